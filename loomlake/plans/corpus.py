"""Generic relational coverage over the star-schema tables: joins of every kind, grouping sets,
frames, set operations, approximate aggregates and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlake.plans.registry import query
from loomlake.workspace import table


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    l = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")  # noqa: E741
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), revenue.alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def star_join(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))  # noqa: E741
    per = l.groupBy("l_orderkey").agg(F.sum("v").alias("v"))  # aggregated before the joins
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c, n = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    j = per.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("v"), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer FULL OUTER JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def full_outer_join(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "full_outer").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""SELECT event_id, (SELECT max(e.event_id) FROM events e WHERE e.user_id = x.user_id AND e.event_type = 'purchase' AND (e.ts, e.event_id) <= (x.ts, x.event_id)) AS last_purchase FROM events x""")
def asof_join(spark, d):
    """The last purchase of the user up to each event: a running maximum in time order, one pass."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, d, "events").select("event_id", F.max(mark).over(w).alias("last_purchase"))


BANDS = "b AS (SELECT unnest([0, 10, 25, 50]) AS low, unnest([10, 25, 50, 1000000]) AS high)"


@query(f"WITH {BANDS} SELECT low, count(*) AS n FROM events JOIN b ON value >= low AND value < high GROUP BY 1")
def range_join(spark, d):
    """Values against a short fixed table of half-open bands."""
    b = spark.createDataFrame([(0, 10), (10, 25), (25, 50), (50, 1_000_000)], "low int, high int")
    return table(spark, d, "events").join(F.broadcast(b), (F.col("value") >= F.col("low")) & (F.col("value") < F.col("high"))).groupBy("low").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(grouping_id(o_orderpriority, o_orderstatus) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())")
def grouping_sets(spark, d):
    o = table(spark, d, "orders")
    return o.groupingSets([["o_orderpriority"], ["o_orderstatus"], []], "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS rank, CAST(dense_rank() OVER w AS BIGINT) AS dense, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS quarter, round(percent_rank() OVER w, 6) AS part
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice)""")
def ranking(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice")
    q = F.ntile(4).over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), q.cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("part"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1 day' PRECEDING AND CURRENT ROW) AS last_day FROM events")
def range_frame(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(at).rangeBetween(-86_400_000_000, 0)
    return table(spark, d, "events").select("event_id", F.count("*").over(w).alias("last_day"))


@query("SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def except_all(spark, d):
    return table(spark, d, "orders").select("o_custkey").exceptAll(table(spark, d, "customer").select("c_custkey"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def pivot(spark, d):
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).count()
    return p.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("click", "purchase", "view")])


@query("SELECT event_type, true AS near FROM events GROUP BY 1")
def approximate_distinct(spark, d):
    """HyperLogLog counts, tested against the exact ones within three standard errors."""
    g = table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("e"))
    return g.select("event_type", (F.abs(F.col("a") - F.col("e")) <= 0.06 * F.col("e") + 1).alias("near"))


@query("SELECT user_id, round(sum(value * value), 4) AS squares FROM events GROUP BY 1")
def grouped_function(spark, d):
    """A grouped-aggregate pandas function (UDAF)."""


    @F.pandas_udf("double")
    def squares(v: pd.Series) -> float:
        return float((v * v).sum())

    return table(spark, d, "events").groupBy("user_id").agg(F.round(squares("value"), 4).alias("squares"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS breaks FROM documents WHERE text IS NOT NULL")
def line_breaks(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("breaks"))
