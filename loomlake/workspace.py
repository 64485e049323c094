"""Session helpers: the shared folder for intermediate tables, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and is at most this many bytes.
BROADCAST_LIMIT = 24 << 20


def session(name: str = "loomlake", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the engine is tested under."""
    builder = SparkSession.builder.master(master).appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary folder is made and
    removed at exit.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="loomlake-")
    atexit.register(shutil.rmtree, own, True)
    context.setCheckpointDir("file://" + own)
    return context.getCheckpointDir().rstrip("/")


_OWN: set[str] = set()


def application_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/loomlake/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(_remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    return path


def _remove(jvm, configuration, path: str) -> None:
    try:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(configuration).delete(folder, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone by now
        pass


class Scope:
    """The tables stored inside a ``with`` block; at its end those not kept are deleted."""

    open: list[Scope] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def keep(self, df: DataFrame) -> DataFrame:
        """A table made by ``stored`` that outlives the block (it then belongs to the block around it)."""
        self.kept.add(df._stored_at)
        return df

    def __enter__(self) -> Scope:
        Scope.open.append(self)
        return self

    def __exit__(self, *error) -> None:
        Scope.open.remove(self)
        if Scope.open:
            Scope.open[-1].paths += [p for p in self.paths if p in self.kept]
        for path in self.paths:
            if path not in self.kept:
                _remove(self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration(), path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: the lineage ends at files that
    outlive any executor.  They are deleted at the end of the ``Scope`` around, if there is one, and
    when the driver ends otherwise."""
    path = f"{application_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if Scope.open:
        Scope.open[-1].paths.append(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._stored_at = path
    return made


def small(df: DataFrame, row_bytes: int, limit: int | None = None, rows: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcasting if its counted rows fit into ``limit`` bytes; leave it to a
    shuffled join otherwise.  ``df`` should be cheap to count (a stored table)."""
    limit = BROADCAST_LIMIT if limit is None else limit
    if rows is None:
        rows = df.limit(limit // row_bytes + 1).count()
    return F.broadcast(df) if rows * row_bytes <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
