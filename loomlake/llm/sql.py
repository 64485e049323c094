"""DuckDB forms of the queries that plain SQL can express on whole tables."""

_TYPED = r"""
typed AS (SELECT sample_id, min(t) AS sample_type FROM (
    SELECT sample_id, regexp_replace(regexp_replace(lower(sample_type), '^\s+|\s+$', '', 'g'), '[-\s]', '_', 'g') AS t FROM samples)
  WHERE sample_id IS NOT NULL
    AND t IN ('policy_qa', 'policy_application', 'tool_selection', 'trajectory', 'clarification', 'exception')
  GROUP BY sample_id),
available AS (SELECT sample_type, count(*) AS n FROM typed GROUP BY sample_type),
plans AS (SELECT plan_id, regexp_replace(regexp_replace(lower(sample_type), '^\s+|\s+$', '', 'g'), '[-\s]', '_', 'g') AS sample_type,
    target_bp, min_rows, ((SELECT count(*) FROM typed) * draw_percent) // 100 AS draw FROM sample_plan),
needs AS (SELECT p.plan_id, p.sample_type, CAST(draw AS BIGINT) AS draw,
    CAST(greatest(min_rows, (draw * target_bp + 9999) // 10000) AS BIGINT) AS needed, CAST(coalesce(n, 0) AS BIGINT) AS available
  FROM plans p LEFT JOIN available a ON a.sample_type = p.sample_type)
"""

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_TEXTS = f"""
texts AS (SELECT sample_id, any_value({_WORDS.format("array_to_string([m.content FOR m IN messages IF m.role IN ('user', 'assistant') AND m.content IS NOT NULL], chr(10))")}) AS w
  FROM samples WHERE sample_id IS NOT NULL GROUP BY 1),
grams AS (SELECT DISTINCT sample_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT sample_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts WHERE len(w) >= 3)),
sizes AS (SELECT sample_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.sample_id AS a, b.sample_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.sample_id < b.sample_id GROUP BY 1, 2),
near AS (SELECT a, b FROM shared JOIN sizes x ON x.sample_id = a JOIN sizes y ON y.sample_id = b WHERE c >= 0.6e0 * (x.n + y.n - c))"""
_SPLITS = r"splits AS (SELECT sample_id, min(regexp_replace(lower(split_name), '^\s+|\s+$', '', 'g')) AS split FROM split_rows WHERE sample_id IS NOT NULL GROUP BY 1)"
#: Smallest label of a component: cc(node, label) over the symmetric edges e(a, b).
_CLOSURE = """cc(node, label) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION
  SELECT e.b, min(cc.label) FROM cc JOIN e ON e.a = cc.node JOIN recurring.cc AS r ON r.node = e.b WHERE cc.label < r.label GROUP BY e.b)"""
_FAMILY = r"regexp_replace(lower(scenario_family), '^\s+|\s+$', '', 'g')"
_TIES = f"""
t AS (SELECT sample_id, CASE WHEN {_FAMILY} NOT IN ('', 'unknown') THEN {_FAMILY} END AS family, unnest(CASE WHEN coalesce(len(source_doc_ids), 0) = 0 THEN [NULL] ELSE source_doc_ids END) AS doc FROM samples),
ties AS (SELECT DISTINCT sample_id, family, CASE WHEN trim(doc) <> '' THEN doc END AS doc FROM t),
keys AS (SELECT DISTINCT sample_id, 'f:' || family AS key FROM ties WHERE family IS NOT NULL UNION SELECT DISTINCT sample_id, 'd:' || doc FROM ties WHERE doc IS NOT NULL),
stars AS (SELECT sample_id AS a, min(sample_id) OVER (PARTITION BY key) AS b FROM keys),
e AS (SELECT a, b FROM stars WHERE a <> b UNION SELECT b, a FROM stars WHERE a <> b)"""
_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_THIRTEEN = "array_to_string(w[i:i + 12], ' ')"

SQL = {
    "p2_found": f"""WITH {_TEXTS}, {_SPLITS} SELECT a AS sample_id_a, b AS sample_id_b FROM near JOIN splits x ON x.sample_id = a JOIN splits y ON y.sample_id = b
      WHERE (x.split = 'train' AND y.split IN ('validation', 'holdout')) OR (y.split = 'train' AND x.split IN ('validation', 'holdout'))""",
    "p3_found": f"""WITH RECURSIVE {_TIES}, {_CLOSURE} SELECT node AS sample_id, group_key FROM cc JOIN (SELECT label, coalesce(min(family), min(doc)) AS group_key FROM cc JOIN ties ON sample_id = node GROUP BY 1) USING (label)""",
    "p4_found": f"""WITH {_SPLITS}, items AS (SELECT item_id, {_WORDS.format("x")} AS w FROM (SELECT item_id, question AS x FROM eval_items UNION ALL SELECT item_id, answer FROM eval_items)),
      g AS (SELECT DISTINCT item_id, {_THIRTEEN} AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM items WHERE len(w) >= 13)),
      said AS (SELECT sample_id, {_WORDS.format("m.content")} AS w FROM (SELECT sample_id, unnest(messages) AS m FROM samples)),
      h AS (SELECT sample_id, {_THIRTEEN} AS gram FROM (SELECT sample_id, w, unnest(range(1, len(w) - 11)) AS i FROM said WHERE len(w) >= 13))
      SELECT DISTINCT item_id, sample_id FROM g JOIN h USING (gram) JOIN splits USING (sample_id) WHERE split = 'train'""",
    "p6_found": f"""WITH RECURSIVE {_TEXTS}, e AS (SELECT a, b FROM near UNION SELECT b, a FROM near), {_CLOSURE} SELECT node AS sample_id, label AS group_id FROM cc""",
    "p7_found": f"""WITH c AS (SELECT chunk_id, text FROM chunks WHERE length(text) > 1200 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) = 1),
      m AS (SELECT chunk_id, replace(replace(regexp_replace(text, '([.!?])({_SPACE})', '\\1' || chr(1) || '\\2', 'g'), chr(10), chr(10) || chr(1)), '。', '。' || chr(1)) AS t FROM c)
      SELECT chunk_id, CASE WHEN list_max([length(x) FOR x IN string_split(t, chr(1))]) > 1200 THEN 'forced' ELSE 'boundary' END AS kind FROM m""",
    "p1_found": f"WITH {_TYPED} SELECT plan_id, sample_type FROM needs WHERE needed > available",
    "p1_report": f"WITH {_TYPED} SELECT plan_id, sample_type, draw, needed, available, needed > available AS short FROM needs",
}
