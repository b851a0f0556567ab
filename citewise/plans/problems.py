"""Queries of the general data problems: rolling totals, orphan references, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.operators.orphans import References
from citewise.operators.rolling import page_rolling
from citewise.operators.shred import element_paths, entity_table, objects, shred
from citewise.sources.tables import table


SERP_FIELDS = ("type", "rank_group", "rank_absolute", "title", "domain", "url")
ANCHOR_FIELDS = ("type", "anchor", "rank", "backlinks", "referring_domains", "first_seen")
ANSWER_FIELDS = ("engine", "questionId", "question", "mentioned", "rank", "sentiment")


def p1_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_rolling(table(spark, sf_dir, "gsc_daily"))


def _references(spark: SparkSession, sf_dir: str, created_at: str | None = "created_at") -> References:
    children = {name: (table(spark, sf_dir, name), "id", "last_audit_id" if name == "monitors" else "audit_id", "audits") for name in ("api_requests", "report_orders", "leads", "monitors")}
    return References(children, {"audits": (table(spark, sf_dir, "audits"), "id", table(spark, sf_dir, "audit_deletions"), "audit_id")}, created_at=created_at)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir, None).orphans().select("src_table", "record_id", "state")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir).counts()


def _sources(spark: SparkSession, sf_dir: str) -> dict:
    return {
        "audits": (table(spark, sf_dir, "audits"), "id", "result"),
        "dfs_backlinks_anchors": (table(spark, sf_dir, "dfs_backlinks_anchors"), "record_id", "payload"),
        "dfs_serp_advanced": (table(spark, sf_dir, "dfs_serp_advanced"), "record_id", "payload"),
    }


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return element_paths(_sources(spark, sf_dir))


def p6_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, (df, rid, text) in _sources(spark, sf_dir).items():
        part = shred(df, rid, text).select(F.lit(name).alias("src"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def p6_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(_sources(spark, sf_dir))


def p6_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p6_nodes holds, added up: nodes, their places in arrays, and characters of strings, by source, shape and kind."""
    text = F.when(F.col("kind") == "string", F.length("scalar"))
    return p6_nodes(spark, sf_dir).groupBy("src", "shape", "kind").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("n_records"), F.sum("ordinal").alias("places"), F.sum(text).alias("n_chars"), F.count("parent").alias("n_below"))


def p6_object_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p6_objects holds, added up: objects, their scalar fields and those with a containing object, by source and shape."""
    return p6_objects(spark, sf_dir).groupBy("src", "shape").agg(F.count("*").alias("n"), F.sum(F.size("fields")).alias("n_fields"), F.count("parent_node").alias("n_below"), F.sum("ordinal").alias("places"))


def p6_serp_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_table(table(spark, sf_dir, "dfs_serp_advanced"), "record_id", "payload", "fetched_at", "tasks[].result[].items[]", SERP_FIELDS)


def p6_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_table(table(spark, sf_dir, "dfs_backlinks_anchors"), "record_id", "payload", "fetched_at", "tasks[].result[].items[]", ANCHOR_FIELDS)


def p6_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_table(table(spark, sf_dir, "audits"), "id", "result", "loaded_at", "matrix[]", ANSWER_FIELDS)


QUERIES = {f.__name__: f for f in (p1_rolling, p3_found, p3_counts, p6_found, p6_nodes, p6_objects, p6_shapes, p6_object_shapes, p6_serp_items, p6_anchors, p6_answers)}

_DAY = """coalesce(
  try_strptime(regexp_extract(trim(date), '^([0-9]{4}-[0-9]{2}-[0-9]{2})([T ].*)?$', 1), '%Y-%m-%d'),
  try_strptime(regexp_extract(trim(date), '^[0-9]{4}/[0-9]{2}/[0-9]{2}$', 0), '%Y/%m/%d'),
  try_strptime(regexp_extract(trim(date), '^[0-9]{8}$', 0), '%Y%m%d'),
  try_strptime(regexp_extract(trim(date), '^[0-9]{2}[.][0-9]{2}[.][0-9]{4}$', 0), '%d.%m.%Y'))::date"""

_ORPHANS = r"""
WITH child AS (
  SELECT 'api_requests' AS src_table, id, audit_id AS ref, loaded_at, created_at FROM api_requests
  UNION ALL SELECT 'report_orders', id, audit_id, loaded_at, created_at FROM report_orders
  UNION ALL SELECT 'leads', id, audit_id, loaded_at, created_at FROM leads
  UNION ALL SELECT 'monitors', id, last_audit_id, loaded_at, created_at FROM monitors),
keyed AS (
  SELECT src_table, id AS record_id, lower(regexp_replace(ref, '[^A-Za-z0-9]', '', 'g')) AS key, min(loaded_at) AS loaded,
         date_trunc('month', min(created_at))::date AS period
  FROM child GROUP BY 1, 2, 3),
own AS (SELECT id AS key, min(loaded_at) AS parent_at FROM audits GROUP BY 1),
judged AS (
  SELECT src_table, record_id, keyed.key, period,
         CASE WHEN own.key IS NOT NULL THEN CASE WHEN parent_at > loaded THEN 'late' END
              WHEN keyed.key IN (SELECT audit_id FROM audit_deletions WHERE audit_id IS NOT NULL) THEN 'deleted' ELSE 'missing' END AS state
  FROM keyed LEFT JOIN own ON own.key = keyed.key WHERE length(keyed.key) = 11 AND record_id IS NOT NULL)
"""

ORACLE = {
    "p1_rolling": f"""
WITH rows AS (SELECT {_DAY} AS day, page, coalesce(query, '') AS query, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions, pulled_at FROM gsc_daily),
once AS (SELECT * FROM rows WHERE day IS NOT NULL QUALIFY row_number() OVER (PARTITION BY day, page, query ORDER BY pulled_at DESC, clicks DESC, impressions DESC) = 1),
daily AS (SELECT page, day, sum(clicks)::bigint AS clicks, sum(impressions)::bigint AS impressions FROM once GROUP BY 1, 2),
calendar AS (SELECT unnest(generate_series(min(day), max(day), interval 1 day))::date AS day FROM daily),
dense AS (SELECT p.page, c.day, coalesce(d.clicks, 0) AS clicks, coalesce(d.impressions, 0) AS impressions
          FROM (SELECT DISTINCT page FROM daily) p CROSS JOIN calendar c LEFT JOIN daily d ON d.page = p.page AND d.day = c.day)
SELECT page, day, clicks, impressions,
  sum(clicks) OVER w7::bigint AS clicks_7d_total, avg(clicks) OVER w7 AS clicks_7d_avg,
  sum(impressions) OVER w7::bigint AS impressions_7d_total, avg(impressions) OVER w7 AS impressions_7d_avg,
  sum(clicks) OVER w30::bigint AS clicks_30d_total, avg(clicks) OVER w30 AS clicks_30d_avg,
  sum(impressions) OVER w30::bigint AS impressions_30d_total, avg(impressions) OVER w30 AS impressions_30d_avg
FROM dense
WINDOW w7 AS (PARTITION BY page ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY page ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "p3_found": _ORPHANS + "SELECT src_table, record_id, state FROM judged WHERE state IS NOT NULL",
    "p3_counts": _ORPHANS + "SELECT src_table, period, state, count(*) AS n, count(DISTINCT key) AS n_keys FROM judged WHERE state IS NOT NULL GROUP BY 1, 2, 3",
}


def _tree(source: str) -> str:
    """Nodes of the valid texts of a source (src, record_id, got_at, p): json strings are read as the JSON within."""
    return f"""
WITH texts AS ({source}),
inner_texts AS (SELECT src, record_id, got_at, p, CASE WHEN json_valid(p) AND json_type(p) = 'VARCHAR' THEN json_extract_string(p, '$') ELSE p END AS q FROM texts WHERE p IS NOT NULL),
docs AS (SELECT src, record_id, got_at, p, CASE WHEN json_valid(q) THEN q END AS q FROM inner_texts WHERE json_valid(q)),
tree AS (SELECT src, record_id, j.rowid AS node, j.* FROM docs, json_tree(docs.q) j)
"""


ORACLE["p6_found"] = _tree("""SELECT 'audits' AS src, id AS record_id, loaded_at AS got_at, result AS p FROM audits
  UNION ALL SELECT 'dfs_backlinks_anchors', record_id, fetched_at, payload FROM dfs_backlinks_anchors
  UNION ALL SELECT 'dfs_serp_advanced', record_id, fetched_at, payload FROM dfs_serp_advanced""") + r"""
SELECT DISTINCT src, record_id, replace(regexp_replace(fullkey, '^\$\.?', ''), '"', '') AS path FROM tree WHERE type = 'OBJECT' AND ends_with(fullkey, ']')"""


_THREE = """SELECT 'audits' AS src, id AS record_id, loaded_at AS got_at, result AS p FROM audits
  UNION ALL SELECT 'dfs_backlinks_anchors', record_id, fetched_at, payload FROM dfs_backlinks_anchors
  UNION ALL SELECT 'dfs_serp_advanced', record_id, fetched_at, payload FROM dfs_serp_advanced"""
_SHAPE = r"""replace(regexp_replace(regexp_replace(fullkey, '^\$\.?', ''), '\[\d+\]', '[]', 'g'), '"', '')"""
ORACLE["p6_shapes"] = _tree(_THREE) + rf"""
SELECT src, {_SHAPE} AS shape, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS kind,
  count(*) AS n, count(DISTINCT record_id) AS n_records, sum(CASE WHEN ends_with(fullkey, ']') THEN key::bigint END)::bigint AS places, sum(CASE WHEN type = 'VARCHAR' THEN length(json_extract_string(value, '$')) END)::bigint AS n_chars, count(parent) AS n_below
FROM tree GROUP BY 1, 2, 3"""
ORACLE["p6_object_shapes"] = _tree(f"SELECT DISTINCT src, record_id, NULL AS got_at, p FROM ({_THREE}) x") + rf"""
, one AS (SELECT src, record_id, hash(p) AS doc, j.id, j.parent, j.type, j.fullkey, j.key FROM docs, json_tree(docs.q) j), f AS (SELECT src, record_id, doc, parent AS id, count(DISTINCT key) AS n FROM one WHERE type NOT IN ('OBJECT', 'ARRAY') AND NOT ends_with(fullkey, ']') GROUP BY 1, 2, 3, 4)
SELECT src, {_SHAPE} AS shape, count(*) AS n, sum(coalesce(f.n, 0))::bigint AS n_fields, count(o.parent) AS n_below, sum(CASE WHEN ends_with(fullkey, ']') THEN key::bigint END)::bigint AS places
FROM one o LEFT JOIN f USING (src, record_id, doc, id) WHERE type = 'OBJECT' GROUP BY 1, 2"""


def _entities(table_name: str, record_id: str, text: str, at: str, shape: str, fields: tuple[str, ...]) -> str:
    values = ", ".join(f"""max(CASE WHEN t.fullkey = o.fullkey || '.{f}' AND t.type NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(t.value, '$') END) AS "{f}" """ for f in fields)
    latest = f"SELECT 's' AS src, {record_id} AS record_id, {at} AS got_at, {text} AS p FROM (SELECT DISTINCT {record_id}, {at}, {text} FROM {table_name} WHERE {text} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {record_id} ORDER BY {at} DESC) = 1)"
    return _tree(latest) + rf"""
, o AS (SELECT record_id, fullkey, id, key, parent, node FROM tree WHERE type = 'OBJECT' AND regexp_matches(fullkey, '^\$\.{shape}$'))
SELECT o.record_id, o.node::int AS node, b.node::int AS parent_node, o.key::int AS ordinal, regexp_replace(o.fullkey, '^\$\.?', '') AS path, {values}
FROM o JOIN tree a ON a.record_id = o.record_id AND a.id = o.parent JOIN tree b ON b.record_id = o.record_id AND b.id = a.parent
  LEFT JOIN tree t ON t.record_id = o.record_id AND t.parent = o.id GROUP BY 1, 2, 3, 4, 5"""


ORACLE["p6_serp_items"] = _entities("dfs_serp_advanced", "record_id", "payload", "fetched_at", r"tasks\[\d+\]\.result\[\d+\]\.items\[\d+\]", SERP_FIELDS)
ORACLE["p6_anchors"] = _entities("dfs_backlinks_anchors", "record_id", "payload", "fetched_at", r"tasks\[\d+\]\.result\[\d+\]\.items\[\d+\]", ANCHOR_FIELDS)
ORACLE["p6_answers"] = _entities("audits", "id", "result", "loaded_at", r"matrix\[\d+\]", ANSWER_FIELDS)
