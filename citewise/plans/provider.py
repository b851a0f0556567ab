"""Queries of the provider operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.operators import provider as P
from citewise.operators.shred import entity_table
from citewise.plans.problems import ORACLE as PROBLEMS
from citewise.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _items(spark: SparkSession, d: str) -> DataFrame:
    serp = table(spark, d, "dfs_serp_advanced")
    items = entity_table(serp, "record_id", "payload", "fetched_at", "tasks[].result[].items[]", ("type", "rank_absolute", "url"))
    return items.join(serp.select("record_id", "keyword").distinct(), "record_id")


ITEMS = f"WITH items AS (SELECT i.*, k.keyword FROM ({PROBLEMS['p6_serp_items']}) i JOIN (SELECT DISTINCT record_id, keyword FROM dfs_serp_advanced) k USING (record_id))"
HOST = r"nullif(regexp_replace(lower(regexp_extract(trim(url), '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '')"


@query(ITEMS + f""", h AS (SELECT keyword, try_cast(rank_absolute AS int) AS rank, {HOST} AS host, url FROM items),
b AS (SELECT keyword, host, min(struct_pack(rank := coalesce(rank, -1), url := url)) AS b FROM h WHERE host IS NOT NULL GROUP BY 1, 2)
SELECT keyword, place, host, b.url AS url FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY b.rank, host) AS place FROM b) WHERE place <= 5""")
def serp_top_hosts(spark: SparkSession, d: str) -> DataFrame:
    return P.top_hosts(_items(spark, d), "keyword", "rank_absolute", "url", F.lit(None).cast("string"))


@query(ITEMS + " SELECT type AS kind, count(DISTINCT keyword) AS n_queries, round(count(DISTINCT keyword)::double / (SELECT count(DISTINCT keyword) FROM items), 4) AS share FROM items WHERE type IS NOT NULL GROUP BY 1")
def serp_features(spark: SparkSession, d: str) -> DataFrame:
    return P.feature_shares(_items(spark, d), "keyword", "type")


@query(f"""WITH i AS (SELECT x.*, k.target FROM ({PROBLEMS['p6_anchors']}) x JOIN (SELECT DISTINCT record_id, target FROM dfs_backlinks_anchors) k USING (record_id)),
r AS (SELECT target, lower(trim(coalesce(anchor, ''))) AS a, sum(coalesce(try_cast(backlinks AS bigint), 0))::bigint AS n FROM i GROUP BY 1, 2),
g AS (SELECT target, sum(n)::bigint AS total, count(*) AS n_anchors, max(struct_pack(n := n, a := a)) AS m FROM r GROUP BY 1)
SELECT target, total, n_anchors, m.a AS top_anchor, CASE WHEN total <> 0 THEN round(m.n::double / total, 4) END AS top_share,
  CASE WHEN total = 0 THEN 'na' WHEN round(m.n::double / total, 4) <= 0.4 THEN 'pass' WHEN round(m.n::double / total, 4) <= 0.6 THEN 'warn' ELSE 'fail' END AS status FROM g""")
def anchor_profile(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "dfs_backlinks_anchors")
    a = entity_table(raw, "record_id", "payload", "fetched_at", "tasks[].result[].items[]", ("anchor", "backlinks")).join(raw.select("record_id", "target").distinct(), "record_id")
    return P.anchor_profile(a, "target", "anchor", "backlinks")


@query("SELECT strftime(created_at, '%Y-%m') AS month, status, count(*) AS n FROM report_orders WHERE created_at IS NOT NULL GROUP BY 1, 2")
def orders_by_month(spark: SparkSession, d: str) -> DataFrame:
    return P.monthly(table(spark, d, "report_orders"), "created_at", ["status"])


@query("""SELECT id, next_run_at FROM (SELECT id, min(next_run_at) AS next_run_at FROM monitors WHERE active AND id IS NOT NULL AND (next_run_at IS NULL OR next_run_at <= TIMESTAMP '2026-08-01') GROUP BY 1)
ORDER BY next_run_at NULLS FIRST, id LIMIT 10""")
def due_monitors(spark: SparkSession, d: str) -> DataFrame:
    return P.due(table(spark, d, "monitors"), F.lit("2026-08-01").cast("timestamp_ntz"))


@query("""SELECT o_orderkey, o_orderpriority, turn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn FROM orders) ORDER BY turn, o_orderpriority LIMIT 37""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return P.stratified(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 37)


@query(ITEMS + f""", h AS (SELECT {HOST} AS host FROM items), l AS (SELECT host, string_split(host, '.') AS p FROM h WHERE host IS NOT NULL)
SELECT array_to_string(list_slice(p, greatest(len(p) - CASE WHEN regexp_matches(host, '\\.(co|com|org|net|gov|ac|edu)\\.[a-z]{{2}}$') THEN 2 ELSE 1 END, 1), len(p)), '.') AS domain, count(*) AS n, count(DISTINCT host) AS n_hosts FROM l GROUP BY 1""")
def serp_domains(spark: SparkSession, d: str) -> DataFrame:
    return P.domain_counts(_items(spark, d), "url")


@query(r"""WITH p AS (SELECT DISTINCT page FROM gsc_daily WHERE page <> ''),
t AS (SELECT page, unnest(list_distinct(string_split(regexp_extract(regexp_replace(page, '[?#].*$', ''), '([a-z0-9-]+)/?$', 1), '-'))) AS topic FROM p)
SELECT topic, count(*) AS n_pages, min(page) AS hub FROM t GROUP BY 1 HAVING count(*) > 1""")
def slug_topics(spark: SparkSession, d: str) -> DataFrame:
    slug = F.regexp_extract(F.regexp_replace("page", r"[?#].*$", ""), r"([a-z0-9-]+)/?$", 1)
    return P.topic_pages(table(spark, d, "gsc_daily").where("page <> ''").select("page").distinct(), "page", F.split(slug, "-"))


@query("""SELECT s_suppkey, CASE WHEN own > 0 AND rival > 0 THEN round(greatest(0.0, least(100.0, 100 - 15 * greatest(log2(rival / own), 0.0))), 1) END AS score
FROM (SELECT l_suppkey AS s_suppkey, sum(l_quantity) AS own, max(sum(l_quantity)) OVER () AS rival FROM lineitem GROUP BY 1)""")
def competitor_scores(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("own"))
    top = own.agg(F.max("own")).first()[0]
    return own.select("s_suppkey", P.competitor_score(F.col("own"), F.lit(top)).alias("score"))
