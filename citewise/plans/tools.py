"""Queries of the page tools, with SQL where one says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.functions.exprs import count_words
from citewise.operators import tools as T
from citewise.operators.shred import shred
from citewise.plans.pages_and_streams import _facts
from citewise.session import cut
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


HEADERS = """SELECT s_suppkey AS site, CASE s_suppkey % 4 WHEN 1 THEN 'max-age=31536000; includeSubDomains; preload' WHEN 2 THEN 'max-age=600' WHEN 3 THEN 'max-age=20000000' END AS hsts, CASE s_suppkey % 3 WHEN 1 THEN 'default-src self' WHEN 2 THEN 'script-src unsafe-inline; frame-ancestors none' END AS csp,
  CASE WHEN s_suppkey % 5 <> 0 THEN 'NoSniff' END AS xcto, CASE WHEN s_suppkey % 6 = 1 THEN 'DENY' END AS xfo, CASE s_suppkey % 7 WHEN 0 THEN 'unsafe-url' WHEN 1 THEN 'no-referrer' END AS rp, CASE WHEN s_suppkey % 8 = 0 THEN 'camera=()' END AS pp, CASE s_suppkey % 9 WHEN 0 THEN 0 WHEN 1 THEN 200 ELSE 301 END AS http_status,
  CASE WHEN s_suppkey % 9 > 1 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'https://' ELSE 'http://' END || 's.example/' END AS http_location, CASE s_suppkey % 10 WHEN 0 THEN 'noindex, follow' WHEN 1 THEN 'none' WHEN 2 THEN 'max-snippet:5' END AS robots, CASE s_suppkey % 11 WHEN 0 THEN 'googlebot: nofollow' WHEN 1 THEN 'otherbot: noindex' END AS x_robots, s_suppkey % 4 <> 3 AS crawlable FROM supplier"""


def _headers(spark: SparkSession, d: str) -> DataFrame:
    h = spark.sql(HEADERS.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, d, "supplier"))
    names = {"strict-transport-security": "hsts", "content-security-policy": "csp", "x-content-type-options": "xcto", "x-frame-options": "xfo", "referrer-policy": "rp", "permissions-policy": "pp"}
    return h.withColumn("headers", F.create_map(*(x for n, c in names.items() for x in (F.lit(n), F.col(c)))))


@query(f"""WITH h AS ({HEADERS}), s AS (SELECT site, CASE WHEN hsts IS NULL THEN 0 WHEN regexp_extract(hsts, 'max-age=(\\d+)', 1)::bigint >= 15552000 THEN 25 ELSE 12 END + CASE WHEN csp IS NULL THEN 0 WHEN contains(csp, 'unsafe-inline') THEN 15 ELSE 25 END + CASE WHEN xcto IS NOT NULL THEN 15 ELSE 0 END
  + CASE WHEN xfo IS NOT NULL OR contains(coalesce(csp, ''), 'frame-ancestors') THEN 15 ELSE 0 END + CASE WHEN rp = 'no-referrer' THEN 10 ELSE 0 END + CASE WHEN pp IS NOT NULL THEN 10 ELSE 0 END AS score FROM h)
SELECT site, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 30 THEN 'D' ELSE 'F' END AS grade FROM s""")
def tool_security_headers(spark: SparkSession, d: str) -> DataFrame:
    return T.security_score(_headers(spark, d), ["site"])


@query(f"""WITH h AS (SELECT *, coalesce(try_cast(regexp_extract(hsts, 'max-age=(\\d+)', 1) AS bigint), 0) AS age FROM ({HEADERS}) x)
SELECT site, item, status FROM h, LATERAL (VALUES ('present', CASE WHEN hsts IS NULL THEN 'fail' ELSE 'pass' END), ('max-age', CASE WHEN age >= 31536000 THEN 'pass' WHEN age >= 15552000 THEN 'warn' WHEN hsts IS NOT NULL THEN 'fail' ELSE 'info' END), ('includeSubDomains', CASE WHEN contains(coalesce(hsts, ''), 'include') THEN 'pass' WHEN hsts IS NOT NULL THEN 'warn' ELSE 'info' END),
  ('preload', CASE WHEN contains(coalesce(hsts, ''), 'preload') THEN 'pass' ELSE 'info' END), ('redirect', CASE WHEN http_status = 301 AND starts_with(http_location, 'https://') THEN 'pass' WHEN http_status = 0 THEN 'info' ELSE 'fail' END)) i(item, status)""")
def tool_hsts(spark: SparkSession, d: str) -> DataFrame:
    return T.hsts_items(_headers(spark, d), ["site"]).drop("value")


@query(f"""WITH h AS (SELECT *, coalesce(robots IN ('noindex, follow', 'none'), false) AS ni, coalesce(robots = 'none', false) OR coalesce(x_robots = 'googlebot: nofollow', false) AS nf FROM ({HEADERS}) x)
SELECT site, item, status FROM h, LATERAL (VALUES ('indexing', CASE WHEN ni THEN 'fail' ELSE 'pass' END), ('links', CASE WHEN nf THEN 'warn' ELSE 'pass' END), ('robots.txt', CASE WHEN crawlable THEN 'pass' WHEN ni THEN 'fail' ELSE 'warn' END)) i(item, status)""")
def tool_meta_robots(spark: SparkSession, d: str) -> DataFrame:
    return T.meta_robots_items(_headers(spark, d), ["site"]).drop("value")


@query("SELECT status, kind, count(*) AS n FROM (SELECT coalesce(http_status, 0) AS status, CASE WHEN coalesce(http_status, 0) = 0 THEN 'no response' WHEN http_status = 200 THEN 'indexable' WHEN http_status IN (301, 308) THEN 'moved for good' WHEN http_status BETWEEN 300 AND 399 THEN 'moved for now' WHEN http_status IN (404, 410) THEN 'gone' WHEN http_status = 429 THEN 'slowed' WHEN http_status BETWEEN 400 AND 499 THEN 'refused' WHEN http_status = 503 THEN 'down for now' ELSE 'server error' END AS kind FROM api_requests) GROUP BY 1, 2")
def tool_status(spark: SparkSession, d: str) -> DataFrame:
    return T.status_items(table(spark, d, "api_requests").withColumnRenamed("status", "state").withColumnRenamed("http_status", "status"))


HOPS = """SELECT o_custkey AS k, 'https://c' || CAST(o_custkey AS STRING) || '.example/' AS start, o_orderkey AS step, 'https://c' || CAST(o_custkey AS STRING) || '.example/' || CAST(CASE WHEN o_custkey % 9 = 0 THEN o_orderkey % 3 ELSE o_orderkey END AS STRING) AS url, CASE o_orderkey % 4 WHEN 0 THEN 301 WHEN 1 THEN 302 WHEN 2 THEN 200 ELSE 308 END AS status,
  CASE WHEN o_orderkey % 4 <> 2 THEN CASE WHEN o_orderkey % 50 = 7 THEN 'http://' ELSE 'https://' END || 'x.example/' || CAST(o_orderkey AS STRING) END AS location, o_orderkey % 300 AS ms FROM orders"""


@query(f"""WITH h AS ({HOPS}), a AS (SELECT start, count(*) FILTER (status >= 300) AS n_hops, coalesce(string_agg(CASE WHEN status >= 300 THEN status::varchar END, ',' ORDER BY step), '') AS codes, count(DISTINCT url) < count(*) AS looped, count(*) FILTER (status = 302) AS n_temporary, coalesce(bool_or(starts_with(location, 'http://')), false) AS downgraded, arg_max(status, step) AS final_status, sum(ms) AS ms FROM h GROUP BY 1)
SELECT start, n_hops, codes, looped, n_temporary, downgraded, final_status, CASE WHEN looped OR downgraded THEN 'fail' WHEN n_hops > 2 OR n_temporary > 0 OR final_status <> 200 OR ms > 2000 THEN 'warn' ELSE 'pass' END AS status FROM a""")
def tool_redirects(spark: SparkSession, d: str) -> DataFrame:
    return T.redirect_chains(spark.sql(HOPS.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders")).drop("k"))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey % 1000 AS source, l_partkey % 1000 AS target FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 1000 <> l_partkey % 1000), b AS (
  SELECT 1::bigint AS page, 0 AS depth UNION SELECT target, depth + 1 FROM b JOIN l ON source = page WHERE depth < 30) SELECT page, min(depth) AS depth FROM b GROUP BY 1""")
def tool_click_depths(spark: SparkSession, d: str) -> DataFrame:
    """Clicks from page 1 where first lines of orders link pages."""
    links = table(spark, d, "lineitem").where("l_linenumber = 1").select((F.col("l_orderkey") % 1000).alias("source"), (F.col("l_partkey") % 1000).alias("target"))
    return T.click_depths(links, spark.range(1, 2).select(F.col("id").alias("page")))


ROBOTS = "User-agent: *\nDisallow: /tools/\nAllow: /tools/canonical\nSitemap: /map.xml\n\nUser-agent: GalaBot\nUser-agent: MoteBot\nDisallow: /*-amber$\nCrawl-delay: 5\n"


@query(r"""WITH p AS (SELECT DISTINCT coalesce(nullif(regexp_extract(page, '(?i)^https?://[^/]+(/[^?#]*)', 1), ''), '/') AS path FROM gsc_daily WHERE page <> '')
SELECT path, bot, NOT CASE WHEN bot = 'Other' THEN starts_with(path, '/tools/') AND NOT starts_with(path, '/tools/canonical') ELSE regexp_matches(path, '-amber$') END AS allowed, CASE WHEN bot = 'Other' THEN '*' ELSE lower(bot) END AS via FROM p, (VALUES ('MoteBot'), ('GalaBot'), ('Other')) b(bot)""")
def tool_bot_access(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("page", r"(?i)^https?://[^/]+(/[^?#]*)", 1)
    p = table(spark, d, "gsc_daily").where("page <> ''").select(F.when(path == "", "/").otherwise(path).alias("path")).distinct()
    return T.bot_access(p.withColumn("robots", F.lit(ROBOTS)).withColumn("at", F.col("path")), ["path"], "robots", "at", ("MoteBot", "GalaBot", "Other")).drop("rule")


@query(r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}]+(?:[''’\-][\p{L}\p{M}\p{N}]+)*')) AS words, length(coalesce(text, '')) AS characters, (CASE WHEN words > 0 THEN greatest(1, ceil(words / 238.0)) ELSE 0 END)::int AS minutes FROM documents""")
def tool_word_counter(spark: SparkSession, d: str) -> DataFrame:
    return T.word_counts(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "words", "characters", "minutes")


@query()
def tool_page_items(spark: SparkSession, d: str) -> DataFrame:
    """On-page, sharing and source items of every page source, each with its tool. The facts they need are written once and read by each."""
    n_words = count_words(F.coalesce("text", F.lit("")))
    f = cut(_facts(spark, d).withColumn("n_words", n_words).drop("text", "main_text", "blocks")).withColumn("status", F.lit(200))
    html = table(spark, d, "documents").where("doc_type = 'page_html'").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    parts = {"onpage": T.onpage_items(f, ["doc_id"]), "og": T.og_items(f, ["doc_id"]), "twitter": T.twitter_items(f, ["doc_id"]), "facebook": T.facebook_items(f, ["doc_id"]), "html": T.html_items(html, ["doc_id"], "text")}
    out = None
    for name, df in parts.items():
        df = df.withColumn("tool", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


@query()
def tool_links(spark: SparkSession, d: str) -> DataFrame:
    return T.link_rows(_facts(spark, d), "doc_id")


@query()
def tool_schema_fields(spark: SparkSession, d: str) -> DataFrame:
    """What typed objects in the audits' results lack; the results hold few schema types."""
    return T.schema_fields(shred(table(spark, d, "audits"), "id", "result"))


READY = """SELECT s_suppkey AS site, 5 AS n_bots, s_suppkey % 6 AS n_bots_blocked, 2 AS n_live, s_suppkey % 3 AS n_live_blocked, s_suppkey * 7 AS n_words, CASE WHEN s_suppkey % 8 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN s_suppkey % 9 = 1 THEN 'noindex' END AS robots, CASE s_suppkey % 4 WHEN 0 THEN 'https://s.example' WHEN 1 THEN 'https://x.example/' END AS canonical,
  CASE WHEN s_suppkey % 7 = 0 THEN 'http://s.example/' ELSE 'https://s.example/' END AS url, s_suppkey % 5 AS n_entity, s_suppkey % 90 AS first_words, s_suppkey % 4 AS n_questions, s_suppkey % 6 = 0 AS has_faq, s_suppkey % 4 AS n_lists, CASE WHEN s_suppkey % 5 > 0 THEN 't' END AS title, CASE WHEN s_suppkey % 3 > 0 THEN 'd' END AS description, s_suppkey % 2 = 0 AS has_sitemap, s_suppkey % 10 = 0 AS has_llms FROM supplier"""


@query(f"""WITH r AS ({READY}), s AS (SELECT site, floor(20 * (1 - n_bots_blocked / 5.0) + 0.5) + floor(15 * (1 - n_live_blocked / 2.0) + 0.5) + CASE WHEN n_words >= 200 THEN 15 WHEN n_words >= 80 THEN 8 ELSE 0 END + CASE WHEN status = 200 AND robots IS NULL THEN 7 ELSE 0 END
  + CASE WHEN canonical IS NULL OR regexp_replace(canonical, '/$', '') = regexp_replace(url, '/$', '') THEN 3 ELSE 0 END + floor(10 * n_entity / 4.0 + 0.5) + CASE WHEN first_words BETWEEN 12 AND 70 THEN 4 ELSE 0 END + CASE WHEN n_questions >= 2 OR has_faq THEN 3 ELSE 0 END + CASE WHEN n_lists >= 2 THEN 3 ELSE 0 END
  + CASE WHEN title IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN description IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN has_sitemap THEN 5 ELSE 0 END + CASE WHEN starts_with(url, 'https://') THEN 5 ELSE 0 END + CASE WHEN has_llms THEN 5 ELSE 0 END AS x FROM r)
SELECT site, least(x, 100)::int AS score, CASE WHEN x >= 80 THEN 'pass' WHEN x >= 55 THEN 'warn' ELSE 'fail' END AS verdict FROM s""")
def tool_readiness(spark: SparkSession, d: str) -> DataFrame:
    return T.readiness(spark.sql(READY.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, d, "supplier")), ["site"])
