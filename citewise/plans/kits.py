"""Queries of the record kits: snapshots, coverage, row checks, networks, keys of cited addresses, sitemaps, scores; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.functions import misc as M
from citewise.functions.exprs import check_key
from citewise.operators import answers as A
from citewise.operators import pairs as P
from citewise.operators import provider as V
from citewise.operators import structure as S
from citewise.operators import validators as W
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


def _sql(spark: SparkSession, d: str, sql: str, *names: str) -> DataFrame:
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql, **{n: table(spark, d, n) for n in names})


@query("""WITH s AS (SELECT o_custkey, year(o_orderdate) < 1996 AS early, max_by(o_orderstatus, o_orderkey) AS status, array_agg(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1, 2),
a AS (SELECT * FROM s WHERE early), b AS (SELECT * FROM s WHERE NOT early), j AS (SELECT a.o_custkey AS k, a.status AS sa, b.status AS sb, a.kinds AS ka, b.kinds AS kb FROM a JOIN b ON a.o_custkey = b.o_custkey)
SELECT o_custkey, 'prompt_set_gap' AS change_type, 'record' AS field, 'present' AS before, 'missing' AS after FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)
UNION ALL SELECT o_custkey, 'prompt_set_gap', 'record', 'missing', 'present' FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)
UNION ALL SELECT k, 'field_change', 'status', sa, sb FROM j WHERE sa <> sb
UNION ALL SELECT k, 'kind_addition', 'kind', '', x FROM (SELECT k, ka, unnest(kb) AS x FROM j) WHERE NOT list_contains(ka, x)
UNION ALL SELECT k, 'kind_removal', 'kind', x, '' FROM (SELECT k, kb, unnest(ka) AS x FROM j) WHERE NOT list_contains(kb, x)""")
def answer_changes(spark: SparkSession, d: str) -> DataFrame:
    early = F.year("o_orderdate") < 1996
    side = lambda c: table(spark, d, "orders").where(c).groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.collect_set("o_orderpriority").alias("kinds"))
    return S.answer_diff(side(early), side(~early), ["o_custkey"], ["status"], {"kind": "kinds"})


NEEDS = "SELECT * FROM (VALUES ('segment', 'BUILDING', '10'), ('segment', 'SPACE', '-1'), ('nation', '7', '5'), ('nation', '9', 'x'), ('stage', 'a', '0')) AS r(dimension, value, minimum)"
PROMPTS = "SELECT CAST(c_custkey / 3 AS STRING) AS prompt_id, CASE c_nationkey WHEN 3 THEN 'disabled' WHEN 4 THEN 'on' ELSE ' active' END AS status, c_mktsegment AS segment, CAST(c_nationkey AS STRING) AS nation FROM customer"


@query(f"""WITH p AS (SELECT * FROM ({PROMPTS.replace('c_custkey / 3', 'c_custkey // 3')}) x WHERE trim(status) = 'active'), v AS (SELECT 'segment' AS dimension, trim(segment) AS value FROM p UNION SELECT 'nation', trim(nation) FROM p)
SELECT dimension, value FROM v WHERE value <> '' AND (dimension, value) NOT IN (SELECT dimension, value FROM ({NEEDS}) y)""")
def prompt_values_unknown(spark: SparkSession, d: str) -> DataFrame:
    return S.unrecognised(_sql(spark, d, PROMPTS.replace("c_custkey / 3", "c_custkey div 3"), "customer"), ["segment", "nation"], spark.sql(NEEDS), "status")


@query(f"""WITH p AS ({PROMPTS.replace('c_custkey / 3', 'c_custkey // 3')}), r AS ({NEEDS})
SELECT 'duplicate_prompt_id' AS code, prompt_id AS value FROM p GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unknown_status', status FROM p WHERE trim(status) NOT IN ('active', 'disabled', 'excluded')
UNION ALL SELECT 'unknown_dimension', dimension FROM r WHERE dimension NOT IN ('segment', 'nation') UNION ALL SELECT 'invalid_minimum', dimension || '=' || value FROM r WHERE coalesce(try_cast(minimum AS INT) < 0, true)""")
def prompt_errors(spark: SparkSession, d: str) -> DataFrame:
    return S.coverage_errors(_sql(spark, d, PROMPTS.replace("c_custkey / 3", "c_custkey div 3"), "customer"), ["segment", "nation"], spark.sql(NEEDS))


SHEET = """SELECT o_orderkey AS row, CASE o_orderkey % 13 WHEN 0 THEN ' ' ELSE 'r' || CAST(o_orderkey - o_orderkey % 2 AS STRING) END AS run_id, CASE o_orderkey % 11 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'late' ELSE 'available' END AS answer_status,
 CASE o_custkey % 9 WHEN 0 THEN 'maybe' WHEN 1 THEN '' WHEN 2 THEN 'TRUE ' ELSE 'false' END AS brand_mentioned, CASE o_custkey % 7 WHEN 0 THEN '' ELSE 'True' END AS brand_recommended, CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '-2' WHEN 2 THEN 'two' ELSE '3' END AS citation_count FROM orders"""


@query(f"""WITH t AS (SELECT row, trim(run_id) AS run_id, answer_status AS s, lower(trim(brand_mentioned)) AS m, lower(brand_recommended) AS r, citation_count AS c FROM ({SHEET}) x), f AS (SELECT row, s, unnest([{{'f': 'brand_mentioned', 'v': m}}, {{'f': 'brand_recommended', 'v': r}}]) AS x FROM t),
first AS (SELECT run_id, min(row) AS first_row FROM t WHERE run_id <> '' GROUP BY 1)
SELECT 'blank_run_id' AS code, '' AS field, row, NULL AS value, NULL AS first_row FROM t WHERE run_id = '' UNION ALL SELECT 'invalid_answer_status', '', row, s, NULL FROM t WHERE s = 'late'
UNION ALL SELECT 'invalid_boolean', x.f, row, x.v, NULL FROM f WHERE s = 'available' AND x.v NOT IN ('true', 'false') UNION ALL SELECT 'unavailable_field_must_be_blank', x.f, row, x.v, NULL FROM f WHERE s = 'unavailable' AND x.v <> ''
UNION ALL SELECT 'invalid_citation_count', '', row, c, NULL FROM t WHERE s = 'available' AND coalesce(try_cast(c AS INT) < 0, true) UNION ALL SELECT 'unavailable_field_must_be_blank', 'citation_count', row, c, NULL FROM t WHERE s <> 'available' AND c <> ''
UNION ALL SELECT 'duplicate_run_id', '', row, run_id, first_row FROM t JOIN first USING (run_id) WHERE row > first_row""")
def answer_row_errors(spark: SparkSession, d: str) -> DataFrame:
    return S.audit_row_errors(_sql(spark, d, SHEET, "orders"))


NAMES = "SELECT l_orderkey AS a, p_brand AS b, l_suppkey % 50 AS p, l_linenumber AS e, l_quantity > 30 AS r FROM lineitem JOIN part ON l_partkey = p_partkey"


@query(f"SELECT b AS brand, count(DISTINCT a) AS answer_count, count(DISTINCT p) AS prompt_count, count(DISTINCT e) AS engine_count, count(DISTINCT CASE WHEN r THEN a END) AS recommended_answer_count FROM ({NAMES}) x WHERE b <> '' GROUP BY 1")
def brand_nodes(spark: SparkSession, d: str) -> DataFrame:
    return S.co_mention_network(_sql(spark, d, NAMES, "lineitem", "part"), "a", "b", "p", "e", F.col("r"))[1]


@query(f"""WITH b AS (SELECT DISTINCT a, b FROM ({NAMES}) x WHERE b <> '')
SELECT x.b AS brand_a, y.b AS brand_b, count(*) AS co_mention_count, md5(string_agg(x.a::varchar, ';' ORDER BY x.a)) AS answers FROM b x JOIN b y ON x.a = y.a AND x.b < y.b GROUP BY 1, 2""")
def brand_edges(spark: SparkSession, d: str) -> DataFrame:
    return S.co_mention_network(_sql(spark, d, NAMES, "lineitem", "part"), "a", "b", "p", "e", F.col("r"))[0].select("brand_a", "brand_b", "co_mention_count", F.md5("answer_ids").alias("answers"))


@query("""WITH r AS (SELECT event_type, count(DISTINCT ts::date) AS n FROM events GROUP BY 1)
SELECT event_type, user_id, count(DISTINCT ts::date) AS run_count, round(count(DISTINCT ts::date)::double / any_value(n), 6) AS coverage FROM events JOIN r USING (event_type) WHERE user_id IS NOT NULL GROUP BY 1, 2""")
def set_items(spark: SparkSession, d: str) -> DataFrame:
    return S.set_coverage(table(spark, d, "events").withColumn("day", F.to_date("ts")), "event_type", "day", "user_id")


@query("""SELECT site, source, target, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'https://www.s' || site || '.example/a' || n ELSE 'https://s' || site || '.example/old' || n END AS url
FROM (SELECT l_suppkey AS site, l_orderkey * 10 + l_linenumber AS source, l_partkey % 3 AS k, l_partkey % 5 AS n, CASE l_partkey % 3 WHEN 0 THEN 'https://s' || l_suppkey || '.example/none' || l_partkey % 5 WHEN 1 THEN 'http://s' || l_suppkey || '.example/a' || l_partkey % 5 || '/?utm_source=x#y' ELSE 'https://s' || l_suppkey || '.example/new' || l_partkey % 5 END AS target FROM lineitem)
WHERE site IN (SELECT s_suppkey FROM supplier)""")
def link_pages(spark: SparkSession, d: str) -> DataFrame:
    host, n = F.concat(F.lit("s"), F.col("site"), F.lit(".example/")), (F.col("l_partkey") % 5).cast("string")
    kind = F.col("l_partkey") % 3
    links = table(spark, d, "lineitem").withColumn("site", F.col("l_suppkey")).select("site", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source"), F.when(kind == 0, F.concat(F.lit("https://"), host, F.lit("none"), n)).when(kind == 1, F.concat(F.lit("http://"), host, F.lit("a"), n, F.lit("/?utm_source=x#y"))).otherwise(F.concat(F.lit("https://"), host, F.lit("new"), n)).alias("target"))
    each = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda n: n.cast("string"))).alias("n"))
    plain = each.select("site", F.concat(F.lit("https://www."), host, F.lit("a"), "n").alias("url"), F.lit(None).cast("string").alias("final_url"))
    moved = each.select("site", F.concat(F.lit("https://"), host, F.lit("old"), "n").alias("url"), F.concat(F.lit("https://"), host, F.lit("new"), "n").alias("final_url"))
    return P.linked_targets(links, plain.unionByName(moved))


CITED = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'HTTP://Shop' || CAST(o_custkey AS STRING) || '.Example:80/a/./b/../g%7Et' WHEN 1 THEN 'https://shop.example:8443/p' || CAST(o_custkey AS STRING) || '?utm_source=x&lang=e%6E&GCLID=2#top' WHEN 2 THEN '../q' || CAST(o_custkey AS STRING) || '?fbclid=1'
 WHEN 3 THEN 'https://shop.example/%zz' || CAST(o_custkey AS STRING) WHEN 4 THEN 'https://shop.example/r%2f' || CAST(o_custkey AS STRING) || '?x=1&x=2&file=a%2fb' ELSE 'ftp://shop.example/' || CAST(o_custkey AS STRING) END AS url, CASE o_orderkey % 6 WHEN 2 THEN 'https://Base.example/one/two/' END AS base FROM orders"""


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'http://shop' || o_custkey || '.example/a/g~t' WHEN 1 THEN 'https://shop.example:8443/p' || o_custkey || '?lang=en' WHEN 2 THEN 'https://base.example/one/q' || o_custkey WHEN 4 THEN 'https://shop.example/r%2F' || o_custkey || '?x=1&x=2&file=a%2Fb' ELSE '' END AS normalized_key,
CASE o_orderkey % 6 WHEN 2 THEN 'relative-resolved' WHEN 3 THEN 'rejected' WHEN 5 THEN 'rejected' ELSE 'normalized' END AS status, CASE WHEN o_orderkey % 6 IN (3, 5) THEN 'reject' ELSE 'compare' END AS decision,
CASE WHEN o_orderkey % 6 IN (3, 5) THEN 'malformed or unsupported URL; no inference' WHEN o_orderkey % 6 = 2 THEN 'fragment removed; tracking-only query dropped' ELSE 'fragment removed; named tracking keys dropped' END AS notes FROM orders""")
def cited_addresses(spark: SparkSession, d: str) -> DataFrame:
    return W.citation_keys(_sql(spark, d, CITED, "orders"), "url", "base").select("id", "normalized_key", "status", "decision", "notes")


@query("""SELECT s_nationkey AS site, 'url' AS kind, 'https://e.example/p?x=1&n=' || s_suppkey AS loc, CASE WHEN s_suppkey % 2 = 0 THEN '2026-01-0' || s_suppkey % 9 + 1 END AS lastmod FROM supplier""")
def sitemap_locations(spark: SparkSession, d: str) -> DataFrame:
    entry = F.concat(F.lit("<url><loc> https://e.example/p?x=1&amp;n="), F.col("s_suppkey"), F.lit(" </loc>"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("<lastmod>2026-01-0"), F.col("s_suppkey") % 9 + 1, F.lit("</lastmod>"))).otherwise(""), F.lit("</url><url><loc></loc></url>"))
    xml = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("site")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("t"))
    return V.sitemap_entries(xml, "site", "t")


SIGNALS = "SELECT o_custkey AS site, o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' ELSE 'fail' END AS status, CASE WHEN o_custkey % 4 > 0 THEN CAST(o_custkey % 101 AS INT) END AS engines FROM orders"


@query(f"""WITH s AS (SELECT site, any_value(engines) AS engines, floor(100 * sum(CASE status WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 ELSE 0 END)::double / count(*) + 0.5) AS signals FROM ({SIGNALS}) x GROUP BY 1)
SELECT site, signals::int AS signals, coalesce(floor(engines * 0.75::double + signals * 0.25::double + 0.5), engines, signals, 0)::int AS overall FROM s""")
def site_visibility(spark: SparkSession, d: str) -> DataFrame:
    s = _sql(spark, d, SIGNALS, "orders").groupBy("site").agg(F.first("engines").alias("engines"), A.site_signal_score(F.collect_list("status")).alias("signals"))
    return s.select("site", F.col("signals").cast("int").alias("signals"), A.overall_visibility(F.col("engines"), F.col("signals")).alias("overall"))


SCORES = "SELECT c_custkey AS site, CASE n WHEN 0 THEN 'content' WHEN 1 THEN 'links' ELSE 'speed' END AS dimension, CASE WHEN (c_custkey + n) % 7 > 0 THEN (c_custkey * 13 + n * 31) % 101 END AS score FROM customer CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS v(n)) w"


@query(f"""WITH a AS (SELECT site, floor(sum(score * w) / sum(w) + 0.5)::bigint AS score FROM (SELECT *, (CASE dimension WHEN 'content' THEN 3.0 WHEN 'links' THEN 2.0 ELSE 1.0 END)::double AS w FROM ({SCORES}) x) WHERE score IS NOT NULL GROUP BY 1),
g AS (SELECT site, CASE WHEN c_nationkey = 5 THEN least(score, 40) ELSE score END AS score, c_nationkey = 5 AS shut FROM a JOIN customer ON c_custkey = site)
SELECT site, score, CASE WHEN shut THEN 'F' WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM g""")
def overall_scores(spark: SparkSession, d: str) -> DataFrame:
    n = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")
    scores = table(spark, d, "customer").select(F.col("c_custkey").alias("site"), n).select("site", F.element_at(F.array(*map(F.lit, ("content", "links", "speed"))), F.col("n") + 1).alias("dimension"), F.when((F.col("site") + F.col("n")) % 7 > 0, (F.col("site") * 13 + F.col("n") * 31) % 101).alias("score"))
    shut = table(spark, d, "customer").where("c_nationkey = 5").select(F.col("c_custkey").alias("site"))
    return S.overall_score(scores, ["site"], {"content": 3.0, "links": 2.0, "speed": 1.0}, shut)


@query("""SELECT o_orderkey AS id, (date_trunc('month', o_orderdate) - INTERVAL 3 MONTH)::date + (day(o_orderdate)::int - 1) AS before, 'www' || o_custkey % 5 || '.example/x' AS page FROM orders""")
def record_days(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://www.WWW"), F.col("o_custkey") % 5, F.lit(".example/x/?utm_medium=a#b"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), M.months_ago(F.to_date("o_orderdate"), 3).alias("before"), check_key(url).alias("page"))
