"""Queries of the pair, sampling and small-value operators over the common tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.functions import exprs as E
from citewise.functions import misc as M
from citewise.functions import text as X
from citewise.operators import pairs as P
from citewise.operators import ranking as R
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


RESULTS = """SELECT l_orderkey AS query, l_linenumber AS position, 'https://www.h' || CAST(l_suppkey % 20 AS STRING) || '.example/p' || CAST(l_partkey % 3 AS STRING) || CASE WHEN l_partkey % 2 = 0 THEN '/' ELSE '?utm_source=x' END AS url,
  CASE l_partkey % 5 WHEN 0 THEN 'listicle' WHEN 1 THEN 'comparison' WHEN 2 THEN 'product' WHEN 3 THEN 'pricing' ELSE 'article' END AS format, l_linenumber <> 3 AS fetched, CAST(l_quantity AS BIGINT) AS n_numbers, l_partkey % 4 AS n_tables FROM lineitem"""


def _sql(spark: SparkSession, d: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=table(spark, d, name))


@query(f"""WITH r AS ({RESULTS}), k AS (SELECT query, regexp_extract(url, 'h\\d+', 0) || regexp_extract(url, '/p\\d', 0) AS k, min(position) AS position, arg_min(url, (position, url)) AS url FROM r WHERE NOT contains(url, '//www.h7.example/') GROUP BY 1, 2)
SELECT query, place, url, position FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY position, url) AS place FROM k) WHERE place <= 5""")
def pair_rivals(spark: SparkSession, d: str) -> DataFrame:
    return P.rivals_of(_sql(spark, d, RESULTS, "lineitem"), F.lit("h7.example"))


@query(f"""WITH r AS ({RESULTS}), b AS (SELECT query, median(n_numbers) AS a, median(n_tables) AS b FROM r WHERE fetched GROUP BY 1)
SELECT o.query, greatest(0, floor(o.n_numbers - coalesce(a, 0) + 0.5))::int AS extra_numbers, greatest(0, floor(o.n_tables - coalesce(b, 0) + 0.5))::int AS extra_tables FROM (SELECT o_orderkey AS query, (floor(o_totalprice)::bigint % 60) AS n_numbers, o_custkey % 5 AS n_tables FROM orders) o LEFT JOIN b ON b.query = o.query""")
def pair_gain(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("query"), (F.floor("o_totalprice").cast("long") % 60).alias("n_numbers"), (F.col("o_custkey") % 5).alias("n_tables"))
    return P.gain_signals(own, _sql(spark, d, RESULTS, "lineitem"))


@query(f"""WITH r AS (SELECT *, CASE WHEN format IN ('listicle', 'comparison') THEN 'list' WHEN format IN ('product', 'pricing') THEN 'commerce' ELSE 'editorial' END AS g FROM ({RESULTS}) x),
g AS (SELECT query, g FROM (SELECT query, g, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, min(position), g) AS n FROM r GROUP BY query, g) WHERE n = 1),
f AS (SELECT query, format FROM (SELECT r.query, format, row_number() OVER (PARTITION BY r.query ORDER BY count(*) DESC, min(position), format) AS n FROM r JOIN g ON g.query = r.query AND g.g = r.g GROUP BY r.query, format) WHERE n = 1)
SELECT query, format FROM f WHERE query IN (SELECT query FROM r GROUP BY 1 HAVING count(*) > 1)""")
def pair_formats(spark: SparkSession, d: str) -> DataFrame:
    return P.dominant_formats(_sql(spark, d, RESULTS, "lineitem"))


@query("""WITH t AS (SELECT DISTINCT p_name AS target, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), lambda w: w NOT IN ('a', 'an', 'the', 'of', 'for', 'to', 'in', 'on', 'and', 'or', 'with', 'at', 'by', 'from', 'is', 'are')))), ' ') AS k FROM part),
b AS (SELECT k, min({'p': p_partkey % 97, 'n': p_name, 'u': 'u' || p_partkey}) AS r FROM (SELECT p_partkey, p_name, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'))), ' ') AS k FROM part) GROUP BY 1)
SELECT target, r.n AS keyword, r.u AS url, r.p AS position FROM t LEFT JOIN b ON b.k = t.k""")
def pair_targets(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return P.ranked_targets(p.select(F.col("p_name").alias("target")).distinct(), p.select(F.col("p_name").alias("keyword"), F.concat(F.lit("u"), "p_partkey").alias("url"), (F.col("p_partkey") % 97).alias("position")))


@query("""WITH k AS (SELECT o_custkey AS c, year(o_orderdate) AS y, sum(o_totalprice) AS v, max(o_orderstatus) AS s FROM orders GROUP BY 1, 2), a AS (SELECT * FROM k WHERE y = 1995), b AS (SELECT * FROM k WHERE y = 1996)
SELECT coalesce(a.c, b.c) AS c, CASE WHEN a.c IS NOT NULL AND coalesce(b.s, '') <> 'O' THEN a.v ELSE b.v END AS v, CASE WHEN a.c IS NOT NULL AND coalesce(b.s, '') <> 'O' THEN a.s ELSE b.s END AS s, a.c IS NOT NULL AND coalesce(b.s, '') <> 'O' AS kept FROM a FULL JOIN b ON a.c = b.c""")
def kept_and_fresh(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"), F.max("o_orderstatus").alias("s"))
    return P.kept_and_fresh(k.where("y = 1995").drop("y"), k.where("y = 1996").drop("y"), ["c"], F.col("s") == "O")


@query("SELECT c_custkey, c_name, coalesce(n, 0) AS n, coalesce(s, 'absent') AS s FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON o_custkey = c_custkey")
def items_with_absent(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("s"))
    return P.with_absent(table(spark, d, "customer").select("c_custkey", "c_name"), big, ["c_custkey"], {"n": 0, "s": "absent"})


@query("""WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS m FROM customer)
SELECT c_nationkey, c_custkey FROM r WHERE m <= 12 OR floor(i / (m / 12.0)) <> floor((i - 1) / (m / 12.0))""")
def even_stride(spark: SparkSession, d: str) -> DataFrame:
    return P.even_stride(table(spark, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 12)


@query("SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 5")
def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    return P.latest(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 5).select("o_custkey", "o_orderkey", "place")


QUEUE = "SELECT o_custkey AS site, 'https://e.example/' || CASE o_orderkey % 3 WHEN 0 THEN 'a/b/' WHEN 1 THEN 'a/' ELSE '' END || CAST(o_orderkey AS STRING) AS url, o_orderkey % 4 AS depth, o_orderkey % 5 = 0 AS in_menu, o_orderkey % 7 AS inbound FROM orders"


@query(f"""SELECT site, url, place FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth, in_menu DESC, len(string_split(url, '/')), inbound DESC, url) AS place FROM ({QUEUE}) q) WHERE place <= 4""")
def crawl_queue(spark: SparkSession, d: str) -> DataFrame:
    return P.crawl_queue(_sql(spark, d, QUEUE, "orders"), "site", 4).select("site", "url", "place")


@query("""SELECT site, unnest(e[1:2]).k AS key, unnest(e[1:2]).n AS n FROM (SELECT o_custkey AS site, list({'k': o_orderpriority, 'n': n} ORDER BY n DESC, o_orderpriority) AS e FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1)""")
def top_of_map(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n")).groupBy(F.col("o_custkey").alias("site")).agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))
    return n.select("site", F.explode(P.top_of_map(F.col("m"), 2)).alias("x")).select("site", F.col("x.key").alias("key"), F.col("x.value").alias("n"))


@query("SELECT id, CASE WHEN unlocked OR plan <> 'paid' OR plan IS NULL THEN score END AS score, coalesce(plan = 'paid', false) AND NOT coalesce(unlocked, false) AS locked FROM (SELECT DISTINCT id, plan, unlocked, score FROM audits)")
def public_view(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audits").select("id", "plan", "unlocked", "score").distinct()
    return P.public_view(a, F.col("plan") == "paid", F.col("unlocked"), ["score"]).select("id", "score", "locked")


@query("""WITH a AS (SELECT domain, arg_max(id, (created_at, id)) AS id FROM audits WHERE status = 'complete' AND created_at >= TIMESTAMP '2026-06-20 12:00:00' - INTERVAL 600 HOUR AND domain IS NOT NULL GROUP BY 1) SELECT domain, id FROM a WHERE domain IN (SELECT domain FROM monitors)""")
def reusable_results(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audits").where("domain is not null").select("id", "domain", "status", "created_at", F.lit(False).alias("deleted"))
    return P.reusable(a, table(spark, d, "monitors").where("domain is not null"), F.lit("2026-06-20 12:00:00").cast("timestamp_ntz"), 600).select("domain", "id")


@query("""WITH l AS (SELECT l_returnflag AS g, name, flag FROM lineitem, LATERAL (VALUES ('large', CASE WHEN l_linenumber <> 2 THEN l_quantity > 25 END), ('dear', l_extendedprice > 35000)) v(name, flag) WHERE flag IS NOT NULL)
SELECT g AS "group", name, count(*) AS n, count(*) FILTER (flag) AS yes, floor(count(*) FILTER (flag) * 1000.0 / count(*) + 0.5) / 10 AS share FROM l GROUP BY GROUPING SETS ((g, name), (name))""")
def cohort_shares(spark: SparkSession, d: str) -> DataFrame:
    return P.cohort_shares(table(spark, d, "lineitem"), "l_returnflag", {"large": F.when(F.col("l_linenumber") != 2, F.col("l_quantity") > 25), "dear": F.col("l_extendedprice") > 35000})


@query("""SELECT event_id, (ts - INTERVAL 8 HOUR)::date - 3 AS to_day, (ts - INTERVAL 8 HOUR)::date - 30 AS from_day, (ts - INTERVAL 8 HOUR)::date - 58 AS before_from, (ts - INTERVAL 8 HOUR)::date - 31 AS before_to, floor(epoch(TIMESTAMP '2024-03-31 00:00:00' - ts) / 86400)::int AS days,
  sha1(concat_ws('|', event_id, coalesce(event_type, ''), coalesce(user_id::varchar, ''))) AS row_id FROM events""")
def day_values(spark: SparkSession, d: str) -> DataFrame:
    """Periods, ages and row ids of events, which lie in winter."""
    r = M.console_ranges(F.col("ts"))
    return table(spark, d, "events").select("event_id", r["to_day"].alias("to_day"), r["from_day"].alias("from_day"), r["before_from"].alias("before_from"), r["before_to"].alias("before_to"), M.days_since(F.col("ts"), F.lit("2024-03-31").cast("timestamp_ntz")).alias("days"), M.row_id(F.col("event_id"), F.col("event_type"), F.col("user_id")).alias("row_id"))


@query("""SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN '' WHEN length(text) <= 80 THEN text ELSE rtrim(substring(text, 1, 79)) || '…' END AS short, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(title)), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents WHERE text IS NULL OR NOT regexp_matches(substring(text, 60, 25), '[^ -~]')""")
def text_values(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is null or not substring(text, 60, 25) rlike '[^ -~]'")
    return docs.select("doc_id", M.truncated(F.col("text"), 80).alias("short"), M.slug(F.col("title")).alias("slug"))


@query()
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", M.excerpt(F.col("text"), F.lit("Ostado"), 300).alias("excerpt"), M.without_markup(F.col("text")).alias("plain"))


@query(r"""SELECT CASE WHEN regexp_matches(p, '^/$') THEN 'home' WHEN regexp_matches(p, '/(privacy|terms|tos|legal|cookie|cookies|imprint|impressum|disclaimer|gdpr|refund)') THEN 'legal' WHEN regexp_matches(p, '/(contact|contact-us|about|about-us|team|support|careers)(/|$)') THEN 'contact' WHEN regexp_matches(p, '/(pricing|plans|price)(/|$)') THEN 'pricing'
  WHEN regexp_matches(p, '/(product|products|shop|store|item|items|p)/[^/]+') THEN 'product' WHEN regexp_matches(p, '/(blog|news|articles?|posts?|guides?|insights|resources|learn|stories|journal)/[^/]+') THEN 'article' WHEN regexp_matches(p, '/(blog|news|articles|posts|guides|resources|category|categories|tag|tags|topics)/?$') THEN 'listing' ELSE 'other' END AS kind,
  regexp_matches(p, '^/(login|log-in|signin|sign-in|signup|sign-up|register|logout|cart|basket|checkout|search|account|my-account|dashboard|admin|wp-admin|user|users|profile|settings|auth|api|thank-you|thanks|unsubscribe|password|reset)(/|$)') AS tool, count(*) AS n
  FROM (SELECT lower(coalesce(nullif(regexp_extract(trim(page), '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')) AS p FROM gsc_daily WHERE page <> '') GROUP BY 1, 2""")
def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    g = table(spark, d, "gsc_daily").where("page <> ''")
    return g.groupBy(X.page_type(F.col("page"), none, F.lit(0), F.lit(0), F.lit(0)).alias("kind"), X.is_tool_path(F.col("page")).alias("tool")).agg(F.count("*").alias("n"))


@query(r"""WITH q AS (SELECT DISTINCT query FROM gsc_daily WHERE query IS NOT NULL), w AS (SELECT query, regexp_extract_all(lower(query), '[\p{L}\p{N}]+') AS t FROM q)
SELECT query, array_to_string(list_sort(list_distinct(list_transform(list_filter(t, lambda a: a NOT IN ('a', 'an', 'the', 'of', 'for', 'to', 'in', 'on', 'and', 'or', 'with', 'at', 'by', 'from', 'is', 'are')), lambda a: CASE WHEN length(a) > 4 AND ends_with(a, 'ies') THEN a[:-4] || 'y' WHEN length(a) > 3 AND ends_with(a, 's') AND NOT regexp_matches(a, '(ss|us|is)$') THEN a[:-2] ELSE a END))), ' ') AS key,
  (greatest(0, len(regexp_extract_all(query, '[ilI.,;:''|!jft ]'))) * 5.6 + len(regexp_extract_all(query, '[mwMW]')) * 17 + len(regexp_extract_all(query, '[A-HJ-LN-VX-Z0-9]')) * 12.4 + (length(query) - len(regexp_extract_all(query, '[ilI.,;:''|!jft ]')) - len(regexp_extract_all(query, '[mwMW]')) - len(regexp_extract_all(query, '[A-HJ-LN-VX-Z0-9]'))) * 10 + 0.5)::double AS w FROM w""".replace("+ 0.5)::double AS w FROM w", ")::double AS w FROM w"))
def query_keys(spark: SparkSession, d: str) -> DataFrame:
    """One key for wordings of a query, and its estimated width before rounding."""
    q = table(spark, d, "gsc_daily").where("query is not null").select("query").distinct()
    n = lambda p: F.regexp_count("query", F.lit(p))
    a, b, c = n(r"[ilI.,;:'|!jft ]"), n("[mwMW]"), n("[A-HJ-LN-VX-Z0-9]")
    return q.select("query", X.keyword_key(F.col("query")).alias("key"), (a * 5.6 + b * 17 + c * 12.4 + (F.length("query") - a - b - c) * 10).cast("double").alias("w"))


@query("""WITH l AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(lower(replace(t, '’', '''')), '\\b(?:symptoms?|treatments?|loans?|mortgages?|tax(?:es)?|retirement|insurance|trading|lawyers?|attorneys?|visas?|immigration|custody|diseases?|cancers?|medications?|dosages?|lawsuits?|divorces?|mental health|credit scores?|diagnos(?:is|es|ed)|diabet(?:es|ic)|pregnan(?:cy|cies|t)|therap(?:y|ies|ist|ists)|invest(?:s|ed|ing|ments?|ors?)?|crypto(?:currency|currencies)?)\\b'), lambda x: true)) AS n_ymyl FROM l""")
def text_markers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.count_markers(F.col("text"), "ymyl").alias("n_ymyl"))


@query()
def text_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Data points, years and other marks of every document."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.count_data_points(t).alias("n_numbers"), X.years_in(t).alias("years"), *(X.count_markers(t, k).alias(k) for k in X.MARKERS), X.title_year(F.col("title")).alias("title_year"), X.title_number(F.col("title")).alias("title_number"), X.title_brand(F.col("title")).alias("title_brand"), X.clickbait_hits(F.col("title")).alias("bait"), X.is_question(F.col("title")).alias("question"))


@query(r"""SELECT page, count(*) AS n, regexp_matches(h, '(^|\.)(reddit|quora|stackexchange|stackoverflow|superuser|serverfault|askubuntu|medium|linkedin|facebook|pinterest|tumblr|wikihow|answers|x|twitter|instagram|tiktok|youtube|substack|blogspot|wordpress|hubpages|fandom)\.com$|(^|\.)mathoverflow\.net$|^news\.ycombinator\.com$|(^|\.)dev\.to$') OR regexp_matches(p, '/(?:forums?|threads?|discussions?)(?:/|$)|/(?:showthread|viewtopic)\.php|/t/[^/]+/\d+(?:/|$)|/questions/\d+(?:/|$)') AS user_content
  FROM (SELECT page, regexp_replace(lower(regexp_extract(trim(page), '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') AS h, lower(regexp_extract(trim(page), '(?i)^https?://[^/?#]+([^?#]*)', 1)) AS p FROM gsc_daily WHERE page <> '') GROUP BY ALL""")
def user_content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gsc_daily").where("page <> ''").groupBy("page").agg(F.count("*").alias("n")).select("page", "n", E.is_user_content(F.col("page")).alias("user_content"))


@query("""WITH n AS (SELECT s_nationkey AS site, s_suppkey AS url, lower(name) AS k, name FROM (SELECT s_nationkey, s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Quorix' WHEN 1 THEN 'quorix' ELSE 'Drafly' END AS name FROM supplier)),
c AS (SELECT site, k, count(DISTINCT url) AS n, k = 'quorix' AS fits FROM n GROUP BY 1, 2), b AS (SELECT site, k, fits FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, fits DESC, k) AS r FROM c) WHERE r = 1)
SELECT b.site, (SELECT m.name FROM n m WHERE m.site = b.site AND m.k = b.k GROUP BY m.name ORDER BY count(*) DESC, m.name LIMIT 1) AS brand, b.k AS brand_key, (SELECT count(DISTINCT url) FROM n m WHERE m.site = b.site AND m.k = b.k)::double / (SELECT count(DISTINCT url) FROM n m WHERE m.site = b.site) AS share, b.fits AS matches FROM b""")
def brand_vote(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    name = F.when(F.col("s_suppkey") % 3 == 0, "Quorix").when(F.col("s_suppkey") % 3 == 1, "quorix").otherwise("Drafly")
    names = s.select(F.col("s_nationkey").alias("site"), F.col("s_suppkey").cast("string").alias("url"), name.alias("name"))
    return R.brand_vote(names, names.select("site", F.lit("www.quorix.example").alias("domain")).distinct())
