"""Queries of the ranking sub-scores over the audit's stand-in sites, with their SQL; console sub-scores over the console rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.operators import checks as C
from citewise.operators import console as G
from citewise.operators import ranking as R
from citewise.plans import audits as A
from citewise.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TODAY = "2026-10-01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


SIGNALS = f"""SELECT *, kind <> 'contact' AND kind <> 'home' AND ok AND NOT shell AS typed, kind <> 'contact' AND kind <> 'home' AND ok AND NOT shell AND main_words >= 300 AS content FROM (SELECT *,
  200 + (n * 31) % 900 AS main_words, n % 4 AS n_experience, (n + site) % 3 AS n_own_images, n % 3 AS n_original, (site + n) % 2 AS n_tables, (n + site) % 4 AS n_authoritative, n % (2 + site % 4) = 0 AS byline, n % 5 = 0 AS author_in_schema,
  site % 4 AS n_same_as, (n = 5 AND site % 3 <> 0) AS is_about, kind = 'contact' AS is_contact, site % 2 = 0 AS has_contact, CASE WHEN n % 3 <> 1 THEN (n * 17 + site * 5) % 900 END AS published_days, CASE WHEN n % 10 = 3 THEN 2020 END AS title_year,
  CASE WHEN n % 7 = 0 THEN 3 ELSE 0 END AS n_ai_phrases, CASE WHEN site % 5 <> 4 THEN 20.0 + (n * 7 + site) % 60 END AS flesch, 40.0 + (site * 3) % 100 AS paragraph_words, n % 5 AS n_h2, n % 3 AS n_h3, n % (2 + site % 3) AS n_lists, n % 9 AS n_list_items,
  CASE WHEN n % 6 = 0 THEN 2 ELSE 0 END AS n_clickbait, CASE WHEN n % 8 = 0 THEN 5 END AS title_number, CASE WHEN n % 4 <> 2 THEN 2018 + n % 9 END AS body_year, n % 3 AS n_outbound, n % 2 AS n_next_steps, n % 4 = 0 AS has_faq, CASE WHEN n % 9 = 0 THEN 1 ELSE 0 END AS n_interstitials,
  n % 3 AS n_questions, (n * 3) % 20 AS n_numbers, CASE WHEN site % 12 = 5 THEN n % 4 ELSE 0 END AS n_ymyl FROM ({A.PAGES}) p) q"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    own = spark.sql(SIGNALS.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))
    more = A.crawl(spark, d).pages.select("k", "final_url", "h1s", "links", "types")
    today = F.lit(TODAY).cast("date")
    return own.join(more, "k").withColumns({
        "js_shell": F.col("shell"), "tool": F.lit(False), "date_published": F.date_sub(today, F.col("published_days").cast("int")), "date_modified": F.lit(None).cast("date"), "body_years": F.when(F.col("body_year").isNotNull(), F.array("body_year")),
        "first_paragraph": F.when(F.col("n") % 3 == 1, "The word detail is here.").otherwise("Nothing of it."), "lead_text": F.lit(""), "heading_texts": F.array("h1"), "format": F.when(F.col("kind") == "product", "product").otherwise("article"),
    })


def _rounded(df: DataFrame) -> DataFrame:
    """Sub-scores of a wide table, whole, one row each, those that aren't measured too."""
    return R.long_subs(df)


_STEP = "CASE WHEN {x} THEN {a} ELSE {b} END"
_ROUND = lambda e: f"CASE WHEN ({e}) IS NOT NULL THEN floor(greatest(0, least(100, ({e})::double)) + 0.5)::int END"
_LONG = lambda pairs: " UNION ALL ".join(f"SELECT site, '{p}' AS pillar, '{s}' AS sub, {_ROUND(e)} AS score FROM z" for p, s, e in pairs)
_CONTENT = f"""WITH s AS ({SIGNALS}), c AS (SELECT *, title LIKE 'Post %' AS post FROM s),
z0 AS (SELECT site, count(*) FILTER (content) AS n, avg(least(n_experience, 3) / 3.0 * 70 + CASE WHEN n_own_images >= 1 THEN 30 ELSE 0 END) FILTER (content) AS x_exp,
  avg(least(n_original, 2) / 2.0 * 40 + n_tables * 20 + CASE WHEN n_authoritative * 1000.0 / main_words >= 2 THEN 40 WHEN n_authoritative * 1000.0 / main_words >= 1 THEN 25 WHEN n_authoritative > 0 THEN 10 ELSE 0 END) FILTER (content) AS x_data,
  avg(CASE WHEN post THEN 25 ELSE 0 END + CASE WHEN n_questions >= 2 OR has_faq THEN 20 ELSE 0 END + CASE WHEN n_numbers * 1000.0 / main_words >= 5 THEN 20 WHEN n_numbers * 1000.0 / main_words >= 2 THEN 10 ELSE 0 END + CASE WHEN n_lists + n_tables > 0 THEN 15 ELSE 0 END
    + CASE WHEN type IN ('BlogPosting', 'Product', 'FAQPage') THEN 10 ELSE 0 END + CASE WHEN byline AND published_days IS NOT NULL THEN 10 ELSE 0 END) FILTER (content) AS x_cite,
  avg(byline::int) FILTER (content) AS bylines, avg(author_in_schema::int) FILTER (content) AS schemas, avg((n_ymyl >= 3 AND n_ymyl * 1000.0 / main_words >= 2)::int) FILTER (content) AS ymyl, max(n_same_as) FILTER (ok) AS same_as, coalesce(bool_or(ok AND is_about), false) AS about, coalesce(bool_or(ok AND is_contact AND has_contact), false) AS contact,
  avg(coalesce(published_days <= 365, false)::int) FILTER (content) AS recent, avg((published_days IS NOT NULL)::int) FILTER (content) AS dated, avg((title_year IS NOT NULL)::int) FILTER (content) AS old_t, avg(coalesce(near_duplicate, false)::int) FILTER (content) AS dup,
  sum(n_ai_phrases) FILTER (content) * 1000.0 / sum(main_words) FILTER (content) AS ai, avg((n_experience = 0)::int) FILTER (content) AS bare, count(*) FILTER (typed) AS n_typed, count(*) FILTER (typed AND main_words < 300) AS thin,
  avg(flesch) FILTER (content) AS fl, avg(paragraph_words) FILTER (content) AS para, avg(main_words::double / greatest(1, n_h2 + n_h3)) FILTER (content) AS per_h, avg((n_lists + n_tables > 0)::int) FILTER (content) AS scan, avg((n_clickbait >= 2)::int) FILTER (content) AS bait,
  avg(coalesce(greatest(n_h2, n_h3, n_list_items) < title_number, false)::int) FILTER (content) AS miss, avg((title <> '' AND NOT (post AND n % 4 = 0))::int) FILTER (content) AS off_t FROM c GROUP BY 1),
days AS (SELECT site, max(d) AS busiest FROM (SELECT site, published_days, count(*) AS d FROM c WHERE content AND published_days IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT z0.*, coalesce(busiest, 0) AS busiest FROM z0 LEFT JOIN days USING (site))
"""
_BY_CONTENT = (
    ("quality", "experience", "x_exp"), ("quality", "data", "x_data"), ("aisearch", "citability", "x_cite"),
    ("quality", "authorship", "40 * bylines + 15 * schemas + 15 * about::int + 15 * contact::int + 15 * (same_as >= 2)::int - 15 * (ymyl >= 0.2 AND bylines < 0.8)::int"),
    ("quality", "freshness", "60 * recent + 20 * dated + 20 * (1 - old_t)"),
    ("quality", "scaled", "100 - dup * 40 - CASE WHEN ai >= 3 THEN 25 WHEN ai >= 1.5 THEN 12 ELSE 0 END - CASE WHEN n >= 10 AND busiest >= 0.4 * n THEN 20 ELSE 0 END - coalesce(thin::double / nullif(n_typed, 0), 0) * 20 - CASE WHEN bare >= 0.8 THEN 10 ELSE 0 END"),
    ("behavior", "readability", "CASE WHEN n > 0 THEN CASE WHEN fl IS NULL THEN 35 WHEN fl >= 60 THEN 50 WHEN fl >= 40 THEN 35 WHEN fl >= 30 THEN 20 ELSE 10 END + CASE WHEN para IS NULL THEN 10 WHEN para <= 80 THEN 20 WHEN para <= 120 THEN 10 ELSE 0 END + CASE WHEN per_h <= 300 THEN 15 ELSE 0 END + 15 * scan END"),
    ("behavior", "promise", "100 - bait * 50 - miss * 30 - off_t * 20"),
)


@query(_CONTENT + _LONG([(p, s, f"CASE WHEN n > 0 THEN {e} END") for p, s, e in _BY_CONTENT]))
def ranking_content(spark: SparkSession, d: str) -> DataFrame:
    """Sub-scores of the pages' content."""
    return _rounded(R.page_subs(_pages(spark, d), F.lit(TODAY).cast("date")))


PAIRS = """SELECT s_suppkey AS site, q, 'query ' || CAST(q AS STRING) || ' s' || CAST(s_suppkey AS STRING) AS query, CASE WHEN q % 3 <> 2 THEN (s_suppkey * 7 + q * 13) % 500 END AS volume, CASE (s_suppkey + q) % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true END AS intent_match,
  CASE WHEN (s_suppkey + q) % 5 <> 0 THEN ((s_suppkey + q * 3) % 11) / 10.0 END AS coverage, (s_suppkey + q) % 7 AS unique_topics, (s_suppkey * q) % 8 AS extra_numbers, q % 2 AS extra_tables, (s_suppkey + q) % 3 AS own_images, s_suppkey % 4 AS experience, CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE q END AS n_fetched,
  ((s_suppkey + q) % 5) / 4.0 AS title_alignment, ((s_suppkey + 2 * q) % 5) / 4.0 AS h1_alignment, (s_suppkey + q) % 2 = 0 AS answer_early, CASE WHEN q <> 1 THEN (s_suppkey * 3 + q * 17) % 90 END AS kd, CASE WHEN q % 2 = 0 THEN (s_suppkey * 11) % 600 END AS avg_top_rank, q % 2 = 1 AS overview_present, (s_suppkey + q) % 3 <> 0 AS overview_loaded,
  s_suppkey % 2 = 0 AS overview_cited FROM (SELECT s_suppkey, 1 AS q FROM supplier UNION ALL SELECT s_suppkey, 2 FROM supplier UNION ALL SELECT s_suppkey, 3 FROM supplier WHERE s_suppkey % 5 <> 0) x"""
RIVALS = """SELECT site, query, q, position, (site + position) % 4 <> 0 AS fetched, (site * position) % 9 = 0 AS ugc, CASE WHEN (site + position) % 3 = 0 THEN 400 + site * 10 END AS modified_days, 100 + (site * position * 37) % 1500 AS n_words, CASE WHEN position <> 2 THEN (site * 13 + position * 101) % 700 END AS domain_rank,
  (site + position) % 11 = 0 AS off_intent FROM (SELECT site, query, q, 1 AS position FROM pairs UNION ALL SELECT site, query, q, 2 FROM pairs UNION ALL SELECT site, query, q, 3 FROM pairs UNION ALL SELECT site, query, q, 4 FROM pairs UNION ALL SELECT site, query, q, 5 FROM pairs UNION ALL SELECT site, query, q, 6 FROM pairs) r"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = spark.sql(PAIRS.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, d, "supplier"))
    return p.withColumns({"brand": F.lit(False), "features": F.when(F.col("q") == 1, F.array(F.lit("AI_Overview"), F.lit("video"))).when(F.col("q") == 2, F.array(F.lit("featured_snippet"), F.lit("map"))), "own_snippet": F.col("site") % 3 == 0})


def _rivals(spark: SparkSession, d: str) -> DataFrame:
    r = spark.sql(RIVALS.replace("FROM pairs", "FROM {pairs}"), pairs=_pairs(spark, d))
    return r.withColumn("date_modified", F.date_sub(F.lit(TODAY).cast("date"), F.col("modified_days").cast("int")))


_PAIR = f"""WITH pairs AS ({PAIRS}), rivals AS ({RIVALS}), own AS (SELECT site, CASE WHEN authority THEN domain_rank END AS own_rank FROM ({A.SITES}) a),
sp AS (SELECT site, query, count(*) FILTER (fetched) AS known, count(*) FILTER (fetched AND (ugc OR coalesce(DATE '{TODAY}' - modified_days::int < DATE '{TODAY}' - INTERVAL 18 MONTH, false) OR n_words < 500 OR off_intent OR coalesce(domain_rank < 100, false) OR coalesce(domain_rank <= own_rank, false))) AS weak, median(domain_rank) AS rr
  FROM rivals LEFT JOIN own USING (site) WHERE position <= 5 GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN volume > 0 THEN volume ELSE 1 END AS vol, CASE WHEN own_rank IS NOT NULL THEN least(100.0, own_rank / 8) END AS strength, coalesce(CASE WHEN avg_top_rank > 0 THEN avg_top_rank END, rr) AS opp,
  CASE WHEN extra_numbers >= 5 THEN 20 WHEN extra_numbers >= 1 THEN 10 ELSE 0 END + extra_tables * 15 + CASE own_images WHEN 2 THEN 15 WHEN 1 THEN 8 ELSE 0 END + CASE WHEN experience >= 2 THEN 10 ELSE 0 END AS signs FROM pairs LEFT JOIN sp USING (site, query) LEFT JOIN own USING (site)),
y AS (SELECT *, CASE WHEN kd IS NULL THEN NULL WHEN strength IS NULL THEN CASE WHEN kd <= 30 THEN 100 WHEN kd <= 45 THEN 70 WHEN kd <= 60 THEN 40 ELSE 10 END ELSE CASE WHEN kd <= strength + 10 THEN 100 WHEN kd <= strength + 25 THEN 70 WHEN kd <= strength + 40 THEN 40 ELSE 10 END END AS kp,
  CASE WHEN own_rank IS NULL OR opp IS NULL THEN NULL WHEN opp <= 0 OR own_rank >= opp THEN 100 WHEN own_rank >= 0.6 * opp THEN 70 WHEN own_rank >= 0.3 * opp THEN 40 ELSE 10 END AS gp FROM x),
z AS (SELECT site, avg(intent_match::int) * 100 AS a, CASE WHEN count(coverage) > 0 THEN least(100, avg(CASE WHEN coverage IS NOT NULL THEN least(1.0, coverage) END) / 0.7 * 100) END AS b, coalesce(avg(least(100, least(unique_topics, 5) * 8 + signs)) FILTER (n_fetched > 0), avg(signs)) AS c, avg(40 * title_alignment + 30 * h1_alignment + CASE WHEN answer_early THEN 30 ELSE 0 END) AS e,
  avg(overview_cited::int) FILTER (overview_present AND overview_loaded) * 100 AS f, avg(CASE least(weak, 3) WHEN 0 THEN 20 WHEN 1 THEN 50 WHEN 2 THEN 80 ELSE 100 END) FILTER (known >= 3) AS g, sum(kp * vol)::double / sum(vol) FILTER (kp IS NOT NULL) AS h, avg(gp) AS i FROM y GROUP BY 1)
"""


@query(_PAIR + _LONG([("relevance", "intent", "a"), ("relevance", "coverage", "b"), ("relevance", "gain", "c"), ("relevance", "alignment", "e"), ("aisearch", "overview", "f"), ("winnability", "serpweakness", "g"), ("winnability", "difficulty", "h"), ("winnability", "gap", "i")]))
def ranking_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Sub-scores of query pairs and their rivals."""
    return _rounded(R.pair_subs(_pairs(spark, d), _rivals(spark, d), _facts(spark, d), F.lit(TODAY).cast("date")))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    f = A.crawl(spark, d).sites
    return f.withColumn("domain_rank", F.when(F.col("authority"), F.col("domain_rank")))


KEYWORDS = """SELECT s_suppkey AS site, q, CASE WHEN q = 5 THEN 'Brand s' || CAST(s_suppkey AS STRING) ELSE CASE q WHEN 4 THEN 'The best shoes for running ' ELSE 'best Shoe running ' END || CAST(s_suppkey % 7 AS STRING) || CAST(q AS STRING) END AS keyword,
  'https://www.s' || CAST(s_suppkey AS STRING) || '.example/plain-' || CAST(q * 7 - 1 AS STRING) AS url, 1 + (s_suppkey * q) % 30 AS position, CASE WHEN q % 3 <> 0 THEN (s_suppkey * 31 + q) % 1500 END AS volume, q = 5 AS brand, CASE WHEN q <> 2 THEN (s_suppkey + q) % 3 - 1 END AS page_domains FROM (SELECT s_suppkey, 1 AS q FROM supplier
  UNION ALL SELECT s_suppkey, 2 FROM supplier UNION ALL SELECT s_suppkey, 3 FROM supplier UNION ALL SELECT s_suppkey, 4 FROM supplier UNION ALL SELECT s_suppkey, 5 FROM supplier) x"""


def _keywords(spark: SparkSession, d: str) -> DataFrame:
    k = spark.sql(KEYWORDS.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, d, "supplier"))
    return k.withColumns({"is_home": F.lit(False), "features": F.when(F.col("q") == 1, F.array(F.lit("paid"), F.lit("shopping"))).when(F.col("q") == 3, F.array(F.lit("organic")))})


@query(f"""WITH k AS ({KEYWORDS}), p AS ({PAIRS}), rows AS (SELECT site, lower(trim(keyword)) AS w, CASE q WHEN 1 THEN 0.15 ELSE 0.0 END AS ab, volume FROM k WHERE q IN (1, 3) UNION ALL SELECT site, lower(query), CASE q WHEN 1 THEN 0.4 ELSE CASE WHEN site % 3 = 0 THEN 0.15 ELSE 0.35 END END, volume FROM p WHERE q IN (1, 2)),
a AS (SELECT site, sum(CASE WHEN position <= 3 THEN 100 WHEN position <= 10 THEN 70 WHEN position <= 20 THEN 40 ELSE 10 END * CASE WHEN volume > 0 THEN volume ELSE 1 END)::double / sum(CASE WHEN volume > 0 THEN volume ELSE 1 END) AS st FROM k WHERE NOT brand GROUP BY 1),
z AS (SELECT site, st, 100 * (1 - sum(ab * CASE WHEN volume > 0 THEN volume ELSE 1 END)::double / sum(CASE WHEN volume > 0 THEN volume ELSE 1 END)) AS zc FROM rows JOIN a USING (site) GROUP BY 1, 2)
""" + _LONG([("winnability", "striking", "st"), ("aisearch", "zeroclick", "zc")]))
def ranking_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Sub-scores of ranked keywords and of what their results pages take."""
    return _rounded(R.keyword_subs(_keywords(spark, d), _pairs(spark, d)))


def _console(spark: SparkSession, d: str) -> DataFrame:
    rows = G.console_rows(table(spark, d, "gsc_daily")).where("impressions > 0")
    w = F.when(F.col("position").isNotNull(), F.col("impressions"))
    q = rows.groupBy(F.pmod(F.length("query"), F.lit(7)).alias("site"), "query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.try_divide(F.sum(F.coalesce("position", F.lit(0.0)) * w), F.sum(w)).alias("position"))
    return q.withColumn("brand", F.col("query").contains("visilume"))


@query(
    __import__("citewise.plans.analytics", fromlist=["CONSOLE"]).CONSOLE
    + """, q AS (SELECT length(query) % 7 AS site, query, sum(clicks)::bigint AS clicks, sum(impressions)::bigint AS i, sum(coalesce(position, 0.0) * CASE WHEN position IS NOT NULL THEN impressions END) / nullif(sum(CASE WHEN position IS NOT NULL THEN impressions END), 0) AS p FROM r WHERE impressions > 0 GROUP BY 1, 2),
c AS (SELECT *, [0.276, 0.158, 0.11, 0.084, 0.063, 0.049, 0.039, 0.033, 0.027, 0.024, 0.01]::double[] AS v FROM q WHERE NOT contains(query, 'visilume') AND i >= 50 AND p > 0),
e AS (SELECT *, CASE WHEN p <= 1 THEN v[1] WHEN p >= 11 THEN 0.01 ELSE v[floor(p)::int] + (v[floor(p)::int + 1] - v[floor(p)::int]) * (p - floor(p)) END AS x FROM c)
SELECT site, 'behavior' AS pillar, 'ctr' AS sub, floor(least(100, 85 * sum(clicks) / sum(x * i)) + 0.5)::int AS score FROM e GROUP BY 1"""
)
def ranking_console(spark: SparkSession, d: str) -> DataFrame:
    """Click-through against what positions promise; sites are lengths of queries."""
    return _rounded(R.console_subs(_console(spark, d)))


FACTS = f"""SELECT *, (site % 11) / 10.0 AS body_share, CASE WHEN site % 6 <> 2 THEN (site % 8) / 10.0 END AS platform_share, CASE WHEN site % 7 <> 1 THEN (site % 10) / 10.0 END AS top_share, CASE WHEN site % 4 <> 0 THEN (site % 5) / 4.0 END AS deep, (site * 17) % 1300 AS brand_volume, CASE WHEN site % 9 <> 5 THEN (site % 11) / 10.0 END AS brand_share,
  site % 3 <> 0 AS brand_matches, site % 4 AS same_as, CASE site % 5 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS owns, site % 2 = 0 AS top3, site % 3 = 0 AS panel, site % 4 AS n_platforms, CASE WHEN site % 4 > 1 THEN 3.0 + (site % 9) / 5.0 END AS rating, site % 6 AS independent, site % 4 AS negative, site % 8 <> 7 AS reputation_known,
  site % 10 = 9 AS robots_missing, CASE WHEN site % 7 <> 0 THEN 8 END AS bots_known, site % 9 AS bots_blocked, site % 60 AS clicks, (site * 3) % 50 AS clicks_before, site * 9 AS impressions, (site * 7) % 300 AS impressions_before, site % 3 <> 2 AS console, site % 5 AS n_up, site % 7 AS n_down, site % 12 AS outbound_checked, site % 4 AS outbound_broken,
  site % 6 AS with_year, least(site % 6, site % 4) AS old_years, (site % 5) / 4.0 AS unsourced, site % 5 AS n, site % 4 AS n_pairs, (site % 3) / 2.0 AS early, (site % 6) / 5.0 AS next, site % 3 AS articles, least(site % 3, site % 2) AS faqs, CASE WHEN site % 5 > 0 THEN (site % 4) / 10.0 END AS popups FROM ({A.SITES}) s"""
_TERMS = lambda *t: "100.0 * (" + " + ".join(f"coalesce({p}, 0)" for _, p in t) + ") / nullif(" + " + ".join(f"CASE WHEN ({p}) IS NOT NULL THEN {m} ELSE 0 END" for m, p in t) + ", 0)"
_BAND = lambda v, g, p: f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} <= {g} THEN 1.0 WHEN {v} <= {p} THEN 0.5 ELSE 0.0 END"
_CHANGE = lambda a, b: f"50 + (CASE WHEN {b} > 0 THEN ({a} - {b}) * 100.0 / {b} ELSE 100 END) / 40 * 50"
_SPAM = "CASE WHEN coalesce(spam_score, 0) > 30 THEN 15 + 25 * least(70, spam_score - 30) / 70 WHEN coalesce(spam_score, 0) > 10 THEN 15 * (spam_score - 10) / 20 ELSE 0 END"
_RANK = "CASE WHEN coalesce(domain_rank, 0) >= 300 THEN 90 + 10 * least(1, (domain_rank - 300) / 700) WHEN coalesce(domain_rank, 0) >= 100 THEN 70 + 20 * (domain_rank - 100) / 200 WHEN coalesce(domain_rank, 0) >= 30 THEN 50 + 20 * (domain_rank - 30) / 70 ELSE 50 * coalesce(domain_rank, 0) / 30 END"


@query(f"WITH z AS ({FACTS}) " + _LONG([
    ("authority", "editorial", f"CASE WHEN NOT authority THEN NULL WHEN backlinks = 0 AND referring_domains = 0 THEN 0 ELSE {_TERMS((60, 'least(60, body_share / 0.6 * 60)'), (40, 'CASE WHEN platform_share IS NOT NULL THEN least(40, platform_share / 0.6 * 40) END'))} END"),
    ("authority", "breadth", f"CASE WHEN authority THEN 0.6 * ({_RANK}) + 0.4 * least(100, log10(1 + referring_domains) / log10(10001) * 100) - ({_SPAM}) END"),
    ("authority", "linkprofile", _TERMS((40, "CASE WHEN authority THEN 40.0 * coalesce(gained_domains, 0) / nullif(coalesce(gained_domains, 0) + coalesce(lost_domains, 0), 0) END"), (30, "CASE WHEN authority AND top_share IS NOT NULL THEN CASE WHEN top_share <= 0.4 THEN 30 WHEN top_share <= 0.6 THEN 15 ELSE 0 END END"), (30, "CASE WHEN visibility THEN 30 * deep END"))),
    ("authority", "entity", "CASE WHEN brand_share IS NULL THEN NULL WHEN visibility THEN CASE WHEN brand_share >= 0.8 AND brand_matches THEN 40 ELSE 0 END + CASE WHEN same_as >= 2 THEN 20 ELSE 0 END + CASE WHEN brand_volume >= 1000 THEN 40 WHEN brand_volume >= 100 THEN 25 WHEN brand_volume > 0 THEN 10 ELSE 0 END ELSE (CASE WHEN brand_share >= 0.8 AND brand_matches THEN 40 ELSE 0 END + CASE WHEN same_as >= 2 THEN 20 ELSE 0 END) / 60.0 * 100 END"),
    ("authority", "reputation", "CASE WHEN reputation_known THEN 100.0 * (CASE WHEN owns IS NULL THEN 0 ELSE CASE WHEN owns THEN 25 WHEN top3 THEN 15 ELSE 0 END + CASE WHEN panel THEN 10 ELSE 0 END END + CASE WHEN n_platforms >= 2 THEN 30 WHEN n_platforms = 1 THEN 15 ELSE 0 END + CASE WHEN rating >= 4 THEN 15 WHEN rating >= 3.5 THEN 8 ELSE 0 END + CASE WHEN independent >= 4 THEN 20 WHEN independent >= 2 THEN 10 ELSE 0 END) / CASE WHEN owns IS NULL THEN 65 ELSE 100 END - least(20, 10 * negative) END"),
    ("winnability", "momentum", f"CASE WHEN console AND clicks + clicks_before >= 20 THEN {_CHANGE('clicks', 'clicks_before')} WHEN console AND impressions + impressions_before >= 200 THEN {_CHANGE('impressions', 'impressions_before')} WHEN visibility THEN 50 + 50.0 * (n_new + n_up - n_down - n_lost) / nullif(n_new + n_up + n_down + n_lost, 0) END"),
    ("aisearch", "crawlers", _TERMS((70, "CASE WHEN robots_missing THEN 70 ELSE (bots_known - bots_blocked) * 70.0 / bots_known END"), (30, "CASE WHEN js_dependent THEN 0 WHEN NOT js_dependent THEN 30 END"))),
    ("behavior", "realuser", f"100 * list_avg(list_filter([{_BAND('field_lcp', 2500, 4000)}, {_BAND('field_inp', 200, 500)}, {_BAND('field_cls', 0.1, 0.25)}], lambda v: v IS NOT NULL))"),
    ("quality", "sources", _TERMS((50, "CASE WHEN outbound_checked >= 5 THEN 50 * (1 - least(1, least(1, outbound_broken * 1.0 / outbound_checked) / 0.2)) END"), (30, "30 * (1 - old_years * 1.0 / nullif(with_year, 0))"), (20, "CASE WHEN n > 0 THEN 20 * (1 - unsourced) END"))),
    ("behavior", "task", _TERMS((40, "CASE WHEN n_pairs > 0 THEN 40 * early END"), (30, "CASE WHEN n > 0 THEN 30 * next END"), (15, "15.0 * faqs / nullif(articles, 0)"), (15, "15 * (1 - popups)"))),
]))
def ranking_facts(spark: SparkSession, d: str) -> DataFrame:
    """Sub-scores of the sites' facts."""
    return _rounded(R.fact_subs(spark.sql(FACTS.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, d, "supplier"))))


_GRAPH = f"""WITH s AS ({SIGNALS}), ok AS (SELECT site, n, url, kind, content, title, type FROM s WHERE ok),
ranks AS (SELECT DISTINCT site, 'https://www.s' || site || '.example/plain-' || (q * 7 - 1) AS url FROM ({KEYWORDS}) k)"""


@query(_GRAPH + """, core AS (SELECT site, url FROM ok WHERE kind IN ('home', 'product') UNION SELECT ok.site, ok.url FROM ok JOIN ranks USING (site, url)), cnt AS (SELECT site, count(*) - 1 AS others FROM ok GROUP BY 1)
SELECT site, 'authority' AS pillar, 'internal' AS sub, floor(avg(10.0) + 0.5)::int AS score FROM core JOIN cnt USING (site) WHERE others > 0 GROUP BY 1""")
def ranking_internal(spark: SparkSession, d: str) -> DataFrame:
    """Links to core pages; the stand-in pages link only to their menus, so no core page has any."""
    return _rounded(R.internal_subs(_pages(spark, d), _keywords(spark, d)))


@query(_GRAPH + """, c AS (SELECT *, CASE WHEN title LIKE 'Post %' THEN 'post' WHEN title = 'Short' THEN 'short' WHEN title LIKE 'Same%' THEN 'same' END AS topic, kind = 'product' AS product FROM ok WHERE content),
t AS (SELECT site, url, count(*) OVER (PARTITION BY site, topic, product) > 1 AND topic IS NOT NULL AS alike FROM c),
kw AS (SELECT DISTINCT site, url FROM (SELECT site, url, count(*) OVER (PARTITION BY site, kw) AS m FROM (SELECT site, url, 'best running shoe ' || (site % 7) || q AS kw FROM (SELECT *, row_number() OVER () AS r FROM (""" + KEYWORDS + """) a) b WHERE NOT brand) x) WHERE m > 1),
z AS (SELECT site, count(*) AS n, count(*) FILTER (alike OR url IN (SELECT url FROM kw)) AS x FROM t GROUP BY 1 HAVING count(*) > 1)
SELECT site, 'relevance' AS pillar, 'cannibalization' AS sub, floor(greatest(0, 100 - least(100, x::double / n / 0.3 * 100)) + 0.5)::int AS score FROM z""")
def ranking_cannibalization(spark: SparkSession, d: str) -> DataFrame:
    """Pages that compete for one search; the stand-in sites have no console rows."""
    none = table(spark, d, "supplier").where("false").selectExpr("s_suppkey AS site", "'' AS query", "'' AS page", "0 AS impressions", "false AS brand")
    return _rounded(R.cannibal_subs(_pages(spark, d), _keywords(spark, d), none))


@query()
def ranking_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Topic clusters of linked content pages: each page links to the next of its site."""
    p = _pages(spark, d)
    following = p.select("site", (F.col("n") - 1).alias("n"), F.array("url").alias("more")).dropDuplicates(["site", "n"])
    return _rounded(R.cluster_subs(p.drop("links").join(following, ["site", "n"], "left").withColumnRenamed("more", "links")))


@query()
def ranking_focus(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).withColumns({"description": F.lit("Words in detail about shoes, lamps, chairs and tables"), "is_entry": F.col("is_entry")})
    return _rounded(R.focus_subs(p, p.where("n % 3 = 0").select("site", F.concat("url", F.lit("-lost-lamp")).alias("url"))))


SUBS_SQL = "SELECT s_suppkey AS site, p AS pillar, s AS sub, CASE WHEN (s_suppkey + i) % 4 <> 0 THEN (s_suppkey * 13 + i * 29) % 101 END AS score FROM supplier, (VALUES " + ", ".join(f"({i}, '{p}', '{s}')" for i, (p, s) in enumerate((p, s) for p, own in R.SUBS.items() for s in own)) + ") v(i, p, s)"
_W = "(VALUES " + ", ".join(f"('{p}', '{s}', {w}, {({'reputation': 25.0}.get(s) or int(w * 75 / 86 * 10 + 0.5) / 10) if p == 'authority' else w})" for p, own in R.SUBS.items() for s, w in own.items()) + ") w(pillar, sub, w, wl)"
_P = "(VALUES " + ", ".join(f"('{f}', '{p}', {w})" for f, own in R.PROFILES.items() for p, w in own.items()) + ") f(profile, pillar, pw)"
_PROFILE = "CASE s_suppkey % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'ecommerce' WHEN 2 THEN 'local' ELSE 'ymyl' END"
_PILLARS = f"""WITH subs AS ({SUBS_SQL}), prof AS (SELECT s_suppkey AS site, {_PROFILE} AS profile, s_suppkey % 101 AS tech, s_suppkey % 7 = 0 AS shut FROM supplier),
a AS (SELECT site, pillar, count(score) AS n, floor(sum(score * CASE WHEN profile = 'local' THEN wl ELSE w END) / sum(CASE WHEN score IS NOT NULL THEN CASE WHEN profile = 'local' THEN wl ELSE w END END) + 0.5)::int AS sc FROM subs JOIN prof USING (site) JOIN {_W} USING (pillar, sub) WHERE pillar <> 'technical' GROUP BY 1, 2),
pil AS (SELECT site, pillar, CASE WHEN n >= 2 THEN sc END AS score FROM a WHERE n > 0 UNION ALL SELECT site, 'technical', tech::int FROM prof)
"""


def _stand_in(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    s = table(spark, d, "supplier")
    subs = spark.sql(SUBS_SQL.replace("FROM supplier", "FROM {supplier}"), supplier=s)
    prof = s.selectExpr("s_suppkey AS site", f"{_PROFILE} AS profile", "s_suppkey % 101 AS tech", "s_suppkey % 7 = 0 AS shut")
    tech = prof.select("site", F.col("tech").alias("score"), R.grade(F.col("tech")).alias("grade"))
    return subs, prof.select("site", "profile"), tech, prof.where("shut")


@query(_PILLARS + f"SELECT site, pillar, score, CASE WHEN score IS NOT NULL THEN {A._GRADE} END AS grade FROM pil")
def ranking_pillars(spark: SparkSession, d: str) -> DataFrame:
    subs, profiles, tech, _ = _stand_in(spark, d)
    return R.pillar_scores(subs, profiles, tech)


@query(_PILLARS + f""", o AS (SELECT site, profile, shut, floor(sum(score * pw)::double / sum(pw) + 0.5)::int AS sc FROM pil JOIN prof USING (site) JOIN {_P} USING (profile, pillar) WHERE score IS NOT NULL GROUP BY 1, 2, 3),
q AS (SELECT site, profile, shut, CASE WHEN shut THEN least(sc, 40) ELSE sc END AS score FROM o)
SELECT site, profile, score, CASE WHEN shut THEN 'F' ELSE {A._GRADE} END AS grade FROM q""")
def ranking_score(spark: SparkSession, d: str) -> DataFrame:
    subs, profiles, tech, shut = _stand_in(spark, d)
    return R.ranking_score(R.pillar_scores(subs, profiles, tech), profiles, shut)


@query(A.SITE_SQL + A._DIMS + """SELECT site, 'technical' AS pillar, sub, score::int AS score FROM dims JOIN (VALUES ('crawl', 'crawlability'), ('onpage', 'onpage'), ('cwv', 'performance'), ('mobile', 'mobile'), ('https', 'security'), ('structure', 'architecture'), ('schema', 'structured')) t(sub, dimension) USING (dimension)""")
def ranking_technical(spark: SparkSession, d: str) -> DataFrame:
    """The seven technical sub-scores are the on-site dimensions' scores."""
    return R.technical_subs(C.site_dimensions(C.site_checks(A.crawl(spark, d))))
