"""Queries of the answer, console, usage and structure operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citewise.functions.exprs import safe_ratio, url_host, url_key
from citewise.functions.text import intent
from citewise.operators import answers as A
from citewise.operators import console as C
from citewise.operators import structure as S
from citewise.operators import usage as U
from citewise.sources.tables import table

BRAND = "visilume"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return A.audit_answers(table(spark, d, "audits"))


ANSWERS = """
WITH valid AS (
  SELECT id AS audit_id, arg_max(result, loaded_at) AS result FROM audits WHERE result IS NOT NULL GROUP BY 1),
unwrapped AS (
  SELECT audit_id, CASE WHEN result[1] = '"' AND json_valid(result) THEN json_extract_string(result, '$') ELSE result END AS r FROM valid),
docs AS (SELECT audit_id, r::json AS r FROM unwrapped WHERE json_valid(r)),
cells AS (SELECT audit_id, r->>'$.brand' AS brand, unnest(json_extract(r, '$.matrix[*]')) AS m FROM docs),
answers AS (
  SELECT audit_id, brand, m->>'$.engine' AS engine, m->>'$.questionId' AS question_id, m->>'$.question' AS question,
         coalesce((m->>'$.mentioned')::boolean, false) AS mentioned, (m->>'$.rank')::int AS rank, m->>'$.sentiment' AS sentiment,
         (m->>'$.usedSearch')::boolean AS used_search, m
  FROM cells WHERE json_type(m) = 'OBJECT'),
named AS (
  SELECT audit_id, question_id, engine, mentioned, unnest(json_extract(m, '$.competitorsMentioned[*]')) AS c FROM answers),
competitors AS (
  SELECT audit_id, question_id, engine, mentioned,
         nullif(regexp_replace(regexp_replace(trim(CASE WHEN json_type(c) = 'OBJECT' THEN c->>'$.name' ELSE c->>'$' END), '\\s+', ' ', 'g'), '[.,;:]+$', ''), '') AS name
  FROM named WHERE json_type(c) <> 'NULL')
"""


@query(ANSWERS + """
SELECT engine, metric, numerator, denominator, CASE WHEN denominator = 0 THEN NULL ELSE round(numerator::double / denominator, 4) END AS rate FROM (
  SELECT engine, 'mention_rate' AS metric, count(*) FILTER (mentioned) AS numerator, count(*) AS denominator FROM answers GROUP BY 1
  UNION ALL SELECT engine, 'positive_rate_mentioned', count(*) FILTER (mentioned AND sentiment = 'positive'), count(*) FILTER (mentioned) FROM answers GROUP BY 1
  UNION ALL SELECT engine, 'first_place_rate_ranked', count(*) FILTER (mentioned AND rank = 1), count(*) FILTER (rank > 0) FROM answers GROUP BY 1)""")
def answer_rates(spark: SparkSession, d: str) -> DataFrame:
    every = F.lit(True)
    return A.rates(_answers(spark, d), ["engine"], {
        "mention_rate": (F.col("mentioned"), every),
        "positive_rate_mentioned": (F.col("sentiment") == "positive", F.col("mentioned")),
        "first_place_rate_ranked": (F.col("mentioned") & (F.col("rank") == 1), F.col("rank") > 0),
    })


@query("""
SELECT engine, metric, numerator, denominator, CASE WHEN denominator = 0 THEN NULL ELSE round(numerator::double / denominator, 4) END AS rate FROM (
  SELECT event_type AS engine, 'mention_rate' AS metric, count(*) FILTER (value > 50) AS numerator, count(*) AS denominator FROM events WHERE value IS NOT NULL GROUP BY 1
  UNION ALL SELECT event_type, 'recommendation_rate', count(*) FILTER (value > 75), count(*) FROM events WHERE value IS NOT NULL GROUP BY 1
  UNION ALL SELECT event_type, 'answered_rows', count(*), count(*) FROM events WHERE value IS NOT NULL GROUP BY 1
  UNION ALL SELECT event_type, 'recommended_of_mentioned', count(*) FILTER (value > 75), count(*) FILTER (value > 50) FROM events WHERE value IS NOT NULL GROUP BY 1)""")
def event_rates(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").where("value is not null").withColumnRenamed("event_type", "engine")
    every, v = F.lit(True), F.col("value")
    return A.rates(ev, ["engine"], {"mention_rate": (v > 50, every), "recommendation_rate": (v > 75, every), "answered_rows": (every, every), "recommended_of_mentioned": (v > 75, v > 50)})


SCORE = """CASE WHEN NOT mentioned THEN 0.0 ELSE (CASE WHEN rank > 0 THEN greatest(0.3, least(1.0, 1 - (rank - 1) * 0.12::double)) ELSE 0.6 END)
  * coalesce(CASE sentiment WHEN 'positive' THEN 1.0::double WHEN 'neutral' THEN 0.85::double WHEN 'negative' THEN 0.5::double WHEN 'absent' THEN 0.0::double END, 0.85::double) END"""
SUMMARY = f"""count(*) AS n_asked, count(*) FILTER (mentioned) AS n_mentioned, floor(count(*) FILTER (mentioned) * 100::double / count(*) + 0.5)::bigint AS mention_rate,
  floor(avg(CASE WHEN mentioned AND rank > 0 THEN rank END) * 10 + 0.5) / 10 AS avg_rank, floor(round(avg(({SCORE})::double) * 100, 9) + 0.5)::bigint AS visibility"""


@query(ANSWERS + f"SELECT engine, {SUMMARY} FROM answers GROUP BY 1")
def engine_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.engine_summary(_answers(spark, d), ["engine"])


@query(ANSWERS + f"SELECT audit_id, engine, {SUMMARY} FROM answers GROUP BY 1, 2")
def audit_engine_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.engine_summary(_answers(spark, d), ["audit_id", "engine"])


@query(ANSWERS + f""", per AS (SELECT audit_id, engine, {SUMMARY} FROM answers GROUP BY 1, 2),
o AS (SELECT audit_id, floor(avg(visibility) + 0.5)::bigint AS score FROM per GROUP BY 1)
SELECT audit_id, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM o""")
def audit_scores(spark: SparkSession, d: str) -> DataFrame:
    from citewise.functions.exprs import grade, round_up_half

    o = A.engine_summary(_answers(spark, d), ["audit_id", "engine"]).groupBy("audit_id").agg(round_up_half(F.avg("visibility")).alias("score"))
    return o.select("audit_id", "score", grade(F.col("score")).alias("grade"))


def _trade(t: str) -> str:
    """One trade word less at the end of t, while four letters or digits are left."""
    cut = f"trim(regexp_replace({t}, '[\\s&,.·-]+(catering|restaurants?|steakhouse|company|group|services?|solutions?|official|inc|llc|ltd|co)\\.?$', ''))"
    return f"CASE WHEN length(regexp_replace({cut}, '[^a-z0-9]', '', 'g')) >= 4 THEN {cut} ELSE {t} END"


ASSISTANTS = "('chatgpt','openai','claude','anthropic','gemini','googlegemini','bard','copilot','microsoftcopilot','githubcopilot','perplexity','llama','ollama','mistral','deepseek','grok','gpt4','gpt4o','gpt5','llm')"
KEYS = f""", k0 AS (SELECT audit_id, question_id, mentioned, name, regexp_replace(trim(lower(name)), '\\.(ai|io|com|co|app|dev|net|org|so|xyz|tech)$', '') AS t FROM competitors WHERE name IS NOT NULL),
k1 AS (SELECT * REPLACE ({_trade("t")} AS t) FROM k0), k2 AS (SELECT * REPLACE ({_trade("t")} AS t) FROM k1), k3 AS (SELECT * REPLACE ({_trade("t")} AS t) FROM k2),
keyed AS (SELECT audit_id, question_id, mentioned, name, coalesce(nullif(regexp_replace(t, '[^a-z0-9]', '', 'g'), ''), nullif(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), '')) AS key FROM k3),
rivals AS (SELECT * FROM keyed WHERE key IS NOT NULL AND key NOT IN {ASSISTANTS}
  AND NOT (length(regexp_replace(key, '(pro|plus|premium|advanced|ai|app)$', '')) >= 3 AND regexp_replace(key, '(pro|plus|premium|advanced|ai|app)$', '') IN {ASSISTANTS}))"""


@query(ANSWERS + KEYS + """, absent AS (SELECT audit_id, question_id, NOT bool_or(mentioned) AS away FROM answers GROUP BY 1, 2),
spell AS (SELECT DISTINCT audit_id, key, name FROM rivals),
pairs AS (SELECT DISTINCT l.audit_id, l.key, s.key AS short FROM spell l JOIN (SELECT DISTINCT audit_id, key FROM spell WHERE length(key) >= 5) s ON s.audit_id = l.audit_id AND length(l.key) > length(s.key) AND starts_with(l.key, s.key)
  WHERE starts_with(regexp_replace(lower(l.name), '[^a-z0-9]', '', 'g'), s.key) AND regexp_matches(l.name, '^(?:[^A-Za-z0-9]*[A-Za-z0-9]){' || length(s.key) || '}(?:$|[\\s&,.·-])')),
taken AS (SELECT audit_id, key, arg_min(short, length(short)) AS into_key FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.audit_id = p.audit_id AND q.key = p.short) GROUP BY 1, 2),
own AS (SELECT r.*, coalesce(t.into_key, r.key) AS k, away FROM rivals r LEFT JOIN taken t USING (audit_id, key) JOIN absent USING (audit_id, question_id)),
stats AS (SELECT audit_id, k, count(*) AS mentions, count(DISTINCT question_id) AS n_questions, least(count(*) FILTER (away), count(DISTINCT question_id)) AS wins FROM own GROUP BY 1, 2),
best AS (SELECT audit_id, k, first(name ORDER BY same DESC, n DESC, length(name), name) AS name FROM (SELECT audit_id, k, name, count(*) AS n, max((key = k)::int) AS same FROM own GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT audit_id, place, name, mentions, n_questions, wins FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY wins DESC, mentions DESC, k) AS place FROM stats) JOIN best USING (audit_id, k) WHERE place <= 12""")
def competitor_league(spark: SparkSession, d: str) -> DataFrame:
    return A.competitor_league(_answers(spark, d))


@query(ANSWERS + KEYS + """, qs AS (
  SELECT audit_id, q->>'$.id' AS question_id, q->>'$.text' AS question, q->>'$.intent' AS intent
  FROM (SELECT audit_id, unnest(json_extract(r, '$.questions[*]')) AS q FROM docs) WHERE json_type(q) <> 'NULL'),
open AS (SELECT audit_id, question_id, count(DISTINCT engine) AS n_engines FROM answers GROUP BY 1, 2 HAVING NOT bool_or(mentioned)),
who AS (SELECT audit_id, question_id, array_to_string(list_sort(list(DISTINCT name))[1:6], ';') AS competitors FROM rivals GROUP BY 1, 2)
SELECT audit_id, question_id, question, intent, n_engines, competitors FROM open JOIN who USING (audit_id, question_id) JOIN qs USING (audit_id, question_id)""")
def gap_questions(spark: SparkSession, d: str) -> DataFrame:
    return A.gap_questions(_answers(spark, d), A.audit_questions(table(spark, d, "audits")))


@query(ANSWERS + """, a AS (
  SELECT audit_id, engine, count(*) AS n, count(*) FILTER (mentioned) AS m, avg(CASE WHEN mentioned AND rank > 0 THEN rank END) AS r,
    count(*) FILTER (NOT coalesce(used_search, false)) AS mn, count(*) FILTER (mentioned AND NOT coalesce(used_search, false)) AS mm FROM answers GROUP BY 1, 2),
b AS (SELECT *, floor(m * 100::double / n + 0.5)::bigint AS rate, floor(r * 10 + 0.5) / 10 AS avg_rank, CASE WHEN mn > 0 THEN floor(mm * 100::double / mn + 0.5)::bigint END AS memory_rate FROM a)
SELECT audit_id, engine, rate, avg_rank, memory_rate,
  CASE WHEN mn >= 2 AND memory_rate >= 80 AND mm >= 2 THEN 5 WHEN rate >= 50 AND avg_rank <= 2.5 THEN 4 WHEN m > 0 THEN 3 ELSE 2 END AS level FROM b""")
def visibility_levels(spark: SparkSession, d: str) -> DataFrame:
    return A.visibility_level(_answers(spark, d), ["audit_id", "engine"])


@query(ANSWERS + """, f AS (SELECT audit_id, engine, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS key, n FROM (
  SELECT audit_id, engine, trim(CASE WHEN json_type(c) = 'OBJECT' THEN c->>'$.name' ELSE c->>'$' END) AS n FROM named WHERE NOT mentioned AND json_type(c) <> 'NULL')),
g AS (SELECT audit_id, engine, key, count(*) AS n, min(n) AS name FROM f WHERE key <> '' GROUP BY 1, 2, 3)
SELECT audit_id, engine, place, name, n FROM (SELECT *, row_number() OVER (PARTITION BY audit_id, engine ORDER BY n DESC, key) AS place FROM g) WHERE place <= 3""")
def picked_instead(spark: SparkSession, d: str) -> DataFrame:
    return A.picked_instead(_answers(spark, d), ["audit_id", "engine"])


_FLAGS = """SELECT event_type AS engine, CASE WHEN event_id % 7 = 0 THEN 'no' ELSE 'yes' END AS answer_available, CASE WHEN value > 50 THEN 'yes' WHEN value > 5 THEN 'no' END AS brand_mentioned,
  CASE WHEN value > 75 THEN 'yes' ELSE 'no' END AS brand_recommended, user_id % 4 AS citation_count, CASE WHEN event_id % 3 = 0 THEN 'yes' ELSE 'no' END AS cited_brand_source FROM events"""


@query(f"""WITH a AS (SELECT * FROM ({_FLAGS}) WHERE answer_available = 'yes'), m AS (
  SELECT 'answer_metrics' AS query, 'mention_rate' AS metric, engine, sum((brand_mentioned = 'yes')::int) AS numerator, count(*) AS denominator FROM a GROUP BY engine
  UNION ALL SELECT 'answer_metrics', 'recommendation_rate', engine, sum((brand_recommended = 'yes')::int), count(*) FROM a GROUP BY engine
  UNION ALL SELECT 'answer_metrics', 'answered_rows', engine, count(*), count(*) FROM a GROUP BY engine
  UNION ALL SELECT 'citation_metrics', 'citation_present_rate_answer', engine, sum((citation_count > 0)::int), count(*) FROM a GROUP BY engine
  UNION ALL SELECT 'citation_metrics', 'brand_citation_rate_answer', engine, sum((cited_brand_source = 'yes')::int), count(*) FROM a GROUP BY engine
  UNION ALL SELECT 'citation_metrics', 'brand_citation_rate_cited_answers', engine, sum((cited_brand_source = 'yes')::int), sum((citation_count > 0)::int) FROM a GROUP BY engine)
SELECT query, metric, engine, numerator::bigint AS numerator, denominator::bigint AS denominator, CASE WHEN denominator = 0 THEN NULL ELSE round(numerator::double / denominator, 4) END AS rate FROM m""")
def citation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Both metrics queries over events read as answers."""
    e = table(spark, d, "events")
    rows = e.selectExpr(
        "event_type AS engine", "CASE WHEN event_id % 7 = 0 THEN 'no' ELSE 'yes' END AS answer_available", "CASE WHEN value > 50 THEN 'yes' WHEN value > 5 THEN 'no' END AS brand_mentioned",
        "CASE WHEN value > 75 THEN 'yes' ELSE 'no' END AS brand_recommended", "user_id % 4 AS citation_count", "CASE WHEN event_id % 3 = 0 THEN 'yes' ELSE 'no' END AS cited_brand_source",
    )
    return A.citation_metrics(rows)


ONCE = "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS rn FROM api_requests WHERE id IS NOT NULL) WHERE rn = 1)"


@query(f"""WITH {ONCE}, e AS (SELECT unnest(cost_breakdown) AS x FROM once), f AS (SELECT x.provider AS provider, x.stage AS stage, x.usd AS usd, x.accuracy AS accuracy, x.calls AS calls FROM e),
g AS (SELECT grouping(provider, stage) AS g, provider, stage, round(sum(usd), 6) AS usd, round(sum(CASE WHEN accuracy = 'measured' THEN usd ELSE 0 END), 6) AS measured_usd,
  round(sum(CASE WHEN accuracy = 'estimated' THEN usd ELSE 0 END), 6) AS estimated_usd, sum(coalesce(calls, 1))::bigint AS calls, count(*) AS n
  FROM f GROUP BY GROUPING SETS ((), (provider), (stage)))
SELECT CASE g WHEN 3 THEN 'all' WHEN 1 THEN 'provider' ELSE 'stage' END AS level, CASE g WHEN 1 THEN provider WHEN 2 THEN stage END AS name, usd, measured_usd, estimated_usd, calls, n FROM g""")
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    return U.cost_rollup(table(spark, d, "api_requests"))


@query(f"""WITH {ONCE} SELECT user_id, count(*) AS n, count(*) FILTER (status = 'complete') AS n_ok, count(*) FILTER (status = 'failed') AS n_failed,
  coalesce(sum(cost_micro_usd), 0)::bigint AS cost_micro_usd, coalesce(sum(input_tokens), 0)::bigint AS input_tokens, coalesce(sum(output_tokens), 0)::bigint AS output_tokens,
  floor(avg(CASE WHEN status = 'complete' AND duration_ms >= 0 THEN duration_ms END) + 0.5)::bigint AS avg_duration_ms FROM once GROUP BY 1""")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return U.usage_totals(table(spark, d, "api_requests"), ["user_id"])


@query(f"WITH {ONCE} SELECT created_at::date AS day, count(*) AS n, count(DISTINCT user_id) AS n_users, sum(cost_micro_usd)::bigint AS cost_micro_usd FROM once GROUP BY 1")
def usage_by_day(spark: SparkSession, d: str) -> DataFrame:
    return U.usage_by_day(table(spark, d, "api_requests"))


CONSOLE = """
WITH parsed AS (SELECT *, coalesce(
  try_strptime(regexp_extract(trim(date), '^([0-9]{4}-[0-9]{2}-[0-9]{2})([T ].*)?$', 1), '%Y-%m-%d'),
  try_strptime(regexp_extract(trim(date), '^[0-9]{4}/[0-9]{2}/[0-9]{2}$', 0), '%Y/%m/%d'),
  try_strptime(regexp_extract(trim(date), '^[0-9]{8}$', 0), '%Y%m%d'),
  try_strptime(regexp_extract(trim(date), '^[0-9]{2}[.][0-9]{2}[.][0-9]{4}$', 0), '%d.%m.%Y'))::date AS day FROM gsc_daily WHERE page <> '' AND query <> ''),
r AS (SELECT day, page, query, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions, position FROM parsed WHERE day IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY day, page, query ORDER BY pulled_at DESC, coalesce(clicks, 0) DESC, coalesce(impressions, 0) DESC, position DESC NULLS LAST) = 1)
"""
SUMS = "sum(clicks)::bigint AS clicks, sum(impressions)::bigint AS impressions, sum(coalesce(position, 0.0) * impressions) AS pw, sum(CASE WHEN position IS NOT NULL THEN impressions ELSE 0 END) AS w"
METRICS = "clicks, impressions, coalesce(CASE WHEN impressions <> 0 THEN round(clicks::double / impressions, 4) END, 0.0) AS ctr, CASE WHEN w <> 0 THEN floor(round(pw / w, 9) * 10 + 0.5) / 10 END AS position"
IS_BRAND = f"contains(regexp_replace(lower(query), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '{BRAND}')"


@query(CONSOLE + f", a AS (SELECT day, {SUMS} FROM r GROUP BY 1) SELECT day, {METRICS} FROM a")
def console_days(spark: SparkSession, d: str) -> DataFrame:
    return C.totals(C.console_rows(table(spark, d, "gsc_daily")), ["day"])


@query(CONSOLE + f""", p AS (SELECT query, regexp_replace(page, '#.*$', '') AS page, {SUMS} FROM r WHERE impressions > 0 GROUP BY 1, 2),
a AS (SELECT query, sum(clicks)::bigint AS clicks, sum(impressions)::bigint AS impressions, sum(pw) AS pw, sum(w) AS w, count(*) AS pages FROM p GROUP BY 1)
SELECT query, {METRICS}, pages, {IS_BRAND} AS brand FROM a ORDER BY a.impressions DESC, a.clicks DESC, query LIMIT 100""")
def console_top_queries(spark: SparkSession, d: str) -> DataFrame:
    return C.top_queries(C.console_rows(table(spark, d, "gsc_daily")), BRAND)


@query(CONSOLE + "SELECT count(*) FILTER (clicks = 0) AS n_zero, count(*) AS n_pages FROM (SELECT regexp_replace(page, '#.*$', '') AS page, sum(clicks) AS clicks FROM r WHERE impressions > 0 GROUP BY 1)")
def console_zero_click(spark: SparkSession, d: str) -> DataFrame:
    return C.zero_click_pages(C.console_rows(table(spark, d, "gsc_daily")))


@query(CONSOLE + f""", p AS (SELECT query, regexp_replace(page, '#.*$', '') AS page, sum(clicks)::bigint AS page_clicks, sum(impressions)::bigint AS page_impressions FROM r WHERE impressions > 0 AND NOT {IS_BRAND} GROUP BY 1, 2),
t AS (SELECT *, sum(page_impressions) OVER (PARTITION BY query)::bigint AS impressions FROM p),
s AS (SELECT * FROM t WHERE impressions >= 20 AND page_impressions * 10 >= impressions),
u AS (SELECT *, count(*) OVER (PARTITION BY query) AS n, row_number() OVER (PARTITION BY query ORDER BY page_impressions DESC, page_clicks DESC, page) AS place FROM s),
best AS (SELECT query FROM u WHERE n >= 2 AND place = 1 ORDER BY impressions DESC, query LIMIT 30)
SELECT query, impressions, place, page, page_clicks, page_impressions FROM u WHERE place <= 5 AND n >= 2 AND query IN (SELECT query FROM best)""")
def console_cannibalised(spark: SparkSession, d: str) -> DataFrame:
    return C.cannibalised(C.console_rows(table(spark, d, "gsc_daily")), BRAND)


@query(CONSOLE + """, a AS (SELECT page, sum(CASE WHEN date_diff('day', day, DATE '2026-09-30') BETWEEN 0 AND 27 THEN clicks ELSE 0 END)::bigint AS clicks,
  sum(CASE WHEN date_diff('day', day, DATE '2026-09-30') BETWEEN 28 AND 55 THEN clicks ELSE 0 END)::bigint AS clicks_before FROM r GROUP BY 1)
SELECT page, clicks, clicks_before, CASE WHEN clicks + clicks_before >= 20 THEN round(CASE WHEN clicks_before = 0 THEN 100.0 ELSE greatest(0.0, least(100.0, 50 + ((clicks - clicks_before) * 100.0::double / nullif(clicks_before, 0)) / 40 * 50)) END, 1) END AS score FROM a""")
def console_momentum(spark: SparkSession, d: str) -> DataFrame:
    return C.momentum(C.console_rows(table(spark, d, "gsc_daily")), ["page"], F.lit("2026-09-30").cast("date"))


@query(CONSOLE + f""", a AS (SELECT page, query, {SUMS} FROM r WHERE impressions > 0 GROUP BY 1, 2), q AS (SELECT page, {METRICS} FROM a)
SELECT page, count(*) FILTER (position >= 0 AND position < 1.5) AS pos_1, count(*) FILTER (position >= 1.5 AND position < 3.5) AS pos_2_3, count(*) FILTER (position >= 3.5 AND position < 10.5) AS pos_4_10,
  count(*) FILTER (position >= 10.5 AND position < 20.5) AS pos_11_20, count(*) FILTER (position >= 20.5 AND position < 50.5) AS pos_21_50, count(*) FILTER (position >= 50.5 AND position < 101) AS pos_51_100 FROM q GROUP BY 1""")
def console_positions(spark: SparkSession, d: str) -> DataFrame:
    return C.position_buckets(C.console_rows(table(spark, d, "gsc_daily")), ["page"])


_STOP = "'a','an','the','and','or','but','of','in','on','at','to','for','from','by','with','vs','versus','is','are','do','does','have','has','it','its','this','that','what','which','who','why','how','when','where','i','my','we','our','you','your','as','if','more','most','all','some','not','no','only','up','like','com','www','net','org','io','co','http','https'"


@query(rf"""WITH w AS (SELECT query, regexp_extract_all(lower(regexp_replace(query, '[''’]', '', 'g')), '[\p{{L}}\p{{N}}]+') AS t, contains(lower(query), '{BRAND}') OR contains(regexp_replace(lower(query), '[^\p{{L}}\p{{N}}]', '', 'g'), '{BRAND}') AS own FROM gsc_daily WHERE query IS NOT NULL),
x AS (SELECT query, own, ' ' || array_to_string(t, ' ') || ' ' AS s, list_filter(t, lambda a: NOT contains(a, '{BRAND}') AND length(a) >= 2 AND a NOT IN ({_STOP})) AS core FROM w)
SELECT CASE WHEN own AND len(list_filter(core, lambda a: NOT regexp_matches(a, '^(login|log|signin|sign|app|website|site|official|homepage|home|account|dashboard)s?$'))) = 0 THEN 'navigational'
  WHEN regexp_matches(s, ' (?:vs|versus|best|top|review|reviews|alternative|alternatives|compare|comparison|comparisons|comparing) ') THEN 'commercial'
  WHEN regexp_matches(s, ' (?:price|prices|pricing|cost|costs|buy|buying|coupon|coupons|discount|discounts|free trial) ') THEN 'transactional'
  WHEN regexp_matches(s, ' (?:near me|new york|nyc|los angeles|chicago|houston|phoenix|philadelphia|san antonio|san diego|dallas|jacksonville|austin|fort worth|san jose|columbus|charlotte|indianapolis|san francisco|seattle|denver|oklahoma city|nashville|washington|el paso|las vegas|boston|detroit|portland|louisville|memphis|baltimore|milwaukee|albuquerque|tucson|fresno|sacramento|mesa|atlanta|kansas city|colorado springs|omaha|raleigh|miami|virginia beach|long beach|oakland|minneapolis|bakersfield|tulsa|tampa|arlington) ') THEN 'local'
  WHEN regexp_matches(s, ' (?:what (?:is|are|does)|whats|how (?:to|do|does|can)|why|guide|guides|meaning|definition|define|tutorial|tutorials|explained) ') THEN 'informational'
  WHEN own THEN 'navigational' ELSE 'informational' END AS intent, count(*) AS n, count(DISTINCT query) AS n_queries FROM x GROUP BY 1""")
def query_intents(spark: SparkSession, d: str) -> DataFrame:
    """Queries are judged once each, then counted."""
    q = table(spark, d, "gsc_daily").where("query is not null").groupBy("query").agg(F.count("*").alias("n"))
    return q.groupBy(intent(F.col("query"), F.array(F.lit(BRAND))).alias("intent")).agg(F.sum("n").alias("n"), F.count("*").alias("n_queries"))


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS a, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> '')
SELECT x.b AS brand_a, y.b AS brand_b, count(*) AS n FROM b x JOIN b y ON x.a = y.a AND x.b < y.b GROUP BY 1, 2""")
def co_mention_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    return S.co_mention_edges(rows, "l_orderkey", "p_brand")


@query("SELECT p_brand AS brand, count(DISTINCT l_orderkey) AS n_answers, count(DISTINCT l_suppkey) AS n_engines FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> '' GROUP BY 1")
def co_mention_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_suppkey", "p_brand")
    return S.co_mention_nodes(rows, "p_brand", {"n_answers": "l_orderkey", "n_engines": "l_suppkey"})


CONCENTRATION = """round(first / total, 6) AS top_1, round(three / total, 6) AS top_3, round(h, 6) AS hhi, round(h * 10000, 2) AS hhi_10000, round(1 / h, 5) AS effective"""


@query(f"""WITH n AS (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey) AS place, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM n),
a AS (SELECT l_returnflag, sum(n)::bigint AS total, count(*) AS n_sources, sum(CASE WHEN place = 1 THEN n ELSE 0 END)::double AS first, sum(CASE WHEN place <= 3 THEN n ELSE 0 END)::double AS three, sum((n::double / total) * (n::double / total)) AS h FROM m GROUP BY 1)
SELECT l_returnflag, total, n_sources, {CONCENTRATION} FROM a""")
def source_concentration(spark: SparkSession, d: str) -> DataFrame:
    return S.concentration(table(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey")


@query("""WITH c AS (SELECT l_returnflag, CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS a, CASE WHEN l_extendedprice > 35000 THEN 'large' ELSE 'small' END AS b, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
e AS (SELECT x.l_returnflag, sum(x.n::double * y.n) AS e FROM (SELECT l_returnflag, a AS k, sum(n) AS n FROM c GROUP BY 1, 2) x JOIN (SELECT l_returnflag, b AS k, sum(n) AS n FROM c GROUP BY 1, 2) y USING (l_returnflag, k) GROUP BY 1),
t AS (SELECT l_returnflag, sum(n)::bigint AS n, sum(CASE WHEN a = b THEN n ELSE 0 END)::double AS same FROM c GROUP BY 1)
SELECT l_returnflag, n, round(same / n, 6) AS observed, round(e / (n::double * n), 6) AS expected, round((same / n - e / (n::double * n)) / (1 - e / (n::double * n)), 6) AS kappa FROM t JOIN e USING (l_returnflag)""")
def coder_agreement(spark: SparkSession, d: str) -> DataFrame:
    size = lambda c, n: F.when(F.col(c) > n, "large").otherwise("small")
    rows = table(spark, d, "lineitem").select("l_returnflag", size("l_quantity", 25).alias("a"), size("l_extendedprice", 35000).alias("b"))
    return S.kappa(rows, ["l_returnflag"], "a", "b")


@query("""SELECT label, count(*) FILTER (b = 'large') AS large, count(*) FILTER (b = 'small') AS small FROM (
  SELECT CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS label, CASE WHEN l_extendedprice > 35000 THEN 'large' ELSE 'small' END AS b FROM lineitem) GROUP BY 1""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    size = lambda c, n: F.when(F.col(c) > n, "large").otherwise("small")
    return S.confusion(table(spark, d, "lineitem").select(size("l_quantity", 25).alias("a"), size("l_extendedprice", 35000).alias("b")), "a", "b", ["large", "small"])


@query("""WITH s AS (SELECT o_custkey, year(o_orderdate) AS y, max_by(o_orderstatus, o_orderkey) AS status, max_by(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1, 2),
a AS (SELECT * FROM s WHERE y = 1995), b AS (SELECT * FROM s WHERE y = 1996)
SELECT o_custkey, 'added' AS change, '' AS field, '' AS old, '' AS new FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)
UNION ALL SELECT o_custkey, 'removed', '', '', '' FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)
UNION ALL SELECT o_custkey, 'changed', 'status', a.status, b.status FROM a JOIN b USING (o_custkey) WHERE a.status <> b.status
UNION ALL SELECT o_custkey, 'changed', 'priority', a.priority, b.priority FROM a JOIN b USING (o_custkey) WHERE a.priority <> b.priority""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    snap = lambda y: table(spark, d, "orders").where(F.year("o_orderdate") == y).groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.max_by("o_orderpriority", "o_orderkey").alias("priority"))
    return S.snapshot_diff(snap(1995), snap(1996), ["o_custkey"], ["status", "priority"])


@query("""WITH r(dimension, value, minimum) AS (VALUES ('c_mktsegment', 'BUILDING', 10), ('c_mktsegment', 'SPACE', 1), ('c_nationkey', '7', 5), ('c_nationkey', '99', 0)),
n AS (SELECT 'c_mktsegment' AS dimension, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'c_nationkey', c_nationkey::varchar, count(*) FROM customer GROUP BY 2)
SELECT dimension, value, minimum, coalesce(n, 0) AS n, coalesce(n, 0) >= minimum AS met FROM r LEFT JOIN n USING (dimension, value)""")
def prompt_coverage(spark: SparkSession, d: str) -> DataFrame:
    need = spark.createDataFrame([("c_mktsegment", "BUILDING", 10), ("c_mktsegment", "SPACE", 1), ("c_nationkey", "7", 5), ("c_nationkey", "99", 0)], "dimension string, value string, minimum int")
    return S.coverage(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], need)


@query("""SELECT 'duration_missing' AS code, 'duration_ms' AS field, id, NULL AS value FROM api_requests WHERE duration_ms IS NULL
UNION ALL SELECT 'duration_negative', 'duration_ms', id, duration_ms::varchar FROM api_requests WHERE duration_ms < 0
UNION ALL SELECT 'failed_without_error', 'status', id, status FROM api_requests WHERE status = 'failed' AND error IS NULL
UNION ALL SELECT 'duplicate_key', 'id', id, id FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS n FROM api_requests) WHERE n > 1""")
def row_errors(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "api_requests")
    rules = {
        "duration_missing": ("duration_ms", F.col("duration_ms").isNull()),
        "duration_negative": ("duration_ms", F.col("duration_ms") < 0),
        "failed_without_error": ("status", (F.col("status") == "failed") & F.col("error").isNull()),
    }
    rows = r.select(F.struct("loaded_at", "id").alias("at"), "id", "duration_ms", "status", "error")
    return S.row_errors(rows, rules, "id", "at").select("code", "field", F.col("row.id").alias("id"), "value")


@query()
def engine_set_agreement(spark: SparkSession, d: str) -> DataFrame:
    named = _answers(spark, d).select("audit_id", "engine", F.explode_outer("competitors").alias("name"))
    return S.set_agreement(named, "audit_id", "engine", "name")


ORACLE["engine_set_agreement"] = ANSWERS.replace("competitors AS (", "raw AS (") + """, runs AS (SELECT DISTINCT audit_id, engine FROM answers),
named2 AS (SELECT DISTINCT audit_id, engine, CASE WHEN json_type(c) = 'OBJECT' THEN c->>'$.name' ELSE c->>'$' END AS name FROM named WHERE json_type(c) <> 'NULL'),
sets AS (SELECT r.audit_id, r.engine, coalesce(list_sort(list(name) FILTER (name IS NOT NULL)), []) AS s FROM runs r LEFT JOIN named2 n ON n.audit_id = r.audit_id AND n.engine = r.engine GROUP BY 1, 2),
pairs AS (SELECT a.audit_id, (a.s = b.s)::int AS same, CASE WHEN len(a.s) + len(b.s) = 0 THEN 1.0::double ELSE len(list_intersect(a.s, b.s))::double / len(list_distinct(list_concat(a.s, b.s))) END AS j
  FROM sets a JOIN sets b ON a.audit_id = b.audit_id AND a.engine < b.engine)
SELECT n.audit_id, n_runs, round(avg(same::double), 6) AS exact_share, round(avg(j), 6) AS mean_jaccard FROM (SELECT audit_id, count(*) AS n_runs FROM runs GROUP BY 1) n LEFT JOIN pairs p ON p.audit_id = n.audit_id GROUP BY 1, 2"""


@query(r"""SELECT host, count(*) AS n, count(DISTINCT key) AS n_keys FROM (
  SELECT regexp_replace(lower(regexp_extract(trim(page), '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') AS host,
    regexp_replace(lower(regexp_extract(trim(page), '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') ||
    regexp_replace(regexp_extract(regexp_replace(trim(page), '#.*$', ''), '(?i)^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS key FROM gsc_daily) WHERE host <> '' GROUP BY 1""")
def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "gsc_daily").select(url_host(F.col("page")).alias("host"), url_key(F.col("page")).alias("key")).where("host is not null")
    return p.groupBy("host").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))


@query("""WITH c AS (SELECT s_suppkey, s_nationkey, CASE WHEN n = 0 THEN 'na' WHEN bad = 0 THEN 'pass' WHEN bad::double / n <= 0.2 + 1e-9 THEN 'warn' ELSE 'fail' END AS late,
   CASE WHEN n = 0 THEN 'na' WHEN ret = 0 THEN 'pass' WHEN ret::double / n <= 0.3 + 1e-9 THEN 'warn' ELSE 'fail' END AS returns,
   CASE WHEN s_acctbal > 0 THEN 'pass' ELSE 'fail' END AS balance
 FROM (SELECT s_suppkey, s_nationkey, s_acctbal, count(l_orderkey) AS n, count(*) FILTER (l_discount > 0.08) AS bad, count(*) FILTER (l_returnflag = 'R') AS ret FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)),
k AS (SELECT s_nationkey, late AS status, 3 AS weight, false AS gate FROM c UNION ALL SELECT s_nationkey, returns, 2, false FROM c UNION ALL SELECT s_nationkey, balance, 1, false FROM c),
a AS (SELECT s_nationkey, count(*) AS n, sum((CASE status WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 ELSE 0.0 END)::double * weight) AS c, sum(weight) AS w FROM k WHERE status <> 'na' GROUP BY 1)
SELECT s_nationkey, n, CASE WHEN n >= 3 THEN floor(c * 100 / w + 0.5)::bigint END AS score FROM a""")
def dimension_scores(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.08).alias("bad"), F.count_if(F.col("l_returnflag") == "R").alias("ret"))
    s = table(spark, d, "supplier").join(lines, "s_suppkey", "left")
    row = lambda status, weight: F.struct(status.alias("status"), F.lit(weight).alias("weight"), F.lit(False).alias("gate"))
    checks = s.select("s_nationkey", F.inline(F.array(row(S.share_status(F.col("bad"), F.col("n")), 3), row(S.share_status(F.col("ret"), F.col("n"), 0.3), 2), row(F.when(F.col("s_acctbal") > 0, "pass").otherwise("fail"), 1))))
    return S.dimension_scores(checks, ["s_nationkey"])


@query("""SELECT o_orderpriority, count(*) AS n, round(round(count(*) FILTER (o_totalprice > 100000)::double / count(*), 9) * 100, 1) AS large, round(round(count(*) FILTER (o_orderstatus = 'F')::double / count(*), 9) * 100, 1) AS finished
FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def study_shares(spark: SparkSession, d: str) -> DataFrame:
    return S.rate_share(table(spark, d, "orders"), ["o_orderpriority"], {"large": F.col("o_totalprice") > 100000, "finished": F.col("o_orderstatus") == "F"})


@query("""WITH o AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
m AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM o)
SELECT user_id, s::bigint AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM m GROUP BY 1, 2""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("interval 30 minutes")
    ev = table(spark, d, "events").withColumn("new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("session", F.sum("new").over(w))
    return ev.groupBy("user_id", "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, percentile_disc(0.9) WITHIN GROUP (ORDER BY n) AS p90, median(n) AS middle, list_sort(list(n))[(count(*) // 2 + 1)::int] AS upper_median FROM r GROUP BY 1""")
def percentile_kinds(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    # the upper median is the value at rank floor(n / 2) + 1: the nearest-rank percentile just above one half
    upper = F.expr("percentile_disc(0.5) within group (order by n desc)")
    return n.groupBy("event_type").agg(F.expr("percentile_disc(0.9) within group (order by n)").alias("p90"), F.median("n").alias("middle"), upper.alias("upper_median"))
