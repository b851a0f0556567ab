"""Queries of the log, page, text, matching and streaming operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citewise.operators import matching as M
from citewise.operators import checks as C
from citewise.operators import pages as P
from citewise.operators.duplicates import near_duplicates
from citewise.session import cut
from citewise.sources.logs import log_lines
from citewise.sources.pages import page_signals, parse_pages
from citewise.sources.robots import robots_decisions, robots_rules
from citewise.sources.tables import table
from citewise.streaming import limits, windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LINES = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_type = 'log'),
g AS (SELECT *, regexp_extract(line, '^(\\S+) \\S+ \\S+ \\[([^\\]]+)\\] "([^"]*)" (\\d{3}) (\\S+) "([^"]*)" "([^"]*)"$', ['ip', 'at', 'request', 'status', 'bytes', 'ref', 'agent']) AS p,
  regexp_matches(line, '^(\\S+) \\S+ \\S+ \\[([^\\]]+)\\] "([^"]*)" (\\d{3}) (\\S+) "([^"]*)" "([^"]*)"$') AS ok FROM l)
"""
AGENT_RULES = [("GallioBot", "search"), ("FencitBot", "training"), ("Marun", "user"), ("WixlioBot", "training"), ("Bot/2", "second"), ("Bot", "other")]
RANGES = [("low", "192.0.2.0/25"), ("high", "192.0.2.128/25"), ("one", "192.0.2.7/32"), ("wide", "192.0.0.0/16")]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_type = 'log'")
    return log_lines(docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")), "line")


@query(LINES + """SELECT ok, CASE WHEN ok THEN try_cast(p.status AS int) END AS status, count(*) AS n, coalesce(sum(CASE WHEN ok THEN try_cast(p.bytes AS bigint) END), 0)::bigint AS bytes, count(DISTINCT CASE WHEN ok THEN p.ip END) AS n_ips FROM g GROUP BY 1, 2""")
def log_status(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy("ok", "status").agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.countDistinct("ip").alias("n_ips"))


_TOKEN = "CASE " + " ".join(f"WHEN contains(lower(p.agent), '{t.lower()}') THEN '{t}|{c}'" for t, c in AGENT_RULES) + " ELSE 'unknown|unknown' END"


@query(LINES + f"""SELECT split_part(t, '|', 1) AS token, split_part(t, '|', 2) AS category, providers, count(*) AS n FROM (
  SELECT {_TOKEN} AS t, CASE WHEN v4 THEN concat_ws(';', CASE WHEN net AND h >= 128 THEN 'high' END, CASE WHEN net AND h < 128 THEN 'low' END, CASE WHEN net AND h = 7 THEN 'one' END, CASE WHEN starts_with(p.ip, '192.0.') THEN 'wide' END) ELSE '' END AS providers
  FROM (SELECT *, regexp_matches(p.ip, '^(25[0-5]|2[0-4]\\d|1?\\d?\\d)([.](25[0-5]|2[0-4]\\d|1?\\d?\\d)){{3}}$') AS v4, starts_with(p.ip, '192.0.2.') AS net, try_cast(split_part(p.ip, '.', 4) AS int) AS h FROM g WHERE ok)) GROUP BY 1, 2, 3""")
def log_agents(spark: SparkSession, d: str) -> DataFrame:
    """Agents and providers of every valid line; providers is empty for addresses outside the ranges or not IPv4."""
    rows = M.in_ranges(_lines(spark, d).where("ok"), "ip", RANGES).withColumn("r", M.first_rule(F.col("agent"), AGENT_RULES))
    return rows.groupBy("r.token", "r.category", F.array_join("providers", ";").alias("providers")).agg(F.count("*").alias("n"))


OWNERS = {"GallioBot": "low", "FencitBot": "high", "Marun": "none", "WixlioBot": "wide"}


@query(LINES + f"""SELECT claimed_token, claimed_category, ip_verification, sum(n)::bigint AS requests FROM (
  SELECT CASE WHEN ok THEN split_part(t, '|', 1) ELSE '_TOTAL' END AS claimed_token, CASE WHEN ok THEN split_part(t, '|', 2) ELSE 'all' END AS claimed_category,
  CASE WHEN NOT coalesce(ok, false) THEN 'malformed_lines' WHEN split_part(t, '|', 1) NOT IN ('GallioBot', 'FencitBot', 'WixlioBot') THEN 'not_checked' WHEN v4 AND CASE split_part(t, '|', 1) WHEN 'GallioBot' THEN net AND h < 128 WHEN 'FencitBot' THEN net AND h >= 128 ELSE starts_with(p.ip, '192.0.') END THEN 'verified' ELSE 'mismatch' END AS ip_verification, 1 AS n
  FROM (SELECT *, {_TOKEN} AS t, regexp_matches(p.ip, '^(25[0-5]|2[0-4]\\d|1?\\d?\\d)([.](25[0-5]|2[0-4]\\d|1?\\d?\\d)){{3}}$') AS v4, starts_with(p.ip, '192.0.2.') AS net, try_cast(split_part(p.ip, '.', 4) AS int) AS h FROM g) UNION ALL SELECT '_TOTAL', 'all', 'malformed_lines', 0) GROUP BY 1, 2, 3""")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.log_summary(_lines(spark, d), AGENT_RULES, OWNERS, [*RANGES, ("wide", "2001:db8::/32")])


ROBOTS = """
User-Agent: ExampleBot
Disallow: /blog/
Allow: /blog/answer
Disallow: /*-amber$
Allow: /tie/*
User-agent: *
Disallow: /tools/
Allow: /tools/canonical
"""


@query(r"""WITH p AS (SELECT DISTINCT coalesce(nullif(regexp_extract(page, '(?i)^https?://[^/]+(/[^?#]*)', 1), ''), '/') AS path FROM gsc_daily WHERE page <> ''),
a AS (SELECT path, agent FROM p, (VALUES ('examplebot'), ('other')) v(agent))
SELECT agent, decision, matched_rule, count(*) AS n FROM (
  SELECT agent, coalesce(CASE
      WHEN agent = 'examplebot' AND starts_with(path, '/blog/answer') THEN 'allow|/blog/answer'
      WHEN agent = 'examplebot' AND regexp_matches(path, '-amber$') THEN 'disallow|/*-amber$'
      WHEN agent = 'examplebot' AND starts_with(path, '/blog/') THEN 'disallow|/blog/'
      WHEN agent = 'other' AND starts_with(path, '/tools/canonical') THEN 'allow|/tools/canonical'
      WHEN agent = 'other' AND starts_with(path, '/tools/') THEN 'disallow|/tools/' END, 'allow|') AS x,
    split_part(x, '|', 1) AS decision, nullif(split_part(x, '|', 2), '') AS matched_rule FROM a) GROUP BY 1, 2, 3""")
def robots(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("page", r"(?i)^https?://[^/]+(/[^?#]*)", 1)
    paths = table(spark, d, "gsc_daily").where("page <> ''").select(F.when(path == "", "/").otherwise(path).alias("path")).distinct()
    rows = paths.select("path", F.explode(F.array(F.lit("examplebot"), F.lit("other"))).alias("agent"))
    return robots_decisions(rows, "agent", "path", robots_rules(ROBOTS)).groupBy("agent", "decision", "matched_rule").agg(F.count("*").alias("n"))


@query(r"""WITH alias AS (SELECT brand AS entity, brand AS alias FROM monitors WHERE brand IS NOT NULL UNION SELECT brand, domain FROM monitors WHERE brand IS NOT NULL AND domain IS NOT NULL),
fold AS (SELECT entity, alias, regexp_replace(lower(alias), '[^\p{L}\p{N}_]+', '', 'g') AS k FROM alias),
e AS (SELECT alias, count(DISTINCT entity) AS n, min(entity) AS entity FROM alias WHERE alias <> '' GROUP BY 1), f AS (SELECT k, count(DISTINCT entity) AS n, min(entity) AS entity FROM fold WHERE k <> '' GROUP BY 1),
o AS (SELECT DISTINCT brand AS name FROM leads WHERE brand IS NOT NULL)
SELECT name, CASE WHEN e.n > 0 THEN 'exact' WHEN f.n > 0 THEN 'normalized' ELSE 'none' END AS match_mode,
  CASE WHEN coalesce(e.n, f.n, 0) = 1 THEN 'match' WHEN coalesce(e.n, f.n, 0) > 1 THEN 'review' ELSE 'no-match' END AS decision,
  CASE WHEN coalesce(e.n, f.n, 0) = 1 THEN coalesce(e.entity, f.entity) END AS entity
FROM o LEFT JOIN e ON e.alias = o.name LEFT JOIN f ON f.k = regexp_replace(lower(o.name), '[^\p{L}\p{N}_]+', '', 'g')""")
def alias_matches(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "monitors").where("brand is not null")
    aliases = m.select(F.col("brand").alias("entity"), F.col("brand").alias("alias")).union(m.where("domain is not null").select("brand", "domain")).distinct()
    return M.match_aliases(table(spark, d, "leads").where("brand is not null").select(F.col("brand").alias("name")).distinct(), "name", aliases)


def _facts(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """Facts of every page source (of those of which where holds), with its source (the site) and address."""
    docs = table(spark, d, "documents").where("doc_type = 'page_html'").where(where).select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text")
    at = docs.withColumn("url", F.concat(F.lit("https://"), F.coalesce("source", F.lit("none.example")), F.lit("/page-"), "doc_id"))
    return parse_pages(at, "doc_id", "text", "url", keep=("source", "url"))


@query(r"""SELECT doc_id::varchar AS doc_id, nullif(trim(regexp_extract(text, '<html lang="([^"]*)"', 1)), '') AS lang,
  len(regexp_extract_all(text, '<h2[^>]*>')) AS n_h2, len(regexp_extract_all(text, '<p(?:\s[^>]*)?>')) AS n_paragraphs FROM documents WHERE doc_type = 'page_html' AND text <> ''""")
def page_facts(spark: SparkSession, d: str) -> DataFrame:
    facts = parse_pages(table(spark, d, "documents").where("doc_type = 'page_html' and text <> ''"), "doc_id", "text")
    return facts.select("doc_id", "lang", F.size(F.filter("headings", lambda h: h["level"] == 2)).alias("n_h2"), "n_paragraphs")


@query(r"""SELECT doc_id::varchar AS doc_id, len(list_filter(regexp_extract_all(text, '<a href="[^"]*"'), lambda x: starts_with(x, '<a href="/'))) AS n_links, replace(trim(regexp_replace(regexp_extract(text, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')), '&amp;', '&') AS title,
  len(regexp_extract_all(text, '<h3[^>]*>')) AS n_h3, len(regexp_extract_all(text, '<ul|<ol')) AS n_lists, len(regexp_extract_all(text, '<table')) AS n_tables FROM documents WHERE doc_type = 'page_html' AND text LIKE '%<title>%</title>%</html>%'""")
def page_structure(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d, "text LIKE '%<title>%</title>%</html>%'")
    s = page_signals(f, "doc_id", F.col("url"))
    return s.select("doc_id", "n_links", "title", "n_h3", "n_lists", "n_tables")


@query()
def page_content(spark: SparkSession, d: str) -> DataFrame:
    """All signals of every page source."""
    return page_signals(_facts(spark, d), "doc_id", F.col("url"))


@query()
def html_site_checks(spark: SparkSession, d: str) -> DataFrame:
    """The audit of the page sources by themselves: a site is a source, its first page the entry; what only probes tell isn't measured.

    The pages' facts, and the rows that are audited, are written once and read by all that follows.
    """
    f = cut(_facts(spark, d).withColumn("site", F.coalesce("source", F.lit(""))))
    s = page_signals(f, "doc_id", F.col("url")).select("doc_id", "n_words", "n_unique_links", "js_shell", "noindex", "page_type", "last_modified")
    near = near_duplicates(f.select("doc_id", "main_text"), "doc_id", "main_text").join(f.select("doc_id", "site"), "doc_id")
    size = near.groupBy("class", "site").agg(F.count("*").alias("c"))
    near = near.join(size, ["class", "site"]).select("doc_id", (F.col("c") > 1).alias("near_duplicate"))
    entry = f.groupBy("site").agg(F.min(F.col("doc_id").cast("long")).cast("string").alias("entry"))
    p = cut(f.join(s, "doc_id").join(near, "doc_id", "left").join(entry, "site").select(
        "site", "url", F.col("url").alias("final_url"), F.lit(200).alias("status"), "title", "description", "h1s", "headings", "n_words", F.col("n_internal").alias("n_links"), "n_unique_links", "n_nofollow", F.col("n_generic_anchors").alias("n_generic"), "n_images", "n_missing_alt", F.col("n_missing_size").alias("n_missing_dims"),
        F.col("json_ld_types").alias("types"), F.col("n_json_ld_errors").alias("n_ld_errors"), "has_breadcrumb", "n_mixed", "hreflang", "canonical", "lang", "viewport", "og", "twitter", "has_favicon", "noindex", F.col("refresh").isNotNull().alias("meta_refresh"), "last_modified", "js_shell", "page_type", "links", (F.col("doc_id") == F.col("entry")).alias("is_entry"), "near_duplicate",
    ))
    sites = p.groupBy("site").agg(F.min(F.when(F.col("is_entry"), F.col("url"))).alias("entry_url"))
    return C.site_checks(C.Crawl(p, sites, F.lit("2026-10-01").cast("date"))).drop("of_pages")


_W = r"[\p{L}\p{N}]+(?:[''’.\-][\p{L}\p{N}]+)*"
_CJK = "[㐀-䶿一-鿿぀-ヿ가-힯]"
_ABBR = r"e\.g|i\.e|vs|mr|mrs|ms|dr|prof|st|jr|sr|inc|ltd|co|corp|no|fig|figs|approx|est|dept|vol|u\.s|u\.k|a\.m|p\.m"


@query(rf"""SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '{_CJK}', ' ', 'g'), '{_W}')) + len(regexp_extract_all(text, '{_CJK}')) AS n_words,
  len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(text, '(^|[^\p{{L}}.])((?i:{_ABBR})|\p{{L}})\.([\t\f\v\r \x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}])', '\1\2\3', 'g'), '(^|[^\p{{L}}.])((?i:{_ABBR})|\p{{L}})\.([\t\f\v\r \x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}])', '\1\2\3', 'g'), '([.!?]["''”’)\]]*)[\t\f\v\r ]+', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_matches(s, '[\p{{L}}\p{{N}}]'))) AS n_sentences FROM documents WHERE text IS NOT NULL""")
def text_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.text_measures(table(spark, d, "documents").where("text is not null"), "doc_id", "text").select("doc_id", "n_words", "n_sentences")


def _prose(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, doc_type and text of every document; of page sources the main text that a reader sees."""
    docs = table(spark, d, "documents").select("doc_id", "doc_type", "text")
    page = F.coalesce(F.col("doc_type") == "page_html", F.lit(False))
    main = parse_pages(docs.where(page), "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("page_html").alias("doc_type"), F.col("main_text").alias("text"))
    return docs.where(~page).unionByName(main)



_FENCE, _PICTURE = r"```(?:[^`]|`[^`]|``[^`])*```", r"!\[[^\]]*\]\([^)]*\)"


def _visible(t: str) -> str:
    """visible_words in DuckDB's SQL."""
    for pattern, to in ((_FENCE, " "), (_PICTURE, " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), ("<[^>]+>", " "), (r"https?://[^ \t\n\r]+", " "), (r"[#>*_`|-]", " ")):
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return f"len(regexp_extract_all({t}, '[A-Za-z0-9][A-Za-z0-9''’.-]*'))"


@query(rf"""WITH d AS (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS t FROM documents), b AS (SELECT doc_id, t, chr(10) || regexp_replace(t, '{_FENCE}', '', 'g') AS bare, regexp_extract_all(regexp_replace(t, '{_PICTURE}', '', 'g'), '\[[^\]]+\]\(([^)\s]+)\)', 1) AS links FROM d),
c AS (SELECT *, regexp_extract_all(bare, '\n##[ \t]+([^\n]+)', 1) AS heads, list_transform(regexp_split_to_array(bare, '\n##[ \t]+[^\n]+')[2:], lambda x: regexp_split_to_array(regexp_replace(x, '^[ \t\n]+', ''), '\n[ \t]*\n')[1]) AS opening, list_filter(regexp_split_to_array(t, '\n[ \t\n]*\n'), lambda x: NOT regexp_matches(x, '^[ \t\n]*(?:#|[-*]|[0-9]+\.|\||!\[|>)')) AS plain FROM b)
SELECT doc_id, {_visible('t')} AS n_words, len(regexp_extract_all(t, '!\[[^\]]*\]\(https?://[^)\s]+\)')) AS n_pictures, len(list_filter(links, lambda u: regexp_matches(u, '^https://') AND NOT regexp_matches(u, '^https?://(?:www\.)?example\.com(?:[/?#]|$)'))) AS n_external, len(list_filter(links, lambda u: regexp_matches(u, '^/(?:[^/]|$)') OR regexp_matches(u, '^https?://(?:www\.)?example\.com(?:[/?#]|$)'))) AS n_internal,
 len(heads) AS n_h2, len(list_filter(heads, lambda h: regexp_matches(h, '\?[ \t]*$'))) AS n_questions, len(list_filter(opening, lambda o: regexp_matches(o, '^[ \t\n]*(?:#{{3}}|[-*]|[0-9]+\.|\||!\[)'))) AS n_listed, len(list_filter(opening, lambda o: NOT regexp_matches(o, '^[ \t\n]*(?:#{{3}}|[-*]|[0-9]+\.|\||!\[)') AND {_visible('o')} > 75)) AS n_long_openings,
 len(list_filter(plain, lambda x: len(regexp_extract_all(x, '[.!?](?:[ \t\n]|$)')) > 5)) AS n_long_paragraphs FROM c""")
def text_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Markdown measures of all documents as they are."""
    return P.markdown_measures(table(spark, d, "documents"), "doc_id", "text", "example.com")

@query()
def reading_ease(spark: SparkSession, d: str) -> DataFrame:
    return P.text_measures(_prose(spark, d), "doc_id", "text")


_EDGE = "{0} NOT IN (" + ", ".join(f"'{w}'" for w in P.STOP_WORDS) + ") AND length({0}) >= 2 AND NOT regexp_matches({0}, '^[0-9]+$')"


@query(rf"""WITH w AS (SELECT doc_type, regexp_extract_all(lower(text), '{P.PHRASE_WORD.replace("'", "''")}') AS w FROM documents), r AS (SELECT doc_type, w, unnest(range(1, len(w) + 1)) AS i FROM w),
t AS (SELECT doc_type, a, b, c, {_EDGE.format("a")} AS x, {_EDGE.format("b")} AS y, {_EDGE.format("c")} AS z, length(b) >= 2 AND NOT regexp_matches(b, '^[0-9]+$') AS m FROM (SELECT doc_type, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM r)),
g AS (SELECT doc_type, 1 AS n, a AS ngram FROM t WHERE x UNION ALL SELECT doc_type, 2, a || ' ' || b FROM t WHERE x AND y UNION ALL SELECT doc_type, 3, a || ' ' || b || ' ' || c FROM t WHERE x AND m AND z),
k AS (SELECT doc_type, n, ngram, count(*) AS count, row_number() OVER (PARTITION BY doc_type, n ORDER BY count(*) DESC, ngram) AS place FROM g GROUP BY 1, 2, 3), s AS (SELECT doc_type AS d, count(*) AS words FROM t GROUP BY 1)
SELECT doc_type, n, place, ngram, count, round(count * n / words, 4) AS share FROM k JOIN s ON d IS NOT DISTINCT FROM doc_type WHERE count >= 2 AND place <= 15""")
def text_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of all documents as they are, markup with them, by doc_type."""
    return P.phrase_density(table(spark, d, "documents"), ["doc_type"], "text")


@query()
def phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of one, two and three words of all documents by doc_type."""
    return P.phrase_density(_prose(spark, d), ["doc_type"], "text")


@query()
def document_classes(spark: SparkSession, d: str) -> DataFrame:
    """Near copies among all documents: each document's class is the least id it is linked to."""
    return near_duplicates(table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts by day of a stream that is restated by each batch; the whole stands in the shared folder."""
    return windows.run_whole(windows.window_counts(windows.read_table(spark, d, "events"), "ts", ["event_type"], "value", "1 day", "2 days"))


@query()
def stream_quota(spark: SparkSession, d: str) -> DataFrame:
    return windows.run_once(limits.window_quota(windows.read_table(spark, d, "events"), "user_id", "ts", "event_id", 5, 86400.0))


@query()
def stream_tokens(spark: SparkSession, d: str) -> DataFrame:
    return windows.run_once(limits.token_bucket(windows.read_table(spark, d, "events"), "user_id", "ts", "event_id", 3, 86400.0))


@query(r"""SELECT left(sha256(concat_ws('|', regexp_replace(coalesce(error, ''), '[0-9a-f]{8}-[0-9a-f-]{27}|\d+', '#', 'g'), regexp_replace(coalesce(endpoint, ''), '[0-9a-f]{8}-[0-9a-f-]{27}|\d+', '#', 'g'))), 32) AS fingerprint,
  count(*) AS n, min(created_at) AS first_seen, max(created_at) AS last_seen FROM api_requests WHERE error IS NOT NULL GROUP BY 1""")
def error_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return windows.fingerprints(table(spark, d, "api_requests").where("error is not null"), ["error", "endpoint"], "created_at")


@query("""WITH g AS (SELECT id, clicks, pulled_at, pulled_at >= TIMESTAMP '2026-08-01' AS late FROM gsc_daily),
last AS (SELECT id, late, clicks FROM g QUALIFY row_number() OVER (PARTITION BY id, late ORDER BY pulled_at DESC, clicks DESC NULLS LAST) = 1)
SELECT count(*) AS n, sum(clicks)::bigint AS clicks FROM last WHERE late OR id NOT IN (SELECT id FROM last WHERE late)""")
def late_restatement(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gsc_daily").select("id", "clicks", "pulled_at")
    cut, newest = F.lit("2026-08-01").cast("timestamp_ntz"), F.struct("pulled_at", "clicks")
    old = g.where(F.col("pulled_at") < cut).groupBy("id").agg(F.max(newest).alias("r")).select("id", "r.clicks", "r.pulled_at")
    return windows.restate(old, g.where(F.col("pulled_at") >= cut), ["id"], newest).agg(F.count("*").alias("n"), F.sum("clicks").alias("clicks"))


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) + s * INTERVAL 6 HOUR AS start, event_type, count(*) AS n, sum(value) AS total FROM events, (VALUES (0), (-1), (-2), (-3)) v(s) GROUP BY 1, 2""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """A day's counts every six hours."""
    return windows.window_counts(table(spark, d, "events"), "ts", ["event_type"], "value", "1 day", "2 days", "6 hours")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT min(ts) AS first, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return windows.session_counts(table(spark, d, "events"), "ts", ["user_id"], "2 hours", "2 days")


@query("""SELECT cadence, count(*) AS n, count(*) FILTER (drop_8) AS n_alerts FROM (SELECT cadence, lag(last_score) OVER (PARTITION BY domain ORDER BY created_at, id) - last_score >= 8 AS drop_8
  FROM (SELECT DISTINCT id, domain, cadence, last_score, created_at FROM monitors WHERE last_score IS NOT NULL AND domain IS NOT NULL)) GROUP BY 1""")
def score_alerts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "monitors").where("last_score is not null and domain is not null").select("id", "domain", "cadence", "last_score", "created_at").distinct()
    before = F.lag("last_score").over(Window.partitionBy("domain").orderBy("created_at", "id"))
    return m.withColumn("alert", before - F.col("last_score") >= 8).groupBy("cadence").agg(F.count("*").alias("n"), F.count_if("alert").alias("n_alerts"))

