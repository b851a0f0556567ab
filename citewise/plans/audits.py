"""Queries of the site audit over tables of pages and sites read out of orders and suppliers, with their SQL.

The test tables hold no probes, so sites are suppliers and pages are orders, whose facts follow from their keys by plain
arithmetic (PAGES and SITES, the same text for both engines). The checks and scores over them are written twice: as the
operators' expressions, and below as SQL of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.operators import checks as C
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


# n: the page's number in its site; site: 0 to 99, the last forty small
PAGES_0 = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 20 = 0 THEN 60 + CAST(floor(o_orderkey / 20.0) AS BIGINT) % 37 ELSE o_orderkey % 60 END AS site, CAST(floor(o_orderkey / 60.0) AS BIGINT) AS n FROM orders"""
_HOST = "'https://www.s' || CAST(site AS STRING) || '.example/'"
PAGES = f"""SELECT *, coalesce(status = 200, false) AS ok, coalesce(status = 200, false) AND NOT shell AS body FROM (SELECT k, site, n,
  {_HOST} || CASE WHEN k < 60 AND n = 0 THEN '' WHEN n % 7 = 0 THEN 'blog/post-' || CAST(n AS STRING) WHEN n % 7 = 1 THEN 'products/item-' || CAST(n AS STRING) WHEN n % 7 = 2 THEN 'Some_Page-' || CAST(n AS STRING)
    WHEN n % 7 = 3 THEN 'a/b/c/d/' || CAST(n AS STRING) WHEN n % 7 = 4 THEN 'contact/' || CAST(n AS STRING) WHEN n % 7 = 5 THEN 'topic-words-' || CAST(n AS STRING) || '?a=1&b=2&c=3' ELSE 'plain-' || CAST(n AS STRING) END AS url,
  CASE WHEN k < 60 AND n = 0 THEN 'home' WHEN n % 7 = 0 THEN 'article' WHEN n % 7 = 1 THEN 'product' WHEN n % 7 = 4 THEN 'contact' ELSE 'other' END AS kind,
  CASE WHEN site % 9 = 4 AND n = 0 THEN 500 WHEN n % 13 = 5 AND site % 3 = 0 THEN 404 WHEN n % 29 = 7 THEN NULL ELSE 200 END AS status,
  CASE WHEN n % (7 + site % 10) = 6 THEN 1 ELSE 0 END AS redirects, n % 6 AS depth, (n % 8 = 7 AND site % 2 = 1) AS shell,
  CASE WHEN n % (5 + site) = 1 THEN '' WHEN n % 3 = 0 THEN 'Short' WHEN n % 3 = 1 THEN 'Post ' || CAST(n AS STRING) || ' about words in detail' ELSE 'Same Title shared on all pages' END AS title,
  CASE WHEN n % (4 + site % 30) = 2 THEN '' WHEN n % (3 + site) = 0 THEN 'A description that is far too long to be shown as it is, because it goes on and on with words that nobody needs, until at last it comes to an end after many, many characters' ELSE 'About page ' || CAST(n % 50 AS STRING) END AS description,
  CASE WHEN n % (6 + site % 20) = 3 THEN 0 WHEN n % (5 + site) = 4 THEN 2 ELSE 1 END AS n_h1, CASE WHEN n % 4 = 0 THEN 'Post words in detail' ELSE 'Another heading' END AS h1, (n % (3 + site % 25) = 1) AS skips,
  CASE WHEN n % 5 = 0 THEN 80 ELSE 400 END AS n_words, n % 160 AS n_links, CASE WHEN site % 4 = 0 THEN n % 3 ELSE 0 END AS n_nofollow, n % (1 + site % 12) AS n_generic, n % 5 AS n_images,
  CASE WHEN n % 5 > 2 AND n % (1 + site % 9) = 0 THEN 1 ELSE 0 END AS n_missing_alt, CASE WHEN site % 11 = 0 THEN NULL WHEN n % 5 > 0 AND n % (2 + site % 15) = 0 THEN 1 ELSE 0 END AS n_missing_dims,
  CASE WHEN k < 60 AND n = 0 AND site % 3 <> 2 THEN CASE WHEN site % 3 = 0 THEN 'Organization' ELSE 'WebSite' END WHEN n % 7 = 0 AND n % (2 + site % 6) <> 0 THEN 'BlogPosting' WHEN n % 7 = 1 AND n % (2 + site % 5) <> 0 THEN 'Product'
    WHEN n % 7 = 6 AND site % 6 = 1 THEN 'BreadcrumbList' WHEN n % 7 = 6 THEN 'FAQPage' END AS type, CASE WHEN site % 8 = 3 AND n = 12 THEN 1 ELSE 0 END AS n_ld_errors, CASE WHEN n % (9 + site) = 8 THEN 2 ELSE 0 END AS n_mixed,
  CASE WHEN n % (4 + site % 40) = 3 THEN 'none' WHEN site % 10 = 9 AND n % 31 = 9 THEN 'relative' WHEN site % 10 = 8 AND n % 31 = 8 THEN 'http' WHEN n % 37 = 11 THEN CASE WHEN site % 2 = 0 THEN 'dead' ELSE 'live' END ELSE 'self' END AS canonical_kind,
  CASE WHEN site % 5 <> 2 OR n % 3 <> 0 THEN 'none' WHEN n % (2 + site % 7) = 0 THEN 'bad' ELSE 'good' END AS hreflang_kind, (n % (8 + site) = 5) AS noindex, (site % 33 = 7 AND n = 9) AS meta_refresh,
  CASE WHEN site % 6 = 5 THEN NULL ELSE 100 + (n * 37) % (300 + site * 20) END AS age_days, CASE WHEN site % 7 = 6 THEN NULL ELSE 300 + (n * 53) % (900 + site * 40) END AS ttfb_ms, (k < 60 AND n = 0) AS is_entry,
  CASE WHEN site % 2 = 0 THEN 6 ELSE n % 3 END AS n_nav, CASE WHEN site % 5 <> 0 AND n % 10 = 0 THEN 'privacy' WHEN site % 7 <> 0 AND n % 10 = 1 THEN 'terms' WHEN site % 4 <> 0 AND n % 10 = 2 THEN 'about' END AS trust,
  CASE WHEN n % 9 = 0 THEN NULL ELSE n % (3 + site % 14) = 2 END AS near_duplicate FROM ({PAGES_0}) a) b"""
SITES_0 = "SELECT s_suppkey AS site FROM supplier"
SITES = f"""SELECT site, {_HOST} AS entry_url, 'www.s' || CAST(site AS STRING) || '.example' AS host,
  CASE WHEN site % 17 = 16 THEN NULL WHEN site % 19 = 18 THEN true ELSE false END AS blocked, CASE WHEN site % 38 = 18 THEN 'tls' END AS blocked_kind, CASE WHEN site % 23 = 22 THEN 'timeout' WHEN site % 29 = 28 THEN 'tls' END AS entry_error,
  CASE WHEN site % 13 = 12 THEN true WHEN site % 13 = 11 THEN false END AS js_dependent, CASE site % 9 WHEN 0 THEN NULL WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN 403 ELSE 200 END AS robots_status, site % 9 > 3 AS robots_found,
  CASE WHEN site % 14 = 5 THEN 600000 ELSE 900 END AS robots_bytes, site % 16 = 6 AS robots_is_html, site % 21 IN (5, 6, 7) AS robots_all, site % 22 = 8 AS robots_entry, CASE site % 21 WHEN 5 THEN true WHEN 6 THEN false END AS googlebot_all,
  CASE WHEN site % 5 = 4 THEN NULL ELSE site % 3 END AS n_blocked_resources, site % 4 <> 0 AS has_sitemap_line, CASE WHEN site % 6 <> 0 THEN 3 END AS ai_rules, site % 15 = 14 AS alt_missing,
  CASE site % 8 WHEN 0 THEN NULL WHEN 1 THEN 404 WHEN 2 THEN 410 WHEN 3 THEN 302 WHEN 4 THEN 500 ELSE 200 END AS soft404_status, site % 3 = 0 AS soft404_like, site % 4 <> 3 AS links_tested,
  CASE WHEN site % 12 = 11 THEN NULL ELSE (site * 7) % 90 - 3 END AS tls_days, site % 12 <> 11 AS tls_known, CASE site % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS tls_www, site % 26 = 25 AS tls_expired, site % 13 = 12 AS tls_failed,
  CASE WHEN site % 3 = 1 THEN 'max-age=1' END AS hsts, site % 5 <> 1 AS headers_known, CASE site % 4 WHEN 0 THEN NULL WHEN 1 THEN 404 ELSE 200 END AS og_image_status, CASE site % 4 WHEN 0 THEN NULL WHEN 2 THEN 'text/html' ELSE 'image/png' END AS og_image_type,
  site % 6 <> 4 AS psi_ok, CASE WHEN site % 2 = 0 THEN 1000.0 + site * 50 END AS field_lcp, CASE WHEN site % 3 = 0 THEN 100.0 + site * 6 END AS field_inp, CASE WHEN site % 4 = 0 THEN site / 200.0 END AS field_cls, CASE WHEN site % 5 = 0 THEN 500.0 + site * 20 END AS field_ttfb,
  CASE WHEN site % 7 <> 0 THEN 1500.0 + site * 40 END AS lab_lcp, CASE WHEN site % 7 <> 1 THEN 50.0 + site * 9 END AS lab_tbt, CASE WHEN site % 7 <> 2 THEN site / 300.0 END AS lab_cls, CASE WHEN site % 7 <> 3 THEN 300.0 + site * 25 END AS lab_ttfb,
  CASE WHEN site % 10 <> 0 THEN site / 100.0 END AS score_performance, CASE WHEN site % 10 <> 1 THEN site / 100.0 END AS score_accessibility, CASE WHEN site % 11 <> 0 THEN (site % 20) / 20.0 END AS a1, CASE WHEN site % 11 <> 1 THEN (site % 13) / 13.0 END AS a2,
  CASE WHEN site % 9 = 0 THEN 500.0 + site * 45 END AS ttfb_p90, CASE WHEN site % 8 <> 0 THEN 100 + site * 4 END AS mobile_words, CASE WHEN site % 16 = 1 THEN 0 ELSE 500 END AS desktop_words, site % 5 <> 0 AS mobile_h1, site % 7 <> 0 AS desktop_h1, site % 3 AS mobile_ld, site % 4 AS desktop_ld,
  CASE WHEN site % 6 <> 5 THEN site % 6 END AS n_large_images, site % 4 <> 2 AS authority, site * 3 AS referring_domains, CASE WHEN site % 9 <> 8 THEN site * 1.0 END AS domain_rank, CASE WHEN site % 9 <> 7 THEN (site * 3) % 50 * 1.0 END AS spam_score, (site % 10) / 10.0 AS nofollow_share,
  CASE WHEN site % 20 = 3 THEN 0 ELSE site * 40 END AS backlinks, site * (site % 5) AS broken_backlinks, site * (site % 30) AS top_anchor_links, CASE WHEN site % 8 <> 6 THEN site % 12 END AS gained_domains, CASE WHEN site % 8 <> 6 THEN site % 7 END AS lost_domains,
  site % 5 <> 3 AS visibility, site * 11 AS n_keywords, site % 30 AS n_top10, site * 19.0 AS etv, site % 3 AS n_quick_wins, site % 10 AS n_new, site % 6 AS n_lost, CASE WHEN site % 7 <> 4 THEN (site % 10) / 10.0 END AS index_ratio, CASE WHEN site % 4 <> 1 THEN 0.2 END AS overview_share,
  CASE WHEN site % 6 <> 1 THEN (site % 40) * 200.0 END AS rival_etv, site % 6 AS n_rivals FROM ({SITES_0}) a"""


def crawl(spark: SparkSession, d: str) -> C.Crawl:
    """The audit's tables out of orders and suppliers."""
    spark_sql = lambda q, **t: spark.sql(q.replace("FROM orders", "FROM {orders}").replace("FROM supplier", "FROM {supplier}"), **t)
    own = {"orders": table(spark, d, "orders"), "supplier": table(spark, d, "supplier")}
    today = F.lit("2026-10-01").cast("date")
    base = spark_sql(PAGES, orders=own["orders"])
    host = F.concat(F.lit("https://www.s"), F.col("site").cast("string"), F.lit(".example/"))
    level = lambda i: F.struct(F.lit(i).alias("level"), F.lit("x").alias("text"))
    kind = F.col("canonical_kind")
    pages = base.select(
        "*", F.when(F.col("n") % 41 == 40, F.concat("url", F.lit("-moved"))).otherwise(F.col("url")).alias("final_url"), F.lit("text/html").alias("content_type"), F.col("shell").alias("js_shell"), F.col("kind").alias("page_type"),
        F.when(F.col("n_h1") == 0, F.array().cast("array<string>")).when(F.col("n_h1") == 1, F.array("h1")).otherwise(F.array("h1", "h1")).alias("h1s"), F.when(F.col("skips"), F.array(level(1), level(3))).otherwise(F.array(level(1), level(2), level(2))).alias("headings"),
        F.when(F.col("type").isNull(), F.array().cast("array<string>")).otherwise(F.array("type")).alias("types"), F.lit(False).alias("has_breadcrumb"), F.when(F.col("hreflang_kind") == "good", F.array(F.struct(F.lit("X-Default").alias("lang"), F.col("url").alias("href")))).when(F.col("hreflang_kind") == "bad", F.array(F.struct(F.lit("de").alias("lang"), F.lit("/de").alias("href")))).alias("hreflang"),
        F.when(kind == "self", F.col("url")).when(kind == "relative", "/x").when(kind == "http", F.regexp_replace("url", "^https", "http")).when(kind == "dead", F.concat(host, F.lit("dead"))).when(kind == "live", F.concat(host, F.lit("live"))).alias("canonical"),
        F.when(F.col("site") % 4 != 1, "en").alias("lang"), F.when(F.col("site") % 5 == 0, "width=300").when(F.col("site") % 5 != 1, "width = device-width").alias("viewport"),
        F.when(F.col("site") % 4 == 0, F.create_map(F.lit("title"), F.lit("t"))).when(F.col("site") % 4 != 1, F.create_map(F.lit("title"), F.lit("t"), F.lit("og:description"), F.lit("d"), F.lit("image"), F.lit("i"))).alias("og"),
        F.when(F.col("site") % 3 == 0, F.create_map(F.lit("card"), F.lit("summary"))).alias("twitter"), (F.col("site") % 2 == 0).alias("has_favicon"), F.date_sub(today, F.col("age_days").cast("int")).alias("last_modified"),
        F.concat(F.transform(F.sequence(F.lit(0), F.col("n_nav").cast("int")), lambda i: F.concat(host, F.lit("nav-"), i.cast("string"))), F.when(F.col("trust").isNotNull(), F.array(F.concat(host, "trust"))).otherwise(F.array().cast("array<string>"))).alias("links"),
    )
    sites = spark_sql(SITES, supplier=own["supplier"])
    audits = F.create_map(*(x for name, c in (("total-byte-weight", "a1"), ("render-blocking-resources", "a2"), ("uses-text-compression", "a1"), ("uses-long-cache-ttl", "a2"), ("modern-image-formats", "a1"), ("uses-optimized-images", "a2"), ("unused-javascript", "a1"), ("font-size", "a2"), ("tap-targets", "a1"), ("unsized-images", "a2")) for x in (F.lit(name), F.col(c).cast("double"))))
    sites = sites.withColumn("audits", audits)
    n = sites.select("site", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    at = F.concat(F.when(F.col("i") % 2 == 0, "https").otherwise("http"), F.lit("://"), F.when(F.col("i") % 4 < 2, "www.").otherwise(""), F.lit("s"), F.col("site").cast("string"), F.lit(".example/"))
    home = F.concat(F.lit("https://www.s"), F.col("site").cast("string"), F.lit(".example/"))
    status = F.when((F.col("site") + F.col("i")) % 9 == 8, F.lit(None)).when((F.col("i") == 0) | ((F.col("i") > 3) & (F.col("site") % 3 == 0)) | ((F.col("i") == 1) & (F.col("site") % 10 == 0)) | ((F.col("i") == 2) & (F.col("site") % 6 == 0)), 200).otherwise(F.when(F.col("site") % 4 == 3, 302).otherwise(301)).cast("int")
    variants = n.select("site", at.alias("url"), F.when(F.col("i") == 4, "utm").when(F.col("i") == 5, "uppercase").alias("kind"), status.alias("status"), F.when(status >= 300, status).alias("first_hop"), F.when(status >= 300, F.col("site") % 4).alias("n_hops"), F.when(status >= 300, home).alias("final_url"), F.when(F.col("site") % 2 == 0, home).alias("canonical"), ((F.col("site") % 25 == 24) & (F.col("i") == 3)).alias("meta_refresh"))
    m = sites.where("site % 7 <> 6").select("site", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    sitemaps = m.select("site", F.concat(home, F.lit("map-"), F.col("i").cast("string")).alias("url"), F.when((F.col("site") % 5 == 2) | (F.col("i") == F.col("site") % 8), 404).otherwise(200).alias("status"), (~((F.col("i") == 1) & (F.col("site") % 6 == 0))).alias("valid"), (F.col("i") == 2).alias("is_index"), F.when((F.col("i") == 0) & (F.col("site") % 31 == 30), 60000).otherwise(F.col("site") % 4 * 10).alias("n_urls"), ((F.col("site") * 3 + F.col("i")) % 11 / 10.0).alias("lastmod_share"), F.date_sub(today, (F.col("site") * 9).cast("int")).alias("newest"))
    s = sites.where("site % 6 <> 5").select("site", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    samples = s.select("site", F.concat(home, F.when(F.col("i") < F.col("site") % 10, "lost-").otherwise("nav-"), F.when(F.col("i") < F.col("site") % 10, F.col("i")).otherwise(F.lit(0)).cast("string")).alias("url"), F.when(F.col("i") == F.col("site") % 40, 404).otherwise(200).alias("status"), ((F.col("i") == 3) & (F.col("site") % 27 == 26)).alias("noindex"), F.lit(True).alias("same_host"), F.lit(None).cast("string").alias("canonical"))
    broken = pages.where("n % (11 + site) = 10 AND ok").select("site", F.col("url").alias("from_url"), F.concat("url", F.lit("x")).alias("to_url"))
    targets = sites.select("site", F.explode(F.array(F.lit("dead"), F.lit("live"))).alias("w")).select("site", F.concat(home, "w").alias("url"), F.when(F.col("w") == "dead", 404).otherwise(200).alias("status"), F.lit(False).alias("noindex"))
    return C.Crawl(pages, sites, today, variants, sitemaps, samples, broken, targets)


def _share(x: str, n: str, a: str = "0", b: str = "0.2") -> str:
    return f"CASE WHEN coalesce({n}, 0) = 0 THEN 'na' WHEN {x}::double / {n} <= {a} + 1e-9 THEN 'pass' WHEN {x}::double / {n} <= {b} + 1e-9 THEN 'warn' ELSE 'fail' END"


def _arch(s: str) -> str:
    return f"CASE WHEN coalesce(n_pages, 0) < 5 OR n_ok = 0 THEN 'na' ELSE {s} END"


def _audit(a: str) -> str:
    return f"CASE WHEN NOT psi_ok OR {a} IS NULL THEN 'na' WHEN {a} >= 0.9 THEN 'pass' WHEN {a} >= 0.5 THEN 'warn' ELSE 'fail' END"


def _vital(f: str, lab: str, good: str, poor: str, lab_good: str | None = None) -> str:
    return f"CASE WHEN NOT psi_ok THEN 'na' WHEN {f} IS NOT NULL THEN CASE WHEN {f} <= {good} THEN 'pass' WHEN {f} <= {poor} THEN 'warn' ELSE 'fail' END WHEN {lab} IS NULL THEN 'na' WHEN {lab} <= {lab_good or good} THEN 'pass' ELSE 'warn' END"


def _three(v: str, good: str, ok: str, known: str) -> str:
    return f"CASE WHEN NOT {known} OR {v} IS NULL THEN 'na' WHEN {good} THEN 'pass' WHEN {ok} THEN 'warn' ELSE 'fail' END"


_BASE = f"""WITH pages0 AS ({PAGES}), sites AS ({SITES}),
pages AS (SELECT *, count(*) FILTER (ok AND title <> '') OVER (PARTITION BY site, lower(title)) AS same_t, count(*) FILTER (ok AND description <> '') OVER (PARTITION BY site, lower(description)) AS same_d,
  canonical_kind IN ('relative', 'http', 'dead') AS wrong, n % 41 = 40 AS elsewhere FROM pages0),
agg AS (SELECT site, count(*) AS n_pages, count(*) FILTER (ok) AS n_ok, count(*) FILTER (body) AS n_body, count(*) FILTER (ok AND title <> '') AS titled, count(*) FILTER (ok AND title = '') AS untitled,
  count(*) FILTER (ok AND title <> '' AND (length(title) < 20 OR length(title) > 60)) AS odd_title, count(*) FILTER (ok AND title <> '' AND same_t > 1) AS shared_title,
  count(*) FILTER (body AND title <> '' AND n_h1 > 0 AND kind <> 'home') AS overlap_pages,
  count(*) FILTER (ok AND description = '') AS undescribed, count(*) FILTER (ok AND description <> '') AS described, count(*) FILTER (ok AND length(description) > 160) AS long_d, count(*) FILTER (ok AND description <> '' AND same_d > 1) AS shared_d,
  count(*) FILTER (body AND n_h1 = 0) AS no_h1, count(*) FILTER (body AND n_h1 > 1) AS more_h1, count(*) FILTER (body AND skips) AS skipping, count(*) FILTER (body AND near_duplicate IS NOT NULL) AS hashed, count(*) FILTER (body AND near_duplicate) AS near,
  count(*) FILTER (ok AND n % 7 IN (2, 5) AND NOT is_entry) AS odd_url, count(*) FILTER (ok AND noindex) AS n_noindex, count(*) FILTER (ok AND (canonical_kind = 'none' OR wrong)) AS canonical_bad, count(*) FILTER (ok AND wrong) AS canonical_wrong,
  count(*) FILTER (status IS NULL OR status >= 400) AS errors, count(*) FILTER (redirects > 0 OR elsewhere) AS moved, count(*) FILTER (ok AND hreflang_kind <> 'none') AS lang_pages, count(*) FILTER (ok AND hreflang_kind = 'bad') AS lang_bad,
  count(*) FILTER (ok AND n_mixed > 0) AS mixed, count(*) FILTER (ok AND depth > 3) AS deep, count(*) FILTER (ok AND n_links < 3) AS few, count(*) FILTER (ok AND n_links > 150) AS many, count(*) FILTER (ok AND n % 7 = 3 AND NOT is_entry) AS deep_url,
  count(*) FILTER (ok AND kind = 'article') AS articles, count(*) FILTER (ok AND kind = 'article' AND type IS DISTINCT FROM 'BlogPosting') AS bare_articles, count(*) FILTER (ok AND kind = 'product') AS products, count(*) FILTER (ok AND kind = 'product' AND type IS DISTINCT FROM 'Product') AS bare_products,
  count(*) FILTER (body AND kind = 'article') AS body_articles, count(*) FILTER (body AND kind = 'article' AND n_words < 200) AS thin, count(*) FILTER (body AND kind NOT IN ('article', 'contact') AND n_words < 200) AS other_thin,
  coalesce(sum(n_images) FILTER (body), 0) AS images, coalesce(sum(n_missing_alt) FILTER (body), 0) AS no_alt, count(*) FILTER (body AND n_missing_alt > 0) AS alt_pages, coalesce(sum(n_links) FILTER (body), 0) AS links_b, coalesce(sum(n_nofollow) FILTER (body), 0) AS nofollow, count(*) FILTER (body AND n_nofollow > 0) AS nofollow_pages,
  count(*) FILTER (ok AND age_days IS NOT NULL) AS dated, count(*) FILTER (ok AND age_days > 365) AS old, count(*) FILTER (ok AND n_missing_dims IS NOT NULL) AS dims_pages, coalesce(sum(n_images) FILTER (ok AND n_missing_dims IS NOT NULL), 0) AS dims_images, coalesce(sum(n_missing_dims) FILTER (ok), 0) AS dims, count(*) FILTER (ok AND n_missing_dims > 0) AS dims_bad,
  count(*) FILTER (ok AND n_ld_errors > 0) AS ld_errors, count(*) FILTER (ok AND type IS NOT NULL) AS ld_pages, count(*) FILTER (ok AND type = 'BreadcrumbList') AS crumbs, coalesce(sum(n_links) FILTER (ok), 0) AS links_o, coalesce(sum(n_generic) FILTER (ok), 0) AS generic, count(*) FILTER (ok AND n_generic > 0) AS generic_pages,
  coalesce(bool_or(ok AND trust = 'privacy'), false)::int AS priv, coalesce(bool_or(ok AND trust = 'terms'), false)::int AS terms, (coalesce(bool_or(ok AND trust = 'about'), false) OR coalesce(bool_or(ok AND n % 7 = 4), false))::int AS cont,
  count(*) FILTER (ok AND meta_refresh) AS refreshing, count(*) FILTER (ok AND n % (11 + site) = 10) AS broken, quantile_disc(ttfb_ms, 0.9) AS p90, count(*) FILTER (ok) AS linking, CASE WHEN min(CASE WHEN ok THEN n_nav END) >= 0 THEN 1 + min(CASE WHEN ok THEN n_nav END) END AS navs,
  count(*) FILTER (ok AND title <> '' AND body AND n_h1 > 0 AND kind <> 'home' AND lap < 0.2) AS apart
  FROM (SELECT *, CASE WHEN title = 'Short' THEN 0.0 ELSE greatest(CASE WHEN h1 = 'Another heading' THEN 0.0 ELSE jac_h END, jac_s) END AS lap FROM (SELECT *, {{LAP}} FROM pages)) GROUP BY 1),
entry AS (SELECT site, status AS e_status, redirects AS e_redirects, noindex AS e_noindex, canonical_kind AS e_canonical, type AS e_type, ok AS e_ok, shell AS e_shell, elsewhere AS e_elsewhere FROM pages WHERE is_entry),
v AS (SELECT site, i, CASE WHEN (site + i) % 9 = 8 THEN NULL WHEN i = 0 OR (i > 3 AND site % 3 = 0) OR (i = 1 AND site % 10 = 0) OR (i = 2 AND site % 6 = 0) THEN 200 WHEN site % 4 = 3 THEN 302 ELSE 301 END AS st FROM sites, range(0, 6) t(i)),
va AS (SELECT site, count(*) FILTER (i % 2 = 1) AS https_n, count(*) FILTER (i % 2 = 1 AND st = 200) AS https_fail, count(*) FILTER (i % 2 = 1 AND (st IS NULL OR st = 302)) AS https_warn, count(*) FILTER (i % 2 = 1 AND st = 302) AS https_temp,
  max(CASE WHEN st >= 300 THEN site % 4 ELSE 0 END) AS longest, count(*) FILTER (site % 25 = 24 AND i = 3) AS v_refresh, count(*) FILTER (i < 4) AS hosts, count(*) FILTER (i < 4 AND st = 200 AND i <> 0) AS host_bad, count(*) FILTER (i < 4 AND st IS NULL) AS silent,
  max(CASE WHEN i = 0 THEN coalesce(st, 0) END) AS www, max(CASE WHEN i = 2 THEN coalesce(st, 0) END) AS apex, count(*) AS n_variants, count(*) FILTER (i > 3) AS spelled, count(*) FILTER (i > 3 AND st = 200 AND site % 2 <> 0) AS spelled_bad,
  count(*) FILTER (i % 2 = 0 AND st < 500) AS https_up FROM v JOIN sites USING (site) WHERE NOT (alt_missing AND i % 4 >= 2) GROUP BY 1),
ma AS (SELECT site, count(*) FILTER (f AND ok_ AND (i = 2 OR u > 0)) AS usable, count(*) FILTER (f) AS fetched, count(*) FILTER (f AND i <> 2 AND u > 50000) AS huge, count(*) FILTER (f AND (NOT ok_ OR (i <> 2 AND u = 0))) AS invalid, sum(CASE WHEN f AND ok_ AND i <> 2 AND u > 0 THEN u END) AS urls, sum(CASE WHEN f AND ok_ AND i <> 2 AND u > 0 THEN u * sh END) AS dated_u
  FROM (SELECT site, i, NOT (site % 5 = 2 OR i = site % 8) AS f, NOT (i = 1 AND site % 6 = 0) AS ok_, CASE WHEN i = 0 AND site % 31 = 30 THEN 60000 ELSE site % 4 * 10 END AS u, ((site * 3 + i) % 11 / 10.0)::double AS sh FROM sites, range(0, 3) t(i) WHERE site % 7 <> 6) GROUP BY 1),
sa AS (SELECT s.site, count(*) AS samples, count(*) FILTER (i = s.site % 40 OR (i = 3 AND s.site % 27 = 26)) AS bad_s, count(*) FILTER (i = 3 AND s.site % 27 = 26) AS no_s, count(*) FILTER (i < s.site % 10 OR coalesce(a.n_ok, 0) = 0) AS orphans FROM sites s CROSS JOIN range(0, 10) t(i) LEFT JOIN agg a ON a.site = s.site WHERE s.site % 6 <> 5 GROUP BY 1),
w AS (SELECT * FROM sites LEFT JOIN agg USING (site) LEFT JOIN entry USING (site) LEFT JOIN va USING (site) LEFT JOIN ma USING (site) LEFT JOIN sa USING (site))
"""
# titles 'Post n about words in detail' against headings 'Post words in detail', and slugs of their kinds of pages
_LAP = """(CASE WHEN title LIKE 'Post %' THEN 3.0 / (CASE WHEN n < 10 THEN 4 ELSE 5 END) WHEN title LIKE 'Same%' THEN 0.0 ELSE 0.0 END) AS jac_h,
  (CASE WHEN title NOT LIKE 'Post %' THEN CASE WHEN title LIKE 'Same%' AND n % 7 = 2 THEN 0.0 ELSE 0.0 END
    ELSE (CASE WHEN n % 7 = 0 THEN CASE WHEN n < 10 THEN 1.0 / 4 ELSE 2.0 / 5 END WHEN n % 7 = 5 THEN CASE WHEN n < 10 THEN 1.0 / 5 ELSE 2.0 / 6 END
      WHEN n < 10 THEN 0.0 WHEN n % 7 IN (3, 4) THEN 1.0 / 5 ELSE 1.0 / 6 END) END) AS jac_s"""
_BASE = _BASE.replace("{LAP}", _LAP)
_CHECKS = {
    "onpage.title.present": ("onpage", "high", _share("untitled", "n_ok"), "n_ok", "untitled"), "onpage.title.length": ("onpage", "low", _share("odd_title", "titled"), "titled", "odd_title"), "onpage.title.unique": ("onpage", "medium", _share("shared_title", "titled"), "titled", "shared_title"),
    "onpage.title.h1-slug-overlap": ("onpage", "low", _share("apart", "overlap_pages"), "overlap_pages", "apart"), "onpage.description.present": ("onpage", "medium", _share("undescribed", "n_ok"), "n_ok", "undescribed"),
    "onpage.description.length": ("onpage", "low", _share("long_d", "described"), "described", "long_d"), "onpage.description.unique": ("onpage", "low", _share("shared_d", "described"), "described", "shared_d"),
    "onpage.h1.missing": ("onpage", "medium", _share("no_h1", "n_body"), "n_body", "no_h1"), "onpage.h1.multiple": ("onpage", "low", _share("more_h1", "n_body"), "n_body", "more_h1"), "onpage.headings.order": ("onpage", "low", _share("skipping", "n_body"), "n_body", "skipping"),
    "onpage.near-duplicate": ("onpage", "medium", "CASE WHEN coalesce(hashed, 0) < 2 THEN 'na' ELSE " + _share("near", "hashed") + " END", "hashed", "near"), "onpage.url.hygiene": ("onpage", "low", _share("odd_url", "n_ok"), "n_ok", "odd_url"),
    "crawl.pages.noindex": ("crawlability", "high", "CASE WHEN n_noindex > 0 AND coalesce(no_s, 0) > 0 THEN 'fail' ELSE " + _share("n_noindex", "n_ok") + " END", "n_ok", "n_noindex"),
    "crawl.canonical.pages": ("crawlability", "CASE WHEN canonical_wrong > 0 THEN 'high' ELSE 'medium' END", "CASE WHEN canonical_wrong > 0 THEN 'fail' ELSE " + _share("canonical_bad", "n_ok") + " END", "n_ok", "canonical_bad"),
    "crawl.pages.errors": ("crawlability", "high", _share("errors", "n_pages"), "n_pages", "errors"), "crawl.links.to-redirects": ("crawlability", "low", _share("moved", "n_pages", "0", "0.1"), "n_pages", "moved"), "crawl.hreflang": ("crawlability", "medium", _share("lang_bad", "lang_pages", "0", "1"), "lang_pages", "lang_bad"),
    "sec.mixed-content": ("security", "medium", _share("mixed", "n_ok"), "n_ok", "mixed"), "arch.depth": ("architecture", "medium", _arch(_share("deep", "n_ok")), "n_ok", "deep"), "arch.internal-links.min": ("architecture", "medium", _arch(_share("few", "n_ok")), "n_ok", "few"),
    "arch.internal-links.bloat": ("architecture", "low", _arch(_share("many", "n_ok")), "n_ok", "many"), "arch.url-depth": ("architecture", "low", _arch(_share("deep_url", "n_ok", "0.1", "1")), "n_ok", "deep_url"),
    "schema.article": ("structured", "high", _share("bare_articles", "articles"), "articles", "bare_articles"), "schema.product": ("structured", "high", _share("bare_products", "products"), "products", "bare_products"),
}
_E = lambda s: f"CASE WHEN NOT coalesce(e_ok, false) THEN 'na' ELSE {s} END"
_SITE = {
    "crawl.blocked": ("crawlability", "critical", "CASE WHEN entry_error = 'tls' OR blocked_kind = 'tls' THEN 'na' WHEN blocked IS NULL THEN 'na' WHEN blocked THEN 'fail' WHEN entry_error IS NOT NULL THEN 'na' ELSE 'pass' END"),
    "crawl.js-dependent": ("crawlability", "high", "CASE WHEN coalesce(blocked, false) THEN 'na' WHEN js_dependent IS NOT NULL THEN CASE WHEN js_dependent THEN 'warn' ELSE 'pass' END WHEN coalesce(e_ok, false) THEN CASE WHEN e_shell THEN 'warn' ELSE 'pass' END ELSE 'na' END"),
    "crawl.robots.exists": ("crawlability", "CASE WHEN robots_status IS NULL OR robots_status >= 500 THEN 'high' ELSE 'low' END", "CASE WHEN robots_status IS NULL THEN 'fail' WHEN robots_status >= 500 THEN 'fail' WHEN robots_status <> 200 THEN 'warn' WHEN robots_is_html THEN 'fail' WHEN robots_bytes > 500 * 1024 THEN 'warn' ELSE 'pass' END"),
    "crawl.robots.blocks-site": ("crawlability", "critical", "CASE WHEN NOT robots_found THEN 'pass' WHEN coalesce(googlebot_all, false) THEN 'fail' WHEN robots_all AND googlebot_all IS NULL THEN 'fail' WHEN robots_all THEN 'info' WHEN robots_entry THEN 'fail' ELSE 'pass' END"),
    "crawl.robots.resources": ("crawlability", "high", "CASE WHEN n_blocked_resources IS NULL THEN 'na' WHEN n_blocked_resources > 0 THEN 'fail' ELSE 'pass' END"),
    "crawl.robots.sitemap-directive": ("crawlability", "low", "CASE WHEN robots_found AND has_sitemap_line THEN 'pass' ELSE 'warn' END"), "crawl.robots.ai-crawlers": ("crawlability", "low", "CASE WHEN ai_rules IS NOT NULL THEN 'info' ELSE 'na' END"),
    "crawl.sitemap.found": ("crawlability", "high", "CASE WHEN coalesce(usable, 0) > 0 THEN 'pass' ELSE 'fail' END"), "crawl.sitemap.valid": ("crawlability", "medium", "CASE WHEN coalesce(fetched, 0) = 0 THEN 'na' WHEN huge > 0 THEN 'fail' WHEN invalid = fetched THEN 'fail' WHEN invalid > 0 THEN 'warn' ELSE 'pass' END"),
    "crawl.sitemap.sample": ("crawlability", "high", _share("bad_s", "samples"), "bad_s"), "crawl.sitemap.lastmod": ("crawlability", "low", "CASE WHEN coalesce(urls, 0) = 0 THEN 'na' WHEN dated_u / urls >= 0.8 THEN 'pass' WHEN dated_u / urls >= 0.3 THEN 'warn' ELSE 'fail' END"),
    "crawl.freshness": ("crawlability", "low", "CASE WHEN dated > 0 THEN CASE WHEN old::double / dated > 0.5 THEN 'warn' ELSE 'pass' END WHEN site % 7 = 6 THEN 'na' WHEN site * 9 > 365 THEN 'warn' ELSE 'pass' END"),
    "crawl.entry.status": ("crawlability", "critical", "CASE WHEN e_redirects IS NULL THEN 'na' WHEN e_status = 200 THEN CASE WHEN e_redirects = 0 THEN 'pass' ELSE 'warn' END ELSE 'fail' END"), "crawl.entry.indexable": ("crawlability", "critical", _E("CASE WHEN e_noindex THEN 'fail' ELSE 'pass' END")),
    "crawl.noindex-robots-conflict": ("crawlability", "high", "CASE WHEN coalesce(n_ok, 0) = 0 THEN 'na' WHEN n_noindex = 0 THEN 'pass' WHEN robots_all OR coalesce(googlebot_all, false) OR (coalesce(e_noindex, false) AND robots_entry) THEN 'fail' ELSE 'pass' END"),
    "crawl.canonical.entry": ("crawlability", "CASE WHEN coalesce(e_ok, false) AND e_canonical IN ('relative', 'http', 'dead') THEN 'high' ELSE 'medium' END", _E("CASE e_canonical WHEN 'none' THEN 'warn' WHEN 'self' THEN 'pass' WHEN 'live' THEN 'warn' ELSE 'fail' END")),
    "crawl.https.redirect": ("crawlability", "CASE WHEN coalesce(https_fail, 0) = 0 AND https_temp > 0 THEN 'low' ELSE 'high' END", "CASE WHEN https_n = 0 THEN 'na' WHEN https_fail > 0 THEN 'fail' WHEN https_warn > 0 THEN 'warn' ELSE 'pass' END"),
    "crawl.host.canonical": ("crawlability", "medium", "CASE WHEN alt_missing OR (www = 0 AND apex = 0) THEN 'na' WHEN www = 200 AND apex = 200 THEN CASE WHEN site % 2 = 0 THEN 'warn' ELSE 'fail' END WHEN www = 200 OR apex = 200 THEN 'pass' ELSE 'warn' END"),
    "crawl.url-variants": ("crawlability", "medium", "CASE WHEN spelled = 0 THEN 'na' WHEN spelled_bad > 0 THEN 'warn' ELSE 'pass' END"), "crawl.redirect.chains": ("crawlability", "medium", "CASE WHEN v_refresh > 0 OR coalesce(refreshing, 0) > 0 THEN 'fail' WHEN longest <= 1 THEN 'pass' WHEN longest = 2 THEN 'warn' ELSE 'fail' END"),
    "crawl.soft404": ("crawlability", "medium", "CASE WHEN soft404_status IS NULL THEN 'na' WHEN soft404_status = 200 THEN CASE WHEN soft404_like THEN 'warn' ELSE 'info' END WHEN soft404_status BETWEEN 300 AND 399 THEN 'warn' ELSE 'pass' END"),
    "crawl.links.broken": ("crawlability", "high", "CASE WHEN NOT links_tested THEN 'na' ELSE " + _share("broken", "(CASE WHEN n_ok > 0 THEN n_ok ELSE n_pages END)") + " END", "broken"),
    "onpage.images.alt": ("onpage", "medium", _share("no_alt", "images", "0.1", "0.3"), "alt_pages"), "onpage.thin": ("onpage", "medium", "CASE WHEN coalesce(n_body, 0) = 0 THEN 'na' WHEN body_articles = 0 THEN CASE WHEN other_thin > 0 THEN 'info' ELSE 'pass' END ELSE " + _share("thin", "body_articles") + " END", "thin"),
    "onpage.lang": ("onpage", "low", _E("CASE WHEN site % 4 = 1 THEN 'warn' ELSE 'pass' END")), "onpage.robots-nofollow": ("onpage", "low", "CASE WHEN coalesce(n_body, 0) = 0 THEN 'na' WHEN links_b > 0 AND nofollow::double / links_b > 0.1 THEN 'warn' ELSE 'pass' END", "nofollow_pages"),
    "perf.cwv.lcp": ("performance", "high", _vital("field_lcp", "lab_lcp", "2500", "4000")), "perf.cwv.inp": ("performance", "high", _vital("field_inp", "lab_tbt", "200", "500")), "perf.cwv.cls": ("performance", "medium", _vital("field_cls", "lab_cls", "0.1", "0.25")), "perf.cwv.ttfb": ("performance", "medium", _vital("field_ttfb", "lab_ttfb", "800", "1800")),
    "perf.lighthouse-score": ("performance", "low", "CASE WHEN psi_ok AND score_performance IS NOT NULL THEN 'info' ELSE 'na' END"), "perf.crawl-ttfb": ("performance", "medium", "CASE WHEN coalesce(ttfb_p90, p90) IS NULL THEN 'na' WHEN coalesce(ttfb_p90, p90) <= 1200 THEN 'pass' WHEN coalesce(ttfb_p90, p90) <= 2500 THEN 'warn' ELSE 'fail' END"),
    "perf.lcp-element": ("performance", "medium", "CASE WHEN NOT psi_ok THEN 'na' WHEN coalesce(a2, 1) < 0.5 THEN 'warn' ELSE 'pass' END"), "perf.weight": ("performance", "low", _audit("a1")), "perf.render-blocking": ("performance", "low", _audit("a2")), "perf.compression": ("performance", "low", _audit("a1")), "perf.cache": ("performance", "low", _audit("a2")),
    "perf.images": ("performance", "low", _audit("least(a1, a2)")), "perf.unused-js": ("performance", "low", _audit("a1")), "mobile.viewport": ("mobile", "critical", _E("CASE site % 5 WHEN 0 THEN 'warn' WHEN 1 THEN 'fail' ELSE 'pass' END")), "mobile.font-size": ("mobile", "medium", _audit("a2")), "mobile.tap-targets": ("mobile", "medium", _audit("a1")),
    "mobile.parity": ("mobile", "high", "CASE WHEN mobile_words IS NULL THEN 'na' WHEN r < 0.5 THEN 'fail' WHEN r < 0.8 OR (desktop_h1 AND NOT mobile_h1) OR (desktop_ld > 0 AND mobile_ld = 0) THEN 'warn' ELSE 'pass' END"),
    "mobile.images.dims": ("mobile", "low", "CASE WHEN coalesce(dims_pages, 0) = 0 THEN 'na' ELSE " + _share("dims", "dims_images") + " END", "dims_bad"), "mobile.images.large": ("mobile", "low", "CASE WHEN n_large_images IS NULL THEN 'na' WHEN n_large_images = 0 THEN 'pass' WHEN n_large_images < 4 THEN 'warn' ELSE 'fail' END"),
    "mobile.accessibility": ("mobile", "low", "CASE WHEN psi_ok AND score_accessibility IS NOT NULL THEN 'info' ELSE 'na' END"), "schema.jsonld.valid": ("structured", "CASE WHEN ld_errors = 0 AND ld_pages = 0 THEN 'medium' ELSE 'high' END", "CASE WHEN coalesce(n_ok, 0) = 0 THEN 'na' WHEN ld_errors > 0 THEN 'fail' WHEN ld_pages = 0 THEN 'warn' ELSE 'pass' END", "ld_errors"),
    "schema.organization": ("structured", "medium", _E("CASE WHEN e_type = 'Organization' THEN 'pass' ELSE 'warn' END")), "schema.website": ("structured", "low", _E("CASE WHEN e_type = 'WebSite' THEN 'pass' ELSE 'warn' END")), "schema.breadcrumb": ("structured", "low", "CASE WHEN coalesce(n_ok, 0) = 0 THEN 'na' WHEN crumbs > 0 THEN 'pass' ELSE 'info' END"),
    "schema.deprecated": ("structured", "low", "CASE WHEN coalesce(n_ok, 0) = 0 THEN 'na' ELSE 'info' END"), "schema.og": ("structured", "low", _E("CASE site % 4 WHEN 0 THEN 'warn' WHEN 1 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'pass' END")), "schema.twitter": ("structured", "low", _E("CASE WHEN site % 3 = 0 THEN 'pass' ELSE 'warn' END")), "schema.favicon": ("structured", "low", _E("CASE WHEN site % 2 = 0 THEN 'pass' ELSE 'warn' END")),
    "sec.https": ("security", "critical", "CASE WHEN tls_failed THEN 'fail' WHEN coalesce(e_status BETWEEN 1 AND 499, false) OR https_up > 0 THEN 'pass' WHEN e_redirects IS NULL AND coalesce(blocked, false) THEN 'na' ELSE 'fail' END"), "sec.tls.expired": ("security", "critical", "CASE WHEN coalesce(tls_days <= 0, false) OR (tls_failed AND tls_expired) THEN 'fail' WHEN tls_days IS NULL THEN 'na' ELSE 'pass' END"),
    "sec.tls.expiring": ("security", "high", "CASE WHEN tls_expired OR tls_days IS NULL OR tls_days <= 0 THEN 'na' WHEN tls_days < 14 THEN 'fail' WHEN tls_days < 30 THEN 'warn' ELSE 'pass' END"), "sec.tls.www": ("security", "medium", "CASE WHEN alt_missing OR tls_www IS NULL THEN 'na' WHEN tls_www THEN 'pass' ELSE 'warn' END"),
    "sec.https.variants": ("security", "high", "CASE WHEN hosts < 2 THEN 'na' WHEN host_bad > 0 THEN 'fail' WHEN silent > 0 THEN 'warn' ELSE 'pass' END"), "sec.hsts": ("security", "low", "CASE WHEN hsts IS NOT NULL THEN 'pass' WHEN entry_error IS NOT NULL OR (e_status IS NULL AND coalesce(blocked, false)) THEN 'na' ELSE 'warn' END"),
    "sec.trust-pages": ("security", "medium", "CASE WHEN coalesce(n_ok, 0) = 0 THEN 'na' WHEN priv + terms + cont = 3 THEN 'pass' WHEN priv + terms + cont = 2 THEN 'warn' ELSE 'fail' END"), "sec.headers": ("security", "low", "CASE WHEN headers_known AND entry_error IS NULL THEN 'info' ELSE 'na' END"),
    "arch.generic-anchors": ("architecture", "low", _arch("CASE WHEN links_o = 0 THEN 'na' WHEN generic::double / links_o > 0.15 THEN 'fail' WHEN generic::double / links_o > 0.05 THEN 'warn' ELSE 'pass' END"), "generic_pages"), "arch.orphans": ("architecture", "medium", _arch(_share("orphans", "samples", "0.5", "0.8")), "orphans"),
    "arch.breadcrumbs": ("architecture", "low", _arch("CASE WHEN crumbs > 0 THEN 'pass' ELSE 'info' END")), "arch.nav-consistency": ("architecture", "low", _arch("CASE WHEN linking < 2 THEN 'na' WHEN navs >= 5 THEN 'pass' ELSE 'warn' END")),
    "auth.referring-domains": ("authority", "high", _three("referring_domains", "referring_domains >= 100", "referring_domains >= 20", "authority")), "auth.rank": ("authority", "high", _three("domain_rank", "domain_rank >= 30", "domain_rank >= 10", "authority")), "auth.spam-score": ("authority", "medium", _three("spam_score", "spam_score <= 10", "spam_score <= 30", "authority")),
    "auth.nofollow-share": ("authority", "low", _three("nofollow_share", "nofollow_share <= 0.6", "true", "authority")), "auth.broken": ("authority", "medium", _three("0", "backlinks = 0 OR broken_backlinks::double / backlinks <= 0.05", "true", "authority")), "auth.anchors": ("authority", "medium", _three("0", "backlinks = 0 OR top_anchor_links::double / backlinks <= 0.4", "true", "authority")),
    "auth.trend": ("authority", "medium", _three("gained_domains", "lost_domains <= gained_domains", "true", "authority")), "vis.keywords": ("visibility", "high", _three("n_keywords", "n_keywords >= 500", "n_keywords >= 50", "visibility")), "vis.top10": ("visibility", "high", _three("n_top10", "n_top10 >= 20", "n_top10 >= 3", "visibility")),
    "vis.etv": ("visibility", "medium", _three("etv", "etv >= 1000", "etv >= 100", "visibility")), "vis.quick-wins": ("visibility", "low", "CASE WHEN visibility AND n_quick_wins > 0 THEN 'info' ELSE 'na' END"), "vis.movement": ("visibility", "medium", _three("n_new", "n_lost <= n_new", "true", "visibility")),
    "vis.index-ratio": ("visibility", "medium", _three("index_ratio", "index_ratio >= 0.6", "index_ratio >= 0.3", "visibility")), "vis.brand-share": ("visibility", "low", "CASE WHEN visibility THEN 'info' ELSE 'na' END"), "vis.ai-overview-share": ("visibility", "low", "CASE WHEN visibility AND overview_share IS NOT NULL THEN 'info' ELSE 'na' END"),
    "comp.gap": ("competitors", "medium", "CASE WHEN n_rivals = 0 OR NOT visibility OR rival_etv IS NULL THEN 'na' WHEN rival_etv / greatest(etv, 1) <= 3 THEN 'pass' WHEN rival_etv / greatest(etv, 1) <= 10 THEN 'warn' ELSE 'fail' END"), "comp.list": ("competitors", "low", "CASE WHEN n_rivals > 0 THEN 'info' ELSE 'na' END"),
}
_LEVEL = lambda s: s if s.startswith("CASE") else f"'{s}'"
_ROWS = [f"('{k}', '{d}', {_LEVEL(sev)}, {s}, coalesce({u}, 0), coalesce({a}, 0), true)" for k, (d, sev, s, u, a) in _CHECKS.items()] + [f"('{k}', '{v[0]}', {_LEVEL(v[1])}, {v[2]}, NULL, {f'coalesce({v[3]}, 0)' if len(v) > 3 else '0'}, {str(len(v) > 3).lower()})" for k, v in _SITE.items()]
SITE_SQL = _BASE + f""", w2 AS (SELECT *, CASE WHEN desktop_words > 0 THEN mobile_words::double / desktop_words ELSE 1 END AS r FROM w),
checks AS (SELECT site, c.check_id, c.dimension, c.severity, CASE c.severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS weight, c.check_id IN ('crawl.robots.blocks-site', 'crawl.entry.status', 'crawl.entry.indexable', 'sec.https', 'sec.tls.expired') AS gate,
  c.status, c.universe, c.affected, c.of_pages FROM w2, LATERAL (VALUES {', '.join(_ROWS)}) c(check_id, dimension, severity, status, universe, affected, of_pages))
"""


@query(SITE_SQL + "SELECT site, check_id, dimension, severity, weight, gate, status, universe, affected FROM checks")
def site_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every check of every site."""
    return C.site_checks(crawl(spark, d)).drop("of_pages")


_DIMS = """, dims AS (SELECT site, dimension, count(*) AS n, CASE WHEN count(*) < 3 THEN NULL ELSE least(floor(sum(CASE status WHEN 'pass' THEN weight WHEN 'warn' THEN weight / 2.0 ELSE 0 END) * 100 / sum(weight) + 0.5), CASE WHEN bool_or(gate AND status = 'fail') THEN 30 ELSE 100 END)::bigint END AS score
  FROM checks WHERE status IN ('pass', 'warn', 'fail') GROUP BY 1, 2)
"""


@query(SITE_SQL + _DIMS + "SELECT * FROM dims")
def site_dimension_scores(spark: SparkSession, d: str) -> DataFrame:
    return C.site_dimensions(C.site_checks(crawl(spark, d)))


_GRADE = "CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"


@query(SITE_SQL + _DIMS + f""", shut AS (SELECT DISTINCT site FROM checks WHERE gate AND status = 'fail'),
o AS (SELECT site, floor(sum(score * wt) / sum(wt) + 0.5)::bigint AS score FROM dims JOIN (VALUES ('crawlability', 25), ('onpage', 20), ('performance', 15), ('mobile', 10), ('structured', 10), ('security', 10), ('architecture', 10)) x(dimension, wt) USING (dimension) WHERE score IS NOT NULL GROUP BY 1)
SELECT site, CASE WHEN site IN (SELECT site FROM shut) THEN least(score, 40) ELSE score END AS score, CASE WHEN site IN (SELECT site FROM shut) THEN 'F' ELSE {_GRADE} END AS grade FROM o""")
def site_technical_score(spark: SparkSession, d: str) -> DataFrame:
    return C.technical_score(C.site_checks(crawl(spark, d)))


@query(SITE_SQL + "SELECT site, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'warn') AS n_warn, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status IN ('na', 'info')) AS n_unmeasured FROM checks GROUP BY 1")
def site_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.issue_counts(C.site_checks(crawl(spark, d)))


@query(SITE_SQL + """SELECT site, place, check_id FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN gate AND status = 'fail' THEN 0 ELSE 1 END, CASE status WHEN 'fail' THEN 0 ELSE 1 END, weight DESC, affected DESC, check_id) AS place
  FROM checks WHERE status IN ('warn', 'fail') AND dimension NOT IN ('authority', 'visibility', 'competitors')) WHERE place <= 3""")
def site_top_issues(spark: SparkSession, d: str) -> DataFrame:
    return C.top_issues(C.site_checks(crawl(spark, d)))


_SLOW = "('" + "', '".join(C.MORE_EFFORT) + "')"


@query(SITE_SQL + f""", x AS (SELECT c.site, check_id, gate AND status = 'fail' AS shut, CASE WHEN of_pages THEN affected ELSE greatest(coalesce(n_pages, 1), 1) END AS pages_affected, weight FROM checks c JOIN w USING (site) WHERE status IN ('warn', 'fail')),
y AS (SELECT *, floor(weight * (1 + log2(1 + pages_affected)) * 10 + 0.5) / 10 AS impact FROM x)
SELECT site, check_id, CASE WHEN shut OR (impact >= 6 AND check_id NOT IN {_SLOW}) THEN 'this_week' WHEN impact >= 4 THEN 'this_month' ELSE 'later' END AS bucket, impact, pages_affected FROM y""")
def site_roadmap(spark: SparkSession, d: str) -> DataFrame:
    c = crawl(spark, d)
    return C.roadmap(C.site_checks(c), c.pages.groupBy("site").agg(F.count("*").alias("n_pages")))
