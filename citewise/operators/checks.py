"""The audit of sites: 107 checks over crawled pages, probes and provider facts, dimension scores, issues and a roadmap."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewise.functions import text as X
from citewise.functions.exprs import check_key, jaccard, round_up_half
from citewise.operators.structure import dimension_scores, overall_score

# Weights of severities and dimensions.
SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}
DIMENSIONS = {"crawlability": 25.0, "onpage": 20.0, "performance": 15.0, "mobile": 10.0, "structured": 10.0, "security": 10.0, "architecture": 10.0}
PAID = ("authority", "visibility", "competitors")

#: Columns that each input table may lack; they are then null, and what needs them isn't measured.
PAGE_COLUMNS = (
    "url string, final_url string, status int, content_type string, redirects int, depth int, title string, description string, h1s array<string>, headings array<struct<level:int,text:string>>, n_words int, "
    "n_links int, n_unique_links int, n_nofollow int, n_generic int, n_images int, n_missing_alt int, n_missing_dims int, types array<string>, n_ld_errors int, has_breadcrumb boolean, n_mixed int, "
    "hreflang array<struct<lang:string,href:string>>, canonical string, lang string, viewport string, og map<string,string>, twitter map<string,string>, has_favicon boolean, noindex boolean, meta_refresh boolean, "
    "last_modified date, js_shell boolean, page_type string, ttfb_ms double, links array<string>, is_entry boolean, near_duplicate boolean"
)
SITE_COLUMNS = (
    "entry_url string, host string, blocked boolean, blocked_kind string, entry_error string, js_dependent boolean, robots_status int, robots_found boolean, robots_bytes long, robots_is_html boolean, robots_all boolean, "
    "robots_entry boolean, googlebot_all boolean, n_blocked_resources int, has_sitemap_line boolean, ai_rules int, alt_missing boolean, soft404_status int, soft404_like boolean, links_tested boolean, tls_days int, tls_known boolean, "
    "tls_www boolean, tls_expired boolean, tls_failed boolean, hsts string, headers_known boolean, og_image_status int, og_image_type string, psi_ok boolean, field_lcp double, field_inp double, field_cls double, field_ttfb double, "
    "lab_lcp double, lab_tbt double, lab_cls double, lab_ttfb double, score_performance double, score_accessibility double, audits map<string,double>, ttfb_p90 double, mobile_words int, desktop_words int, mobile_h1 boolean, "
    "desktop_h1 boolean, mobile_ld int, desktop_ld int, n_large_images int, authority boolean, referring_domains long, domain_rank double, spam_score double, nofollow_share double, backlinks long, broken_backlinks long, "
    "top_anchor_links long, gained_domains long, lost_domains long, visibility boolean, n_keywords long, n_top10 long, etv double, n_quick_wins int, n_new long, n_lost long, index_ratio double, brand_keywords long, "
    "other_keywords long, overview_share double, rival_etv double, n_rivals int"
)
VARIANT_COLUMNS = "url string, kind string, status int, first_hop int, n_hops int, final_url string, canonical string, meta_refresh boolean"
SITEMAP_COLUMNS = "url string, status int, valid boolean, is_index boolean, n_urls long, lastmod_share double, newest date"
SAMPLE_COLUMNS = "url string, status int, noindex boolean, same_host boolean, canonical string"
BROKEN_COLUMNS = "from_url string, to_url string"
TARGET_COLUMNS = "url string, status int, noindex boolean"


@dataclass
class Crawl:
    """The tables of an audit, each with the column site. Missing tables and columns count as not measured.

    pages: one row a crawled page; sites: one row a site; variants: other spellings of the entry's address and where they
    lead; sitemaps: files fetched; samples: sitemap entries visited; broken: dead internal links; targets: canonical
    targets visited. today: what ages are counted to.
    """

    pages: DataFrame
    sites: DataFrame
    today: Column
    variants: DataFrame | None = None
    sitemaps: DataFrame | None = None
    samples: DataFrame | None = None
    broken: DataFrame | None = None
    targets: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def completed(df: DataFrame | None, columns: str, like: DataFrame) -> DataFrame:
    """site and the columns of df in their types; what it lacks is null; no rows without df. Other columns are left out."""
    kinds = [c.strip().split(" ", 1) for c in _columns(columns)]
    if df is None:
        df = like.select("site").limit(0)
    return df.select("site", *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds))


def _columns(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in ddl:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def _utf16(text: Column) -> Column:
    """The length of a text in UTF-16 units, as titles are measured."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


# Words that no overlap of titles, headings and slugs counts.
OVERLAP_STOP = tuple("the a an and or of to for in on with your our is at by from vs how what why best guide free online com www http https".split())


def overlap_tokens(text: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits of two and more, without stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*OVERLAP_STOP)))


def slug_tokens(url: Column) -> Column:
    """overlap_tokens of an address's last part."""
    parts = X.segments(X.path_of(url))
    last = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))
    return overlap_tokens(F.regexp_replace(F.regexp_replace(last, r"(?i)\.[a-z0-9]{2,5}$", ""), "[-_]+", " "))


def _shared(pages: DataFrame, value: str, out: str) -> DataFrame:
    """pages with out: how many readable pages of the site have the same value in any case. Values are counted by a grouping and joined back."""
    key = F.when(F.col("ok"), F.lower(X.collapsed(F.col(value))))
    keyed = pages.withColumn("__k", key)
    counts = keyed.where("__k <> ''").groupBy("site", "__k").agg(F.count("*").alias(out))
    return keyed.join(counts, ["site", "__k"], "left").drop("__k")


def judged_pages(crawl: Crawl) -> DataFrame:
    """The pages with all that the checks ask of one page."""
    p = completed(crawl.pages, PAGE_COLUMNS, crawl.pages)
    types = F.transform(F.coalesce("types", F.array().cast("array<string>")), lambda t: F.lower(t))
    ok = (F.col("status") == 200) & (F.coalesce("content_type", F.lit("")).rlike("(?i)html") | (F.coalesce("content_type", F.lit("")) == ""))
    p = p.withColumns({"types": types, "ok": F.coalesce(ok, F.lit(False)), "title": X.collapsed(F.col("title")), "description": X.collapsed(F.col("description")), "n_words": F.coalesce("n_words", F.lit(0)), "h1s": F.coalesce("h1s", F.array().cast("array<string>"))})
    p = p.withColumn("final_url", F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url")))
    body = F.col("ok") & ~F.coalesce("js_shell", F.lit(False))
    n_h2 = F.size(F.filter(F.coalesce("headings", F.array().cast("array<struct<level:int,text:string>>")), lambda h: h["level"] == 2))
    kind = F.coalesce("page_type", X.page_type(F.col("url"), F.col("types"), F.col("n_words"), F.size("h1s"), n_h2))
    title, slug = overlap_tokens(F.col("title")), slug_tokens(F.col("url"))
    both = lambda a, b: F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(jaccard(a, b))
    overlap = F.greatest(both(title, overlap_tokens(F.get("h1s", F.lit(0)))), F.when(F.size(slug) > 0, both(title, slug)).otherwise(0.0))
    skip = F.expr("exists(sequence(0, size(headings) - 1), i -> get(headings, i).level > coalesce(get(headings, i - 1).level, 1) + 1)")
    params = F.size(F.filter(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda x: x != ""))
    hygiene = X.path_of(F.col("url")).rlike("[A-Z_]") | (F.length("url") > 100) | (params >= 3)
    own = check_key(F.col("final_url"))
    absolute = F.col("canonical").rlike("(?i)^https?://")
    langs = F.coalesce("hreflang", F.array().cast("array<struct<lang:string,href:string>>"))
    named = F.forall(langs, lambda h: h["href"].rlike("(?i)^https?://"))
    answered = F.exists(langs, lambda h: F.lower(h["lang"]) == "x-default") | F.exists(langs, lambda h: check_key(h["href"]) == own)
    p = p.withColumns({
        "body": body, "kind": kind, "overlap": overlap, "skips_level": F.coalesce(F.when(F.size("headings") > 0, skip), F.lit(False)), "bad_url": F.coalesce(hygiene, F.lit(False)), "own_key": own,
        "canonical_key": check_key(F.col("canonical")), "canonical_bad": F.coalesce(~absolute | (F.col("canonical").rlike("(?i)^http://") & F.col("final_url").rlike("(?i)^https://")), F.lit(False)),
        "has_hreflang": F.size(langs) > 0, "bad_hreflang": ~(named & answered), "tool": X.is_tool_path(F.col("url")), "n_segments": F.size(X.segments(X.path_of(F.col("url")))), "noindex": F.coalesce("noindex", F.lit(False)),
        "moved": (F.coalesce("redirects", F.lit(0)) > 0) | (own != check_key(F.col("url"))), "n_link": F.coalesce("n_unique_links", "n_links", F.lit(0)),
    })
    targets = completed(crawl.targets, TARGET_COLUMNS, crawl.pages).select("site", check_key(F.col("url")).alias("canonical_key"), (F.col("status").isNull() | (F.col("status") >= 300) | F.coalesce("noindex", F.lit(False))).alias("dead"))
    targets = targets.groupBy("site", "canonical_key").agg(F.max("dead").alias("target_dead"))
    p = p.join(targets, ["site", "canonical_key"], "left")
    wrong = F.col("canonical_bad") | ((F.col("canonical_key") != F.col("own_key")) & F.coalesce("target_dead", F.lit(False)))
    p = p.withColumn("canonical_wrong", F.coalesce("canonical", F.lit("")).rlike(".") & wrong)
    return _shared(_shared(p, "title", "n_same_title"), "description", "n_same_description")


#: Checks by the share of affected pages: dimension, severity, pages judged, pages at fault, shares up to which pass and warn are given.
PAGE_CHECKS: dict[str, tuple[str, str, str, str, float, float]] = {
    "onpage.title.present": ("onpage", "high", "ok", "title = ''", 0, 0.2),
    "onpage.title.length": ("onpage", "low", "ok and title <> ''", "title_units not between 20 and 60", 0, 0.2),
    "onpage.title.unique": ("onpage", "medium", "ok and title <> ''", "n_same_title > 1", 0, 0.2),
    "onpage.title.h1-slug-overlap": ("onpage", "low", "body and title <> '' and size(h1s) > 0 and kind <> 'home'", "overlap < 0.2", 0, 0.2),
    "onpage.description.present": ("onpage", "medium", "ok", "description = ''", 0, 0.2),
    "onpage.description.length": ("onpage", "low", "ok and description <> ''", "description_units > 160", 0, 0.2),
    "onpage.description.unique": ("onpage", "low", "ok and description <> ''", "n_same_description > 1", 0, 0.2),
    "onpage.h1.missing": ("onpage", "medium", "body", "size(h1s) = 0", 0, 0.2),
    "onpage.h1.multiple": ("onpage", "low", "body", "size(h1s) > 1", 0, 0.2),
    "onpage.headings.order": ("onpage", "low", "body and size(headings) > 0", "skips_level", 0, 0.2),
    "onpage.near-duplicate": ("onpage", "medium", "body and near_duplicate is not null", "near_duplicate", 0, 0.2),
    "onpage.url.hygiene": ("onpage", "low", "ok", "bad_url", 0, 0.2),
    "crawl.pages.noindex": ("crawlability", "high", "ok and not tool", "noindex", 0, 0.2),
    "crawl.canonical.pages": ("crawlability", "medium", "ok", "canonical is null or canonical = '' or canonical_wrong", 0, 0.2),
    "crawl.pages.errors": ("crawlability", "high", "true", "status is null or status = 0 or status >= 400", 0, 0.2),
    "crawl.links.to-redirects": ("crawlability", "low", "true", "moved", 0, 0.1),
    "crawl.hreflang": ("crawlability", "medium", "ok and has_hreflang", "bad_hreflang", 0, 1),
    "sec.mixed-content": ("security", "medium", "ok", "n_mixed > 0", 0, 0.2),
    "arch.depth": ("architecture", "medium", "ok", "depth > 3", 0, 0.2),
    "arch.internal-links.min": ("architecture", "medium", "ok", "n_link < 3", 0, 0.2),
    "arch.internal-links.bloat": ("architecture", "low", "ok", "n_link > 150", 0, 0.2),
    "arch.url-depth": ("architecture", "low", "ok", "n_segments > 3", 0.1, 1),
    "schema.article": ("structured", "high", "ok and kind = 'article'", "not exists(types, t -> t rlike '^(article|blogposting|newsarticle|techarticle|scholarlyarticle|report)$')", 0, 0.2),
    "schema.product": ("structured", "high", "ok and kind = 'product'", "not exists(types, t -> t rlike 'product$')", 0, 0.2),
}
#: Sums over a site's pages that the other checks ask for.
PAGE_SUMS: dict[str, str] = {
    "n_pages": "count(*)", "n_ok": "count_if(ok)", "n_body": "count_if(body)", "n_noindex": "count_if(ok and noindex)", "n_wrong_canonical": "count_if(ok and canonical_wrong)", "n_refresh": "count_if(ok and meta_refresh)",
    "alt_images": "sum(if(body, n_images, 0))", "alt_missing_images": "sum(if(body, n_missing_alt, 0))", "alt_pages": "count_if(body and n_missing_alt > 0)",
    "n_articles": "count_if(body and kind = 'article')", "n_thin": "count_if(body and kind = 'article' and n_words < 200)", "n_other_thin": "count_if(body and kind not in ('article', 'legal', 'contact') and n_words < 200)",
    "follow_links": "sum(if(body and n_nofollow is not null, coalesce(n_links, 0), 0))", "nofollow_links": "sum(if(body, coalesce(n_nofollow, 0), 0))", "n_follow_pages": "count_if(body and n_nofollow is not null)", "nofollow_pages": "count_if(body and n_nofollow > 0)",
    "dated_pages": "count_if(ok and last_modified is not null)", "stale_pages": "count_if(ok and last_modified < __today - interval 365 days)",
    "dims_pages": "count_if(ok and n_missing_dims is not null)", "dims_images": "sum(if(ok and n_missing_dims is not null, coalesce(n_images, 0), 0))", "dims_missing": "sum(if(ok, coalesce(n_missing_dims, 0), 0))", "dims_bad_pages": "count_if(ok and n_missing_dims > 0)",
    "ld_error_pages": "count_if(ok and n_ld_errors > 0)", "ld_pages": "count_if(ok and size(types) > 0)", "breadcrumb_pages": "count_if(ok and (has_breadcrumb or exists(types, t -> t = 'breadcrumblist')))",
    "retired_pages": "count_if(ok and exists(types, t -> t in ('faqpage', 'howto')))", "all_links": "sum(if(ok, coalesce(n_links, 0), 0))", "generic_links": "sum(if(ok, coalesce(n_generic, 0), 0))", "generic_pages": "count_if(ok and n_generic > 0)",
    "has_privacy": "max(ok and exists(seen, u -> u rlike 'privacy|datenschutz|gdpr'))", "has_terms": r"max(ok and exists(seen, u -> u rlike 'terms|tos\\b|legal|conditions|agb'))", "has_contact": "max(ok and exists(seen, u -> u rlike 'contact|about|impressum|imprint|support'))",
    "ttfb_pages": "count(ttfb_ms)",
}
ORGANISATION_TYPE = "^(organization|localbusiness|corporation|onlinebusiness|onlinestore|store|restaurant|medicalbusiness|professionalservice|.*organization)$"

_SHARE = "CASE WHEN {n} = 0 OR {n} IS NULL THEN 'na' WHEN {x} <= {n} * {a} + 1e-9 THEN 'pass' WHEN {x} <= {n} * {b} + 1e-9 THEN 'warn' ELSE 'fail' END"
_AUDIT = "CASE WHEN NOT coalesce(psi_ok, false) OR {s} IS NULL THEN 'na' WHEN {s} >= 0.9 THEN 'pass' WHEN {s} >= 0.5 THEN 'warn' ELSE 'fail' END"


def _vital(field_: str, lab: str, good: float, poor: float, lab_poor: float | None = None) -> str:
    """The field's value decides; a lab's value, of one run, is a warning at worst."""
    lab_good = {"lab_tbt": 200}.get(lab, good)
    return f"CASE WHEN NOT coalesce(psi_ok, false) THEN 'na' WHEN {field_} <= {good} THEN 'pass' WHEN {field_} <= {poor} THEN 'warn' WHEN {field_} IS NOT NULL THEN 'fail' WHEN {lab} <= {lab_good} THEN 'pass' WHEN {lab} IS NOT NULL THEN 'warn' ELSE 'na' END"


_LOW = "least(coalesce(audits['modern-image-formats'], 2), coalesce(audits['uses-optimized-images'], 2), coalesce(audits['uses-responsive-images'], 2))"
_arch = lambda s: f"CASE WHEN n_pages < 5 OR n_ok = 0 OR n_pages IS NULL THEN 'na' ELSE ({s}) END"
_audit = lambda name, severity="low", dim="performance": (dim, severity, _AUDIT.format(s=f"audits['{name}']"))
_no_entry = lambda s: f"CASE WHEN e IS NULL THEN 'na' ELSE ({s}) END"

#: Checks of a site: dimension, severity, status.
SITE_CHECKS: dict[str, tuple[str, str, str]] = {
    "crawl.blocked": ("crawlability", "critical", "CASE WHEN entry_error = 'tls' OR blocked_kind = 'tls' OR blocked IS NULL THEN 'na' WHEN blocked THEN 'fail' WHEN entry_error IS NOT NULL THEN 'na' ELSE 'pass' END"),
    "crawl.js-dependent": ("crawlability", "high", "CASE WHEN coalesce(blocked, false) OR coalesce(js_dependent, e.js_shell) IS NULL THEN 'na' WHEN coalesce(js_dependent, e.js_shell) THEN 'warn' ELSE 'pass' END"),
    "crawl.robots.exists": ("crawlability", "low", "CASE WHEN robots_status IS NULL OR robots_status >= 500 THEN 'fail' WHEN robots_status = 404 THEN 'warn' WHEN robots_status = 200 AND robots_is_html THEN 'fail' WHEN robots_status = 200 AND robots_bytes > 512000 THEN 'warn' WHEN robots_status = 200 THEN 'pass' ELSE 'warn' END"),
    "crawl.robots.blocks-site": ("crawlability", "critical", "CASE WHEN NOT coalesce(robots_found, false) THEN 'pass' WHEN googlebot_all THEN 'fail' WHEN robots_all THEN CASE WHEN NOT googlebot_all THEN 'info' ELSE 'fail' END WHEN robots_entry THEN 'fail' ELSE 'pass' END"),
    "crawl.robots.resources": ("crawlability", "high", "CASE WHEN n_blocked_resources IS NULL THEN 'na' WHEN n_blocked_resources = 0 THEN 'pass' ELSE 'fail' END"),
    "crawl.robots.sitemap-directive": ("crawlability", "low", "CASE WHEN coalesce(robots_found, false) AND has_sitemap_line THEN 'pass' ELSE 'warn' END"),
    "crawl.robots.ai-crawlers": ("crawlability", "low", "CASE WHEN ai_rules IS NULL THEN 'na' ELSE 'info' END"),
    "crawl.sitemap.found": ("crawlability", "high", "CASE WHEN maps_usable > 0 THEN 'pass' ELSE 'fail' END"),
    "crawl.sitemap.valid": ("crawlability", "medium", "CASE WHEN coalesce(maps_fetched, 0) = 0 THEN 'na' WHEN maps_huge > 0 OR maps_invalid = maps_fetched THEN 'fail' WHEN maps_invalid > 0 THEN 'warn' ELSE 'pass' END"),
    "crawl.sitemap.sample": ("crawlability", "high", _SHARE.format(n="samples", x="samples_bad", a=0, b=0.2)),
    "crawl.sitemap.lastmod": ("crawlability", "low", "CASE WHEN coalesce(leaf_urls, 0) = 0 THEN 'na' WHEN leaf_dated / leaf_urls >= 0.8 THEN 'pass' WHEN leaf_dated / leaf_urls >= 0.3 THEN 'warn' ELSE 'fail' END"),
    "crawl.freshness": ("crawlability", "low", "CASE WHEN dated_pages > 0 THEN CASE WHEN stale_pages / dated_pages > 0.5 THEN 'warn' ELSE 'pass' END WHEN maps_newest IS NULL THEN 'na' WHEN maps_newest < __today - interval 365 days THEN 'warn' ELSE 'pass' END"),
    "crawl.entry.status": ("crawlability", "critical", "CASE WHEN entry IS NULL THEN 'na' WHEN entry.status = 200 AND coalesce(entry.redirects, 0) = 0 THEN 'pass' WHEN entry.status = 200 THEN 'warn' ELSE 'fail' END"),
    "crawl.entry.indexable": ("crawlability", "critical", _no_entry("CASE WHEN e.noindex THEN 'fail' ELSE 'pass' END")),
    "crawl.noindex-robots-conflict": ("crawlability", "high", "CASE WHEN coalesce(n_ok, 0) = 0 THEN 'na' WHEN n_noindex = 0 THEN 'pass' WHEN coalesce(robots_all, false) OR coalesce(googlebot_all, false) OR coalesce(entry.noindex AND robots_entry, false) THEN 'fail' ELSE 'pass' END"),
    "crawl.canonical.entry": ("crawlability", "medium", _no_entry("CASE WHEN coalesce(e.canonical, '') = '' THEN 'warn' WHEN e.canonical_bad THEN 'fail' WHEN e.canonical_key = e.own_key THEN 'pass' WHEN e.target_dead THEN 'fail' ELSE 'warn' END")),
    "crawl.https.redirect": ("crawlability", "high", "CASE WHEN coalesce(http_variants, 0) = 0 THEN 'na' WHEN http_fail > 0 THEN 'fail' WHEN http_warn > 0 THEN 'warn' ELSE 'pass' END"),
    "crawl.host.canonical": ("crawlability", "medium", "CASE WHEN coalesce(alt_missing, false) OR www IS NULL OR apex IS NULL OR (www.status IS NULL AND apex.status IS NULL) THEN 'na' WHEN www.status = 200 AND apex.status = 200 THEN CASE WHEN www.canonical_key = apex.canonical_key THEN 'warn' ELSE 'fail' END WHEN coalesce(www.status = 200, false) OR coalesce(apex.status = 200, false) THEN 'pass' ELSE 'warn' END"),
    "crawl.url-variants": ("crawlability", "medium", "CASE WHEN coalesce(spelled, 0) = 0 THEN 'na' WHEN spelled_bad > 0 THEN 'warn' ELSE 'pass' END"),
    "crawl.redirect.chains": ("crawlability", "medium", "CASE WHEN coalesce(n_variants, 0) = 0 THEN 'na' WHEN variant_refresh > 0 OR n_refresh > 0 THEN 'fail' WHEN longest_chain <= 1 THEN 'pass' WHEN longest_chain = 2 THEN 'warn' ELSE 'fail' END"),
    "crawl.soft404": ("crawlability", "medium", "CASE WHEN soft404_status IS NULL THEN 'na' WHEN soft404_status IN (404, 410) THEN 'pass' WHEN soft404_status = 200 AND soft404_like THEN 'warn' WHEN soft404_status = 200 THEN 'info' WHEN soft404_status BETWEEN 300 AND 399 THEN 'warn' ELSE 'pass' END"),
    "crawl.links.broken": ("crawlability", "high", "CASE WHEN NOT coalesce(links_tested, false) THEN 'na' ELSE " + _SHARE.format(n="if(n_ok > 0, n_ok, n_pages)", x="coalesce(broken_pages, 0)", a=0, b=0.2) + " END"),
    "onpage.images.alt": ("onpage", "medium", _SHARE.format(n="alt_images", x="alt_missing_images", a=0.1, b=0.3)),
    "onpage.thin": ("onpage", "medium", "CASE WHEN coalesce(n_body, 0) = 0 THEN 'na' WHEN n_articles = 0 THEN CASE WHEN n_other_thin > 0 THEN 'info' ELSE 'pass' END ELSE " + _SHARE.format(n="n_articles", x="n_thin", a=0, b=0.2) + " END"),
    "onpage.lang": ("onpage", "low", _no_entry("CASE WHEN coalesce(e.lang, '') <> '' THEN 'pass' ELSE 'warn' END")),
    "onpage.robots-nofollow": ("onpage", "low", "CASE WHEN coalesce(n_follow_pages, 0) = 0 THEN 'na' WHEN nofollow_links > 0.1 * follow_links AND follow_links > 0 THEN 'warn' ELSE 'pass' END"),
    "perf.cwv.lcp": ("performance", "high", _vital("field_lcp", "lab_lcp", 2500, 4000)),
    "perf.cwv.inp": ("performance", "high", _vital("field_inp", "lab_tbt", 200, 500)),
    "perf.cwv.cls": ("performance", "medium", _vital("field_cls", "lab_cls", 0.1, 0.25)),
    "perf.cwv.ttfb": ("performance", "medium", _vital("field_ttfb", "lab_ttfb", 800, 1800)),
    "perf.lighthouse-score": ("performance", "low", "CASE WHEN NOT coalesce(psi_ok, false) OR score_performance IS NULL THEN 'na' ELSE 'info' END"),
    "perf.crawl-ttfb": ("performance", "medium", "CASE WHEN coalesce(ttfb_p90, pages_p90) IS NULL THEN 'na' WHEN coalesce(ttfb_p90, pages_p90) > 2500 THEN 'fail' WHEN coalesce(ttfb_p90, pages_p90) > 1200 THEN 'warn' ELSE 'pass' END"),
    "perf.lcp-element": ("performance", "medium", "CASE WHEN NOT coalesce(psi_ok, false) OR NOT exists(array('lcp-lazy-loaded', 'prioritize-lcp-image', 'unsized-images', 'largest-contentful-paint-element'), a -> map_contains_key(audits, a)) THEN 'na' WHEN exists(array('lcp-lazy-loaded', 'prioritize-lcp-image', 'unsized-images', 'largest-contentful-paint-element'), a -> coalesce(audits[a] < 0.5, false)) THEN 'warn' ELSE 'pass' END"),
    "perf.weight": _audit("total-byte-weight"), "perf.render-blocking": _audit("render-blocking-resources"), "perf.compression": _audit("uses-text-compression"),
    "perf.cache": _audit("uses-long-cache-ttl"), "perf.images": ("performance", "low", _AUDIT.format(s=f"nullif({_LOW}, 2)")), "perf.unused-js": _audit("unused-javascript"),
    "mobile.viewport": ("mobile", "critical", _no_entry("CASE WHEN coalesce(e.viewport, '') = '' THEN 'fail' WHEN NOT e.viewport RLIKE '(?i)width\\\\s*=\\\\s*device-width' THEN 'warn' ELSE 'pass' END")),
    "mobile.font-size": _audit("font-size", "medium", "mobile"), "mobile.tap-targets": _audit("tap-targets", "medium", "mobile"),
    "mobile.parity": ("mobile", "high", "CASE WHEN mobile_words IS NULL OR desktop_words IS NULL THEN 'na' WHEN desktop_words > 0 AND mobile_words / desktop_words < 0.5 THEN 'fail' WHEN (desktop_words > 0 AND mobile_words / desktop_words < 0.8) OR coalesce(desktop_h1 AND NOT mobile_h1, false) OR coalesce(desktop_ld > 0 AND mobile_ld = 0, false) THEN 'warn' ELSE 'pass' END"),
    "mobile.images.dims": ("mobile", "low", "CASE WHEN coalesce(dims_pages, 0) = 0 THEN 'na' ELSE " + _SHARE.format(n="dims_images", x="dims_missing", a=0, b=0.2) + " END"),
    "mobile.images.large": ("mobile", "low", "CASE WHEN n_large_images IS NULL THEN 'na' WHEN n_large_images = 0 THEN 'pass' WHEN n_large_images <= 3 THEN 'warn' ELSE 'fail' END"),
    "mobile.accessibility": ("mobile", "low", "CASE WHEN NOT coalesce(psi_ok, false) OR score_accessibility IS NULL THEN 'na' ELSE 'info' END"),
    "schema.jsonld.valid": ("structured", "high", "CASE WHEN coalesce(n_ok, 0) = 0 THEN 'na' WHEN ld_error_pages > 0 THEN 'fail' WHEN ld_pages = 0 THEN 'warn' ELSE 'pass' END"),
    "schema.organization": ("structured", "medium", _no_entry(f"CASE WHEN exists(e.types, t -> t RLIKE '{ORGANISATION_TYPE}') THEN 'pass' ELSE 'warn' END")),
    "schema.website": ("structured", "low", _no_entry("CASE WHEN array_contains(e.types, 'website') THEN 'pass' ELSE 'warn' END")),
    "schema.breadcrumb": ("structured", "low", "CASE WHEN coalesce(n_ok, 0) = 0 THEN 'na' WHEN breadcrumb_pages > 0 THEN 'pass' ELSE 'info' END"),
    "schema.deprecated": ("structured", "low", "CASE WHEN coalesce(n_ok, 0) = 0 THEN 'na' ELSE 'info' END"),
    "schema.og": ("structured", "low", _no_entry("CASE WHEN n_og = 3 THEN CASE WHEN og_image_seen AND (coalesce(og_image_status, 0) <> 200 OR NOT coalesce(og_image_type, 'image/') RLIKE '(?i)^image/') THEN 'warn' ELSE 'pass' END WHEN n_og > 0 THEN 'warn' ELSE 'fail' END")),
    "schema.twitter": ("structured", "low", _no_entry("CASE WHEN coalesce(e.twitter['card'], e.twitter['twitter:card'], '') <> '' THEN 'pass' ELSE 'warn' END")),
    "schema.favicon": ("structured", "low", _no_entry("CASE WHEN e.has_favicon THEN 'pass' ELSE 'warn' END")),
    "sec.https": ("security", "critical", "CASE WHEN coalesce(tls_failed, false) THEN 'fail' WHEN coalesce(entry.final_url RLIKE '(?i)^https://' AND entry.status > 0 AND entry.status < 500, false) OR coalesce(https_up, 0) > 0 THEN 'pass' WHEN entry IS NULL AND coalesce(blocked, false) THEN 'na' ELSE 'fail' END"),
    "sec.tls.expired": ("security", "critical", "CASE WHEN tls_days <= 0 OR (coalesce(tls_failed, false) AND coalesce(tls_expired, false)) THEN 'fail' WHEN NOT coalesce(tls_known, false) OR tls_days IS NULL THEN 'na' ELSE 'pass' END"),
    "sec.tls.expiring": ("security", "high", "CASE WHEN coalesce(tls_expired, false) OR tls_days <= 0 OR tls_days IS NULL THEN 'na' WHEN tls_days < 14 THEN 'fail' WHEN tls_days < 30 THEN 'warn' ELSE 'pass' END"),
    "sec.tls.www": ("security", "medium", "CASE WHEN coalesce(alt_missing, false) OR tls_www IS NULL THEN 'na' WHEN tls_www THEN 'pass' ELSE 'warn' END"),
    "sec.https.variants": ("security", "high", "CASE WHEN coalesce(host_variants, 0) < 2 THEN 'na' WHEN host_bad > 0 THEN 'fail' WHEN host_silent > 0 THEN 'warn' ELSE 'pass' END"),
    "sec.hsts": ("security", "low", "CASE WHEN coalesce(hsts, '') <> '' THEN 'pass' WHEN entry_error IS NOT NULL OR coalesce(entry.status, if(coalesce(blocked, false), 0, 1)) = 0 THEN 'na' ELSE 'warn' END"),
    "sec.trust-pages": ("security", "medium", "CASE WHEN coalesce(n_ok, 0) = 0 THEN 'na' WHEN int(has_privacy) + int(has_terms) + int(has_contact) = 3 THEN 'pass' WHEN int(has_privacy) + int(has_terms) + int(has_contact) = 2 THEN 'warn' ELSE 'fail' END"),
    "sec.headers": ("security", "low", "CASE WHEN NOT coalesce(headers_known, false) OR entry_error IS NOT NULL THEN 'na' ELSE 'info' END"),
    "arch.generic-anchors": ("architecture", "low", _arch("CASE WHEN coalesce(all_links, 0) = 0 THEN 'na' WHEN generic_links > 0.15 * all_links THEN 'fail' WHEN generic_links > 0.05 * all_links THEN 'warn' ELSE 'pass' END")),
    "arch.orphans": ("architecture", "medium", _arch(_SHARE.format(n="samples", x="orphans", a=0.5, b=0.8))),
    "arch.breadcrumbs": ("architecture", "low", _arch("CASE WHEN breadcrumb_pages > 0 THEN 'pass' ELSE 'info' END")),
    "arch.nav-consistency": ("architecture", "low", _arch("CASE WHEN coalesce(linking_pages, 0) < 2 THEN 'na' WHEN shared_links >= 5 THEN 'pass' ELSE 'warn' END")),
    "auth.referring-domains": ("authority", "high", "CASE WHEN NOT coalesce(authority, false) OR referring_domains IS NULL THEN 'na' WHEN referring_domains >= 100 THEN 'pass' WHEN referring_domains >= 20 THEN 'warn' ELSE 'fail' END"),
    "auth.rank": ("authority", "high", "CASE WHEN NOT coalesce(authority, false) OR domain_rank IS NULL THEN 'na' WHEN domain_rank >= 30 THEN 'pass' WHEN domain_rank >= 10 THEN 'warn' ELSE 'fail' END"),
    "auth.spam-score": ("authority", "medium", "CASE WHEN NOT coalesce(authority, false) OR spam_score IS NULL THEN 'na' WHEN spam_score <= 10 THEN 'pass' WHEN spam_score <= 30 THEN 'warn' ELSE 'fail' END"),
    "auth.nofollow-share": ("authority", "low", "CASE WHEN NOT coalesce(authority, false) OR nofollow_share IS NULL THEN 'na' WHEN nofollow_share <= 0.6 THEN 'pass' ELSE 'warn' END"),
    "auth.broken": ("authority", "medium", "CASE WHEN NOT coalesce(authority, false) THEN 'na' WHEN coalesce(broken_backlinks, 0) <= 0.05 * coalesce(backlinks, 0) OR coalesce(backlinks, 0) = 0 THEN 'pass' ELSE 'warn' END"),
    "auth.anchors": ("authority", "medium", "CASE WHEN NOT coalesce(authority, false) THEN 'na' WHEN coalesce(top_anchor_links, 0) <= 0.4 * coalesce(backlinks, 0) OR coalesce(backlinks, 0) = 0 THEN 'pass' ELSE 'warn' END"),
    "auth.trend": ("authority", "medium", "CASE WHEN NOT coalesce(authority, false) OR gained_domains IS NULL OR lost_domains IS NULL THEN 'na' WHEN lost_domains > gained_domains THEN 'warn' ELSE 'pass' END"),
    "vis.keywords": ("visibility", "high", "CASE WHEN NOT coalesce(visibility, false) OR n_keywords IS NULL THEN 'na' WHEN n_keywords >= 500 THEN 'pass' WHEN n_keywords >= 50 THEN 'warn' ELSE 'fail' END"),
    "vis.top10": ("visibility", "high", "CASE WHEN NOT coalesce(visibility, false) OR n_top10 IS NULL THEN 'na' WHEN n_top10 >= 20 THEN 'pass' WHEN n_top10 >= 3 THEN 'warn' ELSE 'fail' END"),
    "vis.etv": ("visibility", "medium", "CASE WHEN NOT coalesce(visibility, false) OR etv IS NULL THEN 'na' WHEN etv >= 1000 THEN 'pass' WHEN etv >= 100 THEN 'warn' ELSE 'fail' END"),
    "vis.quick-wins": ("visibility", "low", "CASE WHEN coalesce(visibility, false) AND n_quick_wins > 0 THEN 'info' ELSE 'na' END"),
    "vis.movement": ("visibility", "medium", "CASE WHEN NOT coalesce(visibility, false) OR n_new IS NULL OR n_lost IS NULL THEN 'na' WHEN n_lost <= n_new THEN 'pass' ELSE 'warn' END"),
    "vis.index-ratio": ("visibility", "medium", "CASE WHEN NOT coalesce(visibility, false) OR index_ratio IS NULL THEN 'na' WHEN index_ratio < 0.3 THEN 'fail' WHEN index_ratio < 0.6 THEN 'warn' ELSE 'pass' END"),
    "vis.brand-share": ("visibility", "low", "CASE WHEN coalesce(visibility, false) THEN 'info' ELSE 'na' END"),
    "vis.ai-overview-share": ("visibility", "low", "CASE WHEN coalesce(visibility, false) AND overview_share IS NOT NULL THEN 'info' ELSE 'na' END"),
    "comp.gap": ("competitors", "medium", "CASE WHEN coalesce(n_rivals, 0) = 0 OR NOT coalesce(visibility, false) OR etv IS NULL OR rival_etv IS NULL THEN 'na' WHEN rival_etv / greatest(etv, 1) <= 3 THEN 'pass' WHEN rival_etv / greatest(etv, 1) <= 10 THEN 'warn' ELSE 'fail' END"),
    "comp.list": ("competitors", "low", "CASE WHEN coalesce(n_rivals, 0) > 0 THEN 'info' ELSE 'na' END"),
}
GATES = ("crawl.robots.blocks-site", "crawl.entry.status", "crawl.entry.indexable", "sec.https", "sec.tls.expired")
#: Pages that a site's check finds at fault, where it counts pages.
AFFECTED = {"crawl.sitemap.sample": "samples_bad", "crawl.links.broken": "coalesce(broken_pages, 0)", "onpage.images.alt": "alt_pages", "onpage.thin": "n_thin", "onpage.robots-nofollow": "nofollow_pages", "mobile.images.dims": "dims_bad_pages", "schema.jsonld.valid": "ld_error_pages", "arch.generic-anchors": "generic_pages", "arch.orphans": "orphans"}
#: Severities that follow from what was found.
SEVERITIES = {
    "crawl.robots.exists": "CASE WHEN robots_status IS NULL OR robots_status >= 500 THEN 'high' ELSE 'low' END", "crawl.canonical.pages": "CASE WHEN n_wrong_canonical > 0 THEN 'high' ELSE 'medium' END",
    "crawl.canonical.entry": "CASE WHEN coalesce(e.canonical, '') <> '' AND (e.canonical_bad OR (e.canonical_key <> e.own_key AND coalesce(e.target_dead, false))) THEN 'high' ELSE 'medium' END",
    "crawl.https.redirect": "CASE WHEN coalesce(http_fail, 0) = 0 AND http_temporary > 0 THEN 'low' ELSE 'high' END", "schema.jsonld.valid": "CASE WHEN ld_error_pages = 0 AND ld_pages = 0 THEN 'medium' ELSE 'high' END",
}
#: Statuses that are set whatever the share, where a page is affected.
FORCED = {"crawl.pages.noindex": "samples_noindex > 0", "crawl.canonical.pages": "n_wrong_canonical > 0"}


def _full_host(url: Column) -> Column:
    """The host in lower case, www included."""
    return F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _variants(crawl: Crawl) -> DataFrame:
    """Per site: counts over the spellings of its entry's address; those of a host that doesn't exist are left out."""
    v = completed(crawl.variants, VARIANT_COLUMNS, crawl.pages)
    https, www = F.col("url").rlike("(?i)^https://"), F.col("url").rlike(r"(?i)^https?://www\.")
    own_kind = F.concat(F.when(https, "https").otherwise("http"), F.when(www, "-www").otherwise("-apex"))
    v = v.join(crawl.extra["entry_keys"], "site")
    v = v.where(~F.col("alt_missing") | F.coalesce(_full_host(F.col("url")) == _full_host(F.col("main_url")), F.lit(True)))
    v = v.withColumns({"kind": F.coalesce("kind", own_kind), "end": F.coalesce("final_url", F.when(F.col("status") == 200, F.col("url"))), "canonical_key": check_key(F.col("canonical")), "hops": F.coalesce("n_hops", F.when(F.col("status").between(300, 399), 1).otherwise(0)), "first": F.coalesce("first_hop", "status")})
    http, host = ~F.col("url").rlike("(?i)^https://"), F.col("kind").rlike("^https?-(www|apex)$")
    at_home = F.coalesce(F.col("end").rlike("(?i)^https://") & (_full_host(F.col("end")) == _full_host(F.col("main_url"))), F.lit(False))
    to_https = F.coalesce(F.col("end").rlike("(?i)^https://"), F.lit(False))
    fails = F.col("status").isNotNull() & ((F.col("status") == 200) | ~to_https)
    warns = ~fails & (F.col("status").isNull() | ~F.col("first").isin(301, 308))
    spelled = F.col("kind").isin("trailing-slash", "index-html", "uppercase", "utm")
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.struct(F.col("status").isNotNull().alias("known"), "status", "canonical_key")))
    return v.groupBy("site").agg(
        F.count("*").alias("n_variants"), F.count_if(http).alias("http_variants"), F.count_if(http & fails).alias("http_fail"), F.count_if(http & warns).alias("http_warn"),
        F.count_if(http & warns & F.col("first").isin(302, 307)).alias("http_temporary"), F.count_if(spelled).alias("spelled"),
        F.count_if(spelled & (F.col("status") == 200) & ~F.coalesce(F.col("canonical_key") == F.col("main_key"), F.lit(False))).alias("spelled_bad"),
        F.max("hops").alias("longest_chain"), F.count_if("meta_refresh").alias("variant_refresh"), F.count_if(host).alias("host_variants"), F.count_if(host & F.col("status").isNotNull() & ~at_home).alias("host_bad"),
        F.count_if(host & F.col("status").isNull()).alias("host_silent"), F.count_if(F.col("url").rlike("(?i)^https://") & F.col("status").isNotNull() & (F.col("status") < 500)).alias("https_up"), pick("https-www").alias("www"), pick("https-apex").alias("apex"),
    )


def _sitemaps(crawl: Crawl) -> DataFrame:
    m = completed(crawl.sitemaps, SITEMAP_COLUMNS, crawl.pages).withColumns({"fetched": F.coalesce(F.col("status") == 200, F.lit(False)), "is_index": F.coalesce("is_index", F.lit(False)), "valid": F.coalesce("valid", F.lit(False)), "n_urls": F.coalesce("n_urls", F.lit(0).cast("long"))})
    usable = F.col("fetched") & F.col("valid") & (F.col("is_index") | (F.col("n_urls") > 0))
    leaf = usable & ~F.col("is_index")
    return m.groupBy("site").agg(
        F.count_if(usable).alias("maps_usable"), F.count_if("fetched").alias("maps_fetched"), F.count_if(F.col("fetched") & ~F.col("is_index") & (F.col("n_urls") > 50_000)).alias("maps_huge"),
        F.count_if(F.col("fetched") & (~F.col("valid") | (~F.col("is_index") & (F.col("n_urls") == 0)))).alias("maps_invalid"), F.sum(F.when(leaf, F.col("n_urls"))).alias("leaf_urls"),
        F.sum(F.when(leaf, F.col("n_urls") * F.coalesce("lastmod_share", F.lit(0.0)))).alias("leaf_dated"), F.max("newest").alias("maps_newest"),
    )


def linked_keys(pages: DataFrame) -> DataFrame:
    """site, key, url of each page's own address, final address and links: whom a page knows, each once a page."""
    links = F.concat(F.array("url", "final_url"), F.coalesce("links", F.array().cast("array<string>")))
    return pages.select("site", "url", F.explode(F.array_distinct(F.transform(links, check_key))).alias("key"))


def _samples(crawl: Crawl, pages: DataFrame) -> DataFrame:
    """Per site: sitemap entries visited, those that can't be indexed, and those that no page links to (by an anti join of keys)."""
    s = completed(crawl.samples, SAMPLE_COLUMNS, crawl.pages).withColumn("key", check_key(F.col("url")))
    elsewhere = F.coalesce(check_key(F.col("canonical")) != F.col("key"), F.lit(False)) & (F.coalesce("canonical", F.lit("")) != "")
    bad = ~F.coalesce(F.col("status") == 200, F.lit(False)) | F.coalesce("noindex", F.lit(False)) | ~F.coalesce("same_host", F.lit(True)) | elsewhere
    known = linked_keys(pages.where("ok")).select("site", "key").distinct().withColumn("known", F.lit(True))
    j = s.withColumn("bad", bad).join(known, ["site", "key"], "left")
    return j.groupBy("site").agg(F.count("*").alias("samples"), F.count_if("bad").alias("samples_bad"), F.count_if("noindex").alias("samples_noindex"), F.count_if(F.col("known").isNull()).alias("orphans"))


def _shared_links(pages: DataFrame) -> DataFrame:
    """Per site: pages that link, and addresses on every one of them: keys are counted once a page, then by site."""
    linking = pages.where("ok and size(links) > 0")
    own = linking.select("site", F.explode(F.array_distinct(F.concat(F.array(check_key(F.col("url"))), F.transform("links", check_key)))).alias("key"))
    seen = own.groupBy("site", "key").agg(F.count("*").alias("n"))
    n = linking.groupBy("site").agg(F.count("*").alias("linking_pages"))
    shared = seen.join(n, "site").where("n = linking_pages").groupBy("site").agg(F.count("*").alias("shared_links"))
    return n.join(shared, "site", "left").fillna(0, ["shared_links"])


def _slowest(pages: DataFrame) -> DataFrame:
    """Per site the nearest-rank 90th percentile of the pages' times: values are counted first, so a site's pages aren't ordered in one place."""
    n = pages.where("ttfb_ms is not null").groupBy("site", "ttfb_ms").agg(F.count("*").alias("c"))
    up_to = F.sum("c").over(Window.partitionBy("site").orderBy("ttfb_ms"))
    total = F.sum("c").over(Window.partitionBy("site"))
    return n.withColumn("r", up_to).withColumn("t", total).where(F.col("r") >= F.ceil(F.col("t") * 0.9)).groupBy("site").agg(F.min("ttfb_ms").alias("pages_p90"))


def site_checks(crawl: Crawl) -> DataFrame:
    """site, check_id, dimension, severity, weight, gate, status, universe, affected: all checks of every site.

    Pages are summed up in one aggregation by site; variants, sitemaps, samples, broken links and shared links in one
    each; the rest is a row per site, from which an array of checks is unrolled. No page list is gathered. A site
    without pages has its site checks. status: pass, warn, fail, info, or na where it wasn't measured.
    """
    pages = judged_pages(crawl).withColumns({"title_units": _utf16(F.col("title")), "description_units": _utf16(F.col("description")), "__today": crawl.today})
    pages = pages.withColumn("seen", F.transform(F.concat(F.array("url"), F.coalesce("links", F.array().cast("array<string>"))), lambda u: F.lower(X.path_of(u))))
    counts = []
    for i, (_, _, applies, fault, _, _) in enumerate(PAGE_CHECKS.values()):
        counts += [F.expr(f"count_if({applies}) AS u{i}"), F.expr(f"count_if(({applies}) AND ({fault})) AS a{i}")]
    per = pages.groupBy("site").agg(*counts, *(F.expr(f"{e} AS {n}") for n, e in PAGE_SUMS.items()))
    sites = completed(crawl.sites, SITE_COLUMNS, crawl.sites)
    entry_columns = ("url", "final_url", "status", "redirects", "noindex", "canonical", "canonical_key", "canonical_bad", "own_key", "target_dead", "lang", "viewport", "og", "twitter", "types", "has_favicon", "js_shell", "ok")
    entries = pages.where("is_entry").dropDuplicates(["site"]).select("site", F.struct(*entry_columns).alias("entry"))
    base = sites.join(entries, "site", "left")
    main = F.coalesce("entry.final_url", "entry_url")
    crawl.extra["entry_keys"] = base.select("site", main.alias("main_url"), check_key(main).alias("main_key"), F.coalesce("alt_missing", F.lit(False)).alias("alt_missing"))
    broken = completed(crawl.broken, BROKEN_COLUMNS, crawl.pages).groupBy("site").agg(F.countDistinct("from_url").alias("broken_pages"))
    wide = base.join(per, "site", "left")
    for part in (_variants(crawl), _sitemaps(crawl), _samples(crawl, pages), broken, _shared_links(pages), _slowest(pages)):
        wide = wide.join(part, "site", "left")
    wide = wide.withColumns({"e": F.when(F.col("entry.ok"), F.col("entry")), "__today": crawl.today}).withColumns({
        "n_og": sum((F.expr(f"int(coalesce(e.og['{k}'], e.og['og:{k}'], '') <> '')") for k in ("title", "description")), F.expr("int(coalesce(e.og['image'], e.og['og:image'], '') <> '')")),
        "og_image_seen": F.expr("og_image_status IS NOT NULL OR og_image_type IS NOT NULL"),
    })
    rows = []
    for i, (name, (dim, severity, _, _, good, warn)) in enumerate(PAGE_CHECKS.items()):
        status = _SHARE.format(n=f"u{i}", x=f"a{i}", a=good, b=warn)
        if dim == "architecture":
            status = _arch(status)
        if name == "onpage.near-duplicate":
            status = f"CASE WHEN u{i} < 2 THEN 'na' ELSE {status} END"
        if name in FORCED:
            status = f"CASE WHEN a{i} > 0 AND coalesce({FORCED[name]}, false) THEN 'fail' ELSE {status} END"
        rows.append(_row(name, dim, severity, status, f"coalesce(u{i}, 0)", f"coalesce(a{i}, 0)", True))
    for name, (dim, severity, status) in SITE_CHECKS.items():
        rows.append(_row(name, dim, severity, status, "CAST(NULL AS bigint)", f"coalesce({AFFECTED[name]}, 0)" if name in AFFECTED else "0", name in AFFECTED))
    weight = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    out = wide.select("site", F.expr(f"inline(array({', '.join(rows)}))"))
    return out.select("site", "check_id", "dimension", "severity", weight[F.col("severity")].alias("weight"), "gate", "status", "universe", "affected", "of_pages")


def _row(name: str, dim: str, severity: str, status: str, universe: str, affected: str, of_pages: bool) -> str:
    level = SEVERITIES.get(name, f"'{severity}'")
    return f"named_struct('check_id', '{name}', 'dimension', '{dim}', 'severity', {level}, 'gate', {str(name in GATES).lower()}, 'status', {status}, 'universe', CAST({universe} AS bigint), 'affected', CAST({affected} AS bigint), 'of_pages', {str(of_pages).lower()})"


def site_dimensions(checks: DataFrame) -> DataFrame:
    """site, dimension, n, score of the checks; see dimension_scores."""
    return dimension_scores(checks, ["site", "dimension"])


def technical_score(checks: DataFrame) -> DataFrame:
    """site, score, grade over the dimensions that aren't paid; a failed gate caps it at 40 and F."""
    shut = checks.where("gate and status = 'fail'").select("site")
    onsite = site_dimensions(checks).where(F.col("dimension").isin(*DIMENSIONS))
    return overall_score(onsite, ["site"], DIMENSIONS, shut)


def issue_counts(checks: DataFrame) -> DataFrame:
    """site, n_pass, n_warn, n_fail, n_unmeasured (na and info)."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return checks.groupBy("site").agg(of("pass").alias("n_pass"), of("warn").alias("n_warn"), of("fail").alias("n_fail"), of("na", "info").alias("n_unmeasured"))


def top_issues(checks: DataFrame, n: int = 3) -> DataFrame:
    """site, place, check_id: the worst issues that aren't paid: failed gates, then failures, then warnings, by severity, by pages affected, by id."""
    rank = F.when(F.col("gate") & (F.col("status") == "fail"), 1000).otherwise(0) + F.when(F.col("status") == "fail", 100).otherwise(0) + F.col("weight") * 10
    found = checks.where(F.col("status").isin("warn", "fail") & ~F.col("dimension").isin(*PAID))
    place = F.row_number().over(Window.partitionBy("site").orderBy(rank.desc(), F.desc("affected"), "check_id"))
    return found.withColumn("place", place).where(F.col("place") <= n).select("site", "place", "check_id")


# Checks that take more than little work to mend.
MORE_EFFORT = tuple(
    "arch.depth arch.internal-links.bloat arch.orphans arch.url-depth crawl.js-dependent crawl.freshness crawl.entry.status crawl.pages.errors crawl.hreflang mobile.parity onpage.images.alt onpage.thin "
    "onpage.near-duplicate onpage.url.hygiene perf.cwv.ttfb perf.crawl-ttfb sec.https schema.product".split()
)


def roadmap(checks: DataFrame, n_pages: DataFrame) -> DataFrame:
    """site, check_id, bucket, impact, pages_affected of every warning and failure: this_week, this_month or later by the impact (1 digit) and the effort.

    n_pages: site, n_pages. Impact is the severity times one more than the doublings of the pages affected; checks of the
    whole site affect every page.
    """
    j = checks.where(F.col("status").isin("warn", "fail")).join(n_pages, "site", "left")
    affected = F.when(F.col("of_pages"), F.col("affected")).otherwise(F.greatest(F.coalesce("n_pages", F.lit(1)), F.lit(1)))
    impact = round_up_half(F.col("weight") * (1 + F.log2(1 + affected)), 1)
    bucket = F.when(F.col("gate") & (F.col("status") == "fail"), "this_week").when((impact >= 6) & ~F.col("check_id").isin(*MORE_EFFORT), "this_week").when(impact >= 4, "this_month").otherwise("later")
    return j.select("site", "check_id", bucket.alias("bucket"), impact.alias("impact"), affected.alias("pages_affected"))
