"""Queries and pages: which page serves a query, rivals, what a page adds, topics covered, reputation, kept answers, samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewise.functions import text as X
from citewise.functions.exprs import check_key, jaccard, main_domain, round_up_half, url_host, url_key, within
from citewise.functions.misc import own_domain

num = lambda c: F.coalesce(c, F.lit(0))


def best_pages(queries: DataFrame, pages: DataFrame, brands: Column) -> DataFrame:
    """site, query, url, title_share, h1_share of the page that best serves each query: most of the query's words in the title, then in the first heading, then most inbound links, then the address.

    queries: site, query; pages: site, url, title, h1, inbound. Pages meet a query only where their title or heading has
    one of its words, so no query meets all pages.
    """
    q = queries.select("site", "query", X.core_tokens(F.col("query"), brands).alias("core")).where("size(core) > 0").distinct()
    words = q.select("site", "query", "core", F.explode("core").alias("w"))
    stems = lambda c: F.array_distinct(F.transform(X.query_words(F.col(c)), X.stem))
    p = pages.select("site", "url", num(F.col("inbound")).alias("inbound"), stems("title").alias("t"), stems("h1").alias("h"))
    on = p.select("site", "url", "inbound", "t", "h", F.explode(F.array_union("t", "h")).alias("w"))
    met = words.join(on, ["site", "w"]).select("site", "query", "core", "url", "inbound", "t", "h").distinct()
    share = lambda c: F.size(F.array_intersect("core", c)) / F.size("core")
    place = F.row_number().over(Window.partitionBy("site", "query").orderBy(F.desc("title_share"), F.desc("h1_share"), F.desc("inbound"), "url"))
    return met.select("site", "query", "url", "inbound", share("t").alias("title_share"), share("h").alias("h1_share")).withColumn("place", place).where("place = 1").select("site", "query", "url", "title_share", "h1_share")


def ranked_targets(targets: DataFrame, ranked: DataFrame) -> DataFrame:
    """target, keyword, url, position: the best ranked keyword that is a target in any wording, by position, or nulls. targets: target; ranked: keyword, url, position."""
    best = ranked.select(X.keyword_key(F.col("keyword")).alias("k"), F.struct("position", "keyword", "url").alias("r")).where("k <> ''").groupBy("k").agg(F.min("r").alias("r"))
    t = targets.select("target", X.keyword_key(F.col("target")).alias("k")).distinct()
    return t.join(best, "k", "left").select("target", "r.keyword", "r.url", "r.position")


def rivals_of(results: DataFrame, domain: Column, top: int = 5) -> DataFrame:
    """query, place, url, position, ugc: the first top results that aren't of the domain, each address once in any spelling. results: query, position, url."""
    rows = results.select("query", "position", "url", url_key(F.col("url")).alias("k"), url_host(F.col("url")).alias("host"), domain.alias("own"))
    # addresses of one key have one host; tested after grouping, it is taken from each address just once
    once = rows.groupBy("query", "k").agg(F.min(F.struct("position", "url")).alias("r"), F.first("host").alias("host"), F.first("own").alias("own")).where(F.col("host").isNotNull() & ~own_domain(F.col("host"), F.col("own")))
    place = F.row_number().over(Window.partitionBy("query").orderBy("r.position", "r.url"))
    return once.withColumn("place", place).where(F.col("place") <= top).select("query", "place", "r.url", "r.position")


def gain_signals(own: DataFrame, rivals: DataFrame) -> DataFrame:
    """query, extra_numbers, extra_tables: what a page has more than the median of the rivals that were read, at least 0, whole. own: query, n_numbers, n_tables; rivals: query, fetched, n_numbers, n_tables."""
    base = rivals.where("fetched").groupBy("query").agg(F.median("n_numbers").alias("a"), F.median("n_tables").alias("b"))
    more = lambda c, m: F.greatest(F.lit(0), round_up_half(num(F.col(c)) - num(F.col(m)))).cast("int")
    return own.join(base, "query", "left").select("query", more("n_numbers", "a").alias("extra_numbers"), more("n_tables", "b").alias("extra_tables"))


def dominant_formats(results: DataFrame) -> DataFrame:
    """query, format: the commonest format of the commonest group of formats among two results and more; ties by the best position, then by name. results: query, position, format."""
    r = results.withColumn("g", X.format_group(F.col("format")))
    n = r.groupBy("query").agg(F.count("*").alias("n")).where("n > 1")
    group = r.groupBy("query", "g").agg(F.count("*").alias("c"), F.min("position").alias("p")).groupBy("query").agg(F.min_by("g", F.struct(-F.col("c"), "p", "g")).alias("g"))
    own = r.join(group, ["query", "g"]).groupBy("query", "format").agg(F.count("*").alias("c"), F.min("position").alias("p")).groupBy("query").agg(F.min_by("format", F.struct(-F.col("c"), "p", "format")).alias("format"))
    return own.join(n.select("query"), "query", "left_semi")


def topic_coverage(headings: DataFrame, least: float = 0.5, shared: int = 3) -> DataFrame:
    """query, coverage, n_shared, n_unique: of the subtopics that two rivals and more share, the part the own page has (null for fewer than shared of them); its topics that no rival has.

    headings: query, source (0 for the own page, else the rival's place), ordinal, tokens (heading_tokens). Topics are
    grouped greedily in order of place and ordinal, each with the first whose words it shares by half; so one query's
    headings, some hundreds at most, are taken in order in one group.
    """

    def like(a: frozenset, b: frozenset) -> bool:
        return bool(a) and bool(b) and len(a & b) / len(a | b) >= least

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own: list[frozenset] = []
        rivals: dict[int, list[frozenset]] = {}
        for source, tokens in pdf.sort_values(["source", "ordinal"])[["source", "tokens"]].itertuples(index=False):
            topics = own if source == 0 else rivals.setdefault(source, [])
            t = frozenset(tokens)
            if t and not any(like(t, o) for o in topics):
                topics.append(t)
        groups: list[tuple[list[frozenset], set[int]]] = []
        for source, topics in rivals.items():
            for t in topics:
                hit = next((g for g in groups if like(g[0][0], t)), None)
                if hit:
                    hit[0].append(t)
                    hit[1].add(source)
                else:
                    groups.append(([t], {source}))
        common = [members for members, sources in groups if len(sources) > 1]
        covered = sum(any(like(t, m) for t in own for m in members) for members in common)
        unique = sum(not any(like(t, m) for topics in rivals.values() for m in topics) for t in own) if rivals else 0
        return pd.DataFrame([(key[0], round(covered / len(common), 3) if len(common) >= shared else None, len(common), unique)], columns=["query", "coverage", "n_shared", "n_unique"])

    return headings.groupBy("query").applyInPandas(run, f"query {dict(headings.dtypes)['query']}, coverage double, n_shared int, n_unique int")


# Review platforms, forums, sites of own profiles, and words of complaint.
PLATFORMS = ("trustpilot.com", "g2.com", "capterra.com", "getapp.com", "softwareadvice.com", "yelp.com", "bbb.org", "sitejabber.com", "producthunt.com", "glassdoor.com", "tripadvisor.com", "clutch.co", "gartner.com", "appsumo.com", "reviews.io", "consumeraffairs.com", "maps.google.com")
FORUMS = ("reddit.com", "quora.com", "news.ycombinator.com", "stackexchange.com", "stackoverflow.com")
PROFILES = ("facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com", "youtube.com", "tiktok.com", "pinterest.com", "threads.net", "github.com", "medium.com", "crunchbase.com", "wellfound.com", "angel.co", "apps.apple.com", "play.google.com", "chromewebstore.google.com")
COMPLAINT = r"(?i)\b(?:scam(?:s|mer|mers|med)?|complaints?|lawsuits?|rip[- ]?offs?|fraud(?:s|ulent)?)\b"


def reputation(results: DataFrame) -> DataFrame:
    """site, owns, top3, independent, n_platforms, rating, forums, negative of the results for a brand and for its reviews.

    results: site, domain, brand_key, search ('brand' or 'reviews'), position, url, title, rating, votes. Each address
    counts once, the brand's search before the reviews'. owns is null without results of the brand's search; independent
    are the main domains of its first ten results that name the brand and are no platform, forum or profile.
    """
    host = url_host(F.col("url"))
    names = F.regexp_replace(F.lower(F.concat_ws(" ", "title", host)), r"[^\p{L}\p{N}]+", "").contains(F.col("brand_key")) & (F.length("brand_key") >= 3)
    label = lambda h: F.when(within(h, PLATFORMS), main_domain(h))
    r = results.where(host.isNotNull()).select("site", "search", "position", host.alias("host"), url_key(F.col("url")).alias("k"), own_domain(host, F.col("domain")).alias("own"), F.coalesce(names, F.lit(False)).alias("named"), F.col("title").rlike(COMPLAINT).alias("bad"), "rating", "votes", label(host).alias("platform"))
    place = F.row_number().over(Window.partitionBy("site", "search").orderBy("position"))
    first = r.where("search = 'brand'").withColumn("place", place).where("place <= 10")
    neutral = ~F.col("own") & F.col("named") & F.col("platform").isNull() & ~within(F.col("host"), FORUMS + PROFILES)
    brand = first.groupBy("site").agg(F.max((F.col("place") == 1) & F.col("own")).alias("owns"), F.max((F.col("place") <= 3) & F.col("own")).alias("top3"), F.countDistinct(F.when(neutral, main_domain(F.col("host")))).alias("independent"))
    once = r.groupBy("site", "k").agg(F.min_by(F.struct("host", "own", "named", "bad", "rating", "votes", "platform"), F.struct((F.col("search") != "brand"), "position")).alias("x")).select("site", "x.*").where("named and not own")
    vote = F.when(F.col("votes") > 0, F.col("votes")).otherwise(1)
    rated = F.when(F.col("platform").isNotNull() & F.col("rating").isNotNull(), F.col("rating"))
    rest = once.groupBy("site").agg(F.countDistinct("platform").alias("n_platforms"), F.try_divide(F.sum(rated * vote), F.sum(F.when(rated.isNotNull(), vote))).alias("rating"), F.count_if(within(F.col("host"), FORUMS)).alias("forums"), F.count_if("bad").alias("negative"))
    sites = results.select("site").distinct()
    zero = lambda c: num(F.col(c)).alias(c)
    return sites.join(brand, "site", "left").join(rest, "site", "left").select("site", "owns", "top3", zero("independent"), zero("n_platforms"), "rating", zero("forums"), zero("negative"))


def found_pages(pages: DataFrame) -> DataFrame:
    """site, about, contact: the address of a page about the site and of one to reach it, crawled ones before those only linked, by address. pages: site, url, links."""
    each = pages.select("site", F.inline(F.concat(F.array(F.struct(F.col("url"), F.lit(0).alias("far"))), F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda u: F.struct(u.alias("url"), F.lit(1).alias("far"))))))
    path = X.path_of(F.col("url"))
    of = lambda p: F.min(F.when(path.rlike(p), F.struct("far", "url")))
    a = each.groupBy("site").agg(of(r"(?i)/(about|about-us|company|our-story|who-we-are|team|our-team)/?$").alias("a"), of(r"(?i)/(contact|contact-us|get-in-touch|reach-us)/?$").alias("c"), of(r"(?i)/(support|help)/?$").alias("s"))
    return a.select("site", F.col("a.url").alias("about"), F.coalesce(F.when(F.col("c.far") == 0, F.col("c.url")), F.when(F.col("s.far") == 0, F.col("s.url")), F.col("c.url")).alias("contact"))


def kept_and_fresh(kept: DataFrame, fresh: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """The rows of a table after a re-run: fresh rows that are ok (a condition on their columns), else the kept ones, else the fresh ones as they are; with kept, whether the old row stands."""
    rest = [c for c in fresh.columns if c not in keys]
    f = fresh.select(*keys, F.struct(*rest).alias("f"), F.coalesce(ok, F.lit(False)).alias("good"))
    j = f.join(kept.select(*keys, F.struct(*rest).alias("k")), keys, "full")
    old = F.col("k").isNotNull() & ~F.coalesce("good", F.lit(False))
    return j.select(*keys, F.when(old, F.col("k")).otherwise(F.col("f")).alias("x"), old.alias("kept")).select(*keys, "x.*", "kept")


def with_absent(items: DataFrame, judgments: DataFrame, keys: list[str], absent: dict) -> DataFrame:
    """Every item with its judgment; those without get the columns of absent, a row that says nothing was found."""
    j = items.join(judgments, keys, "left")
    return j.fillna(absent)


def first_seen(rows: DataFrame, group: str, order: list[str], a: str, b: str) -> DataFrame:
    """The rows, taken in order, whose a and whose b no kept row before has. One group's rows, which are few, are taken one after the other; nulls of a and b never clash."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen_a: set = set()
        seen_b: set = set()
        keep = []
        for i, x, y in pdf.sort_values(order, kind="stable")[[a, b]].itertuples():
            if (x is None or x not in seen_a) and (y is None or y not in seen_b):
                keep.append(i)
                seen_a.add(x)
                seen_b.add(y)
        return pdf.loc[keep]

    return rows.groupBy(group).applyInPandas(run, rows.schema)


def top_of_map(counts: Column, n: int) -> Column:
    """The n greatest entries above 0 of a map of numbers, ties by key, as an array of (key, value)."""
    entries = F.filter(F.map_entries(counts), lambda e: e["value"] > 0)
    order = lambda x, y: F.when(x["value"] > y["value"], -1).when(x["value"] < y["value"], 1).when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)
    return F.slice(F.array_sort(entries, order), 1, n)


def latest(rows: DataFrame, by: str, at: str, tie: str, n: int = 100) -> DataFrame:
    """The n newest rows of each value of by."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), tie))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def crawl_queue(urls: DataFrame, site: str, n: int = 20) -> DataFrame:
    """The next n addresses of each site to fetch: fewer clicks first, then those from menus, then shallower paths, then more links to them, then by address. urls: site, url, depth, in_menu, inbound."""
    depth = F.size(X.segments(X.path_of(F.col("url"))))
    place = F.row_number().over(Window.partitionBy(site).orderBy("depth", F.desc("in_menu"), depth, F.desc("inbound"), "url"))
    return urls.withColumn("place", place).where(F.col("place") <= n)


def even_stride(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """n rows of each value of by at even distances in order, or all of fewer."""
    w = Window.partitionBy(by)
    r = rows.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("m", F.count("*").over(w))
    step = F.col("m") / F.lit(n)
    return r.where((F.col("m") <= n) | (F.floor(F.col("i") / step) != F.floor((F.col("i") - 1) / step))).drop("i", "m")


def public_view(rows: DataFrame, paid: Column, unlocked: Column, hidden: list[str]) -> DataFrame:
    """rows with the columns of hidden null where they are paid for and not unlocked, and locked saying so."""
    shut = F.coalesce(paid, F.lit(False)) & ~F.coalesce(unlocked, F.lit(False))
    return rows.select(*(F.when(~shut, F.col(c)).alias(c) if c in hidden else c for c in rows.columns), shut.alias("locked"))


def reusable(cached: DataFrame, wanted: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """domain, id of the newest finished free result of each wanted domain that is at most hours old. cached: id, domain, status, created_at, deleted."""
    ok = (F.col("status") == "complete") & ~F.coalesce("deleted", F.lit(False)) & (F.col("created_at") >= now - F.make_interval(hours=F.lit(hours)))
    best = cached.where(ok).groupBy("domain").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
    return best.join(wanted.select("domain").distinct(), "domain")


def page_overlap(a: Column, b: Column) -> Column:
    """How alike the topic words of two titles are, 0 for a title without any."""
    x, y = X.topic_tokens(a), X.topic_tokens(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), jaccard(x, y)).otherwise(0.0)


def linked_targets(links: DataFrame, pages: DataFrame) -> DataFrame:
    """site, source, target, url: the crawled page, by its address or by where it leads, that each link of a site means; null where none was crawled. links: site, source, target; pages: site, url, final_url."""
    keys = pages.select("site", "url", F.explode(F.array_distinct(F.array(check_key(F.col("url")), check_key(F.coalesce("final_url", "url"))))).alias("k")).groupBy("site", "k").agg(F.min("url").alias("url"))
    return links.withColumn("k", check_key(F.col("target"))).join(keys, ["site", "k"], "left").select("site", "source", "target", "url")


def cohort_shares(rows: DataFrame, group: str, flags: dict[str, Column]) -> DataFrame:
    """group (null for all), name, n, yes, share (percent, 1 digit) of flags that are known, by group and over all."""
    long = rows.select(F.col(group).alias("group"), F.inline(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("flag")) for n, c in flags.items())))).where("flag is not null")
    return long.groupingSets([["group", "name"], ["name"]], "group", "name").agg(F.count("*").alias("n"), F.count_if("flag").alias("yes")).withColumn("share", round_up_half(F.col("yes") * 100 / F.col("n"), 1))

