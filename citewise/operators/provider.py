"""Provider facts: results pages, anchors, scores, watched brands, samples, topic clusters."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewise.functions.exprs import clamp, main_domain, url_host


def top_hosts(items: DataFrame, query: str, rank: str, url: str, own: Column, top: int = 5) -> DataFrame:
    """query, place, host, url: the first top results of a query from distinct hosts other than own (a host or null), by rank.

    Results that aren't http(s) are left out; ties of the rank go to the smaller address.
    """
    rows = items.select(query, F.col(rank).try_cast("int").alias("rank"), url_host(F.col(url)).alias("host"), F.col(url).alias("url"), own.alias("own")).where(F.col("host").isNotNull() & ~F.col("host").eqNullSafe(F.col("own")))
    best = rows.groupBy(query, "host").agg(F.min(F.struct("rank", "url")).alias("b"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("b.rank", "host"))
    return best.withColumn("place", place).where(F.col("place") <= top).select(query, "place", "host", "b.url")


def feature_shares(items: DataFrame, query: str, kind: str) -> DataFrame:
    """kind, n_queries, share (4 digits): on how many of all queries' pages each kind of result stands. Queries are counted in the same pass, as the kind null."""
    rows = items.where(F.col(query).isNotNull()).select(query, F.explode(F.array(F.lit(None).cast("string"), F.col(kind))).alias("kind")).distinct()
    per = rows.groupBy("kind").agg(F.count("*").alias("n_queries"))
    total = F.max(F.when(F.col("kind").isNull(), F.col("n_queries"))).over(Window.partitionBy())
    return per.withColumn("n", total).where("kind is not null").select("kind", "n_queries", F.round(F.col("n_queries") / F.col("n"), 4).alias("share"))


def anchor_profile(anchors: DataFrame, target: str, anchor: str, backlinks: str) -> DataFrame:
    """target, total, n_anchors, top_anchor, top_share (4 digits), status: pass up to 0.4, warn up to 0.6, else fail, na without links."""
    n = F.coalesce(F.col(backlinks).try_cast("long"), F.lit(0))
    rows = anchors.select(target, F.lower(F.trim(F.coalesce(anchor, F.lit("")))).alias("a"), n.alias("n")).groupBy(target, "a").agg(F.sum("n").alias("n"))
    agg = rows.groupBy(target).agg(F.sum("n").alias("total"), F.count("*").alias("n_anchors"), F.max(F.struct("n", "a")).alias("m"))
    share = F.round(F.try_divide(F.col("m.n").cast("double"), F.col("total")), 4)
    status = F.when(share.isNull(), "na").when(share <= 0.4, "pass").when(share <= 0.6, "warn").otherwise("fail")
    return agg.select(target, "total", "n_anchors", F.col("m.a").alias("top_anchor"), share.alias("top_share"), status.alias("status"))


def monthly(df: DataFrame, at: str, by: list[str]) -> DataFrame:
    """month ('YYYY-MM' of a text or time), by, n; rows without a month are left out."""
    m = F.regexp_extract(F.col(at).cast("string"), r"^(\d{4}-\d{2})", 1)
    return df.select(m.alias("month"), *by).where("month <> ''").groupBy("month", *by).agg(F.count("*").alias("n"))


def competitor_score(own: Column, rival: Column) -> Column:
    """100 less 15 per doubling of a rival's lead, within 0 and 100; null without both."""
    return F.when((own > 0) & (rival > 0), F.round(clamp(100 - 15 * F.greatest(F.log2(rival / own), F.lit(0.0)), 0.0, 100.0), 1))


def due(monitors: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    """The first limit active monitors whose next run is past or unset, the longest due first, then by id; copies count once."""
    rows = monitors.where("active and id is not null").where(F.col("next_run_at").isNull() | (F.col("next_run_at") <= now))
    once = rows.groupBy("id").agg(F.min("next_run_at").alias("next_run_at"))
    return once.orderBy(F.col("next_run_at").asc_nulls_first(), "id").limit(limit)


def stratified(df: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """n rows drawn in turn from the strata: the first of each, then the second of each; strata by name, rows by order."""
    turn = df.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(order)))
    return turn.where(F.col("turn") <= n).orderBy("turn", stratum).limit(n)


# The steps of the 32-bit generator by which resamples are drawn.
MULBERRY = (0x6D2B79F5, 61, 4294967296)


def mulberry(seed: int):
    """Numbers in [0, 1) of the 32-bit generator, the same for the same seed."""
    step, odd, size = MULBERRY
    while True:
        seed = (seed + step) % size
        x = ((seed ^ (seed >> 15)) * (seed | 1)) % size
        x ^= (x + ((x ^ (x >> 7)) * (x | odd))) % size
        yield ((x ^ (x >> 14)) % size) / size


def bootstrap_interval(values: list[float], draws: int = 2000, seed: int = 20260922) -> tuple[float, float]:
    """The 2.5 and 97.5 percent points of the means of draws samples of a short list of values; the same for the same seed."""
    if not values:
        return 0.0, 0.0
    rng, n = mulberry(seed), len(values)
    means = sorted(sum(values[int(next(rng) * n)] for _ in range(n)) / n for _ in range(draws))
    return means[int(0.025 * (draws - 1))], means[int(0.975 * (draws - 1))]


def sitemap_entries(xml: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind ('url' or 'sitemap'), loc, lastmod of each entry of sitemap texts; entries without loc are left out, CDATA and entities are read."""
    entry = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?is)<(?:url|sitemap)\b[^>]*>.*?</(?:url|sitemap)\s*>"), 0))

    def inner(tag: str) -> Column:
        raw = F.regexp_extract("e", rf"(?is)<{tag}\b[^>]*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</{tag}\s*>", 1)
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
            raw = F.replace(raw, F.lit(a), F.lit(b))
        return F.when(raw != "", raw)

    rows = xml.select(key, entry.alias("e"))
    return rows.select(key, F.lower(F.regexp_extract("e", r"(?i)^<(url|sitemap)", 1)).alias("kind"), inner("loc").alias("loc"), inner("lastmod").alias("lastmod")).where("loc is not null")


def topic_pages(pages: DataFrame, page: str, topics: Column) -> DataFrame:
    """topic, n_pages, hub: topics (an array per page) that at least two pages share, and the first of those pages."""
    t = pages.select(page, F.explode(F.array_distinct(topics)).alias("topic"))
    return t.groupBy("topic").agg(F.count("*").alias("n_pages"), F.min(page).alias("hub")).where("n_pages > 1")


def domain_counts(df: DataFrame, url: str) -> DataFrame:
    """domain, n, n_hosts: rows and hosts per registrable domain of addresses."""
    h = df.select(url_host(F.col(url)).alias("host")).where("host is not null")
    return h.groupBy(main_domain(F.col("host")).alias("domain")).agg(F.count("*").alias("n"), F.countDistinct("host").alias("n_hosts"))
