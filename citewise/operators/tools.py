"""Page tools: what one fetched page, header set, robots file, sitemap or link graph tells, as long tables of items with a status.

Each takes tables of what was fetched; nothing is fetched here. Items are (item, status, value); status is pass, warn, fail
or info. A tool's verdict is its worst status.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewise.functions import text as X
from citewise.functions.exprs import round_up_half, same_site, url_host
from citewise.session import cut

has = lambda c: F.coalesce(c, F.lit("")) != ""
pick = lambda cond, a, b: F.when(F.coalesce(cond, F.lit(False)), a).otherwise(b)


def items(df: DataFrame, by: list[str], rows: list[tuple[str, Column, Column]]) -> DataFrame:
    """by, item, status, value; items whose status is null are left out."""
    each = F.array(*(F.struct(F.lit(n).alias("item"), s.alias("status"), v.cast("string").alias("value")) for n, s, v in rows))
    return df.select(*by, F.inline(each)).where("status is not null")


def verdicts(found: DataFrame, by: list[str]) -> DataFrame:
    """by, verdict: the worst status of the items; info is no worse than pass."""
    rank = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    return found.groupBy(*by).agg(F.get(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.max(rank)).alias("verdict"))


# --- robots files as the audit reads them: the exact agent's groups, else those of *

def read_robots(text: str | None) -> dict:
    """groups (agent: rules of allow and path), sitemaps, unknown lines, crawl delays and whether it looks like a page."""
    out: dict = {"groups": {}, "sitemaps": [], "unknown": 0, "delays": {}, "is_html": bool(re.match(r"\s*<(?:!doctype|html)", text or "", re.I))}
    agents: list[str] = []
    open_ = False
    for line in (text or "").lstrip("﻿").splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not key and not colon:
            continue
        if key == "user-agent":
            agents = [*(agents if open_ else []), value.lower()]
            open_ = True
            for a in agents:
                out["groups"].setdefault(a, [])
        elif key in ("allow", "disallow"):
            open_ = False
            for a in agents:
                out["groups"][a].append((key == "allow", value))
        elif key == "crawl-delay":
            open_ = False
            out["delays"] |= dict.fromkeys(agents, value)
        elif key == "sitemap":
            out["sitemaps"].append(value)
        else:
            out["unknown"] += 1
    return out


def deciding_rule(robots: dict, path: str, agent: str) -> tuple[bool, str | None, str]:
    """Whether agent may fetch path, by which rule, and whose group it is: the longest matching path counts, allow before disallow."""
    via = agent.lower() if agent.lower() in robots["groups"] else "*" if "*" in robots["groups"] else None
    best: tuple[int, bool, str] | None = None
    for allow, p in robots["groups"].get(via, []) if via else []:
        if not p:
            continue
        full = p if p[0] in "/*" else f"/{p}"
        body, end = (full[:-1], True) if full.endswith("$") else (full, False)
        if re.match(".*".join(map(re.escape, body.split("*"))) + ("$" if end else ""), path) and (best is None or (len(body), allow) > best[:2]):
            best = (len(body), allow, f"{'Allow' if allow else 'Disallow'}: {p}")
    return (True, None, via or "none") if best is None else (best[1], best[2], via)


def robots_tests(df: DataFrame, by: list[str], robots: str, path: str, agent: str) -> DataFrame:
    """by, allowed, rule, via for each row's robots text, path and agent. The same text is read once a batch."""
    kinds = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            read: dict = {}
            got = []
            for t, p, a in zip(pdf["__t"], pdf["__p"], pdf["__a"], strict=True):
                if t not in read:
                    read[t] = read_robots(t)
                got.append(deciding_rule(read[t], p or "/", a or "*"))
            yield pd.concat([pdf[by], pd.DataFrame(got, columns=["allowed", "rule", "via"], index=pdf.index)], axis=1)

    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "allowed boolean, rule string, via string"])
    return df.select(*by, F.col(robots).alias("__t"), F.col(path).alias("__p"), F.col(agent).alias("__a")).mapInPandas(run, ddl)


def bot_access(sites: DataFrame, by: list[str], robots: str, path: str, bots: tuple[str, ...]) -> DataFrame:
    """by, bot, allowed, rule, via for each of a short list of bots."""
    return robots_tests(sites.withColumn("bot", F.explode(F.array(*map(F.lit, bots)))), [*by, "bot"], robots, path, "bot")


def robots_facts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_groups, sitemaps, n_unknown, is_html, all_blocked (for *), delay (for *), n_relative_sitemaps of each robots text; null for null."""
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                r = read_robots(t) if isinstance(t, str) else None
                out.append((k, None, None, None, None, None, None, None) if r is None else (k, len(r["groups"]), r["sitemaps"], r["unknown"], r["is_html"], not deciding_rule(r, "/", "*")[0], r["delays"].get("*"), sum(not re.match("https?://", s, re.I) for s in r["sitemaps"])))
            yield pd.DataFrame(out, columns=["k", "a", "b", "c", "d", "e", "f", "g"], dtype=object)

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, a int, b array<string>, c int, d boolean, e boolean, f string, g int").toDF(key, "n_groups", "sitemaps", "n_unknown", "is_html", "all_blocked", "delay", "n_relative_sitemaps")


# --- sitemaps

def sitemap_file(body: bytes) -> tuple[str, list[tuple[str, str | None]]]:
    """'index', 'urlset', 'text' or 'invalid', and (loc, lastmod) of each entry: XML in either form, bare loc elements, a list of addresses, any of them gzipped."""
    if body[:2] == b"\x1f\x8b":
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError):
            return "invalid", []
    text = body.decode("utf-8", "replace").lstrip("﻿").strip()
    plain = lambda s: re.sub(r"&(amp|lt|gt|quot|apos|#39);", lambda m: {"amp": "&", "lt": "<", "gt": ">", "quot": '"'}.get(m[1], "'"), re.sub(r"\s*(?:<!\[CDATA\[(.*?)\]\]>|(.*?))\s*\Z", lambda m: (m[1] if m[1] is not None else m[2]).strip(), s, count=1, flags=re.S))
    inner = lambda tag, s: next((plain(m[1]) for m in re.finditer(rf"<(?:\w+:)?{tag}\b[^>]*>(.*?)</(?:\w+:)?{tag}\s*>", s, re.S | re.I)), None)
    if "<" in text:
        kind = "index" if re.search(r"<(?:\w+:)?sitemapindex\b", text, re.I) else "urlset"
        found = [(inner("loc", b), inner("lastmod", b)) for b in re.findall(r"<(?:\w+:)?(?:url|sitemap)\b[^>]*>.*?</(?:\w+:)?(?:url|sitemap)\s*>", text, re.S | re.I)]
        found = [(u, d) for u, d in found if u] or [(plain(u), None) for u in re.findall(r"<(?:\w+:)?loc\b[^>]*>(.*?)</(?:\w+:)?loc\s*>", text, re.S | re.I)]
        return (kind, found) if found and not re.match(r"\s*<(?:!doctype html|html)", text, re.I) else ("invalid", [])
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    return ("text", [(x, None) for x in lines]) if lines and all(re.match("https?://", x, re.I) for x in lines) else ("invalid", [])


def sitemap_entries_of(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, kind, loc, lastmod of every entry of sitemap files given as bytes."""
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, form, u, d) for k, b in zip(pdf["k"], pdf["b"], strict=True) if b is not None for form, found in (sitemap_file(bytes(b)),) for u, d in found]
            yield pd.DataFrame(rows, columns=["k", "kind", "loc", "lastmod"])

    return df.select(F.col(key).alias("k"), F.col(body).alias("b")).mapInPandas(run, f"k {kind}, kind string, loc string, lastmod string").withColumnRenamed("k", key)


def sitemap_items(entries: DataFrame, key: str, host: Column) -> DataFrame:
    """key and the items of each sitemap: entries, copies, other hosts, days that can't be read, share with days."""
    a = entries.withColumn("__own", same_site(F.col("loc"), host)).groupBy(key).agg(
        F.count("*").alias("n"), F.countDistinct("loc").alias("d"), F.count_if(~F.col("__own")).alias("o"), F.count_if(F.col("lastmod").isNotNull()).alias("m"), F.count_if(F.col("lastmod").isNotNull() & F.try_to_date(F.substring("lastmod", 1, 10)).isNull()).alias("bad"))
    share = F.round(F.col("m") / F.col("n"), 3)
    return items(a, [key], [("entries", pick(F.col("n") <= 50_000, "pass", "fail"), F.col("n")), ("copies", pick(F.col("d") == F.col("n"), "pass", "warn"), F.col("n") - F.col("d")), ("other hosts", pick(F.col("o") == 0, "pass", "fail"), F.col("o")), ("unread days", pick(F.col("bad") == 0, "pass", "warn"), F.col("bad")), ("share with days", F.lit("info"), share)])


def click_depths(links: DataFrame, starts: DataFrame, most: int = 30) -> DataFrame:
    """page, depth: the fewest clicks from a start to each page it leads to, up to most. links: source, target; starts: page.

    Each round joins the pages found last with their links and leaves out pages found before; rounds are written, so lineage
    stays short. From these a sitemap is made: pages that answer 200, may be indexed and are their own canonical.
    """
    found = cut(starts.select("page", F.lit(0).alias("depth")).distinct())
    last = found
    edges = links.where("source <> target").select("source", "target").distinct()
    for depth in range(1, most + 1):
        last = cut(last.select(F.col("page").alias("source")).join(edges, "source").select(F.col("target").alias("page")).distinct().join(found.select("page"), "page", "left_anti").select("page", F.lit(depth).alias("depth")))
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def generated_sitemap(pages: DataFrame) -> DataFrame:
    """loc, lastmod of pages (url, status, noindex, canonical, last_modified) fit for a sitemap."""
    own = ~has(F.col("canonical")) | (F.regexp_replace("canonical", "/$", "") == F.regexp_replace("url", "/$", ""))
    return pages.where((F.col("status") == 200) & ~F.coalesce("noindex", F.lit(False)) & own).select(F.col("url").alias("loc"), F.col("last_modified").alias("lastmod")).distinct()


# --- redirects, status, headers

def redirect_chains(hops: DataFrame) -> DataFrame:
    """start, n_hops, codes, looped, n_temporary, downgraded, final_status, status of each chain. hops: start, step, url, status (0 for none), location, ms.

    A chain is its start's few hops, put in order in one row. It fails for a loop, a step from https to http, or an end that
    isn't 200; three hops and more, temporary codes and over two seconds are warnings.
    """
    a = hops.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("step", "url", "status", "location", "ms"))).alias("h"))
    codes = F.filter(F.transform("h", lambda x: F.when(x["status"].between(300, 399) & has(x["location"]), x["status"])), lambda c: c.isNotNull())
    looped = F.size(F.array_distinct(F.transform("h", lambda x: x["url"]))) < F.size("h")
    down = F.col("start").startswith("https://") & F.exists("h", lambda x: x["location"].startswith("http://"))
    final = F.get("h", F.size("h") - 1)["status"]
    temporary = F.size(F.filter(codes, lambda c: c.isin(302, 303, 307)))
    slow = F.aggregate("h", F.lit(0), lambda t, x: t + F.coalesce(x["ms"], F.lit(0)).cast("int")) > 2000
    status = F.when(looped | down | (final == 0) | (final >= 400), "fail").when((F.size(codes) > 2) | (temporary > 0) | (final != 200) | slow, "warn").otherwise("pass")
    return a.select("start", F.size(codes).alias("n_hops"), F.array_join(F.transform(codes, lambda c: c.cast("string")), ",").alias("codes"), looped.alias("looped"), temporary.alias("n_temporary"), F.coalesce(down, F.lit(False)).alias("downgraded"), final.alias("final_status"), status.alias("status"))


def status_items(pages: DataFrame) -> DataFrame:
    """status, kind, n of fetched pages: what each answer means for being indexed."""
    kind = F.when(F.coalesce("status", F.lit(0)) == 0, "no response").when(F.col("status") == 200, "indexable").when(F.col("status").isin(301, 308), "moved for good").when(F.col("status").between(300, 399), "moved for now").when(F.col("status").isin(404, 410), "gone").when(F.col("status") == 429, "slowed").when(F.col("status").between(400, 499), "refused").when(F.col("status") == 503, "down for now").otherwise("server error")
    return pages.groupBy(F.coalesce("status", F.lit(0)).alias("status"), kind.alias("kind")).agg(F.count("*").alias("n"))


def header(name: str) -> Column:
    return F.try_element_at("headers", F.lit(name))


def header_items(df: DataFrame, by: list[str]) -> DataFrame:
    """by and the items of response headers (headers: map of names in lower case): type, caching, compression, robots, links, cookies, server."""
    h = header
    return items(df, by, [
        ("content-type", pick(h("content-type").rlike("(?i)charset="), "pass", "warn"), h("content-type")), ("cache-control", pick(has(h("cache-control")), "pass", "warn"), h("cache-control")),
        ("content-encoding", pick(h("content-encoding").rlike("(?i)br|gzip|zstd|deflate"), "pass", "warn"), h("content-encoding")), ("x-robots-tag", F.when(h("x-robots-tag").rlike("(?i)noindex|none"), "fail").when(has(h("x-robots-tag")), "info"), h("x-robots-tag")),
        ("last-modified or etag", pick(has(h("last-modified")) | has(h("etag")), "pass", "info"), F.coalesce(h("last-modified"), h("etag"))), ("vary", F.when(h("vary").contains("*"), "warn").when(has(h("vary")), "info"), h("vary")), ("server", F.when(has(h("server")), "info"), h("server")),
    ])


def security_score(df: DataFrame, by: list[str]) -> DataFrame:
    """by, score (0 to 100), grade by protections in headers: 25 each for transport and content policy (less for short or lax ones), 15 each for sniffing and framing, 10 each for referrers and permissions."""
    h = header
    age = F.coalesce(F.regexp_extract(h("strict-transport-security"), r"(?i)max-age\s*=\s*\"?(\d+)", 1).try_cast("long"), F.lit(0))
    csp = h("content-security-policy")
    score = (
        F.when(has(h("strict-transport-security")), F.when(age >= 15_552_000, 25).otherwise(12)).otherwise(0) + F.when(has(csp), F.when(csp.rlike("unsafe-inline|unsafe-eval"), 15).otherwise(25)).otherwise(0)
        + F.when(F.lower(h("x-content-type-options")) == "nosniff", 15).otherwise(0) + F.when(has(h("x-frame-options")) | csp.rlike("(?i)frame-ancestors"), 15).otherwise(0)
        + F.when(has(h("referrer-policy")) & ~h("referrer-policy").rlike("unsafe-url"), 10).otherwise(0) + F.when(has(h("permissions-policy")), 10).otherwise(0)
    )
    return df.select(*by, score.alias("score"), F.when(score >= 90, "A").when(score >= 70, "B").when(score >= 50, "C").when(score >= 30, "D").otherwise("F").alias("grade"))


def hsts_items(df: DataFrame, by: list[str]) -> DataFrame:
    """by and the items of a transport policy (hsts, http_status, http_location): present, age of a year, subdomains, preload, redirect of http."""
    raw = F.col("hsts")
    age = F.coalesce(F.regexp_extract(raw, r"(?i)max-age\s*=\s*\"?(\d+)", 1).try_cast("long"), F.lit(0))
    moved = F.col("http_status").between(300, 399) & F.col("http_location").startswith("https://")
    return items(df, by, [
        ("present", pick(has(raw), "pass", "fail"), raw), ("max-age", F.when(age >= 31_536_000, "pass").when(age >= 15_552_000, "warn").when(has(raw), "fail").otherwise("info"), age), ("includeSubDomains", F.when(raw.rlike("(?i)includesubdomains"), "pass").when(has(raw), "warn").otherwise("info"), raw.rlike("(?i)includesubdomains")),
        ("preload", pick(raw.rlike(r"(?i)(?:^|;)\s*preload"), "pass", "info"), raw.rlike(r"(?i)(?:^|;)\s*preload")), ("redirect", F.when(moved, "pass").when(F.coalesce("http_status", F.lit(0)) == 0, "info").otherwise("fail"), F.col("http_status")),
    ])


def meta_robots_items(df: DataFrame, by: list[str]) -> DataFrame:
    """by and what a page's directives (robots, x_robots) and its robots file (crawlable) come to: indexing, links, crawling against noindex."""
    d = F.lower(F.concat_ws(",", "robots", F.when(~F.col("x_robots").rlike(r"(?i)^\s*(?!googlebot)[a-z-]+bot\s*:"), F.col("x_robots"))))
    said = lambda w: d.rlike(rf"(?:^|[,\s:])(?:{w}|none)(?:[,\s]|$)")
    can = F.coalesce("crawlable", F.lit(True))
    return items(df, by, [("indexing", pick(said("noindex"), "fail", "pass"), d), ("links", pick(said("nofollow"), "warn", "pass"), d), ("robots.txt", F.when(can, "pass").when(said("noindex"), "fail").otherwise("warn"), can)])


# --- pages

def title_items(df: DataFrame, by: list[str]) -> DataFrame:
    """by and the items of title and description: lengths and estimated widths, 580 and 920 pixels at most."""
    t, d = X.collapsed(F.col("title")), X.collapsed(F.col("description"))
    wt, wd = X.estimated_pixels(t), X.estimated_pixels(d, 14)
    return items(df, by, [("title", F.when(t == "", "fail").when(wt > 580, "warn").otherwise("pass"), wt), ("title length", F.when(t == "", "fail").when(F.length(t).between(20, 60), "pass").otherwise("warn"), F.length(t)), ("description", F.when(d == "", "warn").when(wd > 920, "warn").otherwise("pass"), wd)])


def meta_items(df: DataFrame, by: list[str]) -> DataFrame:
    """title_items and the other tags of the head: viewport, robots, canonical, language, icon."""
    more = items(df, by, [("viewport", pick(F.col("viewport").rlike(r"(?i)width\s*=\s*device-width"), "pass", "fail"), F.col("viewport")), ("robots", pick(F.col("robots").rlike("(?i)noindex|none"), "fail", "pass"), F.col("robots")), ("canonical", F.when(F.col("n_canonicals") > 1, "fail").when(has(F.col("canonical")), "pass").otherwise("warn"), F.col("canonical")), ("lang", pick(has(F.col("lang")), "pass", "warn"), F.col("lang")), ("icon", pick(F.col("has_favicon"), "pass", "warn"), F.col("has_favicon"))])
    return title_items(df, by).unionByName(more)


def onpage_items(df: DataFrame, by: list[str]) -> DataFrame:
    """meta_items and the page's body: headings, words, pictures, links, marked-up data."""
    h1 = F.size("h1s")
    more = items(df, by, [("h1", F.when(h1 == 1, "pass").when(h1 == 0, "fail").otherwise("warn"), h1), ("words", F.when(F.col("n_words") >= 300, "pass").when(F.col("n_words") >= 100, "warn").otherwise("fail"), F.col("n_words")), ("alt texts", F.when(F.col("n_missing_alt") == 0, "pass").when(F.col("n_missing_alt") <= 0.3 * F.col("n_images"), "warn").otherwise("fail"), F.col("n_missing_alt")), ("links", pick(F.size("links") >= 3, "pass", "warn"), F.size("links")), ("types", F.when(F.col("n_json_ld_errors") > 0, "fail").when(F.size("json_ld_types") > 0, "pass").otherwise("warn"), F.array_join("json_ld_types", ","))])
    return meta_items(df, by).unionByName(more)


def og_items(df: DataFrame, by: list[str]) -> DataFrame:
    """by and the items of Open Graph tags (og map, canonical): title, type, url, image, description, site name, url against canonical."""
    v = lambda k: F.try_element_at("og", F.lit(k))
    trim = lambda c: F.regexp_replace(c, "/$", "")
    return items(df, by, [
        *((k, F.when(has(v(k)), "pass").otherwise("warn" if k == "type" else "fail"), v(k)) for k in ("title", "type", "url", "image")), ("description", F.when(~has(v("description")), "warn").when(F.length(v("description")) > 200, "warn").otherwise("pass"), F.length(v("description"))), ("site_name", pick(has(v("site_name")), "pass", "info"), v("site_name")),
        ("url and canonical", F.when(has(v("url")) & has(F.col("canonical")), pick(trim(v("url")) == trim(F.col("canonical")), "pass", "warn")), v("url")), ("image address", F.when(has(v("image")), pick(v("image").rlike("(?i)^https?://"), "pass", "fail")), v("image")),
    ])


def twitter_items(df: DataFrame, by: list[str]) -> DataFrame:
    """by and the items of card tags (twitter and og maps, status): the card's kind, title, description, picture, site, answer."""
    t = lambda k: F.try_element_at("twitter", F.lit(k))
    o = lambda k: F.try_element_at("og", F.lit(k))
    card = t("card")
    return items(df, by, [("card", F.when(card.isin("summary", "summary_large_image", "app", "player"), "pass").when(has(card), "fail").otherwise("warn"), card), ("title", pick(has(F.coalesce(t("title"), o("title"))), "pass", "fail"), F.coalesce(t("title"), o("title"))), ("description", pick(has(F.coalesce(t("description"), o("description"))), "pass", "info"), F.coalesce(t("description"), o("description"))), ("image", pick(has(F.coalesce(t("image"), o("image"))), "pass", "warn"), F.coalesce(t("image"), o("image"))), ("site", pick(has(t("site")), "pass", "info"), t("site")), ("answer", pick(F.col("status") == 200, "pass", "fail"), F.col("status"))])


def preview(df: DataFrame, by: list[str]) -> DataFrame:
    """by, title, description, image, site: what a shared link shows: Open Graph tags, then card tags, then the page's own, then its host."""
    v = lambda *cs: F.coalesce(*(F.when(has(c), c) for c in cs))
    og, tw = lambda k: F.try_element_at("og", F.lit(k)), lambda k: F.try_element_at("twitter", F.lit(k))
    return df.select(*by, v(og("title"), tw("title"), F.col("title")).alias("title"), v(og("description"), tw("description"), F.col("description")).alias("description"), v(og("image"), tw("image")).alias("image"), v(og("site_name"), url_host(F.col("url"))).alias("site"))


def facebook_items(df: DataFrame, by: list[str]) -> DataFrame:
    """by and the items a social crawler needs (og map, status): its answer and five tags."""
    v = lambda k: F.try_element_at("og", F.lit(k))
    return items(df, by, [("answer", pick(F.col("status") == 200, "pass", "fail"), F.col("status")), *((k, pick(has(v(k)), "pass", "fail" if k in ("title", "image") else "warn"), v(k)) for k in ("url", "title", "description", "image", "type"))])


def html_items(df: DataFrame, by: list[str], html: str) -> DataFrame:
    """by and the items of a page's source: document type, charset early, language, one title, one body, copied ids, old tags, size."""
    h = F.coalesce(F.col(html), F.lit(""))
    n = lambda p: F.regexp_count(h, F.lit(f"(?i){p}"))
    ids = F.regexp_extract_all(h, F.lit(r"(?i)\sid\s*=\s*[\"']([^\"']+)[\"']"), 1)
    return items(df, by, [("doctype", pick(h.rlike(r"(?i)^\s*<!doctype html"), "pass", "fail"), n("<!doctype")), ("charset", pick(F.substring(h, 1, 1024).rlike("(?i)<meta[^>]+charset"), "pass", "warn"), n("charset")), ("lang", pick(h.rlike(r"(?i)<html[^>]+\blang="), "pass", "warn"), n(r"<html[^>]+\blang=")), ("title", pick(n("<title") == 1, "pass", "warn"), n("<title")), ("body", pick(n("<body") <= 1, "pass", "fail"), n("<body")), ("copied ids", pick(F.size(ids) == F.size(F.array_distinct(ids)), "pass", "warn"), F.size(ids) - F.size(F.array_distinct(ids))), ("old tags", pick(n("<(?:font|center|marquee|frameset|blink)[ >]") == 0, "pass", "warn"), n("<(?:font|center|marquee|frameset|blink)[ >]")), ("size", pick(F.length(h) <= 2_000_000, "pass", "warn"), F.length(h))])


def source_facts(df: DataFrame, by: list[str], html: str) -> DataFrame:
    """by, n_chars, n_lines, n_scripts, n_styles, n_comments, n_frames, n_inline_styles of a page's source."""
    h = F.coalesce(F.col(html), F.lit(""))
    n = lambda p: F.regexp_count(h, F.lit(f"(?is){p}"))
    return df.select(*by, F.length(h).alias("n_chars"), F.size(F.split(h, "\n")).alias("n_lines"), n("<script[ >]").alias("n_scripts"), n("<style[ >]|<link[^>]+stylesheet").alias("n_styles"), n("<!--.*?-->").alias("n_comments"), n("<iframe[ >]").alias("n_frames"), n(r"\sstyle\s*=").alias("n_inline_styles"))


def crawler_view(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """by and how a crawler's answer (b) differs from a browser's (a): status, words (half or less fails), title, robots, links. Both: by, status, n_words, title, robots, n_links."""
    j = a.alias("a").join(b.alias("b"), by)
    ratio = F.try_divide(F.col("b.n_words"), F.col("a.n_words"))
    same = lambda c: pick(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), "pass", "warn")
    return items(j, by, [("status", pick(F.col("a.status").eqNullSafe(F.col("b.status")), "pass", "fail"), F.col("b.status")), ("words", F.when(ratio.isNull() | (ratio >= 0.8), "pass").when(ratio > 0.5, "warn").otherwise("fail"), F.round(ratio, 3)), ("title", same("title"), F.col("b.title")), ("robots", same("robots"), F.col("b.robots")), ("links", pick(F.col("b.n_links") >= 0.5 * F.col("a.n_links"), "pass", "warn"), F.col("b.n_links"))])


def link_rows(facts: DataFrame, key: str) -> DataFrame:
    """key, kind (internal, external), target, host, n of each page's distinct links: the extractor's table."""
    row = lambda c, kind: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("target")))
    each = facts.select(key, F.inline(F.concat(row(F.col("links"), "internal"), row(F.col("externals"), "external"))))
    return each.groupBy(key, "kind", "target").agg(F.count("*").alias("n")).select(key, "kind", "target", url_host(F.col("target")).alias("host"), "n")


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, words, characters, characters_no_space, sentences, paragraphs, minutes (at 238 words) of texts; nulls count as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.size(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{M}\p{N}]+(?:['’\-][\p{L}\p{M}\p{N}]+)*"), 0))
    return df.select(key, words.alias("words"), F.length(t).alias("characters"), F.length(F.regexp_replace(t, r"\s", "")).alias("characters_no_space"), X.sentence_count(t).alias("sentences"), F.size(F.filter(F.split(t, r"\n\s*\n"), lambda p: F.trim(p) != "")).alias("paragraphs"), F.when(words > 0, F.greatest(F.lit(1), F.ceil(words / 238))).otherwise(0).cast("int").alias("minutes"))


def llms_items(df: DataFrame, by: list[str], text: str, status: str) -> DataFrame:
    """by and the items of an llms file: found, its title in the first lines, summary, sections, links, size."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, r"\r?\n")
    found = (F.col(status) == 200) & ~t.rlike(r"(?i)^\s*<(!doctype|html)")
    title = F.array_position(F.transform(lines, lambda x: x.rlike(r"^#\s+\S")), True)
    if_ = lambda s: F.when(found, s)
    n = F.regexp_count(t, F.lit(r"(?m)^##\s+\S"))
    links = F.regexp_count(t, F.lit(r"\[[^\]]+\]\(https?://[^)\s]+\)"))
    return items(df, by, [("file", pick(found, "pass", "fail"), F.col(status)), ("title", if_(F.when(title == 0, "fail").when(title > 4, "warn").otherwise("pass")), title), ("summary", if_(pick(t.rlike(r"(?m)^>\s*\S"), "pass", "warn")), t.rlike(r"(?m)^>\s*\S")), ("sections", if_(pick(n > 0, "pass", "warn")), n), ("links", if_(pick(links > 0, "pass", "warn")), links), ("size", if_(F.when(F.octet_length(t) > 204_800, "warn")), F.octet_length(t))])


def submission_items(df: DataFrame, by: list[str]) -> DataFrame:
    """by and the items of an address submission (host, key, key_status, key_body, urls): the key's form, its file, addresses of the host."""
    ok = F.col("key").rlike("^[a-zA-Z0-9-]{8,128}$")
    own = F.filter("urls", lambda u: same_site(u, F.col("host")))
    return items(df, by, [("key", pick(ok, "pass", "fail"), F.col("key")), ("key file", pick((F.col("key_status") == 200) & (F.trim("key_body") == F.col("key")), "pass", "fail"), F.col("key_status")), ("addresses", pick(F.size(own) > 0, "pass", "fail"), F.size(own))])


def vitals_items(df: DataFrame, by: list[str]) -> DataFrame:
    """by and the bands of real users' and lab measures: lcp, inp, cls, ttfb, fcp; those missing are left out."""
    limits = (("lcp", 2500, 4000), ("inp", 200, 500), ("cls", 0.1, 0.25), ("ttfb", 800, 1800), ("fcp", 1800, 3000))
    return items(df, by, [(k, F.when(F.col(k).isNotNull(), F.when(F.col(k) <= good, "pass").when(F.col(k) <= poor, "warn").otherwise("fail")), F.col(k)) for k, good, poor in limits])


def mobile_items(df: DataFrame, by: list[str]) -> DataFrame:
    """by and the items of a page's use on phones: viewport, zoom, letter and target sizes (scores), width of its parts."""
    v = F.coalesce(F.col("viewport"), F.lit(""))
    band = lambda c: F.when(F.col(c).isNotNull(), F.when(F.col(c) >= 0.9, "pass").when(F.col(c) >= 0.5, "warn").otherwise("fail"))
    return items(df, by, [("viewport", F.when(v.rlike(r"(?i)width\s*=\s*device-width"), "pass").when(v != "", "warn").otherwise("fail"), v), ("zoom", pick(v.rlike(r"(?i)user-scalable\s*=\s*(?:no|0)|maximum-scale\s*=\s*1(?:\.0)?\b"), "warn", "pass"), v), ("letters", band("font_size"), F.col("font_size")), ("targets", band("tap_targets"), F.col("tap_targets")), ("width", band("content_width"), F.col("content_width"))])


def image_size(b: bytes) -> tuple[str | None, int | None, int | None]:
    """Format, width and height of a picture from its first bytes: PNG, GIF, JPEG, WebP, ICO, AVIF and SVG."""
    big, little = lambda at, n: int.from_bytes(b[at : at + n], "big"), lambda at, n: int.from_bytes(b[at : at + n], "little")
    if b.startswith(b"\x89PNG") and len(b) >= 24:
        return "png", big(16, 4), big(20, 4)
    if b.startswith(b"GIF") and len(b) >= 10:
        return "gif", little(6, 2), little(8, 2)
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30:
        if b[12:16] == b"VP8X":
            return "webp", little(24, 3) + 1, little(27, 3) + 1
        if b[12:16] == b"VP8 ":
            return "webp", little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF
        bits = little(21, 4)
        return ("webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1) if b[12:16] == b"VP8L" else ("webp", None, None)
    if b.startswith(b"\xff\xd8"):
        at = 2
        while at + 9 < len(b):
            if b[at] != 0xFF:
                at += 1
            elif 0xC0 <= b[at + 1] <= 0xCF and b[at + 1] not in (0xC4, 0xC8, 0xCC):
                return "jpeg", big(at + 7, 2), big(at + 5, 2)
            else:
                at += 2 + big(at + 2, 2)
        return "jpeg", None, None
    if b[:4] in (b"\0\0\1\0", b"\0\0\2\0"):
        sizes = [(b[o] or 256, b[o + 1] or 256) for o in range(6, min(len(b) - 1, 6 + 16 * min(little(4, 2), 32)), 16)]
        return ("ico", *max(sizes)) if sizes else ("ico", None, None)
    if b[4:8] == b"ftyp" and b[8:12] in (b"avif", b"avis"):
        at = b.find(b"ispe")
        return ("avif", big(at + 8, 4), big(at + 12, 4)) if at > 0 else ("avif", None, None)
    head = b[:2048].decode("utf-8", "replace")
    if re.search(r"<svg[\s>]", head, re.I):
        size = [re.search(rf"<svg[^>]*\b{k}=[\"']?(\d+)", head, re.I) for k in ("width", "height")]
        box = re.search(r"viewBox=[\"']?\s*[\d.-]+[\s,]+[\d.-]+[\s,]+([\d.]+)[\s,]+([\d.]+)", head, re.I)
        return "svg", *(int(m[1]) if m else int(float(box[i + 1])) if box else None for i, m in enumerate(size))
    return None, None, None


def image_facts(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, format, width, height, bytes of pictures given as bytes."""
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(k, *(image_size(bytes(b)) if b is not None else (None, None, None)), None if b is None else len(b)) for k, b in zip(pdf["k"], pdf["b"], strict=True)], columns=["k", "format", "width", "height", "bytes"], dtype=object)

    return df.select(F.col(key).alias("k"), F.col(body).alias("b")).mapInPandas(run, f"k {kind}, format string, width int, height int, bytes long").withColumnRenamed("k", key)


def og_image_items(pictures: DataFrame, by: list[str]) -> DataFrame:
    """by and the items of a shared picture (status, format, width, height, bytes): loads, known format, 1200 by 630, ratio near 1.91, at most 8 MB."""
    w, h = F.col("width"), F.col("height")
    ratio = F.try_divide(w, h)
    return items(pictures, by, [("loads", pick(F.col("status") == 200, "pass", "fail"), F.col("status")), ("format", F.when(F.col("format").isin("png", "jpeg", "gif", "webp"), "pass").otherwise("warn"), F.col("format")), ("size", F.when((w >= 1200) & (h >= 630), "pass").when((w >= 600) & (h >= 315), "warn").otherwise("fail"), F.concat_ws("x", w, h)), ("ratio", pick(F.abs(ratio - 1.91) <= 0.2, "pass", "warn"), F.round(ratio, 2)), ("bytes", F.when(F.col("bytes") <= 8 * 1024 * 1024, "pass").otherwise("fail"), F.col("bytes"))])


def favicon_items(icons: DataFrame, by: list[str]) -> DataFrame:
    """by and the items of a site's icons (declared, status, format, width, height; one row an icon): declared, one loads, square of 8 at least, of 48 or a drawing."""
    square = F.col("format").isin("svg", "ico") | (F.col("width") == F.col("height"))
    ok = (F.col("status") == 200) & F.col("format").isNotNull()
    a = icons.groupBy(*by).agg(F.count_if("declared").alias("d"), F.count_if(ok).alias("n"), F.count_if(ok & square & (F.col("format").isin("svg") | (F.col("width") >= 8))).alias("m"), F.count_if(ok & square & (F.col("format").isin("svg") | (F.col("width") >= 48))).alias("g"))
    return items(a, by, [("declared", pick(F.col("d") > 0, "pass", "warn"), F.col("d")), ("loads", pick(F.col("n") > 0, "pass", "fail"), F.col("n")), ("least", pick(F.col("m") > 0, "pass", "fail"), F.col("m")), ("size", pick(F.col("g") > 0, "pass", "warn"), F.col("g"))])


# What each type of marked-up data must and should have; a bar stands between choices.
FIELDS = {
    "Article": ("", "headline image datePublished dateModified author"), "NewsArticle": ("", "headline image datePublished dateModified author"), "BlogPosting": ("", "headline image datePublished dateModified author"), "BreadcrumbList": ("itemListElement", ""),
    "Event": ("name startDate location", "description endDate eventStatus eventAttendanceMode image offers organizer performer"), "FAQPage": ("mainEntity", ""), "HowTo": ("name step", "image totalTime supply tool"), "JobPosting": ("title description datePosted hiringOrganization jobLocation|applicantLocationRequirements", "baseSalary employmentType validThrough"),
    "LocalBusiness": ("name address", "telephone url geo openingHoursSpecification priceRange"), "Organization": ("", "name url logo sameAs contactPoint address"), "Product": ("name offers|review|aggregateRating", "image description brand sku"), "Offer": ("price|priceSpecification priceCurrency", "availability url priceValidUntil"),
    "Recipe": ("name image", "author datePublished description recipeIngredient recipeInstructions totalTime"), "Review": ("author reviewRating itemReviewed", "datePublished reviewBody"), "AggregateRating": ("ratingValue ratingCount|reviewCount", "bestRating itemReviewed"), "SoftwareApplication": ("name offers aggregateRating|review", "applicationCategory operatingSystem"),
    "WebApplication": ("name offers aggregateRating|review", "applicationCategory operatingSystem"), "VideoObject": ("name thumbnailUrl uploadDate", "description contentUrl|embedUrl duration"), "Course": ("name description provider", "offers hasCourseInstance"), "ClaimReview": ("claimReviewed reviewRating url", "author itemReviewed"),
    "Dataset": ("name description", "url creator license"), "Quiz": ("hasPart", "about educationalLevel"), "SpecialAnnouncement": ("name datePosted", "text expires"), "WebSite": ("", "name url alternateName"), "Person": ("", "name url sameAs"),
}
RETIRED = ("FAQPage", "HowTo", "Course", "ClaimReview", "Quiz", "SpecialAnnouncement")
DATE_FIELDS = ("datePublished", "dateModified", "startDate", "endDate", "uploadDate", "datePosted", "validThrough")


def schema_fields(nodes: DataFrame) -> DataFrame:
    """record_id, node, type, field, level of what typed objects lack: 'required' or 'recommended' fields, and 'date' for days that can't be read.

    nodes: the adjacency table of JSON texts (shred: record_id, doc, node, owner, label, ordinal, kind, scalar). An object's
    children are grouped by their owner, so each object is judged by its own labels. Types without rules have no rows.
    """
    child = nodes.where("owner is not null and node <> owner")
    here = child.where("scalar is not null or kind in ('object', 'array')").where("not (kind = 'string' and scalar = '')")
    own = here.groupBy("record_id", "doc", F.col("owner").alias("node")).agg(F.collect_set("label").alias("labels"), F.collect_set(F.when((F.col("label") == "@type") & (F.col("kind") == "string"), F.col("scalar"))).alias("types"), F.collect_set(F.when(F.col("label").isin(*DATE_FIELDS) & (F.col("kind") == "string") & F.try_to_date(F.substring("scalar", 1, 10)).isNull(), F.col("label"))).alias("dates"))
    rules = F.create_map(*(x for t, (must, should) in FIELDS.items() for x in (F.lit(t), F.struct(F.array(*map(F.lit, must.split())).cast("array<string>").alias("must"), F.array(*map(F.lit, should.split())).cast("array<string>").alias("should")))))
    typed = own.select("record_id", "node", "labels", "dates", F.explode("types").alias("type")).withColumn("r", F.try_element_at(rules, F.col("type"))).where("r is not null")
    lacking = lambda specs: F.filter(specs, lambda s: ~F.exists(F.split(s, r"\|"), lambda k: F.array_contains("labels", k)))
    rows = lambda fields, level: F.transform(fields, lambda f: F.struct(f.alias("field"), F.lit(level).alias("level")))
    return typed.select("record_id", "node", "type", F.inline(F.concat(rows(lacking(F.col("r.must")), "required"), rows(lacking(F.col("r.should")), "recommended"), rows(F.col("dates"), "date"))))


def rich_results(fields: DataFrame, typed: DataFrame) -> DataFrame:
    """record_id, type, n, eligible: objects of each type, and those that lack no required field and whose type is still shown. typed: record_id, node, type."""
    broken = fields.where("level in ('required', 'date')").select("record_id", "node", "type").distinct().withColumn("broken", F.lit(True))
    j = typed.where(F.col("type").isin(*FIELDS)).join(broken, ["record_id", "node", "type"], "left")
    return j.groupBy("record_id", "type").agg(F.count("*").alias("n"), F.count_if(F.col("broken").isNull() & ~F.col("type").isin(*RETIRED)).alias("eligible"))


# Weights of the readiness grade.
READINESS = {"search-bots": 20, "live": 15, "ssr": 15, "index": 10, "entity": 10, "structure": 10, "meta": 5, "sitemap": 5, "https": 5, "llms": 5}


def readiness(df: DataFrame, by: list[str]) -> DataFrame:
    """by, score (0 to 100), verdict of a page's readiness to be cited, by fixed weights.

    df: n_bots, n_bots_blocked, n_live, n_live_blocked, n_words, status, robots, canonical, url, n_entity (of name, url, logo,
    sameAs), first_words, n_questions, has_faq, n_lists, title, description, has_sitemap, has_llms.
    """
    w, c = READINESS, F.col
    part = lambda k, bad, n: round_up_half(w[k] * (1 - F.coalesce(F.try_divide(F.coalesce(c(bad), F.lit(0)), c(n)), F.lit(0.0))))
    yes = lambda cond, pts: F.when(F.coalesce(cond, F.lit(False)), pts).otherwise(0)
    own = ~has(c("canonical")) | (F.regexp_replace("canonical", "/$", "") == F.regexp_replace("url", "/$", ""))
    score = (
        part("search-bots", "n_bots_blocked", "n_bots") + part("live", "n_live_blocked", "n_live") + F.when(c("n_words") >= 200, w["ssr"]).when(c("n_words") >= 80, 8).otherwise(0)
        + yes((c("status") == 200) & ~F.coalesce(c("robots").rlike("(?i)noindex|none"), F.lit(False)), 7) + yes(own, 3) + round_up_half(w["entity"] * F.coalesce("n_entity", F.lit(0)) / 4)
        + yes(c("first_words").between(12, 70), 4) + yes((c("n_questions") >= 2) | c("has_faq"), 3) + yes(c("n_lists") >= 2, 3) + yes(has(c("title")), 3) + yes(has(c("description")), 2)
        + yes(c("has_sitemap"), w["sitemap"]) + yes(c("url").startswith("https://"), w["https"]) + yes(c("has_llms"), w["llms"])
    )
    capped = F.least(score, F.lit(100)).cast("int")
    return df.select(*by, capped.alias("score"), F.when(capped >= 80, "pass").when(capped >= 55, "warn").otherwise("fail").alias("verdict"))
