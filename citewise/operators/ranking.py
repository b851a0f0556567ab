"""Forty sub-scores of a site in seven pillars, from its pages, query pairs, rivals, keywords, console queries, anchors and facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewise.functions import text as X
from citewise.functions.exprs import at_most, check_key, clamp, grade, jaccard, round_up_half
from citewise.operators.duplicates import classes

# Sub-scores with their weights in their pillar, pillars by kind of site, weights that kinds override.
SUBS = {
    "relevance": {"intent": 25, "coverage": 25, "gain": 20, "alignment": 15, "cannibalization": 15},
    "quality": {"experience": 22, "data": 18, "authorship": 18, "freshness": 12, "scaled": 18, "sources": 12},
    "authority": {"editorial": 18, "breadth": 18, "linkprofile": 10, "clusters": 10, "focus": 12, "internal": 10, "entity": 8, "reputation": 14},
    "winnability": {"serpweakness": 30, "difficulty": 25, "gap": 20, "striking": 10, "momentum": 15},
    "aisearch": {"overview": 30, "crawlers": 20, "citability": 25, "zeroclick": 25},
    "behavior": {"realuser": 25, "ctr": 25, "task": 20, "readability": 15, "promise": 15},
    "technical": {"crawl": 25, "onpage": 20, "cwv": 15, "mobile": 10, "https": 10, "structure": 10, "schema": 10},
}
TECHNICAL = {"crawl": "crawlability", "onpage": "onpage", "cwv": "performance", "mobile": "mobile", "https": "security", "structure": "architecture", "schema": "structured"}
PROFILES = {
    "default": {"relevance": 25, "quality": 20, "authority": 20, "winnability": 10, "aisearch": 10, "behavior": 10, "technical": 5},
    "ecommerce": {"relevance": 25, "quality": 15, "authority": 20, "winnability": 10, "aisearch": 5, "behavior": 10, "technical": 15},
    "local": {"relevance": 20, "quality": 15, "authority": 25, "winnability": 10, "aisearch": 5, "behavior": 10, "technical": 15},
    "ymyl": {"relevance": 20, "quality": 30, "authority": 20, "winnability": 10, "aisearch": 5, "behavior": 10, "technical": 5},
}
OVERRIDES = {"local": {"authority.reputation": 25}}
CONTENT_KINDS = ("article", "product", "other", "listing")
LEAST_WORDS = 300

num = lambda c: F.coalesce(c, F.lit(0))
yes = lambda c: F.coalesce(c, F.lit(False))


def score_of(x: Column) -> Column:
    """A whole number from 0 to 100, halves up; null stays null."""
    return round_up_half(clamp(x.cast("double"), 0.0, 100.0)).cast("int")


def steps(x: Column, *levels: tuple[float, float], other: float = 0.0) -> Column:
    """The points of the first level that x reaches, levels given from the greatest; other below them."""
    out = F.when(x >= levels[0][0], float(levels[0][1]))
    for least, points in levels[1:]:
        out = out.when(x >= least, float(points))
    return out.otherwise(float(other))


def under(x: Column, *levels: tuple[float, float], other: float = 0.0) -> Column:
    """The points of the first level that x doesn't exceed, levels given from the least; other above them."""
    out = F.when(x <= levels[0][0], float(levels[0][1]))
    for most, points in levels[1:]:
        out = out.when(x <= most, float(points))
    return out.otherwise(float(other))


# --- points

def gain_points(topics: Column, numbers: Column, tables: Column, images: Column, experience: Column) -> Column:
    """0 to 100: 8 for each of up to five own topics, and for more numbers, tables, own images and experience than others give."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0), F.least(num(topics), F.lit(5))) * 8 + steps(num(numbers), (5, 20), (1, 10)) + steps(num(tables), (1, 15)) + steps(num(images), (2, 15), (1, 8)) + steps(num(experience), (2, 10)))


def alignment_points(title: Column, h1: Column, early: Column) -> Column:
    part = lambda c: clamp(num(c).cast("double"), 0.0, 1.0)
    return 40 * part(title) + 30 * part(h1) + F.when(yes(early), 30.0).otherwise(0.0)


def experience_points(markers: Column, own_images: Column) -> Column:
    return F.least(num(markers), F.lit(3)) / 3 * 70 + F.when(num(own_images) >= 1, 30.0).otherwise(0.0)


def data_points(markers: Column, tables: Column, sources: Column, words: Column) -> Column:
    per_1k = F.when(num(words) > 0, num(sources) / words * 1000).otherwise(0.0)
    cited = F.when(per_1k >= 2, 40.0).when(per_1k >= 1, 25.0).when(per_1k > 0, 10.0).otherwise(0.0)
    return F.least(num(markers), F.lit(2)) / 2 * 40 + F.when(num(tables) >= 1, 20.0).otherwise(0.0) + cited


def renormalised(*terms: tuple[float, Column]) -> Column:
    """100 times the points of the terms that are known over their greatest; terms are (greatest, points or null); null without any."""
    most = reduce(lambda a, b: a + b, (F.when(p.isNotNull(), float(m)).otherwise(0.0) for m, p in terms))
    got = reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0.0)) for _, p in terms))
    return F.try_divide(100 * got, F.when(most > 0, most))


def inbound_points(share: Column) -> Column:
    return steps(share, (0.5, 100), (0.2, 70), (0.05, 40), other=10)


def brand_demand_points(volume: Column) -> Column:
    return F.when(volume >= 1000, 40.0).when(volume >= 100, 25.0).when(volume > 0, 10.0).otherwise(0.0)


def anchor_points(top_share: Column) -> Column:
    return F.when(top_share.isNotNull(), under(top_share, (0.4, 30), (0.6, 15)))


def weak_spot_points(n: Column) -> Column:
    return F.when(n <= 0, 20.0).when(n == 1, 50.0).when(n == 2, 80.0).otherwise(100.0)


def difficulty_points(kd: Column, strength: Column) -> Column:
    """By how far a keyword's difficulty exceeds the site's strength, or by the difficulty alone where that isn't known."""
    alone = under(kd, (30, 100), (45, 70), (60, 40), other=10)
    return F.when(strength.isNull(), alone).otherwise(under(kd - strength, (10, 100), (25, 70), (40, 40), other=10))


def gap_points(ratio: Column) -> Column:
    return steps(ratio, (1, 100), (0.6, 70), (0.3, 40), other=10)


def striking_points(position: Column) -> Column:
    return under(position, (3, 100), (10, 70), (20, 40), other=10)


def flesch_points(mean: Column) -> Column:
    return F.when(mean.isNull(), 35.0).otherwise(steps(mean, (60, 50), (40, 35), (30, 20), other=10))


# The share of clicks that each feature of a results page takes, and the shares of clicks by position.
ABSORBERS = ((("ai_overview",), 0.35), (("featured_snippet",), 0.2), (("answer_box",), 0.2), (("paid", "shopping"), 0.15), (("local_pack", "map"), 0.15), (("knowledge_graph",), 0.1), (("video",), 0.05), (("people_also_ask",), 0.05), (("top_stories",), 0.05))
MOST_ABSORBED = 0.85
CTR = (0.276, 0.158, 0.11, 0.084, 0.063, 0.049, 0.039, 0.033, 0.027, 0.024)
CTR_BEYOND = 0.01


def absorption(features: Column, own_snippet: Column) -> Column:
    """The share of clicks that a results page's features take, 0.85 at most; the snippet takes none where it is one's own."""
    low = F.transform(features, lambda f: F.lower(f))
    there = lambda names: F.exists(low, lambda f: f.isin(*names)) & (F.lit(names[0] != "featured_snippet") | ~yes(own_snippet))
    return F.least(F.lit(MOST_ABSORBED), reduce(lambda a, b: a + b, (F.when(there(names), w).otherwise(0.0) for names, w in ABSORBERS)))


def expected_ctr(position: Column) -> Column:
    """The share of clicks a position gets, straight between whole positions."""
    curve = F.array(*(F.lit(x) for x in (*CTR, CTR_BEYOND)))
    low = F.floor(position).cast("int")
    at = lambda i: F.get(curve, F.least(i - 1, F.lit(10)))
    return F.when(position.isNull() | (position <= 1), CTR[0]).when(position >= 11, CTR_BEYOND).otherwise(at(low) + (at(low + 1) - at(low)) * (position - low))


def ctr_points(ratio: Column) -> Column:
    return F.least(F.lit(100.0), 85 * F.greatest(F.lit(0.0), ratio))


def sources_terms(broken: Column, stale: Column, unsourced: Column) -> list[tuple[float, Column]]:
    return [(50, 50 * (1 - at_most(broken / 0.2, 1.0))), (30, 30 * (1 - stale)), (20, 20 * (1 - unsourced))]


def reputation_points(owns: Column, top3: Column, panel: Column, n_platforms: Column, rating: Column, independent: Column, negative: Column) -> Column:
    """0 to 100 from the brand's own results page (35, left out if unknown), reviews (45) and independent mentions (20), less 10 for each of up to two complaints."""
    serp = F.when(owns.isNotNull(), F.when(owns, 25.0).when(yes(top3), 15.0).otherwise(0.0) + F.when(yes(panel), 10.0).otherwise(0.0))
    reviews = steps(num(n_platforms), (2, 30), (1, 15)) + F.when(rating.isNull(), 0.0).otherwise(steps(rating, (4, 15), (3.5, 8)))
    mentions = steps(num(independent), (4, 20), (2, 10))
    most = F.when(serp.isNotNull(), 100.0).otherwise(65.0)
    return clamp(100 * (num(serp) + reviews + mentions) / most - F.least(F.lit(20), 10 * F.greatest(F.lit(0), num(negative))), 0.0, 100.0)


def authority_points(rank: Column, domains: Column, spam: Column) -> Column:
    """Six tenths from the domain's rank in bands, four from the logarithm of its referring domains, less up to 40 for spam."""
    r, s = num(rank), num(spam)
    ranked = F.when(r >= 300, 90 + 10 * F.least(F.lit(1.0), (r - 300) / 700)).when(r >= 100, 70 + 20 * (r - 100) / 200).when(r >= 30, 50 + 20 * (r - 30) / 70).otherwise(50 * r / 30)
    wide = F.least(F.lit(100.0), F.log10(1 + F.greatest(F.lit(0), num(domains))) / 4.0000434272768626 * 100)
    penalty = F.when(s > 30, 15 + 25 * F.least(F.lit(70.0), s - 30) / 70).when(s > 10, 15 * (s - 10) / 20).otherwise(0.0)
    return clamp(round_up_half(0.6 * ranked + 0.4 * wide - penalty), 0.0, 100.0)


def visibility_points(other_keywords: Column, top10: Column, index_ratio: Column) -> Column:
    """From the logarithms of non-brand keywords and top-ten rankings, and the share indexed where that is known."""
    log = lambda n, most: F.least(F.lit(100.0), F.log10(1 + F.greatest(F.lit(0), num(n))) / F.log10(F.lit(float(most))) * 100)
    two = 0.45 * log(other_keywords, 5001) + 0.35 * log(top10, 501)
    indexed = F.least(F.lit(100.0), F.greatest(F.lit(0.0), index_ratio) / 0.8 * 100)
    return clamp(F.when(index_ratio.isNull(), round_up_half(two / 0.8)).otherwise(round_up_half(two + 0.2 * indexed)), 0.0, 100.0)


def rivals_points(worst_ratio: Column) -> Column:
    """100 less 15 for each doubling of the strongest rival's lead."""
    return F.when(worst_ratio.isNotNull(), clamp(100 - F.when(worst_ratio > 1, F.least(F.lit(100.0), round_up_half(15 * F.log2(worst_ratio)))).otherwise(0.0), 0.0, 100.0))


# --- sub-scores by the table they come from; each gives site and a column a sub-score, null where it isn't measured

def content_pages(pages: DataFrame) -> DataFrame:
    """Readable pages of a content kind with at least LEAST_WORDS words of main text, no shells and no tools."""
    typed = yes(F.col("ok")) & F.col("kind").isin(*CONTENT_KINDS) & ~yes(F.col("js_shell")) & ~yes(F.col("tool"))
    return pages.withColumns({"typed": typed, "content": typed & (num(F.col("main_words")) >= LEAST_WORDS)})


def is_ymyl(hits: Column, words: Column) -> Column:
    """Three words of health, money or law, and two in a thousand."""
    return (num(hits) >= 3) & (num(words) > 0) & (num(hits) / words * 1000 >= 2)


CITABLE = ("article", "newsarticle", "blogposting", "faqpage", "howto", "product")


def citability_points() -> Column:
    """0 to 100: a short opening that uses half of the title's words, questions or a FAQ, numbers, lists or tables, types, a signed date."""
    words = F.size(F.split(F.trim(F.col("first_paragraph")), r"\s+"))
    want, have = X.topic_tokens(F.col("title")), X.topic_tokens(F.col("first_paragraph"))
    opening = (F.length(F.trim(num_text("first_paragraph"))) > 0) & (F.length("first_paragraph") < 300) & (words <= 60) & (F.size(want) > 0) & (F.size(F.array_intersect(want, have)) >= 0.5 * F.size(want))
    per_1k = F.when(num(F.col("main_words")) > 0, num(F.col("n_numbers")) / F.col("main_words") * 1000).otherwise(0.0)
    pts = [
        F.when(yes(opening), 25).otherwise(0), F.when((num(F.col("n_questions")) >= 2) | yes(F.col("has_faq")), 20).otherwise(0), F.when(per_1k >= 5, 20).when(per_1k >= 2, 10).otherwise(0),
        F.when((num(F.col("n_lists")) > 0) | (num(F.col("n_tables")) > 0), 15).otherwise(0), F.when(F.exists(F.coalesce("types", F.array().cast("array<string>")), lambda t: F.lower(t).isin(*CITABLE)), 10).otherwise(0),
        F.when(yes(F.col("byline")) & F.coalesce("date_published", "date_modified").isNotNull(), 10).otherwise(0),
    ]
    return reduce(lambda a, b: a + b, pts)


def num_text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def page_subs(pages: DataFrame, today: Column) -> DataFrame:
    """site and the sub-scores of content: experience, data, authorship, freshness, scaled, citability, readability, promise and what sources and task need.

    pages: site, ok, kind, js_shell, tool, title, types, main_words and the signals of the page reader; near_duplicate.
    One aggregation by site, but for the busiest day of publishing, which counts by day before.
    """
    p = content_pages(pages)
    c = F.col("content")
    w = num(F.col("main_words"))
    title_words = X.topic_tokens(F.col("title"))
    told = X.topic_tokens(F.concat_ws(" ", "lead_text", F.array_join(F.coalesce("heading_texts", F.array().cast("array<string>")), " ")))
    delivered = F.greatest(num(F.col("n_h2")), num(F.col("n_h3")), num(F.col("n_list_items")))
    newest = F.array_max("body_years")
    near = lambda d: F.col(d).isNotNull() & (F.col(d) <= F.date_add(today, 2)) & (F.col(d) >= F.date_sub(today, 365))
    p = p.withColumns({
        "x_exp": experience_points(F.col("n_experience"), F.col("n_own_images")), "x_data": data_points(F.col("n_original"), F.col("n_tables"), F.col("n_authoritative"), w), "x_cite": citability_points(),
        "x_ymyl": is_ymyl(F.col("n_ymyl"), w), "x_dated": F.coalesce("date_published", "date_modified").isNotNull(), "x_recent": near("date_published") | near("date_modified"), "x_old_title": yes(F.col("title_year") < F.year(today) - 1),
        "x_off": (F.size(title_words) > 0) & (F.size(F.array_intersect(title_words, told)) < 0.5 * F.size(title_words)), "x_miss": yes((F.col("title_number") >= 2) & (delivered < F.col("title_number"))), "x_year": newest,
    })
    mean = lambda e: F.avg(F.when(c, e))
    n = F.count_if(c)
    share = lambda cond: F.count_if(c & yes(cond)) / n
    per = p.groupBy("site").agg(
        n.alias("n"), mean(F.col("x_exp")).alias("experience"), mean(F.col("x_data")).alias("data"), mean(F.col("x_cite")).alias("citability"),
        share(F.col("byline")).alias("bylines"), share(F.col("author_in_schema")).alias("schemas"), share(F.col("x_ymyl")).alias("ymyl"), F.max(F.when(F.col("ok"), num(F.col("n_same_as")))).alias("same_as"), F.max(yes(F.col("ok") & F.col("is_about"))).alias("about"), F.max(yes(F.col("ok") & F.col("is_contact") & F.col("has_contact"))).alias("contact"),
        share(F.col("x_recent")).alias("recent"), share(F.col("x_dated")).alias("dated"), share(F.col("x_old_title")).alias("old_titles"),
        share(F.col("near_duplicate")).alias("dup"), F.sum(F.when(c, num(F.col("n_ai_phrases")))).alias("ai"), F.sum(F.when(c, w)).alias("words"), share(num(F.col("n_experience")) == 0).alias("bare"),
        F.count_if("typed").alias("n_typed"), F.count_if(F.col("typed") & (w < LEAST_WORDS)).alias("n_thin"),
        F.avg(F.when(c, F.col("flesch"))).alias("flesch"), F.avg(F.when(c & (F.col("paragraph_words") > 0), F.col("paragraph_words"))).alias("paragraph"), mean(w / F.greatest(F.lit(1), num(F.col("n_h2")) + num(F.col("n_h3")))).alias("per_heading"),
        share((num(F.col("n_lists")) > 0) | (num(F.col("n_tables")) > 0)).alias("scannable"), share(num(F.col("n_clickbait")) >= 2).alias("bait"), share(F.col("x_miss")).alias("missed"), share(F.col("x_off")).alias("off"),
        F.count_if(c & F.col("x_year").isNotNull()).alias("with_year"), F.count_if(c & (F.col("x_year") <= F.year(today) - 3)).alias("old_years"), share(num(F.col("n_outbound")) == 0).alias("unsourced"),
        share(num(F.col("n_next_steps")) > 0).alias("next"), F.count_if(c & (F.col("kind") == "article")).alias("articles"), F.count_if(c & (F.col("kind") == "article") & yes(F.col("has_faq"))).alias("faqs"),
        F.count_if(F.col("ok")).alias("readable"), F.count_if(F.col("ok") & (num(F.col("n_interstitials")) > 0)).alias("popups_all"), share(num(F.col("n_interstitials")) > 0).alias("popups"),
    )
    days = p.where(c & F.col("date_published").isNotNull()).groupBy("site", "date_published").agg(F.count("*").alias("d")).groupBy("site").agg(F.max("d").alias("busiest"))
    per = per.join(days, "site", "left")
    some = lambda e: F.when(F.col("n") > 0, e)
    ai_rate = F.when(F.col("words") > 0, F.col("ai") / F.col("words") * 1000).otherwise(0.0)
    thin = F.coalesce(F.try_divide(F.col("n_thin"), F.col("n_typed")), F.lit(0.0))
    burst = (F.col("n") >= 10) & (num(F.col("busiest")) / F.col("n") >= 0.4)
    tick = lambda cond, pts: F.when(yes(cond), float(pts)).otherwise(0.0)
    return per.select(
        "site", "n", "with_year", "old_years", "unsourced", "next", "articles", "faqs", "ymyl", "same_as", F.when(F.col("n") > 0, F.col("popups")).when(F.col("readable") > 0, F.col("popups_all") / F.col("readable")).alias("popups"),
        "experience", "data", "citability",
        some(40 * F.col("bylines") + 15 * F.col("schemas") + tick(F.col("about"), 15) + tick(F.col("contact"), 15) + tick(F.col("same_as") >= 2, 15) - tick((F.col("ymyl") >= 0.2) & (F.col("bylines") < 0.8), 15)).alias("authorship"),
        some(60 * F.col("recent") + 20 * F.col("dated") + 20 * (1 - F.col("old_titles"))).alias("freshness"),
        some(100 - F.col("dup") * 40 - steps(ai_rate, (3, 25), (1.5, 12)) - tick(burst, 20) - thin * 20 - tick(F.col("bare") >= 0.8, 10)).alias("scaled"),
        some(flesch_points(F.col("flesch")) + F.when(F.col("paragraph").isNull(), 10.0).otherwise(under(F.col("paragraph"), (80, 20), (120, 10))) + tick(F.col("per_heading") <= 300, 15) + 15 * F.col("scannable")).alias("readability"),
        some(100 - F.col("bait") * 50 - F.col("missed") * 30 - F.col("off") * 20).alias("promise"),
    )


def pair_subs(pairs: DataFrame, rivals: DataFrame, facts: DataFrame, today: Column) -> DataFrame:
    """site and the sub-scores of query pairs: intent, coverage, gain, alignment, overview, serpweakness, difficulty, gap; and n_pairs, early for task.

    pairs: site, query and the columns used here; rivals: site, query, position, fetched, ugc, date_modified, n_words,
    domain_rank, off_intent; facts: site, domain_rank. Rivals are the first five of a query: they are aggregated by query.
    """
    place = F.row_number().over(Window.partitionBy("site", "query").orderBy("position", "domain_rank"))
    first = rivals.withColumn("place", place).where(F.col("place") <= 5).join(facts.select("site", F.col("domain_rank").alias("own_rank")), "site", "left")
    known = yes(F.col("fetched"))
    weak = known & (yes(F.col("ugc")) | yes(F.col("date_modified") < F.add_months(today, -18)) | (num(F.col("n_words")) < 500) | yes(F.col("off_intent")) | yes(F.col("domain_rank") < 100) | yes(F.col("domain_rank") <= F.col("own_rank")))
    spots = first.groupBy("site", "query").agg(F.count_if(known).alias("n_known"), F.count_if(weak).alias("n_weak"), F.median("domain_rank").alias("rival_rank"))
    j = pairs.join(spots, ["site", "query"], "left").join(facts.select("site", F.col("domain_rank").alias("own_rank")), "site", "left")
    strength = F.when(F.col("own_rank").isNotNull(), F.least(F.lit(100.0), F.col("own_rank") / 8))
    opponent = F.coalesce(F.when(F.col("avg_top_rank") > 0, F.col("avg_top_rank")), F.col("rival_rank"))
    ratio = F.when(opponent > 0, F.col("own_rank") / opponent).when(opponent.isNotNull(), 1e9)
    compared = num(F.col("n_fetched")) > 0
    vol = F.when(F.col("volume") > 0, F.col("volume")).otherwise(1)
    full = gain_points(F.col("unique_topics"), F.col("extra_numbers"), F.col("extra_tables"), F.col("own_images"), F.col("experience"))
    alone = gain_points(F.lit(0), F.col("extra_numbers"), F.col("extra_tables"), F.col("own_images"), F.col("experience"))
    kd = F.when(F.col("kd").isNotNull(), difficulty_points(F.col("kd"), strength))
    seen = yes(F.col("overview_present")) & yes(F.col("overview_loaded"))
    return j.groupBy("site").agg(
        F.count("*").alias("n_pairs"), F.avg(yes(F.col("answer_early")).cast("int")).alias("early"), (100 * F.avg(F.col("intent_match").cast("int"))).alias("intent"),
        at_most(F.avg(clamp(F.col("coverage").cast("double"), 0.0, 1.0)) / 0.7 * 100, 100.0).alias("coverage"),
        F.coalesce(F.avg(F.when(compared, full)), F.avg(alone)).alias("gain"), F.avg(alignment_points(F.col("title_alignment"), F.col("h1_alignment"), F.col("answer_early"))).alias("alignment"),
        (100 * F.avg(F.when(seen, yes(F.col("overview_cited")).cast("int")))).alias("overview"), F.avg(F.when(F.col("n_known") >= 3, weak_spot_points(F.col("n_weak")))).alias("serpweakness"),
        (F.sum(kd * vol) / F.sum(F.when(kd.isNotNull(), vol))).alias("difficulty"), F.avg(F.when(F.col("own_rank").isNotNull() & ratio.isNotNull(), gap_points(ratio))).alias("gap"),
    )


def keyword_subs(keywords: DataFrame, pairs: DataFrame) -> DataFrame:
    """site and the sub-scores of ranked keywords: striking and zeroclick; brand_volume for entity, and deep for linkprofile.

    keywords: site, keyword, url, position, volume, brand, features, page_domains, is_home. Features of a keyword and of a
    pair's query of the same words are one; the volume is the first known.
    """
    vol = F.when(F.col("volume") > 0, F.col("volume")).otherwise(1)
    near = ~yes(F.col("brand")) & (F.col("position") >= 1)
    base = keywords.groupBy("site").agg(
        (F.sum(F.when(near, striking_points(F.col("position")) * vol)) / F.sum(F.when(near, vol))).alias("striking"), F.sum(F.when(yes(F.col("brand")), num(F.col("volume"))).otherwise(0)).alias("brand_volume"))
    urls = keywords.where(F.col("url").isNotNull() & ~yes(F.col("is_home"))).groupBy("site", check_key(F.col("url")).alias("k")).agg(F.max("page_domains").alias("d")).where("d is not null")
    deep = urls.groupBy("site").agg(F.avg((F.col("d") >= 1).cast("int")).alias("deep"))
    key = lambda c: F.lower(F.trim(c))
    ranked = keywords.where(~yes(F.col("brand"))).select("site", key("keyword").alias("k"), "volume", "features", F.lit(False).alias("own"))
    asked = pairs.where(~yes(F.col("brand"))).select("site", key("query").alias("k"), "volume", "features", yes(F.col("own_snippet")).alias("own"))
    rows = ranked.unionByName(asked).groupBy("site", "k").agg(F.array_distinct(F.flatten(F.collect_list("features"))).alias("features"), F.max("volume").alias("volume"), F.max("own").alias("own")).where(F.size("features") > 0)
    taken = rows.groupBy("site").agg((100 * (1 - F.sum(absorption(F.col("features"), F.col("own")) * vol) / F.sum(vol))).alias("zeroclick"))
    return base.join(deep, "site", "full").join(taken, "site", "full")


def console_subs(queries: DataFrame) -> DataFrame:
    """site and ctr: the clicks of non-brand queries with 50 impressions and more against those their positions promise."""
    fit = ~yes(F.col("brand")) & (F.col("impressions") >= 50) & (F.col("position") > 0)
    a = queries.where(fit).groupBy("site").agg(F.sum("clicks").alias("c"), F.sum(expected_ctr(F.col("position")) * F.col("impressions")).alias("e"))
    return a.select("site", F.when(F.col("e") > 0, ctr_points(F.col("c") / F.col("e"))).otherwise(0.0).alias("ctr"))


# Anchors that say nothing, and anchors that are addresses.
GENERIC_ANCHOR = r"(?i)^(?:click here|here|this|this link|link|website|web site|site|homepage|home page|home|read more|learn more|more|more info|source|visit|visit site|visit website|go|continue)$"
ADDRESS_ANCHOR = r"(?i)^(?:https?://|www\.)|^[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:/\S*)?$"


def anchor_kind(anchor: Column, brand_tokens: Column) -> Column:
    """generic, url, brand or keyword."""
    a = F.trim(F.coalesce(anchor, F.lit("")))
    return F.when((a == "") | a.rlike(GENERIC_ANCHOR), "generic").when(a.rlike(ADDRESS_ANCHOR), "url").when(X.is_brand_keyword(a, brand_tokens), "brand").otherwise("keyword")


def anchor_subs(anchors: DataFrame) -> DataFrame:
    """site and top_share: the share of the greatest keyword anchor in all anchors' linking domains, or links where no domains are known.

    anchors: site, anchor, backlinks, domains, brand_tokens.
    """
    a = anchors.where("anchor is not null").withColumn("kind", anchor_kind(F.col("anchor"), F.col("brand_tokens")))
    best = lambda m: F.try_divide(F.coalesce(F.max(F.when(F.col("kind") == "keyword", num(F.col(m)))), F.lit(0)), F.sum(num(F.col(m))))
    s = a.groupBy("site").agg(F.sum(num(F.col("domains"))).alias("d"), best("domains").alias("by_d"), best("backlinks").alias("by_b"))
    return s.select("site", F.when(F.col("d") > 0, F.col("by_d")).otherwise(F.col("by_b")).alias("top_share"))


def inbound_counts(pages: DataFrame) -> DataFrame:
    """site, url, inbound, others: how many other readable pages link to each page, by its address or where it leads, and how many others there are.

    pages: site, url, final_url, ok, links. Links are keyed once a page and joined with the pages' keys.
    """
    ok = pages.where("ok").withColumn("final_url", F.coalesce("final_url", "url"))
    own = ok.select("site", "url", F.explode(F.array_distinct(F.array(check_key(F.col("url")), check_key(F.col("final_url"))))).alias("key"))
    links = ok.select("site", F.col("url").alias("source"), F.explode(F.array_distinct(F.transform(F.coalesce("links", F.array().cast("array<string>")), check_key))).alias("key"))
    met = own.join(links, ["site", "key"]).where("url <> source").select("site", "url", "source").distinct().groupBy("site", "url").agg(F.count("*").alias("inbound"))
    n = ok.groupBy("site").agg((F.count("*") - 1).alias("others"))
    return ok.select("site", "url").distinct().join(met, ["site", "url"], "left").join(n, "site").select("site", "url", num(F.col("inbound")).alias("inbound"), "others")


def internal_subs(pages: DataFrame, keywords: DataFrame) -> DataFrame:
    """site and internal: the mean of inbound_points over a site's core pages, which are home, pricing, product and ranking pages; null under two readable pages."""
    ok = pages.where("ok")
    ranking = keywords.where("url is not null").select("site", check_key(F.col("url")).alias("key")).distinct().withColumn("ranks", F.lit(True))
    core = ok.select("site", "url", "kind", check_key(F.col("url")).alias("key")).join(ranking, ["site", "key"], "left").where(F.col("kind").isin("home", "pricing", "product") | F.col("ranks"))
    met = core.select("site", "url").distinct().join(inbound_counts(pages), ["site", "url"])
    return met.where("others > 0").groupBy("site").agg(F.avg(inbound_points(F.col("inbound") / F.col("others"))).alias("internal"))


def cannibal_subs(pages: DataFrame, keywords: DataFrame, console: DataFrame) -> DataFrame:
    """site and cannibalization: 100 less a third of a percent for each percent of content pages that compete with another page for a search.

    Pages compete if they have one format and 0.6 of their titles' topic words in common, if they rank for one keyword in
    any wording, or if a query of 20 impressions gives a tenth and more to each of two pages. Titles of a site meet only
    where they share a topic word. keywords: site, keyword, url, brand; console: site, query, page, impressions, brand.
    """
    p = content_pages(pages).where("content").select("site", "url", check_key(F.col("url")).alias("key"), "format", X.topic_tokens(F.col("title")).alias("t"))
    n = p.groupBy("site").agg(F.count("*").alias("n")).where("n > 1")
    words = p.where("size(t) > 0").select("site", "key", "format", "t", F.explode("t").alias("w"))
    other = words.select("site", "format", "w", F.col("key").alias("key2"), F.col("t").alias("t2"))
    alike = words.join(other, ["site", "format", "w"]).where((F.col("key") < F.col("key2")) & (jaccard(F.col("t"), F.col("t2")) >= 0.6))
    by_title = alike.select("site", "key").unionByName(alike.select("site", F.col("key2").alias("key")))
    ranked = keywords.where(~yes(F.col("brand")) & F.col("url").isNotNull()).select("site", X.keyword_key(F.col("keyword")).alias("k"), check_key(F.col("url")).alias("key")).where("k <> ''").distinct()
    many = ranked.groupBy("site", "k").agg(F.count("*").alias("c")).where("c > 1")
    by_word = ranked.join(many, ["site", "k"]).select("site", "key")
    split = console.where(~yes(F.col("brand"))).groupBy("site", "query", check_key(F.col("page")).alias("key")).agg(F.sum("impressions").alias("i"))
    total = split.groupBy("site", "query").agg(F.sum("i").alias("t")).where("t >= 20")
    big = split.join(total, ["site", "query"]).where("i >= 0.1 * t")
    two = big.groupBy("site", "query").agg(F.count("*").alias("c")).where("c > 1")
    by_query = big.join(two, ["site", "query"]).select("site", "key")
    involved = by_title.unionByName(by_word).unionByName(by_query).distinct().join(p.select("site", "key").distinct(), ["site", "key"], "left_semi").groupBy("site").agg(F.count("*").alias("x"))
    return n.join(involved, "site", "left").select("site", (100 - F.least(F.lit(100.0), num(F.col("x")) / F.col("n") / 0.3 * 100)).alias("cannibalization"))


def cluster_subs(pages: DataFrame) -> DataFrame:
    """site and clusters: the share of content pages in a topic cluster, full from 0.6; null under five content pages.

    A cluster is three and more content pages with a topic word in common that are linked to each other in any number of
    steps, either way. Links between pages with a common word are the edges; classes of linked pages are found for each word.
    """
    p = content_pages(pages).where("content").withColumn("final_url", F.coalesce("final_url", "url"))
    p = p.select("site", "url", "links", F.array_distinct(F.array(check_key(F.col("url")), check_key(F.col("final_url")))).alias("keys"), X.topic_tokens(F.concat_ws(" ", "title", F.array_join(F.coalesce("h1s", F.array().cast("array<string>")), " "))).alias("t"))
    n = p.groupBy("site").agg(F.count("*").alias("n")).where("n >= 5")
    own = p.select("site", "url", F.explode("keys").alias("key"))
    links = p.select("site", F.col("url").alias("source"), F.explode(F.array_distinct(F.transform(F.coalesce("links", F.array().cast("array<string>")), check_key))).alias("key"))
    pairs = links.join(own, ["site", "key"]).where("source <> url").select("site", F.least("source", "url").alias("a"), F.greatest("source", "url").alias("b")).distinct()
    words = p.select("site", "url", F.explode("t").alias("w"))
    both = pairs.join(words.withColumnRenamed("url", "a"), ["site", "a"]).join(words.withColumnRenamed("url", "b"), ["site", "b", "w"])
    node = lambda c: F.concat_ws("\u0001", F.col("site").cast("string"), "w", c)
    found = classes(both.select(node("a").alias("a"), node("b").alias("b")))
    large = found.groupBy("class").agg(F.count("*").alias("c")).where("c >= 3")
    inside = found.join(large, "class").select(F.split("node", "\u0001").alias("s")).select(F.get("s", F.lit(0)).alias("site"), F.get("s", F.lit(2)).alias("url")).distinct().groupBy("site").agg(F.count("*").alias("x"))
    j = n.withColumn("__s", F.col("site").cast("string")).join(inside.withColumnRenamed("site", "__s"), "__s", "left")
    return j.select("site", F.least(F.lit(100.0), num(F.col("x")) / F.col("n") / 0.6 * 100).alias("clusters"))


def focus_subs(pages: DataFrame, sitemap_urls: DataFrame, top: int = 5) -> DataFrame:
    """site and focus: 100 less two for each percent of pages and sitemap addresses without a word of the site's core vocabulary; null for a vocabulary under five words.

    The core are the topic words of the home page's title, headings and description, of the titles of content pages one
    click away, and of the top most-linked ones. sitemap_urls: site, url; addresses already crawled are left out.
    """
    p = content_pages(pages)
    home = p.where("ok and is_entry").select("site", F.explode(X.topic_tokens(F.concat_ws(" ", "title", F.array_join(F.coalesce("h1s", F.array().cast("array<string>")), " "), "description"))).alias("w"))
    near = p.where("content and depth = 1").select("site", F.explode(X.topic_tokens(F.col("title"))).alias("w"))
    counted = p.where("content").select("site", "url", "title").join(inbound_counts(pages), ["site", "url"]).where("inbound > 0")
    most = counted.withColumn("r", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("inbound"), "url"))).where(F.col("r") <= top).select("site", F.explode(X.topic_tokens(F.col("title"))).alias("w"))
    core = home.unionByName(near).unionByName(most).distinct()
    size = core.groupBy("site").agg(F.count("*").alias("size")).where("size >= 5")
    own = p.where("content").select("site", check_key(F.col("url")).alias("key"), X.topic_tokens(F.concat_ws(" ", "title", F.array_join(F.coalesce("h1s", F.array().cast("array<string>")), " "))).alias("t")).where("size(t) > 0")
    crawled = p.where("ok").select("site", check_key(F.col("url")).alias("key")).distinct()
    more = sitemap_urls.select("site", check_key(F.col("url")).alias("key"), X.slug_topic(F.col("url")).alias("t")).where("t is not null").dropDuplicates(["site", "key"]).join(crawled, ["site", "key"], "left_anti")
    items = own.unionByName(more.select("site", "key", "t")).withColumn("id", F.monotonically_increasing_id())
    on = items.select("site", "id", F.explode("t").alias("w")).join(core, ["site", "w"], "left_semi").select("id").distinct().withColumn("on", F.lit(True))
    a = items.join(on, "id", "left").groupBy("site").agg(F.avg(F.col("on").isNull().cast("int")).alias("off"))
    return a.join(size, "site").select("site", (100 * (1 - F.least(F.lit(1.0), F.col("off") / 0.5))).alias("focus"))


def brand_vote(names: DataFrame, domains: DataFrame) -> DataFrame:
    """site, brand, brand_key, share, matches: the name most of a site's pages give, as it is most often written; ties go to the domain's label, then to the key.

    names: site, url, name (of the organisation, the site or the title's end); domains: site, domain. share is the part of
    the site's pages with a name that matches it.
    """
    n = names.withColumn("k", X.organisation_key(F.col("name"))).where("length(k) > 1")
    label = domains.select("site", X.domain_label(F.col("domain")).alias("label"))
    counted = n.groupBy("site", "k").agg(F.countDistinct("url").alias("n")).join(label, "site")
    fits = X.keys_match(F.col("k"), F.col("label"))
    best = counted.withColumn("fits", fits).withColumn("r", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), F.desc("fits"), "k"))).where("r = 1").select("site", F.col("k").alias("brand_key"), F.col("fits").alias("matches"))
    written = n.groupBy("site", "k", F.trim("name").alias("name")).agg(F.count("*").alias("c")).groupBy("site", F.col("k").alias("brand_key")).agg(F.min_by("name", F.struct(-F.col("c"), "name")).alias("brand"))
    pages = names.groupBy("site").agg(F.countDistinct("url").alias("pages"))
    same = n.join(best, "site").where(X.keys_match(F.col("k"), F.col("brand_key"))).groupBy("site").agg(F.countDistinct("url").alias("same"))
    return best.join(written, ["site", "brand_key"]).join(pages, "site").join(same, "site").select("site", "brand", "brand_key", (F.col("same") / F.col("pages")).alias("share"), "matches")


def fact_subs(f: DataFrame) -> DataFrame:
    """site and the sub-scores of a site's facts and of what other tables left in them, all columns of f.

    f: site, authority (known), domain_rank, referring_domains, backlinks, spam_score, body_share, platform_share, gained_domains,
    lost_domains, top_share, deep, visibility (known), brand_volume, brand_share, brand_matches, same_as, owns, top3, panel,
    n_platforms, rating, independent, negative, reputation_known, robots_missing, bots_known, bots_blocked, js_dependent,
    clicks, clicks_before, impressions, impressions_before, console, n_new, n_up, n_down, n_lost, field_lcp, field_inp,
    field_cls, outbound_checked, outbound_broken, with_year, old_years, unsourced, n, n_pairs, early, next, articles, faqs, popups.
    """
    c = F.col
    known, seen = yes(c("authority")), yes(c("visibility"))
    loc, plat = at_most(c("body_share") / 0.6 * 60, 60.0), at_most(c("platform_share") / 0.6 * 40, 40.0)
    none = (num(c("backlinks")) == 0) & (num(c("referring_domains")) == 0)
    growth = F.try_divide(num(c("gained_domains")), num(c("gained_domains")) + num(c("lost_domains")))
    entity = F.when((c("brand_share") >= 0.8) & yes(c("brand_matches")), 40.0).otherwise(0.0) + F.when(num(c("same_as")) >= 2, 20.0).otherwise(0.0)
    allowed = F.when(yes(c("robots_missing")), 70.0).otherwise(F.try_divide(num(c("bots_known")) - num(c("bots_blocked")), c("bots_known")) * 70)
    shell = F.when(c("js_dependent").isNotNull(), F.when(c("js_dependent"), 0.0).otherwise(30.0))
    change = lambda now, before: F.when(c(before) > 0, (c(now) - c(before)) / c(before) * 100).otherwise(100.0)
    by_clicks, by_impressions = num(c("clicks")) + num(c("clicks_before")) >= 20, num(c("impressions")) + num(c("impressions_before")) >= 200
    moved = num(c("n_new")) + num(c("n_up")) + num(c("n_down")) + num(c("n_lost"))
    rising = 50 + 50 * F.try_divide(num(c("n_new")) + num(c("n_up")) - num(c("n_down")) - num(c("n_lost")), moved)
    from_change = lambda x: clamp(50 + x / 40 * 50, 0.0, 100.0)
    band = lambda v, good, poor: F.when(v.isNotNull(), F.when(v <= good, 1.0).when(v <= poor, 0.5).otherwise(0.0))
    vitals = F.filter(F.array(band(c("field_lcp"), 2500, 4000), band(c("field_inp"), 200, 500), band(c("field_cls"), 0.1, 0.25)), lambda x: x.isNotNull())
    some = c("n") > 0
    return f.select(
        "site",
        F.when(known & none, 0.0).when(known, renormalised((60, loc), (40, plat))).alias("editorial"),
        F.when(known, authority_points(c("domain_rank"), c("referring_domains"), c("spam_score"))).alias("breadth"),
        renormalised((40, F.when(known, 40 * growth)), (30, F.when(known, anchor_points(c("top_share")))), (30, F.when(seen, 30 * c("deep")))).alias("linkprofile"),
        F.when(c("brand_share").isNotNull(), F.when(seen, entity + brand_demand_points(num(c("brand_volume")))).otherwise(entity / 60 * 100)).alias("entity"),
        F.when(yes(c("reputation_known")), reputation_points(c("owns"), c("top3"), c("panel"), c("n_platforms"), c("rating"), c("independent"), c("negative"))).alias("reputation"),
        F.when(yes(c("console")) & by_clicks, from_change(change("clicks", "clicks_before"))).when(yes(c("console")) & by_impressions, from_change(change("impressions", "impressions_before"))).when(seen, rising).alias("momentum"),
        renormalised((70, allowed), (30, shell)).alias("crawlers"),
        F.when(F.size(vitals) > 0, 100 * F.aggregate(vitals, F.lit(0.0), lambda a, x: a + x) / F.size(vitals)).alias("realuser"),
        renormalised(*sources_terms(F.when(c("outbound_checked") >= 5, F.least(F.lit(1.0), c("outbound_broken") / c("outbound_checked"))), F.try_divide(c("old_years"), c("with_year")), F.when(some, c("unsourced")))).alias("sources"),
        renormalised((40, F.when(c("n_pairs") > 0, 40 * c("early"))), (30, F.when(some, 30 * c("next"))), (15, 15 * F.try_divide(c("faqs"), c("articles"))), (15, 15 * (1 - c("popups")))).alias("task"),
    )


def long_subs(*wide: DataFrame) -> DataFrame:
    """site, pillar, sub, score (whole, null where not measured) of wide tables of sub-scores; columns of other names are left out."""
    pillar_of = {s: p for p, subs in SUBS.items() for s in subs}
    out = None
    for df in wide:
        own = [c for c in df.columns if c in pillar_of]
        part = df.select("site", F.inline(F.array(*(F.struct(F.lit(pillar_of[s]).alias("pillar"), F.lit(s).alias("sub"), score_of(F.col(s)).alias("score")) for s in own))))
        out = part if out is None else out.unionByName(part)
    return out


def technical_subs(dimensions: DataFrame) -> DataFrame:
    """site, pillar, sub, score: the on-site dimensions' scores (site, dimension, score) as sub-scores."""
    name = F.create_map(*(F.lit(x) for s, d in TECHNICAL.items() for x in (d, s)))[F.col("dimension")]
    return dimensions.select("site", F.lit("technical").alias("pillar"), name.alias("sub"), F.col("score").cast("int").alias("score")).where("sub is not null")


def site_profiles(pages: DataFrame) -> DataFrame:
    """site, profile: ymyl, local, ecommerce or default, by the first that holds: three tenths of content pages on health, money or law; a home page or two pages of a
    local business; a fifth of pages or five with offers, or a cart with a fifth of pages of products or below shop paths. pages as in page_subs, with links."""
    p = content_pages(pages)
    types = F.transform(F.coalesce("types", F.array().cast("array<string>")), lambda t: F.lower(t))
    has = lambda *names: F.exists(types, lambda t: t.isin(*names))
    local = F.exists(types, lambda t: t.isin(*X.LOCAL_TYPES))
    sells = has("product", "productgroup", "productmodel", "individualproduct", "someproducts") | (has("offer", "aggregateoffer") & ~has("softwareapplication", "webapplication", "mobileapplication", "videogame"))
    path = F.lower(X.path_of(F.col("url")))
    cart = F.exists(F.coalesce("links", F.array().cast("array<string>")), lambda u: F.lower(X.path_of(u)).rlike("/(?:cart|basket|bag|checkout)(?:/|$)"))
    ok = F.col("ok")
    a = p.groupBy("site").agg(
        F.try_divide(F.count_if(F.col("content") & is_ymyl(F.col("n_ymyl"), F.col("main_words"))), F.count_if("content")).alias("y"), F.count_if(ok).alias("n"), F.max(ok & (F.col("kind") == "home") & local).alias("home_local"), F.count_if(ok & local).alias("n_local"),
        F.count_if(ok & sells).alias("n_sells"), F.max(ok & cart).alias("cart"), F.count_if(ok & (F.col("format") == "product")).alias("n_products"), F.count_if(ok & path.rlike("/(?:products?|shop|collections)/|/cart(?:/|$)")).alias("n_shop"),
    )
    shop = (F.col("n_sells") >= 5) | (F.col("n_sells") >= 0.2 * F.col("n")) | (((F.col("n_sells") > 0) | yes(F.col("cart"))) & ((F.col("n_products") >= 0.2 * F.col("n")) | (F.col("n_shop") >= 0.2 * F.col("n"))))
    return a.select("site", F.when(F.col("y") >= 0.3, "ymyl").when(yes(F.col("home_local")) | (F.col("n_local") >= 2), "local").when((F.col("n") > 0) & shop, "ecommerce").otherwise("default").alias("profile"))


def _weights() -> Column:
    """The weight of a sub-score by profile: an override, the rest of its pillar scaled to what is left."""
    out: dict[str, float] = {}
    for profile in PROFILES:
        over = OVERRIDES.get(profile, {})
        for pillar, subs in SUBS.items():
            fixed = {s: over[f"{pillar}.{s}"] for s in subs if f"{pillar}.{s}" in over}
            rest = sum(w for s, w in subs.items() if s not in fixed)
            scale = (sum(subs.values()) - sum(fixed.values())) / rest if fixed else 1.0
            for s, w in subs.items():
                out[f"{profile}|{pillar}.{s}"] = float(fixed.get(s, int(w * scale * 10 + 0.5) / 10 if fixed else w))
    return F.create_map(*(F.lit(x) for kv in out.items() for x in kv))


def pillar_scores(subs: DataFrame, profiles: DataFrame, technical: DataFrame) -> DataFrame:
    """site, pillar, score, grade: the weighted mean of a pillar's measured sub-scores, null under two; the technical pillar is the technical score (site, score, grade)."""
    j = subs.where((F.col("pillar") != "technical") & F.col("score").isNotNull()).join(profiles, "site")
    w = _weights()[F.concat("profile", F.lit("|"), "pillar", F.lit("."), "sub")]
    a = j.groupBy("site", "pillar").agg(F.count("*").alias("n"), F.sum(F.col("score") * w).alias("c"), F.sum(w).alias("w"))
    score = F.when(F.col("n") >= 2, score_of(F.col("c") / F.col("w")))
    rest = a.select("site", "pillar", score.alias("score"), grade(score).alias("grade"))
    return rest.unionByName(technical.select("site", F.lit("technical").alias("pillar"), score_of(F.col("score")).alias("score"), "grade"))


def ranking_score(pillars: DataFrame, profiles: DataFrame, shut: DataFrame) -> DataFrame:
    """site, profile, score, grade: the mean of the pillars that have a score, by the profile's weights; at most 40, and F, for the sites of shut."""
    w = F.create_map(*(F.lit(x) for p, own in PROFILES.items() for k, v in own.items() for x in (f"{p}|{k}", float(v))))[F.concat("profile", F.lit("|"), "pillar")]
    a = pillars.where("score is not null").join(profiles, "site").groupBy("site", "profile").agg((F.sum(F.col("score") * w) / F.sum(w)).alias("s"))
    j = a.join(shut.select("site").distinct().withColumn("__shut", F.lit(True)), "site", "left")
    score = F.when(F.col("__shut"), F.least(score_of(F.col("s")), F.lit(40))).otherwise(score_of(F.col("s")))
    return j.select("site", "profile", score.alias("score"), F.when(F.col("__shut"), "F").otherwise(grade(score)).alias("grade"))
