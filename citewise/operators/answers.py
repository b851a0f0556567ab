"""Analytics of engine answers: rates, rank and visibility scores, competitors, gaps, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewise.functions.exprs import bare, brand_key, clamp, clean_name, is_assistant, round_up_half, safe_ratio

RESULT = (
    "struct<brand: string, matrix: array<struct<engine: string, questionId: string, question: string, mentioned: boolean, rank: int, sentiment: string, usedSearch: boolean, competitorsMentioned: array<string>>>,"
    " questions: array<struct<id: string, text: string, intent: string>>>"
)
# The weight of an answer's tone.
TONE = {"positive": 1.0, "neutral": 0.85, "negative": 0.5, "absent": 0.0}


def _results(audits: DataFrame) -> DataFrame:
    """audit_id and the parsed result of each audit's latest row that has one; damaged results give none."""
    text = audits.where("result is not null").groupBy(F.col("id").alias("audit_id")).agg(F.max_by("result", "loaded_at").alias("result"))
    inner = F.when(F.col("result").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), "result", F.lit("}")), "v string")["v"]).otherwise(F.col("result"))
    whole = text.select("audit_id", inner.alias("json")).where(F.try_parse_json("json").isNotNull())
    return whole.select("audit_id", F.from_json("json", RESULT).alias("r"))


def audit_answers(audits: DataFrame) -> DataFrame:
    """The fact table: audit_id, brand, engine, question_id, question, mentioned, rank, sentiment, used_search, competitors.

    One row per answer in a result's matrix; null entries are left out. A competitor given as an object counts by its
    name.
    """
    rows = _results(audits).select("audit_id", F.col("r.brand").alias("brand"), F.explode("r.matrix").alias("m")).where("m is not null")
    names = F.filter(F.transform(F.coalesce("m.competitorsMentioned", F.array()), lambda c: F.when(c.startswith("{"), F.get_json_object(c, "$.name")).otherwise(c)), lambda c: c.isNotNull())
    return rows.select("audit_id", "brand", F.col("m.engine").alias("engine"), F.col("m.questionId").alias("question_id"), F.col("m.question").alias("question"), F.coalesce("m.mentioned", F.lit(False)).alias("mentioned"), F.col("m.rank").alias("rank"), F.col("m.sentiment").alias("sentiment"), F.col("m.usedSearch").alias("used_search"), names.alias("competitors"))


def audit_questions(audits: DataFrame) -> DataFrame:
    """audit_id, question_id, question, intent of each result's questions."""
    rows = _results(audits).select("audit_id", F.explode("r.questions").alias("q")).where("q is not null")
    return rows.select("audit_id", F.col("q.id").alias("question_id"), F.col("q.text").alias("question"), F.col("q.intent").alias("intent"))


def rates(df: DataFrame, by: list[str], metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Long table by, metric, numerator, denominator, rate (4 digits; null over 0): metrics name a condition to count and one to count it over.

    All metrics come from one aggregation, unpivoted afterwards; null conditions count as false.
    """
    sums = []
    for name, (n, d) in metrics.items():
        sums += [F.count_if(n & d).alias(f"n_{name}"), F.count_if(d).alias(f"d_{name}")]
    wide = df.groupBy(*by).agg(*sums)
    rows = F.array(*(F.struct(F.lit(name).alias("metric"), F.col(f"n_{name}").alias("numerator"), F.col(f"d_{name}").alias("denominator")) for name in metrics))
    return wide.select(*by, F.inline(rows)).withColumn("rate", safe_ratio(F.col("numerator"), F.col("denominator")))


def question_score() -> Column:
    """0 to 1: 0 if not mentioned, else the rank's factor (1 less 0.12 a place, 0.3 at least; 0.6 unranked) times the tone's."""
    place = F.when(F.col("rank") > 0, clamp(1 - (F.col("rank") - 1) * 0.12, 0.3, 1.0)).otherwise(0.6)
    tone = F.coalesce(F.create_map(*(F.lit(x) for kv in TONE.items() for x in kv))[F.col("sentiment")], F.lit(0.85))
    return F.when(F.col("mentioned"), place * tone).otherwise(0.0)


def engine_summary(answers: DataFrame, by: list[str]) -> DataFrame:
    """by, n_asked, n_mentioned, mention_rate (percent), avg_rank of ranked mentions (1 digit), visibility (0-100)."""
    ranked = F.when(F.col("mentioned") & (F.col("rank") > 0), F.col("rank"))
    agg = answers.groupBy(*by).agg(F.count("*").alias("n_asked"), F.count_if("mentioned").alias("n_mentioned"), F.avg(ranked).alias("r"), F.avg(question_score()).alias("v"))
    rate = round_up_half(F.col("n_mentioned") * 100 / F.col("n_asked"))
    return agg.select(*by, "n_asked", "n_mentioned", rate.alias("mention_rate"), round_up_half(F.col("r"), 1).alias("avg_rank"), round_up_half(F.round(F.col("v") * 100, 9)).alias("visibility"))


def competitor_mentions(answers: DataFrame) -> DataFrame:
    """One row per competitor named in an answer: audit_id, question_id, name, key, you_absent (no answer to the question names you).

    Assistants are no competitors, unless your own brand is one.
    """
    own = Window.partitionBy("audit_id", "question_id")
    rows = answers.withColumn("you_absent", ~F.max("mentioned").over(own)).select("audit_id", "question_id", "you_absent", is_assistant(F.col("brand")).alias("self"), F.explode("competitors").alias("raw"))
    named = rows.withColumn("name", clean_name(F.col("raw"))).withColumn("key", brand_key(F.col("name"))).where("key is not null")
    return named.where(F.col("self") | ~is_assistant(F.col("name"))).drop("raw", "self")


def competitor_league(answers: DataFrame, top: int = 12) -> DataFrame:
    """audit_id, place, name, mentions, n_questions, wins: competitors by wins, then mentions, then key.

    Spellings meet by brand_key; a key of five or more characters takes longer keys that go on after it at a word's end
    in one of their spellings ('Alderwick' takes 'Alderwick North'), the shortest such key that no other takes. The name
    is the commonest spelling of the key itself, then the shortest, then the first in order. wins counts mentions where
    you are absent, at most n_questions. Names are counted once, before any join.
    """
    named = competitor_mentions(answers).groupBy("audit_id", "key", "name", "question_id").agg(F.count("*").alias("n"), F.count_if("you_absent").alias("w"))
    keys = named.groupBy("audit_id", "key").agg(F.collect_set("name").alias("names"))
    short = keys.where(F.length("key") >= 5).select("audit_id", F.col("key").alias("short"), F.substring("key", 1, 5).alias("head"))
    long = keys.withColumn("head", F.substring("key", 1, 5))
    ends_word = F.concat(F.lit("^(?:[^A-Za-z0-9]*[A-Za-z0-9]){"), F.length("short").cast("string"), F.lit(r"}(?:$|[\s&,.·-])"))
    at_word = F.exists("names", lambda n: bare(n).startswith(F.col("short")) & F.regexp_like(n, ends_word))
    pairs = long.join(short, ["audit_id", "head"]).where((F.length("key") > F.length("short")) & F.col("key").startswith(F.col("short")) & at_word).select("audit_id", "key", "short")
    lost = pairs.select("audit_id", F.col("key").alias("short")).distinct()
    taken = pairs.join(lost, ["audit_id", "short"], "left_anti").groupBy("audit_id", "key").agg(F.min_by("short", F.length("short")).alias("into"))
    own = named.join(taken, ["audit_id", "key"], "left").withColumn("into", F.coalesce("into", "key"))
    stats = own.groupBy("audit_id", "into").agg(F.sum("n").alias("mentions"), F.countDistinct("question_id").alias("n_questions"), F.sum("w").alias("w"))
    spelled = own.groupBy("audit_id", "into", "name").agg(F.sum("n").alias("n"), F.max((F.col("key") == F.col("into")).cast("int")).alias("same"))
    best = spelled.groupBy("audit_id", "into").agg(F.min_by("name", F.struct(-F.col("same"), -F.col("n"), F.length("name"), "name")).alias("name"))
    place = F.row_number().over(Window.partitionBy("audit_id").orderBy(F.desc("wins"), F.desc("mentions"), "into"))
    out = stats.withColumn("wins", F.least("w", "n_questions")).withColumn("place", place).where(F.col("place") <= top)
    return out.join(best, ["audit_id", "into"]).select("audit_id", "place", "name", "mentions", "n_questions", "wins")


def picked_instead(answers: DataFrame, by: list[str], top: int = 3) -> DataFrame:
    """by, place, name, n: the competitors named most often in answers that don't name you; spellings meet by their letters and digits, ties by key."""
    rows = answers.where("not mentioned").select(*by, F.explode("competitors").alias("raw")).select(*by, F.trim("raw").alias("name"), bare(F.trim("raw")).alias("key")).where("key <> ''")
    counted = rows.groupBy(*by, "key").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "key"))
    return counted.withColumn("place", place).where(F.col("place") <= top).select(*by, "place", "name", "n")


def gap_questions(answers: DataFrame, questions: DataFrame, most: int = 6) -> DataFrame:
    """Questions in which no engine names you but some competitor is: audit_id, question_id, question, intent, n_engines, competitors (the first most in order; no assistants)."""
    agg = answers.groupBy("audit_id", "question_id").agg(F.max("mentioned").alias("any"), F.countDistinct("engine").alias("n_engines"), F.flatten(F.collect_list("competitors")).alias("c"), F.max(is_assistant(F.col("brand"))).alias("self"))
    names = F.array_sort(F.array_distinct(F.filter(F.transform("c", clean_name), lambda x: x.isNotNull() & (F.col("self") | ~is_assistant(x)))))
    gaps = agg.where("not any").withColumn("competitors", F.slice(names, 1, most)).where(F.size("competitors") > 0)
    return gaps.join(questions, ["audit_id", "question_id"]).select("audit_id", "question_id", "question", "intent", "n_engines", F.array_join("competitors", ";").alias("competitors"))


def visibility_level(answers: DataFrame, by: list[str], retrievable: str | None = None) -> DataFrame:
    """by, rate, avg_rank, memory_rate, level: 5 known without search, 4 leading, 3 named, 2 not named, 1 not found by search either.

    Memory are answers given without search: level 5 needs two of them, a rate of 80 and two mentions; level 4 a rate
    of 50 and an average rank of 2.5 or better. retrievable: a column of answers saying whether search finds the site;
    level 1 is for groups where it is false in all rows that have it.
    """
    memory = ~F.coalesce("used_search", F.lit(False))
    ranked = F.when(F.col("mentioned") & (F.col("rank") > 0), F.col("rank"))
    found = F.max(F.col(retrievable)) if retrievable else F.max(F.lit(None).cast("boolean"))
    a = answers.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("mentioned").alias("m"), F.avg(ranked).alias("r"), F.count_if(memory).alias("mem_n"), F.count_if(memory & F.col("mentioned")).alias("mem_m"), found.alias("found"))
    rate, mem = round_up_half(F.col("m") * 100 / F.col("n")), round_up_half(F.try_divide(F.col("mem_m") * 100, F.col("mem_n")))
    rank = round_up_half(F.col("r"), 1)
    level = F.when((F.col("mem_n") >= 2) & (mem >= 80) & (F.col("mem_m") >= 2), 5).when((rate >= 50) & (rank <= 2.5), 4).when(F.col("m") > 0, 3).when(~F.col("found"), 1).otherwise(2)
    return a.select(*by, rate.alias("rate"), rank.alias("avg_rank"), mem.alias("memory_rate"), level.alias("level"))


def citation_metrics(rows: DataFrame) -> DataFrame:
    """query, metric, engine, numerator, denominator, rate of answered audit rows: mentions and recommendations, and citations over all and over cited answers.

    rows: engine, answer_available, brand_mentioned, brand_recommended, cited_brand_source ('yes', 'no' or null) and
    citation_count. Rows that aren't answered count nowhere; nulls are no yes. One aggregation gives all metrics.
    """
    yes = lambda c: F.col(c) == "yes"
    every, cited = F.lit(True), F.col("citation_count") > 0
    metrics = (
        ("answer_metrics", "mention_rate", yes("brand_mentioned"), every), ("answer_metrics", "recommendation_rate", yes("brand_recommended"), every), ("answer_metrics", "answered_rows", every, every),
        ("citation_metrics", "citation_present_rate_answer", cited, every), ("citation_metrics", "brand_citation_rate_answer", yes("cited_brand_source"), every),
        ("citation_metrics", "brand_citation_rate_cited_answers", yes("cited_brand_source"), cited),
    )
    sums = [c for i, (_, _, n, d) in enumerate(metrics) for c in (F.count_if(n).alias(f"n{i}"), F.count_if(d).alias(f"d{i}"))]
    wide = rows.where(yes("answer_available")).groupBy("engine").agg(*sums)
    long = F.array(*(F.struct(F.lit(q).alias("query"), F.lit(m).alias("metric"), F.col(f"n{i}").alias("numerator"), F.col(f"d{i}").alias("denominator")) for i, (q, m, _, _) in enumerate(metrics)))
    return wide.select("engine", F.inline(long)).select("query", "metric", "engine", "numerator", "denominator", safe_ratio(F.col("numerator"), F.col("denominator")).alias("rate"))


def site_signal_score(statuses: Column) -> Column:
    """0 to 100 from an array of signals' statuses: pass 1, warn a half; null without signals."""
    points = F.aggregate(statuses, F.lit(0.0), lambda t, s: t + F.when(s == "pass", 1.0).when(s == "warn", 0.5).otherwise(0.0))
    return F.when(F.size(statuses) > 0, round_up_half(points / F.size(statuses) * 100))


def overall_visibility(engines: Column, site: Column) -> Column:
    """Three quarters the engines' score and one the site's; the one that is there where the other is null; 0 without both."""
    return F.coalesce(round_up_half(engines * 0.75 + site * 0.25), engines, site, F.lit(0)).cast("int")
