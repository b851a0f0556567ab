"""Networks, concentration, agreement, differences and coverage over labelled rows."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewise.functions.exprs import grade, safe_ratio


def co_mention_edges(df: DataFrame, answer: str, brand: str) -> DataFrame:
    """brand_a < brand_b and n, the answers that name both.

    Each answer's distinct brands pair with each other inside the answer's row, so the work follows the sum of squares
    of brands per answer; nulls and empty names are left out.
    """
    sets = df.where(F.col(brand) != "").groupBy(answer).agg(F.array_sort(F.collect_set(brand)).alias("b"))
    pairs = F.flatten(F.transform("b", lambda x, i: F.transform(F.slice("b", i + 2, F.size("b")), lambda y: F.struct(x.alias("brand_a"), y.alias("brand_b")))))
    return sets.where("size(b) > 1").select(F.inline(pairs)).groupBy("brand_a", "brand_b").agg(F.count("*").alias("n"))


def co_mention_network(df: DataFrame, answer: str, brand: str, prompt: str, engine: str, recommended: Column) -> tuple[DataFrame, DataFrame]:
    """Edges: brand_a, brand_b, co_mention_count, answer_ids (joined by ;, in order); nodes: brand, answer_count, prompt_count, engine_count, recommended_answer_count.

    recommended: whether a row recommends its brand; an answer with one such row counts. Names are taken without blanks
    at their ends. answer_ids is as long as the edge's answers: for reports of few answers.
    """
    rows = df.select(F.col(answer).alias("answer"), F.trim(brand).alias("brand"), F.col(prompt).alias("prompt"), F.col(engine).alias("engine"), F.coalesce(recommended, F.lit(False)).alias("recommended")).where("brand <> ''")
    nodes = rows.groupBy("brand").agg(F.countDistinct("answer").alias("answer_count"), F.countDistinct("prompt").alias("prompt_count"), F.countDistinct("engine").alias("engine_count"), F.countDistinct(F.when(F.col("recommended"), F.col("answer"))).alias("recommended_answer_count"))
    sets = rows.groupBy("answer").agg(F.array_sort(F.collect_set("brand")).alias("b")).where("size(b) > 1")
    pairs = F.flatten(F.transform("b", lambda x, i: F.transform(F.slice("b", i + 2, F.size("b")), lambda y: F.struct(x.alias("brand_a"), y.alias("brand_b")))))
    edges = sets.select("answer", F.inline(pairs)).groupBy("brand_a", "brand_b").agg(F.count("*").alias("co_mention_count"), F.array_join(F.array_sort(F.collect_list("answer")), ";").alias("answer_ids"))
    return edges, nodes


def co_mention_nodes(df: DataFrame, brand: str, counts: dict[str, str]) -> DataFrame:
    """brand and the number of distinct values of each column in counts (name to column)."""
    return df.where(F.col(brand) != "").groupBy(F.col(brand).alias("brand")).agg(*(F.countDistinct(c).alias(n) for n, c in counts.items()))


def concentration(df: DataFrame, by: list[str], source: str) -> DataFrame:
    """by, total, n_sources, top_1, top_3, hhi, hhi_10000, effective: how far sources concentrate; shares have 6 digits.

    Sources are counted before any grouping; sums give the rest, and of each group only the three greatest counts are
    ordered (ties by source).
    """
    if not by:
        return concentration(df.select(F.lit(0).alias("__all"), source), ["__all"], source).drop("__all")
    n = df.where(F.col(source).isNotNull()).groupBy(*by, source).agg(F.count("*").alias("n"))
    a = n.groupBy(*by).agg(F.sum("n").alias("total"), F.count("*").alias("n_sources"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    first = n.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), source))).where("place <= 3")
    top = first.groupBy(*by).agg(F.max("n").alias("a"), F.sum("n").alias("b"))
    j = a.alias("x").join(top.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by])
    h = F.col("squares") / (F.col("total").cast("double") * F.col("total"))
    r = lambda x: F.round(x, 6)
    return j.select(*(F.col(f"x.{c}").alias(c) for c in by), "total", "n_sources", r(F.col("a") / F.col("total")).alias("top_1"), r(F.col("b") / F.col("total")).alias("top_3"), r(h).alias("hhi"), F.round(h * 10000, 2).alias("hhi_10000"), F.round(1 / h, 5).alias("effective"))


def confusion(df: DataFrame, a: str, b: str, labels: list[str]) -> DataFrame:
    """One row per label of a: label and the counts of b's labels."""
    return df.where(F.col(a).isin(labels) & F.col(b).isin(labels)).groupBy(F.col(a).alias("label")).pivot(b, labels).count().na.fill(0)


def kappa(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, n, observed, expected, kappa (6 digits; null where expected is 1) of two codings; rows with a null are left out."""
    if not by:
        return kappa(df.select(F.lit(0).alias("__all"), a, b), ["__all"], a, b).drop("__all")
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    side = lambda c: cells.groupBy(*by, F.col(c).alias("label")).agg(F.sum("n").alias(f"n_{c}"))
    both = side("a").join(side("b"), [*by, "label"], "full").groupBy(*by).agg(F.sum(F.coalesce("n_a", F.lit(0)).cast("double") * F.coalesce("n_b", F.lit(0))).alias("e"))
    agree = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    j = agree.join(both, by)
    po, pe = F.col("same") / F.col("n"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    return j.select(*by, "n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.when(F.abs(1 - pe) > 1e-9, F.round((po - pe) / (1 - pe), 6)).alias("kappa"))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, change ('added', 'removed', 'changed'), field, old, new: one row per key added or removed, and per field that differs.

    Keys are unique in each; fields are compared as text, null being the empty text.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    a = before.select(*keys, F.struct(*(text(F.col(f)).alias(f) for f in fields)).alias("a"))
    b = after.select(*keys, F.struct(*(text(F.col(f)).alias(f) for f in fields)).alias("b"))
    j = a.join(b, keys, "full")
    row = lambda change, field, old, new: F.struct(F.lit(change).alias("change"), F.lit(field).alias("field"), old.alias("old"), new.alias("new"))
    none = F.lit("")
    whole = F.when(F.col("a").isNull(), F.array(row("added", "", none, none))).when(F.col("b").isNull(), F.array(row("removed", "", none, none)))
    each = F.filter(F.array(*(row("changed", f, F.col(f"a.{f}"), F.col(f"b.{f}")) for f in fields)), lambda x: x["old"] != x["new"])
    return j.select(*keys, F.inline(F.coalesce(whole, each)))


def answer_diff(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str], sets: dict[str, str]) -> DataFrame:
    """keys, change_type, field, before, after: records on one side only, fields that differ, and members that sets gained or lost.

    sets: name of a change to the array column whose members it is about ('citation_domain' gives
    citation_domain_addition and _removal). Null fields and sets are empty.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    side = lambda df, n: df.select(*keys, F.struct(*(text(F.col(f)).alias(f) for f in fields), *(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))).alias(c) for c in sets.values())).alias(n))
    j = side(before, "a").join(side(after, "b"), keys, "full")
    row = lambda change, field, old, new: F.struct(change.alias("change_type"), F.lit(field).alias("field"), old.alias("before"), new.alias("after"))
    there = lambda c: F.when(F.col(c).isNull(), "missing").otherwise("present")
    whole = F.when(F.col("a").isNull() | F.col("b").isNull(), F.array(row(F.lit("prompt_set_gap"), "record", there("a"), there("b"))))
    each = F.filter(F.array(*(row(F.lit("field_change"), f, F.col(f"a.{f}"), F.col(f"b.{f}")) for f in fields)), lambda x: x["before"] != x["after"])
    for name, c in sets.items():
        gained = F.transform(F.array_except(f"b.{c}", f"a.{c}"), lambda d: row(F.lit(f"{name}_addition"), name, F.lit(""), d))  # noqa: B023
        lost = F.transform(F.array_except(f"a.{c}", f"b.{c}"), lambda d: row(F.lit(f"{name}_removal"), name, d, F.lit("")))  # noqa: B023
        each = F.concat(each, gained, lost)
    return j.select(*keys, F.inline(F.coalesce(whole, each)))


def coverage(df: DataFrame, dimensions: list[str], requirements: DataFrame, status: str | None = None) -> DataFrame:
    """dimension, value, minimum, n, met: how many rows have each required value of each dimension; of rows whose status is 'active' if a status column is given."""
    df = df.where(F.trim(status) == "active") if status else df
    long = df.select(F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), F.trim(F.col(d).cast("string")).alias("value")) for d in dimensions)))).groupBy("dimension", "value").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return requirements.join(long, ["dimension", "value"], "left").select("dimension", "value", "minimum", n.alias("n"), (n >= F.col("minimum")).alias("met"))


def unrecognised(df: DataFrame, dimensions: list[str], requirements: DataFrame, status: str | None = None) -> DataFrame:
    """dimension, value: values of active rows that no requirement names; empty and null values are none."""
    df = df.where(F.trim(status) == "active") if status else df
    long = df.select(F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), F.trim(F.col(d).cast("string")).alias("value")) for d in dimensions)))).where("value <> ''").distinct()
    return long.join(requirements.select("dimension", "value").distinct(), ["dimension", "value"], "left_anti")


def coverage_errors(prompts: DataFrame, dimensions: list[str], requirements: DataFrame) -> DataFrame:
    """code, value of what keeps prompts (prompt_id, status and dimensions) and requirements (texts) from being audited; no rows if nothing does."""
    row = lambda code, value: (F.lit(code).alias("code"), value.alias("value"))
    again = prompts.groupBy(F.trim("prompt_id").alias("v")).agg(F.count("*").alias("n")).where("n > 1").select(*row("duplicate_prompt_id", F.col("v")))
    status = prompts.select(F.trim("status").alias("v")).where(~F.coalesce("v", F.lit("")).isin("active", "disabled", "excluded")).distinct().select(*row("unknown_status", F.col("v")))
    least = F.col("minimum").cast("string").try_cast("int")
    foreign = requirements.where(~F.trim("dimension").isin(*dimensions)).select(*row("unknown_dimension", F.trim("dimension")))
    bad = requirements.where(least.isNull() | (least < 0)).select(*row("invalid_minimum", F.concat_ws("=", F.trim("dimension"), F.trim("value"))))
    return again.unionByName(status).unionByName(foreign).unionByName(bad)


def row_errors(df: DataFrame, rules: dict[str, tuple[str, Column]], key: str, order: str) -> DataFrame:
    """code, field, row, value, first_row: each broken rule of each row, and 'duplicate_key' for rows after the first of their key, which first_row names.

    rules: code to (field, condition that breaks it). A null condition breaks nothing. The first row of a key is found
    by an aggregation and joined back, so no key's rows are gathered; of rows alike in key and order all but one come out.
    """
    broken = F.array(*(F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.col(field).cast("string").alias("value"))) for code, (field, cond) in rules.items()))
    rows = df.select(F.col(order).alias("row"), F.inline(F.filter(broken, lambda x: x.isNotNull())))
    keyed = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(order).alias("row"))
    counted = keyed.groupBy("__key", "row").agg(F.count("*").alias("c"))
    first = counted.groupBy("__key").agg(F.min("row").alias("first_row"), F.sum("c").alias("n")).where("n > 1")
    copies = F.col("c") - (F.col("row") == F.col("first_row")).cast("int")
    again = counted.join(first, "__key").withColumn("c", copies).where("c > 0").withColumn("c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
    none = F.lit(None).cast(df.schema[order].dataType)
    return rows.select("code", "field", "row", "value", none.alias("first_row")).unionByName(again.select(F.lit("duplicate_key").alias("code"), F.lit(key).alias("field"), "row", F.col("__key").cast("string").alias("value"), "first_row"))


def audit_row_errors(rows: DataFrame) -> DataFrame:
    """code, field, row, value, first_row of answer rows read as text, row being their line: run_id, answer_status, brand_mentioned, brand_recommended, citation_count."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    t = rows.select("row", *(clean(c).alias(c) for c in ("run_id", "answer_status", "citation_count")), *(F.lower(clean(c)).alias(c) for c in ("brand_mentioned", "brand_recommended")))
    on, off = F.col("answer_status") == "available", F.col("answer_status") == "unavailable"
    count = F.col("citation_count").try_cast("int")
    issue = lambda code, field, value: F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), value.alias("value"))
    found = F.array(
        F.when(F.col("run_id") == "", issue("blank_run_id", "", F.lit(None).cast("string"))), F.when(~on & ~off, issue("invalid_answer_status", "", F.col("answer_status"))),
        *(F.when(on & ~F.col(f).isin("true", "false"), issue("invalid_boolean", f, F.col(f))) for f in ("brand_mentioned", "brand_recommended")),
        *(F.when(off & (F.col(f) != ""), issue("unavailable_field_must_be_blank", f, F.col(f))) for f in ("brand_mentioned", "brand_recommended")),
        F.when(on & (count.isNull() | (count < 0)), issue("invalid_citation_count", "", F.col("citation_count"))), F.when(~on & (F.col("citation_count") != ""), issue("unavailable_field_must_be_blank", "citation_count", F.col("citation_count"))),
    )
    broken = t.select("row", F.inline(F.filter(found, lambda x: x.isNotNull())))
    keyed = t.where("run_id <> ''").select("run_id", "row")
    first = keyed.groupBy("run_id").agg(F.min("row").alias("first_row"), F.count("*").alias("n")).where("n > 1")
    again = keyed.join(first, "run_id").where("row > first_row")
    out = broken.select("code", "field", "row", "value", F.lit(None).cast("int").alias("first_row"))
    return out.unionByName(again.select(F.lit("duplicate_run_id").alias("code"), F.lit("").alias("field"), "row", F.col("run_id").alias("value"), "first_row"))


def set_agreement(df: DataFrame, group: str, run: str, item: str) -> DataFrame:
    """group, n_runs, exact_share, mean_jaccard over pairs of a group's runs; a run is the set of its items.

    Runs with equal sets are one class with a count, so work follows the classes; two empty sets agree fully. Groups of
    one run have nulls. 6 digits.
    """
    runs = df.groupBy(group, run).agg(F.array_sort(F.collect_set(item)).alias("s"))
    classes = runs.groupBy(group, "s").agg(F.count("*").alias("c"))
    boxes = classes.groupBy(group).agg(F.collect_list(F.struct("s", "c")).alias("k"), F.sum("c").alias("n_runs"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"))
    jac = lambda x, y: F.coalesce(F.try_divide(F.size(F.array_intersect(x["s"], y["s"])).cast("double"), F.size(F.array_union(x["s"], y["s"])).cast("double")), F.lit(1.0)) * x["c"] * y["c"]
    cross = F.aggregate(F.flatten(F.transform("k", lambda x, i: F.transform(F.slice("k", i + 2, F.size("k")), lambda y: jac(x, y)))), F.lit(0.0), lambda t, v: t + v)
    pairs = F.col("n_runs") * (F.col("n_runs") - 1) / 2
    return boxes.select(group, "n_runs", F.round(F.try_divide(F.col("same"), pairs), 6).alias("exact_share"), F.round(F.try_divide(F.col("same") + cross, pairs), 6).alias("mean_jaccard"))


def set_coverage(df: DataFrame, group: str, run: str, item: str) -> DataFrame:
    """group, item, run_count, coverage (6 digits): in how many of a group's runs each item is; runs without items count in the whole."""
    runs = df.groupBy(group).agg(F.countDistinct(run).alias("n_runs"))
    items = df.where(F.col(item).isNotNull()).groupBy(group, item).agg(F.countDistinct(run).alias("run_count"))
    return items.join(runs, group).select(group, item, "run_count", F.round(F.col("run_count") / F.col("n_runs"), 6).alias("coverage"))


def sample_size(baseline: float, target: float, alpha: float, power: float) -> int:
    """Observations per group that tell two proportions apart, by the normal approximation."""
    z = NormalDist().inv_cdf
    pooled = (baseline + target) / 2
    top = z(1 - alpha / 2) * math.sqrt(2 * pooled * (1 - pooled)) + z(power) * math.sqrt(baseline * (1 - baseline) + target * (1 - target))
    return math.ceil((top / (target - baseline)) ** 2)


def weighted_mean(value: Column, weight: Column) -> Column:
    """The mean by weights; a weight that is null or not above 0 counts 1; 0 for no rows."""
    w = F.when(weight > 0, weight).otherwise(1)
    return F.coalesce(F.try_divide(F.sum(value * w), F.sum(F.when(value.isNotNull(), w))), F.lit(0.0))


def share_status(affected: Column, universe: Column, warn: float = 0.2, good: float = 0.0) -> Column:
    """na for an empty universe, pass up to a share good of affected, warn up to a share, else fail."""
    share = F.try_divide(affected.cast("double"), universe.cast("double"))
    return F.when(F.coalesce(universe, F.lit(0)) == 0, "na").when(share <= good + 1e-9, "pass").when(share <= warn + 1e-9, "warn").otherwise("fail")


def dimension_scores(checks: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """by, n, score: weighted credit (pass 1, warn one half, fail 0) of the applicable checks, 0-100; null under least checks; a failed gate caps it at 30.

    checks has by, status, weight, gate (boolean).
    """
    credit = F.when(F.col("status") == "pass", 1.0).when(F.col("status") == "warn", 0.5).otherwise(0.0)
    a = checks.where(F.col("status").isin("pass", "warn", "fail")).groupBy(*by).agg(F.count("*").alias("n"), F.sum(credit * F.col("weight")).alias("c"), F.sum("weight").alias("w"), F.max(F.col("gate") & (F.col("status") == "fail")).alias("shut"))
    score = F.floor(F.try_divide(F.col("c") * 100, F.col("w")) + 0.5)
    return a.select(*by, "n", F.when(F.col("n") >= least, F.when(F.col("shut"), F.least(score, F.lit(30))).otherwise(score)).cast("long").alias("score"))


def overall_score(dimensions: DataFrame, by: list[str], weights: dict[str, float], shut: DataFrame | None = None) -> DataFrame:
    """by, score, grade: the mean of the dimensions that have a score, by their weights; at most 40, and F, for the rows of shut (a failed gate)."""
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("dimension")]
    a = dimensions.where("score is not null").groupBy(*by).agg(F.sum(F.col("score") * w).alias("c"), F.sum(w).alias("w"))
    a = a.select(*by, F.floor(F.try_divide("c", "w") + 0.5).cast("long").alias("score"))
    if shut is None:
        return a.withColumn("grade", grade(F.col("score")))
    gated = shut.select(*by).distinct().withColumn("__shut", F.lit(True))
    j = a.join(gated, by, "left")
    capped = F.when(F.col("__shut"), F.least("score", F.lit(40))).otherwise(F.col("score"))
    return j.select(*by, capped.alias("score"), F.when(F.col("__shut"), "F").otherwise(grade(F.col("score"))).alias("grade"))


def rate_share(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Percent (1 digit) of rows with each flag, over all and by group: rollup of by; null flags leave the denominator."""
    return df.rollup(*by).agg(F.count("*").alias("n"), *(F.round(safe_ratio(F.count_if(c), F.count(c), 9) * 100, 1).alias(n) for n, c in flags.items()))
