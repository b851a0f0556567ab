"""Text measures and the commonest words and phrases of texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewise.functions import exprs as X
from citewise.functions.text import sentence_count


def text_measures(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_words, n_sentences, n_syllables, reading_ease (of texts that look English, else null) of whole texts; nulls for null texts."""
    words = F.regexp_extract_all(F.col(text), F.lit(X.WORD), 0)
    rows = df.select(key, X.count_words(F.col(text)).alias("n_words"), sentence_count(F.col(text)).alias("n_sentences"), X.all_syllables(words).alias("n_syllables"), X.looks_english(F.col(text)).alias("__english"))
    return rows.withColumn("reading_ease", F.when(F.col("__english"), X.reading_ease(F.col("n_words"), F.col("n_sentences"), F.col("n_syllables")))).drop("__english")


def ngram_density(df: DataFrame, by: list[str], text: str, n: int, top: int = 15, least: int = 2) -> DataFrame:
    """by, place, ngram, count, share (of all n-grams, 4 digits): the commonest runs of n words in by, counted least times; ties by name."""
    if not by:
        return ngram_density(df.select(F.lit(0).alias("__all"), text), ["__all"], text, n, top, least).drop("__all")
    w = X.tokens(F.col(text))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))
    rows = df.select(*by, w.alias("w")).where(F.size("w") >= n).select(*by, F.explode(grams).alias("ngram"))
    c = rows.groupBy(*by, "ngram").agg(F.count("*").alias("count"))
    total = c.groupBy(*by).agg(F.sum("count").alias("total"))
    first = Window.partitionBy(*by).orderBy(F.desc("count"), "ngram")
    best = c.where(F.col("count") >= least).withColumn("place", F.row_number().over(first)).where(F.col("place") <= top)
    return best.join(total, by).select(*by, "place", "ngram", "count", F.round(F.col("count") / F.col("total"), 4).alias("share"))


# Words of visible text, what is no plain paragraph, the lengths of openings (words) and paragraphs (sentences) that are long.
VISIBLE_WORD = r"[A-Za-z0-9][A-Za-z0-9'’.-]*"
PICTURE, LINK, FENCE = r"!\[[^\]]*\]\([^)]*\)", r"\[[^\]]+\]\(([^)\s]+)\)", r"```(?:[^`]|`[^`]|``[^`])*```"
LISTED = r"^[ \t\n]*(?:#{3}|[-*]|[0-9]+\.|\||!\[)"
NOT_PLAIN = r"^[ \t\n]*(?:#|[-*]|[0-9]+\.|\||!\[|>)"
LONG_OPENING, LONG_PARAGRAPH = 75, 5


def visible_words(text: Column) -> Column:
    """How many words of a Markdown text a reader sees: no code blocks, pictures, addresses, tags and marks."""
    for pattern, to in ((FENCE, " "), (PICTURE, " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", " "), (r"https?://[^ \t\n\r]+", " "), (r"[#>*_`|-]", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.size(F.regexp_extract_all(text, F.lit(VISIBLE_WORD), 0))


def markdown_measures(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """key and of each whole Markdown text: n_words, n_pictures, n_external, n_internal (links; host is its own), n_h2, n_questions (of n_h2), n_listed (sections that open with a list, table, picture or heading), n_long_openings, n_long_paragraphs; nulls for a null text."""
    t = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    bare = F.regexp_replace(t, FENCE, "")
    links = F.regexp_extract_all(F.regexp_replace(t, PICTURE, ""), F.lit(LINK), 1)
    own = rf"^https?://(?:www\.)?{re.escape(host)}(?:[/?#]|$)"
    heads = F.regexp_extract_all(F.concat(F.lit("\n"), bare), F.lit(r"\n##[ \t]+([^\n]+)"), 1)
    parts = F.split(F.concat(F.lit("\n"), bare), r"\n##[ \t]+[^\n]+")
    opening = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: F.split(F.regexp_replace(x, r"^[ \t\n]+", ""), r"\n[ \t]*\n")[0])
    plain = F.filter(F.split(t, r"\n[ \t\n]*\n"), lambda x: ~x.rlike(NOT_PLAIN))
    count = lambda xs, f: F.size(F.filter(xs, f))
    return df.select(
        key, visible_words(t).alias("n_words"), F.size(F.regexp_extract_all(t, F.lit(r"!\[[^\]]*\]\(https?://[^)\s]+\)"), 0)).alias("n_pictures"), count(links, lambda u: u.rlike("^https://") & ~u.rlike(own)).alias("n_external"), count(links, lambda u: u.rlike("^/(?:[^/]|$)") | u.rlike(own)).alias("n_internal"),
        F.size(heads).alias("n_h2"), count(heads, lambda h: h.rlike(r"\?[ \t]*$")).alias("n_questions"), count(opening, lambda o: o.rlike(LISTED)).alias("n_listed"), count(opening, lambda o: ~o.rlike(LISTED) & (visible_words(o) > LONG_OPENING)).alias("n_long_openings"),
        count(plain, lambda x: F.size(F.regexp_extract_all(x, F.lit(r"[.!?](?:[ \t\n]|$)"), 0)) > LONG_PARAGRAPH).alias("n_long_paragraphs"),
    )


# Words that no n-gram begins or ends with, and words as the page tools count them, with inner apostrophes and hyphens.
STOP_WORDS = tuple(
    "a an and are as at be but by for from has have he her his i if in into is it its me my no not of on or our she so than that the their them then there these they this to too us was we were what when where which who "
    "why will with you your can do does did just also more most about over up out all any been being both each few how only other own same some such very s t now one get".split()
)
PHRASE_WORD = r"[\p{L}\p{M}\p{N}]+(?:['’\-][\p{L}\p{M}\p{N}]+)*"
# the same words without a way back into the group: Java goes one call deeper at each hyphen else, and a word of 2,000 of them ends the executor
_JAVA_PHRASE_WORD = PHRASE_WORD + "+"


def phrase_density(df: DataFrame, by: list[str], text: str, top: int = 15, least: int = 2) -> DataFrame:
    """by, n, place, ngram, count, share (of all words, count * n / words, 4 digits): the commonest runs of 1, 2 and 3 words in by.

    A run neither begins nor ends with a stop word and holds no number and no word of one letter. Runs counted least
    times come out, top of each n; ties by name. Each word gives at most three rows, combined before the shuffle.
    """
    w = F.regexp_extract_all(F.lower(text), F.lit(_JAVA_PHRASE_WORD), 0)
    after = lambda n: F.slice("w", n, F.greatest(F.size("w"), F.lit(1)))
    words = df.select(*by, w.alias("w")).where(F.size("w") > 0)
    words = words.select(*by, F.explode(F.arrays_zip(F.col("w").alias("a"), after(2).alias("b"), after(3).alias("c"))).alias("z")).select(*by, "z.a", "z.b", "z.c")
    edge = lambda c: ~F.col(c).isin(*STOP_WORDS)
    fine = lambda c: (F.length(c) >= 2) & ~F.col(c).rlike("^[0-9]+$")
    words = words.select(*by, "a", "b", "c", *((edge(x) & fine(x)).alias(f"{x}_edge") for x in "abc"), fine("b").alias("b_fine"))
    grams = [
        F.when(F.col("a_edge"), F.col("a")),
        F.when(F.col("a_edge") & F.col("b_edge"), F.concat_ws(" ", "a", "b")),
        F.when(F.col("a_edge") & F.col("b_fine") & F.col("c_edge"), F.concat_ws(" ", "a", "b", "c")),
    ]
    # words that are no n-gram stay as nulls of n = 1: the counts of n = 1 add up to all words
    rows = words.select(*by, F.inline(F.array(*(F.struct(F.lit(i + 1).alias("n"), g.alias("ngram")) for i, g in enumerate(grams))))).where("n = 1 or ngram is not null")
    c = rows.groupBy(*by, "n", "ngram").agg(F.count("*").alias("count"))
    # both sides read c as it is, with no filter that would be pushed below its exchange, so that it is made once
    total = c.groupBy(*by).agg(F.sum(F.when(F.col("n") == 1, F.col("count"))).alias("words"))
    first = Window.partitionBy(*by, "n").orderBy(F.desc("count"), "ngram")
    best = c.where(F.when(F.col("ngram").isNotNull(), F.col("count")).otherwise(0) >= max(least, 1)).withColumn("place", F.row_number().over(first)).where(F.col("place") <= top)
    joined = best.alias("x").join(total.alias("y"), [F.col(f"x.{b}").eqNullSafe(F.col(f"y.{b}")) for b in by])
    return joined.select(*(F.col(f"x.{b}").alias(b) for b in by), "n", "place", "ngram", "count", F.round(F.col("count") * F.col("n") / F.col("words"), 4).alias("share"))
