"""Small column expressions: rounding, days, hashes, JSON, clean texts and excerpts."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from citewise.functions.text import bare_host

# --- numbers


def round_even(digits: int):
    """Rounding to digits with halves of the number's exact binary value to even, as some reports round; a function of a column of doubles."""

    @F.pandas_udf(DoubleType())
    def run(x: pd.Series) -> pd.Series:
        step = Decimal(1).scaleb(-digits)
        return x.map(lambda v: None if pd.isna(v) else float(Decimal(v).quantize(step, ROUND_HALF_EVEN)) if abs(v) < 1e15 else v)

    return run


# --- days

def pacific_day(now: Column) -> Column:
    """The day that it is in the time of search consoles when it is now (UTC)."""
    return F.to_date(F.from_utc_timestamp(now.cast("timestamp"), "America/Los_Angeles"))


def console_ranges(now: Column, lag: int = 3, days: int = 28) -> Column:
    """from_day, to_day of the period that ends lag days ago, and before_from, before_to of the one before it."""
    last = F.date_sub(pacific_day(now), lag)
    return F.struct(F.date_sub(last, days - 1).alias("from_day"), last.alias("to_day"), F.date_sub(last, 2 * days - 1).alias("before_from"), F.date_sub(last, days).alias("before_to"))


def days_since(then: Column, now: Column) -> Column:
    """Whole days from then to now, downwards."""
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 86_400_000_000).cast("int")


def months_ago(now: Column, months: int) -> Column:
    """The same day of the month months before, running over into the next month where that one is too short."""
    first = F.add_months(F.trunc(now, "month"), -months)
    return F.date_add(first, F.dayofmonth(now) - 1)


# --- hashes

def row_id(*parts: Column) -> Column:
    """The SHA-1 of parts joined by |, nulls as empty."""
    return F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def day_key(secret: str):
    """For an address and a day, the first 32 digits of the HMAC-SHA256 under that day's key: the same address differs from day to day."""

    @F.pandas_udf(StringType())
    def run(address: pd.Series, day: pd.Series) -> pd.Series:
        key = {d: hashlib.sha256(f"{secret}:{d}".encode()).digest() for d in day.dropna().unique()}
        return pd.Series([None if a is None or d is None else hmac.new(key[d], a.encode(), hashlib.sha256).hexdigest()[:32] for a, d in zip(address, day, strict=True)])

    return run


# --- JSON

def merged_json(a: Column, b: Column) -> Column:
    """The object a with the members of b, which count where both have one; texts of objects in, text out. Null is empty; what is no object merges as nothing."""
    box = lambda c: F.coalesce(F.from_json(F.coalesce(c, F.lit("{}")), "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    keep = F.map_filter(box(a), lambda k, _: ~F.map_contains_key(box(b), k))
    return F.to_json(F.map_concat(keep, box(b)))


# --- texts

def clean_text(text: Column) -> Column:
    """A text without null characters; strings hold no lone surrogates here."""
    return F.replace(text, F.lit("\u0000"), F.lit(""))


@F.pandas_udf(ArrayType(StringType()))
def target_keywords(lists: pd.Series) -> pd.Series:
    """Of a list of wished keywords the first three that are left: compatible form, lower case, no quotes or control signs, single spaces, 80 characters, none twice, two characters at least."""

    def one(words) -> list[str]:
        out: list[str] = []
        for w in words if words is not None else ():
            if w is None:
                continue
            plain = "".join(" " if ord(c) < 32 or c in "\"“”‘’`<>" else c for c in unicodedata.normalize("NFKC", w.replace("\0", "")).lower())
            k = " ".join(plain.split())[:80].strip()
            if len(k) > 1 and k not in out:
                out.append(k)
            if len(out) == 3:
                break
        return out

    return lists.map(one)


# Marks of plain text formatting, in the order in which they go, and what stays of each.
MARKUP = (
    (r"(?s)```.*?```", " "), (r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"(?m)^\s{0,3}>\s?", ""), (r"(?m)^\s{0,3}[-*+]\s+", ""), (r"(?m)^\s{0,3}\d+\.\s+", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(\*\*|__)(.*?)\1", "$2"), (r"(^|[\s(])[*_](?=\S)([^*_]+?)[*_](?=[\s.,;:!?)]|$)", "$1$2"), (r"`([^`]+)`", "$1"), (r"(?m)^\s*[-*_]{3,}\s*$", " "), (r"\|", " "), (r"\s+", " "),
)


def without_markup(text: Column) -> Column:
    """A text without headings', lists', links', emphasis' and tables' marks, in single spaces."""
    out = F.coalesce(text, F.lit(""))
    for pattern, put in MARKUP:
        out = F.regexp_replace(out, pattern, put)
    return F.trim(out)


def truncated(text: Column, most: int) -> Column:
    """A text of most characters at most, the last an ellipsis if it was longer."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "").when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def slug(text: Column) -> Column:
    """A text as a part of an address: lower-case ASCII letters, digits and single hyphens."""
    t = F.regexp_replace(F.trim(F.lower(text)), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\s+", "-"), "-+", "-"), "^-|-$", "")


def excerpt(text: Column, brand: Column, most: int = 700) -> Column:
    """Up to most characters of a text without markup around its first mention of brand, begun at a sentence or word and ended at a word; its beginning if it has none."""
    t = without_markup(text)
    b = F.trim(F.coalesce(brand, F.lit("")))
    n = F.length(t)
    at = F.when(F.length(b) >= 2, F.position(F.lower(b), F.lower(t))).otherwise(0) - 1
    half = F.greatest(F.lit(0), F.floor((most - F.length(b)) / 2))
    first = F.greatest(F.lit(0), at - half)
    end = F.least(n, first + most)
    first = F.greatest(F.lit(0), F.least(first, end - most)).cast("int")
    ahead = F.substr(t, first + 1, at - first)
    stop, space = F.regexp_instr(ahead, F.lit(r"[.!?]\s")), F.position(F.lit(" "), ahead)
    start = first + F.when(first == 0, 0).when(stop > 0, stop + 1).when(space > 0, space).otherwise(0).cast("int")
    upto = F.substr(t, F.lit(1), end.cast("int") + 1)
    last = F.length(upto) - F.position(F.lit(" "), F.reverse(upto))
    end = F.when((end < n) & (last > at + F.length(b)), last).otherwise(end).cast("int")
    body = F.concat(F.when(start > 0, "…").otherwise(""), F.trim(F.substr(t, start + 1, end - start)), F.when(end < n, "…").otherwise(""))
    return F.when(n <= most, t).when(at < 0, F.concat(F.rtrim(F.substring(t, 1, most)), F.lit("…"))).otherwise(body)


def own_domain(host: Column, domain: Column) -> Column:
    """Whether a host is a domain or lies below it."""
    h, d = bare_host(host), bare_host(domain)
    return F.coalesce((d != "") & (h != "") & ((h == d) | h.endswith(F.concat(F.lit("."), d))), F.lit(False))
