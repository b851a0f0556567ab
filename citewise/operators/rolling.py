"""Totals and averages over trailing periods, days without activity included."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The ways in which days are written, as (pattern, year, month, day group).
DAY_FORMS = (
    (r"^(\d{4})-(\d{2})-(\d{2})(?:[T ].*)?$", 1, 2, 3),
    (r"^(\d{4})/(\d{2})/(\d{2})$", 1, 2, 3),
    (r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3),
    (r"^(\d{2})\.(\d{2})\.(\d{4})$", 3, 2, 1),
)


def read_day(text: Column) -> Column:
    """The date in a text of one of DAY_FORMS, else null; impossible dates are null too."""
    text = F.trim(text)
    day = F.try_to_date(text, "yyyy-MM-dd")
    for form, y, m, d in DAY_FORMS:
        part = [F.regexp_extract(text, form, g) for g in (y, m, d)]
        day = F.coalesce(day, F.when(text.rlike(form), F.try_to_date(F.concat_ws("-", *part), "yyyy-MM-dd")))
    return day


def latest_pull(df: DataFrame, keys: list[str], measures: tuple[str, str], pulled_at: str) -> DataFrame:
    """One row per keys with the two measures of its latest pull; measures are of type int or smaller, others raise.

    Ties of the pull time go to the greater first, then second measure; a null measure counts as 0. The order and
    both measures are packed into one decimal so that the aggregate is a plain max, hashed and combined before the
    shuffle. The session's time zone must be UTC.
    """
    kinds = dict(df.dtypes)
    if any(kinds[m] not in ("tinyint", "smallint", "int") for m in measures):
        raise ValueError("measures must be of 32 bits at most")
    bits = F.lit(2**32).cast("decimal(11,0)")
    a, b = (F.coalesce(F.col(m), F.lit(0)).cast("long") + 2**31 for m in measures)
    pulled = F.coalesce(F.unix_micros(F.col(pulled_at).cast("timestamp")), F.lit(0))
    packed = ((pulled.cast("decimal(17,0)") * bits + a.cast("decimal(11,0)")) * bits + b.cast("decimal(11,0)")).cast("decimal(38,0)")
    top = df.groupBy(*keys).agg(F.max(packed).alias("__top"))
    low = (F.col("__top") % bits).cast("long")
    above = ((F.col("__top") - F.col("__top") % bits) / bits).cast("decimal(38,0)")
    return top.select(*keys, ((above % bits).cast("long") - 2**31).alias(measures[0]), (low - 2**31).alias(measures[1]))


def densify(daily: DataFrame, entity: str, day: str, measures: list[str], first: date, last: date) -> DataFrame:
    """entity x calendar: one row per entity and day of [first, last], measures 0 where daily has no row.

    daily has one row per entity and day. An entity's days come together in one map, at most the calendar's days long
    whatever the skew of the raw rows; the entities are cross joined with the calendar, a table of (last - first) days
    that every task holds, and each day takes its measures from the map. So only the sparse rows are shuffled, and the
    product keeps the entities' partitioning, which the windows after it use.
    """
    calendar = daily.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias(day))
    own = F.map_from_entries(F.collect_list(F.struct(F.col(day), F.struct(*measures)))).alias("__own")
    grid = daily.groupBy(entity).agg(own).crossJoin(F.broadcast(calendar))
    at = F.try_element_at("__own", F.col(day))
    return grid.select(entity, day, at.alias("__at")).select(entity, day, *(F.coalesce(F.col("__at")[m], F.lit(0)).alias(m) for m in measures))


def rolling_totals(daily: DataFrame, entity: str, day: str, measures: list[str], periods: tuple[int, ...] = (7, 30), calendar: tuple[date, date] | None = None) -> DataFrame:
    """For every entity and calendar day: measures of the day, their totals and averages over trailing periods.

    daily: rows of an entity and day are added up; other columns are left out. calendar: first and last day, else those of daily.
    Returns entity, day, m, m_{p}d_total and m_{p}d_avg of each measure and period. A period holds the day itself and
    the p - 1 days before it; before the calendar's start there are no days, so early averages divide by the days
    there are. Null measures count as 0; rows of a null day are left out; a null entity is an entity of its own. An
    empty input gives no rows.
    """
    daily = daily.where(F.col(day).isNotNull()).groupBy(entity, day).agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures))
    first, last = calendar or daily.agg(F.min(day), F.max(day)).first()
    if first is None:
        first = last = date(1970, 1, 1)
    dense = densify(daily.where(F.col(day).between(F.lit(first), F.lit(last))), entity, day, measures, first, last)
    out = [F.col(entity), F.col(day), *(F.col(m) for m in measures)]
    for p in periods:
        frame = Window.partitionBy(entity).orderBy(day).rowsBetween(1 - p, 0)
        days = F.least(F.datediff(F.col(day), F.lit(first)) + 1, F.lit(p))
        for m in measures:
            total = F.sum(m).over(frame)
            out += [total.alias(f"{m}_{p}d_total"), (total / days).alias(f"{m}_{p}d_avg")]
    return dense.select(*out)


def page_rolling(gsc: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """rolling_totals of clicks and impressions per page of search-console rows.

    Every date-page-query counts once, by its latest pull; a null query is the empty one, as in the rows' ids. Pages
    are taken as stored; the page '' is the whole site. Rows whose date can't be read belong to no day.
    """
    rows = gsc.select(read_day(F.col("date")).alias("day"), "page", F.coalesce("query", F.lit("")).alias("query"), "clicks", "impressions", "pulled_at").where("day is not null")
    first, last = gsc.select(read_day(F.col("date")).alias("day")).agg(F.min("day"), F.max("day")).first()
    once = latest_pull(rows, ["day", "page", "query"], ("clicks", "impressions"), "pulled_at")
    return rolling_totals(once, "page", "day", ["clicks", "impressions"], periods, (first, last) if first else None)
