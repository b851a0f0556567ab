from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from citewise.operators.rolling import latest_pull, page_rolling, read_day, rolling_totals


def brute(data, periods, first, last):
    days = [first + timedelta(i) for i in range((last - first).days + 1)]
    out = []
    for e in {x[0] for x in data if x[1] is not None}:
        have = {d: v or 0 for x, d, v in data if x == e and d is not None}
        for i, d in enumerate(days):
            row = [e, d, have.get(d, 0)]
            for p in periods:
                span = days[max(0, i - p + 1) : i + 1]
                t = sum(have.get(x, 0) for x in span)
                row += [t, t / len(span)]
            out.append(tuple(row))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    data = [("a", date(2026, 1, 1), 3), ("a", date(2026, 1, 9), 5), ("b", date(2026, 1, 4), None), (None, date(2026, 1, 5), 7), ("c", None, 9), ("a", date(2026, 1, 10), 1)]
    df = spark.createDataFrame(data, "page string, day date, clicks long").withColumn("__own", F.lit(1)).withColumn("__days", F.lit("x"))
    got = rows(rolling_totals(df, "page", "day", ["clicks"], (3, 7)))
    assert got == brute(data, (3, 7), date(2026, 1, 1), date(2026, 1, 10))


def test_repeated_rows_and_long_totals(spark):
    data = [("a", date(2026, 1, 1), 2**40), ("a", date(2026, 1, 1), 1), ("a", date(2026, 1, 2), None)]
    got = rolling_totals(spark.createDataFrame(data, "page string, day date, clicks long"), "page", "day", ["clicks"], (2,)).orderBy("day").collect()
    assert [r["clicks_2d_total"] for r in got] == [2**40 + 1] * 2


def test_pull_packs_exactly(spark):
    t = datetime(2026, 6, 5, 1, 2, 3, 456789)
    df = spark.createDataFrame([("2026-06-03", "p", "q", 2**31 - 1, 2**31 - 1, t), ("2026-06-03", "p", "r", -(2**31), -1, t)], "date string, page string, query string, clicks int, impressions int, pulled_at timestamp_ntz")
    got = latest_pull(df, ["query"], ("clicks", "impressions"), "pulled_at")
    assert rows(got) == [("q", 2**31 - 1, 2**31 - 1), ("r", -(2**31), -1)]
    with pytest.raises(ValueError):
        latest_pull(df.withColumn("clicks", F.lit(1).cast("long")), ["query"], ("clicks", "impressions"), "pulled_at")


def test_empty_and_calendar(spark):
    df = spark.createDataFrame([], "page string, day date, clicks long")
    assert rolling_totals(df, "page", "day", ["clicks"]).count() == 0
    one = spark.createDataFrame([("a", date(2026, 1, 2), 4)], "page string, day date, clicks long")
    got = rolling_totals(one, "page", "day", ["clicks"], (2,), (date(2026, 1, 1), date(2026, 1, 4)))
    assert [r["clicks_2d_total"] for r in got.orderBy("day").collect()] == [0, 4, 4, 0]


def test_days_are_read(spark):
    texts = ["2026-06-03", " 2026-06-03", "2026/06/03", "20260603", "03.06.2026", "2026-06-03T10:00:00Z", "2026-02-30", "", "x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(read_day(F.col("t"))).collect()]
    assert got == [date(2026, 6, 3)] * 6 + [None] * 4


def test_latest_pull_counts(spark):
    t = datetime(2026, 6, 5)
    data = [
        ("2026-06-03", "p", "q", 1, 10, t), ("2026/06/03", "p", "q", 5, 20, t + timedelta(hours=1)), ("2026-06-03", "p", None, 2, 3, t), ("2026-06-03", "p", "", 2, 3, t),
        ("2026-06-03", "p", "tie", 4, 9, t), ("2026-06-03", "p", "tie", 3, 99, t), ("2026-06-04", "p", "q", None, None, t), ("bad", "p", "q", 50, 50, t), ("2026-06-04", "p", "late", 7, 1, None),
    ]
    df = spark.createDataFrame(data, "date string, page string, query string, clicks int, impressions int, pulled_at timestamp_ntz").withColumn("day", F.lit("clash"))
    got = {r["day"]: r for r in page_rolling(df).collect()}
    assert (got[date(2026, 6, 3)]["clicks"], got[date(2026, 6, 3)]["impressions"]) == (5 + 2 + 4, 20 + 3 + 9)
    assert got[date(2026, 6, 4)]["clicks_7d_total"] == 11 + 7
    assert got[date(2026, 6, 4)]["clicks_7d_avg"] == 9.0
    assert page_rolling(df.limit(0)).count() == 0
