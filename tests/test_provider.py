from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from citewise.operators import provider as P


def test_top_hosts(spark):
    data = [("q", "2", "https://a.example/x", "own.example"), ("q", "1", "https://www.b.example/", "own.example"), ("q", "3", "https://b.example/2", None), ("q", "1", "https://own.example/", "own.example"), ("q", None, "mailto:x", None), ("q", "x", None, None)]
    df = spark.createDataFrame(data, "q string, rank string, url string, own string").withColumn("host", F.lit("clash"))
    assert rows(P.top_hosts(df, "q", "rank", "url", F.col("own"))) == [("q", 1, "b.example", "https://www.b.example/"), ("q", 2, "a.example", "https://a.example/x")]
    assert P.top_hosts(df.limit(0), "q", "rank", "url", F.col("own")).count() == 0


def test_anchor_profile(spark):
    df = spark.createDataFrame([("t", "Brand", "6"), ("t", " brand", "1"), ("t", "x", "3"), ("t", None, "bad"), ("u", "a", None)], "t string, a string, n string")
    assert rows(P.anchor_profile(df, "t", "a", "n")) == [("t", 10, 3, "brand", 0.7, "fail"), ("u", 0, 1, "a", None, "na")]


def test_due_and_months(spark):
    t = datetime(2026, 8, 1)
    df = spark.createDataFrame([("a", True, None), ("b", True, t), ("b", True, t), ("c", True, datetime(2026, 9, 1)), ("d", False, None), (None, True, None)], "id string, active boolean, next_run_at timestamp_ntz")
    assert [r["id"] for r in P.due(df, F.lit(t)).collect()] == ["a", "b"]
    assert rows(P.monthly(df, "next_run_at", ["id"]).select("month", "id", "n")) == [("2026-08", "b", 2), ("2026-09", "c", 1)]


def test_samples(spark):
    df = spark.createDataFrame([(s, i) for s, n in (("a", 9), ("b", 2), ("c", 1)) for i in range(n)], "s string, i int")
    assert [(r["s"], r["i"]) for r in P.stratified(df, "s", "i", 6).collect()] == [("a", 0), ("b", 0), ("c", 0), ("a", 1), ("b", 1), ("a", 2)]
    low, high = P.bootstrap_interval([0.0, 1.0, 1.0, 0.5])
    assert (low, high) == P.bootstrap_interval([0.0, 1.0, 1.0, 0.5])
    assert 0 <= low < 0.625 < high <= 1
    assert P.bootstrap_interval([]) == (0.0, 0.0)


def test_sitemaps(spark):
    xml = "<urlset><url><loc> https://e.example/a?x=1&amp;y=2 </loc><lastmod>2026-01-02</lastmod></url><url><loc><![CDATA[https://e.example/b]]></loc></url><url></url></urlset><sitemapindex><sitemap><loc>s.xml</loc></sitemap></sitemapindex>"
    df = spark.createDataFrame([(1, xml), (2, ""), (3, None), (4, "<html>")], "k int, t string")
    assert rows(P.sitemap_entries(df, "k", "t")) == [(1, "sitemap", "s.xml", None), (1, "url", "https://e.example/a?x=1&y=2", "2026-01-02"), (1, "url", "https://e.example/b", None)]


def test_registered_queries_run(spark, small):
    import __spark_entry__ as entry

    from citewise.plans import analytics, pages_and_streams, problems, provider

    own = {n: f for m in (problems, analytics, pages_and_streams, provider) for n, f in m.QUERIES.items()}
    assert set(own) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    for name in ("p3_found", "p6_found", "competitor_league", "page_content", "serp_features", "stream_quota"):
        assert own[name](spark, small).count() >= 0
