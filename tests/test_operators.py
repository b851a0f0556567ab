import json
import re
import time
from collections import Counter
from datetime import datetime

import pandas as pd
import pytest
import regex
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citewise.functions import exprs as X
from citewise.operators import answers as A
from citewise.operators import matching as M
from citewise.operators import pages as P
from citewise.operators import structure as S
from citewise.sources.files import named_queries, read_csv, read_json_lines, run_named
from citewise.sources.logs import log_lines
from citewise.sources.pages import fact_frames, page_facts, page_signals, parse_pages
from citewise.sources.robots import robots_decisions, robots_rules
from citewise.streaming import windows
from citewise.streaming.limits import step_bucket, step_window


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


@pytest.mark.parametrize(("name", "key"), [("Alderwick Catering", "alderwick"), ("Pellgrove", "pellgrove"), ("Mothlight.ai", "mothlight"), ("AB Group Ltd", "abgroup"), ("Marlow & Co.", "marlow"), ("Quillon Group Services Company Official Ltd", "quillon"), ("", None), (None, None)])
def test_brand_key(spark, name, key):
    assert one(spark, X.brand_key(F.col("x")), name) == key


@pytest.mark.parametrize(("word", "n"), [("cat", 1), ("jumped", 1), ("wanted", 2), ("table", 2), ("places", 1), ("readability", 5), ("yes", 1), ("123", 1)])
def test_syllables(spark, word, n):
    assert one(spark, X.syllables(F.col("x")), word) == n


def test_words_and_urls(spark):
    assert one(spark, X.count_words(F.col("x")), "Don't count 3.5 twice, run-rate 日本語") == 8
    assert one(spark, X.url_key(F.col("x")), "https://WWW.Example.com/a/?utm_source=x&b=2&ref=y&a=1#f") == "example.com/a?b=2&ref=y&a=1"
    assert one(spark, X.check_key(F.col("x")), "http://www.example.com/a/index.html?ref=y&gclid=1&b=2#f") == "example.com/a?b=2"
    assert one(spark, X.check_key(F.col("x")), " /just/a/path ") == "/just/a/path"
    assert one(spark, X.serp_key(F.col("x")), "HTTPS://www.Example.com:8443/a//?utm_source=x") == "www.example.com:8443/a?utm_source=x"
    assert one(spark, X.url_key(F.col("x")), "mailto:a@b.example") is None
    assert one(spark, X.main_domain(F.col("x")), "shop.example.co.uk") == "example.co.uk"
    assert one(spark, X.main_domain(F.col("x")), "a.b.example.com") == "example.com"


ANSWERS = "audit_id string, engine string, question_id string, question string, mentioned boolean, rank int, sentiment string, used_search boolean, competitors array<string>"


def answers(spark):
    data = [
        ("a", "x", "q1", "?", True, 1, "positive", False, ["Alderwick North", "Acme Inc"]), ("a", "y", "q1", "?", False, None, "absent", True, ["Alderwick", "Acme"]),
        ("a", "x", "q2", "?", False, None, "absent", None, ["Alderwick", "Marlower"]), ("a", "y", "q2", "?", False, None, "absent", True, ["alderwick", " ", "Marlow"]),
        ("b", "x", "q1", "?", True, 10, "negative", False, []), ("b", "x", "q2", "?", True, None, "odd", False, None),
    ]
    return spark.createDataFrame(data, ANSWERS)


def test_league_merges_spellings(spark):
    df = answers(spark).withColumn("brand", F.lit("Own"))
    got = [tuple(r) for r in A.competitor_league(df).orderBy("place").collect()]
    assert got == [("a", 1, "Alderwick", 4, 2, 2), ("a", 2, "Marlow", 1, 1, 1), ("a", 3, "Marlower", 1, 1, 1), ("a", 4, "Acme", 2, 1, 0)]


def test_scores_gaps_and_levels(spark):
    df = answers(spark).withColumn("brand", F.lit("Own"))
    got = {(r["audit_id"], r["engine"]): r for r in A.engine_summary(df, ["audit_id", "engine"]).collect()}
    assert (got["a", "x"]["mention_rate"], got["a", "x"]["visibility"], got["a", "x"]["avg_rank"]) == (50, 50, 1.0)
    assert got["b", "x"]["visibility"] == 33  # (0.3 * 0.5 + 0.6 * 0.85) / 2
    questions = spark.createDataFrame([("a", "q1", "one", "high"), ("a", "q2", "two", "medium")], "audit_id string, question_id string, question string, intent string")
    assert [tuple(r) for r in A.gap_questions(df, questions).collect()] == [("a", "q2", "two", "medium", 2, "Alderwick;Marlow;Marlower;alderwick")]
    assert {tuple(r)[:2] + (r["level"],) for r in A.visibility_level(df, ["audit_id", "engine"]).collect()} == {("a", "x", 4), ("a", "y", 2), ("b", "x", 5)}
    assert A.competitor_league(df.limit(0)).count() == A.engine_summary(df.limit(0), ["engine"]).count() == 0


def test_audit_answers_reads_odd_results(spark):
    good = {"brand": "B", "matrix": [{"engine": "x", "questionId": "q1", "mentioned": True, "rank": 2, "competitorsMentioned": ["C", {"name": "D"}, None]}, None], "questions": [{"id": "q1", "text": "t", "intent": "high"}]}
    t = datetime(2026, 6, 1)
    data = [("1", json.dumps(good), t), ("1", None, t), ("2", json.dumps(json.dumps(good)), t), ("3", json.dumps(good)[:-9], t), ("4", "", t), ("5", "{}", t)]
    df = spark.createDataFrame(data, "id string, result string, loaded_at timestamp_ntz")
    assert [(r["audit_id"], r["engine"], r["rank"], r["competitors"]) for r in A.audit_answers(df).orderBy("audit_id").collect()] == [("1", "x", 2, ["C", "D"]), ("2", "x", 2, ["C", "D"])]
    assert A.audit_questions(df).count() == 2


def test_metrics_from_named_queries(spark, tmp_path):
    (tmp_path / "rows.csv").write_text("run_id,engine,available,count\nr1,x,yes,2\nr2,x,yes,\nr3,y,no,1\n")
    df = read_csv(spark, str(tmp_path / "rows.csv"), "run_id string, engine string, available string, count int")
    assert [r["count"] for r in df.orderBy("run_id").collect()] == [2, None, 1]
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "rows.csv"), "engine string, run_id string, available string, count int")
    with pytest.raises(ValueError, match="other"):
        read_csv(spark, str(tmp_path / "rows.csv"), "other string", exact=False)
    text = "-- name: a\nselect engine, count(*) as n from rows group by 1;\n-- name: b\nselect engine, sum(count) as n from rows group by 1;\n"
    assert list(named_queries(text)) == ["a", "b"]
    assert rows(run_named(spark, text, {"rows": df})) == [("a", "x", 2), ("a", "y", 1), ("b", "x", 2), ("b", "y", 1)]
    got = A.rates(df, ["engine"], {"cited": (F.col("count") > 0, F.col("available") == "yes")})
    assert rows(got) == [("x", "cited", 1, 2, 0.5), ("y", "cited", 0, 0, None)]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    assert [(r["ok"], r["a"]) for r in read_json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()] == [(True, 1), (False, None), (False, None)]


def test_concentration_and_agreement(spark):
    df = spark.createDataFrame([(h,) for h in "aaabbc"], "h string")
    r = S.concentration(df, [], "h").first()
    assert (r["total"], r["n_sources"], r["top_1"], r["hhi"]) == (6, 3, 0.5, round(9 / 36 + 4 / 36 + 1 / 36, 6))
    same = spark.createDataFrame([("x", "x")] * 4, "a string, b string")
    assert S.kappa(same, [], "a", "b").first()["kappa"] is None
    assert S.sample_size(0.3, 0.4, 0.05, 0.8) == 356


def test_set_agreement_against_pairs(spark):
    runs = {"r1": "ab", "r2": "ab", "r3": "bc", "r4": ""}
    df = spark.createDataFrame([("g", r, c) for r, s in runs.items() for c in (s or [None])], "g string, r string, b string")
    got = S.set_agreement(df, "g", "r", "b").first()
    sets = [set(s) for s in runs.values()]
    pairs = [(x, y) for i, x in enumerate(sets) for y in sets[i + 1 :]]
    assert got["exact_share"] == round(sum(x == y for x, y in pairs) / 6, 6)
    assert got["mean_jaccard"] == round(sum(len(x & y) / len(x | y) if x | y else 1 for x, y in pairs) / 6, 6)


def test_diff_errors_and_statuses(spark):
    a = spark.createDataFrame([("p", 1, None), ("q", 2, "x")], "k string, n int, s string")
    b = spark.createDataFrame([("p", 1, "y"), ("r", 3, "x")], "k string, n int, s string")
    assert rows(S.snapshot_diff(a, b, ["k"], ["n", "s"])) == [("p", "changed", "s", "", "y"), ("q", "removed", "", "", ""), ("r", "added", "", "", "")]
    df = spark.createDataFrame([(1, "u", -1), (2, "u", None), (3, None, 5)], "row int, k string, v int")
    assert rows(S.row_errors(df, {"negative": ("v", F.col("v") < 0), "absent": ("v", F.col("v").isNull())}, "k", "row")) == [("absent", "v", 2, None, None), ("duplicate_key", "k", 2, "u", 1), ("negative", "v", 1, "-1", None)]
    st_ = spark.createDataFrame([(0, 0), (0, 5), (1, 5), (2, 5)], "a int, u int").select(S.share_status(F.col("a"), F.col("u")))
    assert [r[0] for r in st_.collect()] == ["na", "pass", "warn", "fail"]
    checks = spark.createDataFrame([("s", "pass", 3, False), ("s", "warn", 2, False), ("s", "fail", 1, True), ("s", "na", 9, False), ("t", "pass", 1, False)], "site string, status string, weight int, gate boolean")
    assert rows(S.dimension_scores(checks, ["site"])) == [("s", 3, 30), ("t", 1, None)]


LOG = '192.0.2.7 - - [20/Sep/2026:04:21:13 +0000] "GET /a?b HTTP/1.1" 404 51 "-" "OneBot/2.2"'


def test_logs_and_ranges(spark):
    df = spark.createDataFrame([(LOG,), ("garbage",), (None,)], "line string")
    got = log_lines(df, "line").orderBy(F.desc("ok")).collect()
    assert [r["ok"] for r in got] == [True, False, False]
    assert (got[0]["ip"], got[0]["path"], got[0]["status"], got[0]["bytes"], got[0]["agent"]) == ("192.0.2.7", "/a?b", 404, 51, "OneBot/2.2")
    assert got[1]["status"] is None
    ips = spark.createDataFrame([("192.0.2.7",), ("192.0.3.1",), ("x",), ("10.0.0.300",), (None,)], "ip string")
    ranges = M.in_ranges(ips, "ip", [("p", "192.0.2.0/24"), ("q", "192.0.0.0/16"), ("p", "192.0.2.7/32")])
    assert [r["providers"] for r in ranges.collect()] == [["p", "q"], ["q"], [], [], []]
    rule = spark.createDataFrame([("my OTHERbot",), ("x",), (None,)], "ua string").select(M.first_rule(F.col("ua"), [("Other", "a"), ("bot", "b")]).alias("r")).select("r.*")
    assert [tuple(r) for r in rule.collect()] == [("Other", "a"), ("unknown", "unknown"), ("unknown", "unknown")]


# An own file and own cases: groups of one agent that add up, the longest rule, ties to allow, ends and wildcards, escapes.
ROBOTS_TXT = """
user-agent: MothBot
disallow: /members
allow: /members/join
disallow: /*.csv$
allow: /open/*.csv$
disallow: /caf%C3%A9/
allow: /same
disallow: /same

User-agent: HarborBot
User-agent: mothbot
Disallow: /second/
Disallow:

User-agent: *
Disallow: /drafts/
"""
DECISIONS = [
    ("MothBot", "/members/list", "disallow", "/members"), ("MothBot", "/members/join?x=1", "allow", "/members/join"), ("MothBot", "/data.csv", "disallow", "/*.csv$"), ("MothBot", "/data.csv?x", "allow", None),
    ("MothBot", "/open/data.csv", "allow", "/open/*.csv$"), ("MothBot", "/café/menu", "disallow", "/caf%C3%A9/"), ("MothBot", "/same", "allow", "/same"), ("MothBot", "/second/x", "disallow", "/second/"),
    ("HarborBot", "/second/x", "disallow", "/second/"), ("HarborBot", "/members", "allow", None), ("Other", "/drafts/a", "disallow", "/drafts/"), ("Other", "/members", "allow", None),
]


def test_robots(spark):
    df = spark.createDataFrame([d[:2] for d in DECISIONS], "agent string, path string")
    got = {(r["agent"], r["path"]): (r["decision"], r["matched_rule"]) for r in robots_decisions(df, "agent", "path", robots_rules(ROBOTS_TXT)).collect()}
    assert got == {d[:2]: d[2:] for d in DECISIONS}


def test_aliases(spark):
    aliases = spark.createDataFrame([("e1", "Acme"), ("e2", "Beta Co"), ("e3", "beta-co"), ("e1", None)], "entity string, alias string")
    names = spark.createDataFrame([("Acme",), ("ACME!",), ("betaco",), ("zzz",), ("ＡＣＭＥ",), (None,), ("",)], "name string")
    got = {r["name"]: (r["match_mode"], r["decision"], r["entity"]) for r in M.match_aliases(names, "name", aliases).collect()}
    assert got == {"Acme": ("exact", "match", "e1"), "ACME!": ("normalized", "match", "e1"), "betaco": ("normalized", "review", None), "zzz": ("none", "no-match", None), "ＡＣＭＥ": ("normalized", "match", "e1"), None: ("none", "no-match", None), "": ("none", "no-match", None)}


PAGE = """<!doctype html><html lang="en"><head><title>A page &amp; more</title><meta name="description" content="d"><meta property="og:title" content="o">
<link rel="canonical" href="/x#f"><script type="application/ld+json">{"@graph": [{"@type": ["Organization", "Thing"]}]}</script><script type="application/ld+json">{bad</script></head>
<body><nav><a href="/n">here</a></nav><h1>One</h1><h3>Three</h3><p>Some text <img src="http://e.example/i.png"></p><a rel="nofollow" href="https://other.example/">out</a><h2>left open<p>last</body></html>"""


def test_pages(spark):
    r = page_facts(PAGE, "https://www.e.example/p")
    assert (r["lang"], r["title"], r["description"], r["canonical"]) == ("en", "A page & more", "d", "https://www.e.example/x")
    assert (r["n_images"], r["n_missing_alt"], r["n_mixed"], r["n_external"], r["n_nofollow"], r["n_generic_anchors"]) == (1, 1, 1, 1, 0, 1)
    assert r["json_ld_types"] == ["Organization", "Thing"]
    assert r["n_json_ld_errors"] == 1
    assert [h[0] for h in r["headings"]] == [1, 3, 2]
    assert "here" in r["text"]
    assert "here" not in r["main_text"]
    df = spark.createDataFrame([("1", PAGE, "s"), ("2", "", "s"), ("3", None, "s"), ("4", "<p", "s")], "id string, html string, site string")
    facts = parse_pages(df, "id", "html")
    assert {r["id"]: r["title"] for r in facts.collect()} == {"1": "A page & more", "2": None, "3": None, "4": None}
    assert page_signals(facts, "id", F.lit("https://e.example/")).count() == 4


@given(st.text(max_size=200))
def test_any_page_is_read(html):
    page_facts(html)


DAMAGED = [
    ("<![MASK]doctype html>", {"lang": "en"}), ("<![ x", {}), ("<![MASK", {}), ('<a href="http://[bad/">x</a><a href="/y">y</a>', {"links": ["https://e.example/y"], "n_external": 0}), ('<a href="http://a\u2100b.com/">x</a>', {"n_external": 0}),
    ('<link rel="canonical" href="http://[x">', {"canonical": None, "n_canonicals": 1}), ('<link rel="alternate" hreflang="de" href="http://[x">', {"hreflang": [("de", "http://[x")]}), ('<img src="http://[x/y.png">', {"images": ["own"]}),
    ('<img width="²" height="3" src="/a.png">', {"images": ["own"]}), (f'<img width="{"9" * 5000}" height="{"0" * 5000}1" src="/a.png">', {"images": []}), (f'<script type="application/ld+json">{"[" * 200_000}{"]" * 200_000}</script>', {"n_json_ld_errors": 1}),
    ('<script type="application/ld+json">{"@type": "\\ud800", "author": "\\udc00"}</script>', {"json_ld_types": ["\ufffd"], "authors": ["\ufffd"]}), ('<script type="application/ld+json">{"@type": "Organization", "name": ["a"]}</script>', {"org_name": None, "json_ld_types": ["Organization"]}),
]


@pytest.mark.parametrize(("mark", "want"), DAMAGED)
def test_damaged_pages_are_read(mark, want):
    r = page_facts(mark + '<html lang="en"><body><p>after</p></body></html>', "https://e.example/p")
    assert {k: r[k] for k in want} == want
    assert r["main_text"].endswith("after")
    page_facts(mark, "https://[e.example/p")


@pytest.mark.parametrize("name", ["page_facts", "page_structure", "tool_links", "page_content", "reading_ease", "phrases", "tool_page_items", "html_site_checks"])
def test_page_queries_read_damaged_pages(spark, tmp_path, name):
    from citewise.plans import pages_and_streams, tools

    pages = [(i, m + '<html lang="en"><title>t</title><body><p>one two</p><a href="/y">y</a></body></html>', "e.example", "page_html") for i, (m, _) in enumerate(DAMAGED)]
    spark.createDataFrame(pages, "doc_id long, text string, source string, doc_type string").write.parquet(str(tmp_path / "documents.parquet"))
    got = (pages_and_streams.QUERIES | tools.QUERIES)[name](spark, str(tmp_path)).collect()
    assert got
    if "doc_id" in got[0]:
        assert {str(r["doc_id"]) for r in got} == {str(i) for i, *_ in pages}


LONG = [("<div>" * 20_000 + "x", 0), ("word <a href='/x'>l</a> " * 4500, 4500), ("<p>" + "a" * 100_000, 0), ("<p>" + "a" * 50_000 + "@" + "b" * 50_000, 0)]


@pytest.mark.parametrize(("html", "want"), LONG)
def test_long_pages_take_time_in_proportion(html, want):
    """Tags left open, many links and unbroken text: 100,000 characters took 9 to 177 seconds."""
    start = time.process_time()
    r = page_facts(html, "https://e.example/p")
    assert time.process_time() - start < 4
    assert (len(r["links"]), len(r["link_positions"])) == (want, want)
    assert r["link_positions"] == [2 * i + 1 for i in range(want)]


def test_page_signals_count_words_once_for_all_links(spark):
    """3,000 links in 100,000 characters: the words of the page were counted again for each link."""
    pages = spark.createDataFrame([("a", "<p>" + "word " * 20_000 + "<a href='/x'>l</a> " * 3000 + "</p>"), ("b", "one <a href='/x'>l</a> two three"), ("c", None)], "key string, html string").withColumn("url", F.lit("https://e.example/p"))
    facts = parse_pages(pages, "key", "html", "url").cache()
    facts.count()
    start = time.time()
    got = {r["key"]: r["n_next_steps"] for r in page_signals(facts, "key", F.lit("https://e.example/p")).select("key", "n_next_steps").collect()}
    facts.unpersist()
    assert time.time() - start < 15
    assert got == {"a": 3000, "b": 0, "c": None}


@pytest.mark.parametrize("name", ["page_structure", "tool_links", "page_content"])
def test_page_queries_move_no_facts(spark, tmp_path, name):
    """Pages' facts, whole texts among them, are neither joined nor sorted: each page is read in one narrow pass, null and empty ones too."""
    from citewise.plans import pages_and_streams, tools

    pages = [(1, '<html lang="en"><title>t</title><body><p>one two</p><a href="/y">y</a></body></html>', "e.example", "page_html"), (2, None, None, "page_html"), (3, "", "e.example", "page_html")]
    spark.createDataFrame(pages, "doc_id long, text string, source string, doc_type string").write.parquet(str(tmp_path / "documents.parquet"))
    df = (pages_and_streams.QUERIES | tools.QUERIES)[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
    assert "Join" not in plan
    assert {r["doc_id"] for r in df.collect()} == ({"1", "2", "3"} if name == "page_content" else {"1"})


def test_facts_leave_in_blocks():
    """Pages of one batch, however many and long, don't all lie in memory as facts."""
    pages = pd.DataFrame({"key": list("abcd"), "html": ["<p>one", None, "<p>two", "<p>six"], "url": [""] * 4, "__site": ["s", "s", None, "t"]})
    got = list(fact_frames([pages, pages[:0]], ["key", "text", "__site"], chars=12))
    assert [f["key"].tolist() for f in got] == [["a", "b", "c"], ["d"]]
    assert [f["text"].tolist() for f in got] == [["one", None, "two"], ["six"]]
    assert [f["__site"].tolist() for f in got] == [["s", "s", None], ["t"]]


@pytest.mark.parametrize("name", ["html_site_checks", "tool_page_items"])
def test_page_queries_read_pages_once(spark, tmp_path, name):
    """What the queries return reads facts that are written: the pages aren't parsed again for each of its branches."""
    from citewise.plans import pages_and_streams, tools

    pages = [(1, '<html lang="en"><title>t</title><body><p>one two</p></body></html>', "e.example", "page_html"), (2, None, None, "page_html")]
    spark.createDataFrame(pages, "doc_id long, text string, source string, doc_type string").write.parquet(str(tmp_path / "documents.parquet"))
    df = (pages_and_streams.QUERIES | tools.QUERIES)[name](spark, str(tmp_path))
    assert "MapInPandas" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_text(spark):
    df = spark.createDataFrame([(1, "The cat sat. It ran! " * 10), (2, ""), (3, None)], "id int, t string")
    got = {r["id"]: r for r in P.text_measures(df, "id", "t").collect()}
    assert (got[1]["n_words"], got[1]["n_sentences"]) == (50, 20)
    assert got[1]["reading_ease"] == 100.0
    assert got[2]["reading_ease"] is None
    assert rows(P.ngram_density(df, [], "t", 2, top=2)) == [(1, "cat sat", 10, 0.2041), (2, "it ran", 10, 0.2041)]


def test_phrases_of_all_documents(spark, small):
    """Brute force over every document by the rules of the page tools."""
    from pathlib import Path

    from citewise.plans.pages_and_streams import QUERIES

    docs = spark.read.parquet(str(Path(small, "documents.parquet"))).select("doc_type", "text").collect()
    word = regex.compile(P.PHRASE_WORD)
    count, words = Counter(), Counter()
    for kind, text in docs:
        w = word.findall(((page_facts(text)["main_text"] if text else "") if kind == "page_html" else text or "").lower())
        words[kind] += len(w)
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                g = w[i : i + n]
                if not (g[0] in P.STOP_WORDS or g[-1] in P.STOP_WORDS or any(len(x) < 2 or re.fullmatch("[0-9]+", x) for x in g)):
                    count[kind, n, " ".join(g)] += 1
    want = []
    for kind, n in {(k, n) for k, n, _ in count}:
        best = sorted(((-c, g.encode(), g) for (k, m, g), c in count.items() if (k, m) == (kind, n) and c >= 2))[:15]
        want += [(kind, n, i + 1, g, -c) for i, (c, _, g) in enumerate(best)]
    got = QUERIES["phrases"](spark, small).collect()
    assert sorted((r["doc_type"], r["n"], r["place"], r["ngram"], r["count"]) for r in got) == sorted(want)
    assert {r["doc_type"] for r in got} == {k for k, _, _ in count} and {r["n"] for r in got} == {1, 2, 3}
    assert all(abs(r["share"] - r["count"] * r["n"] / words[r["doc_type"]]) <= 0.000051 for r in got)


def test_phrase_rules(spark):
    df = spark.createDataFrame([("the quick fox of the 42 quick fox b quick fox's den",), ("the quick fox of the den",), (None,), ("",)], "t string").withColumn("k", F.lit("x"))
    assert rows(P.phrase_density(df, ["k"], "t").select("n", "ngram", "count")) == [(1, "den", 2), (1, "fox", 3), (1, "quick", 4), (2, "quick fox", 3)]


@pytest.mark.parametrize("mark", ["-", "'", "’"])
def test_phrases_of_words_joined_many_times(spark, tmp_path, mark):
    """A word of 2,000 hyphens overflowed the stack, which ends the executor: the words of the whole text come out, of pages too."""
    from citewise.plans.pages_and_streams import QUERIES

    words = [mark.join(["na"] * n) for n in (2_000, 30_000)]
    text = " ".join(["lamp", *words, "lamp"])
    docs = [(1, text, "blob"), (2, text, "blob"), (3, f"<p>{text}</p>", "page_html"), (4, f"<p>{text}</p>", "page_html")]
    spark.createDataFrame(docs, "doc_id long, text string, doc_type string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["phrases"](spark, str(tmp_path)).select("doc_type", "n", "ngram", "count").collect()
    a, b = words
    want = {(1, "lamp", 4), (1, a, 2), (1, b, 2), (2, f"lamp {a}", 2), (2, f"{a} {b}", 2), (2, f"{b} lamp", 2), (3, f"lamp {a} {b}", 2), (3, f"{a} {b} lamp", 2)}
    assert {tuple(r) for r in got} == {(kind, *r) for kind in ("blob", "page_html") for r in want}
    assert len(got) == 2 * len(want)


def test_phrases_of_pages_with_long_character_numbers(spark, tmp_path):
    """A character given by a number of more than 4,300 digits ended the page reader by an error."""
    from citewise.plans.pages_and_streams import QUERIES

    pages = [(i, f"<p title='&#{'9' * 5000};'>amber &#{'9' * 5000}; &#{'0' * 5000}65;mber lamp</p>", "page_html") for i in range(2)]
    spark.createDataFrame(pages, "doc_id long, text string, doc_type string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["phrases"](spark, str(tmp_path)).select("n", "ngram", "count").collect()
    assert sorted(map(tuple, got)) == [(1, "amber", 4), (1, "lamp", 2), (2, "amber amber", 2), (2, "amber lamp", 2), (3, "amber amber lamp", 2)]


def test_text_measures_look_at_words_as_one_by_one(spark):
    """Syllables of whole texts are those of each word; they come from Arrow batches, not from an expression run for each word."""
    texts = ["Yes, yellow played agreed tomatoes the-best Don't e.g. wanted", "漢字の the漢 İstanbul K-pop ½ x² tables", "", None, "a.b 漢-a co. approx. ｅ The", "yxes ed eed heed"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    words = F.regexp_extract_all("t", F.lit(X.WORD), 0)
    each = F.aggregate(words, F.lit(0), lambda n, w: n + X.syllables(w))
    spaced = F.regexp_count(F.regexp_replace("t", X.IDEOGRAPH, " "), F.lit(X.WORD)) + F.regexp_count("t", F.lit(X.IDEOGRAPH))
    got = P.text_measures(df, "id", "t")
    assert rows(got.select("id", "n_words", "n_syllables")) == rows(df.select("id", spaced, each))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "ArrowEvalPython" in plan


EN = "The answer engine reads your page, picks the passage that answers the question, and cites it if it can trust the source. That is why a clear first sentence matters more than the length of the article, and why we test every page with real prompts before we publish it."
DE = "Die KI-Suche verändert gerade, wie Kunden neue Marken finden und vergleichen. Wir haben fünfzig typische Anfragen getestet und die Antworten sorgfältig miteinander verglichen, und die Ergebnisse waren überraschend deutlich für kleine Anbieter in diesem Markt. " * 2


def test_reading_ease_of_all_english_documents(spark, tmp_path):
    from citewise.plans.pages_and_streams import QUERIES

    assert [one(spark, X.looks_english(F.col("x")), x) for x in (EN, DE, "The quick answer is yes.", "", None)] == [True, False, False, False, None]
    data = [(1, "audit_note", "EN", EN), (2, "article", "en", DE), (3, "answer", None, EN), (4, "page_html", "und", f"<html><body><p class='x'>{EN}</p></body></html>"), (5, None, "en", "short"), (6, "faq", "en", None), (7, "page_html", "en", None)]
    spark.createDataFrame(data, "doc_id long, doc_type string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["reading_ease"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7]
    ease = one(spark, X.reading_ease(F.lit(got[1]["n_words"]), F.lit(got[1]["n_sentences"]), F.lit(got[1]["n_syllables"])), "")
    assert [got[i]["reading_ease"] for i in range(1, 8)] == [ease, None, ease, ease, None, None, None]
    assert ease is not None and got[4]["n_words"] == got[1]["n_words"] and got[7]["n_words"] is None


def test_log_agents_of_all_addresses(spark, tmp_path):
    from citewise.plans.pages_and_streams import QUERIES

    line = '{} - - [01/Sep/2026:00:00:00 +0000] "GET / HTTP/1.1" 200 5 "-" "GallioBot/1"'
    ips = ["192.0.2.7", "192.0.2.200", "192.0.9.1", "2.0.2.117", "2001:db8::1", "192.0.2.300"]
    spark.createDataFrame([(1, "log", "\n".join([*map(line.format, ips), "no line"]))], "doc_id long, doc_type string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(QUERIES["log_agents"](spark, str(tmp_path)).select("token", "providers", "n")) == [("GallioBot", "", 3), ("GallioBot", "high;wide", 1), ("GallioBot", "low;one;wide", 1), ("GallioBot", "wide", 1)]


def test_momentum_of_pages_without_clicks_before(spark, tmp_path):
    from citewise.plans.analytics import QUERIES

    pull = datetime(2026, 10, 2)
    data = [("2026-09-20", "new", "q", 25), ("2026-09-20", "few", "q", 5), ("2026-09-20", "old", "q", 12), ("2026-08-20", "old", "q", 10), ("2026-08-20", "gone", "q", 30), ("2026-09-20", "none", "q", None)]
    spark.createDataFrame([(*r, 100, 1.0, pull) for r in data], "date string, page string, query string, clicks int, impressions int, position double, pulled_at timestamp_ntz").write.parquet(f"{tmp_path}/gsc_daily.parquet")
    got = rows(QUERIES["console_momentum"](spark, str(tmp_path)))
    assert got == [("few", 5, 0, None), ("gone", 0, 30, 0.0), ("new", 25, 0, 100.0), ("none", 0, 0, None), ("old", 12, 10, 75.0)]


def test_limits():
    s = None
    seen = []
    for now in (0, 5, 10, 10.5, 21):
        s = step_window(s, now, 10)
        seen.append(s)
    assert seen == [(0, 1), (0, 2), (0, 3), (10.5, 1), (21, 1)]
    tokens, oks = None, []
    for now in (0, 0, 0, 5, 5):
        *tokens, ok = step_bucket(tokens, now, 2, 10)
        oks.append(ok)
    assert oks == [True, True, False, True, False]


def test_restate_and_retain(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "k string, v int, t int")
    new = spark.createDataFrame([("b", 3, 2), ("b", 4, 3), ("c", 5, 2)], "k string, v int, t int")
    assert rows(windows.restate(old, new, ["k"], F.col("t"))) == [("a", 1, 1), ("b", 4, 3), ("c", 5, 2)]
    df = spark.createDataFrame([(datetime(2026, 1, 1),), (datetime(2026, 3, 1),), (None,)], "at timestamp")
    assert windows.retained(df, "at", F.lit(datetime(2026, 3, 2)), 30).count() == 2


def test_core_stands_without_llm():
    import ast
    from pathlib import Path

    for f in Path("citewise").rglob("*.py"):
        if "llm" not in f.parts:
            for node in ast.walk(ast.parse(f.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("citewise.llm" in n for n in names), f
