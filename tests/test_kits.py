import gzip
import hashlib
import json
from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from citewise.functions import misc as M
from citewise.operators import answers as A
from citewise.operators import matching as K
from citewise.operators import pages as Q
from citewise.operators import pairs as P
from citewise.operators import ranking as R
from citewise.operators import structure as S
from citewise.operators import tools as T
from citewise.operators import validators as V
from citewise.sources import files
from citewise.sources import logs as L
from citewise.sources.tables import read_jdbc, write_jdbc

# Fixed golden input: addresses, their bases, keys and statuses.
URLS = [
    ("HTTP://Example.COM:80/Guide#Intro", "", "http://example.com/Guide"), ("https://EXAMPLE.com:443/guide", "", "https://example.com/guide"), ("https://example.com:8443/guide", "", "https://example.com:8443/guide"),
    ("https://example.com/a/./b/../report", "", "https://example.com/a/report"), ("https://example.com/report?utm_source=chat&utm_medium=answer", "", "https://example.com/report"), ("https://example.com/report?lang=en&utm_campaign=x", "", "https://example.com/report?lang=en"),
    ("https://example.com/report?page=2&gclid=abc", "", "https://example.com/report?page=2"), ("https://example.com/report%2F2026", "", "https://example.com/report%2F2026"), ("https://example.com/report%7Eteam", "", "https://example.com/report~team"),
    ("https://example.com/report?file=a%2Fb", "", "https://example.com/report?file=a%2Fb"), ("https://example.com/report?x=1&x=2", "", "https://example.com/report?x=1&x=2"), ("https://example.com/report#pricing", "", "https://example.com/report"), ("https://example.com/report/..", "", "https://example.com/"),
    ("https://example.com//report", "", "https://example.com//report"), ("/docs/../guide", "https://example.com/base/index.html", "https://example.com/guide"), ("guide?utm_source=mail", "https://example.com/base/", "https://example.com/base/guide"), ("https://example.com/%ZZ", "", ""), ("https://example.com:bad/report", "", ""),
    ("ftp://example.com/report", "", ""), ("https://example.com/report?ref=partner&fbclid=xyz", "", "https://example.com/report?ref=partner"),
]
# Fixed golden input: answered rows of four engines, and the rates they come to.
AUDIT = "chatgpt y y y 2 y|chatgpt y n n 1 n|chatgpt y y n 0 n|chatgpt n - - - -|perplexity y y y 3 y|perplexity y y n 1 n|perplexity y n n 0 n|perplexity y y y 2 y|gemini y n n 0 n|gemini y y n 2 n|gemini y y y 1 y|gemini n - - - -|google-ai y y n 4 y|google-ai y n n 1 n|google-ai y y y 0 n|google-ai y y n 2 n"
RATES = {
    "answered_rows": "3/3 3/3 4/4 4/4", "mention_rate": "2/3 2/3 3/4 3/4", "recommendation_rate": "1/3 1/3 1/4 2/4", "brand_citation_rate_answer": "1/3 1/3 1/4 2/4", "brand_citation_rate_cited_answers": "1/2 1/2 1/3 2/3", "citation_present_rate_answer": "2/3 2/3 3/4 3/4",
}


def test_citation_keys(spark):
    df = spark.createDataFrame([(i, u, b or None) for i, (u, b, _) in enumerate(URLS)] + [(99, None, None)], "i int, u string, b string")
    got = {r["i"]: r for r in V.citation_keys(df, "u", "b").collect()}
    assert [got[i]["normalized_key"] for i in range(len(URLS))] == [k for *_, k in URLS]
    assert [got[i]["status"] for i in (0, 14, 16, 99)] == ["normalized", "relative-resolved", "rejected", "rejected"]
    assert got[15]["notes"] == V.NOTES[1]
    assert V.citation_key("https://e.example/a/")[0] == "https://e.example/a/"


def test_citation_metrics(spark):
    word = {"y": "yes", "n": "no", "-": None}
    data = [(e, word[a], word[m], word[r], None if n == "-" else int(n), word[c]) for e, a, m, r, n, c in (x.split() for x in AUDIT.split("|"))]
    got = A.citation_metrics(spark.createDataFrame(data, "engine string, answer_available string, brand_mentioned string, brand_recommended string, citation_count int, cited_brand_source string")).collect()
    assert len(got) == 24
    for r in got:
        n, d = map(int, RATES[r["metric"]].split()[["chatgpt", "gemini", "google-ai", "perplexity"].index(r["engine"])].split("/"))
        assert (r["numerator"], r["denominator"], r["rate"]) == (n, d, round(n / d, 4))


def test_snapshots_coverage_and_rows(spark):
    s = "k string, e string, mention boolean, rank int, domains array<string>"
    a = spark.createDataFrame([("p1", "x", True, 1, ["a", "b"]), ("p2", "x", None, None, None), ("p3", "x", True, 2, [])], s)
    b = spark.createDataFrame([("p1", "x", False, 1, ["b", "c"]), ("p2", "x", None, None, None), ("p4", "x", True, 2, [])], s)
    got = S.answer_diff(a, b, ["k", "e"], ["mention", "rank"], {"citation_domain": "domains"})
    assert rows(got) == [("p1", "x", "citation_domain_addition", "citation_domain", "", "c"), ("p1", "x", "citation_domain_removal", "citation_domain", "a", ""), ("p1", "x", "field_change", "mention", "true", "false"), ("p3", "x", "prompt_set_gap", "record", "present", "missing"), ("p4", "x", "prompt_set_gap", "record", "missing", "present")]
    prompts = spark.createDataFrame([("1", "active", "new"), ("2", "active", " old"), ("2", "odd", "x"), ("3", "disabled", "new")], "prompt_id string, status string, stage string")
    need = spark.createDataFrame([("stage", "new", 2), ("place", "x", -1)], "dimension string, value string, minimum int")
    assert rows(S.coverage(prompts, ["stage"], need, "status")) == [("place", "x", -1, 0, True), ("stage", "new", 2, 1, False)]
    assert rows(S.unrecognised(prompts, ["stage"], need, "status")) == [("stage", "old")]
    assert rows(S.coverage_errors(prompts, ["stage"], need)) == [("duplicate_prompt_id", "2"), ("invalid_minimum", "place=x"), ("unknown_dimension", "place"), ("unknown_status", "odd")]
    answers = spark.createDataFrame([(2, "r1", "available", "True", "false", "2"), (3, "r1", "available", "maybe", "", "-1"), (4, " ", "unavailable", "", "yes", "3"), (5, "r2", "gone", None, None, None)], "row int, run_id string, answer_status string, brand_mentioned string, brand_recommended string, citation_count string")
    got = sorted((r["code"], r["row"], r["field"], r["first_row"]) for r in S.audit_row_errors(answers).collect())
    assert got == [("blank_run_id", 4, "", None), ("duplicate_run_id", 3, "", 2), ("invalid_answer_status", 5, "", None), ("invalid_boolean", 3, "brand_mentioned", None), ("invalid_boolean", 3, "brand_recommended", None), ("invalid_citation_count", 3, "", None), ("unavailable_field_must_be_blank", 4, "brand_recommended", None), ("unavailable_field_must_be_blank", 4, "citation_count", None)]
    net = spark.createDataFrame([("a1", "p", "e", "X", True), ("a1", "p", "e", " Y", False), ("a2", "q", "e", "X", False), ("a2", "q", "f", "Y", True), ("a3", "q", "f", "", True)], "a string, p string, e string, b string, r boolean")
    edges, nodes = S.co_mention_network(net, "a", "b", "p", "e", F.col("r"))
    assert rows(edges) == [("X", "Y", 2, "a1;a2")]
    assert rows(nodes) == [("X", 2, 2, 1, 1), ("Y", 2, 2, 2, 1)]
    runs = spark.createDataFrame([("g", "1", "a"), ("g", "2", "a"), ("g", "2", "b"), ("g", "3", None)], "g string, r string, i string")
    assert rows(S.set_coverage(runs, "g", "r", "i")) == [("g", "a", 2, 0.666667), ("g", "b", 1, 0.333333)]


def test_corpus(spark):
    ddl = "case_id string, category string, ambiguity string, claims array<struct<claim_id:string,marker_detected:boolean,marker_kind:string,source_ids:array<string>,claim_support_label:string>>, sources array<struct<source_id:string>>"
    good = [("1", "inline", "none", [("c1", True, "numeric", ["s1"], "supported")], [("s1",)])]
    expected = spark.createDataFrame([("1", "c1", "True", "numeric", "supported", "1", "none")], "case_id string, claim_id string, marker_detected string, marker_kind string, claim_support_label string, source_count string, ambiguity string")
    assert V.corpus_errors(spark.createDataFrame(good, ddl), expected, ("inline",)).count() == 0
    assert V.corpus_table(spark.createDataFrame(good, ddl)).count() == 1
    bad = [("1", "inline", "x", [("c1", False, "numeric", ["s2"], "likely"), ("c9", True, "a", [], "supported")], [("s1",)]), ("1", "inline", "none", [], None)]
    got = {r["code"] for r in V.corpus_errors(spark.createDataFrame(bad, ddl), expected, ("inline", "footnote")).collect()}
    assert got == {"case_id", "missing_category", "unexpected_claim", "no_claims", "unresolved_source", "label_mismatch", "metadata_mismatch", "support_label", "undetected_kind"}


def test_bundle(spark, tmp_path):
    (tmp_path / "a.csv").write_text("answer_id,citation_id\n1,c1\n2,c9\n")
    (tmp_path / "c.csv").write_text("citation_id\nc1\n")
    size = lambda n: {"path": n, "bytes": (tmp_path / n).stat().st_size, "sha256": hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()}
    manifest = {"manifest_version": "1.0", "files": [size("a.csv"), size("c.csv")], "references": [{"source": "a.csv", "field": "citation_id", "target": "c.csv", "id_field": "citation_id"}]}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    assert rows(V.bundle_issues(spark, str(tmp_path))) == [("internal_id_missing", "a.csv:citation_id=c9 not in c.csv:citation_id")]
    manifest |= {"manifest_version": "2", "files": [{**size("a.csv"), "bytes": 1}, {**size("c.csv"), "sha256": "x"}, {"path": "../x"}, {"path": "no.csv"}], "references": [{"source": "zz"}]}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    assert {r["code"] for r in V.bundle_issues(spark, str(tmp_path)).collect()} == {"manifest_version", "byte_size", "hash_format", "unsafe_path", "file_missing", "reference_path"}


def test_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\nz,y\n")
    with pytest.raises(ValueError, match="1 cells of a"):
        files.read_csv(spark, str(tmp_path / "x.csv"), "a int, b string", strict=True)
    assert files.dimensions_of(spark, str(tmp_path / "x.csv"), ("a",)) == ["b"]
    (tmp_path / "x.json").write_text('[{"k": "p", "v": 1}, {"k": "q", "v": 2}, {"k": "p", "v": 3}]')
    assert rows(files.read_json_array(spark, str(tmp_path / "x.json"), "k string, v int", ["k"])) == [("p", 3), ("q", 2)]
    files.write_csv(spark.createDataFrame([("b", None), ("a", 1)], "k string, v int"), str(tmp_path / "out"), ["k"])
    assert next((tmp_path / "out").glob("*.csv")).read_text() == "k,v\na,1\nb,\n"
    files.write_report(spark, {"b": 1, "a": [1.5]}, str(tmp_path / "rep"), None, True)
    assert next((tmp_path / "rep").glob("*.txt")).read_text() == '{"a":[1.5],"b":1}\n' == files.report_text({"b": 1, "a": [1.5]}, None, True)
    done = spark.createDataFrame([(True, "a"), (False, "b")], "ok boolean, d string")
    assert [r["d"] for r in files.unfinished(spark.createDataFrame([("a",), ("b",)], "d string"), done, "d").collect()] == ["b"]


def test_jdbc(spark):
    url, driver = "jdbc:derby:memory:kits;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.createDataFrame([(i, f"n{i}", None if i % 3 else i / 2) for i in range(100)], "id int, name string, x double")
    write_jdbc(df, url, "T1", driver=driver)
    write_jdbc(df.where("id < 5"), url, "T1", driver=driver)
    got = read_jdbc(spark, url, "T1", "id", 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 105 and got.where("id = 3").count() == 2
    write_jdbc(df.limit(0), url, "T2", driver=driver)
    assert read_jdbc(spark, url, "T2", "id", driver=driver).count() == read_jdbc(spark, url, "T2", driver=driver).count() == 0


def test_robots_and_sitemaps(spark):
    r = T.read_robots("User-agent: a\nUser-agent: B\nDisallow: /x\nAllow: /x/y$\nCrawl-delay: 3\nOdd: 1\nSitemap: /m.xml\nUser-agent: *\nDisallow: /")
    assert [T.deciding_rule(r, p, a)[:2] for p, a in (("/x/y", "b"), ("/x/yz", "b"), ("/q", "b"), ("/q", "c"))] == [(True, "Allow: /x/y$"), (False, "Disallow: /x"), (True, None), (False, "Disallow: /")]
    got = T.robots_facts(spark.createDataFrame([(1, "User-agent: *\nDisallow: /\nSitemap: /m"), (2, None), (3, "<html>")], "k int, t string"), "k", "t").orderBy("k").collect()
    assert (got[0]["all_blocked"], got[0]["n_relative_sitemaps"], got[1]["n_groups"], got[2]["is_html"]) == (True, 1, None, True)
    xml = b"<urlset><url><loc> https://e.example/a?x=1&amp;y </loc><lastmod>2026-01-02</lastmod></url></urlset>"
    assert T.sitemap_file(xml) == T.sitemap_file(gzip.compress(xml)) == ("urlset", [("https://e.example/a?x=1&y", "2026-01-02")])
    assert T.sitemap_file(b"https://e.example/a\nhttps://e.example/b\n")[0] == "text"
    assert T.sitemap_file(b"<x><loc>https://e.example/a</loc></x>") == ("urlset", [("https://e.example/a", None)])
    assert T.sitemap_file(b"<html></html>") == T.sitemap_file(b"") == T.sitemap_file(b"\x1f\x8bxx") == ("invalid", [])
    e = T.sitemap_entries_of(spark.createDataFrame([("s", bytearray(xml))], "k string, b binary"), "k", "b")
    assert {(r["item"], r["status"]) for r in T.sitemap_items(e, "k", F.lit("e.example")).collect()} == {("entries", "pass"), ("copies", "pass"), ("other hosts", "pass"), ("unread days", "pass"), ("share with days", "info")}


def test_log_summary(spark):
    line = lambda ip, agent: f'{ip} - - [01/Jan/2026:00:00:00 +0000] "GET / HTTP/1.1" 200 5 "-" "{agent}"'
    lines = [line("192.0.2.9", "x OneBot/1"), line("203.0.113.9", "onebot"), line("2001:db8::7", "OneBot"), line("host", "OneBot"), line("192.0.2.9", "TwoBot"), line("192.0.2.9", "curl"), "broken", None]
    df = L.log_lines(spark.createDataFrame([(x,) for x in lines], "line string"), "line")
    got = K.log_summary(df, [("OneBot", "search"), ("TwoBot", "user")], {"OneBot": "one", "TwoBot": "two"}, [("one", "192.0.2.77/24"), ("one", "2001:db8::1/32")])
    assert rows(got) == [("OneBot", "search", "mismatch", 2), ("OneBot", "search", "verified", 2), ("TwoBot", "user", "not_checked", 1), ("_TOTAL", "all", "malformed_lines", 2), ("unknown", "unknown", "not_checked", 1)]
    assert rows(K.log_summary(df.limit(0), [], {}, [])) == [("_TOTAL", "all", "malformed_lines", 0)]


def test_markdown(spark):
    text = "Start [a](https://x.example/y) and [b](/in) ![p](https://x.example/p.png).\r\n\r\n## What now?\n\nOne. Two. Three. Four. Five. Six.\n\n## List\n- a\n\n## Long\n" + "word " * 80 + "\n\n```\n## no\n```\n[own](https://www.e.example/)"
    got = Q.markdown_measures(spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, t string"), "k", "t", "e.example").orderBy("k").collect()
    assert tuple(got[0])[1:] == (96, 1, 1, 2, 3, 1, 1, 1, 1)
    assert tuple(got[1])[1:] == (0,) * 9 and set(tuple(got[2])[1:]) == {None}


def test_pictures():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + (480).to_bytes(2, "big") + (640).to_bytes(2, "big") + b"\0\0\0\0"
    assert T.image_size(png) == ("png", 640, 480)
    assert T.image_size(jpeg) == ("jpeg", 640, 480)
    assert T.image_size(b"GIF89a" + b"\x10\0\x20\0") == ("gif", 16, 32)
    assert T.image_size(b"\0\0\1\0\1\0\x30\x30" + b"\0" * 14)[0] == "ico"
    assert T.image_size(b'<svg viewBox="0 0 24 12">') == ("svg", 24, 12)
    assert T.image_size(b"") == T.image_size(b"plain") == (None, None, None)


def test_small_values(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    d = lambda s: F.lit(s).cast("date")
    assert one(M.months_ago(d("2026-05-31"), 3)) == date(2026, 3, 3)
    assert one(M.pacific_day(F.lit(datetime(2026, 7, 1, 6)))) == date(2026, 6, 30)
    assert one(M.days_since(F.lit(datetime(2026, 7, 1)), F.lit(datetime(2026, 6, 30, 12)))) == -1
    assert json.loads(one(M.merged_json(F.lit('{"a": 1, "b": {"c": [2]}}'), F.lit('{"a": "x"}')))) == {"a": "x", "b": {"c": [2]}}
    df = spark.createDataFrame([(0.125, ["  Lamp“s ", "LAMP s", "ｘｙ", "a", None, "b c", "d e"], "1.2.3.4", "2026-01-01"), (2.675, None, None, None)], "n double, k array<string>, a string, d string")
    got = df.select(M.round_even(2)(F.col("n")).alias("n"), M.target_keywords(F.col("k")).alias("k"), M.day_key("s")(F.col("a"), F.col("d")).alias("h")).collect()
    assert [r["n"] for r in got] == [0.12, 2.67]
    assert got[0]["k"] == ["lamp s", "xy", "b c"] and got[1]["k"] == [] and len(got[0]["h"]) == 32 and got[1]["h"] is None
    text = "# Head\n\n- **Bold** and [link](x) `code`. " + "word " * 200 + "Then Ostado came. " + "tail " * 200
    out = one(M.excerpt(F.lit(text), F.lit("ostado"), 100))
    assert "Ostado" in out and len(out) <= 102 and out.startswith("…") and out.endswith("…")
    assert one(M.without_markup(F.lit(text))).startswith("Head Bold and link code.")
    assert one(M.excerpt(F.lit("short"), F.lit("x"))) == "short" and one(M.excerpt(F.lit(None).cast("string"), F.lit("x"))) == ""


def test_pairs(spark):
    pages = spark.createDataFrame([("s", "u1", "Garden lamps", "Lamps", 3), ("s", "u2", "Garden lamp care", None, 9), ("s", "u3", None, "Garden lamps", 1)], "site string, url string, title string, h1 string, inbound int")
    q = spark.createDataFrame([("s", "garden lamp"), ("s", "the"), ("s", "zebra")], "site string, query string")
    assert rows(P.best_pages(q, pages, F.array(F.lit("quorix")))) == [("s", "garden lamp", "u1", 1.0, 0.5)]
    heads = [(1, "Fix it"), (1, "Clean lamps"), (1, "Buy lamps"), (2, "Lamp buying"), (2, "Clean the lamp"), (2, "Fix a lamp"), (0, "Cleaning"), (0, "Clean lamps"), (0, "Our story")]
    df = spark.createDataFrame([("q", s, i, t) for i, (s, t) in enumerate(heads)], "query string, source int, ordinal int, t string").select("query", "source", "ordinal", P.X.heading_tokens(F.col("t")).alias("tokens"))
    assert P.topic_coverage(df, shared=2).first()["n_shared"] == 2
    res = [("s", "a.example", "acme", "brand", 1, "https://www.a.example/", "Acme", None, None), ("s", "a.example", "acme", "brand", 2, "https://news.example/acme", "Acme complaints", None, None), ("s", "a.example", "acme", "brand", 3, "https://reddit.com/r/acme", "Acme talk", None, None), ("s", "a.example", "acme", "reviews", 1, "https://www.trustpilot.com/acme", "Acme reviews", 4.5, 10), ("s", "a.example", "acme", "reviews", 2, "https://g2.com/other", "Other", 1.0, 5)]
    r = P.reputation(spark.createDataFrame(res, "site string, domain string, brand_key string, search string, position int, url string, title string, rating double, votes int")).first()
    assert (r["owns"], r["top3"], r["independent"], r["n_platforms"], r["rating"], r["forums"], r["negative"]) == (True, True, 1, 1, 4.5, 1, 1)
    found = P.found_pages(spark.createDataFrame([("s", "https://e.example/x", ["https://e.example/contact", "https://e.example/about"]), ("s", "https://e.example/help", None)], "site string, url string, links array<string>")).first()
    assert (found["about"], found["contact"]) == ("https://e.example/about", "https://e.example/help")
    seen = spark.createDataFrame([("g", 1, "a", "x"), ("g", 2, "a", "y"), ("g", 3, "b", "x"), ("g", 4, "c", None)], "g string, i int, a string, b string")
    assert sorted(r["i"] for r in P.first_seen(seen, "g", ["i"], "a", "b").collect()) == [1, 4]
    links = spark.createDataFrame([("s", "p", "https://e.example/a/"), ("s", "p", "https://e.example/moved"), ("s", "p", "https://e.example/none")], "site string, source string, target string")
    crawled = spark.createDataFrame([("s", "https://www.e.example/a", None), ("s", "https://e.example/b", "https://e.example/moved")], "site string, url string, final_url string")
    assert [r["url"] for r in P.linked_targets(links, crawled).orderBy("target").collect()] == ["https://www.e.example/a", "https://e.example/b", None]


def test_graph_scores(spark):
    ring = [("s", f"https://e.example/p{i}", "Garden lamp care" if i < 4 else f"Alone{i} thing", [f"https://e.example/p{(i + 1) % 4}"] if i < 4 else [], i) for i in range(6)]
    p = spark.createDataFrame(ring, "site string, url string, title string, links array<string>, depth int").withColumns({"ok": F.lit(True), "kind": F.lit("article"), "main_words": F.lit(500), "js_shell": F.lit(False), "tool": F.lit(False), "h1s": F.array().cast("array<string>"), "final_url": F.col("url"), "description": F.lit("Garden lamp care for oak chairs and pine tables"), "is_entry": F.col("depth") == 0})
    assert rows(R.cluster_subs(p)) == [("s", 100.0)]
    assert {(r["url"][-2:], r["inbound"], r["others"]) for r in R.inbound_counts(p).collect()} == {("p0", 1, 5), ("p1", 1, 5), ("p2", 1, 5), ("p3", 1, 5), ("p4", 0, 5), ("p5", 0, 5)}
    none = spark.createDataFrame([], "site string, url string")
    assert rows(R.focus_subs(p, none)) == [("s", pytest.approx(100 * (1 - (2 / 6) / 0.5)))]
