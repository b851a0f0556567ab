from datetime import date

import pytest
from pyspark.sql import functions as F

from citewise.functions import exprs as E
from citewise.functions import text as X
from citewise.sources import pages as P


def one(spark, f, *values):
    kinds = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], kinds).select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("r")).first()["r"]


TABLE = [
    (lambda c: X.count_markers(c, "experience"), [("We tested it. In our experience it’s fine; we used to run.", 2), (None, 0), ("hands-on case studies", 2)]),
    (lambda c: X.count_markers(c, "ymyl"), [("Taxes, loans and a lawyer", 3), ("text", 0)]),
    (X.count_data_points, [("On 2026-05-01 at 10:30 we saw 45% of 1,200 users, $5 and 7 others in 2024, v2.1, 007 and 3 days", 5), (None, 0), ("", 0)]),
    (X.years_in, [("In 2019 and 2021, © 2024 Us, see https://a.example/2018/x, 2020 ms, $ 2017, 12.05.2016 and v2015.1", [2016, 2019, 2021]), (None, []), ("1989 2100", [])]),
    (X.title_year, [("Best of 2024 and 2025", 2025), ("Model 20250", None), (None, None)]),
    (X.title_number, [("Top 10 lamps", 10), ("7 proven ways to sleep", 7), ("12 lamps", 12), ("404 errors explained", None), ("5 minutes with us", None), (None, None)]),
    (X.title_brand, [("Lamps for all | Quorix", "Quorix"), ("A - b – Two Words", "Two Words"), ("No brand", None), ("What? - Really?", None)]),
    (X.clickbait_hits, [("You won't believe this one trick!", 3), ("Plain title", 0), ("STOP NOW READ THIS LAMP", 1), ("A - shocking", 0)]),
    (X.is_question, [("How does it work", True), ("Why us", False), ("Is it? ", True), ("Lamps", False), ("", False), ("What's new", True), (None, False)]),
    (X.estimated_pixels, [("ilm A", 46), ("", 0), (None, 0)]),
    (X.light_stem, [("stories", "story"), ("glass", "glass"), ("lamps", "lamp"), ("bus", "bus")]),
    (X.stem, [("boxes", "box"), ("classes", "class"), ("news", "news"), ("stories", "story"), ("lamps", "lamp")]),
    (X.topic_tokens, [("The best garden lamps of 2024 for gardens", ["garden", "lamp"]), (None, [])]),
    (X.heading_tokens, [("How to fix boxes in the 1990s, don't", ["fix", "box"]), (None, [])]),
    (X.keyword_key, [("Lamps for the garden", "garden lamp"), ("garden lamp", "garden lamp")]),
    (X.domain_label, [("https://www.shop.example.co.uk/x", "example"), ("quorix.example", "quorix"), ("local", "local")]),
    (X.organisation_key, [("Quorix Inc.", "quorix"), ("Ärzte & Co", "ärzte")]),
    (X.path_of, [("https://a.example", "/"), ("https://a.example/x/y?z#f", "/x/y")]),
    (X.is_tool_path, [("https://a.example/login?x", True), ("https://a.example/loginx", False)]),
    (X.slug_topic, [("https://a.example/blog/garden-lamps-2024.html", ["garden", "lamp"]), ("https://a.example/about-us", None), ("https://a.example/lamp", None)]),
    (X.sentence_count, [("Dr. Who met J. Doe at 3 p.m. today. Yes! No?\n\nNew line", 4), ("", 0), (None, 0), ("... --- ", 0)]),
    (X.defines, [("A lamp is a thing that shines.", True), ("This is a lamp.", False)]),
    (P.is_authoritative, [("https://www.nasa.gov/x", True), ("https://a.ac.uk/", True), ("https://en.wikipedia.org/", True), ("https://a.example/", False), (None, False)]),
    (P.author_name, [("By Jane van Doe | 3 May", "Jane van Doe"), ("Written by The Example Team", "Example Team"), ("admin", None), ("jane doe is an editor", None)]),
    (P.iso_date, [("2026-05-01T10:00:00Z", date(2026, 5, 1)), ("20260501", date(2026, 5, 1)), ("2026-02-30", None), ("May 1, 2026", date(2026, 5, 1)), ("1 May 2026", date(2026, 5, 1)), ("x", None), ("1989-01-01", None)]),
    (E.is_user_content, [("https://old.reddit.com/r/x", True), ("https://forum.a.example/x", True), ("https://a.example/forums/x", True), ("https://github.com/a/b/issues/3", True), ("https://github.com/a/b", False), ("nothing", False)]),
    (E.is_assistant, [("ChatGPT Plus", True), ("Claude.ai", True), ("Quorix", False), (None, False)]),
]


@pytest.mark.parametrize(("f", "cases"), TABLE)
def test_values(spark, f, cases):
    got = [r["r"] for r in spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, c string").select("i", f(F.col("c")).alias("r")).orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_intents_and_matches(spark):
    brands = F.array(F.lit("quorix"))
    for q, want in (("quorix login", "navigational"), ("quorix vs drafly", "commercial"), ("lamp prices", "transactional"), ("lamps near me", "local"), ("how to fix a lamp", "informational"), ("quorix lamps", "navigational"), ("lamps", "informational"), (None, None)):
        assert one(spark, lambda c: X.intent(c, brands), q) == want
    assert one(spark, lambda c: X.core_tokens(c, F.array(F.lit("quorix"))), "best quo rix lamps for quorixes") == ["best", "lamp"]
    assert one(spark, lambda a, b: X.same_topic(a, b), "Fix the lamp", "Lamp oil") is False
    assert one(spark, lambda a, b: X.same_topic(a, b), "Garden lamp care", "Care of a garden lamp") is True
    assert one(spark, lambda a, b: X.intent_match(F.lit("commercial"), F.lit(False), a, b), "listicle", "comparison") is True
    assert one(spark, lambda a, b: X.intent_match(F.lit("local"), F.lit(True), a, b), "article", "other") is None
    assert one(spark, lambda q: X.is_label_query(q, "hp"), "hp printer") is True
    assert one(spark, lambda q: X.is_label_query(q, "hp"), "whp printer") is False
    assert one(spark, lambda b, u: E.brand_hit(b, F.lit("quorix.example"), u, F.lit("")), "Quorix", "https://blog.quorix.example/x") is True


def test_page_types_and_formats(spark):
    none = F.array().cast("array<string>")
    for path, checks, parsed in (("", "home", "home"), ("/pricing", "pricing", "pricing"), ("/privacy-policy", "legal", "legal"), ("/about", "contact", "contact"), ("/product/lamp", "product", "product"), ("/blog/x", "article", "article"), ("/blog/", "listing", "listing"), ("/blog/tag/x", "article", "listing"), ("/docs/x", "other", "article"), ("/x", "other", "other")):
        u = f"https://a.example{path}"
        assert one(spark, lambda c: X.page_type(c, none, F.lit(0), F.lit(0), F.lit(0)), u) == checks
        assert one(spark, lambda c: X.parsed_page_type(c, none, F.lit(0)), u) == parsed
    fmt = lambda t, kind="other", items=0, h2=0, para="": one(spark, lambda c: X.page_format(c, F.lit(kind), F.lit(False), none, F.lit(h2), F.lit(0), F.lit(items), F.lit(0), F.lit(para), F.lit("")), t)
    assert [fmt("Lamp vs bulb"), fmt("10 best lamps"), fmt("How to fix it"), fmt("What is a lamp"), fmt("Lamp", para="A lamp is a light."), fmt("Lamp", "product"), fmt("Lamp", items=9, h2=6), fmt("Lamp", "article"), fmt("Lamp")] == ["comparison", "listicle", "how-to", "definition", "definition", "product", "listicle", "article", "other"]


HTML = """<!doctype html><html lang="en"><head><title>7 ways to care for lamps | Quorix</title><meta property="og:site_name" content="Quorix"><link rel="alternate" hreflang="de" href="/de"><link rel="icon" href="/f.ico">
<script type="application/ld+json">{"@type": "Article", "author": {"name": "Jane Doe"}, "datePublished": "2026-05-01", "publisher": {"@type": "Organization", "name": "Quorix", "sameAs": ["a", "b"]}}</script></head>
<body><nav><a href="/">Home</a></nav><div class="promo-popup">x</div><main><h1>Lamp care</h1><p>We tested 45 lamps in our experience and the results were clear for all of us in 2024.</p><h2>How do lamps work?</h2><ul><li>First clean it well.</li><li>Then dry it.</li></ul>
<p>See <a href="https://www.nasa.gov/x">the study</a> and <a href="/next">next</a>, or write to a@b.example.</p><img src="/own/lamp.jpg" width="300" height="200"><img src="https://images.pexels.com/a.jpg"></main><footer><a href="/privacy">Privacy</a></footer></body></html>"""


def test_signals(spark):
    df = spark.createDataFrame([("1", HTML, "https://quorix.example/blog/lamps"), ("2", None, None)], "id string, h string, u string")
    f = P.parse_pages(df, "id", "h", "u").join(df.select("id", "u"), "id")
    r = P.page_signals(f, "id", F.col("u")).where("id = '1'").first()
    assert (r["n_experience"], r["n_original"], r["n_authoritative"], r["n_outbound"], r["n_own_images"], r["n_stock_images"], r["n_questions"], r["n_lists"], r["n_list_items"]) == (2, 0, 1, 1, 1, 1, 1, 1, 2)
    assert (r["author_name"], r["date_published"], r["org_name"], r["n_same_as"], r["site_name"], r["title_brand"], r["title_number"]) == ("Jane Doe", date(2026, 5, 1), "Quorix", 2, "Quorix", "Quorix", 7)
    assert (r["page_type"], r["format"], r["n_interstitials"], r["contact_details"], r["byline"], r["body_years"], r["n_next_steps"]) == ("article", "listicle", 1, ["email"], True, [2024], 1)
    assert r["first_paragraph"].startswith("We tested 45 lamps")
    facts = f.where("id = '1'").first()
    assert ([h["lang"] for h in facts["hreflang"]], facts["has_favicon"], facts["nav_links"]) == (["de"], True, ["https://quorix.example/", "https://quorix.example/privacy"])
