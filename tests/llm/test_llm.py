import random
from collections import Counter
from itertools import chain

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citewise.llm import dyadic, frequent
from citewise.llm.bpe import Encoder, token_counts, token_ids, unlike, vocabulary
from citewise.llm.packing import pack, sum_of_squares
from citewise.llm.pii import Names, View, find, learn_names, normalised, personal_data, redact, redacted
from citewise.llm.splitting import Splitter, split_block, split_texts

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def enc():
    return Encoder(vocabulary("byte_bpe_50k"))


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


# --- encoding


ODD = ["", " ", "a", "aaaa" * 500, "ab" * 999, "日本語のテキスト" * 50, "  \n\n x\t\t", "<|endoftext|> is text", "½ ² Ⅷ ①x", "can't I'LL we've", "\x1c\x1d a\x1fb", "é́ ﷺ 🙋🏽‍♀️", "0" * 333, "_a__b_ c_", " x y\u0085z"]


def test_encoding_equals_the_public_one(enc, public):
    ids, at = enc.encode(ODD)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [public(t) for t in ODD]
    assert enc.count(ODD).tolist() == [len(public(t)) for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_encoding_of_any_text(texts):
    e, p = test_encoding_of_any_text.pair
    ids, at = e.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [p(t) for t in texts]


@pytest.fixture(autouse=True)
def _pair(enc, public):
    test_encoding_of_any_text.pair = (enc, public)


def test_both_matchers_split_alike(enc):
    """Every code point the faster matcher may see, alone and beside letters, digits, spaces, signs and contractions."""
    odd = unlike()
    for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000))):
        if not odd[ord(c)]:
            t = f"a{c}1{c} {c}{c}_'s{c}  {c}"
            assert enc.fast(t) == enc.exact(t), hex(ord(c))
    assert odd[ord("Ⅷ")] and odd[0x1C] and not odd[ord("é")] and enc.split("xⅧ\x1d y") == enc.exact("xⅧ\x1d y")


def test_memory_is_bounded(public, monkeypatch):
    import citewise.llm.bpe as bpe

    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    e = Encoder(vocabulary("byte_bpe_50k"))
    for t in ["one two three four", "five six seven", "one two"]:
        assert e.encode([t])[0].tolist() == public(t)


def test_token_tables(spark, public):
    data = [(1, "hello world"), (2, ""), (3, None), (4, "hello world"), (4, "x" * 3000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(9))
    assert rows(token_ids(df)) == sorted(((k, public(t or "")) for k, t in data), key=str)
    assert rows(token_counts(df)) == sorted(((k, len(public(t or ""))) for k, t in data), key=str)
    assert token_ids(df.limit(0)).count() == 0


# --- packing


def brute_sum_of_squares(sizes, capacity):
    gaps, out = [], []
    for s in sizes:
        def total(g):
            return sum(n * n for x, n in Counter(g).items() if 0 < x < capacity)
        best = None
        for gap in sorted({g for g in gaps if g >= s and 0 < g < capacity}):
            i = max(j for j, g in enumerate(gaps) if g == gap)
            after = [*gaps[:i], gap - s, *gaps[i + 1 :]]
            if best is None or total(after) < best[0]:
                best = (total(after), after)
        new = [*gaps, capacity - s]
        if best is None or total(new) < best[0]:
            best = (total(new), new)
        gaps = best[1]
        out.append(total(gaps))
    return out, len(gaps)


def test_sum_of_squares_keeps_the_least_sum():
    rng = random.Random(1)
    for _ in range(40):
        sizes = [rng.randint(1, 12) for _ in range(40)]
        bins = sum_of_squares(np.array(sizes), 12).tolist()
        gaps, sums = [], []
        for s, b in zip(sizes, bins, strict=True):
            if b == len(gaps):
                gaps.append(12)
            gaps[b] -= s
            assert gaps[b] >= 0
            sums.append(sum(n * n for g, n in Counter(gaps).items() if 0 < g < 12))
        assert sums == brute_sum_of_squares(sizes, 12)[0]


def test_pack(spark):
    rng = random.Random(2)
    data = [(i, rng.randint(1, 60)) for i in range(800)] + [(900, 350), (901, 100), (902, 200), (903, 0), (904, None), (905, -3), (906, 7), (906, 7)]
    df = spark.createDataFrame(data, "doc_id long, n_tokens long").withColumn("group", F.lit("clash")).withColumn("piece", F.lit(1))
    got = pack(df, 100, per_group=300).collect()
    used = Counter()
    for r in got:
        used[r["container"]] += r["n_tokens"]
    assert max(used.values()) <= 100
    assert all(used[r["container"]] == r["fill"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["n_tokens"]))
    assert sorted(by[900]) == [(0, 0, 100), (1, 100, 100), (2, 200, 100), (3, 300, 50)]
    assert sorted(by[901]) == [(0, 0, 100)]
    assert sorted(by[902]) == [(0, 0, 100), (1, 100, 100)]
    assert by[903] == by[904] == by[905] == [(0, 0, 0)]
    assert len(by[906]) == 2
    assert all(len(by[k]) == 1 and by[k][0][2] == n for k, n in data[:800])
    assert sum(used.values()) / (100 * len(used)) > 0.96
    assert rows(pack(df, 100, per_group=300)) == sorted((tuple(r) for r in got), key=str)
    assert pack(df.limit(0), 100).count() == 0


# --- splitting


TEXTS = [
    "One sentence here. Another one follows! And a third? " * 60,
    "\n\n".join("Paragraph %d has some words, and more of them." % i for i in range(120)),
    "a" * 4000, "日本語の文章です。" * 300, " " * 3000, "\n" * 2000, "x" * 1500 + "\n\n" + "y z " * 500, "line one\n" * 400, "short", "", None, "🙋🏽‍♀️" * 400,
]


@pytest.mark.parametrize(("limit", "overlap"), [(64, 16), (50, 0), (10, 9), (2, 1), (1, 0)])
def test_pieces(enc, public, limit, overlap):
    for text, pieces in zip(TEXTS, split_block(Splitter(enc, limit, overlap), TEXTS), strict=True):
        if not text:
            assert pieces == []
            continue
        assert pieces[0][0] == 0
        assert pieces[-1][1:] == (len(text), pieces[-1][2], "end")
        for a, b, n, kind in pieces[:: max(1, len(pieces) // 40)]:
            assert n == len(public(text[a:b]))
            # one character of several tokens may alone be more than a tiny limit
            assert n <= limit or b - a == 1
        for p, q in zip(pieces, pieces[1:], strict=False):
            assert p[0] < q[0] <= p[1] < q[1]
            if overlap == 0:
                assert q[0] == p[1]


def test_pieces_with_a_full_store(enc, monkeypatch):
    import citewise.llm.bpe as bpe

    want = split_block(Splitter(enc, 64, 16), TEXTS)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = Splitter(Encoder(vocabulary("byte_bpe_50k")), 64, 16)
    assert [split_block(small, TEXTS) for _ in range(2)] == [want, want]


def test_natural_boundaries_come_first(enc):
    [paragraphs] = split_block(Splitter(enc, 64, 16), [TEXTS[1]])
    assert {k for *_, k in paragraphs[:-1]} == {"paragraph"}
    [sentences] = split_block(Splitter(enc, 64, 16), [TEXTS[0]])
    assert {k for *_, k in sentences[:-1]} == {"sentence"}
    assert all(TEXTS[0][:b].rstrip()[-1] in ".!?" for _, b, _, k in sentences)
    assert "hard" in {k for *_, k in split_block(Splitter(enc, 64, 16), ["a" * 4000])[0]}


def test_overlap_is_given(enc, public):
    for text in TEXTS[:2]:
        [pieces] = split_block(Splitter(enc, 64, 16), [text])
        for p, q in zip(pieces, pieces[1:], strict=False):
            assert 14 <= len(public(text[q[0] : p[1]])) <= 24


def test_split_table(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = split_texts(df, 64, 16)
    assert all(r["piece_text"] == TEXTS[r["doc_id"]][r["start_pos"] : r["end_pos"]] for r in got.collect())
    assert {r["doc_id"] for r in got.collect()} == {i for i, t in enumerate(TEXTS) if t}
    assert split_texts(df.limit(0), 64, 16).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, 64, 64)


# --- names in no list

OUTSIDE = [
    ("My name is Ottoline Quarmby and I sell tea.", "Ottoline Quarmby"), ("Ich heiße Dörte Wackernagel.", "Dörte Wackernagel"), ("Je m'appelle Mathurin Lefeuvre", "Mathurin Lefeuvre"),
    ("Me llamo Íñigo Zubizarreta, gracias", "Íñigo Zubizarreta"), ("Please call.\nKind regards,\nThaddeus Pellinore", "Thaddeus Pellinore"), ("Dear Ms. Araminta Skelhorn,\nthanks", "Araminta Skelhorn"),
    ("Best regards, Q. Winterbourne", "Q. Winterbourne"), ("Ask for Q. Winterbourne at the desk", "Q. Winterbourne"), ("Frau Wackernagel ruft zurück", "Wackernagel"), ("I spoke to Thaddeus Pellinore", "Thaddeus Pellinore"),
    ("Yesterday Ottoline Quarmby rang twice.", "Ottoline Quarmby"), ("Thaddeus was there", "Thaddeus"),
]


def test_names_by_context_alone():
    """Without any learned name, ten of twelve are found, those that context gives away."""
    hit = [any((k, t[a:b]) == ("person", n) for k, a, b in find(t)) for t, n in OUTSIDE]
    assert hit == [True] * 10 + [False] * 2
    for t in ("My name is on the list", "Dear Pottery Company,\nhello", "Regards,\nThe Team", "Hello Garden Studio,\n", "I spoke to Garden Pottery GmbH", "Summer Lake Road is closed"):
        assert find(t) == []


def invented(seed, n_given, n_family):
    """Given and family names of random syllables."""
    rng = random.Random(seed)
    part = lambda: rng.choice("b d f g k l m n p r s t v z".split()) + rng.choice("a e i o u ai ei ou".split())
    made = lambda k, end: ("".join(part() for _ in range(k)) + end).capitalize()
    return sorted({made(2, rng.choice(["", "n", "l"])) for _ in range(n_given)}), sorted({made(3, rng.choice(["r", "nd", "x", "th"])) for _ in range(n_family)})


def test_learned_names_find_the_rest(spark):
    """Names learned from one half of the leads' name field are found in the texts of the other, whose full names occur nowhere in the first."""
    given, family = invented(7, 40, 120)
    rng = random.Random(8)
    pairs = [(g, f) for g in given for f in rng.sample(family, 60)]
    rng.shuffle(pairs)
    half = len(pairs) // 2
    forms = [lambda g, f: f"{g} {f}", lambda g, f: f"{f}, {g}", lambda g, f: f"{g.upper()} {f.upper()}", lambda g, f: f"{g} {f} <x@y.example>", lambda g, f: f"{g} K. {f}"]
    data = [(rng.choice(forms)(g, f), None) for g, f in pairs[:half]] + [(x, None) for x in ("Zupo Studio", "Zupo GmbH", "Zupo Group", "", "x@y.example")]
    data += [("", f"{given[0]} Lamp works. {g} was here") for g in given[:30]]
    names = learn_names(spark.createDataFrame(data, "name string, message string"), ("name",), ("message",))
    assert names.given == {g.lower() for g in given} and len(names.family) > 110 and "studio" not in names.family and "zupo" not in names.given
    assert names.phrases == {(given[0].lower(), "lamp")}
    found = true = right = 0
    for g, f in pairs[half:]:
        text, want = rng.choice([(f"We met {g} {f} at noon.", f"{g} {f}"), (f"The guide by {g.lower()} {f.lower()} is old", f"{g.lower()} {f.lower()}"), (f"{g} says hello", g), (f"ask {f}, {g} about Summer Lake", f"{f}, {g}"), (f"{g[0]}. {f} and Meadow Hall", f"{g[0]}. {f}")])
        got = [text[a:b] for k, a, b in find(text, names=names) if k == "person"]
        true, found, right = true + 1, found + len(got), right + (want in got)
    assert right / true > 0.97 and right / found > 0.97
    none = learn_names(spark.createDataFrame([(None, None)], "name string, message string"), ("name",), ("message",))
    assert not none.any and not none.phrases


def test_lower_case_at_and_dot():
    for t, want in (("write to jane at firm dot com please", "jane at firm dot com"), ("jane dot roe at mail dot firm dot co dot uk.", "jane dot roe at mail dot firm dot co dot uk"), ("Jane.Roe at firm Dot example", "Jane.Roe at firm Dot example")):
        assert [t[a:b] for k, a, b in find(t) if k == "email"] == [want]
    for t in ("look at firm dot com", "we met at noon", "the red dot at home", "found at shop dot example"):
        assert not [k for k, _, _ in find(t) if k == "email"]


# --- frequent items


def test_frequent(spark, monkeypatch):
    rng = random.Random(3)
    data = [("hot",)] * 3000 + [(f"warm{i % 7}",) for i in range(1400)] + [(f"rare{i}",) for i in range(5000)] + [(None,)] * 500 + [("",)] * 600
    rng.shuffle(data)
    true = Counter(x for (x,) in data)
    df = spark.createDataFrame(data, "query string").repartition(6).withColumn("page", F.lit("one")).withColumn("item", F.lit("clash")).withColumn("hash", F.lit(1))
    want = {("page", "one")} | {("query", k) for k, n in true.items() if k and n >= 0.01 * len(data)}
    for buckets, cells in ((4096, 1 << 16), (8, 16), (1, 1)):  # tiny sketches lose values from their buckets, never from the result
        monkeypatch.setattr(frequent, "BUCKETS", buckets)
        monkeypatch.setattr(frequent, "CELLS", cells)
        got = frequent.at_least(df, ("page", "query"), 0.01)
        assert {(r["field"], r["item"]) for r in got.collect()} == want
        assert all(r["n"] == true[r["item"]] for r in got.where("field = 'query'").collect())
        for r in frequent.frequent(df, ("query",), 10).collect():
            assert r["n_least"] <= true[r["item"]] <= r["n_most"]
    assert frequent.at_least(df.limit(0), ("page", "query"), 0.01).count() == 0
    assert frequent.frequent(df.limit(0), ("query",)).count() == 0


def test_frequent_of_one_bucket(spark):
    """Two frequent values that share a bucket both come out, with their rows."""
    hashes = spark.range(4000).selectExpr("concat('v', id) as item").withColumn("h", F.xxhash64("item")).collect()
    by_bucket: dict[int, list[str]] = {}
    for r in hashes:
        by_bucket.setdefault((r["h"] >> frequent.BUCKET_SHIFT) & (frequent.BUCKETS - 1), []).append(r["item"])
    a, b = next(x for x in by_bucket.values() if len(x) > 1)[:2]
    true = Counter({a: 900, b: 300} | {f"w{i}": 250 - i for i in range(8)} | {f"r{i}": 1 for i in range(3000)})
    data = [(x,) for x, n in true.items() for _ in range(n)]
    random.Random(5).shuffle(data)
    got = frequent.frequent(spark.createDataFrame(data, "query string").repartition(5), ("query",), 6).collect()
    assert [(r["place"], r["item"], r["n_least"], r["n_most"]) for r in sorted(got, key=lambda r: r["place"])] == [(i + 1, x, n, n) for i, (x, n) in enumerate(true.most_common(6))]


def test_merging_keeps_bounds(spark):
    data = [(f"v{i % 40}" if i % 3 else f"r{i}",) for i in range(6000)]
    true = Counter(x for (x,) in data)
    df = spark.createDataFrame(data, "query string")
    parts = [frequent.merge(frequent.sketch(df.where(F.pmod(F.hash("query", F.monotonically_increasing_id()), F.lit(3)) == i), ("query",))) for i in range(3)]
    merged = frequent.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    got = frequent.estimates(merged).collect()
    held = {r["item"] for r in got}
    lost = [f"v{i}" for i in range(40) if f"v{i}" not in held]  # two frequent values may share a bucket; the cells keep them
    cells = {r["cell"]: r["n"] for r in merged.where("cell is not null").collect()}
    assert len(lost) < 4
    for item in lost:
        h = spark.sql(f"select xxhash64('{item}')").first()[0]
        assert cells[h & (frequent.CELLS - 1)] >= true[item]
    assert all(r["n_least"] <= true[r["item"]] <= r["n_most"] for r in got)


# --- percentiles


def test_codes(spark):
    values = [-(2**63), -(2**40) - 12345, -70000, -65537, -65536, -1, 0, 1, 65535, 65536, 65537, 10**6, 2**31 - 1, 2**40 + 12345, 2**53 + 1, 2**62, 2**63 - 1]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(dyadic.encode(F.col("v"))).collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] < 2**dyadic.LEVELS
    assert len(set(got[3:11])) == 7  # 65536 and 65537 share one
    back = dyadic.decode(np.array(got))
    assert all(abs(float(b) - v) <= abs(v) * 2.0 ** -(dyadic.DIGITS + 1) * 1.01 for b, v in zip(back, values, strict=True))
    assert [r[0] for r in spark.createDataFrame([(None,)], "v long").select(dyadic.encode(F.col("v"))).collect()] == [None]


def test_sketch_holds_less_than_the_codes():
    """Every group is sketched; the lower levels have fewer counters than nodes."""
    assert dyadic.N_CELLS * 50 < 2**dyadic.LEVELS
    assert all(len(dyadic.SKETCHED) * dyadic.ROWS * dyadic.WIDTH < 2 ** (dyadic.LEVELS - level) for level in dyadic.SKETCHED[:5])
    cells = dyadic.sketch(np.array([dyadic.HALF + 7]), np.array([3]))
    assert int((cells != 0).sum()) == len(dyadic.EXACT) + dyadic.ROWS * len(dyadic.SKETCHED)


def table(spark, n=20000):
    rng = random.Random(4)
    data = [("a" if i % 3 else "b", i % 5, int(rng.lognormvariate(8, 2)) if i % 4 else 0) for i in range(n)] + [("a", 1, None), ("a", 1, -7), ("only null", 1, None), (None, 1, 5)]
    return data, spark.createDataFrame(data, "g string, day int, v long").withColumn("cell", F.lit("clash")).withColumn("w", F.lit("clash"))


def test_percentiles_days_and_deletions(spark):
    data, df = table(spark)
    days = dyadic.update(df, ["g", "day"], "v")
    whole = dyadic.update(df, ["g"], "v")
    assert rows(dyadic.combine(days, ["g"]).select("g", "cell", "n")) == rows(whole.select("g", "cell", "n"))
    rest = dyadic.subtract(whole, dyadic.combine(days.where("day = 2"), ["g"]), ["g"])
    assert rows(rest.select("g", "cell", "n")) == rows(dyadic.update(df.where("day <> 2"), ["g"], "v").select("g", "cell", "n"))
    got = {r["g"]: r for r in dyadic.quantiles(whole, ["g"], (0.1, 0.5, 0.9, 0.99)).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        v = np.sort([x for k, _, x in data if k == g and x is not None])
        assert r["n"] == len(v)
        for p, name in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"), (0.99, "p99")):
            slack = r[name] * 2.0**-dyadic.DIGITS
            low, high = np.searchsorted(v, r[name] - slack) / len(v), np.searchsorted(v, r[name] + slack, "right") / len(v)
            assert low - 0.01 <= p <= high + 0.01
    errors = dyadic.rank_errors(df, ["g"], "v", dyadic.quantiles(whole, ["g"])).collect()
    assert len(errors) == 12 and all(r["rank_error"] <= dyadic.RANK_ERROR for r in errors)
    assert dyadic.quantiles(dyadic.update(df.limit(0), ["g"], "v"), ["g"]).count() == 0
    negative = df.withColumn("sign", F.lit(-1))
    gone = dyadic.combine(whole.unionByName(dyadic.update(negative, ["g"], "v", F.col("sign"))), ["g"])
    assert gone.count() == 0


def test_percentiles_of_a_long_partition(spark):
    rows_in = 2 * dyadic.ROWS_IN + 50_000
    df = spark.range(0, rows_in, 1, 1).select(F.lit("a").alias("g"), (F.col("id") % 1000).alias("v"))
    got = dyadic.quantiles(dyadic.update(df, ["g"], "v"), ["g"], (0.5,)).collect()
    assert [(r["g"], r["n"]) for r in got] == [("a", rows_in)] and abs(got[0]["p50"] - 499) <= 1000 * dyadic.RANK_ERROR


# --- personal data


NAMES = Names(("orla", "bastien"), ("quenby", "tarrant"), (("orla", "jelly"),))
CASES = [
    ("Write to ann.lee+x@mail.example.org or call +44 20 7946 0279.", ["email:ann.lee+x@mail.example.org", "phone:+44 20 7946 0279"]),
    ("hello AT quorix DOT example / info [at] studio [dot] example [dot] net / a＠b.example / x @ raspod.test", ["email:hello AT quorix DOT example", "email:info [at] studio [dot] example [dot] net", "email:a＠b.example", "email:x @ raspod.test"]),
    ("Look at example.com at noon, field @name, follow us @brand", []),
    ("SSN: 928 38 9986, NINO QQ 60 25 65 B, mi DNI es 00.349.121-X, Steuer-ID 00 736 065 216", ["id_number:928 38 9986", "id_number:QQ 60 25 65 B", "id_number:00.349.121-X", "id_number:00 736 065 216"]),
    ("passport no. X74349338; driver's license # C084-4641-1234; carte d'identité Z17PH5468", ["id_number:X74349338", "id_number:C084-4641-1234", "id_number:Z17PH5468"]),
    ("Order 836-27-60948, invoice INV-2026-9999, ticket #966870347, SKU K62-7234, 192.0.2.36, 2026-05-16, v40.99.60", []),
    ("(303) 555-0122 or 1-404-555-0151 ext. 51 or (0491 570 340) or 06.39.98.40.41", ["phone:(303) 555-0122", "phone:1-404-555-0151 ext. 51", "phone:0491 570 340", "phone:06.39.98.40.41"]),
    ("call zero two zero seven nine four six zero one two three", ["phone:zero two zero seven nine four six zero one two three"]),
    ("our office is 1117 Fennimore Blvd, Villarrosa; 5 bis chemin du Wrenmoor; Saddlecroftstr. 98; Calle del Ottersby 97", ["address:1117 Fennimore Blvd", "address:5 bis chemin du Wrenmoor", "address:Saddlecroftstr. 98", "address:Calle del Ottersby 97"]),
    ('The 301 from Elm Street Bakery loops. 99 Avenue is a brand. Row 61: "Summer Hill Drive"', []),
    ("Dr. Orla Quenby, B. Quenby-Tarrant, O'Tarrant, Bastien H. and orla van tarrant", ["person:Orla Quenby", "person:B. Quenby-Tarrant", "person:O'Tarrant, Bastien H.", "person:orla van tarrant"]),
    ("Orla Pinkpot and Bastien Oddjar are our brands. Orla jelly for all", []),
    ("Orla Unheard came with Bastien Orla Quenby, Quenby GmbH and Orla's cat", ["person:Orla Unheard", "person:Bastien Orla Quenby", "person:Orla"]),
    ("Orla Garden Pots, Orla Studio, @Orla, Bastien & Co", []),
    ("Thanks\nBastien", ["person:Bastien"]),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_find(text, want):
    assert [f"{k}:{text[a:b]}" for k, a, b in find(text, names=NAMES)] == want
    out = redact(text, names=NAMES)
    for w in want:
        assert w.split(":", 1)[1] not in out


def test_lookalikes_and_positions():
    text = "🙋 ​mаrk@exаmple.org and 030‑23125‑75"  # Cyrillic a, hidden and odd characters
    kinds = {k: text[a:b] for k, a, b in find(text)}
    assert kinds["email"] == "mаrk@exаmple.org"
    assert find("x" * 10 + " " + text)[0][1] == find(text)[0][1] + 11


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 @.-()[]atdoAT DOT0123＠аé🙋​\n", max_size=80))
def test_spans_are_in_order_and_the_rest_stays(text):
    found = find(text)
    last = 0
    for _, a, b in found:
        assert last <= a < b <= len(text)
        last = b
    parts, at = [], 0
    for k, a, b in found:
        parts += [text[at:a], f"[{k.upper()}]"]
        at = b
    assert redact(text) == "".join(parts) + text[at:]


def test_view_keeps_the_way_back():
    v = normalised("ab (at) cd [dot] ef")
    assert v.text == "ab@cd.ef"
    assert v.source(0, 8) == (0, 19)
    assert View("xyz").source(1, 2) == (1, 2)


def test_tables(spark):
    data = [("1", "Ann", "mail a@b.example"), ("1", "Ann", "mail a@b.example"), ("2", None, None), ("3", "", "x" * 200_000 + " a@b.example"), (None, "bastien", "c@d.example")]
    df = spark.createDataFrame(data, "lead_id string, name string, message string").withColumn("kind", F.lit("clash")).withColumn("key", F.lit(0))
    got = rows(personal_data(df, "lead_id", ("name", "message"), names=NAMES).select("lead_id", "field", "kind", "start_pos"))
    assert got == sorted([("1", "message", "email", 5), ("3", "message", "email", 200_001), (None, "name", "person", 0), (None, "message", "email", 0)], key=str)
    assert [r["message"] for r in redacted(df, "lead_id", ("name", "message")).where("lead_id = '1'").collect()] == ["mail [EMAIL]"] * 2
    assert redacted(df, "lead_id", ("name", "message")).count() == 5
    assert personal_data(df.limit(0), "lead_id", ("name", "message")).count() == 0


# --- queries


def test_registered_queries_run(spark, small):
    from citewise.llm.queries import QUERIES

    for name, f in QUERIES.items():
        assert f(spark, small).count() > 0, name
