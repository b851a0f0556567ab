import random

from pyspark.sql import functions as F

from citewise.operators import duplicates as D


def fnv(text):
    h = 0x811C9DC5
    units = text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
    return h


def test_hashes_by_hand():
    text = "The quick brown fox 🙋 jumps über 日本 lazy dogs"
    w = D.words(text)
    assert w == ["the", "quick", "brown", "fox", "jumps", "über", "日", "本", "lazy", "dogs"]
    want = sorted({fnv(" ".join(w[i : i + 5])) for i in range(len(w) - 4)})
    assert D.shingle_hashes(w).tolist() == want
    assert D.signature("only four words here") is None
    assert len(D.signature(text)) == 64


def brute(texts, least=0.8):
    sigs = {k: s for k, t in texts if t and (s := D.signature(t)) is not None}
    keys = sorted(sigs)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if D.similarity(sigs[a], sigs[b]) >= least:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}


def near(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_classes_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(-1, None), (-2, ""), (-3, "too short")]
    k = 0
    for g in range(12):
        base = [f"w{g}_{rng.randrange(400)}" for _ in range(120)]
        for _ in range(rng.choice([1, 2, 9, 40])):
            texts.append((k, near(rng, base, rng.choice([0, 0, 1, 2, 3, 6]))))
            k += 1
    df = spark.createDataFrame(texts, "id long, t string").repartition(4).withColumn("k", F.lit("clash")).withColumn("signature", F.lit(0))
    want = brute(texts)
    for bucket, block in ((64, 256), (3, 7)):  # with small ones the larger groups are compared block by block
        monkeypatch.setattr(D, "BUCKET", bucket)
        monkeypatch.setattr(D, "BLOCK", block)
        assert {r["id"]: r["class"] for r in D.near_duplicates(df, "id", "t").collect()} == want
    assert D.near_duplicates(df.limit(0), "id", "t").count() == 0


def test_chains_become_one_class(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["class"] for r in D.classes(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}
