"""Near copies of texts: minhash signatures, a join of signatures that loses no pair, and classes of linked texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewise.session import cut

# Words a shingle, slots of a signature, the steps of the generator of their seeds, and of the two hashes.
SHINGLE, SLOTS = 5, 64
SEED_START, SEED_FACTOR, SEED_STEP = 0x9E3779B9, 1664525, 1013904223
FNV_START, FNV_FACTOR = 0x811C9DC5, 0x01000193
MIX_1, MIX_2 = 0x85EBCA6B, 0xC2B2AE35
#: Rows of one part of a signature that are joined; more of them are compared in blocks of so many.
BUCKET, BLOCK = 64, 256
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]|[\p{L}\p{N}--[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]]+", regex.V1)


def seeds() -> np.ndarray:
    out, x = [], SEED_START
    for _ in range(SLOTS):
        x = (x * SEED_FACTOR + SEED_STEP) % 2**32
        out.append(x)
    return np.array(out, np.uint32)


_SEEDS = seeds()


def words(text: str) -> list[str]:
    """Lower-case runs of letters and digits; each ideograph is a word."""
    return _WORD.findall(text.lower())


def shingle_hashes(tokens: list[str]) -> np.ndarray:
    """The distinct 32-bit FNV-1a hashes, over UTF-16 units, of all runs of SHINGLE words joined by spaces, computed for all runs at once."""
    n = len(tokens) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    units = np.frombuffer((" ".join(tokens)).encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint32)
    sizes = np.fromiter((len(t) + sum(c > "￿" for c in t) if not t.isascii() else len(t) for t in tokens), np.int64, len(tokens))
    first = np.r_[0, np.cumsum(sizes + 1)]
    start, end = first[:n], first[SHINGLE : SHINGLE + n] - 1
    h = np.full(n, FNV_START, np.uint32)
    at = start.copy()
    live = np.arange(n)
    while len(live):
        h[live] = (h[live] ^ units[at[live]]) * np.uint32(FNV_FACTOR)
        at[live] += 1
        live = live[at[live] < end[live]]
    return np.unique(h)


def signature(text: str) -> np.ndarray | None:
    """For each seed the least mixed hash of the text's shingles; None for a text of fewer than SHINGLE words."""
    h = shingle_hashes(words(text))
    if not len(h):
        return None
    out = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096, None] ^ _SEEDS[None, :]
        x = (x ^ (x >> np.uint32(16))) * np.uint32(MIX_1)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(MIX_2)
        out = np.minimum(out, (x ^ (x >> np.uint32(16))).min(axis=0))
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal slots, which estimates the share of common shingles."""
    return float((a == b).mean())


def signatures(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, signature (64 numbers) of each text of five words and more. One narrow pass over whole texts."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(t) if t else None for t in batch.column(1).to_pylist()]
            keep = [i for i, s in enumerate(found) if s is not None]
            flat = np.concatenate([found[i] for i in keep]).astype(np.int64) if keep else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SLOTS), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), lists], names=[key, "signature"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, signature array<bigint>")


def similar_signatures(sigs: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """a < b: pairs of rows whose signatures (each there once) agree in at least least of the slots, enough to link all that are linked.

    Signatures that differ in at most d slots agree wholly in one of d + 1 disjoint parts, so each row meets its like
    under d + 1 keys and no link is lost. Up to BUCKET rows of a key are joined. More are compared block by block: every
    two blocks of BLOCK rows meet in a task of their own, which gives each row's least like instead of all pairs; so a
    group of any size is spread over tasks of one size, and the work follows the square of the different signatures
    that share a part.
    """
    need = math.ceil(least * SLOTS - 1e-9)
    n_parts = SLOTS - need + 1
    kind = dict(sigs.dtypes)[key]
    part = lambda i: F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.pmod(s, F.lit(n_parts)) == i)
    mark = lambda i: F.md5(F.concat_ws("|", i.cast("string"), F.array_join(F.transform(part(i), lambda s: F.get("signature", s)), ",")))
    rows = sigs.select(F.col(key).alias("k"), "signature", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_parts - 1)), mark)).alias("path"))
    sizes = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(sizes, "path")
    small = met.where(F.col("n") <= BUCKET)
    other = small.select("path", F.col("k").alias("b"), F.col("signature").alias("other"))
    equal = F.size(F.filter(F.zip_with("signature", "other", lambda x, y: x == y), lambda e: e))
    pairs = small.join(other, "path").where((F.col("k") < F.col("b")) & (equal >= need)).select(F.col("k").alias("a"), "b")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    large = met.where(F.col("n") > BUCKET).withColumn("own", F.pmod(F.xxhash64("k"), blocks).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), blocks - 1)))
    large = large.select("path", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "k", "signature")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        k, sig = pdf["k"].to_numpy(), np.stack(pdf["signature"].to_numpy())
        order = np.argsort(k, kind="stable")
        k, sig = k[order], sig[order]
        root = np.arange(len(k))
        for at in range(1, len(k)):
            like = np.flatnonzero((sig[:at] == sig[at]).sum(axis=1) >= need)
            if len(like):
                joined = np.unique(np.r_[root[like], at])
                root[np.isin(root, joined)] = joined[0]
        out = [(k[r], k[i]) for i, r in enumerate(root.tolist()) if r != i]
        return pd.DataFrame(out, columns=["a", "b"])

    found = large.groupBy("path", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}")
    return pairs.unionByName(found).distinct()


def classes(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, class: the least node that each node of the edges (a, b) is linked to, in any number of steps.

    In each round a node's least neighbour goes to its greater ones and to itself, and then to itself alone, until
    nothing changes; each round's edges are written and read again. Steps grow with the logarithm of the longest chain.
    """
    both = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct()
    before = None
    for _ in range(rounds):
        out = both.unionByName(both.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = out.groupBy("v").agg(F.min("u").alias("m"))
        star = out.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.least("m", "v").alias("u")).unionByName(least.where("m < v").select("v", F.col("m").alias("u"))).where("u <> v").distinct()
        low = star.groupBy("v").agg(F.min("u").alias("m"))
        both = cut(star.join(low, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u")).where("u <> v").distinct())
        now = both.agg(F.count("*"), F.sum(F.hash("v", "u").cast("long"))).first()
        if now == before:
            break
        before = now
    return both.select(F.col("v").alias("node"), F.col("u").alias("class")).unionByName(both.select(F.col("u").alias("node"), F.col("u").alias("class"))).groupBy("node").agg(F.min("class").alias("class"))


def near_duplicates(df: DataFrame, key: str, text: str, least: float = 0.8) -> DataFrame:
    """key, class of every row with a text of five words and more: the least key of all rows it is linked to.

    Texts whose signatures agree in least of their slots are linked. Texts of one signature are one class at once,
    whatever their number, and are not paired; of each such group its least key is compared with the others. Null and
    shorter texts have no row; a repeated key comes out once for each row.
    """
    sigs = cut(signatures(df, key, text).select(F.col(key).alias("k"), "signature", F.md5(F.array_join("signature", ",")).alias("mark")))
    heads = sigs.groupBy("mark").agg(F.min("k").alias("k"))
    unique = sigs.join(heads, ["mark", "k"], "left_semi").dropDuplicates(["mark"])
    linked = classes(cut(similar_signatures(unique, "k", least))).withColumnRenamed("node", "k")
    of = heads.join(linked, "k", "left").select("mark", F.coalesce("class", "k").alias("class"))
    return sigs.select(F.col("k").alias(key), "mark").join(of, "mark").select(key, "class")
