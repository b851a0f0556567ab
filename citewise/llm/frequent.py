"""The most frequent values of very large columns: exact buckets for heavy ones, a counter array for the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewise.session import cut

BUCKETS, CELLS, EVICT_RATIO = 4096, 1 << 16, 8
BUCKET_SHIFT = 24


class HeavyLight:
    """The sketch of one column of one partition.

    Each bucket holds one value with the rows counted for it (votes for) and the rows of other values that met it
    (votes against). A value that meets a foreign bucket votes against and is counted in the cell of its hash; when the
    votes against are EVICT_RATIO times those for, the bucket's count falls into its own value's cell and the newcomer
    takes the bucket, marked: part of its rows may be in its cell.
    """

    def __init__(self) -> None:
        self.key = np.zeros(BUCKETS, np.int64)
        self.votes = np.zeros(BUCKETS, np.int64)
        self.against = np.zeros(BUCKETS, np.int64)
        self.marked = np.zeros(BUCKETS, bool)
        self.item = np.full(BUCKETS, None, object)
        self.cells = np.zeros(CELLS, np.int64)

    def add(self, hashes: np.ndarray, items: pa.Array) -> None:
        """Take the rows of a batch: equal values together, the most frequent first, one per bucket at a time."""
        key, first, n = np.unique(hashes, return_index=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        key, first, n = key[order], first[order], n[order]
        at = (key >> BUCKET_SHIFT) & (BUCKETS - 1)
        while len(key):
            _, now = np.unique(at, return_index=True)
            b, k, c, f = at[now], key[now], n[now], first[now]
            held = self.votes[b] > 0
            same = held & (self.key[b] == k)
            self.votes[b[same]] += c[same]
            foreign = held & ~same
            self.against[b[foreign]] += c[foreign]
            out = foreign & (self.against[b] >= EVICT_RATIO * self.votes[b])
            np.add.at(self.cells, k[foreign & ~out] & (CELLS - 1), c[foreign & ~out])
            np.add.at(self.cells, self.key[b[out]] & (CELLS - 1), self.votes[b[out]])
            new = out | ~held
            self.key[b[new]], self.votes[b[new]] = k[new], c[new]
            self.against[b[new]], self.marked[b[new]] = 0, out[new]
            self.item[b[new]] = items.take(pa.array(f[new])).to_pylist() if new.any() else []
            rest = np.ones(len(key), bool)
            rest[now] = False
            key, first, n, at = key[rest], first[rest], n[rest], at[rest]


def sketch(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One HeavyLight per partition and field, as rows: field, bucket (null for a cell), cell, hash, item, n, marked.

    Null and empty values are left out. A partition gives at most BUCKETS + CELLS rows a field, whatever it reads.
    """
    cols = [F.when(F.col(f) != "", F.xxhash64(f)).alias(f"h{i}") for i, f in enumerate(fields)]
    schema = pa.schema([("field", pa.string()), ("bucket", pa.int32()), ("cell", pa.int32()), ("hash", pa.int64()), ("item", pa.string()), ("n", pa.int64()), ("marked", pa.bool_())])

    def run(batches):
        parts = [HeavyLight() for _ in fields]
        for batch in batches:
            for i, p in enumerate(parts):
                h = batch.column(i)
                keep = h.is_valid()
                if keep.true_count:
                    p.add(h.filter(keep).to_numpy(), batch.column(len(fields) + i).filter(keep))
        for f, p in zip(fields, parts, strict=True):
            b = np.flatnonzero(p.votes)
            c = np.flatnonzero(p.cells)
            none = pa.nulls
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(b), pa.string()), pa.array(b, pa.int32()), none(len(b), pa.int32()), pa.array(p.key[b]), pa.array(p.item[b].tolist(), pa.string()), pa.array(p.votes[b]), pa.array(p.marked[b])], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(c), pa.string()), none(len(c), pa.int32()), pa.array(c, pa.int32()), none(len(c), pa.int64()), none(len(c), pa.string()), pa.array(p.cells[c]), none(len(c), pa.bool_())], schema=schema)

    return df.select(*cols, *fields).mapInArrow(run, "field string, bucket int, cell int, hash long, item string, n long, marked boolean")


def merge(rows: DataFrame) -> DataFrame:
    """One sketch out of many, in the same form: field, bucket, cell, hash, item, n, marked.

    Votes of a value add up; of a bucket's values the one with most stays (ties: the smaller hash), the others fall
    into their cells; cells add up. A value that shared its bucket in any part, or was marked in one, stays marked.
    Buckets and cells of all parts are added up in one aggregation, at most BUCKETS + CELLS rows a part and field before
    it and not many more after, and written, so that the parts are sketched once. Merging is associative in its bounds: n is never more than the rows of the value, n plus its cell never less.
    """
    once = cut(rows.groupBy("field", "bucket", "cell", "hash").agg(F.sum("n").alias("n"), F.max("marked").alias("marked"), F.first("item").alias("item")))
    held = once.where("bucket is not null").select("field", "bucket", "hash", "n", "marked", "item")
    own = Window.partitionBy("field", "bucket")
    held = held.withColumn("place", F.row_number().over(own.orderBy(F.desc("n"), "hash"))).withColumn("sharing", F.count("*").over(own))
    kept = held.where("place = 1").select("field", "bucket", F.lit(None).cast("int").alias("cell"), "hash", "item", "n", (F.col("marked") | (F.col("sharing") > 1)).alias("marked"))
    fallen = held.where("place > 1").select("field", cell_of("hash").alias("cell"), "n")
    cells = once.where("cell is not null").select("field", "cell", "n").unionByName(fallen).groupBy("field", "cell").agg(F.sum("n").alias("n"))
    null = lambda t: F.lit(None).cast(t)
    return kept.unionByName(cells.select("field", null("int").alias("bucket"), "cell", null("long").alias("hash"), null("string").alias("item"), "n", null("boolean").alias("marked")))


def cell_of(column: str):
    return F.col(column).bitwiseAND(CELLS - 1).cast("int")


def estimates(merged: DataFrame) -> DataFrame:
    """field, item, hash, n_least, n_most of every value in a bucket: at most BUCKETS a field."""
    cells = merged.where("cell is not null").select("field", F.col("cell").alias("own_cell"), F.col("n").alias("in_cell"))
    held = merged.where("bucket is not null").withColumn("own_cell", cell_of("hash")).join(cells, ["field", "own_cell"], "left")
    return held.select("field", "item", "hash", F.col("n").alias("n_least"), (F.col("n") + F.when(F.col("marked"), F.coalesce("in_cell", F.lit(0))).otherwise(0)).alias("n_most"))


def _counted(df: DataFrame, fields: tuple[str, ...], wanted: dict[str, tuple[list[int], list[int]]], least: dict[str, float]) -> DataFrame:
    """field, item, n of the values of each field with a wanted hash or a hash of a wanted cell, if they reach least: one scan for all fields, counted before the shuffle."""
    spark = df.sparkSession
    marks = [(f, h, None) for f, (hashes, _) in wanted.items() for h in hashes] + [(f, None, c) for f, (_, cells) in wanted.items() for c in cells]
    known = spark.createDataFrame(marks, "field string, hash long, own_cell int")
    own = df.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("item")) for f in fields)))).where("item <> ''").withColumn("hash", F.xxhash64("item")).withColumn("own_cell", cell_of("hash"))
    by_hash, by_cell = known.where("hash is not null").select("field", "hash"), known.where("own_cell is not null").select("field", "own_cell", F.lit(True).alias("__cell"))
    hit = own.join(F.broadcast(by_cell), ["field", "own_cell"], "left").join(F.broadcast(by_hash.withColumn("__hash", F.lit(True))), ["field", "hash"], "left").where("__cell or __hash")
    counted = hit.groupBy("field", "item").agg(F.count("*").alias("n"))
    need = F.create_map(*(F.lit(x) for f, n in least.items() for x in (f, float(n))))[F.col("field")]
    return counted.where(F.col("n") >= need)


def frequent(df: DataFrame, fields: tuple[str, ...], k: int = 50) -> DataFrame:
    """field, place, item, n_least, n_most: exactly the k values of each field with most rows, in a second counted scan; n_least = n_most = rows.

    Ties go by item. Equal values written differently are different values. An empty table gives no rows.
    The k-th greatest n_least is reached by k values, so none below it is among the k. A value that reaches it either
    has it as n_most in a bucket or is in a cell that alone reaches it: the rows of these cells are counted, and only
    the numbers of the cells (CELLS a field at most) are collected and broadcast.
    """
    merged = merge(sketch(df, fields)).persist()
    held = estimates(merged)
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n_least"), "hash"))
    kth = held.select("field", "n_least", place.alias("place")).where(F.col("place") <= k).groupBy("field").agg(F.when(F.count("*") == k, F.min("n_least")).otherwise(1).alias("least"))
    least = {f: 1 for f in fields} | {r["field"]: r["least"] for r in kth.collect()}
    reach = F.lit(False)
    for f, n in least.items():
        reach = reach | ((F.col("field") == f) & (F.col("n") >= n))
    near = held.select("field", cell_of("hash").alias("cell"), F.col("n_most").alias("n")).where(reach)
    cells = near.unionByName(merged.where("cell is not null").select("field", "cell", "n").where(reach)).select("field", "cell").distinct().collect()
    merged.unpersist()
    counted = _counted(df, fields, {f: ([], [r["cell"] for r in cells if r["field"] == f]) for f in fields}, least)
    best = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "item"))
    return counted.withColumn("place", best).where(F.col("place") <= k).select("field", "place", "item", F.col("n").alias("n_least"), F.col("n").alias("n_most"))


def at_least(df: DataFrame, fields: tuple[str, ...], share: float, n_rows: int | None = None) -> DataFrame:
    """field, item, n: exactly the values, neither null nor empty, that at least share of all rows hold, with their rows.

    The sketch leaves values whose n_most reaches the threshold and, so that none is lost, cells that alone reach it
    (only then can a value in no bucket). Both are at most BUCKETS + 1/share a field and are collected; a second scan
    counts just the rows of those, combined before the shuffle.
    """
    n_rows = df.count() if n_rows is None else n_rows
    least = share * n_rows
    merged = merge(sketch(df, fields)).persist()
    hashes = estimates(merged).where(F.col("n_most") >= least).select("field", "hash").collect()
    cells = merged.where((F.col("cell").isNotNull()) & (F.col("n") >= least)).select("field", "cell").collect()
    merged.unpersist()
    wanted = {f: ([r["hash"] for r in hashes if r["field"] == f], [r["cell"] for r in cells if r["field"] == f]) for f in fields}
    return _counted(df, fields, wanted, dict.fromkeys(fields, least))
