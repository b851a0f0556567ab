"""References to records that do not exist, were deleted or came later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_LENGTH = 11
#: The HOT keys with most records, among them every key with over a HOT-th of all, are spread over SALTS tasks each.
HOT, SALTS = 200, 32


def reference(value: Column, length: int = KEY_LENGTH) -> Column:
    """The key that value names: its ASCII letters and digits in lower case if exactly length of them, else null."""
    bare = F.lower(F.regexp_replace(value, "[^A-Za-z0-9]+", ""))
    return F.when(F.length(bare) == length, bare)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class References:
    """References of child tables to parent tables, in the steps by which orphans are found.

    children: name of a child table to (rows, id column, reference column, name of the parent table).
    parents: name of a parent table to (rows, id column, deletion log or None, its id column).

    records: one row per child table, record id, parent table and key, with the earliest times; copies of a record count
    once, and a record whose copies name different keys once per key. Null ids and values that are no reference refer
    to nothing. Records without a time are never late, nor any of a parent all of whose rows lack one.
    keys: tagged parent, deletion and child keys are unioned in long form and grouped by parent table and key: flags, the
    parent's earliest time, the earliest and latest record, and the number of records by child table and period (tables
    times periods at most; left out, and period null, without created_at). Rows of one key combine before the shuffle, whatever share of all rows it has.
    orphan_keys: the groups that lack the parent's flag or have a record from before the parent came.
    """

    def __init__(self, children: dict[str, tuple[DataFrame, str, str, str]], parents: dict[str, tuple[DataFrame, str, DataFrame | None, str]], *, loaded_at: str = "loaded_at", created_at: str | None = "created_at"):
        self.by_period = created_at is not None
        period = [F.trunc(F.col(created_at), "month").alias("period")] if self.by_period else []
        said = [
            df.select(F.lit(name).alias("src_table"), F.lit(parent).alias("parent_table"), F.col(rid).cast("string").alias("record_id"), reference(F.col(ref)).alias("key"), F.col(loaded_at).alias("loaded"), *period).where("key is not null and record_id is not null")
            for name, (df, rid, ref, parent) in children.items()
        ]
        self.records = _union(said).groupBy("src_table", "parent_table", "record_id", "key").agg(F.min("loaded").alias("loaded"), *([F.min("period").alias("period")] if self.by_period else []))
        if not self.by_period:
            self.records = self.records.withColumn("period", F.lit(None).cast("date"))
        null = lambda t: F.lit(None).cast(t)
        none = [null("timestamp_ntz").alias("first"), null("timestamp_ntz").alias("last"), null("string").alias("src_table"), null("date").alias("period"), F.lit(0).cast("long").alias("n")]
        long = [self.records.groupBy("parent_table", "key", "src_table", "period").agg(F.lit("child").alias("tag"), null("timestamp_ntz").alias("at"), F.min("loaded").alias("first"), F.max("loaded").alias("last"), F.count("*").alias("n"))]
        for name, (df, pid, log, deleted) in parents.items():
            long.append(df.where(F.col(pid).isNotNull()).select(F.lit(name).alias("parent_table"), F.col(pid).alias("key"), F.lit("parent").alias("tag"), F.col(loaded_at).alias("at"), *none))
            if log is not None:
                long.append(log.where(F.col(deleted).isNotNull()).select(F.lit(name).alias("parent_table"), F.col(deleted).alias("key"), F.lit("deleted").alias("tag"), null("timestamp_ntz").alias("at"), *none))
        uses = F.collect_list(F.when(F.col("tag") == "child", F.struct("src_table", "period", "n")))
        self.keys = _union(long).groupBy("parent_table", "key").agg(
            F.max(F.col("tag") == "parent").alias("has_parent"), F.max(F.col("tag") == "deleted").alias("has_deletion"), F.min("at").alias("parent_at"),
            F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), *([uses.alias("uses")] if self.by_period else []),
        )
        state = F.when(F.col("has_parent"), F.when(F.col("parent_at") > F.col("first"), "late")).when(F.col("has_deletion"), "deleted").otherwise("missing")
        self.orphan_keys = self.keys.where("n > 0").withColumn("state", state).where("state is not null")

    def orphans(self, late_only: bool = False) -> DataFrame:
        """src_table, parent_table, record_id, key, period, state of each record of an orphan key; of a key whose parent came, only records before it.

        Records meet orphan keys alone. The HOT keys with most records, a fixed number, are broadcast and salted, so no
        key is gathered in one task. Ties among them go by all columns, which also keeps both uses of the groups alike,
        so that they, and the records, are computed once.
        """
        keys = self.orphan_keys.where("state = 'late'") if late_only else self.orphan_keys
        by = ["parent_table", "key"]
        hot = self.keys.orderBy(F.desc("n"), *by, "has_parent", "has_deletion", "parent_at", "first", "last", *([F.size("uses")] if self.by_period else [])).limit(HOT).select(*by, F.lit(True).alias("__hot"))
        salted = self.records.join(F.broadcast(hot), by, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.hash("record_id"), F.lit(SALTS))).otherwise(0))
        copies = keys.select(*by, "parent_at", "state").join(F.broadcast(hot), by, "left")
        copies = copies.select(*by, "parent_at", "state", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("__salt"))
        met = salted.join(copies, [*by, "__salt"])
        return met.where((F.col("state") != "late") | (F.col("loaded") < F.col("parent_at"))).select("src_table", "parent_table", "record_id", "key", "period", "state")

    def counts(self) -> DataFrame:
        """src_table, period, state, n, n_keys: records and distinct keys, summed over the groups of orphan keys.

        The groups' own counts are summed; only groups whose parent came after some but not all of their records are
        counted by record.
        """
        whole = self.orphan_keys.where("state <> 'late' or last < parent_at").select("key", "state", F.inline("uses"))
        mixed = self.orphans(late_only=True).groupBy("key", "state", "src_table", "period").agg(F.count("*").alias("n"))
        part = self.orphan_keys.where("state = 'late' and not coalesce(last < parent_at, false)").select("key")
        mixed = mixed.join(part.distinct(), "key", "left_semi")
        return whole.unionByName(mixed).groupBy("src_table", "period", "state").agg(F.sum("n").alias("n"), F.count_distinct("key").alias("n_keys"))
