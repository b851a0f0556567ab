"""Windowed counts over streams, error fingerprints, and tables restated by late data."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.session import shared_folder


def read_table(spark: SparkSession, sf_dir: str, name: str, files_a_batch: int = 256) -> DataFrame:
    """A stream of the files of a Parquet table, at most files_a_batch at a time; times without zone become UTC times, which watermarks need."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    one_file = any(f.rstrip("/").endswith(f"/{name}.parquet") for f in table.inputFiles())
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_a_batch)
    rows = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if one_file else reader.parquet(path)
    return rows.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in rows.dtypes))


def window_counts(events: DataFrame, at: str, by: list[str], value: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """start, by, n, total per window of time; in a stream, rows later than late are dropped and state is bounded by it."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), *by, "n", "total")


def session_counts(events: DataFrame, at: str, by: list[str], gap: str, late: str) -> DataFrame:
    """first, by, n per session: events of by with less than gap between them."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap).alias("s"), *by).agg(F.count("*").alias("n")).select(F.col("s.start").cast("timestamp_ntz").alias("first"), *by, "n")


def fingerprints(errors: DataFrame, parts: list[str], at: str) -> DataFrame:
    """fingerprint, n, first_seen, last_seen of errors alike in parts, with numbers and ids in them masked."""
    masked = [F.regexp_replace(F.coalesce(F.col(p), F.lit("")), r"[0-9a-f]{8}-[0-9a-f-]{27}|\d+", "#") for p in parts]
    key = F.substring(F.sha2(F.concat_ws("|", *masked), 256), 1, 32)
    return errors.groupBy(key.alias("fingerprint")).agg(F.count("*").alias("n"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_whole(stream: DataFrame) -> DataFrame:
    """What a stream of aggregates comes to for what is there now: each batch writes the whole result to the shared folder, the last one counts."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{uuid4().hex}"
    written: list[str] = []

    def put(batch: DataFrame, number: int) -> None:
        path = f"{base}/out-{number}"
        batch.write.mode("overwrite").parquet(path)
        written.append(path)

    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(written[-1]) if written else spark.createDataFrame([], stream.schema)


def upsert_fingerprints(old: DataFrame, new: DataFrame) -> DataFrame:
    """fingerprint, n, first_seen, last_seen, resolved_at: the counts of new (as fingerprints gives) added to old's; what comes again is no longer resolved."""
    j = old.alias("o").join(new.alias("n"), "fingerprint", "full")
    return j.select(
        "fingerprint", (F.coalesce("o.n", F.lit(0)) + F.coalesce("n.n", F.lit(0))).alias("n"), F.least("o.first_seen", "n.first_seen").alias("first_seen"),
        F.greatest("o.last_seen", "n.last_seen").alias("last_seen"), F.when(F.col("n.n").isNull(), F.col("o.resolved_at")).alias("resolved_at"),
    )


def stale(df: DataFrame, status: Column, started_at: Column, created_at: Column, now: Column, minutes: int = 6) -> DataFrame:
    """Rows still running (status) that started, or without a start were created, more than minutes before now."""
    return df.where(status & (F.coalesce(started_at, created_at) < now - F.make_interval(mins=F.lit(minutes))))


def restate(old: DataFrame, new: DataFrame, keys: list[str], newest: Column) -> DataFrame:
    """old with the rows of new in place of those of equal keys, and the others added; of new's rows of a key the newest counts.

    newest orders rows (columns of new). Both have the same columns. What foreachBatch does with each batch of late rows.
    """
    rest = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("r")).select(*keys, "r.*")
    kept = old.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last)


def retained(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows not older than days; a row without a time stays."""
    return df.where(F.col(at).isNull() | (F.col(at) >= now - F.make_interval(days=F.lit(days))))
