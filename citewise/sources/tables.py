"""Reading the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table name in sf_dir; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, name: str, split: str | None = None, parts: int = 64, fetch: int = 10_000, quote: str = '"', **options: str) -> DataFrame:
    """A table or view of a database, its columns pruned and filters pushed down by the source.

    split: a numeric, date or timestamp column by which it is read in parts, between the least and the greatest value,
    which one small query asks for with the name in quotes; an empty table, or one without split, is read in one part.
    """
    read = lambda **more: spark.read.format("jdbc").options(url=url, fetchsize=str(fetch), **options, **more).load()
    if split is None:
        return read(dbtable=name)
    least, most = read(query=f"SELECT MIN({quote}{split}{quote}) AS a, MAX({quote}{split}{quote}) AS b FROM {name}").first()
    if least is None:
        return read(dbtable=name)
    return read(dbtable=name, partitionColumn=split, lowerBound=str(least), upperBound=str(most), numPartitions=str(parts))


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", writers: int = 16, batch: int = 10_000, **options: str) -> None:
    """The rows of df into a table of a database, by at most writers connections; a task tried again may add its rows again, so give the table a key."""
    df.coalesce(writers).write.format("jdbc").options(url=url, dbtable=name, batchsize=str(batch), **options).mode(mode).save()
