"""Readers with checked headers, and SQL files of named queries."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str, exact: bool = True, strict: bool = False) -> DataFrame:
    """A CSV file by its header: the columns of schema, in this order if exact, else among others; empty cells are null.

    A header that doesn't fit raises ValueError naming what is missing; a cell that can't be cast is null, or, if strict,
    raises ValueError after one pass that counts such cells by column.
    """
    want = T.StructType.fromDDL(schema)
    head = spark.read.option("header", True).csv(path).columns
    missing = sorted(set(want.names) - set(head))
    if missing or (exact and head != want.names):
        raise ValueError(f"{path}: " + (f"missing columns {', '.join(missing)}" if missing else "columns differ from the schema"))
    raw = spark.read.option("header", True).option("emptyValue", "").schema(", ".join(f"`{c}` string" for c in head)).csv(path)
    cell = lambda f: F.when(F.col(f.name) != "", F.col(f.name))
    if strict:
        bad = raw.agg(*(F.count_if(cell(f).isNotNull() & cell(f).try_cast(f.dataType).isNull()).alias(f.name) for f in want)).first().asDict()
        if any(bad.values()):
            raise ValueError(f"{path}: " + ", ".join(f"{n} cells of {c} don't fit" for c, n in bad.items() if n))
    return raw.select(*(cell(f).try_cast(f.dataType).alias(f.name) for f in want))


def dimensions_of(spark: SparkSession, path: str, required: tuple[str, ...]) -> list[str]:
    """The columns of a CSV file's header beyond the required ones, in order; ValueError if one of these is missing or no other is there."""
    head = spark.read.option("header", True).csv(path).columns
    missing = sorted(set(required) - set(head))
    if missing or set(head) == set(required):
        raise ValueError(f"{path}: " + (f"missing columns {', '.join(missing)}" if missing else "no further columns"))
    return sorted(set(head) - set(required))


def read_json_array(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The objects of a JSON array file; of those with equal keys the last one counts. An array is one text, so a file is read in one task."""
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.from_json("value", f"array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in T.StructType.fromDDL(schema))}>>")).alias("at", "r"))
    rest = [f.name for f in T.StructType.fromDDL(schema) if f.name not in keys]
    last = rows.select("at", "r.*").groupBy(*keys).agg(F.max_by(F.struct(*rest), "at").alias("x"))
    return last.select(*keys, "x.*").select(*T.StructType.fromDDL(schema).names)


def unfinished(wanted: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """The rows of wanted that no readable line of results (as read_json_lines gives) is about: what a run that was broken off still has to do."""
    return wanted.join(results.where("ok").select(key).distinct(), key, "left_anti")


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """df as one CSV file with a header in a folder, in order. For reports: the rows pass one task."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def report_text(report: dict, indent: int | None = 2, sort: bool = False) -> str:
    """A report as the JSON text that it is published as: indented with a line break at its end, or without spaces, its keys in order if sort."""
    return json.dumps(report, indent=indent, sort_keys=sort, separators=(",", ": ") if indent else (",", ":")) + "\n"


def write_report(spark: SparkSession, report: dict, path: str, indent: int | None = 2, sort: bool = False) -> None:
    """report_text as the one text file of a folder."""
    spark.createDataFrame([(report_text(report, indent, sort).removesuffix("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """line, ok and the columns of schema of each line; a blank or damaged line has ok false and nulls."""
    rows = spark.read.text(path).withColumnRenamed("value", "line")
    got = rows.withColumn("r", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    ok = (F.trim("line") != "") & F.col("r").isNotNull() & F.col("r._bad").isNull()
    return got.select("line", ok.alias("ok"), *(F.when(ok, F.col(f"r.`{n}`")).alias(n) for n in T.StructType.fromDDL(schema).names))


def named_queries(text: str) -> dict[str, str]:
    """The statements of a SQL file by the names in its lines '-- name: x'."""
    parts = re.split(r"(?m)^--\s*name:\s*(\S+)\s*$", text)
    return {n: q.strip().rstrip(";") for n, q in zip(parts[1::2], parts[2::2], strict=True)}


def run_named(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """query and the columns of all named queries, which have the same columns, over tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    out = None
    for name, sql in named_queries(text).items():
        part = spark.sql(sql).select(F.lit(name).alias("query"), "*")
        out = part if out is None else out.unionByName(part)
    return out
