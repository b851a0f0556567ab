"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "citewise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time zone and adaptive execution; conf overrides."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where the session names none (tests, a laptop) one is made and set; on a cluster without the setting
    this fails rather than write to a folder of one machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("CITEWISE_SHARED_DIR")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="citewise-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends there and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
