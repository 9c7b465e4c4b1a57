"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without one gets its own."""
    at = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="taproot-")
    spark.conf.set(_KEY, at)
    return at


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    A lost executor then costs no earlier stage again.
    """
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``df`` has (letter case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
