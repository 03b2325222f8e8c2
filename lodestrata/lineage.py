"""Durable cuts of lineage in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: How tables and index segments are compressed: some two thirds of the bytes of Spark's own choice.
COMPRESSION = "zstd"


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the session's ``spark.checkpoint.dir``; where that is unset, a temporary one if the session runs in one process, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestrata-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; lost executors do not lose the rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as compressed Parquet and read again: for rows with whole texts, of which a checkpoint has every byte."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", COMPRESSION).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
