"""Counts and distributions of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.schema import searchable

#: Columns that a legacy table must have.
LEGACY_UNITS = (
    "id type summary resolution evidence_json context_json tags_json status memory_kind source_refs_json session_id workspace_id repo_id "
    "created_at updated_at fingerprint storage_targets_json loading_policy last_accessed_at"
).split()
LEGACY_SESSIONS = "session_id workspace_id repo_id context_json evidence_refs_json source_refs_json created_at updated_at".split()


def store_stats(units: DataFrame) -> DataFrame:
    """All six counts of a store in one pass."""
    memory = (F.col("status") == "active") & (F.col("memory_kind") == "memory")
    imported = F.col("context_json").ilike('%"imported_from": "continuity"%')
    return units.agg(F.count("*").alias("total"), F.count_if(memory).alias("active"), F.count_if(searchable()).alias("searchable"), F.count_if(F.col("memory_kind") == "candidate").alias("candidate"), F.count_if(F.col("memory_kind") == "raw").alias("raw"), F.count_if(imported).alias("continuity"))


def distribution(rows: DataFrame, column: str, blank: bool = True) -> DataFrame:
    """``value, n``; null and empty values, and with ``blank`` those of white space, count as (empty)."""
    value = F.coalesce(F.col(column), F.lit(""))
    none = (F.regexp_replace(value, r"(?U)\s+", "") if blank else value) == ""
    return rows.groupBy(F.when(none, F.lit("(empty)")).otherwise(value).alias("value")).agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, lists: list[str], strings: list[str]) -> DataFrame:
    """For each JSON list how many rows have entries, for each string how many are not blank."""
    return rows.agg(*[F.count_if(F.coalesce(F.json_array_length(c), F.lit(0)) > 0).alias(c) for c in lists], *[F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) != "").alias(c) for c in strings])


def missing_columns(rows: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(rows.columns))


def file_digests(spark, path: str) -> DataFrame:  # noqa: ANN001
    """``path, sha256`` of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
