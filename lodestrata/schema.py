"""Row types and fixed values of the store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = """id string, fingerprint string, type string, summary string, resolution string, evidence_json string, context_json string,
tags array<string>, status string, memory_kind string, source_refs array<string>, session_id string, workspace_id string, repo_id string,
created_at string, updated_at string"""
VECTORS = "source_id string, source_kind string, dimensions int, embedding array<float>, metadata_json string, updated_at string"

#: The domains of a unit.
TYPES = ("session", "decision", "lesson", "issue", "workflow", "fact", "concept", "person", "project", "tool")
STATUSES = ("draft", "active", "contested", "superseded", "deprecated", "rejected")
KINDS = ("candidate", "memory", "raw")
CONFIDENCE = ("low", "medium", "high")


def searchable() -> Column:
    """Active memory that has evidence."""
    return (F.col("status") == "active") & (F.col("memory_kind") == "memory") & (F.col("evidence_json") != "[]")
