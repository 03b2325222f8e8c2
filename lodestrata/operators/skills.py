"""The skill catalogue: eligible workflow units in a bounded projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import shortened, shortened_list

#: Bounds of what is shown.
BOUNDS = {"name": 120, "version": 40, "description": 2000, "applicability": 2000, "instructions": 8000, "validation": 4000, "safety": 4000}
LISTS = {"prerequisites": (20, 200), "required_tools": (20, 120), "scope": (10, 80), "source_refs": (10, 200)}
EVIDENCE = (10, 40, 200)
CANDIDATES, MOST, VERSION = 500, 50, "1.0.0"


def capability(name: str) -> Column:
    """A string of the unit's ``context.capability``; null if absent."""
    return F.get_json_object("context_json", f"$.capability.{name}")


def eligible() -> Column:
    """An active workflow memory that says it is a skill and has evidence or sources."""
    sourced = (F.coalesce(F.json_array_length("evidence_json"), F.lit(0)) > 0) | (F.coalesce(F.size("source_refs"), F.lit(0)) > 0)
    return (F.col("type") == "workflow") & (F.col("status") == "active") & (F.col("memory_kind") == "memory") & (F.coalesce(capability("kind"), F.lit("")) == "skill") & sourced


def manifest(units: DataFrame) -> DataFrame:
    """Fourteen fields, each bounded."""
    filled = lambda name, other: F.coalesce(F.nullif(capability(name), F.lit("")), other)
    text = lambda name: shortened(capability(name), BOUNDS[name])
    items = lambda name: shortened_list(F.from_json(capability(name), "array<string>"), *LISTS[name])
    evidence = F.slice(F.filter(F.from_json("evidence_json", "array<struct<kind:string,id:string>>"), lambda e: e.isNotNull()), 1, EVIDENCE[0])
    return units.select(
        "id", shortened(filled("name", F.col("summary")), BOUNDS["name"]).alias("name"), shortened(filled("description", F.col("resolution")), BOUNDS["description"]).alias("description"),
        shortened(filled("version", F.lit(VERSION)), BOUNDS["version"]).alias("version"), items("scope").alias("scope"), text("applicability").alias("applicability"), items("prerequisites").alias("prerequisites"),
        items("required_tools").alias("required_tools"), text("instructions").alias("instructions"), text("validation").alias("validation"), text("safety").alias("safety"),
        F.transform(F.coalesce(evidence, F.array().cast("array<struct<kind:string,id:string>>")), lambda e: F.struct(shortened(e["kind"], EVIDENCE[1]).alias("kind"), shortened(e["id"], EVIDENCE[2]).alias("id"))).alias("evidence"),
        shortened_list(F.col("source_refs"), *LISTS["source_refs"]).alias("source_refs"), "updated_at",
    )


def list_skills(units: DataFrame, query: str = "", limit: int = 20) -> DataFrame:
    """Manifests, newest first, among the newest CANDIDATES active workflow memories; a query is looked for in what is shown."""
    newest = units.where((F.col("type") == "workflow") & (F.col("status") == "active") & (F.col("memory_kind") == "memory")).orderBy(F.desc("updated_at"), "id").limit(CANDIDATES)
    rows = manifest(newest.where(eligible()))
    needle = query.strip().lower()
    if needle:
        rows = rows.where(F.contains(F.lower("name"), F.lit(needle)) | F.contains(F.lower("description"), F.lit(needle)))
    return rows.orderBy(F.desc("updated_at"), "id").limit(max(1, min(int(limit), MOST)))


def get_skill(units: DataFrame, skill_id: str) -> DataFrame:
    return manifest(units.where((F.col("id") == skill_id) & eligible()).limit(1))
