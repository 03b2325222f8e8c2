"""Keyed merge into immutable tables, coercion and validation of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.schema import KINDS, STATUSES, TYPES


def last_of_each(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key in input order ``seq``."""
    order = Window.partitionBy(key).orderBy(F.desc(seq))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def merge_plan(current: DataFrame, staged: DataFrame, key: str = "id", seq: str = "seq", keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """The staged rows to write, the last of each key, with ``created`` and the columns in ``keep`` taken from the current row.

    ``writes`` is how often a key was staged, as an input of single upserts would count it.
    """
    often = staged.groupBy(key).agg(F.count("*").alias("writes"))
    rows = last_of_each(staged, key, seq).join(often, key)
    old = current.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in keep], F.lit(True).alias("__known"))
    rows = rows.join(old, key, "left").withColumn("created", F.col("__known").isNull())
    for c in keep:
        rows = rows.withColumn(c, F.coalesce(f"__{c}", c))
    return rows.drop("__known", *[f"__{c}" for c in keep])


def merged(current: DataFrame, plan: DataFrame, key: str = "id") -> DataFrame:
    """The table after a plan: untouched rows and planned ones."""
    return current.join(plan.select(key), key, "left_anti").unionByName(plan.select(*current.columns))


def report(plan: DataFrame) -> DataFrame:
    """``created, updated`` as single upserts in input order would count them."""
    return plan.agg(F.coalesce(F.sum(F.col("created").cast("long")), F.lit(0)).alias("created"), F.coalesce(F.sum(F.col("writes") - F.col("created").cast("long")), F.lit(0)).alias("updated"))


class StoreError(Exception):
    """A store that can't be read or written as asked."""


def or_default(column: Column, default: str) -> Column:
    """A falsy value becomes the default, then white space goes: a blank one ends up empty."""
    return text.stripped(F.when(column.isNull() | (column == ""), F.lit(default)).otherwise(column))


def coerced(rows: DataFrame, as_of: str) -> DataFrame:
    """Units as they are stored: defaults, stripped strings, fingerprint, an id from it where none is given.

    ``rows`` has the columns of a unit but the fingerprint. ``as_of`` stands for absent times.
    """
    clean = lambda c: text.stripped(F.coalesce(F.col(c), F.lit("")))
    out = rows.select(
        clean("id").alias("id"), or_default(F.col("type"), "lesson").alias("type"), clean("summary").alias("summary"), clean("resolution").alias("resolution"),
        F.coalesce("evidence_json", F.lit("[]")).alias("evidence_json"), F.coalesce("context_json", F.lit("{}")).alias("context_json"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        or_default(F.col("status"), "draft").alias("status"), or_default(F.col("memory_kind"), "candidate").alias("memory_kind"), F.coalesce("source_refs", F.array().cast("array<string>")).alias("source_refs"),
        clean("session_id").alias("session_id"), clean("workspace_id").alias("workspace_id"), clean("repo_id").alias("repo_id"),
        or_default(F.col("created_at"), as_of).alias("created_at"), or_default(F.col("updated_at"), as_of).alias("updated_at"), *[c for c in ("seq",) if c in rows.columns],
    )
    named = {c: F.col(c) for c in ("type", "summary", "resolution", "session_id", "workspace_id", "repo_id")}
    print_ = F.when(F.col("id") == "", text.fingerprint(named)).otherwise(text.fingerprint(named | {"id": F.col("id")}))
    out = out.withColumn("fingerprint", print_)
    return out.withColumn("id", F.when(F.col("id") == "", F.concat(F.lit("memory:"), F.left("fingerprint", F.lit(24)))).otherwise(F.col("id")))


def faults() -> Column:
    """What is wrong with a coerced unit; empty: nothing."""
    rules = {"type": F.col("type").isin(*TYPES), "status": F.col("status").isin(*STATUSES), "memory_kind": F.col("memory_kind").isin(*KINDS), "summary": F.col("summary") != ""}
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def records(units: DataFrame) -> DataFrame:
    """Stored units as they are returned: ``evidence`` and ``context`` decoded with all that is in them (VARIANT); what isn't a JSON list or object is an empty one."""

    def decoded(column: str, first: str, empty: str) -> Column:
        fits = F.left(F.ltrim(column), F.lit(1)) == first
        return F.coalesce(F.when(fits, F.try_parse_json(column)), F.parse_json(F.lit(empty)))

    return units.withColumns({"evidence": decoded("evidence_json", "[", "[]"), "context": decoded("context_json", "{", "{}")}).drop("evidence_json", "context_json")


def events(plan: DataFrame, as_of: str, key: str = "id") -> DataFrame:
    """The audit log's rows of a plan: one for each single upsert that it stands for, the first of a new key being its creation."""
    each = plan.select(F.col(key).alias("memory_id"), "created", F.explode(F.sequence(F.lit(1).cast("long"), F.col("writes"))).alias("n"))
    return each.select((F.col("created") & (F.col("n") == 1)).alias("created"), "memory_id", F.lit(as_of).alias("timestamp"), F.lit("upsert").alias("type"))


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coerced units that may be stored, and the others with their ``faults``."""
    rows = rows.withColumn("faults", faults())
    return rows.where(F.size("faults") == 0).drop("faults"), rows.where(F.size("faults") > 0)
