"""The guard around a legacy SQLite file: profile without content, read-only snapshot, import of the snapshot, proof that the source stayed as it was."""

from __future__ import annotations

import hashlib
import os
import sqlite3
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodestrata.operators import profile
from lodestrata.sources.sqlite import opened, read_table

SNAPSHOT = "legacy-source.sqlite3"


class GuardError(Exception):
    """A precondition or a check of the guard failed."""


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def checked(path: str | Path) -> Path:
    """The real path of a regular file that isn't reached through a symbolic link."""
    path = Path(path)
    if path.is_symlink() or not path.is_file():
        raise GuardError(f"not a regular file: {path}")
    return path.resolve()


def tables(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame]:
    """The two legacy tables, once they have all columns that an import needs and the file passes its integrity check."""
    path = checked(path)
    with opened(str(path)) as db:
        try:
            if (said := [r[0] for r in db.execute("pragma integrity_check")]) != ["ok"]:
                raise GuardError("integrity check failed: " + "; ".join(said))
            there = {r[0] for r in db.execute("select name from sqlite_master where type = 'table'")}
        except sqlite3.DatabaseError as e:
            raise GuardError(f"not a database: {path}") from e
    out = []
    for name, required in (("memory_units", profile.LEGACY_UNITS), ("session_contexts", profile.LEGACY_SESSIONS)):
        if name not in there:
            raise GuardError(f"no table {name}")
        rows = read_table(spark, str(path), name)
        if missing := profile.missing_columns(rows, required):
            raise GuardError(f"{name} lacks columns: {missing}")
        out.append(rows)
    return out[0], out[1]


def inspect(spark: SparkSession, path: str | Path) -> dict:
    """Counts, distributions and coverage of a legacy file; no text of it."""
    units, sessions = tables(spark, path)
    pairs = lambda df: {r.value: r.n for r in df.collect()}
    return {
        "sha256": file_sha256(path), "size_bytes": os.path.getsize(path), "memory_units": units.count(), "session_contexts": sessions.count(),
        "by": {c: pairs(profile.distribution(units, c)) for c in ("type", "status", "memory_kind")},
        "coverage": profile.coverage(units, ["evidence_json", "source_refs_json"], ["workspace_id", "repo_id"]).first().asDict(),
        "session_coverage": profile.coverage(sessions, ["evidence_refs_json", "source_refs_json"], []).first().asDict(),
    }


def apply(source: str | Path, staging: str | Path, run: Callable[[Path], int]) -> int:
    """Copies ``source`` to a read-only snapshot in the empty folder ``staging`` and runs an import of it; ``run`` gets the snapshot.

    The source must be the same before, after the copy and after the import, and outside the staging folder.
    """
    source, staging = checked(source), Path(staging).resolve()
    if staging == source.parent or staging in source.parents or source in staging.parents:
        raise GuardError("the staging folder and the source overlap")
    staging.mkdir(parents=True, exist_ok=True)
    if any(staging.iterdir()):
        raise GuardError("the staging folder is not empty")
    before = file_sha256(source)
    copy = staging / SNAPSHOT
    with opened(str(source)) as db, sqlite3.connect(copy) as to:
        db.backup(to)
    copy.chmod(0o444)
    try:
        if file_sha256(source) != before:
            raise GuardError("the source changed while it was copied")
        return run(copy)
    finally:
        if file_sha256(source) != before:
            raise GuardError("the source changed during the import")
