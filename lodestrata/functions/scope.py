"""Workspace identifiers: digests, aliases of a request, and the scope predicate."""

from __future__ import annotations

import hashlib
import re
from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGEST = 20


def digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:DIGEST]


def digest_of(value: Column) -> Column:
    return F.left(F.sha2(F.encode(value, "UTF-8"), 256), F.lit(DIGEST))


def is_digest(value: str | None) -> bool:
    return re.fullmatch(r"[0-9a-f]{20}", (value or "").strip()) is not None


def canonical_workspace(value: str | None) -> str:
    text = (value or "").strip()
    return text if not text or is_digest(text) else digest(text)


def forms(value: str) -> list[str]:
    """The names of one workspace: as given, without slashes at the end, as a local path, and the path's last part."""
    bare = value.rstrip("/")
    path = bare.removeprefix("file://").rstrip("/")
    return [x for x in (value, bare, path, PurePosixPath(path).name) if x]


def aliases(*values: str | None) -> list[str]:
    """All identifiers under which workspaces may be stored: each form of each of them, followed by its digest, the first of equal ones."""
    named = [name for value in values if value and value.strip() for name in forms(value.strip())]
    return list(dict.fromkeys(x for name in named for x in (name, digest(name))))


def in_workspace(column: Column, names: list[str]) -> Column:
    """Among the names, global, or a numbered variant of a digest."""
    found = column.isin(*names) | (column == "")
    for name in names:
        if is_digest(name):
            found = found | column.startswith(f"{name}-")
    return found
