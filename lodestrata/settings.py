"""Settings from the environment and where a store keeps its tables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tables of a store, each a folder of versions.
TABLES = ("units", "vectors", "nodes", "edges", "cjk", "audit")


@dataclass(frozen=True)
class Settings:
    """``root``: the folder of the published tables. The graph counts as configured if its endpoint, user and password are all there."""

    root: str
    graph_uri: str = ""
    graph_user: str = ""
    graph_password: str = ""
    graph_database: str = "graph"

    @property
    def graph_configured(self) -> bool:
        return all((self.graph_uri, self.graph_user, self.graph_password))

    def path(self, table: str) -> str:
        if table not in TABLES:
            raise KeyError(table)
        return f"{self.root}/{table}"

    def shown(self) -> dict[str, object]:
        """What may be shown of the settings: no user, no password."""
        return {"root": self.root, "configured": self.graph_configured, "endpoint": endpoint(self.graph_uri), "database": self.graph_database}


def load(environment: Mapping[str, str] = os.environ) -> Settings:
    get = environment.get
    root = get("LODESTRATA_ROOT") or os.path.join(os.path.expanduser("~"), ".local/share/lodestrata")
    return Settings(root.rstrip("/") or "/", get("LODESTRATA_GRAPH_URI", ""), get("LODESTRATA_GRAPH_USER", ""), get("LODESTRATA_GRAPH_PASSWORD", ""), get("LODESTRATA_GRAPH_DATABASE") or "graph")


def endpoint(uri: str) -> str:
    """An address without user, password, query and fragment; one that can't be read shows only that there is one."""
    if not uri:
        return ""
    try:
        parts = urlsplit(uri)
        host = parts.hostname or ""
        place = (f"[{host}]" if ":" in host else host) + (f":{parts.port}" if parts.port else "")
    except ValueError:
        return "configured"
    return urlunsplit((parts.scheme, place, parts.path, "", ""))


def endpoint_of(uri: Column) -> Column:
    """``endpoint`` for a column of addresses with a host name: the host in lower case, no user, query or fragment."""
    scheme = F.lower(F.regexp_extract(uri, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.lower(F.regexp_extract(uri, r"^[^:]+://(?:[^/?#]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(uri, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(uri, F.lit("")) == "", F.lit("")).when(scheme == "", F.lit("configured")).otherwise(F.concat(scheme, F.lit("://"), place, path))
