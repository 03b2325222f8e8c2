"""Command line: profile or import a legacy file, import a snapshot, rebuild the CJK index, relink, clean up test entities, show capabilities. Prints one JSON report."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata import settings
from lodestrata.operators import graphstore
from lodestrata.operators.merge import StoreError
from lodestrata.plans import imports
from lodestrata.sources import guard
from lodestrata.sources.snapshot import read_sections
from lodestrata.sources.store import Commit, Store, Stored, rows_of


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodestrata")
    out.add_argument("--store", help="folder of the published tables")
    out.add_argument("--as-of", default="1970-01-01T00:00:00Z", help="time for rows without one")
    todo = out.add_subparsers(dest="todo", required=True)
    for name in ("inspect-legacy", "import-legacy", "import-snapshot"):
        one = todo.add_parser(name)
        one.add_argument("path")
        if name != "inspect-legacy":
            one.add_argument("--apply", action="store_true", help="write; otherwise only report")
        if name == "import-legacy":
            one.add_argument("--staging", help="empty folder for the read-only snapshot; needed to apply")
        if name == "import-snapshot":
            one.add_argument("--sync-graph", action="store_true", help="merge nodes and edges too; needs --apply")
    for name in ("reindex-cjk", "relink"):
        one = todo.add_parser(name)
        one.add_argument("--dry-run", action="store_true")
    one.add_argument("--document", default="", help="link the chunks of one document only")
    one.add_argument("--limit", type=int, help="link the first chunks only")
    one = todo.add_parser("test-entities")
    one.add_argument("workspaces", nargs="+")
    one.add_argument("--apply", action="store_true")
    todo.add_parser("capabilities")
    return out


EMPTY = {"units": imports.empty_units, "vectors": imports.empty_vectors, "nodes": lambda s: graphstore.empty(s)[0], "edges": lambda s: graphstore.empty(s)[1]}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    a.store = a.store or settings.load().root
    spark = spark or SparkSession.builder.appName("lodestrata").getOrCreate()
    store = Store(spark, a.store) if a.store else None

    def table(base: Commit, name: str) -> Stored | DataFrame:
        """A store's table, an empty one if it was never written. Any other failure to read ends the command."""
        return EMPTY[name](spark) if store is None else store.table(name, base, EMPTY[name](spark))

    def done(make: Callable[[Commit], imports.Import], apply: bool = True) -> dict:
        """The report of an import, committed if it is to be applied."""
        if not apply:
            return make(Commit() if store is None else store.head()).report
        if store is None:
            raise StoreError("no store is named")
        out, commit = store.update(make)
        return out.report | {"published": commit.version}

    graph_of = lambda base: (table(base, "nodes"), table(base, "edges"))
    try:
        if a.todo == "inspect-legacy":
            report = guard.inspect(spark, a.path)
        elif a.todo == "capabilities":
            report = imports.capabilities()
        elif a.todo == "reindex-cjk":
            base = Commit() if store is None else store.head()
            index = store.index(base) if base.segments else None
            report = imports.reindex_cjk(rows_of(table(base, "units")), index, a.dry_run).report
            if not a.dry_run and store is not None:
                report["published"] = store.reindexed(base).version
        elif a.todo == "relink":
            report = done(lambda base: imports.relink_stored(*graph_of(base), a.as_of, a.document, a.limit, a.dry_run), not a.dry_run)
        elif a.todo == "test-entities":
            report = done(lambda base: imports.cleanup(table(base, "units"), *graph_of(base), a.workspaces, a.apply), a.apply)
        elif a.todo == "import-snapshot":
            if a.sync_graph and not a.apply:
                raise guard.GuardError("--sync-graph needs --apply")
            before = guard.file_sha256(guard.checked(a.path))
            snapshot = read_sections(spark, a.path)
            make = lambda base: imports.import_snapshot(table(base, "units"), snapshot, a.as_of, table(base, "vectors"), graph_of(base) if a.sync_graph else None)
            report = {"mode": "apply" if a.apply else "dry-run", "source": a.path, "source_sha256": before, **done(make, a.apply)}
            report["source_unchanged"] = guard.file_sha256(a.path) == before
        else:
            report = {}

            def run(path) -> int:  # noqa: ANN001
                report.update(done(lambda base: imports.import_legacy(spark, table(base, "units"), str(path), a.as_of), a.apply))
                return 0

            if a.apply and not a.staging:
                raise guard.GuardError("--apply needs --staging")
            guard.apply(a.path, a.staging, run) if a.apply else run(guard.checked(a.path))
    except (guard.GuardError, StoreError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1
    print(json.dumps(report, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
