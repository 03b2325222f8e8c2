import hashlib
import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import ingest, merge, profile, skills, vectors
from lodestrata.sources.store import Store
from lodestrata.schema import UNITS
from lodestrata.sources import guard, sqlite

STAGED = "id string, type string, summary string, resolution string, evidence_json string, context_json string, tags array<string>, status string, memory_kind string, source_refs array<string>, session_id string, workspace_id string, repo_id string, created_at string, updated_at string, seq int"


def staged(spark, *rows):
    base = dict.fromkeys(["id", "type", "summary", "resolution", "evidence_json", "context_json", "tags", "status", "memory_kind", "source_refs", "session_id", "workspace_id", "repo_id", "created_at", "updated_at"])
    return spark.createDataFrame([tuple({**base, **r, "seq": k}.values()) for k, r in enumerate(rows)], STAGED)


def test_coercion_and_fingerprints(spark):
    rows = merge.coerced(staged(spark, {"summary": ' a "q"\n\u0001é中/<&> '}, {"id": " x ", "summary": "s", "type": "fact", "status": "active"}, {"summary": "s", "type": "  "}, {"summary": " "}), "now").collect()
    one = {"type": "lesson", "summary": 'a "q"\n\u0001é中/<&>', "resolution": "", "session_id": "", "workspace_id": "", "repo_id": ""}
    want = hashlib.sha256(json.dumps(one, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    assert rows[0].fingerprint == want and rows[0].id == "memory:" + want[:24] and rows[0].status == "draft" and rows[0].created_at == "now"
    assert rows[1].id == "x"
    good, bad = merge.split_valid(merge.coerced(staged(spark, {"summary": "s"}, {"summary": "s", "type": "  "}, {"summary": " "}, {"summary": "s", "status": "odd", "memory_kind": "odd"}), "now"))
    assert good.count() == 1 and sorted(tuple(r.faults) for r in bad.collect()) == [("status", "memory_kind"), ("summary",), ("type",)]


def test_merge_is_last_wins_and_idempotent(spark, tmp_path):
    current = spark.createDataFrame([("a", "old", "t0"), ("b", "old", "t0")], "id string, text string, created_at string")
    new = spark.createDataFrame([("a", "n1", "t1", 0), ("c", "n1", "t1", 1), ("c", "n2", "t2", 2)], "id string, text string, created_at string, seq int")
    plan = merge.merge_plan(current, new)
    assert tuple(merge.report(plan).first()) == (1, 2)
    out = merge.merged(current, plan)
    assert {tuple(r) for r in out.collect()} == {("a", "n1", "t0"), ("b", "old", "t0"), ("c", "n2", "t2")}
    store = Store(spark, str(tmp_path))
    store.commit(store.commit(store.head(), {"rows": current}), {"rows": plan.select(*current.columns)})
    assert {tuple(r) for r in store.table("rows").rows().collect()} == {tuple(r) for r in out.collect()}
    again = merge.merge_plan(out, new)
    assert merge.report(again).first().created == 0 and {tuple(r) for r in merge.merged(out, again).collect()} == {tuple(r) for r in out.collect()}
    assert tuple(merge.report(merge.merge_plan(current, new.limit(0))).first()) == (0, 0)


def test_decisions(spark):
    rows = [("d1", " Why? ", "so", "2026-01-05", ["x"], "ACTIVE ", "High", {"refines": ["d2", " ", "d3"]}, [("2026-01-01",), ("2026-01-03",)]), ("d2", "Same", "a", "t", None, "weird", None, None, []), ("d3", "Same", "a", "t", None, None, None, None, None), ("", "q", "", "", None, None, None, None, None), ("d5", " ", "", "", None, None, None, None, None)]
    df = spark.createDataFrame(rows, ingest.DECISIONS)
    got = {r.id: r for r in ingest.decisions(df, source="log").collect()}
    assert set(got) == {"continuity:d1", "continuity:d2", "continuity:d3"}
    one = got["continuity:d1"]
    assert (one.status, one.memory_kind, one.updated_at, one.created_at, one.summary, one.source_refs) == ("active", "memory", "2026-01-03", "2026-01-05", "Why?", ["continuity:d1", "log"])
    assert json.loads(one.context_json)["priority"] == "High" and json.loads(one.evidence_json) == [{"id": "d1", "kind": "continuity-decision"}]
    assert got["continuity:d2"].status == "deprecated" and got["continuity:d3"].status == "active"
    assert {(r.id, r.dst, r.confidence) for r in ingest.decision_edges(df).collect()} == {("continuity:d1:refines:d2", "continuity:d2", "high"), ("continuity:d1:refines:d3", "continuity:d3", "high")}


def test_documents_and_embeddings(spark):
    docs = [("p1", "a.pdf", "/x", "h", 2, "ready", [("c1", 0, "1", "one", "h1"), ("c2", 1, "x", "two", ""), (" ", 2, "3", "three", ""), ("c4", 3, "4", " ", "")]), ("p2", "b.pdf", None, None, None, " DRAFT", [("c5", 0, "2", "five", None)]), ("p3", "", None, None, None, None, []), ("p4", "d.pdf", None, None, None, None, None)]
    df = spark.createDataFrame(docs, ingest.DOCUMENTS)
    rows = ingest.chunks(df)
    assert tuple(ingest.document_report(df, rows).first()) == (4, 2, 2, 5)
    units = {r.id: r for r in ingest.document_units(rows, "now").collect()}
    assert units["c1"].summary == "a.pdf - page 1" and units["c1"].tags == ["document", "pdf", "active"] and units["c5"].memory_kind == "candidate"
    emb = spark.createDataFrame([("c1", 0, [1.0]), ("c1", 1, [2.0]), ("c5", 0, [])], "chunkId string, seq int, values array<double>")
    assert {r.id: r["values"] for r in ingest.with_values(ingest.document_units(rows, "now"), emb, "chunkId").collect()} == {"c1": [2.0], "c5": None}


def test_snapshot(spark):
    row = ([("s1", "w1")], [("t1", "s1"), ("t2", "s1"), ("t3", "s2")], None, [("n1", None, None, "text", None, None, ["t2", "gone", "t1"], ["x"], "", ""), ("n2", "fact", "L", "", "draft", "low", ["t1", "t3"], None, "", ""), ("n3", "fact", "L", "", "draft", "low", [], None, "", "")], [])
    snap = spark.createDataFrame([row], ingest.SNAPSHOT)
    assert tuple(ingest.snapshot_profile(snap).first()) == (1, 3, 0, 3, 0)
    nodes = snap.select(F.explode("nodes").alias("n")).select("n.*").withColumnRenamed("evidenceTurnIds", "evidence_ids")
    turns = snap.select(F.explode("turns").alias("t")).select("t.id", F.col("t.sessionId").alias("session_id"))
    sessions = snap.select(F.explode("sessions").alias("s")).select("s.id", F.col("s.workspaceId").alias("workspace_id"))
    got = {r.id: r for r in ingest.extension_units(nodes, turns, sessions).collect()}
    assert (got["n1"].type, got["n1"].summary, got["n1"].session_id, got["n1"].workspace_id, got["n1"].source_refs) == ("concept", "Knowledge", "s1", "w1", ["turn:t2", "turn:t1"])
    assert (got["n2"].session_id, got["n2"].workspace_id) == ("", "") and got["n3"].evidence_json == "[]"


def legacy(path, rows, sessions=()):
    db = sqlite3.connect(path)
    db.execute(f"create table memory_units ({', '.join(f'{c} text' for c in profile.LEGACY_UNITS)})")
    db.execute(f"create table session_contexts ({', '.join(f'{c} text' for c in profile.LEGACY_SESSIONS)})")
    base = dict.fromkeys(profile.LEGACY_UNITS, "") | {"evidence_json": "[]", "context_json": '{"source_id":"mine","own":"kept"}', "tags_json": '["a"]', "source_refs_json": "[]", "storage_targets_json": "{}", "summary": "s"}
    for r in rows:
        v = base | r
        db.execute(f"insert into memory_units ({', '.join(v)}) values ({', '.join('?' * len(v))})", list(v.values()))
    for r in sessions:
        v = dict.fromkeys(profile.LEGACY_SESSIONS, "") | {"context_json": "{}", "evidence_refs_json": "[]", "source_refs_json": "[]"} | r
        db.execute(f"insert into session_contexts ({', '.join(v)}) values ({', '.join('?' * len(v))})", list(v.values()))
    db.commit()
    db.close()


def test_legacy_import(spark, tmp_path):
    path = tmp_path / "old.db"
    rows = [{"id": "1", "type": "fact", "status": "active"}, {"id": "2", "type": "odd", "memory_kind": "raw"}, {"id": "3", "status": "Rejected "}, {"id": "4", "tags_json": "{}"}, {"id": "5", "context_json": "no"}, {"id": "6", "storage_targets_json": "3"}, {"id": "7", "storage_targets_json": "[1]"}, {"id": " "}, {"id": "9", "summary": " "}, {"id": "10", "storage_targets_json": "null"}]
    legacy(path, rows, [{"session_id": "s", "workspace_id": 'w"', "evidence_refs_json": '["e1",{"kind":"k","id":"i"}]'}, {"session_id": " "}])
    units, sessions = guard.tables(spark, path)
    got = {r.id: r for r in ingest.legacy_units(units).collect()}
    assert set(got) == {"legacy:1", "legacy:2", "legacy:3", "legacy:7"}
    assert [(got[f"legacy:{k}"].status, got[f"legacy:{k}"].memory_kind) for k in (1, 2, 3)] == [("draft", "candidate"), ("draft", "raw"), ("rejected", "memory")]
    context = json.loads(got["legacy:2"].context_json)
    assert got["legacy:2"].type == "lesson" and context["source_type"] == "odd" and context["source_id"] == "2" and context["own"] == "kept"
    one = ingest.legacy_sessions(sessions).collect()
    assert len(one) == 1 and one[0].id == "legacy-session-context:" + hashlib.sha256(json.dumps(["s", 'w"', ""]).encode()).hexdigest()
    assert json.loads(one[0].evidence_json) == [{"id": "e1", "kind": "session-evidence"}, {"kind": "k", "id": "i"}]
    report = guard.inspect(spark, path)
    assert report["memory_units"] == 10 and report["by"]["status"]["(empty)"] == 8 and report["session_coverage"]["evidence_refs_json"] == 1


def test_guard(spark, tmp_path):
    path = tmp_path / "old.db"
    legacy(path, [{"id": "1"}])
    seen = []
    assert guard.apply(path, tmp_path / "stage", lambda p: seen.append((p.name, os.stat(p).st_mode & 0o222, guard.tables(spark, p)[0].count())) or 7) == 7
    assert seen == [(guard.SNAPSHOT, 0, 1)]
    with pytest.raises(guard.GuardError, match="not empty"):
        guard.apply(path, tmp_path / "stage", lambda p: 0)
    with pytest.raises(guard.GuardError, match="changed during"):
        guard.apply(path, tmp_path / "s2", lambda p: path.write_bytes(path.read_bytes() + b"x") and 0)
    (tmp_path / "link").symlink_to(path)
    with pytest.raises(guard.GuardError, match="regular"):
        guard.tables(spark, tmp_path / "link")
    with pytest.raises(guard.GuardError, match="overlap"):
        guard.apply(path, tmp_path, lambda p: 0)
    sqlite3.connect(tmp_path / "none.db").execute("create table memory_units (id text)")
    with pytest.raises(guard.GuardError, match="lacks|no table"):
        guard.tables(spark, tmp_path / "none.db")


def test_sqlite_source_reads_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sqlite, "STRIDE", 10)
    db = sqlite3.connect(tmp_path / "t.db")
    db.execute('create table "odd ""name" (a integer, b text)')
    db.executemany('insert into "odd ""name" values (?, ?)', [(i, None if i % 2 else str(i)) for i in range(35)])
    db.commit()
    rows = sqlite.read_table(spark, str(tmp_path / "t.db"), 'odd "name')
    assert rows.count() == 35 and sorted(int(r.a) for r in rows.collect()) == list(range(35))


CAP = "id string, type string, status string, memory_kind string, summary string, resolution string, evidence_json string, context_json string, source_refs array<string>, updated_at string"


def test_skills(spark):
    def row(i, cap, *, type="workflow", evidence="[]", refs=("r",), at="1"):
        return (i, type, "active", "memory", "sum", "res", evidence, json.dumps({"capability": cap}), list(refs), at)

    big = {"kind": "skill", "name": "n" * 500, "scope": ["s" * 100] * 30, "prerequisites": "no list", "instructions": "i" * 9000}
    rows = [row("a", big, at="3"), row("b", {"kind": "skill", "description": "Flash BMC"}, at="5"), row("c", {"kind": "tool"}), row("d", {"kind": "skill"}, type="fact"), row("e", {"kind": "skill"}, refs=()), row("f", {"kind": "skill"}, refs=(), evidence='[{"kind": "k", "id": "i", "x": "secret"}, 5]', at="4")]
    df = spark.createDataFrame(rows, CAP)
    got = skills.list_skills(df).collect()
    assert [r.id for r in got] == ["b", "f", "a"]
    a = got[2]
    assert len(a.name) == 120 and a.name.endswith("…") and len(a.scope) == 10 and all(len(x) == 80 for x in a.scope) and a.prerequisites == [] and len(a.instructions) == 8000 and a.version == "1.0.0"
    assert got[0].name == "sum" and [r.id for r in skills.list_skills(df, " bmc ").collect()] == ["b"]
    assert skills.list_skills(df, limit=0).count() == 1 and skills.get_skill(df, "c").count() == 0 and skills.get_skill(df, "b").count() == 1


def test_vectors(spark):
    rows = [("a", "knowledge", 2, [1.0, 0.0]), ("b", "knowledge", 2, [0.0, 1.0]), ("c", "candidate", 2, [1.0, 0.0]), ("z", "knowledge", 2, [0.0, 0.0]), ("d", "knowledge", 3, [1.0, 0.0, 0.0]), ("n", "knowledge", 2, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "source_id string, source_kind string, dimensions int, embedding array<float>")
    assert [(r.source_id, r.score) for r in vectors.top(df, [2.0, 0.0]).collect()] == [("a", 1.0), ("c", 1.0)]
    assert [r.source_id for r in vectors.top(df, [1.0, 1.0], 1, "knowledge").collect()] == ["a"]
    assert vectors.top(df, [0.0, 0.0]).count() == 0
    asked = df.where("dimensions = 2").select(F.col("source_id").alias("query_id"), "embedding")
    many = {(r.query_id, r.source_id): r.score for r in vectors.top_each(df, asked).collect()}
    for q, _, dims, v in rows:
        if dims == 2:
            assert {s: x for (k, s), x in many.items() if k == q} == {r.source_id: r.score for r in vectors.top(df, v).collect()}
    bad = spark.createDataFrame([("", [1.0]), ("x", []), ("y", [float("nan")]), ("w", [float("inf")]), ("v", [1.0])], "source_id string, embedding array<float>")
    assert [r.source_id for r in bad.where(vectors.valid()).collect()] == ["v"]
    assert tuple(vectors.stats(df.limit(0)).first()) == (0, 0)


def test_profiles(spark, tmp_path):
    df = spark.createDataFrame([("a", "[1]"), (" ", "{}"), (None, "bad"), ("", None), ("a", "[]")], "v string, j string")
    assert {r.value: r.n for r in profile.distribution(df, "v").collect()} == {"a": 2, "(empty)": 3}
    assert {r.value: r.n for r in profile.distribution(df, "v", blank=False).collect()} == {"a": 2, "(empty)": 2, " ": 1}
    assert tuple(profile.coverage(df, ["j"], ["v"]).first()) == (1, 2)
    assert profile.missing_columns(df, ["v", "x", "k"]) == ["k", "x"]
    (tmp_path / "f").write_bytes(b"abc")
    assert profile.file_digests(spark, str(tmp_path / "f")).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    assert tuple(profile.store_stats(spark.createDataFrame([], UNITS)).first()) == (0, 0, 0, 0, 0, 0)


def test_records_keep_all_that_was_stored(spark):
    rows = [("1", '["a", {"id": "b", "n": 2.5}, 7]', '{"deep": {"x": [1, null]}, "n": 1, "t": true}'), ("2", "oops", "[1]"), ("3", None, None), ("4", "{}", " {}")]
    got = {r.id: (r.evidence.toPython(), r.context.toPython()) for r in merge.records(spark.createDataFrame(rows, "id string, evidence_json string, context_json string")).collect()}
    assert got["2"] == got["3"] == got["4"] == ([], {})
    evidence, context = got["1"]
    assert evidence[0] == "a" and float(evidence[1]["n"]) == 2.5 and evidence[2] == 7 and context["deep"] == {"x": [1, None]} and context["n"] == 1 and context["t"] is True
