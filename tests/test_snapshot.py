"""A JSON document read in ranges gives the same objects as the standard library, wherever the ranges end."""

import json
import random

import pytest

from lodestrata.operators.merge import StoreError
from lodestrata.sources import snapshot

ODD = ['a"b', "{", "}", "[]", '\\', '\\"}', "}{][", "é日本", "line\nend", ",", ":", '"},{"', " ", ""]


def value(rng, deep=0):
    kind = rng.randrange(7 if deep < 3 else 4)
    if kind < 2:
        return rng.choice(ODD)
    if kind < 4:
        return rng.choice([1, -2.5, True, None])
    if kind < 6:
        return {rng.choice(ODD) + str(i): value(rng, deep + 1) for i in range(rng.randrange(4))}
    return [value(rng, deep + 1) for _ in range(rng.randrange(4))]


def document(rng):
    out = {}
    for name in rng.sample(["sessions", "turns", "no{des", 'q"x', "edges", "meta"], 5):
        kind = rng.randrange(6)
        out[name] = [{"id": str(i), "v": value(rng)} for i in range(rng.randrange(9))] if kind < 3 else {"a": {"b": {}}, "c": [{}]} if kind == 3 else rng.choice([[], [1, "}", 2], "x}y", 7, None])
    return out


@pytest.fixture(params=[40, 333, 1 << 20])
def ranges(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_same_objects_wherever_ranges_end(spark, tmp_path, ranges):
    rng = random.Random(11)
    for k in range(3):
        doc = document(rng) | {"last": [{"id": "z", "v": "}"}]}
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(doc, ensure_ascii=bool(k % 2), indent=[None, 2, 0][k]) + "\n" * (k % 2))
        got = [(r.section, json.loads(r.element)) for r in snapshot.elements(spark, str(path)).orderBy("seq").collect()]
        assert got == [(name, x) for name, items in doc.items() if isinstance(items, list) for x in items if isinstance(x, dict)]


def test_a_document_in_part_files(spark, tmp_path):
    whole = json.dumps({"turns": [{"id": str(i), "sessionId": "s}"} for i in range(30)], "nodes": [{"id": "n", "tags": ["a"]}]})
    for k, at in enumerate(range(0, len(whole), 97)):
        (tmp_path / f"part-{k:03d}.json").write_text(whole[at : at + 97])
    lists = snapshot.read_sections(spark, str(tmp_path))
    assert [r.id for r in lists["turns"].orderBy("seq").collect()] == [str(i) for i in range(30)] and lists["nodes"].first().tags == ["a"] and lists["edges"].count() == 0


@pytest.mark.parametrize("text", ['{"a": [{"b": 1}', '{"a": ["x]}', '{"a": [{}]}]'])
def test_what_is_not_a_document(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(StoreError):
        snapshot.elements(spark, str(tmp_path / "x.json"))
