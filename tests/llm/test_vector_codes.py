import math
import random

import numpy as np
import pytest

from lodestrata.llm import vector_codes as vc


def brute(rows, entries=256, rounds=4):
    """(vec_id, code, error) by the definition, in Python integers."""
    kept = [(i, l, v) for i, l, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, _, v in kept), default=0) // 4) * 4
    whole = [(i, l, [int(x) * 1024 if abs(x) >= 2**53 else math.floor(x * 1024) for x in v] + [0] * (width - len(v))) for i, l, v in kept]
    size = width // 4
    cut = lambda v, k: v[k * size : (k + 1) * size]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v, k) for _, _, v in first] for k in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for k in range(4):
            of = {}
            for _, _, v in whole:
                of.setdefault(near(cut(v, k), books[k])[1], []).append(cut(v, k))
            books[k] = [[sum(c) // len(of[j]) for c in zip(*of[j], strict=True)] if j in of else old for j, old in enumerate(books[k])]
    out = []
    for i, l, v in whole:
        best = [near(cut(v, k), books[k]) for k in range(4)]
        error = sum(e for e, _ in best)
        out.append((i, l, "".join(f"{j:02x}" for _, j in best), error if error < 1 << 63 else None))
    return out, books


def frame(spark, rows):
    return spark.createDataFrame([(i, l, v, "x", 7) for i, l, v in rows], "vec_id long, label int, embedding array<double>, code string, x int")


def check(spark, rows, monkeypatch=None):
    coded, books = vc.compress(frame(spark, rows))
    want, entries = brute(rows)
    assert sorted(map(repr, ((r.vec_id, r.label, r.code, r.error) for r in coded.collect()))) == sorted(map(repr, want))
    assert not want or [[list(e) for e in b] for b in books.entries] == entries
    return coded, books, want


def test_bounds_hold_and_nearest_is_exact():
    rng = np.random.default_rng(3)
    for scale in (3, 500):
        entries, queries = rng.integers(-scale, scale, (256, 16)), rng.integers(-scale, scale, (300, 16))
        entries[9] = entries[100]
        cells = vc.Cells(entries)
        whole = ((queries[None] - entries[:, None]) ** 2).sum(axis=2)
        lower, upper = cells.bounds(queries)
        assert (lower <= whole).all() and (whole <= upper).all()
        code, error = cells.nearest(queries)
        assert (code == whole.argmin(axis=0)).all() and (error == whole.min(axis=0)).all()
    assert (lower <= upper.min(axis=0)).sum() < 0.3 * lower.size  # most entries are never refined


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2]), [rng.gauss(0, 0.1) for _ in range(8)]) for i in range(320)]
    rows += [(i, 3, [0.25] * 8) for i in range(400, 440)] + [(5, 1, rows[5][2])] * 3
    rows += [(500, 1, None), (501, 1, [0.1] * 7 + [None]), (502, 1, [float("nan")] * 8), (503, 1, [float("inf")] + [0.0] * 7), (None, None, [0.5] * 8)]
    rng.shuffle(rows)
    coded, books, want = check(spark, rows)
    sums = {}
    for _, label, _, e in want:
        sums[label] = sums.get(label, 0) + e
    got = vc.with_label_error(coded).collect()
    assert len(got) == len(want) and all(r.label_error == sums[r.label] for r in got)
    one = coded.select("code", vc.decode(coded.code, books).alias("v")).first()
    assert one.v == [x for k in range(4) for x in books.entries[k][int(one.code[2 * k : 2 * k + 2], 16)]]


@pytest.mark.parametrize("rows", [
    [(3, 1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, 1, []), (1, None, [0.5])],
    [(1, 1, [1e300, -1e300, 1.0, 0.0]), (2, 1, [1e22, 3.0, -2.0**60, 5.0]), (3, 2, [-0.1, 0.1, 0.1, 0.1])],
    [(1, 1, []), (2, 1, [])],
    [],
])
def test_edges(spark, rows):
    check(spark, rows)
