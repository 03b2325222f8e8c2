import random

import pytest

from lodestrata.llm import substrings


def brute(rows, length):
    """kept bytes and maximal removed runs of rows (key, raw), equal keys being one place."""
    seen, out = {}, []
    for key, raw in rows:
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if seen.setdefault(w, (key, i)) != (key, i):
                gone[i : i + length] = [True] * length
        edge = [i for i in range(len(raw) + 1) if (i > 0 and gone[i - 1]) != (i < len(raw) and gone[i])]
        out.append(([(a, b - a) for a, b in zip(edge[::2], edge[1::2], strict=True)], bytes(x for x, g in zip(raw, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot", [0, 3, 10**6])
@pytest.mark.parametrize(("seed", "length", "gram"), [(1, 20, 8), (2, 100, 32), (3, 30, 30), (4, 20, 5)])
def test_against_brute_force(spark, monkeypatch, seed, length, gram, hot):
    import zlib

    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "MERGED", 500)
    rng = random.Random(seed)
    piece = lambda k: "".join(rng.choices("abé \n", k=k))
    shared = [piece(rng.randint(length, 4 * length)) for _ in range(6)] + ["ab" * 3 * length, "x" * 2 * length, "short"]
    texts = [None, "", piece(length - 1)]
    for _ in range(80):
        t = "".join(rng.choice([rng.choice(shared), piece(rng.randint(0, 2 * length))]) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.5 and t:
            k = rng.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        texts.append(t)
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(40, texts[40]), (40, texts[41]), (1000, texts[40] + "é" * 5)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept string, d int")
    got = sorted(repr((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept))) for r in substrings.dedup(df, length=length, gram=gram).collect())
    order = sorted(((-1 if i is None else i, zlib.crc32((t or "").encode())), (t or "").encode(), i) for i, t in rows)
    want = sorted(repr((i, len(raw), s, kept)) for (_, raw, i), (s, kept) in zip(order, brute([(k, raw) for k, raw, _ in order], length), strict=True))
    assert got == want


def test_hot_passage_over_many_partitions(spark):
    rng = random.Random(9)
    passage = "the same passage " * 10
    rows = [(i, "".join(rng.choices("abcdefgh ", k=80)) + passage + "".join(rng.choices("abcdefgh ", k=80))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    got = {r.doc_id: bytes(r.kept) for r in substrings.dedup(df).collect()}
    want = brute([(i, t.encode()) for i, t in rows], 100)
    assert all(got[i] == w[1] for (i, _), w in zip(rows, want, strict=True))


def test_empty(spark):
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
