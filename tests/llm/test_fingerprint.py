import hashlib
import random

from pyspark.sql import functions as F

from lodestrata.llm import fingerprint as fp
from lodestrata.llm.queries import op7_document_fingerprints


def slow(spark, texts, term=5):
    """Bits by plain counting over the same term hashes."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", F.transform(fp.words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    terms = []
    for r in df.orderBy("i").collect():
        terms += [(r.i, r.h[k : k + term]) for k in range(max(1, len(r.h) - term + 1))] if r.h else []
    hashed = spark.createDataFrame(terms, "i int, t array<long>").select("i", F.when(F.size("t") < term, F.xxhash64("t")).otherwise(F.xxhash64(*[F.get("t", F.lit(k)) for k in range(term)])).alias("x"), F.size("t").alias("n"))
    out = {i: [] for i in range(len(texts))}
    whole = {r.i: len(r.h) for r in df.collect()}
    exact = hashed.withColumn("y", F.xxhash64(F.lit(0)))
    for r in exact.collect():
        out[r.i].append(r.x)
    bits = {}
    for i, hs in out.items():
        v = sum(1 << b for b in range(64) if 2 * sum((x % (1 << 64)) >> b & 1 for x in hs) > len(hs)) if whole[i] > term else None
        bits[i] = v
    return bits


def test_votes_by_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "B", "cé", "dd", "e.", "f"], k=n)) for n in (0, 1, 4, 5, 6, 7, 30, 200, 3000)]
    pairs = [(i, t, texts[-1 - i], "x") for i, t in enumerate(texts)] + [(99, None, None, "x")]
    rows = fp.fingerprints(spark.createDataFrame(pairs, "i int, text string, other string, h string"), ["text", "other"], ["i"]).collect()
    got = {r.i: r.fp0 % (1 << 64) for r in rows}
    want = slow(spark, texts)
    assert len(rows) == len(texts) + 1 and all(got[i] == v for i, v in want.items() if v is not None)
    assert got[0] == got[99] == 0 and all(r.fp1 % (1 << 64) == got.get(len(texts) - 1 - r.i, 0) for r in rows)


def test_binary_search_of_stretches(spark):
    bounds = [-3.5, 0.0, 1.0, 7.0, 9.0]
    xs = [None, -9.0, -3.5, 0.5, 1.0, 6.9, 7.0, 8.0, 9.0, 99.0]
    for some in (bounds, bounds[:1], []):
        got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(fp.above(some, F.col("x")).alias("p")).collect()]
        assert got == [0 if x is None else sum(b <= x for b in some) for x in xs]


def expected_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def check_order(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, stretch string")
    got = fp.fingerprint_documents(df).collect()
    order = expected_order(rows)
    want = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        e = t[: len(t) - cut] + n[:cut]
        want.append(repr((i, len(t), hashlib.sha256(e.encode()).hexdigest())))
    assert sorted(repr((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == sorted(want)
    return got


def test_followers(spark, monkeypatch):
    monkeypatch.setattr(fp, "STRETCH", 7)
    rng = random.Random(8)
    rows = [(rng.choice([i, i, i // 3]), "".join(rng.choices("ab é😀\n", k=rng.randint(0, 40)))) for i in range(60)]
    rows += [(None, "first"), (None, None), (5, None), (10**15, "far"), rows[0], rows[0]]
    check_order(spark, rows)


def test_one_none_and_equal_texts(spark):
    got = check_order(spark, [(1, "a b c d e f g h")])
    assert got[0].fp == got[0].next_fp
    assert fp.fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = check_order(spark, [(1, "x y z"), (2, "x y z"), (3, "x y z")])
    assert len({r.fp for r in same}) == 1


def test_lookups_find_all_within_the_radius(spark):
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(200):
        x = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    df = spark.createDataFrame([(x,) for x in [*signed, None]], "fp long")
    got = sorted((r.query, r.fp, r.distance) for r in fp.within(df.where("fp % 3 = 0"), df).collect())
    dist = lambda a, b: bin((a ^ b) % (1 << 64)).count("1")
    assert got == sorted((a, b, dist(a, b)) for a in signed if a % 3 == 0 for b in signed if dist(a, b) <= 3)


def test_query_likeness(spark):
    rows = op7_document_fingerprints(spark, "/root/testdata/sf0.001").toPandas()
    assert len(rows) == 200 and rows.near_edited.between(0, 1).all() and rows.near_next.between(0, 1).all()
    assert rows[rows.n_chars > 400].near_edited.mean() > rows[rows.n_chars > 400].near_next.mean() + 0.1
    assert rows[rows.doc_id % 100 == 0].n_near.notna().all() and rows[rows.doc_id % 100 != 0].n_near.isna().all()
