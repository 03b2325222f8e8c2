import random

import numpy as np

from lodestrata.llm import decontaminate as dc


def slow_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH), h[i - 1, j] + dc.GAP, h[i, j - 1] + dc.GAP)
    return int(h.max())


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(150):
        a, b = rng.integers(0, 4, rng.integers(1, 20)), rng.integers(0, 4, rng.integers(1, 40))
        assert dc.align(a, b)[0] == slow_align(a, b)


def make(seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(480)] + [f"é{i}ñ" for i in range(20)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(20, 50)))) for k in range(20)]
    docs, want = [], set()
    for i in range(300):
        w = rng.choices(vocab, k=rng.randint(40, 200))
        if i % 4 == 0:
            k = rng.choice(items[:10] if i % 8 else items[:1])[0]
            own = items[k][1].split()
            if i % 12 == 0:  # edited: a word in nine changed, some dropped
                own = [x if j % 9 else "new" for j, x in enumerate(own) if j % 13 != 5]
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() + "," if i % 16 == 0 else x for x in own]
            want.add((i, k))
        docs.append((i, " ".join(w)))
    return docs, items, want


def test_planted_copies(spark):
    docs, items, want = make()
    odd = [(None, items[3][1]), (903, "only this."), (900, None), (901, ""), (902, "w1 w2 " * 60_000 + items[4][1]), docs[4], docs[4]]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in docs + odd], "doc_id long, text string, item_id string, score double")
    bench = spark.createDataFrame([*items, items[0], (77, None), (78, ""), (79, "w1"), (80, "w1 w2"), (81, "Only  this")], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in dc.contaminated(df, bench).collect()]
    assert {(i, k) for i, k in got if i is not None and i < 900} == want
    assert [i for i, k in got if k > 78] == [903]
    assert (None, 3) in got and (902, 4) in got and got.count((4, next(k for i, k in want if i == 4))) == 3
    left = dc.decontaminated(df, bench)
    assert left.columns == df.columns
    ids = [r.doc_id for r in left.collect()]
    assert {i for i in ids if i is not None and i < 900} == {i for i, _ in docs} - {i for i, _ in want} and None in ids and 900 in ids and 901 in ids


def test_same_by_brute_force_on_the_small_tables(spark):
    """Every pair whose best alignment with the whole text reaches the threshold, tried one by one."""
    from lodestrata.llm.common import table
    d = "/root/testdata/sf0.001"
    docs, bench = table(spark, d, "documents").orderBy("doc_id").limit(60), table(spark, d, "benchmark")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()}
    want = set()
    import pyarrow as pa

    items = [(r.item_id, dc.folded(pa.array([r.text]))[0]) for r in bench.collect()]
    for r in docs.collect():
        h, _ = dc.folded(pa.array([r.text]))
        for k, w in items:
            if np.isin(w, h).mean() * 1.0 >= dc.LEAST and dc.align(w, h)[0] >= dc.LEAST * dc.MATCH * len(w):
                want.add((r.doc_id, k))
    assert got == want


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert dc.contaminated(df, bench).count() == 0
    assert dc.contaminated(spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"), bench.limit(0)).count() == 0
    assert dc.contaminated(spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"), bench).count() == 1


def test_frequent_seeds_find_edited_and_partial_copies_beside_a_whole_one(spark):
    one, two = [f"q{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    edited = [x if j % 5 else "new" for j, x in enumerate(one)]
    texts = [one, two] + [["pad", *edited, f"end{i}"] for i in range(60)] + [[f"other{i}", *two[:21]] for i in range(60)] + [[*two[:8], f"no{i}"] for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "item_id long, text string")
    want = {(0, 1), (1, 2)} | {(i, 1) for i in range(2, 62)} | {(i, 2) for i in range(62, 122)}
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(df, bench).collect()} == want


def test_recall_of_edited_copies(spark):
    """Items with up to a third of their words replaced, dropped or doubled: of those whose alignment reaches the threshold, nine in ten at least are found."""
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(2000)]
    items = [(k, rng.choices(vocab, k=rng.randint(20, 60))) for k in range(40)]
    docs, reach = [], []
    for i in range(600):
        k, w = rng.choice(items)
        share, own = rng.uniform(0.05, 0.35), []
        for x in w:
            u = rng.random()
            own += [x] if u > share else [rng.choice(vocab)] if u > share / 3 else [x, x] if u > share / 6 else []
        index = {x: n for n, x in enumerate({*w, *own})}
        if slow_align([index[x] for x in w], [index[x] for x in own]) >= dc.LEAST * dc.MATCH * len(w):
            reach.append((i, k))
        docs.append((i, " ".join([*rng.choices(vocab, k=50), *own, *rng.choices(vocab, k=50)])))
    found = {(r.doc_id, r.item_id) for r in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()}
    assert len(reach) > 300 and sum(x in found for x in reach) >= 0.9 * len(reach)
