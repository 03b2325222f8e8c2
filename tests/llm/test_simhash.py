import math
import random

import numpy as np
import pytest

from lodestrata.llm import simhash


def slow_fingerprint(text, k=4):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, radius):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius and find(i) != find(j):
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


def test_documents_against_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=120)) for _ in range(15)]
    texts = [None, "", " \t", "One", "one", "ONE two three", "É É"]
    for b in base:
        w = b.split()
        texts += [b, b.upper(), b.replace(" ", "\n"), *(" ".join([*w[:i], "odd", *w[i + 1 :]]) for i in rng.sample(range(120), 12))]
    texts.append("long " * 80_000)
    rows = [(i if i != 9 else None, t, "x") for i, t in enumerate(texts)] + [(3, "One", "x")] * 2
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    want = sorted(map(repr, zip([r[0] for r in rows], fps, slow_components([r[0] for r in rows], fps, 4), strict=True)))
    assert sorted(repr((r.doc_id, r.fp % (1 << 64), r.component_id)) for r in got) == want


@pytest.mark.parametrize(("radius", "segments", "small"), [(4, 3, 32), (4, 3, 2), (4, 2, 3), (3, 4, 32), (7, 3, 4)])
def test_links_connect_what_chains_connect(spark, monkeypatch, radius, segments, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(radius * 7 + segments)
    fps = {rng.getrandbits(64) for _ in range(120)} | {0, (1 << 64) - 1, 1 << 63}
    for _ in range(250):
        x = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.randint(1, radius + 2)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    from lodestrata.llm.common import components

    root = {r.node: r.root for r in components(simhash.links(df, radius, segments)).collect()}
    slow = slow_components(list(range(len(fps))), fps, radius)
    group = {}
    for x, c in zip(signed, slow, strict=True):
        group.setdefault(c, set()).add(root.get(x, x))
    assert all(len(g) == 1 for g in group.values()) and len({min(g) for g in group.values()}) == len(group)


def test_near_deduped(spark):
    rows = [(5, "a b c d e", "k"), (2, "A b c d e", "k"), (9, "other words stand here now", "k"), (None, "a b c d e", "k"), (2, "A b c d e", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = simhash.near_deduped(df)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 2), (False, 2), (False, 9), (True, 0)] and out.columns == df.columns
    assert simhash.near_deduped(df.limit(0)).count() == 0 and simhash.groups(df.limit(0)).count() == 0


def shingles(text, n=5):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def jaccard_groups(texts, similar=0.8):
    """For each text the first of its group, by comparing all sets that share a shingle."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s or [None]:
            where.setdefault(x, []).append(i)
    pairs = {(a, b) for own in where.values() for k, b in enumerate(own) for a in own[:k]}
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])]
    for a, b in near:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(texts))], near


def test_near_copies_against_brute_force(spark, monkeypatch):
    """All groups of the small table, and those of a table with a large group of edited copies, whether entries are compared member by member or by chains."""
    rng = random.Random(5)
    base = [" ".join(rng.choices([f"w{i}" for i in range(900)], k=150)) for _ in range(12)]
    made = [None, "", " ", "one", "One", "two words", "two  words", *base]
    for b in base:
        w = b.split()
        for edits in (1, 1, 2, 3, 4, 5, 8, 12):
            made.append(" ".join("odd" if i in set(rng.sample(range(150), edits)) else x for i, x in enumerate(w)))
    w = base[0].split()
    made += [" ".join(x if i != k else f"n{j}" for i, x in enumerate(w)) for j, k in enumerate(rng.choices(range(150), k=60))]
    made.append("long " * 80_000)
    small = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    for texts, members in ((small, 512), (made, 512), (made, 8)):
        monkeypatch.setattr(simhash, "MEMBERS", members)
        docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "id long, text string, f0 string, key int")
        got = simhash.without_near_copies(docs, "id")
        assert got.columns == docs.columns
        left, want = {r.id for r in got.collect()}, set(jaccard_groups(texts)[0])
        assert want <= left and len(left - want) <= (0 if members == 512 else 0.03 * len(texts)), (members, left - want)
    assert simhash.without_near_copies(docs.limit(0), "id").count() == 0


def test_recall_of_near_copies(spark):
    """Of the pairs at 0.8 or more that brute force finds in a table of 1,000 documents, those that are in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").orderBy("doc_id").collect()
    want, near = jaccard_groups([r.text for r in docs])
    assert len(near) > 20
    left = {r.doc_id for r in simhash.without_near_copies(spark.createDataFrame(docs).withColumnRenamed("key", "k"), "doc_id").collect()}
    removed = {i for i, w in enumerate(want) if w != i}
    assert sum(docs[i].doc_id not in left for i in removed) >= 0.97 * len(removed)
    assert all(docs[i].doc_id in left for i in set(range(len(docs))) - removed)


def test_plans_follow_the_size():
    widths = []
    for n in (10, 10**5, 10**6, 10**8, 10**10):
        width, ball, tables, parts = simhash.plan(n)
        p = simhash.flips(simhash.SIMILAR)
        meet = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(ball + 1))
        assert tables <= parts * (64 // width) and 1 - (1 - meet) ** tables >= simhash.RECALL
        assert n > 10**6 or n * sum(math.comb(width, k) for k in range(ball + 1)) / 2**width <= simhash.MEMBERS
        widths.append(width)
    assert widths == sorted(widths) and widths[0] < widths[-1]
    assert simhash.segments_for(1000) >= 3 > simhash.segments_for(10**9)


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_any_number_of_segments_finds_the_same(spark, segments):
    docs = spark.createDataFrame([(i, f"a b c d e f g {i % 9} h i j k l m n {i // 9} o p q r s t u v w x y z") for i in range(60)], "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in simhash.groups(docs, segments=3).collect()}
    assert {r.doc_id: r.component_id for r in simhash.groups(docs, segments=segments).collect()} == want


def test_hot_keys_are_joined_without_a_shuffle(spark):
    from lodestrata.llm.common import joined_hot

    rows = spark.createDataFrame([(i, 1 if i < 900 else i) for i in range(1000)] + [(5, None)], "id long, k long")
    values = spark.createDataFrame([(1, 900, "hot")] + [(i, 1, f"v{i}") for i in range(900, 1000)], "k long, n long, v string")
    for share in (0.001, 0.5, 1.0):
        got = {r.id: r.v for r in joined_hot(rows, values, "k", share).collect()}
        assert got == {i: "hot" if i < 900 else f"v{i}" for i in range(1000)}


def test_no_bound_on_an_entry_loses_a_copy(spark, monkeypatch):
    """Whatever is compared first, how many members a task compares and how many candidates one has at once, the groups are those of brute force; first candidates grow with the members."""
    rng = random.Random(11)
    w = [f"w{i}" for i in range(240)]
    near = [" ".join(f"n{rng.randrange(9)}" if i in set(rng.sample(range(240), n)) else x for i, x in enumerate(w)) for n in [4, 5, 7, 9, 11, 13] * 12]
    far = [" ".join(f"f{j}" if i % 24 == 0 else x for i, x in enumerate(w)) for j in range(30)]  # at half similarity: near by their first bits at times, never copies
    texts = [*near, *far, *(" ".join(rng.choices(w, k=100)) for _ in range(20))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    want, pairs = jaccard_groups(texts)
    seen = []
    whole = simhash.candidates
    monkeypatch.setattr(simhash, "candidates", lambda nodes, chosen, similar: seen.append((whole(nodes, chosen, similar).count(), nodes.count(), chosen[2])) or whole(nodes, chosen, similar))
    for members, part, nearest in ((1, 4096, 1), (2, 16, 4)):
        monkeypatch.setattr(simhash, "MEMBERS", members)
        monkeypatch.setattr(simhash, "PART", part, raising=False)
        monkeypatch.setattr(simhash, "NEAREST", nearest)
        left = {r.id for r in simhash.without_near_copies(docs, "id").collect()}
        assert left == set(want), (members, len(left), len(set(want)))
    assert len(pairs) > 40 and all(made <= nodes * tables for made, nodes, tables in seen)


def test_a_family_of_borderline_texts_gives_no_pairs(spark, monkeypatch):
    """Texts that are near by fingerprint and not by sets: no kept table grows with their pairs, and the groups are those of brute force, whether a family is dealt out or not."""
    rng = random.Random(3)
    w = [f"w{i}" for i in range(240)]
    texts = [" ".join(f"n{j}" if i in places else x for i, x in enumerate(w)) for j in range(150) for places in [set(rng.sample(range(2, 240, 6), 4))]]
    texts += [t.replace("w0 ", "v ") for t in texts[:9]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want, pairs = jaccard_groups(texts)
    seen, whole = [], simhash.durable
    monkeypatch.setattr(simhash, "durable", lambda rows: seen.append(whole(rows)) or seen[-1])
    for shingles_of_a_part in (1 << 20, 9000):
        monkeypatch.setattr(simhash, "PART_SHINGLES", shingles_of_a_part, raising=False)
        assert {r.id for r in simhash.without_near_copies(docs, "id").collect()} == set(want)
        assert max(rows.count() for rows in seen) <= len(texts) * simhash.plan(len(texts))[2]
        seen.clear()
    assert len(pairs) >= 9 and len(set(want)) > 100


def test_rounds_of_components_have_tasks_by_their_edges(spark):
    from lodestrata.llm import common

    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = common.components(spark.createDataFrame([(k + 1, k) for k in range(300) if k % 10 != 9], "a long, b long"))
        assert got.select("node").distinct().count() == 300
        assert {(r.node // 10 * 10, r.root) for r in got.collect()} == {(k, k) for k in range(0, 300, 10)}
        assert got.inputFiles() == [] and got.where("node <> root").rdd.getNumPartitions() <= common.TASKS + 64  # roots are made distinct by one more shuffle
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
