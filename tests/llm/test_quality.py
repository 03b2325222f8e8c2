import random

import numpy as np
import pytest

from lodestrata.llm import quality

DOCS = "doc_id long, text string, source string, lang string, n_chars long, keep string, low_p string"


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("be", "ca", "do", "fi", "gu") for b in ("la", "mo", "ne", "ri", "su", "ta")]
    docs, labels, truth = [], [], {}
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        kind = rng.choice(["good"] * 6 + ["caps", "rep", "toxic", "toxic"])
        if kind == "caps":
            w = [x.upper() + "!!" for x in w]
        elif kind == "rep":
            w = [x for x in w[:9] for _ in range(8)]
        elif kind == "toxic":
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["blast", "fiend", "oaf"]))
        truth[i] = (int(kind in ("caps", "rep")), int(kind == "toxic"))
        docs.append((i, " ".join(w), f"h{i % 7}", rng.choice(["a", "b"]), 0, "k", "p"))
        if i % 2:
            labels.append((i, 1 - truth[i][0], truth[i][1]))
    return docs, labels, truth


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels, truth = corpus()
    odd = [(None, None, None, None, None, None, None), (5000, "", "new", "c", 0, "", ""), (5001, "bela " * 90_000, None, "a", 0, "", ""), docs[1], docs[1]]
    df = spark.createDataFrame(docs + odd, DOCS)
    ldf = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 1), (4000, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.classify(df, ldf).toPandas()
    assert len(out) == len(docs) + len(odd) and out.keep.notna().all() and out.low_p.between(0, 1).all()
    held = out[out.doc_id.isin([i for i in truth if i % 2 == 0])].set_index("doc_id")
    low = np.mean([(held.low_p[i] > 0.5) == truth[i][0] for i in held.index])
    toxic = np.mean([(held.toxic_p[i] > 0.5) == truth[i][1] for i in held.index])
    assert low > 0.97 and toxic > 0.97
    stays = quality.kept(df, ldf)
    assert stays.columns == df.columns
    names = stays.select("doc_id", "keep").toPandas()
    assert set(names.doc_id.dropna()) == set(out[out.keep].doc_id.dropna()) and set(names.keep.dropna()) <= {"k", ""}


def test_sites_shrink_towards_their_priors(spark):
    rows = [("big", "p", 2.0)] * 300 + [("big", "q", 2.0)] * 2 + [("small", "p", 2.0)] + [("clean", "p", -4.0)] * 300 + [("other", "p", -4.0)] * 40
    df = spark.createDataFrame([(h, p, x, x) for h, p, x in rows], "source string, lang string, __low double, __toxic double")
    got = {(r["__host"], r["__path"]): r for r in quality.sites(df).collect()}
    rate = 1 / (1 + np.exp(-2.0))
    mean = np.mean([1 / (1 + np.exp(-x)) for _, _, x in rows])
    assert mean < got["small", "p"].low_host < got["big", "p"].low_host < rate
    assert got["clean", "p"].low_host < mean and abs(got["big", "q"].low_path - got["big", "q"].low_host) < 0.05
    assert all(abs(r.low_shift) <= quality.MOST_SHIFT for r in got.values())
    by_hand = {}
    for h in ("big", "small", "clean", "other"):
        x = [1 / (1 + np.exp(-v)) for k, _, v in rows if k == h]
        by_hand[h] = (len(x), sum(x))
    n = sum(c for c, _ in by_hand.values())
    between = (sum(s * s / c for c, s in by_hand.values()) - n * mean**2 - mean * (1 - mean) * 3) / n
    k = max(mean * (1 - mean) / between - 1, 2.0)
    assert got["small", "p"].low_host == pytest.approx((by_hand["small"][1] + k * mean) / (1 + k))


def test_no_labels_and_no_rows(spark):
    docs, labels, _ = corpus(30)
    df = spark.createDataFrame(docs, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(df, none).where("keep").count() == 30
    assert quality.classify(df.limit(0), none).count() == 0 and quality.kept(df.limit(0), none).count() == 0


def test_held_out_labels_of_the_tables(spark):
    """Fitted on one half of the labels, read on the other."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    out = quality.classify(docs, labels.where(half)).join(labels.where(~half), "doc_id").toPandas()
    share = lambda rows: (~rows.keep).mean()
    assert share(out[out.quality == 0]) > 0.97 and share(out[(out.quality == 1) & (out.toxic == 1)]) > 0.93
    assert share(out[(out.quality == 1) & (out.toxic == 0)]) < 0.01


def test_copies_with_different_labels_count_as_the_worse(spark):
    docs = spark.createDataFrame([(i, f"same words {i // 2}", "h", "p", 0, "", "") for i in range(40)], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    first, second = (quality.fit(docs.orderBy(o), labels).beta.tolist() for o in ("doc_id", "text"))
    assert first == second
