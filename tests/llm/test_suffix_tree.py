import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestrata.llm import suffix_tree as st
from lodestrata.llm.queries import op2_lm_scoring

SF = "/root/testdata/sf0.001"
BEGIN, END = "\x01begin", "\x01end"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


class Plain:
    """The tree, by dictionaries."""

    def __init__(self, texts, depth=st.DEPTH, price=st.PRICE):
        least_context, least_next = st.LEAST_CONTEXT, st.LEAST_NEXT
        framed = [[BEGIN, *words(t), END] for t in texts]
        self.words = Counter(w for t in framed for w in t[1:])
        self.n = sum(self.words.values())
        times = Counter(self.words.values())
        self.discount = min(0.9, max(0.1, times[1] / (times[1] + 2 * times[2]))) if times[1] else 0.5
        letters = Counter(b for t in framed for w in t[1:-1] for b in w.encode())
        whole = sum(letters.values()) + 256 + self.n + 1
        self.letter = lambda b: math.log10((letters[b] + 1) / whole)
        self.stop = math.log10((self.n + 1) / whole)
        self.depth, self.own, self.bow = depth, {}, {}
        for d in range(1, depth + 1):
            grams = Counter(tuple(t[i : i + d + 1]) for t in framed for i in range(len(t) - d))
            contexts = Counter(tuple(t[i : i + d]) for t in framed for i in range(len(t) - d))
            after = defaultdict(dict)
            for g, n in grams.items():
                if n >= least_next and contexts[g[:-1]] >= least_context:
                    after[g[:-1]][g[-1]] = n
            for c, nexts in after.items():
                total, stored, kinds = contexts[c], sum(nexts.values()), len(nexts)
                below = {w: 10 ** self.log10(c[1:], w) for w in nexts}
                gain = sum(n * math.log(n / total / below[w]) for w, n in nexts.items())
                if total > stored:
                    gain += (total - stored) * math.log((total - stored) / total / max(1 - sum(below.values()), 1e-12))
                if gain > price * (kinds + 1):
                    self.bow[c] = (total - stored + kinds) / (total + kinds)
                    for w, n in nexts.items():
                        self.own[*c, w] = n / (total + kinds)

    def log10(self, context, w):
        n = self.words[w]
        byte = self.stop + (0 if w == END else sum(map(self.letter, w.encode())))
        if not self.n:
            return byte
        p = (n - self.discount) / self.n if n else 10**byte * self.discount * len(self.words) / self.n
        for d in range(1, len(context) + 1):
            c = tuple(context[-d:])
            if c in self.bow:
                p = self.own.get((*c, w), 0.0) + self.bow[c] * p
        return math.log10(p)

    def score(self, text):
        t = [BEGIN, *words(text), END]
        return sum(self.log10(t[max(0, i - self.depth) : i], t[i]) for i in range(1, len(t)))


@pytest.fixture
def low(monkeypatch):
    """Counts that small tables reach."""
    monkeypatch.setattr(st, "LEAST_CONTEXT", 60)
    monkeypatch.setattr(st, "LEAST_NEXT", 8)


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_contract_by_brute_force(spark, low):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs}
    plain = Plain([r.text for r in docs if not held[r.doc_id]])
    n, v = plain.n, len(plain.words)
    out = op2_lm_scoring(spark, SF).toPandas().set_index("doc_id")
    assert len(out) == len(docs) and len(plain.bow) > 20
    for r in docs:
        own = [*words(r.text), END]
        row = out.loc[r.doc_id]
        assert row.held_out == held[r.doc_id] and row.n_tokens == len(own) and row.train_tokens == n
        assert row.n_known == sum(plain.words[w] > 0 for w in own)
        assert row.base_score == pytest.approx(sum(math.log10((plain.words[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert row.score == pytest.approx(plain.score(r.text), rel=1e-5)


def toy():
    rng = np.random.default_rng(3)
    return [" ".join(rng.choice(list("abcdefgh"), 60, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.04, 0.01])) + f" rare{i} once{i % 7}" for i in range(40)] + ["a b c a b d " * 40, None]


@pytest.mark.parametrize("hot_rows", [None, 12, 0])
def test_rows_of_the_tree_that_workers_lack_are_joined(spark, low, hot_rows):
    """The same scores, however many rows every worker has."""
    texts, asked = toy(), [*toy()[:5], "", "a b c zzz a b é", "unseen a b c a", "h g rare1 f once3 " * 9]
    plain = Plain(texts)
    tree = st.train(frame(spark, texts), hot_rows=hot_rows)
    assert (tree.cold is not None) == (hot_rows is not None)
    got = {r.doc_id: r for r in st.score(frame(spark, asked), tree).collect()}
    for i, t in enumerate(asked):
        assert got[i].score == pytest.approx(plain.score(t), rel=1e-5) and got[i].n_known == sum(plain.words[w] > 0 for w in [*words(t), END])


def test_probabilities_sum_to_one_at_most(low):
    texts = toy()
    plain = Plain(texts)
    assert len(plain.bow) > 3
    fresh = [chr(97 + i) + chr(97 + j) for i in range(26) for j in range(26)] + list("ijklmnopqrstuvwxyz")
    every = [*plain.words, *(w for w in fresh if w not in plain.words)]
    for context in ([], ["a"], ["a", "b"], ["c", "a", "b"], ["never", "a"], ["b", "a", "rare1"]):
        assert 0.8 < sum(10 ** plain.log10([BEGIN, *context][-3:], w) for w in every) <= 1 + 1e-9


def test_gibberish_scores_below_real_text(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r.text and len(r.text) > 600]
    rng = np.random.default_rng(1)
    own = words(docs[0])[:100]
    odd = ["".join(rng.choice(list("qxzjkvwy"), 6)) for _ in own]
    tree = st.train(frame(spark, docs[1:]))
    real, gibberish, known = (r.score for r in st.score(frame(spark, [" ".join(own), " ".join(odd), " ".join(sorted(own))]), tree).orderBy("doc_id").collect())
    assert gibberish < 2 * real and known < 0


def test_the_tree_grows_with_the_corpus(spark, low):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few, all_ = (st.train(d).facts.agg({"own": "count", "bow": "count"}).first() for d in (docs.where("doc_id % 4 = 0"), docs))
    assert all_["count(own)"] > 2 * few["count(own)"] and all_["count(bow)"] > 2 * few["count(bow)"]


def test_contexts_are_kept_where_they_tell_something(spark, low):
    plain = Plain(["x a y b " * 40, "y a x b " * 40] * 5)
    assert ("a",) in plain.bow and 10 ** plain.log10(["x", "a"], "y") > 0.9 > 0.1 > 10 ** plain.log10(["x", "a"], "x")
    tree = st.train(frame(spark, [" ".join(np.random.default_rng(i).choice(list("abcd"), 300)) for i in range(20)]))
    assert tree.facts.where("bow is not null").count() <= 3


def test_odd_rows(spark):
    tree = st.train(spark.createDataFrame([(None,), ("",), ("a b",), ("a b",), ("B a",)], "text string"))
    rows = [(1, None, "x"), (None, "a b", "x"), (2, "", "x"), (2, "", "x"), (3, "zz " * 200_000, "x"), (4, "É\x00 b", "x")]
    clash = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score string, __row int, n_known int")
    out = st.score(clash, tree).collect()
    n = {r.doc_id: r.n_tokens for r in out}
    assert len(out) == 6 and n[1] == 1 and n[None] == 3 and n[3] == 200_001 and n[4] == 3 and all(r.score < 0 for r in out)
    assert st.score(spark.createDataFrame([], "doc_id long, text string"), tree).count() == 0
    empty = st.train(spark.createDataFrame([], "text string"))
    got = st.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), empty).first()
    assert got.n_known == 0 and got.score < 0


def test_rare_rows_cost_what_they_are_asked_for(spark, low, monkeypatch):
    """Where workers have all contexts, a token sends the keys that it lacks and their weights, not all that is known of it; the scores are those of the whole tree."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 4 = 0")
    all_ = st.train(docs)
    tree = st.train(docs, hot_rows=2 * all_.facts.where("bow is not null").count())
    kept, real = [], st.written
    monkeypatch.setattr(st, "written", lambda df: kept.append(real(df)) or kept[-1])
    got = {r.doc_id: r for r in st.score(docs, tree).collect()}
    for r in st.score(docs, all_).collect():
        assert got[r.doc_id].n_known == r.n_known and got[r.doc_id].score == pytest.approx(r.score, rel=1e-5)
    sizes = kept[0].selectExpr(*[f"sum(size({c})) as {c}" for c in ("open", "asks") if c in kept[0].columns]).first().asDict()
    assert not sizes.get("open", 0)
    assert 0 < sizes["asks"] < sum(r.n_tokens for r in got.values())
