import random
import re
from collections import Counter

import pytest

from lodestrata.llm import phrases


def brute(rows, least, longest, most, share):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = []
    for (lang, w), a in found.items():
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        longer = [b for (other, v), b in found.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if not any(100 * b >= share * a for b in longer):
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own[:most])]
    return sorted(ranked)


WORDS = [*"abcdefg", "New", "YORK", "é", "日本", "É", "a'b", " x", "\x1cz"]


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randint(0, 25))
        out.append(("".join(w + rng.choice([" "] * 12 + ["  ", "\t ", ", ", ".", "\n", "\x0b", " ;", "\r\n"]) for w in words), rng.choice(["en", "en", "de", None, "und", ""])))
    return out + [(None, "en"), ("", None), (" \t.,", "de"), ("the same piece again, " * 40, "fr"), ("x" * 5000 + " y", "fr"), ("new york " * 3000, "en")] + [("twin piece here", "de")] * 9


@pytest.mark.parametrize(("least", "longest", "most", "share"), [(3, 5, 2000, 100), (2, 4, 7, 60), (6, 2, 2000, 100)])
def test_against_brute_force(spark, least, longest, most, share):
    rows = texts(least, 120)
    docs = spark.createDataFrame([(t, x, 1, 2, "p") for t, x in rows], "text string, lang string, n int, words int, phrase string").repartition(7)
    got = phrases.collocations(docs, least=least, longest=longest, most=most, share=share).collect()
    assert sorted(map(tuple, got)) == brute(rows, least, longest, most, share)
    assert got


def test_empty_and_nothing_frequent(spark):
    docs = spark.createDataFrame([("one two three", "en")], "text string, lang string")
    assert phrases.collocations(docs).count() == phrases.collocations(docs.limit(0)).count() == 0


def test_large_counts_are_exact(spark):
    n = 10**14
    found = spark.createDataFrame([("en", "a b", 2, n // 7), ("en", "a", 1, n // 3), ("en", "b", 1, n // 5)], "lang string, phrase string, words int, n long")
    r = phrases.cuts(found, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert r.score == 1000 * (n // 7) * n // ((n // 3) * (n // 5))


def test_pieces_become_multiplicities(spark):
    docs = spark.createDataFrame([("A b.\ta  B ,c", None)] * 3, "text string, lang string")
    assert sorted(map(tuple, phrases.pieces(docs).collect())) == [("und", "a b", 6), ("und", "c", 3)]
