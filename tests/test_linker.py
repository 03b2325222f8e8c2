import random

import pytest

from lodestrata.operators import linker

ENTITY = "id string, label string, aliases array<string>, tags array<string>"


def gazetteer(spark, rows, **how):
    return linker.gazetteer(spark.createDataFrame([(i, n, list(a), list(t)) for i, n, a, t in rows], ENTITY), **how)


def slow_spans(text, alias):
    word = set("abcdefghijklmnopqrstuvwxyz0123456789_")
    out, at = [], text.find(alias)
    while at >= 0:
        end = at + len(alias)
        if not (alias[0] in word and at > 0 and text[at - 1] in word) and not (alias[-1] in word and end < len(text) and text[end] in word):
            out.append((at, end))
        at = text.find(alias, end)
    return out


def slow_accepted(text, names):
    every = sorted(((s - e, s, ent, e, a) for a, ent in names for s, e in slow_spans(text, a)))
    out = []
    for _, s, ent, e, a in every:
        if all(e <= s2 or e2 <= s for s2, e2, *_ in out):
            out.append((s, e, a, ent))
    return sorted(out)


@pytest.mark.parametrize("most", [200_000, 0])
def test_spans_by_brute_force(spark, monkeypatch, most):
    """Whether aliases go to every task or meet the texts' words in a shuffle."""
    monkeypatch.setattr(linker, "MOST_BROADCAST", most)
    rng = random.Random(5)
    names = [("aaa", "e1"), ("aa b", "e2"), ("b.a", "e3"), ("aba", "e4"), ("é a", "e5"), ("a é", "e6"), ("中文", "e7"), ("文", "e8")]
    texts = [(f"t{i}", "".join(rng.choices("aab .é中文", k=rng.randint(1, 25)))) for i in range(300)]
    texts = [(i, " ".join(t.split())) for i, t in texts]
    table = spark.createDataFrame([(a, e, a, "label", 3) for a, e in names], "alias string, entity_id string, display string, source string, weight int")
    got = {}
    for r in linker.accepted(linker.spans(spark.createDataFrame(texts, "id string, text string"), table)).collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.alias, r.entity_id))
    for i, t in texts:
        assert sorted(got.get(i, [])) == slow_accepted(t, names), t


def test_a_catalogue_of_many_aliases(spark, monkeypatch):
    """Every word of the lines as an alias, most of them met in a shuffle: the same mentions as with all aliases in every task."""
    lines = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) as id", "text").where("text is not null")
    words = sorted({w.strip(".,").lower() for r in lines.collect() for w in r.text.split() if len(w) > 4})[:8000]
    names = spark.createDataFrame([(w, f"e{i}", w, "label", 3) for i, w in enumerate(words)], "alias string, entity_id string, display string, source string, weight int")
    want = sorted(map(tuple, linker.mentions(lines, names, most=50).collect()))
    monkeypatch.setattr(linker, "MOST_BROADCAST", 0)
    assert len(want) > 2000 and sorted(map(tuple, linker.mentions(lines, names, most=50).collect())) == want


def test_usable_surfaces(spark):
    rows = [("a", "ab", [], []), ("b", "the", [], []), ("c", "BMC", ["阈值", "阈", "x.json", "/usr/lib", ".env", "read me.md"], ["tagged"]), ("", "nobody", [], []), ("d", "y" * 81, [], []), ("e", "---", [], [])]
    assert {r.alias for r in gazetteer(spark, rows).collect()} == {"bmc", "阈值"}
    assert {r.alias for r in gazetteer(spark, rows, include_tags=True).collect()} == {"bmc", "阈值", "tagged"}
    assert {r.alias for r in gazetteer(spark, rows, include_aliases=False).collect()} == {"bmc"}


def test_winner_and_ambiguity(spark):
    got = {r.alias: r for r in gazetteer(spark, [("b", "Same", [], []), ("a", "x", ["same"], []), ("c", "other", [], ["same"])], include_tags=True).collect()}
    assert got["same"].entity_id == "b" and got["same"].entities == ["a", "b", "c"] and got["same"].display == "Same"


def mentions(spark, rows, texts, **how):
    return {(r.id, r.entity_id): r for r in linker.mentions(spark.createDataFrame(texts, "id string, text string"), gazetteer(spark, rows), **how).collect()}


def test_longest_wins_and_confidence(spark):
    rows = [("e1", "IPMI", [], []), ("e2", "IPMI over LAN", [], [])]
    got = mentions(spark, rows, [("t", "IPMI over  LAN and ipmi; ipmi"), ("u", "ipmitool"), ("v", "ipmi"), ("", "ipmi"), ("w", None)])
    assert {k for k in got} == {("t", "e1"), ("t", "e2"), ("v", "e1")}
    assert got["t", "e1"].occurrences == 2 and got["t", "e1"].confidence == "high" and got["t", "e2"].confidence == "medium" and got["t", "e1"].position == 18
    assert len(mentions(spark, rows, [("t", "IPMI over LAN ipmi")], most=1)) == 1


def test_rollup_links_and_preview(spark):
    rows = [("e1", "alpha", [], []), ("e2", "beta", ["beta two"], [])]
    texts = [("c1", "alpha"), ("c2", "alpha alpha beta"), ("c3", "beta two"), ("c4", "alpha beta")]
    found = linker.mentions(spark.createDataFrame(texts, "id string, text string"), gazetteer(spark, rows))
    docs = spark.createDataFrame([("d1", "c1", 0), ("d1", "c2", 1), ("d2", "c3", 0), ("d3", "c4", 0)], "document_id string, id string, seq int")
    rolled = linker.rollup(found, docs)
    got = {(r.document_id, r.entity_id): r for r in rolled.collect()}
    assert (got["d1", "e1"].occurrences, got["d1", "e1"].chunks, got["d1", "e1"].confidence, got["d1", "e1"].evidence) == (3, 2, "high", ["c1", "c2"])
    entities = spark.createDataFrame([(i, n) for i, n, *_ in rows], "id string, label string")
    links = {(r.source_id, r.other_id): r for r in linker.document_links(rolled, entities).collect()}
    assert links["d1", "d3"].shared == 2 and links["d1", "d3"].entity_labels == ["alpha", "beta"] and links["d1", "d2"].entity_ids == ["e2"]
    assert linker.document_links(rolled, entities, entity_ids=[]).count() == 0
    assert {(r.source_id, r.other_id) for r in linker.document_links(rolled, entities, document_id="d2").collect()} == {("d1", "d2"), ("d2", "d3")}
    assert linker.document_links(rolled, entities, entity_ids=["e1"]).count() == 1
    plan = linker.planned_links(rolled, gazetteer(spark, rows)).collect()
    assert (plan[0].source_id, plan[0].other_id, plan[0].entity_labels) == ("d1", "d3", ["alpha", "beta two"])


def test_pruning(spark):
    names = gazetteer(spark, [("e1", "common", [], []), ("e2", "rare", [], [])])
    texts = spark.createDataFrame([(f"t{i}", "uncommon words" if i % 2 else "rare" if i == 0 else "x") for i in range(40)], "id string, text string")
    assert {r.alias for r in linker.pruned(names, texts).collect()} == {"rare"}
    assert linker.pruned(names, texts.limit(10)).count() == 2


def test_many_wordless_aliases_take_another_way(spark, monkeypatch):
    monkeypatch.setattr(linker, "MOST_WORDLESS", 0)
    names = gazetteer(spark, [("e1", "阈值", [], []), ("e2", "é x", [], [])])
    got = linker.mentions(spark.createDataFrame([("t", "电阈值 é x"), ("u", "值")], "id string, text string"), names).collect()
    assert {(r.id, r.entity_id) for r in got} == {("t", "e1"), ("t", "e2")}


def test_many_spans_of_one_text(spark):
    """A hundred thousand overlapping spans take seconds, since each is compared with one neighbour."""
    n = 100_000
    rows = spark.range(n).selectExpr("'t' as id", "int(id * 2) as start", "int(id * 2 + 1 + id % 4) as end", "'a' as alias", "'e' as entity_id", "'A' as display", "'label' as source", "3 as weight")
    got = sorted((r.start, r.end) for r in linker.accepted(rows).select("start", "end").collect())
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False)) and {(6, 10), (14, 18)} <= set(got) and len(got) > n // 3


def test_first_pairs_without_joining_on_what_all_share(spark):
    """One entity in a third of the documents: the first pairs are those of the full join, and few pairs are formed for them."""
    rng = random.Random(9)
    sets = {f"d{i:04d}": {f"e{rng.randrange(400)}" for _ in range(5)} | ({"hot"} if i % 3 == 0 else set()) for i in range(600)}
    for i in range(0, 60, 2):  # pairs that share much
        sets[f"d{i + 1:04d}"] |= set(list(sets[f"d{i:04d}"])[: 2 + i % 3])
    rolled = spark.createDataFrame([(d, e) for d, s in sets.items() for e in s], "document_id string, entity_id string")
    names = sorted(sets)
    full = sorted((-len(sets[a] & sets[b]), a, b) for k, a in enumerate(names) for b in names[k + 1 :] if sets[a] & sets[b])
    for limit in (1, 8, 40):
        got = [(-r.shared, r.source_id, r.other_id) for r in linker.document_pairs(rolled, limit).collect()]
        assert got == full[:limit]
    classes = spark.createDataFrame([(k, 1, sorted((sum(e in s for s in sets.values()), e) for e in sets[d])) for k, d in enumerate(names)], "class long, n long, ranked array<struct<df:long,e:string>>")
    formed = linker._overlaps(classes, 2).count()
    assert formed < 200 * 199 / 2 / 4 and linker._overlaps(classes, 1).where("ca <> cb").count() == len(full)
    assert linker.document_pairs(rolled, None).count() == len(full)


@pytest.mark.parametrize("most", [200_000, 0])
def test_aliases_are_met_on_more_than_their_first_word(spark, monkeypatch, most):
    """Of aliases that share a frequent first word, a text meets those whose first words it has."""
    monkeypatch.setattr(linker, "MOST_BROADCAST", most)
    names = spark.createDataFrame([(f"the n{i} end{j}", f"e{i}.{j}") for i in range(20) for j in range(3)] + [("the", "e"), ("the n5", "f"), ("the n5 end1 more words", "g")], "alias string, entity_id string")
    texts = spark.createDataFrame([("a", "see the n5 end1 and the n5 end1"), ("b", "the n5 end12"), ("c", "end1 the"), ("d", "the")], "id string, h string")
    got = sorted((r.id, r.alias) for r in linker.candidates(texts, names).collect())
    assert got == [("a", "the"), ("a", "the n5"), ("a", "the n5 end1"), ("b", "the"), ("b", "the n5"), ("c", "the"), ("d", "the")]


def test_only_words_that_may_begin_an_alias_are_shuffled(spark, monkeypatch, request):
    """Each word of the texts begins aliases, but few sequences of words are those of one; the shuffle has little more than these."""
    monkeypatch.setattr(linker, "MOST_BROADCAST", 0)
    for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(c, -1)
        request.addfinalizer(lambda c=c: spark.conf.unset(c))
    names = spark.range(400).selectExpr("concat('w', id % 20, ' v', id, ' end') as alias", "concat('e', id) as entity_id")
    words = "concat_ws(' ', transform(sequence(1, 200), i -> concat('w', (id * 7 + i * 11) % 20)))"
    texts = linker.written(spark.range(2000).selectExpr("format_string('t%04d', id) as id", f"if(id % 100 = 0, concat({words}, ' w3 v23 end'), {words}) as h"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    began = written()
    got = sorted(tuple(r) for r in linker.candidates(texts, names).select("id", "alias").collect())
    assert got == [(f"t{i:04d}", "w3 v23 end") for i in range(0, 2000, 100)]
    assert written() - began < 120_000  # of 400,000 words
