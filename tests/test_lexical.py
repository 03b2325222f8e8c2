import random
import sqlite3

from pyspark.sql import functions as F

from lodestrata.functions import scope, text
from lodestrata.operators import lexical
from lodestrata.operators.lexical import Request

UNIT = "id string, summary string, resolution string, tags array<string>, source_refs array<string>, status string, memory_kind string, evidence_json string, session_id string, workspace_id string, repo_id string, updated_at string"


def unit(i, summary, resolution="", tags=(), *, status="active", kind="memory", evidence='[{"id": "x"}]', session="", workspace="", repo="", at="2026-01-01"):
    return (i, summary, resolution, list(tags), [], status, kind, evidence, session, workspace, repo, at)


def search(spark, rows, query, **how):
    return [(r.id, r.scope, r.score) for r in lexical.search(spark.createDataFrame(rows, UNIT), Request(query, **how)).orderBy("pos").collect()]


def ids(*args, **how):
    return [i for i, *_ in search(*args, **how)]


def test_bm25_equals_the_full_text_engine(spark):
    rng = random.Random(7)
    words = ["pad", "Étion", "café", "i2c", "foo_bar", "r:1", "the", "naïve", "alpha", "beta-gamma"]
    rows = [unit(f"u{i}", " ".join(rng.choices(words, k=rng.randint(1, 6))), " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.sample(words, 2)) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, a, b, c, d)")
    db.executemany("insert into t values (?, ?, ?, ?, '')", [(r[0], r[1], r[2], " ".join(r[3])) for r in rows])
    df = lexical.indexed(spark.createDataFrame(rows, UNIT))
    for query in ("pad alpha", "pad pad", "foo_bar", "i2c r:1 the", "beta-gamma naive cafe", "nothing"):
        phrases = text.terms(query)
        match = " OR ".join(f'"{p}"' for p in phrases)
        want = {i: s for i, s in db.execute("select id, bm25(t) from t where t match ?", (match,))}
        got = {r.id: r.bm25 for r in lexical.bm25(df, [text.query_tokens(p) for p in phrases]).collect()}
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_hidden_units_still_count_in_statistics_but_never_show(spark):
    rows = [unit("a", "pad one"), unit("b", "pad two", status="draft", kind="candidate"), unit("c", "pad three", evidence="[]"), unit("d", "pad four", kind="raw")]
    assert ids(spark, rows, "pad") == ["a"]


def test_sessions(spark):
    rows = [unit("a", "pad x", session="s1"), unit("b", "pad x", session="s2"), unit("c", "pad x")]
    assert ids(spark, rows, "pad", session_id="s2")[0] == "b" and len(ids(spark, rows, "pad", session_id="s2")) == 3
    assert ids(spark, rows, "pad", session_id="s2", session_scope="strict") == ["b"]
    assert ids(spark, rows, "pad", session_scope="strict") == ["c"]


def test_workspaces(spark):
    uri = "file:///work/some-project/"
    digest = scope.digest("some-project")
    rows = [unit("a", "pad x", workspace=digest), unit("b", "pad x", workspace=f"{digest}-2"), unit("c", "pad x", workspace="elsewhere"), unit("d", "pad x"), unit("e", "pad x", workspace="some-project")]
    assert set(ids(spark, rows, "pad", workspaces=(uri,), scope_fallback="off")) == {"a", "b", "d", "e"}
    found = search(spark, rows, "pad", workspaces=(uri,))
    assert [i for i, s, _ in found if s == "wider"] == ["c"] and found[-1][0] == "c"
    report = lambda **how: lexical.scope_report(spark.createDataFrame(rows, UNIT), Request("pad", **how)).first()
    assert tuple(report(workspaces=(uri,))) == ("all+any", "mixed", 1)
    assert tuple(report()) == ("all+any", "global", 0)
    only = [unit("c", "pad x", workspace="elsewhere")]
    assert tuple(lexical.scope_report(spark.createDataFrame(only, UNIT), Request("pad", workspaces=("w",))).first()) == ("none", "relaxed", 1)
    assert tuple(lexical.scope_report(spark.createDataFrame(only, UNIT), Request("none-such", workspaces=("w",))).first()) == ("none", "exact", 0)


def test_repositories(spark):
    rows = [unit("a", "pad x", repo="r1"), unit("b", "pad x", repo="r2"), unit("c", "pad x")]
    assert set(ids(spark, rows, "pad", repo_id="r1")) == {"a", "c"} and len(ids(spark, rows, "pad")) == 3


def test_cjk(spark):
    rows = [unit("a", "电压阈值检测"), unit("b", "阈，值 相关"), unit("c", "pad voltage 阈 x 值"), unit("d", "pad")]
    assert set(ids(spark, rows, "阈值")) == {"a", "b"}
    assert ids(spark, rows, "温度") == []
    assert set(ids(spark, rows, "pad 阈值")) == {"a", "b", "c", "d"}


def test_all_beats_any_and_quota_defers(spark):
    rows = [unit("a", "alpha beta"), unit("b", "alpha"), unit("c", "gamma")]
    assert ids(spark, rows, "alpha beta") == ["a", "b"]
    pages = [unit(f"p{i}", f"one.pdf - page {i}", "alpha") for i in range(4)] + [unit(f"q{i}", f"two.pdf - page {i}", "alpha") for i in range(2)]
    got = ids(spark, pages, "alpha", per_document_limit=2)
    assert got[:4] == ["p0", "p1", "q0", "q1"] and got[4:] == ["p2", "p3"]
    assert ids(spark, pages, "alpha", per_document_limit=0, limit=3) == ["p0", "p1", "p2"]


def test_page_boost(spark):
    rows = [unit("a", "alpha alpha alpha"), unit("b", "x.pdf - page 3", "alpha and many other words in a longer text")]
    assert ids(spark, rows, "alpha") == ["b", "a"] and ids(spark, rows, "alpha", page_boost=0) == ["a", "b"]


def test_requests_without_terms_and_empty_store(spark):
    rows = [unit("a", "alpha")]
    assert ids(spark, rows, "!!!") == [] and ids(spark, rows, "_") == []
    assert search(spark, [], "alpha") == []


def test_scope_helpers():
    names = scope.aliases("file:///a/b/")
    assert names[:2] == ["file:///a/b/", scope.digest("file:///a/b/")] and {"/a/b", "b", scope.digest("b")} <= set(names)
    assert scope.canonical_workspace(scope.digest("x")) == scope.digest("x") and scope.canonical_workspace(" x ") == scope.digest("x") and scope.canonical_workspace("") == ""
    assert not scope.is_digest("a" * 32)


def test_get_many_keeps_order_and_repeats(spark):
    df = spark.createDataFrame([unit("a", "x"), unit("b", "y", status="draft")], UNIT)
    assert [r.id for r in lexical.get_many(df, ["b", "zz", "a", "b"]).collect()] == ["b", "a", "b"]
    assert [r.id for r in lexical.get_many(df, ["b", "a"], searchable_only=True).collect()] == ["a"]


def test_normalisation(spark):
    import unicodedata

    rng = random.Random(3)
    texts = ["ＢＭＣ  Straße", "ẞ", "a b", "ﬁn", " x ", None, "", "É́", "İ", "ǅ", *("".join(chr(rng.choice([*range(32, 127), *range(160, 592), 0x4E2D, 0xFF21])) for _ in range(20)) for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", text.normalized(F.col("t")).alias("n")).collect():
        assert r.n == " ".join(unicodedata.normalize("NFKC", r.t or "").casefold().split()) == text.normalize(r.t)


def test_an_index_answers_like_the_table(spark, tmp_path):
    """Phrases that overlap themselves, repeated terms, CJK runs, hidden units and scopes."""
    rng = random.Random(9)
    words = ["pad", "aa", "aa", "foo_bar", "café", "r:1", "风扇阈值", "阈值", "beta"]
    rows = [unit(f"u{i}", " ".join(rng.choices(words, k=rng.randint(0, 5))), " ".join(rng.choices(words, k=rng.randint(0, 15))), rng.sample(words, 2), status=rng.choice(["active", "active", "draft"]), session=f"s{i % 3}", workspace=rng.choice(["", "w", "v"])) for i in range(80)]
    table = spark.createDataFrame(rows, UNIT)
    index = lexical.build_index(table, str(tmp_path / "index"))
    key = lambda r: r.id
    for query in ("pad", "aa.aa pad", "aa aa", "foo_bar cafe", "风扇", "pad 阈值 beta", "nothing", "", "!!"):
        phrases = [p for p in (text.query_tokens(t) for t in text.terms(query)) if p]
        if phrases:
            want = sorted(lexical.scored(table, "text", phrases).collect(), key=key)
            assert sorted(lexical.scored(index, "text", phrases).select(*want[0].__fields__ if want else ["id"]).collect(), key=key) == want
        for how in ({}, {"workspaces": ("w",)}, {"session_id": "s1", "session_scope": "strict"}):
            request = Request(query, limit=20, **how)
            assert lexical.search(index, request).collect() == lexical.search(table, request).collect()
            assert lexical.scope_report(index, request).collect() == lexical.scope_report(table, request).collect()


def test_blocks_that_cannot_answer_are_left_out(spark, tmp_path, monkeypatch):
    """Small blocks, so that most are left out: the same rows as full scoring, for rare, hot, repeated, unknown and hidden words, phrases and scopes."""
    monkeypatch.setattr(lexical, "BLOCK_BITS", 2)
    monkeypatch.setattr(lexical, "FIRST", 16)
    rng = random.Random(4)
    shares = {"the": 0.45, "pad": 0.3, "fan": 0.1, "foo_bar": 0.05, "阈值": 0.05, "rare": 0.02}
    pool = lambda most: " ".join(w for w, p in shares.items() if rng.random() < p for _ in range(rng.randint(1, 3))) + " x" * rng.randint(0, most)
    rows = [unit(f"u{i:04}", pool(4), "y" * (i % 2), status=rng.choice(["active", "active", "draft"]), workspace=rng.choice(["", "w", "v", "v"]), at=f"2026-01-0{rng.randint(1, 9)}") for i in range(1500)]
    table = spark.createDataFrame(rows, UNIT).cache()
    index = lexical.build_index(table, str(tmp_path / "index"))
    saved, blocks = [], index.blocks.cache()
    hows = ({}, {"workspaces": ("w",)}, {"workspaces": ("none",), "scope_fallback": "off"})
    for k, query in enumerate(("the", "fan", "the pad fan rare", "pad pad the", "rare the foo_bar", "the nothing")):
        for how in hows[: 2 if k == 2 else 1] if k % 3 else hows[k // 3 :][:1]:
            request = Request(query, limit=8, per_document_limit=None, **how)
            want = sorted(map(tuple, lexical.ranked(table, request).collect()))
            assert sorted(map(tuple, lexical.ranked(index, request).collect())) == want, (query, how)
        asked = [p[0] for p in (text.query_tokens(t) for t in text.terms(query)) if len(p) == 1]
        to = lexical.reach(index, "text", asked, Request(query, limit=8), True, True)
        units = {r.term: r.units for r in blocks.where("channel = 'text'").groupBy("term").agg(F.sum("units").alias("units")).collect()}
        read = sum(units[t] for t in to.whole) + (to.chosen.agg(F.sum("units")).first()[0] or 0)
        saved += [query] * (read < 0.5 * sum(units.get(t, 0) for t in set(asked)))
    assert "the pad fan rare" in saved  # hot words alone, or a rare one with fewer units than are asked for, may need all blocks


def test_units_of_a_term_are_counted_through_commits(spark, tmp_path):
    """Segments of changes, with and without merges: every term's units are those that have it now, every posting lies in one block within its bounds."""
    root = str(tmp_path)
    frame = lambda rows: spark.createDataFrame(rows, UNIT)
    first = [unit(f"u{i:03}", "the pad", "fan " * (i % 7)) for i in range(120)]
    segments = lexical.with_segment(spark, root, [], frame(first), None)
    new = [unit(f"u{i:03}", "the new", "") for i in range(5)]
    segments = lexical.with_segment(spark, root, segments, frame(new), frame(first[:5]))
    assert len(segments) == 2
    for changed, before in ((new[:2], new[:2]), ([unit("u000", "", "")], new[:1]), ([], first[100:])):
        segments = lexical.with_segment(spark, root, segments, frame(changed), frame(before))
        index = lexical.open_segments(spark, root, segments)
        have = {(r.channel, r.term): r.n for r in index.postings.groupBy("channel", "term").agg(F.countDistinct("id").alias("n")).collect()}
        said = {(r.channel, r.term): r.n for r in index.blocks.groupBy("channel", "term").agg(F.sum("units").alias("n")).where("n <> 0").collect()}
        assert have == said
        off = index.postings.join(index.blocks.drop("bucket"), ["channel", "term", "segment", "block"], "left").where("most is null or count > most or length < least or count <> size(positions)")
        assert off.count() == 0


def test_postings_are_made_where_units_are_read(spark, tmp_path):
    """No shuffle and no second posting of a word for the CJK channel, which still counts all tokens; runs of few bytes hold the same."""
    rows = [unit("a", "pad pad", "fan", ["x"]), unit("b", "风扇 pad", "阈值"), unit("c", "", "")]
    whole = lexical._fields(spark.createDataFrame(rows, UNIT))
    assert "Exchange" not in lexical._postings(whole)._jdf.queryExecution().executedPlan().toString()
    got = {(r.channel, r.term, r.id): (r.length, list(r.positions)) for r in lexical._postings(whole).collect()}
    (length, pads), (_, fans) = got["text", "pad", "a"], got["text", "fan", "a"]
    assert length == 4 and pads[1] == pads[0] + 1 and fans[0] > pads[1] + 1
    assert {t for c, t, _ in got if c == "cjk"} == set("风扇阈值") and got["cjk", "扇", "b"][0] == 5
    old = lexical.RUN_BYTES
    try:
        lexical.RUN_BYTES = 8
        again = lexical._postings(lexical._fields(spark.createDataFrame(rows, UNIT))).collect()
    finally:
        lexical.RUN_BYTES = old
    assert {(r.channel, r.term, r.id): (r.length, list(r.positions)) for r in again} == got


def test_bounds_of_blocks_are_found_without_a_shuffle(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [("text", f"w{k // 700}", f"u{k}", k % 5 + 1, k % 90 + 9, [k], k >> lexical.BLOCK_BITS) for k in range(21_000)]
    spark.createDataFrame(rows, lexical.POSTINGS).coalesce(1).write.parquet(f"{tmp_path}/p")
    postings = spark.read.schema(lexical.POSTINGS).parquet(f"{tmp_path}/p")
    got = lexical._bounds(postings)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    keys = ["channel", "term", "block"]
    want = postings.groupBy(*keys).agg(F.count("*").alias("units"), F.max("count").alias("most"), F.min("length").alias("least"))
    whole = got.groupBy(*keys).agg(F.sum("units").alias("units"), F.max("most").alias("most"), F.min("least").alias("least"))
    assert sorted(whole.collect()) == sorted(want.collect())
    assert got.count() <= want.count() + 2  # three batches
