import corpus_pipeline
from lodestrata.llm import lines
from lodestrata.llm.queries import QUERIES, tokenizer_path
from tests.llm.test_simhash import jaccard_groups

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    """Each stage on what its predecessor kept, compared with plain Python or with what the stage promises."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
        assert k == 4 or docs.columns == columns
    good, cleaned, single, clean, packed = kept
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stays = {r.doc_id for r in good.collect()}
    fine = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in stays for i in fine) >= 0.95 * len(fine)
    rows = {r.doc_id: r for r in cleaned.collect()}
    assert set(rows) == stays and all(r.n_chars == len(r.text) for r in rows.values())
    for r in good.collect():
        assert set(rows[r.doc_id].text.split("\n")) <= {*r.text.split("\n"), ""}
    ids = sorted(rows)
    assert {r.doc_id for r in single.collect()} == {ids[k] for k in jaccard_groups([rows[i].text for i in ids])[0]}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    last = {r.doc_id: r.text for r in clean.collect()}
    assert not [i for i, t in last.items() if any(x in t for x in items)]
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path())
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
    assert set(pieces) == set(last)
    import numpy as np

    for i, own in pieces.items():
        assert np.frombuffer(b"".join(x for _, x, _ in sorted(own)), "<u4").tolist() == [*coder.encode(last[i], add_special_tokens=False).ids, 2]


def test_run_and_names(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] and sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert lines.RATIO == 0.1


def test_null_and_repeated_ids_are_decided_by_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    same, other = "a text of some words that has copies under odd ids", "quite another text with its own words and nothing more"
    rows = [(2, same), (2, same), (None, same), (7, same), (None, other), (None, None), (3, item), (None, item), (3, "clean words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    single = corpus_pipeline.one_of_each(spark, docs, SF)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, single.collect()), key=key) == sorted([(2, same), (None, other), (None, None), (3, item), (3, "clean words only")], key=key)
    clean = corpus_pipeline.without_test_items(spark, docs, SF)
    assert sorted(map(tuple, clean.collect()), key=key) == sorted([r for r in rows if r[1] != item], key=key) and clean.columns == docs.columns


def test_columns_with_the_names_of_keys_stay(spark):
    docs = spark.createDataFrame([(1, "one text of its own", "mine", "own"), (2, "two words, and more of them", "mine", "own")], "doc_id long, text string, `__key` string, `__KEY_` string")
    for stage in (corpus_pipeline.one_of_each, corpus_pipeline.without_test_items):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))
