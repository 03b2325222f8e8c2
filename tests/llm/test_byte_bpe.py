import base64
import random

import public_tokenizers
import pytest
import tiktoken

from lodestrata.llm import byte_bpe
from lodestrata.llm.queries import op12_byte_bpe, ranks_path


def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.coder(ranks_path())


def check(coder, texts):
    ids, ends = coder.encoded(texts)
    judge, at = library(coder.ranks), 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[at:end].tolist() == judge.encode_ordinary(text), repr(text)
        at = end
    assert [x.decode() for x in coder.decoded(ids, ends)] == texts


BITS = [*"abstreSTREdmlv'' \n\t1٣½AЯ日本語é—!.,_", "'s", "'ll", "'re", "’s", "  ", "\n\n", " \n", "\r\n", "　", "ֈ", "\U000323b0", "\U0001f600", "é", "aaaa", "\x1c", "\x00", "<|endoftext|>"]


def test_pre_tokens_and_merges_as_the_library(own):
    rng = random.Random(5)
    check(own, ["".join(rng.choices(BITS, k=rng.randint(0, 60))) for _ in range(1500)])
    check(own, ["", "don't", "'tis 'Twas", "I'll've", " 's", "a's's", "\n's", "''s", "x   y", "  lead", "trail  ", "'", "'s", ""])


def test_characters_that_one_table_has_and_another_has_not(own):
    odd = [chr(c) for c in (0x558, 0x88F, 0x1C89, 0xA7CB, 0xA7CE, 0x11DE0, 0x12550, 0x16EA0, 0x2B73A, 0x323B0, 0x3D000, 0x10FFFF, 0xE000)]
    check(own, [f"a{c}b {c}1{c} {c}{c}'s" for c in odd])


def test_long_words(own):
    rng = random.Random(6)
    check(own, ["a" * 3001, "ab" * 900, "".join(rng.choices("abcdefg", k=700)), "é" * 333 + "日本" * 200, " " * 500, "=" * 300 + "-" * 65, "aaaabaaa" * 50])
    few, kept = byte_bpe.ROWS, own.known
    try:
        byte_bpe.ROWS = 600  # words go through many queries of one or two steps
        own.forget()
        check(own, ["xyzzy" * 60, "a" * 301, "short", "".join(rng.choices("nopq", k=290))])
    finally:
        byte_bpe.ROWS = few
    assert kept is not own.known


def test_a_vocabulary_whose_merges_make_lower_ranks(tmp_path):
    """Random ranks: contracting a pair may put a better pair beside it, in short words and long ones."""
    rng = random.Random(7)
    for round_ in range(6):
        more = list({bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(60)})
        rng.shuffle(more)
        ranks = {bytes([b]): k for k, b in enumerate(rng.sample(range(256), 256))} | {b: 256 + k for k, b in enumerate(more)}
        path = tmp_path / f"{round_}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(b) + b" %d\n" % k for b, k in ranks.items()))
        check(byte_bpe.Coder(str(path)), ["".join(rng.choices("abc", k=rng.choice([3, 7, 20, 64, 65, 90, 200]))) for _ in range(60)] + ["a" * 150, "ab" * 70])


def test_rows(spark, own):
    text = "The “tail” of it, isn't\n\n  the end. "
    rows = [(1, text, 5), (1, text, 5), (None, "x", 1), (2, None, 2), (3, "", 3), (4, "long text " * 30_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = byte_bpe.decode(byte_bpe.encode(docs, ranks_path()), ranks_path()).collect()
    judge = library(own.ranks)
    assert sorted(repr((r.doc_id, r.ids, bytes(r.bytes))) for r in got) == sorted(repr((i, judge.encode_ordinary(t or ""), (t or "").encode())) for i, t, _ in rows)
    assert byte_bpe.encode(docs.limit(0), ranks_path()).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [-5, 70_000, None]), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.bytes for r in byte_bpe.decode(odd, ranks_path()).collect()} == {1: None, 2: b"", 3: b""}


def test_long_texts_are_cut_where_a_token_begins(own, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 100)
    rng = random.Random(8)
    text = "".join(rng.choices([*BITS, "word", " word", " the"], k=2000))
    cut = byte_bpe._chunks(text)
    judge = library(own.ranks)
    assert len(cut) > 10 and "".join(cut) == text and [i for c in cut for i in judge.encode_ordinary(c)] == judge.encode_ordinary(text)


def test_query_against_the_library(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    judge = library(byte_bpe.coder(ranks_path()).ranks)
    got = op12_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = judge.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
