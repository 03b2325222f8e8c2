import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestrata.llm import packing
from lodestrata.llm.queries import tokenizer_path


def test_pieces():
    for n in [*range(1, 300), 4095, 4096, 4097, 20_000]:
        own = packing.pieces(n, 64 if n < 300 else 4096)
        assert [a for a, _ in own] == np.cumsum([0, *(s for _, s in own)]).tolist()[:-1] and sum(s for _, s in own) == n
        assert all(s & (s - 1) == 0 for _, s in own) and sum(s < max(x for _, x in own) for _, s in own) <= 12


def test_ids_and_sequences(spark):
    rng = random.Random(2)
    bits = ["the", " ", "\n", "can't", "I'LL", "ÉTÉ", "naïve", "ß", "x86", "...", "!?,", "日本", "e\u0301", "\u00a0", "µ", "<|endoftext|>", "<|startoftext|>", "—", "'", "_", "\x00", "×"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(150)] + [None, "", "the cat " * 9000]
    rows = [(i if i % 10 else None, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)] * 2
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, ids int"), tokenizer_path()).collect()
    coder = Tokenizer.from_file(tokenizer_path())
    want = sorted(repr([*coder.encode(t or "", add_special_tokens=False).ids, packing.END]) for _, t, _ in rows)
    docs, open_ = [], []
    for r in sorted(got, key=lambda r: r.sequence_id):
        assert r.offset == 0 and len(r.ids) == 4 * r.length and 2**r.bucket == r.length <= packing.LONGEST
        assert r.start == len(open_)
        open_ += np.frombuffer(r.ids, "<u4").tolist()
        if len(open_) == r.doc_tokens:
            docs.append(repr(open_))
            open_ = []
    assert sorted(docs) == want and not open_ and len({r.sequence_id for r in got}) == len(got)


def test_empty_and_bad_length(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, tokenizer_path(), longest=100)
