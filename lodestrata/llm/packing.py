"""Packing by power-of-two decomposition: every document is cut into pieces of binary length, each a
sequence of its own, bucketed by equal length. No sequence crosses documents and none is padded."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import STEP_BYTES, buffers, slices
from lodestrata.llm.tokens import LOWER, SPACE

LONGEST, END = 4096, 2
#: Distinct units whose ids a worker remembers; when there are more it starts anew.
REMEMBERED = 250_000
#: The vocabulary's special tokens. A slice of texts with one of them is encoded text by text.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")

#: Byte classes: 0 white space, 1 letters, 2 punctuation, 3 what may stick to either (digits, apostrophes, other bytes).
GAP, LETTER, PUNCT, STICKY = range(4)
CLASS = np.full(256, STICKY, dtype=np.uint8)
CLASS[SPACE] = GAP
CLASS[[x for x in range(128) if chr(x).isalpha()]] = LETTER
CLASS[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "'"]] = PUNCT
#: Units that are one pre-token for certain: ASCII letters or marks, and letters with two-byte letters of Latin-1.
PURE = re.compile(rb"[A-Za-z]+|[!-&(-/:-@\[-`{-~]+")
LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable in Latin-1, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    """Ids of texts by way of the ids of their distinct units.

    The vocabulary's pre-tokenizer never joins across white space, nor a letter and a punctuation mark other than the
    apostrophe. Texts are cut there. A unit of letters or of marks alone is one pre-token and goes to the merges
    directly; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.model, self.letters = self.coder.model, byte_letters()
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, units: list[bytes]) -> None:
        ids, size, tokenize, letters = [], [], self.model.tokenize, self.letters
        for unit in units:
            if PURE.fullmatch(unit):
                own = [t.id for t in tokenize(unit.decode())]
            elif LATIN.fullmatch(unit):
                own = [t.id for t in tokenize(unit.decode().lower().encode().decode("latin-1").translate(letters))]
            else:
                own = self.coder.encode(unit.decode(), add_special_tokens=False).ids
            ids += own
            size.append(len(own))
        self.known.update(zip(units, range(len(self.first), len(self.first) + len(units)), strict=True))
        size = np.array(size, dtype=np.int64)
        self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.pool = np.concatenate((self.pool, np.array(ids, dtype=np.uint32)))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in one array, an END after each text, and where each text's ids end."""
        raw, offsets = buffers(texts)
        whole = raw.tobytes()
        if any(x.encode() in whole for x in SPECIAL):
            each = [[*self.coder.encode(x or "", add_special_tokens=False).ids, END] for x in texts.to_pylist()]
            return np.array([i for x in each for i in x], dtype=np.uint32), np.cumsum([len(x) for x in each])
        kind = CLASS[raw]
        marked = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7))
        kind[marked] = kind[marked + 1] = LETTER
        word = kind != GAP
        begin = word.copy()
        begin[1:] &= (kind[:-1] == GAP) | (kind[1:] + kind[:-1] == LETTER + PUNCT) & (kind[1:] != GAP) & (kind[:-1] != GAP) & (kind[1:] != kind[:-1])
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[edges] = word[edges]
        starts = np.flatnonzero(begin)
        data = LOWER[raw[word]]
        ends = np.append((np.cumsum(word) - 1)[starts], len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
        units = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.forget()
        self.learn([u for u in units if u not in self.known])
        at = np.array([self.known[u] for u in units], dtype=np.int64)
        codes = at[np.asarray(coded.indices)] if len(units) else at
        sizes = self.size[codes]
        stops = np.concatenate(([0], np.cumsum(sizes)))
        source = np.repeat(self.first[codes] - stops[:-1], sizes) + np.arange(stops[-1])
        text_ends = stops[np.searchsorted(starts, offsets[1:])]
        return np.insert(self.pool[source], text_ends, np.uint32(END)), text_ends + np.arange(1, len(text_ends) + 1)


def pieces(total: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: as many longest ones as fit, then its binary digits, large first."""
    out = [(at, longest) for at in range(0, total - longest + 1, longest)]
    at, rest = len(out) * longest, total % longest
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset``.

    ``ids`` has the piece's ids as little-endian unsigned 32-bit numbers, ``bucket`` is the binary logarithm of
    its length. ``longest`` is a power of two. One pass without a shuffle: a piece is a whole sequence, so
    no document waits for another. ``sequence_id`` is the place of the piece in its input partition, unique in
    a result and the same when a partition is computed again.

    Null text: empty, which still has its end id. Null document ids and repeated rows are documents like
    any other. Other columns are ignored. No rows give no rows.
    """
    if longest & longest - 1 or longest < 1:
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordIds(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                ids, ends = coder(part.column("text"))
                rows, at = [], 0
                for k, end in enumerate(ends.tolist()):
                    rows += [(k, at, start, size, end - at) for start, size in pieces(end - at, longest)]
                    at = end
                row, base, start, size, total = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
                data = pa.py_buffer(np.ascontiguousarray(ids, dtype="<u4").tobytes())
                cuts = np.concatenate((4 * (base + start), [4 * len(ids)])).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts.tobytes()), data])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(size), blob, pa.array(total)], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    cut = source.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")
    return cut.select("*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
