"""Byte-level BPE: texts into ids and back, the merges done by recursive DuckDB queries inside each Spark partition.

A partition's distinct pre-tokens become rows (word, position, token). A recursive query joins neighbours with the
merge table and contracts each word's leftmost pair of least rank until no pair is left. Decoding joins ids with the
vocabulary and puts a text's bytes together by an ordered aggregation.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import SLICE_BYTES, slices

#: Distinct words whose ids a worker remembers; when there are more it starts anew.
REMEMBERED = 600_000
#: Bytes of new words in one recursive query, rows that its steps may pile up together, ids decoded by one query.
WORD_BYTES, ROWS, DECODED = 1 << 19, 4_000_000, 1 << 20
#: Settings of the DuckDB inside a task.
SETTINGS = {"threads": 1, "memory_limit": "250MB", "temp_directory": "", "autoinstall_known_extensions": False, "autoload_known_extensions": False}

#: Character classes: letters, digits, white space, anything else.
LETTER, DIGIT, GAP, OTHER = range(4)
#: What follows an apostrophe in a contraction (fixed by the pattern of pre-tokens).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: A place where a pre-token surely begins: the space.
SURE = re.compile(r"(?<=[a-z0-9]) ")


@cache
def classes() -> np.ndarray:
    """The class of every code point as the tokenizer's library sees it.

    Letters and digits that Python's own table doesn't know may be too new for that library as well; it is asked about them.
    """
    import regex
    import tiktoken

    whole = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern, start in ((LETTER, r"\p{L}+", "a"), (DIGIT, r"\p{N}+", "1"), (GAP, r"\s+", " ")):
        found = [c for m in regex.finditer(pattern, whole) for c in m.group()]
        new = [c for c in found if unicodedata.category(c) == "Cn"]
        ranks = {bytes([b]): b for b in range(256)} | {(start + c).encode(): 256 + k for k, c in enumerate(new)}
        judge = tiktoken.Encoding("classes", pat_str=pattern + r"|[\s\S]", mergeable_ranks=ranks, special_tokens={})
        gone = {c for c in new if len(judge.encode_ordinary(start + c)) > 1}
        out[[ord(c) for c in found if c not in gone]] = kind
    return out


def starts(text: str, ends: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of ``text`` begin, in code points; ``ends`` are the ends of the texts it is joined from. The tokens leave no gaps.

    A run of one class is a token, together with one space before it. Of white space before another class the last character stands
    alone, or goes with what follows if it is a space. A lone apostrophe takes a contraction's letters from the run behind it.
    """
    code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    if not len(code):
        return np.zeros(0, np.int64)
    kind, n = classes()[code], len(code)
    first = np.zeros(n + 1, dtype=bool)
    first[0] = True
    first[ends] = True
    new = first.copy()
    new[1:n] |= kind[1:] != kind[:-1]
    new[n] = True
    run = np.flatnonzero(new)
    gap = kind == GAP
    ahead = np.flatnonzero(gap[:-1] & ~gap[1:] & ~first[1:n])  # the last of white space before another class
    new[ahead] = True
    joins = ahead[code[ahead] == 32]
    new[joins + 1] = False
    lone = run[:-1][(np.diff(run) == 1) & (code[run[:-1]] == 39)]
    lone = lone[new[lone]]  # no space before it
    padded = np.append(code, np.zeros(2, np.uint32))
    for letters in CONTRACTIONS:
        met = np.ones(len(lone), dtype=bool)
        for k, c in enumerate(letters):
            met &= (padded[lone + 1 + k] == ord(c)) & ~first[np.minimum(lone + 1 + k, n)]
        at = lone[met]
        new[at + 1] = False
        new[at + 1 + len(letters)] = True
    return np.flatnonzero(new[:n])


#: Words in bytes up to which one row holds a word's tokens and a step contracts one pair of it; longer ones are a row for each token.
SHORT = 64
#: A step on short words: their (position, pair) rows meet the merge table; ``low`` is the least rank and its leftmost place.
SHORT_STEPS = """
with recursive w(step, word, toks) as (
  select 0, word, toks from state
  union all
  select step + 1, w.word, toks[: (low & 4294967295) - 1] || [(low >> 32)::int] || toks[(low & 4294967295) + 2 :]
  from w join (
    select word, min((t::bigint << 32) | i) as low
    from (select word, unnest(toks[: -2]) as l, unnest(toks[2 :]) as r, unnest(range(1, len(toks))) as i from w where len(toks) > 1) join merges using (l, r)
    group by word) using (word)
)
select word, arg_max(toks, step) as ids from w group by word"""
#: A step on long words contracts all pairs of the least rank that don't overlap, from the left, up to the first one that could thereby make a
#: pair of lower rank. ``met``: how many such pairs stand directly before a row; after an odd number its token is eaten.
LONG_STEPS = """
with recursive w(step, word, pos, tok) as (
  select 0, word, pos, tok from state
  union all
  select step + 1, word, pos, case when hit and met % 2 = 0 and stop is null then t else tok end from (
    select *, rn - 1 - coalesce(max(case when hit then 0 else rn end) over earlier, 0) as met, min(case when hit and risky then rn end) over earlier as stop
    from (
      select *, coalesce(t = low >> 32, false) as hit from (
        select p.*, m.t, (a.l is not null or b.l is not null or c.l is not null) as risky, min((m.t::bigint << 32) | rn) over (partition by word) as low
        from (
          select *, lead(tok) over tokens as nxt, lead(tok, 2) over tokens as after, lag(tok) over tokens as prior, row_number() over tokens as rn
          from w where step < $most window tokens as (partition by word order by pos)) p
        left join merges m on m.l = tok and m.r = nxt
        left join early a on a.l = prior and a.r = m.t left join early b on b.l = m.t and b.r = after left join early c on c.l = m.t and c.r = m.t)
      where low is not null)
    window earlier as (partition by word order by rn rows between unbounded preceding and 1 preceding))
  where not (met % 2 = 1 and (stop is null or stop >= rn - 1))
)
select word, step, list(tok order by pos) as ids from w where (word, step) in (select word, max(step) from w group by word) group by word, step"""


class Coder:
    """A vocabulary in a DuckDB of its own, and the words whose ids are known."""

    def __init__(self, path: str) -> None:
        import duckdb

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ranks = self.ranks
        if len(single := [ranks[bytes([b])] for b in range(256) if bytes([b]) in ranks]) < 256:
            raise ValueError("the vocabulary lacks single bytes")
        self.single = np.array(single, dtype=np.int32)
        pairs = [(ranks[b[:k]], ranks[b[k:]], t) for b, t in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks]
        l, r, t = (np.array(x, dtype=np.int32) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int32),) * 3
        self.db = duckdb.connect(config=SETTINGS)
        self.db.register("given", pa.table({"l": l, "r": r, "t": t}))
        self.db.execute("create table merges as select * from given")
        self.db.execute("create table early as select l, r from given where t < greatest(l, r)")
        self.db.register("given", pa.table({"id": pa.array(ranks.values(), pa.int64()), "hex": [b.hex() for b in ranks]}))
        self.db.execute("create table vocabulary as select * from given")
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Remembers the ids of ``words``, none of which is known: a token of the vocabulary is itself, the others are contracted."""
        at = 0
        while at < len(words):
            to, size = at, 0
            while to < len(words) and (to == at or size + len(words[to]) <= WORD_BYTES):
                size += len(words[to])
                to += 1
            self.add(words[at:to], [np.array([self.ranks[w]]) if w in self.ranks else None for w in words[at:to]])
            at = to

    def add(self, words: list[bytes], ids: list[np.ndarray | None]) -> None:
        for most, least in ((SHORT, 0), (1 << 62, SHORT)):
            rest = [k for k, x in enumerate(ids) if x is None and least < len(words[k]) <= most]
            if rest:
                raw = np.frombuffer(b"".join(words[k] for k in rest), dtype=np.uint8)
                (self.short if most == SHORT else self.long)(ids, rest, np.array([len(words[k]) for k in rest], dtype=np.int64), self.single[raw])
        size = np.array([len(x) for x in ids], dtype=np.int64)
        self.known.update(zip(words, range(len(self.first), len(self.first) + len(words)), strict=True))
        self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.pool = np.concatenate((self.pool, *ids)).astype(np.int32)

    def short(self, ids: list[np.ndarray | None], rest: list[int], sizes: np.ndarray, token: np.ndarray) -> None:
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(token, pa.int32()))
        self.db.register("state", pa.table({"word": np.array(rest, dtype=np.int64), "toks": lists}))
        for k, x in self.lists(SHORT_STEPS):
            ids[k] = x

    def long(self, ids: list[np.ndarray | None], rest: list[int], sizes: np.ndarray, token: np.ndarray) -> None:
        while rest:
            most = max(1, ROWS // len(token))
            self.db.register("state", pa.table({"word": np.repeat(np.array(rest, dtype=np.int64), sizes), "pos": np.arange(len(token)), "tok": token}))
            steps = dict(zip(rest, [0] * len(rest), strict=True))
            for k, x, step in self.lists(LONG_STEPS, {"most": most}):
                ids[k], steps[k] = x, step
            rest = [k for k in rest if steps[k] == most]  # these may have pairs left
            sizes = np.array([len(ids[k]) for k in rest], dtype=np.int64)
            token = np.concatenate([np.zeros(0, np.int32), *[ids[k] for k in rest]])

    def lists(self, query: str, given: dict | None = None) -> list[tuple]:
        """Rows (word, ids, other columns) of a query."""
        out = self.db.sql(query, params=given).to_arrow_table()
        lists = out.column("ids").combine_chunks()
        cuts, flat = np.asarray(lists.offsets).tolist(), np.asarray(lists.values)
        return list(zip(out.column("word").to_pylist(), [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], *[out.column(c).to_pylist() for c in out.column_names if c not in ("word", "ids")], strict=True))

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in one array, and where each text's ids end."""
        whole = "".join(texts)
        raw = np.frombuffer(whole.encode(), dtype=np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        begins = starts(whole, ends)
        place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        cuts = np.append(place[begins], len(raw)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw.tobytes())]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.forget()
        self.learn([w for w in words if w not in self.known])
        codes = np.array([self.known[w] for w in words], dtype=np.int64)[np.asarray(coded.indices)] if words else np.zeros(0, np.int64)
        sizes = self.size[codes]
        stops = np.concatenate(([0], np.cumsum(sizes)))
        source = np.repeat(self.first[codes] - stops[:-1], sizes) + np.arange(stops[-1])
        return self.pool[source], stops[np.searchsorted(begins, ends)]

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids; ids that the vocabulary lacks have none."""
        out = [b""] * len(ends)
        for at in range(0, len(ids), DECODED):
            part = np.arange(at, min(len(ids), at + DECODED))
            self.db.register("given", pa.table({"text": np.searchsorted(ends, part, side="right"), "pos": part, "id": ids[part].astype(np.int64)}))
            made = self.db.execute("select text, unhex(string_agg(hex, '' order by pos)) from given join vocabulary using (id) group by text").fetchall()
            for k, x in made:
                out[k] += x
        return out


@cache
def coder(path: str) -> Coder:
    """A worker's coder, made once."""
    return Coder(path)


def _chunks(text: str) -> list[str]:
    """A long text in pieces of about SLICE_BYTES, cut where a pre-token surely begins."""
    out, at = [], 0
    while len(text) - at > SLICE_BYTES and (met := SURE.search(text, at + SLICE_BYTES)):
        out.append(text[at : met.start()])
        at = met.start()
    return [*out, text[at:]]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, ids``: every text's token ids by the ranks file at ``path``; special tokens are ordinary text. A pass without a shuffle.

    With ``decoded`` also ``bytes``, what ``decode`` makes of the ids, by the same worker: two Python stages in a row would hold two vocabularies.

    Null text: empty, which has no ids. Null document ids and repeated rows are documents like any other. Texts of any length go
    whole, in steps. Other columns are ignored. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [x or "" for x in part.column("text").to_pylist()]
                if len(texts) == 1:
                    made = [own.encoded([c])[0] for c in _chunks(texts[0])]
                    ids, ends = np.concatenate(made), [sum(map(len, made))]
                else:
                    ids, ends = own.encoded(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
                back = [pa.array(own.decoded(ids, np.asarray(ends)), pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, *back], names=["doc_id", "ids", *["bytes"] * len(back)])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, ids array<int>" + ", bytes binary" * decoded)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` (doc_id, ids) with ``bytes``, what the ids stand for; null ids: null bytes, an id that the vocabulary lacks: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten()
            sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
            ids = np.asarray(pa.compute.fill_null(flat, -1))
            made = own.decoded(ids, np.cumsum(sizes))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x if ok else None for x, ok in zip(made, lists.is_valid().to_pylist(), strict=True)], pa.binary())], names=["doc_id", "ids", "bytes"])

    kind = dict(coded.dtypes)["doc_id"]
    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, bytes binary")
