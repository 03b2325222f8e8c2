"""Phrase collocations: frequent phrases of two to five words, scored by their least surprising cut.

Identical pieces of text become one row with a multiplicity. N-grams are counted with these weights, level by level: an
n-gram can only be frequent if its words, and then its word pairs, are. Which of those are frequent is looked up in a bit
table of a fixed size by hash, so a false hit costs a row and nothing else. A task sends each n-gram of a step once; Spark deals
the rows into hash buckets and DuckDB sums each bucket, on disk where it must. What a phrase needs to know of its parts it
learns through requests that are shuffled to the parts' counts.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import buffers, slices, written
from lodestrata.llm.tokens import LOWER, grams, mixed, word_hashes

#: Least occurrences of a candidate, words of the longest, rows of a language, and the share (in per cent) of a
#: phrase's occurrences within a longer one from which it is dropped.
LEAST, LONGEST, MOST, SHARE = 100, 5, 2000, 100
#: Bytes of phrases that are combined in one step before rows leave a task.
COMBINED = 8 << 20
#: Bits of the table that says which words or pairs may be frequent, as a power of two: 16 MB.
BITS = 27
#: Bits of one row of that table while it is made.
ROW_BITS = 15
#: Memory of the DuckDB inside a task; what doesn't fit goes to the task's own scratch folder.
MEMORY = "256MB"

#: Byte classes: what separates pieces, what separates words.
ENDS = np.zeros(256, dtype=bool)
ENDS[[*b".,;:!?", *range(10, 14)]] = True
GAPS = np.zeros(256, dtype=bool)
GAPS[[32, 9]] = True
ROWS = "lang string, phrase string, n long"


def _summed(lang: pa.Array, phrase: pa.Array, n: pa.Array) -> pa.RecordBatch:
    """Rows with equal language and phrase as one."""
    out = pa.table({"lang": lang, "phrase": phrase, "n": n}).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
    return pa.RecordBatch.from_arrays([out.column(c).combine_chunks().cast(k) for c, k in (("lang", pa.string()), ("phrase", pa.string()), ("n_sum", pa.int64()))], names=["lang", "phrase", "n"])


def _spans(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes from ``begin`` on, ``size`` many, of each row, as strings; rows may overlap."""
    ends = np.concatenate(([0], np.cumsum(size)))
    data = raw[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def pieces(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, phrase, n``: the distinct pieces of all texts, words in lower case with one space between, and how often each occurs.

    Null text: empty. Null language: ``und``. Pieces without words are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = buffers(part.column("text"))
                if not len(raw):
                    continue
                raw = LOWER[raw]
                end, gap = ENDS[raw], GAPS[raw]
                word = ~(end | gap)
                begins = word.copy()
                begins[1:] &= ~word[:-1]
                edges = offsets[1:-1][offsets[1:-1] < len(raw)]
                begins[edges] = word[edges]
                at = np.flatnonzero(begins)
                if not len(at):
                    continue
                stops = word.copy()
                stops[:-1] &= ~word[1:]
                stops[edges - 1] = word[edges - 1]
                to = np.flatnonzero(stops) + 1
                row = np.searchsorted(offsets, at, side="right") - 1
                breaks = np.concatenate(([0], np.cumsum(end)))
                new = np.ones(len(at), dtype=bool)  # words that begin a piece
                new[1:] = (row[1:] != row[:-1]) | (breaks[at[1:]] > breaks[to[:-1]])
                size = to - at + 1  # with a space behind, which the piece's last word loses
                last = np.append(new[1:], True)
                size[last] -= 1
                ends = np.cumsum(size)
                data = raw[np.repeat(at - (ends - size), size) + np.arange(ends[-1])]
                data[(ends - 1)[~last]] = 32
                first = np.flatnonzero(new)
                cuts = np.append((ends - size)[first], ends[-1]).astype(np.int64)
                phrase = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
                yield _summed(part.column("lang").take(pa.array(row[first])), phrase, pa.array(np.ones(len(first), np.int64)))

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, ROWS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _of_lang(lang: pa.Array) -> np.ndarray:
    """A 64-bit hash of each row's language."""
    coded = lang.dictionary_encode()
    known = [mixed(np.frombuffer(x.encode().ljust(-(-len(x.encode()) // 8) * 8 or 8, b"\0"), "<u8")) for x in coded.dictionary.to_pylist()]
    return np.array([np.bitwise_xor.reduce(mixed(x + np.arange(len(x), dtype=np.uint64))) for x in known], dtype=np.uint64)[np.asarray(coded.indices)]


def _slots(h: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return (mixed(h ^ lang) >> np.uint64(64 - BITS)).astype(np.int64)


class Bits:
    """Which hashed words or pairs of words may be frequent."""

    def __init__(self, found: DataFrame, words: int) -> None:
        """``found``: frequent phrases of so many words. The table has a fixed size; it is put together in rows of it before the driver gets it."""
        self.words = words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h, row = word_hashes(batch.column("phrase"))
                own, _ = grams(h, row, words)
                yield pa.RecordBatch.from_arrays([pa.array(_slots(own, _of_lang(batch.column("lang"))))], names=["slot"])

        slots = found.select("lang", "phrase").mapInArrow(run, "slot long")
        rows = slots.groupBy((F.col("slot") / (1 << ROW_BITS)).cast("int").alias("row")).agg(F.bitmap_construct_agg(F.col("slot") % (1 << ROW_BITS)).alias("bits"))
        table = np.zeros((1 << (BITS - ROW_BITS), 1 << (ROW_BITS - 3)), dtype=np.uint8)
        for r in rows.collect():
            table[r.row] = np.frombuffer(r.bits, dtype=np.uint8)
        self.shared = found.sparkSession.sparkContext.broadcast(table.ravel())

    def __call__(self, slots: np.ndarray) -> np.ndarray:
        return (self.shared.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def ngrams(source: DataFrame, lengths: tuple[int, ...], bits: Bits | None = None) -> DataFrame:
    """``lang, phrase, n`` of the n-grams of distinct pieces, those whose parts the bits rule out left out; sums of each step of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "phrase"):
                raw, offsets = buffers(part.column("phrase"))
                h, row = word_hashes(part.column("phrase"))
                new = raw == 32
                new[1:] = new[:-1]  # a word begins after a space ...
                new[offsets[:-1]] = True  # ... or with its piece
                begin = np.flatnonzero(new)
                end = np.append(begin[1:] - 1, len(raw))
                end[np.flatnonzero(np.append(row[1:] != row[:-1], True))] = offsets[row[np.append(row[1:] != row[:-1], True)] + 1]
                weight, lang = np.asarray(part.column("n")), part.column("lang")
                for n in lengths:
                    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
                    if bits is not None and len(at):
                        own, start = grams(h, row, bits.words)
                        good = np.zeros(len(h) + 1, dtype=np.int64)
                        good[start] = bits(_slots(own, _of_lang(lang)[row[start]]))
                        sums = np.concatenate(([0], np.cumsum(good)))
                        inner = n - bits.words + 1
                        at = at[sums[at + inner] - sums[at] == inner]
                    size = end[at + n - 1] - begin[at]
                    steps = np.searchsorted(np.cumsum(size), np.arange(COMBINED, int(size.sum()), COMBINED))
                    for own in np.split(np.arange(len(at)), steps):
                        if len(own):
                            to = row[at[own]]
                            yield _summed(lang.take(pa.array(to)), _spans(raw, begin[at[own]], size[own]), pa.array(weight[to]))

    return source.select("lang", "phrase", "n").mapInArrow(run, ROWS)


def counted(rows: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, n``: sums of at least ``least``, summed by DuckDB in each hash bucket of (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with tempfile.TemporaryDirectory() as scratch:
            db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False})

            def all_batches() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            db.register("bucket", pa.RecordBatchReader.from_batches(first.schema, all_batches()))
            out = db.sql(f"select lang, phrase, sum(n)::bigint as n from bucket group by lang, phrase having sum(n) >= {least}").to_arrow_table()
            db.close()
        for b in out.to_batches(max_chunksize=20_000):
            yield pa.RecordBatch.from_arrays([b.column(c).cast(k) for c, k in (("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()))], names=["lang", "phrase", "n"])

    return rows.repartition("lang", "phrase").mapInArrow(run, ROWS)


def frequencies(source: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``lang, phrase, words, n``: all phrases of up to ``longest`` words that occur ``least`` times, written. ``source``: durable ``pieces``."""
    sized = lambda rows: rows.withColumn("words", F.size(F.split("phrase", " ", -1)))
    words = written(sized(counted(ngrams(source, (1,)), least)))
    pairs = written(sized(counted(ngrams(source, (2,), Bits(words, 1)), least)))
    out = words.unionByName(pairs)
    if longest > 2:
        out = out.unionByName(written(sized(counted(ngrams(source, tuple(range(3, longest + 1)), Bits(pairs, 2)), least))))
    return out


def cuts(found: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score`` of the phrases of two words and more: l and r are the counts of the parts at the cut of least score.

    Each phrase asks for both parts of each cut; requests and counts are shuffled by part. ``totals``: words of each language.
    """
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    asked = found.where("words > 1").withColumn("w", F.split("phrase", " ", -1)).select("lang", "phrase", "words", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    asked = asked.select("lang", "phrase", "words", "a", "k", F.explode(F.array(F.struct(F.lit("l").alias("side"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))).alias("x")).select("*", "x.*")
    met = asked.drop("x").join(found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    both = met.groupBy("lang", "phrase", "words", "a", "k").agg(side("l"), side("r")).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    both = both.withColumn("up", F.lit(1000).cast("decimal(38,0)") * whole("a") * whole("n")).withColumn("down", whole("l") * whole("r"))
    best = F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("best")
    return both.groupBy("lang", "phrase", "words", "a", "n").agg(best).select("lang", "phrase", "words", "a", "best.l", "best.r", "n", "best.score", "best.k")


def within_longer(found: DataFrame, share: int = SHARE) -> DataFrame:
    """``lang, phrase`` of the phrases of which ``share`` per cent of the occurrences lie within one longer phrase.

    Every phrase asks for the two that lack its first or last word. That is enough for longer ones too: what stands between
    a phrase and a longer one occurs at least as often as the longer one.
    """
    long = found.where("words > 2").withColumn("w", F.split("phrase", " ", -1))
    inner = long.select("lang", "n", F.explode(F.array_distinct(F.array(F.array_join(F.slice("w", F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("words") - 1), " ")))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return most.join(found.select("lang", "phrase", "n"), ["lang", "phrase"]).where(100 * F.col("longer").cast("decimal(20,0)") >= share * F.col("n").cast("decimal(20,0)")).select("lang", "phrase")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, most: int = MOST, share: int = SHARE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``most`` phrases by score, count and phrase.

    A phrase of two to ``longest`` words occurs a >= ``least`` times; of n words in the language, its parts at a cut occur l and r times, and the
    score is floor(1000 a n / (l r)) at the cut where it is least, the first of equals. Phrases that lie within a longer one
    are dropped (``within_longer``).

    Null text: empty. Null language: ``und``. Repeated rows count again. Texts of any length are whole; other columns are ignored. No
    rows, or none with a frequent phrase, give no rows. Counts up to 10**15 are exact.
    """
    source = written(pieces(docs, text, lang))
    totals = written(source.groupBy("lang").agg(F.sum(F.col("n") * F.size(F.split("phrase", " ", -1))).alias("n")))
    found = frequencies(source, least, longest)
    left = cuts(found, totals).join(within_longer(found, share), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
