"""Benchmark decontamination: word n-grams of the test items are seeds that find passages; a Smith-Waterman
alignment of the item with the text around its seeds scores them, so edited and paraphrased copies count too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import STEP_BYTES, durable, slices
from lodestrata.llm.tokens import PUNCTUATION, grams, word_hashes

#: Words of a seed.
SEED = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of an item's full score.
LEAST = 0.5
#: Bytes of items up to which they are sent to every task. A larger benchmark is taken in blocks of this size, one after another.
BLOCK_BYTES = 8 << 20


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in lower case, of any script, without ASCII punctuation, and their rows."""
    return word_hashes(pc.utf8_lower(texts.cast(pa.large_string())), PUNCTUATION)


class Items:
    """Test items with their seeds. The words of an item shorter than a seed are its one seed."""

    def __init__(self, ids: list, texts: list[str | None], n: int = SEED) -> None:
        self.ids, self.n = ids, n
        h, rows = folded(pa.array(texts, pa.string()))
        cut = np.searchsorted(rows, np.arange(len(ids) + 1))
        self.words = [h[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        seed, item, place = [], [], []
        self.size = np.array([min(n, len(w)) for w in self.words])
        for k, w in enumerate(self.words):
            if len(w):
                g, at = grams(w, np.zeros(len(w)), int(self.size[k]))
                seed.append(g)
                item.append(np.full(len(g), k))
                place.append(at)
        self.item, self.place = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (item, place))
        seed = np.concatenate([*seed, np.zeros(0, np.uint64)])
        self.seeds, self.of = np.unique(seed, return_inverse=True)
        self.sizes = sorted(set(self.size[self.size > 0].tolist()))
        self.by = np.argsort(self.of, kind="stable")
        self.start = np.searchsorted(self.of[self.by], np.arange(len(self.seeds) + 1))
        self.index = None

    def found(self, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(seed, word) of all places where a seed occurs."""
        if self.index is None:
            self.index = pd.Index(self.seeds)
        seeds, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in self.sizes:
            g, at = grams(h, rows, n)
            got = self.index.get_indexer(g)
            on = np.flatnonzero(got >= 0)
            seeds.append(got[on])
            words.append(at[on])
        return np.concatenate(seeds), np.concatenate(words)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the word of ``text`` at which it ends. Rows are vectors: with linear gaps
    the best way along a row is a running maximum."""
    j = np.arange(len(text)) * -GAP
    above, best, end = np.zeros(len(text), np.int64), 0, 0
    for word in item:
        diagonal = np.concatenate(([0], above[:-1])) + np.where(text == word, MATCH, MISMATCH)
        row = np.maximum(np.maximum(diagonal, above + GAP), 0)
        row = np.maximum(np.maximum.accumulate(row + j) - j, 0)
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
        above = row
    return best, end


def matches(h: np.ndarray, rows: np.ndarray, items: Items, least: float) -> list[tuple[int, int, float, int]]:
    """(row, item, score, word) of the best alignment of each item in each row that reaches ``least``."""
    seed, word = items.found(h, rows)
    if not len(seed):
        return []
    first = np.searchsorted(rows, np.arange(int(rows[-1]) + 2))
    count = items.start[seed + 1] - items.start[seed]
    which = items.by[np.repeat(items.start[seed] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    word = np.repeat(word, count)
    item, shift = items.item[which], word - items.place[which]
    order = np.lexsort((shift, item, rows[word]))
    item, shift, row = item[order], shift[order], rows[word][order]
    size = np.array([len(w) for w in items.words])
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (shift[1:] - shift[:-1] > size[item[1:]])
    starts = np.flatnonzero(new)
    # Item words that a window lacks can't match, so a window with too few of them is never aligned.
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(item)).tolist(), strict=True):
        k, r = int(item[a]), int(row[a])
        n = int(size[k])
        if n < SEED and first[r + 1] - first[r] != n:
            continue
        begin = max(int(shift[a]) - n // 2, int(first[r]))
        stop = min(int(shift[b - 1]) + n + n // 2 + 1, int(first[r + 1]))
        if np.isin(items.words[k], h[begin:stop]).sum() < least * n:
            continue
        score, end = align(items.words[k], h[begin:stop])
        share = score / (MATCH * n)
        if share >= least and share > best.get((r, k), (0.0, 0))[0]:
            best[r, k] = share, begin + end - int(first[r])
    return [(r, k, s, w) for (r, k), (s, w) in best.items()]


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """The items in blocks of bounded size, read one partition's rows after another."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).dropDuplicates().orderBy("i", "t").toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t or "") + 64
        if size >= BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """``doc_id, item_id, score, word``: every document and item whose best alignment reaches ``least`` of the item's full score.

    ``word`` is the word of the document where the alignment ends. Every seed of every item is looked up, however
    many documents have it, so neither copies nor partial copies hide each other. Null or wordless texts match nothing. Null ids and repeated rows are
    documents of their own; repeated items count once. An item of fewer words than a seed is too common to be a leak: it matches documents without other words. Other columns are ignored. Empty tables give no rows.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spark, kinds = docs.sparkSession, (dict(source.dtypes)["doc_id"], dict(benchmark.dtypes)[item_id])
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, word long"
    item_type = benchmark.select(F.col(item_id)).limit(0).toArrow().schema.field(0).type
    out = None
    for items in blocks(benchmark, item_id, item_text):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            items = sent.value
            for batch in batches:
                for part in slices(batch, "text", STEP_BYTES):
                    h, rows = folded(part.column("text"))
                    found = matches(h, rows, items, least) if len(h) else []
                    if found:
                        row, item, score, word = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row, pa.int64())), pa.array([items.ids[k] for k in item], item_type), pa.array(score, pa.float64()), pa.array(word, pa.int64())], names=["doc_id", "item_id", "score", "word"])

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: str | float) -> DataFrame:
    """``docs`` without the documents that hold a copy of a test item. Rows with null ids stay. Without items all rows stay; no rows give no rows."""
    bad = durable(contaminated(docs, benchmark, doc_id, text, **how).select(F.col("doc_id").alias("__bad")).dropna().distinct())
    return docs.join(bad, docs[doc_id] == bad["__bad"], "left_anti")
