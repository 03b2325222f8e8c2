"""Suffix-array dedup: every byte covered by a string of ``length`` bytes that also starts earlier goes.

Windows of that length are dealt out by the least hash of the short strings in them, so equal windows meet. Stretches
of windows that are equal as a whole are settled by comparing their hashes. The others, at the edges of repeats, are
settled by suffixes: the stretches that share a least hash are put in shards, each shard's Burrows-Wheeler
transform is made, and the transforms are merged by refining their interleave, one symbol more in each round. The
rounds also split the blocks of suffixes whose prefixes agree so far, which are the common prefixes and repeated
intervals of the merged order; after as many rounds as a window has symbols, a block is one repeated string.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import buffers, durable, slices
from lodestrata.llm.tokens import _power, mixed

#: Bytes of a window and of the short strings whose least hash deals it out.
LENGTH, GRAM = 100, 32
#: Bytes hashed in one step, and stretches or windows that a task compares among themselves before it sends them on.
STEP, TOGETHER = 2 << 20, 500_000
#: A least hash with more unsettled stretches than this goes window by window, dealt out by the windows' own hashes.
HOT, BROADCAST_HOT = 20_000, 100_000
#: Bytes of a symbol: divides LENGTH. Symbols that are merged in one go, and shards in each.
SYMBOL, MERGED, SHARDS = 10, 48_000, 4


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    up, down = _power(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])))
    return mixed((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])


def least_of(hashes: np.ndarray, whole: int) -> np.ndarray:
    """The least of each ``whole`` neighbours."""
    least, size = hashes, 1
    while 2 * size <= whole:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(least) - (whole - size)], least[whole - size :]) if whole > size else least


def stretches(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, least hash, content hash) of the stretches of windows that share a least hash.

    ``windows`` is twice their number, and 1 more if the least hash is met at two places: only then can two windows of one
    stretch be equal.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(raw), STEP):
        part = raw[at : at + STEP + length - 1]
        if len(part) < length:
            break
        grams = gram_hashes(part, gram)
        least = least_of(grams, length - gram + 1)
        place = at + np.arange(len(least))
        row = np.searchsorted(offsets, place, side="right") - 1
        inside = place + length <= offsets[row + 1]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        ends = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
        n = ends - first + 1
        seen = sliding_window_view(grams, length - gram + 1)
        left = first + (seen[first] == least[first, None]).argmax(axis=1)
        right = ends + length - gram - (seen[ends][:, ::-1] == least[ends, None]).argmax(axis=1)
        up, down = _power(len(part) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])))
        content = mixed((sums[ends + length] - sums[first]) * down[first] + n.astype(np.uint64))
        out.append((row[first], first + at - offsets[row[first]], 2 * n + (left < right), least[first], content))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def ranked(symbols: np.ndarray) -> np.ndarray:
    """Dense ranks in the order of the values, in the smallest type."""
    _, rank = np.unique(symbols, return_inverse=True)
    return rank.astype(np.uint16 if len(rank) == 0 or rank.max() < 65535 else np.uint32)


def transform(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, sorted to ``depth`` symbols at least, and Burrows-Wheeler transform of strings that each end in a 0."""
    n = len(symbols)
    rank, size = symbols.astype(np.int64), 1
    ends = np.flatnonzero(symbols == 0)
    rank[ends] = np.arange(len(ends))
    rank[symbols != 0] += len(ends)
    stop = ends[np.searchsorted(ends, np.arange(n))]
    order = np.argsort(rank, kind="stable")
    while size < depth:
        far = np.minimum(np.arange(n) + size, stop)
        key = rank * (n + 1 + int(rank.max())) + np.where(symbols == 0, 0, rank[far])
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], sorted_key[1:] != sorted_key[:-1])))
        size *= 2
    return order, symbols[order - 1]


def merged_blocks(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, block): the suffixes of all shards, as places in their concatenation, in blocks of equal first ``depth`` symbols.

    The interleave says which shard each row of the merged order is from. At first all rows of a shard stand
    together; each round reads the shards' transforms in the interleave's order and deals the rows out by symbol,
    which sorts them by one symbol more.
    """
    base = np.cumsum([0, *map(len, shards)])
    arrays, transforms = zip(*(transform(s, depth) for s in shards), strict=True)
    source = np.repeat(np.arange(len(shards), dtype=np.uint8), np.diff(base))
    whole = np.concatenate(transforms)
    enders = np.repeat(np.arange(len(shards), dtype=np.uint8), [int((s == 0).sum()) for s in shards])
    block = np.zeros(len(source), np.int32)
    for _ in range(depth):
        symbol = np.empty_like(whole)
        symbol[np.argsort(source, kind="stable")] = whole
        order = np.argsort(symbol, kind="stable")
        new = np.ones(len(order), bool)
        dealt, was = symbol[order], block[order]
        new[1:] = (dealt[1:] != dealt[:-1]) | (was[1:] != was[:-1])
        new[: len(enders)] = True  # ends of strings are all different
        source = source[order]
        source[: len(enders)] = enders
        block = np.cumsum(new, dtype=np.int32)
    place = np.empty(len(source), np.int64)
    place[np.argsort(source, kind="stable")] = np.concatenate([a + b for a, b in zip(arrays, base[:-1], strict=True)])
    return place, block


def repeated(texts: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """For each text which of its first ``windows`` windows equal one of an earlier text, or an earlier one of its own."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    first = np.cumsum(sizes) - sizes
    n = len(raw) - SYMBOL + 1
    code = np.zeros((2, n), np.uint64)
    for k in range(SYMBOL):
        code[k // 8] = code[k // 8] << np.uint64(8) | raw[k : k + n]
    rank = ranked(code[0]).astype(np.int64)
    if SYMBOL > 8:
        tail = ranked(code[1]).astype(np.int64)
        rank = ranked(rank * (int(tail.max()) + 1) + tail).astype(np.int64)
    rank = (rank + 1).astype(np.uint16 if rank.max() < 65534 else np.uint32)
    cut = np.linspace(0, len(texts), min(SHARDS, len(texts)) + 1).astype(int)
    shards, origin = [], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        places = []
        for t in range(a, b):
            for phase in range(SYMBOL):
                at = np.arange(first[t] + phase, first[t] + sizes[t] - SYMBOL + 1, SYMBOL)
                places += [at, np.array([-1])]
        at = np.concatenate(places)
        shards.append(np.where(at < 0, 0, rank[at]).astype(rank.dtype))
        origin.append(at)
    place, block = merged_blocks(shards, length // SYMBOL)
    at = np.concatenate(origin)[place]
    on = np.flatnonzero(at >= 0)
    text = np.searchsorted(first, at[on], side="right") - 1
    on = on[at[on] - first[text] < np.array(windows)[text]]
    at, block = at[on], block[on]
    least = np.full(int(block.max(initial=0)) + 1, len(raw), np.int64)
    np.minimum.at(least, block, at)
    again = np.zeros(len(raw), bool)
    again[at[at != least[block]]] = True
    return [again[f : f + w] for f, w in zip(first.tolist(), windows, strict=True)]


KEYS = "d long, k long, start long, n long"


def settled(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``settled, v, d, k, start, n``: stretches that repeat an earlier equal one, and those that suffixes must settle.

    A task first compares the stretches that it has itself, so a passage in a third of all documents is sent
    on once for each task. Then equal least hashes meet, sorted, and pass by with a state of two rows.
    """

    def dealt(v: np.ndarray, d: np.ndarray, k: np.ndarray, start: np.ndarray, n: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((start, k, d, c, n, v))
        v, d, k, start, n, c = (x[order] for x in (v, d, k, start, n, c))
        same = np.zeros(len(v), bool)
        same[1:] = (v[1:] == v[:-1]) & (n[1:] == n[:-1]) & (c[1:] == c[:-1])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(v))))
        twin = same & (d == d[lead]) & (k == k[lead]) & (start == start[lead])
        on = ~twin
        gone = same[on]
        key = np.where(gone, mixed((d[on] ^ k[on]).view(np.uint64)), v[on]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, gone, v[on].view(np.int64), d[on], k[on], start[on], n[on], c[on].view(np.int64))], names=["p", "settled", "v", "d", "k", "start", "n", "c"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for part in slices(batch, "text", STEP):
                raw, offsets = buffers(part.column("text"))
                row, start, n, v, c = stretches(raw, offsets, length, gram)
                held.append((v, np.asarray(part.column("d"))[row], np.asarray(part.column("k"))[row], start, n, c))
                if sum(len(x[0]) for x in held) >= TOGETHER:
                    yield dealt(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            yield dealt(*map(np.concatenate, zip(*held, strict=True)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["settled", "v", "d", "k", "start", "n"]
        lead: np.ndarray | None = None  # the class in progress: v, n, c, d, k, start
        held: np.ndarray | None = None  # the last class's first stretch, if not yet known to share its least hash
        held_sent = False

        def out(gone: np.ndarray | bool, rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(gone), rows.shape[1])), *[pa.array(rows[i]) for i in (0, 3, 4, 5)], pa.array(rows[1] >> 1)], names=names)

        for batch in batches:
            done = np.asarray(batch.column("settled").to_numpy(zero_copy_only=False), dtype=bool)
            rows = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in ("v", "n", "c", "d", "k", "start")])
            if done.any():
                yield out(True, rows[:, done])
            rows = rows[:, ~done]
            if not rows.shape[1]:
                continue
            ahead = rows if lead is None else np.concatenate((lead[:, None], rows), axis=1)
            new = np.ones(ahead.shape[1], bool)
            new[1:] = (ahead[:3, 1:] != ahead[:3, :-1]).any(axis=0)
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            later = ~new & (ahead[3:] != ahead[3:, first]).any(axis=0)
            yield out(True, ahead[:, later])
            heads = ahead[:, new]
            if lead is not None:
                heads = heads[:, 1:]
            if heads.shape[1]:
                chain = heads if held is None else np.concatenate((held[:, None], heads), axis=1)
                shared = np.zeros(chain.shape[1], bool)
                shared[1:] = chain[0, 1:] == chain[0, :-1]
                shared[:-1] |= shared[1:].copy()
                shared |= (chain[1] & 1).astype(bool)
                if held is not None and held_sent:
                    now = shared.copy()
                    now[0] = False
                else:
                    now = shared
                last_known = bool(shared[-1])
                if held is not None and held_sent and chain.shape[1] == 1:
                    last_known = True
                yield out(False, chain[:, now])
                held, held_sent = chain[:, -1].copy(), last_known
            lead = ahead[:, first[-1]].copy()

    rows = docs.mapInArrow(cut, f"p long, settled boolean, v long, {KEYS}, c long")
    order = ["settled", "v", "n", "c", "d", "k", "start"]
    return rows.repartition(F.col("p")).sortWithinPartitions(*order).mapInArrow(compare, f"settled boolean, v long, {KEYS}")


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``d, k, spans``: for each document that loses bytes the pieces to remove, not yet merged.

    ``docs`` has doc_id, d, k and text. It is joined as it is, so that the caller's join can read the same shuffled rows.
    """
    known = durable(settled(docs.where(F.octet_length("text") >= length).select("d", "k", "text"), length, gram))
    open_ = known.where("not settled").drop("settled")
    hot = durable(open_.groupBy("v").agg(F.count("*").alias("times")).where(F.col("times") > HOT).select("v", F.lit(True).alias("hot")))
    few = hot.limit(BROADCAST_HOT + 1).count() <= BROADCAST_HOT
    open_ = open_.join(F.broadcast(hot) if few else hot, "v", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    asked = open_.groupBy("d", "k").agg(F.collect_list(F.struct("v", "start", "n", "hot")).alias("asked"))
    names, types = ["settled", "v", "d", "k", "start", "n", "bytes"], [pa.bool_(), *[pa.int64()] * 5, pa.binary()]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: list[tuple[bytes, int, int, int]] = []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

        def sent() -> list[tuple]:
            """The first of each window that this task has, to be compared with other tasks'; the rest is settled."""
            out, lead = [], None
            for window, d, k, start in sorted(windows):
                if lead is None or window != lead[0]:
                    lead = (window, d, k, start)
                    out.append((False, int.from_bytes(blake2b(window, digest_size=8).digest(), "little", signed=True), d, k, start, 1, window))
                elif (d, k, start) != lead[1:]:
                    out.append((True, d * 0x9E3779B1 + start & 0x7FFFFFFFFFFFFFFF, d, k, start, 1, b""))
            windows.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for d, k, text, own in zip(*(part.column(c).to_pylist() for c in ("d", "k", "text", "asked")), strict=True):
                    raw = text.encode()
                    for x in own:
                        if x["hot"]:
                            windows += [(raw[i : i + length], d, k, i) for i in range(x["start"], x["start"] + x["n"])]
                        else:
                            rows.append((False, x["v"], d, k, x["start"], x["n"], raw[x["start"] : x["start"] + x["n"] + length - 1]))
                yield made(rows + (sent() if len(windows) >= TOGETHER // 4 else []))
        yield made(sent())

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        size = 0

        def spans_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["d", "k", "start", "n"])

        def done() -> list[tuple]:
            out = []
            for (_, _, d, k, start, _, _), again in zip(held, repeated([x[6] for x in held], [x[5] for x in held], length), strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate(([False], again, [False])).astype(np.int8)))
                out += [(d, k, start + a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            return out

        def closed() -> None:
            """One window alone has nothing to equal."""
            nonlocal size
            if len(group) > 1 or group and group[0][5] > 1:
                held.extend(group)
                size += sum(len(x[6]) for x in group)
            group.clear()

        for batch in batches:
            sure: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0]:
                    sure.append(row[2:6])
                    continue
                if group and row[1:5] == group[-1][1:5]:
                    continue  # a repeated row of the table
                if group and row[1] != group[-1][1]:
                    closed()
                    if size >= MERGED:
                        yield spans_of(done())
                        held.clear()
                        size = 0
                group.append(row)
            if sure:
                yield spans_of(sure)
        closed()
        if held:
            yield spans_of(done())

    texts = docs.join(asked, ["d", "k"]).mapInArrow(fetch, f"settled boolean, v long, {KEYS}, bytes binary").repartition(F.col("v")).sortWithinPartitions("settled", "v", "d", "k", "start")
    found = texts.mapInArrow(settle, KEYS)
    return known.where("settled").select("d", "k", "start", "n").unionByName(found).groupBy("d", "k").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: each document's bytes without those that repeat an earlier string of ``length`` bytes.

    ``spans`` are the maximal removed runs (start, length), ``kept`` the other bytes joined. Documents are in the
    order of their ids; null ids come first, equal ids go by the checksum of the text; rows equal in both are one
    place and don't remove each other. Null text: empty. Texts shorter than ``length`` stay whole. Other columns are
    ignored. No rows give no rows.
    """
    kind = dict(docs.dtypes)[doc_id]
    mine = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    mine = mine.withColumn("k", F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0).cast("long")))
    found = spans(mine, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, removed, kept = [], [], []
                for text, own in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    raw = text.encode()
                    edges: list[list[int]] = []
                    for a, b in sorted((x["start"], x["start"] + x["n"] + length - 1) for x in own or ()):
                        if edges and a <= edges[-1][1]:
                            edges[-1][1] = max(edges[-1][1], b)
                        else:
                            edges.append([a, b])
                    at, rest = 0, []
                    for a, b in edges:
                        rest.append(raw[at:a])
                        at = b
                    sizes.append(len(raw))
                    removed.append([{"start": a, "length": b - a} for a, b in edges])
                    kept.append(b"".join([*rest, raw[at:]]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, whole), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return mine.join(found, ["d", "k"], "left").mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,length:long>>, kept binary")
