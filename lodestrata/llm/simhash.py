"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within ``radius`` bits differ in at most
``radius // segments`` bits of some segment, so every fingerprint is looked up, in a table for each segment,
under all values of that segment's small Hamming ball, and whole distances decide. Of the two directions in
which a pair could be met, only the one towards the larger value is enumerated.

``groups`` links 64-bit fingerprints within a few bits, exactly. ``without_near_copies`` finds texts whose sets of shingles
have a Jaccard similarity: their fingerprints differ in a known share of the bits, so segments and balls of a
fingerprint of 256 bits or more are chosen to meet nearly all such pairs, whole distances leave few others, and the sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import STEP_BYTES, components, durable, joined_hot, slices
from lodestrata.llm.lines import few
from lodestrata.llm.tokens import grams, mixed, word_hashes

SHINGLE, RADIUS, SEGMENTS = 4, 4, 3
#: Table entries with up to so many fingerprints are compared pair by pair in one vectorised pass.
SMALL = 32

#: Words of a shingle and similarity of near copies; share of such pairs, at that very similarity, that some segment meets.
TERM, SIMILAR, RECALL = 5, 0.8, 0.99
#: 64-bit parts of a wide fingerprint, least and most.
PARTS = (4, 24)
#: Parts that distances are taken over, at least: fewer would let through too many pairs whose sets are not alike.
WHOLE = 12
#: Standard deviations by which a distance may exceed its mean at the similarity.
SPREAD = 3
#: Members before it, in the order of the fingerprints, of which each member of an entry meets the nearest at first; what that leaves apart meets in full afterwards.
MEMBERS = 512
#: Members of an entry or a family that one task compares with as many others, and the shingles of a family's members; more are dealt out in parts.
PART, PART_SHINGLES = 4096, 1 << 20
#: Nearest candidates of a text whose sets of shingles are compared with its own at first; then all of its family that are not yet in its group.
NEAREST = 2


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    view, size = memoryview(joined), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(words) - shingle + 1], ends[shingle - 1 :]
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 65536):
        hashes = np.array([xxh64_intdigest(view[s:e], 42) for s, e in zip(starts[at : at + 65536].tolist(), ends[at : at + 65536].tolist(), strict=True)], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text as a signed long. Null text: fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = np.array([fingerprint((x or "").encode(), shingle) for x in part.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, fp long")


def widths(segments: int) -> list[int]:
    return [64 * (k + 1) // segments - 64 * k // segments for k in range(segments)]


def entries(fp: str, at: int, width: int, ball: int, table: int, tables: int) -> Column:
    """The entries of a table, for ``width`` bits of ``fp`` from ``at`` on: the values within ``ball`` bits that are not smaller."""
    masks = [sum(1 << x for x in bits) for n in range(ball + 1) for bits in combinations(range(width), n)]
    own = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))
    if not ball:
        return F.array(own * tables + table)
    keys = F.filter(F.transform(F.array(*map(F.lit, masks)).cast("array<long>"), lambda m: own.bitwiseXOR(m)), lambda k: k >= own)
    return F.transform(keys, lambda k: k * tables + table)


def lookups(fps: DataFrame, radius: int, segments: int) -> DataFrame:
    """``k, fp``: all table entries under which a fingerprint is kept or looked up."""
    rows, at = [], 0
    for t, width in enumerate(widths(segments)):
        rows.append(entries("fp", at, width, radius // segments, t, segments))
        at += width
    return fps.select(F.explode(F.concat(*rows)).alias("k"), "fp")


def segments_for(n: int, radius: int = RADIUS) -> int:
    """How many segments make the work least for ``n`` fingerprints: entries, and comparisons within an entry. Any number finds the same links."""

    def work(segments: int) -> float:
        width = min(widths(segments))
        ball = sum(math.comb(width, k) for k in range(radius // segments + 1))
        return segments * ball * (1 + 0.5 * n * ball / 2**width)

    return min(range(2, radius + 2), key=work)


def linked(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all of a group's fingerprints which chains of near ones connect: fewer than it has members."""
    rest, out = fps.copy(), []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            a = front.pop()
            near = np.bitwise_count(rest ^ a) <= radius
            if near.any():
                found = rest[near]
                out += [(a, b) for b in found]
                front += list(found)
                rest = rest[~near]
    return out


def by_entry(compare: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function over rows sorted by entry ``k`` that calls ``compare`` with whole entries and returns its distinct pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_k, left_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def done(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            pair = np.unique(np.stack(compare(k, f), axis=1).view(np.int64), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        for batch in batches:
            k = np.concatenate([left_k, np.asarray(batch.column("k"), dtype=np.int64)])
            f = np.concatenate([left_f, np.asarray(batch.column("fp"), dtype=np.int64).view(np.uint64)])
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))
            left_k, left_f = k[cut:], f[cut:]
            if cut:
                yield done(k[:cut], f[:cut])
        if len(left_k):
            yield done(left_k, left_f)

    return run


def links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """``a, b``: links between distinct fingerprints that connect exactly those which chains of pairs within ``radius`` connect.

    ``fps`` has distinct values in ``fp``. An entry's members are linked by a spanning forest, not by all its
    pairs, so the links grow with the members. Within an entry every comparison is made.
    """

    def compared(k: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(starts, len(k)))
        a, b = [], []
        small = np.repeat(size <= SMALL, size)
        for d in range(1, min(SMALL, int(size.max(initial=1)))):
            i = np.flatnonzero((k[d:] == k[:-d]) & small[d:])
            if not len(i):
                break
            i = i[np.bitwise_count(f[i] ^ f[i + d]) <= radius]
            a.append(f[i])
            b.append(f[i + d])
        for s, n in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            pairs = np.array(linked(f[s : s + n], radius), dtype=np.uint64).reshape(-1, 2)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
        return np.concatenate([*a, f[:0]]), np.concatenate([*b, f[:0]])

    found = lookups(fps, radius, segments).repartition(F.col("k")).sortWithinPartitions("k", "fp")
    return found.mapInArrow(by_entry(compared), "a long, b long").distinct()


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, segments: int | None = None) -> DataFrame:
    """``doc_id, fp, component_id``: a row per document; ``component_id`` is the smallest id reachable over links.

    Equal fingerprints are one node, so copies are never paired. Documents without words have the fingerprint
    zero and are linked like any other. Null document ids take part; a component of nothing else has a null
    id. Repeated rows stay. Other columns are ignored. No rows give no rows.
    """
    each = durable(fingerprints(docs, doc_id, text, shingle))
    nodes = durable(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = components(links(nodes.select("fp"), radius, segments or segments_for(nodes.count(), radius)))
    member = found.withColumnRenamed("node", "fp").join(nodes, "fp")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = member.join(least, "root").select(F.col("fp").alias("__fp"), "component_id")
    known = durable(nodes.join(moved, nodes["fp"] == moved["__fp"], "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"))
    return joined_hot(each, known, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """``docs`` with one document of each component: the smallest id. Of repeated ids all rows stay; null ids stay. No rows give no rows."""
    kept = groups(docs, doc_id, text, **how).where("doc_id = component_id").select(F.col("doc_id").alias("__sh_id")).distinct()
    return docs.join(kept, docs[doc_id] == kept["__sh_id"], "left_semi").unionByName(docs.where(F.col(doc_id).isNull()))


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row, and their rows, in order of both; a row of fewer words has its whole sequence as one."""
    h, rows = word_hashes(texts)
    size = np.bincount(rows, minlength=len(texts))
    g, at = grams(h, rows, shingle)
    every, row = [g], [rows[at]]
    for n in range(1, shingle):
        on = size[rows] == n
        g, at = grams(h[on], rows[on], n)
        every.append(g)
        row.append(rows[on][at])
    g, row = np.concatenate(every), np.concatenate(row)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[new], row[new]


#: For each byte its eight bits as the eight bytes of a number, so that one addition counts eight bits.
SPREAD_BITS = np.array([sum((byte >> k & 1) << 8 * k for k in range(8)) for byte in range(256)], dtype="<u8")


def wide_fingerprints(g: np.ndarray, rows: np.ndarray, n: int, parts: int) -> np.ndarray:
    """``parts`` 64-bit numbers for each of ``n`` rows: a bit is 1 if it is set in over half of the hashes of the row's shingles."""
    votes = np.zeros((n, 64 * parts), np.int64)
    step = 262144 // parts  # 17 MB of counters
    for at in range(0, len(g), step):
        part, own = g[at : at + step], rows[at : at + step]
        raw = np.stack([mixed(part + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) for k in range(parts)], axis=1).view(np.uint8)
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        place = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
        run = np.flatnonzero(place % 255 == 0)  # no counter of eight bits overflows
        counts = np.add.reduceat(SPREAD_BITS[raw], run, axis=0).view(np.uint8)
        votes[own[begin]] += np.add.reduceat(counts.astype(np.int64), np.searchsorted(run, begin), axis=0)
    return np.packbits(2 * votes > np.bincount(rows, minlength=n)[:, None], axis=1, bitorder="little").view("<u8")


def flips(similar: float) -> float:
    """The share of bits in which fingerprints of two sets of equal size and this Jaccard similarity differ: their angle's share of a half turn."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def farthest(size, bits: int, similar: float, sqrt: Callable, greatest: Callable):  # noqa: ANN001, ANN201
    """The distance in ``bits`` up to which sets may be alike, ``size`` the shingles of the larger one; as numbers or as columns.

    Ties among few votes let more bits differ: up to 1 + 1 / c times ``flips`` for c shingles that both have, four at least where the sets are not equal.
    """
    p = (1 / greatest(similar * size, 4.0) + 1) * flips(similar)
    return p * bits + sqrt(p * (1 - p) * bits) * SPREAD


def plan(n: int, similar: float = SIMILAR, recall: float = RECALL) -> tuple[int, int, int, int]:
    """(width, ball, tables, parts) that let a pair of this similarity meet in some table as often as ``recall``, with the least work for ``n`` fingerprints.

    Random members of an entry must not be more than are compared (MEMBERS), so segments get longer with ``n``.
    """
    p, found = flips(similar), []
    for width in range(8, 33):
        for ball in range(4):
            meet = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(ball + 1))
            tables = math.ceil(math.log(1 - recall) / math.log1p(-meet)) if meet < recall else 1
            values = sum(math.comb(width, k) for k in range(ball + 1))
            load, parts = n * values / 2**width, max(PARTS[0], -(-tables // (64 // width)))
            if parts <= PARTS[1]:
                found.append((max(load, MEMBERS), tables * values * (1 + 0.01 * load) + 20 * parts, width, ball, tables, parts))
    return min(found)[2:]


def table_entries(nodes: DataFrame, tables_of: tuple[int, int, int, int], *kept: str) -> DataFrame:
    """``k, fp`` and the ``kept`` columns: every node (f0, f1, ...) in each table entry of the plan; ``fp`` is its ``f0``."""
    width, ball, tables, _ = tables_of
    per = 64 // width
    keys = [entries(f"f{t // per}", t % per * width, width, ball, t, tables) for t in range(tables)]
    return nodes.select(F.explode(F.concat(*keys)).alias("k"), F.col("f0").alias("fp"), *kept)


def candidates(nodes: DataFrame, tables_of: tuple[int, int, int, int], similar: float = SIMILAR) -> DataFrame:
    """``child, parent``: of each table entry, every member with the nearest of the MEMBERS before it, if that is near enough.

    ``nodes`` has distinct ``f0`` and the other parts. A member has one candidate for each of its entries at most, so candidates grow with the
    members, not with their pairs; ``apart`` has the others. Distances are those of ``f0``; whole ones are the caller's to check.
    """
    most, p = MEMBERS, flips(similar)
    near = int(64 * p + (SPREAD - 0.25) * math.sqrt(64 * p * (1 - p)))

    def nearest(k: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, parent = np.full(len(k), near + 1, np.uint8), np.zeros(len(k), np.uint64)
        on, d = np.arange(len(k)), 0
        while len(on) and d < most:
            d += 1
            on = on[on + d < len(k)]
            on = on[k[on + d] == k[on]]
            far = np.bitwise_count(f[on] ^ f[on + d])
            some = far < best[on + d]
            best[on[some] + d], parent[on[some] + d] = far[some], f[on[some]]
        got = best <= near
        return f[got], parent[got]

    found = table_entries(nodes, tables_of).repartition(F.col("k")).sortWithinPartitions("k", "fp")
    return found.mapInArrow(by_entry(nearest), "a long, b long").distinct().select(F.col("a").alias("child"), F.col("b").alias("parent"))


def forest(f: np.ndarray, size: np.ndarray, g: np.ndarray, side: np.ndarray, similar: float, alike: Callable[[int, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Members whose pairs connect all that chains of near ones and equal groups ``g`` connect: fewer pairs than there are groups.

    ``f``: the parts of each member's fingerprint, two at least. Those with ``side`` meet the others; where all or none have it, all meet all. Near ones for which
    ``alike`` (a member, others) is false do not count; it is not asked where both are connected already.
    """
    near, parts, mixed_sides = int(farthest(0, 128, similar, math.sqrt, max)), f.shape[1], side.any() and not side.all()
    own, other = (np.flatnonzero(side), np.flatnonzero(~side)) if mixed_sides else (np.arange(len(f)), np.arange(len(f)))
    root, a, b = np.unique(g, return_inverse=True)[1], [], []
    step = max(1, (1 << 17) // max(1, len(other)))
    for at in range(0, len(own), step):
        mine = own[at : at + step]
        far = np.bitwise_count(f[mine, None, 0] ^ f[None, other, 0]) + np.bitwise_count(f[mine, None, 1] ^ f[None, other, 1])
        row, to = np.nonzero(far <= near)
        row, to = mine[row], other[to]
        fit = (root[row] != root[to]) & (mixed_sides | (row < to))
        row, to = row[fit], to[fit]
        fit = np.bitwise_count(f[row] ^ f[to]).sum(axis=1, dtype=np.int64) <= farthest(np.maximum(size[row], size[to]), 64 * parts, similar, np.sqrt, np.maximum)
        row, to = row[fit], to[fit]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        for x, some in zip(row[first].tolist(), np.split(to, first[1:]), strict=True) if len(row) else ():
            some = some[root[some] != root[x]]
            if alike is not None and len(some):
                some = some[alike(x, some)]
            if len(some):
                met, where = np.unique(root[some], return_index=True)
                a += [x] * len(met)
                b += some[where].tolist()
                root[np.isin(root, met)] = root[x]
    return np.array(a, np.int64), np.array(b, np.int64)


def by_keys(keys: list[str], compare: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function over rows sorted by ``keys`` (longs) that calls ``compare`` with all rows of a key at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            got = compare(pa.Table.from_batches(kept))
            if got is not None:
                yield got

        last = None
        for batch in batches:
            own = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in keys], axis=1)
            first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]).any(axis=1)))) if len(own) else []
            for at, end in zip(first, [*first[1:], len(own)], strict=True):
                if last is not None and tuple(own[at]) != last:
                    yield from done()
                    kept.clear()
                last = tuple(own[at])
                kept.append(batch.slice(at, end - at))
        if kept:
            yield from done()

    return run


def pairs_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def apart(nodes: DataFrame, tables_of: tuple[int, int, int, int], parts: int, large: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``a, b``: groups that connect all groups of which chains of near members in table entries connect; kept.

    ``nodes`` has distinct ``f0``, the other parts and ``g``, the group. All members of an entry are compared, by all ``parts``, and give fewer pairs than it has groups.
    ``large``: the entries of more than PART members. Their members outside the entry's largest group meet all of its members. Where those are over PART, either side is dealt out in
    parts of about that many and each part of one meets each of the other in some task.
    """
    names = [f"f{k}" for k in range(1, parts)]
    rows = table_entries(nodes, tables_of, *names, "size", "g")
    same = ["k"]
    if large.limit(1).count():
        known = F.broadcast(large) if few(large) else large
        rest = rows.join(known, "k")
        main = rest.groupBy("k", "g").agg(F.count("*").alias("n")).groupBy("k").agg(F.max(F.struct("n", "g")).alias("m"), F.sum("n").alias("n"))
        main = durable(main.select("k", F.col("m.g").alias("main"), F.ceil((F.col("n") - F.col("m.n")) / PART).cast("int").alias("nx"), F.ceil(F.col("n") / PART).cast("int").alias("ny")).where("nx > 0"))
        rest = rest.join(F.broadcast(main) if few(main) else main, "k")
        part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = rest.where("g <> main").select("k", part("nx").alias("x"), each("ny").alias("y"), F.lit(True).alias("side"), "fp", *names, "size", "g")
        whole = rest.select("k", each("nx").alias("x"), part("ny").alias("y"), F.lit(False).alias("side"), "fp", *names, "size", "g")
        small = rows.join(known, "k", "left_anti").select("k", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(False).alias("side"), "fp", *names, "size", "g")
        same, rows = ["k", "x", "y"], small.unionByName(own).unionByName(whole)

    def met(whole: pa.Table) -> pa.RecordBatch | None:
        size, g = (np.asarray(whole.column(c)) for c in ("size", "g"))
        if len(g) < 2 or g.min() == g.max():
            return None
        side = np.asarray(whole.column("side")) if len(same) > 1 else np.zeros(len(g), bool)
        a, b = forest(np.stack([np.asarray(whole.column(c)).view(np.uint64) for c in ("fp", *names)], axis=1), size, g, side, similar)
        return pairs_of(g[a], g[b])

    found = rows.repartition(*map(F.col, same)).sortWithinPartitions(*same)
    return durable(found.mapInArrow(by_keys(same, met), "a long, b long").distinct())


def within_families(members: DataFrame, parts: int, similar: float = SIMILAR) -> DataFrame:
    """``a, b``: pairs of members (``f0``) with alike sets that connect all which chains of such pairs in a ``family`` connect; kept.

    ``members`` has distinct ``f0``, the other parts, ``size``, the group ``g`` and the set, ``own``. All members of a family in different groups that are near by all ``parts`` are compared
    by their sets where they meet, so rows grow with the members. A family of over PART members or PART_SHINGLES shingles is dealt out in parts, of which every two meet in some task.
    """
    names = [f"f{k}" for k in range(parts)]
    sums = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / PART, F.sum("size") / PART_SHINGLES)).cast("int").alias("n")).where("n > 1")
    sums = durable(sums)
    rows = members.join(F.broadcast(sums) if few(sums) else sums, "family", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("f0"), F.col("n")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.select("family", F.least("part", "with").alias("x"), F.greatest("part", "with").alias("y"), (F.col("part") <= F.col("with")).alias("side"), *names, "size", "g", "own")

    def met(whole: pa.Table) -> pa.RecordBatch | None:
        size, g = (np.asarray(whole.column(c)) for c in ("size", "g"))
        if g.min() == g.max():
            return None
        sets = whole.column("own").to_pylist()
        kinds, ids = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True)
        n = np.array([len(x) // 8 for x in sets], np.int64)
        ends, marked = np.cumsum(n), np.zeros(len(kinds), bool)

        def alike(x: int, some: np.ndarray) -> np.ndarray:
            mine = ids[ends[x] - n[x] : ends[x]]
            marked[mine] = True
            upto = np.cumsum(n[some])
            of = np.repeat(ends[some] - upto, n[some]) + np.arange(upto[-1])
            sums = np.concatenate(([0], np.cumsum(marked[ids[of]])))
            both = sums[upto] - sums[upto - n[some]]
            marked[mine] = False
            return both >= similar * (n[x] + n[some] - both)

        f = np.stack([np.asarray(whole.column(c)).view(np.uint64) for c in names], axis=1)
        a, b = forest(f, size, g, np.asarray(whole.column("side")), similar, alike)
        return pairs_of(f[a, 0].view(np.int64), f[b, 0].view(np.int64))

    keys = ["family", "x", "y"]
    return durable(rows.repartition(*map(F.col, keys)).sortWithinPartitions(*keys).mapInArrow(by_keys(keys, met), "a long, b long"))


def without_near_copies(docs: DataFrame, key: str, text: str = "text", shingle: int = TERM, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """``docs`` with the row of the smallest ``key`` of each group of near copies; ``key`` is never null and different in every row.

    Two texts are near copies if their sets of ``shingle`` words have a Jaccard similarity of ``similar`` at least; groups are what chains of
    them connect. Texts without words are copies of each other; null counts as such a text. Every candidate that multi-index
    hashing finds is checked by its sets unless both texts are in one group already: first each text's NEAREST by whole distances of those that ``candidates`` gives.
    Groups that chains of near texts connect, by ``apart``, are then a family, in which all near texts of different groups are compared. No rows give no rows.
    """
    chosen = plan(docs.count(), similar, recall)
    parts = max(chosen[-1], WHOLE)
    names = [f"f{k}" for k in range(parts)]

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                g, rows = shingle_sets(part.column("text"), shingle)
                fps = wide_fingerprints(g, rows, part.num_rows, parts).view(np.int64)
                size = pa.array(np.bincount(rows, minlength=part.num_rows), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(np.ascontiguousarray(fps[:, k])) for k in range(parts)), size], names=["key", *names, "size"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                g, rows = shingle_sets(part.column("text"), shingle)
                data = pa.py_buffer(g.astype("<u8").tobytes())
                ends = 8 * np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=part.num_rows))))
                yield pa.RecordBatch.from_arrays([part.column("f0"), pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), data])], names=["f0", "own"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similar * (len(a) + len(b) - both))
            on = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column("child").take(on), batch.column("parent").take(on)], names=["a", "b"])

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.select("key").schema[0].dataType.simpleString()
    each = source.mapInArrow(printed, f"key {kind}, " + ", ".join(f"{c} long" for c in [*names, "size"]))
    nodes = durable(each.groupBy("f0").agg(F.min(F.struct("key", *names[1:], "size")).alias("s")).select("f0", "s.*"))
    of = lambda side: nodes.select(F.col("f0").alias(side), F.array(*names).alias(f"{side}_f"), F.col("size").alias(f"{side}_size"))
    far = sum((F.bit_count(F.col("child_f")[k].bitwiseXOR(F.col("parent_f")[k])) for k in range(1, parts)), F.bit_count(F.col("child_f")[0].bitwiseXOR(F.col("parent_f")[0])))

    def close(pairs: DataFrame) -> DataFrame:
        """``child, parent, far``: pairs whose whole fingerprints are near enough."""
        both = pairs.join(of("child"), "child").join(of("parent"), "parent")
        most = farthest(F.greatest("child_size", "parent_size"), 64 * parts, similar, F.sqrt, lambda a, b: F.greatest(a, F.lit(b)))
        return both.where(far <= most).select("child", "parent", far.alias("far"))

    def with_sets(asked: DataFrame, *more: str) -> DataFrame:
        """``f0, own`` and other columns of ``asked`` (f0, key): the sets of some texts."""
        texts = source.join(F.broadcast(asked.select("f0", "key")) if few(asked) else asked.select("f0", "key"), "key").select("f0", "text")
        shingled = durable(texts.mapInArrow(sets, "f0 long, own binary"))
        return shingled.join(asked.select("f0", *more), "f0") if more else shingled

    def checked(some: DataFrame) -> DataFrame:
        """``a, b``: the pairs whose sets are alike."""
        shingled = with_sets(durable(some.select(F.explode(F.array("child", "parent")).alias("f0")).distinct().join(nodes.select("f0", "key"), "f0")))
        both = some.join(shingled.select(F.col("f0").alias("child"), F.col("own").alias("x")), "child").join(shingled.select(F.col("f0").alias("parent"), F.col("own").alias("y")), "parent")
        return durable(both.select("child", "parent", "x", "y").mapInArrow(alike, "a long, b long"))

    pairs = close(candidates(nodes, chosen, similar))
    pairs = pairs.groupBy("child").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "parent"))), 1, NEAREST).alias("p"))  # as many as its entries at most
    linked_pairs = checked(durable(pairs.select("child", F.explode("p.parent").alias("parent"))))
    found = durable(components(linked_pairs))
    large = durable(table_entries(nodes, chosen).groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("k"))
    grouped = nodes.join(found, nodes["f0"] == found["node"], "left").select("key", *names, "size", F.coalesce("root", "f0").alias("g"))
    families = components(apart(grouped, chosen, parts, large, similar)).select(F.col("node").alias("g"), F.col("root").alias("family"))
    members = durable(grouped.join(F.broadcast(families) if few(families) else families, "g"))
    more = within_families(with_sets(members, *names[1:], "size", "g", "family"), parts, similar)
    if more.limit(1).count():
        found = durable(components(linked_pairs.unionByName(more)))
    kept = nodes.join(found, nodes["f0"] == found["node"], "left").groupBy(F.coalesce("root", "f0").alias("root")).agg(F.min("key").alias("__sh_key")).select("__sh_key")
    return docs.join(kept, docs[key] == kept["__sh_key"], "left_semi")
