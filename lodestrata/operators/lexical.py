"""Lexical search: BM25 over all units, three channels, reciprocal-rank fusion, scope merge, document quota.

Corpus statistics are over all units whatever their state; scope and state filter what may be returned. A store keeps an inverted index:
postings with positions, made where the units are read and sorted by term in runs, and a narrow row for each unit. A request reads, of its few terms, the blocks of postings that can
hold one of the best units. Without an index every unit is tokenised where it is read, once. Either way only the best CHANNEL_CAP units of a
channel leave the tasks.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import scope, text
from lodestrata.lineage import COMPRESSION, durable
from lodestrata.schema import searchable

#: BM25, rank fusion, channel weights, boosts in units of a first rank, most units of a channel.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RANK_BASE = 60
WEIGHTS = {"all": 1.0, "any": 0.45, "cjk": 0.55}
PAGE_BOOST, SESSION_BOOST, SCOPE_BOOST = 2.0, 0.06, 0.5
CHANNEL_CAP = 50
#: Scores are compared after rounding to so many places, so that sums in another order rank alike.
PLACES = 9
DOCUMENT = r"^(.+?\.pdf)(?: - page (\d+))?$"


@dataclass(frozen=True)
class Request:
    query: str
    workspaces: tuple[str, ...] = ()
    repo_id: str = ""
    session_id: str = ""
    session_scope: str = "prefer"
    scope_fallback: str = "global"
    limit: int = 10
    per_document_limit: int | None = 2
    page_boost: float | None = None
    aliases: list[str] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "aliases", scope.aliases(*self.workspaces))

    @property
    def depth(self) -> int:
        return max(1, min(max(4 * self.limit, 32), CHANNEL_CAP))


FIELDS = ("in_summary", "in_resolution", "in_tags", "in_refs")


def indexed(units: DataFrame) -> DataFrame:
    """``units`` with the spaced tokens of summary, resolution, tags and source references, each list one field."""
    joined = lambda c: text.spaced(F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " "))
    return units.withColumns(dict(zip(FIELDS, (text.spaced(F.col("summary")), text.spaced(F.col("resolution")), joined("tags"), joined("source_refs")), strict=True)))


def indexed_cjk(units: DataFrame) -> DataFrame:
    """``units`` with one field of all text, CJK characters apart."""
    whole = F.concat_ws(" ", "summary", "resolution", F.array_join("tags", " "), F.array_join("source_refs", " "))
    return units.withColumn("in_all", text.spaced(text.cjk_spaced(whole)))


#: What a search needs to know of a unit besides its text.
ABOUT = ("id", "summary", "status", "memory_kind", "session_id", "workspace_id", "repo_id", "updated_at")


@dataclass(frozen=True)
class Index:
    """``postings``: channel (text or cjk), term, id, count, length (the unit's tokens in the channel), positions, segment, block. ``docs``: the columns of ABOUT,
    evidence_json as empty or not, and the tokens of each channel. ``blocks``: of each block of a term's postings its units, the greatest count and the least length;
    rows without a block take back the units of older segments that no longer count, so a term's units sum to those that have it.
    """

    postings: DataFrame
    docs: DataFrame
    blocks: DataFrame
    units: int
    mean: dict[str, float]


def about(units: DataFrame) -> list[Column]:
    return [*map(F.col, ABOUT), F.when(F.col("evidence_json") == "[]", "[]").otherwise("[...]").alias("evidence_json")]


def build_index(units: DataFrame, root: str) -> Index:
    """Writes the inverted index of ``units`` under ``root`` as one segment."""
    return open_segments(units.sparkSession, root, with_segment(units.sparkSession, root, [], units, None))


CHANNELS = ("text", "cjk")
POSTINGS = "channel string, term string, id string, count int, length int, positions array<int>, block bigint"
BLOCKS = "channel string, term string, block bigint, units bigint, most int, least int"
SCHEMAS = {"postings": POSTINGS, "blocks": BLOCKS}
#: A block is what of a term lies in 2 ** BLOCK_BITS consecutive postings of a file.
BLOCK_BITS = 8
#: A token that no text has: it stands between two fields and has a position, so that no phrase crosses them.
FIELD_GAP = "|"
#: Bytes of text whose postings a task sorts at once; a file has a run for each, of which a request reads the pages of its terms.
RUN_BYTES = 8 << 20
#: Segments from one on are merged when it has at most so many times the units of all that follow; so their number grows with the logarithm of the units.
FACTOR = 4


def _fields(units: DataFrame) -> DataFrame:
    """``units`` with the spaced tokens of each channel: ``text``, its fields apart, and ``cjk``, null for texts without such a character."""
    whole = F.concat_ws(" ", "summary", "resolution", F.array_join("tags", " "), F.array_join("source_refs", " "))
    both = indexed(units).withColumn("text", F.concat_ws(FIELD_GAP, *FIELDS))
    return both.withColumn("cjk", F.when(whole.rlike(f"[{text.CJK}]"), text.spaced(text.cjk_spaced(whole))))


def _sizes() -> list[Column]:
    """The tokens of each channel; without CJK characters both have the same."""
    own = sum((text.token_count(F.col(c)) for c in FIELDS), F.lit(0))
    return [own.alias("text"), F.coalesce(text.token_count(F.col("cjk")), own).alias("cjk")]


def _net(docs: DataFrame) -> dict[str, int]:
    row = docs.agg(F.count("*").alias("units"), *[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in CHANNELS]).first()
    return row.asDict()


def _postings(whole: DataFrame) -> DataFrame:
    """``channel, term, id, length, positions``: a row for each unit and term, made where the unit is read, without a shuffle, and sorted by term in runs of RUN_BYTES of text.

    The cjk channel is only asked for CJK characters, so it has no other terms; its lengths count all tokens.
    """

    def grouped(ids: pa.Array, texts: pa.Array, channel: str) -> pa.RecordBatch:
        words = pa.compute.ascii_split_whitespace(texts)
        size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(words), 0), dtype=np.int64)
        flat, row = words.flatten(), np.repeat(np.arange(len(size)), size)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        token = pa.compute.invert(pa.compute.is_in(flat, pa.array(["", FIELD_GAP], flat.type)))
        length = np.bincount(row[np.asarray(token)], minlength=len(size)).astype(np.int32)
        keep = token if channel == "text" else pa.compute.match_substring_regex(flat, f"^[{text.CJK}]")
        named, on = flat.filter(keep).dictionary_encode(), np.asarray(keep)
        row, at = row[on], at[on]
        order = np.asarray(pa.compute.array_sort_indices(named.dictionary))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        rank = rank[np.asarray(named.indices)]
        by = np.argsort(rank, kind="stable")  # then by unit and position, in whose order they come
        rank, row, at = rank[by], row[by], at[by]
        first = np.flatnonzero(np.concatenate(([True], (rank[1:] != rank[:-1]) | (row[1:] != row[:-1])))[: len(rank)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(rank)), pa.int32()), pa.array(at, pa.int32()))
        terms = named.dictionary.take(pa.array(order)).take(pa.array(rank[first]))
        columns = [pa.array([channel] * len(first), pa.string()), terms.cast(pa.string()), ids.take(pa.array(row[first])), pa.array(length[row[first]]), lists]
        return pa.RecordBatch.from_arrays(columns, names=["channel", "term", "id", "length", "positions"])

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            ends = np.cumsum(np.asarray(pa.compute.binary_length(batch.column("text")), dtype=np.int64))
            at = 0
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + RUN_BYTES - size, side="right")))
                kept.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - base)
                at = to
                if size >= RUN_BYTES or at < batch.num_rows:
                    yield pa.concat_batches(kept)
                    kept, size = [], 0
        if kept:
            yield pa.concat_batches(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            for channel in CHANNELS:
                yield grouped(part.column("id"), part.column(channel), channel)

    return whole.select("id", *CHANNELS).mapInArrow(run, "channel string, term string, id string, length int, positions array<int>")


def _units_of(postings: DataFrame) -> DataFrame:
    """How many units have each term of each channel."""
    return postings.groupBy("channel", "term").agg(F.count("*").alias("units"))


def _bounds(postings: DataFrame) -> DataFrame:
    """The rows of ``blocks`` for postings as a segment keeps them: a block lies together in one file, so nothing is shuffled.

    A block at the edge of two batches has a row for each part; sums, greatest and least values over its rows are the block's, and it is read if one of them calls for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = np.any([np.asarray(pa.compute.not_equal(c.slice(1), c.slice(0, n - 1))) for c in map(batch.column, ("channel", "term", "block"))], axis=0)
            first = np.flatnonzero(new)
            count, length = (np.asarray(batch.column(c)) for c in ("count", "length"))
            sums = [np.diff(np.append(first, n)), np.maximum.reduceat(count, first), np.minimum.reduceat(length, first)]
            keys = [batch.column(c).take(pa.array(first)) for c in ("channel", "term", "block")]
            yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, sums)], names=["channel", "term", "block", "units", "most", "least"])

    return postings.select("channel", "term", "block", "count", "length").mapInArrow(run, BLOCKS)


def _write(postings: DataFrame, docs: DataFrame, dead: DataFrame, taken: DataFrame, path: str) -> None:
    """A segment, of postings sorted by term in runs. ``taken``: units by term that older segments no longer count."""
    rows = postings.withColumn("count", F.size("positions")).withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    rows.write.option("compression", COMPRESSION).parquet(f"{path}/postings")
    read = docs.sparkSession.read.schema(POSTINGS).parquet(f"{path}/postings")
    blocks = _bounds(read)
    minus = taken.where("units <> 0").select("channel", "term", F.lit(None).cast("long").alias("block"), (-F.col("units")).alias("units"), F.lit(None).cast("int").alias("most"), F.lit(None).cast("int").alias("least"))
    blocks.unionByName(minus).sortWithinPartitions("channel", "term").write.option("compression", COMPRESSION).parquet(f"{path}/blocks")
    docs.write.option("compression", COMPRESSION).parquet(f"{path}/docs")
    dead.write.parquet(f"{path}/dead")


def with_segment(spark: SparkSession, root: str, segments: list[dict], units: DataFrame, replaced: DataFrame | None) -> list[dict]:
    """``segments`` (oldest first) of the index under ``root`` with a new one of ``units``; small ones at the end are merged into one.

    ``replaced``: the units as they were whose rows in older segments no longer count, changed or gone. A segment has ``path``, ``units`` (its rows),
    ``dead`` (ids that it takes away from older ones) and ``net``, what units and tokens it adds to the whole. Nothing that is there is changed.
    """
    whole = _fields(units)
    name = f"index/{uuid.uuid4().hex}"
    old = _fields(units.limit(0) if replaced is None else replaced)
    _write(_postings(whole), whole.select(*about(units), *_sizes()), old.select("id", *_sizes()), _units_of(_postings(old)), f"{root}/{name}")
    new, gone = (spark.read.parquet(f"{root}/{name}/{x}") for x in ("docs", "dead"))
    plus, minus = _net(new), _net(gone)
    segments = [*segments, {"path": name, "units": plus["units"], "dead": minus["units"], "net": {k: plus[k] - minus[k] for k in plus}}]
    first, size = len(segments) - 1, segments[-1]["units"] + segments[-1]["dead"]
    while first and segments[first - 1]["units"] <= FACTOR * size:
        first -= 1
        size += segments[first]["units"]
    return segments if first == len(segments) - 1 else [*segments[:first], _merged(spark, root, segments[first:], bool(first))]


def _read(spark: SparkSession, root: str, segment: dict, what: str) -> DataFrame:
    place = f"{root}/{segment['path']}/{what}"  # a segment that only takes away has no postings, so the schema is given
    return spark.read.schema(SCHEMAS[what]).parquet(place) if what in SCHEMAS else spark.read.parquet(place)


def _live(spark: SparkSession, root: str, segments: list[dict], what: str) -> DataFrame:
    """Postings or docs of all segments but those that a later one takes away; postings with the ``segment`` that they are in."""
    out = []
    for k, one in enumerate(segments):
        rows = _read(spark, root, one, what)
        if what == "postings":
            rows = rows.withColumn("segment", F.lit(k))
        later = [f"{root}/{x['path']}/dead" for x in segments[k + 1 :] if x["dead"]]
        out.append(rows.join(spark.read.parquet(*later).select("id").distinct(), "id", "left_anti") if later else rows)
    return reduce(DataFrame.unionByName, out)


def _blocks(spark: SparkSession, root: str, segments: list[dict]) -> DataFrame:
    return reduce(DataFrame.unionByName, [_read(spark, root, one, "blocks").withColumn("segment", F.lit(k)) for k, one in enumerate(segments)])


def _merged(spark: SparkSession, root: str, segments: list[dict], older: bool) -> dict:
    """One segment for consecutive ones; it takes away from ``older`` ones what they did."""
    name = f"index/{uuid.uuid4().hex}"
    dead = spark.read.parquet(*[f"{root}/{x['path']}/dead" for x in segments]).dropDuplicates(["id"])
    dead = durable(dead if older else dead.limit(0))
    docs, postings = _live(spark, root, segments, "docs"), _live(spark, root, segments, "postings")
    counted = postings.groupBy("channel", "term").agg(F.count("*").alias("units")).unionByName(_blocks(spark, root, segments).select("channel", "term", (-F.col("units")).alias("units")))
    taken = counted.groupBy("channel", "term").agg(F.sum("units").alias("units"))
    rows = postings.drop("block", "segment", "count").sortWithinPartitions("channel", "term", "id")  # runs of many small segments become one
    _write(rows, docs, dead, taken if older else taken.limit(0), f"{root}/{name}")
    net = {k: sum(x["net"][k] for x in segments) for k in ("units", *CHANNELS)}
    return {"path": name, "units": spark.read.parquet(f"{root}/{name}/docs").count(), "dead": dead.count(), "net": net}


def open_segments(spark: SparkSession, root: str, segments: list[dict]) -> Index:
    """The index of ``with_segment``; the numbers of units and tokens are in the segments, so nothing is read for them."""
    total = {k: sum(x["net"][k] for x in segments) for k in ("units", *CHANNELS)}
    mean = {k: total[k] / total["units"] if total["units"] else 0.0 for k in CHANNELS}
    return Index(_live(spark, root, segments, "postings"), _live(spark, root, segments, "docs"), _blocks(spark, root, segments), total["units"], mean)


def _idf(n: int, found: int) -> float:
    return max(math.log((n - found + 0.5) / (found + 0.5)), IDF_FLOOR)


def _gain(idf: float, times: Column, length: Column, mean: float) -> Column:
    """What a phrase found so often adds; it grows with ``times`` and falls with ``length``."""
    tf = times.cast("double")
    return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean or 1.0)))


def _score(phrases: int, idf: list[float], mean: float) -> Column:
    score = F.lit(0.0)
    for k in range(phrases):
        score = score - _gain(idf[k], F.col("found")[k], F.col("length"), mean)
    return score


def bm25(index: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """The units in which a phrase occurs, with ``found`` (occurrences of each phrase) and ``bm25`` (lower is better).

    ``index`` has token fields, named in_..., and the columns of a unit, of which those of ABOUT and evidence_json stay; a phrase
    lies within one field. Repeated phrases count again. A term found in over half the units weighs IDF_FLOOR.
    """
    fields = [c for c in index.columns if c.startswith("in_")]
    total = lambda f: sum((f(F.col(c)) for c in fields[1:]), f(F.col(fields[0])))
    counted = index.select(*about(index), F.array(*[total(lambda c, p=p: text.phrase_count(c, p)) for p in phrases]).alias("found"), total(text.token_count).alias("length"))
    counted = durable(counted)  # narrow rows, so that no text is tokenised again
    sums = counted.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"), *[F.count_if(F.col("found")[k] > 0).alias(f"n{k}") for k in range(len(phrases))]).first()
    score = _score(len(phrases), [_idf(sums.n, sums[f"n{k}"]) for k in range(len(phrases))], sums.mean)
    return counted.where(F.exists("found", lambda n: n > 0)).withColumn("bm25", score).drop("length")


def _asked(rows: DataFrame, channel: str, terms: set[str]) -> DataFrame:
    """The postings or blocks of some terms."""
    return rows.where((F.col("channel") == channel) & F.col("term").isin(*sorted(terms)))


def _found(index: Index, channel: str, phrases: list[list[str]]) -> DataFrame:
    """``id, length, found`` of the units in which one of the phrases occurs; kept."""
    terms = sorted({t for p in phrases for t in p})
    rows = _asked(index.postings, channel, set(terms))
    met = rows.groupBy("id").agg(F.max("length").alias("length"), *[F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"t{k}") for k, t in enumerate(terms)])

    def times(phrase: list[str]) -> Column:
        lists = [F.col(f"t{terms.index(t)}") for t in phrase]
        if len(lists) == 1:
            return F.coalesce(F.when(lists[0].isNotNull(), F.size(lists[0])), F.lit(0))
        back = lambda x, i: F.transform(x, lambda at: at - i)
        starts = reduce(F.array_intersect, [back(x, i) for i, x in enumerate(lists)])
        return F.coalesce(F.when(starts.isNotNull(), F.size(starts)), F.lit(0))

    return durable(met.select("id", "length", F.array(*[times(p).cast("int") for p in phrases]).alias("found")).where(F.exists("found", lambda n: n > 0)))


def _frequencies(found: DataFrame, phrases: int) -> list[int]:
    return list(found.agg(*[F.count_if(F.col("found")[k] > 0).alias(f"n{k}") for k in range(phrases)]).first())


def bm25_of(index: Index, channel: str, phrases: list[list[str]]) -> DataFrame:
    """What ``bm25`` returns, from an index: reads the postings of the request's terms only."""
    found = _found(index, channel, phrases)
    score = _score(len(phrases), [_idf(index.units, n) for n in _frequencies(found, len(phrases))], index.mean[channel])
    return index.docs.join(found, "id").withColumn("bm25", score).select(*ABOUT, "evidence_json", "found", "bm25")


#: Blocks, those of the greatest bounds, whose units give the first threshold; smaller ones, up to so many times as many, until they have the units of whole ones. Units that lie below it by SLACK, wider than rounding, are left out.
FIRST, SMALLER, SLACK = 64, 16, 1e-8
#: Up to so many units are looked up in the postings of the remaining terms by sending their ids to every task.
SENT = 200_000


@dataclass(frozen=True)
class Reach:
    """What of a request's one-word phrases must be read: ``whole`` terms and the ``chosen`` blocks (segment, term, block, units) of ``partly`` read ones.

    ``least``: the gain that a unit must reach (None: any); ``idf`` and ``most``: weight and greatest gain, repeats counted, of each term that a unit has, ``units`` how many have it;
    ``rare``: the term of the fewest units.
    """

    least: float | None
    idf: dict[str, float]
    most: dict[str, float]
    units: dict[str, int]
    whole: set[str]
    partly: set[str]
    chosen: DataFrame
    rare: str | None


def _scopes(request: Request) -> Column:
    own = scope.in_workspace(F.col("workspace_id"), request.aliases) if request.aliases else F.lit(True)
    wide = F.lit(bool(request.aliases and request.scope_fallback == "global"))
    return F.array_compact(F.array(F.when(own, F.lit("own")), F.when(wide, F.lit("wide"))))


def reach(index: Index, channel: str, words: list[str], request: Request, single: bool, every: bool) -> Reach:
    """Which blocks of the words' postings can hold a unit of the best ones, by block-max pruning.

    The units of the blocks with the greatest bounds give a threshold: the gain of the last unit asked for, in each scope. Words are ordered by their greatest gain. A block
    is left out if its bound and the greatest gains of the words before its own stay below the threshold together: a unit in left-out blocks only gains no more than that for
    the last of its words.
    ``single``: a unit with one of the phrases may be an answer; ``every``: one with all may, whatever its gain, for which all postings of the rarest word are read.
    """
    mean, times = index.mean[channel], Counter(words)
    rows = _asked(index.blocks, channel, set(words)) if words else index.blocks.limit(0)
    known = F.col("block").isNotNull()
    low = [F.min("most").alias("fewest"), F.max(F.when(known, F.col("least"))).alias("longest")]
    sums = rows.groupBy("term").agg(F.sum("units").alias("units"), F.max("most").alias("most"), F.min("least").alias("least"), *low).where("units > 0").collect()

    def gain(idf: float, count: int, length: int) -> float:
        return idf * count * (K1 + 1) / (count + K1 * (1 - B + B * length / (mean or 1.0)))

    idf = {r.term: _idf(index.units, r.units) for r in sums}
    weight = {t: times[t] * idf[t] for t in idf}
    most = {r.term: gain(weight[r.term], r.most, r.least) for r in sums}
    worst = {r.term: gain(weight[r.term], r.fewest, r.longest) for r in sums}
    rare = min(sums, key=lambda r: (r.units, r.term)).term if sums else None
    if not sums:
        return Reach(None, {}, {}, {}, set(), set(), rows.select("segment", "term", "block", "units"), None)
    bound = F.coalesce(*[F.when(F.col("term") == t, _gain(weight[t], F.col("most"), F.col("least"), mean)) for t in idf])
    rows = rows.where(known & F.col("term").isin(*idf)).withColumn("bound", bound)
    least = math.inf
    if single:
        first = rows.orderBy(F.desc("bound"), "segment", "term", "block").limit(FIRST * SMALLER).select("segment", "term", "block", "units").collect()
        of: dict[tuple[int, str], list[int]] = {}
        left = FIRST << BLOCK_BITS
        for r in first:
            if left <= 0:
                break
            left -= r.units
            of.setdefault((r.segment, r.term), []).append(r.block)
        here = reduce(lambda a, b: a | b, [(F.col("segment") == k) & (F.col("term") == t) & F.col("block").isin(*of[k, t]) for k, t in of])
        each = F.coalesce(*[F.when(F.col("term") == t, _gain(weight[t], F.col("count"), F.col("length"), mean)) for t in idf])
        part = _asked(index.postings, channel, set(idf)).where(here).groupBy("id").agg(F.sum(each).alias("gain"))  # few blocks
        seen = index.docs.join(F.broadcast(part), "id").where(in_scope(request)).select("gain", F.explode(_scopes(request)).alias("scope"))
        best = Window.partitionBy("scope").orderBy(F.desc("gain"))
        last = seen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == request.depth).collect()
        scopes = 2 if request.aliases and request.scope_fallback == "global" else 1
        least = min(r.gain for r in last) - SLACK if len(last) == scopes else None
    order = sorted(most, key=lambda t: (most[t], t))
    rest = {t: sum(most[x] for x in order[:k]) for k, t in enumerate(order)}
    whole = {t for t in idf if least is None or worst[t] + rest[t] >= least or (every and t == rare)}
    partly = {t for t in idf if t not in whole and most[t] + rest[t] >= least}
    short = F.coalesce(*[F.when(F.col("term") == t, F.lit(rest[t])) for t in idf])
    reached = F.lit(True) if least is None else (F.col("bound") + short >= F.lit(least))
    chosen = rows.where(F.col("term").isin(*partly) & reached) if partly else rows.limit(0)
    return Reach(least, idf, most, {r.term: r.units for r in sums}, whole, partly, chosen.select("segment", "term", "block", "units"), rare)


def best_of(index: Index, channel: str, phrases: list[list[str]], request: Request, single: bool = True, every: bool = True) -> DataFrame:
    """Rows of ``bm25_of``, of which units that can't be among a request's best may be missing.

    ``single``: units with one of the phrases are ranked, ``every``: those with all of them are. Phrases of several words are always read whole;
    one-word phrases by blocks and without positions. The counts of the returned units are whole.
    """
    words = [p[0] for p in phrases if len(p) == 1]
    more = [p for p in phrases if len(p) > 1]
    longs = _found(index, channel, more) if more else None
    held = _frequencies(longs, len(more)) if more else []
    weights = [_idf(index.units, n) for n in held]
    to = reach(index, channel, words, request, single, every and not more)
    terms, mean, times = sorted(to.most), index.mean[channel], Counter(words)
    postings = _asked(index.postings, channel, to.whole | to.partly) if to.whole | to.partly else index.postings.limit(0)
    read = [postings.where(F.col("term").isin(*to.whole)) if to.whole else postings.limit(0)]
    if to.partly:
        read.append(postings.where(F.col("term").isin(*to.partly)).join(to.chosen.drop("units"), ["segment", "term", "block"], "left_semi"))
    narrow = reduce(DataFrame.unionByName, [r.select("id", "length", "term", "count") for r in read])
    counts = lambda some: [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("count"))), F.lit(0)).alias(f"n{terms.index(t)}") for t in some]
    met = narrow.groupBy("id").agg(F.max("length").alias("length"), *counts(terms))
    none = F.array(*[F.lit(0)] * len(more)).cast("array<int>")
    if longs is not None:
        both = met.withColumnRenamed("length", "own").join(longs, "id", "full_outer")
        met = both.select("id", F.coalesce("own", "length").alias("length"), *[F.coalesce(f"n{k}", F.lit(0)).alias(f"n{k}") for k in range(len(terms))], F.coalesce("found", none).alias("longs"))
    else:
        met = met.withColumn("longs", none)
    missing = [t for t in terms if t not in to.whole]
    if missing:
        few = sum(held) + sum(to.units[t] for t in to.whole | to.partly) <= SENT  # then no job need count them
        met = met if few else durable(met)
        have = sum((_gain(times[t] * to.idf[t], F.col(f"n{terms.index(t)}"), F.col("length"), mean) for t in terms if t in to.whole), F.lit(0.0))
        have = have + sum((_gain(w, F.col("longs")[k], F.col("length"), mean) for k, w in enumerate(weights)), F.lit(0.0))
        have = have + sum(to.most[t] for t in missing)
        full = F.forall("longs", lambda n: n > 0) & (F.lit(True) if more else F.col(f"n{terms.index(to.rare)}") > 0)
        met = met.where((have >= F.lit(to.least)) | (full if every else F.lit(False)))
        few = few or met.count() <= SENT
        ids = met.select("id")
        others = _asked(index.postings, channel, set(missing)).select("id", "term", "count").join(F.broadcast(ids) if few else ids, "id", "left_semi")
        others = others.groupBy("id").agg(*counts(missing))
        met = met.drop(*[f"n{terms.index(t)}" for t in missing]).join(others, "id", "left").fillna(0, [f"n{terms.index(t)}" for t in missing])
    place = {id(p): F.col("longs")[k] for k, p in enumerate(more)}
    found = [place[id(p)] if len(p) > 1 else F.col(f"n{terms.index(p[0])}").cast("int") if p[0] in to.most else F.lit(0) for p in phrases]
    longer = iter(weights)
    idf = [next(longer) if len(p) > 1 else to.idf.get(p[0], 0.0) for p in phrases]
    whole = met.select("id", "length", F.array(*found).alias("found"))
    return index.docs.join(whole, "id").withColumn("bm25", _score(len(phrases), idf, mean)).select(*ABOUT, "evidence_json", "found", "bm25")


def scored(source: DataFrame | Index, channel: str, phrases: list[list[str]]) -> DataFrame:
    if isinstance(source, Index):
        return bm25_of(source, channel, phrases)
    return bm25(indexed(source) if channel == "text" else indexed_cjk(source), phrases)


def in_scope(request: Request) -> Column:
    """What may be returned at all: searchable units of the repository and, if strict, session."""
    rule = searchable()
    if request.repo_id:
        rule = rule & F.col("repo_id").isin(request.repo_id, "")
    if request.session_scope == "strict":
        rule = rule & (F.col("session_id") == request.session_id)
    return rule


def ranked(units: DataFrame | Index, request: Request) -> DataFrame:
    """``scope, channel, rank, id, summary, session_id``: the best units of each channel, own for the workspaces and wide for all.

    A unit is scored once for all channels and scopes that it is in; each task sends on at most ``depth`` units of each.
    Without workspaces, or with the fallback off, there is no wide scope.
    """
    phrases = [text.query_tokens(t) for t in text.terms(request.query)]
    real = [p for p in phrases if p]
    runs = text.cjk_runs(request.query)
    whole = F.forall("found", lambda n: n > 0)
    rows = []
    if real:
        every = whole if len(real) == len(phrases) else F.lit(False)
        best = best_of(units, "text", real, request, every=len(real) == len(phrases)) if isinstance(units, Index) else scored(units, "text", real)
        rows.append(best.withColumn("channels", F.array_compact(F.array(F.when(every, F.lit("all")), F.lit("any")))))
    if runs:
        best = best_of(units, "cjk", runs, request, single=False) if isinstance(units, Index) else scored(units, "cjk", runs)
        rows.append(best.withColumn("channels", F.array_compact(F.array(F.when(whole, F.lit("cjk"))))))
    if not rows:
        empty = units.docs if isinstance(units, Index) else units
        return empty.select(F.lit("").alias("scope"), F.lit("").alias("channel"), F.lit(0).alias("rank"), "id", "summary", "session_id").limit(0)
    found = reduce(DataFrame.unionByName, [r.where(in_scope(request)).select("id", "summary", "session_id", "updated_at", F.round("bm25", PLACES).alias("bm25"), F.explode("channels").alias("channel"), _scopes(request).alias("scopes")) for r in rows])
    found = found.select("*", F.explode("scopes").alias("scope")).drop("scopes")
    order = Window.partitionBy("scope", "channel").orderBy("bm25", F.desc("updated_at"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= request.depth).select("scope", "channel", "rank", "id", "summary", "session_id")


def fused(rows: DataFrame, request: Request) -> DataFrame:
    """``id, summary, own, wide``: scores by reciprocal ranks and boosts in either scope, null where a unit isn't in it."""
    weight = F.coalesce(*[F.when(F.col("channel") == k, F.lit(w)) for k, w in WEIGHTS.items()]) / (RANK_BASE + F.col("rank"))
    rows = rows.groupBy("id").agg(F.first("summary").alias("summary"), F.first("session_id").alias("session_id"), *[F.sum(F.when(F.col("scope") == k, weight)).alias(k) for k in ("own", "wide")])
    bonus = F.lit(0.0)
    page = PAGE_BOOST if request.page_boost is None else float(request.page_boost)
    if page:
        bonus = bonus + F.when(text.stripped(F.col("summary")).rlike(DOCUMENT), F.lit(page)).otherwise(0.0)
    if request.session_id and request.session_scope == "prefer":
        bonus = bonus + F.when(F.col("session_id") == request.session_id, F.lit(SESSION_BOOST)).otherwise(0.0)
    return rows.select("id", "summary", *[F.round(F.col(k) + bonus / (RANK_BASE + 1), 6).alias(k) for k in ("own", "wide")])


def document_key(summary: str = "summary", unit_id: str = "id") -> Column:
    name = F.regexp_extract(text.stripped(F.col(summary)), DOCUMENT, 1)
    return F.when(name != "", name).otherwise(F.col(unit_id))


def with_quota(ranked: DataFrame, limit: int, per_document: int | None) -> DataFrame:
    """The first ``limit`` rows (id, summary, score, ...) after the rows beyond a document's quota went to the end; ``pos`` from 1."""
    order = [F.desc("score"), F.asc("id")]
    rows = ranked.withColumn("late", F.lit(False))
    if per_document is not None and per_document > 0:
        rows = rows.withColumn("late", F.row_number().over(Window.partitionBy(document_key()).orderBy(*order)) > per_document)
    best = rows.orderBy("late", *order).limit(max(limit, 0))
    return best.withColumn("pos", F.row_number().over(Window.orderBy("late", *order))).drop("late")


def search(units: DataFrame | Index, request: Request) -> DataFrame:
    """``pos, id, summary, score, scope``: the units (a table or its index) that answer a request, ``scope`` being scoped or wider.

    Global evidence follows a workspace's own by score: own units get a boost, others join unless the fallback is off.
    """
    rows = fused(ranked(units, request), request)
    boost = SCOPE_BOOST / (RANK_BASE + 1) if request.aliases and request.scope_fallback == "global" else 0.0
    rows = rows.select("id", "summary", F.coalesce(F.round(F.col("own") + boost, 6), F.col("wide")).alias("score"), F.when(F.col("own").isNotNull(), "scoped").otherwise("wider").alias("scope"))
    return with_quota(rows, request.limit, request.per_document_limit).select("pos", "id", "summary", "score", "scope")


def scope_report(units: DataFrame | Index, request: Request) -> DataFrame:
    """One row: ``match_mode, scope_match, scope_suppressed`` of a request; the mode is that of the workspaces' own channels."""
    by_id = ranked(units, request).groupBy("id").agg(F.max((F.col("scope") == "own").cast("int")).alias("own"), F.collect_set(F.when(F.col("scope") == "own", F.col("channel"))).alias("c"))
    sums = by_id.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("own"), F.coalesce(F.sum(1 - F.col("own")), F.lit(0)).alias("extra"), F.array_distinct(F.flatten(F.collect_set("c"))).alias("c"))
    label = F.array_join(F.filter(F.array(*map(F.lit, WEIGHTS)), lambda k: F.array_contains("c", k)), "+")
    match = F.when((F.col("extra") > 0) & (F.col("own") > 0), "mixed").when(F.col("extra") > 0, "relaxed").otherwise("exact" if request.aliases else "global")
    return sums.select(F.when(label == "", "none").otherwise(label).alias("match_mode"), match.alias("scope_match"), F.col("extra").alias("scope_suppressed"))


def get_many(units: DataFrame, ids: list[str], searchable_only: bool = False) -> DataFrame:
    """The units of a request's ids in the order asked; unknown ids are absent, repeated ones repeated."""
    asked = units.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id string")
    rows = units.where(searchable()) if searchable_only else units
    return rows.join(F.broadcast(asked), "id").orderBy("pos")
