"""Document fingerprints: SimHash over five-word terms, found again through permuted block tables.

DataFrame functions only. Every term's hash votes, with the term's count as its weight, for or against
each of 64 bits. For lookups the bits are dealt into blocks; whichever ``radius`` bits differ, some choice of
``blocks - radius`` blocks is equal, so one table for each such choice, keyed by those blocks, finds every
fingerprint within the radius, and the whole distance decides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import durable

TERM, RADIUS, BLOCKS = 5, 3, 6
#: Rows of one stretch of the id order. Stretches only divide the work: beyond so many, which is 200 MB of text each at 100 TB, they get longer.
STRETCH, MOST_STRETCHES = 1000, 1 << 19
#: Two counters of 32 bits in a long: bits i and i + 32 of the hashes.
LANES = 0x0000000100000001


def words(text: Column) -> Column:
    """Words of the text in lower case, cut at ASCII white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+", -1), lambda w: w != "")


def terms(text: Column, term: int = TERM) -> Column:
    """Hashes of a text's terms, one for each place; of fewer words than ``term`` the whole sequence is the one term."""

    def once(value: Column, f) -> Column:  # noqa: ANN001
        """f(value) with ``value`` computed once: as the variable of a lambda."""
        return F.element_at(F.transform(F.array(value), f), 1)

    def of(hashes: Column) -> Column:
        chained = F.transform(F.slice(hashes, 1, F.size(hashes) - term + 1), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, term)]))
        return F.when(F.size(hashes) == 0, F.array().cast("array<long>")).when(F.size(hashes) <= term, F.array(F.xxhash64(hashes))).otherwise(chained)

    return once(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def fingerprints(docs: DataFrame, texts: list[str], keys: list[str], term: int = TERM) -> DataFrame:
    """``keys`` and for each column of ``texts`` the 64-bit fingerprint ``fp0, fp1, ...``: a bit is 1 if it is set in over half of the text's
    terms, a term counted as often as it occurs. Texts without words: zero.

    ``keys`` tell the rows apart. The votes are sums over the terms in generated code, two counters of 32 bits in a
    long, and no row is shuffled if ``docs`` is already dealt out by some of ``keys``.
    """
    each = docs.select(*keys, *[terms(F.col(t), term).alias(f"t{k}") for k, t in enumerate(texts)])
    size = [F.size(f"t{k}") for k in range(len(texts))]
    each = each.select(*keys, F.lit(0).alias("c0"), *[sum(size[:k], F.lit(0)).alias(f"c{k}") for k in range(1, len(texts))], F.posexplode_outer(F.concat(*[f"t{k}" for k in range(len(texts))])).alias("at", "h"))
    which = sum(((F.col("at") >= F.col(f"c{k}")).cast("int") for k in range(1, len(texts))), F.lit(0))
    votes = each.select(*keys, which.alias("which"), "h").groupBy(*keys, "which").agg(F.count("h").alias("total"), *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(LANES))).alias(f"v{i}") for i in range(32)])
    out = F.lit(0).cast("long")
    for i in range(32):
        for at, n in ((i, F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(f"v{i}", 32))):
            out = out.bitwiseOR(F.when(2 * n > F.col("total"), F.lit((1 << at) - (1 << 64 if at == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    made = votes.select(*keys, "which", out.alias("fp"))
    return made.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("which") == k, F.col("fp"))), F.lit(0).cast("long")).alias(f"fp{k}") for k in range(len(texts))])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def above(bounds: list[float], x: Column) -> Column:
    """How many of the sorted ``bounds`` are ``x`` or less, by binary search; 0 for null."""
    array = F.array(*map(F.lit, bounds)).cast("array<double>")
    span = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halved(at: Column, _: Column) -> Column:
        mid = F.floor((at["low"] + at["high"]) / 2).cast("int")
        right = (at["low"] < at["high"]) & (F.get(array, mid) <= x)
        return F.struct(F.when(right, mid + 1).otherwise(at["low"]).alias("low"), F.when(right, at["high"]).otherwise(mid).alias("high"))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), span, halved, lambda at: at["low"])
    return F.when(x.isNull(), F.lit(0)).otherwise(found)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``stretch, place, doc_id, text, next_text, edge`` in ascending (doc_id, text), nulls first, the last followed by the first.

    The order is cut into stretches at quantiles of the ids. Each stretch also has a copy of the next one's first
    row (``edge`` true; no result row), so a window over a stretch sees every row's follower.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = rows.count()
    parts = min(MOST_STRETCHES, max(1, -(-n // STRETCH)))
    ids = rows.select(F.col("doc_id").cast("double").alias("x")).where("x is not null")
    bounds = sorted(set(ids.approxQuantile("x", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    rows = rows.withColumn("stretch", above(bounds, F.col("doc_id").cast("double"))).withColumn("edge", F.lit(False))
    heads = rows.groupBy("stretch").agg(F.min(F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(1)).alias("known"), F.min("doc_id").alias("id")).orderBy("stretch").collect()
    if not heads:
        return rows.select("stretch", F.lit(0).alias("place"), "doc_id", "text", F.lit(None).cast("string").alias("next_text"), "edge")
    before = {h.stretch: heads[k - 1].stretch for k, h in enumerate(heads)}
    table = docs.sparkSession.createDataFrame([(h.stretch, before[h.stretch], None if h.known == 0 else h.id) for h in heads], "s int, to int, id bigint")
    edge = rows.join(F.broadcast(table), (F.col("stretch") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("id"))).groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    both = rows.unionByName(edge.select(F.col("to").alias("stretch"), "doc_id", "text", F.lit(True).alias("edge")))
    order = Window.partitionBy("stretch").orderBy("edge", F.asc_nulls_first("doc_id"), "text")
    return both.select("stretch", F.row_number().over(order).alias("place"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "edge")


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n/4) code points replaced by the first as many, or all, of ``other``."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(other, F.lit(1), cut))


def tables(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``fps`` once for each permuted table: ``t`` and ``k``, the value of the blocks that lead there."""
    return fps.select("*", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks(radius, blocks)])).alias("t", "k"))


def masks(radius: int, blocks: int) -> list[int]:
    edge = [64 * k // blocks for k in range(blocks + 1)]
    own = [sum(1 << b for b in range(edge[k], edge[k + 1])) for k in range(blocks)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(own[k] for k in some) for some in combinations(range(blocks), blocks - radius))]


def within(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``query, fp, distance``: all of ``fps`` within ``radius`` of each distinct value of ``queries`` (both: column fp).

    A pair that several tables hold is taken from the first of them. Null fingerprints match nothing.
    """
    left = tables(queries.select("fp").distinct(), radius, blocks).withColumnRenamed("fp", "query")
    right = tables(fps.select("fp").distinct(), radius, blocks)
    x = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)) for i, m in enumerate(masks(radius, blocks))])
    return left.join(right, ["t", "k"]).where((F.bit_count(x) <= radius) & (first == F.col("t"))).select("query", "fp", F.bit_count(x).alias("distance"))


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", term: int = TERM) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp``: fingerprints of every text, its edited text and its follower.

    Null text: empty. Null ids come first in the order, equal ids go by text, repeated rows are documents of their
    own. Other columns are ignored. One document follows itself. No rows give no rows.
    """
    pair = with_next(docs, doc_id, text)
    made = pair.select("stretch", "place", "doc_id", "edge", F.length("text").cast("long").alias("n_chars"), F.when(F.col("edge"), "").otherwise(edited(F.col("text"), F.coalesce("next_text", F.lit("")))).alias("e"), "text")
    made = made.withColumn("edited_sha256", F.sha2(F.encode("e", "UTF-8"), 256))
    made = fingerprints(made, ["text", "e"], ["stretch", "place", "doc_id", "edge", "n_chars", "edited_sha256"], term)
    order = Window.partitionBy("stretch").orderBy("place")
    made = made.select("doc_id", "n_chars", "edited_sha256", F.col("fp0").alias("fp"), F.col("fp1").alias("edited_fp"), F.lead("fp0").over(order).alias("next_fp"), "edge")
    return made.where("not edge").drop("edge")
