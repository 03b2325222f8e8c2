"""Shared pieces of the training-data operators: durable cuts of lineage, byte-bounded
Arrow slices and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.lineage import durable, shared_dir

#: Text bytes that one vectorised step of a Python worker handles; a single longer text is a step of its own.
SLICE_BYTES = 4 << 20
#: The same for steps whose arrays of numbers take some fifty times the bytes of their text.
STEP_BYTES = 1 << 20
#: Edges that a task of a round of ``components`` takes, and how many tasks a round has at least.
EDGES, TASKS = 50_000, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: for rows with whole texts."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` whose texts have about ``most`` bytes together, one row at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text array, nulls as empty, and the offsets of its rows there."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def joined_hot(rows: DataFrame, values: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """``rows`` joined with ``values`` (distinct ``key``, ``n``: rows that have it, other columns): an inner join without skew.

    Keys that have more than ``share`` of the rows are 1 / share at most; their values are broadcast and their rows stay where they are. The others
    are shuffled. Both frames are read twice, so they should be durable.
    """
    total = values.agg(F.sum("n")).first()[0] or 0
    hot = durable(values.where(F.col("n") > max(share * total, 1)).drop("n"))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(values.where(F.col("n") <= max(share * total, 1)).drop("n"), key))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long) as (node, root), root the smallest node.

    Alternating large-star and small-star steps: each round needs only the minimum over a node's
    neighbours, combined before the shuffle, and a join of the edges with those minima, so a hub's
    neighbours never meet in one task's memory. Every round is cut by a checkpoint. A round has tasks by the
    number of edges, not by that of shuffle partitions: a shuffle of few rows between many tasks is mostly empty
    blocks of files. Nodes without an edge do not appear; loops are ignored; an empty input gives an empty result.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state, tasks = None, max(TASKS, -(-edges.count() // EDGES))
    for _ in range(most_rounds):
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).coalesce(tasks)
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks)
        large = large.where("a <> b").distinct().coalesce(tasks)
        low = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = durable(small.where("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
