"""Line dedup by site-relative frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line on more than this share of its host's pages is boilerplate ...
RATIO = 0.1
#: ... if it is on so many of them at least: on a host of a few pages every line has a large share.
MIN_PAGES = 3
#: Bytes of per-host line lists up to which they are broadcast; beyond it the tables are joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Parts into which a host's pages are dealt then, each with a copy of its lines.
SALTS = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, lines``: for each host the lines to drop; hosts without any are absent.

    A page counts once for a line, however often it has it; blank lines are never dropped. Lines count
    as equal when they are the same after trimming spaces. Counts are combined before the shuffle, so a
    host with a third of all pages sends no more than a row per line and task. A host's list has at most
    (mean lines per page) / ratio entries, whatever its size.
    """
    pages = docs.select(F.coalesce(F.col(host), F.lit("")).alias("h"), F.array_distinct(F.transform(lines_of(F.col(text)), F.trim)).alias("l"))
    totals = pages.groupBy("h").agg(F.count("*").alias("pages"))
    counts = pages.select("h", F.explode("l").alias("l")).where("l <> ''").groupBy("h", "l").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(F.broadcast(totals) if few(totals) else totals, "h").where(F.col("n") > ratio * F.col("pages")).groupBy("h").agg(F.collect_list("l").alias("lines"))


def few(rows: DataFrame, most: int = 100_000) -> bool:
    return rows.limit(most + 1).count() <= most


def drop_site_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with ``text`` rid of its host's boilerplate lines; all rows and columns stay.

    Null host: the host ''. Null text stays null and counts as a page with no lines. Repeated rows are
    pages of their own. A text whose lines all go becomes empty. Texts of any length stay in their row; only
    lines are counted elsewhere. Other columns are kept as they are, whatever their names.
    """
    from lodestrata.llm.common import durable

    names = docs.columns
    of = {c: f"c{i}" for i, c in enumerate(names)}
    plain = docs.select(*[F.col(f"`{c}`").alias(v) for c, v in of.items()])
    own, site = F.col(of[text]), F.coalesce(F.col(of[host]), F.lit(""))
    drop = durable(boilerplate(docs, host, text, ratio, min_pages))
    size = drop.agg(F.coalesce(F.sum(F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 32)), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        joined = plain.join(F.broadcast(drop), site == F.col("h"), "left")
    else:
        salt = F.pmod(F.xxhash64(own, F.spark_partition_id()), F.lit(SALTS)).cast("int")
        dealt = drop.select("h", "lines", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
        joined = plain.withColumn("salt", salt).join(dealt, (site == F.col("h")) & (F.col("salt") == F.col("part")), "left")
    kept = F.filter(lines_of(own), lambda x: ~F.array_contains(F.col("lines"), F.trim(x)))
    new = F.when(own.isNull() | F.col("lines").isNull(), own).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[(new if c == text else F.col(v)).alias(c) for c, v in of.items()])
