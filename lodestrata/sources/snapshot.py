"""One large JSON document read in ranges: the objects in its top-level lists become rows, and no row holds more than one of them.

The text is split at every closing brace, which Spark's text source does range by range. A piece is read under both assumptions, that it begins inside
a string and that it doesn't; sums over the pieces of a range, and over the few rows of the ranges, say which one holds and how deep each piece lies.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lodestrata.lineage import durable
from lodestrata.operators.ingest import SNAPSHOT
from lodestrata.operators.merge import StoreError

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_FLAT = rf"(?:{_STRING}|[^\s\[\]{{}}\",]++|\[(?:[^\[\]{{}}\"]++|{_STRING})*+\])"
#: What may stand before a list's or an object's name on the top level: the end of the last list, names with values that hold no object.
_BEFORE = rf"(?s)^\s*(?:\{{|\]|)(?:[\s,]*+{_STRING}\s*+:\s*+{_FLAT})*+[\s,]*+"
_OPENS = rf"{_BEFORE}({_STRING})\s*+:\s*+([\[{{])[\s,]*+"
#: Items before an object in its list: numbers, strings and lists of such.
_ITEMS = rf"(?s)^[\s,]*+(?:{_FLAT}[\s,]++)*+"


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _depth(clean: Column, braced: Column, inside: bool) -> Column:
    """How much deeper it is behind a piece that begins inside a string or outside."""
    whole = F.concat(F.lit('"'), clean) if inside else clean
    out = F.regexp_replace(whole, '(?s)"[^"]*(?:"|$)', "")
    ends_outside = (F.length(whole) - F.length(F.replace(whole, F.lit('"'), F.lit("")))) % 2 == 0
    return _count(out, "{[") - _count(out, "}]") - (braced & ends_outside).cast("int")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """``section, seq, element``: the objects of the top-level lists of the JSON document at ``path``, as texts, in order of ``seq`` within a section.

    ``path`` is a file, or a folder whose files in the order of their names are the document. Empty lists, values that aren't lists and items that aren't
    objects have no rows; a list whose items are lists of objects is not read. StoreError: braces, brackets or quotes do not match. Rows of one file range meet in a window; an object must fit a row.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    rows = raw.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("m"))
    rows = durable(rows)
    # a file's last piece lacks its brace unless the file ends with one
    ends = rows.groupBy("f").agg(F.max(F.struct("b", "m")).alias("last"), (F.sum(F.octet_length("value") + 1) > F.max("size")).alias("bare"))
    rows = rows.join(ends, "f").withColumn("braced", ~(F.col("bare") & (F.struct("b", "m") == F.col("last")))).drop("bare", "last", "size")
    clean = F.regexp_replace("value", r"(?s)\\.", "")
    rows = rows.select("*", (_count(clean, '"') % 2).alias("odd"), _depth(clean, F.col("braced"), False).alias("d0"), _depth(clean, F.col("braced"), True).alias("d1"))
    here = Window.partitionBy("f", "b").orderBy("m")
    earlier, blocks = here.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))

    rows = rows.withColumn("s", before("odd", earlier) % 2)
    rows = rows.withColumns({"x0": F.when(F.col("s") == 0, F.col("d0")).otherwise(F.col("d1")), "x1": F.when(F.col("s") == 0, F.col("d1")).otherwise(F.col("d0"))})
    rows = durable(rows.withColumns({"a0": before("x0", earlier), "a1": before("x1", earlier)}).drop("d0", "d1"))
    of = rows.groupBy("f", "b").agg(F.sum("odd").alias("odd"), F.sum("x0").alias("x0"), F.sum("x1").alias("x1"))
    of = of.withColumn("h", before("odd", blocks) % 2).withColumn("x", F.when(F.col("h") == 0, F.col("x0")).otherwise(F.col("x1")))
    of = durable(of.withColumn("base", before("x", blocks)))
    total = of.agg(F.coalesce(F.sum("x"), F.lit(0)), F.coalesce(F.sum("odd") % 2, F.lit(0))).first()
    if tuple(total) != (0, 0):
        raise StoreError(f"{path} is not one JSON document")

    rows = rows.join(of.select("f", "b", "h", "base"), ["f", "b"])
    inside = (F.col("s") + F.col("h")) % 2
    depth = F.col("base") + F.when(F.col("h") == 0, F.col("a0")).otherwise(F.col("a1"))
    after = depth + F.when(F.col("h") == 0, F.col("x0")).otherwise(F.col("x1"))
    text = F.concat("value", F.when(F.col("braced"), "}").otherwise(""))
    # a group of pieces ends where the depth is that of a list's items or less
    rows = rows.select("f", "b", "m", text.alias("text"), after.alias("after"), (F.col("braced") & ((inside + F.col("odd")) % 2 == 0) & (after <= 2)).alias("ends"))
    rows = durable(rows.withColumn("n", before(F.col("ends").cast("int"), earlier)))
    of = rows.groupBy("f", "b").agg(F.sum(F.col("ends").cast("int")).alias("n")).select("f", "b", before("n", blocks).alias("n_before"))
    rows = rows.join(of, ["f", "b"]).select((F.col("n") + F.col("n_before")).alias("seq"), F.struct("f", "b", "m", "text").alias("piece"), "after", "ends")
    whole = rows.groupBy("seq").agg(F.min(F.struct("piece.f", "piece.b")).alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["text"]), "").alias("text"), F.max(F.when(F.col("ends"), F.col("after"))).alias("after"))
    opens = F.when(F.col("text").rlike(_OPENS), F.struct(F.regexp_extract("text", _OPENS, 1).alias("name"), F.regexp_extract("text", _OPENS, 2).alias("mark")))
    whole = durable(whole.select("seq", "at", F.regexp_replace(F.regexp_replace("text", _OPENS, ""), _ITEMS, "").alias("element"), "after", opens.alias("own")))
    # an item without a name before it is of the list that was opened last
    whole = whole.withColumn("open", F.last("own", ignorenulls=True).over(Window.partitionBy("at").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    of = whole.groupBy("at").agg(F.max_by("open", "seq").alias("open"))
    of = of.select("at", F.last("open", ignorenulls=True).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    whole = whole.join(of, "at").withColumn("open", F.coalesce("open", "before"))
    whole = whole.where((F.col("after") == 2) & (F.col("open.mark") == "[") & F.col("element").startswith("{"))
    return whole.select(F.from_json(F.concat(F.lit("["), F.col("open.name"), F.lit("]")), "array<string>")[0].alias("section"), "seq", "element")


def read_sections(spark: SparkSession, path: str, schema: str = SNAPSHOT) -> dict[str, DataFrame]:
    """A document's lists by name, each as rows of the list's struct in ``schema`` with ``seq``, the place in the document. Absent lists are empty."""
    found = durable(elements(spark, path))
    out = {}
    for f in _schema(spark, schema).fields:
        if isinstance(f.dataType, ArrayType):
            out[f.name] = found.where(F.col("section") == f.name).select("seq", F.from_json("element", f.dataType.elementType).alias("x")).select("seq", "x.*")
    return out


def _schema(spark: SparkSession, ddl: str) -> StructType:
    return StructType.fromDDL(re.sub(r"\s+", " ", ddl))
