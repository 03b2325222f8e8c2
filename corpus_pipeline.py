"""A training corpus from the documents table, in five stages.

Each stage takes the session, the documents that its predecessor kept and the folder of the tables. All but the
last return rows with the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, lines, packing, quality, simhash
from lodestrata.llm.common import table, written
from lodestrata.llm.queries import tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject as low quality or toxic."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def without_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their host's boilerplate lines; ``n_chars`` follows the text."""
    return lines.drop_site_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key that is never null and different in every row, and the key's name, which no column of ``docs`` has: ordered by id, null ids
    last. Written, so that it is the same at each use."""
    name = "__key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return written(docs.withColumn(name, F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row")))), name


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8), whatever the ids."""
    rows, key = keyed(docs)
    return simhash.without_near_copies(rows, key).drop(key)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a copy of a benchmark item, whatever the ids."""
    rows, key = keyed(docs)
    return decontaminate.decontaminated(rows, table(spark, sf_dir, "benchmark"), key).drop(key)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length, each a sequence."""
    out = packing.pack(docs, tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_site_lines),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", without_test_items),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the alignment; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each keeps is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs), sf_dir)
    return docs
