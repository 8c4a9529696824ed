"""Corpus preparation: quality, exact and near duplicates, benchmark leaks, piece ids.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.decontaminate import drop_contaminated
from tidebars.llm.documents import free_names, keep_rows, read_table
from tidebars.llm.exact_dedup import exact_duplicates
from tidebars.llm.pieces import encode_pieces
from tidebars.llm.quality import fit_quality, keep_quality
from tidebars.llm.simhash import alike_rows
from tidebars.llm.similar import similar_groups
from tidebars.session import stage

ORACLE_SQL = None  # SQL cannot express the classifier; tests compare with a brute-force version


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows the classifier rejects go. It learns from the labelled rows of this stage's input."""
    return keep_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; of repeated rows one."""
    return keep_rows(docs, exact_duplicates(docs).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays.

    Links of SimHash fingerprints within 3 bits, found in blocks of bits, are candidates. Rows
    are linked if they share 0.8 or more of their five-word shingles, checked on the shingles.
    Such texts often differ in more than 3 bits, so MinHash bands give further candidates. Texts
    without words are one group. Rows are numbered once, in a written copy, so
    missing and repeated ids do not matter; of equal ids in a group the first row stays.
    """
    (name,) = free_names(docs, "__row")
    numbered = stage(docs.withColumn(name, F.monotonically_increasing_id()))
    row, doc_id = F.col(name).alias("row"), F.col("doc_id").alias("doc_id")
    texts = numbered.select(row, F.col("text").alias("text"))
    groups = similar_groups(texts, alike_rows(texts.withColumnRenamed("row", "doc_id")))
    named = stage(groups.join(numbered.select(row, doc_id), "row"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = named.groupBy("root").agg(F.min(order).alias("first")).select("root", F.col("first.row").alias("first"))
    gone = named.join(first, "root").filter("row <> first").select(F.col("row").alias(name))
    return numbered.join(gone, name, "left_anti").select(*[numbered[f"`{c}`"] for c in docs.columns])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item by 80 % or more of its shingles go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and decoded text of every document left."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("benchmark decontamination", leaks),
    ("piece encoding", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each stage's result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
    return docs
