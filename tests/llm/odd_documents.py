"""Rows that are hard to handle: missing values, ties, repeats, long texts, clashing columns."""

from pyspark.sql import functions as F

LONG = "Alpha beta, gamma delta. " * 30_000
TEXTS = [
    (None, None),
    (None, "no id here at all"),
    (None, "no id here at all"),
    (1, ""),
    (2, None),
    (3, " \t\n "),
    (4, "one"),
    (5, "two words"),
    (6, "The same text stands here twice, word for word, in two rows."),
    (7, "The same text stands here twice, word for word, in two rows."),
    (7, "The same text stands here twice, word for word, in two rows."),
    (7, "An id that occurs with another text."),
    (8, "Ünïcödé 日本語 😀 text ▁ with\x00odd characters"),
    (9, "12345 67890 !!! ???"),
    (10, LONG),
    (11, "x" * 200_000),
    (12, "again and again " * 400),
]
CLASHING = "kept text_sha256 owner print node score held_out predicted k1 k2 w c start n size shard row_number item_id terms quality __x __row __id __sha row root text_ key least".split()


def odd(spark, texts=TEXTS):
    rows = [(i, t, "en" if i else None, None, None) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def empty(spark):
    return odd(spark, TEXTS[:1]).limit(0)


def plain(df):
    """(id, text) of every row, a missing text as the empty one."""
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
