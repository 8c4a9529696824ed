"""Common reading of document tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = "no id"
_SEPARATOR = re.compile(r"[ \t-\r]")


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, a missing text as the empty one; other columns cannot clash."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def id_key(id_col: Column) -> Column:
    """A join key that also matches missing ids."""
    return F.coalesce(id_col.cast("string"), F.lit(NO_ID))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores after it until no column is called so."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` named by ``decided`` (``doc_id``, ``text_sha256``), of rows named twice one.

    Columns and their order are those of ``docs``. The join and the removal of
    repeated rows share one shuffle on (id, digest).
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    names = free_names(docs, "__id", "__sha")
    keyed = docs.withColumns(dict(zip(names, [id_key(F.col(f"`{id_col}`")), F.sha2(text, 256)], strict=True)))
    wanted = decided.select(id_key(F.col("doc_id")).alias(names[0]), F.col("text_sha256").alias(names[1]))
    return keyed.join(wanted, names, "left_semi").dropDuplicates(names).select(
        *[keyed[f"`{c}`"] for c in docs.columns]
    )


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the identifier as text, modulo; missing for a missing identifier."""
    return F.crc32(id_col.cast("string").cast("binary")) % divisor


def text_blocks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The whole text in blocks that end after one of the six separators of words, so
    that one very long text is never held several times over and no word is cut. A block
    takes in its last word however long that is."""
    at = 0
    while at < len(text):
        cut = _SEPARATOR.search(text, min(at + size, len(text)) - 1)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end
