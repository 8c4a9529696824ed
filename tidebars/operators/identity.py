"""Fingerprints that tie a result to exactly the data it was computed from."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.config import as_utc
from tidebars.operators.catalog import ready_rows

# Fixed labels of what a universe fingerprint was computed from.
SOURCE_HASH_BASIS = "source_sha256_v1"
METADATA_BASIS = "catalog_metadata_fallback_v1"
EMPTY_BASIS = "empty_catalog_selection_v1"
FILE_METADATA_BASIS = "market_file_metadata_v1"
#: Added to the basis of a fingerprint, which is a tree digest and not one hash over all lines.
TREE = "+tree_v1"
_PREFIX = 3  # hexadecimal digits: 4096 branches of a fingerprint


def git_blob_sha1(content: Column) -> Column:
    """Object id git gives to file contents."""
    header = F.encode(F.concat(F.lit("blob "), F.length(content).cast("string")), "UTF-8")
    return F.sha1(F.concat(header, F.unhex(F.lit("00")), content))


def metadata_fingerprint(columns: Sequence[str]) -> Column:
    """Digest of a row's values as sorted compact JSON text, without its file hash."""
    named = [F.col(c).cast("string").alias(c) for c in sorted(columns) if c != "source_sha256"]
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)


def tree_digest(df: DataFrame, by: Sequence[str], line: Column, name: str) -> DataFrame:
    """SHA-256 over a group's lines as a tree, whatever their order and number.

    Each line is hashed; hashes that begin with the same ``_PREFIX`` digits are sorted,
    joined by newlines and hashed; so are these digests in order of their prefix. No
    task holds more than one prefix of one group, or one digest per prefix.
    """
    hashed = df.select(*by, F.sha2(line, 256).alias("_line"))
    branch = F.sha2(F.array_join(F.array_sort(F.collect_list("_line")), "\n"), 256)
    branches = hashed.groupBy(*by, F.substring("_line", 1, _PREFIX).alias("_prefix")).agg(branch.alias("_digest"))
    ordered = F.array_sort(F.collect_list(F.struct("_prefix", "_digest")))
    return branches.groupBy(*by).agg(F.sha2(F.array_join(ordered["_digest"], "\n"), 256).alias(name))


@dataclass(frozen=True)
class CatalogScope:
    """What a catalog was built for."""

    start: datetime
    end: datetime
    timeframes: frozenset[str]

    @classmethod
    def of(cls, summary: dict) -> CatalogScope:
        return cls(as_utc(summary["start_inclusive"]), as_utc(summary["end_exclusive"]), frozenset(map(str, summary.get("timeframes", ()))))

    def refusals(self, timeframe: str, start, end) -> list[str]:
        """Why a study may not use the catalog; empty if it may."""
        bounds = {"begin": (self.start, as_utc(start)), "end": (self.end, as_utc(end))}
        found = [f"its bars {word} at {own:%Y-%m-%d %H:%M}, the study's at {asked:%Y-%m-%d %H:%M}" for word, (own, asked) in bounds.items() if own != asked]
        return found if timeframe in self.timeframes else [*found, f"it has no {timeframe} bars"]


def check_catalog_range(summary: dict, timeframe: str, start, end) -> None:
    """A catalog may serve only the date range and timeframes it was built for."""
    if refusals := CatalogScope.of(summary).refusals(timeframe, start, end):
        raise ValueError(f"this catalog is for another study: {', and '.join(refusals)}")


def catalog_selection(catalog: DataFrame, timeframe: str) -> DataFrame:
    """Released pairs with the value that identifies their data, and its basis.

    File hashes are used only if every released row has one; otherwise the rows
    fall back to a digest of their catalog metadata.
    """
    ready = ready_rows(catalog, timeframe)
    metadata = metadata_fingerprint(catalog.columns)
    if "source_sha256" not in catalog.columns:
        return ready.select("pair", metadata.alias("value"), F.lit(METADATA_BASIS).alias("basis"))
    hashed = F.coalesce(F.length("source_sha256") == 64, F.lit(False))
    every = ready.agg(F.bool_and(hashed).alias("_hashed"))  # one row
    rows = ready.select("pair", "source_sha256", metadata.alias("_metadata")).crossJoin(F.broadcast(every))
    return rows.select(
        "pair",
        F.when(F.col("_hashed"), F.col("source_sha256")).otherwise(F.col("_metadata")).alias("value"),
        F.when(F.col("_hashed"), SOURCE_HASH_BASIS).otherwise(METADATA_BASIS).alias("basis"),
    )


def selection_basis(selection: DataFrame) -> DataFrame:
    """One row: the selection's basis, also for an empty selection."""
    return selection.agg(F.coalesce(F.max("basis"), F.lit(EMPTY_BASIS)).alias("basis"))


def universe_fingerprint(selection: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tree digest of ``pair|value`` lines."""
    return tree_digest(selection, by, F.concat_ws("|", "pair", "value"), "fingerprint")


def check_known_pairs(pairs: DataFrame, selection: DataFrame) -> None:
    unknown = pairs.select("pair").join(selection, "pair", "left_anti").orderBy("pair").limit(5).collect()
    if unknown:
        raise ValueError(f"Pairs are not present in catalog selection: {[row.pair for row in unknown]}")


def file_fingerprint(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tree digest of ``pair|file|size`` lines, for runs without a catalog."""
    line = F.concat_ws("|", "pair", "file", F.col("size_bytes").cast("string"))
    return tree_digest(files, by, line, "fingerprint")


def pair_list_fingerprint(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tree digest of the pair names."""
    return tree_digest(pairs, by, F.col("pair"), "fingerprint")


def digest_of(df: DataFrame) -> str:
    """The single digest of an ungrouped fingerprint; that of no lines if there is none."""
    row = df.first()
    return row.fingerprint if row else hashlib.sha256(b"").hexdigest()


def source_checks(sources: DataFrame, pinned: DataFrame) -> DataFrame:
    """Compare file contents (``name``, ``content``) with pinned git object ids (``name``, ``blob_sha1``)."""
    actual = git_blob_sha1(F.col("content"))
    return sources.join(pinned, "name").select(
        "name",
        actual.alias("actual_blob_sha1"),
        F.sha2("content", 256).alias("sha256"),
        (actual == F.col("blob_sha1")).alias("intact"),
    )
