"""Near duplicates by word shingles: pairs met elsewhere and MinHash bands are candidates, shingle sets decide them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.components import components, more_links
from tidebars.llm.documents import LOWER, UPPER
from tidebars.llm.phrases import _FACTORS, _Hashes, sequence_hashes, split_words, word_blocks
from tidebars.session import stage

SHINGLE_WORDS = 5
FIFTHS = 4  # linked from so many fifths of shared shingles on
BANDS, ROWS = 30, 5  # at 0.8 a pair shares no band with a chance of (1 - 0.8^5)^30 = 7e-6
WORDS = 16  # longs of a row's bit table: GROUPS of shingles by hash, DEPTH bits each
DEPTH = 4
GROUPS = 64 * WORDS // DEPTH
LEAST_EQUAL = 90  # of the BANDS * ROWS minima; a pair at 0.8 has fewer with a chance under 1e-8
_LOWER = str.maketrans(UPPER, LOWER)
_U = np.uint64
_DRAW = np.random.default_rng(42)
_XOR, _TIMES = (_DRAW.integers(0, 2**64, (BANDS * ROWS, 1), _U, endpoint=False) for _ in range(2))
_TIMES |= _U(1)


def shingles(text: str, hashes: _Hashes) -> np.ndarray:
    """64-bit hashes of the distinct shingles of the whole text, in order.

    A text of fewer words is one shingle of them all; texts without words are alike.
    """
    text = text.translate(_LOWER)
    parts = [np.unique(sequence_hashes(h, SHINGLE_WORDS, _FACTORS[0])) for _, _, h in word_blocks(text, hashes, SHINGLE_WORDS)]
    return np.unique(np.concatenate(parts)) if parts else np.array([xxhash.xxh64_intdigest(b" ".join(split_words(text)))], _U)


def minima(values: np.ndarray) -> np.ndarray:
    """The least value of each permutation."""
    least = np.full(BANDS * ROWS, 2**64 - 1, _U)
    for i in range(0, len(values), 512):
        np.minimum(least, ((values[i : i + 512] ^ _XOR) * _TIMES).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key a band, equal for equal minima of its permutations."""
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], _U).view(np.int64)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else [], kind))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        sizes, keys, sketches = [], [], []
        for text in batch.column(1).to_pylist():
            values = shingles(text, hashes)
            least = minima(values)
            sizes.append(len(values))
            keys.append(band_keys(least))
            sketches.append((least >> _U(48)).astype(np.uint16).view(np.int16))
        columns = [batch.column(0), pa.array(sizes, pa.int64()), _lists(keys, pa.int64()), _lists(sketches, pa.int16())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "size", "keys", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            found = [np.unique((shingles(t, hashes) >> _U(32)).astype(np.uint32).view(np.int32)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(found, pa.int32())], names=["row", "own"])


def _like(shared: Column, sizes: Column) -> Column:
    """Whether two sets of ``sizes`` together share four fifths of their union."""
    return 5 * shared >= FIFTHS * (sizes - shared)


def _close(a: str, b: str) -> Column:
    """Sizes and minima do not rule a pair out."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    equal = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, e: s + e)
    return (5 * F.least(x, y) >= FIFTHS * F.greatest(x, y)) & (equal >= LEAST_EQUAL)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs ``a, b`` that are alike, by the shingles of both rows.

    Both joins deal the sets by row, so they travel once; with them goes one set a pair.
    Of a row that is second in many pairs Spark splits the pairs.
    """
    one = pairs.join(sets.select(F.col("row").alias("b"), F.col("own").alias("of_b")), "b")
    both = one.join(sets.select(F.col("row").alias("a"), F.col("own").alias("of_a")), "a")
    return both.filter(_like(F.size(F.array_intersect("of_a", "of_b")), F.size("of_a") + F.size("of_b"))).select("a", "b")


def bit_table(core: np.ndarray) -> tuple[np.ndarray, int]:
    """As many bits set in each group as shingles fall into it, ``DEPTH`` at most, and how many
    shingles found no bit. Two rows share no more shingles than bits plus such shingles."""
    counts = np.bincount(core.astype(np.int64) % GROUPS, minlength=GROUPS)
    bits = np.arange(DEPTH) < counts[:, None]
    return np.packbits(bits.ravel(), bitorder="little").view(np.int64), int(np.maximum(counts - DEPTH, 0).sum())


def _bounds(sets: DataFrame) -> DataFrame:
    """``row, core, over, w0, ...``: how many shingles another row of ``sets`` has too, and
    their bit table."""
    single = sets.select("row", F.explode("own").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("row").alias("row")).filter("n = 1")
    alone = single.groupBy("row").agg(F.collect_list("shingle").alias("alone"))  # no more than the row's own set
    names = [f"w{i}" for i in range(WORDS)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.setdiff1d(own, alone or [], assume_unique=True) for own, alone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            tables = [bit_table(core) for core in rows]
            words = np.array([w for w, _ in tables], np.int64).reshape(-1, WORDS)
            columns = [batch.column(0), pa.array([len(c) for c in rows], pa.int64()), pa.array([o for _, o in tables], pa.int64()), *[pa.array(w) for w in words.T]]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "core", "over", *names])

    kinds = ", ".join(f"{c} long" for c in ["row", "core", "over", *names])
    return sets.join(alone, "row", "left").select("row", "own", "alone").mapInArrow(counted, kinds)


def _may_share(a: str, b: str) -> Column:
    """The bounds of both rows leave room for a link; no link fails this."""
    sizes = F.col(f"{a}.size") + F.col(f"{b}.size")
    most = F.least(f"{a}.over", f"{b}.over")
    for i in range(WORDS):
        most += F.bit_count(F.col(f"{a}.w{i}").bitwiseAND(F.col(f"{b}.w{i}")))
    return _like(F.least(f"{a}.core", f"{b}.core"), sizes) & _like(most, sizes)


def similar_groups(texts: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """``row, root`` of every row (``row, text``; rows differ) linked to another; root is the
    least row reached. A missing text counts as the empty one.

    Rows are linked if their sets of five-word shingles share four fifths or more of
    their union; every link is checked on the sets (32-bit hashes). Rows meet if they are
    a pair of ``met`` (``a, b``, found by other means) or if any
    band of MinHash values agrees, and each bucket then needs no more links than
    join the components in it:

    1. Each row of a bucket is compared with the least one, and the pairs of ``met``.
    2. In buckets that still hold several components, shingles that no other row has
       are set aside. A row with too many of them can have no link and goes; the others
       are compared with the row that has the smallest share of them, which in a family of
       near copies is closest to all.
    3. What is left are pairs across components. They are looked up by bucket, but bit tables
       of their shingles bound what a pair can share, so that hardly any without a link
       is compared.

    Pairs that could be linked are never left out but for those of too few equal minima
    (``LEAST_EQUAL``).
    """
    texts = texts.select("row", F.coalesce("text", F.lit("")).alias("text"))
    signed = stage(texts.mapInArrow(_signed, "row long, size long, keys array<long>, sketch array<smallint>"))
    sketches = signed.select("row", "size", "sketch")
    keyed = signed.select("row", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("least")).filter("n > 1")
    members = stage(keyed.join(shared, "key"))

    def likely(pairs: DataFrame, rows: DataFrame, condition: Column) -> DataFrame:
        met = pairs.join(rows.alias("x"), F.col("a") == F.col("x.row")).join(rows.alias("y"), F.col("b") == F.col("y.row"))
        return stage(met.filter(condition).select("a", "b"))

    stars = members.filter("row <> least").select(F.col("row").alias("a"), F.col("least").alias("b"))
    if met is not None:
        stars = stars.unionAll(met.select("a", "b"))
    stars = likely(stars.distinct(), sketches, _close("x", "y"))
    wanted = stars.select(F.col("a").alias("row")).unionAll(stars.select("b")).unionAll(members.filter("n > 2").select("row")).distinct()
    sets = stage(texts.join(wanted, "row", "left_semi").mapInArrow(_sets, "row long, own array<int>"))
    roots = components(_linked(stars, sets))

    def mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows of buckets that hold several components, with their roots."""
        placed = rows.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        several = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("key")
        return placed.join(several, "key", "left_semi")

    open_ = stage(mixed(members.filter("n > 2").select("key", "row"), roots).select("key", "row"))
    if open_.isEmpty():
        return roots.withColumnRenamed("node", "row")
    bounds = stage(_bounds(stage(sets.join(open_.select("row").distinct(), "row", "left_semi"))).join(sketches, "row"))
    known = open_.join(bounds.select("row", "size", "core"), "row")
    smallest = known.groupBy("key").agg(F.min("size").alias("smallest"))
    partner = F.greatest(F.col("smallest"), "core", F.ceil(F.col("size") * FIFTHS / 5))
    alive = stage(known.join(smallest, "key").filter(_like(F.col("core"), F.col("size") + partner)).select("key", "row", (1 - F.col("core") / F.col("size")).alias("own_share")))
    centre = alive.groupBy("key").agg(F.min(F.struct("own_share", "row")).alias("c")).select("key", F.col("c.row").alias("b"))
    stars = alive.join(centre, "key").filter("row <> b").select(F.col("row").alias("a"), "b").distinct()
    roots = more_links(roots, _linked(likely(stars, bounds, _may_share("x", "y") & _close("x", "y")), sets))
    rest = stage(mixed(alive.select("key", "row"), roots).join(bounds, "row"))
    x, y = rest.alias("x"), rest.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.row") < F.col("y.row")) & (F.col("x.root") != F.col("y.root"))
    open_pairs = x.join(y, apart & _may_share("x", "y") & _close("x", "y")).select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct()
    return more_links(roots, _linked(stage(open_pairs), sets)).withColumnRenamed("node", "row")
