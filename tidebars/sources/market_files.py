"""Market files: one OHLCV file per instrument and timeframe.

Names look like ``BTC_USDT_USDT-1m-futures.parquet``; files of other kinds in the
same folder are ignored. All formats give one long table of bars.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.config import as_utc
from tidebars.session import prepare, stage

# Fixed naming pattern of the files and fixed column names of their contents.
FILE_PATTERN = r"^(.+)-([^-]+)-futures\.(feather|parquet|json|json\.gz)$"
COLUMNS = ("date", "open", "high", "low", "close", "volume")
FILE_KEYS = ("pair", "timeframe", "file")
_RAW = "path string, row_index bigint, date timestamp, " + ", ".join(f"{c} double" for c in COLUMNS[1:])
_RAW += ", problem string"  # why a file cannot be read, in a row of its own
_DAMAGE = (ValueError, TypeError, OSError, pa.ArrowException)
# Parquet files up to this size are read at once: what Spark counts for opening a file.
SMALL_BYTES = 4 << 20
_BYTES_PER_TASK = 64 << 20
_OLDEST = int(datetime(1900, 1, 1, tzinfo=timezone.utc).timestamp())  # moments before it may be of another calendar
_BARS = ", ".join(f"{c} string" for c in FILE_KEYS) + ", date timestamp, " + ", ".join(f"{c} double" for c in COLUMNS[1:])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def decode_pair(symbol: Column) -> Column:
    """``A_B_USDT_USDT`` -> ``A_B/USDT:USDT``; fewer than three parts is an error."""
    decoded = F.regexp_replace(symbol, r"^(.+)_([^_]*)_([^_]*)$", r"$1/$2:$3")
    problem = F.concat(F.lit("Unsupported futures filename symbol: "), symbol)
    return F.when(decoded != symbol, decoded).otherwise(F.raise_error(problem).cast("string"))


def with_file_identity(df: DataFrame, path: str = "path") -> DataFrame:
    """Split the file name into ``file``, ``pair``, ``timeframe`` and ``extension``."""
    name = file_name(F.col(path))
    part = lambda group: F.regexp_extract(F.col("file"), FILE_PATTERN, group)
    return (
        df.withColumn("file", name)
        .filter(F.col("file").rlike(FILE_PATTERN))
        .withColumns({"pair": decode_pair(part(1)), "timeframe": part(2), "extension": part(3)})
    )


def _require_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not (fs.exists(path) and fs.getFileStatus(path).isDirectory()):
        raise FileNotFoundError(f"Data directory does not exist: {folder}")


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def _load(spark: SparkSession, reader: DataFrameReader, paths: list[str]) -> DataFrame:
    """What ``reader`` makes of listed files, which may be many: their names reach the JVM in one
    call, and each task that looks them up takes many."""
    names = spark._jvm.org.apache.commons.lang3.StringUtils.split("\0".join(paths), "\0")
    with _setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(_tasks(spark))):
        return reader._df(reader._jreader.load(names))


def _tasks(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


def _contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _load(spark, spark.read.format("binaryFile"), paths).select("path", "content")


def discover(spark: SparkSession, folder: str, timeframe: str | None = None) -> DataFrame:
    """Market files of a folder (not of its subfolders), by pair; contents are not read."""
    return listed_files(spark, folder, timeframe).orderBy("pair", "timeframe", "file")


def listed_files(spark: SparkSession, folder: str, timeframe: str | None = None) -> DataFrame:
    """The same in no order, which would look up every file twice."""
    _require_folder(spark, folder)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"*-{timeframe or '*'}-futures.*").load(folder).coalesce(_tasks(spark))
    found = with_file_identity(listed.select("path", F.col("length").alias("size_bytes"), "modificationTime"))
    if timeframe:
        found = found.filter(F.col("timeframe") == timeframe)
    return found.select(*FILE_KEYS, "extension", "size_bytes", "path")


def with_file_hash(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Add ``source_sha256``, the digest of each file's bytes; no other file is opened."""
    paths = _paths(files)
    if not paths:
        return files.withColumn("source_sha256", F.lit(None).cast("string"))
    hashed = _contents(spark, paths).select("path", F.sha2(F.col("content"), 256).alias("source_sha256"))
    return files.join(hashed, "path", "left")


def _paths(files: DataFrame) -> list[str]:
    """The file table's paths: one short row a file, as any explicit list of files needs."""
    return sorted(row.path for row in files.select("path").toLocalIterator())


def _require_columns(names, where: str) -> None:
    missing = sorted(set(COLUMNS) - {name.lower() for name in names})
    if missing:
        raise ValueError(f"{where} is missing columns: {', '.join(missing)}")


def _epoch_or_text(value: Column) -> Column:
    """Moment written as epoch milliseconds or as ISO-8601 text."""
    millis = value.try_cast("double")
    return F.when(millis.isNotNull(), F.timestamp_millis(millis.cast("long"))).otherwise(
        F.try_to_timestamp(value)
    )


# -- Parquet by footers -----------------------------------------------------------------


def _bar_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """Types of the bar columns of one file if Spark can read them as bars, from its footer."""
    try:
        with _setting(spark, "spark.sql.legacy.parquet.nanosAsLong", "true"):  # how pandas writes dates
            found = {f.name.lower(): f.dataType for f in spark.read.parquet(path).schema}
    except Exception as damage:  # not a Parquet file, or types Spark does not know
        if isinstance(damage, (AnalysisException, Py4JJavaError, PySparkException)):
            return None
        raise
    numbers = (T.NumericType, T.StringType)
    if not all(isinstance(found.get(c), numbers) for c in COLUMNS[1:]):
        return None
    if not isinstance(found.get("date"), (T.TimestampType, T.TimestampNTZType, T.LongType)):
        return None
    return T.StructType([T.StructField(c, found[c]) for c in COLUMNS])


def _with_moments(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.TimestampType() if f.name == "date" else f.dataType) for f in schema])


def group_by_footer(spark: SparkSession, paths: list[str]) -> tuple[list[tuple[T.StructType, list[str]]], list[str]]:
    """Parquet files by the types of their bar columns, and those that need a closer look.

    Row counts come from the footers alone, in one job over all files. Files are then
    decoded with the types of the first one not yet settled; those that give all the
    rows of their footer are good and can be scanned split by row groups, pruned and
    filtered. There is one such job for each distinct set of types. Files that no set of
    types reads whole are torn, hold no rows or lack a column.
    """
    tolerant = spark.read.option("ignoreCorruptFiles", "true")
    name = F.col("_metadata.file_name").alias("name")
    if not paths:
        return [], []
    footers = _load(spark, tolerant.format("parquet").schema("no_such_column string"), paths).groupBy(name).count()
    rows = {r.name: r["count"] for r in footers.toLocalIterator()}
    short = lambda path: path.rsplit("/", 1)[-1]
    waiting, odd = [p for p in paths if short(p) in rows], [p for p in paths if short(p) not in rows]
    groups: list[tuple[T.StructType, list[str]]] = []
    tried: set[str] = set()
    while waiting:
        schema = _bar_schema(spark, waiting[0])
        if schema is None or schema.json() in tried:
            odd.append(waiting.pop(0))
            continue
        tried.add(schema.json())
        # Spark reads any 64-bit moment as a long, but only true ones as a moment: those first
        for own in (_with_moments(schema), schema) if isinstance(schema["date"].dataType, T.LongType) else (schema,):
            if not waiting:
                break
            counts = [F.count(c).alias(f"n_{c}") for c in COLUMNS]  # every column must be decoded to be counted
            decoded = _load(spark, tolerant.format("parquet").schema(own), waiting).groupBy(name).agg(F.count(F.lit(1)).alias("n"), *counts)
            whole = {r.name for r in decoded.toLocalIterator() if r.n == rows[r.name] and all(r[f"n_{c}"] for c in COLUMNS)}
            if good := [p for p in waiting if short(p) in whole]:
                groups.append((own, good))
            waiting = [p for p in waiting if short(p) not in whole]
    return groups, sorted(odd)


def _scan(spark: SparkSession, schema: T.StructType, paths: list[str], start, end) -> DataFrame:
    """Bars of files of one schema; the range is cut on the stored column, so that row groups
    outside it are not read."""
    df, stored = _load(spark, spark.read.format("parquet").schema(schema), paths), F.col("date")
    nanos = isinstance(schema["date"].dataType, T.LongType)
    for limit, keep in ((start, Column.__ge__), (end, Column.__lt__)):
        if limit is not None:
            moment = as_utc(limit)
            df = df.filter(keep(stored, F.lit(int(moment.timestamp()) * 10**9 + moment.microsecond * 1000) if nanos else F.lit(moment)))
    date = F.timestamp_micros(F.expr("date div 1000")) if nanos else stored.cast("timestamp")
    return df.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.row_index").alias("row_index"),
        date.alias("date"),
        *[F.col(c).try_cast("double").alias(c) for c in COLUMNS[1:]],
        F.lit(None).cast("string").alias("problem"),
    )


# -- small Parquet files --------------------------------------------------------------------


def _plain_bars(content: pa.Buffer) -> tuple[np.ndarray, np.ndarray] | None:
    """Moments (microseconds, of nanoseconds the whole ones) and prices of the complete rows of a
    Parquet file, in order; None if it needs a closer look.

    Taken are files of signed numbers and moments that give all rows of their footer and something in
    every column, which Spark reads to the same values.
    """
    from pyarrow import parquet

    file = parquet.ParquetFile(pa.BufferReader(content), coerce_int96_timestamp_unit="us")
    stored = [c for c in map(file.schema.column, range(len(file.schema))) if c.path.split(".")[0].lower() in COLUMNS]
    if sorted(c.path.lower() for c in stored) != sorted(COLUMNS) or any(c.max_repetition_level for c in stored):
        return None
    names = {c.path.lower(): c.path for c in stored}
    table = file.read([names[c] for c in COLUMNS], use_threads=False)
    date, *numbers = (table.column(names[c]) for c in COLUMNS)
    number = lambda t: pa.types.is_float64(t) or pa.types.is_float32(t) or pa.types.is_signed_integer(t)
    if not pa.types.is_timestamp(date.type) or not all(number(c.type) for c in numbers):
        return None
    if not 0 < table.num_rows == file.metadata.num_rows or any(c.null_count == table.num_rows for c in (date, *numbers)):
        return None
    moments = date.to_numpy()
    known, ticks = ~np.isnat(moments), moments.view(np.int64)
    per_second = {"s": 1, "ms": 10**3, "us": 10**6, "ns": 10**9}[date.type.unit]
    if ticks[known].min() < (0 if per_second > 10**6 else _OLDEST * per_second):
        return None
    prices = np.array([c.to_numpy() for c in numbers], dtype=float)  # missing is NaN
    whole = known & ~np.isnan(prices).any(axis=0)
    ticks, prices = ticks[whole], prices[:, whole]
    return ticks // 1000 if per_second > 10**6 else ticks * (10**6 // per_second), prices


def _last_of_bar(micros: np.ndarray) -> np.ndarray:
    """Rows that are the last of their moment."""
    if (micros[1:] > micros[:-1]).all():
        return np.arange(len(micros))
    order = np.argsort(micros, kind="stable")
    sorted_micros = micros[order]
    return order[np.append(sorted_micros[1:] != sorted_micros[:-1], True)]


def _read_small(spark: SparkSession, paths: list[str], size: int, start, end) -> tuple[DataFrame, list[str]]:
    """Clean bars of small Parquet files within [start, end), and the files that need a closer look.

    Each file is opened once. A bar has all its rows in one file, so the task that decodes it keeps
    the last one, and no row is shuffled. Bars are written once.
    """
    fields = [(c, pa.string()) for c in FILE_KEYS] + [("date", pa.timestamp("us", "UTC"))]
    schema = pa.schema([*fields, *[(c, pa.float64()) for c in COLUMNS[1:]], ("unsettled", pa.string())])
    limits = [None if limit is None else as_utc(limit) for limit in (start, end)]
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    first, last = (None if limit is None else (limit - epoch) // timedelta(microseconds=1) for limit in limits)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in FILE_KEYS), strict=True))
            held, rows = [], 0
            for key, path, content in zip(keys, batch["path"].to_pylist(), batch["content"], strict=True):
                try:
                    plain = _plain_bars(content.as_buffer())
                except _DAMAGE:
                    plain = None
                if plain is None:
                    held.append(pa.RecordBatch.from_pylist([{"unsettled": path}], schema=schema))
                    continue
                micros, prices = plain
                kept = _last_of_bar(micros)
                if first is not None:
                    kept = kept[micros[kept] >= first]
                if last is not None:
                    kept = kept[micros[kept] < last]
                n = len(kept)
                columns = [pa.array(micros[kept].view("M8[us]"), schema.field("date").type), *map(pa.array, prices[:, kept])]
                held.append(pa.RecordBatch.from_arrays([*[pa.repeat(k, n) for k in key], *columns, pa.nulls(n, pa.string())], schema=schema))
                rows += n
                if rows >= 65_536:
                    yield pa.concat_batches(held)
                    held, rows = [], 0
            if held:
                yield pa.concat_batches(held)

    named = with_file_identity(_contents(spark, paths)).select(*FILE_KEYS, "path", "content")
    tasks = max(_tasks(spark), -(-size // _BYTES_PER_TASK))
    read = stage(named.coalesce(tasks).mapInArrow(decode, _BARS + ", unsettled string"))
    unsettled = [r.unsettled for r in read.filter("unsettled is not null").select("unsettled").toLocalIterator()]
    return read.filter("unsettled is null").drop("unsettled"), sorted(unsettled)


# -- files that one task decodes ----------------------------------------------------------


def _bar_columns(table: pa.Table, path: str, start: int = 0) -> pd.DataFrame:
    table = table.rename_columns([name.lower() for name in table.column_names])
    _require_columns(table.column_names, path.rsplit("/", 1)[-1])
    frame = table.select(list(COLUMNS)).to_pandas()
    out = pd.DataFrame({"path": path, "row_index": range(start, start + len(frame))})
    out["date"] = pd.to_datetime(frame["date"], utc=True).astype("datetime64[us, UTC]")
    for column in COLUMNS[1:]:
        out[column] = pd.to_numeric(frame[column], errors="coerce").astype(float)
    out["problem"] = None
    return out


def _decode_feather(path: str, content: bytes) -> Iterator[pd.DataFrame]:
    from pyarrow import feather

    yield _bar_columns(feather.read_table(io.BytesIO(content)), path)


def _decode_parquet(path: str, content: bytes) -> Iterator[pd.DataFrame]:
    """Row group by row group, once all of them have been read to the rows the footer names."""
    from pyarrow import parquet

    file = parquet.ParquetFile(io.BytesIO(content))
    names = [name for name in file.schema_arrow.names if name.lower() in COLUMNS]
    groups = lambda: (file.read_row_group(i, columns=names) for i in range(file.num_row_groups))
    _bar_columns(file.schema_arrow.empty_table(), path)
    rows = sum(len(_bar_columns(table, path)) for table in groups())
    if rows != file.metadata.num_rows:
        raise ValueError(f"{rows} of {file.metadata.num_rows} rows can be read")
    start = 0
    for table in groups():
        yield _bar_columns(table, path, start)
        start += len(table)


def _read_each(spark: SparkSession, paths: list[str], decoder: Callable, skip: bool) -> DataFrame:
    """One task decodes one file and passes it on in batches; a file is read whole or not at all."""
    rows_per_batch = 65_536

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                try:
                    for out in decoder(path, content.as_py()):
                        for start in range(0, len(out), rows_per_batch):
                            yield pa.RecordBatch.from_pandas(
                                out.iloc[start : start + rows_per_batch], schema=arrow_schema, preserve_index=False
                            )
                except _DAMAGE as damage:
                    if not skip:
                        raise
                    yield pa.RecordBatch.from_pylist([{"path": path, "problem": " ".join(str(damage).split())}], schema=arrow_schema)

    arrow_schema = pa.schema(
        [("path", pa.string()), ("row_index", pa.int64()), ("date", pa.timestamp("us", "UTC"))]
        + [(c, pa.float64()) for c in COLUMNS[1:]]
        + [("problem", pa.string())]
    )
    return _contents(spark, paths).mapInArrow(decode, _RAW)


def _read_json(spark: SparkSession, paths: list[str], skip: bool) -> DataFrame:
    """Files holding one array of ``[date, o, h, l, c, v]`` rows or of records; gzip by name."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    records = F.col("value").rlike(r"^\s*\[\s*\{")
    listed = F.when(~records, F.from_json("value", "array<array<string>>"))
    named = F.when(records, F.from_json("value", "array<map<string,string>>"))
    by_name = lambda m: F.transform_keys(m, lambda k, v: F.lower(k))
    cells = F.coalesce(
        listed,
        F.transform(named, lambda m: F.array(*[F.try_element_at(by_name(m), F.lit(c)) for c in COLUMNS])),
    )
    problem = F.concat(F.lit("no bars can be read from "), F.col("path"))
    if not skip:
        cells = F.coalesce(cells, F.raise_error(problem).cast("array<array<string>>"))
    rows = text.select("path", F.when(cells.isNull(), problem).alias("problem"), F.posexplode_outer(cells).alias("row_index", "cell"))
    cell = lambda i: F.get("cell", F.lit(i))
    return rows.select(
        "path",
        F.col("row_index").cast("long").alias("row_index"),
        _epoch_or_text(cell(0)).alias("date"),
        *[cell(i).try_cast("double").alias(c) for i, c in enumerate(COLUMNS[1:], 1)],
        "problem",
    )


def clean_bars(raw: DataFrame, keys=FILE_KEYS) -> DataFrame:
    """Drop incomplete rows and keep the last row of every bar."""
    not_a_number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    whole = raw.select(*keys, "date", "row_index", *[not_a_number(c) for c in COLUMNS[1:]]).dropna()
    # five fixed-width aggregates of the same row: a hash aggregation with map-side combining
    last = [F.max_by(c, "row_index").alias(c) for c in COLUMNS[1:]]
    return whole.groupBy(*keys, "date").agg(*last)


def _clean_and_odd(spark: SparkSession, files: DataFrame, skip: bool, start=None, end=None) -> tuple[DataFrame, DataFrame]:
    """Clean bars of the listed files, and the raw rows of those that were decoded file by file.

    No other file is opened. Small Parquet files are each read at once; larger ones that Spark reads
    whole are scanned by schema; what is decoded in one task a file (Feather, JSON, odd Parquet)
    is written once.
    """
    prepare(spark)
    by_kind: dict[str, list[str]] = {}
    small, size = [], 0
    for row in files.select("path", "extension", "size_bytes").toLocalIterator():
        if row.extension == "parquet" and row.size_bytes <= SMALL_BYTES:
            small.append(row.path)
            size += row.size_bytes
        else:
            by_kind.setdefault(row.extension, []).append(row.path)
    parquet_files = by_kind.get("parquet", [])
    settled = []
    if len({path.rsplit("/", 1)[-1] for path in (*small, *parquet_files)}) < len(small) + len(parquet_files):
        parquet_files = [*parquet_files, *small]  # files of one name share their bars
    elif small:
        bars, unsettled = _read_small(spark, sorted(small), size, start, end)
        settled, parquet_files = [bars], [*parquet_files, *unsettled]
    groups, odd = group_by_footer(spark, sorted(parquet_files))
    json_files = sorted(by_kind.get("json", []) + by_kind.get("json.gz", []))
    decoded = []
    if odd:
        decoded.append(_read_each(spark, odd, _decode_parquet, skip))
    if feather := sorted(by_kind.get("feather", [])):
        decoded.append(_read_each(spark, feather, _decode_feather, skip))
    if json_files:
        decoded.append(_read_json(spark, json_files, skip))
    one_by_one = with_file_identity(reduce(DataFrame.unionByName, [spark.createDataFrame([], _RAW), *decoded]))
    if skip and decoded:
        one_by_one = stage(one_by_one)
    scanned = [with_file_identity(_scan(spark, schema, paths, start, end)) for schema, paths in groups]
    if decoded or scanned or not settled:
        raw = reduce(DataFrame.unionByName, [one_by_one, *scanned])
        settled.append(clean_bars(raw.filter(F.col("problem").isNull()) if skip else raw))
    return reduce(DataFrame.unionByName, settled), one_by_one


def load_bars(
    spark: SparkSession, folder: str, timeframe: str | None = None, *, skip_unreadable: bool = False
) -> DataFrame:
    """Bars of all market files of a folder, in any mix of formats and column types.

    With ``skip_unreadable`` a file that cannot be read whole has no bars instead of
    failing the job.
    """
    prepare(spark)
    return _clean_and_odd(spark, listed_files(spark, folder, timeframe), skip_unreadable)[0]


def load_files(spark: SparkSession, files: DataFrame, start=None, end=None) -> tuple[DataFrame, DataFrame]:
    """Bars of those of the listed files (as of ``discover``) that can be read whole, cut to
    [start, end), and ``pair, timeframe, file, problem`` of the others."""
    bars, one_by_one = _clean_and_odd(spark, files, True, start, end)
    if start is not None and end is not None:
        bars = in_range(bars, start, end)
    return bars, one_by_one.filter(F.col("problem").isNotNull()).select(*FILE_KEYS, "problem")


def in_range(bars: DataFrame, start, end) -> DataFrame:
    """Half-open date range; applied before any indicator, so warm-up stays inside it."""
    return bars.filter((F.col("date") >= F.lit(as_utc(start))) & (F.col("date") < F.lit(as_utc(end))))


def parse_file_name(name: str) -> tuple[str, str, str] | None:
    """(pair, timeframe, extension) of one name on the driver; None if it is no market file."""
    match = re.match(FILE_PATTERN, name)
    if match is None:
        return None
    parts = match[1].rsplit("_", 2)
    if len(parts) < 3:
        raise ValueError(f"Unsupported futures filename symbol: {match[1]}")
    return f"{parts[0]}/{parts[1]}:{parts[2]}", match[2], match[3]
