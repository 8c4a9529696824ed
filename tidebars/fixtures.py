"""Panels derived from the driver's ``events`` table.

The test data has no candles or trades, so both are rolled up from events: one
bar per (pair, time bucket), one trade per event.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import feather, parquet
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.operators.series import bar_seconds
from tidebars.session import prepare


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def bars_from_events(
    spark: SparkSession, sf_dir: str, *, pair: str | Column = "event_type", timeframe: str = "1h"
) -> DataFrame:
    """OHLCV bars: value is the price, an event counts as one unit of volume."""
    pair_col = F.col(pair) if isinstance(pair, str) else pair
    seconds = bar_seconds(F.lit(timeframe))
    opened = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / seconds) * seconds)
    moment = F.struct("ts", "event_id")
    return (
        read_events(spark, sf_dir)
        .groupBy(
            pair_col.cast("string").alias("pair"), F.lit(timeframe).alias("timeframe"), opened.alias("date")
        )
        .agg(
            F.min_by("value", moment).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", moment).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )


def trades_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported-trade rows; ``trade_no`` is the order in the export."""
    minutes = F.col("event_id") % 60 + 1
    return read_events(spark, sf_dir).select(
        F.concat(F.lit("system_"), (F.col("event_id") % 4).cast("string")).alias("strategy"),
        F.lit("1h").alias("timeframe"),
        F.col("event_type").alias("pair"),
        ((F.col("value") - 50) / 1000).alias("profit_ratio"),
        (F.col("user_id") % 2 == 1).alias("is_short"),
        F.col("ts").alias("open_date"),
        F.timestamp_micros(F.unix_micros("ts") + minutes * 60_000_000).alias("close_date"),
        F.when(F.col("event_id") % 5 != 0, minutes.cast("double")).alias("trade_duration"),
        F.element_at(
            F.array(F.lit("exit_signal"), F.lit("roi"), F.lit("stop_loss")),
            (F.col("event_id") % 3 + 1).cast("int"),
        ).alias("exit_reason"),
        ((F.col("event_id") % 7 - 3) / 100).alias("funding_fees"),
        F.col("event_id").alias("trade_no"),
    )


_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{[\]^]""")  # as Spark writes them in the names of partition folders


def write_market_files(bars: DataFrame, folder: str, timeframe: str, *, row_group_bytes: int = 64 << 10) -> None:
    """One Parquet file a pair with the types and the name Spark would give it. Pairs are dealt over
    all cores and may be many; a task writes its files one after another, in row groups, and one
    that runs again writes the same rows."""
    spark = bars.sparkSession
    columns = [c for c in bars.columns if c not in ("pair", "timeframe")]
    pair = F.when(F.col("pair") != "", F.col("pair")).otherwise(F.lit("__HIVE_DEFAULT_PARTITION__"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = FileSystem.from_uri(re.sub("^file:/+", "/", folder))
        opened, writer, n = None, None, 0
        for batch in batches:
            own = pa.RecordBatch.from_arrays(batch.columns[1:], names=columns)  # any value may be missing
            rows = max(100, row_group_bytes * batch.num_rows // max(own.nbytes, 1))
            runs, start = pc.run_end_encode(batch["_pair"]), 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if name != opened:
                    if writer is not None:
                        writer.close()
                    escaped = _ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", name)
                    target = f"{root}/{escaped}_USDT_USDT-{timeframe}-futures.parquet"
                    writer = parquet.ParquetWriter(target, own.schema, filesystem=system, use_deprecated_int96_timestamps=True)
                    opened, n = name, n + 1
                writer.write_batch(own.slice(start, end - start), row_group_size=rows)
                start = end
        if writer is not None:
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    _file_system(spark, folder).mkdirs(_path(spark, folder))
    dealt = bars.select(pair.alias("_pair"), *columns).repartition(4 * spark.sparkContext.defaultParallelism, "_pair")
    dealt.sortWithinPartitions("_pair", "date").mapInArrow(write, "n long").agg(F.sum("n")).first()


def write_json_files(bars: DataFrame, folder: str, timeframe: str, extension: str) -> None:
    """One file a pair holding an array of ``[milliseconds, open, high, low, close, volume]`` rows, plain or gzip."""
    spark = bars.sparkSession
    written = f"{folder}/written-{timeframe}-{uuid4().hex}"
    cells = [F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")]
    row = F.array(F.unix_millis("date").cast("double"), *cells)
    rows = bars.groupBy("pair").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # a month of bars a pair
    rows.select("pair", F.to_json("rows").alias("value")).repartition("pair").write.partitionBy("pair").text(
        written, compression="gzip" if extension == "json.gz" else "none"
    )
    _name_files(spark, written, folder, timeframe, extension)


def write_each(files: DataFrame, folder: str) -> int:
    """Write ``name, content`` rows as files below a shared folder, each in its task; a task
    that runs again writes the same bytes. Returns the number of files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = FileSystem.from_uri(re.sub("^file:/+", "/", folder))
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target = f"{root}/{name}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target) as stream:
                    stream.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("name", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_feather_files(bars: DataFrame, folder: str, timeframe: str) -> int:
    """One Feather file a pair (a month of bars)."""

    def content(pdf: pd.DataFrame) -> pd.DataFrame:
        stream = io.BytesIO()
        feather.write_feather(pdf.drop(columns=["pair", "timeframe"]).sort_values("date"), stream)
        return pd.DataFrame({"name": [f"{pdf['pair'][0]}_USDT_USDT-{timeframe}-futures.feather"], "content": [stream.getvalue()]})

    return write_each(bars.groupBy("pair").applyInPandas(content, "name string, content binary"), folder)


def write_report_archives(trades: DataFrame, folder: str) -> int:
    """One report archive for each ``name``: its trades in an early and a late report, beside members that hold none."""

    def content(pdf: pd.DataFrame) -> pd.DataFrame:
        stream, late = io.BytesIO(), pdf.trade_no % 3 != 0
        with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("config.json", "{}")
            archive.writestr("notes.txt", "no report")
            archive.writestr("broken.json", '{"strategy": {"main": {"trades": [')
            for member, own in (("early", pdf[~late]), ("late", pdf[late])):
                listed = [json.loads(trade) for trade in own.sort_values("trade_no").trade]
                archive.writestr(f"{member}.json", json.dumps({"strategy": {"other": {"trades": []}, "main": {"trades": listed}}}))
        return pd.DataFrame({"name": [f"{pdf['name'][0]}.zip"], "content": [stream.getvalue()]})

    text = trades.select("name", "trade_no", F.to_json(F.struct(*[c for c in trades.columns if c != "name"])).alias("trade"))
    return write_each(text.groupBy("name").applyInPandas(content, "name string, content binary"), folder)


def _name_files(spark: SparkSession, written: str, folder: str, timeframe: str, extension: str) -> None:
    for row in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(written).select("path").collect():
        pair = row.path.rsplit("/", 2)[1].removeprefix("pair=")
        target = _path(spark, f"{folder}/{pair}_USDT_USDT-{timeframe}-futures.{extension}")
        if not _file_system(spark, folder).rename(_path(spark, row.path), target):
            raise OSError(f"cannot name {target}")


def tear_file(spark: SparkSession, path: str) -> None:
    """Take bytes out of the first pages; the footer stays whole."""
    content = spark.read.format("binaryFile").load(path).first().content
    stream = _file_system(spark, path).create(_path(spark, path), True)
    try:
        stream.write(bytearray(content[:40] + content[140:]))
    finally:
        stream.close()


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
