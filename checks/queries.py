"""Registered queries: one Spark callable, and where SQL can express it one reference query, per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sql
from checks.settings import CUTOFF, END, HORIZONS, START, STUDY, TRAIN_END, VALIDATION_END
from tidebars.config import ExperimentSpec, RunRequest, StudyConfig, day_range, split_boundaries
from tidebars.fixtures import (
    bars_from_events,
    read_events,
    tear_file,
    trades_from_events,
    write_each,
    write_feather_files,
    write_json_files,
    write_market_files,
    write_report_archives,
)
from tidebars.functions.ranking import benjamini_hochberg, ranked
from tidebars.operators import catalog as quality
from tidebars.operators import discovery as disc
from tidebars.operators import events as ev
from tidebars.operators import identity, trades as tm
from tidebars.operators.audit import look_ahead_violations, system_violations
from tidebars.operators.reuse import requests_table, reusable_runs
from tidebars.operators.series import Panel, bar_blocks, bar_seconds
from tidebars.operators.signals import REGISTRY, compute_signals, macd_exits
from tidebars.plans.studies import (
    build_catalog,
    comparison_counts,
    load_selection,
    run_comparison,
    run_event_study,
    write_catalog,
    write_trade_summary,
)
from tidebars.session import prepare, shared_dir, stage
from tidebars.sinks import CATALOG_NAME, checksums, write_csv
from tidebars.sources import market_files
from tidebars.sources.reports import (
    CATALOG_SCHEMA,
    folder_of,
    newest_file,
    read_manifests,
    read_pair_lists,
    read_table,
    read_trades,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

CONFIG = StudyConfig(
    horizons_bars=HORIZONS,
    minimum_train_events=STUDY["train"],
    minimum_validation_events=STUDY["validation"],
    minimum_holdout_events=STUDY["holdout"],
    validation_fdr=STUDY["fdr"],
)


def query(name: str, oracle: str | None = None):
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if oracle is not None:
            ORACLE[name] = oracle
        return build

    return add


def out(df: DataFrame, *, digits: int = 9, doubles: tuple[str, ...] = ()) -> DataFrame:
    """Plain comparable columns: text dates, bigint numbers and flags, rounded doubles."""
    columns = []
    for field in df.schema.fields:
        kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
        if field.name in doubles:
            c = F.round(c.cast("double"), digits)
        elif kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("boolean", "integer", "long"):
            c = c.cast("bigint")
        elif kind == "double":
            c = F.round(c, digits)
        columns.append(c.alias(field.name))
    return df.select(columns)


hourly = partial(bars_from_events, pair="event_type", timeframe="1h")
half_daily = partial(bars_from_events, pair="user_id", timeframe="12h")


# -- bars, quality, names ----------------------------------------------------------


@query("s_bars_hourly", f"WITH {sql.HOURLY} SELECT pair, timeframe, {sql.day('date')} AS date, open, high, low, close, volume FROM b")
def s_bars_hourly(spark, sf):
    return out(hourly(spark, sf))


@query("s_bars_half_daily", f"WITH {sql.HALF_DAILY} SELECT pair, timeframe, {sql.day('date')} AS date, open, high, low, close, volume FROM b")
def s_bars_half_daily(spark, sf):
    return out(half_daily(spark, sf))


@query(
    "p1_p6_w11_clean",
    f"""WITH r AS (SELECT event_type AS pair, make_timestamp(CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) * 1000000) AS date, event_id,
   value AS price, CASE WHEN event_id % 11 <> 0 THEN CAST(user_id AS DOUBLE) END AS volume FROM events),
 k AS (SELECT *, row_number() OVER (PARTITION BY pair, date ORDER BY event_id DESC) AS rn FROM r WHERE volume IS NOT NULL)
 SELECT pair, {sql.day('date')} AS date, price AS open, price AS high, price AS low, price AS close, volume FROM k
 WHERE rn = 1 AND date >= TIMESTAMP '2024-01-05' AND date < TIMESTAMP '2024-01-25'""",
)
def p1_p6_w11_clean(spark, sf):
    """Coerce, drop incomplete rows, keep the last row of a bar, cut the range."""
    hour = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 3600) * 3600)
    size = F.when(F.col("event_id") % 11 != 0, F.col("user_id").cast("string")).otherwise(F.lit("n/a"))
    raw = read_events(spark, sf).select(
        F.col("event_type").alias("pair"),
        hour.alias("date"),
        F.col("event_id").alias("row_index"),
        *[F.col("value").alias(c) for c in ("open", "high", "low", "close")],
        size.try_cast("double").alias("volume"),
    )
    return out(market_files.in_range(market_files.clean_bars(raw, ["pair"]), "2024-01-05", "2024-01-25"))


@query(
    "f1_f2_f3_names",
    """SELECT c_custkey, 'C_' || CAST(c_custkey AS VARCHAR) || '/USDT:USDT' AS pair,
   ['1m', '15m', '4h', '2d', '1w'][c_custkey % 5 + 1] AS timeframe, ['feather', 'parquet', 'json', 'json.gz'][c_custkey % 4 + 1] AS extension,
   CAST([60, 900, 14400, 172800, 604800][c_custkey % 5 + 1] AS BIGINT) AS bar_seconds
 FROM customer WHERE c_custkey % 3 <> 0""",
)
def f1_f2_f3_names(spark, sf):
    """Parse market file names; every third name is of another kind and is ignored."""
    key = F.col("c_custkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (key % by + 1).cast("int"))
    name = F.concat(
        F.lit("/data/C_"),
        key.cast("string"),
        F.lit("_USDT_USDT-"),
        pick(["1m", "15m", "4h", "2d", "1w"], 5),
        F.when(key % 3 == 0, "-mark.").otherwise("-futures."),
        pick(["feather", "parquet", "json", "json.gz"], 4),
    )
    paths = prepare(spark).read.parquet(f"{sf}/customer.parquet").select("c_custkey", name.alias("path"))
    parsed = market_files.with_file_identity(paths)
    return out(parsed.select("c_custkey", "pair", "timeframe", "extension", bar_seconds().alias("bar_seconds")))


def damaged(spark, sf):
    """Hourly bars of which some have an impossible high."""
    broken = F.when(F.col("volume") % 7 == 0, (F.col("open") + F.col("close")) / 2 - 1)
    hurt = F.col("pair").isin("view", "click")
    return hourly(spark, sf).withColumn("high", F.when(hurt, F.coalesce(broken, F.col("high"))).otherwise(F.col("high")))


DAMAGED = f"""{sql.HOURLY}, x AS (SELECT * REPLACE (
  CASE WHEN pair IN ('view', 'click') AND volume % 7 = 0 THEN (open + close) / 2 - 1 ELSE high END AS high) FROM b)"""
INVALID = "(high < greatest(open, close, low) OR low > least(open, close, high) OR least(open, high, low, close) <= 0 OR volume < 0)"


@query("p7_invalid_ohlc", f"WITH {DAMAGED} SELECT pair, {sql.day('date')} AS date, open, high, low, close FROM x WHERE {INVALID}")
def p7_invalid_ohlc(spark, sf):
    bars = damaged(spark, sf).filter(quality.invalid_ohlc())
    return out(bars.select("pair", "date", "open", "high", "low", "close"))


STEP = f"date_diff('second', lag(date) OVER ({sql.SERIES}), date)"


@query(
    "w18_gaps",
    f"""WITH {sql.HOURLY}, d AS (SELECT *, {STEP} AS step FROM b)
 SELECT pair, count(*) FILTER (step > 3600) AS gaps, CAST(COALESCE(sum(step / 3600 - 1) FILTER (step > 3600), 0) AS BIGINT) AS missing FROM d GROUP BY pair""",
)
def w18_gaps(spark, sf):
    blocks = bar_blocks(hourly(spark, sf), back=1)
    gaps = quality.gap_columns(blocks, Panel()).filter("core")
    return out(
        gaps.groupBy("pair").agg(
            F.count(F.when(F.col("gap"), 1)).alias("gaps"), F.sum("missing").cast("long").alias("missing")
        )
    )


def catalog_of(spark, sf) -> DataFrame:
    """Catalog of the damaged hourly and the 4h bars; one listed file has no bars."""
    bars = damaged(spark, sf).unionByName(bars_from_events(spark, sf, timeframe="4h"))
    name = F.concat("pair", F.lit("-"), "timeframe", F.lit("-futures.parquet"))
    bars = bars.withColumn("file", name)
    listed = read_events(spark, sf).groupBy(F.col("event_type").alias("pair")).agg(F.count(F.lit(1)).alias("size_bytes"))
    listed = listed.select("pair", "size_bytes", F.explode(F.array(F.lit("1h"), F.lit("4h"), F.lit("1d"))).alias("timeframe"))
    files = listed.withColumn("file", name).withColumns(
        {"extension": F.lit("parquet"), "source_sha256": F.when(F.col("timeframe") == "1h", F.sha2("pair", 256))}
    )
    return quality.assess_files(files, bars, "2024-01-02", "2024-01-31", minimum_coverage=0.9, minimum_candles=170)


CATALOG = f"""{DAMAGED}, b4 AS ({sql.bars('event_type', '4h', 14400)}),
 ab AS (SELECT pair, timeframe, date, open, high, low, close, volume FROM x UNION ALL SELECT pair, timeframe, date, open, high, low, close, volume FROM b4),
 st AS (SELECT *, CASE timeframe WHEN '1h' THEN 3600 ELSE 14400 END AS bar FROM ab WHERE date >= TIMESTAMP '2024-01-02' AND date < TIMESTAMP '2024-01-31'),
 sd AS (SELECT *, date_diff('second', lag(date) OVER (PARTITION BY pair, timeframe ORDER BY date), date) AS step FROM st),
 au AS (SELECT pair, timeframe, count(*) AS candles, min(date) AS f, max(date) AS l, count(*) FILTER (step > bar) AS gap_count,
   CAST(COALESCE(sum(step / bar - 1) FILTER (step > bar), 0) AS BIGINT) AS missing, count(*) FILTER ({INVALID}) AS invalid_ohlc_rows FROM sd GROUP BY ALL),
 fl AS (SELECT event_type AS pair, t.timeframe, count(*) AS size_bytes FROM events, (VALUES ('1h'), ('4h'), ('1d')) t(timeframe) GROUP BY ALL),
 ca AS (SELECT fl.pair, fl.timeframe, fl.pair || '-' || fl.timeframe || '-futures.parquet' AS file, 'parquet' AS extension, size_bytes,
   CASE WHEN fl.timeframe = '1h' THEN sha256(fl.pair) END AS source_sha256, COALESCE(candles, 0) AS candles,
   CAST(CASE fl.timeframe WHEN '1h' THEN 29 * 24 WHEN '4h' THEN 29 * 6 ELSE 29 END AS BIGINT) AS expected_candles,
   strftime(f, '%Y-%m-%dT%H:%M:%S+00:00') AS first_candle, strftime(l, '%Y-%m-%dT%H:%M:%S+00:00') AS last_candle,
   COALESCE(gap_count, 0) AS gap_count, missing, COALESCE(invalid_ohlc_rows, 0) AS invalid_ohlc_rows FROM fl LEFT JOIN au USING (pair, timeframe)),
 cv AS (SELECT *, least(candles / expected_candles, 1.0) AS coverage_ratio, COALESCE(missing, expected_candles) AS missing_candles_inside FROM ca),
 cr AS (SELECT *, candles >= 170 AND coverage_ratio >= 0.9 AND invalid_ohlc_rows = 0 AS ready FROM cv),
 catalog AS (SELECT *, CASE WHEN ready THEN 'ready' WHEN candles = 0 THEN 'empty' WHEN invalid_ohlc_rows > 0 THEN 'invalid_ohlc'
   WHEN candles < 170 THEN 'too_short' ELSE 'partial_coverage' END AS status FROM cr)"""


@query(
    "a14_a15_catalog",
    f"""WITH {CATALOG} SELECT pair, timeframe, file, extension, size_bytes, source_sha256, candles, expected_candles,
 round(coverage_ratio, 9) AS coverage_ratio, first_candle, last_candle, gap_count, missing_candles_inside, invalid_ohlc_rows,
 CAST(ready AS BIGINT) AS research_ready, status FROM catalog""",
)
def a14_a15_catalog(spark, sf):
    return out(catalog_of(spark, sf))


MARKET = "pair || '/USDT:USDT'"
KINDS = f"kinds AS (SELECT event_type AS pair, ['plain', 'text', 'iso', 'torn'][CAST((row_number() OVER (ORDER BY event_type) - 1) % 4 AS INTEGER) + 1] AS kind FROM (SELECT DISTINCT event_type FROM events))"


@query(
    "s2_a22_mixed_files",
    f"""WITH {sql.HOURLY}, {KINDS} SELECT {MARKET} AS pair, kind, CAST(kind <> 'torn' AS BIGINT) AS readable,
   CASE WHEN kind = 'torn' THEN 0 ELSE count(*) END AS bars, CASE WHEN kind <> 'torn' THEN {sql.day('min(date)')} END AS first, CASE WHEN kind <> 'torn' THEN {sql.day('max(date)')} END AS last,
   CASE WHEN kind <> 'torn' THEN round(sum(open + 2 * high + 3 * low + 4 * close), 4) END AS prices, CASE WHEN kind <> 'torn' THEN sum(volume) END AS volume
 FROM b JOIN kinds USING (pair) WHERE date >= TIMESTAMP '2024-01-03' AND date < TIMESTAMP '2024-01-29' GROUP BY pair, kind""",
)
def s2_a22_mixed_files(spark, sf):
    """Parquet files of several column types and a torn one, read whole or not at all, cut to a range."""
    bars = stage(hourly(spark, sf))
    pairs = sorted(r.pair for r in bars.select("pair").distinct().collect())  # five event types
    kinds = {p: ("plain", "text", "iso", "torn")[i % 4] for i, p in enumerate(pairs)}
    folder = f"{shared_dir(spark)}/market-{uuid4().hex}"
    text = {c: F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")}
    iso = {"date": F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")}
    for kind, changed in (("plain", {}), ("torn", {}), ("text", text), ("iso", iso)):
        own = bars.filter(F.col("pair").isin([p for p, k in kinds.items() if k == kind]))
        write_market_files(own.withColumns(changed) if changed else own, folder, "1h")
    for pair in (p for p, k in kinds.items() if k == "torn"):
        tear_file(spark, f"{folder}/{pair}_USDT_USDT-1h-futures.parquet")
    files = stage(market_files.discover(spark, folder, "1h"))
    read, problems = market_files.load_files(spark, files, "2024-01-03", "2024-01-29")
    found = read.groupBy("pair").agg(
        F.count(F.lit(1)).alias("bars"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.round(F.sum(F.expr("open + 2 * high + 3 * low + 4 * close")), 4).alias("prices"), F.sum("volume").alias("volume"),
    )
    named = spark.createDataFrame([(f"{p}/USDT:USDT", k) for p, k in kinds.items()], "pair string, kind string")
    rows = files.join(named, "pair").join(problems.select("pair", "problem"), "pair", "left").join(found, "pair", "left")
    return out(rows.select("pair", "kind", F.col("problem").isNull().alias("readable"), F.coalesce("bars", F.lit(0)).alias("bars"), "first", "last", "prices", "volume"))


FORMATS = f"kinds AS (SELECT event_type AS pair, ['json', 'json.gz', 'parquet'][CAST((row_number() OVER (ORDER BY event_type) - 1) % 3 AS INTEGER) + 1] AS extension FROM (SELECT DISTINCT event_type FROM events))"


@query(
    "s1_s4_json_files",
    f"""WITH {sql.HOURLY}, {FORMATS} SELECT {MARKET} AS pair, timeframe, extension, {sql.day('date')} AS date, open, high, low, close, volume FROM b JOIN kinds USING (pair)""",
)
def s1_s4_json_files(spark, sf):
    """Bars written as JSON, gzip and Parquet files, listed and read back."""
    bars = stage(hourly(spark, sf))
    pairs = sorted(r.pair for r in bars.select("pair").distinct().collect())
    kinds = ("json", "json.gz", "parquet")
    folder = f"{shared_dir(spark)}/market-{uuid4().hex}"
    for i, kind in enumerate(kinds):
        own = bars.filter(F.col("pair").isin(pairs[i :: len(kinds)]))
        write_market_files(own, folder, "1h") if kind == "parquet" else write_json_files(own, folder, "1h", kind)
    listed = market_files.discover(spark, folder, "1h").select("file", "extension")
    read = market_files.load_bars(spark, folder, "1h").join(listed, "file")
    return out(read.select("pair", "timeframe", "extension", "date", "open", "high", "low", "close", "volume"))


@query(
    "s3_p1_feather_files",
    f"""WITH {sql.HOURLY} SELECT {MARKET} AS pair, timeframe, 'feather' AS extension, {sql.day('date')} AS date, open, high, low, close, volume FROM b
 WHERE date >= TIMESTAMP '2024-01-03' AND date < TIMESTAMP '2024-01-29'""",
)
def s3_p1_feather_files(spark, sf):
    """Feather files whose columns are in capitals, of another order and with one to spare, cut to a range."""
    folder = f"{shared_dir(prepare(spark))}/market-{uuid4().hex}"
    columns = [F.col(c).alias(c.upper()) for c in ("volume", "close", "low", "high", "open")]
    write_feather_files(hourly(spark, sf).select("pair", "timeframe", "date", *columns, F.lit("x").alias("note")), folder, "1h")
    listed = market_files.discover(spark, folder, "1h").select("file", "extension")
    read = market_files.load_bars(spark, folder, "1h").join(listed, "file")
    cut = read.filter("date >= '2024-01-03' and date < '2024-01-29'")
    return out(cut.select("pair", "timeframe", "extension", "date", "open", "high", "low", "close", "volume"))


@query(
    "k6_catalog_bundle",
    f"""WITH {CATALOG}, w AS (SELECT * FROM catalog WHERE timeframe IN ('1h', '4h')) SELECT {MARKET} AS pair, timeframe, candles, first_candle, status,
   CAST(ready AND timeframe = '1h' AS BIGINT) AS selected, (SELECT count(*) FROM w) AS files, (SELECT count(DISTINCT pair) FROM w) AS unique_pairs,
   (SELECT count(*) FROM w WHERE ready) AS research_ready_files FROM w""",
)
def k6_catalog_bundle(spark, sf):
    """A catalog written with its summary, read back, and its hourly selection."""
    folder = f"{shared_dir(prepare(spark))}/catalog-{uuid4().hex}"
    write_market_files(damaged(spark, sf), f"{folder}/data", "1h")
    write_market_files(bars_from_events(spark, sf, timeframe="4h"), f"{folder}/data", "4h")
    span = "2024-01-02", "2024-01-31"
    summary = write_catalog(spark, f"{folder}/data", f"{folder}/out", *span, timeframes=("1h", "4h"), minimum_coverage=0.9, minimum_candles=170)
    back = read_table(spark, f"{folder}/out/{CATALOG_NAME}", CATALOG_SCHEMA)
    chosen = load_selection(spark, f"{folder}/out", "1h", *span).select("pair", F.lit("1h").alias("timeframe"), F.lit(True).alias("chosen"))
    totals = [F.lit(summary[c]).alias(c) for c in ("files", "unique_pairs", "research_ready_files")]
    rows = back.join(chosen, ["pair", "timeframe"], "left")
    return out(rows.select("pair", "timeframe", "candles", "first_candle", "status", F.coalesce("chosen", F.lit(False)).alias("selected"), *totals))


@query(
    "p9_f10_boundaries",
    """WITH d AS (SELECT event_type AS pair, date_trunc('day', min(ts)) AS f, date_trunc('day', max(ts)) + INTERVAL 1 DAY AS l FROM events GROUP BY event_type)
 SELECT pair, strftime(f, '%Y%m%d') || '-' || strftime(l, '%Y%m%d') AS days, strftime(f + (date_diff('second', f, l) * 3 // 5) * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS train_end,
  strftime(f + (date_diff('second', f, l) * 4 // 5) * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS validation_end FROM d""",
)
def p9_f10_boundaries(spark, sf):
    """Day range and split of the whole days each event type covers (five types)."""
    day = lambda c: F.date_trunc("day", c)
    spans = read_events(spark, sf).groupBy(F.col("event_type").alias("pair")).agg(
        F.date_format(day(F.min("ts")), "yyyy-MM-dd").alias("first"), F.date_format(day(F.max("ts")) + F.expr("interval 1 day"), "yyyy-MM-dd").alias("last")
    )
    rows = [(r.pair, day_range(r.first, r.last), *(f"{m:%Y-%m-%d %H:%M:%S}" for m in split_boundaries(r.first, r.last))) for r in spans.collect()]
    return spark.createDataFrame(rows, "pair string, days string, train_end string, validation_end string")


@query(
    "a15_catalog_from_files",
    f"""WITH {CATALOG} SELECT {MARKET} AS pair, timeframe, pair || '_USDT_USDT-' || timeframe || '-futures.parquet' AS file, extension, candles, expected_candles, {sql.rounded('coverage_ratio')},
   first_candle, last_candle, gap_count, missing_candles_inside, invalid_ohlc_rows, CAST(ready AS BIGINT) AS research_ready, status, 1 AS hashed FROM catalog WHERE timeframe IN ('1h', '4h')
 UNION ALL SELECT 'torn/USDT:USDT', '4h', 'torn_USDT_USDT-4h-futures.parquet', 'parquet', 0, 174, 0.0, NULL, NULL, 0, 174, 0, 0, 'empty', 1""",
)
def a15_catalog_from_files(spark, sf):
    """Catalog of a folder whose files of other timeframes are damaged; one wanted file is torn."""
    folder = f"{shared_dir(spark)}/market-{uuid4().hex}"
    four = bars_from_events(spark, sf, timeframe="4h")
    write_market_files(damaged(spark, sf), folder, "1h")
    write_market_files(four, folder, "4h")
    one = four.filter("pair = 'click'").withColumn("pair", F.lit("torn"))
    for timeframe in ("4h", "1d"):
        write_market_files(one, folder, timeframe)
        tear_file(spark, f"{folder}/torn_USDT_USDT-{timeframe}-futures.parquet")
    found = build_catalog(spark, folder, "2024-01-02", "2024-01-31", timeframes=("1h", "4h"), minimum_coverage=0.9, minimum_candles=170)
    return out(found.withColumn("hashed", F.length("source_sha256") == 64).drop("size_bytes", "source_sha256"))


@query(
    "a16_catalog_summary",
    f"""WITH {CATALOG} SELECT status, count(*) AS status_files, (SELECT count(*) FROM catalog) AS files,
 (SELECT count(DISTINCT pair) FROM catalog) AS unique_pairs, (SELECT count(*) FROM catalog WHERE ready) AS research_ready_files
 FROM catalog GROUP BY status""",
)
def a16_catalog_summary(spark, sf):
    totals = quality.catalog_summary(catalog_of(spark, sf))
    return out(
        totals.select(
            F.explode("status_counts").alias("status", "status_files"), "files", "unique_pairs", "research_ready_files"
        )
    )


@query(
    "a17_pair_coverage",
    f"""WITH {sql.HALF_DAILY} SELECT pair, timeframe, count(*) AS candles, strftime(min(date), '%Y-%m-%dT%H:%M:%S+00:00') AS first_candle,
 strftime(max(date), '%Y-%m-%dT%H:%M:%S+00:00') AS last_candle FROM b GROUP BY ALL""",
)
def a17_pair_coverage(spark, sf):
    return out(quality.pair_coverage(half_daily(spark, sf)))


# -- universe and identity ------------------------------------------------------------


@query("p23_ready_rows", f"WITH {CATALOG} SELECT pair, timeframe, status FROM catalog WHERE ready AND timeframe = '4h'")
def p23_ready_rows(spark, sf):
    text = F.when(F.col("research_ready"), " Yes ").otherwise("0")
    as_text = catalog_of(spark, sf).withColumn("research_ready", text)
    return quality.ready_rows(as_text, "4h").select("pair", "timeframe", "status")


@query(
    "j1_catalog_gate",
    f"""WITH {CATALOG}, b1 AS (SELECT pair, timeframe, count(*) AS n FROM ab GROUP BY ALL)
 SELECT pair, timeframe, n FROM b1 WHERE pair IN (SELECT pair FROM catalog WHERE ready AND timeframe = '4h')""",
)
def j1_catalog_gate(spark, sf):
    selection = identity.catalog_selection(catalog_of(spark, sf), "4h")
    bars = damaged(spark, sf).unionByName(bars_from_events(spark, sf, timeframe="4h"))
    return out(quality.gate(bars.groupBy("pair", "timeframe").agg(F.count(F.lit(1)).alias("n")), selection))


@query(
    "j2_j3_stale_pairs",
    f"""WITH {sql.HALF_DAILY} SELECT DISTINCT pair FROM b
 WHERE pair NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events GROUP BY user_id HAVING count(*) >= 70)""",
)
def j2_j3_stale_pairs(spark, sf):
    busy = read_events(spark, sf).groupBy(F.col("user_id").cast("string").alias("pair")).count().filter("count >= 70")
    return quality.stale_pairs(half_daily(spark, sf), busy)


@query(
    "o6_universe_batch",
    "SELECT pair FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS pair FROM events ORDER BY pair LIMIT 20 OFFSET 10)",
)
def o6_universe_batch(spark, sf):
    pairs = read_events(spark, sf).select(F.col("user_id").cast("string").alias("pair"))
    return quality.select_universe(pairs, max_pairs=20, pair_offset=10)


@query("o6_universe_rest", "SELECT pair FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS pair FROM events ORDER BY pair OFFSET 10)")
def o6_universe_rest(spark, sf):
    """All pairs after the first ten."""
    pairs = read_events(spark, sf).select(F.col("user_id").cast("string").alias("pair"))
    return quality.select_universe(pairs, pair_offset=10)


@query(
    "a20_universe_fingerprint",
    f"WITH {CATALOG}, {sql.tree('timeframe', "pair || '|' || status", 'catalog')}",
)
def a20_universe_fingerprint(spark, sf):
    rows = catalog_of(spark, sf).withColumn("value", F.col("status"))
    return identity.universe_fingerprint(rows, ["timeframe"])


@query(
    "a20_file_fingerprint",
    f"WITH {CATALOG}, {sql.tree('timeframe', "pair || '|' || file || '|' || CAST(size_bytes AS VARCHAR)", 'catalog')}",
)
def a20_file_fingerprint(spark, sf):
    return identity.file_fingerprint(catalog_of(spark, sf), ["timeframe"])


@query(
    "a20_pair_list_fingerprint",
    f"WITH names AS (SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS pair FROM events), {sql.tree('event_type', 'pair', 'names')}",
)
def a20_pair_list_fingerprint(spark, sf):
    pairs = read_events(spark, sf).select("event_type", F.col("user_id").cast("string").alias("pair")).distinct()
    return identity.pair_list_fingerprint(pairs, ["event_type"])


@query(
    "a21_selection_basis",
    f"""WITH {CATALOG} SELECT pair, timeframe, CASE WHEN timeframe = '1h' THEN source_sha256 ELSE 'metadata' END AS value,
 CASE WHEN timeframe = '1h' THEN 'source_sha256_v1' ELSE 'catalog_metadata_fallback_v1' END AS basis FROM catalog WHERE ready""",
)
def a21_selection_basis(spark, sf):
    catalog = stage(catalog_of(spark, sf))
    parts = [identity.catalog_selection(catalog, t).withColumn("timeframe", F.lit(t)) for t in ("1h", "4h")]
    rows = parts[0].unionByName(parts[1])
    hidden = F.when(F.col("basis") == identity.SOURCE_HASH_BASIS, F.col("value")).otherwise("metadata")
    return rows.select("pair", "timeframe", hidden.alias("value"), "basis")


@query(
    "f7_row_fingerprint",
    """SELECT c_custkey, sha256('{"c_custkey":"' || CAST(c_custkey AS VARCHAR) || '","c_mktsegment":' ||
 COALESCE('"' || c_mktsegment || '"', 'null') || ',"c_nationkey":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || CAST(c_nationkey AS VARCHAR) || '"' END || '}') AS fingerprint FROM customer""",
)
def f7_row_fingerprint(spark, sf):
    rows = prepare(spark).read.parquet(f"{sf}/customer.parquet")
    rows = rows.select(
        "c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("c_nationkey"), "c_mktsegment",
        F.lit("x").alias("source_sha256"),
    )
    return out(rows.select("c_custkey", identity.metadata_fingerprint(rows.columns).alias("fingerprint")))


@query("f4_content_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def f4_content_sha256(spark, sf):
    documents = prepare(spark).read.parquet(f"{sf}/documents.parquet")
    return documents.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


@query(
    "f5_git_blob",
    "SELECT CAST(doc_id AS VARCHAR) AS name, sha1(('blob ' || CAST(octet_length(encode(text)) AS VARCHAR))::BLOB || '\\x00'::BLOB || encode(text)) AS actual_blob_sha1, sha256(text) AS sha256, CAST(0 AS BIGINT) AS intact FROM documents",
)
def f5_git_blob(spark, sf):
    documents = prepare(spark).read.parquet(f"{sf}/documents.parquet")
    sources = documents.select(F.col("doc_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("content"))
    pinned = documents.select(F.col("doc_id").cast("string").alias("name"), F.sha1("text").alias("blob_sha1"))
    return out(identity.source_checks(sources, pinned))


@query(
    "f8_iso_times",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00' AS iso FROM events",
)
def f8_iso_times(spark, sf):
    return read_events(spark, sf).select("event_id", quality.iso_time(F.col("ts")).alias("iso"))


SPEC = ExperimentSpec(
    system_id="turtle_channel",
    system_version="1",
    timeframe="12h",
    parameters={"entry_length": 5},
    cost_bps=14.0,
    horizons_bars=HORIZONS,
    data_start=START,
    data_end=END,
    universe_fingerprint="a" * 64,
    universe_fingerprint_basis=identity.SOURCE_HASH_BASIS,
)


# -- signals ---------------------------------------------------------------------------


SIGNALS = {
    "g1_macd_crossover": ("macd_crossover", {}, sql.g1()),
    "g2_liquidity_sweep_reclaim": ("liquidity_sweep_reclaim", {}, sql.g2()),
    "g3_breakout_retest": ("breakout_retest", {"lookback": 3, "retest_tolerance_bps": 5000.0}, sql.g3()),
    "g4_compression_expansion": ("compression_expansion", {}, sql.g4()),
    "g5_bos_choch": ("bos_choch", {}, sql.g5()),
    "g6_turtle_channel": ("turtle_channel", {}, sql.g6()),
    "g7_turtle_vhf": ("turtle_vhf", {}, sql.g7()),
    "g8_isolated_peak_bottom": ("isolated_peak_bottom", {}, sql.g8()),
    "g9_volume_coloured_bars": ("volume_coloured_bars", {}, sql.g9()),
    "g10_follow_line": ("follow_line", {}, sql.g10()),
    "g11_squeeze_momentum": ("squeeze_momentum", {}, sql.g11()),
    "g12_progressive_trend_tracker": ("progressive_trend_tracker", {}, sql.g12()),
}


def _signal_query(system: str, parameters: dict) -> Query:
    def build(spark, sf):
        signals = compute_signals(hourly(spark, sf), system, **parameters)
        return out(signals.select("pair", "date", "long_signal", "short_signal", "tag"))

    return build


for _name, (_system, _parameters, _oracle) in SIGNALS.items():
    query(_name, _oracle)(_signal_query(_system, _parameters))


@query("g1x_macd_exits", sql.g1x())
def g1x_macd_exits(spark, sf):
    return out(macd_exits(hourly(spark, sf)).select("pair", "date", "exit_long", "exit_short", "exit_tag"))


# -- event study -------------------------------------------------------------------------


def events_of(spark, sf) -> DataFrame:
    bars = half_daily(spark, sf)
    return ev.system_events(bars, "turtle_channel", CONFIG, TRAIN_END, VALIDATION_END, entry_length=5)


def summary_of(spark, sf) -> DataFrame:
    return ev.summarise_events(stage(events_of(spark, sf)))


@query(
    "w8_w9_w10_forward",
    "WITH " + sql.HOURLY + ", e AS (SELECT *, date - " + sql.lag("date") + " = INTERVAL 1 HOUR AS edge FROM b) SELECT pair, "
    + sql.day("date") + " AS date, lead(open) OVER w AS next_open, "
    + ", ".join(
        f"lead(close, {h}) OVER w AS exit_close_{h}, "
        f"CASE WHEN lead(close, {h}) OVER w IS NOT NULL THEN max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END AS max_high_{h}, "
        f"CASE WHEN lead(close, {h}) OVER w IS NOT NULL THEN min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END AS min_low_{h}, "
        f"CAST(lead(close, {h}) OVER w IS NOT NULL AND bool_and(edge) OVER (w ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS BIGINT) AS contiguous_{h}"
        for h in (1, 5, 20)
    )
    + " FROM e WINDOW w AS (" + sql.SERIES + ")",
)
def w8_w9_w10_forward(spark, sf):
    horizons = (1, 5, 20)
    ahead = ev.forward_columns(bar_blocks(hourly(spark, sf), ahead=20), Panel(), horizons).filter("core")
    columns = [f"{c}_{h}" for h in horizons for c in ("exit_close", "max_high", "min_low", "contiguous")]
    return out(ahead.select("pair", "date", "next_open", *columns))


EVENTS = f"WITH {sql.turtle_signals()}, {sql.events_cte()}"


@query(
    "c1_p13_events",
    f"{EVENTS} SELECT pair, timeframe, direction, period, CAST(horizon_bars AS BIGINT) AS horizon_bars, CAST(holding_minutes AS BIGINT) AS holding_minutes, {sql.day('signal_date')} AS signal_date, {sql.rounded('net_return', 'mfe', 'mae')} FROM ev",
)
def c1_p13_events(spark, sf):
    return out(events_of(spark, sf))


@query(
    "w12_independent_events",
    f"WITH RECURSIVE {sql.turtle_signals()}, {sql.events_cte()}, {sql.GREEDY} SELECT pair, direction, period, CAST(horizon_bars AS BIGINT) AS horizon_bars, {sql.day('signal_date')} AS signal_date, round(net_return, 9) AS net_return, CAST(independent AS BIGINT) AS independent FROM flagged",
)
def w12_independent_events(spark, sf):
    marked = ev.independent_events(stage(events_of(spark, sf)))
    return out(marked.select("pair", "direction", "period", "horizon_bars", "signal_date", "net_return", "independent"))


DENSE = f"""WITH RECURSIVE {sql.HOURLY}, x AS (SELECT *, close > open AS long_, close < open AS short_ FROM b), {sql.events_cte(60)}, {sql.GREEDY}
SELECT pair, direction, period, CAST(horizon_bars AS BIGINT) AS horizon_bars, count(*) AS events, count(*) FILTER (independent) AS independent,
 round(avg(net_return) FILTER (independent), 9) AS mean_independent FROM flagged GROUP BY ALL"""


@query("w12_dense_custom_signal", DENSE)
def w12_dense_custom_signal(spark, sf):
    """A user-defined signal that fires on almost every bar, walked in short chunks."""
    bars = hourly(spark, sf)
    marked = bars.withColumns({"long_signal": F.col("close") > F.col("open"), "short_signal": F.col("close") < F.col("open")})
    events = stage(ev.marked_events(marked, CONFIG, TRAIN_END, VALIDATION_END))
    walked = ev.independent_events(events, chunk_seconds=36 * 3600)
    chosen = F.when(F.col("independent"), F.col("net_return"))
    return out(
        walked.groupBy("pair", "direction", "period", "horizon_bars").agg(
            F.count(F.lit(1)).alias("events"), F.count(chosen).alias("independent"), F.avg(chosen).alias("mean_independent")
        )
    )


SUMMARY_COLUMNS = f"""pair, direction, period, CAST(horizon_bars AS BIGINT) AS horizon_bars, CAST(holding_minutes AS BIGINT) AS holding_minutes,
 events, non_overlapping_events, {sql.rounded('mean_net_return', 'test_mean_net_return', 'median_net_return', 'win_rate', 'std_net_return',
 'test_std_net_return')}, round(t_stat, 6) AS t_stat, round(p_value, 8) AS p_value, {sql.rounded('profit_factor', 'mean_mfe', 'mean_mae')}"""


@query("a1_a4_event_summary", f"{sql.to_summary()} SELECT {SUMMARY_COLUMNS} FROM summary")
def a1_a4_event_summary(spark, sf):
    summary = summary_of(spark, sf).drop("p_value_method")
    summary = summary.withColumns({"t_stat": F.round("t_stat", 6), "p_value": F.round("p_value", 8)})
    return out(summary)


# A dense summary over all hourly pairs, so that t-tests have many degrees of freedom.
DENSE_SUMMARY = f"""WITH RECURSIVE {sql.HOURLY}, x AS (SELECT *, close > open AS long_, close < open AS short_ FROM b), {sql.events_cte(60)}, {sql.GREEDY}, {sql.SUMMARY}
SELECT {SUMMARY_COLUMNS} FROM summary"""


@query("a4_dense_summary", DENSE_SUMMARY)
def a4_dense_summary(spark, sf):
    bars = hourly(spark, sf)
    marked = bars.withColumns({"long_signal": F.col("close") > F.col("open"), "short_signal": F.col("close") < F.col("open")})
    events = stage(ev.marked_events(marked, CONFIG, TRAIN_END, VALIDATION_END))
    summary = ev.summarise_events(events).drop("p_value_method")
    return out(summary.withColumns({"t_stat": F.round("t_stat", 6), "p_value": F.round("p_value", 8)}))


@query("c2_macd_summary", f"""WITH RECURSIVE {sql.HOURLY}, {sql.macd_cte().replace('x AS (', 'z AS (')},
x AS (SELECT *, COALESCE(above AND volume > 0, FALSE) AS long_, COALESCE(below AND volume > 0, FALSE) AS short_ FROM z), {sql.events_cte(60)}, {sql.GREEDY}, {sql.SUMMARY}
SELECT {SUMMARY_COLUMNS} FROM summary""")
def c2_macd_summary(spark, sf):
    summary = ev.macd_summary(hourly(spark, sf), CONFIG, TRAIN_END, VALIDATION_END).drop("p_value_method")
    return out(summary.withColumns({"t_stat": F.round("t_stat", 6), "p_value": F.round("p_value", 8)}))


@query(
    "w16_benjamini_hochberg",
    """WITH v AS (SELECT event_type, event_id, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE least(1.0, floor(value * 10) / 3000) END AS p FROM events),
 r AS (SELECT *, p * count(*) OVER (PARTITION BY event_type) / count(*) OVER (PARTITION BY event_type ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM v)
 SELECT event_type, event_id, round(p, 9) AS p, round(least(1.0, min(raw) OVER (PARTITION BY event_type ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM r""",
)
def w16_benjamini_hochberg(spark, sf):
    """Families of thousands of p-values, many of them tied, a third equal to 1."""
    p = F.when(F.col("event_id") % 3 == 0, 1.0).otherwise(F.least(F.lit(1.0), F.floor(F.col("value") * 10) / 3000))
    return out(benjamini_hochberg(read_events(spark, sf).select("event_type", "event_id", p.alias("p")), "p", "q", ["event_type"]))


WIDE = tuple(f"{m}_{p}" for m in disc.METRICS for p in ("train", "validation"))


@query("a5_a7_c3_discovery", f"{sql.to_summary()}, {sql.discovery_cte()} SELECT {sql.discovery_columns()} FROM disc")
def a5_a7_c3_discovery(spark, sf):
    table = disc.discovery_table(stage(summary_of(spark, sf)), CONFIG)
    columns = [*disc.KEYS, *WIDE, "train_eligible", "validation_q_value", "fdr_family_size", "discovery_pass", "discovery_score"]
    return out(table.select(*columns), doubles=WIDE)


@query("c4_o1_candidates", f"{sql.to_summary()}, {sql.discovery_cte()} SELECT {sql.discovery_columns()} FROM disc WHERE discovery_pass")
def c4_o1_candidates(spark, sf):
    selected, _ = disc.candidate_tables(stage(summary_of(spark, sf)), CONFIG)
    columns = [*disc.KEYS, *WIDE, "train_eligible", "validation_q_value", "fdr_family_size", "discovery_pass", "discovery_score"]
    return out(selected.select(*columns), doubles=WIDE)


HOLDOUT_WIDE = tuple(f"{m}_holdout" for m in disc.METRICS)


@query(
    "c4_j4_holdout",
    f"""{sql.to_summary()}, {sql.discovery_cte()}, hw AS ({sql.wide(('holdout',))})
 SELECT {sql.KEYS}, round(discovery_score, 9) AS discovery_score, {sql.wide_columns('holdout')},
 CAST(COALESCE(non_overlapping_events_holdout >= {STUDY['holdout']} AND test_mean_net_return_holdout > 0, FALSE) AS BIGINT) AS holdout_pass
 FROM disc LEFT JOIN hw USING ({sql.KEYS}) WHERE discovery_pass""",
)
def c4_j4_holdout(spark, sf):
    _, holdout = disc.candidate_tables(stage(summary_of(spark, sf)), CONFIG)
    return out(holdout.select(*disc.KEYS, "discovery_score", *HOLDOUT_WIDE, "holdout_pass"), doubles=HOLDOUT_WIDE)


_RANK = "SELECT '{0}' AS listing, row_number() OVER (ORDER BY {1}) AS place, pair, {2} FROM {3}"
_HYPOTHESIS = "direction, CAST(horizon_bars AS BIGINT) AS horizon_bars"


@query(
    "o1_o4_ranked",
    f"""{sql.to_summary()}, {sql.discovery_cte()}, hw AS ({sql.wide(('holdout',))}),
 ho AS (SELECT disc.*, hw.* EXCLUDE ({sql.KEYS}), COALESCE(non_overlapping_events_holdout >= {STUDY['holdout']} AND test_mean_net_return_holdout > 0, FALSE) AS hp
   FROM disc LEFT JOIN hw USING ({sql.KEYS}) WHERE discovery_pass),
 two AS (SELECT 'turtle_channel' AS system_id, * FROM disc UNION ALL SELECT 'turtle_strict', * FROM disc)
 {_RANK.format('candidates', f'discovery_score DESC NULLS LAST, validation_q_value NULLS LAST, {sql.KEYS}', _HYPOTHESIS, 'disc WHERE discovery_pass')}
 UNION ALL {_RANK.format('holdout', f'hp DESC, mean_net_return_holdout DESC NULLS LAST, {sql.KEYS}', _HYPOTHESIS, 'ho')}
 UNION ALL {_RANK.format('combined', 'system_id, pair, direction, horizon_bars', _HYPOTHESIS, 'two')}
 UNION ALL {_RANK.format('catalog', 'timeframe, pair', 'timeframe, CAST(NULL AS BIGINT)', "(SELECT DISTINCT event_type AS pair, t.timeframe FROM events, (VALUES ('1h'), ('4h'), ('1d')) t(timeframe))")}""",
)
def o1_o4_ranked(spark, sf):
    """Places of candidates, holdout rows, combined hypotheses and catalog files in their orders."""
    summary = stage(summary_of(spark, sf))
    selected, holdout = disc.candidate_tables(summary, CONFIG)
    combined = disc.combine_discovery(spark, tagged(spark, sf))
    listings = {
        "candidates": (selected, disc.candidate_order()),
        "holdout": (holdout, disc.holdout_order()),
        "combined": (combined, disc.combined_order()),
        "catalog": (catalog_of(spark, sf).withColumns({"direction": F.col("timeframe"), "horizon_bars": F.lit(None).cast("int")}), [F.asc("timeframe"), F.asc("pair")]),
    }
    rows = None
    for name, (table, order) in listings.items():
        listed = ranked(table, *order, name="place").select(F.lit(name).alias("listing"), "place", "pair", "direction", "horizon_bars")
        rows = listed if rows is None else rows.unionByName(listed)
    return out(rows)


@query(
    "k1_k4_k8_study_outputs",
    f"""{sql.to_summary()}, {sql.discovery_cte()}, hw AS ({sql.wide(('holdout',))}),
 ho AS (SELECT *, COALESCE(non_overlapping_events_holdout >= {STUDY['holdout']} AND test_mean_net_return_holdout > 0, FALSE) AS hp FROM disc LEFT JOIN hw USING ({sql.KEYS}) WHERE discovery_pass),
 totals AS (SELECT count(*) AS hypotheses_tested, count(*) FILTER (train_eligible) AS train_eligible_hypotheses, count(*) FILTER (discovery_pass) AS candidate_rows,
   (SELECT count(*) FROM ho WHERE hp) AS holdout_passed FROM disc)
 SELECT * FROM (SELECT 'summary_discovery' AS listing, count(*) AS rows, count(DISTINCT pair) AS pairs, round(sum(p_value), 6) AS p_values FROM summary WHERE period <> 'holdout'
 UNION ALL SELECT 'discovery_tests', count(*), count(DISTINCT pair), round(sum(p_value_validation), 6) FROM disc
 UNION ALL SELECT 'candidates_train_validation', count(*), count(DISTINCT pair), round(sum(p_value_validation), 6) FROM disc WHERE discovery_pass
 UNION ALL SELECT 'holdout_report', count(*), count(DISTINCT pair), round(sum(p_value_holdout), 6) FROM ho
 UNION ALL SELECT 'dataset_coverage', count(DISTINCT user_id), count(DISTINCT user_id), NULL FROM events
 UNION ALL SELECT 'errors', 0, 0, NULL FROM (SELECT 1)) CROSS JOIN totals""",
)
def k1_k4_k8_study_outputs(spark, sf):
    """A study from market files to its folder: the six tables read back by their headers (one is
    empty) and the totals of its summary document."""
    folder = f"{shared_dir(prepare(spark))}/study-{uuid4().hex}"
    write_market_files(half_daily(spark, sf), f"{folder}/data", "12h")
    totals = run_event_study(
        spark, f"{folder}/data", f"{folder}/out", START, END, system="turtle_channel", timeframe="12h", config=CONFIG, entry_length=5
    )
    p_values = {"summary_discovery": "p_value", "holdout_report": "p_value_holdout", "dataset_coverage": None, "errors": None}
    rows = None
    for name in ("summary_discovery", "discovery_tests", "candidates_train_validation", "holdout_report", "dataset_coverage", "errors"):
        p = p_values.get(name, "p_value_validation")
        table = spark.read.csv(f"{folder}/out/{name}.csv", header=True)
        counted = table.agg(
            F.lit(name).alias("listing"), F.count(F.lit(1)).alias("rows"), F.countDistinct("pair").alias("pairs"),
            F.round(F.sum(F.col(p).cast("double")), 6).alias("p_values") if p else F.lit(None).cast("double").alias("p_values"),
        )
        rows = counted if rows is None else rows.unionByName(counted)
    document = spark.read.json(f"{folder}/out/result_summary.json", multiLine=True)
    names = ("hypotheses_tested", "train_eligible_hypotheses", "candidate_rows", "holdout_passed")
    if document.first().asDict()["hypotheses_tested"] != totals["hypotheses_tested"]:
        raise AssertionError("the summary written is not the one returned")
    return out(rows.crossJoin(F.broadcast(document.select(*names))))


@query(
    "a18_result_counts",
    f"""{sql.to_summary()}, {sql.discovery_cte()}, hw AS ({sql.wide(('holdout',))})
 SELECT count(*) AS hypotheses_tested, count(*) FILTER (train_eligible) AS train_eligible_hypotheses, count(*) FILTER (discovery_pass) AS candidate_rows,
 count(*) FILTER (discovery_pass AND COALESCE(non_overlapping_events_holdout >= {STUDY['holdout']} AND test_mean_net_return_holdout > 0, FALSE)) AS holdout_passed
 FROM disc LEFT JOIN hw USING ({sql.KEYS})""",
)
def a18_result_counts(spark, sf):
    summary = stage(summary_of(spark, sf))
    table = stage(disc.discovery_table(summary, CONFIG))
    holdout = disc.holdout_report(table.filter("discovery_pass"), summary, CONFIG)
    counted = table.agg(
        F.count(F.lit(1)).alias("hypotheses_tested"),
        F.count(F.when(F.col("train_eligible"), 1)).alias("train_eligible_hypotheses"),
        F.count(F.when(F.col("discovery_pass"), 1)).alias("candidate_rows"),
    )
    passed = holdout.agg(F.count(F.when(F.col("holdout_pass"), 1)).alias("holdout_passed"))
    return out(counted.crossJoin(F.broadcast(passed)))


# -- comparison ----------------------------------------------------------------------------


def tagged(spark, sf) -> list[DataFrame]:
    """Discovery tables of two experiments: the study, and the same with other thresholds."""
    summary = stage(summary_of(spark, sf))
    strict = StudyConfig(horizons_bars=HORIZONS, minimum_train_events=3, minimum_validation_events=2,
                         minimum_holdout_events=1, validation_fdr=1.0)
    other = ExperimentSpec(**{**SPEC.__dict__, "system_id": "turtle_strict", "parameters": {"entry_length": 5, "strict": True}})
    return [disc.tag_result(disc.discovery_table(summary, c), s) for c, s in ((CONFIG, SPEC), (strict, other))]


_TAGS = "'{0}' AS system_id, '1' AS system_version, '12h' AS timeframe, {1} AS min_train, 2 AS min_validation"
GLOBAL = f"""
 two AS (SELECT {_TAGS.format('turtle_channel', 2)}, * FROM dw UNION ALL SELECT {_TAGS.format('turtle_strict', 3)}, * FROM dw),
 ge AS (SELECT *, COALESCE(non_overlapping_events_train >= min_train AND test_mean_net_return_train > 0, FALSE) AS eligible FROM two),
 gp AS (SELECT *, COALESCE(p_value_validation, 1.0) AS p FROM ge WHERE eligible),
 gr AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM gp),
 gq AS (SELECT system_id, {sql.KEYS}, least(1.0, min(raw) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM gr),
 corrected AS (SELECT ge.*, gq.q, (SELECT count(*) FROM gp) AS family, COALESCE(eligible AND non_overlapping_events_validation >= min_validation
   AND test_mean_net_return_validation > 0 AND gq.q <= 0.9, FALSE) AS pass FROM ge LEFT JOIN gq USING (system_id, {sql.KEYS}))"""


@query(
    "c5_u2_global_fdr",
    f"""{sql.to_summary()}, {sql.discovery_cte()}, {GLOBAL} SELECT system_id, system_version, timeframe, {sql.KEYS},
 round(q, 9) AS global_validation_q_value, family AS global_fdr_family_size, CAST(pass AS BIGINT) AS global_discovery_pass FROM corrected""",
)
def c5_u2_global_fdr(spark, sf):
    corrected = disc.global_fdr(disc.combine_discovery(spark, [stage(t) for t in tagged(spark, sf)]), global_fdr=0.9)
    return out(
        corrected.select("system_id", "system_version", "timeframe", *disc.KEYS, "global_validation_q_value",
                         "global_fdr_family_size", "global_discovery_pass")
    )


@query(
    "a8_system_coverage",
    f"""{sql.to_summary()}, {sql.discovery_cte()}, {GLOBAL} SELECT system_id, system_version, timeframe, count(*) AS hypotheses_tested,
 count(*) FILTER (pass) AS global_candidate_rows, count(DISTINCT pair) FILTER (pass) AS unique_candidate_pairs,
 COALESCE(array_to_string(list_sort(list(DISTINCT direction) FILTER (pass)), ','), '') AS directions,
 COALESCE(array_to_string(list_sort(list(DISTINCT horizon_bars) FILTER (pass)), ','), '') AS horizon_bars FROM corrected GROUP BY ALL""",
)
def a8_system_coverage(spark, sf):
    corrected = disc.global_fdr(disc.combine_discovery(spark, [stage(t) for t in tagged(spark, sf)]), global_fdr=0.9)
    return out(disc.system_coverage(stage(corrected)).drop("experiment_id"))


@query(
    "a19_comparison_counts",
    f"""{sql.to_summary()}, {sql.discovery_cte()}, {GLOBAL} SELECT count(*) AS hypotheses_tested, count(*) FILTER (pass) AS global_candidate_rows,
 count(DISTINCT pair) FILTER (pass) AS unique_candidate_pairs, count(DISTINCT system_id) AS experiments FROM corrected""",
)
def a19_comparison_counts(spark, sf):
    corrected = disc.global_fdr(disc.combine_discovery(spark, [stage(t) for t in tagged(spark, sf)]), global_fdr=0.9)
    return out(comparison_counts(stage(corrected)))


@query(
    "k2_comparison_outputs",
    f"""{sql.to_summary()}, {sql.discovery_cte()}, {GLOBAL}, s AS (SELECT system_id, count(*) AS tested, count(*) FILTER (pass) AS chosen FROM corrected GROUP BY ALL)
 SELECT system_id, {sql.KEYS}, round(q, 9) AS global_validation_q_value, CAST(pass AS BIGINT) AS candidate, tested, chosen,
  (SELECT count(*) FROM corrected) AS hypotheses_tested, (SELECT count(DISTINCT pair) FROM corrected WHERE pass) AS unique_candidate_pairs FROM corrected JOIN s USING (system_id)""",
)
def k2_comparison_outputs(spark, sf):
    """Two discovery tables compared from their files; the three tables and the manifest read back."""
    folder = f"{shared_dir(prepare(spark))}/comparison-{uuid4().hex}"
    inputs = [f"{folder}/{i}.csv" for i in range(2)]
    for path, table in zip(inputs, tagged(spark, sf), strict=True):
        write_csv(table, path)
    manifest = run_comparison(spark, inputs, f"{folder}/out", global_rate=0.9)
    key = "system_id string, pair string, direction string, horizon_bars int, holding_minutes int"
    read = lambda name: spark.read.csv(f"{folder}/out/{name}.csv", header=True)
    typed = [F.col(c.split()[0]).cast(c.split()[1]) for c in key.split(", ")]
    rows = read("combined_discovery_tests").select(*typed, F.col("global_validation_q_value").cast("double"))
    chosen = read("global_candidates_train_validation").select(*typed, F.lit(1).alias("candidate"))
    systems = read("system_coverage").select("system_id", F.col("hypotheses_tested").cast("long").alias("tested"), F.col("global_candidate_rows").cast("long").alias("chosen"))
    joined = rows.join(chosen, [c.split()[0] for c in key.split(", ")], "left").fillna(0, ["candidate"]).join(systems, "system_id")
    return out(joined.withColumns({c: F.lit(manifest[c]) for c in ("hypotheses_tested", "unique_candidate_pairs")}))


@query(
    "w17_duplicate_hypotheses",
    f"{sql.to_summary()}, {sql.discovery_cte()} SELECT {sql.KEYS}, CAST(2 AS BIGINT) AS count FROM disc WHERE direction = 'long'",
)
def w17_duplicate_hypotheses(spark, sf):
    table = stage(tagged(spark, sf)[0])
    twice = table.unionByName(table.filter("direction = 'long'"))
    return out(disc.duplicate_hypotheses(twice).select(*disc.KEYS, "count"))


# The identifying fields of SPEC as they are hashed, written out so that SQL can work the identifier out itself.
SPEC_TEXT = (
    '{"cost_bps":14.0,"data_end":"2024-01-31","data_start":"2024-01-01","horizon_semantics":"bars","horizons_bars":[1,3,5],'
    '"parameters":{"entry_length":5},"system_id":"turtle_channel","system_version":"1","timeframe":"12h",'
    '"universe_fingerprint":"' + 64 * "a" + '","universe_fingerprint_basis":"source_sha256_v1"}'
)


@query(
    "k1_s5_p28_csv_round_trip",
    f"""{sql.to_summary()}, {sql.discovery_cte()} SELECT left(sha256('{SPEC_TEXT}'), 16) AS experiment_id, 'turtle_channel' AS system_id, '1' AS system_version,
 '12h' AS timeframe, {sql.KEYS}, {sql.rounded('p_value_validation', 'test_mean_net_return_train')} FROM disc""",
)
def k1_s5_p28_csv_round_trip(spark, sf):
    """Tagged discovery rows written as CSV and read back with the declared schema."""
    table = tagged(spark, sf)[0]
    columns = list(disc.REQUIRED)
    path = f"{shared_dir(spark)}/csv-{uuid4().hex}"
    write_csv(table.select(*columns), path)
    back = read_table(spark, path, ", ".join(f"{c} {t}" for c, t in disc.REQUIRED.items()))
    return out(back.select(*disc.IDENTITY, *disc.KEYS, "p_value_validation", "test_mean_net_return_train"))


@query(
    "k7_checksums",
    """WITH l AS (SELECT event_type, user_id, event_type || ',' || user_id || ',' || count(*) || chr(10) AS line FROM events GROUP BY event_type, user_id)
 SELECT 'event_type=' || event_type AS folder, sha256(string_agg(line, '' ORDER BY user_id)) AS sha256 FROM l GROUP BY event_type""",
)
def k7_checksums(spark, sf):
    """Checksums of a folder that Spark wrote, one file an event type, by the files' own bytes."""
    path = f"{shared_dir(prepare(spark))}/sums-{uuid4().hex}"
    counts = read_events(spark, sf).groupBy("event_type", "user_id").count()
    line = F.concat_ws(",", "event_type", "user_id", "count").alias("value")
    lines = counts.repartition("event_type").sortWithinPartitions("event_type", "user_id").select("event_type", line)
    lines.write.partitionBy("event_type").option("compression", "none").text(path)
    return checksums(spark, path).select(F.regexp_extract("file", "^(event_type=[^/]+)/", 1).alias("folder"), "sha256")


# -- trades ------------------------------------------------------------------------------------


@query(
    "a9_a13_pair_metrics",
    f"""WITH {sql.trades_cte()}, p AS (SELECT *, pair AS pair_ FROM tr), {sql.drawdown_cte('strategy, timeframe, pair', 'p')}
 SELECT * FROM (SELECT strategy, timeframe, pair, {sql.trade_columns()} FROM tr GROUP BY ALL) JOIN dd USING (strategy, timeframe, pair)""",
)
def a9_a13_pair_metrics(spark, sf):
    metrics = tm.pair_metrics(trades_from_events(spark, sf))
    return out(_coarse(metrics))


def _coarse(metrics: DataFrame) -> DataFrame:
    """Sums grow with the data: compare them to six digits."""
    return metrics.withColumns({c: F.round(c, 6) for c in ("sum_adjusted_returns", "funding_fees_sum")})


@query("a10_overall_metrics", f"WITH {sql.trades_cte()} SELECT strategy, timeframe, {sql.trade_columns()}, CAST(4.0 AS DOUBLE) AS slippage_bps_round_trip FROM tr GROUP BY ALL")
def a10_overall_metrics(spark, sf):
    return out(_coarse(tm.overall_metrics(trades_from_events(spark, sf))))


@query(
    "a11_direction_metrics",
    f"""WITH {sql.trades_cte()}, p AS (SELECT * REPLACE ('__ALL__' AS pair), pair AS pair_ FROM tr UNION ALL SELECT *, pair AS pair_ FROM tr),
 {sql.drawdown_cte('strategy, timeframe, pair, direction', 'p')}
 SELECT * FROM (SELECT strategy, timeframe, pair, direction, {sql.trade_columns(sides=False)} FROM p GROUP BY ALL) JOIN dd USING (strategy, timeframe, pair, direction)""",
)
def a11_direction_metrics(spark, sf):
    return out(_coarse(tm.direction_metrics(trades_from_events(spark, sf))))


@query("a12_exit_reasons", f"WITH {sql.trades_cte()} SELECT strategy, timeframe, exit_reason, count(*) AS trades, round(avg(r), 9) AS expectancy FROM tr GROUP BY ALL")
def a12_exit_reasons(spark, sf):
    return out(tm.exit_reason_metrics(trades_from_events(spark, sf)))


@query(
    "k3_k4_trade_outputs",
    f"""WITH {sql.trades_cte()}, p AS (SELECT * REPLACE ('__ALL__' AS pair) FROM tr UNION ALL SELECT * FROM tr)
 SELECT 'pair_metrics' AS listing, strategy, pair, NULL AS part, count(*) AS trades, round(avg(r), 9) AS expectancy FROM tr GROUP BY ALL
 UNION ALL SELECT 'direction_metrics', strategy, pair, direction, count(*), round(avg(r), 9) FROM p GROUP BY ALL
 UNION ALL SELECT 'exit_reason_metrics', strategy, NULL, exit_reason, count(*), round(avg(r), 9) FROM tr GROUP BY ALL
 UNION ALL SELECT 'overall_metrics', strategy, NULL, NULL, count(*), round(avg(r), 9) FROM tr GROUP BY ALL""",
)
def k3_k4_trade_outputs(spark, sf):
    """The four files of a trade summary, read back."""
    folder = f"{shared_dir(prepare(spark))}/trades-{uuid4().hex}"
    write_trade_summary(trades_from_events(spark, sf), folder)
    parts = {"pair_metrics": None, "direction_metrics": "direction", "exit_reason_metrics": "exit_reason", "overall_metrics": None}
    rows = None
    for name, part in parts.items():
        table = spark.read.json(f"{folder}/{name}.json") if name == "overall_metrics" else spark.read.csv(f"{folder}/{name}.csv", header=True)
        text = lambda c: (F.col(c) if c in table.columns else F.lit(None)).cast("string")  # noqa: B023, E731
        listed = table.select(
            F.lit(name).alias("listing"), "strategy", text("pair").alias("pair"), text(part).alias("part"),
            F.col("trades").cast("long").alias("trades"), F.col("expectancy").cast("double").alias("expectancy"),
        )
        rows = listed if rows is None else rows.unionByName(listed)
    return out(rows)


@query(
    "s7_s8_report_zip",
    f"""WITH {sql.trades_cte()}, u AS (SELECT tr.*, user_id, value FROM tr JOIN events ON trade_no = event_id),
 c AS (SELECT user_id, count(*) FILTER (trade_no % 3 = 0) AS early, count(*) FILTER (trade_no % 3 <> 0) AS late FROM u GROUP BY user_id)
 SELECT 'user-' || user_id || '.zip' AS archive, CAST(user_id = (SELECT max(user_id) FROM c) AS BIGINT) AS newest, 'main' AS strategy,
  row_number() OVER (PARTITION BY user_id ORDER BY trade_no) - 1 AS trade_no, pair, round((value - 50) / 1000, 9) AS profit_ratio, CAST(is_short AS BIGINT) AS is_short,
  {sql.day('open_date')} AS open_date, {sql.day('close_date')} AS close_date, trade_duration, exit_reason, funding_fees
 FROM u JOIN c USING (user_id) WHERE (trade_no % 3 = 0) = (early >= late)""",
)
def s7_s8_report_zip(spark, sf):
    """An archive for each user, of two reports and other members: the report with more trades is read.
    The last user's archive is written last, so it is the newest."""
    folder = f"{shared_dir(prepare(spark))}/reports-{uuid4().hex}"
    users = read_events(spark, sf).select(F.col("event_id").alias("trade_no"), "user_id")
    last = users.agg(F.max("user_id").alias("last")).first().last
    moment = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(c)
    trades = trades_from_events(spark, sf).join(users, "trade_no")
    trades = stage(trades.select("user_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("name"), "trade_no", "pair", "profit_ratio",
                                 "is_short", moment("open_date"), moment("close_date"), "trade_duration", "exit_reason", "funding_fees"))
    for own in (f"user_id <> {last}", f"user_id = {last}"):
        write_report_archives(trades.filter(own).drop("user_id"), folder)
    newest = newest_file(spark, folder)
    rows = read_trades(spark, folder, strategy="main").withColumn("newest", F.col("archive") == newest)
    return out(rows.withColumn("archive", F.regexp_extract("archive", "([^/]+)$", 1)))


def _side(side: str) -> str:
    gain, loss = (f"sum(r) FILTER (direction = '{side}' AND r {op} 0)" for op in ("> ", "<"))
    return f"""count(*) FILTER (direction = '{side}') AS {side}_trades, avg(r) FILTER (direction = '{side}') AS {side}_expectancy,
  CASE WHEN count(*) FILTER (direction = '{side}') > 0 THEN CASE WHEN COALESCE(-{loss}, 0) > 0 THEN COALESCE({gain}, 0) / -{loss} ELSE 'inf'::DOUBLE END END AS {side}_profit_factor"""


SUITE = f"""WITH {sql.trades_cte()}, runs AS (SELECT DISTINCT 'system_' || CAST(event_id % 5 AS VARCHAR) AS strategy, '1h' AS timeframe FROM events),
 s AS (SELECT strategy, timeframe, count(*) AS trades, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(r) AS expectancy,
  CASE WHEN COALESCE(-sum(r) FILTER (r < 0), 0) > 0 THEN COALESCE(sum(r) FILTER (r > 0), 0) / -sum(r) FILTER (r < 0) ELSE 'inf'::DOUBLE END AS profit_factor,
  avg(trade_duration) AS avg_duration_minutes, {_side('long')}, {_side('short')} FROM tr GROUP BY ALL),
 j AS (SELECT strategy, timeframe, COALESCE(trades, 0) AS trades, win_rate, expectancy, profit_factor, avg_duration_minutes,
   COALESCE(long_trades, 0) AS long_trades, long_expectancy, long_profit_factor, COALESCE(short_trades, 0) AS short_trades, short_expectancy, short_profit_factor
   FROM runs LEFT JOIN s USING (strategy, timeframe)),
 k AS (SELECT *, CASE WHEN trades <= 0 THEN 'NO_TRADES' WHEN expectancy > 0 AND profit_factor > 1 THEN 'POSITIVE_SMOKE' ELSE 'NEGATIVE_SMOKE' END AS status FROM j)"""


def suite_of(spark, sf) -> DataFrame:
    runs = read_events(spark, sf).select(
        F.concat(F.lit("system_"), (F.col("event_id") % 5).cast("string")).alias("strategy"), F.lit("1h").alias("timeframe")
    )
    return tm.suite_summary(runs.distinct(), trades_from_events(spark, sf))


@query(
    "c7_j6_p26_suite",
    f"""{SUITE} SELECT strategy, timeframe, trades, {sql.rounded('win_rate', 'expectancy', 'profit_factor', 'avg_duration_minutes')}, long_trades,
 {sql.rounded('long_expectancy', 'long_profit_factor')}, short_trades, {sql.rounded('short_expectancy', 'short_profit_factor')}, status FROM k""",
)
def c7_j6_p26_suite(spark, sf):
    return out(suite_of(spark, sf))


@query(
    "f11_display_cells",
    f"""{SUITE} SELECT strategy, COALESCE(printf('%.4f%%', expectancy * 100), '-') AS expectancy, COALESCE(printf('%.3f', profit_factor), '-') AS profit_factor FROM k""",
)
def f11_display_cells(spark, sf):
    return suite_of(spark, sf).select(
        "strategy", tm.as_percent(F.col("expectancy")).alias("expectancy"), tm.as_number(F.col("profit_factor")).alias("profit_factor")
    )


# -- reuse and audit ------------------------------------------------------------------------------


def _run_owners(spark, sf):
    """Every user once, dealt over all cores: Spark would join such small rows into one task,
    which then writes the files of all of them one after another. The key is not that of the
    distinct rows, as Spark leaves out a second shuffle of the same key."""
    users = read_events(spark, sf).select("user_id").distinct()
    return users.repartition(4 * spark.sparkContext.defaultParallelism, F.xxhash64("user_id"))


def _manifest():
    """Manifest of the run of a row's user."""
    return F.to_json(
        F.struct(
            F.concat(F.lit("system_"), (F.col("user_id") % 3).cast("string")).alias("strategy"),
            F.lit("f" * 64).alias("strategy_sha256"),
            F.lit("1m").alias("timeframe"),
            F.lit("2024-01-01T00:00:00+00:00").alias("start_inclusive"),
            F.lit("2024-01-31T00:00:00+00:00").alias("end_exclusive"),
            F.lit(2).alias("pair_count"),
            F.lit(0.0005).alias("fee_per_side"),
            F.lit(4.0).alias("post_backtest_slippage_bps_round_trip"),
        )
    )


@query(
    "j5_s6_reusable_runs",
    """SELECT CAST(n AS BIGINT) AS request, min('run-' || CAST(user_id AS VARCHAR)) AS run FROM (
   SELECT user_id, user_id % 3 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) WHERE i = 1 AND user_id % 2 = 0 AND user_id % 5 <> 0 GROUP BY n""",
)
def j5_s6_reusable_runs(spark, sf):
    """Manifests written by users' runs, read back from JSON files and matched to three requests."""
    root = f"{shared_dir(prepare(spark))}/runs-{uuid4().hex}"
    run = F.coalesce(F.concat(F.lit("run-"), F.col("user_id").cast("string")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    name = F.concat(F.lit("run="), run, F.lit("/run_manifest.json"))
    write_each(_run_owners(spark, sf).select(name.alias("name"), F.encode(_manifest(), "UTF-8").alias("content")), root)
    # every file is opened once, though three tables are made of them; dealt, so that few files hold the rows
    written = stage(read_manifests(spark, root).repartition("run_dir"))
    written = written.withColumn("run", F.regexp_extract("run_dir", "run=(run-[0-9]+)$", 1))
    number = F.regexp_extract("run", "([0-9]+)$", 1).cast("int")
    lists = written.select("run_dir", F.when(number % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("B"), F.lit("A"))).alias("pairs"))
    archives = written.filter(number % 5 != 0).select("run_dir")  # the others left no archive
    asked = requests_table(
        spark, [(RunRequest(f"system_{i}", "f" * 64, "1m", START, END), ["A", "B"]) for i in range(3)]
    )
    found = reusable_runs(asked, written, lists, archives)
    return out(found.select("request", F.regexp_extract("run_dir", "run=(run-[0-9]+)$", 1).alias("run")))


@query(
    "s9_j5_pair_lists",
    """SELECT CAST(n AS BIGINT) AS request, min('run-' || CAST(user_id AS VARCHAR)) AS run FROM (
   SELECT DISTINCT user_id, user_id % 3 AS n FROM events) WHERE user_id % 2 = 0 AND user_id % 5 <> 0 GROUP BY n""",
)
def s9_j5_pair_lists(spark, sf):
    """Run folders with manifest, pair list and, but for every fifth, an archive; matched to three requests."""
    root = f"{shared_dir(prepare(spark))}/runs-{uuid4().hex}"
    number = F.col("user_id")
    # blanks and empty lines are no pairs; runs of odd numbers have the same pairs in another order
    listed = F.when(number % 2 == 0, F.lit(" A\r\n\n\tB \n")).otherwise(F.lit("B\nA"))
    file = lambda name, text: F.struct(F.lit(name).alias("file"), text.alias("text"))
    kinds = F.array(file("run_manifest.json", _manifest()), file("pairs.txt", listed), file("backtest/r.zip", F.when(number % 5 != 0, F.lit("zip"))))
    each = _run_owners(spark, sf).select("user_id", F.explode(kinds).alias("f")).filter("f.text is not null")
    name = F.concat(F.lit("run-"), F.col("user_id").cast("string"), F.lit("/"), F.col("f.file"))
    write_each(each.select(name.alias("name"), F.encode("f.text", "UTF-8").alias("content")), root)
    zips = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    plain = lambda df: df.withColumn("run_dir", F.regexp_replace("run_dir", "^file:/+", "/"))
    archives = zips.select(folder_of(folder_of(F.col("path"))).alias("run_dir"))
    asked = requests_table(spark, [(RunRequest(f"system_{i}", "f" * 64, "1m", START, END), ["A", "B"]) for i in range(3)])
    found = reusable_runs(asked, plain(read_manifests(spark, root)), plain(read_pair_lists(spark, root)), plain(archives))
    return out(found.select("request", F.regexp_extract("run_dir", "(run-[0-9]+)$", 1).alias("run")))


@query(
    "c6_lookahead_clean",
    "SELECT 'x' AS system, 'x' AS pair, 'x' AS date, CAST(0 AS BIGINT) AS long_full, CAST(0 AS BIGINT) AS long_then FROM events WHERE FALSE",
)
def c6_lookahead_clean(spark, sf):
    """No registered system may change a past signal; so this has no rows."""
    bars = stage(hourly(spark, sf))
    rows = None
    for system in REGISTRY:
        found = system_violations(bars, system, [CUTOFF]).select("system", "pair", "date", "long_full", "long_then")
        rows = found if rows is None else rows.unionByName(found)
    return out(rows)


@query(
    "c6_lookahead_leaky",
    f"""WITH {sql.HOURLY}, a AS (SELECT pair, date, close > (max(close) OVER (PARTITION BY pair)) * 0.5 AS long_full FROM b),
 c AS (SELECT pair, date, close > (max(close) OVER (PARTITION BY pair)) * 0.5 AS long_then FROM b WHERE date <= TIMESTAMP '{CUTOFF}')
 SELECT 'leaky' AS system, pair, {sql.day('date')} AS date, CAST(long_full AS BIGINT) AS long_full, CAST(long_then AS BIGINT) AS long_then
 FROM a JOIN c USING (pair, date) WHERE long_full <> long_then""",
)
def c6_lookahead_leaky(spark, sf):
    """A signal scaled by the whole series' maximum repaints and is found out."""

    def leaky(bars: DataFrame) -> DataFrame:
        top = bars.groupBy("pair").agg(F.max("close").alias("top"))
        return bars.join(top, "pair").select(
            "pair", "timeframe", "date", (F.col("close") > F.col("top") * 0.5).alias("long_signal"), F.lit(False).alias("short_signal")
        )

    found = look_ahead_violations(hourly(spark, sf), leaky, [CUTOFF], name="leaky")
    return out(found.select("system", "pair", "date", "long_full", "long_then"))


def entry_study(spark, sf):
    """Flagship: bars to liquidity-sweep signals to events to tested hypotheses."""
    config = StudyConfig(horizons_bars=(1, 5), minimum_train_events=5, minimum_validation_events=3, minimum_holdout_events=3)
    bars = bars_from_events(spark, sf, timeframe="4h")
    return ev.study_summary(bars, "liquidity_sweep_reclaim", config, TRAIN_END, VALIDATION_END, lookback=5)


assert set(REGISTRY) == {system for system, _, _ in SIGNALS.values()}
