"""Files in, results out: sources, catalog, studies, trades, reuse and sinks."""

import gzip
import hashlib
import json
import zipfile
from datetime import datetime, timedelta

import pandas as pd
import pyarrow.parquet as pq
import pytest
from bars import walk
from pyspark.sql import functions as F

from checks import queries
from tidebars import fixtures, sinks
from tidebars.config import (
    ExperimentSpec, RunRequest, StudyConfig, day_range, suite_timeframe_detail, timeframe_delta,
)
from tidebars.fixtures import write_each
from tidebars.operators import catalog as quality
from tidebars.operators import identity
from tidebars.operators import trades as tm
from tidebars.operators.reuse import requests_table, reusable_runs
from tidebars.plans import studies
from tidebars.sources import market_files, reports

START, END = "2026-01-01", "2026-01-02"


def save(folder, pair, timeframe, pdf, extension):
    name = folder / f"{pair}_USDT_USDT-{timeframe}-futures.{extension}"
    pdf = pdf[["date", "open", "high", "low", "close", "volume"]]
    if extension == "parquet":
        pdf.to_parquet(name)
    elif extension == "feather":
        pdf.to_feather(name)
    else:
        rows = pdf.assign(date=pdf["date"].astype("datetime64[ms, UTC]").astype("int64")).values.tolist()
        content = json.dumps(rows).encode()
        name.write_bytes(gzip.compress(content) if extension == "json.gz" else content)


@pytest.fixture(scope="module")
def data_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    for i, (pair, extension) in enumerate(
        [("AAA", "parquet"), ("BBB", "feather"), ("CCC", "json"), ("DDD", "json.gz"), ("EEE", "parquet")]
    ):
        pdf = walk(pair, 1440 if pair != "EEE" else 30, i, gaps=0.0)
        pdf["date"] = pdf["date"].astype("datetime64[ms, UTC]")
        save(folder, pair, "1m", pdf, extension)
    save(folder, "AAA", "5m", walk("AAA", 20, 9, gaps=0).assign(date=lambda d: d.date.astype("datetime64[ms, UTC]")), "parquet")
    (folder / "AAA_USDT_USDT-1m-mark.parquet").write_bytes(b"not read")
    return str(folder)


def test_names():
    assert market_files.parse_file_name("BTC_USDT_USDT-1m-futures.feather") == ("BTC/USDT:USDT", "1m", "feather")
    assert market_files.parse_file_name("A_B_USDT_USDT-4h-futures.json.gz") == ("A_B/USDT:USDT", "4h", "json.gz")
    assert market_files.parse_file_name("BTC_USDT_USDT-1m-mark.feather") is None
    with pytest.raises(ValueError, match="Unsupported"):
        market_files.parse_file_name("BTC_USDT-1m-futures.feather")
    assert timeframe_delta("4h").total_seconds() == 14_400
    with pytest.raises(ValueError, match="Unsupported timeframe"):
        timeframe_delta("0m")
    assert day_range("2025-09-20", "2026-09-20") == "20250920-20260920"
    assert (suite_timeframe_detail("1m"), suite_timeframe_detail("5m")) == (None, "1m")


def test_bad_symbol_is_an_error_in_spark(spark):
    df = spark.createDataFrame([("/x/BTC_USDT-1m-futures.parquet",)], "path string")
    with pytest.raises(Exception, match="Unsupported futures filename symbol"):
        market_files.with_file_identity(df).collect()


def test_discovery_and_formats(spark, data_dir):
    found = market_files.discover(spark, data_dir, "1m").collect()
    assert [r.pair for r in found] == [f"{p}/USDT:USDT" for p in ("AAA", "BBB", "CCC", "DDD", "EEE")]
    bars = market_files.load_bars(spark, data_dir, "1m").toPandas()
    for i, pair in enumerate(("AAA", "BBB", "CCC", "DDD")):
        expected = walk(pair, 1440, i, gaps=0.0)
        actual = bars[bars.pair == f"{pair}/USDT:USDT"].sort_values("date").reset_index(drop=True)
        assert (actual["date"] == expected["date"].dt.tz_localize(None)).all() and len(actual) == 1440
        for column in ("open", "high", "low", "close", "volume"):
            pd.testing.assert_series_equal(actual[column], expected[column], check_names=False)
    with pytest.raises(FileNotFoundError, match="does not exist"):
        market_files.discover(spark, data_dir + "/nowhere")


def test_dirty_files(spark, tmp_path):
    dates = pd.to_datetime(["2026-01-01 00:02", "2026-01-01 00:01", "2026-01-01 00:01", "2026-01-01 00:03"], utc=True)
    pdf = pd.DataFrame({"Date": dates, "OPEN": [1, 2, 3, 4.0], "High": [1, 2, 3, 4.0], "low": [1, 2, 3, 4.0],
                        "close": ["1", "2", "3", "x"], "volume": [1, 2, 3, 4], "extra": 0})
    pdf.to_feather(tmp_path / "AAA_USDT_USDT-1m-futures.feather")
    records = [{"date": "2026-01-01T00:01:00Z", "open": 1, "high": 2, "low": 1, "close": 1.5, "volume": 7}]
    (tmp_path / "BBB_USDT_USDT-1m-futures.json").write_text(json.dumps(records))
    rows = market_files.load_bars(spark, str(tmp_path)).orderBy("pair", "date").collect()
    assert [(r.pair[:3], r.date.minute, r.close) for r in rows] == [("AAA", 1, 3.0), ("AAA", 2, 1.0), ("BBB", 1, 1.5)]
    pdf.drop(columns="volume").to_feather(tmp_path / "CCC_USDT_USDT-1m-futures.feather")
    with pytest.raises(Exception, match="missing columns: volume"):
        market_files.load_bars(spark, str(tmp_path)).collect()
    (tmp_path / "CCC_USDT_USDT-1m-futures.feather").write_bytes(b"damaged")
    (tmp_path / "DDD_USDT_USDT-1m-futures.parquet").write_bytes(b"damaged")
    (tmp_path / "EEE_USDT_USDT-1m-futures.json").write_text("{damaged")
    (tmp_path / "BBB_USDT_USDT-1m-futures.json").unlink()
    save(tmp_path, "FFF", "1m", walk("FFF", 5, 1, gaps=0), "parquet")
    rows = market_files.load_bars(spark, str(tmp_path), skip_unreadable=True).collect()
    assert {r.pair[:3] for r in rows} == {"AAA", "FFF"}
    with pytest.raises(Exception):
        market_files.load_bars(spark, str(tmp_path)).collect()


def test_torn_and_mixed_files(spark, tmp_path):
    pdf = walk("AAA", 4000, 3, gaps=0).assign(date=lambda d: d.date.astype("datetime64[ms, UTC]"))
    save(tmp_path, "AAA", "1m", pdf, "parquet")
    torn = tmp_path / "BBB_USDT_USDT-1m-futures.parquet"
    pdf[["date", "open", "high", "low", "close", "volume"]].to_parquet(torn, row_group_size=1000)
    group = pq.ParquetFile(torn).metadata.row_group(3)
    first = min(group.column(i).dictionary_page_offset or group.column(i).data_page_offset for i in range(6))
    content = bytearray(torn.read_bytes())
    content[first : first + 400] = b"\xff" * 400
    torn.write_bytes(content)
    save(tmp_path, "CCC", "1m", pdf.assign(volume=pdf["volume"].astype(str), date=pdf["date"].astype(str)), "parquet")
    rows = market_files.load_bars(spark, str(tmp_path), skip_unreadable=True).groupBy("pair").count().collect()
    assert {(r.pair[:3], r["count"]) for r in rows} == {("AAA", 4000), ("CCC", 4000)}
    config = StudyConfig(horizons_bars=(1,), minimum_train_events=5, minimum_validation_events=2, minimum_holdout_events=1)
    result = studies.run_event_study(spark, str(tmp_path), str(tmp_path / "out"), START, "2026-01-04", system="turtle_channel", config=config)
    assert (result["pairs_analyzed"], result["pairs_failed"]) == (2, 1)
    errors = spark.read.csv(str(tmp_path / "out" / "errors.csv"), header=True).collect()
    assert [r.pair for r in errors] == ["BBB/USDT:USDT"] and "timerange" not in errors[0].error


def test_parquet_is_planned_by_footers(spark, tmp_path):
    pdf = walk("AAA", 4000, 3, gaps=0)
    plain = pdf[["date", "open", "high", "low", "close", "volume"]].assign(date=lambda d: d["date"].astype("datetime64[ns, UTC]"))
    plain.to_parquet(tmp_path / "AAA_USDT_USDT-1m-futures.parquet", row_group_size=500)
    plain.assign(volume=plain["volume"].astype(str)).to_parquet(tmp_path / "BBB_USDT_USDT-1m-futures.parquet")
    plain.assign(date=plain["date"].astype("datetime64[ms, UTC]")).to_parquet(tmp_path / "CCC_USDT_USDT-1m-futures.parquet")
    plain.drop(columns="volume").to_parquet(tmp_path / "DDD_USDT_USDT-1m-futures.parquet")
    plain.assign(date=plain["date"].astype(str)).to_parquet(tmp_path / "EEE_USDT_USDT-1m-futures.parquet")
    plain.head(0).to_parquet(tmp_path / "FFF_USDT_USDT-1m-futures.parquet")
    (tmp_path / "GGG_USDT_USDT-1m-futures.parquet").write_bytes(b"PAR1 no footer PAR1")
    for name in ("AAA_USDT_USDT-5m-futures.parquet", "AAA_USDT_USDT-5m-futures.feather", "AAA_USDT_USDT-5m-futures.json"):
        (tmp_path / name).write_bytes(b"damaged and never opened")
    before = spark.conf.get("spark.sql.legacy.parquet.nanosAsLong", None)
    files = market_files.discover(spark, str(tmp_path), "1m")
    groups, odd = market_files.group_by_footer(spark, sorted(r.path for r in files.collect()))
    short = lambda paths: [p.rsplit("/", 1)[-1][:3] for p in paths]
    assert sorted(short(paths) for _, paths in groups) == [["AAA"], ["BBB"], ["CCC"]] and short(odd) == ["DDD", "EEE", "FFF", "GGG"]
    bars, problems = market_files.load_files(spark, files, START, pd.Timestamp(START, tz="UTC") + pd.Timedelta(minutes=90))
    assert {(r.pair[:3], r["count"]) for r in bars.groupBy("pair").count().collect()} == {(p, 90) for p in ("AAA", "BBB", "CCC", "EEE")}
    first = {r.pair[:3]: r.d for r in bars.groupBy("pair").agg(F.min("date").alias("d")).collect()}
    assert set(first.values()) == {pd.Timestamp(START)}  # nanoseconds, milliseconds and text alike
    assert {r.pair[:3] for r in problems.collect()} == {"DDD", "GGG"}
    assert spark.conf.get("spark.sql.legacy.parquet.nanosAsLong", None) == before
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")  # row groups of one file go to several tasks
    try:
        schema, paths = next(g for g in groups if short(g[1]) == ["AAA"])
        tasks = market_files._scan(spark, schema, paths, None, None).groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_small_files_are_read_at_once_to_the_same_bars(spark, tmp_path, monkeypatch):
    n = 300
    pdf = walk("AAA", n, 3, gaps=0)[["date", "open", "high", "low", "close", "volume"]]
    stored = lambda unit, zone=", UTC": pdf.assign(date=lambda d: d["date"].dt.tz_localize(None).astype("datetime64[ns]").dt.tz_localize("UTC" if zone else None).astype(f"datetime64[{unit}{zone}]"))
    gone = pdf["volume"].where(pdf.index % 7 != 0)
    twice = pdf.assign(date=pdf["date"].where(pdf.index % 5 != 0, pdf["date"].shift(-1)))  # of two rows the last stays
    old = pdf.assign(date=pd.to_datetime("1899-12-31 23:00", utc=True).as_unit("us") + pd.to_timedelta(pdf.index, unit="min"))
    odd_nanos = stored("ns").assign(date=lambda d: d["date"] + pd.to_timedelta(pdf.index % 3 * 500, unit="ns"))
    plain = {
        "micros": (stored("us"), {}), "millis": (stored("ms"), {}), "nanos": (odd_nanos, {}), "local": (stored("us", ""), {}),
        "int96": (stored("ns"), {"use_deprecated_int96_timestamps": True}), "groups": (stored("us"), {"row_group_size": 40}),
        "holes": (pdf.assign(volume=gone, close=pdf["close"].where(pdf.index % 11 != 0)), {}), "twice": (twice, {}),
        "whole": (pdf.assign(volume=(pdf["volume"] * 100).astype("int64"), open=pdf["open"].astype("float32")), {}),
        "shuffled": (pdf.sample(frac=1, random_state=1)[["volume", "close", "date", "low", "open", "high"]].rename(columns=str.upper), {}),
        "spare": (pdf.assign(note="x", more=[[1, 2]] * n), {}),
    }
    closer = {
        "text": (pdf.assign(volume=pdf["volume"].astype(str)), {}), "days": (pdf.assign(date=pdf["date"].astype(str)), {}),
        "short": (pdf.drop(columns="volume"), {}), "blank": (pdf.assign(volume=float("nan")).astype({"volume": "Float64"}).assign(volume=pd.NA), {}),
        "none": (pdf.head(0), {}), "early": (old, {}), "epoch": (pdf.assign(date=pdf["date"].astype("datetime64[ns, UTC]").astype("int64")), {}),
        "before70": (stored("ns").assign(date=lambda d: d["date"] - pd.Timedelta(days=60 * 365) + pd.Timedelta(1, "ns")), {}),
        "unsigned": (pdf.assign(volume=(pdf["volume"] * 100).astype("uint64")), {}),
    }
    for name, (rows, settings) in {**plain, **closer}.items():
        rows.to_parquet(tmp_path / f"{name}_USDT_USDT-1m-futures.parquet", index=False, **settings)
    (tmp_path / "bytes_USDT_USDT-1m-futures.parquet").write_bytes(b"PAR1 no footer PAR1")
    whole = (tmp_path / "micros_USDT_USDT-1m-futures.parquet").read_bytes()
    (tmp_path / "torn_USDT_USDT-1m-futures.parquet").write_bytes(whole[:40] + whole[140:])
    looked_at = []
    footers = market_files.group_by_footer
    monkeypatch.setattr(market_files, "group_by_footer", lambda spark, paths: looked_at.append(paths) or footers(spark, paths))

    def read(small):
        monkeypatch.setattr(market_files, "SMALL_BYTES", small)
        files = market_files.discover(spark, str(tmp_path), "1m")
        found = []
        for limits in ((None, None), (pd.Timestamp(START, tz="UTC") + pd.Timedelta(minutes=30), pd.Timestamp(START, tz="UTC") + pd.Timedelta(minutes=90))):
            bars, problems = market_files.load_files(spark, files, *limits)
            found.append((bars.columns, sorted(map(tuple, bars.collect())), sorted(r.pair for r in problems.collect())))
        return found

    at_once = read(market_files.SMALL_BYTES)
    short = sorted(path.rsplit("/", 1)[-1].split("_")[0] for path in looked_at[0])
    assert short == sorted([*closer, "bytes", "torn"])  # the others are opened once, by the task that decodes them
    assert at_once == read(-1)  # by footers, as large files
    per_pair = {name: sum(r[0].startswith(name + "/") for r in at_once[0][1]) for name in plain}
    assert per_pair["shuffled"] == per_pair["micros"] == n and per_pair["holes"] < n and per_pair["twice"] == n - 60
    assert {r[0].split("/")[0] for r in at_once[1][1]} >= set(plain) and at_once[0][2] == at_once[1][2]


def test_market_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    moment = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    price = (F.col("id") % 97).cast("double")
    pair = F.when(F.col("id") % 5 == 0, "A/B c").when(F.col("id") % 5 == 1, "").when(F.col("id") % 5 == 2, F.concat(F.lit("p"), F.col("id").cast("string"))).when(F.col("id") % 5 == 3, "long")
    bars = spark.range(30_000).select(pair.alias("pair"), F.lit("1m").alias("timeframe"), moment.alias("date"),
                                      *[price.alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))
    monkeypatch.setattr(fixtures, "_name_files", None)  # no file is named by the driver
    fixtures.write_market_files(bars, str(tmp_path), "1m")
    fixtures.write_market_files(bars, str(tmp_path), "1m")  # as a task that runs again
    names = {p.name for p in tmp_path.iterdir() if p.suffix == ".parquet"}
    own = {f"{p}_USDT_USDT-1m-futures.parquet" for p in ("A%2FB c", "long", "__HIVE_DEFAULT_PARTITION__")}
    assert own < names and len(names) == 6_003
    long = pq.ParquetFile(tmp_path / "long_USDT_USDT-1m-futures.parquet")
    assert long.metadata.num_rows == 6_000 and long.num_row_groups > 3 and long.schema.column(0).physical_type == "INT96"
    back = pd.concat([pq.read_table(tmp_path / name).to_pandas() for name in sorted(own)]).sort_values("date", ignore_index=True)
    expected = bars.filter("pair is null or pair in ('A/B c', '', 'long')").drop("pair", "timeframe").orderBy("date").toPandas()
    pd.testing.assert_frame_equal(back.astype({"date": "datetime64[ns]"}), expected.astype({"date": "datetime64[ns]"}))


def test_study_from_files(spark, data_dir, tmp_path):
    catalog_dir, out = str(tmp_path / "catalog"), str(tmp_path / "run")
    summary = studies.write_catalog(spark, data_dir, catalog_dir, START, END, timeframes=("1m", "5m"))
    assert summary["files"] == 6 and summary["unique_pairs"] == 5 and summary["research_ready_files"] == 4
    assert summary["status_counts"] == {"ready": 4, "too_short": 2}
    with pytest.raises(FileExistsError, match="already exists"):
        studies.write_catalog(spark, data_dir, catalog_dir, START, END, timeframes=("1m", "5m"))
    with pytest.raises(ValueError, match="its bars end at"):
        studies.load_selection(spark, catalog_dir, "1m", START, "2026-01-03")
    with pytest.raises(ValueError, match="it has no"):
        studies.load_selection(spark, catalog_dir, "4h", START, END)
    selection = studies.load_selection(spark, catalog_dir, "1m", START, END).collect()
    assert {r.basis for r in selection} == {identity.SOURCE_HASH_BASIS} and {len(r.value) for r in selection} == {64}

    config = StudyConfig(horizons_bars=(1, 5), minimum_train_events=5, minimum_validation_events=2,
                         minimum_holdout_events=1, validation_fdr=1.0)
    result = studies.run_event_study(spark, data_dir, out, START, END, system="turtle_channel", config=config,
                                     catalog_dir=catalog_dir)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    leaves = sorted(digest(f"{r.pair}|{r.value}") for r in selection)
    branches = [digest("\n".join(h for h in leaves if h[:3] == k)) for k in sorted({h[:3] for h in leaves})]
    assert result["universe_fingerprint"] == digest("\n".join(branches))
    assert result["universe_fingerprint_basis"] == "source_sha256_v1+tree_v1"
    assert (result["pairs_analyzed"], result["pairs_failed"]) == (4, 0)
    assert result["hypotheses_tested"] == 16
    tests = spark.read.csv(f"{out}/discovery_tests.csv", header=True)
    assert tests.columns[:4] == ["experiment_id", "system_id", "system_version", "timeframe"]
    assert not [c for c in tests.columns if "holdout" in c]
    kept = spark.read.csv(f"{out}/summary_discovery.csv", header=True)
    assert {r.period for r in kept.select("period").distinct().collect()} == {"train", "validation"}
    assert spark.read.csv(f"{out}/holdout_report.csv", header=True).count() == result["candidate_rows"]
    listed = dict(reversed(line.split("  ")) for line in (tmp_path / "run" / "SHA256SUMS.txt").read_text().splitlines())
    manifest = (tmp_path / "run" / "run_manifest.json").read_bytes()
    assert listed["run_manifest.json"] == hashlib.sha256(manifest).hexdigest()
    with pytest.raises(FileExistsError, match="in use"):
        studies.run_event_study(spark, data_dir, out, START, END, system="turtle_channel", config=config)

    both = studies.run_comparison(spark, [f"{out}/discovery_tests.csv"], str(tmp_path / "compared"), global_rate=1.0)
    assert both["hypotheses_tested"] == 16 and both["experiments"] == 1
    assert both["global_candidate_rows"] == result["candidate_rows"]
    listed = (tmp_path / "compared" / "SHA256SUMS.txt").read_text().split()
    assert hashlib.sha256((tmp_path / "compared" / "comparison_manifest.json").read_bytes()).hexdigest() in listed
    with pytest.raises(FileExistsError, match="in use"):
        studies.run_comparison(spark, [f"{out}/discovery_tests.csv"], str(tmp_path / "compared"), global_rate=1.0)

    # without a catalog the short file is studied as well, one that is out of range becomes an error row
    later = studies.run_event_study(spark, data_dir, str(tmp_path / "late"), "2026-01-01 01:00", END, config=config)
    assert (later["pairs_analyzed"], later["pairs_failed"]) == (4, 1)
    errors = spark.read.csv(str(tmp_path / "late" / "errors.csv"), header=True).collect()
    assert [r.pair for r in errors] == ["EEE/USDT:USDT"]
    assert later["universe_fingerprint_basis"] == identity.FILE_METADATA_BASIS + identity.TREE


def test_catalog_rules(spark):
    rows = [("A", "1m", "true", None), ("B", "1m", " YES ", "h"), ("C", "1m", "0", None), ("D", "5m", "1", None)]
    catalog = spark.createDataFrame(rows, "pair string, timeframe string, research_ready string, source_sha256 string")
    assert {r.pair for r in quality.ready_rows(catalog, "1m").collect()} == {"A", "B"}
    selection = identity.catalog_selection(catalog, "1m")
    assert {r.basis for r in selection.collect()} == {identity.METADATA_BASIS}
    assert identity.selection_basis(selection.limit(0)).first().basis == identity.EMPTY_BASIS
    wrong = catalog.withColumn("research_ready", F.lit("maybe"))
    with pytest.raises(Exception, match="invalid research_ready"):
        quality.ready_rows(wrong, "1m").collect()
    files = spark.createDataFrame([("A",)], "pair string")
    with pytest.raises(ValueError, match="stale: 1 .*B"):
        quality.check_not_stale(selection, files)
    with pytest.raises(ValueError, match="not present"):
        identity.check_known_pairs(spark.createDataFrame([("Z",)], "pair string"), selection)
    assert [r.pair for r in quality.select_universe(catalog, pair_offset=1, max_pairs=1).collect()] == ["B"]


def test_git_blob(spark):
    content = spark.createDataFrame([(b"hello\n",)], "content binary")
    assert content.select(identity.git_blob_sha1(F.col("content"))).first()[0] == "ce013625030ba8dba906f756967f9e9ca394464a"


def spec(**changes):
    fields = dict(system_id="macd_crossover", system_version="1", timeframe="1m",
                  parameters={"fast": 12, "slow": 26, "signal": 9}, cost_bps=14.0, horizons_bars=(1, 3),
                  data_start="2025-09-20", data_end="2026-09-20", universe_fingerprint="a" * 64,
                  universe_fingerprint_basis="source_sha256_v1")
    return ExperimentSpec(**{**fields, **changes})


def test_experiment_identity():
    base = spec()
    assert len(base.experiment_id) == 16
    assert spec(parameters={"signal": 9, "slow": 26, "fast": 12}).experiment_id == base.experiment_id
    for change in ({"parameters": {"fast": 11}}, {"data_end": "2026-09-21"}, {"universe_fingerprint": "b" * 64}):
        assert spec(**change).experiment_id != base.experiment_id
    for change, message in (
        ({"system_id": "Bad Id"}, "system_id"), ({"cost_bps": -1}, "cost_bps"), ({"horizons_bars": ()}, "horizons"),
        ({"data_end": "2025-01-01"}, "later"), ({"universe_fingerprint": "xyz"}, "SHA-256"), ({"timeframe": ""}, "timeframe"),
    ):
        with pytest.raises(ValueError, match=message):
            spec(**change)
    with pytest.raises(ValueError, match="minimum_holdout_events"):
        StudyConfig(minimum_holdout_events=0)
    with pytest.raises(ValueError, match="validation_fdr"):
        StudyConfig(validation_fdr=0)


TRADES = [
    {"pair": "BTC/USDT:USDT", "profit_ratio": 0.01, "is_short": False, "open_date": "2026-01-01 00:00:00+00:00",
     "close_date": "2026-01-01 01:00:00+00:00", "exit_reason": "exit_signal", "funding_fees": -0.10},
    {"pair": "BTC/USDT:USDT", "profit_ratio": -0.005, "is_short": True, "open_date": "2026-01-02 00:00:00+00:00",
     "close_date": "2026-01-02 02:00:00+00:00", "exit_reason": "exit_signal", "funding_fees": 0.05},
    {"pair": "ETH/USDT:USDT", "profit_ratio": 0.02, "is_short": False, "open_date": "2026-01-01 00:00:00+00:00",
     "close_date": "2026-01-01 03:00:00+00:00", "exit_reason": "exit_signal", "funding_fees": 0.0},
]


def archive(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in members.items():
            z.writestr(f"{name}.json", content)
    return str(path)


def test_trade_reports(spark, tmp_path):
    empty = json.dumps({"strategy": {"Other": {"trades": []}}})
    full = json.dumps({"strategy": {"Example": {"trades": TRADES}}})
    path = archive(tmp_path / "a.zip", config="{}", broken="{", other=empty, report=full)
    trades = reports.read_trades(spark, path)
    assert trades.count() == 3
    btc, eth = tm.pair_metrics(trades).orderBy("pair").collect()
    assert (btc.expectancy, btc.profit_factor) == (pytest.approx(0.0021), pytest.approx(0.0096 / 0.0054))
    assert (btc.long_trades, btc.short_trades, btc.funding_fees_sum) == (1, 1, pytest.approx(-0.05))
    assert btc.max_drawdown_compounded == pytest.approx(-0.0054) and btc.avg_duration_minutes == 90
    assert eth.profit_factor == float("inf") and eth.max_drawdown_compounded == 0.0
    overall = tm.overall_metrics(trades).first()
    assert overall.trades == 3 and "max_drawdown_compounded" not in overall
    directions = {(r.pair, r.direction): r for r in tm.direction_metrics(trades).collect()}
    assert directions["__ALL__", "long"].expectancy == pytest.approx(0.0146)
    assert directions["__ALL__", "short"].expectancy == pytest.approx(-0.0054)
    assert len(directions) == 5
    assert [r.trades for r in tm.exit_reason_metrics(trades).collect()] == [3]
    studies.write_trade_summary(trades, str(tmp_path / "metrics"))
    assert spark.read.csv(str(tmp_path / "metrics" / "pair_metrics.csv"), header=True).count() == 2
    with pytest.raises(ValueError, match="slippage"):
        tm.pair_metrics(trades, slippage_bps_round_trip=-1)
    with pytest.raises(ValueError, match="missing columns: profit_ratio"):
        tm.pair_metrics(trades.drop("profit_ratio"))
    none = trades.limit(0)
    assert tm.pair_metrics(none).isEmpty() and tm.direction_metrics(none).isEmpty()
    assert tm.direction_metrics(trades.drop("is_short")).isEmpty()
    assert tm.overall_metrics(trades.drop("is_short")).first().long_trades is None
    (tmp_path / "plain.json").write_text(full)
    assert reports.read_json_trades(spark, str(tmp_path / "plain.json")).count() == 3

    two = archive(tmp_path / "b.zip", r=json.dumps({"strategy": {"A": {"trades": TRADES}, "B": {"trades": []}}}))
    assert reports.read_trades(spark, two, strategy="A").count() == 3
    for strategy, message in ((None, "name one of its strategies: A, B"), ("C", "it has no strategy C")):
        with pytest.raises(Exception, match=message):
            reports.read_trades(spark, two, strategy=strategy).collect()
    with pytest.raises(Exception, match="no strategy results"):
        reports.read_trades(spark, archive(tmp_path / "c.zip", x="{}")).collect()
    import os

    os.utime(tmp_path / "a.zip", (2_000_000_000, 2_000_000_000))
    assert reports.newest_file(spark, str(tmp_path)).endswith("a.zip")


def test_the_member_with_most_trades_is_read(tmp_path):
    small, large = {"strategy": {"A": {"trades": [1]}}}, {"strategy": {"A": {"trades": [1, 2]}, "B": {"trades": {}}, "C": None}}
    path = archive(tmp_path / "m.zip", note="no JSON", small=json.dumps(small), large=json.dumps(large), list="[1]", odd=json.dumps({"strategy": 5}))
    with open(path, "rb") as file:
        sections = reports.report_sections(file.read())
    assert len(sections) == 4
    assert reports.choose_section(sections, "A").trades == [1, 2]
    with pytest.raises(ValueError, match="name one of its strategies: A, B, C; no list of trades for B, C"):
        reports.choose_section(sections)
    with pytest.raises(ValueError, match="no list of trades for B"):
        reports.choose_section(sections, "B")


def test_a_catalog_of_another_range_is_refused():
    summary = {"start_inclusive": "2026-01-01T00:00:00+00:00", "end_exclusive": "2026-02-01T00:00:00+00:00", "timeframes": ["1m", "1h"]}
    identity.check_catalog_range(summary, "1h", "2026-01-01", "2026-02-01")
    with pytest.raises(ValueError, match="begin at 2026-01-01 00:00, the study's at 2026-01-02 00:00, and it has no 5m bars"):
        identity.check_catalog_range(summary, "5m", "2026-01-02", "2026-02-01")


def test_drawdown_in_blocks(spark):
    """Equity and its maximum carried over many small blocks, total losses and worse included."""
    import numpy as np

    rng = np.random.default_rng(3)
    returns = {"A": rng.normal(0, 0.05, 300), "B": np.r_[-0.1, 0.05, 0.0], "C": np.r_[0.5, -1.2, 0.3, -0.4]}
    rows = [("s", "1m", pair, float(r), None, datetime(2026, 1, 1) + timedelta(hours=i), i)
            for pair, values in returns.items() for i, r in enumerate(values)]
    df = spark.createDataFrame(rows, "strategy string, timeframe string, pair string, profit_ratio double, "
                                     "is_short boolean, close_date timestamp, trade_no bigint")
    adjusted = tm.adjusted_trades(df, 0.0)
    for size in (7, 10_000):
        found = {r.pair: r.max_drawdown_compounded for r in tm.max_drawdown(adjusted, ["pair"], block_rows=size)[0].collect()}
        for pair, values in returns.items():
            equity = pd.Series(1 + values).cumprod()
            assert found[pair] == pytest.approx((equity / equity.cummax() - 1).min(), abs=1e-12), pair


def test_drawdown_of_a_run_too_long_for_a_product(spark):
    """20 000 wins of 5 % are more than a double can hold; the loss of half that follows is half."""
    df = spark.range(20_001).selectExpr(
        "'s' AS strategy", "'1m' AS timeframe", "'A' AS pair", "IF(id < 20000, 0.05D, -0.5D) AS profit_ratio",
        "CAST(NULL AS BOOLEAN) AS is_short", "timestamp_seconds(1767225600 + id * 60) AS close_date", "id AS trade_no")
    for size in (1_000, 65_536):
        found = tm.max_drawdown(tm.adjusted_trades(df, 0.0), ["pair"], block_rows=size)[0].first()
        assert found.max_drawdown_compounded == pytest.approx(-0.5, abs=1e-9)


def test_suite_status(spark):
    runs = spark.createDataFrame([(100, 0.001, 1.2), (100, -0.001, 0.9), (0, None, None)], "n int, e double, p double")
    of = lambda **kw: [r[0] for r in runs.select(tm.smoke_status(F.col("n"), F.col("e"), F.col("p"), **kw)).collect()]
    assert of() == ["POSITIVE_SMOKE", "NEGATIVE_SMOKE", "NO_TRADES"]
    assert of(no_trades=False) == ["POSITIVE_SMOKE", "NEGATIVE_SMOKE", "NEGATIVE_SMOKE"]


def test_reuse(spark, tmp_path):
    def store(name, pairs, *, zipped=True, **changes):
        run = tmp_path / "runs" / name
        (run / "backtest").mkdir(parents=True)
        manifest = {"strategy": "Example", "strategy_sha256": "f" * 64, "timeframe": "1m",
                    "start_inclusive": "2025-09-20T00:00:00+00:00", "end_exclusive": "2026-09-20T00:00:00+00:00",
                    "pair_count": 2, "fee_per_side": 0.0005, "post_backtest_slippage_bps_round_trip": 4.0, **changes}
        (run / "run_manifest.json").write_text(json.dumps(manifest, indent=2))
        (run / "pairs.txt").write_text("\n".join(pairs) + "\n\n")
        if zipped:
            (run / "backtest" / "r.zip").write_bytes(b"x")

    store("b-exact", ["BTC", "ETH"])
    store("c-exact", ["BTC", "ETH"])
    store("a-order", ["ETH", "BTC"])
    store("a-detail", ["BTC", "ETH"], timeframe_detail="5m")
    store("a-empty", ["BTC", "ETH"], zipped=False)
    (tmp_path / "runs" / "a-bad").mkdir()
    (tmp_path / "runs" / "a-bad" / "run_manifest.json").write_text("{broken")
    root = str(tmp_path / "runs")
    manifests = reports.read_manifests(spark, root)
    assert manifests.count() == 5
    zips = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    archives = zips.select(reports.folder_of(reports.folder_of(F.col("path"))).alias("run_dir"))
    dirs = lambda df: df.withColumn("run_dir", F.regexp_extract("run_dir", "[^/]+$", 0))
    asked = requests_table(spark, [
        (RunRequest("Example", "f" * 64, "1m", "2025-09-20", "2026-09-20"), ["BTC", "ETH"]),
        (RunRequest("Example", "e" * 64, "1m", "2025-09-20", "2026-09-20"), ["BTC", "ETH"]),
        (RunRequest("Example", "f" * 64, "1m", "2025-09-20", "2026-09-20", timeframe_detail="5m"), ["BTC", "ETH"]),
    ])
    found = reusable_runs(asked, dirs(manifests), dirs(reports.read_pair_lists(spark, root)), dirs(archives))
    assert {r.request: r.run_dir for r in found.collect()} == {0: "b-exact", 2: "a-detail"}
    with pytest.raises(ValueError, match="max_pairs"):
        RunRequest("E", "f", "1m", START, END, max_pairs=0)


@pytest.mark.parametrize("name", ["j5_s6_reusable_runs", "s9_j5_pair_lists"])
def test_run_folders_are_written_by_many_tasks(spark, tmp_path, monkeypatch, name):
    """The users' rows are small, but each is a file or three: not the work of one task."""
    rows = [(i, datetime(2024, 1, 1), i % 400, "click", 1.0, None) for i in range(800)]
    kinds = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "events.parquet"))
    tasks = []

    def counted(files, folder):
        parts = files.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
        tasks.append((len(parts), max(r["count"] for r in parts) / sum(r["count"] for r in parts)))
        return write_each(files, folder)

    monkeypatch.setattr(queries, "write_each", counted)
    found = {r.request: r.run for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    runs = [i for i in range(400) if i % 2 == 0 and i % 5]
    assert found == {n: min(f"run-{i}" for i in runs if i % 3 == n) for n in range(3)}
    ((number, largest),) = tasks
    assert number >= 8 and largest < 0.25


def test_fresh_folder(spark, tmp_path):
    sinks.prepare_fresh_dir(spark, str(tmp_path / "new"))
    sinks.prepare_fresh_dir(spark, str(tmp_path / "new"))
    (tmp_path / "new" / "old.csv").write_text("x")
    with pytest.raises(FileExistsError, match="in use"):
        sinks.prepare_fresh_dir(spark, str(tmp_path / "new"))
    with pytest.raises(FileExistsError, match="in use"):
        sinks.prepare_fresh_dir(spark, str(tmp_path / "new" / "old.csv"))


def test_drawdown_of_undated_trades_is_spread_and_joined(spark):
    """100 000 trades without close date; the level over all pairs joins the pairs' summaries."""
    import numpy as np

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"strategy": "s", "timeframe": "1m", "pair": rng.choice(["hot"] * 8 + ["B", "A"], 100_000), "profit_ratio": rng.normal(0, 0.002, 100_000), "trade_no": range(100_000)})
    pdf.loc[pdf.index % 5000 == 7, "pair"] = None
    trades = tm.adjusted_trades(spark.createDataFrame(pdf.astype({"pair": object}).where(pdf.notna(), None), "strategy string, timeframe string, pair string, profit_ratio double, trade_no long"), 0.0)
    summaries = tm.drawdown_summaries(trades, ["strategy", "pair"])
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # else Spark joins ranges as small as these
    spark.conf.set(coalesce, "false")
    try:
        assert summaries.filter("pair = 'hot'").count() >= 4  # of eight shuffle partitions
    finally:
        spark.conf.unset(coalesce)
    fine, coarse = tm.max_drawdown(trades, ["strategy", "pair"], ["strategy"])

    def deepest(r):
        equity = np.cumprod(1 + r)
        return (equity / np.maximum.accumulate(equity) - 1).min()

    want = {p: deepest(g.profit_ratio.to_numpy()) for p, g in pdf.assign(pair=pdf.pair.fillna("none")).groupby("pair")}
    assert {r.pair or "none": pytest.approx(r.max_drawdown_compounded, abs=1e-9) for r in fine.collect()} == want
    order = pdf.assign(pair=pdf.pair.fillna("\U0010ffff")).sort_values(["pair", "trade_no"], kind="stable")
    assert coarse.first().max_drawdown_compounded == pytest.approx(deepest(order.profit_ratio.to_numpy()), abs=1e-9)


def test_summaries_of_ruined_runs_join(spark):
    rows = [("s", "1m", p, r, i) for p, rs in {"A": [0.5, -0.2], "B": [-1.0, 0.5], "C": [0.1, -1.5, 0.2], "D": [-1.0]}.items() for i, r in enumerate(rs)]
    trades = tm.adjusted_trades(spark.createDataFrame(rows, "strategy string, timeframe string, pair string, profit_ratio double, trade_no long"), 0.0)
    fine, coarse = tm.max_drawdown(trades, ["strategy", "pair"], ["strategy"])
    found = {r.pair: r.max_drawdown_compounded for r in fine.collect()}
    assert found["A"] == pytest.approx(-0.2) and found["B"] is None and found["D"] is None
    assert found["C"] == pytest.approx(-1.6)
    assert coarse.first().max_drawdown_compounded == pytest.approx(-1.0)


def test_metrics_of_levels_add_up(spark):
    """Every level against the plain statistics of its own trades."""
    import numpy as np

    rng = np.random.default_rng(8)
    n = 3000
    pdf = pd.DataFrame({"strategy": rng.choice(["a", "b"], n), "timeframe": "1h", "pair": rng.choice(["X", "Y", "Z"], n), "profit_ratio": rng.choice([0.01, -0.01, 0.0, 0.003], n) + (rng.random(n) < 0.3) * rng.normal(0, 0.01, n),
                        "is_short": rng.random(n) < 0.4, "funding_fees": rng.normal(0, 1, n), "trade_no": range(n)})
    trades = spark.createDataFrame(pdf)
    lattice = tm.TradeLattice(trades, 0.0)
    for keys, found in ((["strategy", "pair"], lattice.pairs()), (["strategy"], lattice.overall())):
        rows = {tuple(r[k] for k in keys): r for r in found.collect()}
        for key, g in pdf.groupby(keys):
            r, own = g.profit_ratio, rows[key]
            assert (own.trades, own.wins, own.draws, own.losses) == (len(g), (r > 0).sum(), (r == 0).sum(), (r < 0).sum())
            assert own.median_return == pytest.approx(r.median(), abs=1e-15) and own.expectancy == pytest.approx(r.mean())
            assert own.profit_factor == pytest.approx(r[r > 0].sum() / -r[r < 0].sum()) and own.short_trades == g.is_short.sum()
            assert own.funding_fees_sum == pytest.approx(g.funding_fees.sum())
    directions = {(r.strategy, r.pair, r.direction): r for r in lattice.directions().collect()}
    assert len(directions) == 2 * 4 * 2
    every = pdf[(pdf.strategy == "a") & pdf.is_short].sort_values(["pair", "trade_no"])
    equity = np.cumprod(1 + every.profit_ratio.to_numpy())
    own = directions["a", "__ALL__", "short"]
    assert own.trades == len(every) and own.median_return == pytest.approx(every.profit_ratio.median(), abs=1e-15)
    assert own.max_drawdown_compounded == pytest.approx((equity / np.maximum.accumulate(equity) - 1).min())


@pytest.mark.parametrize("size", [1, 3, 7, 1 << 16])
def test_json_is_read_piece_by_piece(size):
    import io

    stream = reports.JsonStream(io.BytesIO(' [1, 22.5, {"a": "x,]"}, [], null , "é"] '.encode()), size)
    assert list(stream.elements()) == [1, 22.5, {"a": "x,]"}, [], None, "é"]
    stream.finish()
    for wrong in ("[1,2,]", "[1,2", "[1 2]", "[,1]"):
        with pytest.raises(ValueError):
            list(reports.JsonStream(io.BytesIO(wrong.encode()), size).elements())


def test_sections_of_reports_read_as_a_whole_document_would_be(tmp_path):
    texts = [
        '{"x": [{"y": {}}], "strategy": {"A": {"q": 1, "trades": [1, 2, {"z": [3]}]}, "B": {}, "C": 5, "D": {"trades": {}}, "A": {"trades": [7]}}, "e": 0}',
        '{"strategy": {"A": {"trades": [1]}}, "strategy": {"B": {"trades": [2, 3], "trades": [4]}}}',
        '{"strategy": {"A": {"trades": [1]}}, "strategy": 5}',
        '{"strategy": {"A": {"trades": [1,]}}}',
        '{"strategy": {"A": {"trades": [1]}}} x',
        "[]", "5", "", "{",
    ]
    path = archive(tmp_path / "w.zip", **{f"m{i}": text for i, text in enumerate(texts)})
    expected = []
    for i, text in enumerate(texts):
        try:
            document = json.loads(text)
        except ValueError:
            continue
        named = document.get("strategy") if isinstance(document, dict) else None
        for name, body in named.items() if isinstance(named, dict) else ():
            trades = body.get("trades", []) if isinstance(body, dict) else None
            expected.append((f"m{i}.json", name, trades if isinstance(trades, list) else None))
    found = reports.report_sections((tmp_path / "w.zip").read_bytes())
    assert [(s.member, s.strategy, None if s.trades is None else list(s.trades)) for s in found] == expected
    assert [len(s.trades) for s in found if s.trades is not None] == [len(e[2]) for e in expected if e[2] is not None]


def test_pair_lists_keep_digits_and_lose_blanks(spark, tmp_path):
    (tmp_path / "pairs.txt").write_text("0XBTC\r\n\r\n\t1000PEPE \n2Z2\n")
    assert reports.read_pair_lists(spark, str(tmp_path)).first().pairs == ["0XBTC", "1000PEPE", "2Z2"]


def test_a_run_that_fails_half_way_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "run"
    with pytest.raises(RuntimeError), sinks.one_step(spark, str(folder)) as work:
        sinks.write_text(spark, "half", f"{work}/half.txt")
        raise RuntimeError
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["run"] and not list(folder.iterdir())
    with sinks.one_step(spark, str(folder)) as work:
        sinks.write_text(spark, "whole", f"{work}/whole.txt")
        assert not list(folder.iterdir())
    assert {p.name for p in folder.iterdir() if not p.name.startswith(".")} == {"whole.txt", "SHA256SUMS.txt"}
    assert (folder / "SHA256SUMS.txt").read_text() == hashlib.sha256(b"whole").hexdigest() + "  whole.txt\n"
    with pytest.raises(FileExistsError), sinks.one_step(spark, str(folder)):
        pass
    with pytest.raises(FileExistsError), sinks.one_step(spark, str(tmp_path / "other")) as work:
        (tmp_path / "other" / "taken").write_text("x")  # by another run meanwhile
    assert [p.name for p in (tmp_path / "other").iterdir()] == ["taken"]


def test_places_in_an_order(spark):
    from tidebars.functions.ranking import ranked

    rows = spark.range(5_000).selectExpr("id", "if(id % 7 = 0, null, id * 31 % 97) as v")
    got = ranked(rows, F.desc_nulls_last("v"), F.asc("id"))
    assert got.columns == ["id", "v", "rank"]
    expected = sorted(((r.id, r.v) for r in rows.collect()), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert {r.id: r["rank"] for r in got.collect()} == {id: i for i, (id, _) in enumerate(expected, 1)}
    assert ranked(rows.limit(0), F.asc("id")).collect() == []
