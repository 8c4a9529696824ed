"""The studies from input folder to written results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars import sinks
from tidebars.config import ExperimentSpec, StudyConfig, as_utc, bar_minutes, split_boundaries
from tidebars.operators import catalog as quality
from tidebars.operators import identity
from tidebars.operators.discovery import (
    DISCOVERY_SCOPE,
    GLOBAL_SCOPE,
    REQUIRED,
    candidates,
    combine_discovery,
    discovery_table,
    global_fdr,
    holdout_report,
    system_coverage,
    tag_result,
)
from tidebars.operators.events import P_VALUE_METHOD, study_summary
from tidebars.operators.trades import (
    direction_metrics,
    exit_reason_metrics,
    overall_metrics,
    pair_metrics,
)
from tidebars.session import prepare, stage
from tidebars.sources import market_files
from tidebars.sources.reports import CATALOG_SCHEMA, read_json_document, read_table

DEFAULT_TIMEFRAMES = ("1m", "5m", "15m", "1h", "4h", "1d")


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def build_catalog(
    spark: SparkSession,
    data_dir: str,
    start,
    end,
    *,
    timeframes: Sequence[str] = DEFAULT_TIMEFRAMES,
    minimum_coverage: float = 0.80,
    minimum_candles: int = 1_000,
    include_source_sha256: bool = True,
) -> DataFrame:
    """Audit the market files of the wanted timeframes; files of others are not opened, and a
    file that cannot be read whole counts as one without bars."""
    prepare(spark)
    files = stage(market_files.discover(spark, data_dir).filter(F.col("timeframe").isin(*timeframes)))
    bars, _ = market_files.load_files(spark, files, start, end)
    if include_source_sha256:
        files = market_files.with_file_hash(spark, files)
    else:
        files = files.withColumn("source_sha256", F.lit(None).cast("string"))
    return quality.assess_files(
        files, bars, start, end, minimum_coverage=minimum_coverage, minimum_candles=minimum_candles
    )


def write_catalog(
    spark: SparkSession, data_dir: str, output_dir: str, start, end, *, replace: bool = False, **settings
) -> dict:
    """Build a catalog and write it with its summary."""
    catalog = stage(build_catalog(spark, data_dir, start, end, **settings))
    totals = quality.catalog_summary(catalog).first()
    if not totals.files:
        raise ValueError("No matching futures OHLCV files were found")
    summary = {
        "schema_version": 3,
        "created_at_utc": _now(),
        "start_inclusive": as_utc(start).isoformat(),
        "end_exclusive": as_utc(end).isoformat(),
        "timeframes": list(settings.get("timeframes", DEFAULT_TIMEFRAMES)),
        "minimum_coverage": settings.get("minimum_coverage", 0.80),
        "minimum_candles": settings.get("minimum_candles", 1_000),
        "source_sha256": settings.get("include_source_sha256", True),
        "files": totals.files,
        "unique_pairs": totals.unique_pairs,
        "research_ready_files": totals.research_ready_files,
        "status_counts": totals.status_counts,
    }
    sinks.write_catalog_bundle(catalog, summary, output_dir, replace=replace)
    return summary


def load_selection(spark: SparkSession, catalog_dir: str, timeframe: str, start, end) -> DataFrame:
    """Released pairs of a written catalog, after checking that it fits the study."""
    summary = read_json_document(spark, f"{catalog_dir}/{sinks.SUMMARY_NAME}")
    identity.check_catalog_range(summary, timeframe, start, end)
    catalog = read_table(spark, f"{catalog_dir}/{sinks.CATALOG_NAME}", CATALOG_SCHEMA)
    return identity.catalog_selection(catalog, timeframe)


def run_event_study(
    spark: SparkSession,
    data_dir: str,
    output_dir: str,
    start,
    end,
    *,
    system: str = "macd_crossover",
    system_version: str = "1",
    timeframe: str = "1m",
    config: StudyConfig = StudyConfig(),
    catalog_dir: str | None = None,
    max_files: int | None = None,
    **parameters,
) -> dict:
    """Event study of one system over all released pairs, written to a fresh folder."""
    prepare(spark)
    first, last = as_utc(start), as_utc(end)
    train_end, validation_end = split_boundaries(first, last)
    files = stage(market_files.listed_files(spark, data_dir, timeframe))
    before_gate = files.count()
    selection = None
    if catalog_dir is not None:
        selection = stage(load_selection(spark, catalog_dir, timeframe, first, last))
        quality.check_not_stale(selection, files)
        files = quality.gate(files, selection)
    if max_files is not None:
        files = files.orderBy("pair").limit(max_files)
    if catalog_dir is not None or max_files is not None:
        files = stage(files)
    pairs = files.count()
    if not pairs:
        raise ValueError(f"No research-ready {timeframe} futures files found in {data_dir}")

    if selection is not None:
        basis = identity.selection_basis(selection).first().basis
        chosen = selection.join(files.select("pair"), "pair", "left_semi")
        fingerprint = identity.digest_of(identity.universe_fingerprint(chosen))
    else:
        basis = identity.FILE_METADATA_BASIS
        fingerprint = identity.digest_of(identity.file_fingerprint(files))
    if system == "macd_crossover":
        parameters = {
            "fast_period": config.fast_period,
            "slow_period": config.slow_period,
            "signal_period": config.signal_period,
            **parameters,
        }
    spec = ExperimentSpec(
        system_id=system,
        system_version=system_version,
        timeframe=timeframe,
        parameters={**asdict(config), **parameters},
        cost_bps=config.round_trip_cost_bps,
        horizons_bars=config.horizons_bars,
        data_start=first.isoformat(),
        data_end=last.isoformat(),
        universe_fingerprint=fingerprint,
        universe_fingerprint_basis=basis + identity.TREE,
    )
    with sinks.one_step(spark, output_dir) as folder:
        # one damaged file must not stop the study of the others: it ends up in ``errors``
        bars, problems = market_files.load_files(spark, files, first, last)
        bars = stage(bars)
        coverage = stage(quality.pair_coverage(bars).join(files.select("pair", "file", "size_bytes"), ["pair", "file"]))
        errors = quality.unusable_files(files, coverage, problems)
        summary = stage(
            study_summary(bars.drop("file"), system, config, train_end, validation_end, **parameters)
        )
        discovery = stage(discovery_table(summary, config))
        selected = stage(candidates(discovery))
        holdout = stage(holdout_report(selected, summary, config))
        tables = {
            "summary_discovery": tag_result(summary.filter("period != 'holdout'"), spec),
            "discovery_tests": tag_result(discovery, spec),
            "candidates_train_validation": tag_result(selected, spec),
            "holdout_report": tag_result(holdout, spec),
            "dataset_coverage": coverage,
            "errors": errors,
        }
        for name, table in tables.items():
            sinks.write_csv(table, f"{folder}/{name}.csv")

        counts = discovery.agg(
            F.count(F.lit(1)).alias("tested"),
            F.coalesce(F.sum(F.col("train_eligible").cast("int")), F.lit(0)).alias("eligible"),
        ).first()
        revealed = holdout.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("holdout_pass").cast("int")), F.lit(0)).alias("passed")
        ).first()
        analysed, frozen = coverage.count(), selected.count()
        minutes = bar_minutes(timeframe)
        study = f"{system}_event_study"
        result = {
            "schema_version": 5,
            "study": study,
            "experiment_id": spec.experiment_id,
            "system_id": spec.system_id,
            "timeframe": timeframe,
            "data_start": spec.data_start,
            "data_end": spec.data_end,
            "universe_fingerprint": fingerprint,
            "universe_fingerprint_basis": basis + identity.TREE,
            "bar_minutes": minutes,
            "horizons_bars": list(config.horizons_bars),
            "holding_minutes": [minutes * h for h in config.horizons_bars],
            "hypotheses_tested": counts.tested,
            "train_eligible_hypotheses": counts.eligible,
            "pairs_analyzed": analysed,
            "pairs_failed": pairs - analysed,
            "candidate_rows": frozen,
            "holdout_rows": revealed.n,
            "holdout_passed": revealed.passed,
            "status": "candidates_found" if frozen else "no_candidates",
        }
        sinks.write_document(spark, result, f"{folder}/result_summary.json")
        manifest = {
            "schema_version": 3,
            "created_at_utc": _now(),
            "study": study,
            "experiment": spec.manifest(),
            "entry_rule": "A signal counts once its bar has closed; the trade opens with the bar after it",
            "start_inclusive": spec.data_start,
            "end_exclusive": spec.data_end,
            "train_end": train_end.isoformat(),
            "validation_end": validation_end.isoformat(),
            "timeframe": timeframe,
            "bar_minutes": minutes,
            "horizon_semantics": "bars",
            "fdr_scope": DISCOVERY_SCOPE,
            "significance_method": P_VALUE_METHOD,
            "event_count_threshold_basis": "non_overlapping_events",
            "catalog": catalog_dir,
            "pairs_before_catalog_gate": before_gate,
            "pairs_discovered": pairs,
            "pairs_analyzed": analysed,
            "pairs_failed": pairs - analysed,
            "config": asdict(config),
            "holdout_policy": "Holdout metrics are written for the frozen candidates only.",
        }
        sinks.write_document(spark, manifest, f"{folder}/run_manifest.json")
    return result


def run_comparison(
    spark: SparkSession, inputs: Sequence[str], output_dir: str, *, global_rate: float = 0.10
) -> dict:
    """Correct several experiments' discovery tables together and write what survives.

    Results get a folder of their own, with the checksums of its files beside them.
    """
    with sinks.one_step(spark, output_dir) as folder:
        tables = []
        for path in inputs:
            header = spark.read.csv(path, header=True).columns
            extra = {c: "string" for c in header if c not in REQUIRED}
            schema = ", ".join(f"`{c}` {REQUIRED.get(c, extra.get(c))}" for c in header)
            tables.append(read_table(spark, path, schema))
        corrected = stage(global_fdr(combine_discovery(spark, tables), global_fdr=global_rate))
        chosen = corrected.filter("global_discovery_pass")
        sinks.write_csv(corrected, f"{folder}/combined_discovery_tests.csv")
        sinks.write_csv(chosen, f"{folder}/global_candidates_train_validation.csv")
        sinks.write_csv(system_coverage(corrected), f"{folder}/system_coverage.csv")
        counts = comparison_counts(corrected).first()
        manifest = {
            "schema_version": 2,
            "created_at_utc": _now(),
            "stage": "cross_system_discovery_only",
            "holdout_policy": "Inputs that hold holdout columns are refused.",
            "fdr_scope": GLOBAL_SCOPE,
            "global_fdr": global_rate,
            "inputs": list(inputs),
            **counts.asDict(),
        }
        sinks.write_document(spark, manifest, f"{folder}/comparison_manifest.json")
    return manifest


def comparison_counts(corrected: DataFrame) -> DataFrame:
    """One row of totals of a comparison."""
    chosen = F.col("global_discovery_pass")
    totals = corrected.agg(
        F.count(F.lit(1)).alias("hypotheses_tested"),
        F.count(F.when(chosen, 1)).alias("global_candidate_rows"),
    )
    pairs = corrected.filter(chosen).select("pair").distinct().agg(F.count(F.lit(1)).alias("unique_candidate_pairs"))
    experiments = corrected.select("experiment_id").distinct().agg(F.count(F.lit(1)).alias("experiments"))
    return totals.crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(experiments))


def write_trade_summary(trades: DataFrame, output_dir: str, *, slippage_bps_round_trip: float = 4.0) -> None:
    """Pair, direction, exit-reason and overall metrics of exported trades."""
    cost = {"slippage_bps_round_trip": slippage_bps_round_trip}
    trades = stage(trades)
    sinks.write_csv(pair_metrics(trades, **cost), f"{output_dir}/pair_metrics.csv")
    sinks.write_csv(direction_metrics(trades, **cost), f"{output_dir}/direction_metrics.csv")
    sinks.write_csv(exit_reason_metrics(trades, **cost), f"{output_dir}/exit_reason_metrics.csv")
    overall_metrics(trades, **cost).write.mode("errorifexists").json(f"{output_dir}/overall_metrics.json")
