"""Train-screened discovery, frozen candidates and their holdout, and comparison across experiments."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.config import ExperimentSpec, StudyConfig
from tidebars.functions.ranking import benjamini_hochberg

KEYS = ("pair", "direction", "horizon_bars", "holding_minutes")
METRICS = (
    "events",
    "non_overlapping_events",
    "mean_net_return",
    "test_mean_net_return",
    "win_rate",
    "p_value",
    "profit_factor",
    "mean_mfe",
    "mean_mae",
    "test_std_net_return",
)
IDENTITY = ("experiment_id", "system_id", "system_version", "timeframe")
COMPARISON_KEYS = (*IDENTITY, *KEYS)
# Schema of the columns a discovery table must bring to a comparison.
REQUIRED = {
    **dict.fromkeys((*IDENTITY, "pair", "direction"), "string"),
    **dict.fromkeys(("horizon_bars", "holding_minutes"), "int"),
    **dict.fromkeys(
        (
            "events_train",
            "events_validation",
            "non_overlapping_events_train",
            "non_overlapping_events_validation",
        ),
        "bigint",
    ),
    **dict.fromkeys(
        (
            "mean_net_return_train",
            "mean_net_return_validation",
            "test_mean_net_return_train",
            "test_mean_net_return_validation",
            "p_value_validation",
        ),
        "double",
    ),
    **dict.fromkeys(("minimum_train_events", "minimum_validation_events"), "int"),
}
DISCOVERY_SCOPE = "train_screened_validation_pair_direction_horizon"
GLOBAL_SCOPE = "all_experiments_train_screened_validation_family"


def candidate_order() -> list[Column]:
    """Best candidates first."""
    return [F.desc_nulls_last("discovery_score"), F.asc_nulls_last("validation_q_value"), *map(F.asc, KEYS)]


def holdout_order() -> list[Column]:
    """Candidates that hold first, then by their return."""
    return [F.desc("holdout_pass"), F.desc_nulls_last("mean_net_return_holdout"), *map(F.asc, KEYS)]


def combined_order() -> list[Column]:
    """By system, then hypothesis."""
    return [F.asc(c) for c in ("system_id", "system_version", "timeframe", "pair", "direction", "horizon_bars")]


def met(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def by_period(summary: DataFrame, periods: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per hypothesis with ``<metric>_<period>`` columns, missing where a period is.

    A summary has one row per hypothesis and period, so this is one aggregation
    with map-side combining; the period values are fixed, hence so is the schema.
    """
    picks = [
        F.max(F.when(F.col("period") == period, F.col(metric))).alias(f"{metric}_{period}")
        for metric in METRICS
        for period in periods
    ]
    return summary.filter(F.col("period").isin(*periods)).groupBy(*keys).agg(*picks)


def _count(df: DataFrame, member: str, name: str) -> DataFrame:
    """Number of members as a one-row table, which is safe to broadcast onto every row."""
    return F.broadcast(df.agg(F.coalesce(F.sum(F.col(member).cast("long")), F.lit(0)).alias(name)))


def discovery_table(summary: DataFrame, config: StudyConfig) -> DataFrame:
    """Screen hypotheses on train, correct the survivors' validation p-values, and select.

    Holdout rows of ``summary`` are never looked at.
    """
    wide = by_period(summary, ("train", "validation"))
    eligible = met(
        (F.col("non_overlapping_events_train") >= config.minimum_train_events)
        & (F.col("test_mean_net_return_train") > 0)
    )
    train, validation = F.col("test_mean_net_return_train"), F.col("test_mean_net_return_validation")
    wide = wide.withColumn("train_eligible", eligible)
    tested = F.when(F.col("train_eligible"), F.coalesce("p_value_validation", F.lit(1.0)))
    ranked = benjamini_hochberg(wide.withColumn("_tested", tested), "_tested", "validation_q_value").drop("_tested")
    passed = met(
        F.col("train_eligible")
        & (F.col("non_overlapping_events_validation") >= config.minimum_validation_events)
        & (validation > 0)
        & (F.col("validation_q_value") <= config.validation_fdr)
    )
    size = _count(wide, "train_eligible", "fdr_family_size")
    return ranked.crossJoin(size).withColumns(
        {
            "fdr_scope": F.lit(DISCOVERY_SCOPE),
            "minimum_train_events": F.lit(config.minimum_train_events),
            "minimum_validation_events": F.lit(config.minimum_validation_events),
            "experiment_validation_fdr": F.lit(config.validation_fdr),
            "discovery_pass": passed,
            # missing if either side is; `least` alone would skip the missing one
            "discovery_score": F.when(train.isNotNull() & validation.isNotNull(), F.least(train, validation)),
        }
    )


def candidates(discovery: DataFrame) -> DataFrame:
    """The frozen selection, best first."""
    return discovery.filter("discovery_pass").orderBy(*candidate_order())


def holdout_report(selected: DataFrame, summary: DataFrame, config: StudyConfig) -> DataFrame:
    """Holdout metrics of the candidates only; the rest of the holdout stays unread.

    A candidate without holdout events keeps its row with missing metrics.
    """
    frozen = selected.select(*KEYS)
    revealed = summary.filter(F.col("period") == "holdout").join(frozen, list(KEYS), "left_semi")
    passed = met(
        (F.col("non_overlapping_events_holdout") >= config.minimum_holdout_events)
        & (F.col("test_mean_net_return_holdout") > 0)
    )
    return (
        selected.join(by_period(revealed, ("holdout",)), list(KEYS), "left")
        .withColumn("holdout_pass", passed)
        .orderBy(*holdout_order())
    )


def candidate_tables(summary: DataFrame, config: StudyConfig) -> tuple[DataFrame, DataFrame]:
    selected = candidates(discovery_table(summary, config))
    return selected, holdout_report(selected, summary, config)


def tag_result(df: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Put the experiment's identity in front of the result columns."""
    identity = {
        "experiment_id": spec.experiment_id,
        "system_id": spec.system_id,
        "system_version": spec.system_version,
        "timeframe": spec.timeframe,
    }
    rest = [c for c in df.columns if c not in identity]
    return df.select(*[F.lit(v).alias(k) for k, v in identity.items()], *rest)


# -- comparison across experiments ----------------------------------------------------


def check_discovery_columns(df: DataFrame) -> None:
    """Refuse tables that lack required columns or reveal any holdout."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError("Discovery table is missing required columns: " + ", ".join(missing))
    leaked = sorted(c for c in df.columns if "holdout" in c.lower())
    if leaked:
        raise ValueError("Discovery comparison refuses holdout columns: " + ", ".join(leaked))


def duplicate_hypotheses(df: DataFrame) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*COMPARISON_KEYS).count().filter("count > 1")


def check_unique(df: DataFrame) -> None:
    if not duplicate_hypotheses(df).isEmpty():
        raise ValueError(
            "Combined discovery inputs contain duplicate experiment/pair/direction/horizon rows"
        )


def combine_discovery(spark: SparkSession, tables: Iterable[DataFrame]) -> DataFrame:
    """Union of discovery tables by column name; no input gives an empty typed table."""
    checked = list(tables)
    for table in checked:
        check_discovery_columns(table)
    if not checked:
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in REQUIRED.items()))
    combined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), checked)
    check_unique(combined)
    return combined.orderBy(*combined_order())


def global_fdr(combined: DataFrame, *, global_fdr: float = 0.10) -> DataFrame:
    """Correct all train-screened hypotheses of all experiments as one family.

    Every row is held to its own experiment's thresholds.
    """
    check_discovery_columns(combined)
    if not 0 < global_fdr <= 1:
        raise ValueError("global_fdr must be in (0, 1]")
    eligible = met(
        (F.col("non_overlapping_events_train") >= F.col("minimum_train_events"))
        & (F.col("test_mean_net_return_train") > 0)
    )
    screened = combined.withColumn("_eligible", eligible)
    tested = F.when(F.col("_eligible"), F.coalesce("p_value_validation", F.lit(1.0)))
    ranked = benjamini_hochberg(screened.withColumn("_tested", tested), "_tested", "global_validation_q_value")
    passed = met(
        F.col("_eligible")
        & (F.col("non_overlapping_events_validation") >= F.col("minimum_validation_events"))
        & (F.col("test_mean_net_return_validation") > 0)
        & (F.col("global_validation_q_value") <= global_fdr)
    )
    return (
        ranked.crossJoin(_count(screened, "_eligible", "global_fdr_family_size"))
        .withColumns(
            {
                "global_fdr_threshold": F.lit(float(global_fdr)),
                "global_fdr_scope": F.lit(GLOBAL_SCOPE),
                "global_discovery_pass": passed,
            }
        )
        .drop("_eligible", "_tested")
    )


def system_coverage(corrected: DataFrame) -> DataFrame:
    """What every experiment contributed to the global candidates."""
    check_discovery_columns(corrected)
    if "global_discovery_pass" not in corrected.columns:
        raise ValueError("Global FDR must be applied before building system coverage")
    chosen = F.col("global_discovery_pass")
    listed = lambda c: F.array_join(  # noqa: E731 - distinct directions and horizons are few
        F.transform(F.array_sort(F.collect_set(F.when(chosen, F.col(c)))), lambda v: v.cast("string")), ","
    )
    # distinct pairs may be many: counted by a second aggregation, not by a set
    pairs = (
        corrected.filter(chosen)
        .select(*IDENTITY, "pair")
        .distinct()
        .groupBy(*IDENTITY)
        .agg(F.count(F.lit(1)).alias("_pairs"))
    )
    return (
        corrected.groupBy(*IDENTITY)
        .agg(
            F.count(F.lit(1)).alias("hypotheses_tested"),
            F.sum(chosen.cast("long")).alias("global_candidate_rows"),
            listed("direction").alias("directions"),
            listed("horizon_bars").alias("horizon_bars"),
        )
        .join(pairs, list(IDENTITY), "left")
        .select(
            *IDENTITY,
            "hypotheses_tested",
            "global_candidate_rows",
            F.coalesce("_pairs", F.lit(0)).alias("unique_candidate_pairs"),
            "directions",
            "horizon_bars",
        )
        .orderBy(*IDENTITY)
    )
