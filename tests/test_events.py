import math

import numpy as np
import pandas as pd
import pytest
from bars import frame, to_spark
from pyspark.sql import functions as F

from tidebars.config import StudyConfig, split_boundaries
from tidebars.functions.ranking import benjamini_hochberg, counted_values, exact_median, middle_buckets, value_bucket
from tidebars.functions.student_t import upper_tail
from tidebars.operators import discovery as disc
from tidebars.operators import events as ev
from tidebars.operators.series import Panel, bar_blocks
from tidebars.session import stage

FAR = "2027-01-01", "2027-02-01"


def marked(spark, pdf, long=(), short=()):
    pdf = pdf.assign(long_signal=pdf.index.isin(long), short_signal=pdf.index.isin(short))
    from bars import SCHEMA

    return spark.createDataFrame(pdf, SCHEMA + ", long_signal boolean, short_signal boolean")


def test_golden_long_and_short(spark):
    config = StudyConfig(horizons_bars=(2,))
    up = frame([100, 101, 105, 112, 113, 113], [98, 98, 97, 104, 109, 109], [99, 100, 103, 110, 112, 112],
               open_=[99, 99, 100, 108, 111, 111], minutes=15)
    down = frame([102, 103, 104, 102, 91, 91], [100, 99, 90, 85, 87, 87], [101, 100, 95, 90, 88, 88],
                 open_=[101, 101, 100, 94, 89, 89], minutes=15)
    for signals, direction, mfe, mae in (
        (marked(spark, up, long=[1]), "long", 0.12, -0.03),
        (marked(spark, down, short=[1]), "short", 0.15, -0.04),
    ):
        row = ev.summarise_events(ev.marked_events(signals, config, *FAR)).first()
        assert (row.direction, row.period, row.events, row.holding_minutes) == (direction, "train", 1, 30)
        assert row.mean_net_return == pytest.approx(0.0986)
        assert (row.mean_mfe, row.mean_mae) == (pytest.approx(mfe), pytest.approx(mae))
        assert row.profit_factor == math.inf and row.p_value == 1.0 and row.t_stat is None


def test_forward_windows(spark):
    pdf = frame([10, 12, 11, 15, 14], [1] * 5, [2] * 5)
    pdf["date"] = pd.Timestamp("2026-01-01", tz="UTC") + pd.to_timedelta([0, 1, 2, 4, 5], unit="min")
    rows = ev.forward_columns(bar_blocks(to_spark(spark, pdf), ahead=2), Panel(), [1, 2]).orderBy("date").collect()
    assert [r.max_high_2 for r in rows] == [12, 15, 15, None, None]
    assert [r.contiguous_1 for r in rows] == [True, True, False, True, False]
    assert [r.contiguous_2 for r in rows] == [True, False, False, False, False]


@pytest.mark.parametrize("horizons", [(1, 3, 5, 10, 20, 60), (40,), (2, 200), (13, 14)])
def test_extremes_over_many_horizons(spark, horizons):
    rng = np.random.default_rng(5)
    pdf = frame(rng.random(400) + 2, rng.random(400), rng.random(400) + 1)
    rows = ev.forward_columns(
        bar_blocks(to_spark(spark, pdf), rows=128, ahead=max(horizons)), Panel(), horizons
    ).filter("core").orderBy("date").toPandas()
    for h in horizons:
        expected = pdf["high"].shift(-1).rolling(h, min_periods=h).max().shift(-(h - 1))
        np.testing.assert_allclose(rows[f"max_high_{h}"], expected)
        expected = pdf["low"].shift(-1).rolling(h, min_periods=h).min().shift(-(h - 1))
        np.testing.assert_allclose(rows[f"min_low_{h}"], expected)


def test_events_stay_inside_their_period(spark):
    n = 60
    pdf = frame([2.0] * n, [1.0] * n, [1.5] * n)
    train_end, validation_end = split_boundaries("2026-01-01 00:00", "2026-01-01 01:00")
    assert (train_end.minute, validation_end.minute) == (36, 48)
    signals = marked(spark, pdf, long=range(n))
    events = ev.marked_events(signals, StudyConfig(horizons_bars=(5,)), train_end, validation_end).toPandas()
    last = events.groupby("period").signal_date.max().dt.minute.to_dict()
    first = events.groupby("period").signal_date.min().dt.minute.to_dict()
    assert last == {"train": 30, "validation": 42, "holdout": 54}
    assert first == {"train": 0, "validation": 36, "holdout": 48}


def test_custom_signal(spark):
    i = np.arange(600)
    close = 100 + 0.02 * i + 2.5 * np.sin(i / 8)
    signals = marked(spark, frame(close + 0.1, close - 0.1, close, open_=close - 0.01), long=[100, 200, 300, 400, 500])
    config = StudyConfig(horizons_bars=(1,), round_trip_cost_bps=0)
    rows = ev.summarise_events(ev.marked_events(signals, config, "2026-01-01 06:00", "2026-01-01 08:00")).collect()
    assert {r.direction for r in rows} == {"long"} and sum(r.events for r in rows) == 5


def test_overlapping_custom_signals_are_refused(spark):
    signals = marked(spark, frame([2.0] * 9, [1.0] * 9, [1.5] * 9), long=[3], short=[3])
    with pytest.raises(Exception, match="cannot overlap"):
        ev.marked_events(signals, StudyConfig(horizons_bars=(1,)), *FAR).collect()


def events_table(spark, moments, returns, holding, *, timeframe="1m"):
    pdf = pd.DataFrame(
        {"pair": "X", "timeframe": timeframe, "direction": "long", "period": "train", "horizon_bars": holding,
         "holding_minutes": holding,
         "signal_date": pd.Timestamp("2026-01-01", tz="UTC") + pd.to_timedelta(moments, unit="min"),
         "net_return": returns, "mfe": 0.0, "mae": 0.0}
    )
    return spark.createDataFrame(pdf, (
        "pair string, timeframe string, direction string, period string, horizon_bars int, holding_minutes int, "
        "signal_date timestamp, net_return double, mfe double, mae double"))


def test_independent_sample(spark):
    events = events_table(spark, [0, 2, 5, 7, 10], [0.01, 0.02, 0.03, 0.04, 0.05], 5)
    taken = ev.independent_events(events).filter("independent").orderBy("signal_date").collect()
    assert [r.net_return for r in taken] == [0.01, 0.03, 0.05]


@pytest.mark.parametrize("holding, chunk", [(7, 600), (30, 1800), (30, 3600), (45, 900)])
def test_independent_sample_of_one_dense_group(spark, holding, chunk):
    """A single group that fires almost always, walked in chunks, some shorter than the holding period."""
    rng = np.random.default_rng(holding)
    moments = np.flatnonzero(rng.random(3000) < 0.6)
    taken, free = [], -1
    for m in moments.tolist():
        if m >= free:
            taken.append(m)
            free = m + holding
    events = events_table(spark, moments, 0.0, holding)
    rows = ev.independent_events(events, chunk_seconds=chunk).filter("independent").select(
        ((F.unix_seconds("signal_date") - F.unix_seconds(F.lit(pd.Timestamp("2026-01-01", tz="UTC")))) / 60).alias("m")
    ).collect()
    assert sorted(int(r.m) for r in rows) == taken


def test_student_t():
    assert upper_tail(np.array([0.0]), np.array([5.0]))[0] == 0.5
    t, nu = np.meshgrid([-3.0, -0.5, 1e-6, 0.7, 2.0, 12.0], [1.0, 2.0])
    cauchy = 0.5 - np.arctan(t[0]) / np.pi
    two = 0.5 - t[1] / (2 * np.sqrt(2 + t[1] ** 2))
    np.testing.assert_allclose(upper_tail(t, nu), [cauchy, two], rtol=1e-9)
    # close to the normal tail for many degrees of freedom
    assert upper_tail(np.array([1.96]), np.array([1e6]))[0] == pytest.approx(0.0249979, rel=1e-4)


def test_exact_median(spark):
    rng = np.random.default_rng(1)
    values = np.r_[rng.normal(0, 1, 4001), np.zeros(500), rng.normal(0, 1e-12, 300), [1e300, -1e300]]
    pdf = pd.DataFrame({"k": "hot", "v": values})
    small = pd.DataFrame({"k": ["a", "a", "b", "c", "c", "c"], "v": [1.0, 2.0, -3.0, 5.0, 5.0, 7.0]})
    df = spark.createDataFrame(pd.concat([pdf, small]), "k string, v double")
    result = {r.k: r.m for r in exact_median(df, ["k"], "v", "m").collect()}
    assert result == {"hot": pytest.approx(float(np.median(values)), abs=1e-300), "a": 1.5, "b": -3.0, "c": 5.0}


@pytest.mark.parametrize("small", [0, 1000])
def test_median_counts_before_it_shuffles(spark, small):
    """90 % equal values: whether the wanted buckets are broadcast or not, they reach a task as one row a task."""
    rng = np.random.default_rng(2)
    values = np.where(rng.random(20_000) < 0.9, 1.25, rng.normal(1.25, 0.5, 20_000))
    df = spark.createDataFrame(pd.DataFrame({"k": rng.choice(["hot", "hot", "b"], 20_000), "v": values})).repartition(8)
    rows = df.withColumn("_bucket", value_bucket(F.col("v")))
    middle = middle_buckets(rows.groupBy("k", "_bucket").agg(F.count(F.lit(1)).alias("_n")), ["k"])
    counted = counted_values(rows, ["k"], "v", stage(middle.select("k", "_bucket")), small)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert (plan.index("HashAggregate") < plan.index("Join")) == bool(small)  # from the top: values are counted before they are joined, or cut down where they are read
    assert counted.filter("v = 1.25").count() == 2 and counted.agg(F.sum("_n")).first()[0] >= 17_000
    expected = df.toPandas().groupby("k").v.median().to_dict()
    assert {r.k: r.m for r in exact_median(df, ["k"], "v", "m", small).collect()} == expected


def test_rows_without_p_value_are_not_joined(spark):
    """90 % of the rows have no p-value: none of them may pass the join's exchange."""
    df = spark.range(2_000).selectExpr("id", "IF(id % 10 = 0, (id + 1) / 4000D, NULL) AS p")
    adjusted = benjamini_hochberg(df, "p", "q")
    rows = {r.id: (r.p, r.q) for r in adjusted.collect()}
    assert len(rows) == 2_000 and all((p is None) == (q is None) for p, q in rows.values())
    known = sorted(p for p, _ in rows.values() if p is not None)
    raw = [p * len(known) / (i + 1) for i, p in enumerate(known)]
    want = {p: min(1.0, *raw[i:]) for i, p in enumerate(known)}
    assert all(abs(want[p] - q) < 1e-12 for p, q in rows.values() if p is not None)
    plan = adjusted._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull" in plan[plan.index("Join LeftOuter") :]


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,), (None,), (1.0,), (0.0,)], "p double")
    q = {r.p: r.q for r in benjamini_hochberg(df, "p", "q").collect()}
    assert q == {0.0: 0.0, 0.01: pytest.approx(0.03), 0.03: pytest.approx(0.06), 0.04: pytest.approx(0.06),
                 0.5: pytest.approx(0.6), 1.0: 1.0, None: None}


def summary_rows(spark, rows):
    """rows: (pair, period, events, independent events, mean, independent mean, p)."""
    full = [(pair, "long", period, 5, 5, n, k, mean, test, 0.5, p, 1.2, 0.01, -0.01, 0.02)
            for pair, period, n, k, mean, test, p in rows]
    return spark.createDataFrame(full, (
        "pair string, direction string, period string, horizon_bars int, holding_minutes int, events bigint, "
        "non_overlapping_events bigint, mean_net_return double, test_mean_net_return double, win_rate double, "
        "p_value double, profit_factor double, mean_mfe double, mean_mae double, test_std_net_return double"))


def test_holdout_is_revealed_for_candidates_only(spark):
    summary = summary_rows(spark, [
        ("A", "train", 200, 200, 0.01, 0.01, 0.2), ("A", "validation", 50, 50, 0.005, 0.005, 0.001),
        ("A", "holdout", 40, 40, -0.02, -0.02, 0.1),
        ("B", "train", 200, 200, -0.01, -0.01, 0.2), ("B", "validation", 50, 50, 0.005, 0.005, 0.001),
        ("B", "holdout", 40, 40, 0.9, 0.9, 0.1)])
    selected, holdout = disc.candidate_tables(summary, StudyConfig())
    assert [r.pair for r in selected.collect()] == ["A"]
    assert not [c for c in selected.columns if "holdout" in c]
    assert [(r.pair, r.holdout_pass, r.mean_net_return_holdout) for r in holdout.collect()] == [("A", False, -0.02)]


def test_no_candidates_keep_the_schema(spark):
    summary = summary_rows(spark, [("A", "train", 200, 200, -0.01, -0.01, 0.2), ("A", "validation", 50, 50, -1.0, -1.0, 0.5)])
    selected, holdout = disc.candidate_tables(summary, StudyConfig())
    assert selected.isEmpty() and holdout.isEmpty()
    assert {"holdout_pass", "mean_net_return_holdout"} <= set(holdout.columns)


@pytest.mark.parametrize("second_train, q, family", [(0.01, 0.08, 2), (-0.01, 0.04, 1)])
def test_family_is_screened_on_train(spark, second_train, q, family):
    summary = summary_rows(spark, [
        ("A", "train", 200, 120, 0.01, 0.01, 0.2), ("A", "validation", 50, 40, 0.005, 0.005, 0.04),
        ("B", "train", 200, 120, 0.01, second_train, 0.2), ("B", "validation", 50, 40, 0.005, 0.005, 0.20)])
    rows = {r.pair: r for r in disc.discovery_table(summary, StudyConfig(validation_fdr=0.05)).collect()}
    assert rows["A"].validation_q_value == pytest.approx(q) and rows["A"].fdr_family_size == family
    assert rows["A"].discovery_pass == (family == 1)
    if family == 1:
        assert rows["B"].validation_q_value is None and not rows["B"].discovery_pass


def test_thresholds_count_independent_events(spark):
    summary = summary_rows(spark, [("A", "train", 200, 80, 0.01, 0.01, 0.2), ("A", "validation", 50, 20, 0.005, 0.005, 0.001)])
    assert not disc.discovery_table(summary, StudyConfig()).first().discovery_pass


def discovery_rows(spark, rows):
    full = [("e1", system, "1", "1m", pair, "long", 5, 5, 200, 50, 120, 40, 0.01, 0.005, test, 0.005, p, 100, minimum)
            for system, pair, p, test, minimum in rows]
    return spark.createDataFrame(full, ", ".join(f"{c} {t}" for c, t in disc.REQUIRED.items()))


def test_comparison(spark):
    a, b = (discovery_rows(spark, [(s, "X", p, 0.01, 30)]) for s, p in (("one", 0.04), ("two", 0.20)))
    combined = disc.combine_discovery(spark, [a, b])
    rows = disc.global_fdr(combined, global_fdr=0.05).collect()
    assert [r.global_fdr_family_size for r in rows] == [2, 2]
    assert min(r.global_validation_q_value for r in rows) == pytest.approx(0.08)
    assert not any(r.global_discovery_pass for r in rows)
    own = disc.global_fdr(discovery_rows(spark, [("one", "X", 0.001, 0.01, 45)])).first()
    assert not own.global_discovery_pass
    screened = disc.global_fdr(discovery_rows(spark, [("one", "X", 0.04, 0.01, 30), ("one", "Y", 0.2, -0.01, 30)]))
    assert {r.pair: r.global_validation_q_value for r in screened.collect()} == {"X": pytest.approx(0.04), "Y": None}
    covered = disc.system_coverage(screened).first()
    assert (covered.hypotheses_tested, covered.global_candidate_rows, covered.unique_candidate_pairs,
            covered.directions, covered.horizon_bars) == (2, 1, 1, "long", "5")


def test_comparison_refusals(spark):
    table = discovery_rows(spark, [("one", "X", 0.04, 0.01, 30)])
    with pytest.raises(ValueError, match="duplicate"):
        disc.combine_discovery(spark, [table, table])
    with pytest.raises(ValueError, match="refuses holdout columns"):
        disc.combine_discovery(spark, [table.withColumn("x_Holdout", F.lit(1))])
    with pytest.raises(ValueError, match="missing required columns"):
        disc.combine_discovery(spark, [table.drop("pair")])
    with pytest.raises(ValueError, match="must be applied"):
        disc.system_coverage(table)
    empty = disc.combine_discovery(spark, [])
    assert empty.isEmpty() and empty.columns == list(disc.REQUIRED)
