"""Reference SQL for the registered queries, written over uncut series.

Nothing here knows about blocks, halos or carried states: windows run over whole
series and recurrences row by row, so agreement checks the distributed forms.
"""

from __future__ import annotations

from checks.settings import HORIZONS, STUDY, TRAIN_END, VALIDATION_END

SERIES = "PARTITION BY pair ORDER BY date"


def day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def flag(condition: str) -> str:
    return f"CAST(COALESCE({condition}, FALSE) AS BIGINT)"


def bars(pair: str, timeframe: str, seconds: int) -> str:
    moment = f"make_timestamp(CAST(floor(epoch(ts) / {seconds}) * {seconds} AS BIGINT) * 1000000)"
    return f"""
SELECT *, row_number() OVER (PARTITION BY pair ORDER BY date) - 1 AS rn FROM (
  SELECT CAST({pair} AS VARCHAR) AS pair, '{timeframe}' AS timeframe, {moment} AS date,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY ALL)"""


HOURLY = f"b AS ({bars('event_type', '1h', 3600)})"
FOUR_HOURLY = f"b AS ({bars('event_type', '4h', 14400)})"
HALF_DAILY = f"b AS ({bars('user_id', '12h', 43200)})"


def window(agg: str, n: int, shift: int = 0, missing: int = 0) -> str:
    """Aggregate of the n rows ending shift rows back, once the series is long enough."""
    end = f"{shift} PRECEDING" if shift else "CURRENT ROW"
    frame = f"ROWS BETWEEN {n - 1 + shift} PRECEDING AND {end}"
    return f"CASE WHEN rn >= {n - 1 + shift + missing} THEN {agg} OVER ({SERIES} {frame}) END"


def lag(column: str, n: int = 1) -> str:
    return f"lag({column}, {n}) OVER ({SERIES})"


LOCATION = "CASE WHEN high > low THEN (close - low) / (high - low) END"


def signal_rows(source: str, long: str, short: str, long_tag: str, short_tag: str, both: bool = False) -> str:
    """Final projection shared by all signal queries; ``both`` drops bars that are long and short."""
    long, short = f"COALESCE({long}, FALSE)", f"COALESCE({short}, FALSE)"
    if both:
        long, short = f"({long} AND NOT {short})", f"({short} AND NOT {long})"
    return f"""
SELECT pair, {day('date')} AS date, CAST({long} AS BIGINT) AS long_signal,
       CAST({short} AS BIGINT) AS short_signal,
       CASE WHEN {long} THEN {long_tag} WHEN {short} THEN {short_tag} END AS tag
FROM {source}"""


def alpha(span: int) -> str:
    return f"(2.0 / ({span} + 1.0))"


def macd_cte(fast: int = 12, slow: int = 26, signal: int = 9) -> str:
    f, s, g = alpha(fast), alpha(slow), alpha(signal)
    line = f"((1 - {f}) * e.fast + {f} * b.close) - ((1 - {s}) * e.slow + {s} * b.close)"
    return f"""
e AS (
  SELECT pair, rn, close AS fast, close AS slow, CAST(NULL AS DOUBLE) AS macd, CAST(NULL AS DOUBLE) AS sig
  FROM b WHERE rn = 0
  UNION ALL
  SELECT b.pair, b.rn, (1 - {f}) * e.fast + {f} * b.close, (1 - {s}) * e.slow + {s} * b.close,
         CASE WHEN b.rn >= {slow - 1} THEN {line} END,
         CASE WHEN b.rn = {slow - 1} THEN {line}
              WHEN b.rn > {slow - 1} THEN (1 - {g}) * e.sig + {g} * ({line}) END
  FROM e JOIN b ON b.pair = e.pair AND b.rn = e.rn + 1),
m AS (SELECT b.*, e.macd, CASE WHEN b.rn >= {slow + signal - 2} THEN e.sig END AS sig
      FROM b JOIN e USING (pair, rn)),
x AS (SELECT *, macd > sig AND {lag('macd')} <= {lag('sig')} AS above,
             macd < sig AND {lag('macd')} >= {lag('sig')} AS below FROM m)"""


def g1() -> str:
    return f"WITH RECURSIVE {HOURLY}, {macd_cte()}" + signal_rows(
        "x", "(above AND volume > 0)", "(below AND volume > 0)", "'macd_cross_long'", "'macd_cross_short'"
    )


def g1x() -> str:
    return f"""WITH RECURSIVE {HOURLY}, {macd_cte()}
SELECT pair, {day('date')} AS date, {flag('below')} AS exit_long, {flag('above')} AS exit_short,
       CASE WHEN COALESCE(below OR above, FALSE) THEN 'opposite_cross' END AS exit_tag FROM x"""


def g2(source: str = HOURLY, n: int = 20) -> str:
    return f"""WITH {source}, x AS (
  SELECT *, {window('min(low)', n, 1)} AS floor_, {window('max(high)', n, 1)} AS roof, {LOCATION} AS loc FROM b)""" + signal_rows(
        "x",
        "(low <= floor_ * (1 - 5.0 / 10000) AND close > floor_ AND loc >= 0.6 AND volume > 0)",
        "(high >= roof * (1 + 5.0 / 10000) AND close < roof AND loc <= 1 - 0.6 AND volume > 0)",
        "'liquidity_sweep_reclaim_long'",
        "'liquidity_sweep_reclaim_short'",
    )


def g3() -> str:
    return f"""WITH {HOURLY}, x AS (
  SELECT *, {window('max(high)', 3, 2)} AS roof, {window('min(low)', 3, 2)} AS floor_,
         {lag('close')} AS before, {LOCATION} AS loc FROM b)""" + signal_rows(
        "x",
        """(before >= roof * (1 + 5.0 / 10000) AND low <= roof * (1 + 5000.0 / 10000)
            AND low >= roof * (1 - 5000.0 / 10000) AND close > roof AND loc >= 0.55 AND volume > 0)""",
        """(before <= floor_ * (1 - 5.0 / 10000) AND high >= floor_ * (1 - 5000.0 / 10000)
            AND high <= floor_ * (1 + 5000.0 / 10000) AND close < floor_ AND loc <= 1 - 0.55 AND volume > 0)""",
        "'breakout_retest_long'",
        "'breakout_retest_short'",
    )


def g4() -> str:
    return f"""WITH {HOURLY}, w AS (
  SELECT *, ({window('max(high)', 10)} - {window('min(low)', 10)}) / close AS width,
         (high - low) / {lag('close')} AS rng,
         {window('max(high)', 10, 1)} AS roof, {window('min(low)', 10, 1)} AS floor_, {LOCATION} AS loc FROM b),
x AS (SELECT *, {lag('width')} AS before, {window('median(width)', 50, 11, 9)} AS usual_width,
             {window('median(rng)', 10, 1, 1)} AS usual_range FROM w)""" + signal_rows(
        "x",
        """(before <= usual_width * 0.6 AND rng >= usual_range * 1.5
            AND close >= roof * (1 + 5.0 / 10000) AND loc >= 0.65 AND volume > 0)""",
        """(before <= usual_width * 0.6 AND rng >= usual_range * 1.5
            AND close <= floor_ * (1 - 5.0 / 10000) AND loc <= 1 - 0.65 AND volume > 0)""",
        "'compression_expansion_long'",
        "'compression_expansion_short'",
    )


def g5() -> str:
    return f"""WITH {HOURLY}, w AS (
  SELECT *, (high - low) / {lag('close')} AS rng, {window('max(high)', 20, 1)} AS roof,
         {window('min(low)', 20, 1)} AS floor_, {LOCATION} AS loc FROM b),
v AS (SELECT *, {window('median(rng)', 20, 1, 1)} AS usual FROM w),
u AS (SELECT *,
   COALESCE(close >= roof * (1 + 5.0 / 10000) AND rng >= usual * 1.2 AND loc >= 0.65 AND volume > 0, FALSE) AS up,
   COALESCE(close <= floor_ * (1 - 5.0 / 10000) AND rng >= usual * 1.2 AND loc <= 1 - 0.65 AND volume > 0, FALSE) AS down
   FROM v),
k AS (SELECT *, CASE WHEN up AND NOT down THEN 1 WHEN down AND NOT up THEN -1 END AS brk FROM u),
x AS (SELECT *, last_value(brk IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state
      FROM k)""" + signal_rows(
        "x",
        "(brk = 1 AND state IS NOT NULL)",
        "(brk = -1 AND state IS NOT NULL)",
        "CASE WHEN state = 1 THEN 'bos_long' ELSE 'choch_long' END",
        "CASE WHEN state = -1 THEN 'bos_short' ELSE 'choch_short' END",
    )


def turtle(extra: str = "TRUE", source: str = "x") -> str:
    tag = "turtle_vhf" if source == "y" else "tutci_breakout"
    return signal_rows(
        source,
        f"(high >= roof AND volume > 0 AND {extra})",
        f"(low <= floor_ AND volume > 0 AND {extra})",
        f"'{tag}_long'",
        f"'{tag}_short'",
        both=True,
    )


def g6(source: str = HOURLY, n: int = 20) -> str:
    return f"""WITH {source}, x AS (
  SELECT *, {window('max(high)', n, 1)} AS roof, {window('min(low)', n, 1)} AS floor_ FROM b)""" + turtle()


def g7() -> str:
    a = alpha(14)
    return f"""WITH RECURSIVE {HOURLY}, s AS (SELECT *, abs(close - {lag('close')}) AS step FROM b),
w AS (SELECT *, {window('max(high)', 20, 1)} AS roof, {window('min(low)', 20, 1)} AS floor_,
   ({window('max(close)', 18)} - {window('min(close)', 18)}) AS reach, {window('sum(step)', 18, 0, 1)} AS path FROM s),
v AS (SELECT *, CASE WHEN path <> 0 THEN reach / path END AS vhf FROM w),
r AS (
  SELECT pair, rn, vhf AS ema, 0 AS idle, CASE WHEN vhf IS NULL THEN 0 ELSE 1 END AS seen FROM v WHERE rn = 0
  UNION ALL
  SELECT v.pair, v.rn,
    CASE WHEN v.vhf IS NULL THEN r.ema WHEN r.ema IS NULL THEN v.vhf
         ELSE (pow(1 - {a}, r.idle + 1) * r.ema + {a} * v.vhf) / (pow(1 - {a}, r.idle + 1) + {a}) END,
    CASE WHEN v.vhf IS NULL THEN r.idle + 1 ELSE 0 END,
    r.seen + CASE WHEN v.vhf IS NULL THEN 0 ELSE 1 END
  FROM r JOIN v ON v.pair = r.pair AND v.rn = r.rn + 1),
y AS (SELECT v.*, CASE WHEN r.seen >= 14 THEN r.ema END AS ema, {lag('vhf')} AS vhf_before
      FROM v JOIN r USING (pair, rn))""" + turtle("vhf > ema AND vhf > vhf_before", "y")


def g8() -> str:
    lags = ", ".join(f"lag({c}, {k}) OVER ({SERIES}) AS {c[0]}{k}" for c in ("high", "low") for k in (1, 2, 3, 4))
    x = f"""WITH {HOURLY}, l AS (SELECT *, {lags} FROM b),
x AS (SELECT *,
  COALESCE(h1 > high AND h1 > h2 AND h1 > h3 AND low < least(l2, l1), FALSE) AS peak1,
  COALESCE(h2 > high AND h2 >= h1 AND h2 > h3 AND h2 > h4 AND l1 > least(l3, l2) AND low < least(l3, l2), FALSE) AS peak2,
  COALESCE(l1 < low AND l1 < l2 AND l1 < l3 AND high > greatest(h2, h1), FALSE) AS bottom1,
  COALESCE(l2 < low AND l2 < l1 AND l2 < l3 AND l2 < l4 AND h1 < greatest(h3, h2) AND high > greatest(h3, h2), FALSE) AS bottom2
  FROM l)"""
    return x + signal_rows(
        "x",
        "((bottom1 OR bottom2) AND volume > 0)",
        "((peak1 OR peak2) AND volume > 0)",
        "'isolated_bottom'",
        "'isolated_peak'",
        both=True,
    )


def g9() -> str:
    return f"WITH {HOURLY}, x AS (SELECT *, {window('avg(volume)', 30)} AS usual FROM b)" + signal_rows(
        "x",
        "(volume > usual * 1.5 AND close > open)",
        "(volume > usual * 1.5 AND close < open)",
        "'vbcb_strong_bull'",
        "'vbcb_strong_bear'",
    )


def g10() -> str:
    return f"""WITH RECURSIVE {HOURLY}, w AS (
  SELECT *, {window('avg(close)', 21)} AS mid, {window('stddev_pop(close)', 21)} AS dev,
         greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM b),
s AS (SELECT *, CASE WHEN close > mid + dev THEN 1 WHEN close < mid - dev THEN -1 END AS outside FROM w),
t AS (SELECT *, COALESCE(last_value(outside IGNORE NULLS)
                OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS side FROM s),
a AS (SELECT pair, rn, tr AS atr FROM t WHERE rn = 0
      UNION ALL
      SELECT t.pair, t.rn, 0.8 * a.atr + 0.2 * t.tr FROM a JOIN t ON t.pair = a.pair AND t.rn = a.rn + 1),
u AS (SELECT t.*, CASE WHEN t.rn >= 4 THEN a.atr END AS atr FROM t JOIN a USING (pair, rn)),
f AS (SELECT pair, rn, 0.0::DOUBLE AS line, 0.0::DOUBLE AS previous, 0 AS trend, 0 AS trend_before FROM u WHERE rn = 0
      UNION ALL
      SELECT pair, rn, line, previous,
             CASE WHEN line > previous THEN 1 WHEN line < previous THEN -1 ELSE trend END, trend FROM (
        SELECT u.pair, u.rn, f.line AS previous, f.trend,
          CASE WHEN u.atr IS NULL OR u.side = 0 THEN f.line
               WHEN u.side = 1 THEN greatest(u.low - u.atr, f.line)
               ELSE least(u.high + u.atr, f.line) END AS line
        FROM f JOIN u ON u.pair = f.pair AND u.rn = f.rn + 1)),
x AS (SELECT u.*, f.trend, f.trend_before FROM u JOIN f USING (pair, rn))""" + signal_rows(
        "x",
        "(trend_before = -1 AND trend = 1 AND volume > 0)",
        "(trend_before = 1 AND trend = -1 AND volume > 0)",
        "'follow_line_buy'",
        "'follow_line_sell'",
    )


def g11() -> str:
    # end point of the least-squares line through 20 values, by slope and intercept
    value = "regr_intercept(raw, k) + regr_slope(raw, k) * 19.0"
    return f"""WITH {HOURLY}, w AS (
  SELECT *, close - ((({window('max(high)', 20)}) + ({window('min(low)', 20)})) / 2
                     + ({window('avg(close)', 20)})) / 2 AS raw FROM b),
v AS (SELECT w.pair, w.rn, {value} AS val FROM w JOIN (
        SELECT pair, rn AS at, raw, rn FROM w WHERE raw IS NOT NULL) z
        ON z.pair = w.pair AND z.rn BETWEEN w.rn - 19 AND w.rn,
      LATERAL (SELECT z.rn - (w.rn - 19) AS k) WHERE w.rn >= 38 GROUP BY w.pair, w.rn),
y AS (SELECT b.*, v.val FROM b LEFT JOIN v USING (pair, rn)),
q AS (SELECT *, {window('avg(val)', 5, 0, 38)} AS sig FROM y),
x AS (SELECT *, val > sig AND {lag('val')} <= {lag('sig')} AS above,
             val < sig AND {lag('val')} >= {lag('sig')} AS below FROM q)""".replace(
        "regr_intercept(raw, k)", "regr_intercept(z.raw, k)"
    ).replace("regr_slope(raw, k)", "regr_slope(z.raw, k)") + signal_rows(
        "x", "(above AND volume > 0)", "(below AND volume > 0)", "'sqzmom_v2_buy'", "'sqzmom_v2_sell'"
    )


def g12() -> str:
    steps = ", ".join(f"{c} - {lag(c)} AS {c}_step" for c in ("hh", "ll"))
    moves = ", ".join(
        f"greatest({c}_step, 0.0) AS {c}_up, greatest(-{c}_step, 0.0) AS {c}_down" for c in ("hh", "ll")
    )
    sums = ", ".join(
        f"CASE WHEN rn >= 17 THEN sum({c}_{d}) OVER ({SERIES} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) END AS {c}_{d}s"
        for c in ("hh", "ll")
        for d in ("up", "down")
    )
    weight = lambda c: (
        f"CASE WHEN {c}_ups + {c}_downs <> 0 THEN abs(({c}_ups - {c}_downs) / ({c}_ups + {c}_downs)) * {alpha(2)} ELSE 0.0 END"
    )
    step = lambda c: f"CASE WHEN k.{c} IS NULL THEN NULL ELSE k.{c}_w * k.{c} + (1 - k.{c}_w) * COALESCE(r.{c}_ma, 0.0) END"
    return f"""WITH RECURSIVE {HOURLY}, w AS (
  SELECT *, {window('max(high)', 9)} AS hh, {window('min(low)', 9)} AS ll FROM b),
d AS (SELECT *, {steps} FROM w),
m AS (SELECT *, {moves} FROM d), s AS (SELECT *, {sums} FROM m),
k AS (SELECT *, COALESCE({weight('hh')}, 0.0) AS hh_w, COALESCE({weight('ll')}, 0.0) AS ll_w FROM s),
r AS (SELECT pair, rn, CAST(NULL AS DOUBLE) AS hh_ma, CAST(NULL AS DOUBLE) AS ll_ma FROM k WHERE rn = 0
      UNION ALL
      SELECT k.pair, k.rn, {step('hh')}, {step('ll')} FROM r JOIN k ON k.pair = r.pair AND k.rn = r.rn + 1),
n AS (SELECT k.*, r.hh_ma + 2.0 * {window('stddev_pop(hh)', 2, 0, 8)} AS upper_band,
             r.ll_ma - 2.0 * {window('stddev_pop(ll)', 2, 0, 8)} AS lower_band FROM k JOIN r USING (pair, rn)),
y AS (SELECT *, {window('min(upper_band)', 10, 0, 9)} AS upper_, {window('max(lower_band)', 10, 0, 9)} AS lower_ FROM n),
x AS (SELECT *, close > lower_ AND {lag('close')} <= {lag('lower_')} AS above,
             close < upper_ AND {lag('close')} >= {lag('upper_')} AS below FROM y)""" + signal_rows(
        "x", "(above AND volume > 0)", "(below AND volume > 0)", "'ptt_buy'", "'ptt_sell'", both=True
    )


# -- events ---------------------------------------------------------------------


def period(column: str) -> str:
    return (
        f"CASE WHEN {column} < TIMESTAMP '{TRAIN_END}' THEN 'train' "
        f"WHEN {column} < TIMESTAMP '{VALIDATION_END}' THEN 'validation' ELSE 'holdout' END"
    )


def turtle_signals(n: int = 5) -> str:
    """CTEs b (half-daily bars), x with long_/short_ of the turtle channel."""
    return f"""{HALF_DAILY}, t AS (
  SELECT *, {window('max(high)', n, 1)} AS roof, {window('min(low)', n, 1)} AS floor_ FROM b),
x AS (SELECT *, COALESCE(high >= roof AND volume > 0, FALSE) AND NOT COALESCE(low <= floor_ AND volume > 0, FALSE) AS long_,
             COALESCE(low <= floor_ AND volume > 0, FALSE) AND NOT COALESCE(high >= roof AND volume > 0, FALSE) AS short_
      FROM t)"""


def events_cte(minutes: int = 720, cost_bps: float = 14.0) -> str:
    per_horizon = " UNION ALL ".join(
        f"""SELECT pair, timeframe, date, long_, short_, {h} AS horizon_bars, lead(open) OVER w AS entry,
   lead(close, {h}) OVER w AS exit_, lead(date) OVER w AS entry_date, lead(date, {h}) OVER w AS exit_date,
   max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS max_high,
   min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS min_low,
   bool_and(edge) OVER (w ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS contiguous
 FROM g WINDOW w AS ({SERIES})"""
        for h in HORIZONS
    )
    cost = cost_bps / 10_000
    return f"""
g AS (SELECT *, date - lag(date) OVER ({SERIES}) = INTERVAL {minutes} MINUTE AS edge FROM x),
h AS ({per_horizon}),
v AS (SELECT *, {period('date')} AS period FROM h
      WHERE exit_ IS NOT NULL AND contiguous AND {period('date')} = {period('entry_date')}
        AND {period('date')} = {period('exit_date')}),
ev AS (
  SELECT pair, timeframe, 'long' AS direction, period, horizon_bars, horizon_bars * {minutes} AS holding_minutes,
         date AS signal_date, (exit_ - entry) / entry - {cost} AS net_return,
         (max_high - entry) / entry AS mfe, (min_low - entry) / entry AS mae FROM v WHERE long_
  UNION ALL
  SELECT pair, timeframe, 'short', period, horizon_bars, horizon_bars * {minutes}, date,
         (entry - exit_) / entry - {cost}, (entry - min_low) / entry, (entry - max_high) / entry FROM v WHERE short_)"""


HYP = "pair, direction, period, horizon_bars, holding_minutes"

GREEDY = f"""
o AS (SELECT *, row_number() OVER (PARTITION BY {HYP} ORDER BY signal_date) AS i FROM ev),
walk AS (
  SELECT {HYP}, i, TRUE AS independent, signal_date + holding_minutes * INTERVAL 1 MINUTE AS free FROM o WHERE i = 1
  UNION ALL
  SELECT o.pair, o.direction, o.period, o.horizon_bars, o.holding_minutes, o.i, o.signal_date >= walk.free,
         CASE WHEN o.signal_date >= walk.free THEN o.signal_date + o.holding_minutes * INTERVAL 1 MINUTE ELSE walk.free END
  FROM walk JOIN o ON o.pair = walk.pair AND o.direction = walk.direction AND o.period = walk.period
       AND o.horizon_bars = walk.horizon_bars AND o.i = walk.i + 1),
flagged AS (SELECT o.*, walk.independent FROM o JOIN walk USING ({HYP}, i))"""

_COS2 = "(df / (df + t_stat * t_stat))"
P_VALUE = f"""
CASE WHEN t_stat IS NULL OR n <= 1 THEN 1.0 ELSE CASE WHEN t_stat > 0 THEN (1 - area) / 2 ELSE (1 + area) / 2 END END"""
# Finite series for the central area of Student's t with whole degrees of freedom.
AREA = f"""
CASE WHEN df % 2 = 0 THEN
  sin(theta) * list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * pow(cos(theta), 2 * k)))
ELSE 2 / pi() * (theta + CASE WHEN df = 1 THEN 0 ELSE sin(theta) *
  list_sum(list_transform(range(0, (df - 1) // 2), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow(cos(theta), 2 * k + 1))) END) END"""

SUMMARY = f"""
a AS (SELECT {HYP}, count(*) AS events, count(*) FILTER (independent) AS n, avg(net_return) AS mean_net_return,
   avg(net_return) FILTER (independent) AS test_mean_net_return, median(net_return) AS median_net_return,
   avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, stddev_samp(net_return) AS std_net_return,
   stddev_samp(net_return) FILTER (independent) AS test_std_net_return,
   COALESCE(sum(net_return) FILTER (net_return > 0), 0) AS wins, COALESCE(-sum(net_return) FILTER (net_return < 0), 0) AS losses,
   avg(mfe) AS mean_mfe, avg(mae) AS mean_mae FROM flagged GROUP BY {HYP}),
ts AS (SELECT *, CASE WHEN n > 1 AND test_std_net_return > 0 THEN test_mean_net_return / (test_std_net_return / sqrt(n)) END AS t_stat,
              CAST(n - 1 AS BIGINT) AS df FROM a),
th AS (SELECT *, atan(abs(t_stat) / sqrt(df)) AS theta FROM ts),
ar AS (SELECT *, CASE WHEN t_stat IS NOT NULL THEN {AREA} END AS area FROM th),
summary AS (SELECT {HYP}, events, n AS non_overlapping_events, mean_net_return, test_mean_net_return, median_net_return,
   win_rate, std_net_return, test_std_net_return, t_stat, {P_VALUE} AS p_value,
   CASE WHEN losses > 0 THEN wins / losses ELSE 'inf'::DOUBLE END AS profit_factor, mean_mfe, mean_mae FROM ar)"""


def to_summary() -> str:
    return f"WITH RECURSIVE {turtle_signals()}, {events_cte()}, {GREEDY}, {SUMMARY}"


def rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in columns)


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
KEYS = "pair, direction, horizon_bars, holding_minutes"


def wide(periods: tuple[str, ...]) -> str:
    picks = ", ".join(
        f"CAST(max({m}) FILTER (period = '{p}') AS DOUBLE) AS {m}_{p}" for m in METRICS for p in periods
    )
    inside = ", ".join(f"'{p}'" for p in periods)
    return f"SELECT {KEYS}, {picks} FROM summary WHERE period IN ({inside}) GROUP BY {KEYS}"


def wide_columns(*periods: str) -> str:
    return rounded(*(f"{m}_{p}" for m in METRICS for p in periods))


def discovery_cte() -> str:
    train, validation, fdr = STUDY["train"], STUDY["validation"], STUDY["fdr"]
    return f"""
dw AS ({wide(('train', 'validation'))}),
de AS (SELECT *, COALESCE(non_overlapping_events_train >= {train} AND test_mean_net_return_train > 0, FALSE) AS train_eligible FROM dw),
dp AS (SELECT *, COALESCE(p_value_validation, 1.0) AS p FROM de WHERE train_eligible),
dr AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM dp),
dq AS (SELECT {KEYS}, least(1.0, min(raw) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS validation_q_value FROM dr),
disc AS (SELECT de.*, q.validation_q_value, (SELECT count(*) FROM dp) AS fdr_family_size,
   COALESCE(train_eligible AND non_overlapping_events_validation >= {validation}
            AND test_mean_net_return_validation > 0 AND q.validation_q_value <= {fdr}, FALSE) AS discovery_pass,
   CASE WHEN test_mean_net_return_train IS NOT NULL AND test_mean_net_return_validation IS NOT NULL
        THEN least(test_mean_net_return_train, test_mean_net_return_validation) END AS discovery_score
   FROM de LEFT JOIN dq q USING ({KEYS}))"""


def discovery_columns() -> str:
    return f"""{KEYS}, {wide_columns('train', 'validation')}, CAST(train_eligible AS BIGINT) AS train_eligible,
  round(validation_q_value, 9) AS validation_q_value, fdr_family_size,
  CAST(discovery_pass AS BIGINT) AS discovery_pass, round(discovery_score, 9) AS discovery_score"""


def trades_cte() -> str:
    return """
tr AS (SELECT 'system_' || CAST(event_id % 4 AS VARCHAR) AS strategy, '1h' AS timeframe, event_type AS pair,
   (value - 50) / 1000 - 4.0 / 10000 AS r, user_id % 2 = 1 AS is_short, ts AS open_date,
   ts + (event_id % 60 + 1) * INTERVAL 1 MINUTE AS close_date,
   CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 60 + 1 AS DOUBLE) END AS trade_duration,
   ['exit_signal', 'roi', 'stop_loss'][event_id % 3 + 1] AS exit_reason,
   (event_id % 7 - 3) / 100 AS funding_fees, event_id AS trade_no,
   CASE WHEN user_id % 2 = 1 THEN 'short' ELSE 'long' END AS direction FROM events)"""


def trade_columns(sides: bool = True, drawdown: bool = True) -> str:
    return f"""count(*) AS trades, count(*) FILTER (r > 0) AS wins, count(*) FILTER (r = 0) AS draws,
  count(*) FILTER (r < 0) AS losses, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 9) AS win_rate,
  round(avg(r), 9) AS expectancy, round(median(r), 9) AS median_return,
  round(CASE WHEN COALESCE(-sum(r) FILTER (r < 0), 0) > 0 THEN COALESCE(sum(r) FILTER (r > 0), 0) / -sum(r) FILTER (r < 0)
       ELSE 'inf'::DOUBLE END, 9) AS profit_factor, round(sum(r), 6) AS sum_adjusted_returns,
  round(avg(trade_duration), 9) AS avg_duration_minutes,
  {"count(*) FILTER (NOT is_short) AS long_trades, count(*) FILTER (is_short) AS short_trades," if sides else ""}
  round(sum(funding_fees), 6) AS funding_fees_sum"""


def drawdown_cte(keys: str, source: str = "tr") -> str:
    """Deepest fall of the running product below its running maximum, over whole groups."""
    order = f"PARTITION BY {keys} ORDER BY pair_, close_date, open_date, trade_no ROWS UNBOUNDED PRECEDING"
    return f"""
eq AS (SELECT *, product(1 + r) OVER ({order}) AS equity FROM {source}),
pk AS (SELECT *, max(equity) OVER ({order}) AS peak FROM eq),
dd AS (SELECT {keys}, round(min(equity / peak - 1), 9) AS max_drawdown_compounded FROM pk GROUP BY ALL)"""


def tree(by: str, line: str, table: str) -> str:
    """Tree fingerprint of a table's lines, the last two parts of a WITH query."""
    return f"""leaves AS (SELECT {by}, sha256({line}) AS h FROM {table}),
 branches AS (SELECT {by}, substr(h, 1, 3) AS k, sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM leaves GROUP BY {by}, substr(h, 1, 3))
 SELECT {by}, sha256(string_agg(d, chr(10) ORDER BY k)) AS fingerprint FROM branches GROUP BY {by}"""
