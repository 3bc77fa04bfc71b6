"""Queries over candle types and market-structure patterns (survey §2.6, A35)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import patterns, recursive, rolling
from barloom.plans.base import BARS_SQL, BY_BAR_SQL, bars, r
from barloom.plans.indicators import RSI_SQL
from barloom.plans.registry import query

_CANDLE_SQL = f"""{BARS_SQL}, cn0 AS (
    SELECT *, lag(open) OVER w AS po, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc, lead(close) OVER w AS nc, count(*) OVER (PARTITION BY ticker) AS n,
           abs(close - open) AS body, greatest(high - low, 1e-10) AS rng, high - greatest(open, close) AS uw, least(open, close) - low AS dw FROM bars WINDOW w AS ({BY_BAR_SQL})
), cn AS (
    SELECT *, abs(pc - po) AS pb, CASE WHEN pc IS NULL THEN NULL WHEN body / rng < 0.05 THEN 'doji' WHEN body / rng > 0.9 AND uw / rng < 0.05 AND dw / rng < 0.05 THEN 'marubozu'
        WHEN body > abs(pc - po) * 1.1::DOUBLE AND close > open AND open < pc AND close > po THEN 'bullish_engulf' WHEN body > abs(pc - po) * 1.1::DOUBLE AND open > close AND open > pc AND close < po THEN 'bearish_engulf'
        WHEN abs(pc - po) > 0 AND body < abs(pc - po) * 0.8::DOUBLE AND close > open AND open > po AND close < pc THEN 'bullish_harami'
        WHEN abs(pc - po) > 0 AND body < abs(pc - po) * 0.8::DOUBLE AND open > close AND po > open AND pc > close THEN 'bearish_harami'
        WHEN high < ph AND low > pl THEN 'inside' WHEN high > ph AND low < pl THEN 'outside' WHEN dw > 2 * body AND uw < body THEN 'hammer' WHEN uw > 2 * body AND dw < body THEN 'shooting_star'
        WHEN dw > 2 * body THEN 'long_lower' WHEN uw > 2 * body THEN 'long_upper' WHEN body > 3 * abs(pc - po) AND close > open THEN 'big_bull' WHEN body > 3 * abs(pc - po) AND open > close THEN 'big_bear'
        ELSE 'neutral' END AS candle FROM cn0
), odds0 AS (
    SELECT ticker, candle, count(*) AS count, avg((((nc - close) / greatest(close, 1e-10)) > 0)::INT) AS p, avg((nc - close) / greatest(close, 1e-10)) AS r
    FROM cn WHERE n >= 10 AND bar_ix >= greatest(2, n - 1000) + 1 AND bar_ix <= n - 2 GROUP BY 1, 2
), odds AS (
    SELECT t.ticker, c.candle, CASE WHEN count >= 15 THEN p ELSE 0.5 END AS p_up, CASE WHEN count >= 15 THEN r ELSE 0.0 END AS avg_ret, coalesce(count, 0) AS count
    FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN (SELECT unnest({list(patterns.CANDLES)!r}) AS candle) c LEFT JOIN odds0 o ON o.ticker = t.ticker AND o.candle = c.candle
)"""


@query("c01_candle_types", f"WITH {_CANDLE_SQL} SELECT ticker, bar_ix, candle FROM cn")
def c01(spark, sf):
    return patterns.candle_type(bars(spark, sf)).select("ticker", "bar_ix", "candle")


@query("a35_candle_odds", f"WITH {_CANDLE_SQL} SELECT ticker, candle, round(p_up, 6) AS p_up, round(avg_ret, 6) AS avg_ret, count FROM odds")
def a35(spark, sf):
    return patterns.candle_odds(bars(spark, sf)).select("ticker", "candle", r("p_up"), r("avg_ret"), "count")


@query(
    "c02_candle_signal",
    f"""WITH {_CANDLE_SQL} SELECT ticker, bar_ix, candle, CASE WHEN bar_ix = 0 THEN 'none' WHEN p_up - 0.5 > 0.05::DOUBLE THEN 'bullish' WHEN p_up - 0.5 < -0.05::DOUBLE THEN 'bearish' ELSE 'none' END AS candle_signal
        FROM (SELECT ticker, bar_ix, coalesce(candle, 'neutral') AS candle FROM cn) JOIN odds USING (ticker, candle)""",
)
def c02(spark, sf):
    b = bars(spark, sf)
    return patterns.candle_signal(b, patterns.candle_odds(b)).select("ticker", "bar_ix", "candle", "candle_signal")


_SWINGS_SQL = f"""{BARS_SQL}, sw AS (
    SELECT *, count(*) OVER c3 = 3 AND low = min(low) OVER c3 AS swing_low, count(*) OVER c3 = 3 AND high = max(high) OVER c3 AS swing_high FROM bars
    WINDOW c3 AS ({BY_BAR_SQL} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
)"""


def _recent_sql(age: int) -> str:
    return f"""{_SWINGS_SQL}, rs AS (
        SELECT *, last_value(CASE WHEN swing_low THEN bar_ix END IGNORE NULLS) OVER f AS li, last_value(CASE WHEN swing_low THEN low END IGNORE NULLS) OVER f AS ll,
               last_value(CASE WHEN swing_high THEN bar_ix END IGNORE NULLS) OVER f AS hi, last_value(CASE WHEN swing_high THEN high END IGNORE NULLS) OVER f AS hl,
               list(close) OVER (ROWS_{age}) AS cs FROM sw WINDOW f AS ({BY_BAR_SQL} ROWS BETWEEN {age} PRECEDING AND 1 PRECEDING)
    )""".replace(f"(ROWS_{age})", f"({BY_BAR_SQL} ROWS BETWEEN {age} PRECEDING AND CURRENT ROW)")


@query("p01_swings", f"WITH {_SWINGS_SQL} SELECT ticker, bar_ix, swing_low, swing_high FROM sw")
def p01(spark, sf):
    return patterns.swings(bars(spark, sf)).select("ticker", "bar_ix", "swing_low", "swing_high")


@query("p02_recent_swings", f"WITH {_recent_sql(48)} SELECT ticker, bar_ix, coalesce(li, -1) AS low_ix, ll AS low_level, coalesce(hi, -1) AS high_ix, hl AS high_level FROM rs")
def p02(spark, sf):
    b = patterns.recent_swings(bars(spark, sf))
    return b.select("ticker", "bar_ix", F.coalesce("low_swing.ix", F.lit(-1)).alias("low_ix"), F.col("low_swing.level").alias("low_level"), F.coalesce("high_swing.ix", F.lit(-1)).alias("high_ix"), F.col("high_swing.level").alias("high_level"))


def ob_sql(move: float, age: int = 24) -> str:
    return f"""{BARS_SQL}, ob0 AS (
        SELECT *, CASE WHEN bar_ix >= 1 AND (lead(high) OVER w - lead(low) OVER w) / greatest(close, 1e-10) >= {move}::DOUBLE THEN CASE WHEN close < open THEN 'bullish' WHEN close > open THEN 'bearish' END END AS side
        FROM bars WINDOW w AS ({BY_BAR_SQL})
    ), obs AS (
        SELECT *, last_value(CASE WHEN side IS NOT NULL THEN {{'signal': side, 'high': high, 'low': low, 'ix': bar_ix, 'volume': volume}} END IGNORE NULLS) OVER f AS ob, avg(volume) OVER r48 AS mv, list(close) OVER f0 AS cs
        FROM ob0 WINDOW f AS ({BY_BAR_SQL} ROWS BETWEEN {age} PRECEDING AND 1 PRECEDING), f0 AS ({BY_BAR_SQL} ROWS BETWEEN {age} PRECEDING AND CURRENT ROW), r48 AS ({BY_BAR_SQL} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)
    )"""


@query("p03_order_block", f"WITH {ob_sql(0.003)} SELECT ticker, bar_ix, coalesce(ob.signal, 'none') AS signal, ob.high AS ob_high, ob.low AS ob_low, coalesce(ob.ix, -1) AS ix FROM obs")
def p03(spark, sf):
    b = patterns.order_block(bars(spark, sf))
    return b.select("ticker", "bar_ix", F.coalesce("ob.signal", F.lit("none")).alias("signal"), F.col("ob.high").alias("ob_high"), F.col("ob.low").alias("ob_low"), F.coalesce("ob.ix", F.lit(-1)).alias("ix"))


_GAP_SQL = f"""{BARS_SQL}, g0 AS (
    SELECT *, lag(low) OVER w AS pl, lag(high) OVER w AS ph, lead(low) OVER w AS nl, lead(high) OVER w AS nh FROM bars WINDOW w AS ({BY_BAR_SQL})
), g1 AS (
    SELECT *, CASE WHEN bar_ix >= 2 AND pl > nh THEN {{'signal': 'bullish', 'high': pl, 'low': nh, 'ix': bar_ix}} WHEN bar_ix >= 2 AND ph < nl THEN {{'signal': 'bearish', 'high': nl, 'low': ph, 'ix': bar_ix}} END AS gap FROM g0
), g AS (
    SELECT *, last_value(gap IGNORE NULLS) OVER f AS fvg FROM g1 WINDOW f AS ({BY_BAR_SQL} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)
)"""


@query("p04_fair_value_gap", f"WITH {_GAP_SQL} SELECT ticker, bar_ix, coalesce(fvg.signal, 'none') AS signal, fvg.high AS fvg_high, fvg.low AS fvg_low, coalesce(bar_ix - fvg.ix, -1) AS age FROM g")
def p04(spark, sf):
    b = patterns.fair_value_gap(bars(spark, sf))
    return b.select("ticker", "bar_ix", F.coalesce("fvg.signal", F.lit("none")).alias("signal"), F.col("fvg.high").alias("fvg_high"), F.col("fvg.low").alias("fvg_low"), F.coalesce(F.col("bar_ix") - F.col("fvg.ix"), F.lit(-1)).alias("age"))


@query(
    "p05_j10_gap_confluence",
    f"""WITH {_GAP_SQL}, z AS (
        SELECT b.ticker, b.bar_ix, b.close, z.gap.signal AS side, z.gap.low AS lo, z.gap.high AS hi, b.bar_ix - z.bar_ix AS age FROM bars b JOIN g1 z ON z.ticker = b.ticker AND z.bar_ix < b.bar_ix AND b.bar_ix - z.bar_ix <= 47 WHERE z.gap IS NOT NULL
    ), zn AS (SELECT *, row_number() OVER (PARTITION BY ticker, bar_ix, side ORDER BY lo, hi, age) AS k FROM z),
    pr AS (
        SELECT a.ticker, a.bar_ix, a.side, a.k AS ka, b.k AS kb, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM zn a JOIN zn b ON a.ticker = b.ticker AND a.bar_ix = b.bar_ix AND a.side = b.side AND a.k < b.k
        WHERE greatest(a.lo, b.lo) < least(a.hi, b.hi) AND a.close BETWEEN greatest(a.lo, b.lo) AND least(a.hi, b.hi)
    ), cv AS (
        SELECT p.ticker, p.bar_ix, p.side, p.ka, p.kb, p.lo, p.hi, count(*) AS n, min(z.age) AS age FROM pr p JOIN zn z ON z.ticker = p.ticker AND z.bar_ix = p.bar_ix AND z.side = p.side AND z.lo < p.hi AND z.hi > p.lo GROUP BY ALL
    ), best AS (SELECT * FROM cv QUALIFY row_number() OVER (PARTITION BY ticker, bar_ix ORDER BY CASE side WHEN 'bullish' THEN 0 ELSE 1 END, n DESC, ka, kb) = 1)
    SELECT b.ticker, b.bar_ix, coalesce(side, 'none') AS fvg_signal, coalesce(n, 0)::INT AS fvg_count, lo AS fvg_low, hi AS fvg_high, coalesce(age, -1) AS fvg_age FROM bars b LEFT JOIN best USING (ticker, bar_ix)""",
)
def p05(spark, sf):
    return patterns.gap_confluence(bars(spark, sf)).select("ticker", "bar_ix", "fvg_signal", "fvg_count", "fvg_low", "fvg_high", F.coalesce("fvg_age", F.lit(-1)).alias("fvg_age"))


@query(
    "p06_liquidity_sweep",
    f"""WITH {_recent_sql(24)}, s AS (SELECT *, list_min(list_slice(cs, len(cs) - (bar_ix - li), len(cs))) AS mn, list_max(list_slice(cs, len(cs) - (bar_ix - hi), len(cs))) AS mx FROM rs),
        v AS (SELECT *, coalesce(mn < ll AND close > ll, false) AS bull, coalesce(mx > hl AND close < hl, false) AS bear FROM s)
        SELECT ticker, bar_ix, CASE WHEN bull THEN 'bullish' WHEN bear THEN 'bearish' ELSE 'none' END AS sweep_signal, CASE WHEN bull THEN ll WHEN bear THEN hl END AS sweep_level FROM v""",
)
def p06(spark, sf):
    return patterns.liquidity_sweep(bars(spark, sf)).select("ticker", "bar_ix", "sweep_signal", "sweep_level")


@query(
    "p07_premium_discount",
    f"""WITH {_recent_sql(96)}, v AS (SELECT *, coalesce(hl - ll > 0, false) AS ok, greatest(0.0, least(1.0, (close - ll) / nullif(hl - ll, 0))) AS p FROM rs)
        SELECT ticker, bar_ix, round(CASE WHEN ok THEN p ELSE 0.5 END, 6) AS pd_pct, CASE WHEN ok AND p < 0.5 THEN 'discount' WHEN ok AND p > 0.5 THEN 'premium' ELSE 'none' END AS pd_zone,
               CASE WHEN ok THEN bar_ix - least(li, hi) ELSE -1 END AS pd_age FROM v""",
)
def p07(spark, sf):
    return patterns.premium_discount(bars(spark, sf)).select("ticker", "bar_ix", r("pd_pct"), "pd_zone", "pd_age")


@query(
    "p08_structure_shift",
    f"""WITH {_recent_sql(24)} SELECT ticker, bar_ix, CASE WHEN close > hl THEN 'bullish' WHEN close < ll THEN 'bearish' ELSE 'none' END AS mss_signal, CASE WHEN close > hl THEN hl WHEN close < ll THEN ll END AS mss_level FROM rs""",
)
def p08(spark, sf):
    return patterns.structure_shift(bars(spark, sf)).select("ticker", "bar_ix", "mss_signal", "mss_level")


@query(
    "p09_breaker_block",
    f"""WITH {ob_sql(0.002)}, s AS (SELECT *, list_slice(cs, len(cs) - (bar_ix - ob.ix), len(cs)) AS since FROM obs),
        e AS (SELECT *, CASE WHEN ob.signal = 'bullish' THEN list_min(since) ELSE list_max(since) END AS worst, CASE WHEN ob.signal = 'bullish' THEN ob.low ELSE ob.high END AS edge FROM s),
        h AS (SELECT *, bar_ix - (ob.ix + list_position(since, worst) - 1) AS age FROM e),
        k AS (SELECT *, coalesce(ob IS NOT NULL AND CASE WHEN ob.signal = 'bullish' THEN worst < ob.low ELSE worst > ob.high END AND abs(close - edge) <= ob.high - ob.low AND age <= 48, false) AS hit FROM h)
        SELECT ticker, bar_ix, CASE WHEN NOT hit THEN 'none' WHEN ob.signal = 'bullish' THEN 'bearish' ELSE 'bullish' END AS breaker_signal, CASE WHEN hit THEN edge END AS breaker_level, CASE WHEN hit THEN age ELSE -1 END AS breaker_age FROM k""",
)
def p09(spark, sf):
    return patterns.breaker_block(bars(spark, sf)).select("ticker", "bar_ix", "breaker_signal", "breaker_level", F.col("breaker_age").cast("long").alias("breaker_age"))


@query(
    "p10_volume_order_block",
    f"""WITH {ob_sql(0.002)} SELECT ticker, bar_ix, CASE WHEN ob IS NULL OR (mv > 0 AND ob.volume < mv * 1.5::DOUBLE) THEN 'none' ELSE ob.signal END AS signal,
        CASE WHEN mv > 0 AND ob.volume < mv * 1.5::DOUBLE THEN -1 ELSE coalesce(ob.ix, -1) END AS ix FROM obs""",
)
def p10(spark, sf):
    b = patterns.volume_order_block(bars(spark, sf))
    return b.select("ticker", "bar_ix", F.coalesce("vob.signal", F.lit("none")).alias("signal"), F.coalesce("vob.ix", F.lit(-1)).alias("ix"))


def _clusters_sql(low: str, high: str, source: str, oldest: int, newest: int, tolerance: float) -> str:
    """Gap-and-island clusters of the pivots in each bar's frame."""
    return f""", pv AS (
        SELECT b.ticker, b.bar_ix, b.close, 'h' AS side, s.high AS lv FROM {source} s JOIN bars b ON b.ticker = s.ticker AND b.bar_ix - s.bar_ix BETWEEN {newest} AND {oldest} WHERE s.{high}
        UNION ALL SELECT b.ticker, b.bar_ix, b.close, 'l', s.low FROM {source} s JOIN bars b ON b.ticker = s.ticker AND b.bar_ix - s.bar_ix BETWEEN {newest} AND {oldest} WHERE s.{low}
    ), gp AS (
        SELECT *, CASE WHEN abs(lv - lag(lv) OVER q) / greatest(abs(lag(lv) OVER q), 1e-10) <= {tolerance}::DOUBLE THEN 0 ELSE 1 END AS new FROM pv WINDOW q AS (PARTITION BY ticker, bar_ix, side ORDER BY lv)
    ), isl AS (SELECT *, sum(new) OVER (PARTITION BY ticker, bar_ix, side ORDER BY lv ROWS UNBOUNDED PRECEDING) AS island FROM gp),
    cl AS (SELECT ticker, bar_ix, side, any_value(close) AS close, avg(lv) AS m FROM isl GROUP BY ticker, bar_ix, side, island HAVING count(*) >= 2),
    verdict AS (SELECT ticker, bar_ix, max(m) FILTER (side = 'h' AND m < close) AS up, max(m) FILTER (side = 'l' AND m > close) AS dn FROM cl GROUP BY 1, 2)
    SELECT b.ticker, b.bar_ix, CASE WHEN up IS NOT NULL THEN 'bullish' WHEN dn IS NOT NULL THEN 'bearish' ELSE 'none' END AS signal, round(coalesce(up, dn), 6) AS level FROM bars b LEFT JOIN verdict USING (ticker, bar_ix)"""


@query("p11_p12_equal_levels", f"WITH {_SWINGS_SQL}{_clusters_sql('swing_low', 'swing_high', 'sw', 95, 1, 0.001)}")
def p11(spark, sf):
    return patterns.equal_levels(bars(spark, sf)).select("ticker", "bar_ix", F.col("eq_signal").alias("signal"), r("eq_level").alias("level"))


_FRACTAL_SQL = f"""{BARS_SQL}, fr AS (
    SELECT *, coalesce(low < lag(low, 2) OVER w AND low < lag(low) OVER w AND low < lead(low) OVER w AND low < lead(low, 2) OVER w, false) AS fractal_low,
           coalesce(high > lag(high, 2) OVER w AND high > lag(high) OVER w AND high > lead(high) OVER w AND high > lead(high, 2) OVER w, false) AS fractal_high FROM bars WINDOW w AS ({BY_BAR_SQL})
)"""


@query("p13_fractals", f"WITH {_FRACTAL_SQL} SELECT ticker, bar_ix, fractal_low, fractal_high FROM fr")
def p13(spark, sf):
    return patterns.fractals(bars(spark, sf)).select("ticker", "bar_ix", "fractal_low", "fractal_high")


_FSIG_SQL = f"""{_FRACTAL_SQL}, fs0 AS (
    SELECT *, last_value(CASE WHEN fractal_high THEN {{'ix': bar_ix, 'level': high}} END IGNORE NULLS) OVER f AS h, last_value(CASE WHEN fractal_low THEN {{'ix': bar_ix, 'level': low}} END IGNORE NULLS) OVER f AS l,
           (high + low) / 2 AS mid FROM fr WINDOW f AS ({BY_BAR_SQL} ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING)
), fs AS (
    SELECT *, CASE WHEN h IS NOT NULL THEN 'bearish' WHEN l IS NOT NULL THEN 'bullish' ELSE 'none' END AS fractal_signal,
           CASE WHEN count(*) OVER r34 = 34 THEN avg(mid) OVER r5 - avg(mid) OVER r34 ELSE 0.0 END AS ao FROM fs0
    WINDOW r5 AS ({BY_BAR_SQL} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), r34 AS ({BY_BAR_SQL} ROWS BETWEEN 33 PRECEDING AND CURRENT ROW)
)"""


@query("p14_fractal_signal", f"WITH {_FSIG_SQL} SELECT ticker, bar_ix, fractal_signal, coalesce(bar_ix - coalesce(h.ix, l.ix), -1) AS fractal_age, coalesce(h.level, l.level, 0.0) AS fractal_level FROM fs")
def p14(spark, sf):
    return patterns.fractal_signal(bars(spark, sf)).select("ticker", "bar_ix", "fractal_signal", "fractal_age", "fractal_level")


@query(
    "p15_fractal_breakout",
    f"""WITH {_FRACTAL_SQL}, hits AS (
        SELECT b.ticker, b.bar_ix, max(s.bar_ix) FILTER (s.fractal_high AND s.high < b.close) AS up, max(s.bar_ix) FILTER (s.fractal_low AND s.low > b.close) AS dn
        FROM bars b JOIN fr s ON s.ticker = b.ticker AND b.bar_ix - s.bar_ix BETWEEN 2 AND 12 GROUP BY 1, 2
    ) SELECT b.ticker, b.bar_ix, CASE WHEN up IS NOT NULL THEN 'bullish' WHEN dn IS NOT NULL THEN 'bearish' ELSE 'none' END AS breakout_signal,
        coalesce(CASE WHEN up IS NOT NULL THEN s.high ELSE s.low END, 0.0) AS breakout_level, coalesce(b.bar_ix - coalesce(up, dn), -1) AS breakout_age
        FROM bars b LEFT JOIN hits USING (ticker, bar_ix) LEFT JOIN fr s ON s.ticker = b.ticker AND s.bar_ix = coalesce(up, dn)""",
)
def p15(spark, sf):
    return patterns.fractal_breakout(bars(spark, sf)).select("ticker", "bar_ix", "breakout_signal", "breakout_level", "breakout_age")


@query("p16_fractal_clusters", f"WITH {_FRACTAL_SQL}{_clusters_sql('fractal_low', 'fractal_high', 'fr', 23, 2, 0.002)}")
def p16(spark, sf):
    return patterns.fractal_clusters(bars(spark, sf)).select("ticker", "bar_ix", F.col("cluster_signal").alias("signal"), r("cluster_level").alias("level"))


@query(
    "p17_awesome_fractal",
    f"""WITH {_FSIG_SQL} SELECT ticker, bar_ix, CASE WHEN (fractal_signal = 'bullish' AND ao > 0) OR (fractal_signal = 'bearish' AND ao < 0) THEN fractal_signal ELSE 'none' END AS ao_fractal_signal FROM fs""",
)
def p17(spark, sf):
    return patterns.awesome_fractal(bars(spark, sf)).select("ticker", "bar_ix", "ao_fractal_signal")


_DIV_SQL = f"""{BARS_SQL}, dv0 AS (SELECT *, coalesce(sign(close - lag(close) OVER w), 1) * volume AS sv FROM bars WINDOW w AS ({BY_BAR_SQL})),
dv1 AS (SELECT *, sum(sv) OVER w AS obv FROM dv0 WINDOW w AS ({BY_BAR_SQL})),
dv2 AS (
    SELECT *, coalesce(close > lag(close) OVER w AND close > lag(close, 2) OVER w AND close > lead(close) OVER w AND close > lead(close, 2) OVER w, false) AS is_peak,
           coalesce(close < lag(close) OVER w AND close < lag(close, 2) OVER w AND close < lead(close) OVER w AND close < lead(close, 2) OVER w, false) AS is_valley FROM dv1 WINDOW w AS ({BY_BAR_SQL})
), dv3 AS (
    SELECT *, list({{'p': close, 'i': obv}}) FILTER (is_peak) OVER f AS pk, list({{'p': close, 'i': obv}}) FILTER (is_valley) OVER f AS vl FROM dv2 WINDOW f AS ({BY_BAR_SQL} ROWS BETWEEN 21 PRECEDING AND 2 PRECEDING)
)"""


@query("p18_pivots", f"WITH {_DIV_SQL} SELECT ticker, bar_ix, is_peak, is_valley FROM dv2")
def p18(spark, sf):
    return patterns.pivots(bars(spark, sf), "close").select("ticker", "bar_ix", "is_peak", "is_valley")


@query(
    "p19_divergence",
    f"""WITH {_DIV_SQL} SELECT ticker, bar_ix, CASE WHEN coalesce(bar_ix >= 23 AND pk[-1].p > pk[-2].p AND pk[-1].i < pk[-2].i, false) THEN 'bearish'
        WHEN coalesce(bar_ix >= 23 AND vl[-1].p < vl[-2].p AND vl[-1].i > vl[-2].i, false) THEN 'bullish' ELSE 'none' END AS div FROM dv3""",
)
def p19(spark, sf):
    return patterns.divergence(rolling.obv(bars(spark, sf)), "obv").select("ticker", "bar_ix", "div")


def _verdict_sql(i: str) -> str:
    return f"""CASE WHEN coalesce(bar_ix >= 23 AND pk[-1].p > pk[-2].p AND pk[-1].{i} < pk[-2].{i}, false) THEN 'bearish'
        WHEN coalesce(bar_ix >= 23 AND vl[-1].p < vl[-2].p AND vl[-1].{i} > vl[-2].{i}, false) THEN 'bullish' ELSE 'none' END AS {i}_div"""


@query(
    "p20_divergence_bundle",
    f"""WITH {_DIV_SQL}, {RSI_SQL.removeprefix(BARS_SQL + ", ")}, t AS (SELECT *, (high + low + close) / 3.0 AS typ FROM bars),
        f AS (SELECT *, row_number() OVER s AS k, coalesce(typ > lag(typ) OVER s, false) AS up FROM t WINDOW s AS (PARTITION BY ticker, session_id ORDER BY bar_ix)),
        mf AS (SELECT *, sum(CASE WHEN up THEN typ * volume ELSE 0 END) OVER q AS pos, sum(CASE WHEN up THEN 0 ELSE typ * volume END) OVER q AS neg FROM f
              WINDOW q AS (PARTITION BY ticker, session_id ORDER BY bar_ix ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
        iv AS (SELECT d.ticker, d.bar_ix, d.close, d.is_peak, d.is_valley, d.obv, round(100 - 100 / (1 + ag / greatest(al, 1e-10)), 9) AS rsi, round(CASE WHEN mf.k > 5 THEN 100 - 100 / (1 + pos / greatest(neg, 1e-10)) END, 9) AS mfi
               FROM dv2 d JOIN rs USING (ticker, bar_ix) JOIN mf USING (ticker, bar_ix)),
        iw AS (SELECT *, list({{'p': close, 'rsi': rsi, 'obv': obv, 'mfi': mfi}}) FILTER (is_peak) OVER f AS pk, list({{'p': close, 'rsi': rsi, 'obv': obv, 'mfi': mfi}}) FILTER (is_valley) OVER f AS vl
               FROM iv WINDOW f AS ({BY_BAR_SQL} ROWS BETWEEN 21 PRECEDING AND 2 PRECEDING))
        SELECT ticker, bar_ix, {_verdict_sql("rsi")}, {_verdict_sql("obv")}, {_verdict_sql("mfi")} FROM iw""",
)
def p20(spark, sf):
    """RSI, OBV and MFI divergences together (periods of 5: the sessions have nine bars)."""
    b = rolling.mfi(rolling.obv(bars(spark, sf)), 5)
    b = b.join(recursive.wilder_rsi(b, 5).select("ticker", "bar_ix", "rsi"), ["ticker", "bar_ix"])
    # Values that differ in the last bits only are equal.
    b = b.withColumns({c: F.round(c, 9) for c in ("rsi", "mfi")})
    for indicator in ("rsi", "obv", "mfi"):
        b = patterns.divergence(b, indicator, name=f"{indicator}_div")
    return b.select("ticker", "bar_ix", "rsi_div", "obv_div", "mfi_div")
