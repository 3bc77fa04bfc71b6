"""Queries over trailing, session and recursive indicators (survey §2.5, C3, C4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import expanding, recursive, rolling
from barloom.plans.base import BARS_SQL, BY_BAR_SQL, bars, r
from barloom.plans.registry import query, table
from barloom.sources.bars import daily_bars, numbered

_W = f"w AS ({BY_BAR_SQL}), r20 AS ({BY_BAR_SQL} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_BB_SQL = f"""{BARS_SQL}, bb0 AS (
    SELECT *, CASE WHEN count(*) OVER r20 = 20 THEN avg(close) OVER r20 END AS sma, CASE WHEN count(*) OVER r20 = 20 THEN stddev_samp(close) OVER r20 END AS sd
    FROM bars WINDOW {_W}
), bb AS (
    SELECT *, sma + 2 * sd AS upper, sma - 2 * sd AS lower, (sma + 2 * sd - (sma - 2 * sd)) / (sma + 1e-8) AS width FROM bb0
)"""
_SQUEEZE_SQL = f"""{_BB_SQL}, sq0 AS (
    SELECT *, list(width) FILTER (width IS NOT NULL) OVER r20 AS ws, count(*) OVER r20 AS n FROM bb WINDOW {_W}
), sq AS (
    SELECT *, CASE WHEN n = 20 AND len(ws) >= 10 AND width IS NOT NULL THEN len(list_filter(ws, lambda x: x < width)) / len(ws) * 100.0 ELSE 50.0 END AS squeeze_pct,
           n = 20 AND coalesce(len(ws), 0) >= 10 AND width IS NOT NULL AS known FROM sq0
)"""


@query("w08_bollinger", f"WITH {_BB_SQL} SELECT ticker, bar_ix, round(sma, 6) AS sma, round(upper, 6) AS upper, round(lower, 6) AS lower, round(width, 6) AS width FROM bb")
def w08(spark, sf):
    return rolling.bollinger(bars(spark, sf)).select("ticker", "bar_ix", r("sma"), r("upper"), r("lower"), r("width"))


@query(
    "w29_c03_c04_band_zone_squeeze",
    f"""WITH {_SQUEEZE_SQL}, z AS (
        SELECT *, coalesce(upper > lower, false) AS ok, greatest(0.0, least(1.0, (close - lower) / nullif(upper - lower, 0))) AS pct FROM sq
    ) SELECT ticker, bar_ix, CASE WHEN NOT ok THEN 'unknown' WHEN close > upper THEN 'above_upper' WHEN close < lower THEN 'below_lower'
        WHEN pct >= 0.75 THEN 'near_upper' WHEN pct <= 0.25 THEN 'near_lower' ELSE 'middle' END AS zone,
        round(CASE WHEN ok THEN pct ELSE 0.5 END, 6) AS pct_bandwidth, round(squeeze_pct, 6) AS squeeze_pct, known AND squeeze_pct < 20 AS is_squeeze,
        coalesce(close <= lower, false) AS mr_long, coalesce(close >= upper, false) AS mr_short FROM z""",
)
def w29(spark, sf):
    b = rolling.squeeze(rolling.bollinger(bars(spark, sf)))
    zone, pct = rolling.band_zone(F.col("close"), F.col("upper"), F.col("lower"))
    return b.select(
        "ticker",
        "bar_ix",
        zone.alias("zone"),
        r(pct).alias("pct_bandwidth"),
        r("squeeze_pct"),
        "is_squeeze",
        rolling.true(F.col("close") <= F.col("lower")).alias("mr_long"),
        rolling.true(F.col("close") >= F.col("upper")).alias("mr_short"),
    )


PARTIAL_BB_SQL = f"""{BARS_SQL}, pb0 AS (
    SELECT *, avg(close) OVER r20 AS bb_mid, coalesce(stddev_samp(close) OVER r20, 0.0) AS bb_std FROM bars WINDOW {_W}
), pb AS (
    SELECT *, (bb_mid + 2 * bb_std - (bb_mid - 2 * bb_std)) / greatest(bb_mid, 1e-10) AS bb_width,
           (close - (bb_mid - 2 * bb_std)) / greatest(bb_mid + 2 * bb_std - (bb_mid - 2 * bb_std), 1e-10) AS bb_pct,
           close <= bb_mid - 2 * bb_std + 0.5 * bb_std AS touch_lower, close >= bb_mid + 2 * bb_std - 0.5 * bb_std AS touch_upper FROM pb0
)"""


@query(
    "w09_w10_w24_bollinger_partial",
    f"""WITH {PARTIAL_BB_SQL} SELECT ticker, bar_ix, round(bb_mid, 6) AS bb_mid, round(bb_std, 6) AS bb_std, round(bb_width, 6) AS bb_width,
        CASE WHEN bb_std > 0 THEN round(bb_pct, 5) END AS bb_pct, touch_lower, touch_upper,
        coalesce(bb_width > lag(bb_width) OVER w AND lag(bb_width) OVER w > lag(bb_width, 2) OVER w, false) AS bb_momentum
        FROM pb WINDOW w AS ({BY_BAR_SQL})""",
)
def w09(spark, sf):
    b = rolling.rising_twice(rolling.bollinger_partial(bars(spark, sf)), "bb_width", "bb_momentum")
    return b.select("ticker", "bar_ix", r("bb_mid"), r("bb_std"), r("bb_width"), F.when(F.col("bb_std") > 0, r("bb_pct", 5)).alias("bb_pct"), "touch_lower", "touch_upper", "bb_momentum")


@query(
    "w11_linear_channel",
    f"""WITH {BARS_SQL}, l0 AS (
        SELECT *, count(*) OVER r20 AS n, regr_slope(close, bar_ix) OVER r20 AS slope, regr_sxx(close, bar_ix) OVER r20 AS sxx, regr_syy(close, bar_ix) OVER r20 AS syy,
               avg(close) OVER r20 AS my, avg(bar_ix) OVER r20 AS mx FROM bars WINDOW {_W}
    ), l AS (SELECT *, greatest(syy - slope * slope * sxx, 0.0) AS ssr FROM l0)
    SELECT ticker, bar_ix, round(slope, 6) AS lr_slope, round(1 - ssr / greatest(syy, 1e-10), 5) AS lr_r2, round(my + slope * (bar_ix - mx), 5) AS lr_mid, round(sqrt(ssr / (n - 2)), 4) AS lr_std
    FROM l WHERE n = 20""",
)
def w11(spark, sf):
    b = rolling.linear_channel(bars(spark, sf)).filter("bar_ix >= 19")
    return b.select("ticker", "bar_ix", r("lr_slope"), r("lr_r2", 5), r("lr_mid", 5), r("lr_std", 4))


_TR_SQL = f"""{BARS_SQL}, tr AS (
    SELECT *, CASE WHEN lag(close) OVER w IS NULL THEN 0.0 ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM bars WINDOW w AS ({BY_BAR_SQL})
)"""


@query(
    "w12_w13_true_range_atr",
    f"""WITH {_TR_SQL} SELECT ticker, bar_ix, round(tr, 6) AS tr, round(CASE WHEN bar_ix >= 14 THEN avg(tr) OVER r14 WHEN bar_ix > 1 THEN sum(tr) OVER w / bar_ix ELSE 0.0 END, 6) AS atr_sma
        FROM tr WINDOW w AS ({BY_BAR_SQL}), r14 AS ({BY_BAR_SQL} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
)
def w12(spark, sf):
    return rolling.atr_sma(bars(spark, sf)).select("ticker", "bar_ix", r("tr"), r("atr_sma"))


_ATR_SQL = f"""{_TR_SQL}, atr0 AS (
    SELECT ticker, bar_ix, tr, close, CASE WHEN bar_ix >= 14 THEN list_reduce((list(tr) OVER w)[16:], lambda a, x: a + CAST(2.0 / 15 AS DOUBLE) * (x - a), list_sum((list(tr) OVER w)[2:15]) / 14) END AS atr
    FROM tr WINDOW w AS ({BY_BAR_SQL})
), atr1 AS (
    SELECT *, list(atr) FILTER (atr IS NOT NULL) OVER past AS earlier, lag(atr) OVER w AS a1, lag(atr, 2) OVER w AS a2, lag(atr, 3) OVER w AS a3
    FROM atr0 WINDOW w AS ({BY_BAR_SQL}), past AS ({BY_BAR_SQL} ROWS BETWEEN 499 PRECEDING AND 1 PRECEDING)
), atr AS (
    SELECT *, CASE WHEN len(earlier) >= 20 THEN len(list_filter(earlier, lambda x: x < atr)) / len(earlier) ELSE 0.5 END AS atr_pct FROM atr1
)"""


@query(
    "w14_ema_atr",
    f"""WITH {_ATR_SQL} SELECT ticker, bar_ix, round(atr, 6) AS atr, round(atr_pct, 6) AS atr_pct, coalesce(atr > a1 AND a1 > a2 AND a2 > a3, false) AS atr_rising,
        coalesce(atr < a1 AND a1 < a2 AND a2 < a3, false) AS atr_falling, atr_pct < 0.3 AS low_vol, atr_pct > 0.7 AS high_vol FROM atr""",
)
def w14(spark, sf):
    return recursive.ema_atr(bars(spark, sf)).select("ticker", "bar_ix", r("atr"), r("atr_pct"), "atr_rising", "atr_falling", "low_vol", "high_vol")


ADR_SQL = f"""{BARS_SQL}, days AS (SELECT ticker, session_id, max(high) - min(low) AS rng FROM bars GROUP BY 1, 2),
past AS (SELECT ticker, session_id, list(rng) OVER (PARTITION BY ticker ORDER BY session_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS rs FROM days),
adr0 AS (
    SELECT b.*, rs, coalesce(len(rs), 0) >= 3 AS ok, max(high) OVER s - min(low) OVER s AS now FROM bars b JOIN past USING (ticker, session_id) WINDOW s AS (PARTITION BY ticker, session_id ORDER BY bar_ix)
), adr AS (
    SELECT *, CASE WHEN ok THEN list_sum(rs) / len(rs) ELSE 0.0 END AS adr, CASE WHEN ok THEN now ELSE 0.0 END AS current_range, CASE WHEN ok THEN len(list_filter(rs, lambda x: x < now)) / len(rs) END AS pct FROM adr0
)"""


@query(
    "w15_average_daily_range",
    f"""WITH {ADR_SQL} SELECT ticker, bar_ix, round(adr, 6) AS adr, round(current_range, 6) AS current_range, round(CASE WHEN ok THEN current_range / greatest(adr, 1e-10) ELSE 1.0 END, 6) AS range_ratio,
        round(pct, 6) AS adr_percentile, coalesce(pct < 0.3, false) AS low_range, coalesce(pct > 0.7, false) AS high_range, ok AND current_range > adr AS above_adr FROM adr""",
)
def w15(spark, sf):
    return rolling.adr(bars(spark, sf)).select("ticker", "bar_ix", r("adr"), r("current_range"), r("range_ratio"), r("adr_percentile"), "low_range", "high_range", "above_adr")


@query(
    "w16_volatility_regime",
    f"""WITH {ADR_SQL}, {_ATR_SQL.split(BARS_SQL + ", ")[1]}
        SELECT ticker, bar_ix, CASE WHEN coalesce(pct < 0.3, false) AND atr_pct < 0.3 THEN 'compression' WHEN coalesce(pct > 0.7, false) AND atr_pct > 0.7 THEN 'expansion' ELSE 'neutral' END AS regime
        FROM adr JOIN atr USING (ticker, bar_ix)""",
)
def w16(spark, sf):
    b = bars(spark, sf)
    both = rolling.adr(b).join(recursive.ema_atr(b).select("ticker", "bar_ix", "low_vol", "high_vol"), ["ticker", "bar_ix"])
    return both.select("ticker", "bar_ix", rolling.volatility_regime(F.col("low_range"), F.col("high_range"), F.col("low_vol"), F.col("high_vol")).alias("regime"))


VWAP_SQL = f"""{BARS_SQL}, v0 AS (
    SELECT *, (high + low + close) / 3.0 AS typ FROM bars
), v1 AS (
    SELECT *, row_number() OVER s AS k, sum(typ * volume) OVER s / greatest(sum(volume) OVER s, 1e-10) AS vwap, sum(typ * typ * volume) OVER s / greatest(sum(volume) OVER s, 1e-10) AS m2
    FROM v0 WINDOW s AS (PARTITION BY ticker, session_id ORDER BY bar_ix)
), v AS (
    SELECT *, sqrt(greatest(m2 - vwap * vwap, 0.0)) AS sigma, lag(close) OVER s AS c1, lag(close, 2) OVER s AS c2, lag(vwap) OVER s AS v1, lag(vwap, 2) OVER s AS v2
    FROM v1 WINDOW s AS (PARTITION BY ticker, session_id ORDER BY bar_ix)
)"""


@query(
    "w17_session_vwap",
    f"""WITH {VWAP_SQL} SELECT ticker, bar_ix, round(vwap, 6) AS vwap, CASE WHEN sigma > 1e-3 THEN round(sigma, 3) END AS vwap_sigma, CASE WHEN k > 1 AND sigma > 1e-3 THEN round(vwap + 2 * sigma, 3) END AS vwap_upper,
        CASE WHEN sigma > 1e-3 THEN coalesce(c1 <= v1 AND CASE WHEN k >= 3 THEN c2 > v2 ELSE k = 2 END AND close > vwap, false)::INT::DOUBLE END AS crossed_up,
        CASE WHEN sigma > 1e-3 THEN coalesce(c1 >= v1 AND CASE WHEN k >= 3 THEN c2 < v2 ELSE k = 2 END AND close < vwap, false)::INT::DOUBLE END AS crossed_down FROM v""",
)
def w17(spark, sf):
    b = rolling.vwap(bars(spark, sf)).withColumn("at", F.row_number().over(rolling.session(False)))
    # Where prices hardly differ, the deviation is rounding, and what rests on it unknown.
    spread = lambda c, name: F.when(F.col("vwap_sigma") > 1e-3, c).alias(name)
    upper = F.when(F.col("at") > 1, r("vwap_upper", 3))
    return b.select("ticker", "bar_ix", r("vwap"), spread(r("vwap_sigma", 3), "vwap_sigma"), spread(upper, "vwap_upper"), *[spread(F.col(c).cast("double"), c) for c in ("crossed_up", "crossed_down")])


@query(
    "w18_anchored_vwap",
    f"""WITH {VWAP_SQL} SELECT ticker, bar_ix, round(sum(typ * volume) OVER w / greatest(sum(volume) OVER w, 1e-10), 6) AS anchored_vwap FROM v WHERE bar_ix >= 10 WINDOW w AS ({BY_BAR_SQL})""",
)
def w18(spark, sf):
    return rolling.anchored_vwap(bars(spark, sf), 10).filter("bar_ix >= 10").select("ticker", "bar_ix", r("anchored_vwap"))


RSI_SQL = f"""{BARS_SQL}, rs0 AS (
    SELECT ticker, session_id, bar_ix, row_number() OVER s AS k, list(close) OVER s AS cs FROM bars WINDOW s AS (PARTITION BY ticker, session_id ORDER BY bar_ix)
), rs1 AS (
    SELECT *, list_transform(range(2, len(cs) + 1), lambda i: greatest(cs[i] - cs[i - 1], 0.0)) AS g, list_transform(range(2, len(cs) + 1), lambda i: greatest(cs[i - 1] - cs[i], 0.0)) AS l FROM rs0
), rs AS (
    SELECT *, CASE WHEN k > 5 THEN list_reduce(g[6:], lambda a, x: (a * 4 + x) / 5, list_sum(g[1:5]) / 5) END AS ag,
           CASE WHEN k > 5 THEN list_reduce(l[6:], lambda a, x: (a * 4 + x) / 5, list_sum(l[1:5]) / 5) END AS al FROM rs1
)"""


@query("w19_wilder_rsi", f"WITH {RSI_SQL} SELECT ticker, bar_ix, round(100 - 100 / (1 + ag / greatest(al, 1e-10)), 6) AS rsi FROM rs")
def w19(spark, sf):
    """Period 5: the sessions have nine bars."""
    return recursive.wilder_rsi(bars(spark, sf), 5).select("ticker", "bar_ix", r("rsi"))


@query(
    "w20_rsi_simple",
    f"""WITH {BARS_SQL}, d AS (SELECT *, close - lag(close) OVER w AS d FROM bars WINDOW w AS ({BY_BAR_SQL})),
        m AS (SELECT *, avg(greatest(d, 0.0)) OVER r14 AS g, avg(greatest(-d, 0.0)) OVER r14 AS l FROM d WINDOW r14 AS ({BY_BAR_SQL} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
        SELECT ticker, bar_ix, round(CASE WHEN bar_ix < 14 THEN 50.0 WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi14 FROM m""",
)
def w20(spark, sf):
    return rolling.rsi_simple(bars(spark, sf)).select("ticker", "bar_ix", r("rsi14"))


@query(
    "w21_on_balance_volume",
    f"""WITH {BARS_SQL}, d AS (SELECT *, coalesce(sign(close - lag(close) OVER w), 1) * volume AS sv FROM bars WINDOW w AS ({BY_BAR_SQL})),
        o AS (SELECT *, sum(sv) OVER w AS obv FROM d WINDOW w AS ({BY_BAR_SQL}))
        SELECT ticker, bar_ix, obv, round(CASE WHEN count(*) OVER r5 = 5 THEN regr_slope(obv, bar_ix) OVER r5 ELSE 0.0 END, 6) + 0.0 AS obv_slope FROM o WINDOW r5 AS ({BY_BAR_SQL} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def w21(spark, sf):
    return rolling.obv(bars(spark, sf)).select("ticker", "bar_ix", "obv", r("obv_slope"))


@query(
    "w22_money_flow_index",
    f"""WITH {BARS_SQL}, t AS (SELECT *, (high + low + close) / 3.0 AS typ FROM bars),
        f AS (SELECT *, row_number() OVER s AS k, coalesce(typ > lag(typ) OVER s, false) AS up FROM t WINDOW s AS (PARTITION BY ticker, session_id ORDER BY bar_ix)),
        m AS (SELECT *, sum(CASE WHEN up THEN typ * volume ELSE 0 END) OVER q AS pos, sum(CASE WHEN up THEN 0 ELSE typ * volume END) OVER q AS neg FROM f
              WINDOW q AS (PARTITION BY ticker, session_id ORDER BY bar_ix ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
        SELECT ticker, bar_ix, round(CASE WHEN k > 5 THEN 100 - 100 / (1 + pos / greatest(neg, 1e-10)) END, 6) AS mfi FROM m""",
)
def w22(spark, sf):
    """Period 5: the sessions have nine bars."""
    return rolling.mfi(bars(spark, sf), 5).select("ticker", "bar_ix", r("mfi"))


@query(
    "w23_awesome_oscillator",
    f"""WITH {BARS_SQL}, m AS (SELECT *, (high + low) / 2 AS mid FROM bars)
        SELECT ticker, bar_ix, round(CASE WHEN count(*) OVER r34 = 34 THEN avg(mid) OVER r5 - avg(mid) OVER r34 ELSE 0.0 END, 6) AS ao FROM m
        WINDOW r5 AS ({BY_BAR_SQL} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), r34 AS ({BY_BAR_SQL} ROWS BETWEEN 33 PRECEDING AND CURRENT ROW)""",
)
def w23(spark, sf):
    return rolling.awesome(bars(spark, sf)).select("ticker", "bar_ix", r("ao"))


@query(
    "w07_expanding_median_daily",
    """WITH d0 AS (SELECT l_returnflag AS ticker, l_shipdate AS ts, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS close FROM lineitem GROUP BY 1, 2),
        d AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS bar_ix FROM d0)
        SELECT ticker, bar_ix, round(CASE WHEN bar_ix <= 10 THEN 0.001 ELSE quantile_cont(close, 0.5) OVER (PARTITION BY ticker ORDER BY bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, 9) AS gate FROM d""",
)
def w07(spark, sf):
    """The fast form: a few thousand daily bars per ticker."""
    b = numbered(daily_bars(table(spark, sf, "lineitem")))
    found = expanding.expanding_quantiles_fast(b, "close", [0.5], ["median"], ix="bar_ix")
    return found.select("ticker", "bar_ix", r(F.when(F.col("bar_ix") <= 10, F.lit(0.001)).otherwise(F.col("median")), 9).alias("gate"))


@query(
    "w31_equity_and_peak",
    f"""WITH {BARS_SQL}, x AS (SELECT *, coalesce(close / lag(close) OVER w - 1, 0.0) AS ret FROM bars WINDOW w AS ({BY_BAR_SQL})),
        e AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS equity FROM x WINDOW w AS ({BY_BAR_SQL}))
        SELECT ticker, bar_ix, round(equity, 6) AS equity, round(max(equity) OVER w, 6) AS peak FROM e WINDOW w AS ({BY_BAR_SQL})""",
)
def w31(spark, sf):
    from barloom.sources.bars import by_bar, upto

    b = bars(spark, sf).withColumn("ret", F.coalesce(F.col("close") / F.lag("close").over(by_bar()) - 1, F.lit(0.0)))
    b = b.withColumn("equity", rolling.equity(F.col("ret"), upto())).withColumn("peak", F.max("equity").over(upto()))
    return b.select("ticker", "bar_ix", r("equity"), r("peak"))


@query(
    "w33_window_zscore",
    f"""WITH {BARS_SQL}, z AS (SELECT ticker, bar_ix, avg(close) OVER q AS mu, stddev_pop(close) OVER q AS sd, list(close) OVER q AS raw FROM bars WINDOW q AS ({BY_BAR_SQL} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
        SELECT ticker, bar_ix, unnest(list_transform(raw, lambda x: CASE WHEN sd > 1e-3 THEN round(greatest(-5.0, least(5.0, (x - mu) / (sd + 1e-5))), 5) END)) AS z, generate_subscripts(raw, 1) - 1 AS step FROM z""",
)
def w33(spark, sf):
    b = rolling.window_zscore(bars(spark, sf), "close", 12)
    return b.select("ticker", "bar_ix", "sd", F.posexplode("scaled").alias("step", "x")).select("ticker", "bar_ix", F.col("step").cast("long").alias("step"), F.when(F.col("sd") > 1e-3, r("x", 5)).alias("z"))


@query(
    "w34_calendar",
    f"""WITH {BARS_SQL} SELECT ticker, bar_ix, minute(ts)::INT AS minute, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday, day(ts)::INT AS day, month(ts)::INT AS month FROM bars""",
)
def w34(spark, sf):
    return rolling.calendar(bars(spark, sf)).select("ticker", "bar_ix", "minute", "hour", "weekday", "day", "month")
