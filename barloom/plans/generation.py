"""Queries that draw codes and generate paths step by step (survey K2, K3, K7, K8, K10, G2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import generate, inference, sweep
from barloom.plans.base import BARS_SQL, BY_BAR_SQL, bars, r
from barloom.plans.registry import query, table
from barloom.plans.trading import LK, PL, S

T, TOP_P, TOP_K, SEED = 0.8, 0.9, 3, 42


def uniform_sql(*keys: str) -> str:
    return f"('0x' || md5(concat_ws(':', {', '.join(keys)}))[1:13])::BIGINT / {16**13}::DOUBLE"


def ranked_sql(weights: str) -> str:
    """A sorted list of (n, c), negative weights and codes; not of sum 1."""
    return f"list_sort({weights})"


def kept_sql(name: str, source: str, dist: str) -> str:
    """CTEs that add ``kept`` to ``source``: the tempered nucleus of its list ``dist`` of (n: -weight, c: code)."""
    return f"""{name}_p AS (SELECT *, list_transform({dist}, lambda x: -x.n / list_sum(list_transform({dist}, lambda y: -y.n))) AS probs FROM {source}),
    {name}_t AS (SELECT *, list_transform(probs, lambda x: x ** (1.0::DOUBLE / {T}::DOUBLE)) AS tp FROM {name}_p),
    {name}_q AS (SELECT *, list_transform(tp, lambda x: x / list_sum(tp)) AS qs FROM {name}_t)"""


def picked_sql(dist: str, u: str) -> str:
    """The drawn code: ``qs`` are the tempered shares in the order of ``dist``, cut where the mass before exceeds the nucleus."""
    kept = f"list_filter(range(1, len(qs) + 1), lambda i: i = 1 OR list_sum(qs[1:i - 1]) <= {TOP_P}::DOUBLE)"
    return f"{dist}[coalesce(list_filter({kept}, lambda i: list_sum(qs[1:i]) > {u} * list_sum(qs[1:len({kept})]))[1], len({kept}))].c"


_STREAMS_SQL = "c AS (SELECT event_type AS stream, (user_id % 16)::INT AS code, count(*) AS n FROM events GROUP BY 1, 2), d AS (SELECT stream, list_sort(list({'n': -n::DOUBLE, 'c': code})) AS dist FROM c GROUP BY 1)"


@query(
    "k07_draw",
    f"""WITH {_STREAMS_SQL}, {kept_sql("a", "d", "dist")}, {kept_sql("z", "(SELECT stream, list_filter(dist, lambda x: x.n <= dist[" + str(TOP_K) + "].n) AS few FROM d)", "few").replace("(1.0::DOUBLE / 0.8::DOUBLE)", "1.0")},
        e AS (SELECT event_id, event_type AS stream, {uniform_sql("event_type", "event_id::VARCHAR", f"'{SEED}'")} AS u FROM events)
        SELECT e.event_id, e.stream, {picked_sql("a_q.dist", "u").replace("qs", "a_q.qs")} AS code,
               few[coalesce(list_filter(range(1, len(few) + 1), lambda i: list_sum(z_q.qs[1:i]) > u * list_sum(z_q.qs))[1], len(few))].c AS top_k_code, dist[1].c AS most_probable
        FROM e JOIN a_q USING (stream) JOIN z_q USING (stream)""",
)
def k07_draw(spark, sf):
    """A code for each event from its stream's distribution: a tempered nucleus, the top three, and the most probable."""
    e = table(spark, sf, "events")
    counts = e.groupBy(F.col("event_type").alias("stream"), (F.col("user_id") % 16).cast("int").alias("code")).agg(F.count("*").cast("double").alias("prob"))
    streams = counts.groupBy("stream").agg(generate.ranked(F.collect_list(F.struct("code", "prob"))).alias("dist"))
    u = generate.uniform("stream", F.col("event_id").cast("string"), F.lit(str(SEED)))
    rows = e.select("event_id", F.col("event_type").alias("stream")).join(streams, "stream").withColumn("u", u)
    d = F.col("dist")
    return rows.select(
        "event_id",
        "stream",
        generate.draw(d, F.col("u"), T, 0, TOP_P).alias("code"),
        generate.draw(d, F.col("u"), 1.0, TOP_K).alias("top_k_code"),
        generate.draw(d, F.col("u"), sample=False).alias("most_probable"),
    )


_CODES_SQL = f"""rc AS (SELECT ticker, bar_ix, close, coalesce(close / greatest(lag(close) OVER w, 1e-10) - 1, 0.0) AS ret FROM bars WINDOW w AS ({BY_BAR_SQL})),
rk AS (SELECT *, greatest(-5, least(5, floor(ret / 0.02::DOUBLE)))::INT AS code, greatest(-20, least(20, floor(ret / 0.005::DOUBLE)))::INT AS fine FROM rc),
ctx AS (SELECT ticker, bar_ix, close, list(code) OVER q AS cs, list(fine) OVER q AS fs FROM rk WINDOW q AS ({BY_BAR_SQL} ROWS BETWEEN {LK - 1} PRECEDING AND CURRENT ROW))"""

_DRAWN = lambda more: uniform_sql("ticker", "bar_ix::VARCHAR", "s::VARCHAR", f"({SEED + more} + 1000 * h)::VARCHAR")
_NEXT_SQL = "list_sort(list_transform(list_distinct(cs), lambda c: {'n': -(len(list_filter(cs, lambda x: x = c)) + 4.0::DOUBLE * len(list_filter(range(1, len(cs)), lambda i: cs[i] = cs[len(cs)] AND cs[i + 1] = c))), 'c': c}))"
_FINE_SQL = "list_sort(list_transform(list_distinct(own), lambda c: {'n': -len(list_filter(own, lambda x: x = c))::DOUBLE, 'c': c}))"

GENERATED_SQL = f"""{BARS_SQL}, {_CODES_SQL},
start AS (SELECT ticker, bar_ix, s::INT AS s, 0 AS h, cs, fs, close, 0 AS code, 0 AS fine, 0.0::DOUBLE AS confidence, 0.0::DOUBLE AS entropy_s1, 0.0::DOUBLE AS top3_mass, 0.0::DOUBLE AS entropy_ratio
          FROM ctx, range({S}) a(s) WHERE len(cs) = {LK}),
gen AS (
    SELECT * FROM start
    UNION ALL
    (WITH n0 AS (SELECT ticker, bar_ix, s, h, cs, fs, close, {_NEXT_SQL} AS dist FROM gen WHERE h < {PL}),
    {kept_sql("a", "n0", "dist")},
    n1 AS (SELECT * EXCLUDE (tp, qs), {picked_sql("dist", _DRAWN(0))} AS code FROM a_q),
    n2 AS (SELECT * EXCLUDE (probs), probs AS p1, list_filter(list_transform(range(1, len(cs) + 1), lambda i: CASE WHEN cs[i] = code THEN fs[i] END), lambda x: x IS NOT NULL) AS own FROM n1),
    n3 AS (SELECT *, {_FINE_SQL} AS fd FROM n2),
    {kept_sql("b", "n3", "fd")},
    n4 AS (SELECT *, {picked_sql("fd", _DRAWN(1))} AS fine, -list_sum(list_transform(p1, lambda x: x * log2(x))) AS e1, -list_sum(list_transform(probs, lambda x: x * log2(x))) AS e2 FROM b_q)
    SELECT ticker, bar_ix, s, h + 1, list_append(cs, code)[2:], list_append(fs, fine)[2:], close * (1.0 + (fine + 0.5) * 0.005::DOUBLE), code, fine, p1[1], e1, list_sum(p1[1:3]), e2 / (e1 + 1e-8) FROM n4)
)"""


def generated(spark, sf):
    contexts = generate.code_contexts(bars(spark, sf).select("ticker", "bar_ix", "close"), LK)
    return generate.generate(contexts, PL, S, LK, SEED, T, 0, TOP_P)


@query(
    "k08_stepwise",
    f"""WITH RECURSIVE {GENERATED_SQL} SELECT ticker, bar_ix, s, (h - 1)::INT AS h, code, fine, round(close, 6) AS close, round(confidence, 6) AS confidence, round(entropy_s1, 6) + 0.0 AS entropy_s1, round(top3_mass, 6) AS top3_mass, round(entropy_ratio, 5) + 0.0 AS entropy_ratio FROM gen WHERE h > 0""",
)
def k08_stepwise(spark, sf):
    """Five paths of six steps from every bar, drawn step by step, with the beliefs of each step."""
    each = generated(spark, sf).select("ticker", "bar_ix", F.posexplode("generated").alias("s", "path")).select("ticker", "bar_ix", "s", F.explode("path").alias("x"))
    return each.select("ticker", "bar_ix", "s", "x.h", "x.code", "x.fine", r(F.col("x.close")).alias("close"), *[r(F.col(f"x.{c}"), 5 if c == "entropy_ratio" else 6).alias(c) for c in ("confidence", "entropy_s1", "top3_mass", "entropy_ratio")])


@query(
    "k08_mean_paths",
    f"WITH RECURSIVE {GENERATED_SQL} SELECT ticker, bar_ix, (h - 1)::INT AS h, round(avg(close), 6) AS close FROM gen WHERE h > 0 GROUP BY ALL",
)
def k08_mean_paths(spark, sf):
    """The same paths averaged over the samples."""
    return generated(spark, sf).select("ticker", "bar_ix", F.posexplode(generate.mean_path(F.col("generated"))).alias("h", "c")).select("ticker", "bar_ix", "h", r(F.col("c")).alias("close"))


@query(
    "k02_k03_bit_codes",
    f"""WITH {BARS_SQL}, d AS (SELECT ticker, bar_ix, close - lag(close) OVER w AS d FROM bars WINDOW w AS ({BY_BAR_SQL})), l AS (SELECT ticker, bar_ix, list(coalesce(d, 0.0)) OVER ({BY_BAR_SQL} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS z FROM d),
        i AS (SELECT ticker, bar_ix, z, list_sum(list_transform(range(10), lambda k: CASE WHEN z[k + 1] > 0 THEN 1 << k ELSE 0 END))::INT AS s1, list_sum(list_transform(range(10), lambda k: CASE WHEN z[k + 11] > 0 THEN 1 << k ELSE 0 END))::INT AS s2 FROM l WHERE len(z) = 20)
        SELECT ticker, bar_ix, s1, s2, unnest(range(20))::INT AS place, unnest(list_transform(z, lambda x: round(CASE WHEN x > 0 THEN 1 ELSE -1 END / sqrt(20), 6))) AS feature FROM i""",
)
def k02_k03(spark, sf):
    """The signs of the last twenty moves as two ids of ten bits, and features from the ids."""
    from barloom.sources.bars import by_bar, roll

    move = F.coalesce(F.col("close") - F.lag("close").over(by_bar()), F.lit(0.0))
    z = bars(spark, sf).withColumn("d", move).select("ticker", "bar_ix", F.collect_list("d").over(roll(20)).alias("z")).filter("size(z) = 20")
    ids = z.select("ticker", "bar_ix", generate.bits_to_ids(F.col("z")).alias("i")).select("ticker", "bar_ix", "i.*")
    return ids.select("*", F.posexplode(generate.ids_to_bits(F.col("s1"), F.col("s2"))).alias("place", "x")).select("ticker", "bar_ix", "s1", "s2", "place", r("x").alias("feature"))


_FREQUENCY_SQL = f"""gaps AS (SELECT ticker, date_diff('minute', lag(ts) OVER w, ts) AS gap FROM bars WINDOW w AS ({BY_BAR_SQL})),
fq AS (SELECT ticker, gap AS minutes FROM (SELECT ticker, gap, count(*) AS n FROM gaps WHERE gap > 0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC, gap) = 1)"""

_NEXT_SLOTS_SQL = """slots AS (
    SELECT ticker, ts, minutes, list_filter(generate_series(ts + to_minutes(minutes), ts + INTERVAL 14 day, to_minutes(minutes)), lambda t: isodow(t) < 6 AND hour(t) * 60 + minute(t) BETWEEN 600 AND 1120)[1:6] AS f FROM ends JOIN fq USING (ticker)
), fut AS (SELECT ticker, ts, minutes, unnest(range(6))::INT AS h, unnest(f) AS future FROM slots)"""


@query(
    "k10_future_bars",
    f"""WITH {BARS_SQL}, {_FREQUENCY_SQL}, ends AS (SELECT * FROM bars QUALIFY lead(session_id) OVER ({BY_BAR_SQL}) IS DISTINCT FROM session_id), {_NEXT_SLOTS_SQL}
        SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, minutes::INT AS minutes, h, strftime(future, '%Y-%m-%d %H:%M:%S') AS future FROM fut""",
)
def k10_future(spark, sf):
    """The times of the six bars after each session, by the ticker's commonest gap."""
    b = bars(spark, sf)
    ends = inference.last_of_session(b).join(inference.frequency(b), "ticker")
    found = ends.withColumn("future", inference.future_times(F.col("ts"), F.col("minutes"), 6))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.select("ticker", text("ts").alias("ts"), "minutes", F.posexplode("future").alias("h", "f")).select("ticker", "ts", "minutes", "h", text("f").alias("future"))


_SCALED_FIELDS = ("open", "high", "low", "close", "volume", "amount")
_SCALE_SQL = ", ".join(f"avg({c}) OVER q AS mu_{c}, stddev_pop({c}) OVER q AS sd_{c}" for c in _SCALED_FIELDS)


@query(
    "k10_scaled_inputs",
    f"""WITH {BARS_SQL}, f AS (SELECT * EXCLUDE (amount), volume * (open + high + low + close) / 4 AS amount FROM bars), z AS (SELECT *, {_SCALE_SQL}, count(*) OVER q AS n FROM f WINDOW q AS ({BY_BAR_SQL} ROWS BETWEEN {LK - 1} PRECEDING AND CURRENT ROW)),
        u AS (SELECT ticker, bar_ix, unnest([{", ".join(f"{{'field': '{c}', 'x': {c}, 'mu': mu_{c}, 'sd': sd_{c}}}" for c in _SCALED_FIELDS)}]) AS v FROM z WHERE n = {LK})
        SELECT ticker, bar_ix, v.field AS field, round(greatest(-5.0, least(5.0, (v.x - v.mu) / (v.sd + 1e-5))), 4) + 0.0 AS z,
               CASE WHEN abs((v.x - v.mu) / (v.sd + 1e-5)) <= 5 THEN true ELSE abs((v.x - v.mu) / (v.sd + 1e-5)) <= 5 + 1e-9 END AS same FROM u""",
)
def k10_scaled(spark, sf):
    """The inputs of a forecast: amounts filled in, all six fields scaled by their window, and whether scaling back gives the value (it does unless it was clipped)."""
    b = inference.completed(bars(spark, sf).drop("amount"))
    s = inference.scaling(b, LK)
    each = s.select("ticker", "bar_ix", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("x"), F.col("scale")[c].alias("s")) for c in _SCALED_FIELDS])).alias("v"))
    z = inference.scaled(F.col("v.x"), F.col("v.s"))
    back = inference.unscaled(z, F.col("v.s"))
    return each.select("ticker", "bar_ix", "v.field", r(z, 4).alias("z"), (F.abs(back - F.col("v.x")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col("v.x")))).alias("same"))


@query("g02_two_pass")
def g02_two_pass(spark, sf):
    """The forecast's length, then temperature, nucleus and samples for each ticker's best length, on 20 windows a ticker (a sampling operator)."""
    found = sweep.two_pass(bars(spark, sf), LK, [3, 6], [0.6, 1.0, 1.4], [0.7, 0.9], [3, 5], n_windows=20, seed=SEED)
    return found.select("pass", "ticker", "pred_len", "temperature", "top_p", "samples", "n", r("consensus_dir_acc"), r("expectancy", 8), r("direction_accuracy"), r("consensus_rate"), "is_best")
