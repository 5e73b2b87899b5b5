"""Features, windows, statistics and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowpanel import schemas
from flowpanel.catalog.inputs import Inputs
from flowpanel.catalog.registry import query, r, rs
from flowpanel.functions import hurdle
from flowpanel.operators import access, behaviour, dtw, features, generative, stats, windows
from flowpanel.schemas import C_IN, C_OUT, ROLLING_ROWS, SCALED_WEATHER, TEMP_LAG_ROWS, USAGE_LAG_ROWS

_STATS = [f"{c}_{s}" for c in ["log", *SCALED_WEATHER] for s in ("mean", "std")]


def _flat(df, x=("usage",)):
    """Windows as one row per step, so that every element is compared."""
    if len(x) == 1:
        target = [F.col("x").alias("_x0")]
    else:
        target = [F.element_at("x", k + 1).alias(f"_x{k}") for k in range(len(x))]
    rows = [F.element_at("c_in", k + 1).alias(f"_i{k}") for k in range(len(C_IN))]
    outs = [F.element_at("c_out", k + 1).alias(f"_o{k}") for k in range(len(C_OUT))]
    picked = df.select("series_id", "window_idx", "window_start", *target, *rows, *outs)
    names = [f"_x{k}" for k in range(len(x))] + [f"_i{k}" for k in range(len(C_IN))] + [f"_o{k}" for k in range(len(C_OUT))]
    exploded = picked.select("series_id", "window_idx", "window_start", F.posexplode(F.arrays_zip(*names)).alias("interval", "z"))
    final = [*x, *C_IN, *C_OUT]
    return exploded.select(
        "series_id", "window_idx", "window_start", "interval", *[F.col(f"z.{n}").alias(c) for n, c in zip(names, final)]
    )


def _lag_sql(source: str, lags: dict[str, int]) -> str:
    lagged = ", ".join(f"lag({source}, {k}) OVER w AS {c}" for c, k in lags.items())
    return (f"SELECT series_id, date_time, {rs(*lags)} FROM (SELECT series_id, date_time, {lagged} FROM fx_panel "
            "WINDOW w AS (PARTITION BY series_id ORDER BY date_time))")


@query("lag_temp", _lag_sql("temp_c", TEMP_LAG_ROWS))
def lag_temp(i: Inputs):
    lagged = features.lag_temp(i.panel().select("series_id", "date_time", "temp_c"), i.hot())
    return lagged.select("series_id", "date_time", *TEMP_LAG_ROWS)


@query("lag_usage", _lag_sql("usage", USAGE_LAG_ROWS))
def lag_usage(i: Inputs):
    lagged = features.lag_usage(i.panel().select("series_id", "date_time", "usage"), i.hot())
    return lagged.select("series_id", "date_time", *USAGE_LAG_ROWS)


def _rolling_sql(table: str) -> str:
    gdd = "CASE WHEN temp_c IS NOT NULL THEN greatest(temp_c - 10, 0) END"
    values = {"precip_3d": "precip_mm", "snow_24h": "snow_cm", "gdd_7d": gdd}
    sums = ", ".join(
        f"CASE WHEN count({values[c]}) OVER r{k} = count(*) OVER r{k} THEN sum({values[c]}) OVER r{k} END AS {c}"
        for c, k in ROLLING_ROWS.items()
    )
    frames = ", ".join(
        f"r{k} AS (PARTITION BY series_id ORDER BY date_time ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        for k in ROLLING_ROWS.values()
    )
    return f"SELECT series_id, date_time, {rs(*ROLLING_ROWS)} FROM (SELECT series_id, date_time, {sums} FROM {table} WINDOW {frames})"


def _time_lag_sql(source: str, lags: dict[str, int]) -> str:
    joins = " ".join(
        f"LEFT JOIN fx_panel l{k} ON l{k}.series_id = p.series_id AND l{k}.date_time = p.date_time - INTERVAL {15 * k} MINUTE" for k in lags.values())
    return f"SELECT p.series_id, p.date_time, {', '.join(r(f'l{k}.{source}', c) for c, k in lags.items())} FROM fx_panel p {joins}"


@query("lag_temp_by_time", _time_lag_sql("temp_c", TEMP_LAG_ROWS))
def lag_temp_by_time(i: Inputs):
    return features.lag_temp(i.panel(), time_based=True).select("series_id", "date_time", *TEMP_LAG_ROWS)


@query("lag_usage_by_time", _time_lag_sql("usage", USAGE_LAG_ROWS))
def lag_usage_by_time(i: Inputs):
    return features.lag_usage(i.panel(), time_based=True).select("series_id", "date_time", *USAGE_LAG_ROWS)


@query("rolling_sums", _rolling_sql("fx_panel"))
def rolling_sums(i: Inputs):
    rows = i.panel().select("series_id", "date_time", "temp_c", "precip_mm", "snow_cm")
    return features.rolling_sums(rows, hot=i.hot()).select("series_id", "date_time", *ROLLING_ROWS)


@query("build_features", f"SELECT series_id, meter_id, date_time, {rs('usage', *C_IN, *C_OUT)} FROM fx_features")
def build_features(i: Inputs):
    built = features.build_features(access.filter_years(i.panel(True)), hot=i.hot())
    return built.select("series_id", "meter_id", "date_time", "usage", *C_IN, *C_OUT)


_STEP = "series_id, window_idx, window_start, interval"


@query("day_windows", f"SELECT {_STEP}, {rs('usage', *C_IN, *C_OUT)} FROM fx_steps", view=_flat)
def day_windows(i: Inputs):
    return windows.day_windows(i.features(), hot=i.hot())


_FIRST = {**{f"c_in_{k}": c for k, c in enumerate(C_IN)}, **{f"c_out_{k}": c for k, c in enumerate(C_OUT)}}


@query("sliding_windows", f"""
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date_time) - 1 AS pos,
                         lead(date_time, 95) OVER (PARTITION BY series_id ORDER BY date_time) AS last_time,
                         sum(usage) OVER (PARTITION BY series_id ORDER BY date_time ROWS BETWEEN CURRENT ROW AND 95 FOLLOWING) AS total,
                         max(usage) OVER (PARTITION BY series_id ORDER BY date_time ROWS BETWEEN CURRENT ROW AND 95 FOLLOWING) AS peak,
                         sum(temp_c) OVER (PARTITION BY series_id ORDER BY date_time ROWS BETWEEN CURRENT ROW AND 95 FOLLOWING) AS warmth
                  FROM fx_features)
SELECT series_id, pos AS window_idx, date_time AS window_start, {rs("total", "peak", "warmth")}, {r("usage", "x_0")},
  {", ".join(r(c, name) for name, c in _FIRST.items())}
FROM numbered WHERE date_diff('minute', date_time, last_time) = 1425""")
def sliding_windows(i: Inputs):
    """Every window at stride 1 with both matrices: sums over the whole window, the first value of all 23 rows."""
    cut = windows.sliding_windows(i.features(), hot=i.hot())
    total = lambda row: F.aggregate(row, F.lit(0.0), lambda a, v: a + v)
    warm = F.get("c_out", C_OUT.index("temp_c"))
    first = [F.get(F.get(name[:-len(name.split("_")[-1]) - 1], int(name.split("_")[-1])), 0).alias(name) for name in _FIRST]
    return cut.select(
        "series_id", "window_idx", "window_start", total("x").alias("total"), F.array_max("x").alias("peak"), total(warm).alias("warmth"),
        F.get("x", 0).alias("x_0"), *first)


@query("norm_stats", f"SELECT {rs(*_STATS)} FROM fx_stats")
def norm_stats(i: Inputs):
    return stats.norm_stats(i.features())


_NONZERO = ", ".join(
    f"{r(f'coalesce(avg({v}), 0)', f'{c}_mean')}, {r(f'coalesce(stddev_samp({v}), 1)', f'{c}_std')}"
    for c, v in {"log": "ln(usage + 1e0)", **{c: c for c in SCALED_WEATHER}}.items()
)


@query("norm_stats_nonzero", f"SELECT {_NONZERO} FROM fx_features WHERE usage > 0")
def norm_stats_nonzero(i: Inputs):
    return stats.norm_stats(i.features(), "nonzero")


_Z = "(ln(1e0 + greatest({v}, 0)) - log_mean) / (log_std + 1e-6)"


def _z(value: str, masked: bool = True) -> str:
    z = _Z.format(v=value)
    return f"CASE WHEN {value} > 0 THEN {z} ELSE 0e0 END" if masked else z


@query("hurdle_encode", f"""
SELECT {_STEP}, CASE WHEN usage > 0 THEN 1e0 ELSE 0e0 END AS mask, {r(_z('usage'), 'z')} FROM fx_steps, fx_stats""")
def hurdle_encode(i: Inputs):
    x = hurdle.encode_window(F.col("x"), i.stats())
    both = i.windows().select("series_id", "window_idx", "window_start", x.alias("x"))
    pairs = F.arrays_zip(F.col("x")[0].alias("mask"), F.col("x")[1].alias("z"))
    return both.select("series_id", "window_idx", "window_start", F.posexplode(pairs).alias("interval", "p")).select(
        "series_id", "window_idx", "window_start", "interval", "p.mask", "p.z"
    )


_DECODED = f"greatest(exp(least(greatest(({_Z.format(v='usage')}) * log_std + log_mean, -10), 10)) - 1, 0)"


@query("hurdle_decode", f"""
SELECT {_STEP}, {r(f'CASE WHEN usage > 0 THEN {_DECODED} ELSE 0 END', 'decoded')} FROM fx_steps, fx_stats""")
def hurdle_decode(i: Inputs):
    """Encode and decode: the round trip gives the usage back to about 1e-6 relative."""
    decoded = hurdle.decode_window(F.col("x"), i.stats(), hurdle.GATE_REAL)
    return i.encoded().select("series_id", "window_idx", "window_start", F.posexplode(decoded).alias("interval", "decoded"))


def _scaled_lags(i: Inputs, masked: bool):
    scaled = i.windows().withColumn("c_in", hurdle.scale_indoor(F.col("c_in"), i.stats(), masked))
    return _flat(scaled).select("series_id", "window_idx", "window_start", "interval", *C_IN)


def _lags_sql(masked: bool) -> str:
    lags = ", ".join(r(_z(f"s.{c}", masked), c) for c in schemas.USAGE_LAGS)
    return f"SELECT {_STEP}, {rs(*schemas.CALENDAR)}, {lags} FROM fx_steps s, fx_stats"


@query("normalize_lags", _lags_sql(True))
def normalize_lags(i: Inputs):
    return _scaled_lags(i, True)


@query("normalize_lags_unmasked", _lags_sql(False))
def normalize_lags_unmasked(i: Inputs):
    return _scaled_lags(i, False)


def _weather_z(c: str, table: str = "s") -> str:
    return f"{table}.{c}" if c == "snow_flag" else f"({table}.{c} - {c}_mean) / ({c}_std + 1e-6)"


@query("normalize_weather", f"SELECT {_STEP}, {', '.join(r(_weather_z(c), c, 5) for c in C_OUT)} FROM fx_steps s, fx_stats", digits=5)
def normalize_weather(i: Inputs):
    scaled = i.windows().withColumn("c_out", hurdle.scale_outdoor(F.col("c_out"), i.stats()))
    return _flat(scaled).select("series_id", "window_idx", "window_start", "interval", *C_OUT)


@query("training_tensors", f"""
SELECT {_STEP}, CASE WHEN usage > 0 THEN 1e0 ELSE 0e0 END AS mask, {r(_z('usage'), 'z', 5)}, {rs(*schemas.CALENDAR, digits=5)},
{', '.join(r(_z(f's.{c}'), c, 5) for c in schemas.USAGE_LAGS)}, {', '.join(r(_weather_z(c), c, 5) for c in C_OUT)}
FROM fx_steps s, fx_stats""", digits=5, view=lambda df: _flat(df, ("mask", "z")))
def training_tensors(i: Inputs):
    """From the readings to model input: panel, features, encoding, windows."""
    built = features.build_features(access.filter_years(i.build_panel(True)), hot=i.hot())
    return windows.training_tensors(built, i.stats(), i.hot())


@query("finite_windows", "SELECT DISTINCT series_id, window_idx, window_start FROM fx_steps")
def finite_windows(i: Inputs):
    return windows.finite_windows(i.windows()).select("series_id", "window_idx", "window_start")


@query("window_condition_means", f"""
SELECT series_id, window_idx, {', '.join(r(f'avg({c})', c) for c in [*C_IN, *C_OUT])} FROM fx_steps GROUP BY 1, 2""")
def window_condition_means(i: Inputs):
    means = windows.window_condition_means(i.windows())
    return means.select(
        "series_id", "window_idx",
        *[F.col("c_in_mean")[k].alias(c) for k, c in enumerate(C_IN)],
        *[F.col("c_out_mean")[k].alias(c) for k, c in enumerate(C_OUT)],
    )


@query("first_batches", """
SELECT DISTINCT series_id, window_idx, window_start FROM fx_steps ORDER BY series_id, window_idx LIMIT 160""")
def first_batches(i: Inputs):
    return windows.first_batches(i.windows(), 5).select("series_id", "window_idx", "window_start")


@query("thin_rows", f"SELECT {_STEP}, {r('usage')} FROM fx_steps WHERE interval % 2 = 1")
def thin_rows(i: Inputs):
    steps = windows.explode_windows(i.windows(), keep=("window_start",))
    thinned = dtw.thin_rows(steps, ("series_id", "window_idx"), "interval")
    return thinned.select("series_id", "window_idx", "interval", "usage", "window_start")


@query("autocorrelation", f"""
SELECT series_id, {r('corr(usage, lagged)', 'autocorr')}
FROM (SELECT series_id, usage, lag(usage, 4) OVER (PARTITION BY series_id ORDER BY date_time) AS lagged FROM fx_readings)
WHERE lagged IS NOT NULL GROUP BY 1""")
def autocorrelation(i: Inputs):
    return behaviour.autocorrelation(i.readings(), 4, i.hot())


_STARTS = """WITH starts AS (
  SELECT *, usage > 0 AND NOT coalesce(lag(usage > 0) OVER (PARTITION BY series_id ORDER BY date_time), false) AS start
  FROM fx_readings)"""


@query("burst_stats", f"""{_STARTS}
SELECT series_id, CAST(count(*) FILTER (start) AS BIGINT) AS n_events,
  {r("count(*) FILTER (start) / count(DISTINCT CAST(date_time AS DATE))", "events_per_day")},
  {r("count(*) FILTER (usage > 0) / nullif(count(*) FILTER (start), 0)", "mean_steps")}, {r("max(usage)", "peak")}
FROM starts GROUP BY 1""")
def burst_stats(i: Inputs):
    return behaviour.burst_stats(i.readings(), i.hot())


@query("interarrival", f"""{_STARTS}
SELECT series_id, date_time, CAST(date_diff('minute', prev, date_time) AS DOUBLE) AS gap_minutes
FROM (SELECT series_id, date_time, lag(date_time) OVER (PARTITION BY series_id ORDER BY date_time) AS prev FROM starts WHERE start)
WHERE prev IS NOT NULL""")
def interarrival(i: Inputs):
    return behaviour.interarrival(i.readings(), i.hot())


_SCHEDULE = """schedule AS (
  SELECT t, beta, 1 - beta AS alpha, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS alpha_hat
  FROM (SELECT CAST(t AS INTEGER) AS t, 1e-4 + t * (0.02e0 - 1e-4) / 999 AS beta FROM range(1000) s(t)))"""


@query("noise_schedule", f"""
WITH {_SCHEDULE}, w AS (SELECT DISTINCT series_id, window_idx,
  CAST((CAST(substring(series_id, 1, 10) AS BIGINT) * 37 + window_idx * 101) % 1000 AS INTEGER) AS t FROM fx_steps)
SELECT series_id, window_idx, t, {r('beta', digits=9)}, {r('alpha', digits=9)}, {r('alpha_hat', digits=9)}
FROM w JOIN schedule USING (t)""", digits=9)
def noise_schedule(i: Inputs):
    """The schedule looked up for a step of every window."""
    number = F.col("series_id").substr(1, 10).cast("bigint") * 37 + F.col("window_idx") * 101
    timed = i.windows().select("series_id", "window_idx", (number % 1000).cast("int").alias("t"))
    found = generative.with_schedule(timed, generative.noise_schedule(i.spark))
    return found.select("series_id", "window_idx", "t", "beta", "alpha", "alpha_hat")


@query("forward_noise")
def forward_noise(i: Inputs):
    noised = generative.forward_noise(i.encoded(), generative.noise_schedule(i.spark))
    parts = F.arrays_zip(
        F.flatten("x").alias("x0"), F.flatten("eps").alias("eps"), F.flatten("x_t").alias("x_t")
    )
    return noised.select("series_id", "window_idx", "t", F.posexplode(parts).alias("pos", "p")).select(
        "series_id", "window_idx", "t", "pos", "p.x0", "p.eps", "p.x_t"
    )


@query("noise_mse", f"SELECT {r('avg((usage - usage_24h) * (usage - usage_24h))', 'mse')} FROM fx_steps")
def noise_mse(i: Inputs):
    """Any pair of arrays: here the windows against the same steps one day earlier."""
    return generative.noise_mse(i.windows().withColumn("predicted", F.element_at("c_in", 11)), "x")


@query("gaussian_predictor", f"""
WITH cells AS (
  SELECT CAST(dayofweek(window_start) + 1 AS INTEGER) AS stratum, interval, 0 AS channel,
         CASE WHEN usage > 0 THEN 1e0 ELSE 0e0 END AS v FROM fx_steps
  UNION ALL
  SELECT CAST(dayofweek(window_start) + 1 AS INTEGER), interval, 1, {_z('usage')} FROM fx_steps, fx_stats)
SELECT stratum, channel, interval, {r('avg(v)', 'mu')}, {r('var_pop(v)', 'var')}, count(*) AS n FROM cells GROUP BY 1, 2, 3""")
def gaussian_predictor(i: Inputs):
    return _fitted(i)


def _fitted(i: Inputs):
    tensors = i.encoded().withColumn("stratum", F.dayofweek("window_start"))
    return generative.fit_gaussian(tensors, ["stratum"])


_SCENARIOS = "SELECT cell, CAST(date_trunc('day', wx_time) AS TIMESTAMP) AS day, avg(temp_c) AS temp_c, avg(precip_mm) AS precip_mm, avg(snow_cm) AS snow_cm FROM fx_weather_filled GROUP BY 1, 2"


def _scenario_sql() -> str:
    month, dow, hour = "2 * pi() * month(day) / 12", "2 * pi() * (dayofweek(day) + 1) / 7", "2 * pi() * i / 96"
    calendar = [r(f"{fn}({a})", f"{n}_{fn}") for n, a in (("month", month), ("dow", dow), ("hour", hour)) for fn in ("sin", "cos")]
    lag = "(ln(1 + 0.1e0) - log_mean) / (log_std + 1e-6)"
    raw = {
        "temp_c": "temp_c", "precip_mm": "precip_mm", "snow_cm": "snow_cm", "temp_1h": "temp_c", "temp_24h": "temp_c",
        "temp_48h": "temp_c", "precip_3d": "0", "snow_24h": "0", "gdd_7d": "0",
    }
    weather = [
        "CASE WHEN snow_cm > 0 THEN 1e0 ELSE 0e0 END AS snow_flag" if c == "snow_flag"
        else r(f"({raw[c]} - {c}_mean) / ({c}_std + 1e-6)", c)
        for c in C_OUT
    ]
    lags = [r(lag, c) for c in schemas.USAGE_LAGS]
    return f"""SELECT cell, day, CAST(i AS INTEGER) AS interval, {', '.join([*calendar, *lags, *weather])}
FROM ({_SCENARIOS}), fx_stats, range(96) g(i)"""


@query("scenario_encode", _scenario_sql())
def scenario_encode(i: Inputs):
    """A scenario per place and day from its mean weather."""
    day = F.date_trunc("day", "wx_time").cast("timestamp_ntz")
    daily = i.weather(True).groupBy("cell", day.alias("day")).agg(
        *[F.avg(c).alias(c) for c in ("temp_c", "precip_mm", "snow_cm")]
    )
    scenarios = daily.withColumns({"month": F.month("day"), "dow": F.dayofweek("day")})
    names = [f"_{k}" for k in range(len(C_IN) + len(C_OUT))]
    parts = [F.col("c_in")[k] for k in range(len(C_IN))] + [F.col("c_out")[k] for k in range(len(C_OUT))]
    encoded = generative.scenario_encode(scenarios, i.stats())
    steps = encoded.select("cell", "day", F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, names)])).alias("interval", "z"))
    return steps.select("cell", "day", "interval", *[F.col(f"z.{n}").alias(c) for n, c in zip(names, [*C_IN, *C_OUT])])


def _clock_profile(i: Inputs):
    interval = F.floor((F.hour("date_time") * 60 + F.minute("date_time")) / 15).cast("int")
    return i.panel().groupBy(interval.alias("interval")).agg(F.avg("temp_c").alias("temp_c"))


@query("cross_scenarios", f"""
SELECT series_id, CAST(g.i AS INTEGER) AS interval, {r('p.temp_c', 'temp_c')}
FROM (SELECT DISTINCT series_id FROM fx_readings) h, range(96) g(i)
JOIN (SELECT (hour(date_time) * 60 + minute(date_time)) // 15 AS interval, avg(temp_c) AS temp_c FROM fx_panel GROUP BY 1) p
  ON g.i = p.interval""")
def cross_scenarios(i: Inputs):
    return generative.cross_scenarios(i.readings().select("series_id").distinct(), _clock_profile(i))


@query("synthetic_baseline")
def synthetic_baseline(i: Inputs):
    homes = i.readings().select(F.col("series_id").alias("home_id")).distinct()
    return generative.synthetic_baseline(homes, _clock_profile(i))


@query("reverse_sample")
def reverse_sample(i: Inputs):
    """One trace per home and weekday from the fitted predictor, decoded to usage."""
    fitted = generative.gaussian_arrays(_fitted(i), ["stratum"])
    wanted = i.windows().select("series_id", F.dayofweek("window_start").alias("stratum")).distinct()
    scenarios = wanted.join(fitted, "stratum").withColumn("sample_id", generative.sample_key(7, "series_id", "stratum"))
    drawn = generative.decode_samples(generative.reverse_sample(scenarios), i.stats())
    return drawn.select("sample_id", F.posexplode("x").alias("interval", "usage"))
