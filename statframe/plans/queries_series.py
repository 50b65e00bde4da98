"""Registered queries: time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from statframe.operators import sarima
from statframe.operators import timeseries as t
from statframe.plans.registry import fx, query, rounded, rs, view

_M = fx("series_month")
_UNIT = 1e-6        # sums of prices in millions, so rounding is about digits that agree


def _month(spark, sf):
    return view(spark, sf, "series_month").withColumn("v", F.col("v") * _UNIT)


_MM = f"(select k, ts, v * {_UNIT} as v from {_M})"
_MPOS = f"(select *, row_number() over (partition by k order by ts) as rn, count(*) over (partition by k) as nn from {_MM})"


@query("asfreq_grid", f"""
    with s as (select k, ts, v from {fx('series_hour')}), b as (select k, min(ts) as lo, max(ts) as hi from s group by 1),
      g as (select k, unnest(generate_series(lo, hi, interval 1 hour)) as ts from b)
    select g.k, g.ts, {rs('s.v')} as v from g left join s on g.k = s.k and g.ts = s.ts""")
def asfreq_grid(spark, sf):
    return rounded(t.regular_grid(view(spark, sf, "series_hour"), "ts", "1 hour", ["k"]))


@query("split_report", f"""
    with c as (select *, cast(floor((rn - 1) / floor(nn / 3)) + 1 as integer) as part from {_MPOS} where rn <= floor(nn / 3) * 3)
    select k, part, min(ts) as start, max(ts) as end, count(*) as n, {rs('avg(v)', 3)} as mean, {rs('stddev_samp(v)', 3)} as std,
      {rs('stddev_samp(v) / avg(v)')} as cv from c group by k, part""")
def split_report(spark, sf):
    return rounded(t.split_report(_month(spark, sf), "ts", "v", ["k"]), 3, cv=4)


@query("period_variation", f"""
    with g as (select k, date_trunc('year', ts) as period, {rs('avg(v)', 3)} as mean, {rs('stddev_samp(v)', 3)} as std
      from {_MM} group by 1, 2)
    select k, period, mean, std, {rs('std / mean')} as cv from g where std is not null""")
def period_variation(spark, sf):
    return rounded(t.variation(_month(spark, sf), "ts", "v", ["k"]))


@query("variation_verdict", f"""
    with g as (select k, date_trunc('year', ts) as period, {rs('avg(v)', 3)} as mean, {rs('stddev_samp(v)', 3)} as std from {_MM} group by 1, 2),
      c as (select *, {rs('std / mean')} as cv from g where std is not null)
    select k, {rs('max(std) / min(std)')} as std_ratio, {rs('max(cv) / min(cv)')} as cv_ratio,
      case when max(cv) / min(cv) < max(std) / min(std) then 'multiplicative' else 'additive' end as model from c group by 1""")
def variation_verdict(spark, sf):
    return rounded(t.variation_verdict(t.variation(_month(spark, sf), "ts", "v", ["k"]), ["k"]))


@query("diff_series", f"""
    with a as (select k, ts, rn, ln(v) - lag(ln(v)) over (partition by k order by ts) as d from {_MPOS}),
      b as (select k, ts, d - lag(d, 12) over (partition by k order by ts) as v from a)
    select k, ts, {rs('v', 6)} as v from b where v is not null""")
def diff_series(spark, sf):
    return rounded(t.transform(_month(spark, sf), "ts", "v", ["k"], log=True, diff=1, seasonal_diff=1, period=12), 6)


@query("rolling", f"""
    select k, ts, {rs('v', 3)} as v, {rs('case when count(v) over w = 6 then avg(v) over w end', 3)} as rolling_mean,
      {rs('case when count(v) over w = 6 then stddev_samp(v) over w end', 3)} as rolling_std
    from {_MM} window w as (partition by k order by ts rows between 5 preceding and current row)""")
def rolling(spark, sf):
    return rounded(t.rolling(_month(spark, sf), "ts", "v", 6, ["k"]), 3)


@query("smooth_ma", f"""
    select ts, cast(v as double) as v, {rs('case when count(v) over a = 3 then avg(v) over a end', 4)} as ma_3,
      {rs('case when count(v) over b = 7 then avg(v) over b end', 4)} as ma_7 from {fx('series_day')}
    window a as (order by ts rows between 2 preceding and current row), b as (order by ts rows between 6 preceding and current row)""")
def smooth_ma(spark, sf):
    return rounded(t.smooth(view(spark, sf, "series_day"), "ts", "v", [3, 7]))


@query("ewm", f"""
    with s as (select *, row_number() over (partition by k order by ts) as rn from {_MM})
    select a.k, a.ts, {rs('max(a.v)', 4)} as v,
      {rs('sum(b.v * pow(1 - 2.0 / 4, a.rn - b.rn)) / sum(pow(1 - 2.0 / 4, a.rn - b.rn))', 4)} as ewm_3,
      {rs('sum(b.v * pow(1 - 2.0 / 13, a.rn - b.rn)) / sum(pow(1 - 2.0 / 13, a.rn - b.rn))', 4)} as ewm_12
    from s a join s b on a.k = b.k and b.rn <= a.rn group by a.k, a.ts""")
def ewm(spark, sf):
    return rounded(t.smooth(_month(spark, sf), "ts", "v", [3, 12], ["k"], "ewm"))


def _decomposed(model: str) -> str:
    bare, level, adj = ("v / trend", "m / avg(m) over (partition by k)", "v / seasonal / trend") if model == "multiplicative" else (
        "v - trend", "m - avg(m) over (partition by k)", "v - trend - seasonal")
    return f"""
    with t as (select k, ts, v, rn, nn, (rn - 1) % 12 + 1 as pos, case when rn > 6 and rn <= nn - 6 then
        (sum(v) over (partition by k order by ts rows between 5 preceding and 5 following)
         + 0.5 * lag(v, 6) over (partition by k order by ts) + 0.5 * lead(v, 6) over (partition by k order by ts)) / 12 end as trend from {_MPOS}),
      p as (select k, pos, avg({bare}) as m from t group by 1, 2), s as (select k, pos, {level} as seasonal from p),
      d as (select t.k, ts, v, trend, seasonal, {adj} as residual, t.pos from t join s on t.k = s.k and t.pos = s.pos)"""


def _decompose(model: str):
    @query(f"decompose_{model}", _decomposed(model) + f" select k, ts, {rs('trend', 4)} as trend, {rs('seasonal', 5)} as seasonal, "
           f"{rs('residual', 5)} as residual, cast(pos as integer) as position from d")
    def run(spark, sf):
        return rounded(t.decompose(_month(spark, sf), "ts", "v", 12, ["k"], model).select(
            "k", "ts", "trend", "seasonal", "residual", "position"), 5, trend=4)
    return run


_decompose("additive")
_decompose("multiplicative")


@query("seasonal_index", _decomposed("multiplicative") + f""" select distinct k, 'multiplicative' as model, cast(pos as integer) as position,
    {rs('seasonal', 5)} as index, {rs('(seasonal - 1) * 100', 3)} as from_base from d""")
def seasonal_index(spark, sf):
    return rounded(t.seasonal_index(_month(spark, sf), "ts", "v", 12, ["k"], "multiplicative").select(
        "k", "model", "position", "index", "from_base"), 5, from_base=3)


@query("seasonal_adjust", _decomposed("additive") + f" select k, ts, {rs('v - seasonal', 4)} as adjusted from d")
def seasonal_adjust(spark, sf):
    return rounded(t.adjust(_month(spark, sf), "ts", "v", 12, ["k"], "additive").select("k", "ts", "adjusted"))


@query("seasonal_model", f"""
    with b as (select k, floor((rn - 1) / 12) as b, avg(v) as m, stddev_samp(v) as s from {_MPOS} group by 1, 2)
    select k, {rs('max(s) / min(s)')} as std_ratio, {rs('max(s / m) / min(s / m)')} as cv_ratio,
      case when max(s / m) / min(s / m) < max(s) / min(s) then 'multiplicative' else 'additive' end as model from b group by 1""")
def seasonal_model(spark, sf):
    return rounded(t.seasonal_model(_month(spark, sf), "ts", "v", 12, ["k"]))


@query("acf", f"""
    with s as (select k, rn, nn, v - avg(v) over (partition by k) as x from {_MPOS}),
      l as (select a.k, cast(b.rn - a.rn as integer) as lag, sum(a.x * b.x) as c, max(a.nn) as n from s a join s b
            on a.k = b.k and b.rn >= a.rn and b.rn - a.rn <= 24 group by 1, 2),
      z as (select k, c as c0 from l where lag = 0)
    select l.k, lag, n, {rs('c / c0', 6)} as acf, abs(c / c0) > 2 / sqrt(n) as acf_sig, {rs('2 / sqrt(n)', 6)} as bound
    from l join z on l.k = z.k where lag between 1 and greatest(least(36, n // 4), 24)""")
def acf(spark, sf):
    return rounded(t.acf(_month(spark, sf), "ts", "v", ["k"], period=12).select("k", "lag", "n", "acf", "acf_sig", "bound"), 6)


# orders by the autocorrelation: how many lags (and seasonal lags) stand out before the first that does not
@query("acf_cutoffs", f"""
    with s as (select k, rn, nn, v - avg(v) over (partition by k) as x from {_MPOS}),
      l as (select a.k, cast(b.rn - a.rn as integer) as lag, sum(a.x * b.x) as c, max(a.nn) as n from s a join s b
            on a.k = b.k and b.rn >= a.rn and b.rn - a.rn <= 24 group by 1, 2),
      z as (select k, c as c0 from l where lag = 0),
      f as (select l.k, lag, abs(c / c0) > 2 / sqrt(n) as sig from l join z on l.k = z.k where lag between 1 and greatest(least(36, n // 4), 24))
    select k, cast(coalesce(min(lag) filter (where not sig) - 1, max(lag)) as integer) as q,
      cast(coalesce(min(lag // 12) filter (where not sig and lag % 12 = 0) - 1, max(lag // 12)) as integer) as sq from f group by k""")
def acf_cutoffs(spark, sf):
    return t.acf(_month(spark, sf), "ts", "v", ["k"], period=12).select("k", "q", "sq").distinct()


@query("acf_orders")
def acf_orders(spark, sf):
    return rounded(t.acf(view(spark, sf, "series_hour"), "ts", "v", ["k"], period=24), 6)


@query("adf")
def adf(spark, sf):
    return rounded(t.adf(_month(spark, sf), "ts", "v", ["k"]))


@query("adf_variants")
def adf_variants(spark, sf):
    return rounded(t.adf_variants(_month(spark, sf), "ts", "v", ["k"], period=12))


@query("adf_differences")
def adf_differences(spark, sf):
    return rounded(t.adf_differences(view(spark, sf, "series_day"), "ts", "v"))


@query("arima_grid")
def arima_grid(spark, sf):
    return rounded(t.arima_grid(_month(spark, sf), "ts", "v", ["k"], s=12).drop("long_ar", "ar", "ma", "ar_lags", "ma_lags"))


@query("sarima_refined")
def sarima_refined(spark, sf):
    df = _month(spark, sf)
    best = t.core.checkpoint(t.best_orders(t.arima_grid(df, "ts", "v", ["k"], s=12)))
    return rounded(sarima.refine(df, "ts", "v", best, ["k"]).select("k", "p", "d", "q", "sp", "sd", "sq", "params", "n", "aic"), 3)


# residuals of (0.4 | 0.3)(0.2 | -0.5)12 for the series less its first value: 13 residuals back, from nothing before
@query("sarima_residual_sums", f"""
    with recursive w as (select k, rn, v - first_value(v) over (partition by k order by rn) as w from {_MPOS}),
      u as (select k, rn, w - 0.4 * lag(w, 1) over s - 0.2 * lag(w, 12) over s + 0.08 * lag(w, 13) over s as u from w window s as (partition by k order by rn)),
      r as (select k, cast(13 as bigint) as rn, [0.0::double for i in range(13)] as es, 0.0::double as css from u where rn = 1
            union all select r.k, u.rn, list_append(es[2:], u - 0.3 * es[13] + 0.5 * es[2] + 0.15 * es[1]), css + pow(u - 0.3 * es[13] + 0.5 * es[2] + 0.15 * es[1], 2)
              from r join u on u.k = r.k and u.rn = r.rn + 1)
    select k, max(rn) - 13 as n, {rs('max(css)', 2)} as css from r group by k""")
def sarima_residual_sums(spark, sf):
    from pyspark.sql import Window
    df = _month(spark, sf)
    df = df.withColumn("v", F.col("v") - F.first("v").over(Window.partitionBy("k").orderBy("ts")))      # a few years of months per series
    return rounded(sarima.residual_sums(df, "ts", "v", [0.4, 0.3, 0.2, -0.5], (1, 1), (1, 1), 12, ["k"]), 2)


@query("arima_forecast")
def arima_forecast(spark, sf):
    df = _month(spark, sf)
    best = t.core.checkpoint(t.best_orders(t.arima_grid(df, "ts", "v", ["k"], s=12)))
    return rounded(t.forecast(df, "ts", "v", best, 12, ["k"]))


@query("arima_score")
def arima_score(spark, sf):
    df = _month(spark, sf)
    best = t.core.checkpoint(t.best_orders(t.arima_grid(df, "ts", "v", ["k"], s=12)))
    return rounded(t.score(t.fitted(df, "ts", "v", best, ["k"]), "ts", "v", "pred", ["k"], 12))


@query("naive_score", f"""
    with s as (select k, v, v - lag(v, 12) over (partition by k order by ts) as e, lag(v, 1) over (partition by k order by ts) as p,
        lag(v, 12) over (partition by k order by ts) as f from {_MM}), c as (select * from s where f is not null and p is not null)
    select k, 'naive' as target, count(*) as n, {rs('avg(abs(e))')} as mae, {rs('sqrt(avg(e * e))')} as rmse,
      {rs('avg(case when v <> 0 then abs(e / v) end) * 100')} as mape from c group by 1
    union all select k, 'model', count(*), {rs('avg(abs(v - p))')}, {rs('sqrt(avg((v - p) * (v - p)))')},
      {rs('avg(case when v <> 0 then abs((v - p) / v) end) * 100')} from c group by 1""")
def naive_score(spark, sf):
    from pyspark.sql import Window
    df = _month(spark, sf)
    df = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("ts")))
    return rounded(t.score(df, "ts", "v", "p", ["k"], 12))


@query("residual_report", f"""
    with s as (select k, ts, v - avg(v) over (partition by k) as x, v, row_number() over (partition by k order by ts) as rn,
        count(*) over (partition by k) as n from {_MM}),
      l as (select a.k, b.rn - a.rn as lag, sum(a.x * b.x) as c, max(a.n) as n from s a join s b on a.k = b.k and b.rn - a.rn between 0 and 10 group by 1, 2),
      q as (select l.k, max(n) as n, max(n) * (max(n) + 2) * sum(pow(c / c0, 2) / (n - lag)) as q from l
            join (select k, c as c0 from l where lag = 0) z on l.k = z.k where lag > 0 group by 1),
      j as (select k, count(*) as n, skewness(v) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) as g1, kurtosis_pop(v) as g2 from s group by 1),
      h as (select k, max(n) as n, sum(case when rn > n - round(n / 3) then v * v end) / sum(case when rn <= round(n / 3) then v * v end) as h from s group by 1)
    select k, 'Ljung-Box (10)' as test, n, {rs('q')} as statistic from q
    union all select k, 'Jarque-Bera', n, {rs('n / 6.0 * (g1 * g1 + g2 * g2 / 4)')} from j
    union all select k, 'Break in variance', n, {rs('h')} from h""")
def residual_report(spark, sf):
    return rounded(t.residual_report(_month(spark, sf), "ts", "v", ["k"]).select("k", "test", "n", "statistic"))
