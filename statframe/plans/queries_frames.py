"""Registered queries: the data behind charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from statframe.operators import frames, logit, ols
from statframe.plans.queries_models import _THREE, newton_two_sql
from statframe.plans.registry import fx, query, rounded, rs, table, view


def _hist_sql(src: str, x: str, n: str, keys: str = "") -> str:
    k, j = (f"{keys}, ", f"g.{keys} = c.{keys} and ") if keys else ("", "")
    return f"""
    with r as (select min({x}) as lo, max({x}) as hi, count({x}) as n, quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) as iqr from {src}),
      w as (select lo, hi, cast({n} as integer) as n from r), e as (select lo, n, (hi - lo) / n as width from w),
      c as (select {k}cast(least(floor(({x} - lo) / width), n - 1) as integer) as bin, count(*) as count from {src}, e group by all),
      g as (select {('k.' + keys + ', ') if keys else ''}cast(i as integer) as bin, lo + i * width as left_edge, lo + (i + 1) * width as right_edge
            from e, range(1000) t(i){f', (select distinct {keys} from {src}) k' if keys else ''} where i < n)
    select {('g.' + keys + ', ') if keys else ''}g.bin, {rs('left_edge')} as left, {rs('right_edge')} as right, coalesce(c.count, 0) as count
    from g left join c on {j}g.bin = c.bin"""


_AUTO = "ceil((hi - lo) / least((hi - lo) / (log2(n) + 1), 2 * iqr / pow(n, 1.0 / 3)))"


@query("hist_frame", _hist_sql("events", "value", _AUTO))
def hist_frame(spark, sf):
    return rounded(frames.histogram(table(spark, sf, "events"), "value"))


@query("hist_frame_hue", _hist_sql("orders", "o_totalprice", "20", "o_orderstatus"))
def hist_frame_hue(spark, sf):
    return rounded(frames.histogram(table(spark, sf, "orders"), "o_totalprice", 20, "o_orderstatus"))


# rows shared between two bins of 1/32 bandwidth, a Gaussian on every filled bin
@query("kde_frame", f"""
    with s as (select event_type as g, count(value) as n, stddev_samp(value) * pow(count(value), -0.2) as bw, min(value) as lo, max(value) as hi from events group by 1),
      v as (select g, n, bw, value * 32 / bw as spot from events join s on event_type = g where value is not null),
      b as (select g, b, sum(w) as w from (select g, floor(spot) as b, 1 - (spot - floor(spot)) as w from v union all select g, floor(spot) + 1, spot - floor(spot) from v) group by 1, 2),
      x as (select g, n, bw, lo - 3 * bw + i * ((hi - lo + 6 * bw) / 199) as x from s, range(200) t(i))
    select x.g as event_type, {rs('x.x', 6)} as x, {rs('sum(b.w * exp(-0.5 * pow((x.x - b.b * x.bw / 32) / x.bw, 2))) / (max(x.n) * max(x.bw) * sqrt(2 * pi()))', 7)} as density
    from x join b on b.g = x.g group by x.g, x.x""")
def kde_frame(spark, sf):
    return rounded(frames.kde(table(spark, sf, "events"), "value", "event_type"), 7, x=6)


@query("kde_lines", f"""
    select event_type, 'value' as variable, count(value) as n, {rs('avg(value)')} as mean, {rs('stddev_samp(value) / sqrt(count(value))')} as se
    from events group by 1""")
def kde_lines(spark, sf):
    return rounded(frames.kde_lines(table(spark, sf, "events"), "value", "event_type").select("event_type", "variable", "n", "mean", "se"))


@query("density_peaks")
def density_peaks(spark, sf):
    return frames.peaks(view(spark, sf, "numeric"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("variable", "peaks")


@query("box_frame", f"""
    with q as (select o_orderpriority, quantile_cont(o_totalprice, 0.25) as q25, median(o_totalprice) as q50, quantile_cont(o_totalprice, 0.75) as q75
      from orders group by 1), d as (select q.*, o_totalprice as y, o_totalprice between q25 - 1.5 * (q75 - q25) and q75 + 1.5 * (q75 - q25) as ok
      from orders o join q on o.o_orderpriority = q.o_orderpriority)
    select o_orderpriority, {rs('q25')} as q25, {rs('q50')} as q50, {rs('q75')} as q75, count(*) as n, {rs('min(y)')} as min, {rs('max(y)')} as max,
      {rs('min(case when ok then y end)')} as whisker_low, {rs('max(case when ok then y end)')} as whisker_high,
      count(*) filter (where not ok) as outliers from d group by o_orderpriority, d.q25, d.q50, d.q75""")
def box_frame(spark, sf):
    return rounded(frames.box(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"))


@query("box_frame_all", f"""
    with q as (select quantile_cont(value, 0.25) as q25, median(value) as q50, quantile_cont(value, 0.75) as q75 from events),
      d as (select q.*, value as y, value between q25 - 1.5 * (q75 - q25) and q75 + 1.5 * (q75 - q25) as ok from events, q)
    select {rs('q25')} as q25, {rs('q50')} as q50, {rs('q75')} as q75, count(*) as n, {rs('min(y)')} as min, {rs('max(y)')} as max,
      {rs('min(case when ok then y end)')} as whisker_low, {rs('max(case when ok then y end)')} as whisker_high,
      count(*) filter (where not ok) as outliers from d group by d.q25, d.q50, d.q75""")
def box_frame_all(spark, sf):
    return rounded(frames.box(table(spark, sf, "events"), "value"))


@query("bar_frame", f"select o_orderstatus, o_orderpriority, {rs('avg(o_totalprice)')} as value from orders group by 1, 2")
def bar_frame(spark, sf):
    return rounded(frames.bar(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice", "o_orderpriority"))


@query("count_frame", "select o_orderstatus, o_orderpriority, count(*) as count from orders group by 1, 2")
def count_frame(spark, sf):
    return frames.count(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("pie_frame", f"select o_orderpriority, count(*) as count, {rs('count(*) / sum(count(*)) over ()', 6)} as share from orders group by 1")
def pie_frame(spark, sf):
    return rounded(frames.pie(table(spark, sf, "orders"), "o_orderpriority"), 6)


def _stack_cell(level: str) -> str:
    return f"100 * sum(case when o_orderstatus = '{level}' then 1 else 0 end) / count(*)"


@query("stack_frame", f"select o_orderpriority, {rs(_stack_cell('F'))} as \"F\", {rs(_stack_cell('O'))} as \"O\", {rs(_stack_cell('P'))} as \"P\" "
       "from orders group by 1")
def stack_frame(spark, sf):
    df = table(spark, sf, "orders").withColumn("one", F.lit(1.0))
    return rounded(frames.stack(df, "o_orderpriority", "one", "o_orderstatus", "sum", ratio=True))


@query("point_frame", f"""
    select l_returnflag, l_linestatus, {rs('avg(l_quantity)')} as mean, {rs('stddev_samp(l_quantity) / sqrt(count(*))')} as se, count(*) as n
    from lineitem group by 1, 2""")
def point_frame(spark, sf):
    return rounded(frames.point(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_linestatus"))


@query("line_frame", f"select ts, k, {rs('avg(v)')} as mean, count(*) as n from {fx('series_month')} group by 1, 2")
def line_frame(spark, sf):
    return rounded(frames.line(view(spark, sf, "series_month"), "ts", "v", "k"))


@query("matrix_frame", " union all ".join(
    f"select c_custkey as row, '{c}' as column, cast({c} as double) as value from customer" for c in ("c_nationkey", "c_acctbal")))
def matrix_frame(spark, sf):
    return frames.matrix(table(spark, sf, "customer"), "c_custkey", ["c_nationkey", "c_acctbal"])


@query("lm_frame", f"""
    select c1, count(*) as n, {rs('regr_slope(y, x1)', 6)} as slope, {rs('regr_intercept(y, x1)', 6)} as intercept, {rs('regr_r2(y, x1)', 6)} as r2
    from {fx('reg')} group by 1""")
def lm_frame(spark, sf):
    return rounded(frames.lm(view(spark, sf, "reg"), "x1", "y", "c1"), 6)


def _cell(c: str, n: int) -> str:
    return f"cast(least(floor(({c} - {c}_lo) / (({c}_hi - {c}_lo) / {n})), {n - 1}) as integer)"


_XY = ("(select *, min(x1) over () as x1_lo, max(x1) over () as x1_hi, min(y) over () as y_lo, max(y) over () as y_hi from "
       f"{fx('reg')})")


@query("scatter_frame", f"""
    select c1, {_cell('x1', 20)} as cell_x, {_cell('y', 20)} as cell_y, count(*) as count, {rs('avg(x1)')} as x, {rs('avg(y)')} as y
    from {_XY} group by 1, 2, 3""")
def scatter_frame(spark, sf):
    return rounded(frames.scatter(view(spark, sf, "reg"), "x1", "y", "c1", 20))


@query("pair_frame", " union all ".join(
    f"select '{a}' as x_var, '{b}' as y_var, {_cell(a, 10)} as cell_x, {_cell(b, 10)} as cell_y, count(*) as count from {_XY} group by 3, 4"
    for a, b in (("x1", "x1"), ("x1", "y"), ("y", "y"))))
def pair_frame(spark, sf):
    return frames.pair(view(spark, sf, "reg"), ["x1", "y"], cells=10)


# a corner has another point with all others on one side of the line through both
@query("hull_frame", f"""
    with p as (select cast(label as varchar) as hue, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings),
      e as (select a.hue, a.x, a.y from p a join p b on a.hue = b.hue and (a.x, a.y) <> (b.x, b.y) join p c on c.hue = a.hue and (c.x, c.y) <> (a.x, a.y) and (c.x, c.y) <> (b.x, b.y)
            group by a.hue, a.x, a.y, b.x, b.y having min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) > 0)
    select distinct hue, {rs('x', 8)} as x, {rs('y', 8)} as y from e""")
def hull_frame(spark, sf):
    df = table(spark, sf, "embeddings").select(F.element_at("embedding", 1).cast("double").alias("x"),
                                               F.element_at("embedding", 2).cast("double").alias("y"), "label")
    return rounded(frames.hull(df, "x", "y", "label").drop("vertex"), 8)


@query("beta_frame", _THREE + " union all ".join(
    f" select 'x{i + 1}' as variable, {rs(f'b{i} * sqrt(s{i}{i} / syy)', 6)} as beta, case when b{i} > 0 then '+' else '-' end as sign from f" for i in range(3)))
def beta_frame(spark, sf):
    return rounded(frames.beta_bars(ols.fit(view(spark, sf, "reg").select("y", "x1", "x2", "x3"), "y").coefficients()), 6)


@query("odds_frame", f"""
    with f as {newton_two_sql()}
    select 'x1' as variable, {rs('exp(b)', 6)} as odds_ratio, case when b > 0 then '+' else '-' end as sign from f
    union all select 'x2', {rs('exp(c)', 6)}, case when c > 0 then '+' else '-' end from f""")
def odds_frame(spark, sf):
    m = logit.fit(view(spark, sf, "logit").select("y", "x1", "x2"), "y")
    return rounded(frames.beta_bars(m.coefficients(), "odds_ratio"), 6)
