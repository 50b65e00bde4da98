"""Registered queries: linear and logistic regression, classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from statframe.functions.normal import HART_BOTTOM, HART_LIMIT, HART_TOP
from statframe.operators import core, logit, ols
from statframe.plans.registry import fx, query, rounded, rs, view

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_ORDER_SQL = ", ".join(ORDER)
# simple regression of y on x1, as SQL pieces
_LINE = f"(select regr_slope(y, x1) as b, regr_intercept(y, x1) as a, count(*) as n, avg(x1) as mx, avg(y) as my, " \
        f"regr_sxx(y, x1) as sxx, regr_syy(y, x1) as syy, regr_sxy(y, x1) as sxy from {fx('reg')})"
_RES = f"(select t.*, a + b * x1 as fit, y - a - b * x1 as e, l.* exclude (a, b), l.a, l.b from {fx('reg')} t, {_LINE} l)"


def _simple(spark, sf):
    return ols.fit(view(spark, sf, "reg").select(*ORDER, "y", "x1"), "y", ["x1"])


@query("ols_simple", f"""
    select 'x1' as variable, {rs('b', 8)} as b, {rs('sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)', 8)} as se,
      {rs('sxy / sqrt(sxx * syy)', 8)} as beta,
      {rs('b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)', 2)} as t from {_LINE}
    union all
    select 'const', {rs('a', 8)}, {rs('sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0 / n + mx * mx / sxx))', 8)}, null,
      {rs('a / sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0 / n + mx * mx / sxx))', 2)} from {_LINE}""")
def ols_simple(spark, sf):
    return rounded(_simple(spark, sf).coefficients().select("variable", "b", "se", "beta", "t"), 8, t=2)


@query("ols_fitness", f"""
    select n, cast(n - 2 as bigint) as df_resid, {rs('sxy * sxy / sxx / syy', 8)} as r2,
      {rs('1 - (1 - sxy * sxy / sxx / syy) * (n - 1) / (n - 2)', 8)} as r2_adj,
      {rs('(syy - sxy * sxy / sxx) / (n - 2)', 6)} as mse,
      {rs('-n / 2.0 * (ln(2 * pi() * (syy - sxy * sxy / sxx) / n) + 1)', 1)} as llf,
      {rs('n * (ln(2 * pi() * (syy - sxy * sxy / sxx) / n) + 1) + 4', 1)} as aic,
      {rs('n * (ln(2 * pi() * (syy - sxy * sxy / sxx) / n) + 1) + 2 * ln(n)', 1)} as bic from {_LINE}""")
def ols_fitness(spark, sf):
    return rounded(_simple(spark, sf).summary().select("n", "df_resid", "r2", "r2_adj", "mse", "llf", "aic", "bic"),
                   1, r2=8, r2_adj=8, mse=6)


@query("ols_predict", f"select {_ORDER_SQL}, {rs('fit', 6)} as pred from {_RES}")
def ols_predict(spark, sf):
    m = _simple(spark, sf)
    return rounded(m.predict(m.df).select(*ORDER, "pred"), 6)


@query("breusch_pagan", f"""
    select 'Breusch-Pagan' as test, {rs('n * pow(corr(e2, x1), 2)', 4)} as lm,
      {rs('pow(corr(e2, x1), 2) / ((1 - pow(corr(e2, x1), 2)) / (n - 2))', 4)} as statistic
    from (select e * e as e2, x1, n from {_RES}) group by n""")
def breusch_pagan(spark, sf):
    row = _simple(spark, sf).breusch_pagan()
    return rounded(core.rows_frame(spark, [row], "test string, lm double, statistic double"))


@query("durbin_watson", f"""
    select {rs('sum(pow(e - p, 2)) / sum(e * e)', 6)} as dw
    from (select e, lag(e) over (order by {_ORDER_SQL}, e) as p from {_RES})""")
def durbin_watson(spark, sf):
    row = _simple(spark, sf).durbin_watson(ORDER)
    return rounded(core.rows_frame(spark, [{"dw": row["statistic"]}], "dw double"), 6)


@query("reset_linear", f"""
    with z as (select x1 - mx as x, y - my as y, pow(x1 - mx, 2) as z, sxx, sxy, syy, n from {_RES}),
      s as (select max(n) as n, max(sxx) as sxx, max(sxy) as sxy, max(syy) as syy, sum(z * z) - sum(z) * sum(z) / count(*) as szz,
            sum(x * z) as sxz, sum(z * y) as szy from z),
      r as (select n, syy - sxy * sxy / sxx as rss0,
            syy - (sxy * (sxy * szz - sxz * szy) + szy * (sxx * szy - sxz * sxy)) / (sxx * szz - sxz * sxz) as rss1 from s)
    select {rs('(rss0 - rss1) / (rss1 / (n - 3))', 4)} as f from r""")
def reset_linear(spark, sf):
    return rounded(core.rows_frame(spark, [{"f": _simple(spark, sf).reset()["statistic"]}], "f double"))


@query("residual_coverage", f"""
    with s as (select sqrt((max(syy) - max(sxy) * max(sxy) / max(sxx)) / (max(n) - 2)) as s from {_RES})
    """ + " union all ".join(
        f"select cast({k} as integer) as band, {rs(f'avg(case when abs(e) <= {k} * s then 1.0 else 0.0 end)', 6)} as inside from {_RES}, s"
        for k in (1, 2, 3)))
def residual_coverage(spark, sf):
    return rounded(_simple(spark, sf).coverage().select("band", "inside"), 6)


def _horner(coef) -> str:
    out = repr(coef[0])
    for c in coef[1:]:
        out = f"({out} * abs(v) + {c!r})"
    return out


@query("residual_ks", f"""
    with m as (select avg(e) as m, stddev_samp(e) as s from {_RES}),
      v as (select (e - m) / s as v, count(*) as c from {_RES}, m group by 1),
      k as (select v, c, coalesce(sum(c) over (order by v rows between unbounded preceding and 1 preceding), 0) as b,
            sum(c) over () as n, case when abs(v) < {HART_LIMIT} then exp(-v * v / 2) * {_horner(HART_TOP)} / {_horner(HART_BOTTOM)} else 0 end as tail from v),
      d as (select *, case when v > 0 then 1 - tail else tail end as phi from k)
    select {rs('max(greatest(abs(b / n - phi), abs((b + c) / n - phi)))', 6)} as d from d""")
def residual_ks(spark, sf):
    return rounded(core.rows_frame(spark, [{"d": _simple(spark, sf).normality()["statistic"]}], "d double"), 6)


# two predictors in closed form: centred sums, Cramer's rule
_TWO = f"""(select *, s11 * s22 - s12 * s12 as det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as b1,
    (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as b2 from (select count(*) as n, avg(x1) as m1, avg(x2) as m2, avg(y) as my,
    regr_sxx(y, x1) as s11, regr_sxx(y, x2) as s22, covar_pop(x1, x2) * count(*) as s12, regr_sxy(y, x1) as s1y,
    regr_sxy(y, x2) as s2y, regr_syy(y, x1) as syy from {fx('reg')}))"""


@query("ols_two", f"""
    with f as (select *, (syy - b1 * s1y - b2 * s2y) / (n - 3) as mse from {_TWO})
    select 'x1' as variable, {rs('b1', 6)} as b, {rs('sqrt(mse * s22 / det)', 6)} as se, {rs('1 / (1 - s12 * s12 / (s11 * s22))', 6)} as vif from f
    union all select 'x2', {rs('b2', 6)}, {rs('sqrt(mse * s11 / det)', 6)}, {rs('1 / (1 - s12 * s12 / (s11 * s22))', 6)} from f""")
def ols_two(spark, sf):
    m = ols.fit(view(spark, sf, "reg").select("y", "x1", "x2"), "y")
    return rounded(m.coefficients(intercept=False).select("variable", "b", "se", "vif"), 6)


@query("ols_hc3", f"""
    with e as (select x1 - mx as x, e, 1.0 / n + pow(x1 - mx, 2) / sxx as h, sxx from {_RES}),
      m as (select sum(x * x * e * e / pow(1 - h, 2)) as meat, max(sxx) as sxx from e)
    select 'x1' as variable, {rs('sqrt(meat) / sxx', 8)} as se_hc3 from m""")
def ols_hc3(spark, sf):
    return rounded(_simple(spark, sf).coefficients(hc3=True, intercept=False).select("variable", "se_hc3"), 8)


# three predictors: inverse of the centred cross products by cofactors
_X3 = ("x1", "x2", "x3")
_SUMS3 = ", ".join([f"covar_pop({a}, {b}) * count(*) as s{i}{j}" for i, a in enumerate(_X3) for j, b in enumerate(_X3) if i <= j]
                   + [f"covar_pop({a}, y) * count(*) as t{i}" for i, a in enumerate(_X3)] + [f"avg({a}) as m{i}" for i, a in enumerate(_X3)])
_THREE = f"""
    with s as (select cast(count(*) as double) as n, avg(y) as my, var_pop(y) * count(*) as syy, {_SUMS3} from {fx('reg')}),
      c as (select *, s11 * s22 - s12 * s12 as c00, s02 * s12 - s01 * s22 as c01, s01 * s12 - s02 * s11 as c02, s00 * s22 - s02 * s02 as c11,
            s01 * s02 - s00 * s12 as c12, s00 * s11 - s01 * s01 as c22 from s),
      d as (select *, s00 * c00 + s01 * c01 + s02 * c02 as det from c),
      b as (select *, (c00 * t0 + c01 * t1 + c02 * t2) / det as b0, (c01 * t0 + c11 * t1 + c12 * t2) / det as b1, (c02 * t0 + c12 * t1 + c22 * t2) / det as b2 from d),
      f as (select *, syy - b0 * t0 - b1 * t1 - b2 * t2 as rss from b)"""
_HC3 = f"""{_THREE}, e as (select x1 - m0 as u0, x2 - m1 as u1, x3 - m2 as u2, y - my - b0 * (x1 - m0) - b1 * (x2 - m1) - b2 * (x3 - m2) as e, f.* from {fx('reg')}, f),
      h as (select *, pow(e / (1 - 1 / n - (c00 * u0 * u0 + c11 * u1 * u1 + c22 * u2 * u2 + 2 * (c01 * u0 * u1 + c02 * u0 * u2 + c12 * u1 * u2)) / det), 2) as q from e),
      v as (select """ + ", ".join(f"sum(q * pow((c{min(i,0)}{max(i,0)} * u0 + c{min(i,1)}{max(i,1)} * u1 + c{min(i,2)}{max(i,2)} * u2) / det, 2)) as v{i}" for i in range(3)) + " from h)"


@query("ols_multi", _HC3 + " union all ".join(f"""
    select 'x{i + 1}' as variable, {rs(f'b{i}', 6)} as b, {rs(f'sqrt(rss / (n - 4) * c{i}{i} / det)', 6)} as se, {rs(f'b{i} * sqrt(s{i}{i} / syy)', 6)} as beta,
      {rs(f'b{i} / sqrt(rss / (n - 4) * c{i}{i} / det)', 3)} as t, {rs(f's{i}{i} * c{i}{i} / det', 6)} as vif, {rs(f'sqrt(v{i})', 6)} as se_hc3 from f, v""" for i in range(3)))
def ols_multi(spark, sf):
    out = ols.fit(view(spark, sf, "reg").select("y", "x1", "x2", "x3"), "y").coefficients(hc3=True, intercept=False)
    return rounded(out.select("variable", "b", "se", "beta", "t", "vif", "se_hc3"), 6, t=3)


@query("ols_effects")
def ols_effects(spark, sf):
    m = ols.prepared_fit(view(spark, sf, "skew"), "right_pos", log=True)
    return rounded(m.effects(), 6)


@query("ols_backward")
def ols_backward(spark, sf):
    df = view(spark, sf, "reg").select("y", "x1", "x2", "x3", (F.col("l_linenumber") * 1.0).alias("noise"))
    return rounded(ols.backward(df, "y").coefficients(), 6)


@query("ols_prepared")
def ols_prepared(spark, sf):
    df = view(spark, sf, "reg").select("y", "x1", "x2", "x3", "x4", "c1")
    m = ols.prepared_fit(df, "y", outlier=True, vif=True, scale=True, eliminate=True)
    return rounded(m.coefficients(m.use_hc3), 6)


def _scores(name: str, k: int, e: str) -> str:
    return f"""select '{name}' as model, {k} as variables, 1 - sum(pow({e}, 2)) / max(syy) as r2, max(n) as n, sum(pow({e}, 2)) as rss, avg(abs({e})) as mae
        from {fx('reg')}, f"""


_E1, _E2 = "(y - my - t0 / s00 * (x1 - m0))", "(y - my - (t0 * s11 - t1 * s01) / (s00 * s11 - s01 * s01) * (x1 - m0) - (t1 * s00 - t0 * s01) / (s00 * s11 - s01 * s01) * (x2 - m1))"
_E3 = "(y - my - b0 * (x1 - m0) - b1 * (x2 - m1) - b2 * (x3 - m2))"


@query("ols_compare", f"""{_THREE}, m as ({_scores('one', 1, _E1)} union all {_scores('two', 2, _E2)} union all {_scores('all', 3, _E3)}),
      r as (select *, sqrt(rss / n) as rmse, n * (ln(2 * pi() * rss / n) + 1) as dev from m),
      g as (select *, round((rmse - min(rmse) over ()) / min(rmse) over () * 100, 2) as gap from r)
    select cast(row_number() over (order by gap > 5, rmse) as integer) as place, model, variables, {rs('r2')} as R2, {rs('1 - (1 - r2) * (n - 1) / (n - variables - 1)')} as R2_ADJ,
      {rs('dev + 2 * (variables + 1)', 2)} as AIC, {rs('dev + ln(n) * (variables + 1)', 2)} as BIC, {rs('r2')} as R2_ORIGINAL, {rs('rmse')} as RMSE, {rs('mae')} as MAE, gap as gap_pct from g""")
def ols_compare(spark, sf):
    df = view(spark, sf, "reg").select("y", "x1", "x2", "x3").persist()
    fits = {"one": ols.fit(df, "y", ["x1"]), "two": ols.fit(df, "y", ["x1", "x2"]), "all": ols.fit(df, "y")}
    return rounded(ols.compare(fits)[0], 4, AIC=2, BIC=2)


@query("ols_original_errors", f"""
    select {rs('sqrt(avg(e * e))', 6)} as rmse, {rs('avg(abs(e))', 6)} as mae,
      {rs('1 - sum(e * e) / max(syy)', 6)} as r2 from {_RES}""")
def ols_original_errors(spark, sf):
    e = ols.original_errors(_simple(spark, sf))
    return rounded(core.rows_frame(spark, [{"rmse": e["RMSE"], "mae": e["MAE"], "r2": e["R2_ORIGINAL"]}],
                                   "rmse double, mae double, r2 double"), 6)


@query("ols_diagnostics")
def ols_diagnostics(spark, sf):
    m = ols.fit(view(spark, sf, "reg").select(*ORDER, "y", "x1", "x2", "x3"), "y", ["x1", "x2", "x3"])
    return rounded(m.diagnostics(ORDER), 6)


@query("ols_select")
def ols_select(spark, sf):
    df = view(spark, sf, "reg").select("y", "x1", "x2", "x3", "x4")
    m = ols.select_variables(df, "y", ["x1", "x2", "x3", "x4"], ["x1", "x2", "x3", "x4"])
    return rounded(m.coefficients(m.use_hc3), 6)


# ------------------------------------------------------------------- logistic
def newton_sql(steps: int = 12) -> str:
    """Two-parameter logit (intercept, x1) by Newton steps over (x1, y) counts of the whole table."""
    src = f"(select x1, count(*) as n, sum(y) as s from {fx('logit')} group by 1)"
    prev = "(select 0.0::double as a, 0.0::double as b)"
    for _ in range(steps):
        p = "(1 / (1 + exp(-(a + b * x1))))"
        prev = (f"(select a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) as a, b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) as b "
                f"from (select max(a) as a, max(b) as b, sum(s - n * {p}) as ga, sum((s - n * {p}) * x1) as gb, "
                f"sum(n * {p} * (1 - {p})) as haa, sum(n * {p} * (1 - {p}) * x1) as hab, sum(n * {p} * (1 - {p}) * x1 * x1) as hbb "
                f"from {src} d, {prev} q))")
    p = "(1 / (1 + exp(-(a + b * x1))))"
    return f"""select max(a) as a, max(b) as b, sum(n * {p} * (1 - {p})) as haa, sum(n * {p} * (1 - {p}) * x1) as hab,
        sum(n * {p} * (1 - {p}) * x1 * x1) as hbb, sum(s * ln({p}) + (n - s) * ln(1 - {p})) as llf,
        sum(s) * ln(sum(s) / sum(n)) + (sum(n) - sum(s)) * ln(1 - sum(s) / sum(n)) as llnull from {src} d, {prev} q"""


def _logit_one(spark, sf):
    return logit.fit(view(spark, sf, "logit").select("y", "x1"), "y")


@query("logit_simple", f"""
    with f as ({newton_sql()})
    select 'x1' as variable, {rs('b', 6)} as b, {rs('sqrt(haa / (haa * hbb - hab * hab))', 6)} as se,
      {rs('exp(b)', 6)} as odds_ratio from f""")
def logit_simple(spark, sf):
    return rounded(_logit_one(spark, sf).coefficients().select("variable", "b", "se", "odds_ratio"), 6)


@query("logit_fitness", f"""
    select {rs('llf', 2)} as llf, {rs('llnull', 2)} as llnull, {rs('2 * (llf - llnull)', 2)} as lr,
      {rs('1 - llf / llnull', 6)} as pseudo_r2, {rs('4 - 2 * llf', 2)} as aic from ({newton_sql()})""")
def logit_fitness(spark, sf):
    return rounded(_logit_one(spark, sf).summary().select("llf", "llnull", "lr", "pseudo_r2", "aic"), 2, pseudo_r2=6)


@query("logit_sigmoid", f"""
    with f as ({newton_sql()}), r as (select min(x1) as lo, max(x1) as hi from {fx('logit')})
    select {rs('lo + (hi - lo) / 199 * i', 6)} as x1, {rs('1 / (1 + exp(-(a + b * (lo + (hi - lo) / 199 * i))))', 5)} as proba,
      {rs('-a / b', 5)} as boundary from f, r, range(200) t(i)""")
def logit_sigmoid(spark, sf):
    return rounded(_logit_one(spark, sf).sigmoid("x1"), 5, x1=6)


def newton_two_sql(steps: int = 9) -> str:
    """Logit on x1 and x2 by Newton steps over (x1, x2, y) counts of the whole table; the 3 x 3 system by cofactors."""
    src = f"(select x1, x2, count(*) as n, sum(y) as s from {fx('logit')} group by 1, 2)"
    p = "(1 / (1 + exp(-(a + b * x1 + c * x2))))"
    w = f"(n * {p} * (1 - {p}))"
    sums = ", ".join([f"sum({w} * {u} * {v}) as h{i}{j}" for i, u in enumerate(("1", "x1", "x2")) for j, v in enumerate(("1", "x1", "x2")) if i <= j]
                     + [f"sum((s - n * {p}) * {u}) as g{i}" for i, u in enumerate(("1", "x1", "x2"))])
    minors = ("h11 * h22 - h12 * h12 as k00, h02 * h12 - h01 * h22 as k01, h01 * h12 - h02 * h11 as k02, h00 * h22 - h02 * h02 as k11, "
              "h01 * h02 - h00 * h12 as k12, h00 * h11 - h01 * h01 as k22")
    prev = "(select 0.0::double as a, 0.0::double as b, 0.0::double as c)"
    for _ in range(steps):
        prev = (f"(select a + (k00 * g0 + k01 * g1 + k02 * g2) / det as a, b + (k01 * g0 + k11 * g1 + k12 * g2) / det as b, c + (k02 * g0 + k12 * g1 + k22 * g2) / det as c "
                f"from (select *, h00 * k00 + h01 * k01 + h02 * k02 as det from (select *, {minors} from (select max(a) as a, max(b) as b, max(c) as c, {sums} from {src} d, {prev} q))))")
    return f"(select *, h00 * k00 + h01 * k01 + h02 * k02 as det from (select *, {minors} from (select max(a) as a, max(b) as b, max(c) as c, {sums} from {src} d, {prev} q)))"


@query("logit_coefficients", f"""
    with f as {newton_two_sql()}, r as (select pow(corr(x1, x2), 2) as r2 from {fx('logit')})
    select 'x1' as variable, {rs('b', 6)} as b, {rs('sqrt(k11 / det)', 6)} as se, {rs('b / sqrt(k11 / det)', 3)} as z, {rs('exp(b)', 6)} as odds_ratio, {rs('1 / (1 - r2)', 6)} as vif from f, r
    union all select 'x2', {rs('c', 6)}, {rs('sqrt(k22 / det)', 6)}, {rs('c / sqrt(k22 / det)', 3)}, {rs('exp(c)', 6)}, {rs('1 / (1 - r2)', 6)} from f, r""")
def logit_coefficients(spark, sf):
    out = logit.fit(view(spark, sf, "logit").select("y", "x1", "x2"), "y").coefficients()
    return rounded(out.select("variable", "b", "se", "z", "odds_ratio", "vif"), 6, z=3)


@query("logit_prepared")
def logit_prepared(spark, sf):
    m = logit.prepared_fit(view(spark, sf, "logit"), "y", outlier=True, scale=True, eliminate=True)
    return rounded(m.coefficients(), 6)


@query("logit_box_tidwell")
def logit_box_tidwell(spark, sf):
    m = logit.fit(view(spark, sf, "logit").select("y", "x1", "x2").persist(), "y")
    return logit.box_tidwell(m)


@query("logit_fix_linearity")
def logit_fix_linearity(spark, sf):
    m = logit.fix_linearity(view(spark, sf, "logit").select("y", "x1", "x2").persist(), "y")
    return rounded(core.rows_frame(spark, m.history, logit.HISTORY_SCHEMA), 4)


@query("logit_compare")
def logit_compare(spark, sf):
    df = view(spark, sf, "logit").select("y", "x1", "x2").persist()
    return logit.compare({"one": logit.fit(df, "y", ["x1"]), "two": logit.fit(df, "y")})[0]


# -------------------------------------------------------------------- metrics
_CONF = (f"(select count(*) filter (where y = 0 and p <= 0.5) as tn, count(*) filter (where y = 0 and p > 0.5) as fp, "
         f"count(*) filter (where y = 1 and p <= 0.5) as fn, count(*) filter (where y = 1 and p > 0.5) as tp from {fx('scores')})")
_AUC = (f"(select (sum(rk * pos) - max(np) * (max(np) + 1) / 2) / (max(np) * (max(n) - max(np))) as auc from (select pos, "
        f"coalesce(sum(c) over (order by p rows between unbounded preceding and 1 preceding), 0) + (c + 1) / 2.0 as rk, "
        f"cast(sum(pos) over () as double) as np, cast(sum(c) over () as double) as n from (select p, count(*) as c, sum(y) as pos "
        f"from {fx('scores')} group by 1)))")


@query("confusion", f"select * from {_CONF}")
def confusion(spark, sf):
    return logit.confusion(view(spark, sf, "scores"), "y", "p")


@query("performance", f"""
    select tn, fp, fn, tp, {rs('(tp + tn) / (tp + tn + fp + fn)', 6)} as accuracy, {rs('tp / (tp + fp)', 6)} as precision,
      {rs('tp / (tp + fn)', 6)} as recall, {rs('fp / (fp + tn)', 6)} as fpr, {rs('tn / (tn + fp)', 6)} as specificity,
      {rs('2.0 * tp / (2 * tp + fp + fn)', 6)} as f1, {rs('cast(tp as double) * tn / (cast(fp as double) * fn)', 4)} as dor,
      {rs('auc', 6)} as auc, case when auc >= 0.9 then 'outstanding' when auc >= 0.8 then 'excellent'
        when auc >= 0.7 then 'acceptable' when auc >= 0.6 then 'poor' else 'fail' end as auc_grade from {_CONF}, {_AUC}""")
def performance(spark, sf):
    return rounded(logit.performance(view(spark, sf, "scores"), "y", "p"), 6, dor=4)


@query("roc_auc", f"select {rs('auc', 8)} as auc from {_AUC}")
def roc_auc(spark, sf):
    return rounded(logit.roc_auc(view(spark, sf, "scores"), "y", "p"), 8)


@query("roc_points", f"""
    select p as threshold, {rs('sum(pos) over (order by p desc) / sum(pos) over ()', 6)} as tpr,
      {rs('sum(c - pos) over (order by p desc) / sum(c - pos) over ()', 6)} as fpr
    from (select p, count(*) as c, sum(y) as pos from {fx('scores')} group by 1)""")
def roc_points(spark, sf):
    return rounded(logit.roc_points(view(spark, sf, "scores"), "y", "p"), 6)


@query("threshold_table", f"""
    select t as threshold, {rs('(tp + tn) / (tp + tn + fp + fn)', 3)} as accuracy, {rs('tp / (tp + fp)', 3)} as precision,
      {rs('tp / (tp + fn)', 3)} as recall, {rs('2.0 * tp / (2 * tp + fp + fn)', 3)} as f1, fn, fp
    from (select t, count(*) filter (where y = 0 and p <= t) as tn, count(*) filter (where y = 0 and p > t) as fp,
      count(*) filter (where y = 1 and p <= t) as fn, count(*) filter (where y = 1 and p > t) as tp
      from {fx('scores')}, (values (0.3::double), (0.4::double), (0.5::double), (0.6::double), (0.7::double)) v(t) group by t)""")
def threshold_table(spark, sf):
    return rounded(logit.thresholds(view(spark, sf, "scores"), "y", "p"), 3)


@query("pearson_residual_dw", f"""
    with e as (select {_ORDER_SQL}, (y - p) / sqrt(p * (1 - p)) as e from {fx('scores')})
    select {rs('sum(pow(e - q, 2)) / sum(e * e)', 6)} as dw
    from (select e, lag(e) over (order by {_ORDER_SQL}, e) as q from e)""")
def pearson_residual_dw(spark, sf):
    d = view(spark, sf, "scores")
    e = d.select(*ORDER, ((F.col("y") - F.col("p")) / F.sqrt(F.col("p") * (1 - F.col("p")))).alias("e"))
    return rounded(core.rows_frame(spark, [{"dw": ols.durbin_watson(e, "e", ORDER)["statistic"]}], "dw double"), 6)
