"""Registered queries: exploratory analysis and variable selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from statframe.operators import core
from statframe.plans import eda
from statframe.plans.queries_tests import corr_sql, levene_src, oneway_sql, u_sql
from statframe.plans.registry import fx, query, rounded, rs, table, view

_FEATURES = ["x1", "x2", "x3", "x4", "c1", "c2"]


def _reg(spark, sf):
    return view(spark, sf, "reg").select("y", *_FEATURES)


def _discrete_sql(src: str, cols: list[str]) -> str:
    return " union all ".join(f"""
      select '{c}' as variable, (select count(distinct {c}) from {src}) as unique,
        {rs(f'(select count(distinct {c}) from {src}) / n', 6)} as unique_share,
        {rs(f'(select {c} from {src} group by 1 order by count(*) desc, 1 limit 1)', 4)} as mode,
        {rs(f'(select max(k) from (select count(*) as k from {src} group by {c})) / n', 6)} as mode_share,
        {rs('ints / n', 6)} as integer_share, zeros,
        case when zeros > 0 then 'zeros' when ints / n >= 0.9 then 'integer grid'
             when (select count(distinct {c}) from {src}) / n <= 0.01 then 'sparse values' else 'continuous' end as discreteness
      from (select count(*) as n, count(*) filter (where {c} = round({c})) as ints, count(*) filter (where {c} = 0) as zeros from {src})""" for c in cols)


@query("continuous_insight", _discrete_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def continuous_insight(spark, sf):
    return rounded(eda.continuous_insight(view(spark, sf, "numeric")).select(
        "variable", "unique", "unique_share", "mode", "mode_share", "integer_share", "zeros", "discreteness"), 6, mode=4)


@query("continuous_verdicts")
def continuous_verdicts(spark, sf):
    return rounded(eda.continuous_insight(view(spark, sf, "skew")), 4)


@query("nominal_insight", """
    with c as (select 'o_orderstatus' as variable, o_orderstatus as v, count(*) as n from orders group by 2
               union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2),
      s as (select variable, count(*) as levels, cast(max(n) as bigint) as top_n, cast(min(n) as bigint) as bottom_n, max(n) / min(n) as fold from c group by 1)
    select variable, levels, top_n, bottom_n, """ + rs("fold") + """ as fold, case when fold < 2 then 'balanced' when fold < 5 then 'fairly balanced'
      when fold < 15 then 'somewhat imbalanced' else 'imbalanced' end as balance from s""")
def nominal_insight(spark, sf):
    out = eda.nominal_insight(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])
    return rounded(out.select("variable", "levels", "top_n", "bottom_n", "fold", "balance"))


_KINDS = ("continuous", "nominal, 2 levels", "nominal, 3+ levels")
_ANALYSIS = {("continuous", "continuous"): "correlation", ("continuous", _KINDS[1]): "two-sample test", ("continuous", _KINDS[2]): "ANOVA",
             (_KINDS[1], "continuous"): "two-sample test", (_KINDS[2], "continuous"): "ANOVA"}


@query("scope", f"""
    with l as (select 'c1' as c, count(distinct c1) as k from {fx('reg')} union all select 'c2', count(distinct c2) from {fx('reg')}),
      f as (select 'continuous' as kind, 'x1, x2, x3, x4' as names union all select '{_KINDS[1]}', coalesce(string_agg(c, ', ' order by c) filter (where k = 2), '') from l
            union all select '{_KINDS[2]}', coalesce(string_agg(c, ', ' order by c) filter (where k >= 3), '') from l),
      m as (select * from (values """ + ", ".join(f"('{t}', '{f}', '{_ANALYSIS.get((t, f), 'chi-square')}')" for t in _KINDS for f in _KINDS) + """) v(t, k, analysis))
    select t as target_kind, k as feature_kind, analysis, t = 'continuous' and names <> '' as applies, case when t = 'continuous' then names else '' end as features
    from m join f on m.k = f.kind""")
def scope(spark, sf):
    return eda.scope(_reg(spark, sf), "y")


@query("target_correlation", f"""
    select x as variable, round(spearman, 4) as effect from ({corr_sql(fx('reg'), [(c, 'y') for c in ('x1', 'x2', 'x3', 'x4')])})""")
def target_correlation(spark, sf):
    rows = eda.correlation_tests(_reg(spark, sf), "y", ["x1", "x2", "x3", "x4"])
    return rounded(core.rows_frame(spark, rows, eda.TEST_SCHEMA).select("variable", "effect"), 4)


# verdicts from significance (t of the coefficient; the samples are large) and the size of the coefficient
@query("target_verdicts", f"""
    with c as (select x as variable, round(spearman, 4) as r from ({corr_sql(fx('reg'), [(c, 'y') for c in ('x1', 'x2', 'x3', 'x4')])})),
      n as (select count(*) as n from {fx('reg')})
    select variable, case when abs(r) * sqrt((n - 2) / (1 - r * r)) < 1.965 then 'reject' when abs(r) >= 0.3 then 'accept' else 'candidate' end as verdict from c, n""")
def target_verdicts(spark, sf):
    rows = eda.correlation_tests(_reg(spark, sf), "y", ["x1", "x2", "x3", "x4"])
    return core.rows_frame(spark, rows, eda.TEST_SCHEMA).select("variable", "verdict")


_TWO = f"(select c2 as g, y from {fx('reg')})"


@query("target_two_group", f"select 'c2' as variable, 'Mann-Whitney U test' as test, {rs('u', 1)} as statistic from ({u_sql(_TWO, 'F', 'O')})")
def target_two_group(spark, sf):
    rows = eda.two_group_tests(_reg(spark, sf), [("c2", "y", "c2")])
    return rounded(core.rows_frame(spark, rows, eda.TEST_SCHEMA).select("variable", "test", "statistic"), 1)


_THREE = f"(select c1 as g, y from {fx('reg')})"


@query("target_many_group", f"""
    select 'c1' as variable, {rs('ssb / (ssb + ssw)', 8)} as effect from ({oneway_sql(_THREE, 'y', 'g')})""")
def target_many_group(spark, sf):
    rows = eda.many_group_tests(_reg(spark, sf), [("c1", "y", "c1")])
    return rounded(core.rows_frame(spark, rows, eda.TEST_SCHEMA).select("variable", "effect"), 8)


_CHI = """
    with o as (select l_returnflag as x, l_linestatus as y, count(*) as o from lineitem group by 1, 2),
      r as (select x, sum(o) as rn from o group by 1), c as (select y, sum(o) as cn from o group by 1),
      g as (select r.x, c.y, coalesce(o.o, 0) as o, cast(rn as double) * cn / sum(o.o) over () as e from r cross join c left join o on o.x = r.x and o.y = c.y)
    select 'l_returnflag' as variable, """ + rs("sum(pow(o - e, 2) / e)", 4) + " as statistic from g"


@query("target_tables", _CHI)
def target_tables(spark, sf):
    rows = eda.table_tests(table(spark, sf, "lineitem"), "l_linestatus", ["l_returnflag"])
    return rounded(core.rows_frame(spark, rows, eda.TEST_SCHEMA).select("variable", "statistic"))


@query("target_tests_classification")
def target_tests_classification(spark, sf):
    df = table(spark, sf, "lineitem").select("l_linestatus", "l_returnflag", "l_quantity", "l_extendedprice")
    return rounded(eda.target_tests(df, "l_linestatus"), 4)


@query("selection_table")
def selection_table(spark, sf):
    return rounded(eda.selection_table(_reg(spark, sf), "y"), 4)


@query("choose_representatives", f"""
    with t as (select 'x1' as variable, abs(corr(x1, y)) as effect, 1 as g from {fx('reg')} union all select 'x4', abs(corr(x4, y)), 1 from {fx('reg')}
               union all select 'x2', abs(corr(x2, y)), null from {fx('reg')})
    select variable, case when g is not null and row_number() over (partition by g order by effect desc, variable) > 1 then 'candidate' else 'accept' end as verdict from t""")
def choose_representatives(spark, sf):
    r = _reg(spark, sf).agg(*[F.abs(F.corr(c, "y")).alias(c) for c in ("x1", "x4", "x2")])
    rows = r.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("variable"), F.col(c).alias("effect"), F.lit(0.0).alias("p_value"), F.lit("accept").alias("verdict"),
        F.lit("").alias("reason"), F.lit(1 if c != "x2" else None).cast("int").alias("collinear_group")) for c in ("x1", "x4", "x2")])))
    return eda.choose_representatives(rows).select("variable", "verdict")


_FEATURE_PAIRS = [(a, b) for i, a in enumerate(("x1", "x2", "x3", "x4")) for b in ("x1", "x2", "x3", "x4")[i + 1:]]


@query("collinear_groups", f"""
    with recursive p as (select x, y from ({corr_sql(fx('reg'), _FEATURE_PAIRS)}) where abs(round(spearman, 4)) >= 0.7),
      e as (select x, y from p union all select y, x from p), r as (select x as v, x as root from e union select e.y, r.root from r join e on e.x = r.v),
      g as (select v, min(root) as root from r group by 1)
    select v as variable, cast(dense_rank() over (order by root) as integer) as collinear_group from g""")
def collinear_groups(spark, sf):
    return eda.feature_correlation(_reg(spark, sf), "y")["groups"]


@query("correlation_insight")
def correlation_insight(spark, sf):
    return rounded(eda.correlation_insight(_reg(spark, sf), "y", ["x1", "x2"]), 4)


@query("anova_insight")
def anova_insight(spark, sf):
    return rounded(eda.anova_insight(_reg(spark, sf), [("c1", "y", "c1")]), 4)


@query("hue_lines", " union all ".join(
    f"select '{h}' as hue, {h} as level, '{x}' as variable, count(*) as n, {rs(f'regr_slope(y, {x})', 4)} as slope, {rs(f'corr(y, {x})', 6)} as corr "
    f"from {fx('reg')} group by 2" for h in ("c1", "c2") for x in ("x1", "x2", "x3", "x4")))
def hue_lines(spark, sf):
    return rounded(eda.hue_lines(_reg(spark, sf), "y"), 6, slope=4)


@query("hetero_signal", f"""
    with l as (select regr_slope(y, x2) as b, regr_intercept(y, x2) as a from {fx('reg')})
    select {rs('count(*) * pow(corr(pow(y - a - b * x2, 2), x2), 2)', 4)} as lm from {fx('reg')}, l""")
def hetero_signal(spark, sf):
    s = eda.hetero_signal(_reg(spark, sf), "x2", "y")
    return rounded(core.rows_frame(spark, [{"lm": s["lm"]}], "lm double"))


@query("quality_report", """
    select 'numeric columns' as item, 2.0::double as value union all select 'nominal columns', 2.0
    union all select 'duplicate rows', cast((select count(*) from lineitem) - (select count(*) from (select distinct l_returnflag, l_linestatus, l_linenumber, l_tax from lineitem)) as double)
    union all select 'missing values', 0.0""")
def quality_report(spark, sf):
    out = eda.quality_check(view(spark, sf, "dups"))["report"]
    return out.where("variable is null").select("item", "value")


@query("quality_report_variables")
def quality_report_variables(spark, sf):
    out = eda.quality_check(view(spark, sf, "dups"))["report"]
    return rounded(out.where("variable is not null"))


@query("levene_by_variable", " union all ".join(
    f"select '{v}' as variable, {rs('f')} as f from ({oneway_sql(levene_src(fx('reg'), 'y', v), 'd', 'g')})" for v in ("c1", "c2")))
def levene_by_variable(spark, sf):
    from statframe.operators import hypothesis
    long = eda._groups_long(_reg(spark, sf), [("c1", "y", "c1"), ("c2", "y", "c2")])
    return rounded(hypothesis.levene(long, "value", "level", ["feature"]).select(F.col("feature").alias("variable"), "f"))


@query("full_analysis")
def full_analysis(spark, sf):
    return rounded(eda.run(_reg(spark, sf), "y")["selection"], 4)


@query("full_analysis_chapters")
def full_analysis_chapters(spark, sf):
    """All chapters in long form: a chapter's rows are JSON texts."""
    long = None
    for chapter, rows in eda.run(_reg(spark, sf), "y").items():
        one = rounded(rows, 4).select(F.lit(chapter).alias("chapter"), F.to_json(F.struct("*")).alias("row"))
        long = one if long is None else long.unionByName(one)
    return long
