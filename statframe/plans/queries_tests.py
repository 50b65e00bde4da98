"""Registered queries: hypothesis tests and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from statframe.operators import core, correlation, hypothesis
from statframe.plans.registry import fx, query, rounded, rs, view


def k2_sql(src: str, col: str, by: str) -> str:
    """D'Agostino-Pearson K² and p per group."""
    return f"""
    with m as (select {by} as g, cast(count({col}) as double) as n,
        skewness({col}) * (count({col}) - 2) / sqrt(cast(count({col}) as double) * (count({col}) - 1)) as g1,
        kurtosis_pop({col}) + 3 as b2 from {src} group by 1),
      a as (select *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) as y,
        3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) as beta2,
        3 * (n - 1) / (n + 1) as e, 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) as v,
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) as s from m),
      b as (select *, sqrt(2 * (beta2 - 1)) - 1 as w2, (b2 - e) / sqrt(v) as x,
        6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) as ka from a),
      c as (select *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) as z1,
        (1 - 2 / ka) / (1 + x * sqrt(2 / (ka - 4))) as ratio from b),
      d as (select *, (1 - 2 / (9 * ka) - sign(ratio) * pow(abs(ratio), 1.0 / 3)) / sqrt(2 / (9 * ka)) as z2 from c)
    select g, cast(n as bigint) as n, z1 * z1 + z2 * z2 as k2 from d"""


def _k2_query(name: str, source: str, col: str, by: str):
    @query(name, f"select g as \"{by}\", '{col}' as variable, n, {rs('k2', 3)} as statistic, {rs('exp(-k2 / 2)', 6)} as p_value, "
           f"exp(-k2 / 2) >= 0.05 as normal from ({k2_sql(fx(source), col, by)})")
    def run(spark, sf):
        from statframe.operators.quality import normality
        return rounded(normality(view(spark, sf, source), [col], [by]), 3, p_value=6)
    return run


_k2_query("normality_k2", "gauss", "y", "g3")
_k2_query("normality_k2_uniform", "k_group", "y", "g")


def oneway_sql(src: str, y: str, g: str) -> str:
    return f"""
    with c as (select {g} as g, count({y}) as n, avg({y}) as m, var_samp({y}) as v from {src} group by 1),
      t as (select sum(n) as n, count(*) as k, sum(n * m) / sum(n) as gm from c),
      s as (select sum(c.n * (c.m - t.gm) * (c.m - t.gm)) as ssb, sum((c.n - 1) * c.v) as ssw from c, t)
    select cast(t.n as bigint) as n, t.k, ssb, ssw, (ssb / (t.k - 1)) / (ssw / (t.n - t.k)) as f from s, t"""


def levene_src(src: str, y: str, g: str) -> str:
    return f"(select a.{g} as g, abs(a.{y} - b.m) as d from {src} a join (select {g}, median({y}) as m from {src} group by 1) b on a.{g} = b.{g})"


def _levene(name: str, source: str):
    @query(name, f"select n, k, {rs('f', 4)} as f from ({oneway_sql(levene_src(fx(source), 'y', 'g'), 'd', 'g')})")
    def run(spark, sf):
        return rounded(hypothesis.levene(view(spark, sf, source), "y", "g").select("n", "k", "f"))
    return run


_levene("levene", "k_group")
_levene("levene_hetero", "k_group_hetero")


@query("bartlett", f"""
    with c as (select g3, count(y) as n, var_samp(y) as v from {fx('gauss')} group by 1),
      s as (select count(*) as k, sum(n - 1) as m, sum((n - 1) * v) / sum(n - 1) as sp, sum((n - 1) * ln(v)) as lv,
            sum(1.0 / (n - 1)) as inv from c)
    select {rs('(m * ln(sp) - lv) / (1 + (inv - 1.0 / m) / (3 * (k - 1)))')} as statistic,
      cast(k - 1 as double) as df from s""")
def bartlett(spark, sf):
    return rounded(hypothesis.bartlett(hypothesis.group_stats(view(spark, sf, "gauss"), "y", "g3")))


@query("equal_variance", f"""
    select {rs('f')} as levene, 'Levene' as test, {rs('f')} as statistic
    from ({oneway_sql(levene_src(fx('k_group_hetero'), 'y', 'g'), 'd', 'g')})""")
def equal_variance(spark, sf):
    out = hypothesis.equal_variance(view(spark, sf, "k_group_hetero"), "y", "g")
    return rounded(out.select("levene", "test", "statistic"))


def _t_sql(y: str) -> str:
    return f"""
    with c as (select g2, count({y}) as n, avg({y}) as m, var_samp({y}) as v from {fx('gauss')} group by 1),
      p as (select a.n as n1, b.n as n2, a.m as m1, b.m as m2, a.v as v1, b.v as v2 from c a, c b where a.g2 = 'a' and b.g2 = 'b')
    select n1, n2, {rs('m1')} as mean1, {rs('m2')} as mean2,
      {rs('(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2))')} as t_student,
      cast(n1 + n2 - 2 as double) as df_student, {rs('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)')} as t_welch,
      {rs('pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))')} as df_welch from p"""


@query("t_student", _t_sql("y"))
def t_student(spark, sf):
    return rounded(hypothesis.t_statistics(view(spark, sf, "gauss"), "y", "g2"))


@query("t_welch", _t_sql("y_het"))
def t_welch(spark, sf):
    return rounded(hypothesis.t_statistics(view(spark, sf, "gauss"), "y_het", "g2"))


def wilcoxon_sql(src: str, d: str) -> str:
    return f"""
    with d as (select {d} as d from {src} where {d} <> 0), c as (select abs(d) as a, count(*) as n, count(*) filter (where d > 0) as p from d group by 1),
      k as (select *, coalesce(sum(n) over (order by a rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2.0 as rk from c)
    select cast(sum(n) as double) as n, cast(sum(rk * p) as double) as r_plus, cast(sum(rk * (n - p)) as double) as r_minus,
      cast(sum(cast(n as double) * n * n - n) as double) as ties from k"""


def _wilcoxon(name: str, source: str, a: str, b: str | None, shift: float = 0.0):
    d = f"({a} - {b})" if b else f"({a} - {shift})"
    @query(name, f"select n, {rs('r_plus', 1)} as r_plus, {rs('r_minus', 1)} as r_minus, ties from ({wilcoxon_sql(fx(source), d)})")
    def run(spark, sf):
        df = view(spark, sf, source)
        diff = F.col(a) - (F.col(b) if b else F.lit(shift))
        s = hypothesis.wilcoxon_sums(df, diff)
        row = {"n": s["n"], "r_plus": s["r_plus"], "r_minus": s["total"] - s["r_plus"], "ties": s["ties"]}
        return rounded(core.rows_frame(spark, [row], "n double, r_plus double, r_minus double, ties double"), 1)
    return run


_wilcoxon("wilcoxon_w", "paired", "after_v", "before_v")
_wilcoxon("wilcoxon_one_sample", "k_group", "y", None, 25.0)


def _direction_rows(name: str, statistic: dict[str, str], src: str) -> str:
    return " union all ".join(f"select '{name}' as test, '{a}' as alternative, {rs(e)} as statistic from ({src})"
                              for a, e in statistic.items())


@query("paired", _direction_rows("Wilcoxon signed-rank test", {
    "two-sided": "least(r_plus, r_minus)", "less": "r_plus", "greater": "r_plus"},
    wilcoxon_sql(fx("paired"), "(after_v - before_v)")))
def paired(spark, sf):
    return hypothesis.paired(view(spark, sf, "paired"), "before_v", "after_v").select("test", "alternative", "statistic")


@query("one_sample", _direction_rows("Wilcoxon signed-rank test", {
    "two-sided": "least(r_plus, r_minus)", "less": "r_plus", "greater": "r_plus"},
    wilcoxon_sql(fx("k_group"), "(y - 25.0)")))
def one_sample(spark, sf):
    return hypothesis.one_sample(view(spark, sf, "k_group"), "y", 25.0).select("test", "alternative", "statistic")


def u_sql(src: str, a: str, b: str) -> str:
    return f"""
    with c as (select y, count(*) as n, count(*) filter (where g = '{a}') as c1 from {src} where g in ('{a}', '{b}') group by 1),
      k as (select *, coalesce(sum(n) over (order by y rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2.0 as rk from c),
      s as (select cast(sum(c1) as double) as n1, cast(sum(n) as double) as n, cast(sum(rk * c1) as double) as r1,
            sum(cast(n as double) * n * n - n) as ties from k)
    select cast(n1 as bigint) as n1, cast(n - n1 as bigint) as n2, r1 - n1 * (n1 + 1) / 2 as u, ties,
      n1 * (n - n1) / 2 as mean_u, sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))) as sd_u from s"""


@query("mannwhitney_u", f"select n1, n2, {rs('u', 1)} as u, {rs('ties', 1)} as ties, {rs('mean_u', 1)} as mean_u, "
       f"{rs('sd_u', 3)} as sd_u from ({u_sql(fx('two_group'), 'purchase', 'view')})")
def mannwhitney_u(spark, sf):
    return rounded(hypothesis.u_statistics(view(spark, sf, "two_group"), "y", "g", ["purchase", "view"]), 1, sd_u=3)


@query("two_sample", _direction_rows("Mann-Whitney U test", {a: "u" for a in hypothesis.ALTERNATIVES},
                                     u_sql(fx("two_group"), "purchase", "view")))
def two_sample(spark, sf):
    return hypothesis.two_sample(view(spark, sf, "two_group"), "y", "g").select("test", "alternative", "statistic")


# purchase against all other events, so that all rows count
@query("mannwhitney_u_rest", f"select n1, n2, {rs('u', 1)} as u, {rs('ties', 1)} as ties, {rs('mean_u', 1)} as mean_u, "
       f"{rs('sd_u', 3)} as sd_u from ({u_sql(fx('two_group_rest'), 'purchase', 'rest')})")
def mannwhitney_u_rest(spark, sf):
    return rounded(hypothesis.u_statistics(view(spark, sf, "two_group_rest"), "y", "g", ["purchase", "rest"]), 1, sd_u=3)


@query("two_sample_rest", _direction_rows("Mann-Whitney U test", {a: "u" for a in hypothesis.ALTERNATIVES},
                                          u_sql(fx("two_group_rest"), "purchase", "rest")))
def two_sample_rest(spark, sf):
    return hypothesis.two_sample(view(spark, sf, "two_group_rest"), "y", "g").select("test", "alternative", "statistic")


@query("two_sample_p")
def two_sample_p(spark, sf):
    return hypothesis.two_sample(view(spark, sf, "gauss"), "y", "g2")


@query("anova", f"""
    select 'g' as source, 'ANOVA' as test, n, cast(k - 1 as double) as df1, cast(n - k as double) as df2, {rs('f')} as f,
      {rs('ssb / (ssb + ssw)', 6)} as np2, true as equal_var,
      case when ssb / (ssb + ssw) >= 0.14 then 'Large' when ssb / (ssb + ssw) >= 0.06 then 'Medium'
           when ssb / (ssb + ssw) >= 0.01 then 'Small' else 'Negligible' end as effect_size
    from ({oneway_sql(fx('k_group'), 'y', 'g')})""")
def anova(spark, sf):
    return rounded(hypothesis.anova(view(spark, sf, "k_group"), "y", "g").select(
        "source", "test", "n", "df1", "df2", "f", "np2", "equal_var", "effect_size"), np2=6)


@query("welch_anova", f"""
    with c as (select g, cast(count(y) as double) as n, avg(y) as m, var_samp(y) as v from {fx('k_group_hetero')} group by 1),
      w as (select *, n / v as w, sum(n / v) over () as sw, sum(n / v * m) over () / sum(n / v) over () as wm, count(*) over () as k from c),
      s as (select max(k) as k, sum(w * (m - wm) * (m - wm)) / (max(k) - 1) as top,
            3 * sum((1 - w / sw) * (1 - w / sw) / (n - 1)) / (max(k) * max(k) - 1) as lam from w)
    select 'Welch ANOVA' as test, {rs('top / (1 + 2 * lam * (k - 2) / 3)')} as f, cast(k - 1 as double) as df1,
      {rs('1 / lam', 3)} as df2 from s""")
def welch_anova(spark, sf):
    return rounded(hypothesis.anova(view(spark, sf, "k_group_hetero"), "y", "g").select("test", "f", "df1", "df2"), df2=3)


@query("anova_by_segment", f"""
    with c as (select o_orderstatus, o_orderpriority as g, cast(count(*) as double) as n, avg(o_totalprice) as m,
        var_samp(o_totalprice) as v from orders group by 1, 2),
      t as (select o_orderstatus, sum(n) as n, count(*) as k, sum(n * m) / sum(n) as gm from c group by 1)
    select c.o_orderstatus, cast(max(t.n) as bigint) as n,
      {rs('sum(c.n * (c.m - t.gm) * (c.m - t.gm)) / (sum(c.n * (c.m - t.gm) * (c.m - t.gm)) + sum((c.n - 1) * c.v))', 8)} as np2
    from c join t on c.o_orderstatus = t.o_orderstatus group by 1""")
def anova_by_segment(spark, sf):
    from statframe.plans.registry import table
    out = hypothesis.anova(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority", ["o_orderstatus"])
    return rounded(out.select("o_orderstatus", "n", "np2"), np2=8)


def pairs_sql(src: str, se: str, label: str) -> str:
    return f"""
    with c as (select g, cast(count(y) as double) as n, avg(y) as m, var_samp(y) as v from {src} group by 1),
      t as (select sum((n - 1) * v) / (sum(n) - count(*)) as mse from c),
      p as (select a.g as a, b.g as b, a.m - b.m as diff, {se} as se,
        sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) as sp, a.n + b.n as nn from c a join c b on a.g < b.g, t)
    select a, b, '{label}' as test, {rs('diff')} as diff, {rs('se')} as se, {rs('diff / se')} as t,
      {rs('diff / sp * (1 - 3 / (4 * nn - 9))', 6)} as hedges from p"""


@query("posthoc_pairs", pairs_sql(fx("k_group"), "sqrt(mse / a.n + mse / b.n)", "Tukey HSD"))
def posthoc_pairs(spark, sf):
    return rounded(hypothesis.posthoc(view(spark, sf, "k_group"), "y", "g").select(
        "a", "b", "test", "diff", "se", "t", "hedges"), hedges=6)


@query("posthoc_games_howell", pairs_sql(fx("k_group_hetero"), "sqrt(a.v / a.n + b.v / b.n)", "Games-Howell"))
def posthoc_games_howell(spark, sf):
    return rounded(hypothesis.posthoc(view(spark, sf, "k_group_hetero"), "y", "g").select(
        "a", "b", "test", "diff", "se", "t", "hedges"), hedges=6)


# upper 5 % points of the studentised range for 3 and 4 groups and many degrees of freedom
RANGE_3, RANGE_4 = 3.31449, 3.63316


@query("posthoc_extremes", f"""
    with p as ({pairs_sql(fx("k_group"), "sqrt(mse / a.n + mse / b.n)", "Tukey HSD")}), s as (select *, abs(t) * sqrt(2) > {RANGE_3} as significant from p),
      h as (select * from s order by abs(diff) desc, a, b limit 1), l as (select * from s order by abs(diff), a, b limit 1)
    select h.a as largest_a, h.b as largest_b, h.diff as largest_diff, h.significant as largest_significant,
      l.a as smallest_a, l.b as smallest_b, l.diff as smallest_diff, l.significant as smallest_significant from h, l""")
def posthoc_extremes(spark, sf):
    pairs = hypothesis.posthoc(view(spark, sf, "k_group"), "y", "g")
    return rounded(hypothesis.posthoc_extremes(pairs).select(
        *[F.col(f"{k}.{f}").alias(f"{k}_{f}") for k in ("largest", "smallest") for f in ("a", "b", "diff", "significant")]))


@query("anova_two_way")
def anova_two_way(spark, sf):
    return rounded(hypothesis.anova2(view(spark, sf, "two_factor"), "y", ["a", "b"]))


# a factor of two levels against one of many: every sum of squares has a closed form, weights n1 n2 / (n1 + n2) per level
_TWO_BY = """(select case when o_custkey % 2 = 0 then 'even' else 'odd' end as a, o_orderpriority as b, o_totalprice as y from orders)"""


@query("anova_two_way_closed", f"""
    with c as (select a, b, cast(count(*) as double) as n, avg(y) as m, var_samp(y) as v from {_TWO_BY} group by 1, 2),
      w as (select x.b, x.n * z.n / (x.n + z.n) as w, x.m - z.m as d from c x join c z on x.b = z.b and x.a = 'even' and z.a = 'odd'),
      t as (select sum(n) as n, sum(n * m) / sum(n) as gm, sum((n - 1) * v) as rss, count(*) as cells, count(distinct b) as k from c),
      sa as (select sum(g.n * pow(g.m - gm, 2)) as ss from (select a, sum(n) as n, sum(n * m) / sum(n) as m from c group by 1) g, t),
      sb as (select sum(g.n * pow(g.m - gm, 2)) as ss from (select b, sum(n) as n, sum(n * m) / sum(n) as m from c group by 1) g, t),
      d as (select pow(sum(w * d), 2) / sum(w) as a, sum(w * d * d) - pow(sum(w * d), 2) / sum(w) as ab from w),
      r as (select 'a' as source, d.a as ss, cast(1 as double) as df from d
            union all select 'b', sb.ss + d.a - sa.ss, cast(k - 1 as double) from sa, sb, d, t union all select 'a:b', d.ab, cast(k - 1 as double) from d, t)
    select source, {rs('ss / rss', 8)} as ss_share, df, {rs('ss / df / (rss / (n - cells))', 5)} as f, {rs('ss / (ss + rss)', 8)} as np2 from r, t""")
def anova_two_way_closed(spark, sf):
    from statframe.plans.registry import table
    df = table(spark, sf, "orders").select(F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd").alias("a"),
                                           F.col("o_orderpriority").alias("b"), F.col("o_totalprice").alias("y"))
    out = hypothesis.anova2(df, "y", ["a", "b"])
    rest = out.where("source = 'Residual'").select(F.col("ss").alias("rss"))
    return rounded(out.where("source <> 'Residual'").join(F.broadcast(rest)).select("source", (F.col("ss") / F.col("rss")).alias("ss_share"), "df", "f", "np2"), 8, f=5)


# three levels against many: the additive fit solves two equations for what is left of the three
_THREE_BY = """(select 'r' || (o_custkey % 3) as a, o_orderpriority as b, o_totalprice as y from orders)"""


@query("anova_two_way_three", f"""
    with c as (select a, b, cast(count(*) as double) as n, avg(y) as m, var_samp(y) as v from {_THREE_BY} group by 1, 2),
      t as (select sum(n) as n, sum(n * m) / sum(n) as gm, sum((n - 1) * v) as rss, count(*) as cells, count(distinct a) as ka, count(distinct b) as kb from c),
      l as (select b, sum(n) as w, sum(n * m) / sum(n) as mb from c group by b),
      x as (select l.b, l.w, coalesce(sum(c.n) filter (where a = 'r1'), 0) as w1, coalesce(sum(c.n) filter (where a = 'r2'), 0) as w2,
              coalesce(sum(c.n * (c.m - mb)) filter (where a = 'r1'), 0) as r1, coalesce(sum(c.n * (c.m - mb)) filter (where a = 'r2'), 0) as r2
            from l join c on c.b = l.b group by l.b, l.w),
      e as (select sum(r1) as r1, sum(r2) as r2, sum(w1 - w1 * w1 / w) as s11, sum(w2 - w2 * w2 / w) as s22, sum(-w1 * w2 / w) as s12 from x),
      d as (select (r1 * r1 * s22 - 2 * r1 * r2 * s12 + r2 * r2 * s11) / (s11 * s22 - s12 * s12) as a from e),
      sa as (select sum(g.n * pow(g.m - gm, 2)) as ss from (select a, sum(n) as n, sum(n * m) / sum(n) as m from c group by 1) g, t),
      sb as (select sum(l.w * pow(l.mb - gm, 2)) as ss from l, t), cells as (select sum(c.n * pow(c.m - gm, 2)) as ss from c, t),
      r as (select 'a' as source, d.a as ss, cast(ka - 1 as double) as df from d, t
            union all select 'b', sb.ss + d.a - sa.ss, cast(kb - 1 as double) from sa, sb, d, t
            union all select 'a:b', cells.ss - sb.ss - d.a, cast(cells - ka - kb + 1 as double) from cells, sb, d, t)
    select source, {rs('ss / rss', 8)} as ss_share, df, {rs('ss / df / (rss / (n - cells))', 5)} as f, {rs('ss / (ss + rss)', 8)} as np2 from r, t""")
def anova_two_way_three(spark, sf):
    from statframe.plans.registry import table
    df = table(spark, sf, "orders").select(F.concat(F.lit("r"), F.col("o_custkey") % 3).alias("a"), F.col("o_orderpriority").alias("b"), F.col("o_totalprice").alias("y"))
    out = hypothesis.anova2(df, "y", ["a", "b"])
    rest = out.where("source = 'Residual'").select(F.col("ss").alias("rss"))
    return rounded(out.where("source <> 'Residual'").join(F.broadcast(rest)).select("source", (F.col("ss") / F.col("rss")).alias("ss_share"), "df", "f", "np2"), 8, f=5)


@query("anova_two_way_residual", f"""
    with c as (select a, b, count(*) as n, var_samp(y) as v from {fx('two_factor')} group by 1, 2)
    select 'Residual' as source, {rs('sum((n - 1) * v)', 2)} as ss, cast(sum(n) - count(*) as double) as df from c""")
def anova_two_way_residual(spark, sf):
    out = hypothesis.anova2(view(spark, sf, "two_factor"), "y", ["a", "b"])
    return rounded(out.where("source = 'Residual'").select("source", "ss", "df"), 2)


@query("posthoc_two_way", pairs_sql(f"(select a || ', ' || b as g, y from {fx('two_factor')})",
                                    "sqrt(mse / a.n + mse / b.n)", "Tukey HSD"))
def posthoc_two_way(spark, sf):
    return rounded(hypothesis.posthoc2(view(spark, sf, "two_factor"), "y", ["a", "b"]).select(
        "a", "b", "test", "diff", "se", "t", "hedges"), hedges=6)


@query("posthoc_two_way_levels", f"""
    with p as ({pairs_sql(f"(select a || ', ' || b as g, y from {fx('two_factor')})", "sqrt(mse / a.n + mse / b.n)", "Tukey HSD")}),
      f as (select split_part(a, ', ', 1) as x, split_part(b, ', ', 1) as y, abs(t) * sqrt(2) > {RANGE_4} as significant from p),
      l as (select x as level from f union select y from f)
    select level, count(*) filter (where x = level and y = level) as pairs,
      count(*) filter (where x = level and y = level and significant) as significant_pairs from l, f group by 1""")
def posthoc_two_way_levels(spark, sf):
    return hypothesis.posthoc2_levels(hypothesis.posthoc2(view(spark, sf, "two_factor"), "y", ["a", "b"]))


@query("chi2_gof", f"""
    with c as (select o_orderpriority, count(*) as n from orders group by 1),
      s as (select sum(n) as n, count(*) as k from c),
      x as (select sum((c.n - s.n / s.k) * (c.n - s.n / s.k) / (s.n / s.k)) as chi2, max(s.n) as n, max(s.k) as k from c, s)
    select {rs('chi2')} as chi2, cast(k - 1 as integer) as dof, {rs('exp(-chi2 / 2) * (1 + chi2 / 2)', 6)} as p_value,
      {rs('sqrt(chi2 / n)')} as effect_w, {rs('n / k', 2)} as min_expected, n / k >= 5 as assumption from x""")
def chi2_gof(spark, sf):
    return rounded(hypothesis.chi2_gof(view(spark, sf, "cat35"), "o_orderpriority").select(
        "chi2", "dof", "p_value", "effect_w", "min_expected", "assumption"), 6)


def chi2_sql(src: str, x: str, y: str, yates: bool, p: str) -> str:
    # a 2x2 table that breaks the assumption goes to Fisher and shows no statistic
    shown = lambda e: f"(case when share >= 0.8 and min_e >= 1 then {e} end)" if yates else e
    term = "pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e" if yates else "pow(o - e, 2) / e"
    return f"""
    with o as (select {x} as x, {y} as y, count(*) as o from {src} group by 1, 2),
      r as (select x, sum(o) as rn from o group by 1), c as (select y, sum(o) as cn from o group by 1),
      g as (select r.x, c.y, coalesce(o.o, 0) as o, cast(rn as double) * cn / sum(o.o) over () as e
            from r cross join c left join o on o.x = r.x and o.y = c.y),
      s as (select sum({term}) as chi2, sum(o) as n, count(distinct x) as nr, count(distinct y) as nc, min(e) as min_e,
            avg(case when e >= 5 then 1.0 else 0.0 end) as share from g)
    select {shown(rs('chi2'))} as chi2, {shown('cast((nr - 1) * (nc - 1) as integer)')} as dof{p},
      {rs('sqrt(chi2 / (n * (least(nr, nc) - 1)))')} as effect_v, {rs('min_e', 2)} as min_expected,
      share >= 0.8 and min_e >= 1 as assumption from s"""


@query("chi2_independence", chi2_sql(fx("cat35"), "o_orderstatus", "o_orderpriority", False, ", " + rs(
    "exp(-chi2 / 2) * (1 + chi2 / 2 + pow(chi2 / 2, 2) / 2 + pow(chi2 / 2, 3) / 6)", 6) + " as p_value"))
def chi2_independence(spark, sf):
    return rounded(hypothesis.chi2_table(view(spark, sf, "cat35"), "o_orderstatus", "o_orderpriority").select(
        "chi2", "dof", "p_value", "effect_v", "min_expected", "assumption"), 6)


@query("chi2_yates", chi2_sql(fx("cat22"), "quality", "toxic", True, ""))
def chi2_yates(spark, sf):
    return rounded(hypothesis.chi2_homogeneity(view(spark, sf, "cat22"), "quality", "toxic").select(
        "chi2", "dof", "effect_v", "min_expected", "assumption"))


def rank_sql(src: str, col: str) -> str:
    return (f"(select v, coalesce(sum(n) over (order by v rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2.0 as rk "
            f"from (select {col} as v, count(*) as n from {src} group by 1))")


def corr_sql(src: str, pairs: list[tuple[str, str]]) -> str:
    out = []
    for x, y in pairs:
        out.append(f"""
        select '{x}' as x, '{y}' as y, (select {rs(f'corr({x}, {y})', 6)} from {src}) as pearson,
          (select {rs('corr(a.rk, b.rk)', 6)} from {src} t join {rank_sql(src, x)} a on t.{x} = a.v
             join {rank_sql(src, y)} b on t.{y} = b.v) as spearman,
          (select {rs(f'corr({x}, {y})', 6)} from {src}, (select quantile_cont({x}, 0.25) as qx1, quantile_cont({x}, 0.75) as qx3,
             quantile_cont({y}, 0.25) as qy1, quantile_cont({y}, 0.75) as qy3 from {src}) where {x} between qx1 - 1.5 * (qx3 - qx1)
             and qx3 + 1.5 * (qx3 - qx1) and {y} between qy1 - 1.5 * (qy3 - qy1) and qy3 + 1.5 * (qy3 - qy1)) as pearson_trimmed,
          (select count(*) from {src}) as n""")
    return " union all ".join(out)


REG = ["y", "x1", "x2", "x3", "x4"]
_PAIRS = [(a, b) for i, a in enumerate(REG) for b in REG[i + 1:]]


@query("correlation_pairs", corr_sql(fx("reg"), _PAIRS))
def correlation_pairs(spark, sf):
    out = correlation.correlation_pairs(view(spark, sf, "reg"), REG)
    return rounded(out.select("x", "y", "pearson", "spearman", "pearson_trimmed", "n"), 6)


@query("correlation", corr_sql(fx("skew"), [("right_pos", "left_tail")]))
def correlation_one(spark, sf):
    out = correlation.correlation(view(spark, sf, "skew"), "right_pos", "left_tail")
    return rounded(out.select("x", "y", "pearson", "spearman", "pearson_trimmed", "n"), 6)


@query("correlation_nulls", corr_sql(f"(select cast(user_id as double) as user_id, value_n from {fx('nulls')} where value_n is not null)",
                                     [("user_id", "value_n")]))
def correlation_nulls(spark, sf):
    out = correlation.correlation(view(spark, sf, "nulls"), "user_id", "value_n")
    return rounded(out.select("x", "y", "pearson", "spearman", "pearson_trimmed", "n"), 6)


# no variable passes the normality check, so every coefficient is a rank correlation
_MIRROR = f"""
    with p as (select x, y, round(spearman, 4) as coef from ({corr_sql(fx("reg"), _PAIRS)})),
      m as (select x, y, coef from p union all select y, x, coef from p)"""


@query("correlation_matrix", f"""{_MIRROR}, u as (select * from m union all select distinct x, x, 1.0 from m)
    select x as variable, """ + ", ".join(f"max(case when y = '{c}' then coef end) as {c}" for c in sorted(REG)) + " from u group by 1")
def correlation_matrix(spark, sf):
    return correlation.correlation_matrix(correlation.correlation_pairs(view(spark, sf, "reg"), REG))


@query("correlation_summary", f"""{_MIRROR}
    select x as variable, first(y order by abs(coef) desc, y) as max_y, first(coef order by abs(coef) desc, y) as max_coef,
      count(*) filter (where abs(coef) > 0.7) as count,
      coalesce(string_agg(y, ', ' order by abs(coef) desc, y) filter (where abs(coef) > 0.7), '-') as partners from m group by 1""")
def correlation_summary(spark, sf):
    return correlation.correlation_summary(correlation.correlation_pairs(view(spark, sf, "reg"), REG))


@query("vif_pair", " union all ".join(
    f"select '{c}' as variable, {rs('1 / (1 - pow(corr(l_quantity, l_extendedprice), 2))', 6)} as vif from lineitem"
    for c in ("l_extendedprice", "l_quantity")))
def vif_pair(spark, sf):
    return rounded(correlation.vif(view(spark, sf, "numeric"), ["l_quantity", "l_extendedprice"]), 6)


@query("vif", f"""
    with m as (select corr(x1, x2) as a, corr(x1, x3) as b, corr(x2, x3) as c from {fx('reg')}),
      d as (select *, 1 + 2 * a * b * c - a * a - b * b - c * c as det from m)
    select 'x1' as variable, {rs('(1 - c * c) / det', 6)} as vif from d
    union all select 'x2', {rs('(1 - b * b) / det', 6)} from d union all select 'x3', {rs('(1 - a * a) / det', 6)} from d""")
def vif(spark, sf):
    return rounded(correlation.vif(view(spark, sf, "reg"), ["x1", "x2", "x3"]), 6)


@query("tukey_p_values")
def tukey_p_values(spark, sf):
    return rounded(hypothesis.posthoc(view(spark, sf, "k_group_hetero"), "y", "g"), 6)


@query("assumptions")
def assumptions(spark, sf):
    return rounded(hypothesis.assumptions(view(spark, sf, "gauss"), "y", "g3"), 6)


