"""Registered queries: sources, quality, preprocessing, descriptive aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from statframe.operators import core, prep, quality
from statframe.plans.registry import fx, query, rounded, rs, table, view
from statframe.sources import io


def summary_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""
        select '{c}' as variable, s.n as count, {', '.join(f'{rs("s." + m, 6)} as {m}' for m in ('mean', 'std', 'min', 'q25', 'q50', 'q75', 'max'))},
          {rs("abs(s.mean - s.q50) / nullif(s.q50, 0)", 6)} as rel_diff,
          case when abs(s.mean - s.q50) / nullif(s.q50, 0) < 0.1 then 'similar'
               when abs(s.mean - s.q50) / nullif(s.q50, 0) < 0.5 then 'diff' else 'large_diff' end as rdiff_flag,
          {rs("s.q75 - s.q25", 6)} as iqr, {rs("s.hi", 6)} as upper_bound, {rs("s.lo", 6)} as lower_bound,
          o.u as upper_outliers, {rs("o.u / s.rows", 6)} as upper_outliers_ratio, o.d as lower_outliers,
          {rs("o.d / s.rows", 6)} as lower_outliers_ratio, o.u + o.d as outliers, {rs("(o.u + o.d) / s.rows", 6)} as outliers_ratio,
          {rs("s.skew", 6)} as skew,
          case when s.skew < -0.5 then 'left tail' when s.skew > 0.5 then 'right tail' else 'symmetric' end as skew_interpret,
          {rs("s.kurt", 6)} as kurt,
          case when s.kurt < 0 then 'platykurtic' when s.kurt > 0 then 'leptokurtic' else 'mesokurtic' end as kurt_interpret,
          case when s.skew >= 1 or (s.skew > 0.5 and s.kurt > 0)
                 then case when s.min > 0 then 'log' when s.min = 0 then 'log1p' else 'none' end
               when s.skew <= -1 or (s.skew < -0.5 and s.kurt > 0) then 'reverse_log1p' else 'none' end as log_need
        from (select *, q75 + 1.5 * (q75 - q25) as hi, q25 - 1.5 * (q75 - q25) as lo from (
                select count({c}) as n, count(*) as rows, avg({c}) as mean, stddev_samp({c}) as std, min({c}) as min,
                  quantile_cont({c}, 0.25) as q25, quantile_cont({c}, 0.5) as q50, quantile_cont({c}, 0.75) as q75,
                  max({c}) as max, skewness({c}) as skew, kurtosis({c}) as kurt from {src})) s,
          lateral (select cast(count(*) filter (where {c} > s.hi) as bigint) as u,
                   cast(count(*) filter (where {c} < s.lo) as bigint) as d from {src}) o""")
    return " union all ".join(parts)


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SKEW = ["right_pos", "right_zero", "left_tail", "right_neg"]


@query("numerical_summary", summary_sql(fx("numeric"), NUMERIC))
def numerical_summary(spark, sf):
    return rounded(quality.numerical_summary(view(spark, sf, "numeric")), 6)


@query("numerical_summary_skewed", summary_sql(fx("skew"), SKEW))
def numerical_summary_skewed(spark, sf):
    return rounded(quality.numerical_summary(view(spark, sf, "skew")), 6)


@query("numerical_summary_nulls", summary_sql(fx("nulls"), ["value_n"]))
def numerical_summary_nulls(spark, sf):
    return rounded(quality.numerical_summary(view(spark, sf, "nulls"), ["value_n"]), 6)


@query("numerical_summary_by", f"""
    with s as (select l_returnflag, count(l_extendedprice) as n, avg(l_extendedprice) as mean,
        quantile_cont(l_extendedprice, 0.25) as q25, quantile_cont(l_extendedprice, 0.5) as q50,
        quantile_cont(l_extendedprice, 0.75) as q75, kurtosis(l_extendedprice) as kurt from lineitem group by 1),
      o as (select s.l_returnflag, cast(count(*) filter (where l.l_extendedprice > q75 + 1.5 * (q75 - q25)
                or l.l_extendedprice < q25 - 1.5 * (q75 - q25)) as bigint) as outliers
            from s join lineitem l on s.l_returnflag = l.l_returnflag group by 1)
    select s.l_returnflag, 'l_extendedprice' as variable, n as count, {rs('mean')} as mean, {rs('q25')} as q25,
      {rs('q50')} as q50, {rs('q75')} as q75, {rs('kurt')} as kurt, outliers
    from s join o on s.l_returnflag = o.l_returnflag""")
def numerical_summary_by(spark, sf):
    out = quality.numerical_summary(table(spark, sf, "lineitem"), ["l_extendedprice"], by=["l_returnflag"])
    return rounded(out.select("l_returnflag", "variable", "count", "mean", "q25", "q50", "q75", "kurt", "outliers"))


def _counts_sql(src: str, cols: list[str]) -> str:
    return " union all ".join(
        f"select '{c}' as variable, {c} as value, count(*) as n from {src} where {c} is not null group by 2" for c in cols)


@query("categorical_summary", f"""
    with c as ({_counts_sql('orders', ['o_orderstatus', 'o_orderpriority'])}),
      k as (select *, row_number() over (partition by variable order by n desc, value) as rn from c)
    select variable, cast(sum(n) as bigint) as count, count(*) as unique, max(value) filter (where rn = 1) as top,
      max(n) filter (where rn = 1) as freq from k group by variable""")
def categorical_summary(spark, sf):
    return quality.categorical_summary(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("categorical_summary_nulls", f"""
    with c as ({_counts_sql(fx('nulls'), ['type_n'])}),
      k as (select *, row_number() over (partition by variable order by n desc, value) as rn from c)
    select variable, cast(sum(n) as bigint) as count, count(*) as unique, max(value) filter (where rn = 1) as top,
      max(n) filter (where rn = 1) as freq from k group by variable""")
def categorical_summary_nulls(spark, sf):
    return quality.categorical_summary(view(spark, sf, "nulls"), ["type_n"])


@query("value_counts", f"""
    select variable, value, n as count, {rs('n / sum(n) over (partition by variable)', 6)} as share
    from ({_counts_sql('orders', ['o_orderstatus', 'o_orderpriority'])})""")
def value_counts(spark, sf):
    return rounded(quality.value_counts(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]), 6)


@query("missing_report", " union all ".join(
    f"select '{c}' as variable, count(*) as rows, count(*) - count({c}) as missing, "
    f"{rs(f'100.0 * (count(*) - count({c})) / count(*)')} as missing_pct from {fx('nulls')}"
    for c in ("event_id", "user_id", "value_n", "type_n")))
def missing_report(spark, sf):
    return rounded(quality.missing_report(view(spark, sf, "nulls")))


@query("duplicate_report", f"""
    select count(*) as rows, (select count(*) from (select distinct * from {fx('dups')})) as distinct_rows,
      count(*) - (select count(*) from (select distinct * from {fx('dups')})) as duplicates from {fx('dups')}""")
def duplicate_report(spark, sf):
    return quality.duplicate_report(view(spark, sf, "dups"))


@query("drop_duplicates", f"select distinct * from {fx('dups')}")
def drop_duplicates(spark, sf):
    return quality.drop_duplicates(view(spark, sf, "dups"))


@query("set_type", "select cast(c_custkey as double) as c_custkey, cast(c_nationkey as varchar) as c_nationkey, "
       "cast(round(c_acctbal) as bigint) as acct, c_mktsegment from customer")
def set_type(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.round("c_acctbal").alias("acct"), "c_mktsegment")
    return quality.set_type(df, as_float=["c_custkey"], as_string=["c_nationkey"], as_int=["acct"],
                            as_category=["c_mktsegment"])


def _fill(name: str, method: str, sql: str):
    @query(name, f"select event_id, {rs(sql)} as value_n from {fx('nulls')}")
    def run(spark, sf):
        df = view(spark, sf, "nulls").select("event_id", "value_n")
        return rounded(prep.fill_missing(df, ["value_n"], method))
    return run


for _m, _e in (("mean", "avg"), ("median", "median"), ("max", "max"), ("min", "min")):
    _fill(f"fill_{_m}", _m, f"coalesce(value_n, (select {_e}(value_n) from {fx('nulls')}))")


@query("fill_mode", f"""
    select event_id, coalesce(type_n, (select type_n from {fx('nulls')} where type_n is not null
      group by 1 order by count(*) desc, 1 limit 1)) as type_n from {fx('nulls')}""")
def fill_mode(spark, sf):
    return prep.fill_missing(view(spark, sf, "nulls").select("event_id", "type_n"), ["type_n"], "mode")


@query("fill_value", f"select event_id, coalesce(type_n, 'unknown') as type_n from {fx('nulls')}")
def fill_value(spark, sf):
    return prep.fill_missing(view(spark, sf, "nulls").select("event_id", "type_n"), ["type_n"], "value", "unknown")


@query("drop_missing", f"select event_id, value_n, type_n from {fx('nulls')} where value_n is not null and type_n is not null")
def drop_missing(spark, sf):
    return prep.fill_missing(view(spark, sf, "nulls").select("event_id", "value_n", "type_n"), ["value_n", "type_n"], "drop")


_Q = ("(select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3, avg(value) as m, "
      "stddev_pop(value) as s from events) f")
_LO, _HI = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"


@query("clip_iqr", f"select event_id, {rs(f'least(greatest(value, {_LO}), {_HI})', 6)} as value from events, {_Q}")
def clip_iqr(spark, sf):
    return rounded(prep.clip_outliers(table(spark, sf, "events").select("event_id", "value"), ["value"]), 6)


@query("clip_zscore", f"select event_id, {rs('least(greatest(value, m - 3 * s), m + 3 * s)')} as value from events, {_Q}")
def clip_zscore(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return rounded(prep.OutlierClipper(method="zscore", inputCols=["value"]).fit(df).transform(df))


def _outlier(method: str, agg: str):
    @query(f"outlier_to_{method}", f"""
        with f as (select * from {_Q}), k as (select {agg}(value) as fill from events, f where value between {_LO} and {_HI})
        select event_id, {rs(f'case when value between {_LO} and {_HI} then value else fill end')} as value from events, f, k""")
    def run(spark, sf):
        df = table(spark, sf, "events").select("event_id", "value")
        return rounded(prep.clip_outliers(df, ["value"], method))
    return run


for _m, _e in (("median", "median"), ("mean", "avg")):
    _outlier(_m, _e)


@query("log_cols", f"""
    select {rs('ln(right_pos)')} as right_pos, {rs('ln(1 + right_zero)')} as right_zero,
      {rs(f"ln(1 + (select max(left_tail) from {fx('skew')}) - left_tail)")} as left_tail from {fx('skew')}""")
def log_cols(spark, sf):
    df = view(spark, sf, "skew").select("right_pos", "right_zero", "left_tail")
    return rounded(prep.log_transform(df, ["right_pos"], ["right_zero"], ["left_tail"])[0])


@query("inverse_log", f"select {rs('right_pos')} as right_pos, {rs('right_zero')} as right_zero, {rs('left_tail')} as left_tail from {fx('skew')}")
def inverse_log(spark, sf):
    df = view(spark, sf, "skew").select("right_pos", "right_zero", "left_tail")
    out, recipe = prep.log_transform(df, ["right_pos"], ["right_zero"], ["left_tail"])
    return rounded(prep.inverse_log(out, recipe["log"], recipe["log1p"], recipe["reflect"]))


@query("label_encode", "select o_orderkey, cast(dense_rank() over (order by o_orderpriority) - 1 as integer) as o_orderpriority, "
       "cast(dense_rank() over (order by o_orderstatus) - 1 as integer) as o_orderstatus from orders")
def label_encode(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return prep.label_encode(df, ["o_orderpriority", "o_orderstatus"])


@query("dummies", "select o_orderkey, cast(o_orderstatus = 'O' as integer) as \"o_orderstatus_O\", "
       "cast(o_orderstatus = 'P' as integer) as \"o_orderstatus_P\" from orders")
def dummies(spark, sf):
    return prep.dummies(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


def _scale(method: str, center: str, width: str):
    cols = ["l_quantity", "l_extendedprice"]
    stats = ", ".join(f"{center.format(c=c)} as m_{c}, {width.format(c=c)} as s_{c}" for c in cols)
    @query(f"scale_{method}", f"select {', '.join(f'{rs(f"({c} - m_{c}) / s_{c}")} as {c}' for c in cols)} "
           f"from lineitem, (select {stats} from lineitem)")
    def run(spark, sf):
        return rounded(prep.scale(table(spark, sf, "lineitem").select(*cols), cols, method))
    return run


_scale("standard", "avg({c})", "stddev_pop({c})")
_scale("minmax", "min({c})", "(max({c}) - min({c}))")
_scale("robust", "median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))")
_scale("maxabs", "0.0", "greatest(abs(min({c})), abs(max({c})))")


@query("apply_recipe", f"""
    select y, c1, {rs('x1 - 25.5')} as x1_c, {rs('(x1 - 25.5) * (x1 - 25.5)')} as x1_c2, {rs('ln(x2 + 1)')} as x2_log
    from {fx('logit')}""")
def apply_recipe(spark, sf):
    recipe = {"x1": {"method": "square", "center": 25.5}, "x2": {"method": "log", "shift": 1.0}}
    return rounded(prep.apply_recipe(view(spark, sf, "logit"), recipe))


@query("long_to_wide", """
    with n as (select c_mktsegment, c_acctbal, row_number() over (partition by c_mktsegment order by c_custkey) as rn from customer)
    select rn, max(c_acctbal) filter (where c_mktsegment = 'AUTOMOBILE') as "AUTOMOBILE",
      max(c_acctbal) filter (where c_mktsegment = 'BUILDING') as "BUILDING",
      max(c_acctbal) filter (where c_mktsegment = 'FURNITURE') as "FURNITURE",
      max(c_acctbal) filter (where c_mktsegment = 'HOUSEHOLD') as "HOUSEHOLD",
      max(c_acctbal) filter (where c_mktsegment = 'MACHINERY') as "MACHINERY" from n group by rn""")
def long_to_wide(spark, sf):
    return prep.long_to_wide(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal", ["c_custkey"])


@query("mean_interval", f"""
    select l_returnflag, 'l_quantity' as variable, count(l_quantity) as n, {rs('avg(l_quantity)')} as mean,
      {rs('stddev_samp(l_quantity) / sqrt(count(l_quantity))')} as se from lineitem group by 1""")
def mean_interval(spark, sf):
    out = quality.mean_interval(table(spark, sf, "lineitem"), ["l_quantity"], ["l_returnflag"])
    return rounded(out.select("l_returnflag", "variable", "n", "mean", "se"))


@query("split_columns", """
    select 'c_custkey' as variable, 'continuous' as kind, null::bigint as levels
    union all select 'c_name', 'nominal', count(distinct c_name) from customer
    union all select 'c_nationkey', 'continuous', null union all select 'c_acctbal', 'continuous', null
    union all select 'c_mktsegment', 'nominal', count(distinct c_mktsegment) from customer""")
def split_columns(spark, sf):
    return quality.split_columns(table(spark, sf, "customer"))


def pca_ratio_sql(a: str, b: str, src: str) -> str:
    return f"""
      with c as (select abs(corr({a}, {b})) as r from {src})
      select 'PC1' as component, {rs('(1 + r) / 2')} as ratio, {rs('(1 + r) / 2')} as cumulative from c
      union all select 'PC2', {rs('(1 - r) / 2')}, 1.0::double from c"""


@query("pca_explained", pca_ratio_sql("value", "event_id", "events"))
def pca_explained(spark, sf):
    df = table(spark, sf, "events").select("value", "event_id")
    return rounded(prep.fit_pca(df).explained(spark).drop("kept"))


@query("pca_scores")
def pca_scores(spark, sf):
    return rounded(prep.pca(view(spark, sf, "numeric"), n_components=0.8)[0])


@query("reduce_vif", f"select {{}} from {fx('reg')}".format("x1, x2, x3"))
def reduce_vif(spark, sf):
    return prep.reduce_vif(view(spark, sf, "reg").select("x1", "x2", "x3", "x4"))[0]


@query("vif_selector", f"""
    with m as (select corr(x1, x2) as a, corr(x1, x3) as b, corr(x2, x3) as c from {fx('reg')}), k as (select count(*) as n from {fx('reg')})
    select 'x1' as variable, n from k union all select 'x2', n from k union all select 'x3', n from k""")
def vif_selector(spark, sf):
    out = prep.VifSelector(threshold=10.0, inputCols=["x1", "x2", "x3", "x4"]).fit(view(spark, sf, "reg")).transform(view(spark, sf, "reg").select("x1", "x2", "x3", "x4"))
    return out.agg(*[F.count(c).alias(c) for c in out.columns]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).alias("n")) for c in out.columns])))


@query("scaler_saved", f"""
    with s as (select avg(l_quantity) as m, stddev_pop(l_quantity) as s, avg(l_tax) as m2, stddev_pop(l_tax) as s2 from lineitem)
    select l_quantity as raw, {rs('max((l_quantity - m) / s)', 6)} as l_quantity, count(*) as n from lineitem, s group by 1""")
def scaler_saved(spark, sf):
    """A fitted scaler written to the shared folder, read back and applied."""
    df = table(spark, sf, "lineitem").select("l_quantity", "l_tax")
    path = core.shared_path(spark, ".model")
    prep.Scaler(method="standard", inputCols=["l_quantity", "l_tax"]).fit(df).write().save(path)
    out = prep.ScalerModel.load(path).transform(df.withColumn("raw", F.col("l_quantity")))
    return rounded(out.groupBy("raw").agg(F.max("l_quantity").alias("l_quantity"), F.count(F.lit(1)).alias("n")), 6)


@query("saved_tables", """
    select kind, count(*) as n, cast(sum(o_orderkey) as bigint) as keys, count(distinct o_orderpriority) as levels from orders, (values ('csv'), ('json'), ('parquet')) v(kind) group by 1""")
def saved_tables(spark, sf):
    """The table written in every supported form and read back."""
    df, out = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), None
    for kind in ("csv", "json", "parquet"):
        path = core.shared_path(spark, f".{kind}")
        io.save(df, path)
        one = io.read_path(spark, path).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").cast("long").alias("keys"),
                                            F.count_distinct("o_orderpriority").alias("levels"))
        out = one if out is None else out.unionByName(one)
    return out


@query("dataset_catalogue", "select lower(n_name) as name, 'region ' || n_regionkey as desc, n_name || '.parquet' as url from nation where contains(lower(n_name), '1')")
def dataset_catalogue(spark, sf):
    """A catalogue file with an entry for every nation, searched by part of the name."""
    entry = F.struct(F.concat("n_name", F.lit(".parquet")).alias("url"), F.concat(F.lit("region "), "n_regionkey").alias("desc"))
    path = core.shared_path(spark, ".catalogue")
    table(spark, sf, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", entry)))).alias("value")).write.text(path)
    return io.list_datasets(spark, path + "/*.txt", "1").select("name", "desc", "url")


@query("valid_points", f"""
    select c_custkey, lat, lon, 'POINT (' || printf('%.6f', lon) || ' ' || printf('%.6f', lat) || ')' as point
    from (select c_custkey, try_cast(lat as double) as lat, try_cast(lon as double) as lon from {fx('geo')})
    where lat between -90 and 90 and lon between -180 and 180""")
def valid_points(spark, sf):
    return io.valid_points(view(spark, sf, "geo"), "lat", "lon")


@query("read_table", "select * from customer")
def read_table(spark, sf):
    return io.load(spark, f"{sf}/customer.parquet")



# quartiles by sketches: the exact ones are within half a percent of the rows, counted and averaged exactly
@query("numerical_summary_sketched", """
    select 'l_extendedprice' as variable, count(l_extendedprice) as count, """ + rs("avg(l_extendedprice)", 4) + """ as mean, true as q25_near, true as q50_near, true as q75_near from lineitem""")
def numerical_summary_sketched(spark, sf):
    df = table(spark, sf, "lineitem").select("l_extendedprice")
    s = quality.numerical_summary(df, approx=True)
    placed = df.crossJoin(F.broadcast(s.select("q25", "q50", "q75"))).agg(*[      # one row of three numbers
        F.avg((F.col("l_extendedprice") <= F.col(q)).cast("double")).alias(f"{q}_rank") for q in ("q25", "q50", "q75")])
    near = [(F.abs(F.col(f"{q}_rank") - F.lit(p)) < 0.005).alias(f"{q}_near") for q, p in (("q25", .25), ("q50", .5), ("q75", .75))]
    return rounded(s.crossJoin(F.broadcast(placed)).select("variable", "count", "mean", *near), 4)


@query("shapiro_small", "select p_brand, 'p_retailprice' as variable, count(p_retailprice) as n, count(p_retailprice) < 30 as tested from part group by p_brand")
def shapiro_small(spark, sf):
    out = quality.shapiro(table(spark, sf, "part"), ["p_retailprice"], ["p_brand"])
    return out.select("p_brand", "variable", "n", F.col("statistic").isNotNull().alias("tested"))
