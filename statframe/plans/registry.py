"""Query registry: each entry is a Spark query over the driver's tables and, where SQL can say it, its oracle."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statframe import ship

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Views over the whole tables; the same text runs in Spark SQL and DuckDB.
_Z1 = ("sqrt(-2 * ln((cast((o_orderkey * 5719 + 17) % 10007 as double) + 1) / 10008)) * "
       "cos(2 * pi() * cast((o_orderkey * 7675 + 31) % 9973 as double) / 9973)")
_Z2 = ("sqrt(-2 * ln((cast((o_orderkey * 6011 + 5) % 10009 as double) + 1) / 10010)) * "
       "sin(2 * pi() * cast((o_orderkey * 15485863 + 7) % 9967 as double) / 9967)")
VIEWS = {
    "numeric": "select l_quantity, l_extendedprice, l_discount, l_tax from {lineitem}",
    "nulls": "select event_id, user_id, case when event_id % 13 = 0 then null else value end as value_n, "
             "case when event_id % 17 = 0 then null else event_type end as type_n from {events}",
    "dups": "select l_returnflag, l_linestatus, l_linenumber, l_tax from {lineitem}",
    "two_group": "select event_type as g, value as y from {events} where event_type in ('view', 'purchase')",
    "two_group_rest": "select case when event_type = 'purchase' then 'purchase' else 'rest' end as g, value as y from {events}",
    "k_group": "select l_returnflag as g, l_quantity + case when l_returnflag = 'A' then 2 "
               "when l_returnflag = 'N' then 1 else 0 end as y from {lineitem}",
    "k_group_hetero": "select o_orderpriority as g, case when o_orderpriority = '1-URGENT' "
                      "then 3 * (o_totalprice - 250000) else o_totalprice - 250000 end as y from {orders}",
    "two_factor": "select l_returnflag as a, l_linestatus as b, l_quantity + case when l_returnflag = 'A' "
                  "and l_linestatus = 'F' then 3 else 0 end as y from {lineitem}",
    "paired": "select l_orderkey, min(l_extendedprice) as before_v, max(l_extendedprice) as after_v "
              "from {lineitem} group by l_orderkey having count(*) > 1",
    "cat22": "select quality, toxic from {labels}",
    "cat35": "select o_orderstatus, o_orderpriority from {orders}",
    "reg": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, 3 * l_quantity - 20 * l_discount + 5 * l_tax "
           "+ (l_partkey % 97) / cast(97 as double) as y, l_quantity as x1, l_discount as x2, l_tax as x3, "
           "2 * l_quantity + (l_suppkey % 7) / cast(10 as double) as x4, l_returnflag as c1, l_linestatus as c2 from {lineitem}",
    "logit": "select case when l_quantity + l_partkey % 23 > 35 then 1 else 0 end as y, l_quantity as x1, "
             "l_discount as x2, l_returnflag as c1 from {lineitem}",
    "scores": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, "
              "case when l_quantity + l_partkey % 23 > 35 then 1 else 0 end as y, "
              "round(1 / (1 + exp(-(l_quantity - 25) / 10)), 3) as p from {lineitem}",
    "series_month": "select o_orderpriority as k, date_trunc('month', o_orderdate) as ts, "
                    "sum(o_totalprice) as v from {orders} group by 1, 2",
    "series_day": "select date_trunc('day', ts) as ts, count(*) as v from {events} group by 1",
    "series_hour": "select event_type as k, date_trunc('hour', ts) as ts, sum(value) as v from {events} group by 1, 2",
    "geo": "select c_custkey, case when c_custkey % 11 = 0 then 'n/a' else cast(c_acctbal / 100 as string) end as lat, "
           "cast(c_custkey % 400 - 200 as string) as lon from {customer}",
    "skew": "select value + 1 as right_pos, value - 0.01 as right_zero, 500 - value as left_tail, "
            "value - 100 as right_neg from {events}",
    "gauss": "select id, case when id % 2 = 0 then 'a' else 'b' end as g2, concat('g', cast(id % 3 as string)) as g3, "
             "10 + 2 * z as y, 10 + 2 * z * (1 + 2 * (id % 2)) as y_het, 10.4 + 2 * z + 0.5 * w as y_after "
             f"from (select o_orderkey as id, {_Z1} as z, {_Z2} as w from {{orders}})",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def fx(name: str) -> str:
    """The view as a DuckDB subquery."""
    return "(" + VIEWS[name].format(**{t: t for t in TABLES}) + ")"


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return register


def r(x: Column | str, digits: int = 4) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    v = F.round(x.cast("double"), digits)
    return F.when(v == 0, F.lit(0.0)).otherwise(v)


def rs(x: str, digits: int = 4) -> str:
    v = f"round(cast({x} as double), {digits})"
    return f"(case when {v} = 0 then 0.0::double else {v} end)"


def rounded(df: DataFrame, digits: int = 4, **per: int) -> DataFrame:
    """Round every double column; ``per`` overrides the digits of single columns."""
    return df.select(*[r(c, per.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
