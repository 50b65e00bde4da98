"""Registered queries: clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from statframe.operators import cluster, core
from statframe.plans.registry import query, rounded, rs, table

DIMS = 64
AXES = [f"e{i}" for i in range(DIMS)]
# all coordinates of every vector; the shifted ones have a cluster per label
_P = "(select vec_id, cast(embedding as double[]) as v, label from embeddings)"
_S = "(select vec_id, list_transform(cast(embedding as double[]), lambda x: x + 2 * label) as v, label from embeddings)"
EPS, MIN = 1.25, 5


def _points(spark, sf, shift: int = 0):
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding").repartition(spark.sparkContext.defaultParallelism)      # a file may be one task
    return rows.select(
        "vec_id", "label", *[(F.element_at("embedding", i + 1).cast("double") + shift * F.col("label")).alias(c) for i, c in enumerate(AXES)])


def _pairs(src: str) -> str:
    return f"(select a.vec_id as i, b.vec_id as j, b.label as c, a.label as own, list_distance(a.v, b.v) as d from {src} a, {src} b)"


_PAIRS = _pairs(_P)


def _silhouette_sql(dist: str) -> str:
    return f"""
    with m as (select i, own, c, sum({dist}) / (count(*) - case when own = c then 1 else 0 end) as m, count(*) as n from {_PAIRS} group by 1, 2, 3),
      s as (select i, max(case when own = c then m end) as a, max(case when own = c then n end) as n, min(case when own <> c then m end) as b from m group by 1)
    select i as vec_id, case when n <= 1 then 0 else (b - a) / greatest(a, b) end as s from s"""


@query("silhouette_labels", f"select vec_id, {rs('s', 6)} as silhouette from ({_silhouette_sql('d')})")
def silhouette_labels(spark, sf):
    return rounded(cluster.silhouette(_points(spark, sf), AXES, "label", "euclidean").select("vec_id", "silhouette"), 6)


@query("silhouette_squared", f"select vec_id, {rs('s', 6)} as silhouette from ({_silhouette_sql('d * d')})")
def silhouette_squared(spark, sf):
    return rounded(cluster.silhouette(_points(spark, sf), AXES, "label").select("vec_id", "silhouette"), 6)


_SUMMARY = f"""
      p as (select label, sum(s) as area, count(*) as n from s join {_P} p on s.vec_id = p.vec_id group by 1),
      t as (select count(*) as k, sum(area) / sum(n) as score, sum(area) as total_area, max(n) / min(n) as thickness,
            case when sum(area) > 0 then min(area) / sum(area) * count(*) else 0 end as rel from p)
    select k, {rs('score', 6)} as score, {rs('total_area')} as total_area, {rs('thickness', 6)} as thickness,
      {rs('rel', 6)} as min_relative_area, {rs('score * rel / thickness', 6)} as balance from t"""


@query("silhouette_summary", f"with s as ({_silhouette_sql('d * d')}), {_SUMMARY}")
def silhouette_summary(spark, sf):
    s = cluster.silhouette(_points(spark, sf), AXES, "label")
    return rounded(cluster.silhouette_summary(s, "label"), 6, total_area=4)


def _knn_sql(dist: str, src: str = _P) -> str:
    return f"(select i, d from (select i, d, row_number() over (partition by i order by d) as rn from (select a.vec_id as i, {dist} as d from {src} a, {src} b)) where rn = {MIN})"


def _knn(name: str, metric: str, dist: str):
    @query(name, f"select i as vec_id, {rs('d', 7)} as distance from {_knn_sql(dist)}")
    def run(spark, sf):
        return rounded(cluster.knn_distance(_points(spark, sf), "vec_id", MIN, AXES, None, metric), 7)
    return run


_knn("knn_distance", "euclidean", "list_distance(a.v, b.v)")
_knn("knn_distance_manhattan", "manhattan", "list_sum([abs(a.v[k] - b.v[k]) for k in range(1, 65)])")
_knn("knn_distance_cosine", "cosine", "1 - list_cosine_similarity(a.v, b.v)")

# the bend of the k-distance curve: last peak of the difference curve before it falls below the peak less the mean step
_M = cluster.CURVE_POINTS
_EPS_SQL = f"""
    with k as (select d, row_number() over (order by d) - 1 as r, count(*) over () as n from {_knn_sql("list_distance(a.v, b.v)")}),
      h as (select j, j * (n - 1) / cast({_M - 1} as double) as h from range({_M}) t(j), (select max(n) as n from k)),
      c as (select j, a.d + (h - floor(h)) * (coalesce(b.d, a.d) - a.d) as v from h join k a on a.r = floor(h) left join k b on b.r = floor(h) + 1),
      s as (select j, v, (j - min(j) over ()) / cast(max(j) over () - min(j) over () as double) as x, (v - min(v) over ()) / (max(v) over () - min(v) over ()) as y from c),
      f as (select {_M - 1} - j as i, j, v, 1 - y - (1 - x) + 0 as z, x, y from s),
      e as (select a.i, a.v, (select 1 - q.y from s q where q.j = {_M - 1} - a.i) as yn, a.i / cast({_M - 1} as double) as xn from f a),
      g as (select i, v, yn - xn as z from e),
      p as (select i, v, z, lag(z, 1, z) over (order by i) as l, lead(z, 1, z) over (order by i) as r, lead(z) over (order by i) as nxt from g),
      q as (select *, max(case when z >= l and z >= r then i end) over (order by i) as peak, max(case when z <= l and z <= r then i end) over (order by i) as dip from p),
      t as (select q.*, case when dip >= peak then 0 else (select z from p w where w.i = q.peak) - 1 / cast({_M - 1} as double) end as limit_ from q where peak is not null)
    select {rs('v', 6)} as eps from p where i = (select peak from t where nxt < limit_ order by i limit 1)"""


@query("best_eps", _EPS_SQL)
def best_eps(spark, sf):
    eps, _ = cluster.best_eps(_points(spark, sf), "vec_id", MIN, AXES, None)
    return rounded(core.rows_frame(spark, [{"eps": eps}] if eps is not None else [], "eps double"), 6)


@query("k_distance_curve", f"""
    select cast(sum(c) over (order by d) - c as bigint) as rank_from, c as cnt, d as distance from (select {rs('d', 7)} as d, count(*) as c from {_knn_sql("list_distance(a.v, b.v)")} group by 1)""")
def k_distance_curve(spark, sf):
    curve = rounded(cluster.best_eps(_points(spark, sf), "vec_id", MIN, AXES, None)[1], 7)
    return curve.groupBy("distance").agg(F.min("rank_from").cast("long").alias("rank_from"), F.sum("cnt").cast("long").alias("cnt")).select("rank_from", "cnt", "distance")


_SPAIRS = _pairs(_S)
_CORE = f"(select i from {_SPAIRS} where d <= {EPS} group by 1 having count(*) >= {MIN})"


def _shifted_dbscan(spark, sf):
    return cluster.dbscan(_points(spark, sf, 2), "vec_id", EPS, MIN, AXES, None)


@query("dbscan_core", f"select vec_id, vec_id in (select i from {_CORE}) as is_core from {_S}")
def dbscan_core(spark, sf):
    return _shifted_dbscan(spark, sf).select("vec_id", (F.col("vector") == "core").alias("is_core"))


_DBSCAN = f"""
    with recursive e as (select i, j from {_SPAIRS} where d <= {EPS} and i in (select i from {_CORE}) and j in (select i from {_CORE})),
      r as (select i, i as root from {_CORE} union select e.j, r.root from r join e on e.i = r.i where r.root < e.j),
      c as (select i, min(root) as root from r group by 1), n as (select i, cast(dense_rank() over (order by root) - 1 as integer) as c from c),
      b as (select p.i, min(n.c) as c from {_SPAIRS} p join n on p.j = n.i where p.d <= {EPS} and p.i not in (select i from n) group by 1),
      o as (select v.vec_id, coalesce(n.c, b.c, -1) as cluster, case when n.c is not null then 'core' when b.c is not null then 'border' else 'noise' end as vector
        from {_S} v left join n on v.vec_id = n.i left join b on v.vec_id = b.i)"""


@query("dbscan", f"{_DBSCAN} select * from o")
def dbscan(spark, sf):
    return _shifted_dbscan(spark, sf).select("vec_id", "cluster", "vector")


@query("dbscan_summary", f"""{_DBSCAN}
    select cluster, count(*) as n, round(count(*) / (select count(*) from o)::double * 100, 1) as pct, count(*) filter (where vector = 'core') as core,
      count(*) filter (where vector = 'border') as border from o group by 1""")
def dbscan_summary(spark, sf):
    return cluster.dbscan_summary(_shifted_dbscan(spark, sf))


# every label is a cluster of its own, so the best centres are the labels' means
@query("kmeans", f"""
    with l as (select label, cast(row_number() over (order by label) - 1 as integer) as cluster from (select distinct label from embeddings)),
      u as (select label, unnest(range(0, {DIMS})) as k, unnest(v) as x from {_S})
    select cluster, 'e' || k as variable, {rs('avg(x)', 4)} as center from u join l using (label) group by 1, 2""")
def kmeans(spark, sf):
    k = table(spark, sf, "embeddings").select("label").distinct().count()
    return rounded(cluster.kmeans(_points(spark, sf, 2), k, AXES, None).center_frame(), 4)


@query("kmeans_labels", "select label, cast(row_number() over (order by label) - 1 as integer) as cluster, count(*) as n from embeddings group by label")
def kmeans_labels(spark, sf):
    k = table(spark, sf, "embeddings").select("label").distinct().count()
    return cluster.kmeans(_points(spark, sf, 2), k, AXES, None).data.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query("best_k")
def best_k(spark, sf):
    return cluster.best_k(_points(spark, sf), columns=AXES)[1]


@query("best_k_elbow")
def best_k_elbow(spark, sf):
    return cluster.best_k_elbow(_points(spark, sf), columns=AXES)[1]


def _tree(spark, sf):
    k = table(spark, sf, "embeddings").select("label").distinct().count()
    return cluster.agglomerative(_points(spark, sf, 2), k=k, columns=AXES, scaling=None)


@query("micro_ward", "select cast(row_number() over (order by label) - 1 as integer) as cluster, count(*) as n from embeddings group by label")
def micro_ward(spark, sf):
    return _tree(spark, sf)[0].groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("merge_tree", "select cast((select count(*) from embeddings) as double) as rows")
def merge_tree(spark, sf):
    return _tree(spark, sf)[1].agg(F.round(F.max("size"), 3).alias("rows"))


# Ward's heights: half their squares add up to the squared distances from the mean, when every distinct row is a leaf
_SIZES = "(select p_size, avg(p_retailprice) as x, cast(count(*) as double) as y from part group by p_size)"


@query("merge_tree_heights", f"""
    select count(*) - 1 as merges, {rs('sum(pow(x - mx, 2) + pow(y - my, 2))', 4)} as squares
    from {_SIZES}, (select avg(x) as mx, avg(y) as my from {_SIZES})""")
def merge_tree_heights(spark, sf):
    sizes = table(spark, sf, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("x"), F.count("*").cast("double").alias("y"))
    tree = cluster.agglomerative(sizes, k=3, columns=["x", "y"], scaling=None)[1]
    return rounded(tree.agg(F.count("*").alias("merges"), F.sum(F.col("distance") * F.col("distance") / 2).alias("squares")), 4)


# single linkage is connection up to the threshold; clusters touch here
_LINK = 1.09


@query("single_linkage_labels", f"""
    with recursive p as (select *, row_number() over (order by v) as pos from {_P}),
      e as (select a.pos as i, b.pos as j from p a join p b on a.pos <> b.pos and list_distance(a.v, b.v) <= {_LINK}),
      r as (select pos as i, pos as root from p union select e.j, r.root from r join e on e.i = r.i where r.root < e.j),
      c as (select i, min(root) as root from r group by i)
    select vec_id, cast(dense_rank() over (order by root) - 1 as integer) as cluster from p join c on c.i = p.pos""")
def single_linkage_labels(spark, sf):
    out = cluster.agglomerative(_points(spark, sf), distance_threshold=_LINK, columns=AXES, scaling=None, linkage="single")[0]
    return out.select("vec_id", "cluster")


# labels lie along a line, far from each other: the longest edges of the tree join neighbouring labels at their closest points
@query("single_linkage_heights", f"""
    with l as (select label, lead(label) over (order by label) as next from (select distinct label from embeddings))
    select {rs('d', 7)} as distance from (select min(list_distance(a.v, b.v)) as d from l join {_S} a on a.label = l.label join {_S} b on b.label = l.next group by l.label)""")
def single_linkage_heights(spark, sf):
    k = table(spark, sf, "embeddings").select("label").distinct().count()
    tree = cluster.agglomerative(_points(spark, sf, 2), k=k, columns=AXES, scaling=None, linkage="single")[1]
    return rounded(tree.orderBy(F.desc("step")).limit(k - 1).select("distance"), 7)


# with a cluster per label the best inertia is what the labels' rows differ from their means
@query("k_search_inertia", f"""
    with u as (select vec_id, label, unnest(range(0, {DIMS})) as c, unnest(v) as x from {_S}),
      one as (select sum(pow(x - m, 2)) as s from (select x, avg(x) over (partition by c) as m from u)),
      own as (select sum(pow(x - m, 2)) as s from (select x, avg(x) over (partition by c, label) as m from u)),
      n as (select count(distinct label) as k from embeddings)
    select 1 as k, {rs('one.s', 3)} as inertia, cast(null as double) as "drop" from one
    union all select cast(n.k as integer), {rs('own.s', 3)}, {rs('one.s - own.s', 3)} from one, own, n""")
def k_search_inertia(spark, sf):
    k = table(spark, sf, "embeddings").select("label").distinct().count()
    return rounded(cluster.best_k_elbow(_points(spark, sf, 2), [1, k], AXES, None)[1], 3)


@query("persona", f"""
    select c_mktsegment, count(*) as size, {rs('100.0 * count(*) / (select count(*) from customer)', 1)} as pct, 'c_acctbal' as variable,
      {rs('avg(c_acctbal)', 3)} as mean, {rs('median(c_acctbal)', 3)} as median from customer group by 1""")
def persona(spark, sf):
    out = cluster.persona(table(spark, sf, "customer"), "c_mktsegment", num_columns=["c_acctbal"], cat_columns=[], noise=None)
    return rounded(out["numeric"].select("c_mktsegment", "size", "pct", "variable", "mean", "median"), 3)


@query("persona_shares", f"""
    with c as (select o_orderstatus, 'o_orderpriority' as variable, o_orderpriority as level, count(*) as n from orders group by 1, 3)
    select o_orderstatus, variable, level, n, {rs('100.0 * n / sum(n) over (partition by o_orderstatus)', 1)} as pct from c
    union all select 'all', variable, level, cast(sum(n) as bigint), {rs('100.0 * sum(n) / sum(sum(n)) over ()', 1)} from c group by 2, 3""")
def persona_shares(spark, sf):
    out = cluster.persona(table(spark, sf, "orders"), "o_orderstatus", num_columns=[], cat_columns=["o_orderpriority"], noise=None)
    return rounded(out["shares"], 1)


@query("persona_top", f"""
    select o_orderstatus, 'o_orderpriority' as variable, o_orderpriority as top, n as freq from (select *, row_number() over
      (partition by o_orderstatus order by n desc, o_orderpriority) as rn from (select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2)) where rn = 1""")
def persona_top(spark, sf):
    out = cluster.persona(table(spark, sf, "orders"), "o_orderstatus", num_columns=[], cat_columns=["o_orderpriority"], noise=None)
    return out["nominal"]


