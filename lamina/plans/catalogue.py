"""The named queries of the library and the SQL that checks them.

Each query runs over whole tables. Results of floating-point sums are rounded to six places in both
engines, as the order of additions differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import text as T
from lamina.functions import vectors as V
from lamina.operators import descent, embed, graph, hierarchy, knn, layers, propagate, report, spanning, sparse
from lamina.plans import estimator
from lamina.plans.oracles import rounded, sql
from lamina.session import materialize, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def r6(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 1e6 + 0.5) / 1e6 + F.lit(0.0)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.vector_table(read_table(spark, sf_dir, "embeddings"))


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(knn.knn_cosine(_rows(spark, sf_dir), 15), "knn")


def _directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.directed(_knn(spark, sf_dir), 15)


def _fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(graph.fuzzy_union(_directed(spark, sf_dir)), "fuzzy")


# Vectors ------------------------------------------------------------------------------------------------------


@query(sql("e", f"select id, {rounded('sqrt(list_dot_product(v, v))')} as norm from e"))
def vec_norms(spark, sf_dir):
    return _rows(spark, sf_dir).select("id", r6(V.norm(F.col("vector"))).alias("norm"))


@query(sql("e", "select coalesce(bool_and(abs(sqrt(list_dot_product(v, v)) - 1) <= 1e-5), true) as all_unit from e"))
def vec_all_unit(spark, sf_dir):
    return knn.all_unit(_rows(spark, sf_dir))


@query(
    sql("e", f"select id, (i - 1)::int as pos, {rounded('v[i] / greatest(sqrt(list_dot_product(v, v)), 1e-12)')} as value from (select *, unnest(range(1, len(v) + 1)) as i from e)")
)
def vec_l2_normalize(spark, sf_dir):
    return _rows(spark, sf_dir).select("id", F.posexplode(V.l2_normalize_floor(F.col("vector"))).alias("pos", "value")).withColumn("value", r6("value"))


@query(sql("knn", f"select i, rank, j, {rounded('sim')} as sim, {rounded('dist')} as dist from knn"))
def knn_cosine_top15(spark, sf_dir):
    return knn.knn_cosine(_rows(spark, sf_dir), 15).select("i", F.col("rank").cast("int").alias("rank"), "j", r6("sim").alias("sim"), r6("dist").alias("dist"))


@query(
    sql(
        "e",
        f"""select a.id as i, (row_number() over (partition by a.id order by dot desc, b.id) - 1)::int as rank, b.id as j, -dot::bigint as raw,
       {rounded('case when dot <= 0 then 0 else 1.0 / dot end')} as dist
from (select *, [floor(x * 127 + 0.5) for x in v] as q from e) a join (select *, [floor(x * 127 + 0.5) for x in v] as q from e) b on a.id <> b.id,
     lateral (select list_dot_product(a.q, b.q) as dot) qualify rank < 10""",
    )
)
def knn_int8_top10(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("vector", V.quantize_int8(F.col("vector")))
    return knn.knn_int8(rows, 10).select("i", F.col("rank").cast("int").alias("rank"), "j", "raw", r6("dist").alias("dist"))


_WORDS = " + ".join(f"case when v[{i + 1}] > 0 then {1 << i}::bigint else 0 end" for i in range(32))
_WORDS2 = " + ".join(f"case when v[{i + 33}] > 0 then {1 << i}::bigint else 0 end" for i in range(32))


@query(
    sql(
        "e",
        f"""select i, rank, j, {rounded('-share')} as raw, {rounded('case when share <= 0 then 0 else -log2(share) end')} as dist from (
  select i, (row_number() over (partition by i order by share desc, j))::int as rank, j, share from (
    select a.id as i, b.id as j, (bit_count(a.p & b.p) + bit_count(a.q & b.q)) / (bit_count(a.p | b.p) + bit_count(a.q | b.q)) as share
    from (select id, {_WORDS} as p, {_WORDS2} as q from e) a join (select id, {_WORDS} as p, {_WORDS2} as q from e) b on a.id <> b.id) qualify rank < 10
  union all select id, 0, id, 1.0 from e)""",
    )
)
def knn_bits_top10(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("vector", V.pack_signs(F.col("vector"), 64)).withColumn("dim", F.lit(2))
    return knn.knn_bits(rows, 10).select("i", F.col("rank").cast("int").alias("rank"), "j", r6("raw").alias("raw"), r6("dist").alias("dist"))


@query(
    sql(
        "e",
        f"""select id, {rounded('max(d)')} as core from (
  select a.id, list_distance(a.v, b.v) as d, row_number() over (partition by a.id order by d, b.id) as k from e a join e b on a.id <> b.id)
where k <= 5 group by id""",
    )
)
def knn_euclid_core_distance(spark, sf_dir):
    return knn.core_distances(_rows(spark, sf_dir), 5).select("id", r6("core").alias("core"))


@query(sql("knn", "select i, j from knn where i <> j union select j, i from knn where i <> j"))
def reverse_neighbors(spark, sf_dir):
    return knn.reverse_neighbors(_knn(spark, sf_dir))


@query(sql("knn", "select a.i, a.j from knn a join knn b on a.i = b.j and a.j = b.i where a.i < a.j"))
def mutual_knn(spark, sf_dir):
    return knn.mutual(_knn(spark, sf_dir))


@query(
    sql(
        "knn",
        """select distinct least(i, j) as a, greatest(i, j) as b from knn where i <> j and dist <= (select max(dist) from knn where rank = 0)""",
    )
)
def duplicate_pairs(spark, sf_dir):
    return knn.duplicates(_knn(spark, sf_dir))


# Graph --------------------------------------------------------------------------------------------------------


@query(sql("sigma", f"select i, {rounded('sigma')} as sigma, {rounded('rho')} as rho from sigma"))
def fuzzy_sigma_rho(spark, sf_dir):
    return graph.sigma_rho(_knn(spark, sf_dir), 15).select("i", r6("sigma").alias("sigma"), r6("rho").alias("rho"))


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select("i", "j", r6("w").alias("w"))


@query(sql("directed", f"select i, j, {rounded('w')} as w from directed"))
def fuzzy_directed(spark, sf_dir):
    return _edges(_directed(spark, sf_dir))


@query(sql("fuzzy", f"select i, j, {rounded('w')} as w from fuzzy"))
def fuzzy_union(spark, sf_dir):
    return _edges(graph.fuzzy_union(_directed(spark, sf_dir)))


@query(sql("directed", f"select a.i, a.j, {rounded('a.w * b.w')} as w from directed a join directed b on a.i = b.j and a.j = b.i"))
def fuzzy_hadamard(spark, sf_dir):
    return _edges(graph.hadamard(materialize(_directed(spark, sf_dir), "directed")))


@query(
    sql(
        "directed",
        f"""select i, j, {rounded('sum(w)')} as w from (select i, j, w from directed union all select j, i, -w from directed)
group by i, j having sum(w) <> 0""",
    )
)
def graph_difference(spark, sf_dir):
    edges = materialize(_directed(spark, sf_dir), "directed")
    return _edges(graph.add(edges, graph.transpose(edges), -1.0))


@query(sql("fuzzy", f"select i, count(*) as degree, {rounded('sum(w)')} as weight from fuzzy group by i"))
def graph_degree(spark, sf_dir):
    return graph.degrees(_fuzzy(spark, sf_dir)).select("i", "degree", r6("weight").alias("weight"))


@query(sql("fuzzy", f"select a.i, b.j, {rounded('sum(a.w * b.w)')} as w from fuzzy a join fuzzy b on a.j = b.i group by a.i, b.j"))
def graph_matmul(spark, sf_dir):
    edges = _fuzzy(spark, sf_dir)
    return _edges(graph.matmul(edges, edges))


@query(
    sql(
        "fuzzy",
        f"""select f.i as id, (p.i - 1)::int as pos, {rounded('sum(f.w * e.v[p.i])')} as value
from fuzzy f join e on e.id = f.j, unnest(range(1, len(e.v) + 1)) p(i) group by f.i, p.i""",
    )
)
def graph_matmul_dense(spark, sf_dir):
    found = graph.matmul_dense(_fuzzy(spark, sf_dir), _rows(spark, sf_dir), "vector")
    return found.select("id", F.posexplode("x").alias("pos", "value")).withColumn("value", r6("value"))


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("id", F.when(F.col("id") < 32, F.col("id")).otherwise(F.lit(-1)).cast("bigint").alias("label"))


def _vote(source: str, target: str) -> str:
    return f"""{target} as materialized (
  select l.id, coalesce(w.label, l.label) as label from {source} l left join (
    select i, arg_max(label, (votes, label)) as label from (
      select f.i, b.label, round(sum(f.w), 9) as votes
      from fuzzy f join {source} a on a.id = f.i and a.label < 0 join {source} b on b.id = f.j and b.label >= 0 group by f.i, b.label)
    where votes >= 1.0 group by i) w on w.i = l.id)"""


def _voted(rounds: int) -> str:
    steps = ",\n".join(_vote(f"label{n}", f"label{n + 1}") for n in range(rounds))
    head = sql("label0", "")
    return f"{head.rstrip()},\n{steps}\nselect id, label from label{rounds}"


@query(_voted(1))
def label_vote_one_round(spark, sf_dir):
    return propagate.vote(_fuzzy(spark, sf_dir), _seeded(spark, sf_dir))


@query(_voted(4))
def label_prop_rounds(spark, sf_dir):
    edges, labels = _fuzzy(spark, sf_dir), _seeded(spark, sf_dir)
    for _ in range(4):
        labels = materialize(propagate.vote(edges, labels), "labels")
    return labels


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("id", (F.col("id") % 16).alias("label"))


@query(sql(("e",), f"select id % 16 as id, (p.i - 1)::int as pos, {rounded('avg(v[p.i])')} as value from e, unnest(range(1, len(v) + 1)) p(i) group by all"))
def partition_mean_vector(spark, sf_dir):
    found = propagate.part_means(_rows(spark, sf_dir), _parts(spark, sf_dir))
    return found.select("id", F.posexplode("x").alias("pos", "value")).withColumn("value", r6("value"))


@query(
    sql(
        "part",
        f"""select p.label as i, q.label as j, {rounded('least(greatest(sum(f.w) / sqrt(any_value(s.n)), 0), 1)')} as w
from fuzzy f join part p on p.id = f.i join part q on q.id = f.j join (select label, count(*) as n from part group by label) s on s.label = p.label
group by p.label, q.label""",
    )
)
def reduced_graph(spark, sf_dir):
    return _edges(propagate.reduce_graph(_fuzzy(spark, sf_dir), _parts(spark, sf_dir)))


@query(
    sql(
        ("part", "layout0"),
        f"""select a.id, c.c - 1 as pos, {rounded('0.5 * l.x[c.c] + 0.5 * coalesce(n.near[c.c], 0)')} as value
from part a join layout0 l on l.id = a.label
left join (
  select i, [sum(m * x[1]) / sum(m), sum(m * x[2]) / sum(m), sum(m * x[3]) / sum(m), sum(m * x[4]) / sum(m)] as near from (
    select f.i, f.w * g.w / sqrt(s.n) as m, l.x
    from fuzzy f join fuzzy g on g.i = f.j and g.j = f.i join part p on p.id = f.j join layout0 l on l.id = p.label
      join (select label, count(*) as n from part group by label) s on s.label = p.label) group by i) n on n.i = a.id,
unnest([1, 2, 3, 4]) c(c)""",
    )
)
def partition_expand(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    layout = propagate.part_means(_rows(spark, sf_dir).withColumn("vector", F.slice("vector", 1, 4)), parts)
    found = propagate.expand(_fuzzy(spark, sf_dir), parts, materialize(layout, "layout"))
    return found.select("id", F.posexplode("x").alias("pos", "value")).withColumn("value", r6("value"))


@query(
    """with l as (select vec_id as id, case when vec_id % 7 = 0 then -1 else vec_id % 11 * 3 end as label from embeddings)
select id, (select count(distinct label) from l where label >= 0) + row_number() over (order by id) - 1 as label from l where label < 0
union all select id, dense_rank() over (order by label) - 1 from l where label >= 0"""
)
def relabel_contiguous(spark, sf_dir):
    label = F.when(F.col("id") % 7 == 0, F.lit(-1)).otherwise(F.col("id") % 11 * 3).cast("bigint")
    return propagate.contiguous(_rows(spark, sf_dir).select("id", label.alias("label")))


@query(sql("fuzzy", f"select i, j, {rounded('50.0 / greatest(50.0 * w / (select max(w) from fuzzy), 1)')} as eps from fuzzy"))
def edge_epochs_per_sample(spark, sf_dir):
    return embed.schedules(_fuzzy(spark, sf_dir), 50).select("i", "j", r6("eps").alias("eps"))


@query(
    sql(
        "fuzzy",
        f"""
, x0 as materialized (select id, [v[1], v[2], v[3], v[4]] as x, row_number() over (order by id) - 1 as number from e),
s as materialized (select i, j, 50.0 / greatest(50.0 * w / (select max(w) from fuzzy), 1) as eps from fuzzy),
f as materialized (
  select *, floor(7 / eps + 1e-9) as k, greatest(floor(7 / (eps * 1.5) + 1e-9) - 1, 0) as due,
         greatest(floor(ceil((floor(7 / eps + 1e-9) - 1) * eps - 1e-9) / (eps * 1.5) + 1e-9) - 1, 0) as before
  from s where floor(7 / eps + 1e-9) > floor(6 / eps + 1e-9)),
pull as (
  select f.i as id, a.x as a, b.x as b, list_distance(a.x, b.x) as d from f join x0 a on a.id = f.i join x0 b on b.id = f.j),
push as (
  select f.i as id, a.x as a, b.x as b, list_distance(a.x, b.x) ** 2 as d2
  from f, unnest(range(0, (due - before)::bigint)) p(p) join x0 a on a.id = f.i
  join x0 b on b.number = (f.i * 7 + f.j * 13 + p.p * 17) % (select count(*) from x0)),
m as (
  select id, c, 0.1 * (-2 * 0.5 * d - 2) / (2 * d * d - 0.5 * d + 1) * (a[c] - b[c]) as value from pull, unnest([1, 2, 3, 4]) c(c) where d > 0
  union all
  select id, c, 0.1 * least(greatest(4.0 / ((1 + 0.25 * d2) * d2) * (a[c] - b[c]), -4), 4) from push, unnest([1, 2, 3, 4]) c(c) where d2 > 0.01)
select id, c - 1 as pos, {rounded('sum(value)')} as value from m group by id, c""",
    )
)
def layout_one_epoch(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    layout = rows.select("id", F.slice("vector", 1, 4).alias("x"))
    edges = embed.schedules(_fuzzy(spark, sf_dir), 50)
    numbered = propagate._dense(rows.select("id"), "id", "number")
    moves = embed.epoch(edges, layout, 7, 0.1, 1.0, lambda i, j, p, n: F.pmod(i * 7 + j * 13 + p * 17, n), numbered=numbered)
    return moves.select("id", F.posexplode("x").alias("pos", "value")).withColumn("value", r6("value"))


# Trees --------------------------------------------------------------------------------------------------------


@query(sql("mst", f"select a, b, {rounded('w')} as w from mst"))
def mst_euclid(spark, sf_dir):
    return spanning.spanning_tree(_rows(spark, sf_dir)).select("a", "b", r6("w").alias("w"))


@query(sql("mutual", f"select a, b, {rounded('w')} as w from mst"))
def mst_mutual_reachability(spark, sf_dir):
    return spanning.spanning_tree(_rows(spark, sf_dir), min_samples=5).select("a", "b", r6("w").alias("w"))


THRESHOLD = 1.12
_REACH = """reach(a, b) as (
  select id, id from e union
  select r.a, case when m.a = r.b then m.b else m.a end from reach r join mst m on (m.a = r.b or m.b = r.b) and m.w <= {threshold}),
comp as materialized (select a as id, min(b) as component from reach group by a)"""


def _components_sql(body: str) -> str:
    return sql("mst", "").rstrip() + ",\n" + _REACH.replace("{threshold}", str(THRESHOLD)) + "\n" + body


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return spanning.components_at(materialize(spanning.spanning_tree(rows), "tree"), rows, THRESHOLD)


@query(_components_sql("select id, component from comp"))
def components_at_threshold(spark, sf_dir):
    return _components(spark, sf_dir)


@query(_components_sql("select component, count(*) as size from comp group by component"))
def component_sizes(spark, sf_dir):
    return _components(spark, sf_dir).groupBy("component").agg(F.count("*").alias("size"))


def _on_tree(spark: SparkSession, sf_dir: str, cut, schema: str, min_samples: int = 1) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return layers.on_tree(spanning.spanning_tree(rows, min_samples), rows, cut, schema)


def _frame(columns: dict):
    import pandas as pd

    return pd.DataFrame(columns)


@query(sql("mst", f"select {rounded('w')} as dist, count(*) as merges from mst group by 1"))
def linkage_heights(spark, sf_dir):
    found = _on_tree(spark, sf_dir, lambda ids, m: _frame({"dist": m[:, 2]}), "dist double")
    return found.groupBy(r6("dist").alias("dist")).agg(F.count("*").alias("merges"))


@query(sql(("mst", "merges"), f"select s as step, one as left_id, two as right_id, {rounded('w')} as dist, size from merges"))
def linkage_tree(spark, sf_dir):
    def cut(ids, m):
        return _frame({"step": range(len(m)), "left_id": m[:, 0].astype(int), "right_id": m[:, 1].astype(int), "dist": m[:, 2], "size": m[:, 3].astype(int)})

    found = _on_tree(spark, sf_dir, cut, "step bigint, left_id bigint, right_id bigint, dist double, size bigint")
    return found.withColumn("dist", r6("dist"))


#: Least points of a cluster in the queries of condensed trees.
LEAST = 5


def _condensed(body: str, part: str = "condensed") -> str:
    return sql(("mutual", part), body, least=LEAST)


@query(
    _condensed(
        f"""select cluster as parent, p as child, {rounded('lam')} as "lambda", 1::bigint as child_size from left_at
union all select parent, cluster, {rounded('lam')}, size from clusters"""
    )
)
def condensed_tree(spark, sf_dir):
    def cut(ids, m):
        parent, child, at, size = zip(*hierarchy.condense(m, LEAST).rows())
        return _frame({"parent": parent, "child": child, "lambda": at, "child_size": size})

    found = _on_tree(spark, sf_dir, cut, "parent bigint, child bigint, lambda double, child_size bigint", 5)
    return found.withColumn("lambda", r6("lambda"))


@query(_condensed("select cluster from leaves"))
def leaf_clusters(spark, sf_dir):
    return _on_tree(spark, sf_dir, lambda ids, m: _frame({"cluster": hierarchy.condense(m, LEAST).leaves()}), "cluster bigint", 5)


@query(
    _condensed(
        f"""
, tops as (select cluster, max(lam) as top from left_at group by cluster),
marked as (
  select pts.id, x.lam, t.top,
         case when (select count(*) from leaves) = 1 then case when x.lam >= (select max(lam) from left_at where cluster in (select cluster from leaves)) then 0 else -1 end
              else coalesce(l.label, -1) end as label
  from left_at x join pts using (p) left join leaves l on l.cluster = x.cluster left join tops t on t.cluster = x.cluster)
select id, label, case when label < 0 then 0.0 else {rounded('lam / top')} end as strength from marked"""
    )
)
def cluster_labels(spark, sf_dir):
    def cut(ids, m):
        tree = hierarchy.condense(m, LEAST)
        label = hierarchy.labels(tree, tree.leaves())
        return _frame({"id": ids, "label": label, "strength": hierarchy.strengths(tree, tree.leaves(), label)})

    return _on_tree(spark, sf_dir, cut, "id bigint, label bigint, strength double", 5).withColumn("strength", r6("strength"))


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster, parent, birth, death, fade and whether it is the root, of all clusters of the vectors."""

    def cut(ids, m):
        births, deaths, parents, fades = hierarchy.barcode(hierarchy.condense(m, LEAST), LEAST)
        cluster = [len(ids) + i for i in range(len(births))]
        return _frame({"cluster": cluster, "parent": parents, "birth": births, "death": deaths, "fade": fades, "root": [c == len(ids) for c in cluster]})

    return _on_tree(spark, sf_dir, cut, "cluster bigint, parent bigint, birth double, death double, fade double, root boolean", 5)


@query(_condensed(f"select cluster, parent, birth, death, {rounded('fade')} as fade from bars", "bars"))
def min_size_barcode(spark, sf_dir):
    return _bars(spark, sf_dir).drop("root").withColumn("fade", r6("fade"))


@query(
    _condensed(
        f"""select s.size, {rounded('coalesce(sum((death - birth) * fade), 0)')} as total
from (select distinct birth as size from bars) s left join bars b on s.size >= b.birth and s.size < b.death and b.death > b.birth and not b.root group by s.size""",
        "bars",
    )
)
def total_persistence(spark, sf_dir):
    return report.total_persistence(materialize(_bars(spark, sf_dir), "bars")).select("size", r6("total").alias("total"))


@query(
    _condensed(
        """select coalesce((count(*) filter (birth <= 5 and death > 5 and birth <= 10 and death > 10))
       / nullif(count(*) filter ((birth <= 5 and death > 5) or (birth <= 10 and death > 10)), 0)::double, 0) as jaccard from bars""",
        "bars",
    )
)
def active_cluster_jaccard(spark, sf_dir):
    return report.active_similarity(_bars(spark, sf_dir), 5, 10)


@query(
    """with s as (select event_type, date_trunc('hour', ts) as hour, count(*) as n from events group by all),
a as (select *, row_number() over (partition by event_type order by hour) as i,
             (n is distinct from lag(n) over (partition by event_type order by hour))::int as fresh from s),
r as (select *, sum(fresh) over (partition by event_type order by hour) as run from a),
g as (select event_type, run, min(i) as low, max(i) as high, any_value(n) as n from r group by event_type, run),
p as (select *, lag(n) over w as before, lead(n) over w as after from g window w as (partition by event_type order by run))
select r.event_type, r.hour, r.n from p join r on r.event_type = p.event_type and r.i = (p.low + p.high) // 2 where p.n > p.before and p.n > p.after"""
)
def find_peaks_events(spark, sf_dir):
    series = read_table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    return report.peaks(series, ["event_type"], "hour", "n")


# Pipeline -----------------------------------------------------------------------------------------------------


def _fit(spark: SparkSession, sf_dir: str, **changes) -> estimator.Clustering:
    return estimator.fit(_rows(spark, sf_dir), estimator.Params(**changes))


@query()
def cluster_layers(spark, sf_dir):
    return _fit(spark, sf_dir).layers


@query()
def cluster_layer_stats(spark, sf_dir):
    return _fit(spark, sf_dir).layer_stats()


@query()
def cluster_tree(spark, sf_dir):
    return _fit(spark, sf_dir).cluster_tree()


@query()
def fit_predict_labels(spark, sf_dir):
    return _fit(spark, sf_dir).labels()


@query()
def approx_n_clusters_labels(spark, sf_dir):
    return _fit(spark, sf_dir, approx_n_clusters=10).layers.select("id", "label", "strength")


@query()
def base_n_clusters_layers(spark, sf_dir):
    return _fit(spark, sf_dir, base_n_clusters=10).layers


@query()
def node_layout(spark, sf_dir):
    return _fit(spark, sf_dir).layout


@query()
def rp_forest_leaves(spark, sf_dir):
    return descent.forest(_rows(spark, sf_dir).select("id", "vector"))


#: Share of the true neighbours that neighbour descent must find.
RECALL = 0.9


def _recall(spark: SparkSession, rows: DataFrame, metric: str) -> DataFrame:
    """One row: the metric, how many neighbours descent gives, and whether RECALL of the exact ones are among them."""
    rows = materialize(rows, "vectors")
    pair = ["i", "j"]
    exact = knn.TABLES[metric][0](rows, 15).filter("i <> j").select(pair)
    near = materialize(knn.knn_approximate(rows, 15, metric), "near").filter("i <> j").select(pair)
    counts = exact.withColumn("hit", F.lit(0)).unionByName(near.withColumn("hit", F.lit(1))).groupBy(pair).agg(F.max("hit").alias("near"), F.min("hit").alias("only_near"))
    found = counts.agg(F.sum("near").alias("rows"), F.sum((F.col("only_near") == 0).cast("bigint")).alias("true"), F.sum(((F.col("only_near") == 0) & (F.col("near") == 1)).cast("bigint")).alias("hits"))
    return found.select(F.lit(metric).alias("metric"), F.col("rows").cast("bigint").alias("rows"), (F.col("hits") >= RECALL * F.col("true")).alias("recalled"))


def _recall_sql(metric: str, neighbors: int) -> str:
    return f"select '{metric}' as metric, (count(*) * least({neighbors}, count(*) - 1))::bigint as rows, true as recalled from embeddings"


@query(_recall_sql("cosine", 14))
def nn_descent_cosine(spark, sf_dir):
    return _recall(spark, _rows(spark, sf_dir), "cosine")


@query(_recall_sql("int8", 15))
def nn_descent_int8(spark, sf_dir):
    return _recall(spark, _rows(spark, sf_dir).withColumn("vector", V.quantize_int8(F.col("vector"))), "int8")


@query(_recall_sql("bits", 14))
def nn_descent_bits(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("vector", V.pack_signs(F.col("vector"), 64)).withColumn("dim", F.size("vector"))
    return _recall(spark, rows, "bits")


# Reports ------------------------------------------------------------------------------------------------------


def _mod7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 8 - 1).alias("label"))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("class"))


_PURITY = """with c as (select vec_id % 8 - 1 as label, label as class, count(*) as n from embeddings where vec_id % 8 > 0 group by all),
p as (select label, sum(n)::bigint as size, arg_max(class, (n, -class)) as dominant, max(n) / sum(n) as purity from c group by label)"""


@query(f"{_PURITY} select label, size, dominant, {rounded('purity')} as purity from p")
def purity_by_label(spark, sf_dir):
    return report.purity(_mod7(spark, sf_dir), _truth(spark, sf_dir)).withColumn("purity", r6("purity"))


@query(f"{_PURITY} select {rounded('avg(purity)')} as mean_purity from p")
def mean_purity(spark, sf_dir):
    return report.mean_purity(report.purity(_mod7(spark, sf_dir), _truth(spark, sf_dir))).select(r6("mean_purity").alias("mean_purity"))


_IOU = f"""with t as (select vec_id, vec_id % 8 - 1 as a, vec_id % 16 - 1 as b from embeddings),
c as (select a, b, count(*) as common from t where a >= 0 and b >= 0 group by a, b),
o as (select c.a as "left", c.b as "right", common, {rounded("common / ((select count(*) from t where t.a = c.a) + (select count(*) from t where t.b = c.b) - common)")} as iou from c)"""


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 16 - 1).alias("label"))
    found = report.overlaps(_mod7(spark, sf_dir), other)
    return found.withColumn("iou", r6("iou"))


@query(f"{_IOU} select * from o")
def cluster_iou(spark, sf_dir):
    return _two(spark, sf_dir)


@query(
    f"""{_IOU} select "left", "right", common, iou from o where iou >= 0.4
qualify row_number() over (partition by "left" order by iou desc, "right") = 1 and row_number() over (partition by "right" order by iou desc, "left") = 1"""
)
def cluster_matches(spark, sf_dir):
    return report.matches(_two(spark, sf_dir), 0.4)


@query(
    """with s as (select vec_id % 8 - 1 as label, count(*) as n from embeddings group by 1)
select count(*) as clusters, max(n) as largest, quantile_cont(n, 0.5) as median, min(n) as smallest, (select sum(n)::bigint from s where label < 0) as noise from s where label >= 0"""
)
def cluster_size_summary(spark, sf_dir):
    return report.size_summary(_mod7(spark, sf_dir))


@query("select vec_id % 8 - 1 as label, count(*) as size from embeddings group by 1")
def cluster_size_histogram(spark, sf_dir):
    return report.cluster_sizes(_mod7(spark, sf_dir))


@query(
    f"""select vec_id, case when label >= 0 then coalesce({report.CLASS_NAMES['fashion']}[label + 1], '?') else '?' end as fashion,
       case when label >= 0 then coalesce({report.CLASS_NAMES['news5']}[label + 1], '?') else '?' end as news from embeddings"""
)
def class_names(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", report.class_name(F.col("label"), "fashion").alias("fashion"), report.class_name(F.col("label"), "news5").alias("news")
    )


# Texts --------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_SPACE = r"[\s\x0b\x{85}\x{a0}\p{Z}]+"


@query(f"select doc_id, sha256(trim(regexp_replace(replace(text, chr(13), ''), '{_SPACE}', ' ', 'g'))) as body_sha256 from documents")
def doc_normalize_body(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_body(F.col("text")), 256).alias("body_sha256"))


@query(
    f"""with t as (select doc_id, replace(text, chr(13), '') as x from documents),
b as (select doc_id, case when instr(x, chr(10) || chr(10)) > 0 then substr(x, instr(x, chr(10) || chr(10)) + 2) else x end as x from t),
s as (select doc_id, case when instr(reverse(x), reverse(chr(10) || '-- ' || chr(10))) > 0 then left(x, length(x) - instr(reverse(x), reverse(chr(10) || '-- ' || chr(10))) - 4) else x end as x from b),
z as (select doc_id, case when instr(reverse(x), chr(10) || '--' || chr(10)) > 0 then left(x, length(x) - instr(reverse(x), chr(10) || '--' || chr(10)) - 3) else x end as x from s)
select doc_id, sha256(trim(regexp_replace(x, '{_SPACE}', ' ', 'g'))) as body_sha256 from z"""
)
def doc_strip_header(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.strip_message(F.col("text")), 256).alias("body_sha256"))


@query(sql("tokens", "select doc_id, token, count(*) as n from tokens group by doc_id, token", stop=_STOP))
def doc_tokens(spark, sf_dir):
    return T.tokens(read_table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(sql("bag", f"select doc_id, bucket, {rounded('weight')} as weight from bag", stop=_STOP, buckets=T.BUCKETS))
def doc_bow_md5(spark, sf_dir):
    return T.hashed_bag(read_table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("weight", r6("weight"))


@query(
    sql(
        "bag",
        f"""select d.doc_id, {rounded('greatest(coalesce(sqrt(sum(weight * weight)), 0), 1e-12)')} as norm
from documents d left join bag on bag.doc_id = d.doc_id group by d.doc_id""",
        stop=_STOP,
        buckets=T.BUCKETS,
    )
)
def doc_bow_norm(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    norms = docs.select("doc_id").distinct().join(T.bag_norms(T.hashed_bag(docs, "doc_id", "text"), "doc_id"), "doc_id", "left")
    return norms.select("doc_id", r6(F.coalesce("norm", F.lit(1e-12))).alias("norm"))


@query(
    sql(
        "bag",
        f"""
, size as (select doc_id, greatest(sqrt(list_sum(list(weight * weight order by bucket))), 1e-12) as size from bag group by doc_id),
n as materialized (select doc_id as id, bucket, weight / size as v from bag join size using (doc_id)),
d as (select distinct doc_id as id from documents),
s as (select a.id as i, b.id as j, list_sum(list(a.v * b.v order by a.bucket)) as sim from n a join n b on a.bucket = b.bucket and a.id <> b.id group by a.id, b.id)
select a.id as i, (row_number() over (partition by a.id order by coalesce(sim, 0) desc, b.id))::int as rank, b.id as j, {rounded('coalesce(sim, 0)')} as sim
from d a join d b on a.id <> b.id left join s on s.i = a.id and s.j = b.id qualify rank <= 5""",
        stop=_STOP,
        buckets=T.BUCKETS,
    )
)
def doc_knn_bow(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").filter("doc_id is not null")
    shared = materialize(docs.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "shared")
    single, several = (docs.join(shared, "doc_id", how) for how in ("left_anti", "left_semi"))
    rows = T.unit_bags(single, "doc_id", "text").unionByName(T.merged_unit_bags(several, "doc_id", "text"))
    found = sparse.knn_sparse(rows, 5, T.BUCKETS)
    return found.select(F.col("query_id").alias("i"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("j"), r6("score").alias("sim"))


@query(
    f"""with h as (select doc_id, sha256(trim(regexp_replace(replace(text, chr(13), ''), '{_SPACE}', ' ', 'g'))) as h from documents)
select doc_id, min(doc_id) over (partition by h) as duplicate_class from h"""
)
def duplicate_texts(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_body(F.col("text")), 256).alias("h"))
    return rows.join(rows.groupBy("h").agg(F.min("doc_id").alias("duplicate_class")), "h").select("doc_id", "duplicate_class")


# Tables as sources of vectors ---------------------------------------------------------------------------------


@query(
    f"""select user_id as id, count(*) as events, {rounded('sum(value)')} as sum_value, {rounded('max(value)')} as max_value,
       count(distinct event_type) as kinds, {rounded("avg((props->>'$.k')::double)")} as mean_k from events group by user_id"""
)
def user_event_vectors(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double")
    return read_table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.count("*").alias("events"),
        r6(F.sum("value")).alias("sum_value"),
        r6(F.max("value")).alias("max_value"),
        F.countDistinct("event_type").alias("kinds"),
        r6(F.avg(k)).alias("mean_k"),
    )


_SUPPLIER = """with f as (
  select l_suppkey as id, [ln(1 + count(*)), avg(l_quantity) / 50, avg(l_discount) * 10, avg(l_tax) * 10, avg((l_returnflag = 'R')::int)] as v
  from lineitem group by l_suppkey)"""


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        F.array(
            F.log1p(F.count("*").cast("double")),
            F.avg("l_quantity") / 50,
            F.avg("l_discount") * 10,
            F.avg("l_tax") * 10,
            F.avg((F.col("l_returnflag") == "R").cast("int")),
        ).alias("vector")
    )
    return features.withColumn("dim", F.size("vector"))


@query(f"{_SUPPLIER} select id, (i - 1)::int as pos, {rounded('v[i]')} as value from (select *, unnest(range(1, 6)) as i from f)")
def supplier_feature_vectors(spark, sf_dir):
    return _suppliers(spark, sf_dir).select("id", F.posexplode("vector").alias("pos", "value")).withColumn("value", r6("value"))


@query(
    f"""{_SUPPLIER} select a.id as i, (row_number() over (partition by a.id order by d, b.id))::int as rank, b.id as j, {rounded('d')} as dist
from f a join f b on a.id <> b.id, lateral (select list_distance(a.v, b.v) as d) qualify rank < 6 union all select id, 0, id, 0.0 from f"""
)
def supplier_knn(spark, sf_dir):
    return knn.knn_euclidean(materialize(_suppliers(spark, sf_dir), "suppliers"), 6).select("i", F.col("rank").cast("int").alias("rank"), "j", r6("dist").alias("dist"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_predict_labels(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
