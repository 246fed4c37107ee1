"""SQL for the queries of the catalogue: common table expressions that build on each other."""

from __future__ import annotations

#: name -> (names it needs, SQL)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "e": ((), "e as materialized (select vec_id as id, [x::double for x in embedding] as v from embeddings)"),
    "u": (
        ("e",),
        """unit as (select coalesce(bool_and(abs(sqrt(list_dot_product(v, v)) - 1) <= 1e-5), true) as yes from e),
u as materialized (
  select id, case when (select yes from unit) then v
             else [x / case when sqrt(list_dot_product(v, v)) = 0 then 1 else sqrt(list_dot_product(v, v)) end for x in v] end as v from e)""",
    ),
    "knn": (
        ("u",),
        """pairs as (select a.id as i, b.id as j, list_dot_product(a.v, b.v) as sim from u a join u b on a.id <> b.id),
knn as materialized (
  select i, rank, j, sim, case when sim > 0 then greatest(-log2(sim), 0) else 0 end as dist from (
    select i, (row_number() over (partition by i order by sim desc, j))::int as rank, j, sim from pairs qualify rank <= 14
    union all select id, 0, id, list_dot_product(v, v) from u))""",
    ),
    "sigma": (
        ("knn",),
        """rho as materialized (select i, coalesce(arg_min(dist, rank) filter (dist > 0), 0) as rho, avg(dist) as mean from knn group by i),
state(i, it, low, high, middle, open) as (
  select i, 0, 0.0::double, 'infinity'::double, 1.0::double, true from rho
  union all
  select i, it + 1,
         case when near or total > log2(15) then low else middle end,
         case when near or total <= log2(15) then high else middle end,
         case when near then middle when total > log2(15) then (low + middle) / 2
              when isinf(high) then middle * 2 else (middle + high) / 2 end,
         not near
  from (
    select s.i, s.it, s.low, s.high, s.middle, sum(case when k.dist - r.rho > 0 then exp(-((k.dist - r.rho) / s.middle)) else 1 end) as total,
           abs(total - log2(15)) < 1e-5 as near
    from state s join rho r on r.i = s.i join knn k on k.i = s.i and k.rank >= 1 where s.open and s.it < 64
    group by s.i, s.it, s.low, s.high, s.middle)),
sigma as materialized (
  select r.i, r.rho, greatest(arg_max(s.middle, s.it), 1e-3 * case when r.rho > 0 then r.mean else (select avg(dist) from knn) end) as sigma
  from rho r join state s on s.i = r.i group by r.i, r.rho, r.mean)""",
    ),
    "directed": (
        ("sigma",),
        """directed as materialized (
  select k.i, k.j, case when k.dist - s.rho <= 0 or s.sigma = 0 then 1 else exp(-((k.dist - s.rho) / s.sigma)) end as w
  from knn k join sigma s on s.i = k.i where k.i <> k.j and w <> 0)""",
    ),
    "fuzzy": (
        ("directed",),
        """fuzzy as materialized (
  select coalesce(a.i, b.j) as i, coalesce(a.j, b.i) as j, coalesce(a.w, 0) + coalesce(b.w, 0) - coalesce(a.w, 0) * coalesce(b.w, 0) as w
  from directed a full join directed b on a.i = b.j and a.j = b.i)""",
    ),
    "label0": (("fuzzy",), "label0 as materialized (select id, case when id < 32 then id else -1 end as label from e)"),
    "part": (("fuzzy",), "part as materialized (select id, id % 16 as label from e)"),
    "layout0": (("e",), "layout0 as materialized (select label as id, [avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4])] as x from part join e using (id) group by label)"),
    "mst": (
        ("e",),
        """far as materialized (select a.id as a, b.id as b, list_distance(a.v, b.v) as w from e a join e b on a.id <> b.id),
grow(id, d, frm, done) using key (id) as (
  select b, w, a, 0 from far where a = (select min(id) from e)
  union
  (with n as (select * from recurring.grow where done = 0 order by d, least(id, frm), greatest(id, frm) limit 1)
   select id, d, frm, 1 from n union all
   select r.id, f.w, n.id, 0 from n join far f on f.a = n.id join recurring.grow r on r.id = f.b
   where r.done = 0 and r.id <> n.id and (f.w < r.d or (f.w = r.d and (least(n.id, r.id), greatest(n.id, r.id)) < (least(r.frm, r.id), greatest(r.frm, r.id)))))),
mst as materialized (select least(id, frm) as a, greatest(id, frm) as b, d as w from grow)""",
    ),
    "mutual": (
        ("e",),
        """gap as materialized (select a.id as a, b.id as b, list_distance(a.v, b.v) as w from e a join e b on a.id <> b.id),
core as materialized (select a as id, max(w) as core from (select *, row_number() over (partition by a order by w, b) as k from gap) where k <= 5 group by a),
far as materialized (select g.a, g.b, greatest(g.w, x.core, y.core) as w from gap g join core x on x.id = g.a join core y on y.id = g.b),
grow(id, d, frm, done) using key (id) as (
  select b, w, a, 0 from far where a = (select min(id) from e)
  union
  (with n as (select * from recurring.grow where done = 0 order by d, least(id, frm), greatest(id, frm) limit 1)
   select id, d, frm, 1 from n union all
   select r.id, f.w, n.id, 0 from n join far f on f.a = n.id join recurring.grow r on r.id = f.b
   where r.done = 0 and r.id <> n.id and (f.w < r.d or (f.w = r.d and (least(n.id, r.id), greatest(n.id, r.id)) < (least(r.frm, r.id), greatest(r.frm, r.id)))))),
mst as materialized (select least(id, frm) as a, greatest(id, frm) as b, d as w from grow)""",
    ),
    # From a spanning tree mst: points by place, and merges in order; a key below the number of points is a point and its node.
    "merges": (
        ("e",),
        """pts as materialized (select id, (row_number() over (order by id) - 1)::bigint as p from e),
total as materialized (select count(*)::bigint as n from e),
steps as materialized (
  select (row_number() over (order by w, mst.a, mst.b) - 1)::bigint as s, x.p as a, y.p as b, w from mst join pts x on x.id = mst.a join pts y on y.id = mst.b),
link(key, node, other, w, size, s) using key (key) as (
  select p, p, null::bigint, null::double, 1::bigint, -1::bigint from pts
  union
  (with now as (
     select e.s, e.w, x.node as p, y.node as q
     from (select max(s) + 1 as s from link) c join steps e on e.s = c.s
       join recurring.link x on x.key = e.a join recurring.link y on y.key = e.b),
   moved as (select l.key, now.s from now, recurring.link l, total t where l.key < t.n and l.node in (now.p, now.q))
   select moved.key, t.n + moved.s, null, null, 1, moved.s from moved, total t
   union all
   select t.n + now.s, greatest(p, q), least(p, q), now.w, (select count(*) from moved), now.s from now, total t)),
merges as materialized (select key as node, node as one, other as two, w, size, s from link, total where key >= n)""",
    ),
    # Clusters of at least {least} points: a merge of two such sides splits a cluster.
    "condensed": (
        ("merges",),
        """sizes as materialized (select p as node, 1::bigint as size from pts union all select node, size from merges),
sides as materialized (
  select m.node, m.w, x.i, x.child, z.size from merges m, lateral (select 1 as i, m.one as child union all select 2, m.two) x join sizes z on z.node = x.child
  where m.size >= {least}),
splits as materialized (select node from sides group by node having min(size) >= {least}),
walk(node, depth, path) as (
  select node, 0, []::integer[] from merges where s = (select max(s) from merges) and size >= {least}
  union all
  select x.child, k.depth + 1, list_append(k.path, x.i) from walk k join sides x on x.node = k.node and x.size >= {least}),
born as materialized (
  select x.child as node, x.node as of_node, x.w, x.size, (select n from total) + row_number() over (order by k.depth, k.path, x.i) as cluster
  from splits join walk k on k.node = splits.node join sides x on x.node = splits.node),
inside(node, cluster) as (
  select k.node, (select n from total) from walk k where k.depth = 0
  union all
  select x.child, coalesce(b.cluster, c.cluster) from inside c join sides x on x.node = c.node and x.size >= {least} left join born b on b.node = x.child),
up(p, node) as (
  select p, p from pts
  union all
  select u.p, m.node from up u join sizes z on z.node = u.node and z.size < {least} join merges m on u.node in (m.one, m.two)),
left_at as materialized (
  select u.p, c.cluster, 1 / m.w as lam from up u join merges m on m.node = u.node and m.size >= {least} join inside c on c.node = u.node),
clusters as materialized (
  select b.cluster, c.cluster as parent, 1 / b.w as lam, b.size, min(b.size) over (partition by b.of_node) as least
  from born b join inside c on c.node = b.of_node),
leaves as materialized (
  select cluster, row_number() over (order by cluster) - 1 as label from (
    select (select n from total) as cluster union all select cluster from clusters) where cluster not in (select parent from clusters))""",
    ),
    "bars": (
        ("condensed",),
        """above(cluster, over) as (
  select cluster, cluster from clusters
  union all
  select a.cluster, c.parent from above a join clusters c on c.cluster = a.over),
bars as materialized (
  select n as cluster, n as parent, greatest({least}, coalesce((select max(least) from clusters), 0))::double as birth, n::double as death, 0.0::double as fade, true as root from total
  union all
  select c.cluster, c.parent, greatest({least}, coalesce((select max(k.least) from above a join clusters k on k.parent = a.cluster where a.over = c.cluster), 0))::double,
         c.least::double, exp(-1 / c.lam), false from clusters c)""",
    ),
    "tokens": (
        (),
        r"""words as (
  select doc_id, unnest(string_split(trim(regexp_replace(replace(text, chr(13), ''), '[\s\x0b\x{85}\x{a0}\p{Z}]+', ' ', 'g')), ' ')) as word from documents),
kept as (select doc_id, lower(regexp_replace(word, '[^A-Za-z0-9]', '', 'g')) as token from words),
tokens as materialized (select doc_id, token from kept where length(token) >= 3 and token not in ({stop}))""",
    ),
    "bag": (
        ("tokens",),
        """bag as materialized (
  select doc_id, bucket, ln(1 + count(*)) as weight
  from (select doc_id, ('0x' || substr(md5(token), 1, 8))::bigint % {buckets} as bucket from tokens) group by doc_id, bucket)""",
    ),
}


def rounded(expression: str) -> str:
    return f"floor(({expression}) * 1e6 + 0.5) / 1e6 + 0.0"


def sql(needs: tuple[str, ...] | str, body: str, **values) -> str:
    """body after the expressions it needs and those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in PARTS[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in (needs,) if isinstance(needs, str) else needs:
        add(name)
    parts = ",\n".join(PARTS[n][1] for n in order)
    for key, value in values.items():
        parts, body = parts.replace("{" + key + "}", str(value)), body.replace("{" + key + "}", str(value))
    return f"with recursive {parts}\n{body}" if order else body
