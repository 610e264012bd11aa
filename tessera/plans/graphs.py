"""Queries on the graph of symbols and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.plans.relational import E, S, edges, files, symbols
from tessera.session import cut

KIND_COST = {"reexport": 0.1, "dynamic_dispatch": 0.7, "inheritance": 0.6, "implements": 0.7, "jsx_render": 0.8, "framework_entry": 0.55, "callback": 0.7, "server-action": 0.7, "route-handler": 0.7, "event": 0.8}  # fixed values
FLOW_WEIGHT = {"call": 1.0, "import": 1.0, "type_usage": 0.9, "inheritance": 0.9, "implements": 0.9, "jsx_render": 0.8, "framework_entry": 0.8, "dynamic_dispatch": 0.7, "callback": 0.7, "server-action": 0.7, "route-handler": 0.7, "event": 0.8, "reexport": 0.6, "reference": 0.5}  # fixed values
LEAST = {"import": 1, "inheritance": 1, "implements": 1, "call": 2, "type_usage": 3}  # fixed values: edges that join two files


def links(s, d):
    return edges(s, d).select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"), "kind", "strength")


def pivots(s, d, n: int = 5):
    return symbols(s, d, "centrality").orderBy(F.desc("centrality"), "id").limit(n).select("id")


def bfs_distance(s, d):
    return G.bfs(G.undirected(links(s, d)), pivots(s, d), 3).select("id", F.col("distance").cast("bigint").alias("distance"))


def costs(s, d, incoming: bool = False):
    """(src, dst, cost): kind by strength, cheaper within a directory, dearer into tests and copies; ``incoming`` edges, from dst to src, at 1.5 times the cost."""
    f = files(s, d, "path").select(F.col("id").alias("file_id"), "path")
    place = symbols(s, d, "file_id").join(f, "file_id").select("id", "path")
    rows = links(s, d)
    times = F.lit(1.0)
    if incoming:
        rows, times = rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "strength"), F.lit(1.5)
    rows = rows.join(place.select(F.col("id").alias("src"), F.col("path").alias("a")), "src").join(place.select(F.col("id").alias("dst"), F.col("path").alias("b")), "dst")
    kind = F.coalesce(F.create_map(*[F.lit(x) for i in KIND_COST.items() for x in i])[F.col("kind")], F.lit(1.0))
    base = kind / F.when(F.col("strength") > 0, F.col("strength")).otherwise(1.0)
    low = F.lower("b")
    factor = F.when(X.dirname(F.col("a")) == X.dirname(F.col("b")), 0.6).when(low.rlike("(^|/)(legacy|archive|old|prototype)/|_(legacy|demo|old|prototype|archive)[_/]"), 3.0).when(low.rlike("/(tests?|__tests?__|spec)/"), 1.8).when(low.rlike("/(vendor|third_party|external)/"), 2.5).when(low.rlike("(^|/)(examples?|samples?|demo)/"), 3.0).otherwise(1.0)
    return rows.select("src", "dst", (base * factor * times).alias("cost"))


def weighted_distance(s, d):
    """Cheapest ways below 4 over at most three outgoing edges, as its SQL says; ``weighted_reach`` is the whole traversal."""
    return G.weighted_distances(costs(s, d), pivots(s, d), 4.0, 3).select("id", F.round("cost", 6).alias("cost"))


def weighted_reach(s, d):
    """Cheapest ways below 4 over outgoing and incoming edges, to the fixpoint."""
    both = costs(s, d).unionByName(costs(s, d, incoming=True)).groupBy("src", "dst").agg(F.min("cost").alias("cost"))
    return G.weighted_distances(cut(both), pivots(s, d), 4.0, 1_000_000).select("id", F.round("cost", 6).alias("cost"))


def pagerank(s, d):
    return G.pagerank(symbols(s, d), links(s, d), rounds=20, tolerance=0).select("id", F.round("rank", 9).alias("rank"))


def file_links(s, d):
    owner = symbols(s, d, "file_id")
    rows = links(s, d).join(owner.select(F.col("id").alias("src"), F.col("file_id").alias("a")), "src").join(owner.select(F.col("id").alias("dst"), F.col("file_id").alias("b")), "dst").filter("a <> b")
    rows = rows.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(*[F.sum((F.col("kind") == k).cast("int")).alias(k) for k in LEAST])
    joined = (F.col("import") >= 1) | (F.col("inheritance") + F.col("implements") >= 1) | (F.col("call") >= 2) | (F.col("type_usage") >= 3)
    return rows.filter(joined).select("src", "dst")


def file_clusters(s, d):
    return G.components(files(s, d), file_links(s, d)).select(F.col("id").alias("file_id"), F.col("component").alias("cluster_id"))


def symbol_components(s, d):
    return G.components(symbols(s, d), links(s, d))


def strong_components(s, d):
    return G.strong_components(links(s, d))


def circular_count(s, d):
    return G.strong_components(links(s, d)).agg(F.countDistinct("component").alias("clusters"))


def topological_levels(s, d):
    return G.topological_levels(links(s, d)).select("id", F.col("level").cast("bigint").alias("level"))


def betweenness(s, d):
    return G.betweenness(symbols(s, d), links(s, d)).select("id", F.round("betweenness", 6).alias("betweenness"))


def impact_depth3(s, d):
    return G.impact(links(s, d), pivots(s, d)).select("root", "id", F.col("depth").cast("bigint").alias("depth"))


def shortest_path(s, d):
    """Between the twelve symbols with most outgoing and the twelve with most incoming edges."""
    rows = links(s, d)

    def top(column: str, name: str):
        return rows.groupBy(F.col(column).alias(name)).count().orderBy(F.desc("count"), name).limit(12).select(name)

    pairs = top("src", "a").join(top("dst", "b"), F.col("a") != F.col("b"))
    return G.shortest_paths(rows, pairs, 6).select("a", "b", F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def flow_paths(s, d):
    weight = F.coalesce(F.create_map(*[F.lit(x) for i in FLOW_WEIGHT.items() for x in i])[F.col("kind")], F.lit(0.5))
    rows = links(s, d).withColumn("weight", weight)
    roots = rows.groupBy(F.col("src").alias("id")).count().orderBy(F.desc("count"), "id").limit(5).select("id")
    return G.flows(rows, roots).select("root", "rank", F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"))


QUERIES = {f.__name__: f for f in (bfs_distance, weighted_distance, weighted_reach, pagerank, file_clusters, symbol_components, strong_components, circular_count, topological_levels, betweenness, impact_depth3, shortest_path, flow_paths)}
L = f"l as (select source_symbol_id src, target_symbol_id dst, kind, strength from {E})"
PIV = f"pv as (select id from {S} order by centrality desc, id limit 5)"
DIR = "case when contains({0}, '/') then regexp_replace({0}, '/[^/]*$', '') else '.' end"
COST = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in KIND_COST.items()) + " else 1.0 end::double"
REACH = "u as (select distinct src, dst from l where src <> dst), r(a, b) as (select src, dst from u union select r.a, u.dst from r join u on u.src = r.b)"
FL = f"""fl as (select least(a.file_id, b.file_id) src, greatest(a.file_id, b.file_id) dst from l join {S} a on a.id = l.src join {S} b on b.id = l.dst where a.file_id <> b.file_id group by all
having count(*) filter (where l.kind = 'import') >= 1 or count(*) filter (where l.kind in ('inheritance', 'implements')) >= 1 or count(*) filter (where l.kind = 'call') >= 2 or count(*) filter (where l.kind = 'type_usage') >= 3)"""
SQL = {
    "bfs_distance": f"with recursive {L}, {PIV}, u as (select src, dst from l union select dst, src from l), r(id, distance) as (select id, 0 from pv union select u.dst, r.distance + 1 from r join u on u.src = r.id where r.distance < 3) select id, cast(min(distance) as bigint) distance from r group by id",
    "weighted_distance": f"""with recursive {L}, {PIV}, pl as (select s.id, f.path from {S} s join files f on f.id = s.file_id), c as (select l.src, l.dst, {COST} / (case when strength > 0 then strength else 1.0 end) * (case when {DIR.format('a.path')} = {DIR.format('b.path')} then 0.6 when regexp_matches(lower(b.path), '(^|/)(legacy|archive|old|prototype)/|_(legacy|demo|old|prototype|archive)[_/]') then 3.0 when regexp_matches(lower(b.path), '/(tests?|__tests?__|spec)/') then 1.8 when regexp_matches(lower(b.path), '/(vendor|third_party|external)/') then 2.5 when regexp_matches(lower(b.path), '(^|/)(examples?|samples?|demo)/') then 3.0 else 1.0 end)::double cost from l join pl a on a.id = l.src join pl b on b.id = l.dst),
r(id, cost, hop) as (select id, 0.0::double, 0 from pv union select c.dst, r.cost + c.cost, r.hop + 1 from r join c on c.src = r.id where r.hop < 3 and r.cost + c.cost < 4) select id, round(min(cost), 6) cost from r group by id""",
    "file_clusters": f"with recursive {L}, {FL}, u as (select src, dst from fl union select dst, src from fl), r(a, b) as (select id, id from files union select r.a, u.dst from r join u on u.src = r.b) select a file_id, min(b) cluster_id from r group by a",
    "strong_components": f"with recursive {L}, {REACH}, m as (select x.a, x.b from r x join r y on x.a = y.b and x.b = y.a) select a id, least(a, min(b)) component from m where a <> b group by a union select src, src from l where src = dst and src not in (select a from m where a <> b)",
    "circular_count": f"with recursive {L}, {REACH}, m as (select x.a, x.b from r x join r y on x.a = y.b and x.b = y.a), c as (select a id, least(a, min(b)) component from m where a <> b group by a union select src, src from l where src = dst and src not in (select a from m where a <> b)) select count(distinct component) clusters from c",
    "impact_depth3": f"with recursive {L}, {PIV}, r(root, id, depth) as (select id, id, 0 from pv union select r.root, l.src, r.depth + 1 from r join l on l.dst = r.id where r.depth < 3 and (r.depth = 0 or l.kind not in ('import', 'reexport'))) select root, id, cast(min(depth) as bigint) depth from r group by all having min(depth) > 0",
    "shortest_path": f"with recursive {L}, u as (select distinct src, dst from l), pa as (select src id from l group by 1 order by count(*) desc, src limit 12), pb as (select dst id from l group by 1 order by count(*) desc, dst limit 12), r(a, b, path) as (select id, id, [id] from pa union all select r.a, u.dst, r.path || [u.dst] from r join u on u.src = r.b where len(r.path) < 7 and not list_contains(r.path, u.dst)), k as (select a, b, path, row_number() over (partition by a, b order by len(path), path) rn from r where a <> b and b in (select id from pb)) select a, b, array_to_string(list_transform(path, lambda x: x::varchar), '>') path from k where rn = 1",
}
N20 = "with recursive n as (select count(distinct id) n from symbols), l as (select source_symbol_id src, target_symbol_id dst from " + E + " where source_symbol_id in (select id from symbols) and target_symbol_id in (select id from symbols)), o as (select src, count(*) c from l group by 1), r0 as (select distinct id, 1.0::double / (select n from n) rank from symbols)"
for _i in range(1, 21):
    N20 += f", g{_i} as (select dst id, sum(rank / c) got from l join o using (src) join r{_i - 1} r on r.id = l.src group by 1), d{_i} as (select coalesce(sum(rank), 0) lost from r{_i - 1} where id not in (select src from o)), r{_i} as materialized (select r.id, 0.15 / (select n from n) + 0.85 * (coalesce(got, 0) + (select lost from d{_i}) / (select n from n)) rank from r{_i - 1} r left join g{_i} using (id))"
SQL["pagerank"] = N20 + " select id, round(rank, 9) rank from r20"
