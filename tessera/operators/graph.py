"""Graph operators: traversal, ranks, components, cycles, orders, centrality, impact and paths.

Edges are (src, dst) with further columns where an operator says so. Loops cut lineage each round and stop when nothing changes.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, distance) from the nearest seed, up to ``depth`` steps along src to dst."""
    seen = cut(seeds.select("id").distinct().withColumn("distance", F.lit(0)))
    front = seen
    for step in range(1, depth + 1):
        found = edges.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = cut(found.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(step)))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def weighted_distances(edges: DataFrame, seeds: DataFrame, most_cost: float, hops: int = 8) -> DataFrame:
    """(id, cost): cheapest way from a seed over at most ``hops`` edges (src, dst, cost), below ``most_cost``."""
    best = cut(seeds.select("id").distinct().withColumn("cost", F.lit(0.0)))
    front = best
    for _ in range(hops):
        found = edges.join(front.select(F.col("id").alias("src"), F.col("cost").alias("so_far")), "src").select(F.col("dst").alias("id"), (F.col("so_far") + F.col("cost")).alias("cost")).filter(F.col("cost") < most_cost)
        found = found.groupBy("id").agg(F.min("cost").alias("cost"))
        front = cut(found.join(best.select("id", F.col("cost").alias("old")), "id", "left").filter("old is null or cost < old - 1e-12").select("id", "cost"))
        if not front.limit(1).count():
            break
        best = cut(best.unionByName(front).groupBy("id").agg(F.min("cost").alias("cost")))
    return best


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-6, together: int = 5) -> DataFrame:
    """(id, rank): parallel edges count, edges with a missing end are dropped, dangling mass is spread evenly; ranks sum to 1.

    The ranks after k rounds are a sum of v_j = (damping * links)^j applied to ones, with weights that follow from what each v_j loses at dangling nodes.
    So rounds only append v_j to an array, none waits for a sum on the driver, and ``together`` rounds are one job; their change is looked at after each job.
    """
    nodes = nodes.select("id").distinct()
    edges = edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    counted = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))
    out = Window.partitionBy("src")
    links = cut(counted.select("src", "dst", (damping * F.col("times") / F.sum("times").over(out)).alias("share")))
    ends = links.select(F.col("src").alias("id"), F.lit(True).alias("has_out")).distinct()
    state = cut(nodes.join(ends, "id", "left").select("id", F.coalesce("has_out", F.lit(False)).alias("has_out"), F.array(F.lit(1.0)).alias("v")))
    n = state.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    done, lost, weights = 0, [], [1.0 / n]
    while True:
        steps, held = min(together, rounds - done), []
        for _ in range(steps):
            got = links.join(state.select(F.col("id").alias("src"), F.element_at("v", -1).alias("x")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("x")).alias("got"))
            state = state.join(got, "id", "left").select("id", "has_out", F.concat("v", F.array(F.coalesce("got", F.lit(0.0)))).alias("v")).persist()
            held.append(state)
        state = cut(state)
        for df in held:
            df.unpersist()
        sums = state.filter(~F.col("has_out")).agg(*[F.coalesce(F.sum(F.get("v", F.lit(j))), F.lit(0.0)) for j in range(done + steps)]).first() if done + steps else []
        lost = list(sums)
        before = weights
        # weights of v_0, v_1, ... in the ranks of each round
        weights = [1.0 / n]
        for k in range(done + steps):
            before = weights
            mass = sum(w * s for w, s in zip(weights, lost, strict=False))
            weights = [((1 - damping) + damping * mass) / n, *weights]
        done += steps
        weigh = lambda ws: sum((F.get("v", F.lit(j)) * w for j, w in enumerate(ws)), F.lit(0.0))
        if done >= rounds or tolerance > 0 and state.agg(F.sum(F.abs(weigh(weights) - weigh(before)))).first()[0] < tolerance:
            return state.select("id", weigh(weights).alias("rank"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each connected component, by alternating large and small stars.

    The number of rounds is logarithmic in the number of nodes, whatever the diameter.
    """
    links = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct()
    links = cut(links)

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(low, "u")
        if large:
            return out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        return out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    while True:
        new = cut(star(star(links, large=True), large=False))
        same = new.exceptAll(links).limit(1).count() == 0 and links.exceptAll(new).limit(1).count() == 0
        links = new
        if same:
            break
    return nodes.select("id").distinct().join(links.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes on cycles: forward and backward colouring, after trimming what lies on none.

    A self-loop alone is a component of one node.
    """
    edges = cut(edges.select("src", "dst").distinct())
    loops = edges.filter("src = dst").select(F.col("src").alias("id"))
    rest, found = edges.filter("src <> dst"), None
    while True:
        # trim: nodes without an incoming or an outgoing edge are on no cycle
        while True:
            size = rest.count()
            rest = cut(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            if rest.count() == size:
                break
        if not size:
            break
        colour = cut(rest.select(F.col("src").alias("id")).union(rest.select("dst")).distinct().withColumn("colour", F.col("id")))
        while True:  # the largest id that reaches a node is its colour
            step = rest.join(colour.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("new"))
            new = cut(colour.join(step, "id", "left").select("id", F.greatest("colour", F.coalesce("new", "colour")).alias("colour"), F.col("colour").alias("old")))
            colour = new.select("id", "colour")
            if not new.filter("colour <> old").limit(1).count():
                break
        # of one colour, those that reach its root form the component
        back = rest.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("c2")), "dst").filter("c = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        members = bfs(back, colour.filter("id = colour").select("id"), 1_000_000).select("id")
        got = cut(members.join(colour, "id").select("id", F.col("colour").alias("component")))
        found = got if found is None else cut(found.unionByName(got))
        rest = cut(rest.join(got.select(F.col("id").alias("src")), "src", "left_anti").join(got.select(F.col("id").alias("dst")), "dst", "left_anti"))
    alone = loops.select("id", F.col("id").alias("component"))
    if found is None:
        return alone
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).filter("n > 1")
    found = found.join(sizes, "component").select("id", F.col("low").alias("component"))
    return found.unionByName(alone.join(found.select("id"), "id", "left_anti"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """(id, level): the longest way from a node without incoming edges; nodes on or behind cycles have level -1."""
    rest = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    nodes = cut(rest.select(F.col("src").alias("id")).union(rest.select("dst")).distinct())
    out, level, left = None, 0, nodes
    while True:
        ready = cut(left.join(rest.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        if not ready.limit(1).count():
            break
        out = ready if out is None else out.unionByName(ready)
        left = cut(left.join(ready.select("id"), "id", "left_anti"))
        rest = cut(rest.join(ready.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    stuck = left.withColumn("level", F.lit(-1))
    return stuck if out is None else out.unionByName(stuck)


def betweenness(nodes: DataFrame, edges: DataFrame, most_nodes: int = 100_000) -> DataFrame:
    """(id, betweenness), directed and not normalized; parallel edges multiply paths.

    The adjacency is broadcast, which the documented bound ``most_nodes`` keeps small; beyond it all values are 0. Sources are spread over tasks.
    """
    nodes = nodes.select("id").distinct()
    if nodes.count() > most_nodes:
        return nodes.withColumn("betweenness", F.lit(0.0))
    follow: dict[int, list[int]] = defaultdict(list)
    for row in edges.select("src", "dst").toLocalIterator():
        follow[row[0]].append(row[1])
    shared = nodes.sparkSession.sparkContext.broadcast(dict(follow))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, float] = defaultdict(float)
        for batch in batches:
            for source in batch["id"]:
                order, ways, dist, before = [], {source: 1.0}, {source: 0}, defaultdict(list)
                queue = deque([source])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in shared.value.get(v, ()):
                        if w not in dist:
                            dist[w] = dist[v] + 1
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            ways[w] = ways.get(w, 0.0) + ways[v]
                            before[w].append(v)
                share: dict[int, float] = defaultdict(float)
                for w in reversed(order):
                    for v in before[w]:
                        share[v] += ways[v] / ways[w] * (1 + share[w])
                    if w != source:
                        sums[w] += share[w]
        yield pd.DataFrame({"id": list(sums), "b": list(sums.values())})

    sources = edges.select(F.col("src").alias("id")).distinct().repartition("id")
    part = sources.mapInPandas(run, "id bigint, b double").groupBy("id").agg(F.sum("b").alias("b"))
    return nodes.join(part, "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def impact(edges: DataFrame, roots: DataFrame, depth: int = 3, only_first: tuple[str, ...] = ("import", "reexport")) -> DataFrame:
    """(root, id, depth) of what depends on each root: edges (src, dst, kind) backwards, the kinds of ``only_first`` only from the root itself."""
    front = cut(roots.select(F.col("id").alias("root"), "id").distinct().withColumn("depth", F.lit(0)))
    seen = front
    for step in range(1, depth + 1):
        usable = edges if step == 1 else edges.filter(~F.col("kind").isin(*only_first))
        found = usable.join(front.select("root", F.col("id").alias("dst")), "dst").select("root", F.col("src").alias("id")).distinct()
        front = cut(found.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int) -> DataFrame:
    """(a, b, path): a shortest way for each pair along src to dst, ties by the smaller ids; none where there is none within ``hops``."""
    links = edges.select("src", "dst").distinct()
    front = cut(pairs.select(F.col("a").alias("start")).distinct().select("start", F.col("start").alias("at"), F.array("start").alias("path")))
    seen = front
    for _ in range(hops):
        found = front.join(links, front.at == links.src).select("start", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        found = found.groupBy("start", "at").agg(F.min("path").alias("path"))
        front = cut(found.join(seen.select("start", "at"), ["start", "at"], "left_anti"))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return pairs.join(seen, (pairs.a == seen.start) & (pairs.b == seen["at"])).select("a", "b", "path")


def flows(edges: DataFrame, roots: DataFrame, hops: int = 3, most: int = 10) -> DataFrame:
    """(root, rank, path): simple outgoing ways of up to ``hops`` edges (src, dst, kind, weight), two of each first branch a round.

    Ways of imports only are left out; ways stop where nothing follows or at ``hops``.
    """
    rows = cut(roots.select(F.col("id").alias("root"), F.array("id").alias("path"), F.lit(0.0).alias("weight"), F.lit(True).alias("imports")))
    done = None
    links = edges.select("src", "dst", "weight", (F.col("kind") == "import").alias("imp")).groupBy("src", "dst").agg(F.max("weight").alias("w"), F.min("imp").alias("imp"))
    for step in range(hops):
        grown = rows.join(links, F.element_at(rows.path, -1) == links.src, "left")
        ended = grown.filter(F.col("dst").isNull()).select("root", "path", "weight", "imports")
        grown = grown.filter(F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst"))).select("root", F.concat("path", F.array("dst")).alias("path"), (F.col("weight") + F.col("w")).alias("weight"), (F.col("imports") & F.col("imp")).alias("imports"))
        done = ended if done is None else done.unionByName(ended)
        rows = cut(grown)
    done = done.unionByName(rows).filter((F.size("path") > 1) & ~F.col("imports")).distinct()
    branch = Window.partitionBy("root", F.element_at("path", 2)).orderBy(F.desc("weight"), "path")
    done = done.withColumn("turn", F.floor((F.row_number().over(branch) - 1) / 2))
    rank = F.row_number().over(Window.partitionBy("root").orderBy("turn", F.element_at("path", 2), F.desc("weight"), "path"))
    return done.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= most).select("root", "rank", "path")
