"""Core operators: hand-computed cases, brute force and invariants."""

import random
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.stem import stem
from tessera.operators import graph as G
from tessera.operators import hierarchy as H
from tessera.operators import packing as P
from tessera.operators import retrieval as R
from tessera.operators import vectors as V
from tessera.plans import graphs, retrieval
from tessera.sources import tables as T
from tessera.streaming import watch


# hierarchies -----------------------------------------------------------------------------------------------------
def walk(parents, x):
    seen = [x]
    while parents[x] is not None and parents[x] in parents:
        x = parents[x]
        if x in seen:
            return min(seen[seen.index(x) :]), -1
        seen.append(x)
    return x, len(seen) - 1


@pytest.mark.parametrize(("seed", "family"), [(1, 100_000), (2, 3)])
def test_hierarchy_against_brute_force(spark, seed, family):
    random.seed(seed)
    n = 300
    parents = {i: random.choice([None, 0, 99_999, *[random.randrange(max(0, i - 20), n) for _ in range(6)]]) for i in range(n)}
    parents |= {1000 + i: 1000 + i - 1 for i in range(1, 120)} | {1000: None, 2000: 2000, 2001: 2000}
    parents |= {3000 + i: 3000 for i in range(1, 60)} | {3000: None}
    rows = [(i, p, f"n{i}", "x") for i, p in parents.items()]
    df = spark.createDataFrame(rows + rows[:7], "id long, up long, name string, depth string")
    tree = H.hierarchy(df, "id", "up", family_rows=family).cache()
    got = {r.id: r for r in tree.collect()}
    assert len(got) == len(parents)
    below = dict.fromkeys(parents, 0)
    for x in parents:
        root, depth = walk(parents, x)
        assert (got[x].root, got[x].depth) == (root, depth), x
        if depth > 0:
            y = x
            for _ in range(depth):
                y = parents[y]
                below[y] += 1
                assert got[y].entry < got[x].entry and got[x].exit < got[y].exit
    assert all(got[x].descendants == below[x] for x in parents if got[x].depth >= 0)
    assert H.ancestor_pairs(tree).count() == sum(r.depth for r in got.values() if r.depth > 0)
    path = {r.id: r.path for r in H.paths(tree, df.select("id", "name")).collect()}
    assert path[1003] == "n1000.n1001.n1002.n1003" and path[2001] is None


def test_hierarchy_edge_cases(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, None), (3, 77)], "id long, up long")
    got = {r.id: (r.root, r.depth, r.descendants) for r in H.hierarchy(df, "id", "up").collect()}
    assert got == {1: (1, 0, 1), 2: (1, 1, 0), 3: (3, 0, 0)}
    assert H.hierarchy(df.limit(0), "id", "up").count() == 0


# graph -----------------------------------------------------------------------------------------------------------
def edge_table(spark, pairs, kind="call"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "src long, dst long, kind string")


def node_table(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_graph_golden_cases(spark):
    chain = edge_table(spark, [(1, 2), (2, 3)])
    nodes = node_table(spark, [1, 2, 3])
    assert {r.id: r.betweenness for r in G.betweenness(nodes, chain).collect()} == {1: 0, 2: 1, 3: 0}
    assert {r.betweenness for r in G.betweenness(nodes, edge_table(spark, [(1, 2), (2, 3), (1, 3)])).collect()} == {0}
    ranks = {r.id: r.rank for r in G.pagerank(nodes, chain).collect()}
    assert all(v > 0 for v in ranks.values()) and abs(sum(ranks.values()) - 1) < 1e-6
    ring = edge_table(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    assert {(r.id, r.component) for r in G.strong_components(ring).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert {(r.id, r.component) for r in G.strong_components(edge_table(spark, [(7, 7), (1, 2)])).collect()} == {(7, 7)}
    assert {r.id: r.level for r in G.topological_levels(edge_table(spark, [(1, 2), (2, 3), (1, 3), (8, 9), (9, 8)])).collect()} == {1: 0, 2: 1, 3: 2, 8: -1, 9: -1}
    assert {r.id for r in G.impact(edge_table(spark, [(3, 2), (2, 1)]), node_table(spark, [1])).collect()} == {2, 3}
    mixed = edge_table(spark, [(2, 1)]).unionByName(edge_table(spark, [(3, 2)], "import"))
    assert {r.id for r in G.impact(mixed, node_table(spark, [1])).collect()} == {2}
    assert {r.id: r.distance for r in G.bfs(chain, node_table(spark, [1]), 1).collect()} == {1: 0, 2: 1}
    assert [r.path for r in G.shortest_paths(edge_table(spark, [(1, 3), (1, 2), (3, 4), (2, 4)]), spark.createDataFrame([(1, 4)], "a long, b long"), 4).collect()] == [[1, 2, 4]]


def test_components_against_union_find(spark):
    random.seed(4)
    pairs = [(random.randrange(200), random.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {i: i for i in {*range(200), *range(1000, 1061)}}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in G.components(node_table(spark, list(root)), edge_table(spark, pairs)).collect()}
    assert got == {i: find(i) for i in root}
    empty = edge_table(spark, pairs).limit(0)
    assert G.components(node_table(spark, [5]), empty).collect()[0].component == 5
    assert G.strong_components(empty).count() == 0 and G.topological_levels(empty).count() == 0


def test_weighted_reach_follows_incoming_edges_to_the_fixpoint(spark, tmp_path):
    spark.createDataFrame([(1, "a/x.py"), (2, "b/y.py"), (3, "a/z.py"), (4, "c/tests/t.py")], "id long, path string").write.parquet(f"{tmp_path}/files.parquet")
    # 1 to 5 are pivots without edges but 1; 10 to 18 follow by re-exports, one hop each
    symbols = [(i, 1, 9.0) for i in range(1, 6)] + [(i, 2, 1.0) for i in range(10, 19)] + [(20, 2, 1.0), (21, 3, 1.0), (22, 4, 1.0), (23, 2, 1.0)]
    spark.createDataFrame(symbols, "id long, file_id long, centrality double").write.parquet(f"{tmp_path}/symbols.parquet")
    edges = [(1, 10, "reexport", 1.0)] + [(i, i + 1, "reexport", 1.0) for i in range(10, 18)] + [(20, 1, "call", 1.0), (21, 1, "call", 1.0), (22, 1, "call", 1.0), (23, 20, "call", 0.5)]
    spark.createDataFrame([(n, *e) for n, e in enumerate(edges)], "id long, source_symbol_id long, target_symbol_id long, kind string, strength double").write.parquet(f"{tmp_path}/edges.parquet")
    got = {r.id: r.cost for r in graphs.weighted_reach(spark, str(tmp_path)).collect()}
    want = dict.fromkeys(range(1, 6), 0.0) | {10: 0.1} | {i: 0.1 + 0.06 * (i - 10) for i in range(11, 19)} | {20: 1.5, 21: 0.9, 22: 2.7, 23: 1.5 + 1.8}
    assert got == pytest.approx(want, abs=1e-6)


def test_weighted_distances_obey_the_triangle(spark):
    rows = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 0.5), (4, 5, 9.0)], "src long, dst long, cost double")
    assert {r.id: r.cost for r in G.weighted_distances(rows, node_table(spark, [1]), 4.0).collect()} == {1: 0, 2: 1, 3: 2, 4: 2.5}


# retrieval -------------------------------------------------------------------------------------------------------
def test_stemmer():
    assert [stem(w) for w in "caching running authentication validation connections management a an db jwt handler".split()] == "cach run authent valid connect manag a an db jwt handler".split()


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id long, text string")


def test_bm25(spark):
    index = R.postings(docs(spark, "hello world hello", "one two three four five", None, ""))
    assert {(r.term, r.tf) for r in index.filter("doc_id = 1").collect()} == {("hello", 2), ("world", 1)}
    assert R.corpus_stats(index).collect()[0][:2] == (2, 4.0)
    asked = spark.createDataFrame([(1, "hello"), (2, "the a an is"), (3, "helo wrld"), (4, "hello hello")], "query_id int, query string")
    out = R.bm25(index, R.query_terms(asked)).collect()
    score = {r.query_id: r.score for r in out}
    assert set(score) == {1, 4} and abs(score[4] - 2 * score[1]) < 1e-5
    assert {(r.query_id, r.layer) for r in R.with_fallback(index, asked).collect()} >= {(1, 1), (3, 3)}
    fixed = {r.term: r.nearest for r in R.corrected_terms(index, R.query_terms(asked)).collect()}
    assert fixed["helo"] == "hello" and fixed["wrld"] == "world"
    assert R.bm25(index.limit(0), R.query_terms(asked)).count() == 0


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id long, rank long")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, doc_id long, rank long")
    one, two = (sorted((r.doc_id, r.score) for r in R.fuse(x).collect()) for x in ([(a, 1.0), (b, 1.0)], [(b, 1.0), (a, 1.0)]))
    assert one == two and max(one, key=lambda r: r[1])[0] == 11


def test_asked_index_ranks_as_the_whole_index(spark):
    df = docs(spark, "hello world hello", "one two three four five", None, "", "the a an is", "World, one WORLD world", "nothing of it").union(docs(spark, "hello one", "one two three five four"))  # two ids twice
    asks = spark.createDataFrame([(1, "hello one hello"), (2, "world unheard"), (3, "the a"), (4, "")], "query_id int, query string")
    for queries in (asks, asks.filter("query_id > 2")):
        terms, whole = R.query_terms(queries), R.postings(df)
        index, stats = R.asked_index(df, terms)
        assert sorted(index.select("doc_id", "term", "dl", "tf").collect()) == sorted(whole.join(terms.select("term").distinct(), "term", "left_semi").select("doc_id", "term", "dl", "tf").collect())
        assert stats.collect() == R.corpus_stats(whole).collect()
        assert sorted(R.bm25(index, terms, 20, stats).collect()) == sorted(R.bm25(whole, terms).collect())


def broadcast_rows(plan):
    """The rows of each broadcast of a plan that has run."""
    name, children = plan.getClass().getSimpleName(), plan.children()
    if name == "BroadcastExchangeExec":
        yield plan.metrics().apply("numOutputRows").value()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.child()] if name == "ReusedExchangeExec" else [children.apply(i) for i in range(children.size())]
    for x in inner:
        yield from broadcast_rows(x)


def test_rrf_fuse_sends_no_postings_through_the_driver(spark, tmp_path):
    random.seed(6)
    words = [w for _, q in retrieval.ASKED for w in q.split()] + [f"w{i}" for i in range(40)]
    day = lambda i: datetime(2025, 1, 1 + i % 5) if i % 9 else None
    rows = [(i % 290, None if i % 13 == 0 else " ".join(random.choices(words, k=i % 40)), day(i)) for i in range(300)]  # nulls, ties and ids that come twice
    spark.createDataFrame(rows, "doc_id long, text string, created_at timestamp_ntz").write.parquet(f"{tmp_path}/documents.parquet")
    df = retrieval.rrf_fuse(spark, str(tmp_path))
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    sent = list(broadcast_rows(df._jdf.queryExecution().executedPlan()))
    assert sent and max(sent) <= R.query_terms(retrieval.asked(spark)).count()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(f"select query_id, rank, doc_id, score from ({retrieval.SQL['rrf_fuse']})").fetchall())


def test_text_functions(spark):
    row = spark.range(1).select(
        X.split_identifier(F.lit("parseHTTPRequest")).alias("a"), X.fuzzy(F.lit("AUTH"), F.lit("auth")).alias("b"), X.similarity(F.lit("ab"), F.lit("cd")).alias("c"), X.directory_weight(F.lit("legacy/tests/a.ts")).alias("d"),
        X.directory_weight(F.lit("packages/a/b.ts")).alias("e"), X.estimate_tokens(F.lit("12345678")).alias("f"), X.commit_type(F.lit("Fix(core)!: x")).alias("g"), X.truncate(F.lit("abcdefgh"), 6).alias("h"), X.plain_markdown(F.lit("[a](b) `c` **d**")).alias("i"),
        X.last_segments(F.lit("/a/b/c.ts"), 2).alias("j"), T.language_of(F.lit("x/Y.MTS")).alias("k"), T.ignored(F.lit("a/node_modules/b.js")).alias("l"), T.ignored(F.lit("a/b/.env.local")).alias("m"), T.ignored(F.lit("a/b.js")).alias("n"),
    ).collect()[0]
    assert row[:10] == (["parse", "http", "request"], 1.0, 0.0, 0.15, 1.15, 3, "fix", "abc...", "a c d", "b/c.ts")
    assert (row.k, row.l, row.m, row.n) == ("typescript", True, True, False)
    with pytest.raises(ValueError):
        X.glob_pattern("a/{b,c")


def test_quantize(spark):
    df = spark.createDataFrame([([0.5, -0.5, 0.5, 0.5],), ([0.0, 0.0],)], "v array<double>")
    assert [list(r[0]) for r in df.select(V.quantize(F.col("v"))).collect()] == [[64, -63, 64, 64], [0, 0]]


def test_exact_top_k_in_blocks(spark):
    random.seed(6)
    rows = [(i, i % 2, [random.uniform(-1, 1) for _ in range(8)]) for i in range(120)] + [(500, 0, None), (501, 0, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, space int, vector array<double>")
    one, many = (sorted(tuple(r) for r in V.exact_top_k(df, df.filter("id % 20 = 0"), 5, block_rows=b).collect()) for b in (4096, 7))
    assert one == many and len(one) == 30
    assert V.exact_top_k(df.limit(0), df, 5).count() == 0


# packing ---------------------------------------------------------------------------------------------------------
def test_packing_keeps_the_budget(spark):
    random.seed(7)
    rows = [(q, i, i % 9, 10 * i, 10 * i + random.randint(1, 40), random.random(), random.choice([0, 1, 2, 3]), random.randint(1, 400)) for q in (1, 2) for i in range(80)]
    df = spark.createDataFrame(rows, "query_id int, symbol_id long, file_id long, start_line int, end_line int, score double, level int, full_tokens long")
    out = P.pack(df, 1500).toPandas()
    assert (out.groupby("query_id").tokens.sum() <= 1500).all() and set(out.query_id) == {1, 2}
    assert not out.duplicated(["query_id", "symbol_id"]).any() and out.level.between(0, 3).all()
    assert P.pack(df.limit(0), 10).count() == 0


# sources, sinks, streams -----------------------------------------------------------------------------------------
def test_sinks(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id long, v string")
    assert sorted(map(tuple, T.insert_or_ignore(old, new, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, T.upsert(old, new.distinct(), ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_scan_and_log(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.py").write_text("y")
    rows = T.scan_tree(spark, str(tmp_path), "*.py").collect()
    assert len(rows) == 1 and rows[0].path.endswith("a.py") and rows[0].size == 6
    lines = ["commit\tabc\tAnn\t10\tfix: x", "M\tb.py", "A\ta.py", "commit\tdef\tBo\t20\tadd"]
    log = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "source string, line_no int, line string")
    assert sorted((r.hash, r.timestamp, r.files_changed) for r in T.git_log(log).collect()) == [("abc", 10_000, ["a.py", "b.py"]), ("def", 20_000, [])]


def test_export(spark):
    nodes = spark.createDataFrame([(1, 'a"<'), (2, "b")], "id long, name string")
    edges = spark.createDataFrame([(1, 2, "call"), (1, 9, "call")], "source long, target long, kind string")
    assert [r.line for r in T.export_graph(nodes, edges, "dot").filter("part = 'edge'").collect()] == ['  n1 -> n2 [label="call"];']
    assert "a&quot;&lt;" in "".join(r.line for r in T.export_graph(nodes, edges, "graphml").collect())
    assert T.export_graph(nodes, edges, "json").count() == 3


def event_rows(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    return spark.createDataFrame([("a", at(0), "add"), ("a", at(1), "change"), ("a", at(9), "change"), ("b", at(2), "add"), ("b", at(2), "add")], "path string, ts timestamp, event_type string")


def test_stream_equals_batch(spark, tmp_path):
    events = event_rows(spark)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    batch = {(r.path, r.last_type, r.events) for r in watch.debounced(events).collect()}
    assert batch == {("a", "change", 2), ("a", "change", 1), ("b", "add", 2)}
    query = watch.suppressed(stream, ["path", "event_type"]).writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.path, r.event_type) for r in spark.table("seen").collect()} == {("a", "add"), ("a", "change"), ("b", "add")}
    merged = watch.apply_changes(stream, str(tmp_path / "out"), "path", "ts", str(tmp_path / "state"))
    merged.awaitTermination(60)
    rows = {(r.path, r.event_type) for r in spark.read.parquet(str(tmp_path / "out" / "v=0")).collect()}
    assert rows == {("a", "change"), ("b", "add")}
