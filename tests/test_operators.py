"""Packing, assessment, query understanding, memory search, ignore rules, ranks: brute force, golden cases and invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import query as Q
from tessera.operators import assess as A
from tessera.operators import capsule as C
from tessera.operators import graph as G
from tessera.operators import packing as K
from tessera.operators import rendering as R
from tessera.operators import retrieval as M
from tessera.plans import explore, ingest
from tessera.sources import tables as T


def some_items(seed, n=60):
    random.seed(seed)
    out = []
    for i in range(n):
        whole = random.randint(20, 500)
        a = random.randint(1, 300)
        out.append(K.Item(i, i % 7, a, a + random.randint(0, 60), random.random(), random.randint(0, 3), (whole, whole // 2 + 1, 18, 6), random.randint(0, 2), f"g{i % 4}", f"f{i % 7}.ts", f"name{i}"))
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("budget", [0, 30, 400, 3000, 100_000])
def test_packing_invariants(seed, budget):
    items = some_items(seed)
    for shelf in (K.pack_plain(items, budget), K.pack_story(items, budget, budget * 5 // 4)):
        assert shelf.used == sum(i.sizes[shelf.at[i.id]] for i in shelf.items.values()) <= budget
        for inner in shelf.items.values():
            for outer in shelf.items.values():
                assert not (outer.file == inner.file and outer.first < inner.first and inner.last <= outer.last and shelf.at[outer.id] <= shelf.at[inner.id])
        used = shelf.used
        lines = K.file_lines(items, shelf)
        assert shelf.used == used + sum(n for _, n in lines) <= max(budget, 0)
    assert K.pack_plain([], 10).used == K.pack_story([], 10, 10).used == 0


def test_the_best_pivot_is_whole_and_first():
    items = some_items(3)
    for item in items:
        item.distance = 1
    items[9].distance, items[9].score = 0, 2.0
    shelf = K.pack_plain(items, 2000)
    assert next(iter(shelf.at)) == 9 and shelf.at[9] == 0


def test_merging_keeps_each_symbol_once_at_its_fullest():
    a, b = K.Shelf(1000), K.Shelf(1000)
    one, two = some_items(1, 6), some_items(1, 6)
    a.put(one[0], 2), a.put(one[1], 3), b.put(two[0], 1), b.put(two[2], 3)
    merged = K.merged_items([(one, a, {one[1].id}), (two, b, set())])
    assert [i.id for i in merged] == [1, 0, 2] and len({i.id for i in merged}) == 3


def test_packing_queries(spark):
    rows = [(q, i.id, i.file, i.first, i.last, i.score, i.level, list(i.sizes), i.distance, i.group, i.path, i.name, q == 2) for q in (1, 2) for i in some_items(q)]
    df = spark.createDataFrame(rows, "query_id int, symbol_id long, file_id long, start_line int, end_line int, score double, level int, sizes array<long>, distance int, grouping string, path string, name string, story boolean")
    out = K.pack_queries(df, 2000).toPandas()
    assert (out.groupby("query_id").tokens.sum() <= 1600).all() and set(out.query_id) == {1, 2}
    for _, part in out.groupby("query_id"):
        assert sorted(part.position) == list(range(len(part)))
    parts = df.withColumn("sub", F.when(F.col("symbol_id") % 2 == 0, 1).otherwise(2)).withColumn("share", F.lit(0.5)).drop("story")
    both = K.merge_queries(parts, 2000).toPandas()
    assert not both.duplicated(["query_id", "symbol_id"]).any() and (both.groupby("query_id").tokens.sum() <= 1600).all()
    assert K.pack_queries(df.limit(0), 100).count() == 0


def test_rendering_long_sources(spark):
    lines = [f"line {i} of the source" for i in range(400)]
    rows = [(1, "a/b.ts", "f", "function", "f()", "\n".join(lines), 10, 409, True), (2, "a/b.ts", "g", "function", "g()", "return 1", 1, 1, False), (3, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, path string, name string, kind string, signature string, full_source string, start_line int, end_line int, is_exported boolean")
    out = {r.id: r for r in df.select("id", R.level0().alias("l0"), R.level1().alias("l1"), R.level2(F.array(*[F.lit(x) for x in "abcdefg"])).alias("l2"), R.level3().alias("l3"), R.tokens_of_levels().alias("t")).collect()}
    head = out[1].l0.split("\n")
    assert head[0] == "// a/b.ts:10-409" and head[1] == lines[0] and head[-3:] == lines[-3:] and "more lines; read f" in out[1].l0 and out[1].t[0] <= R.CAP
    kept = len(head) - 2 - 3
    assert head[-4] == f"// ... {400 - kept - 3} more lines; read f for the full source"
    assert len(out[1].l1.split("\n")) == 102 and "300 lines omitted" in out[1].l1
    assert out[2].l0 == "// a/b.ts:1-1\nreturn 1" and out[2].l3 == "function g @ a/b.ts:1" and out[2].l2.endswith("deps: a, b, c, d, e, +2 more")
    assert all(n >= 1 for n in out[3].t)


def test_confidence_golden_cases(spark):
    base = dict(intent="narrow", pivots=4, pivots_packed=4, relevant_packed=4, relevant=4, dependency=1.0, noise=0.0, summaries=5, utilization=0.9, term_coverage=1.0, surface=1.0, clusters_packed=2, clusters=2, avg_per_file=3.0, max_per_file=3.0, layers=0, directories=1, query_terms=2, name_coverage=1.0)
    cases = [({}, 1.0), ({"utilization": 0.1}, 0.25), ({"noise": 0.65}, 0.35), ({"pivots_packed": 1, "relevant_packed": 1}, 0.45), ({"query_terms": 1, "directories": 3}, 0.8), ({"intent": "broad", "layers": 1}, 0.40), ({"intent": "task", "layers": 2}, 0.60), ({"clusters_packed": 7}, 0.85), ({"name_coverage": 0.1}, 0.5), ({"pivots": 0, "pivots_packed": 0, "relevant": 0, "relevant_packed": 0}, 0.45)]
    rows = [tuple({**base, **change}[n] for n in A.FIGURES) for change, _ in cases]
    kinds = {"intent": "string", "dependency": "double", "noise": "double", "utilization": "double", "term_coverage": "double", "surface": "double", "avg_per_file": "double", "max_per_file": "double", "name_coverage": "double"}
    df = spark.createDataFrame(rows, ", ".join(f"{n} {kinds.get(n, 'int')}" for n in A.FIGURES))
    got = [r[0] for r in df.select(A.confidence({n: F.col(n) for n in A.FIGURES})).collect()]
    assert got == pytest.approx([want for _, want in cases], abs=1e-9)


def test_query_parts(spark):
    rows = [(1, "refactor the session token"), (2, "how does the request flow reach the cache layer of each store"), (3, "drainRetry"), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "n int, query string").withColumn("p", Q.parts(F.col("query")))
    out = {r.n: r.p for r in df.collect()}
    assert [p.priority for p in out[1]] == [1, 2, 3] and all("session" in p.terms for p in out[1]) and out[1][0].terms[-1] != out[1][1].terms[-1]
    assert all(abs(sum(p.share for p in out[n]) - 1) < 1e-9 for n in (1, 2, 3)) and 1 < len(out[2]) <= 4
    assert out[3][0].terms == ["drainretry"] and out[4][0].terms == []


def test_memory_search_routes(spark):
    docs = spark.createDataFrame([(1, "the login of an account expires", "decision", 1.0, False, 1.0), (2, "session token renewal", "passive", 1.0, False, 1.0), (3, "session token renewal", "passive", 1.0, False, 30.0), (4, "auth broken", "decision", 0.5, True, 1.0), (5, None, "decision", 1.0, False, 1.0), (6, "unrelated xylophonist", "decision", 0.9, None, 1.0)], "doc_id long, text string, scope string, confidence double, stale boolean, age_days double")
    queries = spark.createDataFrame([(1, "auth"), (2, "who resets the auth of users here"), (3, "xylophonis"), (4, "")], "query_id int, query string")
    out = M.memory_search(docs, queries, {"decision": 2.0, "passive": 0.1}).toPandas()
    by = {q: list(part.sort_values("rank").doc_id) for q, part in out.groupby("query_id")}
    assert by[1] == [1, 2] and set(by[2]) >= {1} and by[3] == [6]  # synonyms; prose; the fuzzy or trigram layer
    assert not set(out.doc_id) & {3, 4, 5}
    assert M.memory_search(docs.limit(0), queries, {}).count() == 0


def test_ignore_rules():
    import re

    ignored = lambda path, rules: next((not r.startswith("!") for r in reversed(rules) if re.search(ingest.rule_pattern(r.removeprefix("!")), path)), False)
    rules = ["*.log", "build/", "/root.txt", "a/**/z", "!keep.log"]
    assert ignored("x/y.log", rules) and ignored("build/x", rules) and ignored("q/build/x", rules) and ignored("root.txt", rules) and ignored("a/b/c/z", rules)
    assert not ignored("x/keep.log", rules) and not ignored("build", rules) and not ignored("x/root.txt", rules) and not ignored("y.logs", rules)


def test_lines_within_against_brute_force(spark):
    random.seed(2)
    around = [(i, i % 3, a, a + random.randint(-3, 400)) for i in range(120) for a in [random.randint(-5, 900)]]
    probes = [(i % 3, random.randint(-5, 1300)) for i in range(200)]
    p, y = spark.createDataFrame(probes, "file_id int, line int"), spark.createDataFrame(around, "id int, file_id int, start_line int, end_line int")
    got = sorted((r.file_id, r.line, r.id) for r in explore.within_lines(p, y).collect())
    assert got == sorted((f, x, i) for f, x in probes for i, g, a, b in around if f == g and a <= x <= b)


@pytest.mark.parametrize("together", [1, 3, 5])
def test_ranks_against_power_iteration(spark, together):
    rng = np.random.default_rng(4)
    n, pairs = 30, rng.integers(0, 24, (80, 2))
    links = np.zeros((n, n))
    for a, b in pairs:
        links[b, a] += 1
    out = links.sum(0)
    rank = np.full(n, 1 / n)
    for _ in range(200):
        rank = 0.15 / n + 0.85 * (links[:, out > 0] / out[out > 0] @ rank[out > 0] + rank[out == 0].sum() / n)
    nodes = spark.range(n)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in pairs] + [(3, 999)], "src long, dst long")
    got = {r.id: r["rank"] for r in G.pagerank(nodes, edges, together=together).collect()}
    assert np.abs(np.array([got[i] for i in range(n)]) - rank).sum() < 1e-5 and abs(sum(got.values()) - 1) < 1e-6
    assert G.pagerank(nodes.limit(0), edges).count() == 0


def test_paths(spark):
    rows = [("a/b/../c",), ("/a",), ("C:\\a",), ("a\\b.ts",), ("",), (None,)]
    df = spark.createDataFrame(rows, "p string")
    assert [r[0] for r in df.select(P.is_safe(F.col("p"))).collect()] == [False, False, False, True, False, None]
    assert [r[0] for r in spark.createDataFrame([("/w/x", "/w/x//a\\b"), ("/w", "/w"), ("/w", "/v/a"), ("w/", "./w/a")], "r string, p string").select(P.relative(F.col("r"), F.col("p"))).collect()] == ["a/b", ".", "/v/a", "a"]


def test_capsule_edge_cases(spark):
    columns = "id long, file_id long, path string, name string, kind string, signature string, full_source string, start_line int, end_line int, is_exported boolean, visibility string, centrality double, last_seen long"
    rows = [(1, 1, "r/src/a.ts", "drainRetry", "function", "drainRetry()", "x", 1, 5, True, "public", 0.1, 0), (2, 1, "r/src/a.ts", "helper", "function", "helper()", None, 6, 9, False, None, 0.0, 0), (3, 2, "r/src/b.ts", "other", None, None, "", 1, 1, None, "private", None, None)]
    symbols, edges = spark.createDataFrame(rows, columns), spark.createDataFrame([(1, 2), (2, 3), (1, 77)], "src long, dst long")
    queries = spark.createDataFrame([(1, "drainRetry"), (2, ""), (3, "nowhere to be seen")], "query_id int, query string")
    packed, report = C.capsule(symbols, edges, queries, 500)
    out = packed.toPandas()
    assert set(out.query_id) == {1} and out.sort_values("position").symbol_id.iloc[0] == 1
    told = {r.query_id: r for r in report.collect()}
    assert set(told) == {1, 2, 3} and told[3].symbols == 0 and "no pivot" in told[3].reasons and told[1].confidence is not None
    assert C.capsule(symbols.limit(0), edges.limit(0), queries, 500)[0].count() == 0


def test_language_lists():
    assert {T.LANGUAGES[e] for e in (".tsx", ".jsx", ".hh", ".rake", ".bash")} == {"tsx", "jsx", "cpp", "ruby", "bash"} and len(T.LANGUAGES) == 33
