"""Budgeted retrieval for a batch of queries: pivots, neighbourhood, scores, selection, packing and assessment, keyed by ``query_id``.

Everything before packing is one plan over all queries. Queries without a pivot get no rows and an assessment that says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import query as Q
from tessera.functions import text as X
from tessera.operators import assess as A
from tessera.operators import packing as K
from tessera.operators import rendering as R
from tessera.session import cut

#: Pivots of a query, candidates that are scored (a visited cap), and those selected by intent.
PIVOTS, VISITED, SELECTED = 8, 300, 120
#: Layers of a code base by path.
LAYERS = [r"(^|/)(components?|views?|pages?)/", r"(^|/)(api|routes?|controllers?)/", r"(^|/)(services?|lib|server|utils?|helpers?)/", r"(^|/)(db|data|models?|repositories?|stores?|convex)/"]


def lower_quantile(values: Column, q: float) -> Column:
    """Of an array, the element at floor((n - 1) * q) in order; 0 of an empty one."""
    return F.coalesce(F.get(F.array_sort(values), F.floor((F.size(values) - 1) * q).cast("int")), F.lit(0.0))


def understood(queries: DataFrame) -> DataFrame:
    q = F.col("query")
    rows = queries.select("query_id", "query", Q.intent(q).alias("intent"), Q.terms(q).alias("terms"), Q.verbs(q).alias("verbs"))
    return rows.withColumn("terms", F.when(F.size("terms") > 0, F.col("terms")).otherwise(F.col("verbs"))).withColumn("wide", Q.synonyms(F.col("terms")))


def pivot_hits(symbols: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, lexical): words of names count 2, of signatures 1.5, of paths 1, a synonym half."""
    words = symbols.select("id", F.explode(F.concat(
        F.transform(X.split_identifier(F.col("name")), lambda w: F.struct(w.alias("term"), F.lit(2.0).alias("w"))), F.transform(X.split_identifier(F.regexp_replace("signature", "[^A-Za-z0-9_]+", " ")), lambda w: F.struct(w.alias("term"), F.lit(1.5).alias("w"))),
        F.transform(P.path_terms(F.col("path")), lambda w: F.struct(w.alias("term"), F.lit(1.0).alias("w"))), F.array(F.struct(F.lower("name").alias("term"), F.lit(2.0).alias("w"))),
    )).alias("x")).select("id", "x.term", "x.w").groupBy("id", "term").agg(F.max("w").alias("w"))
    terms = asked.select("query_id", "terms", F.explode("wide").alias("term")).select("query_id", "term", F.when(F.array_contains("terms", F.col("term")), 1.0).otherwise(0.5).alias("of"))
    return words.join(F.broadcast(terms), "term").groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("of")).alias("lexical"))  # terms of a batch of queries


def neighbourhood(pivots: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """(query_id, id, distance) of what lies within ``steps`` edges of a query's pivots, either way."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = pivots.select("query_id", "id", F.lit(0).alias("distance"))
    front = seen
    for step in range(1, steps + 1):
        front = front.join(both, front.id == both.src).select("query_id", F.col("dst").alias("id"), F.lit(step).alias("distance")).distinct()
        seen = seen.unionByName(front)
    return seen.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))


def scored(rows: DataFrame, mode: str, now_ms: int) -> DataFrame:
    """Scores of candidates (query_id, id, distance, lexical, degree, ... of a symbol): node score, locality, hubs, kinds, common names."""
    per_query = Window.partitionBy("query_id")
    rows = cut(rows)
    thresholds = rows.groupBy("query_id").agg(lower_quantile(F.collect_list("centrality"), 0.9).alias("hub_c"), lower_quantile(F.collect_list(F.col("degree").cast("double")), 0.9).alias("hub_d"), F.collect_set(F.when(F.col("distance") == 0, F.col("file_id"))).alias("pivot_files"), F.collect_set(F.when(F.col("distance") == 0, X.dirname(F.col("path")))).alias("pivot_dirs"))
    spread = rows.groupBy("query_id", F.lower("name").alias("low")).agg(F.countDistinct("file_id").alias("spread"))
    rows = rows.join(thresholds, "query_id").withColumn("low", F.lower("name")).join(spread, ["query_id", "low"]).drop("low")
    below = F.regexp_replace("path", "^[^/]+/", "")
    action = F.lower(F.concat_ws(" ", "name", "signature")).rlike("|".join(Q.ACTIONS))
    wide = F.col("intent").isin("broad", "task", "debug")
    ui = F.when(~Q.has_any(F.col("terms"), Q.FOCUS["ui"].split()) & wide & P.is_path(F.col("path"), "ui"), F.when(action, 0.82).otherwise(0.58)).otherwise(1.0)
    noisy = ~Q.has_any(F.col("terms"), Q.FOCUS["test"].split()) & P.is_path(F.col("path"), "noisy_test") & F.lit(mode != "debug")
    runtime = F.when(Q.has_any(F.col("terms"), Q.FOCUS["runtime"].split()), P.weight_of(F.col("kind"), P.RUNTIME_KINDS)).otherwise(1.0)
    left_out = F.col("intent").isin("broad", "task", "narrow") & (P.is_path(below, "vendored") | (~Q.has_any(F.col("terms"), Q.FOCUS["doc"].split()) & P.is_path(F.col("path"), "document")))
    # what is used several times is a column of its own, on a few hundred rows a query
    rows = cut(rows.select("*", X.directory_weight(below).alias("weight"), ui.alias("of_ui"), noisy.alias("noisy"), runtime.alias("of_kind"), left_out.alias("left_out"), X.dirname(F.col("path")).alias("dir")))
    pivot, narrow, broad = F.col("distance") == 0, F.col("intent") == "narrow", F.col("intent") == "broad"
    weight, noisy = F.col("weight"), F.col("noisy")
    near = F.when(F.array_contains("pivot_files", F.col("file_id")), 1.35).when(F.array_contains("pivot_dirs", F.col("dir")), 1.2).otherwise(1.0)
    locality = F.col("near") * weight * F.col("of_ui") * F.when(noisy, 0.3).otherwise(1.0)
    over = lambda c, t: F.when(t > 0, F.greatest(F.lit(0.0), (c - t) / t)).otherwise(0.0)
    rows = rows.select("*", near.alias("near"), F.greatest(over(F.col("centrality"), F.col("hub_c")), over(F.col("degree"), F.col("hub_d"))).alias("pressure"))
    pressure = F.col("pressure")
    relief = F.least(F.when(narrow, 0.4).otherwise(0.25), F.col("lexical") * 0.08)
    hub = F.greatest(F.when(narrow, 0.25).otherwise(0.15), 1 - pressure * F.when(narrow, 0.6).when(broad, 0.8).otherwise(0.9) + relief)
    hub = F.when(~pivot & (pressure > 0), hub).otherwise(1.0)
    age = (now_ms - F.col("last_seen")) / 86_400_000
    base = K.node_score(mode, F.col("distance"), F.col("centrality"), age, F.col("notes"), F.col("is_exported"), 1 + F.least(F.lit(1.5), F.col("lexical") * 0.3), pivot)
    same_file = F.array_contains("pivot_files", F.col("file_id"))
    seen = F.when(same_file | pivot, 1.0).otherwise(P.weight_of(F.col("visibility"), P.VISIBILITY))
    score = base * locality * hub * seen * F.col("of_kind")
    score = score * F.when(F.lit(mode != "debug") & (F.col("lexical") == 0) & (F.col("distance") > 1), 0.4).otherwise(1.0)
    score = score * F.when(~pivot & (F.col("lexical") == 0) & (F.col("spread") > 5), 5.0 / F.col("spread")).otherwise(1.0) * F.when(~pivot & noisy, 0.3).otherwise(1.0)
    kept = (pivot | (weight > 0.2)) & ~F.col("left_out") & ~(noisy & F.col("intent").isin("broad", "task", "narrow") & (~pivot | (F.col("lexical") == 0)))
    rows = rows.withColumn("score", F.round(score, 9)).filter(kept)
    return rows.withColumn("best", F.max("score").over(per_query)).withColumn("local", F.col("near") > 1.0)


def selected(rows: DataFrame, per_file: int = 4) -> DataFrame:
    """Pivots, and of the other candidates those that a query's intent lets through, up to a limit; of a broad query at most four a file."""
    overlap = F.size(F.array_intersect(F.concat(P.camel_words(F.col("name")), P.camel_words(F.col("signature"))), F.col("terms"))) > 0
    pivot, near, lexical = F.col("distance") == 0, F.col("distance") <= 1, F.col("lexical") >= 1
    relevant = (F.col("intent") == "broad") | near | overlap | (F.col("score") >= F.col("best") * 0.35)
    through = F.when(F.col("intent") == "narrow", (lexical | near) & (overlap | near)).when(F.col("intent") == "broad", (F.col("score") >= F.col("best") * 0.12) | lexical).otherwise(F.col("local") | (lexical & near))
    rows = rows.filter(pivot | (relevant & through))
    file_rank = F.row_number().over(Window.partitionBy("query_id", "file_id").orderBy(F.col("distance") != 0, F.desc("score"), "id"))
    rows = rows.withColumn("file_rank", file_rank).filter(pivot | (F.col("intent") != "broad") | (F.col("file_rank") <= per_file))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("distance") != 0, F.desc("score"), "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= SELECTED).drop("file_rank", "rank")


def capsule(symbols: DataFrame, edges: DataFrame, queries: DataFrame, budget: int = 4000, now_ms: int = 1_760_000_000_000, mode: str = "feature", notes: DataFrame | None = None, recent: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The packed rows and one row of assessment for each query.

    ``symbols``: (id, file_id, path, name, kind, signature, full_source, start_line, end_line, is_exported, visibility, centrality, last_seen);
    ``edges``: (src, dst); ``notes``: (id, n) notes of a symbol; ``recent``: (query_id, id) returned before in the session, which are told in one line.
    """
    asked = understood(queries)
    hits = cut(pivot_hits(symbols, asked))
    exact = F.array_contains("terms", F.lower("name")) | (F.lower("name") == F.lower(F.trim("query")))
    found = hits.join(F.broadcast(asked), "query_id").join(symbols.select("id", "name"), "id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.col("lexical") + F.when(exact, 50.0).otherwise(0.0)), "id"))
    pivots = cut(found.withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).select("query_id", "id", "lexical"))
    steps = 2 if budget < 10_000 else 3
    reach = neighbourhood(pivots, edges, steps).join(hits, ["query_id", "id"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", F.desc("lexical"), "id"))
    reach = reach.withColumn("place", place).filter(F.col("place") <= VISITED).drop("place")
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    degree = ends.join(reach.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    rows = reach.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    rows = rows.join(notes.select("id", F.col("n").alias("notes")), "id", "left").withColumn("notes", F.coalesce("notes", F.lit(0))) if notes is not None else rows.withColumn("notes", F.lit(0))
    # sources are read only for what is selected
    rows = rows.join(symbols.drop("full_source"), "id").join(F.broadcast(asked.drop("verbs", "wide")), "query_id")
    chosen = cut(selected(scored(rows, mode, now_ms)))
    level = K.level(F.col("score"), F.col("distance"), F.col("best"))
    if recent is not None:
        chosen = chosen.join(recent.select("query_id", "id", F.lit(True).alias("known")).distinct(), ["query_id", "id"], "left")
        level = F.when(F.col("known"), 3).otherwise(level)
    deps = edges.join(chosen.select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(symbols.select(F.col("id").alias("dst"), F.col("name").alias("dep")), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dep")).alias("deps"))
    chosen = chosen.join(symbols.select("id", "full_source"), "id").join(deps, "id", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))
    group = F.concat_ws("/", F.slice(F.split("path", "/"), 1, 3))
    chosen = cut(chosen.select("query_id", F.col("id").alias("symbol_id"), "file_id", "start_line", "end_line", "score", "lexical", "distance", level.alias("level"), R.tokens_of_levels(F.col("deps")).alias("sizes"), group.alias("grouping"), "path", "name", "signature", P.is_path(F.col("path"), "ui").alias("ui"), F.col("intent").isin("broad", "task").alias("story"), "intent"))
    packed = cut(K.pack_queries(chosen.drop("signature", "lexical", "intent"), budget))
    return packed, assessed(asked, pivots, reach, chosen, packed, budget)


def assessed(asked: DataFrame, pivots: DataFrame, reach: DataFrame, chosen: DataFrame, packed: DataFrame, budget: int) -> DataFrame:
    """(query_id, intent, symbols, files, used_tokens, ... confidence, label, uncertainty, reasons, bottlenecks) of each query."""
    inside = chosen.join(packed.filter("kind = 'symbol'").select("query_id", "symbol_id", F.col("level").alias("at")), ["query_id", "symbol_id"])
    wanted = chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("chosen"), F.sum((F.col("distance") > 0).cast("int")).alias("others"), F.sum(((F.col("distance") == 0) & (F.col("lexical") >= 2)).cast("int")).alias("relevant"), F.countDistinct("grouping").alias("clusters"))
    words = F.array_distinct(F.flatten(F.collect_set(F.concat(P.path_terms(F.col("path")), P.camel_words(F.concat_ws(" ", "name", "signature"))))))
    got = inside.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("symbols"), F.countDistinct("file_id").alias("files"), F.sum((F.col("distance") == 0).cast("int")).alias("pivots_packed"), F.sum(((F.col("distance") == 0) & (F.col("lexical") >= 2)).cast("int")).alias("relevant_packed"), F.sum((F.col("distance") > 0).cast("int")).alias("others_packed"),
        F.sum(((F.col("distance") > 0) & (F.col("lexical") < 1)).cast("int")).alias("noisy"), F.countDistinct("grouping").alias("clusters_packed"), words.alias("words"), F.array_distinct(F.flatten(F.collect_set(P.camel_words(F.col("name"))))).alias("name_words"), F.collect_set("path").alias("paths"),
    )
    busiest = inside.groupBy("query_id", "file_id").count().groupBy("query_id").agg(F.max("count").alias("max_per_file"))
    total = packed.groupBy("query_id").agg(F.sum("tokens").alias("used_tokens"), F.sum((F.col("kind") == "file").cast("int")).alias("summaries"))
    raw = reach.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))
    rows = asked.select("query_id", "intent", "terms")
    for part in (pivots.groupBy("query_id").agg(F.count(F.lit(1)).alias("pivots")), wanted, got, busiest, total, raw):
        rows = rows.join(part, "query_id", "left")
    rows = rows.na.fill(0)
    none = F.array().cast("array<string>")
    names, terms = F.coalesce("name_words", none), F.col("terms")

    def in_layer(pattern: str) -> Column:
        return F.exists(F.coalesce("paths", none), lambda p: F.lower(p).rlike(pattern))

    groups = F.filter(F.transform(Q.coverage_groups(terms), lambda g: F.filter(g, lambda w: F.length(w) > 2)), lambda g: F.size(g) > 0)
    met = F.size(F.filter(groups, lambda g: F.exists(g, lambda w: F.exists(F.coalesce("words", none), lambda k: P.covers(w, k)))))
    term_words = F.array_distinct(F.flatten(F.transform(terms, P.camel_words)))
    rows = rows.withColumn("n_groups", F.size(groups)).withColumn("n_met", met).withColumn("n_terms", F.size(term_words)).withColumn("n_named", F.size(F.array_intersect(term_words, names)))
    surface = F.when(F.col("intent") == "narrow", 1.0).otherwise(F.least(F.lit(1.0), (F.col("pivots") + F.col("symbols") + F.col("files") + F.col("summaries")) / F.when(F.col("intent") == "broad", 18).otherwise(14)))
    figures = {
        "intent": F.col("intent"), "dependency": A.ratio(F.col("others_packed"), F.col("others"), F.when(F.col("chosen") > 0, 1.0).otherwise(0.0)), "noise": A.ratio(F.col("noisy"), F.col("symbols"), F.lit(0.0)), "utilization": F.col("used_tokens") / budget,
        "term_coverage": A.ratio(F.col("n_met"), F.col("n_groups"), F.lit(1.0)), "surface": surface, "avg_per_file": A.ratio(F.col("symbols"), F.col("files"), F.lit(0.0)), "query_terms": F.size("terms"), "name_coverage": A.ratio(F.col("n_named"), F.col("n_terms"), F.lit(1.0)),
        "layers": sum((in_layer(r).cast("int") for r in LAYERS), F.lit(0)), "directories": F.size(F.array_distinct(F.transform(F.coalesce("paths", none), lambda p: F.concat_ws("/", F.slice(F.split(p, "/"), 1, 2))))),
    }
    rows = rows.select("query_id", "symbols", "files", "used_tokens", "chosen", "others", "candidates", *[figures.get(n, F.col(n) if n in rows.columns else F.lit(0)).alias(n) for n in A.FIGURES])
    c = {n: F.col(n) for n in A.FIGURES}
    rows = rows.withColumn("confidence", F.round(A.confidence(c), 6))
    rows = rows.withColumn("why", A.reasons(c, F.col("others"), F.col("confidence")))
    low = F.size("why") > 0
    stuck = A.bottlenecks(c, F.col("intent"), F.col("candidates"), F.col("chosen"), F.col("symbols"), F.col("files"), low, F.col("why"))
    return rows.select("query_id", "intent", "symbols", "files", "used_tokens", "confidence", A.label(F.col("confidence")).alias("label"), A.uncertainty(low, F.size("why"), F.col("confidence"), F.col("utilization")).alias("uncertainty"), F.array_join("why", "; ").alias("reasons"), F.array_join(stuck, ",").alias("bottlenecks"))
