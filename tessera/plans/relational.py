"""Filters, joins, aggregations, windows and set operations over the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.sources.tables import once, table

NOW = 1_760_000_000_000  # the time that recency is counted from, epoch ms
CALLABLE = ["function", "method", "arrow"]


def files(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(s, d, "files").select("id", *columns)


def symbols(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return once(table(s, d, "symbols"), *columns)


def edges(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "edges"), "source_symbol_id", "target_symbol_id", "kind", "strength")


def chunks(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return once(table(s, d, "chunks"), *columns)


def like_escape(s, d):
    return files(s, d, "path").filter(F.expr(r"lower(path) like '%node\\_modules%' or lower(path) like '%\\_generated.%'")).select("id", "path")


def nocase_lookup(s, d):
    return symbols(s, d, "name", "kind").filter(F.lower("name") == "handle").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def path_suffix(s, d):
    """Files that end with another file's last two segments: the shortest path of each suffix."""
    rows = files(s, d, "path").withColumn("suffix", X.last_segments(F.col("path"), 2))
    best = Window.partitionBy("suffix").orderBy(F.length("path"), "path")
    return rows.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("suffix", "path")


def glob_filter(s, d):
    return files(s, d, "path", "language").filter(F.col("path").rlike(X.glob_pattern("**/{src,lib}/**/*.{ts,py}"))).select("id", "path", "language")


def join_symbol_file(s, d):
    rows = symbols(s, d, "file_id", "kind", "start_line", "end_line").join(files(s, d, "language").withColumnRenamed("id", "file_id"), "file_id")
    return rows.groupBy("language", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("end_line") - F.col("start_line") + 1).cast("bigint")).alias("lines"))


def file_pair_edges(s, d):
    """File pairs, either way round, joined by at least one edge."""
    owner = symbols(s, d, "file_id")
    rows = edges(s, d).join(owner.select(F.col("id").alias("source_symbol_id"), F.col("file_id").alias("a")), "source_symbol_id").join(owner.select(F.col("id").alias("target_symbol_id"), F.col("file_id").alias("b")), "target_symbol_id")
    rows = rows.filter("a <> b").groupBy(F.least("a", "b").alias("file_a"), F.greatest("a", "b").alias("file_b"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return rows.filter("n >= 1")


def top_neighbours(s, d, k: int = 6):
    """Up to six strongest neighbours of each symbol over calls, imports, inheritance and implementation, either way."""
    rows = edges(s, d).filter(F.col("kind").isin("call", "import", "inheritance", "implements"))
    both = rows.select(F.col("source_symbol_id").alias("node"), F.col("target_symbol_id").alias("neighbour"), "strength", "id").unionByName(rows.select(F.col("target_symbol_id").alias("node"), F.col("source_symbol_id").alias("neighbour"), "strength", "id"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("strength"), "id", "neighbour"))
    return both.filter("node <> neighbour").withColumn("rank", rank).filter(F.col("rank") <= k).select("node", "neighbour", "strength", F.col("rank").cast("bigint").alias("rank"))


def dead_symbols(s, d):
    """Functions, methods and arrows that are not exported and that no edge points to."""
    rows = symbols(s, d, "name", "kind", "is_exported").filter(~F.col("is_exported") & F.col("kind").isin(CALLABLE))
    return rows.join(edges(s, d).select(F.col("target_symbol_id").alias("id")), "id", "left_anti").select("id", "name", "kind")


def enclosing_symbol(s, d):
    """The smallest symbol around the first line of each chunk."""
    probe = chunks(s, d, "file_id", "start_line").select(F.col("id").alias("chunk_id"), "file_id", F.col("start_line").alias("line"))
    around = symbols(s, d, "file_id", "start_line", "end_line")
    hit = probe.join(around, "file_id").filter("line between start_line and end_line")
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "id"))
    return hit.withColumn("rank", rank).filter("rank = 1").select("chunk_id", F.col("id").alias("symbol_id"))


def chunk_symbols(s, d, k: int = 8):
    """The eight most central symbols inside each chunk's lines."""
    outer = chunks(s, d, "file_id", "start_line", "end_line").select(F.col("id").alias("chunk_id"), "file_id", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    inner = symbols(s, d, "file_id", "start_line", "end_line", "centrality")
    hit = outer.join(inner, "file_id").filter("start_line >= a and end_line <= b")
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("centrality"), "id"))
    return hit.withColumn("rank", rank).filter(F.col("rank") <= k).select("chunk_id", F.col("id").alias("symbol_id"), F.col("rank").cast("bigint").alias("rank"))


def chunk_overlap(s, d):
    """Chunks of a file and the symbols whose lines overlap theirs: how many, and the most central one's centrality."""
    outer = chunks(s, d, "file_id", "start_line", "end_line").select(F.col("id").alias("chunk_id"), "file_id", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    hit = outer.join(symbols(s, d, "file_id", "start_line", "end_line", "centrality"), "file_id").filter("start_line <= b and end_line >= a")
    return hit.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("centrality"), 9).alias("centrality"))


def embedding_coverage(s, d):
    have = once(table(s, d, "chunk_embeddings"), "embedding").filter("embedding is not null").select("id", F.lit(1).alias("e"))
    return chunks(s, d).join(have, "id", "left").agg(F.count(F.lit(1)).alias("total"), F.count("e").alias("embedded"), (F.count(F.lit(1)) - F.count("e")).alias("pending"))


def missing_embeddings(s, d):
    return chunks(s, d, "file_id").join(table(s, d, "chunk_embeddings").select("id").distinct(), "id", "left_anti").select("id", "file_id")


def channel_pairs(s, d):
    """Emitters (clicks) and listeners (views) of one channel: pairs of different users, counted per channel without listing them."""
    e = table(s, d, "events").withColumn("channel", F.get_json_object("props", "$.k"))
    users = e.groupBy("channel", "user_id").agg(F.sum((F.col("event_type") == "click").cast("bigint")).alias("emits"), F.sum((F.col("event_type") == "view").cast("bigint")).alias("listens"))
    out = users.groupBy("channel").agg((F.sum("emits") * F.sum("listens") - F.sum(F.col("emits") * F.col("listens"))).alias("pairs"))
    return out.filter("pairs > 0")


def import_resolution(s, d):
    """Imports of each file that name a file of the same repository by its last two segments."""
    texts = table(s, d, "chunks").select("file_id", F.explode("import_context").alias("line")).select("file_id", F.regexp_extract("line", r"from \"\.\./([\w/.-]+)\.js\"", 1).alias("spec")).filter("spec <> ''").distinct()
    f = files(s, d, "path", "repo")
    asks = texts.join(f.select(F.col("id").alias("file_id"), "repo"), "file_id")
    asks = asks.select("file_id", "repo", "spec", F.explode(F.array(*[F.concat("spec", F.lit(e)) for e in (".ts", ".mts", ".cts", ".js", ".mjs", ".cjs", "/index.ts", "/index.js")])).alias("suffix"))
    targets = f.select(F.col("id").alias("target_id"), "repo", X.last_segments(F.col("path"), 2).alias("suffix"))
    hits = asks.join(targets, ["repo", "suffix"], "left").groupBy("file_id", "spec").agg(F.min("target_id").alias("target_id"))
    return hits.groupBy("file_id").agg(F.count(F.lit(1)).alias("imports"), F.count("target_id").alias("resolved"))


def diff_classify(s, d):
    """Symbols (name, kind) of one repository against those of another, as a re-index would see them."""
    f = files(s, d, "repo")
    rows = symbols(s, d, "file_id", "name", "kind", "body_hash").join(f.select(F.col("id").alias("file_id"), "repo"), "file_id")

    def side(repo: str, alias: str) -> DataFrame:
        return rows.filter(F.col("repo") == repo).groupBy("name", "kind").agg(F.min("body_hash").alias(alias))

    both = side("harbor-index", "old").join(side("quillbase", "new"), ["name", "kind"], "full")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    both = both.withColumn("state", state)
    renamed = both.filter("state = 'deleted'").select(F.col("old").alias("h")).distinct()
    both = both.join(renamed, (both.state == "added") & (both.new == renamed.h), "left").withColumn("state", F.when(F.col("h").isNotNull(), "renamed").otherwise(F.col("state")))
    return both.select("name", "kind", "state")


def degree(s, d):
    """Outgoing and incoming edges of every symbol, 0 where there are none."""
    e = edges(s, d)
    ends = e.select(F.col("source_symbol_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("target_symbol_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    ends = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return symbols(s, d).join(ends, "id", "left").select("id", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))


def dir_rollup(s, d):
    """Files and symbols below each directory, to a depth of three."""
    rows = files(s, d, "path", "symbol_count").withColumn("parts", F.split("path", "/"))
    rows = rows.select(F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.size("parts") - 1))).alias("depth"), "parts", "symbol_count")
    return rows.groupBy(F.concat_ws("/", F.expr("slice(parts, 1, depth)")).alias("dir")).agg(F.count(F.lit(1)).alias("files"), F.sum("symbol_count").alias("symbols"))


def top_files(s, d):
    return files(s, d, "path", "symbol_count").orderBy(F.desc("symbol_count"), "path").limit(20).select("path", "symbol_count")


def file_summary(s, d):
    own = symbols(s, d, "file_id", "name", "is_exported", "centrality")
    e = edges(s, d)
    ends = e.select("id", F.col("source_symbol_id").alias("symbol_id")).unionByName(e.select("id", F.col("target_symbol_id").alias("symbol_id")))
    touched = ends.join(own.select(F.col("id").alias("symbol_id"), "file_id"), "symbol_id").groupBy("file_id").agg(F.countDistinct("id").alias("edge_count"))
    names = F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("is_exported"), F.col("name")))))
    base = own.groupBy("file_id").agg(F.count(F.lit(1)).alias("symbol_count"), F.round(F.avg("centrality"), 9).alias("avg_centrality"), names.alias("exports"))
    return base.join(touched, "file_id", "left").select("file_id", "symbol_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "avg_centrality", "exports")


def session_recency(s, d):
    rows = table(s, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last_at"), "event_type"))
    return rows.withColumn("rank", rank).filter("rank <= 3").select("user_id", "event_type", "last_at", "n")


def session_stats(s, d):
    e = table(s, d, "events")
    hit = F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct(F.get_json_object("props", "$.k")).alias("distinct_items"), F.round(F.avg(hit), 6).alias("followup_rate"))


def language_histogram(s, d):
    return files(s, d, "language").groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").limit(8)


def quantiles(s, d):
    """Lower quantiles, ceiling p95, median and upper median of function lengths by file language."""
    rows = symbols(s, d, "file_id", "kind", "start_line", "end_line").filter(F.col("kind").isin(CALLABLE)).join(files(s, d, "language").withColumnRenamed("id", "file_id"), "file_id").select("language", (F.col("end_line") - F.col("start_line") + 1).alias("n"))
    # ranks of value counts instead of whole lists: a language may hold a third of all rows
    counts = rows.groupBy("language", "n").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("language").orderBy("n")
    total = F.sum("c").over(Window.partitionBy("language"))
    counts = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("total", total).withColumn("first", F.col("upto") - F.col("c"))

    def at(place) -> F.Column:
        return F.max(F.when((F.col("first") <= place) & (place < F.col("upto")), F.col("n"))).cast("bigint")

    n = F.col("total")
    low, high = at(F.floor((n - 1) / 2)), at(F.floor(n / 2))
    return counts.groupBy("language").agg(at(F.floor((n - 1) * 0.9)).alias("q90"), at(F.ceil(n * 0.95) - 1).alias("p95"), ((low + high) / 2).alias("median"), high.alias("upper_median"))


def pattern_groups(s, d):
    """Files with the same set of symbol kinds and visibilities, in groups of three or more, with stepwise confidence."""
    shape = symbols(s, d, "file_id", "kind", "visibility").groupBy("file_id").agg(F.concat_ws("|", F.array_sort(F.collect_set(F.concat_ws(":", "kind", "visibility")))).alias("shape"))
    groups = shape.groupBy(F.sha2("shape", 256).alias("pattern_id")).agg(F.min("shape").alias("shape"), F.count(F.lit(1)).alias("files"))
    level = F.when(F.col("files") >= 10, 0.9).when(F.col("files") >= 5, 0.75).otherwise(0.6)
    return groups.filter("files >= 3").withColumn("confidence", level)


#: Conventions by file name, then by directory.
BY_NAME = [("controller", "controllers"), ("service", "services"), ("repository", "repositories"), ("model", "models"), ("entity", "entities"), ("schema", "schemas"), ("hook", "hooks"), ("store", "stores"), ("middleware", "middleware"), ("guard", "guards"), ("util", "utilities"), ("helper", "helpers"), ("config", "config"), ("test|spec", "tests")]
BY_DIR = [("controllers?|handlers?", "controllers"), ("services?", "services"), ("repositories|repos?|dao", "repositories"), ("models?|entities", "models"), ("hooks?", "hooks"), ("store|state|redux|zustand", "stores"), ("middleware", "middleware"), ("components?|widgets?", "components"), ("pages?|views?|screens?", "pages"), ("routes?|routing", "routes"), ("api|endpoints?", "api"), ("schemas?|migrations?", "schemas"), ("utils?|lib|helpers?|shared", "utilities"), ("config|settings?", "config")]


def convention(path) -> F.Column:
    low, first = F.lower(F.concat(F.lit("/"), path)), None
    for part, name in BY_NAME:
        test = low.rlike(rf"\.({part})\.")
        first = F.when(test, name) if first is None else first.when(test, name)
    for part, name in BY_DIR:
        first = first.when(low.rlike(f"/({part})/"), name)
    return first


def convention_groups(s, d):
    rows = files(s, d, "path").withColumn("convention", convention(F.col("path"))).filter("convention is not null")
    return rows.groupBy("convention").agg(F.count(F.lit(1)).alias("file_count")).filter("file_count >= 2")


def convention_edges(s, d):
    """Edges between files of different conventions, one row for each ordered pair of names."""
    kinds = files(s, d, "path").select(F.col("id").alias("file_id"), convention(F.col("path")).alias("c")).filter("c is not null")
    owner = symbols(s, d, "file_id").join(kinds, "file_id").select("id", "c")
    rows = edges(s, d).join(owner.select(F.col("id").alias("source_symbol_id"), F.col("c").alias("a")), "source_symbol_id").join(owner.select(F.col("id").alias("target_symbol_id"), F.col("c").alias("b")), "target_symbol_id")
    return rows.filter("a < b").groupBy(F.col("a").alias("source_convention"), F.col("b").alias("target_convention")).agg(F.count(F.lit(1)).alias("edge_count"))


def barrel_files(s, d):
    """Files at least half of whose symbols are re-exported."""
    owner = symbols(s, d, "file_id")
    out = edges(s, d).filter("kind = 'reexport'").join(owner.select(F.col("id").alias("source_symbol_id"), "file_id"), "source_symbol_id").groupBy("file_id").agg(F.count(F.lit(1)).alias("reexports"))
    return out.join(files(s, d, "symbol_count").withColumnRenamed("id", "file_id"), "file_id").filter("symbol_count > 0 and reexports >= 0.5 * symbol_count").select("file_id", "reexports", "symbol_count")


def running_budget(s, d, budget: int = 2000):
    """Of each file's chunks in order, those before the running token estimate first goes beyond the budget."""
    rows = chunks(s, d, "file_id", "chunk_index", "text").select("id", "file_id", "chunk_index", X.estimate_tokens(F.col("text")).alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("file_id").orderBy("chunk_index", "id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", upto).filter(F.col("used") <= budget).select("id", "file_id", "used")


def grep_lines(s, d):
    """Lines with a literal, in any case, with the line before and after, of all chunks."""
    rows = chunks(s, d, "file_id", "text").select("id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    w = Window.partitionBy("id").orderBy("pos")
    rows = rows.withColumn("before", F.lag("line").over(w)).withColumn("after", F.lead("line").over(w))
    return rows.filter(F.contains(F.lower("line"), F.lit("retry.drain"))).select("id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "before", "line", "after")


def round_robin(s, d, most: int = 10):
    """Ten files of each language, two of each repository a round."""
    rows = files(s, d, "language", "repo", "path")
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("language", "repo").orderBy("path"))).withColumn("round", F.floor((F.col("rn") - 1) / 2))
    rank = F.row_number().over(Window.partitionBy("language").orderBy("round", "repo", "rn"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).select("language", F.col("rank").cast("bigint").alias("rank"), "path")


def latest_per_key(s, d):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(s, d, "events").withColumn("rank", rank).filter("rank = 1").select("user_id", "event_id", "event_type")


def union_first_wins(s, d):
    """Names from callables, else from types, else from the rest: the first source that has one wins."""
    rows = symbols(s, d, "name", "kind").withColumn("source", F.when(F.col("kind").isin(CALLABLE), 1).when(F.col("kind").isin("class", "type"), 2).otherwise(3))
    return rows.groupBy("name").agg(F.min(F.struct("source", "id")).alias("m")).select("name", F.col("m.source").alias("source"), F.col("m.id").alias("id"))


def prune_and_add(s, d):
    """Files with chunks but no symbols, and with symbols but no chunks."""
    a, b = table(s, d, "chunks").select("file_id").distinct(), table(s, d, "symbols").select("file_id").distinct()
    return a.join(b, "file_id", "left_anti").withColumn("side", F.lit("chunks only")).unionByName(b.join(a, "file_id", "left_anti").withColumn("side", F.lit("symbols only")))


def stale_files(s, d):
    return files(s, d, "repo", "mtime", "last_indexed").groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum((F.col("mtime") > F.col("last_indexed")).cast("bigint")).alias("stale"))


def duplicate_content(s, d):
    """The path that is kept for each content: the shortest, then the first."""
    rank = F.row_number().over(Window.partitionBy("hash").orderBy(F.length("path"), "path"))
    return files(s, d, "path", "hash").withColumn("rank", rank).groupBy("hash").agg(F.max(F.when(F.col("rank") == 1, F.col("path"))).alias("kept"), F.count(F.lit(1)).alias("copies"))


def large_functions(s, d):
    lines = F.col("end_line") - F.col("start_line") + 1
    rows = symbols(s, d, "file_id", "name", "kind", "start_line", "end_line").filter(F.col("kind").isin(CALLABLE) & (lines > 100)).join(files(s, d, "path").withColumnRenamed("id", "file_id"), "file_id")
    return rows.select("path", "name", "start_line", lines.cast("bigint").alias("lines"))


def quality_score(s, d):
    total = symbols(s, d).agg(F.count(F.lit(1)).alias("total"))
    dead = dead_symbols(s, d).agg(F.count(F.lit(1)).alias("dead"))
    large = large_functions(s, d).agg(F.count(F.lit(1)).alias("large"))
    loops = edges(s, d).filter("source_symbol_id = target_symbol_id").agg(F.countDistinct("source_symbol_id").alias("loops"))
    row = total.crossJoin(dead).crossJoin(large).crossJoin(loops)  # four rows of one value each
    score = 100 - F.col("dead") / F.col("total") * 45 - F.col("large") / F.col("total") * 35 - F.col("loops") / F.col("total") * 20
    return row.select("total", "dead", "large", "loops", X.round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).alias("score"))


S = "(select distinct * from symbols)"
E = "(select distinct * from edges)"
C = "(select distinct id, file_id, chunk_index, start_line, end_line, text from chunks)"
SEG2 = "array_to_string(list_slice(string_split(path, '/'), greatest(1, len(string_split(path, '/')) - 1), len(string_split(path, '/'))), '/')"


def _case(pairs, test):
    return " ".join(f"when {test.format(p)} then '{n}'" for p, n in pairs)


CONVENTION = "case " + _case(BY_NAME, r"regexp_matches(lower('/' || path), '\.({})\.')") + " " + _case(BY_DIR, "regexp_matches(lower('/' || path), '/({})/')") + " end"
QUERIES = {f.__name__: f for f in (like_escape, nocase_lookup, path_suffix, glob_filter, join_symbol_file, file_pair_edges, top_neighbours, dead_symbols, enclosing_symbol, chunk_symbols, chunk_overlap, embedding_coverage, missing_embeddings, channel_pairs, import_resolution, diff_classify, degree, dir_rollup, top_files, file_summary, session_recency, session_stats, language_histogram, quantiles, pattern_groups, convention_groups, convention_edges, barrel_files, running_budget, grep_lines, round_robin, latest_per_key, union_first_wins, prune_and_add, stale_files, duplicate_content, large_functions, quality_score)}
DEAD = f"select s.id, s.name, s.kind from {S} s where not is_exported and kind in ('function','method','arrow') and not exists (select 1 from edges e where e.target_symbol_id = s.id)"
LARGE = f"select path, name, start_line, cast(end_line - start_line + 1 as bigint) as lines from {S} s join files f on f.id = s.file_id where kind in ('function','method','arrow') and end_line - start_line + 1 > 100"
SQL = {
    "like_escape": r"select id, path from files where lower(path) like '%node\_modules%' escape '\' or lower(path) like '%\_generated.%' escape '\'",
    "nocase_lookup": f"select kind, count(*) n from {S} where lower(name) = 'handle' group by kind",
    "path_suffix": f"select suffix, path from (select *, row_number() over (partition by suffix order by length(path), path) r from (select path, {SEG2} suffix from files)) where r = 1",
    "glob_filter": r"select id, path, language from files where regexp_matches(path, '^(?:.*/)?(?:src|lib)/(?:.*/)?[^/]*\.(?:ts|py)$')",
    "join_symbol_file": f"select language, kind, count(*) n, cast(sum(end_line - start_line + 1) as bigint) as lines from {S} s join files f on f.id = s.file_id group by all",
    "file_pair_edges": f"select least(a.file_id, b.file_id) file_a, greatest(a.file_id, b.file_id) file_b, e.kind, count(*) n from {E} e join {S} a on a.id = e.source_symbol_id join {S} b on b.id = e.target_symbol_id where a.file_id <> b.file_id group by all",
    "top_neighbours": f"with r as (select * from {E} where kind in ('call','import','inheritance','implements')), b as (select source_symbol_id node, target_symbol_id neighbour, strength, id from r union all select target_symbol_id, source_symbol_id, strength, id from r) select node, neighbour, strength, rank from (select *, row_number() over (partition by node order by strength desc, id, neighbour) rank from b where node <> neighbour) where rank <= 6",
    "dead_symbols": DEAD,
    "enclosing_symbol": f"select chunk_id, symbol_id from (select c.id chunk_id, s.id symbol_id, row_number() over (partition by c.id order by s.end_line - s.start_line, s.start_line, s.id) r from {C} c join {S} s on s.file_id = c.file_id and c.start_line between s.start_line and s.end_line) where r = 1",
    "chunk_symbols": f"select chunk_id, symbol_id, rank from (select c.id chunk_id, s.id symbol_id, row_number() over (partition by c.id order by s.centrality desc, s.id) rank from {C} c join {S} s on s.file_id = c.file_id and s.start_line >= c.start_line and s.end_line <= c.end_line) where rank <= 8",
    "chunk_overlap": f"select c.id chunk_id, count(*) n, round(max(s.centrality), 9) centrality from {C} c join {S} s on s.file_id = c.file_id and s.start_line <= c.end_line and s.end_line >= c.start_line group by c.id",
    "embedding_coverage": "with e as (select distinct id from chunk_embeddings where embedding is not null), c as (select distinct id from chunks) select count(*) total, count(e.id) embedded, count(*) - count(e.id) pending from c left join e on e.id = c.id",
    "missing_embeddings": "select distinct id, file_id from chunks where id not in (select id from chunk_embeddings)",
    "channel_pairs": "with e as (select *, json_extract_string(props, '$.k') channel from events) select a.channel, count(*) pairs from e a join e b on a.channel = b.channel and a.user_id <> b.user_id where a.event_type = 'click' and b.event_type = 'view' group by a.channel",
    "import_resolution": f"""with t as (select distinct file_id, spec from (select file_id, regexp_extract(line, 'from "\\.\\./([\\w/.-]+)\\.js"', 1) spec from (select file_id, unnest(import_context) line from chunks)) where spec <> ''),
a as (select t.file_id, repo, spec, spec || e suffix from t join files f on f.id = t.file_id, (select unnest(['.ts', '.mts', '.cts', '.js', '.mjs', '.cjs', '/index.ts', '/index.js']) e)),
h as (select a.file_id, a.spec, min(g.id) target_id from a left join (select id, repo, {SEG2} suffix from files) g on g.repo = a.repo and g.suffix = a.suffix group by all) select file_id, count(*) imports, count(target_id) resolved from h group by file_id""",
    "diff_classify": f"""with r as (select s.name, s.kind, s.body_hash, f.repo from {S} s join files f on f.id = s.file_id), o as (select name, kind, min(body_hash) old from r where repo = 'harbor-index' group by all), n as (select name, kind, min(body_hash) new from r where repo = 'quillbase' group by all),
b as (select coalesce(o.name, n.name) name, coalesce(o.kind, n.kind) kind, old, new from o full join n on o.name = n.name and o.kind = n.kind),
c as (select *, case when old is null then 'added' when new is null then 'deleted' when old = new then 'unchanged' else 'modified' end state from b)
select name, kind, case when state = 'added' and new in (select old from c where state = 'deleted') then 'renamed' else state end state from c""",
    "degree": f"with n as (select distinct id from symbols) select n.id, coalesce(o, 0) out_degree, coalesce(i, 0) in_degree from n left join (select source_symbol_id, count(*) o from {E} group by 1) a on a.source_symbol_id = n.id left join (select target_symbol_id, count(*) i from {E} group by 1) b on b.target_symbol_id = n.id",
    "dir_rollup": "with p as (select string_split(path, '/') parts, symbol_count from files), x as (select parts, symbol_count, unnest(range(1, cast(least(3, len(parts) - 1) as bigint) + 1)) depth from p) select array_to_string(parts[1:depth], '/') dir, count(*) files, cast(sum(symbol_count) as bigint) symbols from x group by 1",
    "top_files": "select path, symbol_count from files order by symbol_count desc, path limit 20",
    "file_summary": f"""with s as (select * from {S}), t as (select file_id, count(distinct id) edge_count from (select e.id, s.file_id from {E} e join s on s.id = e.source_symbol_id union all select e.id, s.file_id from {E} e join s on s.id = e.target_symbol_id) group by 1)
select s.file_id, count(*) symbol_count, coalesce(any_value(t.edge_count), 0) edge_count, round(avg(centrality), 9) avg_centrality, coalesce(array_to_string(list_sort(list(distinct name) filter (where is_exported)), ','), '') exports from s left join t on t.file_id = s.file_id group by s.file_id""",
    "session_recency": "select user_id, event_type, last_at, n from (select *, row_number() over (partition by user_id order by last_at desc, event_type) r from (select user_id, event_type, max(ts) last_at, count(*) n from events group by all)) where r <= 3",
    "session_stats": "select user_id, count(*) events, round(sum(value), 4) total, count(distinct json_extract_string(props, '$.k')) distinct_items, round(avg(case when event_type = 'purchase' then 1.0 else 0.0 end), 6) followup_rate from events group by user_id",
    "language_histogram": "select language, count(*) n from files group by 1 order by n desc, language limit 8",
    "quantiles": f"""with x as (select language, list_sort(list(end_line - start_line + 1)) v from {S} s join files f on f.id = s.file_id where s.kind in ('function','method','arrow') group by 1)
select language, cast(v[cast(floor((len(v) - 1) * 0.9) as bigint) + 1] as bigint) q90, cast(v[cast(ceil(len(v) * 0.95) as bigint)] as bigint) p95, (v[cast(floor((len(v) - 1) / 2) as bigint) + 1] + v[cast(floor(len(v) / 2) as bigint) + 1]) / 2 median, cast(v[cast(floor(len(v) / 2) as bigint) + 1] as bigint) upper_median from x""",
    "pattern_groups": f"with p as (select file_id, array_to_string(list_sort(list(distinct kind || ':' || visibility)), '|') shape from {S} group by 1) select sha256(shape) pattern_id, min(shape) shape, count(*) files, case when count(*) >= 10 then 0.9 when count(*) >= 5 then 0.75 else 0.6 end::double confidence from p group by shape having count(*) >= 3",
    "convention_groups": f"select convention, count(*) file_count from (select {CONVENTION} convention from files) where convention is not null group by 1 having count(*) >= 2",
    "convention_edges": f"with k as (select id file_id, {CONVENTION} c from files), o as (select s.id, k.c from {S} s join k on k.file_id = s.file_id where c is not null) select a.c source_convention, b.c target_convention, count(*) edge_count from {E} e join o a on a.id = e.source_symbol_id join o b on b.id = e.target_symbol_id where a.c < b.c group by all",
    "barrel_files": f"select s.file_id, count(*) reexports, any_value(f.symbol_count) symbol_count from {E} e join {S} s on s.id = e.source_symbol_id join files f on f.id = s.file_id where e.kind = 'reexport' group by 1 having any_value(f.symbol_count) > 0 and count(*) >= 0.5 * any_value(f.symbol_count)",
    "running_budget": f"select id, file_id, used from (select id, file_id, cast(sum(cast(ceil(length(text) / 3.5) as bigint)) over (partition by file_id order by chunk_index, id rows unbounded preceding) as bigint) used from {C}) where used <= 2000",
    "grep_lines": f"with l as (select id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) as line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) line_no from {C}), w as (select id, line_no, lag(line) over (partition by id order by line_no) as before, line, lead(line) over (partition by id order by line_no) as after from l) select id, line_no, before, line, after from w where contains(lower(line), 'retry.drain')",
    "round_robin": "with a as (select language, repo, path, row_number() over (partition by language, repo order by path) rn from files), b as (select *, row_number() over (partition by language order by (rn - 1) // 2, repo, rn) rank from a) select language, rank, path from b where rank <= 10",
    "latest_per_key": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1",
    "union_first_wins": f"select name, source, id from (select name, id, case when kind in ('function','method','arrow') then 1 when kind in ('class','type') then 2 else 3 end source, row_number() over (partition by name order by case when kind in ('function','method','arrow') then 1 when kind in ('class','type') then 2 else 3 end, id) r from {S}) where r = 1",
    "prune_and_add": "select distinct file_id, 'chunks only' side from chunks where file_id not in (select file_id from symbols) union all select distinct file_id, 'symbols only' from symbols where file_id not in (select file_id from chunks)",
    "stale_files": "select repo, count(*) files, count(*) filter (where mtime > last_indexed) stale from files group by 1",
    "duplicate_content": "select hash, arg_min(path, length(path) * 1000000) kept, count(*) copies from (select * from files order by path) group by hash".replace("arg_min(path, length(path) * 1000000)", "first(path order by length(path), path)"),
    "large_functions": LARGE,
    "quality_score": f"with a as (select (select count(distinct id) from symbols) total, (select count(*) from ({DEAD})) dead, (select count(*) from ({LARGE})) large, (select count(distinct source_symbol_id) from edges where source_symbol_id = target_symbol_id) loops) select *, cast(floor(greatest(0, least(100, 100 - dead / total * 45 - large / total * 35 - loops / total * 20)) + 0.5) as bigint) score from a",
}
