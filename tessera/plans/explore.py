"""Searching lines, resolving names, impact, overview, status and history, vectors with filters, and the rest of the notes' lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators import vectors as V
from tessera.plans.graphs import FLOW_WEIGHT, file_links, links
from tessera.plans.memory import notes
from tessera.plans.relational import C, CALLABLE, E, S, chunks, dead_symbols, edges, files, large_functions, symbols
from tessera.session import cut
from tessera.sources.tables import once, table

BIN = 64  # lines of a bin of the range join


def within_lines(probes: DataFrame, around: DataFrame, line: str = "line") -> DataFrame:
    """Probes (file_id, line, ...) with the rows of ``around`` (file_id, start_line, end_line, ...) whose lines hold them.

    Lines are cut into bins, so that a probe meets what touches its bin and not the whole file.
    """
    bins = F.sequence(F.floor(F.col("start_line") / BIN), F.greatest(F.floor(F.col("end_line") / BIN), F.floor(F.col("start_line") / BIN)))
    held = around.filter("end_line >= start_line").withColumn("__bin", F.explode(bins))
    return probes.withColumn("__bin", F.floor(F.col(line) / BIN)).join(held, ["file_id", "__bin"]).filter(F.col(line).between(F.col("start_line"), F.col("end_line"))).drop("__bin")


def grep(c: DataFrame, f: DataFrame, y: DataFrame, pattern: str, context: int = 2, glob: str | None = None, scope: str = "", most: int = 50, case: bool = False, literal: bool = False) -> DataFrame:
    """(path, line_no, line, context, symbol_id, is_definition, rank): lines that match, with those around, the smallest symbol around, definitions first.

    ``c``: chunks (id, file_id, chunk_index, text), ``f``: files (id, path), ``y``: symbols (id, file_id, start_line, end_line). Lines count through a
    file's chunks; context reaches into the chunks before and behind. Null texts have no lines.
    """
    keep = P.within(F.col("path"), F.lit(scope))
    keep = keep & F.col("path").rlike(X.glob_pattern(glob)) if glob else keep
    c = c.filter("text is not null").join(f.filter(keep).select(F.col("id").alias("file_id"), "path"), "file_id").withColumn("lines", F.split("text", r"\r?\n")).withColumn("n", F.size("lines"))
    order = Window.partitionBy("file_id").orderBy("chunk_index", "id")
    none = F.array().cast("array<string>")
    tail = F.slice("lines", F.greatest(F.col("n") - context + 1, F.lit(1)), F.lit(context)) if context else none
    c = c.withColumn("base", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("before", F.coalesce(F.lag(tail).over(order), none)).withColumn("after", F.coalesce(F.lead(F.slice("lines", 1, context) if context else none).over(order), none))
    test = (lambda x: F.contains(x if case else F.lower(x), F.lit(pattern if case else pattern.lower()))) if literal else (lambda x: x.rlike(pattern if case else "(?i)" + pattern))
    c = c.filter(test(F.col("text")) if literal else F.lit(True))
    c = c.withColumn("all", F.concat("before", "lines", "after")).withColumn("shift", F.size("before"))
    hits = c.select("path", "file_id", "base", "all", "shift", F.posexplode("lines").alias("pos", "line")).filter(test(F.col("line")))
    first = F.greatest(F.lit(0), F.col("pos") + F.col("shift") - context)
    around = F.slice("all", first + 1, F.col("pos") + F.col("shift") - first + context + 1)
    hits = hits.select("path", "file_id", (F.col("base") + F.col("pos") + 1).alias("line_no"), "line", F.array_join(around, "\n").alias("context"))
    best = within_lines(hits.select("file_id", "line_no").distinct(), y.select("id", "file_id", "start_line", "end_line"), "line_no").groupBy("file_id", "line_no").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "start_line", "id")).alias("m"))
    hits = hits.join(best, ["file_id", "line_no"], "left").select("path", "line_no", "line", "context", F.col("m.id").alias("symbol_id"), F.coalesce(F.col("m.start_line") == F.col("line_no"), F.lit(False)).alias("is_definition"))
    top = hits.orderBy(F.desc("is_definition"), "path", "line_no").limit(most)  # a report of the first ``most``
    rank = F.row_number().over(Window.orderBy(F.desc("is_definition"), "path", "line_no"))
    return top.withColumn("rank", rank.cast("bigint"))


def grep_symbols(s, d):
    return grep(chunks(s, d, "file_id", "chunk_index", "text"), files(s, d, "path"), symbols(s, d, "file_id", "start_line", "end_line"), r"\bjournal\w*\.\w+\(", glob="**/*.{ts,py,js}")


def chunk_of_line(s, d):
    """The smallest chunk around the first line of each symbol, and how many symbols begin in it."""
    probes = symbols(s, d, "file_id", "start_line").select(F.col("id").alias("symbol_id"), "file_id", F.col("start_line").alias("line"))
    hit = within_lines(probes, chunks(s, d, "file_id", "start_line", "end_line"))
    best = hit.groupBy("symbol_id").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "id")).alias("m")).select("symbol_id", F.col("m.id").alias("chunk_id"))
    return best.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("symbols"), F.min("symbol_id").alias("first"))


TARGETS = [(1, "handle", "", ""), (2, "Journal.rotate", "rotate", "Journal"), (3, "drainRetr", "", ""), (4, "rotateSnapshot", "", ""), (5, "nothing at all", "", "")]


def symbol_resolution(s, d):
    """The symbols that a name stands for: of that name, else of that qualified name, else of the names that resemble it most; the most central ten."""
    t = s.createDataFrame([(a, b) for a, b, *_ in TARGETS], "n int, target string")
    rows = symbols(s, d, "name", "qualified_name", "centrality")
    exact = rows.join(F.broadcast(t), rows.name == t.target).select("n", "id", "centrality", F.lit(1).alias("level"))
    by_owner = rows.join(F.broadcast(t), rows.qualified_name == t.target).select("n", "id", "centrality", F.lit(2).alias("level"))
    names = rows.select("name").distinct()
    near = names.join(F.broadcast(t), F.lit(True)).withColumn("like", F.round(X.fuzzy(F.col("target"), F.col("name")), 6)).filter("like >= 0.6")  # a stated set of targets against all names
    near = near.groupBy("n").agg(F.max(F.struct("like", F.col("name"))).alias("m")).select("n", F.col("m.name").alias("name"))
    fuzzy = rows.join(F.broadcast(near), "name").select("n", "id", "centrality", F.lit(3).alias("level"))
    union = exact.unionByName(by_owner).unionByName(fuzzy)
    best = union.groupBy("n").agg(F.min("level").alias("level"))
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("centrality"), "id"))
    return union.join(best, ["n", "level"]).withColumn("rank", rank.cast("bigint")).filter("rank <= 10").select("n", "level", "rank", "id")


def impact_rules(s, d):
    """What depends on the most central symbols, three deep: imports only from the root itself, and from the second step on nothing of the root's own file."""
    owner = symbols(s, d, "file_id", "centrality")
    roots = owner.orderBy(F.desc("centrality"), "id").limit(8).select(F.col("id").alias("root"), F.col("file_id").alias("root_file"))
    e = links(s, d).join(owner.select(F.col("id").alias("src"), F.col("file_id").alias("src_file")), "src")
    front = cut(roots.select("root", "root_file", F.col("root").alias("id"), F.lit(0).alias("depth")))
    seen = front
    for step in (1, 2, 3):
        usable = e if step == 1 else e.filter(~F.col("kind").isin("import", "reexport"))
        found = usable.join(front.select("root", "root_file", F.col("id").alias("dst")), "dst")
        found = found if step < 3 else found.filter("src_file <> root_file")
        found = found.select("root", "root_file", F.col("src").alias("id")).distinct()
        front = cut(found.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.unionByName(front)
    return seen.filter("depth > 0").select("root", "id", F.col("depth").cast("bigint").alias("depth"))


def converged_ranks(s, d):
    """Ranks with the operator's own defaults: up to fifty rounds, until the change is below a millionth."""
    return G.pagerank(symbols(s, d), links(s, d)).select("id", F.round("rank", 6).alias("rank"))


def split_clusters(s, d, most: int = 30):
    """File clusters; those of more than thirty files are split by their first two directories, and all are numbered by their smallest file."""
    c = G.components(files(s, d), file_links(s, d)).join(files(s, d, "path"), "id").withColumn("dir", F.array_join(F.slice(F.split("path", "/"), 1, 2), "/"))
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    c = c.join(sizes, "component").withColumn("part", F.when(F.col("n") > most, F.col("dir")).otherwise(F.lit("")))
    heads = c.groupBy("component", "part").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("files"))
    return c.join(heads, ["component", "part"]).select(F.col("id").alias("file_id"), "head", "files")


def quality_report(s, d):
    """The quality score with clusters of circular dependencies, self-loops among them."""
    total, dead, large = (df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((symbols(s, d), "total"), (dead_symbols(s, d), "dead"), (large_functions(s, d), "large")))
    cycles = G.strong_components(links(s, d)).agg(F.countDistinct("component").alias("cycles"))
    row = total.crossJoin(dead).crossJoin(large).crossJoin(cycles)  # one row each
    t = F.greatest(F.col("total"), F.lit(1))
    score = 100 - F.col("dead") / t * 45 - F.col("large") / t * 35 - F.col("cycles") / t * 20
    return row.select("total", "dead", "large", "cycles", X.round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).alias("score"))


def reexport_closure(s, d):
    """All that each symbol stands for through re-exports, with the fewest steps; what leads back to itself is marked."""
    e = cut(links(s, d).filter("kind = 'reexport'").select("src", "dst").distinct())
    front, seen, step = e.withColumn("steps", F.lit(1)), None, 1
    while True:
        front = cut(front)
        if not front.limit(1).count():
            break
        seen = front if seen is None else cut(seen.unionByName(front))
        step += 1
        nxt = front.select("src", F.col("dst").alias("at")).join(e.select(F.col("src").alias("at"), "dst"), "at").select("src", "dst").distinct()
        front = nxt.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("steps", F.lit(step))
    if seen is None:
        return e.select(F.col("src").alias("symbol_id"), F.col("dst").alias("target_id"), F.lit(1).cast("bigint").alias("steps"), F.lit(False).alias("circular"))
    return seen.select(F.col("src").alias("symbol_id"), F.col("dst").alias("target_id"), F.col("steps").cast("bigint").alias("steps"), (F.col("src") == F.col("dst")).alias("circular"))


def edge_strengths(s, d):
    """Strength and flow weight of each kind of edge, and how often the stored strength differs."""
    strength = F.when(F.col("kind") == "import", 0.8).when(F.col("kind") == "reference", 0.6).when(F.col("kind") == "type_usage", 0.4).otherwise(1.0)
    flow = None
    for kind, w in FLOW_WEIGHT.items():
        flow = F.when(F.col("kind") == kind, w) if flow is None else flow.when(F.col("kind") == kind, w)
    return edges(s, d).groupBy("kind", strength.alias("strength_of"), flow.otherwise(0.5).alias("flow")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("strength") != strength).cast("bigint")).alias("other"))


def depth_of_budget(s, d):
    b = F.col("id") * 900
    return files(s, d).select("id", F.when(b < 2000, 3).when(b < 5000, 4).when(b < 10000, 5).otherwise(6).cast("bigint").alias("depth"))


def incoming_flows(s, d):
    """Ways that lead to the symbols with most incoming edges, without tests."""
    tests = symbols(s, d, "file_id").join(files(s, d, "path").filter(P.is_path(F.col("path"), "test")).select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")
    rows = links(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", F.lit(1.0).alias("weight"))
    rows = rows.join(tests.withColumnRenamed("id", "src"), "src", "left_anti").join(tests.withColumnRenamed("id", "dst"), "dst", "left_anti")
    roots = rows.groupBy(F.col("src").alias("id")).count().orderBy(F.desc("count"), "id").limit(5).select("id")
    return G.flows(rows, roots).select("root", "rank", F.array_join(F.transform("path", lambda x: x.cast("string")), "<").alias("path"))


def overview(s, d):
    """A repository at a glance: files, symbols, edges between files, entry points, languages, its largest file."""
    f = files(s, d, "path", "repo", "language", "symbol_count")
    own = symbols(s, d, "file_id", "kind").join(f.select(F.col("id").alias("file_id"), "repo"), "file_id").groupBy("repo").agg(F.count(F.lit(1)).alias("symbols"), F.sum(F.col("kind").isin(CALLABLE).cast("bigint")).alias("callables"))
    head = f.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("language").alias("languages"), F.sum((P.is_path(F.col("path"), "entry") | F.col("path").rlike(r"(^|/)(main|index|app|server)\.\w+$")).cast("bigint")).alias("entries"), F.max(F.struct("symbol_count", (-F.col("id")).alias("n"), "path")).alias("m"))
    return head.join(own, "repo", "left").select("repo", "files", "languages", "entries", F.col("m.path").alias("largest"), F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("callables", F.lit(0)).alias("callables"))


def index_status(s, d):
    """Counts of each table and the share of what is derived."""
    out = None
    for name in ("files", "symbols", "edges", "chunks", "chunk_embeddings", "documents", "events"):
        key = {"documents": "doc_id", "events": "event_id"}.get(name, "id")
        row = table(s, d, name).agg(F.countDistinct(key).alias("rows"), F.max(key).alias("last")).select(F.lit(name).alias("part"), "rows", "last")
        out = row if out is None else out.unionByName(row)
    return out


def commit_search_ranked(s, d):
    """Commits for a query about the past: words of its subject and message, whole phrases more, the newest two hundred; other queries get none."""
    rows = table(s, d, "documents").filter("kind = 'commit_message' and text is not null").orderBy(F.desc("created_at"), F.desc("doc_id")).limit(200)  # what the feature looks at
    subject, low = F.lower(F.substring_index("text", "\n", 1)), F.lower("text")
    asked = [(1, "why changed the retry journal", ["retry", "journal", "changed", "why"]), (2, "cache", ["cache"]), (3, "when was the snapshot introduced", ["when", "snapshot", "introduced"])]
    past = {"why", "when", "history", "changed", "broke", "deprecated", "introduced", "who"}
    parts = None
    for n, text, words in asked:
        if not past & set(words):
            continue
        score = F.when(F.contains(subject, F.lit(text)), 8.0).otherwise(0.0) + F.when(F.contains(low, F.lit(text)), 6.0).otherwise(0.0)
        for w in words:
            score = score + (F.when(F.contains(low, F.lit(w)), 0.5).otherwise(0.0) if w in past else F.when(F.contains(subject, F.lit(w)), 5.0).otherwise(0.0) + F.when(F.contains(low, F.lit(w)), 4.0).otherwise(0.0))
        part = rows.select(F.lit(n).alias("query_id"), "doc_id", "created_at", score.alias("score"))
        parts = part if parts is None else parts.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("created_at"), "doc_id"))
    return parts.filter("score > 0").withColumn("rank", rank.cast("bigint")).filter("rank <= 3").select("query_id", "doc_id", "score", "rank")


def file_history(s, d):
    """Commits that name a file in their text: how many, and the newest, by file name."""
    names = files(s, d, "path").select(F.regexp_replace(X.basename(F.col("path")), r"\.[^.]+$", "").alias("name")).distinct()
    words = table(s, d, "documents").filter("kind = 'commit_message' and text is not null").select("doc_id", F.explode(F.array_distinct(F.split("text", r"[^A-Za-z0-9_-]+"))).alias("name"))
    return words.join(names, "name").groupBy("name").agg(F.count(F.lit(1)).alias("commits"), F.max("doc_id").alias("newest"))


def note_selection(s, d):
    """Of each scope the notes that fit 200 tokens of 1.3 a word, in order of confidence, those too long being skipped; one fold over at most a hundred notes."""
    rows = notes(s, d).filter("length(text) > 0").select("scope", "doc_id", "confidence", F.greatest(F.lit(1), F.ceil(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) * 1.3)).cast("int").alias("n"))
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("confidence"), "doc_id"))
    rows = rows.withColumn("rank", rank).filter("rank <= 100").groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "n"))).alias("all"))
    start = F.struct(F.lit(200).alias("left"), F.array().cast("array<bigint>").alias("ids"))

    def step(t: Column, x: Column) -> Column:
        fits = x["n"] <= t["left"]
        return F.struct((t["left"] - F.when(fits, x["n"]).otherwise(0)).alias("left"), F.when(fits, F.concat(t["ids"], F.array(x["doc_id"]))).otherwise(t["ids"]).alias("ids"))

    return rows.select("scope", F.aggregate("all", start, step)["ids"].alias("ids")).select("scope", F.explode("ids").alias("doc_id"))


def discovered_symbols(s, d):
    """Symbols that an answer's files hold and the answer does not: the twenty most central."""
    rows = symbols(s, d, "file_id", "name", "centrality")
    told = rows.orderBy(F.desc("centrality"), "id").limit(30)
    return rows.join(F.broadcast(told.select("file_id").distinct()), "file_id", "left_semi").join(F.broadcast(told.select("id")), "id", "left_anti").orderBy(F.desc("centrality"), "id").limit(20).select("id", "name")


def embeddings_of(s, d) -> DataFrame:
    e = once(table(s, d, "chunk_embeddings"), "file_id", "embedding", "model_name").filter("embedding is not null")
    return e.select("id", "file_id", F.concat_ws(":", F.lower(F.regexp_replace("model_name", r"^\s+|\s+$", "")), F.size("embedding").cast("string")).alias("space"), F.col("embedding").alias("vector"))


def vector_topk_in_path(s, d):
    """The five nearest chunks in source directories for each chunk whose id is divisible by 20: paths are filtered before distances."""
    inside = files(s, d, "path").filter("path like '%/src/%'").select(F.col("id").alias("file_id"))
    e = embeddings_of(s, d)
    return V.exact_top_k(e.join(inside, "file_id", "left_semi"), e.filter("id % 20 = 0"), 5).select("query_id", "id", "rank", F.round("cosine", 6).alias("cosine"))


def quantization_error(s, d):
    """What int8 loses of each vector: the clamped cosine of a vector with its quantized form."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    q = F.transform(V.quantize(F.col("embedding")), lambda x: x.cast("double") / 127)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    rows = table(s, d, "embeddings").select("vec_id", v.alias("v"), q.alias("q"))
    cos = dot(F.col("v"), F.col("q")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("q"), F.col("q")))
    return rows.select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos)), 6).alias("cosine"))


def hybrid_blend(s, d):
    """Symbols' scores blended with the best cosine of the chunks that overlap their lines, for one asked chunk of each model: 0.6 to 0.4."""
    e = embeddings_of(s, d)
    asked = e.groupBy("space").agg(F.min("id").alias("id"))
    near = V.exact_top_k(e, e.join(F.broadcast(asked.select("id")), "id", "left_semi"), 50).select("id", F.col("cosine"))
    c = chunks(s, d, "file_id", "start_line", "end_line").join(near.groupBy("id").agg(F.max("cosine").alias("cosine")), "id")
    y = symbols(s, d, "file_id", "start_line", "end_line", "centrality").select(F.col("id").alias("symbol_id"), F.col("file_id").alias("f"), F.col("start_line").alias("a"), F.col("end_line").alias("b"), "centrality")
    hit = y.join(c, (y.f == c.file_id) & (y.a <= c.end_line) & (y.b >= c.start_line)).groupBy("symbol_id").agg(F.max("cosine").alias("cosine"), F.max("centrality").alias("centrality"))
    return hit.select("symbol_id", F.round(0.6 * F.greatest(F.lit(0.0), F.col("cosine")) + 0.4 * F.col("centrality"), 6).alias("score"))


def hashed_embedding(s, d):
    """A stand-in for an embedding model: words hashed into 64 places, unit length; the place of the largest value."""
    rows = table(s, d, "documents").filter("text is not null").select("doc_id", F.explode(X.words(F.col("text"))).alias("w"))
    rows = rows.groupBy("doc_id", F.pmod(F.crc32("w"), F.lit(64)).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    norm = rows.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return rows.join(norm, "doc_id").groupBy("doc_id").agg(F.round(F.max(F.col("n") / F.col("norm")), 6).alias("largest"), F.count(F.lit(1)).alias("places"))


def note_gc(s, d):
    """Notes to archive: weak ones, stale old ones, and those whose symbol has gone."""
    rows = notes(s, d).withColumn("symbol_id", F.col("doc_id") * 3)
    ids = symbols(s, d).select(F.col("id").alias("symbol_id"), F.lit(1).alias("there"))
    rows = rows.join(ids, "symbol_id", "left")
    why = F.when(F.col("confidence") < 0.1, "weak").when((F.col("hit_count") == 0) & (F.col("age_days") > 30), "stale").when(F.col("there").isNull() & (F.col("doc_id") % 2 == 0), "orphan")
    return rows.filter(why.isNotNull()).select("doc_id", why.alias("why"))


def staleness_of_diff(s, d):
    """Confidence of symbols' notes after a diff: changed bodies make notes stale, and what depends on them loses 0.3 a step, two steps deep.

    A symbol counts as modified if another of its name and kind in its file has another body, and as deleted if it was last seen before the others.
    """
    rows = symbols(s, d, "file_id", "name", "kind", "body_hash", "last_seen")
    twins = rows.groupBy("file_id", "name", "kind").agg(F.countDistinct("body_hash").alias("bodies"))
    newest = rows.groupBy("file_id").agg(F.max("last_seen").alias("newest"))
    state = F.when(F.col("last_seen") < F.col("newest"), "deleted").when(F.col("bodies") > 1, "modified")
    hard = cut(rows.join(twins, ["file_id", "name", "kind"]).join(newest, "file_id").select("id", state.alias("state")).filter("state is not null"))
    soft = G.impact(links(s, d), hard.filter("state = 'modified'").select("id"), 2, only_first=()).groupBy("id").agg(F.min("depth").alias("depth")).join(hard.select("id"), "id", "left_anti")
    return hard.select("id", "state", F.lit(0.0).alias("confidence")).unionByName(soft.select("id", F.concat(F.lit("soft "), F.col("depth").cast("string")).alias("state"), F.round(1 - 0.3 * F.col("depth"), 6).alias("confidence")))


def note_seeds(s, d):
    """Notes made from documents: of each the first four paragraphs of twenty characters or more, plain, cut at 200, each once in a scope."""
    rows = table(s, d, "documents").filter("kind in ('readme', 'design_note') and text is not null").select("doc_id", "kind", F.posexplode(F.split("text", r"\r?\n\s*\r?\n")).alias("pos", "part"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("part", "`+", ""), r"\[([^\]]+)\]\([^)]+\)", "$1"), "[*_>#]+", " "), r"\s+", " "))
    rows = rows.select("doc_id", F.when(F.col("kind") == "design_note", "decision").otherwise("documentation").alias("scope"), "pos", plain.alias("note")).filter(F.length("note") >= 20)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    rows = rows.withColumn("rank", rank).filter("rank <= 4").withColumn("note", F.when(F.length("note") > 200, F.concat(F.substring("note", 1, 200), F.lit("..."))).otherwise(F.col("note")))
    return rows.groupBy("scope", F.lower("note").alias("note")).agg(F.min("doc_id").alias("doc_id"))


def note_hits(s, d):
    """Hits of notes: how often and when last, from a session's events."""
    hits = table(s, d, "events").filter("event_type = 'click'").groupBy((F.col("user_id") * 7 + 1).alias("doc_id")).agg(F.count(F.lit(1)).alias("more"), F.max("ts").alias("last_hit_at"))
    return notes(s, d).join(hits, "doc_id").select("doc_id", (F.col("hit_count") + F.col("more")).alias("hit_count"), "last_hit_at")


def auto_notes(s, d):
    """Notes that sure answers leave behind: one for each user with a share of purchases of a tenth or more, capped at 0.6, naming what it held."""
    e = table(s, d, "events").groupBy("user_id").agg(F.avg((F.col("event_type") == "purchase").cast("double")).alias("sure"), F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return e.filter("sure >= 0.1").select("user_id", F.round(F.least("sure", F.lit(0.6)), 6).alias("confidence"), F.array_join(F.slice("kinds", 1, 3), ", ").alias("note"))


def latest_log(s, d):
    """Of each user the latest event of those that the users' first session holds: a log joined to its sessions."""
    e = table(s, d, "events")
    sessions = e.groupBy("user_id").agg(F.min("ts").alias("started"))
    inside = e.join(sessions, "user_id").filter(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp")) <= 86_400_000_000)
    return inside.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", F.col("m.event_id").alias("event_id"))


def watcher_actions(s, d):
    """What a watcher does with events: deletions at once, control files one whole run an hour however many change, others by their file."""
    e = table(s, d, "events").select("event_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    kind = F.when(F.col("event_type") == "error", "remove").when(F.col("k") % 10 == 0, "whole run").otherwise("file")
    slot = F.when(kind == "whole run", F.date_trunc("hour", "ts").cast("string")).otherwise(F.col("event_id").cast("string"))
    return e.groupBy(kind.alias("action"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.countDistinct(slot).alias("runs"))


QUERIES = {f.__name__: f for f in (grep_symbols, chunk_of_line, symbol_resolution, impact_rules, converged_ranks, split_clusters, quality_report, reexport_closure, edge_strengths, depth_of_budget, incoming_flows, overview, index_status, commit_search_ranked, file_history, note_selection, discovered_symbols, vector_topk_in_path, quantization_error, hybrid_blend, hashed_embedding, note_gc, staleness_of_diff, note_seeds, note_hits, auto_notes, latest_log, watcher_actions)}

from tessera.plans.graphs import FL, REACH, L  # noqa: E402
from tessera.plans.memory import N  # noqa: E402
from tessera.plans.relational import DEAD, LARGE  # noqa: E402
from tessera.plans.retrieval import COS, GRAMS  # noqa: E402

LINES = "string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))"
SIM = "len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
TA, TB = GRAMS.format("t.target"), GRAMS.format("n.name")
PASTS = "case when contains(lower(text), '{0}') then 0.5 else 0 end"
WORDS5 = "case when contains(lower(split_part(text, chr(10), 1)), '{0}') then 5 else 0 end + case when contains(lower(text), '{0}') then 4 else 0 end"
PHRASE = "case when contains(lower(split_part(text, chr(10), 1)), '{0}') then 8 else 0 end + case when contains(lower(text), '{0}') then 6 else 0 end"
SQL = {
    "grep_symbols": f"""with c as (select c.id, c.file_id, f.path, chunk_index, {LINES} ls from {C} c join files f on f.id = c.file_id where text is not null), l as (select file_id, path, chunk_index, id, generate_subscripts(ls, 1) p, unnest(ls) as line from c), n as (select file_id, path, line, row_number() over (partition by file_id order by chunk_index, id, p) line_no from l),
w as (select *, array_to_string(list(line) over (partition by file_id order by line_no rows between 2 preceding and 2 following), chr(10)) as context from n), h as (select * from w where regexp_matches(lower(line), '\\bjournal\\w*\\.\\w+\\(') and regexp_matches(path, '^(?:.*/)?[^/]*\\.(?:ts|py|js)$')),
e as (select h.file_id, h.line_no, s.id, s.start_line, row_number() over (partition by h.file_id, h.line_no order by s.end_line - s.start_line, s.start_line, s.id) r from h join {S} s on s.file_id = h.file_id and h.line_no between s.start_line and s.end_line),
x as (select path, h.line_no, line, context, e.id symbol_id, coalesce(e.start_line = h.line_no, false) is_definition from h left join e on e.file_id = h.file_id and e.line_no = h.line_no and r = 1) select *, rank from (select *, row_number() over (order by is_definition desc, path, line_no) rank from x) where rank <= 50""".replace("select *, rank from (", "select path, line_no, line, context, symbol_id, is_definition, rank from ("),
    "chunk_of_line": f"with b as (select s.id symbol_id, c.id chunk_id, row_number() over (partition by s.id order by c.end_line - c.start_line, c.id) r from {S} s join (select distinct id, file_id, start_line, end_line from chunks) c on c.file_id = s.file_id and s.start_line between c.start_line and c.end_line) select chunk_id, count(*) symbols, min(symbol_id) first from b where r = 1 group by 1",
    "symbol_resolution": f"""with t as (select * from (values {", ".join(f"({a}, '{b}')" for a, b, *_ in TARGETS)}) t(n, target)), s as (select * from {S}), nm as (select distinct name from s), f as (select t.n, n.name, round(case when lower(t.target) = lower(n.name) then 1 when contains(lower(n.name), lower(t.target)) then 0.9 when length(t.target) < 3 or length(n.name) < 3 then 0 else {SIM.format(a=TA, b=TB)} end, 6) k from t, nm n), g as (select n, name from (select *, row_number() over (partition by n order by k desc, name desc) r from f where k >= 0.6) where r = 1),
u as (select n, id, centrality, 1 as level from s join t on s.name = t.target union all select n, id, centrality, 2 from s join t on s.qualified_name = t.target union all select g.n, id, centrality, 3 from s join g on g.name = s.name), b as (select *, min(level) over (partition by n) m from u) select n, level, rank, id from (select *, row_number() over (partition by n order by centrality desc, id) rank from b where level = m) where rank <= 10""",
    "impact_rules": f"with recursive {L}, o as (select id, file_id from {S}), rt as (select id root, file_id rf from {S} order by centrality desc, id limit 8), r(root, rf, id, depth) as (select root, rf, root, 0 from rt union select r.root, r.rf, l.src, r.depth + 1 from r join l on l.dst = r.id join o on o.id = l.src where r.depth < 3 and (r.depth = 0 or l.kind not in ('import', 'reexport')) and (r.depth < 2 or o.file_id <> r.rf)) select root, id, cast(min(depth) as bigint) depth from r group by all having min(depth) > 0",
    "split_clusters": f"with recursive {L}, {FL}, u as (select src, dst from fl union select dst, src from fl), r(a, b) as (select id, id from files union select r.a, u.dst from r join u on u.src = r.b), c as (select a id, min(b) k from r group by a), z as (select c.*, array_to_string((string_split(f.path, '/'))[1:2], '/') d, count(*) over (partition by k) n from c join files f on f.id = c.id), y as (select *, case when n > 30 then d else '' end p from z) select id file_id, min(id) over (partition by k, p) head, count(*) over (partition by k, p) files from y",
    "quality_report": f"with recursive {L}, {REACH}, m as (select x.a, x.b from r x join r y on x.a = y.b and x.b = y.a), k as (select a id, least(a, min(b)) component from m where a <> b group by a union select src, src from l where src = dst and src not in (select a from m where a <> b)), a as (select (select count(distinct id) from symbols) total, (select count(*) from ({DEAD})) dead, (select count(*) from ({LARGE})) large, (select count(distinct component) from k) cycles) select *, cast(floor(greatest(0, least(100, 100 - dead / total * 45 - large / total * 35 - cycles / total * 20)) + 0.5) as bigint) score from a",
    "reexport_closure": f"with recursive {L}, e as (select distinct src, dst from l where kind = 'reexport'), r(src, dst, steps) as (select src, dst, 1 from e union select r.src, e.dst, r.steps + 1 from r join e on e.src = r.dst where r.steps < 30) select src symbol_id, dst target_id, cast(min(steps) as bigint) steps, src = dst circular from r group by src, dst",
    "edge_strengths": f"select kind, case kind when 'import' then 0.8 when 'reference' then 0.6 when 'type_usage' then 0.4 else 1 end::double strength_of, case kind " + " ".join(f"when '{k}' then {w}" for k, w in FLOW_WEIGHT.items()) + f" else 0.5 end::double flow, count(*) n, count(*) filter (where strength <> case kind when 'import' then 0.8 when 'reference' then 0.6 when 'type_usage' then 0.4 else 1 end::double) other from {E} group by all",
    "depth_of_budget": "select id, case when id * 900 < 2000 then 3 when id * 900 < 5000 then 4 when id * 900 < 10000 then 5 else 6 end::bigint as depth from files",
    "overview": f"with h as (select repo, count(*) files, count(distinct language) languages, count(*) filter (where regexp_matches(lower(path), '{P.ENTRY_PATH}') or regexp_matches(path, '(^|/)(main|index|app|server)\\.\\w+$')) entries, first(path order by symbol_count desc, id) largest from files group by 1), o as (select f.repo, count(*) symbols, count(*) filter (where s.kind in ('function', 'method', 'arrow')) callables from {S} s join files f on f.id = s.file_id group by 1) select h.*, coalesce(symbols, 0) symbols, coalesce(callables, 0) callables from h left join o using (repo)",
    "index_status": " union all ".join(f"select '{n}' part, count(distinct {k}) as rows, max({k}) as last from {n}" for n, k in (("files", "id"), ("symbols", "id"), ("edges", "id"), ("chunks", "id"), ("chunk_embeddings", "id"), ("documents", "doc_id"), ("events", "event_id"))),
    "commit_search_ranked": "with c as (select * from documents where kind = 'commit_message' and text is not null order by created_at desc, doc_id desc limit 200), s as (select 1 query_id, doc_id, created_at, (" + " + ".join([PHRASE.format("why changed the retry journal"), *[WORDS5.format(w) for w in ("retry", "journal")], *[PASTS.format(w) for w in ("changed", "why")]]) + ")::double score from c union all select 3, doc_id, created_at, (" + " + ".join([PHRASE.format("when was the snapshot introduced"), WORDS5.format("snapshot"), *[PASTS.format(w) for w in ("when", "introduced")]]) + ")::double from c) select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, created_at desc, doc_id) rank from s where score > 0) where rank <= 3",
    "file_history": "with n as (select distinct regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', '') as name from files), w as (select doc_id, unnest(list_distinct(string_split_regex(text, '[^A-Za-z0-9_-]+'))) as name from documents where kind = 'commit_message' and text is not null) select name, count(*) commits, max(doc_id) newest from w join n using (name) group by 1",
    "discovered_symbols": f"with t as (select id, file_id from {S} order by centrality desc, id limit 30) select id, name from {S} where file_id in (select file_id from t) and id not in (select id from t) order by centrality desc, id limit 20",
    "vector_topk_in_path": "with e as (select distinct id, file_id, lower(regexp_replace(model_name, '^\\s+|\\s+$', '', 'g')) m, embedding::double[] v from chunk_embeddings where embedding is not null), u as (select * from e where list_sum(list_transform(v, lambda x: abs(x))) > 0), r as (select a.id query_id, b.id id, round(" + COS + ", 9) c from u a join u b on a.m = b.m and len(a.v) = len(b.v) and a.id <> b.id where a.id % 20 = 0 and b.file_id in (select id from files where path like '%/src/%')) select query_id, id, rank, round(c, 6) cosine from (select *, row_number() over (partition by query_id order by c desc, id) rank from r) where rank <= 5",
    "quantization_error": "with e as (select vec_id, embedding::double[] v from embeddings), n as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) n from e), q as (select vec_id, v, list_transform(v, lambda x: case when n = 0 then 0 else greatest(-127, least(127, floor(x / n * 127 + 0.5))) end / 127::double) q from n) select vec_id, round(greatest(0, least(1, list_cosine_similarity(v, q))), 6)::double cosine from q",
    "note_gc": f"with {N}, x as (select doc_id, case when confidence < 0.1 then 'weak' when hit_count = 0 and age_days > 30 then 'stale' when doc_id % 2 = 0 and doc_id * 3 not in (select id from symbols) then 'orphan' end why from n) select * from x where why is not null",
    "note_seeds": "with p as (select doc_id, kind, unnest(string_split_regex(text, '\\r?\\n\\s*\\r?\\n')) part, generate_subscripts(string_split_regex(text, '\\r?\\n\\s*\\r?\\n'), 1) pos from documents where kind in ('readme', 'design_note') and text is not null), x as (select doc_id, case when kind = 'design_note' then 'decision' else 'documentation' end scope, pos, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(part, '`+', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[*_>#]+', ' ', 'g'), '\\s+', ' ', 'g')) note from p), y as (select *, row_number() over (partition by doc_id order by pos) r from x where length(note) >= 20) select scope, lower(case when length(note) > 200 then substring(note, 1, 200) || '...' else note end) note, min(doc_id) doc_id from y where r <= 4 group by all",
    "note_hits": f"with {N}, h as (select user_id * 7 + 1 doc_id, count(*) more, max(ts) last_hit_at from events where event_type = 'click' group by 1) select n.doc_id, hit_count + more hit_count, last_hit_at from n join h on h.doc_id = n.doc_id",
    "auto_notes": "with e as (select user_id, avg((event_type = 'purchase')::int) sure, list_sort(list(distinct event_type)) k from events group by 1) select user_id, round(least(sure, 0.6), 6)::double confidence, array_to_string(k[1:3], ', ') note from e where sure >= 0.1",
    "latest_log": "with s as (select user_id, min(ts) started from events group by 1) select user_id, event_id from (select e.user_id, e.event_id, row_number() over (partition by e.user_id order by e.ts desc, e.event_id desc) r from events e join s on s.user_id = e.user_id where epoch_us(e.ts) - epoch_us(s.started) <= 86400000000) where r = 1",
    "watcher_actions": "with e as (select *, cast(json_extract_string(props, '$.k') as int) k from events), x as (select *, case when event_type = 'error' then 'remove' when k % 10 = 0 then 'whole run' else 'file' end as act from e) select act as action, strftime(ts, '%Y-%m-%d') as day, count(*) events, count(distinct case when act = 'whole run' then strftime(ts, '%Y-%m-%d %H') else event_id::varchar end) runs from x group by all",
}
