"""Index maintenance, name resolution, file search, features and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans.relational import CALLABLE, C, E, S, chunks, convention, edges, files, symbols
from tessera.plans.retrieval import IDENT, LESS_SQL, ORDERED
from tessera.sources.tables import table


def qualified_names(s, d):
    """Each method's name led by that of the smallest class around it in its file."""
    rows = symbols(s, d, "file_id", "name", "kind", "start_line", "end_line")
    inner = rows.filter("kind = 'method'").select(F.col("id").alias("symbol_id"), "file_id", F.col("name").alias("own"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    outer = rows.filter("kind = 'class'").select("file_id", "id", "name", "start_line", "end_line")
    hit = inner.join(outer, "file_id").filter("start_line <= a and end_line >= b")
    rank = F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "id"))
    return hit.withColumn("rank", rank).filter("rank = 1").select("symbol_id", F.concat_ws(".", "name", "own").alias("qualified"))


def call_targets(s, d, most: int = 12):
    """For each call the symbols its target's name may mean: those of the caller's file, else of its repository, else any; the first level that has one, up to twelve."""
    owner = symbols(s, d, "file_id", "name", "kind").join(files(s, d, "repo").withColumnRenamed("id", "file_id"), "file_id")
    calls = edges(s, d).filter("kind = 'call'").select("id", "source_symbol_id", "target_symbol_id")
    asks = calls.join(owner.select(F.col("id").alias("source_symbol_id"), F.col("file_id").alias("f"), F.col("repo").alias("r")), "source_symbol_id").join(owner.select(F.col("id").alias("target_symbol_id"), "name"), "target_symbol_id").select(F.col("id").alias("edge_id"), "f", "r", "name")
    known = owner.filter(F.col("kind").isin(CALLABLE)).select(F.col("id").alias("symbol_id"), "file_id", "repo", "name")
    # one join per level: a name that a tenth of all symbols have is never joined globally, its twelve smallest ids are looked up
    own = asks.join(known.select("name", F.col("file_id").alias("f"), "symbol_id"), ["name", "f"]).select("edge_id", "symbol_id", F.lit(1).alias("level"))
    rest = asks.join(own.select("edge_id").distinct(), "edge_id", "left_anti")

    def first_of(keys):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("symbol_id"))
        return known.withColumn("n", rank).filter(F.col("n") <= most)

    near = rest.join(first_of(["name", "repo"]).select("name", F.col("repo").alias("r"), "symbol_id"), ["name", "r"]).select("edge_id", "symbol_id", F.lit(2).alias("level"))
    rest = rest.join(near.select("edge_id").distinct(), "edge_id", "left_anti")
    far = rest.join(first_of(["name"]).select("name", "symbol_id"), "name").select("edge_id", "symbol_id", F.lit(3).alias("level"))
    rank = F.row_number().over(Window.partitionBy("edge_id").orderBy("symbol_id"))
    return own.unionByName(near).unionByName(far).withColumn("n", rank).filter(F.col("n") <= most).select("edge_id", "symbol_id", "level")


def reexport_targets(s, d):
    """What each symbol stands for in the end through re-exports, at most eight steps, and how many."""
    links = edges(s, d).filter("kind = 'reexport'").groupBy(F.col("source_symbol_id").alias("src")).agg(F.min("target_symbol_id").alias("dst"))
    rows = links.select("src", F.col("dst").alias("at"), F.lit(1).alias("steps"))
    for _ in range(7):
        nxt = links.select(F.col("src").alias("at"), F.col("dst").alias("to"))
        rows = rows.join(nxt, "at", "left").select("src", F.coalesce("to", "at").alias("at"), (F.col("steps") + F.when(F.col("to").isNotNull(), 1).otherwise(0)).alias("steps"))
    return rows.select(F.col("src").alias("symbol_id"), F.col("at").alias("target_id"), F.col("steps").cast("bigint").alias("steps"))


def route_match(s, d):
    """Paths of three segments or more against routes with a placeholder in the middle, segment by segment: matches of each route."""
    parts = files(s, d, "path").withColumn("parts", F.split("path", "/")).withColumn("n", F.size("parts"))
    routes = parts.groupBy("n", F.element_at("parts", 1).alias("repo")).agg(F.min("parts").alias("p")).select("n", "repo", F.transform("p", lambda x, i: F.when(i >= 2, F.lit("[x]")).otherwise(x)).alias("route"))
    hit = parts.join(routes, "n").filter(F.forall(F.zip_with("parts", "route", lambda a, b: (a == b) | F.startswith(b, F.lit("["))), lambda x: x))
    return hit.groupBy(F.concat_ws("/", "route").alias("route")).agg(F.count(F.lit(1)).alias("files"))


def file_search(s, d):
    """Files by words in their path and symbol names: exact words 2 each, times the directory's weight, tests and configuration less."""
    terms = ["journal", "retry", "snapshot"]
    names = symbols(s, d, "file_id", "name").groupBy("file_id").agg(F.array_distinct(F.flatten(F.collect_set(X.split_identifier(F.col("name"))))).alias("words"))
    rows = files(s, d, "path", "language").withColumnRenamed("id", "file_id").join(names, "file_id", "left")
    path_words = X.split_identifier(F.col("path"))
    hits = sum((F.when(F.array_contains(path_words, t), 2.0).otherwise(0.0) + F.when(F.array_contains(F.coalesce("words", F.array().cast("array<string>")), t), 1.0).otherwise(0.0) for t in terms), F.lit(0.0))
    low = F.regexp_replace(F.lower("path"), "^[^/]+/", "")
    weight = X.directory_weight(low) * F.when(F.col("path").rlike(X.TEST_PATH), 0.35).otherwise(1.0) * F.when(F.col("language").isin("json", "yaml"), 0.18).otherwise(1.0)
    return rows.select("file_id", F.round(hits * weight, 6).alias("score")).filter("score > 0").orderBy(F.desc("score"), "file_id").limit(50)


def pivot_scores(s, d):
    """Symbols for a query: name 10, signature 5, path 3 a word, by kind, exact name 100 more."""
    terms = ["journal", "retry"]
    rows = symbols(s, d, "file_id", "name", "kind", "signature").join(files(s, d, "path").withColumnRenamed("id", "file_id"), "file_id")
    words = X.split_identifier(F.col("name"))
    score = sum((F.when(F.array_contains(words, t), 10.0).otherwise(0.0) + F.when(F.contains(F.lower("signature"), F.lit(t)), 5.0).otherwise(0.0) + F.when(F.contains(F.lower("path"), F.lit(t)), 3.0).otherwise(0.0) for t in terms), F.lit(0.0))
    kind = F.when(F.col("kind").isin("class", "function"), 1.2).when(F.col("kind") == "method", 1.0).otherwise(0.8)
    score = score * kind + F.when(F.lower("name") == "journal", 100.0).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("score"), "id"))
    return rows.select("id", "file_id", F.round(score, 6).alias("score")).filter("score > 0").withColumn("rank", rank).filter("rank <= 4").select("id", "file_id", "score")


def body_features(s, d):
    """Dotted chains and error texts in sources: how many symbols hold each."""
    rows = symbols(s, d, "full_source").select("id", F.explode(F.array_distinct(F.concat(F.expr(r"regexp_extract_all(full_source, '([a-z]+[.][a-z]+)[(]', 1)"), F.expr("regexp_extract_all(full_source, 'Error[(][\"`]([a-z]+)', 1)")))).alias("feature"))
    return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("symbols"))


def commit_search(s, d):
    """Commit messages by the query's words: five each in the subject, four in the rest."""
    terms = ["journal", "retry", "cache"]
    rows = table(s, d, "documents").filter("kind = 'commit_message' and text is not null").withColumn("subject", F.lower(F.substring_index("text", "\n", 1))).withColumn("low", F.lower("text"))
    score = sum((F.when(F.contains("subject", F.lit(t)), 5).when(F.contains("low", F.lit(t)), 4).otherwise(0) for t in terms), F.lit(0))
    return rows.select("doc_id", score.cast("bigint").alias("score")).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


def file_lines(s, d, first: int = 10, last: int = 12):
    """Lines ten to twelve of every file, from its chunks in order."""
    c = chunks(s, d, "file_id", "chunk_index", "text").withColumn("lines", F.split("text", r"\r?\n")).withColumn("n", F.size("lines"))
    w = Window.partitionBy("file_id").orderBy("chunk_index", "id").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0))).filter((F.col("base") < last) & (F.col("base") + F.col("n") >= first))
    rows = c.select("file_id", "base", F.posexplode("lines").alias("pos", "line")).withColumn("line_no", F.col("base") + F.col("pos") + 1)
    return rows.filter(F.col("line_no").between(first, last)).select("file_id", "line_no", "line")


def line_windows(s, d, size: int = 40, overlap: int = 4):
    """Every chunk's text as windows of forty lines that overlap by four."""
    c = chunks(s, d, "text").select("id", F.split("text", r"\r?\n").alias("lines"))
    rows = c.select("id", "lines", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("lines") - overlap - 1), F.lit(size - overlap))).alias("start"))
    return rows.select("id", (F.col("start") + 1).cast("bigint").alias("first_line"), F.least(F.col("start") + size, F.size("lines")).cast("bigint").alias("last_line"))


def repo_profile(s, d):
    """Languages, test files and top directories of each repository."""
    rows = files(s, d, "path", "repo", "language").withColumn("root", F.element_at(F.split("path", "/"), 2))
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("language").alias("languages"), F.concat_ws(",", F.array_sort(F.collect_set("root"))).alias("roots"), F.sum(F.col("path").rlike(X.TEST_PATH).cast("bigint")).alias("tests"))


def common_prefix(s, d):
    """The directory that all files of a repository share: that of its first and last path."""
    ends = files(s, d, "path", "repo").groupBy("repo").agg(F.split(F.min("path"), "/").alias("a"), F.split(F.max("path"), "/").alias("b"))
    same = F.aggregate(F.zip_with("a", "b", lambda x, y: x == y), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda t, x: F.struct((t["on"] & F.coalesce(x, F.lit(False))).alias("on"), (t["n"] + F.when(t["on"] & F.coalesce(x, F.lit(False)), 1).otherwise(0)).alias("n")))["n"]
    same = F.least(same, F.size("a") - 1, F.size("b") - 1)
    return ends.select("repo", F.concat_ws("/", F.slice("a", F.lit(1), same)).alias("prefix"))


def incremental_plan(s, d):
    """What a re-index would do with each file: skip, read again, or retry after an error."""
    state = F.when(F.length(F.coalesce("error", F.lit(""))) > 0, "retry").when(F.col("mtime") > F.col("last_indexed"), "reindex").otherwise("skip")
    return files(s, d, "language", "mtime", "last_indexed", "error").groupBy("language", state.alias("action")).agg(F.count(F.lit(1)).alias("files"))


def layer_coverage(s, d):
    """Layers that a repository lacks of those that others have."""
    have = files(s, d, "path", "repo").select("repo", convention(F.col("path")).alias("layer")).filter("layer is not null").distinct()
    all_layers, repos = have.select("layer").distinct(), files(s, d, "repo").select("repo").distinct()
    return repos.crossJoin(F.broadcast(all_layers)).join(have, ["repo", "layer"], "left_anti")  # layers are a fixed list of names


def rerank_blend(s, d):
    """The first eighty chunks of BM25 blended 0.4 to 0.6 with a second, deterministic scorer (trigrams of query and text's first line)."""
    from tessera.operators import retrieval as R
    from tessera.plans.retrieval import asked

    c = chunks(s, d, "text")
    q = asked(s)
    top = R.bm25(R.postings(c, "id"), R.query_terms(q), 80).join(q, "query_id").join(c.withColumnRenamed("id", "doc_id"), "doc_id")
    largest = F.max("score").over(Window.partitionBy("query_id"))
    second = X.similarity(F.col("query"), F.substring_index("text", "\n", 1))
    return R.ranked(top.select("query_id", "doc_id", F.round(0.4 * F.col("score") / largest + 0.6 * second, 9).alias("score")), 20)


def eval_tasks(s, d):
    """Users as tasks and their events as attempts: the first purchase, the events before it, and whether an error came first."""
    e = table(s, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = e.withColumn("n", n)
    out = e.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("n"))).alias("first_success"), F.min(F.when(F.col("event_type") == "error", F.col("n"))).alias("first_error"))
    return out.select("user_id", F.col("first_success").cast("bigint").alias("first_success"), F.coalesce(F.col("first_error") < F.col("first_success"), F.lit(False)).alias("corrected"))


def eval_suite(s, d):
    """The tasks' success, correction and p95 of turns to success."""
    t = eval_tasks(s, d).filter("first_success is not null")
    counts = t.groupBy("first_success").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("upto", F.sum("c").over(Window.orderBy("first_success"))).crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias("total"))))
    p95 = counts.filter(F.col("upto") > F.ceil(F.col("total") * 0.95) - 1).agg(F.min("first_success").alias("p95_turns"))
    rate = eval_tasks(s, d).agg(F.count(F.lit(1)).alias("tasks"), F.round(F.avg(F.col("first_success").isNotNull().cast("double")), 6).alias("success"), F.round(F.avg(F.col("corrected").cast("double")), 6).alias("corrected"))
    return rate.crossJoin(F.broadcast(p95))  # one row each


def ratchet(s, d):
    """Languages whose share of files with an error is above the baseline (that of all files) by more than a hundredth."""
    rows = files(s, d, "language", "error").withColumn("bad", (F.length(F.coalesce("error", F.lit(""))) > 0).cast("double"))
    base = rows.agg(F.avg("bad").alias("base"))
    out = rows.groupBy("language").agg(F.avg("bad").alias("rate")).crossJoin(F.broadcast(base))
    return out.filter("rate > base + 0.01").select("language", F.round("rate", 6).alias("rate"))


QUERIES = {f.__name__: f for f in (qualified_names, call_targets, reexport_targets, route_match, file_search, pivot_scores, body_features, commit_search, file_lines, line_windows, repo_profile, common_prefix, incremental_plan, layer_coverage, rerank_blend, eval_tasks, eval_suite, ratchet)}
WORDS = ORDERED.format(IDENT)
PATH_WORDS = WORDS.replace("regexp_replace(name", "regexp_replace(path")
from tessera.plans.relational import CONVENTION  # noqa: E402

ATT = "a as (select *, row_number() over (partition by user_id order by ts, event_id) n from events), t as (select user_id, min(n) filter (where event_type = 'purchase') first_success, min(n) filter (where event_type = 'error') first_error from a group by 1), u as (select user_id, first_success, coalesce(first_error < first_success, false) corrected from t)"
LINES = "string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))"
SQL = {
    "qualified_names": f"select symbol_id, qualified from (select m.id symbol_id, c.name || '.' || m.name qualified, row_number() over (partition by m.id order by c.end_line - c.start_line, c.start_line, c.id) r from {S} m join {S} c on c.file_id = m.file_id and c.start_line <= m.start_line and c.end_line >= m.end_line where m.kind = 'method' and c.kind = 'class') where r = 1",
    "call_targets": f"""with o as (select s.id, s.file_id, s.name, s.kind, f.repo from {S} s join files f on f.id = s.file_id), q as (select e.id edge_id, a.file_id f, a.repo r, b.name from {E} e join o a on a.id = e.source_symbol_id join o b on b.id = e.target_symbol_id where e.kind = 'call'),
h as (select q.edge_id, o.id symbol_id, case when o.file_id = q.f then 1 when o.repo = q.r then 2 else 3 end as level from q join o on o.name = q.name and o.kind in ('function','method','arrow')), m as (select *, min(level) over (partition by edge_id) best from h) select edge_id, symbol_id, level from (select *, row_number() over (partition by edge_id order by symbol_id) n from m where level = best) where n <= 12""",
    "route_match": "with p as (select string_split(path, '/') parts, len(string_split(path, '/')) n from files), r as (select n, parts[1] repo, min(parts) p from p group by all), q as (select n, list_transform(p, lambda x, i: case when i >= 3 then '[x]' else x end) route from r) select array_to_string(route, '/') route, count(*) files from p join q using (n) where parts[1] = route[1] and parts[2] = route[2] group by 1",
    "commit_search": "select doc_id, score from (select doc_id, cast(" + " + ".join(f"case when contains(lower(split_part(text, chr(10), 1)), '{t}') then 5 when contains(lower(text), '{t}') then 4 else 0 end" for t in ("journal", "retry", "cache")) + " as bigint) score from documents where kind = 'commit_message' and text is not null) where score > 0 order by score desc, doc_id limit 20",
    "file_lines": f"with c as (select id, file_id, chunk_index, {LINES} ls from {C}), b as (select *, coalesce(sum(len(ls)) over (partition by file_id order by chunk_index, id rows between unbounded preceding and 1 preceding), 0) base from c), x as (select file_id, cast(base + generate_subscripts(ls, 1) as bigint) line_no, unnest(ls) as line from b) select * from x where line_no between 10 and 12",
    "line_windows": f"with c as (select id, len({LINES}) n from {C}), w as (select id, n, unnest(range(0, greatest(0, n - 5) + 1, 36)) start from c) select id, start + 1 first_line, least(start + 40, n) last_line from w",
    "repo_profile": "select repo, count(*) files, count(distinct language) languages, array_to_string(list_sort(list(distinct string_split(path, '/')[2])), ',') roots, count(*) filter (where regexp_matches(lower(path), '(^|/)(tests?|__tests?__|spec)/|\\.(test|spec)\\.')) tests from files group by 1",
    "incremental_plan": "select language, case when length(coalesce(error, '')) > 0 then 'retry' when mtime > last_indexed then 'reindex' else 'skip' end as action, count(*) files from files group by all",
    "layer_coverage": f"with h as (select distinct repo, {CONVENTION} layer from files), a as (select distinct layer from h where layer is not null) select r.repo, a.layer from (select distinct repo from files) r, a where (r.repo, a.layer) not in (select repo, layer from h where layer is not null)",
    "eval_tasks": f"with {ATT} select * from u",
    "eval_suite": f"with {ATT}, v as (select list_sort(list(first_success)) l from u where first_success is not null) select (select count(*) from u) tasks, (select round(avg((first_success is not null)::int), 6) from u) success, (select round(avg(corrected::int), 6) from u) corrected, l[cast(ceil(len(l) * 0.95) as bigint)] p95_turns from v",
    "ratchet": "with b as (select language, (length(coalesce(error, '')) > 0)::int bad from files) select language, round(avg(bad), 6) rate from b group by 1 having avg(bad) > (select avg(bad) from b) + 0.01",
    "pivot_scores": f"with r as (select s.id, s.file_id, (" + " + ".join(f"case when list_contains({WORDS}, '{t}') then 10.0 else 0 end + case when contains(lower(signature), '{t}') then 5.0 else 0 end + case when contains(lower(path), '{t}') then 3.0 else 0 end" for t in ("journal", "retry")) + f") * case when kind in ('class','function') then 1.2 when kind = 'method' then 1.0 else 0.8 end + case when lower(name) = 'journal' then 100.0 else 0 end v from {S} s join files f on f.id = s.file_id), x as (select id, file_id, round(v, 6)::double score from r where v > 0) select id, file_id, score from (select *, row_number() over (partition by file_id order by score desc, id) k from x) where k <= 4",
    "common_prefix": "with e as (select repo, string_split(min(path), '/') a, string_split(max(path), '/') b from files group by 1), n as (select *, coalesce(list_min(list_filter(range(1, 30), lambda i: i > len(a) - 1 or i > len(b) - 1 or a[i] <> b[i])), 30) k from e) select repo, array_to_string(a[1:k - 1], '/') prefix from n",
}
