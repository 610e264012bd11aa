"""Predicates, lookups and column functions over the index tables, one query each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import text as X
from tessera.plans.memory import notes
from tessera.plans.relational import C, CALLABLE, E, S, chunks, edges, files, symbols
from tessera.plans.understanding import words_sql
from tessera.sources.tables import table

BASES = ["rookery/src", "tern-router/packages/core", "saltmarsh", "granary/tests", ""]
LANES = [("src/", "core", 0.3), ("packages/core/", "core", 0.5), ("lib/", "library", 0.2), ("tests/", "tests", 0.1), ("app/", "app", 0.4), ("services/", "service", 0.25), ("src/index/", "index", 0.6)]
TERMS = ["journal", "r_try", "cache", "snap%"]
KINDS = "function class method type interface variable enum arrow module".split()


def point_lookups(s, d):
    """Symbols by id, name, qualified name, parent and body's hash of the first one of each name a query gives."""
    rows = symbols(s, d, "name", "kind", "qualified_name", "parent_symbol_id", "body_hash").filter(F.col("name").isin("handle", "drainRetry") | F.col("id").between(10, 14) | F.col("parent_symbol_id").between(20, 30) | F.col("qualified_name").endswith(".rotate"))
    by = F.when(F.col("id").between(10, 14), "id").when(F.col("name").isin("handle", "drainRetry"), "name").when(F.col("parent_symbol_id").between(20, 30), "parent").otherwise("qualified")
    return rows.groupBy(by.alias("by"), "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("body_hash").alias("bodies"))


def idf_wildcards(s, d):
    """Files with a name like each term, in which _ and % match anything, and the terms' weights; one pass for all terms."""
    low, total = F.lower("name"), files(s, d).agg(F.count(F.lit(1)).alias("total"))
    counts = symbols(s, d, "file_id", "name").agg(*[F.countDistinct(F.when(low.like(f"%{t}%"), F.col("file_id"))).alias(f"n{i}") for i, t in enumerate(TERMS)])
    rows = counts.crossJoin(total).select("total", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"n{i}").alias("n")) for i, t in enumerate(TERMS)])).alias("t"))  # one row each
    return rows.select("t.term", F.col("t.n").alias("files"), F.round(F.log(F.col("total") / (1 + F.col("t.n"))), 6).alias("idf"))


def suffix_lookup(s, d):
    """For the last two segments of each file: the path that is equal, else the shortest that ends with them."""
    rows = files(s, d, "path").withColumn("suffix", X.last_segments(F.col("path"), 2))
    best = rows.groupBy("suffix").agg(F.min(F.struct((F.col("path") != F.col("suffix")).alias("other"), F.length("path").alias("n"), "path", "id")).alias("b"))
    return best.select("suffix", F.col("b.path").alias("path"), F.col("b.id").alias("id"))


def within_path(s, d):
    rows = files(s, d, "path").select("path", F.explode(F.array(*[F.lit(b) for b in BASES])).alias("base"))
    return rows.filter(P.within(F.col("path"), F.col("base"))).groupBy("base").agg(F.count(F.lit(1)).alias("files"))


def safe_paths(s, d):
    """Which ways of writing a path are let through."""
    p = F.col("path")
    ways = {"plain": p, "up": F.concat(F.lit("a/../"), p), "absolute": F.concat(F.lit("/"), p), "drive": F.concat(F.lit("C:"), p), "home": F.concat(F.lit("~/"), p), "dots": F.concat(F.lit("a../..b/"), p), "long": F.repeat(p, 200), "empty": F.lit("")}
    rows = files(s, d, "path").select(F.explode(F.array(*[F.struct(F.lit(k).alias("way"), v.alias("path")) for k, v in ways.items()])).alias("w")).select("w.*")
    return rows.groupBy("way").agg(F.sum(P.is_safe(F.col("path")).cast("bigint")).alias("safe"))


def path_flags(s, d):
    return files(s, d, "path").select("id", *[P.is_path(F.col("path"), name).alias(name) for name in P.FLAGS])


def kind_weights(s, d):
    rows = symbols(s, d, "kind", "visibility").select("kind", "visibility", P.weight_of(F.col("kind"), P.RUNTIME_KINDS).alias("result"), P.weight_of(F.col("kind"), P.PIVOT_KINDS).alias("pivot"), P.weight_of(F.col("visibility"), P.VISIBILITY).alias("seen"))
    return rows.groupBy("kind", "visibility", "result", "pivot", "seen").agg(F.count(F.lit(1)).alias("n"))


def row_validation(s, d):
    """Rows that no reader may use, by what is wrong with them, and those that are fine."""
    rows = symbols(s, d, "file_id", "name", "kind", "start_line", "end_line", "visibility", "parent_symbol_id")
    why = F.when(F.col("name").isNull() | (F.col("name") == ""), "name").when(F.col("file_id").isNull(), "file").when(~F.col("kind").isin(KINDS), "kind").when(~F.col("visibility").isin("public", "private", "protected", "internal"), "visibility").when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "lines").when(F.col("parent_symbol_id") == 0, "parent").otherwise("fine")
    return rows.groupBy(why.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def pivot_candidates(s, d):
    """Symbols with their paths, without type declarations and directories that hardly count."""
    f = files(s, d, "path").withColumnRenamed("id", "file_id").withColumn("weight", X.directory_weight(F.regexp_replace("path", "^[^/]+/", "")))
    f = f.filter(~P.is_path(F.col("path"), "type_declaration") & (F.col("weight") > 0.2))
    return symbols(s, d, "file_id", "name").join(f, "file_id").select("id", "path", "weight")


def note_lookups(s, d):
    """Notes by scope: all, expired passive ones, active ones, and those last hit."""
    rows = notes(s, d)
    expired = (F.col("scope") == "memory-notes") & (F.col("age_days") > 7)
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("notes"), F.sum(expired.cast("bigint")).alias("expired"), F.sum((~expired & (F.col("confidence") >= 0.1)).cast("bigint")).alias("active"), F.max("hit_count").alias("hits"))


def edge_enrichment(s, d):
    """Outgoing edges of the hundred most central symbols with their targets' names and paths."""
    rows = symbols(s, d, "file_id", "name", "centrality")
    top = rows.orderBy(F.desc("centrality"), "id").limit(100).select(F.col("id").alias("source_symbol_id"))
    out = edges(s, d).join(F.broadcast(top), "source_symbol_id", "left_semi")  # a hundred ids
    target = rows.select(F.col("id").alias("target_symbol_id"), F.col("name").alias("target"), "file_id").join(files(s, d, "path").withColumnRenamed("id", "file_id"), "file_id")
    return out.join(target, "target_symbol_id").select("id", "source_symbol_id", "kind", "target", "path")


def member_of(s, d):
    """Files whose repository is in a parameter given as JSON."""
    wanted = s.createDataFrame([('["rookery", "granary", "nowhere", "rookery"]',)], "j string").select(F.explode(P.json_list(F.col("j"))).alias("repo"))
    return files(s, d, "repo", "language").join(F.broadcast(wanted), "repo", "left_semi").groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n"))


def boost_recent(s, d):
    """Centrality of symbols, 1.2 times in the fifty files changed last."""
    recent = files(s, d, "mtime").orderBy(F.desc("mtime"), "id").limit(50).select(F.col("id").alias("file_id"), F.lit(1.2).alias("boost"))
    return symbols(s, d, "file_id", "centrality").join(F.broadcast(recent), "file_id", "left").select("id", F.round(F.col("centrality") * F.coalesce("boost", F.lit(1.0)), 9).alias("score"))


def name_spread(s, d):
    """Names in more than five files and what that leaves of a score without a word of the query."""
    rows = symbols(s, d, "file_id", "name").groupBy(F.lower("name").alias("name")).agg(F.countDistinct("file_id").alias("files"))
    return rows.filter("files > 5").select("name", "files", F.round(F.least(F.lit(1.0), 5.0 / F.col("files")), 6).alias("factor"))


def exists_any(s, d):
    """Whether any of several tables has a row of its own kind: each is read until its first."""
    tests = {"errors": table(s, d, "files").filter("error is not null and error <> ''"), "loops": table(s, d, "edges").filter("source_symbol_id = target_symbol_id"), "purchases": table(s, d, "events").filter("event_type = 'purchase'"), "nothing": table(s, d, "files").filter("id < 0")}
    union = None
    for name, df in tests.items():
        part = df.limit(1).select(F.lit(name).alias("what"))
        union = part if union is None else union.unionAll(part)
    return union


def function_summary(s, d):
    """The functions of each file: the first three names and how many more."""
    rows = symbols(s, d, "file_id", "name", "kind").filter(F.col("kind").isin(CALLABLE)).groupBy("file_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    more = F.when(F.size("names") > 3, F.concat(F.lit(" +"), (F.size("names") - 3).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return rows.select("file_id", F.concat(F.array_join(F.slice("names", 1, 3), ", "), more).alias("summary"))


def bootstrap_sync(s, d):
    """Seeds wanted from readmes against notes there are: kept, to be created, to be archived, by content."""
    rows = table(s, d, "documents").filter("length(text) > 0").select("kind", F.sha2("text", 256).alias("hash"))
    want, have = rows.filter("kind in ('readme', 'design_note')").select("hash", F.lit(1).alias("w")).distinct(), rows.filter("kind in ('memory_note', 'design_note')").select("hash", F.lit(1).alias("h")).distinct()
    return want.join(have, "hash", "full").groupBy(F.when(F.col("h").isNull(), "create").when(F.col("w").isNull(), "archive").otherwise("keep").alias("action")).agg(F.count(F.lit(1)).alias("n"))


def subset_names(s, d):
    """Names all of whose words are among the query's."""
    wanted = F.array(*[F.lit(w) for w in "drain retry journal rotate session cache seal handle fetch".split()])
    names = symbols(s, d, "name").select("name").distinct()
    return names.filter(F.size(F.array_except(X.split_identifier(F.col("name")), wanted)) == 0)


def central_of_name(s, d):
    """Of each name the most central symbol."""
    return symbols(s, d, "name", "centrality").groupBy("name").agg(F.max(F.struct("centrality", (-F.col("id")).alias("n"))).alias("m")).select("name", (-F.col("m.n")).alias("id"))


def first_matches(s, d):
    """A scan that stops early: how many of at most twenty files hold the term."""
    return table(s, d, "files").filter(F.contains("path", F.lit("journal"))).limit(20).agg(F.count(F.lit(1)).alias("n"))


def overview_trim(s, d, most: int = 200):
    """The lines of each document that fit a budget of a quarter token a character, rounded up line by line; the first that does not ends it."""
    lines = table(s, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    used = F.sum(F.ceil(F.length("line") / 4)).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("used", used).filter(F.col("used") <= most).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.max("used").alias("tokens"))


def path_words(s, d):
    words = F.array(*[F.lit(w) for w in ("journal", "snapshot", "capsule", "retry")])
    return files(s, d, "path").select("id", F.array_join(P.path_terms(F.col("path")), " ").alias("terms"), P.path_matches(F.col("path"), words).alias("matches"))


def request_paths(s, d):
    """Paths of the requests in chunks, without origin, query and inserted expressions."""
    urls = chunks(s, d, "text").select(F.explode(F.expr(r"regexp_extract_all(text, '[a-z]+://[^\\s\"''`<>)]+', 0)")).alias("url"))
    return urls.groupBy(P.request_path(F.col("url")).alias("path")).agg(F.count(F.lit(1)).alias("n"))


def lanes(s, d):
    """The weight of each file's lanes and the layer of the longest prefix."""
    below = F.regexp_replace("path", "^[^/]+/", "")
    hits = F.filter(F.array(*[F.struct(F.lit(len(p)).alias("n"), F.lit(layer).alias("layer"), F.lit(w).alias("w"), F.lit(p).alias("p")) for p, layer, w in LANES]), lambda x: F.startswith(F.col("below"), x["p"]))
    rows = files(s, d, "path").withColumn("below", below).withColumn("hits", hits)
    return rows.select("id", F.coalesce(1 + F.array_max(F.transform("hits", lambda h: h["w"])), F.lit(1.0)).alias("weight"), F.array_max("hits")["layer"].alias("layer"))


def word_matches(s, d):
    """Words of names against words of a query: covered, of one stem."""
    words = symbols(s, d, "name").select("name").distinct().select(F.explode(P.camel_words(F.col("name"))).alias("word")).distinct()
    rows = words.select("word", F.explode(F.array(*[F.lit(w) for w in ("journaling", "retry", "cached", "snap")])).alias("term"))
    return rows.select("word", "term", P.covers(F.col("word"), F.col("term")).alias("covers"), P.same_stem(F.col("word"), F.col("term")).alias("stem")).filter("covers or stem")


def near_words(s, d):
    """Symbols in whose path, name and signature two words stand within fifty characters."""
    f = files(s, d, "path").withColumnRenamed("id", "file_id")
    rows = symbols(s, d, "file_id", "name", "signature").join(f, "file_id")
    text = F.lower(F.concat_ws(" ", X.last_segments(F.col("path"), 6), "name", "signature"))
    return rows.filter(P.near(text, "journal", "drain")).select("id")


def recency_bonus(s, d):
    return notes(s, d).filter("age_days is not null").groupBy(P.recency_bonus(F.col("age_days") - 300).alias("bonus")).agg(F.count(F.lit(1)).alias("n"))


def json_lists(s, d):
    """Lists kept as JSON, with broken ones read as empty."""
    kept = F.when(F.col("id") % 7 == 0, F.lit('["cut')).when(F.col("id") % 7 == 1, F.lit(None)).otherwise(F.to_json("scope_chain"))
    return chunks(s, d, "scope_chain").select("id", F.size(P.json_list(kept)).cast("bigint").alias("n"))


def formats(s, d):
    rows = files(s, d, "path", "mtime", "symbol_count")
    size = (F.length("path") * F.col("symbol_count") * 997).cast("bigint")
    return rows.select("id", P.human_bytes(size).alias("size"), F.date_format(F.timestamp_millis("mtime"), "yyyy-MM-dd").alias("day"), F.concat(X.round_half_up(F.col("symbol_count") % 100 / 99 * 100).cast("string"), F.lit("%")).alias("share"))


def summary_text(s, d):
    """The words of each file's path, names, signatures and kinds, each once, in order of the alphabet."""
    pieces = lambda c: F.concat(F.transform(F.split(c, "[^A-Za-z0-9]+"), F.lower), X.split_identifier(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")))
    own = symbols(s, d, "file_id", "name", "signature", "kind").select("file_id", F.explode(F.array_distinct(F.concat(pieces(F.col("name")), pieces(F.col("signature")), F.array(F.lower("kind"))))).alias("w"))
    path = files(s, d, "path").select(F.col("id").alias("file_id"), F.explode(pieces(X.last_segments(F.col("path"), 6))).alias("w"))
    words = own.unionByName(path).filter("length(w) >= 2").distinct()
    return words.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("w")), " "), 256).alias("words"))


def relative_paths(s, d):
    p = F.col("path")
    odd = F.when(F.col("id") % 3 == 0, F.concat(F.lit("/work//"), F.replace(p, F.lit("/"), F.lit("\\")))).when(F.col("id") % 3 == 1, F.concat(F.lit("./"), p)).otherwise(F.concat(F.lit("/elsewhere/"), p))
    return files(s, d, "path").select("id", P.relative(F.lit("/work/"), odd).alias("path"))


def match_lines(s, d):
    """The line of the first return in each symbol's source."""
    at = F.instr("full_source", "return")
    return symbols(s, d, "full_source", "start_line").withColumn("at", at).filter("at > 0").select("id", P.line_of(F.col("full_source"), F.col("at"), F.col("start_line")).cast("bigint").alias("line"))


def budget_fit(s, d):
    """Chunks that fit what a budget leaves, by file."""
    return chunks(s, d, "file_id", "chunk_index", "text").groupBy("file_id").agg(F.sum((X.estimate_tokens(F.col("text")) <= 300 - F.col("chunk_index") * 20).cast("bigint")).alias("fit"), F.count(F.lit(1)).alias("n"))


def plain_markdown(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.sha2(X.plain_markdown(F.col("text")), 256).alias("hash"))


def camel_names(s, d):
    return symbols(s, d, "name").select("name").distinct().select("name", F.array_join(P.camel_words(F.col("name")), " ").alias("words"))


QUERIES = {f.__name__: f for f in (point_lookups, idf_wildcards, suffix_lookup, within_path, safe_paths, path_flags, kind_weights, row_validation, pivot_candidates, note_lookups, edge_enrichment, member_of, boost_recent, name_spread, exists_any, function_summary, bootstrap_sync, subset_names, central_of_name, first_matches, overview_trim, path_words, request_paths, lanes, word_matches, near_words, recency_bonus, json_lists, formats, summary_text, relative_paths, match_lines, budget_fit, plain_markdown, camel_names)}

from tessera.plans.memory import N  # noqa: E402
from tessera.plans.relational import SEG2  # noqa: E402
from tessera.plans.retrieval import IDENT, LESS_SQL, ORDERED  # noqa: E402


def case_sql(column: str, weights: dict[str, float]) -> str:
    return f"case lower({column}) " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + " else 1.0 end::double"


SPLIT = ORDERED.format(IDENT)
SEG6 = SEG2.replace("- 1)", "- 5)")
CAMEL = "list_filter(string_split_regex(regexp_replace(lower(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g'), ' +'), lambda w: w <> '')"
PTERMS = f"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({SEG6}, '\\.[^.]+$', ''), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[/\\\\\\-_. ]+'), lambda t: length(t) > 2)"
PHIT = "list_filter(['journal', 'snapshot', 'capsule', 'retry'], lambda q: len(list_filter(t, lambda p: p = q or (length(q) >= 8 and contains(p, q)) or (length(p) >= 8 and contains(q, p)))) > 0)"
AT = "list_filter(range(1, length(t) + 1), lambda i: substring(t, i, {n}) = '{w}')"
PIECES = "list_concat(list_transform(string_split_regex({0}, '[^A-Za-z0-9]+'), lambda w: lower(w)), " + SPLIT.replace("regexp_replace(name", "regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g')") + ")"
PLAIN = "regexp_replace(regexp_replace(replace({0}, '\\', '/'), '/+', '/', 'g'), '^(\\./)+', '')"
SQL = {
    "point_lookups": f"select case when id between 10 and 14 then 'id' when name in ('handle', 'drainRetry') then 'name' when parent_symbol_id between 20 and 30 then 'parent' else 'qualified' end as \"by\", kind, count(*) n, count(distinct body_hash) bodies from {S} where name in ('handle', 'drainRetry') or id between 10 and 14 or parent_symbol_id between 20 and 30 or qualified_name like '%.rotate' group by all",
    "idf_wildcards": " union all ".join(f"select '{t}' term, count(distinct file_id) files, round(ln((select count(*) from files) / (1 + count(distinct file_id))), 6) idf from symbols where lower(name) like '%{t}%'" for t in TERMS),
    "suffix_lookup": f"select suffix, path, id from (select *, row_number() over (partition by suffix order by path <> suffix, length(path), path) r from (select id, path, {SEG2} suffix from files)) where r = 1",
    "within_path": "select base, count(*) files from files, (select unnest(" + words_sql(BASES) + ") base) where base = '' or path = base or starts_with(path, base || '/') group by 1",
    "safe_paths": "with n as (select count(*) n, count(*) filter (where length(path) * 200 <= 4096) s from files) select way, cast(case when way in ('plain', 'dots') then n when way = 'long' then s else 0 end as bigint) safe from n, (select unnest(['plain', 'up', 'absolute', 'drive', 'home', 'dots', 'long', 'empty']) way)",
    "path_flags": "select id, " + ", ".join(f"regexp_matches(lower(path), '{p}') as {n}" for n, p in P.FLAGS.items()) + " from files",
    "kind_weights": f"select kind, visibility, {case_sql('kind', P.RUNTIME_KINDS)} result, {case_sql('kind', P.PIVOT_KINDS)} as pivot, {case_sql('visibility', P.VISIBILITY)} seen, count(*) n from {S} group by all",
    "row_validation": f"select case when name is null or name = '' then 'name' when file_id is null then 'file' when kind not in {tuple(KINDS)} then 'kind' when visibility not in ('public', 'private', 'protected', 'internal') then 'visibility' when start_line < 1 or end_line < start_line then 'lines' when parent_symbol_id = 0 then 'parent' else 'fine' end state, count(*) n from {S} group by 1",
    "pivot_candidates": f"with f as (select id, path, case when lw < 1 then lw when regexp_matches(p, '{X.MORE}') then 1.15 else 1.0 end::double weight from (select *, {LESS_SQL} lw from (select *, lower(regexp_replace(path, '^[^/]+/', '')) p from files)) where not regexp_matches(lower(path), '{P.TYPE_PATH}')) select s.id, path, weight from {S} s join f on f.id = s.file_id where weight > 0.2",
    "note_lookups": f"with {N} select scope, count(*) notes, count(*) filter (where scope = 'memory-notes' and age_days > 7) expired, count(*) filter (where not (scope = 'memory-notes' and age_days > 7) and confidence >= 0.1) active, max(hit_count) hits from n group by 1",
    "edge_enrichment": f"select e.id, e.source_symbol_id, e.kind, t.name target, f.path from {E} e join {S} t on t.id = e.target_symbol_id join files f on f.id = t.file_id where e.source_symbol_id in (select id from {S} order by centrality desc, id limit 100)",
    "member_of": "select repo, language, count(*) n from files where repo in ('rookery', 'granary') group by all",
    "boost_recent": f"select id, round(centrality * case when file_id in (select id from files order by mtime desc, id limit 50) then 1.2 else 1.0 end, 9) score from {S}",
    "name_spread": "select lower(name) as name, count(distinct file_id) files, round(least(1.0, 5.0 / count(distinct file_id)), 6)::double factor from symbols group by 1 having count(distinct file_id) > 5",
    "exists_any": "select 'errors' what where exists (select 1 from files where error <> '') union all select 'loops' where exists (select 1 from edges where source_symbol_id = target_symbol_id) union all select 'purchases' where exists (select 1 from events where event_type = 'purchase')",
    "function_summary": "select file_id, array_to_string(n[1:3], ', ') || case when len(n) > 3 then ' +' || (len(n) - 3) || ' more' else '' end summary from (select file_id, list_sort(list(distinct name)) n from symbols where kind in ('function', 'method', 'arrow') group by 1)",
    "bootstrap_sync": "with w as (select distinct text from documents where length(text) > 0 and kind in ('readme', 'design_note')), h as (select distinct text from documents where length(text) > 0 and kind in ('memory_note', 'design_note')) select case when h.text is null then 'create' when w.text is null then 'archive' else 'keep' end as action, count(*) n from w full join h on w.text = h.text group by 1",
    "subset_names": f"select name from (select distinct name from symbols) where len(list_filter({SPLIT}, lambda w: not list_contains({words_sql('drain retry journal rotate session cache seal handle fetch'.split())}, w))) = 0",
    "central_of_name": f"select name, id from (select name, id, row_number() over (partition by name order by centrality desc, id) r from {S}) where r = 1",
    "first_matches": "select least(20, count(*)) n from files where contains(path, 'journal')",
    "overview_trim": "with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) pos from documents where text is not null), u as (select *, cast(sum(cast(ceil(length(line) / 4) as bigint)) over (partition by doc_id order by pos) as bigint) used from l) select doc_id, count(*) as lines, max(used) tokens from u where used <= 200 group by 1",
    "path_words": f"with p as (select id, {PTERMS} t from files), h as (select *, {PHIT} f from p) select id, array_to_string(t, ' ') terms, len(f) >= 2 or len(list_filter(f, lambda q: length(q) >= 6)) > 0 as matches from h",
    "request_paths": f"""with u as (select unnest(regexp_extract_all(text, '[a-z]+://[^\\s"''`<>)]+')) url from {C}) select regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '^[a-zA-Z]+://[^/]+', ''), '[?#].*$', ''), '\\$\\{{[^}}]+\\}}', '__dynamic__', 'g'), '/+', '/', 'g') path, count(*) n from u group by 1""",
    "lanes": "with h as (select f.id, l.p, l.layer, l.w, row_number() over (partition by f.id order by length(l.p) desc) r, max(l.w) over (partition by f.id) m from files f join (values " + ", ".join(f"('{p}', '{y}', {w})" for p, y, w in LANES) + ") l(p, layer, w) on starts_with(regexp_replace(f.path, '^[^/]+/', ''), l.p)) select f.id, coalesce(1 + m, 1)::double weight, layer from files f left join h on h.id = f.id and r = 1",
    "word_matches": f"with w as (select distinct word from (select unnest({CAMEL.format('name')}) word from symbols)), x as (select word, term from w, (select unnest(['journaling', 'retry', 'cached', 'snap']) term)), y as (select *, contains(word, term) or contains(term, word) c from x) select word, term, c or (length(word) >= 4 and length(term) >= 4 and word[1:4] = term[1:4]) covers, c or word[1:least(5, length(word), length(term))] = term[1:least(5, length(word), length(term))] stem from y where c or (length(word) >= 4 and length(term) >= 4 and word[1:4] = term[1:4]) or word[1:least(5, length(word), length(term))] = term[1:least(5, length(word), length(term))]",
    "near_words": f"with t as (select s.id, lower({SEG6.replace('path', 'f.path')} || ' ' || s.name || ' ' || s.signature) t from {S} s join files f on f.id = s.file_id), p as (select id, {AT.format(n=7, w='journal')} a, {AT.format(n=5, w='drain')} b from t where contains(t, 'journal') and contains(t, 'drain')) select id from p where len(list_filter(a, lambda i: len(list_filter(b, lambda j: case when j >= i then j - i - 7 else i - j - 5 end <= 50)) > 0)) > 0",
    "recency_bonus": f"with {N} select case when age_days - 300 <= 1 then 0.01 when age_days - 300 <= 7 then 0.005 else 0 end::double bonus, count(*) n from n where age_days is not null group by 1",
    "json_lists": "select id, case when id % 7 < 2 then 0 else len(scope_chain) end n from (select distinct id, scope_chain from chunks)",
    "formats": "with x as (select *, cast(length(path) as bigint) * symbol_count * 997 z from files) select id, case when z < 1024 then z || ' B' when z < 1048576 then printf('%.1f', z / 1024.0) || ' KB' else printf('%.1f', z / 1048576.0) || ' MB' end as size, strftime(epoch_ms(mtime), '%Y-%m-%d') as day, cast(floor((symbol_count % 100) / 99 * 100 + 0.5) as bigint) || '%' as share from x",
    "summary_text": f"with w as (select file_id, unnest(list_concat({PIECES.format('name')}, {PIECES.format('signature')}, [lower(kind)])) w from symbols union all select id, unnest({PIECES.format(SEG6)}) from files), u as (select distinct file_id, w from w where length(w) >= 2) select file_id, count(*) n, sha256(array_to_string(list_sort(list(w)), ' ')) words from u group by 1",
    "relative_paths": f"with o as (select id, case when id % 3 = 0 then '/work//' || replace(path, '/', '\\') when id % 3 = 1 then './' || path else '/elsewhere/' || path end p from files), n as (select id, {PLAIN.format('p')} p from o) select id, case when starts_with(p, '/work/') then p[7:] else p end path from n",
    "match_lines": f"select id, start_line + length(b) - length(replace(b, chr(10), '')) as line from (select id, start_line, substring(full_source, 1, instr(full_source, 'return') - 1) b from {S} where instr(full_source, 'return') > 0)",
    "budget_fit": f"select file_id, count(*) filter (where ceil(length(text) / 3.5) <= 300 - chunk_index * 20) fit, count(*) n from {C} group by 1",
    "plain_markdown": "select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '`([^`]*)`', '\\1', 'g'), '[*_]{1,2}([^*_]+)[*_]{1,2}', '\\1', 'g')) hash from documents where text is not null",
    "camel_names": f"select name, array_to_string({CAMEL.format('name')}, ' ') words from (select distinct name from symbols)",
}
