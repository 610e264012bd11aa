"""What an indexer does with files: ignore rules, documents as symbols, sections, imports to files, sinks, and what is left to do."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans.relational import C, chunks, files, symbols
from tessera.plans.retrieval import IDENT, ORDERED
from tessera.sources import tables as T
from tessera.sources.tables import table

IGNORE = ["*.json", "tests/", "tools", "!*/keep_*.json", "/packages/core/*/window", "src/**/cache", "*-?-*.ts", "!tools/retry"]
ALIASES = [("@core/", "packages/core/"), ("~/", "src/"), ("@/", "src/lib/")]
MARKERS = [("package.json", "node"), ("tsconfig.json", "typescript"), ("go.mod", "go"), ("Cargo.toml", "rust"), ("pyproject.toml", "python"), ("pom.xml", "java")]


def rule_pattern(rule: str) -> str:
    """A rule of an ignore file as an expression on a path below the root: a name stands anywhere, a rule with a slash from the root on.

    ``*`` and ``?`` stay within a segment, ``**`` does not; a rule that ends with a slash is about directories only.
    """
    only_dirs, rule = rule.endswith("/"), rule.strip("/") if rule.strip("/") else rule
    body = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part)) for part in re.split(r"(\*\*|\*|\?)", rule) if part)
    start = "^" if "/" in rule else "(?:^|/)"
    return f"{start}{body}/" if only_dirs else f"{start}{body}(?:/|$)"


def ignored_by(path: Column, rules: list[str]) -> Column:
    """The last rule that fits decides; a rule that begins with ! takes a path back in."""
    out = F.lit(False)
    for rule in rules:
        out = F.when(path.rlike(rule_pattern(rule.removeprefix("!"))), not rule.startswith("!")).otherwise(out)
    return out


def ignore_rules(s, d):
    below = F.regexp_replace("path", "^[^/]+/", "")
    return files(s, d, "path", "repo").groupBy("repo").agg(F.sum(ignored_by(below, IGNORE).cast("bigint")).alias("ignored"), F.count(F.lit(1)).alias("files"))


def built_in_ignores(s, d):
    """Files that lie in a directory that is never indexed, or hold secrets; and their language by extension."""
    p = F.col("path")
    odd = F.when(F.col("id") % 5 == 0, F.concat(F.lit("a/.tox/"), p)).when(F.col("id") % 5 == 1, F.concat(p, F.lit(".pem"))).when(F.col("id") % 5 == 2, F.concat(F.lit("x/node_modules/y/"), p)).when(F.col("id") % 5 == 3, F.regexp_replace(p, r"\.[^.]*$", ".tsx")).otherwise(p)
    rows = files(s, d, "path").select("id", odd.alias("path"))
    return rows.select("id", T.ignored(F.col("path")).alias("ignored"), T.language_of(F.col("path")).alias("language"))


def multi_root(s, d):
    """Several roots as one tree: each labelled, paths below their own root; the same path in two roots is two files."""
    f = files(s, d, "path", "repo", "symbol_count")
    roots = ["rookery", "granary", "saltmarsh", "nowhere"]
    union = None
    for root in roots:
        part = f.filter(F.col("repo") == root).select(F.lit(root).alias("root"), F.regexp_replace("path", "^[^/]+/", "").alias("path"), "symbol_count")
        union = part if union is None else union.unionByName(part)
    return union.groupBy("root", X.extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum("symbol_count").alias("symbols"))


def document_symbols(s, d):
    """A document as one symbol: named by its first ten words, with a signature of twenty-four, its lines, and its text cut at 6,000 characters."""
    rows = table(s, d, "documents").filter("text is not null and length(trim(text)) > 0").select("doc_id", "text")
    clean = F.regexp_replace(F.regexp_replace("text", "[`\"'()\\[\\]{}:,]", " "), r"\s+", " ")
    words = X.split_identifier(clean)
    rows = rows.withColumn("words", words)
    cut = F.when(F.length("text") > 6000, F.concat(F.substring("text", 1, 6000), F.lit("\n..."))).otherwise(F.col("text"))
    return rows.select("doc_id", F.array_join(F.slice("words", 1, 10), " ").alias("name"), F.array_join(F.slice("words", 1, 24), " ").alias("signature"), F.size(F.split("text", "\n")).cast("bigint").alias("lines"), F.length(cut).cast("bigint").alias("chars"))


def document_sections(s, d):
    """Sections of documents by heading outside fences, headings without marks; a document without a heading is one section named by nothing."""
    lines = table(s, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    lines = lines.withColumn("fences", F.sum(F.col("line").rlike(r"^\s*(?:```|~~~)").cast("int")).over(w))
    head = F.col("line").rlike(r"^#{1,6}\s+\S") & (F.col("fences") % 2 == 0)
    lines = lines.withColumn("head", head).withColumn("section", F.sum(head.cast("int")).over(w))
    name = F.trim(X.plain_markdown(F.regexp_replace(F.regexp_replace("line", r"^#{1,6}\s+", ""), r"\s*#*\s*$", "")))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    return lines.groupBy("doc_id", "section").agg(F.coalesce(F.max(F.when(F.col("head"), name)), F.lit("")).alias("heading"), F.coalesce(F.max(F.when(F.col("head"), level)), F.lit(0)).cast("bigint").alias("level"), (F.min("pos") + 1).cast("bigint").alias("first_line"), (F.max("pos") + 1).cast("bigint").alias("last_line"))


def alias_imports(s, d):
    """Import specifiers through path aliases to candidate files: the first alias that fits decides; relative ones have none; others start at the base."""
    f = files(s, d, "path", "repo").filter("path like '%.ts' or path like '%.js'").withColumn("below", F.regexp_replace("path", "^[^/]+/", ""))
    spec = F.regexp_replace("below", r"\.[^.]+$", "")
    made = F.when(F.startswith("below", F.lit("packages/core/")), F.concat(F.lit("@core/"), F.regexp_replace(spec, "^packages/core/", ""))).when(F.startswith("below", F.lit("src/")), F.concat(F.lit("~/"), F.regexp_replace(spec, "^src/", ""))).when(F.col("id") % 2 == 0, F.concat(F.lit("./"), spec)).otherwise(spec)
    asks = f.select("id", "repo", made.alias("spec"))
    base = F.when(F.col("spec").rlike(r"^[./]"), F.lit(None))
    for prefix, target in ALIASES:
        base = base.when(F.startswith("spec", F.lit(prefix)), F.concat(F.lit(target), F.col("spec").substr(len(prefix) + 1, 10_000)))
    asks = asks.withColumn("base", base.otherwise(F.col("spec"))).filter("base is not null")
    asks = asks.select("id", "repo", "spec", F.explode(F.array(*[F.concat("base", F.lit(e)) for e in (".ts", ".js", "/index.ts")])).alias("below"))
    return asks.join(f.select("repo", "below", F.col("id").alias("target")), ["repo", "below"]).groupBy("id", "spec").agg(F.min("target").alias("target"))


def module_candidates(language: Column, spec: Column, directory: Column) -> Column:
    """Where a module may lie below the root, best first, by the language's rules; an empty array where the import is none of the repository's."""
    none = F.array().cast("array<string>")
    dots = F.replace(spec, F.lit("."), F.lit("/"))
    python = F.when(F.startswith(spec, F.lit(".")), F.array(F.concat(directory, F.lit("/"), F.regexp_replace(spec, r"^\.+", ""), F.lit(".py")), F.concat(directory, F.lit("/"), F.regexp_replace(spec, r"^\.+", ""), F.lit("/__init__.py")))).otherwise(F.flatten(F.transform(F.reverse(F.sequence(F.lit(1), F.size(F.split(spec, r"\.")))), lambda n: F.transform(F.array(F.lit(".py"), F.lit("/__init__.py")), lambda e: F.concat(F.array_join(F.slice(F.split(spec, r"\."), F.lit(1), n), "/"), e)))))
    java = F.when(spec.rlike(r"^(java|javax|android)\."), none).otherwise(F.transform(F.array(F.lit("src/main/java/"), F.lit("src/test/java/"), F.lit("src/"), F.lit("")), lambda r: F.concat(r, dots, F.lit(".java"))))
    parts = F.split(F.regexp_replace(spec, "^(crate|self|super)::", ""), "::")
    rust = F.array(F.concat(F.lit("src/"), F.array_join(parts, "/"), F.lit(".rs")), F.concat(F.lit("src/"), F.array_join(parts, "/"), F.lit("/mod.rs")), F.concat(F.lit("src/"), F.get(parts, F.lit(0)), F.lit(".rs")), F.concat(F.lit("src/"), F.get(parts, F.lit(0)), F.lit("/mod.rs")))
    name = F.regexp_replace(spec, "^[\"']|[\"']$", "")
    c = F.when(F.startswith(spec, F.lit("<")), none).otherwise(F.transform(F.array(F.concat(directory, F.lit("/")), F.lit(""), F.lit("include/"), F.lit("src/"), F.lit("lib/")), lambda r: F.concat(r, name)))
    ruby = F.when(name.rlike(r"^\.\.?/"), F.array(F.concat(directory, F.lit("/"), F.regexp_replace(name, r"^\./", ""), F.lit(".rb")))).otherwise(F.transform(F.array(F.lit("lib/"), F.lit("app/"), F.lit("")), lambda r: F.concat(r, name, F.lit(".rb"))))
    csharp = F.array(F.concat(dots, F.lit(".cs")), F.concat(F.lit("src/"), dots, F.lit(".cs")), F.concat(F.regexp_extract(spec, r"([^.]*)$", 1), F.lit(".cs")))
    php = F.array(F.concat(F.replace(spec, F.lit("\\"), F.lit("/")), F.lit(".php")))
    return F.when(language == "python", python).when(language == "java", java).when(language == "rust", rust).when(language.isin("c", "cpp"), c).when(language == "ruby", ruby).when(language == "csharp", csharp).when(language == "php", php).otherwise(none)


SPECS = [(1, "python", "lease.ledger", "lease"), (2, "python", ".mirror", "signal"), (3, "python", "os", "a"), (4, "python", "lease.ledger.Part.x", "q"), (5, "java", "shard.session.PacketReplica", "a"), (6, "java", "java.util.List", "a"), (7, "rust", "crate::route::pivot", "a"), (8, "rust", "self::journal", "a"), (9, "c", '"lease.h"', "inc"), (10, "c", "<stdio.h>", "inc"), (11, "ruby", "./seal", "lib/a"), (12, "csharp", "App.Core.Lease", "a"), (13, "php", "App\\Lease", "a"), (14, "go", "x/y", "a")]
TREE = ["lease/ledger.py", "signal/mirror.py", "src/main/java/shard/session/PacketReplica.java", "src/route/pivot.rs", "src/journal/mod.rs", "include/lease.h", "lib/a/seal.rb", "Lease.cs", "App/Lease.php", "src/route.rs", "inc/lease.h"]


def module_files(s, d):
    """Import specifiers of eight languages and the first file of a tree that each may mean."""
    asks = s.createDataFrame(SPECS, "n int, language string, spec string, directory string")
    rows = asks.select("n", "language", F.posexplode(module_candidates(F.col("language"), F.col("spec"), F.col("directory"))).alias("place", "path"))
    hits = rows.join(s.createDataFrame([(p,) for p in TREE], "path string"), "path").groupBy("n").agg(F.min_by("path", "place").alias("path"))
    return asks.join(hits, "n", "left").select("n", "language", "path")


def module_imports(s, d):
    """Python and Java imports of chunks and the files of the same repository they reach by their last two segments, by language."""
    f = files(s, d, "path", "repo", "language")
    lines = table(s, d, "chunks").select("file_id", F.explode("import_context").alias("line")).distinct().join(f.select(F.col("id").alias("file_id"), "repo", "language"), "file_id")
    spec = F.when(F.col("language") == "python", F.regexp_extract("line", r"^(?:from|import) ([\w.]+)", 1)).when(F.col("language") == "java", F.regexp_extract("line", r"^import (?:static )?([\w.]+)", 1)).otherwise("")
    asks = lines.withColumn("spec", spec).filter("spec <> ''").select("file_id", "repo", "language", "spec").distinct()
    tail = F.array_join(F.slice(F.split("spec", r"\."), F.greatest(F.lit(1), F.size(F.split("spec", r"\.")) - 1), F.lit(2)), "/")
    known = f.select("repo", "language", F.regexp_replace(X.last_segments(F.col("path"), 2), r"\.[^.]+$", "").alias("tail")).distinct().withColumn("ok", F.lit(1))
    return asks.withColumn("tail", tail).join(known, ["repo", "language", "tail"], "left").groupBy("language").agg(F.count(F.lit(1)).alias("imports"), F.count("ok").alias("resolved"))


def sink_upsert(s, d):
    """Summaries upserted: rows of changed files replace the old ones, others stay."""
    f = files(s, d, "language", "symbol_count")
    old, new = f.filter("id % 3 <> 0").withColumn("v", F.lit(1)), f.filter("id % 2 = 0").withColumn("v", F.lit(2))
    return T.upsert(old, new, ["id"]).groupBy("language", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("symbol_count").alias("symbols"))


def sink_insert_or_ignore(s, d):
    e = table(s, d, "edges").select("source_symbol_id", "target_symbol_id", "kind", "id")
    out = T.insert_or_ignore(e.filter("id % 2 = 0").dropDuplicates(["source_symbol_id", "target_symbol_id", "kind"]), e, ["source_symbol_id", "target_symbol_id", "kind"])
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def sink_replace_partition(s, d):
    """All chunks of files that come again are replaced, also those that have fewer chunks now."""
    c = chunks(s, d, "file_id", "chunk_index")
    new = c.filter("file_id % 4 = 0 and chunk_index < 2").withColumn("v", F.lit(2))
    return T.replace_partition(c.withColumn("v", F.lit(1)), new, "file_id").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("files"))


def sink_remove_files(s, d):
    """What stays of each table when files go, with everything that hangs on them."""
    gone = files(s, d).filter("id % 7 = 0").select(F.col("id").alias("file_id"))
    kept = symbols(s, d, "file_id").join(gone, "file_id", "left_anti")
    ids = kept.select("id")
    edges_ = table(s, d, "edges").select("id", "source_symbol_id", "target_symbol_id").dropDuplicates(["id"])
    edges_ = edges_.join(ids.withColumnRenamed("id", "source_symbol_id"), "source_symbol_id", "left_semi").join(ids.withColumnRenamed("id", "target_symbol_id"), "target_symbol_id", "left_semi")
    parts = {"files": files(s, d).filter("id % 7 <> 0"), "symbols": kept, "chunks": chunks(s, d, "file_id").join(gone, "file_id", "left_anti"), "edges": edges_}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def sink_session_rows(s, d):
    """Rows of a session's answers: one for each symbol, and one of nulls for an answer without any."""
    e = table(s, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    ids = F.when(F.col("k") % 4 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.col("k") % 4))
    rows = e.filter("k is not null").select("event_id", "user_id", F.explode_outer(ids).alias("symbol"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.count("symbol").alias("symbols"))


def sink_vectors(s, d):
    """Vectors that may be stored: those as long as their model's usual, by model; and whether each chunk has one."""
    e = table(s, d, "chunk_embeddings").select("id", F.lower(F.regexp_replace("model_name", r"^\s+|\s+$", "")).alias("model"), F.size("embedding").alias("n"), "embedding").filter("embedding is not null").dropDuplicates(["id"])
    counts = e.groupBy("model", "n").agg(F.count(F.lit(1)).alias("c"))
    usual = counts.groupBy("model").agg(F.max(F.struct("c", "n")).alias("m")).select("model", F.col("m.n").alias("wanted"))
    return e.join(F.broadcast(usual), "model").groupBy("model").agg(F.sum((F.col("n") == F.col("wanted")).cast("bigint")).alias("stored"), F.sum((F.col("n") != F.col("wanted")).cast("bigint")).alias("refused"))


def structured_output(s, d):
    """Each file's summary as one JSON text."""
    return files(s, d, "path", "language", "symbol_count").select("id", F.to_json(F.struct("path", "language", "symbol_count")).alias("json"))


def index_plan(s, d):
    """What an index run does with each file: by time, then by content; whole, one directory, one file."""
    f = files(s, d, "path", "repo", "hash", "mtime", "last_indexed")
    twin = f.groupBy("hash").agg(F.min("id").alias("first"))
    rows = f.join(twin, "hash")
    state = F.when(F.col("mtime") <= F.col("last_indexed"), "same time").when(F.col("id") != F.col("first"), "same content").otherwise("read")
    scope = F.when(F.col("path").contains("/tests/"), "tests").otherwise("code")
    return rows.groupBy("repo", scope.alias("scope"), state.alias("action")).agg(F.count(F.lit(1)).alias("files"))


def backfill(s, d):
    """Files that lack what is derived from them: chunks, symbols, vectors."""
    f = files(s, d)
    c, y = table(s, d, "chunks").select(F.col("file_id").alias("id")).distinct(), table(s, d, "symbols").select(F.col("file_id").alias("id")).distinct()
    v = table(s, d, "chunk_embeddings").filter("embedding is not null").select(F.col("file_id").alias("id")).distinct()
    out = None
    for name, have in (("chunks", c), ("symbols", y), ("vectors", v)):
        part = f.join(have, "id", "left_anti").select("id", F.lit(name).alias("missing"))
        out = part if out is None else out.unionByName(part)
    return out


def marker_profile(s, d):
    """Kinds of projects by marker files and by the share of languages, with roots."""
    f = files(s, d, "path", "repo", "language")
    marks = F.array_compact(F.array(*[F.when(F.endswith("path", F.lit("/" + m)), k) for m, k in MARKERS], F.when(F.col("language").isin("typescript", "javascript"), "node").when(F.col("language").isin("go", "rust", "python", "java"), F.col("language"))))
    rows = f.select("repo", F.explode(marks).alias("kind")).groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"))
    total = f.groupBy("repo").agg(F.count(F.lit(1)).alias("total"))
    return rows.join(total, "repo").filter("n * 10 >= total").select("repo", "kind", "n")


QUERIES = {f.__name__: f for f in (ignore_rules, built_in_ignores, multi_root, document_symbols, document_sections, alias_imports, module_files, module_imports, sink_upsert, sink_insert_or_ignore, sink_replace_partition, sink_remove_files, sink_session_rows, sink_vectors, structured_output, index_plan, backfill, marker_profile)}

FOLD = "false"
for _rule in IGNORE:
    FOLD = "case when regexp_matches(p, '" + rule_pattern(_rule.removeprefix("!")) + f"') then {'false' if _rule.startswith('!') else 'true'} else {FOLD} end"
DOC = ORDERED.format(IDENT.replace("name", "t"))
TAILS = "array_to_string(list_slice(string_split(spec, '.'), greatest(1, len(string_split(spec, '.')) - 1), len(string_split(spec, '.'))), '/')"
DOCLINES = "string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))"
SQL = {
    "ignore_rules": f"select repo, count(*) filter (where {FOLD}) ignored, count(*) files from (select repo, regexp_replace(path, '^[^/]+/', '') p from files) group by 1",
    "built_in_ignores": "with o as (select id, case id % 5 when 0 then 'a/.tox/' || path when 1 then path || '.pem' when 2 then 'x/node_modules/y/' || path when 3 then regexp_replace(path, '\\.[^.]*$', '.tsx') else path end p from files), m as (select map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.LANGUAGES.items()) + "} m) select id, len(list_filter(string_split(p, '/'), lambda x: list_contains([" + ", ".join(f"'{x}'" for x in T.IGNORED) + "], x) or regexp_matches(x, '^(\\.qa-temp-|\\.git-worktree)'))) > 0 or regexp_matches(lower(p), '" + T.SECRET_PATHS.replace("(?i)", "") + "') as ignored, m[lower(regexp_extract(p, '(\\.[^./]+)$', 1))] as language from o, m",
    "multi_root": "select repo root, regexp_extract(path, '(\\.[^./]+)$', 1) extension, count(*) files, cast(sum(symbol_count) as bigint) symbols from files where repo in ('rookery', 'granary', 'saltmarsh') group by all",
    "document_symbols": f"with a as (select doc_id, text, regexp_replace(regexp_replace(text, '[`\"''()\\[\\]{{}}:,]', ' ', 'g'), '\\s+', ' ', 'g') t from documents where text is not null and length(trim(text)) > 0), b as (select *, {DOC} w from a) select doc_id, array_to_string(w[1:10], ' ') as name, array_to_string(w[1:24], ' ') as signature, len(string_split(text, chr(10))) as lines, case when length(text) > 6000 then 6004 else length(text) end chars from b",
    "document_sections": f"with l as (select doc_id, unnest({DOCLINES}) as line, generate_subscripts({DOCLINES}, 1) pos from documents where text is not null), f as (select *, sum(regexp_matches(line, '^\\s*(?:```|~~~)')::int) over (partition by doc_id order by pos) fences from l), h as (select *, regexp_matches(line, '^#{{1,6}}\\s+\\S') and fences % 2 = 0 head from f), x as (select *, cast(sum(head::int) over (partition by doc_id order by pos) as bigint) section, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^#{{1,6}}\\s+', ''), '\\s*#*\\s*$', ''), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '`([^`]*)`', '\\1', 'g'), '[*_]{{1,2}}([^*_]+)[*_]{{1,2}}', '\\1', 'g')) nm from h) select doc_id, section, coalesce(max(case when head then nm end), '') heading, coalesce(max(case when head then length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) end), 0)::bigint as level, min(pos) first_line, max(pos) last_line from x group by all",
    "alias_imports": "with f as (select id, repo, regexp_replace(path, '^[^/]+/', '') b from files where path like '%.ts' or path like '%.js'), a as (select id, repo, case when b like 'packages/core/%' then '@core/' || regexp_replace(regexp_replace(b, '\\.[^.]+$', ''), '^packages/core/', '') when b like 'src/%' then '~/' || regexp_replace(regexp_replace(b, '\\.[^.]+$', ''), '^src/', '') when id % 2 = 0 then './' || regexp_replace(b, '\\.[^.]+$', '') else regexp_replace(b, '\\.[^.]+$', '') end spec from f), c as (select *, case when spec like '.%' or spec like '/%' then null when spec like '@core/%' then 'packages/core/' || spec[7:] when spec like '~/%' then 'src/' || spec[3:] when spec like '@/%' then 'src/lib/' || spec[3:] else spec end base from a), e as (select *, base || unnest(['.ts', '.js', '/index.ts']) b from c where base is not null) select e.id, spec, min(f.id) target from e join f on f.repo = e.repo and f.b = e.b group by all",
    "module_files": "select * from (values (1, 'python', 'lease/ledger.py'), (2, 'python', 'signal/mirror.py'), (3, 'python', null), (4, 'python', 'lease/ledger.py'), (5, 'java', 'src/main/java/shard/session/PacketReplica.java'), (6, 'java', null), (7, 'rust', 'src/route/pivot.rs'), (8, 'rust', 'src/journal/mod.rs'), (9, 'c', 'inc/lease.h'), (10, 'c', null), (11, 'ruby', 'lib/a/seal.rb'), (12, 'csharp', 'Lease.cs'), (13, 'php', 'App/Lease.php'), (14, 'go', null)) t(n, language, path)",
    "module_imports": f"with l as (select distinct file_id, unnest(import_context) as line from chunks), a as (select distinct l.file_id, f.repo, f.language, case f.language when 'python' then regexp_extract(line, '^(?:from|import) ([\\w.]+)', 1) when 'java' then regexp_extract(line, '^import (?:static )?([\\w.]+)', 1) else '' end spec from l join files f on f.id = l.file_id), k as (select distinct repo, language, regexp_replace(array_to_string(list_slice(string_split(path, '/'), greatest(1, len(string_split(path, '/')) - 1), len(string_split(path, '/'))), '/'), '\\.[^.]+$', '') t from files) select a.language, count(*) imports, count(k.t) resolved from a left join k on k.repo = a.repo and k.language = a.language and k.t = {TAILS} where spec <> '' group by 1",
    "sink_upsert": "select language, case when id % 2 = 0 then 2 else 1 end v, count(*) n, cast(sum(symbol_count) as bigint) symbols from files where id % 2 = 0 or id % 3 <> 0 group by all",
    "sink_insert_or_ignore": "select kind, count(*) n from (select distinct source_symbol_id, target_symbol_id, kind from edges) group by 1",
    "sink_replace_partition": f"with c as (select *, file_id % 4 = 0 and file_id in (select file_id from chunks where chunk_index < 2) again from {C}) select case when again then 2 else 1 end v, count(*) n, count(distinct file_id) files from c where not again or chunk_index < 2 group by 1",
    "sink_remove_files": "with s as (select distinct id from symbols where file_id % 7 <> 0) select 'files' part, count(*) n from files where id % 7 <> 0 union all select 'symbols', count(*) from s union all select 'chunks', count(distinct id) from chunks where file_id % 7 <> 0 union all select 'edges', count(distinct id) from edges where source_symbol_id in (select id from s) and target_symbol_id in (select id from s)",
    "sink_session_rows": "with e as (select user_id, cast(json_extract_string(props, '$.k') as int) k from events) select user_id, cast(sum(greatest(1, k % 4)) as bigint) as rows, cast(sum(k % 4) as bigint) symbols from e where k is not null group by 1",
    "sink_vectors": "with e as (select distinct id, lower(regexp_replace(model_name, '^\\s+|\\s+$', '', 'g')) model, len(embedding) n from chunk_embeddings where embedding is not null), g as (select model, n, count(*) c from e group by all), u as (select *, row_number() over (partition by model order by c desc, n desc) r from g) select e.model, count(*) filter (where e.n = u.n) stored, count(*) filter (where e.n <> u.n) refused from e join u on u.model = e.model and u.r = 1 group by 1",
    "structured_output": "select id, '{\"path\":\"' || path || '\",\"language\":\"' || language || '\",\"symbol_count\":' || symbol_count || '}' as json from files",
    "index_plan": "with f as (select *, min(id) over (partition by hash) first from files) select repo, case when contains(path, '/tests/') then 'tests' else 'code' end scope, case when mtime <= last_indexed then 'same time' when id <> first then 'same content' else 'read' end as action, count(*) files from f group by all",
    "backfill": "select id, 'chunks' missing from files where id not in (select file_id from chunks) union all select id, 'symbols' from files where id not in (select file_id from symbols) union all select id, 'vectors' from files where id not in (select file_id from chunk_embeddings where embedding is not null)",
    "marker_profile": "with k as (select repo, case when language in ('typescript', 'javascript') then 'node' when language in ('go', 'rust', 'python', 'java') then language end kind from files), m as (select repo, kind from k where kind is not null union all select repo, m.k from files join (values " + ", ".join(f"('/{a}', '{b}')" for a, b in MARKERS) + ") m(f, k) on ends_with(path, m.f)), n as (select repo, kind, count(*) n from m group by all) select n.repo, kind, n from n join (select repo, count(*) total from files group by 1) t on t.repo = n.repo where n * 10 >= total",
}
