"""Reading the engine's tables from a directory of Parquet files, and other sources and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def once(df: DataFrame, *columns: str) -> DataFrame:
    """The given columns with each id once: exact duplicates of a row count once."""
    return df.select("id", *columns).dropDuplicates(["id"])


def scan_tree(spark: SparkSession, root: str, glob: str = "*", most_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """Files below ``root``: path, mtime (epoch ms), size, content hash; larger ones and ignored directories are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = rows.filter(F.col("length") <= most_bytes)
    below = F.element_at(F.split("path", "^.*?" + re.escape(root.rstrip("/")) + "/", 2), -1)
    return rows.filter(~ignored(below)).select("path", F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


#: Directories that are never indexed, and paths that hold secrets.
IGNORED = "node_modules dist build .git .next coverage __pycache__ .mypy_cache .turbo .cache venv .venv target .tox vendor .bundle .worktrees __fixtures__ __snapshots__".split()
SECRET_PATHS = r"(?i)(^|/)\.env(\.[^/]*)?$|(^|/)credentials\.json$|(^|/)secrets?/|\.(pem|key)$"
#: Languages by extension.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "jsx", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".hh": "cpp", ".cs": "csharp", ".rb": "ruby", ".rake": "ruby", ".sh": "bash", ".bash": "bash", ".php": "php",
    ".md": "markdown", ".markdown": "markdown", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".ini": "ini",
}


def ignored(path) -> F.Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(d) for d in IGNORED])) | F.exists(parts, lambda p: p.rlike(r"^(\.qa-temp-|\.git-worktree)")) | path.rlike(SECRET_PATHS)


def language_of(path) -> F.Column:
    pairs = [F.lit(x) for item in LANGUAGES.items() for x in item]
    return F.create_map(*pairs)[F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))]


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, and the old ones whose keys are not among them."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows, and of the new ones those with keys that are not there, each once."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"))


def replace_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` replaced."""
    return upsert(old, new, [key])


def git_log(lines: DataFrame) -> DataFrame:
    """(hash, author, timestamp, message, files_changed) from rows (source, line_no, line) of a log with name status.

    A header line reads ``commit<TAB>hash<TAB>author<TAB>epoch seconds<TAB>message``; others ``status<TAB>path``. Logs are split by ``source``.
    """
    order = Window.partitionBy("source").orderBy("line_no")
    head = F.col("line").startswith("commit\t")
    rows = lines.withColumn("commit_no", F.sum(head.cast("int")).over(order)).withColumn("parts", F.split("line", "\t"))
    heads = rows.filter(head).select("source", "commit_no", F.col("parts")[1].alias("hash"), F.col("parts")[2].alias("author"), (F.col("parts")[3].cast("bigint") * 1000).alias("timestamp"), F.col("parts")[4].alias("message"))
    files = rows.filter(~head & (F.size("parts") >= 2)).groupBy("source", "commit_no").agg(F.array_sort(F.collect_set(F.element_at("parts", -1))).alias("files_changed"))
    return heads.join(files, ["source", "commit_no"], "left").select("hash", "author", "timestamp", "message", F.coalesce("files_changed", F.array().cast("array<string>")).alias("files_changed"))


def export_graph(nodes: DataFrame, edges: DataFrame, form: str = "dot") -> DataFrame:
    """One line per node and edge (part, line) in DOT, GraphML or JSON; only edges between the given nodes."""
    from tessera.functions.text import escape_xml

    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    quoted = F.replace(F.replace("name", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    if form == "dot":
        a = F.concat(F.lit('  n'), F.col("id").cast("string"), F.lit(' [label="'), quoted, F.lit('"];'))
        b = F.concat(F.lit("  n"), F.col("source").cast("string"), F.lit(" -> n"), F.col("target").cast("string"), F.lit(' [label="'), F.col("kind"), F.lit('"];'))
    elif form == "graphml":
        a = F.concat(F.lit('<node id="n'), F.col("id").cast("string"), F.lit('"><data key="name">'), escape_xml(F.col("name")), F.lit("</data></node>"))
        b = F.concat(F.lit('<edge source="n'), F.col("source").cast("string"), F.lit('" target="n'), F.col("target").cast("string"), F.lit('"><data key="kind">'), F.col("kind"), F.lit("</data></edge>"))
    else:
        a, b = F.to_json(F.struct("id", "name")), F.to_json(F.struct("source", "target", "kind"))
    return nodes.select(F.lit("node").alias("part"), a.alias("line")).unionByName(kept.select(F.lit("edge").alias("part"), b.alias("line")))
