"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text is cut into atomic segments: its lines, and, where a line alone is too large, clauses and words of it, and
at last runs of characters. Each boundary between neighbouring segments has a strength (a blank line before a
new outer block is strong, a space inside a line weak). The pairs of neighbours wait in a heap; the weakest boundary is
removed first, of equal ones the one whose sides are smaller together, as long as the merged segment plus the
overlap stays within the limit. What is left when no pair fits any more are the pieces. Each piece but the first is
led by the overlap: the end of the text before it, cut at a line or word start where one lies within it.

Sizes follow the estimate of one token per 3.5 characters (code points), rounded up.

Defined results: null and empty texts have no pieces; a text within the limit is one piece without overlap; a
repeated row gives repeated pieces. Line breaks are LF, CRLF or CR; a CRLF is never cut. Pieces without
their overlaps, put together, are the text, character by character. A limit too small for overlap and one character is an error.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import table

LIMIT_TOKENS = 512
OVERLAP_TOKENS = 48
LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+")
#: Places inside a line where it may be cut, strongest first.
INNER = [re.compile(r"(?<=[.!?;。！？；])\s*"), re.compile(r"(?<=[,:，、：)\]}])\s*"), re.compile(r"(?<=\s)(?=\S)")]


def chars(tokens: int) -> int:
    """The most characters that the estimate counts as ``tokens``."""
    return tokens * 7 // 2


def tokens(n_chars: int) -> int:
    return -(-n_chars * 2 // 7)


def atoms(line: str, room: int, level: int = 0) -> list[tuple[str, int]]:
    """Parts of a too long line with the strength of the boundary before each; parts are at most ``room`` long."""
    if len(line) <= room:
        return [(line, 3 - level)]
    if level == len(INNER):
        cuts, at = [], 0
        while at < len(line):
            end = min(at + room, len(line))
            if end < len(line) and room > 1 and line[end - 1 : end + 1] == "\r\n":
                end -= 1
            cuts.append((line[at:end], 0))
            at = end
        return cuts
    out: list[tuple[str, int]] = []
    ends = [m.end() for m in INNER[level].finditer(line) if 0 < m.end() < len(line)]
    for a, b in zip([0, *ends], [*ends, len(line)], strict=True):
        if a == b:
            continue
        parts = atoms(line[a:b], room, level + 1)
        out.append((parts[0][0], 3 - level))
        out.extend(parts[1:])
    return out


def strength(before: str, after: str, indent_before: int, indent_after: int) -> int:
    """How natural a cut between two lines is: larger is better."""
    score = 10
    if not before.strip():
        score += 40 - min(indent_after, 20)
    elif not after.strip():
        return 6  # blank lines stay with what is before them
    opening = before.rstrip()[-1:]
    if opening and opening in "([{:,":
        score -= 6
    if after.lstrip()[:1] in ("}", ")", "]"):
        score -= 7
    elif indent_after < indent_before:
        score += 8
    elif indent_after > indent_before:
        score -= 4
    if before.strip()[:1] in ("}", ")", "]") and indent_after <= indent_before:
        score += 12
    if before.lstrip()[:2] in ("//", "/*", "* ", "*/", "# ", "@") and after.strip():
        score -= 6
    return max(4, score)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start of the overlap, start, end) of each piece of ``text``, in characters."""
    if len(text) <= limit:
        return [(0, 0, len(text))] if text else []
    room = limit - overlap
    if room < 1 or overlap < 0:
        raise ValueError("the limit leaves no room beside the overlap")
    lines = LINE.findall(text)
    starts, strengths, at = [], [], 0
    before, before_indent = "", 0
    for line in lines:
        body = line.rstrip("\r\n")
        indent = len(body) - len(body.lstrip())
        if not body.strip():
            indent = before_indent
        for k, (part, inner) in enumerate(atoms(line, room)):
            starts.append(at)
            strengths.append(strength(before, body, before_indent, indent) if not k else inner)
            at += len(part)
        before, before_indent = body, indent
    n = len(starts)
    ends = [*starts[1:], at]
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(strengths[j], ends[j] - starts[j - 1], j, starts[j - 1], ends[j]) for j in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, size, j, a, b = heapq.heappop(heap)
        if not alive[j]:
            continue
        i = previous[j]
        if starts[i] != a or ends[j] != b:  # one of the sides has grown since
            heapq.heappush(heap, (strengths[j], ends[j] - starts[i], j, starts[i], ends[j]))
            continue
        if size > room:
            continue  # sides only grow, so this pair never fits again
        ends[i], alive[j] = ends[j], False
        following[i] = following[j]
        if following[j] < n:
            previous[following[j]] = i
    out = []
    for i in range(n):
        if alive[i]:
            out.append((lead(text, starts[i], overlap) if i else 0, starts[i], ends[i]))
    return out


def lead(text: str, start: int, overlap: int) -> int:
    """Where the overlap before ``start`` begins: the first line start within it, else the first word start."""
    low = max(0, start - overlap)
    if low == 0 or not overlap:
        return low
    window = text[low - 1 : start]
    for pattern in (r"(?:\r\n|\n|\r(?!\n))(?=[^\r\n]*\S)", r"\s(?=\S)"):
        m = re.search(pattern, window)
        if m and low - 1 + m.end() < start:
            return low - 1 + m.end()
    return low + 1 if text[low - 1 : low + 1] == "\r\n" else low


def lines_before(text: str, at: int) -> int:
    return len(re.findall(r"\r\n|\n|\r", text[:at]))


SCHEMA = "piece_index int, start_line bigint, end_line bigint, start_char bigint, end_char bigint, overlap_chars bigint, token_count bigint, text string"


def split_texts(df: DataFrame, key_cols: list[str], text_col: str = "text", limit_tokens: int = LIMIT_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """The pieces of each text: ``key_cols`` and piece_index, start_line, end_line, start_char, end_char, overlap_chars, token_count, text.

    Lines count from 1 within the text and, as start_char (0-based) and end_char (exclusive), cover the piece with its overlap. Texts
    within the limit never leave the JVM.
    """
    limit, overlap = chars(limit_tokens), chars(overlap_tokens)
    source = df.select(*key_cols, F.col(text_col).alias("__text"))
    size = F.length("__text")
    breaks = F.regexp_count(F.regexp_replace("__text", "(\r\n|\n|\r)$", ""), F.lit("\r\n|\n|\r"))
    whole = source.filter((size > 0) & (size <= limit)).select(
        *key_cols, F.lit(0).alias("piece_index"), F.lit(1).cast("bigint").alias("start_line"), (breaks + 1).cast("bigint").alias("end_line"),
        F.lit(0).cast("bigint").alias("start_char"), size.cast("bigint").alias("end_char"), F.lit(0).cast("bigint").alias("overlap_chars"),
        F.ceil(size * 2 / 7).cast("bigint").alias("token_count"), F.col("__text").alias("text"),
    )
    large = source.filter(size > limit)
    return whole.unionByName(split_large(large, key_cols, limit, overlap))


def split_large(large: DataFrame, key_cols: list[str], limit: int, overlap: int) -> DataFrame:
    """The pieces of the texts in ``__text``, all beyond ``limit`` characters."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key in batch.itertuples(index=False, name=None):
                text = key[-1]
                line, counted = 1, 0
                for k, (a, b, c) in enumerate(pieces(text, limit, overlap)):
                    line += lines_before(text[counted:a], a - counted) if a >= counted else -lines_before(text[a:counted], counted - a)
                    counted = a
                    body = text[a:c]
                    inner = re.sub(r"(?:\r\n|\n|\r)$", "", body)
                    last = line + lines_before(inner, len(inner))
                    rows.append((*key[:-1], k, line, last, a, c, b - a, tokens(c - a), body))
            yield pd.DataFrame(rows, columns=[*key_cols, *NAMES])

    kinds = dict(large.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in key_cols) + ", " + SCHEMA
    return large.mapInPandas(cut, schema)


NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def first_lines(chunks: DataFrame, block: int = 4096) -> DataFrame:
    """(id, first_line) of each chunk: its first line in the file, counted from the texts before it.

    The running sum has two levels, so a file with very many chunks is spread over tasks.
    """
    rows = chunks.select("id", "file_id", "chunk_index", (F.regexp_count("text", F.lit("\r\n|\n|\r")) + 1).cast("bigint").alias("n")).dropDuplicates(["id"])
    rows = rows.withColumn("block", F.floor(F.col("chunk_index") / block))
    blocks = rows.groupBy("file_id", "block").agg(F.sum("n").alias("sum"))
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    inside = Window.partitionBy("file_id", "block").orderBy("chunk_index", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return rows.join(blocks, ["file_id", "block"]).select("id", (F.col("base") + F.col("inner") + 1).cast("bigint").alias("first_line"))


def p1_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """The pieces of the oversized chunks, with lines of the file as the texts themselves give them."""
    chunks = table(spark, directory, "chunks")
    limit, overlap = chars(LIMIT_TOKENS), chars(OVERLAP_TOKENS)
    large = chunks.filter(F.length("text") > limit).select("id", F.col("text").alias("__text")).dropDuplicates(["id"])
    cut = split_large(large, ["id"], limit, overlap)
    out = cut.join(first_lines(chunks), "id", "left")
    for c in ("start_line", "end_line"):
        out = out.withColumn(c, F.col(c) + F.col("first_line") - 1)
    return out.withColumnRenamed("id", "chunk_id").drop("first_line")


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """The ids of the chunks that the splitter cuts into more than one piece."""
    chunks = table(spark, directory, "chunks").filter(F.length("text") > chars(LIMIT_TOKENS)).select("id", F.col("text").alias("__text"))
    cut = split_large(chunks, ["id"], chars(LIMIT_TOKENS), chars(OVERLAP_TOKENS))
    return cut.filter("piece_index > 0").select(F.col("id").alias("chunk_id")).distinct()


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
SQL = {"p1_found": "select distinct id chunk_id from chunks where length(text) > 1792"}
