"""Symbols as text at four levels of detail, in column expressions.

Level 0 is the source, cut to head and tail where it would take more than ``cap`` tokens; level 1 a header and up to a hundred lines; level 2 kind,
name, signature and dependencies; level 3 one line. Tokens are estimated at 3.5 characters. Null parts read as empty; a null source has no lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as X

#: Tokens of a full rendering, the share of them its head may take, lines of the tail, and visible lines at level 1 with those of the head.
CAP, HEAD_SHARE, TAIL, LINES, HEAD_LINES, MOST_DEPS, MOST_NAMES = 600, 0.7, 3, 100, 60, 5, 8


def _c(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def joined(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def head_lines(lines: Column, used: Column, limit: float) -> Column:
    """How many lines behind the first one fit before the tail: the first that goes beyond the limit ends it."""
    middle = F.slice(lines, 2, F.greatest(F.size(lines) - TAIL - 1, F.lit(0)))
    start = F.struct(used.cast("bigint").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(s: Column, line: Column) -> Column:
        fits = s["on"] & (s["used"] + X.estimate_tokens(line) <= limit)
        return F.struct((s["used"] + F.when(fits, X.estimate_tokens(line)).otherwise(0)).alias("used"), (s["n"] + fits.cast("int")).alias("n"), fits.alias("on"))

    return F.aggregate(middle, start, step)["n"]


def level0(cap: int = CAP) -> Column:
    """Of columns path, name, start_line, end_line and full_source."""
    header = F.concat(F.lit("// "), _c("path"), F.lit(":"), _c("start_line"), F.lit("-"), _c("end_line"))
    full = joined(header, _c("full_source"))
    lines = F.split(_c("full_source"), "\n")
    tail = F.slice(lines, F.greatest(F.size(lines) - TAIL + 1, F.lit(1)), F.lit(TAIL))
    note = F.concat(F.lit("// ... cut; read "), _c("name"), F.lit(" for the full source"))
    used = X.estimate_tokens(joined(header, F.get(lines, F.lit(0)), note, F.array_join(tail, "\n")))
    heads = 1 + head_lines(lines, used, cap * HEAD_SHARE)
    omitted = F.size(lines) - heads - F.size(tail)
    cut = joined(header, F.array_join(F.slice(lines, F.lit(1), heads), "\n"), F.concat(F.lit("// ... "), omitted.cast("string"), F.lit(" more lines; read "), _c("name"), F.lit(" for the full source")), F.array_join(tail, "\n"))
    return F.when((X.estimate_tokens(full) <= cap) | (omitted <= 0), full).otherwise(cut)


def level1() -> Column:
    """Of columns path, name, kind, signature, is_exported, start_line and full_source."""
    header = F.concat(F.lit("// "), _c("path"), F.lit(":"), _c("start_line"), F.lit(" ["), _c("kind"), F.lit("] "), F.when(F.col("is_exported"), "export ").otherwise(""), _c("signature"))
    lines = F.split(_c("full_source"), "\n")
    omitted = F.size(lines) - LINES
    cut = joined(header, F.array_join(F.slice(lines, 1, HEAD_LINES), "\n"), F.concat(F.lit("// ... "), omitted.cast("string"), F.lit(" lines omitted; read "), _c("name"), F.lit(" for the full source")), F.array_join(F.slice(lines, HEAD_LINES - LINES, LINES - HEAD_LINES), "\n"))
    return F.when(omitted > 0, cut).otherwise(joined(header, _c("full_source")))


def level2(deps: Column | None = None) -> Column:
    """Of columns path, name, kind, signature and start_line; ``deps`` are names of what the symbol depends on, of which five are told."""
    first = F.concat(F.lit("["), _c("kind"), F.lit("] "), _c("name"), F.lit(" ("), _c("path"), F.lit(":"), _c("start_line"), F.lit(")"))
    second = F.concat(F.lit("sig: "), _c("signature"))
    if deps is None:
        return joined(first, second)
    more = F.when(F.size(deps) > MOST_DEPS, F.concat(F.lit(", +"), (F.size(deps) - MOST_DEPS).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.size(deps) > 0, joined(first, second, F.concat(F.lit("deps: "), F.array_join(F.slice(deps, 1, MOST_DEPS), ", "), more))).otherwise(joined(first, second))


def level3() -> Column:
    return F.concat(_c("kind"), F.lit(" "), _c("name"), F.lit(" @ "), _c("path"), F.lit(":"), _c("start_line"))


def tokens_of_levels(deps: Column | None = None) -> Column:
    """An array of the tokens of each level."""
    return F.array(*[F.greatest(F.lit(1), X.estimate_tokens(c)).cast("bigint") for c in (level0(), level1(), level2(deps), level3())])


def file_line(path: Column, names: Column) -> Column:
    """One line about a file: how many symbols, and eight of their names."""
    more = F.when(F.size(names) > MOST_NAMES, F.concat(F.lit(", +"), (F.size(names) - MOST_NAMES).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.lit("[file] "), path, F.lit(": "), F.size(names).cast("string"), F.lit(" symbols ("), F.array_join(F.slice(names, 1, MOST_NAMES), ", "), more, F.lit(")"))
