"""Column functions on identifiers, paths and texts; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that a query ignores.
STOPWORDS = "a an and are as at be by for from has in is it of on or that the to was were with this".split()
#: Weights of directories that count less, as expressions on the lower-case path.
LESS = [
    (r"(^|/)(legacy|archive|old|prototype)/", 0.15), (r"_(legacy|demo|old|prototype|archive)[_/]", 0.15), (r"(^|/)(vendor|third_party|external)/", 0.3), (r"(^|/)(examples|samples?|demo)/", 0.2), (r"(^|/)(tests?|__tests?__|spec)/", 0.6),
    (r"(^|/)(docs?|documentation)/", 0.4), (r"(^|/)(scripts?|bin)/", 0.5), (r"(^|/)(mocks?|stubs?|fakes?|fixtures?)/", 0.4), (r"(^|/)(migrations?|seeds?)/", 0.5), (r"^src/main/resources/static(/|$)", 0.2),
    (r"^(assets|public)(/|$)", 0.3), (r"^(dist|build|out|\.next)(/|$)", 0.1),
]
#: Fixed value: prefixes of directories that count more, and their weight.
MORE, MORE_WEIGHT = r"^(src/main/java|src/app|src/lib|src/core|packages|libs)(/|$)", 1.15
#: Test files.
TEST_PATH = r"(?i)(^|/)(tests?|__tests?__|spec)/|\.(test|spec)\."


def split_identifier(name: Column) -> Column:
    """Words of an identifier in order, lower case, at least two characters, each once."""
    text = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s_./-]+"), lambda w: F.length(w) >= 2))


def words(text: Column) -> Column:
    """Lower-case ASCII words without stop words, in order, repeated ones kept."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.split(F.lower(text), r"[^A-Za-z0-9_]+"), lambda w: (F.length(w) > 0) & ~F.array_contains(stop, w))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the lower-case text; none below three characters."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def similarity(a: Column, b: Column) -> Column:
    """Trigram similarity; where either side is too short, equality."""
    x, y = trigrams(a), trigrams(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.when(F.lower(a) == F.lower(b), 1.0).otherwise(0.0)).otherwise(jaccard(x, y))


def fuzzy(query: Column, candidate: Column) -> Column:
    """1 for equality in any case, 0.9 for containment, else trigram similarity."""
    q, c = F.lower(query), F.lower(candidate)
    return F.when(q == c, 1.0).when(F.contains(c, q), 0.9).otherwise(similarity(q, c))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.5).cast("bigint")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def last_segments(path: Column, n: int) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: F.length(p) > 0)
    return F.concat_ws("/", F.when(F.size(parts) > n, F.slice(parts, -n, n)).otherwise(parts))


def directory_weight(path: Column) -> Column:
    """The least weight of the directories that count less, else that of those that count more, else 1."""
    low = F.lower(F.regexp_replace(F.regexp_replace(path, r"^\./", ""), "^/+|/+$", ""))
    less = F.least(F.lit(1.0), *[F.when(low.rlike(p), w).otherwise(1.0) for p, w in LESS])
    return F.when(less < 1.0, less).when(low.rlike(MORE), MORE_WEIGHT).otherwise(1.0)


def glob_pattern(glob: str) -> str:
    """A glob with **, *, ? and {a,b} as a regular expression; unmatched braces are an error."""
    import re

    out, depth, i = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{":
            depth, out = depth + 1, out + "(?:"
        elif c == "}":
            depth, out = depth - 1, out + ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        if depth < 0:
            break
        i += 1
    if depth:
        raise ValueError("unmatched brace in glob")
    return f"^{out}$"


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def commit_type(message: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(message, r"^([A-Za-z]+)(?:\([^)]*\))?!?:", 1)), F.lit(""))


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - 3)), F.lit("..."))).otherwise(text)


def plain_markdown(text: Column) -> Column:
    text = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"`([^`]*)`", "$1")
    return F.regexp_replace(text, r"[*_]{1,2}([^*_]+)[*_]{1,2}", "$1")
