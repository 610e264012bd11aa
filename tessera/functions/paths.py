"""Column functions on paths, lines and scores; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as X

#: What paths say about a file, on the lower-case path without backslashes.
TEST_PATH = r"\.(test|spec)\.|^tests?/|/tests?/|/__tests__/|_(test|spec)\.ts$"
NOISY_PATH = TEST_PATH + r"|/mock|/fixture|/__mocks__/"
UI_PATH = r"(^|/)(ui|components?|views?|pages?|templates?|marketing)(/|$)|(^|/)(page|layout)\.[cm]?[jt]sx?$"
TYPE_PATH = r"(^|/)(types|typings)(/|$)|\.d\.ts$"
RUNTIME_PATH = r"(^|/)(src|lib|server|app|api|routes?|controllers?|services?)(/|$)"
CONFIG_PATH = r"(^|/)(\.github|\.circleci|\.vscode|\.husky)(/|$)|(^|/)(package\.json|tsconfig\.json|eslint\.config|vite\.config|vitest\.config|jest\.config|tailwind\.config|postcss\.config)|/\.eslintrc|/(pnpm-lock\.yaml|package-lock\.json|yarn\.lock)$"
ENTRY_PATH = r"(^|/)middleware\.(ts|tsx|js|jsx|mts|cts|mjs|cjs)$|/app/.+/(route|page|layout)\.(ts|tsx|js|jsx|mts|cts|mjs|cjs)$|/pages/.+\.(ts|tsx|js|jsx|mts|cts|mjs|cjs)$"
DOC_PATH = r"\.(md|txt|rst|adoc)$"
VENDOR_PATH = r"(^|/)(vendor|static/js|assets/js|public/js|dist|build|\.next|coverage|\.worktrees?|\.claude|\.qa-temp|__pycache__|\.git|node_modules)/|\b(jquery|modernizr|bootstrap|lodash|moment|popper|aos|plugins|polyfill|bundle)\b|/(template|theme|starter|boilerplate)s?[/-]|\.min\.(js|css)$"
FLAGS = {"test": TEST_PATH, "noisy_test": NOISY_PATH, "ui": UI_PATH, "type_declaration": TYPE_PATH, "runtime": RUNTIME_PATH, "configuration": CONFIG_PATH, "entry": ENTRY_PATH, "document": DOC_PATH, "vendored": VENDOR_PATH}
#: Weights of kinds where running code is preferred, among results and among pivots; what visibility keeps of a score.
RUNTIME_KINDS = {"function": 1.08, "method": 1.08, "class": 1.08, "interface": 0.72, "type": 0.72, "variable": 0.82}
PIVOT_KINDS = {"function": 1.2, "method": 1.2, "class": 1.1, "interface": 0.75, "type": 0.75, "variable": 0.9}
VISIBILITY = {"private": 0.15, "protected": 0.45, "internal": 0.65}


def is_path(path: Column, flag: str) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(FLAGS[flag])


def weight_of(value: Column, weights: dict[str, float]) -> Column:
    out = None
    for key, weight in weights.items():
        out = F.when(F.lower(value) == key, weight) if out is None else out.when(F.lower(value) == key, weight)
    return out.otherwise(1.0)


def within(path: Column, base: Column) -> Column:
    return (base == "") | (path == base) | F.startswith(path, F.concat(base, F.lit("/")))


def is_safe(path: Column) -> Column:
    """Relative, of at most 4,096 characters, and without a step up, a home or a null character."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return (F.length(path).between(1, 4096)) & ~path.rlike(r"^([/\\~]|[A-Za-z]:)") & ~F.array_contains(parts, "..") & ~F.contains(path, F.lit("\x00"))


def relative(root: Column, path: Column) -> Column:
    """The path below the root with plain slashes; paths elsewhere only get plain slashes and no leading ./."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+", "/"), "^(\\./)+", "")
    r, p = F.regexp_replace(plain(root), "/$", ""), plain(path)
    return F.when(p == r, ".").when(F.startswith(p, F.concat(r, F.lit("/"))), p.substr(F.length(r) + 2, F.length(p))).otherwise(p)


def path_terms(path: Column) -> Column:
    """Words of the last six segments without the extension, three characters or more, lower case."""
    bare = F.regexp_replace(X.last_segments(path, 6), r"\.[^.]+$", "")
    return F.filter(F.split(F.lower(F.regexp_replace(bare, "([a-z])([A-Z])", "$1 $2")), r"[/\\\-_. ]+"), lambda t: F.length(t) > 2)


def path_matches(path: Column, words: Column) -> Column:
    """Two words of the query, or one of six characters, are among the path's; words of eight characters may be parts of each other."""
    known = path_terms(path)
    hit = lambda q: F.exists(known, lambda p: (p == q) | ((F.length(q) >= 8) & F.contains(p, q)) | ((F.length(p) >= 8) & F.contains(q, p)))
    found = F.filter(words, hit)
    return (F.size(found) >= 2) | F.exists(found, lambda q: F.length(q) >= 6)


def request_path(url: Column, dynamic: str = "__dynamic__") -> Column:
    """The path of a request: no origin, query or fragment, one mark for each inserted expression, single slashes."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?i)^[a-z]+://[^/]+", ""), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\$\{[^}]+\}", dynamic), "/+", "/")


def camel_words(text: Column) -> Column:
    """Lower-case words of letters and digits, cut where a capital follows a small letter."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]+", " "), " +"), lambda w: w != "")


def covers(word: Column, other: Column) -> Column:
    """Equal, one within the other, or the same first four characters."""
    return (word == other) | F.contains(word, other) | F.contains(other, word) | ((F.length(word) >= 4) & (F.length(other) >= 4) & (F.substring(word, 1, 4) == F.substring(other, 1, 4)))


def same_stem(word: Column, other: Column) -> Column:
    """One within the other, or the same first five characters, fewer where one of them is shorter."""
    n = F.least(F.lit(5), F.length(word), F.length(other))
    return F.contains(word, other) | F.contains(other, word) | (word.substr(F.lit(1), n) == other.substr(F.lit(1), n))


def near(text: Column, one: str, two: str, within_chars: int = 50) -> Column:
    """Whether the two words, lower case, stand at most so many characters apart, or overlap."""
    import re

    a, b = re.escape(one), re.escape(two)
    return text.rlike(rf"(?s)(?={a}).{{0,{len(one) + within_chars}}}{b}|(?={b}).{{0,{len(two) + within_chars}}}{a}")


def recency_bonus(age_days: Column) -> Column:
    return F.when(age_days <= 1, 0.01).when(age_days <= 7, 0.005).otherwise(0.0)


def human_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", n / 1048576.0), F.lit(" MB")))


def line_of(text: Column, offset: Column, first: Column) -> Column:
    """The line of a character offset from 1 in a text whose first line is ``first``."""
    before = text.substr(F.lit(1), offset - 1)
    return first + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def json_list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
