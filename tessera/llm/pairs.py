"""Functions paired with their documentation, by island grammars.

Each row's source is read by the island grammar of its language family: the islands are documentation comments,
annotations, the signature and the balanced body (by brackets or by indentation, strings and comments skipped); all else
is water. The description is what is left of the documentation after markers, tags, licence lines, directives to tools, separators
and code are taken away; a pair is kept if that says more than the name does.

Defined results: rows of other kinds, without source or with a null id have no pair; documentation is sought in doc_comment,
ahead of the code, and in the first string of the body, in this order, and the first that says something is taken; repeated rows give one
pair. Line breaks may be LF or CRLF. A truncated body ends at the end of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

KINDS = ["function", "method", "arrow"]
#: Islands of the families: comments ahead of the code, annotations, and what opens a signature.
LINE_COMMENT = {"hash": re.compile(r"[ \t]*#(?!\[|!\[)[^\n]*(?:\n|$)"), "slash": re.compile(r"[ \t]*//[^\n]*(?:\n|$)")}
BLOCK_COMMENT = re.compile(r"[ \t]*/\*.*?\*/[ \t]*\n?", re.DOTALL)
BLANK = re.compile(r"[ \t\r]*\n")
ANNOTATION = {"hash": re.compile(r"[ \t]*@[\w.]+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?[ \t\r]*\n"), "slash": re.compile(r"[ \t]*(?:@(?!interface\b)[\w.]+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?|#!?\[[^\]]*\])[ \t\r]*\n?")}
PYTHON = re.compile(r"[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+\w+")
STRING = re.compile(r"[ \t]*[rRuUbBfF]{0,2}(?:\"\"\"(?P<a>.*?)(?:\"\"\"|\Z)|'''(?P<b>.*?)(?:'''|\Z)|\"(?P<c>(?:[^\"\\\n]|\\.)*)\"|'(?P<d>(?:[^'\\\n]|\\.)*)')[ \t\r]*;?[ \t\r]*(?:#[^\n]*)?(?=\n|\Z)", re.DOTALL)
WATER = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.){0,3}'|'(?:[^'\\\n]|\\.)*'(?=\s*[,;)\]}+:.])|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*.*?\*/|[^\"'`/{}()\[\];:#]+|.", re.DOTALL)

#: What a documentation comment is not.
LICENCE = re.compile(r"(?i)\bspdx-license|\bcopyright\b|\(c\)\s*\d{4}|^licen[sc]ed (?:under|to)|all rights reserved|^licen[sc]e\s*:|permission is hereby granted")
DIRECTIVE = re.compile(
    r"(?i)^(?:eslint|tslint|jshint|jslint|prettier|istanbul|c8|v8|biome|stylelint|webpack|vite|@ts-|ts-ignore|ts-expect|noqa|nolint|go:|\+build|pylint|flake8|mypy|pyright|type:\s*ignore|fmt:|yapf|isort|ruff|black|pragma|nosec|nosonar|sonar|checkstyle|noinspection|"
    r"suppresswarnings|rustfmt|clippy|cspell|codecov|coverage|#?\s*(?:end)?region\b|#?pragma|lint|shellcheck|deno-|globals?\s|exported\s|swiftlint|spotless|@formatter|formatter:|\$\w+\$|vim:|-\*-|language=|sourcemappingurl|#\s*source)"
)
EMPTY_PHRASE = re.compile(
    r"(?i)^(?:todo|fixme|xxx|hack|tbd|tba|wip|n\s*/?\s*a|nil|none|null|nothing|empty|placeholder|description|desc|documentation|docs?|comment|summary|see (?:above|below|base|parent|super|interface|docs?|readme)|same as|ditto|as above|inherit(?:ed|s|doc)?\b|helpers?|main|constructor|"
    r"destructor|getters?|setters?|handlers?|private|public|internal|protected|static|deprecated|override|utils?|utility|functions?|methods?|add (?:a )?(?:description|docs?|documentation)|description goes here|write (?:me|docs?)|document (?:me|this)|auto[- ]?generated|generated (?:method|stub)|"
    r"no (?:description|documentation|docs?)|missing (?:docs?|description)|self[- ]explanatory|obvious|stub|not documented|undocumented|to be (?:written|documented|done)|default|misc|other|self)\b"
)
TAG = re.compile(r"^(?:@\w+|\\(?:param|return|brief|throws)|:(?:param|type|return|returns|rtype|raises|raise|arg|args)\b|\{@\w+[^}]*\}$)")
SECTION = re.compile(r"(?i)^(?:args?|arguments|parameters?|params|returns?|raises|throws|yields|attributes|examples?|notes?|see also|since|author)\s*:?\s*$")
CODE = re.compile(
    r"^(?:[\w.$>]+\([^()]*(?:\([^()]*\)[^()]*)*\)[;:]?|(?:return|throw|raise|await|yield|break|continue|import|from|package|use|del|assert|print|console)\b[^.!?]*[;()]?|(?:const|let|var|val|final|int|long|float|double|bool|boolean|string|String|def|fn|func|function|class|type|struct|pub|public|private|static)\b.*[=;{(:].*"
    r"|(?:if|for|while|switch|match|else|elif|try|catch|except|with)\b.*[{(:;].*|[\w.$\[\]\"']+\s*(?:[-+*/|&^]|:)?=\s*\S.*|[{}()\[\];,<>]+.*|.*[;{}]|<[^>]+>.*|\w+(?:\.\w+)+)$"
)
STOP = set("the a an this that it is are of for to and in on by with function method procedure routine helper constructor callback handler class object does do will impl implementation func fn def arrow lambda just simply".split())
WIDE = re.compile(r"[฀-๿぀-ヿ㐀-鿿豈-﫿]")


def stem(word: str) -> str:
    for end in ("ies", "ches", "shes", "sses", "xes", "izes", "ing", "ed", "es", "s"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word[: -len(end)] + ("y" if end == "ies" else "")
            break
    word = word[:-1] if len(word) > 3 and word[-1] == word[-2] else word
    return word.rstrip("e") if len(word) > 3 else word


def words_of(text: str) -> list[str]:
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", text))
    return re.findall(r"[^\W\d_]+", text.lower())


def lines_of(comment: str) -> list[str]:
    """The lines of a comment or docstring without its markers."""
    out = []
    text = re.sub(r"^\s*/\*+!?|\*+/\s*$", "\n", comment.strip())
    for line in re.split(r"\r\n|\n|\r", text):
        line = re.sub(r"^\s*/\*+!?|\*+/\s*$", "", line.strip()).strip()
        line = re.sub(r"^(?://+!?|#+!?(?!region|endregion)|\*+(?!/)|--+(?=\s|$)|;+|\"\"\"|''')\s*", "", line)
        out.append(re.sub(r"(?:\"\"\"|'''|\*+/)$", "", line).strip())
    return out


def description(comment: str | None, name: str) -> str | None:
    """What the comment says about the behaviour; None where it says nothing."""
    if not comment or not comment.strip():
        return None
    kept, in_tag = [], False
    for line in lines_of(comment):
        if not line:
            in_tag = False
            continue
        if TAG.match(line) or SECTION.match(line):
            in_tag = True
            continue
        if in_tag and not re.match(r"[A-ZЀ-ӿ]", line) and not WIDE.match(line):
            continue
        in_tag = False
        bare = line.strip(" \t-=*~_#/\\.!?<>|+:;,`'\"")
        if not re.search(r"[^\W\d_]", bare) or LICENCE.search(line) or DIRECTIVE.match(line) or DIRECTIVE.match(bare):
            continue
        if CODE.match(line) and not re.search(r"[a-z]{2,} [a-z]{2,} [a-z]{2,} [a-z]{2,}", line) or "{@inherit" in line.lower():
            continue
        if EMPTY_PHRASE.match(bare) and len(bare.split()) <= 5 and not WIDE.search(bare):
            continue
        kept.append(line)
    text = " ".join(kept)
    if not kept:
        return None
    if len(WIDE.findall(text)) >= 4:
        return text
    said = [w for w in words_of(text) if w not in STOP]
    known = {stem(w) for w in words_of(name)}
    new = [w for w in said if stem(w) not in known]
    if len(said) < 2 or not new or (len(new) == 1 and len(said) <= 2):
        return None
    return text


def islands(source: str) -> tuple[str, str, str | None, int, str]:
    """(family, comments ahead of the code, first string of the body, where the code begins, code without its documentation)."""
    probe, at = "slash", 0
    head = re.search(r"(?m)^[ \t]*(?!#|//|\*|/\*|@)\S.*", source)
    if head and PYTHON.match(head.group()):
        probe = "hash"
    comments = []
    while at < len(source):
        m = BLANK.match(source, at) or ANNOTATION[probe].match(source, at)
        if m and m.end() > at:
            at = m.end()
            continue
        m = LINE_COMMENT[probe].match(source, at) or (BLOCK_COMMENT.match(source, at) if probe == "slash" else None)
        if not m or m.end() == at:
            break
        comments.append(m.group())
        at = m.end()
    if probe == "hash":
        colon = signature_end(source, at)
        start = re.compile(r"[ \t\r]*(?:#[^\n]*)?\n(?:[ \t\r]*(?:#[^\n]*)?\n)*").match(source, colon) if colon else None
        first = STRING.match(source, start.end() if start else colon) if colon else None
        if first:
            text = next(g for g in first.groups() if g is not None)
            return probe, "".join(comments), text, at, source[at : first.start()] + source[first.end() :].lstrip("\n")
        return probe, "".join(comments), None, at, source[at:]
    return probe, "".join(comments), None, at, source[at : body_end(source, at)]


def signature_end(source: str, at: int) -> int:
    """Behind the colon that ends a Python signature; 0 where there is none."""
    depth = 0
    for m in re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*|[()\[\]{}:\n]").finditer(source, at):
        token = m.group()
        if token in "([{":
            depth += 1
        elif token in ")]}":
            depth -= 1
        elif token == ":" and depth <= 0:
            return m.end()
    return 0


def body_end(source: str, at: int) -> int:
    """Behind the balanced body; a function without braces ends with its text."""
    depth, seen = 0, False
    for m in WATER.finditer(source, at):
        token = m.group()
        if token == "{":
            depth, seen = depth + 1, True
        elif token == "}":
            depth -= 1
            if seen and depth <= 0:
                rest = re.compile(r"[ \t]*[;,)]*").match(source, m.end())
                return rest.end()
    return len(source)


def paired(symbols: DataFrame, with_code: bool = True) -> DataFrame:
    """(symbol_id, description and, if ``with_code``, name, kind, signature, family, code) of the documented functions."""

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                name = row.name if isinstance(row.name, str) else ""
                source = row.full_source if isinstance(row.full_source, str) else ""
                family, ahead, first, _, code = islands(source)
                said = next((d for d in (description(c, name) for c in (row.doc_comment if isinstance(row.doc_comment, str) else None, ahead, first)) if d), None)
                if said and source.strip():
                    out.append((row.symbol_id, said, row.name, row.kind, row.signature, family, code) if with_code else (row.symbol_id,))
            yield pd.DataFrame(out, columns=names)

    schema = "symbol_id bigint" + (", description string, name string, kind string, signature string, family string, code string" if with_code else "")
    names = [c.split()[0] for c in schema.split(", ")]
    rows = symbols.filter(F.col("id").isNotNull() & F.col("kind").isin(KINDS))
    # rows without any comment or string at a place where documentation stands never leave the JVM
    documented = F.col("doc_comment").rlike(r"\S") | F.col("full_source").rlike(r"^\s*(?:@[^\n]*\n\s*)*(?://|/\*|#)") | F.col("full_source").rlike(r":[ \t\r]*(?:#[^\n]*)?\n\s*(?:#[^\n]*\n\s*)*[rRuUbBfF]{0,2}[\"']")
    rows = rows.filter(documented).select(F.col("id").cast("bigint").alias("symbol_id"), "name", "kind", "signature", "doc_comment", "full_source")
    out = rows.mapInPandas(pair, schema)
    return out.dropDuplicates(["symbol_id"]) if with_code else out.distinct()


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return paired(table(spark, directory, "symbols"), with_code=False)


def p6_pairs(spark: SparkSession, directory: str) -> DataFrame:
    return paired(table(spark, directory, "symbols"))


QUERIES = {"p6_found": p6_found, "p6_pairs": p6_pairs}
SQL: dict[str, str] = {}
