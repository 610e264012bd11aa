"""Generated, minified, vendored source files and data saved as code, by identifier models.

1. One pass over the files gives each one's identifiers (outside strings and comments) as counts of character trigrams, each
   identifier counted once a file, with the diversity of its identifiers, naming styles, shape figures and what path and leading comments say.
2. From all files a trigram model per language is summed up (its size is bounded: 38 characters to the third power for each of MOST_LANGUAGES
   languages; all rarer languages share one model), the usual cross-entropy and diversity per language, and the naming styles per repository and language.
3. Each file is scored by the models. *Mangled* (minified or bundled): its identifiers' cross-entropy, under the model of its language without
   the file's own counts, lies MANGLED_BITS above the usual. *Template-like* (generated): the sequence of its identifiers, digits aside, packs into
   less than TEMPLATE_SHARE of what the language's files usually take. *Foreign* (vendored): its naming styles are far from those of the
   repository's other files of that language, together with another's licence. *Data*: mostly literals and hardly a definition.
4. Marks are further evidence beside the models: places and file names of copies and of generators' and bundlers' output, and leading comments
   that say so. ``by_model`` and ``by_mark`` tell which of the two named a file.

Defined results: configuration and markup languages (LEFT_OUT), null languages and files without text are never named; repeated rows count once;
identifiers beyond ASCII fold to one class of character; languages compare trimmed and in lower case.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.filetexts import per_file
from tessera.session import cut
from tessera.sources.tables import table

LEFT_OUT = ["json", "yaml", "toml", "ini", "xml", "markdown", "text", "html", "css", "csv"]
#: Bits per character above the language's mean that count as mangled, with at least so many different names and such a share of names of one or two
#: characters (words of another language have many bits too); languages with a model of their own.
MANGLED_BITS, MANGLED_NAMES, MANGLED_SHORT, MOST_LANGUAGES = 1.1, 12, 0.3, 100
#: Identifiers packed together, and the share of the usual packed size below which a file of at least so many identifiers is a template's work.
PACKED_TOGETHER, TEMPLATE_SHARE, TEMPLATE_NAMES = 400, 0.66, 60
#: Share of literals of a data file; the distance of naming styles that is foreign, and styled names needed on both sides.
DATA_SHARE, FOREIGN, STYLED = 0.6, 0.7, 5
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789_"
SIDE = len(ALPHABET) + 1
TOKEN = re.compile(
    r"(?P<c>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|(?:(?<=\n)|(?<=[ \t])|\A)#(?![!\[])[^\n]*)|(?P<s>\"\"\"(?:[^\"]|\"(?!\"\"))*\"\"\"|'''(?:[^']|'(?!''))*'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)"
    r"|(?P<n>0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?)|(?P<i>[^\W\d][\w$]*)"
)
DEFINED = set("function def fn func class struct interface enum trait type const let var val void int long boolean double float String static final public private protected pub async namespace module".split())
#: What heads and paths of such files say.
GENERATED_HEAD = re.compile(r"(?i)\bcode generated\b|\bdo not (?:edit|modify)\b|@generated\b|<auto-?generated|\bauto-?generated\b(?!\s+method)|\bautomatically (?:produced|generated)\b|\b(?:file|code|module) (?:is|was) (?:auto(?:matically)?[- ]?)?(?:generated|produced) (?:by|from|with)|\bchanges will be (?:lost|overwritten)\b|\bgenerated (?:by|from|with) [\w.`-]+|\b(?:maschinell|automatisch) (?:erzeugt|erstellt|generiert)\b|\bgénéré[e]? (?:automatiquement|par)\b|\bgenerad[oa] (?:automáticamente|por)\b|автоматически (?:создан|сгенерирован)|自動生成|自动生成|자동(?:으로)? 생성|^\W*source: \S+\.(?:idl|proto|schema|avsc|thrift)\b")
BY_HAND = re.compile(r"(?i)\b(?:written|maintained|edited|kept) by hand\b|\bhand[- ]?(?:written|maintained|rolled)\b|\bnot generated\b")
VENDORED_HEAD = re.compile(r"(?i)\bvendored (?:copy|from|version)\b|\bupstream (?:release|version|commit|at)\b|\bsee upstream\b|\breleased under the [\w.() -]+ licen[sc]e by\b|\b(?:copied|imported|taken) (?:verbatim )?from (?:https?:|github|upstream)|^\W*[\w.-]+ v?\d+\.\d+\.\d+ (?:- )?.*licen[sc]ed?\b")
FOREIGN_LICENCE = re.compile(r"(?i)\b(?:MIT|BSD|ISC|Apache|MPL|A?L?GPL)\b[^\n]*\blicen[sc]e|\bcopyright\b[^\n]*\b(?:19|20)\d\d\b")
OWN = re.compile(r"(?i)\bthe rest of this (?:repository|repo|project)\b|\bsame licen[sc]e as this\b")
BANNER = re.compile(r"^\s*(?:/\*!|//!)[^\n]{0,80}")
VENDORED_PATH = re.compile(r"(?i)(?:^|/)(?:node_modules|vendor|vendors|vendored|third[-_]?party|extern|externals?|bower_components|jspm_packages|site-packages|pods|carthage|godeps|deps|contrib/lib)/|(?:^|/)[a-z][\w]*-v?\d+\.\d+\.\d+(?:[-._][\w]+)*\.\w+$|(?:^|/)[a-z][\w]*-v?\d+\.\d+\.\d+/")
GENERATED_PATH = re.compile(r"(?i)(?:^|/)(?:generated|__generated__|autogen|gen/proto|gen/go|codegen/out|generated-sources?)/|(?:^|/)zz_generated\.|\.generated\.|\.pb\.(?:go|cc|h|ts|js)$|_pb2(?:_grpc)?\.pyi?$|\.g\.(?:dart|cs|ts)$|_generated\.|\.designer\.cs$|\.freezed\.dart$")
MINIFIED_PATH = re.compile(r"(?i)[.-]min\.[cm]?js$|\.bundle\.[cm]?js$|\.chunk\.[cm]?js$|[.-][0-9a-f]{8,}\.(?:bundle\.|chunk\.)?[cm]?js$")


def trigrams(name: str) -> list[int]:
    codes = [SIDE - 1, *(ALPHABET.find(c) for c in name.lower()), SIDE - 1]
    codes = [c if c >= 0 else SIDE - 1 for c in codes]
    return [(codes[k - 2] if k > 1 else SIDE - 1) * SIDE * SIDE + codes[k - 1] * SIDE + codes[k] for k in range(1, len(codes))]


def packed_share(names: list[str]) -> tuple[int, int]:
    """Size of the identifiers, digits aside, packed in groups of equal length, and before; a file's length does not sway it."""
    after = before = 0
    for k in range(0, len(names), PACKED_TOGETHER):
        text = re.sub(r"\d+", "0", " ".join(names[k : k + PACKED_TOGETHER])).encode()
        after, before = after + len(zlib.compress(text, 6)), before + len(text)
    return after, before


def figures(path: str, text: str) -> tuple:
    """Counts and signs of one file."""
    names: Counter = Counter()
    sequence: list[str] = []
    heads: list[str] = []
    literal = numbers = code = defined = 0
    in_head, before = True, ""
    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "c":
            if in_head:
                heads.append(m.group())
            continue
        in_head = in_head and kind == "s" and not code
        if kind == "i":
            name = m.group()
            code += len(name)
            names[name] += 1
            sequence.append(name)
            if before in DEFINED and name not in DEFINED:
                defined += 1
            before = name
        else:
            literal += len(m.group())
            numbers += kind == "n"
    head = "\n".join(heads)
    own = BY_HAND.search(head) or OWN.search(head)
    total = sum(names.values())
    packed, unpacked = packed_share(sequence)
    body = re.sub(r"\s+", "", text)
    grams = Counter(g for name in names for g in trigrams(name))
    styled = [n for n in names if len(n) > 3]
    return (
        total, len(names), sum(c for n, c in names.items() if len(n) <= 2) / max(1, total), defined, packed / max(1, unpacked), literal / max(1, len(body)), numbers / max(1, total),
        sum("_" in n.strip("_") and n == n.lower() for n in styled), sum(bool(re.match(r"[a-z]+[0-9]*[A-Z]", n)) for n in styled),
        bool(GENERATED_HEAD.search(head)) and not own, bool(VENDORED_HEAD.search(head)) and not own, bool(FOREIGN_LICENCE.search(head)) and not own, bool(GENERATED_PATH.search(path)), bool(VENDORED_PATH.search(path)), bool(MINIFIED_PATH.search(path)),
        list(grams), list(grams.values()),
    )


SCHEMA = (
    "file_id bigint, repo string, language string, names bigint, distinct bigint, short double, defined bigint, packed double, literal double, numbers double, snake bigint, camel bigint, "
    "generated_head boolean, vendored_head boolean, licence_head boolean, generated_path boolean, vendored_path boolean, minified_path boolean, grams array<int>, counts array<int>"
)


def summaries(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of figures per file of a programming language."""
    named = files.withColumn("language", F.lower(F.trim("language"))).filter(F.col("language").isNotNull() & ~F.col("language").isin(LEFT_OUT))

    def work(file_id: int, about: tuple, text: str) -> tuple | None:
        path, language, repo = about
        return (file_id, repo, language, *figures(path or "", text)) if text.strip() else None

    return per_file(named, chunks, work, ["path", "language", "repo"], SCHEMA)


def model(rows: DataFrame) -> dict[str, np.ndarray]:
    """Counts of each trigram by ``tongue``; sums over all files, with bounded size."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for tongue, grams, counts in zip(batch["tongue"], batch["grams"], batch["counts"], strict=True):
                if tongue not in sums:
                    sums[tongue] = np.zeros(SIDE**3)
                np.add.at(sums[tongue], np.asarray(grams, dtype=np.int64), np.asarray(counts, dtype=float))
        for tongue, dense in sums.items():
            at = np.flatnonzero(dense)
            yield pd.DataFrame({"tongue": tongue, "gram": at.astype(np.int32), "n": dense[at]})

    sums = rows.select("tongue", "grams", "counts").mapInPandas(partial, "tongue string, gram int, n double").groupBy("tongue", "gram").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for tongue, part in sums.groupby("tongue"):
        out[tongue] = np.zeros(SIDE**3, dtype=np.float32)
        out[tongue][part["gram"].to_numpy()] = part["n"].to_numpy()
    return out


def bits_without(all_counts: np.ndarray, starts: np.ndarray, grams: np.ndarray, counts: np.ndarray, smooth: float = 0.02) -> float:
    """Bits per character of a file's trigrams under its language's model without the file itself; ``starts``: sums by first two characters."""
    own = pd.Series(counts).groupby(grams // SIDE).sum()
    seen = all_counts[grams] - counts + smooth
    of = starts[grams // SIDE] - own.loc[grams // SIDE].to_numpy() + smooth * SIDE
    return float((-np.log2(seen / of) * counts).sum() / counts.sum())


def verdicts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, kind, by_model, by_mark, bits, and the figures) of every file of a programming language; kind is null for hand-written ones."""
    rows = cut(summaries(files, chunks))
    own_model = [r[0] for r in rows.groupBy("language").count().orderBy(F.desc("count"), "language").limit(MOST_LANGUAGES).collect()]
    rows = rows.withColumn("tongue", F.when(F.col("language").isin(own_model), F.col("language")).otherwise(""))
    shared = rows.sparkSession.sparkContext.broadcast({t: (c, c.reshape(-1, SIDE).sum(1)) for t, c in model(rows).items()})

    @F.pandas_udf("double")
    def entropy(tongue: pd.Series, grams: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for t, g, c in zip(tongue, grams, counts, strict=True):
            out.append(bits_without(*shared.value[t], np.asarray(g, dtype=np.int64), np.asarray(c, dtype=float)) if len(g) else 0.0)
        return pd.Series(out)

    scored = cut(rows.withColumn("bits", entropy("tongue", "grams", "counts")).drop("grams", "counts"))  # narrow rows, read three times below
    # what is usual in each language without the file itself, or in all where a language has no other file: at most MOST_LANGUAGES + 1 rows, and one
    scored = scored.withColumn("long_packed", F.when(F.col("names") >= TEMPLATE_NAMES, F.col("packed")))
    sums = [F.sum(c).alias(f"tongue_{c}") for c in ("bits", "long_packed")] + [F.count(c).alias(f"tongue_n_{c}") for c in ("bits", "long_packed")]
    usual = scored.groupBy("tongue").agg(*sums)
    whole = usual.agg(*[F.sum(c).alias(c.replace("tongue", "whole")) for c in usual.columns[1:]])
    scored = scored.join(F.broadcast(usual), "tongue").crossJoin(F.broadcast(whole))

    def without_own(column: str) -> Column:
        def mean(of: str) -> Column:
            n = F.col(f"{of}_n_{column}") - F.col(column).isNotNull().cast("int")
            return F.when(n > 0, (F.col(f"{of}_{column}") - F.coalesce(column, F.lit(0.0))) / n)

        return F.coalesce(mean("tongue"), mean("whole"))

    scored = scored.withColumn("usual_bits", without_own("bits")).withColumn("usual_packed", without_own("long_packed"))
    # the repository's naming styles without the file's own; a repository may hold a third of all files, so its sums are joined, not windowed
    styles = scored.groupBy("repo", "language").agg(F.sum("snake").alias("all_snake"), F.sum("camel").alias("all_camel"))
    scored = scored.join(styles, ["repo", "language"], "left")
    own, other = F.col("snake") + F.col("camel"), F.col("all_snake") + F.col("all_camel") - F.col("snake") - F.col("camel")
    apart = F.abs(F.col("snake") / F.greatest(own, F.lit(1)) - (F.col("all_snake") - F.col("snake")) / F.greatest(other, F.lit(1)))
    distance = F.when((own >= STYLED) & (other >= STYLED), apart).otherwise(0.0)
    mangled = (F.col("bits") > F.col("usual_bits") + MANGLED_BITS) & (F.col("distinct") >= MANGLED_NAMES) & (F.col("short") > MANGLED_SHORT) & (F.col("literal") <= DATA_SHARE)
    template = F.coalesce(F.col("packed") < TEMPLATE_SHARE * F.col("usual_packed"), F.lit(False)) & (F.col("names") >= TEMPLATE_NAMES)
    data = ((F.col("literal") > DATA_SHARE) & (F.col("defined") <= 3)) | ((F.col("numbers") > 3) & (F.col("defined") <= 3))
    foreign = (F.col("distance") > FOREIGN) & F.col("licence_head")
    by_model = F.when(foreign, "vendored").when(data, "data").when(mangled, "minified").when(template, "generated")
    by_mark = F.when(F.col("vendored_path") | F.col("vendored_head"), "vendored").when(F.col("minified_path"), "minified").when(F.col("generated_head") | F.col("generated_path"), "generated")
    scored = scored.withColumn("distance", distance).withColumn("by_model", by_model).withColumn("by_mark", by_mark)
    return scored.withColumn("kind", F.coalesce(F.when(F.col("by_mark") == "vendored", F.col("by_mark")), "by_model", "by_mark")).drop(*usual.columns, *whole.columns)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return verdicts(table(spark, directory, "files"), table(spark, directory, "chunks")).filter("kind is not null").select("file_id")


def p3_verdicts(spark: SparkSession, directory: str) -> DataFrame:
    out = verdicts(table(spark, directory, "files"), table(spark, directory, "chunks"))
    return out.select("file_id", "language", "kind", "by_model", "by_mark", F.round("bits", 6).alias("bits"), F.round("packed", 6).alias("packed"), F.round("distance", 6).alias("distance"), "short", "defined", "literal")


QUERIES = {"p3_found": p3_found, "p3_verdicts": p3_verdicts}
SQL: dict[str, str] = {}
