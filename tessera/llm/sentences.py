"""Sentence units of texts in many languages and scripts, in SQL expressions only.

1. In a copy of the text, marks that end nothing (in decimals, versions, identifiers, paths, URLs, initials, abbreviations and
   ordinals) are replaced by private-use placeholders, one for one, so that positions stay.
2. A separator is put around fenced code blocks, headings and list items and at blank lines; the blocks become rows.
3. In running text a separator is put behind the end marks of each script, with the closing quotes and brackets
   behind them, where what follows can begin a sentence.
4. Lengths of the pieces give positions; the unit's text is then restored from its placeholders.

Defined results: null, empty and blank texts have no units; a unit has no white space around it; positions count code
points; repeated rows give repeated units. Private-use characters of a text are treated as letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

SEP, DOT, ASK = "\ue001", "\ue010", "\ue011"
D = f"[.{DOT}]"
#: Abbreviations that never end a sentence (their last mark is masked wherever they stand).
NEVER = (
    "e.g i.e vs viz cf approx resp esp fig figs sec secs eq eqs rev vol pp "
    "nr abb abschn kap tab bzw ca vgl evtl ggf inkl exkl sog zzgl bspw "
    "env ex art pág págs núm aprox ej "
    "рис см ок табл гл стр напр ср им ул "
    "π.χ βλ σχ σελ αρ δηλ πίν κεφ"
).split()
#: Titles before a name, capitalized.
TITLES = "Dr Mr Mrs Ms Prof St Messrs Gen Sgt Col Capt Hr Fr Mme Mlle Sr Sra Srta Dra M MM".split()
#: Abbreviations of several words with spaces inside.
SPACED = ["z. b", "d. h", "u. a", "o. ä", "u. u", "i. d. r", "s. o", "s. u", "p. ex", "p. ej", "c. à. d", "т. е", "т. к", "т. н", "ee. uu"]
#: Abbreviations only before a number.
NUMBERED = "no nos p pp n art § num seite s г п".split()
#: German words before which a number with a point is an ordinal, as in "seit dem 5. Quartal".
ORDINAL = "dem der den des das die im am zum vom beim ab bis jeder jedem jeden".split()
CLOSE = "[\"'”“»’›)\\]}」』）】》〉`*_]"
CLOSERS = f"(?:[ \\u00a0\\u202f]»|{CLOSE})*"
ENDS = ".!?…؟।॥。！？｡\u037e"
NAME = f"\\p{{Ll}}[\\p{{L}}\\p{{N}}_]*(?:[(_{DOT}]|\\p{{Lu}})[\\p{{L}}\\p{{N}}_)]"
NEXT = f"(?:\\p{{Ll}}+\\s+[\\p{{Lo}}]|[\\p{{Lu}}\\p{{Lt}}\\p{{Lo}}\\p{{N}}¿¡«“„\"‘'‚(（「『《\\[`]|https?:|[{DOT}]{{1,2}}/|{NAME})"
FENCE = r"(?m)^[^\S\n]*(```|~~~)[^\n]*\n(?s:.*?)(?:^[^\S\n]*\1[`~]*[^\S\n]*$|\z)"
HEADING = r"(?m)^([^\S\n]*#{1,6}[^\S\n][^\n]*)$"
BULLET = r"(?m)^([^\S\n]*[-*+•‣◦][^\S\n]+[^\n]*)$"
NUMBER = r"(?m)^([^\S\n]*\d{1,9}[.)][^\S\n]+[^\n]*)$"


def either(words: list[str]) -> str:
    return "|".join(w.replace(".", D).replace(" ", r"[\s\u00a0]?") for w in sorted(words, key=len, reverse=True))


def masked(text: Column) -> Column:
    """``text`` with placeholders for the marks that end nothing; same length.

    Every pattern begins with the mark itself, so that a text is scanned at the speed of a search for one character.
    """
    start = r"(?:^|[^\p{L}\p{N}_])"
    inner = [
        r"(?=[/\\_\p{N}])",  # decimals, versions, paths
        r"(?=\.?[/\\])",
        r"(?=[\p{Ll}_])(?<=[\p{IsLatin}\p{N}_)\]]\.)",  # identifiers, file names, domains
        r"(?=\p{L}\.)(?<=(?:^|[^\p{L}\p{N}])\p{L}\.)",  # U.S., a.m., π.χ.
        r"(?=\p{Lu}[\p{L}\p{N}_]*[(.])(?<=[\p{L}\p{N}_]\.)",  # pkg.Name(
    ]
    other = [
        rf"(?<={start}(?iu:" + either(NEVER + SPACED) + r")\.)",
        rf"(?=\s*\p{{N}})(?<={start}(?iu:" + either(NUMBERED) + r")\.)",
        rf"(?=[\s\u00a0]?(?:B|h|a|Ä|U|ex|ej|е|к|н|д|п){D})(?<={start}[zZdDuUoOpPтТ]\.)",
        rf"(?=[\s\u00a0]UU)(?<={start}EE\.)",
        rf"(?=\s+\p{{Lu}})(?<={start}(?:" + "|".join(TITLES) + r")\.)",
        rf"(?=[\s\u00a0]?\p{{Lu}}(?:\p{{Ll}}|{D}))(?<=(?:^|[^\p{{L}}\p{{N}}_{DOT}])[A-HJ-ZА-ЯΑ-Ω]\.)",  # initials
        rf"(?=\s+\p{{Lu}})(?<={start}(?iu:" + "|".join(ORDINAL) + r")[\s\u00a0]\p{N}{1,2}\.)",
        rf"(?=\s+[\p{{Ll}}\p{{N}}])(?<=[{DOT}]\p{{L}}\.)",
    ]
    for pattern, by in [
        ("[\ue000-\ue0ff]", "x"),
        (r"\r(?!\n)", "\n"),
        (r"(?U)\.(?:" + "|".join(inner) + ")", DOT),
        (r"\?(?=[\p{IsLatin}_]+=)", ASK),  # queries of URLs
        (r"(?U)\.(?:" + "|".join(other) + ")", DOT),
        (r"(?U)\.\.\.(?=\s+\p{Ll})", DOT * 3),
    ]:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(by))
    return text


def blocks(mask: Column) -> Column:
    """An array of blocks: fenced code, headings, list items, and what lies between blank lines."""

    def inner(part: Column) -> Column:
        # a fence keeps only its own lines: the separator behind it leaves the line break to the next part
        part = F.regexp_replace(part, F.lit(r"(\n[^\S\n]*)(?=\n)"), F.lit("$1" + SEP))
        for pattern in (HEADING, BULLET):
            part = F.regexp_replace(part, F.lit(pattern), F.lit(SEP + "$1" + SEP))
        return F.split(part, SEP)

    parts = F.split(F.regexp_replace(mask, F.lit(FENCE), F.lit(SEP + "$0" + SEP)), SEP)
    return F.flatten(F.transform(parts, lambda p: F.when(p.rlike(r"^[^\S\n]*(?:```|~~~)"), F.array(p)).otherwise(inner(p))))


def pieces(block: Column) -> Column:
    """An array of the units of one block, still with the white space around them."""
    unit = block.rlike(r"^\s*(?:```|~~~|#{1,6}[^\S\n]|[-*+•‣◦][^\S\n])")
    listed = F.split(F.regexp_replace(block, F.lit(NUMBER), F.lit(SEP + "$1" + SEP)), SEP)
    steps = [
        # marks of scripts without spaces; quotes there end a sentence only where a colon led to them
        (r"([：:][“「『《\"][^”」』》\"" + SEP + r"]{0,2000}[。！？!?｡][”」』》\"])(?=[^\s と라이가는를を、，。,.!?！？）」』”])", "$1" + SEP),
        # a Japanese quotation that no particle ties to what follows is a sentence of its own
        (r"[。！？!?｡]+[」』]+(?!と|って|は|が|を|の|に)(?=[^\s」』）、。,.!?！？" + SEP + "])", "$0" + SEP),
        (r"[。！？｡।॥]+(?=[^\s。！？｡।॥" + CLOSE[1:-1] + SEP + "])", "$0" + SEP),
        (r"[。！？｡]+(?=[“‘])", "$0" + SEP),
        (r"[!?]+(?<=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}][!?]{1,3})(?=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}])", "$0" + SEP),
        (r"(?U)[。！？｡।॥]+" + CLOSERS + r"(?=\s+\S)", "$0" + SEP),
        # marks before a space; Greek asks with a semicolon
        (r"(?U)(?:[" + ENDS + "]+" + CLOSERS + r")+(?=\s+" + NEXT + ")", "$0" + SEP),
        (r"(?U);(?<=\p{IsGreek}[»\"”)]?;)" + CLOSERS + r"(?=\s+" + NEXT + ")", "$0" + SEP),
        (r"(?U)[.!?؟]+(?<=[\p{Lo}\p{M}][.!?؟]{1,3})(?=\s+\S)", "$0" + SEP),
        # adjoining sentences without a space
        (r"(?U)[.!?؟]+(?<=[\p{Ll}\p{N})][.!?؟]{1,3})(?=\p{Lu}\p{Ll}*[\s,])", "$0" + SEP),
        # Thai
        (r"[\s\u00a0]+(?=\p{IsThai})(?<=\p{IsThai}[\s\u00a0]{1,4})", SEP + "$0"),
    ]
    prose = block
    for pattern, by in steps:
        prose = F.regexp_replace(prose, F.lit(pattern), F.lit(by))
    return F.when(unit, F.array(block)).when(block.rlike(r"^\s*\d{1,9}[.)][^\S\n]"), listed).otherwise(F.split(prose, SEP))


def running(items: Column) -> Column:
    """Of a short array of numbers, what those ahead of each one sum up to; the growing array is copied at each step."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(items, empty, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))["all"]


def with_starts(rows: DataFrame, keep: list[str], parts: str, to: str) -> DataFrame:
    """Each string of the array ``parts`` as a row with a struct (start, part), where it is not blank.

    Lengths are summed in groups of about the cube root of their count and the groups after one another: n to the power 4/3 in all.
    Every array is a column before a function over another one reads it, as it would be made anew for each element otherwise.
    """
    size = F.size(parts)
    width = F.greatest(F.lit(16), F.ceil(F.cbrt(size)).cast("int"))
    lengths = rows.select(*keep, parts, F.transform(parts, lambda p: F.length(p)).alias("__lengths"), width.alias("__width"))
    groups = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size), F.col("__width")), lambda i: F.slice("__lengths", i, F.col("__width")))
    many = size > 64
    grouped = lengths.select(*keep, parts, "__lengths", F.when(many, groups).alias("__groups"))
    sums = grouped.select(*keep, parts, "__lengths", "__groups", F.when(many, F.transform("__groups", lambda g: F.aggregate(g, F.lit(0), lambda s, n: s + n))).alias("__sums"))
    starts = F.flatten(F.zip_with("__groups", running(F.col("__sums")), lambda g, at: F.transform(running(g), lambda x: x + at)))
    starts = F.when(many, starts).otherwise(running(F.col("__lengths")))
    out = sums.select(*keep, F.explode(F.arrays_zip(starts.alias("start"), F.col(parts).alias("part"))).alias(to))
    return out.filter(F.col(f"{to}.part").rlike(r"(?U)\S"))


def sentences(df: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
    """(key_cols, start_pos, end_pos, sentence) of each unit; ``sentence`` is the piece with its placeholders turned back.

    A lone CR reads as LF and a private-use character as x in ``sentence``; positions are those of the text itself.
    """
    rows = df.filter(F.col(text_col).rlike(r"(?U)\S")).select(*key_cols, masked(F.col(text_col)).alias("__mask"))
    # arrays are made one step before they are used twice, so that nothing is worked out twice
    rows = rows.select(*key_cols, blocks(F.col("__mask")).alias("__parts"))
    rows = with_starts(rows, key_cols, "__parts", "__b")
    rows = rows.select(*key_cols, F.col("__b.start").alias("__base"), pieces(F.col("__b.part")).alias("__parts"))
    rows = with_starts(rows, [*key_cols, "__base"], "__parts", "__u")
    part = F.col("__u.part")
    rows = rows.select(*key_cols, (F.col("__base") + F.col("__u.start") + F.length(part)).alias("__end"), F.regexp_replace(part, F.lit(r"(?U)^\s+"), F.lit("")).alias("__bare"))
    rows = rows.select(*key_cols, (F.col("__end") - F.length("__bare")).cast("bigint").alias("start_pos"), F.regexp_replace("__bare", F.lit(r"(?U)\s+$"), F.lit("")).alias("__bare"))
    return rows.select(*key_cols, "start_pos", (F.col("start_pos") + F.length("__bare")).cast("bigint").alias("end_pos"), F.translate("__bare", DOT + ASK, ".?").alias("sentence"))


def p10_found(spark: SparkSession, directory: str) -> DataFrame:
    return sentences(table(spark, directory, "documents").select("doc_id", "text"), ["doc_id"]).select("doc_id", "start_pos", "end_pos")


def p10_sentences(spark: SparkSession, directory: str) -> DataFrame:
    return sentences(table(spark, directory, "documents").select("doc_id", "text"), ["doc_id"])


QUERIES = {"p10_found": p10_found, "p10_sentences": p10_sentences}
SQL: dict[str, str] = {}
