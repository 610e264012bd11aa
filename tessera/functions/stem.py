"""The Porter stemmer (published 1980), for distinct terms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The suffixes of the published steps 2 to 4.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in "aeiou" and (c != "y" or i == 0 or not out[i - 1]))
    return out


def measure(word: str) -> int:
    kinds = consonants(word)
    return sum(kinds[i] and not kinds[i - 1] for i in range(1, len(kinds)))


def has_vowel(word: str) -> bool:
    return not all(consonants(word))


def short_end(word: str) -> bool:
    kinds = consonants(word)
    return len(word) >= 3 and kinds[-1] and not kinds[-2] and kinds[-3] and word[-1] not in "wxy"


def double_end(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and consonants(word)[-1]


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double_end(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short_end(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for steps in (STEP2, STEP3):
        for end, by in sorted(steps, key=lambda s: -len(s[0])):
            if w.endswith(end):
                if measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + by
                break
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            head = w[: -len(end)]
            if measure(head) > 1 and (end != "ion" or head[-1:] in ("s", "t")):
                w = head
            break
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem_column(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: stem(t) if t is not None else None)


def stemmed(postings: DataFrame, term: str = "term") -> DataFrame:
    """``postings`` with stemmed terms: only distinct terms go through Python."""
    distinct = postings.select(term).distinct().withColumn("__stem", stem_column(F.col(term)))
    return postings.join(distinct, term).drop(term).withColumnRenamed("__stem", term)


def stem_words(column: Column) -> Column:
    return stem_column(column)
