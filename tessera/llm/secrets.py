"""Credentials written out in source code: found and masked without breaking the code around them.

1. A keyword automaton runs over each text once; only the lines it hits are looked at further.
2. On those lines, expressions of issuers' formats, private-key blocks, URLs, headers and assignments to names that
   speak of credentials give candidates, also when split over one expression, encoded, in comments or as the fallback of
   an environment lookup.
3. Candidates are validated: by structure (a signed token's parts decode to JSON, a Basic header to user and password, formats
   have their lengths and alphabets) and against placeholders, masks, environment references, digests, search patterns and plain words.
4. Each secret is replaced by text of the same length and alphabet (letters by x or X, digits by 0, all else as it is).

Defined results: null and empty texts have none; texts without a finding come back unchanged; lines keep their breaks; of repeated rows each
is treated alike, and the found rows are distinct. Texts of any length are read whole, and so are
key blocks. Where an issuer's format ends with a checksum (``checksum_holds``), a token with a good one needs no further signs; one with a wrong checksum
still has to look random, as it may be damaged or of an older format, and a real secret must not stay readable.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import string
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

#: Formats of issuers.
FORMATS = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?P<aws>(?:AKIA|ASIA)[A-Z0-9]{16})|(?P<gh>gh[pousr]_[A-Za-z0-9]{36,})|(?P<ghfine>github_pat_[A-Za-z0-9_]{50,})|(?P<slack>xox[abeoprs]-[A-Za-z0-9-]{20,})"
    r"|(?P<pay>[sr]k_live_[A-Za-z0-9]{16,})|(?P<map>AIza[A-Za-z0-9_-]{35})|(?P<lab>glpat-[A-Za-z0-9_-]{20,})|(?P<npm>npm_[A-Za-z0-9]{36})|(?P<mail>SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})"
    r"|(?P<hub>hf_[A-Za-z0-9]{30,})|(?P<drop>dop_v1_[a-f0-9]{64})|(?P<model>sk-(?:ant|proj|svcacct|or)-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9]{20}T3BlbkFJ[A-Za-z0-9]{20})|(?P<index>pypi-AgE[A-Za-z0-9_-]{50,})"
    r"|(?P<shop>shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32})|(?P<till>sq0(?:atp|csp|idp)-[A-Za-z0-9_-]{22,})|(?P<hooksign>whsec_[A-Za-z0-9+/=_-]{24,})|(?P<oauth>GOCSPX-[A-Za-z0-9_-]{28})|(?P<bricks>dapi[a-f0-9]{32})|(?P<vault>hv[sb]\.[A-Za-z0-9_-]{24,})"
    r"|(?P<chat>\d{8,10}:AA[A-Za-z0-9_-]{33})|(?P<age>AGE-SECRET-KEY-1[0-9A-Z]{58})|(?P<linear>lin_api_[A-Za-z0-9]{32,})|(?P<atlas>ATATT3[A-Za-z0-9_=-]{20,})|(?P<jwt>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}))(?![A-Za-z0-9_])"
)
#: Words in a name that speak of a credential, and words that tell it is something about one.
SECRET_WORDS = set("password passwd pwd passphrase pass pw secret secrets token apikey accesskey credential credentials bearer auth authorization signing hmac jwt passcode".split())
KEY_WORDS = set("api access private secret signing encryption auth client shared service account ssh master".split())
ABOUT_WORDS = set("hint policy ref reference name names pattern regex mask masked label integrity checksum digest hash public verify verifier verification env type kind field placeholder example fingerprint expiry ttl".split())
#: Keywords of the automaton, lower case: all words that the steps after it accept (each name with a key word holds "key"), and the formats' beginnings.
KEYWORDS = sorted(SECRET_WORDS | set(
    "key credential connect login log_in signin sign_in pair signature sig= ://  begin end private akia asia ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ xox sk_live_ rk_live_ sk-ant- sk-proj- sk-svcacct- sk-or- t3blbkfj pypi-age shpat_ shpca_ shppa_ shpss_ sq0 whsec_ gocspx- dapi hvs. hvb. :aa lin_api_ atatt3 hooks.slack.com discord eyj aiza glpat- npm_ sg. hf_ dop_v1_ basic connection cookie encryption".split()
))
#: What stands where a secret should be.
PLACEHOLDER = re.compile(
    r"(?i)your[-_ ]?|example|change[-_ ]?(?:me|it|this)|replace[-_ ]?(?:me|this|with)?|placeholder|dummy|redacted|insert[-_ ]|todo|fixme|to[-_ ]be[-_ ]set|not[-_ ]?set|fake|<[^>]*>|\$\{|\{\{|\$\(|%\(|%s|\.\.\.|^\$[A-Za-z_]\w*$|^\{[^}]*\}$"
    r"|^(?:password|passwd|pass|secret|token|none|null|true|false|undefined|user|admin|root|guest|test|string|bearer|basic|default|empty|unknown|hidden|internal)$|^[*•xX.#_-]+$|^(.)\1{5,}|x{5,}|X{5,}|\*{3,}|^vault:|^(?:env|aws|gcp|vault|ssm|op)://"
)
DIGEST = re.compile(r"^(?:sha\d{1,3}|md5|blake2[bs]?)[-:_=]", re.IGNORECASE)
SEARCH = re.compile(r"\[[^\]]{1,40}\][{+*?]|\.[+*]|\\[dwsb]|\(\?")
PHRASE = re.compile(r"[a-z]+(?:[-_.][a-z]+){2,}[-_.]?\d{2,}[!@#$%]?")
LITERAL = re.compile(r'[rbufRBUF]{0,2}(?:"""(?P<t>[^"]*)"""|"(?P<d>(?:[^"\\\n]|\\.)*)"|\'(?P<s>(?:[^\'\\\n]|\\.)*)\'|`(?P<b>[^`]*)`)')
NAME = re.compile(r"(?P<name>[A-Za-z_$][\w$.-]*)(?P<q>[\"']?)\s*\]?\s*(?P<type>:\s*&?(?:'static\s+)?[A-Za-z_][\w<>\[\]]*\s*(?==[^=>]))?(?P<op>:=|=>|=(?![=>~])|:(?![:/=]))[ \t]*")
CALL = re.compile(r"(?:new\s+)?(?P<f>[A-Za-z_][\w.:]*!?)\s*\(\s*")
FALLBACK = re.compile(r"[\w.\[\]\"'()]*(?:\b|\]|\))\s*(?:\|\||\?\?|\bor\b)\s*")
URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://(?P<user>[^\s:/@\"'`<>]*):(?P<pass>[^\s@/\"'`<>]+)@")
QUERY = re.compile(r"[?&](?:(?:api[-_]?)?key|access[-_]?(?:key|token)|auth(?:[-_]token)?|token|secret|password|pwd|sig|signature|client_secret)=(?P<v>[^&\s\"'`#<>]+)", re.IGNORECASE)
#: Addresses of web hooks, whose last part lets anyone post.
HOOK = re.compile(r"\bhooks\.slack\.com/(?:services|workflows)/T[A-Z0-9]{6,}/[AB][A-Z0-9]{6,}/(?P<v>[A-Za-z0-9]{16,})|\bdiscord(?:app)?\.com/api/webhooks/\d{15,}/(?P<w>[A-Za-z0-9_-]{40,})")
HEADER = re.compile(r"\b(?P<kind>Basic|Bearer|Token|token|bearer|basic)\s+(?P<v>[A-Za-z0-9+/_.~=-]{12,})")
NAMED_HEADER = re.compile(r"[\"']?\b(?:X-[A-Za-z-]*(?:Token|Key|Auth|Secret)|Authorization|PRIVATE-TOKEN)[\"']?\s*[:=,]\s*[\"']?(?P<v>[^\s\"',;]{12,})", re.IGNORECASE)
LOGIN = re.compile(r"\b(?:login|log_in|logIn|signIn|sign_in|authenticate|connect|auth|basicAuth|basic_auth)\(\s*")
COMMENT = re.compile(r"(?i)(?:^|\s)(?://|#|/\*|\*|--|<!--|;)\s.*?\b(?:pw|password|passwd|pwd|passphrase|secret|token|key|credentials?)\b[^:=\n]*[:=]\s*(?P<v>[^\s\"'`,;]+)")
BEGIN_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
END_KEY = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: What a key block holds between its marks: escapes and line breaks, headers, and runs of its body.
BLOCK_PART = re.compile(r"(?P<break>\\[nrt\\\"']|[\s\"'`+,;.()\[\]\\]+|//|#|\*)|(?P<header>[A-Z][A-Za-z-]+: [^\n\\\"']*)|(?P<body>[A-Za-z0-9+/=]+)|(?P<other>.)")
UNQUOTED = re.compile(r"[^\s\"'`#{}\[\](),;|>]+(?=\s*(?:#.*)?$)")

AUTOMATON = ahocorasick.Automaton()
for _word in KEYWORDS:
    AUTOMATON.add_word(_word, len(_word))
AUTOMATON.make_automaton()


def words_of(name: str) -> list[str]:
    return re.findall(r"[a-z]+|\d+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", name)).lower())


def speaks_of_credential(name: str) -> bool:
    words = words_of(name.rsplit(".", 1)[-1])
    known = set(words)
    if known & ABOUT_WORDS:
        return False
    return bool(known & SECRET_WORDS) or ("key" in known and bool(known & KEY_WORDS))


def decoded(value: str) -> str | None:
    try:
        raw = base64.b64decode(value.replace("-", "+").replace("_", "/") + "=" * (-len(value) % 4), validate=True).decode()
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None
    return raw if raw.isprintable() else None


def strong(value: str, phrase: bool = True) -> bool:
    """Whether the value can be a real password, key or token."""
    if not 8 <= len(value) or PLACEHOLDER.search(value) or DIGEST.match(value) or SEARCH.search(value) or re.search(r"\s", value):
        return False
    if phrase and PHRASE.fullmatch(value):
        return True
    digits, lower, upper = (bool(re.search(p, value)) for p in ("[0-9]", "[a-z]", "[A-Z]"))
    marks = bool(re.search(r"[^A-Za-z0-9_.-]", value))
    if re.fullmatch(r"[A-Z][A-Z0-9_]*", value) and "_" in value or len(set(value)) < 5:
        return False
    if re.fullmatch(r"[0-9a-fA-F]+", value):
        return len(value) >= 20 and digits and (lower or upper)
    if digits and (lower or upper):
        plain = re.fullmatch(r"[a-z]+(?:[-_.][a-z0-9]+)*|v?\d+(?:\.\d+)+\S*", value)
        return (marks or lower and upper or len(value) >= 16) and not (plain and not marks and len(value) < 24)
    return lower and upper and len(value) >= 24 and len(set(value)) >= 14 and not re.fullmatch(r"(?:[A-Z]?[a-z]+)+", value)


def checksum_holds(value: str) -> bool:
    """Whether the last six characters of a token of the code host's or package index's format are the CRC-32 of what lies before, in base 62."""
    body = value.split("_", 1)[1] if "_" in value else ""
    if len(body) != 36 or not body.isalnum():
        return False
    rest, digits = zlib.crc32(body[:-6].encode()), ""
    while rest:
        rest, digit = divmod(rest, 62)
        digits = (string.digits + string.ascii_uppercase + string.ascii_lowercase)[digit] + digits
    return digits.rjust(6, "0") == body[-6:]


def signed_token(value: str) -> bool:
    parts = value.split(".")
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in parts[:2])
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and ("alg" in head or "typ" in head)


def basic_pair(value: str) -> bool:
    raw = decoded(value)
    if raw is None or ":" not in raw:
        return False
    secret = raw.split(":", 1)[1]
    return len(secret) >= 6 and not PLACEHOLDER.search(secret) and bool(re.search(r"[0-9\W]", secret))


def literal(m: re.Match) -> tuple[int, int, str]:
    group = next(g for g in "tdsb" if m.group(g) is not None)
    return m.start(group), m.end(group), m.group(group)


def read_value(text: str, at: int, line_end: int, op: str) -> tuple[list[tuple[int, int]], str, str]:
    """Spans, joined value and kind (plain, encoded, none) of the expression that starts at ``at``."""
    lead = FALLBACK.match(text, at, line_end)
    if lead and lead.end() > at and LITERAL.match(text, lead.end()):
        at = lead.end()
    m = LITERAL.match(text, at)
    if m:
        spans = [literal(m)]
        while True:
            glue = re.compile(r"\s*(?:\+|\\\r?\n|\.\s*(?=[\"'])|\|\|(?=\s*['\"]))?\s*").match(text, m.end())
            following = LITERAL.match(text, glue.end()) if glue and glue.end() > m.end() and ("+" in glue.group() or "\\" in glue.group() or "\n" not in glue.group()) else None
            if not following:
                break
            m = following
            spans.append(literal(m))
        return [(a, b) for a, b, _ in spans], "".join(v for _, _, v in spans), "plain"
    call = CALL.match(text, at, line_end + 1)
    if call:
        found, position = [], call.end()
        while True:
            m = LITERAL.match(text, position)
            if not m:
                break
            found.append(literal(m))
            position = re.compile(r"\s*[,+]?\s*").match(text, m.end()).end()
        name = call.group("f").lower()
        if not found:
            inner = CALL.match(text, call.end(), line_end + 1)
            return read_value(text, call.end(), line_end, op) if inner else ([], "", "none")
        if "env" in name or name.endswith((".get", "getproperty", "get_or", "getordefault", "lookup")):
            return ([found[1][:2]], found[1][2], "plain") if len(found) > 1 else ([], "", "none")
        joined = "".join(v for _, _, v in found)
        if "read" in name or "prompt" in name or "vault" in name or "fetch" in name or "compile" in name:
            return [], "", "none"
        if "atob" in name or "decode" in name or "b64" in name or "base64" in name or "unhex" in name:
            return [(a, b) for a, b, _ in found], joined, "encoded"
        return [(a, b) for a, b, _ in found], joined, "plain"
    if op == ":":
        m = UNQUOTED.match(text, at, line_end)
        if m:
            return [(m.start(), m.end())], m.group(), "plain"
    listed = re.compile(r"[\[(]\s*").match(text, at)
    if listed:
        found, position = [], listed.end()
        while m := LITERAL.match(text, position):
            found.append(literal(m))
            position = re.compile(r"\s*[,+]?\s*").match(text, m.end()).end()
        if found and re.compile(r"\s*[\])]\s*\.\s*(?:join|concat)").match(text, position):
            return [(a, b) for a, b, _ in found], "".join(v for _, _, v in found), "plain"
        if found and text[listed.start()] == "(":
            return [(a, b) for a, b, _ in found], "".join(v for _, _, v in found), "plain"
    return [], "", "none"


def findings(text: str) -> list[tuple[int, int]]:
    """The spans of ``text`` that hold secrets, sorted and disjoint."""
    lower = text.lower()
    if len(lower) != len(text):  # a few letters change their length
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans: list[tuple[int, int]] = []
    done = -1
    for position, _ in AUTOMATON.iter(lower):
        if position <= done:
            continue
        start = text.rfind("\n", 0, position) + 1
        end = text.find("\n", position)
        done = end = len(text) if end < 0 else end
        spans += line_findings(text, start, end)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(x for x in spans if x[1] > x[0]):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def line_findings(text: str, start: int, end: int) -> list[tuple[int, int]]:
    line = text[start:end]
    if "-----" in line:
        spans = key_block(text, start, end, line)
        if spans:
            return spans
    if not re.search(r"[\"'`:=]", line):
        return []
    spans: list[tuple[int, int]] = []
    for m in FORMATS.finditer(text, start, end):
        value = m.group()
        if (signed_token(value) if m.group("jwt") else checksum_holds(value) or not PLACEHOLDER.search(value) and len(set(value)) > 9 and bool(re.search(r"\d", value))):
            spans.append(m.span())
    for m in URL.finditer(text, start, end):
        value = m.group("pass")
        if len(value) >= 6 and not PLACEHOLDER.search(value) and not re.fullmatch(r"[A-Z_]+|[a-z]+", value) and not value.startswith(("$", "%", "{")):
            spans.append(m.span("pass"))
    for m in QUERY.finditer(text, start, end):
        if strong(m.group("v")):
            spans.append(m.span("v"))
    for m in HOOK.finditer(text, start, end):
        if not PLACEHOLDER.search(m.group(m.lastgroup)):
            spans.append(m.span(m.lastgroup))
    for m in HEADER.finditer(text, start, end):
        value = m.group("v")
        if (basic_pair(value) if m.group("kind").lower() == "basic" else strong(value)):
            spans.append(m.span("v"))
    for m in NAMED_HEADER.finditer(text, start, end):
        if strong(m.group("v")):
            spans.append(m.span("v"))
    for m in COMMENT.finditer(text, start, end):
        value = m.group("v").rstrip(".)")
        if strong(value):
            spans.append((m.start("v"), m.start("v") + len(value)))
    for m in LOGIN.finditer(text, start, end):
        user = LITERAL.match(text, m.end())
        if user:
            comma = re.compile(r"\s*,\s*").match(text, user.end())
            password = LITERAL.match(text, comma.end()) if comma else None
            if password and strong(literal(password)[2]):
                spans.append(literal(password)[:2])
    for m in NAME.finditer(text, start, end):
        name = m.group("name")
        pairs = words_of(name)[-1:] in (["pair"], ["login"]) or "login" in words_of(name)
        if not speaks_of_credential(name) and not pairs:
            continue
        where, value, kind = read_value(text, m.end(), end, m.group("op"))
        if not where:
            continue
        if kind == "encoded":
            raw = decoded(value)
            good = basic_pair(value) or (raw is not None and strong(raw)) or (raw is None and strong(value))
        else:
            good = not pairs and not value.startswith(("Basic ", "Bearer ")) and "://" not in value and strong(value) or basic_pair(value)
        if good:
            spans += where
    return spans


def key_body(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The runs of a key's body from ``start`` on, whatever their length, to ``end`` or to what no key block holds.

    Words of the code around, which only follow a body, end it: a run below 16 characters counts if a separator ends it and a long one
    comes before it, or if the key's end mark follows.
    """
    body: list[tuple[int, int]] = []
    at = start
    while at < end and (m := BLOCK_PART.match(text, at, end)):
        at = m.end()
        if m.group("other"):
            break
        if m.group("body"):
            body.append(m.span("body"))
    whole = text.startswith("-----END", at) or at >= end and text.startswith("-----END", end)
    if not whole:  # the end mark is cut off: code may follow the last line, and a word of it may look like a body
        while body and (body[-1][1] - body[-1][0] < 16 or text[body[-1][1] : body[-1][1] + 1] in ("_", "-", ":", "{", "}", "<", ">", "!", "@", "$")):
            if len(body) > 1 and not re.search(r"[;{}()]|\n\s*\n", text[body[-2][1] : body[-1][0]]) and re.match(r"[\s\"'`\\]*(?:\Z|[\s\"'`]+[;,)]|\\)", text[body[-1][1] : body[-1][1] + 8]):
                break  # a short last line
            body.pop()
    return body


def key_block(text: str, start: int, end: int, line: str) -> list[tuple[int, int]]:
    """The body of a private key that begins or ends on this line, also if the other end is cut off."""
    m = BEGIN_KEY.search(line)
    if m:
        begin = start + m.end()
        stop = END_KEY.search(text, begin)
        other = text.find("-----BEGIN", begin)  # a block without an end does not reach into the next one
        limit = stop.start() if stop and not 0 <= other < stop.start() else other if other >= 0 else len(text)
        body = key_body(text, begin, limit)
        long = any(b - a >= 16 for a, b in body)
        return body if long and not PLACEHOLDER.search(text[begin : min(limit, begin + 60)].strip() or "...") else []
    m = END_KEY.search(line)
    if not m:
        return []
    last = text.rfind("-----BEGIN", 0, start + m.start())
    if last >= 0 and not text.find("-----END", last, start + m.start()) >= 0:
        return []  # its beginning is there and was masked from there
    body, at = [], start
    while at > 0:
        before = text.rfind("\n", 0, at - 1) + 1
        b = re.fullmatch(r"[\s\"'`+,]*([A-Za-z0-9+/=]+)(?:\\n|[\s\"'`+,])*", text[before : at - 1])
        if not b or len(b.group(1)) < 16 and body:
            break
        body.append((before + b.start(1), before + b.end(1)))
        at = before
    return body if sum(b - a >= 16 for a, b in body) >= 2 or len(body) >= 2 and body[-1][1] - body[-1][0] >= 48 else []


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with each span replaced by a placeholder of the same length and alphabet."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], re.sub("[0-9]", "0", re.sub("[a-z]", "x", re.sub("[A-Z]", "X", text[a:b])))]
        at = b
    return "".join(out) + text[at:]


def scanned(df: DataFrame, key_cols: list[str], text_col: str, keep_text: bool = True) -> DataFrame:
    """The rows with a secret: ``key_cols``, the number of secrets and, if ``keep_text``, the masked text."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                spans = findings(row[-1]) if isinstance(row[-1], str) else []
                if spans:
                    out.append((*row[:-1], len(spans), masked(row[-1], spans)) if keep_text else (*row[:-1], len(spans)))
            yield pd.DataFrame(out, columns=names)

    rows = df.filter(F.length(text_col) >= 8).select(*key_cols, F.col(text_col).alias("__text"))
    kinds = dict(rows.dtypes)
    names = [*key_cols, "secrets", *["masked"] * keep_text]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in key_cols) + ", secrets bigint" + (", masked string" if keep_text else "")
    return rows.mapInPandas(scan, schema)


def both(spark: SparkSession, directory: str, keep_text: bool) -> DataFrame:
    parts = []
    for name, column in (("symbols", "full_source"), ("chunks", "text")):
        rows = scanned(table(spark, directory, name).select(F.col("id").alias("row_id"), column), ["row_id"], column, keep_text)
        parts.append(rows.select(F.lit(name).alias("source_table"), *rows.columns))
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return both(spark, directory, keep_text=False).select("source_table", "row_id").distinct()


def p7_masked(spark: SparkSession, directory: str) -> DataFrame:
    return both(spark, directory, keep_text=True).dropDuplicates(["source_table", "row_id"])


QUERIES = {"p7_found": p7_found, "p7_masked": p7_masked}
SQL: dict[str, str] = {}
