"""Queries about query strings: words, intent, focus, synonyms, parts, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import query as Q
from tessera.functions import text as X
from tessera.plans.relational import symbols

LOG = [
    (1, "how does the auth flow connect to the cache layer"), (2, "fix the error in drainRetry"), (3, "refactor session token handling and validate the schema"), (4, "drainRetry"), (5, "who clears the retry queue"),
    (6, "overview"), (7, "add a route handler for snapshot uploads"), (8, "where is the journal"), (9, "optimize database query index"), (10, "partial snapshot rotate size of each sealed segment"), (11, ""), (12, "test coverage for the graph traversal"),
    (13, "end-to-end lease renewal"), (14, "src/core/lease.ts:Journal.rotate"), (15, "/retry\\w+/i"), (16, "LeaseTable.renew expires"),
]


def log(s: SparkSession) -> DataFrame:
    return s.createDataFrame(LOG, "query_id int, query string")


def spaced(words: F.Column) -> F.Column:
    return F.array_join(words, " ")


def query_classes(s, d):
    """Intent, terms, verbs, focus, implied modules and the budget's multiplier of each query of a log."""
    q = F.col("query")
    return log(s).select("query_id", Q.intent(q).alias("intent"), spaced(Q.terms(q)).alias("terms"), spaced(Q.verbs(q)).alias("verbs"), spaced(Q.focus_terms(q)).alias("focus"), spaced(Q.modules(q)).alias("modules"), Q.budget_multiplier(q).alias("multiplier"))


def query_focus(s, d):
    """Which things a query is about: tests, configuration, types, interface, documents, runtime."""
    words = Q.terms(F.col("query"))
    return log(s).select("query_id", *[Q.has_any(words, known.split()).alias(name) for name, known in Q.FOCUS.items()])


def query_synonyms(s, d):
    return log(s).select("query_id", spaced(Q.synonyms(Q.terms(F.col("query")))).alias("words"))


def query_coverage_groups(s, d):
    groups = Q.coverage_groups(Q.terms(F.col("query")))
    return log(s).select("query_id", F.posexplode(groups).alias("place", "words")).select("query_id", F.col("place").cast("bigint").alias("place"), spaced(F.col("words")).alias("words"))


def query_prose(s, d):
    return log(s).select("query_id", Q.is_broad_prose(F.col("query")).alias("broad"), Q.is_natural(F.col("query")).alias("natural"), Q.class_of(F.col("query"), F.col("query_id") * 5).alias("class"))


def query_hypothetical(s, d):
    return log(s).select("query_id", Q.hypothetical(F.col("query")).alias("code"))


def query_parts(s, d):
    """Sub-queries of each query, with their shares of the budget."""
    return log(s).select("query_id", F.explode(Q.parts(F.col("query"))).alias("p")).select("query_id", F.col("p.priority").cast("bigint").alias("priority"), spaced(F.col("p.terms")).alias("terms"), F.round("p.share", 6).alias("share"))


def query_threes(s, d):
    groups = Q.in_threes(Q.split_terms(F.split(F.regexp_replace("query", r"[^A-Za-z0-9_\s]", " "), r"\s+")))
    return log(s).select("query_id", F.posexplode(groups).alias("place", "g")).select("query_id", F.col("place").cast("bigint").alias("place"), spaced(F.col("g")).alias("words"))


def query_references(s, d):
    """Paths, owners and names of references, and expressions between slashes."""
    path, owner, name = Q.reference(F.col("query"))
    expression, flags = Q.delimited(F.col("query"))
    return log(s).select("query_id", path.alias("path"), owner.alias("owner"), name.alias("name"), expression.alias("expression"), flags.alias("flags"))


def query_search_words(s, d):
    return log(s).select("query_id", F.array_join(Q.search_words(F.col("query")), " OR ").alias("pattern"))


def action_signal(s, d):
    """Symbols whose name or signature holds a verb of action."""
    text = F.lower(F.concat_ws(" ", "name", "signature"))
    return symbols(s, d, "name", "signature", "kind").filter(text.rlike("|".join(Q.ACTIONS))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (query_classes, query_focus, query_synonyms, query_coverage_groups, query_prose, query_hypothetical, query_parts, query_threes, query_references, query_search_words, action_signal)}


def words_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def map_sql(pairs: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def distinct(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


L = "(values " + ", ".join("({}, '{}')".format(i, q.replace("'", "''")) for i, q in LOG) + ") q(query_id, query)"
RAW = "list_filter(string_split_regex(regexp_replace(query, '[^a-zA-Z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1)"
KNOWN = f"""k as (select query_id, query, list_filter({RAW}, lambda w: not list_contains({words_sql(Q.STOP)}, lower(w))) c from {L}),
k1 as (select *, list_transform(c, lambda w: lower(w)) lc from k),
k2 as (select *, list_filter(lc, lambda w: list_contains({words_sql(Q.VERBS)}, w)) v0, list_filter(lc, lambda w: not list_contains({words_sql(Q.VERBS + Q.ASKING)}, w)) t0, list_filter(c, lambda w: not list_contains({words_sql(Q.VERBS + Q.ASKING)}, lower(w)) and (regexp_matches(w, '[A-Z_]') or length(w) >= 7)) m0 from k1),
k3 as (select *, {distinct('v0')} v, {distinct('t0')} t, list_transform(m0, lambda w: lower(w)) m1 from k2),
k4 as (select *, case when regexp_full_match(trim(query), '[a-zA-Z_$][a-zA-Z0-9_$]*') then 'symbol-lookup' when list_has_any(t, {words_sql(Q.DEBUG)}) then 'debug' when len(v) > 0 then 'task' when list_has_any(t, {words_sql(Q.BROAD)}) or regexp_matches(lower(query), 'end.to.end') then 'broad' when list_has_any(lc, {words_sql(Q.ASKING)}) and len(t) < 5 then 'narrow' when len(t) >= 5 then 'broad' else 'narrow' end intent, {distinct('m1')} m from k3),
k5 as (select *, case when len(m) > 0 then m else t[1:(case when intent = 'task' then 3 else 2 end)] end f from k4)"""
MODULES_SQL = "list_filter([" + ", ".join(f"{{'m': '{m}', 'w': {words_sql([m, *w.split()])}}}" for m, w in Q.MODULES.items()) + "], lambda e: list_contains(e.w, x))"
SYN = "map {" + ", ".join(f"'{k}': {words_sql(v)}" for k, v in Q.SYNONYMS.items()) + "}"
SQL = {
    "query_classes": f"""with {KNOWN}, k6 as (select *, list_transform(flatten(list_transform(t, lambda x: {MODULES_SQL})), lambda e: e.m) mm from k5)
select query_id, intent, array_to_string(t, ' ') terms, array_to_string(v, ' ') verbs, array_to_string(f, ' ') focus, array_to_string({distinct('mm')}, ' ') modules, case intent when 'symbol-lookup' then 0.75 when 'narrow' then 1 when 'debug' then 1.25 when 'broad' then 1.5 else 2 end::double multiplier from k6""",
    "query_focus": f"with {KNOWN} select query_id, " + ", ".join(f"list_has_any(t, {words_sql(w.split())}) as \"{n}\"" for n, w in Q.FOCUS.items()) + " from k3",
    "query_synonyms": f"with {KNOWN}, s as (select query_id, list_concat(t, flatten(list_transform(t, lambda w: coalesce({SYN}[w], [])))) a from k3) select query_id, array_to_string({distinct('a')}, ' ') words from s",
    "query_coverage_groups": f"with {KNOWN}, s as (select query_id, unnest(t) w, generate_subscripts(t, 1) - 1 place from k3) select query_id, place, array_to_string(list_concat([w], coalesce({SYN}[w], [])), ' ') words from s",
    "query_prose": f"""with a as (select query_id, query, string_split_regex(trim(query), '\\s+') w, list_filter(string_split_regex(regexp_replace(lower(query), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 1) c from {L})
select query_id, len(w) > 3 and not regexp_matches(query, '[a-z][A-Z]|[a-z]_[a-z]') broad, not regexp_matches(query, '[a-z][A-Z]|[a-z]_[a-z]|\\w\\.\\w') and len(w) > 2 and len(list_filter(w, lambda x: not list_contains({words_sql(Q.PLAIN_STOP)}, lower(x)))) >= 2 as natural,
case when list_has_any(c, {words_sql(Q.VERBS)}) then 'task' when len(c) <= 3 and query_id * 5 <= 30 then 'narrow' else 'broad' end as class from a""",
    "query_hypothetical": f"""with a as (select query_id, query, list_filter(string_split_regex(regexp_replace(lower(query), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 1 and not list_contains({words_sql(Q.PLAIN_STOP)}, x)) w from {L}),
b as (select *, list_filter(w, lambda x: {map_sql(dict(p.split(':') for p in Q.VERB_FORMS.split()))}[x] is null) n, list_filter(list_transform(w, lambda x: {map_sql(dict(p.split(':') for p in Q.VERB_FORMS.split()))}[x]), lambda x: x is not null) f from a), c as (select *, coalesce(f[-1], 'handle') v from b)
select query_id, case when len(n) > 0 then 'function ' || v || array_to_string(list_transform(n, lambda x: upper(x[1]) || x[2:]), '') || '(' || n[1] || ': any): any {{ /* ' || v || ' ' || array_to_string(n, ' ') || ' - ' || query || ' */ }}' else query end code from c""",
    "query_references": f"""with a as (select query_id, query, regexp_extract(query, '^(.*?\\.[A-Za-z0-9]+):{{1,2}}', 1) path from {L}), b as (select *, case when path <> '' then regexp_replace(query, '^.*?\\.[A-Za-z0-9]+:{{1,2}}', '') else query end rest from a)
select query_id, path, regexp_extract(rest, '^(.*)\\.[^.]*$', 1) as owner, regexp_extract(rest, '([^.]*)$', 1) as name, case when regexp_full_match(query, '/.+/[a-z]*') then regexp_extract(query, '^/(.+)/([a-z]*)$', 1) else query end expression, regexp_extract(query, '^/(.+)/([a-z]*)$', 2) flags from b""",
    "query_search_words": f"select query_id, array_to_string(list_filter(string_split_regex(trim(regexp_replace(query, '[^A-Za-z0-9_\\s]', ' ', 'g')), '\\s+'), lambda w: length(w) >= 2), ' OR ') as pattern from {L}",
    "action_signal": "select kind, count(*) n from (select distinct * from symbols) where regexp_matches(lower(concat_ws(' ', name, signature)), '" + "|".join(Q.ACTIONS) + "') group by kind",
}
