"""The flagship: budgeted retrieval for a batch of queries, and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import query as Q
from tessera.operators import capsule as capsules
from tessera.operators import packing as P
from tessera.operators import rendering as R
from tessera.plans.graphs import links
from tessera.plans.relational import NOW, S, files, symbols
from tessera.plans.retrieval import ASKED, asked

BUDGET = 4000


def nodes(s, d):
    rows = symbols(s, d, "file_id", "name", "kind", "signature", "full_source", "start_line", "end_line", "is_exported", "visibility", "centrality", "last_seen")
    return rows.join(files(s, d, "path").withColumnRenamed("id", "file_id"), "file_id")


def _capsule(s, d):
    return capsules.capsule(nodes(s, d), links(s, d), asked(s), BUDGET, NOW)


def capsule(s, d):
    """What goes into each query's answer: symbols and lines about files, level of detail, tokens, place."""
    return _capsule(s, d)[0]


def capsule_report(s, d):
    """Confidence, uncertainty, what speaks against each answer, and where it lost most."""
    return _capsule(s, d)[1]


def capsule_session(s, d):
    """The same answers in a session that has returned the most central symbols before: those are told in one line."""
    known = symbols(s, d, "centrality").orderBy(F.desc("centrality"), "id").limit(200).select("id").crossJoin(F.broadcast(asked(s).select("query_id")))  # a stated set of queries
    return capsules.capsule(nodes(s, d), links(s, d), asked(s), BUDGET, NOW, recent=known)[0]


def capsule_merged(s, d):
    """Answers put together from the parts of each query: each packed in its share of the budget, then merged."""
    rows = understanding_parts(asked(s))
    packed, _ = capsules.capsule(nodes(s, d), links(s, d), rows.select("query_id", "query"), BUDGET, NOW)
    full = nodes(s, d).withColumnRenamed("id", "symbol_id").withColumn("sizes", R.tokens_of_levels())
    items = packed.filter("kind = 'symbol'").select("query_id", "symbol_id", "level", "position").join(full, "symbol_id").join(F.broadcast(rows.select("query_id", "whole", "sub", "share")), "query_id")
    items = items.select(F.col("whole").alias("query_id"), "sub", "share", "symbol_id", "file_id", "start_line", "end_line", (1.0 / (1 + F.col("position"))).alias("score"), "level", "sizes", F.when(F.col("level") == 0, 0).otherwise(1).alias("distance"), "path", "name")
    return P.merge_queries(items, BUDGET)


def understanding_parts(queries):
    """(query_id, query, whole, sub, share): the parts of each query as queries of their own."""
    rows = queries.select(F.col("query_id").alias("whole"), F.explode(Q.parts(F.col("query"))).alias("p"))
    return rows.select((F.col("whole") * 10 + F.col("p.priority")).cast("int").alias("query_id"), F.array_join("p.terms", " ").alias("query"), "whole", F.col("p.priority").alias("sub"), F.col("p.share").alias("share"))


def node_scores(s, d):
    """Every symbol's score as a pivot in debugging mode."""
    age = (NOW - F.col("last_seen")) / 86_400_000
    score = P.node_score("debug", F.lit(0), F.col("centrality"), age, F.lit(0), F.col("is_exported"))
    return symbols(s, d, "centrality", "last_seen", "is_exported").select("id", F.round(score, 6).alias("score"))


def compression_levels(s, d):
    """How many symbols of each file fall into each level when centrality is the score and the first symbol the pivot."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id")
    first = F.col("id") == F.min("id").over(w)
    rows = symbols(s, d, "file_id", "centrality").withColumn("level", P.level(F.col("centrality"), F.when(first, 0).otherwise(1), F.max("centrality").over(w)))
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def query_intent(s, d):
    return asked(s).select("query_id", P.intent(F.col("query")).alias("intent"))


QUERIES = {"capsule": capsule, "capsule_report": capsule_report, "capsule_session": capsule_session, "capsule_merged": capsule_merged, "node_scores": node_scores, "compression_levels": compression_levels, "query_intent": query_intent}
SQL = {
    "node_scores": f"with x as (select id, centrality c, greatest(0.1, 1 - ({NOW} - last_seen) / 86400000 / 30) r, is_exported e, greatest(0.0, least(1.0, (centrality - 0.08) / 0.22)) h from {S}) select id, round((1 + ln(1 + greatest(0, c) * 100000) * 0.3) * (1 + 1.5 * r) * (case when e then 1.2 else 1.0 end) * (1 - h * 0.6), 6) score from x",
    "compression_levels": f"with x as (select *, min(id) over (partition by file_id) f, max(centrality) over (partition by file_id) m from {S}) select case when id = f then 0 when m > 0 and centrality / m >= 0.6 then 1 when m > 0 and centrality / m >= 0.3 then 2 else 3 end as level, count(*) n from x group by 1",
    "query_intent": "select query_id, case when regexp_matches(lower(query), '\\b(" + P.INTENTS[0][1] + ")\\b') then 'debug' when regexp_matches(lower(query), '\\b(" + P.INTENTS[1][1] + ")\\b') then 'task' when regexp_matches(lower(query), '\\b(" + P.INTENTS[2][1] + ")\\b') then 'broad' else 'narrow' end intent from (values " + ", ".join(f"({i}, '{t}')" for i, t in ASKED) + ") q(query_id, query)",
}
