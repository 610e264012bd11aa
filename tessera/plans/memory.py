"""Lifecycle of notes, sessions, watcher events and evaluation, with documents as notes and events as sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.sources.tables import table

NOW = "timestamp'2025-06-01 00:00:00'"
DAY = 86400.0


def notes(s, d) -> DataFrame:
    """Documents as notes: the source is the scope, the length gives confidence and hits."""
    n = F.coalesce("n_chars", F.lit(0))
    return table(s, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("scope"), (n % 100 / 100).alias("confidence"), (n % 7).alias("hit_count"), ((F.unix_micros(F.expr(NOW)) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6 / DAY).alias("age_days"), "text")


def promote(df: DataFrame) -> DataFrame:
    """Notes with three hits or more become conventions of confidence 0.9."""
    up = (F.col("hit_count") >= 3) & (F.col("scope") != "convention")
    return df.withColumn("confidence", F.when(up, 0.9).otherwise(F.col("confidence"))).withColumn("scope", F.when(up, F.lit("convention")).otherwise(F.col("scope")))


def demote(df: DataFrame) -> DataFrame:
    """0.1 less for each 30 days without a hit; archived below 0.1."""
    periods = F.floor(F.col("age_days") / 30)
    new = F.greatest(F.lit(0.0), F.round(F.col("confidence") - periods * 0.1, 6))
    stale = periods >= 1
    return df.withColumn("archived", stale & (new < 0.1)).withColumn("confidence", F.when(stale, new).otherwise(F.col("confidence")))


def note_promote(s, d):
    return promote(notes(s, d)).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def note_demote(s, d):
    return demote(notes(s, d)).select("doc_id", F.round("confidence", 6).alias("confidence"), "archived")


def note_decay(s, d):
    """Decay by 0.1, then what is left of it: archived below 0.1 or when stale for 30 days."""
    rows = notes(s, d).withColumn("confidence", F.greatest(F.lit(0.0), F.round(F.col("confidence") - 0.1, 6)))
    return rows.filter(~((F.col("confidence") < 0.1) | ((F.col("hit_count") == 0) & (F.col("age_days") > 30)))).select("doc_id", "confidence")


def note_ttl(s, d):
    """Passive notes live seven days."""
    rows = notes(s, d)
    return rows.filter((F.col("scope") != "memory-notes") | (F.col("age_days") <= 7)).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


def passive_capture(s, d):
    """Notes by scope and text, each once, the earliest kept."""
    rows = notes(s, d).filter(F.length("text") > 0)
    return rows.groupBy("scope", F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def snapshot_topk(s, d):
    """Of each scope the five notes of highest confidence."""
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("confidence"), "doc_id"))
    return notes(s, d).withColumn("rank", rank.cast("bigint")).filter("rank <= 5").select("scope", "rank", "doc_id", X.truncate(F.coalesce("text", F.lit("")), 60).alias("note"))


def memory_injection(s, d, budget: int = 1000):
    """Of each scope the notes by confidence until the running token estimate goes beyond the budget."""
    rows = notes(s, d).filter(F.length("text") > 0).select("scope", "doc_id", "confidence", X.estimate_tokens(F.col("text")).alias("tokens"))
    used = F.sum("tokens").over(Window.partitionBy("scope").orderBy(F.desc("confidence"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).filter(F.col("used") <= budget).select("scope", "doc_id", "used")


def staleness(s, d):
    """Changed symbols make their dependents' notes lose 0.3 by depth, to depth two, the smaller depth counting."""
    from tessera.operators.graph import impact
    from tessera.plans.graphs import links, pivots

    hit = impact(links(s, d), pivots(s, d), 2, only_first=()).groupBy("id").agg(F.min("depth").alias("depth"))
    return hit.select("id", F.col("depth").cast("bigint").alias("depth"), F.round(F.greatest(F.lit(0.0), 1 - 0.3 * F.col("depth")), 6).alias("confidence"))


def debounce(s, d):
    """Events of a user within two minutes of each other count as one: the last of each burst."""
    e = table(s, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    e = e.withColumn("burst", F.sum(F.coalesce((gap > 120_000_000).cast("int"), F.lit(1))).over(w))
    return e.groupBy("user_id", "burst").agg(F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("events"))


def dedup_recent(s, d):
    """Events of a user and type that follow another one within ten minutes are dropped."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return table(s, d, "events").withColumn("gap", gap).filter("gap is null or gap > 600000000").select("event_id", "user_id", "event_type")


def feedback(s, d):
    """For each error the user's latest click before it (as-of), and the minutes between."""
    e = table(s, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "click", F.struct("event_id", "ts")), ignorenulls=True).over(w)
    rows = e.withColumn("last", last).filter("event_type = 'error' and last is not null")
    return rows.select("event_id", F.col("last.event_id").alias("click_id"), F.round((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last.ts").cast("timestamp"))) / 6e7, 4).alias("wait_min"))


def precision_recall(s, d, k: int = 3):
    """Precision and recall at three of the chunks BM25 finds for its queries, against files with the words in their symbols."""
    from tessera.operators import retrieval as R
    from tessera.plans.relational import chunks, symbols
    from tessera.plans.retrieval import asked

    q = asked(s)
    c = chunks(s, d, "file_id", "text")
    found = R.bm25(R.postings(c, "id"), R.query_terms(q), k).join(c.select(F.col("id").alias("doc_id"), "file_id"), "doc_id").select("query_id", "file_id").distinct()
    words = symbols(s, d, "file_id", "name").select("file_id", F.explode(X.split_identifier(F.col("name"))).alias("term")).distinct()
    terms = R.query_terms(q).distinct()
    need = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    right = terms.join(words, "term").groupBy("query_id", "file_id").agg(F.count(F.lit(1)).alias("have")).join(need, "query_id").filter("have * 2 >= need").select("query_id", "file_id", F.lit(1).alias("ok"))
    hits = found.join(right, ["query_id", "file_id"], "left").groupBy("query_id").agg(F.count("ok").alias("hits"), F.count(F.lit(1)).alias("found"))
    total = right.groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"))
    return q.select("query_id").join(hits, "query_id", "left").join(total, "query_id", "left").select("query_id", F.round(F.coalesce(F.col("hits") / F.col("found"), F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(F.col("hits") / F.col("expected"), F.lit(0.0)), 6).alias("recall"))


QUERIES = {f.__name__: f for f in (note_promote, note_demote, note_decay, note_ttl, passive_capture, snapshot_topk, memory_injection, staleness, debounce, dedup_recent, feedback, precision_recall)}
N = "n as (select doc_id, lower(trim(source)) scope, (coalesce(n_chars, 0) % 100) / 100 confidence, coalesce(n_chars, 0) % 7 hit_count, (epoch_us(timestamp '2025-06-01 00:00:00') - epoch_us(created_at)) / 1e6 / 86400.0 age_days, text from documents)"
SQL = {
    "note_promote": f"with {N}, p as (select case when hit_count >= 3 and scope <> 'convention' then 'convention' else scope end scope, case when hit_count >= 3 and scope <> 'convention' then 0.9::double else confidence end confidence from n) select scope, count(*) n, round(avg(confidence), 6) confidence from p group by 1",
    "note_demote": f"with {N}, p as (select *, floor(age_days / 30) k, greatest(0.0, round(confidence - floor(age_days / 30) * 0.1::double, 6)) v from n) select doc_id, round(case when k >= 1 then v else confidence end, 6) confidence, k >= 1 and v < 0.1 archived from p",
    "note_decay": f"with {N}, p as (select doc_id, greatest(0.0, round(confidence - 0.1::double, 6)) confidence, hit_count, age_days from n) select doc_id, confidence from p where not (confidence < 0.1 or (hit_count = 0 and age_days > 30))",
    "note_ttl": f"with {N} select scope, count(*) n from n where scope <> 'memory-notes' or age_days <= 7 group by 1",
    "passive_capture": f"with {N} select scope, sha256(text) hash, min(doc_id) doc_id, count(*) copies from n where length(text) > 0 group by scope, text",
    "snapshot_topk": f"with {N} select scope, rank, doc_id, case when length(text) > 60 then rtrim(substring(text, 1, 57), ' ') || '...' else coalesce(text, '') end note from (select *, row_number() over (partition by scope order by confidence desc, doc_id) rank from n) where rank <= 5",
    "memory_injection": f"with {N} select scope, doc_id, used from (select scope, doc_id, cast(sum(cast(ceil(length(text) / 3.5) as bigint)) over (partition by scope order by confidence desc, doc_id rows unbounded preceding) as bigint) used from n where length(text) > 0) where used <= 1000",
    "debounce": "with g as (select *, case when ts - lag(ts) over w > interval 2 minutes or lag(ts) over w is null then 1 else 0 end b from events window w as (partition by user_id order by ts, event_id)), h as (select *, sum(b) over (partition by user_id order by ts, event_id) burst from g) select user_id, cast(burst as bigint) burst, max(event_id) last_event, count(*) events from h group by all",
    "dedup_recent": "select event_id, user_id, event_type from (select *, ts - lag(ts) over (partition by user_id, event_type order by ts, event_id) gap from events) where gap is null or gap > interval 10 minutes",
    "feedback": "select e.event_id, c.event_id click_id, round((epoch_us(e.ts) - epoch_us(c.ts)) / 6e7, 4) wait_min from (select * from events where event_type = 'error') e asof join (select * from events where event_type = 'click') c on e.user_id = c.user_id and e.ts >= c.ts",
}
