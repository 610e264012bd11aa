"""Inverted index, BM25 with fallbacks, rank fusion and fuzzy search over batches of queries.

All operators take the queries as a table (query_id, query), so many are answered by one plan. Ties end with the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.session import cut

K1, B, FUSION_K = 1.5, 0.75, 60


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl): raw term frequency and document length. Null and empty texts have no postings."""
    terms = docs.select(F.col(id_col).alias("doc_id"), X.words(F.col(text_col)).alias("terms"))
    rows = terms.select("doc_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return rows.groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: doc_count and avg_dl of the documents with terms."""
    return index.select("doc_id", "dl").distinct().agg(F.count(F.lit(1)).alias("doc_count"), F.avg("dl").alias("avg_dl"))


def asked_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The postings of the asked terms alone, and ``corpus_stats`` of all documents: the same hits for these terms as the whole index gives.

    Each text is split once, within its row, and one row a document is kept; the postings of other words are never made. The terms are a stated, small set.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), X.words(F.col(text_col)).alias("terms")).crossJoin(F.broadcast(terms.agg(F.collect_set("term").alias("asked"))))  # one row
    tf = lambda t: (F.size("terms") - F.size(F.array_remove("terms", t))).cast("bigint")
    held = F.transform(F.array_intersect("terms", "asked"), lambda t: F.struct(t.alias("term"), tf(t).alias("tf")))
    rows = cut(rows.select("doc_id", F.size("terms").alias("dl"), held.alias("held")))  # read for the hits and for the statistics
    index = rows.select("doc_id", "dl", F.inline("held")).groupBy("doc_id", "term", "dl").agg(F.sum("tf").alias("tf"))
    return index, corpus_stats(rows.filter("dl > 0"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(X.words(F.col("query"))).alias("term"))


def bm25(index: DataFrame, terms: DataFrame, limit: int | None = 20, stats: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) by BM25; a term repeated in the query counts again, unknown ones count nothing.

    ``stats`` are those of the whole corpus, where the index is ``asked_index``. Its terms are few and broadcast: else the planner, which takes
    an index for small and queries for endless, may gather the index on the driver.
    """
    few = F.broadcast if stats is not None else lambda x: x
    weights = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    hits = index.join(few(weights), "term")
    df = index.join(few(weights.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = hits.join(few(df), "term").crossJoin(F.broadcast(corpus_stats(index) if stats is None else stats))  # the statistics are one row
    idf = F.log((F.col("doc_count") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("times") * idf * tf), 6).alias("score"))
    return ranked(scored, limit)


def ranked(scored: DataFrame, limit: int | None = None, key: str = "query_id", doc: str = "doc_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), doc))
    out = scored.withColumn("rank", rank.cast("bigint"))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def expanded_terms(index: DataFrame, terms: DataFrame, least: float = 0.4) -> DataFrame:
    """The query's terms and the known terms whose trigrams resemble one of them; only terms that share a trigram are compared."""
    known = index.select("term").distinct()
    a = terms.distinct().withColumn("g", F.explode(X.trigrams(F.col("term"))))
    b = known.select(F.col("term").alias("other"), F.explode(X.trigrams(F.col("term"))).alias("g"))
    pairs = a.join(b, "g").groupBy("query_id", "term", "other").agg(F.count(F.lit(1)).alias("shared"))
    size = lambda c: F.greatest(F.size(X.trigrams(F.col(c))), F.lit(0))
    near = pairs.filter(F.col("shared") / (size("term") + size("other") - F.col("shared")) >= least).select("query_id", F.col("other").alias("term")).distinct()
    return terms.unionByName(near.join(terms.distinct(), ["query_id", "term"], "left_anti"))


def corrected_terms(index: DataFrame, terms: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, term, nearest): an exact known term, else the nearest within ``most`` edits; ties by the smaller term."""
    known = index.select(F.col("term").alias("nearest")).distinct().withColumn("n", F.length("nearest"))
    asks = terms.distinct().withColumn("n", F.explode(F.sequence(F.length("term") - most, F.length("term") + most)))
    pairs = asks.join(known, "n").withColumn("distance", F.levenshtein("term", "nearest", most)).filter("distance >= 0")
    rank = F.row_number().over(Window.partitionBy("query_id", "term").orderBy("distance", "nearest"))
    return pairs.withColumn("rank", rank).filter("rank = 1").select("query_id", "term", "nearest", F.col("distance").cast("bigint").alias("distance"))


def with_fallback(index: DataFrame, queries: DataFrame, limit: int = 20, least: int = 3) -> DataFrame:
    """BM25; queries with fewer than ``least`` hits get the trigram-expanded layer, and then the corrected one; first layers go first.

    Each layer is worked out for the queries alone that the layers before left short.
    """
    index, terms = cut(index), query_terms(queries)  # the index is read by every layer
    widened = [lambda t: expanded_terms(index, t), lambda t: corrected_terms(index, t).select("query_id", F.col("nearest").alias("term"))]
    out = cut(bm25(index, terms, limit).withColumn("layer", F.lit(1)))
    for number, widen in enumerate(widened, 2):
        full = cut(out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("query_id"))
        short = terms.join(full, "query_id", "left_anti")
        if not short.limit(1).count():
            break
        more = bm25(index, widen(short), limit).join(out.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        out = cut(out.unionByName(more.withColumn("layer", F.lit(number))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("layer", "rank"))
    return out.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= limit).select("query_id", "doc_id", "score", "rank", "layer")


def fuse(lists: list[tuple[DataFrame, float]], k: int = FUSION_K, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, doc_id, rank) with weights."""
    union = None
    for df, weight in lists:
        part = df.select("query_id", "doc_id", (F.lit(weight) / (k + F.col("rank"))).alias("s"))
        union = part if union is None else union.unionByName(part)
    return ranked(union.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 9).alias("score")), limit)


def rrf_search(index: DataFrame, asks: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, rank): BM25 and its trigram-expanded form fused, for asks (query_id, term, most); one plan for all of them."""
    terms = asks.select("query_id", "term")
    most = asks.groupBy("query_id").agg(F.max("most").alias("most"))
    wide = expanded_terms(index, terms)
    added = wide.join(terms.distinct(), ["query_id", "term"], "left_anti").select("query_id").distinct()
    lists = [bm25(index, terms, None), bm25(index, wide.join(added, "query_id", "left_semi"), None)]
    lists = [x.join(F.broadcast(most), "query_id").filter("rank <= most").drop("most") for x in lists]
    return fuse([(x, 1.0) for x in lists]).join(F.broadcast(most), "query_id").filter("rank <= most").drop("most")


def memory_search(docs: DataFrame, queries: DataFrame, scope_weights: dict[str, float], limit: int = 20, terms_of=None, passive_ttl_days: float = 7.0) -> DataFrame:
    """(query_id, doc_id, score, rank): notes for queries by words and their synonyms, times confidence and the scope's weight.

    ``docs``: (doc_id, text, scope, confidence, stale, age_days). A broad query in prose is asked with its synonyms and word by word, the first list that
    has a note deciding its score; others with synonyms, fused with the plain query where that differs. Stale and expired passive notes never come
    out. Queries left without any get the fuzzy layer. ``terms_of`` makes terms of a text column (words without stop words by default).
    """
    from tessera.functions import query as Q

    terms_of = terms_of or X.words
    usable = docs.filter(~F.coalesce("stale", F.lit(False)) & ~((F.col("scope") == "passive") & (F.col("age_days") > passive_ttl_days)))
    index = cut(postings(docs.select("doc_id", "text")) if terms_of is X.words else postings_of(docs, terms_of))
    low = F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda w: w != "")
    wide = F.array_join(Q.synonyms(low), " ")
    q = queries.select("query_id", F.lower("query").alias("query"), Q.is_broad_prose(F.col("query")).alias("broad"), low.alias("low")).withColumn("wide", wide)
    # asks of one query: 0 with synonyms, 1 plain, from 10 on word by word; all in one batch
    asks = F.concat(
        F.array(F.struct(F.lit(0).alias("sub"), F.col("wide").alias("text"), F.lit(limit * 3).alias("most"))),
        F.when(~F.col("broad") & (F.col("wide") != F.col("query")), F.array(F.struct(F.lit(1).alias("sub"), F.col("query").alias("text"), F.lit(limit * 2).alias("most")))).otherwise(F.expr("cast(array() as array<struct<sub:int,text:string,most:int>>)")),
        F.when(F.col("broad"), F.filter(F.transform("low", lambda w, i: F.struct((i + 10).cast("int").alias("sub"), w.alias("text"), F.lit(limit).alias("most"))), lambda a: F.length(a["text"]) >= 4)).otherwise(F.expr("cast(array() as array<struct<sub:int,text:string,most:int>>)")),
    )
    asks = q.select(F.col("query_id").alias("of"), "broad", F.explode(asks).alias("a")).select("of", "broad", "a.*").withColumn("query_id", F.col("of") * 1000 + F.col("sub"))
    found = rrf_search(index, asks.select("query_id", "most", F.explode(terms_of(F.col("text"))).alias("term")))
    found = cut(found.join(F.broadcast(asks.select("query_id", "of", "sub", "broad")), "query_id"))
    first = found.filter("broad").groupBy("of", "doc_id").agg(F.min_by("score", "sub").alias("score"))
    rest = found.filter("not broad")
    twice = rest.filter("sub = 1").select("of").distinct().withColumn("both", F.lit(True))
    rest = rest.join(F.broadcast(twice), "of", "left").groupBy("of", "doc_id").agg(F.when(F.first(F.coalesce("both", F.lit(False))), F.sum(1.0 / (FUSION_K + F.col("rank")))).otherwise(F.max("score")).alias("score"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for item in scope_weights.items() for x in item])[F.col("scope")], F.lit(1.0)) if scope_weights else F.lit(1.0)
    out = first.unionByName(rest).withColumnRenamed("of", "query_id").join(usable.select("doc_id", "scope", "confidence"), "doc_id").select("query_id", "doc_id", F.round(F.col("score") * F.col("confidence") * weight, 9).alias("score"))
    out = cut(out)
    missed = queries.join(out.select("query_id").distinct(), "query_id", "left_anti")
    fuzzy = fuzzy_fallback(usable, missed).join(usable.select("doc_id", "scope", "confidence"), "doc_id").select("query_id", "doc_id", F.round(F.col("score") * F.col("confidence") * weight, 9).alias("score"))
    return ranked(out.unionByName(fuzzy), limit)


def postings_of(docs: DataFrame, terms_of) -> DataFrame:
    """As ``postings``, with terms made by ``terms_of``."""
    rows = docs.select("doc_id", terms_of(F.col("text")).alias("terms")).select("doc_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return rows.groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def without(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without some documents (doc_id); its statistics are those of what is left."""
    return index.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def reindexed(index: DataFrame, docs: DataFrame) -> DataFrame:
    """The index with the given documents' texts in place of their old ones; a document is never counted twice."""
    return without(index, docs).unionByName(postings(docs))


def fuzzy_fallback(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Phrase 0.9; else up to 0.8 by hits of single words; below 0.15 nothing. The queries are a stated, small set."""
    q = queries.select("query_id", F.lower("query").alias("phrase"), F.filter(F.split(F.lower("query"), r"\W+"), lambda w: F.length(w) >= 3).alias("words"))
    rows = docs.select("doc_id", F.lower("text").alias("low")).crossJoin(F.broadcast(q))
    hits = F.size(F.filter("words", lambda w: F.contains(F.col("low"), w)))
    score = F.when(F.contains("low", "phrase"), 0.9).when(hits > 0, F.least(F.lit(0.8), 0.3 + 0.15 * hits)).otherwise(0.0)
    return rows.select("query_id", "doc_id", F.round(score, 6).alias("score")).filter("score >= 0.15")
