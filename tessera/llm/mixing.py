"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes: tokens of each document by a public tokenizer, summed per source (trimmed, lower case).
2. Quotas: the total is the largest at which each present source reaches its share without going beyond its cap,
   unless ``total_tokens`` asks for another; then a source that would need more is held at its cap and reported.
   Shares of listed sources without tokens are spread over the present ones in proportion.
3. Documents fall into blocks by a hash. A source's quota is a number of full passes over its blocks and a part of
   another pass: a prefix of the blocks in permuted order, of whose last one documents are taken until the quota is met as closely as whole documents allow.
4. The block copies of all sources are shared out over output shards: the shards are halved again and again, and at each halving
   a multivariate-hypergeometric draw tells how many blocks of each source go left. A shard then takes the next blocks
   of each source's permuted order, so shards are disjoint and each is a fair draw from the whole mix.
5. Each shard is shuffled on its own, by a hash.

The driver holds one number per source and shard, never rows. Everything follows from ``seed``.

Defined results: null, blank and unlisted sources are left out, as are documents without tokens (null or empty texts); repeated rows of one doc_id count
once; several targets of one source are an error; shares need not sum to 1 and are normalized; empty tables give an empty mix.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import counted
from tessera.session import cut
from tessera.sources.tables import table

#: A block holds this many tokens at least, and as many more as keep the number of blocks near MOST_BLOCKS; a shard holds SHARD_BLOCKS blocks.
BLOCK_TOKENS, MOST_BLOCKS, SHARD_BLOCKS, SEED, MOST_SOURCES = 4_000, 1_000_000, 64, 9, 10_000


def split_tree(counts: np.ndarray, shards: int, random: np.random.Generator) -> np.ndarray:
    """(shards, sources): how many blocks of each source each shard gets; the columns sum to ``counts``."""
    out = np.zeros((shards, len(counts)), dtype=np.int64)
    todo = [(0, shards, counts.astype(np.int64))]
    while todo:
        low, high, left = todo.pop()
        if high - low == 1:
            out[low] = left
            continue
        middle = (low + high) // 2
        take = int(left.sum()) * (middle - low) // (high - low)
        drawn = random.multivariate_hypergeometric(left, take, method="marginals") if take else np.zeros_like(left)
        todo += [(low, middle, drawn), (middle, high, left - drawn)]
    return out


def running(rows: DataFrame, order: list, ranges: int = 256) -> DataFrame:
    """``rows`` with ``before``: the sum of ``size`` of the source's rows ahead of each one in the order ``h`` (a hash), then ``order``.

    A source's rows are summed range by range of the hash, so no source is ever in one task.
    """
    # ranges of equal width: hashes are spread evenly, and the ranges' sums are few
    rows = rows.withColumn("__range", F.shiftright("h", 64 - (ranges - 1).bit_length()).cast("int"))
    sums = rows.groupBy("source", "__range").agg(F.sum("size").alias("__sum"))
    earlier = F.sum("__sum").over(Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sums = F.broadcast(sums.select("source", "__range", F.coalesce(earlier, F.lit(0)).alias("__earlier")))  # at most MOST_SOURCES * ranges rows
    inside = F.sum("size").over(Window.partitionBy("source", "__range").orderBy("h", *order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(inside, F.lit(0))).join(sums, ["source", "__range"])
    return rows.withColumn("before", F.col("before") + F.col("__earlier")).drop("__range", "__earlier", "h", "size")


def source_key(column: str):
    return F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))


def plan(sizes: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], total_tokens: int | None) -> list[dict]:
    """Quota of each target. ``sizes``: source -> (documents, tokens)."""
    if len({t[0] for t in targets}) < len(targets):
        raise ValueError("a source has several targets")
    present = [t for t in targets if sizes.get(t[0], (0, 0))[1] > 0 and t[1] > 0 and t[2] > 0]
    weight = sum(t[1] for t in present)
    reach = min((t[2] * sizes[t[0]][1] / (t[1] / weight) for t in present), default=0)
    total = reach if total_tokens is None else total_tokens
    rows = []
    for name, share, cap in targets:
        documents, available = sizes.get(name, (0, 0))
        wanted = total * share / weight if (name, share, cap) in present else 0
        rows.append({"source": name, "target_share": share, "max_repeats": cap, "documents": documents, "available_tokens": available, "quota": int(min(round(wanted), cap * available)), "status": "missing" if not available else "capped" if wanted > cap * available + 1 else "met"})
    return rows


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int | None = None, shard_tokens: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix (shard, position, doc_id, source, pass, n_tokens) and the report on shares."""
    spark = documents.sparkSession
    wanted = [(r[0], float(r[1]), int(r[2])) for r in targets.select(source_key("source"), "target_share", "max_repeats").na.drop().limit(MOST_SOURCES + 1).collect()]
    if len(wanted) > MOST_SOURCES:
        raise ValueError("too many targets")
    listed = spark.createDataFrame([(t[0],) for t in wanted], "source string")
    rows = documents.select("doc_id", source_key("source").alias("source"), "text").join(F.broadcast(listed), "source", "left_semi")
    docs = counted(rows.filter("doc_id is not null and length(text) > 0")).select("doc_id", "source", "n_tokens").dropDuplicates(["doc_id"])
    docs = cut(docs.filter("n_tokens > 0"))
    sizes = {r[0]: (r[1], r[2]) for r in docs.groupBy("source").agg(F.count(F.lit(1)), F.sum("n_tokens")).collect()}
    quotas = plan(sizes, wanted, total_tokens)
    block_tokens = block_tokens or max(BLOCK_TOKENS, -(-sum(tokens for _, tokens in sizes.values()) // MOST_BLOCKS))
    shard_tokens = shard_tokens or SHARD_BLOCKS * block_tokens
    plans = [(q["source"], q["quota"], q["available_tokens"], max(1, math.ceil(q["available_tokens"] / block_tokens)), q["quota"] // q["available_tokens"], q["quota"] % q["available_tokens"]) for q in quotas if q["quota"] > 0]
    parts = F.broadcast(spark.createDataFrame(plans, "source string, quota bigint, size bigint, blocks bigint, full bigint, rest bigint"))
    docs = docs.join(parts, "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks"))).select("doc_id", "source", "n_tokens", "block")
    blocks = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")).join(parts, "source")
    blocks = cut(running(blocks.withColumn("h", F.xxhash64("block", F.lit(seed + 1))).withColumn("size", F.col("tokens")), ["block"]))
    before = F.col("before")
    upto = before + F.col("tokens")
    full = blocks.filter("full > 0").select("source", "block", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("full"))).alias("pass"), F.lit(None).cast("bigint").alias("take"))
    partial = blocks.filter((F.col("rest") > 0) & (before < F.col("rest"))).select("source", "block", (F.col("full") + 1).alias("pass"), F.when(upto > F.col("rest"), F.col("rest") - before).alias("take"))
    copies = cut(full.unionByName(partial))
    numbers = {r[0]: r[1] for r in copies.groupBy("source").count().collect()}
    names = sorted(numbers)
    shards = max(1, math.ceil(sum(p[1] for p in plans) / shard_tokens))
    drawn = split_tree(np.array([numbers[n] for n in names], dtype=np.int64), shards, np.random.default_rng(seed))
    # each shard's places in a source's order, one row a place, meet the copies by an equi-join
    first = drawn.cumsum(0) - drawn
    at, of = np.nonzero(drawn)
    held = spark.createDataFrame(pd.DataFrame({"shard": at.astype(np.int32), "source": np.array(names, dtype=object)[of], "first": first[at, of], "held": drawn[at, of]}), "shard int, source string, first bigint, held bigint")
    places = held.select("shard", "source", F.explode(F.sequence("first", F.col("first") + F.col("held") - 1)).alias("before"))
    ranked = running(copies.withColumn("h", F.xxhash64("block", "pass", F.lit(seed + 2))).withColumn("size", F.lit(1).cast("bigint")), ["block", "pass"])
    copies = ranked.join(places, ["source", "before"]).drop("before")
    # of a cut block, documents are taken in hashed order while each brings the sum nearer to the quota
    torn = docs.join(copies.filter("take is not null"), ["source", "block"])
    inside = Window.partitionBy("source", "block", "pass").orderBy(F.xxhash64("doc_id", F.lit(seed + 3)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    torn = torn.withColumn("upto", F.sum("n_tokens").over(inside)).filter(F.col("upto") - F.col("n_tokens") / 2 <= F.col("take")).drop("upto", "take")
    rest = docs.join(copies.filter("take is null").drop("take"), ["source", "block"])
    chosen = rest.unionByName(torn)
    position = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "pass", F.lit(seed + 4)), "doc_id", "pass")) - 1
    mixed = cut(chosen.withColumn("position", position).select("shard", "position", "doc_id", "source", "pass", "n_tokens"))
    reached = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.max("pass").alias("passes"))
    schema = "source string, target_share double, max_repeats int, documents bigint, available_tokens bigint, quota bigint, status string"
    report = spark.createDataFrame([tuple(q[c.split()[0]] for c in schema.split(", ")) for q in quotas], schema).join(reached, "source", "left")
    total = mixed.agg(F.sum("n_tokens").alias("total"))
    report = report.crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "documents", "available_tokens", F.col("quota").alias("quota_tokens"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce("passes", F.lit(0)).cast("bigint").alias("passes"), F.coalesce(F.col("mixed_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), "status",
    )
    return mixed, report


def p9_mix(spark: SparkSession, directory: str) -> DataFrame:
    return mix(table(spark, directory, "documents"), table(spark, directory, "mix_targets"))[0]


def p9_shares(spark: SparkSession, directory: str) -> DataFrame:
    return mix(table(spark, directory, "documents"), table(spark, directory, "mix_targets"))[1]


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
