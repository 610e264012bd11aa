"""Vector operators: normalizing, int8 quantizing and exact top-k in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x))


def quantize(v: Column) -> Column:
    """Unit length, times 127, rounded half up, clamped; a zero vector stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") / n * 127 + 0.5)))).cast("tinyint"))


def exact_top_k(base: DataFrame, queries: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """(query_id, id, cosine, rank): the ``k`` nearest rows of each query, itself left out.

    ``base`` and ``queries``: (id, space, vector); only rows of one space meet. Both sides are cut into blocks and each pair of
    blocks is one matrix product, of which only the best ``k`` go on. Zero and null vectors are left out. Ties end with the smaller id.
    """
    usable = F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0)
    base, queries = base.filter(usable), queries.filter(usable)
    sizes = base.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("bs")).join(queries.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("qs")), "space")
    left = base.join(F.broadcast(sizes), "space").select("space", F.pmod(F.xxhash64("id"), F.col("bs")).cast("int").alias("bb"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), "id", "vector")
    right = queries.join(F.broadcast(sizes), "space").select(F.col("space").alias("q_space"), F.explode(F.sequence(F.lit(0), F.col("bs") - 1)).alias("q_bb"), F.pmod(F.xxhash64("id"), F.col("qs")).cast("int").alias("q_qb"), F.col("id").alias("query_id"), F.col("vector").alias("asked"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            held, ids = np.stack(a["vector"].to_list()).astype(float), a["id"].to_numpy()
            held /= np.linalg.norm(held, axis=1, keepdims=True)
            asked = np.stack(b["asked"].to_list()).astype(float)
            like = np.round(asked / np.linalg.norm(asked, axis=1, keepdims=True) @ held.T, 9)
            for row, q in zip(like, b["query_id"].to_numpy(), strict=True):
                keep = ids != q
                order = np.lexsort((ids[keep], -row[keep]))[:k]
                out += [(q, i, c) for i, c in zip(ids[keep][order], row[keep][order], strict=True)]
        return pd.DataFrame(out, columns=["query_id", "id", "cosine"])

    parts = left.groupBy("space", "bb", "qb").cogroup(right.groupBy("q_space", "q_bb", "q_qb")).applyInPandas(best, "query_id bigint, id bigint, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return parts.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k)
