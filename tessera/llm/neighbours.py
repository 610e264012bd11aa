"""The k most similar vectors of every vector: multiprobe p-stable hashing with exact reranking.

Exact copies of a vector form a class and only one of each is hashed. Each of L tables hashes a unit vector by
floor((a.v + b) / w) for several Gaussian a. Besides its own bucket a vector visits perturbed buckets, in the
order in which they are likely to hold a neighbour (small distance to the borders crossed). A pair is a candidate if either side
visits the other's bucket in any table; candidates of all tables are merged and reranked by their exact cosine.

The number of hashes per table follows the logarithm of the number of vectors, so chance meetings per vector stay few;
tables and probes follow the hashes, so that a pair at the similarity ``sure`` (0.9, or ``min_cosine`` if larger) is met with a
chance of ``TARGET`` at any size. Below that similarity hashing promises nothing: where ``min_cosine`` is lower, a vector whose k
neighbours are not all at ``sure`` or above meets all vectors of its model in exact matrix products. A bucket with more than ``hot_rows`` vectors is not joined pair by pair: its vectors are
cut into blocks, every visitor meets every block as a matrix product, and only the best k of each block go on. Nothing is capped.

Defined results: vectors that are null, all zero or hold a null element, and rows with a null id or model, are left out; vectors meet only within one model
(trimmed, lower case) and length; rows of one id count once; of equal similarities the smaller id comes first.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import cut
from tessera.sources.tables import table

TABLES, PROBES, WIDTH, SEED, HOT_ROWS = 6, 12, 1.4, 20, 2000
#: The similarity hashing answers for, the least chance of meeting there, and vectors in a block of the exact products.
SURE, TARGET, EXACT_ROWS = 0.9, 0.95, 8000
#: Chance of one hash to agree for two random unit vectors at this width.
CHANCE = 0.37


def perturbations(hashes: int, count: int) -> list[tuple[int, ...]]:
    """The likeliest sets of border crossings, as ranks of the 2*hashes distances in ascending order."""
    m = hashes
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    found, heap = [], [(cost[0], (0,))]
    while heap and len(found) < count:
        total, ranks = heapq.heappop(heap)
        if not any(2 * m - 1 - j in ranks for j in ranks):  # both borders of one hash can't be crossed
            found.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*ranks, last + 1)))
    return found


def first_meetings(cosine: float, hashes: int, probes: int, width: float, samples: int = 10_000, seed: int = SEED) -> np.ndarray:
    """Chances that a pair at ``cosine`` meets in one table with 0, 1, ... ``probes`` probes, by simulation of its places."""
    random = np.random.default_rng([seed, hashes])
    place = random.uniform(size=(samples, hashes))
    other = place + random.normal(size=(samples, hashes)) * math.sqrt(2 - 2 * cosine) / width
    mix = random.integers(1, 2**62, hashes, dtype=np.int64) | 1
    first = np.full(samples, probes + 1)
    with np.errstate(over="ignore"):
        for one, two in ((place, other), (other, place)):
            within = one - np.floor(one)
            order = np.argsort(np.concatenate([within, 1 - within], 1) ** 2, axis=1, kind="stable")
            step = mix[order % hashes] * np.where(order < hashes, -1, 1)
            apart = ((np.floor(two) - np.floor(one)).astype(np.int64) * mix).sum(1)
            for n, ranks in enumerate([(), *perturbations(hashes, probes)]):
                met = step[:, list(ranks)].sum(1) == apart
                first[met] = np.minimum(first[met], n)
    return np.cumsum(np.bincount(first, minlength=probes + 2)[: probes + 1]) / samples


def tables_and_probes(cosine: float, hashes: int, width: float = WIDTH, target: float = TARGET, most_probes: int = 64) -> tuple[int, int]:
    """The cheapest choice that lets a pair at ``cosine`` meet with a chance of ``target``, or that of ``TABLES`` and ``PROBES`` if larger."""
    chances = first_meetings(cosine, hashes, most_probes, width)
    lost = max(1e-4, min(1 - target, (1 - chances[PROBES]) ** TABLES))
    choices = [(math.ceil(math.log(lost) / math.log1p(-min(c, 1 - 1e-9))), probes) for probes, c in enumerate(chances) if c > 0]
    return min(choices, key=lambda x: (x[0] * (3 + x[1]), x[0]))  # a table's own key is sorted and looked up too


def bucket_keys(vectors: np.ndarray, space: int, hashes: int, tables: int, probes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, tables) own keys and (rows, tables * probes) visited keys of ``vectors`` (rows, dimension)."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rows, dimension = unit.shape
    sets, own, visited = perturbations(hashes, probes), [], []
    random = np.random.default_rng([seed, dimension])
    for t in range(tables):
        place = (unit @ random.normal(size=(dimension, hashes)) + random.uniform(0, width, hashes)) / width
        mix = random.integers(1, 2**62, hashes, dtype=np.int64) | 1
        cell = np.floor(place)
        within = place - cell
        order = np.argsort(np.concatenate([within, 1 - within], 1) ** 2, axis=1, kind="stable")
        with np.errstate(over="ignore"):
            salt = np.int64((space * 1_000_003 + t * 7_919) % (2**62))
            key = (cell.astype(np.int64) * mix).sum(1) + salt
            own.append(key)
            step = mix[order % hashes] * np.where(order < hashes, -1, 1)  # the change of the key by each crossing
            for ranks in sets:
                visited.append(key + step[:, list(ranks)].sum(1))
    return np.stack(own, 1), np.stack(visited, 1) if visited else np.empty((rows, 0), np.int64)


def usable(df: DataFrame, id_col: str, vector_col: str, model_col: str) -> DataFrame:
    """(id, space, vector): space tells model and length."""
    model = F.lower(F.regexp_replace(F.col(model_col), r"(?U)^\s+|\s+$", ""))
    v = F.col(vector_col)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), model.alias("model"), v.alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("model").isNotNull() & F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull()))
    return rows.select("id", F.xxhash64("model", F.size("vector")).alias("space"), "vector").dropDuplicates(["id"])


def product(x, y):
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)


def neighbours(df: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", model_col: str = "model_name", min_cosine: float = -1.0, tables: int | None = None, probes: int | None = None, width: float = WIDTH, hot_rows: int = HOT_ROWS, seed: int = SEED, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """(id, neighbour, cosine): up to ``k`` most similar other rows of each usable row, at ``min_cosine`` or above."""
    rows = cut(usable(df, id_col, vector_col, model_col))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy("space", "vector", "salt").orderBy("id"))).filter(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("space", "vector").orderBy("id"))).filter(F.col("n") <= k + 1)
    classes = few.groupBy("space", "vector").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("members"))
    classes = cut(classes)
    count = classes.count()
    hashes = max(8, math.ceil(math.log(max(count, 2)) / -math.log(CHANCE)) + 1)
    sure = max(min_cosine, SURE)
    if tables is None or probes is None:
        tables, probes = tables_and_probes(sure, hashes, width)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (space, _), group in batch.groupby(["space", batch["vector"].map(len)]):
                own, visited = bucket_keys(np.stack(group["vector"].to_list()).astype(np.float64), int(space), hashes, tables, probes, width, seed)
                yield pd.DataFrame({"rep": group["rep"].to_numpy(), "own": list(own), "visited": list(visited)})

    hashed = cut(classes.select("rep", "space", "vector").mapInPandas(keys, "rep bigint, own array<bigint>, visited array<bigint>"))
    base = hashed.select(F.col("rep").alias("b"), F.explode("own").alias("key"))
    visits = hashed.select(F.col("rep").alias("q"), F.explode(F.concat("own", "visited")).alias("key"))
    hot = base.groupBy("key").count().filter(F.col("count") > hot_rows).select("key", F.ceil(F.col("count") / hot_rows).cast("int").alias("blocks"))
    hot = cut(hot)
    vectors = cut(classes.select("rep", "vector", product(F.col("vector"), F.col("vector")).alias("square")))
    scored = None
    if hot.limit(1).count():
        scored = in_blocks(base.join(hot, "key"), visits.join(hot, "key"), vectors, k, sure)
        base, visits = base.join(hot, "key", "left_anti"), visits.join(hot, "key", "left_anti")
    pairs = base.join(visits, "key").filter("b <> q").select(F.least("b", "q").alias("lo"), F.greatest("b", "q").alias("hi")).distinct()
    pairs = pairs.join(vectors.select(F.col("rep").alias("lo"), F.col("vector").alias("v"), F.col("square").alias("vv")), "lo").join(vectors.select(F.col("rep").alias("hi"), F.col("vector").alias("u"), F.col("square").alias("uu")), "hi")
    pairs = pairs.select("lo", "hi", F.round(product(F.col("v"), F.col("u")) / F.sqrt(F.col("vv") * F.col("uu")), 12).alias("cosine")).filter(F.col("cosine") >= sure)
    both = pairs.select(F.explode(F.array(F.struct(F.col("lo").alias("q"), F.col("hi").alias("b")), F.struct(F.col("hi").alias("q"), F.col("lo").alias("b")))).alias("p"), "cosine").select("p.*", "cosine")
    if scored is not None:
        both = both.unionByName(scored).dropDuplicates(["q", "b"])
    if min_cosine < sure:  # what hashing does not answer for
        both = cut(both)
        near = both.join(classes.select(F.col("rep").alias("b"), F.size("members").alias("found")), "b").groupBy(F.col("q").alias("rep")).agg(F.sum("found").alias("found"))
        rest = classes.join(near, "rep", "left").filter(F.size("members") - 1 + F.coalesce("found", F.lit(0)) < k).select(F.col("rep").alias("q"), F.col("space").alias("key"))
        spaces = cut(classes.groupBy(F.col("space").alias("key")).agg(F.ceil(F.count(F.lit(1)) / exact_rows).cast("int").alias("blocks")))
        everyone = classes.select(F.col("rep").alias("b"), F.col("space").alias("key"))
        both = both.unionByName(in_blocks(everyone.join(spaces, "key"), rest.join(spaces, "key"), vectors, k, min_cosine)).dropDuplicates(["q", "b"])
    nearest = both.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "b"))).filter(F.col("n") <= k)
    # a class's neighbours: its own members first, then the members of the nearest classes
    other = nearest.join(classes.select(F.col("rep").alias("b"), F.col("members").alias("ids")), "b").select(F.col("q").alias("rep"), F.transform("ids", lambda i: F.struct((-F.col("cosine")).alias("d"), i.alias("id"))).alias("ids"))
    other = other.groupBy("rep").agg(F.flatten(F.collect_list("ids")).alias("others"))
    listed = classes.join(other, "rep", "left")
    own = F.transform("members", lambda i: F.struct(F.lit(-1.0).alias("d"), i.alias("id")))
    ranked = F.slice(F.array_sort(F.concat(own, F.coalesce("others", F.array().cast("array<struct<d:double,id:bigint>>")))), 1, k + 1)
    listed = listed.select("space", "vector", ranked.alias("ranked")).filter(F.size("ranked") > 1)
    found = rows.join(listed, ["space", "vector"]).select("id", F.slice(F.filter("ranked", lambda r: r["id"] != F.col("id")), 1, k).alias("ranked"))
    return found.select("id", F.explode("ranked").alias("r")).select("id", F.col("r.id").alias("neighbour"), (-F.col("r.d")).alias("cosine")).filter(F.col("cosine") >= min_cosine)


def in_blocks(base: DataFrame, visits: DataFrame, vectors: DataFrame, k: int, min_cosine: float) -> DataFrame:
    """(q, b, cosine): the best ``k`` of every one of a key's ``blocks`` for every visitor of the key."""
    blocks = F.col("blocks")
    vectors = vectors.select("rep", "vector")
    left = base.join(vectors, base.b == vectors.rep).select("key", F.pmod(F.xxhash64("b"), blocks).cast("int").alias("bb"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("qb"), F.col("b").alias("id"), "vector")
    right = visits.join(vectors, visits.q == vectors.rep).select("key", F.pmod(F.xxhash64("q"), blocks).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("bb"), F.col("q").alias("id"), F.col("vector").alias("asked"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"q": [], "b": [], "cosine": []}).astype({"q": "int64", "b": "int64", "cosine": "float64"})
        held, at = np.stack(a["vector"].to_list()).astype(np.float64), a["id"].to_numpy()
        b = b.drop_duplicates("id")
        lengths = np.sqrt((held**2).sum(1))
        out = []
        for start in range(0, len(b), 1024):
            part = b.iloc[start : start + 1024]
            asks = np.stack(part["asked"].to_list()).astype(np.float64)
            like = asks @ held.T
            like /= np.sqrt((asks**2).sum(1))[:, None]
            like /= lengths[None, :]
            np.round(like, 12, out=like)
            asking = part["id"].to_numpy()
            like[asking[:, None] == at[None, :]] = -2
            least = np.full(len(part), -1.5) if len(at) <= k else np.partition(like, -k, axis=1)[:, -k]
            i, j = np.nonzero(like >= np.maximum(least, max(min_cosine, -1.5))[:, None])
            order = np.lexsort((at[j], -like[i, j], i))
            i, j = i[order], j[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append(pd.DataFrame({"q": asking[i[first]], "b": at[j[first]], "cosine": like[i[first], j[first]]}))
        return pd.concat(out)

    return left.groupBy("key", "bb", "qb").cogroup(right.groupBy("key", "bb", "qb")).applyInPandas(best, "q bigint, b bigint, cosine double")


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    found = neighbours(table(spark, directory, "chunk_embeddings"), 5, min_cosine=0.9)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p2_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    return neighbours(table(spark, directory, "chunk_embeddings"), 5)


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours}
SQL: dict[str, str] = {}
