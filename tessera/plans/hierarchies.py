"""Queries on parent-child links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import hierarchy as H
from tessera.sources.tables import table


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    found = H.roots_and_depths(table(spark, directory, "symbols"), "id", "parent_symbol_id")
    return found.select(F.col("id").alias("symbol_id"), F.col("root").alias("root_id"), "depth")


def p4_hierarchy(spark: SparkSession, directory: str) -> DataFrame:
    symbols = table(spark, directory, "symbols")
    tree = H.hierarchy(symbols, "id", "parent_symbol_id")
    out = H.paths(tree, symbols.select("id", "name"))
    return out.select(F.col("id").alias("symbol_id"), F.col("root").alias("root_id"), "depth", "path", "descendants")


def p4_descendants(spark: SparkSession, directory: str) -> DataFrame:
    tree = H.hierarchy(table(spark, directory, "symbols"), "id", "parent_symbol_id")
    return H.ancestor_pairs(tree)


WALK = """
with recursive n as (select id, min(parent_symbol_id) p from symbols where id is not null group by id),
v as (select n.id, n.p, m.id up from n left join n m on n.p = m.id),
w(id, cur, seen) as (
  select id, id, [id] from v
  union all
  select w.id, v.up, w.seen || [v.up] from w join v on w.cur = v.id
  where v.up is not null and not list_contains(w.seen[:-2], w.cur)
),
e as (select w.id, w.seen, v.up, list_contains(w.seen[:-2], w.cur) looped from w join v on w.cur = v.id
      where v.up is null or list_contains(w.seen[:-2], w.cur)),
r as (select id, case when looped then list_min(seen[list_position(seen, seen[-1]):]) else seen[-1] end root_id,
      case when looped then -1 else len(seen) - 1 end depth, seen, looped from e)
"""

QUERIES = {"p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_descendants": p4_descendants}
SQL = {
    "p4_found": WALK + "select r.id symbol_id, cast(root_id as bigint) root_id, cast(depth as bigint) depth from r join n on r.id = n.id where n.p is not null",
    "p4_hierarchy": WALK
    + """, nm as (select id, coalesce(min(name), '') nm from symbols group by id),
q as (select r.id, unnest(seen) anc, generate_subscripts(seen, 1) k from r where not looped),
pa as (select q.id, string_agg(nm.nm, '.' order by k desc) path from q join nm on nm.id = q.anc group by q.id),
ds as (select anc id, count(*) - 1 c from q group by anc)
select r.id symbol_id, cast(root_id as bigint) root_id, cast(depth as bigint) depth, pa.path, ds.c descendants
from r left join pa on pa.id = r.id left join ds on ds.id = r.id and not r.looped""",
    "p4_descendants": WALK
    + """select anc ancestor, id descendant, cast(k - 1 as bigint) distance
from (select id, unnest(seen) anc, generate_subscripts(seen, 1) k from r where not looped) where k > 1""",
}
