"""Queries of rendering and assessment: formulas over figures taken from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import assess as A
from tessera.operators import rendering as R
from tessera.plans.relational import E, S, edges, files, symbols
from tessera.sources.tables import table


def rendered_rows(s, d):
    """Symbols with their paths and the names of what they depend on, in order of the names."""
    rows = symbols(s, d, "file_id", "name", "kind", "signature", "full_source", "start_line", "end_line", "is_exported").join(files(s, d, "path").withColumnRenamed("id", "file_id"), "file_id")
    names = rows.select(F.col("id").alias("target_symbol_id"), "name")
    deps = edges(s, d).join(names, "target_symbol_id").groupBy(F.col("source_symbol_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("deps"))
    return rows.join(deps, "id", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))


def rendered_tokens(s, d):
    """The tokens of each symbol at each level of detail."""
    t = R.tokens_of_levels(F.col("deps"))
    return rendered_rows(s, d).select("id", t.alias("t")).select("id", *[F.col("t")[k].alias(f"l{k}") for k in range(4)])


def rendered_digests(s, d):
    """What each symbol reads like at levels 1 to 3."""
    rows = rendered_rows(s, d)
    return rows.select("id", F.sha2(R.level1(), 256).alias("l1"), F.sha2(R.level2(F.col("deps")), 256).alias("l2"), R.level3().alias("l3"))


def file_lines_told(s, d):
    rows = symbols(s, d, "file_id", "name").groupBy("file_id").agg(F.array_sort(F.collect_list("name")).alias("names")).join(files(s, d, "path").withColumnRenamed("id", "file_id"), "file_id")
    return rows.select("file_id", R.file_line(F.col("path"), F.col("names")).alias("line"))


def figures(s, d):
    """A row of figures per document, spread over their ranges, to try the formulas on."""
    n, k = F.coalesce(F.col("n_chars"), F.lit(0)), F.col("doc_id")
    part = lambda a, m: (n * a + k) % m / (m - 1)
    whole = lambda a, m: (n * a + k) % m
    values = {
        "intent": F.element_at(F.array(*[F.lit(x) for x in ("narrow", "broad", "task", "debug")]), (k % 4 + 1).cast("int")), "pivots": whole(3, 7), "pivots_packed": F.least(whole(3, 7), whole(5, 8)), "relevant": whole(7, 5), "relevant_packed": F.least(whole(7, 5), whole(11, 6)), "dependency": part(13, 11),
        "noise": part(17, 13) * 0.7, "summaries": whole(19, 6), "utilization": part(23, 17), "term_coverage": part(29, 9), "surface": part(31, 10), "clusters": whole(37, 5), "clusters_packed": whole(41, 7), "avg_per_file": whole(43, 4) / 2, "max_per_file": whole(47, 5),
        "layers": whole(53, 4), "directories": whole(59, 5), "query_terms": whole(61, 4), "name_coverage": part(67, 8),
    }
    return table(s, d, "documents").select("doc_id", *[v.alias(c) for c, v in values.items()])


def confidence_formula(s, d):
    rows = figures(s, d).select("doc_id", "intent", F.round(A.confidence({name: F.col(name) for name in A.FIGURES}), 6).alias("confidence"))
    return rows.withColumn("label", A.label(F.col("confidence")))


def uncertainty_levels(s, d):
    c = {name: F.col(name) for name in A.FIGURES}
    rows = figures(s, d).withColumn("sure", F.round(A.confidence(c), 6))
    rows = rows.withColumn("why", A.reasons(c, F.col("pivots") * 2, F.col("sure")))
    level = A.uncertainty(F.size("why") > 0, F.size("why"), F.col("sure"), F.col("utilization"))
    kind, reads = A.tier(F.col("pivots") * 2.5)
    return rows.select("doc_id", F.array_join("why", "; ").alias("reasons"), level.alias("uncertainty"), kind.alias("tier"), reads.cast("bigint").alias("reads"))


def bottleneck_rules(s, d):
    c = {name: F.col(name) for name in A.FIGURES}
    rows = figures(s, d).withColumn("sure", F.round(A.confidence(c), 6))
    rows = rows.withColumn("why", A.reasons(c, F.col("pivots") * 2, F.col("sure")))
    packed, n_files = F.col("pivots_packed") * 6, F.col("directories") * 4
    found = A.bottlenecks(c, F.col("intent"), F.col("pivots") * 40, F.col("pivots") * 12, packed, n_files, F.size("why") > 0, F.col("why"))
    return rows.groupBy(F.array_join(found, ",").alias("bottlenecks")).agg(F.count(F.lit(1)).alias("n"))


def token_efficiency(s, d):
    """Per file: how much a budget of a fifth of its text saves, how much of it is used, and the share of noise."""
    rows = table(s, d, "chunks").select("id", "file_id", "text").dropDuplicates(["id"]).groupBy("file_id").agg(F.sum(X.estimate_tokens(F.col("text"))).alias("raw"), F.max(X.estimate_tokens(F.col("text"))).alias("used"), F.avg((F.length("text") < 80).cast("double")).alias("noise"))
    return rows.select("file_id", F.round(A.unit(1 - F.col("used") / F.greatest(F.col("raw"), F.lit(1))), 6).alias("efficiency"), F.round(A.unit(F.col("used") / 2000), 6).alias("utilization"), F.round("noise", 6).alias("noise"))


QUERIES = {f.__name__: f for f in (rendered_tokens, rendered_digests, file_lines_told, confidence_formula, uncertainty_levels, bottleneck_rules, token_efficiency)}
T = "greatest(1, cast(ceil(length({0}) / 3.5) as bigint))"
ROWS = f"""n as (select distinct id, name from symbols), dp as (select e.source_symbol_id id, list_sort(list(distinct n.name)) deps from {E} e join n on n.id = e.target_symbol_id group by 1),
r as (select s.*, f.path, coalesce(dp.deps, []) deps, string_split(s.full_source, chr(10)) ls from {S} s join files f on f.id = s.file_id left join dp on dp.id = s.id),
a as (select *, '// ' || path || ':' || start_line || '-' || end_line h0, '// ' || path || ':' || start_line || ' [' || kind || '] ' || case when is_exported then 'export ' else '' end || signature h1 from r),
b as (select *, ls[greatest(1, len(ls) - 2):] tl, cast(ceil(length(h0 || chr(10) || ls[1] || chr(10) || '// ... cut; read ' || name || ' for the full source' || chr(10) || array_to_string(ls[greatest(1, len(ls) - 2):], chr(10))) / 3.5) as bigint) u, list_transform(ls[2:greatest(len(ls) - 3, 1)], lambda x: cast(ceil(length(x) / 3.5) as bigint)) lt from a),
c as (select *, 1 + len(list_filter(range(1, len(lt) + 1), lambda i: u + list_sum(lt[1:i]) <= 420)) hd from b),
d as (select *, len(ls) - hd - len(tl) om from c),
x as (select *, case when ceil(length(h0 || chr(10) || full_source) / 3.5) <= 600 or om <= 0 then h0 || chr(10) || full_source else h0 || chr(10) || array_to_string(ls[1:hd], chr(10)) || chr(10) || '// ... ' || om || ' more lines; read ' || name || ' for the full source' || chr(10) || array_to_string(tl, chr(10)) end l0,
case when len(ls) > 100 then h1 || chr(10) || array_to_string(ls[1:60], chr(10)) || chr(10) || '// ... ' || (len(ls) - 100) || ' lines omitted; read ' || name || ' for the full source' || chr(10) || array_to_string(ls[-40:], chr(10)) else h1 || chr(10) || full_source end l1,
'[' || kind || '] ' || name || ' (' || path || ':' || start_line || ')' || chr(10) || 'sig: ' || signature || case when len(deps) > 0 then chr(10) || 'deps: ' || array_to_string(deps[1:5], ', ') || case when len(deps) > 5 then ', +' || (len(deps) - 5) || ' more' else '' end else '' end l2,
kind || ' ' || name || ' @ ' || path || ':' || start_line l3 from d)"""
FIG = """n as (select doc_id, coalesce(n_chars, 0) n from documents), f as (select doc_id, ['narrow', 'broad', 'task', 'debug'][doc_id % 4 + 1] intent, (n * 3 + doc_id) % 7 pivots, least((n * 3 + doc_id) % 7, (n * 5 + doc_id) % 8) pp, (n * 7 + doc_id) % 5 rel, least((n * 7 + doc_id) % 5, (n * 11 + doc_id) % 6) rp,
(n * 13 + doc_id) % 11 / 10 dep, (n * 17 + doc_id) % 13 / 12 * 0.7::double noise, (n * 19 + doc_id) % 6 summ, (n * 23 + doc_id) % 17 / 16 ut, (n * 29 + doc_id) % 9 / 8 tc, (n * 31 + doc_id) % 10 / 9 sf, (n * 37 + doc_id) % 5 cl, (n * 41 + doc_id) % 7 cp, (n * 43 + doc_id) % 4 / 2 av, (n * 47 + doc_id) % 5 mx,
(n * 53 + doc_id) % 4 ly, (n * 59 + doc_id) % 5 dirs, (n * 61 + doc_id) % 4 qt, (n * 67 + doc_id) % 8 / 7 nc from n),
g as (select *, case when rel > 0 then rp / rel when pp > 0 then 0.5 else 0 end rc, case when pivots > 0 then pp / pivots else 0 end pc, case when cl > 0 then cp / cl when cp > 0 then 0.5 else 0 end mc, case when mx > 0 then least(1, av / mx) else 0 end st, least(0.15, summ * 0.03::double) bo, least(tc, sf) ls from f),
h as (select *, greatest(0, least(1, rc * 0.5::double + dep * 0.2::double + (1 - noise) * 0.15::double + bo + 0.05::double)) pl, greatest(0, least(1, mc * 0.45::double + rc * 0.35::double + (1 - noise) * 0.2::double)) bh, greatest(0, least(1, mc * 0.35::double + rc * 0.25::double + (1 - noise) * 0.15::double + bo + 0.1::double)) bb,
greatest(0, least(1, st * 0.35::double + mc * 0.3::double + rc * 0.2::double + (1 - noise) * 0.15::double)) th, greatest(0, least(1, st * 0.3::double + mc * 0.25::double + rc * 0.2::double + (1 - noise) * 0.1::double + 0.15::double)) tb from g),
i as (select *, case intent when 'broad' then greatest(0, least(1, bb * (0.35::double + 0.65::double * case when sf >= 0.75 then greatest(ls, bh * 0.52::double) else ls end))) when 'task' then greatest(0, least(1, tb * (0.45::double + 0.55::double * case when sf >= 0.7 then greatest(ls, th * 0.5::double) else ls end))) else pl end x0 from h),
j as (select *, least(x0, case when ut < 0.15 then 0.25 when ut < 0.25 then 0.35 when ut < 0.35 then 0.45 when ut < 0.5 then 0.55 when ut < 0.6 then 0.65 when ut < 0.7 then 0.72 else 1 end, case when noise > 0.6 then 0.35 when noise > 0.45 then 0.5 when noise > 0.3 then 0.65 else 1 end, case when pc < 0.3 then 0.45 when pc < 0.5 then 0.6 when pc < 0.7 then 0.8 else 1 end) x1 from i),
k as (select *, case when (intent = 'broad' and pp < 3) or rc < 0.3 then least(x1, 0.5) else x1 end * case when cl > 0 and cp > 3 * cl then 0.85::double else 1 end x2 from j),
l as (select *, case when intent <> 'broad' and rel > 0 and rp < rel * 0.5 then least(x2, 0.55) else x2 end x3 from k), m as (select *, case when intent in ('broad', 'task') and ly = 1 then least(x3, 0.4) when intent in ('broad', 'task') and ly = 2 then least(x3, 0.6) else x3 end x4 from l),
o as (select *, case when qt = 1 and dirs >= 3 then x4 - 0.2::double else x4 end x5 from m), p as (select *, case when qt > 0 and nc < 0.3 and intent <> 'broad' then least(x5, 0.5) else x5 end x6 from o),
q as (select *, round(greatest(0, least(1, case when intent <> 'broad' and qt = 1 and pc >= 0.99 and rc >= 0.99 and dep >= 0.99 and noise <= 0.35 and ut >= 0.18 and ut < 0.3 then greatest(x6, 0.18) else x6 end)), 6)::double sure from p),
w as (select *, list_filter([case when pivots = 0 then 'no pivot symbol match' end, case when pivots > 0 and pc < 0.5 then 'pivot coverage below 50%' end, case when pivots > 0 and dep < 0.25 then 'dependency coverage below 25%' end, case when noise > 0.6 then 'low-relevance content exceeds 60%' end,
case when intent <> 'narrow' and tc < 0.6 and not (pc >= 0.75 and dep >= 0.75 and mc >= 0.75 and sf >= 0.75 and noise <= 0.2) then 'query term coverage below 60%' end, case when intent <> 'narrow' and sf < 0.5 then intent || ' retrieval surface too thin' end, case when sure < case when intent = 'narrow' then 0.55 else 0.6 end then 'overall coverage confidence below ' || case when intent = 'narrow' then '55' else '60' end || '%' end], lambda z: z is not null) why from q)"""
SQL = {
    "rendered_tokens": f"with {ROWS} select id, {T.format('l0')} l0, {T.format('l1')} l1, {T.format('l2')} l2, {T.format('l3')} l3 from x",
    "rendered_digests": f"with {ROWS} select id, sha256(l1) l1, sha256(l2) l2, l3 from x",
    "file_lines_told": f"select file_id, '[file] ' || any_value(path) || ': ' || count(*) || ' symbols (' || array_to_string((list_sort(list(name)))[1:8], ', ') || case when count(*) > 8 then ', +' || (count(*) - 8) || ' more' else '' end || ')' as line from {S} s join files f on f.id = s.file_id group by 1",
    "confidence_formula": f"with {FIG} select doc_id, intent, sure confidence, case when sure < 0.45 then 'LOW' when sure < 0.75 then 'MEDIUM' else 'HIGH' end as label from q",
    "uncertainty_levels": f"with {FIG}, y as (select *, len(why) > 0 lo, len(why) k from w), z as (select *, case when not lo and sure >= 0.7 then 0 when not lo then 1 when k >= 4 or sure < 0.2 then 4 when k >= 3 or sure < 0.35 or (k >= 2 and sure < 0.45) then 3 else 2 end at_ from y) select doc_id, array_to_string(why, '; ') reasons, ['very_low', 'low', 'medium', 'high', 'critical'][least(4, at_ + (ut >= 0.95)::int) + 1] uncertainty, case when pivots * 2.5 >= 10 then 'high' when pivots * 2.5 >= 4 then 'medium' else 'low' end tier, case when pivots * 2.5 >= 10 then 2 when pivots * 2.5 >= 4 then 5 else 10 end::bigint reads from z",
    "bottleneck_rules": f"with {FIG}, y as (select *, list_filter([case when pivots * 40 > 200 then 'pivot_flood' end, case when ut > 0.9 and pc < 0.5 then 'budget_exhaustion' end, case when pivots * 12 >= 50 and pp * 6 / greatest(1, pivots * 12) < 0.35 and dep < 0.35 then 'bfs_noise' end, case when dirs * 4 >= 10 and pp * 6 / greatest(1, dirs * 4) < 3 then 'packing_scatter' end], lambda z: z is not null) b from w), z as (select case when len(b) = 0 and intent <> 'narrow' and len(why) > 0 and pc >= 0.85 and dep >= 0.75 and ut < 0.9 and list_contains(why, 'query term coverage below 60%') then ['lexical_mismatch'] else b end b from y) select array_to_string(b, ',') bottlenecks, count(*) n from z group by 1",
    "token_efficiency": "with t as (select file_id, cast(ceil(length(text) / 3.5) as bigint) t, length(text) n from (select distinct id, file_id, text from chunks)), g as (select file_id, sum(t) raw, max(t) used, avg((n < 80)::int) noise from t group by 1) select file_id, round(greatest(0, least(1, 1 - used / greatest(raw, 1))), 6)::double efficiency, round(least(1, used / 2000), 6)::double utilization, round(noise, 6) noise from g",
}
