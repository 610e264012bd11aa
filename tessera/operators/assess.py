"""How far a result can be trusted: coverage, confidence, uncertainty, bottlenecks. One row a query, in column expressions.

Columns are given by name, so whole logs of results are assessed at once. Null figures make null confidence; ratios over nothing are defined below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Figures that a confidence is worked out from, in this order.
FIGURES = "intent pivots pivots_packed relevant_packed relevant dependency noise summaries utilization term_coverage surface clusters_packed clusters avg_per_file max_per_file layers directories query_terms name_coverage".split()
#: Caps of the confidence: below a share of the budget used, above a share of noise, below a share of pivots.
BY_USE = [(0.15, 0.25), (0.25, 0.35), (0.35, 0.45), (0.50, 0.55), (0.60, 0.65), (0.70, 0.72)]
BY_NOISE = [(0.60, 0.35), (0.45, 0.50), (0.30, 0.65)]
BY_PIVOTS = [(0.30, 0.45), (0.50, 0.60), (0.70, 0.80)]
UNCERTAINTY = ["very_low", "low", "medium", "high", "critical"]


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ratio(a: Column, b: Column, other: Column) -> Column:
    return F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(other)


def capped(x: Column, steps: list[tuple[float, float]], value: Column, above: bool = False) -> Column:
    most = None
    for bound, cap in steps:
        test = value > bound if above else value < bound
        most = F.when(test, cap) if most is None else most.when(test, cap)
    return F.least(x, F.coalesce(most, F.lit(1.0)))


def confidence(c: dict[str, Column]) -> Column:
    """Confidence between 0 and 1 from the figures: by intent, then capped where little was used, covered or relevant."""
    intent = c["intent"]
    relevant = ratio(c["relevant_packed"], c["relevant"], F.when(c["pivots_packed"] > 0, 0.5).otherwise(0.0))
    pivots = ratio(c["pivots_packed"], c["pivots"], F.lit(0.0))
    modules = ratio(c["clusters_packed"], c["clusters"], F.when(c["clusters_packed"] > 0, 0.5).otherwise(0.0))
    story = ratio(F.least(c["avg_per_file"], c["max_per_file"]), c["max_per_file"], F.lit(0.0))
    clean, boost = 1 - c["noise"], F.least(F.lit(0.15), c["summaries"] * 0.03)
    surface = F.least(c["term_coverage"], c["surface"])
    plain = unit(relevant * 0.5 + c["dependency"] * 0.2 + clean * 0.15 + boost + 0.05)
    broad_health = unit(modules * 0.45 + relevant * 0.35 + clean * 0.2)
    broad = unit(modules * 0.35 + relevant * 0.25 + clean * 0.15 + boost + 0.10)
    broad = unit(broad * (0.35 + 0.65 * F.greatest(surface, F.when(c["surface"] >= 0.75, broad_health * 0.52).otherwise(0.0))))
    task_health = unit(story * 0.35 + modules * 0.3 + relevant * 0.2 + clean * 0.15)
    task = unit(story * 0.3 + modules * 0.25 + relevant * 0.2 + clean * 0.1 + 0.15)
    task = unit(task * (0.45 + 0.55 * F.greatest(surface, F.when(c["surface"] >= 0.7, task_health * 0.5).otherwise(0.0))))
    x = F.when(intent == "broad", broad).when(intent == "task", task).otherwise(plain)
    x = capped(capped(capped(x, BY_USE, c["utilization"]), BY_NOISE, c["noise"], above=True), BY_PIVOTS, pivots)
    # each step names what came before once, so that the expression grows by steps and not by doubling
    cap = lambda test, most: F.when(test, most).otherwise(1.0)
    x = F.least(x, cap((intent == "broad") & (c["pivots_packed"] < 3) | (relevant < 0.3), 0.5))
    x = x * cap((c["clusters"] > 0) & (c["clusters_packed"] > 3 * c["clusters"]), 0.85)
    x = F.least(x, cap((intent != "broad") & (c["relevant"] > 0) & (c["relevant_packed"] < c["relevant"] * 0.5), 0.55))
    wide = intent.isin("broad", "task")
    x = F.least(x, F.when(wide & (c["layers"] == 1), 0.40).when(wide & (c["layers"] == 2), 0.60).otherwise(1.0))
    x = x - F.when((c["query_terms"] == 1) & (c["directories"] >= 3), 0.2).otherwise(0.0)
    x = F.least(x, cap((c["query_terms"] > 0) & (c["name_coverage"] < 0.3) & (intent != "broad"), 0.50))
    exact = (intent != "broad") & (c["query_terms"] == 1) & (pivots >= 0.99) & (relevant >= 0.99) & (c["dependency"] >= 0.99) & (c["noise"] <= 0.35) & (c["utilization"] >= 0.18) & (c["utilization"] < 0.30)
    return unit(F.greatest(x, F.when(exact, 0.18).otherwise(-1.0)))


def label(x: Column) -> Column:
    return F.when(x < 0.45, "LOW").when(x < 0.75, "MEDIUM").otherwise("HIGH")


def tier(top_pivot: Column) -> tuple[Column, Column]:
    """The tier of the best pivot's score and how many further reads it calls for."""
    return F.when(top_pivot >= 10, "high").when(top_pivot >= 4, "medium").otherwise("low"), F.when(top_pivot >= 10, 2).when(top_pivot >= 4, 5).otherwise(10)


def reasons(c: dict[str, Column], selected: Column, sure: Column) -> Column:
    """What speaks against the result, as an array."""
    intent, narrow = c["intent"], c["intent"] == "narrow"
    pivots = ratio(c["pivots_packed"], c["pivots"], F.lit(0.0))
    modules = ratio(c["clusters_packed"], c["clusters"], F.when(c["clusters_packed"] > 0, 0.5).otherwise(0.0))
    healthy = (pivots >= 0.75) & (c["dependency"] >= 0.75) & (modules >= 0.75) & (c["surface"] >= 0.75) & (c["noise"] <= 0.2)
    floor = F.when(narrow, 0.55).otherwise(0.6)
    return F.array_compact(F.array(
        F.when(c["pivots"] == 0, "no pivot symbol match"), F.when((c["pivots"] > 0) & (pivots < 0.5), "pivot coverage below 50%"), F.when((selected > 0) & (c["dependency"] < 0.25), "dependency coverage below 25%"), F.when(c["noise"] > 0.6, "low-relevance content exceeds 60%"),
        F.when(~narrow & (c["term_coverage"] < 0.6) & ~healthy, "query term coverage below 60%"), F.when(~narrow & (c["surface"] < 0.5), F.concat(intent, F.lit(" retrieval surface too thin"))), F.when(sure < floor, F.concat(F.lit("overall coverage confidence below "), F.when(narrow, "55").otherwise("60"), F.lit("%"))),
    ))


def uncertainty(low: Column, reasons_n: Column, sure: Column, utilization: Column) -> Column:
    """One of five levels; a budget that is nearly used up makes it one worse."""
    at = F.when(~low & (sure >= 0.7), 0).when(~low, 1).when((reasons_n >= 4) | (sure < 0.2), 4).when((reasons_n >= 3) | (sure < 0.35) | (reasons_n >= 2) & (sure < 0.45), 3).otherwise(2)
    at = F.least(F.lit(4), at + (utilization >= 0.95).cast("int"))
    return F.element_at(F.array(*[F.lit(u) for u in UNCERTAINTY]), at + 1)


def bottlenecks(c: dict[str, Column], query_class: Column, candidates: Column, selected: Column, packed: Column, files: Column, low: Column, why: Column) -> Column:
    """Where the result lost most, as an array; empty where nothing stands out."""
    pivots = ratio(c["pivots_packed"], c["pivots"], F.lit(0.0))
    used = unit(c["utilization"])
    found = F.array_compact(F.array(
        F.when(candidates > 200, "pivot_flood"), F.when((used > 0.9) & (pivots < 0.5), "budget_exhaustion"), F.when((selected >= 50) & (packed / F.greatest(selected, F.lit(1)) < 0.35) & (c["dependency"] < 0.35), "bfs_noise"), F.when((files >= 10) & (packed / F.greatest(files, F.lit(1)) < 3), "packing_scatter"),
    ))
    lexical = (F.size(found) == 0) & (query_class != "narrow") & low & (pivots >= 0.85) & (c["dependency"] >= 0.75) & (used < 0.9) & F.exists(why, lambda r: F.contains(r, F.lit("query term coverage")))
    return F.when(lexical, F.array(F.lit("lexical_mismatch"))).otherwise(found)
