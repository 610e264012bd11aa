"""Scoring of candidates and packing under a token budget.

Packing is sequential by nature: each choice depends on what the ones before left over. So it runs in one Arrow batch a query, over a bounded top-k.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of distance, centrality, recency, memory and export in each mode.
MODES = {"debug": (1.0, 0.3, 1.5, 1.2, 0.2), "refactor": (0.7, 1.5, 0.5, 0.8, 1.0), "feature": (1.0, 1.0, 1.0, 1.0, 0.5), "review": (0.5, 1.2, 0.8, 1.0, 0.8)}
#: What a level keeps of a symbol's full size where only that size is known; renderings are counted instead wherever there are texts.
LEVEL_SHARE = (1.0, 0.5, 0.2, 0.06)
#: Share of the budget for code, share of one-line symbols, use at which promotion ends, and symbols a file needs for a line of its own.
CODE_SHARE, ONE_LINERS, FULL_ENOUGH, FILE_SYMBOLS = 0.8, 0.3, 0.85, 3
#: Words of a query's intent; the first group with a word in the query decides.
INTENTS = [("debug", "error|exception|bug|crash|fail|fails|failing|broken|fix|why"), ("task", "add|implement|create|build|refactor|change|update|remove|migrate|write"), ("broad", "architecture|overview|structure|flow|how does|explain|design|system")]


def node_score(mode: str, distance: Column, centrality: Column, age_days: Column, notes: Column, exported: Column, lexical: Column | None = None, pivot: Column | None = None) -> Column:
    """Distance, centrality, recency, notes and export, weighed by the mode, with a penalty for hubs."""
    wd, wc, wr, wm, we = MODES[mode]
    hub = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (centrality - 0.08) / 0.22))
    least = F.when(pivot if pivot is not None else F.lit(False), 0.7).otherwise(0.4)
    score = F.pow(1 / (distance + 1), F.lit(wd)) * (1 + F.log1p(F.greatest(F.lit(0.0), centrality) * 100000) * wc) * (1 + wr * F.greatest(F.lit(0.1), 1 - age_days / 30))
    score = score * (1 + wm * F.least(notes, F.lit(5)) / 5) * (1 + F.when(exported, we).otherwise(0.0)) * (1 - hub * (1 - least))
    return score * lexical if lexical is not None else score


def level(score: Column, distance: Column, largest: Column) -> Column:
    """0 for pivots, then 1 from 0.6 of the largest score, 2 from 0.3, else 3."""
    part = F.when(largest > 0, score / F.greatest(largest, F.lit(1e-12))).otherwise(0.0)
    return F.when(distance == 0, 0).when(part >= 0.6, 1).when(part >= 0.3, 2).otherwise(3)


def intent(query: Column) -> Column:
    """The short form, by three groups of words: the first one that matches; else narrow. ``functions.query.intent`` is the whole classification."""
    out = F.when(query.rlike(r"^\s*[\w.]*(?:[a-z][A-Z]|_)[\w.]*\s*$"), "symbol-lookup")
    for name, words in INTENTS:
        out = out.when(F.lower(query).rlike(rf"\b({words})\b"), name)
    return out.otherwise("narrow")


@dataclass
class Item:
    """One candidate; ``sizes`` are its tokens at levels 0 to 3."""

    id: int
    file: int
    first: int
    last: int
    score: float
    level: int
    sizes: tuple[int, ...]
    distance: int = 1
    group: object = None
    path: str = ""
    name: str = ""
    ui: bool = False


@dataclass
class Shelf:
    """What has been packed so far, in order, under a budget that is never exceeded."""

    budget: int
    used: int = 0
    at: dict[int, int] = field(default_factory=dict)
    items: dict[int, Item] = field(default_factory=dict)

    def put(self, item: Item, level: int) -> bool:
        if item.id in self.at or self.used + item.sizes[level] > self.budget:
            return False
        self.at[item.id], self.items[item.id] = level, item
        self.used += item.sizes[level]
        return True

    def promote(self, item: Item, level: int) -> bool:
        more = item.sizes[level] - item.sizes[self.at[item.id]]
        if more <= 0 or self.used + more > self.budget:
            return False
        self.at[item.id] = level
        self.used += more
        return True

    def full(self, share: float) -> bool:
        return self.used >= share * self.budget

    def by_score(self, least: int, test=lambda item: True) -> list[Item]:
        return sorted((i for i in self.items.values() if self.at[i.id] >= least and test(i)), key=lambda i: (-i.score, i.id))

    def drop_contained(self) -> None:
        """Symbols within another packed one of their file that is told at least as fully."""
        files: dict[int, list[Item]] = {}
        for item in self.items.values():
            files.setdefault(item.file, []).append(item)
        for items in files.values():
            items.sort(key=lambda i: (i.first, -i.last, i.id))
            open_: list[Item] = []
            for item in items:
                open_ = [o for o in open_ if o.last >= item.first]
                if any(o.first < item.first and item.last <= o.last and self.at[o.id] <= self.at[item.id] for o in open_):
                    self.used -= item.sizes[self.at.pop(item.id)]
                    del self.items[item.id]
                else:
                    open_.append(item)


def ranked_items(items: list[Item]) -> list[Item]:
    return sorted(items, key=lambda i: (-i.score, i.id))


def pack_plain(items: list[Item], budget: int) -> Shelf:
    """By score, each at its own level or the next one that fits; then promotion, one-liners, and removal of what is contained.

    The best pivot comes first and whole. At most three tenths of the candidates, or five, go in as one line at first.
    """
    order, shelf = ranked_items(items), Shelf(budget)
    lines, most = 0, max(5, -(-len(order) * 3 // 10))
    if order and order[0].distance == 0:
        shelf.put(order[0], 0)
    for item in order:
        if item.id in shelf.at:
            continue
        for level in range(item.level, 4):
            if level == 3 and lines >= most:
                continue
            if shelf.put(item, level):
                lines += level == 3
                break
    if shelf.budget - shelf.used > 50:
        for item in shelf.by_score(3):
            any(shelf.promote(item, level) for level in (2, 1, 0))
    for item in shelf.by_score(1):
        if shelf.full(FULL_ENOUGH):
            break
        shelf.promote(item, 0)
    for item in order:
        if shelf.full(FULL_ENOUGH):
            break
        shelf.put(item, 3)
    shelf.drop_contained()
    return shelf


def priority(items: list[Item]) -> float:
    """Of a group: its best score, pivots and their neighbours, less for distance."""
    n = len(items)
    return max(i.score for i in items) + 2 * sum(i.distance == 0 for i in items) + 0.9 * sum(i.distance == 1 for i in items) - 0.35 * sum(i.distance for i in items) / n


def pack_story(items: list[Item], budget: int, whole_budget: int) -> Shelf:
    """Group by group of files that belong together, each with half as much again as its fair share; then the tail, promotion and refill."""
    shelf = Shelf(budget)
    if not items or budget <= 0:
        return shelf
    groups: dict[object, list[Item]] = {}
    for item in items:
        groups.setdefault(item.group if item.group is not None else -item.file, []).append(item)
    first = sorted(groups.items(), key=lambda g: (-priority(g[1]), str(g[0])))[: max(1, min(len(groups), max(3, whole_budget // 800)))]
    wholes, most_whole = 0, max(2, min(5, budget // 1200 + 1))
    for at, (_, members) in enumerate(first):
        if shelf.used >= int(budget * 0.9):
            break
        room = min(budget - shelf.used, int((budget - shelf.used) // max(1, len(first) - at) * 1.5))
        members = sorted(members, key=lambda i: (i.distance != 0, -i.score, i.id))
        best, begun = members[0].score, shelf.used
        for item in members:
            level = (0 if wholes < most_whole and item.score >= best * 0.5 else 1) if item.distance == 0 else 1 if item.score >= best * 0.65 else 2
            if item.distance == 0 and item.ui and item.level > 0:
                level = item.level
            for k in range(level, 4):
                if shelf.used - begun + item.sizes[k] <= room and shelf.put(item, k):
                    wholes += k == 0
                    break
    best = max((i.score for i in shelf.items.values()), default=0.0)
    for item in shelf.by_score(2, lambda i: i.score >= best * 0.8):
        if shelf.full(0.9):
            break
        shelf.promote(item, 0 if item.score >= best * 0.95 else 1)

    def tail() -> list[Item]:
        files = {i.file for i in shelf.items.values()}
        worth = lambda i: i.score + {1: 2, 2: 0.25}.get(i.distance, 0) + (0 if i.file in files else 0.5)
        return sorted((i for i in items if i.id not in shelf.at), key=lambda i: (-worth(i), i.distance, -i.score, i.id))

    for item in tail():
        shelf.put(item, 3)
    for item in shelf.by_score(1, lambda i: i.distance > 0):
        if shelf.full(FULL_ENOUGH):
            break
        shelf.promote(item, 0)
    if not shelf.full(0.5):
        known = {i.file for i in shelf.items.values() if shelf.at[i.id] <= 1}
        for item in ranked_items([i for i in items if i.id not in shelf.at and i.file in known]):
            if shelf.full(0.5):
                break
            shelf.put(item, 3 if shelf.full(0.35) else 2)
    shelf.drop_contained()
    for item in tail():
        if shelf.full(FULL_ENOUGH):
            break
        shelf.put(item, 2 if item.distance <= 1 and item.score >= best * 0.65 else 3)
    shelf.drop_contained()
    return shelf


def file_lines(items: list[Item], shelf: Shelf) -> list[tuple[int, int]]:
    """(file, tokens) of a line for each file with enough symbols left out, while they fit."""
    left: dict[int, list[Item]] = {}
    for item in items:
        if item.id not in shelf.at:
            left.setdefault(item.file, []).append(item)
    least, out = (FILE_SYMBOLS if shelf.full(0.4) else 1), []
    for file, members in left.items():
        names = [i.name for i in members]
        line = f"[file] {members[0].path}: {len(names)} symbols ({', '.join(names[:8])}{f', +{len(names) - 8} more' if len(names) > 8 else ''})"
        size = -(-len(line) * 2 // 7)
        if len(names) >= least and shelf.used + size <= shelf.budget:
            out.append((file, size))
            shelf.used += size
    return out


def merged_items(results: list[tuple[list[Item], Shelf, set[int]]]) -> list[Item]:
    """The items of several results, each once at its fullest (then best, then smallest) form, pivots and full ones of the first results first."""
    best: dict[int, tuple] = {}
    rank: dict[int, int] = {}
    for number, (_, shelf, pivots) in enumerate(results):
        for item in shelf.items.values():
            level = shelf.at[item.id]
            form = (level, -item.score, item.sizes[level])
            if item.id not in best or form < best[item.id][0]:
                best[item.id] = (form, item)
            place = number * 10 + (0 if item.id in pivots else 1 if level <= 1 else 2)
            rank[item.id] = min(rank.get(item.id, place), place)
    return [item for _, item in sorted(best.values(), key=lambda x: (rank[x[1].id], x[1].distance != 0, -x[1].score, x[0][0], x[1].id))]


PACKED = "query_id int, kind string, symbol_id bigint, file_id bigint, level int, tokens bigint, position bigint"


def pack_queries(candidates: DataFrame, budget: int, story: bool = False) -> DataFrame:
    """(query_id, kind, symbol_id, file_id, level, tokens, position): what goes into each query's answer, symbols first, then lines about files.

    ``candidates``: (query_id, symbol_id, file_id, start_line, end_line, score, level, sizes) and, where there are any, distance, grouping, path, name,
    ui and story (a query's own choice). Candidates of one query are one group: callers bound them by a top-k, which is the feature here. Code
    gets four fifths of the budget. Ties end with the smaller id; no candidates give no rows.
    """

    def items_of(pdf: pd.DataFrame) -> list[Item]:
        out = []
        for r in pdf.to_dict("records"):
            out.append(Item(int(r["symbol_id"]), int(r["file_id"]), int(r["start_line"]), int(r["end_line"]), float(r["score"]), int(r["level"]), tuple(int(x) for x in r["sizes"]), int(r.get("distance", 1)), r.get("grouping"), r.get("path") or "", r.get("name") or "", bool(r.get("ui", False))))
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = items_of(pdf)
        code = int(budget * CODE_SHARE)
        as_story = bool(pdf["story"].iloc[0]) if "story" in pdf else story
        shelf = pack_story(ranked_items(items), code, budget) if as_story else pack_plain(items, code)
        lines = file_lines(ranked_items(items), shelf)
        q = pdf["query_id"].iloc[0]
        rows = [(q, "symbol", i.id, i.file, shelf.at[i.id], i.sizes[shelf.at[i.id]], k) for k, i in enumerate(shelf.items.values())]
        rows += [(q, "file", None, f, None, n, len(rows) + k) for k, (f, n) in enumerate(lines)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")]).astype({"symbol_id": "Int64", "level": "Int32"})

    return candidates.groupBy("query_id").applyInPandas(run, PACKED)


def merge_queries(candidates: DataFrame, budget: int) -> DataFrame:
    """One answer for each query from its sub-queries: (query_id, sub, share, ... as for ``pack_queries``), each packed in its share, merged and packed again."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        results = []
        for _, part in pdf.sort_values("sub").groupby("sub", sort=True):
            items = [Item(int(r["symbol_id"]), int(r["file_id"]), int(r["start_line"]), int(r["end_line"]), float(r["score"]), int(r["level"]), tuple(int(x) for x in r["sizes"]), int(r.get("distance", 1)), r.get("grouping"), r.get("path") or "", r.get("name") or "") for r in part.to_dict("records")]
            own = int(budget * float(part["share"].iloc[0]))
            results.append((items, pack_story(ranked_items(items), int(own * CODE_SHARE), own), {i.id for i in items if i.distance == 0}))
        items = merged_items(results)
        shelf = pack_story(items, int(budget * CODE_SHARE), budget)
        rows = [(pdf["query_id"].iloc[0], "symbol", i.id, i.file, shelf.at[i.id], i.sizes[shelf.at[i.id]], k) for k, i in enumerate(shelf.items.values())]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")]).astype({"symbol_id": "Int64", "level": "Int32"})

    return candidates.groupBy("query_id").applyInPandas(run, PACKED)


def pack(candidates: DataFrame, budget: int) -> DataFrame:
    """(query_id, symbol_id, level, tokens, position) where only full sizes are known: (query_id, symbol_id, file_id, start_line, end_line, score, level, full_tokens)."""
    sizes = F.array(*[F.greatest(F.lit(1), F.ceil(F.col("full_tokens") * share)).cast("bigint") for share in LEVEL_SHARE])
    rows = pack_queries(candidates.withColumn("sizes", sizes), budget)
    return rows.filter("kind = 'symbol'").select("query_id", "symbol_id", "level", "tokens", "position")
