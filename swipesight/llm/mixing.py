"""Mixing sources to target weights by min-cost flow, for sources that may overlap.

1. Documents are aggregated by membership pattern (the set of sources they belong to): words and rows per pattern.
2. Targets: sources share all words by weight; a target stops at `most` times its source's size and the excess is shared
   again by weight among the rest, until none is above.
3. Flow: source quotas are filled from the patterns. The first use of a pattern's words costs 0, each repetition one more
   (a convex cost), at most `most` uses. Successive shortest paths give a cheapest flow: every word of capacity that
   can serve a quota is used once before any is repeated more than needed.
4. Selection: a pattern's flow is so many whole uses of all its documents and a rest. The rest goes to documents in the
   order of a seeded hash; one document of each pattern is used in part, so quotas are met to the word.

Only the pattern table comes to the driver; more than `MOST_PATTERNS` patterns raise an error. The rest is located without
sorting a pattern in one task: words are summed per hash slot, a running sum over the slots finds the slot in which the
rest ends, and only documents of that slot are ordered.

Null and empty texts have size 0 and are taken 0 times. The null source is a source, the last one. Rows that repeat
a doc_id are documents of their own, in a fixed order by text. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipesight.llm.words import blocks, words

MOST_PATTERNS = 50_000
SLOTS = 4096


def with_size(docs: DataFrame) -> DataFrame:
    """Adds `size`, the words of the text. Only the text goes to Python and only sizes come back; columns keep their order."""

    @F.arrow_udf(T.LongType())
    def size(texts: pa.Array) -> pa.Array:
        sizes = [np.diff(words(some).first) for _, _, some in blocks(pa.RecordBatch.from_arrays([texts], ["text"]))]
        return pa.array(np.concatenate(sizes) if sizes else np.zeros(0), pa.int64())

    return docs.select("*", size(F.col("text").cast("string")).alias("size"))


def targets(sizes: dict, weights: dict, most: float = 3) -> dict:
    """Words wanted of each source. Sources that overlap are each measured by all their words."""
    total, done = float(sum(sizes.values())), {}
    while True:
        free = [s for s in sizes if s not in done]
        share = sum(weights[s] for s in free)
        rest = total - sum(done.values())
        over = [s for s in free if rest * weights[s] / share > most * sizes[s]]
        if not over:
            return done | {s: rest * weights[s] / share for s in free}
        done |= {s: float(most * sizes[s]) for s in over}


def cheapest_flow(patterns: list[tuple[tuple, int]], quotas: dict, most: int) -> list[dict]:
    """For each pattern (sources, words): the words given to each of its sources.

    Successive shortest paths over pattern, use and source; the cost of a path is the number of earlier uses. A path may
    take words back from a source that another pattern can serve, so overlaps are settled at the least cost.
    """
    given: list[dict] = [{} for _ in patterns]
    used = [0] * len(patterns)
    left = dict(quotas)
    of_source: dict = {}
    for p, (sources, size) in enumerate(patterns):
        for s in sources if size else ():
            of_source.setdefault(s, []).append(p)

    def cheapest() -> tuple[list, int] | None:
        # From sources that want words, over patterns that could serve them, to a pattern with words left.
        best, queue, count = {}, [], 0
        for s, want in left.items():
            if want > 0:
                best[("s", s)] = (0, None)
                queue.append((0, count, ("s", s)))
                count += 1
        heapq.heapify(queue)
        goal, goal_cost = None, None
        while queue:
            cost, _, node = heapq.heappop(queue)
            if cost > best[node][0] or (goal_cost is not None and cost >= goal_cost):
                continue
            if node[0] == "s":
                onward = [("p", p) for p in of_source.get(node[1], ())]
            else:
                p = node[1]
                size = patterns[p][1]
                if used[p] < most * size and (goal_cost is None or cost + used[p] // size < goal_cost):
                    goal, goal_cost = node, cost + used[p] // size
                onward = [("s", s) for s, w in given[p].items() if w > 0]
            for other in onward:
                if other not in best or cost < best[other][0]:
                    best[other] = (cost, node)
                    count += 1
                    heapq.heappush(queue, (cost, count, other))
        if goal is None:
            return None
        path = [goal]
        while best[path[-1]][1] is not None:
            path.append(best[path[-1]][1])
        p = goal[1]
        room = patterns[p][1] - used[p] % patterns[p][1]  # up to the next, dearer use
        moved = min([room, left[path[-1][1]], *(given[path[i + 1][1]][path[i][1]] for i in range(1, len(path) - 1, 2))])
        return path, moved

    while (found := cheapest()) is not None:
        path, moved = found
        used[path[0][1]] += moved
        for i in range(0, len(path) - 1, 2):
            given[path[i][1]][path[i + 1][1]] = given[path[i][1]].get(path[i + 1][1], 0) + moved
        for i in range(1, len(path) - 1, 2):
            given[path[i + 1][1]][path[i][1]] -= moved
        left[path[-1][1]] -= moved
    return given


def mix(docs: DataFrame, sources: str, weights=None, most: int = 3, seed: int = 1) -> DataFrame:
    """`docs` with size, pattern, source_size, target and taken.

    `sources`: expression of the array of a row's sources. `weights`: source to weight; by default 1, 2, 3 repeating over
    the sources by code point, null last. `source_size` and `target` are those of the row's first source.
    """
    sized = with_size(docs).withColumn("pattern", F.expr(f"array_sort(array_distinct({sources}))"))
    table = sized.groupBy("pattern").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    found = table.limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    sizes: dict = {}
    for row in found:
        for s in row.pattern or ():
            sizes[s] = sizes.get(s, 0) + row.words
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    if weights is None:
        weights = {s: 1 + i % 3 for i, s in enumerate(order)}
    wanted = targets({s: sizes[s] for s in order}, weights, most) if order else {}
    found.sort(key=lambda r: [(s is None, s or "") for s in r.pattern or ()])
    flow = cheapest_flow([(tuple(r.pattern or ()), r.words) for r in found], {s: round(wanted[s]) for s in order}, most)
    plan = []
    for row, given in zip(found, flow, strict=True):
        words_taken, first = sum(given.values()), (row.pattern or [None])[0]
        uses, rest = divmod(words_taken, row.words) if row.words else (0, 0)
        plan.append((row.pattern, sizes.get(first, 0), wanted.get(first, 0.0), uses, rest))
    plans = docs.sparkSession.createDataFrame(
        plan, "pattern array<string>, source_size bigint, target double, uses bigint, rest bigint"
    )
    return _select(sized, F.broadcast(plans), seed)  # at most MOST_PATTERNS rows


def _select(sized: DataFrame, plans: DataFrame, seed: int) -> DataFrame:
    text_hash = F.xxhash64("text")
    rank = F.xxhash64(F.lit(seed), "doc_id", text_hash)
    same = F.col("pattern").eqNullSafe(F.col("of"))
    rows = sized.join(plans.withColumnRenamed("pattern", "of"), same).drop("of").withColumn("_rank", rank).withColumn(
        "_slot", F.pmod("_rank", F.lit(SLOTS))
    )
    slots = rows.where("rest > 0").groupBy("pattern", "_slot", "rest").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("pattern").orderBy("_slot")) - F.col("words")
    # The last slot of each pattern that is used, and the words that are taken from it: one row for each pattern.
    last = slots.withColumn("before", before).where("before < rest AND before + words >= rest").select(
        F.col("pattern").alias("of"), F.col("_slot").alias("last"), (F.col("rest") - F.col("before")).alias("more")
    )
    rows = rows.join(F.broadcast(last), same, "left").drop("of")
    inside = rows.where("_slot = last").withColumn(
        "_before", F.sum("size").over(Window.partitionBy("pattern").orderBy("_rank", "doc_id", "size").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    ).withColumn("extra", F.expr("greatest(0L, least(size, more - _before))")).drop("_before")
    outside = rows.where("NOT (_slot <=> last)").withColumn("extra", F.expr("CASE WHEN _slot < last THEN size ELSE 0L END"))
    both = outside.unionByName(inside)
    return both.withColumn("taken", F.expr("uses * size + extra")).drop("_rank", "_slot", "last", "more", "extra", "uses", "rest")
