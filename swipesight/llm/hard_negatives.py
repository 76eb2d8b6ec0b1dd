"""Hard negatives for anchors, with spanning-tree bounds over the anchors.

Rows: a row takes part if vec_id, label and vector are not null and no component is null, NaN or infinite; a component x
becomes `floor(256 * x)` (as double). Rows whose components reach 2^31 in size take no part either: their inner products
could leave 64 bits. A row's score against an anchor is the integer inner product (over the positions both have; vectors
of other lengths count as padded with zeros). Order: higher score first, ties by smaller vec_id.

Anchors are the rows whose vec_id is divisible by `every`. An anchor's positives are the first `positives` other rows of
its label (rows of its own vec_id excepted); for each positive with score p, its negatives are the first `negatives` rows
of another label with `low * p <= 100 * n <= 100 * p`.

Method. Anchors are dealt into blocks of about `block` by sign bits of random projections (so that a block holds anchors
near each other), and split at random where a bit pattern is too full. In each block a minimum spanning tree joins the
anchors, rooted at its medoid. Candidate rows are dealt into chunks of about `chunk`. Every (block, chunk) pair is one
task: the root's scores are computed exactly; a child c of parent p has `s_p(x) - |c - p| |x| <= s_c(x) <= s_p(x) + |c - p| |x|`
(Cauchy-Schwarz), from the parent's bounds or exact scores. Only candidates whose interval can reach the wanted window
are scored exactly: for positives, those whose upper bound reaches the fifth best lower bound of the anchor's label; for
negatives, those whose interval overlaps a window `[low p, p]` of one of the anchor's positives. The local first five are
merged over chunks by a window per anchor (or per anchor and positive), whose rows are at most five per chunk.

Two passes: positives first, then negatives with the positives' scores. Exact arithmetic: float64 while products fit 53
bits, else int64. Results: anchor_id, positive_id, rank (1 up), negative_id, positive_score, negative_score; an anchor
without positives, or a positive without negatives, gives no row. An empty table gives no rows. Repeated vec_ids are
separate rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipesight.session import settle

BLOCK = 256  # anchors per block, about
CHUNK = 4096  # candidate rows per chunk, about
TOP = 5
LIMIT = 2**31

_ANCHOR = "a_key long, anchor_id long, alabel int, block int, pos int, parent int, dist double, q array<long>"


def valid(embeddings: DataFrame, relabel: int = 7) -> DataFrame:
    """vec_id, label (shifted where vec_id is divisible by `relabel`), q (quantised), norm and a row key."""
    bad = "x IS NULL OR isnan(x) OR x = double('inf') OR x = double('-inf') OR abs(floor(256 * CAST(x AS DOUBLE))) >= 2147483648"
    kept = embeddings.where(f"vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> {bad})")
    return kept.selectExpr(
        "CAST(vec_id AS BIGINT) AS vec_id",
        f"CAST(IF(vec_id % {relabel} = 0, (label + 1) % 10, label) AS INT) AS label",
        "transform(embedding, x -> CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q",
    ).selectExpr(
        "*", "sqrt(aggregate(q, 0D, (a, x) -> a + CAST(x AS DOUBLE) * x)) AS norm", "monotonically_increasing_id() AS _row"
    )


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _tree(block: pd.DataFrame) -> pd.DataFrame:
    """Minimum spanning tree of a block's anchors (Prim), rooted at the medoid; rows in breadth-first order."""
    q = _matrix(block["q"], max((len(v) for v in block["q"]), default=0)).astype(np.float64)
    n = len(q)
    gaps = np.sqrt(np.maximum(((q[:, None, :] - q[None, :, :]) ** 2).sum(2), 0))
    root = int(np.argmin(gaps.sum(1)))
    parent, best, done = np.full(n, -1), gaps[root].copy(), np.zeros(n, bool)
    done[root], near = True, np.full(n, root)
    for _ in range(n - 1):
        k = int(np.argmin(np.where(done, np.inf, best)))
        done[k], parent[k] = True, near[k]
        closer = ~done & (gaps[k] < best)
        best[closer], near[closer] = gaps[k][closer], k
    order, children = [root], {}
    for k in range(n):
        if k != root:
            children.setdefault(int(parent[k]), []).append(k)
    for k in order:
        order.extend(sorted(children.get(k, [])))
    place = {k: i for i, k in enumerate(order)}
    rows = block.iloc[order].reset_index(drop=True)
    rows["pos"] = np.arange(n, dtype=np.int32)
    rows["parent"] = np.array([place[parent[k]] if parent[k] >= 0 else -1 for k in order], dtype=np.int32)
    rows["dist"] = np.array([gaps[k, parent[k]] if parent[k] >= 0 else 0.0 for k in order])
    return rows[["a_key", "anchor_id", "alabel", "block", "pos", "parent", "dist", "q"]]


def _scorer(cands: np.ndarray, anchors: np.ndarray):
    width = max(cands.shape[1], anchors.shape[1])
    c = np.pad(cands, ((0, 0), (0, width - cands.shape[1])))
    a = np.pad(anchors, ((0, 0), (0, width - anchors.shape[1])))
    big = max(int(np.abs(c).max(initial=0)), 1) * max(int(np.abs(a).max(initial=0)), 1) * max(width, 1)
    if big < 2**53:
        cf, af = c.astype(np.float64), a.astype(np.float64)
        return lambda rows, k: np.rint(cf[rows] @ af[k]).astype(np.int64)
    return lambda rows, k: c[rows] @ a[k]


def _first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Rows of the first k by score descending, then vec_id."""
    order = np.lexsort((ids[rows], -scores[rows]))
    return rows[order[:k]]


def _walk(anchors: pd.DataFrame, cands: pd.DataFrame, wanted):
    """Visit anchors in tree order with bounds; `wanted(i, lo, hi)` names candidates to score exactly, which then feed children."""
    anchors = anchors.sort_values("pos").reset_index(drop=True)
    ids = cands["vec_id"].to_numpy(np.int64)
    norms = cands["norm"].to_numpy(np.float64)
    q_c = _matrix(cands["q"], max((len(v) for v in cands["q"]), default=0))
    q_a = _matrix(anchors["q"], max((len(v) for v in anchors["q"]), default=0))
    score = _scorer(q_c, q_a)
    every = np.arange(len(ids))
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    last_child = {int(p): i for i, p in enumerate(anchors["parent"]) if p >= 0}
    for i, a in anchors.iterrows():
        p = int(a["parent"])
        if p < 0:
            exact = score(every, i).astype(np.float64)
            lo, hi = exact.copy(), exact.copy()
        else:
            plo, phi = bounds[p]
            reach = a["dist"] * norms
            slack = 1e-9 * (np.abs(plo) + np.abs(phi) + reach) + 1.0
            lo, hi = plo - reach - slack, phi + reach + slack
            if last_child.get(p) == i:
                del bounds[p]
        rows = wanted(i, a, lo, hi)
        exact = score(rows, i)
        lo[rows], hi[rows] = exact, exact
        if i in last_child:
            bounds[i] = (lo, hi)
        yield i, a, rows, exact, ids


def _positives(anchors: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
    labels = cands["label"].to_numpy()
    out = []

    def wanted(i, a, lo, hi):
        mine = np.flatnonzero((labels == a["alabel"]) & (cands["vec_id"].to_numpy() != a["anchor_id"]))
        if len(mine) <= TOP:
            return mine
        floor = np.partition(lo[mine], len(mine) - TOP)[len(mine) - TOP]
        return mine[hi[mine] >= floor]

    for i, a, rows, exact, ids in _walk(anchors, cands, wanted):
        full = np.zeros(len(ids), np.int64)
        full[rows] = exact
        for r in _first(full, ids, rows, TOP):
            out.append((a["a_key"], a["anchor_id"], a["alabel"], int(ids[r]), int(full[r])))
    return pd.DataFrame(out, columns=["a_key", "anchor_id", "alabel", "positive_id", "positive_score"])


def _negatives(low: int):
    def run(anchors: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        labels = cands["label"].to_numpy()
        out = []

        def wanted(i, a, lo, hi):
            other = labels != a["alabel"]
            reach = np.zeros(len(labels), bool)
            for p in a["positives"]:
                ps = p["positive_score"]
                if ps >= 0:  # else the window is empty
                    reach |= (100 * hi >= low * ps) & (lo <= ps)
            return np.flatnonzero(other & reach)

        for i, a, rows, exact, ids in _walk(anchors, cands, wanted):
            for p in a["positives"]:
                ps = p["positive_score"]
                fits = rows[(low * ps <= 100 * exact) & (exact <= ps)]
                full = np.zeros(len(ids), np.int64)
                full[rows] = exact
                for r in _first(full, ids, fits, TOP):
                    out.append((a["a_key"], a["anchor_id"], p["positive_id"], ps, int(ids[r]), int(full[r])))
        return pd.DataFrame(out, columns=["a_key", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _blocks(rows: DataFrame, anchors: DataFrame, block: int) -> DataFrame:
    """Anchors with a dense block number; blocks follow sign bits of random projections, full patterns split by hash."""
    n = anchors.count()
    planes = max(0, int(np.ceil(np.log2(max(n, 1) / block))))
    bits = [
        f"IF(aggregate(zip_with(q, sequence(0, size(q) - 1), (x, i) -> x * (pmod(xxhash64({p}, i), 2001) - 1000)), 0D, "
        f"(s, y) -> s + y) >= 0, {1 << p}, 0)"
        for p in range(planes)
    ]
    bucketed = anchors.withColumn("bucket", F.expr(" + ".join(bits) if bits else "0"))
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("n")).selectExpr(
        "bucket", f"CAST(ceil(n / {block}) AS INT) AS parts"
    ).selectExpr("*", "coalesce(sum(parts) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first")
    # One row per bit pattern: at most `2^planes`, about the number of blocks.
    return bucketed.join(F.broadcast(sizes), "bucket").selectExpr(
        "*", "CAST(first + pmod(xxhash64(_row, 'block'), parts) AS INT) AS block"
    )


def mine(embeddings: DataFrame, every: int = 100, low: int = 80, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Hard negatives per anchor and positive; see the module docstring."""
    rows = settle(valid(embeddings))
    anchors = rows.where(f"vec_id % {every} = 0").selectExpr("_row AS a_key", "vec_id AS anchor_id", "label AS alabel", "q", "_row")
    placed = _blocks(rows, anchors, block)
    trees = settle(
        placed.select("a_key", "anchor_id", "alabel", "block", "q").groupBy("block").applyInPandas(_tree, _ANCHOR)
    )
    blocks = (trees.agg(F.max("block")).first()[0] or 0) + 1
    chunks = max(1, -(-rows.count() // chunk))
    spread = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    cands = rows.selectExpr("vec_id", "label", "q", "norm", f"CAST(pmod(xxhash64(_row, 'chunk'), {chunks}) AS INT) AS chunk")
    cands = cands.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = spread.groupBy("block", "chunk").cogroup(cands.groupBy("block", "chunk"))
    local = pairs.applyInPandas(_positives, "a_key long, anchor_id long, alabel int, positive_id long, positive_score long")
    first = "ORDER BY positive_score DESC, positive_id"
    positives = settle(local.selectExpr("*", f"row_number() OVER (PARTITION BY a_key {first}) AS _k").where(f"_k <= {TOP}"))
    listed = positives.groupBy("a_key").agg(
        F.expr("collect_list(named_struct('positive_id', positive_id, 'positive_score', positive_score))").alias("positives")
    )
    with_positives = spread.join(listed, "a_key")
    rescored = with_positives.groupBy("block", "chunk").cogroup(cands.groupBy("block", "chunk")).applyInPandas(
        _negatives(low), "a_key long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    )
    order = "ORDER BY negative_score DESC, negative_id"
    ranked = rescored.selectExpr("*", f"row_number() OVER (PARTITION BY a_key, positive_id {order}) AS rank")
    return ranked.where(f"rank <= {TOP}").selectExpr(
        "anchor_id", "positive_id", "CAST(rank AS INT) AS rank", "negative_id", "positive_score", "negative_score"
    )
