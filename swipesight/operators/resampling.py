"""Oversampling of the rare class between near neighbours, and cleaning by neighbours.

Input and output rows are (transaction_id, label, features) after preparation. Neighbours are exact.
Space is cut at medians into leaves; a query is compared with points of its own leaf first, and then only
with leaves whose box of points comes nearer than what it has. Leaves are cut into blocks of bounded size
and the queries sent to a block into slices, so no task grows with the data. Queries go in rounds of about as many
probes as there are points, and finished shuffles are removed after each, so the disk holds one round whatever the probes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipesight.operators.models import ID
from swipesight.session import release, settle

BLOCK_ROWS = 4096
MAX_LEAVES = 4096
SLICE_BLOCKS = 4  # queries of a slice, in blocks
SAMPLE = 32_768
BATCH = 512
PAIRS = 200_000
ROUND_PROBES = 500_000  # probes of a round at least
NEIGHBOURS, CLEANING_NEIGHBOURS = 5, 3
PARTIAL = "qid string, pid string, distance double"


def _stack(xs: pd.Series) -> np.ndarray:
    return np.stack(xs.to_numpy()).astype(float)


def _compare(k: int):
    """Nearest k points of one block (of equal ones the smaller pid) for each query of one slice, itself and points beyond its limit left out."""

    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"qid": [], "pid": [], "distance": []}).astype({"qid": str, "pid": str})
        if queries.empty or points.empty:
            return none
        points = points.sort_values("pid", kind="stable")
        p, ids, out = _stack(points["point"]), points["pid"].to_numpy(), []
        codes = pd.factorize(np.concatenate([ids, queries["qid"].to_numpy()]))[0]
        own, of_query, take = codes[:len(p)], codes[len(p):], min(k, len(p))
        long_p = (p * p).sum(axis=1)
        right = np.vstack([-2 * p.T, long_p, np.ones(len(p))])
        for start in range(0, len(queries), BATCH):
            part = queries.iloc[start:start + BATCH]
            q, names, limit = _stack(part["x"]), part["qid"].to_numpy(), part["limit"].to_numpy()
            long_q = (q * q).sum(axis=1)
            far = np.column_stack([q, np.ones(len(q)), long_q]) @ right  # squares, good to about 1e-13 of the lengths
            rest = 1e-9 * (1 + long_q + long_p.max())
            bound = limit * limit * (1 + 1e-6)
            same = of_query[start:start + BATCH, None] == own[None, :]
            if np.isinf(limit).any():
                far[same] = np.inf
                bound = np.minimum(np.partition(far, take - 1, axis=1)[:, take - 1] * (1 + 1e-6), bound)
            rows, columns = np.nonzero((far <= (bound + rest)[:, None]) & ~same)
            exact = np.concatenate([np.zeros(0)] + [
                np.sqrt(((q[rows[i:i + PAIRS]] - p[columns[i:i + PAIRS]]) ** 2).sum(axis=1)) for i in range(0, len(rows), PAIRS)
            ])
            order = np.lexsort((columns, exact, rows))  # points stand by pid
            rows, columns, exact = rows[order], columns[order], exact[order]
            at = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, columns, exact = rows[at < k], columns[at < k], exact[at < k]
            out.append(pd.DataFrame({"qid": names[rows], "pid": ids[columns], "distance": exact}))
        return pd.concat(out) if out else none

    return run


class _Tree:
    """Cuts of the space at medians of a sample; boxes of the leaves are those of all points."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.cut, self.below, self.above, self.leaf = [], [], [], [], []
        self.leaves = 0
        self._grow(sample, leaves)

    def _grow(self, rows: np.ndarray, leaves: int) -> int:
        node = len(self.dim)
        for values, start in ((self.dim, 0), (self.cut, 0.0), (self.below, -1), (self.above, -1), (self.leaf, -1)):
            values.append(start)
        spread = rows.var(axis=0) if len(rows) > 1 else np.zeros(1)
        dim = int(spread.argmax())
        if leaves < 2 or len(rows) < 2 or not rows[:, dim].max() > rows[:, dim].min():  # a variance may be off by rounding
            self.leaf[node] = self.leaves
            self.leaves += 1
            return node
        cut = float(np.median(rows[:, dim]))
        left = rows[:, dim] < cut
        if not left.any():  # more than half are the smallest value
            cut = float(rows[rows[:, dim] > cut, dim].min())
            left = rows[:, dim] < cut
        self.dim[node], self.cut[node] = dim, cut
        low = max(1, min(leaves - 1, round(leaves * left.mean())))
        self.below[node] = self._grow(rows[left], low)
        self.above[node] = self._grow(rows[~left], leaves - low)
        return node

    def of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        out, waiting = np.zeros(len(x), dtype=int), [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                left = x[rows, self.dim[node]] < self.cut[node]
                waiting += [(self.below[node], rows[left]), (self.above[node], rows[~left])]
        return out

    def bound(self, low: np.ndarray, high: np.ndarray) -> None:
        """Boxes of all nodes from those of the leaves (an empty leaf's is inf to -inf)."""
        self.low, self.high = np.zeros((len(self.dim), low.shape[1])), np.zeros((len(self.dim), low.shape[1]))
        for node in range(len(self.dim) - 1, -1, -1):  # children come after their node
            if self.leaf[node] >= 0:
                self.low[node], self.high[node] = low[self.leaf[node]], high[self.leaf[node]]
            else:
                a, b = self.below[node], self.above[node]
                self.low[node] = np.minimum(self.low[a], self.low[b])
                self.high[node] = np.maximum(self.high[a], self.high[b])

    def within(self, x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose box comes as near to the row as its limit."""
        found, waiting, most = [(np.zeros(0, int), np.zeros(0, int))], [(0, np.arange(len(x)))], (limit * (1 + 1e-6) + 1e-6) ** 2
        while waiting:
            node, rows = waiting.pop()
            away = np.maximum(np.maximum(self.low[node] - x[rows], x[rows] - self.high[node]), 0)
            rows = rows[((away * away).sum(axis=1) <= most[rows]) & (self.low[node, 0] <= self.high[node, 0])]
            if self.leaf[node] >= 0:
                found.append((rows, np.full(len(rows), self.leaf[node])))
            elif len(rows):
                waiting += [(self.below[node], rows), (self.above[node], rows)]
        return np.concatenate([r for r, _ in found]), np.concatenate([n for _, n in found])


def _boxes(points: DataFrame, tree: _Tree) -> DataFrame:
    """(leaf, n, low, high) of partial groups: one row for each task and leaf."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            if batch.empty:
                continue
            x = _stack(batch["x"])
            for leaf, rows in pd.DataFrame({"leaf": tree.of(x)}).groupby("leaf").indices.items():
                n, low, high = held.get(leaf, (0, np.inf, -np.inf))
                held[leaf] = (n + len(rows), np.minimum(low, x[rows].min(axis=0)), np.maximum(high, x[rows].max(axis=0)))
        yield pd.DataFrame(
            [(leaf, n, low.tolist(), high.tolist()) for leaf, (n, low, high) in held.items()], columns=["leaf", "n", "low", "high"]
        )

    return points.select("x").mapInPandas(run, "leaf int, n long, low array<double>, high array<double>")


def _whole_box(parts: pd.DataFrame) -> pd.DataFrame:
    low, high = _stack(parts["low"]).min(axis=0), _stack(parts["high"]).max(axis=0)
    return pd.DataFrame([(parts["leaf"].iloc[0], parts["n"].sum(), low, high)], columns=["leaf", "n", "low", "high"])


def nearest(
    queries: DataFrame, points: DataFrame, k: int, block_rows: int = BLOCK_ROWS, leaves: int | None = None
) -> DataFrame:
    """Exact k nearest points of each query, itself left out: (qid, pid, distance, rank).

    `queries`: (qid, x), `points`: (pid, x), x an array of doubles.
    """
    total = points.count()
    if leaves is None:
        leaves = max(1, min(MAX_LEAVES, total // block_rows))
    # The sample only says where to cut, so its size is bounded; every point is in a leaf and in its box.
    share = f"pmod(xxhash64(pid), 1000000) < {min(1_000_000, -(-1_000_000 * SAMPLE // max(total, 1)))}"
    sample = points.where(share).select("x").limit(2 * SAMPLE).toArrow().column("x").to_pandas()
    tree = _Tree(_stack(sample) if len(sample) else np.zeros((1, 1)), leaves)
    schema = "leaf int, n long, low array<double>, high array<double>"
    boxes = _boxes(points, tree).groupBy("leaf").applyInPandas(_whole_box, schema).collect()  # one row for each leaf
    width = len(boxes[0]["low"]) if boxes else 1
    low, high = np.full((tree.leaves, width), np.inf), np.full((tree.leaves, width), -np.inf)
    chunks = np.ones(tree.leaves, dtype=int)
    for row in boxes:
        low[row["leaf"]], high[row["leaf"]] = row["low"], row["high"]
        chunks[row["leaf"]] = -(-row["n"] // block_rows)
    tree.bound(low, high)
    first_block = np.concatenate([[0], np.cumsum(chunks)])

    @F.pandas_udf("int")
    def block_of(xs: pd.Series, hashes: pd.Series) -> pd.Series:
        leaf = tree.of(_stack(xs))
        return pd.Series((first_block[leaf] + hashes.to_numpy() % chunks[leaf]).astype("int32"))

    blocks = points.select("pid", "x", block_of("x", F.xxhash64("pid")).alias("block"))
    spark = points.sparkSession

    def compare(probes: DataFrame, counts: dict[int, int]) -> DataFrame:
        slices = F.broadcast(spark.createDataFrame(  # one row for each block
            [(block, -(-n // (SLICE_BLOCKS * block_rows))) for block, n in counts.items()], "block int, slices int"))
        left = probes.join(slices, "block").selectExpr(
            "qid", "x", "limit", "block", "CAST(pmod(xxhash64(qid), slices) AS INT) AS slice")
        right = blocks.join(slices, "block").selectExpr(
            "pid", "x AS point", "block", "explode(sequence(0, slices - 1)) AS slice")
        keys = ["block", "slice"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compare(k), PARTIAL)

    def counted(probes: DataFrame) -> dict[int, int]:
        return {r["block"]: r["n"] for r in probes.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}

    home = queries.select("qid", "x", block_of("x", F.xxhash64("qid")).alias("block"))
    first = settle(compare(home.withColumn("limit", F.lit(float("inf"))), counted(home)))
    release(spark)
    bound = first.groupBy("qid").agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_far"))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def reachable(xs: pd.Series, limit: pd.Series, own: pd.Series) -> pd.Series:
        rows, leaf = tree.within(_stack(xs), limit.to_numpy())
        rows, leaf = np.repeat(rows, chunks[leaf]), np.repeat(leaf, chunks[leaf])
        order = np.lexsort((leaf, rows))
        rows, leaf = rows[order], leaf[order]
        start = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(leaf, prepend=-1) != 0))
        run = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
        block = first_block[leaf] + run
        other = block != own.to_numpy()[rows]
        rows, block = rows[other], block[other]
        return pd.Series(np.split(block.astype("int32"), np.searchsorted(rows, np.arange(1, len(xs)))))

    limited = settle(home.join(bound, "qid", "left").selectExpr(
        "qid", "x", "block AS home", f"CASE WHEN _n >= {k} THEN _far ELSE CAST('Infinity' AS DOUBLE) END AS limit",
    ))
    release(spark)
    probes = limited.select("qid", "x", "limit", F.explode(reachable("x", "limit", "home")).alias("block"))
    counts = counted(probes.select("block"))
    rounds = max(1, -(-sum(counts.values()) // max(total, ROUND_PROBES)))
    near = None
    for at in range(rounds):
        turn = f"pmod(xxhash64(qid, {rounds}), {rounds}) = {at}"  # each query is in one round, so a round is final
        sent = limited.where(turn).select("qid", "x", "limit", F.explode(reachable("x", "limit", "home")).alias("block"))
        found = first.where(turn).unionByName(compare(sent, {block: -(-n // rounds) for block, n in counts.items()}))
        done = settle(found.selectExpr(
            "*", "row_number() OVER (PARTITION BY qid ORDER BY distance, pid) AS rank"
        ).where(f"rank <= {k}"))
        near = done if near is None else near.unionByName(done)
        del sent, found, done
        release(spark)
    return near


def _arrays(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(ID).cast("string").alias("pid"), "label", vector_to_array("features").alias("x"))


def _classes(rows: DataFrame) -> tuple[int, int, int]:
    """(rare label, its rows, rows of the other class)."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rare = min(counts, key=lambda label: (counts[label], label))
    return rare, counts[rare], sum(n for label, n in counts.items() if label != rare)


def _between(base: DataFrame, points: DataFrame, k: int, label: int, seed: int) -> DataFrame:
    """New points on the way from each base row to one of its k neighbours, `copies` of each."""
    near = nearest(base.select(F.col("pid").alias("qid"), "x"), points.select("pid", "x"), k)
    lists = near.groupBy("qid").agg(F.count(F.lit(1)).alias("_k"))
    picked = base.join(lists, base.pid == lists.qid).selectExpr(
        "pid", "x", "_k", "explode(sequence(1, copies)) AS copy",
    ).selectExpr(
        "pid", "x", "copy", f"pmod(xxhash64(pid, copy, {seed}), _k) + 1 AS rank",
        f"pmod(xxhash64(pid, copy, {seed + 1}), 1000000) / 1e6D AS gap",
    )
    ends = near.selectExpr("qid", "rank", "pid AS end").join(
        points.selectExpr("pid AS end", "x AS y"), "end"
    ).select("qid", "rank", "y")
    joined = picked.join(ends, (picked.pid == ends.qid) & (picked["rank"] == ends["rank"]))
    made = settle(joined.selectExpr(
        f"concat('new-', pid, '-', copy) AS {ID}", f"{label} AS label",
        "zip_with(x, y, (a, b) -> a + gap * (b - a)) AS x",
    ).select(ID, "label", array_to_vector("x").alias("features")))
    del near, lists, picked, ends, joined
    release(made.sparkSession)
    return made


def _share_out(expression: str, seed: int) -> str:
    """A whole number whose expected value is the expression."""
    return f"CAST(floor({expression} + pmod(xxhash64(pid, {seed + 2}), 1000000) / 1e6D) AS INT)"


def smote(rows: DataFrame, k: int = NEIGHBOURS, seed: int = 42) -> DataFrame:
    """Rare rows plus points between them and their rare neighbours, up to about the other class."""
    rare, few, many = _classes(rows)
    if few <= 1 or few >= many:
        return rows.select(ID, "label", "features")
    points = _arrays(rows.where(F.col("label") == rare))
    base = points.withColumn("copies", F.expr(_share_out(f"{(many - few) / few!r}D", seed))).where("copies > 0")
    return rows.select(ID, "label", "features").unionByName(_between(base, points, k, rare, seed))


def adasyn(rows: DataFrame, k: int = NEIGHBOURS, seed: int = 42) -> DataFrame:
    """Like `smote`, with more points where more of the neighbours are of the other class."""
    rare, few, many = _classes(rows)
    if few <= 1 or few >= many:
        return rows.select(ID, "label", "features")
    everything = _arrays(rows)
    points = everything.where(F.col("label") == rare)
    near = nearest(points.select(F.col("pid").alias("qid"), "x"), everything.select("pid", "x"), k)
    other = near.join(everything.select("pid", "label"), "pid").groupBy("qid").agg(
        F.expr(f"avg(CAST(label <> {rare} AS INT))").alias("hard")
    ).persist()
    total = other.agg(F.sum("hard")).first()[0] or 0.0
    if not total:
        return rows.select(ID, "label", "features")
    base = points.join(other, points.pid == other.qid).drop("qid").withColumn(
        "copies", F.expr(_share_out(f"hard * {(many - few) / total!r}D", seed))
    ).where("copies > 0")
    return rows.select(ID, "label", "features").unionByName(_between(base, points, k, rare, seed))


def edited_neighbours(rows: DataFrame, k: int = CLEANING_NEIGHBOURS) -> DataFrame:
    """Rows whose k nearest neighbours all carry their own label."""
    points = _arrays(rows)
    near = nearest(points.select(F.col("pid").alias("qid"), "x"), points.select("pid", "x"), k)
    own = points.selectExpr("pid AS qid", "label AS own")
    against = near.join(points.select("pid", "label"), "pid").join(own, "qid").where("label <> own")
    return rows.join(against.select(F.col("qid").alias(ID)).distinct(), ID, "left_anti")


def smoteenn(rows: DataFrame, seed: int = 42) -> DataFrame:
    """`smote`, then only rows at one with their neighbours."""
    return edited_neighbours(smote(rows, seed=seed))
