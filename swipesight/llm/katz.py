"""Language-model scoring: a word bigram model with Katz backoff.

Tokens are the words with A-Z lower-cased and one end per text. A model is three tables, stored in the shared folder:

* unigrams: training count of every word. The lowest level is `p1(w) = (c + 0.1) / (N + 0.1 (V + 1))`, one further class
  standing for all words never seen.
* frequent words: those that make up more than `frequent` of the training tokens, at most `1 / frequent` whatever the corpus,
  so they are numbered and broadcast. Every other word, rare or never seen, goes by its hash; bigrams tell all words apart.
* bigrams: for each history its mass, the p1 of its followers and the number of followers by count.

With `share` above 0, words not above that share of the training tokens have one class in bigrams, told apart inside it by p1.

A bigram seen c times has `d(c) c / (c(h) + 1)`, with Good-Turing discounts d for c up to 5 from the counts of counts of the
whole corpus (1 where these are not regular). One count is set aside in each history, so histories with frequent followers only leave mass too. What is left
goes to the unseen followers by p1, the backoff weight being exactly `(1 - mass seen) / (1 - p1 of the seen)`, so that
probabilities add up to 1. (A history that every class follows has no one to give it to and falls short by that count.)

Bigrams are shuffled once, in `PARTS` parts by key hash so that only a part lies on disk at a time, as one row for each document
and distinct bigram. Those of two frequent words are dealt by both,
the others by their rare word (the follower, if both are rare): a key has at most a row a document, or as many as a rare word has
occurrences. All bigrams into a rare word lie together, so its count, and p1, is their sum there, without a join. Terms of the score are sums over such rows; discounts and backoff weights, known only
after the whole shuffle, are applied to these sums, since `log(d c) = log d + log c`.

Null counts as the empty text (one token, the end). Rows that repeat a doc_id and text are scored alike. Without training
texts all words are unknown and p1 is 1 for the one class left. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swipesight.llm.words import blocks, longs, mix, words
from swipesight.session import checkpoint_dir, release, settle

ADD = 0.1
FREQUENT = 2e-6
CUTOFF = 5  # Good-Turing discounts up to this count
PARTS = 2
END = np.uint64(0x1F)  # hash of the end token: no word has it but by chance
COMBINE = 2_000_000  # distinct words summed up in a task before they are sent on


@dataclass
class Classes:
    """Hashes (sorted) and counts of the numbered words; `n`, `v`: training tokens and distinct words.

    All other words share the class `other` if `lumped`, else they have ids below 0.
    """

    hashes: np.ndarray
    counts: np.ndarray
    n: int
    v: int
    texts: int
    lumped: bool

    @property
    def other(self) -> int:
        return len(self.hashes)

    @cached_property
    def shift(self) -> np.uint64:
        """Bits below those that tell the slots apart, about two to eight for each hash."""
        return np.uint64(62 - max(1, len(self.hashes)).bit_length())

    @cached_property
    def slots(self) -> np.ndarray:
        """The place in `hashes` at which each slot starts."""
        slots = np.arange(1 << int(np.uint64(64) - self.shift), dtype=np.uint64) << self.shift
        return np.searchsorted(self.hashes, slots)

    @cached_property
    def padded(self) -> np.ndarray:
        return np.append(self.hashes, np.uint64(2**64 - 1))

    @property
    def begin(self) -> int:
        return len(self.hashes) + 1

    def p1(self, count):
        return (count + ADD) / (self.n + ADD * (self.v + 1))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        rest = np.full(len(hashes), self.other) if self.lumped else -1 - (hashes >> np.uint64(1)).astype(np.int64)
        if not len(self.hashes):
            return rest
        # Hashes are spread evenly, so a few steps from the start of a slot lead to the place.
        at = self.slots[hashes >> self.shift]
        ahead = np.flatnonzero(self.padded[at] < hashes)
        while len(ahead):
            at[ahead] += 1
            ahead = ahead[self.padded[at[ahead]] < hashes[ahead]]
        return np.where((self.padded[at] == hashes) & (at < self.other), at, rest)

    def mass(self) -> np.ndarray:
        """p1 of each class, the common one last."""
        own = self.p1(self.counts.astype(float))
        return np.append(own, max(1.0 - own.sum(), 1e-300))

    def history(self) -> np.ndarray:
        """Training count of each class as a history: of words, of the common class, of the begin of a text."""
        return np.concatenate([self.counts, [self.n - self.counts.sum(), self.texts]])


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes with an end behind each text, and the first token of each text."""
    found = words(texts)
    ends = found.first[1:]
    return np.insert(found.hash, ends, END), found.first + np.arange(len(found.first))


def _by_bigram(doc: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray, docs: int) -> np.ndarray:
    """Order in which the same bigrams of a document lie together: by document and a hash, which one sort does."""
    bits = np.uint64(max(1, docs).bit_length())
    with np.errstate(over="ignore"):
        key = (mix(key + b.view(np.uint64)) >> bits) | (doc.astype(np.uint64) << (np.uint64(64) - bits))
    order = np.argsort(key)
    key, a_at, b_at = key[order], a[order], b[order]
    if np.any((key[1:] == key[:-1]) & ((a_at[1:] != a_at[:-1]) | (b_at[1:] != b_at[:-1]))):
        return np.lexsort((b, a, doc))  # two bigrams have one hash
    return order


def _source(docs: DataFrame, held: str) -> DataFrame:
    text = docs.selectExpr("doc_id", "coalesce(CAST(text AS STRING), '') AS text", f"coalesce({held}, false) AS held_out")
    return text.withColumn("row", F.xxhash64("doc_id", "text"))


def unigrams(training: DataFrame) -> DataFrame:
    """(word, n): training counts by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def summed():
            both = np.concatenate([held, *(w for w, _ in waiting)])
            n = np.concatenate([sizes, *(c for _, c in waiting)])
            order = np.argsort(both, kind="stable")
            both, n = both[order], n[order]
            starts = np.flatnonzero(np.diff(both, prepend=both[:1] + np.uint64(1))) if len(both) else np.zeros(0, int)
            return both[starts], np.add.reduceat(n, starts) if len(starts) else n[:0]

        for batch in batches:
            for _, _, texts in blocks(batch):
                tokens, _ = _tokens(texts)
                waiting.append(np.unique(tokens, return_counts=True))
                if sum(len(w) for w, _ in waiting) > COMBINE:
                    held, sizes = summed()
                    waiting = []
                    if len(held) > COMBINE // 2:
                        yield pa.RecordBatch.from_arrays([longs(held), pa.array(sizes)], ["word", "n"])
                        held, sizes = held[:0], sizes[:0]
        held, sizes = summed()
        yield pa.RecordBatch.from_arrays([longs(held), pa.array(sizes)], ["word", "n"])

    return training.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def classes(counts: DataFrame, texts: int, share: float, lumped: bool) -> Classes:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    table = counts.where(F.col("n") > share * total.n).toArrow()  # at most 1 / share rows
    hashes = np.ascontiguousarray(table.column("word").to_numpy()).view(np.uint64)
    order = np.argsort(hashes)
    return Classes(hashes[order], table.column("n").to_numpy()[order].astype(np.int64), total.n, total.v, texts, lumped)


def _texts_pass(source: DataFrame, model, kind: str, schema: str, part: int = 0) -> DataFrame:
    """One pass over the texts: `kind` is stats, rare or bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Classes = model.value
        mass, history = np.log10(m.mass()), np.log10(m.history() + 1.0)
        for batch in batches:
            rows = batch.column("row").to_numpy()
            out = batch.column("held_out").to_numpy(zero_copy_only=False)
            for low, high, texts in blocks(batch):
                tokens, first = _tokens(texts)
                own = m.of(tokens)
                doc = np.repeat(np.arange(high - low), np.diff(first))
                before = np.empty_like(own)
                before[1:] = own[:-1]
                before[first[:-1]] = m.begin
                known = (own >= 0) & (own != m.other)
                if kind == "stats":
                    base = np.where(known, mass[np.where(known, own, 0)], 0.0)
                    sums = [np.bincount(doc, x, high - low) for x in (base, np.where(before < 0, 0.0, history[np.maximum(before, 0)]))]
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(low, high - low) for c in (batch.column("row"), batch.column("doc_id"), batch.column("held_out"))),
                         pa.array(np.diff(first)), pa.array(np.bincount(doc, known, high - low).astype(np.int64)),
                         *(pa.array(s) for s in sums)],
                        ["row", "doc_id", "held_out", "n_tokens", "in_class", "class_score", "history_log"],
                    )
                elif kind == "rare":
                    at = np.flatnonzero(~known)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([longs(tokens[at]), pa.array(rows[low:high][doc[at]])], ["word", "row"])
                else:
                    # a: the rare word, or both numbers; b: the other word, numbers of followers shifted by `width`.
                    width = m.begin + 1
                    numbers = np.where(before < 0, before, before * width + own)
                    a, b = np.where(own < 0, own, numbers), np.where(own < 0, before, np.where(before < 0, own + width, 0))
                    key = mix(a.view(np.uint64))
                    order = np.flatnonzero(key % np.uint64(PARTS) == np.uint64(part))
                    a, b, doc = a[order], b[order], doc[order]
                    order = _by_bigram(doc, key[order], a, b, high - low)
                    a, b, doc = a[order], b[order], doc[order]
                    new = np.flatnonzero((np.diff(a, prepend=0) != 0) | (np.diff(b, prepend=0) != 0) | (np.diff(doc, prepend=-1) != 0))
                    n = np.diff(np.append(new, len(a)))
                    at = doc[new]
                    n = np.where(out[low:high][at], -n, n)  # held-out texts are counted below zero
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a[new]), pa.array(b[new]), pa.array(rows[low:high][at]), pa.array(n.astype(np.int32))], ["a", "b", "row", "n"]
                    )

    return source.mapInArrow(run, schema)


def bigram_sums(source: DataFrame, model, held: Classes, part: int) -> DataFrame:
    """Sums over the shuffle of a part of the bigrams: (kind, row, history, v0..v7).

    doc: v0 = sum n log10 c, v1..v5 = tokens whose bigram has that count. history: v0 = p1 of the followers, v1..v6 = followers with that count,
    v7 = occurrences beyond the cutoff. unseen: v0 = tokens, of one document and history.
    """
    width = held.begin + 1
    events = _texts_pass(source, model, "bigrams", "a bigint, b bigint, row bigint, n int", part).repartition("a")
    p1 = source.sparkSession.createDataFrame(
        pa.table({"w": pa.array(np.arange(held.other + 1)), "p1": pa.array(held.mass())})
    )
    key = Window.partitionBy("a", "b")  # lies in the partitions of a
    counted = events.select(
        "a", "b", "row", F.abs("n").alias("n"), F.expr("greatest(n, 0)").alias("t"), F.sum(F.expr("greatest(n, 0)")).over(key).alias("c"),
        F.min("row").over(key).alias("first"),
    )
    if not held.lumped:
        counted = counted.withColumn("of_word", F.sum(F.expr(f"IF(b < {width}, t, 0)")).over(Window.partitionBy("a")))
    counted = counted.selectExpr(
        "row", "n", "c", "row = first AND c > 0 AS is_first", f"CASE WHEN a >= 0 THEN a DIV {width} WHEN b < {width} THEN b ELSE a END AS h",
        f"CASE WHEN a >= 0 THEN a % {width} WHEN b >= {width} THEN b - {width} END AS w",
        "CAST(NULL AS DOUBLE) AS rare_p1" if held.lumped else f"(of_word + {ADD}D) / {held.n + ADD * (held.v + 1)!r}D AS rare_p1",
    ).withColumn("w", F.expr("IF(is_first OR c = 0, w, NULL)"))
    # At most 1 / frequent rows. Rare followers have no number.
    joined = counted.withColumn("rare", F.expr("w IS NULL")).join(F.broadcast(p1), "w", "left").withColumn("p1", F.expr("IF(rare, rare_p1, p1)"))
    # The rows made here are many: kinds are numbers and values plain columns, without an array for each.
    flat = joined.withColumn("kind", F.explode(F.expr("CASE WHEN c = 0 THEN array(2) WHEN is_first THEN array(0, 1) ELSE array(0) END")))
    times = "IF(kind = 0, CAST(n AS DOUBLE), 1D)"
    values = [
        "CASE kind WHEN 0 THEN n * log10(c) WHEN 1 THEN p1 ELSE CAST(n AS DOUBLE) END",
        f"CASE WHEN c = 1 THEN {times} WHEN c = 0 THEN n * log10(p1) ELSE 0D END",
        *(f"IF(c = {r}, {times}, 0D)" for r in range(2, CUTOFF + 1)),
        f"IF(kind = 1 AND c = {CUTOFF + 1}, 1D, 0D)",
        f"IF(kind = 1 AND c > {CUTOFF}, CAST(c AS DOUBLE), 0D)",
    ]
    flat = flat.selectExpr("kind", "IF(kind = 1, 0L, row) AS row", "IF(kind = 0, -1L, h) AS history", *(f"{v} AS v{i}" for i, v in enumerate(values)))
    summed = flat.groupBy("kind", "row", "history").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(8)))
    return summed.withColumn("kind", F.expr("element_at(array('doc', 'history', 'unseen'), kind + 1)"))


def discounts(counts_of_counts: list[float]) -> list[float]:
    """Good-Turing discounts of the counts 1 to k from the numbers of bigrams seen 1 to k + 1 times; 1 where not regular."""
    n = [0.0, *counts_of_counts]
    k = len(n) - 2
    out = []
    for r in range(1, k + 1):
        d = 1.0
        if n[1] > 0 and n[r] > 0:
            tail = (k + 1) * n[k + 1] / n[1]
            if tail < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
        out.append(d if 0 < d <= 1 else 1.0)
    return out


def score(docs: DataFrame, held: str = "false", share: float = 0.0, frequent: float = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); learned from rows where `held` is not true."""
    spark = docs.sparkSession
    source = _source(docs, held)
    training = source.where("NOT held_out")
    counts = settle(unigrams(training))
    own = classes(counts, training.count(), share or frequent, share > 0)
    model = spark.sparkContext.broadcast(own)
    # Written, not checkpointed: as Parquet the many zeros take no room.
    path = f"{checkpoint_dir(spark).rstrip('/')}/bigrams-{uuid.uuid4().hex}"
    for part in range(PARTS):
        bigram_sums(source, model, own, part).write.mode("append").partitionBy("kind").parquet(path)
        release(spark)  # the bigrams, the largest shuffle
    sums = spark.read.schema("row bigint, history bigint, " + ", ".join(f"v{i} double" for i in range(8)) + ", kind string").parquet(path)

    of_counts = sums.where("kind = 'history'").agg(*(F.coalesce(F.sum(f"v{r}"), F.lit(0.0)).alias(f"n{r}") for r in range(1, CUTOFF + 2))).first()
    d = discounts(list(of_counts))
    log_d = [log10(x) for x in d]
    # Occurrences of a history that its followers keep after discounting, and its exact backoff weight.
    kept = " + ".join(["v7", f"{CUTOFF + 1} * 0 * v{CUTOFF + 1}", *(f"{d[r - 1]!r}D * {r} * v{r}" for r in range(1, CUTOFF + 1))])
    times = spark.createDataFrame(pa.table({"history": pa.array(np.arange(own.begin + 1)), "times": pa.array(own.history().astype(float))}))
    alpha = f"IF(v0 IS NULL, 1D, greatest(1D - ({kept}) / (times + 1), 1e-300) / greatest(1D - v0, 1e-300)) AS alpha"
    total = [F.sum(f"v{i}").alias(f"v{i}") for i in range(8)]
    histories = sums.where("kind = 'history'").groupBy("history").agg(*total)
    weights = times.join(histories.where("history >= 0"), "history", "left").selectExpr("history", alpha, "log10(times + 1) AS times_log")
    occurrences = " + ".join(["v7", *(f"{r} * v{r}" for r in range(1, CUTOFF + 1))])
    rare_weights = histories.where("history < 0").withColumn("times", F.expr(occurrences)).selectExpr("history", alpha, "log10(times + 1) AS times_log")
    # In an unseen history the whole mass is backed off; the log of its count, taken off for all tokens, is given back.
    backed = sums.where("kind = 'unseen'").select("row", "history", "v0", "v1")
    unseen = backed.where("history >= 0").join(F.broadcast(weights), "history").unionByName(
        backed.where("history < 0").join(rare_weights, "history", "left").na.fill({"alpha": 1.0, "times_log": 0.0})
    ).groupBy("row").agg(F.expr("sum(v0 * (log10(alpha) + times_log) + v1)").alias("backed_off"))
    seen = sums.where("kind = 'doc'").groupBy("row").agg(*total).selectExpr("row", " + ".join(["v0", *(f"({log_d[r - 1]!r}D) * v{r}" for r in range(1, CUTOFF + 1))]) + " AS seen")

    floor = f"log10({own.p1(0)!r}D)"
    rare = _texts_pass(source, model, "rare", "word bigint, row bigint").join(counts, "word", "left").groupBy("row").agg(
        F.expr("count(n)").alias("known"), F.expr("count(1)").alias("rare"),
        F.expr(f"sum(coalesce(log10((n + {ADD}D) / {own.n + ADD * (own.v + 1)!r}D), {floor}))").alias("rare_score"),
        F.expr(f"sum(IF(word = {END}L, 0D, log10(coalesce(n, 0L) + 1D)))").alias("rare_history"),
    )
    stats = _texts_pass(
        source, model, "stats", f"row bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, in_class bigint, class_score double, history_log double"
    )
    # Rows that repeat a document have been summed together above.
    copies = source.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    joined = stats.join(copies, "row")
    for part in (rare, seen, unseen):
        joined = joined.join(part, "row", "left")
    # Rare words are told apart inside their class, or are histories of their own.
    rest = f"coalesce(rare_score, 0D) - ({float(np.log10(own.mass()[-1]))!r}D) * coalesce(rare, 0L)" if own.lumped else "- coalesce(rare_history, 0D)"
    return joined.selectExpr(
        "doc_id", "held_out", "n_tokens", "in_class + coalesce(known, 0L) DIV copies AS n_known", f"{own.n}L AS train_tokens",
        "class_score + coalesce(rare_score, 0D) / copies AS base_score",
        f"(coalesce(seen, 0D) + coalesce(backed_off, 0D) + ({rest})) / copies - history_log AS score",
    )
