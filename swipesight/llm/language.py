"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over character n-grams (orders 1 to 3, hashed into
`BUCKETS`) tells the languages with a 1 from those with a 0: the weight of an n-gram is the log ratio of its smoothed
shares on both sides, every language counting alike. Counts come from all labelled rows, summed by Spark; they are
additive, so training needs one pass and no sample. The model has at most `BUCKETS` rows and so a fixed size.

A text gets, for each bit, the mean weight of its n-grams. Loss-weighted decoding adds up the hinge losses of the bits
against each codeword, a bit weighing as much as its classifier separates the languages in training, and takes the
codeword with the least loss. `score` is the share of the chosen codeword among `exp(-loss)`; `ambiguous` tells that
the second codeword is nearly as close.

A text that is null or has no letter is `und` with score 0. Rows without text or language are not learned from. Without
any labelled row every text is `und`. Repeated rows are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipesight.llm.words import blocks

BUCKETS = 1 << 15
MOST_LANGUAGES = 256
PIECE = 1 << 20  # code points looked up at once
UNKNOWN = "und"
AMBIGUOUS = 0.6

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """Bits of each language: all different splits up to 7 languages, else well separated random ones."""
    if languages == 1:
        return np.ones((1, 1))
    if languages <= 7:
        bits = np.array(list(product((0, 1), repeat=languages - 1)))[1:]
        return np.column_stack([np.zeros(len(bits), int), bits]).T
    rng, best, distance = np.random.default_rng(seed), None, -1
    for _ in range(20):
        code = rng.integers(0, 2, (languages, int(np.ceil(15 * np.log2(languages)))))
        code = code[:, (code.min(0) == 0) & (code.max(0) == 1)]
        apart = (code[:, None, :] != code[None, :, :]).sum(2) + np.eye(languages, dtype=int) * 10**6
        if apart.min() > distance:
            best, distance = code, apart.min()
    return best


def _grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a whole text, in pieces. White space counts as one space, case is folded."""
    folded = " " + " ".join(text.lower().split()) + " "
    points = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    for low in range(0, len(points), PIECE):
        piece = points[low : low + PIECE + 2]
        out = []
        with np.errstate(over="ignore"):
            for order in (1, 2, 3):
                many = min(PIECE, len(piece) - order + 1)
                if many <= 0:
                    continue
                value = np.full(many, order, dtype=np.uint64)
                for k in range(order):
                    value = (value + piece[k : k + many] + np.uint64(1)) * _FACTORS[k]
                    value ^= value >> np.uint64(29)
                out.append(((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64))
        yield np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # BUCKETS x bits
    trust: np.ndarray  # of each bit
    ambiguous: float

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, False
        total, count = np.zeros(self.weights.shape[1]), 0
        for grams in _grams(text):
            total += self.weights[grams].sum(0, dtype=np.float64)
            count += len(grams)
        # The evidence of a text grows with its length, but neighbouring n-grams are not independent.
        margin = total / count * min(count, 200) / 20
        loss = np.maximum(0.0, 1.0 - self.code * margin) @ self.trust
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        close = len(order) > 1 and share[order[0]] < self.ambiguous
        return self.languages[order[0]], float(share[order[0]]), bool(close)


def train(labelled: DataFrame, ambiguous: float = AMBIGUOUS) -> Model:
    """Model from all rows (text, lang). At most `MOST_LANGUAGES` languages, so that the counts have a bound."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                held = sums.setdefault(lang.as_py(), np.zeros(BUCKETS, dtype=np.int64))
                if len(sums) > MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
                for grams in _grams(text.as_py()):
                    held += np.bincount(grams, minlength=BUCKETS)
        for lang, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(held[at])], ["lang", "bucket", "n"]
            )

    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").selectExpr("CAST(text AS STRING) AS text", "CAST(lang AS STRING) AS lang")
    counts = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most MOST_LANGUAGES x BUCKETS rows
    names = table.column("lang").to_numpy(zero_copy_only=False)
    languages = sorted(set(names))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((BUCKETS, 0)), np.zeros(0), ambiguous)
    seen = np.zeros((len(languages), BUCKETS))
    seen[np.searchsorted(languages, names), table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    shares = seen / np.maximum(seen.sum(1, keepdims=True), 1)
    floor = 0.1 / BUCKETS
    code = codewords(len(languages))
    weights, trust = [], []
    for bit in code.T:
        on = shares[bit == 1].mean(0) if bit.any() else np.zeros(BUCKETS)
        off = shares[bit == 0].mean(0) if not bit.all() else np.zeros(BUCKETS)
        w = np.log((on + floor) / (off + floor)) if bit.any() and not bit.all() else np.ones(BUCKETS)
        expected = np.where(bit == 1, 1.0, -1.0) * (shares @ w)
        weights.append(w)
        trust.append(max(float(expected.min()), 1e-3))
    trust = np.array(trust) / np.sum(trust)
    # A loss of 1 in all bits is worth the same whatever the number of bits.
    return Model(languages, np.where(code == 1, 1.0, -1.0), np.array(weights, dtype=np.float32).T.copy(), trust * 8, ambiguous)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, score and ambiguous. Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in blocks(batch):
                found = [shared.value.judge(t.decode("utf-8", "replace")) for t in texts]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                     pa.array([f[2] for f in found], pa.bool_())],
                    names=[*part.schema.names, "lang_pred", "score", "ambiguous"],
                )

    return docs.mapInArrow(run, kinds)


def held_out(divisor: int, remainder: int) -> str:
    return f"crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % {divisor} = {remainder}"


def folded(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), learned from the labelled documents that are not held out."""
    flagged = docs.withColumn("held_out", F.expr(f"coalesce({held_out(3, 1)}, false)"))
    model = train(flagged.where("NOT held_out").select("text", "lang"))
    return identify(flagged.selectExpr("doc_id", "held_out", "CAST(text AS STRING) AS text"), model).drop("text")
