"""Document quality from a linear-chain conditional random field over lines.

Lines are the pieces of the text between `\\n` (a null or empty text is one empty line). Each line has `OWN` features,
computed JVM-side by SQL higher-order functions over `split(text, '\\n')` (length, words, shares of letters, capitals,
digits, symbols, runs of symbols, words in capitals, long words, end and start marks, links, repeated `!?`). A line's
input to the field is its own features with those of the line before and after (zero and a flag at the ends).

The field has two labels per line (0 bad, 1 good): a weight vector for label 1 (label 0 scores 0), a 2 x 2 transition
matrix and start weights. Training is by maximum likelihood with an L2 penalty. The training rows are the labelled
documents chosen by `train` (a SQL condition); their lines all take the document's label. About `SAMPLE` documents are
fitted at most: beyond it, a share chosen by a hash of doc_id (a documented bound on the fitted sample only; every
document is scored). The fitted table is dealt into a task per `PER_TASK` documents. Every step of the optimiser (Adam, `STEPS` steps) is one Spark job: partitions of the settled feature table
return the sums of loss and gradient from forward-backward, and the driver holds only the weights (`2 * FEATURES + 6`
numbers).

Scoring: forward-backward gives each line's marginal P(good); the document's score is their mean weighted by the line's
length in code points plus one, so empty texts get the marginal of their one empty line. `predicted` is 1 where
score >= 0.7. The weights reach the tasks as plain numbers. Rows are scored independently: repeated rows score alike,
ties need no rule. Extra columns are ignored; the result has doc_id, held_out, score, predicted and n_lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipesight.session import settle

SAMPLE = 5_000  # labelled documents fitted at most
PER_TASK = 1_000  # fitted documents a task of an optimiser step
STEPS = 40
RATE = 0.1
PENALTY = 1e-3  # L2 weight per training line
THRESHOLD = 0.7

# Counts of a line `l`, taken once; the features are made from them.
_COUNTS = {
    "chars": "length(l)",
    "words": "regexp_count(l, '\\\\S+')",
    "letters": "regexp_count(l, '\\\\p{L}')",
    "upper": "regexp_count(l, '\\\\p{Lu}')",
    "digits": "regexp_count(l, '\\\\p{N}')",
    "symbols": "regexp_count(l, '[^\\\\p{L}\\\\p{N}\\\\s.,;:!?()\\'\"-]')",
    "runs": "regexp_count(l, '[^\\\\p{L}\\\\p{N}\\\\s]{2,}')",
    "caps": "regexp_count(l, '\\\\b\\\\p{Lu}{2,}\\\\b')",
    "ends": "IF(l RLIKE '[.!?][\"\\')]*\\\\s*$', 1, 0)",
    "starts": "IF(l RLIKE '^\\\\s*\\\\p{Lu}', 1, 0)",
    "long": "regexp_count(l, '\\\\S{16,}')",
    "link": "IF(l RLIKE '(https?://|www\\\\.|@)', 1, 0)",
    "bangs": "regexp_count(l, '[!?]{2,}')",
}
# Own features of a line from its counts `c`, first the constant 1.
_OWN = [
    "1D",
    "ln(1 + c.chars) / 8",
    "ln(1 + c.words) / 6",
    "c.letters / greatest(c.chars, 1)",
    "c.upper / greatest(c.letters, 1)",
    "c.digits / greatest(c.chars, 1)",
    "c.symbols / greatest(c.chars, 1)",
    "c.runs / greatest(c.words, 1)",
    "c.caps / greatest(c.words, 1)",
    "CAST(c.ends AS DOUBLE)",
    "CAST(c.starts AS DOUBLE)",
    "c.chars / greatest(c.words, 1) / 10",
    "c.long / greatest(c.words, 1)",
    "CAST(c.link AS DOUBLE)",
    "c.bangs / greatest(c.words, 1)",
    "IF(c.chars = 0, 1D, 0D)",
]
OWN = len(_OWN)
FEATURES = OWN + 2 * (OWN - 1) + 2


def line_features(text: str = "text") -> str:
    """SQL: per line, an array of the own features; a null text is one empty line."""
    counts = ", ".join(f"'{name}', {sql}" for name, sql in _COUNTS.items())
    lines = f"transform(split(coalesce({text}, ''), '\\n'), l -> named_struct({counts}))"
    return f"transform({lines}, c -> array({', '.join(f'CAST({f} AS DOUBLE)' for f in _OWN)}))"


def _inputs(own: np.ndarray) -> np.ndarray:
    """Own features of each line with those of its neighbours and two end flags."""
    n = len(own)
    rest = own[:, 1:]
    before, after = np.zeros_like(rest), np.zeros_like(rest)
    before[1:], after[:-1] = rest[:-1], rest[1:]
    flags = np.zeros((n, 2))
    flags[0, 0], flags[-1, 1] = 1.0, 1.0
    return np.hstack([own, before, after, flags])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _unpack(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return theta[:FEATURES], theta[FEATURES : FEATURES + 4].reshape(2, 2), theta[FEATURES + 4 :]


def chain(x: np.ndarray, theta: np.ndarray, label: int | None = None):
    """Marginals P(good) per line; with a label also loss (minus log-likelihood) and gradient of that labelling."""
    w, trans, start = _unpack(theta)
    n = len(x)
    em = np.zeros((n, 2))
    em[:, 1] = x @ w
    alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
    alpha[0] = start + em[0]
    for t in range(1, n):
        alpha[t] = _lse(alpha[t - 1][:, None] + trans, 0) + em[t]
    for t in range(n - 2, -1, -1):
        beta[t] = _lse(trans + (em[t + 1] + beta[t + 1])[None, :], 1)
    log_z = _lse(alpha[-1], 0)
    marg = np.exp(alpha + beta - log_z)
    if label is None:
        return marg[:, 1]
    gold = em[:, label].sum() + start[label] + (n - 1) * trans[label, label]
    loss = log_z - gold
    g_w = x.T @ (marg[:, 1] - (label == 1))
    g_t = np.zeros((2, 2))
    if n > 1:
        pair = alpha[:-1, :, None] + trans[None] + (em[1:] + beta[1:])[:, None, :] - log_z
        g_t = np.exp(pair).sum(0)
        g_t[label, label] -= n - 1
    g_s = marg[0].copy()
    g_s[label] -= 1
    return loss, np.concatenate([g_w, g_t.ravel(), g_s])


def _train_table(docs: DataFrame, labels: DataFrame, train: str, sample: int) -> DataFrame:
    labelled = docs.selectExpr("doc_id", "text").where(train).join(
        labels.selectExpr("doc_id", "CAST(quality AS INT) AS label").where("label IN (0, 1)"), "doc_id"
    )
    n = labelled.count()
    if n > sample:
        labelled = labelled.where(f"pmod(xxhash64(doc_id, 'fit'), 1000000) < {int(1e6 * sample / n)}")
    parts = max(1, -(-min(n, sample) // PER_TASK))
    return settle(labelled.selectExpr("label", f"{line_features()} AS own").repartition(parts))


def fit(docs: DataFrame, labels: DataFrame, train: str, sample: int = SAMPLE, steps: int = STEPS) -> np.ndarray:
    """Weights of the field, fitted on the labelled rows where `train` holds."""
    table = _train_table(docs, labels, train, sample)
    size = FEATURES + 6
    theta = np.zeros(size)
    first, second = np.zeros(size), np.zeros(size)
    lines = table.selectExpr("sum(size(own))").first()[0] or 0
    if not lines:
        return theta
    schema = "loss double, " + ", ".join(f"g{i} double" for i in range(size))
    for step in range(1, steps + 1):
        weights = theta.copy()

        def sums(batches: Iterator[pd.DataFrame], weights=weights) -> Iterator[pd.DataFrame]:
            loss, grad = 0.0, np.zeros(size)
            for batch in batches:
                for label, own in zip(batch["label"], batch["own"]):
                    l, g = chain(_inputs(np.array([np.asarray(v, float) for v in own])), weights, int(label))
                    loss, grad = loss + l, grad + g
            yield pd.DataFrame([[loss, *grad]], columns=["loss", *[f"g{i}" for i in range(size)]])

        total = table.mapInPandas(sums, schema).agg(*[F.sum(c).alias(c) for c in ["loss", *[f"g{i}" for i in range(size)]]]).first()
        grad = np.array([total[f"g{i}"] or 0.0 for i in range(size)]) / lines + PENALTY * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta


def score(docs: DataFrame, theta: np.ndarray, held_out: str, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and n_lines of every row."""
    weights = [float(v) for v in theta]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.array(weights)
        for batch in batches:
            scores, counts = [], []
            for own in batch["own"]:
                rows = np.array([np.asarray(v, float) for v in own])
                marg = chain(_inputs(rows), t)
                size = np.expm1(rows[:, 1] * 8) + 1  # length + 1, back from ln(1 + length) / 8
                scores.append(float(np.clip((marg * size).sum() / size.sum(), 0.0, 1.0)))
                counts.append(len(rows))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores, "n_lines": counts})

    feats = docs.selectExpr("doc_id", f"coalesce({held_out}, false) AS held_out", f"{line_features()} AS own")
    doc_type = dict(docs.dtypes)["doc_id"]
    out = feats.mapInPandas(run, f"doc_id {doc_type}, held_out boolean, score double, n_lines long")
    return out.selectExpr("doc_id", "held_out", "score", f"CAST(score >= {threshold} AS INT) AS predicted", "n_lines")


def folded(docs: DataFrame, labels: DataFrame, divisor: int = 4, remainder: int = 2) -> DataFrame:
    """Fit on rows whose crc32(doc_id as text) mod `divisor` is not `remainder`; score all rows."""
    held = f"pmod(crc32(CAST(doc_id AS STRING)), {divisor}) = {remainder}"
    theta = fit(docs, labels, f"NOT coalesce({held}, false)")
    return score(docs, theta, held)
