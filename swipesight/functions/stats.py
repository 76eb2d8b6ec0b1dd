"""Test statistics over groups; only one-row results reach the small p-value helpers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipesight.functions.ranks import running_totals, value_counts


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal statistic."""
    return z.map(lambda v: None if pd.isna(v) else min(1.0, math.erfc(abs(v) / math.sqrt(2))))


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series([_student_tail(a, b) for a, b in zip(t, df)], dtype="float64")


def _student_tail(t: float, df: float) -> float | None:
    if t is None or df is None or math.isnan(t) or math.isnan(df):
        return None
    if df <= 0:
        return None
    # P(|T| > t) is the regularised incomplete beta function of df / (df + t^2) at (df / 2, 1 / 2)
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if t == 0:
        return 1.0
    if df > 1e6:
        # The normal tail with the first term in 1 / df; the next one is below 1e-12.
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        return math.erfc(abs(t) / math.sqrt(2)) + density * (abs(t) ** 3 + abs(t)) / (2 * df)
    far = t * t / (df + t * t)
    log_front = a * math.log1p(-far) + b * math.log(far) + _log_gamma_step(a) - math.lgamma(b)
    if x < (a + 1) / (a + b + 2):
        return min(1.0, math.exp(log_front) * _beta_fraction(a, b, x) / a)
    return max(0.0, 1 - math.exp(log_front) * _beta_fraction(b, a, far) / b)


def _log_gamma_step(a: float) -> float:
    """log gamma(a + 1/2) - log gamma(a), without the loss of digits of the difference for large a."""
    if a < 50:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    r = 1 / a
    return 0.5 * math.log(a) + r * (-1 / 8 + r * r * (1 / 192 + r * r * (-1 / 640 + r * r * 17 / 14336)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, from front to back with guarded quotients."""
    tiny, sum_ab = 1e-300, a + b
    c, d = 1.0, 1 / _away(1 - sum_ab * x / (a + 1), tiny)
    value = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (sum_ab + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / _away(1 + step * d, tiny)
            c = _away(1 + step / c, tiny)
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return value


def _away(value: float, tiny: float) -> float:
    return tiny if abs(value) < tiny else value


def u_distribution(n1: int, n2: int) -> list[int]:
    """Number of orderings of n1 + n2 untied values with U = 0, 1, ..., n1 * n2 (counting recursion).

    f(m, n) of u is f(m - 1, n) of u - n plus f(m, n - 1) of u: the largest value is a member or not.
    """
    table = {(0, n): [1] for n in range(n2 + 1)} | {(m, 0): [1] for m in range(n1 + 1)}
    for m in range(1, n1 + 1):
        for n in range(1, n2 + 1):
            counts = [0] * (m * n + 1)
            for u, c in enumerate(table[(m - 1, n)]):
                counts[u + n] += c
            for u, c in enumerate(table[(m, n - 1)]):
                counts[u] += c
            table[(m, n)] = counts
    return table[(n1, n2)]


def exact_p(n1: int, n2: int, u: float) -> float:
    """Two-sided exact p-value of U for untied groups: twice the smaller tail, at most 1."""
    counts = u_distribution(n1, n2)
    low = min(u, n1 * n2 - u)
    tail = sum(counts[: int(low) + 1]) / sum(counts)
    return min(1.0, 2 * tail)


def mann_whitney(df: DataFrame, value: str, member: str, exact_below: int = 0) -> DataFrame:
    """U of the members against the others, with midranks, tie correction and continuity correction.

    The p-value is the normal approximation, two-sided. With `exact_below`, groups without ties whose sizes are both at
    most that get the exact p-value of the counting recursion instead (`exact` tells which); the one result row is then
    computed, the distribution having at most `exact_below`^2 + 1 entries.
    """
    approx = _mann_whitney(df, value, member)
    if not exact_below:
        return approx.drop("ties")
    row = approx.first()
    small = row.ties == 0 and 0 < row.n1 <= exact_below and 0 < row.n2 <= exact_below
    p = exact_p(row.n1, row.n2, row.u) if small else row.p_value
    return approx.drop("ties").withColumn("p_value", F.lit(p).cast("double")).withColumn("exact", F.lit(bool(small)))


def _mann_whitney(df: DataFrame, value: str, member: str) -> DataFrame:
    counts = value_counts(
        df.where(f"{member} IS NOT NULL"), value, n1=f"CASE WHEN {member} THEN 1 ELSE 0 END"
    )
    ranked = running_totals(counts, value, ["n"])
    sums = ranked.selectExpr(
        "n", "n1", "CAST(n1 AS DOUBLE) * (n_through - n + (n + 1) / 2) AS rank_sum", "CAST(n AS DOUBLE) AS d"
    ).agg(
        F.expr("sum(n1)").alias("n1"), F.expr("sum(n) - sum(n1)").alias("n2"),
        F.expr("sum(rank_sum)").alias("r1"), F.expr("sum(d * d * d - d)").alias("ties"),
    )
    u = sums.selectExpr(
        "n1", "n2", "ties", "r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2 AS u", "CAST(n1 AS DOUBLE) * n2 / 2 AS mean",
        "sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * (n1 + n2 + 1 - "
        "coalesce(try_divide(ties, CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)), 0D))) AS sd",
    )
    scored = u.selectExpr(
        "n1", "n2", "u", "ties", "greatest(0D, try_divide(greatest(u, CAST(n1 AS DOUBLE) * n2 - u) - mean - 0.5D, sd)) AS z"
    )
    return scored.withColumn("p_value", normal_p("z"))


def welch(df: DataFrame, value: str, member: str) -> DataFrame:
    """Welch's t of members against the others, with both means and their ratio."""
    part = lambda f, test: f"{f}(CASE WHEN {test} THEN {value} END)"
    yes, no = member, f"NOT {member}"
    row = df.agg(
        F.expr(part("count", yes)).alias("n1"), F.expr(part("count", no)).alias("n2"),
        F.expr(part("avg", yes)).alias("mean1"), F.expr(part("avg", no)).alias("mean2"),
        F.expr(part("var_samp", yes)).alias("v1"), F.expr(part("var_samp", no)).alias("v2"),
    )
    error = "(try_divide(v1, n1) + try_divide(v2, n2))"
    freedom = (
        f"try_divide({error} * {error}, try_divide(power(try_divide(v1, n1), 2), n1 - 1) "
        "+ try_divide(power(try_divide(v2, n2), 2), n2 - 1))"
    )
    out = row.selectExpr(
        "n1", "n2", "mean1", "mean2", "try_divide(mean1, mean2) AS ratio",
        f"try_divide(mean1 - mean2, sqrt({error})) AS t", f"{freedom} AS freedom",
    )
    return out.withColumn("p_value", student_p("t", "freedom"))


