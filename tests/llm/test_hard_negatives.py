"""Hard negatives against brute force, with small blocks and chunks so that trees and merges are exercised."""

import brute
import pytest

from swipesight.llm import hard_negatives, queries

MID = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("block, chunk", [(2, 37), (5, 4096)])
def test_against_brute_force(spark, block, chunk):
    e = spark.read.parquet(f"{MID}/embeddings.parquet")
    plain = brute.hard_negatives([(r.vec_id, r.label, r.embedding) for r in e.collect()])
    assert rows_of(hard_negatives.mine(e, block=block, chunk=chunk)) == plain
    assert len(plain) > 50


def test_invalid_rows_ties_repeats_and_clashing_names(spark):
    base = [
        (0, [1.0, 0.0], 1), (100, [0.5, 0.5], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.9, 0.1], 2),
        (4, [0.9, 0.1], 2), (5, [0.85, 0.0], 3), (6, [None, 0.0], 2), (8, [float("nan"), 1.0], 2), (9, None, 2),
        (10, [0.9, 0.05], None), (11, [0.95, 0.0], 4), (12, [], 3), (13, [0.2], 5), (200, [float("inf"), 1.0], 1),
        (300, [1.0, 0.0], 9), (301, [1.0, 0.0], 9), (302, [0.99, 0.0], 1), (None, [1.0, 0.0], 1),
    ]
    df = spark.createDataFrame(base, SCHEMA).selectExpr("*", "1 AS a_key", "2 AS block", "3 AS chunk", "'x' AS q")
    got = rows_of(hard_negatives.mine(df, block=2, chunk=3))
    assert got == brute.hard_negatives([(v, lab, e) for v, e, lab in base])
    assert any(r[0] == 0 for r in got)


def test_empty(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_columns(spark):
    df = queries.op12_hard_negatives(spark, "/root/testdata/sf0.001")
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
