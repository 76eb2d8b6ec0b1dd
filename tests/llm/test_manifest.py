"""Merkle manifest against a plain version, with nulls, repeats, one row, empty tables and clashing names."""

import brute
import pytest

from swipesight.llm import manifest, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def result(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append((r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified))
    return {k: sorted(v) for k, v in got.items()}


def expected(rows, arity=16):
    return {k: sorted(v) for k, v in brute.manifest(rows, arity).items()}


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_given_documents(spark, arity):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = result(manifest.manifest(docs, arity=arity))
    assert got == expected(rows, arity)
    assert any(not v[5] for vs in got.values() for v in vs)


def test_nulls_repeats_and_clashing_names(spark):
    rows = [
        (1, "a", "en", 3, "ABC"), (1, "a", "en", 3, "ABC"), (None, "a", None, None, None), (5, None, "de", 2, "Xy"),
        (7, None, None, 0, ""), (2, "b", "fr", 4, "zzzz"), (3, "a", "en", 1, "Q"), (None, None, None, None, "N"),
    ] + [(100 + i, "a", "en", 2, f"T{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS idx", "'x' AS hash", "2 AS _grp", "3 AS count")
    got = result(manifest.manifest(docs, arity=3))
    assert got == expected(rows, 3)
    assert len(got[1]) == 2


def test_one_row_and_empty(spark):
    one = spark.createDataFrame([(9, "s", "en", 1, "A")], SCHEMA)
    (row,) = manifest.manifest(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == brute.sha("")
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_columns(spark):
    df = queries.op13_merkle_manifest(spark, SMALL)
    assert df.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert df.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
