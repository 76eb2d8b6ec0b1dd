"""The registered queries of this package: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from swipesight.llm import (
    decontaminate, hard_negatives, quality_crf, jaccard_join, katz, language, line_dedup, manifest, merkle, mixing, oracle, site_tree, surrogates, url_filter,
)

# The rules that the url query is asked for.
RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.folded(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "array(source)")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The labelled outcome of a page is that of the document with its number.
    labels = _table(spark, sf_dir, "labels").selectExpr("doc_id AS page_id", "CAST(toxic = 1 OR quality = 0 AS INT) AS bad")
    return url_filter.judge(_table(spark, sf_dir, "pages"), labels, RULES)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents"), language.held_out(10, 0))


def op7_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_next(_table(spark, sf_dir, "documents"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.folded(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def entries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = {name: run for name, run in globals().items() if name.startswith("op") and name[2].isdigit()}
    return numbered | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": oracle.URL_FILTER, "op5_ngram_jaccard_join": oracle.JACCARD, "op9_decontamination": oracle.DECONTAMINATION,
        "op12_hard_negatives": oracle.HARD_NEGATIVES,
    }
