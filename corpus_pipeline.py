"""A corpus from language id to the final mix, in five stages.

Every stage is a function of (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again before the next.
All but the last return the columns of `documents`, whatever they are.

1. language: documents without a letter, and those whose language the codewords leave ambiguous, go.
2. lines: repeated chunks of lines go, but for the first; documents of which nothing but white space is left by that go.
3. near duplicates: of documents linked by five-word shingles at 0.8 or more, the one with the smallest doc_id stays.
4. benchmarks: spans of test items are cut out; documents that are mostly such spans go.
5. mix: words by source weight; what the mix takes, with the number of words taken of each document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from swipesight.llm import decontaminate, jaccard_join, language, line_dedup, mixing
from swipesight.session import bound_batches, checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the documents that have a language. Clean documents of any language stay."""
    bound_batches(spark)
    model = language.train(docs.select("text", "lang"))
    return language.identify(docs, model).where("lang_pred <> 'und' AND NOT ambiguous").select(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.remove_repeated(docs)
    kept = left.where("n_removed = 0 OR length(trim(regexp_replace(text, '\\\\s+', ' '))) > 0")
    chars = "IF(n_removed > 0, CAST(length(text) AS BIGINT), n_chars) AS n_chars"
    return kept.selectExpr(*(chars if c == "n_chars" else f"`{c}`" for c in docs.columns))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return jaccard_join.keep_one(docs, n=5, percent=80)


def remove_benchmark_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes at least a word of, with size, source_size, target and taken."""
    bound_batches(spark)
    return mixing.mix(docs, "array(source)").where("taken > 0").select(*docs.columns, "size", "source_size", "target", "taken")


STAGES = [
    ("language id", identify_language),
    ("line dedup", remove_repeated_lines),
    ("n-gram jaccard join", keep_one_of_near_duplicates),
    ("benchmark decontamination", remove_benchmark_spans),
    ("mixing", mix_sources),
]

# The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
