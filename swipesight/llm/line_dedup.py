"""Line dedup with content-defined chunks of lines. Built-in Spark functions only.

A text is cut into lines, every line is hashed, and a rolling hash over the last `ROLL` line hashes places a chunk boundary
where it is 0 modulo `SPACING` and was not at the line before. A long line (`LONG_WORDS` words or more) is a chunk by itself. Boundaries so depend on nearby
lines only and move with the text: lines inserted elsewhere don't shift them, and a passage that repeats across documents is
cut alike everywhere, but for its two ends.

A chunk is looked at if it has two lines with text or is a long line. Of those that occur more than once in all texts, the
occurrence in the smallest doc_id (the first there) stays and the others are removed, after their bytes were compared: the
smallest and the largest text under a hash must be equal, else nothing under that hash is removed.

Only chunks are aggregated, with partial sums on the map side, so a chunk that is in a third of all documents costs no more
than others. Null and empty texts have no chunks and stay as they are. A document is a doc_id with its text (told by two
hashes and the length): rows that repeat both count as one document, and what they repeat among each other stays; rows
that repeat a doc_id with other texts are other documents, the smaller text identity first. Ties can't occur, positions being unique. Extra columns are kept. Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLL = 2
SPACING = 3
LONG_WORDS = 40
_BOUND = (1 << 31) - 1
# Which text a row of a doc_id holds: two hashes and the length.
_IDENTITY = "struct(xxhash64(text) AS a, hash(text) AS b, length(text) AS n)"


def _chunked(docs: DataFrame, roll: int, spacing: int, long_words: int) -> DataFrame:
    """(doc_id, text, lines, ends): `ends` are the numbers of the last lines of the chunks, counted from 1."""
    lines = docs.selectExpr("doc_id", f"{_IDENTITY} AS __ld_text", "split(text, '\\n', -1) AS lines").where("doc_id IS NOT NULL AND lines IS NOT NULL")
    # A line of n words has n - 1 gaps of white space; the count decides alike wherever the line stands.
    words = "size(split(trim(regexp_replace(x, '[\\\\x20\\\\x09-\\\\x0D]+', ' ')), ' '))"
    short = f"length(x) < {2 * long_words - 1}"
    hashed = lines.selectExpr(
        "doc_id", "__ld_text", "lines", f"transform(lines, x -> pmod(xxhash64(x), {_BOUND}L)) AS h",
        f"transform(lines, x -> CASE WHEN {short} THEN false ELSE {words} >= {long_words} END) AS long_line",
    )
    window = " + ".join(f"{pow(31, k)}L * coalesce(get(h, i - {k}), 0L)" for k in range(roll))
    marked = hashed.selectExpr("doc_id", "__ld_text", "lines", "long_line", f"transform(h, (x, i) -> ({window}) % {spacing} = 0) AS marks")
    # Of marks in a row only the first is a boundary, so that chunks between them have two lines or more.
    mark = "(get(marks, i) AND NOT coalesce(get(marks, i - 1), false))"
    edge = f"i = size(lines) - 1 OR get(long_line, i) OR get(long_line, i + 1) OR {mark}"
    return marked.selectExpr("doc_id", "__ld_text", "lines", "long_line", f"filter(sequence(0, size(lines) - 1), i -> {edge}) AS ends")


def chunks(docs: DataFrame, roll: int = ROLL, spacing: int = SPACING, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, __ld_text, begin, finish, key, chunk) of the chunks that are looked at; lines are numbered from 0.

    `__ld_text` tells rows that repeat a doc_id with other texts apart.
    """
    cut = _chunked(docs, roll, spacing, long_words)
    spans = cut.select(
        "doc_id", "__ld_text", "lines", "long_line",
        F.explode(F.expr("transform(ends, (e, k) -> struct(coalesce(get(ends, k - 1), -1) + 1 AS begin, e AS finish))")).alias("s"),
    ).selectExpr("doc_id", "__ld_text", "s.begin", "s.finish", "get(long_line, s.begin) AS is_long", "slice(lines, s.begin + 1, s.finish - s.begin + 1) AS part")
    kept = spans.where("is_long OR size(filter(part, x -> length(trim(x)) > 0)) > 1")
    return kept.selectExpr("doc_id", "__ld_text", "begin", "finish", "concat_ws('\\n', part) AS chunk").selectExpr(
        "doc_id", "__ld_text", "begin", "finish", "xxhash64(chunk, length(chunk)) AS key", "chunk"
    )


def repeated(found: DataFrame) -> DataFrame:
    """(key, kept_doc, kept_text, kept_line) of the chunks that occur more than once with the same bytes."""
    groups = found.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "__ld_text", "begin")).alias("kept"), F.min("chunk").alias("low"), F.max("chunk").alias("high")
    )
    return groups.where("n > 1 AND low = high").selectExpr("key", "kept.doc_id AS kept_doc", "kept.__ld_text AS kept_text", "kept.begin AS kept_line")


def remove_repeated(docs: DataFrame, roll: int = ROLL, spacing: int = SPACING, long_words: int = LONG_WORDS) -> DataFrame:
    """`docs` without the repeated chunks, with n_lines, n_removed (lines) and n_chunks_removed; `text` is what is left."""
    found = chunks(docs, roll, spacing, long_words)
    gone = (
        found.drop("chunk").join(repeated(found), "key").where("NOT (doc_id = kept_doc AND __ld_text = kept_text AND begin = kept_line)")
        .groupBy("doc_id", "__ld_text").agg(F.collect_set(F.struct("begin", "finish")).alias("_gone"))  # of one document
    )
    taken = set(docs.columns)

    def free(name: str) -> str:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        return name

    doc, row, spans, count, rest = free("_id"), free("_text_id"), free("_gone"), free("_lines"), free("_left")
    gone = gone.selectExpr(f"doc_id AS {doc}", f"__ld_text AS {row}", f"_gone AS {spans}")
    joined = docs.join(gone, (F.col("doc_id") == F.col(doc)) & (F.expr(_IDENTITY) == F.col(row)), "left").drop(doc, row)
    names = [f"`{c}`" for c in docs.columns if c != "text"]
    outside = f"filter(split(text, '\\n', -1), (x, i) -> NOT exists({spans}, g -> i BETWEEN g.begin AND g.finish))"
    left = joined.withColumn(count, F.expr("coalesce(size(split(text, '\\n', -1)), 0)")).withColumn(
        rest, F.expr(f"CASE WHEN {spans} IS NOT NULL THEN {outside} END")
    )
    names = [n for n in names if n.strip("`") not in ("n_lines", "n_removed", "n_chunks_removed")]
    return left.selectExpr(
        *names, f"CASE WHEN {rest} IS NULL THEN text ELSE concat_ws('\\n', {rest}) END AS text",
        f"CAST(CASE WHEN text IS NULL THEN 0 ELSE {count} END AS BIGINT) AS n_lines",
        f"CAST(CASE WHEN {rest} IS NULL THEN 0 ELSE {count} - size({rest}) END AS BIGINT) AS n_removed",
        f"CAST(coalesce(size({spans}), 0) AS BIGINT) AS n_chunks_removed",
    )
