"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

Leaves are pieces of a paragraph that end behind `.`, `!`, `?`, `|` or the line break, or after 200 code points; a paragraph is a line, a section a run
of paragraphs that ends where the paragraph's own hash says so (about one in `SECTION`), or at an empty line. So an edit
changes the leaf, its paragraph, its section and the root, and nothing else. The hash of an inner node is the hash of its
children's hashes.

Form of a fingerprint: `root/section=paragraph:leaf.length,leaf.length;paragraph:...` with sections joined by `/`, hashes in
hex and lengths (code points) in decimal. Two roots are equal if and only if the texts are (up to hash collisions).

`likeness` compares two trees from the top: equal roots give 1; the leaves of equal branches are counted whole, and
only differing branches are opened. It is the share of code points in leaves of both, of the longer text's.
`differences` names the differing branches.

Null counts as the empty text. Rows with a null doc_id have no place in the order of documents and are left out of
`with_next`'s result. Rows that repeat a doc_id are ordered by the hash of their text. Extra columns are ignored. The next
document of the last one is the first; a single document is its own next. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTION = 8
_LEAF = re.compile(r"[^.!?|\n]{0,200}[.!?|]+[ \t]*|[^.!?|\n]{1,200}")
_PARAGRAPH = re.compile(r"[^\n]*\n|[^\n]+")


def _hash(data: bytes, size: int) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def fingerprint(text: str) -> str:
    sections: list[list[str]] = [[]]
    for line in _PARAGRAPH.findall(text):
        # A line break belongs to the last leaf of its line; an empty line is a leaf.
        body, tail = (line[:-1], line[-1:]) if line.endswith("\n") else (line, "")
        leaves = _LEAF.findall(body) or [""]
        leaves[-1] += tail
        named = [f"{_hash(leaf.encode('utf-8', 'surrogatepass'), 6)}.{len(leaf)}" for leaf in leaves]
        own = _hash(",".join(named).encode(), 8)
        sections[-1].append(f"{own}:{','.join(named)}")
        if not body or int(own[:8], 16) % SECTION == 0:
            sections.append([])
    parts = []
    for paragraphs in sections:
        if paragraphs:
            parts.append(f"{_hash(''.join(p[:16] for p in paragraphs).encode(), 8)}={';'.join(paragraphs)}")
    return "/".join([_hash("".join(p[:16] for p in parts).encode(), 16), *parts])


def _sections(tree: str) -> dict[str, str]:
    return dict(part.split("=", 1) for part in tree.split("/")[1:])


def _size(leaf: str) -> int:
    return int(leaf.rsplit(".", 1)[1])


def _open(parts: list[str], mark: str, skip: Counter) -> tuple[list[str], int]:
    """Children of the parts that are not in `skip` (by name), and the code points of those that are."""
    rest, known = [], 0
    skip = Counter(skip)
    for part in parts:
        name, _, body = part.partition(mark)
        if skip[name] > 0:
            skip[name] -= 1
            known += sum(_size(leaf) for leaf in re.findall(r"[0-9a-f]+\.\d+", body))
        else:
            rest.append(body)
    return rest, known


def likeness(one: str, two: str) -> float:
    """0 to 1."""
    if one.split("/", 1)[0] == two.split("/", 1)[0]:
        return 1.0
    total = max(sum(int(n) for n in re.findall(r"\.(\d+)", tree)) for tree in (one, two))
    if not total:
        return 0.0
    a, b = one.split("/")[1:], two.split("/")[1:]
    both = Counter(p[:16] for p in a) & Counter(p[:16] for p in b)
    (a, same), (b, _) = _open(a, "=", both), _open(b, "=", both)
    a, b = [p for s in a for p in s.split(";")], [p for s in b for p in s.split(";")]
    both = Counter(p[:16] for p in a) & Counter(p[:16] for p in b)
    (a, more), (b, _) = _open(a, ":", both), _open(b, ":", both)
    same += more
    both = Counter(x for p in a for x in p.split(",")) & Counter(x for p in b for x in p.split(","))
    same += sum(_size(leaf) * n for leaf, n in both.items())
    return min(1.0, same / total)


def differences(one: str, two: str) -> list[tuple[int, int]]:
    """(first code point, length) of the leaves of `one` that `two` lacks: where an edit lies."""
    if one.split("/", 1)[0] == two.split("/", 1)[0]:
        return []
    there = Counter(re.findall(r"[0-9a-f]+\.\d+", two.partition("/")[2]))
    out, at = [], 0
    for leaf in re.findall(r"[0-9a-f]+\.\d+", one.partition("/")[2]):
        if there[leaf] > 0:
            there[leaf] -= 1
        else:
            out.append((at, _size(leaf)))
        at += _size(leaf)
    return out


def _cuts(docs: DataFrame, parts: int) -> list[int]:
    """Distinct doc_ids that divide the rows into about `parts` ranges."""
    if parts < 2:
        return []
    found = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return sorted({int(x) for x in found})


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Rows are dealt by ranges of doc_id and read in order. The first row of each range also goes, as a last row, to the range
    before it (of the first range: to the last), so each task has the next text of all its rows and texts move once.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where("doc_id IS NOT NULL").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "coalesce(CAST(text AS STRING), '') AS text")
    cuts = _cuts(rows.select("doc_id"), parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("part", pa.array([bisect_left(cuts, d) for d in batch.column("doc_id").to_pylist()], pa.int32()))

    dealt = rows.mapInArrow(deal, "doc_id bigint, text string, part int")
    # One row for each range: its first doc_id, and the least text that has it.
    heads = sorted(
        (r.part, r.doc_id, r.key)
        for r in dealt.groupBy("part").agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("key"))).alias("x")).selectExpr("part", "x.*").collect()
    )
    before = {}
    for i, (_, doc_id, key) in enumerate(heads):
        before[(doc_id, key)] = heads[i - 1][0]

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows, and the first row of each range once more for the range before."""
        for batch in batches:
            yield batch.append_column("tail", pa.array([False] * len(batch)))
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            for i, x in enumerate(zip(ids, keys, strict=True)):
                if x in before:
                    row = batch.slice(i, 1).drop_columns(["part"]).append_column("part", pa.array([before[x]], pa.int32()))
                    yield row.select(["doc_id", "text", "part", "key"]).append_column("tail", pa.array([True]))

    both = dealt.withColumn("key", F.xxhash64("text")).mapInArrow(copy, "doc_id bigint, text string, part int, key bigint, tail boolean")
    placed = both.repartition(max(parts, 1), "part").sortWithinPartitions("part", "tail", "doc_id", "key")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, doc_id, text, fingerprint)
        out: list[tuple] = []
        for batch in batches:
            columns = [batch.column(n) for n in ("part", "doc_id", "text", "tail")]
            for part, doc_id, text, tail in zip(*columns, strict=True):
                part, text, tail = part.as_py(), text.as_py(), tail.as_py()
                own = fingerprint(text)
                if held is not None and held[0] == part:
                    out.append(_compare(held, text, own))
                held = None if tail else (part, doc_id.as_py(), text, own)
            if out:
                yield _batch(out)
                out = []

    return placed.mapInArrow(
        read,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _compare(held: tuple, text: str, tree: str) -> tuple:
    _, doc_id, own, own_tree = held
    half = len(own) // 2
    edited = own[: len(own) - half] + text[:half]
    edited_tree = fingerprint(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(own), digest, own_tree, edited_tree, likeness(own_tree, edited_tree), likeness(own_tree, tree)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
