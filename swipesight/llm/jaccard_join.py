"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. It is cut into fragments, so every document is cut
into segments, one for each fragment.

* Candidates. Two sets of similarity t differ in at most `(1 - t) / (1 + t)` of the sum of their sizes. With more
  fragments than that number, at least one fragment holds the same segment on both sides. So documents meet under the
  hash of a whole segment, never under single frequent n-grams. Documents of similar size share one cut (classes of
  size; a document near the upper end of its class also takes the cut of the next one). A document that has too many
  empty segments for this argument also takes a second, third... order of the n-grams, until it has few enough.
  Candidates whose sketches (1024 parities of n-grams) differ in more bits than linked sets can differ in n-grams go.
* Counting. For a candidate pair the partial overlap of each fragment is counted by itself, and the partial counts are
  summed per pair. There the order is cut into so many fragments (a power of two by the larger set's size) that one
  holds about `FRAGMENT_GRAMS` n-grams, so long documents are spread over rows.
* Groups. Equal sets are one class, joined once. Under a shared segment the documents are compared with the one that
  shares most, not all with all. Groups that are then still in several components are compared across components, after
  the documents that hold too many n-grams of their own to be linked to anything there are taken out (an exact bound).

Nulls and empty texts have no n-grams and are linked with nothing. Rows that repeat a doc_id keep their own row; the
class is named by its smallest doc_id. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipesight.llm.words import blocks, longs, mix, ragged, words
from swipesight.operators.graph import components_of_pairs
from swipesight.session import release, settle

CLASS_RATIO = 1.5
FRAGMENT_GRAMS = 2048
BITMAP_BITS = 1 << 24
KEY_BITS = 1 << 28
PIECE_BITS = 1 << 26
SKETCH_BITS = 1024
BROADCAST_IDS = 1_000_000
SIGNATURE = "doc_id bigint, n_shingles bigint, set bigint, sketch array<bigint>"


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each document; a shorter text is one n-gram, an empty one has none."""
    out = []
    with np.errstate(over="ignore"):
        factors = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
        total = max(0, len(hashes) - n + 1)
        grams = np.zeros(total, dtype=np.uint64)
        for k in range(n):
            grams += hashes[k : k + total] * factors[k]
        grams = mix(grams)
        for low, high in zip(first[:-1], first[1:], strict=True):
            size = high - low
            if size >= n:
                out.append(np.unique(grams[low : high - n + 1]))
            elif size:
                short = (hashes[low:high] * factors[:size]).sum(dtype=np.uint64) + np.uint64(size)
                out.append(mix(np.array([short], dtype=np.uint64)))
            else:
                out.append(grams[:0])
    return out


class Cuts:
    """Classes of set sizes and the number of fragments of each, for a similarity in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [-(-percent // (100 - percent))]

    def differing(self, size: int, other: int) -> int:
        """N-grams in which two linked sets of these sizes can differ."""
        return (size + other) * (100 - self.percent) // (100 + self.percent)

    def classes(self, size: int) -> list[tuple[int, int, int]]:
        """(class, fragments, n-grams that can differ) under which a set of this size is filed; none if only an equal set can be linked.

        Two linked sets meet in the class of the larger one.
        """
        if size < self.bounds[0]:
            return []
        largest = size * 100 // self.percent
        while self.bounds[-1] <= largest:
            self.bounds.append(int(-(-self.bounds[-1] * CLASS_RATIO // 1)))
        own = int(np.searchsorted(self.bounds, size, side="right")) - 1
        last = int(np.searchsorted(self.bounds, largest, side="right")) - 1
        if last + 1 >= len(self.bounds):
            self.bounds.append(int(-(-self.bounds[-1] * CLASS_RATIO // 1)))
        return [(c, self._fragments(c), self.differing(size, min(largest, self.bounds[c + 1] - 1))) for c in range(own, last + 1)]

    def _fragments(self, c: int) -> int:
        most = self.differing(self.bounds[c + 1] - 1, self.bounds[c + 1] - 1)
        return most + 1 + most // 16


def segment_keys(grams: np.ndarray, cuts: Cuts) -> np.ndarray:
    """Hashes of the non-empty segments of one set, under all cuts it needs."""
    keys = []
    with np.errstate(over="ignore"):
        for c, fragments, differing in cuts.classes(len(grams)):
            spare = fragments - differing
            for order in range(64):
                values = grams if order == 0 else np.sort(mix(grams + np.uint64(order)))
                at = ((values >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
                starts = np.flatnonzero(np.diff(at, prepend=np.uint64(2**63)))
                sums = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), starts)
                where = at[starts] + np.uint64((c << 40) + (order << 56))
                keys.append(mix(sums + mix(where)))
                if fragments - len(starts) < spare:
                    break
    return np.concatenate(keys) if keys else grams[:0]


def _whole(grams: np.ndarray) -> np.uint64:
    """Hash of a set."""
    with np.errstate(over="ignore"):
        return mix(~grams).sum(dtype=np.uint64)


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the n-grams in each of `SKETCH_BITS` places. Two sketches differ in no more bits than the sets in n-grams."""
    odd = np.bincount((grams & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, set, sketch): size, hash and sketch of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in blocks(batch):
                found = words(texts)
                sets = shingle_hashes(found.hash, found.first, n)
                sketches = [sketch(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[low:high], pa.array([len(s) for s in sets], pa.int64()),
                        longs(np.array([_whole(s) for s in sets], dtype=np.uint64)),
                        ragged(np.concatenate(sketches), np.array([len(s) for s in sketches])),
                    ],
                    ["doc_id", "n_shingles", "set", "sketch"],
                )

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, SIGNATURE)


def filed(docs: DataFrame, n: int, percent: int, wanted: Broadcast | None = None) -> DataFrame:
    """(key, set) of all segments; only those with a key in the bitmap `wanted`, if given. Made anew rather than kept on disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = Cuts(percent)
        for batch in batches:
            for _, _, texts in blocks(batch):
                found = words(texts)
                sets = {int(_whole(s)): s for s in shingle_hashes(found.hash, found.first, n) if len(s)}
                keys = [segment_keys(s, cuts) for s in sets.values()]
                if not keys:
                    continue
                owner = np.repeat(np.array(list(sets), dtype=np.uint64), [len(k) for k in keys])
                key = np.concatenate(keys)
                if wanted is not None:
                    at = key & np.uint64(KEY_BITS - 1)
                    keep = (wanted.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    key, owner = key[keep], owner[keep]
                yield pa.RecordBatch.from_arrays([longs(key), longs(owner)], ["key", "set"])

    source = docs.where("doc_id IS NOT NULL").selectExpr("CAST(text AS STRING) AS text")
    return source.mapInArrow(run, "key bigint, set bigint")


def _bitmap(places: DataFrame, bits: int) -> Broadcast:
    """Bitmap of fixed size with the places `at` (from 0) of a frame set."""
    one = places.selectExpr("at + 1 AS at").selectExpr("bitmap_bucket_number(at) AS bucket", "bitmap_bit_position(at) AS position")
    parts = settle(one.repartition("bucket").groupBy("bucket").agg(F.expr("bitmap_construct_agg(position)").alias("bits")))
    flags = np.zeros(max(bits // 8, 4096), dtype=np.uint8)
    # At most `bits` / 32768 rows of 4 KB. One job for about 8 MB, not for each shuffle partition: the driver keeps something of every job.
    for row in parts.coalesce(max(1, bits // PIECE_BITS)).toLocalIterator():
        low = (row.bucket - 1) * 4096
        flags[low : low + 4096] = np.frombuffer(bytes(row.bits), dtype=np.uint8)
    return places.sparkSession.sparkContext.broadcast(flags)


def _level(size: int) -> int:
    """The order is cut into 2 to this power fragments for counting."""
    return ((size - 1) // FRAGMENT_GRAMS).bit_length()


def _level_sql(size: str) -> str:
    return f"IF({size} <= {FRAGMENT_GRAMS}, 0, length(bin(({size} - 1) DIV {FRAGMENT_GRAMS})))"


def sets_of(docs: DataFrame, ids: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc, level, fragment, grams) of the documents of `ids`, at their own level and that of the largest set linked to them.

    A bitmap of fixed size drops most other documents before their text is hashed; the joins that follow are exact.
    """
    place = f"CAST(pmod(xxhash64(doc), {BITMAP_BITS}) AS BIGINT)"
    wanted = _bitmap(ids.distinct().selectExpr(f"{place} AS at"), BITMAP_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(wanted.value, bitorder="little")
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False).astype(np.int64)
            batch = batch.filter(pa.array(bits[at] > 0))
            for low, _, texts in blocks(batch):
                found = words(texts)
                ids, levels, where, counts, values = [], [], [], [], []
                for i, grams in enumerate(shingle_hashes(found.hash, found.first, n)):
                    for level in {_level(len(grams)), _level(len(grams) * 100 // percent)} if len(grams) else ():
                        fragment = (grams >> np.uint64(64 - level)) if level else np.zeros(len(grams), np.uint64)
                        used, size = np.unique(fragment, return_counts=True)
                        ids += [batch.column("doc")[low + i].as_py()] * len(used)
                        levels += [level] * len(used)
                        where.append(used.astype(np.int64))
                        counts.append(size)
                        values.append(grams)
                if ids:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(levels, pa.int32()), pa.array(np.concatenate(where)),
                         ragged(np.concatenate(values), np.concatenate(counts))],
                        ["doc", "level", "fragment", "grams"],
                    )

    source = docs.where("doc_id IS NOT NULL").selectExpr("CAST(doc_id AS BIGINT) AS doc", "CAST(text AS STRING) AS text")
    return source.selectExpr("doc", "text", f"{place} AS at").mapInArrow(
        run, "doc bigint, level int, fragment bigint, grams array<bigint>"
    )


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, shared): overlaps counted within each fragment and summed per pair."""
    pairs = pairs.withColumn("level", F.expr(_level_sql("greatest(n_a, n_b)")))
    left = pairs.join(sets.withColumnsRenamed({"doc": "a", "grams": "grams_a"}), ["a", "level"])
    both = left.join(sets.withColumnsRenamed({"doc": "b", "grams": "grams_b"}), ["b", "level", "fragment"])
    part = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("part"))
    return part.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("shared"))


def _linked(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    ids = pairs.selectExpr("a AS doc").union(pairs.selectExpr("b AS doc"))
    return overlaps(pairs, sets_of(docs, ids, n, percent)).where(f"100 * shared >= {percent} * (n_a + n_b - shared)").select("a", "b")


def _near_size(percent: int, a: str = "n_a", b: str = "n_b") -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _alike(percent: int) -> str:
    """Whether the sketches of a and b allow a link (exact: no link is ruled out)."""
    bits = " + ".join(f"bit_count(sketch_a[{i}] ^ sketch_b[{i}])" for i in range(SKETCH_BITS // 64))
    return f"({bits}) * {100 + percent}L <= (n_a + n_b) * {100 - percent}"


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    a, b = (classes.selectExpr(f"doc AS {side}", f"sketch AS sketch_{side}") for side in "ab")
    return pairs.join(a, "a").join(b, "b").where(_alike(percent)).select("a", "b", "n_a", "n_b")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id reachable over links of `percent` or more."""
    signed = settle(signatures(docs, n))
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set").agg(
        F.min("doc_id").alias("doc"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch")
    )
    shared = settle(
        filed(docs, n, percent).groupBy("key").agg(F.min("set").alias("l"), F.max("set").alias("h")).where("l <> h").select("key")
    )
    release(docs.sparkSession)  # all segments, the largest shuffle
    # The bitmap keeps most segments that nobody shares out of the shuffle; the join is exact.
    again = filed(docs, n, percent, _bitmap(shared.selectExpr(f"pmod(key, {KEY_BITS}L) AS at"), KEY_BITS))
    met = settle(again.join(shared, "key").distinct().join(classes.drop("sketch"), "set").select("key", "doc", "n"))
    members = settle(_with_centre(met))
    release(docs.sparkSession)
    heads = members.where("doc = first").selectExpr("key", "doc AS a", "n AS n_a")
    starred = members.where("doc <> first").selectExpr("key", "doc AS b", "n AS n_b").join(heads, "key")
    near = starred.where(_near_size(percent)).select("a", "b", "n_a", "n_b").distinct()
    links = settle(_linked(docs, settle(_plausible(near, classes, percent)), n, percent))
    release(docs.sparkSession)  # the sets that the links were counted from
    labels = components_of_pairs(_nodes(links), links, "a", "b").selectExpr("a AS doc", "component AS label")

    open_groups = _open_groups(members, labels)
    release(docs.sparkSession)
    if not open_groups.isEmpty():
        more = settle(_linked(docs, settle(_across(docs, open_groups, classes, n, percent)), n, percent))
        release(docs.sparkSession)
        if not more.isEmpty():
            links = settle(links.union(more))
            labels = components_of_pairs(_nodes(links), links, "a", "b").selectExpr("a AS doc", "component AS label")

    named = classes.join(labels, "doc", "left").selectExpr("set", "coalesce(label, doc) AS component_id")
    whole = signed.select("doc_id", "n_shingles", "set").where("n_shingles > 0").join(named, "set", "left")
    empty = signed.where("n_shingles = 0").selectExpr("doc_id", "n_shingles", "doc_id AS component_id")
    return whole.selectExpr("doc_id", "n_shingles", "coalesce(component_id, doc_id) AS component_id").union(empty)


def _with_centre(members: DataFrame) -> DataFrame:
    """Adds `first`, the document that a group is compared with: the one that shares most segments with others.

    In a group of edited copies that is the least edited one, which is linked to most of the group.
    """
    weight = members.groupBy("doc").agg(F.count(F.lit(1)).alias("weight"))
    centre = members.join(weight, "doc").groupBy("key").agg(F.expr("max_by(doc, struct(weight, -doc))").alias("first"))
    return members.join(centre, "key")


def _nodes(links: DataFrame) -> DataFrame:
    return links.select("a").union(links.select("b")).distinct()


def _open_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their labels, of the groups that lie in more than one component."""
    labelled = settle(
        members.join(labels, "doc", "left").selectExpr("key", "doc", "n", "first", "coalesce(label, doc) AS label")
    )
    split = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count(F.lit(1)).alias("k"))
    # In a group of two, the pair has been compared.
    return settle(labelled.join(split.where("l < h AND k > 2").select("key"), "key"))


def _across(docs: DataFrame, groups: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs of open groups in different components that the sketches and the bound on their own n-grams leave.

    An n-gram that no other document of any open group has can't be shared, so `n - alone` bounds the overlap.
    """
    docs_in = groups.select("doc", F.expr(_level_sql("n")).alias("level")).distinct()
    sets = sets_of(docs, docs_in, n, percent).join(docs_in, ["doc", "level"], "left_semi")
    grams = sets.select("doc", F.explode("grams").alias("gram"))
    alone = (
        grams.groupBy("gram").agg(F.min("doc").alias("doc"), F.max("doc").alias("other")).where("doc = other")
        .groupBy("doc").agg(F.count(F.lit(1)).alias("alone"))
    )
    kept = settle(
        groups.where("doc <> first").join(alone, "doc", "left").join(classes.select("doc", "sketch"), "doc")
        .selectExpr("key", "doc", "n", "label", "sketch", "n - coalesce(alone, 0L) AS most").where(f"100 * most >= {percent} * n")
    )
    left = kept.selectExpr("key", "doc AS a", "n AS n_a", "label AS label_a", "most AS most_a", "sketch AS sketch_a")
    right = kept.selectExpr("key", "doc AS b", "n AS n_b", "label AS label_b", "most AS most_b", "sketch AS sketch_b")
    possible = f"{100 + percent} * least(most_a, most_b) >= {percent} * (n_a + n_b)"
    found = left.join(right, "key").where(f"a < b AND label_a <> label_b AND {_near_size(percent)} AND {possible} AND {_alike(percent)}")
    return found.select("a", "b", "n_a", "n_b").distinct()


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Documents without near duplicates: the one with the smallest doc_id of each component stays.

    Of rows that repeat a doc_id, all stay if it is their component's smallest.
    """
    found = jaccard_components(docs, n, percent)
    dropped = settle(found.where("doc_id <> component_id").select("doc_id").distinct())
    # Few enough ids (8 MB) are sent to the documents; more are joined by a shuffle.
    few = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti")
