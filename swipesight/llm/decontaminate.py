"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton holds every run of words of every item. Training tokens are streamed through it, keeping the length of the
longest run that ends at the current word. Where that length reaches the window, the words of the window are hit;
an item shorter than the window is hit where the whole item occurs.

The automaton is built from items of bounded size: the items are dealt into shards of at most `SHARD_WORDS` words (one
longer item is a shard by itself), each shard has its own automaton, and a document is streamed through all of them. So
what a task holds at once has a fixed bound, and a larger benchmark costs more passes in the same task.

Words that no item has can't be in a match. They are recognised by hash for whole batches, and only runs of known words
that are long enough are looked up by their text and streamed.

A null text has no words. Item rows that are null or without words have no window. Repeated rows are judged one by one.
Extra columns are ignored by `matches` and kept by `remove_spans`. Empty tables give empty results or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipesight.llm.words import NOT_ALNUM, Words, blocks, words

WINDOW = 10
SHARD_WORDS = 500_000


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.found: list[set[str]] = [set()]  # items in which the state's runs of `window` words occur
        self.whole: list[dict[int, set[str]]] = [{}]  # items shorter than the window that a run ends with, by length
        ends: list[tuple[str, list[int]]] = []
        for name, tokens in items:
            if tokens:
                ends.append((name, [self.ids.setdefault(t, len(self.ids)) for t in tokens]))
                self._add(ends[-1][1])
        self.shortest = min([window, *(len(t) for _, t in ends)])
        for name, tokens in ends:
            self._mark(name, tokens)
        self.hashes = np.sort(words([b" ".join(self.ids)], NOT_ALNUM).hash)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.found.append(set())
        self.whole.append({})
        return len(self.step) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """A copy of q for the runs that end after p."""
        copy = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(token) == q:
            self.step[p][token] = copy
            p = self.link[p]
        return copy

    def _add(self, tokens: list[int]) -> None:
        last = 0
        for token in tokens:
            known = self.step[last].get(token)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, token, known)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and token not in self.step[p]:
                self.step[p][token] = new
                p = self.link[p]
            if p >= 0:
                q = self.step[p][token]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
            last = new

    def _mark(self, name: str, tokens: list[int]) -> None:
        state = 0
        for i, token in enumerate(tokens):
            state = self.step[state][token]
            if i + 1 >= self.window:
                at = state
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                self.found[at].add(name)
        if len(tokens) < self.window:
            self.whole[state].setdefault(len(tokens), set()).add(name)

    def stream(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs of words (begin, end), unmerged, and the items they come from."""
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        state = length = 0
        for i, word in enumerate(tokens):
            token = self.ids.get(word)
            if token is None:
                state = length = 0
                continue
            while state and token not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.step[state].get(token, 0)
            length = length + 1 if state else 0
            at = state
            while at > 0:
                # The runs of a state end alike; those of its link are shorter ends.
                low = self.length[self.link[at]]
                most = min(length, self.length[at])
                if most >= self.window > low:
                    hits.append((i + 1 - self.window, i + 1))
                    items |= self.found[at]
                for size, names in self.whole[at].items():
                    if size <= most:
                        hits.append((i + 1 - size, i + 1))
                        items |= names
                at = self.link[at]
        return hits, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def shards(benchmark: DataFrame, shard_words: int) -> list[Broadcast]:
    """Items as words, in broadcast parts of at most `shard_words` words (or one item)."""
    spark, out, held, size = benchmark.sparkSession, [], [], 0
    rows = benchmark.selectExpr("CAST(item_id AS STRING) AS item_id", "CAST(text AS STRING) AS text")
    for row in rows.where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        found = words([row.text.encode()], NOT_ALNUM)
        tokens = [found.text(i) for i in range(len(found.hash))]
        if held and size + len(tokens) > shard_words:
            out.append(spark.sparkContext.broadcast(held))
            held, size = [], 0
        held.append((row.item_id, tokens))
        size += len(tokens)
    return [*out, spark.sparkContext.broadcast(held)] if held else out


def _runs(found: Words, automaton: Automaton) -> Iterator[tuple[int, int, int]]:
    """(document, first word, last word + 1) of the runs of known words that are long enough for a match."""
    at = np.searchsorted(automaton.hashes, found.hash)
    known = automaton.hashes[np.minimum(at, len(automaton.hashes) - 1)] == found.hash
    inside = np.zeros(len(known) + 2, dtype=np.int8)
    inside[1:-1] = known
    edges = np.flatnonzero(np.diff(inside))
    for begin, end in zip(edges[0::2], edges[1::2], strict=True):
        if end - begin < automaton.shortest:
            continue
        doc = int(np.searchsorted(found.first, begin, side="right")) - 1
        while begin < end:
            stop = min(end, found.first[doc + 1])
            if stop - begin >= automaton.shortest:
                yield doc, int(begin), int(stop)
            begin, doc = stop, doc + 1


def _matcher(parts: list[Broadcast], window: int):
    """For a block of texts: the words, and per document the merged hit spans and the item ids."""
    built: list[Automaton] = []

    def run(texts: list[bytes]) -> tuple[Words, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        found = words(texts, NOT_ALNUM)
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for part in parts:
            if len(parts) > 1 or not built:
                built[:] = [Automaton(part.value, window)]
            if len(built[0].hashes) == 0 or len(found.hash) == 0:
                continue
            for doc, begin, end in _runs(found, built[0]):
                hits, names = built[0].stream([found.text(i) for i in range(begin, end)])
                if hits:
                    base = begin - int(found.first[doc])
                    spans.setdefault(doc, []).extend((base + a, base + b) for a, b in hits)
                    items.setdefault(doc, set()).update(names)
        return found, {d: merged(s) for d, s in spans.items()}, items

    return run


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) of every document."""
    parts = shards(benchmark, shard_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _matcher(parts, window)
        for batch in batches:
            for low, high, texts in blocks(batch):
                found, spans, items = match(texts)
                names = [sorted(items.get(d, ())) for d in range(len(texts))]
                hit = [sum(b - a for a, b in spans.get(d, ())) for d in range(len(texts))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[low:high], pa.array(np.diff(found.first)), pa.array(hit, pa.int64()),
                        pa.array([len(n) for n in names], pa.int64()),
                        pa.array([hashlib.sha256(",".join(n).encode()).hexdigest() for n in names]),
                        pa.array([h > 0 for h in hit]), pa.array(names, pa.list_(pa.string())),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "CAST(text AS STRING) AS text").mapInArrow(
        run,
        f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
        "items array<string>",
    )


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_coverage: float = 0.5, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """Documents without the spans that benchmark items hit.

    A document of whose words more than `most_coverage` are hit is dropped. From others the spans are cut out, each
    replaced by nothing from the begin of its first word to the end of its last; the rest of the text stays byte for byte.
    All columns are kept; `n_chars`, if there, is set to the new length.
    """
    parts = shards(benchmark, shard_words)
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _matcher(parts, window)
        for batch in batches:
            for low, high, texts in blocks(batch):
                found, spans, _ = match(texts)
                part = batch.slice(low, high - low)
                if not spans:
                    yield part
                    continue
                texts = part.column(at).to_pylist()
                keep = np.ones(len(texts), dtype=bool)
                starts = np.cumsum([0] + [len((t or "").encode()) + 1 for t in texts])
                for doc, cut in spans.items():
                    first = found.first[doc]
                    if sum(b - a for a, b in cut) > most_coverage * (found.first[doc + 1] - first):
                        keep[doc] = False
                        continue
                    data, pieces, done = texts[doc].encode(), [], 0
                    for a, b in cut:
                        pieces.append(data[done : found.start[first + a] - starts[doc]])
                        done = found.end[first + b - 1] - starts[doc]
                    texts[doc] = (b"".join(pieces) + data[done:]).decode()
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.field(at).type)
                if chars is not None:
                    lengths = [None if t is None else len(t) for t in texts]
                    columns[chars] = pa.array(lengths).cast(part.schema.field(chars).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep))

    fields = [f if f.name != "text" else T.StructField("text", T.StringType()) for f in docs.schema.fields]
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, T.StructType(fields))
