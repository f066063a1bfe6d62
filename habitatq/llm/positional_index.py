"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed once: every segment (a run of documents of bounded bytes) stores
its terms in order, how often each occurs, and the positions of every occurrence. A
phrase is looked up in each segment by taking the postings of its rarest term there,
shifted to where the phrase would start, and intersecting them with the shifted postings
of the next rarer terms until none or all have agreed. A document never spans segments,
so no lookup needs a shuffle, and the index is written to the shared folder, from which
a lost task reads its segments again.

Phrases come from the benchmark, whose size is stated but not bounded by the corpus: they
are searched in blocks of at most ``BLOCK_WINDOWS`` distinct windows, which is what the
driver and a task hold at once. With several blocks each is one pass over the index whose
answers (the words covered and the items found, of documents that have any) are written
before the next block is taken up; covers are then joined bit by bit. Segments are numbered
when the index is built, so equal ones stay apart.

Defined cases: a null text has no words. Repeated rows, of documents or items, are
answered as they are; items sharing an id are one item, and null is an id of its own
(an empty name). An item of fewer words than a window is one window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatq.llm import words as W
from habitatq.sources.tables import stored

WINDOW = 10
#: Distinct windows searched in one pass over the index: 16 MB of term fingerprints.
BLOCK_WINDOWS = 200_000
SEGMENT_BYTES = 4 << 20
INDEX = "segment long, doc_ids array<bigint>, text_keys array<bigint>, sizes array<int>, terms binary, counts binary, positions binary"


def build(docs: DataFrame) -> DataFrame:
    """The index of whole texts, stored: one row per segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for number, b in enumerate(W.slices(batches, limit=SEGMENT_BYTES, rows=1 << 16), first):
            w = W.words_of(b.column("text"), W.ALNUM_WORD, lower=True)
            h = w.hashes()
            order = np.argsort(h, kind="stable")
            terms, counts = np.unique(h[order], return_counts=True)
            cells = [
                pa.array([number], pa.int64()),
                pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([b.column("text_key").to_pylist()], pa.list_(pa.int64())),
                pa.array([w.counts.astype(np.int32)], pa.list_(pa.int32())),
                *(pa.array([x.tobytes()], pa.binary()) for x in (terms, counts.astype(np.int32), order.astype(np.int32))),
            ]
            yield pa.record_batch(cells, names=["segment", "doc_ids", "text_keys", "sizes", "terms", "counts", "positions"])

    texts = W.id_text(docs).withColumn("text_key", F.xxhash64("text"))
    return stored(texts.mapInArrow(run, INDEX), "positions")


@dataclass
class Segment:
    """Postings of one index row; positions count through all documents of the segment."""

    ptr: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    positions: np.ndarray

    def __post_init__(self) -> None:
        n = np.int64(len(self.positions) + 1)
        self.n = n
        self.codes = np.repeat(np.arange(len(self.terms), dtype=np.int64), self.counts) * n + self.positions
        self.first = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])

    @staticmethod
    def of(row: dict) -> Segment:
        sizes = np.array(row["sizes"], np.int64)
        return Segment(
            np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(row["terms"], np.uint64),
            np.frombuffer(row["counts"], np.int32), np.frombuffer(row["positions"], np.int32),
        )

    def lookup(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows all of whose terms occur here, and the index of each of these terms."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros((0, windows.shape[1]), np.int64)
        alive, at = np.arange(len(windows)), []
        for j in range(windows.shape[1]):
            k = np.minimum(np.searchsorted(self.terms, windows[alive, j]), len(self.terms) - 1)
            ok = self.terms[k] == windows[alive, j]
            alive, at = alive[ok], [x[ok] for x in at] + [k[ok]]
        return alive, np.stack(at, axis=1) if len(alive) else np.zeros((0, windows.shape[1]), np.int64)

    def postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of each term in turn, and which term of the list each belongs to."""
        sizes = self.counts[term].astype(np.int64)
        which = np.repeat(np.arange(len(term)), sizes)
        return self.positions[self.first[term][which] + W.spans(sizes)].astype(np.int64), which

    def same_text(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ptr, a, "right") == np.searchsorted(self.ptr, b, "right")

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its first term) of every exact occurrence."""
        alive, term = self.lookup(windows)
        if not len(alive):
            return alive, alive
        order = np.argsort(self.counts[term], axis=1, kind="stable")
        rows = np.arange(len(alive))
        at, which = self.postings(term[rows, order[:, 0]])
        start = at - order[which, 0]
        ok = (start >= 0) & (start + windows.shape[1] < self.n)
        start, which = start[ok], which[ok]
        for j in range(1, windows.shape[1]):
            offset = order[which, j]
            want = term[which, offset] * self.n + start + offset
            ok = self.codes[np.minimum(np.searchsorted(self.codes, want), len(self.codes) - 1)] == want
            start, which = start[ok], which[ok]
        ok = self.same_text(start, start + windows.shape[1] - 1)
        return alive[which[ok]], start[ok]

    def proximity(self, windows: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its first term) where every other term lies within ``slop`` words, in any order."""
        alive, term = self.lookup(windows)
        if not len(alive):
            return alive, alive
        order = 1 + np.argsort(self.counts[term[:, 1:]], axis=1, kind="stable")
        start, which = self.postings(term[:, 0])
        text = np.searchsorted(self.ptr, start, "right")
        for j in range(order.shape[1]):
            low = np.maximum(start - slop, self.ptr[text - 1])
            high = np.minimum(start + slop, self.ptr[text] - 1)
            base = term[which, order[which, j]] * self.n
            ok = np.searchsorted(self.codes, base + low) < np.searchsorted(self.codes, base + high, "right")
            start, which, text = start[ok], which[ok], text[ok]
        return alive[which], start


@dataclass
class Phrases:
    """Distinct windows of one length, and the names of the items that have each."""

    windows: np.ndarray
    first: np.ndarray
    items: np.ndarray


def _blocks(benchmark: DataFrame, window: int, block_windows: int) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            w = W.words_of(b.column("text"), W.ALNUM_WORD, lower=True)
            h, names = w.hashes(), b.column("item_id").to_pylist()
            ids, cells = [], []
            for i, (s, e) in enumerate(zip(w.ptr[:-1], w.ptr[1:])):
                size = min(window, e - s)
                for at in range(s, e - size + 1) if size else ():
                    ids.append(names[i] or "")
                    cells.append(h[at : at + size].tobytes())
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(cells, pa.binary())], names=["item_id", "words"])

    windows = stored(items.mapInArrow(run, "item_id string, words binary").distinct(), "phrases")
    blocks = max(1, -(-windows.count() // block_windows))
    return [windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k) for k in range(blocks)]


def _phrases(block: DataFrame) -> list[Phrases]:
    by: dict[int, dict[bytes, set]] = {}
    for row in block.toLocalIterator():
        by.setdefault(len(row["words"]) // 8, {}).setdefault(bytes(row["words"]), set()).add(row["item_id"])
    out = []
    for size, found in sorted(by.items()):
        names = [sorted(x) for x in found.values()]
        out.append(Phrases(
            np.frombuffer(b"".join(found), np.uint64).reshape(-1, size),
            np.concatenate([[0], np.cumsum([len(x) for x in names])]), np.array([y for x in names for y in x], object),
        ))
    return out


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None,
           block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``doc_id, text_key, n_words, n_hit, items`` of every document.

    ``n_hit`` counts the words inside any occurrence of a window, or with ``slop`` the first words of
    windows whose terms all lie that near; ``items`` names the items concerned, in string order.
    """
    blocks = _blocks(benchmark, window, block_windows)
    context = index.sparkSession.sparkContext
    if len(blocks) == 1:
        return _pass(index, context.broadcast(_phrases(blocks[0])), slop).select("doc_id", "text_key", "n_words", "n_hit", "items")
    passes = []
    for block in blocks:
        phrases = context.broadcast(_phrases(block))
        passes.append(stored(_pass(index, phrases, slop).filter("n_hit > 0").select("segment", "place", "items", "cover"), "block"))
        phrases.destroy()
    found = passes[0]
    for other in passes[1:]:
        found = found.unionByName(other)
    by_bits = found.select("segment", "place", F.posexplode("cover").alias("at", "bits")).filter("bits <> 0")
    by_bits = by_bits.groupBy("segment", "place", "at").agg(F.bit_or("bits").alias("bits"))
    hits = by_bits.groupBy("segment", "place").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_hit"))
    names = found.select("segment", "place", F.explode("items").alias("item")).groupBy("segment", "place").agg(F.sort_array(F.collect_set("item")).alias("items"))
    every = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "text_keys", "sizes")).alias("place", "of"))
    every = every.select("segment", F.col("place").cast("long").alias("place"), "of.doc_ids", "of.text_keys", "of.sizes")
    none = F.array().cast("array<string>")
    return every.join(hits, ["segment", "place"], "left").join(names, ["segment", "place"], "left").select(
        F.col("doc_ids").alias("doc_id"), F.col("text_keys").alias("text_key"), F.col("sizes").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def _pass(index: DataFrame, phrases: Broadcast, slop: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield _answer(b.slice(i, 1).to_pylist()[0], phrases.value, slop)

    schema = "segment long, place long, doc_id long, text_key long, n_words long, n_hit long, items array<string>, cover array<long>"
    return index.mapInArrow(run, schema)


def _answer(row: dict, phrases: list[Phrases], slop: int | None) -> pa.RecordBatch:
    """One row per document of a segment; ``cover`` has a bit per word, and is empty where no word is hit."""
    seg = Segment.of(row)
    texts, change = len(seg.ptr) - 1, np.zeros(seg.n + 1, np.int64)
    names: list[set] = [set() for _ in range(texts)]
    for p in phrases:
        which, start = seg.phrases(p.windows) if slop is None else seg.proximity(p.windows, slop)
        if not len(which):
            continue
        np.add.at(change, start, 1)
        np.add.at(change, start + (p.windows.shape[1] if slop is None else 1), -1)
        text = np.searchsorted(seg.ptr, start, "right") - 1
        for t, w in set(zip(text.tolist(), which.tolist())):
            names[t].update(p.items[p.first[w] : p.first[w + 1]])
    covered = np.cumsum(change)[: seg.n - 1] > 0
    hit = np.diff(np.concatenate([[0], np.cumsum(covered)])[seg.ptr])
    cover = [_bits(covered[a:b]) if n else [] for a, b, n in zip(seg.ptr[:-1], seg.ptr[1:], hit)]
    return pa.record_batch(
        [
            pa.array([row["segment"]] * texts, pa.int64()), pa.array(range(texts), pa.int64()),
            pa.array(row["doc_ids"], pa.int64()), pa.array(row["text_keys"], pa.int64()), pa.array(np.diff(seg.ptr)), pa.array(hit),
            pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(cover, pa.list_(pa.int64())),
        ],
        names=["segment", "place", "doc_id", "text_key", "n_words", "n_hit", "items", "cover"],
    )


def _bits(covered: np.ndarray) -> np.ndarray:
    packed = np.packbits(covered)
    return np.pad(packed, (0, -len(packed) % 8)).view(np.int64)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    found = search(build(docs), benchmark, window)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    bad = search(build(docs), benchmark, window).filter("n_hit > 0").select(
        F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["bad_key"])
    return docs.join(bad, same, "left_anti")
