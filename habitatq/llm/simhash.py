"""Near-duplicate documents by SimHash fingerprints and anchor-point covering.

Anchors are the words of a covering code: every point lies within the covering radius
of its own (nearest) anchor. A fingerprint is compared at its own anchor with all
fingerprints that were replicated there, and each is replicated to every anchor within
covering radius plus threshold, so no pair within the threshold is missed. The code is
the binary Golay code (23 bits, 4096 anchors, radius 3), applied to parts of the
fingerprint: of 4 differing bits some part of three holds at most 1, some part of two
at most 2. Three parts need about 16 replicas a fingerprint, two parts (with the bits
beyond 23 kept as they are, 2 million anchors each) about 210 but far fewer comparisons;
``layout`` picks by the number of distinct fingerprints.

Copies collapse to one row per distinct fingerprint before any replica is made. An
anchor with very many fingerprints is split: its own fingerprints are dealt to several
tasks and the replicas go to all of these. At an anchor only links that join two groups
not yet joined there are returned, so a dense group of g gives fewer than g links.

Defined cases: a text without a word (null included) has fingerprint zero and links like
any other; a null id takes part, never names a component, and a component of null ids
alone has a null name. Repeated rows are answered one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from habitatq.llm import graphs
from habitatq.llm import words as W
from habitatq.sources.tables import stored

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: Distinct fingerprints above which two parts serve instead of three.
TWO_PARTS_FROM = 1 << 24
#: Rows of one anchor that one task compares.
ANCHOR_ROWS = 100_000
_U = np.uint64


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of one whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *end[: len(words) - size].tolist()]
    ends = (end[size - 1 :] - 1).tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    for a in range(0, n, 1 << 16):
        parts = [joined[s:e] for s, e in zip(starts[a : a + (1 << 16)], ends[a : a + (1 << 16)])]
        h = np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            fps = [fingerprint_of(t, shingle) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return W.id_text(docs).mapInArrow(run, "doc_id long, fp long")


class Golay:
    """Nearest words of the perfect binary Golay code of length 23."""

    def __init__(self) -> None:
        leaders = np.zeros(2048, np.int64)
        for weight in range(4):
            for bits in combinations(range(23), weight):
                leader = sum(1 << b for b in bits)
                leaders[self.syndrome(np.array([leader]))[0]] = leader
        self.leaders = leaders

    @staticmethod
    def syndrome(x: np.ndarray) -> np.ndarray:
        """Remainder of division by the generator polynomial."""
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= np.where(x >> bit & 1, 0b101011100011 << (bit - 11), 0)
        return x

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return x ^ self.leaders[self.syndrome(x)]


def layout(distinct: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, differing bits allowed) of each part."""
    if distinct < TWO_PARTS_FROM:
        return [(0, 21, 1), (21, 21, 1), (42, 22, 1)]
    return [(0, 32, 2), (32, 32, 2)]


def anchors(fp: np.ndarray, part: tuple[int, int, int], code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Own anchor of each fingerprint, and all anchors within radius plus threshold (a row may repeat one)."""
    first, bits, allowed = part
    x = (fp.view(_U) >> _U(first)).astype(np.int64) & ((1 << bits) - 1)
    flips = [sum(1 << b for b in c) for w in range(allowed + 1) for c in combinations(range(max(bits, 23)), w)]
    y = x[:, None] ^ np.array(flips, np.int64)[None, :]
    near = (y >> 23 << 23) | code.nearest(y & ((1 << 23) - 1))
    return near[:, 0], np.sort(near, axis=1)


def replicas(distinct: DataFrame, parts: list[tuple[int, int, int]]) -> DataFrame:
    """``anchor, fp, own``: each fingerprint at every anchor near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        step = 4096 if len(parts) > 2 else 512
        for b in batches:
            every = b.column(0).to_numpy()
            for a in range(0, len(every), step):
                fp = every[a : a + step]
                for k, part in enumerate(parts):
                    own, near = anchors(fp, part, code)
                    fresh = np.ones(near.shape, bool)
                    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
                    row, col = np.nonzero(fresh)
                    at = near[row, col]
                    yield pa.record_batch(
                        [pa.array(at | (k << 40)), pa.array(fp[row]), pa.array(at == own[row])], names=["anchor", "fp", "own"]
                    )

    return distinct.select("fp").mapInArrow(run, "anchor long, fp long, own boolean")


def links_at(fp: np.ndarray, own: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the ``own`` fingerprints with all others at one anchor, fewer than there are fingerprints."""
    every = np.unique(fp)
    bits = every.view(_U)  # of signed numbers, the bits of the absolute value would be counted
    group = np.arange(len(every))
    mine = np.searchsorted(every, np.unique(fp[own]))
    left, right = [], []
    step = max(1, (1 << 20) // max(1, len(every)))
    for a in range(0, len(mine), step):
        block = mine[a : a + step]
        close = np.bitwise_count(bits[block][:, None] ^ bits[None, :]) <= threshold
        for r in np.flatnonzero(close.sum(axis=1) > 1):
            js = np.flatnonzero(close[r])
            of = group[js]
            kinds, at = np.unique(of, return_index=True)
            if len(kinds) > 1:
                to = group[block[r]]
                joined = kinds != to
                left += [every[block[r]]] * int(joined.sum())
                right += every[js[at[joined]]].tolist()
                group[np.isin(group, kinds)] = to
    return np.array(left, np.int64), np.array(right, np.int64)


def links(distinct: DataFrame, threshold: int = THRESHOLD, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """``a, b``: links that connect all fingerprints within ``threshold`` of each other.

    ``distinct`` has one row per fingerprint (column ``fp``) and is read twice.
    """
    if threshold > THRESHOLD:
        raise ValueError(f"the parts cover at most {THRESHOLD} differing bits")
    near = replicas(distinct, layout(distinct.count()))
    crowded = near.groupBy("anchor").count().filter(F.col("count") > anchor_rows)
    crowded = stored(crowded.select("anchor", F.ceil(F.col("count") / anchor_rows).cast("int").alias("tasks")), "crowded")
    if crowded.isEmpty():
        dealt = near.withColumn("task", F.lit(0))
    else:
        tasks = F.coalesce("tasks", F.lit(1))
        chosen = F.pmod(F.xxhash64("fp"), tasks).cast("int")
        dealt = (
            near.join(crowded, "anchor", "left")
            .withColumn("mine", chosen)
            .withColumn("task", F.explode(F.sequence(F.lit(0), tasks - 1)))
            .select("anchor", "fp", (F.col("own") & (F.col("task") == F.col("mine"))).alias("own"), "task")
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ("anchor", "task")):
            a, b = links_at(g.column("fp").to_numpy(), g.column("own").to_numpy(zero_copy_only=False), threshold)
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.repartition("anchor", "task").sortWithinPartitions("anchor", "task").mapInArrow(run, "a long, b long")


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Whole groups, one at a time, of batches sorted by integer keys."""
    kept: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        cuts = [0, *change.tolist(), b.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[s] for c in cols)
            if kept and key != last:
                yield pa.concat_batches(kept)
                kept = []
            kept.append(b.slice(s, e - s))
            last = key
    if kept:
        yield pa.concat_batches(kept)


def classes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id reachable over links, for every row."""
    found = stored(fingerprints(docs), "fingerprints")
    distinct = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = graphs.components(links(distinct, threshold)).select(F.col("node").alias("fp"), "root")
    placed = stored(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    names = stored(placed.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    by_fp = placed.join(names, "root").select("fp", "component_id")
    return found.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``; the fingerprint as 16 lowercase hex digits."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows whose id names their component: one document of each group of near copies.

    Rows without an id are kept as they are. Of rows that repeat the id all are the document's.
    """
    named = classes(docs.filter("doc_id IS NOT NULL"))
    kept = named.filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    out = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left").filter(docs["doc_id"].isNull() | kept["kept_id"].isNotNull())
    return out.select(*[docs[c] for c in docs.columns])
