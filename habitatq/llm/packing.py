"""Best-fit packing of tokenised documents by a configuration linear program.

Texts become token ids and pieces of at most ``CAPACITY`` tokens on the executors; what
the driver sees is the histogram of piece lengths (``CAPACITY`` rows at most). Lengths are
put into classes, and fractional numbers of configurations (multisets of classes that fit a
sequence) are found by multiplicative weights: the next configuration is the best one at
the current class prices, by a knapsack over the capacity, and the prices of what it holds
fall exponentially with the share already covered. Configurations are rounded down and filled
with real lengths; what is left, and all short pieces, go by decreasing length into the
fullest sequence that has room. All of this handles runs of alike sequences, so the plan has
as many rows as there are lengths and configurations, whatever the number of documents.

Pieces of a length are then numbered over the whole cluster and look up their sequence
and place in the plan.

Defined cases: a null text is empty and gives the closing id alone; repeated rows and null
ids are packed like any others.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from habitatq.llm import words as W
from habitatq.sources.tables import stored

CAPACITY, CLOSING_ID = 4096, 1
#: Width of a length class, and the length up to which pieces only fill gaps.
CLASS_WIDTH, SHORT = 16, 256
#: Share of a class's demand that one configuration may cover at once, and how fast prices fall.
STEP, RATE = 0.1, 6.0
#: Share of a sequence that a configuration must fill to be used.
FULL = 0.985
NUMBERED_AT_ONCE = 100_000
_KNOWN_PIECES = 400_000


#: Bytes of words that are one piece: ASCII letters, and the two bytes of U+00C0 to U+00FF but for the signs U+00D7 and U+00F7.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = True
_LETTER[[0x97, 0xB7]] = False
#: ASCII marks; letters followed by a run of them are two pieces.
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


class Encoder:
    """Token ids of whole texts, equal to the tokenizer's own.

    The tokenizer drops white space and never joins what it separates, nor letters and marks, so the
    distinct words of a slice are encoded once, those of plain letters without their case and
    without one closing mark. Such pieces stay known between slices (up to a bound) and are
    encoded many at a time; where one ends shows by the end-of-word tokens. A text that may hold
    a special token is encoded as it is.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def bytes_of(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def learn(self, pieces: list[bytes]) -> None:
        for a in range(0, len(pieces), 512):
            some = pieces[a : a + 512]
            ids = np.array(self.whole(b" ".join(some).decode()), self.kind)
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(some) and stops[-1] == len(ids):
                raw, size = ids.tobytes(), ids.itemsize
                self.known.update((p, raw[s * size : e * size]) for p, s, e in zip(some, [0, *stops], stops))
            else:
                self.known.update((p, self.bytes_of(self.whole(p.decode()))) for p in some)

    def texts(self, column: pa.Array) -> list[np.ndarray]:
        """The closing id ends each."""
        w = W.words_of(column)
        letters, marks = (np.concatenate([[0], np.cumsum(table[w.data], dtype=np.int32)]) for table in (_LETTER, _MARK))
        middle = w.start + letters[w.end] - letters[w.start]
        plain = (letters[middle] - letters[w.start] == middle - w.start) & (marks[w.end] - marks[middle] == w.end - middle)
        middle = np.where(plain & (middle > w.start), middle, w.end)
        count = 1 + (middle < w.end)
        place = np.cumsum(count) - count
        start, end = np.repeat(w.start, count), np.repeat(w.end, count)
        end[place] = middle
        tail = place[count > 1] + 1
        start[tail] = middle[count > 1]
        plain = np.repeat(plain, count)
        lower = W.LOWER[w.data]
        key = W.Words(lower, w.offsets, start, end, w.ptr).hashes()
        key[~plain] = W.mix(W.Words(w.data, w.offsets, start[~plain], end[~plain], w.ptr).hashes() + np.uint64(1))
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        raw, low = w.data.tobytes(), lower.tobytes()
        simple = plain[first].tolist()
        pieces = [low[s:e] if ok else raw[s:e] for s, e, ok in zip(start[first].tolist(), end[first].tolist(), simple)]
        if len(self.known) > _KNOWN_PIECES:
            self.known.clear()
        new = [i for i, p in enumerate(pieces) if p not in self.known]
        self.learn([pieces[i] for i in new if simple[i]])
        self.known.update((pieces[i], self.bytes_of(self.whole(pieces[i].decode()))) for i in new if not simple[i])
        parts = [self.known[p] for p in pieces]
        flat = np.frombuffer(b"".join(parts), self.kind)
        sizes = np.array([len(x) for x in parts], np.int64) // flat.itemsize
        taken = sizes[which]
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which], taken) + W.spans(taken)].astype(np.uint32) if len(flat) else flat.astype(np.uint32)
        borders = np.concatenate([[0], np.cumsum(taken)])[np.concatenate([place, [len(start)]])[w.ptr]]
        out = [np.append(ids[a:b], np.uint32(CLOSING_ID)) for a, b in zip(borders[:-1], borders[1:])]
        if any(x in raw for x in self.special):
            for i, text in enumerate(column.to_pylist()):
                if text and any(x in text.encode() for x in self.special):
                    out[i] = np.array([*self.whole(text), CLOSING_ID], np.uint32)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str | Callable[[], str], capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document, stored.

    ``tokenizer`` is the path of the vocabulary file, or a function that each worker calls for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer() if callable(tokenizer) else tokenizer)
        for b in W.slices(batches):
            row, start, length, crc = [], [], [], []
            for i, ids in enumerate(own.texts(b.column("text"))):
                for s in range(0, len(ids), capacity):
                    part = ids[s : s + capacity]
                    row.append(i)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.astype("<u4").tobytes()))
            start = np.array(start, np.int64)
            yield pa.record_batch(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array((start // capacity).astype(np.int32)), pa.array(start),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return stored(W.id_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")


def best_configuration(price: np.ndarray, capacity: int) -> np.ndarray:
    """How often each class 1..capacity is in the dearest multiset that fits; class c has size c."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        value = price[1 : c + 1] + best[c - 1 :: -1]
        k = int(value.argmax())
        best[c], last[c] = value[k], k + 1
    out, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        out[last[c]] += price[last[c]] > 0  # else room left free
        c -= last[c]
    return out


def configurations(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how many sequences take each, fractionally, so that every class is covered."""
    covered, size = np.zeros(capacity + 1), np.arange(capacity + 1) / capacity
    found: dict[bytes, list] = {}
    while True:
        left = demand - covered
        open_ = left > 1e-9
        if not open_.any():
            return [(c, x) for c, x in found.values()]
        price = np.where(open_, size * np.exp(-RATE * covered / np.maximum(demand, 1)), 0.0)
        c = best_configuration(price, capacity)
        used = c > 0
        share = float(np.min(np.minimum(left[used], np.maximum(STEP * demand[used], 1)) / c[used]))
        covered += share * c
        found.setdefault(c.tobytes(), [c, 0.0])[1] += share


@dataclass
class Run:
    """Sequences ``first`` to ``first + count - 1``, all filled up to ``fill``."""

    first: int
    count: int
    fill: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """The rounded configuration program, or the same best fit from empty sequences where that takes fewer."""
    plans = [_plan(histogram, capacity, configured) for configured in (True, False)]
    return min(plans, key=lambda rows: max((r[3] + r[2] for r in rows), default=0))


def _plan(histogram: dict[int, int], capacity: int, configured: bool) -> list[tuple[int, int, int, int, int]]:
    """(length, number of the first piece, pieces, sequence of the first piece, offset): one piece a sequence."""
    left = {n: k for n, k in histogram.items() if k}
    used = dict.fromkeys(left, 0)
    out, runs, sequences = [], [], 0

    def place(length: int, count: int, first: int, fill: int) -> None:
        out.append((length, used[length], count, first, fill))
        used[length] += count
        left[length] -= count

    width = max(1, min(CLASS_WIDTH, capacity // 64))
    classes: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        if n > min(SHORT, capacity // 8):
            classes.setdefault((n + width // 2) // width, []).append(n)
    slots = capacity // width
    demand = np.zeros(slots + 1)
    for c, lengths in classes.items():
        if c <= slots:
            demand[c] = sum(left[n] for n in lengths)
    for c, share in sorted(configurations(demand, slots) if configured else [], key=lambda x: -x[1]):
        count = int(share + 1e-6)
        if not count or c @ np.arange(slots + 1) < FULL * slots:
            continue  # best fit does better with what loosely filled sequences would take
        group = [Run(sequences, count, 0)]
        sequences += count
        sizes = np.repeat(np.arange(slots + 1), c)[::-1]
        for size in sizes[: max(1, len(sizes) - 1)]:  # best fit chooses the last, which makes up for rounded classes
            filled = []
            for run in group:
                while run.count:
                    length = next((n for n in classes[size] if left[n]), None)
                    if length is None:
                        filled.append(run)
                        break
                    k = min(run.count, left[length])
                    place(length, k, run.first, run.fill)
                    filled.append(Run(run.first, k, run.fill + length))
                    run = Run(run.first + k, run.count - k, run.fill)
            group = filled
        runs += group
    by_fill: dict[int, list[Run]] = {}
    for run in runs:
        by_fill.setdefault(run.fill, []).append(run)
    for length in sorted(left, reverse=True):
        fill = capacity - length
        while left[length]:
            while fill > 0 and not by_fill.get(fill):
                fill -= 1
            if fill <= 0:
                each = capacity // length
                k = -(-left[length] // each)
                by_fill.setdefault(0, []).append(Run(sequences, k, 0))
                sequences += k
                for turn in range(each):
                    some = by_fill[turn * length].pop()
                    k = min(some.count, left[length])
                    if k:
                        place(length, k, some.first, some.fill)
                        by_fill.setdefault(some.fill + length, []).append(Run(some.first, k, some.fill + length))
                    if some.count > k:
                        if some.fill:
                            by_fill.setdefault(some.fill, []).append(Run(some.first + k, some.count - k, some.fill))
                    if not left[length]:
                        break
                continue
            run = by_fill[fill].pop()
            k = min(run.count, left[length])
            place(length, k, run.first, run.fill)
            by_fill.setdefault(run.fill + length, []).append(Run(run.first, k, run.fill + length))
            if run.count > k:
                by_fill[fill].append(Run(run.first + k, run.count - k, run.fill))
    return out


def numbered(found: DataFrame, at_once: int = NUMBERED_AT_ONCE) -> DataFrame:
    """``found`` with ``number``: pieces of each length counted from 0, without a task for a whole length."""
    splits = max(1, found.count() // at_once)
    own = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = found.withColumn("split", F.pmod(F.xxhash64(*own), F.lit(splits)))
    sizes = dealt.groupBy("length", "split").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("length", "split", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "split").orderBy(*own)) - 1
    return dealt.withColumn("rank", rank).join(offsets, ["length", "split"]).withColumn("number", F.col("before") + F.col("rank"))


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    found = pieces(docs, tokenizer, capacity)
    rows = np.array(plan({r["length"]: r["count"] for r in found.groupBy("length").count().collect()}, capacity), np.int64).reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    key = rows[:, 0] << 48 | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            at = np.searchsorted(key, length << 48 | number, "right") - 1
            cells = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch(
                [*cells, pa.array(rows[at, 3] + number - rows[at, 1]), pa.array(rows[at, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered(found).select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(run, schema)
