"""Document fingerprints from prefix polynomial hashes.

A text is its code points c_0 c_1 ...; the prefix array of a modulus p holds, for every i, the sum of
(c_j + 1) * B**j over j < i, modulo p. The hash of any span is a difference of two entries, divided by
the power at which the span begins, so two spans of any texts are compared in constant time, and the
longest common extension of two places is found by binary search. Two prime moduli are kept, 62 bits.

The fingerprint of a text is hexadecimal: its length (8 digits), 64 slots and prefix marks (2 digits each).
Its spans of ``SPAN`` code points fall into the slots by their hashes, and a slot keeps a byte of its smallest
hash (00: no span). The marks are a byte of the prefix hash at lengths that grow by an eighth each. The likeness
of two fingerprints is the larger of two estimates: the share of spans in common (Dice) from the slots, and the
common beginning as a share of the longer text from the first mark that differs. It is 1 for equal texts and
about 0 for unrelated ones; scattered edits show in the slots, a changed end of a text of repeated lines in the marks.

Documents are put in order of their ids by one range shuffle of whole rows; within a partition each row
meets its successor in the stream. Only the first and last row of a partition are matched afterwards, by
a join of at most as many rows as there are partitions.

Defined cases: a null text is empty; two empty texts have likeness 1, an empty and another one 0. A text
shorter than 24 code points takes spans of half its length. Null ids come first; rows that repeat an id
follow each other by a hash of the text. A lone document is its own successor. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatq.llm import words as W
from habitatq.sources.tables import stored

#: Two primes below 2**31 and a base for each; fixed, as fingerprints of different runs are compared.
MODULI = (2147483647, 2147483629)
BASES = (1000003019, 1442695041)
SPAN, SLOTS = 12, 64
_BLOCK = 1 << 16
_U = np.uint64


def _mod(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p by a division that numpy vectorises, unlike its remainder."""
    return x - x // _U(p) * _U(p)


def _powers(base: int, n: int, p: int) -> np.ndarray:
    out = np.ones(1, _U)
    while len(out) < n:
        out = np.concatenate([out, _mod(out * _U(pow(base, len(out), p)), p)])
    return out[:n]


class _Scale:
    """Powers of a base by exponent: low 16 bits from one table, the rest from another that grows."""

    def __init__(self, base: int, p: int):
        self.p, self.step, self.low, self.high = p, pow(base, _BLOCK, p), _powers(base, _BLOCK, p), np.ones(1, _U)

    def blocks(self, n: int) -> np.ndarray:
        if len(self.high) < n:
            self.high = _powers(self.step, 2 * n, self.p)
        return self.high

    def at(self, i: np.ndarray) -> np.ndarray:
        high = self.blocks(int(i.max(initial=0) >> 16) + 1)
        return _mod(self.low[i & (_BLOCK - 1)] * high[i >> 16], self.p)


_UP = [_Scale(b, p) for b, p in zip(BASES, MODULI)]
_DOWN = [_Scale(pow(b, -1, p), p) for b, p in zip(BASES, MODULI)]


class PrefixHashes:
    """Prefix arrays of a run of code points."""

    def __init__(self, codes: np.ndarray):
        self.n = n = len(codes)
        self.sums = []
        for scale in _UP:
            p, sums = scale.p, np.zeros(n + 1, np.uint32)
            high = scale.blocks((n >> 16) + 1)
            for a in range(0, n, _BLOCK):
                part = codes[a : a + _BLOCK].astype(_U) + _U(1)
                run = _mod(np.cumsum(_mod(part * scale.low[: len(part)], p)), p)
                sums[a + 1 : a + 1 + len(part)] = _mod(run * high[a >> 16] + _U(sums[a]), p)
            self.sums.append(sums)

    @classmethod
    def of(cls, text: str) -> PrefixHashes:
        return cls(code_points([text]))

    def spans(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hash of each span [i, j); equal for equal spans wherever they lie."""
        out = np.zeros(len(i), _U)
        for scale, sums in zip(_DOWN, self.sums):
            d = sums[j].astype(_U) + _U(scale.p) - sums[i]
            out = (out << _U(31)) | _mod(d * scale.at(i), scale.p)
        return out

    def rolling(self, size: int, block: int) -> np.ndarray:
        """Hashes of all spans of ``size`` that begin in one block of 65,536 places and end inside the run."""
        a = block * _BLOCK
        b = min(a + _BLOCK, self.n - size + 1)
        out = np.zeros(max(0, b - a), _U)
        if len(out):
            for scale, sums in zip(_DOWN, self.sums):
                d = sums[a + size : b + size].astype(_U) + _U(scale.p) - sums[a:b]
                shifted = _mod(_mod(d * scale.low[: b - a], scale.p) * scale.blocks(block + 1)[block], scale.p)
                out = (out << _U(31)) | shifted
        return out

    def extensions(self, i: np.ndarray, other: PrefixHashes, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of each place i and place j of the other, at most ``most``."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.spans(i, i + mid) == other.spans(j, j + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _borders(texts: list[str]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)


def slot_bytes(hashes: PrefixHashes, borders: np.ndarray) -> np.ndarray:
    """One row of ``SLOTS`` bytes for each text of a run."""
    lengths = np.diff(borders)
    least = np.full((len(lengths), SLOTS), np.iinfo(_U).max, _U)
    flat = least.reshape(-1)

    def put(text: np.ndarray, spans: np.ndarray) -> None:
        h = W.mix(spans + _U(0x9E3779B97F4A7C15))
        np.minimum.at(flat, text * SLOTS + (h >> _U(58)).astype(np.int64), h & _U((1 << 58) - 1))

    long, short = lengths >= 2 * SPAN, np.flatnonzero(lengths < 2 * SPAN)
    for block in range((hashes.n >> 16) + 1 if long.any() else 0):
        spans = hashes.rolling(SPAN, block)
        text = np.searchsorted(borders, [block * _BLOCK, block * _BLOCK + len(spans)], "right") - 1
        few = np.arange(text[0], min(text[1] + 1, len(lengths)))
        begin = np.maximum(borders[few], block * _BLOCK) - block * _BLOCK
        end = np.minimum(borders[few + 1] - SPAN + 1 - block * _BLOCK, len(spans))
        counts = np.where(long[few], np.maximum(0, end - begin), 0)
        put(np.repeat(few, counts), spans[np.repeat(begin, counts) + W.spans(counts)])
    size = np.maximum(1, lengths[short] // 2)
    counts = np.maximum(0, lengths[short] - size + 1)
    i = np.repeat(borders[short], counts) + W.spans(counts)
    put(np.repeat(short, counts), hashes.spans(i, i + np.repeat(size, counts)))
    return np.where(least == np.iinfo(_U).max, 0, 1 + _mod(W.mix(least), 255)).astype(np.uint8)


def mark_lengths(most: int) -> np.ndarray:
    """Lengths at which a prefix is marked: 1, 2, ... while an eighth is less than one, then growing by an eighth."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] + max(1, out[-1] >> 3))
    return np.array(out)


@dataclass
class Prints:
    """Fingerprints of a run of texts: lengths, slot bytes, and prefix marks (-1 beyond the text)."""

    n: np.ndarray
    slots: np.ndarray
    marks: np.ndarray

    @classmethod
    def of(cls, hashes: PrefixHashes, borders: np.ndarray) -> Prints:
        n = np.diff(borders)
        lengths = mark_lengths(int(n.max(initial=1)))
        text, k = np.nonzero(lengths[None, :] <= n[:, None])
        marks = np.full((len(n), len(lengths)), -1, np.int16)
        marks[text, k] = W.mix(hashes.spans(borders[text], borders[text] + lengths[k])) & _U(255)
        return cls(n, slot_bytes(hashes, borders), marks)

    @classmethod
    def of_texts(cls, texts: list[str]) -> Prints:
        return cls.of(PrefixHashes(code_points(texts)), _borders(texts))

    @classmethod
    def from_hex(cls, lines: list[str]) -> Prints:
        rows = [bytes.fromhex(x) for x in lines]
        marks = np.full((len(rows), max([1, *(len(r) - 4 - SLOTS for r in rows)])), -1, np.int16)
        for k, r in enumerate(rows):
            marks[k, : len(r) - 4 - SLOTS] = np.frombuffer(r[4 + SLOTS :], np.uint8)
        slots = np.array([np.frombuffer(r[4 : 4 + SLOTS], np.uint8) for r in rows]).reshape(len(rows), SLOTS)
        return cls(np.array([int.from_bytes(r[:4]) for r in rows]), slots, marks)

    def hex(self) -> list[str]:
        bodies = zip(self.n.tolist(), self.slots, self.marks.astype(np.uint8), (self.marks >= 0).sum(axis=1).tolist())
        return [f"{n:08x}{s.tobytes().hex()}{m[:k].tobytes().hex()}" for n, s, m, k in bodies]

    def rows(self, which: slice) -> Prints:
        return Prints(self.n[which], self.slots[which], self.marks[which])


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """How like each fingerprint is to the other's in the same row."""
    any_slot = ((a.slots > 0) | (b.slots > 0)).sum(axis=1)
    share = ((a.slots == b.slots) & (a.slots > 0)).sum(axis=1) / np.maximum(any_slot, 1)
    width = min(a.marks.shape[1], b.marks.shape[1])
    x, y = a.marks[:, :width], b.marks[:, :width]
    same = np.logical_and.accumulate((x == y) & (x >= 0), axis=1).sum(axis=1)
    common = np.concatenate([[0], mark_lengths(1 << 40)])[same]
    longer = np.maximum(a.n, b.n)
    near = np.maximum(2 * share / (1 + share), common / np.maximum(longer, 1))
    equal = (a.n == b.n) & (share == 1) & (same == (a.marks >= 0).sum(axis=1))
    return np.where((longer == 0) | equal, 1.0, near)


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def compared(texts: list[str], following: list[str]) -> dict[str, list | np.ndarray]:
    """Result columns of texts whose next texts are given."""
    edited = [edited_text(t, f) for t, f in zip(texts, following)]
    at, bt = _borders(texts), _borders(edited)
    a, b = PrefixHashes(code_points(texts)), PrefixHashes(code_points(edited))
    own, other = Prints.of(a, at), Prints.of(b, bt)
    if len(following) > 1 and following[:-1] == texts[1:]:  # a stream in order: only the last is new
        last = Prints.of_texts(following[-1:])
        near_next = np.concatenate([likeness(own.rows(slice(0, -1)), own.rows(slice(1, None))), likeness(own.rows(slice(-1, None)), last)])
    else:
        near_next = likeness(own, Prints.of_texts(following))
    return {
        "n_chars": np.diff(at),
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": own.hex(),
        "edited_fingerprint": other.hex(),
        "near_edited": likeness(own, other),
        "near_next": near_next,
        "common_prefix": a.extensions(at[:-1], b, bt[:-1], np.minimum(np.diff(at), np.diff(bt))),
    }


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, common_prefix long")
_NAMES = [f.split()[0] for f in RESULT.split(", ")]
_DONE, _LAST, _FIRST = 0, 1, 2
_STREAM = f"{RESULT}, part int, kind int, text string"


def _answers(ids: pa.Array, texts: list[str], following: list[str]) -> list[pa.Array]:
    found = compared(texts, following)
    return [ids, *(pa.array(found[n]) for n in _NAMES[1:])]


def _edge(doc_id: int | None, part: int, kind: int, text: str) -> pa.RecordBatch:
    nothing = [pa.array([None], t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())]
    return pa.record_batch(
        [pa.array([doc_id], pa.int64()), *nothing, pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([text], pa.string())],
        names=[*_NAMES, "part", "kind", "text"],
    )


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of all rows but the last of a partition; that and the first row are passed on with their texts."""
    held: tuple[int | None, str, int] | None = None
    for b in W.slices(batches):
        ids, texts, part = b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("part")[0].as_py()
        if held is None:
            yield _edge(ids[0], part, _FIRST, texts[0])
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = (ids[-1], texts[-1], part)
        n = len(ids) - 1
        if n:
            columns = _answers(pa.array(ids[:-1], pa.int64()), texts[:-1], texts[1:])
            more = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, _DONE, np.int32)), pa.nulls(n, pa.string())]
            yield pa.record_batch([*columns, *more], names=[*_NAMES, "part", "kind", "text"])
    if held is not None:
        yield _edge(held[0], held[2], _LAST, held[1])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in W.slices(batches, limit=W.SLICE_BYTES // 2):
        yield pa.record_batch(_answers(b.column("doc_id"), b.column("text").to_pylist(), b.column("following").to_pylist()), names=_NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            prints = Prints.of_texts(texts)
            yield pa.record_batch([b.column("doc_id"), pa.array(prints.n), pa.array(prints.hex())], names=["doc_id", "n_chars", "fingerprint"])

    return W.id_text(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they and the next text's are.

    Columns ``RESULT``; ``common_prefix`` is the longest common extension of text and edited text from their beginnings.
    """
    rows = W.id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    order = ["doc_id", "tie", "place"]
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    found = stored(rows.mapInArrow(_in_order, _STREAM), "fingerprints")
    done = found.filter(f"kind = {_DONE}").select(*_NAMES)
    parts = sorted(r.part for r in found.filter(f"kind = {_FIRST}").select("part").collect())  # at most as many as partitions
    if not parts:
        return done
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    first = found.filter(f"kind = {_FIRST}").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    last = found.filter(f"kind = {_LAST}").select("doc_id", "text", "part").join(follows, "part").join(first, "next_part")
    return done.unionByName(last.select("doc_id", "text", "following").mapInArrow(_pairs, RESULT))
