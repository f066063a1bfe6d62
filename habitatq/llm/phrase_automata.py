"""Repeated passages removed by sharded Aho-Corasick automata.

1. Anchor phrases that two documents have are found (``anchors``), each with the smallest
   document that has it, its home. Documents go to the shards of their phrases' homes: copies
   of a document mostly share its shard, so a document's words are sent about once, and only
   the stretches around shared phrases are.
2. The phrases of a shard are compiled into an automaton (words as letters), and all stretches
   of the shard are streamed through it, which gives every occurrence of a phrase.
3. Windows of ``WINDOW`` words are formed over these occurrences alone, and those that occur in
   two documents are confirmed as recurring, each with its smallest document; in larger
   documents the words of such windows are removed.

A shard with too many stretches, such as one with a passage of very many documents, is dealt to
several tasks, each with the automaton of its own stretches; the windows found are then counted
over the cluster, with combination before the shuffle, and every task of the shard gets the
confirmed ones.

A word is removed if a window of ``WINDOW`` words over it also starts in a document with a
smaller id; windows are judged on the input. Defined cases: a null text has no words; a null
id neither loses nor removes words; rows with the same id are one document, so none removes
words of another.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatq.llm import anchors as A
from habitatq.llm import words as W
from habitatq.sources.tables import stored

#: Anchors of a shard on average, and of one task at most, about; letters streamed at once.
SHARD_ANCHORS, TASK_ANCHORS, LETTERS_AT_ONCE = 20_000, 60_000, 200_000


def _letters(hashes: np.ndarray) -> np.ndarray:
    """Words as automaton letters; 0 stays free."""
    return np.maximum(hashes >> np.uint64(32), np.uint64(1)).astype(np.uint32)


def stretches(suspect: DataFrame, shards: int) -> DataFrame:
    """``shard, doc_id, text_key, start, letters, phrases``: words around shared anchors, and where phrases start in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            a, ok, homes = A.shared_anchors(b)
            letters = _letters(a.hashes)
            text, at = a.text[ok], a.at[ok]
            start, stop = at - a.high[ok], at - a.low[ok] + A.WINDOW
            shard = (W.mix(homes.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((start, shard, text))
            out: list[list] = []
            for t, k, s, e, p in zip(*(x[order].tolist() for x in (text, shard, start, stop, at))):
                if out and out[-1][:2] == [t, k] and s <= out[-1][3]:
                    out[-1][3] = max(out[-1][3], e)
                    out[-1][4].append(p - out[-1][2])
                else:
                    out.append([t, k, s, e, [p - s]])
            texts = pa.array([x[0] for x in out], pa.int64())
            yield pa.record_batch(
                [
                    pa.array([x[1] for x in out], pa.int64()), b.column("doc_id").take(texts), b.column("text_key").take(texts),
                    pa.array([x[2] - int(a.words.ptr[x[0]]) for x in out], pa.int64()),
                    pa.array([letters[x[2] : x[3]].tobytes() for x in out], pa.binary()), pa.array([x[4] for x in out], pa.list_(pa.int32())),
                ],
                names=["shard", "doc_id", "text_key", "start", "letters", "phrases"],
            )

    return suspect.mapInArrow(run, "shard long, doc_id long, text_key long, start long, letters binary, phrases array<int>")


class _Stretches:
    """Stretches laid end to end, a free letter after each."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        raw = table.column("letters").to_pylist()
        self.size = np.array([len(x) // 4 for x in raw], np.int64)
        self.base = np.cumsum(self.size + 1) - (self.size + 1)
        self.letters = np.frombuffer(b"\0\0\0\0".join([*raw, b""]), np.uint32)
        self.doc, self.start = table.column("doc_id").to_numpy(), table.column("start").to_numpy()
        counts = table.column("phrases").combine_chunks() if isinstance(table, pa.Table) else table.column("phrases")
        self.phrase = counts.flatten().to_numpy() + np.repeat(self.base, np.diff(counts.offsets.to_numpy()))
        self.owner = np.repeat(np.arange(len(raw)), self.size + 1)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows over the automaton's hits, and their fingerprints."""
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for p in {self.letters[x : x + A.GRAM].tobytes() for x in self.phrase.tolist()}:
            automaton.add_word(tuple(np.frombuffer(p, np.uint32).tolist()))
        if not len(automaton):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        automaton.make_automaton()
        over = np.zeros(len(self.letters) + 1, np.int64)
        for a in range(0, len(self.letters), LETTERS_AT_ONCE):
            part = tuple(self.letters[max(0, a - A.GRAM + 1) : a + LETTERS_AT_ONCE].tolist())
            ends = np.fromiter((e for e, _ in automaton.iter(part)), np.int64) + max(0, a - A.GRAM + 1)
            begin = ends - A.GRAM + 1
            np.add.at(over, np.maximum(begin + A.GRAM - A.WINDOW, 0), 1)
            np.add.at(over, begin + 1, -1)
        at = np.flatnonzero(np.cumsum(over)[:-1] > 0)
        row = self.owner[at]
        at = at[at + A.WINDOW <= self.base[row] + self.size[row]]  # inside one stretch
        prints = W.window_hash(W.mix(self.letters.astype(np.uint64)), A.WINDOW)
        return at, prints[at].view(np.int64)


def _counted(win: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of two documents in order, and the smallest document of each."""
    order = np.argsort(win, kind="stable")
    win, low, high = win[order], low[order], high[order]
    first = np.flatnonzero(np.concatenate([[True], win[1:] != win[:-1]])) if len(win) else np.zeros(0, np.int64)
    if not len(first):
        return win, low
    low, high, win = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), win[first]
    return win[low < high], low[low < high]


def _occurrences(streamed: pa.Table, shared: pa.Table) -> pa.Table:
    """Spans of ``streamed`` that repeat a smaller document, at the hits of one automaton.

    ``shared`` has the confirmed windows of a shard of several tasks; others confirm their own.
    """
    spans = {n: pa.array([], pa.int64()) for n in ("doc_id", "text_key", "start", "stop")}
    if not streamed.num_rows:
        return pa.table(spans)
    s = _Stretches(streamed)
    at, win = s.windows()
    if shared.num_rows:
        known, least = _counted(*(shared.column(c).to_numpy() for c in ("win", "low", "high")))
    else:
        known, least = _counted(win, s.doc[s.owner[at]], s.doc[s.owner[at]])
    if not len(known):
        return pa.table(spans)
    place = np.minimum(np.searchsorted(known, win), len(known) - 1)
    cut = at[(known[place] == win) & (least[place] < s.doc[s.owner[at]])]
    if not len(cut):
        return pa.table(spans)
    new = np.concatenate([[True], (np.diff(cut) > A.WINDOW) | (np.diff(s.owner[cut]) > 0)])
    first, last = cut[new], cut[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(cut) - 1]])]
    row = s.owner[first]
    start = first - s.base[row] + s.start[row]
    key = streamed.column("text_key").to_numpy()[row]
    return pa.table({"doc_id": s.doc[row], "text_key": key, "start": start, "stop": start + last - first + A.WINDOW})


def repeated_spans(suspect: DataFrame, shard_anchors: int = SHARD_ANCHORS, task_anchors: int = TASK_ANCHORS) -> DataFrame:
    """``doc_id, text_key, start, stop``: spans of words to remove. ``suspect`` is read several times."""
    total = suspect.select(F.sum(F.size("keys"))).first()[0] or 0
    streamed = stretches(suspect, max(1, -(-total // shard_anchors)))
    sizes = streamed.groupBy("shard").agg(F.sum(F.size("phrases")).alias("n"))
    sizes = stored(sizes.select("shard", F.ceil(F.col("n") / task_anchors).cast("int").alias("tasks")), "shards")
    dealt = streamed.join(sizes, "shard").withColumn("task", F.pmod(F.xxhash64("doc_id"), "tasks").cast("int"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = _Stretches(b)
                at, win = s.windows()
                row = s.owner[at]
                yield pa.record_batch([b.column("shard").take(pa.array(row)), pa.array(win), pa.array(s.doc[row])], names=["shard", "win", "doc"])

    several = sizes.filter("tasks > 1")
    crowded = dealt.filter("tasks > 1").select("shard", "doc_id", "start", "letters", "phrases").mapInArrow(windows, "shard long, win long, doc long")
    counted = crowded.groupBy("shard", "win").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high")
    shared = counted.join(several, "shard").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    left = dealt.select("shard", "task", "doc_id", "text_key", "start", "letters", "phrases").groupBy("shard", "task")
    right = shared.select("shard", "task", "win", "low", "high").groupBy("shard", "task")
    return left.cogroup(right).applyInArrow(_occurrences, "doc_id long, text_key long, start long, stop long")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs``."""
    sketched = A.sketch(docs)
    suspect = A.suspects(docs, sketched)
    return A.digest(sketched, A.without_spans(suspect, repeated_spans(suspect)))
