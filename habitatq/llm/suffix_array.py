"""Passages repeated across documents, by a sparse suffix array.

Only suffixes at content-selected anchor positions are retained, and of these only ones
whose first ``GRAM`` words also begin a retained suffix of another document. They are
sorted by their next ``WINDOW`` words over the whole cluster; the sort key ends with the
document id, so no range of it is too large for a task. In sorted order

* suffixes with the same words on both sides lie together: the first of them stands for
  all, and the windows of those from later documents are repeated;
* the longest match to the right with a different neighbour tells which windows of a
  standing suffix can occur elsewhere at all; these are extended to the left and looked
  up by fingerprint. The first and last group of a range keep all theirs.

A word is repeated if a window of ``WINDOW`` words over it also starts in a document with
a smaller id. A document that repeats only itself has no repeated words.

Defined cases: a null id neither has nor causes repeated words; a null text has no words;
rows with the same id are one document, so none is smaller than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from habitatq.llm import anchors as A
from habitatq.llm import words as W
from habitatq.sources.tables import stored

_SUFFIX = "right binary, wins binary, high int, doc_id long, text_key long, at long"


def suffixes(suspect: DataFrame) -> DataFrame:
    """Retained suffixes: next words as 16-bit symbols, and fingerprints of the windows that chose the position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            a, ok, _ = A.shared_anchors(b)
            if not ok.any():
                continue
            text, at, low, high = a.text[ok], a.at[ok], a.low[ok], a.high[ok]
            symbol = np.concatenate([(a.hashes >> np.uint64(48)).astype(">u2"), np.zeros(A.WINDOW, ">u2")])
            cell = at[:, None] + np.arange(A.WINDOW)[None, :]
            right = np.where(cell < a.words.ptr[text + 1][:, None], symbol[cell], 0).astype(">u2")
            wins = a.window_hashes()
            base = a.words.ptr[text]
            yield pa.record_batch(
                [
                    pa.array([x.tobytes() for x in right], pa.binary()),
                    pa.array([wins[p - h : p - l + 1].tobytes() for p, l, h in zip(at, low, high)], pa.binary()),
                    pa.array(high.astype(np.int32)), b.column("doc_id").take(pa.array(text)), b.column("text_key").take(pa.array(text)),
                    pa.array(at - base),
                ],
                names=["right", "wins", "high", "doc_id", "text_key", "at"],
            )

    return suspect.mapInArrow(run, _SUFFIX)


def compare_neighbours(sorted_suffixes: DataFrame) -> DataFrame:
    """``win, doc_id, text_key, start, stop, source``: spans that repeat (of the earlier document ``source``) and, without
    a source, windows to look up. Batches are compared one by one; the outermost groups of each keep all their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _compared(b)

    return sorted_suffixes.mapInArrow(run, "win long, doc_id long, text_key long, start long, stop long, source long")


def _compared(b: pa.RecordBatch) -> pa.RecordBatch:
    n = b.num_rows
    right = np.frombuffer(b"".join(b.column("right").to_pylist()), ">u2").reshape(n, A.WINDOW)
    wins = b.column("wins").to_pylist()
    high, doc, key, at = (b.column(c).to_numpy() for c in ("high", "doc_id", "text_key", "at"))
    differs = right[1:] != right[:-1]
    same_right = ~differs.any(axis=1)
    head = np.ones(n, bool)
    head[1:] = ~same_right | (high[1:] != high[:-1]) | np.array([x != y for x, y in zip(wins[1:], wins[:-1])], bool)
    heads = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    common = np.where(same_right, A.WINDOW, differs.argmax(axis=1))[heads[1:] - 1]
    whole = np.array([A.WINDOW])
    longest = np.maximum(np.concatenate([whole, common]), np.concatenate([common, whole]))[group]
    source = doc[heads][group]
    sizes = np.array([len(x) // 8 for x in wins])
    start = at - high
    later = doc > source
    flat = np.frombuffer(b"".join(wins), np.int64)
    first = np.cumsum(sizes) - sizes
    # window j of a suffix starts ``high - j`` words before it and needs the rest to the right
    look = np.where(later, 0, np.minimum(sizes, np.maximum(0, high - (A.WINDOW - longest) + 1)))
    row, j = np.repeat(np.arange(n), look), W.spans(look)
    return pa.record_batch(
        [
            pa.array(np.concatenate([flat[first[later]], flat[first[row] + j]])),
            pa.array(np.concatenate([doc[later], doc[row]])), pa.array(np.concatenate([key[later], key[row]])),
            pa.array(np.concatenate([start[later], start[row] + j])),
            pa.array(np.concatenate([start[later] + sizes[later] - 1 + A.WINDOW, start[row] + j + A.WINDOW])),
            pa.array(np.concatenate([source[later], np.zeros(len(row), np.int64)]), mask=np.repeat([False, True], [later.sum(), len(row)])),
        ],
        names=["win", "doc_id", "text_key", "start", "stop", "source"],
    )


def repeated_spans(suspect: DataFrame) -> DataFrame:
    """``doc_id, text_key, start, stop, source``: spans of repeated words, overlapping as found."""
    order = ["right", "high", "wins", "doc_id"]
    ranged = suffixes(suspect).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(compare_neighbours(ranged), "compared")
    least = found.filter("source IS NULL").groupBy("win").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = stored(least.filter("least < most").select("win", "least"), "windows")  # a plain shuffle, so a hot window can be split
    looked = found.join(least, "win", "left")
    earlier = F.least("source", F.when(F.col("least") < F.col("doc_id"), F.col("least")))
    return looked.select("doc_id", "text_key", "start", "stop", earlier.alias("source")).filter("source IS NOT NULL")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, first_word, n_words, source_doc_id`` of every longest run of repeated words.

    The source is the smallest document with the run's first window.
    """
    spans = repeated_spans(suspects_of(docs))
    own = Window.partitionBy("doc_id", "text_key").orderBy("start")
    begins = F.col("start") > F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("run", F.sum(F.when(begins, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "text_key", "run").agg(
        F.min("start").alias("first_word"), (F.max("stop") - F.min("start")).alias("n_words"), F.min_by("source", "start").alias("source_doc_id")
    ).select("doc_id", "first_word", "n_words", "source_doc_id")


def suspects_of(docs: DataFrame) -> DataFrame:
    return A.suspects(docs, A.sketch(docs))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated words, and the white space after them, cut from ``text``.

    ``n_chars`` follows where there is such a column. A document of which no word is left goes.
    """
    suspect = suspects_of(docs)
    texts = suspect.select("doc_id", "text_key", "text").join(A.per_document(repeated_spans(suspect)), ["doc_id", "text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            w = W.words_of(b.column("text"))
            out = []
            for i, cut in enumerate(b.column("spans").to_pylist()):
                s, e, base = int(w.offsets[i]), int(w.offsets[i + 1]), w.ptr[i]
                kept = []
                for a, z in A.union_of([(x["start"], x["stop"]) for x in cut]):
                    kept.append(bytes(w.data[s : w.start[base + a]]))
                    s = int(w.start[base + z]) if base + z < w.ptr[i + 1] else e
                out.append((b"".join(kept) + bytes(w.data[s:e])).decode())
            yield pa.record_batch([b.column("doc_id"), b.column("text_key"), pa.array(out, pa.string())], names=["cut_id", "cut_key", "cut_text"])

    cut = texts.mapInArrow(run, "cut_id long, cut_key long, cut_text string").dropDuplicates(["cut_id", "cut_key"])
    same = (docs["doc_id"].cast("long") == cut["cut_id"]) & (F.xxhash64(docs["text"].cast("string")) == cut["cut_key"])
    left = cut["cut_text"]
    joined = docs.join(cut, same, "left").filter(left.isNull() | left.rlike("[^ \\t-\\r]"))
    changed = {"text": F.coalesce(cut["cut_text"], docs["text"]).alias("text")}
    if "n_chars" in docs.columns:
        chars = F.when(cut["cut_text"].isNotNull(), F.length(cut["cut_text"])).otherwise(docs["n_chars"])
        changed["n_chars"] = chars.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return joined.select(*[changed.get(c, docs[c]) for c in docs.columns])
