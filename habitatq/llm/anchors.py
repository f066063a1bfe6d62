"""Content-selected anchors: the places at which passages shared by documents can be found.

Each window of ``WINDOW`` words chooses the smallest fingerprint among its runs of ``GRAM``
words (the leftmost of equals). The choice depends on the window's words alone, so equal
windows choose the same run at the same offset: two documents that share a window share an
anchor key. About one position in thirteen is an anchor. Documents none of whose anchors
occurs in another document share no window with any, and need no further look.
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

WINDOW, GRAM = 50, 25


@dataclass
class Anchors:
    """Anchors of a run of texts. An anchor at word ``at`` serves the windows that start ``low`` to ``high`` words before it."""

    words: W.Words
    hashes: np.ndarray
    text: np.ndarray
    key: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def window_hashes(self) -> np.ndarray:
        return W.window_hash(self.hashes, WINDOW)


def anchors_of(column: pa.Array) -> Anchors:
    w = W.words_of(column)
    h = w.hashes()
    starts = W.window_starts(w.ptr, WINDOW)
    grams = W.window_hash(h, GRAM)
    at = W.minimisers(grams, WINDOW - GRAM + 1)[starts] if len(starts) else np.zeros(0, np.int64)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    last = np.ones(len(at), bool)
    last[:-1] = first[1:]
    at, low, high = at[first], at[last] - starts[last], at[first] - starts[first]
    return Anchors(w, h, np.searchsorted(w.ptr, at, "right") - 1, grams[at].view(np.int64), at, low, high)


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_words, words_sha256, keys`` of every row, stored; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            a = anchors_of(b.column("text"))
            sha = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in b.column("text").to_pylist()]
            ends = np.searchsorted(a.text, np.arange(b.num_rows + 1))
            keys = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(a.key))
            yield pa.record_batch(
                [b.column("doc_id"), b.column("text_key"), pa.array(a.words.counts), pa.array(sha), keys],
                names=["doc_id", "text_key", "n_words", "words_sha256", "keys"],
            )

    texts = W.id_text(docs).withColumn("text_key", F.xxhash64("text"))
    return stored(
        texts.mapInArrow(run, "doc_id long, text_key long, n_words long, words_sha256 string, keys array<bigint>"), "sketch"
    )


def suspects(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """``doc_id, text_key, text, keys, homes``, stored: documents with keys that another document has too, these
    keys, and the smallest document that has each.

    Keys are counted with combination before the shuffle. The counts are stored, so that the look-up joins
    two plain shuffles and adaptive execution splits a key of very many documents.
    """
    found = sketched.filter("doc_id IS NOT NULL").select("doc_id", "text_key", F.explode("keys").alias("key"))
    shared = found.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    by_doc = found.join(stored(shared.select("key", "least"), "shared"), "key").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("key", "least")).alias("has"))
    texts = W.id_text(docs).filter("doc_id IS NOT NULL").withColumn("text_key", F.xxhash64("text"))
    joined = texts.join(by_doc, ["doc_id", "text_key"])
    return stored(joined.select("doc_id", "text_key", "text", F.col("has.key").alias("keys"), F.col("has.least").alias("homes")), "suspects")


def shared_anchors(batch: pa.RecordBatch) -> tuple[Anchors, np.ndarray, np.ndarray]:
    """Anchors of a ``suspects`` batch, which of them have a key listed with their document, and the homes of those."""
    a = anchors_of(batch.column("text"))
    keys, homes = batch.column("keys"), batch.column("homes").flatten().to_numpy()
    owner = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
    listed = W.mix(keys.flatten().to_numpy().view(np.uint64)) + owner.astype(np.uint64)
    mine = W.mix(a.key.view(np.uint64)) + a.text.astype(np.uint64)
    order = np.argsort(listed)
    at = np.searchsorted(listed, mine, sorter=order)
    at = order[np.minimum(at, len(order) - 1)] if len(order) else at[:0]
    ok = listed[at] == mine if len(order) else np.zeros(len(mine), bool)
    return a, ok, homes[at[ok]] if len(order) else homes


def union_of(spans: list) -> list[list[int]]:
    """Overlapping or touching word spans as one, in order."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def per_document(spans: DataFrame) -> DataFrame:
    """``doc_id, text_key, spans``: the spans (``start``, ``stop``) of each document; as many as its words at most."""
    return spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def without_spans(suspect: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_removed, kept_sha256`` of the documents that lose words, one row per distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            removed, sha = [], []
            for text, cut in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                words, kept, at, gone = text.encode().split(), [], 0, 0
                for s, e in union_of([(x["start"], x["stop"]) for x in cut]):
                    kept += words[at:s]
                    at, gone = e, gone + e - s
                removed.append(gone)
                sha.append(hashlib.sha256(b" ".join(kept + words[at:])).hexdigest())
            yield pa.record_batch(
                [b.column("doc_id"), b.column("text_key"), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "text_key", "n_removed", "kept_sha256"],
            )

    texts = suspect.select("doc_id", "text_key", "text").join(per_document(spans), ["doc_id", "text_key"])
    cut = texts.mapInArrow(run, "doc_id long, text_key long, n_removed long, kept_sha256 string")
    return cut.dropDuplicates(["doc_id", "text_key"])


def digest(sketched: DataFrame, cut: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of the sketch."""
    joined = sketched.drop("keys").join(cut, ["doc_id", "text_key"], "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256")
    )
