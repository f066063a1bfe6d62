"""Quality rules: counts with fixed limits, and divergence from language references.

A language's reference is the distribution of character classes and of common words (those
that make up at least ``COMMON_SHARE`` of the language's words) over all its documents. A
document is compared with every reference by the Jensen-Shannon distance (square root of the
divergence, base 2) and judged by the nearest. A document whose own language is named but has no
reference (fewer than ``MIN_REFERENCE_WORDS`` words, or beyond the ``MAX_LANGUAGES`` largest) is
judged by the fixed limits alone, as nothing of its kind is known. Short documents scatter by chance, so below
``MIN_WORDS`` words none is judged, and below ``MIN_WORDS_FOR_WORDS`` only characters count.

References take two passes with exact counts. The first finds candidates: a slice of the
corpus reports a word only if it has a tenth of the share there, so a word's reported sum
lacks at most a tenth of the share, and all words with nine tenths of it are candidates: a
bounded number per language. The second counts these over all documents.

Defined cases: a null text has no words; a null language adds to no reference but its
documents are judged; in ``references`` repeated rows count as often as they are there, ``rules``
gives it each text of a language once, so that a large group of copies cannot move a reference
onto itself; with no reference
(no language has ``MIN_REFERENCE_WORDS`` words) nothing diverges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatq.llm import words as W
from habitatq.sources.tables import stored

MIN_WORDS, MIN_WORDS_FOR_WORDS = 50, 75
#: Hash slots in which repeated texts are looked for; at most so many numbers are broadcast.
COPY_SLOTS = 1 << 20
COMMON_SHARE, MIN_REFERENCE_WORDS, MAX_LANGUAGES = 0.003, 1000, 2048
#: Largest distances of a kept document; that of words widens by WORD_SCATTER / sqrt(words), as chance does.
MAX_CHARACTER_DISTANCE, MAX_WORD_DISTANCE, WORD_SCATTER = 0.3, 0.2, 1.5

LOWER, UPPER, DIGIT, MARK, SYMBOL, SPACE, OTHER = range(7)
CLASSES = 7
CLASS_OF = np.full(256, SYMBOL, np.int64)
CLASS_OF[0x61:0x7B], CLASS_OF[0x41:0x5B], CLASS_OF[0x30:0x3A] = LOWER, UPPER, DIGIT
CLASS_OF[[ord(c) for c in ".,;:!?'\"()-"]] = MARK
CLASS_OF[:0x21] = SPACE
CLASS_OF[0x80:] = OTHER
_FIRST_BYTE = np.ones(256, np.int64)
_FIRST_BYTE[0x80:0xC0] = 0  # the rest of a code point
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[0x0A] = False


def _per_text(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[borders])


def class_counts(w: W.Words) -> np.ndarray:
    """Texts x character classes, in code points."""
    n = len(w.ptr) - 1
    text = np.repeat(np.arange(n), np.diff(w.offsets))
    first = _FIRST_BYTE[w.data] > 0
    return np.bincount((text * CLASSES + CLASS_OF[w.data])[first], minlength=n * CLASSES).reshape(n, CLASSES)


def lower_hashes(w: W.Words) -> np.ndarray:
    return W.Words(W.LOWER[w.data], w.offsets, w.start, w.end, w.ptr).hashes()


def repeated_words(w: W.Words, size: int = 3) -> np.ndarray:
    """Words of each text inside a window of ``size`` words found twice or more in the text."""
    at = W.window_starts(w.ptr, size)
    if not len(at):
        return np.zeros(len(w.ptr) - 1, np.int64)
    key = W.mix(W.window_hash(w.hashes(), size)[at] + w.owner()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[counts[which] > 1]
    change = np.zeros(int(w.ptr[-1]) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + size, -1)
    return _per_text(np.cumsum(change)[:-1] > 0, w.ptr)


def repeated_lines(column: pa.Array, w: W.Words) -> np.ndarray:
    """Lines of each text that have a word and equal an earlier line."""
    lines = W.words_of(column, _NOT_BREAK)
    has_word = np.searchsorted(w.start, lines.end) > np.searchsorted(w.start, lines.start)
    text = lines.owner()[has_word]
    key = W.mix(lines.hashes()[has_word] + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    n = len(w.ptr) - 1
    return np.bincount(text, minlength=n) - np.bincount(text[first], minlength=n)


@dataclass
class References:
    """Common words of all languages in order of their fingerprints; distributions per language (rows)."""

    languages: list[str]
    words: np.ndarray
    member: np.ndarray  # languages x words, whether common there
    word_share: np.ndarray  # languages x words
    class_share: np.ndarray  # languages x classes


def _counts(docs: DataFrame, chosen: np.ndarray | None, share: float) -> DataFrame:
    """``lang, kind, item, n``: words (kind 0), character classes (1) and the number of words (2) of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            w = W.words_of(b.column("text"))
            h, classes = lower_hashes(w), class_counts(w)
            names = b.column("lang").dictionary_encode()
            code = names.indices.to_numpy()
            langs, kinds, items, ns = [], [], [], []
            for k, name in enumerate(names.dictionary.to_pylist()):
                own = code == k
                words = h[np.repeat(own, w.counts)]
                found, n = np.unique(words, return_counts=True)
                keep = n >= share / 10 * len(words) if chosen is None else np.isin(found, chosen, assume_unique=True)
                add = [(0, found[keep].view(np.int64), n[keep]), (1, np.arange(CLASSES), classes[own].sum(axis=0)), (2, np.zeros(1, int), np.array([len(words)]))]
                for kind, item, count in add:
                    langs += [name] * len(item)
                    kinds += [kind] * len(item)
                    items.append(item)
                    ns.append(count)
            yield pa.record_batch(
                [pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array(np.concatenate(items).astype(np.int64)),
                 pa.array(np.concatenate(ns).astype(np.int64))], names=["lang", "kind", "item", "n"],
            )

    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).dropna()
    found = known.mapInArrow(run, "lang string, kind int, item long, n long")
    return found.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, share: float = COMMON_SHARE, max_languages: int = MAX_LANGUAGES,
               min_words: int = MIN_REFERENCE_WORDS) -> References:
    """References of the ``max_languages`` languages with most words."""
    first = stored(_counts(docs, None, share), "word-counts")
    sized = first.filter((F.col("kind") == 2) & (F.col("n") >= min_words)).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    large = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in sized], "lang string, total long"))  # max_languages rows
    rows = first.filter("kind = 0").join(large, "lang").filter(F.col("n") >= 0.9 * share * F.col("total")).collect()  # 1 / (0.9 * share) a language
    languages = sorted(r["lang"] for r in sized)
    chosen = np.unique(np.array([r["item"] for r in rows], np.int64).view(np.uint64))
    place = {x: i for i, x in enumerate(languages)}
    words, totals = np.zeros((len(languages), len(chosen))), np.zeros(len(languages))
    classes = np.zeros((len(languages), CLASSES))
    if languages:
        for r in _counts(docs, chosen, share).join(large.select("lang"), "lang", "left_semi").collect():
            i = place[r["lang"]]
            if r["kind"] == 0:
                words[i, np.searchsorted(chosen, np.int64(r["item"]).view(np.uint64))] = r["n"]
            elif r["kind"] == 1:
                classes[i, r["item"]] = r["n"]
            else:
                totals[i] = r["n"]
    word_share = words / np.maximum(totals, 1)[:, None]
    member = word_share >= share
    return References(languages, chosen, member, np.where(member, word_share, 0.0), classes / np.maximum(classes.sum(axis=1), 1)[:, None])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of ``p`` to ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def _rest(share: np.ndarray) -> np.ndarray:
    """What is left of one; rounding leaves none rather than less than none."""
    return np.where(share > 1 - 1e-12, 0.0, 1 - share)


def distances(w: W.Words, ref: References) -> tuple[np.ndarray, np.ndarray]:
    """Character and word distance of each text to the reference with the smallest sum of both."""
    n = len(w.ptr) - 1
    classes = class_counts(w)
    p = classes / np.maximum(classes.sum(axis=1), 1)[:, None]
    counts = np.zeros((n, len(ref.words)))
    if len(ref.words):
        h = lower_hashes(w)
        at = np.minimum(np.searchsorted(ref.words, h), len(ref.words) - 1)
        ok = ref.words[at] == h
        counts = np.bincount((w.owner() * len(ref.words) + at)[ok], minlength=n * len(ref.words)).reshape(n, -1)
    share = counts / np.maximum(w.counts, 1)[:, None]
    best_chars, best_words, best = np.zeros(n), np.zeros(n), np.full(n, np.inf)
    for i in range(len(ref.languages)):
        of_chars = distance(p, ref.class_share[i][None, :])
        own, other = share[:, ref.member[i]], ref.word_share[i][ref.member[i]]
        of_words = distance(
            np.concatenate([own, _rest(own.sum(axis=1, keepdims=True))], axis=1), np.append(other, _rest(other.sum()))[None, :]
        )
        nearer = of_chars + of_words < best
        best = np.where(nearer, of_chars + of_words, best)
        best_chars, best_words = np.where(nearer, of_chars, best_chars), np.where(nearer, of_words, best_words)
    return best_chars, best_words


def judge(docs: DataFrame, ref: References) -> DataFrame:
    """Counts, distances and verdict of every row; no shuffle."""

    rows = max(1, min(4096, (1 << 22) // max(1, len(ref.words))))  # texts x common words are held at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches, rows=rows):
            column = b.column("text")
            w = W.words_of(column)
            inside = np.zeros(len(w.data) + 1, np.int64)
            inside[w.start] += 1
            inside[w.end] -= 1
            points = _per_text(_FIRST_BYTE[w.data] * (np.cumsum(inside)[:-1] > 0), w.offsets)
            repeats, n_words = repeated_words(w), w.counts
            failed = (n_words < MIN_WORDS) | (100 * repeats > 50 * n_words)
            of_chars, of_words = distances(w, ref)
            limit = MAX_WORD_DISTANCE + WORD_SCATTER / np.sqrt(np.maximum(n_words, 1))
            strange = (of_chars > MAX_CHARACTER_DISTANCE) | ((n_words >= MIN_WORDS_FOR_WORDS) & (of_words > limit))
            strange &= ~b.column("unknown").to_numpy(zero_copy_only=False)
            cells = [n_words, points, _per_text(_SYMBOLS[w.data], w.offsets), repeated_lines(column, w), repeats, failed, ~failed & ~strange,
                     of_chars, of_words]
            yield pa.record_batch([b.column("doc_id"), *map(pa.array, cells)], names=[c.split()[0] for c in _JUDGED.split(", ")])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    with_lang = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    known = docs.sparkSession.createDataFrame([(x, False) for x in ref.languages], "lang string, unknown boolean")  # MAX_LANGUAGES rows at most
    marked = with_lang.join(F.broadcast(known), "lang", "left").select("doc_id", "text", F.coalesce("unknown", F.col("lang").isNotNull()).alias("unknown"))
    return marked.mapInArrow(run, _JUDGED)


_JUDGED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, character_distance double, word_distance double"
)


def copies_once(docs: DataFrame) -> DataFrame:
    """``lang, text``, each pair once; rows without one of them go.

    Only hashes and the texts that may have copies are shuffled: a row whose slot no repeated hash
    falls into has none and stays where it is. The rest is compared by whole texts.
    """
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).dropna()
    key = F.xxhash64("lang", "text")
    repeated = known.select(key.alias("key")).groupBy("key").count().filter("count > 1")
    slots = F.broadcast(stored(repeated.select(F.pmod("key", F.lit(COPY_SLOTS)).alias("slot")).distinct(), "slots"))
    placed = known.withColumn("slot", F.pmod(key, F.lit(COPY_SLOTS)))
    copied = placed.join(slots, "slot", "left_semi").select("lang", "text").distinct()
    return placed.join(slots, "slot", "left_anti").select("lang", "text").unionByName(stored(copied, "copied-texts"))


def rules(docs: DataFrame) -> DataFrame:
    """``judge`` with references of the documents themselves, of which copies count once."""
    return judge(docs, references(copies_once(docs)))
