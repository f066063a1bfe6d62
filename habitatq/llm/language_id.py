"""Language identification with string kernels.

The kernel of two texts counts the byte n-grams (every length of a blended spectrum)
that occur in both, divided by the geometric mean of how many each has; only presence
counts, so repetition inside a text changes nothing. N-grams are hashed to a fixed
number of slots. Kernel ridge regression, one language against the rest, is fitted on
Nyström landmarks; as the kernel is a scaled inner product, landmarks and coefficients
fold into one matrix (slots x languages), and scoring a batch is one matrix product.

Every language that has an id, a text and a name is learned, up to ``MAX_LANGUAGES`` (more than
identifiers of languages in use). Texts and landmarks a language become fewer as languages become
more, so that what is collected stays within ``FIT_TOTAL`` texts, or four a language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is
every text if nothing was learned. A null id is never learned from and not held out.
Repeated rows are each answered. Equal scores go to the first language in name order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitatq.llm import words as W

ORDERS = (1, 2, 3, 4)
SLOTS = 1 << 14
#: Per language: landmarks, and texts the regression is fitted on; both over all languages; languages.
LANDMARKS, FIT_TEXTS, FIT_TOTAL, LANDMARKS_TOTAL, MAX_LANGUAGES = 32, 400, 6400, 1024, 2048
RIDGE = 1e-2
_ROWS = 512


def presence(column: pa.Array, slots: int = SLOTS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Texts x slots, true where an n-gram of the text falls. A-Z count as a-z, white space as one kind."""
    data, borders = W.text_buffers(column)
    data = np.where(W.ANY_WORD, W.LOWER, np.uint8(0x20))[data]
    n, have = len(borders) - 1, np.zeros((len(borders) - 1) * slots, bool)
    base = np.repeat(np.arange(n, dtype=np.int64) * slots, np.diff(borders))
    code = np.zeros(len(data), np.uint32)
    for order in range(1, max(orders) + 1):
        code = (code[: len(data) - order + 1] << np.uint32(8)) | data[order - 1 :]
        if order not in orders or not len(code):
            continue
        slot = ((code + np.uint32(order)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - slots.bit_length() + 1)
        at = base[: len(code)] + slot
        have[at[base[: len(code)] == base[order - 1 :]] if order > 1 else at] = True
    return have.reshape(n, slots)


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, borders = W.text_buffers(column)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    at = np.concatenate([[0], np.cumsum(ascii_letter[data])])[borders]
    out = np.diff(at) > 0
    for i in np.flatnonzero(~out & (np.diff(borders) > 0)):
        out[i] = any(c.isalpha() for c in bytes(data[borders[i] : borders[i + 1]]).decode("utf-8", "replace"))
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # slots x languages

    def scores(self, have: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(have.sum(axis=1, dtype=np.float32), 1))
        return (have.astype(np.float32) @ self.weights) / size[:, None]


def held_out(doc_id: str, modulus: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def fit(docs: DataFrame, fit_texts: int = FIT_TEXTS, landmarks: int = LANDMARKS, max_languages: int = MAX_LANGUAGES) -> Model:
    """Learn from all rows given that have an id, a text and a language.

    Per language, at most ``fit_texts`` texts are taken in the order of a hash of the id (fewer beyond
    16 languages, see ``FIT_TOTAL``); texts are turned into slot bits on the executors, so what reaches
    the driver is bounded whatever their length. Beyond ``max_languages`` the most frequent are learned.
    """
    known = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).dropna()
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return Model([], np.zeros((SLOTS, 0), np.float32))
    fit_texts, landmarks = max(4, min(fit_texts, FIT_TOTAL // len(counts))), max(1, min(landmarks, LANDMARKS_TOTAL // len(counts)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (2.0 * fit_texts + 8) / r["count"])) for r in counts], "lang string, share double")
    taken = known.join(F.broadcast(shares), "lang").withColumn("place", place).filter(F.col("place") < F.col("share"))  # max_languages rows

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches, rows=_ROWS):
            packed = np.packbits(presence(b.column("text")), axis=1)
            yield pa.record_batch(
                [b.column("lang"), b.column("place"), b.column("doc_id"), pa.array([x.tobytes() for x in packed], pa.binary())],
                names=["lang", "place", "doc_id", "bits"],
            )

    sample = taken.mapInArrow(bits, "lang string, place double, doc_id long, bits binary")
    languages = sorted(r["lang"] for r in counts)
    by: dict[str, list] = {x: [] for x in languages}
    for x in sample.toLocalIterator():
        by[x["lang"]].append((x["place"], x["doc_id"], bytes(x["bits"])))
    for x in languages:
        by[x] = sorted(by[x])[:fit_texts]
    rows = [np.unpackbits(np.frombuffer(b, np.uint8)).astype(np.float32) for x in languages for _, _, b in by[x]]
    if not rows:
        return Model([], np.zeros((SLOTS, 0), np.float32))
    x = np.stack(rows)
    x /= np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
    owner = np.repeat(np.arange(len(languages)), [len(by[y]) for y in languages])
    first = np.concatenate([np.flatnonzero(owner == k)[:landmarks] for k in range(len(languages))])
    z = x[first]
    to_landmarks, among = (x @ z.T).astype(np.float64), (z @ z.T).astype(np.float64)
    goal = (owner[:, None] == np.arange(len(languages))[None, :]).astype(np.float64)
    weight = 1.0 / np.maximum(np.bincount(owner, minlength=len(languages)), 1)[owner][:, None]
    left = to_landmarks.T @ (to_landmarks * weight) + RIDGE * among + 1e-8 * np.eye(len(z))
    alpha = np.linalg.solve(left, to_landmarks.T @ (goal * weight))
    return Model(languages, (z.T.astype(np.float64) @ alpha).astype(np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text, lang_pred, score`` for every row; no shuffle."""
    names, weights = np.array([*model.languages, "und"], object), model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(list(names[:-1]), weights)
        for b in W.slices(batches, rows=_ROWS):
            letters = has_letter(b.column("text"))
            if len(names) == 1:
                best, score = np.zeros(len(letters), int), np.zeros(len(letters))
                letters[:] = False
            else:
                all_scores = own.scores(presence(b.column("text")))
                best = all_scores.argmax(axis=1)
                score = np.clip(all_scores[np.arange(len(best)), best], 0, 1).astype(float)
            best = np.where(letters, best, len(names) - 1)
            yield pa.record_batch(
                [*b.columns, pa.array(names[best], pa.string()), pa.array(np.where(letters, score, 0.0))],
                names=[*b.schema.names, "lang_pred", "score"],
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 4, rest: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: fitted on the rows not held out, applied to all rows."""
    train = docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, rest))
    model = fit(train)
    return predict(W.id_text(docs), model).select("doc_id", held_out("doc_id", modulus, rest).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, min_score: float, modulus: int = 4, rest: int = 2) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language with at least ``min_score``."""
    if "lang" not in docs.columns:
        raise ValueError("a column lang is needed to learn from")
    model = fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, rest)))
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items() if c != "text"], F.col("text").cast("string").alias("text"))
    kept = predict(plain, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return kept.select(*[F.col("text" if c == "text" else n).cast(docs.schema[c].dataType).alias(c) for c, n in names.items()])
