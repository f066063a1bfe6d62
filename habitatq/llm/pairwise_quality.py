"""Quality scores by Bradley-Terry ranking of preference pairs.

Every pair of a document labelled good and one labelled bad says that the first is
preferred. The chance of that is the logistic function of the difference of two scores, and a
score is a weighted sum of features of the text; the weights minimise the mean logistic loss over
all pairs there are, by Newton steps on feature differences. The cut between good and bad is the
score quantile at the share of bad labels, counted over all labels given (documents of a kind
weigh as much as all labels of that kind), and reported scores are the logistic function of the
distance to that cut, moved so that the cut is ``CUT``.

All labelled documents and all their pairs are learned from. Pairs are not formed: what a
document adds to a sum over pairs is a smooth function of its score, given by the scores of the
other kind. Scores fall into cells of width 1, in which such a function is the polynomial through
its values at ``NODES`` Chebyshev points, to about 1e-13. Spark adds up what documents weigh at
each point; the driver gets these sums, some per cell that has scores, and never a document.

Defined cases: a null text is empty and scored like any other; labels without an id or quality
are left out, repeated ones count as often as they are there; ids held out are never learned
from, and a null id is not held out. Without labels of both kinds every score is ``CUT``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatq.llm import quality_rules as Q
from habitatq.llm import words as W
from habitatq.llm.language_id import held_out
from habitatq.operators.aggregates import rank_ranges
from habitatq.sources.tables import stored

PENALTY, CUT, NODES = 1e-3, 0.3, 12
Sums = dict[tuple[int, int], np.ndarray]
_ANGLES = np.pi * (np.arange(NODES) + 0.5) / NODES
_COSINES = np.cos(np.outer(np.arange(NODES), _ANGLES)) * np.where(np.arange(NODES) > 0, 2.0, 1.0)[:, None] / NODES


def shares(column: pa.Array) -> np.ndarray:
    """Texts x shares of characters, words and lines."""
    w = W.words_of(column)
    n, words = len(w.ptr) - 1, np.maximum(w.counts, 1)
    classes = Q.class_counts(w)
    chars = np.maximum(classes.sum(axis=1), 1)
    owner, h = w.owner(), w.hashes()
    length = w.end - w.start
    inner, kinds = Q.CLASS_OF[w.data], []
    for kind in (Q.UPPER, Q.DIGIT, Q.SYMBOL, Q.MARK):
        sums = np.concatenate([[0], np.cumsum(inner == kind)])
        kinds.append(sums[w.end] - sums[w.start])
    upper, digit, symbol, mark = kinds

    def share(of_words: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=of_words, minlength=n) / words

    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    key = np.unique(W.mix(h) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
    distinct = np.bincount(owner[key], minlength=n) / np.sqrt(words) / 8
    last = inner[w.end - 1] if len(h) else np.zeros(0)
    return np.stack(
        [
            *(classes / chars[:, None]).T, share(upper == length), share(digit == length), share(symbol > 0), share(symbol == length),
            share(mark > 1), share(last == Q.SYMBOL), share(last == Q.MARK), share(same), share(length <= 3), share(length) / 20,
            Q.repeated_words(w) / words, Q.repeated_lines(column, w) / words, distinct, np.log1p(w.counts) / 10,
        ],
        axis=1,
    )


def features(of_text: np.ndarray) -> np.ndarray:
    """Texts x features: the shares and their square roots."""
    return np.concatenate([of_text, np.sqrt(np.maximum(of_text, 0))], axis=1)


WIDTH = features(shares(pa.array([""]))).shape[1]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (self.standard(x) * self.weights).sum(axis=1)  # row by row: equal texts score equal

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.cut + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Points:
    """Scores of one kind: their cells, and per point of each cell (points x 1 + features) what documents and features weigh there."""

    cells: np.ndarray
    sums: np.ndarray

    @property
    def at(self) -> np.ndarray:
        return (self.cells[:, None] + np.cos(_ANGLES) / 2).ravel()


@dataclass
class Pairs:
    """Means over all pairs at some weights, and the curvature each kind has at its points."""

    loss: float
    gradient: np.ndarray
    crossed: np.ndarray
    curvature: dict[int, tuple[np.ndarray, np.ndarray]]


def _spread(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each score, and what each point of it weighs there (scores x points)."""
    cell = np.rint(score)
    angle = np.arccos(np.clip(2 * (score - cell), -1, 1))
    return cell.astype(np.int64), np.cos(angle[:, None] * np.arange(NODES)) @ _COSINES


def _arrays(values: np.ndarray) -> pa.Array:
    """A matrix as a column of its lines."""
    return pa.array(list(values), pa.list_(pa.float64()))


def _lines(column: pa.Array) -> np.ndarray:
    """The matrix whose lines a column has."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def with_shares(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of every row, ``x`` its shares; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            yield pa.record_batch([b.column("doc_id"), _arrays(shares(b.column("text")))], names=["doc_id", "x"])

    return W.id_text(docs).mapInArrow(run, "doc_id long, x array<double>")


def _sums(rows: DataFrame, share: Callable[[np.ndarray, np.ndarray], Sums]) -> Sums:
    """Sum over all rows of the matrices that ``share(quality, features)`` gives, by its keys.

    A task adds up its own; those of tasks are added by line of a matrix, in the order of partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Sums = {}
        for b in batches:
            if b.num_rows:
                for key, m in share(b.column("quality").to_numpy(), features(_lines(b.column("x")))).items():
                    total[key] = total[key] + m if key in total else m
        for (kind, cell), m in total.items():
            yield pa.record_batch(
                [pa.array(np.full(len(m), kind, np.int32)), pa.array(np.full(len(m), cell)), pa.array(np.arange(len(m), dtype=np.int32)), _arrays(m)],
                names=["kind", "cell", "line", "v"],
            )

    parts = rows.mapInArrow(run, "kind int, cell long, line int, v array<double>").withColumn("part", F.spark_partition_id())
    ordered = parts.groupBy("kind", "cell", "line").agg(F.array_sort(F.collect_list(F.struct("part", "v"))).alias("parts"))
    added = F.aggregate(
        F.slice("parts", 2, F.size("parts")), F.col("parts")[0]["v"], lambda total, p: F.zip_with(total, p["v"], lambda a, b: a + b))
    got = ordered.select("kind", "cell", "line", added.alias("v")).toArrow().sort_by([("kind", "ascending"), ("cell", "ascending"), ("line", "ascending")])
    if not got.num_rows:
        return {}
    kind, cell, line = (got.column(c).to_numpy() for c in ("kind", "cell", "line"))
    first = np.flatnonzero(line == 0)
    found = np.split(_lines(got.column("v").combine_chunks()), first[1:])
    return {(int(kind[i]), int(cell[i])): m for i, m in zip(first, found, strict=True)}


def _with_ones(z: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(z), 1)), z], axis=1)


def _pairs(rows: DataFrame, model: Model) -> Pairs:
    """What all pairs of a good and a bad row say about the weights of the model."""

    def share(quality: np.ndarray, x: np.ndarray) -> Sums:
        cell, basis = _spread(model.raw(x))
        z = _with_ones(model.standard(x))
        keys, which = np.unique(np.stack([quality, cell]), axis=1, return_inverse=True)
        return {(int(q), int(c)): basis[which.ravel() == i].T @ z[which.ravel() == i] for i, (q, c) in enumerate(keys.T)}

    sums = _sums(rows, share)
    bad, good = (Points(np.array([c for k, c in sums if k == q]), np.concatenate([m for (k, _), m in sums.items() if k == q])) for q in (0, 1))
    pairs = bad.sums[:, 0].sum() * good.sums[:, 0].sum()
    loss, gradient, crossed = 0.0, np.zeros(WIDTH), np.zeros((WIDTH, WIDTH))
    of_good, of_bad = np.zeros(len(good.sums)), np.zeros(len(bad.sums))
    for a in range(0, len(good.sums), 512):
        own = good.sums[a : a + 512]
        ahead = good.at[a : a + 512, None] - bad.at
        wrong = 1 / (1 + np.exp(np.clip(ahead, -500, 500)))  # chance of the wrong order
        curve = wrong * (1 - wrong)
        loss += own[:, 0] @ np.logaddexp(0, -ahead) @ bad.sums[:, 0]
        gradient += own[:, 0] @ wrong @ bad.sums[:, 1:] - wrong @ bad.sums[:, 0] @ own[:, 1:]
        crossed += own[:, 1:].T @ curve @ bad.sums[:, 1:]
        of_good[a : a + 512] = curve @ bad.sums[:, 0]
        of_bad += own[:, 0] @ curve
    at = {1: (good.cells, of_good.reshape(-1, NODES) / pairs), 0: (bad.cells, of_bad.reshape(-1, NODES) / pairs)}
    penalty = PENALTY / 2 * model.weights @ model.weights
    return Pairs(loss / pairs + penalty, gradient / pairs + PENALTY * model.weights, (crossed + crossed.T) / pairs, at)


def _curve(rows: DataFrame, model: Model, pairs: Pairs) -> np.ndarray:
    """Second derivatives of the mean loss over all pairs."""

    def share(quality: np.ndarray, x: np.ndarray) -> Sums:
        cell, basis = _spread(model.raw(x))
        z, weight = model.standard(x), np.zeros(len(x))
        for q, (cells, curvature) in pairs.curvature.items():
            own = quality == q
            weight[own] = (basis[own] * curvature[np.searchsorted(cells, cell[own])]).sum(axis=1)
        return {(0, 0): (z * weight[:, None]).T @ z}

    return _sums(rows, share)[0, 0] - pairs.crossed + PENALTY * np.eye(WIDTH)


def fit(docs: DataFrame, labels: DataFrame, fit_labels: int | None = None) -> Model:
    """Learn from all labelled documents given; with ``fit_labels``, from so many labels of each kind in the order of a hash of the id."""
    return _fit(with_shares(docs), labels, fit_labels)


def _fit(table: DataFrame, labels: DataFrame, fit_labels: int | None = None) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().filter("quality IN (0, 1)")
    chosen = known
    if fit_labels is not None:
        kinds = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_labels) for q in (0, 1)]
        chosen = kinds[0].unionByName(kinds[1])
    rows = stored(table.join(chosen, "doc_id").select("quality", "x"), "labelled")
    first = _sums(rows, lambda quality, x: {(q, 0): _with_ones(x[quality == q]).sum(axis=0)[None] for q in (0, 1)})
    found = {q: int(first[q, 0][0, 0]) if (q, 0) in first else 0 for q in (0, 1)}
    model = Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0)
    if not found[0] or not found[1]:
        return model
    n = found[0] + found[1]
    mean = (first[0, 0][0, 1:] + first[1, 0][0, 1:]) / n
    square = _sums(rows, lambda quality, x: {(0, 0): ((x - mean) ** 2).sum(axis=0)[None]})[0, 0][0]
    model.mean, model.scale = mean, np.maximum(np.sqrt(square / n), 1e-6)
    pairs = _pairs(rows, model)
    for _ in range(30):
        step = np.linalg.solve(_curve(rows, model, pairs), pairs.gradient)
        if np.abs(step).max() < 1e-6:
            model.weights = model.weights - step
            break
        start, least = model.weights, pairs.loss
        for halvings in range(20):
            model.weights = start - step / 2**halvings
            pairs = _pairs(rows, model)
            if pairs.loss <= least + 1e-10:
                break
    model.cut = _cut(rows, model, found, {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()})
    return model


def _cut(rows: DataFrame, model: Model, found: dict[int, int], labelled: dict[int, int]) -> float:
    """Score quantile at the share of bad labels, interpolated between the middles of neighbouring weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column("quality"), pa.array(model.raw(features(_lines(b.column("x")))))], names=["quality", "raw"])

    # documents of a kind weigh as much as all its labels, in whole numbers
    whole = gcd(labelled[0] * found[1], labelled[1] * found[0])
    weight = {q: labelled[q] * found[1 - q] // whole for q in (0, 1)}
    target = weight[0] * found[0]
    scored = rows.mapInArrow(run, "quality int, raw double").groupBy(F.col("raw").alias("_v"))
    counts = scored.agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"))
    mass = sum(F.col(c).cast("decimal(38,0)") * F.lit(Decimal(weight[q])) for q, c in ((0, "bad"), (1, "good")))
    counted = stored(counts.select(F.lit(0).alias("one"), "_v", mass.cast("decimal(38,0)").alias("_m"), "bad", "good"), "scores")
    rank = rows.sparkSession.createDataFrame([(0, Decimal(target))], "one int, _rank decimal(38,0)")
    held = rank_ranges(counted, ["one"], rank).first()
    before = counted.filter(F.col("_v") < held["_low"]).agg(F.max("_v")).first()[0]
    after = counted.filter(F.col("_v") > held["_high"]).agg(F.min("_v")).first()[0]
    edges = held["_low"] if before is None else before, held["_high"] if after is None else after
    near = sorted(counted.filter(F.col("_v").between(*edges)).collect(), key=lambda r: r["_v"])  # a range of few values and its neighbours
    done = int(held["_before"]) - sum(int(r["_m"]) for r in near if r["_v"] < held["_low"]) - target
    middles, values = [], []
    for r in near:
        low, high = weight[0 if r["bad"] else 1], weight[1 if r["good"] else 0]
        middles += [done + low / 2, done + int(r["_m"]) - high / 2]
        values += [r["_v"]] * 2
        done += int(r["_m"])
    return float(np.interp(0, middles, values))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every row; no shuffle."""
    return _score(with_shares(docs), model)


def _score(table: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.scores(features(_lines(b.column("x"))))
                yield pa.record_batch([b.column("doc_id"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return table.mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; labels of ids held out are not used."""
    table = stored(with_shares(docs), "shares")
    model = _fit(table, labels.filter(~held_out("doc_id", modulus, rest)))
    return _score(table, model).select("doc_id", held_out("doc_id", modulus, rest).alias("held_out"), "score", "predicted")
