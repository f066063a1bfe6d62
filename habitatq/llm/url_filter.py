"""URL filter: host and path rules, and a logistic regression for all other URLs.

The regression sees hashed character n-grams of host and path (apart from each other, with
their ends marked) and is trained on a small table of labelled URLs (``labelled_urls``, apart from the rules); scoring is one pass
without a shuffle, so a host with very many pages does no harm.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up
to ``?``, ``#`` or the end. A rule is a host and the start of a path; it fits the host and its
subdomains, and the longest that fits wins.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is judged by
the model (its bias alone). Repeated rows are judged one by one. Without labels of both kinds
the model allows everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitatq.llm import labelled_urls
from habitatq.llm import words as W

#: Rules of the registered query: verdict, and host with the start of the path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
SLOTS, ORDERS = 1 << 16, (3, 4, 5)
#: Labelled URLs of each kind that are fitted on, in the order of a hash.
FIT_URLS = 4096
STEPS, PENALTY = 200, 1e-4


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url)))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return W.ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of each URL, one after the other, and how many each has."""
    raw = [f"\x01{h}\x02{p}\x03".encode() for h, p in zip(hosts, paths)]
    size = np.array([len(x) for x in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), size)
    in_path = np.cumsum(data == 2) - owner > 0
    slots, owners = [], []
    for order in ORDERS:
        n = len(data) - order + 1
        if n <= 0:
            continue
        code = np.zeros(n, np.uint64)
        for j in range(order):
            code = code << np.uint64(8) | data[j : n + j]
        ok = owner[:n] == owner[order - 1 :]
        key = W.mix(code[ok] * np.uint64(2) + in_path[:n][ok].astype(np.uint64) + np.uint64(order << 50))
        slots.append((key % np.uint64(SLOTS)).astype(np.int64))
        owners.append(owner[:n][ok])
    owner, slot = np.concatenate(owners), np.concatenate(slots)
    order = np.argsort(owner, kind="stable")
    return slot[order], np.bincount(owner, minlength=len(raw))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def chance(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Chance of a block."""
        slot, counts = grams(hosts, paths)
        sums = np.diff(np.concatenate([[0], np.cumsum(self.weights[slot])])[np.concatenate([[0], np.cumsum(counts)])])
        return 1 / (1 + np.exp(-np.clip(sums / np.sqrt(np.maximum(counts, 1)) + self.bias, -50, 50)))


def fit(labelled: DataFrame, fit_urls: int = FIT_URLS, steps: int = STEPS) -> Model:
    """Learn from ``url, blocked``; at most ``fit_urls`` of each kind are collected."""
    host, path = host_and_path("url")
    known = labelled.select("url", F.col("blocked").cast("int").alias("blocked")).dropna()
    one = [known.filter(F.col("blocked") == k).orderBy(F.xxhash64("url"), "url").limit(fit_urls) for k in (0, 1)]
    rows = sorted(tuple(r) for r in one[0].unionByName(one[1]).select(host, path, "blocked").collect())
    y = np.array([r[2] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(SLOTS), -50.0)
    slot, counts = grams([r[0] for r in rows], [r[1] for r in rows])
    row, scale = np.repeat(np.arange(len(rows)), counts), 1 / np.sqrt(np.maximum(counts, 1))
    borders = np.cumsum(counts) - counts
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b, seen, seen_b = np.zeros(SLOTS), 0.0, np.full(SLOTS, 1e-12), 1e-12
    for _ in range(steps):
        z = np.add.reduceat(w[slot], borders) * scale + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        g = np.bincount(slot, (error * scale)[row], SLOTS) + PENALTY * w
        seen += g * g
        seen_b += error.sum() ** 2
        w -= 0.5 * g / np.sqrt(seen)
        b -= 0.5 * error.sum() / np.sqrt(seen_b)
    return Model(w, b)


class Rules:
    """Longest rule of a host, or of a domain above it, whose path the path starts with."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))
        for found in self.by_host.values():
            found.sort(key=lambda x: -len(x[0]))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str, str] | None = None
        while True:
            for start, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(start):
                    if best is None or len(rule) > len(best[0]):
                        best = (rule, verdict)
                    break
            _, dot, host = host.partition(".")
            if not dot:
                return best or (None, None)


def _with_parts(pages: DataFrame) -> DataFrame:
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path("url")
    return plain.select("page_id", "url", host.alias("host"), path.alias("path"))


def judge(pages: DataFrame, model: Model, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rules(rules)
        for b in W.slices(batches, "path"):
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            chance = model.chance(hosts, paths)
            found = [known.find(h, p) for h, p in zip(hosts, paths)]
            verdict = [v or ("block" if c > 0.5 else "allow") for (_, v), c in zip(found, chance)]
            yield pa.record_batch(
                [b.column("page_id"), b.column("host"), b.column("path"), pa.array([r for r, _ in found], pa.string()),
                 pa.array(verdict, pa.string()), pa.array(chance)],
                names=["page_id", "host", "path", "rule", "verdict", "block_score"],
            )

    parts = _with_parts(pages).select("page_id", "host", "path")
    return parts.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, block_score double")


def filter_pages(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """``judge`` with a model of ``labelled`` (``url, blocked``); of the table in ``labelled_urls`` if none is given."""
    if labelled is None:
        labelled = pages.sparkSession.createDataFrame(labelled_urls.rows(), "url string, blocked int")
    return judge(pages, fit(labelled), rules)
