"""Transducers against dictionaries, and collocations against counting every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from habitatq.llm import collocations
from habitatq.llm.transducer import Transducer, levels, summed

SCHEMA = "doc_id long, text string, lang string, name string, n long, w0 long, f long"


def random_paths(rng, n, depth=4, labels=5):
    paths = np.zeros((n, depth), np.int64)
    for row in paths:
        k = rng.randrange(1, depth + 1)
        row[:k] = [rng.choice([-7, 3, 11, 2**62, -(2**61)][:labels]) for _ in range(k)]
    return paths


@pytest.mark.parametrize("seed", range(4))
def test_transducer(seed):
    rng = random.Random(seed)
    paths, weights = summed(random_paths(rng, 300), np.array([rng.randrange(1, 9) for _ in range(300)]))
    want: Counter = Counter()
    for path, w in zip(paths.tolist(), weights.tolist()):
        path = [x for x in path if x]
        for k in range(1, len(path) + 1):
            want[tuple(path[:k])] += w
    asked = random_paths(rng, 500)
    t = Transducer.of(paths, weights)
    assert t.weights_of(asked).tolist() == [want[tuple(x for x in p if x)] for p in asked.tolist()]
    assert sum(len(step[0]) for step in levels(paths, weights)) == len(want)


def test_equal_states_are_one():
    paths = np.array([[a, b, c] for a in (1, 2, 3, 4) for b in (5, 6) for c in (7, 8)])
    assert len(Transducer.of(paths, np.ones(len(paths), np.int64))) == 4 + 2 + 2
    assert len(Transducer.of(paths[:0], np.ones(0, np.int64))) == 0


def brute(rows, min_count, top):
    n: Counter = Counter()
    f: Counter = Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    out: dict = {}
    for (lang, p), a in candidates.items():
        held = any(la == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (la, q), b in candidates.items())
        if not held:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


@pytest.mark.parametrize(("min_count", "top"), [(3, 2000), (20, 5), (300, 2000)])
def test_collocations(spark, monkeypatch, min_count, top):
    monkeypatch.setattr(collocations, "_BLOCK", 50)
    monkeypatch.setattr(collocations, "HOT", 0 if top == 5 else 8)  # every pair split over ranges
    monkeypatch.setattr(collocations, "SHARD_WORDS", 500)
    rng = random.Random(min_count)
    common = ["The", "of", "a b", "é", "\U0001f600", "x\x00y"]
    rare = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        words = [rng.choice(common if rng.random() < 0.7 else rare) for _ in range(rng.randrange(40))]
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\v"]) for w in words), rng.choice(["en", "de", None, "und"])))
    rows += [(200, None, "en"), (201, "", None), (202, " .,;\t\n", "fr"), (203, "very long " * 20_000, "la"), (None, "the hot phrase stands here", "en")]
    rows += [(300 + i, "the hot phrase stands here again and again and again", "en") for i in range(60)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in collocations.mine(docs, min_count, top).collect())
    want = brute(rows, min_count, top)
    assert got == want and (want or min_count == 300 and not want)


def test_no_rows(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).collect() == []
