"""Prefix polynomial hashes against plain string comparison, and the query against one loop over sorted documents."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest

from habitatq.llm import catalog, prefix_hashes as P

SCHEMA = "doc_id long, text string, lang string, part int, kind int, tie long, place long, following string"
SMALL = "/root/testdata/sf0.001"


def some_texts(seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    sizes = [0, 1, 2, 3, 4, 11, 12, 13, 23, 24, 25, 60, 900, 70_000, 140_000]
    return ["".join(rng.choice("ab é\U0001f600\x00") for _ in range(n)) for n in sizes] + ["a" * 200_000, "ab" * 40_000]


def test_equal_spans_hash_alike_and_others_do_not():
    rng = random.Random(1)
    text = "".join(rng.choice("ab") for _ in range(3000)) + "x" * 70_000
    h = P.PrefixHashes.of(text)
    for _ in range(300):
        n, i, j = rng.randrange(12), rng.randrange(3000), rng.randrange(72_000)
        got = h.spans(np.array([i]), np.array([i + n])) == h.spans(np.array([j]), np.array([j + n]))
        assert bool(got[0]) == (text[i : i + n] == text[j : j + n])


def test_longest_common_extensions():
    texts = some_texts()
    for a in texts:
        for b in (a, a[: len(a) // 2] + "z" + a[len(a) // 2 + 1 :], a[1:], ""):
            x, y = P.PrefixHashes.of(a), P.PrefixHashes.of(b)
            for i in {0, len(a) // 3}:
                want = len(os.path.commonprefix([a[i:], b]))
                most = np.array([min(len(a) - i, len(b))])
                assert x.extensions(np.array([i]), y, np.array([0]), most)[0] == want


def test_a_text_has_one_fingerprint_in_any_run():
    texts = some_texts()
    together = P.slot_bytes(P.PrefixHashes(P.code_points(texts)), P._borders(texts))
    for row, text in zip(together, texts):
        n = len(text)
        size = P.SPAN if n >= 2 * P.SPAN else max(1, n // 2)
        hashes = P.PrefixHashes.of(text)
        alone = P.slot_bytes(hashes, P._borders([text]))[0]
        i = np.arange(max(0, n - size + 1))
        spans = P.W.mix(hashes.spans(i, i + size) + np.uint64(0x9E3779B97F4A7C15))
        assert (row == alone).all()
        assert set(np.flatnonzero(alone)) == {int(s) >> 58 for s in np.unique(spans)}


def test_likeness():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    near = text[:1000] + "Z" + text[1001:2500] + "insertion" + text[2500:]
    far = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    prints = P.Prints.of_texts([text, near, far, "", "", text])
    read = P.Prints.from_hex(prints.hex())

    def like(i, j):
        a, b = (P.likeness(p.rows(slice(i, i + 1)), p.rows(slice(j, j + 1)))[0] for p in (prints, read))
        assert a == b
        return a

    assert like(0, 1) > 0.9 and like(0, 2) < 0.1
    assert like(0, 5) == 1 and like(3, 4) == 1 and like(0, 4) == 0
    lines = "the same line over and over\n" * 90
    prints = read = P.Prints.of_texts([lines, P.edited_text(lines, far)])
    assert 0.6 <= like(0, 1) < 0.8


def brute(rows: list[tuple]) -> dict:
    """By (id, text, next text): count of rows. Rows of one id go by the hash that Spark gave their text."""
    out: dict = {}
    for k, (i, t, _) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n, q = len(t), len(t) // 4
        edited = t[: n - q] + following[:q]
        key = (i, n, hashlib.sha256(edited.encode()).hexdigest(), len(os.path.commonprefix([t, edited])))
        out[key] = out.get(key, 0) + 1
    return out


def check(spark, docs):
    from pyspark.sql import functions as F

    text = F.coalesce("text", F.lit(""))
    rows = [tuple(r) for r in docs.select("doc_id", text, F.xxhash64(text)).collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    got: dict = {}
    found = P.with_edited(docs).collect()
    for r in found:
        key = (r.doc_id, r.n_chars, r.edited_sha256, r.common_prefix)
        got[key] = got.get(key, 0) + 1
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) >= 8 + 2 * P.SLOTS
        if r.n_chars >= 100 and r.common_prefix < r.n_chars:
            assert r.fingerprint != r.edited_fingerprint
    assert got == brute(rows)
    return found, rows


def test_odd_rows(spark):
    rng = random.Random(8)
    texts = some_texts()
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "null id"), (None, None), (6, "same id"), (6, "same id"), (6, None), (-5, "first")]
    rows += [(1000 + i, "copy of a hot text " * 5) for i in range(60)] + [(2000, "hot id " * 9)] * 40
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "l", 1, 1, 1, 1, "f") for i, t in rows], SCHEMA).repartition(5)
    found, _ = check(spark, docs)
    hot = [r for r in found if r.doc_id and 1000 <= r.doc_id < 1059]
    assert len({r.fingerprint for r in hot}) == 1 and all(r.near_next == 1 for r in hot)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    docs = spark.createDataFrame([(i, f"text number {i} of a few", "l", 1, 1, 1, 1, "f") for i in range(n)], SCHEMA)
    found, _ = check(spark, docs)
    assert len(found) == n


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_query(spark):
    found, rows = check(spark, spark.read.parquet(f"{SMALL}/documents.parquet"))
    text = {i: t for i, t, _ in rows}
    by_print: dict = {}
    for r in found:
        by_print.setdefault(text[r.doc_id], set()).add(r.fingerprint)
        if r.n_chars >= 400:
            assert r.near_edited >= 0.6 and (r.near_edited > r.near_next or r.near_next >= 0.6)
    assert all(len(s) == 1 for s in by_print.values())
    assert sorted(r.doc_id for r in catalog.op13_prefix_fingerprints(spark, SMALL).select("doc_id").collect()) == sorted(text)
