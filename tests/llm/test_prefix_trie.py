"""Tree contraction against a recursive sum, and the trie of conversations against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from habitatq.llm import contraction, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node long, level long, part long, key string, size long"


def forest(rng: random.Random, n: int, chain: float) -> list[tuple[int, int, int | None, int | None]]:
    """(node, level, parent's) of a random tree in which most nodes hang below the newest one when ``chain`` is near 1."""
    out: list[tuple] = [(0, 0, None, None)]
    for k in range(1, n):
        up = out[-1] if rng.random() < chain else rng.choice(out)
        out.append((rng.randrange(5) + 10 * k, up[1] + 1, up[0], up[1]))
    return out


@pytest.mark.parametrize(("n", "chain"), [(1, 0), (2, 0), (60, 0), (300, 0.97), (260, 0.6), (300, 1)])
def test_subtree_totals(spark, n, chain):
    rng = random.Random(n)
    rows = forest(rng, n, chain)
    kids: dict = {}
    for node, level, up, up_level in rows:
        kids.setdefault((up, up_level), []).append((node, level))
    values = {r[:2]: (rng.randrange(9), rng.randrange(10**9)) for r in rows}

    def xor(at, which):
        out = 0
        for kid in kids.get(at, []):
            out ^= kid[which]
        return out

    table = [(*r, *values[r[:2]], len(kids.get(r[:2], [])), xor(r[:2], 0), xor(r[:2], 1)) for r in rows]
    df = spark.createDataFrame(table, "node long, level long, up_node long, up_level long, x long, y long, kids long, kid_node long, kid_level long")
    want: dict = {}
    for r in sorted(rows, key=lambda r: -r[1]):
        below = [want[k] for k in kids.get(r[:2], [])]
        want[r[:2]] = tuple(values[r[:2]][v] + sum(b[v] for b in below) for v in (0, 1))
    got = contraction.subtree_totals(df.repartition(3), ["x", "y"]).collect()
    assert len(got) == len(rows) and {(r.node, r.level): (r.x, r.y) for r in got} == want


def brute(rows: list[tuple]) -> list[tuple]:
    turns: dict = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())} {role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((t is not None, t or 0, key, role, text))
    turns = {c: [x[3:] for x in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        built[c] = tuple(turns.get(lender, [])[:h] + own[h:])
    members: dict = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children: dict = {}
    for seq in members:
        if seq:
            children.setdefault(seq[:-1], []).append(seq)
    leaves, saved, out = {}, {}, []
    for seq in sorted(members, key=len, reverse=True):
        kids = children.get(seq, [])
        leaves[seq] = sum(leaves[k] for k in kids) if kids else 1
        saved[seq] = sum(saved[k] for k in kids) + ((len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0)
        ends = ",".join(str(c) for c in sorted(c for c, s in built.items() if s == seq))
        out.append((min(members[seq]), len(seq), min(members[seq[:-1]]) if seq else None, len(members[seq]), len(kids), leaves[seq], saved[seq],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3, "k", 4) for r in rows], SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=lambda r: r[:2])
    assert got == brute(rows)


def test_trie(spark):
    rng = random.Random(2)
    rows = []
    for c in rng.sample(range(-20, 200), 120):
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["", "a", "é", None, "hello " * 9])) for t in range(rng.choice([1, 2, 8, 9, 12]))]
    rows += [(c, t, "user", f"the same {t}") for c in range(300, 360) for t in range(3)]  # a group of copies
    rows += [(1000, t // 3, "user", "b" * (t % 7)) for t in range(600)]  # a long chain with ties in turn
    rows += [(1001, None, None, None), (1001, None, "user", "x"), (1001, 4, "user", "x"), (1001, 4, "user", "x")]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None), (2003, 0, "user", "y" * 200_000), (-7, -3, "a\nb", "c"), (-8, -3, "a", "b\nc")]
    rng.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(7, 1, "user", "x")], [(None, 1, "user", "x")], [(5, None, None, None)]])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_blocks_and_borders(spark, monkeypatch):
    """Sequences longer than a block of hashes, and one node whose ends reach over several partitions and pieces."""
    monkeypatch.setattr(prefix_trie, "_BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "_PIECE", 3)
    rows = [(c, t, "u", "same" if t < 30 else f"{c} {t}") for c in (5, 10, 15, 20) for t in range(41)]
    rows += [(c, t, "u", "copy") for c in range(100, 300, 5) for t in range(2)]
    check(spark, rows)
    ends = spark.range(5000).select(F.lit(3).cast("long").alias("node"), F.lit(1).cast("long").alias("level"), F.col("id").alias("conv_id"))
    got = prefix_trie.end_digests(ends.repartition(8)).collect()
    assert [r.digest for r in got] == [hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()]
