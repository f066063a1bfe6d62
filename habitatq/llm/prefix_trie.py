"""Prefix trie of conversations: which beginnings are shared, by how many, and what sharing them saves.

Conversations are rebuilt first: number c begins with the first h original turns of conversation c - c % 5
and goes on with its own turns after its first h, h being the CRC-32 of c's decimal digits modulo 9. A node of
the trie is a distinct sequence of d first turns (role, text); its totals over its subtree come from parallel
tree contraction (``contraction``), so neither a very long conversation nor a crowd of copies is held in one task.

Turns are put in order by one range shuffle on conversation, turn and digest, without their texts, and numbered
by place in the partition plus what earlier partitions have of the conversation. A prefix is known by the
exclusive or of two 64-bit hashes of each (turn, position), summed up in blocks of 4,096 turns and over blocks.

Defined cases: rows without conv_id are left out; a null turn comes first, equal turns of one conversation go by the
MD5 of role and text; a null role or text is empty; repeated rows are turns of their own; an absent conversation
lends no turns; an empty table has no node, not even a root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitatq.llm import contraction
from habitatq.sources.tables import stored

#: Conversations that share a lender, and the modulus of the number of lent turns.
GROUP, LENT = 5, 9
_BLOCK = 4096
_PLACE = (1 << 33) - 1
_PIECE = 1 << 16


def lender(c: Column) -> Column:
    return c - c % GROUP


def lent_turns(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % LENT


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, ordinal, key, size, n_turns``: each turn's place from 1, a digest of role and text, UTF-8 bytes of the text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(" "), role, text).cast("binary")).alias("key"),
        F.octet_length(text).cast("long").alias("size"),
    ).filter("conv_id IS NOT NULL").withColumn("place", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "key", "place"]
    at = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = stored(at.select("conv_id", "key", "size", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(_PLACE).alias("at")), "turns")
    runs = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    own = Window.partitionBy("conv_id")
    earlier = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = runs.select("conv_id", "part", (earlier - F.col("first") + 1).alias("shift"), F.sum("n").over(own).alias("n_turns"))
    return placed.join(offsets, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("ordinal"), "key", "size", "n_turns")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``conv_id, depth, key, size, n_turns``, ``conv_id, n_turns``): turns of the rebuilt conversations, and their lengths (0 too)."""
    turns = stored(ordered_turns(conversations), "ordered")
    c, h, n = F.col("conv_id"), F.col("h"), F.col("n_turns")
    sizes = turns.filter("ordinal = 1").select("conv_id", "n_turns")
    lenders = sizes.select(c.alias("lender"), n.alias("has"))
    plan = sizes.withColumns({"lender": lender(c), "h": lent_turns(c)}).join(lenders, "lender", "left")
    plan = plan.withColumn("lent", F.least("h", F.coalesce("has", F.lit(0))))
    plan = stored(plan.select("conv_id", "lender", "h", "lent", (F.col("lent") + F.greatest(n - h, F.lit(0))).alias("length")), "rebuilding")
    # A conversation's own turns need only whether its lender has fewer than h turns: a few short lenders, not a join of all turns.
    short = plan.filter("lent < h").select("conv_id", F.col("lent").alias("short_lent"))
    rest = turns.withColumn("h", lent_turns(c)).filter("ordinal > h").join(short, "conv_id", "left")
    lent = F.coalesce("short_lent", "h")
    kept = rest.select("conv_id", (F.col("ordinal") - h + lent).alias("depth"), "key", "size", (n - h + lent).alias("n_turns"))
    heads = turns.filter((F.col("ordinal") < LENT) & (c % GROUP == 0)).select(c.alias("lender"), "ordinal", "key", "size")
    begun = heads.join(plan, "lender").filter("ordinal <= h").select(
        "conv_id", F.col("ordinal").alias("depth"), "key", "size", F.col("length").alias("n_turns"))
    return kept.unionByName(begun), plan.select("conv_id", F.col("length").alias("n_turns"))


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with the two hashes of the sequence up to each turn (``a, b``) and before it (``up_a, up_b``)."""
    hashed = turns.withColumns({
        "one": F.xxhash64("key", "depth"), "two": F.xxhash64("depth", "key"), "block": F.floor((F.col("depth") - 1) / _BLOCK),
    })
    block = Window.partitionBy("conv_id", "block")
    so_far = block.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = hashed.withColumns({"a": F.bit_xor("one").over(so_far), "b": F.bit_xor("two").over(so_far)})
    blocks = hashed.groupBy("conv_id", "block").agg(F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", F.bit_xor("one").over(before).alias("c_one"), F.bit_xor("two").over(before).alias("c_two"))
    carried = carried.filter("block > 0")  # of most conversations there is no second block
    zero = F.lit(0).cast("long")
    out = inside.join(carried, ["conv_id", "block"], "left").withColumns({
        "a": F.col("a").bitwiseXOR(F.coalesce("c_one", zero)), "b": F.col("b").bitwiseXOR(F.coalesce("c_two", zero)),
    })
    return out.withColumns({"up_a": F.col("a").bitwiseXOR(F.col("one")), "up_b": F.col("b").bitwiseXOR(F.col("two"))}).select(
        "conv_id", "depth", "size", "n_turns", "a", "b", "up_a", "up_b")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node inside a sorted partition; of its first and last node the pieces to be hashed."""
    def rows(nodes: list, levels: list, parts: list, numbers: list, pieces: list, digests: list) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array(nodes, pa.int64()), pa.array(levels, pa.int64()), pa.array(parts, pa.int64()), pa.array(numbers, pa.int64()),
             pa.array(pieces, pa.string()), pa.array(digests, pa.string())],
            names=["node", "level", "part", "number", "piece", "digest"])

    def cut(node: tuple, part: int, ids: list, number: int) -> pa.RecordBatch:
        return rows([node[0]], [node[1]], [part], [number], [",".join(map(str, ids))], [None])

    now, ids, first, number, part = None, [], True, 0, 0
    for b in batches:
        done: tuple[list, list, list] = ([], [], [])
        for node, level, conv, part in zip(*(b.column(k).to_pylist() for k in ("node", "level", "conv_id", "part"))):
            if now != (node, level):
                if now is not None and first:
                    yield cut(now, part, ids, number)
                elif now is not None:
                    text = ",".join(map(str, ids))
                    for column, value in zip(done, (*now, hashlib.sha256(text.encode()).hexdigest())):
                        column.append(value)
                first, now, ids, number = now is None, (node, level), [], 0
            ids.append(conv)
            if first and len(ids) == _PIECE:  # only the first node of a partition can be continued from another
                yield cut(now, part, ids, number)
                ids, number = [], number + 1
        if done[0]:
            n = len(done[0])
            yield rows(done[0], done[1], [part] * n, [0] * n, [None] * n, done[2])
    if now is not None and ids:
        for a in range(0, len(ids), _PIECE):
            yield cut(now, part, ids[a : a + _PIECE], number + a // _PIECE)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, sorted by partition and number."""
    now, state = None, hashlib.sha256()
    for b in batches:
        done: tuple[list, list, list] = ([], [], [])
        for node, level, piece in zip(*(b.column(k).to_pylist() for k in ("node", "level", "piece"))):
            if now != (node, level):
                if now is not None:
                    for column, value in zip(done, (*now, state.hexdigest())):
                        column.append(value)
                now, state = (node, level), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        yield pa.record_batch([pa.array(x, t) for x, t in zip(done, (pa.int64(), pa.int64(), pa.string()))], names=["node", "level", "digest"])
    if now is not None:
        yield pa.record_batch([pa.array([x]) for x in (*now, state.hexdigest())], names=["node", "level", "digest"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``node, level, digest``: SHA-256 of the ascending, comma-joined ``conv_id`` of each node. ``ends`` is read twice.

    Rows are sorted over all partitions; a node that reaches over a border is put together from pieces of
    at most 65,536 ids, hashed one after the other, so not even the ends of all conversations are held at once.
    """
    order = ["node", "level", "conv_id"]
    sorted_ends = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    cut = sorted_ends.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(
        _digests, "node long, level long, part long, number long, piece string, digest string")
    cut = stored(cut, "digests")
    pieces = cut.filter("piece IS NOT NULL").repartition("node", "level").sortWithinPartitions("node", "level", "part", "number")
    return cut.filter("piece IS NULL").select("node", "level", "digest").unionByName(
        pieces.select("node", "level", "piece").mapInArrow(_joined, "node long, level long, digest string"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` of the subtree, and ``ends_sha256`` of the conversations that end there."""
    turns, lengths = rebuilt(conversations)
    turns, zero = stored(prefixes(turns), "prefixes"), F.lit(0).cast("long")
    root = lengths.agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("a"), zero.alias("b"), zero.alias("level"), "node", "n_convs", zero.alias("size"), *(F.lit(None).cast("long").alias(x) for x in ("up_a", "up_b")))
    nodes = turns.groupBy("a", "b", F.col("depth").alias("level")).agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.min("size").alias("size"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"))
    nodes = stored(nodes.unionByName(root), "nodes")
    above = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("level").alias("up_level"), F.col("node").alias("up_node"))
    tree = nodes.withColumn("up_level", F.when(F.col("level") > 0, F.col("level") - 1)).join(above, ["up_a", "up_b", "up_level"], "left")
    tree = stored(tree.select("a", "b", "node", "level", "up_node", "up_level", "n_convs", ((F.col("n_convs") - 1) * F.col("size")).alias("saved")), "tree")
    children = tree.filter("up_node IS NOT NULL").groupBy(F.col("up_node").alias("node"), F.col("up_level").alias("level")).agg(
        F.count("*").alias("kids"), F.bit_xor("node").alias("kid_node"), F.bit_xor("level").alias("kid_level"))
    filled = tree.join(children, ["node", "level"], "left").fillna(0, ["kids", "kid_node", "kid_level"])
    filled = stored(filled.withColumn("leaves", (F.col("kids") == 0).cast("long")), "forest")
    totals = contraction.subtree_totals(filled, ["leaves", "saved"])
    last = turns.filter("depth = n_turns").select("conv_id", "a", "b", F.col("depth").alias("level")).unionByName(
        lengths.filter("n_turns = 0").select("conv_id", zero.alias("a"), zero.alias("b"), zero.alias("level")))
    ends = stored(last.join(tree.select("a", "b", "level", "node"), ["a", "b", "level"]).select("node", "level", "conv_id"), "ends")
    facts = filled.select("node", "level", "up_node", "n_convs", "kids")
    return facts.join(totals, ["node", "level"]).join(end_digests(ends), ["node", "level"], "left").select(
        F.col("node").alias("conv_id"), F.col("level").alias("depth"), F.col("up_node").alias("parent_conv_id"), "n_convs",
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
