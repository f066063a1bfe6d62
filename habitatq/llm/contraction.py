"""Subtree totals of a forest by parallel tree contraction.

Rounds of two joins each: *rake* takes all leaves off and adds their totals to their parents; *compress*
takes nodes with one child out of their chains, where a node goes if it comes before both its neighbours in
a fixed order (trailing zeros of the depth, then a hash, then the id), so no two neighbours go at once and a
plain chain halves each round. What lies on a bypassed path is kept as the weight of the new edge. When only
roots are left, the rounds are undone backwards: a node taken out of a chain gets its own sum plus that of
its child, known by then. Tables shrink by a constant share a round, whatever the depth of the forest.

A node knows how many children it has left and the exclusive or of their ids, which is the child's id once
one is left. Messages to one node are combined before the shuffle, so a node with very many children costs
no more than any other. Each round is written to the shared folder and read back, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitatq.sources.tables import stored


def _order(node: str, level: str) -> Column:
    """A total order of nodes in which, along a chain, every other one comes before its neighbours."""
    c, d = F.col(node), F.col(level)
    ruler = F.bit_count(d.bitwiseAND(-d) - 1)
    return F.struct(ruler.cast("int").alias("r"), F.xxhash64(c, d).alias("h"), c.alias("c"), d.alias("d"))


def _goes() -> Column:
    only = (F.col("kids") == 1) & F.col("up_node").isNotNull()
    me = _order("node", "level")
    return only & (me < _order("up_node", "up_level")) & (me < _order("kid_node", "kid_level"))


def _plus(column: str, more: str) -> Column:
    return (F.col(column) + F.coalesce(more, F.lit(0))).alias(column)


def _rake(state: DataFrame, values: list[str]) -> DataFrame:
    sums = [F.sum(F.col(v) + F.col(f"edge_{v}")).alias(f"more_{v}") for v in values]
    gone = (
        state.filter("kids = 0 AND up_node IS NOT NULL").groupBy(F.col("up_node").alias("node"), F.col("up_level").alias("level"))
        .agg(*sums, F.count("*").alias("fewer"), F.bit_xor("node").alias("x_node"), F.bit_xor("level").alias("x_level"))
    )
    zero = F.lit(0).cast("long")
    return state.filter("kids > 0 OR up_node IS NULL").join(gone, ["node", "level"], "left").select(
        "node", "level", "up_node", "up_level", *(_plus(v, f"more_{v}") for v in values), *(f"edge_{v}" for v in values),
        (F.col("kids") - F.coalesce("fewer", zero)).alias("kids"),
        F.col("kid_node").bitwiseXOR(F.coalesce("x_node", zero)).alias("kid_node"),
        F.col("kid_level").bitwiseXOR(F.coalesce("x_level", zero)).alias("kid_level"),
    )


def _compress(state: DataFrame, values: list[str]) -> DataFrame:
    """The nodes that stay; a child of one that went has that one in ``out_node``, ``out_level`` and what it lacks in ``out_*``."""
    goes, none = _goes(), F.lit(None).cast("long")
    fields = ["node", "level", "x_node", "x_level", "new_node", "new_level", "out_node", "out_level"]
    fields += [f"{kind}_{v}" for kind in ("path", "sum") for v in values]

    def message(**known: Column) -> Column:
        return F.struct(*(known.get(f, none).alias(f) for f in fields))

    c = F.col
    to_child = message(
        node=c("kid_node"), level=c("kid_level"), new_node=c("up_node"), new_level=c("up_level"), out_node=c("node"), out_level=c("level"),
        **{f"path_{v}": c(v) + c(f"edge_{v}") for v in values}, **{f"sum_{v}": c(v) for v in values},
    )
    to_parent = message(
        node=c("up_node"), level=c("up_level"), x_node=c("node").bitwiseXOR(c("kid_node")), x_level=c("level").bitwiseXOR(c("kid_level"))
    )
    sent = state.filter(goes).select(F.inline(F.array(to_child, to_parent)))
    met = sent.groupBy("node", "level").agg(
        F.bit_xor("x_node").alias("x_node"), F.bit_xor("x_level").alias("x_level"), *(F.max(f).alias(f) for f in fields[4:])
    )
    zero = F.lit(0).cast("long")
    return state.filter(~F.coalesce(goes, F.lit(False))).join(met, ["node", "level"], "left").select(
        "node", "level", F.coalesce("new_node", "up_node").alias("up_node"), F.coalesce("new_level", "up_level").alias("up_level"),
        *values, *(_plus(f"edge_{v}", f"path_{v}") for v in values), "kids",
        F.col("kid_node").bitwiseXOR(F.coalesce("x_node", zero)).alias("kid_node"),
        F.col("kid_level").bitwiseXOR(F.coalesce("x_level", zero)).alias("kid_level"),
        "out_node", "out_level", *((F.col(f"sum_{v}") + F.col(f"edge_{v}")).alias(f"out_{v}") for v in values),
    )


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``node, level`` and the total of each of ``values`` over the subtree of every node, its own included.

    ``nodes`` has ``node, level`` (together unique), ``up_node, up_level`` of the parent (null for a root; a
    parent's level is smaller), ``kids`` and the exclusive or of the children's ids, ``kid_node, kid_level``
    (0 without children), and the values, all long and not null. It is read several times.
    """
    state = nodes.select(
        "node", "level", "up_node", "up_level", *values, *(F.lit(0).cast("long").alias(f"edge_{v}") for v in values), "kids", "kid_node", "kid_level"
    )
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while state.filter("up_node IS NOT NULL").limit(1).count():
        raked = stored(_rake(state, values), "raked")
        compressed = stored(_compress(raked, values), "compressed")
        rounds.append((state, compressed))
        state = compressed
    known = state.select("node", "level", *values)
    for before, after in reversed(rounds):
        leaves = before.filter("kids = 0 AND up_node IS NOT NULL").select("node", "level", *values)
        out = after.filter("out_node IS NOT NULL").select("node", "level", "out_node", "out_level", *(f"out_{v}" for v in values))
        back = out.join(known, ["node", "level"]).select(
            F.col("out_node").alias("node"), F.col("out_level").alias("level"), *((F.col(v) + F.col(f"out_{v}")).alias(v) for v in values)
        )
        known = stored(known.unionByName(leaves).unionByName(back), "totals")
    return known
