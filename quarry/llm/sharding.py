"""Sharding by a hierarchical weighted hash tree (native).

A key descends region, rack and shard: at each level every child draws -ln(u) / weight from a hash
of (key, child) and the least draw wins, so a child gets rows in proportion to its weight, and a
change of one weight moves rows only into or out of the subtrees whose weights change.  Growth by
one shard adds a region of its own, so rows move only into the new shard.

Defined cases: null keys hash as the text "null"; null text has no bytes; equal keys go to one
shard; rows alike in doc_id, size and crc may swap slots, which no column shows; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank

#: {region: {rack: {shard: weight}}}
Tree = dict[str, dict[str, dict[int, float]]]
EIGHT: Tree = {
    "region0": {"rack0": {0: 1.0, 1: 1.0}, "rack1": {2: 1.0, 3: 1.0}},
    "region1": {"rack2": {4: 1.0, 5: 1.0}, "rack3": {6: 1.0, 7: 1.0}},
}
NINE: Tree = EIGHT | {"region2": {"rack4": {8: 1.0}}}


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _draw(key: Column, child: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from 53 bits of the hash of key and child."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(weight)


def _descend(key: Column, node: dict, path: str) -> Column:
    """The shard under node: the child with the least draw, the first in order on a tie."""
    children = [(name, child, _weight(child)) for name, child in node.items() if _weight(child) > 0]
    if not children:
        raise ValueError(f"no weight under {path or 'the tree'}")
    below = lambda name, child: _descend(key, child, f"{path}/{name}") if isinstance(child, dict) else F.lit(int(name))
    if len(children) == 1:
        return below(*children[0][:2])
    draws = [_draw(key, f"{path}/{name}", w) for name, _, w in children]
    least = F.least(*draws)
    out = below(*children[-1][:2])
    for (name, child, _), draw in list(zip(children, draws))[-2::-1]:
        out = F.when(draw == least, below(name, child)).otherwise(out)
    return out


def assign_shard(key: Column, tree: Tree = EIGHT) -> Column:
    """The shard number of a key under a tree of weights."""
    return _descend(F.coalesce(key.cast("string"), F.lit("null")), tree, "").cast("int")


def op6(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        assign_shard(F.col("doc_id")).alias("shard"),
        assign_shard(F.col("doc_id"), NINE).alias("grown_shard"),
    )
    ranked = gapless_rank(rows, "shard", ["doc_id", "size", "text_crc32"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
