"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A row descends region, rack and shard.  On each level every child draws ln(u) / weight, u in
(0, 1) from a hash of child and row key, and the largest draw wins, so a child gets rows in
proportion to its weight and the draws of the other children never change with it.  If a
weight changes, rows move only between that node's subtree and its siblings, on its path; a
shard added as a region of its own takes rows only into itself.

Slots number the rows of a shard from 0 without gaps, in the order of a hash of the key, then key,
CRC and size.  Equal rows are counted first, in chunks of at most ``RANGE_ROWS``; the chunks are range
partitioned in that order and numbered by prefix sums, and each then gives its rows' slots.  So
neither a shard nor a key that many rows share, equal or not, is ever sorted in one task.

Defined cases: a null text has no bytes and CRC 0; rows without key are placed like the empty
string; rows of equal key share a shard and their slots follow in the order of CRC and size;
an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.operators.common import prefix_sums

RANGE_ROWS = 4096


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def uniform_tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """Shards 0 to n-1 of equal weight, in racks and regions filled in order."""
    return [Leaf(f"g{s // (per_rack * racks)}", f"g{s // (per_rack * racks)}.r{s // per_rack}", s) for s in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """``tree`` with one more shard, in a new region of its own."""
    s = max(x.shard for x in tree) + 1
    return [*tree, Leaf(f"new{s}", f"new{s}.r", s, weight)]


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def draw(name: Column, key: Column, weight: Column) -> Column:
    u = F.conv(F.substring(F.md5(F.concat(name, F.lit("|"), key_text(key))), 1, 13), 16, 10).cast("double")
    return F.log((u + 0.5) / float(16 ** 13)) / weight


def place(key: Column, tree: list[Leaf]) -> Column:
    """The shard of ``key``."""
    weights: dict[tuple, float] = {}
    for x in tree:
        if x.weight <= 0:
            raise ValueError("weights must be positive")
        for node in (("", x.region), (x.region, x.rack), (x.rack, str(x.shard))):
            weights[node] = weights.get(node, 0.0) + x.weight

    def children(parent: str) -> Column:
        return F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight"))
                         for (p, c), w in sorted(weights.items()) if p == parent])

    at = F.lit("")
    for level in ([""], sorted({x.region for x in tree}), sorted({x.rack for x in tree})):
        below = F.create_map(*[y for p in level for y in (F.lit(p), children(p))])
        drawn = F.transform(F.element_at(below, at), lambda c: F.struct(draw(c["name"], key, c["weight"]), c["name"]))
        at = F.array_max(drawn)["name"]
    return at.cast("int")


def assign(docs: DataFrame, tree: list[Leaf], grown_tree: list[Leaf] | None = None, text: str = "text",
           key: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) for every row."""
    k, t = F.col(key), F.col(text)
    same = docs.select(
        k.alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(t), F.lit(0)).cast("long").alias("text_crc32")) \
        .groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_copies"))
    chunks = same.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {RANGE_ROWS}L")))) \
        .withColumn("_n", F.least(F.lit(RANGE_ROWS).cast("long"), F.col("_copies") - F.col("_chunk") * RANGE_ROWS))
    own = F.col("doc_id")
    rows = chunks.select(
        "doc_id", "size", "text_crc32", "_n", place(own, tree).alias("shard"),
        (place(own, grown_tree) if grown_tree else F.lit(None).cast("int")).alias("grown_shard"),
        F.struct(F.conv(F.substring(F.md5(key_text(own)), 1, 8), 16, 10).cast("long"), own, "text_crc32", "size", "_chunk").alias("_order"))
    numbered = prefix_sums(rows, ["shard"], "_order", {"_first": F.col("_n")})
    return numbered.select("doc_id", "size", "text_crc32", "shard",
                           F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("slot"), "grown_shard")
