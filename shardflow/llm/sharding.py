"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks in regions and shards in racks.  A key descends it: at each
node every child draws ``-ln(u) / weight``, where ``u`` is a uniform number made of the
key and the child's name, and the smallest draw wins.  A child therefore gets a share of
its weight, and if one child's weight grows, keys move into that child only: movement
stays in the subtrees whose weights change.  A node's weight is that of its shards.

The law held is ``key``: doc_id and the tree decide.  ``Tree.grown`` opens a region of
its own for the added shard.  No other node's weight changes then, so that every row
that moves goes to the added shard.  (A shard added to an existing rack would draw rows
into its region and rack, where some would settle on its neighbours.)

All is SQL functions: no Python runs on the executors.  Slots number the rows of a shard
without gaps.  A shard's rows are first dealt to ``buckets`` by hash, each bucket is
numbered alone, and the counts of the buckets before it are added, so that no task sorts
a whole shard.

Defined cases: a null doc_id is the key ``''``; a null text counts as empty; rows of one
doc_id go to one shard and get slots of their own; an empty table gives no rows; a text of
any length is one row; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """``regions[r][k]`` lists the (shard, weight) pairs of rack ``k`` of region ``r``."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def even(shards: int, per_rack: int = 4, racks: int = 3) -> Tree:
        """Shards 0 to ``shards - 1`` of weight 1, filled rack by rack."""
        all_racks = [tuple((s, 1.0) for s in range(i, min(i + per_rack, shards))) for i in range(0, shards, per_rack)]
        return Tree(tuple(tuple(all_racks[i : i + racks]) for i in range(0, len(all_racks), racks)))

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region of its own."""
        shard = 1 + max(s for region in self.regions for rack in region for s, _ in rack)
        return Tree((*self.regions, (((shard, weight),),)))


#: Number in (0, 1) of 52 bits, for the child ``c`` and the key.
_UNIFORM = "(CAST(conv(substr(md5(concat(c.name, ':', {key})), 1, 13), 16, 10) AS DOUBLE) + 0.5D) / 4503599627370496D"


def _weight(node) -> float:
    return node[1] if isinstance(node[0], int) else sum(map(_weight, node))


def _children(nodes: list[tuple[str, float, int]]) -> str:
    return "array(" + ", ".join(f"named_struct('name', '{name}', 'weight', {weight!r}D, 'value', {value})" for name, weight, value in nodes) + ")"


def _drawn(key: str, children: str) -> str:
    """SQL for the value of the child with the smallest draw."""
    return f"array_min(transform({children}, c -> named_struct('draw', -ln({_UNIFORM.format(key=key)}) / c.weight, 'value', c.value))).value"


def nodes_of(tree: Tree) -> list[tuple[str, str, float, int]]:
    """(parent, name, weight, value) of every node below the root; the value of a shard is its number."""
    out = []
    for r, region in enumerate(tree.regions):
        out.append(("", f"r{r}", _weight(region), r))
        for k, rack in enumerate(region):
            out.append((f"r{r}", f"r{r}k{k}", _weight(rack), k))
            out += [(f"r{r}k{k}", f"s{s}", w, s) for s, w in rack]
    return out


def placed(df: DataFrame, tree: Tree, key: str, out: str) -> DataFrame:
    """``df`` with the shard of the string column ``key`` in the column ``out``: one draw at each level."""
    regions = _children([(f"r{r}", _weight(x), r) for r, x in enumerate(tree.regions)])
    numbers = {at: i for i, at in enumerate((r, k) for r, x in enumerate(tree.regions) for k in range(len(x)))}
    racks = ", ".join(_children([(f"r{r}k{k}", _weight(y), numbers[r, k]) for k, y in enumerate(x)]) for r, x in enumerate(tree.regions))
    shards = ", ".join(_children([(f"s{s}", w, s) for s, w in y]) for x in tree.regions for y in x)
    region = _drawn(key, regions)
    rack = _drawn(key, f"element_at(array({racks}), {region} + 1)")
    return df.withColumn(out, F.expr(_drawn(key, f"element_at(array({shards}), {rack} + 1)")).cast("int"))


def _slots(df: DataFrame, counted: DataFrame, shard: str, order: list[Column], out: str) -> DataFrame:
    """Gapless numbers from 0 in each shard.  ``counted`` has the same rows' shard and ``_bucket``; its counts are as many as shards times buckets at most."""
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.groupBy(shard, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order))
    return df.withColumn("_number", number).join(F.broadcast(offsets), [shard, "_bucket"]).withColumn(out, (F.col("_before") + F.col("_number") - 1).cast("long")).drop("_before", "_number", "_bucket")


def shard_documents(docs: DataFrame, tree: Tree, buckets: int = 512) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("_text"), F.crc32(text).alias("text_crc32"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"))
    # The text too, so that many rows of one doc_id, or of none, are no single bucket.
    drawn = F.md5(F.concat(F.lit("slot:"), "_key", F.lit(":"), F.col("text_crc32").cast("string")))
    keyed = keyed.withColumn("_bucket", F.pmod(F.conv(F.substring(drawn, 1, 7), 16, 10).cast("long"), F.lit(buckets)).cast("int"))
    shards = placed(keyed.select("_key", "_bucket"), tree, "_key", "shard")
    sized = keyed.select("doc_id", "_key", "_bucket", (F.octet_length("_text") + 8).cast("long").alias("size"), "text_crc32", F.lit("key").alias("law"))
    whole = placed(placed(sized, tree, "_key", "shard"), tree.grown(), "_key", "grown_shard")
    slotted = _slots(whole, shards, "shard", [F.col("_key"), F.col("size"), F.col("text_crc32")], "slot")
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
