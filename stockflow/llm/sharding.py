"""Hierarchical weighted hash tree: documents descend region, rack and shard.

At each level every child draws for the document: the logarithm of a hash of (path of the
child, key) as a fraction, over the child's weight, and the greatest draw wins. A child wins in
proportion to its weight. A change of weights below one node changes that node's draw alone, so
documents move only into subtrees whose weight grows and out of those whose weight shrinks. The
weight of a node is the sum of its shards' weights.

All of it is column expressions: no shuffle for the placement, and Python nowhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096  # of slot numbering, in every shard


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(n_shards: int, base: int = 8, racks: int = 2, shards_per_rack: int = 2) -> list[Leaf]:
    """Shards of which the first ``base`` (at most all) fill regions of ``racks`` x ``shards_per_rack``.

    Shards that would fill a region in part, and all further ones, are regions of their own. So a
    tree grows by one with the ``base`` it began with, and documents move only into the new shard.
    """
    per_region = racks * shards_per_rack
    filled = min(base, n_shards) // per_region * per_region
    leaves = []
    for shard in range(n_shards):
        if shard < filled:
            region, inside = divmod(shard, per_region)
            leaves.append(Leaf(f"r{region}", f"k{inside // shards_per_rack}", shard))
        else:
            leaves.append(Leaf(f"x{shard}", "k0", shard))
    return leaves


def grown(leaves: Sequence[Leaf]) -> list[Leaf]:
    """``leaves`` and one more, a region of its own, with the next number and the average weight.

    No weight of the given tree changes, so documents move only into the new shard.
    """
    shard = max(leaf.shard for leaf in leaves) + 1
    taken = {leaf.region for leaf in leaves}
    region = f"x{shard}"
    while region in taken:
        region += "x"
    weights = [leaf.weight for leaf in leaves if leaf.weight > 0]
    return [*leaves, Leaf(region, "k0", shard, sum(weights) / len(weights))]


def _draw(key: Column, path: str, weight: float) -> Column:
    """The logarithm of a fraction in (0, 1) made of 48 bits of a hash, over the weight."""
    digest = F.md5(F.concat(F.lit(path + ":"), key).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
    return F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 48))) / F.lit(float(weight))


def _winner(key: Column, children: Sequence[tuple[str, float, Column]]) -> Column:
    """The value of the child with the greatest draw; the greatest value among equal draws."""
    if len(children) == 1:
        return children[0][2]
    draws = [F.struct(_draw(key, path, weight).alias("draw"), value.alias("value")) for path, weight, value in children]
    return F.greatest(*draws)["value"]


def _children(leaves: Sequence[Leaf], name: str) -> dict[str, list[Leaf]]:
    out: dict[str, list[Leaf]] = {}
    for leaf in leaves:
        if leaf.weight > 0:
            out.setdefault(getattr(leaf, name), []).append(leaf)
    return out


def _weight(leaves: Sequence[Leaf]) -> float:
    return sum(leaf.weight for leaf in leaves)


def place(docs: DataFrame, leaves: Sequence[Leaf], key: str = "doc_id", prefix: str = "") -> DataFrame:
    """``docs`` with region, rack and shard (after ``prefix``), from the key and the tree alone.

    A null key counts as the empty text. Equal keys share a shard. Columns of these names are
    replaced; all else passes through, so extra columns, nulls and repeated rows do no harm.
    """
    regions = _children(leaves, "region")
    if not regions:
        raise ValueError("no shard has a weight")
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    names = [prefix + c for c in ("region", "rack", "shard")]
    out = docs.withColumn(names[0], _winner(text, [(r, _weight(x), F.lit(r)) for r, x in sorted(regions.items())]))
    rack, shard = F.lit(None).cast("string"), F.lit(None).cast("int")
    for region, inner in sorted(regions.items()):
        racks = _children(inner, "rack")
        here = F.col(names[0]) == region
        paths = [(f"{region}/{k}", _weight(x), F.lit(k)) for k, x in sorted(racks.items())]
        rack = F.when(here, _winner(text, paths)).otherwise(rack)
    out = out.withColumn(names[1], rack)
    for region, inner in sorted(regions.items()):
        for rack_name, last in sorted(_children(inner, "rack").items()):
            here = (F.col(names[0]) == region) & (F.col(names[1]) == rack_name)
            paths = [(f"{region}/{rack_name}/{x.shard}", x.weight, F.lit(x.shard)) for x in last]
            shard = F.when(here, _winner(text, paths)).otherwise(shard)
    return out.withColumn(names[2], shard)


def number_slots(placed: DataFrame, order: Sequence[str], n: str, buckets: int = BUCKETS) -> DataFrame:
    """Add ``slot``, the first of the ``n`` consecutive numbers that a row takes in its shard.

    A shard's rows are dealt to a fixed number of buckets by a hash of ``order`` and numbered
    there; the sizes of the buckets before, at most shards x ``buckets`` rows, are added. No
    task holds a whole shard.
    """
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])
    keyed = placed.withColumn("bucket_", F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets)))
    sums = keyed.groupBy("shard", "bucket_").agg(F.sum(n).alias("size_"))
    before = Window.partitionBy("shard").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "bucket_", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("ahead_"))
    inside = Window.partitionBy("shard", "bucket_").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = keyed.withColumn("inside_", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    joined = own.join(F.broadcast(sums), ["shard", "bucket_"])  # at most shards x buckets rows
    return joined.withColumn("slot", F.col("ahead_") + F.col("inside_")).drop("bucket_", "ahead_", "inside_")


def shard_documents(
    docs: DataFrame,
    n_shards: int = 8,
    id_column: str = "doc_id",
    text: str = "text",
    leaves: Sequence[Leaf] | None = None,
    base: int = 8,
) -> DataFrame:
    """doc_id, size, text_crc32, law, region, rack, shard, slot and grown_shard of every row.

    The tree is ``leaves``, or ``n_shards`` shards of which ``base`` were there at first.

    ``size`` is the text's bytes (null: none) plus 1. Rows that are the same in id, size and
    checksum are counted before anything moves and get consecutive slots. ``grown_shard`` is
    the shard with one more shard in that tree. An empty table gives no rows.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
    )
    counted = slim.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n_"))
    leaves = leaves or tree(n_shards, base)
    placed = place(counted, leaves)
    numbered = number_slots(placed, ["doc_id", "size", "text_crc32"], "n_")
    both = place(numbered, grown(leaves), prefix="grown_")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_") - 1)).alias("copy_")
    return both.select("*", each).select(
        F.col("doc_id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "region",
        "rack",
        "shard",
        (F.col("slot") + F.col("copy_")).alias("slot"),
        "grown_shard",
    )
