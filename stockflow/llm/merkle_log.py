"""Merkle dataset manifest as a postorder append log.

Every tree (here one per language) is a binary hash tree over its leaves in order; a last run of
one node is hashed alone. Its nodes are appended to a log in completion order: a leaf, then
every parent that it completes; when the leaves end, the unfinished parents on the right edge
follow from the bottom up. With ``m`` leaves appended, 2m - popcount(m) nodes stand in the log,
which gives each node's position in closed form (``log_positions``), and so the addresses of the
siblings that make up a proof, without any pointer.

Builders are aligned: a builder takes ``2**HEIGHT`` consecutive leaves, a whole subtree but for
the last, and writes its part of the log, a segment. The segments' roots are the leaves of the
next tier, until one segment is left; the trees' roots, in the order of their keys, are the
leaves of one more tree. Proofs go the other way: a segment gets the proof of its own root from
the tier above and slices its leaves' siblings out of its log by position. No task holds more
than a segment and its leaves, whatever a tree's size.

Leaves are numbered by a range partitioning and offsets per partition, never by a window over a
tree. Equal leaves (same order key and digest) are counted before they move and numbered as a
run, which is cut at the borders of segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stockflow.llm.common import ship, written

HEIGHT = 12  # levels of a segment
HEX = 64  # a digest's characters


def hashed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.asarray(x, np.uint64)).astype(np.int64)


def log_positions(level: int, index: np.ndarray, n: int) -> np.ndarray:
    """Places in the log of the nodes ``index`` of ``level`` in a tree of ``n`` leaves."""
    index = np.asarray(index, np.int64)
    last = (index + 1) << level  # leaves once the node is complete
    whole = 2 * (last - 1) - popcount(last - 1) + level
    zeros = (n & -n).bit_length() - 1  # levels that n leaves fill
    ragged = 2 * n - n.bit_count() + level - zeros - 1
    return np.where(last <= n, whole, ragged)


def log_size(n: int, height: int) -> int:
    return 2 * n - n.bit_count() + height - ((n & -n).bit_length() - 1)


def append_log(leaves: Sequence[str], height: int) -> list[str]:
    """The nodes of a tree of ``height`` levels over ``leaves`` in completion order."""
    log: list[str] = []
    open_: list[str | None] = [None] * (height + 1)  # the left sibling that waits at each level
    for number, node in enumerate(leaves, 1):
        log.append(node)
        level = 0
        while not number >> level & 1:
            node = hashed(open_[level] + node)
            log.append(node)
            level += 1
        open_[level] = node
    edge, n = None, len(leaves)
    for level in range(height):
        if n >> level & 1:
            edge = hashed(open_[level] + (edge or ""))
            log.append(edge)
        elif edge:
            edge = hashed(edge)
            log.append(edge)
    return log


def siblings(log: str, n: int, height: int, places: np.ndarray) -> list[list[tuple[str, str]]]:
    """For each leaf place the (left, right) siblings from the bottom up, empty where none is."""
    out: list[list[tuple[str, str]]] = [[] for _ in places]
    for level in range(height):
        index = np.asarray(places, np.int64) >> level
        other = index ^ 1
        there = other << level < n
        at = log_positions(level, np.where(there, other, 0), n) * HEX
        for path, k, is_there, p in zip(out, other & 1, there, at, strict=True):
            if not is_there:
                path.append(("", ""))
            elif k:
                path.append(("", log[p : p + HEX]))
            else:
                path.append((log[p : p + HEX], ""))
    return out


def fold(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = hashed(left + leaf + right)
    return leaf


def proof_text(path: Sequence[tuple[str, str]]) -> str:
    return "".join(left + right for left, right in path)


def tree_height(n: int) -> int:
    return (n - 1).bit_length()


def numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` (tree, order columns, n_) with ``start``, the number of the row's first leaf.

    Ranges of (tree, order) are cut by sampling and stored; the leaves of a tree before a range
    are added up from one row per tree and range.
    """
    ranged = leaves.repartitionByRange("tree", *order).withColumn("range_", F.spark_partition_id())
    ranged = written(ranged, "leaf_ranges")
    sums = ranged.groupBy(F.col("tree").alias("t_"), F.col("range_").alias("r_")).agg(F.sum("n_").alias("size_"))
    before = Window.partitionBy("t_").orderBy("r_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("t_", "r_", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("ahead_"))
    inside = Window.partitionBy("tree", "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("inside_", F.coalesce(F.sum("n_").over(inside), F.lit(0)))
    rows = rows.join(sums, (F.col("tree") == F.col("t_")) & (F.col("range_") == F.col("r_")))
    return rows.withColumn("start", F.col("ahead_") + F.col("inside_")).drop("t_", "r_", "range_", "ahead_", "inside_")


def pieces(leaves: DataFrame, height: int) -> DataFrame:
    """Runs of equal leaves cut at the borders of segments: segment, first (in it) and n_."""
    size = 1 << height
    end = F.col("start") + F.col("n_")
    parts = F.sequence(F.shiftright("start", height), F.shiftright(end - 1, height))
    cut = leaves.withColumn("segment", F.explode(parts))
    low = F.greatest(F.col("start"), F.col("segment") * size)
    high = F.least(end, (F.col("segment") + 1) * size)
    return cut.withColumns({"first": (low - F.col("segment") * size).cast("int"), "n_": high - low}).drop("start")


SEGMENT = "tree string, segment long, size long, levels int, log string"


def build_segments(cut: DataFrame, sizes: DataFrame, height: int) -> DataFrame:
    """One row per builder: its leaf count, levels and log. ``sizes`` has tree and leaves (of it)."""

    arrow = to_arrow_schema(StructType.fromDDL(SEGMENT))

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table[c].to_pylist() for c in ("first", "n_", "leaf")], strict=True))
        leaves = [leaf for _, n, leaf in rows for _ in range(n)]
        total = table["leaves"][0].as_py()
        levels = height if total > 1 << height else tree_height(total)
        log = "".join(append_log(leaves, levels))
        head = [table["tree"][0].as_py(), table["segment"][0].as_py()]
        return pa.Table.from_pylist([dict(zip(arrow.names, [*head, len(leaves), levels, log], strict=True))], arrow)

    ship(cut.sparkSession)
    given = sizes.select(F.col("tree").alias("t_"), "leaves")
    rows = cut.select("tree", "segment", "first", "n_", "leaf").join(given, F.col("tree") == F.col("t_")).drop("t_")
    return rows.groupBy("tree", "segment").applyInArrow(build, SEGMENT)


def root_of(log: str = "log") -> Column:
    return F.substring(log, -HEX, HEX)


#: A proof travels as one text: for each level a mark (L, R or -) and the sibling, if any.
def packed(path: Sequence[tuple[str, str]]) -> str:
    return "".join("L" + a if a else "R" + b if b else "-" for a, b in path)


def unpacked(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        mark = text[at]
        digest = "" if mark == "-" else text[at + 1 : at + 1 + HEX]
        out.append((digest, "") if mark == "L" else ("", digest))
        at += 1 + len(digest)
    return out


def extract(cut: DataFrame, segments: DataFrame, height: int, columns: Sequence[str]) -> DataFrame:
    """Every leaf of ``cut`` with its proof up to the last root.

    ``segments`` carries subroot, root and the proof of the segment's own root (``up``). The
    passed ``columns`` stay; ``place`` is the leaf's number in its tree.
    """
    kept = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in columns)
    schema = "tree string, place long, leaf string, subroot string, root string, proof string, " + kept
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        [segment] = right.to_pylist()
        log, n = segment["log"], segment["size"]
        repeats = left["n_"].to_numpy()
        row = np.repeat(np.arange(left.num_rows), repeats)
        ahead = np.arange(len(row)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
        places = left["first"].to_numpy().astype(np.int64)[row] + ahead
        leaf_at = log_positions(0, places, n) * HEX
        made = {c: left[c].combine_chunks().take(pa.array(row)) for c in columns}
        made |= {c: [segment[c]] * len(row) for c in ("tree", "subroot", "root")}
        made["place"] = (segment["segment"] << height) + places
        made["leaf"] = [log[p : p + HEX] for p in leaf_at]
        made["proof"] = [packed(p) + segment["up"] for p in siblings(log, n, segment["levels"], places)]
        return pa.Table.from_pydict(made, schema=arrow)

    ship(cut.sparkSession)
    return cut.groupBy("tree", "segment").cogroup(segments.groupBy("tree", "segment")).applyInArrow(prove, schema)


def prove(
    leaves: DataFrame,
    order: Sequence[str],
    keep: Sequence[str],
    height: int = HEIGHT,
    above: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Every leaf with its proof: tree, place, leaf, subroot (its tree's), root, proof and ``keep``.

    ``leaves`` has tree (a text, never null), ``leaf``, the ``order`` columns and ``n_`` equal
    leaves. ``above`` turns the trees' roots (tree, leaf) into subroot, root and ``up``, the
    proof beyond the tree's root; without it a tree's root is the last.
    """
    cut = written(pieces(numbered(leaves, order), height), "leaf_pieces")
    sizes = written(cut.groupBy("tree").agg(F.sum("n_").alias("leaves")), "tree_sizes")
    tiers = []
    while True:
        segments = written(build_segments(cut, sizes, height), "log_segments")
        tiers.append((cut, segments))
        most = sizes.agg(F.max("leaves")).first()[0] or 0
        if most <= 1 << height:
            break
        cut = segments.select(
            "tree",
            F.shiftright("segment", height).alias("segment"),
            F.col("segment").bitwiseAND((1 << height) - 1).cast("int").alias("first"),
            F.lit(1).cast("long").alias("n_"),
            root_of().alias("leaf"),
            F.col("segment").alias("child"),
        )
        sizes = sizes.select("tree", F.shiftright(F.col("leaves") + ((1 << height) - 1), height).alias("leaves"))
    roots = segments.select("tree", root_of().alias("leaf"))
    if above is None:
        ups = roots.select("tree", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.lit("").alias("up"))
    else:
        ups = above(roots)
    ups = ups.withColumn("segment", F.lit(0).cast("long"))
    while True:
        cut, segments = tiers.pop()
        proved = extract(cut, segments.join(ups, ["tree", "segment"]), height, ["child"] if tiers else keep)
        if not tiers:
            return proved
        ups = proved.select("tree", F.col("child").alias("segment"), "subroot", "root", F.col("proof").alias("up"))
        ups = written(ups, "segment_proofs")


def prove_under_one_root(leaves: DataFrame, order: Sequence[str], keep: Sequence[str], height: int = HEIGHT) -> DataFrame:
    """``prove``, with the trees' roots, in the order of their keys, as leaves of one more tree."""

    def above(roots: DataFrame) -> DataFrame:
        subroots = roots.select(F.lit("").alias("tree"), F.col("tree").alias("key_"), "leaf", F.lit(1).cast("long").alias("n_"))
        top = prove(subroots, ["key_"], ["key_"], height)
        ups = top.select(F.col("key_").alias("tree"), F.col("leaf").alias("subroot"), "root", F.col("proof").alias("up"))
        return written(ups, "root_proofs")

    return prove(leaves, order, keep, height, above)


def verify(proved: DataFrame, claimed: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, proof_sha256, folded_root (from the ``claimed`` leaf) and verified."""
    kept = ", ".join(f"`{c}` {proved.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kept}, proof_sha256 string, folded_root string, verified boolean"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [unpacked(p) for p in batch["proof"].to_pylist()]
            folded = [fold(leaf, path) for leaf, path in zip(batch[claimed].to_pylist(), paths, strict=True)]
            made = {c: batch[c] for c in keep}
            made["proof_sha256"] = [hashed(proof_text(p)) for p in paths]
            made["folded_root"] = folded
            made["verified"] = [a == b for a, b in zip(folded, batch["root"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict(made, schema=arrow)

    ship(proved.sparkSession)
    return proved.select(*dict.fromkeys([*keep, claimed, "root", "proof"])).mapInArrow(check, schema)


def tree_key(group: str) -> Column:
    """A text for each value of a group column that sorts null first, then by UTF-8 bytes."""
    return F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))


def manifest_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """tree, doc_id, leaf and claimed of each row of ``docs``, with ``n_`` equal ones counted.

    ``claimed`` is the digest that a holder of the row would show: with one more in n_chars
    where ``tampered``, which a null n_chars survives.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    leaf = leaf_digest(columns)
    claimed = leaf_digest([*columns[:3], more, columns[4]])
    forged = F.when(tampered, claimed) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(tree_key("lang").alias("tree"), "doc_id", leaf.alias("leaf"), forged.alias("claimed"))
    return rows.groupBy("tree", "doc_id", "leaf", "claimed").agg(F.count(F.lit(1)).alias("n_"))


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    Leaves stand by doc_id (null first), rows of one id by digest. Null fields are ``-``; equal
    rows are leaves of their own with proofs of their own. An empty table gives no rows.
    """
    leaves = manifest_leaves(docs, tampered)
    proved = prove_under_one_root(leaves, ["doc_id", "leaf"], ["doc_id", "claimed"], height)
    proved = proved.withColumn("claimed", F.coalesce("claimed", "leaf"))
    return verify(proved, "claimed", ["doc_id", "leaf", "subroot", "root"])
