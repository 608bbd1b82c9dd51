"""Near-duplicate groups by circulant MinHash, banding and exact verification.

A text's set holds its distinct shingles of ``width`` words (A-Z lower-cased, words parted by
ASCII blanks); a text with fewer words is one shingle, a text without words has an empty set
and links with nothing. Texts with equal sets form a class, and only classes are compared.

Signatures: shingles fall on a universe of 2**20 places, a first permutation moves them, and a
second permutation, shifted by 1, 2, ... K places, gives all K coordinates: coordinate k is the
least value of the shifted permutation over the set. 32 bands of 4 coordinates miss a pair of
similarity 0.8 with chance (1 - 0.8**4)**32, about 5e-8.

Classes that share a band bucket form loose clusters (components over buckets, so no pairs are
made). Each cluster goes to a task as full sets, and a link is made only where the exact
intersection reaches the threshold. A cluster larger than ``block_items`` set entries is cut
into blocks, and every two blocks meet in a task of their own: all its pairs are looked at, in
bounded memory. A task returns a spanning forest of its links, never all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import (
    LOWER_TABLE,
    frees,
    mix,
    ship,
    span_hashes,
    text_blocks,
    text_key,
    word_spans,
    written,
)
from stockflow.llm.components import bucket_components

UNIVERSE_BITS = 20
BANDS, ROWS = 32, 4
BLOCK_ITEMS = 2_000_000

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


@lru_cache
def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and windows on the second: row i has its values at i+1 ... i+K."""
    size = 1 << UNIVERSE_BITS
    rng = np.random.default_rng(20)
    first = rng.permutation(size).astype(np.uint32)
    second = rng.permutation(size).astype(np.uint32)
    circle = np.concatenate([second, second[: coordinates + 1]])
    return first, np.lib.stride_tricks.sliding_window_view(circle[1:], coordinates)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, sorted, and the offsets of the texts in them."""
    data = LOWER_TABLE[data]
    starts, ends, firsts = word_spans(~_BLANK[data], offsets)
    words = span_hashes(data, starts, ends)
    n = len(words)
    n_words = np.diff(firsts)
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    if n >= width:
        total = words[: n - width + 1].copy()
        for k in range(1, width):
            total = mix(total + np.uint64(0x9E3779B97F4A7C15)) + words[k : n - width + 1 + k]
        whole = np.flatnonzero(text_of[: n - width + 1] == text_of[width - 1 :])
        hashes, owner = mix(total[whole]), text_of[whole]
    else:
        hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        alone = []
        for text in short.tolist():
            value = words[firsts[text] : firsts[text] + 1].copy()
            for k in range(1, n_words[text]):
                value = mix(value + np.uint64(0x9E3779B97F4A7C15)) + words[firsts[text] + k : firsts[text] + k + 1]
            alone.append(mix(value + np.uint64(n_words[text])))
        hashes = np.concatenate([hashes, *alone])
        owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(len(n_words) + 1))


def signatures(hashes: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """K coordinates of each set; the empty set has the greatest values."""
    first, windows = _permutations(coordinates)
    places = first[(hashes & np.uint64((1 << UNIVERSE_BITS) - 1)).astype(np.int64)]
    out = np.full((len(offsets) - 1, coordinates), np.iinfo(np.uint32).max, np.uint32)
    for text in np.flatnonzero(np.diff(offsets)).tolist():
        low, high = int(offsets[text]), int(offsets[text + 1])
        for at in range(low, high, 16_384):
            part = windows[places[at : min(high, at + 16_384)]].min(axis=0)
            np.minimum(out[text], part, out=out[text])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xA24BAED4963EE407)
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    for k in range(rows):
        keys = mix(keys + parts[:, :, k] + np.uint64(k + 1))
    return keys.view(np.int64)


@frees
def _describe(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """n_shingles, a 128-bit name of the set and its band keys, beside the columns id and tkey."""
    for batch in batches:
        for start, end, data, offsets in text_blocks(batch.column("text")):
            hashes, at = shingle_hashes(data, offsets, width)
            sizes = np.diff(at)
            keys = band_keys(signatures(hashes, at, bands * rows), bands, rows)
            sums = np.zeros((2, len(hashes) + 1), np.uint64)
            np.cumsum(mix(hashes + np.uint64(11)), out=sums[0, 1:])
            np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1, 1:])
            names = np.ascontiguousarray((sums[:, at[1:]] - sums[:, at[:-1]]).T).astype(">u8")
            flat = pa.array(keys[sizes > 0].ravel())
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)), flat
            )
            ids = batch.column("id").slice(start, end - start)
            tkeys = batch.column("tkey").slice(start, end - start)
            yield pa.RecordBatch.from_arrays(
                [ids, tkeys, pa.array(sizes.astype(np.int64)), pa.array([x.tobytes() for x in names], pa.binary()), lists],
                ["id", "tkey", "n_shingles", "node", "bands"],
            )


def sets_table(docs: DataFrame, width: int, bands: int, rows: int, id_column: str, text: str) -> DataFrame:
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_column).alias("id"), text_key(text).alias("tkey"), F.col(text).alias("text"))
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, tkey binary, n_shingles long, node binary, bands array<long>"
    return slim.mapInArrow(lambda batches: _describe(batches, width, bands, rows), schema)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        onward = parent[parent]
        if (onward == parent).all():
            return parent
        parent = onward


def linked_pairs(
    hashes: np.ndarray, offsets: np.ndarray, percent: int, split: int | None = None
) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets: 100 * intersection >= percent * union.

    All pairs count (with ``split``: those of one set before and one at or after it), unless a
    path already joins them. Sets go in order of size; a set meets those that a longer set can
    still link with, through the places of its own entries, so no pair without a common
    entry costs anything.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    entries, ids = np.unique(hashes, return_inverse=True)
    owner = place[np.repeat(np.arange(n), sizes)]
    by_entry = np.lexsort((owner, ids))
    owners = owner[by_entry]
    heads = np.searchsorted(ids[by_entry], np.arange(len(entries) + 1))
    in_order = sizes[order]
    ids_of = [ids[offsets[i] : offsets[i + 1]] for i in order]
    parent = np.arange(n)
    forest = []
    for x in range(n):
        size = int(in_order[x])
        # An intersection of i leaves a union of a + b - i: i * (100 + percent) >= percent * (a + b).
        low = int(np.searchsorted(in_order, -(-size * percent // 100)))
        if low >= x:
            continue
        runs = [owners[heads[e] : heads[e + 1]] for e in ids_of[x] if heads[e + 1] - heads[e] > 1]
        if not runs:
            continue
        met = np.bincount(np.concatenate(runs), minlength=n)[low:x]
        near = np.flatnonzero(met * (100 + percent) >= percent * (size + in_order[low:x])) + low
        if split is not None and len(near):
            near = near[(order[near] < split) != (order[x] < split)]
        for y in near.tolist():
            a, b = x, y
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            while parent[b] != b:
                parent[b] = parent[parent[b]]
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                forest.append((int(order[x]), int(order[y])))
    return forest


def _verify(batch: pa.Table, width: int, percent: int) -> pa.Table:
    """Links among the classes of one cluster, or between two of its blocks."""
    names = batch["node"].to_pylist()
    side = batch["side"].to_numpy()
    first = {(int(s), name): row for row, (s, name) in reversed(list(enumerate(zip(side, names, strict=True))))}
    order = [first[key] for key in sorted(first)]  # repeated rows once; side 0 before side 1
    side = side[order]
    parts, sizes = [], []
    for _, _, data, offsets in text_blocks(batch["text"].take(pa.array(order))):
        hashes, at = shingle_hashes(data, offsets, width)
        parts.append(hashes)
        sizes.append(np.diff(at))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    cut = int((side == 0).sum()) if (side == 1).any() else None
    pairs = linked_pairs(np.concatenate(parts), offsets, percent, cut)
    ends = [sorted((names[order[x]], names[order[y]])) for x, y in pairs]
    return pa.table({"a": pa.array([a for a, _ in ends], pa.binary()), "b": pa.array([b for _, b in ends], pa.binary())})


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_column: str = "doc_id",
    text: str = "text",
    bands: int = BANDS,
    rows: int = ROWS,
    block_items: int = BLOCK_ITEMS,
    group: str | None = None,
) -> DataFrame:
    """(id, text_key, n_shingles, component_id, kept) of every row of ``docs``.

    ``component_id`` is the least id that links reach, itself included; ``kept`` marks the rows
    whose id it is. Null and wordless texts have the empty set and their own component. Rows
    without an id count as the last of their component: it is null only where no row of the
    component has one. Repeated rows stay repeated. Other columns are not read. ``group`` names one
    more column: 16 bytes that all rows of a component share and no other row has, null where the
    set is empty.
    """
    sets = written(sets_table(docs, width, bands, rows, id_column, text), "sets")
    classes = sets.where("n_shingles > 0").groupBy("node", "n_shingles")
    classes = classes.agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tkey")).alias("least"), F.first("bands").alias("bands")
    )
    named = classes.select("node", "n_shingles", "least.id", "least.tkey", "bands")
    member = named.select("node", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    buckets = written(member.join(shared, "bucket", "left_semi"), "buckets")
    loose = bucket_components(buckets).withColumnRenamed("component", "cluster")

    # Blocks of a cluster: by a hash of the node, enough of them that one holds about block_items.
    sized = loose.join(named.select("node", "n_shingles", "id", "tkey"), "node")
    totals = sized.groupBy("cluster").agg(
        F.ceil(F.sum("n_shingles") / F.lit(block_items)).alias("n_blocks"), F.count(F.lit(1)).alias("n")
    )
    placed = sized.join(totals.where("n > 1"), "cluster").withColumn(
        "block", F.when(F.col("n_blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("node", F.lit(7)), "n_blocks"))
    )
    meetings = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1),
        lambda other: F.struct(
            F.least("block", other).alias("low"),
            F.greatest("block", other).alias("high"),
            F.when(F.col("block") <= other, 0).otherwise(1).alias("side"),
        ),
    )
    dealt = placed.select("cluster", "node", "id", "tkey", F.explode(meetings).alias("m"))
    dealt = dealt.select("cluster", "node", "id", "tkey", "m.low", "m.high", "m.side")

    texts = docs.select(F.col(id_column).alias("id"), text_key(text).alias("tkey"), F.col(text).alias("text"))
    here = dealt.withColumnsRenamed({"id": "r_id", "tkey": "r_tkey"})
    joined = texts.join(here, texts["id"].eqNullSafe(here["r_id"]) & (texts["tkey"] == here["r_tkey"]))
    links = joined.groupBy("cluster", "low", "high").applyInArrow(
        lambda batch: _verify(batch.select(["node", "side", "text"]), width, percent), "a binary, b binary"
    )
    links = written(links.distinct(), "links")
    # An edge is a bucket of two.
    edges = links.select(F.explode(F.array("a", "b")).alias("node"), F.concat("a", "b").alias("bucket"))
    found = bucket_components(edges)

    ends = named.select("node", "id").join(found, "node")
    names = ends.groupBy("component").agg(F.min("id").alias("component_id"))
    joined_up = ends.join(names, "component").select("node", "component", "component_id")
    own = named.select("node", F.col("id").alias("own_id")).join(joined_up, "node", "left")
    final = own.select("node", F.coalesce("component_id", "own_id").alias("component_id"), F.coalesce("component", "node").alias("component"))
    out = sets.drop("bands").join(final, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_column),
        F.col("tkey").alias("text_key"),
        "n_shingles",
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
        *([F.col("component").alias(group)] if group else []),
    )
