"""Packing of token pieces into sequences by shortest-pack-first over the length histogram.

Documents become token ids (with an end id), cut into pieces of at most ``length`` ids. Only the
histogram of piece lengths, at most ``length`` numbers, comes to the driver. There the lengths
are placed longest first, each into the pack that is shortest so far and still has room; packs
with the same content are one pattern with a count, so the work depends on the histogram's
width and not on the number of documents. The patterns then go back to the pieces: a piece's
rank among the pieces of its length says which copy of which pattern it fills.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm.common import ship, text_blocks, written
from stockflow.llm.tokens import BLOCK, encoder, forget

LENGTH = 2048
RANK_ROWS = 50_000


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each packing pattern; the counts fill exactly the histogram."""
    open_packs: dict[int, list[list]] = {}  # filled -> [count, pattern]
    filled: list[int] = []  # the keys of open_packs, in order

    def add(count: int, pattern: tuple[int, ...]) -> None:
        total = sum(pattern)
        if total not in open_packs:
            open_packs[total] = []
            bisect.insort(filled, total)
        open_packs[total].append([count, pattern])

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        if not 0 < size <= length:
            raise ValueError(f"a piece of {size} ids does not fit into {length}")
        while left > 0:
            if filled and filled[0] + size <= length:
                group = open_packs[filled[0]][-1]
                used = min(left, group[0])
                group[0] -= used
                if not group[0]:
                    open_packs[filled[0]].pop()
                    if not open_packs[filled[0]]:
                        del open_packs[filled.pop(0)]
                add(used, (*group[1], size))
                left -= used
            else:
                # New packs take as many of this length as fit, since each would be the shortest again.
                each = min(length // size, left)
                packs = left // each
                add(packs, (size,) * each)
                left -= packs * each
    return [(count, pattern) for total in filled for count, pattern in open_packs[total]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, times) of every run in every pattern.

    A run is the ``times`` places of one length in a pattern, which stand side by side; its ranks
    fill the places of a sequence one after the other, then those of the next sequence.
    """
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for size, places in itertools.groupby(pattern):
            times = len(list(places))
            rank = taken.get(size, 0)
            out.append((size, rank, rank + count * times, sequence, offset, times))
            taken[size] = rank + count * times
            offset += size * times
        sequence += count
    return out


class Places:
    """Where the piece of a length and rank goes: a binary search among the runs."""

    def __init__(self, histogram: dict[int, int], runs: list[tuple[int, int, int, int, int, int]]) -> None:
        sizes = np.array(sorted(histogram), np.int64)
        self.sizes = sizes
        #: Pieces of lesser lengths: with them ahead, ranks of different lengths differ.
        self.ahead = np.concatenate([[0], np.cumsum([histogram[s] for s in sizes.tolist()])]).astype(np.int64)
        table = np.array(sorted(runs), np.int64).reshape(-1, 6)
        self.low = table[:, 1] + self.ahead[np.searchsorted(sizes, table[:, 0])]
        self.sequence, self.offset, self.times = table[:, 3], table[:, 4], table[:, 5]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        at = rank + self.ahead[np.searchsorted(self.sizes, length)]
        run = np.searchsorted(self.low, at, "right") - 1
        which = at - self.low[run]
        return self.sequence[run] + which // self.times[run], self.offset[run] + which % self.times[run] * length


def _placed(batches: Iterator[pa.RecordBatch], places: Places, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sequence, offset = places.of(*(batch.column(c).to_numpy() for c in ("length", "rank")))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"]
        )


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, length: int, ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).encode
    for batch in batches:
        for first, end, data, offsets in text_blocks(batch.column("text"), BLOCK):
            texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(end - first)]
            rows, starts, lengths, crcs, totals, parts = [], [], [], [], [], []
            for row, found in enumerate(encode(texts), first):
                found += end_id.to_bytes(4, "little")
                total = len(found) // 4
                for start in range(0, total, length):
                    part = found[4 * start : 4 * (start + length)]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    totals.append(total)
                    parts.append(part)
            longs = [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())), *longs, *([pa.array(parts, pa.binary())] if ids else [])],
                ["id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if ids else [])],
            )


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    length: int = LENGTH,
    id_column: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
    keep_words: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null or empty text is its end id alone. Repeated rows, and rows without an id, are packed
    as often as they occur. An empty table gives no rows. Other columns are not read. With
    ``with_ids`` the piece's ids come along as little-endian unsigned 32-bit integers.
    Workers keep the ids of the words they have met for their next task; without ``keep_words``
    each task starts anew and leaves that memory to the stages after it.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from _pieces(batches, tokenizer, end_id, length, with_ids)
        finally:
            if not keep_words:
                forget()

    made = slim.mapInArrow(cut, schema)
    pieces = written(made, "pieces")

    # At most ``length`` rows.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # The runs of all patterns: their number depends on ``length`` alone.
    places = Places(histogram, slots(shortest_pack_first(histogram, length)))

    # Ranks inside buckets of a length, each behind the buckets before it.
    n_buckets = max(1, max(histogram.values(), default=1) // RANK_ROWS)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(n_buckets)))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "start", "ids_crc32")
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    ranked = keyed.withColumn("row", F.row_number().over(inside)).join(sizes, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("row") - 1 + F.col("before"))

    keep = ["id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    placed = ranked.select(*keep, "rank").mapInArrow(
        lambda batches: _placed(batches, places, keep), f"{schema}, sequence_id long, offset long"
    )
    names = [id_column, *keep[1:5], "sequence_id", "offset", *keep[5:]]
    return placed.withColumnsRenamed({"id": id_column}).select(*names)
