"""Token-id files with Elias-Fano document boundaries.

Documents are encoded in ascending id order; their ids are concatenated without any table of
64-bit offsets. A segment holds the ids of consecutive documents:

    magic ``EFTOK1``, id width (2 or 4 bytes), number of documents without an id,
    Elias-Fano list of the boundaries (0, then the end of each document),
    Elias-Fano list of the document ids less the least one,
    the ids, little-endian unsigned

An Elias-Fano list of n numbers up to u takes about 2 + log2(u / n) bits a number: the low bits
as they are, the high bits in unary, and the place of every 256th one for ``select``. Segments
are rows of Parquet files (column ``segment``), so any Hadoop file system can hold them and a
half-written file never shows. The start of a segment among all ids is not stored; it is the
sum of the id counts of the segments before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockflow.llm.common import ship, text_blocks, written
from stockflow.llm.tokens import BLOCK, encoder

MAGIC = b"EFTOK1"
SEGMENT_IDS = 1 << 18
SAMPLE = 256


@dataclass
class EliasFano:
    """A list of non-decreasing numbers."""

    n: int
    low_bits: int
    low: np.ndarray  # uint8, packed
    high: np.ndarray  # uint8, packed: number i is a one at place (number >> low_bits) + i
    samples: np.ndarray  # uint32: the place of every SAMPLE-th one

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel())
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros((top >> low_bits) + n + 1, np.uint8)
        ones[places] = 1
        return cls(n, low_bits, low, np.packbits(ones), places[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, memoryview]:
        """The list at the start of ``data``, and what follows it."""
        n, low_bits, n_low, n_high = struct.unpack_from("<QBQQ", data)
        at = struct.calcsize("<QBQQ")
        n_samples = -(-n // SAMPLE)
        ends = np.cumsum([at, n_low, n_high, 4 * n_samples]).tolist()
        low = np.frombuffer(data[ends[0] : ends[1]], np.uint8)
        high = np.frombuffer(data[ends[1] : ends[2]], np.uint8)
        samples = np.frombuffer(data[ends[2] : ends[3]], "<u4")
        return cls(n, low_bits, low, high, samples), data[ends[3] :]

    def select(self, i: int) -> int:
        """Number i, from the sample before it and a scan of fewer than SAMPLE ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        missing = i % SAMPLE
        byte = place >> 3
        step = 64
        bits = np.unpackbits(self.high[byte : byte + step])
        bits[: place & 7] = 0
        while True:
            ones = np.flatnonzero(bits)
            if len(ones) > missing:
                break
            missing -= len(ones)
            byte += step
            bits = np.unpackbits(self.high[byte : byte + step])
        high = byte * 8 + int(ones[missing]) - i
        first = i * self.low_bits
        part = np.unpackbits(self.low[first >> 3 : (first + self.low_bits + 7 >> 3) + 1])[first & 7 :][: self.low_bits]
        return high << self.low_bits | sum(int(b) << k for k, b in enumerate(part))

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high))[: self.n] - np.arange(self.n)
        values = high.astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            bits = np.unpackbits(self.low)[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
            values |= (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return values.astype(np.int64)


def pack_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One segment; ``ids`` are little-endian unsigned 32-bit, documents without an id come first."""
    tokens = np.frombuffer(b"".join(ids), "<u4")
    wide = len(tokens) and int(tokens.max()) >= 1 << 16
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
    parts = [
        MAGIC,
        struct.pack("<BQq", 4 if wide else 2, len(doc_ids) - len(known), least),
        EliasFano.of(bounds).to_bytes(),
        EliasFano.of(known.astype(np.uint64) - np.uint64(least % (1 << 64))).to_bytes(),
        tokens.astype("<u4" if wide else "<u2").tobytes(),
    ]
    return b"".join(parts)


@dataclass
class Segment:
    missing: int
    least: int
    bounds: EliasFano
    doc_ids: EliasFano
    tokens: np.ndarray

    @classmethod
    def of(cls, data: bytes) -> Segment:
        view = memoryview(data)
        if view[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token segment")
        width, missing, least = struct.unpack_from("<BQq", view, len(MAGIC))
        view = view[len(MAGIC) + struct.calcsize("<BQq") :]
        bounds, view = EliasFano.from_bytes(view)
        doc_ids, view = EliasFano.from_bytes(view)
        return cls(missing, least, bounds, doc_ids, np.frombuffer(view, f"<u{width}"))

    def document(self, i: int) -> np.ndarray:
        """The ids of document i alone."""
        return self.tokens[self.bounds.select(i) : self.bounds.select(i + 1)]

    def ids(self) -> list[int | None]:
        return [None] * self.missing + [int(x) + self.least for x in self.doc_ids.all()]


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int, segment_ids: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).encode
    docs: list[int | None] = []
    found: list[bytes] = []
    key = None
    size = number = 0

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key[0]], pa.int64()),
                pa.array([key[1]], pa.int64()),
                pa.array([number], pa.int64()),
                pa.array([len(docs)], pa.int64()),
                pa.array([size], pa.int64()),
                pa.array([pack_segment(docs, found)], pa.binary()),
            ],
            ["first_doc", "first_tie", "number", "n_docs", "n_ids", "segment"],
        )

    for batch in batches:
        for first, end, data, offsets in text_blocks(batch.column("text"), BLOCK):
            texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(end - first)]
            own = batch.column("id").slice(first, end - first).to_pylist()
            ties = batch.column("tie").slice(first, end - first).to_pylist()
            for doc, tie, ids in zip(own, ties, encode(texts), strict=True):
                if key is None:
                    key = (doc, tie)
                docs.append(doc)
                found.append(ids + end_id.to_bytes(4, "little"))
                size += len(ids) // 4 + 1
                if size >= segment_ids:
                    yield close()
                    docs, found, key, size, number = [], [], None, 0, number + 1
    if docs:
        yield close()


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_column: str = "doc_id",
    text: str = "text",
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode all texts and write them in ascending id order under ``path``.

    A null text is empty: its end id alone. Rows without an id come first; rows with the same id
    stand in order of a hash of the text, so that one id with a large share of the rows still
    spreads over tasks. The text moves once, to the task of its id range; ids are made there.
    """
    ship(docs.sparkSession)
    slim = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(text).alias("text"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"),
    )
    ranges = slim.repartitionByRange(F.col("id").asc_nulls_first(), F.col("tie"))
    ordered = ranges.sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")
    segments = ordered.mapInArrow(
        lambda batches: _segments(batches, tokenizer, end_id, segment_ids),
        "first_doc long, first_tie long, number long, n_docs long, n_ids long, segment binary",
    )
    segments.write.option("compression", "uncompressed").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            segment = Segment.of(batch.column("segment")[row].as_py())
            bounds = [segment.bounds.select(i) for i in range(segment.bounds.n)]
            wide = segment.tokens.astype("<u4")
            spans = list(zip(bounds[:-1], bounds[1:], strict=True))
            n = len(spans)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array([row] * n, pa.int64())) for c in ("first_doc", "first_tie", "number")),
                    pa.array(segment.ids(), pa.int64()),
                    pa.array([a for a, _ in spans], pa.int64()),
                    pa.array([b - a for a, b in spans], pa.int64()),
                    pa.array([zlib.crc32(wide[a:b].tobytes()) for a, b in spans], pa.int64()),
                ],
                ["first_doc", "first_tie", "number", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start among all ids, n_tokens and ids_crc32 of each document in the files."""
    ship(spark)
    files = spark.read.parquet(path)
    key = ["first_doc", "first_tie", "number"]
    # Ids before a segment: those of the ranges before its range, one row each, and of the
    # segments before it in its range.
    order = [F.col("first_doc").asc_nulls_first(), "first_tie", "number"]
    ranges = files.select(*key, "n_ids").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranges = written(ranges, "segment_index")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("part").agg(F.sum("n_ids").alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    index = ranges.withColumn("inside", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(totals, "part")
    index = index.withColumn("base", F.col("ahead") + F.col("inside"))
    index = index.select(*[F.col(c).alias(f"i_{c}") for c in key], "base")
    docs = files.select(*key, "segment").mapInArrow(
        _read,
        "first_doc long, first_tie long, number long, doc_id long, local_start long, n_tokens long, ids_crc32 long",
    )
    same = docs["first_doc"].eqNullSafe(index["i_first_doc"])
    for c in key[1:]:
        same &= docs[c] == index[f"i_{c}"]
    joined = docs.join(index, same)
    return joined.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
