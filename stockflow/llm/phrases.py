"""Text fingerprints by locally consistent parsing.

A text's bytes are parsed into a hierarchy of phrases. On every level, runs of one name become
one name; then deterministic coin tossing gives each name a small label from itself and its
left neighbours: in each round, twice the place of the lowest bit that differs from the
neighbour's label, plus that bit. Four rounds leave labels below 6, and neighbours still
differ. Phrases begin at local maxima, so whether one begins somewhere depends only on a few
names around, not on offsets: equal substrings get the same phrases inside, whatever
surrounds them. A phrase's name is the hash of the names in it, and the names are the next
level's text; each level is some three times shorter. A text's hierarchy ends where one phrase
is left, which is the whole text.

The fingerprint is a sketch of the phrase names of the upper levels (from some 10 bytes on):
one least hash in each of 64 bins, 16 bits of it kept, ``----`` for an empty bin. The likeness
of two fingerprints is the share of bins that agree among those that either one uses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stockflow.llm.common import BLOCK_BYTES, blocks, mix, ship

BINS = 64
FROM_LEVEL = 2
EMPTY = "----"

_STEP = 0xD6E8FEB86659FD93
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.multiply.accumulate(steps)
    return _TABLES["up"], _TABLES["down"]


def _without_runs(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs as single names, and where texts begin; ``first`` marks the texts' first names."""
    fresh = first.copy()
    fresh[1:] |= names[1:] != names[:-1]
    starts = np.flatnonzero(fresh)
    lengths = np.diff(np.append(starts, len(names)))
    out = names[starts].astype(np.uint64)
    long = lengths > 1
    if long.any():
        out[long] = mix(out[long] + lengths[long].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return out, first[starts]


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 that differ between neighbours of a text."""
    labels = names
    for _ in range(4):
        differ = labels.copy()
        differ[1:] ^= labels[:-1]
        differ[first] = 1  # nothing to the left: as if the lowest bit differed
        lowest = differ & (~differ + labels.dtype.type(1))
        place = np.bitwise_count(lowest - labels.dtype.type(1)).astype(np.uint8)
        bit = (labels & lowest) != 0
        labels = place * np.uint8(2) + bit
    return labels


def next_level(names: np.ndarray, offsets: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each text, and the texts' offsets among them."""
    full = offsets[:-1] < offsets[1:]
    first = np.zeros(len(names), bool)
    first[offsets[:-1][full]] = True
    names, first = _without_runs(names, first)
    n = len(names)
    if not n:
        return names, np.zeros(len(offsets), np.int64)
    labels = _labels(names, first)
    begin = first.copy()
    # A first name has no left neighbour to exceed; the phrase before a maximum ends there.
    begin[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~first[2:]
    starts = np.flatnonzero(begin)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(names) * up[:n], out=sums[1:])
    ends = np.append(starts[1:], n)
    phrases = mix((sums[ends] - sums[starts]) * down[starts] + np.uint64(level + 1))
    texts = np.cumsum(full) - 1  # place of each text among those that are not empty
    heads = np.append(np.flatnonzero(first[starts]), len(starts))
    out = np.zeros(len(offsets), np.int64)
    out[:-1] = np.where(full, heads[np.maximum(texts, 0)], heads[np.minimum(texts + 1, len(heads) - 1)])
    out[-1] = len(starts)
    return phrases, out


def sketches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """BINS numbers for each text: 16 bits of the least hash of each bin, or -1."""
    n = len(offsets) - 1
    out = np.full((n, BINS), -1, np.int32)
    names, at = data, offsets
    keys, owners = [], []
    level, parted = 1, np.ones(n, bool)  # texts that have more than one phrase on the level below
    while level <= FROM_LEVEL or parted.any():
        names, at = next_level(names, at, level)
        sizes = np.diff(at)
        if level >= FROM_LEVEL:
            own = np.repeat(parted if level > FROM_LEVEL else np.ones(n, bool), sizes)
            keys.append(mix(names[own] + np.uint64(level)))
            owners.append(np.repeat(np.arange(n), sizes)[own])
        parted = sizes > 1
        level += 1
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    if not len(keys):
        return out
    place = owners * BINS + (keys >> np.uint64(58)).astype(np.int64)
    order = np.lexsort((keys, place))
    place, keys = place[order], keys[order]
    least = np.ones(len(place), bool)
    least[1:] = place[1:] != place[:-1]
    out.ravel()[place[least]] = (mix(keys[least]) & np.uint64(0xFFFF)).astype(np.int32)
    return out


def as_text(sketch: np.ndarray) -> str:
    return "".join(f"{x:04x}" if x >= 0 else EMPTY for x in sketch.tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; two texts without phrases are alike."""
    used = ((a >= 0) | (b >= 0)).sum(axis=1)
    same = ((a == b) & (a >= 0)).sum(axis=1)
    return np.where(used, same / np.maximum(used, 1), 1.0)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Sketches of texts, in blocks of about a megabyte."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    parts = [np.zeros((0, BINS), np.int32)]
    for start, end in blocks(offsets):
        data = np.frombuffer(b"".join(texts[start:end]), np.uint8)
        parts.append(sketches(data, offsets[start : end + 1] - offsets[start]))
    return np.concatenate(parts)


def add_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fingerprint``: row by row, no shuffle.

    ``keep`` names the input columns that stay, all by default; one called fingerprint gives
    way. A null text is empty; an empty text has no phrases.
    """
    ship(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(text).to_pylist()]
            marks = pa.array([as_text(s) for s in fingerprints(texts)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), marks], [*keep, "fingerprint"])

    wanted = list(dict.fromkeys([*keep, text]))
    schema = StructType([*(docs.schema[c] for c in keep), *StructType.fromDDL("fingerprint string").fields])
    return docs.select(*wanted).mapInArrow(run, schema)


# Each document against its edited text and the next document


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    """All but the last of ``rows`` (bucket, id, text), each with the row after it."""
    texts = [r[2] for r in rows]
    pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0]]
    edited = []
    for i in pairs:
        cut = len(texts[i]) // 3
        edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
    own = fingerprints([t.encode() for t in texts])
    changed = fingerprints([t.encode() for t in edited])
    at = np.array(pairs, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][1] for i in pairs], pa.int64()),
            pa.array([len(texts[i]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([as_text(own[i]) for i in pairs], pa.string()),
            pa.array([as_text(s) for s in changed], pa.string()),
            pa.array(likeness(own[at], changed) if pairs else [], pa.float64()),
            pa.array(likeness(own[at], own[at + 1]) if pairs else [], pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "id", "text")), strict=True):
            held.append(row)
            size += len(row[2])
            if size >= BLOCK_BYTES:
                yield _compare(held)
                held, size = held[-1:], 0
    if len(held) > 1:
        yield _compare(held)


def _bucketed(batches: Iterator[pa.RecordBatch], ids: np.ndarray, ties: np.ndarray, nulls: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The number of the last first key that is not after the row, in descending order of id."""
    for batch in batches:
        null = batch.column("id").is_null().to_numpy(zero_copy_only=False)
        id_ = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False)
        tie = batch.column("tie").to_numpy(zero_copy_only=False)
        low = np.zeros(len(id_), np.int64)
        high = np.full(len(id_), len(ids), np.int64)
        for _ in range(len(ids).bit_length()):
            middle = np.minimum((low + high) >> 1, len(ids) - 1)
            m_null, m_id, m_tie = nulls[middle], ids[middle], ties[middle]
            # Is first key ``middle`` at or before the row? Ids descend, none comes last, ties ascend.
            same = (m_null & null) | (~m_null & ~null & (m_id == id_))
            before = np.where(same, m_tie <= tie, ~m_null & (null | (m_id > id_)))
            live = low < high
            low = np.where(live & before, middle + 1, low)
            high = np.where(live & ~before, middle, high)
        bucket = pa.array(np.maximum(low - 1, 0))
        yield pa.RecordBatch.from_arrays(
            [bucket, batch.column("id"), batch.column("tie"), batch.column("text")], ["bucket", "id", "tie", "text"]
        )


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next text are.

    The edited text has its last third (rounded down, in code points) replaced by the first as
    many of the next document's, or all; the next document is the one after in descending id
    order, after the last the first. Rows without an id come last; equal ids go by a hash of the
    text, then of equal texts any is next. Null texts are empty. An empty table gives no rows, a
    single row is next to itself.

    The ids alone are sorted into ranges first; the ranges' first keys (one for each shuffle
    partition) cut the table into buckets, and each bucket also gets the first row of the one
    after it. So the texts move once, and no task sees more than its range.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").desc_nulls_last(), F.col("tie")]
    ranges = slim.select("id", "tie").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    # Greatest id first, and no id only in the last range, so the least (none, -id, tie) comes first.
    heads = ranges.groupBy("part").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), (-F.col("id")).alias("less"), "tie", "id")).alias("k")
    )
    firsts = sorted((r["k"]["none"], r["k"]["less"] or 0, r["k"]["tie"], r["k"]["id"]) for r in heads.collect())  # n rows
    empty = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not firsts:
        return spark.createDataFrame([], empty).withColumnRenamed("doc_id", id_column)
    nulls = np.array([f[0] for f in firsts])
    ids = np.array([f[3] or 0 for f in firsts], np.int64)
    ties = np.array([f[2] for f in firsts], np.int64)
    schema = "bucket long, id long, tie long, text string"
    rows = slim.mapInArrow(lambda batches: _bucketed(batches, ids, ties, nulls), schema)
    rows = rows.withColumn("after", F.lit(0))

    keys = spark.createDataFrame(
        [((i - 1) % len(firsts), f[3], f[2]) for i, f in enumerate(firsts)], "b long, k_id long, k_tie long"
    )
    ahead = slim.join(F.broadcast(keys), slim["id"].eqNullSafe(keys["k_id"]) & (slim["tie"] == keys["k_tie"]))
    ahead = ahead.groupBy(F.col("b").alias("bucket")).agg(
        F.first("id").alias("id"), F.first("tie").alias("tie"), F.first("text").alias("text")
    )
    both = rows.unionByName(ahead.withColumn("after", F.lit(1)))
    ordered = both.repartition(n, "bucket").sortWithinPartitions("bucket", "after", *order)
    return ordered.select("bucket", "id", "text").mapInArrow(_neighbours, empty).withColumnRenamed("doc_id", id_column)
