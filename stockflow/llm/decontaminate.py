"""Benchmark decontamination by prefix-filtered containment.

Words are runs of a-z, 0-9 and everything beyond ASCII, with A-Z lower-cased. A window is
``window`` consecutive words of a benchmark item; a shorter item is one window of its own
length. A document word is hit if it lies in an occurrence of any window.

A window can only occur where all its shingles (of up to ``shingle`` words) occur, so one of
them is enough to find it: its prefix token, the shingle that is rarest in the documents.
First the shingles of the benchmark are counted over all documents, then each document looks
up its shingles among the prefix tokens; a match at place i of a token at place o of a window
of n words leaves one candidate, from i - o to i - o + n, which must lie inside the document
(length and positional bound) and is compared word for word.

The benchmark is the query set. It is taken in blocks of at most ``block_bytes`` of text (and
one item), one after the other, so what is sent to the tasks has a fixed bound whatever the
size of the benchmark; hits are carried along in the rows and no rows are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from stockflow.llm.common import LOWER, frees, ship, utf8

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 4 << 20

_WORD_BYTES = bytes(b for b in range(256) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
#: Lower-cases A-Z and blanks out what is in no word.
_WORDS = bytes(LOWER[b] if b in _WORD_BYTES else 0x20 for b in range(256))

_SPAN = StructType([StructField("begin", LongType()), StructField("end", LongType())])
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def _shingles(words: list[bytes], width: int) -> zip:
    return zip(*(words[k:] for k in range(width)), strict=False)


@dataclass
class Index:
    """Windows of a block of items, and where a shingle places them."""

    windows: dict[tuple[bytes, ...], list[str]] = field(default_factory=dict)
    #: shingle width -> shingle -> (place in the window, words of the window)
    prefix: dict[int, dict[tuple[bytes, ...], list[tuple[int, int]]]] = field(default_factory=dict)


def windows_of(items: list[tuple[str, bytes]], window: int) -> dict[tuple[bytes, ...], list[str]]:
    found: dict[tuple[bytes, ...], set[str]] = {}
    for name, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).add(name)
    return {w: sorted(names) for w, names in found.items()}


def shingle_numbers(windows: dict[tuple[bytes, ...], list[str]], shingle: int) -> dict[int, dict[tuple[bytes, ...], int]]:
    """All shingles of the windows, by width, numbered."""
    numbers: dict[int, dict[tuple[bytes, ...], int]] = {}
    n = 0
    for w in windows:
        width = min(shingle, len(w))
        of_width = numbers.setdefault(width, {})
        for s in _shingles(list(w), width):
            if s not in of_width:
                of_width[s] = n
                n += 1
    return numbers


def build_index(windows: dict[tuple[bytes, ...], list[str]], numbers: dict, counts: np.ndarray, shingle: int) -> Index:
    index = Index(windows)
    for w in windows:
        width = min(shingle, len(w))
        options = enumerate(_shingles(list(w), width))
        _, token, place = min((int(counts[numbers[width][s]]), s, i) for i, s in options)
        places = index.prefix.setdefault(width, {}).setdefault(token, [])
        if (place, len(w)) not in places:
            places.append((place, len(w)))
    return index


def occurrences(index: Index, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word spans of all windows that occur, and the items that they come from."""
    spans, items = set(), set()
    for width, prefix in index.prefix.items():
        for at, token in enumerate(_shingles(words, width)):
            if token in prefix:
                for place, n in prefix[token]:
                    begin = at - place
                    if begin >= 0 and begin + n <= len(words):
                        names = index.windows.get(tuple(words[begin : begin + n]))
                        if names:
                            spans.add((begin, begin + n))
                            items.update(names)
    return merge(spans), items


def merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


@frees
def _count(batches: Iterator[pa.RecordBatch], numbers: dict, total: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(total, np.int64)
    for batch in batches:
        flat, offsets = utf8(batch.column(0))
        for row in range(batch.num_rows):
            words = words_of(flat[offsets[row] : offsets[row + 1]].tobytes())
            for width, of_width in numbers.items():
                hits = [of_width[s] for s in _shingles(words, width) if s in of_width]
                if hits:
                    counts += np.bincount(hits, minlength=total)
    met = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["number", "n"])


@frees
def _match(batches: Iterator[pa.RecordBatch], index: Index | None, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets = utf8(batch.column("text_"))
        before = batch.column("spans_").to_pylist()
        named = batch.column("items_").to_pylist()
        sizes, spans, items = [], [], []
        for row in range(batch.num_rows):
            words = words_of(flat[offsets[row] : offsets[row + 1]].tobytes())
            sizes.append(len(words))
            found, names = occurrences(index, words) if index else ([], set())
            if before[row]:
                found = merge([*found, *((s["begin"], s["end"]) for s in before[row])])
                names |= set(named[row])
            spans.append([{"begin": a, "end": b} for a, b in found])
            items.append(sorted(names))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in keep),
                batch.column("text_"),
                pa.array(sizes, pa.int64()),
                pa.array(spans, _SPANS),
                pa.array(items, pa.list_(pa.string())),
            ],
            [*keep, "text_", "n_words", "spans_", "items_"],
        )


def item_blocks(benchmark: DataFrame, block_bytes: int, id_column: str, text: str) -> Iterator[list[tuple[str, bytes]]]:
    """Different items with a text, in blocks of about ``block_bytes``; an item without an id has the name ''."""
    items = benchmark.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("name"), F.col(text).alias("text")
    )
    items = items.where(F.octet_length("text") > 0).distinct()
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    # Half of the bound on average, so that chance leaves no block much above it.
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for block in range(n):
        part = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == block) if n > 1 else items
        yield [(r["name"], r["text"].encode()) for r in part.collect()]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each row of ``docs`` with n_words, n_hit, hit_spans (of words), items and contaminated.

    ``keep`` names the input columns that stay, all by default; those that clash with a new
    column give way. Texts that are null or have no words are clean, whatever the benchmark;
    items that are null or have no words match nothing; repeated items count once and repeated
    documents stay repeated. ``items`` are the ids of all items with an occurring window,
    sorted as strings.
    """
    spark = docs.sparkSession
    ship(spark)
    new = ["n_words", "n_hit", "hit_spans", "items", "contaminated", "text_", "spans_", "items_"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    fields = [StructField(c, docs.schema[c].dataType) for c in keep]
    schema = StructType(
        [
            *fields,
            StructField("text_", StringType()),
            StructField("n_words", LongType()),
            StructField("spans_", ArrayType(_SPAN)),
            StructField("items_", ArrayType(StringType())),
        ]
    )
    out = docs.select(
        *keep,
        F.col(text).alias("text_"),
        F.lit(None).cast(ArrayType(_SPAN)).alias("spans_"),
        F.lit(None).cast("array<string>").alias("items_"),
    )
    for items in item_blocks(benchmark, block_bytes, item_id, item_text):
        windows = windows_of(items, window)
        numbers = shingle_numbers(windows, shingle)
        total = sum(map(len, numbers.values()))
        held = None
        if windows:
            sent = spark.sparkContext.broadcast(numbers)
            counted = docs.select(F.col(text)).mapInArrow(
                lambda batches, sent=sent, total=total: _count(batches, sent.value, total), "number long, n long"
            )
            counts = np.zeros(total, np.int64)
            for row in counted.groupBy("number").agg(F.sum("n").alias("n")).collect():  # at most the block's shingles
                counts[row["number"]] = row["n"]
            held = spark.sparkContext.broadcast(build_index(windows, numbers, counts, shingle))
        out = out.select(*keep, "text_", "spans_", "items_").mapInArrow(
            lambda batches, held=held: _match(batches, held.value if held else None, keep), schema
        )
    hit = F.aggregate("spans_", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return out.select(
        *keep,
        "n_words",
        hit.alias("n_hit"),
        F.col("spans_").alias("hit_spans"),
        F.col("items_").alias("items"),
        (hit > 0).alias("contaminated"),
    )
