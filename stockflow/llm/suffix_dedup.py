"""Exact removal of long repeated byte strings with difference-cover suffix arrays.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else, in the
same text or another. All strings count, on the texts as given; matches never cross texts.

Suffix sorting is spread over tasks so that equal strings always meet. Every string of
``length`` bytes has an anchor, the place of its least ``gram``-byte hash; equal strings have
equal anchors at equal distances. The strings of one anchor are consecutive and form one
segment of at most ``2 * length`` bytes. Then:

1. anchors whose name (hash of the gram) occurs once are done: none of their strings repeats;
2. segments that occur as a whole more than once repeat in every string (copied texts and the
   inside of copied passages end here, without any bytes being moved);
3. the other segments of a repeated name go, once each, to the task of that name. What agrees
   with another one around the anchor goes into a suffix array by the difference cover modulo
   3: triples of the sampled places are sorted and named, the names are sorted by recursion,
   the remaining suffixes are sorted by them and merged, and the first ``length`` bytes of
   neighbours are compared. Recursion ends once names stand for ``length`` bytes or all differ.

A name with more than ``max_segments`` different segments would make one task too large; its
strings are named by 128 bits of BLAKE2b instead and counted by an aggregation. Same result.

Passages of words that another text has too are found in the same way, with words for bytes
(``passage_words``): strings of that many words, anchored at their least ``GRAM_WORDS`` words.
Names are even for strings of bytes and odd for strings of words.

Names are polynomial hashes, which only bring strings together: unequal grams of one name cost
work and change nothing. Segments are equal by 64 bits of BLAKE2b (beside their name),
neighbours in a suffix array by their bytes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import (
    code_sums,
    dropped,
    frees,
    neighbour_hashes,
    prefix_sums,
    ship,
    span_hashes,
    text_blocks,
    text_key,
    utf8,
    word_spans,
    written,
)

LENGTH = 400
GRAM = 48
GRAM_WORDS = 12
MAX_SEGMENTS = 10_000
CHUNK = 1 << 20
ARRAY_BYTES = 1 << 20

#: Bytes that part words.
BLANKS = b" \t\n\v\f\r"
IS_WORD = np.ones(256, bool)
IS_WORD[list(BLANKS)] = False


# Anchors


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by runs from both ends of blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchored(names: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, begin, end, anchor) of each segment, in the units that ``names`` has a gram for each.

    A segment is a run of strings of ``length`` units with the same anchor, which never leaves
    its text.
    """
    n = int(offsets[-1])
    places = np.uint64((1 << 24) - 1)
    numbered = names & ~places
    numbered |= np.arange(len(names), dtype=np.uint64)
    least = _sliding_min(numbered, length - gram + 1)
    # A string must end inside the text that it starts in.
    inside = np.ones(n + 1, bool)
    for end in offsets[1:].tolist():
        inside[max(0, end - length + 1) : end] = False
    inside = inside[: n - length + 1]
    fresh = inside.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    starting = offsets[:-1][offsets[:-1] <= n - length]
    fresh[starting] = inside[starting]
    begin = np.flatnonzero(fresh)
    last = inside.copy()
    last[:-1] &= fresh[1:] | ~inside[1:]
    end = np.flatnonzero(last) + length
    anchor = (least[begin] & places).astype(np.int64)
    return np.searchsorted(offsets, begin, "right") - 1, begin, end, anchor


def _digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    whole, blake = memoryview(data.tobytes()), hashlib.blake2b
    found = [blake(whole[a:b], digest_size=8).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), "<u8").astype(np.uint64)


def _no_segments() -> tuple[np.ndarray, ...]:
    return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, begin, end, name, hash, anchor) of each segment; places count from ``data[0]``."""
    if len(data) < length:
        return _no_segments()
    names = neighbour_hashes(prefix_sums(data), gram)
    text, begin, end, anchor = anchored(names, offsets, length, gram)
    return text, begin, end, names[anchor] & ~np.uint64(1), _digests(data, begin, end), anchor


def word_segments(data: np.ndarray, offsets: np.ndarray, words: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same for strings of ``words`` words, from the first byte of a word to the last of one."""
    starts, ends, firsts = word_spans(IS_WORD[data], offsets)
    codes = span_hashes(data, starts, ends)
    for low in range(0, len(starts) - words + 1, CHUNK):
        high = min(len(starts), low + CHUNK + words - 1)
        names = neighbour_hashes(code_sums(codes[low:high]), gram)
        text, begin, end, anchor = anchored(names, np.clip(firsts, low, high) - low, words, gram)
        name = names[anchor] | np.uint64(1)
        begin, end, anchor = starts[low + begin], ends[low + end - 1], starts[low + anchor]
        yield text, begin, end, name, _digests(data, begin, end), anchor


def _chunks(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, offsets) of parts of a block; a long text is cut into parts that overlap."""
    total = int(offsets[-1])
    if total <= 2 * CHUNK:
        yield 0, total, offsets
        return
    for start in range(0, max(1, total - length + 1), CHUNK):
        end = min(total, start + CHUNK + length - 1)
        yield start, end, np.clip(offsets, start, end) - start


@frees
def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, _, data, offsets in text_blocks(batch.column("text")):
            found = ((low, segments(data[low:high], inner, length, gram)) for low, high, inner in _chunks(offsets, length))
            if words:
                by_words = word_segments(data, offsets, words, min(GRAM_WORDS, words))
                found = itertools.chain(found, ((0, each) for each in by_words))
            for low, (text, begin, end, name, digest, anchor) in found:
                own = pa.array(text + start)
                base = offsets[text] - low
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(own),
                        batch.column("tkey").take(own),
                        pa.array(name.view(np.int64)),
                        pa.array(digest.view(np.int64)),
                        pa.array(begin - base),
                        pa.array(end - base),
                        pa.array(anchor - base),
                    ],
                    ["id", "tkey", "name", "digest", "begin", "end", "anchor"],
                )


# Suffix arrays


def _named(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the sorted rows of ``keys``, the same for equal rows; by row."""
    fresh = np.zeros(len(order), bool)
    for key in keys:
        k = key[order]
        fresh[1:] |= k[1:] != k[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(fresh) + 1
    return names


def _key(bits: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Pairs of numbers as one, in the order of the pairs; ``low`` has ``bits`` bits at most."""
    return high.astype(np.int64) << bits | low


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``codes`` (positive integers) in order of their first ``depth`` codes at least.

    Difference cover modulo 3. Suffixes that agree on ``depth`` codes may stand in any order.
    """
    n = len(codes)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: codes[i:].tolist()), np.int64)
    if int(codes.max()) >> 31:  # smaller numbers, so that two of them fit into one
        codes = np.unique(codes, return_inverse=True)[1] + 1
    t = np.concatenate([codes.astype(np.int64), np.zeros(3, np.int64)])
    ones = np.arange(1, n + (n % 3 == 1), 3)  # one place past the end keeps the two halves apart
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    width = max(1, int(t.max()).bit_length())
    if 3 * width <= 63:
        packed = t[sample] << (2 * width) | t[sample + 1] << width | t[sample + 2]
        order = np.argsort(packed)
        names = _named(order, packed)
    else:
        a, b, c = t[sample], t[sample + 1], t[sample + 2]
        order = np.lexsort((c, b, a))
        names = _named(order, a, b, c)
    if depth > 3 and int(names.max()) < len(sample):
        ranked = suffix_array(names, -(-depth // 3))
        order = ranked
    rank = np.zeros(n + 4, np.int64)
    by_sample = np.empty(len(sample), np.int64)
    by_sample[order] = np.arange(1, len(sample) + 1)
    rank[sample] = by_sample
    sample_sorted = sample[order]
    sample_sorted = sample_sorted[sample_sorted < n]

    # Each remaining suffix goes behind the lesser ones of either half of the sample, which are
    # sorted by the same keys: two merges of sorted numbers.
    rest = np.arange(0, n, 3)
    bits = len(sample).bit_length()
    first = _key(bits, t[rest], rank[rest + 1])
    along = np.argsort(first)
    rest, first = rest[along], first[along]
    one = sample_sorted[sample_sorted % 3 == 1]
    two = sample_sorted[sample_sorted % 3 == 2]
    low = np.searchsorted(_key(bits, t[one], rank[one + 1]), first)
    ahead, own = _key(width, t[two], t[two + 1]), _key(width, t[rest], t[rest + 1])
    if bits + 2 * width > 63:  # pairs of codes by their order among those that there are
        names = np.unique(np.concatenate([ahead, own]), return_inverse=True)[1]
        ahead, own = names[: len(two)], names[len(two) :]
    low += np.searchsorted(_key(bits, ahead, rank[two + 2]), _key(bits, own, rank[rest + 2]))
    out = np.empty(n, np.int64)
    low = np.maximum.accumulate(low)  # ties within the depth may leave it uneven
    places = low + np.arange(len(rest))
    out[places] = rest
    free = np.ones(n, bool)
    free[places] = False
    out[free] = sample_sorted
    return out


def equal_neighbours(data: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours in ``order`` whose next ``length`` bytes are the same, byte for byte."""
    first, second = order[:-1], order[1:]
    if not len(first):
        return first, second
    step = min(8, length)
    strings = np.lib.stride_tricks.sliding_window_view(data, step)
    packed = np.zeros(len(strings), np.uint64)
    for k in range(step):
        packed |= strings[:, k].astype(np.uint64) << np.uint64(8 * k)
    for at in [*range(0, length - step, step), length - step]:
        same = packed[first + at] == packed[second + at]
        first, second = first[same], second[same]
    return first, second


def repeated_strings(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, the places from which its next ``length`` bytes also start elsewhere."""
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    codes = np.empty(starts[-1], np.int64)
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    codes[:] = data
    codes += 1
    codes[starts[1:] - 1] = 257 + np.arange(len(parts))  # every end is a code of its own
    order = suffix_array(codes, length)
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    whole = order + length < starts[owner[order] + 1]
    order = order[whole]
    first, second = equal_neighbours(data, order, length)
    found = np.zeros(len(codes), bool)
    found[first] = True
    found[second] = True
    return [np.flatnonzero(found[starts[i] : starts[i] + sizes[i]]) for i in range(len(parts))]


def shared_passages(parts: list[list[bytes]], owners: list[bytes], words: int) -> list[np.ndarray]:
    """For each part, a list of words, the places from which its next ``words`` words also start
    in a part of another owner."""
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    part_of = np.repeat(np.arange(len(parts)), sizes + 1)
    numbers = pa.array(itertools.chain.from_iterable(parts), pa.large_binary()).dictionary_encode()
    codes = np.empty(starts[-1], np.int64)
    inner = np.ones(len(codes), bool)
    inner[starts[1:] - 1] = False
    codes[inner] = numbers.indices.to_numpy() + 1
    codes[~inner] = len(numbers.dictionary) + 1 + np.arange(len(parts))  # every end is a code of its own
    order = suffix_array(codes, words)
    order = order[order + words < starts[part_of[order] + 1]]
    found = np.zeros(len(codes), bool)
    if len(order):
        first, second = order[:-1], order[1:]
        live = np.arange(len(first))
        for k in range(words):
            live = live[codes[first[live] + k] == codes[second[live] + k]]
        fresh = np.ones(len(order), bool)
        fresh[live + 1] = False
        whose: dict[bytes, int] = {}
        owner = np.array([whose.setdefault(o, len(whose)) for o in owners])[part_of[order]]
        runs = np.flatnonzero(fresh)
        shared = np.minimum.reduceat(owner, runs) != np.maximum.reduceat(owner, runs)
        found[order] = shared[np.cumsum(fresh) - 1]
    return [np.flatnonzero(found[starts[i] : starts[i] + sizes[i]]) for i in range(len(parts))]


def _word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(data, np.uint8)
    starts, ends, _ = word_spans(IS_WORD[flat], np.array([0, len(flat)]))
    return starts, ends


def _runs(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Spans of the strings at ``places``, one for each run of neighbours."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    first = places[np.concatenate([[0], cut + 1])]
    last = places[np.concatenate([cut, [len(places) - 1]])]
    return list(zip(first.tolist(), (last + length).tolist(), strict=True))


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the first low bytes agree, the first high do not
    while high - low > 1:
        middle = (low + high) >> 1
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _reach(parts: list[bytes]) -> list[int]:
    """Longest common prefix of each part with another one: that with a neighbour in order."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    reach = [0] * len(parts)
    for a, b in zip(order, order[1:], strict=False):
        n = _common(parts[a], parts[b])
        reach[a] = max(reach[a], n)
        reach[b] = max(reach[b], n)
    return reach


def trimmed(parts: list[tuple[int, bytes]], length: int) -> list[tuple[int, int]]:
    """What can repeat of segments (anchor, bytes) that share their anchor's gram.

    A string agrees with another on both sides of the anchor, so it lies within the furthest
    agreement to the left and to the right. Where that is too short the range is empty.
    """
    left = _reach([data[:anchor][::-1] for anchor, data in parts])
    right = _reach([data[anchor:] for anchor, data in parts])
    spans = [(anchor - a, anchor + b) for (anchor, _), a, b in zip(parts, left, right, strict=True)]
    return [(a, b) if b - a >= length else (0, 0) for a, b in spans]


@frees
def _compare(batches: Iterator[pa.RecordBatch], length: int, words: int) -> Iterator[pa.RecordBatch]:
    """Repeated spans of the segments of each name; rows of a name are neighbours."""
    group: list[tuple] = []
    held: list[tuple] = []
    said: list[tuple] = []  # segments of words
    size = 0

    def close() -> int:
        """Move what can repeat of the last name's segments to the next suffix array."""
        kept = 0
        if group[0][0] & 1:
            for row in group:
                said.append((row[1], row[2], row[4], row[5]))
                kept += len(row[5])
        else:
            for row, (a, b) in zip(group, trimmed([(g[3] - g[2], g[5]) for g in group], length), strict=True):
                if b:
                    held.append((row[1], row[2] + a, row[4], row[5][a:b]))
                    kept += b - a
        group.clear()
        return kept

    def work() -> pa.RecordBatch:
        out = []
        for (tkey, begin, single, _), places in zip(held, repeated_strings([h[3] for h in held], length), strict=True):
            if single:
                out += [(tkey, begin + a, begin + b, False) for a, b in _runs(places, length)]
        held.clear()
        shared = shared_passages([s[3].split() for s in said], [s[0] for s in said], words) if said else []
        for (tkey, begin, single, data), places in zip(said, shared, strict=True):
            if single and len(places):
                starts, ends = _word_places(data)
                out += [(tkey, begin + int(starts[a]), begin + int(ends[b - 1]), True) for a, b in _runs(places, words)]
        said.clear()
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tkey", "begin", "end", "words"]
        )

    for batch in batches:
        columns = ("name", "tkey", "begin", "anchor", "single", "bytes")
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if group and row[0] != group[-1][0]:
                size += close()
                if size >= ARRAY_BYTES:
                    yield work()
                    size = 0
            group.append(row)
    if group:
        close()
    if held or said:
        yield work()


@frees
def _string_names(batches: Iterator[pa.RecordBatch], length: int, words: int) -> Iterator[pa.RecordBatch]:
    """128-bit names of all strings of the segments of very common names."""
    for batch in batches:
        for row in range(batch.num_rows):
            data = batch.column("bytes")[row].as_py()
            by_words = bool(batch.column("name")[row].as_py() & 1)
            if by_words:
                said = data.split()
                starts, ends = _word_places(data)
                strings = [b" ".join(said[i : i + words]) for i in range(len(said) - words + 1)]
                begin, end = starts[: len(strings)], ends[words - 1 :]
            else:
                strings = [data[i : i + length] for i in range(len(data) - length + 1)]
                begin = np.arange(len(strings))
                end = begin + length
            both = b"".join([hashlib.blake2b(s, digest_size=16).digest() for s in strings])
            a, b = np.frombuffer(both, np.int64).reshape(-1, 2).T
            n, base = len(strings), batch.column("begin")[row].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(a),
                    pa.array(b),
                    pa.array([batch.column("tkey")[row].as_py()] * n, pa.binary()),
                    pa.array(begin + base),
                    pa.array(end + base),
                    pa.array([batch.column("single")[row].as_py()] * n, pa.bool_()),
                    pa.array([by_words] * n, pa.bool_()),
                ],
                ["a", "b", "tkey", "begin", "end", "single", "words"],
            )


@frees
def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts whose segments are asked for, cut up: one row for each."""
    for batch in batches:
        flat, offsets = utf8(batch.column("text"))
        whole = memoryview(flat)
        of, wanted = _flat(batch.column("wanted"))
        base = offsets[of]
        edges = base + wanted["begin"].to_numpy(), base + wanted["end"].to_numpy()
        for low in range(0, len(of), 4096):
            some = slice(low, low + 4096)
            parts = [whole[a:b] for a, b in zip(edges[0][some].tolist(), edges[1][some].tolist(), strict=True)]
            columns = {c: wanted[c][some] for c in ("name", "begin", "anchor", "single", "hot")}
            columns |= {"tkey": batch.column("tkey").take(pa.array(of[some])), "bytes": pa.array(parts, pa.binary())}
            names = ["name", "tkey", "begin", "anchor", "single", "hot", "bytes"]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def _flat(lists: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Lists of structs side by side: the row of each struct, and its fields; a null list is empty."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    inner = lists.flatten()
    fields = dict(zip((f.name for f in inner.type), inner.flatten(), strict=True))
    return np.repeat(np.arange(len(lists)), counts), fields


def _elsewhere(words: Column) -> Column:
    """Of a group: whether a string of bytes occurs again, or one of words in another text.

    Texts are told apart by 64 bits of their key.
    """
    text = F.xxhash64("tkey")
    return F.when(words, F.min(text) != F.max(text)).otherwise(F.count(F.lit(1)) > 1)


def repeated_spans(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    id_column: str = "doc_id",
    text: str = "text",
    max_segments: int = MAX_SEGMENTS,
    passage_words: int = 0,
) -> DataFrame:
    """(tkey, begin, end, words): spans of bytes to remove, by text; spans of one text may overlap.

    With ``passage_words``, also the spans (``words`` is true) of passages of so many words or
    more that another document has too; these are not to remove.
    """
    ship(docs.sparkSession)
    gram = min(gram, length)
    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(F.col(id_column).alias("id"), text_key(text).alias("tkey"), F.col(text).alias("text"))
    least = min(length, 2 * passage_words - 1) if passage_words else length
    found = slim.where(F.octet_length("text") >= least).mapInArrow(
        lambda batches: _anchors(batches, length, gram, passage_words),
        f"id {kind}, tkey binary, name long, digest long, begin long, end long, anchor long",
    )
    # What a step has shuffled, and the anchors, are done with once its table stands.
    anchors = written(found, "anchors")
    by_words = F.col("name").bitwiseAND(F.lit(1)) == 1
    common = anchors.groupBy("name").agg(_elsewhere(by_words).alias("again")).where("again").select("name")
    # Written, so that the join is of two bare shuffles and a common name's rows can be split.
    common = written(common, "names", shuffles_go=True)
    repeated = written(anchors.join(common, "name", "left_semi"), "repeated", shuffles_go=True)
    dropped(anchors)

    variants = repeated.groupBy("name", "digest").agg(
        _elsewhere(by_words).alias("again"),
        (F.min("begin") != F.max("begin")).alias("spread"),
        F.min(F.struct("id", "tkey", "begin", "end", "anchor")).alias("at"),
    )
    variants = written(variants, "variants", shuffles_go=True)
    # All places of the variants that repeat, and of those that stand twice in one text alone.
    placed = variants.where("again or spread").select("name", "digest", "again", "at.begin")
    placed = placed.withColumnsRenamed({"name": "v_name", "digest": "v_digest", "begin": "v_begin"})
    same = (repeated["name"] == placed["v_name"]) & (repeated["digest"] == placed["v_digest"])
    places = repeated.join(placed, same)
    whole = places.where("again").select("tkey", "begin", "end", by_words.alias("words"))
    further = places.where(~F.col("again") & (F.col("begin") != F.col("v_begin")))
    further = further.groupBy("name", "tkey", "begin", "end", "anchor").agg(F.min("id").alias("id"))

    stats = variants.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_variants"), F.count_if(~F.col("again")).alias("n_single")
    )
    # Very common names are told before there are any bytes, so that these are shuffled once.
    undecided = variants.join(stats.where("n_variants > 1 and n_single > 0"), "name")
    undecided = undecided.withColumns({"single": ~F.col("again"), "hot": F.col("n_variants") > max_segments})
    asked = undecided.select("at.id", "at.tkey", "name", "at.begin", "at.end", "at.anchor", "single", "hot")
    if passage_words:
        hot = stats.where(F.col("n_variants") > max_segments).select("name", F.lit(True).alias("found"))
        further = further.join(hot, "name", "left").withColumns({"single": F.lit(True), "hot": F.col("found").isNotNull()})
        asked = asked.unionByName(further.drop("found"))
    wanted = asked.groupBy("id", "tkey").agg(
        F.collect_list(F.struct("name", "begin", "end", "anchor", "single", "hot")).alias("wanted")
    )
    wanted = wanted.withColumnsRenamed({"id": "r_id", "tkey": "r_tkey"})
    texts = slim.join(wanted, slim["id"].eqNullSafe(wanted["r_id"]) & (slim["tkey"] == wanted["r_tkey"]))
    cut = texts.select("tkey", "text", "wanted").mapInArrow(
        _cut_out, "name long, tkey binary, begin long, anchor long, single boolean, hot boolean, bytes binary"
    )
    cut = written(cut, "segments", shuffles_go=True)
    near = cut.where("not hot").drop("hot").repartition("name").sortWithinPartitions("name")
    near = near.mapInArrow(
        lambda batches: _compare(batches, length, passage_words), "tkey binary, begin long, end long, words boolean"
    )
    strings = cut.where("hot").mapInArrow(
        lambda batches: _string_names(batches, length, passage_words),
        "a long, b long, tkey binary, begin long, end long, single boolean, words boolean",
    )
    # A string that occurs once is none to remove; of the others, those in a single segment are new.
    counted = strings.groupBy("a", "b", "words").agg(_elsewhere(F.col("words")).alias("again")).where("again")
    far = strings.where("single").join(counted, ["a", "b", "words"], "left_semi")
    spans = whole.unionByName(near).unionByName(far.select("tkey", "begin", "end", "words"))
    if not passage_words:
        return spans
    # A text that several documents have is a passage of all of them.
    copied = slim.groupBy("tkey").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("end"))
    copied = copied.where("n > 1 and end > 0")
    return spans.unionByName(
        copied.select("tkey", F.lit(0).cast("long").alias("begin"), F.col("end").cast("long"), F.lit(True).alias("words"))
    )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def on_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the bytes of characters that are only partly covered."""
    out = []
    for begin, end in spans:
        while begin < end and data[begin] & 0xC0 == 0x80:
            begin += 1
        while begin < end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if begin < end:
            out.append((begin, end))
    return out


def longest_passage(data: bytes, spans: list[tuple[int, int]], least: int) -> int:
    """Words of the longest of the spans, overlapping ones together; 0 if it has fewer than ``least``."""
    most = max((len(data[a:b].split()) for a, b in merged(spans)), default=0)
    return most if most >= least else 0


@frees
def _remove(
    batches: Iterator[pa.RecordBatch], keep: list[str], whole_characters: bool, passage_words: int
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets = utf8(batch.column("text_"))
        sizes, gone, counts, digests, kept, ranges, longest = [], [], [], [], [], [], []
        of, found = _flat(batch.column("spans_"))
        firsts = np.searchsorted(of, np.arange(batch.num_rows + 1)).tolist()
        found = list(zip(*(found[c].to_pylist() for c in ("begin", "end", "words")), strict=True))
        for row, (low, high) in enumerate(itertools.pairwise(firsts)):
            data = flat[offsets[row] : offsets[row + 1]].tobytes()
            longest.append(longest_passage(data, [(a, b) for a, b, words in found[low:high] if words], passage_words))
            spans = merged([(a, b) for a, b, words in found[low:high] if not words])
            if whole_characters:
                spans = on_characters(data, spans)
            edges = [0, *(x for s in spans for x in s), len(data)]
            rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else data
            sizes.append(len(data))
            gone.append(len(data) - len(rest))
            counts.append(len(spans))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
            ranges.append([{"begin": a, "end": b} for a, b in spans])
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in keep),
                pa.array(sizes, pa.int64()),
                pa.array(gone, pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(kept, pa.binary()),
                pa.array(ranges, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                *([pa.array(longest, pa.int64())] if passage_words else []),
            ],
            [*keep, *NEW, *(["shared_words"] if passage_words else [])],
        )


NEW = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans"]
ADDED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary, spans array<struct<begin:long,end:long>>"


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    id_column: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    whole_characters: bool = False,
    passage_words: int = 0,
    **options: int,
) -> DataFrame:
    """Each row with what is left of its text (bytes, spans removed, digest).

    ``keep`` names the input columns that stay, all by default; those that clash with a new
    column give way. Null and empty texts have no bytes; texts shorter than ``length`` stay
    whole; of repeated texts every copy is cut alike. ``whole_characters`` leaves characters
    that a span covers in part, so that the rest is valid UTF-8.

    With ``passage_words`` there is one more column, ``shared_words``: the words
    (``[^\\x20\\x09-\\x0D]+``) of the text's longest passage whose every word lies in a run of
    ``passage_words`` words that another document has too, overlapping runs taken together; 0
    without one. A text that several documents have is such a passage if it is long enough.
    """
    names = [*NEW, "shared_words", "text_", "spans_", "tkey_"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    spans = repeated_spans(docs, length, id_column=id_column, text=text, passage_words=passage_words, **options)
    by_text = spans.groupBy("tkey").agg(F.collect_set(F.struct("begin", "end", "words")).alias("spans_"))
    rows = docs.select(*keep, F.col(text).alias("text_"), text_key(text).alias("tkey_"))
    rows = rows.join(by_text, rows["tkey_"] == by_text["tkey"], "left").drop("tkey", "tkey_")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    added = f"{ADDED}, shared_words long" if passage_words else ADDED
    return rows.mapInArrow(
        lambda batches: _remove(batches, keep, whole_characters, passage_words), f"{fields}, {added}" if fields else added
    )
