"""Phrase collocations by mergeable Misra-Gries summaries and an exact second pass.

Blocks. Texts are lower-cased (A-Z), cut into pieces and words, and stored per language in blocks
of some ``BLOCK_BYTES``: the block's different words, and the words of its pieces as numbers.

First pass. Each block counts its n-grams of up to ``longest`` words under a hash and deals them to
hash partitions, so many that one holds some ``PARTITION_MASS`` occurrences whatever the corpus;
there 32 bits tell n-grams apart. A block's part of a partition is a Misra-Gries summary without error; a partition's
summaries are merged one after the other at a capacity above its occurrences over the threshold:
where a merge leaves more counters, the largest counter beyond the capacity is subtracted from
all, and what is not above zero goes. All that is ever subtracted stays below the threshold, so
every n-gram that occurs so often keeps a counter; keys that meet by chance only add some that
do not. The survivors go back to the blocks in which they occur.

Second pass. Each block counts its surviving n-grams by word numbers, not by keys, and the sums
over blocks are the exact frequencies; what is below the threshold goes. Parts of a frequent
phrase are as frequent, so the left and right frequencies of every cut are at hand. Scores are
whole divisions of decimals with 38 digits: exact for up to 10**15 occurrences of a phrase.

Memory: a task holds a block, or a partition's summaries (5 bytes for each different n-gram that
a block has in it). Nothing is broadcast or collected.

Edge cases: null and empty texts have no words; a null language is ``und``; rows without id,
repeated rows and rows in any order all count; ties go by a and then by the phrase's bytes; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stockflow.llm.common import LOWER_TABLE, mix, ship, utf8, written

BLOCK_BYTES = 8 << 20
PARTITION_MASS = 4_000_000
BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
BLANK = np.zeros(256, bool)
BLANK[list(b" \t")] = True

BLOCKS = "block string, lang string, n_words long, mass long, words binary, places binary"
SUMMARIES = "part long, block string, keys binary, counts binary"


def cut_words(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of ``data``, each word's number among them, and where pieces begin."""
    flat = LOWER_TABLE[np.frombuffer(data, np.uint8)]
    ends_piece = BREAK[flat]
    is_word = ~(ends_piece | BLANK[flat])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], is_word.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    values = flat[is_word]
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values)]
    ).dictionary_encode()
    pieces = np.cumsum(ends_piece)[starts] if len(starts) else np.zeros(0, np.int64)
    begins = np.diff(pieces, prepend=-1) != 0
    return words.dictionary, words.indices.to_numpy().astype(np.uint32), begins


def block_row(block: str, lang: str, data: bytes, longest: int) -> dict:
    words, ids, begins = cut_words(data)
    places = ids << np.uint32(1) | begins
    lengths = np.diff(np.append(np.flatnonzero(begins), len(begins)))
    mass = sum(int(np.maximum(lengths - n, 0).sum()) for n in range(longest))
    packed = zstandard.ZstdCompressor(level=1).compress(places.tobytes())
    return {"block": block, "lang": lang, "n_words": len(ids), "mass": mass, "words": b" ".join(words.to_pylist()), "places": packed}


def word_blocks(docs: DataFrame, longest: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``BLOCKS`` of the texts of ``docs`` (lang, text)."""
    arrow = to_arrow_schema(StructType.fromDDL(BLOCKS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, {}, 0
        for batch in batches:
            data, offsets = utf8(batch["text"])
            langs = batch["lang"].to_pylist()
            for row in range(batch.num_rows):
                text = data[offsets[row] : offsets[row + 1]].tobytes()
                held.setdefault(langs[row], []).append(text)
                size += len(text)
                if size >= block_bytes:
                    for lang, texts in held.items():
                        made += 1
                        yield pa.RecordBatch.from_pylist([block_row(f"{task}-{made}", lang, b"\n".join(texts), longest)], arrow)
                    held, size = {}, 0
        for lang, texts in held.items():
            made += 1
            yield pa.RecordBatch.from_pylist([block_row(f"{task}-{made}", lang, b"\n".join(texts), longest)], arrow)

    ship(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text != ''")
    return rows.mapInArrow(cut, BLOCKS)


class Block:
    """A stored block: its words, the words' places and the n-grams by length."""

    def __init__(self, lang: str, words: bytes, places: bytes):
        self.words = words.split(b" ") if words else []
        codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(places), np.uint32)
        self.ids = (codes >> np.uint32(1)).astype(np.int64)
        self.follows = (codes & np.uint32(1)) == 0  # on a word of its piece
        salt = lang.encode()
        digests = b"".join(blake2b(w, digest_size=8, key=blake2b(salt, digest_size=32).digest()).digest() for w in self.words)
        self.word_keys = np.frombuffer(digests, np.uint64)

    def grams(self, longest: int, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first places, keys) of all n-grams of each length.

        A key is the hash partition, from the hash's upper half, above the hash's lower half.
        """
        half = np.uint64(32)
        first, keys = np.arange(len(self.ids)), self.word_keys[self.ids]
        for n in range(1, longest + 1):
            if n > 1:
                last = first + (n - 1)
                keep = np.flatnonzero(last < len(self.ids))
                keep = keep[self.follows[last[keep]]]
                first = first[keep]
                keys = mix(keys[keep] * np.uint64(0x9E3779B97F4A7C15) + self.word_keys[self.ids[first + (n - 1)]])
            part = (keys >> half) * np.uint64(parts) >> half
            yield n, first, part << half | keys & np.uint64(0xFFFFFFFF)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable") if counts is not None else None
    keys = keys[order] if order is not None else np.sort(keys)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[starts], np.diff(np.append(starts, len(keys)))
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


class Summary:
    """A Misra-Gries summary of at most ``capacity`` counters after each merge."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0
        self.subtracted = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting >= self.capacity:
            self.settle()

    def settle(self) -> None:
        keys, counts = zip((self.keys, self.counts), *self.waiting, strict=True)
        self.keys, self.counts = summed(np.concatenate(keys), np.concatenate(counts))
        self.waiting, self.n_waiting = [], 0
        if len(self.keys) > self.capacity:
            beyond = len(self.counts) - 1 - self.capacity
            least = int(np.partition(self.counts, beyond)[beyond])
            self.subtracted += least
            stays = self.counts > least
            self.keys, self.counts = self.keys[stays], self.counts[stays] - least

    def frequent(self, threshold: int) -> np.ndarray:
        """Sorted keys that may occur ``threshold`` times, among them all that do."""
        self.settle()
        return self.keys[self.counts + self.subtracted >= threshold]


def packed_counts(counts: np.ndarray) -> bytes:
    """One byte a count; from 255 on, the count follows at the end in 8 bytes."""
    large = counts[counts >= 255]
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype(np.int64).tobytes()


def unpacked_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.int64, offset=n)
    return counts


def summaries(blocks: DataFrame, longest: int, parts: int) -> DataFrame:
    """Each block's counted n-grams by hash partition."""
    arrow = to_arrow_schema(StructType.fromDDL(SUMMARIES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                [row] = batch.slice(i, 1).to_pylist()
                block = Block(row["lang"], row["words"], row["places"])
                keys, counts = summed(np.concatenate([k for _, _, k in block.grams(longest, parts)]))
                part, keys = (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32)
                starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                made = [
                    {"part": int(part[a]), "block": row["block"], "keys": keys[a:b].tobytes(), "counts": packed_counts(counts[a:b])}
                    for a, b in zip(starts, [*starts[1:], len(part)], strict=True)
                ]
                for a in range(0, len(made), 64):
                    yield pa.RecordBatch.from_pylist(made[a : a + 64], arrow)

    filled = blocks.filter("n_words > 0")
    return filled.select("block", "lang", "words", "places").mapInArrow(count, SUMMARIES)


def survivors(parts: DataFrame, threshold: int) -> DataFrame:
    """(block, part, keys): the keys of each block that survive the merge of their partition."""
    schema = "block string, part long, keys binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def merge(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_pylist()
        keys = [np.frombuffer(k.as_buffer(), np.uint32) for k in table["keys"]]
        counts = [unpacked_counts(c.as_py(), len(k)) for c, k in zip(table["counts"], keys, strict=True)]
        mass = sum(int(c.sum()) for c in counts)
        summary = Summary(mass // threshold + 1)
        for k, c in zip(keys, counts, strict=True):
            summary.merge(k, c)
        stays = summary.frequent(threshold)
        assert summary.subtracted < threshold
        kept = [k[np.isin(k, stays, assume_unique=True)].tobytes() for k in keys]
        return pa.Table.from_pydict({"block": blocks, "part": table["part"], "keys": kept}, schema=arrow)

    return parts.groupBy("part").applyInArrow(merge, schema)


def phrase_counts(blocks: DataFrame, kept: DataFrame, longest: int, parts: int) -> DataFrame:
    """lang, phrase, length and f of every surviving n-gram of each block, by its words."""
    schema = "lang string, phrase string, length int, f long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        made = {"lang": [], "phrase": [], "length": [], "f": []}
        for row in left.to_pylist():
            wanted = [
                np.frombuffer(k, np.uint32) + (np.uint64(part) << np.uint64(32))
                for part, k in zip(right["part"].to_pylist(), right["keys"].to_pylist(), strict=True)
            ]
            wanted = np.sort(np.concatenate([np.zeros(0, np.uint64), *wanted]))
            if not len(wanted):
                continue
            block = Block(row["lang"], row["words"], row["places"])
            for n, first, keys in block.grams(longest, parts):
                at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                first = first[wanted[at] == keys]
                grams = np.stack([block.ids[first + i] for i in range(n)])
                order = np.lexsort(grams)
                grams = grams[:, order]
                new = np.any(grams[:, 1:] != grams[:, :-1], axis=0)
                starts = np.flatnonzero(np.concatenate(([True], new))) if len(first) else np.zeros(0, np.int64)
                for gram in grams[:, starts].T.tolist():
                    made["phrase"].append(b" ".join([block.words[i] for i in gram]).decode())
                made["f"] += np.diff(np.append(starts, len(first))).tolist()
                made["length"] += [n] * len(starts)
                made["lang"] += [row["lang"]] * len(starts)
        return pa.Table.from_pydict(made, schema=arrow)

    slim = blocks.select("block", "lang", "words", "places")
    return slim.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(count, schema)


def frequent_phrases(docs: DataFrame, threshold: int = 10, longest: int = 3, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, f) of all phrases that occur ``threshold`` times, and (lang, n)."""
    spark = docs.sparkSession
    blocks = written(word_blocks(docs, longest, block_bytes), "word_blocks")
    mass = blocks.agg(F.sum("mass")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-mass // PARTITION_MASS))
    kept = survivors(summaries(blocks, longest, parts), threshold)
    counts = phrase_counts(blocks, kept, longest, parts)
    sums = counts.groupBy("lang", "phrase", "length").agg(F.sum("f").alias("f")).filter(F.col("f") >= threshold)
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return written(sums, "phrases"), written(totals, "words_by_lang")


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exactly."""
    wide = "CAST({} AS DECIMAL(15, 0))"
    a, left, right = wide.format(a), wide.format(left), wide.format(right)
    return F.expr(f"({a} * {a} * CAST(1000000 AS DECIMAL(7, 0))) DIV ({left} * {right})")


def collocations(
    docs: DataFrame,
    threshold: int = 10,
    longest: int = 3,
    inside_percent: int = 50,
    top: int = 2000,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each language's best ``top`` phrases of 2 to ``longest`` words: rank, a, l, r, n, score.

    A cut after k words has score floor(1000000 a a / (l r)); the lowest-scoring cut counts, the
    first among equals. A phrase goes whose words lie contiguously inside a longer one with
    ``inside_percent`` of its frequency.
    """
    found, totals = frequent_phrases(docs, threshold, longest, block_bytes)
    split = F.split("phrase", " ")
    candidates = found.filter("length > 1").select("lang", "phrase", "length", F.col("f").alias("a"))

    cuts = candidates.select("*", F.explode(F.expr("sequence(1, length - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(split, 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice(split, F.col("k") + 1, F.col("length") - F.col("k")), " ").alias("rest"),
    )
    part = found.select(F.col("lang").alias("lang_"), F.col("phrase").alias("part"), "f")
    for name, value in (("first", "l"), ("rest", "r")):
        same = (cuts["lang"] == part["lang_"]) & (cuts[name] == part["part"])
        cuts = cuts.join(part, same).withColumnRenamed("f", value).drop("lang_", "part")
    best = F.min(F.struct(score("a", "l", "r").alias("score"), "k", "l", "r")).alias("best")
    scored = cuts.groupBy("lang", "phrase", "a").agg(best)

    inner = candidates.filter("length > 2").select("*", F.explode(F.expr("sequence(2, length - 1)")).alias("m"))
    inner = inner.select("*", F.explode(F.expr("sequence(1, length - m + 1)")).alias("at"))
    inner = inner.select(
        F.col("lang").alias("lang_"), F.array_join(F.slice(split, F.col("at"), F.col("m")), " ").alias("part"), "a"
    )
    longer = inner.groupBy("lang_", "part").agg(F.max("a").alias("longer"))
    same = (scored["lang"] == longer["lang_"]) & (scored["phrase"] == longer["part"])
    within = F.coalesce(100 * F.col("longer").cast("decimal(20,0)") >= inside_percent * F.col("a").cast("decimal(20,0)"), F.lit(False))
    scored = scored.join(longer, same, "left").filter(~within)

    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n",
        F.col("best.score").cast("long").alias("score"),
    )
