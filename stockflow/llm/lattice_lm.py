"""Document log-probabilities from a subword lattice.

A text is its words (A-Z lower-cased, parted by ASCII blanks), then an end. A token costs:

* the end: (c + 1/2) / (N + 1), where c of the N training tokens are ends;
* a word w: (c - d) / (N + 1) if it occurs in training, plus g * S(w), where d is the absolute
  discount n1 / (n1 + 2 n2) and g = (d V + 1/2) / (N + 1) is the mass that discounting V words
  leaves for new ones.

S(w) is the marginal probability of the word's bytes over all segmentations into the pieces of
an existing subword vocabulary (and single bytes): a product of unigram piece scores, where the
last piece of a word has a score of its own, summed by a forward recursion in log space over
the whole word, however long it is. All
arcs of the lattice together, whole words and pieces, sum to 1, so scores are probabilities.

The vocabulary is read, not trained. The piece scores are fitted by expectation maximisation
over all different training words; word counts are those of the whole training part. Words are
counted once per chunk of documents in tasks, S(w) is computed once per training word and once
per chunk for each new one, and chunks, words and counts meet in ordinary shuffles: the tables grow with the corpus and none is collected or broadcast. What is, the
piece scores, has the size of the vocabulary. No row holds a whole chunk: its documents go in rows
of about a megabyte of text, its words one by one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import LOWER, frees, ship, utf8, written

CHUNK_BYTES = 8 << 20
ROW_BYTES = 1 << 20  # bytes of a chunk's documents in one row
MAX_PIECE = 8  # bytes that one code holds; longer pieces are compared byte by byte
LONG = 256  # bytes; a longer word is scored alone, the others side by side
BLOCK = 1 << 14  # bytes of a long word at once
BYTES_AT_ONCE = 1 << 17  # bytes of other words at once
ROUNDS = 3


def subword_vocabulary(path: str) -> list[bytes]:
    """All pieces of a sentencepiece file, lower-cased, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", "").encode().translate(LOWER)
            if piece:
                pieces.add(piece)
    return sorted(pieces)


class Lattice:
    """Piece numbers by byte string, and log scores inside a word (0) and at its end (1)."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray | None = None):
        self.pieces = pieces
        n = len(pieces)
        self.scores = np.full((2, n), -np.log(2 * n)) if scores is None else scores
        self.longest = max(map(len, pieces))
        self.codes, self.numbers, self.maybe = {}, {}, {}
        for size in range(1, self.longest + 1):
            mine = sorted((p, i) for i, p in enumerate(pieces) if len(p) == size)
            self.numbers[size] = np.array([i for _, i in mine], np.int32)
            head = np.array([int.from_bytes(p[:MAX_PIECE], "big") for p, _ in mine], np.uint64)
            tail = np.array([int.from_bytes(p[-MAX_PIECE:], "big") for p, _ in mine], np.uint64)
            short = size <= MAX_PIECE
            self.codes[size] = tail if short else np.array([p for p, _ in mine], f"S{size}")
            self.maybe[size] = np.zeros(1 << 16, bool)
            self.maybe[size][self._mark(tail if short else self._ends(head, tail))] = True

    @staticmethod
    def _mark(codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)

    @staticmethod
    def _ends(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """One code of the first and the last MAX_PIECE bytes of a longer piece."""
        return tail + head * np.uint64(0xD1342543DE82EF95)

    def arcs(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each byte (row) and size (column, from 1), one more than the number of the piece that
        ends there, or 0; ``at`` counts the bytes of the word up to and with it."""
        found = np.zeros((len(data), self.longest), np.int32)
        codes = data.astype(np.uint64)
        for size in range(1, min(MAX_PIECE, self.longest) + 1):
            if 1 < size <= len(data):
                codes[size - 1 :] |= data[: len(data) - size + 1].astype(np.uint64) << np.uint64(8 * (size - 1))
            where = np.flatnonzero((at >= size) & self.maybe[size][self._mark(codes)])
            self._find(found, size, where, codes[where])
        far = np.flatnonzero(at > MAX_PIECE)
        for size in range(MAX_PIECE + 1, self.longest + 1):
            far = far[at[far] >= size]
            mark = self._mark(self._ends(codes[far - size + MAX_PIECE], codes[far]))
            where = far[self.maybe[size][mark]]
            # All keys have this size, so padding with zeros makes none equal: the search is exact.
            spans = data[where[:, None] + np.arange(1 - size, 1)]
            self._find(found, size, where, np.ascontiguousarray(spans).view(f"S{size}").reshape(-1))
        return found

    def _find(self, found: np.ndarray, size: int, where: np.ndarray, keys: np.ndarray) -> None:
        if len(where) and len(self.codes[size]):
            place = np.minimum(np.searchsorted(self.codes[size], keys), len(self.codes[size]) - 1)
            hit = self.codes[size][place] == keys
            found[where[hit], size - 1] = self.numbers[size][place[hit]] + 1


class Paths:
    """The arcs of some words, side by side: place k of all words with k or more bytes, from long
    to short, stands before place k + 1, so that a step is a run of places and of arcs."""

    def __init__(self, lattice: Lattice, words: list[bytes]):
        sizes = np.array([len(w) for w in words], np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        data = np.frombuffer(b"".join([words[i] for i in self.order]), np.uint8)
        word = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        # How many words reach each place, and where the places begin.
        reach = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0)) + 1), "right")
        self.begin = np.concatenate([[0], np.cumsum(reach)])
        turned = np.empty(len(data), np.int64)
        turned[self.begin[at] + word - len(sizes)] = np.arange(len(data))
        found = lattice.arcs(data, at)[turned]
        row, size = np.nonzero(found)
        self.number = found[row, size] - 1
        at, word = at[turned][row], word[turned][row]
        self.final = (at == sizes[word]).astype(np.int64)
        self.score = lattice.scores[self.final, self.number]
        self.target = row + len(sizes)
        self.source = self.begin[at - size - 1] + word
        self.ends = self.begin[sizes] + np.arange(len(sizes))

    def forward(self) -> np.ndarray:
        """Log sums from the start of the word to each place."""
        steps = range(1, len(self.begin) - 1)
        return self._sums(self.score, self.source, self.target, steps)

    def backward(self) -> np.ndarray:
        """Log sums from each place to the end of the word."""
        order = np.argsort(self.source, kind="stable")
        steps = range(len(self.begin) - 3, -1, -1)
        return self._sums(self.score[order], self.target[order], self.source[order], steps)

    def _sums(self, score: np.ndarray, source: np.ndarray, target: np.ndarray, steps: range) -> np.ndarray:
        # Single bytes are pieces, so each place but the outer ones has an arc from either side.
        sums = np.zeros(int(self.begin[-1]))
        first = np.flatnonzero(np.diff(target, prepend=-1))
        places, counts = target[first], np.diff(first, append=len(target))
        bounds = np.searchsorted(places, self.begin)
        first = np.append(first, len(target))
        for k in steps:
            a, b = bounds[k], bounds[k + 1]
            run = slice(first[a], first[b])
            starts = first[a:b] - first[a]
            terms = score[run] + sums[source[run]]
            top = np.maximum.reduceat(terms, starts)
            total = np.add.reduceat(np.exp(terms - np.repeat(top, counts[a:b])), starts)
            sums[places[a:b]] = top + np.log(total)
        return sums


def _groups(words: list[bytes]) -> Iterator[np.ndarray]:
    """Places of words up to LONG bytes that are scored together, from short to long."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    order = order[: np.searchsorted(sizes[order], LONG, "right")]
    before = np.concatenate([[0], np.cumsum(sizes[order])])
    start = 0
    while start < len(order):
        end = int(np.searchsorted(before, before[start] + BYTES_AT_ONCE, "right")) - 1
        yield order[start : max(start + 1, end)]
        start = max(start + 1, end)


class LongWord:
    """One word in blocks of bytes; each takes the last sums, as many as the longest piece has
    bytes, from the block before it. Memory does not depend on the length of the word."""

    def __init__(self, lattice: Lattice, word: bytes):
        self.lattice = lattice
        self.data = np.frombuffer(word, np.uint8)

    def arcs(self, first: int) -> tuple[list, ...]:
        """Of the block of places from ``first`` + 1: bounds by place, then sizes, scores, piece
        numbers and kinds of the arcs that end there."""
        begin, end = max(0, first - self.lattice.longest), min(first + BLOCK, len(self.data))
        data = self.data[begin:end]
        found = self.lattice.arcs(data, np.arange(1, len(data) + 1))[first - begin :]
        row, size = np.nonzero(found)
        number = found[row, size] - 1
        final = (row + first + 1 == len(self.data)).astype(np.int64)
        score = self.lattice.scores[final, number]
        bounds = np.searchsorted(row, np.arange(len(found) + 1))
        return bounds.tolist(), (size + 1).tolist(), score.tolist(), number, final

    def forward(self, carried: list[float], bounds: list[int], sizes: list[int], scores: list[float]) -> list[float]:
        """``carried``, which ends with the sum at the place before the block, and the block's sums."""
        sums = list(carried)
        for a, b in zip(bounds, bounds[1:]):  # noqa: B905
            n = len(sums)
            terms = [scores[j] + sums[n - sizes[j]] for j in range(a, b)]
            top = max(terms)
            sums.append(top + math.log(sum([math.exp(t - top) for t in terms])))
        return sums

    def carried(self) -> Iterator[tuple[int, list[float]]]:
        """The place before each block and the sums carried into it; at last the end of the word."""
        sums = [0.0]
        for first in range(0, len(self.data), BLOCK):
            yield first, sums
            bounds, sizes, scores, _, _ = self.arcs(first)
            sums = self.forward(sums, bounds, sizes, scores)[-self.lattice.longest :]
        yield len(self.data), sums

    def score(self) -> float:
        for _, sums in self.carried():  # noqa: B007
            pass
        return sums[-1]

    def add_counts(self, total: np.ndarray) -> None:
        *blocks, (_, sums) = self.carried()
        whole = sums[-1]
        # Sums from the places before a block to the end of the word, over arcs that end later.
        later = [-math.inf] * (self.lattice.longest - 1) + [0.0]
        for first, carried in reversed(blocks):
            bounds, sizes, scores, number, final = self.arcs(first)
            ahead = self.forward(carried, bounds, sizes, scores)
            n = len(bounds) - 1
            shift = len(ahead) - n - 1  # place first + i is entry shift + i of ``ahead``
            pad = self.lattice.longest
            back = [-math.inf] * (pad + n + 1)  # place first + i is entry pad + i
            back[-len(later) :] = later
            uses = [0.0] * len(sizes)
            for i in range(n, 0, -1):
                here = back[pad + i]
                for j in range(bounds[i - 1], bounds[i]):
                    size, way = sizes[j], scores[j] + here
                    uses[j] = math.exp(ahead[shift + i - size] + way - whole)
                    other = back[pad + i - size]
                    top = max(other, way)
                    if top > -math.inf:
                        back[pad + i - size] = top + math.log1p(math.exp(min(other, way) - top))
            later = back[1 : pad + 1]
            np.add.at(total, (final, number), uses)


def word_scores(lattice: Lattice, words: list[bytes]) -> np.ndarray:
    """Natural logarithm of S(w) for each word."""
    out = np.zeros(len(words))
    for group in _groups(words):
        paths = Paths(lattice, [words[i] for i in group])
        out[group[paths.order]] = paths.forward()[paths.ends]
    for i, word in enumerate(words):
        if len(word) > LONG:
            out[i] = LongWord(lattice, word).score()
    return out


def expected_counts(lattice: Lattice, words: list[bytes]) -> np.ndarray:
    """How often each piece is used inside and at the end of the words, over all segmentations."""
    n = len(lattice.pieces)
    total = np.zeros((2, n))
    for group in _groups(words):
        paths = Paths(lattice, [words[i] for i in group])
        ahead, back = paths.forward(), paths.backward()
        # The first places are those of whole words, in the order of the words.
        whole = np.zeros(len(ahead))
        whole[: len(group)] = back[: len(group)]
        for k in range(1, len(paths.begin) - 1):
            a, b = paths.begin[k], paths.begin[k + 1]
            whole[a:b] = back[: b - a]
        use = np.exp(ahead[paths.source] + paths.score + back[paths.target] - whole[paths.target])
        total += np.bincount(paths.final * n + paths.number, use, 2 * n).reshape(2, n)
    for word in words:
        if len(word) > LONG:
            LongWord(lattice, word).add_counts(total)
    return total


def refit(lattice: Lattice, counts: np.ndarray) -> Lattice:
    """Scores in proportion to the expected counts; single bytes never reach zero."""
    counts = counts.copy()
    single = [i for i, p in enumerate(lattice.pieces) if len(p) == 1]
    counts[:, single] += 0.01
    with np.errstate(divide="ignore"):
        return Lattice(lattice.pieces, np.log(counts / counts.sum()))


# Tables


def _packed(docs: pa.RecordBatch) -> bytes:
    """Documents as one value: the JVM hands it on as it is, and a row without one costs nothing."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(docs)
    return sink.getvalue().to_pybytes()


@frees
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a chunk as bags of word numbers, some of them packed in a row, and with each row
    the words that are new in it, numbered from ``first`` on, with their training counts in the chunk."""
    part = TaskContext.get().partitionId()
    number = 0
    ids, train, totals, bounds, words, counts = [], [], [], [0], [], []
    seen: dict[bytes, int] = {}
    cuts = [(0, 0)]  # documents and words before each row
    size = row_size = 0

    def close() -> Iterator[pa.RecordBatch]:
        numbers = np.array(words, np.int32)
        times = np.array(counts, np.int32)
        begin = np.array(bounds, np.int64)
        learnt = np.repeat(np.array(train, bool), np.diff(begin))
        in_training = np.bincount(numbers[learnt], times[learnt], len(seen)).astype(np.int64)
        spelling = list(seen)
        for (doc, word), (doc_end, word_end) in pairwise(cuts):
            own, bags = slice(doc, doc_end), slice(begin[doc], begin[doc_end])
            pairs = pa.StructArray.from_arrays([numbers[bags], times[bags]], ["number", "times"])
            bag = pa.ListArray.from_arrays(pa.array(begin[doc : doc_end + 1] - begin[doc], pa.int32()), pairs)
            docs = pa.RecordBatch.from_arrays(
                [pa.array(ids[own], pa.int64()), pa.array(train[own], pa.bool_()), pa.array(totals[own], pa.int64()), bag],
                ["id", "train", "total", "bag"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | number], pa.int64()),
                    pa.array([word], pa.int32()),
                    pa.array([sum(train[own])], pa.int64()),
                    pa.array([_packed(docs)], pa.binary()),
                    pa.array([spelling[word:word_end]], pa.list_(pa.binary())),
                    pa.array([in_training[word:word_end]], pa.list_(pa.int64())),
                ],
                ["chunk", "first", "ends", "docs", "words", "in_training"],
            )

    for batch in batches:
        flat, offsets = utf8(batch.column("text"))
        own, learn = batch.column("id").to_pylist(), batch.column("train").to_pylist()
        for row in range(batch.num_rows):
            found = flat[offsets[row] : offsets[row + 1]].tobytes().translate(LOWER).split()
            bag = Counter(found)
            ids.append(own[row])
            train.append(learn[row])
            totals.append(len(found))
            words += [seen.setdefault(w, len(seen)) for w in bag]
            counts += bag.values()
            bounds.append(len(words))
            size += int(offsets[row + 1] - offsets[row])
            row_size += int(offsets[row + 1] - offsets[row])
            if row_size >= ROW_BYTES or size >= CHUNK_BYTES:
                cuts.append((len(ids), len(seen)))
                row_size = 0
            if size >= CHUNK_BYTES:
                yield from close()
                number, size = number + 1, 0
                ids, train, totals, bounds, words, counts = [], [], [], [0], [], []
                seen, cuts = {}, [(0, 0)]
    if ids:
        if cuts[-1][0] < len(ids):
            cuts.append((len(ids), len(seen)))
        yield from close()


@frees
def _expect(batches: Iterator[pa.RecordBatch], lattice: Lattice) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, len(lattice.pieces)))
    for batch in batches:
        total += expected_counts(lattice, batch.column("word").to_pylist())
    used = np.flatnonzero(total.sum(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), pa.array(total[0, used]), pa.array(total[1, used])], ["piece", "inner", "final"]
    )


def fit_pieces(words: DataFrame, pieces: list[bytes], rounds: int = ROUNDS) -> Lattice:
    """Piece scores from all rows of ``words`` (word binary), each counting once."""
    lattice = Lattice(pieces)
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast(lattice)
        used = words.select("word").mapInArrow(
            lambda batches, sent=sent: _expect(batches, sent.value), "piece long, inner double, final double"
        )
        counts = np.zeros((2, len(pieces)))
        sums = used.groupBy("piece").agg(F.sum("inner").alias("inner"), F.sum("final").alias("final"))
        for row in sums.collect():  # at most one row a piece
            counts[:, row["piece"]] = row["inner"], row["final"]
        if not counts.any():
            break
        lattice = refit(lattice, counts)
    return lattice


@frees
def _word_scores(batches: Iterator[pa.RecordBatch], lattice: Lattice) -> Iterator[pa.RecordBatch]:
    """Training words and counts with ``spelt``, the logarithm of S(w)."""
    for batch in batches:
        spelt = word_scores(lattice, batch.column("word").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("word"), batch.column("c"), pa.array(spelt)], ["word", "c", "spelt"]
        )


def _score(chunk: pa.Table, lattice: Lattice, facts: dict) -> Iterator[pa.RecordBatch]:
    n, v, ends, discount = facts["tokens"], facts["distinct"], facts["ends"], facts["discount"]
    fresh = (discount * facts["words"] + 0.5) / (n + 1)
    whole = n + 0.5 * (v + 1)
    end_base, end_score = np.log10((ends + 0.5) / whole), np.log10((ends + 0.5) / (n + 1))
    found = chunk.select(["number", "c", "spelt", "word"]).filter(pc.is_null(chunk["docs"]))
    place = found["number"].to_numpy()
    c, spelt = np.zeros(len(place)), np.zeros(len(place))
    c[place] = found["c"].fill_null(0).to_numpy()
    spelt[place] = found["spelt"].fill_null(0.0).to_numpy()
    new = found["c"].is_null()
    spelt[place[new.to_numpy()]] = word_scores(lattice, found["word"].filter(new).to_pylist())
    base = np.log10((c + 0.5) / whole)
    pieces = spelt + np.log(fresh)
    seen = c > 0
    with np.errstate(divide="ignore"):
        log_seen = np.log(np.where(seen, c - discount, 0) / (n + 1))
    score = np.logaddexp(log_seen, pieces) / np.log(10)
    for packed in chunk["docs"].drop_null():
        docs = pa.ipc.open_stream(packed.as_buffer()).read_next_batch()
        bags = docs.column("bag")
        bounds = bags.offsets.to_numpy()
        numbers, times = (bags.values.field(name).to_numpy() for name in ("number", "times"))
        sums = [np.concatenate([[0], np.cumsum(x[numbers] * times)]) for x in (base, score, seen.astype(float))]
        sums = [x[bounds[1:]] - x[bounds[:-1]] for x in sums]
        yield pa.RecordBatch.from_arrays(
            [
                docs.column("id"),
                pc.invert(docs.column("train")),
                pa.array(docs.column("total").to_numpy() + 1),
                pa.array(sums[2].round().astype(np.int64) + int(ends > 0)),
                pa.array(np.full(docs.num_rows, n, np.int64)),
                pa.array(sums[0] + end_base),
                pa.array(sums[1] + end_score),
            ],
            ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def _scored(chunk: pa.Table, lattice: Lattice, facts: dict) -> pa.Table:
    """The documents of one chunk, from its rows of documents and its words."""
    return pa.Table.from_batches(list(frees(_score)(chunk, lattice, facts)))


def score_documents(
    docs: DataFrame,
    train: str,
    pieces: list[bytes],
    id_column: str = "doc_id",
    text: str = "text",
    rounds: int = ROUNDS,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``train`` names a boolean column: its rows are learnt from, the others are held out. Null
    and empty texts have the end alone; repeated rows count as often as they occur; rows
    without an id are scored like all others. Without training rows every word is new and the
    pieces are alike. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col(train), F.lit(False)).alias("train"),
        F.col(text).alias("text"),
    )
    made = slim.mapInArrow(
        _chunks,
        "chunk long, first int, ends long, docs binary, words array<binary>, in_training array<long>",
    )
    chunks = written(made, "chunks")
    listed = F.arrays_zip("words", "in_training")
    each = chunks.select("chunk", "first", F.posexplode(listed).alias("at", "w")).select(
        "chunk",
        (F.col("first") + F.col("at")).alias("number"),
        F.col("w.words").alias("word"),
        F.col("w.in_training").alias("n"),
    )
    counts = written(each.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "counts")

    sums = counts.agg(
        F.count(F.lit(1)).alias("words"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"),
        F.count_if(F.col("c") == 1).alias("once"),
        F.count_if(F.col("c") == 2).alias("twice"),
    ).first()
    ends = chunks.agg(F.sum("ends")).first()[0] or 0
    facts = {
        "words": sums["words"],
        "tokens": sums["tokens"] + ends,
        "ends": ends,
        "distinct": sums["words"] + (ends > 0),
        "discount": sums["once"] / (sums["once"] + 2 * sums["twice"]) if sums["once"] and sums["twice"] else 0.5,
    }
    sent = spark.sparkContext.broadcast(fit_pieces(counts, pieces, rounds))

    spelt = counts.mapInArrow(
        lambda batches: _word_scores(batches, sent.value), "word binary, c long, spelt double"
    )
    # Only new words travel on as bytes; they are scored where their chunk is.
    new = F.when(F.col("c").isNull(), F.col("word")).alias("word")
    found = each.select("chunk", "number", "word").join(spelt, "word", "left")
    found = found.select("chunk", "number", "c", "spelt", new)
    both = found.unionByName(chunks.select("chunk", "docs"), allowMissingColumns=True)
    # A group of its own for each chunk, as a task may have any number of them in one batch else.
    out = both.groupBy("chunk").applyInArrow(
        lambda chunk: _scored(chunk, sent.value, facts),
        "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return out.withColumnRenamed("id", id_column)
