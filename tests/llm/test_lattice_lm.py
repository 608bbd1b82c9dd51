import math
import re
import zlib
from collections import Counter
from decimal import Decimal
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from small_tables import documents, sf  # noqa: F401
from stockflow.llm import lattice_lm as lm
from stockflow.llm.queries import QUERIES
from stockflow.llm.tokens import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTES = [bytes([b]) for b in range(256)]
SMALL = sorted([*BYTES, b"th", b"the", b"he", b"ing", b"in", b"abcdefgh"])


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def segmentations(lattice, word):
    number = {p: i for i, p in enumerate(lattice.pieces)}

    def rest(at):
        if at == len(word):
            yield []
        for size in range(1, lm.MAX_PIECE + 1):
            if at + size <= len(word) and word[at : at + size] in number:
                arc = (int(at + size == len(word)), number[word[at : at + size]])
                for more in rest(at + size):
                    yield [arc, *more]

    return list(rest(0))


@pytest.fixture(scope="module")
def lattice():
    return lm.Lattice(SMALL, np.log(np.random.default_rng(1).random((2, len(SMALL))) / 600))


def test_scores_sum_all_segmentations(lattice):
    words = [b"the", b"thing", b"a", b"inthein", b"heathe", "é".encode(), b"xabcdefgh"]
    want = [math.log(sum(math.exp(sum(lattice.scores[a] for a in s)) for s in segmentations(lattice, w))) for w in words]
    assert lm.word_scores(lattice, words) == pytest.approx(want)


def test_expected_counts(lattice):
    words = [b"the", b"thing", b"inthein", b"a"]
    want = np.zeros((2, len(SMALL)))
    for w in words:
        paths = segmentations(lattice, w)
        weights = [math.exp(sum(lattice.scores[a] for a in s)) for s in paths]
        for path, weight in zip(paths, weights, strict=True):
            for arc in path:
                want[arc] += weight / sum(weights)
    assert lm.expected_counts(lattice, words) == pytest.approx(want)


def test_refitting_never_lowers_the_likelihood():
    words = [w.encode() for w in "the thing in the weather is nothing but the inner thing".split()]
    lattice, last = lm.Lattice(SMALL), -math.inf
    for _ in range(6):
        lattice = lm.refit(lattice, lm.expected_counts(lattice, words))
        assert np.exp(lattice.scores).sum() == pytest.approx(1)
        now = lm.word_scores(lattice, words).sum()
        assert now > last - 0.5  # up to the floor of single bytes
        last = now


def exact(lattice, word):
    """S(w) and the expected counts by uncut sums over the whole word, in decimals."""
    scores = [[Decimal(float(x)).exp() for x in row] for row in lattice.scores]
    numbers = {p: i for i, p in enumerate(lattice.pieces)}
    longest, n = max(map(len, lattice.pieces)), len(word)
    arcs = []
    for end in range(1, n + 1):
        for size in range(1, min(longest, end) + 1):
            if word[end - size : end] in numbers:
                arcs.append((end - size, end, int(end == n), numbers[word[end - size : end]]))
    ahead, back = [Decimal(1), *[Decimal(0)] * n], [*[Decimal(0)] * n, Decimal(1)]
    for a, b, kind, i in arcs:
        ahead[b] += ahead[a] * scores[kind][i]
    for a, b, kind, i in reversed(arcs):
        back[a] += back[b] * scores[kind][i]
    counts = np.zeros((2, len(lattice.pieces)))
    for a, b, kind, i in arcs:
        counts[kind, i] += float(ahead[a] * scores[kind][i] * back[b] / ahead[n])
    return float(ahead[n].ln()), counts


@pytest.mark.parametrize("block", [1 << 14, 40, 3])
def test_long_words_are_scored_whole(lattice, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK", block)
    words = [b"the" * 50, "東京の天気".encode() * 8, b"ab", b"the" * 300, b"xabcdefgh" * 60, b"a" * 257, b"thing"]
    want = [exact(lattice, w) for w in words]
    assert lm.word_scores(lattice, words) == pytest.approx([score for score, _ in want], rel=1e-9)
    for word, (_, counts) in zip(words, want, strict=True):
        assert lm.expected_counts(lattice, [word]) == pytest.approx(counts, rel=1e-9, abs=1e-9)
    assert lm.expected_counts(lattice, words) == pytest.approx(sum(counts for _, counts in want), rel=1e-9, abs=1e-9)


def test_the_vocabulary_has_every_piece_of_the_file():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    said = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    want = {model.id_to_piece(i).replace("▁", "").translate(LOWER).encode() for i in said} - {b""}
    pieces = lm.subword_vocabulary(path)
    assert set(pieces) == want | set(BYTES)
    assert {b"different", b"information", b"government"} < set(pieces)


@pytest.mark.parametrize("long", [1 << 8, 0])
def test_pieces_over_eight_bytes(monkeypatch, long):
    monkeypatch.setattr(lm, "LONG", long)
    monkeypatch.setattr(lm, "BLOCK", 11)
    alike = [b"abcdefgh" + middle + b"stuvwxyz" for middle in (b"12", b"34", b"12345678")]
    pieces = sorted([*SMALL, *alike, b"different", b"differences", b"information", "東京の天気".encode(), b"zeros\0\0\0\0", b"a" * 24])
    lattice = lm.Lattice(pieces, np.log(np.random.default_rng(2).random((2, len(pieces))) / 600))
    words = [*alike, b"abcdefgh56stuvwxyz", b"indifferent", b"differences" * 3, b"informational", "東京の天気です".encode()]
    words += [b"zeros\0\0\0\0", b"zeros\0\0\0", b"zeros\0\0\0\0\0", b"a" * 60, b"different"]
    want = [exact(lattice, w) for w in words]
    assert lm.word_scores(lattice, words) == pytest.approx([score for score, _ in want], rel=1e-9)
    assert lm.expected_counts(lattice, words) == pytest.approx(sum(c for _, c in want), rel=1e-9, abs=1e-9)


def brute(rows, learn):
    """Everything but the score."""
    c = Counter()
    for doc, text in rows:
        if learn(doc):
            c.update([*tokens(text), None])
    n, v = sum(c.values()), len(c)
    out = []
    for doc, text in rows:
        said = [*tokens(text), None]
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in said)
        out.append((doc, not learn(doc), len(said), sum(c[t] > 0 for t in said), n, base))
    return sorted(out, key=repr)


def check(got, rows, learn):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=repr)
    want = brute(rows, learn)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op2_lattice_likelihood"](spark, sf).collect()
    check(got, rows, lambda doc: zlib.crc32(str(doc).encode()) % 5 != 1)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    # The base gives all new words one probability together, the lattice one to each.
    learnt, held = ([r for r in got if r.held_out == kind] for kind in (False, True))
    assert sum(r.score for r in learnt) > 1.05 * sum(r.base_score for r in learnt)
    assert sum(r.score for r in held) > 1.5 * sum(r.base_score for r in held)


def test_edge_cases(documents):
    rows = [(1, None), (2, ""), (3, " \t "), (None, "The end"), (4, "the the THE end"), (4, "the the THE end")]
    rows += [(5, "x" * 100_000), (6, "new words " * 50_000), (7, "é ß 東京")]
    docs = documents(rows).selectExpr("*", "doc_id <= 4 as learn", "'q' as chunk", "1 as words", "'i' as id", "2 as train")
    learn = lambda doc: doc is not None and doc <= 4
    check(lm.score_documents(docs, "learn", SMALL).collect(), rows, learn)
    none = docs.withColumn("learn", F.lit(False))
    got = lm.score_documents(none, "learn", SMALL).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in got)
    assert lm.score_documents(docs.limit(0), "learn", SMALL).count() == 0


def test_token_probabilities_sum_to_one(documents):
    """All words over a small vocabulary of two letters, up to a length that leaves little."""
    pieces = sorted({*BYTES, b"ab"})
    rows = [(1, "a b ab ab ba"), (2, "a a")]
    rows += [(10 + i, w) for i, w in enumerate(["q"])]
    docs = documents(rows).selectExpr("doc_id", "text", "doc_id < 10 as learn")
    got = {r.doc_id: r for r in lm.score_documents(docs, "learn", pieces).collect()}
    one_end = math.log10((2 + 0.5) / (7 + 2 + 1))
    assert got[1].score < 5 * math.log10(0.9) + one_end
    assert 10 ** (got[10].score - one_end) < 0.2


def test_chunks_are_scored_one_at_a_time(documents):
    """Once all chunks of a task came to Python in one batch."""
    rows = [(i, f"the word{i % 5} of it {i}") for i in range(40)]
    docs = documents(rows).selectExpr("doc_id", "text", "doc_id % 3 > 0 as learn").repartition(9)
    got = lm.score_documents(docs, "learn", SMALL)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    check(got.collect(), rows, lambda doc: doc % 3 > 0)


def test_no_row_holds_a_whole_chunk(monkeypatch):
    """Once a chunk was one row, of a size that executors had no room for side by side."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", 900)
    monkeypatch.setattr(lm, "ROW_BYTES", 200, raising=False)
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    texts = [f"The word{i % 7} and word{i} of it " * (1 + i % 3) for i in range(60)] + [None, "", "long " * 300, "end"]
    learn = [i % 3 > 0 for i in range(len(texts))]
    ids = [None if i == 5 else i for i in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({"id": ids, "train": learn, "text": texts})
    rows = [r for b in lm._chunks(iter([batch.slice(0, 33), batch.slice(33)])) for r in b.to_pylist()]
    found, held = [], {}
    for r in rows:
        words = held.setdefault(r["chunk"], ([], []))
        assert r["first"] == len(words[0])
        words[0].extend(r["words"])
        words[1].extend(r["in_training"])
    sizes = Counter()
    want = {chunk: Counter() for chunk in held}
    for r in rows:
        docs = pa.ipc.open_stream(r["docs"]).read_all().to_pylist()
        own = [len((texts[len(found) + i] or "").encode()) for i in range(len(docs))]
        assert sum(own[:-1]) < 200  # the last one may be longer by itself
        sizes[r["chunk"]] += sum(own)
        assert r["ends"] == sum(d["train"] for d in docs)
        for d in docs:
            bag = Counter({held[r["chunk"]][0][x["number"]].decode(): x["times"] for x in d["bag"]})
            assert d["total"] == bag.total()
            if d["train"]:
                want[r["chunk"]].update(bag)
            found.append((d["id"], d["train"], bag))
    assert found == list(zip(ids, learn, map(Counter, map(tokens, texts)), strict=True))
    assert all(dict(zip(map(bytes.decode, w), n, strict=True)) == {x.decode(): want[k][x.decode()] for x in w} for k, (w, n) in held.items())
    assert len(held) > 3 and len(rows) > 2 * len(held) and all(len(set(w)) == len(w) for w, _ in held.values())
    assert max(sizes.values()) >= 900 and {chunk >> 32 for chunk in held} == {3}


def test_rows_of_a_chunk_meet_its_words_one_by_one(documents):
    """Once the words of a chunk came as one array; texts of several megabytes make several rows."""
    rows = [(i, f"the word{i % 5} of it {i} " * 4_000) for i in range(45)]
    docs = documents(rows).selectExpr("doc_id", "text", "doc_id % 3 > 0 as learn").repartition(1)
    got = lm.score_documents(docs, "learn", SMALL)
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
    check(got.collect(), rows, lambda doc: doc % 3 > 0)
