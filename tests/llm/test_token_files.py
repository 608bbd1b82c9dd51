import random
import zlib

import numpy as np
import pytest
from small_tables import documents, sf  # noqa: F401
from stockflow.llm import token_files as tf
from stockflow.llm.queries import QUERIES
from stockflow.llm.tokens import Encoder, tokenizer_path

BYTES = tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_whole_texts(name):
    encoder = Encoder(tokenizer_path(name))
    rng = random.Random(5)
    bits = [" ", "  ", "   ", "\n", " \n", "\t", "a", "The", "don't", "'S", "é", "é", "́", "12", "3.5", "!!"]
    bits += ["　", "\x1c", "\xa0", "東京", "Σ", "ΑΣ", "<|endoftext|>", "x" * 30, "\x85", "​", "İ", "ß", "\r\n", "½", "\0", "\0a"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(3000)]
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, got, want in zip(texts, encoder.encode(texts), whole, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_file_as_loaded(name):
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(tokenizer_path(name)), Encoder(tokenizer_path(name))
    rng = random.Random(6)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "  ", "\n", "a", "The", "e", "\u0301", "12", "Σ"]
    texts = ["a <|endoftext|> b", *("".join(rng.choice(bits) for _ in range(rng.randrange(10))) for _ in range(2000))]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    if name.startswith("byte"):
        assert np.frombuffer(encoder.encode(texts)[0], "<u4").tolist() == [64, 220, 50256, 275]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_letters_and_marks_are_not_handled_one_by_one(name, monkeypatch):
    encoder = Encoder(tokenizer_path(name))
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdéßñ東") for _ in range(rng.randrange(1, 9))) for _ in range(5000)]
    texts = [" ".join(w + rng.choice(["", "", ".", ",", ".\nThen"]) for w in rng.sample(words, 500)) for _ in range(40)]
    want = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]

    class Library:
        def __init__(self, inner):
            self.inner, self.asked = inner, []

        def encode_batch_fast(self, some, **options):
            self.asked.append(len(some))
            return self.inner.encode_batch_fast(some, **options)

    one_by_one = []
    words_of = Encoder._words
    monkeypatch.setattr(Encoder, "_words", lambda self, piece: one_by_one.append(piece) or words_of(self, piece))
    encoder.of_words = Library(encoder.of_words)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    # A line feed alone at most; all new words in two lists, one of 4,096, and none of them again.
    assert len(set(one_by_one) - {"\n\n"}) <= 1500 * encoder.lower and not {w for w in one_by_one if w.isalpha()}
    assert sum(encoder.of_words.asked) <= 4


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_white_space_and_characters_are_those_of_the_library(name):
    encoder = Encoder(tokenizer_path(name))
    rng = random.Random(8)
    bits = ["\n", "\n\n", "\t\n", "\n\t", " \n", " ", "\x1c", "\x85", "\xa0", "a", "Be", "'s", ".", ",", "1", "\u0558", "\u1c89", "\U00010d50"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(10))) for _ in range(5000)]
    texts += [f"ab{c}cd {c}. x{c}, {c}" for c in map(chr, range(0x3000))]
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, got, want in zip(texts, encoder.encode(texts), whole, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text


def test_memory_is_bounded(monkeypatch):
    from stockflow.llm import tokens

    monkeypatch.setattr(tokens, "KEPT", 50)
    encoder = Encoder(BYTES)
    for i in range(0, 2000, 20):
        texts = [f"word{j} and more" for j in range(i, i + 20)]
        want = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    assert len(encoder.pieces.new) < 150 and len(encoder.pieces.old) < 150


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], [0, 1 << 40], list(range(1000)), [7] * 600 + [8] * 600])
def test_elias_fano_round_trip(values):
    one = tf.EliasFano.of(np.array(values, np.uint64))
    back, rest = tf.EliasFano.from_bytes(memoryview(one.to_bytes() + b"tail"))
    assert bytes(rest) == b"tail" and back.all().tolist() == values
    assert [back.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        back.select(len(values))


def test_elias_fano_random_select_and_space():
    rng = np.random.default_rng(2)
    values = np.cumsum(rng.integers(0, 900, 20_000))
    one = tf.EliasFano.of(values)
    for i in rng.integers(0, len(values), 300).tolist():
        assert one.select(i) == values[i]
    assert len(one.to_bytes()) * 8 < len(values) * (2.3 + np.log2(values[-1] / len(values))) + 500


def brute(rows):
    encoder = Encoder(BYTES)
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(QUERIES["op3_token_files"](spark, sf)) == brute(rows)


def test_edge_cases(spark, documents, tmp_path):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(5, None), (-3, "minus"), (2, ""), (2**62, long), (None, "no id"), (7, "same"), (7, "same"), (9, "<|endoftext|>")]
    docs = documents(rows).selectExpr("*", "1 as tie", "'x' as id", "2 as segment")
    tf.write_token_files(docs, f"{tmp_path}/a", BYTES, 2, segment_ids=8)
    assert rows_of(tf.read_token_files(spark, f"{tmp_path}/a")) == brute(rows)
    whole = Encoder(BYTES).tokenizer
    for row in spark.read.parquet(f"{tmp_path}/a").collect():
        segment = tf.Segment.of(row.segment)
        texts = dict(rows)
        for i, doc in enumerate(segment.ids()):
            assert segment.document(i).tolist() == [*whole.encode(texts[doc] or "", add_special_tokens=False).ids, 2] or doc == 9
    tf.write_token_files(docs.limit(0), f"{tmp_path}/b", BYTES, 2)
    assert tf.read_token_files(spark, f"{tmp_path}/b").count() == 0


def test_reading_takes_the_bounds_by_select(monkeypatch):
    import pyarrow as pa

    sizes = [i % 7 for i in range(900)]
    packed = tf.pack_segment(list(range(900)), [b"\1\0\0\0" * n for n in sizes])
    asked = []
    select = tf.EliasFano.select
    monkeypatch.setattr(tf.EliasFano, "select", lambda self, i: asked.append(i) or select(self, i))
    batch = pa.RecordBatch.from_pydict({"first_doc": [0], "first_tie": [0], "number": [0], "segment": [packed]})
    (got,) = tf._read(iter([batch]))
    assert got.column("local_start").to_pylist() == np.cumsum([0, *sizes[:-1]]).tolist()
    assert got.column("n_tokens").to_pylist() == sizes
    assert asked == list(range(901))


def test_wide_ids():
    ids = np.array([1, 70_000, 3], "<u4")
    segment = tf.Segment.of(tf.pack_segment([4], [ids.tobytes()]))
    assert segment.document(0).tolist() == ids.tolist() and segment.tokens.dtype.itemsize == 4


def test_starts_run_on_over_ranges_of_segments(spark, documents, tmp_path):
    rows = [(i, f"text {i} " * (i % 9)) for i in range(400)] + [(None, "none")]
    tf.write_token_files(documents(rows).repartition(7), f"{tmp_path}/c", BYTES, 2, segment_ids=16)
    assert spark.read.parquet(f"{tmp_path}/c").count() > 100
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(tf.read_token_files(spark, f"{tmp_path}/c"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows)
