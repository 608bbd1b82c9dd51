import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from small_tables import documents, sf  # noqa: F401
from stockflow.llm import common
from stockflow.llm import suffix_dedup as sd
from stockflow.llm.queries import QUERIES


def brute(rows, length):
    datas = [(doc, (text or "").encode()) for doc, text in rows]
    seen = Counter(d[i : i + length] for _, d in datas for i in range(len(d) - length + 1))
    out = []
    for doc, d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        n_spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        rest = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((doc, len(d), sum(gone), n_spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def test_suffix_array_on_small_alphabets():
    rng = random.Random(1)
    for _ in range(200):
        codes = [rng.randrange(1, rng.choice([2, 3, 6]) + 1) for _ in range(rng.randrange(60))]
        got = sd.suffix_array(np.array(codes, np.int64), 10**6).tolist()
        assert got == sorted(range(len(codes)), key=lambda i: codes[i:])


def test_suffix_array_of_large_codes():
    rng = random.Random(6)
    for most in (1 << 14, 1 << 24, 1 << 40, (1 << 63) - 1):
        some = [rng.randrange(1, most + 1) for _ in range(5)]
        for n in (3, 4, 5, 40, 41, 42, 700):
            codes = [rng.choice(some) for _ in range(n)]
            got = sd.suffix_array(np.array(codes, np.int64), 10**6).tolist()
            assert got == sorted(range(n), key=lambda i: codes[i:])


def test_suffix_array_costs_a_few_sorts():
    rng = np.random.default_rng(3)
    words = rng.integers(98, 123, (4000, 6))
    codes = words[rng.integers(0, 4000, 170_000)].ravel().astype(np.int64)
    numbers = rng.random(len(codes))

    def least(work):
        times = []
        for _ in range(3):
            began = time.thread_time()
            work()
            times.append(time.thread_time() - began)
        return min(times)

    # About 2 sorts of as many numbers; 6.5 with a binary search step by step over all suffixes.
    assert least(lambda: sd.suffix_array(codes, 400)) < 4.5 * least(lambda: np.argsort(numbers, kind="stable"))


def test_lists_of_structs_side_by_side():
    import pyarrow as pa

    lists = pa.array([[{"a": 9, "b": True}], None, [{"a": 1, "b": True}, {"a": 2, "b": False}], [], [{"a": 3, "b": True}]])
    rows, fields = sd._flat(lists.slice(1))
    assert rows.tolist() == [1, 1, 3]
    assert fields["a"].to_pylist() == [1, 2, 3] and fields["b"].to_pylist() == [True, False, True]


def test_repeated_strings_on_small_alphabets():
    rng = random.Random(2)
    for _ in range(200):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 6))]
        length = rng.randrange(2, 9)
        seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        want = [[i for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1] for p in parts]
        assert [x.tolist() for x in sd.repeated_strings(parts, length)] == want


def thue_morse(n):
    """Two strings of which polynomial hashes modulo a power of two are equal from some n on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return bytes(b"ab"[x] for x in bits), bytes(b"ba"[x] for x in bits)


def test_strings_with_equal_polynomial_hashes_differ(documents):
    one, other = thue_morse(1024)
    assert one != other
    names = sd.neighbour_hashes(sd.prefix_sums(np.frombuffer(one + other, np.uint8)), 1024)
    assert names[0] == names[1024]
    assert [len(x) for x in sd.repeated_strings([one, other], 1024)] == [0, 0]
    rows = [(1, one.decode()), (2, other.decode()), (3, "x" + one.decode()), (4, other.decode() + "y")]
    for rows, most in ((rows[:2], sd.MAX_SEGMENTS), (rows, sd.MAX_SEGMENTS), (rows, 1)):  # noqa: B020
        left = sd.remove_repeats(documents(rows), length=1024, gram=1024, max_segments=most)
        assert rows_of(left) == brute(rows, 1024)


def test_segments_cover_every_string_once():
    rng = random.Random(3)
    data = np.array([rng.choice(b"abc") for _ in range(500)], np.uint8)
    offsets = np.array([0, 0, 17, 200, 203, 500])
    text, begin, end, _, _, _ = sd.segments(data, offsets, 20, 6)
    starts = [(t, p) for t, b, e in zip(text, begin, end, strict=True) for p in range(b, e - 20 + 1)]
    want = [(t, p) for t in range(5) for p in range(offsets[t], offsets[t + 1] - 20 + 1)]
    assert starts == want


def shared_passage(documents):
    """Texts with a passage of 60 words in common, between words of their own."""
    rng = random.Random(8)

    def some(n):
        return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))

    passage = some(60)
    return documents([(i, f"{some(40)} {passage} {some(40)}") for i in range(20)])


@pytest.mark.parametrize("passage_words", [0, 51])  # as in the pipeline, as in the query
def test_finished_steps_leave_no_disk_taken(spark, documents, passage_words):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    shared = Path(common.shared_path(spark, "x")).parent

    def shuffled():
        files = env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split()
        return {f for f in files if re.search(r"/shuffle_\d+_\d+_\d+\.data$", f)}

    docs, shuffles, tables = shared_passage(documents), shuffled(), set(shared.iterdir())
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    left = sd.remove_repeats(docs, length=200, keep=["doc_id"], passage_words=passage_words)
    ends = time.monotonic() + 20
    while shuffled() - shuffles and time.monotonic() < ends:
        time.sleep(0.2)
    assert not shuffled() - shuffles
    kept = sorted(p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - tables)
    assert kept == ["names", "repeated", "segments", "variants"]
    assert spark.conf.get(setting, None) == before
    rows = left.collect()
    assert len(rows) == 20 and all(r.n_removed >= 60 * 7 - 1 for r in rows)
    assert not passage_words or all(r.shared_words == 60 for r in rows)


def test_bytes_of_segments_are_shuffled_once(spark, documents, capsys):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        sd.repeated_spans(shared_passage(documents), length=200, passage_words=51).explain("formatted")
    finally:
        spark.conf.set(limit, before)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[.*\bbytes#", capsys.readouterr().out)
    assert len(moved) == 1


@pytest.mark.parametrize("max_segments", [sd.MAX_SEGMENTS, 1])
def test_mixed_repeats(documents, max_segments):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(5))
    shared = [" ".join(word() for _ in range(20)) for _ in range(3)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(12))) for _ in range(3)]
        if i % 3:
            parts.insert(rng.randrange(4), rng.choice(shared)[rng.randrange(20) :])
        rows.append((i, "".join(parts)))
    rows += [(100, rows[1][1]), (101, rows[1][1]), (102, "xy" * 300), (103, "q" * 59), (104, "q" * 61)]
    left = sd.remove_repeats(documents(rows), length=60, gram=16, max_segments=max_segments)
    assert rows_of(left) == brute(rows, 60)


def test_edge_cases(documents):
    long = " ".join(str(i * 7919 % 1_000_003) for i in range(300_000))
    passage = "a passage that two texts share, " * 20
    rows = [(1, None), (2, ""), (None, None), (3, "short"), (3, "short"), (4, "x" + passage + "y"), (None, passage)]
    rows += [(5, long), (6, long[1000:1_500_000]), (7, "w" * 400), (8, "v" * 401)]
    docs = documents(rows).selectExpr("*", "'z' as tkey", "1 as spans", "2 as begin", "3 as id", "4 as n_bytes")
    got = sd.remove_repeats(docs, length=400, keep=["doc_id", "lang"])
    small = [r for r in rows if r[0] not in (5, 6)]
    assert [r for r in rows_of(got) if r[0] not in (5, 6)] == brute(small, 400)
    cut = {r[0]: r for r in rows_of(got)}
    assert cut[5][2] == 1_499_000 and cut[6][2] == 1_499_000
    assert sd.remove_repeats(docs.limit(0), length=400).count() == 0


def test_whole_characters_leave_valid_text(documents):
    rows = [(1, "1" + "ab" * 20 + "é"), (2, "2" + "ab" * 20 + "è")]
    cut = sd.remove_repeats(documents(rows), length=30, gram=8, whole_characters=True).collect()
    assert sorted(bytes(r.kept_text).decode() for r in cut) == ["1é", "2è"]


def test_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(QUERIES["op7_suffix_array_dedup"](spark, sf)) == brute(rows, 400)


def brute_words(rows, words):
    """The longest passage of each row, from all runs of so many words of all rows."""
    said = [(doc, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc, text in rows]
    seen = defaultdict(set)
    for row, (_, w) in enumerate(said):
        for i in range(len(w) - words + 1):
            seen[tuple(w[i : i + words])].add(row)
    out = []
    for doc, w in said:
        longest = run = end = 0
        for i in range(len(w) - words + 1):
            if len(seen[tuple(w[i : i + words])]) > 1:
                run = run + i + words - end if i < end else words
                end = i + words
                longest = max(longest, run)
        out.append((doc, longest))
    return sorted(out, key=repr)


def passages(df):
    return sorted(((r.doc_id, r.shared_words) for r in df.collect()), key=repr)


def test_passages_of_lists_of_words():
    parts = [b"a b c d x".split(), b"y a b c d".split(), b"d x d x d x".split()]
    found = sd.shared_passages(parts, [b"1", b"2", b"2"], 2)
    assert [f.tolist() for f in found] == [[0, 1, 2, 3], [1, 2, 3], [0, 2, 4]]
    assert [f.tolist() for f in sd.shared_passages(parts, [b"1"] * 3, 2)] == [[], [], []]
    assert sd.shared_passages([[], [b"a"]], [b"1", b"2"], 2)[1].tolist() == []


@pytest.mark.parametrize("max_segments", [sd.MAX_SEGMENTS, 1])
def test_shared_passages(documents, max_segments, monkeypatch):
    monkeypatch.setattr(sd, "GRAM_WORDS", 3)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 4)))
    shared = [[word() for _ in range(20)] for _ in range(4)]
    rows = []
    for i in range(80):
        parts = [[word() for _ in range(rng.randrange(8))] for _ in range(3)]
        for _ in range(i % 4):
            one = rng.choice(shared)
            at = rng.randrange(12)
            parts.insert(rng.randrange(4), one[at : at + rng.randrange(4, 14)])
        rows.append((i, "".join(w + rng.choice([" ", "  ", "\n"]) for part in parts for w in part)))
    line = " ".join(word() for _ in range(12))
    rows += [(100, rows[1][1]), (101, rows[1][1]), (101, rows[1][1]), (None, f"{line} {line} {line}"), (102, None), (103, "")]
    # The same run twice in one text, and parts of it elsewhere.
    twice = " ".join(f"t{i}" for i in range(12))
    rows += [(104, f"{twice} u {twice}"), (105, " ".join(f"t{i}" for i in range(3, 11))), (106, "one two"), (107, "one two")]
    left = sd.remove_repeats(documents(rows), length=60, gram=16, max_segments=max_segments, passage_words=6)
    assert passages(left) == brute_words(rows, 6)
    assert rows_of(left) == brute(rows, 60)


def test_long_texts_share_passages(documents, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 5000)
    rng = random.Random(8)
    long = [str(rng.randrange(10**6)) for _ in range(40_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["x", *long[4_990:10_060], "y"])), (3, " ".join(long[:50])), (4, "z" * 900)]
    got = sd.remove_repeats(documents(rows), length=400, passage_words=51, keep=["doc_id"])
    assert passages(got) == [(1, 5070), (2, 5070), (3, 0), (4, 0)]
    assert sd.remove_repeats(documents(rows).limit(0), passage_words=51).count() == 0


def test_query_finds_the_passages(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert passages(QUERIES["op7_suffix_array_dedup"](spark, sf)) == brute_words(rows, 51)
