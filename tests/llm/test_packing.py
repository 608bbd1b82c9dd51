import os
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from small_tables import documents, sf  # noqa: F401
from stockflow.llm import packing as pk
from stockflow.llm.queries import QUERIES
from stockflow.llm.tokens import Encoder, tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")


def brute_greedy(sizes, length):
    """Longest first, each into the shortest pack with room, one at a time."""
    packs = []
    for size in sorted(sizes, reverse=True):
        room = [p for p in packs if sum(p) + size <= length]
        if room:
            min(room, key=sum).append(size)
        else:
            packs.append([size])
    return packs


def test_patterns_fill_the_histogram_as_the_plain_rule_does():
    rng = random.Random(11)
    for _ in range(200):
        length = rng.randrange(5, 40)
        sizes = [rng.randrange(1, length + 1) for _ in range(rng.randrange(60))]
        patterns = pk.shortest_pack_first(Counter(sizes), length)
        used = Counter()
        for count, pattern in patterns:
            assert count > 0 and sum(pattern) <= length
            for size in pattern:
                used[size] += count
        assert used == Counter(sizes)
        assert sum(c for c, _ in patterns) == len(brute_greedy(sizes, length))


def test_slots_cover_every_rank_once():
    histogram = {7: 5, 4: 11, 2: 3, 1: 9}
    plan = pk.slots(pk.shortest_pack_first(histogram, 10))
    ranks = defaultdict(list)
    for size, low, high, _, _, _ in plan:
        ranks[size] += range(low, high)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}


def test_places_fill_every_sequence_without_gaps():
    rng = random.Random(12)
    for _ in range(50):
        length = rng.randrange(5, 40)
        histogram = dict(Counter(rng.randrange(1, length + 1) for _ in range(rng.randrange(1, 90))))
        patterns = pk.shortest_pack_first(histogram, length)
        plan = pk.slots(patterns)
        assert len(plan) == sum(len(set(pattern)) for _, pattern in patterns)
        places = pk.Places(histogram, plan)
        filled = defaultdict(list)
        for size, n in histogram.items():
            sequence, offset = places.of(np.full(n, size), np.arange(n))
            for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
                filled[s].append((o, size))
        assert sorted(filled) == list(range(sum(c for c, _ in patterns)))
        for parts in filled.values():
            at = 0
            for o, size in sorted(parts):
                assert o == at
                at += size
            assert at <= length


def test_many_short_pieces_take_one_run():
    histogram = {1: 10_000_000}
    plan = pk.slots(pk.shortest_pack_first(histogram, 2048))
    assert len(plan) <= 2
    sequence, offset = pk.Places(histogram, plan).of(np.ones(3, np.int64), np.array([0, 1664, 9_999_999]))
    # The sequence that is not full, of 10,000,000 - 4,882 * 2,048 = 1,664 ids, is the first.
    assert sequence.tolist() == [0, 1, 4882] and offset.tolist() == [0, 0, 2047]


def test_too_long_pieces_are_refused():
    with pytest.raises(ValueError):
        pk.shortest_pack_first({11: 1}, 10)


def test_a_block_of_texts_is_encoded_at_once(monkeypatch):
    import pyarrow as pa

    asked = []
    encode = Encoder.encode
    monkeypatch.setattr(Encoder, "encode", lambda self, texts: asked.append(len(texts)) or encode(self, texts))
    texts = [f"text {i} of some\nwords, " * 500 for i in range(300)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(300)), "text": texts})
    got = pa.Table.from_batches(pk._pieces(iter([batch]), WORDS, 1, 2048, True))
    assert sum(map(len, texts)) > 3 << 20 and asked == [300]
    whole = Encoder(WORDS).tokenizer
    for i in (0, 7, 299):
        parts = [p for d, p in zip(got.column("id").to_pylist(), got.column("ids").to_pylist(), strict=True) if d == i]
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == [*whole.encode(texts[i], add_special_tokens=False).ids, 1]


def test_a_worker_keeps_little_of_the_texts_it_has_encoded():
    # In a process of its own, as a worker; before, some 165 MB of freed arrays stayed with it.
    code = f"""
import re
import pyarrow as pa
from stockflow.llm import packing as pk

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10

pk.encoder({WORDS!r}).encode(["a few words"])
before = held()
texts = [" ".join(f"w{{(i * 131 + k * 977) % 60000:x}} of text" for k in range(800)) for i in range(1500)]
batch = pa.RecordBatch.from_pydict({{"id": list(range(1500)), "text": texts}})
del texts
rows = sum(b.num_rows for b in pk._pieces(iter([batch]), {WORDS!r}, 1, 2048, False))
print(rows, batch.nbytes, held() - before)
"""
    env = {**os.environ, "PYTHONPATH": os.pathsep.join(sys.path)}
    said = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True, timeout=300)
    rows, size, more = map(int, said.stdout.split())
    assert rows >= 1500 and size > 15 << 20 and more < 100, said.stdout


def check(rows, got, length):
    tokenizer = Encoder(WORDS).tokenizer
    want = Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), length):
            part = np.array(ids[start : start + length], "<u4")
            want[doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return sum(r.length for r in got) / max(1, len(sequences) * length)


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check(rows, QUERIES["op10_pack_sequences"](spark, sf).collect(), 2048) > 0.95


def test_edge_cases(documents, monkeypatch):
    monkeypatch.setattr(pk, "RANK_ROWS", 2)
    rows = [(1, None), (2, ""), (None, "no id"), (None, "no id"), (3, "a b c " * 20_000), (4, "same"), (4, "same")]
    rows += [(10 + i, "x " * (i % 7)) for i in range(60)]
    docs = documents(rows).selectExpr("*", "1 as start", "'x' as id", "2 as length", "3 as bucket", "4 as offset")
    check(rows, pk.pack(docs, WORDS, 1, length=16).collect(), 16)
    got = pk.pack(docs, WORDS, 1, length=16, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    anew = pk.pack(docs, WORDS, 1, length=16, keep_words=False).drop("sequence_id", "offset")
    assert sorted(map(str, anew.collect())) == sorted(map(str, pk.pack(docs, WORDS, 1, length=16).drop("sequence_id", "offset").collect()))
    assert pk.pack(docs.limit(0), WORDS, 1).count() == 0
