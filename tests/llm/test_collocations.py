import random
import re
from collections import Counter

import numpy as np
import pytest
from small_tables import sf  # noqa: F401
from stockflow.llm import collocations as co
from stockflow.llm.queries import QUERIES

UPPER = {i: i + 32 for i in range(65, 91)}


def brute(rows, threshold=10, longest=3, percent=50, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    key = (lang, *words[i : i + size])
                    f[key] = f.get(key, 0) + 1
    out = []
    candidates = {k: a for k, a in f.items() if len(k) > 2 and a >= threshold}
    inside = Counter()
    for (lang, *words), a in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                key = (lang, *words[i : i + size])
                inside[key] = max(inside[key], a)
    for (lang, *words), a in candidates.items():
        if 100 * inside[(lang, *words)] >= percent * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    ranked = []
    for lang in n:
        for rank, (_, score, a, phrase, left, right) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            ranked.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked)


def found(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_query_against_brute_force(spark, sf):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = found(QUERIES["op13_collocations"](spark, sf))
    assert got == brute(rows) and len(got) > 50


@pytest.mark.parametrize("seed,longest,block", [(1, 3, 300), (2, 4, 1), (3, 2, 1 << 20), (4, 5, 4_000)])
def test_random_texts(spark, seed, longest, block):
    rng = random.Random(seed)
    words = ["a", "B", "b", "é", "x-y", "　", "東京", "\x1f", "\x00"]
    rows = []
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randrange(25)))
        rows.append((rng.choice(["en", "en", "en", None, "und", ""]), rng.choice([text, text, None, ""])))
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as f", "'p' as phrase", "2 as rank", "3 as n")
    got = found(co.collocations(docs, threshold=4, longest=longest, inside_percent=40, top=30, block_bytes=block))
    assert got == brute(rows, 4, longest, 40, 30) and got


def test_large_figures_stay_exact(spark):
    rows = [(999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_998), (7, 9, 11), (10**15 - 1, 10**15 - 1, 10**15 - 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, l long, r long").select(co.score("a", "l", "r")).collect()]
    assert got == [1_000_000 * a * a // (left * right) for a, left, right in rows]


def test_edge_cases(spark):
    hot = [("en", "very common words")] * 300
    rows = [*hot, (None, None), (None, "x y " * 20), ("en", ""), ("de", " \t"), ("fr", "w" * 300_000 + " ") , ("fr", "a b. " * 40_000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert found(co.collocations(docs)) == brute(rows)
    assert co.collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_summaries_keep_every_frequent_key(seed):
    """Whatever the order and the sizes of the merged summaries."""
    rng = np.random.default_rng(seed)
    threshold = 10
    draws = rng.zipf(1.3, 40_000).astype(np.uint64) % np.uint64(30_000)
    parts = np.array_split(draws, rng.integers(1, 60))
    summary = co.Summary(len(draws) // threshold + 1)
    for part in parts:
        summary.merge(*co.summed(part))
    keys, counts = co.summed(draws)
    assert summary.subtracted < threshold
    assert set(keys[counts >= threshold]) <= set(summary.frequent(threshold))
    assert len(summary.keys) <= summary.capacity


def test_tight_capacity_subtracts():
    summary = co.Summary(3)
    for key, count in ((1, 5), (2, 4), (3, 3), (4, 2), (5, 1)):
        summary.merge(np.array([key], np.uint32), np.array([count]))
    summary.settle()
    assert summary.subtracted > 0 and 1 in summary.keys and len(summary.keys) <= 3


def test_counts_pack_into_bytes():
    counts = np.array([1, 254, 255, 256, 10**12, 3])
    assert co.unpacked_counts(co.packed_counts(counts), 6).tolist() == counts.tolist()
