import hashlib
import random
import re

import pytest
from small_tables import documents, sf  # noqa: F401
from stockflow.llm import decontaminate as dc
from stockflow.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                names = windows.get(tuple(w[i : i + n]))
                if names:
                    hit.update(range(i, i + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(
        (
            (r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated)
            for r in df.collect()
        ),
        key=repr,
    )


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = QUERIES["op4_decontaminate"](spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, items)
    assert any(r.contaminated for r in got)


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 40])
def test_small_alphabet(spark, documents, block_bytes):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    rows = [(i, text(rng.randrange(40))) for i in range(40)]
    items = [(i, text(rng.randrange(1, 9))) for i in range(12)] + [(3, "a b"), (20, "c"), (21, None), (22, " -- "), (None, "b b b b")]
    items = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(documents(rows), items, window=5, block_bytes=block_bytes)
    assert rows_of(got) == brute(rows, [tuple(r) for r in items.collect()], window=5)


def test_edge_cases(spark, documents):
    long = "filler words " * 100_000
    passage = "Alpha, beta GAMMA delta: epsilon zeta eta theta iota kappa lambda"
    rows = [(1, None), (2, ""), (None, passage), (3, long + passage.lower()), (4, passage[:-7]), (4, passage[:-7]), (5, "été α")]
    docs = documents(rows).selectExpr("*", "1 as n_hit", "'x' as items", "2 as spans_", "3 as n_words", "4 as text_")
    items = spark.createDataFrame([("q", passage), ("q", passage), ("r", "ÉTÉ")], "item_id string, text string").selectExpr("*", "1 as name")
    got = dc.contaminated(docs, items, keep=["doc_id"])
    assert rows_of(got) == brute(rows, [("q", passage), ("r", "ÉTÉ")])
    assert "lang" in dc.contaminated(docs, items).columns
    assert dc.contaminated(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in dc.contaminated(docs, items.limit(0)).collect())
