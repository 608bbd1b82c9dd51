import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F
from small_tables import sf  # noqa: F401
from stockflow.llm import merkle_log as ml
from stockflow.llm.queries import QUERIES


def h(text):
    return sha256(text.encode()).hexdigest()


def levels(leaves):
    out = [list(leaves)]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, place):
    out = []
    for row in tree[:-1]:
        other = place ^ 1
        node = row[other] if other < len(row) else ""
        out.append((node, "") if place & 1 else ("", node))
        place >>= 1
    return out


def cell(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def digest(r, more=0):
    n = r["n_chars"] if r["n_chars"] is None else r["n_chars"] + more
    return h("".join(cell(x) for x in (r["doc_id"], r["source"], r["lang"], n, r["text"])))


def brute(rows, tampered):
    trees = {}
    for r in rows:
        claimed = digest(r, 1) if tampered(r["doc_id"]) else digest(r)
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, digest(r), claimed, r["doc_id"]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {name: levels([x[2] for x in sorted(trees[name])]) for name in names}
    top = levels([built[name][-1][0] for name in names])
    out = []
    for at, name in enumerate(names):
        for place, (_, _, leaf, claimed, doc) in enumerate(sorted(trees[name])):
            steps = path(built[name], place) + path(top, at)
            node = claimed
            for left, right in steps:
                node = h(left + node + right)
            proof = h("".join(a + b for a, b in steps))
            out.append((doc, leaf, built[name][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 11, 16, 21, 63, 64, 100])
def test_log_is_addressed_in_closed_form(n):
    leaves = [h(str(i)) for i in range(n)]
    tree = levels(leaves)
    for height in (ml.tree_height(n), ml.tree_height(n) + 3):
        log = ml.append_log(leaves, height)
        assert len(log) == ml.log_size(n, height)
        for level, row in enumerate(tree):
            at = ml.log_positions(level, range(len(row)), n)
            assert [log[p] for p in at] == row
        text = "".join(log)
        if height == len(tree) - 1:
            assert log[-1] == tree[-1][0]
            got = ml.siblings(text, n, height, range(n))
            assert got == [path(tree, i) for i in range(n)]
            assert all(ml.fold(x, p) == tree[-1][0] for x, p in zip(leaves, got, strict=True))
            assert all(ml.unpacked(ml.packed(p)) == p for p in got)


def test_nodes_stand_in_completion_order():
    log = ml.append_log(list("abcdef"), 3)
    order = [log.index(x) for x in "abcdef"]
    assert order == [0, 1, 3, 4, 7, 8]  # after b its pair, after d its pair and the four


@pytest.mark.parametrize("height", [1, 2, 3, 12])
def test_manifest_against_brute_force(spark, height):
    rows = [
        {"doc_id": i if i % 17 else None, "source": None if i % 5 == 0 else f"s{i % 3}", "lang": (None, "en", "é", "de", "")[i % 5 if i % 4 else 1],
         "n_chars": None if i % 7 == 0 else i * 3, "text": None if i % 11 == 0 else "" if i % 13 == 0 else f"wörd {i} " * (i % 4)}
        for i in range(90)
    ]
    rows += [dict(rows[20])] * 9 + [{"doc_id": 5, "source": "x", "lang": "en", "n_chars": 2**63 - 1, "text": "y" * 200_000}]
    rows += [{"doc_id": 3, "source": None, "lang": "alone", "n_chars": 1, "text": "a"}]
    docs = spark.createDataFrame([(*r.values(), "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string")
    tampered = F.col("doc_id").isNotNull() & (F.col("doc_id") % 3 == 0)
    got = ml.manifest(docs, tampered, height=height).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, lambda i: i is not None and i % 3 == 0)
    assert any(r.verified for r in got) and not all(r.verified for r in got)


def test_query_against_brute_force(spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op12_merkle_manifest"](spark, sf).collect()
    want = brute(rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 0)
    assert sorted(map(tuple, got), key=repr) == want
    hit = {r.doc_id for r in got if not r.verified}
    assert hit == {r["doc_id"] for r in rows if r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert ml.manifest(docs).count() == 0


def test_runs_of_equal_leaves_are_cut_at_segments(spark):
    rows = spark.createDataFrame([("t", 3, 10)], "tree string, start long, n_ long")
    got = sorted((r.segment, r["first"], r.n_) for r in ml.pieces(rows, 2).collect())
    assert got == [(0, 3, 1), (1, 0, 4), (2, 0, 4), (3, 0, 1)]
