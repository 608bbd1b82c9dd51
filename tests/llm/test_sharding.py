import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from small_tables import documents, sf  # noqa: F401
from stockflow.llm import sharding as sh
from stockflow.llm.queries import QUERIES


def brute_shard(key, leaves):
    def draw(path, weight):
        bits = int(hashlib.md5(f"{path}:{key}".encode()).hexdigest()[:12], 16)
        return math.log((bits + 0.5) / (1 << 48)) / weight

    def total(name, inner):
        out = defaultdict(float)
        for leaf in inner:
            out[getattr(leaf, name)] += leaf.weight
        return out

    region = max(total("region", leaves).items(), key=lambda x: draw(x[0], x[1]))[0]
    inner = [x for x in leaves if x.region == region]
    rack = max(total("rack", inner).items(), key=lambda x: draw(f"{region}/{x[0]}", x[1]))[0]
    return max((x for x in inner if x.rack == rack), key=lambda x: draw(f"{region}/{rack}/{x.shard}", x.weight)).shard


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op1_hash_tree_shards"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots = defaultdict(list)
    for r in got:
        data = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.shard == brute_shard(r.doc_id, sh.tree(8))
        assert r.grown_shard in (r.shard, 8) and r.grown_shard == brute_shard(r.doc_id, sh.tree(9))
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(8))


def test_shares_follow_weights_and_moves_stay_in_changed_subtrees(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("shard", F.lit("clash"))
    leaves = [sh.Leaf("a", "k", 0, 1), sh.Leaf("a", "l", 1, 2), sh.Leaf("b", "k", 2, 3), sh.Leaf("b", "l", 3, 2)]
    before = {r.doc_id: r for r in sh.place(keys, leaves).collect()}
    counts = Counter(r.shard for r in before.values())
    assert all(abs(counts[x.shard] / 20_000 - x.weight / 8) < 0.02 for x in leaves)
    heavier = [*leaves[:3], sh.Leaf("b", "l", 3, 4)]
    for r in sh.place(keys, heavier).collect():
        old = before[r.doc_id]
        if r.shard != old.shard:
            assert r.region == "b" and (old.region == "a" or r.rack == "l")
    for n in (8, 9, 12):
        now = {r.doc_id: r.shard for r in sh.place(keys, sh.tree(n)).collect()}
        more = {r.doc_id: r.shard for r in sh.place(keys, sh.tree(n + 1)).collect()}
        assert all(more[k] in (now[k], n) for k in now) and n in more.values()


def test_one_more_shard_takes_rows_only_into_itself(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    given = [sh.Leaf("x4", "k", 0, 1), sh.Leaf("a", "l", 1, 2), sh.Leaf("b", "k", 2, 0), sh.Leaf("b", "l", 3, 0.5)]
    for leaves in [sh.tree(n) for n in range(1, 13)] + [given]:
        new = max(x.shard for x in leaves) + 1
        both = sh.place(sh.place(docs, leaves), sh.grown(leaves), prefix="grown_")
        moves = {(r.shard, r.grown_shard) for r in both.select("shard", "grown_shard").distinct().collect()}
        assert all(after in (before, new) for before, after in moves)
        assert {x for x, _ in moves} == {x.shard for x in leaves if x.weight} and new in {x for _, x in moves}
    for options in ({"n_shards": 3}, {"leaves": given}):
        new = 3 if "n_shards" in options else 4
        rows = sh.shard_documents(docs, **options).collect()
        assert len(rows) == 2_000 and all(r.grown_shard in (r.shard, new) for r in rows)
    for n, base in ((2, 2), (3, 3), (5, 5), (9, 8)):
        assert sh.grown(sh.tree(n, base)) == sh.tree(n + 1, base)


def test_edge_cases(documents):
    rows = [(None, None), (None, "x"), (1, ""), (1, ""), (1, ""), (2, "é" * 100_000), (3, None)]
    docs = documents(rows).selectExpr("*", "'q' as shard", "1 as slot", "2 as size", "'n' as n_", "0 as bucket_")
    got = sh.shard_documents(docs).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted(
        (str(d), len((t or "").encode()) + 1) for d, t in rows
    )
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sh.shard_documents(docs.limit(0)).count() == 0


def test_plan_has_no_python(spark, sf):
    plan = QUERIES["op1_hash_tree_shards"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "SinglePartition"))
