from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from small_tables import documents, sf  # noqa: F401
from stockflow.llm import mixture as mx
from stockflow.llm.queries import QUERIES


def brute_targets(sizes, weights, share=Fraction(3, 2), limit=2):
    """Shares by rounds, in fractions: cap those above, share the rest anew."""
    budget, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        left, total = budget - sum(capped.values()), sum(weights[s] for s in free)
        shares = {s: left * weights[s] / total for s in free}
        above = {s: Fraction(limit * sizes[s]) for s in free if shares[s] > limit * sizes[s]}
        if not above:
            return capped | shares
        capped |= above


def tables(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100, "d": 100, "e": 3},
    {"a": 0, "b": 7, "c": 1000, None: 10},
    {"a": 5}, {"a": 0, "b": 0}, {f"s{i:02d}": (i * 7919) % 501 for i in range(23)},
])
def test_targets_against_rounds(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r for r in mx.target_rates(mx.cyclic_weights(rows)).collect()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    assert {s: r.weight for s, r in got.items()} == weights
    if sum(sizes.values()):
        want = brute_targets(sizes, weights)
        assert {s: r.target for s, r in got.items()} == {s: float(x) for s, x in want.items()}
    else:
        assert all(r.target == 0 for r in got.values())


def test_query_keeps_the_contract(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    first, second = [{r.doc_id: r for r in QUERIES["op11_mix_sources"](spark, sf).collect()} for _ in range(2)]
    assert first == second and set(first) == set(docs)
    taken, largest, target = Counter(), defaultdict(int), {}
    for i, r in first.items():
        text = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in docs[i].text or "")
        assert r["size"] == len([w for w in text.split(" ") if w])
        assert r.taken in (0, r["size"], 2 * r["size"])
        source = docs[i].source
        taken[source] += r.taken
        largest[source] = max(largest[source], r["size"])
        target[source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1.25 * largest[s] for s in target)


def test_draws_are_bernoulli_over_seeds(spark):
    rows = tables(spark, [(i, "a", "w " * (1 + i % 7)) for i in range(12)] + [(100, "b", "w " * 40)])
    hits, rounds = Counter(), 60
    for seed in range(rounds):
        for r in mx.mixture(rows, weights=(1, 1), seed=seed).filter("source = 'a'").collect():
            hits[r.doc_id] += r.copies
    rate = r.target / r.source_size
    assert all(abs(hits[i] / rounds - rate) < 0.25 for i in range(12))
    assert sum(hits.values()) / 12 / rounds == pytest.approx(rate, abs=0.05)


def test_edge_cases(spark):
    same = [(7, "hot", "one two three")] * 9_000
    rows = [(None, None, None), (None, "hot", "x"), (1, "hot", ""), (2, "", "é " * 50_000), (2, "", "z"), (3, "empty", None)]
    docs = tables(spark, same + rows).selectExpr("*", "1 as size", "'q' as copies", "2 as n_", "3 as rank_")
    got = mx.mixture(docs, share=(5, 4)).collect()
    assert len(got) == len(same) + len(rows)
    sizes, target, taken = Counter(), {}, Counter()
    for r in got:
        sizes[r.source] += r["size"]
        target[r.source] = r.target
        taken[r.source] += r.taken
        assert r.taken <= 2 * r["size"]
    assert sizes == {"hot": 27_001, "": 50_001, None: 0, "empty": 0}
    assert abs(taken["hot"] - target["hot"]) <= 4 and target[None] == 0
    copies = Counter(r.copies for r in got if r.doc_id == 7)
    rate = target["hot"] / 27_001
    assert copies[int(rate) + 1] / 9_000 == pytest.approx(rate % 1, abs=0.001)
    assert mx.mixture(docs.limit(0)).count() == 0


def test_mix_emits_whole_rows(spark):
    rows = [(i % 40, f"s{i % 3}", "w " * (i % 5), i % 2) for i in range(160)] + [(None, None, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copies int")
    counted = docs.select("source", mx.word_count("text").alias("size")).selectExpr("*", "1 as n_")
    rates = mx.target_rates(mx.cyclic_weights(mx.source_sizes(counted)))
    mixed = mx.mix(docs, rates)
    assert mixed.columns == docs.columns
    got = Counter((r.doc_id, r.source, r.text) for r in mixed.collect())
    want = Counter()
    for r in mx.mixture(docs).collect():
        want[(r.doc_id, r.source)] += r.copies
    assert {k: v for k, v in want.items() if v} == dict(sum((Counter({k[:2]: n}) for k, n in got.items()), Counter()))
    assert set(tuple(r) for r in mixed.collect()) <= set(rows)


def test_plan_has_no_python(spark, sf):
    plan = QUERIES["op11_mix_sources"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
