import collections

import corpus_pipeline as cp
import test_circulant_minhash as near
import test_decontaminate as bench
import test_packing as packs
import test_ppm_langid as lang
import test_suffix_dedup as suffix
from small_tables import sf  # noqa: F401
from stockflow.llm import suffix_dedup

assert near and bench and packs and lang and suffix


def repeats(texts, length):
    """What is left of each text, whole characters only."""
    datas = [t.encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        spans = suffix_dedup.merged([(i, i + length) for i in range(len(d) - length + 1) if seen[d[i : i + length]] > 1])
        for a, b in reversed(suffix_dedup.on_characters(d, spans)):
            d = d[:a] + d[b:]
        out.append(d.decode())
    return out


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert [name for name, _ in cp.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontaminate", "packing"]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name == "language_id":
            rows = {k: t for k, t in rows.items() if any(c.isalpha() for c in t)}
        elif name == "near_dedup":
            kept = {doc for doc, _, _, kept in near.brute(list(rows.items()), 5) if kept}
            assert len(kept) < len(rows)
            rows = {k: t for k, t in rows.items() if k in kept}
        elif name == "suffix_dedup":
            rows = dict(zip(rows, repeats(list(rows.values()), cp.PASSAGE_BYTES), strict=True))
        elif name == "decontaminate":
            hit = {r[0] for r in bench.brute(list(rows.items()), items) if r[-1]}
            assert hit
            rows = {k: t for k, t in rows.items() if k not in hit}
        else:
            packs.check(list(rows.items()), out.collect(), cp.SEQUENCE)
            break
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        got = {r.doc_id: r for r in docs.collect()}
        assert {k: r.text for k, r in got.items()} == rows
        assert all(r.n_chars == len(r.text) for r in got.values())


def test_texts_without_letters_go_whatever_languages_are_known(spark, sf):
    rows = [(1, None, None), (2, "", None), (3, "12 !", None), (4, "words", None), (5, "東", None), (None, "9", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = table.selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as long) as n_chars")
    labelled = spark.createDataFrame([(7, "more words", "en", "s", 10)], docs.schema)
    assert {r.doc_id for r in cp.identify_language(spark, docs, sf).collect()} == {4, 5}
    assert {r.doc_id for r in cp.identify_language(spark, docs.unionByName(labelled), sf).collect()} == {4, 5, 7}


def test_one_row_of_each_near_duplicate_group_stays(spark, sf):
    long = " ".join(f"w{i}" for i in range(60))
    other, third = long.replace("w", "x"), long.replace("w", "y")
    rows = [(4, long), (4, long), (4, long), (4, long + " end"), (9, long), (None, long)]  # one group
    rows += [(None, other), (None, other), (None, other + " end")]  # without any id
    rows += [(None, third), (None, third)]  # another one
    rows += [(4, "a text of its own"), (5, "x y"), (6, None), (6, None), (None, " ")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    docs = table.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    left = cp.drop_near_duplicates(spark, docs, sf)
    assert left.columns == docs.columns
    got = collections.Counter((r.doc_id, (r.text or "")[:2]) for r in left.collect())
    want = [(4, "w0"), (None, "x0"), (None, "y0"), (4, "a "), (5, "x "), (6, ""), (6, ""), (None, " ")]
    assert got == collections.Counter(want)


def test_run(spark, sf):
    assert cp.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_edge_cases(spark, sf):
    rows = [(None, None, None), (1, None, "en"), (2, "", "en"), (3, "12", "en"), (4, "a few words", None), (4, "a few words", None)]
    rows += [(5, "the long text " * 30_000, "en"), (6, "texte français avec des mots", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "doc_id", "text", "lang", "'s' as source", "cast(length(text) as long) as n_chars"
    )
    for start in (docs, docs.limit(0)):
        left = start
        for name, stage in cp.STAGES:
            left = stage(spark, left, sf)
            assert name == "packing" or left.columns == docs.columns
        left.collect()
