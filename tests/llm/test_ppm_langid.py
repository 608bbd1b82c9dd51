import math
import zlib

import numpy as np
import pytest
from small_tables import documents, sf  # noqa: F401
from stockflow.llm import ppm_langid as ppm
from stockflow.llm.queries import QUERIES

ENGLISH = "the cat and the dog were walking through the green field with their friends "
GERMAN = "der Hund und die Katze gingen durch das grüne Feld mit ihren Freunden "


@pytest.fixture(scope="module")
def model(documents):
    rows = [(i, ENGLISH + str(i), "en") for i in range(20)] + [(50 + i, GERMAN + str(i), "de") for i in range(20)]
    return ppm.fit(documents(rows))


def brute_bits(texts, text, most=3):
    """Code length by plain PPM with escape method C, on the bytes as they are."""
    counts = {}
    for t in texts:
        s = [32] * most + list(t.encode())
        for i in range(most, len(s)):
            for order in range(most + 1):
                followers = counts.setdefault(tuple(s[i - order : i]), {})
                followers[s[i]] = followers.get(s[i], 0) + 1
    bits, s = 0.0, [32] * most + list(text.encode())
    for i in range(most, len(s)):
        p = 1 / 256
        for order in range(most + 1):
            followers = counts.get(tuple(s[i - order : i]))
            if followers:
                total, kinds = sum(followers.values()), len(followers)
                p = followers[s[i]] / (total + kinds) if s[i] in followers else p * kinds / (total + kinds)
        bits -= math.log2(p)
    return bits


TEXTS = {"en": [ENGLISH + str(i) for i in range(20)], "de": [GERMAN + str(i) for i in range(20)]}
PROBES = ("the green dog", "Freunde gingen", "a", "THE the  9 walking\nfield", "東京 grün \x00\x7f", "")


def test_code_lengths_are_exact(model):
    data = np.frombuffer("".join(PROBES).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(p.encode()) for p in PROBES)])
    for probe, got in zip(PROBES, ppm.code_lengths(model, data, offsets), strict=True):
        for language, bits in zip(model.languages, got, strict=True):
            assert bits == pytest.approx(brute_bits(TEXTS[language], probe), rel=1e-9)


@pytest.mark.parametrize("order", [0, 1, 5, 7])
def test_contexts_of_any_order(documents, order):
    rows = [(i, t, lang) for lang, texts in TEXTS.items() for i, t in enumerate(texts)]
    model = ppm.fit(documents(rows), order=order)
    for probe in PROBES:
        data = np.frombuffer(probe.encode(), np.uint8)
        got = ppm.code_lengths(model, data, np.array([0, len(data)]))[0]
        for language, bits in zip(model.languages, got, strict=True):
            assert bits == pytest.approx(brute_bits(TEXTS[language], probe, order), rel=1e-9)


def test_predictions_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    learn = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and r.text:
            learn.setdefault(r.lang, set()).add(r.text)
    assert max(map(len, learn.values())) <= ppm.DOCS_PER_LANGUAGE  # so the sample is all of them
    got = {r.doc_id: r for r in QUERIES["op8_ppm_language_id"](spark, sf).collect()}
    shown = [r for r in sorted(rows, key=lambda r: r.doc_id) if r.text and len(r.text) < 2000 and any(map(str.isalpha, r.text))]
    for r in shown[::20]:
        bits = {lang: brute_bits(texts, r.text) for lang, texts in learn.items()}
        best = min(sorted(bits), key=bits.get)
        share = 1 / sum(2 ** min(0.0, bits[best] - b) for b in bits.values())
        assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == (best, pytest.approx(share, rel=1e-6))


def test_edge_cases(spark, documents, model):
    rows = [(1, None), (None, "the dog"), (2, ""), (3, "12 !? 7"), (4, "der Hund"), (4, "der Hund"), (5, "dog " * 60_000), (6, "東京")]
    docs = documents(rows).selectExpr("*", "'x' as score", "1 as lang_pred")
    got = ppm.identify(docs, model).collect()
    found = [(r.doc_id, r.lang_pred) for r in got]
    assert found == [(1, "und"), (None, "en"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (5, "en"), (6, found[-1][1])]
    assert found[-1][1] in ("de", "en") and all(0 <= r.score <= 1 for r in got)
    assert ppm.identify(docs.limit(0), model).count() == 0


def test_without_training_rows(documents):
    model = ppm.fit(documents([(1, "text"), (2, None, "en")]))
    assert [r.lang_pred for r in ppm.identify(documents([(1, "text")]), model).collect()] == ["und"]


def test_held_out_accuracy(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op8_ppm_language_id"](spark, sf).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    judged = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert judged and sum(r.lang_pred == docs[r.doc_id].lang for r in judged) >= 0.97 * len(judged)
