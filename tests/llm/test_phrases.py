import hashlib
import random

import numpy as np
import pytest
from small_tables import documents, sf  # noqa: F401
from stockflow.llm import phrases as ph
from stockflow.llm.queries import QUERIES


def brute_next_level(names):
    """Phrase boundaries of one text by the rules, one name at a time."""
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    wide = []
    for x, n in runs:
        one = np.array([x], np.uint64)
        if n > 1:
            one = ph.mix(one + np.uint64(n) * np.uint64(0x9FB21C651E98DF25))
        wide.append(int(one[0]))
    labels = wide
    for _ in range(4):
        fresh = []
        for i, x in enumerate(labels):
            differ = labels[i - 1] ^ x if i else 1
            place = (differ & -differ).bit_length() - 1
            fresh.append(2 * place + (x >> place & 1))
        labels = fresh
    assert all(x < 6 for x in labels[1:]) and all(a != b for a, b in zip(labels, labels[1:], strict=False))
    begin = [i for i in range(len(wide)) if i == 0 or (i < len(wide) - 1 and labels[i - 1] < labels[i] > labels[i + 1])]
    return [wide[a:b] for a, b in zip(begin, [*begin[1:], len(wide)], strict=True)]


def test_phrases_follow_the_rules():
    rng = random.Random(8)
    texts = [[rng.randrange(4) + 97 for _ in range(rng.randrange(60))] for _ in range(50)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    names, at = ph.next_level(np.array(sum(texts, []), np.uint8), offsets, 1)
    seen = {}
    for i, text in enumerate(texts):
        want = brute_next_level(text)
        got = names[at[i] : at[i + 1]].tolist()
        assert len(got) == len(want)
        for name, phrase in zip(got, want, strict=True):
            assert seen.setdefault(name, phrase) == phrase
    assert len(set(map(tuple, seen.values()))) == len(seen)


def test_equal_substrings_share_their_inside():
    rng = random.Random(9)
    body = bytes(rng.randrange(97, 123) for _ in range(4000))
    for before in (b"", b"x", b"some other start "):
        a, b = (ph.next_level(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 1)[0] for t in (body, before + body))
        assert a[6:].tolist() == b[-len(a) + 6 :].tolist()


def test_alone_or_in_a_block():
    rng = random.Random(10)
    texts = [bytes(rng.choice(b"ab c") for _ in range(rng.randrange(300))) for _ in range(40)] + [b"", b"aaaa", b"a"]
    together = ph.fingerprints(texts)
    assert all((ph.fingerprints([t])[0] == together[i]).all() for i, t in enumerate(texts))


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = ph.fingerprints([text.encode(), edited.encode(), after.encode()])
        like = lambda x, y: float(ph.likeness(x[None], y[None])[0])
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), ph.as_text(a), ph.as_text(b), like(a, b), like(a, c)))
    return sorted(out)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows_of(QUERIES["op6_phrase_fingerprints"](spark, sf))
    assert got == brute(rows)
    assert np.median([r[5] for r in got]) > 0.4 > 0.1 > np.median([r[6] for r in got])


@pytest.mark.parametrize("n", [0, 1, 2, 9])
def test_few_rows(documents, n):
    rows = [(i * 3 - 4, None if i == 3 else "" if i == 5 else f"text número {i} " * i) for i in range(n)]
    docs = documents(rows).selectExpr("*", "1 as tie", "'x' as bucket", "2 as fingerprint", "'i' as id")
    assert rows_of(ph.compare_with_next(docs)) == (brute(rows) if rows else [])


def test_rows_without_id_and_repeated_rows(documents):
    rows = [(None, "none"), (None, "none"), (None, "other"), (2, "two"), (2, "two"), (2, "zwei"), (1, "long é " * 50_000)]
    got = ph.compare_with_next(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(d), len(t)) for d, t in rows)
    by_text = {}
    for r in got:
        assert by_text.setdefault((r.doc_id, r.n_chars), r.fingerprint) == r.fingerprint or r.n_chars in (4, 3)


def test_added_column(documents):
    docs = documents([(1, "some text that is long enough"), (None, None)]).selectExpr("*", "1 as fingerprint")
    marks = [r.fingerprint for r in ph.add_fingerprint(docs).collect()]
    assert len(marks[0]) == 4 * ph.BINS and marks[1] == ph.EMPTY * ph.BINS


def test_the_hierarchy_ends_with_the_whole_text():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    text = " ".join(words).encode()
    names, at, level = np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0
    keys = []
    while level < ph.FROM_LEVEL or len(names) > 1:
        level += 1
        names, at = ph.next_level(names, at, level)
        if level >= ph.FROM_LEVEL:
            keys += ph.mix(names + np.uint64(level)).tolist()
    assert level > 6
    want = {}
    for key in sorted(keys, reverse=True):
        want[key >> 58] = key
    marks = [int(ph.mix(np.array([want[b]], np.uint64))[0] & np.uint64(0xFFFF)) if b in want else -1 for b in range(ph.BINS)]
    assert ph.fingerprints([text, b"short", text[:90]])[0].tolist() == marks
