"""Language identification by prediction by partial matching (PPM).

One byte-context tree per language gives each byte a probability under the longest context
(``order`` bytes at most) that the language has seen, with an escape (method C: d distinct
followers among n take d/(n+d)) to the next shorter context and, below order 0, to equal chances
of all 256 bytes. The statistics are frozen after training, so the code length of a text is a
plain sum of table entries, over every byte of the whole text. The language with the shortest
code wins. Bytes are taken as they are: no folding, no smaller alphabet.

The trees are sparse: for each order, the grams (context and byte) that any language has seen,
sorted, with their code length in each language, escapes to shorter contexts included. A byte
whose gram no language has seen adds its context's escapes and is looked up one order lower.

The trees are fitted on at most ``docs_per_language`` different texts of each language, those
with the smallest hash: a documented bound. Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from stockflow.llm.common import frees, id_crc, ship, text_blocks

UNDETERMINED = "und"
SYMBOLS = 256
DOCS_PER_LANGUAGE = 400
ORDER = 3  # bytes of context
BLANK = 32  # what stands before a text

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class Model:
    """By order k: ``grams[k]`` (k bytes of context and the byte) with ``bits[k]``, ``contexts[k]``
    with ``escapes[k]``; a row of code lengths has an entry for each language."""

    languages: list[str]
    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


def training_rows(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows whose crc32 of the id leaves 1 to 4 modulo 5 and that have a text and a language."""
    return docs.where((id_crc(id_column) % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def _codes(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Each byte (lowest) and the ``order`` bytes before it; before a text all is blank."""
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = data.astype(np.uint64)
    codes = last.copy()
    for k in range(1, order + 1):
        now = np.empty_like(last)
        now[1:] = last[:-1]
        now[starts] = BLANK
        codes |= now << np.uint64(8 * k)
        last = now
    return codes


def _grams(batch: pa.Table, order: int) -> pa.Table:
    """The longest grams of one language's sample, with their counts."""
    found = [
        np.unique(_codes(data, offsets, order), return_counts=True) for _, _, data, offsets in text_blocks(batch["text"])
    ]
    grams, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    counts = np.bincount(where, np.concatenate([n for _, n in found]), len(grams)).astype("<i8")
    language = batch["lang"][0].as_py()
    return pa.table({"lang": [language], "grams": [grams.astype("<u8").tobytes()], "counts": [counts.tobytes()]})


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, order: int = ORDER) -> Model:
    """Trees of all languages of ``docs`` (text, lang), from a bounded sample of different texts.

    The sample goes by the hash of the text alone; repeated rows count once. Only the counted
    grams of the sample, which is bounded, come to the driver: in practice some ten thousand a
    language. ``order`` is 7 at most. Without labelled rows the model has no language.
    """
    if not 0 <= order <= 7:
        raise ValueError("a gram of more than 8 bytes does not fit its code")
    ship(docs.sparkSession)
    labelled = docs.select("lang", "text", F.xxhash64("text").alias("key")).where(F.col("text") != "")
    first = Window.partitionBy("lang").orderBy("key")
    chosen = labelled.select("lang", "key").distinct().withColumn("n", F.row_number().over(first))
    chosen = chosen.where(F.col("n") <= docs_per_language).drop("n")
    sample = labelled.join(F.broadcast(chosen), ["lang", "key"], "left_semi")  # languages x docs_per_language rows
    sample = sample.groupBy("lang", "key").agg(F.first("text").alias("text")).drop("key")
    counted = sample.groupBy("lang").applyInArrow(
        lambda rows: _grams(rows, order), "lang string, grams binary, counts binary"
    )
    counted = {r["lang"]: (np.frombuffer(r["grams"], "<u8"), np.frombuffer(r["counts"], "<i8")) for r in counted.collect()}
    return build(counted, order)


def build(counted: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """The trees of all languages from the counts of their longest grams."""
    languages = sorted(counted)
    model = Model(languages, [], [], [], [])
    if not languages:
        return model
    byte = np.uint64(8)
    for k in range(order + 1):
        keep = np.uint64((1 << 8 * (k + 1)) - 1)
        seen = {}
        for language in languages:
            codes, counts = counted[language]
            own, where = np.unique(codes & keep, return_inverse=True)
            seen[language] = own, np.bincount(where, counts, len(own))
        grams = np.unique(np.concatenate([own for own, _ in seen.values()]))
        contexts, of = np.unique(grams >> byte, return_inverse=True)
        if k:
            shorter = np.searchsorted(model.grams[k - 1], grams & np.uint64((1 << 8 * k) - 1))
            below = model.bits[k - 1][shorter]
        else:
            below = np.full((len(grams), len(languages)), np.log2(SYMBOLS))
        escapes = np.zeros((len(contexts), len(languages)))
        bits = np.empty_like(below)
        for column, language in enumerate(languages):
            own, counts = seen[language]
            at = np.searchsorted(grams, own)
            total = np.bincount(of[at], counts, len(contexts))
            kinds = np.bincount(of[at], minlength=len(contexts))
            known = total > 0  # another context takes nothing: its bytes are coded one order lower
            escapes[known, column] = np.log2(total[known] + kinds[known]) - np.log2(kinds[known])
            bits[:, column] = below[:, column] + escapes[of, column]
            bits[at, column] = np.log2(total[of[at]] + kinds[of[at]]) - np.log2(counts)
        model.grams.append(grams)
        model.bits.append(bits)
        model.contexts.append(contexts)
        model.escapes.append(escapes)
    return model


def _found(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``codes`` in a sorted table, and which of them are there."""
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return at, table[at] == codes


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits that each text takes in each language."""
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    full = np.flatnonzero(offsets[:-1] < offsets[1:])
    if not len(full) or not model.languages:
        return out
    order = len(model.grams) - 1
    codes = _codes(data, offsets, order)
    # Each gram that occurs is looked up once; the grams of a block are far fewer than its bytes.
    kinds, where = np.unique(codes, return_inverse=True)
    each = np.zeros((len(kinds), len(model.languages)))
    left = np.arange(len(kinds))
    for k in range(order, -1, -1):
        code = kinds[left] & np.uint64((1 << 8 * (k + 1)) - 1)
        at, there = _found(model.grams[k], code)
        each[left[there]] += model.bits[k][at[there]]
        left, code = left[~there], code[~there]
        at, there = _found(model.contexts[k], code >> np.uint64(8))
        each[left[there]] += model.escapes[k][at[there]]
    each[left] += np.log2(SYMBOLS)
    out[full] = np.add.reduceat(each[where], offsets[:-1][full], axis=0)
    return out


def has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    has = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for row in np.flatnonzero(~has).tolist():
        text = data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
        has[row] = any(map(str.isalpha, text))
    return has


def predict(model: Model, column: pa.Array) -> tuple[list[str], list[float]]:
    """Language and its share of the probability, all languages alike beforehand.

    A text that is null or has no letter, or a model without languages, gives ``und`` and 0.
    Ties go to the first language in order.
    """
    names, scores = [], []
    for start, end, data, offsets in text_blocks(column, 256 << 10):
        bits = code_lengths(model, data, offsets)
        has = has_letters(data, offsets)
        if not model.languages:
            has[:] = False
        else:
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(np.minimum(0, bits.min(axis=1)[:, None] - bits)).sum(axis=1)
        names += [model.languages[best[i]] if has[i] else UNDETERMINED for i in range(end - start)]
        scores += [float(share[i]) if has[i] else 0.0 for i in range(end - start)]
    return names, scores


def identify(
    docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, letters: str | None = None
) -> DataFrame:
    """``docs`` (columns ``keep``, all by default) with ``lang_pred`` and ``score``.

    ``letters`` names one more column: whether the text has a letter, whatever the model knows.
    Columns of these names are replaced; the rest pass through untouched, nulls and repeated
    rows included. No shuffle. The model, whose size depends on the languages and not on the
    rows, is broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", letters)]
    fields = [f for f in docs.schema.fields if f.name in keep]
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    added += [StructField(letters, BooleanType())] if letters else []

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(held.value, batch.column(text))
            columns = [batch.column(c) for c in keep]
            columns += [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            if letters:
                found = [x for _, _, data, offsets in text_blocks(batch.column(text)) for x in has_letters(data, offsets).tolist()]
                columns.append(pa.array(found, pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, [*keep, *(f.name for f in added)])

    wanted = list(dict.fromkeys([*keep, text]))
    return docs.select(*wanted).mapInArrow(run, StructType([docs.schema[f.name] for f in fields] + added))
