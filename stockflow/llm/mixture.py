"""Mixing sources to target weights: repetition rates, whole copies and a hash-seeded remainder.

Tokens (words) are summed per source and turned into targets: the budget is shared by weight, a
target stops at ``limit`` times its source's size, and what is over goes to the others by
weight, until none is above. With sources in ascending order of cap per weight that has a closed
form: the first sources that reach their cap before their turn's share keep it, the others
divide the rest. Sums stay whole numbers until the one division that makes the target.

A source's rate is its target over its size. Each document is taken floor(rate) times, and once
more with a chance of the rate's fraction f: a Bernoulli draw from hashes, which any rerun
repeats. The draws of a source are spread evenly: its documents are numbered by (size class,
hash of the document), and number r is taken where floor((r + 1) f + u) passes floor(r f + u),
with u in [0, 1) from a hash of the seed and the source. Over seeds each document's chance is f;
for any seed, any run of numbers has its share to within one document, so a source's taken words
miss its target by about its largest document at most, where independent draws would miss by
many in a source with few.

All of it is column expressions. Equal rows are counted before they move, so one row that makes
up a third of the table is one row of the shuffle; their numbers are handed out in chunks that
are dealt to all tasks. There is one rate row per source; Spark joins it by its measured size.

Edge cases: a null text has no words; a null id, source or text is a value of its own in
grouping and the empty text in the hash; a source without words has target 0 and rate 0; an
empty table gives no rows; other columns do not matter (``mix`` passes them through).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 4096  # equal rows numbered at a time
KEYS = ["doc_id", "source", "digest_", "row_"]


def word_count(text: str | Column) -> Column:
    """Words between blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), source: str = "source") -> DataFrame:
    """``sources`` (one row each) with ``weight``, repeating in code point order, null last.

    Spark compares strings by their UTF-8 bytes, which is the order of code points.
    """
    place = F.row_number().over(Window.orderBy(F.col(source).isNull(), source)) - 1
    each = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    return sources.withColumn("weight", F.element_at(each, (place % len(weights) + 1).cast("int")))


def target_rates(
    sources: DataFrame, share: tuple[int, int] = (3, 2), limit: int = 2, source: str = "source"
) -> DataFrame:
    """target and rate of every row of ``sources`` (source, source_size, weight > 0).

    The budget is ``share`` (a fraction) of all sizes. One row per source, the mixture's own
    declaration, is all that meets in the windows. Needs share <= limit, else all are capped.
    """
    over, under = share
    cap = F.lit(limit) * F.col("source_size")
    order = [(cap.cast("double") / F.col("weight")), F.col(source).isNull(), F.col(source)]
    everything = Window.partitionBy(F.lit(1))
    before = everything.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    shared = sources.withColumns({
        # under * (words left when all earlier sources keep their cap), and the weights left
        "left_": F.lit(over) * F.sum("source_size").over(everything)
        - F.lit(under) * F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "weights_": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # cap < weight * left / (under * weights), without a division
    wide = F.col("weights_").cast("decimal(18,0)")
    capped = (F.lit(under) * cap).cast("decimal(20,0)") * wide < F.col("weight") * F.col("left_")
    shared = shared.withColumn("open_", ~capped)
    first = everything.orderBy(F.col("open_").desc(), *order).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    top, bottom = F.first("left_").over(first), F.first("weights_").over(first)
    # a source is capped exactly if every source before it is, so the first open one sets the level
    portion = (F.col("weight") * top).cast("double") / (F.lit(under) * bottom).cast("double")
    target = F.when(F.col("open_"), portion).otherwise(cap.cast("double"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return shared.withColumn("target", target).withColumn("rate", rate).drop("left_", "weights_", "open_")


def _hash(parts: Sequence[Column], seed: int) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.md5(text.cast("binary"))


def size_class(size: Column) -> Column:
    """A number that grows with the size: its bits and the first three of them."""
    bits = F.length(F.bin(size))
    first = F.call_function("shiftright", size, F.greatest(bits - 3, F.lit(0)))
    return (bits * 8 + first).cast("int")


def numbered(counted: DataFrame) -> DataFrame:
    """``counted`` with ``rank_``, the number of its first row in its source by (class, hash).

    Rows are numbered inside a bucket, the first two digits of the hash in a size class, and
    the rows of the source's buckets before are added: at most 256 figures a class.
    """
    rows = counted.withColumn("bucket_", F.substring("hash_", 1, 2))
    sums = rows.groupBy("source", "class_", "bucket_").agg(F.sum("n_").alias("size_"))
    before = (Window.unboundedPreceding, -1)
    ahead = F.sum("size_").over(Window.partitionBy("source").orderBy("class_", "bucket_").rowsBetween(*before))
    sums = sums.select(
        F.col("source").alias("s_"),
        F.col("class_").alias("c_"),
        F.col("bucket_").alias("b_"),
        F.coalesce(ahead, F.lit(0)).alias("ahead_"),
    )
    inside = Window.partitionBy("source", "class_", "bucket_").orderBy("hash_", *KEYS).rowsBetween(*before)
    rows = rows.withColumn("inside_", F.coalesce(F.sum("n_").over(inside), F.lit(0)))
    same = rows["source"].eqNullSafe(sums["s_"]) & (F.col("class_") == F.col("c_")) & (F.col("bucket_") == F.col("b_"))
    rows = rows.join(sums, same).withColumn("rank_", F.col("ahead_") + F.col("inside_"))
    return rows.drop("s_", "c_", "b_", "bucket_", "ahead_", "inside_")


def repeated(rows: DataFrame, n: str, name: str, keys: Sequence[str]) -> DataFrame:
    """Each row ``n`` (at least 1) times, numbered from 0 in ``name``.

    Chunks of ``CHUNK`` numbers are dealt out by hash, so no task lists one row's numbers alone.
    """
    whole = [F.lit(x).cast("long") for x in (0, CHUNK)]
    chunks = rows.select("*", F.explode(F.sequence(whole[0], F.col(n) - 1, whole[1])).alias("from_"))
    chunks = chunks.repartition(*keys, "from_")
    until = F.least(F.col("from_") + CHUNK, F.col(n)) - 1
    return chunks.select("*", F.explode(F.sequence(F.col("from_"), until)).alias(name)).drop("from_", n)


def with_copies(counted: DataFrame, rates: DataFrame, seed: int = 0) -> DataFrame:
    """One row per document with ``copies``, how often the mix takes it.

    ``counted`` has ``KEYS``, ``size`` and ``n_`` (equal rows). A document whose source has no
    row in ``rates`` is taken 0 times.
    """
    rows = counted.withColumns({
        "class_": size_class(F.col("size")),
        "hash_": _hash([F.col(k) for k in ("doc_id", "source", "digest_")], seed),
    })
    rows = numbered(rows)
    given = rates.select(F.col("source").alias("of_"), "source_size", "target", "rate")
    rows = rows.join(given, rows["source"].eqNullSafe(given["of_"]), "left").drop("of_")
    rows = repeated(rows, "n_", "own_", KEYS).withColumn("rank_", F.col("rank_") + F.col("own_"))
    rate = F.coalesce("rate", F.lit(0.0))
    whole = F.floor(rate)
    part = rate - whole.cast("double")
    start = F.conv(F.substring(_hash([F.col("source")], seed), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    once_more = F.floor((F.col("rank_") + 1) * part + start) - F.floor(F.col("rank_") * part + start)
    return rows.withColumn("copies", (whole + once_more).cast("long")).drop("class_", "hash_", "rank_", "own_", "rate")


def source_sizes(counted: DataFrame) -> DataFrame:
    return counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n_")).alias("source_size"))


def _keyed(docs: DataFrame, row: Column) -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return ["doc_id", "source", F.md5(text).alias("digest_"), row.alias("row_"), word_count("text").alias("size")]


def _counted(keyed: DataFrame) -> DataFrame:
    return written(keyed.groupBy(*KEYS, "size").agg(F.count(F.lit(1)).alias("n_")), "mix_sizes")


def mixture(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    limit: int = 2,
    seed: int = 0,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words) of every document."""
    counted = _counted(docs.select(*_keyed(docs, F.lit(""))))
    rates = written(target_rates(cyclic_weights(source_sizes(counted), weights), share, limit), "mix_rates")
    rows = with_copies(counted, rates, seed).drop("digest_", "row_")
    return rows.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, rates: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed corpus: every row of ``docs``, all columns, as often as it is taken.

    ``rates`` (source, source_size, target, rate) comes from ``target_rates``. Copies are drawn
    on keys and digests alone; the texts move twice, once to leave one of equal rows and once
    to deal out its copies. Rows are equal if their columns, written as JSON, are. The draws are
    those of ``mixture``: rows of one id, source and text share its numbers in this order.
    """
    full = F.struct(*[F.col(c) for c in docs.columns])
    keyed = docs.select(*_keyed(docs, F.md5(F.to_json(full).cast("binary"))), full.alias("full_"))
    drawn = with_copies(_counted(keyed.drop("full_")), rates, seed)
    taken = drawn.groupBy(*[F.col(k).alias("t" + k) for k in KEYS]).agg(F.sum("copies").alias("copies")).filter("copies > 0")
    one = keyed.dropDuplicates(KEYS)
    rows = one.join(taken, reduce(lambda a, b: a & b, [one[k].eqNullSafe(taken["t" + k]) for k in KEYS]))
    return repeated(rows, "copies", "copy_", KEYS).select("full_.*")
