"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``. ``run`` writes each stage's result as Parquet in the
shared folder and reads it back for the next one, so a lost executor costs one stage at most.

The tokenizer and the byte lengths cannot be put into SQL, so there is no ORACLE_SQL; the tests
hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm import circulant_minhash, decontaminate, packing, ppm_langid, suffix_dedup
from stockflow.llm.common import table, text_key, written
from stockflow.llm.tokens import tokenizer_path

SHINGLE_WORDS = 5
PERCENT = 80
#: Fifty words of running text, with room for short ones.
PASSAGE_BYTES = 240
WINDOW_WORDS = 10
SEQUENCE = 2048
END_ID = 1

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without any letter go; a missing language is filled in with the predicted one."""
    model = ppm_langid.fit(ppm_langid.training_rows(docs))
    found = ppm_langid.identify(docs, model, letters="has_letter").where("has_letter")
    found = found.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that with the least id, rows without an id
    last; among rows of one id that with the least text key; of copies of that one, any.

    Texts without a word are in no group and stay.
    """
    found = circulant_minhash.near_duplicates(docs, width=SHINGLE_WORDS, percent=PERCENT, group="group")
    found = found.where(F.col("group").isNotNull())
    rows = found.groupBy("group", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows, "near_rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    least = rows.groupBy(F.col("group").alias("of")).agg(F.min(order).alias("least"))
    stays = F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.text_key") == F.col("text_key"))
    marks = rows.join(least, F.col("group") == F.col("of")).select(
        F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), stays.alias("stays"), "n"
    )
    marks = written(marks.where(~F.col("stays") | (F.col("n") > 1)), "near_marks")
    same = docs["doc_id"].eqNullSafe(marks["m_id"]) & (text_key(docs["text"]) == marks["m_key"])
    single = docs.join(marks, same, "left_anti")
    copied = marks.where("stays")
    if copied.isEmpty():
        return single
    # Tasks leave one of their copies each before these meet.
    copies = docs.join(copied, same).dropDuplicates(["m_id", "m_key"]).select(*docs.columns)
    return single.unionByName(copies)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once go, wherever they stand; whole characters only.

    Null texts stay null; a text that was all repeats is left empty.
    """
    left = suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES, whole_characters=True)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.decode("kept_text", "UTF-8")).otherwise(F.col("text"))
    left = left.withColumn("text", text)
    return left.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), window=WINDOW_WORDS)
    return found.where(~F.col("contaminated")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=END_ID, length=SEQUENCE, keep_words=False)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeated_passages),
    ("decontaminate", decontaminate_benchmark),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
