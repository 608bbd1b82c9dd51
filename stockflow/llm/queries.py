"""The operators as queries over the test tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm import (
    chat_format,
    circulant_minhash,
    collocations,
    decontaminate,
    lattice_lm,
    merkle_log,
    mixture,
    packing,
    phrases,
    ppm_langid,
    sharding,
    suffix_dedup,
    token_files,
)
from stockflow.llm.common import id_crc, shared_path, table
from stockflow.llm.tokens import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs, n_shards=8)


@query
def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (id_crc() % 5 != 1).alias("learn"))
    pieces = lattice_lm.subword_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    return lattice_lm.score_documents(docs, "learn", pieces)


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = shared_path(spark, "tokens")
    token_files.write_token_files(docs, path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(spark, path)


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), window=10, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat_format.message_records(table(spark, sf_dir, "conversations"))
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7,)], "conv_id long").select(
        "conv_id", F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("completion"))).alias("record")
    )
    formatted = chat_format.format_records(records.unionByName(own), keep=["conv_id"])
    return chat_format.read_back(formatted, keep=["conv_id"])


@query
def op6_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = suffix_dedup.remove_repeats(docs, length=400, keep=["doc_id"], passage_words=51)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shared_words")


@query
def op8_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = ppm_langid.fit(ppm_langid.training_rows(docs))
    held_out = (id_crc() % 5 == 0).alias("held_out")
    found = ppm_langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out, "lang_pred", "score")


@query
def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = circulant_minhash.near_duplicates(docs, width=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, length=2048)


@query
def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixture.mixture(docs, weights=(5, 2, 1), share=(3, 2), limit=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return merkle_log.manifest(docs, tampered=F.col("doc_id").isNotNull() & (id_crc() % 7 == 0))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return collocations.collocations(docs, threshold=10, longest=3, inside_percent=50, top=2000)
