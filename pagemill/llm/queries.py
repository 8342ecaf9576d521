"""The registered queries of the training-data operators, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, decontaminate, mil, oracles, outliers, pseudonym, simhash, substring_index, suffix, warc, wordpiece
from pagemill.runtime import table


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_file())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, limit=4)
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decontaminate.flagged(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive(table(spark, sf_dir, "pages"))
    columns = "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"
    # predicates go into the reader: payloads of responses are checked against their digests, revisits are headers only
    responses = warc.read(spark, folder, columns, verify="true").where("record_type = 'response'")
    found = responses.union(warc.read(spark, folder, columns).where("record_type = 'revisit'"))
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_index.remove_repeats(table(spark, sf_dir, "documents"), batches=3, fanout=1)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outliers.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonym.pseudonymise(table(spark, sf_dir, "documents"), pseudonym.session_key(spark)).select("row.doc_id", "n_replaced", "text")


def op9_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mil.train(docs, table(spark, sf_dir, "labels"))
    scored = mil.score(docs, model).select("row.doc_id", "score")
    return scored.select("doc_id", mil.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_simhash, op3_templates, op4_warc, op5_substring, op6_outliers, op7_wordpiece, op8_pseudonyms, op9_mil, op10_suffix)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
