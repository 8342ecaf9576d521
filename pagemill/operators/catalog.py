"""Documents as seen from their chunks: lists, rollups, generations, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.schemas import DIGITAL, HANDWRITTEN, MIXED


def list_documents(chunks: DataFrame) -> DataFrame:
    """Per exact name: chunks, greatest page number, the first chunk's type and method; by name."""
    name = T.strip(F.coalesce(F.when(~T.is_blank(F.col("document_name")), F.col("document_name")), F.col("filename"), F.lit("")))
    first = lambda c: F.min_by(c, "chunk_index").alias(c)
    grouped = chunks.groupBy(name.alias("document_name")).agg(F.count("*").alias("chunk_count"), F.coalesce(F.max("page_number"), F.lit(0)).alias("page_count"), first("content_type"), first("extraction_method"))
    return grouped.where(F.length("document_name") > 0).orderBy(F.lower("document_name"))


def content_rollup(types: Column) -> Column:
    """One type if all agree, else mixed."""
    seen = F.collect_set(types)
    return F.when(F.size(seen) == 1, F.when(F.get(seen, F.lit(0)) == HANDWRITTEN, HANDWRITTEN).when(F.get(seen, F.lit(0)) == DIGITAL, DIGITAL).otherwise(MIXED)).otherwise(MIXED)


def upload_summary(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: pages kept, pages recognised, chunks, methods joined by +, type rollup, status."""
    per_pages = pages.groupBy("document_name").agg(
        F.count("*").alias("page_count"),
        F.count_if(F.col("extraction_method").isin("trocr", "pytesseract")).alias("ocr_pages"),
        F.array_join(F.sort_array(F.collect_set("extraction_method")), "+").alias("methods"),
        content_rollup(F.col("content_type")).alias("content_type"),
    )
    counts = chunks.groupBy("document_name").agg(F.count("*").alias("chunk_count"))
    joined = per_pages.join(counts, "document_name", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    return joined.withColumn("status", F.when(F.col("chunk_count") > 0, "INDEXED").otherwise("FAILED"))


def matches_document(filename: Column, document_name: Column, wanted: Column) -> Column:
    """Equality with either name, case and outer white space aside; a blank name matches nothing."""
    key = T.document_key(wanted)
    return (F.length(key) > 0) & ((T.document_key(filename) == key) | (T.document_key(document_name) == key))


def latest(chunks: DataFrame) -> DataFrame:
    """Chunks of each document's newest generation."""
    newest = chunks.groupBy("document_key").agg(F.max("generation").alias("generation"))
    return chunks.join(newest, ["document_key", "generation"], "left_semi")


def without_documents(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Chunks of documents that names (document_name) doesn't list; unknown names do nothing."""
    gone = names.select(T.document_key(F.col("document_name")).alias("document_key")).where("length(document_key) > 0").distinct()
    return chunks.join(gone, "document_key", "left_anti")


def document_chunks(chunks: DataFrame, name: str | None = None) -> DataFrame:
    """All chunks without a name, else those of the document, in order."""
    if not name:
        return chunks
    return chunks.where(matches_document(F.col("filename"), F.col("document_name"), F.lit(name))).orderBy("chunk_index")


def health(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("document_key").alias("documents"), F.count("*").alias("chunks"))


def first_rows(df: DataFrame, by: str, order: str, count: int) -> DataFrame:
    """At most count rows of each group, in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_r") <= count).drop("_r")
