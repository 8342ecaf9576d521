"""The test tables read as the engine's inputs: pages, chunks, lines, drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import chunking
from pagemill.runtime import spread, table, written


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages: the source is the document, the id the page number."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("source").alias("document_name"),
        F.col("doc_id").cast("int").alias("page_number"),
        F.coalesce("text", F.lit("")).alias("raw_text"),
        (F.col("doc_id") % 7 == 0).alias("has_image"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table of all pages, written once, as an ingest would."""
    cut = chunking.chunk_texts(pages(spark, sf_dir), ["document_name", "page_number"], "raw_text")
    typed = cut.select("document_name", "page_number", F.lit("digital_text").alias("content_type"), F.lit("pymupdf").alias("extraction_method"), "position", "text", F.lit(None).cast("double").alias("ocr_confidence"))
    return written(chunking.chunk_records(typed), "chunks")


def confidence(doc: Column, line: Column) -> Column:
    return ((doc * 31 + line * 17) % 100).cast("double") / 100.0


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as recognised lines with made-up confidences."""
    split = spread(table(spark, sf_dir, "documents")).select("doc_id", "source", T.lines(F.col("text")).alias("l"))
    made = F.transform("l", lambda x, i: F.struct(x.alias("text"), confidence(F.col("doc_id"), i).alias("confidence")))
    return split.select("doc_id", "source", made.alias("lines"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_lines(recognised(spark, sf_dir), ["doc_id"], "lines")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text is asked of one document."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("document_key"), F.col("text").alias("question"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, reply): assistant turns with the turn before them."""
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reply")).join(asked, ["conv_id", "turn"])


def labelled(text: Column, count: int) -> Column:
    """Pieces between full stops, each with a label that goes round."""
    return F.array_join(F.transform(F.split(text, r"\. "), lambda x, i: F.concat(x, F.lit(" [S"), (i % count + 1).cast("string"), F.lit("]"))), " ")


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, first and second drafts of every kind that the answer stage tells apart."""
    from pagemill.operators.answering import NOT_FOUND

    def source(text: Column, page: Column, kind: Column, conf: Column) -> Column:
        return F.struct(text.alias("text"), F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("filename"), page.cast("int").alias("page_number"), kind.alias("content_type"), conf.alias("ocr_confidence"))

    k = F.col("conv_id") + F.col("turn")
    null = F.lit(None).cast("double")
    three = F.array(
        source(F.col("reply"), F.col("turn"), F.lit("digital_text"), null),
        source(F.col("question"), F.lit(0), F.lit("handwritten_ocr"), F.when(k % 3 > 0, (k % 10).cast("double") / 10.0)),
        source(F.lit("  "), F.lit(None), F.lit("digital_text"), F.lit(0.9)),
    )
    sources = F.when(k % 11 == 0, F.slice(three, 3, 1)).when(k % 11 == 1, F.slice(three, 2, 1)).when(k % 11 == 2, F.slice(three, 1, 1)).otherwise(three)
    reply = F.col("reply")
    draft = (
        F.when(k % 12 == 0, F.lit(NOT_FOUND))
        .when(k % 12 == 1, F.concat(F.lit("[S1 | conv, page 1 | digital_text] "), labelled(reply, 1)))
        .when(k % 12 == 2, reply)
        .when(k % 12 == 3, labelled(reply, 9))
        .when(k % 12 == 4, F.concat(F.lit(NOT_FOUND), F.lit(" "), labelled(reply, 1)))
        .when(k % 12 == 5, F.concat(F.lit("made up | [S1] nowhere stated [S1] "), labelled(reply, 1)))
        .when(k % 12 == 6, F.lit("[S1] [S2]"))
        .when(k % 12 == 7, F.lit("[S1 | conv | digital_text]"))
        .when(k % 12 == 8, F.lit("never stated [S1]"))
        .otherwise(labelled(reply, 1))
    )
    retry = F.when(k % 5 == 0, F.lit(NOT_FOUND)).when(k % 5 == 1, labelled(reply, 1)).when(k % 5 == 2, F.lit("")).otherwise(labelled(reply, 4))
    return turns(spark, sf_dir).select("conv_id", "turn", "question", sources.alias("sources"), draft.alias("draft"), retry.alias("retry"))
