"""Continuous ingest: new pages of a folder become new generations of their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill import providers
from pagemill.config import DEFAULT, Settings
from pagemill.functions import text as T
from pagemill.operators import chunking, layout
from pagemill.runtime import written
from pagemill.schemas import PAGES
from pagemill.sources.store import ChunkStore


def stream_pages(spark: SparkSession, folder: str, store: ChunkStore, checkpoint: str, settings: Settings = DEFAULT, embedder: providers.Provider | None = None) -> StreamingQuery:
    """Parquet pages (schema PAGES), routed as in an upload, over the batches of a document.

    A page replaces the one of its number; other pages of its document stay,
    streamed or uploaded.  As lines repeat over pages, all streamed pages of a
    batch's documents are routed anew.  Pages that need recognition, and
    documents over its budget, become rejects.  Pages without a name are rejects too.
    A batch that is run again after a failure gives a newer generation of the
    same chunks: readers see the same result, rejects may stand twice.
    """
    pages = spark.readStream.schema(PAGES).parquet(folder)

    def replace(batch: DataFrame, number: int) -> None:
        generation = store.next_generation()
        fresh = written(batch.withColumns({"document_key": T.document_key(F.col("document_name")), "generation": F.lit(generation).cast("long"), "has_image": F.coalesce("has_image", F.lit(False))}), "batch")
        named = F.coalesce(F.length("document_key"), F.lit(0)) > 0
        store.keep_pages(fresh.where(named))
        touched = fresh.where(named).select("document_key").distinct()
        known = written(store.pages().join(touched, "document_key", "left_semi"), "pages")
        # one spelling of a name for all pages of a document: that of its newest page
        spelt = known.groupBy("document_key").agg(F.max_by("document_name", F.struct("generation", "document_name")).alias("document_name"))
        whole = known.drop("document_name", "generation").join(spelt, "document_key")
        routed = written(layout.route_pages(whole, settings), "routed")
        read, scans, over = layout.budgeted(routed, settings)
        cut = chunking.chunk_texts(read, ["document_name", "page_number"], "usable_text", settings)
        typed = cut.select("document_name", "page_number", F.lit("digital_text").alias("content_type"), F.lit("pymupdf").alias("extraction_method"), "position", "text", F.lit(None).cast("double").alias("ocr_confidence"))
        # uploaded pages that the stream doesn't know stay as they are, under the newest spelling
        held = known.select(F.col("document_key").alias("k_key"), F.col("page_number").alias("k_page"))
        live = store.chunks().drop("document_name").join(spelt, "document_key")
        kept = live.join(held, (F.col("document_key") == F.col("k_key")) & F.col("page_number").eqNullSafe(F.col("k_page")), "left_anti")
        kept = kept.select("document_name", "page_number", "content_type", "extraction_method", F.col("chunk_index").alias("position"), "text", "ocr_confidence")
        every = typed.unionByName(chunking.repositioned(kept)).join(over.select("document_name"), "document_name", "left_anti")
        records = written(chunking.chunk_records(every, str(generation)), "chunks")
        # a document whose pages are all gone by rule must not show its old ones
        empty = spelt.join(over.select("document_name"), "document_name", "left_anti").join(records.select("document_name"), "document_name", "left_anti").select("document_name", "document_key")
        store.replace(records, empty, generation)
        if embedder is not None:
            store.index(records, embedder)
        nameless = fresh.where(~named).select(F.lit(None).cast("string").alias("path"), "document_name", F.lit("page without a document name").alias("error"))
        store.reject(layout.unrecognised(scans).unionByName(over).unionByName(nameless))

    return pages.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
