"""Cutting pages into overlapping chunks, and lines into packed chunks.

Both are folds along one page: each start depends on the last cut.  They run per
page in Arrow batches; pages are rows, so any number of tasks can share a
document.  Positions within a document come from per-page counts afterwards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.config import DEFAULT, Settings
from pagemill.functions import text as T
from pagemill.runtime import ship_package

#: A chunk prefers to end behind the first character of one of these.
CUTS = (". ", "? ", "! ", "; ", ": ", "\n")


def cut_text(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of a text in normal form."""
    least, out, start = max(120, int(size * 0.45)), [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            cut = max(text.rfind(mark, start, end) for mark in CUTS)
            if cut - start >= least:
                end = cut + 1
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return out


def pack_lines(costs: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges [s, e) of lines per chunk, from line costs (length + 1).

    With P the running sum of costs: a chunk from s goes as far as size
    allows, but takes at least the first line not used yet; the next one
    repeats the trailing lines that fit into overlap (at least one line,
    none if there is no overlap), unless that leaves no room for its first new line.
    """
    P, out, s, used = [0, *accumulate(costs)], [], 0, 0
    while used < len(costs):
        e = max(used + 1, bisect_right(P, P[s] + size) - 1)
        out.append((s, e))
        used = s = e
        if e < len(costs) and overlap > 0:
            tail = max(out[-1][0], min(e - 1, bisect_left(P, P[e] - overlap)))
            if P[e + 1] - P[tail] <= size:
                s = tail
    return out


def chunk_texts(df: DataFrame, keys: list[str], text: str, settings: Settings = DEFAULT) -> DataFrame:
    """(keys, position, text): chunks of each row's text, positions from 0."""
    ship_package(df.sparkSession)
    size, overlap = settings.size, settings.overlap
    ready = df.select(*keys, T.normalize(F.col(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                chunks = [cut_text(x, size, overlap) for x in part.column(len(keys)).to_pylist()]
                rows = pa.array([i for i, c in enumerate(chunks) for _ in c], pa.int32())
                position = pa.array([p for c in chunks for p in range(len(c))], pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(rows) for i in range(len(keys))), position, pa.array([x for c in chunks for x in c], pa.string())], [*keys, "position", "text"])

    kinds = ", ".join(f"`{k}` {ready.schema[k].dataType.simpleString()}" for k in keys)
    return ready.mapInArrow(run, f"{kinds}, position int, text string")


def chunk_lines(df: DataFrame, keys: list[str], lines: str, settings: Settings = DEFAULT) -> DataFrame:
    """(keys, position, text, ocr_confidence): packed lines; the confidence is the worst line's."""
    ship_package(df.sparkSession)
    size, overlap = settings.size, settings.overlap
    stripped = F.transform(F.coalesce(F.col(lines), F.array()), lambda x: F.struct(T.strip(F.coalesce(x["text"], F.lit(""))).alias("text"), x["confidence"].cast("double").alias("confidence")))
    ready = df.select(*keys, F.filter(stripped, lambda x: F.length(x["text"]) > 0).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, position, texts, worst = [], [], [], []
                for i, found in enumerate(part.column(len(keys)).to_pylist()):
                    for p, (s, e) in enumerate(pack_lines([len(x["text"]) + 1 for x in found], size, overlap)):
                        rows.append(i)
                        position.append(p)
                        texts.append("\n".join(x["text"] for x in found[s:e]))
                        worst.append(min(x["confidence"] for x in found[s:e]))
                taken = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(taken) for i in range(len(keys))), pa.array(position, pa.int32()), pa.array(texts, pa.string()), pa.array(worst, pa.float64())], [*keys, "position", "text", "ocr_confidence"])

    kinds = ", ".join(f"`{k}` {ready.schema[k].dataType.simpleString()}" for k in keys)
    return ready.mapInArrow(run, f"{kinds}, position int, text string, ocr_confidence double")


def repositioned(chunks: DataFrame) -> DataFrame:
    """Chunks whose position runs over the document, with positions from 0 in each page, as chunk_records takes them."""
    first = chunks.groupBy(F.col("document_name").alias("f_document"), F.col("page_number").alias("f_page")).agg(F.min("position").alias("f_position"))
    same = F.col("document_name").eqNullSafe(F.col("f_document")) & F.col("page_number").eqNullSafe(F.col("f_page"))
    return chunks.join(first, same).withColumn("position", (F.col("position") - F.col("f_position")).cast("int")).drop("f_document", "f_page", "f_position")


def chunk_records(chunks: DataFrame, generation: str = "0") -> DataFrame:
    """Chunk rows (schema CHUNKS) from (document_name, page_number, content_type, extraction_method, position, text, ocr_confidence).

    chunk_index runs over the document: the chunks of earlier pages plus the
    position in the page.  The window sorts one small row per page, not chunks.
    """
    per_page = chunks.groupBy("document_name", "page_number").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("document_name").orderBy(F.col("page_number").asc_nulls_first())
    before = per_page.withColumn("_before", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    same_page = F.col("c.page_number").eqNullSafe(F.col("b.page_number"))
    numbered = chunks.alias("c").join(before.alias("b"), F.col("c.document_name").eqNullSafe(F.col("b.document_name")) & same_page)
    index = (F.col("b._before") + F.col("c.position")).cast("int")
    key = T.document_key(F.col("c.document_name"))
    return numbered.select(
        F.sha2(F.concat_ws("/", key, F.lit(generation), index.cast("string")), 256).alias("id"),
        F.col("c.document_name").alias("filename"),
        F.col("c.document_name").alias("document_name"),
        key.alias("document_key"),
        index.alias("chunk_index"),
        F.concat_ws("-", F.coalesce("c.page_number", F.lit(0)).cast("string"), index.cast("string")).alias("chunk_id"),
        F.col("c.page_number").alias("page_number"),
        F.col("c.content_type").alias("content_type"),
        F.col("c.extraction_method").alias("extraction_method"),
        F.col("c.text").alias("text"),
        F.round("c.ocr_confidence", 4).alias("ocr_confidence"),
    )
