"""Files to pages: routing by suffix, size limits, and readers for each kind.

Whatever can't be read becomes a row of rejects, never an empty document.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.config import DEFAULT, Settings
from pagemill.functions import text as T
from pagemill.runtime import ship_package

#: Which reader takes which suffix.
READERS = {"pdf": [".pdf"], "docx": [".docx"], "plaintext": [".txt", ".md"], "image": [".png", ".jpg", ".jpeg"]}
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
EXTRACTED = "path string, document_name string, page_number int, raw_text string, has_image boolean, error string"


def reader_of(path: Column) -> Column:
    suffix = T.extension(path)
    out = None
    for reader, suffixes in READERS.items():
        out = (out.when if out is not None else F.when)(suffix.isin(suffixes), reader)
    return out


def upload_error(path: Column, length: Column, limit: int) -> Column:
    """Why a file isn't taken, null if it is."""
    return (
        F.when(F.length(T.strip(T.base_name(path))) == 0, "empty name")
        .when(reader_of(path).isNull(), F.concat(F.lit("Unsupported file type: "), T.extension(path)))
        .when(length > limit, F.concat(F.lit("larger than "), F.lit(str(limit)), F.lit(" bytes")))
    )


def scan(spark: SparkSession, path: str, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(files with content, rejects) below a path; oversized content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    limit = settings.max_upload_bytes
    why = upload_error(F.col("path"), F.col("length"), limit)
    rejects = files.select("path", T.base_name(F.col("path")).alias("document_name"), why.alias("error")).where("error IS NOT NULL")
    # the plain test on length reaches the scan, so that large files aren't opened
    taken = files.where(F.col("length") <= limit).where(reader_of(F.col("path")).isNotNull())
    return taken.select("path", T.base_name(F.col("path")).alias("document_name"), reader_of(F.col("path")).alias("reader"), "content"), rejects


def docx_text(content: bytes) -> str:
    """Body paragraphs, then every table's rows with their cells joined by blanks."""
    with zipfile.ZipFile(io.BytesIO(content)) as f:
        body = ElementTree.fromstring(f.read("word/document.xml")).find(f"{WORD}body")
    if body is None:
        return ""

    def spoken(node) -> str:
        marks = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
        return "".join(x.text or "" if x.tag == f"{WORD}t" else marks.get(x.tag, "") for x in node.iter())

    parts = [spoken(p) for p in body.findall(f"{WORD}p")]
    for row in (r for table in body.findall(f"{WORD}tbl") for r in table.findall(f"{WORD}tr")):
        cells = ["\n".join(spoken(p) for p in c.findall(f"{WORD}p")).strip() for c in row.findall(f"{WORD}tc")]
        parts.append(" ".join(x for x in cells if x))
    return "\n".join(x for x in parts if x.strip())


def _texts(read):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    text, error = read(content), None
                except Exception as e:  # a broken file is a row of rejects
                    text, error = None, f"Could not open this document: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([None], pa.int32()), pa.array([text], pa.string()), pa.array([False]), pa.array([error], pa.string())], ["path", "document_name", "page_number", "raw_text", "has_image", "error"])

    return run


def extract(files: DataFrame, pdf_pages=None) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects) of files (path, document_name, reader, content).

    Plain text drops bytes that aren't UTF-8. pdf_pages(content) gives
    (page_number, text, has_image) per page, and may give the page's image, an
    array (height, width, channels) of bytes, as a fourth; without it PDFs are rejected.
    Images are left to the recogniser: one page each, no text.
    """
    ship_package(files.sparkSession)
    cols = files.select("path", "document_name", "content", "reader")
    only = lambda r: cols.where(F.col("reader") == r).select("path", "document_name", "content")
    plain = only("plaintext").mapInArrow(_texts(lambda b: b.decode("utf-8", "ignore")), EXTRACTED)
    docx = only("docx").mapInArrow(_texts(docx_text), EXTRACTED)

    def pdf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if pdf_pages is None:
                        raise ValueError("no PDF reader is plugged in")
                    rows = [(*r[:3], None) for r in pdf_pages(content)]
                except Exception as e:
                    rows = [(None, None, False, f"Could not open this PDF: {e}")]
                number, text, image, error = zip(*rows) if rows else ((), (), (), ())
                k = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([path] * k, pa.string()), pa.array([name] * k, pa.string()), pa.array(number, pa.int32()), pa.array(text, pa.string()), pa.array(image, pa.bool_()), pa.array(error, pa.string())], ["path", "document_name", "page_number", "raw_text", "has_image", "error"])

    pdfs = only("pdf").mapInArrow(pdf, EXTRACTED)
    images = cols.where("reader = 'image'").select("path", "document_name", F.lit(1).alias("page_number"), F.lit("").alias("raw_text"), F.lit(True).alias("has_image"), F.lit(None).cast("string").alias("error"))
    every = plain.unionByName(docx).unionByName(pdfs).unionByName(images)
    return every.where("error IS NULL").drop("error"), every.where("error IS NOT NULL").select("path", "document_name", "error")


def page_images(files: DataFrame, wanted: DataFrame, pdf_pages) -> DataFrame:
    """(image) of the wanted (document_name, page_number) that pdf_pages gives an image of, as Spark's image source has it; origin is name, \\x1f, page."""
    ship_package(files.sparkSession)
    numbers = wanted.groupBy("document_name").agg(F.collect_set("page_number").alias("numbers"))
    chosen = files.where(F.col("reader") == "pdf").select("document_name", "content").join(numbers, "document_name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, pages in zip(*(c.to_pylist() for c in batch.columns)):
                for row in pdf_pages(content):
                    if row[0] in pages and len(row) > 3 and row[3] is not None:
                        height, width, channels = row[3].shape
                        columns = [pa.array([f"{name}\x1f{row[0]}"]), *[pa.array([n], pa.int32()) for n in (height, width, channels)], pa.array([row[3].tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["origin", "height", "width", "nChannels", "data"])

    found = chosen.mapInArrow(run, "origin string, height int, width int, nChannels int, data binary")
    return found.select(F.struct("origin", "height", "width", "nChannels", "data").alias("image"))
