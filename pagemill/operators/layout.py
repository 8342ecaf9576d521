"""Page layout: repeated lines, usable text, routing, recognition budget, ink bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.config import DEFAULT, Settings
from pagemill.functions import text as T

#: Fixed values of line segmentation.
MIN_LINE_HEIGHT, MAX_LINE_HEIGHT, LINE_PAD, MERGE_GAP, INK_RATIO = 8, 400, 6, 4, 0.015


def page_lines(pages: DataFrame) -> DataFrame:
    """(document_name, page_number, line_no, line) of lines that aren't blank."""
    tall = pages.select("document_name", "page_number", F.posexplode(T.lines(F.col("raw_text"))).alias("line_no", "line"))
    return tall.where(~T.is_blank(F.col("line")))


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """(document_name, line, n_pages, is_url): stripped lines of two pages or more, and lone addresses."""
    seen = page_lines(pages).select("document_name", "page_number", T.strip(F.col("line")).alias("line")).distinct()
    counts = seen.groupBy("document_name", "line").agg(F.count("*").alias("n_pages"))
    return counts.withColumn("is_url", T.is_url_line(F.col("line"))).where("n_pages >= 2 OR is_url")


def usable_text(pages: DataFrame, boilerplate: DataFrame | None = None) -> DataFrame:
    """pages with usable_text: lines that aren't boilerplate, in order.

    Rows are told apart by document, page number and text, so that a null number
    keeps its text and different texts under one number keep their own.
    """
    noise = (boilerplate if boilerplate is not None else boilerplate_lines(pages)).select(F.col("document_name").alias("n_document"), F.col("line").alias("n_line"))
    keyed = pages.withColumn("_text", F.sha2(F.coalesce("raw_text", F.lit("")), 256))
    tall = keyed.select("document_name", "page_number", "_text", F.posexplode(T.lines(F.col("raw_text"))).alias("line_no", "line"))
    stripped = tall.where(~T.is_blank(F.col("line"))).withColumn("stripped", T.strip(F.col("line")))
    kept = stripped.join(noise, F.col("document_name").eqNullSafe(F.col("n_document")) & (F.col("stripped") == F.col("n_line")), "left_anti")
    ordered = F.array_sort(F.collect_set(F.struct("line_no", "line")))
    joined = kept.groupBy("document_name", "page_number", "_text").agg(T.strip(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("usable_text"))
    found = joined.select(F.col("document_name").alias("j_document"), F.col("page_number").alias("j_page"), F.col("_text").alias("j_text"), "usable_text")
    same = F.col("document_name").eqNullSafe(F.col("j_document")) & F.col("page_number").eqNullSafe(F.col("j_page")) & (F.col("_text") == F.col("j_text"))
    return keyed.join(found, same, "left").select(*[F.col(f"`{c}`") for c in pages.columns], F.coalesce("usable_text", F.lit("")).alias("usable_text"))


def route_pages(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """usable_text and route: digital, drop (only boilerplate, no image) or ocr."""
    least = settings.embedded_min_chars
    raw = F.length(T.strip(F.coalesce("raw_text", F.lit(""))))
    route = F.when(F.length("usable_text") >= least, "digital").when((raw >= least) & ~F.col("has_image"), "drop").otherwise("ocr")
    return usable_text(pages).withColumn("raw_chars", raw).withColumn("route", route)


def ocr_budget(routed: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Per document the pages of each route, and whether recognition would exceed its budget."""
    return routed.groupBy("document_name").agg(
        F.count("*").alias("n_pages"),
        F.count_if(F.col("route") == "digital").alias("digital_pages"),
        F.count_if(F.col("route") == "drop").alias("dropped_pages"),
        F.count_if(F.col("route") == "ocr").alias("ocr_pages"),
    ).withColumn("over_budget", F.col("ocr_pages") > settings.max_ocr_pages)


def budgeted(routed: DataFrame, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digital pages, pages to recognise, rejects of documents over the budget) of routed pages; the first two leave such documents out."""
    over = ocr_budget(routed, settings).where("over_budget").select("document_name")
    within = routed.join(over, "document_name", "left_anti")
    error = F.lit(f"more than {settings.max_ocr_pages} pages need recognition")
    return within.where("route = 'digital'"), within.where("route = 'ocr'").select("document_name", "page_number"), over.select(F.lit(None).cast("string").alias("path"), "document_name", error.alias("error"))


def unrecognised(scans: DataFrame) -> DataFrame:
    """Rejects of pages that need recognition and had none."""
    page = F.coalesce(F.col("page_number").cast("string"), F.lit("without number"))
    return scans.select(F.lit(None).cast("string").alias("path"), "document_name", F.format_string("page %s needs recognition", page).alias("error"))


def islands(flags: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """(by, start, end) half-open ranges of consecutive true flags."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.when(F.coalesce(F.lag(flag).over(w), F.lit(False)) != F.col(flag), 1).otherwise(0)
    numbered = flags.withColumn("_c", change).withColumn("_g", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where(F.col(flag)).groupBy(*by, "_g").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end")).drop("_g")


def merge_bands(bands: DataFrame, by: list[str], gap: int = MERGE_GAP) -> DataFrame:
    """Ordered disjoint ranges, joined over gaps of at most `gap`."""
    w = Window.partitionBy(*by).orderBy("start")
    new = F.when(F.col("start") - F.lag("end").over(w) <= gap, 0).otherwise(1)
    numbered = bands.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def line_bands(ink: DataFrame, by: str = "image_id") -> DataFrame:
    """(image, start, end) of text lines from ink rows (image, row, width, ink)."""
    least = F.greatest(F.lit(1), (F.col("width") * F.lit(INK_RATIO)).cast("int"))
    runs = islands(ink.withColumn("inked", F.col("ink") >= least), [by], "row", "inked")
    height = F.col("end") - F.col("start")
    return merge_bands(runs, [by]).where(height.between(MIN_LINE_HEIGHT, MAX_LINE_HEIGHT))


def ink_columns(bands: DataFrame, pixels: DataFrame, widths: DataFrame, by: str = "image_id") -> DataFrame:
    """Bands with left and right: first and last ink column, padded; the whole width without ink."""
    inside = bands.join(pixels, by).where("row >= start AND row < end")
    reach = inside.groupBy(by, "start", "end").agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    joined = bands.join(reach, [by, "start", "end"], "left").join(widths, by)
    left = F.coalesce(F.greatest(F.lit(0), F.col("lo") - LINE_PAD), F.lit(0))
    right = F.coalesce(F.least(F.col("width"), F.col("hi") + 1 + LINE_PAD), F.col("width"))
    return joined.select(by, "start", "end", left.cast("long").alias("left"), right.cast("long").alias("right"))


def page_payload(printed: Column, printed_confidence: Column, lines: Column) -> Column:
    """The page's text, type, method and confidence: print where accepted, else recognised lines."""
    from pagemill.functions.confidence import line_confidence

    recognised = F.array_join(F.transform(F.filter(lines, lambda x: ~T.is_blank(x["text"])), lambda x: x["text"]), "\n")
    return F.when(
        printed.isNotNull(),
        F.struct(printed.alias("text"), F.lit("digital_text").alias("content_type"), F.lit("pytesseract").alias("method"), printed_confidence.alias("confidence")),
    ).otherwise(F.struct(recognised.alias("text"), F.lit("handwritten_ocr").alias("content_type"), F.lit("trocr").alias("method"), F.round(line_confidence(lines), 4).alias("confidence")))
