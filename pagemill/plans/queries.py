"""The registered queries of the engine's operators, over whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import confidence as C
from pagemill.functions import text as T
from pagemill.operators import answering as A
from pagemill.operators import catalog, evaluation, layout, ranking
from pagemill.plans import tables as D
from pagemill.runtime import ship_package, spread, table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# text


@query
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normal"))


@query
def tokenize(spark, sf_dir):
    words = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.array_join(words, " ").alias("tokens"))


@query
def clean_lines(spark, sf_dir):
    tall = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    marked = F.concat(F.repeat(F.lit("# "), (F.col("line_no") % 4).cast("int")), F.repeat(F.lit("#"), (F.col("doc_id") % 3).cast("int")), "line")
    return tall.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.clean_line(marked).alias("cleaned"))


@query
def printed_usable(spark, sf_dir):
    letters, marks = T.letters_and_marks(F.col("text"))
    usable = T.printed_is_usable(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", letters.cast("long").alias("letters"), marks.cast("long").alias("marks"), usable.alias("usable"))


@query
def url_lines(spark, sf_dir):
    forms = {"plain": F.col("url"), "closed": F.concat("url", F.lit(").")), "spoken": F.concat(F.lit("see "), "url"), "bare": F.regexp_replace("url", "^https?://", "WWW.")}
    return table(spark, sf_dir, "pages").select("page_id", *[T.is_url_line(c).alias(k) for k, c in forms.items()])


@query
def route_files(spark, sf_dir):
    name = F.concat(F.lit("Dir.x/f"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, [".PDF", ".txt", ".md", ".docx", ".png", ".JPG", ".jpeg", ".exe", "", ".tar.gz"])), (F.col("page_id") % 10 + 1).cast("int")))
    from pagemill.sources.ingest import reader_of

    rows = table(spark, sf_dir, "pages").select("page_id", name.alias("path"))
    return rows.select("page_id", T.base_name(F.col("path")).alias("document_name"), T.extension(F.col("path")).alias("extension"), reader_of(F.col("path")).alias("reader"))


# layout


@query
def boilerplate_lines(spark, sf_dir):
    return layout.boilerplate_lines(D.pages(spark, sf_dir))


@query
def usable_pages(spark, sf_dir):
    return layout.usable_text(D.pages(spark, sf_dir)).select("document_name", "page_number", "usable_text")


@query
def route_pages(spark, sf_dir):
    return layout.route_pages(D.pages(spark, sf_dir)).select("document_name", "page_number", F.col("raw_chars").cast("long").alias("raw_chars"), F.length("usable_text").cast("long").alias("usable_chars"), "route")


@query
def ocr_budget(spark, sf_dir):
    return layout.ocr_budget(layout.route_pages(D.pages(spark, sf_dir)))


def ink_rows(spark, sf_dir):
    """A made-up page of 120 rows for each benchmark item."""
    item = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("image_id"))
    rows = item.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(119))).alias("row"))
    inked = ((F.col("row") + F.col("image_id") * 3) % (F.col("image_id") % 7 + 17) < (F.col("image_id") % 5 + 9)) & (F.col("row") % 29 != 0)
    return rows.select("image_id", F.col("row").cast("long").alias("row"), F.lit(200).cast("long").alias("width"), F.when(inked, F.lit(40)).otherwise(F.lit(2)).cast("long").alias("ink"))


@query
def line_bands(spark, sf_dir):
    return layout.line_bands(ink_rows(spark, sf_dir))


@query
def ink_columns(spark, sf_dir):
    ink = ink_rows(spark, sf_dir)
    bands = layout.line_bands(ink)
    pixels = ink.where("ink > 10 AND image_id % 4 > 0").select("image_id", "row", F.explode(F.array(10 + F.col("row") % 13, 150 + F.col("image_id") % 60)).alias("col")).where("col < 200")
    return layout.ink_columns(bands, pixels, ink.select("image_id", "width").distinct())


# chunks


@query
def chunk_pages(spark, sf_dir):
    return D.chunks(spark, sf_dir).select("document_name", "page_number", "chunk_index", "chunk_id", "id", "text")


@query
def pack_lines(spark, sf_dir):
    return D.packed(spark, sf_dir)


@query
def page_confidence(spark, sf_dir):
    return D.recognised(spark, sf_dir).select("doc_id", F.round(C.line_confidence(F.col("lines")), 6).alias("confidence"))


@query
def word_confidence(spark, sf_dir):
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("text"), (((F.col("doc_id") * 13 + i * 7) % 102) - 1).cast("double").alias("conf")))
    return table(spark, sf_dir, "documents").select("doc_id", C.word_confidence(words).alias("confidence"))


@query
def sequence_confidence(spark, sf_dir):
    n = (F.col("doc_id") % 9).cast("int")
    steps = F.transform(F.sequence(F.lit(0), n), lambda s: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda v: ((F.col("doc_id") * 7 + s * 3 + v * 5) % 11).cast("double") / 2.0))
    sequence = F.transform(F.sequence(F.lit(0), n + 1), lambda s: ((F.col("doc_id") + s * s) % 5).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(C.sequence_confidence(steps, sequence, F.array(F.lit(0), F.lit(1))), 6).alias("confidence"))


@query
def accepted_print(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    conf = F.when(F.col("doc_id") % 5 > 0, (F.col("doc_id") % 100).cast("double") / 100.0)
    payload = layout.page_payload(F.when(C.accepted_print(F.lit(True), T.printed_is_usable(F.col("text")), conf), T.normalize(F.col("text"))), conf, F.array(F.struct(F.lit("line").alias("text"), F.lit(0.5).alias("confidence"))))
    return docs.select("doc_id", payload.alias("p")).select("doc_id", F.length("p.text").cast("long").alias("n_chars"), "p.content_type", "p.method", "p.confidence")


# retrieval


@query
def bm25_topk(spark, sf_dir):
    return ranking.bm25_ranking(D.questions(spark, sf_dir), D.chunks(spark, sf_dir)).select("query_id", "rank", "chunk_index", "score")


@query
def dense_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("document_key"), F.col("vec_id").alias("chunk_index"), "embedding")
    asked = vectors.where("chunk_index % 50 = 0").select(F.col("chunk_index").alias("query_id"), "document_key", F.col("embedding").alias("vector"))
    return ranking.dense_ranking(asked, vectors, F.lit(24)).select("query_id", "rank", "chunk_index", "score")


@query
def rrf_fuse(spark, sf_dir):
    chunks, asked = D.chunks(spark, sf_dir), D.questions(spark, sf_dir)
    totals = chunks.groupBy("document_key").agg(F.count("*").alias("n_chunks"))
    posted = ranking.indexed(asked, chunks)
    dense = ranking.ranked(ranking.bag_scores(asked, chunks, posted[0]).join(totals, "document_key"), ranking.candidate_pool(F.col("n_chunks")))
    return ranking.fuse(dense, ranking.bm25_ranking(asked, chunks, posted=posted)).select("query_id", "chunk_index", "rrf_score", "fused_rank")


@query
def hybrid_retrieve(spark, sf_dir):
    found = ranking.retrieve(D.questions(spark, sf_dir), D.chunks(spark, sf_dir))
    return found.select("query_id", "final_rank", "chunk_index", "rerank_score", "rrf_score", "id", F.substring("text", 1, 400).alias("text"))


@query
def overview_sample(spark, sf_dir):
    return ranking.overview(D.chunks(spark, sf_dir)).select("document_name", "chunk_index", "page_number", "text")


# documents


def _typed(spark, sf_dir):
    typed = F.when(F.col("page_number") % 3 == 0, "handwritten_ocr").otherwise("digital_text")
    method = F.when(F.col("page_number") % 3 == 0, "trocr").when(F.col("page_number") % 3 == 1, "pytesseract").otherwise("pymupdf")
    return lambda df: df.withColumns({"content_type": typed, "extraction_method": method})


@query
def document_catalog(spark, sf_dir):
    return catalog.list_documents(_typed(spark, sf_dir)(D.chunks(spark, sf_dir)))


@query
def upload_summary(spark, sf_dir):
    typed = _typed(spark, sf_dir)
    return catalog.upload_summary(typed(D.pages(spark, sf_dir)), D.chunks(spark, sf_dir))


@query
def document_scope(spark, sf_dir):
    """Chunks of the documents asked for by name, in any case."""
    names = D.questions(spark, sf_dir).select(F.concat(F.lit("  "), F.upper("document_key"), F.lit(" ")).alias("n"), (F.col("query_id") % 3).alias("r")).where("r = 0").select(T.document_key(F.col("n")).alias("document_key")).distinct()
    return D.chunks(spark, sf_dir).join(names, "document_key", "left_semi").groupBy("document_key").agg(F.count("*").alias("n"), F.max("chunk_index").alias("last"))


def _generations(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(T.document_key(F.col("source")).alias("document_key"), "doc_id", (F.col("doc_id") % 3 + F.length("source") % 2).alias("generation"), "n_chars")


@query
def latest_generation(spark, sf_dir):
    return catalog.latest(_generations(spark, sf_dir)).select("document_key", "generation", "doc_id")


@query
def delete_document(spark, sf_dir):
    names = spark.createDataFrame([(" SRC3 ",), ("src7",), ("unknown",), ("  ",)], "document_name string")
    return catalog.without_documents(_generations(spark, sf_dir), names).select("document_key", "doc_id")


@query
def store_health(spark, sf_dir):
    return catalog.health(D.chunks(spark, sf_dir))


@query
def upload_limits(spark, sf_dir):
    """What an upload is refused for, sizes in bytes against a limit of 3,000."""
    from pagemill.sources.ingest import upload_error

    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.element_at(F.array(F.lit(".txt"), F.lit(".zip"), F.lit(".MD")), (F.col("doc_id") % 3 + 1).cast("int"))).alias("path"), F.octet_length("text").cast("long").alias("length"))
    return rows.select("doc_id", upload_error(F.col("path"), F.col("length"), 3000).alias("error"))


# answers


@query
def classify_question(spark, sf_dir):
    phrases = F.array(*map(F.lit, A.DOCUMENT_REQUESTS))
    c = table(spark, sf_dir, "conversations")
    asked = F.when(F.col("conv_id") % 3 == 0, F.concat(F.upper(F.element_at(phrases, (F.col("conv_id") % 13 + 1).cast("int"))), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", A.is_document_request(asked).alias("whole_document"))


@query
def trust_gate(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 4 == 0, F.lit("handwritten_ocr")).when(F.col("doc_id") % 4 < 3, F.lit("digital_text"))
    conf = F.when(F.col("doc_id") % 5 > 0, F.col("ocr_confidence"))
    rows = D.packed(spark, sf_dir).select("doc_id", "position", F.struct(F.when(F.col("doc_id") % 50 == 7, F.lit(" \n")).otherwise(F.col("text")).alias("text"), kind.alias("content_type"), conf.alias("ocr_confidence")).alias("s"))
    return rows.select("doc_id", "position", A.is_trusted(F.col("s")).alias("trusted"))


@query
def build_context(spark, sf_dir):
    return D.drafts(spark, sf_dir).select("conv_id", "turn", A.build_context(F.col("sources")).alias("context"), A.label_range(F.size("sources")).alias("labels"))


@query
def split_claims(spark, sf_dir):
    return D.drafts(spark, sf_dir).select("conv_id", "turn", F.posexplode(A.split_claims(F.col("draft"))).alias("pos", "claim")).withColumn("pos", F.col("pos").cast("long"))


@query
def citation_check(spark, sf_dir):
    d = D.drafts(spark, sf_dir)
    n = F.size("sources")
    return d.select("conv_id", "turn", F.array_join(T.labels(F.col("draft")), ",").alias("labels"), A.is_cited(F.col("draft")).alias("cited"), A.citations_are_real(F.col("draft"), n).alias("real"), F.size(A.cited_sources(F.col("draft"), F.col("sources"))).cast("long").alias("resolved"))


@query
def label_repair(spark, sf_dir):
    d = D.drafts(spark, sf_dir)
    return d.select("conv_id", "turn", A.strip_leaks(F.col("draft")).alias("stripped"), A.append_label(F.col("draft"), F.size("sources")).alias("labelled"), A.repair_labels(F.col("draft")).alias("repaired"))


@query
def answer_state_machine(spark, sf_dir):
    done = A.answers(D.drafts(spark, sf_dir))
    return done.select("conv_id", "turn", "answer", "reason", F.size("sources").cast("long").alias("n_sources"), F.col("n_dropped").cast("long").alias("n_dropped"))


@query
def response_sources(spark, sf_dir):
    score = F.when(F.col("turn") % 4 == 1, F.col("turn").cast("double") / 10.0)
    shown = D.drafts(spark, sf_dir).select("conv_id", "turn", F.posexplode(A.response_sources(F.col("sources"), score)).alias("pos", "s"))
    return shown.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "s.filename", "s.page_number", "s.text", "s.score")


# evaluation


def _truth_and_hypothesis(spark, sf_dir):
    """Every line against itself with letters lost, beyond-ASCII characters folded."""
    ship_package(spark)
    tall = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    truth = F.regexp_replace("line", "[^\\x00-\\x7f]", "#")
    return tall.select("doc_id", F.col("line_no").cast("long").alias("line_no"), truth.alias("truth")).withColumn("hypothesis", F.regexp_replace("truth", "(?i)th| a |[.] ", " "))


@query
def error_rates(spark, sf_dir):
    return _truth_and_hypothesis(spark, sf_dir).select("doc_id", "line_no", F.round(evaluation.character_error(F.col("truth"), F.col("hypothesis")), 6).alias("cer"))


@query
def word_error_rates(spark, sf_dir):
    return _truth_and_hypothesis(spark, sf_dir).select("doc_id", "line_no", F.round(evaluation.word_error(F.col("truth"), F.col("hypothesis")), 6).alias("wer"))
