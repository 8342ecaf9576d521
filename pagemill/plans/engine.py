"""The engine's front: ingest files, list, ask questions in batches, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import providers
from pagemill.config import DEFAULT, Settings
from pagemill.functions import text as T
from pagemill.functions.confidence import line_confidence
from pagemill.operators import answering, chunking, imaging, layout, ranking
from pagemill.runtime import written
from pagemill.sources import ingest
from pagemill.sources.store import ChunkStore


class Engine:
    """Models are providers; without a recogniser, pages that need one are rejected."""

    def __init__(self, spark: SparkSession, store: str, settings: Settings = DEFAULT, embedder=None, reranker=ranking.overlap_score, generator=None, verifier=None, recogniser=None, pdf_pages=None):
        self.spark, self.settings, self.store = spark, settings, ChunkStore(spark, store)
        self.embedder, self.reranker, self.recogniser, self.pdf_pages = embedder, reranker, recogniser, pdf_pages
        self.generator = generator or providers.ExtractiveGenerator()
        self.verifier = verifier or providers.ContainmentVerifier()

    def info(self) -> dict:
        return {"service": "pagemill", "models": {k: getattr(v, "name", None) for k, v in (("embedder", self.embedder), ("generator", self.generator), ("verifier", self.verifier), ("recogniser", self.recogniser))}}

    def health(self) -> dict:
        return self.store.health().first().asDict() | {"recogniser_ready": self.recogniser is not None}

    def list_documents(self) -> DataFrame:
        return self.store.list_documents()

    def delete(self, names: list[str]) -> None:
        self.store.delete(names)

    def ingest(self, path: str) -> tuple[DataFrame, DataFrame]:
        """(summary, rejects) after indexing every file below path as the newest generation of its document."""
        files, refused = ingest.scan(self.spark, path, self.settings)
        pages, broken = ingest.extract(files, self.pdf_pages)
        pages = written(pages, "pages")
        paged = pages.where("page_number IS NOT NULL").where(T.extension(F.col("document_name")) == ".pdf").select("document_name", "page_number", "raw_text", "has_image")
        routed = written(layout.route_pages(paged, self.settings), "routed")
        read, scans, over = layout.budgeted(routed, self.settings)
        digital = read.select("document_name", "page_number", F.col("usable_text").alias("text"), F.lit("pymupdf").alias("extraction_method"))
        plain = pages.where("page_number IS NULL").select("document_name", "page_number", F.col("raw_text").alias("text"), F.when(T.extension(F.col("document_name")) == ".docx", "python-docx").otherwise("plaintext").alias("extraction_method"))
        texts = chunking.chunk_texts(digital.unionByName(plain), ["document_name", "page_number", "extraction_method"], "text", self.settings)
        chunks = texts.select("document_name", "page_number", F.lit("digital_text").alias("content_type"), "extraction_method", "position", "text", F.lit(None).cast("double").alias("ocr_confidence"))
        kept = digital.unionByName(plain).select("document_name", "page_number", F.lit("digital_text").alias("content_type"), "extraction_method")
        lost = scans
        if self.recogniser is not None:
            lines = written(self._recognised(path).unionByName(self._recognised_scans(files, scans)), "lines")
            lost = scans.join(lines.select("document_name", "page_number"), ["document_name", "page_number"], "left_anti")
            packed = chunking.chunk_lines(lines, ["document_name", "page_number"], "lines", self.settings)
            chunks = chunks.unionByName(packed.select("document_name", "page_number", F.lit("handwritten_ocr").alias("content_type"), F.lit("trocr").alias("extraction_method"), "position", "text", "ocr_confidence"))
            kept = kept.unionByName(lines.select("document_name", "page_number", F.lit("handwritten_ocr").alias("content_type"), F.lit("trocr").alias("extraction_method")))
        # ids carry the generation, so that vectors of replaced chunks are nobody's
        records = written(chunking.chunk_records(chunks, str(self.store.next_generation())), "chunks")
        self.store.replace(records)
        if self.embedder is not None:
            self.store.index(records, self.embedder)
        from pagemill.operators.catalog import upload_summary

        summary = upload_summary(kept, records)
        names = files.select("document_name").distinct()
        empty = names.join(records.select("document_name").distinct(), "document_name", "left_anti").join(broken.unionByName(over).select("document_name").distinct(), "document_name", "left_anti")
        silent = empty.select(F.lit(None).cast("string").alias("path"), "document_name", F.lit("No readable text found in this document.").alias("error"))
        return summary, refused.unionByName(broken).unionByName(over).unionByName(layout.unrecognised(lost)).unionByName(silent)

    def _recognised(self, path: str) -> DataFrame:
        """(document_name, page_number, lines, confidence) of image files."""
        images = self.spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,PNG,jpg,JPG,jpeg,JPEG}").load(path)
        found = imaging.recognise(imaging.image_lines(images, self.settings.denoise_images), self.recogniser, self.settings.recognizer_batch)
        return found.select(T.base_name(F.col("path")).alias("document_name"), F.lit(1).alias("page_number"), "lines", F.round(line_confidence(F.col("lines")), 4).alias("confidence"))

    def _recognised_scans(self, files: DataFrame, scans: DataFrame) -> DataFrame:
        """(document_name, page_number, lines, confidence) of the scans whose image the PDF reader gives."""
        images = ingest.page_images(files, scans, self.pdf_pages)
        lines = imaging.image_lines(images, self.settings.denoise_images, self.settings.pdf_max_dimension)
        found = imaging.recognise(lines, self.recogniser, self.settings.recognizer_batch)
        name = F.split("path", "\x1f")
        return found.select(name[0].alias("document_name"), name[1].cast("int").alias("page_number"), "lines", F.round(line_confidence(F.col("lines")), 4).alias("confidence"))

    def evidence(self, questions: DataFrame) -> DataFrame:
        """(query_id, question, sources) from (query_id, question, document_name): overviews for whole-document requests, else ranked chunks."""
        chunks = self.store.chunks()
        asked = questions.where(~T.is_blank(F.col("question"))).withColumn("document_key", T.document_key(F.col("document_name"))).withColumn("whole", answering.is_document_request(F.col("question")))
        ranked = ranking.retrieve(asked.where("NOT whole"), chunks, self.settings, self._dense(asked, chunks), self.reranker)
        picked = ranked.select("query_id", F.col("final_rank").alias("place"), "text", "filename", "page_number", "content_type", "ocr_confidence")
        wide = asked.where("whole").select("query_id", "document_key")
        spread = ranking.overview(chunks.join(wide.select("document_key").distinct(), "document_key", "left_semi"), None, self.settings).join(wide, "document_key")
        picked = picked.unionByName(spread.select("query_id", F.col("place").cast("int").alias("place"), "text", "filename", "page_number", "content_type", "ocr_confidence"))
        ordered = picked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "text", "filename", "page_number", "content_type", "ocr_confidence"))).alias("s"))
        sources = F.transform(F.coalesce("s", F.array()), lambda x: F.struct(*[x[c].alias(c) for c in ("text", "filename", "page_number", "content_type", "ocr_confidence")]))
        return questions.join(ordered, "query_id", "left").select("query_id", "question", sources.alias("sources"))

    def _dense(self, asked: DataFrame, chunks: DataFrame) -> DataFrame | None:
        if self.embedder is None:
            return None
        vectors = self.store.vectors()
        queries = providers.apply(asked.select("query_id", "document_key", F.col("question").alias("text")), self.embedder, ["text"], "vector", "array<double>").drop("text")
        totals = chunks.groupBy("document_key").agg(F.count("*").alias("n_chunks"))
        pairs = queries.join(vectors, "document_key").join(totals, "document_key")
        score = F.round(ranking.cosine(F.col("vector"), F.col("embedding")), ranking.DIGITS)
        return ranking.ranked(pairs.select("query_id", "document_key", "chunk_index", "n_chunks", score.alias("score")), ranking.candidate_pool(F.col("n_chunks"), self.settings))

    def ask(self, questions: DataFrame) -> DataFrame:
        """(query_id, question, answer, reason, sources, n_dropped) for (query_id, question, document_name)."""
        found = written(self.evidence(questions), "evidence")
        trusted = F.filter("sources", lambda s: answering.is_trusted(s, self.settings))
        ready = found.withColumn("all_sources", F.col("sources")).withColumn("sources", trusted)
        # only rows with evidence reach the generator
        some, none = ready.where(F.size("sources") > 0), ready.where(F.size("sources") == 0)
        first = providers.apply(some, self.generator, ["question", "sources"], "draft", "string")
        first = written(first.unionByName(none.withColumn("draft", F.lit(None).cast("string"))), "drafts")
        n = F.size("sources")
        again = (n > 0) & ~answering.citations_are_real(answering.append_label(answering.strip_leaks(F.col("draft")), n), n) & (F.length(answering.strip_leaks(F.col("draft"))) > 0)
        retried = providers.apply(first.where(again), self.generator, ["question", "sources", "draft"], "retry", "string")
        drafts = retried.unionByName(first.where(~F.coalesce(again, F.lit(False))).withColumn("retry", F.lit(None).cast("string")))
        drafts = written(drafts.withColumn("sources", F.col("all_sources")).drop("all_sources"), "second")
        done = answering.answers(self._judged(drafts), self.settings, lambda claim, _: F.array_contains("passed", claim))
        return done.select("query_id", "question", "answer", "reason", "sources", "n_dropped")

    def _judged(self, drafts: DataFrame) -> DataFrame:
        """drafts with `passed`: the claims that the verifier passes."""
        claims = answering.prepared(drafts, self.settings).select("query_id", F.col("_trusted").alias("sources"), F.posexplode("_claims").alias("pos", "claim"))
        passed = providers.verified_claims(claims, self.verifier, self.settings).groupBy("query_id").agg(F.collect_set("claim").alias("passed"))
        return drafts.join(passed, "query_id", "left").withColumn("passed", F.coalesce("passed", F.array().cast("array<string>")))
