"""Retrieval over many questions at once: lexical and dense ranks, fusion, reranking, cut-off.

Every question is scoped to one document by `document_key`; no question sees
another document's chunks.  Statistics and postings are tables derived from the
chunk table, so that a batch of questions is a few joins on (document, token).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.config import DEFAULT, Settings
from pagemill.functions import text as T
from pagemill.runtime import small_side, written

#: Fixed values of the ranking function (Okapi): k1, b, and the share of the mean for common words.
K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 6


def candidate_pool(total: Column, settings: Settings = DEFAULT) -> Column:
    return F.least(F.greatest(F.lit(settings.rerank_candidates), F.floor(total / 20).cast("int")), F.lit(settings.rerank_candidates_max))


def postings(chunks: DataFrame) -> DataFrame:
    """(document_key, chunk_index, token, tf)."""
    words = chunks.select("document_key", "chunk_index", F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy("document_key", "chunk_index", "token").agg(F.count("*").alias("tf"))


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("document_key", "chunk_index", F.size(T.tokens(F.col("text"))).cast("long").alias("length"))


def indexed(questions: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """postings and chunk_lengths, written, of the documents that are asked about: texts are split into words once."""
    keys = small_side(written(questions.select("document_key").distinct(), "asked"))
    words = chunks.join(keys, "document_key", "left_semi").select("document_key", "chunk_index", T.tokens(F.col("text")).alias("words"))
    posted = words.select("document_key", "chunk_index", F.explode_outer("words").alias("token")).groupBy("document_key", "chunk_index", "token").agg(F.count("*").alias("tf"))
    kept = written(posted, "postings")
    lengths = kept.groupBy("document_key", "chunk_index").agg(F.sum(F.when(F.col("token").isNotNull(), F.col("tf")).otherwise(0)).alias("length"))
    return kept.where("token IS NOT NULL"), written(lengths, "lengths")


def term_weights(posted: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((document_key, token, idf), (document_key, n_chunks, mean_length))."""
    documents = lengths.groupBy("document_key").agg(F.count("*").alias("n_chunks"), (F.sum("length").cast("double") / F.count("*")).alias("mean_length"))
    df = posted.groupBy("document_key", "token").agg(F.count("*").alias("df")).join(documents.select("document_key", "n_chunks"), "document_key")
    raw = df.withColumn("raw", F.log(F.col("n_chunks") - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5)))
    mean = raw.groupBy("document_key").agg((F.sum("raw") / F.count("*")).alias("mean_raw"))
    weighed = raw.join(mean, "document_key").withColumn("idf", F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean_raw")).otherwise(F.col("raw")))
    return weighed.select("document_key", "token", "idf"), documents


def question_tokens(questions: DataFrame) -> DataFrame:
    """(query_id, document_key, token, qtf) from (query_id, document_key, question)."""
    words = questions.select("query_id", "document_key", F.explode(T.tokens(F.col("question"))).alias("token"))
    return words.groupBy("query_id", "document_key", "token").agg(F.count("*").alias("qtf"))


def bm25_scores(questions: DataFrame, chunks: DataFrame, posted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, document_key, chunk_index, n_chunks, score) of chunks that share a word with their question."""
    posted, lengths = posted or (postings(chunks), chunk_lengths(chunks))
    idf, documents = term_weights(posted, lengths)
    asked = question_tokens(questions)
    hits = asked.join(posted, ["document_key", "token"]).join(idf, ["document_key", "token"]).join(lengths, ["document_key", "chunk_index"]).join(documents, "document_key")
    weight = F.col("idf") * (F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.col("mean_length"))))
    return hits.groupBy("query_id", "document_key", "chunk_index", "n_chunks").agg(F.round(F.sum(F.col("qtf") * weight), DIGITS).alias("score"))


def ranked(scores: DataFrame, limit: Column, positive: bool = False) -> DataFrame:
    """Rank by score, ties in chunk order, up to a limit per question; then only scores above 0, if asked."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_index"))
    top = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return top.where("score > 0") if positive else top


def bm25_ranking(questions: DataFrame, chunks: DataFrame, settings: Settings = DEFAULT, posted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    return ranked(bm25_scores(questions, chunks, posted or indexed(questions, chunks)), candidate_pool(F.col("n_chunks"), settings), positive=True)


def cosine(a: Column, b: Column) -> Column:
    """Inner product of unit vectors, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def dense_ranking(questions: DataFrame, vectors: DataFrame, limit: Column) -> DataFrame:
    """Exact cosine ranks from (query_id, document_key, vector) and (document_key, chunk_index, embedding)."""
    # counted questions go to the vectors: these stay where they are, each task ranks its own, and only ranks move
    pairs = vectors.join(small_side(questions, 50_000), "document_key")
    return ranked(pairs.select("query_id", "document_key", "chunk_index", F.round(cosine(F.col("vector"), F.col("embedding")), DIGITS).alias("score")), limit)


def bag_scores(questions: DataFrame, chunks: DataFrame, posted: DataFrame | None = None) -> DataFrame:
    """Cosine of word counts: the deterministic dense default where no embedding model is plugged in."""
    posted = postings(chunks) if posted is None else posted
    norms = posted.groupBy("document_key", "chunk_index").agg(F.sum(F.col("tf") * F.col("tf")).alias("cc"))
    asked = question_tokens(questions)
    length = asked.groupBy("query_id").agg(F.sum(F.col("qtf") * F.col("qtf")).alias("qq"))
    dots = asked.join(posted, ["document_key", "token"]).groupBy("query_id", "document_key", "chunk_index").agg(F.sum(F.col("qtf") * F.col("tf")).alias("dot"))
    joined = dots.join(norms, ["document_key", "chunk_index"]).join(length, "query_id")
    return joined.select("query_id", "document_key", "chunk_index", F.round(F.col("dot") / (F.sqrt(F.col("cc").cast("double")) * F.sqrt(F.col("qq").cast("double"))), DIGITS).alias("score"))


def fuse(dense: DataFrame, lexical: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, document_key, chunk_index, rrf_score, fused_rank): reciprocal ranks added, ties as first seen."""
    both = dense.select("query_id", "document_key", "chunk_index", F.col("rank").alias("d"), F.lit(None).cast("int").alias("l")).unionByName(
        lexical.select("query_id", "document_key", "chunk_index", F.lit(None).cast("int").alias("d"), F.col("rank").alias("l"))
    )
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(settings.rrf_k) + F.col(c)), F.lit(0.0))
    added = both.groupBy("query_id", "document_key", "chunk_index").agg(F.max("d").alias("d"), F.max("l").alias("l"))
    scored = added.withColumn("rrf_score", F.round(share("d") + share("l"), DIGITS))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.coalesce(F.col("d"), F.lit(1_000_000) + F.col("l")))
    return scored.withColumn("fused_rank", F.row_number().over(w)).drop("d", "l")


def overlap_score(question: Column, text: Column) -> Column:
    """Deterministic reranker default: the share of the question's distinct words that the text has, on a logit-like scale."""
    asked = F.array_distinct(T.tokens(question))
    met = F.size(F.array_intersect(asked, T.tokens(text)))
    return F.when(F.size(asked) == 0, F.lit(-6.0)).otherwise(F.round(F.lit(12.0) * met / F.size(asked) - F.lit(6.0), DIGITS))


def cut_and_order(candidates: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Candidates within the margin of their question's best score, ranked; at most top_k."""
    per = Window.partitionBy("query_id")
    near = candidates.withColumn("best", F.max("rerank_score").over(per)).where(F.col("rerank_score") >= F.col("best") - F.lit(settings.rerank_margin)).drop("best")
    w = per.orderBy(F.desc("rerank_score"), F.desc("rrf_score"), F.asc("fused_rank"))
    return near.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= settings.top_k)


def evidence(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fused ranks with their chunks; ids that the chunk table hasn't, and blank chunks, vanish."""
    rows = chunks.select(
        "document_key", "chunk_index", "id", T.strip(F.col("text")).alias("text"), "filename", "document_name", "chunk_id", "page_number",
        F.coalesce("content_type", F.lit("digital_text")).alias("content_type"), F.coalesce("extraction_method", F.lit("unknown")).alias("extraction_method"), "ocr_confidence",
    )
    return fused.join(rows, ["document_key", "chunk_index"]).where(F.length("text") > 0)


def retrieve(questions: DataFrame, chunks: DataFrame, settings: Settings = DEFAULT, dense: DataFrame | None = None, reranker=overlap_score) -> DataFrame:
    """The evidence rows of every question (query_id, document_key, question), best first.

    dense: ranks from an embedding model, else the word-count cosine.
    Blank questions, unknown documents and top_k of 0 give no rows.
    """
    asked = questions.where(~T.is_blank(F.col("question")))
    totals = chunks.groupBy("document_key").agg(F.count("*").alias("n_chunks"))
    pool = candidate_pool(F.col("n_chunks"), settings)
    posted = indexed(asked, chunks)
    if dense is None:
        dense = ranked(bag_scores(asked, chunks, posted[0]).join(totals, "document_key"), pool)
    fused = fuse(dense, bm25_ranking(asked, chunks, settings, posted), settings).join(totals, "document_key").where(F.col("fused_rank") <= pool)
    candidates = evidence(fused, chunks).join(asked.select("query_id", "question"), "query_id")
    return cut_and_order(candidates.withColumn("rerank_score", reranker(F.col("question"), F.col("text"))), settings)


def overview(chunks: DataFrame, limit: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Evenly spread chunks of each document, blanks ignored; all of a short document, none for limit 0."""
    count = settings.overview_chunks if limit is None else limit
    some = chunks.where(~T.is_blank(F.col("text"))).withColumn("page", F.coalesce("page_number", F.lit(0)))
    # places come from page counts: windows hold a row per page, or a page's chunk numbers, never a document's texts
    w = Window.partitionBy("document_key")
    before = w.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = some.groupBy("document_key", "page").agg(F.count("*").alias("n")).withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(w)}).drop("n")
    within = Window.partitionBy("document_key", "page").orderBy("chunk_index")
    numbered = some.select("document_key", "page", "chunk_index").withColumn("r", F.row_number().over(within)).join(pages, ["document_key", "page"])
    picks = numbered.select("document_key", "chunk_index", "total", (F.col("before") + F.col("r") - 1).cast("int").alias("place"))
    if count <= 0:
        picks = picks.where(F.lit(False))
    step = F.col("total").cast("double") / F.lit(max(count, 1))
    # the place is taken if some i < count has floor(i * step) = place: the least i with i * step >= place is the only candidate
    i = F.ceil(F.col("place") / step)
    taken = lambda x: (x < count) & (F.floor(x * step) == F.col("place"))
    chosen = picks.where((F.col("total") <= count) | taken(i) | taken(i - 1) | taken(i + 1))
    return some.drop("page").join(chosen, ["document_key", "chunk_index"]).select(*chunks.columns, "place", "total")
