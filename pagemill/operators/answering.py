"""The answer stage as column expressions: trust gate, context, citations, claims, refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.config import DEFAULT, Settings
from pagemill.functions import text as T

#: The refusal, the note on a partial answer, and the phrases that ask for a whole document.
NOT_FOUND = "I could not find enough information in the uploaded documents to answer this confidently."
PARTIAL_NOTE = " Some parts of this question are not answered by the document."
DOCUMENT_REQUESTS = (
    "summarize", "summarise", "summary", "overview", "document about", "document cover", "document discuss",
    "explain this document", "explain the document", "main topics", "key topics", "topics covered", "in simple words",
)
HEADER_LEAK = r"\[S\d+\s*\|[^\]]*\]"
LAYOUT_MARK = r"[|\n]"


def is_document_request(question: Column) -> Column:
    return F.coalesce(F.lower(question), F.lit("")).rlike("|".join(DOCUMENT_REQUESTS))


def is_trusted(source: Column, settings: Settings = DEFAULT) -> Column:
    """Text that wasn't recognised, or was with enough confidence; never blank."""
    unscored = F.coalesce(source["content_type"], F.lit("")) != "handwritten_ocr"
    return F.when(T.is_blank(source["text"]), False).when(source["ocr_confidence"].isNull(), unscored).otherwise(source["ocr_confidence"] >= settings.min_confidence)


def build_context(sources: Column) -> Column:
    """Numbered excerpts under their headers; blank ones use up a number but aren't shown."""

    def one(s: Column, i: Column) -> Column:
        name = T.strip(F.coalesce(s["filename"], F.lit("selected document")))
        page = F.when(F.coalesce(s["page_number"], F.lit(0)) != 0, F.concat(F.lit(", page "), s["page_number"].cast("string"))).otherwise("")
        head = F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit(" | "), name, page, F.lit(" | "), F.coalesce(s["content_type"], F.lit("digital_text")), F.lit("]\n"))
        return F.when(~T.is_blank(s["text"]), F.concat(head, T.strip(s["text"])))

    return F.array_join(F.filter(F.transform(sources, one), lambda x: x.isNotNull()), "\n\n")


def citations_are_real(answer: Column, count: Column) -> Column:
    found = T.labels(answer)
    return (F.size(found) > 0) & F.forall(found, lambda x: x.between(1, count))


def is_cited(answer: Column) -> Column:
    return answer.rlike(T.CITATION)


def label_range(count: Column) -> Column:
    return F.when(count == 1, "[S1]").otherwise(F.concat(F.lit("[S1] to [S"), count.cast("string"), F.lit("]")))


def strip_leaks(draft: Column) -> Column:
    """Without copied headers and refusal lines; only a refusal: empty."""
    bare = T.strip(F.regexp_replace(F.coalesce(draft, F.lit("")), HEADER_LEAK, ""))
    return T.strip(F.replace(bare, F.lit(NOT_FOUND), F.lit("")))


def append_label(draft: Column, count: Column) -> Column:
    return F.when((count == 1) & ~is_cited(draft), F.concat(T.strip(draft), F.lit(" [S1]"))).otherwise(draft)


def repair_labels(draft: Column) -> Column:
    """Every label becomes [S1], and runs of them one."""
    return F.regexp_replace(F.regexp_replace(T.strip(draft), r"\[S\d+\]", "[S1]"), rf"(?:\[S1\]{T.SPACE}*)+", "[S1]")


def split_claims(draft: Column) -> Column:
    """Statements up to their label; labels alone and an unlabelled tail are no claims."""
    parts = F.transform(F.regexp_extract_all(draft, F.lit(r"(?s).*?\[S\d+\]"), F.lit(0)), T.strip)
    return F.filter(parts, lambda c: ~c.rlike(r"^\[S\d+\]$"))


def cited_sources(answer: Column, sources: Column) -> Column:
    """The sources behind an answer's labels, in label order."""
    return F.transform(F.filter(T.labels(answer), lambda i: i.between(1, F.size(sources))), lambda i: F.get(sources, i - 1))


def contains_verifier(claim: Column, sources: Column) -> Column:
    """Deterministic default verdict: some excerpt has the claim's words, label and case aside."""
    body = T.strip(F.regexp_replace(F.lower(claim), r"\[s\d+\]", ""))
    return F.exists(sources, lambda s: F.contains(F.lower(s["text"]), body))


def kept_claims(claims: Column, verdict, settings: Settings = DEFAULT) -> Column:
    """The first max_claims claims that have no layout marks and pass; verdict maps a claim to a boolean (null fails)."""
    first = F.slice(claims, 1, max(1, settings.max_claims))
    return F.filter(first, lambda c: ~c.rlike(LAYOUT_MARK) & F.coalesce(verdict(c), F.lit(False)))


def prepared(drafts: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """drafts with what the outcomes are decided on; `_claims` are the statements of the draft that counts."""
    real_text = F.filter("sources", lambda s: ~T.is_blank(s["text"]))
    trusted = F.filter("sources", lambda s: is_trusted(s, settings))
    base = drafts.withColumns({"_n_real": F.size(real_text), "_trusted": trusted})
    base = base.withColumns({"_n": F.size("_trusted"), "_d0": F.coalesce("draft", F.lit(""))})
    base = base.withColumns({"_empty": T.strip(F.col("_d0")).isin("", NOT_FOUND), "_d1": strip_leaks(F.col("_d0"))})
    base = base.withColumn("_d2", append_label(F.col("_d1"), F.col("_n")))
    base = base.withColumn("_again", ~citations_are_real(F.col("_d2"), F.col("_n")))
    # the second draft is cleaned like the first
    base = base.withColumn("_d3", F.when(F.col("_again"), strip_leaks(F.col("retry"))).otherwise(F.col("_d2")))
    mend = (F.col("_n") == 1) & ~citations_are_real(F.col("_d3"), F.col("_n"))
    base = base.withColumn("_d4", F.when(mend, repair_labels(F.col("_d3"))).otherwise(F.col("_d3")))
    return base.withColumn("_claims", split_claims(F.col("_d4")))


def answers(drafts: DataFrame, settings: Settings = DEFAULT, verifier=contains_verifier) -> DataFrame:
    """answer, reason, sources and n_dropped for rows with sources (array), draft and retry.

    retry is the second draft, used where the first one's citations aren't
    real.  Each outcome is one branch; the first that applies wins.
    """
    base = prepared(drafts, settings)
    base = base.withColumn("_kept", kept_claims(F.col("_claims"), lambda c: verifier(c, F.col("_trusted")), settings))
    refused_again = F.col("_again") & (T.strip(F.coalesce("retry", F.lit(""))) == NOT_FOUND) | (F.col("_again") & (F.length("_d3") == 0) & F.coalesce(F.contains(F.col("retry"), F.lit(NOT_FOUND)), F.lit(False)))
    reason = (
        F.when(F.col("_n_real") == 0, "no_evidence")
        .when(F.col("_n") == 0, "low_handwriting_confidence")
        .when(F.col("_empty") | (F.length("_d1") == 0), "not_answerable")
        .when(refused_again, "not_answerable")
        .when(~citations_are_real(F.col("_d4"), F.col("_n")), "untraceable_citation")
        .when(F.size("_claims") == 0, "unsupported_claim")
        .when(F.size("_kept") == 0, "unsupported_claim")
    )
    base = base.withColumn("reason", reason)
    text = F.concat(F.array_join("_kept", " "), F.when(F.size("_claims") > F.size("_kept"), PARTIAL_NOTE).otherwise(""))
    out = base.withColumns(
        {
            "answer": F.when(F.col("reason").isNull(), text).otherwise(NOT_FOUND),
            "sources": F.when(F.col("reason").isNull(), F.col("_trusted")).otherwise(F.slice("_trusted", 1, 0)),
            "n_dropped": F.when(F.col("reason").isNull(), F.size("_claims") - F.size("_kept")).otherwise(0),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def response_sources(sources: Column, score: Column) -> Column:
    """What a response shows of each source: text up to 400 characters, a score of 0 where there is none."""
    return F.transform(sources, lambda s: F.struct(s["filename"].alias("filename"), s["page_number"].alias("page_number"), F.substring(s["text"], 1, 400).alias("text"), F.coalesce(score, F.lit(0.0)).alias("score")))
