"""Training-data pipeline over `documents`.

STAGES are applied in order; each is written to the shared folder and read again,
so that a lost executor never costs more than a stage.

1. quality: documents that the classifier rejects (score under 0.5) go.
2. near_duplicates: op2's method and parameters; of each class of linked fingerprints one
   document stays, that of least id; texts without links, and documents without an id, stay.
3. decontamination: documents that hold a benchmark item go.
4. pii: personal values are replaced by pseudonyms; n_chars follows the text.  The key is
   the session's setting spark.pagemill.pseudonym.key, else one made for the session.
5. encoding: ids of every text, and the digests of ids and decoded text.

The first four return the columns of `documents`, whatever else these are called.  Rows
with one id and one text share their fate and become one in the second stage; different
texts under one id are judged each by itself.  Labels are looked up in the folder's
`labels`, items in its `benchmark`; where these are empty, every document scores 0.5 and
none is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, decontaminate, mil, pseudonym, simhash
from pagemill.llm.queries import tokenizer_file
from pagemill.runtime import table, written

#: Words of a shingle and bits that may differ, as op2's contract has them.
SHINGLE, LIMIT = 4, 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are one empty passage with a score; a null id is carried; long texts are read whole; no rows give none."""
    model = mil.train(docs, table(spark, sf_dir, "labels"))
    return mil.score(docs, model).where(F.col("score") >= 0.5).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without words are copies of each other; rows with a null id all stay; no rows give none."""
    return simhash.one_of_each(docs, simhash.near_duplicates(docs, shingle=SHINGLE, limit=LIMIT))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts, and rows with a null id, are never contaminated; an empty benchmark lets all stay."""
    return decontaminate.clean(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text stays null, with a null n_chars; an empty one stays empty."""
    changed = pseudonym.pseudonymise(docs, pseudonym.session_key(spark))
    value = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return changed.select(*[value.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text counts as empty; a null id is carried; repeated rows give repeated rows."""
    return bpe.round_trip_digests(docs, tokenizer_file())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("encoding", encoding),
]
#: The stages need a trained model, hashes and a tokenizer: none of them is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
