"""The chunk store: an append-only log of generations in Parquet.

A document is replaced by appending its next generation, deleted by appending a
tombstone; readers take each document's newest entry.  Writes are Spark's job
commits, so that a reader sees a whole generation or none.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import providers
from pagemill.functions import text as T
from pagemill.operators import catalog
from pagemill.schemas import CHUNKS, PAGES, REJECTS

LOG = f"{CHUNKS}, generation long, deleted boolean"
#: Pages that came by stream, as they were read.
PAGE_LOG = f"{PAGES}, document_key string, generation long"
VECTORS = "id string, embedding array<double>"
_one_writer = threading.Lock()


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str | None = None) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path or self.path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def log(self) -> DataFrame:
        """Every entry; a store that isn't there is empty, one that can't be read is an error."""
        if not self._exists():
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.path)

    def chunks(self, document_name: str | None = None) -> DataFrame:
        """Live chunks, of one document (case and outer white space aside) or of all."""
        log = self.log()
        if document_name:
            log = log.where(F.col("document_key") == T.document_key(F.lit(document_name)))
        return catalog.latest(log).where("NOT deleted").drop("generation", "deleted")

    def next_generation(self) -> int:
        last = [log.agg(F.max("generation")).first()[0] or 0 for log in (self.log(), self._page_log())]
        return max(last) + 1

    def replace(self, chunks: DataFrame, empty: DataFrame | None = None, generation: int | None = None) -> None:
        """Append chunks (schema CHUNKS) as the newest generation of their documents; documents in empty (document_name, document_key) have none left."""
        with _one_writer:
            number = generation or self.next_generation()
            stamp = lambda df, gone: df.withColumns({"generation": F.lit(number).cast("long"), "deleted": F.lit(gone)})
            self._append(stamp(chunks, False) if empty is None else stamp(chunks, False).unionByName(stamp(empty, True), allowMissingColumns=True))

    def delete(self, names: list[str]) -> None:
        """Delete documents by name; unknown and blank names do nothing."""
        if not names:
            return
        with _one_writer:
            gone = self.spark.createDataFrame([(n,) for n in names], "document_name string").select("document_name", T.document_key(F.col("document_name")).alias("document_key"))
            known = self.log().select("document_key").distinct()
            rows = gone.where("length(document_key) > 0").dropDuplicates(["document_key"]).join(known, "document_key", "left_semi")
            self._append(rows.withColumns({"generation": F.lit(self.next_generation()).cast("long"), "deleted": F.lit(True)}))

    def _append(self, rows: DataFrame) -> None:
        fields = self.spark.createDataFrame([], LOG).schema
        shaped = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        shaped.write.mode("append").parquet(self.path)

    def _page_log(self) -> DataFrame:
        if not self._exists(f"{self.path}-pages"):
            return self.spark.createDataFrame([], PAGE_LOG)
        return self.spark.read.schema(PAGE_LOG).parquet(f"{self.path}-pages")

    def pages(self) -> DataFrame:
        """Streamed pages (PAGE_LOG): the newest text of each page, without those before a deletion or an upload of the whole document."""
        read = self._page_log()
        streamed = read.select("document_key", "generation").distinct()
        whole = self.log().select("document_key", "generation").distinct().join(streamed, ["document_key", "generation"], "left_anti")
        floor = whole.groupBy("document_key").agg(F.max("generation").alias("floor"))
        since = read.join(floor, "document_key", "left").where("floor IS NULL OR generation > floor")
        newest = F.max(F.struct("generation", "document_name", "raw_text", "has_image")).alias("p")
        return since.groupBy("document_key", "page_number").agg(newest).select("p.document_name", "page_number", "p.raw_text", "p.has_image", "document_key", "p.generation")

    def keep_pages(self, pages: DataFrame) -> None:
        """Append streamed pages (PAGE_LOG)."""
        self._add(pages, PAGE_LOG, f"{self.path}-pages")

    def rejects(self) -> DataFrame:
        """What streams couldn't index."""
        if not self._exists(f"{self.path}-rejects"):
            return self.spark.createDataFrame([], REJECTS)
        return self.spark.read.schema(REJECTS).parquet(f"{self.path}-rejects")

    def reject(self, rows: DataFrame) -> None:
        self._add(rows, REJECTS, f"{self.path}-rejects")

    def _add(self, rows: DataFrame, schema: str, path: str) -> None:
        fields = self.spark.createDataFrame([], schema).schema
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).write.mode("append").parquet(path)

    def index(self, chunks: DataFrame, embedder: providers.Provider) -> None:
        """Embed chunks that have text once, and keep the vectors by chunk id."""
        some = chunks.where(~T.is_blank(F.col("text"))).select("id", "text")
        providers.apply(some, embedder, ["text"], "embedding", "array<double>").select("id", "embedding").write.mode("append").parquet(f"{self.path}-vectors")

    def vectors(self) -> DataFrame:
        """(document_key, chunk_index, embedding) of live chunks; vectors of replaced chunks never surface."""
        live = self.chunks().select("id", "document_key", "chunk_index")
        if not self._exists(f"{self.path}-vectors"):
            return live.select("document_key", "chunk_index", F.lit(None).cast("array<double>").alias("embedding")).where(F.lit(False))
        kept = self.spark.read.schema(VECTORS).parquet(f"{self.path}-vectors").dropDuplicates(["id"])
        return live.join(kept, "id").drop("id")

    def compact(self, path: str) -> ChunkStore:
        """A new store with the live generations, their vectors, streamed pages and rejects only."""
        new = ChunkStore(self.spark, path)
        live = catalog.latest(self.log()).where("NOT deleted")
        live.write.parquet(new.path)
        if self._exists(f"{self.path}-vectors"):
            kept = self.spark.read.schema(VECTORS).parquet(f"{self.path}-vectors").dropDuplicates(["id"])
            kept.join(live.select("id"), "id", "left_semi").write.parquet(f"{new.path}-vectors")
        if self._exists(f"{self.path}-pages"):
            new.keep_pages(self.pages())
        if self._exists(f"{self.path}-rejects"):
            new.reject(self.rejects().distinct())
        return new

    def list_documents(self) -> DataFrame:
        return catalog.list_documents(self.chunks())

    def health(self) -> DataFrame:
        return catalog.health(self.chunks())
