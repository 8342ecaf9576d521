"""Incremental removal of repeated word windows with a log-structured fingerprint index.

The index is a list of immutable runs: Parquet tables bucketed and sorted by anchor
hash, one entry for each distinct (anchor, content) of a stretch of windows, with the
place where it first stood.  A manifest in the index's folder names the live runs and
the greatest key; `FingerprintIndex.open` goes on from it in another session.  A new
batch is

1. cut into the same fingerprints, which are merge-joined with every run (bucketed
   alike, so that history isn't shuffled);
2. judged: a fingerprint (128 bits) that history or an earlier document of the batch
   has covers its windows; of fingerprints that share only the anchor, the texts are
   fetched and verified window by window, byte by byte (`repeats.py`);
3. appended as a new sorted run.  Beyond `fanout` runs, all are merged into one.

The sooner key wins: batches must come in increasing key order (one that doesn't is
refused), and a word is removed if a window over it also starts in a document with a
smaller key.

Defined results: a null text has no words; a text shorter than a window is kept; rows
with a null key are kept whole and take no part; repeated rows, and different texts
under one key, don't remove each other, and each text is judged by itself; an empty
batch changes nothing.  Only key and text are read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import repeats as R
from pagemill.llm.repeats import keyed
from pagemill.llm.suffix import levels
from pagemill.runtime import drop_folder, scratch, shared_folder, written

ENTRY = "key long, th long, at long, n int, mh long, s long"


def word_units(length: int = 50, gram: int = 8, bound: int = 4096) -> R.Units:
    return R.Units(words=True, length=length, grams=levels(gram, length), ordered=True, bound=bound)


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints of all batches so far."""

    def __init__(self, spark: SparkSession, units: R.Units, fanout: int = 4, folder: str | None = None):
        self.spark, self.units, self.fanout = spark, units, fanout
        self.folder = folder or shared_folder(spark, "fingerprints")
        # as many buckets as shuffle partitions: then a batch moves to history's layout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.last: int | None = None
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fanout: int = 4) -> FingerprintIndex:
        """The index that a folder's newest manifest describes."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        top = path(f"{folder}/manifest")
        system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        known = [x.getPath() for x in system.listStatus(top)] if system.exists(top) else []
        done = sorted(x.getName() for x in known if system.exists(path(x, "_SUCCESS")))
        if not done:
            raise FileNotFoundError(f"no manifest of an index in {folder}")
        state = json.loads(spark.read.text(f"{folder}/manifest/{done[-1]}").first()["value"])
        index = cls(spark, R.Units(**{k: tuple(v) if isinstance(v, list) else v for k, v in state["units"].items()}), fanout, folder)
        index.buckets, index.runs, index.last, index.version = state["buckets"], state["runs"], state["last"], int(done[-1])
        for name in index.runs:
            clustered = f"CLUSTERED BY (mh) SORTED BY (mh, s) INTO {index.buckets} BUCKETS"
            columns = ENTRY.replace(" long", " BIGINT").replace(" int", " INT")
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {clustered} LOCATION '{folder}/{name}'")
        return index

    def save(self) -> None:
        """A new manifest; Spark's commit makes it whole or absent, and the newest counts."""
        self.version += 1
        units = {k: getattr(self.units, k) for k in self.units.__dataclass_fields__}
        state = json.dumps({"units": units, "buckets": self.buckets, "runs": self.runs, "last": self.last})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.text(f"{self.folder}/manifest/{self.version:08d}")

    def _write_run(self, entries: DataFrame) -> str:
        name = f"pagemill_run_{uuid.uuid4().hex[:12]}"
        ready = entries.repartition(self.buckets, "mh")
        ready.write.format("parquet").bucketBy(self.buckets, "mh").sortBy("mh", "s").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def history(self) -> list[DataFrame]:
        return [self.spark.table(x) for x in self.runs]

    def judge(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(covered, contested) of a batch's fingerprints against history and within the batch."""
        units = self.units
        totals = R.anchor_totals(rows)
        for run in self.history():
            known = run.groupBy("mh").agg(F.min("s").alias("l"), F.max("s").alias("h"), F.min("key").alias("k"))
            totals = totals.hint("merge").join(known, "mh", "left").select("mh", F.least("lo", "l").alias("lo"), F.greatest("hi", "h").alias("hi"), "total", F.least("first", "k").alias("first"), F.greatest("last", "k").alias("last"))
        kept = written(R.repeated(units, totals), "anchors")
        met = R.meet(units, rows, kept)
        for run in self.history():
            # of history only the anchors that are contested, each entry with its row of the batch's anchors
            mixed = kept.where("mixed")
            met = met.unionByName(run.hint("merge").join(mixed, "mh").select(*[c for c in rows.columns if c in run.columns], F.col("key").alias("ord"), F.lit(False).alias("need"), F.lit(1).alias("copies"), "mixed", "first"))
        return R.judge(units, written(met, "met"))

    def append(self, rows: DataFrame) -> None:
        """Add a batch as a run; compact when there are more than `fanout`."""
        first = rows.groupBy("mh", "s").agg(F.min(F.struct("key", "th", "at", "n")).alias("r"))
        self.runs.append(self._write_run(first.select("r.key", "r.th", "r.at", "r.n", "mh", "s")))
        if len(self.runs) > self.fanout:
            self.compact()
        else:
            self.save()

    def compact(self) -> None:
        """Merge all runs into one that keeps the first place of each fingerprint."""
        merged = self.history()[0]
        for run in self.history()[1:]:
            merged = merged.unionByName(run)
        first = merged.groupBy("mh", "s").agg(F.min(F.struct("key", "th", "at", "n")).alias("r"))
        old, self.runs = self.runs, [self._write_run(first.select("r.key", "r.th", "r.at", "r.n", "mh", "s"))]
        self.save()
        for name in old:
            self._drop(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_folder(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        """Forget the tables in this session; the folder stays and can be opened again."""
        for name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def remove(self) -> None:
        """Delete the index."""
        self.close()
        drop_folder(self.spark, self.folder)

    def advance(self, batch: DataFrame) -> bool:
        """Note the batch's greatest key; false if it has none. Keys up to the last batch's are refused."""
        low, high = batch.agg(F.min("key"), F.max("key")).first()
        if low is None:
            return False
        if self.last is not None and low <= self.last:
            raise ValueError(f"a batch from key {low} on comes after key {self.last}")
        self.last = high
        return True


def batch_rows(docs: DataFrame, units: R.Units) -> DataFrame:
    """A batch's fingerprints, written once: they are joined, then appended."""
    rows = R.run_rows(docs, units).withColumns({"ord": F.col("key"), "need": F.lit(True), "copies": F.lit(1)})
    return written(rows, "fingerprints")


def add_batch(index: FingerprintIndex, batch: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """Judge and append one batch (key, th, text); library has the texts of earlier batches.

    Returns (key, n_units, n_removed, n_spans, kept) of the batch.
    """
    with scratch(index.spark):
        some = index.advance(batch)
        rows = batch_rows(batch, index.units)
        covered, contested = index.judge(rows)
        texts = batch if library is None else library.unionByName(batch)
        covered = covered.union(R.settle_by_texts(index.units, written(contested, "contested"), texts))
        out = R.apply_cover(index.units, batch, covered)
        if some:
            index.append(rows)
    return out


def remove_repeats(df: DataFrame, batches: int = 3, fanout: int = 1, units: R.Units | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The whole table as `batches` successive batches of increasing keys.

    (key, n_words, n_removed, kept): kept has the other words, joined by one space.
    Verification of all batches' contested fingerprints is one pass over the texts.
    """
    units = units or word_units()
    docs = keyed(df, text, key)
    spark = df.sparkSession
    index = FingerprintIndex(spark, units, fanout)
    cuts = docs.agg(F.percentile_approx("key", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    with scratch(spark):
        covered, contested = [], []
        for low, high in zip(bounds, bounds[1:]):
            batch = docs
            if low is not None:
                batch = batch.where(F.col("key") > low)
            if high is not None:
                batch = batch.where(F.col("key") <= high)
            with scratch(spark):
                rows = batch_rows(batch, units)
                done, open_ = index.judge(rows)
                # both are written now: compaction may replace the runs they were read from
                covered.append(written(done, "covered", result=True))
                contested.append(written(open_, "contested", result=True))
                if high is not None:
                    index.last = high
                    index.append(rows)
        waiting = contested[0]
        for more in contested[1:]:
            waiting = waiting.unionByName(more)
        covered.append(R.settle_by_texts(units, waiting, docs))
        whole = covered[0]
        for more in covered[1:]:
            whole = whole.union(more)
        out = R.apply_cover(units, docs, whole)
    index.remove()
    return out.select(F.col("key").alias(key), F.col("n_units").alias("n_words"), "n_removed", F.col("kept").cast("string").alias("kept"))
