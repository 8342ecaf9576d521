"""Exact repeated windows over a whole corpus: anchored runs, their ranks, and how contested ones are settled.

Positions are the content-defined anchors of `anchors.py`, not all positions: the
anchor of a window is its least `gram`-unit substring, so windows with different
anchors differ.  A *run* is a stretch of windows with one anchor; (anchor name,
content hash), 128 bits in all, is its rank.

Ranks are grouped by anchor.  An anchor that occurs once settles its windows as
unique.  If all runs of an anchor have one content, their windows repeat.  Runs with
one anchor and several contents are *contested*: they may share some of their windows.
Equal contents are settled, one of them staying as a witness.  The rest is settled

* by `settle_by_ranks`: cut anew under anchors of doubled length, named by the pair of
  the names of their halves, and ranked again, until unique or at the window length;
* or by `settle_by_texts`: windows of one anchor are compared in one task, bytes
  included; anchors with too many or too large runs are first cut anew as above.

Rows of runs: key, th, at (first window), n (windows), mh, s, ord, need, copies.  The
texts of contested runs of the first level, segments, stay in a table of their own; runs
of later levels name theirs by base, its first window, and texts aren't joined by rank.
(key, th) names a text: th tells apart different texts under one key.
*Ordered*: a window is covered if an equal one has a smaller `ord`.
*Unordered*: a window is covered if an equal one stands anywhere else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import anchors as A
from pagemill.runtime import scratch, ship_package, small_side, written

BYTE_CODE = A.mix(np.arange(1, 257, dtype=np.uint64))
NAME = ["key", "th"]
ROWS = "key long, th long, at long, n int, mh long, s long"
PLACED = f"{ROWS}, ord long, need boolean, copies int, base long"
FIELDS = ["key", "th", "at", "n", "mh", "s", "ord", "need", "copies", "base", "seg"]
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.binary())
#: Bytes of segments that are cut or compared at once.
CHUNK = 1 << 19


@dataclass(frozen=True)
class Units:
    """What a window is made of, its length, and the anchor lengths of the levels.

    bound, heavy: runs, and bytes of their texts, from which an anchor isn't compared in one task.
    """

    words: bool
    length: int
    grams: tuple[int, ...]
    ordered: bool
    bound: int = 4096
    heavy: int = 4 << 20

    def prepare(self, text: str | None) -> tuple[bytes, np.ndarray | None, np.ndarray | None]:
        """The unit text, and for words their starts and ends in it."""
        data = (text or "").encode("utf-8")
        if not self.words:
            return data, None, None
        data = b" ".join(data.split())
        return data, *A.word_spans(data)

    def codes(self, data: bytes, starts: np.ndarray | None, ends: np.ndarray | None) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8)
        if not self.words:
            return BYTE_CODE[raw]
        if not len(starts):
            return np.zeros(0, np.uint64)
        return A.span_hash(A.prefix_hash(BYTE_CODE[raw]), starts, ends)

    def cut(self, text: str | None) -> tuple[np.ndarray, ...]:
        """(first window, count, anchor name, content hash) of each run of a text at the first level."""
        data, starts, ends = self.prepare(text)
        at, n, mh = A.runs(self.codes(data, starts, ends), self.length, self.grams[0])
        last = at + n + self.length - 1
        begin, end = (at, last) if not self.words else (starts[at], ends[last - 1]) if len(at) else (at, at)
        digest = xxhash.xxh3_64_intdigest
        s = np.fromiter((digest(data[a:z]) for a, z in zip(begin.tolist(), end.tolist())), np.uint64, len(at))
        return at, n, mh, s

    def names(self, prefix: np.ndarray, level: int) -> np.ndarray:
        """Names of all substrings of the level's length: each the name of a pair of names of the level before, the second at the offset that is added."""
        size = self.grams[0]
        out = A.gram_hash(prefix, size)
        for longer in self.grams[1 : level + 1]:
            out = A.pair_name(out, longer - size)
            size = longer
        return out


class Joined:
    """The texts of several runs behind each other, with their windows numbered through."""

    def __init__(self, units: Units, n: np.ndarray, segs: list[bytes]):
        self.units, self.n = units, n.astype(np.int64)
        self.data = (b" " if units.words else b"").join(segs)
        self.spans = A.word_spans(self.data) if units.words else (None, None)
        self.prefix = A.prefix_hash(units.codes(self.data, *self.spans))
        per = self.n + units.length - 1
        first = np.cumsum(per) - per
        self.owner = np.repeat(np.arange(len(n)), self.n)
        self.within = np.arange(len(self.owner)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.start = first[self.owner] + self.within

    def bytes_of(self, start: int, windows: int = 1) -> bytes:
        """The text of windows from a unit on."""
        end = start + windows + self.units.length - 1
        return self.data[start:end] if not self.units.words else self.data[self.spans[0][start] : self.spans[1][end - 1]]


def _small(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes in a column, so that long texts don't pile up."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1]
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def keyed(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, th, text); repeated rows have one name."""
    body = F.col(text).cast("string")
    return df.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("th"), body.alias("text"))


def run_rows(docs: DataFrame, units: Units) -> DataFrame:
    """ROWS of every run of docs (key, th, text); rows with a null key have none."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 2):
            found = [units.cut(x) for x in batch.column(2).to_pylist()]
            names = [np.repeat(batch.column(i).to_numpy(zero_copy_only=False), [len(x[0]) for x in found]) for i in (0, 1)]
            at, n, mh, s = (np.concatenate(x) for x in zip(*found))
            columns = (*names, at, n, mh.view(np.int64), s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS)], FIELDS[:6])

    # shorter texts hold no window
    some = docs.where("key IS NOT NULL").where(F.octet_length("text") >= (2 * units.length - 1 if units.words else units.length))
    return some.select("key", "th", "text").mapInArrow(run, ROWS)


def anchor_totals(rows: DataFrame, ordered: bool = True) -> DataFrame:
    """Per anchor: least and greatest content, copies, least and greatest ord."""
    order = [F.min("ord").alias("first"), F.max("ord").alias("last")] if ordered else [F.lit(None).cast("long").alias("first")]
    return rows.groupBy("mh").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum("copies").alias("total"), *order)


def repeated(units: Units, totals: DataFrame) -> DataFrame:
    """Anchors that can settle anything: (mh, mixed, first)."""
    some = totals.where("last > first" if units.ordered else "total > 1")
    return some.select("mh", (F.col("lo") != F.col("hi")).alias("mixed"), "first")


def meet(units: Units, rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows whose anchor is repeated, without those that are already settled as unique."""
    met = rows.join(kept, "mh")
    return met.where("mixed OR (need AND ord > first)" if units.ordered else "mixed OR need")


def judge(units: Units, met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(covered runs (key, th, at, n), contested rows) of what has met."""
    covered = met.where("NOT mixed").select(*NAME, "at", "n")
    mixed = met.where("mixed")
    kinds = mixed.groupBy("mh", "s").agg(F.sum("copies").alias("same"), F.min("ord").alias("lead"), F.min(F.struct(*NAME, "at")).alias("rep"))
    # written apart: a join of two plain exchanges is one that Spark can split for a hot key
    told = mixed.join(written(kinds, "kinds"), ["mh", "s"])
    if units.ordered:
        out, stay = F.col("need") & (F.col("ord") > F.col("lead")), F.col("ord") == F.col("lead")
        need, copies = F.col("need") & (F.col("ord") > F.col("first")), F.lit(1)
    else:
        out = F.col("need") & (F.col("same") > 1)
        stay = (F.col("same") == 1) | (F.struct(*NAME, "at") == F.col("rep"))
        need, copies = F.col("need") & (F.col("same") == 1), F.least(F.col("same"), F.lit(2))
    carried = [x for x in ("base",) if x in met.columns]
    # written too, since three plans read it
    told = written(told.select(*NAME, "at", "n", "mh", "s", "ord", need.alias("need"), copies.cast("int").alias("copies"), *carried, out.alias("out"), stay.alias("stay")).where("out OR stay"), "told")
    covered = covered.union(told.where("out").select(*NAME, "at", "n"))
    contested = told.where("stay").drop("out", "stay")
    wanted = contested.groupBy("mh").agg(F.max("need").alias("wanted")).where("wanted").select("mh")
    return covered, contested.join(wanted, "mh").select(*NAME, "at", "n", "mh", "s", "ord", "need", "copies", *carried)


def texts_of(docs: DataFrame, names: DataFrame) -> DataFrame:
    """The docs (key, th, text) of the written distinct names, once each; their join moves only these if the names are few."""
    return docs.where("key IS NOT NULL").join(small_side(names), NAME, "left_semi").dropDuplicates(NAME)


def fetch_segments(units: Units, contested: DataFrame, docs: DataFrame) -> DataFrame:
    """Contested rows of the first level with their text, from docs (key, th, text)."""
    wanted = contested.groupBy(*NAME).agg(F.collect_set(F.struct("at", "n", "mh", "s", "ord", "need", "copies")).alias("runs"))
    some = texts_of(docs, written(contested.select(*NAME).distinct(), "names"))
    joined = some.join(wanted, NAME).select(*NAME, "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 2):
            flat, at, n, per = _runs_of(batch, 3)
            segs: list[bytes] = []
            place = 0
            for text, count in zip(batch.column(2).to_pylist(), per.tolist()):
                data, starts, ends = units.prepare(text)
                a, z = at[place : place + count], at[place : place + count] + n[place : place + count] + units.length - 1
                if units.words:
                    a, z = starts[a], ends[z - 1]
                segs += [data[x:y] for x, y in zip(a.tolist(), z.tolist())]
                place += count
            names = [pa.array(np.repeat(batch.column(i).to_numpy(), per)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*names, *(flat.field(i) for i in range(7)), pa.array(at), pa.array(segs, pa.binary())], FIELDS)

    return joined.mapInArrow(run, f"{PLACED}, seg binary")


def _runs_of(batch: pa.RecordBatch, column: int) -> tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray]:
    """The structs in a column of lists, their `at` and `n`, and how many each row has."""
    lists = batch.column(column)
    flat = lists.flatten()
    at, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    return flat, at, n, np.diff(lists.offsets.to_numpy())


def with_texts(units: Units, rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Contested rows of a later level with their text, from the segments they are parts of."""
    wanted = rows.groupBy(*NAME, "base").agg(F.collect_set(F.struct("at", "n", "mh", "s", "ord", "need", "copies")).alias("runs"))
    joined = segments.select(*NAME, "base", "seg").join(wanted, [*NAME, "base"]).select(*NAME, "base", "seg", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 3, CHUNK):
            flat, at, n, per = _runs_of(batch, 4)
            base = np.repeat(batch.column(2).to_numpy(), per)
            segs: list[bytes] = []
            place = 0
            for seg, count in zip(batch.column(3).to_pylist(), per.tolist()):
                a = at[place : place + count] - base[place : place + count]
                z = a + n[place : place + count] + units.length - 1
                if units.words:
                    starts, ends = A.word_spans(seg)
                    a, z = starts[a], ends[z - 1]
                segs += [seg[x:y] for x, y in zip(a.tolist(), z.tolist())]
                place += count
            names = [pa.array(np.repeat(batch.column(i).to_numpy(), per)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*names, *(flat.field(i) for i in range(7)), pa.array(base), pa.array(segs, pa.binary())], FIELDS)

    return joined.mapInArrow(run, f"{PLACED}, seg binary")


def recut(units: Units, rows: DataFrame, level: int) -> DataFrame:
    """Runs, without texts, of the rows' texts under the level's anchors."""
    gram = units.grams[level]
    chosen = rows.select(*NAME, "at", "n", "ord", "need", "copies", "base", "seg")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 8, CHUNK):
            key, th, at, n, order, need, copies, base = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(8))
            j = Joined(units, n, batch.column(8).to_pylist())
            names = units.names(j.prefix, level)
            place = np.arange(len(names), dtype=np.uint64)
            anchor = (A.sliding_min((names & A.HIGH32) | place, units.length - gram + 1) & A.LOW32)[j.start]
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (j.owner[1:] != j.owner[:-1])])
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(anchor)))
            start, o = j.start[head], j.owner[head]
            s = A.span_hash(j.prefix, start, start + count + units.length - 1)
            columns = (key[o], th[o], at[o] + j.within[head], count, names[anchor[head].astype(np.int64)].view(np.int64), s.view(np.int64), order[o], need[o], copies[o], base[o])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS)], FIELDS[:10])

    return chosen.mapInArrow(run, PLACED)


def _level(units: Units, rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame | None]:
    """(covered, contested), written, of rows with texts, ranked again under the level's anchors.

    At the last level each window is its own anchor: equal names are equal windows, and nothing is contested.
    """
    with scratch(rows.sparkSession):
        if units.grams[level] == units.length:
            cut = written(recut(units, rows, level).select(*NAME, "at", "mh", "s", "ord", "need", "copies"), "level")
            same = cut.groupBy("mh", "s").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("last > first") if units.ordered else cut.groupBy("mh", "s").agg(F.sum("copies").alias("total")).where("total > 1")
            met = cut.where("need").select(*NAME, "at", "mh", "s", *["ord"] * units.ordered).join(written(same, "names"), ["mh", "s"])
            met = met.where("ord > first") if units.ordered else met
            return written(met.select(*NAME, "at", F.lit(1).alias("n")), "covered", result=True), None
        cut = written(recut(units, rows, level), "level")
        met = meet(units, cut, written(repeated(units, anchor_totals(cut, units.ordered)), "anchors"))
        covered, contested = judge(units, written(met, "met"))
        return written(covered, "covered", result=True), written(contested, "contested", result=True)


def settle_by_ranks(units: Units, contested: DataFrame, docs: DataFrame) -> DataFrame:
    """Covered runs of the contested rows of the first level: all are ranked again, level by level."""
    segments = rows = written(fetch_segments(units, contested, docs), "segments")
    covered = contested.select(*NAME, "at", "n").where(F.lit(False))
    for level in range(1, len(units.grams)):
        more, left = _level(units, rows, level)
        covered = covered.union(more)
        if left is not None:
            rows = with_texts(units, left, segments)
    return covered


def _compare(units: Units, table: pa.Table) -> pa.RecordBatch:
    """Covered runs among the windows of whole anchor groups: equal hashes, then equal bytes."""
    key, th, at, n, order, need, copies = (table.column(i).to_numpy() for i in range(1, 8))
    j = Joined(units, n, table.column(8).to_pylist())
    owner = j.owner
    hashes = A.span_hash(j.prefix, j.start, j.start + units.length)
    weight = order[owner] if units.ordered else np.zeros(len(owner), np.int64)
    by = np.lexsort((np.arange(len(owner)), weight, hashes))
    head = np.concatenate([[True], hashes[by][1:] != hashes[by][:-1]])
    group = np.cumsum(head) - 1
    lead = np.empty(len(owner), np.int64)
    lead[by] = by[np.flatnonzero(head)][group]
    if units.ordered:
        hit = order[owner] > order[owner[lead]]
    else:
        hit = np.empty(len(owner), bool)
        hit[by] = np.bincount(group, copies[owner[by]])[group] > 1
    hit &= need[owner]
    # windows that follow each other, with leads that follow each other, are checked as one text
    follows = np.concatenate([[False], hit[1:] & hit[:-1] & (owner[1:] == owner[:-1]) & (lead[1:] == lead[:-1] + 1) & (owner[lead[1:]] == owner[lead[:-1]])])
    first = np.flatnonzero(hit & ~follows)
    count = np.add.reduceat(hit.astype(np.int64), first) if len(first) else first
    for w, c in zip(first.tolist(), count.tolist()):
        if lead[w] != w and j.bytes_of(j.start[w], c) != j.bytes_of(j.start[lead[w]], c):
            for x in range(w, w + c):
                hit[x] = _covered_by_text(units, j, x, np.flatnonzero(hashes == hashes[x]), order, copies)
    before = np.concatenate([[False], hit[:-1] & (owner[1:] == owner[:-1])])
    begin = np.flatnonzero(hit & ~before)
    after = np.concatenate([hit[1:] & (owner[1:] == owner[:-1]), [False]])
    end = np.flatnonzero(hit & ~after)
    o = owner[begin]
    return pa.RecordBatch.from_arrays([pa.array(key[o], pa.int64()), pa.array(th[o], pa.int64()), pa.array(at[o] + j.within[begin], pa.int64()), pa.array((end - begin + 1).astype(np.int32))], [*NAME, "at", "n"])


def _covered_by_text(units: Units, j: Joined, window: int, peers: np.ndarray, order: np.ndarray, copies: np.ndarray) -> bool:
    """Whether a window is covered, by the bytes of those with its hash."""
    text = j.bytes_of(j.start[window])
    same = [j.owner[x] for x in peers.tolist() if j.bytes_of(j.start[x]) == text]
    return bool(min(order[same]) < order[j.owner[window]]) if units.ordered else int(copies[same].sum()) > 1


def compare(units: Units, rows: DataFrame) -> DataFrame:
    """Covered runs among rows whose anchors have bounded numbers of rows and bytes each."""
    chosen = rows.select("mh", *NAME, "at", "n", "ord", "need", "copies", "seg")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _small(batches, 8, CHUNK):
            held.append(batch)
            if sum(x.nbytes for x in held) >= CHUNK:
                table = pa.Table.from_batches(held).combine_chunks()
                mh = table.column(0).to_numpy()
                last = int(np.flatnonzero(mh != mh[-1])[-1]) + 1 if (mh != mh[-1]).any() else 0
                if last:
                    yield _compare(units, table.slice(0, last))
                held = table.slice(last).to_batches()
        if held and sum(x.num_rows for x in held):
            yield _compare(units, pa.Table.from_batches(held))

    return chosen.repartition("mh").sortWithinPartitions("mh").mapInArrow(run, "key long, th long, at long, n int")


def settle_by_texts(units: Units, contested: DataFrame, docs: DataFrame) -> DataFrame:
    """Covered runs of the contested rows of the first level: texts are compared, of large anchors after further levels."""
    segments = rows = written(fetch_segments(units, contested, docs), "segments")
    covered = contested.select(*NAME, "at", "n").where(F.lit(False))
    for level in range(len(units.grams)):
        size = rows.groupBy("mh").agg(F.count("*").alias("rows"), F.sum(F.octet_length("seg")).alias("bytes"))
        large = written(size.where((F.col("rows") > units.bound) | (F.col("bytes") > units.heavy)).where("rows > 1").select("mh"), "large")
        covered = covered.union(compare(units, rows.join(small_side(large), "mh", "left_anti")))
        if level + 1 == len(units.grams) or large.isEmpty():
            break
        more, left = _level(units, rows.join(small_side(large), "mh", "left_semi"), level + 1)
        covered = covered.union(more)
        if left is None:
            break
        rows = written(with_texts(units, left, segments), "parts")
    return covered


def apply_cover(units: Units, docs: DataFrame, covered: DataFrame) -> DataFrame:
    """(key, n_units, n_removed, n_spans, kept) for each row of docs (key, th, text): kept is what no covered window touches, as binary.

    Texts without a covered window aren't moved, if the others' names are few enough to be sent everywhere.
    """
    covered = written(covered, "covered", result=True)
    names = written(covered.select(*NAME).distinct(), "names", result=True)
    few = small_side(names)
    spans = covered.groupBy(*NAME).agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    touched = docs.join(few, NAME, "left_semi").join(spans, NAME).select("key", "text", "runs")
    rest = docs.join(few, NAME, "left_anti").select("key", "text", F.lit(None).cast("array<struct<at:bigint,n:int>>").alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 1):
            rows = [_kept(units, text, found) for text, found in zip(batch.column(1).to_pylist(), batch.column(2))]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n_units", "n_removed", "n_spans", "kept"])

    schema = "key long, n_units long, n_removed long, n_spans long, kept binary"
    return touched.mapInArrow(run, schema).union(rest.mapInArrow(run, schema))


def _kept(units: Units, text: str | None, found: pa.ListScalar) -> tuple[int, int, int, bytes]:
    data, starts, ends = units.prepare(text)
    total = len(starts) if units.words else len(data)
    runs = found.values
    if runs is None or not len(runs):
        return total, 0, 0, data
    at, n = (runs.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    mask = A.covered(at, n, units.length, total)
    spans = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))
    if units.words:
        kept = b" ".join([data[a:z] for a, z in zip(starts[~mask].tolist(), ends[~mask].tolist())])
    else:
        kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
    return total, int(mask.sum()), spans, kept
