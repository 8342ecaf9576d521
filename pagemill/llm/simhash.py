"""SimHash near-duplicate classes with pigeonring candidate filtering.

A document's 64-bit fingerprint takes the majority of its shingles' hash bits.
Fingerprints at most `limit` bits apart are linked; a class is a connected
component of links.  Equal fingerprints are merged first, so that copies never
meet each other again.

Candidates: the 64 bits form a ring of ``limit + 1`` segments.  If two
fingerprints differ in at most `limit` bits, then from some segment i on, for
every length l, the differences in segments i .. i+l-1 sum to at most
``l * limit / (limit + 1)`` (strong pigeonring form): none in the first, one in
the first two, two in the first three.  These three conditions make an equality key:
segment i as a whole, one of the two halves of segment i+1, since one differing bit
leaves a half unharmed, and one of the three thirds of segment i+2, since two leave a
third.  That is six keys of about 24 bits for each of the segments.  Within a key, all
chain lengths are tested, then the full distance.

Within a key's group, links are not listed: a breadth-first search over not yet
reached fingerprints makes a spanning forest, at most one edge per fingerprint.
Groups over `tile` fingerprints are split into blocks whose pairs go to
different tasks, so that no task holds an unbounded group.

Defined results: a null text counts as empty; a text without words has
fingerprint 0 and links like any other; fewer words than the shingle's make one
shingle; repeated rows give repeated result rows; rows with a null key keep
their fingerprint and have a null component.  Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.anchors import mix
from pagemill.llm.components import components
from pagemill.runtime import ship_package, small_side, written

SEED = 42
BLOCK = 1 << 16


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices, so that only few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        raw = b"".join([digest(data[a:z], SEED) for a, z in zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, shingle: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, th, fp): th is the text's hash, fp the fingerprint as a signed long."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = [fingerprint(x, shingle) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], ["key", "th", "fp"])

    chosen = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), text_hash(F.col(text)).alias("th"))
    return chosen.mapInArrow(run, "key long, th long, fp long").withColumnRenamed("key", key)


def ring(limit: int) -> list[tuple[int, int]]:
    """(shift, width) of the limit + 1 segments, from the lowest bit."""
    count = limit + 1
    edges = [round(64 * i / count) for i in range(count + 1)]
    return [(a, z - a) for a, z in zip(edges, edges[1:])]


def _mask(shift: int, width: int) -> int:
    return ((1 << width) - 1) << shift


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def key_masks(limit: int) -> list[tuple[int, int]]:
    """(first segment, mask of the key's bits): a part of each of the two next segments, for each segment."""
    parts, out = ring(limit), []
    for i, (shift, width) in enumerate(parts):
        masks = [_mask(shift, width)]
        for ahead in range(1, min(3, limit)):
            # at most `ahead` bits differ in the first ahead + 1 segments, so one of ahead + 1 pieces is unharmed
            start, size = parts[(i + ahead) % len(parts)]
            edges = [start + round(size * k / (ahead + 1)) for k in range(ahead + 2)]
            masks = [m | _mask(a, z - a) for m in masks for a, z in zip(edges, edges[1:])]
        out += [(i, m) for m in masks]
    return out


def chain_masks(limit: int, first: int) -> list[tuple[int, int]]:
    """(mask of segments first .. first+l-1, differences allowed in it) for l = 2 .. limit."""
    parts, count = ring(limit), limit + 1
    out = []
    for l in range(2, count):
        mask = 0
        for j in range(l):
            mask |= _mask(*parts[(first + j) % count])
        out.append((mask, l * limit // count))
    return out


def _forest(fps: np.ndarray, block: np.ndarray, first: int, limit: int, across: bool) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among fps (of different blocks only, if `across`)."""
    chains = [(np.uint64(m), n) for m, n in chain_masks(limit, first)]
    left = np.arange(len(fps))
    edges: list[tuple[int, int]] = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            differ = fps[left] ^ fps[at]
            near = np.ones(len(left), bool) if not across else block[left] != block[at]
            for mask, most in chains:
                near &= np.bitwise_count(differ & mask) <= most
            near &= np.bitwise_count(differ) <= limit
            if near.any():
                found = left[near]
                edges += [(at, x) for x in found]
                queue += found.tolist()
                left = left[~near]
    return edges


def _search(limit: int):
    masks = key_masks(limit)

    def emit(group: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        kind, tile, fps, reps, block = (np.concatenate(x) for x in zip(*group)) if len(group) > 1 else group[0]
        edges = _forest(fps.view(np.uint64), block, masks[int(kind[0])][0], limit, bool(tile[0] >= 0 and len(np.unique(block)) > 1))
        if edges:
            u, v = np.array(edges).T
            yield pa.RecordBatch.from_arrays([pa.array(reps[u]), pa.array(reps[v])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, part, tile, fps, reps, block = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            change = (kind[1:] != kind[:-1]) | (part[1:] != part[:-1]) | (tile[1:] != tile[:-1])
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(kind)]])
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                name = (kind[a], part[a], tile[a])
                if name != last and held:
                    yield from emit(held)
                    held = []
                last = name
                held.append((kind[a:z], tile[a:z], fps[a:z], reps[a:z], block[a:z]))
        if held:
            yield from emit(held)

    return run


def in_shared_groups(rows: DataFrame) -> DataFrame:
    """Rows (kind, part, ...) of groups of two or more, with the group's size n.

    Spark takes exploded rows to be as few as those of the file they come from and
    would send them all to the driver, so that the join's kind is stated.
    """
    shared = written(rows.groupBy("kind", "part").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    return rows.join(small_side(shared, otherwise="merge"), ["kind", "part"])


def links(distinct: DataFrame, limit: int = 4, tile: int = 20_000) -> DataFrame:
    """Spanning edges (u, v) between representatives, from distinct (fp, rep)."""
    ship_package(distinct.sparkSession)
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for k, (_, m) in enumerate(key_masks(limit))])
    rows = distinct.select("fp", "rep", F.explode(keys).alias("k")).select("k.kind", "k.part", "fp", "rep")
    blocks = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int")
    met = in_shared_groups(rows).withColumn("blocks", blocks).withColumn("block", mine)
    # a group of one block is tile -1; else each pair of blocks (and each block itself) is a tile
    tiles = F.when(F.col("blocks") == 1, F.array(F.lit(-1))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.least(b, F.col("block")) * F.col("blocks") + F.greatest(b, F.col("block")))
    )
    dealt = met.select("kind", "part", F.explode(tiles).alias("tile"), "fp", "rep", "block")
    sorted_groups = dealt.repartition("kind", "part", "tile").sortWithinPartitions("kind", "part", "tile")
    return sorted_groups.mapInArrow(_search(limit), "u long, v long")


def near_duplicates(df: DataFrame, shingle: int = 5, limit: int = 4, tile: int = 20_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, th, fp, class, component): class is the least fingerprint that is reachable over links, component the smallest key.

    th is the hash of the row's text. Fingerprints are the nodes, so that different
    texts under one key don't join their classes.
    """
    prints = written(fingerprints(df, shingle, text, key).withColumnRenamed(key, "key"), "fingerprints")
    distinct = written(prints.where("key IS NOT NULL").groupBy("fp").agg(F.min("key").alias("lead")), "distinct")
    merged = components(links(distinct.select("fp", F.col("fp").alias("rep")), limit, tile)).select(F.col("node").alias("fp"), F.col("component").alias("class"))
    # joins are merges: each of these tables grows with the corpus, and none may go to the driver
    met = written(distinct.join(merged.hint("merge"), "fp"), "linked")
    least = met.groupBy("class").agg(F.min("lead").alias("component"))
    joined = met.select("fp", "class").join(least.hint("merge"), "class")
    named = distinct.join(joined.hint("merge"), "fp", "left").select("fp", F.coalesce("class", "fp").alias("class"), F.coalesce("component", "lead").alias("component"))
    mine = lambda c: F.when(F.col("key").isNotNull(), F.col(c)).alias(c)
    out = prints.join(named.hint("merge"), "fp", "left").select("key", "th", "fp", mine("class"), mine("component"))
    return out.withColumnRenamed("key", key)


def hexadecimal(column: str) -> Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


# Classes by similarity: texts whose sets of shingles have a Jaccard similarity of `similarity` or more are linked.
#
# Whether two texts are linked is decided on their whole sets of shingles; sketches only find who is to be compared.
# A sketch is the least shingle under each of BANDS * ROWS orders. Texts that agree in a whole band and in at least
# LOOSE of all orders go to one candidate class. Candidate classes are then searched exactly, by the rarest shingles
# in the class (prefix filter). A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 3) ** 20, 6 in
# 10 million, and falls under LOOSE with one of about 1 in 10 million.

BANDS, ROWS, ORDER_BYTES = 20, 3, 2
ORDERS = BANDS * ROWS
LOOSE = ORDERS // 2
#: Shingles of a candidate class from which its texts are dealt in blocks to several tasks.
BLOCK_SHINGLES = 2_000_000
_MULTIPLIERS = mix(np.arange(1, ORDERS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; words as in fingerprint."""
    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    data = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(parts))
    starts, ends = starts[: len(parts) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(data[a:z], SEED) for a, z in zip(starts, ends)), np.uint64, len(starts)))


def sketch(shingles: np.ndarray) -> bytes:
    """The low bytes of the least shingle under each order."""
    least = np.full(ORDERS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            np.minimum(least, (shingles[at : at + 4096, None] * _MULTIPLIERS[None, :]).min(axis=0), out=least)
    return least.astype(np.uint16).tobytes()


def sketches(df: DataFrame, shingle: int, text: str, key: str) -> DataFrame:
    """(key, th, fp, n, sketch): th is the text's hash, fp a digest of the set of shingles, n its size."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [shingle_set(x, shingle) for x in batch.column(1).to_pylist()]
            columns = [pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["key", "th", "fp", "n", "sketch"])

    chosen = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), text_hash(F.col(text)).alias("th"))
    return chosen.mapInArrow(run, "key long, th long, fp binary, n long, sketch binary")


def _groups(batches: Iterator[pa.RecordBatch], names: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in their first `names` (whole-number) columns, if of two rows or more."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(names)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
        # single rows inside of a batch are groups of one
        wanted = np.diff(cuts) > 1
        wanted[[0, -1]] = True
        for g in np.flatnonzero(wanted).tolist():
            a, z = int(cuts[g]), int(cuts[g + 1])
            name = tuple(c[a] for c in columns)
            if name != last:
                if sum(b.num_rows for b in held) > 1:
                    yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = name
            held.append(batch.slice(a, z - a))
    if sum(b.num_rows for b in held) > 1:
        yield pa.Table.from_batches(held).combine_chunks()


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _loose_forest(prints: np.ndarray, block: np.ndarray, across: bool) -> list[tuple[int, int]]:
    """Spanning edges among rows of sketches that agree in LOOSE orders."""
    left = np.arange(len(prints))
    edges: list[tuple[int, int]] = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = (prints[left] == prints[at]).sum(axis=1) >= LOOSE
            if across:
                near &= block[left] != block[at]
            if near.any():
                found = left[near].tolist()
                edges += [(at, x) for x in found]
                queue += found
                left = left[~near]
    return edges


def candidate_links(distinct: DataFrame, tile: int = 20_000) -> DataFrame:
    """Spanning edges (u, v) of the candidate classes, from distinct (rep, sketch)."""
    ship_package(distinct.sparkSession)
    width = ROWS * ORDER_BYTES
    number = lambda k: F.conv(F.hex(F.substring("sketch", k * width + 1, width)), 16, 10).cast("long")
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), number(k).alias("part")) for k in range(BANDS)])
    rows = distinct.select("rep", "sketch", F.explode(keys).alias("k")).select("k.kind", "k.part", "rep", "sketch")
    blocks = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    met = in_shared_groups(rows).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = met.select("kind", "part", F.explode(_tiles()).alias("tile"), "rep", "sketch", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            reps, block = group.column(3).to_numpy(), group.column(5).to_numpy()
            prints = np.frombuffer(b"".join(group.column(4).to_pylist()), np.uint16).reshape(len(reps), ORDERS)
            edges = _loose_forest(prints, block, bool(group.column(2)[0].as_py() >= 0 and len(np.unique(block)) > 1))
            if edges:
                u, v = np.array(edges).T
                yield _edges(reps[u], reps[v])

    return dealt.repartition("kind", "part", "tile").sortWithinPartitions("kind", "part", "tile").mapInArrow(run, "u long, v long")


def _tiles() -> Column:
    """Tiles of a row of `block` among `blocks`: -1 for a group of one block; else one for each pair of blocks, itself included."""
    pair = lambda b: F.least(b, F.col("block")) * F.col("blocks") + F.greatest(b, F.col("block"))
    return F.when(F.col("blocks") == 1, F.array(F.lit(-1))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))


def similar_pairs(sets: list[np.ndarray], block: np.ndarray, across: bool, similarity: float) -> list[tuple[int, int]]:
    """Spanning edges of the pairs of sets of Jaccard similarity `similarity` or more (of different blocks only, if `across`).

    Two such sets share one of the rarest n - ceil(similarity * n) + 1 elements
    of each, by any order common to both.
    """
    size = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), size)
    names, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(names))
    order = np.lexsort((rank[place], of))
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    prefix = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    kept = order[np.arange(len(order)) - first[of] < prefix[of]]
    kept = kept[count[place[kept]] > 1]
    kept = kept[np.argsort(place[kept], kind="stable")]
    parent = np.arange(len(sets))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    edges, tested = [], set()
    cuts = np.flatnonzero(np.diff(place[kept])) + 1
    for posting in np.split(of[kept], cuts):
        left = posting.tolist()
        while len(left) > 1 and len({root(x) for x in left}) > 1:
            at = left.pop()
            for x in left:
                pair = (x, at) if x < at else (at, x)
                if (across and block[x] == block[at]) or pair in tested or root(x) == root(at):
                    continue
                tested.add(pair)
                if min(size[x], size[at]) < similarity * max(size[x], size[at]) - 1e-9:
                    continue
                shared = len(np.intersect1d(sets[x], sets[at], assume_unique=True))
                if shared >= similarity * (size[x] + size[at] - shared) - 1e-9:
                    parent[root(at)] = root(x)
                    edges.append(pair)
    return edges


def exact_links(df: DataFrame, members: DataFrame, shingle: int, similarity: float, tile: int, text: str, key: str) -> DataFrame:
    """Spanning edges (u, v) within candidate classes, from members (rep, lead, fp, n, candidate)."""
    ship_package(df.sparkSession)
    texts = df.select(F.col(key).cast("long").alias("lead"), F.col(text).cast("string").alias("text"))
    size = members.groupBy("candidate").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("rows") / F.lit(tile), F.col("shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    placed = members.join(size, "candidate").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = placed.select("rep", "fp", "candidate", F.explode(_tiles()).alias("tile"), "block")
    found = texts.join(placed.select("lead", "rep", "fp"), "lead").select("rep", "text", "fp")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [(i, f, s.tobytes()) for i, (t, f) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())) if xxhash.xxh128_digest((s := shingle_set(t, shingle)).tobytes()) == f]
            at = pa.array([i for i, _, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)]], ["rep", "fp", "shingles"])

    # rows of the same id with other texts have other sets; repeated rows are one
    sets = found.mapInArrow(hashed, "rep long, fp binary, shingles binary").dropDuplicates(["rep", "fp"])
    grouped = sets.join(dealt, ["rep", "fp"]).select("candidate", "tile", "rep", "shingles", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            reps, block = group.column(2).to_numpy(), group.column(4).to_numpy()
            held = [np.frombuffer(x, np.uint64) for x in group.column(3).to_pylist()]
            edges = similar_pairs(held, block, bool(group.column(1)[0].as_py() >= 0 and len(np.unique(block)) > 1), similarity)
            if edges:
                u, v = np.array(edges).T
                yield _edges(reps[u], reps[v])

    return grouped.repartition("candidate", "tile").sortWithinPartitions("candidate", "tile").mapInArrow(run, "u long, v long")


def similar_documents(df: DataFrame, shingle: int = 5, similarity: float = 0.8, tile: int = 20_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, th, class, component): classes of the links between texts of Jaccard similarity `similarity` or more.

    th is the hash of the row's text, component the smallest key of the class. Texts
    with the same set of shingles are one; texts without words have the empty set.
    Different texts under one key are different documents. Other edge cases are as in
    near_duplicates.
    """
    prints = written(sketches(df, shingle, text, key), "fingerprints")
    merged = prints.where("key IS NOT NULL").groupBy("fp").agg(F.min("key").alias("lead"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # numbers of the distinct sets: made on a written table and written, so that they stay
    distinct = written(written(merged, "merged").withColumn("rep", F.monotonically_increasing_id()), "distinct")
    candidates = components(candidate_links(distinct, tile)).withColumnRenamed("component", "candidate")
    members = written(distinct.select("fp", "rep", "lead", "n").join(candidates, distinct["rep"] == candidates["node"]).select("rep", "lead", "fp", "n", "candidate"), "members")
    linked = components(exact_links(df, members, shingle, similarity, tile, text, key)).withColumnRenamed("component", "class")
    named = written(distinct.join(linked, distinct["rep"] == linked["node"], "left").select("fp", "lead", F.coalesce("class", "rep").alias("class")), "named")
    least = named.groupBy("class").agg(F.min("lead").alias("component"))
    out = prints.where("key IS NOT NULL").select("key", "th", "fp").join(named.join(least, "class").select("fp", "class", "component"), "fp").select("key", "th", "class", "component")
    none = prints.where("key IS NULL").select("key", "th", F.lit(None).cast("long").alias("class"), F.lit(None).cast("long").alias("component"))
    return out.unionByName(none).withColumnRenamed("key", key)


def one_of_each(df: DataFrame, classes: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of each class the rows' text of least key (and, of these, least hash), once; rows with a null key stay."""
    first = written(classes.where(F.col(key).isNotNull()).groupBy("class").agg(F.min(F.struct(key, "th")).alias("r")).select(F.col(f"r.{key}").alias("_key"), F.col("r.th").alias("_th")), "first")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{key}`").cast("long").alias("_key"), text_hash(F.col(f"`{text}`")).alias("_th"))
    kept = rows.where("_key IS NOT NULL").join(first, ["_key", "_th"], "left_semi").dropDuplicates(["_key", "_th"])
    return kept.unionByName(rows.where("_key IS NULL")).select("_row.*")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
