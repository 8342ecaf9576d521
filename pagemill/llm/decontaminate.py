"""Benchmark decontamination by typed templates, in DataFrame operations only.

A text's words are made canonical: punctuation at the ends goes, letters are
lowered, and numbers, units after numbers, and names become typed placeholders.
A name is a capitalised word that isn't one of OPENERS, wherever it stands, so that
neither the begin of a sentence nor what precedes a passage changes a template.

1. Windows of `window` template words are joined with the benchmark's distinct
   window hashes; what meets is a hit (document, place, hash), without an item.
2. An item must have `share` of its windows in a document, so one of its rarest
   few is among the hits.  Only these make candidates (document, item): a template
   that many items share doesn't pair every document with all of them.
3. Candidates get all their windows at all places.  Windows at one displacement are
   aligned, and their slots (the words behind the placeholders) are compared: each
   value of the item must become one value, and different names and units different
   ones; different numbers may become equal.  Consistent alignments count.

An item's windows are those with at least as many plain words as placeholders.
Items without any use all windows, and need the same values.  An item shorter than a
window is one window of its own length, and needs the same names (the same values, if
it is mostly placeholders).  Of under `least` words, it must be the whole text.

Windows of the benchmark are broadcast if they are at most `broadcast_rows` (counted
first), else shuffled.

Defined results: a null text has no words; rows with a null key are never
contaminated; repeated documents are judged alike, different texts under one key each
by itself; of repeated items the smallest id is named; an empty benchmark contaminates
nothing; columns other than the keys and texts aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.runtime import small_side, written

WINDOW = 8
#: Unit words that make a placeholder after a number, number words, and capitalised words that are no names.
UNITS = "mm cm m km ft yd mi mg g kg t oz lb lbs ml cl l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years % percent usd eur gbp dollar dollars euro euros pound pounds cent cents meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres inch inches foot feet mile miles mph kmh hz kb mb gb tb".split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
OPENERS = "a an the this that these those what which who whose why how when where if in on at of for to from with by and or but not is are was were do does did can could will would should has have had it he she they we you all each every some any no there then find given suppose let".split()
#: Placeholders of numbers, units and names; the value follows. No text word has the first character.
NUMBER, UNIT, NAME = "\x01n", "\x01u", "\x01p"
#: Each pattern begins with the cheapest test of a place, which most places fail. After the first, words are parted by blanks only.
_BREAK = r"[\x01\t-\r!?;\"()\[\]{}<>“”«»…]|[.,:]+(?![0-9])"
_NAME = r"(?=\p{Lu})(?<![^ ])(?!(?i:" + "|".join(OPENERS) + r")(?: |$))[^ ]+"
_NUMBER = r"(?=[$+\-0-9])(?<![^ ])[$+\-]?[0-9][0-9.,/:]*%?(?= |$)"
_UNIT = rf"({NUMBER}[^ ]+ +)({'|'.join(sorted(UNITS, key=len, reverse=True))})(?= |$)"


def words(text: Column) -> Column:
    """Canonical words: lower case, typed ones behind their placeholder; number words are typed by `_kind`."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), _BREAK, " ")
    for mark in "'‘’":
        out = F.replace(out, F.lit(mark), F.lit(""))
    for pattern, made in ((_NAME, f"{NAME}$0"), (_NUMBER, f"{NUMBER}$0"), (rf"(?i){_UNIT}", f"$1{UNIT}$2"), (" {2,}", " ")):
        out = F.regexp_replace(out, pattern, made)
    out = F.lower(F.btrim(out))
    return F.when(F.length(out) == 0, F.array().cast("array<string>")).otherwise(F.split(out, " "))


def _kind(word: Column) -> Column:
    """A word as its template has it."""
    return F.when(word.isin(NUMBER_WORDS), NUMBER).when(word.startswith("\x01"), F.left(word, F.lit(2))).otherwise(word)


def _slots(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: x.startswith("\x01") | x.isin(NUMBER_WORDS))


def _window_hashes(hashes: str, size: int) -> Column:
    """The hash of each window of `size` words, by its begin."""
    begins = F.slice(hashes, 1, F.greatest(F.size(hashes) - (size - 1), F.lit(0)))
    return F.transform(begins, lambda x, i: F.xxhash64(F.lit(size), x, *[F.get(hashes, i + k) for k in range(1, size)]))


def _kept_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, text): th tells apart different texts under one key."""
    body = F.col(text).cast("string")
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), text_hash(body).alias("th"), body.alias("text"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def benchmark_windows(items: DataFrame, window: int = WINDOW, share: float = 0.5, least: int = 4, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, q, size, h, slots, whole, rule, n_windows, rare): the windows of each distinct item, at all places.

    rule: 0 values may be others, 1 names must be the same, 2 all values must be. whole: matches whole texts only.
    rare: one of the few of which every contaminated document has one.
    """
    split = items.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item_id"), words(F.col(text).cast("string")).alias("w")).where(F.size("w") > 0)
    distinct = split.groupBy("w").agg(F.min("item_id").alias("item_id"))
    hashed = distinct.select("item_id", "w", F.transform("w", lambda x: F.xxhash64(_kind(x))).alias("hashes"))
    n = F.size("w")
    sized = [F.when(n == k, _window_hashes("hashes", k)) for k in range(1, window)]
    tall = hashed.select("item_id", "w", F.least(n, F.lit(window)).alias("size"), F.posexplode(F.coalesce(*sized, _window_hashes("hashes", window))).alias("q", "h"))
    told = tall.select("item_id", (F.col("q") + 1).alias("q"), "size", "h", _slots(F.slice("w", F.col("q") + 1, F.col("size"))).alias("slots"), n.alias("n"))
    loose = 2 * F.size("slots") <= F.col("size")
    per = Window.partitionBy("item_id")
    used = told.withColumn("loose", loose).withColumn("any", F.max("loose").over(per)).where("loose OR NOT any")
    rule = F.when(~F.col("loose") | (F.col("n") < least), 2).when(F.col("n") < window, 1).otherwise(0)
    counted = used.withColumns({"n_windows": F.count("*").over(per), "rule": rule, "whole": F.col("n") < least})
    sharing = counted.groupBy("h").agg(F.countDistinct("item_id").alias("sharing"))
    place = F.row_number().over(per.orderBy("sharing", "q"))
    out = counted.join(sharing, "h").withColumn("rare", place <= F.col("n_windows") - F.ceil(F.col("n_windows") * F.lit(share)) + 1)
    return out.select("item_id", "q", "size", "h", "slots", "whole", "rule", "n_windows", "rare")


def hits(docs: DataFrame, known: DataFrame, sizes: list[int], broadcast_rows: int) -> DataFrame:
    """(key, th, p, size, h, n) of the windows in docs (key, th, text) that the benchmark has too; n words in the text."""
    hashed = docs.select("key", "th", F.transform(words(F.col("text")), lambda x: F.xxhash64(_kind(x))).alias("hashes"))
    met = None
    for size in sizes:
        tall = hashed.select("key", "th", F.size("hashes").alias("n"), F.posexplode(_window_hashes("hashes", size)).alias("p", "h"))
        side = small_side(known.where(F.col("size") == size).select("h").distinct(), broadcast_rows)
        found = tall.join(side, "h").select("key", "th", (F.col("p") + 1).alias("p"), F.lit(size).alias("size"), "h", "n")
        met = found if met is None else met.unionByName(found)
    return met


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = 0.5, least: int = 4, broadcast_rows: int = 500_000, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, th, item_id, hits, n_windows, same_values) of each document and item that contaminates it."""
    known = written(benchmark_windows(items, window, share, least, item_key, item_text), "windows")
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect()) or [window]
    texts = _kept_texts(docs, key, text)
    met = written(hits(texts, known, sizes, broadcast_rows), "hits")
    rare = small_side(known.where("rare").select("h", "size", "item_id", "whole").distinct(), broadcast_rows)
    candidates = met.join(rare, ["h", "size"]).where("NOT whole OR n = size").select("key", "th", "item_id").distinct()
    pairs = candidates.join(small_side(known, broadcast_rows), "item_id").join(met.select("key", "th", "p", "size", "h"), ["key", "th", "size", "h"])
    which = ["key", "th", "item_id", "shift"]
    met_pairs = written(pairs.select("key", "th", "item_id", (F.col("p") - F.col("q")).alias("shift"), "p", "q", "size", "slots", "rule", "n_windows"), "pairs")

    # the values in the documents, at the places that met
    places = met_pairs.where(F.size("slots") > 0).select("key", "th", "p", "size").distinct().groupBy("key", "th").agg(F.collect_list(F.struct("p", "size")).alias("at"))
    some = texts.join(small_side(met_pairs.where(F.size("slots") > 0).select("key", "th").distinct()), ["key", "th"], "left_semi")
    # words are made below the join, once a text: above, they would be made once a place
    split = some.select("key", "th", words(F.col("text")).alias("w")).dropDuplicates(["key", "th"]).join(places, ["key", "th"]).select("key", "th", "w", F.explode("at").alias("at"))
    values = split.select("key", "th", "at.p", "at.size", _slots(F.slice("w", F.col("at.p"), F.col("at.size"))).alias("there"))
    zipped = met_pairs.join(values, ["key", "th", "p", "size"]).select(*which, "rule", F.explode(F.arrays_zip(F.col("slots").alias("a"), F.col("there").alias("b"))).alias("z")).select(*which, "rule", "z.a", "z.b").distinct()
    zipped = written(zipped, "values")
    apart = F.col("a").startswith(NAME) | F.col("a").startswith(UNIT)
    wrong = (F.col("a") != F.col("b")) & ((F.col("rule") == 2) | ((F.col("rule") == 1) & apart))
    by_a = zipped.groupBy(*which, "a").agg(F.countDistinct("b").alias("n"), F.min("b").alias("b"), F.max(wrong).alias("wrong"))
    forward = by_a.groupBy(*which).agg(F.max("n").alias("most"), F.max("wrong").alias("wrong"), F.count(F.when(apart, 1)).alias("n_a"), F.bool_and(F.col("a") == F.col("b")).alias("same"))
    backward = zipped.where(apart).groupBy(*which).agg(F.countDistinct("b").alias("n_b"))
    checked = forward.join(backward, which, "left").select(*which, ((F.col("most") == 1) & ~F.col("wrong") & (F.col("n_a") == F.coalesce("n_b", F.lit(0)))).alias("consistent"), "same")
    aligned = met_pairs.select(*which, "q", "n_windows").distinct().join(checked, which, "left").where("coalesce(consistent, true)")
    found = aligned.groupBy("key", "th", "item_id").agg(F.countDistinct("q").alias("hits"), F.max("n_windows").cast("long").alias("n_windows"), F.bool_and(F.coalesce("same", F.lit(True))).alias("same_values"))
    return found.where(F.col("hits") >= F.ceil(F.col("n_windows") * F.lit(share))).withColumnRenamed("key", key)


def flagged(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, contaminated, n_items, item_id, hits, same_values) per row of docs; item_id has the most hits, then the least id."""
    best = F.max_by(F.struct("item_id", "hits", "same_values"), F.struct("hits", (-F.col("item_id")).alias("i")))
    per = found.groupBy(key, "th").agg(F.count("*").alias("n_items"), best.alias("r"))
    joined = docs.select(F.col(key).cast("long").alias(key), text_hash(F.col(text).cast("string")).alias("th")).join(per, [key, "th"], "left")
    return joined.select(key, F.col("r").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "r.item_id", F.coalesce("r.hits", F.lit(0)).cast("long").alias("hits"), "r.same_values")


def clean(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, whatever their columns are called."""
    dirty = written(found.select(F.col(key).alias("_key"), F.col("th").alias("_th")).distinct(), "contaminated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{key}`").cast("long").alias("_key"), text_hash(F.col(f"`{text}`").cast("string")).alias("_th"))
    return rows.join(small_side(dirty), ["_key", "_th"], "left_anti").select("_row.*")
