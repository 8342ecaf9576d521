"""Quality rules with robust multivariate outlier rejection, in DataFrame operations only.

Base rules are counts over the whole text.  Documents that pass them are described by
a vector of transformed statistics, in whole numbers of 1 / SCALE.  For each language
and source, each language, and all together, a minimum-covariance-determinant estimate
of centre and scatter is found:

* from four starts (medians and median deviations; covariance of tanh-transformed, of
  spatial-sign-transformed and of plain vectors), concentration steps take the `share`
  of documents of least distance and estimate from them anew, until the determinant
  falls no further; of the four, that of least determinant counts;
* its scatter is multiplied by the factor that makes it consistent for normal data.

An estimate of n documents is then drawn towards its parent's (source to language to
all) with weight n / (n + `prior`), whatever n is.  A document is kept if its squared
Mahalanobis distance is at most the chi-square quantile at `quantile` with as many
degrees as statistics (19.998 at the default 0.9995 with four).

`floor`, squared, is added to each variance, in the determinant too, so that a group of
near-constant values doesn't reject small deviations.

Equal vectors are counted first, so that steps run over distinct vectors, not documents.
Sums are exact, and the subset's border is found on a fixed grid of distances (GRID steps
for each factor e): documents in the border's step all count.  So the outcome depends
neither on partitions nor on the order of rows, and no group is ever gathered.

Defined results: a null text has no words and fails the base rules; null language or
source is a group of its own; repeated rows give repeated results; a null key is
carried; an empty table gives one, and one without documents that pass rejects all;
very long texts are like any other; other columns aren't looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.runtime import scratch, small_side, written

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
SCALE = 1000
#: Distances are ranked on a grid of this many steps for each factor e.
GRID = 500
FEATURES = ("x0", "x1", "x2", "x3")
D = len(FEATURES)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def _without(text: Column, letters: str) -> Column:
    for letter in letters:
        text = F.replace(text, F.lit(letter), F.lit(""))
    return text


def _repeated_words(words: Column) -> Column:
    """Words that stand in an 8-word window found twice or more in the array.

    Windows are compared by hash.  Only where an array has repeats at all,
    hashes are sorted with their places to find them, and the places in
    order give the number of words covered.
    """
    count = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), count - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(count < 2 * 1 + WINDOW - 1, F.lit(0)).otherwise(
        F.aggregate(
            F.array(hashes),
            F.lit(0).cast("int"),
            lambda _, h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered_words(h)),
        )
    )


def _covered_words(hashes: Column) -> Column:
    """Words in windows whose hash occurs more than once, windows numbered from 0."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(p: Column) -> Column:
        last = F.size(p) - 1
        same = lambda i, j: F.get(p, i)["h"] == F.get(p, j)["h"]
        kept = F.filter(p, lambda x, i: ((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1)))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def length(at: Column) -> Column:
        last = F.size(at) - 1
        own = F.transform(at, lambda x, i: F.when(i == last, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(at, i + 1) - x)))
        return F.aggregate(own, F.lit(0), lambda a, b: a + b)

    # each step is bound once: an array of one element, and a lambda over it
    once = lambda value, step: F.get(F.transform(F.array(value), step), F.lit(0))
    return once(once(placed, places), length)


def base_statistics(df: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    chosen = df.select(F.col(key).cast("long").alias("key"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SEPARATORS}]"))
    split = chosen.withColumns({"w": F.filter(F.split("t", f"[{SEPARATORS}]+"), lambda x: x != ""), "l": lines})
    counted = split.select(
        "key",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(_without(F.col("t"), SEPARATORS)).cast("long").alias("word_chars"),
        (F.octet_length("t") - F.octet_length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed statistics as whole numbers of 1 / SCALE.

    Logarithms of the mean word length and of symbols per hundred characters,
    and the shares of repeated lines and words as square roots.
    """
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    whole = lambda x: F.round(x * SCALE).cast("long")
    return stats.withColumns(
        {
            "x0": whole(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n)),
            "x1": whole(F.log1p(100.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)))),
            "x2": whole(F.sqrt(F.col("n_dup_lines") / n)),
            "x3": whole(F.sqrt(F.col("n_repeat_words") / n)),
        }
    )


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(degrees // 2))


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


def consistency(share: float) -> float:
    """What the covariance of the central share of normal data must be multiplied by."""
    return share / chi_square(chi_square_quantile(share, D), D + 2) if share < 1 else 1.0


def _sums(names: tuple[str, ...] | list[str], weight: str = "w") -> list[Column]:
    """n, s*, p**: weighted count, sums and products; exact, as all are whole numbers."""
    w = F.col(weight)
    return [F.sum(w).alias("n"), *[F.sum(w * F.col(x)).alias(f"s{i}") for i, x in enumerate(names)], *[F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"p{i}{j}") for i, j in PAIRS]]


def _with_covariance(sums: DataFrame) -> DataFrame:
    """sums with m*, c**: mean and covariance."""
    out = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(D)})
    return out.withColumns({f"c{i}{j}": F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in PAIRS})


def _with_factor(rows: DataFrame, floor: float) -> DataFrame:
    """rows (m*, c**) with l**, the Cholesky factor of c plus the floor's square, and its logdet."""
    out = rows
    for i, j in PAIRS:
        value = F.col(f"c{i}{j}") if i != j else F.greatest(F.col(f"c{i}{j}"), F.lit(0.0)) + (floor * SCALE) ** 2
        for k in range(j):
            value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1.0))) if i == j else value / F.col(f"l{j}{j}"))
    return out.withColumn("logdet", 2 * sum((F.log(f"l{i}{i}") for i in range(1, D)), F.log("l00")))


ESTIMATE = [f"m{i}" for i in range(D)] + [f"c{i}{j}" for i, j in PAIRS] + [f"l{i}{j}" for i, j in PAIRS] + ["logdet"]


def _with_distance(rows: DataFrame) -> DataFrame:
    """rows (x*, m*, l**) with the squared Mahalanobis distance d2."""
    out = rows
    for i in range(D):
        value = F.col(FEATURES[i]) - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", value / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, D)), F.col("y0") * F.col("y0"))).drop(*[f"y{i}" for i in range(D)])


def _median(rows: DataFrame, value: str) -> DataFrame:
    """Per g and i the least value that at least half of the weight w doesn't exceed.

    Windows run over the distinct values, whose number has a bound: they are on a grid.
    """
    counts = rows.groupBy("g", "i", value).agg(F.sum("w").alias("n"))
    per = Window.partitionBy("g", "i")
    ranked = counts.withColumns({"c": F.sum("n").over(per.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "t": F.sum("n").over(per)})
    return ranked.where(2 * F.col("c") >= F.col("t")).groupBy("g", "i").agg(F.min(value).alias("q"))


def _starts(cells: DataFrame, floor: float) -> DataFrame:
    """(g, k, m*, c**) of the four starts."""
    tall = cells.select("g", "w", F.posexplode(F.array(*FEATURES)).alias("i", "x"))
    centre = written(_median(tall, "x"), "centre")
    off = tall.join(small_side(centre.withColumnRenamed("q", "c")), ["g", "i"]).select("g", "i", "w", F.abs(F.col("x") - F.col("c")).alias("x"))
    both = centre.join(_median(off, "x").withColumnRenamed("q", "mad"), ["g", "i"])
    pick = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c))).cast("double")
    deviation = lambda i: F.sqrt(F.pow(pick(i, "mad") * 1.4826, F.lit(2.0)) + (floor * SCALE) ** 2)
    flat = written(both.groupBy("g").agg(*[pick(i, "q").alias(f"q{i}") for i in range(D)], *[deviation(i).alias(f"d{i}") for i in range(D)]), "scales")
    placed = cells.join(small_side(flat), "g")
    whole = lambda x: F.round(x * SCALE).cast("long")
    z = [(F.col(FEATURES[i]) - F.col(f"q{i}")) / F.col(f"d{i}") for i in range(D)]
    radius = F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0]))
    bent = {f"t{i}": whole(F.tanh(z[i])) for i in range(D)} | {f"u{i}": F.coalesce(whole(F.try_divide(z[i], radius)), F.lit(0).cast("long")) for i in range(D)}
    placed = placed.withColumns(bent)
    scales = ["g", *[f"q{i}" for i in range(D)], *[f"d{i}" for i in range(D)]]

    def of(kind: int, letter: str) -> DataFrame:
        """A start from the covariance of bent vectors, drawn out by the deviations again."""
        sums = _with_covariance(placed.groupBy(*scales).agg(*_sums([f"{letter}{i}" for i in range(D)])))
        return sums.select("g", F.lit(kind).alias("k"), *[F.col(f"q{i}").alias(f"m{i}") for i in range(D)], *[(F.col(f"c{i}{j}") * F.col(f"d{i}") * F.col(f"d{j}") / SCALE**2).alias(f"c{i}{j}") for i, j in PAIRS])

    plain = _with_covariance(cells.groupBy("g").agg(*_sums(FEATURES))).select("g", F.lit(3).alias("k"), *ESTIMATE[: D + len(PAIRS)])
    diagonal = flat.select("g", F.lit(0).alias("k"), *[F.col(f"q{i}").alias(f"m{i}") for i in range(D)], *[(F.col(f"d{i}") * F.col(f"d{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS])
    return diagonal.unionByName(of(1, "t")).unionByName(of(2, "u")).unionByName(plain)


def _concentrate(cells: DataFrame, now: DataFrame, share: float, floor: float) -> DataFrame:
    """(g, k, ESTIMATE) from the share of documents of least distance from each estimate.

    Sums are taken for each step of the distance grid, then added up from the least to the border.
    """
    far = _with_distance(cells.join(small_side(now, 50_000), "g")).withColumn("b", F.floor(F.log1p("d2") * GRID).cast("int"))
    binned = far.groupBy("g", "k", "b").agg(*_sums(FEATURES))
    per = Window.partitionBy("g", "k")
    sofar = per.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    summed = ["n", *[f"s{i}" for i in range(D)], *[f"p{i}{j}" for i, j in PAIRS]]
    added = binned.select("g", "k", "b", *[F.sum(c).over(sofar).alias(c) for c in summed], F.sum("n").over(per).alias("total"))
    enough = added.where(F.col("n") >= F.ceil(F.col("total") * F.lit(share)))
    border = enough.groupBy("g", "k").agg(F.min_by(F.struct(*summed), "b").alias("r")).select("g", "k", "r.*")
    return _with_factor(_with_covariance(border), floor).select("g", "k", *ESTIMATE)


def estimates(cells: DataFrame, share: float = 0.75, floor: float = 0.15, steps: int = 50) -> DataFrame:
    """(g, ESTIMATE) of least determinant for each g of cells (g, x*, w); at most `steps` steps, many more than are ever needed."""
    first = _with_factor(_starts(cells, floor), floor).select("g", "k", *ESTIMATE)
    now = written(first.withColumn("logdet", F.lit(float("inf"))), "estimate")
    finished = []
    for _ in range(steps):
        new = _concentrate(cells, now, share, floor).withColumnsRenamed({c: f"_{c}" for c in ESTIMATE})
        better = F.col("_logdet") < F.col("logdet") - 1e-9
        both = now.join(new, ["g", "k"]).select("g", "k", better.alias("better"), *[F.when(better, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ESTIMATE])
        both = written(both, "estimate")
        finished.append(both.where("NOT better").drop("better"))
        now = both.where("better").drop("better")
        if now.isEmpty():
            break
    out = now
    for part in finished:
        out = out.unionByName(part)
    return out.groupBy("g").agg(F.min_by(F.struct(*ESTIMATE), F.struct("logdet", "k")).alias("r")).select("g", "r.*")


def _drawn(child: str, parent: str, n: Column, prior: float) -> dict[str, Column]:
    """Mean and covariance of a mixture of child and parent, with weights n and prior."""
    w = n / (n + F.lit(float(prior)))
    c = lambda side, name: F.col(f"{side}_{name}")
    mean = {f"m{i}": w * c(child, f"m{i}") + (1 - w) * c(parent, f"m{i}") for i in range(D)}
    apart = lambda i: c(child, f"m{i}") - c(parent, f"m{i}")
    return mean | {f"c{i}{j}": w * c(child, f"c{i}{j}") + (1 - w) * c(parent, f"c{i}{j}") + w * (1 - w) * apart(i) * apart(j) for i, j in PAIRS}


def judged(df: DataFrame, share: float = 0.75, floor: float = 0.15, quantile: float = 0.9995, prior: float = 50.0, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """base_statistics and kept, d2 (null for documents that fail the base rules)."""
    stats = written(vectors(base_statistics(df, text, key, lang, source)), "statistics", result=True)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    named = stats.withColumns({"a": F.concat(F.lit("s"), name("lang"), F.lit("\x00"), name("source")), "b": F.concat(F.lit("l"), name("lang"))})
    with scratch(df.sparkSession):
        groups = written(final_estimates(named.where("NOT base_failed"), share, floor, prior), "groups", result=True)
    placed = named.join(small_side(groups, 50_000), "a", "left")
    kept = F.when(~F.col("base_failed"), F.col("d2"))
    cutoff = chi_square_quantile(quantile, D)
    out = _with_distance(placed).select("key", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("d2"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= cutoff)).withColumn("kept", F.coalesce("kept", F.lit(False))).withColumnRenamed("key", key)


def final_estimates(passed: DataFrame, share: float, floor: float, prior: float) -> DataFrame:
    """(a, m*, l**) for each language and source a, consistent and drawn towards its parents."""
    # a document counts in its source's, its language's and the whole table's estimate
    cells = written(passed.select(*FEATURES, F.explode(F.array("a", "b", F.lit("all"))).alias("g")).groupBy("g", *FEATURES).agg(F.count("*").alias("w")), "cells")
    values = ESTIMATE[: D + len(PAIRS)]
    raw = estimates(cells, share, floor).select("g", *[f"m{i}" for i in range(D)], *[(F.col(f"c{i}{j}") * consistency(share)).alias(f"c{i}{j}") for i, j in PAIRS])
    own = written(raw.join(cells.groupBy("g").agg(F.sum("w").alias("n")), "g"), "own")
    side = lambda prefix: own.select(F.col("g").alias(f"{prefix}_g"), F.col("n").alias(f"{prefix}_n"), *[F.col(c).alias(f"{prefix}_{c}") for c in values])
    pairs = written(passed.select("a", "b").distinct(), "pairs")
    langs = pairs.select("b").distinct().withColumn("t", F.lit("all")).join(side("l"), F.col("b") == F.col("l_g")).join(side("t"), F.col("t") == F.col("t_g"))
    langs = langs.select("b", *[v.alias(f"p_{c}") for c, v in _drawn("l", "t", F.col("l_n"), prior).items()])
    sources = pairs.join(written(langs, "languages"), "b").join(side("s"), F.col("a") == F.col("s_g"))
    drawn = sources.select("a", *[v.alias(c) for c, v in _drawn("s", "p", F.col("s_n"), prior).items()])
    return _with_factor(drawn, floor).select("a", *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in PAIRS])
