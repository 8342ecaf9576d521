"""Character and word error rates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pagemill.functions import text as T
from pagemill.operators.distance import edit_distances


def evaluated_form(text: Column) -> Column:
    """Lower case, white space as single blanks."""
    return T.strip(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"{T.SPACE}+", " "))


@F.arrow_udf(DoubleType())
def _character_rates(truth: pa.Array, hypothesis: pa.Array) -> pa.Array:
    a, b = truth.to_pylist(), hypothesis.to_pylist()
    return pa.array(edit_distances(a, b) / np.array([max(1, len(x)) for x in a]), pa.float64())


def character_error(truth: Column, hypothesis: Column) -> Column:
    """Edit distance over the truth's length; the session has to have the package shipped."""
    return _character_rates(evaluated_form(truth), evaluated_form(hypothesis))


def word_error(truth: Column, hypothesis: Column) -> Column:
    """Edit distance of words: each distinct word of the pair becomes one character first."""
    words = lambda c: F.filter(F.split(evaluated_form(c), " "), lambda w: F.length(w) > 0)
    a, b = words(truth), words(hypothesis)
    once = lambda value, step: F.get(F.transform(F.array(value), step), F.lit(0))
    # characters from U+10000 on stand for the words: a million of them, none a surrogate
    letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(n + 0x10000), 8, "0")), "UTF-32")
    coded = lambda ws, known: F.array_join(F.transform(ws, lambda w: letter(F.array_position(known, w))), "")
    pair = F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("known"))
    return once(pair, lambda p: F.levenshtein(coded(p["a"], p["known"]), coded(p["b"], p["known"])) / F.greatest(F.lit(1), F.size(p["a"])))
