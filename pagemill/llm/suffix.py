"""Removal of byte strings that occur more than once, by distributed prefix doubling.

Spark ranks positions by the text that starts there, at lengths that double from `gram`
and then close in on `length` (64, 128, 164, 200).  At each length, rows of (name of the position,
content of its run of windows) are shuffled and sorted by name; what is unique or
wholly equal is settled and leaves, and only the rest goes to the next length.  There
a position's name is the name of the pair of the names at the position and at the
position plus the offset that is added, as in prefix doubling over a suffix array;
names are 64-bit fingerprints of the pair, since only their equality is asked for.

Plain doubling over every byte would shuffle at least 16 bytes for each byte of text
and round; so the ranked positions are content-defined anchors (`repeats.py`), about
one byte in 68 at the first length and every byte of what is still open at the last.
The result is the same as over all positions.  All that is contested goes through all
lengths, whatever the size of its group: rows of a large group are shuffled by name and
content, and never gathered in a task.

Defined results: a null text is empty; matches never cross documents; texts shorter
than `length` are kept; repeated rows are repeats like any other, and each gets the same
result; different texts under one id are different documents; a row with a null key is
kept whole and takes no part; an empty table gives one.  Only key and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import repeats as R
from pagemill.runtime import scratch, written


def levels(gram: int, length: int) -> tuple[int, ...]:
    """gram, doubled while that stays below the window length; then half of what is missing, then the length."""
    out = [min(gram, length)]
    while out[-1] < length:
        missing = length - out[-1]
        out.append(2 * out[-1] if out[-1] < missing else length if missing <= length // 5 else out[-1] + -(-missing // 2))
    return tuple(out)


def remove_repeats(df: DataFrame, length: int = 200, gram: int = 64, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): kept has the bytes in no repeated window."""
    units = R.Units(words=False, length=length, grams=levels(gram, length), ordered=False)
    docs = R.keyed(df, text, key)
    with scratch(df.sparkSession):
        covered, contested = _first_length(units, docs)
        covered = covered.union(R.settle_by_ranks(units, contested, docs))
        out = R.apply_cover(units, docs, covered)
    return out.withColumnsRenamed({"key": key, "n_units": "n_bytes"})


def _first_length(units: R.Units, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(covered, contested) runs, written, of all positions at the first length; tables go as soon as the next one is written."""
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):
            rows = written(R.run_rows(docs, units).withColumns({"ord": F.lit(0).cast("long"), "need": F.lit(True), "copies": F.lit(1)}), "positions")
            met = written(R.meet(units, rows, written(R.repeated(units, R.anchor_totals(rows, ordered=False)), "anchors")), "met", result=True)
        covered, contested = R.judge(units, met)
        return written(covered, "covered", result=True), written(contested, "contested", result=True)
