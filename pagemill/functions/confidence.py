"""Confidence rules over words, tokens and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import is_blank


def word_confidence(words: Column) -> Column:
    """Mean of non-blank words' scores that aren't negative, as a share; null without any.

    words: array of (text, conf) with conf from 0 to 100, or -1 for no word.
    """
    kept = F.filter(words, lambda w: ~is_blank(w["text"]) & (w["conf"] >= 0))
    total = F.aggregate(kept, F.lit(0.0), lambda a, w: a + w["conf"])
    return F.when(F.size(kept) > 0, F.round(total / (F.size(kept) * 100.0), 4))


def sequence_confidence(scores: Column, sequence: Column, skip: Column) -> Column:
    """Mean softmax probability of the emitted tokens; 0 if all are skipped.

    scores: one array of logits per step; the sequence may be longer, the
    steps then belong to its end. skip: token numbers that don't count.
    """
    offset = F.size(sequence) - F.size(scores)

    def probability(step: Column, token: Column) -> Column:
        top = F.array_max(step)
        mass = F.aggregate(step, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return F.exp(F.get(step, token) - top) / mass

    taken = F.zip_with(scores, F.slice(sequence, offset + 1, F.size(scores)), lambda s, t: F.when(~F.array_contains(skip, t), probability(s, t)))
    kept = F.filter(taken, lambda p: p.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, p: a + p) / F.size(kept)).otherwise(F.lit(0.0))


def line_confidence(lines: Column) -> Column:
    """Mean confidence of non-blank lines of (text, confidence); 0 without any."""
    kept = F.filter(lines, lambda x: ~is_blank(x["text"]))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size(kept)).otherwise(F.lit(0.0))


def accepted_print(enabled: Column, usable: Column, confidence: Column) -> Column:
    """Whether a printed-page attempt replaces handwriting recognition."""
    return F.coalesce(enabled & usable & confidence.isNotNull(), F.lit(False))
