"""Rule-based assertions of spans: historical, negated, family; by the line that a span stands in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import ASSERTION_TYPES, ASSERTIONS, FLAGS, Lexicon

BEFORE, AFTER = 100, 40


def negated(window: Column, lexicon: Lexicon) -> Column:
    """A negation cue between line start and span end, once false friends are erased."""
    return F.regexp_replace(window, FLAGS + lexicon.negation_false, " ").rlike(FLAGS + lexicon.negation)


def historical(line: Column, s: Column, e: Column, lexicon: Lexicon) -> Column:
    """A history cue close to the span; ``s`` and ``e`` count from the line's start."""
    low, high = F.greatest(s - BEFORE, F.lit(0)), F.least(e + AFTER, F.length(line))
    return F.substring(line, low + 1, high - low).rlike(FLAGS + lexicon.history)


def family(line: Column, lexicon: Lexicon) -> Column:
    """A relative is the subject and not only the narrator."""
    return line.rlike(FLAGS + lexicon.family) & ~line.rlike(FLAGS + lexicon.narrator)


def assertions(line: Column, s: Column, e: Column, top: Column, lexicon: Lexicon) -> Column:
    """The assertion labels of a span in its line, in fixed order."""
    s, e = s.cast("int"), e.cast("int")
    flags = (
        F.coalesce(top == "history", F.lit(False)) | historical(line, s, e, lexicon),
        negated(F.substring(line, F.lit(1), e), lexicon),
        family(line, lexicon),
    )
    return F.filter(F.array(*[F.when(f, F.lit(n)) for f, n in zip(flags, ASSERTIONS, strict=True)]), lambda x: x.isNotNull())


def assign(spans: DataFrame, lexicon: Lexicon, types: tuple[str, ...] = ASSERTION_TYPES) -> DataFrame:
    """``spans(..., line, line_start, start, end, type, top)`` with assertions; other types have none."""
    own = assertions(F.col("line"), F.col("start") - F.col("line_start"), F.col("end") - F.col("line_start"), F.col("top"), lexicon)
    return spans.withColumn("assertions", F.when(F.col("type").isin(*types), own).otherwise(F.array().cast("array<string>")))
