"""Operators that multiply rows: lines, regex matches, items, headings, frames, windows of tokens.

A document's lines are exploded in the scan, with their offsets: a row is a whole text, so nothing is shuffled for them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.lexicon import FLAGS, Lexicon


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, *keep, line_no, start, line): every line of every text, blank ones too, with its offset."""
    split = docs.select("doc_id", *keep, F.split(F.regexp_replace(F.col("text"), "\r\n?", "\n"), "\n").alias("_lines"))
    flat = split.withColumn("_starts", _line_starts(F.transform("_lines", F.length))).select("doc_id", *keep, "_starts", F.posexplode("_lines").alias("line_no", "line"))
    return flat.select("doc_id", *keep, "line_no", F.get("_starts", F.col("line_no")).alias("start"), "line")


@F.arrow_udf(T.ArrayType(T.LongType()))
def _line_starts(sizes: pa.Array) -> pa.Array:
    """Where lines of these lengths begin in their texts: running sums over the arrays."""
    ends = np.concatenate(([0], np.cumsum(sizes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))))
    upto = np.concatenate(([0], np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + 1)))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(upto[:-1] - np.repeat(upto[ends[:-1]], np.diff(ends))))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("match", T.StringType())])))
def _placed(gaps: pa.Array, found: pa.Array) -> pa.Array:
    """Each match with its start: running sums over the arrays, linear in their length, which a fold that appends isn't."""
    sizes = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    matched = found.flatten()
    between = gaps.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    # A text has one gap more than matches (or none of either, where it is null): the last one is left out.
    last = np.cumsum(gaps.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) - 1
    kept = np.ones(len(between), bool)
    kept[last[gaps.is_valid().to_numpy(zero_copy_only=False)]] = False
    long = pc.utf8_length(matched).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate(([0], np.cumsum(between[kept] + long)))
    ends = np.cumsum(sizes)
    starts = upto[1:] - long - np.repeat(upto[ends - sizes], sizes)
    rows = pa.StructArray.from_arrays([pa.array(starts.astype(np.int32)), matched], ["start", "match"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), rows)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, match>> of all matches, in code points: gaps and matches alternate; none of a null text."""
    return _placed(F.transform(F.split(text, pattern, -1), F.length), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def items(lines_: DataFrame) -> DataFrame:
    """(doc_id, line_no, start, end, item): what commas and semicolons part, without bullets at its ends."""
    m = lines_.select("doc_id", "line_no", F.col("start").alias("base"), F.inline(matches(F.col("line"), "[,;]+|[^,;]+")))
    m = m.where(~F.col("match").rlike("^[,;]"))
    chars = F.lit(" \t.-*+•")
    lead = F.length("match") - F.length(F.ltrim(F.col("match"), chars))
    item = F.trim(F.col("match"), chars)
    start = F.col("base") + F.col("start") + lead
    return m.select("doc_id", "line_no", start.alias("start"), (start + F.length(item)).alias("end"), item.alias("item")).where(F.trim("item") != "")


def line_kinds(lines_: DataFrame) -> DataFrame:
    """(kind, n, share): six kinds of line, the first that fits."""
    t = F.trim("line")
    size = F.size(X.words(F.col("line")))
    kind = (
        F.when(t == "", "blank")
        .when(t.rlike(r"^\s*(\d{1,2}[.)]|#+)\s*\S+") & (size <= 10), "heading")
        .when(t.rlike(r"^(?:[-*+•]|\d+[.)])\s+"), "bullet")
        .when(t.rlike(r"^[^:]{1,60}:\s*$"), "label")
        .when(size <= 10, "short")
        .otherwise("prose")
    )
    counted = lines_.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return counted.select("kind", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share"))


def skeleton_headers(lines_: DataFrame) -> DataFrame:
    """(header, freq): lines that look like headers: short, and numbered, ending in a colon, or capitalised."""
    t = F.trim("line")
    size = F.size(F.filter(F.split(t, " "), lambda w: w != ""))
    looks = t.rlike(r"^\d+[.)]") | (t.endswith(":") & (size <= 7)) | (t.rlike(r"^(?U)\p{Lu}") & (size <= 6) & ~t.endswith("."))
    return lines_.where((t != "") & (F.length(t) <= 60) & looks).groupBy(t.alias("header")).agg(F.count("*").alias("freq"))


def numbered_headings(lines_: DataFrame) -> DataFrame:
    """(doc_id, line_no, number, title) of numbered short lines."""
    p = r"^\s*(\d{1,2})\s*[.)]\s*(.{1,140}?)\s*$"
    return lines_.where(F.col("line").rlike(p)).select("doc_id", "line_no", F.regexp_extract("line", p, 1).cast("int").alias("number"), F.regexp_extract("line", p, 2).alias("title"))


def duplicate_headings(headings: DataFrame) -> DataFrame:
    """(doc_id, extra, adjacent): repeated (number, title) pairs and neighbours that are equal."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    key = F.struct("number", F.lower("title"))
    flagged = headings.select("doc_id", key.alias("k"), (key == F.lag(key).over(w)).alias("same"))
    counted = flagged.groupBy("doc_id", "k").agg(F.count("*").alias("n"), F.count_if("same").alias("s"))
    return counted.groupBy("doc_id").agg(F.sum(F.col("n") - 1).alias("extra"), F.sum("s").alias("adjacent"))


def mine_frames(templates: DataFrame) -> DataFrame:
    """(template, types, freq, safe) from ``templates(line)`` of blanked text: pruned and flagged."""
    t = X.squeeze(F.col("line"))
    types = F.regexp_extract_all(F.col("template"), F.lit(r"\{([^}]*)\}"), F.lit(1))
    counted = templates.select(t.alias("template")).where(F.col("template").contains("{") & F.length("template").between(3, 95)).groupBy("template").agg(F.count("*").alias("freq"))
    counted = counted.where("freq >= 2").withColumn("types", types)
    doubled = F.exists(F.arrays_zip(F.slice("types", F.lit(1), F.size("types") - 1).alias("a"), F.slice("types", F.lit(2), F.size("types")).alias("b")), lambda x: x["a"] == x["b"])
    return counted.where(~F.coalesce(doubled, F.lit(False))).withColumn("safe", X.residual_words(F.col("template")) <= 5)


def token_windows(tokens: Column, size: int = 256, stride: int = 48) -> Column:
    """Overlapping windows: array<struct<start, tokens>>; consecutive windows share ``stride`` tokens."""

    def use(t: Column) -> Column:
        last = F.greatest(F.size(t) - stride - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last, F.lit(size - stride)), lambda s: F.struct(s.alias("start"), F.slice(t, s + 1, size).alias("tokens")))

    return X.bind(tokens, use)


def newline_pieces(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, start, text, ...) that run over lines, split: one for each line, without bullets or blanks."""
    rest = [c for c in spans.columns if c not in ("start", "end", "text")]
    flat = spans.select(*rest, F.col("start").alias("base"), F.inline(matches(F.col("text"), r"[^\n]+")).alias("before", "piece"))
    body = F.regexp_replace("piece", r"^\s*(?:[-*+•]|\d+[.)])\s*", "")
    lead = F.length("piece") - F.length(F.regexp_replace(body, r"(?U)^\s+", ""))
    kept = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    start = F.col("base") + F.col("before") + lead
    return flat.select(*rest, start.alias("start"), (start + F.length(kept)).alias("end"), kept.alias("text")).where("text <> ''")


def sections(lines_: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``lines_`` with header (struct), label, top and sub carried forward per document.

    A top-level header resets the sub-context; a sub header and a label line set it without resetting.
    """
    label = X.label_of(F.col("line"), lexicon)
    own = lines_.withColumn("label", label).withColumn("header", F.when(F.trim("line") != "", X.header_of(F.coalesce(label, F.col("line")), lexicon)))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_reset = F.col("header.top").isNotNull() & F.col("label").isNull()
    # What a line does to the sub-context: sets it, clears it, or nothing.
    effect = F.when(F.col("header.sub").isNotNull(), F.struct(F.col("header.sub").alias("v"))).when(is_reset, F.struct(F.lit(None).cast("string").alias("v")))
    carried = own.withColumns({"top": F.last("header.top", True).over(w), "_sub": F.last(effect, True).over(w)})
    return carried.withColumn("sub", F.col("_sub.v")).drop("_sub")
