"""Operators on spans and tag sequences: coding, overlap, suppression, invariants."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sweep import sweep as sweep
from .tables import LocateInOrder, PlaceLongestFirst


def bio_decode(tags: DataFrame, zero_width: Column | None = None) -> DataFrame:
    """(doc_id, type, start, end, conf) from ``tags(doc_id, pos, ts, te, tag, prob)``.

    A span begins at ``B-`` or where the type changes; ``I-`` of the same type goes on; ``O`` ends it.  Where tags have a
    ``place``, their tokens' numbers in a row, those of ``O`` may be left out: a gap ends a span as well.
    """
    t = tags.where("te > ts") if zero_width is None else tags.where(~zero_width)
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = t.withColumn("kind", F.when(F.col("tag") != "O", F.substring("tag", F.lit(3), F.length("tag"))))
    begins = F.col("tag").startswith("B-") | ~F.col("kind").eqNullSafe(F.lag("kind").over(w))
    if "place" in tags.columns:
        begins = begins | (F.col("place") != F.lag("place").over(w) + 1)
    t = t.withColumn("begins", begins.cast("int"))
    t = t.withColumn("island", F.sum("begins").over(w)).where("kind is not null")
    conf = F.coalesce(F.avg("prob"), F.lit(1.0))
    return t.groupBy("doc_id", "island", F.col("kind").alias("type")).agg(F.min("ts").alias("start"), F.max("te").alias("end"), conf.alias("conf")).drop("island")


def bio_encode(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """``tokens(doc_id, pos, ts, te)`` with the tag of the first span that overlaps each (B- where the span starts).

    Tokens and spans meet in the 64-character buckets that both touch, never by all pairs of a document.
    """
    buckets = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / 64), F.floor(F.greatest(F.col(e) - 1, F.col(s)) / 64))).alias("bucket")
    s = spans.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), "type", buckets("start", "end"))
    own = [c for c in tokens.columns if c not in ("doc_id", "pos")]
    near = tokens.select("*", buckets("ts", "te")).join(s, ["doc_id", "bucket"], "left")
    hit = F.min(F.when((F.col("ts") < F.col("e")) & (F.col("te") > F.col("s")), F.struct("s", "e", "type"))).alias("span")
    out = near.groupBy("doc_id", "pos", *own).agg(hit)
    tag = F.when(F.col("span").isNull(), "O").otherwise(F.concat(F.when(F.col("ts") <= F.col("span.s"), "B-").otherwise("I-"), F.col("span.type")))
    return out.withColumn("tag", tag).drop("span")


def bio_texts(docs: DataFrame, spans: DataFrame, outside: bool = True) -> DataFrame:
    """(doc_id, place, pos, ts, te, tag) of the words of ``docs(doc_id, text)``, tagged as :func:`bio_encode` does.

    ``pos`` is a hundred thousand times the line's number and the word's number in it, ``place`` its number in the text;
    without ``outside`` words in no span are left out.  A text meets its spans as arrays of one row, before it is cut into
    words, so words are neither shuffled nor joined.
    """
    held = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), "type"))).alias("spans"))
    # Texts go into the join as plans.pipelines.from_logits has them, so that one shuffle of them serves both.
    both = docs.select("doc_id", F.col("text").alias("raw")).join(held, "doc_id", "left" if outside else "inner").withColumn("text", F.regexp_replace("raw", "\r\n?", "\n"))
    gaps = both.select("doc_id", "spans", F.split("text", r"\S+", -1).alias("gaps"), F.transform(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), F.length).alias("sizes"))
    breaks = F.transform("gaps", lambda g: F.length(g) - F.length(F.replace(g, F.lit("\n"))))
    bound = lambda c: F.coalesce(F.transform("spans", lambda x: x[c]), F.array().cast("array<bigint>"))
    words = _words_in(F.transform("gaps", F.length), breaks, "sizes", bound("s"), bound("e"), F.lit(outside))
    flat = gaps.select("doc_id", "spans", words.alias("words")).select("doc_id", "spans", F.inline("words"))
    own = F.get("spans", F.col("span"))
    tag = F.when(F.col("span") < 0, "O").otherwise(F.concat(F.when(F.col("ts") <= own["s"], "B-").otherwise("I-"), own["type"]))
    return flat.select("doc_id", "place", "pos", "ts", "te", tag.alias("tag"))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("pos", "ts", "te")], T.StructField("span", T.IntegerType())])))
def _words_in(gaps: pa.Array, breaks: pa.Array, sizes: pa.Array, starts: pa.Array, ends: pa.Array, outside: pa.Array) -> pa.Array:
    """Words, from their lengths and those of the gaps before them, each with the first span (of sorted ones) that overlaps it, or -1."""
    flat = lambda x: x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    upto = lambda x: np.concatenate(([0], np.cumsum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))))
    (g, b, z, s, e), at_g, at_z, at_s = map(flat, (gaps, breaks, sizes, starts, ends)), upto(gaps), upto(sizes), upto(starts)
    every, out, many = outside[0].as_py() if len(outside) else True, [], np.zeros(len(sizes), np.int64)
    for k in range(len(sizes)):
        n = at_z[k + 1] - at_z[k]
        size, line = z[at_z[k] : at_z[k + 1]], np.cumsum(b[at_g[k] : at_g[k] + n])
        te = np.cumsum(g[at_g[k] : at_g[k] + n] + size)
        ts, place, own = te - size, np.arange(n), np.full(n, -1)
        first, last = s[at_s[k] : at_s[k + 1]], e[at_s[k] : at_s[k + 1]]
        low, high = np.searchsorted(te, first, "right"), np.searchsorted(ts, last, "left")
        for i in range(len(first) - 1, -1, -1):
            own[low[i] : high[i]] = i
        pos = line * 100_000 + place - np.searchsorted(line, line, "left")
        kept = slice(None) if every else np.flatnonzero(own >= 0)
        out.append([x[kept] for x in (place, pos, ts, te, own)])
        many[k] = len(out[-1][0])
    kinds = (np.int32, np.int64, np.int64, np.int64, np.int32)
    columns = [pa.array(np.concatenate([x[c] for x in out] or [np.zeros(0)]).astype(t)) for c, t in enumerate(kinds)]
    rows = pa.StructArray.from_arrays(columns, ["place", "pos", "ts", "te", "span"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), rows)


def chunks(tags: DataFrame, dummy: str = "dum") -> DataFrame:
    """(doc_id, type, start, end) in positions, by the begin/inside/end/single state rules of chunk scoring."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = tags.where(F.col("tag") != dummy).withColumns({"p": F.substring("tag", 1, 1), "kind": F.substring_index("tag", "-", -1)})
    before, kind0 = F.coalesce(F.lag("p").over(w), F.lit("O")), F.coalesce(F.lag("kind").over(w), F.lit("O"))
    begin = F.col("p").isin("B", "S") | ((F.col("p").isin("I", "E")) & (before.isin("E", "S", "O") | (kind0 != F.col("kind"))))
    t = t.withColumn("begins", ((F.col("p") != "O") & begin).cast("int"))
    t = t.withColumn("island", F.sum("begins").over(w)).where("p <> 'O'")
    return t.groupBy("doc_id", "island", F.col("kind").alias("type")).agg(F.min("pos").alias("start"), F.max("pos").alias("end")).drop("island")


def suppress(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, type, start, end, conf) left when, best first, each that overlaps one kept already goes.

    Order: confidence, then length, both descending; then start, end and type.
    """
    key = F.struct((-F.col("conf")).alias("c"), (F.col("start") - F.col("end")).alias("l"), "start", "end", "type", "conf")
    ordered = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(key)).alias("xs"))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,type:string,conf:double>>)")

    def step(acc: Column, x: Column) -> Column:
        one = F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), x["type"].alias("type"), x["conf"].cast("double").alias("conf"))
        return F.when(F.exists(acc, lambda a: (a["start"] < x["end"]) & (a["end"] > x["start"])), acc).otherwise(F.array_append(acc, one))

    return ordered.select("doc_id", F.inline(F.aggregate("xs", empty, step)))


def first_of(spans: DataFrame, *order: str) -> DataFrame:
    """One span for each (doc_id, type, start, end): the first by ``order``."""
    w = Window.partitionBy("doc_id", "type", "start", "end").orderBy(*order)
    return spans.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def offset_faults(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(n, faults): spans whose text isn't what stands at their place."""
    j = spans.join(docs.select("doc_id", F.col("text").alias("raw")), "doc_id")
    wrong = F.substring(F.col("raw"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")) != F.col("text")
    return j.agg(F.count("*").alias("n"), F.count_if(wrong).alias("faults"))


def section_at(spans: DataFrame, sections: DataFrame) -> DataFrame:
    """Spans with the section of the first line interval that holds their start (its end included).

    An as-of lookup without a range join: intervals and spans are sorted together per document, and the
    line before a start that is a line's first character ends exactly there.  Sections may have their line's ``size`` in
    its place, so that lines aren't shuffled.
    """
    size = F.col("size") if "size" in sections.columns else F.length("line")
    lines = sections.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("start").alias("s"), (F.col("start") + size).alias("e"), "top").alias("own"), F.lit(None).cast("struct<k:bigint>").alias("span"))
    own = [c for c in spans.columns if c != "doc_id"]
    probe = spans.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("kind"), F.struct(*own).alias("span"))
    both = lines.drop("span").unionByName(probe, allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("at", "kind")
    last = both.withColumn("hit", F.last("own", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return last.where("kind = 1").select("doc_id", "span.*", F.when(F.col("at") <= F.col("hit.e"), F.col("hit.top")).alias("section"))


def merge_pieces(pieces: DataFrame) -> DataFrame:
    """Entity pieces (doc_id, start, end, label, score) that touch or share an end merged, with the best piece's label."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = pieces.withColumn("new", (F.col("start") > F.coalesce(far, F.lit(-1))).cast("int")).withColumn("island", F.sum("new").over(w))
    return p.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("label", F.struct("score", -F.col("start"))).alias("label"), F.max("score").alias("score")).drop("island")


def first_piece_labels(pieces: DataFrame) -> DataFrame:
    """Word labels for sub-word pieces (doc_id, pos, word_id, label): the first piece has it, others -100."""
    w = Window.partitionBy("doc_id", "word_id").orderBy("pos")
    return pieces.withColumn("label", F.when(F.col("word_id").isNull() | (F.row_number().over(w) > 1), -100).otherwise(F.col("label")))


def mask_entities(tags: DataFrame, share: float, seed: int, mask: str = "[MASK]") -> DataFrame:
    """``tags(doc_id, pos, tag, token)`` with whole entities masked: a group goes if its hash is below ``share``."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    group = F.sum(F.when(F.col("tag").startswith("I-"), 0).otherwise(1)).over(w)
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "doc_id", group)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return tags.withColumn("token", F.when((F.col("tag") != "O") & (draw < share), mask).otherwise(F.col("token")))


def locate_in_order(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, k, start, end, error) of ordered items (doc_id, k, item, after, occ), found from a moving cursor.

    A document's text and its items are one partition of :class:`~spanloom.operators.tables.LocateInOrder`.
    """
    asked = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("k").cast("long").alias("k"), "item", "after", F.col("occ").cast("int").alias("occ"))
    text = docs.join(items.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = asked.join(docs.select("doc_id"), "doc_id", "left_semi").unionByName(text, allowMissingColumns=True)
    return LocateInOrder(rows.asTable().partitionBy("doc_id").orderBy(F.col("k").asc_nulls_first()))


def locate_longest_first(phrases: DataFrame, docs: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc_id, phrase, start, end): planned phrases placed longest first, each where it first fits beside the others.

    Documents where fewer than ``least`` of their phrases are found give none.  A document's text and its phrases are
    one partition of :class:`~spanloom.operators.tables.PlaceLongestFirst`.
    """
    asked = phrases.where("phrase is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "phrase", (-F.length("phrase")).alias("shorter"))
    text = docs.join(phrases.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = asked.join(docs.select("doc_id"), "doc_id", "left_semi").unionByName(text, allowMissingColumns=True)
    return PlaceLongestFirst(rows.asTable().partitionBy("doc_id").orderBy(F.col("shorter").asc_nulls_first(), "phrase"), F.lit(float(least)))
