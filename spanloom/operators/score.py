"""Scores of predicted against gold spans, of tag sequences, and of labels.

Spans have (doc_id, idx, type, start, end, text, assertions, codes); any further leading keys (such as an
experiment) are given as ``keys``, of which the last is the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import ASSERTION_TYPES, CODE_TYPES
from ..functions.similarity import word_levenshtein
from .hygiene import shared_table


def _pairs(gold: DataFrame, pred: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    g = gold.select(*keys, *[F.col(c).alias("g_" + c) for c in ("idx", "type", "start", "end", "text")])
    p = pred.select(*keys, *[F.col(c).alias("p_" + c) for c in ("idx", "type", "start", "end", "text")])
    return g, p


def _buckets(start: str, end: str) -> Column:
    """The 64-character buckets that a span touches, one a row."""
    return F.explode(F.sequence(F.floor(F.col(start) / 64), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / 64))).alias("bucket")


def dominant(edges: DataFrame, keys: list[str], *order: Column, rounds: int = 2) -> DataFrame:
    """(*keys, gi, pi): what taking ``edges(*keys, gi, pi, ...)`` in ``order`` gives if no end is used twice.

    An edge that comes first at both its ends is taken whatever the others are, and all that touch it go.  Such
    rounds are windows by one end each, so a document with very many edges isn't one task's, and most documents
    are done after the first.  Edges may hang together in chains that only their order settles, one edge a
    round: what is left after ``rounds`` goes on sorted by document, with the ends taken so far at hand.
    """
    left = edges.select(*keys, F.col("gi").cast("long").alias("gi"), F.col("pi").cast("long").alias("pi"), F.struct(*order).alias("o"))
    taken = None
    for _ in range(rounds):
        g, p = Window.partitionBy(*keys, "gi"), Window.partitionBy(*keys, "pi")
        best = left.withColumn("og", F.min("o").over(g)).withColumn("op", F.min("o").over(p)).withColumn("hit", (F.col("o") == F.col("og")) & (F.col("o") == F.col("op")))
        # A taken edge is the first of its end, so an edge touches one if the first of one of its ends is taken.
        marked = best.withColumn("gone", F.max("hit").over(p)).withColumn("gone", F.col("gone") | F.max("hit").over(g))
        marked = shared_table(marked.where("hit or not gone").select(*keys, "gi", "pi", "o", "hit"), "edges")
        won, left = marked.where("hit").select(*keys, "gi", "pi"), marked.where("not hit").drop("hit")
        taken = won if taken is None else taken.union(won)
        if left.isEmpty():
            return taken
    rest = _in_order(left, keys)
    return rest if taken is None else taken.union(rest)


def _in_order(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The ordered fold, as a stream over edges sorted by document; only the ends taken in one document are held."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gs, ps = None, set(), set()
        for batch in batches:
            kept = []
            for i, (*own, g, p) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if own != key:
                    key, gs, ps = own, set(), set()
                if g not in gs and p not in ps:
                    gs.add(g)
                    ps.add(p)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int32()))

    dealt = edges.repartition(*keys).sortWithinPartitions(*keys, "o").select(*keys, "gi", "pi")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields[:n])
    return dealt.mapInArrow(run, f"{fields}, gi long, pi long")


def greedy_match(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, gi, pi): one-to-one pairs of one type, best first: 2 for equal text, else overlap over one half.

    Ties go to the higher prediction, then the higher gold index.  Candidates come from two equi-joins (equal
    text; or the same 64-character bucket, of those that the spans touch), never from all pairs of a document.
    """
    g, p = _pairs(gold, pred, keys)
    same = g.withColumn("norm", X.normalize_for_match(F.col("g_text"))).join(p.withColumn("norm", X.normalize_for_match(F.col("p_text"))), [*keys, "norm"])
    same = same.where("g_type = p_type").select(*keys, F.col("g_idx").alias("gi"), F.col("p_idx").alias("pi"), F.lit(2.0).alias("s"))
    near = g.select("*", _buckets("g_start", "g_end")).join(p.select("*", _buckets("p_start", "p_end")), [*keys, "bucket"])
    near = near.where("g_type = p_type").select(*keys, F.col("g_idx").alias("gi"), F.col("p_idx").alias("pi"), X.iou(F.col("g_start"), F.col("g_end"), F.col("p_start"), F.col("p_end")).alias("s")).where("s > 0.5")
    edges = same.union(near).groupBy(*keys, "gi", "pi").agg(F.max("s").alias("s"))
    return dominant(edges, keys, -F.col("s"), -F.col("pi"), -F.col("gi"))


def paired(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each match, unmatched gold span and unmatched prediction: (*keys, g, p) as structs."""
    m = greedy_match(gold, pred, keys)
    fields = ["type", "start", "end", "text", "assertions", "codes"]
    g = gold.select(*keys, F.col("idx").cast("long").alias("gi"), F.struct(*fields).alias("g"))
    p = pred.select(*keys, F.col("idx").cast("long").alias("pi"), F.struct(*fields).alias("p"))
    return g.join(m, [*keys, "gi"], "left").join(p, [*keys, "pi"], "full").select(*keys, "gi", "pi", "g", "p")


def document_scores(gold: DataFrame, pred: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: text_score, assertions_score, and the candidate score's weighted sum and weight.

    ``docs(*keys)`` are the documents that count: those with gold, whether or not anything was predicted.
    """
    w = X.words
    pairs = paired(gold, pred, keys)
    both = F.col("g").isNotNull() & F.col("p").isNotNull()
    a, b = w(F.col("g.text")), w(F.col("p.text"))
    hit = F.when(both, F.greatest(F.lit(0.0), 1 - word_levenshtein(a, b) / F.greatest(F.size(a), F.lit(1))))
    kinds = list(ASSERTION_TYPES)
    counted = F.coalesce(F.col("g.type"), F.col("p.type")).isin(*kinds)
    none = F.array().cast("array<string>")
    side = lambda s, c: F.coalesce(F.col(f"{s}.{c}"), none)
    asserted = F.when(counted, X.jaccard(side("g", "assertions"), side("p", "assertions")))
    weight = F.when(F.col("g").isNotNull(), F.size(side("g", "codes")) + 1).otherwise(1)
    coded = X.jaccard(side("g", "codes"), side("p", "codes"))
    rows = pairs.select(*keys, hit.alias("hit"), F.col("g").isNotNull().cast("int").alias("ng"), F.col("p").isNotNull().cast("int").alias("np"), asserted.alias("aj"), (coded * weight).alias("cw"), weight.alias("w"), F.coalesce(F.col("g.type"), F.col("p.type")).isin(*CODE_TYPES).alias("has_codes"))
    sums = rows.groupBy(*keys).agg(
        F.coalesce(F.sum("hit"), F.lit(0.0)).alias("hits"), F.sum("ng").alias("n_gold"), F.sum("np").alias("n_pred"),
        F.avg("aj").alias("aj"), F.sum(F.when(F.col("has_codes"), F.col("cw"))).alias("cand_sum"), F.sum(F.when(F.col("has_codes"), F.col("w"))).alias("cand_weight"),
    )
    out = docs.select(*keys).distinct().join(sums, keys, "left")
    most = F.greatest(F.col("n_gold"), F.col("n_pred"))
    return out.select(
        *keys,
        F.coalesce(F.when(most > 0, F.col("hits") / F.when(most > 0, most).otherwise(1)), F.lit(1.0)).alias("text_score"),
        F.coalesce("aj", F.lit(1.0)).alias("assertions_score"),
        F.coalesce("cand_sum", F.lit(0.0)).alias("cand_sum"),
        F.coalesce(F.col("cand_weight").cast("double"), F.lit(0.0)).alias("cand_weight"),
    )


def dataset_score(doc_scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """text, assertions (means over documents), candidates (one weighted mean over all), and final .3/.3/.4."""
    cand = F.when(F.sum("cand_weight") > 0, F.sum("cand_sum") / F.sum("cand_weight")).otherwise(1.0)
    out = doc_scores.groupBy(*(group or [])).agg(F.avg("text_score").alias("text_score"), F.avg("assertions_score").alias("assertions_score"), cand.alias("candidates_score"))
    return out.withColumn("final_score", 0.3 * F.col("text_score") + 0.3 * F.col("assertions_score") + 0.4 * F.col("candidates_score"))


def max_overlap(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, gi, pi): gold spans in order take, of the unused predictions of any type, the one they overlap most."""
    g, p = _pairs(gold, pred, keys)
    inter = F.least("g_end", "p_end") - F.greatest("g_start", "p_start")
    near = g.select("*", _buckets("g_start", "g_end")).join(p.select("*", _buckets("p_start", "p_end")), [*keys, "bucket"])
    edges = near.select(*keys, F.col("g_idx").alias("gi"), F.col("p_idx").alias("pi"), inter.alias("o")).where("o > 0").distinct()
    return dominant(edges, keys, F.col("gi"), -F.col("o"), F.col("pi"))


def diagnose(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, gi, pi, type, kind, side): exact, boundary (left, right, both), wrong_type, missed or spurious."""
    m = max_overlap(gold, pred, keys)
    g = gold.select(*keys, F.col("idx").cast("long").alias("gi"), F.col("type").alias("gt"), F.col("start").alias("gs"), F.col("end").alias("ge"))
    p = pred.select(*keys, F.col("idx").cast("long").alias("pi"), F.col("type").alias("pt"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    j = g.join(m, [*keys, "gi"], "left").join(p, [*keys, "pi"], "full")
    left, right = F.col("gs") != F.col("ps"), F.col("ge") != F.col("pe")
    kind = F.when(F.col("gt").isNull(), "spurious").when(F.col("pt").isNull(), "missed").when(F.col("gt") != F.col("pt"), "wrong_type").when(left | right, "boundary").otherwise("exact")
    side = F.when(kind == "boundary", F.when(left & right, "both").when(left, "left").otherwise("right"))
    return j.select(*keys, "gi", "pi", F.coalesce("gt", "pt").alias("type"), kind.alias("kind"), side.alias("side"))


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = X.safe_divide(tp, tp + fp), X.safe_divide(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), X.safe_divide(2 * p * r, p + r).alias("f1")]


def set_prf(gold: DataFrame, pred: DataFrame, keys: list[str], kind: str = "type") -> DataFrame:
    """Precision, recall and F1 of two sets of rows by ``kind``, and over all (kind null), with support."""
    g = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    p = pred.select(*keys).distinct().withColumn("p", F.lit(1))
    both = g.join(p, keys, "full")
    hit, extra, lost = F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()), F.count_if(F.col("g").isNull()), F.count_if(F.col("p").isNull())
    counts = both.rollup(kind).agg(hit.alias("tp"), extra.alias("fp"), lost.alias("fn"))
    return counts.select(kind, *_prf(F.col("tp"), F.col("fp"), F.col("fn")), (F.col("tp") + F.col("fn")).alias("support"))


def averages(by_kind: DataFrame, kind: str = "type") -> DataFrame:
    """Macro (plain) and weighted (by support) means of what :func:`set_prf` has by kind, and its micro row."""
    own = by_kind.where(F.col(kind).isNotNull())
    parts = ("precision", "recall", "f1")
    macro = own.agg(*[F.avg(c).alias(c) for c in parts], F.sum("support").alias("support")).withColumn("average", F.lit("macro"))
    weighted = own.agg(*[X.safe_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in parts], F.sum("support").alias("support")).withColumn("average", F.lit("weighted"))
    micro = by_kind.where(F.col(kind).isNull()).select(*parts, "support", F.lit("micro").alias("average"))
    return micro.unionByName(macro).unionByName(weighted).select("average", *parts, "support")


def token_confusion(tags: DataFrame) -> DataFrame:
    """(accuracy, tp, fp, fn, tn) of ``tags(gold_tag, pred_tag)``; two O count as true negative only."""
    g, p = F.col("gold_tag"), F.col("pred_tag")
    return tags.agg(
        (F.count_if(g == p) / F.count("*")).alias("accuracy"),
        F.count_if((g == p) & (g != "O")).alias("tp"),
        F.count_if((g != p) & (p != "O")).alias("fp"),
        F.count_if((g != "O") & (p == "O")).alias("fn"),
        F.count_if((g == "O") & (p == "O")).alias("tn"),
    )


def numbered_tuples(tags: DataFrame, with_words: bool = True, dummy: str = "dum") -> DataFrame:
    """(sent_id, tag, word, nth): a sentence's tagged words, the n-th repeat of each told apart."""
    bare = F.regexp_replace("tag", "^[BI]-", "")
    t = tags.where(~F.col("tag").isin("0", "O", dummy)).select("sent_id", "pos", bare.alias("tag"), (F.col("word") if with_words else F.lit("dummy")).alias("word"))
    nth = F.row_number().over(Window.partitionBy("sent_id", "tag", "word").orderBy("pos")) - 1
    return t.select("sent_id", "tag", "word", nth.alias("nth"))


def tuple_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per tag and overall (micro, macro) precision, recall and F1 of numbered tuples; zero denominators count as 1."""
    return _with_averages(set_prf(gold, pred, ["sent_id", "tag", "word", "nth"], "tag"))


def counted_tuples(gold: DataFrame, pred: DataFrame, dummy: str = "dum") -> DataFrame:
    """(sent_id, tag, word, g, p): how often each side of ``(sent_id, word, tag)`` has a tuple, dealt by sentence in one shuffle."""
    side = lambda df, g: df.select("sent_id", "tag", "word", F.lit(g).alias("g"), F.lit(1 - g).alias("p"))
    return counted_sides(side(gold, 1).union(side(pred, 0)), dummy)


def counted_sides(sides: DataFrame, dummy: str = "dum") -> DataFrame:
    """As :func:`counted_tuples`, of both sides' ``(sent_id, tag, word, g, p)``, with 1 for the side that a row is of and 0 for the other."""
    told = sides.where(~F.col("tag").isin("0", "O", dummy)).select("sent_id", F.regexp_replace("tag", "^[BI]-", "").alias("tag"), "word", "g", "p")
    return told.repartition("sent_id").groupBy("sent_id", "tag", "word").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))


def count_scores(counted: DataFrame) -> DataFrame:
    """As :func:`tuple_scores` of :func:`numbered_tuples`, from :func:`counted_tuples`: the n-th repeats meet up to the lesser count."""
    met = F.when(F.col("sent_id").isNotNull() & F.col("word").isNotNull(), F.least("g", "p")).otherwise(0)
    return scores_of_counts(counted.withColumn("met", met))


def scores_of_counts(counts: DataFrame) -> DataFrame:
    """Scores of ``counts(tag, met, g, p)``: tuples that meet, and all of either side."""
    by = counts.rollup("tag").agg(F.sum("met").alias("tp"), F.sum(F.col("p") - F.col("met")).alias("fp"), F.sum(F.col("g") - F.col("met")).alias("fn"))
    return _with_averages(by.select("tag", *_prf(F.col("tp"), F.col("fp"), F.col("fn"))))


def kind_counts(counted: DataFrame) -> DataFrame:
    """(tag, words, dummy, g, p): over all sentences, how many tuples meet with their words, and by their tag alone."""
    known = F.col("sent_id").isNotNull()
    met = F.when(known & F.col("word").isNotNull(), F.least("g", "p")).otherwise(0)
    own = counted.groupBy("sent_id", "tag").agg(F.sum(met).alias("words"), F.sum("g").alias("g"), F.sum("p").alias("p"))
    return own.groupBy("tag").agg(F.sum("words").alias("words"), F.sum(F.when(known, F.least("g", "p")).otherwise(0)).alias("dummy"), F.sum("g").alias("g"), F.sum("p").alias("p"))


def _with_averages(by: DataFrame) -> DataFrame:
    """What ``by`` has of each tag, of all (micro), and the means (macro)."""
    parts = ("precision", "recall", "f1")
    own = by.where("tag is not null").select("tag", *parts)
    micro = by.where("tag is null").select(F.lit("overall_micro").alias("tag"), *parts)
    p, r = F.avg("precision"), F.avg("recall")
    macro = own.agg(p.alias("precision"), r.alias("recall"), F.avg("f1").alias("f1")).select(F.lit("overall_macro").alias("tag"), *parts)
    return own.union(micro).union(macro)


def multilabel_prf(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Per label and macro: precision, recall, F1 of ``rows(gold_<label>, pred_<label>)`` as 0 and 1."""
    out = None
    for x in labels:
        g, p = F.col(f"gold_{x}") == 1, F.col(f"pred_{x}") == 1
        c = rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
        one = c.select(F.lit(x).alias("label"), *_prf(F.col("tp"), F.col("fp"), F.col("fn")))
        out = one if out is None else out.union(one)
    macro = out.agg(F.lit("macro").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return out.union(macro)


def error_rows(gold: DataFrame, pred: DataFrame, sentences: DataFrame) -> DataFrame:
    """(sent_id, tag, text, gold, pred): per sentence and tag, what was there and what was found, where they differ."""
    side = lambda d, n: d.groupBy("sent_id", "tag").agg(F.array_join(F.array_sort(F.collect_list("word")), "\t").alias(n))
    j = side(gold, "gold").join(side(pred, "pred"), ["sent_id", "tag"], "full").fillna("", ["gold", "pred"])
    return j.where("gold <> pred").join(sentences, "sent_id")
