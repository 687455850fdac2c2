"""Whole runs: notes to coded, qualified concepts; and predictions to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import CLINICAL_VI, DIAGNOSIS, DRUG, LAB_RESULT, Lexicon
from ..operators import assertions, lines, link, rules, score, spans
from ..operators.hygiene import shared_table


def predict(docs: DataFrame, lexicon: Lexicon = CLINICAL_VI, diagnoses: DataFrame | None = None, drugs: DataFrame | None = None, vocabulary: DataFrame | None = None, k_diagnosis: int = 3, k_drug: int = 1) -> DataFrame:
    """(doc_id, text, type, start, end, assertions, candidates) of every document.

    Codes are looked up once for each distinct mention text, then joined back.
    """
    found = assertions.assign(rules.extract(docs, lexicon, vocabulary), lexicon)
    found = spans.first_of(found, "line_no")
    coded = None
    for kind, terms, k, match in ((DIAGNOSIS, diagnoses, k_diagnosis, link.match_terminology), (DRUG, drugs, k_drug, link.match_drugs)):
        if terms is None:
            continue
        q = found.where(F.col("type") == kind).select(F.col("text").alias("query")).distinct().withColumn("query_id", F.xxhash64("query"))
        best = match(q, terms, k).groupBy(F.col("query_id").alias("coded_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"].cast("string")).alias("codes"))
        one = best.withColumn("kind", F.lit(kind))
        coded = one if coded is None else coded.union(one)
    if coded is not None:
        found = found.join(coded, (F.xxhash64("text") == F.col("coded_id")) & (F.col("type") == F.col("kind")), "left")
    else:
        found = found.withColumn("codes", F.lit(None).cast("array<string>"))
    return found.select("doc_id", "text", "type", "start", "end", "assertions", F.coalesce("codes", F.array().cast("array<string>")).alias("candidates"))


def evaluate(gold: DataFrame, pred: DataFrame, docs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The dataset score (one row, or one for each leading key)."""
    keys = keys or ["doc_id"]
    return score.dataset_score(score.document_scores(gold, pred, docs, keys), keys[:-1])


def from_logits(tokens: DataFrame, docs: DataFrame, lexicon: Lexicon = CLINICAL_VI, least: float = 0.95) -> DataFrame:
    """(doc_id, text, type, start, end, conf, section): mentions from a token classifier's output, overlapping windows and all.

    ``tokens(doc_id, window, pos, ts, te, tag, prob)`` are decoded window by window (with ``place``, as
    :func:`spans.bio_decode` has it, those of ``O`` may be left out).  Spans below ``least`` go; what
    runs over lines is split; bounds snap to words; diagnoses and drugs lose a parenthesis that tells an event;
    garbage goes; of equal spans the first window's stays.  Then the surest are kept first, and what overlaps one
    that is kept goes.
    """
    parts = tokens.withColumn("doc_id", F.struct("doc_id", "window"))
    decoded = spans.bio_decode(parts).where(F.col("conf") >= least).select("doc_id.doc_id", "doc_id.window", "type", "start", "end", "conf")
    text = docs.select("doc_id", F.col("text").alias("raw"))
    cut = lambda s, e: F.substring(F.col("raw"), s + 1, e - s)
    own = decoded.join(text, "doc_id").withColumn("text", cut(F.col("start").cast("int"), F.col("end").cast("int"))).drop("raw")
    pieces = lines.newline_pieces(own).join(text, "doc_id")
    snap = X.snap_to_words(F.col("raw"), F.col("start").cast("int"), F.col("end").cast("int"))
    snapped = pieces.select("doc_id", "window", "type", "conf", X.bind(snap, lambda at: F.struct(at["start"].alias("start"), cut(at["start"], at["end"]).alias("text"))).alias("at"))
    # Written once: the expressions below refer to a snapped text many times, and would compute it anew each time.
    snapped = shared_table(snapped.select("doc_id", "window", "type", "conf", "at.start", "at.text").where("text <> ''"), "snapped")
    short = F.when(F.col("type").isin(DIAGNOSIS, DRUG), X.trim_parenthesis(F.col("text"), lexicon)).otherwise(F.col("text"))
    kept = snapped.select("doc_id", "window", "type", F.col("start").cast("long").alias("start"), "conf", short.alias("text")).where(F.trim("text") != "")
    kept = kept.where(~X.is_garbage(F.col("text"), F.col("type") == LAB_RESULT, lexicon)).withColumn("end", (F.col("start") + F.length("text")).cast("long"))
    best = spans.suppress(spans.first_of(kept, "window"))
    mentions = best.join(text, "doc_id").withColumn("text", cut(F.col("start").cast("int"), F.col("end").cast("int"))).drop("raw")
    told = lines.sections(lines.lines(docs).withColumn("size", F.length("line")), lexicon)
    return spans.section_at(mentions, told.select("doc_id", "start", "size", "top")).select("doc_id", "text", "type", "start", "end", "conf", "section")
