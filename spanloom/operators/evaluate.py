"""Evaluation of tagging models on what they put out: sequences of tags in text, and tags of heard words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .hygiene import shared_table
from .score import counted_sides, counted_tuples, kind_counts, scores_of_counts


def sequence_tags(rows: DataFrame, pad: str = "0") -> DataFrame:
    """(sent_id, pos, word, gold_tag, pred_tag) from ``rows(sent_id, words, gold, encoded)``.

    ``encoded`` is a generated text of tagged words.  Predictions that are fewer than the gold tags are filled with
    ``pad``, and what is more is cut off; a word whose two tags differ has ``pad`` as well.
    """
    tags = F.transform(X.decode_tags(F.col("encoded"), pad), lambda x: x["tag"])
    filled = F.concat(tags, F.array_repeat(F.lit(pad), F.greatest(F.size("gold") - F.size("tags"), F.lit(0))))
    told = rows.withColumn("tags", tags).withColumn("pred", F.slice(filled, F.lit(1), F.size("gold")))
    flat = told.where("size(gold) > 0").select("sent_id", F.posexplode(F.arrays_zip("words", "gold", "pred")).alias("pos", "x"))
    return flat.select("sent_id", "pos", F.col("x.words").alias("word"), F.col("x.gold").alias("gold_tag"), F.col("x.pred").alias("pred_tag"))


def both_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(kind, tag, precision, recall, f1) of ``gold`` and ``pred(sent_id, pos, word, tag)``, the words of either side its own.

    ``words`` counts a tuple of tag and word, ``dummy`` the tag alone, so that mis-heard words still count as tagged.
    Tuples are shuffled once, by sentence, and counted there; the counts without words are sums of those with them.
    """
    return _both(counted_tuples(gold, pred))


def tag_scores(tags: DataFrame) -> DataFrame:
    """As :func:`both_scores` of the two sides of ``tags(sent_id, word, gold_tag, pred_tag)``, made once for both."""
    side = lambda c, g: F.struct(F.col(c).alias("tag"), "word", F.lit(g).alias("g"), F.lit(1 - g).alias("p"))
    return _both(counted_sides(tags.select("sent_id", F.inline(F.array(side("gold_tag", 1), side("pred_tag", 0))))))


def _both(words: DataFrame) -> DataFrame:
    """Tuples are read once; of them a row a tag is kept, which both kinds' rates and means are made of."""
    counts, out = shared_table(kind_counts(words), "tags"), None
    for kind in ("words", "dummy"):
        one = scores_of_counts(counts.select("tag", F.col(kind).alias("met"), "g", "p")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.union(one)
    return out.select("kind", "tag", "precision", "recall", "f1")
