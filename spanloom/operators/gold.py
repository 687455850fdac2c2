"""Gold spans from annotated items, and reports on them and on predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hygiene import shared_table
from .score import diagnose
from .spans import locate_in_order


def build_gold(items: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts (doc_id, text, type, start, end, assertions, candidates) and faults (doc_id, k, item) of annotated items.

    ``items(doc_id, k, item, type, after, occ, assertions, candidates)`` are placed in order (see
    :class:`~spanloom.operators.tables.LocateInOrder`).  An item that isn't found, or whose document isn't there, is
    a fault and no concept.
    """
    place = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("k").cast("long").alias("k"), "item", "type", "assertions", "candidates")
    found = locate_in_order(items, docs)
    both = shared_table(place.join(found, ["doc_id", "k"], "left").withColumn("error", F.coalesce("error", F.lit(True))), "gold")
    none = F.array().cast("array<string>")
    concepts = both.where("not error").select("doc_id", F.col("item").alias("text"), "type", "start", "end", F.coalesce("assertions", none).alias("assertions"), F.coalesce("candidates", none).alias("candidates"))
    return concepts, both.where("error").select("doc_id", "k", "item")


def gold_report(items: DataFrame, concepts: DataFrame, faults: DataFrame) -> DataFrame:
    """(n_docs, n_concepts, n_faults) of a built gold."""
    docs = items.select("doc_id").distinct().select(F.lit(1).alias("d"), F.lit(0).alias("c"), F.lit(0).alias("f"))
    rows = docs.union(concepts.select(F.lit(0), F.lit(1), F.lit(0))).union(faults.select(F.lit(0), F.lit(0), F.lit(1)))
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("d", "n_docs"), ("c", "n_concepts"), ("f", "n_faults"))])


def diagnosis_report(gold: DataFrame, pred: DataFrame, keys: list[str], types: tuple[str, ...] | None = None) -> DataFrame:
    """(part, type, kind, n, share): how predictions differ from gold, over all, by type and by side of the boundary.

    ``part`` is ``total`` (share of the gold spans; spurious predictions have none), ``type`` or ``side``.  ``types``
    restricts both sides to some types: gold before matching, predictions that are left over after it.
    """
    own = gold.where(F.col("type").isin(*types)) if types else gold
    told = diagnose(own, pred, keys)
    if types:
        told = told.where((F.col("kind") != "spurious") | F.col("type").isin(*types))
    told = shared_table(told, "diagnosis")
    n = F.count("*").alias("n")
    total = told.groupBy("kind").agg(n)
    golds = F.sum(F.when(F.col("kind") != "spurious", F.col("n"))).over(Window.partitionBy())
    share = F.when(F.col("kind") != "spurious", F.round(F.col("n") / F.greatest(golds, F.lit(1)), 6))
    none = F.lit(None)
    a = total.select(F.lit("total").alias("part"), none.cast("string").alias("type"), "kind", "n", share.alias("share"))
    b = told.where("kind <> 'spurious'").groupBy("type", "kind").agg(n).select(F.lit("type"), "type", "kind", "n", none.cast("double"))
    c = told.where("side is not null").groupBy("side").agg(n).select(F.lit("side"), none.cast("string"), "side", "n", none.cast("double"))
    return a.union(b).union(c)


def diagnosis_examples(gold: DataFrame, pred: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """(kind, nth, *keys, gi, gold, pred): the first ``most`` boundary, type and missed cases, in order of ``keys`` and gold.

    Each task sends at most ``most`` rows of a kind on.
    """
    told = diagnose(gold, pred, keys).where(F.col("kind").isin("boundary", "wrong_type", "missed"))
    first = Window.partitionBy("kind").orderBy(*keys, "gi")
    few = told.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most)
    g = gold.select(*keys, F.col("idx").cast("long").alias("gi"), F.col("text").alias("gold"))
    p = pred.select(*keys, F.col("idx").cast("long").alias("pi"), F.col("text").alias("pred"))
    return few.join(g, [*keys, "gi"]).join(p, [*keys, "pi"], "left").select("kind", "nth", *keys, "gi", "gold", "pred")
