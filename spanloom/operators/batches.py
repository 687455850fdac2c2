"""Training batches under a constraint: no code twice in a batch, every batch as full as any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hygiene import shared_table


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``place``, its number from 0 in an order, without a sort in one task.

    Rows are range-partitioned and numbered inside each partition; the counts of the partitions before (a row a
    partition) move them on.
    """
    at = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = shared_table(at, "ordered").withColumn("_part", F.shiftright("_at", 33))
    counts = at.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at.join(counts.select("_part", (before - F.col("_first")).alias("_move")), "_part").withColumn("place", F.col("_at") + F.col("_move")).drop("_at", "_part", "_move")


def contrastive_batches(pairs: DataFrame, size: int = 64, seed: int = 1) -> DataFrame:
    """``pairs(code, a, b)`` with batch and slot: at most ``size`` a batch, no code twice, sizes that differ by one at most.

    Pairs are numbered with those of a code in a row, codes and pairs in hash order, and dealt to the batches in
    turn.  There are as many batches as sizes or the most frequent code ask for, so a code's pairs never come
    round to a batch again.  Rows with a null code take no part.
    """
    own = pairs.where("code is not null")
    n, most = own.groupBy("code").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    batches = max(1, -(-n // size), most)
    hashed = lambda *c: F.unhex(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(x).cast("string") for x in c])))
    dealt = numbered(own.withColumns({"_h": hashed("code"), "_i": hashed("a", "b")}), "_h", "code", "_i", "a", "b").drop("_h", "_i")
    return dealt.withColumns({"batch": F.col("place") % batches, "slot": F.floor(F.col("place") / batches)}).drop("place")


def padded_negatives(batched: DataFrame, negatives: DataFrame, k: int) -> DataFrame:
    """``batched`` with hard: exactly ``k`` negatives of each anchor, from ``negatives(a, nth, negative)`` by nth.

    What an anchor lacks is filled from the anchors that follow it in its batch (round to the first), whose codes are
    others; in a batch of fewer than k + 1 they come again, and an anchor alone in its batch has only its own.
    """
    keys = ["batch", "slot"]
    ranked = negatives.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy("nth", "negative"))).where(F.col("_n") <= k)
    own = ranked.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "negative"))), lambda x: x["negative"]).alias("own"))
    ring = F.transform(F.array_sort(F.collect_list(F.struct("slot", "a")).over(Window.partitionBy("batch"))), lambda x: x["a"])
    held = batched.withColumn("_ring", ring).withColumn("_at", F.row_number().over(Window.partitionBy("batch").orderBy("slot"))).join(own, "a", "left")
    kind = dict(batched.dtypes)["a"]
    have = F.coalesce("own", F.array().cast(f"array<{kind}>"))
    others = F.size("_ring") - 1
    fill = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get("_ring", ((F.col("_at") + i % F.greatest(others, F.lit(1))) % F.size("_ring")).cast("int")))
    hard = F.slice(F.concat(have, F.when(others > 0, fill).otherwise(F.array().cast(f"array<{kind}>"))), 1, k)
    return held.withColumn("hard", hard).select(*[c for c in batched.columns if c not in keys], *keys, "hard")
