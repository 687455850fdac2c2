"""Synthetic documents and catalogs: everything drawn by hashes of a seed and an id, so runs agree.

Documents are rows of parts (doc_id, part, text, type); offsets are running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Ingredient, precise ingredient and brand names (fixed values of the terminology's term types).
DRUG_TERM_TYPES = ("IN", "PIN", "BN")
SLICES = 4096


def draw(seed: int, *keys) -> Column:
    """A number in [0, 1) from the first 8 hexadecimal digits of an md5 (which any SQL engine has)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pick(seed: int, n: Column, *keys) -> Column:
    """A whole number below n."""
    return F.floor(draw(seed, *keys) * n).cast("long")


def drug_catalog(terms: DataFrame, most: int = 20_000, seed: int = 1, max_words: int = 5) -> DataFrame:
    """Drug names of the listed term types and at most five words, ``most`` of them in hash order."""
    good = terms.where(F.col("tty").isin(*DRUG_TERM_TYPES) & (F.size(X.words(F.col("name"))) <= max_words))
    return good.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("code").cast("string"), "name")), "code").limit(most)


def name_catalog(terms: DataFrame, max_words: int = 10) -> DataFrame:
    """Terms with natural, short names."""
    return terms.where(X.is_natural_name(F.col("name"), max_words))


def shares(frames: DataFrame) -> DataFrame:
    """``frames(template, freq)`` with low and high, their share of the summed frequencies, for each slice of [0, 1) that it touches."""
    w = Window.orderBy(F.desc("freq"), "template")
    upto = frames.withColumn("high", F.sum("freq").over(w) / F.sum("freq").over(Window.partitionBy())).withColumn("low", F.coalesce(F.lag("high").over(w), F.lit(0.0)))
    return upto.withColumn("slice", F.explode(F.sequence(F.floor(F.col("low") * SLICES), F.floor(F.col("high") * SLICES))))


def weighted_choice(frames: DataFrame, draws: DataFrame) -> DataFrame:
    """``draws(id, u)`` each with the frame at share u of the summed frequencies.

    Frames and draws meet by equal slices of [0, 1), of which a frame holds those that its share touches.  The
    frames are a catalog, so their running sum is one small sort.
    """
    return draws.withColumn("slice", F.floor(F.col("u") * SLICES)).join(shares(frames), "slice").where("u >= low and u < high").drop("low", "high", "slice")


def build_texts(parts: DataFrame) -> DataFrame:
    """(doc_id, text, concepts): parts joined in order; parts with a type are concepts with their offsets."""
    w = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    placed = parts.withColumn("start", start.cast("int")).withColumn("end", (F.col("start") + F.length("text")).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "text", "type", "start", "end")))
    one = placed.groupBy("doc_id").agg(ordered.alias("ps"))
    concepts = F.transform(F.filter("ps", lambda p: p["type"].isNotNull()), lambda p: F.struct(p["text"].alias("text"), p["type"].alias("type"), p["start"].alias("start"), p["end"].alias("end")))
    return one.select("doc_id", F.array_join(F.transform("ps", lambda p: p["text"]), "").alias("text"), concepts.alias("concepts"))


def template_documents(spark: SparkSession, n: int, catalog: DataFrame, per_doc: int = 4, seed: int = 1) -> DataFrame:
    """``n`` documents of a header and ``per_doc`` bulleted lines, each a mention of a catalog entry (k, type, name)."""
    size = catalog.count()
    rows = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("line", F.explode(F.sequence(F.lit(1), F.lit(per_doc))))
    chosen = rows.withColumn("k", pick(seed, F.lit(size), "doc_id", "line")).join(catalog, "k")
    parts = chosen.select("doc_id", F.inline(F.array(
        F.struct((F.col("line") * 3).alias("part"), F.lit("- ").alias("text"), F.lit(None).cast("string").alias("type")),
        F.struct((F.col("line") * 3 + 1).alias("part"), F.col("name").alias("text"), F.col("type").alias("type")),
        F.struct((F.col("line") * 3 + 2).alias("part"), F.lit("\n").alias("text"), F.lit(None).cast("string").alias("type")),
    )))
    header = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).alias("part"), F.concat(F.lit("Note "), "id", F.lit("\n")).alias("text"), F.lit(None).cast("string").alias("type"))
    return build_texts(parts.union(header))


def compose_drug(name: Column, seed: int, key: Column) -> Column:
    """A name, with a dose in six of ten cases and a route in half of those drawn."""
    dose = F.when(draw(seed, key, F.lit("dose")) < 0.6, F.concat(((pick(seed, F.lit(20), key, F.lit("mg")) + 1) * 5).cast("string"), F.lit("mg")))
    route = F.when(draw(seed, key, F.lit("route")) < 0.5, F.element_at(F.array(F.lit("po"), F.lit("iv"), F.lit("bid"), F.lit("daily")), (pick(seed, F.lit(4), key, F.lit("r")) + 1).cast("int")))
    return F.concat_ws(" ", name, dose, route)


def fill_slots(template: Column, values: Column) -> Column:
    """A template with its slots filled in order from an array."""
    pieces = F.split(template, r"\{[^}]*\}", -1)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.concat(F.get(pieces, i - 1), F.coalesce(F.get(values, i - 1), F.lit("")))), "")


def mixing_count(frame_entities: Column, other_entities: Column, n_frames: Column, share: float) -> Column:
    """How many frame documents bring the share of frame entities to ``share``; from 1 to all."""
    want = share / (1 - share) * other_entities
    return F.least(F.greatest(F.floor(want / (frame_entities / n_frames) + 0.5), F.lit(1)), n_frames).cast("long")
