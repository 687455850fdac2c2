"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

``plan`` gives every source a target size: weights 5, 2, 1, repeating over the sources by code point (null
last), share the total; a target stops at three times its source's size and the excess is shared again by
weight among the others.  Each document of a source is to be copied ``target / source_size`` times: the whole
part is certain, the fraction is rounded at random so that the source keeps its total.

Rounding is pivotal: two units with fractions p and q meet, and words (fraction times size) pass from one to the
other, this way or that, until one is all in or all out, each way with the chance that keeps everyone's
expectation.  Words are kept, so a source's total is right but for its last unit.  Units meet in chunks of
about ``CHUNK`` documents of like size, by a fold over each chunk's sorted array; every chunk leaves at most one
unit undecided, and these meet again, ``FAN`` chunks at a time, level by level (a reduction tree) until each
source has one, which is drawn.  Words are integers of 2**-20, so none are lost by rounding, and draws are hashes
of the seed and the two units: reruns agree.  Documents without words are drawn each for itself.

Scale: words are counted in the scan; what is shuffled is (source, size, doc_id), without texts.  A source
that holds a third of all rows is spread over its chunks from the start.  The per-source and per-size-class
tables are aggregates with map-side combine; nothing about documents reaches the driver.

Defined cases: null text has size 0 and takes 0 words; null sources form a source of their own; the whole
table empty gives no rows; if all sizes are 0 all targets are 0.  Rows alike in doc_id, source and size are
one unit: each of them gets the unit's copies.  Extra columns are ignored by ``mix`` and kept by ``apply``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hash_fraction, shielded, table

WEIGHTS = (5, 2, 1)
MOST = 3
CHUNK = 128
FAN = 128
ONE = 1 << 20  # parts of a word
SEED = 20


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, rounds_most: int = 1_000_000) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: shares by weight, none above ``MOST`` times its size.

    Capping is settled in one pass, whatever the number of sources: order them by size per weight; sharing
    caps a prefix of that order, the longest at whose every place the share of the rest exceeds the cap.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(place - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    w = sizes.select("source", "source_size", weight.alias("weight"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    w = w.select(
        "*",
        F.sum("source_size").over(whole).cast("double").alias("total"),
        F.sum("weight").over(whole).alias("weights"),
        F.coalesce(F.sum("source_size").over(upto), F.lit(0)).cast("double").alias("size_before"),
        F.coalesce(F.sum("weight").over(upto), F.lit(0.0)).alias("weight_before"),
        F.row_number().over(order).alias("place"),
    )
    # The share per weight if exactly the sources before this one are capped.
    rate = (F.col("total") - MOST * F.col("size_before")) / (F.col("weights") - F.col("weight_before"))
    w = w.withColumn("rate", rate).withColumn("free", F.col("rate") * F.col("weight") <= MOST * F.col("source_size"))
    first = F.min(F.when(F.col("free"), F.col("place"))).over(whole)
    w = w.withColumn("first_free", first)
    final = F.max(F.when(F.col("place") == F.col("first_free"), F.col("rate"))).over(whole)
    target = F.when(F.col("first_free").isNull() | (F.col("place") < F.col("first_free")), MOST * F.col("source_size").cast("double")).otherwise(final * F.col("weight"))
    return w.select("source", "source_size", target.alias("target"))


_OPEN = "struct<uid: bigint, mass: bigint, room: bigint>"


def _fold(units: Column, level: int) -> Column:
    """A fold over a chunk's array of (uid, mass, room): (undecided unit or null, units decided to be in).

    ``room`` is a unit's size in ``ONE`` and ``mass`` its fraction of it; the undecided unit's is neither none nor all.
    """
    start = F.struct(F.lit(None).cast(_OPEN).alias("open"), F.array().cast("array<bigint>").alias("won"))

    def unit(x: Column, mass: Column) -> Column:
        return F.struct(x["uid"].alias("uid"), mass.alias("mass"), x["room"].alias("room"))

    def step(acc: Column, b: Column) -> Column:
        a = acc["open"]
        up, down = F.least(a["room"] - a["mass"], b["mass"]), F.least(a["mass"], b["room"] - b["mass"])
        draw = F.pmod(F.xxhash64(a["uid"], b["uid"], F.lit(SEED + level)), F.lit(1 << 40)).cast("double") / float(1 << 40)
        pass_ = F.when(draw * (up + down) < down, up).otherwise(-down)  # words that go from b to a
        a, b = unit(a, a["mass"] + pass_), unit(b, b["mass"] - pass_)
        both = F.array(a, b)
        won = F.transform(F.filter(both, lambda x: x["mass"] == x["room"]), lambda x: x["uid"])
        rest = F.get(F.filter(both, lambda x: (x["mass"] > 0) & (x["mass"] < x["room"])), F.lit(0))
        return F.struct(rest.alias("open"), F.concat(acc["won"], won).alias("won"))

    return F.aggregate(units, start, lambda acc, x: F.when(acc["open"].isNull(), F.struct(unit(x, x["mass"]).alias("open"), acc["won"].alias("won"))).otherwise(step(acc, x)))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs(doc_id, text, source)``."""
    rows = cut(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of(F.col("text")).alias("size")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    plan = cut(targets(sizes), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_source = plan.select(
        F.col("source").alias("s"), "source_size", "target",
        F.floor(ratio).cast("int").alias("whole"),
        (ratio - F.floor(ratio)).alias("fraction"),
    )

    # Units and their size classes: about eight to the octave, so that a chunk's members weigh alike.
    group = F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int")
    units = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times"))
    uid = F.xxhash64(F.lit(SEED), "doc_id", "source", "size")
    units = units.select(uid.alias("uid"), "source", "size", (F.col("size") * F.col("times") * ONE).alias("room"), group.alias("class")).where("size > 0")
    classes = units.groupBy("source", "class").agg(F.count("*").alias("n"))
    chunks = F.ceil(F.col("n") / CHUNK)
    before = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = cut(classes.select("source", "class", chunks.alias("chunks"), F.coalesce(F.sum(chunks).over(before), F.lit(0)).alias("offset")), "classes")
    most = classes.agg(F.max(F.col("chunks") + F.col("offset"))).first()[0] or 0

    c = classes.select(F.col("source").alias("cs"), F.col("class").alias("cc"), "chunks", "offset")
    open_units = (
        units.join(per_source.select("s", "fraction"), F.col("source").eqNullSafe(F.col("s")))
        .join(c, F.col("source").eqNullSafe(F.col("cs")) & (F.col("class") == F.col("cc")))
        .withColumn("mass", F.round(F.col("fraction") * F.col("room")).cast("long"))
    )
    # A fraction so near to none or all that it rounds to it is decided from the start.
    certain = open_units.where("mass = room").select("uid")
    open_units = open_units.where("mass > 0 and mass < room")
    open_units = open_units.select("source", (F.col("offset") + F.pmod("uid", "chunks")).alias("chunk"), F.struct("size", "uid", "mass", "room").alias("u"))
    folded = open_units.groupBy("source", "chunk").agg(F.array_sort(F.collect_list("u")).alias("us"))
    taken: list[DataFrame] = [certain]
    level = 0
    while True:
        folded = cut(folded.select("source", "chunk", _fold(F.col("us"), level).alias("r")), f"level{level}")
        taken.append(folded.select(F.explode("r.won").alias("uid")))
        left = folded.where("r.open is not null").select("source", "chunk", "r.open")
        if most <= 1:
            break
        most = -(-most // FAN)
        level += 1
        # A unit keeps its place: chunks are in order of size class, and so are their residuals.
        folded = left.select("source", F.floor(F.col("chunk") / FAN).alias("to"), F.struct("chunk", "open.uid", "open.mass", "open.room").alias("u")).groupBy("source", F.col("to").alias("chunk")).agg(F.array_sort(F.collect_list("u")).alias("us"))
    last = hash_fraction(F.col("open.uid"), SEED) < F.col("open.mass") / F.col("open.room")
    taken.append(left.where(last).select("open.uid"))
    won = taken[0]
    for more in taken[1:]:
        won = won.union(more)

    won = won.select(F.col("uid").alias("won_uid"), F.lit(1).alias("more"))
    out = rows.withColumn("uid", uid).join(won, F.col("uid") == F.col("won_uid"), "left").join(per_source, F.col("source").eqNullSafe(F.col("s")))
    drawn = F.when((F.col("size") == 0) & (hash_fraction(F.col("uid"), SEED) < F.col("fraction")), 1).otherwise(0)
    copies = (F.col("whole") + drawn + F.coalesce("more", F.lit(0))).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def apply(docs: DataFrame) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (rows not taken go)."""
    return shielded(docs, ("doc_id", "text", "source"), _repeat)


def _repeat(docs: DataFrame) -> DataFrame:
    plan = mix(docs).select("doc_id", "source", "size", "copies").distinct().where("copies > 0")
    plan = plan.select(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"), F.col("copies").alias("_mix_copies"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_mix_id")) & F.col("source").cast("string").eqNullSafe(F.col("_mix_source")) & (size_of(F.col("text")) == F.col("_mix_size"))
    return docs.join(plan, on).select(*docs.columns, F.explode(F.sequence(F.lit(1), "_mix_copies")).alias("_mix_copy")).drop("_mix_copy")


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
