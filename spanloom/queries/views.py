"""Views that stand in for annotated notes on the driver's tables, in Spark and in SQL alike.

Gold spans are the first one to three words of every line of six words or more; predictions drop, widen,
retype and add some of them, all by arithmetic on doc_id and line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import TYPES
from ..operators.lines import lines


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(load(spark, sf_dir, "documents"))


def _type(n):
    return F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.pmod(n, F.lit(5)) + 1).cast("int"))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = F.split("line", " ")
    return all_lines(spark, sf_dir).withColumn("ws", ws).where(F.size("ws") >= 6).withColumn("k", 1 + F.col("line_no") % 3)


def gold_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _base(spark, sf_dir).withColumn("text", F.array_join(F.slice("ws", F.lit(1), F.col("k")), " "))
    r = F.col("line_no") % 4
    asserted = F.filter(F.array(F.when(r >= 2, F.lit("isHistorical")), F.when(r % 2 == 1, F.lit("isNegated"))), lambda x: x.isNotNull())
    return b.select(
        "doc_id", F.col("line_no").cast("long").alias("idx"), _type(F.col("doc_id") + F.col("line_no")).alias("type"), "start",
        (F.col("start") + F.length("text")).alias("end"), "text", asserted.alias("assertions"), F.array(F.concat(F.lit("C"), (F.col("line_no") % 7).cast("string"))).alias("codes"),
    )


def pred_spans(spark: SparkSession, sf_dir: str, exp: int = 0) -> DataFrame:
    d, n = F.col("doc_id"), F.col("line_no")
    b = _base(spark, sf_dir)
    k = F.col("k") + F.when((d + n) % 4 == 0, 1).otherwise(0)
    text = F.array_join(F.slice("ws", F.lit(1), k), " ")
    r = n % 4
    asserted = F.filter(F.array(F.when((r >= 2) & (n % 5 != 0), F.lit("isHistorical")), F.when((r % 2 == 1) & (n % 5 != 0), F.lit("isNegated"))), lambda x: x.isNotNull())
    kept = b.where((d + (3 + exp) * n) % 7 != 0).select(
        "doc_id", n.cast("long").alias("idx"), _type(d + n + F.when((d * n) % 11 == 0, 1).otherwise(0)).alias("type"), "start", (F.col("start") + F.length(text)).alias("end"),
        text.alias("text"), asserted.alias("assertions"), F.array(F.concat(F.lit("C"), ((n + F.when(n % 3 == 0, 1).otherwise(0)) % 7).cast("string"))).alias("codes"),
    )
    last = F.element_at("ws", -1)
    extra = b.where(((d + n) % 9 == 0) & (last != "")).select(
        "doc_id", (n + 100000).cast("long").alias("idx"), _type(d).alias("type"), (F.col("start") + F.length("line") - F.length(last)).alias("start"), (F.col("start") + F.length("line")).alias("end"),
        last.alias("text"), F.array().cast("array<string>").alias("assertions"), F.array(F.lit("C9")).alias("codes"),
    )
    return kept.union(extra)


_TYPE_SQL = "['" + "', '".join(TYPES) + "']"

LINES = """
lines AS (
    SELECT doc_id, line_no, line,
           coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS line_no FROM documents)
)"""

BASE = LINES + """,
base AS (
    SELECT *, 1 + line_no % 3 AS k FROM (SELECT *, string_split(line, ' ') AS ws FROM lines) WHERE len(ws) >= 6
)"""

GOLD = f"""
gold AS (
    SELECT doc_id, line_no::BIGINT AS idx, {_TYPE_SQL}[(doc_id + line_no) % 5 + 1] AS type, start, start + length(text) AS "end", text,
           list_filter([CASE WHEN line_no % 4 >= 2 THEN 'isHistorical' END, CASE WHEN line_no % 2 = 1 THEN 'isNegated' END], lambda x: x IS NOT NULL) AS assertions,
           ['C' || (line_no % 7)] AS codes
    FROM (SELECT *, array_to_string(ws[1:k], ' ') AS text FROM base)
)"""


def pred_sql(exp: str = "0") -> str:
    return f"""
pred AS (
    SELECT doc_id, line_no::BIGINT AS idx, {_TYPE_SQL}[(doc_id + line_no + CASE WHEN (doc_id * line_no) % 11 = 0 THEN 1 ELSE 0 END) % 5 + 1] AS type,
           start, start + length(text) AS "end", text,
           list_filter([CASE WHEN line_no % 4 >= 2 AND line_no % 5 <> 0 THEN 'isHistorical' END, CASE WHEN line_no % 2 = 1 AND line_no % 5 <> 0 THEN 'isNegated' END], lambda x: x IS NOT NULL) AS assertions,
           ['C' || ((line_no + CASE WHEN line_no % 3 = 0 THEN 1 ELSE 0 END) % 7)] AS codes
    FROM (SELECT *, array_to_string(ws[1:k + CASE WHEN (doc_id + line_no) % 4 = 0 THEN 1 ELSE 0 END], ' ') AS text FROM base WHERE (doc_id + (3 + {exp}) * line_no) % 7 <> 0)
    UNION ALL
    SELECT doc_id, line_no + 100000, {_TYPE_SQL}[doc_id % 5 + 1], start + length(line) - length(ws[-1]), start + length(line), ws[-1], [], ['C9']
    FROM base WHERE (doc_id + line_no) % 9 = 0 AND ws[-1] <> ''
)"""


SPANS = BASE + "," + GOLD + "," + pred_sql()

#: Greedy one-to-one matching as a fold over each document's sorted edges.
MATCH = """
edges AS (
    SELECT doc_id, gi, pi, max(s) AS s FROM (
        SELECT g.doc_id, g.idx AS gi, p.idx AS pi,
               CASE WHEN lower(g.text) = lower(p.text) THEN 2.0::DOUBLE
                    ELSE greatest(least(g."end", p."end") - greatest(g.start, p.start), 0)::DOUBLE / (greatest(g."end", p."end") - least(g.start, p.start)) END AS s
        FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND g.type = p.type
    ) WHERE s > 0.5 GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, pi DESC, gi DESC) AS n FROM edges
), RECURSIVE_FOLD AS (
    SELECT doc_id, list_reduce(list_prepend([]::STRUCT(gi BIGINT, pi BIGINT)[], list([{'gi': gi, 'pi': pi}] ORDER BY n)),
        lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.gi = x[1].gi OR a.pi = x[1].pi)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept
    FROM ranked GROUP BY doc_id
), matched AS (
    SELECT doc_id, unnest(kept).gi AS gi, unnest(kept).pi AS pi FROM RECURSIVE_FOLD
)"""

#: Documents' scores from gold, pred and matched.
DOC_SCORES = """
pairs AS (
    SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, g.idx AS gi, p.idx AS pi, g.type AS gt, p.type AS pt, g.text AS gx, p.text AS px,
           g.assertions AS ga, p.assertions AS pa, g.codes AS gc, p.codes AS pc
    FROM gold g LEFT JOIN matched m ON g.doc_id = m.doc_id AND g.idx = m.gi
    FULL JOIN pred p ON p.doc_id = m.doc_id AND p.idx = m.pi
), worded AS (
    SELECT *, list_filter(string_split(lower(gx), ' '), lambda w: w <> '') AS gw, list_filter(string_split(lower(px), ' '), lambda w: w <> '') AS pw FROM pairs
), numbered AS (
    SELECT *, list_distinct(list_concat(gw, pw)) AS v FROM worded
), scored AS (
    SELECT *,
        CASE WHEN gi IS NOT NULL AND pi IS NOT NULL THEN greatest(0, 1 - levenshtein(
            array_to_string(list_transform(gw, lambda w: chr((list_position(v, w) + 64)::INTEGER)), ''),
            array_to_string(list_transform(pw, lambda w: chr((list_position(v, w) + 64)::INTEGER)), ''))::DOUBLE / greatest(len(gw), 1)) END AS hit,
        CASE WHEN coalesce(gt, pt) IN ('CHẨN_ĐOÁN', 'THUỐC', 'TRIỆU_CHỨNG') THEN
            CASE WHEN len(coalesce(ga, [])) = 0 AND len(coalesce(pa, [])) = 0 THEN 1.0
                 ELSE len(list_intersect(coalesce(ga, []), coalesce(pa, [])))::DOUBLE / len(list_distinct(list_concat(coalesce(ga, []), coalesce(pa, [])))) END END AS aj,
        CASE WHEN gi IS NOT NULL THEN len(gc) + 1 ELSE 1 END AS w, coalesce(gt, pt) IN ('CHẨN_ĐOÁN', 'THUỐC') AS coded,
        CASE WHEN len(coalesce(gc, [])) = 0 AND len(coalesce(pc, [])) = 0 THEN 1.0
             ELSE len(list_intersect(coalesce(gc, []), coalesce(pc, [])))::DOUBLE / len(list_distinct(list_concat(coalesce(gc, []), coalesce(pc, [])))) END AS cj
    FROM numbered
), sums AS (
    SELECT doc_id, coalesce(sum(hit), 0) AS hits, count(gi) AS ng, count(pi) AS np, avg(aj) AS aj, sum(cj * w) FILTER (WHERE coded) AS cs, (sum(w) FILTER (WHERE coded))::DOUBLE AS cw FROM scored GROUP BY doc_id
), doc_scores AS (
    SELECT d.doc_id, CASE WHEN greatest(ng, np) > 0 THEN hits / greatest(ng, np) ELSE 1.0 END AS text_score, coalesce(aj, 1.0) AS assertions_score,
           coalesce(cs, 0.0) AS cand_sum, coalesce(cw, 0.0) AS cand_weight
    FROM (SELECT DISTINCT doc_id FROM gold) d LEFT JOIN sums USING (doc_id)
)"""


def spread(df):
    """``df`` over all cores if its files give fewer partitions than there are (one small file is one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
