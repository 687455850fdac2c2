"""Generated documents and training batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicon import CLINICAL_VI, DIAGNOSIS, DRUG
from ..operators import batches as B
from ..operators import generate as G
from ..operators import link as K
from . import views as V
from .corpus import _u32
from .linking import ORACLE_SQL as LINKING

FILLERS = ("Seen today, no change.", "Plan to be told tomorrow.", "Stable.")


def _catalog(spark, d):
    """Nations as diagnoses and parts as drugs."""
    n = V.load(spark, d, "nation").select(F.lit(DIAGNOSIS).alias("type"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.concat(F.lit("N"), "n_nationkey").alias("code"))
    return n.union(V.load(spark, d, "part").select(F.lit(DRUG), F.col("p_partkey").cast("long"), "p_name", F.concat(F.lit("P"), "p_partkey")))


def _frames(spark, d):
    """The first words of benchmark items around slots; some begin with a cue."""
    ws = F.split("text", " ")
    cue = F.when(F.col("item_id") % 7 == 0, "không có ").when(F.col("item_id") % 7 == 1, "tiền sử ").otherwise("")
    one = F.concat(cue, F.get(ws, F.lit(0)), F.lit(f" {{{DIAGNOSIS}}} "), F.get(ws, F.lit(1)), F.when(F.col("item_id") % 2 == 0, f" {{{DRUG}}}").otherwise(""))
    return V.load(spark, d, "benchmark").select(one.alias("template"), (F.col("item_id") % 5 + 1).alias("freq")).groupBy("template").agg(F.sum("freq").alias("freq"))


def _headers(spark, d):
    return V.load(spark, d, "nation").select(F.concat("n_name", F.lit(":")).alias("text"), (F.col("n_regionkey") + 1).alias("freq"))


def _told(docs):
    """Digests of documents, their labels, and concepts that don't stand where they say."""
    label = lambda x: F.size(F.filter("concepts", lambda c: F.array_contains(c["assertions"], x)))
    wrong = F.filter("concepts", lambda c: F.substring(F.col("text"), c["start"] + 1, c["end"] - c["start"]) != c["text"])
    return docs.select(
        "doc_id", "target", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), F.size("concepts").alias("n_concepts"),
        label("isNegated").alias("n_negated"), label("isHistorical").alias("n_historical"), label("isFamily").alias("n_family"), F.size(wrong).alias("n_wrong"),
    )


def frame_docs(spark, d):
    """A document for every one there is, from frames, headers and fillers."""
    ids = V.load(spark, d, "documents").select("doc_id")
    return _told(G.frame_documents(ids, _frames(spark, d), _headers(spark, d), FILLERS, _catalog(spark, d), CLINICAL_VI))


TEMPLATES = (
    G.Template(("History", "Known:"), (G.Slot(DIAGNOSIS, label="isHistorical"),), 1, 4, ("- ", "    - ", "")),
    G.Template(("Now",), (G.Slot(DIAGNOSIS, cues=("no", "denies"), cue_share=0.25, cue_label="isNegated"),), 2, 5, ("- ", ""), (",\n", "\n", ", ")),
    G.Template(("Drugs",), (G.Slot(DRUG), G.Slot(DIAGNOSIS, before=(" for ",), share=0.5)), 1, 4),
)


def note_docs(spark, d):
    """A document for every one there is, from templates and fillers, with glue."""
    ids = V.load(spark, d, "documents").select("doc_id")
    return _told(G.note_documents(ids, TEMPLATES, FILLERS, _catalog(spark, d)))


def contrastive_batches(spark, d):
    """Every vector as an anchor of its label, with three negatives: near ones of other labels, then the batch's."""
    e = V.load(spark, d, "embeddings")
    pairs = e.select(F.col("label").alias("code"), F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    hard = K.hard_negatives(e, 2, 6).select(F.col("vec_id").alias("a"), "nth", "negative").where("a % 3 > 0")
    out = B.padded_negatives(B.contrastive_batches(pairs, 32), hard, 3)
    return out.select("batch", "slot", F.col("code").alias("label"), F.col("a").alias("vec_id"), F.array_join(F.col("hard").cast("array<string>"), ",").alias("hard"))


QUERIES = {f.__name__: f for f in (frame_docs, note_docs, contrastive_batches)}


def _u(*keys: str) -> str:
    return _u32("'1|' || " + " || '|' || ".join(keys))


_LABEL = f"CASE WHEN {_u('doc_id', 'step', 'spot', chr(39) + 'label' + chr(39))} < 0.73 THEN 'isHistorical' WHEN {_u('doc_id', 'step', 'spot', chr(39) + 'label' + chr(39))} < 0.96 THEN 'isNegated' ELSE 'isFamily' END"
_FILL = "[" + ", ".join("'" + f + "'" for f in FILLERS) + "]"

ORACLE_SQL = {
    "frame_docs": f"""
WITH fw AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark),
fr AS (SELECT CASE item_id % 7 WHEN 0 THEN 'không có ' WHEN 1 THEN 'tiền sử ' ELSE '' END || ws[1] || ' {{{DIAGNOSIS}}} ' || ws[2] || CASE WHEN item_id % 2 = 0 THEN ' {{{DRUG}}}' ELSE '' END AS template, sum(item_id % 5 + 1) AS freq FROM fw GROUP BY 1),
fh AS (SELECT *, sum(freq) OVER (ORDER BY freq DESC, template) / sum(freq) OVER () AS high, (sum(freq) OVER (ORDER BY freq DESC, template) - freq) / sum(freq) OVER () AS low FROM fr),
hr AS (SELECT n_name || ':' AS template, n_regionkey + 1 AS freq FROM nation),
hh AS (SELECT *, sum(freq) OVER (ORDER BY freq DESC, template) / sum(freq) OVER () AS high, (sum(freq) OVER (ORDER BY freq DESC, template) - freq) / sum(freq) OVER () AS low FROM hr),
sh AS (SELECT least((SELECT min(length(regexp_replace(template, '\\{{[^}}]*\\}}', '', 'g'))) FROM fr), (SELECT min(length(template)) FROM hr), {min(map(len, FILLERS))}) + 1 AS shortest),
n AS (SELECT DISTINCT doc_id FROM documents),
t AS (SELECT doc_id, least(greatest(floor(exp(7.11::DOUBLE + 0.62::DOUBLE * sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {_u('doc_id', "'n1'")})) * cos(2 * pi() * {_u('doc_id', "'n2'")}))), 182), 5702)::INTEGER AS target FROM n),
s AS (SELECT doc_id, target, unnest(range(least(120, ceil(target / shortest))::BIGINT)) AS step FROM t, sh),
r AS (SELECT *, {_u('doc_id', 'step', "'kind'")} AS r, {_u('doc_id', 'step', "'pick'")} AS u FROM s),
x AS (SELECT r.*, template, regexp_extract_all(template, '\\{{([^}}]*)\\}}', 1) AS types, string_split_regex(template, '\\{{[^}}]*\\}}') AS pieces FROM r JOIN fh ON r >= 0.45 AND u >= low AND u < high),
ent AS (SELECT doc_id, target, step, template, 2 * i - 1 AS spot, types[i] AS type FROM (SELECT *, unnest(range(1, len(types) + 1)) AS i FROM x)),
cat AS (SELECT '{DIAGNOSIS}' AS type, n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT '{DRUG}', p_partkey, p_name FROM part),
named AS (SELECT doc_id, target, step, spot, name AS text, e.type,
    CASE WHEN contains(template, 'không có') THEN 'isNegated' WHEN contains(template, 'tiền sử') THEN 'isHistorical'
         WHEN {_u('doc_id', 'step', 'spot', "'has'")} < CASE e.type WHEN '{DIAGNOSIS}' THEN 0.818 ELSE 0.7 END THEN {_LABEL} END AS label
    FROM ent e JOIN (SELECT type, count(*) AS size FROM cat GROUP BY type) z ON z.type = e.type JOIN cat ON cat.type = e.type AND cat.k = floor({_u('doc_id', 'step', 'spot', "'name'")} * size)),
p AS (
    SELECT doc_id, target, step, 0 AS spot, template || chr(10) AS text, NULL AS type, NULL AS label FROM r JOIN hh ON r < 0.15 AND u >= low AND u < high
    UNION ALL SELECT doc_id, target, step, 0, {_FILL}[floor({_u('doc_id', 'step', "'filler'")} * {len(FILLERS)})::BIGINT + 1] || chr(10), NULL, NULL FROM r WHERE r >= 0.15 AND r < 0.45
    UNION ALL SELECT doc_id, target, step, 2 * i - 2, pieces[i], NULL, NULL FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM x)
    UNION ALL SELECT doc_id, target, step, 1000, chr(10), NULL, NULL FROM x
    UNION ALL SELECT * FROM named
),
o AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY step, spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
k AS (SELECT *, min(start) OVER (PARTITION BY doc_id, step) AS begun FROM o)
SELECT doc_id, target, length(string_agg(text, '' ORDER BY step, spot))::INTEGER AS n_chars, md5(string_agg(text, '' ORDER BY step, spot)) AS text_md5, count(type)::INTEGER AS n_concepts,
       count(*) FILTER (WHERE label = 'isNegated')::INTEGER AS n_negated, count(*) FILTER (WHERE label = 'isHistorical')::INTEGER AS n_historical, count(*) FILTER (WHERE label = 'isFamily')::INTEGER AS n_family, 0::INTEGER AS n_wrong
FROM k WHERE begun < target GROUP BY doc_id, target""",
    "contrastive_batches": "WITH near AS (" + LINKING["hard_negatives"].replace("nth <= 3", "nth <= 2").replace("n <= 9", "n <= 8") + """
), h AS (SELECT vec_id, list(negative ORDER BY nth) AS own FROM near WHERE vec_id % 3 > 0 GROUP BY vec_id),
z AS (SELECT count(*) AS n, max(c) AS most FROM (SELECT label, count(*) OVER (PARTITION BY label) AS c FROM embeddings WHERE label IS NOT NULL)),
o AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5('1|' || label), label, md5('1|' || vec_id || '|' || (vec_id + 1)), vec_id) - 1 AS place FROM embeddings WHERE label IS NOT NULL),
b AS (SELECT vec_id, label, place % m AS batch, place // m AS slot FROM o, (SELECT greatest(1, (n + 31) // 32, most) AS m FROM z)),
g AS (SELECT b.*, list(vec_id) OVER (PARTITION BY batch ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ring, coalesce(own, []) AS own FROM b LEFT JOIN h USING (vec_id))
SELECT batch, slot, label, vec_id, array_to_string(list_concat(own, list_transform(range(3), lambda i: ring[(slot + 1 + i % (len(ring) - 1)) % len(ring) + 1]))[1:3], ',') AS hard FROM g""",
}
