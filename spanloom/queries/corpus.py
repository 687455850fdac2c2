"""Corpus hygiene, synthetic documents, terminology extracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import hygiene as H
from ..operators import profile as P
from ..operators import lines as L
from ..operators import synth as S
from . import views as V


def _docs(spark, d):
    return V.load(spark, d, "documents")


def _distinct_docs(spark, d, classes=None):
    """One document of each class of equal texts."""
    docs = _docs(spark, d)
    classes = H.text_classes(docs) if classes is None else classes
    return docs.join(classes.where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi")


def ngram13_leakage(spark, d):
    return H.leakage(_docs(spark, d), V.load(spark, d, "benchmark"), 13)


def lcs_leakage(spark, d):
    return H.lcs_leakage(_docs(spark, d), V.load(spark, d, "benchmark")).select("item_id", F.round("best", 6).alias("best"), "longest_run")


def reuse_ratio(spark, d):
    return H.reuse_ratio(_docs(spark, d), 7).withColumn("ratio", F.round("ratio", 6))


def text_classes(spark, d):
    return H.text_classes(_docs(spark, d))


def reuse_pairs(spark, d):
    return H.contained_pairs(_distinct_docs(spark, d), 0.45).select("a", "b", "shared", F.round("containment", 6).alias("containment"), F.round("jaccard", 6).alias("jaccard"))


def reuse_runs(spark, d):
    """Reused pairs with their longest common run of words, as digests of the excerpts."""
    docs = _distinct_docs(spark, d)
    pairs = H.contained_pairs(docs, 0.12).where("shared >= 40").select("a", "b", "shared", F.round("containment", 6).alias("containment"))
    return H.longest_runs(pairs, docs).select("a", "b", "shared", "containment", "run", "run_a", F.md5("excerpt").alias("excerpt_md5"))


def nearest_doc(spark, d):
    """For every document the nearest other text, by the smallest id that has it; copies share their class's row."""
    classes = H.shared_table(H.text_classes(_docs(spark, d)), "members")
    near = H.nearest_documents(_distinct_docs(spark, d, classes)).withColumnRenamed("doc_id", "class_id")
    return classes.join(near, "class_id").select("doc_id", "class_id", "other", F.round("containment", 6).alias("containment"), "n_strong")


def reuse_components(spark, d):
    return H.components(H.contained_pairs(_distinct_docs(spark, d), 0.45).select("a", "b"))


def repeated_lines(spark, d):
    return H.repeated_lines(V.all_lines(spark, d)).select(F.md5("line").alias("line_md5"), "n_docs", "n_occurrences")


def repeats_within(spark, d):
    return H.repeats_within(V.all_lines(spark, d))


def trigram_dedup(spark, d):
    return H.greedy_keep(_docs(spark, d).select("doc_id", "text")).select("doc_id")


def qa_overlap(spark, d):
    return H.qa_overlap(V.load(spark, d, "conversations")).select("conv_id", F.round("jaccard", 6).alias("jaccard"), F.round("overlap", 6).alias("overlap"))


def set_cover(spark, d):
    m = P.measures(V.spread(_docs(spark, d).select("doc_id", "text")))
    told = P.flags(m)
    names = [c for c in told.columns if c != "doc_id"]
    features = told.select("doc_id", F.explode(F.array(*[F.when(F.col(c), c) for c in names])).alias("feature")).where("feature is not null")
    return H.set_cover(features, m.select("doc_id", "chars"), names, list(P.RARE))


def mined_frames(spark, d):
    """Lines with their capitalised words blanked, as frames."""
    b = V.all_lines(spark, d).select(F.regexp_replace("line", r"[A-Z][a-z]+", "{CAP}").alias("line"))
    return L.mine_frames(b).select("template", F.size("types").alias("n_slots"), "freq", "safe")


def _terms(spark, d):
    tty = F.element_at(F.array(F.lit("IN"), F.lit("BN"), F.lit("SCD"), F.lit("PIN")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return V.load(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), tty.alias("tty"))


def drug_catalog(spark, d):
    return S.drug_catalog(_terms(spark, d), 500)


def weighted_frames(spark, d):
    frames = V.load(spark, d, "part").groupBy(F.col("p_name").alias("template")).agg(F.count("*").alias("freq"))
    draws = spark.range(1000).select("id", S.draw(3, "id").alias("u"))
    return S.weighted_choice(frames, draws).groupBy("template").agg(F.count("*").alias("n"))


def template_docs(spark, d):
    catalog = V.load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.lit("DRUG").alias("type"))
    docs = S.template_documents(spark, 200, catalog)
    one = docs.select("doc_id", "text", F.inline("concepts").alias("c", "type", "start", "end"))
    return one.select("doc_id", F.col("c").alias("mention"), F.col("start").cast("long").alias("start"), (F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("c")).alias("in_place"))


def mix_ratio(spark, d):
    n = V.load(spark, d, "documents").select(F.lit(1).alias("n_frames"), F.regexp_count("text", F.lit("[A-Z][a-z]+")).alias("a"), F.lit(0).alias("b"))
    m = V.load(spark, d, "benchmark").select(F.lit(0), F.lit(0), F.regexp_count("text", F.lit("[a-z]+")))
    both = n.union(m).agg(F.sum("n_frames").alias("n_frames"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.select(S.mixing_count(F.col("a"), F.col("b"), F.col("n_frames"), 0.3).alias("take"))


def composed_drugs(spark, d):
    return V.load(spark, d, "part").select("p_partkey", S.compose_drug(F.col("p_name"), 5, F.col("p_partkey")).alias("mention"))


QUERIES = {
    f.__name__: f
    for f in (
        ngram13_leakage, lcs_leakage, reuse_ratio, text_classes, reuse_pairs, reuse_runs, nearest_doc, reuse_components, repeated_lines, repeats_within, trigram_dedup, qa_overlap,
        set_cover, mined_frames, drug_catalog, weighted_frames, template_docs, mix_ratio, composed_drugs,
    )
}

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')"
_NORM = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"


def _grams(table: str, key: str, n: int, distinct: bool = True) -> str:
    g = f"list_transform(range(1, greatest(len(ws) - {n - 2}, 1)), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))"
    return f"SELECT {key}, unnest({'list_distinct(' + g + ')' if distinct else g}) AS sh FROM (SELECT {key}, {_TOK} AS ws FROM {table}) WHERE len(ws) >= {n}"


_CLASSES = f"classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_NORM}) AS class_id FROM documents)"
_PAIRS = f"""
{_CLASSES}, reps AS (SELECT d.* FROM documents d JOIN classes c ON d.doc_id = c.doc_id AND c.class_id = d.doc_id),
s AS ({_grams('reps', 'doc_id', 8)}), sz AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sh AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (SELECT a, b, shared, shared / least(p.n, q.n) AS containment, shared / (p.n + q.n - shared) AS jaccard FROM sh JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b)
"""


def _u32(expr: str) -> str:
    return f"(('0x' || substring(md5({expr}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


ORACLE_SQL = {
    "ngram13_leakage": f"WITH a AS ({_grams('documents', 'doc_id', 13, False)}), b AS ({_grams('benchmark', 'item_id', 13)}) SELECT doc_id, count(*) AS n_hits, count(DISTINCT item_id) AS n_items FROM a JOIN b USING (sh) GROUP BY doc_id",
    "reuse_ratio": f"WITH s AS ({_grams('documents', 'doc_id', 7)}), f AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1) SELECT doc_id, count(*) AS n_shingles, count(f.sh) AS n_reused, round(count(f.sh) / count(*), 6) AS ratio FROM s LEFT JOIN f USING (sh) GROUP BY doc_id",
    "text_classes": f"WITH {_CLASSES} SELECT * FROM classes",
    "reuse_pairs": f"WITH {_PAIRS} SELECT a, b, shared, round(containment, 6) AS containment, round(jaccard, 6) AS jaccard FROM pairs WHERE containment >= 0.45",
    "reuse_runs": f"""WITH {_PAIRS}, k AS (SELECT * FROM pairs WHERE shared >= 40 AND containment >= 0.12),
w AS (SELECT doc_id, {_TOK} AS ws FROM documents),
g AS (SELECT doc_id, i, hash(array_to_string(ws[i:i + 7], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w WHERE len(ws) >= 8)),
m AS (SELECT k.a, k.b, x.i, y.i AS j FROM k JOIN g x ON x.doc_id = k.a JOIN g y ON y.doc_id = k.b AND y.h = x.h),
o AS (SELECT *, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS island FROM m),
r AS (SELECT a, b, i - j AS d, island, min(i) AS i, count(*) + 7 AS run FROM o GROUP BY ALL),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY run DESC, i, d DESC) = 1)
SELECT f.a, f.b, shared, round(containment, 6) AS containment, run::INTEGER AS run, (i - 1)::INTEGER AS run_a, md5(array_to_string(ws[i:i + least(run, 28) - 1], ' ')) AS excerpt_md5
FROM f JOIN k ON k.a = f.a AND k.b = f.b JOIN w ON w.doc_id = f.a""",
    "nearest_doc": f"""WITH {_PAIRS}, u AS (SELECT a AS doc_id, b AS other, shared, containment FROM pairs UNION ALL SELECT b, a, shared, containment FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY containment DESC, other) AS n, count(*) FILTER (WHERE containment >= 0.3 AND shared >= 40) OVER (PARTITION BY doc_id) AS n_strong FROM u)
SELECT c.doc_id, class_id, other, round(containment, 6) AS containment, n_strong FROM classes c JOIN r ON r.doc_id = class_id WHERE n = 1""",
    "trigram_dedup": f"""
WITH w AS (SELECT doc_id, list_filter(string_split({_NORM}, ' '), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) BETWEEN 1 AND 2 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: array_to_string(ws[i:i + 2], ' ')) END)) AS sh FROM w),
sz AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN sz m ON m.doc_id = a JOIN sz n ON n.doc_id = b WHERE k / (m.n + n.n - k) >= 0.8),
l AS (SELECT b, list(a) AS smaller FROM e GROUP BY b),
f AS (SELECT list_reduce(list_prepend([]::STRUCT(b BIGINT, smaller BIGINT[])[], list([{{'b': b, 'smaller': smaller}}] ORDER BY b)),
      lambda acc, x: CASE WHEN len(list_filter(x[1].smaller, lambda a: NOT list_contains(list_transform(acc, lambda y: y.b), a))) > 0 THEN list_concat(acc, x) ELSE acc END) AS gone FROM l),
g AS (SELECT unnest(gone).b AS doc_id FROM f)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g)""",
    "reuse_components": f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs WHERE containment >= 0.45 UNION SELECT b, a FROM pairs WHERE containment >= 0.45),
w AS (SELECT a AS doc_id, a AS r FROM e UNION SELECT w.doc_id, e.b FROM w JOIN e ON w.r = e.a)
SELECT doc_id, min(r) AS component FROM w GROUP BY doc_id""",
    "repeated_lines": "WITH " + V.LINES + r""", n AS (SELECT doc_id, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS x FROM lines)
SELECT md5(x) AS line_md5, count(DISTINCT doc_id) AS n_docs, count(*) AS n_occurrences FROM n WHERE length(x) >= 45 GROUP BY x HAVING count(DISTINCT doc_id) >= 2""",
    "repeats_within": "WITH " + V.LINES + r""", n AS (SELECT doc_id, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS x FROM lines), c AS (SELECT doc_id, x, count(*) AS k FROM n WHERE length(x) >= 30 GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, count(*) AS n_types, sum(k - 1)::BIGINT AS n_extra FROM c GROUP BY doc_id""",
    "qa_overlap": f"""
WITH q AS (SELECT conv_id, turn AS qt, text AS q FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) = 1),
a AS (SELECT c.conv_id, q, c.text AS a FROM conversations c JOIN q USING (conv_id) WHERE role = 'assistant' AND turn > qt QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY turn, c.text) = 1),
w AS (SELECT conv_id, list_distinct(list_filter(string_split({_NORM.replace('text', 'q')}, ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split({_NORM.replace('text', 'a')}, ' '), lambda x: x <> '')) AS y FROM a)
SELECT conv_id, round(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard,
       round(CASE WHEN least(len(x), len(y)) > 0 THEN len(list_intersect(x, y))::DOUBLE / least(len(x), len(y)) ELSE 0.0 END, 6) AS overlap FROM w""",
    "mined_frames": "WITH " + V.LINES + r""",
t AS (SELECT trim(regexp_replace(regexp_replace(line, '[A-Z][a-z]+', '{CAP}', 'g'), '\s+', ' ', 'g')) AS template FROM lines),
c AS (SELECT template, count(*) AS freq, len(regexp_extract_all(template, '\{[^}]*\}')) AS k FROM t WHERE contains(template, '{') AND length(template) BETWEEN 3 AND 95 GROUP BY template HAVING count(*) >= 2)
SELECT template, k::INTEGER AS n_slots, freq, len(list_filter(string_split(trim(regexp_replace(regexp_replace(template, '\{[^}]*\}', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '')) <= 5 AS safe FROM c WHERE k < 2""",
    "drug_catalog": """
WITH t AS (SELECT p_partkey AS code, p_name AS name, ['IN', 'BN', 'SCD', 'PIN'][p_partkey % 4 + 1] AS tty FROM part)
SELECT * FROM t WHERE tty IN ('IN', 'PIN', 'BN') AND len(string_split(trim(name), ' ')) <= 5 ORDER BY md5('1|' || code || '|' || name), code LIMIT 500""",
    "weighted_frames": f"""
WITH f AS (SELECT p_name AS template, count(*) AS freq FROM part GROUP BY p_name),
h AS (SELECT template, sum(freq) OVER (ORDER BY freq DESC, template) / sum(freq) OVER () AS high, (sum(freq) OVER (ORDER BY freq DESC, template) - freq) / sum(freq) OVER () AS low FROM f),
d AS (SELECT {_u32("'3|' || i")} AS u FROM range(1000) r(i))
SELECT template, count(*) AS n FROM d JOIN h ON u >= low AND u < high GROUP BY template""",
    "template_docs": f"""
WITH r AS (SELECT i AS doc_id, l AS line FROM range(200) a(i), range(1, 5) b(l)),
c AS (SELECT doc_id, line, p_name AS mention FROM r JOIN part ON p_partkey = floor({_u32("'1|' || doc_id || '|' || line")} * (SELECT count(*) FROM part))),
o AS (SELECT doc_id, mention, length('Note ' || doc_id) + 1 + sum(length(mention) + 3) OVER (PARTITION BY doc_id ORDER BY line) - length(mention) - 1 AS s FROM c)
SELECT doc_id, mention, s::BIGINT AS start, true AS in_place FROM o""",
    "composed_drugs": f"""
WITH d AS (SELECT p_partkey, p_name, {_u32("'5|' || p_partkey || '|dose'")} AS a, {_u32("'5|' || p_partkey || '|mg'")} AS m, {_u32("'5|' || p_partkey || '|route'")} AS b, {_u32("'5|' || p_partkey || '|r'")} AS r FROM part)
SELECT p_partkey, p_name || CASE WHEN a < 0.6 THEN ' ' || ((floor(m * 20)::BIGINT + 1) * 5) || 'mg' ELSE '' END || CASE WHEN b < 0.5 THEN ' ' || ['po', 'iv', 'bid', 'daily'][floor(r * 4)::BIGINT + 1] ELSE '' END AS mention FROM d""",
    "mix_ratio": """
WITH n AS (SELECT count(*) AS nf, sum(len(regexp_extract_all(text, '[A-Z][a-z]+'))) AS a FROM documents), m AS (SELECT sum(len(regexp_extract_all(text, '[a-z]+'))) AS b FROM benchmark)
SELECT least(greatest(floor(0.3 / 0.7 * b / (a / nf) + 0.5), 1), nf)::BIGINT AS take FROM n, m""",
}
