"""Reports on predictions, labels and texts, and the smaller helpers of linking and training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import ASSERTIONS, PLAIN
from ..operators import gold as G
from ..operators import lines as L
from ..operators import link as K
from ..operators import profile as P
from ..operators import score
from ..operators import spans as S
from ..operators import synth
from ..plans import pipelines
from . import linking, scoring, texts
from . import spans as spans_
from . import views as V


def diagnosis_report(spark, d):
    return G.diagnosis_report(*scoring._both(spark, d), ["doc_id"], ("CHẨN_ĐOÁN", "THUỐC"))


def diagnosis_examples(spark, d):
    return G.diagnosis_examples(*scoring._both(spark, d), ["doc_id"], 8)


def _annotated(spark, d):
    """Items of every document: the last words of its lines; every ninth is spoilt, some are anchored or counted."""
    n = F.col("line_no")
    item = F.element_at(F.split("line", " "), -1)
    rows = V.all_lines(spark, d).where("line <> '' and line not like '% '")
    return rows.select(
        "doc_id", n.cast("long").alias("k"), F.when(n % 9 == 8, F.concat(item, F.lit("#"))).otherwise(item).alias("item"), V._type(n).alias("type"),
        F.when(n % 4 == 1, F.substring_index("line", " ", 1)).alias("after"), F.when(n % 5 == 2, n % 3 + 1).cast("int").alias("occ"),
        F.array().cast("array<string>").alias("assertions"), F.array().cast("array<string>").alias("candidates"),
    )


def gold_build(spark, d):
    concepts, _ = G.build_gold(_annotated(spark, d), V.load(spark, d, "documents"))
    return concepts.select("doc_id", "text", "type", "start", "end")


def gold_report(spark, d):
    items = _annotated(spark, d)
    return G.gold_report(items, *G.build_gold(items, V.load(spark, d, "documents")))


def dense_lexical_max(spark, d):
    """Vector candidates by label, and a lexical hit of a fixed score for each query."""
    q, t = linking._vectors(spark, d)
    lexical = q.select("query_id", (F.floor(F.col("query_id") / 20) % 10).cast("string").alias("code"))
    vectors = K.dense(q, t, 50).select("query_id", "code", "score")
    return K.best_of(lexical, vectors, 0.45, 0.9, 3).select("query_id", "rank", "code", F.round("score", 6).alias("score"))


def assertion_labels(spark, d):
    """Gold assertions as many-hot vectors, and the labels of made scores that reach one half."""
    g = V.gold_spans(spark, d)
    scores = F.array(*[(x % 10) / 10 for x in (F.col("idx") * 7, F.col("idx") * 3, F.col("doc_id") + F.col("idx"))])
    hot = F.array_join(F.transform(X.multi_hot(F.col("assertions"), ASSERTIONS), lambda x: x.cast("int").cast("string")), "")
    return g.select("doc_id", "idx", hot.alias("hot"), F.array_join(X.labels_over(scores, ASSERTIONS), ",").alias("over"))


def garbage_items(spark, d):
    items = L.items(V.all_lines(spark, d)).withColumn("bad", X.is_garbage(F.col("item"), F.length("item") % 3 == 0, PLAIN))
    return items.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.count_if("bad").alias("n_garbage"))


def forced_labels(spark, d):
    """What the cues of each line demand, as of a template."""
    return V.all_lines(spark, d).groupBy("doc_id").agg(*[F.count_if(X.forced_label(F.col("line"), PLAIN).eqNullSafe(F.lit(x))).alias(n) for x, n in (("isNegated", "n_negated"), ("isHistorical", "n_historical"), (None, "n_free"))])


def clean_generated(spark, d):
    """Turns as a generator might give them: fenced, with a lead-in, or as they are."""
    k = F.col("turn") % 3
    raw = F.when(k == 0, F.concat(F.lit("```text\n"), "text", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Sure, as asked:\n"), "text")).otherwise(F.col("text"))
    return V.load(spark, d, "conversations").select("conv_id", "turn", F.md5(X.clean_generated(raw)).alias("clean_md5"))


def described_concepts(spark, d):
    k = F.col("p_partkey")
    some = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type"))
    told = X.describe_concept(F.col("p_name"), some, F.col("p_brand"), F.when(k % 2 == 0, "").otherwise("block"), F.col("p_type"), F.when(k % 5 == 0, "").otherwise(F.upper("p_name")))
    return V.load(spark, d, "part").select("p_partkey", told.alias("description"))


def slue_errors(spark, d):
    t = scoring._tags(spark, d).withColumn("sent_id", F.concat_ws("-", "doc_id", "line_no"))
    side = lambda c: score.numbered_tuples(t.select("sent_id", "pos", "word", F.col(c).alias("tag")))
    return score.error_rows(side("gold_tag"), side("pred_tag"), V.all_lines(spark, d).select(F.concat_ws("-", "doc_id", "line_no").alias("sent_id"), F.md5("line").alias("line_md5")))


def piece_labels(spark, d):
    """Words of five letters or more are two pieces; a separator stands before each line."""
    words = V.all_lines(spark, d).select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("at", "word"))
    word = F.col("line_no") * 100_000 + F.col("at") + 1
    long = F.length("word") >= 5
    pieces = words.select("doc_id", word.cast("long").alias("word_id"), (F.length("word") % 3).alias("label"), F.explode(F.when(long, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("j"))
    pieces = pieces.select("doc_id", (F.col("word_id") * 2 + F.col("j")).alias("pos"), "word_id", "label")
    marks = V.all_lines(spark, d).select("doc_id", (F.col("line_no") * 200_000).cast("long").alias("pos"), F.lit(None).cast("long").alias("word_id"), F.lit(7).alias("label"))
    return S.first_piece_labels(pieces.union(marks)).groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


def token_classifier(spark, d):
    """Mentions of a made classifier: gold spans as tags, in windows of three lines that share one, with made confidences."""
    docs = V.load(spark, d, "documents")
    t = spans_._tagged(spark, d, False)
    line = F.floor(F.col("pos") / 100_000)
    windows = F.array_distinct(F.array(F.floor(line / 2), F.floor((line - 1) / 2)))
    prob = 0.9 + ((F.col("pos") + F.col("doc_id")) % 10) / 100
    tokens = t.select("doc_id", F.explode(windows).alias("window"), "place", "pos", "ts", "te", "tag", prob.alias("prob")).where("window >= 0")
    found = pipelines.from_logits(tokens, docs, PLAIN, 0.94)
    return found.select("doc_id", "text", "type", "start", "end", F.round("conf", 6).alias("conf"), "section")


def flagged_files(spark, d):
    flags = texts.feature_flags(spark, d)
    return P.files_where(flags, *[c for c in flags.columns if c != "doc_id"])


def name_catalog(spark, d):
    return synth.name_catalog(V.load(spark, d, "part").select(F.col("p_partkey").alias("code"), F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 4 == 0, "(old)"), "p_type").alias("name")), 4)


QUERIES = {
    f.__name__: f
    for f in (
        diagnosis_report, diagnosis_examples, gold_build, gold_report, dense_lexical_max, assertion_labels, garbage_items, forced_labels, clean_generated, described_concepts, slue_errors, piece_labels,
        token_classifier, flagged_files, name_catalog,
    )
}

_DIAG = scoring.ORACLE_SQL["boundary_diag"].rsplit("SELECT coalesce(gt, pt)", 1)[0]
_TOLD = _DIAG.replace("SELECT g.type AS gt,", "SELECT g.doc_id, g.idx AS gi, g.text AS gold, p.text AS pred, g.type AS gt,")
_KINDS = "('CHẨN_ĐOÁN', 'THUỐC')"
_SOME = _DIAG.replace("FROM gold g JOIN pred p", f"FROM (SELECT * FROM gold WHERE type IN {_KINDS}) g JOIN pred p").replace("FROM gold g LEFT JOIN m", f"FROM (SELECT * FROM gold WHERE type IN {_KINDS}) g LEFT JOIN m")
_ITEM = "trim(x, ' ' || chr(9) || '.-*+•')"
_GOLD = "WITH RECURSIVE " + V.LINES + f""",
i AS (SELECT doc_id, line_no AS k, string_split(line, ' ')[-1] || CASE WHEN line_no % 9 = 8 THEN '#' ELSE '' END AS item, {V._TYPE_SQL}[line_no % 5 + 1] AS type,
      CASE WHEN line_no % 4 = 1 THEN string_split(line, ' ')[1] END AS after, CASE WHEN line_no % 5 = 2 THEN line_no % 3 + 1 END AS occ,
      row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM lines WHERE line <> '' AND line NOT LIKE '% '),
c AS (SELECT i.*, text, CASE WHEN instr(text, after) > 0 THEN instr(text, after) - 1 + length(after) END AS anchor,
      CASE WHEN occ IS NULL THEN NULL ELSE list_reduce([0::BIGINT, 1, 2, 3][1:occ + 1], lambda p, j: CASE WHEN p < 0 OR instr(substr(text, p + 1), item) = 0 THEN -1 ELSE p + instr(substr(text, p + 1), item) END) - 1 END AS nth
      FROM i JOIN documents USING (doc_id)),
f(doc_id, n, k, spot, item, type, past) AS (
    SELECT DISTINCT doc_id, 0::BIGINT, NULL::INTEGER, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT FROM documents
    UNION ALL
    SELECT doc_id, n, k, spot, item, type, CASE WHEN spot >= 0 THEN spot + length(item) ELSE past END FROM (
        SELECT f.doc_id, c.n, c.k, c.item, c.type, f.past,
               CASE WHEN occ IS NOT NULL THEN greatest(nth, -1)
                    WHEN instr(substr(text, coalesce(anchor, f.past) + 1), c.item) > 0 THEN coalesce(anchor, f.past) + instr(substr(text, coalesce(anchor, f.past) + 1), c.item) - 1
                    ELSE instr(text, c.item) - 1 END AS spot
        FROM f JOIN c ON c.doc_id = f.doc_id AND c.n = f.n + 1)
)"""

ORACLE_SQL = {
    "diagnosis_report": _SOME + f""",
k2 AS (SELECT *, coalesce(gt, pt) AS type, CASE WHEN kind = 'boundary' THEN CASE WHEN gs <> ps AND ge <> pe THEN 'both' WHEN gs <> ps THEN 'left' ELSE 'right' END END AS side FROM k WHERE kind <> 'spurious' OR pt IN {_KINDS})
SELECT 'total' AS part, NULL AS type, kind, count(*) AS n, CASE WHEN kind <> 'spurious' THEN round(count(*) / (SELECT count(*) FROM k2 WHERE kind <> 'spurious'), 6) END AS share FROM k2 GROUP BY kind
UNION ALL SELECT 'type', type, kind, count(*), NULL FROM k2 WHERE kind <> 'spurious' GROUP BY type, kind
UNION ALL SELECT 'side', NULL, side, count(*), NULL FROM k2 WHERE side IS NOT NULL GROUP BY side""",
    "diagnosis_examples": _TOLD + """,
f2 AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id, gi)::INTEGER AS nth FROM k WHERE kind IN ('boundary', 'wrong_type', 'missed'))
SELECT kind, nth, doc_id, gi, gold, pred FROM f2 WHERE nth <= 8""",
    "gold_build": _GOLD + """
SELECT doc_id, item AS text, type, spot AS start, spot + length(item) AS "end" FROM f WHERE n > 0 AND spot >= 0""",
    "gold_report": _GOLD + """
SELECT count(DISTINCT doc_id) AS n_docs, count(*) FILTER (WHERE spot >= 0) AS n_concepts, count(*) FILTER (WHERE spot < 0) AS n_faults FROM f WHERE n > 0""",
    "dense_lexical_max": "WITH " + linking._DENSE + """,
u AS (SELECT query_id, code, score * 0.9::DOUBLE AS score FROM c UNION ALL SELECT vec_id, ((vec_id // 20) % 10)::VARCHAR, 0.45 FROM embeddings WHERE vec_id % 20 = 0),
b AS (SELECT query_id, code, max(score) AS score FROM u GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code)::INTEGER AS rank FROM b)
SELECT query_id, rank, code, round(score, 6) AS score FROM z WHERE rank <= 3""",
    "assertion_labels": "WITH " + V.BASE + "," + V.GOLD + """
SELECT doc_id, idx, (list_contains(assertions, 'isHistorical'))::INT || '' || (list_contains(assertions, 'isNegated'))::INT || (list_contains(assertions, 'isFamily'))::INT AS hot,
       array_to_string(list_filter([CASE WHEN (idx * 7) % 10 >= 5 THEN 'isHistorical' END, CASE WHEN (idx * 3) % 10 >= 5 THEN 'isNegated' END, CASE WHEN (doc_id + idx) % 10 >= 5 THEN 'isFamily' END], lambda x: x IS NOT NULL), ',') AS over FROM gold""",
    "garbage_items": "WITH " + V.LINES + f""",
m AS (SELECT doc_id, unnest(regexp_extract_all(line, '[^,;]+')) AS x FROM lines),
t AS (SELECT doc_id, {_ITEM} AS item FROM m WHERE trim({_ITEM}) <> '')
SELECT doc_id, count(*) AS n_items, count(*) FILTER (WHERE length(trim(item)) < 2 OR trim(regexp_replace(lower(item), '\\s+', ' ', 'g')) IN {PLAIN.stop_spans!r}
       OR (length(item) % 3 <> 0 AND regexp_matches(trim(item), '^[^\\p{{L}}\\p{{M}}_]+$'))) AS n_garbage FROM t GROUP BY doc_id""",
    "forced_labels": "WITH " + V.LINES + f""",
c AS (SELECT doc_id, CASE WHEN regexp_matches(regexp_replace(line, '(?i){PLAIN.negation_false}', ' ', 'g'), '(?i){PLAIN.negation}') THEN 'N' WHEN regexp_matches(line, '(?i){PLAIN.history}') THEN 'H' END AS x FROM lines)
SELECT doc_id, count(*) FILTER (WHERE x = 'N') AS n_negated, count(*) FILTER (WHERE x = 'H') AS n_historical, count(*) FILTER (WHERE x IS NULL) AS n_free FROM c GROUP BY doc_id""",
    "clean_generated": r"SELECT conv_id, turn, CASE WHEN NOT regexp_matches(text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]') THEN md5(trim(text, ' ')) END AS clean_md5 FROM conversations",
    "described_concepts": """
SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' (also: ' || p_brand || ', ' || p_type || ')' END || ' ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ', block' END
       || CASE WHEN p_type = '' THEN '' ELSE ', ' || p_type END || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '. ' || upper(p_name) END AS description FROM part""",
    "slue_errors": scoring._TAGS + """,
s AS (SELECT doc_id || '-' || line_no AS sent_id, * FROM tags),
g AS (SELECT sent_id, gold_tag[3:] AS tag, string_agg(word, chr(9) ORDER BY word) AS gold FROM s WHERE gold_tag <> 'O' GROUP BY ALL),
p AS (SELECT sent_id, pred_tag[3:] AS tag, string_agg(word, chr(9) ORDER BY word) AS pred FROM s WHERE pred_tag <> 'O' GROUP BY ALL)
SELECT sent_id, tag, coalesce(gold, '') AS gold, coalesce(pred, '') AS pred, line_md5 FROM g FULL JOIN p USING (sent_id, tag) JOIN (SELECT doc_id || '-' || line_no AS sent_id, md5(line) AS line_md5 FROM lines) USING (sent_id) WHERE coalesce(gold, '') <> coalesce(pred, '')""",
    "piece_labels": "WITH " + V.LINES + """,
w AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1)::BIGINT AS spot FROM lines),
p AS (SELECT doc_id, (line_no * 100000::BIGINT + spot) * 2 AS pos, length(word) % 3 AS label FROM w
      UNION ALL SELECT doc_id, (line_no * 100000::BIGINT + spot) * 2 + 1, -100 FROM w WHERE length(word) >= 5
      UNION ALL SELECT doc_id, line_no * 200000::BIGINT, -100 FROM lines)
SELECT doc_id, label::INTEGER AS label, count(*) AS n, sum(pos)::BIGINT AS places FROM p GROUP BY doc_id, label""",
    "flagged_files": "SELECT flag, doc_id FROM (UNPIVOT (" + texts.ORACLE_SQL["feature_flags"] + ") ON COLUMNS(* EXCLUDE doc_id) INTO NAME flag VALUE held) WHERE held",
    "name_catalog": r"""
WITH t AS (SELECT p_partkey AS code, p_name || CASE WHEN p_partkey % 4 = 0 THEN ' (old)' ELSE '' END || ' ' || p_type AS name FROM part)
SELECT * FROM t WHERE len(list_filter(string_split(name, ' '), lambda w: w <> '')) <= 4 AND NOT regexp_matches(name, '[\[\](){}†*]|[A-Z]\d{2}')""",
}
