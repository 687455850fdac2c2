"""Scores of predicted against gold spans, tags and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluate, score
from ..plans import pipelines
from . import views as V


def _r(df, *columns, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in columns})


_SCORES = ("text_score", "assertions_score", "candidates_score", "final_score")


def _both(spark, d):
    return V.gold_spans(spark, d), V.pred_spans(spark, d)


def greedy_match(spark, d):
    return score.greedy_match(*_both(spark, d), ["doc_id"])


def per_doc_report(spark, d):
    g, p = _both(spark, d)
    return _r(score.document_scores(g, p, g.select("doc_id").distinct(), ["doc_id"]), "text_score", "assertions_score", "cand_sum", "cand_weight")


def final_score(spark, d):
    g, p = _both(spark, d)
    return _r(pipelines.evaluate(g, p, g.select("doc_id").distinct()), *_SCORES)


def rescore_all(spark, d):
    g, p, out = V.gold_spans(spark, d), None, None
    for e in (0, 1, 2):
        g1, p1 = g.withColumn("exp", F.lit(e)), V.pred_spans(spark, d, e).withColumn("exp", F.lit(e))
        out, p = (g1, p1) if out is None else (out.union(g1), p.union(p1))
    keys = ["exp", "doc_id"]
    return _r(pipelines.evaluate(out, p, out.select(*keys).distinct(), keys), *_SCORES)


def boundary_diag(spark, d):
    g, p = _both(spark, d)
    return score.diagnose(g, p, ["doc_id"]).groupBy("type", "kind", F.coalesce("side", F.lit("-")).alias("side")).agg(F.count("*").alias("n"))


def entity_prf(spark, d):
    g, p = _both(spark, d)
    by = score.set_prf(g, p, ["doc_id", "type", "start", "end"])
    return _r(by.withColumn("type", F.coalesce("type", F.lit("(all)"))), "precision", "recall", "f1")


def prf_averages(spark, d):
    g, p = _both(spark, d)
    return _r(score.averages(score.set_prf(g, p, ["doc_id", "type", "start", "end"])), "precision", "recall", "f1")


def _gold_pred(pos):
    """The two tags of the word at place ``pos`` of a line."""
    n = F.col("doc_id") + F.col("line_no") + pos
    gold = F.when(pos == 0, "B-A").when((pos == 1) & (F.col("line_no") % 2 == 0), "I-A").when(pos == 4, "B-B").otherwise("O")
    return gold, F.when(n % 11 == 0, "O").when((n % 13 == 0) & (pos < 6), "B-B").otherwise(gold)


def _tags(spark, d):
    """Tags by word place: gold B on each line's first word, predictions by arithmetic."""
    words = V.all_lines(spark, d).select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("pos", "word"))
    gold, pred = _gold_pred(F.col("pos"))
    return words.select("doc_id", "line_no", "pos", "word", gold.alias("gold_tag"), pred.alias("pred_tag"))


def token_confusion(spark, d):
    return _r(score.token_confusion(_tags(spark, d)), "accuracy")


def slue(spark, d):
    t = _tags(spark, d).withColumn("sent_id", F.concat_ws("-", "doc_id", "line_no"))
    side = lambda c: score.numbered_tuples(t.select("sent_id", "pos", "word", F.col(c).alias("tag")))
    return _r(score.tuple_scores(side("gold_tag"), side("pred_tag")), "precision", "recall", "f1")


def seq2seq_eval(spark, d):
    """Lines as a generator tags them: some lose their last two words, some gain one; scored with and without words."""
    tagged = lambda w, pos: F.struct(w.alias("word"), *(c.alias(k) for c, k in zip(_gold_pred(pos), ("gold_tag", "pred_tag"), strict=True)))
    # No word of a line is empty or holds a star: told of the line, before its words are made.
    good = V.all_lines(spark, d).where("line_no % 35 <> 0 and line <> '' and not (line like ' %' or line like '% ' or line like '%  %' or line like '%*%')")
    whole = good.select("doc_id", "line_no", F.transform(F.split("line", " "), tagged).alias("x"))
    n, none = F.size("x"), F.array().cast("array<string>")
    col = lambda c: F.transform("x", lambda y: y[c])
    short = F.when(F.col("line_no") % 7 == 0, F.greatest(n - 2, F.lit(0))).otherwise(n)
    more = lambda v: F.when(F.col("line_no") % 5 == 0, F.array(F.lit(v))).otherwise(none)
    encoded = X.encode_tags(F.concat(F.slice(col("word"), F.lit(1), short), more("more")), F.concat(F.slice(col("pred_tag"), F.lit(1), short), more("B-A")))
    rows = whole.select(F.concat_ws("-", "doc_id", "line_no").alias("sent_id"), col("word").alias("words"), col("gold_tag").alias("gold"), encoded.alias("encoded"))
    return _r(evaluate.tag_scores(evaluate.sequence_tags(rows)), "precision", "recall", "f1")


def asr_scores(spark, d):
    """Tagged words against tagged hypotheses in which every fourth word is heard otherwise."""
    t = _tags(spark, d).withColumn("sent_id", F.concat_ws("-", "doc_id", "line_no"))
    heard = F.when(F.col("pos") % 4 == 3, F.concat("word", F.lit("x"))).otherwise(F.col("word"))
    gold, hyp = t.select("sent_id", "pos", "word", F.col("gold_tag").alias("tag")), t.select("sent_id", "pos", heard.alias("word"), F.col("pred_tag").alias("tag"))
    return _r(evaluate.both_scores(gold, hyp), "precision", "recall", "f1")


def multilabel_prf(spark, d):
    docs = V.load(spark, d, "documents").select("doc_id", (F.length("text") > 600).cast("int").alias("pred_quality"), F.lower("text").rlike("idiot|moron|stupid|scum").cast("int").alias("pred_toxic"))
    rows = V.load(spark, d, "labels").select("doc_id", F.col("quality").alias("gold_quality"), F.col("toxic").alias("gold_toxic")).join(docs, "doc_id")
    return _r(score.multilabel_prf(rows, ["quality", "toxic"]), "precision", "recall", "f1")


def label_balance(spark, d):
    return V.load(spark, d, "labels").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))


QUERIES = {f.__name__: f for f in (greedy_match, per_doc_report, final_score, rescore_all, boundary_diag, entity_prf, prf_averages, token_confusion, slue, seq2seq_eval, asr_scores, multilabel_prf, label_balance)}

_DIV = "CASE WHEN {b} = 0 THEN {a} ELSE {a} / {b} END"


def _prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    return f"(CASE WHEN {tp} + {fp} = 0 THEN {tp}::DOUBLE ELSE {tp}::DOUBLE / ({tp} + {fp}) END) AS precision, (CASE WHEN {tp} + {fn} = 0 THEN {tp}::DOUBLE ELSE {tp}::DOUBLE / ({tp} + {fn}) END) AS recall"


_F1 = "CASE WHEN precision + recall = 0 THEN 2 * precision * recall ELSE 2 * precision * recall / (precision + recall) END"

_ENTITY = (
    "WITH " + V.SPANS + f""",
g AS (SELECT DISTINCT doc_id, type, start, "end", 1 AS g FROM gold), p AS (SELECT DISTINCT doc_id, type, start, "end", 1 AS p FROM pred),
both_ AS (SELECT type, g, p FROM g FULL JOIN p USING (doc_id, type, start, "end")),
counts AS (SELECT type, count(*) FILTER (WHERE g = 1 AND p = 1) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn FROM both_ GROUP BY ROLLUP (type)),
rates AS (SELECT type, {_prf()}, tp + fn AS support FROM counts),
full_ AS (SELECT *, {_F1} AS f1 FROM rates)
"""
)

_TAGS = (
    "WITH " + V.LINES + """,
words AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) - 1 AS pos FROM lines),
golded AS (SELECT *, CASE WHEN pos = 0 THEN 'B-A' WHEN pos = 1 AND line_no % 2 = 0 THEN 'I-A' WHEN pos = 4 THEN 'B-B' ELSE 'O' END AS gold_tag FROM words),
tags AS (SELECT *, CASE WHEN (doc_id + line_no + pos) % 11 = 0 THEN 'O' WHEN (doc_id + line_no + pos) % 13 = 0 AND pos < 6 THEN 'B-B' ELSE gold_tag END AS pred_tag FROM golded)
"""
)


def _final(prefix: str = "") -> str:
    return f"""
SELECT {prefix} round(ts, 6) AS text_score, round(sa, 6) AS assertions_score, round(c, 6) AS candidates_score, round(0.3 * ts + 0.3 * sa + 0.4 * c, 6) AS final_score
FROM (SELECT avg(text_score) AS ts, avg(assertions_score) AS sa, CASE WHEN sum(cand_weight) > 0 THEN sum(cand_sum) / sum(cand_weight) ELSE 1.0 END AS c FROM doc_scores)"""




def _both_sql(source: str) -> str:
    """Tuple scores of ``source(sent, pos, gold_word, gold_tag, pred_word, pred_tag)``, with words and without."""
    parts = []
    for kind, g, p in (("words", "gold_word", "pred_word"), ("dummy", "'dummy'", "'dummy'")):
        parts.append(f"""(WITH gt AS (SELECT sent, gold_tag[3:] AS tag, {g} AS word, row_number() OVER (PARTITION BY sent, gold_tag[3:], {g} ORDER BY pos) AS nth, 1 AS g FROM {source} WHERE gold_tag NOT IN ('O', '0')),
pt AS (SELECT sent, pred_tag[3:] AS tag, {p} AS word, row_number() OVER (PARTITION BY sent, pred_tag[3:], {p} ORDER BY pos) AS nth, 1 AS p FROM {source} WHERE pred_tag NOT IN ('O', '0')),
counts AS (SELECT tag, count(*) FILTER (WHERE g = 1 AND p = 1) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn FROM gt FULL JOIN pt USING (sent, tag, word, nth) GROUP BY ROLLUP (tag)),
rates AS (SELECT tag, {_prf()} FROM counts), full_ AS (SELECT *, {_F1} AS f1 FROM rates)
SELECT '{kind}' AS kind, tag, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM full_ WHERE tag IS NOT NULL
UNION ALL SELECT '{kind}', 'overall_micro', round(precision, 6), round(recall, 6), round(f1, 6) FROM full_ WHERE tag IS NULL
UNION ALL SELECT '{kind}', 'overall_macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM full_ WHERE tag IS NOT NULL)""")
    return " UNION ALL ".join(parts)


ORACLE_SQL = {
    "seq2seq_eval": _TAGS + """,
ok AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE word = '' OR contains(word, '*')) OVER w AS bad FROM tags WHERE line_no % 35 <> 0 WINDOW w AS (PARTITION BY doc_id, line_no)),
src AS (SELECT doc_id || '-' || line_no AS sent, pos, word AS gold_word, gold_tag, word AS pred_word, CASE WHEN line_no % 7 = 0 AND pos >= n - 2 THEN '0' ELSE pred_tag END AS pred_tag FROM ok WHERE bad = 0)
""" + _both_sql("src"),
    "asr_scores": _TAGS + ", src AS (SELECT doc_id || '-' || line_no AS sent, pos, word AS gold_word, gold_tag, word || CASE WHEN pos % 4 = 3 THEN 'x' ELSE '' END AS pred_word, pred_tag FROM tags) " + _both_sql("src"),
    "greedy_match": "WITH " + V.SPANS + "," + V.MATCH + " SELECT doc_id, gi, pi FROM matched",
    "per_doc_report": "WITH " + V.SPANS + "," + V.MATCH + "," + V.DOC_SCORES + " SELECT doc_id, round(text_score, 6) AS text_score, round(assertions_score, 6) AS assertions_score, round(cand_sum, 6) AS cand_sum, round(cand_weight, 6) AS cand_weight FROM doc_scores",
    "final_score": "WITH " + V.SPANS + "," + V.MATCH + "," + V.DOC_SCORES + _final(),
    "rescore_all": " UNION ALL ".join(f"(WITH {V.BASE},{V.GOLD},{V.pred_sql(str(e))},{V.MATCH},{V.DOC_SCORES}{_final(f'{e} AS exp,')})" for e in (0, 1, 2)),
    "entity_prf": _ENTITY + " SELECT coalesce(type, '(all)') AS type, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM full_",
    "prf_averages": _ENTITY + """
SELECT 'micro' AS average, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM full_ WHERE type IS NULL
UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM full_ WHERE type IS NOT NULL
UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM full_ WHERE type IS NOT NULL""",
    "boundary_diag": "WITH " + V.SPANS + """,
e AS (SELECT g.doc_id, g.idx AS gi, p.idx AS pi, least(g."end", p."end") - greatest(g.start, p.start) AS o FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND g.start < p."end" AND g."end" > p.start),
f AS (SELECT doc_id, list_reduce(list_prepend([]::STRUCT(gi BIGINT, pi BIGINT)[], list([{'gi': gi, 'pi': pi}] ORDER BY gi, o DESC, pi)),
        lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.gi = x[1].gi OR a.pi = x[1].pi)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM e GROUP BY doc_id),
m AS (SELECT doc_id, unnest(kept).gi AS gi, unnest(kept).pi AS pi FROM f),
j AS (SELECT g.type AS gt, p.type AS pt, g.start AS gs, p.start AS ps, g."end" AS ge, p."end" AS pe
      FROM gold g LEFT JOIN m ON g.doc_id = m.doc_id AND g.idx = m.gi FULL JOIN pred p ON p.doc_id = m.doc_id AND p.idx = m.pi),
k AS (SELECT *, CASE WHEN gt IS NULL THEN 'spurious' WHEN pt IS NULL THEN 'missed' WHEN gt <> pt THEN 'wrong_type' WHEN gs <> ps OR ge <> pe THEN 'boundary' ELSE 'exact' END AS kind FROM j)
SELECT coalesce(gt, pt) AS type, kind, CASE WHEN kind = 'boundary' THEN CASE WHEN gs <> ps AND ge <> pe THEN 'both' WHEN gs <> ps THEN 'left' ELSE 'right' END ELSE '-' END AS side, count(*) AS n
FROM k GROUP BY ALL""",
    "token_confusion": _TAGS + """
SELECT round(count(*) FILTER (WHERE gold_tag = pred_tag) / count(*), 6) AS accuracy, count(*) FILTER (WHERE gold_tag = pred_tag AND gold_tag <> 'O') AS tp,
       count(*) FILTER (WHERE gold_tag <> pred_tag AND pred_tag <> 'O') AS fp, count(*) FILTER (WHERE gold_tag <> 'O' AND pred_tag = 'O') AS fn,
       count(*) FILTER (WHERE gold_tag = 'O' AND pred_tag = 'O') AS tn FROM tags""",
    "slue": _TAGS + f""",
gt AS (SELECT doc_id, line_no, gold_tag[3:] AS tag, word, row_number() OVER (PARTITION BY doc_id, line_no, gold_tag[3:], word ORDER BY pos) AS nth, 1 AS g FROM tags WHERE gold_tag <> 'O'),
pt AS (SELECT doc_id, line_no, pred_tag[3:] AS tag, word, row_number() OVER (PARTITION BY doc_id, line_no, pred_tag[3:], word ORDER BY pos) AS nth, 1 AS p FROM tags WHERE pred_tag <> 'O'),
counts AS (SELECT tag, count(*) FILTER (WHERE g = 1 AND p = 1) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn FROM gt FULL JOIN pt USING (doc_id, line_no, tag, word, nth) GROUP BY ROLLUP (tag)),
rates AS (SELECT tag, {_prf()} FROM counts), full_ AS (SELECT *, {_F1} AS f1 FROM rates)
SELECT tag, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM full_ WHERE tag IS NOT NULL
UNION ALL SELECT 'overall_micro', round(precision, 6), round(recall, 6), round(f1, 6) FROM full_ WHERE tag IS NULL
UNION ALL SELECT 'overall_macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM full_ WHERE tag IS NOT NULL""",
    "multilabel_prf": f"""
WITH r AS (SELECT l.quality AS gq, l.toxic AS gx, (length(text) > 600)::INT AS pq, regexp_matches(lower(text), 'idiot|moron|stupid|scum')::INT AS px FROM labels l JOIN documents USING (doc_id)),
c AS (SELECT 'quality' AS label, count(*) FILTER (WHERE gq = 1 AND pq = 1) AS tp, count(*) FILTER (WHERE gq <> 1 AND pq = 1) AS fp, count(*) FILTER (WHERE gq = 1 AND pq <> 1) AS fn FROM r
      UNION ALL SELECT 'toxic', count(*) FILTER (WHERE gx = 1 AND px = 1), count(*) FILTER (WHERE gx <> 1 AND px = 1), count(*) FILTER (WHERE gx = 1 AND px <> 1) FROM r),
rates AS (SELECT label, {_prf()} FROM c), full_ AS (SELECT *, {_F1} AS f1 FROM rates)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM full_
UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM full_""",
    "label_balance": "SELECT round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels",
}
