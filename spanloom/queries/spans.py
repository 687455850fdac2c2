"""Spans: coding, suppression, sections, assertions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import PLAIN
from ..operators import assertions as A
from ..operators import lines as L
from ..operators import rules
from ..operators import spans as S
from ..plans import pipelines
from ..sources import io
from . import views as V


def _docs(spark, d):
    return V.load(spark, d, "documents")


def _tagged(spark, d, outside=True):
    """Word tokens of lines, with offsets, tagged by the gold spans."""
    return S.bio_texts(_docs(spark, d), V.gold_spans(spark, d), outside)


def bio_encode(spark, d):
    return _tagged(spark, d, False).select("doc_id", "pos", "tag")


def bio_decode(spark, d):
    """Gold spans encoded and decoded again."""
    tags = _tagged(spark, d, False).withColumn("prob", F.when(F.col("pos") % 2 == 0, 0.5).otherwise(1.0))
    return S.bio_decode(tags).select("doc_id", "type", "start", "end", F.round("conf", 6).alias("conf"))


def chunk_tags(spark, d):
    words = V.all_lines(spark, d).select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("p", "w"))
    n = F.col("doc_id") + F.col("line_no") + F.col("p")
    tag = F.when(n % 7 == 0, "B-A").when(n % 7 == 1, "I-A").when(n % 7 == 2, "I-B").otherwise("O")
    t = words.select(F.concat_ws("-", "doc_id", "line_no").alias("doc_id"), F.col("p").cast("long").alias("pos"), tag.alias("tag"))
    return S.chunks(t).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start") + 1).alias("n_words"))


def span_nms(spark, d):
    """Gold and predicted spans together, each with a confidence, the best kept."""
    g = V.gold_spans(spark, d).select("doc_id", "type", "start", "end", F.round(0.5 + F.pmod(F.col("idx") * 37 + F.col("doc_id"), F.lit(50)) / 100, 2).alias("conf"))
    p = V.pred_spans(spark, d).select("doc_id", "type", "start", "end", F.round(0.5 + F.pmod(F.col("idx") * 53 + F.col("doc_id"), F.lit(50)) / 100, 2).alias("conf"))
    return S.suppress(g.union(p)).select("doc_id", "start", "end", "type", "conf")


def newline_split(spark, d):
    whole = _docs(spark, d).select("doc_id", F.lit(0).cast("long").alias("start"), "text")
    return L.newline_pieces(whole).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("text").alias("text_md5"))


def span_dedup(spark, d):
    g, p = V.gold_spans(spark, d).withColumn("src", F.lit(0)), V.pred_spans(spark, d).withColumn("src", F.lit(1))
    return S.first_of(g.union(p), "src").select("doc_id", "type", "start", "end", "src")


def offset_invariant(spark, d):
    return S.offset_faults(V.gold_spans(spark, d).union(V.pred_spans(spark, d)), _docs(spark, d))


def section_carry(spark, d):
    s = L.sections(V.all_lines(spark, d), PLAIN)
    return s.select("doc_id", "line_no", "top")


def section_reset(spark, d):
    return L.sections(V.all_lines(spark, d), PLAIN).groupBy(F.coalesce("top", F.lit("-")).alias("top"), F.coalesce("sub", F.lit("-")).alias("sub")).agg(F.count("*").alias("n"))


def section_lookup(spark, d):
    s = L.sections(V.all_lines(spark, d), PLAIN)
    found = S.section_at(V.pred_spans(spark, d).select("doc_id", "start", "idx"), s)
    return found.select("doc_id", "idx", "start", "section")


def cue_assertions(spark, d):
    ls = V.all_lines(spark, d)
    b = V.gold_spans(spark, d).select("doc_id", F.col("idx").cast("int").alias("line_no"), F.col("start").alias("s"), "end")
    j = ls.join(b, ["doc_id", "line_no"])
    own = A.assertions(F.col("line"), F.col("s") - F.col("start"), F.col("end") - F.col("start"), F.lit(None).cast("string"), PLAIN)
    return j.select("doc_id", "line_no", F.array_join(own, "+").alias("assertions"))


def mark_context(spark, d):
    g = V.pred_spans(spark, d).join(_docs(spark, d).select("doc_id", F.col("text").alias("raw")), "doc_id")
    marked = X.mark_context(F.col("raw"), F.col("start").cast("int"), F.col("end").cast("int"))
    return g.select("doc_id", "idx", F.md5(marked).alias("context_md5"))


def snap_word(spark, d):
    """Predicted spans cut by a character on either side and snapped back."""
    g = V.gold_spans(spark, d).where(F.length("text") > 2).join(_docs(spark, d).select("doc_id", F.col("text").alias("raw")), "doc_id")
    s = X.snap_to_words(F.col("raw"), (F.col("start") + 1).cast("int"), (F.col("end") - 1).cast("int"))
    return g.select("doc_id", "idx", s["start"].alias("start"), s["end"].alias("end"))


def rule_extract(spark, d):
    return rules.extract(_docs(spark, d), PLAIN).groupBy("type").agg(F.count("*").alias("n"))


def rule_pipeline(spark, d):
    return pipelines.predict(_docs(spark, d), PLAIN)


def concept_json(spark, d):
    g = V.gold_spans(spark, d).withColumnRenamed("codes", "candidates")
    return io.concept_json(g).select("doc_id", F.md5("json").alias("json_md5"))


def mask_entities(spark, d):
    tags = _tagged(spark, d).select("doc_id", "pos", "tag", F.lit("x").alias("token"))
    return S.mask_entities(tags, 0.3, 7).groupBy("tag", "token").agg(F.count("*").alias("n"))


def assertion_combinations(spark, d):
    from ..operators.profile import assertion_combinations as combos

    return combos(V.gold_spans(spark, d))


def span_density(spark, d):
    from ..operators.profile import span_density as density

    return density(V.gold_spans(spark, d), _docs(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        bio_encode, bio_decode, chunk_tags, span_nms, newline_split, span_dedup, offset_invariant, section_carry, section_reset, section_lookup, cue_assertions,
        mark_context, snap_word, rule_extract, rule_pipeline, concept_json, mask_entities, assertion_combinations, span_density,
    )
}

_TOKENS = "WITH " + V.BASE + "," + V.GOLD + r""",
tm AS (SELECT doc_id, line_no, start, regexp_extract_all(line, '\S+') AS ms, list_transform(string_split_regex(line, '\S+'), lambda x: length(x)) AS gs FROM lines),
te0 AS (SELECT doc_id, line_no, start, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS i FROM tm),
tokens AS (SELECT doc_id, line_no::BIGINT * 100000 + i - 1 AS pos, start + sum(gap + length(m)) OVER (PARTITION BY doc_id, line_no ORDER BY i) - length(m) AS ts, start + sum(gap + length(m)) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS te FROM te0),
tagged AS (SELECT t.doc_id, t.pos, t.ts, t.te, min(struct_pack(s := g.start, e := g."end", ty := g.type)) AS sp FROM tokens t LEFT JOIN gold g ON t.doc_id = g.doc_id AND t.ts < g."end" AND t.te > g.start GROUP BY ALL),
tags AS (SELECT doc_id, pos, ts, te, CASE WHEN sp IS NULL OR sp.s IS NULL THEN 'O' WHEN ts <= sp.s THEN 'B-' || sp.ty ELSE 'I-' || sp.ty END AS tag FROM tagged)
"""

_HEADS = "CASE " + " ".join(f"WHEN regexp_matches(n, '{p}') THEN {{'top': {('NULL' if t is None else repr(t))}::VARCHAR, 'sub': {('NULL' if s is None else repr(s))}::VARCHAR}}" for p, t, s in PLAIN.headers) + " END"
_LABEL = PLAIN.label.replace("'", "''")
_SECTIONS = "WITH " + V.LINES + rf""",
lab AS (SELECT *, nullif(regexp_extract(lower(line), '{_LABEL}', 1), '') AS label FROM lines),
nrm AS (SELECT *, trim(regexp_replace(lower(coalesce(label, line)), '\s+', ' ', 'g')) AS n FROM lab),
hd AS (SELECT *, CASE WHEN trim(line) <> '' THEN {_HEADS} END AS h FROM nrm),
ef AS (SELECT *, CASE WHEN h.sub IS NOT NULL THEN {{'v': h.sub}} WHEN h.top IS NOT NULL AND label IS NULL THEN {{'v': NULL::VARCHAR}} END AS eff FROM hd),
sec AS (SELECT doc_id, line_no, start, line, last_value(h.top IGNORE NULLS) OVER w AS top, (last_value(eff IGNORE NULLS) OVER w).v AS sub FROM ef
        WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""

ORACLE_SQL = {
    "concept_json": "WITH " + V.BASE + "," + V.GOLD + """,
j AS (SELECT doc_id, start, "end", '{"text":' || to_json(text) || ',"type":' || to_json(type)
      || CASE WHEN type IN ('CHẨN_ĐOÁN', 'THUỐC') THEN ',"candidates":' || to_json(codes) ELSE '' END
      || CASE WHEN type IN ('CHẨN_ĐOÁN', 'THUỐC', 'TRIỆU_CHỨNG') THEN ',"assertions":' || to_json(assertions) ELSE '' END
      || ',"position":[' || start || ',' || "end" || ']}' AS c FROM gold)
SELECT doc_id, md5('[' || string_agg(c, ',' ORDER BY start, "end") || ']') AS json_md5 FROM j GROUP BY doc_id""",
    "bio_encode": _TOKENS + " SELECT doc_id, pos, tag FROM tags WHERE tag <> 'O'",
    "bio_decode": _TOKENS + """,
k AS (SELECT *, CASE WHEN tag <> 'O' THEN tag[3:] END AS kind FROM tags),
b AS (SELECT *, CASE WHEN tag[1:2] = 'B-' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS beg FROM k),
i AS (SELECT *, sum(beg) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM b)
SELECT doc_id, kind AS type, min(ts)::BIGINT AS start, max(te)::BIGINT AS "end", round(avg(CASE WHEN pos % 2 = 0 THEN 0.5 ELSE 1.0 END), 6) AS conf FROM i WHERE kind IS NOT NULL GROUP BY doc_id, island, kind""",
    "chunk_tags": "WITH " + V.LINES + """,
w AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS x, generate_subscripts(string_split(line, ' '), 1) - 1 AS p FROM lines),
t AS (SELECT *, (doc_id + line_no + p) % 7 AS n FROM w),
g AS (SELECT *, CASE n WHEN 0 THEN 'B' WHEN 1 THEN 'I' WHEN 2 THEN 'I' ELSE 'O' END AS a, CASE n WHEN 0 THEN 'A' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'O' END AS kind FROM t),
l AS (SELECT *, coalesce(lag(a) OVER w, 'O') AS a0, coalesce(lag(kind) OVER w, 'O') AS k0 FROM g WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY p)),
b AS (SELECT *, CASE WHEN a <> 'O' AND (a = 'B' OR a0 = 'O' OR k0 <> kind) THEN 1 ELSE 0 END AS beg FROM l)
SELECT kind AS type, sum(beg)::BIGINT AS n, count(*) AS n_words FROM b WHERE a <> 'O' GROUP BY kind""",
    "span_nms": "WITH " + V.SPANS + """,
u AS (SELECT doc_id, type, start, "end" AS e, round(0.5 + ((idx * 37 + doc_id) % 50) / 100, 2) AS conf FROM gold UNION ALL SELECT doc_id, type, start, "end", round(0.5 + ((idx * 53 + doc_id) % 50) / 100, 2) FROM pred),
f AS (SELECT doc_id, list_reduce(list_prepend([]::STRUCT(s BIGINT, e BIGINT, t VARCHAR, c DOUBLE)[], list([{'s': start, 'e': e, 't': type, 'c': conf}] ORDER BY conf DESC, e - start DESC, start, e, type)),
    lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.s < x[1].e AND a.e > x[1].s)) > 0 THEN acc ELSE list_concat(acc, x) END) AS k FROM u GROUP BY doc_id),
o AS (SELECT doc_id, unnest(k) AS x FROM f)
SELECT doc_id, x.s AS start, x.e AS "end", x.t AS type, x.c AS conf FROM o""",
    "newline_split": "WITH " + V.LINES + r""",
b AS (SELECT doc_id, start, line, regexp_replace(line, '^\s*(?:[-*+•]|\d+[.)])\s*', '') AS body FROM lines),
t AS (SELECT doc_id, start + length(line) - length(regexp_replace(body, '^\s+', '')) AS s, regexp_replace(regexp_replace(body, '^\s+', ''), '\s+$', '') AS x FROM b)
SELECT doc_id, s::BIGINT AS start, (s + length(x))::BIGINT AS "end", md5(x) AS text_md5 FROM t WHERE x <> ''""",
    "span_dedup": "WITH " + V.SPANS + """, u AS (SELECT doc_id, type, start, "end", 0 AS src FROM gold UNION ALL SELECT doc_id, type, start, "end", 1 FROM pred)
SELECT doc_id, type, start, "end", min(src) AS src FROM u GROUP BY ALL""",
    "offset_invariant": "WITH " + V.SPANS + """, u AS (SELECT doc_id, start, "end", text AS x FROM gold UNION ALL SELECT doc_id, start, "end", text FROM pred)
SELECT count(*) AS n, count(*) FILTER (WHERE substring(d.text, u.start + 1, u."end" - u.start) <> x) AS faults FROM u JOIN documents d USING (doc_id)""",
    "section_carry": _SECTIONS + " SELECT doc_id, line_no, top FROM sec",
    "section_reset": _SECTIONS + " SELECT coalesce(top, '-') AS top, coalesce(sub, '-') AS sub, count(*) AS n FROM sec GROUP BY 1, 2",
    "section_lookup": _SECTIONS.replace("WITH " + V.LINES, "WITH " + V.SPANS, 1) + """
SELECT p.doc_id, p.idx, p.start, s.top AS section FROM pred p LEFT JOIN sec s ON s.doc_id = p.doc_id AND s.start <= p.start AND p.start <= s.start + length(s.line)""",
    "cue_assertions": "WITH " + V.BASE + "," + V.GOLD + rf""",
j AS (SELECT l.doc_id, l.line_no, lower(l.line) AS line, (g.start - l.start)::BIGINT AS s, (g."end" - l.start)::BIGINT AS e FROM lines l JOIN gold g ON l.doc_id = g.doc_id AND l.line_no = g.idx)
SELECT doc_id, line_no, array_to_string(list_filter([
    CASE WHEN regexp_matches(substring(line, greatest(s - 100, 0) + 1, least(e + 40, length(line)) - greatest(s - 100, 0)), '{PLAIN.history}') THEN 'isHistorical' END,
    CASE WHEN regexp_matches(regexp_replace(substring(line, 1, e), '{PLAIN.negation_false}', ' ', 'g'), '{PLAIN.negation}') THEN 'isNegated' END,
    CASE WHEN regexp_matches(line, '{PLAIN.family}') AND NOT regexp_matches(line, '{PLAIN.narrator}') THEN 'isFamily' END], lambda x: x IS NOT NULL), '+') AS assertions FROM j""",
    "mark_context": "WITH " + V.SPANS + r""",
j AS (SELECT p.doc_id, p.idx, d.text AS raw, p.start AS s, p."end" AS e, greatest(p.start - 180, 0) AS lo, least(p."end" + 80, length(d.text)) AS hi FROM pred p JOIN documents d USING (doc_id)),
c AS (SELECT *, substring(raw, lo + 1, s - lo) AS l, substring(raw, e + 1, hi - e) AS r FROM j)
SELECT doc_id, idx, md5(CASE WHEN lo > 0 AND instr(l, ' ') > 0 THEN l[instr(l, ' ') + 1:] ELSE l END || ' [ENT] ' || substring(raw, s + 1, e - s) || ' [/ENT] '
    || CASE WHEN hi < length(raw) AND instr(r, ' ') > 0 THEN regexp_replace(r, '(?s) [^ ]*$', '') ELSE r END) AS context_md5 FROM c""",
    "mask_entities": _TOKENS + """,
g AS (SELECT *, sum(CASE WHEN tag[1:2] = 'I-' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM tags)
SELECT tag, CASE WHEN tag <> 'O' AND ('0x' || substring(md5('7|' || doc_id || '|' || grp::BIGINT), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3 THEN '[MASK]' ELSE 'x' END AS token, count(*) AS n FROM g GROUP BY ALL""",
    "assertion_combinations": "WITH " + V.BASE + "," + V.GOLD + """, k AS (SELECT CASE WHEN len(assertions) = 0 THEN '(empty)' ELSE array_to_string(list_sort(assertions), '+') END AS combination FROM gold)
SELECT combination, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM k GROUP BY combination""",
    "span_density": "WITH " + V.BASE + "," + V.GOLD + """, n AS (SELECT d.doc_id, count(g.doc_id) AS n FROM documents d LEFT JOIN gold g USING (doc_id) GROUP BY d.doc_id)
SELECT round(avg(n), 4) AS mean, min(n) AS least, max(n) AS most, list_sort(list(n))[count(*) // 2 + 1] AS upper_median FROM n""",
}
