"""The SQL surface (registered functions and table functions) and the dictionary sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sweep as W
from ..plans.sql import register
from . import texts
from . import views as V


def sql_items(spark, d):
    """``item_split`` by the table function."""
    register(spark)
    return spark.sql("SELECT * FROM span_items(TABLE(SELECT doc_id, line_no, start, line FROM {lines}))", lines=V.all_lines(spark, d))


def sql_locate(spark, d):
    """The last word of every line, in order of lines, found from a moving cursor."""
    register(spark)
    return spark.sql(
        """
        WITH asked AS (
            SELECT doc_id, cast(line_no AS BIGINT) AS k, element_at(split(line, ' '), -1) AS item, cast(null AS STRING) AS after, cast(null AS INT) AS occ, cast(null AS STRING) AS text FROM {lines} WHERE line <> '' AND line NOT LIKE '% '
            UNION ALL SELECT doc_id, null, null, null, null, text FROM {docs}
        ) SELECT * FROM span_locate(TABLE(asked) PARTITION BY doc_id ORDER BY k NULLS FIRST)
        """,
        lines=V.all_lines(spark, d),
        docs=V.load(spark, d, "documents"),
    )


def sql_place(spark, d):
    """The first two words of every line, as planned phrases: longest first, each where it first fits."""
    register(spark)
    return spark.sql(
        """
        WITH phrases AS (SELECT DISTINCT doc_id, substring_index(line, ' ', 2) AS phrase FROM {lines} WHERE line LIKE '% %'),
        asked AS (
            SELECT doc_id, phrase, -length(phrase) AS shorter, cast(null AS STRING) AS text FROM phrases
            UNION ALL SELECT doc_id, null, null, text FROM {docs}
        ) SELECT * FROM span_place(TABLE(asked) PARTITION BY doc_id ORDER BY (shorter NULLS FIRST, phrase))
        """,
        lines=V.all_lines(spark, d),
        docs=V.load(spark, d, "documents"),
    )


def sql_functions(spark, d):
    """Scalars by name, over every text."""
    register(spark)
    return spark.sql(
        """
        SELECT doc_id, md5(span_norm(text)) AS norm_md5, size(span_words(text)) AS n_words, size(span_tokens(text)) AS n_tokens, size(span_trigrams(text)) AS n_trigrams,
               size(span_ngrams(span_tokens(text), 13)) AS n_grams, span_head(span_norm(text)) AS head,
               round(span_jaccard(span_words(source), span_words(text)), 6) AS jaccard, round(span_iou(doc_id, doc_id + 10, doc_id + 4, doc_id + n_chars), 6) AS iou,
               round(span_safe_divide(n_chars, size(span_words(text)) % 3), 6) AS ratio, span_natural_name(text, 40) AS natural, span_too_long(text, 500) AS long
        FROM {docs}
        """,
        docs=V.load(spark, d, "documents"),
    )


def _vocabulary(spark, d):
    """Part names, and the first one to three words of every benchmark item."""
    ws = F.split(F.regexp_replace("text", r"[^\p{L}]+", " "), " ")
    own = V.load(spark, d, "benchmark").select(F.explode(F.array(*[F.array_join(F.slice(ws, 1, n), " ") for n in (1, 2, 3)])).alias("phrase"))
    return own.where("length(phrase) >= 4").select("phrase", F.lit("ITEM").alias("type")).union(V.load(spark, d, "part").select("p_name", F.lit("PART"))).distinct()


def dictionary_sweep(spark, d):
    """Hits in all documents, off the gold spans; then single words: the last ones of benchmark items."""
    last = F.lower(F.regexp_extract("text", r"([A-Za-z]{5,})[^A-Za-z]*$", 1))
    words = V.load(spark, d, "benchmark").select(last.alias("phrase"), F.lit("WORD").alias("type")).where("phrase <> ''").distinct()
    return W.sweep(V.spread(V.load(spark, d, "documents")), _vocabulary(spark, d), V.gold_spans(spark, d), words)


QUERIES = {f.__name__: f for f in (sql_items, sql_locate, sql_place, sql_functions, dictionary_sweep)}

_W = r"list_filter(string_split(trim(regexp_replace(lower({}), '\s+', ' ', 'g')), ' '), lambda w: w <> '')"

ORACLE_SQL = {
    "sql_items": texts.ORACLE_SQL["item_split"],
    "sql_locate": "WITH RECURSIVE " + V.LINES + r""",
a AS (SELECT doc_id, line_no, string_split(line, ' ')[-1] AS item, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM lines WHERE line <> '' AND line NOT LIKE '% '),
f(doc_id, n, k, spot, item, cursor) AS (
    SELECT doc_id, 0::BIGINT, NULL::INTEGER, NULL::BIGINT, NULL::VARCHAR, 0::BIGINT FROM documents
    UNION ALL
    SELECT doc_id, n, k, spot, item, CASE WHEN spot >= 0 THEN spot + length(item) ELSE cursor END FROM (
        SELECT f.doc_id, a.n, a.line_no AS k, a.item, f.cursor,
               CASE WHEN instr(substr(d.text, f.cursor + 1), a.item) > 0 THEN f.cursor + instr(substr(d.text, f.cursor + 1), a.item) - 1 ELSE instr(d.text, a.item) - 1 END AS spot
        FROM f JOIN a ON a.doc_id = f.doc_id AND a.n = f.n + 1 JOIN documents d ON d.doc_id = f.doc_id)
)
SELECT doc_id, k::BIGINT AS k, spot::BIGINT AS start, CASE WHEN spot >= 0 THEN spot + length(item) ELSE -1 END::BIGINT AS "end", spot < 0 AS error FROM f WHERE n > 0""",
    "sql_functions": rf"""
WITH w AS (SELECT *, {_W.format('text')} AS ws, {_W.format('source')} AS ss, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+') AS ts, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm FROM documents)
SELECT doc_id, md5(norm) AS norm_md5, len(ws)::INTEGER AS n_words, len(ts)::INTEGER AS n_tokens,
       CASE WHEN len(ws) < 3 THEN least(len(ws), 1) ELSE len(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))) END::INTEGER AS n_trigrams,
       greatest(len(ts) - 12, 0)::INTEGER AS n_grams, nullif(regexp_extract(norm, '[a-zà-ỹ]{{2,}}'), '') AS head,
       round(len(list_intersect(ss, ws))::DOUBLE / len(list_distinct(list_concat(ss, ws))), 6) AS jaccard,
       CASE WHEN n_chars < 4 THEN 0.0 ELSE round(greatest(least(10, n_chars) - 4, 0)::DOUBLE / greatest(10, n_chars), 6) END AS iou,
       round(n_chars::DOUBLE / CASE WHEN len(ws) % 3 = 0 THEN 1 ELSE len(ws) % 3 END, 6) AS ratio,
       len(ws) <= 40 AND NOT regexp_matches(text, '[\[\](){{}}†*]|[A-Z][0-9]{{2}}') AS natural, len(ws) > 500 AS long FROM w""",
    "dictionary_sweep": "WITH " + V.BASE + "," + V.GOLD + r""",
b AS (SELECT string_split(regexp_replace(text, '[^\p{L}]+', ' ', 'g'), ' ') AS ws, lower(regexp_extract(text, '([A-Za-z]{5,})[^A-Za-z]*$', 1)) AS last FROM benchmark),
v0 AS (SELECT lower(phrase) AS phrase, 'ITEM' AS type FROM (SELECT array_to_string(ws[1:n], ' ') AS phrase FROM b, range(1, 4) r(n)) WHERE length(phrase) >= 4 UNION SELECT lower(p_name), 'PART' FROM part WHERE p_name <> ''),
v AS (SELECT phrase, type, list_filter(range(1, length(phrase)), lambda k: substr(phrase, k + 1) = substr(phrase, 1, length(phrase) - k)) AS shifts FROM (SELECT phrase, min(type) AS type FROM v0 GROUP BY phrase)),
h AS (SELECT doc_id, text, phrase, type, shifts, string_split(lower(text), phrase) AS ps FROM documents JOIN v ON contains(lower(text), phrase)),
p AS (SELECT doc_id, text, phrase, type, shifts, unnest(range(1, len(ps))) AS i, list_transform(ps, lambda x: length(x)) AS ls FROM h),
s0 AS (SELECT doc_id, text, phrase, type, shifts, (list_sum(ls[1:i]) + (i - 1) * length(phrase))::BIGINT AS start FROM p),
s AS (SELECT doc_id, text, phrase, type, start FROM s0
      UNION SELECT doc_id, text, phrase, type, start + k FROM (SELECT *, unnest(shifts) AS k FROM s0) WHERE lower(substr(text, start + k + 1, length(phrase))) = phrase),
q0 AS (SELECT doc_id, phrase, type, start FROM s
      WHERE NOT regexp_matches(substr(text, start, CASE WHEN start = 0 THEN 0 ELSE 1 END), '[\p{L}\p{M}\p{N}_]') AND NOT regexp_matches(substr(text, start + length(phrase) + 1, 1), '[\p{L}\p{M}\p{N}_]')),
q1 AS (SELECT doc_id, phrase, type, list_reduce(list_prepend([]::STRUCT(start BIGINT, stop BIGINT)[], list([{'start': start, 'stop': start + length(phrase)}] ORDER BY start)),
      lambda acc, y: CASE WHEN len(acc) > 0 AND acc[-1].stop > y[1].start THEN acc ELSE list_concat(acc, y) END) AS kept FROM q0 GROUP BY ALL),
q AS (SELECT doc_id, 1 AS stage, -length(phrase) AS shorter, phrase, z.start AS start, z.stop AS stop, type FROM (SELECT doc_id, phrase, type, unnest(kept) AS z FROM q1)),
m AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z\-]{4,}') AS ms, string_split_regex(text, '[A-Za-z][A-Za-z\-]{4,}') AS gs FROM documents),
n AS (SELECT doc_id, ms, list_transform(gs, lambda x: length(x)) AS gl, list_transform(ms, lambda x: length(x)) AS ml, unnest(range(1, len(ms) + 1)) AS i FROM m),
x AS (SELECT doc_id, 2 AS stage, 0 AS shorter, lower(ms[i]) AS phrase, (list_sum(gl[1:i]) + coalesce(list_sum(ml[1:i - 1]), 0))::BIGINT AS start, length(ms[i]) AS len FROM n WHERE lower(ms[i]) IN (SELECT last FROM b)),
c AS (SELECT doc_id, stage, shorter, phrase, start, stop, type FROM q UNION ALL SELECT doc_id, stage, shorter, phrase, start, start + len, 'WORD' FROM x),
g AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM gold WHERE gold.doc_id = c.doc_id AND gold.start < c.stop AND gold."end" > c.start)),
f AS (SELECT doc_id, list_reduce(list_prepend([]::STRUCT(start BIGINT, stop BIGINT, type VARCHAR, stage INTEGER)[],
          list([{'start': start, 'stop': stop, 'type': type, 'stage': stage}] ORDER BY stage, shorter, phrase, start)),
      lambda acc, y: CASE WHEN len(list_filter(acc, lambda z: z.start < y[1].stop AND z.stop > y[1].start)) > 0 THEN acc ELSE list_concat(acc, y) END) AS kept FROM g GROUP BY doc_id),
k AS (SELECT doc_id, unnest(kept) AS z FROM f)
SELECT k.doc_id, z.start AS start, z.stop AS "end", substr(d.text, z.start + 1, z.stop - z.start) AS text, z.type AS type, z.stage AS stage FROM k JOIN documents d USING (doc_id)""",
}
