"""Linking: names and vectors to codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import link as K
from . import views as V


def _terms(spark, d):
    """Parts as a terminology: many codes share a name."""
    return V.load(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_partkey").alias("code"), F.col("p_name").alias("name"))


def _names(spark, d):
    """One row for each different name, its code the smallest part key."""
    return V.load(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("row_id")).select("row_id", F.col("row_id").alias("code"), "name")


def _queries(spark, d):
    """Names as mentions: some whole, some with words swapped or a word lost."""
    n = _names(spark, d)
    a, b = F.substring_index("name", " ", 1), F.substring_index("name", " ", -1)
    k = F.col("row_id") % 3
    return n.select(F.col("row_id").alias("query_id"), F.when(k == 0, F.upper("name")).when(k == 1, F.concat(b, F.lit(" "), a)).otherwise(a).alias("query"))


def exact_lookup(spark, d):
    return K.exact(_queries(spark, d), _terms(spark, d)).groupBy("query_id").agg(F.count("*").alias("n"), F.min("code").alias("first_code"), F.max("code").alias("last_code"))


def blocked_topk(spark, d):
    return K.top_k(K.blocked(_queries(spark, d), _names(spark, d)), 3).select("query_id", "rank", "code", F.round("score", 4).alias("score"))


def fuzzy_topk(spark, d):
    return K.top_k(K.fuzzy(_queries(spark, d), _names(spark, d)), 3).select("query_id", "rank", "code", F.round("score", 4).alias("score"))


def match_terms(spark, d):
    return K.match_terminology(_queries(spark, d), _names(spark, d)).select("query_id", "rank", "code", F.round("score", 4).alias("score"))


def match_drugs(spark, d):
    return K.match_drugs(_queries(spark, d), _names(spark, d)).select("query_id", "rank", "code", F.round("score", 4).alias("score"))


def bm25_topk(spark, d):
    found = K.bm25(_queries(spark, d), _names(spark, d), 5)
    return found.select("query_id", "row_id", F.round("score", 5).alias("score"))


def _vectors(spark, d):
    """The stated query set (ids divisible by 20) and all rows as terms, their labels as codes."""
    e = V.load(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    t = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("code"), F.concat(F.lit("v"), "label").alias("name"))
    return q, t


def dense_topk(spark, d):
    return K.dense(*_vectors(spark, d), 5).select("query_id", "row_id", F.round("score", 6).alias("score"))


def dense_codes(spark, d):
    return K.top_k(K.dense(*_vectors(spark, d), 50), 3).select("query_id", "rank", "code", F.round("score", 6).alias("score"))


def abstain_gate(spark, d):
    found = K.abstain(K.top_k(K.dense(*_vectors(spark, d), 50), 1), 0.45)
    return found.select("query_id", "code", F.round("score", 6).alias("score"))


def rrf_fuse(spark, d):
    """Two lexical rankings fused: whole names and head tokens."""
    q, t = _queries(spark, d), _names(spark, d)
    a = K.bm25(q, t, 5).select("query_id", "code", "name", F.round("score", 5).alias("score"))
    b = K.exact(q, t)
    return K.fuse(a, b).select("query_id", "code", F.round("score", 6).alias("score"), "name")


def fallback_match(spark, d):
    q, t = _queries(spark, d), _names(spark, d)
    both = K.fallback(K.exact(q, t), K.bm25(q, t, 1).select("query_id", "code", "name", "score"))
    return both.select("query_id", "code", F.round("score", 5).alias("score"))


def _named_vectors(spark, d):
    """As :func:`_vectors`, with names: each row's is that of the part with its number, a query's is its first word."""
    q, t = _vectors(spark, d)
    names = V.load(spark, d, "part").select(F.col("p_partkey").alias("row_id"), "p_name")
    t = t.drop("name").join(names, "row_id", "left").withColumn("name", F.coalesce("p_name", F.lit(""))).drop("p_name")
    own = names.select(F.col("row_id").alias("query_id"), F.substring_index("p_name", " ", 1).alias("query"))
    return q.join(own, "query_id", "left").fillna("", ["query"]), t


def retrieve_and_rerank(spark, d):
    q, t = _named_vectors(spark, d)
    return K.retrieve_and_rerank(q, t, 0.4, 1).select("query_id", "code", F.round("score", 6).alias("score"))


def hybrid_gate(spark, d):
    q, t = _named_vectors(spark, d)
    return K.hybrid(q, t, 0.4, 2).select("query_id", "rank", "code", F.round("score", 6).alias("score"))


def hard_negatives(spark, d):
    return K.hard_negatives(V.load(spark, d, "embeddings"), 3, 6)


def describe_codes(spark, d):
    p = V.load(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("code"), F.col("p_name").alias("name"))
    return K.describe(p)


def synonym_pairs(spark, d):
    p = V.load(spark, d, "part").select(F.col("p_brand").alias("code"), F.col("p_name").alias("name"))
    return K.synonym_pairs(p)


def bilingual_pairs(spark, d):
    p = V.load(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_type").alias("other_name"))
    return K.bilingual_pairs(p)


QUERIES = {
    f.__name__: f
    for f in (
        exact_lookup, blocked_topk, fuzzy_topk, match_terms, match_drugs, bm25_topk, dense_topk, dense_codes, abstain_gate, rrf_fuse, fallback_match, retrieve_and_rerank,
        hybrid_gate, hard_negatives, describe_codes, synonym_pairs, bilingual_pairs,
    )
}

_Q = """
names AS (SELECT p_name AS name, min(p_partkey) AS row_id FROM part GROUP BY p_name),
q AS (SELECT row_id AS query_id, CASE row_id % 3 WHEN 0 THEN upper(name) WHEN 1 THEN string_split(name, ' ')[-1] || ' ' || string_split(name, ' ')[1] ELSE string_split(name, ' ')[1] END AS query FROM names)
"""
_BM25 = _Q + """,
t AS (SELECT row_id, name, string_split(lower(name), ' ') AS ws, len(string_split(name, ' ')) AS dl FROM names),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM t),
tf AS (SELECT row_id, dl, w, count(*) AS tf FROM (SELECT row_id, dl, unnest(ws) AS w FROM t) GROUP BY ALL),
raw AS (SELECT w, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY w, n),
idf AS (SELECT w, CASE WHEN idf < 0 THEN (SELECT avg(idf) * 0.25 FROM raw) ELSE idf END AS idf FROM raw),
qw AS (SELECT query_id, w, count(*) AS qf FROM (SELECT query_id, unnest(string_split(lower(query), ' ')) AS w FROM q) GROUP BY ALL),
sc AS (SELECT query_id, row_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qw JOIN idf USING (w) JOIN tf USING (w), st GROUP BY query_id, row_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id DESC) AS n FROM sc WHERE score > 0)
"""
_DENSE = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, t.vec_id AS row_id, t.label::VARCHAR AS code, round(list_dot_product(q.e, t.e), 9) AS score FROM v q, v t WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS n FROM s),
c AS (SELECT query_id, code, max(score) AS score FROM r WHERE n <= 50 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code)::INTEGER AS rank FROM c)
"""



def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two strings, one letter of ``a`` a row of the table."""
    step = f"list_append(acc, CASE WHEN ord({b}[y[1]]) = x[1] THEN row[y[1]] + 1 ELSE greatest(row[y[1] + 1], acc[y[1]]) END)"
    inner = f"list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda acc, y: {step})"
    return f"list_reduce(list_prepend(list_transform(range(0, length({b}) + 1), lambda j: 0::BIGINT), list_transform(string_split({a}, ''), lambda k: [ord(k)::BIGINT])), lambda row, x: {inner})[length({b}) + 1]"


def _indel(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 200.0::DOUBLE * {_lcs(a, b)} / (length({a}) + length({b})) END"


_SETS = _Q + f""",
pr AS (SELECT query_id, row_id, lower(query) AS q, lower(name) AS n, list_distinct(string_split(lower(query), ' ')) AS x, list_distinct(string_split(lower(name), ' ')) AS y FROM q, names),
ps AS (SELECT *, array_to_string(list_sort(list_intersect(x, y)), ' ') AS c, array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ') AS a, array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ') AS b FROM pr),
pu AS (SELECT *, trim(c || ' ' || a) AS u, trim(c || ' ' || b) AS v FROM ps),
fz AS (SELECT query_id, row_id AS code, CASE WHEN c <> '' AND (a = '' OR b = '') THEN 100.0 ELSE greatest({_indel('u', 'v')}, CASE WHEN c <> '' THEN greatest({_indel('c', 'u')}, {_indel('c', 'v')}) ELSE 0.0 END) END AS score FROM pu),
f AS (SELECT * FROM fz WHERE score >= 78 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code) <= 30),
hd AS (SELECT query_id, row_id AS code, array_to_string(list_sort(string_split(q, ' ')), ' ') AS q, array_to_string(list_sort(string_split(n, ' ')), ' ') AS n FROM pr WHERE regexp_extract(q, '[a-zà-ỹ]{{2,}}') = regexp_extract(n, '[a-zà-ỹ]{{2,}}')),
bs AS (SELECT query_id, code, {_indel('q', 'n')} AS score FROM hd),
bl AS (SELECT * FROM bs WHERE score >= 60),
ex AS (SELECT query_id, row_id AS code, 100.0 AS score FROM pr WHERE q = n)
"""


def _top(source: str, k: int) -> str:
    return f"SELECT query_id, rank, code, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code)::INTEGER AS rank FROM ({source})) WHERE rank <= {k}"


ORACLE_SQL = {
    "fuzzy_topk": "WITH " + _SETS + _top("SELECT * FROM f", 3),
    "blocked_topk": "WITH " + _SETS + _top("SELECT * FROM bl", 3),
    "match_terms": "WITH " + _SETS + _top("SELECT * FROM ex UNION ALL SELECT * FROM f WHERE query_id NOT IN (SELECT query_id FROM ex)", 3),
    "match_drugs": "WITH " + _SETS + _top("SELECT * FROM ex UNION ALL SELECT * FROM bl WHERE query_id NOT IN (SELECT query_id FROM ex)", 1),
    "retrieve_and_rerank": "WITH " + _DENSE + """,
nm AS (SELECT query_id, code, score, count(*) OVER (PARTITION BY query_id) AS n, max(score) OVER (PARTITION BY query_id) AS best,
       [lower(string_split(coalesce(a.p_name, ''), ' ')[1])] AS x, list_distinct(list_filter(string_split(lower(coalesce(b.p_name, '')), ' '), lambda w: w <> '')) AS y
       FROM r LEFT JOIN part a ON a.p_partkey = query_id LEFT JOIN part b ON b.p_partkey = row_id WHERE n <= 50),
js AS (SELECT query_id, code, CASE WHEN n = 1 THEN score ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END AS score FROM nm WHERE best >= 0.4),
mx AS (SELECT query_id, code, max(score) AS score FROM js GROUP BY ALL)
SELECT query_id, code, round(score, 6) AS score FROM mx QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code) = 1""",
    "hybrid_gate": "WITH " + _DENSE + """,
dn AS (SELECT query_id, code, coalesce(p_name, '') AS name, score, max(score) OVER (PARTITION BY query_id) AS best FROM r LEFT JOIN part ON p_partkey = row_id WHERE n <= 50),
dv AS (SELECT query_id, code, name, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code) - 1 AS rank FROM dn WHERE best >= 0.4),
qs AS (SELECT DISTINCT d.query_id, lower(string_split(coalesce(p_name, ''), ' ')[1]) AS w FROM dv d LEFT JOIN part ON p_partkey = d.query_id),
t AS (SELECT vec_id AS row_id, label::VARCHAR AS code, coalesce(p_name, '') AS name, list_filter(string_split(lower(coalesce(p_name, '')), ' '), lambda w: w <> '') AS ws FROM embeddings LEFT JOIN part ON p_partkey = vec_id),
st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM t),
tf AS (SELECT row_id, dl, w, count(*) AS tf FROM (SELECT row_id, len(ws) AS dl, unnest(ws) AS w FROM t) GROUP BY ALL),
raw AS (SELECT w, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY w, n),
idf AS (SELECT w, CASE WHEN idf < 0 THEN (SELECT avg(idf) * 0.25 FROM raw) ELSE idf END AS idf FROM raw),
sc AS (SELECT query_id, row_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qs JOIN idf USING (w) JOIN tf USING (w), st GROUP BY query_id, row_id),
bm AS (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id DESC) <= 50),
bv AS (SELECT query_id, code, name, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code) - 1 AS rank FROM bm JOIN t USING (row_id)),
fu AS (SELECT query_id, code, sum(1.0::DOUBLE / (60 + rank)) AS score, min({'rank': rank, 'name': name}).name AS name FROM (SELECT * FROM dv UNION ALL SELECT * FROM bv) GROUP BY ALL),
rr AS (SELECT query_id, code, count(*) OVER (PARTITION BY query_id) AS n, score, [w] AS x, list_distinct(list_filter(string_split(lower(name), ' '), lambda w: w <> '')) AS y FROM fu JOIN qs USING (query_id)),
fs AS (SELECT query_id, code, CASE WHEN n = 1 THEN score ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END AS score FROM rr)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code)::INTEGER AS rank, code, round(score, 6) AS score FROM fs QUALIFY rank <= 2""",
    "exact_lookup": "WITH " + _Q + " SELECT query_id, count(*) AS n, min(p_partkey) AS first_code, max(p_partkey) AS last_code FROM q JOIN part ON lower(p_name) = lower(query) GROUP BY query_id",
    "bm25_topk": "WITH " + _BM25 + " SELECT query_id, row_id, round(score, 5) AS score FROM rk WHERE n <= 5",
    "dense_topk": "WITH " + _DENSE + " SELECT query_id, row_id, round(score, 6) AS score FROM r WHERE n <= 5",
    "dense_codes": "WITH " + _DENSE + " SELECT query_id, rank, code, round(score, 6) AS score FROM k WHERE rank <= 3",
    "abstain_gate": "WITH " + _DENSE + " SELECT query_id, code, round(score, 6) AS score FROM k WHERE rank = 1 AND score >= 0.45",
    "rrf_fuse": "WITH " + _BM25 + """,
a AS (SELECT query_id, row_id AS code, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, row_id) - 1 AS rank FROM rk WHERE n <= 5),
b AS (SELECT query_id, row_id AS code, row_number() OVER (PARTITION BY query_id ORDER BY row_id) - 1 AS rank FROM q JOIN names ON lower(name) = lower(query)),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT query_id, code, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, any_value(name) AS name FROM u JOIN names ON row_id = code GROUP BY query_id, code""",
    "fallback_match": "WITH " + _BM25 + """,
e AS (SELECT query_id, row_id AS code, 100.0::DOUBLE AS score FROM q JOIN names ON lower(name) = lower(query))
SELECT * FROM e UNION ALL SELECT query_id, row_id, round(score, 5) FROM rk WHERE n = 1 AND query_id NOT IN (SELECT query_id FROM e)""",
    "hard_negatives": """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id, q.label AS own, t.vec_id AS other, t.label, round(list_dot_product(q.e, t.e), 9) AS score FROM v q, v t),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS n FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other)::INTEGER AS nth FROM r WHERE n <= 9 AND label <> own AND other <> vec_id)
SELECT vec_id, nth, other AS negative FROM k WHERE nth <= 3""",
    "describe_codes": """
WITH f AS (SELECT p_brand AS code, p_name AS name, min(p_partkey) AS row_id FROM part GROUP BY ALL),
l AS (SELECT code, list(name ORDER BY row_id) AS ns FROM f GROUP BY code)
SELECT code, ns[1] || CASE WHEN len(ns) > 1 THEN ' (also: ' || array_to_string(ns[2:3], ', ') || ')' ELSE '' END AS description FROM l""",
    "synonym_pairs": """
WITH n AS (SELECT DISTINCT p_brand AS code, lower(p_name) AS name FROM part),
w AS (SELECT code, name AS a, lead(name) OVER w AS b, row_number() OVER w AS nth FROM n WINDOW w AS (PARTITION BY code ORDER BY md5('1|' || name), name))
SELECT code, a, b FROM w WHERE b IS NOT NULL AND nth <= 3""",
    "bilingual_pairs": "SELECT p_partkey AS code, lower(p_name) AS a, lower(trim(p_type)) AS b FROM part WHERE p_name <> '' AND p_type <> '' AND lower(p_name) <> lower(trim(p_type))",
}
