"""The SQL surface: the library's functions and table functions by name, for one session.

``register`` makes temporary functions of the session.  Scalars are SQL expressions, so Catalyst inlines them
and a query that uses them stays in generated code; only what no built-in expresses is an Arrow function.
Table functions take a table argument partitioned by document:

    SELECT * FROM span_locate(TABLE(asked) PARTITION BY doc_id ORDER BY k NULLS FIRST)
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions import similarity, text
from ..operators import tables

#: name(arguments) returns: expression.  They call each other, in this order.
SCALARS = {
    "span_squeeze(s STRING) RETURNS STRING": r"trim(regexp_replace(s, r'(?U)\s+', ' '))",
    "span_norm(s STRING) RETURNS STRING": "span_squeeze(lower(s))",
    "span_words(s STRING) RETURNS ARRAY<STRING>": "filter(split(span_norm(s), ' '), w -> w <> '')",
    "span_tokens(s STRING) RETURNS ARRAY<STRING>": r"regexp_extract_all(lower(s), r'(?U)\w+', 0)",
    "span_ngrams(ws ARRAY<STRING>, n INT) RETURNS ARRAY<STRING>": "CASE WHEN size(ws) >= n THEN transform(sequence(1, greatest(size(ws) - n + 1, 1)), i -> array_join(slice(ws, i, n), ' ')) ELSE cast(array() AS ARRAY<STRING>) END",
    "span_trigrams(s STRING) RETURNS ARRAY<STRING>": "CASE WHEN size(span_words(s)) IN (1, 2) THEN array(array_join(span_words(s), ' ')) ELSE array_distinct(span_ngrams(span_words(s), 3)) END",
    "span_head(norm STRING) RETURNS STRING": "nullif(regexp_extract(norm, r'(?iu)[a-zà-ỹ]{2,}', 0), '')",
    "span_iou(s1 BIGINT, e1 BIGINT, s2 BIGINT, e2 BIGINT) RETURNS DOUBLE": "CASE WHEN e1 < s1 OR e2 < s2 OR greatest(e1, e2) <= least(s1, s2) THEN 0D ELSE greatest(least(e1, e2) - greatest(s1, s2), 0) / (greatest(e1, e2) - least(s1, s2)) END",
    "span_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(array_union(a, b)) = 0 THEN 1D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END",
    "span_safe_divide(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "a / CASE WHEN b = 0 THEN 1D ELSE b END",
    "span_residual_words(template STRING) RETURNS INT": r"size(span_words(regexp_replace(template, r'\{[^}]*\}', ' ')))",
    "span_natural_name(s STRING, most INT) RETURNS BOOLEAN": r"size(span_words(s)) <= most AND NOT s RLIKE r'[\[\](){}†*]|[A-Z]\d{2}'",
    "span_before_parenthesis(s STRING) RETURNS STRING": "trim(CASE WHEN instr(s, '(') > 1 THEN substring_index(s, '(', 1) ELSE s END)",
    "span_too_long(s STRING, most INT) RETURNS BOOLEAN": "size(span_words(s)) > most",
    "span_encode_tags(ws ARRAY<STRING>, tags ARRAY<STRING>) RETURNS STRING": "array_join(zip_with(ws, tags, (w, t) -> t || '* ' || w || ' ' || t || '*'), ' ')",
    "span_word_distance(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS INT": "levenshtein(array_join(transform(a, w -> char(array_position(array_distinct(concat(a, b)), w) + 64)), ''), array_join(transform(b, w -> char(array_position(array_distinct(concat(a, b)), w) + 64)), ''))",
}

#: Arrow functions.
ARROW = {
    "span_strip_diacritics": text.strip_diacritics, "span_nfc": text.nfc, "span_indel": similarity.indel, "span_token_sort_ratio": similarity.token_sort_ratio,
    "span_token_set_ratio": similarity.token_set_ratio, "span_lcs_ratio": similarity.lcs_ratio, "span_longest_run": similarity.longest_run, "span_word_distance_any": similarity.word_levenshtein_any,
}

#: Table functions.
TABLES = {"span_items": tables.SplitItems, "span_locate": tables.LocateInOrder, "span_place": tables.PlaceLongestFirst, "span_take_free": tables.TakeFree}


def register(spark: SparkSession) -> list[str]:
    """Registers all of them as temporary functions of the session; their names."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, f in ARROW.items():
        spark.udf.register(name, f)
    for name, f in TABLES.items():
        spark.udtf.register(name, f)
    return [*(h.split("(")[0] for h in SCALARS), *ARROW, *TABLES]
