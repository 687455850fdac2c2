"""Text functions, lines, features and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lines as L
from ..operators import profile as P
from . import views as V


def _docs(spark, d):
    return V.load(spark, d, "documents")


def norm_match(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.normalize_for_match(F.col("text"))).alias("norm_md5"), F.size(X.words(F.col("text"))).alias("n_words"))


def lines_offsets(spark, d):
    return V.all_lines(spark, d).select("doc_id", "line_no", "start", F.length("line").alias("n_chars"), F.md5("line").alias("line_md5"))


def finditer_spans(spark, d):
    m = _docs(spark, d).select("doc_id", F.inline(L.matches(F.col("text"), "[A-Z][a-z]+")))
    return m.select("doc_id", F.col("start").cast("long").alias("start"), "match")


def strip_span(spark, d):
    ls = V.all_lines(spark, d).select("doc_id", "line_no", "start", F.col("line").alias("piece"))
    b = X.edge_trim(F.col("piece"), F.col("start"))
    return ls.select("doc_id", "line_no", b["start"].cast("long").alias("start"), b["end"].cast("long").alias("end"))


def item_split(spark, d):
    return L.items(V.all_lines(spark, d)).select("doc_id", "line_no", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "item")


def line_kind(spark, d):
    return L.line_kinds(V.all_lines(spark, d))


def skeleton_headers(spark, d):
    return L.skeleton_headers(V.all_lines(spark, d))


def length_quantiles(spark, d):
    q = P.quantiles(_docs(spark, d).select(F.length("text").cast("double").alias("n")), "n")
    return q.select(*[F.round(c, 4).alias(c) for c in q.columns])


def _longs(df):
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("long").alias(c) if kinds[c] == "int" else F.col(c) for c in df.columns])


def _measured(spark, d):
    return _longs(P.measures(V.spread(_docs(spark, d).select("doc_id", "text"))))


def _structured(spark, d):
    return _longs(P.structure(V.spread(_docs(spark, d).select("doc_id", "text")), P.PLAIN))


def feature_matrix(spark, d):
    return _measured(spark, d).drop("phrase_repeat_hits")


def feature_flags(spark, d):
    return P.flags(_measured(spark, d)).drop("f_glue")


def phrase_repeats(spark, d):
    """What needs back references, which the other engine's expressions don't have."""
    return P.flags(_measured(spark, d), "phrase_repeat_hits").select("doc_id", "phrase_repeat_hits", "f_glue")


#: Columns with look-around or back references.
_NOISE = ("inline_bullet_count", "consecutive_word_repeat_hits", "concatenated_repeat_hits", "legacy_phrase_repeat_hits", "legacy_glue_or_repeat_proxy", "attached_number_unit_hits")


def structure_profile(spark, d):
    return _structured(spark, d).drop(*_NOISE)


def structure_noise(spark, d):
    return _structured(spark, d).select("doc_id", *_NOISE)


def label_overlap(spark, d):
    return _longs(P.label_overlap(V.spread(_docs(spark, d).select("doc_id", "text")), P.PLAIN))


def genre_combinations(spark, d):
    return P.genre_combinations(_structured(spark, d))


def structure_summary(spark, d):
    columns = ["genre_qa", "genre_clinical", "genre_health_education", "mixed_major_genre", "compacted_layout", "fragment_start", "redaction_runs", "multiple_space_runs", "stitching_signal_count"]
    return P.summary(_structured(spark, d), columns)


def repeated_words(spark, d):
    return _docs(spark, d).select("doc_id", F.regexp_count("text", F.lit(r"\b([A-Za-z]{2,}) \1\b")).alias("n")).where("n > 0")


def density_buckets(spark, d):
    stops = _docs(spark, d).select(F.regexp_count("text", F.lit("[,;]")).alias("n"))
    return P.density_buckets(stops, "n")


def head_tokens(spark, d):
    return V.load(spark, d, "part").select("p_partkey", X.head_token(X.normalize_for_match(F.col("p_name"))).alias("head"))


def word_trigrams(spark, d):
    return V.load(spark, d, "benchmark").select("item_id", F.explode(X.word_trigrams(F.col("text"))).alias("gram"))


def token_windows(spark, d):
    w = F.split(F.col("text"), r"\s+")
    one = _docs(spark, d).select("doc_id", F.inline(L.token_windows(w, 256, 48)))
    return one.select("doc_id", F.col("start").cast("long").alias("start"), F.size("tokens").alias("n"))


def natural_names(spark, d):
    return V.load(spark, d, "part").where(X.is_natural_name(F.col("p_name"), 6)).select("p_partkey", "p_name")


def tag_codec(spark, d):
    """Words tagged, encoded and decoded again: pairs that differ."""
    w = F.filter(F.split(F.col("text"), r"\s+"), lambda x: x.rlike(r"^[a-z]+$"))
    t = V.load(spark, d, "benchmark").select("item_id", w.alias("w")).withColumn("t", F.transform("w", lambda x, i: F.when(i % 3 == 0, "A").otherwise("0")))
    back = t.withColumn("back", X.decode_tags(X.encode_tags(F.col("w"), F.col("t"))))
    return back.select("item_id", F.size("back").alias("n"), F.size(F.filter(F.arrays_zip("w", "t", "back"), lambda x: (x["w"] != x["back"]["word"]) | (x["t"] != x["back"]["tag"]))).alias("faults"))


QUERIES = {
    f.__name__: f
    for f in (
        norm_match, lines_offsets, finditer_spans, strip_span, item_split, line_kind, skeleton_headers, length_quantiles, feature_matrix, feature_flags,
        phrase_repeats, structure_profile, structure_noise, label_overlap, genre_combinations, structure_summary, repeated_words, density_buckets, head_tokens, word_trigrams, token_windows, natural_names, tag_codec,
    )
}

_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_EDGE = "chr(9) || chr(10) || chr(13) || ' .,;:*-–—•+()[]\"''' "
_W = r"list_filter(string_split_regex(trim(line), '\s+'), lambda w: w <> '')"
#: Text with every character that is not part of a word doubled, so that neighbouring words don't share their bounds.
_N = r"[^\p{L}\p{M}\p{N}_]"
_UPPER = "A-ZÀÁẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬÈÉẺẼẸÊẾỀỂỄỆÌÍỈĨỊÒÓỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÙÚỦŨỤƯỨỪỬỮỰỲÝỶỸỴĐ"
_LOWER = _UPPER.replace("A-Z", "a-z").lower()
_LINES = r"""
d0 AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls0 FROM documents),
d AS (SELECT doc_id, t, CASE WHEN ls0[-1] = '' THEN ls0[1:len(ls0) - 1] ELSE ls0 END AS ls FROM d0)"""
_MEASURES = _LINES + rf""",
u AS (SELECT *, ' ' || regexp_replace(t, '({_N})', '\1\1', 'g') || ' ' AS u FROM d),
measures0 AS (SELECT doc_id, length(t) AS chars, len(ls) AS lines,
    len(regexp_extract_all(t, '(?im)(?:^\s*\d\s*[.)]\s)|tiền sử|bệnh sử|lý do (?:nhập viện|khám)|đánh giá tại bệnh viện|triệu chứng')) AS section_hits,
    len(regexp_extract_all(t, '(?i)tiền sử|trước khi nhập viện|thuốc trước|bệnh (?:lý )?(?:mạn|mãn) tính|trong quá khứ|tiền căn')) AS history_hits,
    len(regexp_extract_all(t, '(?i)tiền sử gia đình|thành viên (?:trong )?gia đình|trong gia đình (?:có|bị)|cha mẹ|anh trai|chị gái|em trai|em gái|di truyền|người thân'))
      + len(regexp_extract_all(u, '(?i){_N}(?:bố|mẹ){_N}')) AS family_subject_hits,
    len(regexp_extract_all(t, '(?i)người nhà (?:kể|cho biết|nhận thấy|báo)|theo lời (?:kể của )?người nhà')) AS family_narrator_hits,
    len(regexp_extract_all(u, '(?i){_N}\d+(?:[.,][.,]\d+)?(?:\s\s)?(?:mg|mcg|ml|g|iu|units?){_N}')) AS dosage_hits,
    len(regexp_extract_all(u, '(?i){_N}(?:po|iv|im|sc|bid|tid|qid|qd|qhs|qam|q\d+h|prn|nebs?|daily){_N}')) AS route_hits,
    len(regexp_extract_all(u, '(?i){_N}(?:wbc|neut|lymp|lymph|hgb|hct|plt|rbc|troponin|creatinin|creatinine|glucose|inr|alt|ast|ure|urea|bun|spo2|natri|kali|bạch  cầu|tiểu  cầu|men  gan|hồng  cầu){_N}')) AS lab_token_hits,
    len(list_filter(ls, lambda x: regexp_matches(' ' || x || ' ', '(?i){_N}(?:wbc|neut|lymp|lymph|hgb|hct|plt|rbc|troponin|creatinin|creatinine|glucose|inr|alt|ast|ure|urea|bun|spo2|natri|kali|bạch cầu|tiểu cầu|men gan|hồng cầu){_N}')
      AND regexp_matches(' ' || x || ' ', '{_N}\d+(?:[.,]\d+)?{_N}'))) AS lab_result_lines,
    greatest(len(regexp_extract_all(u, '(?i){_N}(?:không|chưa|âm  tính|loại  trừ){_N}')) + len(regexp_extract_all(t, '\(-\)'))
      - len(regexp_extract_all(t, '(?i)không xác định|không đặc hiệu|không rõ|không điển hình')), 0) AS neg_hits,
    len(regexp_extract_all(t, '[{_LOWER}][{_UPPER}]')) AS camel_glue_hits, len(regexp_extract_all(u, '{_N}N//A{_N}')) AS na_hits,
    len(regexp_extract_all(t, '(?m)\*\*|^\s*\*\s|^\s*\+\s')) AS markdown_hits,
    len(regexp_extract_all(u, '{_N}[A-Za-z]{{4,}}{_N}')) AS eng_count, len(regexp_extract_all(u, '{_N}\p{{L}}+{_N}')) AS alpha FROM u),
measures AS (SELECT * EXCLUDE (alpha), round(eng_count / greatest(alpha, 1), 3) AS eng_ratio FROM measures0)
"""
_HEAD = r"^\s*(\d{1,2})\s*[.)]\s*(.{1,140}?)\s*$"
_STRUCTURE = _LINES + rf""",
f AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '\S')) AS fl, ' ' || regexp_replace(t, '({_N})', '\1\1', 'g') || ' ' AS u,
    list_transform(list_filter(ls, lambda x: regexp_matches(x, '{_HEAD}')), lambda x: regexp_extract(x, '{_HEAD}', 1)::INT || ' ' || regexp_extract(x, '{_HEAD}', 2)) AS heads,
    list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks,
    list_transform(regexp_extract_all(t, '(?i)1\. the|2\. of|3\. in'), lambda x: x[1]) AS canonical FROM d),
g AS (SELECT *, coalesce(fl[1], '') AS first, list_transform(fl, lambda x: length(x)) AS lens, list_transform(heads, lambda x: lower(x)) AS keys,
    list_transform(list_filter(list_transform(ls, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 30), lambda x: lower(x)) AS lk,
    list_transform(list_filter(blocks, lambda x: length(x) >= 80), lambda x: lower(x)) AS bk FROM f),
c AS (SELECT doc_id, length(t) AS chars, len(regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS tokens, len(ls) AS physical_lines, len(fl) AS nonempty_lines, len(blocks) AS paragraphs,
    coalesce(list_max(lens), 0) AS max_line_chars, round(coalesce(list_max(lens), 0) / greatest(length(t), 1), 4) AS longest_line_share, coalesce(list_max(lens), 0) / greatest(length(t), 1) AS share_,
    len(list_filter(lens, lambda x: x >= 300)) AS lines_ge_300_chars, len(list_filter(lens, lambda x: x >= 500)) AS lines_ge_500_chars, len(list_filter(lens, lambda x: x >= 600)) AS lines_ge_600_chars,
    len(list_filter(lens, lambda x: x >= 1000)) AS lines_ge_1000_chars, round(length(t) / greatest(len(fl), 1), 2) AS mean_chars_per_nonempty_line,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\s*(?:[•●▪◦‣*+-]|–|—)\s+'))) AS bullet_line_count, len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*+]\s+'))) AS dash_list_count,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[•●▪◦‣]\s*'))) AS unicode_bullet_line_count, len(list_filter(ls, lambda x: regexp_matches(x, '^\s*\d{{1,2}}\s*[.)]\s*'))) AS numbered_line_start_count,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\s*\d{{1,2}}\s*[.)]\s*.*[•●▪◦‣]'))) AS heading_inline_bullet_count, len(heads) AS numbered_heading_count,
    array_to_string(list_transform(heads, lambda x: string_split(x, ' ')[1]), ',') AS heading_numbers, len(keys) - len(list_distinct(keys)) AS duplicate_numbered_heading_extra,
    len(list_filter(range(1, len(keys)), lambda i: keys[i] = keys[i + 1])) AS adjacent_duplicate_heading_count, array_to_string(canonical, ',') AS canonical_clinical_sequence, len(canonical) AS canonical_heading_count,
    len(canonical) - len(list_distinct(canonical)) AS repeated_canonical_heading_extra, len(regexp_extract_all(t, '(?im)^the ')) AS clinical_history_hits, len(regexp_extract_all(t, '(?im)^of ')) AS clinical_present_illness_hits,
    len(regexp_extract_all(t, '(?im)^(?:der|die) ')) AS clinical_assessment_hits, len(regexp_extract_all(t, '(?i)license|released')) AS clinical_field_hits, len(regexp_extract_all(t, '(?i) (?:her|his|elle) ')) AS patient_specific_hits,
    regexp_matches(first, '(?i)^the ') AS case_opening, len(list_filter(heads, lambda x: regexp_matches(x, '(?i)tion|ment'))) AS education_heading_count, len(regexp_extract_all(t, '(?i)with the')) AS education_prose_hits,
    len(list_filter(heads, lambda x: regexp_matches(x, '(?i)the\??$'))) > 0 OR regexp_matches(first, '(?i)the\??$') AS definition_title, len(regexp_extract_all(t, '(?im)^in ')) AS question_label_hits,
    len(regexp_extract_all(t, '(?im)^to ')) AS answer_label_hits, len(regexp_extract_all(t, '(?i) this ')) AS doctor_greeting_hits, len(regexp_extract_all(t, '(?i) that ')) AS consultation_closing_hits,
    len(regexp_extract_all(t, '\*{{3,}}')) AS redaction_runs, length(array_to_string(regexp_extract_all(t, '\*{{3,}}'), '')) AS redaction_chars, len(regexp_extract_all(t, '\[[^\]\n]{{2,60}}\]')) AS placeholder_hits,
    len(list_filter(regexp_extract_all(t, '\*+'), lambda x: length(x) = 2)) + len(regexp_extract_all(t, '(?m)^\s*\*\s+|^\s*#{{1,6}}\s+')) AS markdown_hits, len(regexp_extract_all(t, '\x{{fffd}}|â€|Ã©|Ã¨|Ãª|Ä‘')) AS mojibake_hits,
    len(regexp_extract_all(t, '\p{{Mn}}')) AS decomposed_codepoints, len(regexp_extract_all(t, '[{_LOWER}][{_UPPER}]')) AS lower_upper_glue_hits, len(regexp_extract_all(t, '[.!?][{_UPPER}]')) AS punct_upper_glue_hits,
    len(regexp_extract_all(t, '(?:license|released)[A-Z]')) AS heading_glue_hits, len(regexp_extract_all(t, '[^\S\n]{{2,}}')) AS multiple_space_runs, len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]+\S'))) AS leading_indent_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '[ \t]+$'))) AS trailing_space_lines, len(regexp_extract_all(t, '\t')) AS tab_count, len(regexp_extract_all(t, '\x{{200b}}')) AS zero_width_space_count,
    len(regexp_extract_all(t, '\x{{a0}}')) AS nbsp_count, len(regexp_extract_all(t, '\r')) AS carriage_return_count, starts_with(t, chr(65279)) AS has_utf8_bom,
    len(list_filter(list_distinct(lk), lambda k: len(list_filter(lk, lambda y: y = k)) > 1)) AS repeated_line_types, len(lk) - len(list_distinct(lk)) AS repeated_line_extra,
    len(list_filter(list_distinct(bk), lambda k: len(list_filter(bk, lambda y: y = k)) > 1)) AS repeated_paragraph_types, len(bk) - len(list_distinct(bk)) AS repeated_paragraph_extra,
    len(regexp_extract_all(u, '{_N}[A-Za-z]{{4,}}{_N}')) AS ascii_word_count, round(len(regexp_extract_all(u, '{_N}[A-Za-z]{{4,}}{_N}')) / greatest(len(regexp_extract_all(u, '{_N}\p{{L}}+{_N}')), 1), 4) AS ascii_word_ratio,
    len(fl) = 0 OR regexp_matches(first, '^\s*(?:[•●▪◦‣*+-]|–|—)\s+') OR starts_with(lower(ltrim(first)), 'of ') OR starts_with(lower(ltrim(first)), 'and ') OR starts_with(lower(ltrim(first)), 'de ') AS fragment_start,
    CASE WHEN regexp_matches(t, '(?im)^in ') THEN length(string_split_regex(t, '(?im)^in ')[1]) ELSE -1 END > 0.35 * length(t)
      OR CASE WHEN regexp_matches(t, '(?im)^to ') THEN length(string_split_regex(t, '(?im)^to ')[1]) ELSE -1 END > 0.35 * length(t) AS abnormal_qa_label_position FROM g),
e AS (SELECT *, round(bullet_line_count / greatest(nonempty_lines, 1), 4) AS bullet_line_ratio, dash_list_count + unicode_bullet_line_count + numbered_line_start_count AS list_marker_count,
    canonical_clinical_sequence = '1,2,3' AS canonical_full_1_2_3, canonical_heading_count > 0 AND canonical_clinical_sequence <> '1,2,3' AS canonical_partial_or_malformed,
    ((clinical_history_hits > 0)::INT + (clinical_present_illness_hits > 0)::INT + (clinical_assessment_hits > 0)::INT)::BIGINT AS clinical_section_count,
    clinical_history_hits + clinical_present_illness_hits + clinical_assessment_hits AS clinical_heading_total, question_label_hits > 0 AND answer_label_hits > 0 AS qa_complete,
    (question_label_hits > 0) <> (answer_label_hits > 0) AS qa_partial, question_label_hits + answer_label_hits = 0 AND doctor_greeting_hits > 0 AND consultation_closing_hits > 0 AS qa_implicit_without_marker,
    share_ >= 0.72 OR (nonempty_lines <= 3 AND max_line_chars >= 500) AS compacted_layout FROM c),
h AS (SELECT *, qa_complete OR (question_label_hits + answer_label_hits > 0 AND doctor_greeting_hits > 0) OR qa_implicit_without_marker AS genre_qa,
    clinical_section_count >= 2 OR clinical_field_hits >= 3 OR case_opening OR (patient_specific_hits >= 3 AND clinical_field_hits >= 1) AS genre_clinical,
    education_heading_count >= 2 OR definition_title OR (education_heading_count >= 1 AND education_prose_hits >= 2) AS genre_health_education FROM e),
i AS (SELECT *, (genre_qa::INT + genre_clinical::INT + genre_health_education::INT)::BIGINT AS major_genre_count FROM h),
j AS (SELECT *, major_genre_count >= 2 AS mixed_major_genre, genre_qa AND genre_clinical AS embedded_qa_clinical, genre_health_education AND genre_clinical AS embedded_article_clinical,
    CASE WHEN genre_qa AND NOT compacted_layout THEN 'qa_dialogue' WHEN genre_health_education AND numbered_heading_count >= 2 AND NOT compacted_layout THEN 'numbered_health_article'
      WHEN genre_clinical AND clinical_section_count >= 2 AND NOT compacted_layout THEN 'numbered_clinical_template' WHEN case_opening AND NOT compacted_layout THEN 'narrative_case'
      WHEN compacted_layout OR (nonempty_lines <= 5 AND fragment_start) THEN 'fragment_or_compacted' ELSE 'freeform_or_hybrid' END AS layout_proxy,
    genre_qa AND NOT genre_clinical AND clinical_field_hits > 0 AS clinical_field_intrusion,
    clinical_heading_total > 0 AND clinical_section_count < 2 AND (genre_qa OR genre_health_education) AS clinical_heading_intrusion FROM i),
structured AS (SELECT * EXCLUDE (share_), ((mixed_major_genre)::INT + clinical_heading_intrusion::INT + clinical_field_intrusion::INT + (duplicate_numbered_heading_extra > 0)::INT + (repeated_canonical_heading_extra > 0)::INT
      + (heading_glue_hits > 0)::INT + (heading_inline_bullet_count > 0)::INT + (fragment_start AND major_genre_count >= 1)::INT)::BIGINT AS stitching_signal_count FROM j)
"""

ORACLE_SQL = {
    "label_overlap": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract(coalesce(text, ''), '(?im)^in ') AS m, string_split_regex(coalesce(text, ''), '(?im)^in ')[1] AS h FROM documents),
r AS (SELECT doc_id, CASE WHEN m <> '' THEN 'x' || substr(text, length(h) + length(m) + 1) END AS rest FROM d),
t AS (SELECT *, regexp_extract(rest, '(?im)^to ') AS m2, string_split_regex(rest, '(?im)^to ')[1] AS h2 FROM r),
w AS (SELECT doc_id, CASE WHEN m2 <> '' THEN list_distinct(list_filter(regexp_extract_all(lower(substr(h2, 2)), '[\p{L}\p{N}\p{M}_]+'), lambda x: length(x) >= 2 AND x NOT IN ('the', 'of', 'and', 'in', 'to'))) END AS q,
             CASE WHEN m2 <> '' THEN list_distinct(list_filter(regexp_extract_all(lower(substr(rest, length(h2) + length(m2) + 1)), '[\p{L}\p{N}\p{M}_]+'), lambda x: length(x) >= 2 AND x NOT IN ('the', 'of', 'and', 'in', 'to'))) END AS a FROM t),
n AS (SELECT doc_id, coalesce(len(q), 0) AS nq, coalesce(len(a), 0) AS na, coalesce(len(list_intersect(q, a)), 0) AS nb FROM w)
SELECT doc_id, CASE WHEN nq > 0 AND na > 0 THEN round(nb / (nq + na - nb), 4) END AS jaccard, CASE WHEN nq > 0 AND na > 0 THEN round(nb / least(nq, na), 4) END AS overlap, nq::BIGINT AS question_tokens, na::BIGINT AS answer_tokens FROM n""",
    "repeated_words": r"""
WITH p AS (SELECT doc_id, unnest(string_split(text, ' ')) AS p, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
e AS (SELECT doc_id, i, p, regexp_extract(p, '(?:^|[^\p{L}\p{N}_])([A-Za-z]{2,})$', 1) AS a, lead(regexp_extract(p, '^([A-Za-z]{2,})(?:$|[^\p{L}\p{N}_])', 1)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM p),
m AS (SELECT doc_id, i, regexp_matches(p, '^[A-Za-z]+$') AS whole FROM e WHERE a <> '' AND a = b),
s AS (SELECT *, CASE WHEN whole AND lag(i) OVER (PARTITION BY doc_id ORDER BY i) = i - 1 THEN 0 ELSE 1 END AS begins FROM m),
r AS (SELECT doc_id, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
c AS (SELECT doc_id, run, (count(*) + 1) // 2 AS n FROM r GROUP BY ALL)
SELECT doc_id, sum(n)::INTEGER AS n FROM c GROUP BY doc_id""",
    "norm_match": f"SELECT doc_id, md5(n) AS norm_md5, len(list_filter(string_split(n, ' '), lambda w: w <> ''))::INTEGER AS n_words FROM (SELECT doc_id, {_NORM} AS n FROM documents)",
    "lines_offsets": "WITH " + V.LINES + " SELECT doc_id, line_no, start, length(line)::INTEGER AS n_chars, md5(line) AS line_md5 FROM lines",
    "finditer_spans": r"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+') AS ms, list_transform(string_split_regex(text, '[A-Z][a-z]+'), lambda g: length(g)) AS gs FROM documents),
e AS (SELECT doc_id, unnest(ms) AS match, unnest(gs[1:len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS i FROM m)
SELECT doc_id, (sum(gap + length(match)) OVER (PARTITION BY doc_id ORDER BY i) - length(match))::BIGINT AS start, match FROM e""",
    "strip_span": "WITH " + V.LINES + f""", p AS (SELECT doc_id, line_no, start, line AS piece FROM lines)
SELECT doc_id, line_no, (start + length(piece) - length(ltrim(piece, {_EDGE})))::BIGINT AS start,
       (start + length(piece) - length(ltrim(piece, {_EDGE})) + length(trim(piece, {_EDGE})))::BIGINT AS "end" FROM p""",
    "item_split": "WITH " + V.LINES + r""",
m AS (SELECT doc_id, line_no, start AS base, regexp_extract_all(line, '[,;]+|[^,;]+') AS ms FROM lines),
e AS (SELECT doc_id, line_no, base, unnest(ms) AS x, unnest(range(1, len(ms) + 1)) AS i FROM m),
o AS (SELECT *, base + sum(length(x)) OVER (PARTITION BY doc_id, line_no ORDER BY i) - length(x) AS s FROM e),
t AS (SELECT doc_id, line_no, s + length(x) - length(ltrim(x, ' ' || chr(9) || '.-*+•')) AS s2, trim(x, ' ' || chr(9) || '.-*+•') AS item FROM o WHERE NOT regexp_matches(x, '^[,;]'))
SELECT doc_id, line_no, s2::BIGINT AS start, (s2 + length(item))::BIGINT AS "end", item FROM t WHERE trim(item) <> ''""",
    "line_kind": "WITH " + V.LINES + r""",
k AS (SELECT trim(line) AS t, len(list_filter(string_split_regex(trim(lower(line)), '\s+'), lambda w: w <> '')) AS n FROM lines),
c AS (SELECT CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^\s*(\d{1,2}[.)]|#+)\s*\S+') AND n <= 10 THEN 'heading' WHEN regexp_matches(t, '^(?:[-*+•]|\d+[.)])\s+') THEN 'bullet'
        WHEN regexp_matches(t, '^[^:]{1,60}:\s*$') THEN 'label' WHEN n <= 10 THEN 'short' ELSE 'prose' END AS kind FROM k)
SELECT kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM c GROUP BY kind""",
    "skeleton_headers": "WITH " + V.LINES + r""",
k AS (SELECT trim(line) AS t, len(list_filter(string_split(trim(line), ' '), lambda w: w <> '')) AS n FROM lines)
SELECT t AS header, count(*) AS freq FROM k WHERE t <> '' AND length(t) <= 60
  AND (regexp_matches(t, '^\d+[.)]') OR (t[-1] = ':' AND n <= 7) OR (regexp_matches(t, '^\p{Lu}') AND n <= 6 AND t[-1] <> '.')) GROUP BY t""",
    "length_quantiles": "SELECT round(min(n), 4) AS least, round(quantile_cont(n, 0.25), 4) AS p25, round(quantile_cont(n, 0.5), 4) AS median, round(quantile_cont(n, 0.75), 4) AS p75, round(max(n), 4) AS most FROM (SELECT length(text)::DOUBLE AS n FROM documents)",
    "feature_matrix": "WITH " + _MEASURES + " SELECT * FROM measures",
    "feature_flags": "WITH " + _MEASURES + """
SELECT doc_id, chars < 400 AS f_short, chars > 3000 AS f_long, section_hits >= 3 AS f_structured, section_hits < 3 AS f_freeform, dosage_hits + route_hits >= 2 AS f_drug, lab_result_lines >= 2 AS f_lab,
  neg_hits >= 1 AS f_neg, family_subject_hits >= 1 AS f_family, family_narrator_hits >= 1 AS f_narrator, history_hits >= 1 AS f_history, eng_ratio >= 0.06 OR eng_count >= 10 AS f_codeswitch,
  markdown_hits >= 1 AS f_markdown, na_hits >= 3 AS f_na FROM measures""",
    "structure_profile": "WITH " + _STRUCTURE + " SELECT * FROM structured",
    "genre_combinations": "WITH " + _STRUCTURE + """
SELECT coalesce(nullif(concat_ws('+', CASE WHEN genre_qa THEN 'qa' END, CASE WHEN genre_clinical THEN 'clinical' END, CASE WHEN genre_health_education THEN 'health_education' END), ''), 'unclassified') AS genres,
  count(*) AS n FROM structured GROUP BY 1""",
    "structure_summary": "WITH " + _STRUCTURE + " SELECT count(*) AS n_docs, "
    + ", ".join(f"count(*) FILTER (WHERE {c}) AS {c}" for c in ("genre_qa", "genre_clinical", "genre_health_education", "mixed_major_genre", "compacted_layout", "fragment_start")) + ", "
    + ", ".join(f"round(avg({c}), 4) AS {c}_mean, max({c}) AS {c}_max" for c in ("redaction_runs", "multiple_space_runs", "stitching_signal_count")) + " FROM structured",
    "density_buckets": """
WITH c AS (SELECT len(regexp_extract_all(text, '[,;]')) AS x FROM documents)
SELECT CASE WHEN x = 0 THEN '0' WHEN x < 5 THEN '1-4' WHEN x < 10 THEN '5-9' WHEN x < 20 THEN '10-19' ELSE '20+' END AS bucket, count(*) AS n FROM c GROUP BY 1""",
    "head_tokens": "SELECT p_partkey, nullif(regexp_extract(lower(p_name), '[a-zà-ỹ]{2,}'), '') AS head FROM part",
    "word_trigrams": f"""
WITH w AS (SELECT item_id, list_filter(string_split({_NORM}, ' '), lambda x: x <> '') AS ws FROM benchmark),
g AS (SELECT item_id, CASE WHEN len(ws) BETWEEN 1 AND 2 THEN [array_to_string(ws, ' ')] WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS gs FROM w)
SELECT item_id, unnest(gs) AS gram FROM g""",
    "token_windows": r"""
WITH w AS (SELECT doc_id, len(string_split_regex(text, '\s+')) AS n FROM documents),
s AS (SELECT doc_id, n, unnest(range(0, greatest(n - 49, 0) + 1, 208)) AS start FROM w)
SELECT doc_id, start::BIGINT AS start, least(256, n - start)::INTEGER AS n FROM s""",
    "natural_names": r"SELECT p_partkey, p_name FROM part WHERE len(string_split(trim(p_name), ' ')) <= 6 AND NOT regexp_matches(p_name, '[\[\](){}†*]|[A-Z]\d{2}')",
    "tag_codec": r"SELECT item_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: regexp_matches(x, '^[a-z]+$')))::INTEGER AS n, 0 AS faults FROM benchmark",
}
