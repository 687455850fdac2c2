"""Structure profiles of documents: measures, flags, genre and noise signals, distributions of spans.

Everything per document is one projection over the text and the array of its lines: no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.repeats import phrase_repeats
from .lines import numbered_headings, lines as line_rows

#: Letters of the language, lower and upper case (fixed values).
LOWER = "a-zàáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵđ"
UPPER = "A-ZÀÁẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬÈÉẺẼẸÊẾỀỂỄỆÌÍỈĨỊÒÓỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÙÚỦŨỤƯỨỪỬỮỰỲÝỶỸỴĐ"

#: Places before an upper-case letter that follows a lower-case one; most places are passed by one comparison, as both lists are long.
GLUE = rf"(?=[A-Z\x{{80}}-\x{{10ffff}}])(?<=[{LOWER}])[{UPPER}]"


@dataclass(frozen=True)
class Signals:
    """Patterns that tell what kind of document a text is (Java regular expressions)."""

    sections: tuple[str, str, str]
    field: str
    patient: str
    opening: str
    question: str
    answer: str
    greeting: str
    closing: str
    topic: str
    prose: str
    definition: str
    canonical: str
    heading_glue: str
    fragments: tuple[str, ...]
    stopwords: tuple[str, ...]


# Signals of Vietnamese medical documents.
MEDICAL_VI = Signals(
    sections=(
        r"(?iuU)\b(?:tiền\s+sử\s+bệnh(?!\s+hiện\s+tại)(?:\s+(?:nội\s+khoa|lý|nội))?|lịch\s+sử\s+bệnh(?!\s+hiện\s+tại))\b",
        r"(?iuU)\b(?:tiền\s+sử\s+bệnh\s+hiện\s+tại|bệnh\s+sử\s+hiện\s+tại|lịch\s+sử\s+bệnh\s+hiện\s+tại)\b",
        r"(?iuU)\bđánh\s+giá\s+tại\s+bệnh\s+viện\b",
    ),
    field=(
        r"(?iuU)\b(?:lý\s+do\s+nhập\s+viện|thời\s+điểm\s+khởi\s+phát|thuốc\s+trước\s+khi\s+nhập\s+viện|các\s+bệnh\s+lý\s+m[aã]n\s+tính|"
        r"tiền\s+sử\s+phẫu\s+thuật|kết\s+quả\s+phòng\s+thí\s+nghiệm|kết\s+quả\s+chẩn\s+đoán\s+hình\s+ảnh|"
        r"thủ\s+thuật\s+(?:đã\s+)?(?:được\s+)?thực\s+hiện|sự\s+kiện\s+trước\s+khi\s+nhập\s+viện)\b"
    ),
    patient=r"(?iuU)\b(?:bệnh\s+nhân|BN)\s+(?:nam|nữ|\d|\b)|\b(?:ông|bà)\s+ấy\b|\bnhập\s+viện\b|\bvào\s+viện\b",
    opening=r"(?iuU)^\s*(?:bệnh\s+nhân|BN)\s+(?:nam|nữ)?\s*\d{1,3}\s*tuổi",
    question=r"(?imuU)^\s*(?:câu\s+hỏi(?:\s+(?:của|từ)\s+người\s+dùng)?(?:\s+gửi\s+đến\s+hệ\s+thống)?|hỏi)\s*(?::|$)",
    answer=r"(?imuU)^\s*(?:câu\s+trả\s+lời\s+của\s+bác\s+sĩ|bác\s+sĩ\s+trả\s+lời|trả\s+lời)\s*(?::|$)",
    greeting=r"(?iuU)\b(?:chào\s+(?:bạn|bác\s+sĩ)|kính\s+chào\s+bác\s+sĩ|cảm\s+ơn\s+bạn\s+đã\s+(?:gửi\s+)?câu\s+hỏi)\b",
    closing=r"(?iuU)\b(?:chúc\s+bạn\s+(?:nhiều\s+)?sức\s+kh(?:ỏe|oẻ|oe)|bạn\s+nên\s+(?:đến|đi)\s+(?:khám|gặp\s+bác\s+sĩ)|theo\s+hướng\s+dẫn\s+của\s+bác\s+sĩ)\b",
    topic=(
        r"(?iuU)\b(?:là\s+gì|là\s+bệnh\s+gì|nguyên\s+nhân|cơ\s+chế\s+bệnh\s+sinh|dấu\s+hiệu|triệu\s+chứng|chẩn\s+đoán|điều\s+trị|phòng\s+ngừa|"
        r"biến\s+chứng|có\s+nguy\s+hiểm|chế\s+độ\s+dinh\s+dưỡng|yếu\s+tố\s+nguy\s+cơ|theo\s+dõi|kết\s+luận)\b"
    ),
    prose=(
        r"(?iuU)\b(?:cho\s+đến\s+nay|các\s+nhà\s+khoa\s+học|nhiều\s+chuyên\s+gia|được\s+định\s+nghĩa\s+là|tóm\s+lại|điều\s+quan\s+trọng|"
        r"theo\s+khuyến\s+cáo|người\s+bệnh\s+cần|cha\s+mẹ\s+cần|phụ\s+huynh\s+cần)\b"
    ),
    definition=r"(?iuU)\b(?:là\s+gì|là\s+bệnh\s+gì)\s*\??$",
    canonical=r"(?iuU)1\.\s{0,3}(?:tiền\s+sử|lịch\s+sử)|2\.\s{0,3}(?:tiền\s+sử|bệnh\s+sử|lịch\s+sử)|3\.\s{0,3}(?:đánh\s+giá|khám|thăm\s+khám)",
    heading_glue=rf"(?iuU)(?:tiền\s+sử\s+bệnh\s+hiện\s+tại|bệnh\s+sử\s+hiện\s+tại|đánh\s+giá\s+tại\s+bệnh\s+viện)(?=[{UPPER}])",
    fragments=(
        "thêm.", "điều trị phụ thuộc", "có ý định điều trị", "cận lâm sàng", "các bệnh mãn tính", "các bệnh lý mãn tính", "câu trả lời của bác sĩ",
    ),
    stopwords=(
        "ạ", "ai", "anh", "bác", "bạn", "bị", "bởi", "các", "cần", "cho", "chào", "chỉ", "có", "của", "cũng", "đã", "đang", "để", "đến", "được", "em", "gì", "hiện", "hỏi",
        "không", "khi", "là", "làm", "lại", "mà", "một", "mong", "mình", "này", "nên", "nếu", "người", "như", "những", "nhiều", "ở", "ra", "rất", "sau", "sẽ", "thì", "trong",
        "trên", "tôi", "từ", "và", "về", "với", "xin",
    ),
)

#: Signals for the invented prose of the test tables.
PLAIN = Signals(
    sections=(r"(?im)^the ", r"(?im)^of ", r"(?im)^(der|die) "),
    field=r"(?i)license|released",
    patient=r"(?i) (her|his|elle) ",
    opening=r"(?i)^the ",
    question=r"(?im)^in ",
    answer=r"(?im)^to ",
    greeting=r"(?i) this ",
    closing=r"(?i) that ",
    topic=r"(?i)tion|ment",
    prose=r"(?i)with the",
    definition=r"(?i)the\??$",
    canonical=r"(?i)1\. the|2\. of|3\. in",
    heading_glue=r"(?:license|released)[A-Z]",
    fragments=("of ", "and ", "de "),
    stopwords=("the", "of", "and", "in", "to"),
)

# Features of the first generation, of Vietnamese clinical notes.
FEATURES = {
    "section_hits": r"(?iumU)(?:^\s*\d\s*[.)]\s)|tiền sử|bệnh sử|lý do (?:nhập viện|khám)|đánh giá tại bệnh viện|triệu chứng",
    "history_hits": r"(?iuU)tiền sử|trước khi nhập viện|thuốc trước|bệnh (?:lý )?(?:mạn|mãn) tính|trong quá khứ|tiền căn",
    "family_subject_hits": r"(?iuU)tiền sử gia đình|thành viên (?:trong )?gia đình|trong gia đình (?:có|bị)|\bbố\b|\bmẹ\b|cha mẹ|anh trai|chị gái|em trai|em gái|di truyền|người thân",
    "family_narrator_hits": r"(?iuU)người nhà (?:kể|cho biết|nhận thấy|báo)|theo lời (?:kể của )?người nhà",
    "dosage_hits": r"(?iuU)\b\d+(?:[.,]\d+)?\s?(?:mg|mcg|ml|g|iu|units?)\b",
    "route_hits": r"(?iuU)\b(?:po|iv|im|sc|bid|tid|qid|qd|qhs|qam|q\d+h|prn|nebs?|daily)\b",
    "lab_token_hits": (
        r"(?iuU)\b(?:wbc|neut|lymp|lymph|hgb|hct|plt|rbc|troponin|creatinin|creatinine|glucose|inr|alt|ast|ure|urea|bun|spo2|natri|kali|bạch cầu|tiểu cầu|men gan|hồng cầu)\b"
    ),
    "camel_glue_hits": GLUE,
    "na_hits": r"(?U)\bN/A\b",
    "markdown_hits": r"(?mU)\*\*|^\s*\*\s|^\s*\+\s",
}
#: Negation cues, and what looks like one and isn't (fixed values).
NEGATION = r"(?iuU)\bkhông\b|\bchưa\b|\bâm tính\b|\(-\)|\bloại trừ\b"
NOT_NEGATION = r"(?iuU)không xác định|không đặc hiệu|không rõ|không điển hình"
#: Letters that most phrases above hold, and many more; and what of a pattern a text without them may hold.
MARKED = r"[\x{dd}\x{fd}\x{100}-\x{1fff}]"
UNMARKED = {
    FEATURES["section_hits"]: r"(?mU)^\s*\d\s*[.)]\s",
    FEATURES["history_hits"]: None,
    FEATURES["family_subject_hits"]: r"(?iu)anh trai|em (?:trai|gái)",
    FEATURES["family_narrator_hits"]: None,
    NEGATION: r"(?iuU)(?=[kâ(])(?:\bkhông\b|\bâm tính\b|\(-\))",
    NOT_NEGATION: r"(?iu)không rõ",
}
#: Features that are rare and so count more in a cover (fixed values).
RARE = ("f_family", "f_narrator", "f_glue", "f_short", "f_long", "f_freeform", "f_lab", "f_codeswitch")

#: Lines that begin with a list marker, and numbered headings (fixed values).
BULLET_LINE = r"(?U)^\s*(?:[•●▪◦‣*+-]|–|—)\s+"
NUMBERED_LINE = r"(?U)^\s*\d{1,2}\s*[.)]\s*"
HEADING_LINE = r"(?U)^\s*(\d{1,2})\s*[.)]\s*(.{1,140}?)\s*$"
#: How every line begins that one of these, or one of the list markers counted below, may match.
LISTED_LINE = r"(?U)^\s*[•●▪◦‣*+\-–—\d]"


def line_array(text: Column) -> Column:
    """The lines, as every kind of line end parts them; the end of the last line makes no line of its own."""

    def use(parts: Column) -> Column:
        return F.slice(parts, F.lit(1), F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))

    return X.bind(F.split(F.coalesce(text, F.lit("")), r"(?=[\n-\x1e\x{85}\x{2028}\x{2029}])(?:\R|[\x1c-\x1e])"), use)


def count_lines(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern)))


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, and the 17 first-generation measures) of every document."""
    t = F.col("text")
    count = lambda p: F.lit(0) if p is None else F.regexp_count(t, F.lit(p))
    hits = lambda p: F.when(F.col("marked"), count(p)).otherwise(count(UNMARKED[p])) if p in UNMARKED else count(p)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), line_array(F.col("text")).alias("ls"), F.coalesce(t.rlike(MARKED), F.lit(False)).alias("marked"))
    english, alpha = hits(r"(?U)(?<!\w)[A-Za-z]{4,}(?!\w)"), hits(r"(?U)(?<!\w)\p{L}+(?!\w)")
    lab = F.filter("ls", lambda x: x.rlike(FEATURES["lab_token_hits"]) & x.rlike(r"(?U)\b\d+(?:[.,]\d+)?\b"))
    # A line's hit is one of the text as well, for what ends a line is no part of a word.
    lab = F.when(hits(FEATURES["lab_token_hits"]) > 0, lab).otherwise(F.array().cast("array<string>"))
    return base.select(
        "doc_id", F.length(t).alias("chars"), F.size("ls").alias("lines"), *[hits(p).alias(k) for k, p in FEATURES.items()], phrase_repeats(t).alias("phrase_repeat_hits"),
        F.greatest(hits(NEGATION) - hits(NOT_NEGATION), F.lit(0)).alias("neg_hits"), F.size(lab).alias("lab_result_lines"),
        F.round(english / F.greatest(alpha, F.lit(1)), 3).alias("eng_ratio"), english.alias("eng_count"),
    )


def flags(measured: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, *keep, and the 14 flags): thresholds over the measures."""
    c = F.col
    return measured.select(
        "doc_id", *keep,
        (c("chars") < 400).alias("f_short"), (c("chars") > 3000).alias("f_long"), (c("section_hits") >= 3).alias("f_structured"), (c("section_hits") < 3).alias("f_freeform"),
        (c("dosage_hits") + c("route_hits") >= 2).alias("f_drug"), (c("lab_result_lines") >= 2).alias("f_lab"), (c("neg_hits") >= 1).alias("f_neg"),
        (c("family_subject_hits") >= 1).alias("f_family"), (c("family_narrator_hits") >= 1).alias("f_narrator"), (c("history_hits") >= 1).alias("f_history"),
        (c("camel_glue_hits") + c("phrase_repeat_hits") >= 1).alias("f_glue"), ((c("eng_ratio") >= 0.06) | (c("eng_count") >= 10)).alias("f_codeswitch"),
        (c("markdown_hits") >= 1).alias("f_markdown"), (c("na_hits") >= 3).alias("f_na"),
    )


def _extra(keys: Column) -> Column:
    return F.size(keys) - F.size(F.array_distinct(keys))


def _keys(blocks: Column, least: int) -> Column:
    """Hashes of the squeezed blocks of ``least`` characters or more."""
    return F.transform(F.filter(blocks, lambda x: F.length(x) >= least), lambda x: F.xxhash64(F.lower(x)))


def _repeats(keys: str) -> tuple[Column, Column]:
    """How many different values of an array column are there twice, and their extra copies."""
    ordered, extra = F.array_sort(keys), _extra(F.col(keys))

    def again(x: Column) -> Column:
        pairs = F.arrays_zip(F.slice(x, F.lit(1), F.size(x) - 1).alias("a"), F.slice(x, F.lit(2), F.size(x)).alias("b"))
        return F.size(F.array_distinct(F.transform(F.filter(pairs, lambda p: p["a"] == p["b"]), lambda p: p["a"])))

    return F.when(extra > 0, X.bind(ordered, again)).otherwise(0), extra


def structure(docs: DataFrame, signals: Signals) -> DataFrame:
    """One wide row for each document: lines, list markers, headings, signals, genres, layout, noise, stitching."""
    t, ls, full, c = F.col("text"), F.col("ls"), F.col("full"), F.col
    # The patterns written in place below (markers, units, redaction, placeholders, markdown, broken encodings) are fixed values.
    n = lambda p: F.regexp_count(t, F.lit(p))
    some = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), line_array(F.col("text")).alias("ls"))
    base = base.withColumn("full", F.filter("ls", lambda x: x.rlike(r"(?U)\S")))
    base = base.withColumn("listed", F.filter("ls", lambda x: x.rlike(LISTED_LINE)))
    heads = F.transform(F.filter("listed", lambda x: x.rlike(HEADING_LINE)), lambda x: F.struct(F.regexp_extract(x, HEADING_LINE, 1).cast("int").alias("number"), X.squeeze(F.regexp_extract(x, HEADING_LINE, 2)).alias("title")))
    blocks = F.filter(F.transform(F.split(t, r"(?U)\n\s*\n"), X.squeeze), lambda x: x != "")
    long_lines = F.transform(F.filter(ls, lambda x: F.length(x) >= 30), X.squeeze)
    d = base.withColumns({
        "heads": heads, "blocks": blocks, "line_keys": _keys(long_lines, 30), "words": F.regexp_extract_all(t, F.lit(r"(?U)\w+"), F.lit(0)), "first": F.coalesce(F.get(full, F.lit(0)), F.lit("")), "lens": F.transform(full, F.length),
        "canonical": F.transform(F.regexp_extract_all(t, F.lit(signals.canonical), F.lit(0)), lambda x: F.substring(x, 1, 1)),
    })
    keys = F.transform("heads", lambda h: F.concat_ws(" ", h["number"].cast("string"), F.lower(h["title"])))
    # Words of letters alone: no look around them is needed, as words are whole.
    alpha = F.size(F.filter("words", lambda x: ~x.rlike(r"\P{L}")))
    d = d.withColumns({"keys": keys, "block_keys": _keys(c("blocks"), 80), "alpha": alpha, "ascii": n(r"(?U)\b[A-Za-z]{4,}\b")})
    line_types, line_extra = _repeats("line_keys")
    block_types, block_extra = _repeats("block_keys")
    longest, chars, least_one = F.coalesce(F.array_max("lens"), F.lit(0)), F.length(t), F.greatest(F.size(full), F.lit(1))
    over = lambda k: F.size(F.filter("lens", lambda x: x >= k))
    d = d.withColumns({
        "chars": chars, "tokens": F.size("words"), "physical_lines": F.size(ls), "nonempty_lines": F.size(full), "paragraphs": F.size("blocks"), "max_line_chars": longest,
        "longest_line_share": F.round(longest / F.greatest(chars, F.lit(1)), 4), "lines_ge_300_chars": over(300), "lines_ge_500_chars": over(500), "lines_ge_600_chars": over(600),
        "lines_ge_1000_chars": over(1000), "mean_chars_per_nonempty_line": F.round(chars / least_one, 2),
        "bullet_line_count": count_lines(c("listed"), BULLET_LINE), "dash_list_count": count_lines(c("listed"), r"(?U)^\s*[-*+]\s+"),
        "unicode_bullet_line_count": count_lines(c("listed"), r"(?U)^\s*[•●▪◦‣]\s*"), "numbered_line_start_count": count_lines(c("listed"), NUMBERED_LINE),
        "inline_bullet_count": n(r"(?U)(?<=\S)[^\S\n]*[•●▪◦‣]") + n(r"(?U)(?<=\S)[^\S\n]{2,}[-*+][^\S\n]+"),
        "heading_inline_bullet_count": count_lines(c("listed"), NUMBERED_LINE + r".*[•●▪◦‣]"),
        "numbered_heading_count": F.size("heads"), "heading_numbers": F.concat_ws(",", F.transform("heads", lambda h: h["number"].cast("string"))),
        "duplicate_numbered_heading_extra": _extra(c("keys")),
        "adjacent_duplicate_heading_count": F.size(F.filter(F.arrays_zip(some(c("keys")).alias("a"), F.slice("keys", F.lit(2), F.greatest(F.size("keys"), F.lit(1))).alias("b")), lambda x: x["a"] == x["b"])),
        "canonical_clinical_sequence": F.concat_ws(",", "canonical"), "canonical_heading_count": F.size("canonical"), "repeated_canonical_heading_extra": _extra(c("canonical")),
        "clinical_history_hits": n(signals.sections[0]), "clinical_present_illness_hits": n(signals.sections[1]), "clinical_assessment_hits": n(signals.sections[2]),
        "clinical_field_hits": n(signals.field), "patient_specific_hits": n(signals.patient), "case_opening": F.col("first").rlike(signals.opening),
        "education_heading_count": F.size(F.filter("heads", lambda h: h["title"].rlike(signals.topic))), "education_prose_hits": n(signals.prose),
        "definition_title": F.exists("heads", lambda h: h["title"].rlike(signals.definition)) | F.col("first").rlike(signals.definition),
        "question_label_hits": n(signals.question), "answer_label_hits": n(signals.answer), "doctor_greeting_hits": n(signals.greeting), "consultation_closing_hits": n(signals.closing),
        "question_at": F.regexp_instr(t, F.lit(signals.question)), "answer_at": F.regexp_instr(t, F.lit(signals.answer)),
        "starts_listed": F.col("first").rlike(BULLET_LINE), "start": F.lower(F.regexp_replace("first", r"(?U)^\s+", "")),
        "redaction_runs": n(r"\*{3,}"), "redaction_chars": F.length(F.array_join(F.regexp_extract_all(t, F.lit(r"\*{3,}"), F.lit(0)), "")), "placeholder_hits": n(r"\[[^\]\n]{2,60}\]"),
        "markdown_hits": n(r"(?mU)(?<!\*)\*\*(?!\*)|^\s*\*\s+|^\s*#{1,6}\s+"), "mojibake_hits": n("\ufffd|â€|Ã©|Ã¨|Ãª|Ä‘"), "decomposed_codepoints": n(r"\p{Mn}"),
        "lower_upper_glue_hits": n(GLUE), "punct_upper_glue_hits": n(rf"[.!?](?=[A-Z\x{{80}}-\x{{10ffff}}])(?=[{UPPER}])"), "heading_glue_hits": n(signals.heading_glue),
        "consecutive_word_repeat_hits": n(r"(?iuU)\b(\w{2,})\s+\1\b"), "concatenated_repeat_hits": n(r"(?iuU)(\w{4,})\1"), "legacy_phrase_repeat_hits": phrase_repeats(t),
        "attached_number_unit_hits": n(r"(?iuU)(?<!\w)\d+(?:[.,]\d+)?(?:micromol/l|mmol/l|µmol/l|ml/ngày|mg/dl|mmhg|mcg|l/ph|l/p|g/l|u/l|mg|ml|cm|kg|fr|cc|g)(?!\w)"),
        "multiple_space_runs": n(r"(?U)[^\S\n]{2,}"), "leading_indent_lines": count_lines(ls, r"(?U)^[ \t]+\S"), "trailing_space_lines": count_lines(ls, r"[ \t]+$"),
        "tab_count": n("\t"), "zero_width_space_count": n("\u200b"), "nbsp_count": n("\u00a0"), "carriage_return_count": n("\r"), "has_utf8_bom": t.startswith("\ufeff"),
        "repeated_line_types": line_types, "repeated_line_extra": line_extra, "repeated_paragraph_types": block_types, "repeated_paragraph_extra": block_extra,
        "ascii_word_count": c("ascii"), "ascii_word_ratio": F.round(c("ascii") / F.greatest(c("alpha"), F.lit(1)), 4),
    })
    hit = lambda name: (c(name) > 0).cast("int")
    sections = ("clinical_history_hits", "clinical_present_illness_hits", "clinical_assessment_hits")
    labels = c("question_label_hits") + c("answer_label_hits")
    d = d.withColumns({
        "bullet_line_ratio": F.round(c("bullet_line_count") / least_one, 4), "list_marker_count": c("dash_list_count") + c("unicode_bullet_line_count") + c("numbered_line_start_count"),
        "canonical_full_1_2_3": c("canonical_clinical_sequence") == "1,2,3", "canonical_partial_or_malformed": (c("canonical_heading_count") > 0) & (c("canonical_clinical_sequence") != "1,2,3"),
        "clinical_section_count": sum((hit(x) for x in sections), F.lit(0)), "clinical_heading_total": sum((c(x) for x in sections), F.lit(0)),
        "qa_complete": (c("question_label_hits") > 0) & (c("answer_label_hits") > 0), "qa_partial": (c("question_label_hits") > 0) != (c("answer_label_hits") > 0),
        "qa_implicit_without_marker": (labels == 0) & (c("doctor_greeting_hits") > 0) & (c("consultation_closing_hits") > 0),
        "compacted_layout": (longest / F.greatest(chars, F.lit(1)) >= 0.72) | ((c("nonempty_lines") <= 3) & (longest >= 500)),
        "fragment_start": (c("nonempty_lines") == 0) | c("starts_listed") | F.exists(F.array(*[F.lit(x) for x in signals.fragments]), lambda p: F.startswith("start", p)),
        "abnormal_qa_label_position": F.greatest("question_at", "answer_at") - 1 > chars * 0.35,
        "legacy_glue_or_repeat_proxy": c("lower_upper_glue_hits") + c("legacy_phrase_repeat_hits") > 0,
    })
    d = d.withColumns({
        "genre_qa": c("qa_complete") | ((labels > 0) & (c("doctor_greeting_hits") > 0)) | c("qa_implicit_without_marker"),
        "genre_clinical": (c("clinical_section_count") >= 2) | (c("clinical_field_hits") >= 3) | c("case_opening") | ((c("patient_specific_hits") >= 3) & (c("clinical_field_hits") >= 1)),
        "genre_health_education": (c("education_heading_count") >= 2) | c("definition_title") | ((c("education_heading_count") >= 1) & (c("education_prose_hits") >= 2)),
    })
    qa, clinical, education = c("genre_qa"), c("genre_clinical"), c("genre_health_education")
    genres, open_ = qa.cast("int") + clinical.cast("int") + education.cast("int"), ~c("compacted_layout")
    layout = (
        F.when(qa & open_, "qa_dialogue").when(education & (c("numbered_heading_count") >= 2) & open_, "numbered_health_article")
        .when(clinical & (c("clinical_section_count") >= 2) & open_, "numbered_clinical_template").when(c("case_opening") & open_, "narrative_case")
        .when(~open_ | ((c("nonempty_lines") <= 5) & c("fragment_start")), "fragment_or_compacted").otherwise("freeform_or_hybrid")
    )
    d = d.withColumns({
        "major_genre_count": genres, "mixed_major_genre": genres >= 2, "layout_proxy": layout, "embedded_qa_clinical": qa & clinical, "embedded_article_clinical": education & clinical,
        "clinical_field_intrusion": qa & ~clinical & (c("clinical_field_hits") > 0),
        "clinical_heading_intrusion": (c("clinical_heading_total") > 0) & (c("clinical_section_count") < 2) & (qa | education),
    })
    stitches = ("mixed_major_genre", "clinical_heading_intrusion", "clinical_field_intrusion")
    counts = ("duplicate_numbered_heading_extra", "repeated_canonical_heading_extra", "heading_glue_hits", "heading_inline_bullet_count")
    stitching = sum((c(x).cast("int") for x in stitches), F.lit(0)) + sum((hit(x) for x in counts), F.lit(0)) + (c("fragment_start") & (genres >= 1)).cast("int")
    d = d.withColumn("stitching_signal_count", stitching)
    return d.drop("text", "ls", "full", "heads", "blocks", "first", "lens", "canonical", "keys", "question_at", "answer_at", "starts_listed", "start", "listed", "line_keys", "block_keys", "words", "alpha", "ascii")


def label_overlap(docs: DataFrame, signals: Signals) -> DataFrame:
    """(doc_id, jaccard, overlap, question_tokens, answer_tokens) of content words after the first question and the answer that follows it.

    A document without both, or without content words on either side, has null ratios.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def after(text: Column, pattern: str) -> Column:
        at = F.regexp_instr(text, F.lit(pattern))
        # A letter in front, so that the rest doesn't begin a line of its own.
        return F.when(at > 0, F.concat(F.lit("x"), F.substring(text, at + F.length(F.regexp_substr(text, F.lit(pattern))), F.length(text))))

    d = d.withColumn("rest", after(F.col("text"), signals.question)).withColumn("tail", after(F.col("rest"), signals.answer))
    at = F.regexp_instr("rest", F.lit(signals.answer))
    content = lambda t: F.array_distinct(F.filter(X.word_tokens(t), lambda w: (F.length(w) >= 2) & ~w.isin(*signals.stopwords)))
    found = F.col("tail").isNotNull()
    d = d.select("doc_id", F.when(found, content(F.substring(F.col("rest"), F.lit(2), at - 2))).alias("q"), F.when(found, content(F.substring("tail", 2, 1 << 30))).alias("a"))
    both, q, a = F.size(F.array_intersect("q", "a")), F.coalesce(F.size("q"), F.lit(0)), F.coalesce(F.size("a"), F.lit(0))
    q, a = F.greatest(q, F.lit(0)), F.greatest(a, F.lit(0))
    ratio = lambda x: F.when((q > 0) & (a > 0), F.round(both / F.greatest(x, F.lit(1)), 4))
    return d.select("doc_id", ratio(q + a - both).alias("jaccard"), ratio(F.least(q, a)).alias("overlap"), q.alias("question_tokens"), a.alias("answer_tokens"))


def heading_repeats(docs: DataFrame) -> DataFrame:
    from .lines import duplicate_headings

    return duplicate_headings(numbered_headings(line_rows(docs)))


def shares(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, share of all)."""
    c = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def assertion_combinations(spans: DataFrame) -> DataFrame:
    """(combination, n, share): sorted assertions joined by +, or (empty)."""
    key = F.when(F.size("assertions") == 0, "(empty)").otherwise(F.array_join(F.array_sort("assertions"), "+"))
    return shares(spans.select(key.alias("combination")), "combination")


def span_density(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(mean, least, upper_median, most) number of spans of a document, documents without any included."""
    n = docs.select("doc_id").join(spans.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    total, least, most, mean = n.agg(F.count("*"), F.min("n"), F.max("n"), F.round(F.avg("n"), 4)).first()
    # The element at place n // 2 of the sorted counts, from the counts' own histogram.
    h = n.groupBy("n").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy("n"))  # one row for each different count
    median = h.withColumn("upto", upto).where(F.col("upto") > total // 2).agg(F.min("n").alias("upper_median"))
    return median.select(F.lit(mean).cast("double").alias("mean"), F.lit(least).cast("long").alias("least"), F.lit(most).cast("long").alias("most"), "upper_median")


def quantiles(df: DataFrame, column: str) -> DataFrame:
    """(least, p25, median, p75, most), interpolated."""
    p = lambda q: F.percentile(column, F.lit(q))
    return df.agg(F.min(column).alias("least"), p(0.25).alias("p25"), p(0.5).alias("median"), p(0.75).alias("p75"), F.max(column).alias("most"))


def density_buckets(df: DataFrame, column: str) -> DataFrame:
    """(bucket, n): 0, 1-4, 5-9, 10-19, 20+."""
    x = F.col(column)
    b = F.when(x == 0, "0").when(x < 5, "1-4").when(x < 10, "5-9").when(x < 20, "10-19").otherwise("20+")
    return df.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def genre_combinations(structured: DataFrame) -> DataFrame:
    """(genres, n): active genres joined by +, or unclassified."""
    g = F.concat_ws("+", F.when(F.col("genre_qa"), "qa"), F.when(F.col("genre_clinical"), "clinical"), F.when(F.col("genre_health_education"), "health_education"))
    return structured.groupBy(F.when(g == "", "unclassified").otherwise(g).alias("genres")).agg(F.count("*").alias("n"))


def files_where(structured: DataFrame, *flags: str) -> DataFrame:
    """(flag, doc_id): the documents that satisfy each flag, a row each."""
    held = F.array(*[F.when(F.col(f), F.lit(f)) for f in flags])
    return structured.select(F.explode(held).alias("flag"), "doc_id").where("flag is not null")


def summary(structured: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each flag the number of documents, for each number its mean and largest value."""
    kinds = dict(structured.dtypes)
    out = [F.count("*").alias("n_docs")]
    for c in columns:
        out += [F.count_if(c).alias(c)] if kinds[c] == "boolean" else [F.round(F.avg(c), 4).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max")]
    return structured.agg(*out)
