"""Lexicons: the cues and patterns that extraction and assertion rules are given.

``CLINICAL_VI`` is for Vietnamese clinical notes.  ``PLAIN`` is a small neutral one for other corpora.
Patterns are Java regular expressions, matched without regard to case.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Concept types, those that carry assertions and those that carry codes (fixed values).
TYPES = ("TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "CHẨN_ĐOÁN", "THUỐC")
SYMPTOM, LAB_NAME, LAB_RESULT, DIAGNOSIS, DRUG = TYPES
ASSERTION_TYPES = (DIAGNOSIS, DRUG, SYMPTOM)
CODE_TYPES = (DIAGNOSIS, DRUG)
ASSERTIONS = ("isHistorical", "isNegated", "isFamily")

#: Characters that cling to either end of a span (fixed value).
EDGE_CHARS = " \t\r\n.,;:*-–—•+()[]\"'"

FLAGS = "(?iuU)"


@dataclass(frozen=True)
class Lexicon:
    headers: tuple[tuple[str, str | None, str | None], ...]  # pattern, top section, sub-context; the first that matches wins
    label: str  # group 1 is the label of a "label: value" line
    lab: str
    route: str
    history: str
    negation: str
    negation_false: str
    family: str
    narrator: str
    narrative: str
    stop_spans: tuple[str, ...]
    skip_subs: tuple[str, ...] = ("narrative", "procedure", "imaging")
    # List markers, numbers, doses and emphasis, the same in all lexicons.
    bullet: str = r"^(\s*(?:[-*+•]|\d+[.)]|\*\s*\d+[.)])\s+)"
    number: str = r"\d+([.,]\d+)?"
    dose: str = r"\b\d+([.,]\d+)?\s?(mg|mcg|ml|g|iu|units?)\b"
    markdown: str = r"\*\*|__"


# The cue lists of Vietnamese clinical notes.
CLINICAL_VI = Lexicon(
    headers=(
        (r"tiền sử bệnh hiện tại|bệnh sử hiện tại|lịch sử bệnh hiện tại|quá trình bệnh", "present", None),
        (r"(?:tiền sử|tiền căn)(?!\s*\d)", "history", None),
        (r"đánh giá tại bệnh viện|khám tại bệnh viện|tại bệnh viện", "hospital", None),
        (r"thuốc (trước|đã điều trị|điều trị)|thuốc trước khi|danh sách thuốc", None, "drug"),
        (r"bệnh (lý )?(mạn|mãn) tính|bệnh mạn|bệnh kèm|chẩn đoán", None, "diagnosis"),
        (r"triệu chứng|lý do (nhập viện|khám)|than phiền", None, "symptom"),
        (r"kết quả (xét nghiệm|phòng thí nghiệm|labo)|xét nghiệm", None, "lab"),
        (r"chẩn đoán hình ảnh|kết quả hình ảnh", None, "imaging"),
        (r"thủ thuật|phẫu thuật", None, "procedure"),
        (r"diễn biến|sự kiện|đặc điểm|tình trạng|yếu tố nguy cơ", None, "narrative"),
    ),
    label=(
        r"^\s*(lý do (?:nhập viện|khám)|triệu chứng(?: hiện tại| khi (?:nhập viện|vào viện))?|"
        r"bệnh (?:lý )?(?:mạn|mãn) tính|bệnh mạn tính|thuốc(?: trước khi nhập viện| đã điều trị)?|"
        r"chẩn đoán|kết quả xét nghiệm|lý do)\s*:\s*"
    ),
    lab=(
        r"\b(wbc|neut%?|lymp?h%?|hgb|hct|plt|rbc|troponin|creatinin[e]?|glucose|inr|"
        r"alt|ast|ure|urea|bun|spo2|natri|kali|bạch cầu|tiểu cầu|hồng cầu|men gan|"
        r"tổng phân tích|công thức máu|chức năng gan|nước tiểu|đường huyết|điện tâm đồ|"
        r"ecg|x-quang|siêu âm|ct|mri|holter)\b"
    ),
    route=r"\b(po|iv|im|sc|bid|tid|qid|qd|qhs|qam|q\d+h|prn|nebs?|daily)\b",
    history=(
        r"tiền sử|trước khi nhập viện|trước nhập viện|trong quá khứ|tiền căn|"
        r"đã từng|bệnh (mạn|mãn) tính|trước đây|cách đây"
    ),
    negation=r"\bkhông\b|\bchưa\b|\bâm tính\b|\(-\)|\bloại trừ\b|\bkhông có\b|\bkhông ghi nhận\b",
    negation_false=r"không xác định|không đặc hiệu|không rõ|không điển hình|không phụ thuộc",
    family=(
        r"\bbố\b|\bmẹ\b|cha mẹ|anh trai|chị gái|em trai|em gái|người thân|"
        r"thành viên (trong )?gia đình|trong gia đình (có|bị)|tiền sử gia đình|di truyền"
    ),
    narrator=r"người nhà (kể|cho biết|nhận thấy|báo)|theo lời (kể của )?người nhà",
    narrative=(
        r"\b(decreased|increased|changed|discontinued|started|stopped|switched|held|"
        r"đang dùng|đã dùng|giảm liều|tăng liều|ngừng|bắt đầu|quyết định|chuyển sang|tiền sử)\b"
    ),
    stop_spans=(
        "và", "hoặc", "nhưng", "là", "của", "các", "có", "được", "cho", "với", "khi",
        "một", "khoảng một", "trong", "sau", "trước", "đã", "bị", "vào", "ra", "tại",
    ),
)

PLAIN = Lexicon(
    headers=(
        (r"^the ", "present", None),
        (r"^of ", "history", None),
        (r"^(der|die) ", "hospital", None),
        (r"license", None, "drug"),
        (r"^in ", None, "diagnosis"),
        (r"^(la|le|de) ", None, "symptom"),
        (r"^to ", None, "narrative"),
    ),
    label=r"^\s*(the|in|la)\s*:\s*",
    lab=r"\b(ing|tion|rest|ment)\b",
    route=r"\b(her|den|des)\b",
    history=r"(^| )(was|est|ist|fue)( |$)",
    negation=r"(^| )(not|and|nicht|pas|no)( |$)",
    negation_false=r"and the|no se",
    family=r"(^| )(her|sie|elle|ella)( |$)",
    narrator=r"(^| )(that|dass|qui|que)( |$)",
    narrative=r"\b(is|was|est|ist)\b",
    stop_spans=("the", "of", "and", "la", "de", "der", "die"),
)
