"""Text functions, lines, sections, rules, spans and sources on literal rows."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spanloom.functions import repeats
from spanloom.functions import text as X
from spanloom.functions.lexicon import CLINICAL_VI, DIAGNOSIS, DRUG, LAB_NAME, LAB_RESULT, SYMPTOM
from spanloom.operators import hygiene, lines, link, profile, rules, spans, synth
from spanloom.plans import pipelines
from spanloom.sources import io
from spanloom.streaming import notes

NOTE = "\n".join([
    "1. Tiền sử bệnh",
    "Thuốc trước khi nhập viện:",
    "- aspirin 81 mg po daily (dose decreased)",
    "Bệnh mạn tính: tăng huyết áp",
    "2. Bệnh sử hiện tại",
    "Triệu chứng: đau ngực, không ho; khó thở",
    "Kết quả xét nghiệm: WBC 12,5",
    "Diễn biến",
    "- nằm viện ba ngày",
])


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_normalisation(spark):
    assert one(spark, X.normalize_for_match(F.col("s")), s="  Đau \t NGỰC\n") == "đau ngực"
    assert one(spark, X.normalize_for_match(F.col("s"), True), s="Đau Ngực") == "dau nguc"
    assert one(spark, X.head_token(F.col("s")), s="5 x-ray") == "ray" and one(spark, X.head_token(F.col("s")), s="1 2") is None


def test_trimming(spark):
    t = lambda s: one(spark, X.trim_parenthesis(F.col("s"), CLINICAL_VI), s=s)
    assert t("prograf (dose decreased from 5mg)") == "prograf" and t("Rosuvastatin (Crestor)") == "Rosuvastatin (Crestor)" and t("Bệnh thận (tiền sử") == "Bệnh thận" and t("(all") == "(all"
    b = one(spark, X.edge_trim(F.col("s"), F.lit(100)), s="- *fever*, ")
    assert (b["start"], b["end"]) == (103, 108)
    assert one(spark, X.trim_at_parenthesis(F.col("s")), s="a b (c)") == "a b" and one(spark, X.trim_at_parenthesis(F.col("s")), s="(c) d") == "(c) d"


def test_snapping(spark):
    def snap(s, a, b):
        r = one(spark, X.snap_to_words(F.col("s"), F.lit(a), F.lit(b)), s=s)
        return s[r["start"] : r["end"]]

    assert snap("level 5.2 mg", 8, 9) == "5.2" and snap("level 5.2 mg", 6, 7) == "5.2"
    assert snap("Ngừng thuốc", 1, 3) == "Ngừng" and snap("end. Next", 0, 2) == "end"


def test_marked_context(spark):
    s = "word " * 60 + "target" + " tail" * 40
    out = one(spark, X.mark_context(F.col("s"), F.lit(300), F.lit(306)), s=s)
    assert "[ENT] target [/ENT]" in out and out.startswith("word ") and out.split("[/ENT]")[1].strip().split(" ")[-1] == "tail"


def test_flexible_find(spark):
    f = lambda s, n, h=0: one(spark, X.find_flexible(F.col("s"), F.col("n"), F.lit(h)), s=s, n=n)
    assert f("a b a b", "a b", 1) == 4 and f("a b", "a b", 2) == 0 and f("😀 x  (y)\nz", "x (y) z") == 2 and f("abc", "d") == -1


def test_matches_count_code_points(spark):
    r = one(spark, lines.matches(F.col("s"), "[a-z]+"), s="😀ab, 日本 cd")
    assert [(x["start"], x["match"]) for x in r] == [(1, "ab"), (8, "cd")]
    assert one(spark, lines.matches(F.col("s"), "x"), s="") == []


def test_sections_and_rules(spark):
    docs = spark.createDataFrame([(1, NOTE)], "doc_id long, text string")
    s = {r["line_no"]: (r["top"], r["sub"]) for r in lines.sections(lines.lines(docs), CLINICAL_VI).collect()}
    assert s[0] == ("history", None) and s[2] == ("history", "drug") and s[3] == ("history", "diagnosis") and s[4] == ("present", None)
    got = {(r["type"], r["text"]) for r in rules.extract(docs, CLINICAL_VI).collect()}
    assert got == {(DRUG, "aspirin 81 mg po daily"), (DIAGNOSIS, "tăng huyết áp"), (SYMPTOM, "đau ngực"), (SYMPTOM, "không ho"), (SYMPTOM, "khó thở"), (LAB_NAME, "WBC"), (LAB_RESULT, "12,5")}


def test_rule_pipeline(spark):
    docs = spark.createDataFrame([(1, NOTE)], "doc_id long, text string")
    drugs = spark.createDataFrame([(1, 11, "aspirin"), (2, 12, "aspirin 81 mg po daily")], "row_id long, code long, name string")
    out = {r["text"]: r for r in pipelines.predict(docs, CLINICAL_VI, drugs=drugs).collect()}
    assert out["aspirin 81 mg po daily"]["candidates"] == ["12"] and out["aspirin 81 mg po daily"]["assertions"] == ["isHistorical"]
    assert out["không ho"]["assertions"] == ["isNegated"] and out["đau ngực"]["assertions"] == []
    assert all(NOTE[r["start"] : r["end"]] == r["text"] for r in out.values())


def test_bio_round_trip(spark):
    tags = [("B-A", 0, 2), ("I-A", 3, 5), ("I-B", 6, 8), ("O", 9, 10), ("I-B", 11, 12), ("B-B", 13, 14), ("B-A", 15, 15)]
    df = spark.createDataFrame([(1, k, s, e, t, 0.5) for k, (t, s, e) in enumerate(tags)], "doc_id long, pos long, ts long, te long, tag string, prob double")
    assert {(r["type"], r["start"], r["end"]) for r in spans.bio_decode(df).collect()} == {("A", 0, 5), ("B", 6, 8), ("B", 11, 12), ("B", 13, 14)}


def test_suppression_is_disjoint(spark):
    df = spark.createDataFrame([(1, "A", 0, 5, 0.9), (1, "B", 3, 8, 0.95), (1, "A", 8, 9, 0.1), (1, "C", 0, 20, 0.9)], "doc_id long, type string, start long, end long, conf double")
    assert {(r["start"], r["end"]) for r in spans.suppress(df).collect()} == {(3, 8), (8, 9)}


def test_section_lookup_takes_the_earlier_line(spark):
    s = spark.createDataFrame([(1, 0, 0, "abc", "x"), (1, 1, 4, "def", "y")], "doc_id long, line_no int, start long, line string, top string")
    p = spark.createDataFrame([(1, 3), (1, 4), (1, 9)], "doc_id long, start long")
    assert {r["start"]: r["section"] for r in spans.section_at(p, s).collect()} == {3: "x", 4: "y", 9: None}


def test_locating(spark):
    docs = spark.createDataFrame([(1, "fever and cough. No fever; later cough")], "doc_id long, text string")
    items = spark.createDataFrame([(1, 0, "fever", None, None), (1, 1, "fever", "No ", None), (1, 2, "cough", None, None), (1, 3, "gone", None, None)], "doc_id long, k long, item string, after string, occ int")
    assert [(r["k"], r["start"], r["error"]) for r in spans.locate_in_order(items, docs).orderBy("k").collect()] == [(0, 0, False), (1, 20, False), (2, 33, False), (3, -1, True)]
    plan = spark.createDataFrame([(1, "cough"), (1, "fever and")], "doc_id long, phrase string")
    assert [(r["phrase"], r["start"]) for r in spans.locate_longest_first(plan, docs).collect()] == [("fever and", 0), ("cough", 10)]
    assert {r["start"] for r in spans.sweep(docs, ["fever", "cough"]).collect()} == {0, 10, 20, 33}


def test_merge_pieces_and_first_piece_labels(spark):
    p = spark.createDataFrame([(1, 0, 3, "A", 0.4), (1, 3, 6, "B", 0.9), (1, 8, 9, "A", 0.2)], "doc_id long, start long, end long, label string, score double")
    assert {(r["start"], r["end"], r["label"]) for r in spans.merge_pieces(p).collect()} == {(0, 6, "B"), (8, 9, "A")}


def test_links(spark):
    terms = spark.createDataFrame([(0, 10, "red bolt"), (1, 11, "red nut"), (2, 12, "blue bolt"), (3, 13, "Red  Bolt")], "row_id long, code long, name string")
    q = spark.createDataFrame([(1, "RED bolt"), (2, "red bolts"), (3, "zzz")], "query_id long, query string")
    assert {(r["query_id"], r["code"]) for r in link.exact(q, terms).collect()} == {(1, 10), (1, 13)}
    got = {(r["query_id"], r["code"]) for r in link.match_terminology(q, terms, 1).collect()}
    assert got == {(1, 10), (2, 10)}
    assert {r["query_id"] for r in link.abstain(link.blocked(q, terms), 99).collect()} == {1}
    fused = link.fuse(link.exact(q, terms), link.blocked(q, terms)).where("query_id = 1 and code = 10").first()
    assert fused["score"] == pytest.approx(2 / 60)


def test_greedy_keep_differs_from_components(spark):
    a = [f"w{k}" for k in range(12)]
    docs = spark.createDataFrame([(1, " ".join(a[:10])), (2, " ".join(a[1:11])), (3, " ".join(a[2:12])), (4, ""), (5, "")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in hygiene.greedy_keep(docs, 0.75).collect()) == [1, 3, 4, 5]


def test_greedy_keep_is_brute_force_on_mixed_texts(spark):
    draw = random.Random(5)
    base = [[f"w{draw.randrange(30)}" for _ in range(draw.randrange(1, 25))] for _ in range(6)]
    texts = []
    for _ in range(80):
        t = list(draw.choice(base))
        for _ in range(draw.randrange(4)):
            t[draw.randrange(len(t))] = f"x{draw.randrange(4)}"
        texts.append(" ".join(t))
    texts += ["", None, texts[0], "a b", "a b"]

    def grams(t):
        w = (t or "").split()
        return {" ".join(w)} if 0 < len(w) < 3 else {" ".join(w[k : k + 3]) for k in range(len(w) - 2)}

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bar in (0.5, 0.8, 1.0):
        kept = []
        for k, t in enumerate(texts):
            g = grams(t)
            if not any(g and len(g & grams(texts[o])) / len(g | grams(texts[o])) >= bar for o in kept):
                kept.append(k)
        assert sorted(r["doc_id"] for r in hygiene.greedy_keep(docs, bar).collect()) == kept
    assert hygiene.greedy_keep(docs.limit(0)).collect() == []


def test_bio_encode_is_brute_force_over_buckets(spark):
    draw = random.Random(3)
    spans_ = [(1, s, s + draw.choice((0, 1, 5, 64, 300)), "T") for s in draw.sample(range(900), 12)] + [(2, 0, 4, "U")]
    tokens = [(1, k, s, s + draw.choice((0, 2, 9, 130))) for k, s in enumerate(draw.sample(range(1000), 150))] + [(3, 0, 0, 4)]
    want = {}
    for d, k, ts, te in tokens:
        hit = min(((s, e, t) for o, s, e, t in spans_ if o == d and ts < e and te > s), default=None)
        want[d, k] = "O" if hit is None else ("B-" if ts <= hit[0] else "I-") + hit[2]
    told = spans.bio_encode(spark.createDataFrame(tokens, "doc_id long, pos long, ts long, te long"), spark.createDataFrame(spans_, "doc_id long, start long, end long, type string"))
    assert {(r["doc_id"], r["pos"]): r["tag"] for r in told.collect()} == want


def test_templates_and_slots(spark):
    spans_ = F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("S").alias("type")), F.struct(F.lit(10).alias("start"), F.lit(15).alias("end"), F.lit("D").alias("type")))
    assert one(spark, X.blank_spans(F.col("s"), spans_), s="fever and cough") == "{S} and {D}"
    assert one(spark, synth.fill_slots(F.col("s"), F.array(F.lit("x"), F.lit("y"))), s="{S} and {D}.") == "x and y."
    assert one(spark, X.residual_words(F.col("s")), s="{S} and {D} too") == 2


QA = "Câu hỏi: đau bụng kéo dài?\nBác sĩ trả lời:\nChào bạn, đau bụng kéo dài cần khám.\n"
TEMPLATE = "1. Tiền sử bệnh\n- x\n2. Bệnh sử hiện tại\nđau***\n3. Đánh giá tại bệnh viện\n3. Đánh giá tại bệnh viện\nổn"
ARTICLE = "1. Viêm gan là gì?\nmột\n2. Nguyên nhân của bệnh • do virus\nhai\nba bốn năm sáu"


def test_structure_of_vietnamese_documents(spark):
    rows = [(1, QA), (2, TEMPLATE), (3, None), (4, ARTICLE), (5, "Thêm. " + "a" * 600), (6, "Câu hỏi: đau?"), (7, "BN nam 45 tuổi vào viện\nđau\nsốt\nho\nmệt"), (8, "dài " * 20 + "\nTrả lời: a"), (9, QA + "lý do nhập viện")]
    r = {x["doc_id"]: x for x in profile.structure(spark.createDataFrame(rows, "doc_id long, text string"), profile.MEDICAL_VI).collect()}
    layouts = {1: "qa_dialogue", 2: "numbered_clinical_template", 3: "fragment_or_compacted", 4: "numbered_health_article", 5: "fragment_or_compacted", 7: "narrative_case"}
    assert {k: r[k]["layout_proxy"] for k in layouts} == layouts
    assert r[1]["qa_complete"] and r[1]["genre_qa"] and r[6]["qa_partial"] and not r[6]["genre_qa"]  # a label alone, without a greeting, is no dialogue
    assert (r[2]["canonical_clinical_sequence"], r[2]["repeated_canonical_heading_extra"], r[2]["duplicate_numbered_heading_extra"], r[2]["adjacent_duplicate_heading_count"]) == ("1,2,3,3", 1, 1, 1)
    assert r[2]["canonical_partial_or_malformed"] and r[2]["redaction_chars"] == 3 and r[2]["stitching_signal_count"] == 2 and r[2]["dash_list_count"] == 1
    assert r[4]["definition_title"] and r[4]["genre_health_education"] and r[4]["heading_inline_bullet_count"] == 1 and r[4]["inline_bullet_count"] == 1 and r[4]["heading_numbers"] == "1,2"
    assert r[5]["fragment_start"] and r[5]["compacted_layout"] and r[5]["lines_ge_600_chars"] == 1 and r[3]["fragment_start"]
    assert r[7]["case_opening"] and r[8]["abnormal_qa_label_position"] and not r[1]["abnormal_qa_label_position"]
    assert r[9]["clinical_field_intrusion"] and not r[9]["genre_clinical"] and r[9]["stitching_signal_count"] == 1


def test_label_overlap(spark):
    rows = [(1, QA), (2, "Trả lời: a\nCâu hỏi: b"), (3, None), (4, "Câu hỏi:\nTrả lời: gan")]
    out = {r["doc_id"]: tuple(r)[1:] for r in profile.label_overlap(spark.createDataFrame(rows, "doc_id long, text string"), profile.MEDICAL_VI).collect()}
    # đau bụng kéo dài; the answer adds khám.
    assert out == {1: (0.8, 1.0, 4, 5), 2: (None, None, 0, 0), 3: (None, None, 0, 0), 4: (None, None, 0, 1)}


def test_first_features(spark):
    text = "1. Tiền sử gia đình: mẹ bị THA\nWBC 10.5, không sốt, không rõ\naspirin 81 mg po daily, iv 5ml\nN/A đauBụng ** liver liver disease disease"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "abcdef abcdef abcdef abcdef")], "doc_id long, text string")
    m = profile.measures(docs)
    r = {x["doc_id"]: x.asDict() for x in m.collect()}
    want = {
        "chars": len(text), "lines": 4, "section_hits": 2, "history_hits": 1, "neg_hits": 1, "family_subject_hits": 2, "family_narrator_hits": 0, "dosage_hits": 2, "route_hits": 3, "lab_token_hits": 1,
        "lab_result_lines": 1, "camel_glue_hits": 1, "phrase_repeat_hits": len(re.findall(r"(.{6,}?)\1", text)), "eng_count": 6, "na_hits": 1, "markdown_hits": 1,
    }
    assert {k: r[1][k] for k in want} == want and r[3]["phrase_repeat_hits"] == len(re.findall(r"(.{6,}?)\1", "abcdef abcdef abcdef abcdef"))
    f = {x["doc_id"]: x.asDict() for x in profile.flags(m).collect()}
    assert f[1]["f_drug"] and f[1]["f_family"] and not f[1]["f_lab"] and f[2]["f_short"] and f[2]["f_freeform"] and not f[2]["f_codeswitch"]


def test_noise_against_another_engine(spark):
    texts = ["đau đau bụng bụng bụng", "abcdabcd xyzxyz", "a  - b   * c", "x • y\n• z • w", "5mg 3 mg 7ml/ngày 2,5g/l x9g", "Đau đau"]
    out = {r["doc_id"]: r for r in profile.structure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), profile.MEDICAL_VI).collect()}
    for k, t in enumerate(texts):
        inline = sum(bool(line[: m.start()].strip()) for line in t.split("\n") for m in re.finditer("[•●▪◦‣]", line)) + len(re.findall(r"(?<=\S)[^\S\n]{2,}[-*+][^\S\n]+", t))
        units = r"(?i)(?<!\w)\d+(?:[.,]\d+)?(?:micromol/l|mmol/l|µmol/l|ml/ngày|mg/dl|mmhg|mcg|l/ph|l/p|g/l|u/l|mg|ml|cm|kg|fr|cc|g)(?!\w)"
        want = (inline, len(re.findall(r"(?iu)\b(\w{2,})\s+\1\b", t)), len(re.findall(r"(?iu)(\w{4,})\1", t)), len(re.findall(units, t)))
        assert tuple(out[k][c] for c in ("inline_bullet_count", "consecutive_word_repeat_hits", "concatenated_repeat_hits", "attached_number_unit_hits")) == want, t


def test_set_cover_fills_up(spark):
    rng = random.Random(2)
    names = [f"f{k}" for k in range(9)]
    has = {i: {x for x in names if rng.random() < 0.25} for i in range(40)}
    chars, rare = {i: rng.randint(1, 6) for i in has}, names[:3]
    for known in (names, [*names, "nowhere"]):
        left, want = set(known), []
        while left and len(want) < 12:
            best = max((i for i in has if i not in want), key=lambda i: (sum(3 if x in rare else 1 for x in has[i] & left), len(has[i]), -i))
            want.append(best)
            left -= has[best]
        want += sorted((i for i in has if i not in want), key=lambda i: (-len(has[i]), chars[i], i))[: 12 - len(want)]
        features = spark.createDataFrame([(i, x) for i, own in has.items() for x in own], "doc_id long, feature string")
        out = hygiene.set_cover(features, spark.createDataFrame(list(chars.items()), "doc_id long, chars int"), known, rare, 12)
        assert [r["doc_id"] for r in out.orderBy("round").collect()] == want


def test_contained_pairs_lose_nothing(spark):
    rng = random.Random(8)
    line = " ".join(f"common{k}" for k in range(12))
    texts = []
    for k in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 40))]
        texts.append((line + " " if k % 3 == 0 else "") + " ".join(words))
        if k % 4 == 0:
            texts.append(" ".join([*words[: len(words) * 2 // 3], *(f"v{rng.randrange(400)}" for _ in range(6))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {(r["a"], r["b"]): tuple(r)[2:] for r in hygiene.reuse_pairs(docs, 4).where("containment >= 0.3").collect()}
    assert whole and {(r["a"], r["b"]): tuple(r)[2:] for r in hygiene.contained_pairs(docs, 0.3, 4).collect()} == whole


def test_concept_files(spark, tmp_path):
    rows = [{"text": "aspirin", "type": DRUG, "candidates": ["1"], "assertions": [], "position": [0, 7]}, {"text": "ho", "type": SYMPTOM, "assertions": ["isNegated"], "position": [9, 11]}]
    for stem in ("2", "10"):
        (tmp_path / f"{stem}.json").write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "skip.txt").write_text("no")
    back = io.read_concepts(spark, str(tmp_path))
    assert back.count() == 4
    one_doc = back.where("stem = '2'").withColumn("doc_id", F.lit(1))
    assert json.loads(io.concept_json(one_doc).first()["json"]) == rows
    stems = back.select("stem").distinct()
    assert [r["stem"] for r in io.natural_order(stems).collect()] == ["2", "10"]
    made = back.groupBy("stem").agg(F.lit("[]").alias("json"))
    assert io.package(made, str(tmp_path / "out.zip")) == 2


def test_tables(spark, tmp_path):
    line = "|".join(["1", "ENG", "", "", "", "", "", "", "", "", "", "RXNORM", "IN", "1", 'a "quoted" name', "", "N", ""]) + "|"
    (tmp_path / "conso.rrf").write_text(line + "\n" + line.replace("RXNORM", "OTHER") + "\n")
    t = io.read_terminology(spark, str(tmp_path / "conso.rrf")).collect()
    assert len(t) == 1 and t[0]["str"] == 'a "quoted" name' and t[0].asDict().keys() == set(io.CONSO_KEPT)
    (tmp_path / "t.csv").write_text('﻿code,name\nA, "x ""y"" z" \n', encoding="utf-8")
    assert io.read_csv(spark, str(tmp_path / "t.csv")).columns == ["code", "name"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert io.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text(NOTE, encoding="utf-8")
    out = notes.section_lines(notes.read_stream(spark, str(tmp_path / "in")), CLINICAL_VI)
    q = notes.write_stream(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 9 and {r["top"] for r in rows if r["start"] >= NOTE.index("2. Bệnh")} == {"present"}


def test_phrase_repeats_are_those_of_the_pattern():
    rnd = random.Random(3)
    plain = re.compile(r"([^\n\r\x85\u2028\u2029]{6,}?)\1")
    for _ in range(300):
        texts = ["".join(rnd.choice("ab\n é😀"[: rnd.randint(1, 6)]) for _ in range(rnd.randint(0, 90))) * rnd.randint(1, 3) for _ in range(rnd.randint(0, 4))]
        assert repeats.count_repeats(texts) == [len(plain.findall(t)) for t in texts]


def test_phrase_repeats_of_a_long_line(spark):
    words = [f"{k:x}" for k in range(40_000)]
    line = " ".join([*words, *words[-20_000:]])
    start = time.perf_counter()
    got = spark.createDataFrame([(1, line), (2, "a" * 100_000), (3, None)], "doc_id long, text string").select(repeats.phrase_repeats("text").alias("n")).collect()
    assert [r["n"] for r in got] == [1, 8333, None] and time.perf_counter() - start < 60


def test_matches_of_a_long_line(spark):
    start = time.perf_counter()
    rows = spark.createDataFrame([(1, "ab " * 200_000), (2, None), (3, "")], "doc_id long, text string").select("doc_id", F.posexplode(lines.matches(F.col("text"), r"\S+")).alias("k", "m"))
    assert rows.agg(F.count("*"), F.sum(F.col("m.start") - 3 * F.col("k"))).first()[:] == (200_000, 0)
    assert time.perf_counter() - start < 60


def test_snapping_over_long_words(spark):
    for s, a, b, want in ((f"a {'x' * 500} b", 200, 210, (2, 502)), (f"{'1.2' * 100} b", 150, 151, (0, 300)), (f"{'x' * 61} {'y' * 62}-", 100, 101, (62, 124))):
        r = one(spark, X.snap_to_words(F.col("s"), F.lit(a), F.lit(b)), s=s)
        assert (r["start"], r["end"]) == want


def test_patterns_are_read_in_short_where_no_marked_letter_is(spark):
    from spanloom.operators import profile as P

    rng = random.Random(8)
    bits = ["tiền sử", "anh trai", "em GÁI", "EM TRAI", "lý do khám", "LÝ DO KHÁM", "không rõ", "KHÔNG", "âm tính", "(-)", "chưa", "\n 1. ", "\n2) x", "người nhà kể", "không", "a", "bố", " ", "éa", "aB", "đB", "bĐ", "eÀ", ".", "WBC 12", "x wbc", "\r\n", " "]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    plain = {k: F.regexp_count("text", F.lit(p)) for k, p in P.FEATURES.items()} | {"camel_glue_hits": F.regexp_count("text", F.lit(rf"[{P.LOWER}][{P.UPPER}]"))}
    plain["neg_hits"] = F.greatest(F.regexp_count("text", F.lit(P.NEGATION)) - F.regexp_count("text", F.lit(P.NOT_NEGATION)), F.lit(0))
    ls = F.split("text", r"\R|[\x1c-\x1e]")
    plain["lab_result_lines"] = F.size(F.filter(ls, lambda x: x.rlike(P.FEATURES["lab_token_hits"]) & x.rlike(r"(?U)\b\d+(?:[.,]\d+)?\b")))
    want = df.select("doc_id", *[c.alias(k) for k, c in plain.items()]).orderBy("doc_id").collect()
    assert P.measures(df).select("doc_id", *plain).orderBy("doc_id").collect() == want
    assert set(P.UNMARKED) < {*P.FEATURES.values(), P.NEGATION, P.NOT_NEGATION}


def test_repeats_and_words_are_worked_out_once(spark):
    """Lines and blocks are squeezed in one place of the plan, and counts are those of a literal version."""
    import re
    from collections import Counter

    from spanloom.operators import profile

    line, block = "The  line that is long\tenough to count", "a block of text that is quite long, " * 3
    texts = [None, "", "\n\n", f"{line}\n" * 2 + line.replace("  ", " ").upper() + "\nshort\nshort\n", f"{block}\n \n{block.upper()}\n\n{block}\n\n{line}", "x3 a_b é naïve 12 ab-cd́ ² ａｂ\nab "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    columns = ["repeated_line_types", "repeated_line_extra", "repeated_paragraph_types", "repeated_paragraph_extra"]
    found = profile.structure(docs, profile.PLAIN)
    assert found.select(*columns)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 3

    def repeats(parts, least):
        n = Counter(x.lower() for x in (re.sub(r"\s+", " ", p).strip() for p in parts) if len(x) >= least)
        return sum(v > 1 for v in n.values()), sum(v - 1 for v in n.values())

    got = {r["doc_id"]: tuple(r)[1:] for r in found.select("doc_id", *columns, "tokens", "ascii_word_ratio").collect()}
    for k, text in enumerate(texts):
        t = text or ""
        assert got[k][:4] == repeats(t.split("\n"), 30) + repeats(re.split(r"\n\s*\n", t), 80), k
    assert got[5][4:] == (9, 0.0)
    assert got[3][4] == 26 and got[3][5] == round(sum(len(w) >= 4 for w in re.findall(r"\w+", texts[3])) / 26, 4)


def test_words_of_texts_are_tagged_as_tokens_are(spark):
    draw = random.Random(8)
    texts = {k: "".join(draw.choice(("a", "bc", " ", "  ", "\n", "\r\n", "\t", "đ")) for _ in range(draw.randint(0, 120))) for k in range(40)}
    docs = spark.createDataFrame([*texts.items(), (99, None), (100, "")], "doc_id long, text string")
    spans_ = [(k, s, s + draw.choice((0, 1, 5, 40)), draw.choice("TU")) for k in texts if k % 5 for s in draw.choices(range(60), k=6)]
    gold = spark.createDataFrame(spans_, "doc_id long, start long, end long, type string")
    want = {}
    for k, text in texts.items():
        at, n = 0, 0
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            for j, m in enumerate(re.finditer(r"[^ \t\n\x0b\f\r]+", line)):
                ts, te = at + m.start(), at + m.end()
                hit = min(((s, e, t) for d, s, e, t in spans_ if d == k and ts < e and te > s), default=None)
                want[k, i * 100_000 + j] = (n, ts, te, "O" if hit is None else ("B-" if ts <= hit[0] else "I-") + hit[2])
                n += 1
            at += len(line) + 1
    told = lambda df: {(r["doc_id"], r["pos"]): (r["place"], r["ts"], r["te"], r["tag"]) for r in df.collect()}
    whole, inside = spans.bio_texts(docs, gold), spans.bio_texts(docs, gold, outside=False)
    assert told(whole) == want and told(inside) == {k: v for k, v in want.items() if v[3] != "O"}
    decoded = lambda df: sorted(tuple(r) for r in spans.bio_decode(df.withColumn("prob", F.lit(0.5))).collect())
    assert decoded(inside) == decoded(whole.drop("place"))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # texts and spans: no buckets of words


def test_lines_are_not_shuffled_for_their_offsets(spark):
    docs = spark.createDataFrame([(1, "ab\r\n\nc"), (2, None), (3, ""), (4, "x")], "doc_id long, text string")
    got = lines.lines(docs)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0, "ab"), (1, 1, 3, ""), (1, 2, 4, "c"), (3, 0, 0, ""), (4, 0, 0, "x")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
