"""Gold from items, reports, files of concepts, token classifiers and tagged sequences."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.functions.lexicon import CLINICAL_VI, DIAGNOSIS, DRUG, LAB_RESULT, SYMPTOM
from spanloom.operators import evaluate, gold, hygiene, score, spans
from spanloom.plans import pipelines, sql
from spanloom.sources import io


def literal_places(text, items):
    """(start, error) of items (item, after, occ): the surveyed rule, step by step."""
    cursor, out = 0, []
    for item, after, occ in items:
        begin = cursor
        if after and after in text:
            begin = text.index(after) + len(after)
        if occ:
            at = -1
            for _ in range(occ):
                at = text.find(item, at + 1)
                if at < 0:
                    break
        else:
            at = text.find(item, begin)
            at = text.find(item) if at < 0 else at
        cursor = at + len(item) if at >= 0 else cursor
        out.append(at)
    return out


def test_items_are_placed_by_the_literal_rule(spark):
    rng = random.Random(4)
    words = ["aa", "a", "b", "ab", "c d", "é"]
    docs, items, want = [], [], {}
    for d in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        own = [(rng.choice([*words, "zz"]), rng.choice([None, None, "b", "c", "zz"]), rng.choice([None, None, None, 1, 2, 9])) for _ in range(rng.randint(1, 9))]
        docs.append((d, text))
        items += [(d, k, *x) for k, x in enumerate(own)]
        want |= {(d, k): at for k, at in enumerate(literal_places(text, own))}
    docs.append((99, None))
    items += [(99, 0, "a", None, None), (100, 0, "a", None, None)]
    df = spark.createDataFrame(items, "doc_id long, k long, item string, after string, occ int")
    got = spans.locate_in_order(df, spark.createDataFrame(docs, "doc_id long, text string"))
    found = {(r["doc_id"], r["k"]): r["start"] for r in got.collect()}
    assert found == want | {(99, 0): -1}


def test_phrases_are_placed_by_the_literal_rule(spark):
    rng = random.Random(5)
    words = ["Aa", "b", "ab", "aab", "É"]
    docs, plans, want = [], [], set()
    for d in range(60):
        text = "".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
        own = list(dict.fromkeys("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 5))))
        docs.append((d, text))
        plans += [(d, p) for p in own]
        taken, found, low = [], [], text.lower()
        for p in sorted(own, key=lambda x: (-len(x), x)):
            for at in range(len(low) - len(p) + 1):
                if low.startswith(p.lower(), at) and not any(at < e and at + len(p) > s for s, e in taken):
                    taken.append((at, at + len(p)))
                    found.append((d, p, at, at + len(p)))
                    break
        want |= set(found) if len(found) >= 0.6 * len(own) else set()
    got = spans.locate_longest_first(spark.createDataFrame(plans, "doc_id long, phrase string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == want


def test_gold_and_its_report(spark):
    docs = spark.createDataFrame([(1, "fever and cough"), (2, "no pain")], "doc_id long, text string")
    rows = [(1, 0, "cough", SYMPTOM, None, None, ["isNegated"], None), (1, 1, "fever", SYMPTOM, None, None, None, None), (1, 2, "gone", SYMPTOM, None, None, None, None), (2, 0, "pain", SYMPTOM, "no ", None, None, ["C1"])]
    items = spark.createDataFrame(rows, "doc_id long, k long, item string, type string, after string, occ int, assertions array<string>, candidates array<string>")
    concepts, faults = gold.build_gold(items, docs)
    assert {(r["doc_id"], r["text"], r["start"], r["end"]) for r in concepts.collect()} == {(1, "cough", 10, 15), (1, "fever", 0, 5), (2, "pain", 3, 7)}
    assert [tuple(r) for r in faults.collect()] == [(1, 2, "gone")]
    assert tuple(gold.gold_report(items, concepts, faults).first()) == (2, 3, 1)


def test_a_file_for_each_document(spark, tmp_path):
    rows = [(10, "fever", SYMPTOM, 0, 5, ["isNegated"], []), (10, "mi", DIAGNOSIS, 9, 11, [], ["I21"]), (7, "5 mg", LAB_RESULT, 1, 5, [], [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, type string, start int, end int, assertions array<string>, candidates array<string>")
    docs = spark.createDataFrame([(10,), (7,), (3,)], "doc_id long")
    for _ in range(2):  # again, over what is there
        assert io.write_concepts(df, str(tmp_path / "out"), docs=docs) == 3
        assert sorted(os.listdir(tmp_path / "out")) == ["10.json", "3.json", "7.json"]
    told = json.loads((tmp_path / "out" / "10.json").read_text())
    assert told[0] == {"text": "fever", "type": SYMPTOM, "assertions": ["isNegated"], "position": [0, 5]}
    assert told[1] == {"text": "mi", "type": DIAGNOSIS, "candidates": ["I21"], "assertions": [], "position": [9, 11]}
    back = {(r["stem"], r["text"], r["start"]) for r in io.read_concepts(spark, str(tmp_path / "out")).collect()}
    assert back == {("10", "fever", 0), ("10", "mi", 9), ("7", "5 mg", 1)}


def test_text_is_composed_before_words_are_cut(spark):
    whole, apart = "bệnh nhân sốt cao đã ba ngày nay rồi nhé", "bệnh nhân sốt cao đã ba ngày nay rồi nhé"
    docs = spark.createDataFrame([(1, whole), (2, apart), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in hygiene.reuse_pairs(docs, 3).select("a", "b", "jaccard").collect()] == [(1, 2, 1.0)]


def test_token_classifier_chain(spark):
    text = "Tiền sử\n- viêm phổi (đã dùng thuốc\n- aspirin\n- sốt cao\nvà 12.5"
    at = lambda w: (text.index(w), text.index(w) + len(w))
    rows = []

    def add(window, pos, word, tag, prob, cut=0):
        s, e = at(word)
        rows.append((1, window, pos, s, e - cut, tag, prob))

    add(0, 0, "viêm", f"B-{DIAGNOSIS}", 0.99)
    add(0, 1, "phổi (đã dùng", f"I-{DIAGNOSIS}", 0.97)  # the parenthesis is never closed: it goes
    add(0, 2, "aspirin", f"B-{DRUG}", 0.99, cut=2)  # snaps back to the word
    add(1, 0, "aspirin", f"B-{DRUG}", 0.96)  # the same span from the next window
    add(1, 1, "sốt cao\nvà", f"B-{SYMPTOM}", 0.98)  # over two lines: the second is a stop word
    add(1, 2, "cao", f"B-{DIAGNOSIS}", 0.96)  # overlaps a surer one
    add(1, 3, "12", f"B-{LAB_RESULT}", 0.99)  # a number keeps its decimals
    add(1, 4, "Tiền", f"B-{SYMPTOM}", 0.5)  # not sure enough
    tokens = spark.createDataFrame(rows, "doc_id long, window long, pos long, ts long, te long, tag string, prob double")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {(r["text"], r["type"], r["start"], round(r["conf"], 2), r["section"]) for r in pipelines.from_logits(tokens, docs, CLINICAL_VI, 0.95).collect()}
    assert got == {
        ("viêm phổi", DIAGNOSIS, at("viêm")[0], 0.98, "history"), ("aspirin", DRUG, at("aspirin")[0], 0.99, "history"),
        ("sốt cao", SYMPTOM, at("sốt")[0], 0.98, "history"), ("12.5", LAB_RESULT, at("12.5")[0], 0.99, "history"),
    }


def test_sequences_are_filled_and_cut(spark):
    rows = [("s1", ["a", "b", "c"], ["B-X", "O", "B-Y"], "B-X* a B-X* O* b B-Y*"), ("s2", ["a"], ["B-X"], "B-X* a B-X* B-X* b B-X*"), ("s3", ["a"], ["O"], "")]
    df = spark.createDataFrame(rows, "sent_id string, words array<string>, gold array<string>, encoded string")
    got = {(r["sent_id"], r["pos"]): (r["word"], r["gold_tag"], r["pred_tag"]) for r in evaluate.sequence_tags(df).collect()}
    assert got == {("s1", 0): ("a", "B-X", "B-X"), ("s1", 1): ("b", "O", "0"), ("s1", 2): ("c", "B-Y", "0"), ("s2", 0): ("a", "B-X", "B-X"), ("s3", 0): ("a", "O", "0")}
    side = spark.createDataFrame([("s", 0, "a", "B-X"), ("s", 1, "b", "B-X")], "sent_id string, pos int, word string, tag string")
    heard = side.withColumn("word", F.when(F.col("pos") == 1, "bb").otherwise(F.col("word")))
    told = {(r["kind"], r["tag"]): round(r["f1"], 6) for r in evaluate.both_scores(side, heard).collect()}
    assert told["words", "X"] == 0.5 and told["dummy", "X"] == 1.0


@pytest.mark.parametrize("name", ["span_norm", "span_items", "span_token_set_ratio"])
def test_names_are_registered(spark, name):
    assert name in sql.register(spark)


def test_registered_functions_equal_the_columns(spark):
    from spanloom.functions import text as X

    sql.register(spark)
    df = spark.createDataFrame([("  Đau  đầu\t(nhẹ) ", "sốt"), ("", "x y"), (None, "a"), ("Aspirin 81 MG po", "aspirin"), ("one two three four", "two one")], "s string, t string")
    s, t = F.col("s"), F.col("t")
    mine = df.select(X.normalize_for_match(s), X.words(s), X.word_tokens(s), X.word_trigrams(s), X.head_token(X.normalize_for_match(s)), X.jaccard(X.words(s), X.words(t)), X.residual_words(s), X.is_natural_name(s, 3), X.trim_at_parenthesis(s), X.too_long(s, 3))
    named = df.selectExpr("span_norm(s)", "span_words(s)", "span_tokens(s)", "span_trigrams(s)", "span_head(span_norm(s))", "span_jaccard(span_words(s), span_words(t))", "span_residual_words(s)", "span_natural_name(s, 3)", "span_before_parenthesis(s)", "span_too_long(s, 3)")
    assert [tuple(r) for r in named.collect()] == [tuple(r) for r in mine.collect()]
    ratios = df.where("s is not null").selectExpr("span_token_set_ratio(span_norm(s), span_norm(t)) a", "span_word_distance(span_words(s), span_words(t)) b").collect()
    assert ratios[2]["a"] == 100.0 and ratios[3]["b"] == 3


def test_counted_tuples_score_as_numbered_ones_and_are_shuffled_once(spark):
    import random

    from spanloom.operators import score

    rng = random.Random(4)
    rows = lambda: [(rng.choice(["s1", "s2", None]), k, rng.choice(["a", "b", None]), rng.choice(["B-X", "I-X", "B-Y", "O", "0"])) for k in range(80)]
    gold, pred = (spark.createDataFrame(rows(), "sent_id string, pos int, word string, tag string") for _ in "gp")
    want = [("words", *r) for r in map(tuple, score.tuple_scores(score.numbered_tuples(gold), score.numbered_tuples(pred)).collect())]
    want += [("dummy", *r) for r in map(tuple, score.tuple_scores(score.numbered_tuples(gold, False), score.numbered_tuples(pred, False)).collect())]
    told = evaluate.both_scores(gold, pred)
    assert sorted(map(tuple, told.collect())) == sorted(want)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_sides_of_one_table_score_alike_and_are_read_once(spark):
    draw = random.Random(4)
    rows = [(f"s{draw.randint(0, 9)}", k, draw.choice("xyz"), draw.choice(("O", "B-A", "I-A", "B-B")), draw.choice(("0", "O", "B-A", "B-B", "B-C"))) for k in range(300)]
    tags = spark.createDataFrame(rows, "sent_id string, pos int, word string, gold_tag string, pred_tag string")
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: read.add(1) or x)
    side = lambda c: tags.select("sent_id", "pos", "word", F.col(c).alias("tag"))
    want = sorted(map(tuple, evaluate.both_scores(side("gold_tag"), side("pred_tag")).collect()))
    for kind, with_words in (("words", True), ("dummy", False)):
        told = score.tuple_scores(*(score.numbered_tuples(side(c), with_words) for c in ("gold_tag", "pred_tag")))
        assert sorted(r[1:] for r in want if r[0] == kind) == sorted(map(tuple, told.select("tag", "precision", "recall", "f1").collect()))
    assert sorted(map(tuple, evaluate.tag_scores(tags.withColumn("word", seen("word"))).collect())) == want
    assert read.value == len(rows)


def test_tags_of_triples(spark):
    text = "B-A* x B-A* *O* y z* O* w* O* ** v **"
    want = [(m[1], m[0] if m[0] == m[2] else "0") for m in re.findall(r"(\S+)\* (\S+) (\S+)\*", text)]
    assert [tuple(x) for x in spark.createDataFrame([(text,)], "t string").select(X.decode_tags(F.col("t"))).first()[0]] == want
