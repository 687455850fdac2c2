"""Scores on literal rows, and the folds against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import similarity, text as X
from spanloom.functions.lexicon import DRUG, SYMPTOM
from spanloom.operators import score, spans

SPAN = "doc_id long, idx long, type string, start long, end long, text string, assertions array<string>, codes array<string>"

# Three drugs with one code and one assertion each, two symptoms with neither.
GOLD = [
    (1, 0, DRUG, 0, 7, "aspirin", ["isHistorical"], ["1191"]),
    (1, 1, DRUG, 10, 19, "metformin", ["isHistorical"], ["6809"]),
    (1, 2, DRUG, 22, 32, "lisinopril", ["isHistorical"], ["29046"]),
    (1, 3, SYMPTOM, 40, 49, "chest pain", [], []),
    (1, 4, SYMPTOM, 55, 60, "cough", [], []),
]


def changed(k, **new):
    names = [c.split()[0] for c in SPAN.split(", ")]
    row = dict(zip(names, GOLD[k], strict=True)) | new
    return [tuple(row[n] for n in names) if j == k else g for j, g in enumerate(GOLD)]


CASES = {
    "identical": (GOLD, (1, 1, 1, 1)),
    "one wrong code": (changed(0, codes=["999"]), (1, 1, 4 / 6, 0.866667)),
    "one missing assertion": (changed(0, assertions=[]), (1, 0.8, 1, 0.94)),
    "one wrong type, coded": (changed(3, type=DRUG, codes=["5"]), (0.8, 1, 6 / 7, 0.882857)),
    "no predictions": ([], (0, 0.4, 0, 0.12)),
    "spurious, coded": ([*GOLD, (1, 5, DRUG, 70, 75, "other", [], ["7"])], (5 / 6, 1, 6 / 7, 0.892857)),
    "spurious, abstained": ([*GOLD, (1, 5, DRUG, 70, 75, "other", [], [])], (5 / 6, 1, 1, 0.95)),
}


@pytest.mark.parametrize("case", CASES)
def test_metric_cases(spark, case):
    pred, want = CASES[case]
    g, p = spark.createDataFrame(GOLD, SPAN), spark.createDataFrame(pred, SPAN)
    got = score.dataset_score(score.document_scores(g, p, g.select("doc_id").distinct(), ["doc_id"])).first()
    for value, expected in zip((got["text_score"], got["assertions_score"], got["candidates_score"], got["final_score"]), want, strict=True):
        assert expected is None or value == pytest.approx(expected, abs=1e-6)


def test_greedy_match_prefers_text_then_later_indices(spark):
    g = spark.createDataFrame([(1, 0, "A", 0, 10, "x", [], []), (1, 1, "A", 100, 110, "x", [], []), (1, 2, "A", 200, 210, "long", [], [])], SPAN)
    p = spark.createDataFrame([(1, 0, "A", 0, 10, "x", [], []), (1, 1, "A", 201, 210, "other", [], []), (1, 2, "B", 200, 210, "long", [], [])], SPAN)
    assert {(r["gi"], r["pi"]) for r in score.greedy_match(g, p, ["doc_id"]).collect()} == {(1, 0), (2, 1)}


def test_matches_are_one_to_one(spark):
    rng = random.Random(3)
    make = lambda n: [(d, k, rng.choice("AB"), s := rng.randint(0, 200), s + rng.randint(1, 20), rng.choice("xyzuvw"), [], []) for d in range(5) for k in range(n)]
    g, p = make(20), make(25)
    got = [(r["doc_id"], r["gi"], r["pi"]) for r in score.greedy_match(spark.createDataFrame(g, SPAN), spark.createDataFrame(p, SPAN), ["doc_id"]).collect()]
    want = []
    for d in range(5):
        edges = []
        for a in g:
            for b in p:
                if a[0] == b[0] == d and a[2] == b[2]:
                    inter, hull = min(a[4], b[4]) - max(a[3], b[3]), max(a[4], b[4]) - min(a[3], b[3])
                    s = 2.0 if a[5] == b[5] else max(0, inter) / hull
                    if s > 0.5:
                        edges.append((s, b[1], a[1]))
        used_p, used_g = set(), set()
        for _, b, a in sorted(edges, reverse=True):
            if b not in used_p and a not in used_g:
                used_p.add(b)
                used_g.add(a)
                want.append((d, a, b))
    assert sorted(got) == sorted(want)


def test_sequence_scores(spark):
    tags = spark.createDataFrame([("O", "O"), ("B-A", "B-A"), ("I-A", "O"), ("O", "B-A"), ("B-B", "B-A")], "gold_tag string, pred_tag string")
    r = score.token_confusion(tags).first()
    assert (r["accuracy"], r["tp"], r["fp"], r["fn"], r["tn"]) == (0.4, 1, 2, 1, 1)
    t = spark.createDataFrame([(1, k, x) for k, x in enumerate(["B-PER", "I-PER", "O", "B-LOC", "I-ORG"])], "doc_id long, pos long, tag string")
    assert {(r["type"], r["start"], r["end"]) for r in spans.chunks(t).collect()} == {("PER", 0, 1), ("LOC", 3, 3), ("ORG", 4, 4)}


def test_prf_averages(spark):
    g = spark.createDataFrame([(1, "A", 0, 1), (1, "B", 3, 3)], "doc_id long, type string, start long, end long")
    p = spark.createDataFrame([(1, "A", 0, 1), (1, "B", 4, 4)], g.schema)
    out = {r["average"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in score.averages(score.set_prf(g, p, g.columns)).collect()}
    assert out["micro"] == out["macro"] == out["weighted"] == (0.5, 0.5, 0.5, 2)


def test_word_edit_distance(spark):
    rng = random.Random(1)
    rows = [([rng.choice("abcde") for _ in range(rng.randint(0, 8))], [rng.choice("abcde") for _ in range(rng.randint(0, 8))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    out = df.select(similarity.word_levenshtein(F.col("a"), F.col("b")).alias("x"), similarity.word_levenshtein_any("a", "b").alias("y")).collect()
    assert [r["x"] for r in out] == [r["y"] for r in out]


def test_ratios():
    assert similarity.indel_ratio("", "") == 100 and similarity.indel_ratio("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert similarity._token_set("a b c", "c b a") == 100 and similarity._token_set("a b", "a b c") == 100 and similarity._token_set("", "x") == 0
    assert similarity.lcs_length("abcbdab", "bdcaba") == 4


def test_jaccard_and_iou(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    r = spark.range(1).select(
        X.jaccard(a(), a()).alias("both"), X.jaccard(a("x"), a()).alias("one"), X.jaccard(a("x", "y"), a("y", "z")).alias("some"),
        X.iou(F.lit(0), F.lit(10), F.lit(5), F.lit(15)).alias("half"), X.iou(F.lit(5), F.lit(5), F.lit(5), F.lit(5)).alias("void"), X.iou(F.lit(9), F.lit(5), F.lit(0), F.lit(9)).alias("bad"),
    ).first()
    assert (r["both"], r["one"], r["void"], r["bad"]) == (1, 0, 0, 0) and r["some"] == pytest.approx(1 / 3) and r["half"] == pytest.approx(1 / 3)
