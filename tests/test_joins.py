"""Joins by similarity, matching, runs and sweeps against brute force."""

import random
import re
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.functions.similarity import _token_set
from spanloom.operators import hygiene, link, score, sweep

# Fuzzy names


def _names(n, seed):
    rng = random.Random(seed)
    pool = ["ab", "mi", "cd", "acute", "old", "heart", "fever", "sốt", "đau", "ngực", "of", "x", "appendicitis", "appendicitus", "infarction", "a"]
    out = ["ab cd", "acute mi", "old mi of heart", "a", "x" * 90, "x" * 80 + " y", "", "  ", None]
    for _ in range(n):
        ws = [rng.choice(pool) if rng.random() < 0.8 else "".join(rng.choice("abcdeđư") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 6))]
        out.append(rng.choice(["", " "]).join(ws) if rng.random() < 0.1 else " ".join(ws).upper() if rng.random() < 0.2 else " ".join(ws))
    return out


def _norm(s):
    return " ".join((s or "").lower().split())


@pytest.mark.parametrize(("bar", "most"), [(78.0, 30), (78.0, 3), (60.0, 500), (95.0, 30)])
def test_fuzzy_equals_full_scan(spark, bar, most):
    names, queries = _names(250, 1), ["ab", "mi", *_names(60, 2)]
    terms = spark.createDataFrame([(k, f"c{k % 90}", n) for k, n in enumerate(names)], "row_id long, code string, name string")
    asked = spark.createDataFrame([(k, q) for k, q in enumerate(queries)], "query_id long, query string")
    got = sorted((r["query_id"], r["code"], _norm(r["name"]), round(r["score"], 6)) for r in link.fuzzy(asked, terms, bar, most).collect())
    want = []
    for k, q in enumerate(queries):
        scored = sorted((-_token_set(_norm(q), _norm(n)), i) for i, n in enumerate(names))
        want += [(k, f"c{i % 90}", _norm(names[i]), round(-s, 6)) for s, i in [x for x in scored if -x[0] >= bar][:most]]
    assert got == sorted(want)
    assert any(k == 0 for k, *_ in got) and any(k == 1 for k, *_ in got)  # two letters find longer names


def test_fuzzy_over_no_names(spark):
    none = spark.createDataFrame([], "row_id long, code string, name string")
    asked = spark.createDataFrame([(1, "ab")], "query_id long, query string")
    assert link.fuzzy(asked, none).collect() == []
    assert link.fuzzy(asked.where("false"), none).collect() == []


# Runs and nearest texts


def _texts(n, seed, vocabulary=60):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, vocabulary)}"
    blocks = [" ".join(word() for _ in range(rng.randint(9, 40))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = [rng.choice(blocks) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5))]
        out.append(" ".join(parts))
    return [*out, "", "w1 " * 300, "w1 " * 250 + "w2"]


def test_longest_runs_equal_the_literal_search(spark):
    texts = _texts(30, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))], "a long, b long")
    for r in hygiene.longest_runs(pairs, docs).collect():
        x, y = texts[r["a"]].split(), texts[r["b"]].split()
        m = SequenceMatcher(None, x, y, autojunk=False).find_longest_match(0, len(x), 0, len(y))
        assert (r["run"], r["run_a"], r["run_b"]) == ((m.size, m.a, m.b) if m.size else (0, -1, -1))
        assert r["excerpt"] == " ".join(x[m.a : m.a + min(m.size, 28)])


def test_longest_runs_of_very_repetitive_texts_end(spark):
    docs = spark.createDataFrame([(1, "a " * 200_000), (2, "b " + "a " * 150_000)], "doc_id long, text string")
    start = time.time()
    r = hygiene.longest_runs(spark.createDataFrame([(1, 2)], "a long, b long"), docs).first()
    assert (r["run"], r["run_a"], r["run_b"]) == (150_000, 0, 1) and time.time() - start < 30


@pytest.mark.parametrize(("seed", "strong", "least"), [(5, 0.3, 40), (6, 0.5, 5), (7, 0.9, 1)])
def test_nearest_documents_equal_all_pairs(spark, seed, strong, least):
    texts = _texts(70, seed, 400)
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:5]])), "doc_id long, text string")
    want = hygiene.nearest(hygiene.reuse_pairs(docs), strong, least)
    key = lambda df: sorted((r["doc_id"], r["other"], round(r["containment"], 9), r["n_strong"]) for r in df.collect())
    assert key(hygiene.nearest_documents(docs, strong=strong, least=least)) == key(want)


def test_nearest_documents_with_one_line_in_a_third_of_many(spark):
    rng = random.Random(9)
    line = "a line of some fourteen words that very many of these texts hold alike indeed"
    rows = []
    for k in range(5000):
        own = " ".join(f"v{rng.randint(0, 10**9)}" for _ in range(rng.randint(20, 120)))
        rows.append((k, f"{own} {line}" if k % 3 == 0 else own))
    start = time.time()
    got = {r["doc_id"]: r for r in hygiene.nearest_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - start < 120
    shared = len(line.split()) - 7
    sizes = {k: len(t.split()) - 7 for k, t in rows if k % 3 == 0}
    assert set(got) == set(sizes)
    low = min(sizes.values())
    for k, r in got.items():
        # The smallest documents are the nearest to all larger ones; to the smallest, all are alike.
        pool = [j for j, n in sizes.items() if j != k and (n == low or sizes[k] == low)]
        assert r["other"] == min(pool) and abs(r["containment"] - shared / low) < 1e-9 and r["n_strong"] == 0


# Matching


def _fold(edges):
    taken, out = (set(), set()), []
    for g, p in edges:
        if g not in taken[0] and p not in taken[1]:
            taken[0].add(g)
            taken[1].add(p)
            out.append((g, p))
    return sorted(out)


@pytest.mark.parametrize("rounds", [0, 1, 2, 4])
def test_dominant_edges_equal_the_fold(spark, rounds):
    from pyspark.sql import functions as F

    rng, rows = random.Random(3), []
    for d in range(30):
        for _ in range(rng.choice([1, 5, 60])):
            rows.append((d, rng.randint(0, 12), rng.randint(0, 12), rng.choice([0.6, 0.7, 2.0])))
    rows += [(99, k // 2, (k + 1) // 2, float(1000 - k)) for k in range(60)]  # a chain that only its order settles
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, gi long, pi long, s double")
    got = score.dominant(df, ["doc_id"], -F.col("s"), -F.col("pi"), -F.col("gi"), rounds=rounds)
    assert sorted((g, p) for d, g, p in map(tuple, got.collect()) if d == 99) == _fold([(k // 2, (k + 1) // 2) for k in range(60)])
    by = {}
    for d, g, p in got.collect():
        by.setdefault(d, []).append((g, p))
    for d in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == d), key=lambda r: (-r[3], -r[2], -r[1]))
        assert sorted(by[d]) == _fold([(r[1], r[2]) for r in own])


def test_matching_of_a_document_with_very_many_edges_ends(spark):
    gold = spark.range(1000).selectExpr("1L doc_id", "id idx", "'A' type", "id * 100 start", "id * 100 + 90 end", "'same' text", "array() assertions", "array() codes")
    pred = spark.range(50).selectExpr("1L doc_id", "id idx", "'A' type", "id * 100 + 1 start", "id * 100 + 91 end", "'same' text", "array() assertions", "array() codes")
    start = time.time()
    got = sorted((r["gi"], r["pi"]) for r in score.greedy_match(gold, pred, ["doc_id"]).collect())
    assert got == [(950 + k, k) for k in range(50)] and time.time() - start < 60


# Sweep


def _literal_sweep(text, vocabulary, occupied, words):
    taken, out = list(occupied), []
    free = lambda a, b: not any(a < d and b > c for c, d in taken)
    for phrase in sorted(vocabulary, key=lambda p: (-len(p), p)):
        for m in re.finditer(r"(?<![\wÀ-ỹ])" + re.escape(phrase) + r"(?![\wÀ-ỹ])", text, re.I):
            if free(m.start(), m.end()):
                taken.append((m.start(), m.end()))
                out.append((m.start(), m.end(), m.group(), vocabulary[phrase], 1))
    for m in re.finditer(r"[A-Za-z][A-Za-z\-]{4,}", text):
        if free(m.start(), m.end()) and m.group().lower() in words:
            taken.append((m.start(), m.end()))
            out.append((m.start(), m.end(), m.group(), words[m.group().lower()], 2))
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 60])
def test_sweep_equals_the_literal_search(spark, shard_bytes):
    rng = random.Random(8)
    pool = ["fever", "high", "aspirin", "sốt", "cao", "đau", "ab", "co-codamol", "metformin", "x"]
    vocabulary = {"fever": "S", "high fever": "S", "sốt cao": "S", "ab ab": "T", "ab": "T", "cao": "U", "đau": "S", "fever high": "V", "(x)": "P"}
    words = {"aspirin": "D", "metformin": "D", "fever": "D", "co-codamol": "D"}
    texts, occupied = [], []
    for d in range(80):
        text = "".join(rng.choice(pool).upper() + rng.choice([" ", ", ", "", "\n"]) if rng.random() < 0.2 else rng.choice(pool) + rng.choice([" ", " ", " (x) ", "_"]) for _ in range(rng.randint(0, 40)))
        texts.append(text)
        for _ in range(rng.choice([0, 0, 3])):
            a = rng.randint(0, max(0, len(text) - 1))
            occupied.append((d, a, a + rng.randint(0, 12)))
    docs = spark.createDataFrame([*enumerate(texts), (500, None), (501, "")], "doc_id long, text string")
    table = lambda v: spark.createDataFrame([*v.items(), ("", "none")], "phrase string, type string")
    taken = spark.createDataFrame(occupied, "doc_id long, start long, end long")
    got = sweep.sweep(docs, table(vocabulary), taken, table(words), shard_bytes)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["text"], r["type"], r["stage"]))
    for d, text in enumerate(texts):
        own = [(a, b) for k, a, b in occupied if k == d]
        assert sorted(by.get(d, [])) == _literal_sweep(text, vocabulary, own, words)
    assert not {500, 501} & set(by)


def test_dense_keeps_the_smallest_rows_of_ties(spark):
    vectors = [[float(k % 3), 1.0] for k in range(700)]
    terms = spark.createDataFrame([(k, str(k), v) for k, v in enumerate(vectors)], "row_id long, code string, vector array<double>")
    queries = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "query_id long, vector array<double>")
    got = {}
    for r in link.dense(queries, terms, 4).collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["row_id"]))
    for k, v in enumerate(vectors):
        want = sorted((-(v[0] * w[0] + 1.0), n) for n, w in enumerate(vectors))[:4]
        assert sorted(got[k]) == want


def _shuffled(spark, run) -> int:
    """Bytes that the stages of ``run()`` write for others."""
    sc = spark.sparkContext
    stages = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in _listed(sc)}
    before = stages()
    run()
    time.sleep(1)
    return sum(n for k, n in stages().items() if k not in before)


def _listed(sc):
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return [found.apply(k) for k in range(found.size())]


def _unlike(n_docs: int, n_words: int):
    rng = random.Random(21)
    return [(k, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n_words))) for k in range(n_docs)]


def test_shingles_of_one_document_alone_are_shuffled_once_and_packed(spark):
    docs = spark.createDataFrame(_unlike(150, 2000), "doc_id long, text string")
    assert _shuffled(spark, lambda: hygiene.shared_shingles(docs).count()) < 14 * 150 * 2000


def test_runs_write_words_of_documents_in_pairs_only(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "b c d e"), (3, "x y")], "doc_id long, text string")
    written, real = {}, hygiene.shared_table
    monkeypatch.setattr(hygiene, "shared_table", lambda df, label: written.setdefault(label, real(df, label)))
    r = hygiene.longest_runs(spark.createDataFrame([(1, 2)], "a long, b long"), docs).first()
    assert (r["run"], r["run_a"], r["excerpt"]) == (3, 1, "b c d") and sorted(x["doc_id"] for x in written["words"].collect()) == [1, 2]


def test_trigrams_of_one_document_alone_are_shuffled_once_and_packed(spark):
    docs = spark.createDataFrame(_unlike(150, 2000), "doc_id long, text string")
    # The texts go along once more, about eight bytes a word.
    assert _shuffled(spark, lambda: hygiene.greedy_keep(docs).count()) < 24 * 150 * 2000


def test_repeated_rows_are_no_duplicates_of_themselves(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d f g h"), (3, "a b"), (4, "A  b")]
    kept = hygiene.greedy_keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 1, 2, 3]


def test_texts_are_normalised_once_for_their_classes(spark):
    docs = spark.createDataFrame([(1, "a  b"), (2, "A b "), (3, "c")], "doc_id long, text string")
    classes = hygiene.text_classes(docs)
    assert sorted(map(tuple, classes.collect())) == [(1, 1), (2, 1), (3, 3)]
    assert "sha2" not in classes._jdf.queryExecution().optimizedPlan().toString().lower()


def test_single_spaces_stay_and_other_white_space_is_one_space(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(" a\t\n\r  \u0085　b") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.trim(F.regexp_replace("t", r"(?U)\s+", " "))
    assert df.where(~plain.eqNullSafe(X.squeeze(F.col("t")))).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_over_parts_equals_all_pairs_and_shuffles_no_vectors(spark, monkeypatch, kind):
    rng = random.Random(5)
    vectors = [[rng.choice((rng.gauss(0, 1), 0.5, -0.5)) for _ in range(32)] for _ in range(900)]
    one = spark.createDataFrame(list(enumerate(vectors)), f"vec_id long, embedding array<{kind}>").withColumn("label", (F.col("vec_id") % 4).cast("int"))
    monkeypatch.setattr(link, "VECTOR_BLOCK", 50)
    q = one.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).repartition(4)
    t = one.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    own = [r["embedding"] for r in one.orderBy("vec_id").collect()]
    want = {k: sorted((-round(sum(x * y for x, y in zip(v, w, strict=True)), 9), n) for n, w in enumerate(own))[:7] for k, v in enumerate(own)}
    told = lambda: {r["query_id"]: [(-round(x["score"], 8), x["row_id"]) for x in r["found"]] for r in link.nearest(q, t, 7).collect()}
    near = {k: [(round(s, 8), n) for s, n in v if -s >= -2] for k, v in want.items()}
    assert told() == near
    monkeypatch.setattr(link, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(link, "TERM_BYTES", 40_000)  # some parts, whose bests are merged
    assert told() == near
    monkeypatch.setattr(link, "TERM_BYTES", 128 << 20)
    assert told() == near
    q.cache().count()
    assert _shuffled(spark, lambda: link.nearest(q, t, 7).write.format("noop").mode("overwrite").save()) < 20_000


def test_shingles_of_the_same_documents_are_one_group(spark, monkeypatch):
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    long, short = words(200), words(30)
    texts = [long, f"{words(20)} {long}", f"{long} {words(40)}", f"{short} {words(25)} {long}", f"{words(9)} {short}", words(50), "too few words", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {r["doc_id"]: r for r in hygiene.shared_shingles(docs).withColumn("many", hygiene.weight(F.col("sh"))).collect()}
    assert {k: (len(r["sh"]), r["many"]) for k, r in held.items()} == {0: (1, 193), 1: (1, 193), 2: (1, 193), 3: (2, 216), 4: (1, 23)}
    want = sorted(map(tuple, hygiene.reuse_pairs(docs).collect()))
    assert len(want) == 7
    for many in (hygiene.MANY, 7):  # few fit into a number: a passage is some groups
        monkeypatch.setattr(hygiene, "MANY", many)
        assert sorted(map(tuple, hygiene.contained_pairs(docs, 0.01).collect())) == want
        assert sorted(map(tuple, hygiene.contained_pairs(docs, 0.5).collect())) == [r for r in want if r[3] >= 0.5]
