"""Generators, batches, loads and caches."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.functions.lexicon import ASSERTION_TYPES, CLINICAL_VI, DIAGNOSIS, DRUG
from spanloom.operators import batches, generate
from spanloom.sources import load

LAB = "TÊN_XÉT_NGHIỆM"


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(DIAGNOSIS, k, f"disease {k}", f"D{k}") for k in range(7)] + [(DRUG, k, f"drug {k}", f"R{k}") for k in range(5)] + [(LAB, k, f"lab {k}", None) for k in range(3)]
    return spark.createDataFrame(rows, "type string, k long, name string, code string")


def check(docs, lengths=generate.LENGTH):
    """Every concept stands where it says; a document stops at the first step past its length."""
    rows = docs.collect()
    for r in rows:
        last = 0
        for c in r["concepts"]:
            assert r["text"][c["start"] : c["end"]] == c["text"] and c["start"] >= last
            last = c["end"]
        assert lengths[2] <= r["target"] <= lengths[3]
    return rows


def test_frame_documents(spark, catalog):
    frames = spark.createDataFrame(
        [(f"- {{{DIAGNOSIS}}}", 6), (f"bệnh nhân không có {{{DIAGNOSIS}}}", 2), (f"tiền sử dùng {{{DRUG}}} trị {{{DIAGNOSIS}}}", 2), (f"{{{LAB}}}: cao", 1)], "template string, freq long"
    )
    headers = spark.createDataFrame([("1. Heading", 3), ("Other:", 1)], "text string, freq long")
    fill = ("A neutral line.", "Another one, somewhat longer.")
    made = generate.frame_documents(spark.range(300).withColumnRenamed("id", "doc_id"), frames, headers, fill, catalog, CLINICAL_VI, most=400)
    rows = check(made)
    assert len(rows) == 300
    lines = Counter()
    for r in rows:
        assert r["text"].endswith("\n") and len(r["text"]) >= r["target"]
        own = r["text"].split("\n")[:-1]
        assert len(r["text"]) - len(own[-1]) - 1 < r["target"]  # one step less would not have been enough
        for x in own:
            lines["head" if x in ("1. Heading", "Other:") else "fill" if x in fill else "frame"] += 1
        for c in r["concepts"]:
            before = r["text"][: c["start"]].rsplit("\n", 1)[-1]
            if "không có" in before:
                assert c["assertions"] == ["isNegated"]
            elif "tiền sử" in before:
                assert c["assertions"] == ["isHistorical"]
            if c["type"] not in ASSERTION_TYPES:
                assert c["assertions"] == []
            assert c["candidates"] == [None if c["type"] == LAB else ("D" if c["type"] == DIAGNOSIS else "R") + c["text"].split()[1]]
    n = sum(lines.values())
    assert abs(lines["head"] / n - 0.15) < 0.02 and abs(lines["fill"] / n - 0.30) < 0.02
    free = [c for r in rows for c in r["concepts"] if c["type"] == DIAGNOSIS and r["text"][: c["start"]].rsplit("\n", 1)[-1] == "- "]
    assert abs(sum(bool(c["assertions"]) for c in free) / len(free) - 0.818) < 0.03
    assert len(set(made.agg(F.countDistinct("text")).first())) == 1
    again = generate.frame_documents(spark.range(120, 130).withColumnRenamed("id", "doc_id"), frames, headers, fill, catalog, CLINICAL_VI, most=400)
    assert {(r["doc_id"], r["text"]) for r in again.collect()} == {(r["doc_id"], r["text"]) for r in rows if 120 <= r["doc_id"] < 130}
    with pytest.raises(ValueError):
        generate.frame_documents(spark.range(3).withColumnRenamed("id", "doc_id"), frames.where("false"), headers, fill, catalog, CLINICAL_VI)


def test_note_documents(spark, catalog):
    templates = (
        generate.Template(("History", "Past:"), (generate.Slot(DIAGNOSIS, label="isHistorical"),), 1, 4, ("- ", "")),
        generate.Template(("Now",), (generate.Slot(DIAGNOSIS, cues=("no", "denies"), cue_share=0.25, cue_label="isNegated"),), 2, 5, ("- ",), (",\n", "\n")),
        generate.Template(("Drugs",), (generate.Slot(DRUG, before=("takes ",)), generate.Slot(LAB, before=(", seen by ",), share=0.5)), 1, 2),
    )
    made = generate.note_documents(spark.range(300).withColumnRenamed("id", "doc_id"), templates, ("All is well.", "Seen today."), catalog, most=300)
    rows = check(made)
    cued, glued = Counter(), 0
    for r in rows:
        assert len(r["text"]) >= r["target"] or r["text"].count("\n") > 100
        glued += bool(re.search(r"\b(?:no|denies|Now|Drugs|History)(?:disease|-)", r["text"]))
        for c in r["concepts"]:
            before = r["text"][: c["start"]]
            if c["type"] == DIAGNOSIS and c["assertions"] != ["isHistorical"]:
                negated = bool(re.search(r"(?:no|denies) ?$", before))
                assert negated == (c["assertions"] == ["isNegated"])
                cued[negated] += 1
    assert abs(cued[True] / sum(cued.values()) - 0.25) < 0.03
    assert 0 < glued < 0.3 * len(rows)
    lengths = sorted(r["target"] for r in rows)
    assert abs(lengths[150] - 1224) < 250  # the median of the log-normal


@pytest.mark.parametrize(("codes", "size"), [([400, 3, 3, 2, 1, 1], 8), ([5] * 40, 16), ([1], 4), ([2, 1], 64)])
def test_contrastive_batches_hold_their_constraint(spark, codes, size):
    rows = [(f"c{k}", f"a{k}-{i}", f"b{i}") for k, n in enumerate(codes) for i in range(n)]
    pairs = spark.createDataFrame([*rows, (None, "x", "y")], "code string, a string, b string")
    got = batches.contrastive_batches(pairs, size)
    own = got.collect()
    assert sorted((r["code"], r["a"], r["b"]) for r in own) == sorted(rows)
    by = {}
    for r in own:
        by.setdefault(r["batch"], []).append(r)
    for held in by.values():
        assert len({r["code"] for r in held}) == len(held) <= size
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    sizes = [len(x) for x in by.values()]
    assert max(sizes) - min(sizes) <= 1
    hard = spark.createDataFrame([(f"a{k}-{i}", j, f"n{k}-{i}-{j}") for k, n in enumerate(codes) for i in range(n) for j in range((k + i) % 4)], "a string, nth int, negative string")
    code = {a: c for c, a, _ in rows}
    for r in batches.padded_negatives(got, hard, 3).collect():
        k, i = map(int, r["a"][1:].split("-"))
        mine = [f"n{k}-{i}-{j}" for j in range((k + i) % 4)][:3]
        assert r["hard"][: len(mine)] == mine
        assert len(r["hard"]) == (3 if len(by[r["batch"]]) > 1 else len(mine))
        assert all(code[x] != r["code"] for x in r["hard"][len(mine) :])


FIELDS = (load.Field("id", 4), load.Field("name", 10), load.Field("n", number=True), load.Field("last", 3))


def test_load_with_rejects(spark, tmp_path):
    lines = ["1|one|5|x|", "2|two", "", "3|three|six|y|", "4|four|7|z|more|", "12345|five|1|x", "6|a name that is too long|1|x|", "7|seven||w\r", "8||-2||"]
    (tmp_path / "in.rrf").write_text("\n".join(lines))
    good, bad = load.parse(spark, str(tmp_path / "in.rrf"), FIELDS)
    assert sorted(map(tuple, good.collect())) == [("1", "one", 5, "x"), ("2", "two", None, None), ("7", "seven", None, "w"), ("8", None, -2, None)]
    assert {(r["line"].split("|")[0], r["reason"]) for r in bad.collect()} == {("3", "n is not a whole number"), ("4", "too many cells"), ("12345", "id is too long"), ("6", "name is too long")}


def test_failed_load_leaves_the_old_table(spark, tmp_path):
    path, rejects = str(tmp_path / "table"), str(tmp_path / "rejects")
    (tmp_path / "a.rrf").write_text("1|one|5|x|\n")
    (tmp_path / "b.rrf").write_text("2|two|5|x|\n3|three|six|y|\n")
    load.bulk_load(spark, str(tmp_path / "a.rrf"), path, rejects, FIELDS)
    with pytest.raises(ValueError):
        load.bulk_load(spark, str(tmp_path / "b.rrf"), path, rejects, FIELDS)
    assert [r["id"] for r in spark.read.parquet(path).collect()] == ["1"]
    assert [r["line"] for r in spark.read.parquet(rejects).collect()] == ["3|three|six|y|"]

    def refuse(df):
        raise RuntimeError(df.count())

    with pytest.raises(RuntimeError):
        load.replace_table(spark.range(5), path, refuse)
    with pytest.raises(Exception):
        load.replace_table(spark.range(5).select(F.raise_error(F.lit("no")).alias("x")), path)
    assert [r["id"] for r in spark.read.parquet(path).collect()] == ["1"]
    assert sorted(os.listdir(tmp_path)) == ["a.rrf", "b.rrf", "rejects", "table"]
    load.bulk_load(spark, str(tmp_path / "b.rrf"), path, rejects, FIELDS, most_rejects=1)
    assert [r["id"] for r in spark.read.parquet(path).collect()] == ["2"]
    both = load.replace_table(spark.read.parquet(path).union(spark.read.parquet(path)), path)  # reads what it replaces
    assert both.count() == 2


def test_vectors_are_built_once(spark, tmp_path):
    seen = []

    def build(names):
        seen.append(sorted(r["name"] for r in names.collect()))
        return names.select("name", F.array(F.length("name").cast("double")).alias("vector"))

    ask = lambda *names, encoder="e": {r["name"]: r["vector"] for r in load.vectors_for(spark.createDataFrame([(n,) for n in names], "name string"), encoder, str(tmp_path / "cache"), build).collect()}
    assert ask() == {} and seen == []
    assert ask("ab", "c", "ab", None) == {"ab": [2.0], "c": [1.0]}
    assert ask("c", "ab") == {"ab": [2.0], "c": [1.0]}
    assert ask("c", "abd") == {"abd": [3.0], "c": [1.0]}
    assert seen == [["ab", "c"], ["abd"]]
    assert ask("c", encoder="other") == {"c": [1.0]} and seen[2:] == [["c"]]


def test_generation_is_dealt_over_tasks(spark):
    from pyspark.sql import functions as F

    from spanloom.operators import generate

    steps = generate.steps_of(spark.range(3 * generate.IDS).select(F.col("id").alias("doc_id")), 1, 5, F.lit(4))
    assert steps.groupBy(F.spark_partition_id()).count().count() >= 3


def test_parts_of_unknown_types_are_left_out(spark):
    from spanloom.operators import generate

    parts = spark.createDataFrame([(1, 100, 0, 0, "a ", None, None), (1, 100, 0, 1, None, "X", None), (1, 100, 0, 2, None, "Y", "l"), (1, 100, 1, 0, "b", None, None)], "doc_id long, target int, step int, at int, text string, type string, label string")
    catalog = spark.createDataFrame([("Y", 0, "why", "c")], "type string, k long, name string, code string")
    row = generate.assemble(parts, catalog, 1).first()
    assert row["text"] == "a whyb" and [(c["text"], c["start"], c["assertions"], c["candidates"]) for c in row["concepts"]] == [("why", 2, ["l"], ["c"])]


def _notes(spark, catalog, n=200, **more):
    templates = (generate.Template(("Now",), (generate.Slot(DIAGNOSIS),), 1, 2), generate.Template(("Drugs",), (generate.Slot(DRUG, before=("takes ",)), generate.Slot(LAB, share=0.5))))
    return generate.note_documents(spark.range(n).withColumnRenamed("id", "doc_id"), templates, ("Well.", "Seen today."), catalog, **more)


def test_notes_grow_until_their_drawn_length(spark, catalog):
    rows = check(_notes(spark, catalog))
    assert len(rows) == 200 and all(len(r["text"]) >= r["target"] for r in rows)
    assert max(r["text"].count("\n") for r in rows) > 200
    short = check(_notes(spark, catalog, most=3))  # an end that is asked for
    assert all(r["text"].count("\n") <= 3 * 5 for r in short)


def test_names_that_are_not_broadcast_give_the_same_documents(spark, catalog, monkeypatch):
    frames = spark.createDataFrame([(f"- {{{DIAGNOSIS}}}", 6), (f"dùng {{{DRUG}}} trị {{{DIAGNOSIS}}}", 2), (f"{{{LAB}}} of {{NONE}}", 1)], "template string, freq long")
    headers = spark.createDataFrame([("1. Heading", 3)], "text string, freq long")
    made = lambda: generate.frame_documents(spark.range(50).withColumnRenamed("id", "doc_id"), frames, headers, ("A line.",), catalog, CLINICAL_VI)
    told = lambda df: sorted((r["doc_id"], r["target"], r["text"], r["concepts"]) for r in df.collect())
    whole = told(made())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = made()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") <= 2  # ids alone: distinct, and dealt over tasks
        monkeypatch.setattr(generate, "BROADCAST_BYTES", 400)
        some = told(made())
        monkeypatch.setattr(generate, "BROADCAST_BYTES", 0)
        assert whole == some == told(made())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
