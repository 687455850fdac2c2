"""The pipeline, stage by stage on each stage's own input, against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from test_documents import WORD, components_brute, fingerprint_brute, lines_brute

import corpus_pipeline
from spanloom.llm import bpe, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghilmnorstu"), rng.integers(2, 8))) for _ in range(400)]
    shared = "This line stands in a good many of the documents."
    rows = []
    for k in range(120):
        body = "\n".join(" ".join(rng.choice(words, 25)) for _ in range(4))
        text = body if k % 4 else shared + "\n" + body
        if k % 10 == 7:
            text = "buy!! now!! CHEAP$$$ win*** ### free%%% click|| " * 8 + str(k)
        if k % 15 == 14:
            text = rows[-3][1]  # an exact copy
        rows.append((k, text, "en", "abc"[k % 3], len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (None, rows[1][1], "en", "b", 1), rows[2]]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 10 != 7), 0) for k in range(0, 120, 1) if k % 2 or k % 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    read = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, read[-1], folder).write.parquet(f"{tmp_path}/{k}")
        read.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(df.columns == COLUMNS for df in read[1:5])
    rows = [[tuple(r) for r in df.collect()] for df in read[:5]]

    kept = {r[0] for r in rows[1]}
    assert not any(i is not None and i % 10 == 7 for i in kept)
    assert {r[0] for r in rows[0] if r[1] and len(WORD.findall(r[1])) >= 20 and (r[0] is None or r[0] % 10 != 7)} <= kept

    want = lines_brute([r[:2] for r in rows[1]])
    assert Counter((r[0], r[1]) for r in rows[2]) == Counter({(w[0], w[3]): n for w, n in want.items()})
    assert all(r[4] == len(r[1]) for r in rows[2])

    fp = {r[1]: fingerprint_brute(r[1]) for r in rows[2]}
    root = components_brute(set(fp.values()))
    least = defaultdict(list)
    for r in rows[2]:
        if r[0] is not None:
            least[root[fp[r[1]]]].append(r[0])
    assert sorted(r[0] for r in rows[3] if r[0] is not None) == sorted({min(v) for v in least.values()})

    plan = Counter((r["doc_id"], r["copies"]) for r in mixing.mix(read[3]).collect() if r["copies"])
    assert Counter(r[0] for r in rows[4]) == Counter({i: n * k for (i, n), k in plan.items()})

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    ids = Counter()
    for r in rows[4]:
        e = np.array(t.encode(r[1], add_special_tokens=False).ids, "<u4").tobytes()
        ids[(r[0], hashlib.sha256(e).hexdigest())] += 1
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in read[5].collect()) == ids


def test_run_is_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() > 0


def test_stages_on_an_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
