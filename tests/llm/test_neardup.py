"""The pipeline's near-dup stage against brute-force Jaccard similarity of five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from spanloom.llm import neardup


def shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}


def kept_brute(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    texts = []
    for k in range(40):  # copies with more and more words changed: similarity falls from 1 through 0.8 to 0.5
        base = rng.choices(made, k=rng.randint(60, 200))
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 6):
            own = list(base)
            for at in rng.sample(range(len(own)), changes):
                own[at] = rng.choice(made)
            texts.append(" ".join(own))
    base, other = rng.choices(made, k=150), rng.choices(made, k=30)
    for k in range(90):  # one large group of near copies, another with a shared passage only
        own = list(base)
        own[rng.randrange(150)] = rng.choice(made)
        texts.append(" ".join(own))
        texts.append(" ".join(other + rng.choices(made, k=rng.choice((3, 5, 8)))))
    texts += [texts[5].upper(), texts[9].replace(" ", " \n"), "", None, " \t", "one", "One", "one two three four", "one two three four five"]
    rng.shuffle(texts)
    out = [(k, t) for k, t in enumerate(texts)]
    return out + [out[7], (None, out[8][1]), (None, None)]


def test_stage_keeps_one_of_each_group(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()]
    assert out.count(None) == 2 and sorted(i for i in out if i is not None) == kept_brute(rows)


@pytest.mark.parametrize(("big", "block"), [(2, 2048), (8, 7), (1000, 2048)])
def test_groups_of_any_size(spark, rows, big, block):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r[0] for r in neardup.near_texts(df, big, block).where("component_id is not null").collect()) == kept_brute(rows)


@pytest.mark.parametrize("n", [3, 100, 700, 3000])
def test_maps_never_forbid_what_is_alike(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, n).astype(np.uint64)
    for share in (0.05, 0.11, 0.2, 0.5, 1.0):
        m = int(share * n)
        other = np.r_[base[m:], rng.integers(0, 2**63, m // 2).astype(np.uint64)]
        maps = neardup.parity_maps(2, np.repeat([0, 1], [len(base), len(other)]), np.r_[base, other]).to_pylist()
        both = len(set(base.tolist()) & set(other.tolist()))
        alike = 5 * both >= 4 * (len(base) + len(other) - both)
        assert neardup.may_be_alike(*maps, len(base) + len(other)) >= alike
        assert share < 0.5 or n < 100 or not neardup.may_be_alike(*maps, len(base) + len(other))


def test_many_half_alike_texts_end_and_stay(spark):
    """4,000 texts that share 40 words and have six own: similarity 36 / 48, and every pair meets on a common shingle."""
    import time

    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, passage + "".join(f" o{rng.randrange(10**9)}" for _ in range(6))) for k in range(4000)]
    rows += [(k + 5000, text) for k, text in rows[:5]] + [(6000, passage + " o1 o2 o3 o4"), (6001, passage + " o5 o6 o7 o8")]
    start = time.time()
    kept = sorted(r["doc_id"] for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect())
    assert kept == [*range(4000), 6000]
    assert time.time() - start < 240


def test_groups_are_cut_where_they_end(spark):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 12, 500))
    rows = np.unique(np.stack([keys, rng.integers(0, 50, 500), rng.integers(0, 9, 500)]), axis=1)
    for size in (1, 3, 40, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[s : s + size]) for x in rows], names=["a", "b", "c"]) for s in range(0, rows.shape[1], size)]
        groups = list(neardup._groups(iter(batches)))
        assert all(not set(x[0]) & set(y[0]) for x, y in zip(groups, groups[1:]))
        assert np.array_equal(np.concatenate(groups, axis=1), neardup._once(rows))


def fingerprint(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_majorities_of_bits(monkeypatch):
    monkeypatch.setattr(neardup, "_RUN", 7)
    rng = np.random.default_rng(4)
    own = np.repeat([0, 2, 3, 5], [1, 9, 30, 4])
    sh = rng.integers(0, 2**63, len(own)).astype(np.uint64) * np.uint64(3)
    assert neardup.prints(7, own, sh).tolist() == [fingerprint(sh[own == r].tolist()) for r in range(7)]


@pytest.mark.parametrize("hot", [20_000, 3])
@pytest.mark.parametrize("radius", [2, 4, 5])
def test_trees_link_every_value_that_has_a_close_one(spark, radius, hot):
    from spanloom.llm import simhash

    rng = np.random.default_rng(radius)
    values = set()
    for v in rng.integers(0, 2**63, 30).tolist():
        for _ in range(9):
            for b in rng.choice(64, int(rng.integers(1, radius + 2)), replace=False).tolist():
                v ^= 1 << b
            values.add(v)
    nodes = spark.createDataFrame([(int(np.array(v, np.uint64).view(np.int64)),) for v in values], "fp long")
    found = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(nodes, hot, radius, simhash.shard_links).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in found)

    linked = {max(p) for p in found}
    assert linked == {b for b in values if any(a < b and (a ^ b).bit_count() <= radius for a in values)}


def test_dense_shards_take_no_square(monkeypatch):
    from spanloom.llm import simhash

    rng = np.random.default_rng(1)
    values = {sum(1 << b for b in rng.choice(40, 3, replace=False).tolist()) for _ in range(6000)}
    met = []
    monkeypatch.setattr(simhash.BKTree, "near", lambda self, *a, f=simhash.BKTree.near: met.append(found := f(self, *a)) or found)
    assert len(simhash.shard_links(list(values), 4)) > 5000 * len(values) // 6000 and max(map(len, met)) == 1


def test_stage_takes_its_first_links_from_fingerprints(spark, rows):
    """Long texts with one word changed at an end are within the radius; every link is of alike sets."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(base), " ".join([*base[:-1], "changed"])]
    all_rows = [*rows, *[(k + 5000, t) for k, t in enumerate(texts)]]
    df = spark.createDataFrame(all_rows, "doc_id long, text string")
    marks = neardup.marks(df).collect()
    nodes = spark.createDataFrame(marks, "doc_id long, node long, size int, map binary, fp long").groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "map", "fp")])
    found = [tuple(r) for r in neardup.close_texts(df, nodes).collect()]
    by_doc = {r["doc_id"]: r for r in marks if r["doc_id"] is not None}
    text_of = {by_doc[i]["node"]: t for i, t in all_rows if i is not None}
    fp_of = {r["node"]: r["fp"] % (1 << 64) for r in marks}
    for a, b in found:
        x, y = shingles(text_of[a]), shingles(text_of[b])
        assert 5 * len(x & y) >= 4 * len(x | y) and (fp_of[a] ^ fp_of[b]).bit_count() <= neardup.RADIUS
    close = {frozenset((by_doc[5000 + k]["node"], by_doc[5001 + k]["node"])) for k in range(0, 60, 2)}
    close = {p for p in close if (lambda a, b: (fp_of[a] ^ fp_of[b]).bit_count() <= neardup.RADIUS)(*p)}
    assert len(close) >= 25 and close <= {frozenset(p) for p in found}
