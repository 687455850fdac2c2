"""Hard negatives, byte-level BPE and the Merkle manifest, against brute force and through their queries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from spanloom.llm import bytebpe, hardneg, merkle
from spanloom.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>, label int, list int, rank string"


def folder(tmp_path_factory, name, df):
    path = tmp_path_factory.mktemp(name)
    df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


# Hard negatives


def brute(rows, every, positives=5, negatives=5):
    """``rows`` of (vec_id, label, weights); in plain Python."""
    out = []
    for a, la, wa in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(wa, w)), b, lb) for b, lb, w in rows if b != a)
        for sp, p, _ in [s for s in scored if s[2] == la][:positives]:
            fit = [(n, -sn) for sn, n, ln in scored if ln != la and 80 * -sp <= 100 * -sn <= 100 * -sp]
            out += [(a, p, k + 1, n, -sp, sn) for k, (n, sn) in enumerate(fit[:negatives])]
    return sorted(out)


def some_vectors(n, seed, dims=6):
    """Clusters, copies, ties, several lengths and rows that take no part."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = (rng.normal(size=dims) + 3 * (np.arange(dims) == k % dims)).round(1).tolist()
        rows.append((k - 20, v, int(rng.integers(0, 3)), 1, "x"))
    rows += [(k + 1000, [1.0] * dims, k % 2, 1, "x") for k in range(80)]  # copies, and so ties
    rows += [(2000, [], 1, 1, "x"), (2100, [2.0, 2.0], 1, 1, "x"), (2200, [2.0] * (dims + 3), 0, 1, "x"), (-300, [0.0] * dims, 2, 1, "x")]
    rows += [(None, [1.0] * dims, 1, 1, "x"), (5000, None, 1, 1, "x"), (5100, [1.0, None], 1, 1, "x"), (5200, [float("nan")] * dims, 1, 1, "x"), (5300, [float("inf")] * dims, 1, 1, "x"), (5400, [1.0] * dims, None, 1, "x")]
    return [*rows, rows[3]]


def taking_part(rows, move=True):
    seen = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if move and i % 7 == 0 else label
        one = (label, [int(np.floor(256 * x)) for x in v])
        seen[i] = min(seen.get(i, one), one)
    return [(i, *one) for i, one in seen.items()]


def test_hard_negatives_equal_brute_force(spark, tmp_path_factory, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 16)
    rows = some_vectors(400, 3)
    path = folder(tmp_path_factory, "embeddings", spark.createDataFrame(rows, VECTORS))
    got = sorted(map(tuple, QUERIES["op11_hard_negative_mining"](spark, path).collect()))
    want = brute(taking_part(rows), 100)
    assert len(want) > 50
    assert got == want


def test_hard_negatives_of_numbers_past_doubles(spark):
    rows = [(k, [float(2**50 + k % 3), -float(2**49)] if k % 5 else [1e300, -1e300], k % 2) for k in range(40)]
    got = hardneg.mine(hardneg.weights(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), every=20)
    long = 2**63 - 1
    cap = lambda x: max(-long - 1, min(long, x))
    w = {k: (lab, [cap(int(np.floor(256 * x))) for x in v]) for k, v, lab in rows}
    want = []
    for a in (0, 20):
        scored = sorted((-cap(sum(x * y for x, y in zip(w[a][1], w[b][1]))), b) for b in w if b != a)
        for sp, p in [s for s in scored if w[s[1]][0] == w[a][0]][:5]:
            fit = [(n, -sn) for sn, n in scored if w[n][0] != w[a][0] and 80 * -sp <= 100 * -sn <= 100 * -sp]
            want += [(a, p, k + 1, n, -sp, sn) for k, (n, sn) in enumerate(fit[:5])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_hard_negatives_of_nothing(spark):
    assert hardneg.mine(hardneg.weights(spark.createDataFrame([], VECTORS))).collect() == []


def test_lists_are_skipped_by_bounds_and_none_that_matters():
    rng = np.random.default_rng(1)
    centres = np.rint(rng.normal(size=(40, 8)) * 500)
    rows = np.concatenate([c + rng.integers(-20, 21, (50, 8)) for c in centres]).astype(np.int64)
    near, far = hardneg.nearest(rows.astype(float), centres)
    radius = np.array([far[near == c].max() for c in range(40)])
    queries = rows[::100]
    scores = queries @ rows.T
    kth = np.sort(scores, 1)[:, -5]
    go = hardneg.visits(queries, [[None]] * len(queries), [[int(x)] for x in kth], centres, radius, 0, None)
    assert go.mean() < 0.25
    for i, row in enumerate(scores):
        assert go[i][near[np.flatnonzero(row >= kth[i])]].all()
    window = hardneg.visits(queries, [[int(x)] for x in kth], [[None]] * len(queries), centres, radius, 0, None)
    for i, row in enumerate(scores):
        assert window[i][near[np.flatnonzero((row <= kth[i]) & (100 * row >= 80 * kth[i]))]].all()
    parts = [hardneg.visits(queries, [[None]] * len(queries), [[None]] * len(queries), centres, radius, s, t) for s, t in ((0, 2), (2, 16), (18, None))]
    assert (sum(p.astype(int) for p in parts) == 1).all()


# Byte-level BPE


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bytebpe.public_pattern(), mergeable_ranks=bytebpe.ranks(bytebpe.ranks_path()).rank, special_tokens={})


def test_byte_bpe_equals_public_library(spark, edge_docs, edge_rows, public, tmp_path_factory):
    path = folder(tmp_path_factory, "documents", edge_docs)
    got = sorted(map(tuple, QUERIES["op12_byte_bpe_encode_decode"](spark, path).collect()), key=repr)
    want = []
    for doc_id, text, *_ in edge_rows:
        ids = public.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(public.decode_bytes(ids)).hexdigest()))
    assert got == sorted(want, key=repr)


def test_byte_bpe_keeps_columns_and_decodes(spark, edge_docs, empty_docs, public):
    out = bytebpe.encode(edge_docs)
    assert {"doc_id", "lang", "kept", "TARGET", "n_tokens", "ids", "decoded"} <= set(out.columns)
    for r in bytebpe.decode(out.drop("decoded")).select("text", "ids", "decoded", "n_tokens").collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == public.encode_ordinary(r["text"] or "") and len(ids) == r["n_tokens"]
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bytebpe.encode(empty_docs).collect() == []


def test_byte_bpe_of_pieces_of_all_lengths(public, monkeypatch):
    voc, rng = bytebpe.Ranks(bytebpe.ranks_path()), random.Random(3)
    pieces = ["".join(rng.choice("abthenriosé") for _ in range(n)) for n in (*range(1, 70), 255, 256, 257, 700) for _ in range(3)]
    pieces = list(dict.fromkeys([*pieces, "a" * 250, "ab" * 120, "a" * 40_000]))
    want = [public.encode_ordinary(p) for p in pieces]
    assert voc.merge([p.encode() for p in pieces]) == want
    assert [voc.merge_long(p.encode()) for p in pieces if len(p) < 2000] == [w for p, w in zip(pieces, want) if len(p) < 2000]
    monkeypatch.setattr(bytebpe, "BATCH_BYTES", 300)
    assert voc.merge([p.encode() for p in pieces]) == want
    assert voc.decode(want) == [p.encode() for p in pieces]
    with pytest.raises(ValueError):
        voc.decode([[50_300]])


def test_byte_bpe_forgets_pieces_without_change(public, monkeypatch):
    monkeypatch.setattr(bytebpe, "CACHE_PIECES", 20)
    enc, rng = bytebpe.Encoder(bytebpe.ranks_path(), bytebpe.public_pattern(), False), random.Random(4)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abehnort") for _ in range(rng.randint(1, 4))) for _ in range(12))]
        pieces, decoded = enc.encode(texts)
        assert [np.frombuffer(b"".join(p), "<u4").tolist() for p in pieces] == [public.encode_ordinary(t) for t in texts]
        assert decoded == [t.encode() for t in texts]
        assert len(enc.ids) < 60 and len(enc.old_ids) < 60


# Merkle manifest


def _h(xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _climb(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([_h(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def _path(levels, i):
    out = []
    for row in levels[:-1]:
        run = row[i // 16 * 16 : i // 16 * 16 + 16]
        out.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        i //= 16
    return out


def plain_manifest(rows):
    """``rows`` of (doc_id, text, lang, source, n_chars)."""
    by = {}
    for d, text, lang, source, n in rows:
        leaf = _h(map(_field, (d, source, lang, n, text)))
        hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0 and text is not None
        low = "".join(c.lower() if c.isascii() else c for c in text) if hit else text
        by.setdefault(source, []).append(((d is not None, d or 0), leaf, d, _h(map(_field, (d, source, lang, n, low)))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _climb([x[1] for x in sorted(by[s])]) for s in names}
    top, out = _climb([trees[s][-1][0] for s in names]), []
    for k, s in enumerate(names):
        for i, (_, leaf, d, now) in enumerate(sorted(by[s])):
            path = _path(trees[s], i) + _path(top, k)
            for left, right in path:
                now = _h([left, now, right])
            out.append((d, leaf, trees[s][-1][0], top[-1][0], _h(a + b for a, b in path), now, now == top[-1][0]))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_of_odd_rows(spark, edge_docs, edge_rows, tmp_path_factory):
    path = folder(tmp_path_factory, "documents", edge_docs)
    got = QUERIES["op13_merkle_manifest"](spark, path).select(*COLUMNS).collect()
    want = plain_manifest([(d, t, lang, source, n) for d, t, lang, source, n in edge_rows])
    assert sorted(map(tuple, got), key=repr) == want
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [(1,), (1, 1, 1), (5000, 257, 256, 17, 16, 1)])
def test_manifest_of_many_sizes(spark, sizes, tmp_path_factory):
    rows = [(k * 10_000 + i, f"Text {i}", "en", f"s{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    path = folder(tmp_path_factory, "documents", spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(map(tuple, QUERIES["op13_merkle_manifest"](spark, path).select(*COLUMNS).collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_nothing(spark, empty_docs):
    assert merkle.manifest(empty_docs).collect() == []


def test_walk_gives_every_run_and_keeps_few_nodes():
    for n in (1, 2, 15, 16, 17, 100, 255, 256):
        leaves = [f"{i:064x}" for i in range(n)]
        levels = _climb(leaves)
        assert merkle.height(n) == len(levels) - 1
        for i, runs in enumerate(merkle.walk(leaves, len(levels) - 1)):
            for k, run in enumerate(runs):
                at = i // 16 ** (k + 1) * 16
                assert run == levels[k][at : at + 16]
    stack = merkle.Treehash(3)
    for i in range(5000):
        stack.feed(str(i))
        assert sum(map(len, stack.open[:-1])) <= 3 * 16
