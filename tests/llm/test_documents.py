"""The document operators against brute force, over rows with every edge case."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import bpe, langid, linededup, lmscore, mixing, quality, simhash

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def by_row(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_base_counts(edge_docs, edge_rows):
    def brute(t):
        t = t or ""
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        c = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(covered), failed, not failed

    out = quality.score(edge_docs, None)
    assert len(out.columns) == len({c.lower() for c in out.columns})
    want = Counter((r[0], *brute(r[1])) for r in edge_rows)
    assert by_row(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == want


def test_quality_model_learns(spark, edge_docs, empty_docs):
    good, bad = "the quick brown fox jumps over the lazy dog near a river ", "buy!! now!! CHEAP$$$ win*** ### free%%% click|| "
    rows = [(k, ("".join(np.random.default_rng(k).permutation((good if k % 2 else bad).split(" ")).tolist()) + " " + (good if k % 2 else bad)) * 3, "en", "a", 1) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)] + [(None, 1, 0), (5, None, 0), (5, 7, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    out = {r["doc_id"]: r["prob"] for r in quality.score(docs, model).collect()}
    assert all((out[k] >= 0.5) == bool(k % 2) for k in range(80, 120))
    assert quality.fit(docs, labels.where("quality = 1")) is None
    assert quality.fit(empty_docs, labels) is None
    assert quality.score(empty_docs, model).count() == 0
    assert quality.score(edge_docs, model).count() == edge_docs.count()


def test_quality_sample_is_bounded(spark, monkeypatch):
    rows = [(k % 2 if k < 3000 else k, f"text {k} of words " * (2000 if k % 50 == 0 else 3)) for k in range(3400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), *((k, k % 2) for k in range(3000, 3400))], "doc_id long, quality int")
    sample = quality.labelled_sample(docs, labels, 100).collect()
    ids = Counter(r["doc_id"] for r in sample)
    assert max(ids.values()) == 1 and all(90 < n <= 100 for n in Counter(r["quality"] for r in sample).values())
    assert all(len(r["text"]) <= quality.FIT_CHARS for r in sample)
    small = quality.labelled_sample(docs, labels, 100, total=2000).collect()
    assert 0 < sum(len(r["text"]) for r in small) <= 2000 and len({r["quality"] for r in small}) == 2


def test_quality_grams_are_of_code_points():
    text = "aé中🙂b"
    chars, at = quality._code_points(np.frombuffer((text + "xyzé").encode(), np.uint8), np.array([0, len(text.encode()), len((text + "xyzé").encode())]))
    assert at.tolist() == [0, 5, 9] and chars[1] == chars[8] and len(set(chars.tolist())) == 8
    assert [len(b) for _, b in quality._char_features(chars)] == [7, 6]


def lines_brute(rows):
    def key(line):
        return line.strip(SPACE).translate(LOWER)

    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                holders[key(line)].add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != i)]
        out[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


def test_line_dedup(edge_docs, edge_rows, empty_docs):
    out = linededup.dedup(edge_docs)
    assert by_row(out, "doc_id", "n_lines", "n_dropped", "kept_text") == lines_brute([r[:2] for r in edge_rows])
    assert linededup.dedup(empty_docs).count() == 0
    assert linededup.apply(edge_docs).columns == edge_docs.columns


def test_line_dedup_with_many_shards_and_parts_is_the_same(edge_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 2)
    monkeypatch.setattr(linededup, "PROBE_ROWS", 3)
    out = linededup.dedup(edge_docs)
    assert by_row(out, "doc_id", "n_lines", "n_dropped", "kept_text") == lines_brute([r[:2] for r in edge_rows])


def test_probing_keeps_what_is_held_and_little_else(spark, monkeypatch):
    monkeypatch.setattr(linededup, "PROBE_ROWS", 100)
    rng = np.random.default_rng(6)
    keys = [tuple(x) for x in rng.integers(-(2**63), 2**63 - 1, (4000, 2)).tolist()]
    held = spark.createDataFrame(keys[:1000], "hi long, lo long")
    all_ = spark.createDataFrame([(*k, d) for d, k in enumerate(keys)], "hi long, lo long, doc_id long")
    may = {r["doc_id"] for r in linededup.probe(all_, linededup.build_filters(held, 4), 4).collect()}
    assert set(range(1000)) <= may and len(may) < 1020


def test_line_store_is_reversible_and_reopens(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 4)
    monkeypatch.setattr(linededup, "DELTAS", 5)
    rows = [(k, f"a line shared by all of them\nown line number {k} of this\nshared by pairs {k // 2} only") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "store")

    def told(ids):
        """What a store opened anew says of the documents, and what it should say."""
        own = docs.where(F.col("doc_id").isin(list(ids)))
        found = by_row(linededup.LineStore(spark, path).dedup(own), "doc_id", "n_lines", "n_dropped", "kept_text")
        return found == lines_brute([r for r in rows if r[0] in ids])

    store = linededup.LineStore(spark, path)
    store.insert(docs.where("doc_id < 6"))
    assert told(range(6)) and store.shards == 1
    linededup.LineStore(spark, path).insert(docs.where("doc_id >= 6"))
    assert told(range(12)) and linededup.LineStore(spark, path).shards == 2
    store = linededup.LineStore(spark, path)
    store.delete(docs.where("doc_id in (0, 3)").select("doc_id"))
    assert told([k for k in range(12) if k not in (0, 3)])

    # A change that fails half way leaves the version whole, and can be tried again.
    with monkeypatch.context() as m:
        m.setattr(linededup.LineStore, "_commit", lambda *_: (_ for _ in ()).throw(OSError("no space")))
        with pytest.raises(OSError, match="no space"):
            store.insert(docs.where("doc_id in (0, 3)"))
    assert told([k for k in range(12) if k not in (0, 3)])
    store.insert(docs.where("doc_id in (0, 3)"))
    assert told(range(12))
    store.delete(docs.where("doc_id >= 6").select("doc_id"))
    assert told(range(6))
    assert sum(k != "filters" for _, k, _ in linededup.LineStore(spark, path).entries) <= 5

    other = linededup.LineStore(spark, path)
    store.delete(docs.where("doc_id = 1").select("doc_id"))
    other.delete(docs.where("doc_id = 2").select("doc_id"))
    with pytest.raises(RuntimeError, match="two changes"):
        linededup.LineStore(spark, path)


@pytest.mark.parametrize("n", [0, 1, 5, 64, 5000])
def test_cuckoo_filter(n):
    h = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    f = linededup.CuckooFilter.of(h)
    assert f.contains(h).all()
    f = linededup.CuckooFilter.from_bytes(f.to_bytes())
    f.delete(h[: n // 2])
    assert f.contains(h[n // 2 :]).all()
    assert (f.slots > 0).sum() == n - n // 2


def fingerprint_brute(t, n=3):
    w = WORD.findall((t or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(nodes, radius=2):
    parent = {k: k for k in nodes}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(nodes, 2):
        if (a ^ b).bit_count() <= radius:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {k: top(k) for k in nodes}


def test_near_duplicates(edge_docs, edge_rows, empty_docs):
    fps = [(r[0], fingerprint_brute(r[1])) for r in edge_rows]
    root = components_brute({f for _, f in fps})
    least = defaultdict(list)
    for i, f in fps:
        if i is not None:
            least[root[f]].append(i)
    want = Counter((i, f, min(least[root[f]], default=None)) for i, f in fps)
    out = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(edge_docs).collect())
    assert out == want
    assert simhash.near_duplicates(empty_docs).count() == 0
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in want if c is not None})
    assert ids.count(None) == sum(r[0] is None for r in edge_rows)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_links_find_every_close_pair(spark, hot):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40).tolist()
    values = set(centres)
    for c in centres:
        v = c
        for _ in range(12):
            v ^= 1 << int(rng.integers(64))
            values.add(v)
    nodes = spark.createDataFrame([(int(np.array(v, np.uint64).view(np.int64)),) for v in values], "fp long")
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.links(nodes, hot)).collect()}
    want = components_brute(values)
    group = lambda m: sorted(sorted(g) for g in _groups(m).values())
    assert group({v: got.get(v, v) for v in values}) == group(want)


def _groups(m):
    out = defaultdict(list)
    for k, v in m.items():
        out[v].append(k)
    return out


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    values = [int(x) & 0xFFF for x in rng.integers(0, 2**12, 400)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.near(q, 2)) == [k for k, v in enumerate(values) if (v ^ q).bit_count() <= 2]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    out = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(out[k] == 0 for k in range(1, 201)) and out[501] == 500


def test_mixing(edge_docs, edge_rows, empty_docs):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    size = Counter((r[0], len(WORD.findall(r[1] or ""))) for r in edge_rows)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == size
    per = defaultdict(int)
    for r in edge_rows:
        per[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in per if s is not None), key=lambda s: s) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(per.values()), set()
    while True:
        rest, w = total - sum(3 * per[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and rest * weight[s] > w * 3 * per[s]}
        if not more:
            break
        capped |= more
    for r in rows:
        want = 3 * per[r["source"]] if r["source"] in capped else rest * weight[r["source"]] / w
        assert r["source_size"] == per[r["source"]] and abs(r["target"] - want) < 1e-6 * max(1, want)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        low = want / per[r["source"]]
        assert int(low - 1e-9) <= r["copies"] <= int(low) + 1
    again = mixing.mix(edge_docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(empty_docs).count() == 0
    out = mixing.apply(edge_docs)
    assert out.columns == edge_docs.columns
    # Rows alike in id, source and size are one unit, so exact repeats are each copied alike.
    assert out.count() == sum(r["copies"] for r in rows)


@pytest.mark.parametrize("skewed", [False, True])
def test_mixing_keeps_totals(spark, skewed):
    rng = np.random.default_rng(3)
    sizes = np.minimum(20_000, rng.pareto(0.9, 1500) * 20 + 1).astype(int) if skewed else np.arange(1500) % 40 + 1
    docs = spark.createDataFrame([(k, "w " * int(n), "abc"[k % 3] if k % 2 else "a") for k, n in enumerate(sizes)], "doc_id long, text string, source string")
    per = defaultdict(lambda: [0, 0.0, 0])
    for r in mixing.mix(docs).collect():
        per[r["source"]][0] += r["taken"]
        per[r["source"]][1] = r["target"]
        per[r["source"]][2] = max(per[r["source"]][2], r["size"])
    # Words are kept but for the last unit, which is drawn.
    assert all(abs(t - want) <= largest + 1 for t, want, largest in per.values())
    assert skewed or all(abs(t - want) / want < 0.01 for t, want, _ in per.values())


def test_mixing_keeps_expectations(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 7 * 5), "ab"[k % 2]) for k in range(60)], "doc_id long, text string, source string")
    copies = Counter()
    for seed in range(40):
        monkeypatch.setattr(mixing, "SEED", 100 * seed)
        for r in mixing.mix(docs).collect():
            copies[r["doc_id"]] += r["copies"]
            want = r["target"] / r["source_size"]
            copies["off", r["source"], r["size"]] += r["copies"] - want
    # 40 draws of some ten documents of a source and size: the mean is within 5 standard errors.
    assert all(abs(v) < 5 * 0.5 * (40 * 5) ** 0.5 for k, v in copies.items() if isinstance(k, tuple))


def test_bpe_is_exact(edge_docs, edge_rows, empty_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    want = Counter()
    for r in edge_rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    out = bpe.digests(edge_docs)
    assert by_row(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.digests(empty_docs).count() == 0
    tiny = bpe.build_lexicon(edge_docs, bpe.tokenizer_path(), 3)
    small = bpe.encode(edge_docs, lexicon=tiny)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in small.collect()) == Counter((w[0], w[1]) for w in want.elements())
    back = bpe.decode(small.select("ids", F.col("decoded").alias("was"))).where("decoded <> was")
    assert back.count() == 0


def test_transducer_shares_suffixes():
    words = {f"{a}{b}ing".encode(): np.array([k, k + 1], "<u4").tobytes() for k, (a, b) in enumerate(itertools.product("abcdef", "xyz"))}
    fst = bpe.Transducer.mapped(bpe.Transducer.compile(words))
    assert fst.lookup(list(words)) == list(words.values())
    assert fst.lookup([b"axin", b"axingx", b"", b"zzz"]) == [None] * 4
    assert len(fst.final) == 6  # root, second letter, i, n, g and the end
    assert bpe.Transducer(bpe.Transducer.compile({})).lookup([b"a"]) == [None]


def test_merging_forms_agree():
    voc = bpe.vocabulary(bpe.tokenizer_path())
    words = [w.encode() for w in ("the", "transformers", "zzzzqqq", "ab" * 19, "naïve", "!!!")]
    assert voc.merge(words) == [np.array(voc.merge_long(w), "<u4").tobytes() for w in words]


def test_language_id(spark, edge_docs, empty_docs):
    rng = np.random.default_rng(2)
    parts = {"aa": ["the", "ing", "ther", "and", "tion"], "bb": ["eau", "oui", "ment", "aux", "que"], "cc": ["sch", "ung", "keit", "ein", "cht"]}
    rows = []
    for k in range(300):
        lang = ["aa", "bb", "cc"][k % 3]
        rows.append((k, " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(30)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert sorted(model) == ["aa", "bb", "cc"]
    out = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(out[k]["lang_pred"] == lang and 0 <= out[k]["score"] <= 1 for k, _, lang in rows)
    blind = spark.createDataFrame([(k, t, None) for k, t, _ in rows], docs.schema)
    assert langid.fit(blind) == {}
    edge = langid.predict(edge_docs, model).collect()
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in edge)
    assert {r["lang_pred"] for r in langid.predict(edge_docs, {}).collect()} == {"und"}
    assert langid.predict(empty_docs, model).count() == 0 and langid.fit(empty_docs) == {}
    flags = docs.select("doc_id", langid.is_held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in flags)


def test_lm_scores(spark, edge_docs, edge_rows, empty_docs):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(x for _ in range(40) for x in (["red", "green", "blue"] if rng.random() < 0.5 else ["one", "two", "three"]))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    corpus = lmscore.statistics(docs)
    assert len(corpus.hashes) == 6
    net = lmscore.fit(docs, corpus)
    shuffled = spark.createDataFrame([(k, " ".join(rng.permutation(t.split()).tolist())) for k, t in rows], docs.schema)
    own = {r["doc_id"]: r["mean_log_prob"] for r in lmscore.score(docs, corpus, net).collect()}
    other = {r["doc_id"]: r["mean_log_prob"] for r in lmscore.score(shuffled, corpus, net).collect()}
    assert all(own[k] > other[k] for k in own)
    edge = lmscore.score(edge_docs, corpus, net).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in edge) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in edge_rows)
    assert all((r["mean_log_prob"] is None) == (r["n_tokens"] == 0) for r in edge)
    assert lmscore.score(empty_docs, corpus, net).count() == 0
    void = lmscore.statistics(empty_docs)
    assert lmscore.score(docs, void, lmscore.fit(empty_docs, void)).count() == len(rows)


def test_lm_result_does_not_depend_on_partitions(spark, edge_docs):
    found = []
    for n in (4, 16):
        docs = edge_docs.repartition(n)
        corpus = lmscore.statistics(docs)
        net = lmscore.fit(docs, corpus, start_rows=20, shard_windows=500)
        found.append(by_row(lmscore.score(docs, corpus, net), "doc_id", "n_tokens", "log_prob"))
    assert found[0] == found[1]


def test_lm_pseudo_likelihood_against_brute_force(spark, edge_docs, edge_rows):
    corpus = lmscore.statistics(edge_docs)
    net = lmscore.fit(edge_docs, corpus, start_rows=20)
    c, p = corpus.side, {k: v.astype(float) for k, v in net.p.items()}
    own, spell = dict(zip(corpus.hashes.tolist(), corpus.slots.tolist(), strict=True)), corpus.spell.reshape(256, 256)

    def slot(w):
        data = np.frombuffer(w, np.uint8)
        h = linededup.mix(np.zeros(1, np.uint64))  # a uint64 array to fill
        h[0] = lmscore.span_hash(lmscore.prefix_hash(data), np.array([0]), np.array([len(data)]))[0]
        return own.get(int(h[0]), corpus.own + int(linededup.mix(h ^ np.uint64(lmscore.SEED))[0] % np.uint64(c * c - corpus.own)))

    def brute(text):
        w = [x.encode() for x in WORD.findall((text or "").translate(LOWER))]
        ids = [c * c] * 2 + [slot(x) for x in w] + [c * c] * 2
        total = 0.0
        for k, x in enumerate(w):
            near = np.concatenate([p["embed"][ids[k + d]] for d in (0, 1, 3, 4)])
            h = np.tanh(near @ p["hidden"] + p["hidden_b"])
            z, (a, b) = h @ p["cls"] + p["cls_b"], divmod(ids[k + 2], c)
            y = h @ p["word"][a] + p["word_b"][a]
            total += z[a] - np.logaddexp.reduce(z) + y[b] - np.logaddexp.reduce(y)
            if ids[k + 2] >= corpus.own:
                total += min(0.0, sum(spell[u, v] for u, v in zip(b" " + x, x + b" ", strict=True)) + math.log(c * c - corpus.own))
        return total

    got = sorted((str(r["doc_id"]), r["n_tokens"], r["log_prob"]) for r in lmscore.score(edge_docs, corpus, net).collect() if r["n_tokens"] < 1000)
    want = sorted((str(r[0]), len(WORD.findall(r[1] or "")), brute(r[1])) for r in edge_rows if len(WORD.findall(r[1] or "")) < 1000)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 0.06 + 1e-4 * abs(w[2]) for g, w in zip(got, want, strict=True))


def test_lm_probabilities_sum_to_one():
    net = lmscore.WindowNet()
    ctx = np.array([[1, 2, 3, 4]] * net.side**2)
    assert abs(np.exp(net.log_probs(ctx, np.arange(net.side**2))).sum() - 1) < 1e-4


def test_lm_model_averaging_tree(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "FAN", 3)
    rows = [(k, k + 1, np.full(5, float(k), "<f4").tobytes()) for k in range(20)]
    flat, total = lmscore._average(spark.createDataFrame(rows, "k long, n long, flat binary"))
    assert total == 210 and np.allclose(flat, sum((k + 1) * k for k in range(20)) / 210)
