import random
from collections import defaultdict

import numpy as np
import pytest

from lakewright.llm import op3_minhash, op8_embeddings
from lakewright.llm.common import components
from lakewright.llm.shingles import shingle_set, signature, word_hashes


def brute_sets(text, n):
    words, word = [], []
    for b in (text or "").encode():
        if b == 0x20 or 0x09 <= b <= 0x0D:
            if word:
                words.append(bytes(word))
            word = []
        else:
            word.append(b + 32 if 0x41 <= b <= 0x5A else b)
    if word:
        words.append(bytes(word))
    if not words:
        return set()
    return {tuple(words[i: i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def groups(items, linked):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = [None, "", " \n\t ", "one", "one two", "ONE Two", "one\ttwo  ", "É é", "x " * 5000]
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randrange(30, 200))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy))
    return list(enumerate(out))


def test_shingles_equal_brute_force():
    for _, t in corpus():
        for n in (1, 3, 5):
            assert len(shingle_set(t, n)) == len(brute_sets(t, n))
    assert np.array_equal(word_hashes("A b" + " c" * 10), word_hashes("a\x0bB" + "\tC" * 10)) is True
    long = "alpha beta " * 200_000
    assert len(word_hashes(long)) == 400_000 and len(set(word_hashes(long).tolist())) == 2


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    s = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    t = np.concatenate([s[:450], rng.integers(0, 2**63, 50, dtype=np.uint64)])
    same = (signature(s, 2048) == signature(np.unique(t), 2048)).mean()
    assert abs(same - 450 / 550) < 0.08
    few = signature(s[:2], 168)
    assert len(set(few.tolist())) == 2


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, words, percent):
    rows = corpus()
    df = spark.createDataFrame([*rows, (None, rows[20][1]), rows[20], rows[20]], "doc_id long, text string").selectExpr("*", "1 as bands", "2 as `set`", "3 as component_id")
    got = [r.asDict() for r in op3_minhash.near_duplicates(df, words=words, percent=percent).collect()]
    assert len(got) == len(rows) + 3
    sets = {i: brute_sets(t, words) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = groups(sets, links)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] is None
            continue
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_empty_and_wordless_tables(spark):
    assert op3_minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = op3_minhash.near_duplicates(spark.createDataFrame([(2, None), (1, " ")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (300, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(30):
        base = rng.normal(size=32)
        for _ in range(int(rng.integers(1, 9))):
            v = base + rng.normal(size=32) * rng.choice([0.0, 0.15, 0.3])
            rows.append((len(rows), [float(x) for x in v], int(g % 3)))
    good = len(rows)
    nan = float("nan")
    rows += [(good, None, 1), (good + 1, [0.0] * 32, 1), (good + 2, [nan] + [1.0] * 31, 1), (good + 3, [None] + [1.0] * 31, 1), (good + 4, rows[0][1], None), (good + 5, [], 1), (good + 6, [float("inf")] * 32, 0), (0, rows[0][1], 0), (good + 7, [1e-200] * 32, 2), (good + 8, [2e200] * 32, 2), (good + 9, [1.0, 2.0], 2), (None, rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as `key`", "2 as prefix", "3 as block")
    got = [r.asDict() for r in op8_embeddings.near_vectors(df).collect()]
    assert len(got) == len(rows)
    use = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    unit = [np.array(r[1]) / np.abs(r[1]).max() for r in use]
    unit = [u / np.linalg.norm(u) for u in unit]
    n, links = defaultdict(list), []
    for i, a in enumerate(use):
        count = sum(len(a[1]) == len(b[1]) and a[2] == b[2] and i != j and unit[i] @ unit[j] >= 0.93 for j, b in enumerate(use))
        n[a[0]].append(count)
        links += [(a[0], b[0]) for j, b in enumerate(use) if i < j and len(a[1]) == len(b[1]) and a[2] == b[2] and unit[i] @ unit[j] >= 0.93]
    want = groups({r[0] for r in rows if r[0] is not None}, links)
    have = defaultdict(list)
    for r in got:
        if r["vec_id"] is None:
            assert r["n_links"] == 0 and r["component_id"] is None
            continue
        have[r["vec_id"]].append(r["n_links"])
        assert r["component_id"] == want[r["vec_id"]] and r["kept"] == (r["vec_id"] == r["component_id"])
    total = sum(sum(v) for v in n.values())
    assert sum(sum(v) for v in have.values()) >= 0.9 * total
    assert all(sorted(have[i]) == sorted(n.get(i, [0] * len(have[i]))) for i in have)


def test_no_vectors(spark):
    assert op8_embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    got = op8_embeddings.near_vectors(spark.createDataFrame([(5, None, 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert [tuple(r) for r in got] == [(5, 0, 5, True)]


def test_blocks_cover_every_pair(spark, monkeypatch):
    monkeypatch.setattr(op8_embeddings, "BLOCK", 3)
    rows = [(i, [1.0, 0.001 * i, 0.0], 1) for i in range(20)]
    got = op8_embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r["n_links"] == 19 and r["component_id"] == 0 for r in got)


def test_near_copies_of_strangers_that_share_buckets(spark):
    # strangers alike below the limit (0.77), each with one near copy (0.86)
    shared, rows = [f"t{i}" for i in range(200)], []
    for i in range(300):
        own = [f"s{i}x{j}" for j in range(30)]
        rows.append((2 * i, " ".join(shared + own)))
        rows.append((2 * i + 1, " ".join(shared + own[:13] + [f"c{i}x{j}" for j in range(17)])))
    got = {r["doc_id"]: r["component_id"] for r in op3_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1, percent=85).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_bands_follow_the_limit():
    for percent in (75, 80, 85, 90, 100):
        bands, rows = op3_minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-4


@pytest.mark.parametrize("block", [4, 10_000])
def test_every_pair_of_a_bucket_is_settled(spark, monkeypatch, block):
    # chains of near copies around a common text, so that hubs miss many of them
    monkeypatch.setattr(op3_minhash, "BLOCK", block)
    rng = random.Random(11)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(90):
        own = list(base)
        for k in rng.sample(range(120), rng.choice([4, 9, 14, 20])):
            own[k] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(own)))
    sets = {i: brute_sets(t, 1) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in op3_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1, percent=85).collect()}
    assert got == groups(sets, linked)


def test_deduplicate_keeps_rows_by_id_and_text(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "z"), (None, a, "n"), (None, "all by itself " * 9, "m"), (3, "", "e"), (3, "", "e"), (None, None, "e"), (4, b.upper(), "u"), (5, "only one row", "o"), (5, "only one row", "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `set` string").selectExpr("*", "1 as h", "2 as component")
    got = op3_minhash.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["set"]) for r in got.collect()) == [(0, "e"), (0, "m"), (1, "x"), (2, "z"), (3, "e"), (3, "e"), (5, "o")]
    assert op3_minhash.deduplicate(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "lorem ipsum dolor " * 60_000), (2, "lorem ipsum dolor " * 60_000), (3, "sit " * 300_000)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in op3_minhash.deduplicate(long).select("doc_id").collect()) == [1, 3]


def links_of(x, labels, limit=0.93):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (u @ u.T >= limit) & (labels[:, None] == labels[None]) & ~np.eye(len(x), dtype=bool)


@pytest.mark.parametrize("flat", [4096, 40])
def test_recall_of_links_near_the_limit(spark, monkeypatch, flat):
    monkeypatch.setattr(op8_embeddings.Pivots.__init__, "__defaults__", (flat,))
    rng = np.random.default_rng(7)
    base = rng.normal(size=(150, 24))
    x = base[rng.integers(0, 150, 1200)] + 0.22 * rng.normal(size=(1200, 24))
    x = np.concatenate([x, base[0] + 0.15 * rng.normal(size=(600, 24))])  # a third of all rows
    labels = rng.integers(0, 2, len(x))
    want = links_of(x, labels)
    rows = [(i, [float(c) for c in v], int(y)) for i, (v, y) in enumerate(zip(x, labels, strict=True))]
    got = {r["vec_id"]: r for r in op8_embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert 0.99 * want.sum() <= found <= want.sum()
    assert all(got[i]["n_links"] <= want[i].sum() for i in got)


def test_two_level_pivots_find_the_nearest():
    rng = np.random.default_rng(8)
    ref = op8_embeddings.unit(rng.normal(size=(2000, 16)))
    x = op8_embeddings.unit(rng.normal(size=(300, 16)))
    exact = op8_embeddings.Pivots(ref, flat=5000).nearest(x, 8)
    near = op8_embeddings.Pivots(ref, flat=100).nearest(x, 8)
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(exact, near, strict=True)]) > 0.8


def test_batches_do_not_split_block_pairs():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    rows = []
    for p in range(30):
        v = rng.normal(size=4)
        rows += [{"label": "a", "dim": 4, "p": p, "q": p + 1, "i": 0, "j": 0, "block": 0, "key": bytes([p, k]), "n": 1, "prefix": [p, p + 1], "v": (v + 0.01 * k).tobytes()} for k in range(int(rng.integers(1, 6)))]
    t = pa.Table.from_pylist(rows, schema=pa.schema([("label", pa.string()), ("dim", pa.int32()), ("p", pa.int32()), ("q", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("key", pa.binary()), ("n", pa.int64()), ("prefix", pa.list_(pa.int32())), ("v", pa.binary())]))
    whole = [r for b in op8_embeddings.verified(iter(t.to_batches()), 0.93) for r in b.to_pylist()]
    for size in (1, 2, 3, 7):
        parts = [r for b in op8_embeddings.verified(iter(t.to_batches(max_chunksize=size)), 0.93) for r in b.to_pylist()]
        assert parts == whole and len(whole) > 20
