import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lakewright.llm import op1_token_counts, op5_bpe, op7_packing
from lakewright.llm.tokens import Codec, codec, default_path

HARD = [
    "", "a", "  ", "\n\n x", "Hello, world's 'tisé 99 bottles", "<|endoftext|>a<|endoftext|> <|endoftext|>", "x" * 9000, "ab" * 7000, " " * 9000 + "y", "中文" * 3000,
    "word " * 3000, "\U0001f600" * 2500, "don't've\t\r\n  !!!???", "a" * 4096 + " " + "1" * 5000, "  ​﻿", "<|endoftext" * 900,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def want(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encode_equals_library(library):
    c = codec(default_path())
    rng = random.Random(5)
    alphabet = "ab \n'sté中1! <|endoftext|>"
    texts = HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(200)]
    for t in texts:
        assert c.encode(t).tolist() == want(library, t), t[:60]
        assert c.decode(c.encode(t)) == t == library.decode(want(library, t), skip_special_tokens=False)


def test_unsplit_text_equals_one_piece():
    c = Codec(default_path(), leaf=16)
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["a", "the", "ing", "é", "x", "tion", "中"]) for _ in range(rng.randrange(1, 200)))
        assert c.unsplit(text) == c.piece(text.encode())


def test_small_leaf_on_whole_texts(library):
    rng = random.Random(7)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "23", "!", "é", "中", "\u00a0", "\u3000", "\x1c", "\u0085", "\U0001f600", "$", "\u0301", "²", "ⅷ", "\u200b", "<|endoftext|>"]
    texts = HARD + ["".join(rng.choices(alphabet, k=rng.randrange(5, 300))) for _ in range(300)]
    for leaf in (5, 16, 64):
        c = Codec(default_path(), leaf=leaf)
        for t in texts:
            assert c.encode(t).tolist() == want(library, t), (leaf, t[:60])
        assert c.windows > 100


def test_every_code_point_at_a_seam(library):
    c = Codec(default_path(), leaf=8)
    points = [p for p in range(0x3000) if not 0xD800 <= p < 0xE000] + list(range(0x3000, 0x110000, 97))
    points = [p for p in points if not 0xD800 <= p < 0xE000]
    for at in range(0, len(points), 500):
        text = "".join(f"ab {chr(p)}c'{chr(p)} 1{chr(p)}{chr(p)}  " for p in points[at: at + 500])
        assert c.encode(text).tolist() == want(library, text), hex(points[at])


def test_documents_go_through_the_tree(library):
    import pyarrow.parquet as pq

    c = Codec(default_path())
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    for t in texts:
        assert c.encode(t).tolist() == want(library, t)
    assert c.windows >= sum(len(t) > 1024 for t in texts) > 100


def test_long_texts_in_parallel(library):
    c = codec(default_path())
    for text in ("wordy text, " * 20_000, "a" * 200_000, "中文字" * 50_000, " \n" * 60_000 + "x", "\n" * 3000 + "w" * 3000 + "\n\n" + "1" * 3000):
        assert c.encode(text).tolist() == want(library, text), text[:20]


def test_shortcut_counts(library):
    counts = op1_token_counts.Counts(codec(default_path()))
    assert len(counts.whole) > 20_000 and all(v == 1 for v in counts.whole.values())
    for t in HARD:
        assert counts.of(t) == len(want(library, t))
    assert counts.of(None) == 0
    counts.limit = len(counts.whole) + 3
    for i in range(50):
        assert counts.of(f"zqx{i}w") == len(want(library, f"zqx{i}w"))


def test_the_proof_can_fail():
    c = codec(default_path())
    told = op1_token_counts.whole_tokens(c.ranks, c.merges, c.split)
    assert 49_000 < len(told) <= len(c.ranks)
    # strings that no merges reach, that merges reach another way, or that split
    merges = {(b"a", b"b"): 0, (b"b", b"c"): 1, (b"a", b"bc"): 2, (b"x", b"y"): 3, (b" ", b"."): 4, (b"1", b"a"): 5}
    vocab = [b"a", b"ab", b"bc", b"abc", b"xy", b"zzzq", b" .", b"1a", b"\xff"]
    assert set(op1_token_counts.whole_tokens(vocab, merges, c.split)) == {"a", "ab", "bc", "xy", " ."}


def test_a_file_whose_ids_do_not_follow_its_merges_is_refused(tmp_path):
    import json

    with open(default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"][10], spec["model"]["merges"][11] = spec["model"]["merges"][11], spec["model"]["merges"][10]
    path = tmp_path / "swapped.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        Codec(str(path))


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(900, None), (None, "no id"), (3, HARD[3]), (3, HARD[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'x' as n_tokens", "1 as ids", "2 as `part`", "3 as length")


def test_counts_and_digests(spark, frame, library):
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in op1_token_counts.token_counts(frame).collect())
    assert got == sorted((str(i), len((t or "").encode()), len(want(library, t))) for i, t in rows)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op5_bpe.digests(frame).collect())
    assert got == sorted((str(i), len(want(library, t)), hashlib.sha256(np.array(want(library, t), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    ids = op5_bpe.encode(frame)
    assert sorted(r["text"] for r in op5_bpe.decode(ids).collect()) == sorted(t or "" for _, t in rows)


def test_packing_is_a_partition(spark, frame, library):
    got = op7_packing.pack(frame).collect()
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    ids = {i: [*want(library, t), 0] for i, t in rows}
    pieces, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        data = np.array(ids[r["doc_id"]][r["start"]: r["start"] + r["length"]], "<u4")
        assert len(data) == r["length"] <= 1024 and zlib.crc32(data.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    copies = {i: sum(j == i for j, _ in rows) for i, _ in rows}
    for i, got_i in pieces.items():
        assert sum(n for _, n in got_i) == len(ids[i]) * copies[i]
    assert set(pieces) == set(ids)
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_shortest_pack_first_uses_up_the_histogram():
    rng = random.Random(1)
    hist = {n: rng.randrange(1, 2000) for n in rng.sample(range(1, 1025), 400)}
    patterns = op7_packing.shortest_pack_first(hist)
    used = defaultdict(int)
    for p, n in patterns:
        assert sum(p) <= 1024
        for x in p:
            used[x] += n
    assert used == hist
    total = sum(k * v for k, v in hist.items())
    assert sum(n for _, n in patterns) * 1024 < 1.1 * total + 4096


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op1_token_counts.token_counts(df).count() == 0
    assert op5_bpe.digests(df).count() == 0
    assert op7_packing.pack(df).count() == 0
