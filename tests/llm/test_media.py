import hashlib
import os
import random
import zlib

import pytest

from lakewright.llm import matroska, op10_media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1024, 1025, 2048, 2049, 5000, 8192, 40_000, 300_000])
def test_round_trip(n):
    k, payload = op10_media.payload_of("é" * n)
    assert k == 2 * n and len(payload) % 64 == 0 and len(payload) >= 64
    media = matroska.mux(payload)
    back, m = op10_media.read_payload(media)
    assert back == payload and m.doc_type == "matroska" and m.tracks[1]["codec"] == "A_PCM/INT/LIT"
    assert {c for _, _, c in m.cues} == set(m.clusters)
    assert [p.timestamp_ns for p in m.packets] == sorted(p.timestamp_ns for p in m.packets)
    for pos in m.clusters:
        assert media[m.segment + pos: m.segment + pos + 4] == bytes.fromhex("1f43b675")


@pytest.mark.parametrize("lacing", [matroska.NO_LACING, matroska.XIPH, matroska.FIXED, matroska.EBML_LACING])
def test_lacing(lacing):
    rng = random.Random(lacing)
    for _ in range(40):
        n = 1 if lacing == matroska.NO_LACING else rng.randrange(1, 20)
        size = rng.randrange(0, 70)
        parts = [os.urandom(size if lacing == matroska.FIXED else rng.randrange(0, 2000)) for _ in range(n)]
        body = matroska.block(3, -7, parts, lacing)
        track, rel, _, ranges = matroska.frames(body, 0, len(body))
        assert (track, rel) == (3, -7) and [body[a:b] for a, b in ranges] == parts


def test_unknown_sizes_groups_and_signed_times():
    e = matroska.element
    grouped = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, matroska.block(2, 5, [b"abc"], 0)) + matroska.uint(matroska.BLOCK_DURATION, 3))
    body = matroska.uint(matroska.CLUSTER_TIMESTAMP, 100) + grouped + e(matroska.SIMPLE_BLOCK, matroska.block(1, -4, [b"xy"], 0))
    open_cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + body
    data = e(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + open_cluster + open_cluster
    m = matroska.parse(data)
    assert [(p.track, p.timestamp_ns, data[p.start: p.end], p.cluster) for p in m.packets] == [(2, 105_000_000, b"abc", 0), (1, 96_000_000, b"xy", 0), (2, 105_000_000, b"abc", 1), (1, 96_000_000, b"xy", 1)]


def test_tables(spark):
    rows = [(1, "hello"), (2, None), (3, ""), (None, "x" * 9000), (1, "hello"), (5, "\U0001f600" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as media", "2 as feature")
    got = op10_media.digests(df).collect()
    assert len(got) == 6 and got[0] == got[4] and got[1][1:] == got[2][1:]
    for (i, t), r in zip(rows, got):
        n, payload = op10_media.payload_of(t)
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = matroska.mux(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    stored = op10_media.store(df)
    p = op10_media.packets(stored)
    assert p.where("error is not null").count() == 0 and p.where("doc_id = 5").count() == 196
    bad = spark.createDataFrame([(1, bytearray(b"\x00\x01")), (2, None), (3, bytearray(b"")), (4, bytearray(matroska.mux(b"a" * 64)[:90]))], "doc_id long, media binary")
    assert sorted(r["doc_id"] for r in op10_media.packets(bad).where("error is not null").collect()) == [1, 4]
    assert op10_media.digests(df.limit(0)).count() == 0
