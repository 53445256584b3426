"""Media columns: Matroska files to and from packet tables.

`store` writes each payload as a Matroska file of 8-bit samples; `packets`
parses files into one row per packet with its track, timestamp, cluster and
byte range. Bytes that are no Matroska file give no packets and an error text.

A null or empty text has a payload of 64 zero bytes. Equal texts give equal
values; repeated rows repeat; an empty table gives an empty result. Further columns
are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import matroska
from .common import table


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(unpadded length, UTF-8 bytes padded to a positive multiple of 64)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def read_payload(media: bytes) -> tuple[bytes, matroska.Media]:
    """The samples of a file's first track in timestamp order."""
    m = matroska.parse(media)
    own = sorted((p for p in m.packets if p.track == min(m.tracks)), key=lambda p: (p.timestamp_ns, p.start))
    return b"".join(media[p.start: p.end] for p in own), m


def feature(payload: bytes, m: matroska.Media) -> str:
    """What a stored file holds: structure and integer signal statistics."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    laced = [0, 0, 0, 0]
    for p in m.packets:
        laced[p.lacing] += 1
    cued = {c for _, _, c in m.cues} == set(m.clusters)
    return f"clusters={len(m.clusters)};packets={len(m.packets)};laced={':'.join(map(str, laced))};cued={int(cued)};last_ns={max((p.timestamp_ns for p in m.packets), default=0)};sum={int(x.sum())};energy={int(((x - 128) ** 2).sum())};crossings={int(np.count_nonzero(np.diff(x >= 128)))}"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media) with the text's payload as a Matroska file."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([matroska.mux(payload_of(x.as_py())[1]) for x in b.column(1)], pa.binary())], names=[id_col, "media"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, media binary")


def packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: (id, n, track, timestamp_ns, cluster, lacing, keyframe,
    byte_start, byte_end, error); a file that cannot be read has one row with the
    error alone, a null file none."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["n", "track", "timestamp_ns", "cluster", "lacing", "keyframe", "byte_start", "byte_end", "error"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, rows = [], []
            for i, x in enumerate(b.column(1)):
                data = x.as_py()
                if data is None:
                    continue
                try:
                    got = [(n, p.track, p.timestamp_ns, p.cluster, p.lacing, p.keyframe, p.start, p.end, None) for n, p in enumerate(matroska.parse(data).packets)]
                except (matroska.Malformed, IndexError) as e:
                    got = [(*[None] * 8, str(e))]
                rows += got
                of += [i] * len(got)
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[id_col, *names])

    return df.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, n long, track long, timestamp_ns long, cluster long, lacing long, keyframe boolean, byte_start long, byte_end long, error string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store, read back and digest in one pass, so that files need not leave the worker."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for b in batches:
            rows = []
            for x in b.column(1):
                n, payload = payload_of(x.as_py())
                media = matroska.mux(payload)
                back, m = read_payload(media)
                if len(back) != len(payload):
                    raise matroska.Malformed("a stored payload came back with another length")
                rows.append((n, len(back), sha(back).hexdigest(), zlib.crc32(back[-64:]), len(media), sha(media).hexdigest(), feature(back, m)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
