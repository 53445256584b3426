"""Matroska: EBML elements, clusters, blocks with lacing, and cues.

Element ids and lacing codes below are fixed values of the public format.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Ids of elements.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, DURATION = 0x4282, 0x2AD7B1, 0x4489
DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION, MUXING_APP, WRITING_APP = 0x4287, 0x4285, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, RATE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
# Kinds of lacing, as in a block's flags.
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
TOP = {EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES}


#: What the files name as their writer.
APP = b"lakewright"


class Malformed(ValueError):
    """Bytes that are not an EBML document of this kind."""


# -- writing ---------------------------------------------------------------
def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer of the least width that holds it."""
    w = width or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(eid: int, n: int) -> bytes:
    return element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def float8(eid: int, x: float) -> bytes:
    import struct

    return element(eid, struct.pack(">d", x))


def signed_vint(n: int) -> bytes:
    w = next(k for k in range(1, 9) if abs(n) < (1 << 7 * k - 1))
    return vint(n + (1 << 7 * w - 1) - 1, w)


def block(track: int, rel: int, frames: list[bytes], lacing: int) -> bytes:
    """The body of a block: track, relative timestamp, flags, laced frames."""
    head = vint(track) + rel.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1])
    if lacing == NO_LACING:
        return head + frames[0]
    sizes = [len(f) for f in frames]
    laces = bytes([len(frames) - 1])
    if lacing == XIPH:
        laces += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == EBML_LACING and len(frames) > 1:  # the last size is what is left
        laces += vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    return head + laces + b"".join(frames)


def mux(payload: bytes, rate: int = 8000, frame: int = 1024, laced: int = 8, blocks: int = 32) -> bytes:
    """An 8-bit mono PCM file of payload: frames of `frame` bytes, `laced` to a
    block, `blocks` to a cluster. Equal frames are laced as fixed, two unlike
    ones as Xiph, more as EBML. The time unit is one sample."""
    # simple blocks are of version 2
    head = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 2) + uint(DOC_TYPE_READ_VERSION, 2))
    audio = element(AUDIO, float8(RATE, rate) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(DEFAULT_DURATION, 10**9 * frame // rate) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    info = element(INFO, uint(TIMESTAMP_SCALE, 10**9 // rate) + float8(DURATION, len(payload)) + element(MUXING_APP, APP) + element(WRITING_APP, APP))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    span = min(frame * laced * blocks, 32768 // (frame * laced) * (frame * laced))  # a relative timestamp has 16 bits
    for start in range(0, len(payload), span):
        parts = [uint(CLUSTER_TIMESTAMP, start)]
        for b in range(start, min(start + span, len(payload)), frame * laced):
            frames = [payload[f: f + frame] for f in range(b, min(b + frame * laced, len(payload)), frame)]
            same = len({len(f) for f in frames}) == 1
            lacing = NO_LACING if len(frames) == 1 else FIXED if same else XIPH if len(frames) == 2 else EBML_LACING
            parts.append(element(SIMPLE_BLOCK, block(1, b - start, frames, lacing)))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


# -- reading ---------------------------------------------------------------
@dataclass
class Packet:
    track: int
    timestamp_ns: int
    start: int
    end: int
    cluster: int
    lacing: int
    keyframe: bool


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    segment: int = 0


def read_vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, int]:
    """(value, width, next offset); value is -1 for an unknown size."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no variable-length integer at {at}")
    w = 9 - data[at].bit_length()
    if at + w > len(data):
        raise Malformed(f"cut off at {at}")
    n = int.from_bytes(data[at: at + w], "big")
    if not keep_marker:
        n ^= 1 << 7 * w
        if n == (1 << 7 * w) - 1:
            n = -1
    return n, w, at + w


def elements(data: bytes, at: int, end: int, within: int = 0):
    """(id, start of body, end of body) of the elements in data[at:end]. A
    segment or cluster of unknown size ends at the next element of its level."""
    while at < end:
        eid, _, p = read_vint(data, at, True)
        n, _, p = read_vint(data, p, False)
        if n < 0:
            if eid == CLUSTER:
                stop = next((a for i, a in _heads(data, p, end) if i in TOP), end)
            else:
                stop = end
        else:
            stop = p + n
        if stop > end:
            raise Malformed(f"element {eid:#x} at {at} runs over its parent")
        yield eid, p, stop
        at = stop


def _heads(data: bytes, at: int, end: int):
    while at < end:
        eid, _, p = read_vint(data, at, True)
        yield eid, at
        n, _, p = read_vint(data, p, False)
        if n < 0:
            return
        at = p + n


def frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative timestamp, flags, byte ranges) of a block's body."""
    track, _, at = read_vint(data, at, False)
    if at + 3 > end:
        raise Malformed("block without a header")
    rel, flags = int.from_bytes(data[at: at + 2], "big", signed=True), data[at + 2]
    at += 3
    lacing = flags >> 1 & 3
    if lacing == NO_LACING:
        return track, rel, flags, [(at, end)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(n - 1):
            s = 0
            while data[at] == 255:
                s, at = s + 255, at + 1
            sizes.append(s + data[at])
            at += 1
    elif lacing == EBML_LACING and n > 1:
        s, _, at = read_vint(data, at, False)
        sizes.append(s)
        for _ in range(n - 2):
            d, w, at = read_vint(data, at, False)
            if d < 0:
                d = (1 << 7 * w) - 1
            s += d - (1 << 7 * w - 1) + 1
            sizes.append(s)
    if lacing == FIXED:
        if (end - at) % n:
            raise Malformed("fixed lacing of unequal frames")
        sizes = [(end - at) // n] * n
    else:
        sizes.append(end - at - sum(sizes))
    out = []
    for s in sizes:
        if s < 0 or at + s > end:
            raise Malformed("a lace runs over its block")
        out.append((at, at + s))
        at += s
    return track, rel, flags, out


def parse(data: bytes) -> Media:
    """Packet table, tracks and cues of a file."""
    import struct

    m = Media()
    num = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b - a in (4, 8) else 0.0
    for eid, a, b in elements(data, 0, len(data)):
        if eid == EBML:
            m.doc_type = next((data[x:y].decode("ascii", "replace") for i, x, y in elements(data, a, b) if i == DOC_TYPE), "")
        if eid != SEGMENT:
            continue
        m.segment = a
        at = a
        for top, c, d in elements(data, a, b):
            if top == INFO:
                for i, x, y in elements(data, c, d):
                    if i == TIMESTAMP_SCALE:
                        m.scale = num(x, y)
                    elif i == DURATION:
                        m.duration = real(x, y)
            elif top == TRACKS:
                for i, x, y in elements(data, c, d):
                    if i == TRACK_ENTRY:
                        t = {"codec": "", "type": 0, "frame_ns": 0}
                        for j, p, q in elements(data, x, y):
                            if j == TRACK_NUMBER:
                                m.tracks[num(p, q)] = t
                            elif j == TRACK_TYPE:
                                t["type"] = num(p, q)
                            elif j == CODEC_ID:
                                t["codec"] = data[p:q].decode("ascii", "replace")
                            elif j == DEFAULT_DURATION:
                                t["frame_ns"] = num(p, q)
                            elif j == AUDIO:
                                t |= {"rate": next((real(u, v) for k, u, v in elements(data, p, q) if k == RATE), 8000.0)}
            elif top == CLUSTER:
                m.clusters.append(at - a)
                _cluster(data, c, d, m, num)
            elif top == CUES:
                for i, x, y in elements(data, c, d):
                    when, where = 0, []
                    for j, p, q in elements(data, x, y) if i == CUE_POINT else ():
                        if j == CUE_TIME:
                            when = num(p, q)
                        elif j == CUE_TRACK_POSITIONS:
                            got = {k: num(u, v) for k, u, v in elements(data, p, q)}
                            where.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER_POSITION, 0)))
                    m.cues += [(when * m.scale, t, pos) for t, pos in where]
            at = d
    return m


def _cluster(data: bytes, a: int, b: int, m: Media, num) -> None:
    base, which = 0, len(m.clusters) - 1
    for eid, x, y in elements(data, a, b):
        if eid == CLUSTER_TIMESTAMP:
            base = num(x, y)
        blocks = [(x, y, True)] if eid == SIMPLE_BLOCK else [(p, q, False) for j, p, q in elements(data, x, y) if j == BLOCK] if eid == BLOCK_GROUP else []
        for p, q, simple in blocks:
            track, rel, flags, ranges = frames(data, p, q)
            step = m.tracks.get(track, {}).get("frame_ns", 0)
            for k, (s, e) in enumerate(ranges):
                m.packets.append(Packet(track, (base + rel) * m.scale + k * step, s, e, which, flags >> 1 & 3, simple and bool(flags & 0x80)))
