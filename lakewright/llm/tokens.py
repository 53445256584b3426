"""Byte-level BPE from a public tokenizer file, exact for texts of any length.

`Codec.encode` gives the ids that the tokenizers library gives for the file. A text
longer than a leaf is encoded by tree concatenation: its halves are encoded apart,
then a window around the cut is encoded again and grown until it agrees with both
sides. There are two kinds of windows.

- Text that splits: a window ends where every split has a boundary, that is where the
  class of characters (letter, number, white space, other) changes in a way that no
  pre-token spans. The left half's ids of the window's left part and the right half's
  ids of its right part must be what the encoder gives for these parts alone; then all
  other ids stand, and the window's ids replace those between.
- Unsplit text, one pre-token longer than a leaf: a window is some tokens on each side
  of the join. A seam agrees if the pair of tokens at it encodes to itself; a token
  sequence whose neighbouring pairs all do so is the encoding of its bytes, since a
  merge across a seam would already show in the pair.

Leaves of long texts are encoded by two threads; the encoder holds no lock meanwhile.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import regex
import tiktoken

# The split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters above which a text, or one pre-token, is encoded as a tree.
LEAF = 1024
#: Characters from which a text's leaves are encoded by two threads.
THREADS = 1 << 16


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a vocabulary string stands for: printable
    Latin-1 stands for itself, the other bytes follow from U+0100 in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merged(piece: list[bytes], rank: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Byte-pair merging by rank, lowest first and leftmost of equals, from single
    bytes and by merges alone."""
    while len(piece) > 1:
        best = min(zip(piece, piece[1:], strict=False), key=lambda p: rank.get(p, len(rank)))
        if best not in rank:
            break
        out, i = [], 0
        while i < len(piece):
            if i + 1 < len(piece) and (piece[i], piece[i + 1]) == best:
                out.append(piece[i] + piece[i + 1])
                i += 2
            else:
                out.append(piece[i])
                i += 1
        piece = out
    return piece


_SPACE = regex.compile(r"\s")
#: Places at which every split has a boundary.
_BOUND = regex.compile(r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=[^\s\p{L}\p{N}])(?=[\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")


class Codec:
    def __init__(self, path: str, leaf: int = LEAF):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"] != spec["pre_tokenizer"] | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or spec["normalizer"]:
            raise ValueError(f"not a plain byte-level BPE: {path}")
        byte = _byte_of()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.ranks = {bytes(byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        halves = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(bytes(byte[c] for c in x), bytes(byte[c] for c in y)): k for k, (x, y) in enumerate(halves)}
        # the encoder takes ids for ranks: merges must make tokens in the order of their ids
        made = [self.ranks.get(x + y, -1) for x, y in self.merges]
        if spec["model"].get("ignore_merges") or any(i >= j for i, j in zip(made, made[1:], strict=False)) or made and made[0] < 0:
            raise ValueError(f"ids do not follow the merges: {path}")
        self.enc = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=special)
        self.split = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.leaf = leaf
        self.piece = self.enc._encode_single_piece
        self.plain = self.enc.encode_ordinary
        self.bytes_of = self.enc.decode_bytes
        self.pool: ThreadPoolExecutor | None = None
        self.windows = 0
        del spec

    # -- unsplit text ------------------------------------------------------
    def _agree(self, x: int, y: int) -> bool:
        return self.piece(self.bytes_of([x, y])) == [x, y]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of left's bytes and right's bytes together."""
        if not left or not right:
            return left + right
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            mid = self.piece(self.bytes_of(a + b))
            keep, rest = left[: len(left) - len(a)], right[len(b):]
            if (not keep or self._agree(keep[-1], mid[0])) and (not rest or self._agree(mid[-1], rest[0])):
                return keep + mid + rest
            k *= 2

    def leaves(self, text: str) -> list[list[int]]:
        """Ids of the text's parts of leaf characters, each alone; in parallel if long."""
        parts = [text[i: i + self.leaf] for i in range(0, len(text), self.leaf)]
        if len(text) < THREADS:
            return [self.plain(p) for p in parts]
        if self.pool is None:
            self.pool = ThreadPoolExecutor(2)
        return list(self.pool.map(self.plain, parts))

    def unsplit(self, text: str) -> list[int]:
        """Encode one pre-token of any length: leaves, then joins of tokens."""
        parts = self.leaves(text)
        while len(parts) > 1:
            parts = [self.join(*parts[i: i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    # -- text that splits --------------------------------------------------
    def joined(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        w = 16
        while True:
            a, b = max(lo, mid - w), min(hi, mid + w)
            # a contraction looks two characters ahead, so a safe end keeps away from the cut
            p = next((m.start() for m in reversed(list(_BOUND.finditer(text, a, mid - 2))) if m.start() > a), None) if a > lo else lo
            q = next((m.start() for m in _BOUND.finditer(text, mid, b) if mid < m.start() < b), None) if b < hi else hi
            if p is not None and q is not None:
                tail, head = self.plain(text[p:mid]), self.plain(text[mid:q])
                if left[len(left) - len(tail):] == tail and right[: len(head)] == head:
                    self.windows += 1
                    return left[: len(left) - len(tail)] + self.plain(text[p:q]) + right[len(head):]
            w *= 2

    def concatenated(self, text: str) -> list[int]:
        """Encode a text without long pre-tokens: leaves, then joins of windows."""
        parts, size = self.leaves(text), self.leaf
        while len(parts) > 1:
            parts = [self.joined(text, i * size, (i + 1) * size, min((i + 2) * size, len(text)), parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
            size *= 2
        return parts[0] if parts else []

    def has_long(self, text: str) -> bool:
        """Whether a pre-token may be longer than a leaf."""
        if len(text) <= self.leaf:
            return False
        words = text.split()
        if words and max(map(len, words)) >= self.leaf:
            return True
        return len(text) - sum(map(len, words)) - len(words) >= self.leaf

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without special strings that may hold long pre-tokens."""
        out: list[int] = []
        start = end = 0
        for m in self.split.finditer(text):
            if m.end() - m.start() > self.leaf:
                # the text before ends at a boundary; white space at its end may split otherwise
                out += self._between(text, start, m.start())
                out += self.unsplit(m.group())
                start = m.end()
            end = m.end()
        return out + self._between(text, start, end)

    def _between(self, text: str, start: int, end: int) -> list[int]:
        """Ids of text[start:end], both being boundaries of the text's pre-tokens."""
        body = end
        while body > start and _SPACE.match(text, body - 1):
            body -= 1
        if end == len(text) or body == end or _SPACE.match(text, end):
            return self.concatenated(text[start:end])
        # white space before a word splits as the whole text has it
        out = self.concatenated(text[start:body])
        for m in self.split.finditer(text, body):
            if m.start() >= end:
                break
            out += self.plain(m.group())
        return out

    # -- whole texts -------------------------------------------------------
    def segments(self, text: str):
        """Parts of text as (string, None) or (special string, id)."""
        if self.specials is None or not any(s in text for s in self.special):
            yield text, None
            return
        at = 0
        for m in self.specials.finditer(text):
            yield text[at: m.start()], None
            yield m.group(), self.special[m.group()]
            at = m.end()
        yield text[at:], None

    def encode(self, text: str | None) -> np.ndarray:
        """uint32 ids of a whole text; null and empty give none."""
        if not text:
            return np.empty(0, np.uint32)
        if len(text) <= self.leaf and not any(s in text for s in self.special):
            return self.enc.encode_to_numpy(text, disallowed_special=())
        out: list[int] = []
        for part, sid in self.segments(text):
            if sid is not None:
                out.append(sid)
            else:
                out += self._plain(part) if self.has_long(part) else self.concatenated(part)
        return np.asarray(out, np.uint32)

    def decode(self, ids) -> str:
        return self.enc.decode_bytes([int(i) for i in ids] if not isinstance(ids, np.ndarray) else ids.tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str, leaf: int = LEAF) -> Codec:
    """One codec per worker process and file."""
    return Codec(path, leaf)
