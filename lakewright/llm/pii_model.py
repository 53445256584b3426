"""Boosted trees over candidate spans, fitted on generated texts.

No table labels spans, so texts are generated with a fixed seed: addresses and numbers
that are personal, and look-alikes that are not (times, versions, orders, dates, serial
numbers), each in a sentence, with or without words that announce it. The texts go through
the generators and the feature expressions that every query uses; a candidate is right
if it covers a personal span almost exactly. One half of the texts fits the trees,
the other calibrates a threshold for each kind. The trees become one SQL expression;
nothing here runs on rows of a table.
"""

from __future__ import annotations

import random

import numpy as np

FEATURES = ("kind", "generator", "length", "digits", "seps", "before_word", "after_word", "cue", "anti", "luhn", "distinct", "groups", "first", "parts", "marks", "space_before", "letters")
# Words that announce personal data, and words that announce other numbers.
CUES = "tel phone call fax mobile cell mail email e-mail contact reach card visa ip host address whatsapp sms telefon correo write ring dial pay server client".split()
ANTI = "order invoice version isbn issn page chapter figure table section serial item sku model build total sum price ref id code part lot ticket case release time at date since line".split()
#: Generated texts, trees, their rate and depth, and the least precision of a threshold.
TEXTS, TREES, RATE, DEPTH, PRECISION = 3000, 40, 0.3, 3, 0.97
KINDS = {"email": 0, "ip": 1, "card": 2, "phone": 3}


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _word(r: random.Random) -> str:
    return "".join(r.choice(["the", "on", "er", "ti", "le", "ch", "an", "ou", "st", "ver", "en", "la"]) for _ in range(r.randrange(1, 4)))


def _personal(r: random.Random, kind: str) -> str:
    name, site, tld = _word(r) + r.choice(["", ".", "_", "-"]).join(["", _word(r)]) * r.randrange(2), _word(r) + r.choice(["", "mail", "-net"]), r.choice(["com", "org", "net", "de", "fr", "es", "io"])
    if kind == "email":
        at, dot = r.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" AT ", " DOT "), (" at ", " dot "), (" @ ", "."), (" @ ", " . "), ("(at)", "(dot)")])
        return name + at + site + dot + tld
    if kind == "ip":
        group = lambda: f"{r.randrange(1 << r.choice([8, 16, 16, 16])):x}"
        form = r.randrange(3)
        if form == 0:
            return ":".join(group() for _ in range(8))
        if form == 1:
            k = r.randrange(1, 6)
            return ":".join(group() for _ in range(k)) + "::" + ":".join(group() for _ in range(r.randrange(1, 7 - k)))
        return r.choice(["[.]", " . ", "(.)", "[dot]"]).join(str(r.randrange(256)) for _ in range(4))
    if kind == "card":
        d = list(r.choice("3456") + _digits(r, 15))
        if r.random() < 0.5:
            return "".join(d)
        sep = r.choice([" ", "-", ".", "/"])
        return sep.join("".join(d[k: k + 4]) for k in range(0, 16, 4))
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{_digits(r, 2)} {a} {b}{c}", f"0{a[:2]} / {b} {c}", f"0{a}{b}{c}"])


def _other(r: random.Random, kind: str) -> str:
    w = lambda: _word(r)
    if kind == "email":
        return r.choice([f"{w()} at {w()} dot {w()} {w()}", f"{w()} at the dot of {w()}", f"{w()} @ {w()}", f"2 @ {r.randrange(90)}.50", f"{w()} AT {w()}"])
    if kind == "ip":
        return r.choice([f"{r.randrange(24)}:{_digits(r, 2)}:{_digits(r, 2)}", "std::" + w(), f"{w()[:3]}::{w()[:3]}", ":".join(f"{r.randrange(256):02x}" for _ in range(6)), f"{r.randrange(9)}[.]{r.randrange(30)}", ".".join(str(r.randrange(40)) for _ in range(3)), "a::b"])
    if kind == "card":
        return r.choice([_digits(r, r.choice([13, 14, 17, 18, 19])), "1" + _digits(r, 12), "978" + _digits(r, 10), "0." + _digits(r, 16), "_" + _digits(r, 16), _digits(r, 16) + w(), "-".join(_digits(r, 4) for _ in range(5)), "/".join(_digits(r, 4) for _ in range(3)), w() + _digits(r, 16), "#" + _digits(r, 16)])
    return r.choice([f"20{_digits(r, 2)}-0{r.randrange(1, 9)}-{_digits(r, 2)}", f"978-3-{_digits(r, 2)}-{_digits(r, 6)}-{r.randrange(9)}", f"{r.randrange(1, 9)} {_digits(r, 3)} {_digits(r, 3)}", f"{_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}-{_digits(r, 2)}", f"{_digits(r, 3)} {_digits(r, 3)} {_digits(r, 3)}", f"{_digits(r, 2)}.{_digits(r, 3)}.{_digits(r, 3)}", f"{_digits(r, 8)}", f"{_digits(r, 12)}", "0" + _digits(r, r.randrange(12, 18))])


def generated(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with their personal spans (kind, start, end in code points)."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randrange(1, 3)):
            kind, good = r.choice(list(KINDS)), r.random() < 0.5
            text += " ".join(_word(r) for _ in range(r.randrange(1, 9))).capitalize() + " "
            if r.random() < (0.5 if good else 0.1):
                text += r.choice(CUES) + r.choice([" ", ": ", " is "])
            elif not good and r.random() < 0.5 or good and r.random() < 0.02:
                # a number of any form that other words announce is not personal
                text += r.choice(ANTI) + r.choice([" ", ": ", " no. ", " = "])
                text += (_other(r, kind) if r.random() < 0.5 or kind in ("email", "ip") else _personal(r, kind)) + " "
                continue
            at, item = len(text), _personal(r, kind) if good else _other(r, kind)
            text += item
            if good:
                spans.append((kind, at, len(text)))
            text += r.choice([" ", ". ", ", ", "\n"]) + " ".join(_word(r) for _ in range(r.randrange(0, 6))) + ". "
        out.append((text, spans))
    return out


def right(kind: str, s: int, e: int, spans: list[tuple[str, int, int]]) -> bool:
    """Whether a candidate covers a personal span of its kind almost exactly."""
    return any(k == kind and 10 * (min(e, b) - max(s, a)) >= 8 * (max(e, b) - min(s, a)) for k, a, b in spans)


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree of second-order gains: (feature, limit, left, right) or a leaf."""
    best, lam = (1e-6, 0, 0.0), 1.0
    total = g.sum() ** 2 / (h.sum() + lam)
    if depth and len(x) > 1:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(np.diff(v) > 0)
            if len(at):
                gain = gs[at] ** 2 / (hs[at] + lam) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + lam) - total
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float(v[at[k]]))
    if best[0] <= 1e-6:
        return round(float(-g.sum() / (h.sum() + lam)) * RATE, 6)
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], g[left], h[left], depth - 1), grow(x[~left], g[~left], h[~left], depth - 1)


def value(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def fit(x: np.ndarray, y: np.ndarray, unseen: np.ndarray) -> tuple[list, list[float]]:
    """Trees fitted on the rows that are not unseen, and a threshold for each kind:
    the least score at which PRECISION of the accepted unseen candidates are right."""
    own, goal = x[~unseen], y[~unseen]
    trees, score = [], np.zeros(len(own))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(own, p - goal, p * (1 - p), DEPTH))
        score += np.array([value(trees[-1], r) for r in own])
    limits = []
    for k in sorted(KINDS.values()):
        rows = unseen & (x[:, 0] == k)
        got = np.array([sum(value(t, r) for t in trees) for r in x[rows]])
        order = np.argsort(-got, kind="stable")
        share = np.cumsum(y[rows][order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero((share >= PRECISION) & (np.append(got[order][1:], -np.inf) < got[order]))
        limits.append(round(float(got[order][good[-1]]), 6) if len(good) else float("inf"))
    return trees, limits
