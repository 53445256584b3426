import hashlib
import random
import re

import pytest

from lakewright.llm import op2_quotes, op6_pii, pii_model

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    return [f"{k}:{m.start()}:{m.end()}" for k in PATTERNS for m in re.finditer(PATTERNS[k], text or "") if ok[k](m.group())]


def texts():
    rng = random.Random(8)
    out = ["".join(rng.choice("a.@-+1 23(4)\U0001f600é_%0") for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    return [*out, None, "", "a@b.co_x@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.0.0.01", "4444 4444 4444 4448", "1" * 30_000, "a" * 30_000, "1 " * 4000, "a@b.c " * 1200, "+1 (234) 555-0199 x", "é\U0001f600 me@x.org", "4111111111111111 4111-1111-1111-1111"]


@pytest.fixture(scope="module")
def found(spark):
    rows = list(enumerate(texts())) + [(None, "q@w.e"), (2, "q@w.e"), (2, "q@w.e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as base", "2 as added", "3 as spans")
    return rows, df


def test_base_spans_equal_brute_force(spark, found):
    rows, df = found
    want = sorted((str(i), brute(t)) for i, t in rows)
    got = [(str(r["doc_id"]), [f"{k}:{x['s']}:{x['e']}" for k in PATTERNS for x in r["base"][k]]) for r in op6_pii.find(df.select("doc_id", "text")).collect()]
    assert sorted(got) == want


def test_query_columns(spark, found, monkeypatch):
    rows, df = found
    monkeypatch.setattr(op6_pii, "table", lambda *a: df)
    got = op6_pii.query(spark, "").collect()
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == sorted((str(i), hashlib.sha256(",".join(brute(t)).encode()).hexdigest()) for i, t in rows)
    for r in got:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        order = list(PATTERNS)
        assert spans == sorted(spans, key=lambda s: (order.index(s[0]), int(s[1])))


def test_added_spans_and_redaction(spark):
    rows = [(1, "call 555-123-4567 now"), (2, "order 555-123-4567-88 page"), (3, "mail bob (at) site (dot) com ok"), (4, "a@b.co and 10.0.0.1"), (5, None), (6, "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as base", "7 as `Added`", "null as s")
    out = {r["doc_id"]: r for r in op6_pii.redact(df).collect()}
    assert out[1]["text"] == "call [phone] now" and out[3]["text"] == "mail [email] ok"
    assert out[2]["text"] == rows[1][1]
    assert out[4]["text"] == "[email] and [ip]" and out[5]["text"] is None and out[6]["text"] == "plain"
    assert out[1]["base"] == "k" and out[1]["Added"] == 7 and list(out[1].asDict()) == df.columns


def test_added_spans_of_unseen_texts(spark):
    texts = pii_model.generated(1500, seed=99)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    good = bad = 0
    caught = [set() for _ in texts]
    for r in op6_pii.find(df).collect():
        want, base = texts[r["doc_id"]][1], [(x["s"], x["e"]) for k in PATTERNS for x in r["base"][k]]
        last = 0
        for x in r["added"]:
            assert x["s"] >= last and not any(s < x["e"] and x["s"] < e for s, e in base)
            last = x["e"]
            ok = pii_model.right(x["kind"], x["s"], x["e"], want)
            good, bad = good + ok, bad + (not ok)
        for k, s, e in want:
            if any(pii_model.right(x["kind"], x["s"], x["e"], [(k, s, e)]) for x in r["added"]) or any(a < e and s < b for a, b in base):
                caught[r["doc_id"]].add((k, s, e))
    assert good / (good + bad) > 0.93
    assert sum(map(len, caught)) / sum(len(s) for _, s in texts) > 0.75


def test_overlaps_of_generators_are_settled_along_the_text(spark):
    # two generators propose the same number, and a base span beats what overlaps it
    rows = [(1, "ring 0049 555 1234567 or dial (030) 555-1234"), (2, "+49 30 5551234 567"), (3, "pay 4111 1111 1111 1112 now"), (4, "card 4111111111111111 ok")]
    got = {r["doc_id"]: r for r in op6_pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [x["kind"] for x in got[1]["added"]] == ["phone", "phone"] and len(got[2]["base"]["phone"]) == 1 and not got[2]["added"]
    assert [(x["s"], x["e"]) for x in got[3]["added"]] == [(4, 23)] and len(got[4]["base"]["card"]) == 1 and not got[4]["added"]


def test_redaction_of_very_many_spans(spark):
    import time

    text = "é call 555-123-4567 or a@b.co, " * 4000
    began = time.time()
    got = op6_pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]["text"]
    assert got == "é call [phone] or [email], " * 4000 and time.time() - began < 60


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op6_pii.find(df).count() == 0 and op6_pii.redact(df).count() == 0


# -- quotations --------------------------------------------------------------
def link(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as place", "2 as quotes")
    return [r.asDict() for r in op2_quotes.link(df).orderBy("conv_id", "place").collect()]


def test_links_and_order(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you today?"),
        (1, 1, "assistant", "> How are  YOU today?\nFine, thanks.\nOn Monday Bob wrote:\n>> deep one\n> Hello there.\nok"),
        (1, 2, "user", "> Fine, thanks.\ngood"),
        (1, 3, "user", "> Hello there.\nme too"),
        (2, 0, "user", "> Hello there.\nfrom elsewhere"),
        (2, 1, "user", None), (2, 1, "user", ""), (None, 0, "user", "x"), (3, None, None, "y"), (4, 5, "user", "alone"),
    ]
    got = link(spark, rows)
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[1, 1]["body"] == "Fine, thanks.\nok" and by[1, 1]["n_quotes"] == 3 and by[1, 1]["n_linked"] == 2 and by[1, 1]["quote_depth"] == 2
    assert by[1, 2]["parent_turn"] == 1 and by[1, 3]["parent_turn"] == 0 and by[1, 3]["depth"] == 1 and by[1, 2]["depth"] == 2
    assert (by[2, 0]["linked_conv_id"], by[2, 0]["linked_turn"], by[2, 0]["parent_turn"]) == (1, 0, None)
    assert sorted(r["place"] for r in got if r["conv_id"] == 2) == [0, 1, 2]
    assert by[None, 0]["place"] == 0 and by[3, None]["body"] == "y" and by[4, 5]["thread_turn"] == 5


def brute_levels(text):
    out = []
    for line in re.split(r"\r\n|\n|\r", text):
        m = re.match(r"(?:[ \t]*>)*", line)
        out.append((m.group().count(">"), re.sub(r"^ ", "", line[m.end():])))
    return out


def test_levels_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(["> ", ">", " ", "a", "b\n", "\n", "\r\n", "c"]) for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string")
    for r in df.select("text", op2_quotes.lines(df.text).alias("ls")).collect():
        assert [(x["level"], x["line"]) for x in r["ls"]] == brute_levels(r["text"])


def test_long_threads_and_messages(spark):
    rows = [(1, t, "user", f"m{t}") for t in range(300)] + [(2, 0, "user", "> q\nline\n" * 3000)]
    got = link(spark, rows)
    one = [r for r in got if r["conv_id"] == 1]
    assert [r["turn"] for r in one] == list(range(300)) and max(r["depth"] for r in one) == 299 and {r["thread_turn"] for r in one} == {0}
    assert next(r for r in got if r["conv_id"] == 2)["n_quotes"] == 3000


def test_no_messages(spark):
    assert link(spark, []) == []


def test_trimmed_quotes_of_several_lines(spark):
    said = "Hello\nalpha one\nbeta two\ngamma three\nBye"
    rows = [(1, 0, "a", said), (1, 1, "b", "other"), (1, 2, "c", "> alpha one\n> beta two\nmy answer"), (1, 3, "c", "> Alpha one\n>\n> gamma  three\nskipped a line"), (1, 4, "d", "> alpha one\n> delta four\nnobody said that"), (2, 0, "e", "> beta two\n> gamma three\nelsewhere")]
    got = {(r["conv_id"], r["turn"]): r for r in op2_quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    linked = {k: (r["n_linked"], r["linked_conv_id"], r["linked_turn"], r["parent_turn"]) for k, r in got.items()}
    assert linked == {(1, 0): (0, None, None, None), (1, 1): (0, None, None, 0), (1, 2): (1, 1, 0, 0), (1, 3): (1, 1, 0, 0), (1, 4): (0, None, None, 3), (2, 0): (1, 1, 0, None)}


def brute_link(rows):
    """Links, parents, depths and places of (conv, turn, role, text) rows, one at a time."""
    norm = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    some = lambda ts: {norm(t) for t in ts} - {""}
    cue = re.compile(r"^\s*.{0,400}\b(?:wrote|writes)\s*:\s*$", re.I)
    seen = []
    for conv, turn, role, text in rows:
        ls = brute_levels(text or "")
        ls = [(lv, x) for i, (lv, x) in enumerate(ls) if not (i + 1 < len(ls) and ls[i + 1][0] > lv and cue.match(x))]
        ps = []
        for lv, x in ls:
            if ps and ps[-1][0] == lv:
                ps[-1][1].append(x)
            else:
                ps.append((lv, [x]))
        own = ["\n".join(x) for lv, x in ps if lv == 0]
        units = some(own) | some(x for lv, x in ls if lv == 0) | {s for t in own for s in some(re.split(r"(?<=[.!?])\s", norm(t)))}
        quotes = {}
        for lv, x in ps:
            t = norm("\n".join(x))
            if lv and t:
                quotes[t] = [{t}, some(x), some(re.split(r"(?<=[.!?])\s", t))]
        seen.append((conv, turn, units, quotes))
    out = {}
    for conv in {c for c, *_ in seen}:
        turns = sorted({t for c, t, *_ in seen if c == conv})
        parent = {t: turns[i - 1] if i else None for i, t in enumerate(turns)}
        info = {}
        for turn in turns:
            asked = {}
            for c, t, _, q in seen:
                if (c, t) == (conv, turn):
                    asked |= q
            near, far, n = [], [], 0
            for ways in asked.values():
                holds = sorted({(c, t) for c, t, u, _ in seen if any(d and d <= u for d in ways)})
                a = [t for c, t in holds if c == conv and t < turn]
                b = [h for h in holds if h[0] != conv]
                n += bool(a or b)
                if a:
                    near.append(min(a))
                elif b:
                    far.append(min(b))
            if near:
                parent[turn] = max(near)
            info[turn] = (n, conv if near else min(far)[0] if far else None, max(near) if near else min(far)[1] if far else None)
        place, order = 0, [turns[0]]
        while order:
            t = order.pop()
            depth, up = 0, t
            while parent[up] is not None:
                up, depth = parent[up], depth + 1
            copies = sum((c, x) == (conv, t) for c, x, *_ in seen)
            for k in range(copies):
                out.setdefault((conv, t), []).append((*info[t], parent[t], up, depth, place + k))
            place += copies
            order += sorted((x for x in turns if parent[x] == t), reverse=True)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_threads_and_places_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randrange(2, 6))).capitalize() + rng.choice(".!?")
    said, rows = ["Hello there."], []
    for conv in range(12):
        turn = rng.randrange(5)
        for _ in range(rng.randrange(1, 14)):
            own = [rng.choice([sentence(), sentence() + " " + sentence(), "Hello there."]) for _ in range(rng.randrange(1, 4))]
            parts = list(own)
            for _ in range(rng.randrange(0, 3)):
                src = rng.choice(said).split("\n")
                k = rng.randrange(len(src))
                cut = src[k: k + rng.randrange(1, 4)]
                if rng.random() < 0.3:
                    cut = [rng.choice(re.split(r"(?<=[.!?])\s", " ".join(cut)))]
                if rng.random() < 0.3:  # wrapped anew
                    w = " ".join(cut).split()
                    cut = [" ".join(w[: len(w) // 2 + 1]), " ".join(w[len(w) // 2 + 1:])]
                parts.insert(rng.randrange(len(parts) + 1), "\n".join(("> " if rng.random() < 0.8 else ">> ") + x for x in cut))
                if rng.random() < 0.2:
                    parts.insert(0, "Bob wrote:")
            said.append("\n".join(own))
            rows.append((conv, turn, "user", rng.choice(["\n", "\r\n"]).join(p.replace("\n", "\n") for p in parts)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
            turn += rng.choice([1, 1, 2, 10])
    want = brute_link(rows)
    assert sum(x[0][0] for x in want.values()) > 20
    got = {}
    for r in op2_quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["n_linked"], r["linked_conv_id"], r["linked_turn"], r["parent_turn"], r["thread_turn"], r["depth"], r["place"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_original_of_another_conversation_behind_a_later_own_one(spark):
    rows = [(1, 0, "a", "> the passage\nme"), (1, 5, "a", "the passage"), (2, 0, "b", "the passage"), (3, 0, "b", "the passage")]
    got = {(r["conv_id"], r["turn"]): r for r in link(spark, rows)}
    assert (got[1, 0]["n_linked"], got[1, 0]["linked_conv_id"], got[1, 0]["linked_turn"]) == (1, 2, 0)


def test_gapped_turns_are_one_thread(spark):
    got = link(spark, [(1, t, "a", f"m{t}") for t in (10, 20, 30)])
    assert [(r["turn"], r["parent_turn"], r["thread_turn"], r["depth"], r["place"]) for r in got] == [(10, None, 10, 0, 0), (20, 10, 10, 1, 1), (30, 20, 10, 2, 2)]


def test_hot_line_and_many_copies_of_a_turn(spark):
    rows = [(c, 0, "a", "Hello everyone.") for c in range(400)] + [(c, 1, "b", "> Hello everyone.\nyes") for c in range(400)] + [(7, 3, "c", "same")] * 300
    got = {(r["conv_id"], r["turn"], r["place"]): r for r in link(spark, rows)}
    assert len(got) == len(rows) and sorted(p for c, t, p in got if (c, t) == (7, 3)) == list(range(2, 302))
    assert all(got[c, 1, 1]["linked_conv_id"] == c and got[c, 1, 1]["linked_turn"] == 0 for c in range(400))
