"""Quotation linking, native: nested quotes, their originals, reply order.

1. A message's lines get the number of `>` signs before them; runs of lines of
   one level are passages. Level 0 is the message's own text, and an attribution
   line ("... wrote:") before a deeper passage belongs to the quotation.
2. Passages are normalised (lower case, white space collapsed, outer marks cut)
   and hashed. A message's units are its own passages, lines and sentences. A message
   holds a quoted passage if the passage, or each of its lines, or each of its
   sentences, is one of the message's units: so trimmed quotes, runs of lines and
   re-wrapped sentences find their original. Messages of equal units are one class,
   and a passage of several units is sought by the one that fewest classes have.
3. A quoted passage links to the first earlier message of its conversation that
   holds it, else to the first of another conversation. A message answers the
   latest linked message of its conversation, else the turn before it, gaps or not.
4. Replies form a tree for each conversation. Its preorder (a message, then its
   replies by turn, each with all of its own replies) is the conversation's order.
   Depths and places come from pointer doubling; siblings and turns are numbered
   over ranges that split a conversation, so one of any length is in no single task.

Joins whose keys may be hot meet the hot keys, of which there are few by their
counts, in a broadcast (`spread_join`).

Result: a row per message with conv_id, turn, role, body (own text without
quotes), n_quotes, n_linked (different quoted passages that are linked), quote_depth,
parent_turn, linked_conv_id, linked_turn, thread_turn, depth and place (0 is first).
Null text is empty. Rows with a null conv_id or turn stand alone at place 0. Repeated
rows each get a row and a place; a reply goes to the turn, not to one of its copies.
Several originals tie by the least conv_id, then turn. A message without lines has an
empty body. An empty table gives an empty result. Further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ranked, spread_join, table
from .native import let

#: Parts into which the messages of one class are dealt.
SALT = 16
ATTRIBUTION = r"(?i)^\s*.{0,400}\b(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s ]+", " "))


def lines(text: Column) -> Column:
    """array<struct<level, line>> of a text."""

    def one(x: Column) -> Column:
        head = F.regexp_extract(x, r"^(?:[ \t]*+>)*+", 0)
        level = F.length(F.regexp_replace(head, "[^>]", ""))
        return F.struct(level.alias("level"), F.regexp_replace(F.substring(x, F.length(head) + 1, F.length(x)), r"^ ", "").alias("line"))

    raw = F.transform(F.split(text, r"\r\n|\n|\r", -1), one)

    def attribute(ls: Column) -> Column:
        def fix(x: Column, i: Column) -> Column:
            after = F.when(i + 1 < F.size(ls), F.get(ls, i + 1)["level"]).otherwise(F.lit(0))
            cue = (after > x["level"]) & x["line"].rlike(ATTRIBUTION)
            return F.struct(F.when(cue, F.lit(-1)).otherwise(x["level"]).alias("level"), x["line"].alias("line"))

        return F.transform(ls, fix)

    return F.filter(let(raw, attribute), lambda x: x["level"] >= 0)


def passages(ls: Column) -> Column:
    """array<struct<level, text>>: runs of lines of one level, in order."""

    def runs(z: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(z) - 1), lambda i: (i == 0) | (F.get(z, i)["level"] != F.get(z, i - 1)["level"]))

        def cut_at(s: Column) -> Column:
            def one(a: Column, k: Column) -> Column:
                end = F.coalesce(F.get(s, k + 1), F.size(z))
                return F.struct(F.get(z, a)["level"].alias("level"), F.array_join(F.transform(F.slice(z, a + 1, end - a), lambda x: x["line"]), "\n").alias("text"))

            return F.transform(s, one)

        return let(starts, cut_at)

    return F.when(F.size(ls) > 0, let(ls, runs)).otherwise(F.array().cast("array<struct<level:int,text:string>>"))


def parsed(df: DataFrame) -> DataFrame:
    """df's conv_id, turn, role with lines and passages of the text."""
    own = df.select("conv_id", "turn", "role", lines(F.coalesce("text", F.lit(""))).alias("ls"))
    return own.select("conv_id", "turn", "role", "ls", passages(F.col("ls")).alias("ps"))


def sentences(t: Column) -> Column:
    """Sentences of a normalised text."""
    return F.split(t, r"(?<=[.!?])\s", -1)


def hashed(texts: Column) -> Column:
    """Sorted hashes of the texts that are not empty when normalised."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.transform(texts, normal), lambda t: t != ""), lambda t: F.md5(t))))


def follow(start: DataFrame) -> DataFrame:
    """(conv_id, turn, end, total) of rows (conv_id, turn, to, w, done): where the
    pointers end, and the sum of weights on the way. A round doubles how far a row
    sees; rows that see the end are done and leave the rounds."""
    first = cut(start, "pointers")
    settled, active = first.where("done"), first.where("not done")
    while active.take(1):
        over = settled.unionByName(active).select("conv_id", F.col("turn").alias("to"), F.col("to").alias("to2"), F.col("w").alias("w2"), F.col("done").alias("done2"))
        new = spread_join(active.select("conv_id", "turn", "to", "w"), over, ["conv_id", "to"])
        new = cut(new.select("conv_id", "turn", F.col("to2").alias("to"), (F.col("w") + F.col("w2")).alias("w"), F.col("done2").alias("done")), "pointers")
        settled, active = settled.unionByName(new.where("done")), new.where("not done")
    return settled.select("conv_id", "turn", F.col("to").alias("end"), F.col("w").alias("total"))


def originals(good: DataFrame) -> DataFrame | None:
    """(conv_id, turn, answers, far, n_linked) of the messages that quote."""
    asked = good.where("size(quotes) > 0").select("conv_id", "turn", F.explode("quotes").alias("q"))
    ways = F.array_distinct(F.filter(F.array(F.array("q.h"), F.col("q.lines"), F.col("q.sentences")), lambda d: F.size(d) > 0))
    asked = asked.select("conv_id", "turn", F.col("q.h").alias("h"), F.explode(ways).alias("d")).withColumn("did", F.md5(F.array_join("d", ",")))
    asked = cut(asked.dropDuplicates(["conv_id", "turn", "h", "did"]), "asked")
    if not asked.take(1):
        return None
    want = cut(asked.select("did", "d").dropDuplicates(["did"]), "wanted")
    classes = cut(good.groupBy("class").agg(F.first("units").alias("units")), "classes")
    at = cut(good.groupBy("class", "conv_id").agg(F.min("turn").alias("turn")), "places")

    # which classes have which of the units asked for
    held = cut(classes.select("class", F.explode("units").alias("u")), "units")
    said = cut(spread_join(held, want.select(F.explode("d").alias("u")).distinct(), ["u"]), "said")
    single = want.where("size(d) = 1").select("did", F.col("d")[0].alias("u"))
    holds = spread_join(said, single, ["u"]).select("did", "class")
    several = cut(want.where("size(d) > 1").select("did", F.explode("d").alias("u")), "several")
    if several.take(1):
        often = spread_join(several, said.groupBy("u").agg(F.count(F.lit(1)).alias("n")), ["u"])
        rarest = often.groupBy("did").agg(F.min(F.struct("n", "u")).alias("least"), F.count(F.lit(1)).alias("found"))
        rarest = rarest.join(want, "did").where("found = size(d)").select("did", "d", F.col("least.u").alias("u"))
        maybe = said.join(rarest, "u").join(classes, "class")
        holds = holds.unionByName(maybe.where(F.size(F.array_except("d", "units")) == 0).select("did", "class"))
    # a class that very many conversations have is dealt over SALT tasks
    salted = at.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALT)).cast("int"))
    holds = holds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    found = cut(holds.join(salted, ["class", "salt"]).groupBy("did", "conv_id").agg(F.min("turn").alias("turn")), "found")

    least = cut(found.groupBy("did").agg(F.min(F.struct("conv_id", "turn")).alias("one")), "least")
    # the first of another conversation than the first
    two = spread_join(found, least, ["did"]).where(F.col("conv_id") != F.col("one.conv_id")).groupBy("did").agg(F.min(F.struct("conv_id", "turn")).alias("two"))
    first = cut(least.join(two, "did", "left"), "least")
    near = asked.select("conv_id", "turn", "h", "did").join(found.withColumnRenamed("turn", "near"), ["did", "conv_id"], "left")
    hit = spread_join(cut(near, "near"), first, ["did"], "left")
    far = F.when(F.col("one.conv_id") != F.col("conv_id"), F.col("one")).otherwise(F.col("two"))
    hit = hit.select("conv_id", "turn", "h", F.when(F.col("near") < F.col("turn"), F.col("near")).alias("near"), far.alias("far"))
    one = hit.groupBy("conv_id", "turn", "h").agg(F.min("near").alias("near"), F.min("far").alias("far")).where("near is not null or far is not null")
    return one.groupBy("conv_id", "turn").agg(F.max("near").alias("answers"), F.min(F.when(F.col("near").isNull(), F.col("far"))).alias("far"), F.count(F.lit(1)).alias("n_linked"))


def reply_order(nodes: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth, first) of nodes (conv_id, turn, n,
    parent_turn), one for each turn of n copies; first counts the rows before it."""
    up = follow(nodes.select("conv_id", "turn", F.coalesce("parent_turn", "turn").alias("to"), F.col("parent_turn").isNotNull().cast("long").alias("w"), F.col("parent_turn").isNull().alias("done")))
    kids = ranked(nodes.where("parent_turn is not null").select("conv_id", "parent_turn", "turn"), ["conv_id", "parent_turn"], ["turn"], "r")
    kids = cut(kids, "siblings")
    after = kids.select("conv_id", "parent_turn", (F.col("r") - 1).alias("r"), F.col("turn").alias("sibling"))
    kin = cut(kids.join(after, ["conv_id", "parent_turn", "r"], "left").select("conv_id", "turn", "parent_turn", "sibling"), "siblings")
    # the nearest message at or above one that has a later sibling
    roots = nodes.where("parent_turn is null").select("conv_id", "turn", F.lit(None).cast("long").alias("parent_turn"), F.lit(None).cast("long").alias("sibling"))
    every = kin.unionByName(roots)
    stays = F.col("sibling").isNotNull() | F.col("parent_turn").isNull()
    climb = follow(every.select("conv_id", "turn", F.when(stays, F.col("turn")).otherwise(F.col("parent_turn")).alias("to"), F.lit(0).cast("long").alias("w"), stays.alias("done")))
    onward = climb.join(every.select("conv_id", F.col("turn").alias("end"), "sibling"), ["conv_id", "end"]).select("conv_id", "turn", "sibling")
    child = kids.where("r = 1").select("conv_id", F.col("parent_turn").alias("turn"), F.col("turn").alias("child"))
    succ = onward.join(child, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("child", "sibling").alias("next")).where("next is not null")
    before = succ.join(nodes.select("conv_id", "turn", "n"), ["conv_id", "turn"]).select("conv_id", F.col("next").alias("turn"), F.col("turn").alias("to"), F.col("n").alias("w"))
    line = nodes.select("conv_id", "turn").join(before, ["conv_id", "turn"], "left")
    place = follow(line.select("conv_id", "turn", F.coalesce("to", "turn").alias("to"), F.coalesce("w", F.lit(0)).alias("w"), F.col("to").isNull().alias("done")))
    return up.select("conv_id", "turn", F.col("end").alias("thread_turn"), F.col("total").alias("depth")).join(place.select("conv_id", "turn", F.col("total").alias("first")), ["conv_id", "turn"])


def link(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message of df, as the module says."""
    src = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = parsed(src)
    own = F.filter("ps", lambda p: p["level"] == 0)
    body = F.trim(F.array_join(F.transform(own, lambda p: p["text"]), "\n"))
    quoted = F.filter(F.transform(F.filter("ps", lambda p: p["level"] > 0), lambda p: F.struct(p["level"].alias("level"), normal(p["text"]).alias("t"), F.split(p["text"], "\n", -1).alias("ls"))), lambda p: p["t"] != "")
    quotes = F.transform(quoted, lambda p: F.struct(p["level"].alias("level"), F.md5(p["t"]).alias("h"), hashed(p["ls"]).alias("lines"), hashed(sentences(p["t"])).alias("sentences")))
    units = hashed(F.concat(F.transform(own, lambda p: p["text"]), F.transform(F.filter("ls", lambda x: x["level"] == 0), lambda x: x["line"]), F.flatten(F.transform(own, lambda p: sentences(normal(p["text"]))))))
    msg = cut(rows.select("conv_id", "turn", "role", body.alias("body"), quotes.alias("quotes"), units.alias("units"), F.md5(F.array_join(units, ",")).alias("class")), "messages")

    good = msg.where("conv_id is not null and turn is not null")
    turns = cut(good.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")), "turns")
    counted = ranked(turns, ["conv_id"], ["turn"], "r")
    counted = cut(counted, "turns")
    prev = counted.select("conv_id", (F.col("r") + 1).alias("r"), F.col("turn").alias("before"))
    parents = counted.join(prev, ["conv_id", "r"], "left").drop("r")
    linked = originals(good)
    if linked is None:
        parents = parents.withColumns({"answers": F.lit(None).cast("long"), "far": F.lit(None).cast("struct<conv_id:long,turn:long>"), "n_linked": F.lit(0).cast("long")})
    else:
        parents = parents.join(linked, ["conv_id", "turn"], "left")
    parents = cut(parents.select("conv_id", "turn", "n", F.coalesce("answers", "before").alias("parent_turn"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.when(F.col("answers").isNotNull(), F.col("conv_id")).otherwise(F.col("far.conv_id")).alias("linked_conv_id"), F.coalesce("answers", F.col("far.turn")).alias("linked_turn")), "parents")
    told = cut(parents.join(reply_order(parents), ["conv_id", "turn"]), "told")

    shown = msg.select("conv_id", "turn", "role", "body", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).cast("long").alias("quote_depth"))
    one = spread_join(shown.where("conv_id is not null and turn is not null"), told.where("n = 1"), ["conv_id", "turn"])
    # copies of a turn are numbered; they come in the order of role and text
    more = spread_join(shown.where("conv_id is not null and turn is not null"), told.where("n > 1"), ["conv_id", "turn"])
    more = ranked(more, ["conv_id", "turn"], ["role", "body"], "r").withColumn("place", F.col("first") + F.col("r") - 1)
    long = F.lit(None).cast("long")
    alone = shown.where("conv_id is null or turn is null").select("*", long.alias("parent_turn"), F.lit(0).cast("long").alias("n_linked"), long.alias("linked_conv_id"), long.alias("linked_turn"), long.alias("thread_turn"), long.alias("depth"), F.lit(0).cast("long").alias("place"))
    names = ["conv_id", "turn", "role", "body", "n_quotes", "n_linked", "quote_depth", "parent_turn", "linked_conv_id", "linked_turn", "thread_turn", "depth", "place"]
    return one.withColumn("place", F.col("first")).select(*names).unionByName(more.select(*names)).unionByName(alone.select(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))
