"""Chat formatting by quotation linking.

A line's quote level is its number of leading ``>`` marks (each may be followed by one
space).  A passage is a run of lines of one level that no blank line breaks; it is normalised
as one text (case, white space, so line breaks do not matter) and hashed.  A quoted passage
comes from the earliest earlier message of its thread that says it; if there is none, from the
earliest such message of all threads, if it has ``FAR_WORDS`` words or more.  Passages found
nowhere, such as those cut short, are looked up line by line in their thread.  The message that
gave most characters of the level-1 passages (ties: the earliest) is the one replied to; if
nothing of them is found, or nothing is quoted, the message starts a conversation of its own.
Parent links are then doubled until every message knows its first ancestor and its depth, which
order the conversation without its quotes.

Every step is an equi-join on a unique key or a combined minimum, so neither a very common
passage nor a very long thread meets in one task.  A very long message is one row throughout.

Null or empty text: empty clean text, no quotes.  Passages without a letter or digit are never
linked.  Rows with a null thread or number are each kept; they are sources of nothing.
Rows equal in thread, number and text count as one; other messages of one number are kept, and the
source among them is the one of the least text hash.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, tidy

_MARKS = r"^((?:> ?)*)"
FAR_WORDS = 5


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), " ", ""))


def normalised(passage: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(passage), r"\s+", " "))


def passages(text: Column, at: Column) -> Column:
    """Normalised passages of level ``at`` with their normalised lines."""
    line = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.when(level(x) == at, F.regexp_replace(F.regexp_replace(x, _MARKS, ""), r"^\s+$", "")).otherwise(""))
    said = lambda a: F.filter(F.transform(a, normalised), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    p = F.transform(F.split(F.array_join(line, "\n"), "\n{2,}"), lambda x: F.struct(normalised(x).alias("body"), said(F.split(x, "\n")).alias("lines")))
    return F.filter(p, lambda x: x["body"].rlike(r"[\p{L}\p{N}]"))


def clean(text: Column) -> Column:
    """The text without quoted lines and the blank lines that end or start it."""
    own = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: level(x) == 0)
    return F.regexp_replace(F.array_join(own, "\n"), r"^\n+|\n+$", "")


def as_mail(messages: DataFrame, thread: str = "conv_id", number: str = "turn") -> DataFrame:
    """Messages as mail programs write them: each quotes the one before it (of several, the least text), with its quotes."""
    quote = lambda c: F.regexp_replace(c, r"(?m)^", "> ")
    m = messages.select(thread, number, "text")
    ago = lambda k: m.groupBy(thread, (F.col(number) + k).alias(number)).agg(F.min("text").alias(f"t{k}"))
    j = m.join(ago(1), [thread, number], "left").join(ago(2), [thread, number], "left")
    deep = F.when(F.col("t2").isNotNull(), F.concat(quote(quote(F.col("t2"))), F.lit("\n"))).otherwise(F.lit(""))
    return j.select(thread, number, F.when(F.col("t1").isNull(), F.col("text")).otherwise(F.concat(deep, quote(F.col("t1")), F.lit("\n\n"), F.coalesce("text", F.lit("")))).alias("text"))


@tidy
def link(messages: DataFrame, thread: str = "conv_id", number: str = "turn") -> DataFrame:
    """``conv_id, turn, text`` (without quotes), ``n_quoted, n_linked`` (passages), ``max_level, reply_conv, reply_turn, root_conv, root_turn, depth``."""
    m = messages.select(F.col(thread).cast("long").alias("conv_id"), F.col(number).cast("long").alias("turn"), "text")
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    m = m.where(named).distinct().unionByName(m.where(~named))
    m = settle(m.withColumn("id", F.monotonically_increasing_id()))
    levels = F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), level))
    p = m.select("id", "conv_id", "turn", "text", F.explode(levels).alias("level"))
    p = p.select("id", "conv_id", "turn", F.xxhash64("text").alias("tie"), "level", F.explode(passages(F.col("text"), F.col("level"))).alias("p"))
    key = lambda x: F.struct(F.xxhash64(x).alias("h1"), F.crc32(x.cast("binary")).alias("h2"), F.length(x).alias("chars"))
    p = p.select("id", "conv_id", "turn", "tie", "level", key(F.col("p.body")).alias("k"), F.size(F.split("p.body", " ")).alias("words"), F.transform("p.lines", key).alias("lines"))
    p = settle(p.select("id", "conv_id", "turn", "tie", "level", "k.*", "words", "lines"))
    same = ["id", "conv_id", "turn", "level", "h1", "h2"]
    quoted = p.where("level > 0").groupBy(*same).agg(F.sum("chars").alias("chars"), F.count("*").alias("n"), F.max("words").alias("words"), F.min("lines").alias("lines"))
    own = p.where("level = 0 and conv_id is not null and turn is not null")
    first = F.min(F.struct("turn", "tie", "id"))
    near = own.groupBy("conv_id", "h1", "h2").agg(first.alias("near"))
    far = own.where(F.col("words") >= FAR_WORDS).groupBy("h1", "h2").agg(F.min(F.struct("conv_id", "turn", "tie", "id")).alias("far"))
    earlier = F.when(F.col("near.turn") < F.col("turn"), F.struct("conv_id", "near.turn", "near.tie", "near.id"))
    found = settle(quoted.join(near, ["conv_id", "h1", "h2"], "left").withColumn("src", earlier).drop("near"))
    lost = found.where("src is null").join(far, ["h1", "h2"], "left")
    before = F.struct("far.conv_id", "far.turn") < F.struct("conv_id", "turn")
    lost = settle(lost.withColumn("src", F.when(before, F.col("far"))).drop("far"))
    by_line = own.select("conv_id", "turn", "tie", "id", F.explode("lines").alias("l")).groupBy("conv_id", "l.h1", "l.h2").agg(first.alias("near"))
    lines = lost.where("src is null").select("id", "conv_id", "turn", "level", F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.explode("lines").alias("l")).select("*", "l.*")
    lines = settle(lines.join(by_line, ["conv_id", "h1", "h2"]).withColumn("src", earlier).where("src is not null").select("id", "level", "p1", "p2", "chars", "src"))
    whole = found.where("src is not null").unionByName(lost.where("src is not null")).select("id", "level", "n", "chars", "src")
    partly = lost.where("src is null").join(lines.select("id", "level", F.col("p1").alias("h1"), F.col("p2").alias("h2")).distinct(), ["id", "level", "h1", "h2"], "left_semi")
    linked = whole.select("id", "n").unionByName(partly.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n_linked"))
    counts = quoted.groupBy("id").agg(F.sum("n").alias("n_quoted"), F.max("level").alias("max_level")).join(linked, "id", "left")
    votes = whole.where("level = 1").select("id", "src", "chars").unionByName(lines.where("level = 1").select("id", "src", "chars"))
    votes = votes.groupBy("id", "src").agg(F.sum("chars").alias("chars"))
    parent = votes.groupBy("id").agg(F.min(F.struct((-F.col("chars")).alias("c"), F.col("src"))).alias("v")).select("id", F.col("v.src.id").alias("parent"))
    parent = settle(parent.where("id <> parent"))
    jump = settle(m.select("id").join(parent, "id", "left").select("id", F.coalesce("parent", "id").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while True:  # depth doubles in each round; links go to earlier messages, so there are no rings
        step = jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more")), "up")
        step = settle(step.select("id", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        jump = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    name = lambda c, p: m.select(F.col("id").alias(c), F.col("conv_id").alias(f"{p}_conv"), F.col("turn").alias(f"{p}_turn"))
    out = m.join(counts, "id", "left").join(parent, "id", "left").join(jump, "id").join(name("parent", "reply"), "parent", "left").join(name("up", "root"), "up")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", "turn", clean(F.col("text")).alias("text"), zero("n_quoted"), zero("n_linked"), zero("max_level"), "reply_conv", "reply_turn", "root_conv", "root_turn", "depth")
