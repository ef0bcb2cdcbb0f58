"""Quotation linking: quote levels, passages, originals, and conversations without quotes.

Native DataFrame operations only. A line's quote level is the number of ``>``
marks in its head (``> > text`` is level 2). Runs of lines of one level above
0 are quoted passages; a head line such as ``On ... wrote:`` right before a
passage belongs to the quotation. Passages and the lines of messages are
normalised (letters and digits of any script, lower case, single spaces). A
message said a passage if a run of its whole lines of any length has the same
text, however the quote is broken into lines; a passage is joined to the
message that said it first: in the same conversation before the quoting turn,
else in the first other conversation of the table. The message a turn answers is the original of its shallowest linked
passage, else the turn before; following these answers gives the reply order.

Only runs that begin like a passage and are as long as one are hashed. Hashes of
what was said are reduced to one row for each conversation, and to two for the
table, before they meet the passages; joins are equi-joins that Spark may split
where a key is hot.

Defined results: null text is empty; a null conv_id or turn is a key of its
own and its message is linked with nothing; rows that repeat a (conv_id, turn)
keep their own rows; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shortest normalised passage that is looked up.
MIN_CHARS = 1
#: Characters by which the lines that begin a passage are found.
PREFIX = 12
#: Turns of one stretch of a conversation.
CHUNK = 1024
_BREAK = "\r\n|\r|\n"
_MARKS = r"^[ \t]*((?:>[ \t]?)+)"
_ATTRIBUTION = r"(?i)^[ \t]*(on|am|el|le)\b.{0,200}\b(wrote|schrieb|escribió|a écrit)[ \t]*:[ \t]*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    """Array of (level, body, is attribution) of the text's lines."""

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 1)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        return F.struct(level.alias("level"), F.when(level > 0, F.substring(line, F.length(F.regexp_extract(line, _MARKS, 0)) + 1, F.length(line))).otherwise(line).alias("body"), line.rlike(_ATTRIBUTION).alias("head"))

    return F.transform(F.split(text, _BREAK), one)


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, body (without quotes), passages (array of level, text), max_level."""
    text = F.coalesce("text", F.lit(""))
    rows = messages.select("conv_id", "turn", "role", text.alias("text"))
    plain = ~F.col("text").contains(">")
    lines = rows.withColumn("lines", F.when(~plain, _lines(F.col("text"))))
    level = lambda i: F.when((i >= 0) & (i < F.size("lines")), F.col("lines")[i]["level"]).otherwise(F.lit(0))
    kept = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(x["head"] & (level(i + 1) > 0)))
    begins = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (level(i) > 0) & (level(i) != level(i - 1)))

    def passage(i: Column) -> Column:
        after = F.filter(F.sequence(i, F.size("lines") - 1), lambda j: level(j) != level(i))
        stop = F.when(F.size(after) > 0, F.element_at(after, 1)).otherwise(F.size("lines"))
        return F.struct(level(i).alias("level"), F.array_join(F.transform(F.slice("lines", i + 1, stop - i), lambda x: x["body"]), "\n").alias("text"))

    none = F.expr("cast(array() as array<struct<level: int, text: string>>)")
    out = lines.withColumn("body", F.when(plain, F.col("text")).otherwise(F.trim(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"))))
    out = out.withColumn("passages", F.when(plain, none).otherwise(F.transform(begins, passage)))
    return out.select("conv_id", "turn", "role", "text", "body", "passages", F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).alias("max_level"))


def said(messages: DataFrame, passages: DataFrame) -> DataFrame:
    """(hash, conv_id, turn): the first turn of each conversation that says each of the ``passages`` (norm) in whole lines."""
    wanted = passages.groupBy(F.substring("norm", 1, PREFIX).alias("key")).agg(F.collect_set(F.length("norm")).alias("sizes"))
    lines = F.filter(F.transform(F.split("body", _BREAK), normalised), lambda x: x != "")
    own = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", lines.alias("lines")).withColumn("row", F.xxhash64("lines"))
    run = lambda i, n: F.substring(F.array_join(F.slice("lines", i + 1, n), "\n"), F.lit(1), n)
    ends = lambda text, n: F.substring(text, n + 1, F.lit(1)).isin("\n", "")

    def keys(_: Column, i: Column) -> Column:
        head = run(i, F.lit(PREFIX))
        short = F.filter(F.sequence(F.lit(1), F.lit(PREFIX - 1)), lambda n: (F.length(head) >= n) & ends(head, n))
        whole = F.when(F.length(head) == PREFIX, F.array(head)).otherwise(F.array().cast("array<string>"))
        return F.transform(F.array_distinct(F.concat(whole, F.transform(short, lambda n: F.substring(head, F.lit(1), n)))), lambda k: F.translate(k, "\n", " "))

    begins = own.select("conv_id", "turn", "row", F.posexplode(F.transform("lines", keys)).alias("i", "keys")).select("conv_id", "turn", "row", "i", F.explode("keys").alias("key"))
    tried = begins.join(wanted, "key").select("conv_id", "turn", "row", "i", F.explode("sizes").alias("size"))
    runs = tried.join(own, ["conv_id", "turn", "row"]).withColumn("text", run(F.col("i"), F.col("size") + 1))
    found = runs.where((F.length("text") >= F.col("size")) & ends(F.col("text"), F.col("size")))
    each = found.select("conv_id", "turn", F.xxhash64(F.translate(F.substring("text", F.lit(1), F.col("size")), "\n", " ")).alias("hash"))
    return each.groupBy("hash", "conv_id").agg(F.min("turn").alias("turn"))


def link_quotes(conversations: DataFrame) -> DataFrame:
    """One row per quoted passage of at least MIN_CHARS: conv_id, turn, level, position, quoted, source_conv, source_turn."""
    messages = parsed(conversations)
    quoted = messages.where("size(passages) > 0").select("conv_id", "turn", F.posexplode("passages").alias("position", "p"))
    quoted = quoted.select("conv_id", "turn", "position", F.col("p.level").alias("level"), F.col("p.text").alias("quoted"), normalised(F.col("p.text")).alias("norm"))
    quoted = quoted.where(F.length("norm") >= MIN_CHARS)
    first = said(messages, quoted)
    quoted = quoted.withColumn("hash", F.xxhash64("norm")).drop("norm")
    near = first.select("hash", "conv_id", F.col("turn").alias("near_turn"))
    two = first.withColumn("r", F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))).where("r <= 2")
    far = two.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("far"), F.max(F.struct("conv_id", "turn")).alias("next"))
    linked = quoted.join(near, ["hash", "conv_id"], "left").join(far, "hash", "left")
    inside = F.col("near_turn") < F.col("turn")
    outside = F.when(F.col("far.conv_id") != F.col("conv_id"), F.col("far")).when(F.col("next.conv_id") != F.col("conv_id"), F.col("next"))
    return linked.withColumn("outside", outside).select(
        "conv_id", "turn", "position", "level", "quoted",
        F.when(inside, F.col("conv_id")).otherwise(F.col("outside.conv_id")).alias("source_conv"),
        F.when(inside, F.col("near_turn")).otherwise(F.col("outside.turn")).alias("source_turn"),
    )


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quotes, max_level, n_linked, reply_to, place for every message.

    ``reply_to``: the turn of the conversation that the message answers (null for the first).
    ``place``: its number in the conversation, ordered by what it answers, then by turn, role and text
    (null without a conv_id or turn).
    """
    messages = parsed(conversations)
    links = link_quotes(conversations)
    here = F.col("source_turn").isNotNull() & (F.col("source_conv") == F.col("conv_id"))
    per = links.groupBy("conv_id", "turn").agg(F.count("source_turn").alias("n_linked"), F.min_by("source_turn", F.when(here, F.struct("level", "position"))).alias("quoted_turn"))
    before = _before(messages.select("conv_id", "turn").where("conv_id is not null and turn is not null").distinct())
    out = messages.join(per, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
    out = out.select(
        "conv_id", "turn", "role", "text", "body", F.size("passages").alias("n_quotes"), "max_level",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("quoted_turn", "before").alias("reply_to"),
    )
    # numbers within stretches of CHUNK keys, plus the rows of the stretches before: no window spans a conversation
    key = F.coalesce("reply_to", "turn")
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    out = out.withColumn("known", known).withColumn("chunk", F.when(known, F.floor(key / CHUNK)).otherwise(F.pmod(F.xxhash64("text", "role"), F.lit(CHUNK))))
    inside = F.row_number().over(Window.partitionBy("conv_id", "known", "chunk").orderBy(key, "turn", "role", "text"))
    counts = out.where("known").groupBy("conv_id", "chunk").agg(F.count("*").alias("rows"))
    earlier = counts.select("conv_id", "chunk", F.lit(True).alias("known"), (F.sum("rows").over(Window.partitionBy("conv_id").orderBy("chunk")) - F.col("rows")).alias("earlier"))
    placed = out.withColumn("inside", inside).join(earlier, ["conv_id", "chunk", "known"], "left")
    return placed.select("conv_id", "turn", "role", "body", "n_quotes", "max_level", "n_linked", "reply_to", F.when(F.col("known"), F.col("inside") + F.col("earlier")).alias("place"))


def _before(turns: DataFrame) -> DataFrame:
    """conv_id, turn, before: the conversation's turn before each one."""
    chunked = turns.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    ends = chunked.groupBy("conv_id", "chunk").agg(F.max("turn").alias("end"))
    ends = ends.select("conv_id", "chunk", F.lag("end").over(Window.partitionBy("conv_id").orderBy("chunk")).alias("end_before"))
    near = chunked.withColumn("near", F.lag("turn").over(Window.partitionBy("conv_id", "chunk").orderBy("turn")))
    return near.join(ends, ["conv_id", "chunk"]).select("conv_id", "turn", F.coalesce("near", "end_before").alias("before"))


def op2(spark, sf_dir: str) -> DataFrame:
    from lexatlas.runtime import table

    found = reply_ordered(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "role", F.sha2("body", 256).alias("body_sha256"), "n_quotes", "max_level", "n_linked", "reply_to", "place")
