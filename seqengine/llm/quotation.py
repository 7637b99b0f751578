"""Chat formatting by quotation linking (operator 2), in DataFrame functions.

1. A line's quote level is the number of its leading `>` marks.  A message's own
   text is its lines at level 0; those at level 1 quote the message it answers,
   deeper ones what that message quoted.
2. Own and quoted text are cut into sentences, normalised (lower case, runs of
   other characters than letters and digits become one space) and hashed.
3. The hashes of quoted sentences are joined to the own sentences of earlier
   messages of the same conversation; the message with most of a level's, the
   latest on a tie, is that level's source.  The source of the shallowest level
   that has one is answered; without any the previous message is.
4. Conversations are the messages without quotes in order of turn, in which
   every message follows the one it answers, in parts of `PART` messages.

Positions are found in chunks of `CHUNK` turns and then over chunks, so a
conversation that holds a third of all messages stays spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK, PART = 1024, 64
_LEVEL = "length(replace(regexp_extract(line, '^((?:> ?)*)', 1), ' ', ''))"


def quote_lines(text: str = "text"):
    """A column of the text's lines as structs: level and content without its quote marks."""
    return F.expr(f"transform(split({text}, '\n'), line -> struct({_LEVEL} as level, if({_LEVEL} > 0, regexp_replace(line, '^((?:> ?)*)', ''), line) as content))")


def _sentences(level: int | str) -> str:
    """SQL: the normalised, distinct, non-empty sentences of the lines at a level, a number or a column."""
    joined = f"concat_ws(' ', transform(filter(lines, l -> l.level = {level}), l -> l.content))"
    plain = f"transform(regexp_extract_all({joined}, '[^.!?]+', 0), s -> trim(regexp_replace(lower(s), '[^\\\\p{{L}}\\\\p{{N}}]+', ' ')))"
    return f"array_distinct(filter({plain}, s -> s <> ''))"


def linked_messages(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as conv_id, turn, role, own, quoted, answers, jumps, position, sources.

    `own` is the text without quotes, `quoted` says whether there was a quote
    and `answers` is the turn of the message answered (null for the first);
    `sources` has the level and turn of every quote level with a match, or null.
    Equal rows are one message; messages of one turn are ordered by role and
    text; null text is empty, and null conv_id, turn or role are values of their
    own that sort first.  Other columns are ignored.
    """
    rows = conversations.select(*(F.col(c) for c in ("conv_id", "turn", "role")), F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("lines", quote_lines()).withColumn("at", F.struct("turn", "role", "text"))
    own = F.expr("trim(concat_ws('\n', transform(filter(lines, l -> l.level = 0), l -> l.content)))")
    rows = rows.withColumn("own", own).withColumn("quoted", F.expr("exists(lines, l -> l.level > 0)"))
    chunk = F.expr(f"coalesce(turn, -1) div {CHUNK}")
    rows = rows.withColumn("chunk", chunk)

    inside = W.partitionBy("conv_id", "chunk").orderBy("at")
    over = W.partitionBy("conv_id").orderBy("chunk")
    chunks = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    chunks = chunks.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), (F.sum("n").over(over) - F.col("n")).alias("base"), F.lag("last").over(over).alias("before"))
    placed = rows.withColumn("i", F.row_number().over(inside)).withColumn("lag", F.lag("turn").over(inside))
    placed = placed.join(chunks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
    placed = placed.withColumn("position", F.col("base") + F.col("i") - 1).withColumn("previous", F.when(F.col("i") > 1, F.col("lag")).otherwise(F.col("before")))

    levels = F.expr("array_distinct(transform(filter(lines, l -> l.level > 0), l -> l.level))")
    asks = rows.where("quoted").select("conv_id", "at", "lines", F.explode(levels).alias("depth"))
    asks = asks.select("conv_id", "at", "depth", F.explode(F.expr(_sentences("depth"))).alias("s")).select("conv_id", "at", "depth", F.xxhash64("s").alias("h"), F.md5("s").alias("m"))
    says = rows.select(F.col("conv_id").alias("c"), F.col("turn").alias("source"), F.explode(F.expr(_sentences(0))).alias("s")).select("c", "source", F.xxhash64("s").alias("h2"), F.md5("s").alias("m2"))
    match = asks.join(says.distinct(), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("h2")) & (F.col("m") == F.col("m2")) & (F.col("source") < F.col("at.turn")))
    scores = match.groupBy("conv_id", "at", "depth", "source").agg(F.count_distinct("m").alias("hits"))
    best = scores.groupBy("conv_id", "at", "depth").agg(F.max(F.struct("hits", "source")).alias("b"))
    best = best.groupBy("conv_id", "at").agg(F.array_sort(F.collect_list(F.struct(F.col("depth").alias("level"), F.col("b.source").alias("source")))).alias("sources"))
    best = best.select(F.col("conv_id").alias("c"), F.col("at").alias("q"), "sources", F.col("sources")[0]["source"].alias("source"))
    found = placed.drop("c", "k").join(best, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("q")), "left")
    return found.select("conv_id", "turn", "role", "own", "quoted", F.coalesce("source", "previous").alias("answers"), (F.col("source").isNotNull() & ~F.col("source").eqNullSafe(F.col("previous"))).alias("jumps"), "position", "sources")


def chat_parts(messages: DataFrame) -> DataFrame:
    """Messages of `linked_messages` as chat text: conv_id, part, messages, quoting, chat.

    A message that answers another than the previous one names its turn.
    """
    head = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>"), F.when(F.col("jumps"), F.concat(F.lit("<|answers "), F.col("answers").cast("string"), F.lit("|>"))).otherwise(F.lit("")))
    line = F.concat(head, F.lit("\n"), F.col("own"), F.lit("<|end|>"))
    part = messages.withColumn("part", F.expr(f"position div {PART}")).groupBy("conv_id", "part")
    items = part.agg(F.count("*").alias("messages"), F.count_if("quoted").alias("quoting"), F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("items"))
    return items.select("conv_id", "part", "messages", "quoting", F.array_join(F.transform("items", lambda x: x["line"]), "\n").alias("chat"))
