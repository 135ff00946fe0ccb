r"""Quotation linking: conversations in reply order, without their quotes.

A line's quote level is the number of > before it. Consecutive lines of one level
make a passage. Quoted passages are normalised (quote marks gone, lower case,
white space folded) and hashed, and so are the own passages and lines of all
messages of the conversation; a quote is linked to the earliest message that has
its hash, if that stands before it, else to the one that most of its paragraphs
and lines are linked to. A message replies to the latest message that its outermost quotes are
linked to, and without such a link to the message before it.

Reply order: a message is followed by the message after it, unless that replies
to another; replies to an earlier message come behind all that continues it, and
of the replies to one message the earlier come first. reply_place numbers the messages
of a conversation so, from 0, in an ordered walk over the runs of messages that
continue each other: sizes are summed up the tree and places down it, in steps that
double their reach.

Defined results: a null text is empty and has no quotes; a row without conv_id or
turn keeps its own text and stands alone; of repeated rows (same conv_id and
turn) each is kept, links lead to their turn, and they share a place; turns are any
64-bit numbers; ties between equally often found originals go to the latest; an
empty table gives an empty result. Only
conv_id, turn, role and text are read.

Only DataFrame operations run here. Hashes are matched within a conversation,
after the originals are reduced to one row each with map-side combine. No
window spans a conversation: running values go by blocks of turns, and then
over the blocks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import held, materialise, table

#: Turns of a block, within which running values are found by a window.
BLOCK = 4096
#: Bytes of conversation ids up to which they are broadcast, and what one takes there.
BROADCAST_BYTES, CONV_BYTES = 32 << 20, 48
#: One quote mark: each match begins where the one before ends, so that a line may have any number of marks.
MARK = r"\G(?:^\s*)?>\s?"
#: A line that only introduces a quote.
ATTRIBUTION = r"(?i)^\s*(?:on .{1,200} wrote|.{1,200} wrote|am .{1,200} schrieb.{0,100}|le .{1,200} a écrit|el .{1,200} escribió)\s*:\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x{00A0}>]+", " "))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def parse(messages: DataFrame) -> DataFrame:
    """Adds own_text, quotes (array of level, text) and max_level; one row per message."""
    text = F.coalesce("text", F.lit(""))
    rows = messages.select("*", F.split(text, "\n").alias("_lines"))
    level = F.transform("_lines", lambda l: F.regexp_count(l, F.lit(MARK)))
    body = F.transform("_lines", lambda l: F.regexp_replace(l, MARK, ""))
    rows = rows.select("*", level.alias("_level"), body.alias("_body"))
    # First lines of the passages.
    starts = F.filter(F.sequence(F.lit(0), F.size("_level") - 1), lambda i: (i == 0) | (F.get("_level", i) != F.get("_level", i - 1)))
    rows = rows.select("*", starts.alias("_starts"))

    def passage(s: Column, k: Column) -> Column:
        n = F.coalesce(F.get("_starts", k + 1), F.size("_level")) - s
        return F.struct(F.get("_level", s).alias("level"), F.slice("_body", s + 1, n).alias("lines"))

    rows = rows.select("*", F.transform("_starts", passage).alias("_passages"))
    own = F.filter("_passages", lambda p: p["level"] == 0)
    # An attribution line goes only where a quote follows.
    quoting = F.exists("_level", lambda v: v > 0)
    own_lines = F.flatten(F.transform(own, lambda p: p["lines"]))
    own_lines = F.when(quoting, F.filter(own_lines, lambda l: ~l.rlike(ATTRIBUTION))).otherwise(own_lines)
    quotes = F.transform(F.filter("_passages", lambda p: p["level"] > 0), lambda p: F.struct(p["level"].alias("level"), F.array_join(p["lines"], "\n").alias("text")))
    own_text = F.when(quoting, F.btrim(F.array_join(own_lines, "\n"), F.lit("\n \t\r"))).otherwise(text)
    # Held, as a filter on the quotes would else repeat all of this for every line.
    made = zip(("own_text", "quotes", "max_level"), held(own_text, quotes, F.array_max("_level").cast("long")))
    return rows.select(*messages.columns, *[c.alias(name) for name, c in made])


def _keys(text: Column) -> Column:
    """Hashes of a text's passages and lines: the whole, its paragraphs, its lines."""
    parts = F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, "\n"))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: normalised(p) != ""), _hash))


def links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, level, quote (number), original (turn of the linked message or null); one row per quoted passage."""
    quotes = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL AND size(quotes) > 0").select("conv_id", "turn", F.posexplode("quotes").alias("quote", "q"))
    keyed = quotes.select("conv_id", "turn", "quote", "q.level", _hash(F.col("q.text")).alias("whole"), F.explode_outer(_keys(F.col("q.text"))).alias("key"))
    # Only messages of conversations with quotes are taken apart and sent on.
    quoting = materialise(quotes.select("conv_id").distinct(), "chat-quoting")
    quoting = F.broadcast(quoting) if quoting.count() * CONV_BYTES <= BROADCAST_BYTES else quoting
    own = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").join(quoting, "conv_id", "left_semi").select("conv_id", "turn", F.explode(_keys(F.col("own_text"))).alias("key"))
    originals = own.groupBy("conv_id", "key").agg(F.min("turn").alias("original"))
    found = keyed.join(originals, ["conv_id", "key"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
    votes = found.groupBy("conv_id", "turn", "quote", "level", "original").agg(F.max((F.col("key") == F.col("whole")).cast("int")).alias("whole"), F.count("key").alias("lines"))
    order = F.struct(F.col("original").isNotNull().alias("a"), F.coalesce("whole", F.lit(0)).alias("w"), F.col("lines"), F.col("original"))
    return votes.groupBy("conv_id", "turn", "quote", "level").agg(F.max(order).alias("best")).select("conv_id", "turn", "quote", "level", F.col("best.original").alias("original"))


def _before(turns: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the largest value among earlier turns of the conversation; turns has distinct conv_id, turn."""
    rows = turns.select("*", F.floor(F.col("turn") / BLOCK).alias("_block"), value.alias("_value"))
    inside = W.partitionBy("conv_id", "_block").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    ends = rows.groupBy("conv_id", "_block").agg(F.max("_value").alias("_end"))
    over = W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("conv_id", "_block", F.max("_end").over(over).alias("_earlier"))
    rows = rows.withColumn("_inside", F.max("_value").over(inside)).join(ends, ["conv_id", "_block"])
    return rows.withColumn(name, F.coalesce(F.greatest("_inside", "_earlier"), "_inside", "_earlier")).drop("_block", "_value", "_inside", "_earlier")


def _ranked(turns: DataFrame, name: str) -> DataFrame:
    """Adds the place of each turn in its conversation, from 0; turns has distinct conv_id, turn."""
    rows = turns.withColumn("_block", F.floor(F.col("turn") / BLOCK))
    sizes = rows.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    over = W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("conv_id", "_block", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("conv_id", "_block").orderBy("turn")) - 1
    return rows.withColumn("_inside", inside).join(before, ["conv_id", "_block"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_block", "_before", "_inside")


def _sum_before(rows: DataFrame, group: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of the value over the earlier rows of the group; a group may be spread over many parts of the sorted table."""
    placed = materialise(rows.orderBy(*group, *order).withColumn("_part", F.spark_partition_id()), "chat-sorted")
    inside = F.sum(value).over(W.partitionBy("_part", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    sums = placed.groupBy("_part", *group).agg(F.sum(value).alias("_n"))
    over = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("_part").alias("_of"), *[F.col(g).alias(f"_{g}") for g in group], F.sum("_n").over(over).alias("_before"))
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group], F.col("_part") == F.col("_of"))
    joined = placed.withColumn("_inside", inside).join(sums, same)
    return joined.select(*rows.columns, (F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0))).alias(name))


def reply_places(parents: DataFrame) -> DataFrame:
    """conv_id, turn, reply_place from conv_id, turn, linked (turn replied to or null), previous."""
    # A message that replies to the one before it continues its run; any other link begins a run. The first run has no name.
    begins = (F.col("linked").isNotNull()) & (~F.col("linked").eqNullSafe(F.col("previous")))
    rows = parents.withColumn("_begin", F.when(begins, F.col("turn")))
    rows = _ranked(_before(rows, F.col("_begin"), "_earlier_begin"), "at")
    rows = materialise(rows.select("conv_id", "turn", "linked", "_begin", "at", F.coalesce("_begin", "_earlier_begin").alias("run")), "chat-runs")
    sizes = rows.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # Where a run hangs: the run of the message that it answers.
    branches = rows.where("_begin IS NOT NULL").select("conv_id", "run", F.col("linked").alias("to"))
    tree = branches.join(rows.select("conv_id", F.col("turn").alias("to"), F.col("run").alias("up")), ["conv_id", "to"]).join(sizes.select("conv_id", "run", "n"), ["conv_id", "run"])
    above = sizes.select(F.col("conv_id").alias("_conv"), F.col("run").alias("_run"), F.col("n").alias("up_n"))
    tree = tree.join(above, (F.col("conv_id") == F.col("_conv")) & F.col("up").eqNullSafe(F.col("_run"))).drop("_conv", "_run")
    tree = materialise(tree, "chat-tree")

    # Messages of each run and all below it: in step k a run adds what the runs 2^k below it know.
    known = tree.select("conv_id", "run", F.col("n").alias("weight"), F.col("up").alias("jump"))
    while not known.where("jump IS NOT NULL").isEmpty():
        sent = known.where("jump IS NOT NULL").groupBy("conv_id", F.col("jump").alias("run")).agg(F.sum("weight").alias("more"))
        far = known.select("conv_id", F.col("run").alias("jump"), F.col("jump").alias("further"))
        known = known.join(sent, ["conv_id", "run"], "left").join(far, ["conv_id", "jump"], "left")
        known = materialise(known.select("conv_id", "run", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"), F.col("further").alias("jump")), "chat-weights")

    # Behind the run above come its branches, those of its later messages first.
    weighed = tree.join(known.select("conv_id", "run", "weight"), ["conv_id", "run"])
    placed = _sum_before(weighed, ["conv_id", "up"], [F.desc("to"), F.col("run")], "weight", "earlier")
    places = materialise(placed.select("conv_id", "run", (F.col("up_n") + F.col("earlier")).alias("place"), F.col("up").alias("jump")), "chat-places")
    while not places.where("jump IS NOT NULL").isEmpty():  # each step doubles the part of the way up that is summed
        far = places.select("conv_id", F.col("run").alias("jump"), F.col("place").alias("head"), F.col("jump").alias("further"))
        longer = places.join(far, ["conv_id", "jump"], "left")
        places = materialise(longer.select("conv_id", "run", (F.col("place") + F.coalesce("head", F.lit(0))).alias("place"), F.col("further").alias("jump")), "chat-places")

    firsts = sizes.select(F.col("conv_id").alias("_conv"), F.col("run").alias("_run"), "first").join(
        places.select(F.col("conv_id").alias("_c"), F.col("run").alias("_r"), "place"), (F.col("_conv") == F.col("_c")) & (F.col("_run") == F.col("_r")), "left"
    )
    joined = rows.join(firsts, (F.col("conv_id") == F.col("_conv")) & F.col("run").eqNullSafe(F.col("_run")))
    return joined.select("conv_id", "turn", (F.coalesce("place", F.lit(0)) + F.col("at") - F.col("first")).cast("long").alias("reply_place"))


def reply_order(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, own_text, n_quotes, n_linked, max_level, reply_to, reply_place."""
    parsed = parse(messages.select("conv_id", "turn", "role", "text"))
    found = materialise(links(parsed), "chat-links")
    replies = found.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("original").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("original"))).alias("outer"), F.max("original").alias("any")
    )
    replies = replies.select("conv_id", "turn", "n_quotes", "n_linked", F.coalesce("outer", "any").alias("linked"))
    turns = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn")).distinct()
    parents = _before(turns, F.col("turn"), "previous").join(replies, ["conv_id", "turn"], "left")
    parents = materialise(parents.select("conv_id", "turn", "linked", "previous", "n_quotes", "n_linked"), "chat-parents")
    placed = parents.join(reply_places(parents.select("conv_id", "turn", "linked", "previous")), ["conv_id", "turn"], "left")
    placed = placed.select("conv_id", "turn", F.coalesce("linked", "previous").alias("reply_to"), "n_quotes", "n_linked", "reply_place")
    zero = F.lit(0).cast("long")
    return parsed.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "own_text", F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"), "max_level", "reply_to", "reply_place"
    )


def conversations(messages: DataFrame) -> DataFrame:
    """The messages in reply order, sorted over the whole table, so that no conversation has to fit a task."""
    return reply_order(messages).orderBy("conv_id", "reply_place")


def op7_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of the conversations, with its place in reply order and its own text."""
    return reply_order(table(spark, sf_dir, "conversations"))


