"""Veto messages: items to their deletion instructions, heading and reason.

An item opens with instructions that wrap over lines and sometimes share one; it ends with a heading and a reason. Where an
instruction ends is known only from what has been read of it, so an item's lines are one fold (an item is some dozens of lines); items
are rows and fold side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import documents

# The formula that closes a reason, the quotes that close one, the words that begin an instruction.
CLOSING_FORMULA, CLOSING_QUOTES, OPENS = "is in the public interest", '[”"]', "on page"


def collapsed(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def starts_instruction(line: Column) -> Column:
    return F.lower(collapsed(line)).startswith(OPENS)


def is_complete(text: Column) -> Column:
    """A range that is opened is also closed, and the text ends with a closing quote or with a full stop that is no ellipsis."""
    low, end = F.lower(text), F.rtrim(text)
    has = lambda words: low.rlike("|".join(words))
    unclosed = has(documents.RANGE_OPENERS) & ~has(documents.RANGE_CONNECTORS) & ~has(documents.PAGE_END_CONNECTORS)
    stop = end.endswith(".") & ~end.endswith("...")
    return (end.rlike(CLOSING_QUOTES + "$") | stop) & ~unclosed  # the end is looked at first, as it decides most lines


def embedded(text: Column) -> Column:
    """The instructions run together in one: a new one begins at "on page" and a number with "delete" somewhere behind."""
    parts = F.split(text, r"(?is)(?=on page\s*[0-9].*delete)")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def deletion_block(lines: Column) -> Column:
    """struct(instructions, after): the leading instructions of an item's lines, and the number of lines they take.

    A line that begins an instruction ends the one before; another line goes on an incomplete one, else the block ends. Blank lines are passed over.
    """
    state = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"), F.lit(0).alias("after"), F.lit(False).alias("ended"))

    def step(a: Column, line: Column) -> Column:
        begins, goes_on = F.lower(line).startswith(OPENS), (a["open"] != "") & ~is_complete(a["open"])
        taken = (line == "") | begins | goes_on
        now = F.when(line == "", a["open"]).when(begins, line).otherwise(documents.join_lines(F.array(a["open"], line)))
        done = F.when(begins & (a["open"] != ""), F.array_append(a["done"], a["open"])).otherwise(a["done"])
        read = F.struct(now.alias("open"), done.alias("done"), (a["after"] + 1).alias("after"), F.lit(False).alias("ended"))
        return F.when(taken, read).otherwise(F.struct(a["open"].alias("open"), a["done"].alias("done"), a["after"].alias("after"), F.lit(True).alias("ended")))

    def finish(a: Column) -> Column:
        whole = F.when(a["open"] != "", F.array_append(a["done"], a["open"])).otherwise(a["done"])
        return F.struct(F.flatten(F.transform(whole, embedded)).alias("instructions"), a["after"].alias("after"))

    def until_end(a: Column, raw: Column) -> Column:
        # White space is collapsed once a line, not wherever the fold looks at it, and not in lines behind the block.
        return F.when(a["ended"], a).otherwise(F.get(F.transform(F.array(collapsed(raw)), lambda line: step(a, line)), F.lit(0)))

    return F.aggregate(lines, state, until_end, finish)


def message_items(lines: DataFrame) -> DataFrame:
    """Items of messages (doc, line_no, text), without running feet.

    doc, segment (place in the message, from 1), item_number, instructions, title, title_rejoined, rationale, has_formula. What
    precedes the first ITEM NUMBER belongs to none.
    """
    number = F.regexp_extract(F.trim("text"), r"^ITEM NUMBER\s+([0-9]+)(?:\s|$)", 1)
    content = lines.where(~documents.is_running_foot(F.col("text")))
    rows = documents.segments(content, number != "").where("segment > 0").withColumn("number", F.when(number != "", number.try_cast("int")))
    body = F.sort_array(F.collect_list(F.when(F.col("number").isNull(), F.struct("line_no", "text"))))["text"]
    items = rows.groupBy("doc", "segment").agg(F.max("number").alias("item_number"), body.alias("lines")).withColumn("block", deletion_block(F.col("lines")))
    rest = F.filter(F.transform(F.slice("lines", F.col("block.after") + 1, F.greatest(F.size("lines") - F.col("block.after"), F.lit(0))), lambda x: F.trim(x)), lambda x: x != "")
    items = items.withColumn("rest", rest).withColumn("head", documents.heading(F.col("rest")))
    reason = documents.join_lines(F.slice("rest", F.when(F.col("head.rejoined"), 3).otherwise(2), F.greatest(F.size("rest"), F.lit(1))))
    items = items.withColumn("rationale", reason)
    formula = F.contains(F.lower("rationale"), F.lit(CLOSING_FORMULA))
    return items.select("doc", "segment", "item_number", F.col("block.instructions").alias("instructions"), F.col("head.title").alias("title"), F.col("head.rejoined").alias("title_rejoined"), "rationale", formula.alias("has_formula"))


def item_deletions(items: DataFrame) -> DataFrame:
    """Every instruction of every item with its place and what it strikes (``documents.deletions``)."""
    return documents.deletions(items.select("doc", "segment", "item_number", F.posexplode("instructions").alias("place", "instruction")))


def message_report(items: DataFrame) -> DataFrame:
    """Per message: items, deletions and what is amiss, by count (``documents.veto_report``); an item counts by its number."""
    # An item's own counts come with the item, so that items are folded once.
    own = items.select("doc", "segment", "item_number", "has_formula", F.explode_outer("instructions").alias("instruction"))
    cut = documents.deletions(own)
    there = F.col("instruction").isNotNull()
    counted = cut.groupBy("doc", "segment", "item_number", "has_formula").agg(
        F.count("instruction").alias("n"), F.count_if(there & (F.col("kind") == "unrecognised")).alias("unknown"), F.bool_or(there & F.coalesce(F.contains(F.coalesce("text", "begins"), F.lit("$")), F.lit(False))).alias("money"),
    )
    return documents.counted_report(counted)
