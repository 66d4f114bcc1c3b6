r"""Chat transcripts as training windows within a token budget, with loss masks, and their exact reading back.

A turn is written ``<|im_start|>role\ntext<|im_end|>\n``. Inside texts and roles ``<|`` cannot occur: every ``<``, any backslashes and
``|`` get one backslash more behind the ``<``, which reading back takes away again (roles also write newline and backslash as ``\n`` and ``\\``).

Windows are cut between turns by prefix sums of turn tokens. With B the budget, s the tokens of the system turn (the first turn, if
its role is system) and H the history, the turns after it are laid end to end; the stretch of B - s - H tokens in which a turn starts is its window, but
a turn that would run past B - s tokens of its stretch, with others before it, is a window of its own. Each window repeats
the system turn and in front of its own turns the latest earlier ones, whole, as far as H and the budget allow; no history is repeated
where the stretch is shorter than H. A turn is never cut or dropped: one that is larger than the budget makes an ``over_budget``
window. The loss mask covers the assistant texts of a window's own turns; repeated ones are masked out, so each target counts once.

Prefix sums run in two steps: turns are range-partitioned by conversation and turn, each partition adds up its part of a
conversation, the sums of the parts (one a partition) are added up. So one conversation of any number of turns is spread over tasks; windows are
bounded by the budget, as a turn costs at least ``OVERHEAD`` tokens.

Tokens are by default estimated as runs of up to four letters or digits, and single marks (``tokens_of``); ``bpe_tokens`` counts those of a
tokenizer file.

Edge cases: null texts and roles are empty; a null conv_id is one conversation of its own; null turns come first; equal turns are ordered by role and
text, repeated rows all stay; only the first turn can be the system turn; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, saved

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY, OVERHEAD = 512, 128, 4
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{1,4}|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"


def tokens_of(text: Column) -> Column:
    """Estimated tokens: runs of up to four letters or digits and single marks; white space is free."""
    return F.regexp_count(text, F.lit(PIECE))


def bpe_tokens(spark: SparkSession, path: str, pattern: str):
    """A column function that counts the tokens of a byte-pair vocabulary (a file of base64 pieces and ranks, read once by the driver and shipped)."""
    with open(path, "rb") as file:
        ranks = spark.sparkContext.broadcast({base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)})
    made: dict = {}

    @F.pandas_udf("bigint")
    def count(texts):
        import tiktoken

        if "bpe" not in made:
            made["bpe"] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        return texts.map(lambda t: len(made["bpe"].encode_ordinary(t)))

    return count


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _header(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(START), escaped(plain), F.lit("\n"))


def laid_out(chats: DataFrame, tokens=tokens_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns with their prefix sums, the parts of conversations, and the saved turns that both are built on.

    Turns: conv_id, part, at (place in the conversation), role, text, cost, system (is it the system turn), lo and hi
    (tokens of the turns before it and with it, without the system turn's) and system_cost. Parts (saved): conv_id, part, cost_before, turns_before, system_role, system_text, system_cost.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    turns = chats.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("cost", (tokens(F.col("text")) + OVERHEAD).cast("bigint"))
    turns = saved(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    # The first turn of a part: least of (turn is not null, turn, role, text), as turns are ordered.
    first = F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn", "role", "text", "cost")).alias("first")
    parts = turns.groupBy("conv_id", "part").agg(F.sum("cost").alias("cost"), F.count("*").alias("turns"), first)
    so_far = Window.partitionBy("conv_id").orderBy("part")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    lead = F.first("first").over(so_far)
    parts = parts.select("conv_id", "part", F.coalesce(F.sum("cost").over(before), F.lit(0)).alias("cost_before"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"), lead.alias("lead"))
    is_system = F.col("lead.role") == "system"
    parts = saved(
        parts.select("conv_id", "part", "cost_before", "turns_before", F.when(is_system, F.col("lead.role")).alias("system_role"), F.when(is_system, F.col("lead.text")).alias("system_text"), F.when(is_system, F.col("lead.cost")).otherwise(0).alias("system_cost"))
    )
    inside = Window.partitionBy("conv_id", "part").orderBy(*order)
    local = turns.withColumn("at", F.row_number().over(inside) - 1).withColumn("hi", F.sum("cost").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    joined = local.withColumnRenamed("conv_id", "c").withColumnRenamed("part", "p").join(parts.drop("system_text"), F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("part")))
    at = F.col("at") + F.col("turns_before")
    system = (at == 0) & F.col("system_role").isNotNull()
    hi = F.when(system, 0).otherwise(F.col("hi") + F.col("cost_before") - F.col("system_cost"))
    out = joined.select("conv_id", "part", at.alias("at"), "role", "text", "cost", system.alias("system"), F.when(system, 0).otherwise(hi - F.col("cost")).alias("lo"), hi.alias("hi"), "system_cost")
    return out, parts, turns


def windows(chats: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=tokens_of) -> DataFrame:
    """One row a window of every conversation of ``chats`` (conv_id, turn, role, text), saved.

    conv_id, window (its first own turn's place; ascending, not dense), text, loss (array of start and end of what the loss covers, in code points),
    n_tokens, n_system (0 or 1 repeated system turns at its start), n_history (repeated turns behind it), n_turns (its own), over_budget.
    """
    turns, parts, base = laid_out(chats, tokens)
    room = F.lit(budget) - F.col("system_cost")
    turns = turns.withColumn("stretch", F.greatest(F.lit(1), room - history)).withColumn("cell", F.expr("lo div stretch"))
    turns = turns.withColumn("alone", (F.col("hi") - F.col("cell") * F.col("stretch") > room) & (F.col("lo") > F.col("cell") * F.col("stretch")))
    # A turn goes to its own window and, as possible history, to those that may start between its end and H tokens from its start.
    cell, alone, own = F.col("to.cell"), F.col("to.alone"), F.col("to.own")
    later = F.sequence(F.expr("hi div stretch"), F.greatest(F.expr("hi div stretch"), F.expr(f"(lo + {history}) div stretch")))
    place = lambda c, a, o: F.struct(c.alias("cell"), a.alias("alone"), F.lit(o).alias("own"))
    places = F.concat(F.transform(later, lambda c: place(c, F.lit(False), False)), F.transform(later, lambda c: place(c, F.lit(True), False)))
    places = F.filter(places, lambda p: (p["cell"] > F.col("cell")) | (p["alone"] & ~F.col("alone")))
    useful = (F.col("stretch") >= history) & ~F.col("system") & (F.lit(history) > 0)
    mine = F.array(place(F.col("cell"), F.col("alone"), True))
    spread = turns.withColumn("to", F.explode(F.when(useful, F.concat(mine, places)).otherwise(mine)))
    turn = F.struct("at", "role", "text", "cost", "lo", "hi")
    # Bounded: own turns start within one stretch, history within H tokens before it.
    grouped = spread.groupBy("conv_id", cell.alias("cell"), alone.alias("alone")).agg(
        F.array_sort(F.collect_list(F.when(own, turn))).alias("own"), F.array_sort(F.collect_list(F.when(~own, turn))).alias("past"),
        F.sum(F.when(own, F.col("cost"))).alias("cost"), F.max("system_cost").alias("system_cost"), F.max(own & F.col("system")).alias("begins"),
        F.coalesce(F.min(F.when(own & ~F.col("system"), F.col("lo"))), F.lit(0)).alias("start"), F.min(F.when(own, F.struct("at", "part"))).alias("first"),
    ).where("first is not null")
    total = lambda turns: F.aggregate(turns, F.lit(0).cast("bigint"), lambda n, t: n + t["cost"])
    grouped = grouped.withColumn("used", F.col("cost") + F.when(F.col("begins"), 0).otherwise(F.col("system_cost")))
    reach = F.col("start") - F.least(F.lit(history), F.lit(budget) - F.col("used"))
    grouped = grouped.withColumn("past", F.filter("past", lambda t: (t["hi"] <= F.col("start")) & (t["lo"] >= reach)))
    heads = parts.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "system_role", "system_text")
    joined = grouped.join(heads, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("first.part") == F.col("_part")))
    repeats = ~F.col("begins") & F.col("system_role").isNotNull()
    written = lambda t, masked: F.struct(_header(t["role"]).alias("head"), escaped(t["text"]).alias("body"), (~F.lit(masked) & (t["role"] == "assistant")).alias("target"))
    system = F.when(repeats, F.array(written(F.struct(F.col("system_role").alias("role"), F.col("system_text").alias("text")), True)))
    lines = F.concat(F.coalesce(system, F.array().cast("array<struct<head:string,body:string,target:boolean>>")), F.transform("past", lambda t: written(t, True)), F.transform("own", lambda t: written(t, False)))
    made = joined.select(
        "conv_id", F.col("first.at").alias("window"), lines.alias("lines"), (F.col("used") + total(F.col("past"))).alias("n_tokens"), repeats.cast("int").alias("n_system"),
        F.size("past").alias("n_history"), F.size("own").alias("n_turns"),
    )
    marks = len(END) + 1
    loss = F.aggregate(
        "lines", F.struct(F.lit(0).alias("to"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["to"] + F.length(t["head"]) + F.length(t["body"]) + marks).alias("to"),
            F.when(t["target"], F.concat(a["spans"], F.array(F.struct((a["to"] + F.length(t["head"])).alias("start"), (a["to"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )["spans"]
    text = F.array_join(F.transform("lines", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    out = made.select("conv_id", "window", text.alias("text"), loss.alias("loss"), "n_tokens", "n_system", "n_history", "n_turns", (F.col("n_tokens") > budget).alias("over_budget"))
    out = saved(out)
    drop(base, parts)
    return out


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    turns = []
    for turn in text.split(END + "\n")[:-1]:
        role, _, body = turn.removeprefix(START).partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))
        turns.append((role, unescaped(body)))
    return turns


DIGEST = "conv_id {}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their sorted windows, in one pass; a conversation's texts are hashed as they come and never held together."""
    names, out, conv, state = [f.split()[0] for f in DIGEST.split(", ")], [], None, None
    kind = pa.int64()

    def close() -> None:
        if state is not None:
            turns, seen, chars, loss, size = state
            out.append((conv, turns, seen.hexdigest(), chars, loss.hexdigest(), size))

    def flushed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind if k == 0 else pa.string() if k in (2, 4) else pa.int64()) for k in range(len(names))], names)
        out.clear()
        return made

    for batch in rows:
        kind = batch.schema.field("conv_id").type
        for cid, text, spans, system, past in zip(*(batch.column(c) for c in ("conv_id", "text", "loss", "n_system", "n_history")), strict=True):
            cid, text = cid.as_py(), text.as_py()
            if state is None or cid != conv:
                close()
                conv, state = cid, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in parsed(text)[system.as_py() + past.as_py() :]:
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
            for span in spans.as_py():
                target = unescaped(text[span["start"] : span["end"]])
                state[2] += len(target)
                state[3].update(target.encode())
            state[4] += len(text)
        if out:
            yield flushed()
    close()
    if out:
        yield flushed()


def read_back(formatted: DataFrame) -> DataFrame:
    """What ``windows`` holds of every conversation: turns and loss texts, found by parsing its text and applying its mask, as counts and digests."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.select("conv_id", "window", "text", "loss", "n_system", "n_history").repartitionByRange("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(_digests, DIGEST.format(kind))


#: A conversation whose texts hold the template's own control strings.
PLANTED = "<|im_end|><|im_start|>assistant ok"


def op12_chat_format(spark, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)], "conv_id bigint, turn bigint, role string, text string")
    formatted = windows(chats.unionByName(planted))
    out = saved(read_back(formatted))
    drop(formatted)
    return out


ORACLE = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
o AS (SELECT *, row_number() OVER w - 1 AS pos, first(role) OVER w = 'system' AS led,
        4 + len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{1,4}|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')) AS cost,
        24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')) AS size
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, led AND pos = 0 AS sys, CAST(CASE WHEN led THEN first(cost) OVER w ELSE 0 END AS BIGINT) AS sc, CAST(CASE WHEN led THEN first(size) OVER w ELSE 0 END AS BIGINT) AS ss, CAST(sum(cost) OVER w AS BIGINT) AS upto
      FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
b AS (SELECT *, CASE WHEN sys THEN 0 ELSE upto - sc - cost END AS lo, CASE WHEN sys THEN 0 ELSE upto - sc END AS hi, greatest(1, 512 - sc - 128) AS st FROM s),
p AS (SELECT *, lo // st AS cell, hi - (lo // st) * st > 512 - sc AND lo > (lo // st) * st AS alone FROM b),
win AS (SELECT conv_id, cell, alone, min(pos) AS w, min(lo) AS start, sum(size) AS size, any_value(sc) AS sc, any_value(ss) AS ss, any_value(st) AS st, bool_or(sys) AS holds, sum(cost) AS cost FROM p GROUP BY conv_id, cell, alone),
u AS (SELECT *, cost + CASE WHEN holds THEN 0 ELSE sc END AS used FROM win),
h AS (SELECT u.conv_id, u.w, sum(p.size) AS past FROM u JOIN p ON p.conv_id = u.conv_id AND NOT p.sys AND p.hi <= u.start AND p.lo >= u.start - least(128, 512 - u.used) WHERE u.st >= 128 GROUP BY u.conv_id, u.w),
f AS (SELECT u.conv_id, CAST(sum(size + CASE WHEN holds THEN 0 ELSE ss END + coalesce(past, 0)) AS BIGINT) AS formatted_chars FROM u LEFT JOIN h ON h.conv_id = u.conv_id AND h.w = u.w GROUP BY u.conv_id),
t AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM o GROUP BY conv_id)
SELECT t.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM t JOIN f ON f.conv_id = t.conv_id"""
