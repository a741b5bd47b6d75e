"""Chat formatting by quotation linking.

A message's lines are parsed into nested quote levels (leading ``>`` marks). Lines of one level in a row are a passage;
attribution lines ("... wrote:") in front of a deeper level belong to the quotation. What a message says itself is its
level-0 text. Quoted passages, their paragraphs and their lines are normalised (case folded, white space collapsed) and
hashed, and joined by hash to the messages that said them: the earliest such message of the same conversation before
the quoting one, or else the earliest of any other conversation. Many messages may say the same; a hash is reduced to
one original for each conversation and to two over all before the join, so a quotation meets few rows, and one of the
two is always of another conversation if there is any.

Every message is returned once, in reply order within its conversation, without quotations, with the message it
replies to (the one that its outermost quoted passage comes from) and all sources of its quotations. Null text is
empty. conv_id and turn are whole numbers; what can't be read as one counts as null, and rows without conversation or
turn are kept, order last and have no sources. Repeated rows are messages of their own. Other columns, whatever their
names, are left out. Messages of one conversation and turn are one place: they quote and are quoted together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bound_batches, materialise

_MARKS = re.compile(r"^(?:[ \t]*>)+")
_WROTE = re.compile(r"(?:wrote|writes|schrieb|a écrit)\s*:\s*$", re.IGNORECASE)
WHOLE, PARAGRAPH, LINE = 3, 2, 1
TURNS, SALTS = 1024, 64


def normalised(passage: str) -> str:
    return " ".join(passage.casefold().split())


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text and its quoted passages as (level, text), in order."""
    lines = []
    for line in (text or "").split("\n"):
        mark = _MARKS.match(line)
        lines.append((mark[0].count(">"), line[mark.end() :].removeprefix(" ")) if mark else (0, line))
    kept, below = [], 0  # the level of the next line that isn't blank
    for level, line in reversed(lines):
        if not (below > level and _WROTE.search(line)):
            kept.append((level, line))
        below = level if line.strip() else below
    kept.reverse()
    passages: list[tuple[int, list[str]]] = []
    for level, line in kept:
        if passages and passages[-1][0] == level:
            passages[-1][1].append(line)
        else:
            passages.append((level, [line]))
    own = "\n".join(line for level, part in passages if not level for line in part)
    own = re.sub(r"\n{3,}", "\n\n", own).strip("\n") if any(level for level, _ in passages) else own
    return own, [(level, "\n".join(part).strip("\n")) for level, part in passages if level and any(x.strip() for x in part)]


def units(passage: str) -> Iterator[tuple[int, int]]:
    """(weight, hash) of a passage, its paragraphs and its lines."""
    seen = set()
    for weight, parts in ((WHOLE, [passage]), (PARAGRAPH, re.split(r"\n\s*\n", passage)), (LINE, passage.split("\n"))):
        for part in parts:
            plain = normalised(part)
            if plain and plain not in seen:
                seen.add(plain)
                yield weight, xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) - (1 << 63)


_SAID = pa.list_(pa.int64())
_QUOTED = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("weight", pa.int32()), ("hash", pa.int64())]))
PARSED = "conv_id long, turn long, role string, text string, said array<long>, quoted array<struct<passage: int, level: int, weight: int, hash: long>>"


def parsed(messages: DataFrame) -> DataFrame:
    """PARSED of messages (conv_id, turn, role, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, said, quoted = [], [], []
            for text in b.column("text").to_pylist():
                mine, passages = parse(text)
                own.append(mine)
                said.append([h for _, h in units(mine)])
                quoted.append([{"passage": i, "level": level, "weight": w, "hash": h} for i, (level, p) in enumerate(passages) for w, h in units(p)])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), pa.array(own, pa.string()), pa.array(said, _SAID), pa.array(quoted, _QUOTED)], ["conv_id", "turn", "role", "text", "said", "quoted"])

    bound_batches(messages.sparkSession)
    return messages.selectExpr("try_cast(conv_id as long) conv_id", "try_cast(turn as long) turn", "cast(role as string) role", "cast(text as string) text").mapInArrow(of, PARSED)


def links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, sources, reply_conv, reply_turn) of each message that quotes others, from PARSED."""
    quotes = rows.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*").distinct()
    asked = quotes.select("hash").distinct()
    said = rows.select("conv_id", "turn", F.explode("said").alias("hash")).filter("conv_id is not null and turn is not null").join(asked, "hash", "left_semi")
    here = said.groupBy("hash", "conv_id").agg(F.min("turn").alias("here_turn"))
    # two of each hash, at first within salts, as one line may be said by a third of all conversations
    two = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy("hash", *by).orderBy("conv_id"))).filter("n <= 2").drop("n")
    firsts = two(two(here.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS))), "salt")).groupBy("hash")
    there = firsts.agg(F.min(F.struct("conv_id", F.col("here_turn").alias("turn"))).alias("first"), F.max(F.struct("conv_id", F.col("here_turn").alias("turn"))).alias("second"))
    met = quotes.join(here, ["hash", "conv_id"], "left").join(there, "hash")
    own = F.col("here_turn") < F.col("turn")
    source = F.when(own, F.struct("conv_id", F.col("here_turn").alias("turn")))
    for other in ("first", "second"):
        source = source.when(F.col(f"{other}.conv_id") != F.col("conv_id"), F.col(other))
    met = met.withColumn("source", source).filter("source is not null")
    best = met.groupBy("conv_id", "turn", "passage", "level").agg(F.max(F.struct("weight", (-F.col("source.turn")).alias("t"), (-F.col("source.conv_id")).alias("c"))).alias("b"))
    best = best.select("conv_id", "turn", "passage", "level", (-F.col("b.c")).alias("reply_conv"), (-F.col("b.t")).alias("reply_turn"))
    reply = F.min(F.struct("level", "passage", "reply_conv", "reply_turn"))
    return best.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set(F.struct("reply_conv", "reply_turn"))).alias("sources"), reply.alias("r")).select("conv_id", "turn", "sources", "r.reply_conv", "r.reply_turn")


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, text, reply_conv, reply_turn, sources, formatted) of every message.

    ``position`` counts from 1 in reply order: a message comes after all those of its conversation that it quotes. It is
    summed over ranges of turns, so that no task holds a whole conversation.
    """
    rows = materialise(parsed(messages), "messages").withColumn("range", F.expr(f"turn div {TURNS}"))
    counts = rows.groupBy("conv_id", "range").count()
    before = Window.partitionBy("conv_id").orderBy(F.col("range").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("conv_id").alias("oc"), F.col("range").alias("orange"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    placed = rows.withColumn("n", F.row_number().over(inside)).join(offsets, F.col("conv_id").eqNullSafe(F.col("oc")) & F.col("range").eqNullSafe(F.col("orange")))
    found = links(rows).withColumnsRenamed({"conv_id": "lc", "turn": "lt"})
    linked = placed.join(found, (F.col("conv_id") == F.col("lc")) & (F.col("turn") == F.col("lt")), "left")
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    return linked.select("conv_id", (F.col("offset") + F.col("n")).alias("position"), "turn", "role", "text", "reply_conv", "reply_turn", "sources", formatted.alias("formatted"))
