"""Mixing sources to target weights, in DataFrame functions only.

Targets. Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share ``share`` times all words; a
target stops at ``most`` times its source's words and the excess goes to the others by weight. That fixed point is
target = min(most * words, level * weight) with one level for all, found with running sums over the sources.

Blocks. Each source's documents, in a pseudorandom order of doc_id and size, are one sequence of words, packed into
blocks of BLOCK words; the last may be shorter. A document covers an interval of that sequence, which is summed up over
ranges of the order; a range that equal doc_ids crowd is split further, at last by rows, so that no task holds them all.

Slots. A source has as many slots as its target's words need; the last may take only its block's first words. Slot q
reads block perm(q mod blocks), where perm is a swap-or-not shuffle of the whole blocks with keys of source and epoch;
a short last block stays last. Every epoch reads each block once, so no document is taken over ``most`` times.

Shards. Each output shard of SHARD slots draws its source counts from a multinomial with the slots' shares. Draws
beyond a source's own number of slots go, in order, to sources that have some left, so all totals are exact. Blocks
and slots are joined by (source, index). Shards and slots are in mixed_shards(); how many words of a document are taken
over all depends on the totals alone.

Sizes are counts of words; a null text has 0. Repeated and null doc_ids are rows of their own; rows of one doc_id, source
and size are interchangeable. A table without words takes nothing. Columns of docs may have any names. All draws are
arithmetic on the seed: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, materialise

WEIGHTS, SHARE, MOST, BLOCK, SHARD, ROUNDS, SEED = (3, 1, 2), 1.5, 2, 256, 4096, 12, 20_240_607
#: Rows that a running sum over documents holds in one task, or so; slots that are made from one row; cells of a draw.
NEAR_ROWS, CHUNK, CELLS, SALTS = 20_000, 4096, 4096, 64
PRIME = 2_147_483_647


#: SQL for what decides a document's place.
PLACE = "coalesce(doc_id, 0) + size * 7919"


def draw(x: str, salt: str) -> str:
    """SQL for a pseudorandom long in [0, PRIME): multiplicative generators around a square, without which neighbours' draws
    would follow each other in even steps. The same SQL runs elsewhere."""
    first = f"(((cast({x} as bigint) % {PRIME} + {PRIME}) % {PRIME} + (cast({salt} as bigint) % {PRIME}) * 7919 + {SEED}) % {PRIME})"
    second = f"(({first} * 48271 + 11) % {PRIME})"
    third = f"({second} * ({second} + 69621) % {PRIME})"
    return f"(({third} * 39373 + 5) % {PRIME})"


def sizes(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, rank, source_size, target) of each source of (source, size): a row for each source only."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    by = by.withColumn("level", level)
    # with all before it at their caps, a source is the first that isn't if the level doesn't exceed its ratio
    by = by.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return by.select("source", "rank", "source_size", target.alias("target"))


def plan(sized: DataFrame, block: int = BLOCK, **how) -> DataFrame:
    """targets() with the words to take, the number of blocks and of slots."""
    by = targets(sized, **how).withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    by = by.withColumn("whole", F.expr(f"source_size div {block}")).withColumn("blocks", F.expr(f"whole + if(source_size % {block} > 0, 1, 0)"))
    slots = f"if(source_size = 0, 0L, (goal div source_size) * blocks + (goal % source_size + {block - 1}) div {block})"
    return by.withColumn("slots", F.expr(slots).cast("long"))


def located(docs: DataFrame, by: DataFrame, near_rows: int = NEAR_ROWS) -> DataFrame:
    """docs (row, doc_id, source, size, ...) with rank, source_size, target and their interval's ``begin`` in the source's
    words; ``row`` tells rows apart.

    The running sum is taken in ranges of the pseudorandom order, so a source with a third of all rows has many tasks. In
    ranges of over four times the rows meant, each doc_id and size is a range of its own, in SALTS parts.
    """
    most = docs.groupBy("source").count().agg(F.max("count")).first()[0] or 0  # one number
    bits = max(4, (most // near_rows).bit_length())
    joined = docs.join(by.select(F.col("source").alias("_s"), "rank", "source_size", "target"), docs["source"].eqNullSafe(F.col("_s"))).drop("_s")
    joined = joined.withColumn("place", F.expr(draw(PLACE, "1"))).withColumn("range", F.shiftright("place", 31 - bits))
    crowded = joined.groupBy("rank", "range").agg(F.count("*").alias("crowd")).filter(F.col("crowd") > 4 * near_rows)
    joined = joined.join(crowded, ["rank", "range"], "left").withColumn("split", F.col("crowd").isNotNull())
    # of a split range, the order's own columns; of another, the same values throughout
    parts = {"p": F.col("place"), "none": F.col("doc_id").isNull().cast("int"), "d": F.coalesce("doc_id", F.lit(0)).cast("long"), "z": F.col("size"), "salt": F.pmod(F.xxhash64("row"), F.lit(SALTS))}
    joined = joined.withColumns({k: F.when(F.col("split"), v).otherwise(F.lit(0)).cast("long") for k, v in parts.items()})
    cell = ["rank", "range", *parts]
    totals = joined.groupBy(*cell).agg(F.sum("size").alias("total"))
    before = Window.partitionBy("rank").orderBy("range", *parts).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*cell, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*cell).orderBy("place", F.col("doc_id").asc_nulls_last(), "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    own = joined.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return own.join(totals, cell).withColumn("begin", F.col("offset") + F.col("own")).drop("place", *cell[1:], "crowd", "split", "own", "offset")


def _drawn(by: DataFrame, shard: int) -> DataFrame:
    """(shard, slot, rank, q): each output slot's source by multinomial draws, and the source's own number for it."""
    spark = by.sparkSession
    total = by.agg(F.sum("slots")).first()[0] or 0  # one number
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    shares = by.filter("slots > 0").select("rank", "slots", F.sum("slots").over(upto).alias("z")).withColumn("a", F.col("z") - F.col("slots"))
    # a draw falls into a source's interval [a, z) of all slots; intervals and draws meet by cells
    width = max(1, -(-total // CELLS))
    cells = shares.withColumn("cell", F.explode(F.expr(f"sequence(a div {width}, (z - 1) div {width})")))
    slots = spark.range(total).selectExpr(f"id div {shard} shard", f"id % {shard} slot", f"cast(floor({draw('id', '2')} / {PRIME}D * {total}) as long) v").withColumn("cell", F.expr(f"v div {width}"))
    drawn = slots.join(cells, "cell").filter("v >= a and v < z").select("shard", "slot", "rank")
    counts = drawn.groupBy("shard", "rank").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "rank", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "rank").orderBy("slot")
    numbered = drawn.withColumn("i", F.row_number().over(within) - 1).join(counts, ["shard", "rank"]).selectExpr("shard", "slot", "rank", "before + i q")
    # settle what was drawn beyond a source's slots
    had = by.select("rank", "slots").join(drawn.groupBy("rank").agg(F.count("*").alias("n")), "rank", "left").selectExpr("rank", "slots", "coalesce(n, 0) n")
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    had = had.select("rank", "slots", "n", *(F.coalesce(F.sum(F.greatest(F.expr(x), F.lit(0))).over(before), F.lit(0)).alias(y) for x, y in (("n - slots", "over"), ("slots - n", "under"))))
    own = numbered.join(had.select("rank", "slots", "over"), "rank")
    kept = own.filter("q < slots").select("shard", "slot", "rank", "q")
    spare = own.filter("q >= slots").selectExpr("shard", "slot", "over + q - slots e", f"(over + q - slots) div {CHUNK} cell")
    short = had.filter("n < slots").selectExpr("rank", "n", "under a", "under + slots - n z", f"explode(sequence(under div {CHUNK}, (under + slots - n - 1) div {CHUNK})) cell")
    moved = spare.join(short, "cell").filter("e >= a and e < z").selectExpr("shard", "slot", "rank", "n + e - a q")
    return kept.unionAll(moved)


def permuted(x: str, n: str, rank: str, epoch: str, rounds: int = ROUNDS) -> str:
    """SQL for the swap-or-not shuffle of x in [0, n) with keys of source and epoch."""
    key = draw("i * 104729", f"{rank} * 31 + {epoch} + 3")
    other = f"(({key}) % {n} + {n} - x) % {n}"
    swap = draw(f"greatest(x, {other})", f"i * 1009 + {rank} * 7 + {epoch} + 4") + " % 1024 < 512"
    return f"aggregate(sequence(0L, {rounds - 1}L), cast({x} as bigint), (x, i) -> if({swap}, {other}, x))"


def mix_slots(by: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix: (shard, slot, rank, epoch, block, take), each slot with its source's block and the words it takes of it."""
    own = _drawn(by, shard).join(by.select("rank", "source_size", "goal", "whole", "blocks"), "rank")
    own = own.selectExpr("*", "q div blocks epoch", "q % blocks r")
    own = own.withColumn("block", F.expr(f"if(r < whole, {permuted('r', 'whole', 'rank', 'epoch')}, r)"))
    words = f"least(if(r < whole, {block}, source_size % {block}), goal - epoch * source_size - r * {block})"
    return own.selectExpr("shard", "slot", "rank", "epoch", "block", f"{words} take")


def _taken_pieces(place: DataFrame, by: DataFrame, block: int, shard: int) -> DataFrame:
    """Of each document with words and each slot that reads it: (rank, begin, shard, slot, epoch, first word, words)."""
    pieces = place.filter("size > 0").select("rank", "begin", "size", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")).alias("block"))
    pieces = pieces.selectExpr("rank", "begin", "block", f"greatest(begin, block * {block}) a", f"least(begin + size, (block + 1) * {block}) z")
    met = pieces.join(mix_slots(by, block, shard), ["rank", "block"])
    met = met.selectExpr("rank", "begin", "shard", "slot", "epoch", "a - begin first", f"least(z, block * {block} + take) - a words")
    return met.filter("words > 0")


def _placed(docs: DataFrame, doc_id: str, text: str, source: str, block: int, how: dict) -> tuple[DataFrame, DataFrame]:
    """(located() rows, plan)."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), sizes(text).alias("size"))
    sized = materialise(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    by = materialise(plan(sized, block, **how), "plan")
    return materialise(located(sized, by), "located"), by


def mixed_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard: int = SHARD, **how) -> DataFrame:
    """(shard, slot, source, doc_id, first, words): what each slot of each output shard reads, words ``first`` (from 0) and on
    of a document. Sorted by shard, slot and order in the block, this is the mix."""
    place, by = _placed(docs, doc_id, text, source, block, how)
    met = _taken_pieces(place, by, block, shard).join(place.filter("size > 0").select("rank", "begin", "source", "doc_id"), ["rank", "begin"])
    return met.select("shard", "slot", "source", "doc_id", "begin", "first", "words")


def taken_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard: int = SHARD, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    place, by = _placed(docs, doc_id, text, source, block, how)
    taken = _taken_pieces(place, by, block, shard).groupBy("rank", "begin").agg(F.sum("words").alias("taken"))
    with_words = place.filter("size > 0").join(taken, ["rank", "begin"], "left")
    columns = ["doc_id", "size", "source_size", "target"]
    return with_words.select(*columns, F.coalesce("taken", F.lit(0)).alias("taken")).unionAll(place.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", block: int = BLOCK, shard: int = SHARD, **how) -> DataFrame:
    """The mix as rows like those of docs: one for each epoch that reads a document, with the words it takes.

    A text that is taken whole stays as it is; of others, the words taken with the white space before each.
    """
    own = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # whatever the columns are called, ours don't clash
    base = docs.toDF(*own.values()).withColumns({"size": sizes(own[text]), "row": F.monotonically_increasing_id()})
    base = materialise(base, "sized")
    names = base.select("row", F.col(own[doc_id]).alias("doc_id"), F.col(own[source]).alias("source"), "size")
    by = materialise(plan(names, block, **how), "plan")
    place = materialise(located(names, by).select("row", "size", "rank", "begin"), "located")
    pieces = _taken_pieces(place, by, block, shard).groupBy("rank", "begin", "epoch").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts"))
    epochs = place.filter("size > 0").join(pieces, ["rank", "begin"]).groupBy("row").agg(F.collect_list(F.struct("epoch", "parts")).alias("epochs"))
    met = base.join(epochs, "row").select(*own.values(), "size", F.explode("epochs").alias("e"))
    met = met.withColumn("count", F.aggregate("e.parts", F.lit(0).cast("long"), lambda n, p: n + p["words"]))
    tokens = F.regexp_extract_all(F.col(own[text]), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.flatten(F.transform("e.parts", lambda p: F.slice(F.col("tokens"), (p["first"] + 1).cast("int"), p["words"].cast("int"))))
    met = met.withColumn("tokens", F.when(F.col("count") < F.col("size"), tokens))
    whole = F.when(F.col("count") < F.col("size"), F.array_join(part, "")).otherwise(F.col(own[text]))
    return met.withColumn(own[text], whole).select(*[F.col(v).alias(c) for c, v in own.items()])


def oracle(block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, rounds: int = ROUNDS) -> str:
    """DuckDB's SQL for taken_words() of table documents."""
    shuffle = ["s0 as (select *, q // blocks epoch, q % blocks r, q % blocks x from slot)"]
    for i in range(rounds):
        key = draw(f"{i} * 104729", "rank * 31 + epoch + 3")
        shuffle.append(f"o{i} as (select *, case when r < whole then ({key} % whole + whole - x) % whole end other from s{i})")
        swap = draw("greatest(x, other)", f"{i} * 1009 + rank * 7 + epoch + 4")
        shuffle.append(f"s{i + 1} as (select * exclude (x, other), case when r < whole and {swap} % 1024 < 512 then other else x end x from o{i})")
    return f"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) size from documents),
s as (select source, cast(sum(size) as bigint) source_size from sized group by source),
r as (select *, row_number() over (order by source nulls last) - 1 rank from s),
w as (select *, cast(list_extract([{', '.join(f'{x}.0' for x in weights)}], cast(rank % {len(weights)} + 1 as bigint)) as double) weight, {most} * cast(source_size as double) cap from r),
l as (select *, cap / weight ratio, (cast({share} as double) * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) level from w),
f as (select * exclude (level), (select level from l where level <= ratio order by ratio, rank limit 1) level from l),
p as (select *, coalesce(least(cap, level * weight), cap) target from f),
g as (select *, cast(floor(target + 0.5) as bigint) goal, source_size // {block} whole, source_size // {block} + (case when source_size % {block} > 0 then 1 else 0 end) blocks from p),
slot as (select *, unnest(range(0, case when source_size = 0 then 0 else (goal // source_size) * blocks + (goal % source_size + {block - 1}) // {block} end)) q from g),
{', '.join(shuffle)},
took as (select rank, x block, least(case when r < whole then {block} else source_size % {block} end, goal - epoch * source_size - r * {block}) take from s{rounds}),
placed as (select d.doc_id, d.size, g.rank, g.source_size, g.target, row_number() over () id,
  coalesce(sum(d.size) over (partition by g.rank order by {draw('coalesce(d.doc_id, 0) + d.size * 7919', '1')}, d.doc_id nulls last, d.size rows between unbounded preceding and 1 preceding), 0) b
  from sized d join g on d.source is not distinct from g.source),
piece as (select *, unnest(range(cast(b // {block} as bigint), cast((b + size - 1) // {block} + 1 as bigint))) block from placed where size > 0),
got as (select id, sum(greatest(0, least(b + size, (piece.block + 1) * {block}, piece.block * {block} + take) - greatest(b, piece.block * {block}))) taken
  from piece join took on piece.rank = took.rank and piece.block = took.block group by id)
select doc_id, cast(size as bigint) size, source_size, target, cast(coalesce(taken, 0) as bigint) taken from placed left join got on placed.id = got.id"""
