"""Exact removal of repeated passages by sorting suffixes.

A byte goes if a string of LENGTH bytes that covers it starts at another place too, in the same document or another.
Sorting a row for every suffix would move hundreds of times the input, so suffixes travel in runs:

1. Each suffix (cut after LENGTH bytes) has a leading token: of its GRAM-byte substrings, the one of least hash, the
   leftmost on ties. Equal suffixes have the same token at the same offset. Neighbouring suffixes with the same token
   form a run of 85 suffixes on average, kept as (token hash, digest of the run's bytes, text, place).
2. Sampled splitters range-partition the runs by (token, digest, text, place) and each bucket is sorted. Equal runs
   are neighbours; so are runs that share a token. As splitters may fall inside a token's or a run's group, no group
   has to fit a task; buckets then compare their first and last rows across their boundaries.
3. Runs that equal a neighbour are repeated as a whole. Runs that share their token only are compared by suffix: their
   bytes are range-partitioned by token again, and each bucket sorts its suffixes by multikey quicksort on eight-byte
   words, dropping each suffix as soon as it stands alone. Tokens of more than ``hot`` different runs (a frequent line
   in many contexts) are dealt out by the suffixes' digests instead.

Runs are taken as equal by 128 bits (their token's hash and their digest), texts and the suffixes of crowded tokens by
their MD5; all other suffixes are compared byte by byte.

Every stage is linear in the text. Nulls and empty texts have nothing to remove. Equal texts have equal results and
are cut in full from LENGTH bytes on, repeated rows included. Texts of any length are read in segments. Columns whose
names are those of this module's own may be in docs; ``spans`` and ``kept`` are replaced. doc_ids play no part, so they
may be null or repeated.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import bound_batches, delete_path, fresh_path, materialise, text_or_empty

LENGTH, GRAM, SEGMENT, STRETCH = 200, 32, 1 << 20, 1 << 22
RUNS = "key long, digest long, text_key binary, start long, n long"
PIECE_BYTES = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))
_STEP = {k: np.uint64(pow(0x5851F42D4C957F2D, k, 1 << 64)) for k in (1, 2, 4, 8, 16)}
_PLACE = np.uint64((1 << 24) - 1)


def find_runs(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first suffix, number of suffixes, token hash) of all runs; the pieces have under 2**24 bytes together."""
    none = np.empty(0, "i8")
    n = sum(map(len, pieces))
    if n < length:
        return none, none, none, np.empty(0, "u8")
    h = _BYTE[np.frombuffer(b"".join(pieces), "u1")]
    for k in (1, 2, 4, 8, 16):
        h = h[:-k] * _STEP[k] + h[k:]
    h = _mix(h)
    least = (h & ~_PLACE) | np.arange(len(h), dtype="u8")
    width = length - GRAM + 1
    k = 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if k < width:
        least = np.minimum(least[: k - width], least[width - k :])
    token = (least & _PLACE).astype("i8")
    ends = np.cumsum([len(p) for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])[: len(token)]
    whole = np.arange(len(token)) + length <= ends[piece]
    same = whole[1:] & whole[:-1] & (token[1:] == token[:-1])
    first = np.flatnonzero(whole & ~np.concatenate([[False], same]))
    last = np.flatnonzero(whole & ~np.concatenate([same, [False]]))
    base = (ends - [len(p) for p in pieces])[piece[first]]
    return piece[first], first - base, last - first + 1, h[token[first]]


def _segments(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, offset, bytes) of SEGMENT bytes or so; long texts overlap by one suffix less a byte."""
    group, total = [], 0
    for i, data in enumerate(texts):
        for at in range(0, max(1, len(data) - length + 1), SEGMENT):
            piece = data[at : at + SEGMENT + length - 1]
            group.append((i, at, piece))
            total += len(piece)
            if total >= SEGMENT:
                yield group
                group, total = [], 0
    if group:
        yield group


def _batch(columns: list, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names.split())


def text_runs(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """RUNS of all texts. A task reports a text twice at most, so that many copies don't crowd one token."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()  # of this task's texts; two copies tell what more would tell
        for b in batches:
            texts, keys = [], []
            for data in (t.encode() for t in b.column(0).to_pylist()):
                key = hashlib.md5(data, usedforsecurity=False).digest()
                seen[key] += 1
                if seen[key] <= 2:
                    texts.append(data)
                    keys.append(key)
            for group in _segments(texts, length):
                piece, start, n, key = find_runs([g[2] for g in group], length)
                views = [memoryview(g[2]) for g in group]
                digest = [xxhash.xxh3_64_intdigest(views[p][s : s + k + length - 1]) for p, s, k in zip(piece.tolist(), start.tolist(), n.tolist())]
                offset = np.array([g[1] for g in group], "i8")[piece]
                owner = np.array([g[0] for g in group], "i8")[piece]
                text_key = pa.array(keys, pa.binary()).take(pa.array(owner))
                yield _batch([pa.array(key.view("i8")), pa.array(np.array(digest, "u8").view("i8")), text_key, pa.array(start + offset), pa.array(n)], "key digest text_key start n")

    return docs.select(text_or_empty(text).alias("text")).filter(F.octet_length("text") >= length).mapInArrow(scan, RUNS)


INTERVAL, REQUEST, EDGE = 0, 1, 2


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each run of a sorted bucket with the one before and after it; the first and the last are edges too."""
    held, before, began = None, None, False
    for b in _then_none(batches):
        if b is not None and not b.num_rows:
            continue
        rows = [x for x in (held, b) if x is not None]
        if not rows:
            return
        t = pa.Table.from_batches(rows).combine_chunks()
        key, digest = t.column("key").to_numpy(), t.column("digest").to_numpy()
        alike_key, alike = key[1:] == key[:-1], (key[1:] == key[:-1]) & (digest[1:] == digest[:-1])
        first = before is not None and before[0] == key[0]
        prev_key = np.concatenate([[first], alike_key])
        prev = np.concatenate([[first and before[1] == digest[0]], alike])
        next_key, next_ = np.concatenate([alike_key, [False]]), np.concatenate([alike, [False]])
        done = len(key) if b is None else len(key) - 1  # the last row waits for the next batch
        equal = np.flatnonzero((prev | next_)[:done])
        asked = np.flatnonzero(((prev_key & ~prev) | (next_key & ~next_))[:done])
        edges = ([0] if not began else []) + ([len(key) - 1] if b is None else [])
        began = True
        for kind, at in ((INTERVAL, equal), (REQUEST, asked), (EDGE, np.array(edges, "i8"))):
            if len(at):
                out = t.take(pa.array(at)).add_column(0, "kind", pa.array(np.full(len(at), kind, "i4")))
                yield from out.to_batches()
        if b is not None:
            held = t.slice(len(key) - 1).to_batches()[0]
            before = (key[-2], digest[-2]) if len(key) > 1 else before


def _then_none(batches):
    yield from batches
    yield None


def _across(edges: list) -> list[tuple]:
    """What the buckets' first and last runs, in order, have in common with their neighbours in other buckets."""
    out = []
    for x, y in zip(edges[:-1], edges[1:]):
        if (x.text_key, x.start) == (y.text_key, y.start) and x.part == y.part:
            continue  # first and last of a bucket
        if x.part != y.part and x.key == y.key:
            kind = INTERVAL if x.digest == y.digest else REQUEST
            out += [(kind, r.key, r.digest, bytes(r.text_key), r.start, r.n) for r in (x, y)]
    return out


def repeated_suffixes(data: bytes, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which suffixes, cut after ``length`` bytes, equal another: multikey quicksort on words of eight bytes."""
    raw = np.frombuffer(data + bytes(8), "u1").astype("u8")
    word = raw[:-8].copy()
    for k in range(1, 8):
        word = word << np.uint64(8) | raw[k : len(raw) - 8 + k]
    alive, group = starts, np.zeros(len(starts), "i8")
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        value = word[alive + k]
        order = np.lexsort((value, group))
        alive, value, group = alive[order], value[order], group[order]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (group[1:] != group[:-1])])
        group = np.cumsum(new)
        alone = new & np.concatenate([new[1:], [True]])
        alive, group = alive[~alone], group[~alone]
        if not len(alive):
            break
    return np.sort(alive)


def _spans(starts: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Sorted suffixes as intervals [from, to)."""
    if len(starts):
        cut = np.flatnonzero(np.diff(starts) > 1)
        yield from zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + length).tolist())


def _local(length: int):
    """Intervals of repeated suffixes among pieces (key, text_key, start, piece) that are sorted by key."""

    def of(rows: list[tuple]) -> pa.RecordBatch:
        data = b"".join(r[3] for r in rows)
        base = np.cumsum([0, *(len(r[3]) for r in rows)])
        starts = np.concatenate([np.arange(b, b + len(r[3]) - length + 1) for b, r in zip(base, rows)])
        found = repeated_suffixes(data, starts, length)
        edge = np.searchsorted(found, base)  # found is sorted, so each row's are neighbours
        out = []
        for i in np.flatnonzero(np.diff(edge)).tolist():
            out += [(rows[i][1], rows[i][2] + s, rows[i][2] + e) for s, e in _spans(found[edge[i] : edge[i + 1]] - base[i], length)]
        return _batch([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64()))], "text_key a z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if total >= PIECE_BYTES and row[0] != rows[-1][0]:
                    yield of(rows)
                    rows, total = [], 0
                rows.append(row)
                total += len(row[3])
        if rows:
            yield of(rows)

    return run


def _single_suffixes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, text_key, start, piece in zip(*(c.to_pylist() for c in b.columns)):
                n = len(piece) - length + 1
                digest = [hashlib.md5(piece[i : i + length], usedforsecurity=False).digest() for i in range(n)]
                yield _batch([pa.array(digest, pa.binary()), pa.array([text_key] * n, pa.binary()), pa.array(range(start, start + n), pa.int64())], "digest text_key a")

    return run


def _pieces(docs: DataFrame, wanted: DataFrame, text: str, length: int) -> DataFrame:
    """Bytes of the wanted runs (key, text_key, start, n), once for each text."""
    by_text = wanted.groupBy("text_key").agg(F.collect_list(F.struct("key", "start", "n")).alias("runs"))
    texts = keyed_texts(docs, text).dropDuplicates(["text_key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text_key, t, runs in zip(*(c.to_pylist() for c in b.columns)):
                data = t.encode()
                out += [(r["key"], text_key, r["start"], data[r["start"] : r["start"] + r["n"] + length - 1]) for r in runs]
            yield _batch([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.binary()))], "key text_key start piece")

    return texts.join(by_text, "text_key").select("text_key", "text", "runs").mapInArrow(cut, "key long, text_key binary, start long, piece binary")


def keyed_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.unhex(F.md5(text_or_empty(text))).alias("text_key"), text_or_empty(text).alias("text"))


def repeated_intervals(docs: DataFrame, text: str = "text", length: int = LENGTH, hot: int = 4096) -> DataFrame:
    """(text_key, a, z): intervals of bytes that go, which may overlap, for each text."""
    spark = docs.sparkSession
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    where = fresh_path(spark, "runs")
    text_runs(docs, text, length).write.parquet(where)
    runs = spark.read.schema(RUNS).parquet(where)
    order = ["key", "digest", "text_key", "start"]
    compared = runs.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, f"kind int, {RUNS}")
    compared = materialise(compared.withColumn("part", F.spark_partition_id()), "compared")
    delete_path(spark, where)
    edges = compared.filter(F.col("kind") == EDGE).collect()  # two rows a bucket at most
    edges.sort(key=lambda r: (r.key, r.digest, bytes(r.text_key), r.start))
    schema = T.StructType([f for f in compared.schema.fields if f.name != "part"])
    compared = compared.drop("part").unionAll(spark.createDataFrame(_across(edges), schema))
    equal = compared.filter(F.col("kind") == INTERVAL).select("text_key", F.col("start").alias("a"), (F.col("start") + F.col("n") + length - 1).alias("z"))
    wanted = compared.filter(F.col("kind") == REQUEST).select("key", "text_key", "start", "n").distinct()
    pieces = materialise(_pieces(docs, wanted, text, length), "pieces")
    crowded = materialise(pieces.groupBy("key").count().filter(F.col("count") > hot).select("key"), "crowded")
    out = equal
    few = pieces
    if not crowded.isEmpty():
        few = pieces.join(crowded, "key", "left_anti")
        many = pieces.join(crowded, "key", "left_semi").select("key", "text_key", "start", "piece")
        single = many.mapInArrow(_single_suffixes(length), "digest binary, text_key binary, a long")
        twice = single.groupBy("digest").count().filter("count > 1").select("digest")
        out = out.unionAll(single.join(twice, "digest").select("text_key", "a", (F.col("a") + length).alias("z")))
    local = few.select("key", "text_key", "start", "piece").repartitionByRange(parts, "key").sortWithinPartitions("key")
    return _joined(out.unionAll(local.mapInArrow(_local(length), "text_key binary, a long, z long")))


def _joined(intervals: DataFrame) -> DataFrame:
    """Intervals that overlap or touch become one, within stretches of STRETCH bytes, so that a text has few of them and
    no task all of a giant's."""
    own = Window.partitionBy("text_key", "stretch").orderBy("a", "z")
    before = F.max("z").over(own.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("a") > before, F.lit(True)).cast("int")
    marked = intervals.withColumn("stretch", F.expr(f"a div {STRETCH}")).withColumn("new", new)
    island = marked.withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("text_key", "stretch", "island").agg(F.min("a").alias("a"), F.max("z").alias("z")).select("text_key", "a", "z")


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def remove(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, z in spans:
        kept.append(data[at:a])
        at = z
    return b"".join([*kept, data[at:]])


def deduplicate(docs: DataFrame, text: str = "text", length: int = LENGTH, hot: int = 4096) -> DataFrame:
    """docs with ``spans`` (array of structs a, z: removed bytes) and ``kept`` (the remaining bytes) for each row; they
    replace columns of these names."""
    docs = docs.drop("spans", "kept")
    spans = repeated_intervals(docs, text, length, hot).groupBy("text_key").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    own = [f"_{i}" for i in range(len(docs.columns))]  # whatever the columns are called, ours don't clash
    keyed = docs.toDF(*own).withColumn("_key", F.unhex(F.md5(F.coalesce(own[docs.columns.index(text)], F.lit("")))))
    joined = keyed.join(spans.withColumnRenamed("text_key", "_key"), "_key", "left").select(*own, "spans")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("z", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [merged([(x["a"], x["z"]) for x in s or []]) for s in b.column("spans").to_pylist()]
            kept = [remove((t or "").encode(), s) for t, s in zip(b.column(at).to_pylist(), found)]
            kind = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([[{"a": a, "z": z} for a, z in s] for s in found], kind), pa.array(kept, pa.binary())], names)

    return joined.mapInArrow(cut, schema)


def removed_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    cut = deduplicate(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["z"] - s["a"])
    return cut.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def whole_characters(kept: str) -> Column:
    """Bytes as a string, without those that aren't whole characters any more."""

    @F.pandas_udf("string")
    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda x: bytes(x).decode("utf-8", "ignore"))

    return decode(F.col(kept))
