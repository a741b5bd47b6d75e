"""Approximate nearest neighbours by multi-index hashing.

Codes. Vectors are centred, brought to their principal axes, and turned by BITS / d stacked rotations, the first
learned by iterative quantisation, the others from random ones; signs give BITS bits. It is fitted on at most SAMPLE
rows (those of least hash), but every row is indexed.

Index. A code is cut into BITS / 8 substrings of a byte, each with its own table: for each of the 256 values, the rows
of a block whose substring is within the substring radius, as a bitset. By the pigeonhole principle a code within
``radius`` of the query is within radius // substrings in one substring, so the union of one bitset a table holds
every such code; it is filtered by whole distance and the rest ranked by inner product on the original vectors.

The radius is the TRUST quantile of the distances of true neighbours within the sample. The sample is no denser than
the table, so its neighbours are no nearer: the radius errs to the large side as the table grows. A query that has
fewer than k rows within the radius in the whole table, however that is cut into blocks, is asked again with the
radius at the whole code, which reaches every row.

A stated query set meets all rows, in blocks of G x S cells with a partition each. Vectors that are null, zero, or hold
null or non-finite components take no part, nor do rows without id. Vectors of different lengths have no inner product:
each length is a search of its own. Repeated ids are rows of their own: a row isn't its own neighbour, but other rows
with its id are. Ties go to the smaller id. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

BITS, SAMPLE, PROBES, ROUNDS, TRUST, K = 256, 4096, 256, 20, 0.97, 20
ROWS_BLOCK, QUERIES_BLOCK, QUERY_PACK, BLOCK_BYTES = 16384, 1024, 256, 1 << 24
FOUND = "query long, query_id long, vec_id long, score double"
_NEAR = np.bitwise_count(np.arange(256, dtype="u1")[:, None] ^ np.arange(256, dtype="u1"))


class Codes:
    """The learned map from vectors to codes."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, seed: int = 7):
        rng, d = np.random.default_rng(seed), sample.shape[1]
        self.mean = sample.mean(0)
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        self.turns = []
        for k in range(-(-bits // d)):
            turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(ROUNDS if k == 0 else 0):
                u, _, v = np.linalg.svd(np.where(centred @ axes @ turn > 0, 1.0, -1.0).T @ (centred @ axes))
                turn = (u @ v).T
            self.turns.append(axes @ turn)
        self.turns, self.bits = np.concatenate(self.turns, 1)[:, :bits], bits

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.mean) @ self.turns > 0, axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between rows of two equally long lists of codes."""
    return np.bitwise_count(a.view("u8") ^ b.view("u8")).sum(-1, dtype="i4")


def fit(sample: np.ndarray, k: int = K, bits: int = BITS, trust: float = TRUST) -> tuple[Codes, int]:
    """The codes and the radius. Copies say nothing of how far neighbours are, so each vector counts once."""
    sample = np.unique(sample, axis=0)
    codes = Codes(sample, bits)
    packed = codes.of(sample)
    probes = np.arange(0, len(sample), max(1, len(sample) // PROBES))
    inner = sample[probes] @ sample.T
    inner[np.arange(len(probes)), probes] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return codes, bits
    best = np.argpartition(-inner, k - 1, axis=1)[:, :k]
    near = distances(np.repeat(packed[probes], k, 0), packed[best.ravel()])
    return codes, int(np.quantile(near, trust, method="higher"))


class Index:
    """A block of rows, with a table of bitsets for each substring."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, packed: np.ndarray, radius: int):
        self.rows, self.ids, self.vectors, self.packed, self.radius = rows, ids, vectors, packed, radius
        within = radius // packed.shape[1]
        self.tables = [np.packbits(_NEAR[:, column] <= within, axis=1) for column in packed.T]

    def candidates(self, code: np.ndarray) -> np.ndarray:
        """Rows within the radius of a code, found by probing every table."""
        union = self.tables[0][code[0]].copy()
        for table, value in zip(self.tables[1:], code[1:]):
            union |= table[value]
        probed = np.unpackbits(union, count=len(self.ids)).view("?")
        if 4 * np.count_nonzero(probed) > len(probed):  # of so many, distances are faster without fetching rows
            return np.flatnonzero(probed & (distances(self.packed, code[None]) <= self.radius))
        found = np.flatnonzero(probed)
        return found[distances(self.packed[found], code[None]) <= self.radius]

    def search(self, row: int, vector: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row ids, scores) of a query's k best of this block, without the row that it is itself."""
        found = self.candidates(code)
        found = found[self.rows[found] != row]
        if len(found) > k:
            rough = self.vectors[found] @ vector  # rounded by blocks of rows, so equal rows may differ by a little
            least = np.partition(rough, len(rough) - k)[len(rough) - k]
            found = found[rough >= least - 1e-9 * max(1.0, abs(least))]
        score = np.einsum("ij,ij->i", self.vectors[found], np.broadcast_to(vector, (len(found), len(vector))))
        order = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found[order]], score[order]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    return own.filter(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.empty((0, 0))


PACK = "p int, rows binary, ids binary, vectors binary"


def _packs(block: int):
    """Rows (p, n, id, v), sorted by p, as PACK rows of up to ``block`` rows of one p."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            p, at = t["p"].to_numpy(), 0
            while at < len(p):
                end = min(at + block, int(np.searchsorted(p, p[at], "right")))
                if not last and end == len(p) and end - at < block:
                    break  # its p may go on in the next batch
                part = t.slice(at, end - at)
                cells = [int(p[at]), part["n"].to_numpy().tobytes(), part["id"].to_numpy().tobytes(), _matrix(part["v"].combine_chunks()).astype("f8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["p", "rows", "ids", "vectors"])
                at = end
            held[:] = t.slice(at).to_batches()

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= block:
                yield from out(False)
        if held:
            yield from out(True)

    return pack


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(row["rows"], "i8")
    return rows, np.frombuffer(row["ids"], "i8"), np.frombuffer(row["vectors"], "f8").reshape(len(rows), -1)


def _packed(df: DataFrame, groups: int, block: int, name: str) -> DataFrame:
    dealt = df.withColumn("p", F.pmod(F.xxhash64("n"), F.lit(groups)).cast("int")).repartition(groups, "p").sortWithinPartitions("p", "n")
    return materialise(dealt.select("p", "n", "id", "v").mapInArrow(_packs(block), PACK), name)


def _met(rows: DataFrame, g: int, queries: DataFrame, s: int, shared, radius: int | None, k: int) -> DataFrame:
    """FOUND: the k best of each query in each block. Rows in G groups and queries in S groups meet in G x S cells, as in
    a blocked matrix product: each row travels S times, each query G times."""
    asked = _packed(queries, s, QUERY_PACK, "query_packs").selectExpr(f"explode(sequence(0, {g - 1})) g", "p s", "1 kind", "rows", "ids", "vectors")
    here = rows.selectExpr("p g", f"explode(sequence(0, {s - 1})) s", "0 kind", "rows", "ids", "vectors")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, fitted = shared.value
        at, blocks = None, []
        for b in batches:
            for row in b.to_pylist():
                if row["cell"] != at:
                    at, blocks = row["cell"], []
                ns, ids, vs = _unpack(row)
                packed = codes.of(vs)
                if not row["kind"]:
                    blocks.append(Index(ns, ids, vs, packed, fitted if radius is None else radius))
                    continue
                for index in blocks:
                    best = [index.search(n, v, c, k) for n, v, c in zip(ns.tolist(), vs, packed)]
                    many = [len(near) for near, _ in best]
                    columns = [np.repeat(ns, many), np.repeat(ids, many), *(np.concatenate(x) for x in zip(*best))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "query_id", "vec_id", "score"])

    cells = here.unionAll(asked).withColumn("cell", F.expr(f"g * {s} + s"))
    return cells.repartitionById(g * s, "cell").sortWithinPartitions("cell", "kind").mapInArrow(search, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """FOUND with ``rank``: the k best of each query."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _nearest(own: DataFrame, is_query: Column, k: int, bits: int, trust: float, rows_block: int, queries_block: int) -> DataFrame:
    """nearest() of rows (n, id, v) whose vectors are equally long."""
    spark = own.sparkSession
    sample = own.orderBy(F.xxhash64("id", "n"), "n").limit(SAMPLE).select("v").toArrow()  # bounded by SAMPLE
    vectors = _matrix(sample["v"].combine_chunks())
    shared = spark.sparkContext.broadcast(fit(vectors, k, bits, trust))  # a few square matrices
    queries, total = own.filter(is_query), own.count()
    rows_block = min(rows_block, max(1, BLOCK_BYTES // (8 * vectors.shape[1])))
    g = -(-total // rows_block)
    groups = lambda df: max(1, -(-df.count() // queries_block))
    rows = _packed(own, g, rows_block, "row_packs")
    found = materialise(_ranked(_met(rows, g, queries, groups(queries), shared, None, k), k), "found")
    enough = found.filter(F.col("rank") == min(k, total - 1)).select(F.col("query").alias("n"))
    lonely = materialise(queries.join(enough, "n", "left_anti"), "lonely") if total > 1 else queries.limit(0)
    if not lonely.isEmpty():
        again = _ranked(_met(rows, g, lonely, groups(lonely), shared, bits, k), k)
        found = found.join(enough.withColumnRenamed("n", "query"), "query", "left_semi").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", bits: int = BITS, trust: float = TRUST, rows_block: int = ROWS_BLOCK, queries_block: int = QUERIES_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by inner product; ``is_query`` is on column id."""
    spark = vectors.sparkSession
    own = materialise(usable(vectors, vec_id, embedding).withColumn("n", F.monotonically_increasing_id()), "vectors")
    lengths = sorted(r[0] for r in own.select(F.size("v")).distinct().collect())  # a number for each dimension in use
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionAll, [_nearest(own.filter(F.size("v") == n), is_query, k, bits, trust, rows_block, queries_block) for n in lengths])
