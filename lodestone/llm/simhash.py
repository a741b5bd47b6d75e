"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments A and B. Two fingerprints at distance d <= 2 differ in
(dA, dB) bits with dA + dB <= 2, so one segment differs by one bit at most and exactly one of these holds:

* dA = 0: they share A, and B differs by 1 or 2 bits (key: A whole);
* dB = 0: they share B, and A differs by 1 or 2 bits (key: B whole);
* dA = dB = 1: they share a variant of A with one wildcard bit (32 keys), one with that bit 0, one with 1.

Keys are joined by equality and the pairs verified with bit_count(xor). Copies collapse to one fingerprint before
any key is made. Buckets of more than ``hot`` fingerprints are not joined: their members get variants with all
differing bits as wildcards instead (each such bucket holds four fingerprints at most), which is exact and linear.

Nulls and empty texts have fingerprint zero and link like any other; a null doc_id is carried through and never
chosen as a component's smallest id unless its whole component has none. Repeated rows are returned as often. Other
columns, whatever their names, are left out. components() raises RuntimeError if its rounds don't suffice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bound_batches, clear, made, materialise

SEED = 42
#: Edges that one task unites: a few MB.
SMALL = 200_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of so many words; of the whole sequence if it is shorter; nothing without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    if not w:
        return np.empty(0, "u8")
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], "u8")
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(x), SEED) for x in zip(*(w[i:] for i in range(words)))), "u8", len(w) - words + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes. Blocks bound the memory for very long texts."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, "i8")
    for i in range(0, len(hashes), 1 << 16):
        block = hashes[i : i + (1 << 16)].astype(">u8").view("u1").reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(0, dtype="i8")
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """docs with a column ``fp``: the fingerprint's 64 bits as a long."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([majority_bits(shingle_hashes(t, words)) for t in batch], "u8").view("i8"))

    return docs.withColumn("fp", of(F.col(text)))


def _distance(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def _opposite_pairs(keyed: DataFrame) -> DataFrame:
    """Pairs of rows that share ``key`` and have opposite ``side``s."""
    left = keyed.filter("side = 0").select("key", F.col("fp").alias("x"))
    right = keyed.filter("side = 1").select("key", F.col("fp").alias("y"))
    return left.join(right, "key").select("x", "y")


def _whole_keys(fps: DataFrame) -> DataFrame:
    """Keys 0 (segment A) and 1 (segment B), each with the segment below."""
    return fps.selectExpr("fp", "explode(array(shiftrightunsigned(fp, 32), shiftleft(1L, 32) | (fp & 4294967295L))) key")


def _wild_keys(fps: DataFrame) -> DataFrame:
    """Keys 2 to 33: segment A with one wildcard; side is the bit that it hides."""
    at = fps.selectExpr("fp", "explode(sequence(32, 63)) p").selectExpr("fp", "p", "shiftleft(1L, p) b")
    return at.selectExpr("fp", "shiftleft(p - 30L, 32) | shiftrightunsigned(fp & ~b, 32) key", "if((fp & b) != 0, 1, 0) side")


def links(fps: DataFrame, hot: int = 256) -> DataFrame:
    """All pairs (x < y as longs) of distinct fingerprints (column ``fp``, unique) at distance 1 or 2."""
    whole, wild = _whole_keys(fps), _wild_keys(fps)
    keys = whole.select("key").unionAll(wild.select("key"))
    crowded = materialise(keys.groupBy("key").count().filter(F.col("count") > hot).select("key"), "crowded")
    found = []
    if not crowded.isEmpty():
        found = _crowded_links(whole, wild, crowded)
        whole, wild = (x.join(crowded, "key", "left_anti") for x in (whole, wild))
    left, right = whole.select("key", F.col("fp").alias("x")), whole.select("key", F.col("fp").alias("y"))
    near = left.join(right, "key").filter((F.col("x") < F.col("y")) & (_distance("x", "y") <= 2)).select("x", "y")
    near = near.unionAll(_opposite_pairs(wild).filter(_distance("x", "y") <= 2))
    for more in found:
        near = near.unionAll(more)
    return near.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _one_wildcard(fps: DataFrame) -> DataFrame:
    """Exact distance-1 links: all 64 bits, one of them a wildcard; two fingerprints a key at most."""
    at = fps.selectExpr("fp", "explode(sequence(0, 63)) p").selectExpr("fp", "p", "shiftleft(1L, p) b")
    return _opposite_pairs(at.selectExpr("fp", "struct(p, fp & ~b as rest) key", "if((fp & b) != 0, 1, 0) side"))


def _two_wildcards(fps: DataFrame, p: str, q: str) -> DataFrame:
    """Exact distance-2 links whose differing bits are at p < q, both SQL arrays; four fingerprints a key at most."""
    at = fps.selectExpr("fp", f"explode({p}) p").selectExpr("fp", "p", f"explode({q}) q").filter("p < q")
    at = at.selectExpr("fp", "p", "q", "shiftleft(1L, p) bp", "shiftleft(1L, q) bq")
    alike = "if(((fp & bp) != 0) = ((fp & bq) != 0), 1, 0) as alike"
    return _opposite_pairs(at.selectExpr("fp", f"struct(p, q, {alike}, fp & ~bp & ~bq as rest) key", "if((fp & bp) != 0, 1, 0) side"))


def _crowded_links(whole: DataFrame, wild: DataFrame, crowded: DataFrame) -> list[DataFrame]:
    """Links inside crowded buckets, without comparing all their members to each other."""
    low, high, a = "sequence(0, 31)", "sequence(32, 63)", F.shiftrightunsigned("key", 32) == 0
    inside = whole.join(crowded, "key", "left_semi")
    same_a, same_b = inside.filter(a).select("fp").distinct(), inside.filter(~a).select("fp").distinct()
    mixed = wild.join(crowded, "key", "left_semi").select("fp").distinct()
    return [_one_wildcard(inside.select("fp").distinct()), _two_wildcards(same_a, low, low), _two_wildcards(same_b, high, high), _two_wildcards(mixed, low, high)]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of one task."""
    above: dict = {}

    def find(node):
        while (up := above.setdefault(node, node)) != node:
            above[node] = node = above[up]  # each look shortens the way
        return node

    kind = None
    for b in batches:
        kind = b.schema.field("x").type
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
            x, y = find(x), find(y)
            above[max(x, y)] = min(x, y)
    if above:
        yield pa.RecordBatch.from_arrays([pa.array(list(above), kind), pa.array([find(n) for n in list(above)], kind)], ["node", "root"])


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, root) for every node of ``edges`` (x, y: any orderable type); root: the smallest node reachable.

    Up to ``small`` edges, a number that doesn't grow with the input, are united in one task. More of them take
    alternating large-star and small-star rounds; each is cut with a table in the shared folder, and the round before
    deleted. Neither edges nor nodes reach the driver, only the count and a checksum by which a fixed point is seen.
    Rounds grow with the square of the logarithm of the longest chain at most; RuntimeError after ``most_rounds``.
    """
    since = made()
    edges = materialise(edges.filter("x <> y").selectExpr("least(x, y) x", "greatest(x, y) y").distinct(), name)
    if edges.count() <= small:
        kind = edges.schema["x"].dataType.simpleString()
        found = materialise(edges.coalesce(1).mapInArrow(_united, f"node {kind}, root {kind}"), name)
        clear(edges.sparkSession, since, -1)
        return found
    seen = None
    for _ in range(most_rounds):
        both = edges.select("x", "y").unionAll(edges.selectExpr("y x", "x y"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).selectExpr("x", "least(x, m) m")
        large = both.filter("y > x").join(least, "x").selectExpr("m x", "y").filter("x <> y").distinct()
        down = large.selectExpr("greatest(x, y) x", "least(x, y) y")
        root = down.groupBy("x").agg(F.min("y").alias("m"))
        nearer = down.join(root, "x").filter("y <> m").selectExpr("y a", "m b").unionAll(root.selectExpr("x a", "m b"))
        edges = materialise(nearer.selectExpr("least(a, b) x", "greatest(a, b) y").filter("x <> y").distinct(), name)
        clear(edges.sparkSession, since, -1)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.xxhash64("x", "y").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if state == seen:
            return edges.selectExpr("y node", "x root").unionAll(edges.selectExpr("x node", "x root").distinct())
        seen = state
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, hot: int = 256) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; components of fingerprints at 2 or fewer differing bits."""
    bound_batches(docs.sparkSession)
    with_fp = materialise(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words).select("doc_id", "fp"), "fingerprints")
    least = with_fp.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(with_fp.select("fp").distinct(), hot))
    rooted = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = rooted.join(smallest, "root").select("fp", "component_id")
    return with_fp.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
