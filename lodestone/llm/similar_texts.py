"""Near-duplicates of a given similarity: SimHash and MinHash candidates, verified by the true Jaccard similarity of their shingles.

* Each set of word shingles has a SimHash of 64 bits. Those at two differing bits or fewer are met by deletion variants
  (simhash.links), without any chance; where different sets share a fingerprint, the smallest stands for it.
* At the similarity asked for, fingerprints differ by about ten bits, which no deletion variants reach. So what SimHash
  leaves apart is met by MinHash: a text's set of word shingles gives BANDS keys, each of the minima of ROWS hash functions. Two sets share a minimum
  with a chance that is their Jaccard similarity s, whatever their sizes, and are candidates if they share a key: a pair
  is missed with a chance of (1 - s ** ROWS) ** BANDS, which is 7e-10 at 0.8 and less above. Candidate search isn't exact
  in the strict sense, but at this rate a miss isn't to be expected in a thousand million pairs.
* Sets of SHORT shingles at most are found without any chance: ordered by hash, two of them share one of the first
  size - ceil(similarity * size) + 1, which are their keys. Sets near SHORT have both kinds of keys, so that every pair
  that can be similar has one kind in common.
* Every candidate pair is verified on its two whole sets; nothing is estimated and the threshold has no margin.

Equal sets collapse before any key is made. The rest is done in four steps, each of which leaves out pairs that the
links found so far connect, as groups are what is asked for:

1. Fingerprints within two bits: a pair for each link of fingerprints, and each set with the smallest of its fingerprint.
2. Each set meets the smallest set of all its buckets: a pair a set at most, which connects most near copies.
3. Each set meets the smallest set of each of its buckets.
4. Buckets that still hold several groups compare the sets of different groups, in tiles of ``crowd`` sets, each pair
   in the first bucket that it shares; a tile returns a spanning forest. Sets of a bucket's largest group aren't
   compared with each other, so a bucket of one large group and a few strays costs as many rows as it has sets.

Null and empty texts have no shingles and are alike. Texts shorter than a shingle are one shingle. Rows of one doc_id
and text are one document; of equal doc_ids with different texts, each is a document. A null doc_id stays only where
its group has no other. Other columns, whatever their names, are carried through. Groups with chains of links that
components() can't follow in its rounds raise RuntimeError; its rounds suffice for chains of 2 ** 30 links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import simhash
from lodestone.llm.common import bound_batches, materialise
from lodestone.llm.simhash import components, majority_bits, shingle_hashes

WORDS, SIMILARITY, CROWD = 5, 0.8, 256
BANDS, ROWS, SHORT = 40, 4, 40
_FLIP, _TIMES, _FOLD = (np.random.default_rng(seed).integers(0, 1 << 64, BANDS * ROWS, "u8") | np.uint64(1) for seed in (1, 2, 3))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes, in order."""
    return np.unique(shingle_hashes(text, words))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of hashes."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, "u8")
    for i in range(0, len(hashes), 256):
        least = np.minimum(least, ((hashes[i : i + 256, None] ^ _FLIP) * _TIMES).min(0))
    mixed = (least ^ (least >> np.uint64(32))) * _FOLD
    return (mixed ^ (mixed >> np.uint64(29))).reshape(BANDS, ROWS).sum(1, dtype="u8")


def keys(hashes: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Keys of which sets (ordered) of that similarity share one."""
    n = len(hashes)
    prefix = hashes[: n - int(np.ceil(similarity * n - 1e-9)) + 1 if n <= SHORT else 0]
    return np.concatenate([prefix, band_keys(hashes)]) if n >= similarity * SHORT else prefix


def reaches(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two ordered sets have that Jaccard similarity."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def signatures(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, tie, size, digest, fp, keys) of docs (doc_id, text); equal sets have equal digests. fp: the set's SimHash."""

    @F.pandas_udf("size int, digest binary, fp long, keys array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            sets = [shingle_set(t, words) for t in batch]
            fps = np.array([majority_bits(h) for h in sets], "u8").view("i8")
            own = [(len(h), xxhash.xxh3_128_digest(h.tobytes()), fp, keys(h, similarity).view("i8")) for h, fp in zip(sets, fps)]
            yield pd.DataFrame(own, columns=["size", "digest", "fp", "keys"])

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), of("text").alias("f")).select("doc_id", "tie", "f.*")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """Nodes (id, size, fp, keys, least) of signatures: one of each set, least naming its smallest document."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("least")
    one = rows.groupBy("size", "digest").agg(least, F.first("fp").alias("fp"), F.first("keys").alias("keys")).drop("digest")
    return materialise(one.withColumn("id", F.monotonically_increasing_id()), "nodes")


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, keys, shingles) of nodes (id, keys, least): the whole set, as bytes, from the text of the node's document."""

    @F.pandas_udf("binary")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingle_set(t, words).tobytes() for t in batch])

    wanted = nodes.selectExpr("id", "keys", "least.doc_id d", "least.tie t")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    met = wanted.join(texts, (F.col("t") == F.col("tie")) & F.col("d").eqNullSafe(F.col("doc_id"))).select("id", "keys", "text").dropDuplicates(["id"])
    return met.select("id", "keys", of("text").alias("shingles"))


def _sizes_fit(similarity: float) -> Column:
    """Whether sets of sizes nx and ny can reach that similarity at all."""
    return F.least("nx", "ny") >= F.lit(similarity) * F.greatest("nx", "ny") - 1e-9


def _near_fingerprints(nodes: DataFrame, similarity: float) -> DataFrame:
    """(x, y) nodes whose fingerprints differ by two bits at most, and whose sizes fit: the smallest nodes of two linked
    fingerprints, and each node with the smallest of its own."""
    fps = materialise(nodes.groupBy("fp").agg(F.min(F.struct("id", "size")).alias("hub")), "fingerprints")
    alike = nodes.join(fps, "fp").selectExpr("hub.id x", "id y", "hub.size nx", "size ny").filter("x <> y")
    hub = lambda k: fps.selectExpr(f"fp f{k}", f"hub.id {k}", f"hub.size n{k}")
    linked = simhash.links(fps.select("fp")).toDF("fx", "fy").join(hub("x"), "fx").join(hub("y"), "fy").select("x", "y", "nx", "ny")
    return alike.unionAll(linked).filter(_sizes_fit(similarity)).selectExpr("least(x, y) x", "greatest(x, y) y")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) whose sets have that similarity."""

    @F.pandas_udf("boolean")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([reaches(np.frombuffer(x, "u8"), np.frombuffer(y, "u8"), similarity) for x, y in zip(a, b)], dtype="bool")

    x, y = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "xy")
    return pairs.select("x", "y").join(x, "x").join(y, "y").filter(alike("sx", "sy")).select("x", "y")


def _tile(table: pa.Table, similarity: float) -> pa.Table:
    """Links that connect more of a tile's groups. A tile (a, b) of a bucket's parts compares a with b, or a within itself."""
    key, tile = table["key"][0].as_py(), table["tile"][0].as_py()
    ids, roots, parts = table["id"].to_numpy(), table["root"].to_numpy().copy(), table["part"].to_numpy()
    sets, keys = [np.frombuffer(s, "u8") for s in table["shingles"].to_pylist()], table["keys"].to_pylist()
    sizes, banded = np.array([len(s) for s in sets]), np.array([len(k) >= BANDS for k in keys])
    bands, out = np.array([k[-BANDS:] if len(k) >= BANDS else [0] * BANDS for k in keys]), []
    for i in range(len(ids)):
        j = np.arange(i + 1, len(ids))
        met = (roots[j] != roots[i]) & (np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]) - 1e-9)
        j = j[met & (parts[j] != parts[i])] if tile["a"] != tile["b"] else j[met]
        same = (bands[j] == bands[i]) & banded[j, None] & banded[i]
        j = j[~same.any(1) | (bands[i][same.argmax(1)] == key)]  # others meet in the first bucket that they share
        for k in j.tolist():
            if roots[i] != roots[k] and reaches(sets[i], sets[k], similarity):
                out.append((int(ids[i]), int(ids[k])))
                roots[roots == roots[k]] = roots[i]
    return pa.table({"x": pa.array([a for a, _ in out], pa.int64()), "y": pa.array([b for _, b in out], pa.int64())})


def _tiled(shared: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float, crowd: int) -> DataFrame:
    """(x, y) links inside the buckets (key, id) that hold several groups; roots: (node, root) of sets in larger groups."""
    rooted = shared.select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = materialise(rooted, "rooted")
    groups = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    several = groups.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("groups")).filter("groups > 1")
    several = several.selectExpr("key", "main.root main", f"n <= {crowd} small", f"(main.n + {crowd - 1}) div {crowd} m", f"m + (n - main.n + {crowd - 1}) div {crowd} w")
    parted = rooted.join(several, "key").withColumn("part", F.expr("if(small, 0L, if(root = main, pmod(xxhash64(id, key), m), m + pmod(xxhash64(id, key), w - m)))"))
    others = "if(small, array(0L), if(root = main, sequence(m, w - 1), sequence(0L, w - 1)))"
    tiles = parted.selectExpr("key", "id", "root", "part", f"explode(transform({others}, o -> struct(least(part, o) as a, greatest(part, o) as b))) tile")
    return tiles.join(sets, "id").groupBy("key", "tile").applyInArrow(lambda t: _tile(t, similarity), "x long, y long")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (x, y) of different groups; roots: (node, root) of sets in larger groups."""
    of = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}"))
    return pairs.join(of("x"), "x", "left").join(of("y"), "y", "left").filter(F.coalesce("rx", "x") != F.coalesce("ry", "y")).select("x", "y")


def links(docs: DataFrame, nodes: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """(x, y) links between nodes (id, size, fp, keys, least), as many as connect each group."""
    buckets = nodes.select("id", "size", F.explode("keys").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min(F.struct("id", "size")).alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = materialise(buckets.join(hubs, "key"), "shared_keys")
    near = materialise(_near_fingerprints(nodes, similarity), "near_fingerprints")
    met = shared.select("id").unionAll(near.select("x")).unionAll(near.select("y")).distinct()
    sets = materialise(shingle_sets(docs, nodes.join(met, "id", "left_semi"), words), "shingle_sets")
    found = materialise(_verified(near, sets, similarity), "simhash_links")
    stars = shared.selectExpr("hub.id x", "id y", "hub.size nx", "size ny").filter("x <> y").filter(_sizes_fit(similarity)).select("x", "y")
    first = _apart(stars, components(found, "simhash_groups")).groupBy("y").agg(F.min("x").alias("x")).select("x", "y")
    found = materialise(found.unionAll(_verified(first, sets, similarity)), "first_links")
    apart = _apart(stars, components(found, "first_groups"))
    more = _verified(apart.distinct().join(first, ["x", "y"], "left_anti"), sets, similarity)
    found = materialise(found.unionAll(more), "star_links")
    return found.unionAll(_tiled(shared, components(found, "star_groups"), sets, similarity, crowd))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """The rows of docs (doc_id, text, ...) without all but one, that of the smallest doc_id, of each near-duplicate group."""
    bound_batches(docs.sparkSession)
    rows = materialise(signatures(docs.select("doc_id", "text"), words, similarity), "signatures")
    nodes = distinct_sets(rows)
    found = materialise(links(docs, nodes, words, similarity, crowd), "links")
    rooted = nodes.select("id", "least").join(components(found), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    stay = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("_doc"), F.col("least.tie").alias("_tie"))
    own = docs.withColumn("_own", F.xxhash64("text"))
    kept = own.join(stay, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_tie")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_own"]).select(*docs.columns)
