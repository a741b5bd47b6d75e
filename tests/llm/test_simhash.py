import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash


def brute(fps):
    """Least index reachable over links at two bits or fewer."""
    root = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    return root


@pytest.mark.parametrize("hot", [256, 1])
def test_links_are_all_pairs(spark, hot):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)} | {0}
    for x in list(fps)[:25]:
        fps |= {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(6)}
        fps |= {x ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32, 64)) for _ in range(3)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = {(r.x, r.y) for r in simhash.links(df, hot).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert found == want


@pytest.mark.parametrize("small", [simhash.SMALL, 0])
def test_components_of_a_chain(spark, small):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 103), (200, 150), (7, 7)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "x long, y long"), small=small).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100, 150: 150, 200: 150}
    assert simhash.components(spark.createDataFrame([], "x long, y long"), small=small).count() == 0
    rng = random.Random(small)
    some = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    root = list(range(300))
    for _ in range(300):
        for a, b in some:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(some, "x long, y long"), small=small).collect()}
    assert got == {n: root[n] for n in {n for e in some if e[0] != e[1] for n in e}}


def fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(spark):
    base = " ".join(f"w{i * 37 % 101}" for i in range(400))
    texts = [base, base.upper().replace("W", "w"), base + " tail", "A b", "a  B\n", None, "", " \t", "É é x y z", base, "other words altogether here", "x" * 100_000]
    df = spark.createDataFrame([(i * 2 + 5, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    rows = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = [fingerprint(t) for t in texts]
    assert [int(rows[i * 2 + 5].fingerprint, 16) for i in range(len(texts))] == fps
    assert [rows[i * 2 + 5].component_id for i in range(len(texts))] == [r * 2 + 5 for r in brute(fps)]
    assert all(len(r.fingerprint) == 16 for r in rows.values())


def test_odd_ids(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    rows = simhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_majority():
    assert simhash.majority_bits(np.array([0b110, 0b100], "u8")) == 0b100
    assert simhash.majority_bits(np.array([], "u8")) == 0
