import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import similar_texts as st
from lodestone.llm.simhash import components, majority_bits, shingle_hashes


def corpus():
    """Groups of near copies at many similarities, and texts of their own."""
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = [text(rng.randint(30, 500)) for _ in range(60)]
    for base in rows[:30]:
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, len(own) // 60 + 1)):
                own[rng.randrange(len(own))] = "edit"
            rows.append(own)
    return [" ".join(r) for r in rows]


def groups(texts):
    """Components over all pairs at 0.8, and over all at 0.7."""
    sets = [set(shingle_hashes(t, 5).tolist()) for t in texts]
    out = []
    for least in (0.8, 0.7):
        root = list(range(len(texts)))
        find = lambda i: i if root[i] == i else find(root[i])  # noqa: B023, E731
        for i in range(len(texts)):
            for j in range(i):
                union = len(sets[i] | sets[j])
                if not union or len(sets[i] & sets[j]) / union >= least:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        out.append([find(i) for i in range(len(texts))])
    return out


@pytest.mark.parametrize("crowd", [200, 2])
def test_one_of_each_group_stays(spark, crowd):
    texts = corpus() + [None, "", "a b", "a b", "a c"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bits string")
    kept = {r.doc_id for r in st.keep_one(df, crowd=crowd).collect()}
    tight, loose = groups(texts)
    # whatever is less alike than 0.7 stays; of what is 0.8 alike, all but a few in a hundred leave one
    assert {i for i, r in enumerate(loose) if r == i} <= kept
    assert len(kept) - len(set(tight)) <= 0.02 * len(texts)
    assert {0, 1, 2} <= kept and sum(i in kept for i in range(len(texts) - 5, len(texts))) == 3


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "z"), (2, "long " * 60_000)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text[:5]) for r in st.keep_one(df).collect()) == [("1", "a b c"), ("2", "long "), ("None", "z")]
    assert st.keep_one(df.limit(0)).count() == 0


def edited(edits, n=150):
    """Pairs of texts of 200 shingles, where so many edits change five shingles each."""
    rng, out = random.Random(edits), []
    for i in range(n):
        base = [f"t{i}w{j}" for j in range(204)]
        own = list(base)
        for j in rng.sample(range(1, 39), edits):
            own[5 * j] = f"edit{j}"
        out += [" ".join(base), " ".join(own)]
    return out


def kept_of(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in st.keep_one(df, **more).collect()}


@pytest.mark.parametrize("crowd", [200, 2])
def test_every_link_at_the_threshold_is_found(spark, crowd):
    texts = edited(4) + corpus()  # 180 of 220 shingles, 0.818
    tight, _ = groups(texts)
    assert kept_of(spark, texts, crowd=crowd) == set(tight)


def test_nothing_below_the_threshold_goes(spark):
    texts = edited(5)  # 175 of 225 shingles, 0.778
    assert kept_of(spark, texts) == set(range(len(texts)))


def test_short_texts_like_brute_force(spark):
    """Texts of 5 to 15 words, with a word appended, taken off the front or changed at an end or inside."""
    rng, texts = random.Random(15), []
    for i in range(300):
        base = [f"s{i}w{j}" for j in range(rng.randint(5, 15))]
        at = rng.randrange(len(base))
        texts += [" ".join(x) for x in (base, rng.choice([[*base, "x"], base[1:], [*base[:-1], "x"], [*base[:at], "x", *base[at + 1 :]]]))]
    tight, _ = groups(texts)
    assert kept_of(spark, texts) == set(tight) and len(set(tight)) < len(texts) - 50
    assert all(len(st.keys(st.shingle_set(t))) <= 3 for t in texts)  # few enough to be prefixes


def test_simhash_links_by_itself(spark):
    """Where no MinHash key is shared, the groups are those of fingerprints within two bits, verified."""
    rng, texts = random.Random(12), []
    for i in range(12):
        base = [f"v{i}w{rng.randrange(10**6)}" for _ in range(3000)]
        for at in (None, 0, 1500):
            texts.append(" ".join("edit" if j == at else w for j, w in enumerate(base)))
    texts += ["", "a b", "c d e f g h"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = st.distinct_sets(st.signatures(docs)).withColumn("id", F.col("least.doc_id")).withColumn("keys", F.array("id"))
    got = {(r.node, r.root) for r in components(st.links(docs, nodes)).collect()}
    fps = [majority_bits(st.shingle_set(t)) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if (fps[a] ^ fps[b]).bit_count() <= 2:  # all within one base, so 0.99 alike
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    grouped = [i for i, r in enumerate(root) if root.count(r) > 1]
    assert got == {(i, root[i]) for i in grouped} and len(grouped) > 10


def test_sets_of_one_fingerprint_meet(spark):
    """Different sets of equal fingerprints are verified like any: 0.8 alike links, less doesn't."""
    base = " ".join(f"w{i}" for i in range(104))
    texts = [base, base + " x", " ".join(f"v{i}" for i in range(104)), "y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = st.distinct_sets(st.signatures(docs)).withColumns({"id": F.col("least.doc_id"), "fp": F.lit(5).cast("long")}).withColumn("keys", F.array("id"))
    assert [(r.x, r.y) for r in st.links(docs, nodes).collect()] == [(0, 1)]
