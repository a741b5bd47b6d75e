import numpy as np
import pyspark.sql.functions as F
import pytest

from lodestone.llm import multi_index as mi
from tests.conftest import DATA


def exact(ids, v, query_ids, k):
    out = {}
    for q in query_ids:
        score = v @ v[list(ids).index(q)]
        out[q] = [(int(i), s) for s, i in sorted(((-s, i) for i, s in zip(ids, score) if i != q))[:k]]
    return out


def recall(rows, want):
    found = {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(found.get(q, set()) & {i for i, _ in best}) / len(best) for q, best in want.items()])


def test_recall(spark):
    df = spark.read.parquet(str(DATA / "sf0.1/embeddings.parquet"))
    rows = mi.nearest(df, F.col("id") % 20 == 0, rows_block=2000, queries_block=100).collect()
    table = df.orderBy("vec_id").toPandas()
    v = np.stack(table.embedding).astype("f8")
    want = exact(table.vec_id.tolist(), v, [i for i in table.vec_id if i % 20 == 0], 20)
    assert recall(rows, want) >= 0.9
    assert all(sorted(r.rank for r in rows if r.query_id == q) == list(range(1, 21)) for q in list(want)[:5])
    place = {i: k for k, i in enumerate(table.vec_id)}
    assert all(r.score == pytest.approx(v[place[r.query_id]] @ v[place[r.vec_id]], abs=1e-12) for r in rows[:500])


def test_clusters_and_copies(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 32))
    v = np.concatenate([centres[rng.integers(0, 30, 1500)] + 0.2 * rng.normal(size=(1500, 32)), np.repeat(centres[:1], 300, 0)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows = mi.nearest(df, F.col("id") % 20 == 0).collect()
    assert recall(rows, exact(range(len(v)), v, range(0, len(v), 20), 20)) >= 0.9


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    packed = rng.integers(0, 256, (400, 8), "u1")
    packed[200:] = packed[:200] ^ (rng.random((200, 64)) < 0.1).astype("u1").reshape(200, 8, 8).dot(1 << np.arange(8)).astype("u1")
    for radius in (9, 30):  # few rows are probed, and most
        index = mi.Index(np.arange(400), np.arange(400), np.zeros((400, 2)), packed, radius)
        near = np.bitwise_count(packed[:100, None] ^ packed[None]).sum(-1) <= radius
        assert all(index.candidates(packed[q]).tolist() == np.flatnonzero(near[q]).tolist() for q in range(100))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0]), (40, []), (8, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    found = sorted(tuple(r) for r in mi.nearest(df, F.col("id") % 20 == 0).collect())
    assert found == [(0, 1, 8, 1.0), (0, 2, 20, 1.0), (0, 3, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 8, 1.0), (20, 3, 1, 0.5)]
    assert mi.nearest(df.limit(0), F.col("id") % 20 == 0).collect() == []


def test_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(60, 4))
    v[1] = v[0]
    ids = [20, 20, *range(1, 19), *range(41, 81)][:60]  # two queries, both with id 20
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in mi.nearest(df, F.col("id") == 20, rows_block=16, queries_block=1, trust=1.0).collect())
    score = v @ v[0]
    want = []
    for own in (0, 1):
        best = sorted((-s, i) for j, (i, s) in enumerate(zip(ids, score)) if j != own)[:20]
        want += [(20, rank, i, round(-s, 12)) for rank, (s, i) in enumerate(best, 1)]
    assert got == sorted(want) and sum(r[2] == 20 for r in got) == 2


def test_lonely_queries_and_other_lengths(spark):
    """A query that has too few rows within the radius is asked again, and lengths don't meet; blocks don't matter."""
    rng = np.random.default_rng(9)
    v = [(5 * np.eye(8)[0] + 0.01 * rng.normal(size=8)).tolist() for _ in range(300)] + [(-np.eye(8)[1]).tolist()]
    rows = [*enumerate(v, 1), (1000, [1.0, 2.0]), (1001, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    lonely = [sorted((r.query_id, r.rank, r.vec_id) for r in mi.nearest(df, F.col("id").isin(301, 1000), rows_block=b, trust=0.0).collect()) for b in (16384, 40)]
    score = np.array(v) @ np.array(v[300])
    want = [(301, k, int(i) + 1) for k, i in enumerate(sorted(range(300), key=lambda i: (-score[i], i))[:20], 1)]
    assert lonely[0] == lonely[1] == [*want, (1000, 1, 1001)]


def test_one_row(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert mi.nearest(df.limit(1), F.col("id") % 20 == 0).collect() == []
