import random
import re

import duckdb
import pytest

from lodestone.llm import mixing


def documents(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "é", None, "z"])
        text = rng.choice([None, "", " \t", None]) if rng.random() < 0.05 else "".join(rng.choice([" ", "\n", "  "]) + f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 400)))
        rows.append((i, text, source))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", 1, 2) for r in rows], "doc_id long, text string, source string, lang string, size int, taken int")


def sizes(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(by):
    """Reshare until none is above its cap."""
    weights = dict(zip(sorted(by, key=lambda s: (s is None, s or "")), (mixing.WEIGHTS * len(by))[: len(by)]))
    total, capped = 1.5 * sum(by.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in capped}
        left = total - sum(capped.values())
        got = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: 2.0 * by[s] for s in got if got[s] > 2 * by[s]}
        if not over:
            return capped | got
        capped |= over


def run(spark, rows, **how):
    return sorted(mixing.taken_words(frame(spark, rows), **how).collect(), key=lambda r: (r.doc_id is None, r.doc_id))


@pytest.mark.parametrize(("block", "shard"), [(256, 4096), (16, 7)])
def test_targets_are_met(spark, block, shard):
    rows = documents(300, 2)
    got = run(spark, rows, block=block, shard=shard)
    by = {}
    for _, t, s in rows:
        by[s] = by.get(s, 0) + sizes(t)
    want = targets(by)
    taken = {s: 0 for s in by}
    for r, (i, t, s) in zip(got, rows):
        assert (r.doc_id, r.size, r.source_size) == (i, sizes(t), by[s])
        assert r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in by)
    assert got == run(spark, list(reversed(rows)), block=block, shard=shard)


def test_like_sql(spark):
    rows = documents(200, 3)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    want = sorted(con.execute(mixing.oracle()).fetchall())
    assert [tuple(r) for r in run(spark, rows)] == want


def test_shuffle_is_a_permutation(spark):
    for n in (1, 2, 7, 500):
        df = spark.range(n).selectExpr("id", f"{n}L n", "3L rank", "1L epoch")
        found = sorted(r[0] for r in df.selectExpr(mixing.permuted("id", "n", "rank", "epoch")).collect())
        assert found == list(range(n))


def test_slots_settle_to_their_totals(spark):
    by = spark.createDataFrame([(0, 1000), (1, 10), (2, 0), (3, 333)], "rank long, slots long")
    rows = mixing._drawn(by, 50).collect()
    found = {}
    for r in rows:
        found.setdefault(r.rank, []).append(r.q)
    assert {k: sorted(v) for k, v in found.items()} == {0: list(range(1000)), 1: list(range(10)), 3: list(range(333))}
    assert len({(r.shard, r.slot) for r in rows}) == 1343 and max(r.shard for r in rows) == 26


def test_mixed_texts(spark):
    rows = documents(120, 5) + [(7, "one two", "a"), (7, "one two", "a")]
    base = frame(spark, rows)
    out = mixing.mixed_documents(base, block=32).collect()
    assert out[0].asDict().keys() == set(base.columns)
    words = {}
    for r in out:
        words[r.doc_id, r.source] = words.get((r.doc_id, r.source), 0) + sizes(r.text)
    taken = {}
    for r, (_, _, s) in zip(run(spark, rows[:120], block=32), rows):
        taken[r.doc_id, s] = r.taken
    total = lambda w, s: sum(v for (_, x), v in w.items() if x == s)
    assert all(abs(total(words, s) - total(taken, s)) <= 9 for s in {r[2] for r in rows})
    texts = {}
    for i, t, s in rows:
        texts.setdefault((i, s), []).append(t or "")
    assert all(any(r.text in t for t in texts[r.doc_id, r.source]) or sizes(r.text) < max(map(sizes, texts[r.doc_id, r.source])) for r in out)


def test_odd_tables(spark):
    assert run(spark, []) == []
    got = run(spark, [(None, "a b", "s"), (None, "a b", "s"), (1, "", None), (2, "x " * 100_000, "t")])
    assert [r.size for r in got] == [0, 100_000, 2, 2] and sum(r.taken for r in got if r.size == 2) == 8


def test_ranges_of_equal_ids_are_split(spark):
    """A source whose doc_ids are null, and one with one id, are cut as fine as rows; nothing else changes."""
    rng = random.Random(12)
    rows = [(None if i % 3 else 7, " ".join("w" * 1 for _ in range(rng.choice([3, 3, 3, 40]))), rng.choice(["a", "a", "b"])) for i in range(600)] + documents(200, 3)
    sized = frame(spark, rows).select("doc_id", "source", mixing.sizes().alias("n")).withColumnRenamed("n", "size").withColumn("row", mixing.F.monotonically_increasing_id())
    by = mixing.plan(sized)
    key = lambda df: sorted(((r.source or "", r.begin, r.size) for r in df.collect() if r["size"]))
    fine, coarse = (mixing.located(sized, by, near_rows=n) for n in (1, 20_000))
    assert key(fine) == key(coarse)
    for source in {"a", "b", None}:
        own = sorted((r.begin, r["size"]) for r in fine.collect() if r.source == source and r["size"])
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_shards_hold_their_draws(spark):
    """Slots are whole, each shard's source counts are near the sources' shares, and pieces add up to the words taken."""
    rows = documents(300, 8)
    got = mixing.mixed_shards(frame(spark, rows), block=16, shard=50).collect()
    taken = {(r.doc_id): r.taken for r in run(spark, rows, block=16, shard=50)}
    words: dict = {}
    for r in got:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.words
    assert words == {k: v for k, v in taken.items() if v}
    slots: dict = {}
    for r in got:
        slots.setdefault((r.shard, r.slot), []).append(r)
    assert all(len({r.source for r in s}) == 1 and sum(r.words for r in s) <= 16 for s in slots.values())
    total = len(slots)
    assert sorted(slots) == [(k // 50, k % 50) for k in range(total)]
    share = sum(s[0].source == "a" for s in slots.values()) / total
    for k in range(total // 50):
        drawn = sum(slots[k, i][0].source == "a" for i in range(50))
        assert abs(drawn - 50 * share) < 4 * (50 * share * (1 - share)) ** 0.5 + 1
    assert len({tuple(slots[k, i][0].source for i in range(50)) for k in range(total // 50)}) > 1
