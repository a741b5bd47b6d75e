import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import suffix_array as sa


def brute(texts, length):
    seen = Counter()
    for t in texts:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        out.append((sum(mark), len(re.findall(b"\1+", bytes(mark))), bytes(c for c, m in zip(t, mark) if not m)))
    return out


def sample():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(40), text(6)
    texts = [text(rng.randint(1, 120)) for _ in range(25)]
    texts += [f"{text(20)} {passage} {text(9)}" for _ in range(12)] + [f"{text(12)} {line} {text(12)}" for _ in range(30)]
    texts += [texts[3], texts[3], None, "", "a" * 500, "ab" * 90, passage + passage, "x" * 39, "x" * 40]
    near = text(200)
    return texts + [near[:i] + "#" + near[i + 1 :] for i in rng.sample(range(len(near)), 12)]


@pytest.mark.parametrize(("length", "hot"), [(40, 4096), (40, 0), (200, 4096)])
def test_like_brute_force(spark, length, hot):
    texts = sample()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(5)
    rows = {r.doc_id: r for r in sa.deduplicate(df, length=length, hot=hot).collect()}
    for i, (removed, spans, kept) in enumerate(brute([(t or "").encode() for t in texts], length)):
        r = rows[i]
        assert (sum(s.z - s.a for s in r.spans), len(r.spans), bytes(r.kept)) == (removed, spans, kept), i
        assert r.text == texts[i] and r.source == "x"


def test_query_columns(spark):
    df = spark.createDataFrame([(1, "b" * 300), (2, None), (2, "short")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sa.removed_bytes(df).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[0] == (1, 300, 300, 1, empty)
    assert {x[1:] for x in rows[1:]} == {(0, 0, 0, empty), (5, 0, 0, hashlib.sha256(b"short").hexdigest())}
    assert sa.removed_bytes(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "b", 5, 6)], "doc_id long, text string, spans int, kept int")
    assert sa.deduplicate(df).columns == ["doc_id", "text", "spans", "kept"]


def test_long_texts_are_read_in_segments(monkeypatch):
    monkeypatch.setattr(sa, "SEGMENT", 1000)
    rng = random.Random(1)
    data = bytes(rng.choice(b"abc") for _ in range(5000))
    covered = []
    for group in sa._segments([data, b"", b"abc"], 50):
        piece, start, n, _ = sa.find_runs([g[2] for g in group], 50)
        covered += [(group[p][0], group[p][1] + s + k) for p, s, c in zip(piece, start, n) for k in range(c)]
    assert sorted(covered) == [(0, i) for i in range(4951)]


def test_equal_suffixes_share_their_token():
    rng = random.Random(2)
    passage = bytes(rng.randrange(256) for _ in range(600))
    x, y = (bytes(rng.randrange(256) for _ in range(k)) + passage for k in (77, 330))
    piece, start, n, key = sa.find_runs([x, y])
    by_place = [{int(s) + k - cut: int(h) for p, s, c, h in zip(piece, start, n, key) if p == i for k in range(c)} for i, cut in ((0, 77), (1, 330))]
    assert all(by_place[0][k] == by_place[1][k] for k in range(401))


def test_multikey_sort():
    rng = random.Random(9)
    data = bytes(rng.choice(b"ab") for _ in range(4000))
    starts = np.arange(len(data) - 19)
    seen = Counter(data[i : i + 20] for i in starts)
    assert sa.repeated_suffixes(data, starts, 20).tolist() == [i for i in starts if seen[data[i : i + 20]] > 1]
