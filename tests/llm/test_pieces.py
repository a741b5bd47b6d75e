import functools
import itertools
import random

import numpy as np
import pytest

from lodestone.llm import pieces
from lodestone.llm.common import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


def texts():
    rng = random.Random(11)
    words = ["the", "internationalization", "naïve", "中文字", "🙂", "  ", "\n\n", "a" * 40, "=====", "x1", "▁", "été"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(25)] + ["ab" * 400, "é" * 300, "中" * 200, " " * 150]


def chunks_of(text, size):
    return [(a, min(len(text), a + size)) for a in range(0, len(text), size)]


@pytest.mark.parametrize("size", [16, 37, 200])
def test_scan_gives_the_librarys_pieces(size):
    merges, model = pieces.merges_of(PATH), pieces.load(PATH)
    for text in texts():
        plain = model.normalize(text)
        spans = chunks_of(plain, size)
        own = [pieces.transfer(merges, plain, a, b) for a, b in spans]
        whole = functools.reduce(pieces.combine, own)
        start = {(0, ""): (0.0, None)}
        leave = [s for s in pieces.through(start, whole) if s[0] == 0]
        assert len(leave) == 1
        layers = [start]
        for t in own:
            layers.append(pieces.through(layers[-1], t))
        last, parts = leave[0], []
        for (a, b), layer in zip(reversed(spans), reversed(layers[1:])):
            parts = pieces.backtrace(merges, plain, a, b, layer[last][1], last) + parts
            last = layer[last][1]
        assert pieces.ids_of(PATH, parts) == model.encode(text)
        assert -whole[2][0][whole[1].index(leave[0])] == len(parts)  # the weight counts pieces


def test_matrices_combine_associatively():
    merges, plain = pieces.merges_of(PATH), pieces.load(PATH).normalize(texts()[0] * 3)
    a, b, c = (pieces.transfer(merges, plain, x, y) for x, y in itertools.islice(chunks_of(plain, 40), 3))
    left, right = pieces.combine(pieces.combine(a, b), c), pieces.combine(a, pieces.combine(b, c))
    assert left[:2] == right[:2] and (left[2] == right[2]).all()
    direct = pieces.transfer(merges, plain, 0, 120)
    assert direct[0] == left[0] and {s: v for s, v in zip(left[1], left[2].T[:, 0])} == {s: v for s, v in zip(direct[1], direct[2].T[:, 0]) if v > -np.inf}


def test_documents(spark):
    model = pieces.load(PATH)
    own = [None, "", *texts(), "giant " * 2000, "giant " * 2000, "z" * 6000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(own)], "doc_id long, text string, ids int")
    rows = {r.doc_id: r for r in pieces.encode_documents(df, PATH, giant=1000, chunk=250, block=3).collect()}
    assert len(rows) == len(own)
    for i, t in enumerate(own):
        ids = model.encode(t or "")
        assert (rows[i].ids, rows[i].n_tokens, rows[i].n_bytes) == (ids, len(ids), len((t or "").encode()))
        assert rows[i].round_trip == (model.decode(ids) == (t or "")) and rows[i].round_trip == ("▁" not in (t or ""))
    assert pieces.encode_documents(df.limit(0), PATH).count() == 0


def test_the_path_of_most_weight_is_taken():
    """Of two entry states that lead to one exit state, the better path's is kept, whatever their order."""
    a, b, end = (0, "a"), (1, "b"), (0, "z")
    chunk = ([a, b], [end], np.array([[-5.0], [-2.0]]))
    for reached in ({a: (-1.0, None), b: (-2.0, None)}, {b: (-2.0, None), a: (-1.0, None)}):
        assert pieces.through(reached, chunk) == {end: (-4.0, b)}
    assert pieces.through({a: (0.0, None)}, ([a], [end], np.array([[pieces.NEVER]]))) == {}
