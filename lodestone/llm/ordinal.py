"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are grades 0 .. K-1. All cuts share one weight vector over hashed text features: P(grade < k) =
sigmoid(threshold[k] - score), with ordered thresholds. A document gets its expected grade and the probability of the
top grade; it is selected where that tail probability reaches ``cut``.

The model is fitted on at most SAMPLE labelled rows (those of least hash, a documented bound) with full-batch Adam on
the driver, and scores whole texts of all rows: its features are the set of words (lower case, letters and digits) and
the shares of token shapes (runs of capitals, small letters, digits and each other character), repetition and length.

Nulls and empty texts have the features of no words. Rows without a rating aren't fitted; without any labelled row
all weights are zero and every document is taken to have the top grade. Repeated rows are scored alike. A rating that
is given twice counts once, as does a doc_id that several documents have: the text of least hash is fitted. A document
whose tail probability equals the cut is selected. The columns that classify() adds replace those of their names.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bound_batches

SAMPLE, WORD_BITS, SHAPE_BITS, EPOCHS, RATE, SPARSE, LEAST_DOCS, LEAST_WEIGHT, CUT = 8000, 17, 12, 250, 0.1, 4e-3, 4, 0.1, 0.7
WIDTH = (1 << WORD_BITS) + (1 << SHAPE_BITS)
SHAPE_SCALE = 8.0


def _slot(text: str, bits: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> (64 - bits)


def _shape(token: str) -> str:
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token)
    return "".join(k for k, _ in itertools.groupby(kinds))


class _Slots(dict):
    """Each token's word and shape slot; forgets all when it is full."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > 100_000:
            self.clear()
        word = re.sub(r"[\W_]+", "", token.lower())
        self[token] = out = (_slot(word, WORD_BITS) if word else -1, (1 << WORD_BITS) + _slot(f"shape {_shape(token)}", SHAPE_BITS))
        return out


_slots = _Slots()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and their values."""
    counts = Counter((text or "").split())
    n, known = sum(counts.values()), [_slots[t] for t in counts]
    words = {w for w, _ in known}
    words.discard(-1)
    shapes: dict[int, float] = {}
    for (_, s), k in zip(known, counts.values()):
        shapes[s] = shapes.get(s, 0.0) + SHAPE_SCALE * k / n
    distinct, most = (len(counts) / n, max(counts.values()) / n) if n else (0.0, 0.0)
    for name in (f"length {n.bit_length()}", f"distinct {int(distinct * 10)}", f"most {int(most * 10)}"):
        slot = (1 << WORD_BITS) + _slot(name, SHAPE_BITS)
        shapes[slot] = shapes.get(slot, 0.0) + 1.0
    return np.array([*words, *shapes], "i4"), np.array([*[1.0] * len(words), *shapes.values()], "f4")


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: float | np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - np.asarray(score)[..., None], -60, 60)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _cuts(steps: np.ndarray) -> np.ndarray:
    """Thresholds from the first and the logs of the steps up, which keep them in order."""
    return np.concatenate([steps[:1], steps[0] + np.cumsum(np.exp(steps[1:]))])


def loss_and_slope(y, column, values, owner, theta: np.ndarray, grades: int) -> tuple[float, np.ndarray]:
    """The mean negative log likelihood at theta (weights, then thresholds' steps), and its gradient."""
    n, d, last = len(y), len(theta) - grades + 1, grades - 2
    cuts = _cuts(theta[d:])
    score = np.bincount(owner, values * theta[:d][column], n)
    upper = np.where(y <= last, _sigmoid(cuts[np.minimum(y, last)] - score), 1.0)
    lower = np.where(y > 0, _sigmoid(cuts[np.maximum(y - 1, 0)] - score), 0.0)
    p = np.maximum(upper - lower, 1e-9)
    up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_cut = (np.bincount(np.maximum(y - 1, 0), low, grades - 1) - np.bincount(np.minimum(y, last), up, grades - 1)) / n
    slope = np.bincount(column, values * (up - low)[owner], d) / n
    return float(-np.log(p).mean()), np.concatenate([slope, [by_cut.sum()], np.exp(theta[d + 1 :]) * np.cumsum(by_cut[::-1])[::-1][1:]])


def _descend(y, column, values, owner, theta: np.ndarray, sparse: float, grades: int) -> np.ndarray:
    """Full-batch Adam from theta on loss_and_slope() with an L1 penalty on the weights."""
    theta, d = theta.copy(), len(theta) - grades + 1
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, EPOCHS + 1):
        w = theta[:d].copy()
        _, slope = loss_and_slope(y, column, values, owner, theta, grades)
        slope[:d] = np.where(w != 0, slope[:d] + sparse * np.sign(w), slope[:d] - np.clip(slope[:d], -sparse, sparse))
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta -= RATE * min(1, 2 * (1 - step / (EPOCHS + 1))) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[:d][theta[:d] * w < 0] = 0  # no step leads across zero
    return theta


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int) -> Model:
    """Maximum likelihood in two descents: one with an L1 penalty, which leaves few slots, so that words of a few rows
    don't learn those rows by heart; then those slots alone, almost without it. Slots in fewer than LEAST_DOCS rows keep
    weight zero."""
    if not rows:
        return Model(np.zeros(WIDTH), np.full(grades - 1, -60.0))
    y = np.array([r[0] for r in rows])
    slots, values = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]).astype("f8")
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    share = np.clip([np.mean(y < k) for k in range(1, grades)], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    steps = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    used, weights = np.flatnonzero(np.bincount(slots, minlength=WIDTH) >= LEAST_DOCS), np.zeros(WIDTH)
    for sparse in (SPARSE, SPARSE / 50):
        place = np.full(WIDTH, -1)
        place[used] = np.arange(len(used))
        keep = place[slots] >= 0
        theta = _descend(y, place[slots[keep]], values[keep], owner[keep], np.concatenate([weights[used], steps]), sparse, grades)
        weights[:] = 0
        weights[used], steps = theta[: len(used)], theta[len(used) :]
        used = np.flatnonzero(np.abs(weights) >= LEAST_WEIGHT)
    return Model(weights, _cuts(steps))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from (doc_id, quality, toxic): 2 good and clean, 1 good but toxic, 0 poor."""
    grade: Column = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade")).filter("grade is not null and doc_id is not null")


def train(docs: DataFrame, ratings: DataFrame, grades: int = 3, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` ratings (doc_id, grade) of docs (doc_id, text)."""
    bound_batches(docs.sparkSession)
    chosen = ratings.select("doc_id", "grade").distinct().withColumn("h", F.xxhash64("doc_id", "grade")).orderBy("h", "doc_id", "grade").limit(sample)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # as many rows as the sample has
    least = F.min(F.struct(F.xxhash64("text").alias("t"), "text")).alias("least")  # one text for each rating
    texts = met.groupBy("h", "doc_id", "grade").agg(least).select("h", "grade", "least.text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("grade"), pa.array([s for s, _ in x], pa.list_(pa.int32())), pa.array([v for _, v in x], pa.list_(pa.float32()))], ["h", "grade", "slots", "values"])

    table = texts.select("h", F.col("grade").cast("int"), "text").mapInArrow(of, "h long, grade int, slots array<int>, values array<float>").toArrow()
    rows = zip(*(table.column(c).to_pylist() for c in ("h", "grade")), table.column("slots"), table.column("values"))
    found = sorted(((h, g, s.values.to_numpy(), v.values.to_numpy()) for h, g, s, v in rows), key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
    return fit([r[1:] for r in found], grades)


def classify(docs: DataFrame, model: Model, cut: float = CUT, text: str = "text") -> DataFrame:
    """docs with ``expected_grade``, ``tail_probability`` and ``selected``; clashing columns of docs are kept out."""
    bound_batches(docs.sparkSession)
    weights, thresholds = model.weights.astype("f8"), model.thresholds
    own = docs.drop("expected_grade", "tail_probability", "selected")
    # the weights are WIDTH numbers, whatever the input
    shared = docs.sparkSession.sparkContext.broadcast((weights, thresholds))

    @F.pandas_udf("expected_grade double, tail_probability double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, thresholds = shared.value
        for batch in texts:
            x = np.array([float(weights[s] @ v) for s, v in map(features, batch)])
            tails = Model(weights, thresholds).tails(x)
            yield pd.DataFrame({"expected_grade": tails.sum(-1), "tail_probability": tails[..., -1]})

    scored = own.withColumn("_score", score(F.col(text)))
    return scored.select(*own.columns, "_score.expected_grade", "_score.tail_probability", (F.col("_score.tail_probability") >= cut).alias("selected"))
