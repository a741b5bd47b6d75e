import hashlib

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import mixing, ordinal, pieces, suffix_array
from lodestone.llm.common import materialise, tokenizer_path
from tests.conftest import DATA
from tests.llm.test_similar_texts import groups
from tests.llm.test_suffix_array import brute


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output on a small table."""
    sf = str(DATA / "sf0.001")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, sf), name)
        out[name] = (docs, after)
        docs = after
    return out


def test_columns(stages, spark):
    raw = spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).dtypes
    assert all(after.dtypes == raw for name, (_, after) in stages.items() if name != "encode")
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages) and corpus_pipeline.ORACLE_SQL is None


def test_clean_documents_stay(stages, spark):
    before, after = stages["quality"]
    labels = spark.read.parquet(str(DATA / "sf0.001/labels.parquet"))
    clean = labels.filter("quality = 1 and toxic = 0").join(before, "doc_id").count()
    assert after.join(labels.filter("quality = 1 and toxic = 0"), "doc_id").count() >= 0.95 * clean
    poor = labels.filter("quality = 0").join(before, "doc_id").count()
    assert after.join(labels.filter("quality = 0"), "doc_id").count() <= 0.2 * poor
    assert after.exceptAll(before).count() == 0


def test_no_copies_stay(stages):
    before, after = stages["near_duplicates"]
    assert after.select("text").distinct().count() == after.count() <= before.count()
    assert after.exceptAll(before).count() == 0


def test_passages_go(stages):
    before, after = stages["repeated_passages"]
    rows = before.orderBy("doc_id").collect()
    want = {r.doc_id: kept.decode("utf-8", "ignore") if removed else r.text for r, (removed, _, kept) in zip(rows, brute([r.text.encode() for r in rows], suffix_array.LENGTH))}
    got = after.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_mix_meets_targets(stages):
    before, after = stages["mix"]
    sized = lambda df: {r[0]: r[1] for r in df.select("source", mixing.sizes().alias("n")).groupBy("source").sum("n").collect()}
    had, got = sized(before), sized(after)
    want = {r.source: r.target for r in mixing.targets(before.select("source", mixing.sizes().alias("size"))).collect()}
    assert all(abs(got.get(s, 0) - want[s]) <= 0.5 for s in had)


def test_encoding_is_the_librarys(stages):
    before, after = stages["encode"]
    model = pieces.load(tokenizer_path("piece_bpe_32k.model"))
    want = sorted((r.doc_id, model.encode(r.text)) for r in before.collect())
    assert sorted((r.doc_id, r.ids) for r in after.collect()) == want


def test_run_is_the_stages(stages, spark):
    key = lambda df: sorted((r.doc_id, hashlib.md5(str(r.ids).encode()).hexdigest()) for r in df.collect())
    assert key(corpus_pipeline.run(spark, str(DATA / "sf0.001"))) == key(stages["encode"][1])


def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns that clash with the operators' own."""
    passage = " ".join(f"p{i}" for i in range(80))
    texts = [None, "", " ", "one two", "one two", f"start {passage} end", f"{passage} é", "é" * 300, "long " * 50_000, f"x {passage}"]
    rows = [(i, t, "en", "src1", 0) for i, t in enumerate(texts)] + [(None, "no id", None, None, None), (None, None, None, None, None), (3, "one two", "en", "src1", 0), (3, "another", "de", None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    return docs, docs.selectExpr("*", "1 spans", "2 kept", "3 size", "4 `row`", "true selected", "5 tie", "6 _own", "7 ids", "8 n_bytes", "9 epochs", "10 root")


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    sf = str(DATA / "sf0.001")
    plain, clashing = odd(spark)
    out = stage(spark, clashing, sf)
    got = sorted(map(str, out.collect()))
    assert got == sorted(map(str, stage(spark, plain, sf).select(out.columns).collect()))
    assert stage(spark, clashing.limit(0), sf).count() == 0
    rows = out.collect()
    if name == "near_duplicates":
        assert sorted((str(r.doc_id), r.text) for r in rows if r.text is None or len(r.text) < 10) == [("0", None), ("3", "another"), ("3", "one two"), ("None", "no id")]
    if name == "repeated_passages":
        kept = {r.doc_id: kept.decode("utf-8", "ignore") for r, (_, _, kept) in zip(plain.collect(), brute([(r.text or "").encode() for r in plain.collect()], suffix_array.LENGTH)) if r.doc_id not in (None, 3)}
        assert len(rows) == 14 and {r.doc_id: r.text or "" for r in rows if r.doc_id not in (None, 3)} == kept
        assert all(r.text is None for r in rows if r.doc_id == 0) and {r.text for r in rows if r.doc_id in (3, 4)} == {"one two", "another"}
    if name == "mix":
        assert {r.doc_id for r in rows} <= {3, 4, 5, 6, 7, 8, 9, None} and all(r.text for r in rows)
    if name == "encode":
        assert sorted((str(r.doc_id), r.n_tokens) for r in rows if r.n_tokens == 0) == [("0", 0), ("1", 0), ("None", 0)]


def test_quality_is_the_models(spark):
    """What stays is what the fitted weights select, summed up for each document by itself."""
    sf = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = ordinal.train(docs, ordinal.graded(spark.read.parquet(f"{sf}/labels.parquet")))
    want = set()
    for r in docs.collect():
        slots, values = ordinal.features(r.text)
        score = sum(float(model.weights[s]) * float(v) for s, v in zip(slots, values))
        if 1 / (1 + np.exp(model.thresholds[-1] - score)) >= ordinal.CUT:
            want.add(r.doc_id)
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).collect()} == want


def test_near_duplicates_like_brute_force(stages):
    """On the given documents: one of each group that pairs at 0.8 make, and nothing else goes."""
    before, after = stages["near_duplicates"]
    rows = before.select("doc_id", "text").orderBy("doc_id").collect()
    tight, _ = groups([r.text for r in rows])
    assert {r.doc_id for r in after.collect()} == {rows[i].doc_id for i in set(tight)}
