from tokenizers import Tokenizer

from lodestone.llm import token_counts
from lodestone.llm.common import fresh_path, tokenizer_path

TEXTS = [None, "", "a", "Hello world", "Hello world", "naïve 中文   <|endoftext|>", "long " * 50_000]
SCHEMA = "doc_id long, text string, n_tokens string, text_digest string"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def test_counts_are_the_librarys(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    rows = token_counts.count_tokens(frame(spark, TEXTS), path, 1024).collect()
    want = {(i, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS)}
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in rows} == want and len(rows) == len(TEXTS)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)


def test_cache_holds_each_text_once(spark):
    path, cache = tokenizer_path("byte_bpe_50k.json"), fresh_path(spark, "cache")
    token_counts.count_tokens(frame(spark, TEXTS[:5]), path, 8, cache).collect()
    assert token_counts.read_cache(spark, cache).count() == 3
    again = token_counts.count_tokens(frame(spark, TEXTS, 10), path, 8, cache).collect()
    assert len(again) == len(TEXTS) and token_counts.read_cache(spark, cache).count() == 5


def test_models_have_their_own_rows(spark):
    cache = fresh_path(spark, "cache")
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        token_counts.count_tokens(frame(spark, ["Hello", None]), tokenizer_path(name), 8, cache).collect()
    assert token_counts.read_cache(spark, cache).count() == 4


def test_no_rows(spark):
    assert token_counts.count_tokens(frame(spark, []), tokenizer_path("byte_bpe_50k.json"), 8).collect() == []
