import pytest
from pyspark.sql import functions as F

from lumenframe.llm import tokens
from lumenframe.llm.common import shared_folder

public = pytest.importorskip("public_tokenizers")

TEXTS = ["", " ", "hello  world\n\n", "<s> </s> <unk> <0x0A>", "<|endoftext|> x", "é漢字\u0000▁", "word " * 3000, "a" * 20000]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_are_the_librarys_and_cached(spark, name):
    path = public.path(name)
    if name.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(own.encode(t))
    else:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    rows = [*enumerate(TEXTS), (None, "hello  world\n\n"), (100, None), (3, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest__", F.lit(1)).withColumn("n_bytes", F.lit("clash"))
    cache = shared_folder(spark, "cache")
    want = sorted(str((i, len((t or "").encode()), count(t or ""), count(t or "") > 4096)) for i, t in rows)
    for _ in range(2):
        got = tokens.count_tokens(docs, path, cache)
        assert sorted(str((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)) for r in got.collect()) == want
        assert tokens.read_cache(spark, cache).count() == len(set(TEXTS))
    more = docs.union(spark.createDataFrame([(7, "never seen", 1, "x")], docs.schema))
    tokens.count_tokens(more, path, cache)
    assert tokens.read_cache(spark, cache).count() == len(set(TEXTS)) + 1


def test_stored_counts_are_used_and_versions_kept_apart(spark):
    path, cache = public.path("piece_bpe_32k.model"), shared_folder(spark, "cache")
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    tokens.count_tokens(docs, path, cache)
    tokens.count_tokens(docs, public.path("byte_bpe_50k.json"), cache)
    assert tokens.read_cache(spark, cache).count() == 2
    planted = shared_folder(spark, "cache")
    tokens.read_cache(spark, cache).withColumn("n_tokens", F.lit(777).cast("long")).write.parquet(planted)
    assert tokens.count_tokens(docs, path, planted).first().n_tokens == 777
    assert tokens.count_tokens(docs.limit(0), path, planted).count() == 0
