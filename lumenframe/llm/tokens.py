"""Token counts through a digest cache.

A text's count is stored under the digest of its normalised content and the
digest of the tokenizer file, so a count is made once per distinct content
and tokenizer version.  Documents are joined to the stored counts by digest;
only distinct contents that miss are encoded, and their counts are appended.
Duplicates are dropped on the map side before the one shuffle of texts, so a
content that a third of all rows share costs one row per map task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import own_name

#: A tokenizer file is sent to every executor; a larger one is refused.
MAX_TOKENIZER_BYTES = 64 << 20

CACHE_SCHEMA = T.StructType([
    T.StructField("digest", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType()),
])

_LOADED: dict[str, Callable[[str], int]] = {}


def counter(kind: str, raw: bytes) -> Callable[[str], int]:
    """How many tokens the tokenizer's own library gives for a text.

    No begin, end or other special token is added, nothing is cut or padded.
    """
    version = hashlib.sha256(raw).hexdigest()
    if version not in _LOADED:
        if kind == "model":
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_proto=raw)
            _LOADED[version] = lambda text: len(own.encode(text))
        elif kind == "json":
            from tokenizers import Tokenizer

            fast = Tokenizer.from_buffer(raw)
            fast.no_truncation()
            fast.no_padding()
            _LOADED[version] = lambda text: len(fast.encode(text, add_special_tokens=False).ids)
        else:
            raise ValueError(f"no library for tokenizer files of kind {kind!r}")
    return _LOADED[version]


def tokenizer_version(kind: str, raw: bytes) -> str:
    """A digest of the file and of the library that reads it, with its version."""
    from importlib.metadata import version

    library = {"model": "sentencepiece", "json": "tokenizers"}.get(kind, kind)
    return hashlib.sha256(f"{library} {version(library)} ".encode() + raw).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none if the cache doesn't exist yet."""
    if _exists(spark, path):
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` without its text, with ``n_bytes``, ``n_tokens``, ``over_limit``.

    Runs the encoding of misses and appends to the cache when called; what is
    returned only joins to it.  Null texts count as empty, which has no
    tokens; whole texts are counted, however long; repeated rows and texts get
    a row each from one stored count; a text of exactly ``limit`` tokens isn't
    over it; an empty table gives an empty one.  Columns of ``docs`` that have
    one of the three names are replaced.  Appending twice the same content
    (two jobs at once) is harmless: equal keys have equal counts.
    """
    spark = docs.sparkSession
    raw = Path(tokenizer_path).read_bytes()
    if len(raw) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer_path} has over {MAX_TOKENIZER_BYTES} bytes")
    kind = tokenizer_path.rpartition(".")[2]
    version = tokenizer_version(kind, raw)
    shipped = spark.sparkContext.broadcast(raw)

    @F.arrow_udf(T.LongType())
    def counted(texts: pa.Array) -> pa.Array:
        count = counter(kind, shipped.value)
        return pa.array([count(x.as_py()) for x in texts], type=pa.int64())

    content = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))
    (key,) = own_name(docs, "digest__")

    stored = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    distinct = docs.select(digest.alias("digest"), content.alias("content")).dropDuplicates(["digest"])
    misses = distinct.join(stored.select("digest"), "digest", "left_anti")
    misses.select("digest", F.lit(version).alias("tokenizer"), counted("content").alias("n_tokens")).write.mode("append").parquet(cache_path)

    made = {"n_bytes", "n_tokens", "over_limit"}
    kept = [c for c in docs.columns if c != text_col and c.lower() not in made]
    # equal keys have equal counts, so the distinct rows have one per key
    counts = read_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = counts.select(F.reverse(F.hex("digest")).alias(key), "n_tokens")
    keyed = docs.select(*[F.col(f"`{c}`") for c in kept], F.octet_length(content).cast("long").alias("n_bytes"), F.reverse(F.hex(digest)).alias(key))
    return keyed.join(counts, key, "left").select(*[F.col(f"`{c}`") for c in kept], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
