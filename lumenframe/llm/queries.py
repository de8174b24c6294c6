"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import licenses, mixing, pieces, quality, simhash, tokens, topk, toxicity, urls, warc
from lumenframe.llm.common import checkpointed, shared_folder


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where a public tokenizer's file is; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prints = checkpointed(docs.select("doc_id", simhash.fingerprint_column(F.col("text")).alias("fp")))
    found = simhash.near_duplicates(prints)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, tokenizer_path(), shared_folder(spark, "token-counts"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(nullif(refers_to, '') AS BIGINT)").alias("refers_to"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes("base")).alias("base_failed"), quality.passes().alias("kept"), "failed",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


def pieces_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    encoded = table(spark, sf_dir, "documents").select("doc_id", pieces.encode_column(spark, path, F.col("text")).alias("ids"))
    return encoded.select("doc_id", F.md5(pieces.decode_column(spark, path, F.col("ids"))).alias("digest"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("id % 20 = 0"))


def _sql_pattern(rule: urls.Rule) -> str:
    """The rule as a regular expression of the SQL twin."""
    return urls.expression(rule).pattern.replace("\\Z", "$").replace("\\-", "-").replace("'", "''")


def _op2_sql() -> str:
    rules = sorted(urls.PREFIX_RULES, key=lambda r: -len(r.pattern))
    fits = {r: f"regexp_matches(target, '^(?s)(?:{_sql_pattern(r)})')" for r in (*rules, *urls.PATTERN_RULES)}
    fits |= {r: f"regexp_matches(target, '^(?:{_sql_pattern(r)})', 'si')" for r in urls.PATTERN_RULES}
    ranked = sorted(urls.PATTERN_RULES, key=lambda r: (r.verdict == "allow", len(r.pattern), r.pattern), reverse=True)
    case = lambda rs, value, other: "CASE " + " ".join(f"WHEN {fits[r]} THEN '{value(r)}'" for r in rs) + f" ELSE {other} END"
    return rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM u),
t AS (SELECT page_id, host, path, host || tail AS target FROM h),
j AS (
  SELECT page_id, host, path, {case(rules, lambda r: r.pattern, "NULL")} AS rule, {case(rules, lambda r: r.verdict, "NULL")} AS verdict,
    {case(ranked, lambda r: r.pattern, "NULL")} AS pattern, {case(ranked, lambda r: r.verdict, f"'{urls.DEFAULT}'")} AS otherwise FROM t)
SELECT page_id, host, path, rule, coalesce(verdict, otherwise) AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern FROM j
"""


OP5_SQL = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT r, page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT *, first_value(page_id) OVER w AS first_id, row_number() OVER w AS place FROM d WINDOW w AS (PARTITION BY digest ORDER BY page_id NULLS LAST, r))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND place > 1 THEN first_id END AS refers_to
FROM f
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM q JOIN v AS c ON c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sample(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key, coalesce('s' || source, 'n') AS name FROM documents),
s AS (SELECT source, name, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source, name),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS most FROM s),
l AS (
  SELECT *, row_number() OVER o AS place,
    CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST)),
f AS (SELECT place, level FROM l WHERE weight * level <= most ORDER BY place LIMIT 1),
t AS (
  SELECT l.name, l.source_size, CASE WHEN l.place < f.place THEN CAST(l.most AS DOUBLE) ELSE l.weight * f.level END AS target
  FROM l CROSS JOIN f),
q AS (
  SELECT doc_id, size, key, name, source_size, target, sum(size) OVER (PARTITION BY name ORDER BY key, size) AS upto
  FROM d JOIN t USING (name)),
c AS (
  SELECT *, CASE WHEN target > 0 THEN CAST(CAST(upto + source_size * i AS BIGINT) AS DOUBLE) / target ELSE 0 END AS time
  FROM q, (VALUES (0), (1), (2)) AS v(i)),
r AS (SELECT *, sum(size) OVER (ORDER BY time, name, key, size) AS run FROM c),
b AS (SELECT sum(size) AS budget FROM d),
n AS (
  SELECT doc_id, size, key, name, source_size, target,
    count(*) FILTER (WHERE size > 0 AND run <= budget) / (count(*) // 3) AS copies, min(time) AS first_time
  FROM r CROSS JOIN b GROUP BY doc_id, size, key, name, source_size, target)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies, first_time
FROM n JOIN (SELECT doc_id AS again, size AS s, name AS m FROM d) ON again IS NOT DISTINCT FROM doc_id AND s = size AND m = name
"""

OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
t AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM t) WHERE c > 1),
inside AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN l USING (r) LEFT JOIN inside USING (r)),
f AS (
  SELECT *, CAST(
      (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 2 * word_chars < 3 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 30 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END)
    + (CASE WHEN n_words > 1000000 THEN 128 ELSE 0 END) AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed & 3) <> 0 AS base_failed, (failed & 127) = 0 AS kept, failed
FROM f
"""

RULE_BITS = ("few_words", "repeated_words", "symbols", "short_words", "long_words", "duplicate_lines", "capitals")
ABLATION_SQL = "WITH f AS (SELECT failed & 127 AS mask FROM (" + OP6_SQL + "))\n" + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, CAST(coalesce(sum(CASE WHEN mask & {1 << i} <> 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_failed, CAST(coalesce(sum(CASE WHEN mask = {1 << i} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_only FROM f"
    for i, rule in enumerate(RULE_BITS)
)

#: What encoding takes for a space comes back as one.
ROUND_TRIP_SQL = "SELECT doc_id, md5(replace(coalesce(text, ''), chr(9601), ' ')) AS digest FROM documents"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_url_filters": op2_url_filters,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_pieces": op8_pieces,
    "op9_licenses": op9_licenses,
    "op10_top_k": op10_top_k,
    "quality_ablation": quality_ablation,
    "pieces_round_trip": pieces_round_trip,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": _op2_sql(),
    "op4_mixing": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op6_quality_rules": OP6_SQL,
    "op10_top_k": OP10_SQL,
    "quality_ablation": ABLATION_SQL,
    "pieces_round_trip": ROUND_TRIP_SQL,
}
