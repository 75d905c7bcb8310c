"""The queries of this package: the operators over whole tables, in the columns that their contracts name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsight.llm import decontaminate, interactions, jaccard, katz, licenses, packing, quality, secrets, shards, token_counts, token_files, toxicity, tries
from crawlsight.llm.common import documents, scratch

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["kind"].isin([k.name for k in secrets.BASE]))
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("found")).alias("spans"),
    )


@query
def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.byte_shards(documents(spark, sf_dir), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: crc32 in SQL: the table follows from the polynomial, a text's bytes are folded through it.
ORACLES["op9_byte_shards"] = """
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
    FROM range(256) r(i))
), bytes AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT doc_id, strlen(text) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(text)), lambda i: ('0x' || h[2*i+1:2*i+2])::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM bytes, crc_table
), placed AS (
  SELECT *, sum(size) OVER w - size AS start, row_number() OVER w AS n, sum(size) OVER () AS total
  FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
), cut AS (
  SELECT *, least(15, ((2 * start + size) * 16) // (2 * total))::INT AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY n) - 1 AS slot, NULL::INT AS grown_shard
FROM cut
"""


@query
def op10_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_tokens(documents(spark, sf_dir), path)
    return token_files.token_index(token_files.read_tokens(spark, path))


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(documents(spark, sf_dir))


ORACLES["op5_license_scan"] = licenses.oracle()


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op6_decontamination"] = decontaminate.ORACLE


@query
def op8_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz.log_scores(documents(spark, sf_dir))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(documents(spark, sf_dir), jaccard.Similarity(words=4, num=85))
    return found.select("doc_id", "n_shingles", "component_id")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


@query
def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.filter_interactions(documents(spark, sf_dir), labels(spark, sf_dir))


ORACLES["op12_filter_interactions"] = interactions.ORACLE


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLES["op13_prefix_trie"] = tries.ORACLE
