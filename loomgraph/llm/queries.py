"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, katz, langid, mixing, quality_rules, sentencepiece_lattice, sharding, simhash, term_divergence, token_count, topk, url_filter, warc
from .common import crc_fold, prepare, shared_dir, table
from .oracles import ORACLES

#: The public vocabulary that counts and encodes tokens; any SentencePiece model's path may take its place.
TOKENIZER = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", quality_rules.verdicts(F.col("text"), rules).alias("v")).select("doc_id", "v.*")


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return katz.score_documents(table(spark, sf_dir, "documents"), crc_fold("doc_id", 5) == 1)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold("doc_id", 4) == 2
    model = langid.fit(docs, ~held_out)
    return docs.select("doc_id", held_out.alias("held_out"), langid.predictions(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.*")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = table(spark, sf_dir, "documents").select("doc_id", n_bytes.alias("n_bytes"), token_count.token_counts(F.col("text"), tokenizer_path()).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    import uuid

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("lang"))


def op12_term_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return term_divergence.divergence(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    found = sharding.shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "sharded.size", crc, F.lit("bytes").alias("law"), "sharded.shard", "sharded.slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_quality_rules, op2_katz_backoff, op3_source_mixing, op4_language_id, op5_url_filter,
    op6_exact_top_k, op7_token_counts, op8_sentencepiece_lattice, op9_simhash_neardup, op10_warc_archives,
    op11_filter_audit, op12_term_divergence, op13_sharding,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return dict(ORACLES)
