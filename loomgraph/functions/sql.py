"""The library's expressions as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "kg_doc_id(source_file STRING, label STRING) RETURNS STRING": "substring(sha2(concat(source_file, '::', label), 256), 1, 12)",
    "kg_code_id(stem STRING, name STRING) RETURNS STRING": (
        "lower(regexp_replace(regexp_replace(array_join(transform(filter(array(stem, name), p -> p <> ''), "
        "p -> regexp_replace(p, '^[_.]+|[_.]+$', '')), '_'), '[^a-zA-Z0-9]+', '_'), '^_+|_+$', ''))"
    ),
    "kg_word_count(body STRING) RETURNS INT": r"size(filter(split(coalesce(body, ''), '(?U)\\s+'), w -> w <> ''))",
    "kg_top_dir(path STRING) RETURNS STRING": "substring_index(path, '/', 1)",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions for this session; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
