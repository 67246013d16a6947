"""Checks of records and graphs; they tell, they don't stop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CONFIDENCES, EDGE_FIELDS, FILE_TYPES, NODE_FIELDS, RELATIONS


def record_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What is wrong with records: kind, record, error."""
    out = None

    def add(rows: DataFrame, kind: str, record, error) -> None:
        nonlocal out
        found = rows.select(F.lit(kind).alias("kind"), record.alias("record"), error.alias("error"))
        out = found if out is None else out.unionByName(found)

    name = F.coalesce("id", F.lit("?"))
    pair = F.concat(F.coalesce("source", F.lit("?")), F.lit(" - "), F.coalesce("target", F.lit("?")))
    missing = lambda fields: F.explode(F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f"missing {f}")) for f in fields])))
    add(nodes.select(name.alias("record"), missing(NODE_FIELDS).alias("error")), "node", F.col("record"), F.col("error"))
    add(nodes.where(~F.col("file_type").isin(*FILE_TYPES)), "node", name, F.concat(F.lit("invalid file_type "), "file_type"))
    add(edges.select(pair.alias("record"), missing(EDGE_FIELDS).alias("error")), "edge", F.col("record"), F.col("error"))
    add(edges.where(~F.col("confidence").isin(*CONFIDENCES)), "edge", pair, F.concat(F.lit("invalid confidence "), "confidence"))
    known = nodes.select("id").where("id is not null").distinct()
    for end in ("source", "target"):
        loose = edges.where(f"{end} is not null").join(known.withColumnRenamed("id", end), end, "left_anti")
        add(loose, "edge", pair, F.concat(F.lit(f"{end} is no node: "), end))
    return out


def schema_warnings(nodes: DataFrame, edges: DataFrame, entity_types=FILE_TYPES, relation_types=RELATIONS, shown: int = 20) -> DataFrame:
    """The first warnings about types that a schema doesn't name: warning."""
    types = nodes.where((F.col("file_type") != "") & ~F.col("file_type").isin(*entity_types)).select(
        F.lit(0).alias("kind"), F.col("ord"), F.concat(F.lit("Node '"), F.coalesce("label", "id"), F.lit("': unknown type '"), "file_type", F.lit("'")).alias("warning")
    )
    relations = edges.where((F.col("relation") != "") & ~F.col("relation").isin(*relation_types)).select(F.lit(1).alias("kind"), "ord", F.concat(F.lit("Edge '"), "relation", F.lit("': unknown relation type")).alias("warning"))
    return types.unionByName(relations).orderBy("kind", "ord", "warning").limit(shown).select("warning")
