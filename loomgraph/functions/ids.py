"""Identifiers of nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_id(*parts: Column) -> Column:
    """Id of a code entity: parts without outer `_` and `.`, joined by `_`, every other run of signs folded to `_`, lower case."""
    trimmed = F.transform(F.filter(F.array(*parts), lambda p: p != ""), lambda p: F.regexp_replace(p, r"^[_.]+|[_.]+$", ""))
    folded = F.regexp_replace(F.array_join(trimmed, "_"), "[^a-zA-Z0-9]+", "_")
    return F.lower(F.regexp_replace(folded, "^_+|_+$", ""))


def doc_id(source_file: Column, label: Column) -> Column:
    """Id of a document entity: 12 hex digits of a hash of its file and label."""
    return F.substring(F.sha2(F.concat(source_file, F.lit("::"), label), 256), 1, 12)
