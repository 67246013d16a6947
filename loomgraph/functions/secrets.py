"""Screening of texts for secrets. The patterns are our own; labels name their families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Families in the order in which they are told.
PATTERNS = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "aws": r"\bAKIA[0-9A-Z]{16}\b",
    "github": r"\bgh[pousr]_[A-Za-z0-9]{20,}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
    "google": r"\bAIza[0-9A-Za-z_-]{30,}",
    "openai": r"\bsk-[A-Za-z0-9_-]{20,}",
    "slack": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "assignment": r"(?i)\b(?:api[_-]?key|secret|token|password|passwd)\b\s*[:=]\s*[\"']?[A-Za-z0-9_/+=.-]{16,}",
}
BLOB = r"[A-Za-z0-9+/=]{40,}"


def secret_label(text: Column) -> Column:
    """The family of the first secret that is found; null if none is."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in PATTERNS.items()])


def has_secret(text: Column) -> Column:
    """True for a labelled secret or a run of 40 signs as opaque as one."""
    return F.coalesce(secret_label(text).isNotNull() | text.rlike(BLOB), F.lit(False))
