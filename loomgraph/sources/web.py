"""Web pages: which addresses may be read, and pages as notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_text, url_filename

# Schemes that may be fetched, and hosts that may not.
SCHEMES = ("http", "https")
BLOCKED_HOSTS = ("metadata.google.internal", "metadata.google.com", "localhost")
MAX_BYTES, MAX_TEXT_BYTES = 52_428_800, 10_485_760
_PRIVATE = r"^(0\.|10\.|127\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|2(2[4-9]|[3-5]\d)\.)|^\[?(::1|f[cd]|fe80)"


def guard(url: Column) -> Column:
    """Why an address may not be fetched: scheme, host or private; null if it may. Names aren't resolved here."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.when(~scheme.isin(*SCHEMES), "scheme").when(host.isin(*BLOCKED_HOSTS), "host").when(host.rlike(_PRIVATE), "private")


def looks_like_html(body: Column) -> Column:
    head = F.lower(F.substring(body, 1, 500))
    return F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<body"))


def ingested(pages: DataFrame, captured: str = "1970-01-01T00:00:00+00:00") -> DataFrame:
    """Pages (url, html) as notes: url, file, text, note. Blocked addresses are left out."""
    text = F.when(looks_like_html(F.col("html")), page_text(F.col("html"))).otherwise(F.col("html"))
    rows = pages.where(guard(F.col("url")).isNull()).select("url", url_filename(F.col("url")).alias("file"), text.alias("text"))
    note = F.concat(F.lit('---\nsource_url: "'), "url", F.lit(f'"\ncaptured_at: "{captured}"\n---\n\n'), "text")
    return rows.withColumn("note", note)
