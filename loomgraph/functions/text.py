"""Text expressions. Patterns are Unicode-aware and count only line feeds as line ends where `^` and `$` matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line in a text.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
WIKILINK = r"\[\[([^\]]+)\]\]"


def lines(text: Column) -> Column:
    """A text's lines; a last empty one doesn't count."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def strip_tags(html: Column) -> Column:
    """Text of a page with its tags replaced by blanks; scripts and styles keep their text."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def page_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>", ""), r"(?s)<style[^>]*>.*?</style>", "")
    return strip_tags(bare)


def without_fences(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)```.*?```", "")


def is_noisy(term: Column) -> Column:
    """True for terms that look like code, paths, tables or numbers rather than names."""
    letters = F.length(F.regexp_replace(term, r"[^\p{L}]", ""))
    return (
        ~F.length(term).between(2, 40)
        | term.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
        | term.rlike(r"  |\t")
        | term.rlike(r"[/\\={}()\[\]]")
        | (letters < F.length(term) * 0.5)
    )


def sanitized(label: Column) -> Column:
    """A label that is safe within HTML: no control characters, 256 characters, escaped."""
    out = F.substring(F.regexp_replace(label, r"[\x00-\x1f\x7f]", ""), 1, 256)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def slug(text: Column) -> Column:
    """A file-name fragment of at most 40 characters; `note` if nothing is left."""
    kept = F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]", "")
    dashed = F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, 40), "-+$", "")
    return F.when(cut == "", "note").otherwise(cut)


def url_filename(url: Column) -> Column:
    """File name for a page: scheme dropped, other signs than letters, digits, `-`, `.` and `_` folded one by one, 80 characters."""
    name = F.regexp_replace(F.regexp_replace(url, "https?://", ""), r"(?U)[^\w\-.]", "_")
    return F.concat(F.regexp_replace(F.substring(name, 1, 80), "_+$", ""), F.lit(".md"))


def truncated_label(label: Column) -> Column:
    """Labels of more than eight words are cut at 60 characters and marked."""
    cut = F.regexp_replace(F.substring(label, 1, 60), "[ ,;:.-]+$", "")
    return F.when(word_count(label) > 8, F.concat(cut, F.lit("…"))).otherwise(label)


def vault_name(label: Column) -> Column:
    """A label without characters that file names can't have."""
    name = F.replace(F.trim(F.regexp_replace(label, r'[\\/*?:"<>|#^\[\]]', "")), F.lit(".."), F.lit(""))
    return F.when(name == "", "unnamed").otherwise(name)


def cut_at_word(text: Column, limit: int) -> Column:
    """At most `limit` characters, cut back to the last blank and marked with dots."""
    head = F.substring(text, 1, limit)
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(head, r"(?s) [^ ]*$", ""), F.lit("..."))).otherwise(text)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]+$", 0)


def has_suffix(path: Column) -> Column:
    return file_name(path).rlike(r"^.+\.[^.]+$")


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty without one. A leading dot starts no suffix."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")
