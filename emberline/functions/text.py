"""Text and vector functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What marks quoted text, and the prefixes of a subject.
QUOTES = (
    r"(?m)^>+\s?.*$",
    r"(?is)-{3,}\s*Original Message\s*-{3,}.*",
    r"(?is)-{3,}\s*Forwarded by\s.*?-{3,}.*",
    r"(?im)On .{10,80} wrote:\s*$",
)
PREFIXES = r"(?i)^(?:(?:re|fwd?)\s*:\s*)+"


def strip_quotes(body: Column) -> Column:
    """Without quoted lines, forwarded and original-message blocks and reply headers; blank runs shortened."""
    for pattern in QUOTES:
        body = F.regexp_replace(body, pattern, "")
    return F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def normalize_subject(subject: Column) -> Column:
    """Lower case, without reply and forward prefixes, white space collapsed."""
    bare = F.regexp_replace(F.trim(subject), PREFIXES, "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers, in doubles."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
