"""Text and id expressions. Every function maps Column to Column and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardloom.functions.rows import let

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same characters between words; regular expressions alone know fewer.
# Those beyond Latin-1 are looked for inside their range only, so that most characters take one step, not one for each member.
WHITESPACE_RUN = (
    "[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]+"
)

# Fixed value: the URL namespace of RFC 4122, as hex digits.
UUID_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

# Markdown and HTML images, removed in this order.
IMAGE_PATTERNS = (
    r"!\[.*?\]\(data:image.*?\)",
    r"!\[.*?\]\(.*?\)",
    r"<img.*?>",
)

# The input types an E5 model knows.
INPUT_TYPES = ("passage", "query", "")


def trim_ws(c: Column) -> Column:
    """Strip Unicode white space from both ends (SQL ``trim`` strips spaces only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (trim_ws(c) == "")


def words(c: Column) -> Column:
    """White-space separated words; an empty array for blank or null text."""
    none = F.array().cast("array<string>")
    return let(trim_ws(c), lambda s: F.when(s.isNull() | (s == ""), none).otherwise(F.split(s, WHITESPACE_RUN)))


def token_count(c: Column) -> Column:
    return F.when(is_blank(c), F.lit(0)).otherwise(F.size(F.split(trim_ws(c), WHITESPACE_RUN)))


def clean_markdown(c: Column) -> Column:
    """Remove images, then strip. ``(?d)`` keeps ``.`` stopping at line feeds only."""
    cleaned = F.coalesce(c, F.lit(""))
    for pattern in IMAGE_PATTERNS:
        cleaned = F.regexp_replace(cleaned, "(?d)" + pattern, "")
    return trim_ws(cleaned)


def embeddable_text(c: Column, any_text: bool = False) -> Column:
    """The stripped text, or null where no model could embed it (blank, or, without ``any_text``, the text ``nan``)."""
    s = trim_ws(c)
    return F.when((s != "") if any_text else (s != "") & (F.lower(s) != "nan"), s)


def prefix_text(c: Column, input_type: str) -> Column:
    """Add the E5 prefix unless the text already carries one."""
    prefix = input_type.strip().lower()
    if prefix not in INPUT_TYPES:
        raise ValueError(f"Unknown input type {input_type!r}; known are {[t for t in INPUT_TYPES if t]} and none at all.")
    if not prefix:
        return c
    marked = F.lower(c).startswith("passage: ") | F.lower(c).startswith("query: ")
    return F.when(marked, c).otherwise(F.concat(F.lit(prefix + ": "), c))


def _hyphenate(h: Column) -> Column:
    return F.concat_ws(
        "-", *[F.substring(h, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )


def uuid5_url(c: Column) -> Column:
    """Name-based UUID (version 5, URL namespace) of the UTF-8 bytes of ``c``."""
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID_URL_NAMESPACE)), F.encode(c, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return _hyphenate(
        F.concat(
            F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15)
        )
    )


def point_id(uid: Column, ordinal: Column) -> Column:
    """Canonical point id.

    Digits lose leading zeros, any spelling of a UUID becomes lower case with hyphens, other text
    becomes a version-5 UUID, and a missing uid falls back to the row ordinal.
    """
    s = trim_ws(uid)
    bare = F.lower(F.replace(F.btrim(F.replace(F.replace(s, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit("")),
                                     F.lit("{}")), F.lit("-"), F.lit("")))
    return (
        F.when(uid.isNull() | (s == "") | (F.lower(s) == "nan"), ordinal.cast("string"))
        .when(s.rlike("^[0-9]+$"), F.regexp_replace(s, "^0+(?=[0-9])", ""))
        .when(bare.rlike("^[0-9a-f]{32}$"), _hyphenate(bare))
        .otherwise(uuid5_url(s))
    )
