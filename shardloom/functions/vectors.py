"""Vector expressions: parsing, normalisation, cosine and feature hashing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardloom.functions.rows import let
from shardloom.functions.text import words

# Equal vectors must tie exactly whatever the order of their sums, so scores keep this many decimals.
SCORE_DECIMALS = 9


def parse_vector(c: Column) -> Column:
    """Text such as ``[0.1, 2]`` or ``(1, 2)`` as ARRAY<DOUBLE>; null for anything else."""
    as_list = (
        F.when(c.rlike(r"^\s*\[[^\[\]]*\]\s*$"), c)
        .when(c.rlike(r"^\s*\([^()\[\]]*,[^()\[\]]*\)\s*$"), F.translate(c, "()", "[]"))
    )
    # Number and list spellings that JSON lacks: a trailing comma, "5." and ".5".
    as_list = F.regexp_replace(as_list, r",\s*\]\s*$", "]")
    as_list = F.regexp_replace(as_list, r"\.(?![0-9])", ".0")
    as_list = F.regexp_replace(as_list, r"(?<![0-9])\.", "0.")
    parsed = F.from_json(as_list, "array<double>", {"allowNonNumericNumbers": "false"})
    return let(parsed, lambda vector: F.when(~F.exists(vector, lambda x: x.isNull()), vector))


def all_finite(v: Column) -> Column:
    """Whether no element is null, NaN or infinite; true for an empty vector."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit-length copy as ARRAY<DOUBLE>; null for null, empty or all-zero vectors."""
    return let(
        v,
        lambda vec: let(l2_norm(vec), lambda norm: F.when(norm > 0, F.transform(vec, lambda x: x.cast("double") / norm))),
    )


def hashed_features(text: Column, dim: int) -> Column:
    """Signed feature-hash codes of the words: ``2 * bucket`` for plus, ``2 * bucket + 1`` for minus.

    The bucket comes from the first eight hex digits of the word's MD5, the sign from the ninth.
    """

    def code(digest: Column) -> Column:
        bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dim
        return (bucket * 2 + F.when(F.substring(digest, 9, 1) < "8", 0).otherwise(1)).cast("int")

    return F.transform(F.transform(words(F.lower(text)), lambda word: F.md5(word)), code)


def hash_embed(text: Column, dim: int) -> Column:
    """Deterministic embedding by feature hashing, L2-normalised; null for text without words.

    It reads one row at a time: no explode, no shuffle, so copies of one text cost nothing extra.
    """
    every_code = F.sequence(F.lit(0), F.lit(2 * dim))

    def signed_counts(starts: Column) -> Column:
        # Code c occurs starts[c + 1] - starts[c] - 1 times; a bucket is its plus code less its minus code.
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda b: 2 * F.get(starts, 2 * b + 1) - F.get(starts, 2 * b) - F.get(starts, 2 * b + 2),
        )

    def run_starts(codes: Column) -> Column:
        # Every code has a run, so the starts of the runs are in the order of the codes; one pass, whatever the dimension.
        first = F.transform(codes, lambda c, i: F.when((i == 0) | (F.get(codes, i - 1) != c), i))
        return F.filter(first, lambda i: i.isNotNull())

    # Counting by position: sorted together with one of each code, every code starts somewhere.
    in_order = F.sort_array(F.concat(hashed_features(text, dim), every_code))
    return normalize(let(let(in_order, run_starts), signed_counts))
