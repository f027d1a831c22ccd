"""Column helpers for text and rounding; everything stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = r"(?U)\s+"
#: The characters that ``WHITESPACE`` matches (the Unicode property of that name).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
WORD = r"[\p{L}\p{N}]+"


def collapse(c: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, WHITESPACE, " "))


def strip(c: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.btrim(c, F.lit(SPACES))


def norm_key(c: Column) -> Column:
    """Case- and space-insensitive key; null becomes the empty string."""
    return F.lower(collapse(F.coalesce(c, F.lit(""))))


def norm_text(c: Column) -> Column:
    """Matching form: lower case, quotation marks removed, spaces collapsed, null as empty."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[«»\"']", ""))


def present(c: Column) -> Column:
    """True for a non-null, non-empty string."""
    return F.coalesce(c != "", F.lit(False))


def icontains(c: Column, needle: str) -> Column:
    """Case-insensitive substring test; the needle is literal, so ``%`` and ``_`` mean themselves."""
    return F.lower(c).contains(needle.lower())


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in text order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value of a small literal map, null when the key is absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.element_at(F.create_map(*pairs), c)


def round_half_even(c: Column, digits: int) -> Column:
    """Round a double by its binary value, ties to even.

    Spark rounds the shortest decimal text of a double; here the exact product ``c * 10^digits`` is kept as
    a double plus its rounding error (splitting the factor into halves), so 0.15 stays below the tie it is below.
    """
    scale = float(10**digits)
    x = c.cast("double")
    split = x * F.lit(134217729.0)
    high = split - (split - x)
    low = x - high
    product = x * F.lit(scale)
    error = (high * F.lit(scale) - product) + low * F.lit(scale)
    whole = F.floor(product).cast("double")
    fraction = product - whole
    up = (
        F.when(fraction > 0.5, F.lit(1.0))
        .when(fraction < 0.5, F.lit(0.0))
        .when(error > 0, F.lit(1.0))
        .when(error < 0, F.lit(0.0))
        .otherwise(F.pmod(whole, F.lit(2.0)))
    )
    return (whole + up) / F.lit(scale)
