"""Column expressions on texts and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def dot(a: str, b: str) -> str:
    """SQL of the dot product of two numeric arrays, in doubles."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS double) * cast(y AS double)), 0.0D, (s, x) -> s + x)"


def cosine(a: str, b: str) -> str:
    return f"({dot(a, b)} / sqrt({dot(a, a)} * {dot(b, b)}))"


def scale_of(v: str) -> str:
    """Step of a vector's int8 copy: its largest absolute value over 127."""
    return f"(array_max(transform({v}, x -> abs(cast(x AS double)))) / 127.0D)"


def quantized(v: str) -> str:
    return f"transform({v}, x -> cast(round(cast(x AS double) / {scale_of(v)}) AS tinyint))"
