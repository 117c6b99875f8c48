"""Vector expressions over ``array<float>``; all arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null for a zero vector or for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def cosine_or_zero(a: Column, b: Column) -> Column:
    """Cosine; 0 for a zero vector or for vectors of different lengths."""
    return F.coalesce(cosine(a, b), F.lit(0.0))


def bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``x`` evaluated once, however often the body, or a lambda in it, uses it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def unit(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays."""
    return bound(a, lambda v: bound(norm(v), lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))))


def pooled(tokens: Column, mask: Column, how: str = "mean") -> Column:
    """One vector of ``array<array<double>>``: mean over unmasked tokens, the first token (cls), or the maximum; then to length 1."""
    if how == "cls":
        return unit(F.get(tokens, F.lit(0)))
    join = (lambda x, y: F.greatest(x, y)) if how == "max" else (lambda x, y: x + y)

    def merged(shown: Column) -> Column:
        rest = F.slice(shown, F.lit(2), F.greatest(F.size(shown) - 1, F.lit(0)))
        total = F.aggregate(rest, F.get(shown, F.lit(0)), lambda s, t: F.zip_with(s, t, join))
        return total if how == "max" else F.transform(total, lambda x: x / F.size(shown))

    return unit(bound(F.filter(F.zip_with(tokens, mask, lambda t, m: F.when(m == 1, t)), lambda t: t.isNotNull()), merged))
