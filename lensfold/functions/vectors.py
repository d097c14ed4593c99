"""Vector columns as Spark SQL expressions; all sums in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def scale(v: Column | str, factor: Column) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double") * factor)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") + y.cast("double"))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once. Inside a lambda a plain outer expression would be computed
    again for every element, which makes a normalisation quadratic in the vector length."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(v: Column | str) -> Column:
    """Unit length; a zero vector stays zero."""
    whole = F.transform(_c(v), lambda x: x.cast("double"))
    return bind(whole, lambda w: bind(norm(w), lambda n: F.transform(w, lambda x: F.when(n > 0, x / n).otherwise(x))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either side is the zero vector."""
    return bind(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).when(n.isNotNull(), F.lit(0.0)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - cosine(a, b)
