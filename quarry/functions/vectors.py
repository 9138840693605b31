"""Column expressions over ``array<float>`` embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Inner product of two arrays, accumulated in double, in index order."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    squares = F.transform(_col(v), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def l2_normalize(v) -> Column:
    """Unit-length vector (array<double>); a zero vector stays zero.

    The norm is computed once per vector, in the finish step of the fold.
    """
    v = _col(v)

    def scale(sum_sq):
        norm = F.sqrt(sum_sq)
        return F.transform(
            v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))

    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"),
                       scale)
