"""Vector functions as Spark column expressions (JVM side, no Python).

Vectors are ``array<float>``; arithmetic is done in double. These are the
small-data and single-query forms; the batched top-k runs block matrix
products in Arrow batches (``lodestar.operators.knn``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.config import DIST_DIGITS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    a, b = _col(a), _col(b)
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a) -> Column:
    a = _col(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_distance(a, b) -> Column:
    """1 - cos(a, b): 0 for the same direction, 2 for opposite."""
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def euclidean_distance(a, b) -> Column:
    a, b = _col(a), _col(b)
    diff = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(diff, F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def negative_dot(a, b) -> Column:
    """The 'dot' metric: negative inner product, so lower means more similar."""
    return -dot(a, b)


def vector_distance(metric: str, a, b) -> Column:
    metric = metric.lower()
    if metric == "cosine":
        return cosine_distance(a, b)
    if metric == "euclidean":
        return euclidean_distance(a, b)
    if metric == "dot":
        return negative_dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def normalize(a) -> Column:
    """Scale to length 1 (norm2); the result stays ``array<float>``.

    The norm is the fold's accumulator and the division happens in its finish step,
    so it is computed once per row, not once per element."""
    a = _col(a)
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"),
                       lambda acc: F.transform(a, lambda x: (x.cast("double") / F.sqrt(acc)).cast("float")))


def base_type(vector) -> str:
    """The number type of a vector column's data type (an array of float or double)."""
    return {"float": "float32", "double": "float64"}[vector.elementType.typeName()]


def dims(a) -> Column:
    return F.size(_col(a))


def rounded(x: Column, digits: int = DIST_DIGITS) -> Column:
    """Round for stable ranking across engines; ``+ 0.0`` turns -0.0 into 0.0."""
    return F.round(x, digits) + F.lit(0.0)


def from_json_vector(s) -> Column:
    return F.from_json(_col(s), "array<float>")


def to_json_vector(a) -> Column:
    return F.to_json(_col(a))
