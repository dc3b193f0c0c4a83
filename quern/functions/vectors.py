"""Vector expressions: double-precision folds over arrays, guarded against zero vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from the first component on; the shorter vector counts as if it ended in zeros."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(F.slice(products, F.lit(1), F.least(F.size(a), F.size(b))), F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit vector; a zero vector stays zero, so its scores are 0 and never NaN."""
    # Bound once: the norm of a row is not computed again per component.
    return F.get(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def of_dimension(v: Column, size: int) -> Column:
    """The vector, or an error for any other number of components."""
    return F.when(F.size(v) == size, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {size} components, got "), F.size(v).cast("string"))))


def literal(values: list[float]) -> Column:
    """A query vector as a constant: folded once, never sent per row."""
    return F.array(*(F.lit(float(x)) for x in values))
