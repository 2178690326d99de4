"""Vector algebra on array columns, as native higher-order expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def l2sq(a: ColumnLike, b: ColumnLike) -> Column:
    """Squared Euclidean distance, summed in index order."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: ColumnLike) -> Column:
    return F.sqrt(dot(a, a))


def add(a: ColumnLike, b: ColumnLike) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: ColumnLike, b: ColumnLike) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: ColumnLike, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def upper_triangle(a: ColumnLike) -> Column:
    """Row-major upper triangle of the outer product of a vector with itself."""
    col = F.col(a) if isinstance(a, str) else a
    return F.flatten(F.transform(col, lambda x, i: F.transform(F.slice(col, i + 1, F.size(col)), lambda y: x * y)))


def strided(a: ColumnLike, start: int, step: int) -> Column:
    """Every ``step``-th element from ``start`` on."""
    return F.filter(a, lambda x, i: (i >= start) & ((i - start) % step == 0))


def view(embedding: ColumnLike, space: str) -> Column:
    """The whole interleaved embedding, or the third slot of every prototype."""
    if space == "full":
        return F.col(embedding) if isinstance(embedding, str) else embedding
    if space == "junction":
        return strided(embedding, 2, 3)
    raise ValueError(f"unknown space {space!r}; choose full or junction")


def as_metric(d: Column, metric: str) -> Column:
    """A squared distance as it is, or its root with tiny negatives as 0."""
    if metric == "squared":
        return d
    if metric == "sqrt":
        return F.sqrt(F.greatest(d, F.lit(0.0)))
    raise ValueError(f"unknown metric {metric!r}; choose squared or sqrt")


def mean_vector(value: str, weight: Column | None = None) -> Column:
    """Aggregate: (weighted) sum of array columns by element, as a map-side combinable aggregate.

    ``ml.stat.Summarizer`` keeps one dense buffer a group and merges partial buffers, so a group of
    any size needs no more memory than one vector.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = array_to_vector(F.col(value))
    return vector_to_array(Summarizer.mean(v, weight) if weight is not None else Summarizer.mean(v))


def require_columns(df, needed) -> None:
    """ValueError that lists the missing columns, at call time."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
