"""Vector expressions and aggregates."""

from __future__ import annotations

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F


def as_double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)


def with_unit(df: DataFrame, vector: str, out: str = "unit") -> DataFrame:
    """Add the vector scaled to length 1; a zero vector stays zero, so its cosine is 0."""
    raw = df.withColumn("_raw", array_to_vector(as_double(vector)))
    return Normalizer(p=2.0, inputCol="_raw", outputCol=out).transform(raw).drop("_raw")


def is_nonzero(vector: Column | str) -> Column:
    return F.exists(vector, lambda v: v != 0)


def mean_vector(a: Column) -> Column:
    """Aggregate: mean of an array column, with partial sums on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(a)))


def mean_unit(u: Column | str) -> Column:
    """Aggregate: mean of a :func:`with_unit` column."""
    return vector_to_array(Summarizer.mean(F.col(u) if isinstance(u, str) else u))


def sum_unit(u: Column | str) -> Column:
    """Aggregate: sum of a :func:`with_unit` column."""
    return vector_to_array(Summarizer.sum(F.col(u) if isinstance(u, str) else u))
