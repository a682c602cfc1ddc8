"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector has no length, null if lengths differ."""
    both = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None)).when(both == 0, 0.0).otherwise(dot(a, b) / both)


def normalized(a: Column) -> Column:
    """A vector of length 1 in the same direction; one without length stays as it is."""
    length = norm(a)
    return F.when(length == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x / length))
