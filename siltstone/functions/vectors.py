"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 for empty, unequal or zero vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def cosine_to(a: Column, query: list[float]) -> Column:
    """Cosine with a constant vector whose norm is known when the query is planned."""
    norm = sum(x * x for x in query) ** 0.5
    if not query or norm == 0:
        return F.lit(0.0)
    q = F.array(*[F.lit(float(x)) for x in query])
    own = F.sqrt(dot(a, a))
    return F.when((F.size(a) == len(query)) & (own > 0), dot(a, q) / (own * norm)).otherwise(F.lit(0.0))
