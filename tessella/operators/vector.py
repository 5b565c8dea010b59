"""Nearest neighbours by Euclidean distance: exact, as one pass with a bounded heap in each task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(vector: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    squares = F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def knn(rows: DataFrame, id_column: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(id, distance) of the k nearest, ties by id; vectors of another length and nulls are left out."""
    fit = rows.where(F.size(vector) == len(query))
    return fit.select(F.col(id_column).alias("id"), distance(F.col(vector), query).alias("distance")).orderBy("distance", "id").limit(k)
