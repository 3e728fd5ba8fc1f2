"""Vectors and scores as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for an empty vector, unequal lengths or a zero norm."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) <= 0) | (F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def proximity(hop: Column) -> Column:
    return 1.0 / (1.0 + hop)


def recency(occurred: Column, created: Column, now: Column, half_life_days: float) -> Column:
    age = (F.unix_micros(now) - F.unix_micros(F.coalesce(occurred, created))) / 86_400e6
    return F.exp(-math.log(2) * F.greatest(F.lit(0.0), age) / half_life_days)


def frequency(count: Column, most: Column) -> Column:
    return F.when(most <= 0, F.lit(0.0)).otherwise(F.log1p(count) / F.log1p(most))
