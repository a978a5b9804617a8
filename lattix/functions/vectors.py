"""Distances and products of array columns, all higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column | str) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def masked_distance(a: Column, b: Column) -> Column:
    """Over the elements that are not null in either."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.coalesce((x - y) * (x - y), F.lit(0.0)))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x / norm(a))
