"""Vector functions on array columns, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + 1e-8) * (norm(b) + 1e-8))


def unit(v: Column) -> Column:
    return F.transform(doubles(v), lambda x: x / (norm(v) + 1e-8))


def rms(v: Column) -> Column:
    return F.sqrt(dot(v, v) / F.size(v) + 1e-12)
