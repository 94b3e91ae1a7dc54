"""Column expressions over arrays and structs: padding, vectors, confidences, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad(xs: Column, n: Column, value: Column) -> Column:
    """Filled up at the end to n elements."""
    return F.concat(xs, F.array_repeat(value, F.greatest(n - F.size(xs), F.lit(0)).cast("int")))


def reverse_inner(xs: Column) -> Column:
    """The first and the last element stay, those between are turned round."""
    n = F.size(xs)
    return F.when(n <= 2, xs).otherwise(F.concat(F.slice(xs, 1, 1), F.reverse(F.slice(xs, F.lit(2), F.greatest(n - 2, F.lit(0)))), F.slice(xs, -1, 1)))


def softmax_max(xs: Column) -> Column:
    """The largest value of the softmax."""
    top = F.array_max(xs)
    return 1.0 / F.aggregate(xs, F.lit(0.0).cast("double"), lambda a, x: a + F.exp((x - top).cast("double")))


def normalise(xs: Column, mean: Column, std: Column) -> Column:
    return F.transform(xs, lambda x, i: (x.cast("double") - F.get(mean, i)) / F.get(std, i))


def denormalise(xs: Column, mean: Column, std: Column) -> Column:
    return F.transform(xs, lambda x, i: x * F.get(std, i) + F.get(mean, i))


def repeat_each(xs: Column, times: Column) -> Column:
    """Every value as often as the array of counts says."""
    return F.flatten(F.transform(F.arrays_zip(xs.alias("x"), times.alias("n")), lambda z: F.array_repeat(z["x"], z["n"].cast("int"))))


def box_of(points: Column) -> Column:
    """Bounding box of 'x,y x,y ...'."""
    each = F.transform(F.split(points, " "), lambda p: F.struct(F.split_part(p, F.lit(","), F.lit(1)).cast("int").alias("x"), F.split_part(p, F.lit(","), F.lit(2)).cast("int").alias("y")))
    xs, ys = F.transform(each, lambda p: p["x"]), F.transform(each, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("l"), F.array_min(ys).alias("t"), F.array_max(xs).alias("r"), F.array_max(ys).alias("b"))


def scaled(box: Column, ratio: float) -> Column:
    return F.struct(*(F.floor(box[k] * ratio).cast("int").alias(k) for k in "ltrb"))
