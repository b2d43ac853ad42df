"""Similarity of feature frames and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with 1e-9 added to the denominator, so that silence gives 0."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def pearson(x: str, y: str, least: float = 1e-9) -> Column:
    """Pearson correlation as an aggregate; -1 where a side is constant or there are no rows."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.coalesce(F.when((sx >= least) & (sy >= least), F.try_divide(F.covar_pop(x, y), sx * sy)), F.lit(-1.0))


def cycle(df: DataFrame, key: str, f: str, v: str, n: int) -> DataFrame:
    """(key, f, cos): each frame against the one ``n`` later. An equi join on the shifted frame number; frames may have holes."""
    later = df.select(key, (F.col(f) - n).alias(f), F.col(v).alias("_w"))
    return df.select(key, f, F.col(v).alias("_v")).join(later, [key, f]).select(key, f, cosine(F.col("_v"), F.col("_w")).alias("cos"))


def stretch(c: DataFrame, key: str, f: str, n: int) -> DataFrame:
    """(key, f, sim): mean cosine of the ``n`` successive frames from each frame on, where all of them exist."""
    w = W.partitionBy(key).orderBy(f).rangeBetween(0, n - 1)
    s = c.withColumns({"sim": F.avg("cos").over(w), "_n": F.count(F.lit(1)).over(w)})
    return s.filter(F.col("_n") == n).select(key, f, "sim")


def means(df: DataFrame, keys: list[str], v: str, name: str = "mean") -> DataFrame:
    """(keys..., name): the mean of each place of the arrays of a key."""
    b = df.select(*keys, F.posexplode(v).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"))
    return b.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_l")).select(*keys, F.col("_l._m").alias(name))


def minus(a: Column, b: Column) -> Column:
    """Difference of two arrays, place by place."""
    return F.zip_with(a, b, lambda x, y: x - y)
