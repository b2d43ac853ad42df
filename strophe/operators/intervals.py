"""Interval and as-of joins. Every helper takes a key, so that plans are hash or merge joins on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cover(df: DataFrame, keys: list[str], a, b, pos: str) -> DataFrame:
    """One row for each integer position in [a, b) of each row: a range condition becomes an equality on ``pos``."""
    return df.filter(b > a).withColumn(pos, F.explode(F.sequence(a.cast("bigint"), (b - 1).cast("bigint"))))


def asof_last(left: DataFrame, right: DataFrame, key: str, ts: str, cols: list[str]) -> DataFrame:
    """``left`` with the values of the latest row of ``right`` at or before its ``ts``, null where there is none.

    One union and one window over (key, ts): no range join. At equal times right rows come first, the last of them by
    their values wins. Both sides need ``key`` and ``ts``; ``cols`` are taken from the right.
    """
    own = left.columns
    r = right.select(F.lit(0).alias("_side"), key, ts, F.struct(*cols).alias("_r"))
    u = left.select(F.lit(1).alias("_side"), *own).unionByName(r, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(ts, "_side", "_r").rowsBetween(W.unboundedPreceding, 0)
    u = u.withColumn("_m", F.last("_r", True).over(w)).filter("_side = 1")
    return u.select(*own, *(F.col("_m")[c].alias(c) for c in cols))


def next_after(left: DataFrame, right: DataFrame, key: str, ts: str, cols: list[str]) -> DataFrame:
    """As :func:`asof_last`, but the earliest row of ``right`` strictly after ``ts``."""
    own = left.columns
    r = right.select(F.lit(1).alias("_side"), key, ts, F.struct(*cols).alias("_r"))
    u = left.select(F.lit(0).alias("_side"), *own).unionByName(r, allowMissingColumns=True)
    # a left row at the same time comes after the right rows, seen backwards it doesn't see them
    w = W.partitionBy(key).orderBy(F.col(ts).desc(), F.col("_side"), F.col("_r").desc()).rowsBetween(W.unboundedPreceding, 0)
    u = u.withColumn("_m", F.last("_r", True).over(w)).filter("_side = 0")
    return u.select(*own, *(F.col("_m")[c].alias(c) for c in cols))


def overlap(left: DataFrame, right: DataFrame, key: str, cols: list[str] = ()) -> DataFrame:
    """Rows of (key, a, b, ...) and (key, a, b, ...) of whole numbers that overlap, the right clipped to the left as (ra, rb), with the
    columns ``cols`` of the right.

    Both sides are cut at the borders of buckets of time and meet by (key, bucket), so that a key with many rows is no product; a pair counts in the
    first bucket it shares. A key's buckets are as wide as its rows on the left lie apart on average, and of the right only what lies between the
    first and the last of them is cut, so there are hardly more pieces than rows. Rows whose b isn't above a overlap nothing.
    """
    lo, hi = F.min("a"), F.max("b")
    n = left.filter("a < b").groupBy(F.col(key).alias("_k")).agg(F.greatest(F.lit(1), F.ceil((hi - lo) / F.count(F.lit(1)))).cast("bigint").alias("_w"), lo.alias("_lo"), hi.alias("_hi"))
    at = lambda c: F.floor(F.col(c) / F.col("_w"))
    pieces = lambda a, b: F.explode(F.sequence(at(a), F.floor((F.col(b) - 1) / F.col("_w"))))
    le = left.filter("a < b").join(n.drop("_lo", "_hi"), F.col(key) == F.col("_k")).drop("_k").withColumn("_at", pieces("a", "b"))
    ro = right.filter("a < b").select(F.col(key).alias("_r"), "a", "b", *cols).join(n, F.col("_r") == F.col("_k"))
    ro = ro.select("_r", F.greatest("a", "_lo").alias("_a"), F.least("b", "_hi").alias("_b"), "_w", *cols).filter("_a < _b")
    ro = ro.select("_r", "_a", "_b", *cols, pieces("_a", "_b").alias("_s"))
    j = le.join(ro, (F.col(key) == F.col("_r")) & (F.col("_at") == F.col("_s")) & (F.col("_a") < F.col("b")) & (F.col("_b") > F.col("a")))
    j = j.filter(F.col("_at") == F.greatest(at("a"), at("_a")))
    return j.select(*left.columns, *cols, F.greatest("_a", "a").alias("ra"), F.least("_b", "b").alias("rb"))


def first_begun(df: DataFrame, keys: list[str], last: str) -> DataFrame:
    """Rows of (keys, a, b, ...) with the time ``since`` from which each is the first begun of all that are open, up to its b; others are
    left out. Of those begun at once the one with the least ``last`` comes first.

    A row is first when all begun before it have ended, so these stretches never overlap: an as-of lookup finds the one at a moment, and
    no pairs are made. Rows whose b isn't above a are never open.
    """
    w = W.partitionBy(*keys).orderBy("a", F.col(last).asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    return df.filter("a < b").withColumn("since", F.greatest("a", F.max("b").over(w))).filter("since < b")


def tile(cuts: DataFrame, key: str, t: str, thin: float = 0.04) -> DataFrame:
    """(key, t0, t1): successive cut points as intervals. A point within ``thin`` of the point before it is left out;
    the comparison is with the list as it was, so a chain of close points loses all but the first."""
    w = W.partitionBy(key).orderBy(t)
    c = cuts.select(key, t).distinct()
    c = c.withColumn("_p", F.lag(t).over(w)).filter(F.col("_p").isNull() | (F.col(t) - F.col("_p") > thin))
    return c.withColumn("t1", F.lead(t).over(w)).filter("t1 is not null").select(key, F.col(t).alias("t0"), "t1")
