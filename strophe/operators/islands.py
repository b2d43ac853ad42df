"""Gaps and islands over ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the islands of each key from 0; ``starts`` is true on the first row of a new one (it may use lag over the
    same window). ``order`` must be total. A null counts as no start."""
    w = W.partitionBy(*keys).orderBy(*order)
    one = df.withColumn("_new", F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(starts.cast("int"), F.lit(0))))
    return one.withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def runs(df: DataFrame, keys: list[str], pos: str, flag: Column) -> DataFrame:
    """(keys..., a, b): maximal runs [a, b) of successive integer positions on which ``flag`` holds.

    Positions may have holes, which end a run; repeated positions must be removed before."""
    w = W.partitionBy(*keys).orderBy(pos)
    on = df.filter(flag).select(*keys, pos)
    g = on.withColumn("_g", F.col(pos) - F.row_number().over(w))
    return g.groupBy(*keys, "_g").agg(F.min(pos).alias("a"), (F.max(pos) + 1).alias("b")).drop("_g")


def best_cluster(df: DataFrame, keys: list[str], start: str, end: str, jump: float) -> DataFrame:
    """(keys..., start, end, n): of the clusters of intervals, cut where a start lies more than ``jump`` after the end of
    the row before, the one with most rows; the earliest of equals. Its end is the largest of its ends."""
    w = W.partitionBy(*keys).orderBy(start, end)
    c = islands(df, keys, [start, end], F.col(start) - F.lag(end).over(w) > jump, "_c")
    g = c.groupBy(*keys, "_c").agg(F.min(start).alias("_s"), F.max(end).alias("_e"), F.count(F.lit(1)).alias("n"))
    best = g.groupBy(*keys).agg(F.max_by(F.struct("_s", "_e", "n"), F.struct("n", -F.col("_c"))).alias("x"))
    return best.select(*keys, F.col("x._s").alias("start"), F.col("x._e").alias("end"), F.col("x.n").alias("n"))


def fill_gaps(df: DataFrame, key: str, order: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Untimed rows (null start) get a slot between their timed neighbours, in closed form.

    Of a run of untimed rows k = 1..m, with p the last known end before and x the next known start: between both, if
    they are more than 0.3 apart, the first takes (p + 0.05, x - 0.05) and the rest slots of 1.5 from x on; otherwise all
    take slots of 1.5 from p on. With only x the first ends at x - 0.05. With neither they stay untimed. Ends at or
    before their start become start + 0.8.
    """
    w = W.partitionBy(key).orderBy(*order)
    back, fwd = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    d = df.withColumn("_t", F.col(start).isNotNull())
    d = d.withColumns({
        "_p": F.last(end, True).over(back), "_x": F.first(start, True).over(fwd),
        "_g": F.count(F.when(F.col("_t"), 1)).over(back),
    })
    d = d.withColumn("_k", F.row_number().over(W.partitionBy(key, "_g", "_t").orderBy(*order)).cast("double"))
    p, x, k = F.col("_p"), F.col("_x"), F.col("_k")
    later_s, later_e = x + 1.5 * (k - 2), x + 1.5 * (k - 2) + 1.45
    s = (
        F.when(F.col("_t"), F.col(start))
        .when(p.isNotNull() & x.isNotNull() & (x - p > 0.3), F.when(k == 1, p + 0.05).otherwise(later_s))
        .when(p.isNotNull(), p + 1.5 * (k - 1) + 0.05)
        .when(x.isNotNull(), F.when(k == 1, F.greatest(F.lit(0.0), x - 1.5)).otherwise(later_s))
    )
    e = (
        F.when(F.col("_t"), F.col(end))
        .when(p.isNotNull() & x.isNotNull() & (x - p > 0.3), F.when(k == 1, x - 0.05).otherwise(later_e))
        .when(p.isNotNull(), p + 1.5 * k)
        .when(x.isNotNull(), F.when(k == 1, x - 0.05).otherwise(later_e))
    )
    d = d.withColumns({"_s": s, "_e": e})
    d = d.withColumns({start: F.col("_s"), end: F.when(F.col("_s").isNull(), F.col("_e")).when(F.col("_e").isNull() | (F.col("_e") <= F.col("_s")), F.col("_s") + 0.8).otherwise(F.col("_e"))})
    return d.drop("_t", "_p", "_x", "_g", "_k", "_s", "_e")


#: Slices of the order in which rows are numbered, and how finely their borders are estimated.
SLICES, FINE = 64, 1000


def numbered(df: DataFrame, key: str, by: str, ties: list[str], name: str) -> DataFrame:
    """``df`` with the number of each row in its key, from 0 in order of ``by`` (a number), then of ``ties``.

    Rows are numbered within slices of the range of ``by``; the rows of the slices before are added. So a key that holds much of the data is
    sorted in many tasks. Rows without ``by`` come first. An empty table stays empty.
    """
    cuts = df.select(F.percentile_approx(by, [i / SLICES for i in range(1, SLICES)], FINE)).first()[0] or []
    at = sum(((F.col(by) > c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    x = df.withColumn("_s", F.coalesce(at, F.lit(-1)))
    n = x.groupBy(key, "_s").agg(F.count(F.lit(1)).alias("_n"))
    n = n.select(F.col(key).alias("_k"), F.col("_s").alias("_t"), F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    j = x.join(n, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_t")))
    w = W.partitionBy(key, "_s").orderBy(by, *ties)
    return j.withColumn(name, (F.row_number().over(w) - 1 + F.col("_b")).cast("bigint")).drop("_s", "_k", "_t", "_b")
