"""One mixture of several sources with target shares of the total size.

Efraimidis-Spirakis sampling: every document gets the key -ln(u) / weight, u from a hash of its id; the smallest
keys of a source are its sample. A source first gives whole epochs, then documents in order of their keys up to
the tokens that are still missing. Prefix sums are taken over slices of the key range; only the slice in which
a budget ends is put in order row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Slices of the range of keys, at least, and rows of a slice at which there are more.
SLICES, PART = 4096, 1_000_000


def budgets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, have, budget, epochs, part): tokens each source has and shall give.

    The total is the largest at which no source needs more than max_repeats epochs. Sources without tokens, or without
    a positive share or repeats, get nothing and don't hold the others back.
    """
    have = docs.groupBy("source").agg(F.sum("tokens").alias("have"))
    t = targets.filter("source is not null").dropDuplicates(["source"]).join(have, "source", "left")
    can = F.expr("try_divide(max_repeats * have, target_share)")
    t = t.withColumn("can", F.when((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("have") > 0), can))
    t = t.withColumn("total", F.min("can").over(W.partitionBy()))  # mix_targets: a handful of rows, fixed
    budget = F.coalesce(F.when(F.col("can").isNotNull(), F.floor(F.col("total") * F.col("target_share") + 1e-6)), F.lit(0).cast("bigint"))
    t = t.withColumn("budget", F.least(budget, F.coalesce(F.col("max_repeats") * F.col("have"), F.lit(0))).cast("bigint"))
    t = t.withColumn("epochs", F.coalesce(F.expr("try_divide(budget - budget % have, have)"), F.lit(0)).cast("int"))
    return t.select("source", "target_share", "max_repeats", F.coalesce("have", F.lit(0)).alias("have"), "budget", "epochs", (F.col("budget") - F.col("epochs") * F.coalesce("have", F.lit(0))).alias("part"))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """((source, epoch, doc_id, tokens), (source, target_share, actual_share, tokens, most_used, max_repeats)).

    ``docs`` has (doc_id, source, tokens, weight). Documents without tokens or of sources without a target are left out;
    equal keys are ordered by doc_id.
    """
    from ..session import cut

    docs = cut(docs.filter("tokens > 0 and source is not null"))
    b = cut(budgets(docs, targets))
    slices = max(SLICES, docs.count() // PART)
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    d = docs.join(F.broadcast(b.select("source", "epochs", "part")), "source")  # one row a source of mix_targets
    d = d.withColumn("key", -F.log(u) / F.col("weight"))
    d = d.withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * slices))
    sums = d.groupBy("source", "slice").agg(F.sum("tokens").alias("t"), F.first("part").alias("part"))
    ahead = F.sum("t").over(W.partitionBy("source").orderBy("slice")) - F.col("t")
    edge = sums.withColumn("ahead", ahead).filter("part > 0 and ahead < part and ahead + t > part")
    # the slice of each source in which its budget ends: one row a source
    d = d.join(F.broadcast(edge.select("source", F.col("slice").alias("edge"), "ahead")), "source", "left")
    # all of a part is used up where no slice exceeds it, which only happens with part = 0 or the end of a slice
    below = cut(sums.withColumn("upto", F.sum("t").over(W.partitionBy("source").orderBy("slice"))).filter("upto <= part").groupBy("source").agg(F.max("slice").alias("last")))
    d = d.join(F.broadcast(below), "source", "left")
    inside = d.filter("slice = edge").withColumn("run", F.col("ahead") + F.sum("tokens").over(W.partitionBy("source").orderBy("key", "doc_id"))).filter("run <= part")
    more = d.filter("slice <= last").select("source", "epochs", "doc_id", "tokens").unionByName(inside.select("source", "epochs", "doc_id", "tokens"))
    last = more.select("source", F.col("epochs").alias("epoch"), "doc_id", "tokens")
    whole = d.filter("epochs > 0").select("source", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"), "doc_id", "tokens")
    out = whole.unionByName(last)
    got = out.groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("epoch") + 1).alias("most_used"))
    s = b.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    shares = s.select("source", "target_share", F.round(F.expr("try_divide(tokens, sum(tokens) over ())"), 6).alias("actual_share"), "tokens", F.coalesce("most_used", F.lit(0)).alias("most_used"), "max_repeats")
    return out, shares


def checked(docs: DataFrame, mixed: DataFrame, shares: DataFrame) -> DataFrame:
    """(source, target_share, share_ok, repeats_ok, epochs_ok) of a mixture: whether each share differs from its target by no more than the largest
    document of each source makes, no document is used too often, and none is used twice more than another of its source.
    A mixture without tokens has no right share."""
    most = docs.filter("tokens > 0").groupBy("source").agg(F.max("tokens").alias("largest"), F.count(F.lit(1)).alias("n"))
    used = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("k")).groupBy("source").agg(F.max("k").alias("hi"), F.min("k").alias("lo"), F.count(F.lit(1)).alias("m"))
    x = shares.join(most, "source", "left").join(used, "source", "left")
    w = W.partitionBy()  # a row for each source of mix_targets
    x = x.withColumn("slack", F.sum("largest").over(w) / F.sum("tokens").over(w))
    lo = F.when(F.col("m") < F.col("n"), 0).otherwise(F.col("lo"))
    return x.select(
        "source", "target_share", F.coalesce(F.abs(F.col("actual_share") - F.col("target_share")) <= F.col("slack"), F.lit(False)).alias("share_ok"),
        (F.coalesce("hi", F.lit(0)) <= F.col("max_repeats")).alias("repeats_ok"), (F.coalesce(F.col("hi") - lo, F.lit(0)) <= 1).alias("epochs_ok"),
    )
