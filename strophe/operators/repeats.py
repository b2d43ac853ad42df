"""Stretches of a series of frames that repeat: candidates for loops, their seams, and where a song may take over from a loop.

A frame has a number f from 0 without holes, a feature vector v, an onset strength o, and the levels vl of the voice and il of the music. What
lies ahead of a frame comes to it as arrays from a window over blocks of frames with a halo, so no series is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import similarity as S

#: Frames of one block.
BLOCK = 4_096
#: Frames by which a period may be longer or shorter than asked, and frames its onsets are compared over at most.
SEARCH, LONGEST = 2, 16
#: Weight of the correlation of onsets; frames without voice before a loop and after it; what the loudness may differ in dB.
ONSETS, BEFORE, AFTER, TOLERANCE = 0.3, 1, 2, 4.0
#: dB by which the threshold is relaxed from step to step; the last step allows singing.
STEPS = (0.0, 6.0, 12.0, None)


def ahead(df: DataFrame, key: str, f: str, arrays: dict[str, tuple[str, int, int]]) -> DataFrame:
    """``df`` with arrays of the values around each row: name -> (column, from, to), both ends included, shorter at the ends of a series."""
    lo, hi = max(0, -min(a for _, a, _ in arrays.values())), max(b for _, _, b in arrays.values())
    b = F.floor(F.col(f) / BLOCK)
    near = F.array_distinct(F.array(F.floor((F.col(f) - hi) / BLOCK), b, F.floor((F.col(f) + lo) / BLOCK)))
    x = df.withColumn("_b", F.explode(near))
    w = W.partitionBy(key, "_b").orderBy(f)
    return x.withColumns({n: F.collect_list(c).over(w.rowsBetween(a, z)) for n, (c, a, z) in arrays.items()}).filter(F.col("_b") == b).drop("_b")


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it: it is the one element of an array that is transformed."""
    return F.element_at(F.transform(F.array(value), lambda z: f(z)), 1)


def correlation(a: Column, b: Column, n: Column | int, least: float = 1e-6) -> Column:
    """Pearson correlation of two arrays of n values; null where one is shorter or constant."""
    n = F.lit(n) if isinstance(n, int) else n
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda t, y: t + y) / F.size(x)
    sides = F.struct(a.alias("a"), b.alias("b"), n.alias("n"))
    means = lambda z: F.struct(z["a"].alias("a"), z["b"].alias("b"), z["n"].alias("n"), mean(z["a"]).alias("ma"), mean(z["b"]).alias("mb"))
    centred = lambda z: F.struct(F.transform(z["a"], lambda y: y - z["ma"]).alias("a"), F.transform(z["b"], lambda y: y - z["mb"]).alias("b"), z["n"].alias("n"))
    products = lambda z: F.struct((S.dot(z["a"], z["b"]) / z["n"]).alias("c"), F.sqrt(S.dot(z["a"], z["a"]) / z["n"]).alias("sa"), F.sqrt(S.dot(z["b"], z["b"]) / z["n"]).alias("sb"))
    result = lambda z: F.when((z["sa"] >= least) & (z["sb"] >= least), F.try_divide(z["c"], z["sa"] * z["sb"]))
    whole = lambda z: F.when((F.size(z["a"]) == z["n"]) & (F.size(z["b"]) == z["n"]), _once(means(z), lambda x: _once(centred(x), lambda y: _once(products(y), result))))
    return _once(sides, whole)


def threshold(df: DataFrame, key: str, level: str) -> DataFrame:
    """(key, base): the level below which a series is silent: 18 under the usual loud level, at least 0.4 of the way up from the floor."""
    x = df.select(key, F.greatest(F.col(level), F.lit(-80.0)).alias("_x"))
    p = x.groupBy(key).agg(F.percentile("_x", 0.9).alias("_hi"), F.percentile("_x", 0.1).alias("_lo"))
    m = x.join(p, key).filter("_x > _hi - 15").groupBy(key).agg(F.median("_x").alias("_s"), F.max("_lo").alias("_l"))
    return m.select(key, F.greatest(F.col("_s") - 18, F.col("_l") + 0.4 * (F.col("_s") - F.col("_l"))).alias("base"))


def periods(x: DataFrame, key: str, bars: tuple[int, ...], bar: int, beat: int) -> DataFrame:
    """Beats with (bars, length, pc) for every number of bars: the length near it at which the onsets recur best, the shortest of equals, and
    that correlation; -9 and the length asked for where no correlation exists. Arrays vs and is of the levels come along."""
    far = (bar * max(bars) + SEARCH) * 3
    a = ahead(x, key, "f", {"os": ("o", 0, bar * max(bars) + SEARCH + LONGEST), "vs": ("vl", -BEFORE, far + AFTER), "ms": ("il", 0, far)}).filter(F.col("f") % beat == 0)
    y = a.drop("v", "o", "vl", "il").withColumn("bars", F.explode(F.array(*map(F.lit, bars))))
    w = F.least(F.lit(LONGEST), F.col("bars") * bar)
    one = lambda d: F.struct((-F.round(correlation(F.slice("os", F.lit(1), w), F.slice("os", F.col("bars") * bar + d + 1, w), w), 6)).alias("c"), F.lit(d).alias("d"))
    best = F.array_min(F.filter(F.array(*(one(d) for d in range(-SEARCH, SEARCH + 1))), lambda z: z["c"].isNotNull()))
    y = y.withColumn("_m", best).drop("os")
    return y.select("*", (F.col("bars") * bar + F.coalesce("_m.d", F.lit(0))).alias("length"), F.coalesce(-F.col("_m.c"), F.lit(-9.0)).alias("pc")).drop("_m")


def search(x: DataFrame, key: str, bars: tuple[int, ...], bar: int, beat: int) -> DataFrame:
    """(key, bars, rung, f, length, pc, sim, score): every stretch that may be repeated, on each rung of the ladder: the thresholds of
    STEPS, each first for the loop and the next cycle, then for the loop alone.

    The voice stays under the threshold from before the loop to after it, and the music is about as loud as it usually is without voice. The similarity is
    the mean cosine, of frames less their mean without voice, of a cycle with the next; where the third cycle has no voice, the
    lesser of that and the next one's. A key without frames under a threshold has no row for it.
    """
    n = x.groupBy(key).agg(F.count(F.lit(1)).alias("frames"))
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(1e9) if s is None else F.col("base") + s).alias("vf")) for k, s in enumerate(STEPS)))).alias("s")
    th = threshold(x, key, "vl").select(key, steps).select(key, "s.k", "s.vf")
    free = x.join(th, key).filter("vl < vf")
    usual = free.groupBy(key, "k").agg(F.median("il").alias("med"))
    # of a centred frame only its products with others are needed: (v - m)(w - m) = vw - vm - wm + mm, so vectors meet once a lag and not once a threshold
    v = x.select(key, "f", "v")
    own = v.join(S.means(free, [key, "k"], "v"), key).select(key, "k", "f", S.dot(F.col("v"), F.col("mean")).alias("vm"), S.dot(F.col("v"), F.col("v")).alias("vv"), S.dot(F.col("mean"), F.col("mean")).alias("mm"))
    own = own.select(key, "k", "f", "vm", "mm", F.sqrt(F.greatest(F.lit(0.0), F.col("vv") - 2 * F.col("vm") + F.col("mm"))).alias("norm"))
    lags = sorted({b * bar + d for b in bars for d in range(-SEARCH, SEARCH + 1)})
    products = v.withColumn("length", F.explode(F.array(*map(F.lit, lags)))).withColumn("_b", F.col("f") + F.col("length")).join(v.select(key, F.col("f").alias("_b"), F.col("v").alias("_w")), [key, "_b"])
    products = products.select(key, F.col("f").alias("_a"), "length", S.dot(F.col("v"), F.col("_w")).alias("vw"))

    y = periods(x, key, bars, bar, beat).join(n, key)
    y = y.filter((F.col("f") >= BEFORE) & (F.col("f") + 2 * F.col("length") + AFTER < F.col("frames")))
    y = y.join(th, key).join(usual, [key, "k"]).withColumn("strict", F.explode(F.array(F.lit(1), F.lit(0))))
    y = y.withColumns({"rung": 2 * F.col("k") + 1 - F.col("strict"), "span": (1 + F.col("strict")) * F.col("length")})
    total = F.aggregate(F.slice("ms", F.lit(1), F.col("span")), F.lit(0.0), lambda a, z: a + z)
    tolerance = F.when(F.col("rung").isin(4, 5), 2 * TOLERANCE).otherwise(TOLERANCE)
    quiet = F.array_max(F.slice("vs", F.lit(1), F.col("span") + BEFORE + AFTER)) <= F.col("vf")
    y = y.filter(quiet & (F.abs(total / F.col("span") - F.col("med")) <= tolerance))
    third = (F.col("f") + 3 * F.col("length") < F.col("frames")) & (F.array_max(F.slice("vs", 2 * F.col("length") + BEFORE + 1, F.col("length"))) <= F.col("vf"))
    y = y.withColumn("third", F.coalesce(third, F.lit(False))).drop("vs", "ms", "med", "frames", "span", "strict")

    i = y.select(key, "k", "f", "length").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), 2 * F.col("length") - 1)))
    side = lambda n: own.select(key, "k", F.col("f").alias(n), F.col("vm").alias(f"{n}m"), F.col("norm").alias(f"{n}n"), *(["mm"] if n == "_a" else []))
    c = i.withColumns({"_a": F.col("f") + F.col("i"), "_b": F.col("f") + F.col("length") + F.col("i")}).join(products, [key, "_a", "length"]).join(side("_a"), [key, "k", "_a"]).join(side("_b"), [key, "k", "_b"])
    cos = (F.col("vw") - F.col("_am") - F.col("_bm") + F.col("mm")) / (F.col("_an") * F.col("_bn") + 1e-9)
    early = F.col("i") < F.col("length")
    c = c.groupBy(key, "k", "f", "length").agg(F.avg(F.when(early, cos)).alias("s1"), F.avg(F.when(~early, cos)).alias("s2"))
    sim = F.when(F.col("length") < 4, -1.0).when(F.col("third"), F.least("s1", "s2")).otherwise(F.col("s1"))
    out = y.join(c, [key, "k", "f", "length"]).withColumn("sim", sim)
    return out.select(key, "bars", "rung", "f", "length", F.round("pc", 6).alias("pc"), F.round("sim", 6).alias("sim"), F.round(F.col("sim") + ONSETS * F.col("pc"), 6).alias("score"))


def _around(c: int) -> Column:
    """The frames around the border of cycle c of a loop."""
    return F.transform(F.sequence(F.lit(-3), F.lit(2)), lambda j: F.struct(F.lit(c).alias("c"), (F.col("f") + c * F.col("length") + j).alias("g")))


def seams(x: DataFrame, key: str, loops: DataFrame) -> DataFrame:
    """(key, f, length, seam) of loops: the largest change from frame to frame around their seam, whose first frame is what follows the loop in
    the original, against the mean of the largest changes at the same place of three cycles of the original."""
    v = x.select(key, "f", "v")
    nxt = v.select(key, (F.col("f") - 1).alias("f"), F.col("v").alias("_n"))
    flux = v.join(nxt, [key, "f"]).select(key, "f", S.mean_difference(F.col("v"), F.col("_n")).alias("y"))
    t = loops.select(key, "f", "length").distinct()
    k = F.explode(F.flatten(F.array(*(_around(c) for c in range(3))))).alias("k")
    ref = t.select(key, "f", "length", k).select(key, F.col("f").alias("_f"), "length", "k.c", F.col("k.g").alias("f")).join(flux, [key, "f"])
    ref = ref.groupBy(key, "_f", "length", "c").agg(F.max("y").alias("y")).groupBy(key, "_f", "length").agg(F.avg("y").alias("ref"))
    own = F.explode(F.array(*(F.col("f") + j for j in (1, 2)), *(F.col("f") + F.col("length") - j for j in (3, 2, 1)))).alias("g")
    inner = t.select(key, F.col("f").alias("_f"), "length", own).filter(F.col("g").between(F.col("_f") + 1, F.col("_f") + F.col("length") - 1)).withColumnRenamed("g", "f").join(flux, [key, "f"])
    inner = inner.groupBy(key, "_f", "length").agg(F.max("y").alias("inner"))
    p = v.select(key, (F.col("f") - 1).alias("_f"), F.col("v").alias("_p"))
    q = t.select(key, F.col("f").alias("_f"), "length", (F.col("f") + F.col("length")).alias("f")).join(v, [key, "f"]).join(p, [key, "_f"])
    jump = q.select(key, "_f", "length", S.mean_difference(F.col("_p"), F.col("v")).alias("jump"))
    z = jump.join(inner, [key, "_f", "length"]).join(ref, [key, "_f", "length"])
    return z.select(key, F.col("_f").alias("f"), "length", F.round(F.greatest("jump", "inner") / (F.col("ref") + 1e-9), 6).alias("seam"))


def entries(x: DataFrame, key: str, loop: int, beat: int, bpb: int, lo: int, short: int, cross: int, width: int) -> DataFrame:
    """(key, t, q, ref, hi): beats t on which a song may take over from a loop that starts near frame ``loop``, with their phase q in the bar and the
    frame ref of the loop at that phase; from ``lo`` on, ``cross`` frames before the last but ``short``. Keys of fewer than two bars have none."""
    n = x.groupBy(key).agg(F.count(F.lit(1)).alias("frames"))
    b = x.filter(F.col("f") % beat == 0).select(key, "f", F.floor(F.col("f") / beat).alias("j"))
    j0 = b.groupBy(key).agg(F.min(F.struct(F.abs(F.col("f") - loop).alias("d"), "j")).alias("m")).select(key, F.col("m.j").alias("j0"))
    y = b.join(j0, key).join(n, key).filter(F.col("frames") >= 2 * bpb * beat)
    q = F.pmod(F.col("j") - F.col("j0"), F.lit(bpb))
    y = y.withColumns({"q": q, "ref": (F.col("j0") + q) * beat, "hi": F.col("frames") - short})
    ok = (F.col("f") >= lo) & (F.col("f") + cross <= F.col("hi")) & (F.col("f") + width + 1 < F.col("frames")) & (F.col("ref") + width <= F.col("frames"))
    return y.filter(ok).select(key, F.col("f").alias("t"), F.col("q").cast("bigint").alias("q"), "ref", "hi")


def scored_entries(x: DataFrame, key: str, e: DataFrame, lag: int, cross: int, width: int) -> DataFrame:
    """(key, t, q, d, oc, sim, score) of entries: the lag d of at most ``lag`` frames at which the onsets of the next ``width`` frames correlate best
    with the loop's, that correlation, the mean cosine there, and the score."""
    w = ahead(x.select(key, "f", "o"), key, "f", {"os": ("o", 0, width - 1)}).select(key, "f", "os")
    ref = w.select(key, F.col("f").alias("ref"), F.col("os").alias("_r"))
    own = e.withColumn("d", F.explode(F.sequence(F.lit(-lag), F.lit(lag)))).withColumn("f", F.col("t") + F.col("d")).join(w, [key, "f"]).join(ref, [key, "ref"])
    oc = F.coalesce(correlation(F.col("_r"), F.col("os"), width, 1e-9), F.lit(-1.0))
    best = own.withColumn("oc", oc).groupBy(key, "t", "q", "ref", "hi").agg(F.min(F.struct((-F.round("oc", 6)).alias("n"), "d", "oc")).alias("m"))
    best = best.select(key, "t", "q", "ref", "hi", "m.d", F.round("m.oc", 6).alias("oc"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i"))
    u = x.join(S.means(x, [key], "v"), key).select(key, "f", S.minus(F.col("v"), F.col("mean")).alias("u"))
    a = u.select(key, F.col("f").alias("_a"), F.col("u").alias("_u"))
    b = u.select(key, F.col("f").alias("_b"), F.col("u").alias("_w"))
    c = best.withColumns({"_a": F.col("ref") + F.col("i"), "_b": F.col("t") + F.col("d") + F.col("i")}).join(a, [key, "_a"]).join(b, [key, "_b"])
    c = c.groupBy(key, "t", "q", "d", "oc", "hi").agg(F.round(F.avg(S.cosine(F.col("_u"), F.col("_w"))), 6).alias("sim"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == width)
    late = 0.01 * F.greatest(F.lit(0), F.col("hi") - cross - (F.col("t") + F.col("d")))
    score = F.round(F.col("sim") + 0.5 * F.col("oc") + F.when(F.col("q") == 0, 0.05).otherwise(0.0) - late, 6)
    return c.select(key, "t", "q", "d", "oc", "sim", score.alias("score"))
