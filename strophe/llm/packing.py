"""Fixed-capacity containers filled with documents.

Only the number of items of each size matters for the plan, and sizes are whole numbers up to the capacity, so
the plan is made from a histogram whose length the capacity bounds, however many documents there are. Large
items (over a third of the capacity) are matched greedily, at most two to a bin; smaller ones go, the largest
first, to the tightest gap that takes them. The plan consists of ranges: items r0.. of one size fill bins
b0.. with q to a bin. Documents find their bin by their rank among those of their size.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts in which the documents of one size are ranked, at least, and rows of a part at which there are more.
SALTS, PART = 16, 1_000_000
#: The largest capacity: the histogram and the plan, which the driver holds, have hardly more rows than it.
LARGEST = 1 << 20


def plan(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(size, first rank, items, first bin, items a bin)], bins) for counts of items by size, sizes 1..capacity."""
    left = {s: n for s, n in sizes.items() if n > 0}
    rank: dict[int, int] = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of bins (first, number)
    order: list[int] = []  # gaps that have bins, ascending
    bins = 0

    def place(s: int, first: int, n_bins: int, q: int, n: int) -> None:
        out.append((s, rank[s], n, first, q))
        rank[s] += n
        left[s] -= n

    def free(gap: int, first: int, n: int) -> None:
        if n > 0 and gap > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    alive = list(large)
    while alive:
        s = alive[-1]
        k = bisect_left(alive, capacity - s + 1) - 1
        t = alive[k] if k >= 0 else 0
        if not t:
            n = left[s]
            place(s, bins, n, 1, n)
            free(capacity - s, bins, n)
        elif t == s:
            n = left[s] // 2
            if n:
                place(s, bins, n, 2, 2 * n)
                free(capacity - 2 * s, bins, n)
            elif k > 0:
                t = alive[k - 1]
                n = 1
                place(s, bins, 1, 1, 1)
                place(t, bins, 1, 1, 1)
                free(capacity - s - t, bins, 1)
                if not left[t]:
                    alive.remove(t)
            else:
                n = 1
                place(s, bins, 1, 1, 1)
                free(capacity - s, bins, 1)
        else:
            n = min(left[s], left[t])
            place(s, bins, n, 1, n)
            place(t, bins, n, 1, n)
            free(capacity - s - t, bins, n)
            if not left[t]:
                alive.remove(t)
        bins += n
        if not left[s]:
            alive.remove(s)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            i = bisect_left(order, s)
            if i == len(order):
                q = capacity // s
                n = -(-left[s] // q)
                free(capacity, bins, n)
                bins += n
                continue
            gap = order[i]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(i)
            q = gap // s
            full = min(n, left[s] // q)
            if full:
                place(s, first, full, q, full * q)
                free(gap - q * s, first, full)
            if full < n:
                rest = left[s] if left[s] < q else 0
                if rest:
                    place(s, first + full, 1, rest, rest)
                    free(gap - rest * s, first + full, 1)
                    full += 1
                free(gap, first + full, n - full)
    return out, bins


def pack(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, bin_id, doc_id, piece, from_token, tokens): every document in a container of each capacity.

    ``sizes`` has (doc_id, tokens). A document above the capacity is cut into full pieces, one bin each ('d<doc>-<piece>'),
    and a rest that is packed like any item; no other document is split. Documents without tokens share the bin 'empty'.
    Packs with a null or non-positive capacity give no rows; one above LARGEST is an error.
    """
    from ..session import cut

    sizes = cut(sizes.select("doc_id", "tokens"))
    # pack_sizes: a handful of rows, fixed
    p = [tuple(r) for r in packs.filter("capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("bigint")).distinct().collect()]
    if any(c > LARGEST for _, c in p):
        raise ValueError(f"capacities above {LARGEST} are not planned for")
    each = F.array(*(F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("bigint").alias("c")) for n, c in sorted(p, key=str)))
    x = sizes.withColumn("p", F.explode(each.cast("array<struct<pack_name: string, c: bigint>>"))).select("doc_id", "tokens", "p.*")
    x = x.withColumns({"full": F.when(F.col("tokens") > F.col("c"), F.floor(F.col("tokens") / F.col("c"))).otherwise(0)})
    x = x.withColumn("rest", F.col("tokens") - F.col("full") * F.col("c"))
    # the histogram has at most as many rows as the capacities add up to
    counts = x.filter("rest > 0").groupBy("pack_name", "c", "rest").agg(F.count(F.lit(1)).alias("n")).collect()
    by: dict[tuple[str, int], dict[int, int]] = {}
    for r in counts:
        by.setdefault((r["pack_name"], r["c"]), {})[r["rest"]] = r["n"]
    rows = []
    for (name, c), h in sorted(by.items(), key=str):
        rows += [(name, *seg) for seg in plan(h, c)[0]]
    salts = max(SALTS, sum(r["n"] for r in counts) // PART)
    spark = sizes.sparkSession
    segments = spark.createDataFrame(rows, "pack_name string, rest bigint, r0 bigint, items bigint, b0 bigint, q bigint")
    # ranks among the documents of one size, in parts so that a common size is no single task
    items = x.filter("rest > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    per = items.groupBy("pack_name", "rest", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("pack_name", "rest").orderBy("salt")) - F.col("n")
    per = per.select("pack_name", "rest", "salt", before.alias("before"))
    rn = F.row_number().over(W.partitionBy("pack_name", "rest", "salt").orderBy("doc_id")) - 1
    ranked = items.withColumn("rn", rn).join(per, ["pack_name", "rest", "salt"]).withColumn("r", F.col("rn") + F.col("before"))
    hit = (ranked["pack_name"] == segments["pack_name"]) & (ranked["rest"] == segments["rest"]) & (ranked["r"] >= segments["r0"]) & (ranked["r"] < segments["r0"] + segments["items"])
    placed = ranked.join(F.broadcast(segments), hit).select(  # a few segments for each size: bounded by the capacities
        ranked["pack_name"],
        F.concat(F.lit("b"), (F.col("b0") + F.floor((F.col("r") - F.col("r0")) / F.col("q"))).cast("string")).alias("bin_id"),
        "doc_id",
        F.col("full").cast("int").alias("piece"),
        (F.col("full") * F.col("c")).alias("from_token"),
        ranked["rest"].alias("tokens"),
    )
    whole = x.filter("full > 0").select("pack_name", "doc_id", "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("k"))
    whole = whole.select(
        "pack_name",
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("bin_id"),
        "doc_id",
        F.col("k").cast("int").alias("piece"),
        (F.col("k") * F.col("c")).alias("from_token"),
        F.col("c").alias("tokens"),
    )
    none = x.filter("tokens = 0").select("pack_name", F.lit("empty").alias("bin_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("from_token"), F.lit(0).cast("bigint").alias("tokens"))
    return placed.unionByName(whole).unionByName(none)


def usage(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, bins, tokens, fill): the containers used for each capacity and the share of their room that is filled."""
    per = packed.filter("tokens > 0").groupBy("pack_name", "bin_id").agg(F.sum("tokens").alias("t"))
    per = per.groupBy("pack_name").agg(F.count(F.lit(1)).alias("bins"), F.sum("t").alias("tokens"))
    j = per.join(F.broadcast(packs.select("pack_name", "capacity_tokens").distinct()), "pack_name")
    return j.select("pack_name", "bins", "tokens", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6).alias("fill"))


def checked(sizes: DataFrame, packed: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, documents, overfull, incomplete, split) of a packing: documents placed, containers above their capacity, documents whose pieces
    don't add up, and documents split although they fit. The last three are 0 in a right one."""
    p = F.broadcast(packs.filter("capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("bigint").alias("c")).distinct())
    bins = packed.groupBy("pack_name", "bin_id").agg(F.sum("tokens").alias("t")).join(p, "pack_name").groupBy("pack_name").agg(F.count(F.when(F.col("t") > F.col("c"), 1)).alias("overfull"))
    own = packed.groupBy("pack_name", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    each = F.array(*(F.struct(F.lit(n).alias("pack_name"), F.lit(c).alias("c")) for n, c in sorted(map(tuple, p.collect()))))
    docs = sizes.select("doc_id", F.col("tokens").alias("want")).dropDuplicates(["doc_id"]).withColumn("p", F.explode(each)).select("doc_id", "want", "p.*").join(own, ["pack_name", "doc_id"], "left")
    docs = docs.groupBy("pack_name").agg(
        F.count("t").alias("documents"), F.count(F.when(F.coalesce("t", F.lit(-1)) != F.col("want"), 1)).alias("incomplete"), F.count(F.when((F.col("want") <= F.col("c")) & (F.col("n") > 1), 1)).alias("split")
    )
    return docs.join(bins, "pack_name").select("pack_name", "documents", "overfull", "incomplete", "split")
