"""Records that are the same apart from their format: one is kept, the copies are counted.

Every field is reduced to its letters and digits in lower case. Header lines form a multiset whose hash is the
sum of the hashes of its members, so their order doesn't matter and nothing is sorted; it is combined with the
hashes of the other fields into a fingerprint. Rows meet by fingerprint alone; then the fields of every copy are compared with those
of the record that is kept, header lines by how often each occurs. Records without copies are not looked at again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = r"^\s*\[\p{L}+:.*\]\s*$"


def normal(c):
    """What remains of a text: letters and digits in lower case; null as empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def _sum(hashes):
    """Sum of 64-bit hashes modulo 2^63, order-free; halves are added so that nothing overflows."""
    m = F.lit((1 << 62) - 1)
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, x: (a + x.bitwiseAND(m)).bitwiseAND(m))


def fields(df: DataFrame, key: str, plain: str, synced: str) -> DataFrame:
    """(key, plain, head, rest): the three things that must agree; head is an array in its given order."""
    lines = F.split(F.coalesce(synced, F.lit("")), r"\r\n|\n|\r")
    return df.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias(key),
        normal(F.col(plain)).alias("plain"),
        F.filter(F.transform(F.filter(lines, lambda x: x.rlike(HEADER)), normal), lambda x: x != "").alias("head"),
        normal(F.array_join(F.filter(lines, lambda x: ~x.rlike(HEADER)), "\n")).alias("rest"),
    )


def _rows(f: DataFrame, key: str) -> DataFrame:
    """Fields with their fingerprint (h1, h2), without the records that are empty throughout."""
    h = lambda seed: F.xxhash64(
        F.lit(seed), "plain", "rest", F.size("head"), _sum(F.transform("head", lambda x: F.xxhash64(F.lit(seed), x)))
    )
    return f.filter("plain != '' or rest != '' or size(head) > 0").withColumns({"h1": h(1), "h2": h(2)})


#: Header lines up to which each is counted in both records; longer headers are compared as sorted arrays.
HEADERS = 64


def same_lines(a, b):
    """Whether two arrays hold the same lines equally often."""
    often = lambda x, y: F.size(F.filter(x, lambda z: z == y))
    few = F.forall(a, lambda y: often(a, y) == often(b, y))
    return (F.size(a) == F.size(b)) & F.when(F.size(a) <= HEADERS, few).otherwise(F.array_sort(a) == F.array_sort(b))


def classes(df: DataFrame, key: str = "lrclib_id", plain: str = "plainlyrics", synced: str = "syncedlyrics") -> DataFrame:
    """(keep_id, id): every record that isn't empty throughout with the smallest id of its group, its own included.

    Null equals empty; repeated rows count once. Rows meet by fingerprint of 128 bits, and the fields of copies are compared with the kept record's;
    should different records ever share a fingerprint, those are matched by their fields instead.
    """
    from ..session import cut

    r = cut(_rows(fields(df, key, plain, synced), key).select(F.col(key).alias("id"), "h1", "h2").distinct())
    g = r.groupBy("h1", "h2").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = cut(r.join(g, ["h1", "h2"]).select("keep_id", "id", "h1", "h2"))
    own = df.select(F.col(key).cast("bigint").alias(key), plain, synced).join(met.select(F.col("id").alias(key)), key, "left_semi").dropDuplicates([key])
    f = fields(own, key, plain, synced)
    of = lambda i, x: f.select(F.col(key).alias(i), F.struct("plain", "rest", "head").alias(x))
    both = met.filter("id != keep_id").join(of("id", "a"), "id").join(of("keep_id", "b"), "keep_id")
    same = (F.col("a.plain") == F.col("b.plain")) & (F.col("a.rest") == F.col("b.rest")) & same_lines(F.col("a.head"), F.col("b.head"))
    wrong = cut(both.filter(~same).select("h1", "h2").distinct())
    alone = r.join(g.select("h1", "h2"), ["h1", "h2"], "left_anti").select(F.col("id").alias("keep_id"), "id")
    if wrong.isEmpty():
        return alone.unionByName(met.select("keep_id", "id"))
    again = f.join(met.join(wrong, ["h1", "h2"], "left_semi").select(F.col("id").alias(key)), key, "left_semi").withColumn("head", F.array_sort("head"))
    by = ["plain", "rest", "head"]
    more = again.join(again.groupBy(*by).agg(F.min(key).alias("keep_id")), by).select("keep_id", F.col(key).alias("id")).distinct()
    return alone.unionByName(met.join(wrong, ["h1", "h2"], "left_anti").select("keep_id", "id")).unionByName(more)


def found(df: DataFrame, **names: str) -> DataFrame:
    """(keep_id, copy_id): every copy with the smallest id of its group. See :func:`classes`."""
    return classes(df, **names).filter("id > keep_id").withColumnRenamed("id", "copy_id")


def counts(df: DataFrame, **names: str) -> DataFrame:
    """(keep_id, copies): one record per lyric and the number of its records, itself included."""
    return classes(df, **names).groupBy("keep_id").agg(F.count(F.lit(1)).alias("copies"))
