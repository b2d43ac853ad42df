"""Extras beyond the song pipeline: the general relational and stream shapes, as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..streaming import sessions as ST
from .base import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("""with m as (select user_id, epoch_us(ts) us, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) p from events),
i as (select user_id, us, sum(case when p is null or us - p >= 3600000000 then 1 else 0 end) over (partition by user_id order by us rows unbounded preceding) n from m)
select user_id, cast(min(us) as bigint) as start_us, cast(max(us) + 3600000000 as bigint) as end_us, cast(count(*) as bigint) as n from i group by user_id, i.n""")
def x_sessions(s, d):
    """Sessions of users with a gap of an hour, by the function that also runs on a stream."""
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.sessions(e).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("select cast(epoch_us(ts) // 3600000000 * 3600000000 as bigint) as start_us, event_type, cast(count(*) as bigint) as n, round(sum(value), 4) as total from events group by 1, 2")
def x_tumbling(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.per_window(e).select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select coalesce(l_returnflag, '*') as flag, coalesce(l_linestatus, '*') as status, cast(count(*) as bigint) as n, round(sum(l_quantity), 4) as qty from lineitem group by cube (l_returnflag, l_linestatus)")
def x_cube(s, d):
    c = table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"))
    return c.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "qty")


@query("select song_id from song_meta except select song_id from lrclib")
def x_except(s, d):
    """Songs without candidates."""
    return table(s, d, "song_meta").select("song_id").subtract(table(s, d, "lrclib").select("song_id"))


@query("select song_id from scribe_vocals intersect select song_id from lrclib")
def x_intersect(s, d):
    """Songs with both a transcript and candidates."""
    return table(s, d, "scribe_vocals").select("song_id").intersect(table(s, d, "lrclib").select("song_id"))
