"""Registering queries, and the inputs many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


class Registry:
    """Queries of a module and their SQL by name."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        def add(f):
            n = name or f.__name__
            self.queries[n] = f
            if sql:
                self.sql[n] = sql
            return f

        return add


def lines(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Lines of plans, redelivered ones once."""
    return table(spark, d, "plan_lines").select("line_id", "plan_id", "i", *cols).dropDuplicates(["line_id"])


#: The same in SQL.
LINES = "l as (select distinct on (line_id) * from plan_lines)"


def words(spark: SparkSession, d: str) -> DataFrame:
    """Timed words of transcripts as (tid, pos, text, s, e), redelivered ones once."""
    t = table(spark, d, "words").filter("wtype = 'word' and start_s is not null and end_s is not null")
    t = t.select(F.col("transcript_id").alias("tid"), F.col("pos").cast("bigint").alias("pos"), "text", F.col("start_s").alias("s"), F.col("end_s").alias("e"))
    return t.groupBy("tid", "pos").agg(F.min("text").alias("text"), F.min("s").alias("s"), F.min("e").alias("e"))


WORDS = """w as (select transcript_id tid, cast(pos as bigint) pos, min(text) "text", min(start_s) s, min(end_s) e
  from words where wtype = 'word' and start_s is not null and end_s is not null group by 1, 2)"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """A level series for each user: (user_id, f, v), f counting from 0."""
    from ..operators import islands

    t = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("v"))
    return islands.numbered(t, "user_id", "us", ["event_id"], "f").select("user_id", "f", "v")


FRAMES = "fr as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as f, value v from events)"
