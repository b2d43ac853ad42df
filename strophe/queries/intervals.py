"""Continuous periods and gaps of plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.periods import periods
from ..session import table


#: Milliseconds a time may have at most; what is beyond them is no time.
FAR = 9.2e18


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(plan_id, kind, from_ms, to_ms): what each plan's lines with their pauses cover, and the gaps.

    A pause that is null or no number is 0; a begin or end that is null, no number or can't be counted in milliseconds is no time."""
    t = table(spark, d, "plan_lines").filter("plan_id is not null").select("plan_id", "start_s", "end_s", F.coalesce(F.nanvl("vgap", F.lit(0.0)), F.lit(0.0)).alias("gap"))
    a, b = F.col("start_s") * 1000, (F.col("end_s") + F.col("gap")) * 1000
    t = t.filter(~F.isnan("start_s") & ~F.isnan("end_s") & (F.col("end_s") >= F.col("start_s")) & (F.abs(a) < FAR) & (F.abs(b) < FAR))
    t = t.select("plan_id", F.round(a).cast("bigint").alias("a"), F.round(b).cast("bigint").alias("b"))
    return periods(t, ("plan_id",), "a", "b")


P2_SQL = """
with t as (
  select plan_id, start_s * 1000 x, (end_s + case when vgap is null or isnan(vgap) then 0 else vgap end) * 1000 y
  from plan_lines where end_s >= start_s and plan_id is not null and not isnan(start_s) and not isnan(end_s)),
l as (select plan_id, cast(round(x) as bigint) a, cast(round(y) as bigint) b from t where abs(x) < 9.2e18 and abs(y) < 9.2e18),
c as (select distinct plan_id, a, b from l where a < b),
m as (select plan_id, a, b, max(b) over (partition by plan_id order by a, b rows between unbounded preceding and 1 preceding) pb from c),
i as (select *, sum(case when pb is null or a > pb then 1 else 0 end) over (partition by plan_id order by a, b rows unbounded preceding) n from m),
p as (select plan_id, n, min(a) from_ms, max(b) to_ms from i group by plan_id, n),
g as (select plan_id, to_ms x, lead(from_ms) over (partition by plan_id order by n) y from p)
select plan_id, 'period' as kind, from_ms, to_ms from p
union all select plan_id, 'gap', x, y from g where y is not null
"""

QUERIES = {"p2_found": p2_found}
SQL = {"p2_found": P2_SQL}
