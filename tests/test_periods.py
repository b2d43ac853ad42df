import random

from strophe.operators.periods import disjoint, periods
from strophe.queries.intervals import p2_found

SCHEMA = "k string, a bigint, b bigint, kind string, __note string"


def brute(rows):
    out = set()
    for k in {r[0] for r in rows}:
        iv = sorted((a, b) for q, a, b in rows if q == k and a is not None and b is not None and a < b)
        merged = []
        for a, b in iv:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(k, "period", a, b) for a, b in merged}
        out |= {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def run(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA).repartition(parts)
    got = [tuple(r) for r in periods(df, ("k",), "a", "b", salts=3).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random(spark):
    r = random.Random(1)
    rows = [(r.choice(["p", "q", "r", None]), a := r.randint(0, 3000), a + r.randint(-3, 12)) for _ in range(900)]
    rows += [("hot", a := r.randint(0, 9000), a + 5) for _ in range(1500)]
    assert run(spark, rows) == brute(rows)


def test_touching_nested_repeated_and_null(spark):
    rows = [("p", 0, 10), ("p", 10, 12), ("p", 2, 3), ("p", 0, 10), ("p", 13, 14), ("q", 5, 5), ("r", None, 4), ("r", 4, None), ("s", -9, -2), ("s", 7, 3)]
    assert run(spark, rows) == {("p", "period", 0, 12), ("p", "gap", 12, 13), ("p", "period", 13, 14), ("s", "period", -9, -2)}


def test_one_partition_with_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("k%d" % (i % 3), i * 4, i * 4 + 3 + (i % 5)) for i in range(200)]
        assert run(spark, rows, 1) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert run(spark, []) == set()


def test_large_numbers_take_the_slow_way():
    import numpy as np

    big = 1 << 61
    k, a, b = disjoint(np.array([0, 1, 1, 0]), np.array([0, -big, 3, 2]), np.array([5, 4, big, 9]))
    assert list(zip(k, a, b)) == [(0, 0, 9), (1, -big, big)]


def test_times_that_are_no_times(spark, tmp_path):
    nan = float("nan")
    rows = [("p", 1.0, 2.0, 0.5), ("p", 2.4, 2.2, 5.0), ("p", None, 3.0, 0.0), ("p", 4.0, 5.0, None), ("p", 6.0, 6.0, -1.0), ("p", nan, 9.0, 0.0), (None, 1.0, 2.0, 0.0), ("q", 1.0, 1.0, 0.001), ("r", 1.0, 2.0, 2e12), ("r", 1.0, 1e30, 0.0), ("r", 5.0, 6.0, nan)]
    spark.createDataFrame(rows, "plan_id string, start_s double, end_s double, vgap double").write.parquet(f"{tmp_path}/plan_lines.parquet")
    got = {tuple(r) for r in p2_found(spark, str(tmp_path)).collect()}
    assert got == {("p", "period", 1000, 2500), ("p", "gap", 2500, 4000), ("p", "period", 4000, 5000), ("q", "period", 1000, 1001), ("r", "period", 1000, 2_000_000_000_002_000)}
