"""All queries over empty tables, and over tables whose columns are null wherever that can be."""

import os

import pytest

from strophe.llm.queries import QUERIES

FIXED = ("lang_codes", "pack_sizes", "mix_targets")
KEYS = ("lrclib_id", "transcript_id", "plan_id", "line_id", "doc_id", "song_id")


@pytest.fixture(scope="module")
def folders(spark, data, tmp_path_factory):
    from pyspark.sql import functions as F

    root = tmp_path_factory.mktemp("edges")
    for f in os.listdir(data):
        t = spark.read.parquet(f"{data}/{f}")
        own = t if f[:-8] in FIXED else None
        (own or t.limit(0)).write.parquet(f"{root}/empty/{f}")
        nulls = t.limit(40).select(*(F.col(c) if c in KEYS else F.lit(None).cast(k).alias(c) for c, k in t.dtypes))
        (own or nulls.withColumn("key", F.lit("clash")).withColumn("text_", F.lit(1))).write.parquet(f"{root}/nulls/{f}")
    return root


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, folders, name):
    n = QUERIES[name](spark, f"{folders}/empty").count()
    assert n == (6 if name in ("p9_shares", "p9_checked") else 0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls(spark, folders, name):
    rows = QUERIES[name](spark, f"{folders}/nulls").collect()
    if name in ("p1_found", "p3_found", "p4_found", "p6_found", "p7_found", "p10_found", "p9_mix"):
        assert rows == []
    if name == "p5_found":
        assert rows and {r.defect for r in rows} == {"empty"}
    if name == "p8_pack":
        assert {r.bin_id for r in rows} == {"empty"}
