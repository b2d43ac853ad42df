"""All core queries over empty tables, and over tables whose columns are null wherever that can be."""

import os

import pytest

from strophe.catalog import collect

QUERIES, _ = collect()
FIXED = ("lang_codes", "nation", "region")
KEYS = ("lrclib_id", "transcript_id", "plan_id", "line_id", "song_id", "pos", "i", "section", "event_id", "vec_id", "s_suppkey", "p_partkey", "l_orderkey", "l_linenumber", "ts", "user_id", "label_")


@pytest.fixture(scope="module")
def folders(spark, data, tmp_path_factory):
    from pyspark.sql import functions as F

    root = tmp_path_factory.mktemp("edges")
    for f in os.listdir(data):
        t = spark.read.parquet(f"{data}/{f}").coalesce(1)
        fixed = f[:-8] in FIXED
        (t if fixed else t.limit(0)).write.parquet(f"{root}/empty/{f}")
        nulls = t.limit(30).select(*(F.col(c) if c in KEYS else F.lit(None).cast(k).alias(c) for c, k in t.dtypes)).withColumn("key", F.lit("clash"))
        (t if fixed else nulls).write.parquet(f"{root}/nulls/{f}")
    return root


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, folders, name):
    assert QUERIES[name](spark, f"{folders}/empty").count() == (25 if name == "resolve_voice" else 0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls(spark, folders, name):
    QUERIES[name](spark, f"{folders}/nulls").collect()
