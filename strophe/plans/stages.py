"""Stage tables: a result is kept under a hash of its settings and inputs, and read again while both stay the same."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def stage_key(settings: dict, inputs: dict) -> str:
    """Hash of settings and of what the inputs are (paths, versions, modification times), in any order of their keys."""
    return hashlib.sha256(json.dumps([settings, inputs], sort_keys=True, default=str).encode()).hexdigest()[:20]


def stage(spark: SparkSession, root: str, name: str, settings: dict, inputs: dict, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The stage table, built if there is no complete one for this key. A half-written one has no _SUCCESS and is rebuilt."""
    at = f"{root}/{name}/key={stage_key(settings, inputs)}"
    if force or not _complete(spark, at):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def _complete(spark: SparkSession, at: str) -> bool:
    if "://" not in at:
        return (Path(at) / "_SUCCESS").exists()
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
