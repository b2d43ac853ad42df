"""Overlapping and gapped time intervals: continuous periods and the gaps between them.

A mergeable aggregate: its state is, for each key, a list of sorted, disjoint intervals, and two states combine by
a linear merge. States are first built where the rows lie, then merged in a tree (by key and a salt, then by key), so
a key that holds much of the data arrives at its last task as a few short lists; there the sorted lists are merged
as they stream by, with one open interval in memory. All keys of a batch are merged in the same array operations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Intervals a task gathers before it emits the state it has.
GATHER = 1_000_000


def disjoint(k: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals [a, b) of keys k, in any order, as sorted ones of which no two of a key overlap or touch."""
    if not len(a):
        return k, a, b
    o = np.lexsort((a, k))
    k, a, b = k[o], a[o], b[o]
    head = np.r_[True, k[1:] != k[:-1]]
    # a running maximum within each key: ends are lifted above all ends of the keys before
    low = int(b.min())
    lift = int(b.max()) - low + 1
    n = int(head.sum())
    if n * lift < 1 << 62:
        step = (np.cumsum(head) - 1) * lift
        top = np.maximum.accumulate(b - low + step) - step + low
    else:
        top = np.concatenate([np.maximum.accumulate(x) for x in np.split(b, np.flatnonzero(head)[1:])])
    first = np.r_[True, a[1:] > top[:-1]] | head
    return k[first], a[first], top[np.r_[np.flatnonzero(first)[1:] - 1, len(b) - 1]]


def _merge(df: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Several states, one after the other, as one. Each is sorted already, and the stable sort merges the sorted runs it meets in linear time."""
    code = pd.factorize(df[keys[0]], use_na_sentinel=False)[0] if len(keys) == 1 else df.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    k, a, b = disjoint(code, df["__a"].to_numpy(np.int64), df["__b"].to_numpy(np.int64))
    at = np.full(code.max() + 1 if len(code) else 0, -1)
    at[code[::-1]] = np.arange(len(code))[::-1]
    out = df[keys].iloc[at[k]].reset_index(drop=True)
    return out.assign(__a=a, __b=b)


def _states(keys: list[str]):
    def run(batches):
        held, n = [], 0
        for df in batches:
            held.append(df)
            n += len(df)
            if n >= GATHER:
                yield _merge(pd.concat(held, ignore_index=True), keys)
                held, n = [], 0
        if n:
            yield _merge(pd.concat(held, ignore_index=True), keys)

    return run


def _periods(keys: list[str]):
    """Rows come in order of key and start; only the last period of a batch can still grow."""

    def run(batches):
        held = None
        for df in batches:
            if not len(df):
                continue
            m = _merge(df if held is None else pd.concat([held, df], ignore_index=True), keys)
            held = m.iloc[-1:]
            same = pd.concat([m[c].iloc[1:].reset_index(drop=True).eq(m[c].iloc[:-1]) | (m[c].iloc[1:].reset_index(drop=True).isna() & m[c].iloc[:-1].isna()) for c in keys], axis=1).all(axis=1).to_numpy()
            gaps = m.iloc[1:][same][keys].assign(kind="gap", from_ms=m["__b"].to_numpy()[:-1][same], to_ms=m["__a"].to_numpy()[1:][same])
            done = m.iloc[:-1]
            yield pd.concat([done[keys].assign(kind="period", from_ms=done["__a"], to_ms=done["__b"]), gaps])
        if held is not None:
            yield held[keys].assign(kind="period", from_ms=held["__a"], to_ms=held["__b"])

    return run


def periods(df: DataFrame, keys: tuple[str, ...], from_col: str, to_col: str, salts: int = 16) -> DataFrame:
    """(keys..., kind, from_ms, to_ms): per key the periods covered by [from, to) and the gaps between successive ones.

    Rows whose from or to is null, or with to <= from, cover nothing; a key with only such rows gives no row. A null
    key is a key of its own. Repeated rows change nothing, an empty table gives an empty one, other columns are not read.
    """
    keys = list(keys)
    src = df.select(*keys, F.col(from_col).cast("bigint").alias("__a"), F.col(to_col).cast("bigint").alias("__b")).filter("__a < __b")
    types = dict(src.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    part = src.mapInPandas(_states(keys), head + ", __a bigint, __b bigint")
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    once = part.repartition(*keys, salt).mapInPandas(_states(keys), head + ", __a bigint, __b bigint")
    whole = once.repartition(*keys).sortWithinPartitions(*keys, "__a")
    return whole.mapInPandas(_periods(keys), head + ", kind string, from_ms bigint, to_ms bigint")
