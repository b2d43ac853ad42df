"""Numeric functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def db_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def limit_of(ceiling_db: Column) -> Column:
    """Amplitude of the limiter for a ceiling in dB, kept within [0.0625, 1]."""
    return F.greatest(F.lit(0.0625), F.least(F.lit(1.0), db_gain(ceiling_db)))


def progress(t: Column, total: Column) -> Column:
    """t / total within [0, 1]; 0 where total is 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(t, total), F.lit(0.0))))


def px(v: Column, width: Column | int, canvas: int = 1280) -> Column:
    """A length on the design canvas in pixels of a picture that is ``width`` wide, half to even."""
    return F.bround(v * width / canvas).cast("bigint")


def smoothstep(v: Column) -> Column:
    return v * v * (3 - 2 * v)


def fade(pos: Column, n: Column, n_in: Column, n_out: Column) -> Column:
    """Gain at sample ``pos`` of ``n`` with linear ramps of n_in and n_out samples, both clamped to n; a ramp of one
    sample or less is none."""
    a, b = F.least(n_in, n), F.least(n_out, n)
    up = F.when((a > 1) & (pos < a), pos / (a - 1)).otherwise(1.0)
    down = F.when((b > 1) & (pos >= n - b), (n - 1 - pos) / (b - 1)).otherwise(1.0)
    return up * down
