"""Text functions as Column expressions. Null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markup of lyric files.
TIME_TAG = r"^\s*\[\d+:\d+(?:[.:]\d+)?\]\s*"
KEY_TAG = r"(?i)^\[[a-z]+:.*\]$"
PART_TAG = r"(?i)^\[(chorus|verse|bridge|intro|outro|hook)[^\]]*\]$"


def norm(c: Column) -> Column:
    """Lower case, straight apostrophes, nothing but letters, marks, digits, underscores and apostrophes."""
    return F.regexp_replace(F.translate(F.lower(c), "’", "'"), r"[^\p{L}\p{M}\p{N}_']", "")


def clean_line(c: Column) -> Column:
    """Without parentheses, blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.translate(c, "()", ""), r"\s+", " "))


def slug(c: Column) -> Column:
    """Runs of other than word characters as one hyphen, none at the ends; 'song' if nothing is left."""
    s = F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}_]+", "-")
    return F.coalesce(F.nullif(F.trim(s, F.lit("-")), F.lit("")), F.lit("song"))


def cap(c: Column) -> Column:
    """First letter in upper case, the rest as it is; null as empty."""
    return F.coalesce(F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2))), F.lit(""))


def rstrip_punct(c: Column) -> Column:
    return F.rtrim(c, F.lit(".,;:"))


def strip_time(line: Column) -> Column:
    """A line without its leading time tag, trimmed."""
    return F.trim(F.regexp_replace(line, TIME_TAG, ""))


def is_markup(line: Column) -> Column:
    """Blank, [key:value] or [chorus ...] lines."""
    return (line == "") | line.rlike(KEY_TAG) | line.rlike(PART_TAG)


def parse_lyrics(c: Column) -> Column:
    """The sung lines of a lyric text as an array; null as an empty one."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r"), strip_time)
    return F.filter(lines, lambda x: ~is_markup(x))


def tokens(c: Column) -> Column:
    """Normalized words; tokens without a word character are left out."""
    return F.filter(F.transform(F.split(F.trim(c), r"\s+"), norm), lambda x: x != "")


def mmss(t: Column) -> Column:
    """Seconds as m:ss, truncated."""
    s = t.cast("bigint")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("bigint"), F.pmod(s, F.lit(60)))


def speech_key(model: Column, voice: Column, speed: Column, stability: Column, text: Column) -> Column:
    """Cache key of a spoken text; a null prints as None."""
    show = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    return F.substring(F.md5(F.concat_ws("|", *map(show, (model, voice, speed, stability, text)))), 1, 16)
