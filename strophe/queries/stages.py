"""Stage files written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..session import shared_dir, table
from ..sources import formats
from .base import LINES, Registry, lines

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _folder(s, name):
    return f"{shared_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("""select song_id, case when bad then null else title end as title, case when bad then null else artist end as artist, case when bad then 0.0 else coalesce(duration, 0.0) end as duration
from (select *, length(title) % 7 = 0 bad from song_meta)""")
def scan_tags(s, d):
    """Title, artist and duration of a probed file: keys in any case, text that is no JSON has no tags, a missing duration is 0."""
    t = table(s, d, "song_meta")
    made = F.to_json(F.struct(F.struct(F.struct(F.col("title").alias("TITLE"), F.col("artist").alias("Artist")).alias("tags"), F.col("duration").cast("string").alias("duration")).alias("format")))
    probe = F.when(F.length("title") % 7 == 0, F.concat(F.lit("{"), "title")).otherwise(made)
    g = formats.probed(probe)
    return t.select("song_id", g["tags"]["title"].alias("title"), g["tags"]["artist"].alias("artist"), g["duration"].alias("duration"))


_PLANS = f"with {LINES}, p as (select plan_id, count(*) n, sum(length(text)) c from l group by 1) select p.plan_id, d.source_lang, cast(n as bigint) as n, cast(c as bigint) as chars from p join plan_docs d using (plan_id)"


@query(_PLANS)
def sink_json_stage(s, d):
    """Plans as nested documents, one a row, written as JSON and read back."""
    row = F.struct(F.col("i").cast("int").alias("i"), "text", "translation")
    p = lines(s, d, "text", "translation").groupBy("plan_id").agg(F.array_sort(F.collect_list(row)).alias("lines"))
    p = p.join(table(s, d, "plan_docs").select("plan_id", "source_lang", "target_lang"), "plan_id")
    formats.write_json(p, at := _folder(s, "plans"))
    b = formats.read_json(s, at)
    chars = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(F.length(x["text"]), F.lit(0)))
    return b.select("plan_id", "source_lang", F.size("lines").cast("bigint").alias("n"), chars.alias("chars"))


@query("select transcript_id, any_value(language_code) as language_code, any_value(language_probability) as p, any_value(length(text)) as chars from scribe_vocals group by 1")
def scan_json_stage(s, d):
    """Transcripts kept as multi-line JSON documents, one file for each task, read with a schema; a field that is missing is null."""
    t = table(s, d, "scribe_vocals").select("transcript_id", "language_code", "language_probability", "text").dropDuplicates(["transcript_id"])
    one = F.to_json(F.struct("transcript_id", "language_code", F.col("language_probability").alias("p"), "text"), {"pretty": "true"})
    at = _folder(s, "transcripts")
    t.groupBy(F.spark_partition_id()).agg(F.array_join(F.collect_list(one), ",\n").alias("docs")).select(F.concat(F.lit("["), "docs", F.lit("]"))).write.mode("overwrite").text(at)
    b = s.read.schema("transcript_id bigint, language_code string, p double, text string, lost string").json(at, multiLine=True)
    return b.select("transcript_id", "language_code", "p", F.length("text").alias("chars"))


@query("select vec_id, label, len(embedding)::int as n, round(list_sum(embedding::double[]), 5) as v from embeddings")
def sink_features(s, d):
    """Feature arrays cast to single precision, written as Parquet and read back."""
    t = table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<float>").alias("embedding"))
    t.write.mode("overwrite").parquet(at := _folder(s, "features"))
    b = s.read.parquet(at)
    v = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return b.select("vec_id", "label", F.size("embedding").alias("n"), F.round(v, 5).alias("v"))


@query("select vec_id, len(embedding)::int as n, round(list_max(embedding)::double, 5) as hi from embeddings")
def scan_features(s, d):
    return table(s, d, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.round(F.array_max("embedding").cast("double"), 5).alias("hi"))


@query("with y as (select distinct lrclib_id, plainlyrics t from lrclib where plainlyrics is not null), x as (select lrclib_id, unnest(string_split_regex(t, '\\r\\n|\\n|\\r')) r, generate_subscripts(string_split_regex(t, '\\r\\n|\\n|\\r'), 1) - 1 i from y) select lrclib_id, cast(i as int) as i, md5(r) as v from x")
def scan_lyrics_text(s, d):
    """Lyric texts written, read whole and cut into lines again."""
    t = table(s, d, "lrclib").filter("plainlyrics is not null").select("lrclib_id", "plainlyrics").dropDuplicates(["lrclib_id"])
    at = _folder(s, "lyrics")
    # a text is a row of a column store, as millions of tiny files would serve nobody; formats.read_lyrics reads folders of text files
    t.write.mode("overwrite").parquet(at)
    return s.read.parquet(at).select("lrclib_id", F.posexplode(F.split("plainlyrics", r"\r\n|\n|\r")).alias("i", "r")).select("lrclib_id", "i", F.md5(F.col("r").cast("binary")).alias("v"))


@query("select event_id, round(greatest(0.0625, least(1.0, pow(10, (-1.0 - 1.0 - value / 20) / 20))), 6) as v from events")
def sink_audio(s, d):
    """Limiter amplitude of an encoder with a ceiling; lossy formats get one dB less."""
    return table(s, d, "events").select("event_id", F.round(N.limit_of(-1.0 - 1.0 - F.col("value") / 20), 6).alias("v"))
