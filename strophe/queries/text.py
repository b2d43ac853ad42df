"""Scalar functions over lyric lines, labels and event values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..session import table
from .base import LINES, Registry, lines

query = Registry()
QUERIES, SQL = query.queries, query.sql

_N = r"regexp_replace(replace(lower({0}), '’', ''''), '[^\p{{L}}\p{{M}}\p{{N}}_'']', '', 'g')"
_SPLIT = r"string_split_regex(coalesce({0}, ''), '\r\n|\n|\r')"
_STRIP = r"trim(regexp_replace({0}, '^\s*\[\d+:\d+(?:[.:]\d+)?\]\s*', ''))"
_MARK = r"({0} = '' or regexp_matches({0}, '(?i)^\[[a-z]+:.*\]$') or regexp_matches({0}, '(?i)^\[(chorus|verse|bridge|intro|outro|hook)[^\]]*\]$'))"
_TOK = "list_filter(list_transform(string_split_regex(trim(text), '\\s+'), lambda x: " + _N.format("x") + "), lambda x: x <> '')"


@query(f"with {LINES} select line_id, {_N.format('text')} as v from l")
def fn_norm(s, d):
    return lines(s, d, "text").select("line_id", T.norm(F.col("text")).alias("v"))


@query(f"with {LINES} select line_id, trim(regexp_replace(replace(replace(text, '(', ''), ')', ''), '\\s+', ' ', 'g')) as v from l")
def fn_clean_line(s, d):
    return lines(s, d, "text").select("line_id", T.clean_line(F.col("text")).alias("v"))


@query(r"select song_id, coalesce(nullif(trim(regexp_replace(lower(title), '[^\p{L}\p{M}\p{N}_]+', '-', 'g'), '-'), ''), 'song') as v from song_meta")
def fn_slug(s, d):
    return table(s, d, "song_meta").select("song_id", T.slug(F.col("title")).alias("v"))


@query(f"with {LINES} select line_id, coalesce(upper(text[1:1]) || text[2:], '') as v from l")
def fn_cap(s, d):
    return lines(s, d, "text").select("line_id", T.cap(F.col("text")).alias("v"))


@query(f"with {LINES} select line_id, rtrim(text, '.,;:') as v from l")
def fn_rstrip_punct(s, d):
    return lines(s, d, "text").select("line_id", T.rstrip_punct(F.col("text")).alias("v"))


_LYR = "y as (select distinct lrclib_id, syncedlyrics t from lrclib)"


@query(f"with {_LYR} select lrclib_id, array_to_string(list_filter(list_transform({_SPLIT.format('t')}, lambda x: {_STRIP.format('x')}), lambda x: not {_MARK.format('x')}), chr(10)) as v from y")
def fn_parse_lyrics(s, d):
    t = table(s, d, "lrclib").select("lrclib_id", "syncedlyrics").dropDuplicates(["lrclib_id"])
    return t.select("lrclib_id", F.array_join(T.parse_lyrics(F.col("syncedlyrics")), "\n").alias("v"))


_PLAIN = "y as (select distinct lrclib_id, plainlyrics t from lrclib where plainlyrics is not null)"


@query(f"with {_PLAIN}, x as (select lrclib_id, generate_subscripts({_SPLIT.format('t')}, 1) - 1 as i, unnest({_SPLIT.format('t')}) r from y), z as (select lrclib_id, cast(i as int) i, {_STRIP.format('r')} as text from x) select * from z where not {_MARK.format('text')}")
def flt_lyric_markup(s, d):
    t = table(s, d, "lrclib").filter("plainlyrics is not null").select("lrclib_id", "plainlyrics").dropDuplicates(["lrclib_id"])
    x = t.select("lrclib_id", F.posexplode(F.split("plainlyrics", r"\r\n|\n|\r")).alias("i", "r")).select("lrclib_id", "i", T.strip_time(F.col("r")).alias("text"))
    return x.filter(~T.is_markup(F.col("text")))


@query(f"with {LINES} select line_id, cast(generate_subscripts({_TOK}, 1) - 1 as int) as pos, unnest({_TOK}) as token from l where text is not null")
def fn_tokenize(s, d):
    return lines(s, d, "text").select("line_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))


@query(f"select distinct transcript_id, pos, {_N.format('text')} as token from words where wtype = 'word' and {_N.format('text')} <> ''")
def flt_words(s, d):
    t = table(s, d, "words").filter("wtype = 'word'").select("transcript_id", "pos", T.norm(F.col("text")).alias("token"))
    return t.filter("token <> ''").distinct()


def _labels(s, d):
    return table(s, d, "plan_docs").select("plan_id", "source_lang", "target_lang")


_CODE = "case when length(source_lang) = 2 then lower(source_lang) else c.iso1 end"


@query(f"select plan_id, {_CODE} as v from plan_docs left join lang_codes c on c.iso3 = lower(source_lang)")
def fn_iso1(s, d):
    c = F.broadcast(table(s, d, "lang_codes").select("iso1", "iso3"))  # 12 rows, fixed
    j = _labels(s, d).join(c, F.lower("source_lang") == F.col("iso3"), "left")
    return j.select("plan_id", F.when(F.length("source_lang") == 2, F.lower("source_lang")).otherwise(F.col("iso1")).alias("v"))


@query("select plan_id, coalesce(c.lang_name, target_lang) as v from plan_docs left join lang_codes c on c.iso1 = target_lang")
def fn_lang_name(s, d):
    c = F.broadcast(table(s, d, "lang_codes").select("iso1", "lang_name"))
    return _labels(s, d).join(c, F.col("target_lang") == F.col("iso1"), "left").select("plan_id", F.coalesce("lang_name", "target_lang").alias("v"))


@query("select p.plan_id, c.iso1, c.lang_name from plan_docs p join lang_codes c on c.iso3 = p.source_lang or c.iso1 = p.source_lang")
def join_lang_lookup(s, d):
    c = table(s, d, "lang_codes").select(F.explode(F.array("iso1", "iso3")).alias("code"), "iso1", "lang_name")
    return _labels(s, d).join(F.broadcast(c), F.col("source_lang") == F.col("code")).select("plan_id", "iso1", "lang_name")


@query("select plan_id, case when lower(source_lang) = 'en' then 'fr' else 'en' end as v from plan_docs")
def fn_default_target(s, d):
    return _labels(s, d).select("plan_id", F.when(F.lower("source_lang") == "en", "fr").otherwise("en").alias("v"))


@query("select event_id, cast(cast(floor(trunc(value) / 60) as bigint) as varchar) || ':' || lpad(cast(cast(trunc(value) - 60 * floor(trunc(value) / 60) as bigint) as varchar), 2, '0') as v from events where value is not null")
def fn_mmss(s, d):
    return table(s, d, "events").filter("value is not null").select("event_id", T.mmss(F.col("value")).alias("v"))


@query("select event_id, round(pow(10, (-value / 10) / 20), 6) as v from events")
def fn_db_gain(s, d):
    return table(s, d, "events").select("event_id", F.round(N.db_gain(-F.col("value") / 10), 6).alias("v"))


@query("select event_id, round(greatest(0.0625, least(1.0, pow(10, (1 - value / 4) / 20))), 6) as v from events")
def fn_limit(s, d):
    return table(s, d, "events").select("event_id", F.round(N.limit_of(1 - F.col("value") / 4), 6).alias("v"))


@query("select song_id, round(least(1.0, greatest(0.0, case when duration = 0 then 0.0 else coalesce(bpm, 0) / duration end)), 6) as v from song_meta where duration is not null")
def fn_progress(s, d):
    t = table(s, d, "song_meta").filter("duration is not null")
    return t.select("song_id", F.round(N.progress(F.coalesce("bpm", F.lit(0.0)), F.col("duration")), 6).alias("v"))


@query("select event_id, cast(round_even(value * 1920 / 1280, 0) as bigint) as v from events")
def fn_px(s, d):
    return table(s, d, "events").select("event_id", N.px(F.col("value"), 1920).alias("v"))


_KEY = "md5('m|' || coalesce(plan_id, 'None') || '|1.0|None|' || coalesce({0}, 'None'))[1:16]"


@query(f"with {LINES} select line_id, {_KEY.format('text')} as v from l")
def fn_tts_key(s, d):
    k = T.speech_key(F.lit("m"), F.col("plan_id"), F.lit("1.0"), F.lit(None), F.col("text"))
    return lines(s, d, "text").select("line_id", k.alias("v"))


@query(
    f"with {LINES}, k as (select plan_id, narrate, text, {_KEY.format('text')} as key from l where text is not null), o as (select distinct key from k where narrate) "
    "select plan_id, cast(count(*) as bigint) as new_keys, cast(sum(n) as bigint) as new_chars from (select plan_id, key, max(length(text)) n from k where not coalesce(narrate, false) and key not in (select key from o) group by 1, 2) group by 1"
)
def anti_tts_cache(s, d):
    """Texts still to be spoken: keys of lines that aren't narrated and whose key no narrated line has, each billed once."""
    k = T.speech_key(F.lit("m"), F.col("plan_id"), F.lit("1.0"), F.lit(None), F.col("text"))
    t = lines(s, d, "text", "narrate").filter("text is not null").withColumn("key", k)
    new = t.filter(~F.coalesce("narrate", F.lit(False))).join(t.filter("narrate").select("key").distinct(), "key", "left_anti")
    per = new.groupBy("plan_id", "key").agg(F.max(F.length("text")).alias("n"))
    return per.groupBy("plan_id").agg(F.count(F.lit(1)).alias("new_keys"), F.sum("n").cast("bigint").alias("new_chars"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def fn_json_extract(s, d):
    """A tolerant parse: text that isn't JSON and fields that are missing or of another type give null."""
    return table(s, d, "events").select("event_id", F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999999999")).cast("bigint").alias("k"))


@query(f"with {LINES} select plan_id, md5(string_agg(cast(i as varchar) || ': ' || coalesce(text, ''), chr(10) order by i, line_id)) as v from l group by plan_id")
def fn_format_rows(s, d):
    """Numbered rows of each plan in order, as one text (its md5)."""
    row = F.struct("i", "line_id", F.format_string("%d: %s", "i", F.coalesce("text", F.lit(""))).alias("r"))
    t = lines(s, d, "text").groupBy("plan_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return t.select("plan_id", F.md5(F.array_join("r.r", "\n").cast("binary")).alias("v"))


@query(f"""with {LINES}, x as (select p.plan_id, p.section, p.label, l.text, row_number() over (partition by p.plan_id, p.section order by l.line_id) n from plan_sections p left join l on l.plan_id = p.plan_id and l.i = p.line_idx[1])
select plan_id, section, coalesce(nullif(label, ''), 'part ' || cast(section as varchar)) as v, coalesce(nullif(label, ''), text[1:30]) as summary from x where n = 1""")
def prj_section_meta(s, d):
    """What a section is called: its label, else its number; in a summary its label, else the first thirty characters of its first line."""
    first = lines(s, d, "text").select("plan_id", "i", F.struct("line_id", "text").alias("t")).groupBy("plan_id", "i").agg(F.min("t").alias("t"))
    t = table(s, d, "plan_sections").select("plan_id", "section", F.nullif("label", F.lit("")).alias("label"), F.get("line_idx", F.lit(0)).alias("i"))
    t = t.join(first, ["plan_id", "i"], "left")
    return t.select("plan_id", "section", F.coalesce("label", F.concat(F.lit("part "), F.col("section").cast("string"))).alias("v"), F.coalesce("label", F.substring("t.text", 1, 30)).alias("summary"))


_SIZE = "cast(p_size * 40 as varchar) || case p_partkey % 7 when 0 then '' when 1 then 'X' else 'x' end || cast(p_size * 20 + p_partkey % 3 as varchar)"


@query(
    f"with x as (select p_partkey, lower({_SIZE}) v from part), y as (select *, try_cast(nullif(regexp_extract(v, '^(\\d+)x(\\d+)$', 1), '') as bigint) w, try_cast(nullif(regexp_extract(v, '^(\\d+)x(\\d+)$', 2), '') as bigint) h from x) "
    "select p_partkey, coalesce(w >= 320 and h >= 180 and w % 2 = 0 and h % 2 = 0, false) as ok from y"
)
def val_video_size(s, d):
    """A size is valid as WxH in any case, both even, 320 x 180 or more."""
    p = table(s, d, "part")
    by = F.when(F.col("p_partkey") % 7 == 0, "").when(F.col("p_partkey") % 7 == 1, "X").otherwise("x")
    v = F.lower(F.concat((F.col("p_size") * 40).cast("string"), by, (F.col("p_size") * 20 + F.col("p_partkey") % 3).cast("string")))
    w, h = (F.nullif(F.regexp_extract(v, r"^(\d+)x(\d+)$", k), F.lit("")).cast("bigint") for k in (1, 2))
    ok = (w >= 320) & (h >= 180) & (w % 2 == 0) & (h % 2 == 0)
    return p.select("p_partkey", F.coalesce(ok, F.lit(False)).alias("ok"))


@query(
    "select plan_id, coalesce((lyrics_source = 'lrclib.net' and source_lang <> 'en') or (n_lines > 20 and target_lang <> 'en'), false) as conflict from plan_docs"
)
def val_lang_conflict(s, d):
    """Only what was explicitly asked for can disagree; a null asks for nothing."""
    want_src = F.when(F.col("lyrics_source") == "lrclib.net", "en")
    want_dst = F.when(F.col("n_lines") > 20, "en")
    c = F.coalesce(want_src != F.col("source_lang"), F.lit(False)) | F.coalesce(want_dst != F.col("target_lang"), F.lit(False))
    return table(s, d, "plan_docs").select("plan_id", c.alias("conflict"))


@query("select user_id, event_id, round(v * v * (3 - 2 * v), 6) as v from (select user_id, event_id, least(1.0, greatest(0.0, value / 40)) v from events where value is not null)")
def fn_smoothstep(s, d):
    v = F.least(F.greatest(F.col("value") / 40, F.lit(0.0)), F.lit(1.0))
    return table(s, d, "events").filter("value is not null").select("user_id", "event_id", F.round(N.smoothstep(v), 6).alias("v"))


@query(
    "select l_orderkey, l_linenumber, round((case when p < 10 then p / 9 else 1.0 end) * (case when p >= 30 then (49 - p) / 19 else 1.0 end), 6) as v from (select *, cast(l_quantity as double) - 1 p from lineitem where l_quantity is not null)"
)
def fn_fade(s, d):
    """Gain at position l_quantity of 1 to 50 with ramps of 10 and 20."""
    t = table(s, d, "lineitem").filter("l_quantity is not null")
    return t.select("l_orderkey", "l_linenumber", F.round(N.fade(F.col("l_quantity").cast("double") - 1, F.lit(50), F.lit(10), F.lit(20)), 6).alias("v"))


def _wrap(text, width):
    """Greedy wrap by characters; a word wider than a row goes on from the row begun, cut where rows are full."""
    rows = [""]
    for w in (text or "").split():
        if len(w) > width:
            run = rows.pop() + w
            rows += [run[i : i + width] for i in range(0, len(run), width)]
        elif rows[-1] and len(rows[-1]) + 1 + len(w) > width:
            rows.append(w)
        else:
            rows[-1] = " ".join(filter(None, (rows[-1], w)))
    return rows


_LAST = "string_split(a, chr(10))[-1]"
#: The wrap as a fold over words, w words and {0} characters a row; rows are joined by line breaks.
_FOLD = (
    "list_reduce(list_prepend('', case when trim(coalesce(text, '')) = '' then []::varchar[] else string_split_regex(trim(text), '\\s+') end), lambda a, w: "
    f"case when length(w) > {{0}} then a[1:length(a) - length({_LAST})] || array_to_string(list_transform(range(0, (length({_LAST}) + length(w) + {{0}} - 1) // {{0}}), lambda i: substr({_LAST} || w, cast(i * {{0}} + 1 as bigint), {{0}})), chr(10)) "
    f"when {_LAST} = '' then a || w when length({_LAST}) + 1 + length(w) > {{0}} then a || chr(10) || w else a || ' ' || w end)"
)


@query(f"with {LINES}, x as (select line_id, string_split({_FOLD.format(24)}, chr(10)) r from l) select line_id, cast(generate_subscripts(r, 1) - 1 as int) as k, unnest(r) as part from x")
def fn_wrap(s, d):
    """Lines of each text wrapped greedily to 24 characters (character counts stand in for measured widths)."""
    @F.pandas_udf("array<string>")
    def wrap(x: pd.Series) -> pd.Series:
        return x.map(lambda t: _wrap(t, 24))

    return lines(s, d, "text").select("line_id", F.posexplode(wrap("text")).alias("k", "part"))


_ROOM = " ".join(f"when {n} then len(string_split({_FOLD.format(max(1, int(400 / (0.55 * n))))}, chr(10)))" for n in range(40, 19, -2))


@query(f"with {LINES}, x as (select line_id, n, case n when 0 then 0 {_ROOM} end r from l, (select unnest(range(20, 41, 2)) n)) select line_id, cast(coalesce(max(case when r * n * 1.3 <= 100 then n end), 20) as int) as size from x group by 1")
def fn_fit(s, d):
    """The largest size from 40 down to 20 in steps of 2 at which the wrapped text fits a box of 400 x 100."""
    @F.pandas_udf("int")
    def fit(x: pd.Series) -> pd.Series:
        def one(t):
            room = {n: max(1, int(400 / (0.55 * n))) for n in range(40, 19, -2)}
            return next((n for n, w in room.items() if len(_wrap(t, w)) * n * 1.3 <= 100), 20)

        return x.map(one)

    return lines(s, d, "text").select("line_id", fit("text").alias("size"))


@query("select plan_id, section, cast(k - 1 as int) as k, case when k - 1 < section % 5 then 'past' when k - 1 = section % 5 then 'current' else 'future' end as v from (select plan_id, section, unnest(line_idx) x, generate_subscripts(line_idx, 1) k from plan_sections)")
def fn_line_colour(s, d):
    """Class of each line of a section while its line number section mod 5 is sung."""
    t = table(s, d, "plan_sections").select("plan_id", "section", F.posexplode("line_idx").alias("k", "x"))
    cur = F.col("section") % 5
    return t.select("plan_id", "section", "k", F.when(F.col("k") < cur, "past").when(F.col("k") == cur, "current").otherwise("future").alias("v"))


@query("select plan_id, section, cast(k - 1 as int) as k, round(360 - 52.0 * n / 2 + 26 + 52.0 * (k - 1), 6) as y from (select plan_id, section, len(line_idx) n, unnest(range(1, len(line_idx) + 1)) k from plan_sections)")
def fn_centered_block(s, d):
    """Heights of the lines of a block centred at 360, line height 40 * 1.3."""
    t = table(s, d, "plan_sections").select("plan_id", "section", F.size("line_idx").alias("n"), F.posexplode("line_idx").alias("k", "x"))
    return t.select("plan_id", "section", "k", F.round(360 - 52.0 * F.col("n") / 2 + 26 + 52.0 * F.col("k"), 6).cast("double").alias("y"))
