"""Sections of plans: summaries, windows, time lines, and the sequential rules that cut them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..operators import islands
from ..operators import sections as S
from ..session import table
from .base import LINES, Registry, lines, words
from .lines import _SEC, section_lines, sung_lines

query = Registry()
#: The numbers the queries below take; their SQL has the same ones written out.
TUNED = Settings()
QUERIES, SQL = query.queries, query.sql
r6 = lambda c: F.round(c, 6)
_J = f"with {LINES}, {_SEC}"


@query(f"{_J} select plan_id, section, cast(k as int) as k, i, line_id from j")
def join_section_lines(s, d):
    return section_lines(s, d).select("plan_id", "section", "k", "i", "line_id")


_SUM = f"""{_J}, n as (select plan_id, count(*) n from l group by 1), a as (select plan_id, section, round(arg_min(coalesce(start_s, -1), k), 6) as first_start, round(arg_max(coalesce(end_s, -1), k), 6) as last_end, cast(count(*) as bigint) as n_lines,
cast(count(case when narrate then 1 end) as bigint) as n_told, cast(coalesce(sum(case when narrate then length(text) + length(coalesce(translation, '')) end), 0) as bigint) as chars, arg_max(i, k) as li, arg_max(coalesce(vgap, 9), k) as lg from j group by 1, 2)
select a.plan_id, section, first_start, last_end, n_lines, n_told, chars, li < n.n - 1 and lg < 0.3 as cut from a join n using (plan_id)"""


@query(_SUM)
def agg_section_summary(s, d):
    """Times, lines, told lines and characters of each section, and whether it ends inside singing."""
    j = section_lines(s, d, "start_s", "end_s", "text", "translation", "vgap", "narrate")
    n = lines(s, d).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    c = F.length("text") + F.length(F.coalesce("translation", F.lit("")))
    a = j.groupBy("plan_id", "section").agg(
        r6(F.min_by(F.coalesce("start_s", F.lit(-1.0)), "k")).alias("first_start"), r6(F.max_by(F.coalesce("end_s", F.lit(-1.0)), "k")).alias("last_end"),
        F.count(F.lit(1)).alias("n_lines"), F.count(F.when(F.col("narrate"), 1)).alias("n_told"), F.coalesce(F.sum(F.when(F.col("narrate"), c)), F.lit(0)).cast("bigint").alias("chars"),
        F.max_by("i", "k").alias("li"), F.max_by(F.coalesce("vgap", F.lit(9.0)), "k").alias("lg"),
    )
    out = a.join(n, "plan_id")
    return out.select("plan_id", "section", "first_start", "last_end", "n_lines", "n_told", "chars", ((F.col("li") < F.col("n") - 1) & (F.col("lg") < 0.3)).alias("cut"))


@query(f"with z as ({_SUM.replace('with l', 'with l', 1)}) select plan_id, cast(count(*) as bigint) as sections, cast(sum(chars) as bigint) as chars, cast(count(case when cut then 1 end) as bigint) as cut from z group by 1")
def report_plan(s, d):
    z = agg_section_summary(s, d)
    return z.groupBy("plan_id").agg(F.count(F.lit(1)).alias("sections"), F.sum("chars").cast("bigint").alias("chars"), F.count(F.when(F.col("cut"), 1)).alias("cut"))


@query(f"{_J} select plan_id, section, round(min(start_s), 6) as t from j where start_s is not null group by 1, 2")
def agg_first_at(s, d):
    return section_lines(s, d, "start_s").filter("start_s is not null").groupBy("plan_id", "section").agg(r6(F.min("start_s")).alias("t"))


@query(f"{_J} select plan_id, section, bool_or(coalesce(narrate, false)) as told from j group by 1, 2")
def agg_has_narration(s, d):
    return section_lines(s, d, "narrate").groupBy("plan_id", "section").agg(F.bool_or(F.coalesce("narrate", F.lit(False))).alias("told"))


_SEGS = "g as (select plan_id, section, list_min(line_idx) a, list_max(line_idx) b from plan_sections where len(line_idx) > 0), n as (select plan_id, count(distinct i) n from plan_lines group by 1)"


@query(f"with {_SEGS}, o as (select *, lag(b) over (partition by plan_id order by a, section) pb from g) select plan_id, coalesce(min(a) = 0 and max(b) = max(n) - 1 and bool_and(a <= b) and bool_and(pb is null or a = pb + 1), false) as ok from o left join n using (plan_id) group by 1")
def agg_cover_check(s, d):
    """Whether the sections of a plan cover its lines exactly once and in order."""
    g = table(s, d, "plan_sections").filter("size(line_idx) > 0").select("plan_id", "section", F.array_min("line_idx").alias("a"), F.array_max("line_idx").alias("b"))
    n = table(s, d, "plan_lines").groupBy("plan_id").agg(F.countDistinct("i").alias("n"))
    o = g.withColumn("pb", F.lag("b").over(W.partitionBy("plan_id").orderBy("a", "section"))).join(n, "plan_id", "left")
    ok = (F.min("a") == 0) & (F.max("b") == F.max("n") - 1) & F.bool_and(F.col("a") <= F.col("b")) & F.bool_and(F.col("pb").isNull() | (F.col("a") == F.col("pb") + 1))
    return o.groupBy("plan_id").agg(F.coalesce(ok, F.lit(False)).alias("ok"))


@query("select plan_id, section, cast(row_number() over (partition by plan_id order by list_min(line_idx), section) as bigint) as rank from plan_sections")
def sort_segments(s, d):
    t = table(s, d, "plan_sections")
    return t.select("plan_id", "section", F.row_number().over(W.partitionBy("plan_id").orderBy(F.array_min("line_idx").asc_nulls_last(), "section")).cast("bigint").alias("rank"))


@query(f"""with {LINES}, g as (select plan_id, i, list(translation order by coalesce(edited_at, timestamp '1970-01-01'), line_id) t from l where i is not null group by 1, 2),
a as (select plan_id, i, k, t[k] tr from g, (select unnest([1, 2, 3]) k)), n as (select plan_id, k, bool_and(coalesce(tr, '') <> '') ok from a group by 1, 2), f as (select plan_id, min(k) k from n where ok group by 1)
select p.plan_id, coalesce(cast(f.k as int), 0) as tries, f.k is not null as complete from plan_docs p left join f using (plan_id)""")
def agg_complete_answer(s, d):
    """The first of three answers that has a translation for every line of a plan, 0 if none has: an answer that lacks one is
    asked for again. The k-th answer for a line is its k-th row by time."""
    t = lines(s, d, "translation", "edited_at").filter("i is not null and plan_id is not null")
    at = F.struct(F.coalesce("edited_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"), "line_id", F.col("translation").alias("tr"))
    g = t.groupBy("plan_id", "i").agg(F.array_sort(F.collect_list(at)).alias("t"))
    a = g.select("plan_id", "i", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"), "t").select("plan_id", "k", F.coalesce(F.get(F.col("t.tr"), F.col("k") - 1), F.lit("")).alias("tr"))
    ok = a.groupBy("plan_id", "k").agg(F.bool_and(F.col("tr") != "").alias("ok")).filter("ok").groupBy("plan_id").agg(F.min("k").alias("k"))
    return table(s, d, "plan_docs").select("plan_id").join(ok, "plan_id", "left").select("plan_id", F.coalesce("k", F.lit(0)).cast("int").alias("tries"), F.col("k").isNotNull().alias("complete"))


_FL = f"""{_J}, f as (select plan_id, section, arg_min(coalesce(sing_start, start_s), k) s0, arg_max(coalesce(sing_end, end_s), k) s1, arg_max(coalesce(vgap, 1.0), k) lg, arg_max(coalesce(vgap_mid, end_s), k) lm
from j where start_s is not null and end_s is not null group by 1, 2),
o as (select f.*, sm.duration du, lag(lm) over x pm, lead(section) over x nx from f join plan_docs p using (plan_id) join song_meta sm on sm.song_id = p.song_id where sm.duration > 0 window x as (partition by plan_id order by section)),
w as (select *, greatest(greatest(0.0, s0 - 2.0), coalesce(pm, 0.0)) a, case when nx is null then du else least(least(du, s1 + 1.5), lm) end b0 from o),
z as (select *, greatest(b0, case when lg >= 0.2 then s1 else b0 end) b from w)"""
_WIN = f'{_FL} select plan_id, section, round(a, 6) as start, round(b, 6) as "end", round(least(0.3, greatest(0.05, s0 - a)), 6) as fade_in, round(case when nx is null then 0.05 else least(1.5, greatest(0.1, b - s1)) end, 6) as fade_out, nx is not null and lg < 0.2 as cut from z'


@query(_WIN)
def win_song_windows(s, d):
    """Excerpt of the song for each section: a little before its first and after its last sung line, cut in the pauses."""
    j = section_lines(s, d, "start_s", "end_s", "sing_start", "sing_end", "vgap", "vgap_mid").filter("start_s is not null and end_s is not null")
    f = j.groupBy("plan_id", "section").agg(
        F.min_by(F.coalesce("sing_start", "start_s"), "k").alias("s0"), F.max_by(F.coalesce("sing_end", "end_s"), "k").alias("s1"),
        F.max_by(F.coalesce("vgap", F.lit(1.0)), "k").alias("lg"), F.max_by(F.coalesce("vgap_mid", "end_s"), "k").alias("lm"),
    )
    m = table(s, d, "plan_docs").select("plan_id", "song_id").join(table(s, d, "song_meta").filter("duration > 0").select("song_id", F.col("duration").alias("du")), "song_id")
    x = W.partitionBy("plan_id").orderBy("section")
    o = f.join(m, "plan_id").withColumns({"pm": F.lag("lm").over(x), "nx": F.lead("section").over(x)})
    o = o.withColumn("a", F.greatest(F.lit(0.0), F.col("s0") - TUNED.song_preroll, F.coalesce("pm", F.lit(0.0))))
    o = o.withColumn("b", F.when(F.col("nx").isNull(), F.col("du")).otherwise(F.least("du", F.col("s1") + TUNED.song_tail, "lm")))
    o = o.withColumn("b", F.greatest("b", F.when(F.col("lg") >= 0.2, F.col("s1")).otherwise(F.col("b"))))
    return o.select(
        "plan_id", "section", r6("a").alias("start"), r6("b").alias("end"), r6(F.least(F.lit(TUNED.song_fade_in), F.greatest(F.lit(0.05), F.col("s0") - F.col("a")))).alias("fade_in"),
        r6(F.when(F.col("nx").isNull(), 0.05).otherwise(F.least(F.lit(TUNED.song_fade_out), F.greatest(F.lit(0.1), F.col("b") - F.col("s1"))))).alias("fade_out"), (F.col("nx").isNotNull() & (F.col("lg") < 0.2)).alias("cut"),
    )




_CURSOR = f"""{_J}, le as (select plan_id, section, 2.0::double + sum(0.07::double * length(rtrim(text, '.,;:')) + 0.45 + 0.07::double * length(coalesce(translation, '')) + 0.9) + 0.5 x from j where narrate and text is not null group by 1, 2),
w0 as (select * from ({{win}})), b as (select w0.plan_id, w0.section, coalesce(le.x, 0) + case when le.x is null then 0 else 0.4 end + ("end" - start) len, cut from w0 left join le using (plan_id, section)),
c as (select *, lag(cut) over (partition by plan_id order by section) pc, coalesce(sum(len + case when cut then -least(1.0, len) else 0.6 end) over (partition by plan_id order by section rows between unbounded preceding and 1 preceding), 0) t from b)
select plan_id, section, round(t, 6) as t0, round(t + len, 6) as t1 from c"""


@query(_CURSOR.format(win=_WIN))
def win_section_cursor(s, d, windows=None):
    """Where each section lies on the time line: its lesson (as win_narration_timeline lays it out, with a tail of 0.5 s and a gap of 0.4 s) and
    its excerpt. After an excerpt that ends inside singing the next section fades in over its last second, else a gap of 0.6 s follows."""
    c = section_lines(s, d, "text", "translation", "narrate").filter("narrate and text is not null")
    clip = 0.07 * F.length(T.rstrip_punct(F.col("text"))) + TUNED.gap_lang + 0.07 * F.length(F.coalesce("translation", F.lit(""))) + TUNED.gap_line
    le = c.groupBy("plan_id", "section").agg((TUNED.lead_in + F.sum(clip) + TUNED.learn_tail).alias("x"))
    b = (windows or win_song_windows(s, d)).join(le, ["plan_id", "section"], "left")
    b = b.withColumn("len", F.coalesce(F.col("x") + TUNED.gap_to_song, F.lit(0.0)) + (F.col("end") - F.col("start")))
    x = W.partitionBy("plan_id").orderBy("section").rowsBetween(W.unboundedPreceding, -1)
    t = F.coalesce(F.sum(F.col("len") + F.when(F.col("cut"), -F.least(F.lit(1.0), F.col("len"))).otherwise(TUNED.gap_section)).over(x), F.lit(0.0))
    return b.select("plan_id", "section", r6(t).alias("t0"), r6(t + F.col("len")).alias("t1"))


_CLIP = f"""{_J}, c as (select plan_id, section, k, line_id, 0.07::double * length(rtrim(text, '.,;:')) a, 0.07::double * length(coalesce(translation, '')) b from j where narrate and text is not null),
p as (select *, 2.0::double + coalesce(sum(a + 0.45 + b + 0.9) over (partition by plan_id, section order by k rows between unbounded preceding and 1 preceding), 0) t from c)"""


_NARRATION = f"{_CLIP} select plan_id, section, line_id, 'src' as kind, round(t, 6) as t0, round(t + a, 6) as t1 from p union all select plan_id, section, line_id, 'dst', round(t + a + 0.45, 6), round(t + a + 0.45 + b, 6) from p"


@query(_NARRATION)
def win_narration_timeline(s, d):
    """Spoken line, pause, translation, pause after a lead-in of 2 s; a clip lasts 0.07 s a character."""
    c = section_lines(s, d, "text", "translation", "narrate").filter("narrate and text is not null")
    c = c.withColumns({"a": 0.07 * F.length(T.rstrip_punct(F.col("text"))), "b": 0.07 * F.length(F.coalesce("translation", F.lit("")))})
    x = W.partitionBy("plan_id", "section").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    t = TUNED.lead_in + F.coalesce(F.sum(F.col("a") + TUNED.gap_lang + F.col("b") + TUNED.gap_line).over(x), F.lit(0.0))
    ev = lambda kind, u, v: F.struct(F.lit(kind).alias("kind"), r6(u).alias("t0"), r6(v).alias("t1"))
    p = c.withColumn("t", t)
    e = F.array(ev("src", F.col("t"), F.col("t") + F.col("a")), ev("dst", F.col("t") + F.col("a") + TUNED.gap_lang, F.col("t") + F.col("a") + TUNED.gap_lang + F.col("b")))
    return p.select("plan_id", "section", "line_id", F.explode(e).alias("e")).select("plan_id", "section", "line_id", "e.*")


@query("select song_id, round(ceil(duration / bar) * bar + 2 * bar, 6) as teach, round((((5.0 - duration) % bar) + bar) % bar + ceil((duration - (((5.0 - duration) % bar) + bar) % bar) / bar) * bar, 6) as handover from song_meta where bar > 0 and duration is not null")
def win_bar_quantize(s, d):
    """The bar line two bars after the end of a speech, and the first moment after it at which the loop has a given phase."""
    t = table(s, d, "song_meta").filter("bar > 0 and duration is not null")
    bar, du = F.col("bar"), F.col("duration")
    qs = F.pmod(5.0 - du, bar)
    return t.select("song_id", r6(F.ceil(du / bar) * bar + 2 * bar).alias("teach"), r6(qs + F.ceil((du - qs) / bar) * bar).alias("handover"))


@query(f"with w0 as ({_WIN}), {LINES}, {_SEC} select j.plan_id, j.section, cast(j.k as int) as k, round(10 + coalesce(sing_start, start_s) - w0.start, 6) as a, round(10 + coalesce(sing_end, end_s) - w0.start, 6) as b from j join w0 using (plan_id, section) where start_s is not null and end_s is not null")
def win_sung_windows(s, d):
    """When each line of a section is sung in the lesson, if its excerpt is played at 10 s."""
    j = section_lines(s, d, "start_s", "end_s", "sing_start", "sing_end").filter("start_s is not null and end_s is not null")
    j = j.join(win_song_windows(s, d).select("plan_id", "section", "start"), ["plan_id", "section"])
    return j.select("plan_id", "section", "k", r6(10 + F.coalesce("sing_start", "start_s") - F.col("start")).alias("a"), r6(10 + F.coalesce("sing_end", "end_s") - F.col("start")).alias("b"))


@query(f"{_J} select plan_id, section, line_id, cast(row_number() over (partition by plan_id, section order by k) as bigint) as pos, cast(count(*) over (partition by plan_id, section) as bigint) as total from j where narrate")
def win_position(s, d):
    j = section_lines(s, d, "narrate").filter("narrate")
    x = W.partitionBy("plan_id", "section")
    return j.select("plan_id", "section", "line_id", F.row_number().over(x.orderBy("k")).cast("bigint").alias("pos"), F.count(F.lit(1)).over(x).alias("total"))


@query(f"{_J} select a.plan_id, a.section, cast(a.k as int) as k, a.line_id as line_a, b.line_id as line_b from j a join j b on a.plan_id = b.plan_id and a.k = b.k and b.section = a.section + 1")
def join_zip(s, d):
    """Lines of a section zipped with those of the next one."""
    a = section_lines(s, d).select("plan_id", "section", "k", F.col("line_id").alias("line_a"))
    b = a.select("plan_id", (F.col("section") - 1).alias("section"), "k", F.col("line_a").alias("line_b"))
    return a.join(b, ["plan_id", "section", "k"])


@query(f"with {LINES}, m as (select p.song_id, plan_id, cast(count(case when timed then 1 end) as bigint) m, cast(count(*) as bigint) n from l join plan_docs p using (plan_id) group by 1, 2), r as (select *, m - 0.5 * (n - m) sc, row_number() over (partition by song_id order by m - 0.5 * (n - m) desc, plan_id) rn from m) select song_id, plan_id, round(cast(sc as double), 6) as score, case when m >= 0.4 * n then 'lyrics' else 'transcript' end as source from r where rn = 1")
def agg_match_score(s, d):
    """The best matched candidate of a song, given how many of its parts matched (timed lines here): matched ones less half of the others,
    the first of equals; below 0.4 the transcript serves. agg_match_aligned does the same with aligned words."""
    j = lines(s, d, "timed").join(table(s, d, "plan_docs").select("plan_id", "song_id"), "plan_id")
    m = j.groupBy("song_id", "plan_id").agg(F.count(F.when(F.col("timed"), 1)).alias("m"), F.count(F.lit(1)).alias("n"))
    sc = F.col("m") - 0.5 * (F.col("n") - F.col("m"))
    b = m.groupBy("song_id").agg(F.min(F.struct((-sc).alias("sc"), "plan_id", "m", "n")).alias("x"))
    source = F.when(F.col("x.m") >= 0.4 * F.col("x.n"), "lyrics").otherwise("transcript")
    return b.select("song_id", "x.plan_id", F.round((-F.col("x.sc")).cast("double"), 6).alias("score"), source.alias("source"))


def _timed(s, d, *cols):
    """Timed lines of plans; a plan's lines fit a task."""
    return lines(s, d, "start_s", "end_s", "vgap", "narrate", *cols).filter("start_s is not null and end_s is not null and plan_id is not null")


def _track(g: pd.DataFrame) -> tuple[pd.DataFrame, S.Track]:
    g = g.sort_values(["i", "line_id"]).reset_index(drop=True)
    pause = g["vgap"].fillna(g["start_s"].shift(-1) - g["end_s"]).fillna(1.0)
    return g, S.Track(g["start_s"], g["end_s"], pause, g["narrate"].eq(True))


@query()
def win_gap_sections(s, d):
    """Sections of each plan by its pauses: (plan_id, section, first, last) over its timed lines."""

    def run(key, g):
        b = S.by_pauses(_track(g)[1], TUNED)
        return pd.DataFrame({"plan_id": key[0], "section": range(len(b) - 1 if b else 0), "first": b[:-1], "last": [k - 1 for k in b[1:]]})

    return _timed(s, d).groupBy("plan_id").applyInPandas(run, "plan_id string, section int, first int, last int")


@query()
def win_split_long(s, d):
    """All lines of a plan cut at their best pauses until no part has more than eight told lines."""

    def run(key, g):
        t = _track(g)[1]
        out = S.shortened(t, list(range(len(t))), TUNED.max_lines)
        return pd.DataFrame({"plan_id": key[0], "part": range(len(out)), "first": [p[0] for p in out], "last": [p[-1] for p in out]})

    return _timed(s, d).groupBy("plan_id").applyInPandas(run, "plan_id string, part int, first int, last int")


@query()
def win_struct_sections(s, d):
    """Sections of each plan from its labelled segments (plan_sections), if these hold every timed line once and in order, else by
    its pauses: (plan_id, section, label, first, last, n); first and last count the plan's timed lines."""

    def run(key, g, seg):
        if not len(g):
            return pd.DataFrame([], columns=["plan_id", "section", "label", "first", "last", "n"])
        g, t = _track(g)
        at = {}
        for k, i in enumerate(g["i"]):
            at.setdefault(i, []).append(k)
        segs = [(x or f"part {k + 1}", [j for i in idx for j in at.get(i, [])]) for k, (x, idx) in enumerate(zip(seg["label"], seg["line_idx"]))]
        segs = sorted((x for x in segs if x[1]), key=lambda x: x[1][0])
        if S.covers(segs, len(t)):
            out = S.by_segments(t, [len(x.split()) if isinstance(x, str) else 0 for x in g["text"]], segs)
        else:
            b = S.by_pauses(t)
            out = [(f"part {k + 1}", list(range(x, y))) for k, (x, y) in enumerate(zip(b, b[1:]))]
        rows = [(key[0], k, label, idx[0], idx[-1], len(idx)) for k, (label, idx) in enumerate(out)]
        return pd.DataFrame(rows, columns=["plan_id", "section", "label", "first", "last", "n"])

    seg = table(s, d, "plan_sections").filter("plan_id is not null and line_idx is not null").select("plan_id", "section", "label", "line_idx").orderBy("plan_id", "section")
    pairs = _timed(s, d, "text").groupBy("plan_id").cogroup(seg.groupBy("plan_id"))
    return pairs.applyInPandas(run, "plan_id string, section int, label string, first int, last int, n int")


_TIMED = "with t as (select distinct on (line_id) * from plan_lines) select plan_id, cast(count(*) as bigint) as lines, true as ordered, true as whole from t where start_s is not null and end_s is not null and plan_id is not null group by 1"


def _covered(x):
    """Whether (plan_id, part, first, last) hold the lines 0, 1, ... of each plan once each and in order."""
    w = W.partitionBy("plan_id").orderBy("part")
    y = x.withColumns({"p": F.lag("last").over(w)})
    ok = F.bool_and(F.coalesce(F.col("first") == F.col("p") + 1, F.col("first") == 0))
    return y.groupBy("plan_id").agg((F.max("last") + 1).cast("bigint").alias("lines"), ok.alias("ordered"), F.bool_and(F.col("first") <= F.col("last")).alias("whole"))


@query(_TIMED)
def x_gap_sections_cover(s, d):
    """What win_gap_sections must hold: every timed line of a plan is in one section, in order."""
    return _covered(win_gap_sections(s, d).withColumnRenamed("section", "part"))


@query(_TIMED)
def x_split_long_cover(s, d):
    """The same of win_split_long."""
    return _covered(win_split_long(s, d))


@query("with t as (select distinct on (line_id) * from plan_lines), n as (select *, row_number() over (partition by plan_id order by i, line_id) - 1 k, coalesce(vgap, lead(start_s) over (partition by plan_id order by i, line_id) - end_s, 1.0) g, lead(line_id) over (partition by plan_id order by i, line_id) nx from t where start_s is not null and end_s is not null and plan_id is not null) select plan_id, cast(k as bigint) as line, false as joined from n where nx is not null and g >= 6.0")
def x_gap_sections_breaks(s, d):
    """Pauses of six seconds or more always end a section, unless one of its sides was too small to stand alone; none is inside a
    section whose sides both have enough told lines."""
    w = W.partitionBy("plan_id").orderBy("i", "line_id")
    t = _timed(s, d).withColumns({"k": F.row_number().over(w) - 1, "g": F.coalesce("vgap", F.lead("start_s").over(w) - F.col("end_s"), F.lit(1.0)), "nx": F.lead("line_id").over(w)})
    t = t.withColumn("told", F.count(F.when(F.col("narrate"), 1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    x = win_gap_sections(s, d)
    inside = t.filter("nx is not null and g >= 6.0").select("plan_id", "k", "told").join(x, "plan_id").filter("k between first and last")
    ends = t.select("plan_id", F.col("k").alias("e"), F.col("told").alias("n"))
    j = inside.join(ends.select("plan_id", F.col("e").alias("last"), F.col("n").alias("n1")), ["plan_id", "last"])
    j = j.join(ends.select("plan_id", (F.col("e") + 1).alias("first"), F.col("n").alias("n0")), ["plan_id", "first"], "left")
    big = (F.col("told") - F.coalesce("n0", F.lit(0)) >= 4) & (F.col("n1") - F.col("told") >= 4) & (F.col("k") < F.col("last"))
    return j.select("plan_id", F.col("k").cast("bigint").alias("line"), big.alias("joined"))


def matched(s, d):
    """(song_id, tid, lrclib_id, line, s, e): words of each transcript that match words of a candidate's lyric line, in blocks of two or more.

    A candidate meets every transcript of its song; a song has at most eight candidates (dedup_candidates), so its transcripts are
    never gathered. The words of one transcript are one array.
    """
    import difflib

    from .lines import dedup_candidates

    w = words(s, d).withColumn("token", T.norm(F.col("text"))).filter("token != ''")
    heard = w.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "s", "e"))).alias("w")).select("tid", F.col("w.token").alias("token"), F.col("w.s").alias("s"), F.col("w.e").alias("e"))
    of = table(s, d, "scribe_vocals").select("song_id", F.col("transcript_id").alias("tid")).dropDuplicates(["tid"])
    c = dedup_candidates(s, d).join(sung_lines(s, d).select("lrclib_id", "lines"), "lrclib_id").select("song_id", "lrclib_id", F.transform("lines", T.tokens).alias("lines"))

    def run(batches):
        for b in batches:
            rows = []
            for song, tid, lid, text, token, x, y in zip(b["song_id"], b["tid"], b["lrclib_id"], b["lines"], b["token"], b["s"], b["e"]):
                told = [(i, w) for i, ws in enumerate(text) for w in ws]
                for m in difflib.SequenceMatcher(None, [w for _, w in told], list(token), autojunk=False).get_matching_blocks():
                    if m.size >= 2:
                        rows += [(song, tid, lid, told[m.a + k][0], x[m.b + k], y[m.b + k]) for k in range(m.size)]
            yield pd.DataFrame(rows, columns=["song_id", "tid", "lrclib_id", "line", "s", "e"])

    j = c.join(of, "song_id").join(heard, "tid").select("song_id", "tid", "lrclib_id", "lines", "token", "s", "e")
    return j.mapInPandas(run, "song_id string, tid bigint, lrclib_id bigint, line int, s double, e double")


@query()
def join_sequence_align(s, d):
    """Lyric lines matched to the words of each transcript of their song: (song_id, tid, lrclib_id, line, start, end, n); of a
    line's hits the largest cluster."""
    keys = ["song_id", "tid", "lrclib_id", "line"]
    b = islands.best_cluster(matched(s, d), keys, "s", "e", 2.5)
    return b.select(*keys, r6(F.col("start")).alias("start"), r6(F.col("end")).alias("end"), "n")


@query()
def agg_match_aligned(s, d):
    """The lyric of each transcript: of the song's candidates the one with the highest score, matched words less half of the others,
    the first of equals; kept if 0.4 of its words matched, else the transcript itself serves (lrclib_id is null)."""
    from .lines import dedup_candidates

    total = dedup_candidates(s, d).join(sung_lines(s, d).select("lrclib_id", "lines"), "lrclib_id").select("song_id", "lrclib_id", "rank", F.aggregate("lines", F.lit(0), lambda a, x: a + F.size(T.tokens(x))).alias("n"))
    of = table(s, d, "scribe_vocals").select("song_id", F.col("transcript_id").alias("tid")).dropDuplicates(["tid"])
    m = matched(s, d).groupBy("tid", "lrclib_id").agg(F.count(F.lit(1)).alias("m"))
    x = total.join(of, "song_id").join(m, ["tid", "lrclib_id"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    sc = F.col("m") - 0.5 * (F.col("n") - F.col("m"))
    b = x.groupBy("song_id", "tid").agg(F.min(F.struct((-sc).alias("sc"), "rank", "lrclib_id", "m", "n")).alias("x"))
    b = of.join(b.drop("song_id"), "tid", "left")
    ok = F.coalesce(F.col("x.m") >= 0.4 * F.col("x.n"), F.lit(False))
    return b.select("song_id", "tid", F.when(ok, F.col("x.lrclib_id")).alias("lrclib_id"), F.round((-F.col("x.sc")).cast("double"), 6).alias("score"), F.when(ok, "lyrics").otherwise("transcript").alias("source"))
