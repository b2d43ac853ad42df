"""Operators over timed words, lines and activity frames."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import intervals, islands
from ..operators.periods import periods
from ..session import table
from .base import FRAMES, LINES, WORDS, Registry, frames, lines, words
from .text import _MARK, _SPLIT, _STRIP
from .text import _N as _NORM

query = Registry()
QUERIES, SQL = query.queries, query.sql
HOP = 0.02
r6 = lambda c: F.round(c, 6)
_QUIET = "q as (select user_id, f, f - row_number() over (partition by user_id order by f) g from fr where v < 80), ru as (select user_id, min(f) a, max(f) + 1 b from q group by user_id, g)"


def quiet(s, d):
    """Runs of frames below 80."""
    return islands.runs(frames(s, d), ["user_id"], "f", F.col("v") < 80)


@query(f"with {FRAMES}, {_QUIET} select user_id, a, b from ru")
def win_runs(s, d):
    return quiet(s, d)


@query(f"with {FRAMES}, {_QUIET} select user_id, a, b from (select *, row_number() over (partition by user_id order by b - a desc, a) n from ru) where n = 1")
def win_longest_pause(s, d):
    m = quiet(s, d).groupBy("user_id").agg(F.max_by(F.struct("a", "b"), F.struct(F.col("b") - F.col("a"), -F.col("a"))).alias("m"))
    return m.select("user_id", "m.a", "m.b")


@query(f"""with {FRAMES}, {_QUIET}, z as (select user_id, f as line, f * 10 a, f * 10 + 14 b from fr)
select z.user_id, z.line, greatest(ru.a, z.a) ra, least(ru.b, z.b) rb from z join ru on z.user_id = ru.user_id and ru.a < z.b and ru.b > z.a""")
def join_line_silence(s, d):
    """Silence around each line (a stretch of 14 frames from every tenth frame on), clipped to it."""
    z = frames(s, d).select("user_id", F.col("f").alias("line"), (F.col("f") * 10).alias("a"), (F.col("f") * 10 + 14).alias("b"))
    return intervals.overlap(z, quiet(s, d), "user_id").select("user_id", "line", "ra", "rb")


@query(f"""with {WORDS}, m as (select *, lag(e) over o pe, lag("text") over o pt from w window o as (partition by tid order by pos)),
i as (select *, sum(case when pe is not null and (s - pe > 0.6 or regexp_matches(pt, '[.!?]$')) then 1 else 0 end) over (partition by tid order by pos rows unbounded preceding) isl from m),
n as (select *, (row_number() over (partition by tid, isl order by pos) - 1) // 10 part from i),
g as (select tid, isl, part, min(pos) p0, round(arg_min(s, pos), 6) as start, round(arg_max(e, pos), 6) as "end", count(*) as n from n group by 1, 2, 3)
select tid, cast(row_number() over (partition by tid order by p0) - 1 as bigint) as i, start, "end", n from g""")
def win_transcript_lines(s, d):
    """Lines of a transcript: cut at a pause over 0.6 s, after a final mark, or after 10 words."""
    w = W.partitionBy("tid").orderBy("pos")
    x = words(s, d).withColumns({"pe": F.lag("e").over(w), "pt": F.lag("text").over(w)})
    x = islands.islands(x, ["tid"], ["pos"], (F.col("s") - F.col("pe") > 0.6) | F.col("pt").rlike("[.!?]$"), "isl")
    x = x.withColumn("part", F.floor((F.row_number().over(W.partitionBy("tid", "isl").orderBy("pos")) - 1) / 10))
    g = x.groupBy("tid", "isl", "part").agg(F.min("pos").alias("p0"), r6(F.min_by("s", "pos")).alias("start"), r6(F.max_by("e", "pos")).alias("end"), F.count(F.lit(1)).alias("n"))
    return g.select("tid", (F.row_number().over(W.partitionBy("tid").orderBy("p0")) - 1).cast("bigint").alias("i"), "start", "end", "n")


_CLU = """m as (select *, lag(e) over (partition by tid, line order by s, e, pos) pe from h),
c as (select *, sum(case when s - pe > 0.5 then 1 else 0 end) over (partition by tid, line order by s, e, pos rows unbounded preceding) cl from m),
g as (select tid, line, cl, min(s) s, max(e) e, count(*) n from c group by 1, 2, 3)"""


def _hits(s, d):
    """Words of a transcript in lines of twelve."""
    return words(s, d).withColumn("line", F.floor(F.col("pos") / 12).cast("bigint"))


@query(f'with {WORDS}, h as (select *, pos // 12 line from w), {_CLU} select tid, line, round(s, 6) as start, round(e, 6) as "end", n from (select *, row_number() over (partition by tid, line order by n desc, cl) rn from g) where rn = 1')
def win_hit_clusters(s, d):
    """Of the clusters of a line's words (cut at jumps over 0.5 s from the previous end) the largest, the earliest of equals."""
    b = islands.best_cluster(_hits(s, d), ["tid", "line"], "s", "e", 0.5)
    return b.select("tid", "line", r6(F.col("start")).alias("start"), r6(F.col("end")).alias("end"), "n")


@query(f"with {LINES}, j as (select p.section, l.* from (select plan_id, section, unnest(line_idx) i from plan_sections) p join l using (plan_id, i)) select plan_id, section, round(min(start_s), 6) as start, round(max(end_s), 6) as \"end\" from j where start_s is not null and end_s is not null group by 1, 2")
def agg_line_times(s, d):
    """From the first start to the largest end of what belongs together: the timed lines of each section."""
    j = section_lines(s, d, "start_s", "end_s").filter("start_s is not null and end_s is not null")
    return j.groupBy("plan_id", "section").agg(r6(F.min("start_s")).alias("start"), r6(F.max("end_s")).alias("end"))


_ACT = """fr as (select tid, f from (select distinct tid, unnest(range(cast(trunc(s / 0.02) as bigint), cast(trunc(e / 0.02) as bigint))) f from w where e > s) where f % 100 < 55),
x as (select *, cast(trunc(s / 0.02) as bigint) a, greatest(cast(trunc(s / 0.02) as bigint) + 1, cast(trunc(e / 0.02) as bigint)) b from w),
y as (select tid, pos, a, b, unnest(range(a, b)) f from x)"""


def _active(s, d):
    """Active frames of each transcript: those under a word, silenced for the last 45 of every 100."""
    w = words(s, d)
    f = intervals.cover(w.filter("e > s"), ["tid"], F.floor(F.col("s") / HOP), F.floor(F.col("e") / HOP), "f")
    return f.select("tid", "f").distinct().filter("f % 100 < 55")


def _covered(s, d):
    a = F.floor(F.col("s") / HOP)
    return intervals.cover(words(s, d), ["tid"], a, F.greatest(a + 1, F.floor(F.col("e") / HOP)), "f").select("tid", "pos", "f")


@query(f"with {WORDS}, {_ACT} select y.tid, y.pos, cast(count(*) as bigint) as n, cast(count(fr.f) as bigint) as active from y left join fr on y.tid = fr.tid and y.f = fr.f group by 1, 2")
def join_word_frames(s, d):
    """Frames each word covers and how many of them are active."""
    j = _covered(s, d).join(_active(s, d).withColumn("on", F.lit(1)), ["tid", "f"], "left")
    return j.groupBy("tid", "pos").agg(F.count(F.lit(1)).alias("n"), F.count("on").alias("active"))


@query(f"with {WORDS}, {_ACT} select y.tid, y.pos from y left join fr on y.tid = fr.tid and y.f = fr.f group by 1, 2 having count(fr.f) >= 0.4 * count(*) union select transcript_id, cast(pos as bigint) from words where coalesce(wtype, '') <> 'word'")
def flt_only_sung(s, d):
    """What stays of a transcript: words at least 0.4 of whose frames are active, and all that is no word. Words without times have no frames."""
    other = table(s, d, "words").filter(F.coalesce("wtype", F.lit("")) != "word").select(F.col("transcript_id").alias("tid"), F.col("pos").cast("bigint").alias("pos"))
    return join_word_frames(s, d).filter("active >= 0.4 * n").select("tid", "pos").unionByName(other).distinct()


_UN = f"""{LINES}, u as (select plan_id, i, line_id, case when timed then start_s end s, case when timed then end_s end e from l),
k as (select *, last_value(e ignore nulls) over o p, first_value(s ignore nulls) over (partition by plan_id order by i, line_id rows between current row and unbounded following) x,
  count(s) over o g from u window o as (partition by plan_id order by i, line_id rows unbounded preceding)),
n as (select *, row_number() over (partition by plan_id, g, s is null order by i, line_id) k from k),
v as (select plan_id, i, line_id, case when s is not null then s when p is not null and x is not null and x - p > 0.3 then case when k = 1 then p + 0.05 else x + 1.5 * (k - 2) end
    when p is not null then p + 1.5 * (k - 1) + 0.05 when x is not null then case when k = 1 then greatest(0.0, x - 1.5) else x + 1.5 * (k - 2) end end s2,
  case when s is not null then e when p is not null and x is not null and x - p > 0.3 then case when k = 1 then x - 0.05 else x + 1.5 * (k - 2) + 1.45 end
    when p is not null then p + 1.5 * k when x is not null then case when k = 1 then x - 0.05 else x + 1.5 * (k - 2) + 1.45 end end e2 from n),
z as (select plan_id, i, line_id, s2, case when s2 is not null and (e2 is null or e2 <= s2) then s2 + 0.8 else e2 end e2 from v)"""


def _untimed(s, d):
    t = lines(s, d, "timed", "start_s", "end_s")
    return t.select("plan_id", "i", "line_id", F.when(F.col("timed"), F.col("start_s")).alias("start"), F.when(F.col("timed"), F.col("end_s")).alias("end"))


@query(f'with {_UN} select line_id, round(s2, 6) as start, round(e2, 6) as "end" from z')
def win_fill_gaps(s, d):
    t = islands.fill_gaps(_untimed(s, d), "plan_id", ["i", "line_id"])
    return t.select("line_id", r6(F.col("start")).alias("start"), r6(F.col("end")).alias("end"))


@query(f"with {LINES} select line_id, plan_id, cast(row_number() over (partition by plan_id order by i, line_id) - 1 as bigint) as k from l where timed and start_s is not null")
def flt_untimed(s, d):
    """Timed lines, numbered anew without holes."""
    t = lines(s, d, "timed", "start_s").filter("timed and start_s is not null")
    return t.select("line_id", "plan_id", (F.row_number().over(W.partitionBy("plan_id").orderBy("i", "line_id")) - 1).cast("bigint").alias("k"))


_ANN = f"""{LINES}, t as (select plan_id, i, line_id, start_s s, end_s e from l where start_s is not null and end_s is not null and plan_id is not null),
nb as (select *, lead(s) over o ns, lag(e) over o pe from t window o as (partition by plan_id order by i, line_id)),
iv as (select plan_id, greatest(0, cast(floor(s / 0.02) as bigint)) a, cast(floor(e / 0.02) as bigint) b from t where e > s),
mx as (select plan_id, greatest(0, cast(floor(max(e) / 0.02) as bigint)) + 1500 m from t group by 1),
cu as (select plan_id, a, b, max(b) over (partition by plan_id order by a, b rows between unbounded preceding and 1 preceding) top from iv where a < b),
ru as (select plan_id, greatest(0, coalesce(top, 0)) a, a b from cu where a > coalesce(top, 0)
  union all select mx.plan_id, greatest(0, coalesce(max(cu.b), 0)), mx.m from mx left join cu using (plan_id) group by mx.plan_id, mx.m having mx.m > coalesce(max(cu.b), 0)),
w as (select *, cast(floor((e - 0.2) / 0.02) as bigint) wa, cast(floor((case when ns is null then e + 30 else ns + 0.1 end) / 0.02) as bigint) wb, case when ns is null then 30.0 else greatest(0.0, ns - e - 0.1) end wg,
  cast(floor(greatest(0.0, case when pe is null then s - 30 else pe - 0.2 end) / 0.02) as bigint) va, cast(floor((s + 0.1) / 0.02) as bigint) vb from nb),
cl as (select w.line_id, greatest(ru.a, w.wa) a, least(ru.b, w.wb) b from w join ru on w.plan_id = ru.plan_id and ru.a < w.wb and ru.b > w.wa),
bk as (select w.line_id, max(least(ru.b, w.vb)) b from w join ru on w.plan_id = ru.plan_id and ru.a < w.vb and ru.b > w.va where least(ru.b, w.vb) - greatest(ru.a, w.va) >= 15 group by 1),
be as (select line_id, a, b from cl qualify row_number() over (partition by line_id order by b - a desc, a) = 1),
lo as (select line_id, min(a) a from cl where b - a >= 15 group by 1),
r as (select w.*, be.a, be.b, lo.a la, bk.b ba, coalesce(be.b - be.a, 0) n from w left join be using (line_id) left join lo using (line_id) left join bk using (line_id))"""


@query(f"""with {_ANN} select line_id, round(case when n >= 8 then greatest(n * 0.02, wg) else wg end, 6) as vgap,
round(case when n >= 8 then (a + b) / 2.0 * 0.02 when ns is not null then (e + ns) / 2 else e + 1.0 end, 6) as vgap_mid,
round(least(coalesce(ns, 1e9), greatest(e, case when la is not null then least(la * 0.02, coalesce(ns, 1e9)) else e + least(0.15, wg / 2 + 0.02) end)), 6) as sing_end,
round(least(s, greatest(case when ba is not null then ba * 0.02 else s - 0.15 end, coalesce(pe, 0.0))), 6) as sing_start from r""")
def win_annotate(s, d):
    """Where the singing of each line begins and ends, the pause after it (the longer of a real silence and the gap to the next line),
    and where to cut in that. Frames of 0.02 s; a frame is quiet if no line of the plan covers it, up to 30 s after the last line.

    Quiet runs are the gaps between the periods of a plan. Lines that end at or before their start cover nothing, what lies before 0 is cut off.
    """
    t = lines(s, d, "start_s", "end_s").select("plan_id", "i", "line_id", F.col("start_s").alias("s"), F.col("end_s").alias("e")).filter("s is not null and e is not null and plan_id is not null")
    w = W.partitionBy("plan_id").orderBy("i", "line_id")
    fl = lambda c: F.floor(c / HOP)
    p = periods(t.filter("e > s").select("plan_id", F.greatest(F.lit(0), fl(F.col("s"))).alias("a"), fl(F.col("e")).alias("b")), ("plan_id",), "a", "b")
    ends = p.filter("kind = 'period'").groupBy("plan_id").agg(F.min("from_ms").alias("p0"), F.max("to_ms").alias("p1"))
    m = t.groupBy("plan_id").agg((F.greatest(F.lit(0), fl(F.max("e"))) + 1500).alias("m")).join(ends, "plan_id", "left")
    edge = F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.coalesce("p0", F.lit(0)).alias("b")), F.struct(F.coalesce("p1", F.lit(0)).alias("a"), F.col("m").alias("b")))
    ru = p.filter("kind = 'gap'").select("plan_id", F.col("from_ms").alias("a"), F.col("to_ms").alias("b")).unionByName(m.select("plan_id", F.explode(edge).alias("x")).select("plan_id", "x.a", "x.b").filter("a < b"))
    z = t.withColumns({"ns": F.lead("s").over(w), "pe": F.lag("e").over(w)})
    z = z.withColumn("wg", F.when(F.col("ns").isNull(), 30.0).otherwise(F.greatest(F.lit(0.0), F.col("ns") - F.col("e") - 0.1)))
    after = F.struct(F.lit(1).alias("side"), fl(F.col("e") - 0.2).alias("a"), fl(F.coalesce(F.col("ns") + 0.1, F.col("e") + 30)).alias("b"))
    back = F.struct(F.lit(0).alias("side"), fl(F.greatest(F.lit(0.0), F.coalesce(F.col("pe") - 0.2, F.col("s") - 30))).alias("a"), fl(F.col("s") + 0.1).alias("b"))
    c = intervals.overlap(z.select("plan_id", "line_id", F.explode(F.array(after, back)).alias("x")).select("plan_id", "line_id", "x.*"), ru, "plan_id").withColumn("n", F.col("rb") - F.col("ra"))
    best = c.groupBy("line_id").agg(
        F.min(F.when(F.col("side") == 1, F.struct((-F.col("n")).alias("n"), "ra", "rb"))).alias("m"),
        F.min(F.when((F.col("side") == 1) & (F.col("n") >= 15), F.col("ra"))).alias("la"), F.max(F.when((F.col("side") == 0) & (F.col("n") >= 15), F.col("rb"))).alias("ba"),
    )
    r = z.join(best, "line_id", "left").withColumn("n", F.coalesce(-F.col("m.n"), F.lit(0)))
    ns, real = F.coalesce("ns", F.lit(1e9)), F.col("n") >= 8
    return r.select(
        "line_id",
        r6(F.when(real, F.greatest(F.col("n") * HOP, F.col("wg"))).otherwise(F.col("wg"))).alias("vgap"),
        r6(F.when(real, (F.col("m.ra") + F.col("m.rb")) / 2.0 * HOP).when(F.col("ns").isNotNull(), (F.col("e") + F.col("ns")) / 2).otherwise(F.col("e") + 1.0)).alias("vgap_mid"),
        r6(F.least(ns, F.greatest("e", F.when(F.col("la").isNotNull(), F.least(F.col("la") * HOP, ns)).otherwise(F.col("e") + F.least(F.lit(0.15), F.col("wg") / 2 + 0.02))))).alias("sing_end"),
        r6(F.least("s", F.greatest(F.coalesce(F.col("ba") * HOP, F.col("s") - 0.15), F.coalesce("pe", F.lit(0.0))))).alias("sing_start"),
    )


@query(f"""with {FRAMES}, x as (select user_id, f, v >= 80 act from fr), y as (select user_id, f, max(act::int) over (partition by user_id order by f rows between 2 preceding and 3 following) dil from x)
select user_id, f, min(dil) over w = 1 and count(*) over w = 6 as active from y window w as (partition by user_id order by f rows between 3 preceding and 2 following)""")
def win_closing(s, d):
    """Morphological closing with a structure of six frames: dilate, then erode with the mirrored window. What lies beyond the ends
    of the series is off, so the first three frames and the last two are never active."""
    w = W.partitionBy("user_id").orderBy("f")
    x = frames(s, d).withColumn("dil", F.max((F.col("v") >= 80).cast("int")).over(w.rowsBetween(-2, 3)))
    e = w.rowsBetween(-3, 2)
    return x.select("user_id", "f", ((F.min("dil").over(e) == 1) & (F.count(F.lit(1)).over(e) == 6)).alias("active"))


@query("select distinct lrclib_id from lrclib where not coalesce(instrumental, false)")
def flt_instrumental(s, d):
    return table(s, d, "lrclib").filter(~F.coalesce("instrumental", F.lit(False))).select("lrclib_id").distinct()


@query(f"with {LINES} select plan_id, i, line_id from l where narrate")
def flt_narrated(s, d):
    return lines(s, d, "narrate").filter("narrate").select("plan_id", "i", "line_id")


_SEC = "x as (select plan_id, section, generate_subscripts(line_idx, 1) k, unnest(line_idx) i from plan_sections), j as (select x.section, x.k, l.* from x join l on x.plan_id = l.plan_id and x.i = l.i)"


def section_lines(s, d, *cols):
    """Lines of sections as (plan_id, section, k, i, ...), k counting from 1."""
    x = table(s, d, "plan_sections").select("plan_id", "section", F.posexplode("line_idx").alias("k", "i")).withColumn("k", F.col("k") + 1)
    return x.join(lines(s, d, *cols), ["plan_id", "i"])


@query(f"with {LINES}, {_SEC} select plan_id, section from j group by 1, 2 having arg_max(coalesce(end_s, 1e9), k) - arg_min(coalesce(start_s, -1e9), k) < 1.0 and sum(len(string_split_regex(trim(coalesce(text, '')), '\\s+'))) <= 2")
def flt_adlib(s, d):
    """Sections of less than a second from the start of their first line to the end of their last, with at most two words."""
    n = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))
    span = F.max_by(F.coalesce("end_s", F.lit(1e9)), "k") - F.min_by(F.coalesce("start_s", F.lit(-1e9)), "k")
    g = section_lines(s, d, "text", "start_s", "end_s").groupBy("plan_id", "section").agg(span.alias("t"), F.sum(n).alias("n"))
    return g.filter("t < 1.0 and n <= 2").select("plan_id", "section")


_CAND = f"y as (select lrclib_id, song_id, cand, list_filter(list_transform({_SPLIT.format("coalesce(nullif(syncedlyrics, ''), plainlyrics)")}, lambda x: {_STRIP.format('x')}), lambda x: not {_MARK.format('x')}) ls from (select distinct on (lrclib_id) * from lrclib) where not coalesce(instrumental, false))"


def sung_lines(s, d):
    """(lrclib_id, song_id, cand, lines): the sung lines of each candidate that is not instrumental, of its synced text if it has one, else of
    its plain text; candidates without any are left out."""
    t = table(s, d, "lrclib").filter("not coalesce(instrumental, false)").select("lrclib_id", "song_id", "cand", "plainlyrics", "syncedlyrics").dropDuplicates(["lrclib_id"])
    text = F.coalesce(F.nullif("syncedlyrics", F.lit("")), "plainlyrics")
    return t.select("lrclib_id", "song_id", "cand", T.parse_lyrics(text).alias("lines")).filter("size(lines) > 0")


@query(rf"with {_CAND}, k as (select *, array_to_string(list_transform(ls, lambda x: {_NORM.format('x')}), chr(10)) key from y where len(ls) > 0), f as (select *, row_number() over (partition by song_id, key order by cand, lrclib_id) n from k) select song_id, lrclib_id, cast(row_number() over (partition by song_id order by cand, lrclib_id) as bigint) as rank from f where n = 1 qualify rank <= 8")
def dedup_candidates(s, d):
    """Candidates of a song, the first of those with the same normalized sung lines, at most eight in their order."""
    t = sung_lines(s, d).withColumn("key", F.md5(F.array_join(F.transform("lines", T.norm), "\n")))
    # the first of equals by a mergeable minimum; no window over a song's texts
    f = t.groupBy("song_id", "key").agg(F.min(F.struct("cand", "lrclib_id")).alias("m"))
    n = F.row_number().over(W.partitionBy("song_id").orderBy("m.cand", "m.lrclib_id")).cast("bigint")
    return f.select("song_id", "m.lrclib_id", n.alias("rank")).filter("rank <= 8")


_NK = r"regexp_replace(replace(lower(text), '’', ''''), '[^\p{L}\p{M}\p{N}_'']', '', 'g')"


@query(f"with {LINES}, k as (select *, {_NK} key from l where text is not null) select line_id, first_value(translation) over (partition by plan_id, key order by i, line_id) as v from k")
def dedup_translation(s, d):
    """Equal lines of a plan get the translation of the first of them."""
    t = lines(s, d, "text", "translation").filter("text is not null").withColumn("key", T.norm(F.col("text")))
    w = W.partitionBy("plan_id", "key").orderBy("i", "line_id")
    return t.select("line_id", F.first("translation").over(w).alias("v"))


@query(f"""with {LINES}, k as (select plan_id, i, line_id, {_NK} key, translation from l where text is not null), kn as (select plan_id, key, arg_max(translation, i * 10000000 + line_id) tr from k where translation <> '' group by 1, 2)
select plan_id, bool_and(kn.tr is not null) as reuse from k left join kn using (plan_id, key) group by 1""")
def join_known_translation(s, d):
    """Whether every line of a plan has a stored translation; of several for one text the latest counts."""
    k = lines(s, d, "text", "translation").filter("text is not null").withColumn("key", T.norm(F.col("text")))
    known = k.filter("translation != ''").groupBy("plan_id", "key").agg(F.max_by("translation", F.struct("i", "line_id")).alias("tr"))
    return k.join(known, ["plan_id", "key"], "left").groupBy("plan_id").agg(F.bool_and(F.col("tr").isNotNull()).alias("reuse"))


_DS = f"with {LINES}, {_SEC}, k as (select *, {_NK} key from j where text is not null), f as (select *, min(section) over (partition by plan_id, key) f from k) select plan_id, section, bool_or(f = section) as kept from f group by 1, 2"


@query(_DS)
def dedup_sections(s, d):
    """A section is kept if at least one of its lines is heard in it for the first time."""
    k = section_lines(s, d, "text").filter("text is not null").withColumn("key", T.norm(F.col("text")))
    f = k.groupBy("plan_id", "key").agg(F.min("section").alias("f"))
    return k.join(f, ["plan_id", "key"]).groupBy("plan_id", "section").agg(F.bool_or(F.col("f") == F.col("section")).alias("kept"))


_JS = f"with {LINES}, {_SEC}, k as (select distinct plan_id, section, {_NK} key from j where text is not null) select a.plan_id, a.section as later, b.section as earlier from k a join k b on a.plan_id = b.plan_id and a.key = b.key and b.section < a.section group by 1, 2, 3 having count(*) = (select count(*) from k where k.plan_id = a.plan_id and k.section = a.section)"


@query(_JS)
def join_subset(s, d):
    """Pairs of sections of a plan of which the later one has no line the earlier one lacks."""
    k = section_lines(s, d, "text").filter("text is not null").select("plan_id", "section", T.norm(F.col("text")).alias("key")).distinct()
    n = k.groupBy("plan_id", "section").agg(F.count(F.lit(1)).alias("n"))
    a, b = k.withColumnRenamed("section", "later"), k.withColumnRenamed("section", "earlier")
    c = a.join(b, ["plan_id", "key"]).filter("earlier < later").groupBy("plan_id", "later", "earlier").agg(F.count(F.lit(1)).alias("c"))
    return c.join(n.withColumnRenamed("section", "later"), ["plan_id", "later"]).filter("c = n").select("plan_id", "later", "earlier")
