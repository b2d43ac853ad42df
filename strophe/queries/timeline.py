"""Time lines of events: as-of lookups, states in intervals, and what is drawn."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import intervals
from ..session import cut, table
from .base import LINES, Registry
from .lines import _SEC, section_lines
from .sections import _CURSOR, _NARRATION, _WIN, win_narration_timeline, win_section_cursor, win_song_windows

query = Registry()
QUERIES, SQL = query.queries, query.sql
r6 = lambda c: F.round(c, 6)


def events(s, d, kind=None):
    """Events as (user_id, event_id, us, value) with their time in microseconds."""
    t = table(s, d, "events")
    t = t.filter(F.col("event_type") == kind) if kind else t
    return t.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value", "event_type")


_EV = "ev as (select user_id, event_id, epoch_us(ts) us, value, event_type from events)"


@query(f"""with {_EV}, p as (select * from ev where event_type = 'purchase'), v as (select user_id, us, max(event_id) event_id from ev where event_type = 'view' group by 1, 2)
select p.event_id, coalesce(v.event_id, -1) as match_id from p asof left join v on p.user_id = v.user_id and p.us >= v.us""")
def join_asof_spoken(s, d):
    """The last view at or before each purchase of a user, -1 if there is none."""
    r = events(s, d, "view").select("user_id", "us", F.col("event_id").alias("match_id"))
    return intervals.asof_last(events(s, d, "purchase").select("user_id", "us", "event_id"), r, "user_id", "us", ["match_id"]).select("event_id", F.coalesce("match_id", F.lit(-1)).alias("match_id"))


@query(f"""with {_EV}, p as (select * from ev where event_type = 'click'), v as (select user_id, us, min(event_id) event_id from ev where event_type = 'signup' group by 1, 2)
select p.event_id, coalesce(v.event_id, -1) as match_id from p asof left join v on p.user_id = v.user_id and p.us < v.us""")
def join_next_start(s, d):
    """The first signup strictly after each click of a user; of several at one time the one with the least number, -1 if there is none."""
    r = events(s, d, "signup").select("user_id", "us", F.col("event_id").alias("match_id"))
    return intervals.next_after(events(s, d, "click").select("user_id", "us", "event_id"), r, "user_id", "us", ["match_id"]).select("event_id", F.coalesce("match_id", F.lit(-1)).alias("match_id"))


@query(f"with {_EV} select v.event_id, exists (select 1 from ev c where c.event_type = 'click' and c.user_id = v.user_id and c.us // 3600000000 = v.us // 3600000000 and c.us <= v.us + 1800000000) as shown from ev v where v.event_type = 'view'")
def join_src_dst(s, d):
    """Whether the counterpart of a view (a click of the user in the same hour) exists and has begun half an hour later."""
    h = F.floor(F.col("us") / 3600000000)
    c = events(s, d, "click").withColumn("h", h).groupBy("user_id", "h").agg(F.min("us").alias("first"))
    v = events(s, d, "view").withColumn("h", h).join(c, ["user_id", "h"], "left")
    return v.select("event_id", F.coalesce(F.col("first") <= F.col("us") + 1800000000, F.lit(False)).alias("shown"))


@query(f"""with {_EV}, iv as (select user_id, us a, us + cast(round(value * 60000000) as bigint) + case when event_type = 'signup' then 600000 else 0 end b, case event_type when 'signup' then 0 when 'purchase' then 1 else 2 end pr, event_id from ev where event_type in ('signup', 'purchase', 'click')),
j as (select v.event_id, pr, iv.event_id match_id, row_number() over (partition by v.event_id order by pr, iv.a, iv.event_id) n from ev v join iv on v.user_id = iv.user_id and v.us >= iv.a and v.us < iv.b where v.event_type = 'view')
select v.event_id, coalesce(case j.pr when 0 then 'text' when 1 then 'song' when 2 then 'lesson' end, 'title') as state, coalesce(j.match_id, -1) as match_id from ev v left join j on v.event_id = j.event_id and j.n = 1 where v.event_type = 'view'""")
def join_interval_state(s, d):
    """What a user sees at each view: a text, else a song, else a lesson whose interval holds it, else the title; of several the first begun.

    Of each kind only the stretches in which an interval is the first begun are looked up, in one pass over a user's events in order of time."""
    iv = events(s, d).filter("event_type in ('signup', 'purchase', 'click') and user_id is not null")
    pr = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    end = F.col("us") + F.round(F.col("value") * 60000000).cast("bigint") + F.when(pr == 0, 600000).otherwise(0)
    iv = intervals.first_begun(iv.select("user_id", pr.alias("pr"), F.col("us").alias("a"), end.alias("b"), F.col("event_id").alias("match_id")), ["user_id", "pr"], "match_id")
    v = events(s, d, "view").select("user_id", "us", "event_id")
    own = v.filter("user_id is not null and us is not null and event_id is not null").withColumn("_side", F.lit(1))
    # a view comes after what begins at the same time
    u = own.unionByName(iv.select("user_id", F.col("since").alias("us"), F.lit(0).alias("_side"), "pr", F.struct("b", "a", "match_id").alias("i")), allowMissingColumns=True)
    w = W.partitionBy("user_id").orderBy("us", "_side").rowsBetween(W.unboundedPreceding, 0)
    u = u.withColumns({f"i{k}": F.last(F.when(F.col("pr") == k, F.col("i")), True).over(w) for k in range(3)}).filter("_side = 1")
    seen = lambda k: F.when(F.col(f"i{k}.b") > F.col("us"), F.struct(F.lit(k).alias("pr"), F.col(f"i{k}.a"), F.col(f"i{k}.match_id").isNull().alias("none"), F.col(f"i{k}.match_id")))
    best = u.groupBy("event_id").agg(F.min(F.coalesce(*map(seen, range(3)))).alias("m"))
    state = F.coalesce(F.when(F.col("m.pr") == 0, "text").when(F.col("m.pr") == 1, "song").when(F.col("m.pr") == 2, "lesson"), F.lit("title"))
    return v.join(best, "event_id", "left").select("event_id", state.alias("state"), F.coalesce("m.match_id", F.lit(-1)).alias("match_id"))


_EVENTS = f"""cu as ({_CURSOR.format(win=_WIN)}), wn as ({_WIN}), na as ({_NARRATION}), {LINES}, {_SEC},
e as (select na.plan_id, na.section, line_id, kind, round(cu.t0 + na.t0, 6) t0, round(cu.t0 + na.t1, 6) t1 from na join cu using (plan_id, section)),
so as (select plan_id, section, round(cu.t1 - (wn."end" - wn.start), 6) t0, cu.t1, wn.start src0 from cu join wn using (plan_id, section)),
su as (select plan_id, section, j.k, round(so.t0 + coalesce(sing_start, start_s) - src0, 6) a, round(so.t0 + coalesce(sing_end, end_s) - src0, 6) b from j join so using (plan_id, section) where start_s is not null and end_s is not null),
fa as (select plan_id, section, min(t0) begins from (select plan_id, section, t0 from e where kind = 'src' union all select plan_id, section, t0 from so) group by 1, 2),
tot as (select plan_id, max(t1) + 1 total from (select plan_id, t1 from e union all select plan_id, t1 from so) group by 1),
c0 as (select plan_id, t0 t from e union select plan_id, t1 from e union select plan_id, t0 from so union select plan_id, t1 from so union select plan_id, a from su union select plan_id, b from su union select plan_id, begins from fa
  union select plan_id, unnest([0.0::double, 1.2, total]) from tot union select plan_id, unnest(range(1, cast(trunc(total) as bigint) + 1))::double from tot),
cut as (select plan_id, t from c0 join tot using (plan_id) where t between 0 and total)"""


def section_events(s, d):
    """What happens on the time line of each plan: (e, songs, sung, first): spoken lines, excerpts of the song with the begin src0 of what they
    play, when each line is sung in them, and when a section begins. A text is read at the very beginning, up to 1.2 s."""
    wn = cut(win_song_windows(s, d))
    cu = win_section_cursor(s, d, wn)
    at = cu.select("plan_id", "section", F.col("t0").alias("c0"))
    e = win_narration_timeline(s, d).join(at, ["plan_id", "section"]).select("plan_id", "section", "line_id", "kind", r6(F.col("c0") + F.col("t0")).alias("t0"), r6(F.col("c0") + F.col("t1")).alias("t1"))
    e = cut(e)  # each of these is looked up in several ways
    songs = cu.select("plan_id", "section", "t1").join(wn, ["plan_id", "section"]).select("plan_id", "section", r6(F.col("t1") - (F.col("end") - F.col("start"))).alias("t0"), "t1", F.col("start").alias("src0"))
    songs = cut(songs)
    j = section_lines(s, d, "start_s", "end_s", "sing_start", "sing_end").filter("start_s is not null and end_s is not null")
    own = j.join(songs, ["plan_id", "section"])
    x = lambda c, t: r6(F.col("t0") + F.coalesce(c, t) - F.col("src0"))
    sung = cut(own.select("plan_id", "section", "k", x("sing_start", "start_s").alias("a"), x("sing_end", "end_s").alias("b")))
    first = e.filter("kind = 'src'").select("plan_id", "section", "t0").unionByName(songs.select("plan_id", "section", "t0")).groupBy("plan_id", "section").agg(F.min("t0").alias("at"))
    return e, songs, sung, first


def cut_points(e, songs, sung, first):
    """(plan_id, t): every moment at which something begins or ends, whole seconds, 0 and the end; each once."""
    tot = e.select("plan_id", "t1").unionByName(songs.select("plan_id", "t1")).groupBy("plan_id").agg((F.max("t1") + 1).alias("total"))
    ticks = F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1), F.col("total").cast("bigint"))), lambda z: z.cast("double"))
    own = tot.select("plan_id", F.explode(F.concat(ticks, F.array(F.lit(0.0), F.lit(1.2), "total"))).alias("t"))
    edges = [df.select("plan_id", F.explode(F.array(*cs)).alias("t")) for df, cs in ((e, ("t0", "t1")), (songs, ("t0", "t1")), (sung, ("a", "b")), (first, ("at",)))]
    for x in edges:
        own = own.unionByName(x)
    return own.join(tot, "plan_id").filter("t between 0 and total").select("plan_id", "t").distinct()


@query(f"with {_EVENTS} select plan_id, t from cut")
def set_union_cuts(s, d):
    """Every moment at which something begins or ends on a plan's time line: spoken lines, excerpts, sung lines, sections; whole seconds, 0 and
    the end; each once."""
    return cut_points(*section_events(s, d))


_IV = f"""{_EVENTS}, th as (select *, lag(t) over (partition by plan_id order by t) pt from cut), iv as (select plan_id, t t0, lead(t) over (partition by plan_id order by t) t1 from th where pt is null or t - pt > 0.04),
mi as (select *, (t0 + t1) / 2 mid from iv where t1 is not null),
sg as (select mi.plan_id, mi.t0, so.section, row_number() over (partition by mi.plan_id, mi.t0 order by so.section) n from mi join so on so.plan_id = mi.plan_id and so.t0 <= mid and mid < so.t1),
cr as (select sg.plan_id, sg.t0, sg.section, coalesce(max(su.k), 0) k from sg join mi on mi.plan_id = sg.plan_id and mi.t0 = sg.t0 left join su on su.plan_id = sg.plan_id and su.section = sg.section and su.a <= mid where n = 1 group by 1, 2, 3),
ps as (select *, row_number() over (partition by plan_id, section order by t0, line_id) pos, count(*) over (partition by plan_id, section) n from e where kind = 'src'),
ls as (select mi.plan_id, mi.t0, mid, ps.section, ps.line_id, pos, n, row_number() over (partition by mi.plan_id, mi.t0 order by ps.t0 desc, ps.section desc, ps.line_id desc) r from mi join ps on ps.plan_id = mi.plan_id and ps.t0 <= mid),
le as (select ls.*, coalesce(de.t0 <= mid, false) shown, mid < coalesce(so.t0, 1e18) open from ls left join e de on de.plan_id = ls.plan_id and de.section = ls.section and de.line_id = ls.line_id and de.kind = 'dst' left join so on so.plan_id = ls.plan_id and so.section = ls.section where r = 1),
up as (select mi.plan_id, mi.t0, fa.section, row_number() over (partition by mi.plan_id, mi.t0 order by begins, fa.section) r from mi join fa on fa.plan_id = mi.plan_id and begins > mid),
fi as (select mi.plan_id, mi.t0, mi.t1, case when mi.mid < 1.8 then 'text' when cr.section is not null then 'song:' || cast(cr.section as varchar) || ':' || cast(cr.k as varchar)
  when le.open then 'lesson:' || cast(le.line_id as varchar) || case when shown then ':1:' else ':0:' end || cast(pos as varchar) || '/' || cast(le.n as varchar) else 'title:' || coalesce(cast(up.section as varchar), '-') end as state
  from mi left join cr on cr.plan_id = mi.plan_id and cr.t0 = mi.t0 left join le on le.plan_id = mi.plan_id and le.t0 = mi.t0 left join up on up.plan_id = mi.plan_id and up.t0 = mi.t0 and up.r = 1)"""


@query(f"with {_IV} select * from fi")
def win_intervals(s, d):
    """Intervals of one visual state on a plan's time line: points closer than 0.04 s to the one before are thinned, the state is that of
    the middle. A text is shown 0.6 s longer than it is read; else the excerpt that plays, with the number of the line last begun; else the
    line last spoken, whether its translation has begun, its place in the lesson; else a title with the section that comes next."""
    e, songs, sung, first = section_events(s, d)
    iv = intervals.tile(cut_points(e, songs, sung, first), "plan_id", "t").withColumn("mid", (F.col("t0") + F.col("t1")) / 2)
    # where excerpts overlap the first one is seen
    o = W.partitionBy("plan_id").orderBy("section").rowsBetween(W.unboundedPreceding, -1)
    so = songs.withColumn("mid", F.greatest("t0", F.coalesce(F.max("t1").over(o), F.col("t0")))).filter("mid < t1")
    st = intervals.asof_last(iv, so.select("plan_id", "mid", F.col("t1").alias("until"), F.col("section").alias("song")), "plan_id", "mid", ["until", "song"])
    st = st.withColumn("song", F.when(F.col("mid") < F.col("until"), F.col("song"))).withColumn("at", F.concat_ws("/", "plan_id", F.coalesce(F.col("song").cast("string"), F.lit("-"))))
    # the highest number among the lines begun, whatever order they are sung in
    w = W.partitionBy("plan_id", "section").orderBy("a").rangeBetween(W.unboundedPreceding, 0)
    su = sung.withColumn("cur", F.max("k").over(w)).select(F.concat_ws("/", "plan_id", F.col("section").cast("string")).alias("at"), F.col("a").alias("mid"), "cur")
    st = intervals.asof_last(st, su, "at", "mid", ["cur"]).drop("at", "until")
    p = W.partitionBy("plan_id", "section")
    src = e.filter("kind = 'src'").withColumns({"pos": F.row_number().over(p.orderBy("t0", "line_id")), "n": F.count(F.lit(1)).over(p)})
    src = src.join(e.filter("kind = 'dst'").select("plan_id", "section", "line_id", F.col("t0").alias("dt")), ["plan_id", "section", "line_id"], "left").join(songs.select("plan_id", "section", F.col("t0").alias("st")), ["plan_id", "section"], "left")
    st = intervals.asof_last(st, src.select("plan_id", F.col("t0").alias("mid"), "section", "line_id", "pos", "n", "dt", "st"), "plan_id", "mid", ["section", "line_id", "pos", "n", "dt", "st"])
    nx = first.select("plan_id", F.col("at").alias("mid"), F.col("section").alias("next"))
    st = intervals.next_after(st, nx, "plan_id", "mid", ["next"])
    text = lambda c: F.col(c).cast("string")
    lesson = F.col("line_id").isNotNull() & (F.col("mid") < F.coalesce("st", F.lit(1e18)))
    state = (
        F.when(F.col("mid") < 1.8, "text").when(F.col("song").isNotNull(), F.concat(F.lit("song:"), text("song"), F.lit(":"), F.coalesce("cur", F.lit(0)).cast("string")))
        .when(lesson, F.concat(F.lit("lesson:"), text("line_id"), F.when(F.col("dt") <= F.col("mid"), ":1:").otherwise(":0:"), text("pos"), F.lit("/"), text("n"))).otherwise(F.concat(F.lit("title:"), F.coalesce(text("next"), F.lit("-"))))
    )
    return st.select("plan_id", "t0", "t1", state.alias("state"))


@query(f"{'with ' + _IV} select distinct plan_id, state from fi")
def distinct_states(s, d):
    """One picture is drawn for each distinct state."""
    return win_intervals(s, d).select("plan_id", "state").distinct()


@query(f"with {_IV}, nn as (select *, row_number() over (partition by plan_id order by t0) - 1 as n from fi) select plan_id, cast(n as bigint) as n, state, round(t1 - t0, 4) as duration from nn")
def sink_video(s, d):
    """The listing of frames: a state and how long it is shown."""
    n = F.row_number().over(W.partitionBy("plan_id").orderBy("t0")) - 1
    return win_intervals(s, d).select("plan_id", n.cast("bigint").alias("n"), "state", F.round(F.col("t1") - F.col("t0"), 4).alias("duration"))
