"""Level series, feature frames, and the search for stretches that repeat."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import intervals, islands, repeats
from ..operators import similarity as S
from ..session import cut, table
from .base import FRAMES, Registry, frames

query = Registry()
QUERIES, SQL = query.queries, query.sql
r6 = lambda c: F.round(c, 6)


def vectors(s, d):
    """Feature frames of each label: (label, f, v), f from 0 in order of vec_id."""
    t = table(s, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return islands.numbered(t, "label", "vec_id", [], "f").select("label", "f", "v")


_EM = "em as (select label, row_number() over (partition by label order by vec_id) - 1 as f, embedding::double[] v from embeddings)"
_COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-9)"
_CY = "{0} as (select a.label, a.f, " + _COS + " c from em a join em b on a.label = b.label and b.f = a.f + {1})"
_ST = "{0} as (select label, f, avg(c) over w sim, count(*) over w n from {1} window w as (partition by label order by f range between current row and {2} following) qualify n = {2} + 1)"


@query(f"""with {FRAMES}, x as (select user_id, greatest(v - 90, -80.0) x from fr), p as (select user_id, quantile_cont(x, 0.9) p90, quantile_cont(x, 0.1) lo from x group by 1),
m as (select x.user_id, median(x) sing, max(lo) lo from x join p using (user_id) where x > p90 - 15 group by 1) select user_id, round(greatest(sing - 18, lo + 0.4 * (sing - lo)), 6) as v from m""")
def agg_vocal_threshold(s, d):
    """Level below which a series counts as silent: 18 under the usual loud level, but at least 40 % of the way up from the floor."""
    x = frames(s, d).select("user_id", F.greatest(F.col("v") - 90, F.lit(-80.0)).alias("x"))
    p = x.groupBy("user_id").agg(F.percentile("x", 0.9).alias("hi"), F.percentile("x", 0.1).alias("lo"))
    m = x.join(p, "user_id").filter("x > hi - 15").groupBy("user_id").agg(F.median("x").alias("sing"), F.max("lo").alias("lo"))
    return m.select("user_id", r6(F.greatest(F.col("sing") - 18, F.col("lo") + 0.4 * (F.col("sing") - F.col("lo")))).alias("v"))


@query(f"with {FRAMES} select user_id, cast(f // 8 as bigint) as h, round(20 * log10(sqrt(avg(v * v)) + 1e-9), 6) as db from fr group by 1, 2 having count(*) = 8")
def agg_frame_rms(s, d):
    g = frames(s, d).groupBy("user_id", F.floor(F.col("f") / 8).alias("h")).agg(F.avg(F.col("v") * F.col("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return g.filter("n = 8").select("user_id", "h", r6(20 * F.log10(F.sqrt("m") + 1e-9)).alias("db"))


@query(f"with {FRAMES} select user_id, round(sqrt(avg(v * v)) + 1e-12, 6) as v from fr group by 1")
def agg_rms(s, d):
    return frames(s, d).groupBy("user_id").agg(r6(F.sqrt(F.avg(F.col("v") * F.col("v"))) + 1e-12).alias("v"))


@query(f"with {FRAMES} select user_id, round(median(v), 6) as v from fr where v < 80 group by 1")
def agg_median_loudness(s, d):
    return frames(s, d).filter("v < 80").groupBy("user_id").agg(r6(F.median("v")).alias("v"))


@query(f"with {FRAMES}, m as (select user_id, max(v) m from fr group by 1) select user_id, min(f) as a, max(f) as b from fr join m using (user_id) where v > m * pow(10, -35 / 20.0) group by 1")
def agg_trim(s, d):
    """First and last frame within 35 dB of the loudest."""
    x = frames(s, d)
    m = x.groupBy("user_id").agg(F.max("v").alias("m"))
    return x.join(m, "user_id").filter(F.col("v") > F.col("m") * 10 ** (-35 / 20)).groupBy("user_id").agg(F.min("f").alias("a"), F.max("f").alias("b"))


_BT = "bt as (select user_id, event_id, epoch_us(ts) / 1e6 t, row_number() over (partition by user_id order by ts, event_id) - 1 as j from events)"


def beats(s, d):
    """Event times as beats: (user_id, event_id, j, t)."""
    t = table(s, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return islands.numbered(t, "user_id", "us", ["event_id"], "j").select("user_id", "event_id", (F.col("us") / 1e6).alias("t"), "j")


@query(f"""with {_BT}, dd as (select user_id, t, t - lag(t) over (partition by user_id order by j) d from bt), m as (select user_id, median(d) m from dd group by 1)
select user_id, round((max(t) - min(t)) / sum(case when d is not null then greatest(1.0, round_even(d / m, 0)) end), 3) as v from dd join m using (user_id) where m > 0 group by 1 having count(*) > 1""")
def agg_beat_period(s, d):
    """Span of the beats by the number of beats each interval stands for."""
    x = beats(s, d).withColumn("d", F.col("t") - F.lag("t").over(W.partitionBy("user_id").orderBy("j")))
    m = x.groupBy("user_id").agg(F.median("d").alias("m")).filter("m > 0")
    u = F.greatest(F.lit(1.0), F.bround(F.col("d") / F.col("m")))
    g = x.join(m, "user_id").groupBy("user_id").agg((F.max("t") - F.min("t")).alias("span"), F.sum(F.when(F.col("d").isNotNull(), u)).alias("n"))
    return g.filter("n > 0").select("user_id", F.round(F.col("span") / F.col("n"), 3).alias("v"))


@query(f"with {_EM}, {_CY.format('c', 4)} select label, round(case when count(*) < 4 then -1.0 else avg(c) end, 6) as v from c group by 1")
def agg_cosine(s, d):
    """Mean cosine of each frame with the one four later; fewer than four pairs give -1."""
    c = S.cycle(vectors(s, d), "label", "f", "v", 4)
    return c.groupBy("label").agg(r6(F.when(F.count(F.lit(1)) < 4, -1.0).otherwise(F.avg("cos"))).alias("v"))


@query(f"with {_EM}, x as (select label, f, unnest(v) v, generate_subscripts(v, 1) - 1 as bin from em) select label, f, cast(bin as int) as bin, round(v - avg(v) over (partition by label, bin), 6) as v from x")
def agg_mean_centre(s, d):
    """Frames less the mean of each feature bin over all frames of the label."""
    v = vectors(s, d)
    m = S.means(v, ["label"], "v")
    return v.join(m, "label").select("label", "f", F.posexplode(S.minus(F.col("v"), F.col("mean"))).alias("bin", "v")).select("label", "f", "bin", r6("v").alias("v"))


@query(f"with {_EM}, {_CY.format('c', 4)} select label, f, round(c, 6) as v from c")
def join_self_cycle(s, d):
    return S.cycle(vectors(s, d), "label", "f", "v", 4).select("label", "f", r6("cos").alias("v"))


_PE = "coalesce(case when stddev_pop({0}) >= 1e-9 and stddev_pop({1}) >= 1e-9 then covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) end, -1)"


@query(f"with {FRAMES}, p as (select a.user_id, a.v x, b.v y from fr a join fr b on a.user_id = b.user_id and b.f = a.f + 1) select user_id, round({_PE.format('x', 'y')}, 6) as v from p group by 1")
def agg_corr(s, d):
    """Correlation of a series with itself one frame later."""
    x = frames(s, d)
    p = x.select("user_id", "f", F.col("v").alias("x")).join(x.select("user_id", (F.col("f") - 1).alias("f"), F.col("v").alias("y")), ["user_id", "f"])
    return p.groupBy("user_id").agg(r6(S.pearson("x", "y")).alias("v"))


_FX = "fx as (select a.label, b.f, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) / len(a.v) x from em a join em b on a.label = b.label and b.f = a.f + 1)"


def flux(s, d):
    v = vectors(s, d)
    p = v.select("label", (F.col("f") + 1).alias("f"), F.col("v").alias("p"))
    return v.join(p, ["label", "f"]).select("label", "f", S.mean_difference(F.col("v"), F.col("p")).alias("x"))


@query(f"with {_EM}, {_FX} select label, f, round(max(x) over (partition by label order by f rows between 1 preceding and 1 following), 6) as peak from fx")
def agg_flux(s, d):
    """Mean absolute difference to the frame before, as a maximum over three frames."""
    w = W.partitionBy("label").orderBy("f").rowsBetween(-1, 1)
    return flux(s, d).select("label", "f", r6(F.max("x").over(w)).alias("peak"))


@query(f"""with {FRAMES}, s as (select user_id, f a from fr where f % 4 = 0), p as (select s.user_id, s.a, d, x.v x, y.v y from s join (select unnest([-2, -1, 0, 1, 2]) d) on true join (select unnest(range(0, 16)) i) on true join fr x on s.user_id = x.user_id and x.f = s.a + i join fr y on s.user_id = y.user_id and y.f = s.a + 8 + d + i),
c as (select user_id, a, d, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) c from p group by 1, 2, 3 having count(*) = 16 and stddev_pop(x) >= 1e-6 and stddev_pop(y) >= 1e-6) select user_id, a, cast(8 + d as int) as period, c from c qualify row_number() over (partition by user_id, a order by c desc, d) = 1""")
def win_refine_period(s, d):
    """From every fourth frame on: the period of eight frames, two more or less, at which sixteen frames recur best, the shortest of
    equals; stretches that are constant or too short are skipped."""
    o = repeats.ahead(frames(s, d), "user_id", "f", {"o": ("v", 0, 25)}).filter("f % 4 = 0")
    lag = F.explode(F.array(*map(F.lit, range(-2, 3)))).alias("d")
    c = o.select("user_id", F.col("f").alias("a"), lag, "o").withColumn("c", F.round(repeats.correlation(F.slice("o", 1, 16), F.slice("o", F.col("d") + 9, 16), 16), 6))
    m = c.filter("c is not null").groupBy("user_id", "a").agg(F.min(F.struct((-F.col("c")).alias("nc"), "d")).alias("m"))
    return m.select("user_id", "a", (F.col("m.d") + 8).alias("period"), (-F.col("m.nc")).alias("c"))


_THR = "x0 as (select user_id, f, greatest(v - 90, -80.0) x, v from fr), p0 as (select user_id, quantile_cont(x, 0.9) p90, quantile_cont(x, 0.1) lo from x0 group by 1), th as (select x0.user_id, greatest(median(x) - 18, max(lo) + 0.4 * (median(x) - max(lo))) t from x0 join p0 using (user_id) where x > p90 - 15 group by 1)"


@query(f"""with {FRAMES}, {_THR}, m as (select user_id, median(v) med from x0 join th using (user_id) where x < t group by 1),
w as (select user_id, f, max(x) over (partition by user_id order by f range between 1 preceding and 12 following) hi, count(*) over (partition by user_id order by f range between 1 preceding and 12 following) n, avg(v) over (partition by user_id order by f range between current row and 11 following) mean from x0)
select user_id, f from w join m using (user_id) join th using (user_id) where n = 14 and f % 2 = 0 and hi <= t + 12 and abs(mean - med) <= 20""")
def flt_loop_hard(s, d):
    """Starts of stretches of twelve frames with a frame on both sides, none of them louder than the threshold of agg_vocal_threshold allows
    (12 dB relaxed), whose mean is near the usual level of the quiet frames."""
    o = W.partitionBy("user_id").orderBy("f")
    x = frames(s, d).withColumn("x", F.greatest(F.col("v") - 90, F.lit(-80.0)))
    th = repeats.threshold(x, "user_id", "x")
    m = x.join(th, "user_id").filter("x < base").groupBy("user_id").agg(F.median("v").alias("med"), F.first("base").alias("base"))
    w = x.withColumns({"hi": F.max("x").over(o.rangeBetween(-1, 12)), "n": F.count(F.lit(1)).over(o.rangeBetween(-1, 12)), "mean": F.avg("v").over(o.rangeBetween(0, 11))})
    return w.join(m, "user_id").filter("n = 14 and f % 2 = 0 and hi <= base + 12 and abs(mean - med) <= 20").select("user_id", "f")


# A label's frames stand for a song: the first bin of a frame for its onsets, the second and third for the levels of voice and music in dB;
# a beat is two frames, a bar two beats.
_X = f"""{_EM}, x as (select label, f, v, v[1] o, 60 * v[2] vl, 30 * v[3] il from em), nf as (select label, count(*) n from em group by 1),
px as (select label, quantile_cont(greatest(vl, -80), 0.9) hi, quantile_cont(greatest(vl, -80), 0.1) lo from x group by 1),
tb as (select label, greatest(median(greatest(vl, -80)) - 18, max(lo) + 0.4 * (median(greatest(vl, -80)) - max(lo))) base from x join px using (label) where greatest(vl, -80) > hi - 15 group by 1),
th as (select label, k, case when k = 3 then 1e9 else base + 6 * k end vf from tb, (select unnest([0, 1, 2, 3]) k)),
me as (select label, k, median(il) med from x join th using (label) where vl < vf group by 1, 2),
cm as (select label, k, list(m order by bin) m from (select label, k, bin, avg(v[bin]) m from x join th using (label), (select unnest(range(1, 65)) bin) where vl < vf group by 1, 2, 3) group by 1, 2),
sc as (select x.label, k, f, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) u from x join cm using (label)),
pd as (select a.label, b.f, bars, d, round(covar_pop(a.o, c.o) / (stddev_pop(a.o) * stddev_pop(c.o)), 6) c from (select label, f from x where f % 2 = 0) b, (select unnest([1, 2, 4]) bars), (select unnest([-2, -1, 0, 1, 2]) d), (select unnest(range(0, 16)) i)
  join x a on a.label = b.label and a.f = b.f + i join x c on c.label = b.label and c.f = b.f + 4 * bars + d + i where i < 4 * bars group by 1, 2, 3, 4 having count(*) = least(16, 4 * bars) and stddev_pop(a.o) >= 1e-6 and stddev_pop(c.o) >= 1e-6),
pr as (select x.label, x.f, b.bars, 4 * b.bars + coalesce(q.d, 0) L, coalesce(q.c, -9.0) pc from x, (select unnest([1, 2, 4]) bars) b left join (select * from pd qualify row_number() over (partition by label, f, bars order by c desc, d) = 1) q on q.label = x.label and q.f = x.f and q.bars = b.bars where x.f % 2 = 0),
rg as (select pr.*, th.k, vf, strict, 2 * th.k + 1 - strict rung, f + (1 + strict) * L fin, n from pr join th using (label) join nf using (label), (select unnest([0, 1]) strict) where f >= 1 and f + 2 * L + 2 < n),
lv as (select rg.label, rg.f, bars, rung, max(vl) hi, avg(case when x.f >= rg.f and x.f < fin then il end) mean from rg join x on x.label = rg.label and x.f >= rg.f - 1 and x.f < fin + 2 group by 1, 2, 3, 4),
ok as (select rg.*, f + 3 * L < n third from rg join lv using (label, f, bars, rung) join me using (label, k) where hi <= vf and abs(mean - med) <= case when rung in (4, 5) then 8.0 else 4.0 end),
si as (select ok.label, ok.f, bars, rung, avg(case when i < L then {_COS.replace('a.v', 'a.u').replace('b.v', 'b.u')} end) s1, avg(case when i >= L then {_COS.replace('a.v', 'a.u').replace('b.v', 'b.u')} end) s2 from ok, (select unnest(range(0, 36)) i) join sc a on a.label = ok.label and a.k = ok.k and a.f = ok.f + i join sc b on b.label = ok.label and b.k = ok.k and b.f = ok.f + L + i where i < 2 * L group by 1, 2, 3, 4),
t3 as (select ok.label, ok.f, bars, rung, max(vl) hi from ok join x on x.label = ok.label and x.f >= ok.f + 2 * L and x.f < ok.f + 3 * L where third group by 1, 2, 3, 4),
ca as (select ok.label, bars, rung, ok.f, cast(L as int) L, pc, case when L < 4 then -1.0 when third and t3.hi <= vf then least(s1, s2) else s1 end sim from ok join si using (label, f, bars, rung) left join t3 using (label, f, bars, rung)),
lo as (select label, bars, rung, f, L, round(pc, 6) pc, round(sim, 6) sim, round(sim + 0.3 * pc, 6) score from ca)"""


def song(s, d):
    """(label, f, v, o, vl, il): frames with their onsets and levels."""
    v = F.col("v")
    return vectors(s, d).select("label", "f", "v", v[0].alias("o"), (60 * v[1]).alias("vl"), (30 * v[2]).alias("il"))


def loops(s, d, x=None):
    return repeats.search(song(s, d) if x is None else x, "label", bars=(1, 2, 4), bar=4, beat=2)


@query(f"with {_X} select label, bars, cast(rung as int) as rung, f, L as length, pc, sim, cast(row_number() over (partition by label, bars, rung order by score desc, f) as bigint) as rank from lo")
def top_loops(s, d):
    """Stretches that may be repeated, on every rung of the ladder of thresholds, by their similarity with the next cycle and 0.3 of the
    correlation of their onsets; two cycles in a row have to match where the third one has no voice."""
    w = W.partitionBy("label", "bars", "rung").orderBy(F.desc("score"), "f")
    return loops(s, d).select("label", "bars", "rung", "f", "length", "pc", "sim", F.row_number().over(w).cast("bigint").alias("rank"))


_FL = "fl as (select a.label, a.f, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) / len(a.v) y from em a join em b on a.label = b.label and b.f = a.f + 1)"
_SEAM = f"""{_FL}, s0 as (select t.label, t.bars, t.rung, t.f, greatest(max(case when fl.f between t.f + L - 3 and t.f + L - 1 or fl.f between t.f + 1 and t.f + 2 then y end), max(list_sum(list_transform(list_zip(p.v, q.v), lambda z: abs(z[1] - z[2]))) / len(p.v))) seam
  from t join fl on fl.label = t.label and fl.f between t.f + 1 and t.f + L - 1 join em p on p.label = t.label and p.f = t.f + 1 join em q on q.label = t.label and q.f = t.f + L group by 1, 2, 3, 4),
s1 as (select t.label, t.bars, t.rung, t.f, c, max(y) y from t, (select unnest([0, 1, 2]) c) join fl on fl.label = t.label and fl.f between t.f + c * L - 3 and t.f + c * L + 2 group by 1, 2, 3, 4, 5),
sm as (select label, bars, rung, f, round(max(seam) / (avg(y) + 1e-9), 6) seam from s0 join s1 using (label, bars, rung, f) group by 1, 2, 3, 4)"""
_CANDS = f"""{_X}, r0 as (select *, min(rung) over (partition by label, bars) mr from lo where rung < 6), r1 as (select *, min(rung) over (partition by label, bars) mr from lo where rung >= 6),
t as (select *, row_number() over (partition by label, bars, rung order by score desc, f) n from (select * from r0 union all select * from r1) where rung = mr qualify n <= 40), {_SEAM},
cd as (select t.label, t.bars, cast(t.rung as int) as rung, t.f, t.L, t.sim, sm.seam, cast(row_number() over (partition by t.label, t.bars, t.rung >= 6 order by round(t.sim - 0.15 * greatest(0, sm.seam - 1), 6) desc, n) as bigint) rank from t join sm using (label, bars, rung, f))"""


def candidates(s, d):
    """(label, bars, rung, f, length, sim, seam, rank): of the first rung that has any the forty best, ranked anew with their seams; and the
    same of the last two rungs, on which singing is allowed."""
    x = song(s, d)
    w = W.partitionBy("label", "bars", F.col("rung") >= 6)
    c = loops(s, d, x).withColumn("mr", F.min("rung").over(w)).filter("rung = mr")
    c = cut(c.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "f"))).filter("n <= 40"))
    c = c.join(repeats.seams(x, "label", c), ["label", "f", "length"])
    key = F.round(F.col("sim") - 0.15 * F.greatest(F.lit(0.0), F.col("seam") - 1), 6)
    return c.withColumn("key", key).withColumn("rank", F.row_number().over(w.orderBy(F.desc("key"), "n")).cast("bigint"))


@query(f"with {_CANDS} select label, bars, rung, f, L as length, seam, rank from cd where rung < 6")
def top_candidates(s, d):
    """Ranked candidates of each length: the threshold is relaxed by 6 and 12 dB, on each step first for two cycles, then for the loop alone; on the
    last step the loudness may differ twice as much."""
    return candidates(s, d).filter("rung < 6").select("label", "bars", "rung", "f", "length", "seam", "rank")


@query(f"with {_CANDS} select label, bars, f, L as length, seam from cd where rung < 6 and rank <= 10")
def agg_seam(s, d):
    """The jump at the seam of a loop against those at the same place of the bar in the original: 1 is as natural as the song."""
    return candidates(s, d).filter("rung < 6 and rank <= 10").select("label", "bars", "f", "length", "seam")


@query(f"with {_CANDS} select label, bars, f, L as length, rank from cd where rung < 6 and rank <= 2")
def limit_list_loops(s, d):
    """The two best stretches of each length."""
    return candidates(s, d).filter("rung < 6 and rank <= 2").select("label", "bars", "f", "length", "rank")


@query(f"with {_CANDS} select label, bars, f, L as length, cast(greatest(2, ceil(24.0 / L)) as bigint) as cycles from cd where rung < 6 and rank <= 2")
def sink_loops(s, d):
    """What is exported: the two best stretches of each length, repeated to at least two cycles and 24 frames."""
    return limit_list_loops(s, d).select("label", "bars", "f", "length", F.greatest(F.lit(2), F.ceil(24.0 / F.col("length"))).cast("bigint").alias("cycles"))


_PICK = f"""{_CANDS}, op as (select label, f, bars, L, sim, case when bars = 4 and rung < 6 then 1 when bars = 4 and sim >= 0.45 then 2 when bars = 2 and rung < 6 then 3 when bars = 1 and rung < 6 then 4 end pref from cd where rank = 1
  union all select label, f, bars, cast(L as int), null, 0 from pr where label % 5 = 0 and f = 8 and bars = 4),
pk as (select label, coalesce(f, -1) f, coalesce(bars, 0) bars, coalesce(L, 0) length, sim, case pref when 0 then 'manual' when 1 then 'asked' when 2 then 'sung' when 3 then 'shorter' when 4 then 'shorter' else 'none' end note from (select nf.label, op.* exclude (label) from nf left join (select * from op where pref is not null) op using (label) qualify row_number() over (partition by nf.label order by pref) = 1))"""


@query(f"with {_PICK} select label, cast(f as bigint) as f, cast(bars as int) as bars, length, round(sim, 6) as sim, note from pk")
def pick_loop(s, d):
    """The loop of each label: where its start is given (here 8, for every fifth label) that; else the best of the length asked for (4 bars);
    else of that length with singing, if it repeats well (0.45 or more); else of a half and a quarter; else none."""
    c = candidates(s, d).filter("rank = 1")
    low = F.col("rung") < 6
    pref = F.when((F.col("bars") == 4) & low, 1).when((F.col("bars") == 4) & (F.col("sim") >= 0.45), 2).when((F.col("bars") == 2) & low, 3).when((F.col("bars") == 1) & low, 4)
    c = c.select("label", pref.alias("pref"), "f", "bars", "length", "sim").filter("pref is not null")
    x = song(s, d)
    given = repeats.periods(x.filter("label % 5 = 0"), "label", (4,), 4, 2).filter("f = 8").select("label", F.lit(0).alias("pref"), "f", "bars", "length", F.lit(None).cast("double").alias("sim"))
    m = c.unionByName(given).groupBy("label").agg(F.min(F.struct("pref", "f", "bars", "length", "sim")).alias("m"))
    note = F.when(F.col("m.pref") == 0, "manual").when(F.col("m.pref") == 1, "asked").when(F.col("m.pref") == 2, "sung").when(F.col("m.pref") > 2, "shorter").otherwise("none")
    all_ = x.select("label").distinct().join(m, "label", "left")
    return all_.select("label", F.coalesce("m.f", F.lit(-1)).cast("bigint").alias("f"), F.coalesce("m.bars", F.lit(0)).alias("bars"), F.coalesce("m.length", F.lit(0)).cast("int").alias("length"), r6("m.sim").alias("sim"), note.alias("note"))


# an entry is searched on the beats from frame 8 to the last but two, with a crossfade of four frames, compared over six, for a loop that starts at frame 5
_ENT = f"""{_EM}, x as (select label, f, v, v[1] o from em), nf as (select label, count(*) n from em group by 1), bt as (select label, f, f // 2 j from x where f % 2 = 0),
j0 as (select label, j j0 from bt qualify row_number() over (partition by label order by abs(f - 5), j) = 1),
cm as (select label, list(m order by bin) m from (select label, bin, avg(v[bin]) m from x, (select unnest(range(1, 65)) bin) group by 1, 2) group by 1),
sc as (select x.label, f, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) u from x join cm using (label)),
rf as (select bt.label, bt.f rf, bt.j - j0 q from bt join j0 using (label) join nf using (label) where bt.j - j0 between 0 and 1 and bt.f + 6 <= n),
en as (select bt.label, bt.f t, rf.q, rf.rf, n - 2 hi, n from bt join j0 using (label) join nf using (label) join rf on rf.label = bt.label and rf.q = ((bt.j - j0) % 2 + 2) % 2 where n >= 8 and bt.f >= 8 and bt.f + 4 <= n - 2 and bt.f + 6 + 1 < n)"""


def entries(s, d):
    x = vectors(s, d).select("label", "f", "v", F.col("v")[0].alias("o"))
    return repeats.entries(x, "label", loop=5, beat=2, bpb=2, lo=8, short=2, cross=4, width=6)


@query(f"with {_ENT} select label, t, cast(q as bigint) as q from en")
def flt_entry(s, d):
    """Beats on which an excerpt may begin: late enough, with room for the crossfade before the first sung word, with a reference stretch of
    the loop at the same phase and all frames there."""
    return entries(s, d).select("label", "t", "q")


@query(f"""with {_ENT}, od as (select en.label, en.t, en.q, en.rf, hi, n, d, count(*) c, coalesce(case when count(*) = 6 and stddev_pop(a.o) >= 1e-9 and stddev_pop(b.o) >= 1e-9 then covar_pop(a.o, b.o) / (stddev_pop(a.o) * stddev_pop(b.o)) end, -1) oc
  from en, (select unnest([-1, 0, 1]) d), (select unnest(range(0, 6)) i) left join x a on a.label = en.label and a.f = en.rf + i left join x b on b.label = en.label and b.f = en.t + d + i where en.t + d >= 0 group by 1, 2, 3, 4, 5, 6, 7),
ob as (select * from od qualify row_number() over (partition by label, t order by round(oc, 6) desc, d) = 1),
z as (select ob.label, ob.t, ob.q, ob.d, round(oc, 6) oc, round(avg({_COS.replace('a.v', 'a.u').replace('b.v', 'b.u')}), 6) sim, max(hi) hi from ob, (select unnest(range(0, 6)) i) join sc a on a.label = ob.label and a.f = ob.rf + i join sc b on b.label = ob.label and b.f = ob.t + ob.d + i group by 1, 2, 3, 4, 5 having count(*) = 6),
y as (select *, round(sim + 0.5 * oc + case when q = 0 then 0.05 else 0 end - 0.01 * greatest(0, hi - 4 - (t + d)), 6) score from z)
select label, t + d as t, cast(q as bigint) as q, cast(d as int) as lag, oc, sim, score from y qualify row_number() over (partition by label order by score desc, y.t) = 1""")
def top_entry(s, d):
    """The beat on which the song takes over: where its next frames resemble those of the loop at the same phase most, in sound and in
    onsets, moved by a frame if the onsets then fall together better; bar lines and late beats are preferred, the first of equals."""
    x = vectors(s, d).select("label", "f", "v", F.col("v")[0].alias("o"))
    b = repeats.scored_entries(x, "label", entries(s, d), lag=1, cross=4, width=6)
    m = b.groupBy("label").agg(F.min(F.struct((-F.col("score")).alias("n"), F.col("t"), "q", "d", "oc", "sim", "score")).alias("m"))
    return m.select("label", (F.col("m.t") + F.col("m.d")).alias("t"), "m.q", F.col("m.d").alias("lag"), "m.oc", "m.sim", "m.score")


@query(f"with {FRAMES}, n as (select user_id, count(*) n from fr where v < 60 group by 1), x as (select user_id, n, unnest([1, 2, 4, 8]) k from n) select user_id, cast(min(k) as int) as k from x where n >= 64 / k group by 1")
def ladder_xfade(s, d):
    """The longest of X, X/2, X/4, X/8 for which there is room: the first rung of the ladder that fits."""
    n = frames(s, d).filter("v < 60").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", "n", F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))).alias("k")).filter(F.col("n") >= 64 / F.col("k")).groupBy("user_id").agg(F.min("k").alias("k"))


@query(f"with {_BT}, m as (select user_id, min(t) + 86400 x from bt group by 1) select user_id, j from bt join m using (user_id) qualify row_number() over (partition by user_id order by abs(t - x), j) = 1")
def nearest_beat(s, d):
    """The beat nearest to a day after the first; the first of equals."""
    b = beats(s, d)
    m = b.groupBy("user_id").agg((F.min("t") + 86400).alias("x"))
    g = b.join(m, "user_id").groupBy("user_id").agg(F.min(F.struct(F.abs(F.col("t") - F.col("x")).alias("d"), "j")).alias("m"))
    return g.select("user_id", "m.j")


@query(f"with {FRAMES}, w as (select user_id, f w, unnest(range(f, f + 6)) f from fr where f % 10 = 0) select w.user_id, w.w as win, cast(count(*) as bigint) as n, round(avg(v), 6) as mean, max(v) as hi from w join fr using (user_id, f) group by 1, 2")
def join_window_frames(s, d):
    """Windows of six frames from every tenth on, with the mean and maximum of their frames."""
    x = frames(s, d)
    w = intervals.cover(x.filter("f % 10 = 0").select("user_id", F.col("f").alias("win")), ["user_id"], F.col("win"), F.col("win") + 6, "f")
    return w.join(x, ["user_id", "f"]).groupBy("user_id", "win").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("v")).alias("mean"), F.max("v").alias("hi"))


@query(f"with {_BT}, q as (select user_id, j q from bt where j < 4) select bt.user_id, bt.j, q.q as phase from bt join q on bt.user_id = q.user_id and ((bt.j - 5) % 4 + 4) % 4 = q.q")
def join_cross_beats_phase(s, d):
    """Every beat with the reference phase it stands in, counted from beat 5."""
    b = beats(s, d).select("user_id", "j")
    q = b.filter("j < 4").select("user_id", F.col("j").alias("phase"))
    return b.withColumn("phase", F.pmod(F.col("j") - 5, F.lit(4))).join(q, ["user_id", "phase"]).select("user_id", "j", "phase")


@query(f"with {FRAMES} select a.user_id, a.f - 2 as k, round(case when a.f - 2 < 5 then pow(sin(pi() / 2 * (a.f - 2) / 4), 2) * a.v + (1 - pow(sin(pi() / 2 * (a.f - 2) / 4), 2)) * b.v else a.v end, 6) as v from fr a join fr b on a.user_id = b.user_id and b.f = a.f + 20 where a.f between 2 and 21")
def win_loop_crossfade(s, d):
    """A loop of twenty frames from frame 2 on; its first five fade from what follows its end."""
    x = frames(s, d)
    b = x.select("user_id", (F.col("f") - 20).alias("f"), F.col("v").alias("w"))
    k = F.col("f") - 2
    g = F.pow(F.sin(F.lit(3.141592653589793) / 2 * k / 4), 2)
    return x.filter("f between 2 and 21").join(b, ["user_id", "f"]).select("user_id", k.alias("k"), r6(F.when(k < 5, g * F.col("v") + (1 - g) * F.col("w")).otherwise(F.col("v"))).alias("v"))


@query(f"with {FRAMES}, p as (select distinct user_id, unnest(range(0, 20)) pos from fr) select p.user_id, pos, v from p join fr on fr.user_id = p.user_id and fr.f = (pos + 3) % 7")
def win_cyclic_shift(s, d):
    """A loop of seven frames turned by three and repeated to twenty."""
    x = frames(s, d)
    p = x.select("user_id").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint")))).withColumn("f", F.pmod(F.col("pos") + 3, F.lit(7)))
    return p.join(x, ["user_id", "f"]).select("user_id", "pos", "v")


@query("with p as (select l_orderkey, l_linenumber * 3 + unnest(range(0, cast(l_quantity as bigint) % 10 + 1)) pos, l_discount x from lineitem) select l_orderkey, cast(pos as bigint) as pos, round(sum(x), 6) as v, cast(count(*) as bigint) as n from p group by 1, 2")
def agg_overlap_add(s, d):
    """Pieces laid at offsets on one track; where they overlap they add up."""
    t = table(s, d, "lineitem")
    at = (F.col("l_linenumber") * 3).cast("bigint")
    p = t.select("l_orderkey", F.explode(F.sequence(at, at + F.col("l_quantity").cast("bigint") % 10)).alias("pos"), F.col("l_discount").alias("x"))
    return p.groupBy("l_orderkey", "pos").agg(r6(F.sum("x")).alias("v"), F.count(F.lit(1)).alias("n"))


@query(f"""with {FRAMES}, a as (select user_id, f, max(v) over (partition by user_id order by f rows between 1 preceding and 1 following) x from fr), b as (select user_id, f, avg(x) over (partition by user_id order by f rows between 1 preceding and 1 following) > 60 s from a),
c as (select user_id, f, max(s::int) over (partition by user_id order by f rows between 6 preceding and 6 following) x from b) select user_id, f, round(avg(x) over (partition by user_id order by f rows between 5 preceding and 5 following), 6) as act from c""")
def win_duck_envelope(s, d):
    """How far music is ducked: moving maximum and mean, a threshold, then a hold and a smoothing."""
    o = W.partitionBy("user_id").orderBy("f")
    x = frames(s, d).withColumn("x", F.max("v").over(o.rowsBetween(-1, 1)))
    x = x.withColumn("s", (F.avg("x").over(o.rowsBetween(-1, 1)) > 60).cast("int"))
    x = x.withColumn("h", F.max("s").over(o.rowsBetween(-6, 6)))
    return x.select("user_id", "f", r6(F.avg("h").over(o.rowsBetween(-5, 5))).alias("act"))


_GAIN = """case when f < 5 then 2.0 * (f / 4.0) * (f / 4.0) * (3 - 2 * f / 4.0) when f < 15 then 2.0 * pow(0.5, ((f - 5) / 9.0) * ((f - 5) / 9.0) * (3 - 2 * (f - 5) / 9.0)) when f < 25 then pow(10.0, 10.0 * case when f < 20 then ((f - 15) / 4.0) * ((f - 15) / 4.0) * (3 - 2 * (f - 15) / 4.0) else 1 - ((f - 20) / 4.0) * ((f - 20) / 4.0) * (3 - 2 * (f - 20) / 4.0) end / 20)
when f < 40 then pow(10.0, (-7.0 * least(1.0, v / 200)) / 20) when f < 50 then 1.0 * pow(3.0, ((f - 40) / 9.0) * ((f - 40) / 9.0) * (3 - 2 * (f - 40) / 9.0)) when f < 55 then 3.0 * (1 - ((f - 50) / 4.0) * ((f - 50) / 4.0) * (3 - 2 * (f - 50) / 4.0)) else 0.0 end"""


@query(f"with {FRAMES} select user_id, f, round({_GAIN}, 6)::double as gain from fr")
def win_gain_curve(s, d):
    """Gain of a bed: it fades in as a song fades out (to 2), settles to 1, rises by 10 dB and back while nobody speaks, is ducked by the level, swells
    to 3 and hands over to the next song."""
    f = F.col("f")
    st = lambda a, n: N.smoothstep((f - a) / float(n - 1))
    swell = F.when(f < 20, st(15, 5)).otherwise(1 - st(20, 5))
    g = (
        F.when(f < 5, 2.0 * st(0, 5)).when(f < 15, 2.0 * F.pow(F.lit(0.5), st(5, 10))).when(f < 25, N.db_gain(10.0 * swell))
        .when(f < 40, N.db_gain(-7.0 * F.least(F.lit(1.0), F.col("v") / 200))).when(f < 50, F.pow(F.lit(3.0), st(40, 10))).when(f < 55, 3.0 * (1 - st(50, 5))).otherwise(0.0)
    )
    return frames(s, d).select("user_id", "f", r6(g).alias("gain"))
