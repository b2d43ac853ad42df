"""Small cases of the shared operators, and closed forms against folds."""

import random

from pyspark.sql import functions as F

from strophe.config import Settings
from strophe.functions import text as T
from strophe.operators import intervals, islands
from strophe.operators import sections as S


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_text(spark):
    assert one(spark, T.norm, "Don’t,") == "don't"
    assert one(spark, T.norm, "Été!") == "été"
    assert one(spark, T.clean_line, "  a (b)   c ") == "a b c"
    assert one(spark, T.slug, "Où es-tu?") == "où-es-tu"
    assert one(spark, T.slug, "??") == "song"
    assert one(spark, T.cap, "été") == "Été"
    assert one(spark, T.cap, None) == ""
    assert one(spark, T.rstrip_punct, "so;:.") == "so"
    lyric = "[ti:x]\n[00:01.20] one\n\n[Chorus 2]\n[00:03] two (x)\nthree"
    assert one(spark, T.parse_lyrics, lyric) == ["one", "two (x)", "three"]
    assert one(spark, T.parse_lyrics, None) == []


def fold(rows):
    """Row by row, carrying the last end; imputed values feed the next row. Starts ahead are looked up once."""
    ahead, x = [], None
    for a, _ in reversed(rows):
        ahead.insert(0, x)
        x = a if a is not None else x
    out, p = [], None
    for (a, b), x in zip(rows, ahead):
        if a is None and p is not None:
            a, b = p + 0.05, x - 0.05 if x is not None and x - p > 0.3 else p + 1.5
        elif a is None and x is not None:
            a, b = max(0.0, x - 1.5), x - 0.05
        p = b if b is not None else p
        out.append((a, a + 0.8 if a is not None and (b is None or b <= a) else b))
    return out


def test_fill_gaps_equals_the_fold(spark):
    r = random.Random(5)
    rows, want = [], {}
    for k in range(60):
        t, item = 0.0, []
        for _ in range(r.randint(1, 14)):
            t += r.choice([0.1, 0.5, 3.0, 8.0])
            item.append((None, None) if r.random() < 0.45 else (t, t + 1.0))
            t += 1.0
        for i, (a, b) in enumerate(fold(item)):
            want[k, i] = (a, b)
        rows += [(k, i, a, b) for i, (a, b) in enumerate(item)]
    df = spark.createDataFrame(rows, "k int, i int, start double, end double")
    for x in islands.fill_gaps(df, "k", ["i"]).collect():
        a, b = want[x.k, x.i]
        assert (a is None) == (x.start is None)
        assert a is None or abs(a - x.start) < 1e-9 and abs(b - x.end) < 1e-9


def test_runs_and_clusters(spark):
    df = spark.createDataFrame([("a", f, f not in (3, 7)) for f in range(9)], "k string, f int, q boolean")
    assert sorted(map(tuple, islands.runs(df, ["k"], "f", F.col("q")).collect())) == [("a", 0, 3), ("a", 4, 7), ("a", 8, 9)]
    hits = spark.createDataFrame([("l", 1.0, 1.3), ("l", 17.0, 17.4), ("l", 17.5, 18.0), ("l", 18.2, 18.4)], "k string, s double, e double")
    assert [tuple(r) for r in islands.best_cluster(hits, ["k"], "s", "e", 2.5).collect()] == [("l", 17.0, 18.4, 3)]
    assert islands.best_cluster(hits.limit(0), ["k"], "s", "e", 2.5).count() == 0


def test_asof(spark):
    left = spark.createDataFrame([("u", t, t) for t in (0, 5, 9, 20)] + [("v", 5, 99)], "k string, t int, id int")
    right = spark.createDataFrame([("u", 5, "x"), ("u", 5, "y"), ("u", 9, "z")], "k string, t int, m string")
    last = {r.id: r.m for r in intervals.asof_last(left, right, "k", "t", ["m"]).collect()}
    assert last == {0: None, 5: "y", 9: "z", 20: "z", 99: None}
    nxt = {r.id: r.m for r in intervals.next_after(left, right, "k", "t", ["m"]).collect()}
    assert nxt == {0: "x", 5: "z", 9: None, 20: None, 99: None}


def test_tiling_covers_without_holes(spark):
    cuts = spark.createDataFrame([("a", t) for t in (0.0, 1.0, 1.03, 1.06, 2.0, 2.0, 5.0)], "k string, t double")
    got = sorted((r.t0, r.t1) for r in intervals.tile(cuts, "k", "t").collect())
    assert got == [(0.0, 1.0), (1.0, 2.0), (2.0, 5.0)]


def track(starts, gaps, told=None, length=2.0):
    return S.Track(starts, [a + length for a in starts], gaps, told or [True] * len(starts))


def test_sections_by_pauses():
    starts = [3.0 * i for i in range(6)] + [60.0, 63.0, 66.0]
    x = track(starts, [1.0, 1.0, 2.5, 1.0, 1.0, 9.0, 1.0, 1.0, 1.0])
    assert S.by_pauses(x, Settings(min_lines=2, max_lines=4)) == [0, 3, 6, 9]
    assert S.by_pauses(track([], [])) == []
    assert S.by_pauses(track([1.0], [5.0])) == [0, 1]


def test_small_sections_go_to_the_nearer_side():
    # four lines, a pause, one line, a shorter pause, four lines
    x = track([float(3 * i) for i in range(9)], [1, 1, 1, 8, 7, 1, 1, 1, 1.0])
    assert S.by_pauses(x, Settings(max_song_seconds=100.0)) == [0, 4, 9]
    # equal pauses: to the left; too long when joined: it stays
    y = track([float(3 * i) for i in range(9)], [1, 1, 1, 8, 8, 1, 1, 1, 1.0])
    assert S.by_pauses(y, Settings(max_song_seconds=100.0)) == [0, 5, 9]
    assert S.by_pauses(y, Settings(max_song_seconds=12.0)) == [0, 4, 5, 9]
    # a section without spoken lines is joined however long that gets
    z = track([float(3 * i) for i in range(9)], [1, 1, 1, 8, 8, 1, 1, 1, 1.0], [True] * 4 + [False] + [True] * 4)
    assert S.by_pauses(z, Settings(max_song_seconds=12.0)) == [0, 5, 9]


def test_sections_hold_every_line_and_obey_the_limits():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 40)
        x = track([2.5 * i for i in range(n)], [r.choice([0.05, 0.1, 0.3, 1.0, 7.0]) for _ in range(n)], [r.random() < 0.8 for _ in range(n)])
        b = S.by_pauses(x)
        assert b[0] == 0 and b[-1] == n and b == sorted(set(b))
        parts = S.shortened(x, list(range(n)), 8)
        assert [i for p in parts for i in p] == list(range(n))
        assert all(x.pause[p[-1]] >= S.PAUSE for p in parts[:-1])


def test_segments_that_run_on_are_joined_and_interjections_left_out():
    x = S.Track([0, 3, 6, 9.0], [2.9, 5, 6.5, 12], [0.05, 2, 2, 2], [True] * 4)
    out = S.by_segments(x, [3, 3, 1, 4], [("v", [0]), ("w", [1]), ("x", [2]), ("y", [3])])
    assert out == [("v & w", [0, 1]), ("y", [3])]
    assert S.covers([("a", [0, 1]), ("b", [2])], 3) and not S.covers([("a", [1, 0])], 2) and not S.covers([("a", [0])], 2) and not S.covers([("a", []), ("b", [0])], 1)


def test_overlap_equals_brute_force(spark):
    r = random.Random(8)
    mk = lambda n, far: [(r.choice(["a", "b", None]), x, x + r.choice([0, 1, 3, 40, far])) for x in (r.randint(-50, 400) for _ in range(n))]
    left, right = mk(60, 300), mk(60, 5000)
    L = spark.createDataFrame([(*x, i) for i, x in enumerate(left)], "k string, a bigint, b bigint, id int")
    R = spark.createDataFrame(right, "k string, a bigint, b bigint")
    got = sorted((x.id, x.ra, x.rb) for x in intervals.overlap(L, R, "k").collect())
    want = sorted((i, max(a, c), min(b, e)) for i, (k, a, b) in enumerate(left) for (q, c, e) in right if k is not None and k == q and a < b and c < e and c < b and e > a)
    assert got == want and len(want) > 100
    assert intervals.overlap(L.limit(0), R, "k").count() == 0


def test_overlap_cuts_no_interval_beyond_the_rows_it_may_meet(spark):
    """One short row has buckets of its own width; a long interval is no more pieces for that."""
    L = spark.createDataFrame([("a", 10**9, 10**9 + 1, 0)], "k string, a bigint, b bigint, id int")
    R = spark.createDataFrame([("a", 0, 10**12), ("a", -5, 10**9), ("a", 10**9 + 1, 10**12)], "k string, a bigint, b bigint")
    assert [(x.id, x.ra, x.rb) for x in intervals.overlap(L, R, "k").collect()] == [(0, 10**9, 10**9 + 1)]


def test_state_at_views_equals_sql(spark, tmp_path):
    """A user with a single view and long intervals, many at once that begin together, redelivered views, and nulls."""
    from datetime import datetime, timedelta

    from strophe.queries import timeline

    from .oracle import connect, rows

    r = random.Random(3)
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    kinds = ["view", "view", "signup", "purchase", "click", "error"]
    ev = [(1, at(50), 1, "view", 0.0), (2, at(0), 1, "click", 1e6), (3, at(1), 1, "purchase", 200.5), (4, at(51), 1, "signup", 3e5)]
    ev += [(r.choice([None, *range(5, 700)]), r.choice([None, *map(at, range(300))]), r.choice([None, 2, 3, 4]), r.choice(kinds), r.choice([None, -3.0, 0.0, 1.0, 7.5, 90.0])) for _ in range(900)]
    spark.createDataFrame(ev, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    got = timeline.join_interval_state(spark, str(tmp_path)).toPandas()
    want = connect(str(tmp_path)).execute(timeline.SQL["join_interval_state"]).df()
    assert rows(got) == rows(want) and len(set(got.state)) == 4


def test_wav(spark, tmp_path):
    import struct
    import wave

    from strophe.sources import formats

    with wave.open(f"{tmp_path}/a.wav", "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(100)
        w.writeframes(b"".join(struct.pack("<hh", 16384, 0) for _ in range(250)))
    (tmp_path / "b.wav").write_bytes(b"no sound")
    c = formats.read_wav(spark, str(tmp_path))
    assert sorted((r.chunk, len(r.left), r.left[0], r.right[0]) for r in c.collect()) == [(0, 100, 0.5, 0.0), (1, 100, 0.5, 0.0), (2, 50, 0.5, 0.0)]
    assert formats.mono(c).first().v[0] == 0.25


def test_lyrics_file(spark, tmp_path):
    from strophe.sources import formats

    (tmp_path / "a.txt").write_text("one\r\ntwo\n\nthree")
    assert [(r.i, r.text) for r in formats.read_lyrics(spark, str(tmp_path)).orderBy("i").collect()] == [(0, "one"), (1, "two"), (2, ""), (3, "three")]
