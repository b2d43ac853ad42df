from pyspark.sql import functions as F

from strophe.config import Settings
from strophe.plans import providers, stages
from strophe.streaming import sessions


def test_stage_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    a = dict(root=str(tmp_path), name="s", inputs={"t": 1}, build=build)
    for gap in (1, 1, 2):
        assert stages.stage(spark, settings={"gap": gap}, **a).count() == 5
    assert len(calls) == 2
    stages.stage(spark, settings={"gap": 1}, force=True, **a)
    assert len(calls) == 3
    assert stages.stage_key({"a": 1, "b": 2}, {}) == stages.stage_key({"b": 2, "a": 1}, {})


def test_known_texts_are_not_asked_for(spark):
    lines = spark.createDataFrame([("One two",), ("one two!",), ("three",), (None,), ("!?",)], "text string")
    none = spark.createDataFrame([], "key string, translation string")
    first = providers.translate(lines, none, "fr")
    assert {r.key: r.translation for r in first.collect()} == {"onetwo": "[fr] One two", "three": "[fr] three"}

    def refuse(texts, lang):
        raise AssertionError(texts)

    again = providers.translate(lines, spark.createDataFrame(first.collect()), "fr", refuse)
    assert again.count() == 2


def test_settings():
    import argparse
    from dataclasses import fields

    from strophe.config import arguments

    assert Settings.of({"max_lines": 6, "lead_in": None, "unknown": 1}) == Settings(max_lines=6)
    assert len(fields(Settings)) == 59
    p = argparse.ArgumentParser()
    arguments(p)
    assert Settings.of(vars(p.parse_args(["--max-lines", "5", "--loop-start", "1.5", "--video"]))) == Settings(max_lines=5, loop_start=1.5, video=True)


def test_retries():
    import pytest

    waits, left = [], [None, 429, 503]

    def busy():
        if left:
            raise providers.Unavailable(left.pop(0))
        return "ok"

    assert providers.retrying(busy, sleep=waits.append)() == "ok" and waits == [2.0, 4.0, 6.0]
    left[:] = [500] * 9
    with pytest.raises(providers.Unavailable):
        providers.retrying(busy, sleep=waits.append)()
    assert len(left) == 5
    left[:] = [404]
    with pytest.raises(providers.Unavailable):
        providers.retrying(busy, sleep=waits.append)()
    tries = []
    with pytest.raises(ValueError):
        providers.complete(lambda t, g: tries.append(1) or ["x", " "])(["a", "b"], "fr")
    assert len(tries) == 3


def test_structure():
    answers = [[("a", [0, 2])], [("b", [1]), ("a", [0])], [("c", [])]]
    assert providers.structure(2, lambda: answers.pop(0)) == [("a", [0]), ("b", [1])]
    assert providers.structure(2, lambda: [("a", [0])]) is None


def test_speech_and_lookups_ask_once(spark):
    t = spark.createDataFrame([("one",), ("one",), ("two",), (None,)], "text string")
    none = spark.createDataFrame([], "key string, audio binary")
    first = providers.speak(t, none, "m", "v", lambda x: x.encode()).collect()
    assert sorted((bytes(r.audio), r.characters, r.asked) for r in first) == [(b"one", 3, True), (b"two", 3, True)]
    again = providers.speak(t, spark.createDataFrame([(r.key, r.audio) for r in first], "key string, audio binary"), "m", "v", lambda x: 1 / 0)
    assert {r.asked for r in again.collect()} == {False}
    songs = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), ("", "x"), (None, "y")], "title string, artist string")
    known = spark.createDataFrame([("b", "x", "known")], "title string, artist string, answer string")
    assert sorted((r.title, r.answer) for r in providers.look_up(songs, known, lambda t, a: f"{t}/{a}").collect()) == [("a", "a/None"), ("b", "known")]


def test_stream_equals_batch_but_for_open_sessions(spark, tmp_path, data):
    src = f"{tmp_path}/in"
    spark.read.parquet(f"{data}/events.parquet").repartition(3).write.parquet(src)
    sessions.run(sessions.sessions(sessions.read(spark, src)), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    e = spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    want = {tuple(r) for r in sessions.sessions(e).collect()}
    assert got <= want and len(want - got) <= 60
    sessions.run(sessions.sessions(sessions.read(spark, src)), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got)


def test_lines_of_a_stream_equal_those_of_the_table(spark, tmp_path, data):
    import os

    from strophe.queries.base import words
    from strophe.queries.lines import win_transcript_lines
    from strophe.streaming import folds

    w = words(spark, data).toPandas().sort_values(["tid", "pos"])
    src = f"{tmp_path}/words"
    os.makedirs(src)
    third = w.groupby("tid").cumcount() * 3 // w.groupby("tid")["pos"].transform("size")
    for k in range(3):
        # the words of the first part come again with the second
        w[(third == k) | ((third == 0) & (k == 1))].to_parquet(f"{src}/{k}.parquet", coerce_timestamps="us")
        os.utime(f"{src}/{k}.parquet", (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema("tid bigint, pos bigint, text string, s double, e double").option("maxFilesPerTrigger", 1).parquet(src)
    q = folds.transcript_lines(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.tid, r.i): (round(r.start, 6), round(r.end, 6), r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.tid, r.i): (r.start, r.end, r.n) for r in win_transcript_lines(spark, data).collect()}
    last = {t: max(i for u, i in want if u == t) for t, _ in want}
    assert got == {k: v for k, v in want.items() if k[1] != last[k[0]]} and len(got) > 100


def test_workspace():
    from strophe.plans import workspace as w

    assert w.home("/r/", "song", "lyrics", "en", "fr") == w.home("/r", "song", "lyrics", "en", "de") == "/r/song"
    assert w.home("/r", "song", "plan", "en", "fr") == "/r/song/en-fr" and w.home("/r", "song", "lyrics", "en", "fr", "/x/") == "/x"
