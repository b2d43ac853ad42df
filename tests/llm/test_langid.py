import pandas as pd
import pytest

from strophe.llm import langid


@pytest.fixture(scope="module")
def tables(data):
    d = data.replace("sf0.001", "sf0.01")
    l = pd.read_parquet(f"{d}/plan_lines.parquet").drop_duplicates("line_id").sort_values("line_id")
    x = l.merge(pd.read_parquet(f"{d}/plan_docs.parquet")[["plan_id", "target_lang"]], on="plan_id").dropna(subset=["translation"])
    return x[x.translation.str.len() >= 20]


@pytest.fixture(scope="module")
def profiles(tables):
    x = tables.iloc[::2]
    return langid.Profiles.fit(zip(x.translation, x.target_lang))


def test_held_out_accuracy(profiles, tables):
    x = tables.iloc[1::2]
    ok = [bool(r) and max(r, key=lambda q: q[1])[0] == g for r, g in zip(map(profiles.runs, x.translation), x.target_lang)]
    # some translations are in another language by design
    assert sum(ok) / len(ok) > 0.93


def test_mixed(profiles):
    t = "They steal the map in the garden and nothing more, they count the silence again. Ils comptent la lumière du matin à la gare comme si tu étais là"
    assert [(l, n >= 8) for l, n, _ in profiles.runs(t)] == [("en", True), ("fr", True)]


def test_names_and_sounds_have_no_language(profiles):
    assert profiles.runs("la la la la na na na") == []
    assert profiles.runs("") == [] and profiles.runs("12 34 !?") == []
    one = profiles.runs("They steal the map la la la in Zelmorpel and they count the silence")
    assert [x[0] for x in one] == ["en"]


def test_distance(profiles):
    d = profiles.distance("Nous avons perdu la lumière du matin dans cette ville")
    assert min(d, key=d.get) == "fr" and profiles.distance("") == {}


def test_the_distance_decides(profiles, monkeypatch):
    """Whatever language the path proposes for a stretch, the least out-of-place distance names it."""
    import numpy as np

    t = "Nous avons perdu la lumière du matin dans cette ville, et personne ne chante plus"
    k = profiles.langs.index("pl")
    monkeypatch.setattr(profiles, "path", lambda pen: np.full(len(pen), k))
    assert [x[0] for x in profiles.runs(t)] == ["fr"]
    monkeypatch.setattr(profiles, "out_of_place", lambda ws: None)
    assert [x[0] for x in profiles.runs(t)] == ["pl"]


def test_confidence(profiles):
    sure = profiles.runs("Nous avons perdu la lumière du matin dans cette ville, et personne ne chante plus")[0]
    assert sure[0] == "fr" and 0.5 < sure[2] <= 1


def test_pieces_equal_the_whole(profiles):
    """A text read in two pieces with the lines around each gives the runs of the whole."""
    en, fr = "they count the silence in the garden and nothing more", "ils comptent la lumière du matin à la gare"
    lines = [en, en, fr, en, fr, fr, en, en] * 3
    whole = profiles.runs("\n".join(lines))
    for cut in range(4, 20):
        a = profiles.runs("\n".join(lines[:cut]), "", "\n".join(lines[cut : cut + langid.BESIDE]))
        b = profiles.runs("\n".join(lines[cut:]), "\n".join(lines[max(0, cut - langid.BESIDE) : cut]), "")
        both = a + b
        if a[-1][0] == b[0][0]:
            both = a[:-1] + [(a[-1][0], a[-1][1] + b[0][1], 0.0)] + b[1:]
        assert [x[:2] for x in both] == [x[:2] for x in whole], cut


def test_documents(spark, profiles):
    en, fr = "they count the silence in the garden and nothing more once again", "ils comptent la lumière du matin à la gare comme si tu étais là"
    v = spark.createDataFrame([(1, en), (1, en), (2, en[:40] + " " + fr), (3, None), (4, "la la")], "transcript_id bigint, text string")
    rows = [("p", 1000 + i, i, fr) for i in range(300)] + [("p", 1, None, en), ("q", 2, None, en), (None, 3, 0, en), ("q", 4, 1, None)]
    lines = spark.createDataFrame(rows, "plan_id string, line_id bigint, i int, text string")
    got = sorted((r.src, r.rec_id, r.lang) for r in langid.documents(v, lines, profiles).collect())
    assert got == [("plan_docs", "p", "fr"), ("plan_docs", "q", "en"), ("scribe_vocals", "1", "en"), ("scribe_vocals", "2", "fr")]
    assert langid.documents(v.limit(0), lines.limit(0), profiles).count() == 0


def test_long(profiles):
    assert [x[:2] for x in profiles.runs("they count the silence in the garden " * 20_000)] == [("en", 140_000)]


def test_found(spark, profiles):
    en, fr = "they count the silence in the garden and nothing more once again", "ils comptent la lumière du matin à la gare comme si tu étais là"
    v = spark.createDataFrame(
        [(1, "eng", en, "k"), (2, "EN-gb", en + " " + fr, "k"), (2, "EN-gb", en + " " + fr, "k"), (3, None, en, "k"), (4, "und", "la la la", "k"), (5, "fr", en, "k"), (6, "en", None, "k"), (7, "", "", "k")],
        "transcript_id bigint, language_code string, text string, label string",
    )
    plans = spark.createDataFrame([("p", "fre"), ("q", "en"), ("r", "??")], "plan_id string, source_lang string")
    # a stretch that only forms over the border of two pieces of a plan
    rows = [("p", 1000 + i, i, "la la la") for i in range(254)] + [("p", 1254, 254, "they count the silence in"), ("p", 1255, 255, "they count"), ("p", 1256, 256, "the silence in the garden"), ("q", 1, 0, en), ("q", 1, 0, en), ("q", 2, None, None)]
    lines = spark.createDataFrame(rows, "plan_id string, line_id bigint, i int, text string")
    codes = spark.createDataFrame([("en", "eng", "eng"), ("fr", "fra", "fre")], "iso1 string, iso3 string, iso2b string")
    got = sorted(map(tuple, langid.found(v, plans, lines, codes, profiles).collect()))
    assert got == [("plan_docs", "p", "en"), ("scribe_vocals", "2", "en"), ("scribe_vocals", "2", "fr"), ("scribe_vocals", "3", "en"), ("scribe_vocals", "5", "en")]
    assert langid.found(v.limit(0), plans.limit(0), lines.limit(0), codes, profiles).count() == 0


def test_fit_counts_all_lines(spark, data):
    """The profiles from a table of more than 16,000 lines are those of all its rows, whatever their ids."""
    d = data.replace("sf0.001", "sf0.01")
    l = pd.read_parquet(f"{d}/plan_lines.parquet")[["plan_id", "translation"]].dropna()
    p = pd.read_parquet(f"{d}/plan_docs.parquet")[["plan_id", "target_lang"]].drop_duplicates("plan_id")
    x = pd.concat([l.assign(line_id=range(k * len(l), (k + 1) * len(l)), translation=l.translation + f" tale{k}") for k in range(6)])
    own = x.merge(p, on="plan_id").dropna(subset=["target_lang"])
    own = own[own.translation.str.len() >= 20]
    want = langid.Profiles.fit(zip(own.translation, own.target_lang), 3 * len(own) / 16_000)
    got = langid.fit(spark.createDataFrame(x), spark.createDataFrame(p))
    assert len(own) > 16_000 and got.ranks == want.ranks and got.words == want.words
    assert langid.fit(spark.createDataFrame(x).limit(0), spark.createDataFrame(p)).langs == []
