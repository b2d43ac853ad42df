import pandas as pd
import pytest

from strophe.llm import pairs


@pytest.fixture(scope="module")
def model(data):
    import glob

    d = data.replace("sf0.001", "sf0.01")
    l = pd.read_parquet(glob.glob(f"{d}/plan_lines.parquet")[0]).drop_duplicates("line_id")
    p = pd.read_parquet(f"{d}/plan_docs.parquet")[["plan_id", "target_lang"]]
    x = l.merge(p, on="plan_id").dropna(subset=["text", "translation"])
    return pairs.Model.fit(zip(x.text, x.translation, x.target_lang))


@pytest.mark.parametrize(
    "text,tr,lang,want",
    [
        ("Ela pinta o tambor perto do fogo!", "She paints the drum near the fire", "en", None),
        ("Ela pinta o tambor perto do fogo!", None, "en", "empty"),
        ("Ela pinta o tambor perto do fogo!", " …—", "en", "empty"),
        ("Ela pinta o tambor", "“Ela pinta o tambor”: I'm sorry, but I can't help with this request.", "en", "refusal"),
        ("Je vois la rue déserte", "Niestety nie jestem w stanie przetłumaczyć tego wersu.", "en", "refusal"),
        ("Lo siento, no puedo olvidar tu promesa", "I'm sorry, I can't forget your promise", "en", None),
        ("They count her laughter in Tashrip.", "they count her laughter Tashrip", "de", "copy"),
        ("They chase the key.", "“They chase the key”", "fr", "copy"),
        ("I keep a little fire above the harbour?", "Je garde un petit feu au-dessus du port?", "pt", "other_language"),
        ("Tú rompes la llave en Golfen bajo la nieve", "You break the", "en", "truncated"),
        ("La la la la", "La la la la", "en", None),
        ("Oh oh oh", "", "en", "empty"),
        (None, "She paints", "en", None),
        ("Ela pinta o tambor", "She paints the drum", None, None),
    ],
)
def test_defect(model, text, tr, lang, want):
    assert pairs.defect(model, text, tr, lang) == want


def test_refusal_grammar():
    """Not done and what was asked, in one sentence; either alone is a lyric."""
    for t in (
        "Я не могу показать этот текст", "Leider kann ich bei dieser Anfrage nicht helfen", "Diese Anfrage kann ich nicht erfüllen", "Tej prośby nie mogę spełnić",
        "As a language model I have limits", "Come modello linguistico mi fermo", "I must decline to process this content", "No puedo ayudar con esta solicitud",
    ):
        assert pairs.refuses(t), t
    for t in ("I can't forget your request", "You can read my text. I cannot sleep", "No puedo olvidar tu nombre", "Translate me to the sky", "Ai, que saudade", "I can't. The lyrics are mine", ""):
        assert pairs.refuses(t) == (t == "I can't forget your request"), t


def test_quick_test_passes_all_the_grammar_knows():
    for k in "AOS":
        for w in pairs.TERMINALS[k].split():
            assert pairs._ASKED.search(w.rstrip("*"))


def planted(spark_free_dir):
    d = spark_free_dir.replace("sf0.001", "sf0.01")
    l = pd.read_parquet(f"{d}/plan_lines.parquet").drop_duplicates("line_id")
    x = l.merge(pd.read_parquet(f"{d}/plan_docs.parquet")[["plan_id", "target_lang"]].drop_duplicates("plan_id"), on="plan_id")
    one = lambda v: v if isinstance(v, str) else None
    return [(one(t), one(r), one(g)) for t, r, g in zip(x.text, x.translation, x.target_lang)]


@pytest.mark.parametrize("name,off,kind", [("parse", lambda *a: [], "truncated"), ("tiles", lambda a, b: [], "copy"), ("other_script", lambda *a: False, None), ("refuses", lambda t: False, "refusal")])
def test_each_method_decides(monkeypatch, model, data, name, off, kind):
    """Without the parser, the tiling or the grammar the defects they decide are not found in the test tables."""
    rows = planted(data)
    with_it = [pairs.defect(model, *r) for r in rows]
    monkeypatch.setattr(pairs, name, off)
    without = [pairs.defect(model, *r) for r in rows]
    if kind:
        assert with_it.count(kind) > 20 and without.count(kind) == 0
    else:
        assert pairs.defect(model, "She paints the drum", "彼女は太鼓を塗る", "fr") != "other_language"


def test_parse_of_a_pair(model):
    of = lambda text, tr, lang, share: pairs.parse(model, text, pairs.words(text), tr, pairs.words(tr), lang, share)
    assert "mark" in of("She paints the drum near the fire", "Elle peint (le tambour", "fr", 0.6)
    assert "line" in of("She paints the drum near the fire", "Elle", "fr", 0.1)
    assert "name" in of("We live in Golfen", "Nous vivons", "fr", 0.6)
    assert "phrase" in of("You break the key", "Tu romps la", "fr", 0.6)


def test_parser():
    assert pairs.open_marks("a (b [c] “d”") == ["("]
    assert pairs.open_marks('"x" ```y``` {z}') == []
    assert pairs.open_marks("“never closed") == ["“"]


def test_parser_of_markup_and_lists():
    assert pairs.open_marks("<b>x</b> **y** _z_ a_b 2 * 3<br>") == []
    assert pairs.open_marks("<i>never closed") == ["<i>"] and pairs.open_marks("never <i") == ["<"]
    assert pairs.open_marks("**never closed") == ["**"]
    assert pairs.open_marks("- one\n- two") == [] and pairs.open_marks("1. one\n2.") == ["2."]
    assert pairs.open_marks("* one (two\n* ") == ["(", "*"]


@pytest.mark.parametrize(
    "text,tr,lang,want",
    [
        ("She paints the drum near the fire", "彼女は火のそばで太鼓を塗る", "fr", "other_language"),
        ("She paints the drum near the fire", "Она красит барабан у костра", "ja", "other_language"),
        ("She paints the drum near the fire", "彼女は火のそばで太鼓を塗る", "ja", None),
        ("Golfen Tashrip!", "Golfen Tashrip и", "ru", None),
    ],
)
def test_script(model, text, tr, lang, want):
    got = pairs.defect(model, text, tr, lang)
    assert got == want or want is None and got != "other_language"


def test_tiles():
    assert pairs.tiles("a b c d".split(), "c d a b".split()) == [2, 2]
    assert pairs.tiles("a a b".split(), "a b b".split()) == [2]
    assert pairs.tiles([], ["a"]) == [] and pairs.tiles(["a"], []) == []


def test_copied():
    a = "we chase the yellow lamp".split()
    assert pairs.copied(a, a) and pairs.copied(a, a[1:]) and pairs.copied(a, a[:2] + a[3:])
    assert not pairs.copied(a, a[::-1]) and not pairs.copied(a, a[:2]) and not pairs.copied(a, ["you", *a[1:]])
    assert not pairs.copied(["a"], []) and pairs.copied(["a"], ["a"])


def test_found(spark, model):
    lines = spark.createDataFrame(
        [(1, "p", "Ela pinta", None, "x"), (1, "p", "Ela pinta", None, "x"), (2, "q", "They chase the key", "They chase the key", "x"), (3, None, "a", "", "x"), (None, "p", "a", "", "x")],
        "line_id bigint, plan_id string, text string, translation string, defect string",
    )
    plans = spark.createDataFrame([("p", "en"), ("p", "en")], "plan_id string, target_lang string")
    assert sorted(map(tuple, pairs.found(lines, plans, model).collect())) == [(1, "empty"), (2, "copy"), (3, "empty")]
    assert pairs.found(lines.limit(0), plans.limit(0)).count() == 0


def test_fit_counts_all_lines(spark, data):
    """The model from a table of more than 24,000 lines is that of all its rows, whatever their ids."""
    d = data.replace("sf0.001", "sf0.01")
    l = pd.read_parquet(f"{d}/plan_lines.parquet")[["plan_id", "text", "translation"]]
    p = pd.read_parquet(f"{d}/plan_docs.parquet")[["plan_id", "target_lang"]].drop_duplicates("plan_id")
    x = pd.concat([l.assign(line_id=range(k * len(l), (k + 1) * len(l)), text=l.text + f" tale{k % 3}") for k in range(6)])
    own = x.merge(p, on="plan_id").dropna(subset=["text", "translation", "target_lang"])
    want = pairs.Model.fit([r for r in zip(own.text, own.translation, own.target_lang) if len(r[0]) >= 12 and len(r[1]) >= 12])
    x = x.astype(object).where(x.notna(), None)
    lines = spark.createDataFrame(x[["line_id", "plan_id", "text", "translation"]], "line_id bigint, plan_id string, text string, translation string")
    got = pairs.fit(lines, spark.createDataFrame(p))
    assert len(own) > 24_000 and got.profiles.ranks == want.profiles.ranks and got.profiles.words == want.profiles.words
    assert (got.lexicon, got.inner, got.ratio, got.vocabulary) == (want.lexicon, want.inner, want.ratio, want.vocabulary)
    assert len(got.lexicon) > 100 and len(got.ratio) > 10
    empty = pairs.fit(lines.limit(0), spark.createDataFrame(p))
    assert empty.lexicon == {} and empty.profiles.langs == []


@pytest.mark.parametrize("text", ["", "l'amour d’été ‘x’ rock'5 a''b", "été नमस्ते ١٢٣ x²½", "𝔘nder 𐐷𐐷 a_b", "It's 3 o'clock 5a 'tis", "ИЙ Ёлка 彼女は太鼓"])
def test_split_and_size_equal_the_patterns(text):
    from strophe.llm import langid

    assert langid.split(text) == langid.WORD.findall(text)
    assert pairs.letters(langid.split(text)) == pairs.size(text)
    assert pairs._ASKED.search(text.lower()) is None or any(map(pairs.asks, pairs.words(text)))


ODD = [
    "", " ", "…", "’", "l'amour d’été", "La la la la", "oh Oh la", "x²½ १२", "彼女は太鼓を塗る", "Golfen Tashrip!", "well-known rock'n’roll ‘x’ y", "𝔘nder 𐐷 a_b\tc\x1cd", "a (b", "I’m sorry, I can't help with this request", None,
]


def batches(rows):
    import pyarrow as pa

    return [pa.array([r[k] for r in rows], pa.string()) for k in range(3)]


def test_words_of_many_texts(model):
    """Words and their places at once are those of each text by itself."""
    from strophe.llm import bulk
    from strophe.llm.langid import split

    w = bulk.Words(**bulk.rated(model.profiles))
    texts = [*ODD, "She paints the drum near the fire", "Ela pinta la la o tambor"] * 2
    t = w.read(batches([(x,) * 3 for x in texts])[0])
    names = list(w._words)
    s, n = bulk.totals(w, t)
    for i, x in enumerate(texts):
        own = split(x or "")
        assert [names[k] for k in t.words[t.row == i]] == own
        assert (s[i].tolist(), n[i]) == model.profiles.totals(own)
        assert [w.strings[w["plain"][k]] for k in t.words[t.row == i]] == pairs.words(x or "")


def test_no_defect_without_doubt(model, data):
    """Of the lines of a table and of odd ones no defect is passed over, and few others are looked at one by one."""
    rows = planted(data)
    odd = [(a, b, g) for a in ODD for b in ODD for g in ("en", "pt", "xx", "", None)]
    doubts = pairs.Doubts(model)
    for some in (rows, odd, rows[::-1]):
        d = doubts(*batches(some))
        assert [pairs.defect(model, *r) if x else None for r, x in zip(some, d)] == [pairs.defect(model, *r) for r in some]
    assert doubts(*batches(rows)).mean() < 0.25
    assert doubts(*batches([])).tolist() == []
