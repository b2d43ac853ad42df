import pytest

from strophe.llm import encoding as E

from .languages import LINES, SIGNS

CLEAN = [
    "Él olvida la luz de la mañana entre las paredes por última vez",
    "Où est passé l'été? Ça, c'est créé à Noël, mon cœur",
    "Nie mogę zapomnieć żółtą lampę w Umadro jeszcze raz",
    "ONA NIESIE ŻÓŁTĄ LAMPĘ",
    "Он забывает разбитое зеркало под мостом",
    "Я ВИЖУ ЖЁЛТУЮ ЛАМПУ",
    "Die Straße über dem Hügel wärmt schöne Mädchen",
    "Não posso te dar o pão, coração",
    "20 °C and © 2020 ♪ — “quoted” … 👩‍🎤 ❤️",
    "break the key in \u0422\u0456rzam",
    "pοche with a Greek letter, Ｆull width, t\xadhis",
]
CASES = [
    ("Él olvida la luz de mañana", "utf-8", "cp1252"), ("Él olvida la mañana, corazón", "utf-8", "latin-1"), ("perché la città è già là", "utf-8", "cp1251"),
    ("Nie mogę zapomnieć łódkę", "utf-8", "cp437"), ("Я помню горькую песню", "utf-8", "mac_roman"), ("Я помню горькую песню", "cp1251", "cp1252"),
    ("Я не могу забыть зелёный холм", "koi8-r", "cp1251"), ("Śni mi się mapę jakbyś tu była", "cp1250", "cp1252"), ("vacía canción última estación", "cp1252", "cp850"),
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_is_no_case(text):
    assert not E.is_garbled(text)
    assert E.restore(text) == (text, True)


@pytest.mark.parametrize("text,real,shown", CASES)
def test_round_trip(text, real, shown):
    bad = text.encode(real).decode(shown)
    assert bad != text and E.is_garbled(bad)
    assert E.restore(f"plain line\n{bad}\nanother") == (f"plain line\n{text}\nanother", True)


def test_decoded_wrongly_twice():
    text = "we don’t know, mañana"
    bad = text.encode().decode("cp1252").encode().decode("cp1252")
    assert E.restore(bad) == (text, True)


def test_one_line_among_good_cyrillic_ones():
    good = "\n".join(["Снова дождь идёт за окном", "Я тебя люблю и жду", "Мы с тобой одни"] * 3)
    line = "Я иду домой"
    bad = line.encode("koi8-r").decode("cp1251")
    assert E.restore(f"{good}\n{bad}") == (f"{good}\n{line}", True)
    assert not E.is_garbled(f"{good}\n{line}") and not E.is_garbled(f"{good}\nЯ ЛЮБЛЮ ТЕБЯ, МОСКВА")


def test_lost_bytes_are_found_but_not_whole():
    assert E.restore("Br�cke") == ("Br�cke", False)


def test_escapes():
    assert E.restore("Caf&eacute; ma&#241;ana") == ("Café mañana", True)
    assert not E.is_garbled("rock & roll; R&B 100%")


def test_nothing_to_read():
    assert not E.is_garbled(None) and not E.is_garbled("")
    assert E.restore(None) == (None, True)


def test_very_long():
    text = "\n".join(["Él olvida la mañana"] * 20_000)
    bad = text + "\n" + "mañana".encode().decode("cp1252")
    assert E.restore(bad) == (text + "\nmañana", True)


def test_found(spark):
    bad = "maÃ±ana"
    rows = [(1, bad, None, "x"), (1, bad, None, "y"), (2, None, bad, "x"), (3, "", "", "x"), (4, "mañana", "plain", "x"), (None, bad, bad, "x")]
    df = spark.createDataFrame(rows, "lrclib_id bigint, plainlyrics string, syncedlyrics string, field string")
    f = E.found(df, "lrclib_id", ("plainlyrics", "syncedlyrics"))
    assert sorted(map(tuple, f.collect())) == [(1, "plainlyrics"), (2, "syncedlyrics")]
    r = E.restored(df, "lrclib_id", ("plainlyrics", "syncedlyrics"))
    assert sorted(map(tuple, r.collect())) == [(1, "plainlyrics", "mañana", True), (2, "syncedlyrics", "mañana", True)]
    assert E.found(df.limit(0), "lrclib_id", ("plainlyrics", "syncedlyrics")).count() == 0


def test_many_layers():
    bad = text = "Él olvida la mañana"
    for _ in range(6):
        bad = bad.encode().decode("latin-1")
    assert E.restore(bad) == (text, True)


ALL = [line for lines in LINES.values() for line in lines]


@pytest.mark.parametrize("text", [*ALL, *SIGNS, *("\n".join(x) for x in LINES.values())])
def test_correct_text_of_any_language_is_no_case(text):
    assert not E.is_garbled(text) and E.restore(text) == (text, True)


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp1251", "cp1253", "cp1254", "mac_roman", "cp437", "cp850"])
def test_utf8_shown_in_a_page_in_any_language(page):
    shown = E._decoder(page)
    right = 0
    for text in ALL:
        bad = "".join(chr(b) if b < 128 else shown[b] for b in text.encode())
        assert E.is_garbled(bad) or text.isascii(), text
        right += E.restore(bad) == (text, True)
    assert right >= 0.9 * len(ALL)  # two pages show some letters alike


def test_the_search_decides(monkeypatch):
    """Without steps nothing is reachable, and nothing but lost bytes is found."""
    monkeypatch.setattr(E, "steps", lambda *a: iter(()))
    E._line.cache_clear()
    assert not E.is_garbled("maÃ±ana corazÃ³n") and E.is_garbled("Br\ufffdcke")
    E._line.cache_clear()


def test_letters_foreign_to_the_mended_lines():
    text = "Quizás no puedo más\nEl último tren está, corazón\nmil pájaros"
    bad = text.encode("cp1252").decode("cp850")
    assert E.restore(bad)[0] == text


def test_one_shown_letter_in_a_word_of_two_scripts():
    assert E.restore("TГє escondes tu nombre") == ("Tú escondes tu nombre", True)
