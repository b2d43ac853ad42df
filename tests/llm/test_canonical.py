import random
import unicodedata

import pytest

from strophe.llm import canonical as C

HIT = ["ｆull", "ﬁre", "éte", "t\xadhis", "a​b", "a\xa0b", "bоtter", "pοche", "a‍b", "x️", " "]
MISS = ["plain", "été", "Я помню", "“quoted” — it’s…", "👩‍🎤", "❤️ 🏳️‍🌈", "tab\there\nand line", "Ωμέγα", "1️", "東京タワーです"]


@pytest.mark.parametrize("t", HIT)
def test_hit(spark, t):
    assert _found(spark, [t]) == {0}


def _found(spark, texts):
    v = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "transcript_id bigint, text string")
    l = spark.createDataFrame([], "lrclib_id bigint, plainlyrics string")
    return {r.rec_id for r in C.found(l, v).collect()}


def test_misses(spark):
    assert _found(spark, MISS + [None, ""]) == set()


def test_wrongly_decoded_lyrics_are_left_out(spark):
    l = spark.createDataFrame([(1, "NÃ\xa0o Ã©"), (2, "a\xa0b"), (2, "a\xa0b")], "lrclib_id bigint, plainlyrics string")
    v = spark.createDataFrame([], "transcript_id bigint, text string")
    assert [tuple(r) for r in C.found(l, v).collect()] == [("lrclib", 2)]


@pytest.mark.parametrize("a,b", [("ｆｕｌｌ", "full"), ("ﬁre", "fire"), ("été", "été"), ("t\xadhis​", "this"), ("a\xa0b", "a b"), ("bоtter", "botter"), ("pοche", "poche"),
                                 ("мoгy", "могу"), ("👩‍🎤 ok", "👩‍🎤 ok"), ("it’s… ½ ™", "it’s... ½ TM"), ("don´t", "don´t"), ("\u212b\u2126\u037e", "ÅΩ;"), ("\u0958\u0627\u0653", "\u0915\u093c\u0622"), ("\u1112\u1161\u11ab", "한"), ("ｶﾞ", "ガ"), ("\U0001d400Ⅳ", "AIV"), ("™️", "™️"), (None, None), ("", "")])
def test_canonical(a, b):
    assert C.canonical(a) == b


def test_idempotent_and_equal_to_normalizing_everything():
    r = random.Random(3)
    pool = "abcéñ ﬁｆ̧́̈ зо̆漢"
    for _ in range(2000):
        t = "".join(r.choice(pool) for _ in range(r.randint(0, 14)))
        c = C.canonical(t)
        assert C.canonical(c) == c
        if not set(t) & set("зо"):
            assert unicodedata.normalize("NFC", c) == c


POOL = [
    c for r in ((0x41, 0x250), (0x300, 0x330), (0x370, 0x530), (0x5D0, 0x670), (0x900, 0x980), (0x1100, 0x1200), (0x1E00, 0x2000), (0xAC00, 0xAC40), (0xF900, 0xFA20), (0xFB00, 0xFB50), (0xFF00, 0xFFDD), (0x1D400, 0x1D420))
    for c in map(chr, range(*r)) if unicodedata.category(c) != "Cn"
]


def test_spliced_segments_equal_normalizing_everything():
    """Brute force: the whole text normalized at once."""
    r = random.Random(1)
    kept = C.properties()[2]
    for _ in range(5000):
        t = "".join(r.choice(POOL) for _ in range(r.randint(1, 12)))
        c = C.canonical(t)
        assert C.canonical(c) == c and unicodedata.is_normalized("NFC", c)
        if kept.isdisjoint(t):
            assert C._spliced(t, C.segments(t)) == unicodedata.normalize("NFKC", t)


def test_quick_check_properties():
    """What is not unstable survives next to anything that is not, too."""
    r = random.Random(2)
    no, maybe, _ = C.properties()
    sure = [c for c in POOL if c not in no and c not in maybe]
    for _ in range(5000):
        t = "".join(r.choice(sure) for _ in range(6))
        assert unicodedata.is_normalized("NFKC", t) and C.segments(t) == []


def test_reasons():
    assert [C.reasons(t) for t in ("ｆull", "e\u0301", "a\u200bb", "a\xa0b", "bоtter", "x² ™ …", None, "", "plain")] == [{"form"}, {"accent"}, {"invisible"}, {"blank"}, {"scripts"}, set(), set(), set(), set()]


def test_pattern_agrees_with_reasons(spark):
    """The pattern that lets texts through to the operator misses nothing it would find."""
    r = random.Random(4)
    texts = ["".join(r.choice(POOL + list("ab  ") + list("\u200b\u200d\xa0\xad😀")) for _ in range(r.randint(1, 5))) for _ in range(3000)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    passed = {x.i for x in df.filter(F.col("t").rlike(C.JAVA)).collect()}
    want = {i for i, t in enumerate(texts) if C.reasons(t) - {"scripts"}}
    assert want <= passed


def test_long():
    assert C.canonical("é" * 200_000) == "é" * 200_000
