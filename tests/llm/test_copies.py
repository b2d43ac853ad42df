from strophe.llm import copies

SCHEMA = "lrclib_id bigint, plainlyrics string, syncedlyrics string, h1 string, head int"
S = "[ti:A b]\n[ar:C]\n[00:01.20] one\n[00:02.00] two"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, copies.found(df).collect())), dict(map(tuple, copies.counts(df).collect()))


def test_formats(spark):
    rows = [
        (5, "One\nTwo", S), (3, "ONE / two!!", "[AR:c]\r\n[TI:a  b]\r\n\r\n[00:01:20] One\r\n[00:02:00] Two"), (3, "ONE / two!!", "[AR:c]\r\n[TI:a  b]\r\n\r\n[00:01:20] One\r\n[00:02:00] Two"),
        (7, "one two", "[ti:A b]\n[ar:C]\n[00:02.00] two\n[00:01.20] one"), (8, "one two three", S), (9, None, ""), (10, "!?", None), (11, "", S), (12, None, S),
        (13, "one two", "[ti:A b]\n[ti:A b]\n[ar:C]\n[00:01.20] one\n[00:02.00] two"),
    ]
    pairs, n = run(spark, rows)
    assert pairs == [(3, 5), (11, 12)]
    assert n == {3: 2, 7: 1, 8: 1, 11: 2, 13: 1}


def test_hot_group_and_long_text(spark):
    long = "word " * 100_000
    pairs, n = run(spark, [(i, "same text", None) for i in range(500)] + [(1000, long, None), (1001, long.upper(), None)])
    assert n[0] == 500 and (0, 499) in pairs and (1000, 1001) in pairs and len(pairs) == 500


def test_empty(spark):
    assert run(spark, []) == ([], {})


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = copies._rows
    monkeypatch.setattr(copies, "_rows", lambda f, key: real(f, key).withColumns({"h1": F.lit(1), "h2": F.lit(2)}))
    pairs, n = run(spark, [(1, "a", None), (2, "b", None), (3, "A", None), (4, "B!", None), (5, "c", None)])
    assert pairs == [(1, 3), (2, 4)] and n == {1: 2, 2: 2, 5: 1}


def test_long_headers_and_their_multiplicities(spark):
    many = [f"[k:{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}]" for i in range(90)]
    pairs, n = run(spark, [(1, "t", "\n".join(many)), (2, "t", "\n".join(many[::-1])), (3, "t", "\n".join(many + many[:1])), (4, "t", "\n".join([*many[1:], many[1]]))])
    assert pairs == [(1, 2)] and n == {1: 2, 3: 1, 4: 1}
