import random
from collections import Counter, defaultdict

from strophe.llm import mixing, packing, tokens


def check(h, c):
    out, bins = packing.plan(h, c)
    fill, ranks = Counter(), defaultdict(list)
    for s, r0, n, b0, q in out:
        for i in range(n):
            fill[b0 + i // q] += s
            ranks[s].append(r0 + i)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in h.items() if n}
    assert all(v <= c for v in fill.values()) and len(fill) == bins
    return bins


def test_plan():
    r = random.Random(1)
    for _ in range(400):
        c = r.choice([1, 2, 3, 7, 30, 100])
        h = Counter()
        for _ in range(r.randint(0, 50)):
            h[r.randint(1, c)] += r.choice([1, 1, 3, 40])
        bins = check(h, c)
        total = sum(s * n for s, n in h.items())
        assert bins <= 1.5 * -(-total // c) + 2


def test_plan_length_does_not_follow_the_items():
    h = {s: 10**9 + s for s in range(1, 101)}
    assert len(packing.plan(h, 100)[0]) < 2000


def test_pack(spark):
    sizes = [(i, [0, 1, 5, 6, 10, 23, 4, 4][i % 8]) for i in range(160)]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint")
    packs = spark.createDataFrame([("p", 10), ("one", 1), ("none", None), ("bad", 0)], "pack_name string, capacity_tokens int")
    rows = packing.pack(df, packs).collect()
    cap = {"p": 10, "one": 1}
    fill, got, parts = Counter(), Counter(), Counter()
    for r in rows:
        fill[r.pack_name, r.bin_id] += r.tokens
        got[r.pack_name, r.doc_id] += r.tokens
        parts[r.pack_name, r.doc_id] += 1
    assert {p for p, _ in fill} == {"p", "one"}
    assert all(n <= cap[p] for (p, _), n in fill.items())
    assert all(got[p, i] == n for i, n in sizes for p in cap)
    assert all(parts["p", i] == (1 if n <= 10 else 3) for i, n in sizes)
    assert packing.pack(df.limit(0), packs).count() == 0


def test_mix(spark):
    r = random.Random(2)
    docs = [(i, s, r.randint(1, 900), r.choice([0.1, 0.5, 1.0])) for i, s in enumerate(["a"] * 3000 + ["b"] * 300 + ["c"] * 50 + ["other"] * 40)]
    docs += [(9000, None, 5, 1.0), (9001, "a", 0, 1.0)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint, weight double")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 8), ("missing", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    out, shares = mixing.mix(df, t)
    rows = out.collect()
    assert len(rows) == len({(x.doc_id, x.epoch) for x in rows})
    used = Counter(x.doc_id for x in rows)
    most = {"a": 1, "b": 3, "c": 8}
    src = {d[0]: d[1] for d in docs}
    assert all(n <= most[src[d]] for d, n in used.items())
    got = {x.source: x for x in shares.collect()}
    total = sum(x.tokens for x in rows)
    for s, n in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(got[s].tokens / total - n) < 0.01
    assert got["missing"].tokens == 0
    # whole epochs come first: every document of a source is used as often as another one, but for one time
    for s in most:
        n = [used[d[0]] for d in docs if d[1] == s and d[2] > 0]
        assert max(n) - min(n) <= 1
    assert mixing.mix(df.limit(0), t)[0].count() == 0


def test_weights_draw_better_documents_more_often(spark):
    docs = [(i, "a", 10, 1.0 if i % 2 else 0.1) for i in range(4000)] + [(10_000 + i, "b", 10, 1.0) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint, weight double")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    a = [r.doc_id for r in mixing.mix(df, t)[0].filter("source = 'a'").collect()]
    assert len(a) == 400 and sum(i % 2 for i in a) > 320


def test_tokens(spark):
    assert tokens.count(None) == tokens.count("") == 0
    text = "Über the   harbour,\n\n 1234 " * 3
    e = tokens.encoder()
    assert tokens.count(text) == len(e.encode_ordinary(text)) and e.decode(e.encode_ordinary(text)) == text
    df = spark.createDataFrame([(1, "s", "abc", 7), (2, None, None, 7), (3, "s", "", 7)], "doc_id bigint, source string, text string, tokens int")
    assert sorted((r.doc_id, r.tokens, r.weight > 0) for r in tokens.counted(df, "source", weigh=True).collect())[1:] == [(2, 0, True), (3, 0, True)]


def test_capacity_is_bounded(spark):
    import pytest

    df = spark.createDataFrame([(1, 5)], "doc_id bigint, tokens bigint")
    with pytest.raises(ValueError):
        packing.pack(df, spark.createDataFrame([("p", packing.LARGEST + 1)], "pack_name string, capacity_tokens bigint"))


def test_a_wrong_packing_is_seen(spark):
    sizes = spark.createDataFrame([(1, 6), (2, 6), (3, 4), (4, 12)], "doc_id bigint, tokens bigint")
    packs = spark.createDataFrame([("p", 10)], "pack_name string, capacity_tokens int")
    bad = spark.createDataFrame([("p", "a", 1, 6), ("p", "a", 2, 6), ("p", "b", 3, 2), ("p", "c", 3, 2), ("p", "d", 4, 10)], "pack_name string, bin_id string, doc_id bigint, tokens bigint")
    assert [tuple(r) for r in packing.checked(sizes, bad, packs).collect()] == [("p", 4, 1, 1, 1)]
    good = packing.pack(sizes, packs)
    assert [tuple(r) for r in packing.checked(sizes, good, packs).collect()] == [("p", 4, 0, 0, 0)]


def test_quality_orders_texts():
    prose = ("The flexible rotor is mounted on the bearing and extends along its axis.\nWhen the pressure rises, the valve engages the housing and the motor stops.\n" * 1) + " ".join(f"Sentence {w} tells how {w} parts of it move." for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
    stuffed = "cheap valve cheap hinge valve best cheap valve " * 30
    links = "\n".join(f"https://a.b/{i} | #tag{i}" for i in range(60))
    bullets = "\n".join(f"- item {i}" for i in range(60))
    q = tokens.quality
    assert q(prose) > 0.8 > q(bullets) and q(prose) > q(stuffed) and q(stuffed) > q(links) or q(links) < 0.4
    assert q(None) == q("") == q("   ") == 0.05 and 0.05 <= q("a") <= 1
    assert q(prose * 2) <= q(prose)
