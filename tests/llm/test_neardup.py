import math
import random
from itertools import combinations

import numpy as np
import regex

from strophe.llm import encoding, golay, neardup

VOCABULARY = [f"w{i}" for i in range(400)]


def test_golay_keys():
    v = np.arange(0, 1 << 23, 9973)
    k = golay.indices(v)
    assert set((k >= 0).sum(1)) == {1, 6}
    for d in (0, 1, 2):
        for flips in list(combinations(range(23), d))[::7]:
            w = v ^ sum(1 << b for b in flips)
            j = golay.indices(w)
            share = ((k[:, :, None] == j[:, None, :]) & (k[:, :, None] >= 0)).any((1, 2))
            assert share.all()


def brute(rows, least=0.6):
    sets = {}
    for i, t in rows:
        if i is None or not t or encoding.is_garbled(t):
            continue
        w = regex.findall(r"[\p{L}\p{N}]+", t.lower())
        s = frozenset(zip(w, w[1:], w[2:]))
        if s:
            sets[i] = s
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "lrclib_id bigint, plainlyrics string, rep int, key string")
    got = list(map(tuple, neardup.pairs(df, "lrclib_id", "plainlyrics", skip=encoding.is_garbled).collect()))
    assert len(got) == len(set(got))
    return set(got)


def test_all_pairs_with_edits(spark):
    r = random.Random(4)
    rows, n = [], 0
    for _ in range(40):
        base = [r.choice(VOCABULARY) for _ in range(r.randint(60, 220))]
        for _ in range(r.randint(1, 5)):
            t = list(base)
            for _ in range(r.randint(0, 8)):
                k = r.randrange(len(t))
                t[k : k + r.choice([0, 1])] = [r.choice(VOCABULARY)] * r.choice([0, 1])
            rows.append((n, " ".join(t)))
            n += 1
    want = brute(rows)
    assert len(want) > 60
    assert run(spark, rows) == want


def test_copies_short_null_and_repeated(spark):
    t = " ".join(VOCABULARY[:50])
    rows = [(i, t if i % 2 else t.upper() + "!") for i in range(40)] + [(3, t), (100, "a b"), (101, "a b"), (102, "a b c"), (103, "A, b. c"), (104, None), (105, ""), (106, "mÃ¡s vacÃ­a canciÃ³n"), (107, "mÃ¡s vacÃ­a canciÃ³n"), (None, t)]
    got = run(spark, rows)
    assert got == set(combinations(range(40), 2)) | {(102, 103)}


def test_very_long(spark):
    r = random.Random(1)
    t = [r.choice(VOCABULARY) for _ in range(60_000)]
    rows = [(1, " ".join(t)), (2, " ".join(t[:50_000])), (3, " ".join(t[30_000:]))]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == set()


def test_recall_on_the_test_data(spark, data):
    from strophe.llm.queries import p3_found

    t = spark.read.parquet(f"{data}/lrclib.parquet").select("lrclib_id", "plainlyrics").dropDuplicates(["lrclib_id"]).collect()
    assert set(map(tuple, p3_found(spark, data).collect())) == brute([tuple(x) for x in t])


def test_sketches_hardly_ever_part_pairs_at_the_threshold():
    """Each place of a pair of similarity 0.6 differs with a probability of 0.4 * 7 / 8."""
    n, p = neardup.PLACES, 0.4 * 7 / 8
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(neardup.APART + 1, n + 1)) < 2e-7


def test_hot_keys_and_classes_are_split(spark, monkeypatch):
    """With blocks of three rows everything is hot: the same pairs, each once."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    r = random.Random(9)
    base = [r.choice(VOCABULARY) for _ in range(80)]
    rows = []
    for n in range(24):
        t = list(base)
        t[r.randrange(80)] = r.choice(VOCABULARY)
        rows += [(3 * n + c, " ".join(t)) for c in range(1 + n % 3)]
    rows += [(1000 + i, " ".join(base)) for i in range(10)]
    want = brute(rows)
    assert len(want) > 500 and run(spark, rows) == want


def test_meeting_of_keys_in_batches():
    """Brute force over any cut of the sorted rows into batches."""
    import pandas as pd

    r = random.Random(3)
    for _ in range(200):
        rows = sorted((r.choice([1, 2, 2, 2, 3, 4, 5]), r.randint(0, 30)) for _ in range(r.randint(0, 40)))
        cuts = sorted(r.sample(range(len(rows) + 1), min(len(rows) + 1, r.randint(0, 5))))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        got = pd.concat([pd.DataFrame({"a": [], "b": [], "key": []}), *neardup.meeting(5)(pd.DataFrame({"key": [k for k, _ in p], "rep": [x for _, x in p]}, dtype="int64") for p in parts)])
        of = {k: [x for y, x in rows if y == k] for k, _ in rows}
        want = {(min(a, b), max(a, b)) for v in of.values() if len(v) <= 5 for a, b in combinations(v, 2) if a != b}
        pairs = got[got.b.notna()]
        assert {(int(a), int(b)) for a, b in zip(pairs.a, pairs.b)} == want
        hot = got[got.b.isna()]
        assert sorted((int(k), int(a)) for k, a in zip(hot.key, hot.a)) == sorted((k, x) for k, v in of.items() if len(v) > 5 for x in v)


def test_links(spark):
    a, b = " ".join(VOCABULARY[:50]), " ".join(VOCABULARY[:48] + ["x", "y"])
    rows = [(5, a), (3, a.upper()), (3, a), (9, b), (11, "a b c d"), (12, None), (13, "a b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "lrclib_id bigint, plainlyrics string, rep int")
    got = sorted(map(tuple, neardup.links(df, "lrclib_id", "plainlyrics").collect()))
    assert got == [(3, 3, 2, 1), (5, 3, 2, 1), (9, 9, 1, 2), (11, 11, 1, 0)]
    assert neardup.links(df.limit(0), "lrclib_id", "plainlyrics").count() == 0


def test_without_golay_keys_nothing_is_found(spark, monkeypatch):
    t = [" ".join(VOCABULARY[:50]), " ".join(VOCABULARY[:49] + ["x"])]
    rows = list(enumerate(t))
    assert run(spark, rows) == {(0, 1)}
    monkeypatch.setattr(golay, "indices", lambda v: np.full((*v.shape, golay.KEYS), -1))
    assert neardup.keys(np.zeros((1, 24), np.int64), np.zeros((1, 24), np.int32))[0].size == 0
