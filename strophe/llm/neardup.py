"""Near-duplicate texts: every pair whose sets of word shingles overlap by a given share.

Texts with the same set of shingles form a class, and classes meet through one representative. Representatives
that share a key are candidates; candidates are verified on their whole texts; verified pairs are expanded to
the members of both classes at the very end, or only counted (:func:`links`).

Keys come from a fingerprint of SEGMENTS times 23 bits, each bit taken from the least word of the text under a hash of
its own. A segment is decoded to the Golay codewords nearby, so texts whose segments differ in a few bits still
share a key of it; errors spread over the segments, so by the pigeonhole principle some segments have few. A
codeword's index has 12 bits only, which would put millions of texts under one key: each segment therefore also
has ANCHORS least shingles of the text, and a key is an index together with the anchors of its segment.
"""

from __future__ import annotations

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay

#: A sketch has PLACES places of three bits, one for each of as many least shingles. Two texts of similarity 0.6 differ in 22 places
#: on average with a deviation of 3.8, texts without common shingles in 56 with 2.6; one in ten million pairs right at 0.6 differs in more than APART.
PLACES, APART = 64, 42
#: Rows of one key, and members of one class, that meet each other in one task; more are split into blocks.
BLOCK = 2_000
#: Segments of the fingerprint, and least shingles that join a segment in its keys.
SEGMENTS, ANCHORS = 24, 3

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_rng = np.random.default_rng(23)
_odd = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BIT, _ANCHOR = _odd(SEGMENTS * golay.BITS), _odd(SEGMENTS * ANCHORS)
_FOLD, _SEGMENT = _odd(ANCHORS), _odd(SEGMENTS)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_hashes: dict[str, int] = {}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def hashed(text: str | None) -> np.ndarray:
    """Hashes of the words of a text in order."""
    if len(_hashes) > 500_000:
        _hashes.clear()
    w = words(text) if text else []
    return np.array([_hashes.get(x) or _hashes.setdefault(x, xxhash.xxh64_intdigest(x) or 1) for x in w], np.uint64)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the distinct runs of k words, sorted; empty for fewer words."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for i in range(k):
        x = (x ^ (h[i : i + n] * _STEP[i % 5])) * _STEP[(i + 1) % 5]
        x ^= x >> np.uint64(29)
    return np.unique(x)


def shingles(text: str | None, k: int = 3) -> np.ndarray:
    return runs(hashed(text), k)


def _least(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The least value of a set under each of many hashes."""
    low = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 1024):
        y = x[i : i + 1024, None] * by
        low = np.minimum(low, y.min(0))
    return low


def fingerprint(h: np.ndarray) -> np.ndarray:
    """SEGMENTS vectors of 23 bits of a set of words."""
    low = _least(np.unique(h), _BIT)
    bit = (low ^ (low >> np.uint64(33))) * _STEP[0] >> np.uint64(63)
    return (bit.reshape(SEGMENTS, golay.BITS).astype(np.int64) << np.arange(golay.BITS)).sum(1)


def folded(anchors: np.ndarray) -> np.ndarray:
    """One number for the anchors of each segment: (n, SEGMENTS * ANCHORS) to (n, SEGMENTS)."""
    n = len(anchors)
    return ((anchors.reshape(n, SEGMENTS, ANCHORS) * _FOLD).sum(2, dtype=np.uint64) ^ _SEGMENT).view(np.int64)


def sketch(anchors: np.ndarray) -> list[np.ndarray]:
    """Three numbers of PLACES bits for each text: the three bits of a place come from one least shingle, so a place differs in
    seven eighths of the cases in which that does."""
    x = anchors[:, :PLACES]
    x = (x ^ (x >> np.uint64(29))) * _STEP[2]
    at = np.arange(PLACES, dtype=np.uint64)
    return [((x >> np.uint64(63 - k) & np.uint64(1)) << at).sum(1, dtype=np.uint64).view(np.int64) for k in range(3)]


def keys(folds: np.ndarray, segments: np.ndarray) -> list[np.ndarray]:
    """The keys of each text, (n, SEGMENTS) folded anchors and vectors: every index near a segment with the anchors of the segment.

    48 bits of a key are enough to tell millions of texts apart, and a quarter less to move.
    """
    index = golay.indices(segments)
    x = (folds.view(np.uint64)[..., None] + index.astype(np.uint64) * _STEP[1]) * _STEP[0]
    x = ((x ^ (x >> np.uint64(31))) * _STEP[3] >> np.uint64(16)).view(np.int64)
    return [v[i >= 0] for v, i in zip(x.reshape(len(x), -1), index.reshape(len(index), -1))]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    n = len(np.intersect1d(a, b, assume_unique=True))
    return n / (len(a) + len(b) - n)


#: Classes a task remembers, to prepare one text of each only.
REMEMBERED = 200_000


def prepared(df: DataFrame, k: int, skip=None) -> DataFrame:
    """(id, c1, c2, s0, s1, s2, folds, segments) of every text (id, text) of at least k words: the name of its set of shingles, its
    sketch, and for each segment its anchors and its vector. Each text is read and hashed once. ``skip`` drops texts.

    Of the texts of one class in one task only the first has more than its name, so copies cost next to nothing.
    """
    import pandas as pd

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            ids, names, own, least, segs = [], [], [], [], []
            for i, t in zip(b["id"], b["text"]):
                if not isinstance(t, str) or (skip is not None and skip(t)):
                    continue
                h = hashed(t)
                s = runs(h, k)
                if len(s):
                    d = xxhash.xxh128_intdigest(s.tobytes())
                    if d not in seen:
                        if len(seen) > REMEMBERED:
                            seen.clear()
                        seen.add(d)
                        own.append(len(ids))
                        least.append(_least(s, _ANCHOR))
                        segs.append(fingerprint(h))
                    ids.append(i)
                    names.append(((d & (1 << 64) - 1) - (1 << 63), (d >> 64) - (1 << 63)))
            if ids:
                out = pd.DataFrame({"id": ids, "c1": [n[0] for n in names], "c2": [n[1] for n in names]})
                full = {c: np.full(len(ids), None, object) for c in ("s0", "s1", "s2", "folds", "segments")}
                if own:
                    a = np.array(least)
                    for c, v in zip(full, (*sketch(a), folded(a), np.array(segs).astype(np.int32))):
                        full[c][own] = [int(x) for x in v] if v.ndim == 1 else list(v)[:]
                yield out.assign(**full)

    return df.mapInPandas(run, "id bigint, c1 bigint, c2 bigint, s0 bigint, s1 bigint, s2 bigint, folds array<bigint>, segments array<int>")


def representatives(made: DataFrame, *cols: str) -> DataFrame:
    """(rep, cols...): the least id of each class with what is prepared of it; partial aggregates, so a class of any size travels as few rows."""
    return made.groupBy("c1", "c2").agg(F.min("id").alias("rep"), *(F.first(c, True).alias(c) for c in cols))


def keyed(first: DataFrame) -> DataFrame:
    """(rep, key): the keys of representatives (rep, folds, segments)."""
    import pandas as pd

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"rep": b["rep"], "key": keys(np.stack(b["folds"]), np.stack(b["segments"]))})

    return first.select("rep", "folds", "segments").mapInPandas(run, "rep bigint, key array<bigint>").select("rep", F.explode("key").alias("key"))


def meeting(block: int):
    """A function over rows (rep, key) in order of key: pairs (a, b) of one key, a < b, and rows (a, null, key) of keys that more than
    ``block`` rows have. Only the rows of one key are held, and of a hot key hardly more than ``block``: from there on its rows are passed through."""
    import pandas as pd

    def flush(k, r):
        """Pairs and hot rows of whole keys; k is sorted."""
        begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[begin, len(k)])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in np.unique(size[(size > 1) & (size <= block)]):
            rows = r[begin[size == n][:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            a.append(rows[:, i].ravel())
            b.append(rows[:, j].ravel())
        a, b = np.concatenate(a), np.concatenate(b)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        yield pd.DataFrame({"a": both[:, 0], "b": pd.array(both[:, 1], "Int64"), "key": pd.array([None] * len(both), "Int64")})
        hot = np.repeat(size > block, size)
        if hot.any():
            yield pd.DataFrame({"a": r[hot], "b": pd.array([None] * int(hot.sum()), "Int64"), "key": pd.array(k[hot], "Int64")})

    def run(batches):
        k, r = np.zeros(0, np.int64), np.zeros(0, np.int64)
        passed = None  # the hot key whose rows are passed through
        for batch in batches:
            nk, nr = batch["key"].to_numpy(np.int64), batch["rep"].to_numpy(np.int64)
            if passed is not None:
                n = int(np.searchsorted(nk, passed, "right")) if len(nk) and nk[0] == passed else 0
                if n:
                    yield pd.DataFrame({"a": nr[:n], "b": pd.array([None] * n, "Int64"), "key": pd.array(nk[:n], "Int64")})
                    nk, nr = nk[n:], nr[n:]
                if len(nk):
                    passed = None
            k, r = np.concatenate([k, nk]), np.concatenate([r, nr])
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1], "left"))
            if last:
                yield from flush(k[:last], r[:last])
                k, r = k[last:], r[last:]
            if len(k) > block:
                passed = k[-1]
                yield from flush(k, r)
                k, r = k[:0], r[:0]
        if len(k):
            yield from flush(k, r)

    return run


def _blocks(n):
    """How many blocks a group of n rows has."""
    return F.ceil(n / BLOCK).cast("int")


def candidates(made: DataFrame) -> DataFrame:
    """(a, b), a < b: representatives that share a key and whose sketches don't differ in too many places, each pair once.

    Keys are moved once. A key of more than BLOCK rows is met in blocks afterwards: a row of its first side goes to one block of the
    key, on the second side to all, so that a key that much of the collection has is split over tasks.
    """
    from ..session import cut

    places = ("s0", "s1", "s2")
    first = representatives(made, "folds", "segments")
    sketches = representatives(made, *places).select("rep", *places)
    of = lambda x: sketches.select(F.col("rep").alias(x), *(F.col(c).alias(f"{x}{c}") for c in places))
    near = lambda df: df.join(of("a"), "a").join(of("b"), "b", "left").filter(F.col("b").isNull() | (F.bit_count(F.expr(" | ".join(f"(a{c} ^ b{c})" for c in places))) <= APART))
    met = keyed(first).repartition("key").sortWithinPartitions("key").mapInPandas(meeting(BLOCK), "a bigint, b bigint, key bigint").distinct()
    # most that meet by chance differ in too many places of their sketches to be worth the sight of their texts
    out = cut(near(met).select("a", "b", "key"))
    hot = out.filter("b is null").select(F.col("a").alias("rep"), "key")
    cold = out.filter("b is not null").select("a", "b")
    if hot.isEmpty():
        return cold
    n = hot.groupBy("key").agg(_blocks(F.count(F.lit(1))).alias("n"))
    at = hot.join(n, "key")
    a = at.select("key", F.col("rep").alias("a"), F.pmod(F.xxhash64("rep"), "n").cast("int").alias("block"))
    b = at.select("key", F.col("rep").alias("b"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    more = a.join(b, ["key", "block"]).filter("a < b").select("a", "b").distinct()
    return cut(cold.unionByName(near(more).select("a", "b")).distinct())


def linked(df: DataFrame, key: str, text: str, k: int, least: float, skip=None) -> tuple[DataFrame, DataFrame]:
    """(members, sure): (rep, id, n) of every compared record with its class and the size of that, and the pairs (a, b) of
    representatives whose texts are as similar as asked."""
    from ..session import cut

    texts = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    made = cut(prepared(texts, k, skip))
    own = made.select("id", "c1", "c2").distinct()
    reps = own.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    members = cut(own.join(reps, ["c1", "c2"]).select("rep", "id", "n"))
    near = candidates(made)
    need = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    told = texts.join(need, "id", "left_semi").dropDuplicates(["id"])

    def verify(batches):
        for x in batches:
            known: dict[int, np.ndarray] = {}

            def of(i, t):
                if i not in known:
                    known[i] = shingles(t, k)
                return known[i]

            ok = [jaccard(of(i, t), of(j, u)) >= least for i, t, j, u in zip(x["a"], x["ta"], x["b"], x["tb"])]
            yield x.loc[np.array(ok, bool), ["a", "b"]]

    ta = told.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    tb = told.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return members, near.join(ta, "a").join(tb, "b").select("a", "ta", "b", "tb").mapInPandas(verify, "a bigint, b bigint")


def pairs(df: DataFrame, key: str, text: str, k: int = 3, least: float = 0.6, skip=None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records whose sets of distinct runs of k words have an intersection of
    at least ``least`` of their union.

    Null texts, texts of fewer than k words and texts ``skip`` holds for are not compared; repeated rows count once. Large classes
    are expanded in blocks.
    """
    members, sure = linked(df, key, text, k, least, skip)
    one = lambda rep, x: members.select(F.col("rep").alias(rep), F.col("id").alias(x), F.pmod(F.xxhash64("id"), _blocks(F.col("n"))).cast("int").alias("block"))
    all_ = lambda rep, x: members.select(F.col("rep").alias(rep), F.col("id").alias(x), F.explode(F.sequence(F.lit(0), _blocks(F.col("n")) - 1)).alias("block"))
    within = one("rep", "x").join(all_("rep", "y"), ["rep", "block"]).filter("x < y").select("x", "y")
    size = members.filter("rep = id").select(F.col("rep").alias("b"), "n")
    left = sure.join(size, "b").join(one("a", "x").drop("block"), "a").select("x", "b", F.pmod(F.xxhash64("x"), _blocks(F.col("n"))).cast("int").alias("block"))
    across = left.join(all_("b", "y"), ["b", "block"]).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def links(df: DataFrame, key: str, text: str, k: int = 3, least: float = 0.6, skip=None) -> DataFrame:
    """(id, rep, copies, links): every compared record with its class, named by the least id in it, the records of the class, and the
    records of other classes it is linked to. No pair of copies is ever made, so this holds for classes of any size."""
    members, sure = linked(df, key, text, k, least, skip)
    size = members.filter("rep = id").select("rep", "n")
    both = sure.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(sure.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    n = both.join(size.select(F.col("rep").alias("other"), "n"), "other").groupBy("rep").agg(F.sum("n").alias("links"))
    return members.join(n, "rep", "left").select("id", "rep", F.col("n").alias("copies"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
