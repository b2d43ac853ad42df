"""Language of texts and of stretches in mixed texts by rank-order n-gram profiles.

A profile lists a language's n-grams from the most to the least frequent. The out-of-place distance of a text ranks the
text's own n-grams in the same way and averages how far the two places lie apart; n-grams a profile lacks are as far away as its
length. It names the language of every document and of every stretch. Where a stretch may begin and end is
proposed first: each word by itself gets the place of its n-grams in each profile (on a log scale), and the cheapest path through the
words, with a price for each change of language, cuts the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

import numpy as np
import regex

#: Longest n-gram and length of a profile.
N, TOP = 5, 4000
#: The profiles are fitted on all lines. A known word occurs in KNOWN of so many lines; more lines need it as often in proportion.
PER, KNOWN = 16_000, 3
#: Price of a change of language, in log places.
SWITCH = 7.0
#: Words a stretch needs.
STRETCH = 8
#: How sharply a difference of out-of-place distances (of 0 to 1) tells on the confidence.
SHARP = 12.0
#: A word whose n-grams are this rare on average (log2 places) even in its best profile is a name.
NAME = 7.4
#: Steps of a log place of a word where places are summed.
STEPS = 2.0**24

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’‘ʼ][\p{L}\p{M}]+)*")
_PLAIN = re.compile("[A-Za-z0-9]+(?:'[A-Za-z]+)*")
FAR = re.compile("[\U00010000-\U0010ffff]")


def ranges(p: str) -> str:
    """The characters below 65,536 that a pattern of one character matches, for a class of the faster module."""
    near = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    return "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(f"{p}+", near))


@cache
def _near() -> re.Pattern:
    """WORD for the characters below 65,536, in the faster module."""
    return re.compile(rf"[{ranges(r'[\p{L}\p{M}\p{N}]')}]+(?:['’‘ʼ][{ranges(r'[\p{L}\p{M}]')}]+)*")


def split(text: str) -> list[str]:
    """The words of a text, as WORD finds them."""
    if text.isascii():
        return _PLAIN.findall(text)
    return WORD.findall(text) if FAR.search(text) else _near().findall(text)


# Sounds without meaning.
SOUNDS = frozenset("la na oh ooh oooh ah aah hey mmm mm hmm doo dum da dee uh yeah ya whoa woah wo eh ay hoo sha".split())


def grams(word: str) -> set[str]:
    """The n-grams of a word between blanks."""
    w = f" {word} "
    return {w[i : i + n] for n in range(1, N + 1) for i in range(len(w) - n + 1)} - {" "}


class Places(dict):
    """The log places of words at the beginning of a text, or inside it; none for numbers and names."""

    def __init__(self, profiles: "Profiles", inside: bool):
        super().__init__()
        self.profiles, self.inside = profiles, inside

    def __missing__(self, raw: str) -> tuple[float, ...] | None:
        if len(self) > 200_000:
            self.clear()
        w = raw.lower().replace("’", "'")
        if w[0].isdigit():
            self[raw] = None
            return None
        v, best = self.profiles.word(w)
        name = best > NAME or self.inside and best > NAME - 2.5 and raw[0].isupper()
        # in steps of a power of two, so that sums are exact in any order
        self[raw] = out = tuple((np.round(v * STEPS) / STEPS).tolist()) if w in self.profiles.words or not name else None
        return out


class Profiles:
    """Rank-order profiles of some languages, and the caches to use them fast."""

    def __init__(self, ranks: dict[str, dict[str, int]], words: frozenset[str]):
        self.langs = sorted(ranks)
        self.ranks = ranks
        self.words = words
        m = dict.fromkeys(g for lang in self.langs for g in ranks[lang])
        self._at = {g: i for i, g in enumerate(m)}
        # the last row is that of n-grams no profile has
        self._logs = np.full((len(m) + 1, len(self.langs)), math.log2(TOP + 1))
        for k, lang in enumerate(self.langs):
            for g, r in ranks[lang].items():
                self._logs[self._at[g], k] = math.log2(r + 1)
        self._places = np.full((len(m), len(self.langs)), TOP, np.float64)
        for k, lang in enumerate(self.langs):
            for g, r in ranks[lang].items():
                self._places[self._at[g], k] = r
        self._ids: dict[str, np.ndarray] = {}
        self._zero = np.zeros(len(self.langs))
        self._cache: dict[str, tuple[np.ndarray, float]] = {}
        self._first, self._inside = Places(self, False), Places(self, True)

    @classmethod
    def fit(cls, rows, least: float = 3) -> "Profiles":
        """From (text, language) rows; words in ``least`` rows are known. Texts without words and null languages are skipped."""
        count: dict[str, Counter] = {}
        seen: Counter = Counter()
        for text, lang in rows:
            if text and lang:
                ws = [w.lower() for w in WORD.findall(text)]
                seen.update(set(ws))
                count.setdefault(lang, Counter()).update(ws)
        ranks = {}
        for lang, ws in count.items():
            c: Counter = Counter()
            for w, n in ws.items():
                for g in grams(w):
                    c[g] += n
            top = sorted(c.items(), key=lambda x: (-x[1], x[0]))[:TOP]
            ranks[lang] = {g: i + 1 for i, (g, _) in enumerate(top)}
        return cls(ranks, frozenset(w for w, n in seen.items() if n >= least))

    def word(self, w: str) -> tuple[np.ndarray, float]:
        """(mean log place of the word's n-grams in each profile, the least of them)."""
        hit = self._cache.get(w)
        if hit is None:
            if len(self._cache) > 200_000:
                self._cache.clear()
            at = [self._at.get(x, -1) for x in grams(w)]
            v = self._logs[at].sum(0) / len(at)
            hit = self._cache[w] = (v, float(v.min()))
        return hit

    def totals(self, found: list[str]) -> tuple[list[float], int]:
        """(log places of some words summed for each language, how many of them have a language): tokens() for short texts."""
        if not found:
            return [0.0] * len(self.langs), 0
        if not SOUNDS.isdisjoint(map(str.lower, found)):
            low = [w.lower().replace("’", "'") for w in found]
            silent = [w in SOUNDS and any(x.lower() in SOUNDS for x in (*found[max(0, i - 1) : i], *found[i + 1 : i + 2])) for i, w in enumerate(low)]
            rows = [v for i, w in enumerate(found) if not silent[i] and (v := (self._inside if i else self._first)[w])]
        else:
            rows = [v for v in (self._first[found[0]], *map(self._inside.__getitem__, found[1:])) if v]
        return (list(map(sum, zip(*rows))) if rows else [0.0] * len(self.langs)), len(rows)

    def tokens(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(words, their log places, which of them have a language). Names, sounds and numbers have none."""
        found = split(text)
        low = [w.lower().replace("’", "'") for w in found]
        rows = []
        has = []
        known, word, zero = self.words, self.word, self._zero
        for i, w in enumerate(low):
            if w in SOUNDS and ((i and low[i - 1] in SOUNDS) or (i + 1 < len(low) and low[i + 1] in SOUNDS)) or w[0].isdigit():
                v = zero
            else:
                v, best = word(w)
                if w not in known and (best > NAME or i and best > NAME - 2.5 and found[i][0].isupper()):
                    v = zero
            rows.append(v)
            has.append(v is not zero)
        pen = np.array(rows) if rows else np.zeros((0, len(self.langs)))
        has = np.array(has, bool)
        return low, pen, has

    def path(self, pen: np.ndarray) -> np.ndarray:
        """The language of each word on the cheapest path."""
        n, k = pen.shape
        if not n:
            return np.zeros(0, int)
        best = int(pen.sum(0).argmin())
        gain = np.vstack([np.zeros(k), np.cumsum(pen[:, [best]] - pen, 0)])
        # the most that any run of words gains in another language; below the price nothing changes
        top = (gain - np.minimum.accumulate(gain, 0)).max(0)
        if top.max() <= SWITCH:
            return np.full(n, best)
        cost = pen[0].copy()
        back = np.zeros((n, k), np.int8)
        stay = np.arange(k)
        for i in range(1, n):
            j = int(cost.argmin())
            change = cost[j] + SWITCH < cost
            back[i] = np.where(change, j, stay)
            cost = np.where(change, cost[j] + SWITCH, cost) + pen[i]
        out = np.zeros(n, int)
        out[-1] = int(cost.argmin())
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def ids(self, w: str) -> np.ndarray:
        """Numbers of the word's n-grams that some profile has."""
        hit = self._ids.get(w)
        if hit is None:
            if len(self._ids) > 200_000:
                self._ids.clear()
            hit = self._ids[w] = np.array([self._at[g] for g in grams(w) if g in self._at], np.int64)
        return hit

    def out_of_place(self, words: list[str]) -> np.ndarray | None:
        """The distance of some words to each profile, 0 to 1: their n-grams, of which the TOP most frequent count, are ranked by
        frequency (equals share the mean of their places) and compared with their places in the profile. None without n-grams."""
        own = [self.ids(w) for w in words]
        a = np.concatenate(own) if own else np.zeros(0, np.int64)
        if not len(a):
            return None
        g, n = np.unique(a, return_counts=True)
        _, group, size = np.unique(-n, return_inverse=True, return_counts=True)
        place = (np.cumsum(size) - size + (size + 1) / 2)[group]
        if len(g) > TOP:
            keep = np.argsort(-n, kind="stable")[:TOP]
            g, place = g[keep], place[keep]
        return np.minimum(np.abs(self._places[g] - place[:, None]), TOP).mean(0) / TOP

    def runs(self, text: str, before: str = "", after: str = "") -> list[tuple[str, int, float]]:
        """(language, words that have one, confidence) of each stretch of a text in order.

        ``before`` and ``after`` are the texts around it: they take part in the path, so that a cut near a border falls where it
        would in the whole, but their words are not counted. The language of a stretch is the one at the least out-of-place distance; neighbours
        of one language are one stretch.
        """
        ws, pen, has = self.tokens(text)
        parts = [self.tokens(before), (ws, pen, has), self.tokens(after)]
        own = [p[h] for _, p, h in parts]
        way = self.path(np.concatenate(own))[len(own[0]) : len(own[0]) + len(own[1])]
        words = [w for w, h in zip(ws, has) if h]
        out: list[tuple[str, int, int, np.ndarray | None]] = []
        if len(way):
            cuts = np.r_[0, np.flatnonzero(np.diff(way)) + 1, len(way)]
            for a, b in zip(cuts, cuts[1:]):
                d = self.out_of_place(words[a:b])
                lang = self.langs[int(way[a] if d is None else d.argmin())]
                if out and out[-1][0] == lang:
                    a = out.pop()[1]
                    d = self.out_of_place(words[a:b])
                out.append((lang, int(a), int(b), d))
        return [(lang, b - a, confidence(d, self.langs.index(lang))) for lang, a, b, d in out]

    def distance(self, text: str) -> dict[str, float]:
        """The out-of-place distance of a whole text to every profile, 0 to 1; empty for no words with a language."""
        ws, _, has = self.tokens(text)
        d = self.out_of_place([w for w, h in zip(ws, has) if h])
        return {} if d is None else dict(zip(self.langs, d.tolist()))


def confidence(d: np.ndarray | None, k: int) -> float:
    """Share of language k when each language weighs by how much farther than k it is out of place."""
    return 0.0 if d is None else round(float(1 / np.exp(np.clip(SHARP * (d[k] - d), -50, 50)).sum()), 4)


_FITTED: dict[int, Profiles] = {}


def unpack(key: int, ranks, words) -> Profiles:
    """Profiles in a Python worker, built once."""
    if key not in _FITTED:
        _FITTED.clear()
        _FITTED[key] = Profiles(ranks, words)
    return _FITTED[key]


#: Entries a task counts before it hands them on.
HELD = 400_000


def summed(batches, add, columns: list[str]):
    """Counts of a whole task: ``add(batch, counts)`` adds up rows [count, ...] by their (language, string); they come out as frames."""
    import pandas as pd

    counts: dict[tuple[str, str], list[int]] = {}
    for b in batches:
        add(b, counts)
        if len(counts) > HELD:
            yield pd.DataFrame([(*k, *v) for k, v in counts.items()], columns=columns)
            counts.clear()
    yield pd.DataFrame([(*k, *v) for k, v in counts.items()], columns=columns)


def learned(counts, least: float) -> Profiles:
    """Profiles from all (lang, w, n, d): how often a word occurs in a language, and in how many rows; words in ``least`` rows are known.

    The row of the empty word stands for a language. Only the profiles and the known words come to the driver, and by ``least`` they are bounded."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    def run(batches):
        def add(b, c):
            for lang, w, n in zip(b["lang"], b["w"], b["n"]):
                for g in grams(w):
                    c.setdefault((lang, g), [0])[0] += n

        yield from summed(batches, add, ["lang", "g", "n"])

    g = counts.filter("n > 0").select("lang", "w", "n").mapInPandas(run, "lang string, g string, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    top = g.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "g"))).filter(F.col("r") <= TOP)
    ranks: dict[str, dict[str, int]] = {r.lang: {} for r in counts.filter("w = ''").select("lang").distinct().collect()}
    for r in top.select("lang", "g", "r").collect():
        ranks[r.lang][r.g] = r.r
    known = counts.groupBy("w").agg(F.sum("d").alias("d")).filter(F.col("d") >= least).filter("w <> ''").select("w").collect()
    return Profiles(ranks, frozenset(r.w for r in known))


def fit(lines, plans) -> Profiles:
    """Profiles from all translated lines and the clean target language of their plan."""
    from pyspark.sql import functions as F

    from ..session import cut

    t = lines.select("plan_id", "translation").filter("length(translation) >= 20")
    t = t.join(plans.filter("target_lang <> ''").select("plan_id", F.col("target_lang").alias("lang")).dropDuplicates(["plan_id"]), "plan_id").select("lang", "translation")

    def run(batches):
        def add(b, c):
            lists: dict[str, tuple[list[str], ...]] = {}
            for lang, text in zip(b["lang"], b["translation"]):
                n, d = lists.setdefault(lang, ([], []))
                ws = [w.lower() for w in split(text)]
                n += ws
                d += {*ws, ""}
            for lang, own in lists.items():
                for k, x in enumerate(own):
                    for w, n in Counter(x).items():
                        c.setdefault((lang, w), [0, 0])[k] += n

        yield from summed(batches, add, ["lang", "w", "n", "d"])

    c = t.mapInPandas(run, "lang string, w string, n bigint, d bigint").groupBy("lang", "w").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    c = cut(c)
    rows = c.filter("w = ''").agg(F.sum("d")).first()[0] or 0
    return learned(c, KNOWN * max(1.0, rows / PER))


#: Lines of a plan in one piece, and of its neighbours beside it.
CHUNK, BESIDE = 256, 12


def _pieces(vocals, lines):
    """(src, rec_id, chunk, before, text, after): transcripts whole, plans in pieces of CHUNK lines with BESIDE lines of their neighbours.

    Lines without a number follow all others in the order of line_id. No plan is gathered whole.
    """
    from pyspark.sql import functions as F

    v = vocals.filter("transcript_id is not null").select(
        F.lit("scribe_vocals").alias("src"), F.col("transcript_id").cast("string").alias("rec_id"), F.lit(0).cast("bigint").alias("chunk"), F.lit("").alias("before"), "text", F.lit("").alias("after")
    )
    n = F.coalesce(F.col("i").cast("bigint"), F.lit(1 << 40) + F.coalesce(F.col("line_id"), F.lit(0)).cast("bigint"))
    own = lines.filter("plan_id is not null and text is not null").select("plan_id", n.alias("n"), "line_id", "text")
    k, at = F.floor(F.col("n") / CHUNK), F.pmod("n", F.lit(CHUNK))
    part = lambda c, p: F.struct(c.alias("chunk"), F.lit(p).alias("part"))
    goes = F.array_compact(F.array(part(k, 1), F.when(at < BESIDE, part(k - 1, 2)), F.when(at >= CHUNK - BESIDE, part(k + 1, 0))))
    rows = own.select("plan_id", F.explode(goes).alias("g"), F.struct("n", "line_id", "text").alias("l")).select("plan_id", "g.chunk", "g.part", "l")
    text = lambda p: F.array_join(F.array_sort(F.collect_set(F.when(F.col("part") == p, F.col("l"))))["text"], "\n")
    pl = rows.groupBy("plan_id", "chunk").agg(text(0).alias("before"), text(1).alias("text"), text(2).alias("after"), F.max(F.col("part") == 1).alias("own")).filter("own")
    return v.unionByName(pl.select(F.lit("plan_docs").alias("src"), F.col("plan_id").alias("rec_id"), "chunk", "before", "text", "after"))


def _sent(vocals, profiles: Profiles):
    import zlib

    key = zlib.crc32(repr(sorted((k, len(v)) for k, v in profiles.ranks.items())).encode())
    return key, vocals.sparkSession.sparkContext.broadcast((profiles.ranks, profiles.words))  # at most TOP n-grams a language, words of KNOWN in PER lines


def stretches(vocals, plans, lines, profiles: Profiles):
    """(src, rec_id, pos, lang, words, confidence): every stretch of each transcript and plan in text order (col ``pos``).

    A plan is read in pieces, each with the lines around it, and the runs of words at the borders of pieces are joined. Null and
    empty texts give no row; redelivered rows count once.
    """
    import pandas as pd
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from .canonical import canonical

    key, sent = _sent(vocals, profiles)

    def run(batches):
        p = unpack(key, *sent.value)
        for b in batches:
            rows = []
            for s, r, c, u, t, v in zip(b["src"], b["rec_id"], b["chunk"], b["before"], b["text"], b["after"]):
                runs = p.runs(canonical(t), canonical(u), canonical(v)) if isinstance(t, str) else []
                rows += [(s, r, c, i, *x) for i, x in enumerate(runs)]
            yield pd.DataFrame(rows, columns=["src", "rec_id", "chunk", "k", "lang", "words", "confidence"])

    r = _pieces(vocals, lines).mapInPandas(run, "src string, rec_id string, chunk bigint, k int, lang string, words int, confidence double")
    # runs that touch a border of a piece and go on in the next one are one stretch
    r = r.dropDuplicates(["src", "rec_id", "chunk", "k"])
    w = W.partitionBy("src", "rec_id").orderBy("chunk", "k")
    r = r.withColumn("new", F.when(F.lag("lang").over(w) == F.col("lang"), 0).otherwise(1))
    r = r.withColumn("pos", F.sum("new").over(w))
    sure = F.round(F.sum(F.col("confidence") * F.col("words")) / F.sum("words"), 4)
    return r.groupBy("src", "rec_id", "pos").agg(F.first("lang").alias("lang"), F.sum("words").alias("words"), sure.alias("confidence"))


def documents(vocals, lines, profiles: Profiles):
    """(src, rec_id, lang, words, confidence): the one language of each transcript and plan, that at the least out-of-place distance.

    The distances of the pieces of a plan are averaged by their words. Texts without words that have a language give no row.
    """
    import pandas as pd
    from pyspark.sql import functions as F

    from .canonical import canonical

    key, sent = _sent(vocals, profiles)

    def run(batches):
        p = unpack(key, *sent.value)
        for b in batches:
            rows = []
            for s, r, c, t in zip(b["src"], b["rec_id"], b["chunk"], b["text"]):
                ws, _, has = p.tokens(canonical(t)) if isinstance(t, str) else ([], None, [])
                own = [w for w, h in zip(ws, has) if h]
                if (d := p.out_of_place(own)) is not None:
                    rows.append((s, r, c, len(own), d.tolist()))
            yield pd.DataFrame(rows, columns=["src", "rec_id", "chunk", "words", "far"])

    r = _pieces(vocals, lines).select("src", "rec_id", "chunk", "text").mapInPandas(run, "src string, rec_id string, chunk bigint, words int, far array<double>").dropDuplicates(["src", "rec_id", "chunk"])
    langs = profiles.langs
    total = F.sum("words")
    far = F.array(*(F.sum(F.col("far")[k] * F.col("words")) / total for k in range(len(langs)))) if langs else F.array().cast("array<double>")
    out = r.groupBy("src", "rec_id").agg(total.alias("words"), far.alias("far"))
    best = F.array_min("far")
    weight = F.aggregate("far", F.lit(0.0), lambda a, x: a + F.exp(SHARP * (F.array_min("far") - x)))
    name = F.element_at(F.array(*map(F.lit, langs)) if langs else F.array().cast("array<string>"), F.array_position("far", best).cast("int"))
    return out.select("src", "rec_id", name.alias("lang"), "words", F.round(1 / weight, 4).alias("confidence"))


def labels(vocals, plans, codes):
    """(src, rec_id, label): the label of each record as iso1, null if missing or naming no language."""
    from pyspark.sql import functions as F

    both = vocals.filter("transcript_id is not null").select(F.lit("scribe_vocals").alias("src"), F.col("transcript_id").cast("string").alias("rec_id"), F.col("language_code").alias("raw")).unionByName(
        plans.filter("plan_id is not null").select(F.lit("plan_docs").alias("src"), F.col("plan_id").alias("rec_id"), F.col("source_lang").alias("raw"))
    )
    both = both.dropDuplicates(["src", "rec_id"]).withColumn("code", F.lower(F.regexp_extract(F.trim("raw"), r"^([A-Za-z]+)(?:[-_.].*)?$", 1)))
    c = codes.select(F.explode(F.array_distinct(F.array("iso1", "iso3", "iso2b"))).alias("code"), F.col("iso1").alias("label")).dropDuplicates(["code"])
    return both.join(F.broadcast(c), "code", "left").select("src", "rec_id", "label")  # lang_codes: 12 rows, fixed


def found(vocals, plans, lines, codes, profiles: Profiles | None = None):
    """(src, rec_id, lang): for records with no usable label or a stretch the label does not name, every language
    that has a stretch of STRETCH or more words."""
    from pyspark.sql import functions as F
    from pyspark.sql import Window as W

    profiles = profiles or fit(lines, plans)
    s = stretches(vocals, plans, lines, profiles).filter(F.col("words") >= STRETCH).select("src", "rec_id", "lang").distinct()
    j = s.join(labels(vocals, plans, codes), ["src", "rec_id"])
    odd = F.max(F.when(F.col("label").isNull() | (F.col("label") != F.col("lang")), 1).otherwise(0)).over(W.partitionBy("src", "rec_id"))
    return j.withColumn("odd", odd).filter("odd = 1").select("src", "rec_id", "lang")
