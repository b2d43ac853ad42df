"""Defective text-translation pairs: empty, refused, copied, in another language, broken off.

Each translation goes through a fixed chain, the first defect counts: nothing but marks; a refusal by a grammar over
classes of words; a copy by the coverage of greedy string tiling; another script by its letters, another language by n-gram profiles; broken
off by what a pushdown parse of the pair still holds open at the end of the translation.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

from .bulk import Texts, Words, among, distinct, merged, rated, slices, totals
from .langid import HELD, SOUNDS, Profiles, learned, split

#: The model is fitted on all lines. How often something must occur in it is said for so many lines; more lines need it as often in proportion.
PER = 24_000
#: Lines a word must occur in to be known, a word of a line to have a sure translation, a word to be found never to end a translation; lines of
#: two languages for a usual ratio.
KNOWN, SURE, INNER, RATIO = 3, 5, 30, 8
#: Total log places the target language may lie behind the best one.
BEHIND = 2.5

# The terminals of the refusal grammar, as whole words and, with a star, beginnings of words.
TERMINALS = {
    # says by itself that something is not done
    "U": "cannot can't won't unable declin* refus* impossib* imposib* impossív* unmöglich* niemożliw* невозможн* verweiger* lehne odmawi* rechaz* rifiut* recus*",
    # can, may, is able
    "C": "can able allowed permitted could puedo podemos posible possible possibile possível peux pouvons puis mesure posso possiamo grado podemos consigo kann darf können dürfen möchte lage möglich mogę możemy stanie wolno могу можем состоянии имею вправе",
    "N": "not no ne n pas non não nicht kein* nie не must'nt",
    # what a translator is asked to do
    "A": "translat* traduc* traduz* tradur* tradui* übersetz* tłumacz* przetłumacz* перев* reproduc* reproduir* reproduz* riprodur* wiedergeben odtworzyć воспроизвести",
    # what is asked, and why it is not given
    "O": "request* solicitud* demande* richiest* pedido* anfrage* prośb* sprawie запрос* content* contenu* contenid* conteúd* inhalt* treści контент* lyrics protected copyright* guidelines assist* letra paroles testo texto texte text tekst* текст* geschützt* chronion* защищ* песни",
    # the speaker as a model: L and D together, or S
    "L": "language ai lenguaje linguagem langue langage linguistique linguistico linguístico językow* языков*",
    "D": "model modelo modèle modello модел*",
    "S": "sprachmodell* chatbot llm",
}
# Productions over the terminals of one sentence, other words being "x": a refusal says that something is not done and,
# before or after that, what was asked; or it names the speaker as a model.
_UNABLE = r"(?:U|C[^ NU]{0,7}N|N[^ C]{0,2}C)"
_REFUSAL = regex.compile(rf"{_UNABLE}[^ ]{{0,9}}[AO]|[AO][^ ]{{0,7}}{_UNABLE}|C[^ NU]{{0,5}}[AO][^ NU]{{0,5}}N|LD|Dx?L|S")
_STEMS = {k: [w[:-1] for w in v.split() if w[-1] == "*"] for k, v in TERMINALS.items()}
_WHOLE = {w: k for k, v in TERMINALS.items() for w in v.split() if w[-1] != "*"}
#: What each refusal has, to pass over most texts at once.
_ASKED = regex.compile("|".join(sorted({w.rstrip("*") for k in "AOLS" for w in TERMINALS[k].split()} - {"ai"})) + r"|\bai\b")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+(?:'[\p{L}]+)?|[.!?\n]+")
_SIGN = regex.compile(r"[\p{L}\p{N}]")
_MARK = regex.compile(r"[(\[{“«\"`<*_~\n]")
_CORE = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_CLOSERS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_TAG = regex.compile(r"<(/?)(\p{L}[\w-]*)([^<>]*)(>?)")
_VOID = frozenset("br hr img wbr".split())
_EMPHASIS = regex.compile(r"[*_~]+")
#: A bullet or number at the beginning of a line; alone on the last line it is an item that never came.
_ITEM = regex.compile(r"(?:^|(?<=\n))[^\S\n]*(?:[-*•+]|\d+[.)])(?=\s|$)")
_QUOTED = regex.compile(r"^\s*(?:“[^”]*”|\"[^\"]*\"|«[^»]*»|„[^“”]*[“”])\s*[:：,-]?\s*")


@lru_cache(maxsize=100_000)
def terminal(word: str) -> str:
    """The terminal of the refusal grammar a lower-case word stands for; the end of a sentence is a blank."""
    if not word[0].isalpha():
        return " "
    if word in _WHOLE:
        return _WHOLE[word]
    return next((k for k, stems in _STEMS.items() for x in stems if word.startswith(x)), "x")


@lru_cache(maxsize=200_000)
def asks(word: str) -> bool:
    """Whether a word has what each refusal has."""
    return _ASKED.search(word) is not None


def refuses(text: str) -> bool:
    """Whether a text declines instead of translating; a quotation of the line before it is skipped."""
    low = text.lower().replace("’", "'")
    if not _ASKED.search(low):
        return False
    t = _QUOTED.sub("", low, count=1) or low
    return _REFUSAL.search("".join(map(terminal, _TOKEN.findall(t)))) is not None


# The scripts of the languages of lang_codes.
_LATIN, _CYRILLIC = r"\p{Script=Latin}", r"\p{Script=Cyrillic}"
SCRIPTS = dict.fromkeys("en fr es de it pt pl nl sv tr".split(), _LATIN) | {"ru": _CYRILLIC, "ja": r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}ー]"}
_SCRIPT = {lang: regex.compile(s) for lang, s in SCRIPTS.items()}
_LETTER = regex.compile(r"\p{L}")


@lru_cache(maxsize=200_000)
def scripted(word: str, target: str) -> tuple[int, int]:
    """(letters of a word, those of a script of the language)."""
    return len(_LETTER.findall(word)), len(_SCRIPT[target].findall(word))


def other_script(told: list[str], kept: list[str], target: str | None) -> bool:
    """Whether most letters of a translation are of no script of the target language; words kept from the line don't count."""
    if target not in _SCRIPT:
        return False
    same = set(kept)
    counts = [scripted(w, target) for w in told if lower(w) not in same]
    return sum(n for n, _ in counts) > 2 * sum(k for _, k in counts)


def tiles(a: list[str], b: list[str]) -> list[int]:
    """Lengths of the tiles of greedy string tiling: the longest common runs of words first, no word twice."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        at.setdefault(w, []).append(i)
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for j, w in enumerate(b):
            for i in at.get(w, ()):
                n = 0
                while i + n < len(a) and j + n < len(b) and not used_a[i + n] and not used_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if not n:
            return out
        for k in range(n):
            used_a[i + k] = used_b[j + k] = True
        out.append(n)


#: Words of a line a copy may lack, and tiles it may be in beyond one for each of them.
LACKS = 1


def copied(a: list[str], b: list[str]) -> bool:
    """Whether b is a again: tiles cover all of b and all but LACKS words of a, and as few of them as that needs."""
    if not len(a) - LACKS <= len(b) <= len(a) or len(a) <= LACKS:
        return a == b
    if not set(b) <= set(a):
        return False  # no tiles could cover b
    t = tiles(a, b)
    return sum(t) == len(b) and len(t) <= 1 + LACKS


def open_marks(text: str) -> list[str]:
    """What a pushdown parser still holds at the end of a text: opened brackets, quotations, fences, tags, emphasis, and a
    list's last item if nothing follows its mark."""
    stack: list[str] = []
    i = 0
    while i < len(text):
        c = text[i]
        if text.startswith("```", i):
            stack.pop() if stack[-1:] == ["```"] else stack.append("```")
            i += 3
            continue
        if (i == 0 or text[i - 1] == "\n") and (m := _ITEM.match(text, i)):
            if i and not text[m.end() :].strip():
                stack.append(m[0].strip())
            i = m.end()
            continue
        if c == "<" and (m := _TAG.match(text, i)):
            name, tag = m[2].lower(), f"<{m[2].lower()}>"
            if not m[4]:
                stack.append("<")  # broken off inside a tag
            elif m[1]:
                if stack[-1:] == [tag]:
                    stack.pop()
            elif name not in _VOID and not m[3].endswith("/"):
                stack.append(tag)
            i = m.end()
            continue
        if c in "*_~" and (m := _EMPHASIS.match(text, i)):
            before, after = text[i - 1 : i], text[m.end() : m.end() + 1]
            if stack[-1:] == [m[0]] and before.strip():
                stack.pop()
            elif after.strip() and not before.isalnum():
                stack.append(m[0])
            i = m.end()
            continue
        if c in "([{“«":
            stack.append(c)
        elif c in _CLOSERS and stack and stack[-1] == _CLOSERS[c]:
            stack.pop()
        elif c == '"':
            stack.pop() if stack[-1:] == ['"'] else stack.append('"')
        i += 1
    return stack


@lru_cache(maxsize=200_000)
def lower(word: str) -> str:
    return word.lower().replace("’", "'")


def words(text: str) -> list[str]:
    return list(map(lower, split(text)))


def only_sounds(ws: list[str]) -> bool:
    return bool(ws) and all(w in SOUNDS for w in ws)


@dataclass
class Model:
    """What is learned from the pairs."""

    profiles: Profiles
    #: (target language, word of the line) -> words one of which its translation nearly always has
    lexicon: dict[tuple[str, str], frozenset[str]]
    #: words that hardly ever end a translation
    inner: frozenset[tuple[str, str]]
    #: (language of the line, target language) -> usual ratio of lengths
    ratio: dict[tuple[str, str], float]
    #: (language, word) seen in translations
    vocabulary: frozenset[tuple[str, str]]

    def widest(self, target: str) -> float:
        """The largest usual ratio of lengths into a language."""
        if not hasattr(self, "_widest"):
            self._widest: dict[str, float] = {}
            for (_, t), v in self.ratio.items():
                self._widest[t] = max(v, self._widest.get(t, 0.0))
        return self._widest.get(target, 1.0)

    @classmethod
    def fit(cls, rows) -> "Model":
        """From (text, translation, target language) rows; :func:`fit` does the same in many tasks."""
        rows = [r for r in rows if all(r)]
        by = max(1.0, len(rows) / PER)
        p = Profiles.fit(((t, lang) for _, t, lang in rows), KNOWN * by)
        n_s: Counter = Counter()
        n_st: dict[tuple[str, str], Counter] = defaultdict(Counter)
        n_t: Counter = Counter()
        total: Counter = Counter()
        last: Counter = Counter()
        ratio = defaultdict(list)
        for text, tr, lang in rows:
            a, b = set(words(text)), words(tr)
            if not a or not b or refuses(tr) or a == set(b):
                continue
            total[lang] += 1
            last[lang, b[-1]] += 1
            bs = set(b)
            for t in bs:
                n_t[lang, t] += 1
            for s in a:
                n_s[lang, s] += 1
                n_st[lang, s].update(bs)
            src = best_language(p, split(text))[0]
            ratio[src, lang].append(size(tr) / max(1, size(text)))
        lexicon = {}
        for (lang, s), c in n_st.items():
            n = n_s[lang, s]
            if n < SURE * by:
                continue
            good = [t for t, k in c.items() if k >= 0.6 * n and k * total[lang] > 4 * n * n_t[lang, t]]
            if good:
                lexicon[lang, s] = frozenset(good)
        inner = frozenset(k for k, n in n_t.items() if n >= INNER * by and last[k] < 0.02 * n)
        med = {k: sorted(v)[len(v) // 2] for k, v in ratio.items() if len(v) >= RATIO * by}
        return cls(p, lexicon, inner, med, frozenset(k for k, n in n_t.items() if n >= KNOWN * by))


def size(text: str) -> int:
    return sum(map(len, _CORE.findall(text)))


def letters(found: list[str]) -> int:
    """The size of a text by its words: all their characters but the apostrophes."""
    s = "".join(found)
    return len(s) - s.count("'") - (0 if s.isascii() else s.count("’") + s.count("‘") + s.count("ʼ"))


def best_language(p: Profiles, found: list[str]):
    """(best language, log places of each language behind it, words with a language) of some words."""
    s, n = p.totals(found)
    least = min(s)
    return p.langs[s.index(least)], [x - least for x in s], n


def defect(m: Model, text: str | None, translation: str | None, target: str | None) -> str | None:
    """The defect of a translation, or None. A missing text or target language only rules out the tests that need it."""
    if translation is None or not _SIGN.search(translation):
        return "empty"
    told = split(translation)
    b = list(map(lower, told))
    if any(map(asks, b)) and refuses(translation):
        return "refusal"
    text = text or ""
    own = split(text)
    a = list(map(lower, own))
    if not a or only_sounds(a):
        return None
    if copied(a, b):
        return "copy"
    if other_script(told, a, target):
        return "other_language"
    if target in m.profiles.ranks:
        best, behind, n = best_language(m.profiles, told)
        if n and behind[m.profiles.langs.index(target)] > BEHIND:
            return "other_language"
    elif target is None:
        return None
    return "truncated" if breaks_off(m, text, a, translation, b, target, own, told) else None


#: Share of its usual length below which something open says that a translation breaks off, by what is open.
OPEN = {"line": 0.42, "tail": 0.68, "mark": 0.85, "name": 0.9, "word": 0.95, "phrase": 0.95}


def parse(m: Model, text: str, a: list[str], translation: str, b: list[str], target: str, share: float, own: list[str] | None = None) -> list[str]:
    """What a pushdown parse of a translation still holds at its end.

    Marks, tags and list items open and close as :func:`open_marks` says. Beside them the line opens what its translation
    has to close: the line itself ("line", closed when the translation is long enough to be one), its names
    ("name", closed where they come), and its last words with a sure translation ("tail", closed by any of these, once earlier ones
    have come). A word that never ends a translation opens a "phrase", which the next word closes; a last word that nobody uses is
    a "word" that was cut. Ending with what the line ends with closes everything but marks and the line.
    """
    have = set(b)
    stack = ["line"] if share < OPEN["line"] else []
    if _MARK.search(translation) and not open_marks(text):
        stack += ["mark"] * len(open_marks(translation))
    known = m.profiles.words
    stack += ["name" for w in (own or split(text))[1:] if w[0].isupper() and w.lower() not in known and w.lower() not in have]
    end = b[-1]
    if end in m.lexicon.get((target, a[-1]), ()):
        return stack
    if (target, end) in m.inner:
        stack.append("phrase")
    if (target, end) not in m.vocabulary and end not in a:
        stack.append("word")
    if share < OPEN["tail"]:
        sure = [bool(m.lexicon[target, w] & have) for w in a if (target, w) in m.lexicon]
        k = 2 if len(sure) > 3 else 1
        if len(sure) >= 2 and not any(sure[-k:]) and any(sure[:-k]):
            stack.append("tail")
    return stack


def breaks_off(m: Model, text: str, a: list[str], translation: str, b: list[str], target: str, own: list[str], told: list[str]) -> bool:
    """Whether the parse of a translation ends with something open that a text of its length should have closed."""
    if len(translation) > 1.1 * len(text) * m.widest(target):
        return False
    src = best_language(m.profiles, own)[0]
    share = letters(told) / max(1, letters(own)) / m.ratio.get((src, target), 1.0)
    return share <= 1.05 and any(share < OPEN[x] for x in parse(m, text, a, translation, b, target, share, own))


_MODEL: dict[int, tuple[Model, "Doubts"]] = {}


def usable(w: Words, own: Texts, told: Texts, translations) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which pairs the model may learn from: not refused, no copy in other order; the different words of each line, of each translation).

    A word of a text is text number * 2^32 + number of the word."""
    a, b = (distinct(t.row << 32 | w["plain"][t.words]) for t in (own, told))
    na, nb, both = (np.bincount(k >> 32, minlength=len(own.size)) for k in (a, b, a[among(a, b)]))
    ok = (na > 0) & (nb > 0) & ~((na == nb) & (na == both))
    for i in np.flatnonzero(ok & told.any(w["asks"][told.words])):
        ok[i] = not refuses(translations[i].as_py())
    return ok, a[ok[a >> 32]], b[ok[b >> 32]]


def asked(word: str) -> bool:
    return asks(lower(word))


class Tally:
    """Counts of words by target language: how often and in how many translations they occur; of usable pairs, how many lines and
    translations have them, how many translations end with them. The empty word counts all pairs."""

    def __init__(self):
        self.words = Words(asks=asked)
        self.langs: dict[str, int] = {}
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, lang, text, translation) -> None:
        """Arrow arrays: target languages, lines and translations of some pairs."""
        w = self.words
        told, own = w.read(translation), w.read(text)
        g = lang.dictionary_encode()
        g = np.array([self.langs.setdefault(x, len(self.langs)) for x in g.dictionary.to_pylist()], np.int64)[g.indices.to_numpy()]
        ok, a, b = usable(w, own, told, translation)
        low, none = w["low"][told.words], w.number("")
        d = distinct(told.row << 32 | low)
        last = told.words[told.end[ok] - 1]
        word = (1 << 32) - 1
        keys = (
            (0, g[told.row], low), (1, g[d >> 32], d & word), (1, g, none), (2, g[a >> 32], a & word), (3, g[b >> 32], b & word), (3, g[ok], none), (4, g[ok], w["plain"][last]),
        )
        self.kept.append(np.unique(np.concatenate([(own * 5 + k) << 32 | ws for k, own, ws in keys]), return_counts=True))
        if sum(len(k) for k, _ in self.kept) > 3 * HELD:
            self.kept = [merged(self.kept)]

    def full(self) -> bool:
        return self.words.full() or sum(len(k) for k, _ in self.kept) > 2 * HELD

    def frames(self):
        """The counts as Arrow batches; they begin anew."""
        import pyarrow as pa

        k, n = merged(self.kept)
        g, kind = (k >> 32) // 5, (k >> 32) % 5
        own, at = np.unique(g << 32 | k & ((1 << 32) - 1), return_inverse=True)
        counts = np.zeros((5, len(own)), np.int64)
        counts[kind, at] = n
        langs = list(self.langs)
        ws = [self.words.strings[i] for i in (own & ((1 << 32) - 1)).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in (own >> 32).tolist()], pa.string()), pa.array(ws, pa.string()), *map(pa.array, counts)], ["lang", "w", *"ndstz"])
        self.kept = []
        self.words.clear()


class Meetings:
    """How often numbered words of lines and of their translations meet, and ratios of lengths."""

    def __init__(self, profiles: Profiles, left: dict, right: dict, rows_left: np.ndarray, rows_right: np.ndarray):
        self.langs, self.n, self.m = profiles.langs, rows_left, rows_right
        self.where = {g: i for i, g in enumerate(self.langs)}
        numbers = lambda by: lambda w: [by[g].get(lower(w), -1) for g in self.langs]
        self.words = Words(asks=asked, letters=lambda w: letters([w]), left=numbers(left), right=numbers(right), **rated(profiles))
        self.ratios: Counter = Counter()
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, lang, text, translation) -> None:
        """Arrow arrays: target languages, lines and translations of some pairs."""
        if self.words.full():
            self.words.clear()
        w = self.words
        told, own = w.read(translation), w.read(text)
        ok, _, _ = usable(w, own, told, translation)
        if not ok.any():
            return
        g = lang.dictionary_encode()
        g = np.array([self.where[x] for x in g.dictionary.to_pylist()], np.int64)[g.indices.to_numpy()]
        src = totals(w, own)[0].argmin(1)
        ratio = told.sum(w["letters"][told.words]) / np.maximum(1, own.sum(w["letters"][own.words]))
        self.ratios.update(zip((-1 - src * len(self.langs) - g)[ok].tolist(), ratio[ok].tolist()))

        def met(t: Texts, column: str) -> tuple[np.ndarray, np.ndarray]:
            x = w[column][t.words, g[t.row]]
            at = (x >= 0) & ok[t.row]
            k = distinct(t.row[at] << 32 | x[at])
            return k & ((1 << 32) - 1), np.bincount(k >> 32, minlength=len(ok))

        (A, na), (B, nb) = met(own, "left"), met(told, "right")
        times = np.repeat(nb, na)  # each word of a line meets all of its translation
        x, y = np.repeat(A, times), B[slices(np.repeat(np.cumsum(nb) - nb, na), times)]
        ok = self.m[y] >= 0.6 * self.n[x]  # rarer words can't be in 0.6 of the rows
        self.kept.append(np.unique(x[ok] * len(self.m) + y[ok], return_counts=True))
        if sum(len(k) for k, _ in self.kept) > 2_000_000:
            self.kept = [self.pairs()]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return merged(self.kept)

    def frames(self):
        """The counts as Arrow batches; they begin anew."""
        import pyarrow as pa

        k, n = self.pairs()
        for key, ratio, n in ((k, np.zeros(len(k)), n), ([k for k, _ in self.ratios], [r for _, r in self.ratios], list(self.ratios.values()))):
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ratio, pa.float64()), pa.array(n, pa.int64())], ["key", "ratio", "n"])
        self.kept, self.ratios = [], Counter()


def fit(lines, plans) -> Model:
    """The model from all lines with their plan's target language.

    Words are counted first; then, as profiles and word counts are known, how words meet and the ratios of lengths. What comes to the driver
    occurs in a fixed share of the lines at least, so it doesn't grow with them."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from ..session import cut

    t = lines.select("plan_id", "text", "translation").filter("length(translation) >= 12 and length(text) >= 12")
    t = t.join(plans.filter("target_lang <> ''").select("plan_id", F.col("target_lang").alias("lang")).dropDuplicates(["plan_id"]), "plan_id").select("text", "translation", "lang")

    def count(batches):
        c = Tally()
        for b in batches:
            c.add(b["lang"], b["text"], b["translation"])
            if c.full():
                yield from c.frames()
        yield from c.frames()

    c = t.mapInArrow(count, "lang string, w string, n bigint, d bigint, s bigint, t bigint, z bigint")
    c = cut(c.groupBy("lang", "w").agg(*(F.sum(x).alias(x) for x in "ndstz")))
    heads = c.filter("w = ''").collect()
    total = {r.lang: r.t for r in heads}
    by = max(1.0, sum(r.d for r in heads) / PER)
    p = learned(c, KNOWN * by)
    often = c.filter("w <> ''").filter((F.col("s") >= SURE * by) | (F.col("t") >= KNOWN * by)).select("lang", "w", "s", "t", "z").orderBy("lang", "w").collect()
    vocabulary = frozenset((r.lang, r.w) for r in often if r.t >= KNOWN * by)
    inner = frozenset((r.lang, r.w) for r in often if r.t >= INNER * by and r.z < 0.02 * r.t)
    # a word of a quarter of all translations is no translation of any
    left = [r for r in often if r.s >= SURE * by]
    right = [r for r in often if r.t >= 0.6 * SURE * by and 4 * r.t < total[r.lang]]
    langs = p.langs
    n, m = np.array([r.s for r in left], np.int64), np.array([r.t for r in right], np.int64)
    numbered = lambda rows: {g: {r.w: i for i, r in enumerate(rows) if r.lang == g} for g in langs}
    sent = lines.sparkSession.sparkContext.broadcast((p.ranks, p.words, numbered(left), numbered(right), n, m))

    def meet(batches):
        ranks, known, lo, hi, n, m = sent.value
        pairs = Meetings(Profiles(ranks, known), lo, hi, n, m)
        for b in batches:
            pairs.add(b["lang"], b["text"], b["translation"])
            if len(pairs.ratios) > HELD:
                yield from pairs.frames()
        yield from pairs.frames()

    r = cut(t.mapInArrow(meet, "key bigint, ratio double, n bigint").groupBy("key", "ratio").agg(F.sum("n").alias("n")))
    # the value in the middle, the upper one of two
    w = W.partitionBy("key")
    r2 = r.filter("key < 0").withColumns({"upto": F.sum("n").over(w.orderBy("ratio")), "all": F.sum("n").over(w)})
    mid = r2.filter((F.col("all") >= RATIO * by) & (F.col("upto") > F.floor(F.col("all") / 2))).groupBy("key").agg(F.min("ratio").alias("ratio")).collect()
    ratio = {(langs[(-1 - x.key) // len(langs)], langs[(-1 - x.key) % len(langs)]): x.ratio for x in mid}

    every = np.array([total[x.lang] for x in left], np.int64)
    limits = lines.sparkSession.sparkContext.broadcast((n, m, every))

    def good(batches):
        n, m, every = limits.value
        for b in batches:
            x, y, k = b["key"].to_numpy() // max(1, len(m)), b["key"].to_numpy() % max(1, len(m)), b["n"].to_numpy()
            yield b[(k >= 0.6 * n[x]) & (k * every[x] > 4 * n[x] * m[y])][["key"]]

    lexicon: dict[tuple[str, str], set[str]] = {}
    for x in r.filter("key >= 0").select("key", "n").mapInPandas(good, "key bigint").collect():
        a, b = left[x.key // len(right)], right[x.key % len(right)]
        lexicon.setdefault((a.lang, a.w), set()).add(b.w)
    return Model(p, {k: frozenset(v) for k, v in lexicon.items()}, inner, ratio, vocabulary)


class Doubts:
    """Tells for many pairs at once which may have a defect, so that defect() need not look at the others.

    No pair for which defect() finds something is left out: each test here is one of its tests, or a condition that one can't do without."""

    def __init__(self, m: Model):
        langs = m.profiles.langs
        self.langs = langs
        self.where = {g: i for i, g in enumerate(langs)}
        self.scripts = {s: g for g, s in SCRIPTS.items()}
        own = list(self.scripts)
        #: The column of a language's script beside that of all letters; -1 for none.
        self.script = np.array([1 + own.index(SCRIPTS[g]) if g in SCRIPTS else -1 for g in langs], np.int64)
        self.ratio = np.array([[m.ratio.get((a, b), 1.0) for b in langs] for a in langs])
        self.words = Words(
            asks=asked,
            letters=lambda w: letters([w]),
            scripts=lambda w: [scripted(w, "en")[0], *(scripted(w, g)[1] for g in self.scripts.values())],
            name=lambda w: w[0].isupper() and w.lower() not in m.profiles.words,
            ends=lambda w: [(g, lower(w)) in m.inner or (g, lower(w)) not in m.vocabulary for g in langs],
            **rated(m.profiles),
        )

    def __call__(self, text, translation, target) -> np.ndarray:
        """Arrow arrays: lines, translations and target languages of some pairs."""
        import pyarrow.compute as pc

        if self.words.full():
            self.words.clear()
        w = self.words
        told, own = w.read(translation), w.read(text)
        g = target.dictionary_encode()
        g = np.array([self.where.get(x, -1) for x in g.dictionary.to_pylist()] + [-1], np.int64)[pc.fill_null(g.indices, -1).to_numpy(zero_copy_only=False)]
        odd = (told.size == 0) | (own.size == 0) | (g < 0)  # whatever is missing or strange
        if odd.all():
            return odd
        a, b = (t.row << 32 | w["plain"][t.words] for t in (own, told))
        here = distinct(a)
        new = ~among(b, here)
        out = odd | told.any(w["asks"][told.words])
        out |= ~told.any(new) & (told.size <= own.size) & (told.size >= own.size - LACKS)  # may be a copy
        # another language
        n = w["scripts"][told.words]
        of = self.script[g][told.row]
        out |= (told.sum(n[:, 0] * new) > 2 * told.sum(n[np.arange(len(of)), of] * new)) & (self.script[g] >= 0)
        s, k = totals(w, told)
        out |= (k > 0) & (s[np.arange(len(g)), g] - s.min(1) > BEHIND)
        # broken off
        share = told.sum(w["letters"][told.words]) / np.maximum(1, own.sum(w["letters"][own.words])) / self.ratio[totals(w, own)[0].argmin(1), g]
        out |= share < max(OPEN["line"], OPEN["tail"])
        out |= (share < OPEN["mark"]) & pc.fill_null(pc.match_substring_regex(translation, _MARK.pattern), True).to_numpy(zero_copy_only=False)
        name = np.flatnonzero(w["name"][own.words])
        name = name[~among(own.row[name] << 32 | w["low"][own.words[name]], distinct(b))]
        out |= (share < OPEN["name"]) & (np.bincount(own.row[name], minlength=len(g)) > 0)
        some = np.flatnonzero(~odd)
        last = told.words[told.end[some] - 1]
        out[some] |= (share[some] < max(OPEN["phrase"], OPEN["word"])) & w["ends"][last, g[some]]
        return out


def found(lines, plans, model: Model | None = None):
    """(line_id, defect): every defective line once.

    Null and markless translations are 'empty'; lines of unknown plans are tested without a target language;
    redelivered rows count once; an empty table gives an empty result.
    """
    import zlib

    from pyspark.sql import functions as F

    m = model or fit(lines, plans)
    parts = (m.profiles.ranks, m.profiles.words, m.lexicon, m.inner, m.ratio, m.vocabulary)
    key = zlib.crc32(repr((len(m.lexicon), sorted(m.ratio.items()), len(m.profiles.words))).encode())
    sent = lines.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        import pyarrow as pa

        if key not in _MODEL:
            ranks, ws, *rest = sent.value
            _MODEL.clear()
            own = Model(Profiles(ranks, ws), *rest)
            _MODEL[key] = own, Doubts(own)
        model, doubts = _MODEL[key]
        for b in batches:
            b = b.take(pa.array(np.flatnonzero(doubts(b["text"], b["translation"], b["target_lang"]))))
            d = [defect(model, *x) for x in zip(*(b[c].to_pylist() for c in ("text", "translation", "target_lang")))]
            out = pa.RecordBatch.from_arrays([b["line_id"], pa.array(d, pa.string())], ["line_id", "defect"])
            yield out.filter(out["defect"].is_valid())

    # the hot key is the plan's: one row of plan_docs meets many lines, which AQE splits
    t = lines.filter("line_id is not null").select(F.col("line_id").cast("bigint").alias("line_id"), "plan_id", "text", "translation")
    j = t.join(plans.select("plan_id", "target_lang").dropDuplicates(["plan_id"]), "plan_id", "left")
    return j.select("line_id", "text", "translation", "target_lang").mapInArrow(run, "line_id bigint, defect string").dropDuplicates(["line_id"])


