"""Text read with the wrong character encoding: detection and repair.

A best-first graph search over "show as bytes of encoding A, read as encoding B" and unescape steps.
States are texts, remembered by hash; the cost of a state says how implausible its characters are next to each
other, and the search returns the cheapest text it can reach. The cost knows no language and no alphabet: it looks at
what a wrong decoding leaves behind, whatever was written (controls and replacement characters, signs inside words,
capitals after small letters, words of two scripts, words almost wholly of accented letters, sequences that are the
bytes of UTF-8 shown one by one). Every code page used agrees with ASCII below 128, so a line is searched by its words that
hold other characters, beside the number of its plain words.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

# Cyrillic, Greek and Latin letters that look like letters of another script: homoglyphs, not wrong decoding.
LOOKALIKE = set("аеорсухіјѕһԁԛԝтмнвкАВЕКМНОРСТХІЈЅУ" + "αοριντυκχεγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "aceopxyijsABCEHIJKMOPSTXY")
#: Code pages in which the bytes of UTF-8 get shown; those of several bytes a character are tried on East Asian signs only.
SHOWN_UTF8 = ("cp1252", "latin-1", "cp1251", "cp1250", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "mac_roman", "cp437", "cp850", "cp852", "koi8-r", "cp866")
SHOWN_WIDE = ("cp932", "gbk", "big5", "cp949")
#: (shown in, really in): single-byte pages mistaken for each other.
SHOWN_BYTE = (
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "iso8859-2"),
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp850"), ("cp1252", "cp437"),
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("cp1251", "cp1250"),
    ("cp1250", "iso8859-2"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp850", "cp1250"),
    ("cp1252", "iso8859-5"), ("cp1252", "cp866"), ("cp1252", "cp1253"), ("cp1252", "cp1254"), ("cp1252", "cp1255"), ("cp1252", "cp1256"),
)
STEP_COST = 0.3
#: What a path has to gain to be believed, by itself and if the same path has mended another line of the text.
GAIN, AGAIN = 1.1, 0.1
#: Costs that are no different; the price of a letter that the mended lines of a text don't have.
NEAR, FOREIGN = 0.25, 0.5

_NON_ASCII = re.compile(r"[^ \n\r\t]*[^\x00-\x7f][^ \n\r\t]*")
_ESCAPE = re.compile(r"&(?:#\d{2,6}|#x[0-9a-fA-F]{2,6}|[A-Za-z]{2,8});|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|(?:%[C-F][0-9A-F]%[89AB][0-9A-F])+")
#: Characters no text has: what remains where bytes had no meaning in the page they were read in, or were thrown away.
_LOST = re.compile("[\x80-\x9f�]")
_TAG = re.compile(r"\[[^\]\n]*\]")


@lru_cache(maxsize=None)
def _encoder(page: str) -> dict[str, int]:
    """Character to byte; bytes a page leaves out stand for the control character of that number."""
    return {bytes([b]).decode(page, "ignore") or chr(b): b for b in range(128, 256)}


@lru_cache(maxsize=None)
def _decoder(page: str) -> dict[int, str]:
    return {b: c for c, b in _encoder(page).items()}


@lru_cache(maxsize=None)
def _sequences(page: str) -> tuple[re.Pattern, re.Pattern]:
    """(one character of UTF-8 shown in a page, the same without a capital before a closing mark and a mark before a letter)."""
    of = _decoder(page)
    cls = lambda a, b, no="": "[" + "".join(re.escape(of[x]) for x in range(a, b) if of[x] not in no) + "]"
    tail = cls(0x80, 0xC0)
    wide = f"{cls(0xE0, 0xF0)}{tail}{{2}}|{cls(0xF0, 0xF5)}{tail}{{3}}"
    sure = cls(0x80, 0xC0, "’”»…–—\xa0")
    marks = "‘’“”–—"
    return re.compile(f"{cls(0xC2, 0xE0)}{tail}|{wide}"), re.compile(f"{cls(0xC2, 0xE0, marks)}(?:{sure}|{tail}(?=\\w))|[{marks}](?!\\w){tail}|{wide}")


@lru_cache(maxsize=None)
def _kind(c: str) -> str:
    """The part a character plays: L letter, M mark, C control or replacement, S sign, T sign that may follow a word, F
    joiner or other invisible, P punctuation, E emoji or other picture, N number."""
    o = ord(c)
    if o == 0xFFFD or 0x80 <= o < 0xA0:
        return "C"
    g = unicodedata.category(c)
    if g in ("Co", "Cn"):
        return "C"
    if c in "ªº" or g == "No" or c in "®™©°€£¥$†‡":
        return "T"
    if c in "µ¶§‰¦":
        return "S"
    if g == "Lm" and 0x2B0 <= o < 0x300:
        return "P" if c in "ʼʻ" else "S"
    if g[0] == "L":
        return "L"
    if g[0] == "M":
        return "M"
    if g == "Cf":
        return "F"
    if 0x1F000 <= o or 0x2600 <= o < 0x2800 or g[0] == "Z" or 0x3000 <= o < 0x3040:
        return "E"
    if g in ("Pi", "Pf", "Pd", "Po", "Pc", "Ps", "Pe"):
        return "P"
    return "N" if g == "Nd" else "S"


_EAST = {"CJK", "HIRAGANA", "KATAKANA", "HALFWIDTH", "HANGUL", "IDEOGRAPHIC", "KATAKANA-HIRAGANA", "BOPOMOFO"}


@lru_cache(maxsize=None)
def _script(c: str) -> str:
    """The script of a letter by its name; scripts written together are one, full-width and modifier letters have none."""
    if c < "\x80":
        return "LATIN"
    s = unicodedata.name(c, "?").partition(" ")[0]
    if s in ("FULLWIDTH", "MODIFIER", "FEMININE", "MASCULINE", "MATHEMATICAL"):
        return ""
    return "EAST" if s in _EAST else s


# What Irish sets before a capital vowel.
PREFIXED = "hnt"
#: Marks that stand between letters of one word.
_INNER = set("’‘ʼ‑–—·‧・.-…")


def _twins(w: str, scripts: dict[str, int], latin: bool) -> bool:
    """Whether all letters of one script of a word look like letters of its other one; ``latin`` says that it may be the Latin script."""
    if not set(scripts) <= {"LATIN", "CYRILLIC", "GREEK"}:
        return False
    return any(all(c in LOOKALIKE for c in w if _kind(c) == "L" and _script(c) == s) for s in scripts if latin or s != "LATIN")


@lru_cache(maxsize=200_000)
def word_cost(w: str, given: int = 0) -> float:
    """How implausible the characters of a word are, given their neighbours.

    ``given`` says that the word is the given text rather than the result of a step: only there may letters of two scripts
    be look-alikes, which are nobody's wrong decoding; of any of its scripts (1) or of another than Latin only (2).
    """
    out = mix = 0.0
    letters = dense = 0
    scripts: dict[str, int] = {}
    last = ""  # script of the letter before
    for k, c in enumerate(w):
        p, n = w[k - 1] if k else " ", w[k + 1] if k + 1 < len(w) else " "
        if c.isascii():
            if c.isalpha():
                letters += 1
                scripts["LATIN"] = scripts.get("LATIN", 0) + 1
                mix += 2.0 if last not in ("", "LATIN") else 0.0
                last = "LATIN"
                out += 2.0 if c.isupper() and p.islower() and not p.isascii() else 0.0
            continue
        kind = _kind(c)
        if kind == "C":
            out += 4.0
        elif kind == "S":
            out += 2.5 if p.isalpha() and n.isalpha() else 1.5 if p.isalpha() or n.isalpha() or not (p.isascii() and n.isascii()) else 0.0
        elif kind == "T":
            if p.isalpha() and n.isalpha() and not (c == "°" and n in "CF"):
                out += 2.5
            elif n.isalpha() and not p.isalnum() and unicodedata.category(c) in ("No", "Lo"):
                out += 1.5
            elif p.isalpha() or n.isalpha() and not (c in "°€£¥$" and not p.isalpha()):
                out += 0.7
        elif kind == "P":
            if p.isalpha() and n.isalpha() and c not in _INNER:
                out += 1.7
            elif c in "¿¡" and (p.isalpha() or not (n.isalpha() or n in "¿¡*'\"“‘«(_")):
                out += 1.5 if p.isalpha() else 1.0
            elif c in "‚„" and p.isalpha():
                out += 1.0
            elif c == "·" and (p.isalpha() != n.isalpha()):
                out += 1.0
        elif kind == "L":
            letters += 1
            s = _script(c)
            if s:
                scripts[s] = scripts.get(s, 0) + 1
                mix += 2.0 if last not in ("", s) else 0.0
                if not last and c in "ьъЬЪ":
                    out += 1.0  # signs that soften the letter before them
                last = s
            dense += s == "LATIN"
            if c.isupper() and p.islower():
                out += 1.0 if k == 1 and p in PREFIXED else 2.0
            if n in "\xa0\xad" and not p.isupper() and c in "ÃÂГРÎÏÐÑ":
                out += 2.0  # how UTF-8 shows a letter whose second byte is a blank or a hyphen
        elif kind == "M" and not p.isalpha() and _kind(p) != "M" and not (p in "*#" or p.isdigit() or _kind(p) in "ESP" or c >= "︀"):
            out += 0.5
    if mix and not (given and _twins(w, scripts, given == 1)):
        out += mix
    if dense >= 3 and dense >= 0.8 * letters:
        out += 0.4 * dense if dense > 3 else 0.25
    elif dense == letters == 2 and not out and len(w) == 2:
        out += 0.3
    return out


_VOWELS = set("аеёиоуыэюя")
# Russian letters from the most to the least frequent, to tell one Cyrillic page from another.
RU_ORDER = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
_RANK = {c: i for i, c in enumerate(RU_ORDER)}


def inverted(words: tuple[str, ...]) -> bool:
    """Whether words begin with a small letter and go on in capitals, as a sentence does when cases are swapped."""
    ws = [w for w in words if w[0].isalpha()]
    return len(ws) > 1 and ws[0][0].islower() and sum(map(str.isupper, ws[1:])) >= 0.8 * (len(ws) - 1) and any(len(w) > 2 for w in ws[1:])


@lru_cache(maxsize=50_000)
def _swapped(words: tuple[str, ...]) -> float:
    """Extra cost of Cyrillic words that are mostly in capitals, as one Cyrillic page shown in another comes out:
    whether small letters and capitals changed places, and whether the letters are too rare and vowels too seldom next to
    consonants for a text of that length."""
    text = " ".join(words)
    letters = [c for c in text if "Ѐ" <= c < "԰"]
    if len(letters) < 5 or 2 * sum(c.isupper() for c in letters) < len(letters):
        return 0.0
    odd = 3.0 if inverted(words) else 0.0
    low = text.lower()
    r = [_RANK.get(c, 14) for c in low if "а" <= c < "Ѡ"]
    near = [(a in _VOWELS) != (b in _VOWELS) for a, b in zip(low, low[1:]) if a in _RANK and b in _RANK]
    n = min(len(r), 40)
    return odd + max(0.0, sum(r) / len(r) - 11.0) * n / 8 + (max(0.0, 0.58 - sum(near) / len(near)) * n / 2 if near else 0.0)


@lru_cache(maxsize=200_000)
def _shown(words: tuple[str, ...]) -> int:
    """Bytes too many, at characters of UTF-8 that the words show byte by byte in some page; 0 unless everything beyond ASCII is part of one."""
    text = "\n".join(words)
    most = 0
    for page in SHOWN_UTF8:
        one, sure = _sequences(page)
        if one.search(text) and one.sub("", text).isascii():
            most = max(most, sum(len(m) - 1 for m in sure.findall(text)))
    return most


def cost(words: tuple[str, ...], plain: int = 0, given: bool = False) -> float:
    """Cost of a line: its words beyond ASCII, and how many plain words it has beside them."""
    out = 0.0
    other = cyrillic = 0
    n = _shown(words)
    out += n
    for w in words:
        # one sequence may be chance, and look-alikes still are; more of them are not
        out += word_cost(w, (1, 2, 0)[min(n, 2)] if given else 0)
        f = next((c for c in w if c.isalpha()), "a")
        if f >= "Ͱ":
            other += 1
            cyrillic += "Ѐ" <= f < "԰"
    if other:
        out += 1.0 * min(plain + len(words) - other, other) if not given else 0.0
        if cyrillic:
            own = tuple(w for w in words if "Ѐ" <= next((c for c in w if c.isalpha()), "a") < "԰" and not any(c.isascii() and c.isalpha() for c in w))
            out += _swapped(own) if own else 0.0
    return out


def _bytes(text: str, page: str) -> bytes | None:
    m = _encoder(page)
    try:
        return bytes(ord(c) if c < "\x80" else m[c] for c in text)
    except KeyError:
        return None


def _utf8(text: str, page: str) -> str | None:
    if page in SHOWN_WIDE:
        try:
            out = text.encode(page).decode("utf-8")
        except UnicodeError:
            return None
        return None if out == text else out
    b = _bytes(text, page)
    if b is None:
        return None
    try:
        out = b.decode("utf-8")
    except UnicodeDecodeError:
        # a no-break space that became a plain one, the letter before it left alone: "Ã " was "à"
        try:
            out = re.sub(rb"\xc3(?=[ \n]|$)", b"\xc3\xa0", b).decode("utf-8")
        except UnicodeDecodeError:
            return None
    return None if out == text else out


def _byte(text: str, shown: str, real: str) -> str | None:
    b = _bytes(text, shown)
    if b is None:
        return None
    m = _decoder(real)
    out = "".join(chr(x) if x < 128 else m[x] for x in b)
    return None if out == text else out


def _unescape(text: str) -> str | None:
    def one(m: re.Match) -> str:
        s = m[0]
        if s[0] == "&":
            return html.unescape(s)
        if s[0] == "\\":
            return chr(int(s[2:], 16))
        try:
            return bytes.fromhex(s.replace("%", "")).decode("utf-8")
        except UnicodeDecodeError:
            return s

    out = _ESCAPE.sub(one, text)
    return None if out == text else out


_WIDE = re.compile("[⺀-￯]")


def steps(text: str, pages: bool = True) -> Iterator[tuple[str, str]]:
    """Every (name of the step, text after it) that can be taken from a text; ``pages`` allows one single-byte page for another."""
    if (t := _unescape(text)) is not None:
        yield "unescape", t
    if not text.isascii():
        for page in SHOWN_UTF8:
            if (t := _utf8(text, page)) is not None:
                yield f"{page}>utf-8", t
        if _WIDE.search(text):
            for page in SHOWN_WIDE:
                if (t := _utf8(text, page)) is not None:
                    yield f"{page}>utf-8", t
        if pages:
            for shown, real in SHOWN_BYTE:
                if (t := _byte(text, shown, real)) is not None:
                    yield f"{shown}>{real}", t


def search(text: str, plain: int = 0) -> tuple[str, float, float, tuple[str, ...], list[tuple[str, tuple[str, ...]]]]:
    """Best-first search from a text: the cheapest text reached, its cost, the cost of the start, the steps, and what was
    reached at nearly the same cost, as (text, steps).

    A path takes any number of decode and unescape steps, each of which makes the text shorter, and at most one change
    of single-byte pages (two in a row are one change of another pair), so the graph is finite. A state is visited once. The search
    ends when no open state can become cheaper than the best one, since every step has its price: nothing is cut off.
    """
    def of(t: str, given: bool = False) -> float:
        return cost(tuple(t.split("\n")), plain, given) + 2.0 * len(_ESCAPE.findall(t))

    start = of(text, True)
    best = (start, text, ())
    seen = {hash((text, True))}
    heap: list[tuple[float, int, str, tuple[str, ...], bool]] = [(start, 0, text, (), True)]
    cheap: list[tuple[float, str, tuple[str, ...]]] = []
    k = 0
    while heap:
        c, _, t, path, pages = heapq.heappop(heap)
        if c < best[0] - 1e-9:
            best = (c, t, path)
        if c <= best[0] + NEAR:
            cheap.append((c, t, path))
        if STEP_COST * (len(path) + 1) >= best[0] - 1e-9:
            continue
        for name, u in steps(t, pages):
            free = pages and (name.endswith("utf-8") or name == "unescape")
            if (h := hash((u, free))) not in seen:
                seen.add(h)
                k += 1
                heapq.heappush(heap, (of(u) + STEP_COST * (len(path) + 1), k, u, (*path, name), free))
    return best[1], best[0], start, best[2], [(t, p) for c, t, p in cheap if p and c <= best[0] + NEAR]


#: Steps between two Cyrillic pages: the script stays, so they need twice the gain.
_CYRILLIC_STEPS = {f"{a}>{b}" for a, b in SHOWN_BYTE if {a, b} <= {"cp1251", "koi8-r", "cp866"}}


@lru_cache(maxsize=50_000)
def _line(words: tuple[str, ...], plain: int) -> tuple[bool, tuple[str, ...], bool, tuple]:
    """(is garbled, the steps that mend it, whether every word comes back, equal ways to mend it) of a line."""
    t, c, start, path, ties = search("\n".join(words), plain)
    lost = _LOST.search(t) is not None
    need = GAIN
    if path and path[0] in _CYRILLIC_STEPS:
        # letters that are merely rare are no proof: some word must be misshapen as well
        need = 2 * GAIN if any(word_cost(w, 1) for w in words) or inverted(words) else 1e9
    if path and start - c >= need and c <= 0.6 * start:
        return True, path, not lost, tuple(ties)
    return lost, (), False, ()


def _apply(text: str, path: tuple[str, ...]) -> str:
    for name in path:
        if name == "unescape":
            t = _unescape(text)
        else:
            shown, _, real = name.partition(">")
            t = _utf8(text, shown) if real == "utf-8" else _byte(text, shown, real)
        if t is None:
            return text
        text = t
    return text


def _suspects(text: str) -> list[tuple[int, tuple[str, ...], int]]:
    """(line number, words to search, plain words) of each line that costs anything."""
    out = []
    for i, line in enumerate(text.split("\n")):
        escaped = ("&" in line or "\\" in line or "%" in line) and _ESCAPE.search(line)
        if line.isascii():
            if not escaped:
                continue
            words = tuple(w for w in line.split() if _ESCAPE.search(w))
        else:
            words = tuple(_NON_ASCII.findall(line))
            if escaped:
                words += tuple(w for w in line.split() if w.isascii() and _ESCAPE.search(w))
        bare = _TAG.sub(" ", line)
        plain = sum(w.isascii() and any(map(str.isalpha, w)) for w in bare.split())
        if escaped or cost(words, plain, True):
            out.append((i, words, plain))
    return out


def _none(text: str | None) -> bool:
    return not text or text.isascii() and not (("&" in text or "\\" in text or "%" in text) and _ESCAPE.search(text))


def _native(words: str) -> set[str]:
    return {c for c in words if not c.isascii() and c.isalpha()}


def garbled_lines(text: str | None) -> list[tuple[int, tuple[str, ...], bool]]:
    """(line number, steps, can be mended) of each garbled line. Null, empty and pure ASCII texts without escapes have none.

    Every line that costs anything is searched. Of paths that cost the same the one that mends more lines of the text is
    taken, then the one to letters the rest of the text has. Where lines were mended, their paths are tried on the other lines
    once more, at a price for each letter the mended lines don't have.
    """
    if _none(text):
        return []
    lines = text.split("\n")
    found = []
    for i, words, plain in _suspects(text):
        hit, path, whole, ties = _line(words, plain)
        if hit:
            found.append((i, path, whole, ties))
    if not found:
        return []
    out = {i: (path, whole) for i, path, whole, _ in found}
    if any(len(ties) > 1 for *_, ties in found):
        votes: dict[tuple[str, ...], int] = {}
        for *_, ties in found:
            for _, p in ties:
                votes[p] = votes.get(p, 0) + 1
        own = set()
        for i, line in enumerate(lines):
            if i not in out and not line.isascii():
                own |= _native(line)
        for i, path, whole, ties in found:
            if len(ties) > 1:
                t, path = max(ties, key=lambda x: (votes[x[1]], sum(c in own for c in _native(x[0])), x[1] == path))
                out[i] = (path, not _LOST.search(t))
    known = sorted({p for p, _ in out.values() if p})
    if known:
        native: set[str] = set()
        for i, (p, _) in out.items():
            if p:
                native |= _native(_mended(lines[i], p))
        foreign = lambda ws: FOREIGN * sum(c not in native for w in ws for c in w if not c.isascii() and c.isalpha())
        for i, line in enumerate(lines):
            if i in out or line.isascii():
                continue
            words = tuple(_NON_ASCII.findall(line))
            now = cost(words, 0, True) + foreign(words)
            for p in known:
                t = tuple(_apply(w, p) for w in words)
                letters = lambda ws: (len("".join(ws)), sum(c.isalpha() for w in ws for c in w))
                (m, a), (n, b) = letters(words), letters(t)
                if t != words and cost(t) + foreign(t) <= now - AGAIN and (m != n or b >= a):
                    out[i] = (p, not any(map(_LOST.search, t)))
                    break
    return [(i, *out[i]) for i in sorted(out)]


def is_garbled(text: str | None) -> bool:
    """Whether any part of a text was read with a wrong encoding: whether the search mends a line, or leaves lost bytes in it."""
    return not _none(text) and any(_line(words, plain)[0] for _, words, plain in _suspects(text))


def _mended(line: str, path: tuple[str, ...]) -> str:
    whole = _apply(line, path)
    return whole if whole != line else " ".join(_apply(w, path) for w in line.split(" "))


def restore(text: str | None) -> tuple[str | None, bool]:
    """(the text with every garbled line mended where that is possible, whether all of them were)."""
    bad = garbled_lines(text)
    if not bad:
        return text, True
    lines = text.split("\n")
    for i, path, _ in bad:
        lines[i] = _mended(lines[i], path)
    return "\n".join(lines), all(w for _, _, w in bad)


def found(df, key: str, fields: tuple[str, ...]):
    """(key, field) of every text in ``fields`` with a part read in a wrong encoding, once per pair.

    Null, empty and plain ASCII texts give no row; redelivered rows give one; other columns are not read.
    """
    from pyspark.sql import functions as F

    def run(batches):
        import pandas as pd

        for b in batches:
            k, f = [], []
            for name in fields:
                hit = [is_garbled(v) if isinstance(v, str) else False for v in b[name]]
                k += list(b[key][hit])
                f += [name] * sum(hit)
            yield pd.DataFrame({key: pd.Series(k, dtype="int64"), "field": pd.Series(f, dtype="object")})

    plain = F.lit(False)
    for name in fields:
        plain = plain | F.col(name).rlike(r"[^\x00-\x7f]|&|%|\\")
    src = df.select(F.col(key).cast("bigint").alias(key), *fields).filter(plain & F.col(key).isNotNull())
    return src.mapInPandas(run, f"{key} bigint, field string").distinct()


def restored(df, key: str, fields: tuple[str, ...]):
    """(key, field, restored, whole): the mended text of every affected field; ``whole`` is false where a part
    stays lost (its bytes were replaced before it got here). Rows as in :func:`found`."""
    from pyspark.sql import functions as F

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for name in fields:
                for k, v in zip(b[key], b[name]):
                    if isinstance(v, str) and is_garbled(v):
                        t, whole = restore(v)
                        rows.append((k, name, t, whole))
            yield pd.DataFrame(rows, columns=[key, "field", "restored", "whole"]).astype({key: "int64", "whole": "bool"})

    src = df.select(F.col(key).cast("bigint").alias(key), *fields).filter(F.col(key).isNotNull())
    out = src.mapInPandas(run, f"{key} bigint, field string, restored string, whole boolean")
    return out.dropDuplicates([key, "field"])
