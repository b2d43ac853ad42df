"""Look-alike text: detection, and one consistent form.

Both come from one pass over the segments of a text that are not certain to be normal. Which those are is read off the
normalization properties of characters: a character is unstable if it changes under normalization by itself (quick check "no"), if
it may compose with what is before it (quick check "maybe"), or if it is a mark. A run of unstable characters with the one character before it, the
boundary nothing composes across, is a segment; segments are normalized by themselves and spliced into the text, whose other characters stay
as they are. Invisible characters, odd blanks and words of several scripts are segments of their own kinds.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import regex

# Letters that look the same in two scripts, Latin first.
CYRILLIC_TWINS = dict(zip("aeopcyxijsABEKMHOPCTXIJSY", "аеорсухіјѕАВЕКМНОРСТХІЈЅУ"))
GREEK_TWINS = dict(zip("aopvuixktABEZHIKMNOPTYX", "αορνυιχκτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"))

WIDTH = r"！-～￠-￦"
LIGATURE = r"ﬀ-ﬆﬓ-ﬗĲĳ"
ACCENT = r"̀-ͯ᪰-᫿᷀-᷿⃐-⃢⃤-⃿︠-︯"
HIDDEN = r"­؜᠎​‌‎‏‪-‮⁠-⁤⁦-⁩﻿ᅟᅠㅤ￹-￻"
BLANK = r"   -   　"


def _scripts(prop: str) -> str:
    """Two neighbouring letters of different scripts; ``prop`` writes a script property in the dialect at hand."""
    out = []
    for s in ("Latin", "Cyrillic", "Greek"):
        one = prop.format(s)
        other = r"[\p{L}&&[^" + one + prop.format("Common") + prop.format("Inherited") + "]]"
        out += [one + r"\p{M}*" + other, other + r"\p{M}*" + one]
    return "|".join(out)


#: Java pattern: only a text that holds a match can be affected; :func:`reasons` decides. A joiner or variation sign inside an emoji is none. Java looks
#: behind by code units here, so the second half of an emoji (Cs) counts as one.
_EMOJI = r"\p{So}\p{Cs}"
JAVA = (
    f"[{WIDTH}{LIGATURE}{ACCENT}{HIDDEN}{BLANK}]"
    rf"|(?<![{_EMOJI}\p{{Sk}}\uFE0F])\u200D|\u200D(?![{_EMOJI}\u2640\u2642])"
    rf"|(?<![{_EMOJI}\p{{Sm}}\p{{Po}}\p{{Pd}}0-9#*])[\uFE00-\uFE0F]"
    "|" + _scripts(r"\p{{Is{}}}")
)

_WORD = regex.compile(r"[\p{L}\p{M}]+")
_FIRST = regex.compile(f"[{HIDDEN}]" r"|(?<![\p{So}\p{Sk}\uFE0F])\u200D|\u200D(?![\p{So}\u2640\u2642])|(?<![\p{So}\p{Sm}\p{Po}\p{Pd}0-9#*])[\uFE00-\uFE0F]")
_BLANK = regex.compile(f"[{BLANK}]")
_FORM, _ACCENT = regex.compile(f"[{WIDTH}{LIGATURE}]"), regex.compile(f"[{ACCENT}]")
_TO_LATIN = {c: a for t in (CYRILLIC_TWINS, GREEK_TWINS) for a, c in t.items()}
_LAT, _CYR, _GRE = regex.compile(r"\p{Latin}"), regex.compile(r"\p{Cyrillic}"), regex.compile(r"\p{Greek}")
_OTHER = {s: regex.compile(rf"[\p{{L}}--\p{{{s}}}--\p{{Common}}--\p{{Inherited}}]", regex.V1) for s in ("Latin", "Cyrillic", "Greek")}


@lru_cache(maxsize=1)
def properties() -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """(characters that change by themselves, those that may compose with what is before them, those of them that only change
    under the compatibility form but are kept: fractions, and accents that would become a blank with a mark)."""
    no, maybe, kept = set(), set(), set()
    for o in range(0x80, sys.maxunicode + 1):
        if 0x323B0 <= o < 0xE0000 or 0xF0000 <= o or 0xD800 <= o < 0xE000 or 0xAC00 <= o < 0xD7A4:
            continue  # unassigned, private or surrogate; Hangul syllables are composed
        c = chr(o)
        parts = unicodedata.decomposition(c)
        if parts:
            if unicodedata.normalize("NFKC", c) != c:
                no.add(c)
                if parts.startswith("<fraction>") or parts.startswith("<compat> 0020 "):
                    kept.add(c)
            elif " " in parts and parts[0] != "<":
                maybe.add(chr(int(parts.split()[-1], 16)))
        if unicodedata.combining(c):
            maybe.add(c)
    maybe |= {chr(o) for r in ((0x1161, 0x1176), (0x11A8, 0x11C3)) for o in range(*r)}
    maybe |= {c for c in no if unicodedata.normalize("NFKC", c)[0] in maybe}
    return frozenset(no), frozenset(maybe), frozenset(kept)


def _class(chars) -> str:
    """The inside of a bracketed class that holds some characters."""
    out, o = [], sorted(map(ord, chars))
    i = 0
    while i < len(o):
        j = i
        while j + 1 < len(o) and o[j + 1] == o[j] + 1:
            j += 1
        out.append(rf"\U{o[i]:08x}-\U{o[j]:08x}")
        i = j + 1
    return "".join(out)


@lru_cache(maxsize=1)
def _all() -> frozenset[str]:
    no, maybe, _ = properties()
    return no | maybe


@lru_cache(maxsize=10_000)
def _segment(present: frozenset[str]) -> regex.Pattern:
    """A segment of a text in which these unstable characters occur: unstable ones, and the one before them if they may compose with it."""
    no, maybe, kept = properties()
    own, joins = _class(present & (no - kept - maybe)), _class(present & maybe)
    begin = [f"[{own}]"] * bool(own) + [f"[^{own}][{joins}]" if own else f".[{joins}]", f"^[{joins}]"] * bool(joins)
    return regex.compile(f"(?:{'|'.join(begin)})[{own}{joins}]*" if begin else "(?!)", regex.DOTALL)


def _unstable(text: str) -> list[regex.Match]:
    """The segments of a text; most texts have no unstable character at all."""
    present = _all().intersection(text)
    return list(_segment(present).finditer(text)) if present else []


def _one_script(m: regex.Match) -> str:
    w = m[0]
    lat, cyr, gre = len(_LAT.findall(w)), len(_CYR.findall(w)), len(_GRE.findall(w))
    if (lat > 0) + (cyr > 0) + (gre > 0) < 2:
        return w
    # letters without a twin decide; a tie goes to the script with more letters
    sure = {"l": sum(bool(_LAT.match(c)) and c not in CYRILLIC_TWINS and c not in GREEK_TWINS for c in w),
            "c": sum(bool(_CYR.match(c)) and c not in _TO_LATIN for c in w),
            "g": sum(bool(_GRE.match(c)) and c not in _TO_LATIN for c in w)}
    n = {"l": lat, "c": cyr, "g": gre}
    to = max("lcg", key=lambda s: (sure[s], n[s]))
    out = []
    for c in w:
        a = _TO_LATIN.get(c, c)
        out.append(a if to == "l" else (CYRILLIC_TWINS if to == "c" else GREEK_TWINS).get(a, c))
    return "".join(out)


def segments(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, normal form) of each segment that normalization changes."""
    out = []
    kept = properties()[2]
    for m in _unstable(text):
        s = m[0]
        if m.end() < len(text) and text[m.end()] == "\uFE0F" and len(s) == 1:
            continue  # a sign shown as a picture
        # what is kept divides a segment
        if kept.isdisjoint(s):
            t = unicodedata.normalize("NFKC", s)
        else:
            t = "".join(x if x in kept else unicodedata.normalize("NFKC", x) for x in regex.split(f"([{_class(kept)}])", s))
        if t != s:
            out.append((m.start(), m.end(), t))
    return out


def _spliced(text: str, segs: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, t in segs:
        out += (text[at:a], t)
        at = b
    return "".join((*out, text[at:]))


def reasons(text: str | None) -> set[str]:
    """Why a text only looks like ordinary text: form (full-width, ligature), accent (combining), invisible, blank, scripts. Empty if it doesn't.

    Segments that change for another reason, as a sign with a compatible plain form, are no case.
    """
    if not text or text.isascii():
        return set()
    out = set()
    if _FIRST.search(text):
        out.add("invisible")
    if _BLANK.search(text):
        out.add("blank")
    for m in _unstable(text):
        if _FORM.search(m[0]):
            out.add("form")
        if _ACCENT.search(m[0]):
            out.add("accent")
    for m in _WORD.finditer(text):
        w = m[0]
        if not w.isascii() and any(p.search(w) and _OTHER[s].search(w) for s, p in (("Latin", _LAT), ("Cyrillic", _CYR), ("Greek", _GRE))):
            out.add("scripts")
            break
    return out


def canonical(text: str | None) -> str | None:
    """The one form of a text: composed letters, compatible characters as their plain ones (but for fractions and accents that stand
    alone), plain blanks, nothing invisible, one script a word.

    Null stays null, ASCII stays as it is, emoji sequences stay whole; applying it again changes nothing, and the result is always
    in normal form C.
    """
    if not text or text.isascii():
        return text
    t = text
    while True:  # what becomes plain may compose with its mark, or a letter that changes its script
        u = _BLANK.sub(" ", _FIRST.sub("", t))
        u = _spliced(u, segments(u))
        if _CYR.search(u) or _GRE.search(u):
            u = _WORD.sub(_one_script, u)
        if u == t:
            return u
        t = u


def found(lyrics, vocals):
    """(src, rec_id) of every lyric (plainlyrics) and transcript (text) that only looks like ordinary text.

    Lyrics read in a wrong encoding are left out. Null and empty texts are no cases; redelivered rows count once.
    """
    from pyspark.sql import functions as F

    from . import encoding

    def clean(batches):
        for b in batches:
            hit = [bool(reasons(t)) and not (s == "lrclib" and encoding.is_garbled(t)) for s, t in zip(b["src"], b["t"])]
            yield b.loc[hit, ["src", "rec_id"]]

    both = lyrics.select(F.lit("lrclib").alias("src"), F.col("lrclib_id").cast("bigint").alias("rec_id"), F.col("plainlyrics").alias("t")).unionByName(
        vocals.select(F.lit("scribe_vocals").alias("src"), F.col("transcript_id").cast("bigint").alias("rec_id"), F.col("text").alias("t"))
    )
    hit = both.filter(F.col("rec_id").isNotNull() & F.col("t").rlike(JAVA))
    return hit.mapInPandas(clean, "src string, rec_id bigint").distinct()


def canonical_texts(lyrics, vocals):
    """(src, rec_id, text, changed): every lyric and transcript in its one form; null texts stay null."""
    from pyspark.sql import functions as F

    def run(batches):
        for b in batches:
            t = [canonical(x) if isinstance(x, str) else None for x in b["t"]]
            b["changed"] = [x is not None and x != y for x, y in zip(t, b["t"])]
            b["text"] = t
            yield b[["src", "rec_id", "text", "changed"]]

    both = lyrics.select(F.lit("lrclib").alias("src"), F.col("lrclib_id").cast("bigint").alias("rec_id"), F.col("plainlyrics").alias("t")).unionByName(
        vocals.select(F.lit("scribe_vocals").alias("src"), F.col("transcript_id").cast("bigint").alias("rec_id"), F.col("text").alias("t"))
    )
    return both.mapInPandas(run, "src string, rec_id bigint, text string, changed boolean").dropDuplicates(["src", "rec_id"])
