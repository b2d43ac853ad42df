"""Pages of repeated keywords, links, headings of other pages or product tags.

Two kinds of evidence have to meet. List density: a text is cut into parts, and those without sentences (by their function
words) are lists; lists that are a document's own (numerals, references, sequences, values, figures) are none. Replication: the
items of lists become phrases, shingles of at most SHINGLE words in which links, tags, prices and numbers stand for themselves, and the phrases of
every page are counted by the distinct hosts (applicants, else sources) whose pages have them, each also with one or two words left open, as an
item may carry a name or a choice of words that no other page has (lists of links, prices and the like also by their form alone). A list is stitched where most of its items have a phrase of HOSTS or more hosts; a
page is spam if stitched lists, and bare phrases it repeats itself, are more than SHARE of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import cache
from itertools import combinations

import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import FAR, ranges

#: Longest shingle of a phrase in words, share of a page that makes it a case.
SHINGLE, SHARE = 5, 0.5
#: Distinct hosts that make a phrase replicated, share of replicated items that makes a part stitched.
HOSTS, STITCHED = 3, 0.5
#: Parts into which a phrase that much of the collection has is split where pages look up its hosts.
SALTS = 8
#: Least share of function words in prose.
PROSE = 0.07

# Function words of the languages patents are written in.
FUNCTION = frozenset(
    "the a an of is and to in which that from one at by with be can has have as it on for so when between are or than into its may each not without before after while "
    "der die das den dem des ein eine einer einem eines und ist zu in an auf mit von für wird werden als so nicht sich durch nach bei aus um über oder bis wenn einen wobei nach daß dass "
    "le la les l un une des du de d et est à au aux en que qui dans sur par pour se ne pas avec sans plus ou lorsque entre selon être sont ce cette son sa "
    "el los las del al y es una unos por para con se no que su sin más o cuando entre según ser son como lo este esta".split()
)
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:['’_-][\p{L}\p{N}]+)*")
_PLAIN = re.compile("[A-Za-z0-9]+(?:['_-][A-Za-z0-9]+)*")
#: A heading of a patent's own, alone on its line.
_HEADING = regex.compile(r"^[\p{Lu}\s]{4,40}$")
_LINK = regex.compile(r"\[[^\]\n]*\]\([^)\n]*\)|https?://\S+|\bwww\.\S+|(?<![\w.@])[\w-]{2,}(?:\.[\w-]{2,})*\.\p{Ll}{2,10}(?![\w.])(?:/\S*)?")
_TAG = regex.compile(r"#\p{L}[\p{L}\p{N}_]{2,}|(?<![\w/])\p{L}[\p{L}_]+:[\p{L}\p{N}_](?!//)[^\s,;|]*")
_PRICE = regex.compile(r"\d+[.,]\d\d ?(?:\p{Sc}|[A-Z]{3}\b)|\p{Sc} ?\d+(?:[.,]\d+)?")
_PATH = regex.compile(r"[»›]|\(\d{1,4}\)\s*(?:[;|,-]|$)|\s(?:>|::|→)\s")
_OWN_OF = (
    r"\b(?:FIG|Fig|Abb|Figura?|figure|Figur|figura|Tab|Table|Tabelle|Tableau|Tabla)\.?\s*\d+|\b[A-Z]{2}[ -]?\d{5,}(?: ?[A-Z]\d?)?\b|\b[acgtun]{8,}\b|\b[ACGTUN]{8,}\b|\b(?:SEQ ID|INT\. CL|IPC)\b|\[\d{4}\]"
)
_NUMBER_OF = r"(?<![\p{L}\d])\d+(?:[.,]\d+)*(?![\p{L}\d])"
_OWN, _NUMBER = regex.compile(_OWN_OF), regex.compile(_NUMBER_OF)
# the same for texts of ASCII, in the faster module
_PLAIN_OWN, _PLAIN_NUMBER = re.compile(_OWN_OF), re.compile(_NUMBER_OF.replace(r"\p{L}", "A-Za-z"))
_UPPER = regex.compile(r"\p{Lu}")
#: What links, tags, prices and paths have; sentences without any need no closer look.
_MARKS = ":»›#$€£¥["
_MONEY, _WAYS = set("$€£¥"), set("»›:")


@cache
def _near() -> tuple[re.Pattern, re.Pattern]:
    """(end of a sentence and the blanks before the next one, _WORD) for the characters below 65,536, in the faster module."""
    ln = ranges(r"[\p{L}\p{N}]")
    return re.compile(rf"[.!?][{ranges(r'\s')}]+(?=[\[{ranges(r'\p{Lu}')}\U00010000-\U0010ffff])"), re.compile(rf"[{ln}]+(?:['’_-][{ln}]+)*")


def pieces(text: str) -> list[str]:
    """A text cut at the ends of lines, and of sentences before a capital or a bracket."""
    ends = _near()[0].finditer
    out = []
    for line in text.split("\n"):
        at = 0
        for m in ends(line):
            if (c := line[m.end()]) > "\uffff" and not _UPPER.match(c):
                continue
            out.append(line[at : m.start() + 1])
            at = m.end()
        out.append(line[at:] if at else line)
    return out


def words(text: str) -> list[str]:
    """The words of a text, as _WORD finds them."""
    if text.isascii():
        return _PLAIN.findall(text)
    return (_WORD if FAR.search(text) else _near()[1]).findall(text)


def parts(text: str) -> list[tuple[str, str]]:
    """(kind, part) of a text in order; kind is prose, evident, own or bare."""
    marks = [c for c in _MARKS if c in text]
    return [(kind(x, marks), x) for seg in pieces(text) if (x := seg.strip())]


#: What a link has: its brackets, how it begins, or a point before two small letters.
_POINT = re.compile("\\.[a-z\x80-\U0010ffff]{2}")


def may_link(seg: str) -> bool:
    """Whether _LINK could match: a condition it can't do without."""
    return "://" in seg or "](" in seg or "www." in seg or _POINT.search(seg) is not None


_DIGIT = re.compile(r"\d")
#: Digits, and the characters of which the two modules know different ones.
_MAY_COUNT = re.compile("[\\d\U00010000-\U0010ffff]")


def kind(seg: str, marks: Iterable[str] = _MARKS) -> str:
    """The kind of a part; ``marks`` are those of _MARKS that its text has."""
    ws = seg.lower().split()
    n = len(ws)
    f = sum(map(FUNCTION.__contains__, ws))
    prose = n >= 4 and f >= max(1, (PROSE if n >= 14 else 2 * PROSE) * n) and (f >= 2 or n < 14)
    dot = seg.find(".")
    dotted = -1 < dot < len(seg) - 2
    signs = {c for c in marks if c in seg}
    if prose and not signs and not dotted:
        return "prose"
    digits = _DIGIT.search(seg) is not None
    # each pattern only where what it needs is there
    marked = prices = 0
    if (dotted or "[" in signs) and may_link(seg):
        marked += sum(len(m[0]) for m in _LINK.finditer(seg))
    if "#" in signs or ":" in signs:
        marked += sum(len(m[0]) for m in _TAG.finditer(seg))
    if digits and (dotted or "," in seg or signs & _MONEY):
        found = [len(m[0]) for m in _PRICE.finditer(seg)]
        marked, prices = marked + sum(found), len(found)
    if marked * 3 >= len(seg) or prices and prices * 60 >= len(seg):
        return "evident"
    if signs & _WAYS or "(" in seg or ">" in seg or "→" in seg:
        paths = len(_PATH.findall(seg))
        if paths and paths * 40 >= len(seg):
            return "evident"
    if prose:
        return "prose"
    n = len(words(seg))
    if not n:
        return "own"
    number, of = (_PLAIN_NUMBER, _PLAIN_OWN) if seg.isascii() else (_NUMBER, _OWN)
    numbers = len(number.findall(seg)) if digits else 0
    own = sum(len(m[0]) for m in of.finditer(seg))
    if own * 3 >= len(seg) or (numbers >= 1 and numbers * 4 >= n) or own and n <= 8:
        return "own"
    if n <= 4 and _HEADING.match(seg):
        return "own"
    return "bare"


#: What stands for a link, a price, a tag and a number, whatever they say; an item ends with a link or a price.
LINK, PRICE, TAG, NUMBER = map(chr, range(0xE001, 0xE005))
_SHAPES = (
    (lambda seg: "](" in seg, regex.compile(r"\[([^\]\n]*)\]\([^)\n]*\)"), rf" \1 {LINK} | "),
    (may_link, _LINK, f" {LINK} | "),
    (_MAY_COUNT.search, _PRICE, f" {PRICE} | "),
    (lambda seg: "#" in seg or ":" in seg, _TAG, f" {TAG} "),
    (_MAY_COUNT.search, regex.compile(r"(?:\p{L}+-)?\d[\d.,]*"), f" {NUMBER} "),
)
_ITEMS = regex.compile(rf"[|;,•·\n!?]+|\.(?=\s|$)|\s[-–—*»]\s|(?<=\))\s|(?<={NUMBER})\s+(?=\p{{L}})|^\W+(?=\w)")
_SHAPED = regex.compile(rf"\p{{L}}+(?:['’_-]\p{{L}}+)*|[{LINK}-{NUMBER}]")


def items(seg: str) -> list[list[str]]:
    """The items of a list part as words; links, prices, tags and numbers are one sign each, whatever they say."""
    # each pattern only where what it needs is there
    for needs, p, to in _SHAPES:
        if needs(seg):
            seg = p.sub(to, seg)
    return [w for i in _ITEMS.split(seg.lower()) if i and (w := _SHAPED.findall(i))]


def phrases(item: list[str], bare: bool = True) -> list[str]:
    """The phrases of an item: its shingle, or all of SHINGLE words of a longer one, each also with one or two words left
    open while two others remain; unless the item is bare, also with all of its words left open, which leaves its form."""
    out = []
    for k in range(max(1, len(item) - SHINGLE + 1)):
        w = item[k : k + SHINGLE]
        out.append(" ".join(w))
        at = [i for i, x in enumerate(w) if x < LINK]
        if not bare and 0 < len(at) < len(w):
            out.append(" ".join("*" if x < LINK else x for x in w))
        for n in (1, 2):
            if len(w) - n >= 2:
                out += [" ".join("*" if i in o else x for i, x in enumerate(w)) for o in combinations(at, n)]
    return out


def repeats(bare: str) -> float:
    """Share of the words of a page's bare parts that come at least three times in them."""
    ws = [w.lower() for w in words(bare)]
    c = Counter(ws)
    return sum(n for n in c.values() if n >= 3) / len(ws) if len(ws) >= 12 else 0.0


_ITEM = regex.compile(r"^\W*(?:\p{L}[\p{L}'’_-]*\s+){1,4}?(\p{L}[\p{L}'’_-]*)\s+#?\d{1,6}\W*$")
_LIST = regex.compile(r"[|;,•·\n]+|\s[-–—*]\s")


def catalogue(own: list[str], prose: list[str]) -> list[str]:
    """The parts that are lists of numbered articles: six or more items that end in a name and a number, the names
    differing from item to item and hardly ever met in the page's prose, as the parts of a patent's own list are."""
    names, out = [], []
    for seg in own:
        each = [i for i in _LIST.split(seg) if i.strip()]
        hits = [m[1].lower() for i in each if (m := _ITEM.match(i))]
        if hits and 2 * len(hits) >= len(each):
            names += hits
            out.append(seg)
    if len(names) < 6 or len(set(names)) < 0.7 * len(names):
        return []
    told = {w.lower() for s in prose for w in words(s)}
    return out if sum(n in told for n in names) <= 0.3 * len(names) else []


def measure(text: str | None) -> tuple[int, float, list[tuple[bool, int, list[tuple[int, list[str]]]]]]:
    """(characters, share of repeated words in bare parts, lists) of a text; a list is (is bare, characters, [(times, phrases) of each item]).

    Lists of one kind and of few items are taken together, as links or keywords often stand alone on their lines.
    """
    if not text:
        return 0, 0.0, []
    ps = parts(text)
    total = sum(len(s) for _, s in ps)
    own = [s for k, s in ps if k == "own"]
    evident = [s for k, s in ps if k == "evident"]
    if sum(map(len, own)) > 100:
        evident += catalogue(own, [s for k, s in ps if k == "prose"])
    bare = [s for k, s in ps if k == "bare"]
    lists = []
    for is_bare, segs in ((False, evident), (True, bare)):
        for group in grouped(segs):
            c = Counter(tuple(i) for s in group for i in items(s))
            lists.append((is_bare, sum(map(len, group)), [(n, phrases(list(i), is_bare)) for i, n in c.items()]))
    return total, repeats("\n".join(bare)), lists


#: Characters that are judged together at least.
TOGETHER = 400


def grouped(segs: list[str]) -> list[list[str]]:
    """Parts in order in groups of TOGETHER characters or more."""
    out: list[list[str]] = []
    room = 0
    for s in segs:
        if room <= 0:
            out.append([])
            room = TOGETHER
        out[-1].append(s)
        room -= len(s)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, host, total, repeated, lists, phrase, at, item) of every document: its lists as (number, bare, characters, items), and
    the hash of each phrase with the number of its list and its item.

    Every phrase of every list is listed, however little of its page it is: it counts for its host.
    """
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for i, h, t in zip(b["doc_id"], b["host"], b["text"]):
                total, rep, lists = measure(t if isinstance(t, str) else None)
                ph, at, item, times, k = [], [], [], [], 0
                for j, (_, _, its) in enumerate(lists):
                    for n, phs in its:
                        for x in set(phs):
                            ph.append(xxhash.xxh64_intdigest(x) - (1 << 63))
                            at.append(j)
                            item.append(k)
                            times.append(n)
                        k += 1
                rows.append((i, h, total, rep, [x[0] for x in lists], [x[1] for x in lists], [sum(n for n, _ in x[2]) for x in lists], ph, at, item, times))
            yield pd.DataFrame(rows, columns=["doc_id", "host", "total", "repeated", "bare", "chars", "items", "phrase", "at", "item", "times"])

    src = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("applicant", "source", F.lit("")).alias("host"), "text")
    return src.mapInPandas(
        run, "doc_id bigint, host string, total bigint, repeated double, bare array<boolean>, chars array<bigint>, items array<bigint>, phrase array<bigint>, at array<int>, item array<int>, times array<bigint>"
    )


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, listed, stitched, repeated, density, spam) of every document; shares of its characters.

    ``listed`` is the share of lists, ``stitched`` that of lists most items of which have a phrase on pages of HOSTS or more
    hosts, ``repeated`` the share of repeated words in bare parts; ``density``, stitched lists and bare parts the page repeats, decides.
    Null and empty texts have shares of 0 and are no spam. Phrases are counted once a host before they are counted over hosts, and pages
    look up replicated phrases in SALTS parts, so a phrase that much of the collection has is no hot key.
    """
    from ..session import cut

    m = cut(measured(docs))
    e = m.filter("size(phrase) > 0").select("doc_id", "host", F.explode(F.arrays_zip("phrase", "at", "item", "times")).alias("p")).select("doc_id", "host", "p.*")
    hosts = e.select("phrase", "host").distinct().groupBy("phrase").agg(F.count(F.lit(1)).alias("hosts")).filter(F.col("hosts") >= HOSTS)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    common = hosts.select("phrase", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = e.withColumn("salt", salt).join(common, ["phrase", "salt"]).groupBy("doc_id", "at", "item").agg(F.max("times").alias("times"))
    j = met.groupBy("doc_id", "at").agg(F.sum("times").alias("met"))
    lists = m.select("doc_id", "total", "repeated", F.posexplode_outer(F.arrays_zip("bare", "chars", "items")).alias("at", "l")).select("doc_id", "total", "repeated", "at", "l.*").dropDuplicates(["doc_id", "at"])
    x = lists.join(j, ["doc_id", "at"], "left")
    stitched = F.coalesce(F.col("met") >= STITCHED * F.col("items"), F.lit(False))
    counts = stitched | (F.col("bare") & (F.col("repeated") >= STITCHED))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.coalesce(F.sum(c), F.lit(0)), F.max("total")), F.lit(0.0)), 6)
    out = x.groupBy("doc_id").agg(
        share(F.col("chars")).alias("listed"), share(F.when(stitched, F.col("chars"))).alias("stitched"), F.round(F.max("repeated"), 6).alias("repeated"), share(F.when(counts, F.col("chars"))).alias("density")
    )
    return out.withColumn("spam", F.col("density") > SHARE)


def found(docs: DataFrame) -> DataFrame:
    """(doc_id,): pages that by more than half of their characters are repeated keywords, links, headings or tags."""
    return scored(docs).filter("spam").select("doc_id").distinct()
