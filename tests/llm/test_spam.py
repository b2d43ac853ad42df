from strophe.llm import spam

PATENT = "The flexible rotor 10 is mounted on the bearing 112 and extends along its longitudinal axis. As shown in FIG. 3, the valve engages the housing when pressure rises above 16 kPa. "
OWN = "\n".join(["10 rotor", "112 bearing", "FIG. 3: valve", "YV 2152290 B2 (Fenkirbo)", "71.6 | 509 | flexible", "ggcagatttt gggacactct gctacagggc"])
NAMES = [a + b + c for a in ("lusk", "dar", "zel", "mor") for b in ("gren", "wick", "fi", "mor") for c in ("bo", "tir", "ka")]


def spam_page(kind, k):
    """A page of one kind; k varies its names and numbers, so that no two pages share them."""
    n = NAMES[k:] + NAMES[:k]
    return {
        "links": "\n".join(f"https://shop.{n[i]}x{i}.example/a/b{i}" for i in range(20)),
        "tags": " | ".join(f"tag:{n[i]} cat:cheap sku:{i * k}" for i in range(30)),
        "hash": ", ".join(f"#{n[i]}cheap{i}" for i in range(30)),
        "prices": " - ".join(f"LENS XAN-{i * k} {i},99 EUR" for i in range(30)),
        "words": "valve cheap hinge quality valve bearing hinge bracket cheap valve rotor cheap bracket rotor valve hinge cheap quality rotor bracket valve hinge bearing cheap " * 4,
        "catalogue": "\n".join(f"Drive belt {n[i]} {100 + i}" for i in range(14)),
        "paths": "\n".join(f"valve {n[i]} › supplier › www.{n[i + 1]}.test" for i in range(15)),
    }[kind]


KINDS = ("links", "tags", "hash", "prices", "words", "catalogue", "paths")


def flags(spark, docs, hosts=4):
    df = spark.createDataFrame([(i, t, "h%d" % (i % hosts), "s", 1) for i, t in docs], "doc_id bigint, text string, applicant string, source string, total int")
    return {r.doc_id for r in spam.found(df).collect()}


def test_kinds(spark):
    docs = [(4 * j + k, spam_page(kind, k)) for j, kind in enumerate(KINDS) for k in range(4)]
    links = spam_page("links", 1)
    docs += [(100, PATENT * 5), (101, PATENT * 3 + "\n" + OWN), (102, None), (103, ""), (104, "Valve / bracket"), (105, PATENT * 9 + "\n" + links[:300]), (106, PATENT + "\n" + links * 2)]
    assert flags(spark, docs) == set(range(4 * len(KINDS))) | {106}


def test_hosts_decide(spark):
    """The same pages of one host: no list is stitched from what others have, and only repetition on the page remains."""
    docs = [(4 * j + k, spam_page(kind, k)) for j, kind in enumerate(KINDS) for k in range(4)]
    assert flags(spark, docs, hosts=1) == {i for i, _ in docs if KINDS[i // 4] == "words"}


def test_own_lists_are_no_case(spark):
    docs = [(i, PATENT + "\n" + "\n".join([OWN] * 6)) for i in range(6)]
    assert flags(spark, docs) == set()


def test_long_and_repeated(spark):
    w = spam_page("words", 0)
    assert flags(spark, [(1, w * 400), (1, w * 400), (2, PATENT * 2000)]) == {1}


def test_hot_phrase(spark):
    """One phrase on every page."""
    docs = [(i, "\n".join(["https://a.example/x"] * 10)) for i in range(200)]
    assert flags(spark, docs) == set(range(200))


def test_empty(spark):
    assert flags(spark, []) == set()
    rows = [(None, "x", None, None), (1, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, applicant string, source string")
    assert [tuple(r) for r in spam.scored(df).collect()] == [(1, 0.0, 0.0, 0.0, 0.0, False)]


def test_replicated_phrases(spark):
    """Bare phrases without repetition on the page count where pages of other hosts have them, not otherwise."""
    page = "\n".join(f"alpha{i} beta{i} gamma{i}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(40))
    own = "\n".join(f"delta{i} epsilon{i} zeta{i}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(40))
    assert flags(spark, [(0, page), (1, page), (2, page), (7, own)]) == {0, 1, 2}


def test_few_phrases_count_for_their_hosts(spark):
    """A page is stitched from phrases that other hosts hold among much prose."""
    page = "\n".join(f"alpha{c} beta{c} gamma{c}" for c in "abcdefghijklmnopqrstuvwxyz")
    docs = [(0, page), (1, PATENT * 80 + "\n" + page), (2, PATENT * 80 + "\n" + page)]
    assert flags(spark, docs) == {0}


def test_brute_force(spark, data):
    """Scores of the test tables as a plain count over all pages gives them."""
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: (r.applicant or r.source or "", r.text) for r in df.select("doc_id", "applicant", "source", "text").collect()}
    m = {i: spam.measure(t) for i, (_, t) in rows.items()}
    hosts = {}
    for i, (h, _) in rows.items():
        for _, _, its in m[i][2]:
            for _, phs in its:
                for x in phs:
                    hosts.setdefault(x, set()).add(h)
    want = set()
    for i, (total, rep, lists) in m.items():
        n = 0
        for bare, chars, its in lists:
            met = sum(k for k, phs in its if any(len(hosts[x]) >= spam.HOSTS for x in phs))
            n += chars if its and met >= spam.STITCHED * sum(k for k, _ in its) or bare and rep >= spam.STITCHED else 0
        if total and n > spam.SHARE * total:
            want.add(i)
    assert {r.doc_id for r in spam.found(df).collect()} == want and want


CUTS = [
    "End. Next [0001] x. [2] y! é. École? \x1cA.\x85B.  C. d", "a.\n\nB.\r\nC. \n d.\x0bE", "。Ω. Ω. я. Я. ½ x²y it’s a_b-c'd", "𝐀. 𝐀b. 𝐚 . 𞤀 𐐷𐐀.x", "", " . \n", "?!. Foo...Bar ... Baz",
]


def test_faster_patterns_equal_the_named_ones():
    import regex

    cut = regex.compile(r"\n+|(?<=[.!?])\s+(?=\p{Lu}|\[)")
    for t in [*CUTS, PATENT, OWN, *(spam_page(k, 1) for k in KINDS)]:
        assert [x.strip() for x in spam.pieces(t) if x.strip()] == [x.strip() for x in cut.split(t) if x.strip()]
        assert spam.words(t) == spam._WORD.findall(t)
        assert not spam._LINK.search(t) or spam.may_link(t)
        for seg in spam.pieces(t):
            assert spam.kind(seg) == spam.kind(seg, [c for c in spam._MARKS if c in t])
            if seg.isascii():
                assert spam._PLAIN_NUMBER.findall(seg) == spam._NUMBER.findall(seg)
                assert [m[0] for m in spam._PLAIN_OWN.finditer(seg)] == [m[0] for m in spam._OWN.finditer(seg)]


def test_patterns_are_tried_only_where_they_could_match(monkeypatch):
    """The pattern of links, the slowest, on pages with points, numbers and brackets but no link."""
    tried = []

    class Counted:
        def __init__(self, p):
            self.finditer = lambda seg: tried.append(seg) or p.finditer(seg)

    monkeypatch.setattr(spam, "_LINK", Counted(spam._LINK))
    want = spam.measure(PATENT * 3 + "\n16.5 kPa at 3.25 V [0012] of the valve. [0013] The rotor\n" + OWN)
    assert tried == [] and want[0] > 0
    assert spam.kind("see www.luskgren.example now") == "evident" and len(tried) == 1
