"""Token counts by a public tokenizer. Its vocabulary file is a parameter and is read where it lies."""

from __future__ import annotations

import base64
import math
import os
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks file of a byte-level BPE; every executor needs it at this place.
VOCABULARY = os.environ.get("STROPHE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that cuts a text into pieces before this vocabulary is applied.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text; none for null and empty ones. A very long text is counted in whole."""
    return len(encoder(path).encode_ordinary(text)) if text else 0


_BULLET = re.compile(r"^\s*(?:[-*•»·–—]|\d+[.)])\s")
_SYMBOL = re.compile(r"[#|<>{}\\^~=_�]|\.{3}|…|https?:|www\.")
_END = tuple(".!?:;”»\"')")


def _within(x: float, lo: float, hi: float, zero_lo: float, zero_hi: float) -> float:
    """1 from lo to hi, falling in a line to 0 at zero_lo and zero_hi."""
    if lo <= x <= hi:
        return 1.0
    return max(0.0, (x - zero_lo) / (lo - zero_lo)) if x < lo else max(0.0, (zero_hi - x) / (zero_hi - hi))


def quality(text: str | None) -> float:
    """A weight from 0.05 to 1: the geometric mean of measures of running text, each from 0 to 1.

    The share of words with a letter, their usual length, signs of markup and links a word, lines that are list items, lines that end as sentences do, lines
    and words said again, and length. One bad measure pulls the weight down however good the others are.
    """
    words = text.split() if text else []
    if not words:
        return 0.05
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = Counter(w.lower() for w in words)
    many = sum(c for w, c in kinds.items() if len(w) > 3 and c > max(3, 0.02 * n))
    measures = (
        _within(sum(any(map(str.isalpha, w)) for w in words) / n, 0.8, 1.0, 0.3, 2.0),
        _within(sum(map(len, words)) / n, 3.5, 9.0, 1.0, 16.0),
        _within(len(_SYMBOL.findall(text)) / n, 0.0, 0.02, -1.0, 0.3),
        _within(sum(_BULLET.match(x) is not None for x in lines) / len(lines), 0.0, 0.3, -1.0, 1.1),
        _within(sum(x.rstrip().endswith(_END) for x in lines) / len(lines), 0.3, 1.0, -0.3, 2.0),
        _within(1 - len(set(lines)) / len(lines), 0.0, 0.1, -1.0, 0.8),
        _within(many / n, 0.0, 0.3, -1.0, 1.0),
        _within(n, 50, 1e12, -20, 2e12),
    )
    return round(min(1.0, max(0.05, math.prod(max(m, 0.02) for m in measures) ** (1 / 3))), 4)


def counted(docs: DataFrame, *keep: str, weigh: bool = False, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, kept columns..., tokens[, weight]) of every document."""
    import pandas as pd

    def run(batches):
        for b in batches:
            out = b.drop(columns="text")
            out["tokens"] = pd.Series([count(t if isinstance(t, str) else None, path) for t in b["text"]], index=b.index, dtype="int64")
            if weigh:
                out["weight"] = [quality(t if isinstance(t, str) else None) for t in b["text"]]
            yield out

    src = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), *keep, "text")
    schema = ", ".join(f"`{n}` {t}" for n, t in src.dtypes if n != "text") + ", tokens bigint" + ", weight double" * weigh
    return src.mapInPandas(run, schema)
