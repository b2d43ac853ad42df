"""Folds over a stream that carry state from one batch to the next: transcript lines as words arrive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A line ends before a longer pause, after a final mark, or at this many words.
PAUSE, WORDS, MARKS = 0.6, 10, (".", "!", "?")
OUT = "tid bigint, i bigint, start double, end double, n bigint"
STATE = "i bigint, start double, end double, n bigint, final boolean, pos bigint"


def closed(words: pd.DataFrame, held: tuple | None) -> tuple[list[tuple], tuple]:
    """Lines that the words of one transcript, in order of pos, close, and the line that stays open, as (i, start, end, n, final, pos).
    Words at or before the last position seen were delivered before and change nothing."""
    i, start, end, n, final, last = held or (0, None, None, 0, False, -1)
    out = []
    for pos, text, s, e in words.sort_values("pos", kind="stable")[["pos", "text", "s", "e"]].itertuples(index=False):
        if pos <= last:
            continue
        if n and (s - end > PAUSE or final or n >= WORDS):
            out.append((i, start, end, n))
            i, n = i + 1, 0
        start = s if not n else start
        end, n, final, last = e, n + 1, isinstance(text, str) and text.endswith(MARKS), pos
    return out, (i, start, end, n, final, last)


def transcript_lines(words: DataFrame) -> DataFrame:
    """(tid, i, start, end, n): lines of each transcript as soon as the next word closes them; words (tid, pos, text, s, e) of a transcript arrive in
    their order, batch by batch. The state of a transcript is one open line. Null ids are left out."""

    def fold(key, batches, state: GroupState):
        held = state.get if state.exists else None
        out, held = closed(pd.concat(list(batches), ignore_index=True), held)
        state.update(tuple(held))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["tid", "i", "start", "end", "n"])

    w = words.filter("tid is not null and pos is not null and s is not null and e is not null")
    return w.groupBy("tid").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
