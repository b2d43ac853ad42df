"""External services as functions over batches: translation, structure, speech, lookups. What is known is never asked for again."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Texts of one batch and a target language to translations.
Translate = Callable[[list[str], str], list[str]]


class Unavailable(Exception):
    """A service did not answer; ``status`` is that of its response, None if there was none."""

    def __init__(self, status: int | None = None):
        super().__init__(f"status {status}")
        self.status = status


def retrying(ask: Callable, tries: int = 4, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``ask`` tried again, after ``wait`` seconds more each time, while the service is busy (429) or failing (5xx) or gives no response.
    Other refusals, and the last failure, are raised."""

    def asked(*args, **named):
        for k in range(tries):
            try:
                return ask(*args, **named)
            except Unavailable as e:
                passing = e.status is None or e.status == 429 or 500 <= e.status < 600
                if not passing or k == tries - 1:
                    raise
                sleep(wait * (k + 1))

    return asked


def echo(texts: list[str], lang: str) -> list[str]:
    """A deterministic stand-in for a service."""
    return [f"[{lang}] {t}" for t in texts]


def complete(ask: Translate, tries: int = 3) -> Translate:
    """``ask`` repeated until it gives a translation that isn't empty for every text; an error after ``tries``."""

    def asked(texts: list[str], lang: str) -> list[str]:
        for _ in range(tries):
            out = ask(texts, lang)
            if len(out) == len(texts) and all(isinstance(x, str) and x.strip() for x in out):
                return out
        raise ValueError("a translation for every text is needed")

    return asked


def translate(lines: DataFrame, known: DataFrame, lang: str, ask: Translate = echo) -> DataFrame:
    """(key, translation) for every text of ``lines``: known ones from (key, translation), each other one asked for once.

    Null texts and texts without a word character are left out. A task that is repeated asks again for its batch only; write
    the result and pass it as ``known`` to a rerun.
    """
    texts = lines.select(T.norm(F.col("text")).alias("key"), "text").filter("key != ''").groupBy("key").agg(F.min("text").alias("text"))
    have = known.filter("key is not null and translation is not null").groupBy("key").agg(F.max("translation").alias("translation"))
    new = texts.join(have, "key", "left_anti")
    ask = complete(retrying(ask))

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"key": b["key"], "translation": ask(list(b["text"]), lang)})

    return texts.select("key").join(have, "key").unionByName(new.mapInPandas(run, "key string, translation string"))


def speak(texts: DataFrame, known: DataFrame, model: str, voice: str, ask: Callable[[str], bytes]) -> DataFrame:
    """(key, characters, audio, asked) of every text: recordings that (key, audio) has are taken from there and cost nothing; each other
    text is spoken once, however often it comes. Null texts are left out."""
    key = T.speech_key(F.lit(model), F.lit(voice), F.lit(None), F.lit(None), F.col("text"))
    t = texts.filter("text is not null").select(key.alias("key"), "text").groupBy("key").agg(F.min("text").alias("text"))
    have = known.filter("key is not null and audio is not null").groupBy("key").agg(F.max("audio").alias("audio"))
    ask = retrying(ask)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "characters": b["text"].str.len().astype("int64"), "audio": [ask(x) for x in b["text"]], "asked": True})

    old = t.join(have, "key").select("key", F.length("text").cast("bigint").alias("characters"), "audio", F.lit(False).alias("asked"))
    return old.unionByName(t.join(have, "key", "left_anti").mapInPandas(run, "key string, characters bigint, audio binary, asked boolean"))


def look_up(songs: DataFrame, known: DataFrame, ask: Callable[[str, str | None], str | None]) -> DataFrame:
    """(title, artist, answer) of every song with a title: known answers are kept, others asked for once; a service that stays away answers
    nothing (null), and that is not kept as known."""
    s = songs.filter("title is not null and trim(title) != ''").select("title", F.coalesce("artist", F.lit("")).alias("artist")).distinct()
    have = known.filter("answer is not null").groupBy("title", F.coalesce("artist", F.lit("")).alias("artist")).agg(F.max("answer").alias("answer"))
    ask = retrying(ask)

    def one(title: str, artist: str) -> str | None:
        try:
            return ask(title, artist or None)
        except Unavailable:
            return None

    def run(batches):
        for b in batches:
            yield b[["title", "artist"]].assign(answer=[one(t, a) for t, a in zip(b["title"], b["artist"])])

    return s.join(have, ["title", "artist"]).unionByName(s.join(have, ["title", "artist"], "left_anti").mapInPandas(run, "title string, artist string, answer string"))


def structure(n: int, ask: Callable[[], list[tuple[str, list[int]]]], tries: int = 3) -> list[tuple[str, list[int]]] | None:
    """Labelled segments of n lines that hold each line once and in order, asked for up to ``tries`` times; None if no answer does."""
    from ..operators.sections import covers

    for _ in range(tries):
        out = sorted(ask(), key=lambda x: x[1][:1])
        if covers(out, n):
            return out
    return None
