"""Reading and writing the stage formats: nested JSON, whole text files, feature arrays, PCM wav, media tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAN = "plan_id string, source_lang string, target_lang string, lines array<struct<i: int, text: string, translation: string>>"
FRAMES = "path string, chunk int, rate int, left array<float>, right array<float>"


def write_json(df: DataFrame, path: str) -> None:
    """One nested document a row."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str = PLAN) -> DataFrame:
    """Nested documents with a given schema; fields that are missing or of another type are null."""
    return spark.read.schema(schema).json(path)


def read_lyrics(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, text): the lines of whole text files, i from 0."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return t.select("path", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("i", "text"))


def tags(props) -> F.Column:
    """A map of text tags with keys in lower case; text that is no JSON gives an empty one."""
    m = F.from_json(props, "map<string,string>")
    return F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))


def probed(text) -> F.Column:
    """(tags, duration) of a media probe's JSON: format.tags with keys in lower case and format.duration, 0 if it is missing or no number; text that
    is no JSON has no tags and lasts 0."""
    g = F.from_json(text, "format struct<tags: map<string,string>, duration: string>")["format"]
    t = F.transform_keys(F.coalesce(g["tags"], F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    return F.struct(t.alias("tags"), F.coalesce(g["duration"].try_cast("double"), F.lit(0.0)).alias("duration"))


def read_wav(spark: SparkSession, path: str, seconds: float = 1.0) -> DataFrame:
    """(path, chunk, rate, left, right): 16-bit PCM wav files in chunks of ``seconds``; mono files give two equal sides.

    Files that are no such wav give no row. Chunks keep a song of any length out of a single row.
    """

    def run(batches):
        import io
        import wave

        import numpy as np
        import pandas as pd

        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"]):
                try:
                    with wave.open(io.BytesIO(data)) as w:
                        if w.getsampwidth() != 2:
                            continue
                        n, rate, k = w.getnchannels(), w.getframerate(), 0
                        while len(raw := w.readframes(int(rate * seconds))):
                            x = np.frombuffer(raw, "<i2").reshape(-1, n).astype("f4") / 32768
                            rows.append((p, k, rate, x[:, 0], x[:, min(1, n - 1)]))
                            k += 1
                except (wave.Error, EOFError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "chunk", "rate", "left", "right"])

    f = spark.read.format("binaryFile").load(path).select("path", "content")
    return f.mapInPandas(run, FRAMES)


def mono(df: DataFrame) -> DataFrame:
    """(path, chunk, rate, v): the mean of both sides."""
    return df.select("path", "chunk", "rate", F.zip_with("left", "right", lambda a, b: (a + b) / 2).alias("v"))
