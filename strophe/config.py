"""Tunables with their defaults, in seconds, dB, bars or lines as their names say. None stands for "not asked for"."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

# The names of settings and what they are unless given.


@dataclass(frozen=True)
class Settings:
    # languages and lyrics
    source_lang: str = "en"
    target_lang: str = "fr"
    lyrics_file: str | None = None
    no_lookup: bool = False
    llm_model: str | None = None
    device: str | None = None
    # sections
    section_mode: str = "llm"
    section_gap: float = 6.0
    min_lines: int = 4
    max_lines: int = 8
    max_song_seconds: float = 35.0
    repeats: str = "teach"
    # excerpts of the song
    song_preroll: float = 2.0
    song_tail: float = 1.5
    song_fade_in: float = 0.3
    song_fade_out: float = 1.5
    song_gain_db: float = -2.0
    # spoken intro and outro
    intro: str | None = None
    intro_lang: str = "target"
    intro_bars: int = 2
    intro_swell_db: float = 10.0
    outro: str | None = None
    outro_lang: str = "target"
    outro_gap: float = 1.0
    # pictures
    video: bool = False
    video_size: str = "1280x720"
    video_fps: int = 10
    video_font: str | None = None
    # hand-over between loop and song
    swell_bars: float = 1.0
    transition_bars: float = 1.0
    entry_lookback: float = 8.0
    settle_bars: float = 1.0
    plain_entry: bool = False
    # loops
    loop_bars: int = 4
    loop_start: float | None = None
    loop_crossfade: float = 0.4
    loop_vfree_db: float | None = None
    loop_loudness_tol: float = 4.0
    beats_per_bar: int = 4
    # levels
    bed_db: float = -17.0
    duck_db: float = -7.0
    duck_hold: float = 0.25
    voice_level_db: float = -21.0
    learn_gain_db: float = 4.9
    ceiling_db: float = -1.0
    bitrate: str = "192k"
    # timing of what is spoken
    lead_in: float = 2.0
    gap_lang: float = 0.45
    gap_line: float = 0.9
    learn_tail: float = 0.5
    gap_to_song: float = 0.4
    gap_section: float = 0.6
    trim_db: float = 35.0
    # voices
    tts_model: str | None = None
    voice_gender: str = "male"
    src_voice: str | None = None
    dst_voice: str | None = None
    tts_speed: float | None = None
    tts_stability: float | None = None

    @classmethod
    def of(cls, given: dict) -> "Settings":
        """Only known names are taken; a null keeps the default."""
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in names and v is not None})


def arguments(p: argparse.ArgumentParser) -> None:
    """A flag for every setting; flags that are not given are None, which :meth:`Settings.of` takes for "not asked for"."""
    for f in fields(Settings):
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            p.add_argument(flag, action="store_true", default=None)
        else:
            kind = next((t for t in (int, float) if f.type.split(" ")[0] == t.__name__), str)
            p.add_argument(flag, type=kind, default=None, metavar=kind.__name__.upper())
