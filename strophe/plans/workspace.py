"""Where the stages of an item lie: those that don't depend on the languages once for each item, the others for each pair of languages."""

from __future__ import annotations

# Stages all languages of an item share.
SHARED = ("stems", "transcript", "lyrics", "loops", "features")


def folder(root: str, item: str, source: str, target: str, explicit: str | None = None) -> str:
    """The folder of an item for a pair of languages; one that was given explicitly is never redirected."""
    return explicit.rstrip("/") if explicit else f"{root.rstrip('/')}/{item}/{source}-{target}"


def home(root: str, item: str, name: str, source: str, target: str, explicit: str | None = None) -> str:
    """Where a stage of an item lies: a shared one beside the folders of all languages, so that a new language finds it there and nothing
    is copied."""
    at = folder(root, item, source, target, explicit)
    return at if explicit or name not in SHARED else f"{root.rstrip('/')}/{item}"
