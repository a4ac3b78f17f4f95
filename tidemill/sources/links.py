"""Dataset links: a base, a base pinned to a content hash, or a base to be indexed anew."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Link:
    base: str
    pinned: str | None = None
    refresh: bool = False


def parsed(text: str) -> Link:
    """The last @ divides; a suffix that is neither a hash nor `refresh` belongs to the base."""
    base, at, suffix = text.rpartition("@")
    if at and suffix == "refresh":
        return Link(base, refresh=True)
    if at and suffix.startswith("sha256:"):
        if not suffix[7:].strip():
            raise ValueError("the pinned hash is empty")
        return Link(base, pinned=suffix[7:])
    return Link(text)


def intent_key(base: str) -> str:
    return "sha256_" + hashlib.sha256(base.strip().rstrip("/").encode()).hexdigest()


def checked_key(key: str) -> str:
    """key, if it can't leave the store's folder."""
    if not key.strip() or ".." in key or re.search(r"[/\\]", key):
        raise ValueError(f"not a key: {key!r}")
    return key
