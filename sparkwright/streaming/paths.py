"""Paths that file streams read."""

from __future__ import annotations


def pattern(path: str) -> str:
    """The path as a pattern that it alone matches: a file stream takes a plain path for a folder, but a pattern for a single file, too."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") or not path else f"{path[:-1]}[{path[-1]}]"
