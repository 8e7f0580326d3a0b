"""Checks of the arguments that callers pass in from outside; a bad one raises ValueError."""

from __future__ import annotations

# The kinds that requests may name, and the limits of their numbers.
SOURCE_TYPES = ("file", "url", "text", "stream")
ACTIONS = ("modify", "create", "delete")
SUMMARY_TYPES = ("extractive", "abstractive", "hierarchical", "custom")
LIMITS = {
    "max_context_tokens": (1, 32768),
    "min_completeness": (0.0, 1.0),
    "dependency_depth": (1, 5),
    "temperature": (0.0, 2.0),
    "max_summary_tokens": (1, 8192),
}


def within(name: str, value: float) -> float:
    low, high = LIMITS[name]
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in {low} .. {high}, not {value}")
    return value


def one_of(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def not_empty(name: str, value: str | None) -> str:
    if not value:
        raise ValueError(f"{name} must not be empty")
    return value


def context_request(query: str, max_tokens: int = 4096, min_completeness: float = 0.9, dependency_depth: int = 2) -> dict:
    return {
        "query": not_empty("query", query), "max_tokens": within("max_context_tokens", max_tokens),
        "min_completeness": within("min_completeness", min_completeness), "dependency_depth": within("dependency_depth", dependency_depth),
    }


def summary_request(content: str, summary_type: str = "abstractive", temperature: float = 0.2, max_tokens: int = 1024) -> dict:
    return {
        "content": not_empty("content", content), "summary_type": one_of("summary_type", summary_type, SUMMARY_TYPES),
        "temperature": within("temperature", temperature), "max_tokens": within("max_summary_tokens", max_tokens),
    }


def update_request(action: str, file: str, content: str | None = None) -> dict:
    return {"action": one_of("action", action, ACTIONS), "file": not_empty("file", file), "content": content}
