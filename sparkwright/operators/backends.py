"""Language models behind one interface. Nothing here opens a connection: a remote backend gets a transport, a callable
from (path, payload) to the parsed answer or, for streams, to an iterator of parsed events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

from sparkwright.operators.summarize import echo_generator

Transport = Callable[[str, dict], Any]


class Backend(Protocol):
    name: str

    def generate(self, prompt: str, temperature: float = 0.2, max_tokens: int = 1024) -> str: ...

    def stream(self, prompt: str, temperature: float = 0.2, max_tokens: int = 1024) -> Iterator[str]: ...

    def healthy(self) -> bool: ...


@dataclass
class EchoBackend:
    """The stand-in without a model: its stream gives the words of the whole answer."""

    name: str = "echo"

    def generate(self, prompt: str, temperature: float = 0.2, max_tokens: int = 1024) -> str:
        return echo_generator(prompt)

    def stream(self, prompt: str, temperature: float = 0.2, max_tokens: int = 1024) -> Iterator[str]:
        for i, word in enumerate(self.generate(prompt, temperature, max_tokens).split(" ")):
            yield word if not i else " " + word

    def healthy(self) -> bool:
        return True


@dataclass
class ChatBackend:
    """Chat completions: a list of messages in, choices with a message (or, in a stream, deltas) out."""

    model: str
    transport: Transport
    system: str = "You are a careful technical writer."
    name: str = "chat"

    def _payload(self, prompt: str, temperature: float, max_tokens: int, stream: bool) -> dict:
        messages = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
        return {"model": self.model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens, "stream": stream}

    def generate(self, prompt: str, temperature: float = 0.2, max_tokens: int = 1024) -> str:
        return self.transport("/chat/completions", self._payload(prompt, temperature, max_tokens, False))["choices"][0]["message"]["content"] or ""

    def stream(self, prompt: str, temperature: float = 0.2, max_tokens: int = 1024) -> Iterator[str]:
        for event in self.transport("/chat/completions", self._payload(prompt, temperature, max_tokens, True)):
            part = event["choices"][0].get("delta", {}).get("content")
            if part:
                yield part

    def healthy(self) -> bool:
        try:
            self.transport("/models", {})
        except Exception:  # whatever a client raises: it can't be reached
            return False
        return True


@dataclass
class MessagesBackend:
    """Messages with the system text beside them: blocks of content out, in a stream deltas of text."""

    model: str
    transport: Transport
    system: str = "You are a careful technical writer."
    name: str = "messages"

    def _payload(self, prompt: str, temperature: float, max_tokens: int, stream: bool) -> dict:
        return {"model": self.model, "system": self.system, "messages": [{"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": max_tokens, "stream": stream}

    def generate(self, prompt: str, temperature: float = 0.2, max_tokens: int = 1024) -> str:
        answer = self.transport("/messages", self._payload(prompt, temperature, max_tokens, False))
        return "".join(b["text"] for b in answer["content"] if b.get("type") == "text")

    def stream(self, prompt: str, temperature: float = 0.2, max_tokens: int = 1024) -> Iterator[str]:
        for event in self.transport("/messages", self._payload(prompt, temperature, max_tokens, True)):
            if event.get("type") == "content_block_delta" and event.get("delta", {}).get("text"):
                yield event["delta"]["text"]

    def healthy(self) -> bool:
        try:
            self.generate("ping", max_tokens=1)
        except Exception:  # whatever a client raises: it can't be reached
            return False
        return True


KINDS: dict[str, Callable[..., Backend]] = {"echo": lambda **_: EchoBackend(), "chat": ChatBackend, "messages": MessagesBackend}


def create_backend(kind: str, **settings) -> Backend:
    if kind not in KINDS:
        raise ValueError(f"backend must be one of {', '.join(KINDS)}, not {kind!r}")
    return KINDS[kind](**settings)


@dataclass
class Backends:
    """Named backends; one is the default."""

    default: str = "echo"
    known: dict[str, Backend] = field(default_factory=lambda: {"echo": EchoBackend()})

    def get(self, name: str | None = None) -> Backend:
        """KeyError for an unknown name."""
        return self.known[name or self.default]

    def health(self) -> dict:
        """healthy if any backend is."""
        each = {name: b.healthy() for name, b in self.known.items()}
        return {"status": "healthy" if any(each.values()) else "unhealthy", "backends": each, "n_healthy": sum(each.values())}
