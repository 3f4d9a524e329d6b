"""Structured calls of a language model: the protocol that plans ask for, with checks, re-asking, retries and usage.

A provider is one function, ``send(model, system, messages, schema) -> Reply``; everything else is here, so that tests and offline
runs need no network. Plans call ``structured`` from mapInPandas or on the driver; a client holds no session.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field


class ModelError(Exception):
    """A call that failed for good."""


class Transient(Exception):
    """A failure worth another attempt: a timeout, a rate limit, a server's error."""


class ToolUnsupported(Exception):
    """The model can't be made to use a tool; it is asked in words from then on."""


@dataclass
class Reply:
    values: list[dict]  # the submissions of one answer: exactly one is valid
    usage: dict[str, int] = field(default_factory=dict)


@dataclass
class Client:
    send: Callable[..., Reply]
    models: dict[str, str]  # tier -> model
    key: str | None = "offline"
    attempts: int = 3
    repeats: int = 2
    wait: Callable[[float], None] = time.sleep
    plain: set[str] = field(default_factory=set)  # models that are asked in words
    calls: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.key:
            raise ModelError("no key for the model's provider")

    def structured(self, agent: str, system: str, user: str, check: Callable[[dict], dict], tier: str = "fast", schema: dict | None = None) -> dict:
        """The one submission that ``check`` accepts (it raises ValueError on others); asked again with the complaint up to
        ``repeats`` times."""
        model, messages = self.models[tier], [{"role": "user", "content": user}]
        for _ in range(self.repeats + 1):
            reply = self._sent(model, system, messages, schema)
            self.calls.append({"agent": agent, "model": model, **reply.usage})
            try:
                if len(reply.values) != 1:
                    raise ValueError(f"{len(reply.values)} submissions instead of one")
                return check(reply.values[0])
            except ValueError as e:
                # every submission is answered, then the model is asked again
                messages = [*messages, {"role": "assistant", "content": reply.values}, *({"role": "tool", "content": f"invalid: {e}"} for _ in reply.values or [0])]
        raise ModelError(f"{agent}: no valid answer after {self.repeats + 1} calls")

    def _sent(self, model: str, system: str, messages: list[dict], schema: dict | None) -> Reply:
        for n in range(self.attempts):
            try:
                return self.send(model, system, messages, schema, forced=model not in self.plain)
            except ToolUnsupported:
                self.plain.add(model)
                return self.send(model, system, messages, schema, forced=False)
            except Transient as e:
                if n + 1 == self.attempts:
                    raise ModelError(str(e)) from e
                self.wait(min(10, 2**n))
        raise ModelError("no attempt was made")
