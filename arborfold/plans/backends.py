"""What answers prompts: column expressions for tests and dry runs, a chat server over HTTP for real use."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborfold.plans.journal import ChatError, Journal, Journaled


class Backend(Protocol):
    def complete(self, system: Column, user: Column) -> Column: ...


class Digest:
    """A digest of both prompts: short, so that levels condense."""

    def complete(self, system: Column, user: Column) -> Column:
        return F.sha2(F.concat(system, F.lit("\x1f"), user), 256)


class Echo:
    """The user prompt: never condenses."""

    def complete(self, system: Column, user: Column) -> Column:
        return user


class Head:
    def __init__(self, k: int) -> None:
        self.k = k

    def complete(self, system: Column, user: Column) -> Column:
        return F.substring(user, 1, self.k)


def post_chat(base: str, model: str, system: str, user: str, num_ctx: int, timeout: float = 600) -> str:
    """One attempt; an error holds at most 1024 bytes of the answer."""
    body = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "stream": False, "options": {"num_ctx": num_ctx} if num_ctx else {}}
    request = urllib.request.Request(base.rstrip("/") + "/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return json.load(answer).get("message", {}).get("content", "")
    except urllib.error.HTTPError as e:
        raise ChatError(f"chat server error: status {e.code}, response: {e.read(1024).decode(errors='replace')}") from e


class HttpChat(Journaled):
    """A chat server.  A nondeterministic function, so that the optimizer never asks twice; callers write its answers before using them."""

    def __init__(self, base: str, model: str, num_ctx: int, journal: Journal) -> None:
        super().__init__(f"{base} {model} {num_ctx}", lambda system, user: post_chat(base, model, system, user, num_ctx), journal)
