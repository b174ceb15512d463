"""Answers of a model, kept as they come, and a cap on the calls in flight.

A call costs seconds and money, and a task that dies is run again with all its prompts.  So each answer is written to
the journal, by the digest of model and prompts, before the next prompt is asked; a prompt whose answer is there is not
asked again, by whichever attempt or job, nor by the next run if this one dies.  Each prompt is asked once: an error is
kept too, and an attempt that meets it fails without asking, until the next run begins.  A call is made under one of
`in_flight` leases, so that all tasks together never have more calls open.

The folder is one that driver and executors see alike, as the scanned tree is.  An answer is a file of its own; a run
that has written its state forgets them, so files are as many as one run's prompts.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from arborfold.plans.lease import lease


class ChatError(RuntimeError):
    pass


def digest(*parts: str) -> str:
    """Of the parts with their lengths, so that no two lists of parts are one."""
    return hashlib.sha256("".join(f"{len(p)}:{p}" for p in parts).encode(errors="surrogatepass")).hexdigest()


class Journal:
    def __init__(self, folder: str, in_flight: int = 4, ttl: float = 30) -> None:
        if in_flight < 1:
            raise ValueError("at least one call must be allowed in flight")
        self.folder, self.in_flight, self.ttl = folder, in_flight, ttl

    def _file(self, key: str) -> Path:
        return Path(self.folder, "answers", key[:2], f"{key}.json")

    def known(self, key: str) -> str | None:
        """The answer that is kept; ChatError if the prompt was asked in this run and failed."""
        try:
            kept = json.loads(self._file(key).read_text())
        except FileNotFoundError:
            return None
        if "error" in kept:
            raise ChatError(f"asked before in this run: {kept['error']}")
        return kept["answer"]

    def _keep(self, key: str, kept: dict) -> None:
        path = self._file(key)
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f".{uuid.uuid4().hex}")
        part.write_text(json.dumps(kept))
        os.replace(part, path)

    def ask(self, key: str, call: Callable[[], str]) -> str:
        """The answer that is kept, or one call's, which is kept before it is returned."""
        if (answer := self.known(key)) is not None:
            return answer
        # another task may be asking the same: who holds the prompt looks again, and holds it until the answer is kept
        with lease(os.path.join(self.folder, "asking", key), 1, self.ttl):
            if (answer := self.known(key)) is not None:
                return answer
            with lease(os.path.join(self.folder, "calls"), self.in_flight, self.ttl):
                try:
                    answer = call()
                except Exception as e:
                    self._keep(key, {"error": str(e)[:2000]})
                    raise
            self._keep(key, {"answer": answer})
        return answer

    def begin(self) -> None:
        """A new run: what failed in the last may be asked again."""
        for path in Path(self.folder, "answers").glob("*/*.json"):
            if "error" in json.loads(path.read_text()):
                path.unlink()

    def forget(self) -> None:
        """The run's state is written: its answers are not needed any more."""
        for part in ("answers", "asking"):
            shutil.rmtree(Path(self.folder, part), ignore_errors=True)


class Journaled:
    """A backend whose answers go through a journal.  call: (system, user) -> answer, run in tasks; name: of the model."""

    def __init__(self, name: str, call: Callable[[str, str], str], journal: Journal) -> None:
        self.name, self.call, self.journal = name, call, journal

    def complete(self, system: Column, user: Column) -> Column:
        name, call, journal = self.name, self.call, self.journal

        @F.pandas_udf("string")
        def ask(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for s, u in parts:
                yield pd.Series([journal.ask(digest(name, a, b), lambda a=a, b=b: call(a, b)) for a, b in zip(s, u, strict=True)], dtype=object)

        return ask.asNondeterministic()(system, user)
