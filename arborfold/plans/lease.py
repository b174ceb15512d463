"""Leases on slots of a shared folder: at most so many holders at a time, whoever and wherever they are.

A holder of slot s has the file s.g of highest generation g.  Creating a file exclusively is the only step that must be
atomic: a slot is taken by creating s.(g + 1), if s.g has been given back (s.g.free) or has not been touched for `ttl`
seconds.  Holders touch their file from a thread.  A generation is never used twice, so it also is a fencing number: of
two that both believe to hold a slot, the later has the higher one.
"""

from __future__ import annotations

import contextlib
import os
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass


class LeaseHeld(RuntimeError):
    pass


@dataclass(frozen=True)
class Lease:
    slot: int
    generation: int
    path: str

    def lost(self) -> bool:
        """Whether a later holder has taken the slot."""
        return _newest(os.path.dirname(self.path)).get(self.slot, (0, False))[0] > self.generation


def _newest(folder: str) -> dict[int, tuple[int, bool]]:
    """The highest generation of each slot, and whether it has been given back."""
    out: dict[int, tuple[int, bool]] = {}
    for name in os.listdir(folder):
        slot, generation, *rest = [*name.split("."), ""]
        if slot.isdigit() and generation.isdigit():
            out[int(slot)] = max(out.get(int(slot), (0, False)), (int(generation), rest[:1] == ["free"]))
    return out


def _stale(path: str, ttl: float) -> bool:
    try:
        # the folder's own clock: a file made now, beside the one judged
        return _now(os.path.dirname(path)) - os.stat(path).st_mtime > ttl
    except FileNotFoundError:
        return False  # tidied up meanwhile: look again


def _now(folder: str) -> float:
    probe = os.path.join(folder, f"clock-{os.getpid()}-{threading.get_ident()}")
    with open(probe, "w"):
        now = os.stat(probe).st_mtime
    with contextlib.suppress(FileNotFoundError):
        os.unlink(probe)
    return now


def _take(folder: str, slots: int, ttl: float) -> Lease | None:
    newest = _newest(folder)
    for slot in range(slots):
        generation, free = newest.get(slot, (0, True))
        if not free and not _stale(os.path.join(folder, f"{slot}.{generation}"), ttl):
            continue
        path = os.path.join(folder, f"{slot}.{generation + 1}")
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644))
        except FileExistsError:
            continue
        for old in (f"{slot}.{generation}", f"{slot}.{generation}.free"):
            with contextlib.suppress(FileNotFoundError):
                os.unlink(os.path.join(folder, old))
        return Lease(slot, generation + 1, path)
    return None


@contextlib.contextmanager
def lease(folder: str, slots: int = 1, ttl: float = 30, wait: float | None = None) -> Iterator[Lease]:
    """Hold one of the slots.  wait: seconds to try before LeaseHeld; None: as long as it takes."""
    os.makedirs(folder, exist_ok=True)
    until, pause = None if wait is None else time.monotonic() + wait, 0.005
    while (held := _take(folder, slots, ttl)) is None:
        if until is not None and time.monotonic() >= until:
            raise LeaseHeld(f"all {slots} of {folder} are held")
        time.sleep(pause)
        pause = min(0.25, pause * 1.5)
    stop = threading.Event()

    def beat() -> None:
        while not stop.wait(ttl / 3):
            with contextlib.suppress(FileNotFoundError):  # lost
                os.utime(held.path)

    thread = threading.Thread(target=beat, daemon=True)
    thread.start()
    try:
        yield held
    finally:
        stop.set()
        thread.join()
        # given back under its own generation, so that a later holder is not disturbed
        with contextlib.suppress(FileNotFoundError):
            os.rename(held.path, f"{held.path}.free")
