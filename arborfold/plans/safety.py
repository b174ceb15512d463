"""Files on the driver: sandboxed paths, atomic writes, the lock, the git probe."""

from __future__ import annotations

import contextlib
import os
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

from arborfold.plans.lease import Lease, LeaseHeld, lease

LOCK_NAME = ".arborfold.lock"


class PathTraversal(ValueError):
    pass


class LockHeld(RuntimeError):
    pass


def resolve_inside(root: str | Path, path: str) -> Path:
    """path under root, symbolic links followed; absolute paths count from root; PathTraversal if it leads outside."""
    top = Path(root).resolve()
    # what is there is resolved link by link; what is not there yet is appended as written
    plain = os.path.normpath(os.path.join(top, path.lstrip("/")))
    found = Path(os.path.realpath(plain))
    if found != top and top not in found.parents:
        raise PathTraversal(f"{path} leads outside {root}")
    return found


def read_inside(root: str | Path, path: str) -> bytes:
    return resolve_inside(root, path).read_bytes()


def write_atomic(target: Path, data: bytes, mode: int = 0o644) -> None:
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=".tmp-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(name, mode)
        os.replace(name, target)
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(name)
        raise


def write_inside(root: str | Path, path: str, text: str) -> None:
    write_atomic(resolve_inside(root, path), text.encode())


def ensure_lock_is_ignored(root: str | Path) -> None:
    path = resolve_inside(root, ".gitignore")
    old = path.read_bytes() if path.exists() else b""
    if LOCK_NAME in (x.strip() for x in old.decode(errors="replace").split("\n")):
        return
    gap = b"\n" if old and not old.endswith(b"\n") else b""
    write_atomic(path, old + gap + f"# Lock of arborfold\n{LOCK_NAME}\n".encode())


@contextlib.contextmanager
def lock(root: str | Path, ttl: float = 60) -> Iterator[Lease]:
    """The only run on root.  A holder that has died, and so has not touched its lease for ttl seconds, is passed over."""
    try:
        with lease(str(Path(root, LOCK_NAME)), 1, ttl, wait=0) as held:
            yield held
    except LeaseHeld as e:
        raise LockHeld(f"{Path(root, LOCK_NAME)} is held: another run is on") from e


def run_git(root: str | Path, *args: str) -> str:
    done = subprocess.run(["git", "--no-pager", *args], cwd=root, capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {' '.join(args)}: {done.stderr.strip()}")
    return done.stdout.strip()


def in_git(root: str | Path) -> bool:
    try:
        return run_git(root, "rev-parse", "--is-inside-work-tree") == "true"
    except (OSError, RuntimeError):
        return False
