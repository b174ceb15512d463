"""python -m arborfold.cli init | update | setup [--model-id M] [--num-ctx N] [--calls N] [folder]"""

from __future__ import annotations

import argparse
import signal
import sys
import threading
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from arborfold import config as conf


def ask_text(question: str, default: str, read: Callable[[], str]) -> str:
    print(f"{question} [{default}]: ", end="", flush=True)
    line = read()
    if not line:
        raise EOFError("input ended")
    return line.strip() or default


def ask_list(question: str, present: list[str], read: Callable[[], str]) -> tuple[list[str], bool]:
    """(values, changed): blank keeps them, clear or none empties them."""
    print(f"{question} [{', '.join(present)}]: ", end="", flush=True)
    line = read()
    if not line:
        raise EOFError("input ended")
    line = line.strip()
    if not line:
        return present, False
    if line.lower() in ("clear", "none"):
        return [], True
    return [x.strip() for x in line.split(",") if x.strip()], True


def setup(folder: str, read: Callable[[], str] = sys.stdin.readline) -> conf.Config:
    c = conf.load(folder) if Path(folder, conf.FILE_NAME).exists() else conf.Config()
    c = replace(c, model_id=ask_text("Model", c.model_id, read), base_url=ask_text("Server", c.base_url, read))
    size = ask_text("Context", str(c.num_ctx), read)
    c = replace(c, num_ctx=int(size) if size.isdigit() and int(size) else c.num_ctx)
    ignore, changed = ask_list("Ignore", list(c.ignore), read)
    c = replace(c, ignore=tuple(conf.deduplicate(ignore)) if changed else c.ignore, docs_dir=ask_text("Folder for pages", c.docs_dir, read))
    conf.save(folder, c)
    return c


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="arborfold")
    p.add_argument("mode", choices=["init", "update", "setup"])
    p.add_argument("folder", nargs="?", default=".")
    p.add_argument("--model-id", default="")
    p.add_argument("--num-ctx", default="")
    p.add_argument("--calls", type=int, default=4, help="calls of the model that may be open at a time")
    args = p.parse_args(argv)
    try:
        if args.mode == "setup":
            setup(args.folder)
            return 0
        if not Path(args.folder, conf.FILE_NAME).exists():
            if not sys.stdin.isatty():
                raise conf.ConfigError("there is no configuration: run setup")
            setup(args.folder)
        c = conf.resolve(args.folder, model_id=args.model_id, num_ctx=args.num_ctx)
        from pyspark.sql import SparkSession

        from arborfold.plans.backends import HttpChat
        from arborfold.plans.journal import Journal
        from arborfold.plans.pipeline import Engine

        spark = SparkSession.builder.appName("arborfold").getOrCreate()
        engine = Engine(spark, args.folder, c, HttpChat(c.base_url, c.model_id, c.num_ctx, Journal(str(Path(args.folder, c.docs_dir, ".state", "journal").resolve()), args.calls)), lambda kind, m: print(m, file=sys.stderr if kind == "error" else sys.stdout))
        for s in (signal.SIGINT, signal.SIGTERM):
            # the main thread may be talking to the JVM: another one cancels
            signal.signal(s, lambda *_: threading.Thread(target=engine.cancel, daemon=True).start())
        engine.run(args.mode)
    except Exception as e:
        print(f"Execution failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
