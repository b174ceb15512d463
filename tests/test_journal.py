"""Leases, the answer journal and the cap on calls, against a server that counts."""

import json
import multiprocessing
import os
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from arborfold.plans.backends import HttpChat, post_chat
from arborfold.plans.journal import ChatError, Journal, Journaled, digest
from arborfold.plans.lease import LeaseHeld, lease


class Server:
    """Answers with the prompt's length; counts what is asked and how many calls are open."""

    def __init__(self, fails=(), slow=0.05):
        self.asked, self.open, self.most, self.fails, gate = Counter(), 0, 0, set(fails), threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                user = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"]
                with gate:
                    outer.asked[user] += 1
                    outer.open += 1
                    outer.most = max(outer.most, outer.open)
                time.sleep(slow)
                with gate:
                    outer.open -= 1
                self.send_response(500 if user in outer.fails else 200)
                self.end_headers()
                self.wfile.write(json.dumps({"message": {"content": str(len(user))}}).encode())

            def log_message(self, *a):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.http.server_port}"


def prompts(spark, n):
    return spark.range(n).repartition(4).select(F.lit("s").alias("s"), F.concat(F.lit("prompt "), "id").alias("u"))


def answers(df, chat):
    return {r.u: r.a for r in df.withColumn("a", chat.complete(F.col("s"), F.col("u"))).collect()}


def test_cap_and_one_call_a_prompt(spark, tmp_path):
    """Four tasks, at most two calls open; equal prompts of all tasks are asked once; a second job asks nothing."""
    server = Server()
    chat = HttpChat(server.base, "m", 5, Journal(str(tmp_path), in_flight=2))
    df = prompts(spark, 24).union(prompts(spark, 24))
    want = {f"prompt {i}": str(len(f"prompt {i}")) for i in range(24)}
    assert answers(df, chat) == want and answers(df, chat) == want
    assert server.most <= 2 and server.asked == Counter(want.keys())
    other = HttpChat(server.base, "another", 5, Journal(str(tmp_path), in_flight=2))
    assert answers(prompts(spark, 3), other) and server.asked["prompt 1"] == 2


def test_a_killed_task_asks_nothing_twice(spark, tmp_path):
    """The worker dies in the middle; the job fails, and the next asks only what has no answer yet."""
    server, mark = Server(slow=0.002), str(tmp_path / "died")
    base = server.base

    def call(system, user):
        if user.endswith(" 213") and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        return post_chat(base, "m", system, user, 5)

    chat = Journaled("m", call, Journal(str(tmp_path / "j"), ttl=2))
    df = spark.range(400).coalesce(1).select(F.lit("s").alias("s"), F.concat(F.lit("prompt "), "id").alias("u"))
    with pytest.raises(Exception):  # noqa: B017
        answers(df, chat)
    assert sum(server.asked.values()) == 213
    assert len(answers(df, chat)) == 400
    assert set(server.asked.values()) == {1} and len(server.asked) == 400


def test_errors_are_asked_once_a_run(spark, tmp_path):
    server = Server(fails={"prompt 2"})
    journal = Journal(str(tmp_path))
    chat = HttpChat(server.base, "m", 5, journal)
    for _ in range(2):
        with pytest.raises(Exception, match="chat server error|asked before"):
            answers(prompts(spark, 5), chat)
    assert server.asked["prompt 2"] == 1
    server.fails.clear()
    journal.begin()
    assert len(answers(prompts(spark, 5), chat)) == 5
    assert server.asked["prompt 2"] == 2 and max(v for k, v in server.asked.items() if k != "prompt 2") == 1
    journal.forget()
    assert journal.known(digest(chat.name, "s", "prompt 1")) is None
    with pytest.raises(ChatError):
        journal.ask("0" * 64, lambda: (_ for _ in ()).throw(ChatError("no")))
    with pytest.raises(ValueError):
        Journal(str(tmp_path), 0)


def hold(folder, log, n):
    for _ in range(n):
        with lease(folder, 2, ttl=5) as held:
            with open(log, "a") as f:
                f.write(f"+ {held.slot} {held.generation}\n")
            time.sleep(0.01)
            with open(log, "a") as f:
                f.write(f"- {held.slot} {held.generation}\n")


def test_leases_of_processes(tmp_path):
    """Six processes, two slots: never three at a time, and no generation twice."""
    folder, log = str(tmp_path / "l"), str(tmp_path / "log")
    running = [multiprocessing.get_context("spawn").Process(target=hold, args=(folder, log, 8)) for _ in range(6)]
    for p in running:
        p.start()
    for p in running:
        p.join()
    held, seen = set(), set()
    for sign, slot, generation in (x.split() for x in open(log)):
        if sign == "+":
            assert slot not in {s for s, _ in held} and (slot, generation) not in seen
            held.add((slot, generation))
            seen.add((slot, generation))
        else:
            held.remove((slot, generation))
        assert len(held) <= 2
    assert len(seen) == 48


def test_a_lease_expires_only_without_a_holder(tmp_path):
    folder = str(tmp_path)
    with lease(folder, 1, ttl=0.6) as first:
        time.sleep(1.5)  # the thread keeps it
        with pytest.raises(LeaseHeld), lease(folder, 1, ttl=0.6, wait=0.1):
            pass
        assert not first.lost()
    dead = os.path.join(folder, "0.7")
    open(dead, "w").close()
    with pytest.raises(LeaseHeld), lease(folder, 1, ttl=30, wait=0):
        pass
    os.utime(dead, (time.time() - 60, time.time() - 60))
    with lease(folder, 1, ttl=30, wait=0) as next_one:
        assert next_one.generation == 8
        with lease(folder, 2, ttl=30, wait=0) as other:
            assert other.slot == 1
