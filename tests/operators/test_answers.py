"""Calls that are made once: logs over stops, ends at the first failure, kept connections."""

import http.server
import json
import os
import threading
import time
import types

import pytest
from pyspark.sql import functions as F

from siltstone import schemas as S
from siltstone.operators import answers
from siltstone.operators import chain as C
from siltstone.operators import generate as G
from siltstone.operators.answers import AnswerLog
from siltstone.sources.connections import Connections

from .test_chain import TEMPLATES, good, units

STAGE = G.Stage("QA", lambda said: F.concat(F.lit("ask "), F.col("id").cast("string"), F.lit(" "), said), S.QA_GENERATED_JSON, S.QA_GENERATED)
ANSWER = json.dumps({"question": "Is it so?", "claim_evaluation_explanation": "yes"})


def told(path, line):
    with open(path, "a") as f:
        f.write(line + "\n")


def lines(path):
    return open(path).read().split("\n")[:-1] if os.path.exists(path) else []


def test_a_killed_task_is_asked_for_alone(spark, tmp_path):
    """A worker dies in the middle of a run. What other tasks had answered isn't asked for again, nor by a third run."""
    calls, once = str(tmp_path / "calls"), str(tmp_path / "once")

    def script(prompt):
        told(calls, prompt)
        if prompt.startswith("ask 77 ") and not os.path.exists(once):
            open(once, "w").close()
            time.sleep(2)  # others go on meanwhile
            os._exit(1)
        return ANSWER

    log = AnswerLog(str(tmp_path / "log"), each=2)
    rows = spark.createDataFrame([(i, "c") for i in range(120)], "id long, claim string")
    ask = lambda log: G.with_retries(rows, STAGE, G.ScriptedGenerator(script), pool=2, log=log, identity=("id",))
    with pytest.raises(Exception, match="(?i)worker|crash|exit"):
        ask(log)
    before = lines(calls)
    ok, bad = ask(log)
    assert sorted(r.id for r in ok.collect()) == list(range(120)) and bad.isEmpty()
    again = len(lines(calls)) - 120
    assert len(before) > 20 and 1 <= again <= 4 * 4  # four tasks under way, of two threads and two calls each
    ask(log)
    assert len(lines(calls)) == 120 + again


def test_rows_alike_share_an_answer_and_failures_are_asked_again(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def script(prompt):
        told(calls, prompt)
        if prompt.startswith("ask 3 ") and len([c for c in lines(calls) if c.startswith("ask 3 ")]) <= 2:
            raise TimeoutError("slow")
        return ANSWER

    rows = spark.createDataFrame([(3,), (4,), (4,), (None,)], "id long")
    log = AnswerLog(str(tmp_path / "log"))
    run = lambda attempts: G.with_retries(rows, G.Stage("QA", lambda s: F.concat_ws(" ", F.lit("ask"), "id", s), STAGE.schema, STAGE.record, attempts=attempts), G.ScriptedGenerator(script), log=log, identity=("id",), concurrency=8)
    ok, bad = run(1)
    assert sorted(str(r.id) for r in ok.collect()) == ["4", "4", "None"] and [r.failure.error_type for r in bad.collect()] == ["TimeoutError"]
    assert len(lines(calls)) == 3
    ok, bad = run(2)
    assert ok.count() == 4 and bad.isEmpty() and len(lines(calls)) == 5


@pytest.mark.parametrize("slow", [False, True])
def test_tasks_of_fast_answers_grow_and_leave_slow_ones(spark, tmp_path, monkeypatch, slow):
    """Answers that come fast make few files; where they turn slow, what a grown task does not come to goes to small ones. Each is asked for once."""
    monkeypatch.setattr(answers, "TASKS", 4)
    monkeypatch.setattr(answers, "SECONDS", 20.0 if not slow else 0.5)
    monkeypatch.setattr(answers, "STEP", 16)
    monkeypatch.setattr(answers, "time", types.SimpleNamespace(monotonic=iter(x / 100 for x in range(100)).__next__))  # as if each wave took no time
    calls = str(tmp_path / "calls")

    def script(prompt):
        if slow and len(lines(calls)) > 40:
            time.sleep(0.1)
        told(calls, prompt)
        return ANSWER

    rows = spark.range(400)
    log = AnswerLog(str(tmp_path / "log"), each=2)
    for _ in range(2):
        ok, bad = G.with_retries(rows, STAGE, G.ScriptedGenerator(script), pool=2, log=log, identity=("id",))
        assert sorted(r.id for r in ok.collect()) == list(range(400)) and bad.isEmpty()
        assert len(lines(calls)) == len(set(lines(calls))) == 400
    files = len([f for f in os.listdir(tmp_path / "log") if f.endswith(".parquet")])
    assert files > 40 if slow else files < 40  # of 400 rows, four a small task


@pytest.mark.parametrize("bad", [4, 220])
def test_a_run_ends_at_its_first_failure(spark, tmp_path, bad):
    """Of 400 candidates those of the waves up to the one with the failure are asked for, twice at most."""
    calls = str(tmp_path / "calls")

    def script(prompt):
        told(calls, prompt[:5])
        return "no json" if f"dog number {bad} " in prompt else good(prompt)

    rows = units(spark, 400).withColumn("audio_captions", F.array(F.array(F.lit("a dog barks at a car"), F.concat(F.lit("dog number "), "unit_index", F.lit(" here"))), F.array(F.lit("rain falls"))))
    with pytest.raises(C.GenerationFailed, match=f"unit-{bad}:"):
        C.run(rows, C.Chain(TEMPLATES, G.ScriptedGenerator(script), on_error="abort", wave=100))
    assert len(lines(calls)) == 100 * (bad // 100 + 1) + 1


def test_a_chain_goes_on_from_its_log(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def script(prompt):
        told(calls, prompt)
        return good(prompt)

    chain = C.Chain(TEMPLATES, G.ScriptedGenerator(script), each=2, log=AnswerLog(str(tmp_path / "log")), concurrency=8)
    one = C.run(units(spark, 6), chain)
    n = len(lines(calls))
    two = C.run(units(spark, 6), chain)
    key = lambda out: sorted(map(str, out.audit.collect()))
    assert key(one) == key(two) and n == len(lines(calls)) and one.stats.first() == two.stats.first()
    C.run(units(spark, 8), chain)
    assert len(lines(calls)) > n


@pytest.fixture()
def server():
    seen = {"connections": 0, "calls": 0, "now": 0, "most": 0}
    lock = threading.Lock()

    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def setup(self):
            with lock:
                seen["connections"] += 1
            super().setup()

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                seen["calls"] += 1
                seen["now"] += 1
                seen["most"] = max(seen["most"], seen["now"])
            time.sleep(0.02)
            with lock:
                seen["now"] -= 1
            status = 503 if body["messages"][0]["content"] == "busy" else 200
            text = json.dumps({"choices": [{"message": {"content": body["messages"][0]["content"]}, "finish_reason": "stop"}]}).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(text)))
            if body["messages"][0]["content"] == "last":
                self.send_header("Connection", "close")
                self.close_connection = True
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *args):
            pass

    run = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    run.daemon_threads = True
    threading.Thread(target=run.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{run.server_port}/v1/chat/completions", seen
    run.shutdown()


def test_connections_are_kept_and_bounded(spark, server):
    """200 calls of eight tasks, one after the other in a few workers: no more connections than calls at a time."""
    url, seen = server
    generator = G.HttpGenerator(url, "m", most=2)
    rows = spark.range(200).repartition(8)
    got = G.generate(rows, F.col("id").cast("string"), generator, pool=6).collect()
    assert sorted(int(json.loads(r.raw)["choices"][0]["message"]["content"]) for r in got) == list(range(200))
    assert seen["calls"] == 200 and seen["most"] <= 4 * 2 and seen["connections"] <= 4 * 2


def test_a_connection_that_the_server_closes_is_replaced(server):
    url, seen = server
    own = Connections(url, 5.0, 1)
    ask = lambda text: own.post(json.dumps({"messages": [{"content": text}]}).encode(), {"Content-Type": "application/json"})
    assert [ask(t)[0] for t in ("a", "last", "b", "busy", "c")] == [200, 200, 200, 503, 200]
    assert seen["connections"] == 2
    with pytest.raises(OSError):
        Connections("http://127.0.0.1:9/", 1.0, 1).post(b"", {})
    with pytest.raises(ValueError):
        Connections("ftp://x", 1.0, 1)


def test_http_failures_keep_their_status(spark, server):
    url, seen = server
    generator = G.HttpGenerator(url, "m", retry=G.RetryPolicy(attempts=3, initial=0.01, jitter=0))
    row = G.generate(spark.createDataFrame([("busy",)], "t string"), F.col("t"), generator).first()
    assert (row.raw, row.failure.error_type, row.failure.http_status) == (None, "HttpFailure", 503) and seen["calls"] == 3
