"""Extractor calls that fail or hang, and sessions as a table and as a stream that is stopped and started again."""

import datetime
import json
import time

from pyspark.sql import functions as F

from graphloom.functions.text import keywords, shared
from graphloom.operators import consolidate, runner
from graphloom.operators.graph import Graph
from graphloom.streaming.sessions import session_entries


def test_calls_that_answer_raise_and_hang(spark):
    def call(text):
        if "hang" in text:
            time.sleep(30)
        if "raise" in text:
            raise ValueError("refused")
        return "```json\n{\"entities\": []}\n```" if "fence" in text else "no braces" if "odd" in text else "see {\"a\": 1}."

    texts = ["hang 1", "raise", "fence", "plain", "odd", "hang 2", None]
    chunks = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)], "agent string, chunk long, text string").coalesce(1)
    began = time.monotonic()
    got = {r["chunk"]: (r["json"], r["error"]) for r in runner.extract(chunks, call, parallel=2, limit=1.0).collect()}
    assert time.monotonic() - began < 20
    assert got == {0: (None, "timeout"), 1: (None, "refused"), 2: ('{"entities": []}', None), 3: ('{"a": 1}', None), 4: (None, "no JSON in output"), 5: (None, "timeout"), 6: ('{"a": 1}', None)}


def test_calls_at_a_time_are_bounded():
    running, most = [0], [0]

    def call(text):
        running[0] += 1
        most[0] = max(most[0], running[0])
        time.sleep(0.05)
        running[0] -= 1
        return "{}"

    assert [x[:2] for x in runner.outcomes(["t"] * 9, call, 3, 10)] == [("{}", None)] * 9 and most[0] <= 3
    assert runner.outcomes([], call, 3, 10) == []
    assert runner.outcomes(["{1}"], runner.command("cat"), 1, 10)[0][0] == "{1}"
    assert runner.outcomes(["x"], runner.command("false"), 1, 10)[0][1] == "exit code 1"
    assert runner.outcomes(["x"], runner.command("sleep", "9", limit=0.2), 1, 10)[0][1] == "timeout"


def test_sleep_moves_watermarks_up_to_what_hung(spark):
    def call(text):
        if "stuck" in text:
            time.sleep(20)
        if "broken" in text:
            raise ValueError("no")
        return '{"entities": [{"name": "Alpha"}]}'

    rows = [("ok", 1, "fine"), ("ok", 2, "fine"), ("slow", 1, "fine"), ("slow", 2, "stuck"), ("slow", 3, "fine"), ("bad", 1, "broken"), ("bad", 2, "fine")]
    entries = spark.createDataFrame([(a, f"2024-01-0{d}", i, t) for i, (a, d, t) in enumerate(rows)], "agent string, ts string, seq long, full_text string")
    g, per, _ = consolidate.sleep(Graph.empty(spark), entries, runner.extractor(call, limit=1.0), F.to_timestamp(F.lit("2024-02-01")), "2024-02-01", size=1)
    assert {r["agent"]: (r["last_consolidated_ts"], r["entries_processed"]) for r in g.state.collect()} == {"ok": ("2024-01-02", 2), "slow": ("2024-01-01", 1)}
    assert {r["agent"]: (r["chunks"], r["failed"]) for r in per.collect()} == {"ok": (2, 0), "slow": (3, 1), "bad": (2, 1)}


EVENTS = "session_id string, seq long, ts timestamp, kind string, agent string, text string"


def at(minute):
    return (datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)).isoformat()


ROWS = [
    ("a", 2, 5, "task_complete", "x", "second"), ("a", 1, 3, "task_complete", "y", "first"), ("a", 3, 6, "shutdown", "x", ""), ("b", 4, 4, "shutdown", "", "error"), ("b", 5, 8, "task_complete", "x", "after the end"),
    ("c", 6, 2, "task_complete", "x", ""), ("c", 7, 9, "shutdown", "x", "routine"), ("d", 8, 7, "error", "x", "no end"), ("e", 9, 7, "shutdown", None, None), ("e", 10, 7, "task_complete", "x", "same time"), (None, 11, 7, "shutdown", "x", ""),
]
WANT = {("a", "y", "action", "first"), ("b", "default", "handover", "Session ended (error)"), ("e", "default", "handover", "Session ended (routine)")}


def told(df):
    return sorted((r["session_id"], r["agent"], r["type"], r["summary"]) for r in df.collect())


def test_sessions_as_a_table(spark):
    rows = spark.createDataFrame([(s, q, datetime.datetime.fromisoformat(at(m)), k, a, t) for s, q, m, k, a, t in ROWS], EVENTS)
    assert told(session_entries(rows)) == sorted(WANT)
    assert told(session_entries(rows.limit(0))) == []


def test_sessions_as_a_stream_that_is_started_again(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def run(name, rows):
        (src / name).write_text("".join(json.dumps(dict(zip(("session_id", "seq", "ts", "kind", "agent", "text"), (s, q, at(m), k, a, t)))) + "\n" for s, q, m, k, a, t in rows))
        entries = session_entries(spark.readStream.schema(EVENTS).json(str(src)), late="10 minutes")
        entries.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", out).trigger(availableNow=True).start().awaitTermination()

    run("1.json", ROWS[:1] + ROWS[3:7])  # the first completion of a is late, but not too late
    run("2.json", ROWS[1:3] + ROWS[7:])
    run("3.json", [("z", 90, 60, "task_complete", "x", "far on")])
    assert told(spark.read.parquet(out)) == sorted(WANT)
    run("4.json", [("a", 91, 1, "task_complete", "x", "too late"), ("b", 92, 61, "shutdown", "x", "again"), ("y", 93, 200, "shutdown", "x", "")])
    assert told(spark.read.parquet(out)) == sorted(WANT | {("z", "x", "action", "far on")})


def test_keywords_and_shared_members(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(keywords(F.lit("How does the authentication system work with JWT tokens?"))) == ["authentication", "system", "work", "jwt", "tokens"]
    assert one(keywords(F.lit('graph.addNode(name: "test-node")'))) == ["graph", "addnode", "name", "test-node"]
    assert one(keywords(F.lit("the and or I am ok"))) == [] and one(keywords(F.lit(None).cast("string"))) == [] and len(one(keywords(F.lit("word " * 20)))) == 8
    assert one(shared(F.array(F.lit("b"), F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("b")))) == ["b", "a"]
