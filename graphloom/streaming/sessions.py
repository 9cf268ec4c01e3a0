"""One log entry a session, out of events that a session's end is told by."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ENTRY = "session_id string, ts timestamp, agent string, type string, summary string, tags string"
_STATE = "done_at long, done_seq long, done_says string, end_at long, end_seq long, end_kind string, agent string, closed boolean"


def session_entries(events: DataFrame, late: str = "10 minutes", keep_minutes: int = 1440) -> DataFrame:
    """session_id, ts, agent, type, summary, tags: the entry of each session of events (session_id, seq, ts, kind, agent, text).

    The first 'task_complete' of a session, if it isn't after the first 'shutdown',
    makes an 'action' of its text; with an empty text it makes no entry, and none is
    made later. Else the first 'shutdown' makes a 'handover', 'Session ended (<text>)',
    'routine' where it says nothing. Other kinds count for nothing. A session with
    neither has no entry yet. First is by (ts, seq); the agent is that of the event
    itself, 'default' where it has none. Events without a session or a time are passed over.

    Of a stream the same, with events out of order: an entry is given once the
    watermark, which lags by `late`, has passed what decides it; events that come after it
    are too late. A closed session is remembered for keep_minutes, so that what else
    it sends makes no second entry."""
    rows = events.filter("session_id is not null and ts is not null and kind in ('task_complete', 'shutdown')")
    rows = rows.select("session_id", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "ts", "kind", F.coalesce(F.nullif("agent", F.lit("")), F.lit("default")).alias("agent"), F.coalesce("text", F.lit("")).alias("text"))
    if events.isStreaming:
        stated = rows.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(_step(keep_minutes), ENTRY, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
        return stated
    at = F.struct("ts", "seq", "agent", "text")
    first = rows.groupBy("session_id").agg(F.min(F.when(F.col("kind") == "task_complete", at)).alias("done"), F.min(F.when(F.col("kind") == "shutdown", at)).alias("end"))
    completed = F.col("done").isNotNull() & (F.col("end").isNull() | (F.struct("done.ts", "done.seq") <= F.struct("end.ts", "end.seq")))
    out = first.withColumn("completed", completed).filter("not completed or done.text != ''")
    pick = lambda a, b: F.when(F.col("completed"), a).otherwise(b)
    ended = F.concat(F.lit("Session ended ("), F.when(F.col("end.text") == "", "routine").otherwise(F.col("end.text")), F.lit(")"))
    return out.select(
        "session_id", pick(F.col("done.ts"), F.col("end.ts")).alias("ts"), pick(F.col("done.agent"), F.col("end.agent")).alias("agent"), pick(F.lit("action"), F.lit("handover")).alias("type"), pick(F.col("done.text"), ended).alias("summary"),
        pick(F.lit("auto-task-complete"), F.lit("auto-session-end")).alias("tags"))


def _step(keep_minutes: int):
    far = 1 << 62

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, done_seq, says, end, end_seq, kind, agent, closed = state.get if state.exists else (far, 0, "", far, 0, "", "", False)
        if state.hasTimedOut and closed:
            state.remove()
            return
        if not closed and not state.hasTimedOut:
            for frame in frames:
                for ts, seq, what, who, text in zip(frame["ts"].astype("datetime64[us]").astype("int64"), frame["seq"], frame["kind"], frame["agent"], frame["text"], strict=True):
                    at = (int(ts), int(seq))
                    if what == "task_complete" and at < (done, done_seq):
                        (done, done_seq), says = at, f"{who}\0{text}"
                    elif what == "shutdown" and at < (end, end_seq):
                        (end, end_seq), kind = at, f"{who}\0{text}"
        decides = min((done, done_seq), (end, end_seq))[0]
        passed = decides // 1000 < state.getCurrentWatermarkMs() or state.hasTimedOut
        if not closed and passed:
            closed = True
            complete = (done, done_seq) <= (end, end_seq)
            who, text = (says if complete else kind).split("\0", 1)
            if not complete:
                text = f"Session ended ({text or 'routine'})"
            if text:
                ts = pd.to_datetime([done if complete else end], unit="us")
                yield pd.DataFrame({"session_id": [key[0]], "ts": ts, "agent": [who], "type": ["action" if complete else "handover"], "summary": [text], "tags": ["auto-task-complete" if complete else "auto-session-end"]})
        state.update((done, done_seq, says, end, end_seq, kind, agent, closed))
        state.setTimeoutTimestamp(max(decides // 1000 + 1, state.getCurrentWatermarkMs() + 1) if not closed else max(decides // 1000, state.getCurrentWatermarkMs()) + keep_minutes * 60_000)

    return step
