"""Calls of an extractor that may fail or hang, a few at a time in each task."""

from __future__ import annotations

import queue
import re
import subprocess
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.sources.shared import ship

#: Gives what an extractor says of a text; raises where it can't.
Call = Callable[[str], str]
#: Calls at a time in a task, and seconds that one may take.
PARALLEL, LIMIT = 2, 120.0


def json_part(said: str) -> str | None:
    """What stands in the first fenced block of an answer, else from its first to its last brace."""
    fenced = re.search(r"```(?:json)?\s*([\s\S]*?)```", said)
    if fenced:
        return fenced[1].strip()
    raw = re.search(r"\{[\s\S]*\}", said)
    return raw[0] if raw else None


def command(*args: str, limit: float = LIMIT) -> Call:
    """A call that runs a command with the text on its standard input; it is killed at the limit."""

    def call(text: str) -> str:
        done = subprocess.run(args, input=text, capture_output=True, text=True, timeout=limit)
        if done.returncode:
            raise RuntimeError(f"exit code {done.returncode}")
        return done.stdout

    return call


def outcomes(texts: list[str], call: Call, parallel: int, limit: float) -> list[tuple[str | None, str | None, float]]:
    """For each text: the JSON or null, what went wrong or null, and the seconds it took.

    A call that is over its limit counts as failed and its place is free; its thread
    can't be ended and is left behind, so calls should end by themselves (see command())."""
    out: list = [None] * len(texts)
    waiting, running, done = deque(range(len(texts))), {}, queue.SimpleQueue()

    def work(i: int) -> None:
        try:
            said = call(texts[i])
            found = json_part(said or "")
            done.put((i, found, None if found is not None else "no JSON in output"))
        except subprocess.TimeoutExpired:
            done.put((i, None, "timeout"))
        except Exception as e:  # whatever a call raises is a failure of its text
            done.put((i, None, str(e) or type(e).__name__))

    while waiting or running:
        while waiting and len(running) < parallel:
            i = waiting.popleft()
            running[i] = time.monotonic()
            threading.Thread(target=work, args=(i,), daemon=True).start()
        try:
            i, found, error = done.get(timeout=max(0.001, min(running.values()) + limit - time.monotonic()))
            if i in running:
                out[i] = (found, error, time.monotonic() - running.pop(i))
        except queue.Empty:
            now = time.monotonic()
            for i in [i for i, began in running.items() if now - began >= limit]:
                out[i] = (None, "timeout", now - running.pop(i))
    return out


def extract(chunks: DataFrame, call: Call, parallel: int = PARALLEL, limit: float = LIMIT) -> DataFrame:
    """agent, chunk, json, error, seconds for each row of chunks (agent, chunk, text): json is null where error isn't.

    A null text is an empty one. A task has `parallel` calls at a time; a row that fails fails alone."""
    ship(chunks.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in chunks.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = outcomes([t or "" for t in batch.column("text").to_pylist()], call, parallel, limit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("agent"), batch.column("chunk"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.float64())],
                names=["agent", "chunk", "json", "error", "seconds"])

    return chunks.select("agent", "chunk", "text").mapInArrow(run, f"agent {types['agent']}, chunk {types['chunk']}, json string, error string, seconds double")


def extractor(call: Call, parallel: int = PARALLEL, limit: float = LIMIT) -> Callable[[DataFrame], DataFrame]:
    """What consolidate.sleep() takes: a failed call leaves its chunk, and those after it, to be tried again."""
    return lambda chunks: extract(chunks, call, parallel, limit)
