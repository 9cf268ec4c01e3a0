"""Replay of logs: what is pending, chunks to extract from, and how far each agent has come."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.signals import salience


def pending(entries: DataFrame, state: DataFrame) -> DataFrame:
    """Entries (agent, ts, seq ...) strictly after their agent's watermark; all of an agent without one. state has a row an agent."""
    marks = state.select("agent", F.col("last_consolidated_ts").alias("_mark"))
    return entries.join(marks, "agent", "left").filter(F.col("_mark").isNull() | (F.col("ts") > F.col("_mark"))).drop("_mark")


def chunks(entries: DataFrame, size: int = 8) -> DataFrame:
    """agent, chunk (from 0), n, first_ts, last_ts, text: entries by (ts, seq), `size` to a chunk, parted by rulers.

    Numbers are per agent; an agent's entries are numbered by a first pass over
    days, so that no task sorts more than one agent's day."""
    day = F.substring("ts", 1, 10)
    rows = entries.withColumn("_day", day)
    before = Window.partitionBy("agent").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("agent", "_day").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    inner = Window.partitionBy("agent", "_day").orderBy("ts", "seq")
    numbered = rows.withColumn("_i", F.row_number().over(inner)).join(days.select("agent", "_day", "_before"), ["agent", "_day"]).withColumn("_n", F.col("_before") + F.col("_i") - 1)
    numbered = numbered.withColumn("chunk", F.floor(F.col("_n") / size))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "full_text"))), lambda x: x["full_text"]), "\n\n---\n\n")
    return numbered.groupBy("agent", "chunk").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), text.alias("text"))


def advance(state: DataFrame, done: DataFrame, run_ts: str) -> DataFrame:
    """state after done (agent, ts, n): the timestamp is replaced, counts add up."""
    new = done.groupBy("agent").agg(F.max("ts").alias("_ts"), F.sum("n").cast("int").alias("_n"))
    out = state.join(new, "agent", "full")
    run = F.when(F.col("_ts").isNotNull(), F.lit(run_ts)).otherwise(F.col("last_run_ts"))
    return out.select("agent", F.coalesce("_ts", "last_consolidated_ts").alias("last_consolidated_ts"), run.alias("last_run_ts"), (F.coalesce("entries_processed", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("entries_processed"))


def finished_prefix(results: DataFrame) -> DataFrame:
    """agent, ts, n up to the first chunk that failed (results: agent, chunk, ok, last_ts, n): a failed chunk is tried again."""
    w = Window.partitionBy("agent").orderBy("chunk")
    ok = results.withColumn("_bad", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(w)).filter("_bad = 0")
    return ok.groupBy("agent").agg(F.max("last_ts").alias("ts"), F.sum("n").alias("n"))


def high_salience(entries: DataFrame, least: float = 0.7) -> DataFrame:
    """Entries (full_text, entry_type ...) with salience, those of at least `least` combined."""
    return entries.withColumn("salience", salience(F.col("full_text"), F.col("entry_type"))).filter(F.col("salience.combined") >= least)
