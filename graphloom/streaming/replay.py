"""Incremental replay: a stream of log lines, each batch extracted and written as changes, which are folded into a graph's snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.consolidate import apply_extractions
from graphloom.operators.extraction import parse_extractions
from graphloom.sources.logs import parse_lines
from graphloom.sources.shared import settle
from graphloom.sources.store import load, save

#: Turns a batch of entries into rows (seq, json); the default reads extractions that entries carry in their context.
Extractor = Callable[[DataFrame], DataFrame]


def carried(entries: DataFrame) -> DataFrame:
    return entries.filter("context is not null").select("seq", F.col("context").alias("json"))


def start(spark: SparkSession, logs: str, root: str, checkpoint: str, extractor: Extractor = carried) -> StreamingQuery:
    """Read the JSON lines below logs, what is there and not yet read, into changes of the graph at root.

    A batch writes what it brings alone: its mentions and relations below
    root/incoming/batch=<n>, and lines and extractions that can't be read below
    root/quarantine/batch=<n>. A batch that is given again, as after a failure, writes
    the same folders anew, so nothing counts twice. fold() puts changes into the graph."""
    stream = spark.readStream.option("recursiveFileLookup", "true").text(logs).select(F.col("value").alias("line"))

    def each(batch: DataFrame, number: int) -> None:
        rows = settle(batch.withColumn("seq", F.monotonically_increasing_id() + F.lit(number) * (1 << 48)))[0]
        good, unread = parse_lines(rows)
        found, relations, broken = parse_extractions(extractor(good))
        bad = unread.select("seq", F.lit("log").alias("source"), F.col("line").alias("text")).unionByName(broken.select("seq", F.lit("extraction").alias("source"), F.col("json").alias("text")))
        for df, name in ((found, f"incoming/batch={number}/mentions"), (relations, f"incoming/batch={number}/relations"), (bad, f"quarantine/batch={number}")):
            df.write.mode("overwrite").parquet(f"{root}/{name}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quarantined(spark: SparkSession, root: str) -> DataFrame:
    """seq, source (log or extraction), text of all that a stream couldn't read."""
    return spark.read.schema("seq long, source string, text string").option("recursiveFileLookup", "true").parquet(f"{root}/quarantine")


def fold(spark: SparkSession, root: str, as_of=None) -> int:
    """Put the batches that came since the last fold into the graph at root, as one new version; how many they were.

    The version holds the number of the last batch that is in it, so a fold that fails
    changes nothing and one that is run again adds nothing."""
    graph = load(spark, root)
    mark = graph.state.filter("agent = '_stream'").select("entries_processed").first()
    done = mark[0] if mark else 0
    numbers = sorted(n for n in _batches(spark, f"{root}/incoming") if n >= done)
    if not numbers:
        return 0
    read = lambda name: spark.read.parquet(*[f"{root}/incoming/batch={n}/{name}" for n in numbers])
    now = F.current_timestamp() if as_of is None else as_of
    out, _ = apply_extractions(graph, read("mentions"), read("relations"), now)
    state = graph.state.filter("agent != '_stream'").unionByName(spark.createDataFrame([("_stream", None, None, numbers[-1] + 1)], graph.state.schema))
    save(spark, out.with_(state=state), root)
    return len(numbers)


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose last table is written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    return [int(n[6:]) for n in names if n.startswith("batch=") and fs.exists(hadoop.Path(f"{path}/{n}/relations/_SUCCESS"))]


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type, value) by tumbling window and type, for streams and tables alike; later events than `late` are dropped from a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
