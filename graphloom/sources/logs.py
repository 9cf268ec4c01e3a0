"""Agent logs: JSON lines, and Markdown with dated sections."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.signals import entry_class, full_text, salience

ENTRY = "ts string, agent string, type string, summary string, detail string, sessionId string, session_id string, tags array<string>, context string, _bad string"


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, quarantine) of lines (line and other columns, which stay): what isn't JSON, or lacks ts, is quarantined as it stands. For streams and tables alike."""
    parsed = lines.filter(F.trim("line") != "").withColumn("e", F.from_json("line", ENTRY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.coalesce(F.col("e._bad").isNull() & F.col("e.ts").isNotNull(), F.lit(False))
    others = [c for c in lines.columns if c != "line"]
    rows = parsed.filter(good).select(
        *others, "e.ts", "e.agent", "e.type", "e.summary", "e.detail", F.coalesce("e.sessionId", "e.session_id").alias("session_id"), F.coalesce("e.tags", F.array().cast("array<string>")).alias("tags"), "e.context")
    return rows, parsed.filter(~good).select(*others, "line")


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, quarantine) of JSON lines below path. Entries have seq, a number of their own, and written, which orders them as they were written: by the number of their append, else by their file's time; then by file, and by place in it."""
    commit = F.coalesce(F.try_to_number(F.regexp_extract("_metadata.file_path", r"/commit-(\d{12})/[^/]*$", 1), F.lit("999999999999")).cast("long"), F.lit(0))
    place = F.struct(commit.alias("commit"), F.when(commit == 0, F.col("_metadata.file_modification_time")).alias("time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return parse_lines(lines.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("seq"), place.alias("written"), F.col("value").alias("line")))


def append_entries(entries: DataFrame, path: str) -> int:
    """Write entries, in their order, as the next append below path, and give its number. Two writers of one number collide on its folder, and the later one takes the next."""
    spark = entries.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(top)
    numbers = [int(n[7:]) for n in (s.getPath().getName() for s in fs.listStatus(top)) if re.fullmatch(r"commit-\d{12}", n)]
    number = max(numbers, default=0) + 1
    while True:
        try:
            entries.write.mode("errorifexists").json(f"{path.rstrip('/')}/commit-{number:012d}")
            return number
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            number += 1


def select_entries(entries: DataFrame, *, agent: str | None = None, since_date: str | None = None, after: str | None = None, kind: str | None = None, last: int | None = None) -> DataFrame:
    """Entries of an agent from a date on, strictly after a timestamp, of a type; of these the last ones written (by written where entries have it, else by seq)."""
    out = entries
    if agent is not None:
        out = out.filter(F.col("agent") == agent)
    if since_date is not None:
        out = out.filter(F.substring("ts", 1, 10) >= since_date)
    if after is not None:
        out = out.filter(F.col("ts") > after)
    if kind is not None:
        out = out.filter(F.col("type") == kind)
    return out if last is None else out.orderBy(F.desc("written" if "written" in out.columns else "seq")).limit(last)


def entry_content() -> Column:
    """detail, tags and context as lines; the summary where there is none of them."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", ")))
    context = F.when(F.col("context").isNotNull(), F.concat(F.lit("Context: "), F.col("context")))
    detail = F.when(F.col("detail") != "", F.col("detail"))
    lines = F.concat_ws("\n", detail, tags, context)
    return F.when(lines == "", F.coalesce("summary", F.lit(""))).otherwise(lines)


def to_log_entries(entries: DataFrame) -> DataFrame:
    """date, heading, content, entry_type, full_text, metadata and what orders them."""
    meta = F.map_filter(F.create_map(F.lit("agent"), F.col("agent"), F.lit("sessionId"), F.col("session_id"), F.lit("tags"), F.array_join("tags", ", ")), lambda k, v: v.isNotNull() & (v != ""))
    rows = entries.select("ts", "seq", "agent", F.substring("ts", 1, 10).alias("date"), F.coalesce("summary", F.lit("")).alias("heading"), entry_content().alias("content"), F.col("type").alias("entry_type"), meta.alias("metadata"))
    return rows.withColumn("full_text", full_text(F.col("heading"), F.col("content")))


def parse_markdown(texts: DataFrame) -> DataFrame:
    """path, seq, date, heading, content, entry_type of the sections of Markdown logs (path, text).

    '## date' begins a day, '### x' an entry; a file's header lines and rulers are
    skipped; what stands before any date, empty entries and consolidation notes
    are dropped. A file's lines are one window, which is as large as the file."""
    lines = texts.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    date = F.nullif(F.regexp_extract("line", r"^## (\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    head = F.nullif(F.regexp_extract("line", r"^### (.+)", 1), F.lit(""))
    header = F.col("line").startswith("# Log") | F.col("line").startswith("_Append-only")
    marked = lines.filter(~header).select("path", "n", "line", date.alias("d"), head.alias("h"))
    until = Window.partitionBy("path").orderBy("n")
    marked = marked.withColumn("date", F.last("d", ignorenulls=True).over(until)).withColumn("part", F.sum(F.when(F.col("d").isNotNull() | F.col("h").isNotNull(), 1).otherwise(0)).over(until))
    body = marked.filter(F.col("d").isNull() & F.col("h").isNull() & (F.trim("line") != "---"))
    sections = marked.groupBy("path", "part").agg(F.first("date").alias("date"), F.max("h").alias("heading"), F.min("n").alias("seq"))
    text = body.groupBy("path", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("content"))
    trimmed = F.regexp_replace("content", r"^\s+|\s+$", "")
    out = sections.join(text, ["path", "part"]).withColumn("content", trimmed).withColumn("heading", F.coalesce("heading", F.lit("")))
    out = out.filter(F.col("date").isNotNull() & (F.col("content") != "") & ~F.col("content").rlike(r"^_Consolidated .+\._$"))
    return out.select("path", "seq", "date", "heading", "content", entry_class(F.col("heading"), F.col("content")).alias("entry_type"))


def entry_count(lines: DataFrame) -> DataFrame:
    """One row, n: the lines (value) that aren't blank."""
    return lines.filter(F.trim("value") != "").agg(F.count("*").alias("n"))


def scored_sections(texts: DataFrame) -> DataFrame:
    """A Markdown log's sections with what a reader of them is shown: path, seq, date, heading, entry_type, importance, novelty, combined."""
    s = salience(full_text(F.col("heading"), F.col("content")), F.col("entry_type"))
    return parse_markdown(texts).withColumn("s", s).select("path", "seq", "date", "heading", "entry_type", "s.importance", "s.novelty", "s.combined")
