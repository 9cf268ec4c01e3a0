"""Histogram sort into shards of near equal bytes.

Rows get a 63-bit key: 12 bits of a hash of the text, 35 of a hash of doc_id and
text, 16 of a hash of the row's place in its file. So equal texts lie in one zone
of 1/4096 of the key space, yet a text that fills a third of all rows still spreads
over that zone's keys and can be cut anywhere; rows equal in doc_id and text too
spread over 65,536 keys. Splitters are found by counting: exact bytes below the
4096 probes that the first 12 bits give, then, only inside the bins where a
target falls, below 4096 finer probes each, until every splitter is within the
tolerance or its bin holds one key. Then rows are exchanged once, by
(shard, bin), and numbered; the bins' counts give where each bin starts.
Everything is DataFrame work; the driver sees counts of probes alone.

At most (shards - 1) x 4096 counts come to the driver in a round, whatever the
input, and six rounds exhaust the key. Rows that lie in the exchange: key,
size, crc and id, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import discard, free_name, materialize, row_key, table

KEY_BITS, STEP = 63, 12
#: Low bits of a key that tell equal rows apart, and bits by which heavy bins are cut finer for the exchange.
ROW_BITS, FINE = 16, 8


def key_of(doc_id: Column, text: Column, row: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    zone = F.shiftrightunsigned(F.xxhash64(text), 52)
    middle = F.shiftrightunsigned(F.xxhash64(doc_id, text, F.lit(1)), 13 + ROW_BITS)
    low = F.shiftrightunsigned(F.xxhash64(row), 64 - ROW_BITS)
    return F.shiftleft(zone, 51).bitwiseOR(F.shiftleft(middle, ROW_BITS)).bitwiseOR(low)


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def splitters(keys: DataFrame, shards: int, tolerance: float) -> tuple[list[int], int]:
    """Keys at which shards 1.. begin, and the bytes of all rows.

    A splitter's error is how far the bytes below it are from its share of all
    bytes; rounds go on until each is within tolerance x a shard's bytes or its
    bin is one key wide (a single row, or a 65,536th of one row's repeats)."""
    shift = KEY_BITS - STEP
    top = keys.groupBy(F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("bytes")).orderBy("bin").collect()
    total = sum(r["bytes"] for r in top)
    if not total:
        return [], 0
    targets = [total * i / shards for i in range(1, shards)]
    allowed = tolerance * total / shards

    def place(rows, base, target):
        """The best probe edge among the bins of rows for a target, and the bin that it falls in with the bytes below."""
        below, best = base, None
        for r in rows:
            for edge, at in ((r["bin"], below), (r["bin"] + 1, below + r["bytes"])):
                if best is None or abs(at - target) < abs(best[0] - target):
                    best = (at, edge)
            if below <= target <= below + r["bytes"]:
                return best, (r["bin"], below)
            below += r["bytes"]
        return best, None

    found: dict[int, int] = {}
    pending: dict[int, tuple[int, int]] = {}
    for i, target in enumerate(targets):
        (at, edge), inside = place(top, 0, target)
        if abs(at - target) <= allowed or inside is None:
            found[i] = edge << shift
        else:
            pending[i] = inside
    while pending and shift > 0:
        finer = max(0, shift - STEP)
        bins = sorted({b for b, _ in pending.values()})
        rows = (
            keys.filter(F.shiftright("key", shift).isin(bins))
            .groupBy(F.shiftright("key", shift).alias("above"), F.shiftright("key", finer).alias("bin"))
            .agg(F.sum("size").alias("bytes")).orderBy("bin").collect()
        )
        still = {}
        for i, (b, base) in pending.items():
            (at, edge), inside = place([r for r in rows if r["above"] == b], base, targets[i])
            if abs(at - targets[i]) <= allowed or finer == 0 or inside is None:
                found[i] = edge << finer
            else:
                still[i] = inside
        pending, shift = still, finer
    return [found[i] for i in sorted(found)], total


def shard_rows(docs: DataFrame, shards: int = 16, tolerance: float = 0.002, heavy: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Null text: size 1 and the crc of nothing. Null doc_id: kept. Repeated rows
    stay, each with a slot, and spread like others. Empty table: no rows. Fewer
    rows than shards: some shards stay empty. Which of rows equal in doc_id and text
    goes where depends on their place in the file; all else on their values alone.
    Other columns are not read.

    heavy: a bin of the first 12 bits with over so many times the mean rows is
    cut finer for the exchange by the next 8 bits, and what is heavy then, which is
    equal rows, by the last 8, so that no bin is a large part of all rows."""
    key = key_of(F.col("doc_id"), F.col("text"), row_key())
    keys = materialize(
        docs.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), key.alias("key")),
        "shardkeys",
    )
    cuts, _ = splitters(keys, shards, tolerance)
    shard = sum((F.when(F.col("key") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    bin_of = lambda bits: F.shiftright("key", KEY_BITS - bits)
    counts = keys.groupBy(bin_of(STEP).alias("bin")).count()
    mean = counts.agg(F.avg("count")).first()[0] or 1
    # of either kind there are at most 4096 / heavy
    large = [r["bin"] for r in counts.filter(F.col("count") > heavy * mean).select("bin").collect()]
    second = keys.filter(bin_of(STEP).isin(large)).groupBy(bin_of(STEP + FINE).alias("bin")).count()
    equal = [r["bin"] for r in second.filter(F.col("count") > heavy * mean).select("bin").collect()] if large else []
    fine = F.shiftleft(F.when(bin_of(STEP).isin(large), bin_of(STEP + FINE)).otherwise(F.shiftleft(bin_of(STEP), FINE)) if large else F.shiftleft(bin_of(STEP), FINE), FINE)
    if equal:
        fine = fine.bitwiseOR(F.when(bin_of(STEP + FINE).isin(equal), F.col("key").bitwiseAND(F.lit((1 << FINE) - 1))).otherwise(F.lit(0)))
    dealt = keys.select("*", shard.alias("shard"), fine.alias("fine"))
    starts = dealt.groupBy("shard", "fine").count().select(
        "shard", "fine", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inner = Window.partitionBy("shard", "fine").orderBy("key", "doc_id", "size")
    # starts has at most 4096 + 2 x (4096 / heavy) x 256 bins, of which those that a splitter cuts count twice, of 20 bytes each
    numbered = dealt.withColumn("n", F.row_number().over(inner)).join(F.broadcast(starts), ["shard", "fine"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, tolerance: float = 0.002) -> None:
    """The same law applied to whole rows: docs written below path in folders shard=0.. (_shard where docs has a column of that name), by key within a file."""
    name, at = free_name("key", docs.columns), free_name("shard", docs.columns)
    key = key_of(F.col("doc_id"), F.col("text"), row_key())
    counted = materialize(docs.select(size_of(F.col("text")).alias("size"), key.alias("key")), "shardkeys")
    cuts, _ = splitters(counted, shards, tolerance)
    discard(counted)
    shard = sum((F.when(F.col(name) >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    keyed = docs.withColumn(name, key).withColumn(at, shard)
    keyed.repartitionByRange(at, name).sortWithinPartitions(at, name).drop(name).write.partitionBy(at).parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


QUERIES = {"op4_sharding": op4_sharding}
SQL: dict[str, str] = {}
