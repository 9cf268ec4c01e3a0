"""What the text operators share: shared-folder tables, row keys, Arrow text access, splits.

Row identity. Documents may repeat a doc_id or have none, so operators that
must bring parts of one row together use ``row_key``: a number that a scan of
the same files gives again, also when a lost task is run anew.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import pickle
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.shared import ship as ship_package

#: Tables that materialize() wrote and nothing deleted yet, oldest first.
_made: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of this machine's only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "step", keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, outlives executors. keep: scratch() leaves it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not keep:
        _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that materialize() made, once nothing will read it again."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        _made.pop(path, None)
        _delete(df.sparkSession, path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, the tables that were made within it; what was built on them must be written by then."""
    before = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in before]:
            _delete(_made.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: The most bytes of an Arrow batch: what a worker, and the executor beside it, hold at once however long texts are.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, wherever they run, and bound the batches that they get."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound) == str(64 << 20) + "b":  # its default; a smaller one that was asked for stays
        spark.conf.set(bound, BATCH_BYTES)
    ship_package(spark)


_lone: dict[object, object] = {}


def lone(key: object, make: Callable[[], object] | None = None) -> object:
    """What make() gives, kept in this worker process under key for later tasks; whatever was kept under another key is let go and its memory given back.

    A worker serves stage after stage, so without this each stage's caches would stay beside the next one's."""
    if key not in _lone:
        _lone.clear()
        gc.collect()
        give_back()
        _lone[key] = make() if make else None
    return _lone[key]


def give_back() -> None:
    """Return free memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, mod n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def py_remainder(doc_id, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def row_key() -> Column:
    return F.monotonically_increasing_id()


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column's rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return []
    if pa.types.is_string(column.type) and column.null_count == 0 and column.buffers()[2] is not None:
        raw = memoryview(column.buffers()[2])
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].tolist()
        return [bytes(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
    return [b"" if x is None else x.encode() for x in column.to_pylist()]


def slices(items: list, sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about `most` together; a larger item goes alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(items):
        yield start, len(items)


def bounded_sample(labels: DataFrame, bound: int, *keys: str) -> DataFrame:
    """At most `bound` rows, the same for the same rows: those first by a hash of keys. A top-k, so no task holds more than `bound`."""
    return labels.orderBy(F.xxhash64(*keys), *keys).limit(bound)


WHITE = bytes(range(9, 14)) + b" "


def tokens(data: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased: what bytes.lower and bytes.split do."""
    return data.lower().split()


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, bound: int | None, value: str = "text") -> DataFrame:
    """value, label of the labelled training rows, or of at most `bound` of them: those of labels whose crc32(doc_id) mod modulus isn't held_out.

    A sample is taken from the labels alone, so what is broadcast is at most
    `bound` pairs of numbers. Of rows with one doc_id that of the least hash counts,
    so there are at most as many rows as labels however often docs repeats one; of labels the least."""
    train = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held_out))
    each = train.groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = docs.select("doc_id", value).join(each if bound is None else F.broadcast(bounded_sample(each, bound, "doc_id")), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by(value, F.xxhash64(value)).alias(value), F.min("label").alias("label")).select(value, "label")


def tree_total(parts: DataFrame, add: Callable[[object, object], object], width: int = 16) -> object | None:
    """The sum of parts (i: the number of the task, got: a pickled value), in the order of i; None where there is none.

    Values meet in groups of `width` numbers until at most `width` are left, which come
    to the driver: what it and a task hold doesn't grow with the tasks."""

    def total(rows) -> tuple[int, object]:
        rows = sorted(rows)
        return rows[0][0] // width, functools.reduce(add, (pickle.loads(got) for _, got in rows))

    def run(group: pa.Table) -> pa.Table:
        i, got = total(zip(group["i"].to_pylist(), group["got"].to_pylist(), strict=True))
        return pa.table({"i": [i], "got": [pickle.dumps(got)]}, schema=pa.schema([("i", pa.int64()), ("got", pa.binary())]))

    n = parts.rdd.getNumPartitions()
    while n > width:
        parts = parts.groupBy(F.expr(f"i div {width}").alias("_group")).applyInArrow(run, "i long, got binary")
        n = -(-n // width)
    found = [(r["i"], r["got"]) for r in parts.collect()]
    return total(found)[1] if found else None


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def logistic_fit(x: np.ndarray, y: np.ndarray | None, ridge: float, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; y None: every row of x is a difference that should be positive. No intercept is added."""
    w = np.zeros(x.shape[1])
    y = np.ones(len(x)) if y is None else y
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def row_bits(rows: DataFrame, slot: Column) -> DataFrame:
    """at, bits: a bit set over slots (not negative), 64 to a row."""
    slots = rows.select(slot.alias("slot"))
    return slots.groupBy(F.expr("cast(slot div 64 as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with underscores before it until no column of taken is called so, in whatever case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def drop_rows(docs: DataFrame, gone: DataFrame, bits: int = 24) -> DataFrame:
    """docs without the rows whose row_key() is in gone (rid).

    A bit set of 2**bits hashed keys, of at most 4 MB, is broadcast; only rows
    that it marks are joined with gone by a shuffle, so texts that stay don't move."""
    rid, at, mask, marked = (free_name(c, docs.columns) for c in ("rid", "at", "mask", "marked"))
    gone = gone.select(F.col("rid").alias(rid))
    slot = F.pmod(F.xxhash64(rid), F.lit(1 << bits))
    marks = row_bits(gone, slot).select(F.col("at").alias(at), F.col("bits").alias(mask))
    keyed = docs.withColumn(rid, row_key())
    keyed = keyed.join(F.broadcast(marks), F.floor(slot / 64).cast("int") == F.col(at), "left")
    keyed = keyed.withColumn(marked, F.coalesce(F.getbit(F.col(mask), F.pmod(slot, F.lit(64)).cast("int")) == 1, F.lit(False)))
    stay = keyed.filter(~F.col(marked)).unionByName(keyed.filter(F.col(marked)).join(gone, rid, "left_anti"))
    return stay.select([F.col(f"`{c}`") for c in docs.columns])
