"""Removal of byte strings that occur twice, by bucket-pointer refinement of a sparse suffix array.

Suffixes are those that start at anchors: of each window of consecutive q-grams
the one with the least hash, so two equal strings of `length` bytes have the same
anchors at the same places, four at least. The suffixes' buckets are first their
q-grams. A bucket is refined by the identifiers that its suffixes' later offsets
have: those of the next anchor make pairs, and the identifiers of pairs, reused,
make runs of four. After each round what is alone in its bucket is dropped, as no
string that holds it can occur twice. Identifiers name equal prefixes and need no
order between buckets, so a round is a window over each text's own suffixes, a
count by identifier and a join.

What is left are the starts of strings all of whose runs of four are shared.
Those that follow each other and have the same first anchor are a context: one
row for some forty starts. Contexts are equal or not by a 128-bit digest of all
bytes that their strings cover; where a context occurs twice all its starts are
repeated. A context that is alone, but shares its first run with another, is
settled start by start, by a hash of `length` bytes within that run's bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.occurrences import sift
from graphloom.llm.common import discard, materialize, row_key, ship, slices, table, text_bytes
from graphloom.llm.components import join_hot
from graphloom.llm.shingles import _BYTE, _power_tables, mix

#: Bytes of a q-gram, runs of so many anchors, bytes that are hashed at once, low bits of an order that hold the place.
GRAM, RUN, PIECE, PLACE = 40, 4, 1 << 19, 24
_LOW = np.uint64((1 << PLACE) - 1)
_OTHER = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_of(length: int) -> int:
    """How many consecutive q-grams have an anchor, such that `length` bytes have RUN anchors."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    return (length - GRAM) // RUN


def hashes(data: np.ndarray, width: int, value: np.ndarray = _BYTE) -> np.ndarray:
    """A hash of each `width` bytes that follow each other."""
    n = len(data)
    up, down = _power_tables(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * up[:n])])
    return mix((sums[width:] - sums[:-width]) * down[: max(0, n - width + 1)])


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values that follow each other."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


class Anchors:
    """Of texts end to end (of PIECE bytes together at most, or one text): each anchor's place, hash, text, number in its text, and the first and last window that has it."""

    def __init__(self, texts: list[bytes], length: int):
        window = window_of(length)
        self.length, self.sizes = length, np.array([len(t) for t in texts], np.int64)
        self.ends = self.sizes.cumsum()
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        reach = GRAM + window - 1
        self.last_window = length - reach  # of those inside a string, counted from its start
        self.end_of = np.repeat(self.ends, self.sizes) if len(texts) > 1 else None
        found = []
        for t in range(0, len(self.data) - reach + 1, PIECE):
            block = self.data[t : t + PIECE + reach - 1]
            if len(block) < reach:
                break
            grams = hashes(block, GRAM)
            order = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
            at = (least(order, window) & _LOW).astype(np.int64)
            inside = np.arange(t, t + len(at)) + reach <= self.end_of[t : t + len(at)] if self.end_of is not None else np.ones(len(at), bool)
            same = np.append(False, (at[1:] == at[:-1]) & inside[:-1])
            first = np.flatnonzero(inside & ~same)
            last = np.flatnonzero(inside & np.append(~(same[1:] & inside[1:]), True))
            found.append((at[first] + t, grams[at[first]].view(np.int64), first + t, last + t))
        place, gram, first, last = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        fresh = np.append(True, place[1:] != place[:-1])[: len(place)]  # an anchor that two pieces have counts once
        self.place, self.gram, self.first = place[fresh], gram[fresh], first[fresh]
        self.last = last[np.append(fresh[1:], True)[: len(last)]]
        self.text = np.searchsorted(self.ends, self.place, "right")
        self.base = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def shared(self, run: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts: first and last start, and first anchor. known: of each anchor, whether the run that it begins is shared."""
        out, dead = [], np.append(0, (~known).cumsum())
        for t in range(0, len(self.data), PIECE):
            starts = np.arange(t, min(t + PIECE, len(self.data)))
            if self.end_of is not None:
                starts = starts[starts + self.length <= self.end_of[starts]]
            else:
                starts = starts[starts + self.length <= len(self.data)]
            if not len(starts):
                continue
            a = np.searchsorted(self.first, starts, "right") - 1
            b = np.searchsorted(self.first, starts + self.last_window, "right") - 1
            live = dead[b - RUN + 2] == dead[a]
            starts, a = starts[live], a[live]
            if len(starts):
                cut = np.append(True, (starts[1:] != starts[:-1] + 1) | (a[1:] != a[:-1]))
                begin = np.flatnonzero(cut)
                out.append((starts[begin], starts[np.append(begin[1:], len(starts)) - 1], a[begin]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    yield from slices(texts, [len(t) for t in texts], PIECE)


def anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    """rid, i, place, id: the anchors of each text (rid, text) in order, with their q-grams' hashes."""
    ship(keyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rid = text_bytes(batch.column("text")), batch.column("rid").to_numpy()
            for a, b in _groups(texts):
                x = Anchors(texts[a:b], length)
                begin = np.append(0, x.ends)[x.text]
                yield pa.RecordBatch.from_arrays([pa.array(rid[a:b][x.text]), pa.array((np.arange(len(x.text)) - x.base[x.text]).astype(np.int32)), pa.array((x.place - begin).astype(np.int32)), pa.array(x.gram)], names=["rid", "i", "place", "id"])

    return keyed.filter(F.octet_length("text") >= length).mapInArrow(run, "rid long, i int, place int, id long")


def twice(rows: DataFrame, name: str) -> DataFrame:
    """The written rows whose id occurs twice at least, written; one id may have any share of the rows."""
    counts = materialize(rows.groupBy("id").count().filter("count > 1"), f"{name}ids")
    met = sift(rows, counts, F.col("id"), counts.count())
    out = materialize(join_hot(met, counts, "id", "count", rows.count()).drop("count"), name)
    discard(rows)
    discard(counts)
    return out


def refined(rows: DataFrame, step: int) -> DataFrame:
    """Runs of step anchors to runs of twice as many: a new id of the run's own, that of the run `step` anchors on, and how far that is."""
    here = Window.partitionBy("rid").orderBy("i")
    later = lambda c: F.lead(c, step).over(here)
    met = rows.withColumns({"j": later("i"), "far": later("place"), "next": later("id")}).filter(F.col("j") == F.col("i") + step)
    return met.select("rid", "i", "place", F.xxhash64("id", F.col("far") - F.col("place"), "next").alias("id"))


def context_rows(held: DataFrame, length: int) -> DataFrame:
    """rid, low, high, run, key: of each text (rid, text, runs) the starts low..high of strings whose runs are all shared, and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rid = text_bytes(batch.column("text")), batch.column("rid").to_numpy()
            lists = batch.column("runs")
            edges, parts = lists.offsets.to_numpy(), lists.values
            i, ids = parts.field("i").to_numpy(), parts.field("id").to_numpy()
            for a, b in _groups(texts):
                x = Anchors(texts[a:b], length)
                known, run_id = np.zeros(len(x.place), bool), np.zeros(len(x.place), np.int64)
                mine = slice(edges[a], edges[b])
                at = np.repeat(x.base[: b - a], np.diff(edges[a : b + 1])) + i[mine]
                known[at], run_id[at] = True, ids[mine]
                low, high, first = x.shared(run_id, known)
                of, whole = x.text[first], x.data.tobytes()
                begin = np.append(0, x.ends)[of]
                keys = [hashlib.blake2b(whole[p : q + length], digest_size=16).digest() for p, q in zip(low.tolist(), high.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rid[a:b][of]), pa.array((low - begin).astype(np.int32)), pa.array((high - begin).astype(np.int32)), pa.array(run_id[first]), pa.array(keys, pa.binary())], names=["rid", "low", "high", "run", "key"])

    return held.mapInArrow(run, "rid long, low int, high int, run long, key binary")


def start_rows(held: DataFrame, length: int) -> DataFrame:
    """rid, low, run, alone, hashes: of each context asked for (rid, text, asked) the hash of every start's string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, rid, asked in zip(text_bytes(batch.column("text")), batch.column("rid").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                asked.sort(key=lambda x: x["low"])
                data, k = np.frombuffer(text, np.uint8), 0
                while k < len(asked):  # stretches of the text that contexts lie in, PIECE bytes at most or one context
                    n = k + 1
                    while n < len(asked) and asked[n]["low"] <= asked[n - 1]["high"] + length and asked[n]["high"] - asked[k]["low"] < PIECE:
                        n += 1
                    t = asked[k]["low"]
                    h = hashes(data[t : asked[n - 1]["high"] + length], length, _OTHER).view(np.int64)
                    rows = asked[k:n]
                    yield pa.RecordBatch.from_arrays([pa.array([rid] * (n - k)), pa.array([r["low"] for r in rows], pa.int32()), pa.array([r["run"] for r in rows]), pa.array([r["alone"] for r in rows]), pa.array([h[r["low"] - t : r["high"] - t + 1] for r in rows], pa.list_(pa.int64()))], names=["rid", "low", "run", "alone", "hashes"])
                    k = n

    return held.mapInArrow(run, "rid long, low int, run long, alone boolean, hashes array<long>")


def remove(held: DataFrame, length: int) -> DataFrame:
    """rid, n_removed, n_spans, kept: each text (rid, text, cuts) without the bytes that strings starting at low..high cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column("cuts")
            edges, low, high = cuts.offsets.to_numpy(), cuts.values.field("low").to_numpy(), cuts.values.field("high").to_numpy()
            out = []
            for k, text in enumerate(text_bytes(batch.column("text"))):
                mine = slice(edges[k], edges[k + 1])
                depth = np.zeros(len(text) + 1, np.int32)
                np.add.at(depth, low[mine], 1)
                np.add.at(depth, high[mine] + length, -1)
                gone = depth.cumsum()[:-1] > 0
                out.append((int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), np.frombuffer(text, np.uint8)[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["rid", "n_removed", "n_spans", "kept"])

    return held.mapInArrow(run, "rid long, n_removed long, n_spans long, kept binary")


def repeated_starts(keyed: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """The texts (rid, text and more) that may hold repeated strings, and rid, cuts (array of low, high): where such strings of `length` bytes start; both written."""
    rows = materialize(anchor_rows(keyed, length), "anchors")
    rows = twice(rows, "shared")
    for step in (1, 2):  # to pairs, to runs of four
        longer = materialize(refined(rows, step), "runs")
        discard(rows)
        rows = twice(longer, "shared")
    by_text = materialize(rows.groupBy("rid").agg(F.collect_list(F.struct("i", "id")).alias("runs")), "bytext")
    discard(rows)
    texts = by_text.select("rid")
    held = materialize(sift(keyed, texts, F.col("rid"), by_text.count()).join(by_text, "rid"), "held")
    discard(by_text)
    contexts = materialize(context_rows(held, length), "contexts")
    kinds = materialize(contexts.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("rid", "low", "high", "run")).alias("one")), "kinds")
    many = kinds.filter("n > 1").select("key", "n")
    sure = join_hot(contexts, many, "key", "n", contexts.count()).select("rid", "low", "high")
    # buckets in which a context is alone beside others: of each kind of context one is hashed start by start
    one = kinds.select("n", "one.*")
    buckets = materialize(one.groupBy("run").agg(F.count("*").alias("m"), F.min("n").alias("few")).filter("m > 1 and few = 1").select("run", "m"), "buckets")
    asked = join_hot(one, buckets, "run", "m", kinds.count()).groupBy("rid").agg(F.collect_list(F.struct("low", "high", "run", (F.col("n") == 1).alias("alone"))).alias("asked"))
    starts = start_rows(held.select("rid", "text").join(asked, "rid"), length).select("rid", "run", "alone", F.posexplode("hashes").alias("k", "hash"), "low")
    starts = materialize(starts.select("rid", "run", "alone", (F.col("low") + F.col("k")).alias("start"), "hash"), "starts")
    again = materialize(starts.groupBy("run", "hash").count().filter("count > 1"), "again")
    met = sift(starts.filter("alone"), again, F.struct("run", "hash"), again.count())
    found = join_hot(met, again, ["run", "hash"], "count", starts.count()).select("rid", F.col("start").alias("low"), F.col("start").alias("high"))
    places = materialize(sure.unionByName(found).groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("cuts")), "cuts")  # fewer than a text has bytes
    for used in (contexts, kinds, buckets, starts, again):
        discard(used)
    return held, places


def removals(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs as rid, doc_id, text; rid, n_removed, n_spans, kept of the texts that lose bytes; and the written table that this is read from."""
    keyed = docs.select(row_key().alias("rid"), "doc_id", "text")
    held, cuts = repeated_starts(keyed.select("rid", "text"), length)
    return keyed, remove(held.select("rid", "text").join(cuts, "rid"), length), held


def drop_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: each row of docs (doc_id, text) without the bytes of any string of `length` bytes that also starts elsewhere in docs.

    Strings are those of UTF-8 bytes and lie in one text; overlapping ones count, also
    of one text, and all are judged on the whole input. kept is null where nothing is
    removed. Null and empty texts: no bytes, nothing removed. Repeated rows are texts of
    their own, so a row of `length` bytes that occurs twice loses all its bytes in both.
    Rows without a doc_id are texts like others. An empty table gives no rows. Other
    columns are not read. docs must be a scan of files, as row_key asks."""
    keyed, gone, _ = removals(docs, length)
    return _counted(keyed, gone).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def _counted(keyed: DataFrame, gone: DataFrame, *more: Column) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return keyed.select("rid", "doc_id", size, *more).join(gone, "rid", "left").na.fill(0, ["n_removed", "n_spans"])


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed, gone, held = removals(table(spark, sf_dir, "documents"), 400)
    less = materialize(gone.select("rid", "n_removed", "n_spans", F.sha2("kept", 256).alias("less")), "less")
    discard(held)
    rows = _counted(keyed, less, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("whole"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce("less", "whole").alias("kept_sha256"))


QUERIES = {"op11_suffix_dedup": op11_suffix_dedup}
SQL: dict[str, str] = {}
