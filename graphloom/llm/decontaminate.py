"""Benchmark passages in documents, found with a few edits by the pigeonhole rule.

Texts are normalised to lower-case words of letters and digits. A test item may
be met with k edits, k being a share of its length; cut into k + 1 pieces, at
least one piece of it is then met unchanged. An Aho-Corasick automaton finds the
pieces of all items in one reading of a document, each hit says where the item
would lie, and Myers' bit-parallel edit distance over that window decides.

The items are a query set held by each task, in blocks of a bounded size; every
document is matched against every block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import lone, row_key, ship, table, text_bytes

#: Edits allowed for each byte of a normalised item.
RATE = 0.08
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))
_GAPS = re.compile(r"[\W_]+")


def normalise(data: bytes) -> str:
    """Lower-case words of letters and digits, one space apart, as a string with one character a UTF-8 byte."""
    if data.isascii():
        return b" ".join(data.translate(_WORDS).split()).decode("ascii")
    return _GAPS.sub(" ", data.decode("utf-8", "replace").lower()).strip().encode().decode("latin-1")


def best_match(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """The least edit distance of pattern to a substring of text and where the first such ends, if it is at most `most`; Myers 1999, one word of the pattern's length."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score, best = full, 0, m, None
    for end, c in enumerate(text, 1):
        eq = at.get(c, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1, minus << 1
        up = full & (minus | ~(vertical | plus))
        down = full & plus & vertical
        if score <= most and (best is None or score < best[0]):
            best = (score, end)
    return best


class Matcher:
    """items: (id or None, normalised text), none empty."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        self.items, self.rate = items, rate
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def budget(self, item: str) -> int:
        return int(self.rate * len(item))

    @property
    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for i, (_, text) in enumerate(self.items):
                pieces = self.budget(text) + 1
                cuts = [len(text) * j // pieces for j in range(pieces + 1)]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    piece = text[x:y]
                    a.add_word(piece, (y - x, [*a.get(piece, (0, []))[1], (i, x)]))
            if self.items:
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def find(self, data: bytes) -> dict[int, tuple[int, int]]:
        """For each item met, by its place in items: its least distance, and where in the normalised text the first such place ends."""
        if not self.items or not data:
            return {}
        text = normalise(data)
        starts: dict[int, set[int]] = {}
        for end, (n, uses) in self.automaton.iter(text):
            for i, offset in uses:
                starts.setdefault(i, set()).add(end - n + 1 - offset)
        out = {}
        for i, places in starts.items():
            item = self.items[i][1]
            k = self.budget(item)
            best, window = None, None
            for place in [*sorted(places), None]:  # places whose windows meet are looked at together
                if window and place is not None and place - k <= window[1]:
                    window = (window[0], place + len(item) + k)
                    continue
                if window:
                    low = max(0, window[0])
                    got = best_match(item, text[low : window[1]], k)
                    if got and (best is None or got[0] < best[0]):
                        best = (got[0], got[1] + low)
                window = (place - k, place + len(item) + k) if place is not None else None
            if best:
                out[i] = best
        return out


def matchers(benchmark: DataFrame, rate: float = RATE, block_bytes: int = 4 << 20) -> Iterator[Matcher]:
    """Matchers over all items of benchmark (item_id, text), block by block, none above about block_bytes of text.

    Items whose text is null or holds no letter or digit match nothing."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for b in range(blocks):
        rows = benchmark.filter((F.pmod(F.xxhash64("item_id", "text", row_key()), F.lit(blocks)) == b) & F.col("text").isNotNull()).select("item_id", "text").collect()
        yield Matcher(sorted(((r["item_id"], t) for r in rows if (t := normalise(r["text"].encode()))), key=lambda x: (x[0] is not None, x)), rate)


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, ends_at for each row of docs and item that it holds within rate x length edits.

    distance: the least over the document's places; ends_at: where in the
    normalised text (UTF-8 bytes) the first such place ends. Null and empty texts
    hold nothing; other columns are not read; repeated rows and repeated items
    each give their rows; a null doc_id or item_id is reported as null. Items shorter than
    1 / rate must be met unchanged. No shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, distance int, ends_at long"
    out = None
    for matcher in matchers(benchmark, rate):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lone("decontaminate")
            for batch in batches:
                found = [(d, shared.value.items[i][0], k, end) for d, t in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True) for i, (k, end) in shared.value.find(t).items()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "item_id", "distance", "ends_at"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs that hold no item, all columns as they were."""
    ship(docs.sparkSession)
    for matcher in matchers(benchmark, rate):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lone("decontaminate")
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.find(t) for t in text_bytes(batch.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
SQL: dict[str, str] = {}
