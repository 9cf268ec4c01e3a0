"""Resampling of documents towards a target corpus by hashed n-gram importance.

Features are the runs of one to three words of a text. Distinct feature strings
are counted, each is hashed once to one of 10,000 buckets, buckets are added up
over all documents and over the target, and the log ratio of a bucket's smoothed
shares is its gain. Gains are joined back to each document's features; a
document's weight is their sum, and the Gumbel top-k of the weights is a draw
without replacement in proportion to their exponentials.

dictionary() is the table of all distinct strings of a corpus. As three features
begin at every word and most are rare, it is several times the texts: resample()
therefore builds the dictionary of each Arrow batch (chunk) in the task that reads
it, and what is shuffled are bucket counts. A chunk's distinct strings are pairs of
a string known before and a word, and so are their hashes: crc32 of the first part,
moved on by the length of the second, by exclusive or with the crc32 of the second.
"""

from __future__ import annotations

import collections
import functools
import itertools
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import give_back, materialize, row_key, ship, slices, table, text_bytes

BUCKETS = 10_000
#: Bytes of text that share a dictionary.
CHUNK = 1 << 20
#: What separates words: all of ASCII but digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, _BETWEEN), lambda w: w != "")


def runs_of(words: Column, longest: int = 3) -> Column:
    at = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i)), lambda n: F.concat_ws(" ", F.slice(words, i + 1, n)))
    return F.when(F.size(words) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 1), at))).otherwise(F.array().cast("array<string>"))


def dictionary(docs: DataFrame) -> DataFrame:
    """feature, n, bucket: every distinct feature string of docs (text), its count, and its bucket."""
    features = docs.select(F.explode(runs_of(words_of(F.col("text")))).alias("feature"))
    return features.groupBy("feature").agg(F.count("*").alias("n")).withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % BUCKETS)


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BYTE_SHIFT = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def _moved(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0, x & 255] ^ tables[1, x >> 8 & 255] ^ tables[2, x >> 16 & 255] ^ tables[3, x >> 24]


@functools.lru_cache(maxsize=4096)
def move(n: int) -> np.ndarray:
    """Tables, one a byte of the value, that move a crc32 on by n bytes."""
    if n == 0:
        return np.arange(256, dtype=np.uint32)[None] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    if n == 1:
        x = move(0)
        return x >> 8 ^ _BYTE_SHIFT[x & 255]
    half = move(n // 2)
    out = _moved(half, half)
    return _moved(move(1), out) if n % 2 else out


class Chunk:
    """The features of some texts: a bucket for each word's run of one, two and three, where the run ends in its text."""

    def __init__(self, texts: list[bytes]):
        number = collections.defaultdict(itertools.count().__next__)
        words = [np.fromiter(map(number.__getitem__, _WORD.findall(t.lower())), np.int64) for t in texts]
        self.n_words = np.array([len(w) for w in words], np.int64)
        self.edges = np.append(0, self.n_words.cumsum())
        at = np.concatenate(words) if words else np.zeros(0, np.int64)
        left = np.repeat(self.edges[1:], self.n_words) - np.arange(len(at))  # words from here to the text's end
        first = np.array([zlib.crc32(w) for w in number], np.uint32)
        after = np.array([zlib.crc32(b" " + w) for w in number], np.uint32)
        sizes, size_of = np.unique(np.array([len(w) + 1 for w in number], np.int64), return_inverse=True)
        tables = np.stack([move(int(n)) for n in sizes]) if len(sizes) else np.zeros((0, 4, 256), np.uint32)
        self.buckets, hashes, run = [], first, at
        self.buckets.append((first % BUCKETS).astype(np.int64)[at])
        for more in (1, 2):
            inside = np.flatnonzero(left > more)
            known, which = np.unique(run[inside] << 32 | at[inside + more], return_inverse=True)
            head, word = hashes[known >> 32], known & 0xFFFFFFFF
            size = size_of[word]
            hashes = tables[size, 0, head & 255] ^ tables[size, 1, head >> 8 & 255] ^ tables[size, 2, head >> 16 & 255] ^ tables[size, 3, head >> 24] ^ after[word]
            run = np.zeros(len(at), np.int64)
            run[inside] = which
            buckets = np.full(len(at), -1, np.int64)
            buckets[inside] = (hashes % BUCKETS)[which]
            self.buckets.append(buckets)

    def counts(self) -> np.ndarray:
        return sum(np.bincount(b[b >= 0], minlength=BUCKETS) for b in self.buckets)

    def sums(self, gain: np.ndarray) -> np.ndarray:
        """Of each text, the sum of its features' gains."""
        gain = np.append(gain, 0)  # -1: no run
        return np.diff(np.append(0, sum(gain[b] for b in self.buckets).cumsum())[self.edges])


def bucket_counts(docs: DataFrame) -> DataFrame:
    """bucket, n: how many features of docs (text) fall into a bucket, a row for each task."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in slices(texts, [len(t) for t in texts], CHUNK):
                total += Chunk(texts[a:b]).counts()
        give_back()
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long")


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """rid, doc_id, n_words, n_features, weight for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in slices(texts, [len(t) for t in texts], CHUNK):
                chunk = Chunk(texts[a:b])
                n = chunk.n_words
                columns = [*batch.select(["rid", "doc_id"]).slice(a, b - a).columns, pa.array(n), pa.array(sum(np.maximum(n - k, 0) for k in range(3))), pa.array(chunk.sums(gain))]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "n_words", "n_features", "weight"])
        give_back()

    return docs.select(row_key().alias("rid"), "doc_id", "text").mapInArrow(run, f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain for every bucket, of two tables bucket, n."""
    total = lambda df, n: df.groupBy("bucket").agg(F.sum("n").alias(n))
    every = corpus.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    both = every.join(total(corpus, "s"), "bucket", "left").join(total(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    all_of = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1).cast("double") * (F.col("all_s") + BUCKETS)) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + BUCKETS))
    return both.crossJoin(F.broadcast(all_of)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row


def gumbel(doc_id: Column) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("42:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored (rid, doc_id, n_words, score and more) with rank: 1, 2, .. for the highest percent of rows of at least least_words words, else null.

    Rows are dealt by ranges of the order itself, written, and numbered within a
    range from the counts of those before: no task sorts all that is drawn. Equal
    scores go by doc_id, nulls last; rows equal in both by their place in the file, so
    that a doc_id that repeats without end is spread over ranges too."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("rid")]
    can = scored.filter(F.col("n_words") >= least_words)
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(can.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "drawn")
    counts = dealt.groupBy("part").count()
    # a row for each range
    starts = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("start"), (F.sum("count").over(Window.partitionBy()) * percent / 100).cast("long").alias("k"))
    placed = dealt.join(F.broadcast(starts), "part")
    far = placed.filter(F.col("start") >= F.col("k")).withColumn("rank", F.lit(None).cast("long"))
    near = placed.filter(F.col("start") < F.col("k")).withColumn("n", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    near = near.withColumn("rank", F.when(F.col("n") <= F.col("k"), F.col("n").cast("long"))).drop("n")
    rest = scored.filter(~F.coalesce(F.col("n_words") >= least_words, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return near.unionByName(far).drop("part", "start", "k").unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs (doc_id, text), drawn towards target (text).

    Null and empty texts have no features: weight 0, and are not drawn. A null doc_id
    draws its noise as an empty one. Repeated rows are rows of their own. With an empty
    target all gains follow from no counts; with no documents there are no rows. Other
    columns are not read."""
    ratios = gains(bucket_counts(docs), bucket_counts(target))
    gain = np.array([r["gain"] for r in ratios.orderBy("bucket").collect()], np.int64)  # BUCKETS rows
    scored = materialize(weights(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"))), "weights")
    return draw(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_importance": op12_importance}
#: crc32 is linear: the exclusive or of a value for each byte, by its distance from the end, and of one for the length.
SQL = {
    "op12_importance": r"""
with recursive byte0 as (
  select b, list_reduce([b::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) t(b)
), place(j, b, v) as (
  select 0, b, v from byte0
  union all
  select j + 1, p.b, xor(p.v >> 8, z.v) from place p join byte0 z on z.b = p.v & 255 where j < (select max(strlen(text)) from (select unnest(string_split_regex(text, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as text from documents union all select unnest(string_split_regex(text, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark)) * 3 + 2
), start(n, v) as (
  select 0, 4294967295::bigint
  union all
  select n + 1, xor(s.v >> 8, z.v) from start s join byte0 z on z.b = s.v & 255 where n < (select max(j) + 1 from place)
), words as (
  select true as mine, row_number() over () as rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
  union all
  select false, -row_number() over (), null, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') from benchmark
), spots as (
  select mine, rid, w, unnest(range(1, len(w) + 1)) as i from words
), runs as (
  select mine, rid, array_to_string(w[i:i + k - 1], ' ') as f from spots, range(1, 4) t(k) where i + k - 1 <= len(w)
), counted as (
  select mine, rid, f, count(*) as n from runs group by all
), strings as (
  select f, row_number() over () as fid, encode(f) as raw, strlen(f) as len from (select distinct f from counted)
), bytes as (
  select fid, len, hex(raw) as h, unnest(range(len)) as i from strings
), crc as (
  select fid, xor(bit_xor(p.v), any_value(s.v)) as x
  from bytes join place p on p.j = len - 1 - i and p.b = ('0x' || substr(h, 2 * i + 1, 2))::bigint join start s on s.n = len group by fid
), dictionary as (
  select f, xor(x, 4294967295) % 10000 as bucket from crc join strings using (fid)
), buckets as (
  select bucket, sum(n) filter (mine) as s, sum(n) filter (not mine) as t from counted join dictionary using (f) group by bucket
), gains as (
  select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from buckets) + 10000)) / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from buckets) + 10000))))::bigint as gain from buckets
), weights as (
  select rid, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from counted join dictionary using (f) join gains using (bucket) where mine group by rid
), scored as (
  select rid, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from words left join weights using (rid) where mine
), drawn as (
  select rid, row_number() over (order by score desc, doc_id nulls last, rid) as rank from scored where n_words >= 20
)
select doc_id, n_features, weight, score, case when rank <= (select count(*) * 5 // 100 from drawn) then rank end as rank from scored left join drawn using (rid)
""",
}
