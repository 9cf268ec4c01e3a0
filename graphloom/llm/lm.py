"""Log-likelihood of documents under a recurrent language model and under counts.

Counts of words cover all training documents. The most frequent words are the
members of the model's classes; every other word, also one never met, belongs to
an open class by its ending, and has within it the probability of its count.
The network is trained on all training documents by many trainers, each on its
part, whose parameters are averaged after each round.

Broadcast: the network, and the counts of at most 2**17 frequent words; a word of
over 64 bytes goes by a digest everywhere. Counts of other words are met by a join;
none of them has more than 1 in some tens of thousands of all tokens, as that many
words are more frequent.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import discard, lone, materialize, remainder, row_key, ship, slices, table, text_bytes, tokens
from graphloom.llm.gru import WIDTH, Net, Shape
from graphloom.llm.shingles import word_hashes, word_spans

#: The end of a text as a token; no word holds white space.
END = b"\n"
CLOSING = b".,;:!?"
OPEN = 48
HEAD, LONGEST = 1 << 17, 64
#: Bytes of text whose words are looked up together.
SLICE = 1 << 19


def token_of(word: bytes) -> bytes:
    """What stands for a word in tables: itself, or a digest of a long one, after white space as no word has."""
    return word if len(word) <= LONGEST else b" " + hashlib.sha256(word).digest()


def open_class(word: bytes) -> int:
    """An open class for a word: by its last two bytes before closing punctuation, and whether there is some."""
    core = word.rstrip(CLOSING)
    return zlib.crc32(core[-2:]) % (OPEN // 2) * 2 + (len(core) < len(word))


def count_words(docs: DataFrame) -> DataFrame:
    """token binary, c long over all rows of docs, END once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            for word in [w for w in counts if len(w) > LONGEST]:
                counts[token_of(word)] += counts.pop(word)
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["token", "c"])

        for batch in batches:
            for text in text_bytes(batch.column("text")):
                counts.update(tokens(text))
                counts[END] += 1
                if len(counts) > 200_000:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


#: open_class of one and of two last bytes, by their number.
_ONE = np.array([zlib.crc32(bytes([i])) % (OPEN // 2) * 2 for i in range(256)], np.int32)
_TWO = np.array([zlib.crc32(bytes([i >> 8, i & 255])) % (OPEN // 2) * 2 for i in range(1 << 16)], np.int32)
_CLOSING = np.isin(np.arange(256), list(CLOSING))


def open_classes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """open_class of words that lie in data."""
    core = ends.copy()
    while True:
        more = (core > begins) & _CLOSING[data[np.maximum(core, 1) - 1]]
        if not more.any():
            break
        core -= more
    n = core - begins
    last = data[np.maximum(core, 1) - 1].astype(np.int32)
    two = _TWO[data[np.maximum(core, 2) - 2].astype(np.int32) << 8 | last]
    return np.where(n > 1, two, np.where(n == 1, _ONE[last], zlib.crc32(b"") % (OPEN // 2) * 2)) + (core < ends)


class Vocabulary:
    """Symbols: members first (END is 0), then other frequent words, then one for each open class."""

    def __init__(self, head: list[tuple[bytes, int]], members: int, n: int, v: int, open_n: np.ndarray, open_v: np.ndarray):
        """head: frequent words with counts, most frequent first, END first of all."""
        self.members = min(members, len(head))
        # words are told by 64-bit hashes; END and digests of long words are none that a text holds as such
        own = [(i, w) for i, (w, _) in enumerate(head) if w != END and not w.startswith(b" ")]
        hashes, _ = word_hashes([w for _, w in own])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.of_hash = hashes[order], np.array([i for i, _ in own], np.int32)[order]
        self.long = {w: i for i, (w, _) in enumerate(head) if w.startswith(b" ")}
        self.head = len(head)
        c = np.array([c for _, c in head], float)
        rest = np.array([open_class(w) for w, _ in head[self.members :]], np.int64)
        self.open_total = open_n + open_v + 1.0
        own = -(-self.members // WIDTH)
        every = np.arange(OPEN)
        self.class_of = np.concatenate([np.arange(self.members) // WIDTH, own + rest, own + every])
        self.row_of = np.concatenate([np.arange(self.members), self.members + rest, self.members + every])
        self.base = np.concatenate([np.log10((c + 1) / (n + v + 1)), np.zeros(OPEN)])
        within = np.log10((c[self.members :] + 1) / self.open_total[rest])
        self.within = np.concatenate([np.zeros(self.members), within, np.zeros(OPEN)])
        self.known = np.concatenate([c > 0, np.zeros(OPEN, bool)])
        self.counts = c[: self.members]

    def symbols(self, texts: list[bytes], rest: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts' words, with an END after each text's; how many each text has; with rest the tokens that are not among the head, which text each is of, how often the text has it, and its open class."""
        whole, begins, ends, hashes, at = word_spans(texts)
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        hit = self.hashes[place] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        hit &= ends - begins <= LONGEST
        symbol = np.zeros(len(hashes), np.int32)
        symbol[hit] = self.of_hash[place[hit]]
        miss = np.flatnonzero(~hit)
        first, last = begins[miss], ends[miss]
        symbol[miss] = self.head + open_classes(np.frombuffer(whole, np.uint8), first, last)
        for i in np.flatnonzero(last - first > LONGEST).tolist():
            token = token_of(whole[first[i] : last[i]])
            symbol[miss[i]] = self.long.get(token, self.head + open_class(token))
        count = np.diff(at)
        text = np.repeat(np.arange(len(texts)), count)
        out = np.zeros(len(hashes) + len(texts), np.int32)
        out[np.arange(len(hashes)) + text] = symbol
        new = miss[symbol[miss] >= self.head] if rest else miss[:0]
        # a text's repeats of a word lie together; long words go by their tokens, as their hashes may be made to agree
        wide = ends[new] - begins[new] > LONGEST
        long, new = new[wide], new[~wide]
        new = new[np.lexsort((hashes[new], text[new]))]
        own = np.ones(len(new), bool)
        own[1:] = (hashes[new[1:]] != hashes[new[:-1]]) | (text[new[1:]] != text[new[:-1]])
        cuts = np.flatnonzero(own)
        times, new = np.diff(np.append(cuts, len(new))), new[cuts]
        rare = [whole[a:b] for a, b in zip(begins[new].tolist(), ends[new].tolist(), strict=True)]
        met = Counter(zip(text[long].tolist(), [token_of(whole[a:b]) for a, b in zip(begins[long].tolist(), ends[long].tolist(), strict=True)], strict=True))
        of = np.append(text[new], np.array([i for i, _ in met], np.int64))
        kind = np.append(symbol[new] - self.head, np.array([open_class(w) for _, w in met], np.int64))
        return out, count + 1, rare + [w for _, w in met], of, np.append(times, np.array(list(met.values()), np.int64)), kind

    def each(self, texts: list[bytes]) -> list[np.ndarray]:
        """The symbols of each text."""
        out = []
        for a, b in slices(texts, [len(t) + 1 for t in texts], SLICE):
            symbols, n, *_ = self.symbols(texts[a:b], rest=False)
            out += np.split(symbols, np.cumsum(n)[:-1])
        return out


def learn_vocabulary(counts: DataFrame, members: int) -> Vocabulary:
    """From the table of counts: sums over all of it, and its frequent words."""
    bucket = F.floor(F.log2("c") * 8).cast("int")
    usable = F.col("token") != F.lit(END)
    hist = counts.groupBy(bucket.alias("b")).agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(usable.cast("int")).alias("u")).collect()
    n, v = sum(r["n"] for r in hist), sum(r["v"] for r in hist)
    least, room = None, HEAD
    for r in sorted(hist, key=lambda r: -r["b"]):
        if r["u"] > room:
            break
        least, room = r["b"], room - r["u"]
    head: list[tuple[bytes, int]] = []
    if least is not None:
        got = counts.filter(usable & (bucket >= least)).toArrow()
        head = sorted(zip(got["token"].to_pylist(), got["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    end = counts.filter(F.col("token") == F.lit(END)).collect()
    head.insert(0, (END, end[0]["c"] if end else 0))
    named = counts.sparkSession.sparkContext.broadcast({w for w, _ in head[:members]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, c = batch.column("token").to_pylist(), batch.column("c").to_numpy()
            kind = np.array([-1 if w in named.value else open_class(w) for w in words], np.int64)
            use = kind >= 0
            sums, kinds = np.bincount(kind[use], c[use], OPEN), np.bincount(kind[use], minlength=OPEN)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(OPEN)), pa.array(sums.astype(np.int64)), pa.array(kinds.astype(np.int64))], names=["k", "n", "v"])

    open_n, open_v = np.zeros(OPEN), np.zeros(OPEN)
    for r in counts.mapInArrow(run, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        open_n[r["k"]], open_v[r["k"]] = r["n"], r["v"]
    out = Vocabulary(head, members, n, v, open_n, open_v)
    out.total, out.distinct, out.open_n = n, v, open_n
    return out


def _averaged(models: DataFrame, width: int = 4) -> np.ndarray:
    """The mean of the rows' arrays (i, flat), width rows at a time."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        weight = rows["weight"].to_numpy(float)
        total = sum(np.frombuffer(b, np.float32) * np.float32(w / weight.sum()) for b, w in zip(rows["flat"], weight, strict=True))
        return pd.DataFrame({"i": [int(rows["i"].iloc[0]) // width], "weight": [weight.sum()], "flat": [total.astype(np.float32).tobytes()]})

    n = models.count()
    while n > width:
        models = materialize(models.groupBy(F.expr(f"i div {width}")).applyInPandas(mean, "i long, weight double, flat binary"), "models")
        n = -(-n // width)
    return np.frombuffer(mean(models.toPandas())["flat"][0], np.float32).copy()


def learn_network(train: DataFrame, vocabulary: Vocabulary, hidden: int, rounds: int, tokens_each: int) -> tuple[Shape, np.ndarray]:
    """A network from all rows of train (doc_id, text), each gone over once.

    A round goes over one of `rounds` parts of them, by a hash; a trainer gets about
    tokens_each tokens of it, from neighbouring files, so no text is moved."""
    spark = train.sparkSession
    shape = Shape(vocabulary.members, OPEN, hidden)
    flat = np.concatenate([shape.start(vocabulary.counts, vocabulary.open_n), np.full(shape.total, 1e-8, np.float32)])
    trainers = max(1, round(vocabulary.total / max(1, rounds) / tokens_each))
    words = spark.sparkContext.broadcast(vocabulary)
    for r in range(rounds):
        now = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], now=now, r=r) -> Iterator[pa.RecordBatch]:
            v = words.value
            mine = now.value.copy()
            net, squares = Net(shape, mine[: shape.total], v.row_of, v.class_of), mine[shape.total :]
            seen, held, size = 0, [], 0
            for batch in batches:
                new = v.each(text_bytes(batch.column("text")))
                held += new
                size += sum(map(len, new))
                if size > 1_000_000:
                    net.train(held, squares)
                    seen, held, size = seen + size, [], 0
            if held:
                net.train(held, squares)
                seen += size
            if seen:
                from pyspark import TaskContext

                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen)]), pa.array([mine.tobytes()], pa.binary())], names=["i", "weight", "flat"])

        part = train.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(rounds)) == r).select("text").coalesce(trainers)
        models = materialize(part.mapInArrow(run, "i long, weight double, flat binary"), "models")
        if not models.isEmpty():
            flat = _averaged(models)
        discard(models)
        now.unpersist()
    return shape, flat[: shape.total]


def score_documents(docs: DataFrame, train: DataFrame, members: int = 1536, hidden: int = 24, rounds: int = 4, tokens_each: int = 2_000_000, chunk_tokens: int = 1_500_000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    train: rows (doc_id, text) to count and learn from. Words: A-Z lower-cased, parted by
    ASCII white space, then one end. base_score: add-one counts, log10. score: the
    network's log10 probability of the whole text, state carried from its begin to its
    end. Null text counts as empty: its end alone. Without training rows every base_score
    is 0. Repeated rows each give a row; other columns are not read."""
    spark = docs.sparkSession
    ship(spark)
    counts = materialize(count_words(train), "counts")
    vocabulary = learn_vocabulary(counts, members)
    shape, flat = learn_network(train, vocabulary, hidden, rounds, tokens_each)
    shared, key = spark.sparkContext.broadcast((vocabulary, shape, flat)), uuid.uuid4().int

    def scorer() -> tuple[Vocabulary, Net]:
        v, shape, flat = shared.value
        return v, Net(shape, flat, v.row_of, v.class_of)

    own_type = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def rows(rid: np.ndarray, token: list[bytes], times: np.ndarray, kind: np.ndarray, own: pa.Array) -> pa.RecordBatch:
        columns = [pa.array(rid, pa.int64()), pa.array(token, pa.binary()), pa.array(times, pa.int32()), pa.array(kind, pa.int32()), own]
        return pa.RecordBatch.from_arrays(columns, names=["rid", "token", "times", "kind", "own"])

    def scored(v: Vocabulary, net: Net, ids: list[int], names: list[int | None], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """A row for each of a text's words whose count is to be met, and the text's own row."""
        rid = np.array(ids, np.int64)
        symbols, n, known, base, fixed = [], [], [], [], []
        for a, b in slices(texts, [len(t) + 1 for t in texts], SLICE):
            s, count, rare, of, times, kind = v.symbols(texts[a:b])
            begin = np.cumsum(count) - count
            symbols += np.split(s, begin[1:])
            n.append(count)
            known.append(np.add.reduceat(v.known[s], begin, dtype=np.int64))
            base.append(np.add.reduceat(v.base[s], begin))
            fixed.append(np.add.reduceat(v.within[s], begin))
            if rare:
                yield rows(rid[a + of], rare, times, kind, pa.nulls(len(rare), own_type))
        score = net.score(symbols) / np.log(10) + np.concatenate(fixed)
        parts = [pa.array(names, pa.int64()), *(pa.array(np.concatenate(x), t) for x, t in ((n, pa.int64()), (known, pa.int64()), (base, pa.float64()))), pa.array(score, pa.float64())]
        none = np.zeros(len(ids), np.int32)
        # a text's own row has a key that is no word, so these rows spread like words do
        yield rows(rid, [b" %d" % i for i in ids], none, none, pa.StructArray.from_arrays(parts, fields=list(own_type)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = lone(key, scorer)
        ids, names, texts, size = [], [], [], 0
        for batch in batches:
            ids += batch.column("rid").to_pylist()
            names += batch.column("doc_id").to_pylist()
            new = text_bytes(batch.column("text"))
            texts += new
            size += sum(len(t) // 5 + 1 for t in new)
            if size > chunk_tokens:
                yield from scored(v, net, ids, names, texts)
                ids, names, texts, size = [], [], [], 0
        if ids:
            yield from scored(v, net, ids, names, texts)

    ordered = docs.select(row_key().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = ordered.mapInArrow(run, "rid long, token binary, times int, kind int, own struct<doc_id: long, n_tokens: long, n_known: long, base_score: double, score: double>")
    met = parts.join(counts.withColumnRenamed("token", "t"), F.col("token") == F.col("t"), "left")
    c = F.coalesce("c", F.lit(0))
    whole = F.element_at(F.array([F.lit(float(x)) for x in vocabulary.open_total]), F.col("kind") + 1)
    n_v = float(vocabulary.total + vocabulary.distinct + 1)
    # rid tells rows apart; a row's id comes with its own part, so rows are numbered in one reading alone
    out = met.groupBy("rid").agg(
        F.max("own.doc_id").alias("doc_id"), F.sum("own.n_tokens").alias("n_tokens"), F.sum(F.coalesce("own.n_known", F.when(c > 0, F.col("times")).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("own.base_score", F.col("times") * F.log10((c + 1) / n_v))).alias("base_score"), F.sum(F.coalesce("own.score", F.col("times") * F.log10((c + 1) / whole))).alias("score"))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 7) == 2
    out = score_documents(docs, docs.filter(~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
SQL: dict[str, str] = {}
