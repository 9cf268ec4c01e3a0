"""Document quality by pairwise ranking.

Bradley-Terry: a document's strength is linear in its features, and the better
of a pair wins with the logistic of the difference of strengths. All pairs of a
preferred and a rejected labelled document give the weights, by logistic loss on
feature differences. A quantile of the training scores is the threshold; the
reported score is a logistic of the strength that is 0.7 there.

Pairs are not formed: what a document gets from all those of the other kind is a
function of its strength and of their counts by strength, so a pass over the
labelled documents gives the loss of all pairs, and another its gradient. Counts
lie on a grid, between whose points the logistic is taken as linear.
"""

from __future__ import annotations

import operator
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import discard, labelled, lone, materialize, remainder, ship, sigmoid, table, text_bytes, tree_total

#: Bytes counted as one kind each.
KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t", "line": b"\n\r", "stop": b".?", "comma": b",;:", "shout": b"!", "bar": b"|",
    "hash": b"#", "and": b"&", "star": b"*", "dollar": b"$", "percent": b"%", "brace": b"{}[]<>=\\/", "quote": b"\"'`()", "dash": b"-_~+^@", "beyond": range(128, 256),
}
_KIND = np.zeros((256, len(KINDS)))
for _i, _members in enumerate(KINDS.values()):
    _KIND[list(_members), _i] = 1
N_FEATURES = len(KINDS) + 8
#: The reported score of a document at the threshold.
AT_THRESHOLD = 0.7


def features(data: bytes) -> np.ndarray:
    """Shares of kinds of bytes, and of lengths, repeats and distinct words and lines; all 0 for an empty text."""
    out = np.zeros(N_FEATURES)
    words = data.split()
    if not words:
        return out
    k, n, w = len(KINDS), len(data), len(words)
    out[:k] = np.sqrt(np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _KIND / n)
    lines = data.split(b"\n")
    distinct = len(set(words))
    out[k:] = [
        np.log1p(w), n / w / 10, np.log(distinct + 1) / np.log(w + 1), sum(map(operator.eq, words, words[1:])) / w, len(set(lines)) / len(lines), np.log(w / len(lines) + 1), distinct / w,
        sum(map(bytes.istitle, words)) / w,
    ]
    return out


def training_rows(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """x (features), label of every labelled training document. Features are joined with labels, so no text is moved."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lone("quality")
        for batch in batches:
            x = [features(t).astype("<f4").tobytes() for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.binary())], names=["doc_id", "x"])

    given = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held_out))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("x", T.BinaryType())])
    return labelled(given.mapInArrow(run, schema), labels, "quality", modulus, held_out, None, "x")


class Binned:
    """Sums by place on a grid: those of a value between two points go to both, the nearer one getting more."""

    def __init__(self, at: np.ndarray, step: float, columns: np.ndarray):
        low = np.floor(at / step).astype(np.int64)
        part = at / step - low
        self.first, self.step = int(low.min()), step
        low -= self.first
        n = int(low.max()) + 2
        self.sums = np.stack([np.bincount(low, c * (1 - part), n) + np.bincount(low + 1, c * part, n) for c in columns.T], 1)

    def __add__(self, other: Binned) -> Binned:
        out = object.__new__(Binned)
        out.first, out.step = min(self.first, other.first), self.step
        out.sums = np.zeros((max(self.first + len(self.sums), other.first + len(other.sums)) - out.first, self.sums.shape[1]))
        for b in (self, other):
            out.sums[b.first - out.first :][: len(b.sums)] += b.sums
        return out

    def against(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """For each point the sums of all points, each times of(its place less this point's)."""
        m = len(self.sums)
        n = 1 << (3 * m).bit_length()
        kernel = np.fft.rfft(of(np.arange(1 - m, m) * self.step), n)[:, None]
        return np.fft.irfft(np.fft.rfft(self.sums[::-1], n, axis=0) * kernel, n, axis=0)[m - 1 : 2 * m - 1][::-1]

    def read(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Values that are given by point, at other places."""
        return np.interp(at / self.step - self.first, np.arange(len(values)), values)


#: Adds up, over batches (features, labels) of all training rows, what a function gives for each: a tuple; None without rows.
Total = Callable[[Callable[[np.ndarray, np.ndarray], tuple]], tuple | None]


def add(one: tuple | None, two: tuple) -> tuple:
    return two if one is None else tuple(a + b for a, b in zip(one, two, strict=True))


def total_of(rows: DataFrame) -> Total:
    """Of rows (x, label): a task makes one tuple, and they are added up in a tree."""

    def total(part: Callable) -> tuple | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            got = None
            for batch in batches:
                if batch.num_rows:
                    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<f4").reshape(-1, N_FEATURES)
                    got = add(got, part(x.astype(float), batch.column("label").to_numpy()))
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([pickle.dumps(got)], pa.binary())], names=["i", "got"])

        return tree_total(rows.mapInArrow(run, "i long, got binary"), add)

    return total


def _slope(t: np.ndarray) -> np.ndarray:
    return sigmoid(t) * sigmoid(-t)


def _softplus(t: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, t)


class Ranker:
    #: Grids for counts, and for the second derivative, which only steers the steps.
    FINE, COARSE = 1 / 64, 1 / 4
    #: Edges between which rows are counted in a pass.
    EDGES = 4096

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 2.5e-5, quantile: float | None = None):
        """ridge: against the mean loss of a pair. quantile: of the training scores, the part that is rejected; by default the one that best tells the labels apart."""
        self.learn((lambda part: part(x, y)) if len(y) else lambda part: None, ridge, quantile)

    @classmethod
    def of_rows(cls, rows: DataFrame, ridge: float = 2.5e-5, quantile: float | None = None) -> Ranker:
        """From a table (x, label) of any size, by passes over all of it."""
        out = cls.__new__(cls)
        out.learn(total_of(rows), ridge, quantile)
        return out

    def learn(self, total: Total, ridge: float, quantile: float | None) -> None:
        got = total(lambda x, y: (np.array([(y == 0).sum(), (y == 1).sum()]), x.sum(0), (x * x).sum(0)))
        self.counts = [0, 0] if got is None else got[0].tolist()
        self.fitted = all(self.counts)
        if not self.fitted:
            return
        n = sum(self.counts)
        self.mean = got[1] / n
        self.spread = np.sqrt(np.maximum(got[2] / n - self.mean**2, 0)) + 1e-6
        self.weights = np.zeros(2 * N_FEATURES)
        self._fit(total, ridge)
        self._cut(total, quantile)

    def _fit(self, total: Total, ridge: float, rounds: int = 60) -> None:
        """Newton steps on the mean loss over all pairs, halved where the loss would rise."""
        pairs = self.counts[0] * self.counts[1]

        def loss_at(w: np.ndarray) -> tuple[float, Binned, Binned]:
            def part(x: np.ndarray, y: np.ndarray) -> tuple:
                z, kind = self.expand(x), np.stack([y == 0, y == 1], 1).astype(float)
                return Binned(z @ w, self.FINE, kind), Binned(z @ w, self.COARSE, np.hstack([z * kind[:, :1], z * kind[:, 1:], kind]))

            hist, sums = total(part)
            return float(hist.sums[:, 1] @ hist.against(_softplus)[:, 0]) / pairs + ridge * float(w @ w) / 2, hist, sums

        w, k = self.weights, len(self.weights)
        loss, hist, sums = loss_at(w)
        for _ in range(rounds):
            beaten, beating, flows = hist.against(sigmoid)[:, 0], hist.against(lambda t: sigmoid(-t))[:, 1], sums.against(_slope)

            def part(x: np.ndarray, y: np.ndarray, w=w, hist=hist, sums=sums, beaten=beaten, beating=beating, flows=flows[:, -2:]) -> tuple:
                z = self.expand(x)
                s = z @ w
                pull = np.where(y == 1, hist.read(s, beaten), -hist.read(s, beating))
                weight = np.where(y == 1, sums.read(s, flows[:, 0]), sums.read(s, flows[:, 1]))
                return pull @ z, (z * weight[:, None]).T @ z

            pull, own = total(part)
            cross = sums.sums[:, k : 2 * k].T @ flows[:, :k]
            step = np.linalg.solve((own - cross - cross.T) / pairs + ridge * np.eye(k), pull / pairs - ridge * w)
            for _ in range(12):
                new, *grids = loss_at(w + step)
                if new <= loss + 1e-12:
                    break
                step = step / 2
            else:
                break
            w, gain, loss, (hist, sums) = w + step, loss - new, new, grids
            if np.abs(step).max() < 1e-5 or gain < 1e-11:
                break
        self.weights = w

    def _cut(self, total: Total, quantile: float | None) -> None:
        """The threshold and the scale, from ranks among all training rows."""
        weights, n = self.weights, sum(self.counts)

        def below(edges: np.ndarray) -> np.ndarray:
            """How many rows of either label lie below each edge."""

            def part(x: np.ndarray, y: np.ndarray) -> tuple:
                at = np.searchsorted(edges, self.expand(x) @ weights, side="right")
                return (np.stack([np.bincount(at[y == i], minlength=len(edges) + 1) for i in (0, 1)]),)

            return np.cumsum(total(part)[0][:, :-1], 1)

        (found,) = total(lambda x, y: (Binned(self.expand(x) @ weights, self.FINE, np.ones((len(y), 1))),))
        low, high = (found.first - 1) * self.FINE, (found.first + len(found.sums)) * self.FINE
        least = (high - low) * 1e-10

        def split(places: list[tuple[float, float]]) -> np.ndarray:
            each = max(2, self.EDGES // max(1, len(places)))
            return np.unique(np.concatenate([np.linspace(a, b, each + 1) for a, b in places]))

        if quantile is None:  # both kinds weigh the same
            best, count, places = -1.0, 0, [(low, high)]
            while places:
                edges = split(places)
                got = below(edges)
                gain = got[0] / self.counts[0] - got[1] / self.counts[1]
                i = int(gain.argmax())
                if gain[i] > best:
                    best, count = float(gain[i]), int(got[:, i].sum())
                more = np.diff(got, axis=1)
                # between two edges the gain may be greater only if rows of both labels lie there
                open_ = (more > 0).all(0) & (gain[:-1] + more[0] / self.counts[0] > best + 1e-12) & (np.diff(edges) > least)
                begins, ends = (set(e) for e in zip(*places, strict=True))
                places = [(a, b) for a, b in zip(edges[:-1][open_].tolist(), edges[1:][open_].tolist(), strict=True) if a in begins or a not in ends]
            quantile = min(1.0, max(0.0, (count - 0.5) / max(1, n - 1)))
        self.quantile = quantile
        # rows by their rank: those around the quantile, and the middle ones of each label
        at = quantile * (n - 1)
        wanted = [((0, 1), int(np.floor(at))), ((0, 1), int(np.ceil(at)))] + [((i,), r) for i in (0, 1) for r in ((self.counts[i] - 1) // 2, self.counts[i] // 2)]
        places = [(low, high)] * len(wanted)
        while any(b - a > least for a, b in places):
            edges = split(places)
            got = below(edges)
            for k, (kinds, rank) in enumerate(wanted):
                j = int(np.searchsorted(got[list(kinds)].sum(0), rank, side="right"))
                places[k] = (edges[j - 1], edges[j])
        value = [(a + b) / 2 for a, b in places]
        self.threshold = float(value[0] + (at - np.floor(at)) * (value[1] - value[0]))
        self.scale = max(1e-6, (value[4] + value[5] - value[2] - value[3]) / 16)

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([z, z * z / 3])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), AT_THRESHOLD)
        return sigmoid((self.expand(x) @ self.weights - self.threshold) / self.scale + np.log(AT_THRESHOLD / (1 - AT_THRESHOLD)))


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """All columns of docs, then score (0 to 1) and predicted (1 from 0.7 on).

    Learned from all labelled rows that are not held out. Without labelled rows of both
    kinds every score is 0.7, so nothing is rejected. Null text counts as empty;
    empty texts have features 0 and the score of that. Columns of docs named
    score or predicted are replaced. Repeated rows each give a row. No shuffle of docs."""
    ship(docs.sparkSession)
    train = materialize(training_rows(docs, labels, modulus, held_out), "quality")
    ranker = docs.sparkSession.sparkContext.broadcast(Ranker.of_rows(train))
    discard(train)
    docs = docs.select([c for c in docs.columns if c not in ("score", "predicted")])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lone("quality")
        for batch in batches:
            if batch.num_rows:
                s = ranker.value.score(np.array([features(t) for t in text_bytes(batch.column("text"))]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= AT_THRESHOLD).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


QUERIES = {"op7_quality": op7_quality}
SQL: dict[str, str] = {}
