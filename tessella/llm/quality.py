"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network,
probabilities calibrated by a temperature.

Tokens are runs of letters, of digits and of other signs, case kept. Every token is hashed to
one of BUCKETS; a bucket has a sparse ternary index vector, made from its number, and its
context vector is the sum of the index vectors of the tokens within WINDOW of its occurrences,
over the whole corpus, as integers, so that reruns and lost executors change nothing. Vectors
are centred and brought to length one. A document's features are mean and deviation of its
tokens' vectors and the mean absolute step between neighbours (small in repetitive text).

The network (features -> HIDDEN tanh -> 1) is fitted with numpy on the driver, on at most
SAMPLE labelled rows, those with the least hash of doc_id; a fifth of them is held back to fit
the temperature that divides the logit. That bound does not depend on the corpus; the
documents' texts and ids do not reach the driver otherwise.

Edge cases: null and empty texts have zero features and are scored like others; labels that
are null or not 0 or 1 are ignored, of repeated ones the least counts; with labels of one kind
only, or none, the score is the share of ones (0.5 without any); repeated rows get equal
scores; a very long text is read with few others at a time; rows equal in all that the sample is
chosen by are equal rows (ties); only doc_id and text are read, so other columns cannot clash, and
``accepted`` carries them; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, batches_of_rows, documents, mix64

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 64, 8, 2
#: Tokens whose neighbours are counted at a time.
HELD = 1_000_000
HIDDEN, SAMPLE, EPOCHS, SEED = 32, 12_000, 40, 7
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Buckets(dict):
    """token -> bucket, remembered; emptied when large."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        b = self[token] = xxhash.xxh3_64_intdigest(token) & BUCKETS - 1
        return b

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all tokens, number of tokens of each text)."""
        found = [TOKEN.findall(t) if t else [] for t in texts]
        n = np.array([len(f) for f in found], np.int64)
        flat = np.fromiter((self[t] for f in found for t in f), np.int64, int(n.sum()))
        return flat, n


def index_vectors() -> np.ndarray:
    """BUCKETS x DIM of -1, 0 and 1, NONZERO draws a row."""
    out = np.zeros((BUCKETS, DIM), np.float32)
    rows = np.arange(BUCKETS, dtype=np.uint64)
    for k in range(NONZERO):
        x = mix64(rows * np.uint64(NONZERO) + np.uint64(k + 1))
        out[rows.astype(np.int64), (x % np.uint64(DIM)).astype(np.int64)] = np.where(x >> np.uint64(63), 1, -1)
    return out


def sparse(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, signs) of the non-zeros of each row, filled up with zeros."""
    at = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO]
    return at, np.take_along_axis(index, at, axis=1)


def neighbours(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one, other, times) of the pairs of buckets within WINDOW in one text, the lower first."""
    doc = np.repeat(np.arange(len(n)), n)
    pairs = [np.zeros(0, np.int64)]
    for step in range(1, WINDOW + 1):
        a, b = flat[:-step], flat[step:]
        pairs.append((np.minimum(a, b) * BUCKETS + np.maximum(a, b))[doc[:-step] == doc[step:]])
    pair, times = np.unique(np.concatenate(pairs), return_counts=True)
    return pair // BUCKETS, pair % BUCKETS, times


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    (at, sign), seen = sparse(index_vectors()), Buckets()
    total, used = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def add() -> None:
        flat, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        np.add(used, np.bincount(flat, minlength=BUCKETS), out=used)
        one, other, times = neighbours(flat, n)
        for to, of in ((one, other), (other, one)):
            for k in range(NONZERO):
                np.add(total, np.bincount(to * DIM + at[of, k], weights=times * sign[of, k], minlength=BUCKETS * DIM), out=total)

    for batch in batches_of_rows(batches, 64):
        held.append(seen.of(batch.column(0).to_pylist()))
        if sum(len(x[0]) for x in held) > HELD:
            add()
    if held:
        add()
    table, rows = total.reshape(BUCKETS, DIM), np.flatnonzero(used)
    for k in range(0, len(rows), 4096):
        part = rows[k : k + 4096]
        columns = [pa.array(part, pa.int32()), pa.array(used[part], pa.int64()), *(pa.array(table[part, d].astype(np.int64), pa.int64()) for d in range(DIM))]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "n", *(f"v{d}" for d in range(DIM))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM unit vectors from the contexts in all of docs (text). The sums are merged
    by bucket on the executors; BUCKETS rows come to the driver."""
    names = [f"v{d}" for d in range(DIM)]
    parts = docs.select("text").mapInArrow(_contexts, "bucket int, n long, " + ", ".join(f"{v} long" for v in names))
    table = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(v).alias(v) for v in names)).toArrow()
    out = np.zeros((BUCKETS, DIM))
    if table.num_rows:
        out[table.column("bucket").to_numpy()] = np.stack([table.column(v).to_numpy() for v in names], axis=1)
        n = np.zeros(BUCKETS)
        n[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
        out -= n[:, None] * (out.sum(axis=0) / n.sum())  # what any context has
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0).astype(np.float32)


def pooled(flat: np.ndarray, n: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """len(n) x 3 DIM features."""
    out = np.zeros((len(n), 3 * DIM), np.float32)
    ends = np.cumsum(n).tolist()
    for row, a, b in zip(out, [0, *ends], ends, strict=False):
        if b > a:
            own = vectors[flat[a:b]]
            mean = np.add.reduce(own, axis=0) / (b - a)
            row[:DIM] = mean
            row[DIM : 2 * DIM] = np.sqrt(np.maximum(np.einsum("ij,ij->j", own, own) / (b - a) - mean * mean, 0))
            row[2 * DIM :] = np.add.reduce(np.abs(own[1:] - own[:-1]), axis=0) / max(b - a - 1, 1)
    return out


class Network:
    """features -> tanh -> logit / temperature."""

    def __init__(self, share: float):
        self.share, self.w1 = share, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(x))
        held, fit = order[: len(x) // 5], order[len(x) // 5 :]
        if len({*y[fit].tolist()}) < 2:
            return self
        self.shift, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-4
        z = (x - self.shift) / self.scale
        p = {"w1": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1)}
        m = {k: np.zeros_like(v) for k, v in p.items()}
        v = {k: np.zeros_like(w) for k, w in p.items()}
        t = 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                a = np.tanh(z[rows] @ p["w1"] + p["b1"])
                gap = (1 / (1 + np.exp(-(a @ p["w2"] + p["b2"]))) - y[rows]) / len(rows)
                back = np.outer(gap, p["w2"]) * (1 - a * a)
                g = {"w1": z[rows].T @ back + 1e-4 * p["w1"], "b1": back.sum(axis=0), "w2": a.T @ gap + 1e-4 * p["w2"], "b2": np.array([gap.sum()])}
                t += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = p["w1"], p["b1"], p["w2"], float(p["b2"][0])
        self.temperature = 1.0
        if len(held):
            logit = self.logit(x[held])
            grid = np.exp(np.linspace(np.log(0.5), np.log(8), 81))
            loss = [np.mean(np.logaddexp(0, logit / g) - y[held] * logit / g) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


def _features(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Buckets()
        for batch in batches_of_rows(batches, 64):
            x = pooled(*seen.of(batch.column(2).to_pylist()), vectors.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    return run


def remainder3(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


class QualityModel:
    """Word vectors and network, small enough to be broadcast."""

    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
        """docs (doc_id, text) all count for the vectors; of labels (doc_id, quality) those
        outside the held-out third are learned from, at most `sample`."""
        spark = docs.sparkSession
        vectors = word_vectors(docs)
        known = labels.where(F.col("quality").isin(0, 1) & (remainder3(F.col("doc_id")) != 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
        chosen = Stash(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled").df  # at most `sample` rows, so it may be broadcast
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
        rows = texts.mapInArrow(_features(spark.sparkContext.broadcast(vectors)), "doc_id long, quality int, x binary").toArrow()
        x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, 3 * DIM)
        y = rows.column("quality").to_numpy().astype(float)
        order = np.lexsort((*x[:, :2].T, rows.column("doc_id").to_numpy()))
        return cls(vectors, Network(float(y.mean()) if len(y) else 0.5).fit(x[order].astype(float), y[order]))

    def scores(self, seen: Buckets, texts: list[str | None]) -> np.ndarray:
        return self.network.probability(pooled(*seen.of(texts), self.vectors))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Buckets()
        for batch in batches_of_rows(batches, 64):
            p = model.value.scores(seen, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(QualityModel.fit(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(remainder3(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def _keep(model, at: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Buckets()
        for batch in batches_of_rows(batches, 64):
            yield batch.filter(pa.array(model.value.scores(seen, batch.column(at).to_pylist()) >= least))

    return run


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all columns, whose score is `least` or more."""
    model = docs.sparkSession.sparkContext.broadcast(QualityModel.fit(docs.select("doc_id", "text"), labels))
    return docs.mapInArrow(_keep(model, docs.columns.index("text"), least), docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
