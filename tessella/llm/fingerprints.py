"""Document fingerprints by consistent weighted sampling.

The weighted terms of a text are its word pairs (single words if it has one word), weighted
by their number. For each of K samples, Gamma(2,1) variates r and c and a uniform b that
belong to (term, sample) alone give, for weight w, t = floor(ln w / r + b) and
ln a = ln c + r b - r - r t; the term with the least a is drawn. Two texts draw the same
(term, t) with a probability equal to the generalised Jaccard similarity of their weights.
As ln a is a function of (term, t), the least value itself stands for the draw.

Terms are 64-bit hashes, and r, c and b come from a mix of (term, sample), so that two texts
share no term by chance however long they are; terms are taken in blocks, so memory is bounded.
What was computed for the terms of a document and of the one after it serves the edit too.

Edge cases: a null text is empty; a text without words has a fingerprint of zeros, alike (1)
to another such and unlike (0) to any other; a very long text is sampled whole, block by block;
rows with the same doc_id are ordered by text (ties), repeated rows follow one another; null ids
come first; the only row of a table is its own next document; only doc_id and text are read, so
other columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stash, batches_of_bytes, documents, hashed_words, mix64, ngram_hashes, partitions

SAMPLES = 128
#: Terms for which variates are made at a time (few enough for a processor's cache), and up to which a text's are kept.
BLOCK, KEPT = 128, 1 << 14
#: Bytes of text whose documents' terms are kept at a time.
ROWS_BYTES = 1 << 18

#: Sorted terms and their ln a at t = 0.
Known = tuple[np.ndarray, np.ndarray]


_LN_UNIT = np.float32(48 * np.log(2))


class _Room:
    """Arrays for the variates of BLOCK terms, so that none is allocated in the loop."""

    def __init__(self, samples: int):
        self.mask = mix64(np.arange(1, samples + 1, dtype=np.uint64) << np.uint64(40))
        self.x, self.y, self.z = (np.empty((BLOCK, samples), np.uint64) for _ in range(3))
        self.u = np.empty((BLOCK, 2 * samples), np.float32)
        self.base, self.r, self.b = (np.empty((BLOCK, samples), np.float32) for _ in range(3))


@cache
def _room(samples: int) -> _Room:
    return _Room(samples)


def _gamma(bits: np.ndarray, u: np.ndarray, out: np.ndarray) -> None:
    """Gamma(2,1): minus the logarithm of two uniforms of 24 bits, from the halves of 64."""
    half = bits.view(np.uint32)
    np.right_shift(half, np.uint32(8), out=half)
    np.bitwise_or(half, np.uint32(1), out=half)  # never 0
    u[...] = half.view(np.int32)
    np.multiply(u[:, 0::2], u[:, 1::2], out=out)
    np.log(out, out=out)
    np.subtract(_LN_UNIT, out, out=out)


def variates(term: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ln a at t = 0, r, b) of at most BLOCK terms, each len(term) x samples; valid until the next
    call."""
    room, n = _room(samples), len(term)
    x, y, z, base, r, b, u = (getattr(room, k)[:n] for k in ("x", "y", "z", "base", "r", "b", "u"))
    np.bitwise_xor(term[:, None], room.mask, out=x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(x, np.uint64(shift), out=z)
        np.bitwise_xor(x, z, out=x)
        np.multiply(x, np.uint64(factor), out=x)
    np.right_shift(x, np.uint64(31), out=z)
    np.bitwise_xor(x, z, out=x)
    np.multiply(x, np.uint64(0x165667B19E3779F9), out=z)
    b[...] = (z.view(np.uint32)[:, 1::2] >> np.uint32(8)).view(np.int32)
    np.add(b, np.float32(0.5), out=b)
    np.multiply(b, np.float32(2.0**-24), out=b)
    np.multiply(x, np.uint64(0xD6E8FEB86659FD93), out=y)
    np.right_shift(y, np.uint64(32), out=z)
    np.bitwise_xor(y, z, out=y)
    np.multiply(y, np.uint64(0xC2B2AE3D27D4EB4F), out=y)
    _gamma(x, u, r)
    _gamma(y, u, base)
    np.log(base, out=base)
    base += r * (b - np.float32(1))
    return base, r, b


def bases(term: np.ndarray, samples: int, known: tuple[Known, ...]) -> np.ndarray:
    """ln a at t = 0 of sorted terms, from those known where they hold them."""
    out = np.empty((len(term), samples), np.float32)
    lacking = np.ones(len(term), bool)
    for terms, values in known:
        at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
        hit = lacking & (terms[at] == term)
        out[hit] = values[at[hit]]
        lacking &= ~hit
    left = np.flatnonzero(lacking)
    for k in range(0, len(left), BLOCK):
        out[left[k : k + BLOCK]] = variates(term[left[k : k + BLOCK]], samples)[0]
    return out


def drawn(hashes: np.ndarray, samples: int = SAMPLES, known: tuple[Known, ...] = ()) -> tuple[np.ndarray | None, tuple[Known, ...]]:
    """The samples' least ln a for the words' hashes, None without words; and what is worth
    knowing of the terms."""
    if not len(hashes):
        return None, ()
    term, weight = np.unique(ngram_hashes(hashes, min(2, len(hashes))), return_counts=True)
    least = np.full(samples, np.inf, np.float32)
    kept: tuple[Known, ...] = ()
    for k in range(0, len(term), KEPT):
        some, times = term[k : k + KEPT], weight[k : k + KEPT]
        once = times == 1
        if once.any():
            single = some[once]
            value = bases(single, samples, known)
            np.minimum(least, value.min(axis=0), out=least)
            if len(term) <= KEPT:
                kept = ((single, value),)
        many = np.flatnonzero(~once)
        for j in range(0, len(many), BLOCK):
            at = many[j : j + BLOCK]
            base, r, b = variates(some[at], samples)
            step = np.floor(np.log(times[at].astype(np.float32))[:, None] / r + b)
            np.minimum(least, (base - r * step).min(axis=0), out=least)
    return least, kept


def signature(hashes: np.ndarray, samples: int = SAMPLES) -> np.ndarray | None:
    return drawn(hashes, samples)[0]


def as_text(sig: np.ndarray | None, samples: int = SAMPLES) -> str:
    """Four hexadecimal digits a sample, of a hash of the value."""
    if sig is None:
        return "0" * 4 * samples
    return (mix64(sig.view(np.uint32).astype(np.uint64)) >> np.uint64(48)).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return float(np.count_nonzero(a == b)) / len(a)


def edited(text: str, after: str) -> str:
    """text with its last half replaced by the first as many code points of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _hashes(texts: list[str]) -> list[np.ndarray]:
    """The words' hashes of each text."""
    h, n = hashed_words(pa.array(texts, pa.large_string()))
    ends = np.cumsum(n).tolist()
    return [h[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted within buckets: each document with the one after it; a bucket's last row
    (head) is the first document of the next bucket and only looked at."""
    held = None
    for batch in batches_of_bytes(batches, 3, ROWS_BYTES):
        bucket, head, doc_id, text = (batch.column(k).to_pylist() for k in range(4))
        rows = [(k, i, t, *drawn(h)) for k, i, t, h in zip(bucket, doc_id, text, _hashes(text), strict=True)]
        pairs = []
        for row, is_head in zip(rows, head, strict=True):
            if held is not None and held[0] == row[0]:
                pairs.append((held, row, edited(held[2], row[2])))
            held = None if is_head else row
        out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        for (before, after, changed), h in zip(pairs, _hashes([p[2] for p in pairs]), strict=True):
            _, before_id, own, sig, known = before
            new = drawn(h, known=known + after[4])[0]
            values = (before_id, len(own), hashlib.sha256(changed.encode("utf-8")).hexdigest(), as_text(sig), as_text(new), likeness(sig, new), likeness(sig, after[3]))
            for to, value in zip(out.values(), values, strict=True):
                to.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["n_chars"], pa.int64()), *(pa.array(out[k], pa.string()) for k in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(pa.array(out[k], pa.float64()) for k in ("near_edited", "near_next"))], names=list(out))


def _dealt(cuts):
    """doc_id, ... with its bucket: the number of cuts up to the id; null ids are in the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            bucket = np.searchsorted(cuts.value, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket, pa.int32())], names=[*batch.schema.names, "bucket"])

    return run


def with_neighbour(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of docs (doc_id, text) and of its edit by the next document.

    Rows are dealt to buckets, one a task, by ranges of doc_id (approximate quantiles, one number
    a bucket, searched in order), and each bucket gets a copy of the first row of the next one, so
    that one sort within partitions puts every document before its neighbour without a global window.
    """
    spark = docs.sparkSession
    n = max(1, partitions(spark))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    asked = [k / n for k in range(1, n)] or [0.5]
    found = rows.agg(F.percentile_approx("doc_id", asked, max(10_000, 10 * n))).first()[0] if n > 1 else None
    cuts = spark.sparkContext.broadcast(np.unique(np.array(found or [], np.int64)))
    ids = rows.select("doc_id").mapInArrow(_dealt(cuts), "doc_id long, bucket int")
    first = ids.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id"))["doc_id"].alias("first_id"))
    # at most n rows, so they may be ordered in one task and broadcast; the last bucket's next is the first
    last = F.max("bucket").over(Window.partitionBy())
    first = Stash(first.withColumn("before", F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), last)), "bucket-heads").df
    heads = rows.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("before").agg(F.min(F.struct("text", "doc_id")).alias("f"))
    heads = heads.select("f.doc_id", "f.text", F.col("before").alias("bucket"), F.lit(1).alias("head"))
    both = rows.mapInArrow(_dealt(cuts), "doc_id long, text string, bucket int").withColumn("head", F.lit(0)).unionByName(heads)
    laid = both.select("bucket", "head", "doc_id", "text").repartitionById(n, "bucket").sortWithinPartitions("bucket", "head", F.col("doc_id").asc_nulls_first(), "text")
    return laid.mapInArrow(_in_order, SCHEMA)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbour(documents(spark, sf_dir))
