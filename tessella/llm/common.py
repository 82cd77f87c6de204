"""What the corpus operators share: written tables, word and shingle hashes, an id filter."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import shared_folder

#: Characters that separate words, and those stripped from lines: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CODEC = pa.Codec("zstd")
#: Where texts are dealt to homes by row: so many homes a shuffle partition, of so many bytes at least
#: as long as there is one a partition.
HOMES, HOME_BYTES = 8, 1 << 20


class Stash:
    """A DataFrame written to the shared folder and read again: lineage ends here, so a lost
    executor costs no recomputation of what came before."""

    #: Those written and not dropped.
    live: ClassVar[set[Stash]] = set()

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        Stash.live.add(self)
        DriverHeap.check(self.spark)

    def drop(self) -> None:
        """Deletes the files; call it once nothing reads them any more."""
        Stash.live.discard(self)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Asks for a collection of what nothing refers to any more, upon which Spark's cleaner deletes
    the shuffle files of finished jobs; it changes nothing else."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class DriverHeap:
    """Between the many small jobs of one operator the driver's JVM rather takes more memory than it
    collects plans, task states and broadcasts that are done with. So where its heap has grown by a
    SHARE-th of its limit since it was last seen at its least, a collection gives that back."""

    SHARE = 16
    #: The least heap seen since the last collection, and the application it belongs to.
    least: ClassVar[tuple[str, int]] = ("", 0)

    @classmethod
    def check(cls, spark: SparkSession) -> None:
        app, heap = spark.sparkContext.applicationId, spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
        now = heap.totalMemory()
        seen = cls.least[1] if cls.least[0] == app else now
        if now - seen > heap.maxMemory() // cls.SHARE:
            tidy(spark)
            seen = heap.totalMemory()
        cls.least = (app, min(seen, now))


def stash(df: DataFrame, name: str) -> DataFrame:
    return Stash(df, name).df


def settled(make: Callable[[], DataFrame], name: str) -> Stash:
    """What make returns, written; the tables that were written on the way to it are dropped."""
    before = set(Stash.live)
    out = Stash(make(), name)
    for used in Stash.live - before - {out}:
        used.drop()
    return out


class Scratch:
    """Written tables that are dropped together."""

    def __init__(self):
        self.held: list[Stash] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(Stash(df, name))
        return self.held[-1].df

    def drop(self) -> None:
        for s in self.held:
            s.drop()
        self.held = []


#: Hot keys are broadcast up to this many.
BROADCAST_KEYS = 100_000


class HotKeys:
    """The keys with more than `most` rows: at most rows / most of them, broadcast if they are
    BROADCAST_KEYS at most; else joins are left to adaptive splitting."""

    def __init__(self, rows: DataFrame, key: str, most: int, scratch: Scratch):
        self.key = key
        self.keys = scratch(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "hot-keys")
        self.few = self.keys.count() <= BROADCAST_KEYS

    def join(self, left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
        """left with right, which has one row a key: rows of hot keys find theirs in a broadcast
        and are not dealt by the key."""
        if not self.few:
            return left.join(right, self.key, how)
        mark = F.broadcast(self.keys.select(self.key, F.lit(True).alias("is_hot")))
        marked = left.join(mark, self.key, "left")
        hot = marked.where("is_hot").drop("is_hot").join(F.broadcast(right.join(mark, self.key, "left_semi")), self.key, how)
        return marked.where("is_hot is null").drop("is_hot").join(right, self.key, how).unionByName(hot)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else left."""
    return F.translate(c, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The base of a hash that is independent of the first.
SECOND_BASE = int(_ODD[1])


_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are hashed by array steps of 8; a longer word is hashed alone.
LONG_WORD = 256


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, number of words of each text) of an Arrow binary or string
    array, optionally with A-Z lower-cased. A text is read as bytes, without an object a word."""
    kind = np.int64 if pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type) else np.int32
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    first, last = int(ends[0]), int(ends[-1])
    ends = ends - first
    size = last - first
    raw = np.zeros(size + 8, np.uint8)  # so that 8 bytes can be read from every place
    if size:
        own = np.frombuffer(data, np.uint8, size, first)
        raw[:size] = _LOWER[own] if lower else own
    solid = np.zeros(size + 1, bool)
    np.logical_not(_BLANK[raw[:size]], out=solid[:size])
    opens = solid[:size].copy()
    opens[1:] &= ~solid[: max(0, size - 1)]
    at = ends[:-1]
    at = at[at < size]
    opens[at] = solid[at]  # a text starts anew
    start = np.flatnonzero(opens)
    closes = np.ones(size, bool)
    closes &= solid[:size]
    closes[:-1] &= ~solid[1:size] | opens[1:]
    length = np.flatnonzero(closes) + 1 - start
    n = np.diff(np.searchsorted(start, ends))
    eight = np.ndarray((size + 1,), "<u8", raw.data, strides=(1,))
    h = mix64((eight[start] & _FIRST_BYTES[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * _ODD[0]))
    left, done = np.flatnonzero(length > 8), 8
    for k in left[length[left] > LONG_WORD].tolist():
        h[k] = xxhash.xxh3_64_intdigest(raw[start[k] : start[k] + length[k]].tobytes())
    left = left[length[left] <= LONG_WORD]
    while len(left):
        part = eight[start[left] + done] & _FIRST_BYTES[np.minimum(length[left] - done, 8)]
        h[left] = mix64(h[left] * _ODD[1] + part)
        done += 8
        left = left[length[left] > done]
    return h, n


def ngram_hashes(h: np.ndarray, n: int, base: int = int(_ODD[0])) -> np.ndarray:
    """Hash of each run of n consecutive values of h; fewer than n: none. The polynomial's
    base is odd, so order counts."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(base)
        out += h[k : k + len(out)]
    return mix64(out)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingle hashes; with fewer words the whole sequence as one."""
    if not len(h):
        return h
    return np.unique(ngram_hashes(h, min(n, len(h))))


def pack_sorted(values: np.ndarray, flag: np.ndarray | int = 0) -> bytes:
    """Rising values below 2^46 as gaps, with a bit each, byte by byte of all, so that what is
    small in all of them costs nothing."""
    gaps = np.diff(values.astype(np.int64), prepend=0) * 2 + flag
    return _CODEC.compress(np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes(), asbytes=True)


def unpack_sorted(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, bits) of n values."""
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :6] = np.frombuffer(_CODEC.decompress(packed, 6 * n, asbytes=True), np.uint8).reshape(6, n).T
    gaps = planes.reshape(-1).view("<u8")
    return np.cumsum(gaps >> np.uint64(1)), (gaps & np.uint64(1)).astype(bool)


def array_of(table: pa.Table, name: str) -> pa.Array:
    """A column of a table as one array."""
    whole = table.column(name).combine_chunks()
    return whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole


def homes_for(texts: DataFrame, parts: int) -> tuple[int, int]:
    """(homes, bytes) for the column text of `texts`."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(parts, min(HOMES * parts, size // HOME_BYTES)), size


def home_of_row(homes: int) -> Column:
    """A number below `homes` for each row, the same however often the plan is run over the same
    files; identical rows have different ones."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(homes)).cast("int")


def batches_of_rows(batches: Iterator, rows: int) -> Iterator:
    """Arrow record batches cut to at most so many rows, so that memory follows one slice."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def batches_of_bytes(batches: Iterable, column: int, size: int = 4 << 20) -> Iterator:
    """Arrow record batches cut so that the binary column holds about `size` bytes a slice, or one
    row that has more."""
    for b in batches:
        texts = b.column(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        k = 0
        while k < b.num_rows:
            done = int(ends[k - 1]) if k else 0
            to = max(k + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield b.slice(k, to - k)
            k = to


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, nulls as text; the same in every engine."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


class IdFilter:
    """A Bloom filter of longs, at most MAX_BITS, so that it may be broadcast whatever their
    number: with very many ids it lets more through."""

    BLOCKS, PROBES, PER_ID, MAX_BITS = 64, 4, 16, 1 << 27

    def __init__(self, bits: np.ndarray, block_bits: int, tight: bool):
        #: tight: there are PER_ID bits or more per id
        self.bits, self.block_bits, self.tight = bits, block_bits, tight

    @staticmethod
    def _block(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(58)).astype(np.int64)

    @classmethod
    def _positions(cls, h: np.ndarray, block_bits: int) -> Iterator[np.ndarray]:
        low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(26)) | np.uint64(1)
        for k in range(cls.PROBES):
            yield ((low + np.uint64(k) * high) % np.uint64(block_bits)).astype(np.int64)

    @classmethod
    def build(cls, ids: DataFrame) -> IdFilter:
        """From a DataFrame with one column of longs. Each block is filled by one task."""
        n = ids.count()
        bits = min(cls.MAX_BITS, 1 << max(13, (n * cls.PER_ID).bit_length()))
        block_bits = bits // cls.BLOCKS

        def deal(batches: Iterator) -> Iterator:
            for b in batches:
                x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cls._block(mix64(x.view(np.uint64))).astype(np.int32)), pa.array(x)], names=["block", "id"])

        def fill(batches: Iterator) -> Iterator:
            full: dict[int, np.ndarray] = {}
            for b in batches:
                h = mix64(b.column(1).to_numpy().astype(np.int64).view(np.uint64))
                block = cls._block(h)
                for k in np.unique(block):
                    own = full.setdefault(int(k), np.zeros(block_bits, bool))
                    for at in cls._positions(h[block == k], block_bits):
                        own[at] = True
            for k, own in full.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["block", "bits"])

        filled = ids.where(F.col(ids.columns[0]).isNotNull()).mapInArrow(deal, "block int, id long").repartition("block").mapInArrow(fill, "block int, bits binary")
        out, size = np.zeros(bits // 8, np.uint8), block_bits // 8
        for row in filled.toLocalIterator():  # BLOCKS rows
            out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(bytes(row["bits"]), np.uint8)
        return cls(out, block_bits, n * cls.PER_ID <= bits)

    def maybe(self, ids: np.ndarray) -> np.ndarray:
        """False only for ids that were not put in."""
        h = mix64(ids.astype(np.int64).view(np.uint64))
        base, ok = self._block(h) * self.block_bits, np.ones(len(h), bool)
        for at in self._positions(h, self.block_bits):
            at = base + at
            ok &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return ok
