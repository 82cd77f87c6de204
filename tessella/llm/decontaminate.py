"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A segment is any run of LENGTH characters of a benchmark item that starts at a multiple of STRIDE
or ends the item; a shorter item is one segment. A text leaks the item if some region of it is
within e = floor(RATE * L) edits of a segment of length L. By the q-gram lemma the region then
shares at least L + 1 - Q (e + 1) q-grams with the segment, on diagonals that differ by e at most,
so in one of the overlapping diagonal bands of width 2 e that start every e diagonals. Bands of
an item in which a segment shares so many are retained, and aligned with it, in the band only.

To find the bands only some of an item's q-grams are looked up: those most common among the items
are left out, as many as no segment misses (of N q-grams of which a match keeps `least`, any
N - least + need hold `need`). The bands that hold `need` of the rest are then counted in full.

So a leak of LENGTH + STRIDE - 1 characters of an item, 51, with at most RATE edits is found, as is
any shorter item in full; the shortest run of 13 words in the given benchmark has 51 characters.

The items are the query set and the texts are scanned once: items go to the workers in blocks of at
most BLOCK_BYTES; a worker holds one block at a time, and takes them in turn for each GROUP_BYTES
of texts. Texts are compared lower-cased, each run of blanks as one space, character by character.

Edge cases: null and empty texts match nothing; items of fewer than Q characters, or null, are not
looked for; very long texts are compared in full; of an item's segments the one that shares most
q-grams is reported, then the one that starts first (ties); repeated rows and items give a row
each; rows without an id are matched too; only doc_id, text and item_id are read, so other columns
cannot clash, and ``clean`` carries them; an empty benchmark matches nothing and an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of_bytes, documents

Q, LENGTH, STRIDE, RATE = 8, 48, 4, 0.08
BLOCK_BYTES, GROUP_BYTES, TABLE_BITS = 4 << 20, 32 << 20, 22


def normal(text: bytes | str | None) -> str:
    if isinstance(text, bytes):
        text = text.decode("utf-8", "replace")
    return " ".join((text or "").lower().split())


def characters(text: str) -> np.ndarray:
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def qgrams(own: np.ndarray) -> np.ndarray:
    """Every run of Q = 8 characters as an integer, character k weighing 256^k modulo 2^64."""
    n = len(own) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if own.dtype == np.uint8:
        out, raw = np.empty(n, np.uint64), own.tobytes()
        for k in range(min(Q, n)):
            out[k::8] = np.frombuffer(raw, "<u8", (len(raw) - k) // 8, k)
        return out
    wide = own.astype(np.uint64)
    out = wide[Q - 1 :].copy()
    for k in range(Q - 2, -1, -1):
        out <<= np.uint64(8)
        out += wide[k : k + n]
    return out


def budget(length: int) -> tuple[int, int]:
    """(edits allowed, q-grams shared at least); fewer edits where the lemma needs it."""
    e = int(RATE * length)
    while e and length + 1 - Q * (e + 1) < 1:
        e -= 1
    return e, max(1, length + 1 - Q * (e + 1))


def banded_edits(pattern: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best match of the whole pattern ending anywhere in text, on the
    diagonals low..high (text position - pattern position); None beyond `most` edits."""
    width = high - low + 1
    steps = np.arange(width)
    big = most + 1 + width
    # cell d of row i: text position i + low + d characters consumed
    at = low + steps
    row = np.where((at >= 0) & (at <= len(text)), 0, big)
    for i, ch in enumerate(pattern.tolist()):
        at = i + low + steps  # the text's character matched by a diagonal step
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == ch
        new = np.where(inside, row + ~same, big)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # the pattern's character left out
        end = i + 1 + low + steps
        new = np.where((end >= 0) & (end <= len(text)), new, big)
        row = np.minimum.accumulate(new - steps) + steps  # the text's characters left out
        row = np.where((end >= 0) & (end <= len(text)), row, big)
        if row.min() > most:
            return None
    best = int(row.argmin())
    return int(row[best]), len(pattern) + low + best


class Item:
    """A normalised item: its characters, q-grams and segments."""

    def __init__(self, item_id: int | None, text: str):
        self.id, self.text, self.own = item_id, text, characters(text)
        self.gram = qgrams(self.own)
        self.length = min(LENGTH, len(text))
        self.edits, self.least = budget(self.length)
        self.need = max(1, self.least // 3)
        self.step = max(1, self.edits)
        self.grams = self.length - Q + 1  # of a segment
        last = len(text) - self.length
        self.starts = np.unique([*range(0, last, STRIDE), last])

    def looked_up(self, often: np.ndarray) -> np.ndarray:
        """Which q-grams to look up: all but the most common, as long as every run of a segment's
        q-grams keeps all but `least` - `need`."""
        out, room = np.ones(len(self.gram), bool), np.full(len(self.gram), self.least - self.need)
        for at in np.argsort(-often, kind="stable").tolist():
            runs = room[max(0, at - self.grams + 1) : at + 1]
            if runs.min() > 0:
                runs -= 1
                out[at] = False
        return out


class ItemIndex:
    """The q-grams of a block of items (item_id, text)."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        made = (Item(i, normal(raw)) for i, raw in items)
        self.items = [x for x in made if len(x.gram)]
        gram = np.concatenate([np.zeros(0, np.uint64), *(x.gram for x in self.items)])
        item = np.repeat(np.arange(len(self.items)), [len(x.gram) for x in self.items])
        pos = np.concatenate([np.zeros(0, int), *(np.arange(len(x.gram)) for x in self.items)])
        _, back, often = np.unique(gram, return_inverse=True, return_counts=True)
        often, ends = often[back], np.cumsum([0, *(len(x.gram) for x in self.items)])
        kept = np.concatenate([np.zeros(0, bool), *(x.looked_up(often[a:b]) for x, a, b in zip(self.items, ends, ends[1:], strict=False))])
        order = np.flatnonzero(kept)[np.argsort(gram[kept], kind="stable")]
        self.gram, self.first, self.times = np.unique(gram[order], return_index=True, return_counts=True)
        self.item, self.pos = item[order].astype(np.int32), pos[order].astype(np.int32)
        self.step, self.need, self.grams = (np.array([getattr(x, k) for x in self.items], int) for k in ("step", "need", "grams"))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.slot(self.gram)] = True

    @staticmethod
    def slot(g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def likely(self, g: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) in which a segment shares `need` of the q-grams looked up."""
        p = np.flatnonzero(self.table[self.slot(g)])
        at = np.minimum(np.searchsorted(self.gram, g[p]), len(self.gram) - 1)
        hit = self.gram[at] == g[p]
        p, at = p[hit], at[hit]
        times = self.times[at]
        post = np.repeat(self.first[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        item, pos = self.item[post].astype(np.int64), self.pos[post].astype(np.int64)
        enough = (np.bincount(item, minlength=len(self.items)) >= self.need)[item]
        item, pos, p = item[enough], pos[enough], np.repeat(p, times)[enough]
        if not len(item):
            return []
        band = (p - pos) // self.step[item]
        item, pos = np.concatenate([item, item]), np.concatenate([pos, pos])
        band = np.concatenate([band, band - 1])
        order = np.lexsort((pos, band, item))
        item, pos, band = item[order], pos[order], band[order]
        new = np.ones(len(item), bool)
        new[1:] = (np.diff(item) != 0) | (np.diff(band) != 0) | (np.diff(pos) != 0)
        item, pos, band = item[new], pos[new], band[new]
        ahead = np.arange(len(item)) + self.need[item] - 1
        to = np.minimum(ahead, len(item) - 1)
        full = (ahead < len(item)) & (item[to] == item) & (band[to] == band) & (pos[to] - pos < self.grams[item])
        return sorted({*zip(item[full].tolist(), band[full].tolist(), strict=True)})

    def retained(self, k: int, band: int, g: np.ndarray) -> list[tuple[int, int]]:
        """(q-grams shared in the band, start) of the item's segments that meet the lemma's bound."""
        x = self.items[k]
        low, high = band * x.step, band * x.step + 2 * x.step - 1
        a = max(0, low)
        near = g[a : max(a, high + len(x.gram))]
        order = np.argsort(x.gram, kind="stable")
        left, right = (np.searchsorted(x.gram[order], near, side=s) for s in ("left", "right"))
        times = right - left
        pos = order[np.repeat(left - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        diagonal = np.repeat(np.arange(a, a + len(near)), times) - pos
        pos = np.unique(pos[(diagonal >= low) & (diagonal <= high)])
        shared = np.searchsorted(pos, x.starts + x.grams) - np.searchsorted(pos, x.starts)
        return [(int(n), int(s)) for n, s in zip(shared, x.starts, strict=True) if n >= x.least]

    def matches(self, raw: bytes | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, start in the item, end in the normalised text, edits) of each item found."""
        text = normal(raw)
        own = characters(text)
        g = qgrams(own)
        if not len(g) or not len(self.gram):
            return []
        regions: dict[int, list[tuple[int, int, int]]] = {}
        for k, band in self.likely(g):
            regions.setdefault(k, []).extend((-n, s, band) for n, s in self.retained(k, band, g))
        out = []
        for k, found in regions.items():
            x = self.items[k]
            for _, s, band in sorted(found):
                low, high = band * x.step + s - x.edits, band * x.step + 2 * x.step - 1 + s + x.edits
                part = x.text[s : s + x.length]
                at = text.find(part, max(0, low), max(0, high + x.length))
                end = (0, at + x.length) if at >= 0 else banded_edits(x.own[s : s + x.length], own, low, high, x.edits)
                if end:
                    out.append((x.id, s, end[1], end[0]))
                    break
        return out


def blocks(items: DataFrame) -> list:
    """The benchmark (item_id, text) as broadcast indexes of about BLOCK_BYTES of items each."""
    spark = items.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n, out = max(1, math.ceil(size / BLOCK_BYTES)), []
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        found = sorted(((r[0], bytes(r[1] or b"")) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        out.append(spark.sparkContext.broadcast(ItemIndex(found)))
    return out


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches together as long as their texts have fewer than GROUP_BYTES."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches_of_bytes(batches, column):
        held.append(batch)
        size += batch.column(column).nbytes
        if size > GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _found(indexes: list, texts: list[list]) -> list[list[list[tuple]]]:
    """The matches of each text of each batch, one index in memory at a time."""
    out: list[list[list[tuple]]] = [[[] for _ in batch] for batch in texts]
    for index in indexes:
        own = index.value
        for batch, to in zip(texts, out, strict=True):
            for text, found in zip(batch, to, strict=True):
                found += own.matches(text)
        if len(indexes) > 1:
            index.__dict__.pop("_value", None)  # it is read again from the worker's file
    return out


def _find(indexes: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            for batch, found in zip(group, _found(indexes, [b.column(1).to_pylist() for b in group]), strict=True):
                out = [(doc_id, *m) for doc_id, own in zip(batch.column(0).to_pylist(), found, strict=True) for m in own]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names=["doc_id", "item_id", "item_start", "text_end", "edits"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_start, text_end, edits): for each row of docs and each item it
    leaks a segment it holds; positions are in the normalised texts."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(_find(blocks(benchmark)), "doc_id long, item_id long, item_start long, text_end long, edits long")


def _clean(indexes: list, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, at):
            for batch, found in zip(group, _found(indexes, [b.column(at).to_pylist() for b in group]), strict=True):
                yield batch.filter(pa.array([not own for own in found], pa.bool_()))

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item, with all their columns."""
    return docs.mapInArrow(_clean(blocks(benchmark), docs.columns.index("text")), docs.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
