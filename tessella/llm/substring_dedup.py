"""Substring dedup: windows of words that also start in an earlier document.

Texts are dealt once to homes, by a number of the row, and are read there three times; what the
three passes say to each other goes by packed rows. Windows have a 96-bit hash; its high bits name
the part, one of as many as there are shuffle partitions, that a window belongs to.

Pass 1 counts windows in a count-min sketch of about a cell per byte of text, cut into the parts and
held there: nothing of it is broadcast or comes to the driver, whatever its size. A home sends a
part its distinct windows as sorted 32-bit prints, a sparse sketch, of three bytes a window. The
part merges them with counters that stop at 2 and answers with a bit a window: whether all cells
of the print count two or more.

Pass 2 groups the windows estimated repeated exactly, by their hash. A home first resolves what it
holds itself, and sends of each window only the starts in its least doc_id; so a window that a
third of all documents hold is an entry a home. A part answers with the starts that go.

Pass 3 cuts the texts. The three passes are one plan, in which the texts' exchange is reused.

Edge cases: null and empty texts have no words; texts shorter than a window lose nothing; a very
long text is one row of its home; of equal windows the least doc_id keeps all its own (ties); a null
doc_id comes after all others; rows that share a doc_id never remove each other's words, and
repeated rows lose the same and are spread over homes; only doc_id and text are read, so other
columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SECOND_BASE, array_of, documents, hashed_words, home_of_row, homes_for, mix64, ngram_hashes, pack_sorted, partitions, unpack_sorted

WINDOW, DEPTH = 13, 2
_CODEC = pa.Codec("zstd")
_M32 = np.uint64(0xFFFFFFFF)


def _squeezed(raw: bytes) -> bytes:
    return _CODEC.compress(raw, asbytes=True)


def _opened(packed: bytes, size: int) -> bytes:
    return _CODEC.decompress(packed, size, asbytes=True)


def parts_and_prints(w: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The window's part and its 32-bit print there: the whole and the fraction of w * parts / 2^64,
    so that neither falls as w rises."""
    n = np.uint64(parts)
    x = (w >> np.uint64(32)) * n + ((w & _M32) * n >> np.uint64(32))
    return (x >> np.uint64(32)).astype(np.int64), x & _M32


def windows(texts: pa.Array, window: int = WINDOW, second: bool = True) -> tuple[np.ndarray, ...]:
    """(w, v, row, start) of each window of each text: 64 and, if second, 32 more bits of hash."""
    h, n = hashed_words(texts)
    row = np.repeat(np.arange(len(n)), n)
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), row[:0], row[:0]
    inside = np.flatnonzero(row[window - 1 :] == row[: len(row) - window + 1])
    v = (ngram_hashes(h, window, SECOND_BASE)[inside] >> np.uint64(32)).astype(np.uint32) if second else np.zeros(0, np.uint32)
    row = row[inside]
    return ngram_hashes(h, window)[inside], v, row, inside - (np.cumsum(n) - n)[row]


def cells(prints: np.ndarray, width: int) -> list[np.ndarray]:
    """The DEPTH cells of each print in its part's sketch; each depth has `width` of its own."""
    x = mix64(prints + np.uint64(1))
    return [((half * np.uint64(width) >> np.uint64(32)) + np.uint64(d * width)).astype(np.int64) for d, half in enumerate((x & _M32, x >> np.uint64(32)))]


def count(counts: np.ndarray, prints: np.ndarray, twice: np.ndarray) -> None:
    """Adds one home's prints to a part's sketch, whose counters stop at 2."""
    for cell in cells(prints, len(counts) // DEPTH):
        counts[cell] = np.minimum(2, counts[cell] + 1)
        counts[cell[twice]] = 2


def repeated(counts: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether the prints' windows are estimated repeated."""
    return np.logical_and.reduce([counts[cell] > 1 for cell in cells(prints, len(counts) // DEPTH)])


def _sketch(window: int, parts: int):
    """Of a home: its distinct windows, packed by part."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        w, n = np.unique(windows(array_of(table, "text"), window, second=False)[0], return_counts=True)
        part, prints = parts_and_prints(w, parts)
        bounds = np.searchsorted(part, np.arange(parts + 1))
        rows = [(p, int(b - a), pack_sorted(prints[a:b], n[a:b] > 1)) for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
        return _table(key[0].as_py(), rows)

    return run


_PACKED = "part int, home int, n int, blob binary"


def _table(home: int, rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([home] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())]
    return pa.table(columns, names=["part", "home", "n", "blob"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[int, int, bytes]]]:
    """part -> (home, n, blob) of all rows of a task, which has one part or few."""
    held: dict[int, list[tuple[int, int, bytes]]] = {}
    for batch in batches:
        for part, home, n, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            held.setdefault(part, []).append((home, n, blob))
    return held


def _merge(width: int):
    """Of a part: a bit for each window of each home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches).items():
            counts = np.zeros(DEPTH * width, np.uint8)
            for _, n, blob in rows:
                count(counts, *unpack_sorted(blob, n))
            for home, n, blob in rows:
                bits = np.packbits(repeated(counts, unpack_sorted(blob, n)[0])).tobytes()
                yield from _table(home, [(part, n, bits)]).to_batches()

    return run


def _places(doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> list[bytes]:
    return [doc.astype(np.int64).tobytes(), tag.astype(np.int64).tobytes(), np.diff(start, prepend=0).astype(np.int32).tobytes()]


def _read_places(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = np.cumsum(np.frombuffer(raw, np.int32, n, 16 * n), dtype=np.int64)
    return np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n), start


def pack_windows(w: np.ndarray, v: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, n: int) -> bytes:
    """The first n are entries to be compared, the others are known to go and need no hash."""
    places = b"".join(_places(doc[:n], tag[:n], start[:n]) + _places(doc[n:], tag[n:], start[n:]))
    return np.array([n, len(doc) - n], np.int64).tobytes() + w[:n].tobytes() + v[:n].tobytes() + _squeezed(places)


def unpack_windows(blob: bytes) -> tuple[np.ndarray, np.ndarray, tuple, tuple]:
    """(w, v, places of these, places that go)"""
    n, gone = np.frombuffer(blob, np.int64, 2).tolist()
    raw = _opened(blob[16 + 12 * n :], 20 * (n + gone))
    return np.frombuffer(blob, np.uint64, n, 16), np.frombuffer(blob, np.uint32, n, 16 + 8 * n), _read_places(raw[: 20 * n], n), _read_places(raw[20 * n :], gone)


def later(w: np.ndarray, v: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the same window is there with a smaller doc."""
    order = np.argsort(w, kind="stable")
    same = np.diff(w[order]) == 0
    if (same & (np.diff(v[order].astype(np.int64)) != 0)).any():
        order = np.lexsort((v, w))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(w[order]) != 0) | (np.diff(v[order].astype(np.int64)) != 0)
    out = np.zeros(len(order), bool)
    if len(order):
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
        out[order] = doc[order] > least[np.cumsum(new) - 1]
    return out


def _candidates(window: int, parts: int):
    """Of a home, with the parts' answers: the windows estimated repeated, packed by part."""

    def run(key: tuple, table: pa.Table, bits: pa.Table) -> pa.Table:
        w, v, row, start = windows(array_of(table, "text"), window)
        value, back = np.unique(w, return_inverse=True)
        answers = {p: (n, b) for p, n, b in zip(bits.column("part").to_pylist(), bits.column("n").to_pylist(), bits.column("blob").to_pylist(), strict=True)}
        ok = [np.unpackbits(np.frombuffer(answers[p][1], np.uint8), count=answers[p][0]).astype(bool) for p in sorted(answers)]
        ok = np.concatenate([np.zeros(0, bool), *ok])
        left = np.flatnonzero(ok[back])
        w, v, row, start = w[left], v[left], row[left], start[left]
        doc, tag = (array_of(table, c).to_numpy()[row] for c in ("doc", "tag"))
        part, gone = parts_and_prints(w, parts)[0], later(w, v, doc)
        order = np.argsort(part * 2 + gone, kind="stable")
        w, v, doc, tag, start, gone, part = (x[order] for x in (w, v, doc, tag, start, gone, part))
        bounds = np.searchsorted(part, np.arange(parts + 1))
        rows = [(p, int(b - a), pack_windows(w[a:b], v[a:b], doc[a:b], tag[a:b], start[a:b], int(b - a - gone[a:b].sum()))) for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
        return _table(key[0].as_py(), rows)

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part: the places that go, packed by home."""
    for part, rows in _by_part(batches).items():
        blobs = [unpack_windows(blob) for _, _, blob in rows]
        gone = later(*(np.concatenate([b[k] for b in blobs]) for k in range(2)), np.concatenate([b[2][0] for b in blobs]))
        ends = np.cumsum([len(b[0]) for b in blobs]).tolist()
        for (home, _, _), blob, a, b in zip(rows, blobs, [0, *ends], ends, strict=False):
            doc, tag, start = (np.concatenate([x[gone[a:b]], y]) for x, y in zip(blob[2], blob[3], strict=True))
            if len(doc):
                yield from _table(home, [(part, len(doc), _squeezed(b"".join(_places(doc, tag, start))))]).to_batches()


def _cut(window: int, digest: bool):
    """Of a home, with what goes of it: its texts cut."""

    def run(key: tuple, table: pa.Table, gone: pa.Table) -> pa.Table:
        at: dict[tuple[int, int], np.ndarray] = {}
        if gone.num_rows:
            packs = [_read_places(_opened(blob, 20 * n), n) for n, blob in zip(gone.column("n").to_pylist(), gone.column("blob").to_pylist(), strict=True)]
            doc, tag, start = (np.concatenate([p[k] for p in packs]) for k in range(3))
            order = np.lexsort((start, tag, doc))
            doc, tag, start = doc[order], tag[order], start[order]
            head = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(tag) != 0)]))
            ends = [*head[1:].tolist(), len(doc)]
            at = {k: np.unique(start[a:b]) for k, a, b in zip(zip(doc[head].tolist(), tag[head].tolist(), strict=True), head.tolist(), ends, strict=True)}
        out: tuple[list, list, list, list] = ([], [], [], [])
        for doc_id, doc, tag, text in zip(*(table.column(c).to_pylist() for c in ("doc_id", "doc", "tag", "text")), strict=True):
            words = (text or b"").split()
            left = words
            own = at.get((doc, tag))
            if own is not None:
                edge = np.zeros(len(words) + 1, np.int64)
                edge[own] += 1
                edge[own + window] -= 1
                left = [w for w, c in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not c]
            whole = b" ".join(left)
            for to, value in zip(out, (doc_id, len(words), len(words) - len(left), hashlib.sha256(whole).hexdigest() if digest else whole.decode("utf-8")), strict=True):
                to.append(value)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs (doc_id, text): kept is the words
    left, joined by one space, or with digest its SHA-256."""
    parts = max(1, partitions(docs.sparkSession))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.col("text").cast("binary").alias("text"))
    homes, size = homes_for(rows, parts)
    width = max(64, -(-size // (parts * DEPTH)))
    texts = rows.select(home_of_row(homes).alias("home"), "doc_id", "doc", F.xxhash64("text").alias("tag"), "text").repartition(parts, "home")
    at_home = texts.groupBy("home")
    prints = at_home.applyInArrow(_sketch(window, parts), _PACKED)
    bits = prints.repartitionById(parts, "part").mapInArrow(_merge(width), _PACKED)
    sent = at_home.cogroup(bits.groupBy("home")).applyInArrow(_candidates(window, parts), _PACKED)
    gone = sent.repartitionById(parts, "part").mapInArrow(_resolve, _PACKED)
    return at_home.cogroup(gone.groupBy("home")).applyInArrow(_cut(window, digest), "doc_id long, n_words long, n_removed long, kept string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d WHERE len(words) >= 13)
), f AS (
  SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1
), g AS (
  SELECT w.doc_id, list(w.i) AS starts FROM w JOIN f ON w.s = f.s WHERE f.least < w.doc_id GROUP BY w.doc_id
), p AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM (SELECT doc_id, unnest(starts) AS s FROM g)
), q AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), k AS (
  SELECT q.doc_id, string_agg(q.word, ' ' ORDER BY q.i) AS kept, count(*) AS n_kept FROM q ANTI JOIN p ON q.doc_id = p.doc_id AND q.i = p.i GROUP BY q.doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(d.words) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
