"""Line dedup over levelled sorted runs of line hashes.

The index is a list of runs, tables of (h1, h2, n_docs, max_doc) sorted by hash within hash
partitions. A batch of documents is merge-anti-joined with the runs, which gives the lines that
are new, and then added as a run of level 0; when a level holds FANOUT runs they are compacted
to one of the next level, so a line hash is rewritten a logarithmic number of times.

``dedup`` takes the batches by falling doc_id: the batch in which a line is new holds the largest
doc_id with that line, which keeps it, and the runs hold in how many documents it is. Incremental
use: ``LineIndex.new_lines`` (lines in no run yet), ``LineIndex.add``. Lines are hashed once, into a
written table that the batches and the last step read.

Line hashes are 128 bits wide (two longs), so that equal hashes stand for equal keys. A document
is a doc_id: rows that share one count once.

Edge cases: a null or empty text is one empty line; a very long text is hashed by itself; rows that
share a doc_id drop and keep the same lines, repeated rows too; rows without a doc_id count for no
line and keep none that goes; of equal lines those of the largest doc_id all stay (ties); only
doc_id and text are read, so other columns cannot clash; an empty table gives an empty result. A
line of a third of all documents is one row per task in the runs' aggregation; in the last join
such hot lines, HOT at most, are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Stash, batches_of_bytes, batches_of_rows, documents

FANOUT, BATCHES, MIN_CHARS, MIN_DOCS = 4, 6, 40, 5
#: A line is hot if more than HOT_ROWS documents hold it and more than 1 / HOT of all (line, document) pairs.
HOT, HOT_ROWS = 2000, 1000
_STRIP = BLANKS.encode()
_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64())])


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line stripped and with A-Z lower-cased; None if shorter than min_chars code points."""
    key = line.strip(_STRIP).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_bytes(batches, 1):
            hashes, ids, tags = [], [], []
            for doc_id, text, tag in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = {xxhash.xxh3_128_digest(k) for line in (text or b"").split(b"\n") if (k := line_key(line, min_chars)) is not None}
                hashes.extend(own)
                ids.extend([doc_id] * len(own))
                tags.extend([tag] * len(own))
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64()), pa.array(tags, pa.int64())], schema=_LINES)

    return run


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tag); the tag tells rows with one doc_id and different texts apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumn("tag", F.xxhash64("text"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, tag), each line key of a row once."""
    return tagged(docs).mapInArrow(_line_hashes(min_chars), "h1 long, h2 long, doc_id long, tag long")


class LineIndex:
    """Levels of runs; levels[k] is a list of written tables."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.levels = fanout, []

    def runs(self) -> list[DataFrame]:
        return [run.df for level in self.levels for run in level]

    @staticmethod
    def _merged(parts: list[DataFrame]) -> DataFrame:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def add(self, lines: DataFrame) -> Stash:
        """Adds a batch's lines (h1, h2, doc_id) as a sorted run, compacting full levels. Returns
        those (h1, h2, n_docs, max_doc) that no run held before."""
        own = lines.where("doc_id is not null").select("h1", "h2", "doc_id").distinct()
        run = own.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
        run = Stash(run.sortWithinPartitions("h1", "h2"), "lines-l0")
        new = Stash(self.new_lines(run.df), "lines-new")
        self._put(0, run)
        return new

    def _put(self, level: int, run: Stash) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, Stash(self._merged([r.df for r in old]).sortWithinPartitions("h1", "h2"), f"lines-l{level + 1}"))
            for r in old:
                r.drop()

    def merged(self) -> DataFrame:
        """All runs as one (h1, h2, n_docs, max_doc)."""
        return self._merged(self.runs())

    def new_lines(self, lines: DataFrame) -> DataFrame:
        """Merge-anti-join: the lines (h1, h2, ...) whose hash no run holds."""
        for run in self.runs():
            lines = lines.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return lines

    def drop(self) -> None:
        for level in self.levels:
            for run in level:
                run.drop()
        self.levels = []


def repeated(docs_lines: DataFrame, often: DataFrame) -> DataFrame:
    """(doc_id, tag, h1, h2) of the lines that go: those in often (h1, h2, n_docs, max_doc) that a
    larger doc_id keeps."""
    total = often.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    hot = F.col("n_docs") > max(HOT_ROWS, total // HOT)
    hottest = often.where(hot).select("h1", "h2", F.col("max_doc").alias("hot_max"))  # at most HOT rows, so it may be broadcast
    lines = docs_lines.join(F.broadcast(hottest), ["h1", "h2"], "left")
    # rows of hot lines are done; their keys are scattered so that they meet in no task
    scattered = lambda h: F.when(F.col("hot_max").isNotNull(), F.xxhash64("doc_id", "tag", h)).otherwise(F.col(h))
    rest = often.where(~hot).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "max_doc")
    hit = lines.withColumn("k1", scattered("h1")).withColumn("k2", scattered("h2")).join(rest, ["k1", "k2"], "left").withColumn("last", F.coalesce("hot_max", "max_doc"))
    return hit.where(F.col("last").isNotNull() & F.coalesce(F.col("doc_id") < F.col("last"), F.lit(True))).select("doc_id", "tag", "h1", "h2")


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])


def _keep(min_chars: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_rows(batches, 1000):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for doc_id, text, gone in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                lines = (text or b"").split(b"\n")
                kept = lines
                if gone is not None:
                    drop = {gone[k : k + 16] for k in range(0, len(gone), 16)}
                    kept = [x for x in lines if (k := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in drop]
                whole = b"\n".join(kept)
                for to, value in zip(out, (doc_id, len(lines), len(lines) - len(kept), hashlib.sha256(whole).hexdigest() if digest else whole.decode("utf-8")), strict=True):
                    to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _KEPT.types, strict=True)], schema=_KEPT)

    return run


def batch_of(lines: DataFrame, batches: int) -> list[DataFrame]:
    """Rows with a doc_id cut by it into so many batches of about equal rows, the largest first."""
    at = lines.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(at or []), reverse=True)
    if not cuts:
        return [lines]
    inner = [lines.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)) for a, b in zip(cuts[1:], cuts, strict=False)]
    return [lines.where(F.col("doc_id") >= cuts[0]), *inner, lines.where(F.col("doc_id") < cuts[-1])]


def often_held(lines: DataFrame, index: LineIndex, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> Stash:
    """(h1, h2, n_docs, max_doc) of the lines (h1, h2, doc_id) that min_docs documents or more hold,
    batch by batch through the index."""
    new = [index.add(batch) for batch in batch_of(lines, batches)]
    keepers = new[0].df
    for n in new[1:]:
        keepers = keepers.unionByName(n.df)
    counts = index.merged().where(F.col("n_docs") >= min_docs).select("h1", "h2", "n_docs")
    out = Stash(counts.join(keepers.select("h1", "h2", "max_doc"), ["h1", "h2"]), "often")
    for n in new:
        n.drop()
    return out


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, digest: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): kept is the text left, or with digest its SHA-256."""
    lines, index = Stash(line_hashes(docs, min_chars), "line-hashes").df, LineIndex(fanout)
    often = often_held(lines, index, min_docs, batches).df
    index.drop()
    packed = repeated(lines, often).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("h1", "h2")).alias("g"))
    packed = packed.select(F.col("doc_id").alias("g_id"), F.col("tag").alias("g_tag"), "g")
    same = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tag") == F.col("g_tag"))
    joined = tagged(docs).join(packed, same, "left").select("doc_id", "text", "g")
    return joined.mapInArrow(_unpacked(min_chars, digest), "doc_id long, n_lines long, n_dropped long, kept string")


def _unpacked(min_chars: int, digest: bool):
    keep = _keep(min_chars, digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> Iterator[pa.RecordBatch]:
            for batch in batches_of_rows(batches, 1000):
                lists = batch.column(2)
                flat = lists.flatten()
                both = np.stack([flat.field("h1").to_numpy(zero_copy_only=False), flat.field("h2").to_numpy(zero_copy_only=False)], axis=1).astype(np.int64).tobytes() if len(flat) else b""
                ends = np.cumsum([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()])
                valid = lists.is_valid().to_pylist()
                starts = [0, *ends[:-1].tolist()] if len(ends) else []
                gone = [both[16 * a : 16 * b] if ok else None for a, b, ok in zip(starts, ends.tolist(), valid, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.binary())], names=["doc_id", "text", "gone"])

        yield from keep(packed())

    return run


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(documents(spark, sf_dir), digest=True)
    return out.withColumnRenamed("kept", "kept_sha256")


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS max_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id < f.max_doc AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
