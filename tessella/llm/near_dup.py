"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

Signature: each shingle ranks the M positions by its own random permutation and puts level +
uniform at the position of each level; a position keeps the least value. As values of level j
lie in [j, j+1), a document whose positions are all filled after some level is finished: most
stop after one. Levels are run over all documents of a batch at once.

Documents with equal shingle sets form a class, grouped by a 128-bit hash, and only class
representatives (least doc_id) go on. Bands of the signature give buckets. The first member
of a bucket is its pivot and is compared with all others on the full sets; links are grouped.
Two members of a pivot that are still in different components are compared too, unless the
differences from the pivot refute a link (see ``unrefuted``). So every pair that shares a
bucket is linked, in one component, or refuted: no pairs within a group of copies, and no
link lost to a cap.

Sets are compared as sorted arrays of 64-bit shingle hashes.

Edge cases: documents without words (null text too) are linked with nothing; with fewer words
than a shingle's the whole sequence is the set; a very long text is signed with few others at a
time; rows that share a doc_id are one document for links; a class whose ids are all null stays
ungrouped; ties go to the least doc_id; ``near_duplicates`` reads only doc_id and text, and
``distinct_documents`` carries other columns in a struct, so they cannot clash; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HotKeys, IdFilter, Scratch, Stash, batches_of_bytes, documents, hashed_words, mix64, shingle_set
from .components import components

POSITIONS, ROWS = 80, 4
#: Members of one hub that are dealt to one task.
PER_TASK = 64


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The set of each text, A-Z lower-cased."""
    h, n = hashed_words(texts, lower=True)
    ends = np.cumsum(n).tolist()
    return [shingle_set(h[a:b], words) for a, b in zip([0, *ends], ends, strict=False)]


def superminhash(sets: list[np.ndarray], m: int = POSITIONS) -> np.ndarray:
    """len(sets) x m signatures of non-empty sets of 64-bit hashes."""
    n = len(sets)
    sig = np.full(n * m, np.inf)
    elem = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    perm: np.ndarray | None = None
    for level in range(m):
        if not len(elem):
            break
        x = mix64(elem ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        value = level + (x & np.uint64(0xFFFFFFFF)).astype(np.float64) / (1 << 32)
        pick = level + ((x >> np.uint64(32)) * np.uint64(m - level) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            place = pick
        else:
            rows = np.arange(len(elem))
            place = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[rows, level]
        np.minimum.at(sig, doc * m + place, value)
        open_docs = np.isinf(sig.reshape(n, m)).any(axis=1)
        stay = open_docs[doc]
        if perm is None:
            elem, doc, first = elem[stay], doc[stay], pick[stay]
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(elem), 1))
            perm[np.arange(len(elem)), first] = 0
        else:
            elem, doc, perm = elem[stay], doc[stay], perm[stay]
    return sig.reshape(n, m)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """n x (m / rows) bucket hashes, different for different bands."""
    bits = sig.view(np.uint64).reshape(len(sig), -1, rows)
    h = np.arange(1, bits.shape[1] + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = np.broadcast_to(h, bits.shape[:2]).copy()
    for k in range(rows):
        h = mix64(h ^ bits[:, :, k])
    return h.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(words: int, m: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_bytes(batches, 1, 1 << 20):
            sets = shingle_sets(batch.column(1), words)
            full = [s for s in sets if len(s)]
            own = bands(superminhash(full, m), rows) if full else np.zeros((0, m // rows), np.int64)
            it = iter(own)
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            listed = pa.array([next(it) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), listed], schema=_SIGNED)

    return run


def signed(docs: DataFrame, words: int, m: int = POSITIONS, rows: int = ROWS) -> DataFrame:
    thin = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return thin.mapInArrow(_sign(words, m, rows), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def _sets(words: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_bytes(batches, 1):
            batch = batch.filter(pa.array(wanted.value.maybe(pc.fill_null(batch.column(0), 0).to_numpy())))
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return run


_COMPARED = "a long, b long, linked boolean, n_a long, n_b long, diff array<long>"


def _compare(least: int, with_diff: bool):
    """Rows sorted by (a, salt, kind): the sets of a (kind 0; several if rows share its id), then
    those of the members b that are compared with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: list[np.ndarray] = []
        at = None
        for batch in batches_of_bytes(batches, 4, 2 << 20):
            out: list[tuple] = []
            for a, salt, kind, b, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if kind == 0:
                    if at != (a, salt):
                        hub = []
                    at = (a, salt)
                    hub.append(own)
                    continue
                for other in hub if at == (a, salt) else ():
                    apart = np.setxor1d(other, own, assume_unique=True)
                    both = (len(other) + len(own) - len(apart)) // 2
                    out.append((a, b, 100 * both >= least * (len(other) + len(own) - both), len(other), len(own), apart.view(np.int64) if with_diff else []))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["a", "b", "linked", "n_a", "n_b", "diff"])

    return run


def compared(sets: DataFrame, pairs: DataFrame, least: int, with_diff: bool, scratch: Scratch) -> DataFrame:
    """Each of pairs (a, b) with whether 100 * intersection >= least * union, the sets' sizes
    and, with_diff, their symmetric difference.

    b's set travels to the pair; a's set, which may serve very many pairs, is copied once per
    PER_TASK of them, and the pairs are salted alike. A task reads a's set once and then its members'.
    """
    hot = HotKeys(pairs, "a", PER_TASK, scratch)
    parts = hot.keys.select("a", F.ceil(F.col("n") / PER_TASK).cast("int").alias("parts"))
    of = lambda df: df.join(F.broadcast(parts) if hot.few else parts, "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    salted = of(pairs).select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"))
    hubs = of(pairs.select("a").distinct().join(sets.withColumnRenamed("doc_id", "a"), "a"))
    hubs = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("b"), "shingles")
    members = salted.join(sets.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "shingles")
    both = hubs.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    return both.mapInArrow(_compare(least, with_diff), _COMPARED)


def unrefuted(star: DataFrame, labels: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of members of one pivot, in different components, that may be linked.

    star holds each member's difference D from its pivot (a: pivot, b: member). Members u, v
    differ by |D_u| + |D_v| - 2 |D_u and D_v| shingles, and what only one member of the pivot
    has in its D is in no intersection: with c the rest of D, they differ by at least
    |D_u| + |D_v| - 2 min(c_u, c_v). Independent edits are such elements, so of a large group
    of copies with different edits hardly a pair is left to compare. The bound is tried on
    the distinct sizes of a pivot's members first, whose number doesn't grow with the group.
    """
    hot = HotKeys(star, "a", PER_TASK, scratch)
    comp = lambda c, name: labels.select(F.col("node").alias(c), F.col("comp").alias(name))
    known = hot.join(star, comp("a", "ca")).join(comp("b", "cb"), "b", "left")
    known = known.withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))
    known = scratch(known.select("a", "b", "cb", (F.col("ca") != F.col("cb")).alias("open"), F.col("n_b").alias("n"), F.size("diff").alias("d"), "diff"), "known")
    rows = scratch(hot.join(known, known.where("open").select("a").distinct(), "left_semi"), "open")
    alone = rows.select("a", "b", F.explode("diff").alias("e")).groupBy("a", "e").agg(F.count(F.lit(1)).alias("k"), F.min("b").alias("b")).where("k = 1")
    own = alone.groupBy("a", "b").agg(F.count(F.lit(1)).alias("own"))
    sized = scratch(rows.drop("diff").join(own, ["a", "b"], "left").withColumn("c", F.col("d") - F.coalesce("own", F.lit(0))).drop("own"), "sized")
    left = sized.where("open").select("a", *[F.col(k).alias(f"{k}_l") for k in ("b", "cb", "n", "d", "c")])
    right = sized.select("a", *[F.col(k).alias(f"{k}_r") for k in ("b", "cb", "open", "n", "d", "c")])
    apart = F.col("d_l") + F.col("d_r") - 2 * F.least("c_l", "c_r")
    fits = (100 + least) * apart <= (100 - least) * (F.col("n_l") + F.col("n_r"))
    kinds = left.select("a", "n_l", "d_l", "c_l").distinct().join(right.select("a", "n_r", "d_r", "c_r").distinct(), "a").where(fits)
    some = left.join(kinds, ["a", "n_l", "d_l", "c_l"])
    pairs = some.join(right, ["a", "n_r", "d_r", "c_r"]).where((F.col("cb_l") != F.col("cb_r")) & (~F.col("open_r") | (F.col("b_l") < F.col("b_r"))))
    return pairs.select(F.least("b_l", "b_r").alias("a"), F.greatest("b_l", "b_r").alias("b")).distinct()


def links(docs: DataFrame, members: DataFrame, words: int, least: int, scratch: Scratch) -> DataFrame:
    """(node, comp) of class representatives with links; members: (bucket, node)."""
    heads = members.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    star = scratch(members.join(heads, "bucket").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    ids = star.select(F.col("a").alias("doc_id")).unionAll(star.select(F.col("b").alias("doc_id"))).distinct()
    ids = scratch(ids, "ids")
    # sets are made only for rows that a bounded Bloom filter of the ids lets through, so that the
    # texts needn't be shuffled; a set too many finds no pair. Where there are more ids than the
    # filter is made for, a join makes the choice exact.
    wanted = docs.sparkSession.sparkContext.broadcast(IdFilter.build(ids))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary"))
    sets = texts.mapInArrow(_sets(words, wanted), "doc_id long, shingles binary")
    if not wanted.value.tight:
        sets = sets.join(ids, "doc_id", "left_semi")
    sets = scratch(sets, "sets")
    seen = scratch(compared(sets, star, least, True, scratch), "star")
    edges = seen.where("linked").select("a", "b")
    labels = components(edges)
    more = scratch(unrefuted(seen, labels, least, scratch), "pairs")
    if more.isEmpty():
        return labels
    found = compared(sets, more, least, False, scratch).where("linked").select("a", "b")
    return components(edges.unionAll(found))


def near_duplicates(docs: DataFrame, words: int = 5, least: int = 80, m: int = POSITIONS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    return _grouped(docs, words, least, m, rows).drop("s1", "s2")


def _grouped(docs: DataFrame, words: int, least: int, m: int, rows: int) -> DataFrame:
    docs, scratch = docs.select("doc_id", "text"), Scratch()
    sig = Stash(signed(docs, words, m, rows), "signatures").df
    classes = scratch(sig.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "classes")
    members = classes.where(F.col("node").isNotNull()).select(F.explode("bands").alias("bucket"), "node").distinct()
    labels = links(docs, members, words, least, scratch)
    named = Stash(classes.select("s1", "s2", "node").join(labels, "node", "left").select("s1", "s2", F.coalesce("comp", "node").alias("comp")), "class-components").df
    scratch.drop()
    out = sig.drop("bands").join(named, ["s1", "s2"], "left")
    comp = F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), "s1", "s2").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_documents(docs: DataFrame, words: int = 5, least: int = 80) -> DataFrame:
    """docs, with all columns, without the rows whose component has a smaller doc_id. Rows that
    share the kept doc_id and their text stay once; rows without a doc_id stay unless linked
    to one with; documents without words all stay."""
    found = Stash(_grouped(docs, words, least, POSITIONS, ROWS), "near-duplicates").df
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("n_id")).distinct()
    rows = docs.select(F.struct("*").alias("n_row"), F.col("doc_id").cast("long").alias("n_doc"), F.col("text").alias("n_text"))
    same = F.col("n_doc").eqNullSafe(F.col("n_id"))
    left = rows.join(gone, same, "left_anti")
    repeated = found.where("kept").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("n_id"))
    if not repeated.isEmpty():
        once = left.join(repeated, same, "left_semi").dropDuplicates(["n_doc", "n_text"])
        left = left.join(repeated, same, "left_anti").unionByName(once)
    return left.select("n_row.*")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, least=85)


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list(g) AS g, count(*) AS n FROM (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)
  ) GROUP BY doc_id
), e AS (
  SELECT doc_id, n, unnest(g) AS g FROM s
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT x.b, r.root FROM reach r JOIN both_ways x ON x.a = r.node WHERE r.root < x.b
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
FROM d JOIN reach r ON r.node = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
