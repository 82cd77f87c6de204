"""Mixing sources to target weights.

Tokens are summed per source, a water-filling gives each source its target (capped at a
multiple of its size), and the repetition rate target / size follows. A document is emitted
floor(rate) times, and once more if a hash of its id, seeded, falls below the fraction. The seed
is a source's own: of SEEDS shifts of the hash the one that brings the source's words nearest
to its target, from one aggregation that holds the sums for all of them.

Edge cases: a null text has size 0; a null source is a source of its own, ordered last; a
source without words has rate 1, since no number of copies changes its words; a very long text is
counted whole and repeated whole; repeated rows are mixed each for itself but share the extra
copy's hash; sources of one ratio are filled in code-point order and of equally near shifts the
first is taken (ties); ``mix`` carries other columns in a struct, so they cannot clash; an empty
table gives none.

Words are counted once: sizes, sources and hashes are written as a thin table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stash, unit_hash, word_count

#: So many sources' rows are broadcast, those with most documents; the others are joined.
BROADCAST_SOURCES = 10_000
WEIGHTS, CAP, SEED, SEEDS = (1.0, 2.0, 3.0), 3.0, "mix-1", 32


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(m_source, source_size, m_rows, target) from rows (m_source, m_size).

    Sources in code-point order, null last, carry the weights in turn. Ordered by
    cap * size / weight, each source in turn either stops at its cap or, with all after it,
    shares what is left by weight; that is the fixpoint of resharing the excess.
    The windows without a key run over one row per source.
    """
    per = sizes.groupBy("m_source").agg(F.sum("m_size").alias("source_size"), F.count(F.lit(1)).alias("m_rows"))
    turn = F.row_number().over(Window.orderBy(F.col("m_source").asc_nulls_last())) - 1
    most = F.lit(cap) * F.col("source_size")
    by_ratio = Window.orderBy("ratio", "turn")
    filled = (
        per.withColumn("turn", turn)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")))
        .withColumn("ratio", most / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("capped_before", F.coalesce(F.sum(most).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("place", F.row_number().over(by_ratio))
    )
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("place", "level"))).over(Window.partitionBy())
    share = F.col("first.level") * F.col("weight")
    return filled.withColumn("first", first).select("m_source", "source_size", "m_rows", F.least(most, F.coalesce(share, most)).alias("target"))


def _rate(cap: float) -> Column:
    return F.when(F.col("source_size") == 0, F.lit(1.0)).otherwise(F.least(F.col("target") / F.col("source_size"), F.lit(cap)))


def _extra(shift: Column) -> Column:
    """Whether the Bernoulli copy is made, for a shift of the hash m_u."""
    x = F.col("m_u") + shift / float(SEEDS)
    return x - F.floor(x) < F.col("m_rate") - F.floor("m_rate")


def _joined(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with their source's row: the sources with most documents, which may be hot, are
    broadcast, and what they leave is dealt by source."""
    right = sources.withColumnRenamed("m_source", "t_source")
    same = F.col("m_source").eqNullSafe(F.col("t_source"))
    if sources.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(right), same, "left").drop("t_source", "m_rows")
    most = right.orderBy(F.desc("m_rows"), "t_source").limit(BROADCAST_SOURCES)
    most = F.broadcast(stash(most.withColumn("m_most", F.lit(True)), "mix-most"))
    first = rows.join(most, same, "left")
    rest = first.where("m_most is null").select(*rows.columns).join(right, same, "left")
    return first.where("m_most").drop("m_most").unionByName(rest).drop("t_source", "m_rows")


def hashed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds m_source and m_u, a document's hash in [0, 1)."""
    return docs.withColumns({"m_source": F.col("source"), "m_u": unit_hash(F.lit(seed), F.col("doc_id"))})


def source_plan(thin: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(m_source, source_size, target, m_rows, m_rate, m_shift) from rows (m_source, m_size, m_u)."""
    targets = stash(source_targets(thin, weights, cap).withColumn("m_rate", _rate(cap)), "mix-targets")
    tried = _joined(thin.select("m_source", "m_size", "m_u"), targets)
    sums = [F.coalesce(F.sum(F.when(_extra(F.lit(k)), F.col("m_size"))), F.lit(0)).alias(f"e{k}") for k in range(SEEDS)]
    base = F.floor("m_rate") * F.col("source_size")
    gaps = F.array(*[F.struct(F.abs(base + F.col(f"e{k}") - F.col("target")).alias("gap"), F.lit(k).alias("k")) for k in range(SEEDS)])
    known = tried.groupBy("m_source", "source_size", "target", "m_rate").agg(F.count(F.lit(1)).alias("m_rows"), *sums)
    return stash(known.select("m_source", "source_size", "target", "m_rows", "m_rate", F.array_min(gaps)["k"].alias("m_shift")), "mix-seeds")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (m_source, m_u, ...) with source_size, target and m_copies."""
    copies = F.floor("m_rate") + F.when(_extra(F.col("m_shift")), 1).otherwise(0)
    return _joined(rows, plan).withColumn("m_copies", copies.cast("long")).drop("m_source", "m_u", "m_rate", "m_shift")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, m_size, m_source, m_u), written, of docs (doc_id, text, source)."""
    return stash(hashed(docs.select("doc_id", "source", word_count(F.col("text")).alias("m_size")), seed).drop("source"), "mix-sizes")


def with_targets(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """Adds m_size, source_size, target and m_copies to each row of docs (doc_id, text, source)."""
    plan = source_plan(sized(docs, seed), weights, cap)
    return with_copies(hashed(docs.withColumn("m_size", word_count(F.col("text"))), seed), plan)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row of docs as often as its copies say, with docs' columns."""
    plan = source_plan(sized(docs, seed), weights, cap)
    inner = docs.select(F.struct("*").alias("m_row"), F.col("doc_id"), F.col("source"))
    out = with_copies(hashed(inner, seed), plan)
    return out.select("m_row", F.explode(F.array_repeat(F.lit(1), F.col("m_copies").cast("int"))).alias("m_copy")).select("m_row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    thin = sized(documents(spark, sf_dir))
    out = with_copies(thin, source_plan(thin))
    return out.select("doc_id", F.col("m_size").alias("size"), "source_size", "target", (F.col("m_size") * F.col("m_copies")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM per
), r AS (
  SELECT *, CAST(turn % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS most, 3.0::DOUBLE * source_size / (turn % 3 + 1) AS ratio FROM w
), f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(weight) OVER (ORDER BY ratio, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
     row_number() OVER (ORDER BY ratio, turn) AS place FROM r
), l AS (SELECT arg_min(level, place) AS level FROM f WHERE ratio > level
), t AS (
  SELECT f.source, f.source_size, least(f.most, coalesce(l.level * f.weight, f.most)) AS target FROM f, l
), c AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size = 0 THEN 1.0::DOUBLE ELSE least(t.target / t.source_size, 3.0::DOUBLE) END AS rate,
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT source, k, abs(floor(any_value(rate)) * any_value(source_size) + sum(CASE WHEN u + k / 32.0::DOUBLE - floor(u + k / 32.0::DOUBLE) < rate - floor(rate) THEN size ELSE 0 END) - any_value(target)) AS gap
  FROM c, (SELECT unnest(range(32)) AS k) GROUP BY source, k
), b AS (
  SELECT source, k FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY gap, k) = 1
)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u + k / 32.0::DOUBLE - floor(u + k / 32.0::DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
"""
