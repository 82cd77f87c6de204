"""Language-model scoring with a log-frequency Bloom filter.

Counts of tokens (words, and one end per document) and of all bigrams are exact. A bigram's count
is quantised on a logarithmic scale, q = 1 + floor(log_b c), and the bigram is entered into a
Bloom filter once for each level 1..q. A probe asks for level 1, 2, ... until one is absent: the
last present level is the quantised count. The PROBES bits of an entry lie in one word of 64, so
that a probe reads memory once; about 1 % of absent entries seem present.

Probability, absolutely discounted and interpolated with the unigram:
    p(w | h) = max(c^(h w) - D, 0) / c(h) + alpha(h) p(w),   p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))
where c^ = b^(q - 1) is at most the count and alpha(h) = 1 - sum_w max(c^ - D, 0) / c(h), so
the probabilities of a context add up to one but for the filter's false positives. Contexts that
were never seen, and a document's first token, use p(w).

Bigrams are keyed by the 64-bit hash of the context and a mix of both words' hashes, which for one
context is a bijection of the second word's; within a part of the filter its upper 40 bits are. Tasks count what they hold and send it packed, one
row a part, to as many parts as there are shuffle partitions: by context, so that a part sums
the context's masses, but a context with more than 1 / (4 parts) of all tokens by bigram, so that
it is spread. Each part counts, quantises and fills its own piece of the filter, of BITS_PER_ENTRY
an entry whatever their number. No table of bigrams is written.

The filter stays in its parts, whatever its size. Texts are dealt to homes; each asks the parts for its
distinct bigrams, sorted and packed, and is answered with their quantised counts; the texts' exchange
is reused when they are scored.

The totals of the DICTIONARY most frequent tokens are broadcast (a bounded table). A
position with a rarer token, as word or context, is completed by joins with the table of all totals;
as these tokens are rare, the joins have no hot key.

Masses, and what joins complete, are summed as integers, so that no order of rows changes a score.

Edge cases: a null text is empty and has its end only; a very long text is one row of its home; a null doc_id is training data; repeated rows count and are scored each; of tokens
equally frequent at the dictionary's end all or none are in it, which changes no score (ties);
without training tokens every count is 0; only doc_id and text are read, so other columns cannot
clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, array_of, batches_of_bytes, documents, hashed_words, home_of_row, homes_for, mix64, pack_sorted, partitions, tidy, unpack_sorted

DICTIONARY = 1 << 20
BASE, DISCOUNT = 1.5, 0.75
BITS_PER_ENTRY, PROBES = 12, 5
#: Positions that a task holds before it sends their bigrams; the unit of masses and of joined sums.
FLUSH, MASS_UNIT, SCORE_UNIT = 1_500_000, 1 << 20, 1 << 40
#: Stands for a document's end among the hashes of its words.
END = np.uint64(0x5851F42D4C957F2D)
_CODEC = pa.Codec("zstd")
_M32 = np.uint64(0xFFFFFFFF)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, number of tokens of each text): the words with A-Z lower-cased, then
    the end."""
    h, n = hashed_words(texts, lower=True)
    out = np.full(len(h) + len(n), END)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, n + 1


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    for batch in batches_of_bytes(batches, 0):
        held.append(tokens(batch.column(0))[0])
        if sum(map(len, held)) > FLUSH:
            yield flush()
    if held:
        yield flush()


def token_counts(train: DataFrame) -> DataFrame:
    """(h, c): exact counts over the whole of train (text)."""
    return train.select(F.col("text").cast("binary")).mapInArrow(_count_tokens, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def grams_of(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The bigrams' keys; for one h each w has its own."""
    return mix64(h * np.uint64(0x9E3779B97F4A7C15) + w)


def parts_of(h: np.ndarray, g: np.ndarray, hot: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, a key that orders by part and, but for hot contexts, by context); hot is sorted."""
    at = np.minimum(np.searchsorted(hot, h), max(0, len(hot) - 1))
    key = mix64(np.where(hot[at] == h, g, h) if len(hot) else h)
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), key


def _squeezed(raw: bytes) -> bytes:
    return _CODEC.compress(raw, asbytes=True)


def _opened(packed: bytes, size: int) -> bytes:
    return _CODEC.decompress(packed, size, asbytes=True)


def pack_bigrams(h: np.ndarray, g: np.ndarray, c: np.ndarray) -> bytes:
    """h in runs"""
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(first, append=len(h))
    return np.array([len(g), len(first)], np.int64).tobytes() + g.tobytes() + h[first].tobytes() + _squeezed(size.astype(np.int32).tobytes() + c.astype(np.int64).tobytes())


def unpack_bigrams(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, runs = np.frombuffer(blob, np.int64, 2).tolist()
    raw = _opened(blob[16 + 8 * (n + runs) :], 4 * runs + 8 * n)
    h = np.repeat(np.frombuffer(blob, np.uint64, runs, 16 + 8 * n), np.frombuffer(raw, np.int32, runs))
    return h, np.frombuffer(blob, np.uint64, n, 16), np.frombuffer(raw, np.int64, n, 4 * runs)


def _bigrams(hot: np.ndarray, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, g = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            g, first, c = np.unique(g, return_index=True, return_counts=True)
            h = h[first]
            part, key = parts_of(h, g, hot, parts)
            order = np.argsort(key)
            h, g, c, part = h[order], g[order], c[order], part[order]
            bounds = np.searchsorted(part, np.arange(parts + 1))
            out = [(p, pack_bigrams(h[a:b], g[a:b], c[a:b])) for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], names=["part", "blob"])

        for batch in batches_of_bytes(batches, 0):
            w, n = tokens(batch.column(0))
            inside = np.ones(len(w), bool)
            inside[np.cumsum(n) - 1] = False  # nothing follows an end
            inside = np.flatnonzero(inside)
            held.append((w[inside], grams_of(w[inside], w[inside + 1])))
            if sum(len(x[0]) for x in held) > FLUSH:
                yield flush()
        if sum(len(x[0]) for x in held):
            yield flush()

    return run


def levels_of(c: np.ndarray) -> np.ndarray:
    """1 + floor(log_b c), with care for powers of b."""
    return (np.floor(np.log(c.astype(float)) / math.log(BASE) + 1e-9) + 1).astype(np.int64)


#: What the filter keeps of a bigram's key.
KEPT = np.uint64(24)


def _marks(gram: np.ndarray, level: int, words: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(word, bits in it) of (gram, level) in a piece of so many words, 2^32 at most."""
    x = mix64(gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level))
    bits = np.zeros(len(x), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << (x >> np.uint64(6 * k) & np.uint64(63))
    return ((x >> np.uint64(32)) * words >> np.uint64(32)).astype(np.int64), bits


def filled(gram: np.ndarray, q: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> bytes:
    """A piece of the filter that holds each gram (its upper bits) at the levels 1..q."""
    piece = np.zeros(max(1, -(-int(q.sum()) * bits_per_entry // 64)), np.uint64)
    for level in range(1, int(q.max(initial=0)) + 1):
        at, bits = _marks(gram[q >= level], level, np.uint64(len(piece)))
        order = np.argsort(at)
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        piece[at[order][first]] |= np.bitwise_or.reduceat(bits[order], first)
    return piece.tobytes()


class LogFrequencyFilter:
    """A piece of the filter and its probes."""

    def __init__(self, piece: bytes):
        self.words = np.frombuffer(piece, np.uint64)

    def quantised(self, grams: np.ndarray) -> np.ndarray:
        """The last level present of each gram (its upper bits), 0 if none is."""
        out = np.zeros(len(grams), np.int64)
        left, level = np.arange(len(grams)), 1
        while len(left):
            at, bits = _marks(grams, level, np.uint64(len(self.words)))
            here = np.flatnonzero(self.words[at] & bits == bits)
            left, grams = left[here], grams[here]
            out[left] = level
            level += 1
        return out


def _counted(bits_per_entry: int):
    """Per part: its piece of the filter, and the masses of its contexts in MASS_UNITs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(part, []).append(unpack_bigrams(blob))
        for part in list(held):
            h, g, c = (np.concatenate(x) for x in zip(*held.pop(part), strict=True))
            order = np.argsort(g)
            h, g, c = h[order], g[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            h, g, q = h[first], g[first], levels_of(np.add.reduceat(c, first))
            order = np.argsort(h)
            mass = np.round(np.maximum(BASE ** (q[order] - 1.0) - DISCOUNT, 0.0) * MASS_UNIT).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
            contexts, mass = h[order][first].view(np.int64), np.add.reduceat(mass, first)
            piece = filled(g >> KEPT, q, bits_per_entry)
            for k in range(0, len(contexts), 50_000):
                some = slice(k, k + 50_000)
                lists = [pa.array([x[some].tolist()], pa.list_(pa.int64())) for x in (contexts, mass)]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([piece if k == 0 else None], pa.binary()), *lists], names=["part", "piece", "h", "m"])

    return run


def counted(train: DataFrame, hot: np.ndarray, parts: int, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """(part, piece, h, m) from train (text): the filter's piece of a part and, as lists, the
    masses of contexts; a context may be in several rows."""
    sent = train.mapInArrow(_bigrams(hot, parts), "part int, blob binary").repartitionById(parts, "part")
    return sent.mapInArrow(_counted(bits_per_entry), "part int, piece binary, h array<long>, m array<long>")


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, open_h array<long>, open_w array<long>, open_q array<long>, open_ch array<long>, open_m array<double>, open_cw array<long>"
OPEN = ("h", "w", "q", "ch", "m", "cw")


def looked_up(m: dict, h: np.ndarray) -> dict[str, np.ndarray]:
    """What the model knows of tokens, given their hashes in order."""
    found = np.zeros(len(h), bool)
    count, mass, carried = np.zeros(len(h), np.int64), np.zeros(len(h)), np.zeros(len(h), bool)
    if len(m["hashes"]):
        at = np.minimum(np.searchsorted(m["hashes"], h), len(m["hashes"]) - 1)
        found = m["hashes"][at] == h
        count[found], mass[found], carried[found] = (m[k][at[found]] for k in ("counts", "mass", "carried"))
    p = (count + 0.1) / m["total"]
    alpha = np.where(count > 0, np.maximum(1e-6, 1 - mass / np.maximum(count, 1)), 1.0)
    rare, tail = ~(carried | m["all_carried"]), ~found & (not m["complete"])
    return {"h": h, "count": count, "mass": mass, "rare": rare, "tail": tail, "p": p, "log": np.log10(p), "alpha": alpha, "hot": np.isin(h, m["hot"]), "part": parts_of(h, h, m["hot"][:0], m["parts"])[0]}


class Positions:
    """The tokens of texts, with what the model knows of them, and the bigrams to be asked for."""

    def __init__(self, m: dict, texts: pa.Array):
        h, self.n = tokens(texts)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        h, self.slot = np.unique(h, return_inverse=True)
        self.at = at = looked_up(m, h)
        self.count, self.tail = at["count"][self.slot], at["tail"][self.slot]
        # contexts: the token before in the same document
        self.before = self.slot[np.maximum(np.arange(len(self.slot)) - 1, 0)]
        self.follows = np.zeros(len(self.slot), bool)
        self.follows[1:] = self.doc[1:] == self.doc[:-1]
        self.c_h = np.where(self.follows, at["count"][self.before], 0)
        self.rare = self.follows & at["rare"][self.before]
        # a bigram of tokens never seen in training needs no probe
        self.probed = np.flatnonzero(self.follows & (self.rare | (self.c_h > 0)) & (self.tail | (self.count > 0)))
        asked = self.before[self.probed]
        g = grams_of(at["h"][asked], at["h"][self.slot[self.probed]])
        self.part, hot = at["part"][asked], np.flatnonzero(at["hot"][asked])
        self.part[hot] = parts_of(g[hot], g[hot], m["hot"][:0], m["parts"])[0]
        self.gram = g >> KEPT

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(parts, grams, index back) of the bigrams asked for, by part and gram."""
        key = self.part.astype(np.uint64) << np.uint64(40) | self.gram
        key, back = np.unique(key, return_inverse=True)
        return (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1), back

    def scored(self, doc_id: pa.Array, held_out: pa.Array, found: np.ndarray) -> pa.RecordBatch:
        """The rows' scores, given the quantised counts of the bigrams asked for; what joins must
        complete is left out of the sums and listed."""
        at, n, follows = self.at, self.n, self.follows
        q = np.zeros(len(self.slot), np.int64)
        q[self.probed] = found
        left = self.tail | self.rare
        base = np.where(self.tail, 0.0, at["log"][self.slot])
        full = at["p"][self.slot] * np.where(follows, at["alpha"][self.before], 1.0)
        some = np.flatnonzero(q)
        full[some] += np.maximum(BASE ** (q[some] - 1.0) - DISCOUNT, 0.0) / np.maximum(self.c_h[some], 1) * (self.c_h[some] > 0)
        full = np.where(left, 0.0, np.log10(np.minimum(1.0, full)))
        add = lambda x: np.bincount(self.doc, weights=x, minlength=len(n))
        # -1 stands for what the joins fill in
        mass = np.where(follows & ~self.rare, at["mass"][self.before], 0.0)
        opened = (at["h"][self.before].view(np.int64), at["h"][self.slot].view(np.int64), q, np.where(self.rare, -1, self.c_h), mass, np.where(self.tail, -1, self.count))
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(self.doc[left], minlength=len(n)))]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [doc_id, held_out, pa.array(n.astype(np.int64)), pa.array(add(self.count > 0).astype(np.int64)), pa.array(add(base)), pa.array(add(full)), *(pa.ListArray.from_arrays(offsets, pa.array(x[left])) for x in opened)],
            names=[c.split()[0] for c in _SCORED.split(", ")],
        )


_ASKED = "part int, home int, n int, blob binary"


def _asked(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["part", "home", "n", "blob"])


def _ask(model):
    """Of a home: its distinct bigrams, packed by part."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, gram, _ = Positions(model.value, array_of(table, "text")).distinct()
        used, first, n = np.unique(part, return_index=True, return_counts=True)
        return _asked([(int(p), key[0].as_py(), int(size), pack_sorted(gram[a : a + size])) for p, a, size in zip(used, first, n, strict=True)])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and home, a part's piece (home null) before what is asked of it: the
    quantised counts, in the order asked."""
    own: dict[int, LogFrequencyFilter] = {}
    for batch in batches:
        for part, home, n, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if home is None:
                own = {part: LogFrequencyFilter(blob)}
                continue
            q = own[part].quantised(unpack_sorted(blob, n)[0]) if part in own else np.zeros(n, np.int64)
            yield from _asked([(part, home, n, _squeezed(q.astype(np.uint8).tobytes()))]).to_batches()


def _score_home(model):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Positions(model.value, array_of(table, "text"))
        part, _, back = own.distinct()
        q = np.zeros(len(part), np.int64)
        for p, n, blob in zip(*(answers.column(c).to_pylist() for c in ("part", "n", "blob")), strict=True):
            q[np.searchsorted(part, p) : np.searchsorted(part, p, side="right")] = np.frombuffer(_opened(blob, n), np.uint8)
        return pa.Table.from_batches([own.scored(array_of(table, "doc_id"), array_of(table, "held_out"), q[back])])

    return run


def scored_at_home(rows: DataFrame, model, pieces: DataFrame, parts: int) -> DataFrame:
    """The rows' scores with the pieces (part, piece) of the filter; the texts are shuffled once."""
    homed = rows.select(home_of_row(homes_for(rows, parts)[0]).alias("home"), *rows.columns).repartition(parts, "home").groupBy("home")
    asked = homed.applyInArrow(_ask(model), _ASKED)
    held = pieces.select("part", F.lit(None).cast("int").alias("home"), F.lit(0).alias("n"), F.col("piece").alias("blob"))
    met = asked.unionByName(held).repartitionById(parts, "part").sortWithinPartitions("part", F.col("home").asc_nulls_first())
    answers = met.mapInArrow(_answer, _ASKED)
    return homed.cogroup(answers.groupBy("home")).applyInArrow(_score_home(model), _SCORED)


def dictionary(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(hashes, counts, masses) of the most frequent tokens, at most `most`, ordered by hash;
    whether they are all. The cut is by classes of counts, a few hundred rows."""
    cls = F.floor(F.log2(F.col("c").cast("double")) * 16 + 1e-9)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(cls.alias("k")).count().collect()), reverse=True)
    taken, least = 0, None
    for k, n in sizes:
        if taken + n > most:
            break
        taken, least = taken + n, k
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), not sizes
    top = counts.where(cls >= least).toArrow()
    h = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], top.column("c").to_numpy()[order], top.column("m").to_numpy()[order], taken == sum(n for _, n in sizes)


def discounted(q: Column) -> Column:
    """max(c^ - D, 0) of a quantised count, 0 for none."""
    return F.when(q > 0, F.greatest(F.pow(F.lit(BASE), q - 1) - DISCOUNT, F.lit(0.0))).otherwise(0.0)


def scored(docs: DataFrame, most: int = DICTIONARY, vocabulary: int = DICTIONARY, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for docs (doc_id, text).

    At most `most` tokens' counts are broadcast, and with the `vocabulary` most frequent of them
    what they need as contexts; the others' are joined. None of the bounds changes what is counted."""
    spark = docs.sparkSession
    parts = max(1, partitions(spark))
    rows = docs.select(F.col("doc_id").cast("long"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    train = rows.where(~F.col("held_out")).select("text")
    totals = Stash(token_counts(train), "token-counts")
    n_all, v_all = totals.df.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    hot = totals.df.where(F.col("c") * (4 * parts) > n_all).select("h").toArrow().column("h").to_numpy()  # fewer than 4 parts
    hot = np.sort(hot.view(np.uint64))
    made = Stash(counted(train, hot, parts, bits_per_entry), "bigram-filter")
    masses = made.df.select(F.explode(F.arrays_zip("h", "m")).alias("x")).groupBy(F.col("x.h").alias("h")).agg((F.sum("x.m") / F.lit(float(MASS_UNIT))).alias("m"))
    counts = Stash(totals.df.join(masses, "h", "left").select("h", "c", F.coalesce("m", F.lit(0.0)).alias("m")), "token-totals").df
    totals.drop()
    tidy(spark)  # the bigrams' shuffle is not needed any more
    pieces = made.df.where("piece is not null").select("part", "piece")
    hashes, count, mass, complete = dictionary(counts, most)
    carried = np.zeros(len(hashes), bool)
    carried[np.lexsort((hashes, -count))[:vocabulary]] = True
    all_carried = complete and bool(carried.all())
    total = n_all + 0.1 * (v_all + 1)
    model = spark.sparkContext.broadcast({"hashes": hashes, "counts": count, "mass": mass, "carried": carried, "complete": complete, "all_carried": all_carried, "total": total, "hot": hot, "parts": parts})
    out = scored_at_home(rows, model, pieces, parts)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score"]
    if all_carried:
        return out.select(*columns)
    out = Stash(out.withColumn("rid", F.monotonically_increasing_id()), "scored").df
    tidy(spark)  # nor are the texts'
    left = out.select("rid", F.explode(F.arrays_zip(*[f"open_{k}" for k in OPEN])).alias("t")).select("rid", *[F.col(f"t.open_{k}").alias(k) for k in OPEN])
    left = left.withColumn("tail", F.col("cw") < 0)
    zero = F.lit(0)
    left = _completed(left, F.col("ch") < 0, counts.select("h", F.col("c").alias("c_"), F.col("m").alias("m_")), ["h"], {"ch": F.coalesce("c_", zero), "m": F.coalesce("m_", F.lit(0.0))})
    left = _completed(left, F.col("tail"), counts.select(F.col("h").alias("w"), F.col("c").alias("c_")), ["w"], {"cw": F.coalesce("c_", zero)})
    p = (F.col("cw") + 0.1) / F.lit(total)
    seen = F.col("ch") > 0
    inner = F.greatest("ch", F.lit(1))
    full = F.log10(F.least(F.lit(1.0), F.when(seen, discounted(F.col("q")) / inner).otherwise(0.0) + F.when(seen, F.greatest(F.lit(1e-6), 1 - F.col("m") / inner)).otherwise(1.0) * p))
    added = lambda x: F.sum(F.round(x * SCORE_UNIT).cast("long")) / F.lit(float(SCORE_UNIT))
    more = left.groupBy("rid").agg(added(full).alias("full"), added(F.when(F.col("tail"), F.log10(p)).otherwise(0.0)).alias("base"), F.sum(F.when(F.col("tail") & (F.col("cw") > 0), 1).otherwise(0)).alias("known"))
    both = out.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score").join(more, "rid", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return both.select("doc_id", "held_out", "n_tokens", plus("n_known", "known"), columns[4], plus("base_score", "base"), plus("score", "full"))


def _completed(rows: DataFrame, lacking: Column, known: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """rows, those lacking a value with it from the join; the others keep off the join, as their
    keys may be hot."""
    joined = rows.where(lacking).join(known, keys, "left").withColumns(values).select(*rows.columns)
    return rows.where(~lacking).unionByName(joined)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
