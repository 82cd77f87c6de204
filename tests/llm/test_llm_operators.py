"""The corpus operators against plain Python on a small table, and their edge cases."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import common, components, decontaminate, fingerprints, line_dedup, lm_scoring, mixing, near_dup, quality, sharding, substring_dedup, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_hashed_words_are_those_of_split():
    """Equal hashes stand for equal words, over slices, nulls, either case and very long words."""
    rng = np.random.default_rng(3)
    bits = [b"a", b"B", b" ", b"\n", "é".encode(), b"\x0b", b"xyz", b"longword" * 3, b"q" * 300, b"longword" * 3 + b"r"]
    for lower in (False, True):
        words = {}
        for _ in range(60):
            texts = [None if rng.random() < 0.1 else b"".join(bits[k] for k in rng.integers(0, len(bits), int(rng.integers(0, 30)))) for _ in range(8)]
            skip = int(rng.integers(0, 9))
            h, n = common.hashed_words(pa.array(texts, pa.binary()).slice(skip), lower)
            split = [((t or b"").lower() if lower else t or b"").split() for t in texts[skip:]]
            assert n.tolist() == [len(x) for x in split]
            assert all(words.setdefault(a, b) == b for a, b in zip(h.tolist(), [w for own in split for w in own], strict=True))
        assert len(set(words.values())) == len(words)
    assert common.hashed_words(pa.array([], pa.binary()))[0].size == 0
    assert len(common.hashed_words(pa.array(["one two", None, ""], pa.string()))[0]) == 2


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- shared ----------------------------------------------------------------------------------


def test_id_filter_lets_every_member_through(spark):
    ids = spark.range(0, 5000, 7)
    f = common.IdFilter.build(ids)
    assert f.tight and f.maybe(np.arange(0, 5000, 7)).all() and f.maybe(np.arange(10**6, 10**6 + 5000)).mean() < 0.05


def test_components_of_chain_star_and_loop(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 100 for k in range(100, 140)) and got[202] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 quality -------------------------------------------------------------------------------


def quality_data(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "and", "slept"], 30)) + "." for _ in range(60)]
    bad = [" ".join(w + "!!" for w in rng.choice(["BUY", "NOW", "WIN", "CASH", "FREE"], 30)) for _ in range(60)]
    texts = good + bad + [None, ""]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (3, None), (5, 7)], "doc_id long, quality int")
    return docs, labels


def test_quality_separates_held_out_documents(spark):
    docs, labels = quality_data(spark)
    got = by_id(quality.scored(docs, labels))
    assert len(got) == 122 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [r for i, r in got.items() if r["held_out"] and i < 120]
    assert np.mean([r["predicted"] == (r["doc_id"] < 60) for r in held]) >= 0.95
    again = by_id(quality.scored(docs.repartition(5), labels.repartition(2)))
    assert all(abs(again[i]["score"] - got[i]["score"]) < 1e-9 for i in got)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def plain_vectors(texts):
    """Context vectors token by token, and the buckets of each text."""
    index = quality.index_vectors()
    buckets = [[xxhash.xxh3_64_intdigest(t) & quality.BUCKETS - 1 for t in quality.TOKEN.findall(text or "")] for text in texts]
    total, n = np.zeros((quality.BUCKETS, quality.DIM)), np.zeros(quality.BUCKETS)
    for own in buckets:
        for i, b in enumerate(own):
            n[b] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(own), i + quality.WINDOW + 1)):
                if j != i:
                    total[b] += index[own[j]]
    total -= n[:, None] * (total.sum(axis=0) / max(1, n.sum()))
    size = np.linalg.norm(total, axis=1, keepdims=True)
    return np.divide(total, size, out=np.zeros_like(total), where=size > 0), buckets


def test_quality_equals_a_plain_computation(spark, monkeypatch):
    """Vectors, pooling, network and scores, text by text in plain Python; the contexts in small batches."""
    monkeypatch.setattr(quality, "HELD", 200)
    docs, labels = quality_data(spark)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    texts[7] = texts[7] * 300  # a very long one
    docs = spark.createDataFrame([(i, t, "mine", 1) for i, t in enumerate(texts)], "doc_id long, text string, quality string, x int")
    vectors, buckets = plain_vectors(texts)
    assert np.abs(quality.word_vectors(docs.repartition(4)) - vectors).max() < 1e-5
    rows = []
    for own in buckets:
        v = vectors[own] if own else np.zeros((0, quality.DIM))
        mean = v.mean(axis=0) if own else np.zeros(quality.DIM)
        rows.append(np.concatenate([mean, v.std(axis=0) if own else mean, np.abs(np.diff(v, axis=0)).sum(axis=0) / max(len(own) - 1, 1)]))
    features = np.array(rows)
    learned = [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 != 1]
    known = {r["doc_id"]: r["quality"] for r in labels.where("quality in (0, 1) and doc_id is not null").collect()}
    x, y = features[learned].astype(np.float32), np.array([float(known[i]) for i in learned])
    order = np.lexsort((*x[:, :2].T, learned))
    want = quality.Network(float(y.mean())).fit(x[order].astype(float), y[order]).probability(features)
    got = by_id(quality.scored(docs, labels))
    assert max(abs(got[i]["score"] - want[i]) for i in got) < 0.01


def test_quality_ignores_held_out_labels(spark):
    docs, labels = quality_data(spark)
    lies = labels.withColumn("quality", F.when(quality.remainder3(F.col("doc_id")) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = by_id(quality.scored(docs, labels)), by_id(quality.scored(docs, lies))
    assert all(a[i]["score"] == b[i]["score"] for i in a)


def test_quality_without_labels_or_rows(spark, empty):
    docs, labels = quality_data(spark)
    assert {r["score"] for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.scored(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.scored(empty, labels).count() == 0


# --- 2 mixing --------------------------------------------------------------------------------


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1.0 + k % 3 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return capped | target
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing_targets_and_copies(docs, rows):
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = water_fill(dict(sizes))
    got = mixing.with_targets(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["m_size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        rate = r["target"] / r["source_size"]
        assert math.floor(rate - 1e-12) <= r["m_copies"] <= min(3, math.ceil(rate + 1e-12))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["m_copies"] for r in got)


def test_mixing_comes_near_its_targets(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.when(F.col("id") % 3 < 1, 0).otherwise(F.col("id") % 7 + 1)).alias("source"))
    per = mixing.with_targets(rows).groupBy("source").agg(F.sum(F.col("m_size") * F.col("m_copies")).alias("taken"), F.first("target").alias("target"))
    assert all(abs(r["taken"] / r["target"] - 1) < 0.1 for r in per.collect())


def test_mixing_more_sources_than_are_broadcast(spark, docs, monkeypatch):
    """Whatever number of sources is broadcast, and with columns of the operator's own names."""
    clash = docs.withColumns({c: F.lit("mine") for c in ("m_source", "m_u", "m_rate", "m_shift", "m_size", "target", "t_source", "m_most")})
    want = sorted((r["doc_id"] or -1, r["m_size"], r["target"], r["m_copies"]) for r in mixing.with_targets(docs).collect())
    whole = mixing.mix(clash)
    for most in (0, 2):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
        assert sorted((r["doc_id"] or -1, r["m_size"], r["target"], r["m_copies"]) for r in mixing.with_targets(docs).collect()) == want
        mixed = mixing.mix(clash)
        assert mixed.columns == clash.columns and mixed.count() == whole.count() == sum(w[3] for w in want)


def test_mixing_a_very_long_text(spark):
    rows = [(1, "w " * 50_000, "a"), *((k, "b c", "b") for k in range(2, 40))]
    got = by_id(mixing.with_targets(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert got[1]["m_size"] == 50_000 and got[2]["target"] == 3 * 76 and {got[k]["m_copies"] for k in range(2, 40)} == {3}


def test_mixing_degenerate(spark, empty):
    assert mixing.with_targets(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert {r["m_copies"] for r in mixing.with_targets(blank).collect()} == {1}


# --- 3 fingerprints --------------------------------------------------------------------------


def test_fingerprints_follow_the_order_of_ids(docs, rows):
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = collections.Counter()
    for k, (i, text) in enumerate(order):
        half, after = len(text) // 2, order[(k + 1) % len(order)][1]
        want[i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    got = fingerprints.with_neighbour(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_equal_texts_have_equal_fingerprints(unique_docs, unique_rows):
    got = by_id(fingerprints.with_neighbour(unique_docs))
    prints = collections.defaultdict(set)
    for i, text, *_ in unique_rows:
        prints[text or ""].add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_likeness_estimates_the_generalised_jaccard():
    rng = np.random.default_rng(2)
    of = lambda words: common.hashed_words(pa.array([b" ".join(words)]))[0]
    for _ in range(5):
        a = [str(w).encode() for w in rng.integers(0, 60, 300)]
        b = a[:150] + [str(w).encode() for w in rng.integers(0, 60, 150)]
        pairs = [collections.Counter(zip(t, t[1:], strict=False)) for t in (a, b)]
        keys = pairs[0] | pairs[1]
        true = sum((pairs[0] & pairs[1]).values()) / sum(keys.values())
        got = fingerprints.likeness(fingerprints.signature(of(a)), fingerprints.signature(of(b)))
        assert abs(got - true) < 0.17
    assert fingerprints.likeness(None, None) == 1.0 and fingerprints.likeness(None, fingerprints.signature(of([b"x"]))) == 0.0


def test_fingerprints_whichever_buckets_and_clashing_columns(spark, docs):
    """The same rows from one bucket as from many, with other columns of the operator's names."""
    clash = docs.withColumns({c: F.lit("mine") for c in ("bucket", "head", "first_id", "before", "n_chars", "f")})
    was = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "7", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(str, fingerprints.with_neighbour(clash).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert found[0] == found[1] == found[2]


def test_fingerprints_of_very_long_texts(spark):
    rng = np.random.default_rng(1)
    long = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40_000)) for _ in range(2)]
    got = by_id(fingerprints.with_neighbour(spark.createDataFrame([(0, long[0]), (1, long[0]), (2, long[1])], "doc_id long, text string")))
    assert got[0]["near_next"] == 1.0 and got[1]["near_next"] < 0.03 and 0.2 < got[1]["near_edited"] < 0.5


def test_fingerprints_one_row_and_none(spark, empty):
    one = spark.createDataFrame([(4, "abcdef", "x")], "doc_id long, text string, fingerprint string")
    r = fingerprints.with_neighbour(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and r["near_next"] == 1.0
    assert fingerprints.with_neighbour(empty).count() == 0


# --- 4 line dedup ----------------------------------------------------------------------------


def strip_key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize(("batches", "fanout", "hot_rows"), [(1, 4, 1000), (3, 2, 0), (5, 2, 1000)])
def test_line_dedup_equals_brute_force(unique_docs, unique_rows, batches, fanout, hot_rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot_rows)
    holders = collections.defaultdict(set)
    for i, text, *_ in unique_rows:
        for line in (text or "").split("\n"):
            holders[strip_key(line)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    got = by_id(line_dedup.dedup(unique_docs, batches=batches, fanout=fanout))
    assert gone and len(got) == len(unique_rows)
    for i, text, *_ in unique_rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(strip_key(x), i) == i]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))


def test_line_dedup_counts_documents_not_rows(spark):
    """Repeated rows and shared ids are one document, rows without an id none; those lose the line
    once enough documents hold it."""
    line, other = "a line that is long enough to be looked at, of ten words or so", "another line that is long enough, which only four documents hold"
    few = [(1, line)] * 4 + [(2, line)] + [(None, line)] * 3
    made = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("tag", "h1", "g", "n_docs", "max_doc")})
    assert {r["n_dropped"] for r in line_dedup.dedup(made(few)).collect()} == {0}
    many = few + [(k, line + "\nown") for k in (3, 4, 5)] + [(5, "with the last\n" + line.upper() + "  ")] + [(k, other) for k in (6, 7, 8, 9)] + [(10, None)]
    got = sorted((r["doc_id"] or -1, r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup(made(many).repartition(3)).collect())
    want = [(-1, 1, 1, "")] * 3 + [(1, 1, 1, "")] * 4 + [(2, 1, 1, ""), (3, 2, 1, "own"), (4, 2, 1, "own"), (5, 2, 0, line + "\nown"), (5, 2, 0, "with the last\n" + line.upper() + "  ")]
    assert got == want + [(k, 1, 0, other) for k in (6, 7, 8, 9)] + [(10, 1, 0, "")]


def test_line_dedup_very_long_text(spark):
    line = "the same line of more than forty code points, again and again"
    long = "\n".join([line if k % 2 else f"{line} {k}" for k in range(20_000)])
    rows = [(1, long), *((k, line) for k in (2, 3, 4, 5))]
    got = by_id(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1]["n_lines"] == 20_000 and got[1]["n_dropped"] == 10_000 and got[5]["n_dropped"] == 0


def test_line_dedup_comes_through_compacted_runs(unique_docs):
    """With its own batches and fan-out the index has a run of level 1, and a line is new once."""
    index, lines = line_dedup.LineIndex(), line_dedup.line_hashes(unique_docs)
    often = line_dedup.often_held(lines, index).df
    assert len(index.levels) == 2 and len(index.levels[1]) == 1 and len(index.levels[0]) == line_dedup.BATCHES - line_dedup.FANOUT
    merged = {(r["h1"], r["h2"]): (r["n_docs"], r["max_doc"]) for r in index.merged().collect()}
    assert {(r["h1"], r["h2"]): (r["n_docs"], r["max_doc"]) for r in often.collect()} == {k: v for k, v in merged.items() if v[0] >= line_dedup.MIN_DOCS} != {}


def test_line_dedup_rows_with_shared_or_no_ids(docs, rows, empty):
    assert line_dedup.dedup(docs).count() == len(rows) and line_dedup.dedup(empty).count() == 0


def test_line_index_finds_new_lines(spark, unique_docs):
    index = line_dedup.LineIndex(2)
    lines = line_dedup.line_hashes(unique_docs)
    parts = [lines.where(f"doc_id % 3 = {k}") for k in range(3)]
    for p in parts[:2]:
        index.add(p)
    known = {tuple(r) for p in parts[:2] for r in p.select("h1", "h2").collect()}
    want = {tuple(r) for r in parts[2].select("h1", "h2").collect()} - known
    assert {tuple(r) for r in index.new_lines(parts[2]).select("h1", "h2").collect()} == want
    assert len(index.levels) == 2 and not index.levels[0] and len(index.runs()) == 1


# --- 5 sharding ------------------------------------------------------------------------------


def test_sharding_is_even_and_gapless(spark, docs, rows):
    got = sharding.shard_rows(sharding.sized_rows(docs)).collect()
    assert len(got) == len(rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 7919 % 97).cast("int")).alias("text"))
    load = [r["b"] for r in sharding.shard_rows(sharding.sized_rows(many)).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 16 and max(load) < 1.01 * min(load)


def test_slot_map_rebalances_by_moving_little(spark, tmp_path):
    loads = spark.range(512).select(F.col("id").cast("int").alias("v_slot"), (F.col("id") * 31 % 100 + 1).alias("bytes"))
    store = sharding.SlotMap(spark, f"file://{tmp_path}/map")
    store.write(sharding.place(loads, 4), 1)
    store.rebalance(loads, 1, 5)
    both = store.read(1).withColumnRenamed("shard", "was").join(store.read(2), "v_slot").join(loads, "v_slot").collect()
    assert all(r["shard"] in (r["was"], 4) for r in both) 
    moved = sum(r["bytes"] for r in both if r["shard"] != r["was"]) / sum(r["bytes"] for r in both)
    assert 0.15 < moved < 0.25
    total = collections.Counter()
    for r in both:
        total[r["shard"]] += r["bytes"]
    assert max(total.values()) < 1.06 * min(total.values())
    store.rebalance(loads, 2, 3)
    assert {r["shard"] for r in store.read(3).collect()} == {0, 1, 2}


def test_sharding_equals_a_plain_placement(spark, docs):
    """Shards and slots recomputed in plain Python from the virtual slots' bytes."""
    got = sharding.shard_rows(sharding.sized_rows(docs)).collect()
    loads, load, shard = collections.Counter(), [0] * 16, {}
    for r in got:
        loads[r["v_slot"]] += r["size"]
    for v, size in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        shard[v] = load.index(min(load))
        load[shard[v]] += size
    assert all(shard[r["v_slot"]] == r["shard"] for r in got)
    rows = sorted(got, key=lambda r: (r["shard"], r["v_slot"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
    at = collections.Counter()
    want = []
    for r in rows:
        want.append((r["shard"], at[r["shard"]]))
        at[r["shard"]] += 1
    key = lambda r: (r["v_slot"], r["doc_id"], r["text_crc32"], r["size"])
    places, wanted = collections.defaultdict(list), collections.defaultdict(list)
    for r, w in zip(rows, want, strict=True):
        places[key(r)].append((r["shard"], r["slot"]))
        wanted[key(r)].append(w)
    assert all(sorted(places[k]) == sorted(wanted[k]) for k in wanted)


def test_sharding_keeps_to_the_versions_of_a_map(spark, tmp_path):
    """A rerun reads the version there is; after growth only few slots move, in the next version."""
    made = lambda n: spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 7919 % 97).cast("int")).alias("text"))
    store = sharding.SlotMap(spark, f"file://{tmp_path}/map")
    shards = lambda n: {r["doc_id"]: r["shard"] for r in sharding.shard_rows(sharding.sized_rows(made(n)), store=store).select("doc_id", "shard").collect()}
    first = shards(30_000)
    assert store.latest() == 1 and store.read(1).count() == sharding.SLOTS
    assert shards(30_000) == first and store.latest() == 1
    grown = shards(33_000)
    moved = sum(grown[k] != first[k] for k in first) / len(first)
    assert store.latest() == 2 and 0 < moved < 0.1
    assert {r["doc_id"]: r["shard"] for r in sharding.shard_documents(made(33_000), store=store).collect()} == grown and store.latest() == 2


def test_sharding_identical_rows(spark):
    many = spark.range(3000).select(F.when(F.col("id") >= 1000, F.col("id")).alias("doc_id"), F.lit("one text").alias("text"))
    got = sharding.shard_rows(sharding.sized_rows(many)).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 3000 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding_keeps_columns_and_empty_tables(docs, rows, empty):
    out = sharding.shard_documents(docs.withColumn("shard", F.lit("clash")))
    assert out.columns == [*docs.columns, "shard", "virtual_slot"] and out.count() == len(rows)
    assert sharding.shard_documents(empty).count() == 0 and sharding.shard_rows(sharding.sized_rows(empty)).count() == 0


# --- 6 URL filters ---------------------------------------------------------------------------

URLS = [
    "http://A.Example.NET/en/1?x", "https://a.example.net/de/1", "http://net/", "http://net", "http://xnet/", "ftp://b.example.com/de/9#t", "http://example.com/dex/",
    "http://q.org/fr/1", "http://q.org/fr", None, "", "no scheme/net/", "http://", "x://y.net?u=http://z.org/fr/", "http://b.casino.com/p/1/2/3/4/5/6", "http://h.com//a//b/", "http://b.casino.com/p/77",
    "http://ÄB.net/en/", "a://b://c.net/",
]


def judge(url):
    rules = sorted(url_filters.RULES, key=lambda r: -len(r[0]))
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    for rule, says in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            return host, path, rule, says
    return host, path, None, None


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = by_id(url_filters.judged(pages), "page_id")
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule, says = judge(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == says if says else got[i]["verdict"] in ("allow", "block")


def judged_urls(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("mine") for c in ("host", "segs", "node", "says", "n")})
    return sorted(url_filters.judged(pages.repartition(3)).collect(), key=lambda r: r["page_id"])


def test_url_templates_are_rejected_on_hosts_without_a_rule(spark):
    """The rules label net hosts only; other hosts are judged by the templates they share."""
    urls = [f"http://h{k % 5}.net/offer/{k}.html" for k in range(40)] + [f"http://h{k % 5}.example.net/en/{k}" for k in range(60)]
    asked = ["http://shop.io/offer/7.html", "http://shop.io/offer/8.html", "http://shop.io/en/3", "http://shop.io/other/3", "http://shop.io/"]
    got = judged_urls(spark, urls + asked)
    assert [r["verdict"] for r in got[-5:]] == ["block", "block", "allow", "allow", "allow"] and all(r["rule"] is None for r in got[-5:])
    assert {r["verdict"] for r in got[:40]} == {"block"} and {r["verdict"] for r in got[40:100]} == {"allow"}
    assert got[-5]["template"] == "/offer/{n}.html"


def test_url_wildcards_merging_up_the_tree_and_deep_paths(spark):
    slug = [f"http://slug.net/a/word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    deep = "/".join(f"x{chr(97 + k % 26)}" for k in range(300))
    got = judged_urls(spark, [*slug, f"http://deep.net/{deep}", f"http://deep.io/{deep}/"])
    assert {r["template"] for r in got[:60]} == {"/a/*"}
    assert got[60]["template"] == got[61]["template"] == "/" + deep and {r["verdict"] for r in got} == {"block"}
    rows = [("h", ["a", "x"], 50, 40), ("h", ["a", "y"], 50, 41), ("h", ["b", "x"], 50, 39), ("h", ["c", "z"], 50, 0), ("h", ["d"], 0, 0), ("h", [], 0, 0)]
    nodes = spark.createDataFrame(rows, "host string, node array<string>, n long, blocked long")
    branch = {tuple(r["node"]): r["branch"] for r in url_filters.merged(nodes, 2).df.collect()}
    assert branch["a", "x"] == branch["a", "y"] and branch["a", "x"][1] == "~" and branch["c", "z"] == ["c", "z"] and branch["d",] == ["d"] and branch[()] == []
    alike = spark.createDataFrame([("h", [a, b], 50, 40 + k) for k, (a, b) in enumerate([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")])], nodes.schema)
    assert {tuple(r["branch"]) for r in url_filters.merged(alike, 2).df.collect()} == {("~", "~")}


def test_url_filters_equal_their_sql(spark):
    """On URLs deeper, wider and odder than the tables'."""
    rng = np.random.default_rng(5)
    hosts = ["a.net", "b.net", "c.example.net", "d.example.com", "e.org", "f.io", "g.io"]
    urls = [*URLS, *(f"http://{hosts[rng.integers(7)]}/" + "/".join(f"{'abc'[rng.integers(3)]}{rng.integers(60) if d == 1 else ''}" for d in range(rng.integers(0, 12))) for _ in range(900))]
    urls += [f"http://{hosts[rng.integers(7)]}/{'en de fr'.split()[rng.integers(3)]}/k{chr(97 + rng.integers(26))}{chr(97 + rng.integers(26))}" for _ in range(600)]
    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls})
    con = duckdb.connect()
    con.register("pages", pages)
    want = con.execute(url_filters.oracle()).fetchall()
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["template"]) for r in judged_urls(spark, urls)]
    assert got == sorted(want) and {r[4] for r in want if r[3] is None} == {"allow", "block"}


def test_url_filters_empty(spark):
    assert url_filters.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


# --- 7 near-duplicates -----------------------------------------------------------------------


def brute_components(rows, words, least):
    sets = {}
    for i, text, *_ in rows:
        w = [m.translate({c: c + 32 for c in range(65, 91)}) for m in WORD.findall(text or "")]
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("words", "least"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(unique_docs, unique_rows, words, least):
    want = brute_components(unique_rows, words, least)
    got = by_id(near_dup.near_duplicates(unique_docs, words, least))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_with_clashing_columns_and_a_very_long_text(spark):
    long = " ".join(f"w{k * 7919 % 30_000}" for k in range(30_000))
    rows = [(1, long), (2, long + " end"), (3, "w1 w2 w3 w4 w5"), (4, None), (5, long.replace("w77 ", "x "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("n_shingles", "s1", "bands", "node", "comp", "kept", "a", "n_id", "n_row")})
    got = by_id(near_dup.near_duplicates(docs))
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}
    left = near_dup.distinct_documents(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {1, 3, 4}


def test_near_duplicates_with_hot_pivots(spark, unique_docs, unique_rows, monkeypatch):
    """Whether hot pivots are broadcast, salted or neither, the links are the same."""
    want = brute_components(unique_rows, 3, 85)
    for most, keys in ((1, 100_000), (1, 0), (10**6, 100_000)):
        monkeypatch.setattr(near_dup, "PER_TASK", most)
        monkeypatch.setattr(common, "BROADCAST_KEYS", keys)
        got = by_id(near_dup.near_duplicates(unique_docs, 3, 85))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want


def test_near_copies_without_a_hub(spark):
    """A chain in which only neighbours are linked, and many copies of a base with edits of
    their own, which only the base links."""
    rng = np.random.default_rng(4)
    text = [f"w{k}" for k in range(150)]
    rows = []
    for step in range(12):
        rows.append((len(rows), " ".join(text), "", "", 0))
        text = text.copy()
        text[(step * 11) % 150] = f"c{step}"
        text[(step * 11 + 60) % 150] = f"d{step}"
    base = [f"b{k}" for k in range(150)]
    for k in range(60):
        own = base.copy()
        for at in rng.choice(150, int(k % 6) + 2, replace=False):
            own[at] = f"e{k}x{at}"
        rows.append((len(rows), " ".join(own), "", "", 0))
    rows.append((len(rows), " ".join(base), "", "", 0))
    want = brute_components(rows, 3, 85)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, 3, 85).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


def test_superminhash_estimates_jaccard_and_is_complete():
    rng = np.random.default_rng(0)
    common_part = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    a = np.unique(np.concatenate([common_part, rng.integers(0, 1 << 62, 100).astype(np.uint64)]))
    b = np.unique(np.concatenate([common_part, rng.integers(0, 1 << 62, 100).astype(np.uint64)]))
    sig = near_dup.superminhash([a, b, a[:1], a], 256)
    assert np.isfinite(sig).all() and (sig[0] == sig[3]).all() and abs((sig[0] == sig[1]).mean() - 0.6) < 0.12
    assert sorted(np.floor(sig[2]).astype(int)) == list(range(256))


def test_distinct_documents(docs, rows, empty):
    left = near_dup.distinct_documents(docs.withColumn("n_id", F.lit(1)))
    assert left.columns == [*docs.columns, "n_id"]
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert len(kept) == len(set(kept)) and kept.count((5, rows[5][1])) == 1
    assert {(r[0], r[1]) for r in rows if r[1] and not WORD.findall(r[1])} <= set(kept)
    assert near_dup.near_duplicates(docs).count() == len(rows) and near_dup.distinct_documents(empty).count() == 0


# --- 8 substring dedup -----------------------------------------------------------------------


def brute_windows(rows):
    first, words = {}, {i: WORD.findall(t or "") for i, t, *_ in rows}
    for i, w in words.items():
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def test_substring_dedup_equals_brute_force(unique_docs, unique_rows):
    got = by_id(substring_dedup.dedup(unique_docs))
    want = brute_windows(unique_rows)
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == want and sum(w[1] for w in want.values()) > 500


@pytest.mark.parametrize("homes", [1, 8, 200])
def test_substring_dedup_whatever_the_homes(spark, monkeypatch, docs, rows, homes):
    """Rows with repeated ids, null ids and null texts too."""
    monkeypatch.setattr(common, "HOMES", homes)
    monkeypatch.setattr(common, "HOME_BYTES", 100)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup(docs).collect()]
    first, words = {}, [(1 << 62 if r[0] is None else r[0], WORD.findall(r[1] or "")) for r in rows]
    for i, w in words:
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    want = []
    for r, (i, w) in zip(rows, words, strict=True):
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        want.append((r[0], len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    assert sorted(got, key=key) == sorted(want, key=key) and sum(w[2] for w in want) > 500


def test_substring_dedup_very_long_text_and_hot_passage(spark):
    rng = np.random.default_rng(3)
    long = " ".join(f"w{k}" for k in rng.integers(0, 10**6, 20_000))
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [long, "a b " + long] + [f"own{k} " + passage for k in range(60)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("doc", "part", "home", "n", "blob", "tag")})
    got = by_id(substring_dedup.dedup(made.repartition(5)))
    assert got[0]["n_removed"] == 0 and got[1]["kept"] == "a b" and got[1]["n_words"] == 20_002
    assert got[2]["n_removed"] == 0 and all(got[k]["kept"] == f"own{k - 2}" for k in range(3, 62))


def test_substring_dedup_other_rows(docs, rows, empty):
    assert substring_dedup.dedup(docs).count() == len(rows) and substring_dedup.dedup(empty).count() == 0


def test_sketch_never_underestimates(unique_rows):
    """Nor does it let many unique windows through, at a cell a byte; each text its own home."""
    texts = [(r[1] or "").encode() for r in unique_rows]
    parts, size = 3, sum(map(len, texts))
    homes = [np.unique(substring_dedup.windows(pa.array([t]))[0], return_counts=True) for t in texts]
    counts = [np.zeros(substring_dedup.DEPTH * (size // (parts * substring_dedup.DEPTH)), np.uint8) for _ in range(parts)]
    for w, n in homes:
        part, prints = substring_dedup.parts_and_prints(w, parts)
        for p in range(parts):
            own = prints[part == p]
            back, twice = common.unpack_sorted(common.pack_sorted(own, n[part == p] > 1), len(own))
            assert (back == own).all() and (twice == (n[part == p] > 1)).all()
            substring_dedup.count(counts[p], back, twice)
    w, v, _, _ = substring_dedup.windows(pa.array(texts))
    value, n = np.unique(w, return_counts=True)
    part, prints = substring_dedup.parts_and_prints(value, parts)
    assert (np.diff(part) >= 0).all() and all((np.diff(prints[part == p].astype(np.int64)) >= 0).all() for p in range(parts))
    ok = np.zeros(len(value), bool)
    for p in range(parts):
        ok[part == p] = substring_dedup.repeated(counts[p], prints[part == p])
    assert ok[n > 1].all() and (n > 1).any() and ok[n == 1].mean() < 0.2
    assert len({*zip(w.tolist(), v.tolist(), strict=True)}) == len(value)
    assert len({tuple(x.split()[k : k + 13]) for x in texts for k in range(len(x.split()) - 12)}) == len(value)


def test_substring_dedup_shuffles_the_texts_once(docs):
    """The texts' exchange is made once and reused by the other passes; nothing is broadcast."""
    df = substring_dedup.dedup(docs)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 2 and plan.count("monotonically_increasing_id()") == 1 and "Broadcast" not in plan


# --- 9 language model ------------------------------------------------------------------------


@pytest.mark.parametrize("most", [1 << 20, 30, 0])
def test_lm_base_scores_are_exact(docs, rows, most):
    count, text_tokens = collections.Counter(), []
    for i, text, *_ in rows:
        t = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")] + ["\n"]
        held = i is not None and zlib.crc32(str(i).encode()) % 10 == 0
        text_tokens.append((i, held, t))
        if not held:
            count.update(t)
    total = sum(count.values())
    z = total + 0.1 * (len(count) + 1)
    want = sorted((-1 if i is None else i, held, len(t), sum(count[w] > 0 for w in t), round(sum(math.log10((count[w] + 0.1) / z) for w in t), 6)) for i, held, t in text_tokens)
    got = lm_scoring.scored(docs, most=most, vocabulary=16).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] <= 1e-9 and r["train_tokens"] == total for r in got)


def test_log_frequency_filter_counts_are_never_low(spark):
    g = np.arange(1, 3000, dtype=np.int64)
    grams = (g * 37).view(np.uint64)
    f = lm_scoring.LogFrequencyFilter(lm_scoring.filled(grams, g % 9 + 1))
    q = f.quantised(grams)
    assert (q >= g % 9 + 1).all() and (q == g % 9 + 1).mean() > 0.97
    assert (f.quantised((g * 37 + 1).view(np.uint64)) == 0).mean() > 0.97


def test_lm_empty(empty, spark):
    assert lm_scoring.scored(empty).count() == 0
    held = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)
    r = lm_scoring.scored(spark.createDataFrame([(held, "never seen")], "doc_id long, text string")).first()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"]) == (0, 0, 3)


# --- 10 decontamination ----------------------------------------------------------------------


def edit_distance_inside(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, d in enumerate(t):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_banded_alignment_equals_full(spark):
    rng = np.random.default_rng(6)
    for _ in range(60):
        p = "".join(rng.choice(list("abc"), 20))
        own = list(p)
        for _ in range(int(rng.integers(0, 5))):
            at, kind = int(rng.integers(0, len(own))), int(rng.integers(0, 3))
            own[at : at + (kind != 0)] = ["x"] if kind != 1 else []
        lead = int(rng.integers(0, 9))
        t = "z" * lead + "".join(own) + "z" * 7
        got = decontaminate.banded_edits(decontaminate.characters(p), decontaminate.characters(t), -30, 60, 6)
        true = edit_distance_inside(p, t)
        assert (got[0] if got else 7) == min(true, 7)
        near = decontaminate.banded_edits(decontaminate.characters(p), decontaminate.characters(t), lead - 6, lead + 6, 6)
        assert near and near[0] == true


def test_leaks_are_found_and_others_left(spark, docs, rows, empty):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9))))
    items = [" ".join(word() for _ in range(n)) for n in (12, 30, 60)]
    edited = items[1].split()
    edited[5] = edited[5][:-1] + "x"
    leaks = ["lead " + items[0].upper() + " tail", "a  b\n" + " ".join(edited), items[2][40:240], items[0].replace(" ", "\n ")]
    clean = [items[0][:30] + " " + items[1][-30:], " ".join(items[0].split()[::-1]), None, ""]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(leaks + clean)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([*enumerate(items), (7, None), (8, "too few words here"), (9, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(d, b).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 0)}
    left = decontaminate.clean(d, b)
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {4, 5, 6, 7}
    assert decontaminate.clean(docs, b).count() == len(rows) and decontaminate.clean(docs, b.limit(0)).count() == len(rows) and decontaminate.matches(empty, b).count() == 0


def test_blocks_of_items_cover_all(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    items = spark.createDataFrame([(k, f"item number {k} has a text of its own with words {k * 7919}") for k in range(20)], "item_id long, text string")
    parts = [x.value for x in decontaminate.blocks(items)]
    assert len(parts) > 3 and sorted(x.id for p in parts for x in p.items) == list(range(20))
    docs = spark.createDataFrame([(k, f"so item number {k} has a text of its own with words {k * 7919} ok") for k in range(20)], "doc_id long, text string")
    exact = {r["doc_id"] for r in decontaminate.matches(docs, items).where("edits = 0 and doc_id = item_id").collect()}
    assert exact == set(range(20))


def leaky_texts(rng, items, n):
    """Texts with pieces of items of various lengths, some edited."""
    out = []
    for _ in range(n):
        own = list(items[int(rng.integers(len(items)))])
        size = int(rng.integers(30, 70))
        at = int(rng.integers(0, max(1, len(own) - size)))
        own = own[at : at + size]
        for _ in range(int(rng.integers(0, 5))):
            k, kind = int(rng.integers(0, len(own))), int(rng.integers(0, 3))
            own[k : k + (kind != 0)] = ["é"] if kind != 1 else []
        out.append("vor " + "".join(own) + " nach " + "".join(rng.choice(list("abc "), 20)))
    return out


@pytest.mark.parametrize("letters", ["abcdefgh ", "дежзийкл ", "漢字仮名交文章表現語"])
def test_matches_equal_brute_force(spark, letters, monkeypatch):
    """Every (text, item) pair, by the full alignment of every segment, in blocks of items too."""
    rng = np.random.default_rng(len(letters))
    items = [decontaminate.normal("".join(rng.choice(list(letters), n))) for n in (90, 75, 48, 20, 9)]
    texts = [decontaminate.normal(t) for t in leaky_texts(rng, items[:3], 22)] + ["x " + items[3] + " y", items[4], items[3][:15], ""]
    want = set()
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            x = decontaminate.Item(j, item)
            if any(edit_distance_inside(item[s : s + x.length], t) <= x.edits for s in x.starts.tolist()):
                want.add((i, j))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("item_id", "edits")})
    b = spark.createDataFrame([*enumerate(items), (7, letters[:5])], "item_id long, text string").withColumn("doc_id", F.lit(3))
    for size in (4 << 20, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = [(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, b).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert 8 < len(want) < 100 and {i for i, _ in want} != set(range(len(texts)))


def test_every_run_of_51_characters_is_found(spark):
    rng = np.random.default_rng(1)
    item = "".join(rng.choice(list("abcdefghijklmnop "), 200))
    index = decontaminate.ItemIndex([(1, item.encode())])
    text = decontaminate.normal(item)
    assert all(index.matches(f"zz {text[k : k + 51]} zz") for k in range(len(text) - 51) if " " not in (text[k], text[k + 50]))


def test_a_leak_deep_in_a_very_long_text(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    item = " ".join(word() for _ in range(13))
    long = " ".join(word() for _ in range(20_000)) + " " + item + " end"
    index = decontaminate.ItemIndex([(1, item.encode()), (None, b"a null id is an item too, which is looked for")])
    assert [m[0] for m in index.matches(long.encode())] == [1] and index.matches(long[: -len(item) - 5].encode()) == []


def test_budget_keeps_the_bound_positive():
    for length in range(8, 400):
        e, least = decontaminate.budget(length)
        assert least >= 1 and e <= decontaminate.RATE * length and (e == 0 or length + 1 - decontaminate.Q * (e + 1) >= 1)
