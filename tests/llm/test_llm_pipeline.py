"""The corpus pipeline on the smallest tables, and the queries against their oracles."""

import collections
import math

import duckdb
import pytest
from test_llm_operators import brute_components, edit_distance_inside, water_fill

import corpus_pipeline
from tessella.llm import decontaminate, quality, registry

SF = "/root/testdata/sf0.001"


def test_stages_are_in_order():
    names = [f.__name__ for _, f in corpus_pipeline.STAGES]
    assert names == ["keep_quality", "drop_near_duplicates", "drop_leaks", "mix_sources", "shard"]


def test_pipeline_runs_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns
        if k < 3:
            assert 0 < now.count() < docs.count() or k == 2
            assert now.join(docs, "doc_id", "left_anti").isEmpty()
        docs = now
    assert {"shard", "virtual_slot"} <= set(docs.columns) and docs.count() > 0


def test_pipeline_equals_its_stages_in_plain_python(spark, tmp_path):
    """run() against the classifier's scores, brute-force components and alignments, water-filled
    targets and a plain placement, each on what the stage before it kept."""
    picked = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 700").orderBy("doc_id").limit(70)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(6)
    rows = [tuple(r) for r in picked.collect()]
    names, item_rows = picked.columns, [tuple(r) for r in items.collect()]
    at = {c: k for k, c in enumerate(names)}
    for k, i in enumerate((3, 11, 20)):  # leaks, whole and with an edit, and near copies
        text = item_rows[k][1]
        rows[i] = tuple(("start of it " + (text if k else text.replace("a", "o", 1))) if c == "text" else v for c, v in zip(names, rows[i], strict=True))
    top = max(r[at["doc_id"]] for r in rows)
    rows += [tuple({"doc_id": top + 1 + k, "text": (rows[k][at["text"]] or "") + " more"}.get(c, v) for c, v in zip(names, rows[k], strict=True)) for k in range(30, 36)]
    spark.createDataFrame(rows, picked.schema).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in quality.scored(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    left = [r for r in rows if scores[r[at["doc_id"]]] >= 0.5]
    groups = brute_components([(r[at["doc_id"]], r[at["text"]]) for r in left], 5, 80)
    left = [r for r in left if groups[r[at["doc_id"]]][1] == r[at["doc_id"]]]

    def leaks(text):
        own = decontaminate.normal(text)
        made = [decontaminate.Item(i, decontaminate.normal(t)) for i, t in item_rows]
        # an alignment within the budget keeps some quarter of the segment whole
        near = ((x, s) for x in made for s in x.starts.tolist() if any(x.text[s + q : s + q + x.length // 4] in own for q in range(0, x.length, x.length // 4)))
        return any(edit_distance_inside(x.text[s : s + x.length], own) <= x.edits for x, s in near)

    left = [r for r in left if not leaks(r[at["text"]])]
    sizes = collections.Counter()
    for r in left:
        sizes[r[at["source"]]] += len((r[at["text"]] or "").encode().split())
    target = water_fill(dict(sizes))
    got = collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert 0 < len(left) < len(rows) and set(got) <= {r[at["doc_id"]] for r in left}
    for r in left:
        rate = target[r[at["source"]]] / sizes[r[at["source"]]] if sizes[r[at["source"]]] else 1.0
        assert math.floor(rate - 1e-9) <= got[r[at["doc_id"]]] <= math.ceil(rate + 1e-9)
    placed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in placed) == got and {r["shard"] for r in placed} <= set(range(16))
    assert len({(r["virtual_slot"], r["shard"]) for r in placed}) == len({r["virtual_slot"] for r in placed})


def test_pipeline_with_empty_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda r: tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r)
    got = sorted(key(r) for r in df.select(*columns).collect())
    result = c.execute(registry.oracle_sql()[name])
    order = [d[0] for d in result.description]
    assert got == sorted(key(r[order.index(k)] for k in columns) for r in result.fetchall())


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)]
