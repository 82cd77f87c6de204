"""The driver's heap between the tables that an operator writes on its way."""

from tessella.llm import common


def test_a_written_table_asks_for_a_collection_when_the_driver_heap_grew(spark, monkeypatch):
    jvm, asked = spark.sparkContext._jvm, []
    heap = jvm.java.lang.Runtime.getRuntime()
    monkeypatch.setattr(common, "tidy", asked.append)
    tables, size, held = [common.Stash(spark.range(3).toDF("a"), "before")], 32 << 20, []
    asked.clear()
    least = heap.totalMemory()
    while heap.totalMemory() - least <= heap.maxMemory() // 8:  # held, so that nothing shrinks meanwhile
        held.append(jvm.java.nio.ByteBuffer.allocate(size))
    tables.append(common.Stash(spark.range(3).toDF("a"), "after"))
    for buffer in held:
        spark.sparkContext._gateway.detach(buffer)
    assert asked == [spark]
    assert sorted(r["a"] for r in tables[1].df.collect()) == [0, 1, 2]
    for t in tables:
        t.drop()


def test_a_heap_that_did_not_grow_is_left_alone(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(common, "tidy", asked.append)
    monkeypatch.setattr(common.DriverHeap, "SHARE", 1)  # a heap cannot grow by its limit
    common.Stash(spark.range(3).toDF("a"), "one").drop()
    common.Stash(spark.range(3).toDF("a"), "two").drop()
    assert asked == []
