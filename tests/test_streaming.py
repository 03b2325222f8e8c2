from pyspark.sql import functions as F

from lodestrata.operators import merge
from lodestrata.sources.store import Store
from lodestrata.streaming import audit


def test_rates_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = [(True, f"m{i % 3}", f"2026-01-01T0{i % 4}:10:00Z", "upsert") for i in range(20)] + [(False, "m", "later", "upsert")]
    spark.createDataFrame(rows, audit.EVENTS).coalesce(1).write.json(str(tmp_path / "log"))
    query = audit.rates(audit.read_log(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.start, r.events) for r in spark.table("rates").where("start is not null").collect()}
    batch = spark.createDataFrame(rows, audit.EVENTS).withColumn("at", F.try_to_timestamp("timestamp"))
    assert got == {(r.start, r.events) for r in audit.rates(batch).where("start is not null").collect()} and len(got) == 4


def test_continuous_merge(spark, tmp_path):
    schema = "id string, text string, created_at string"
    store = Store(spark, str(tmp_path / "store"))
    store.commit(store.head(), {"rows": spark.createDataFrame([("a", "old", "t0")], schema)})
    spark.createDataFrame([("a", "new", "t1"), ("b", "new", "t1")], schema).coalesce(1).write.json(str(tmp_path / "in"))

    def go(checkpoint="cp"):
        query = audit.merge_each(spark.readStream.schema(schema).json(str(tmp_path / "in")), store.root, str(tmp_path / checkpoint), "rows").start()
        query.processAllAvailable()
        query.stop()

    go()
    assert {tuple(r) for r in store.table("rows").rows().collect()} == {("a", "new", "t0"), ("b", "new", "t1")} and store.head().version == 2
    for x in (tmp_path / "cp" / "commits").iterdir():  # as if the stream had failed after the store's commit and before its own
        x.unlink()
    go()
    assert store.head().version == 2


def test_continuous_merge_into_an_empty_store(spark, tmp_path):
    schema = "id string, text string, created_at string"
    spark.createDataFrame([("a", "new", "t1")], schema).coalesce(1).write.json(str(tmp_path / "in"))
    query = audit.merge_each(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp"), "rows").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in Store(spark, str(tmp_path / "store")).table("rows").rows().collect()] == [("a", "new", "t1")]


def test_log_of_a_plan(spark):
    """Each upsert that a plan stands for is an event; the first one of a new key is its creation."""
    plan = spark.createDataFrame([("a", True, 3), ("b", False, 1)], "id string, created boolean, writes long")
    assert sorted(map(tuple, merge.events(plan, "now").collect())) == [(False, "a", "now", "upsert")] * 2 + [(False, "b", "now", "upsert"), (True, "a", "now", "upsert")]
