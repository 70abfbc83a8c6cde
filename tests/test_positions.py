"""Positions where many rows share a key."""

from pyspark.sql import functions as F

from adherence.operators import batching


def test_equal_keys_spread_over_blocks(spark, monkeypatch):
    """A third of the rows without a key: no block is more than a few times the others."""
    seen = {}
    real = batching.written

    def spy(rows, label):
        out = real(rows, label)
        seen["blocks"] = [r["count"] for r in out.groupBy("_block").count().collect()]
        return out

    monkeypatch.setattr(batching, "written", spy)
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("key"), F.col("id").alias("other"))
    placed = batching.with_position(rows, "key", rows_per_block=1_500)
    assert len(seen["blocks"]) >= 15 and max(seen["blocks"]) < 4_500
    got = placed.orderBy("position").collect()
    assert [r.position for r in got] == list(range(30_000))
    assert all(r.key is None for r in got[:10_000]) and [r.key for r in got[10_000:]] == sorted(r.key for r in got[10_000:])
    same = spark.range(20_000).select(F.lit(None).cast("string").alias("key"), F.map_from_arrays(F.array(F.lit(1)), F.array(F.lit(2))).alias("m"))
    placed = batching.with_position(same, "key", rows_per_block=1_000)
    assert len(seen["blocks"]) >= 10 and max(seen["blocks"]) < 4_000
    assert placed.agg(F.count_distinct("position"), F.min("position"), F.max("position")).first() == (20_000, 0, 19_999)


def test_ties_do_not_depend_on_the_partitioning(spark):
    rows = spark.range(500).select((F.col("id") % 5).alias("key"), F.col("id").cast("string").alias("text"))
    first = {r.text: r.position for r in batching.with_position(rows, "key").collect()}
    again = {r.text: r.position for r in batching.with_position(rows.repartition(7), "key", rows_per_block=40).collect()}
    assert first == again
    assert batching.with_position(rows.limit(0), "key").collect() == []
