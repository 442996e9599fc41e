"""Which side of a join is broadcast when one of them comes from rows on the driver."""

from pyspark.sql import functions as F

from quarry.operators import batch as B
from quarry.operators import joins as J


def test_rows_are_not_broadcast_to_a_few_offsets(spark, tmp_path):
    # a compressed table that looks small, as parquet does
    path = str(tmp_path / "rows")
    spark.range(0, 20000).select((F.col("id") % 3).alias("import_id"), F.repeat(F.lit("x"), 500).alias("t")).write.parquet(path)
    counts = spark.createDataFrame([(0, 5), (1, 7), (None, 2)], "import_id long, _n long")
    offsets = B.running_offsets(counts, ["import_id"])
    assert [tuple(r) for r in offsets.collect()] == [(None, 2, 0), (0, 5, 2), (1, 7, 7)]
    assert J.estimated_bytes(offsets) < 10_000
    plan = J.join_small(spark.read.parquet(path), offsets, "import_id", "inner")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "BuildLeft" not in plan


def test_offsets_of_nothing_are_empty(spark):
    none = B.running_offsets(spark.createDataFrame([], "import_id long, _n long"), ["import_id"])
    assert none.columns == ["import_id", "_n", "_off"] and none.count() == 0
