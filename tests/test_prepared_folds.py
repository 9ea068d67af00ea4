"""What cross-validation keeps of a table."""

from pyspark.sql import functions as F

from tabloom.operators import supervised
from tabloom.operators.features import FeatureConfig


def test_folds_keep_only_what_a_model_reads(spark):
    rows = spark.range(300).select(
        "id", F.pmod("id", F.lit(7)).alias("a"), F.pmod("id", F.lit(3)).cast("string").alias("c"), (F.col("id") * 2).alias("y"),
        F.lit("a long text no model reads").alias("note"), F.lit(1).alias("fold"),
    )
    config = FeatureConfig(numeric=("a",), categorical=("c",))
    folds = supervised.prepare_folds(rows, "y", "regression", config, ["id"], 3)
    assert len(folds) == 3
    for number, (ready, own) in enumerate(folds):
        assert own.columns == ["a", "c", "y", "_y", "fold"]
        assert {r["fold"] for r in own.select("fold").collect()} == {number}
        assert ready.rows.count() == ready.stats.rows == 200 and own.count() == 100
