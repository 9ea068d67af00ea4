"""Jobs that share a bucket of a followed stream."""

import pytest
from pyspark.sql import functions as F

from tabloom.streaming import events

SCHEMA = "event_id string, job_id bigint, event_type string, status string, message string, created_at string"


@pytest.mark.parametrize("buckets", [1, 128])
def test_jobs_of_a_bucket_end_by_themselves(spark, tmp_path, buckets):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def batch(*rows):
        made = spark.createDataFrame([(*r[:4], f"m {r[0]}", f"2024-01-01 {r[4]}:00") for r in rows], SCHEMA)
        made = made.withColumn("created_at", F.col("created_at").cast("timestamp"))
        made.write.mode("append").parquet(folder)
        stream = events.follow_events(events.read_events(spark, folder, schema=made.schema), buckets=buckets)
        got = events.drain(stream, out, state).collect()
        assert all(r["message"] == f"m {r['event_id']}" for r in got)
        return sorted((r["event_id"], r["job_id"], r["is_terminal"]) for r in got if r["job_id"] is not None), sorted(
            r["event_id"] for r in got if r["job_id"] is None
        )

    big = 2**60 + 1  # not a whole double
    first = batch(("a", 1, "move", "running", "09:00"), ("b", 1, "end", "completed", "09:01"), ("c", 1, "move", "running", "09:02"),
                  ("a", big, "move", "running", "09:03"), ("n", None, "move", "running", "09:00"))
    assert first == ([("a", 1, False), ("a", big, False), ("b", 1, True)], ["n"])
    second = batch(("d", 1, "move", "running", "08:00"), ("e", big, "end", "failed", "08:00"), ("o", None, "end", "failed", "09:01"))
    assert second == ([("a", 1, False), ("a", big, False), ("b", 1, True), ("e", big, True)], ["n", "o"])
    assert batch(("f", big, "move", "running", "07:00"), ("p", None, "move", "running", "07:00")) == second


def test_the_number_of_groups_is_bounded(spark, tmp_path):
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("event_id"), F.col("id").cast("string").alias("job_id"), F.lit("move").alias("event_type"),
        F.lit("running").alias("status"), F.lit("m").alias("message"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.follow_events(events.read_events(spark, str(tmp_path / "in"), schema=rows.schema), buckets=2, parts=2)
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "_bucket#" in plan
    assert events.drain(stream, str(tmp_path / "out"), str(tmp_path / "state")).count() == 3000
