"""Following job events as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabloom.functions.values import quoted
from tabloom.operators.lifecycle import TERMINAL_STATES, job_state

EVENT_SCHEMA = (
    "event_id string, job_id string, workflow_id string, event_type string, step_name string, "
    "status string, message string, payload string, created_at timestamp"
)

# Groups a job's rows are dealt over in a batch.
PARTS = 32
# Buckets of jobs; each makes ``PARTS`` groups, however many jobs there are.
BUCKETS = 128


def read_events(
    spark: SparkSession, folder: str, pattern: str = "*", schema: T.StructType | str = EVENT_SCHEMA,
    files_per_batch: int | None = None,
) -> DataFrame:
    """A streaming scan of Parquet event files."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def follow_events(
    events: DataFrame, job: str = "job_id", event_id: str = "event_id", event_time: str = "created_at",
    parts: int = PARTS, resent_within: str | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Every event of a job once, up to and with its terminal event (``is_terminal``).

    Spark's own state per (job, id) drops what was seen; it spreads a job's ids over all tasks.
    Then the rows of a job are dealt over ``parts`` groups, each of which also gets the job's few
    terminal rows (their texts only once), so every group knows by itself where the job ends: no task
    gathers a job's rows or ids.  Step events never close a job.  A closed job passes nothing on,
    however late or early its rows are dated.

    Jobs share ``buckets`` of groups, as a call per job and part costs more than its rows.  A group's state
    is the ids of its closed jobs, read whenever the bucket gets rows; streams that close many
    millions of jobs should take more buckets.

    Ids are kept for good, or for ``resent_within`` (such as "2 days") of event time if rows
    aren't sent again later than that; rows dated further back are then dropped.
    """
    if resent_within is None:
        once = events.dropDuplicates([job, event_id])
    else:
        once = events.withWatermark(event_time, resent_within).dropDuplicatesWithinWatermark([job, event_id])
    ends = F.coalesce(F.col("status").isin(TERMINAL_STATES) & (F.col("event_type") != "step"), F.lit(False))
    home = F.pmod(F.xxhash64(event_id), F.lit(parts)).cast("int")
    everywhere = F.sequence(F.lit(0), F.lit(parts - 1))
    # One text per job, NULL being a job as well.
    name = F.coalesce(F.concat(F.lit("="), F.col(job).cast("string")), F.lit(""))
    bucket = F.pmod(F.xxhash64(name, F.lit(buckets)), F.lit(buckets)).cast("int")
    dealt = once.withColumns({"is_terminal": ends, "_home": home, "_job": name, "_bucket": bucket}).withColumn(
        "_part", F.explode(F.when(F.col("is_terminal"), everywhere).otherwise(F.array("_home")))
    )
    fields, order = events.schema.fields, ["_job", "_time", "_id"]
    # Integers travel as text, as pandas makes them doubles next to another job's NULL.
    texts = [f.name for f in fields if isinstance(f.dataType, (T.StringType, T.IntegralType))]
    output = T.StructType([T.StructField(f.name, T.StringType() if f.name in texts else f.dataType) for f in fields])
    output = output.add("is_terminal", T.BooleanType())
    own = F.col("_home") == F.col("_part")
    dealt = dealt.withColumns({"_time": F.col(event_time), "_id": F.col(event_id)}).withColumns(
        {c: F.when(own, quoted(c).cast("string")) for c in texts}
    )

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed = set(state.get[0]) if state.exists else set()
        rows = pd.concat([f[~f["_job"].isin(closed)] for f in frames]).sort_values(order, kind="stable")
        ending = rows["is_terminal"].astype("int64")
        before = ending.groupby(rows["_job"]).cumsum() - ending
        rows = rows[before == 0]
        ended = rows.loc[rows["is_terminal"], "_job"]
        if len(ended):
            state.update((sorted(closed.union(ended)),))
        yield rows.loc[rows["_home"] == rows["_part"], output.names]

    followed = dealt.groupBy("_bucket", "_part").applyInPandasWithState(
        follow, output, "closed array<string>", "append", GroupStateTimeout.NoTimeout
    )
    return followed.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in fields], "is_terminal")


def follow_job_state(events: DataFrame) -> DataFrame:
    """Running state per job by the rule of ``job_state``, for update mode: one state row per job."""
    return job_state(events)


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append everything available now to Parquet and read it back."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def drain_updates(stream: DataFrame, key: str, path: str, checkpoint: str) -> DataFrame:
    """Write each batch's changed rows and read the latest row per key.

    A batch folder is overwritten when its batch is retried, so a restart
    leaves no row twice.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id:08d}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = stream.sparkSession.read.parquet(path).drop("batch")
    newest = Window.partitionBy(key).orderBy(F.desc("batch_id"))
    return written.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r", "batch_id")
