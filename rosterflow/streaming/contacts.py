"""The contact log as a stream."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "sequence bigint, client_event_id string, turf_id string, person_id string, kind string, payload string, created_at timestamp"
LATEST = "turf_id string, person_id string, sequence bigint, outcome string"


def read(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """New Parquet files of events, as they come."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_at_once).parquet(path)


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each client_event_id once, within ``late`` by the events' time; events without one all pass."""
    timed = events.withWatermark("created_at", late)
    # ids of their own keep events without one apart
    name = F.coalesce("client_event_id", F.concat(F.lit("\u0000"), F.col("sequence").cast("string")))
    return timed.withColumn("__event", name).dropDuplicatesWithinWatermark(["__event"]).drop("__event")


def latest_states(events: DataFrame) -> DataFrame:
    """turf_id, person_id, sequence, outcome whenever a newer result comes; order is the server's sequence.

    A null outcome is a state too. Results older than the state change nothing.
    """
    results = events.where(F.col("kind") == "result").select("turf_id", "person_id", "sequence", F.get_json_object("payload", "$.outcome").alias("outcome"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else -1
        best = None
        for rows in batches:
            top = rows.loc[rows["sequence"].idxmax()]
            if top["sequence"] > seen:
                seen, best = int(top["sequence"]), top
        if best is not None:
            state.update((seen,))
            outcome = best["outcome"] if isinstance(best["outcome"], str) else None
            yield pd.DataFrame({"turf_id": [key[0]], "person_id": [key[1]], "sequence": [seen], "outcome": [outcome]})

    return results.groupBy("turf_id", "person_id").applyInPandasWithState(update, LATEST, "sequence bigint", "update", GroupStateTimeout.NoTimeout)


def append_new(batch: DataFrame, path: str) -> None:
    """For foreachBatch: appends events whose client_event_id the log at ``path`` lacks; those without one always."""
    from ..operators.contacts import deduplicated as first_of_each

    spark = batch.sparkSession
    fresh = first_of_each(batch)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        known = spark.read.schema(EVENT).parquet(path).where("client_event_id is not null").select("client_event_id")
        fresh = fresh.where("client_event_id is null").unionByName(fresh.where("client_event_id is not null").join(known, "client_event_id", "left_anti"))
    fresh.write.mode("append").parquet(path)


def scans(events: DataFrame, minutes: int = 10) -> DataFrame:
    """turf_id, window, n: scans counted in windows of ``minutes``; older ones are forgotten."""
    return events.withWatermark("created_at", f"{minutes} minutes").groupBy("turf_id", F.window("created_at", f"{minutes} minutes")).agg(F.count("*").alias("n"))
