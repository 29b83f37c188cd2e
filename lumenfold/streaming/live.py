"""Live state as Structured Streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfold.operators import commands, pairing
from lumenfold.sources.staging import new_path

PAIRED = "house bigint, id string, partner string, event string"
PAIRS = "partners map<string,string>"


def autosave(states: DataFrame, path: str, checkpoint: str, seconds: int = 20):
    """O-04: every trigger writes the newest document of each house it has seen, in a folder
    of its own (epoch=N), which a repeated trigger overwrites. Ties go to the greater document."""

    def keep(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy("house").agg(F.max(F.struct("at_s", "document")).alias("n")).select("house", "n.document", "n.at_s")
        newest.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return states.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds")


def running_affinity(chats: DataFrame, per_hour: float = 2.2) -> DataFrame:
    """O-43 on a stream; use output mode update or complete."""
    return chats.groupBy("src", "dst").agg(F.sum(F.col("hours") * F.lit(per_hour)).alias("score"))


def occupancy(changes: DataFrame) -> DataFrame:
    """O-44 on a stream of changes(house, object_id, change) of +1 and -1."""
    return changes.groupBy("house", "object_id").agg(F.sum("change").alias("users"))


def _pair(key, batches, state: GroupState):
    """O-35 on a stream. A house's rows of one trigger are few; they are put in order over all of its batches."""
    partners = dict(state.get[0] or {}) if state.exists else {}
    out = []
    for r in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples(index=False):
        out += [(key[0], *x) for x in pairing.step(partners, r)]
    if partners:
        state.update((partners,))
    elif state.exists:
        state.remove()  # nothing is kept of a house in which nobody chats
    yield pd.DataFrame(out, columns=["house", "id", "partner", "event"])


def chat_links(arrivals: DataFrame) -> DataFrame:
    """O-35, O-66 on a stream: arrivals(house, seq, kind, id, other, other_using) -> links
    made and parted. State is one small map a house with links; houses run in parallel."""
    return arrivals.groupBy("house").applyInPandasWithState(_pair, PAIRED, PAIRS, "append", GroupStateTimeout.NoTimeout)


def command_stream(inputs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """O-06 on a stream: inputs(input_id, house, ts, source, name) -> the commands of command_table(). An input
    delivered again within late of its first time is dropped, and so is one that comes later
    than that behind the newest. State: input_ids of that long."""
    rows = inputs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("input_id", "house", "ts", commands.command_of(F.col("source"), F.col("name")).alias("command")).where("command is not null and ts is not null")
    return rows.dropDuplicatesWithinWatermark(["input_id"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def available_now(stream: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over all that is there, into a table in the shared folder -> that table. settings
    hold while it runs."""
    spark = stream.sparkSession
    path, before = new_path(spark, name), {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        out = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress").outputMode("append").trigger(availableNow=True).start()
        out.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(path)
