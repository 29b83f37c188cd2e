"""Switches whose next state depends on the present one: speed, scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def speeds(commands: DataFrame, start: int = 1) -> DataFrame:
    """O-71: commands(house, at_s, seq, value) -> with speed after each. A value is set as it is; a null
    value is Space: 0 where the speed is above 0, else 1. Ties go by seq.

    Every Space after the first since a value was set just turns back, so the last value and
    the number of Spaces since then say it all: two running aggregates, no step by step."""
    w = Window.partitionBy("house").orderBy("at_s", "seq").rowsBetween(Window.unboundedPreceding, 0)
    spaces = F.sum(F.col("value").isNull().cast("int")).over(w)
    rows = commands.withColumn("_spaces", spaces)
    rows = rows.withColumn("_set", F.last(F.when(F.col("value").isNotNull(), F.struct("value", "_spaces")), ignorenulls=True).over(w))
    base, since = F.coalesce("_set.value", F.lit(start)), F.col("_spaces") - F.coalesce("_set._spaces", F.lit(0))
    even = since % 2 == 0
    speed = F.when(since == 0, base).when(base > 0, F.when(even, 1).otherwise(0)).otherwise(F.when(even, 0).otherwise(1))
    return rows.withColumn("speed", speed).drop("_spaces", "_set")


def running(speeds: DataFrame, start: int = 1) -> DataFrame:
    """speeds(house, at_s, seq, speed) from speeds() -> with run_s: seconds up to the command in which the
    house didn't stand still. Before its first command a house runs at start from at_s 0."""
    w = Window.partitionBy("house").orderBy("at_s", "seq")
    gap = (F.col("at_s") - F.coalesce(F.lag("at_s").over(w), F.lit(0.0))) * (F.coalesce(F.lag("speed").over(w), F.lit(start)) > 0).cast("int")
    return speeds.withColumn("_gap", gap).withColumn("run_s", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def run_at(events: DataFrame, clock: DataFrame, start: int = 1) -> DataFrame:
    """events(house, at_s, ...) with run_s as running() counts it. A command at the same time as an event
    holds from then on. One ordered window over both, no range join."""
    names = [c for c in events.columns if c != "house"]
    one = events.select("house", "at_s", F.lit(1).alias("_kind"), F.struct(*names).alias("_event"), F.lit(None).cast("struct<at_s:double,run_s:double,speed:int>").alias("_set"))
    two = clock.select("house", "at_s", F.lit(0).alias("_kind"), F.lit(None).cast(one.schema["_event"].dataType).alias("_event"), F.struct(F.col("at_s").cast("double").alias("at_s"), F.col("run_s").cast("double").alias("run_s"), F.col("speed").cast("int").alias("speed")).alias("_set"), "seq")
    w = Window.partitionBy("house").orderBy("at_s", "_kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = one.withColumn("seq", F.lit(None).cast(two.schema["seq"].dataType)).unionByName(two).withColumn("_set", F.last("_set", ignorenulls=True).over(w)).where("_kind = 1")
    runs = F.coalesce("_set.speed", F.lit(start)) > 0
    run = F.coalesce("_set.run_s", F.lit(0.0)) + (F.col("at_s") - F.coalesce("_set.at_s", F.lit(0.0))) * runs.cast("int")
    return rows.select("house", "_event.*", run.alias("run_s"))


def scenes(presses: DataFrame, at: str = "run_s") -> DataFrame:
    """O-28, O-69: presses(house, run_s, seq, length_s) -> with starts: whether the press begins a scene, and
    end_s: when that one is over, by itself after length_s or by the next press. A press while a
    scene is on ends it; one at its very end finds it over.

    A press that comes length_s or more after the one before always starts; any other does
    what the one before didn't. So within a run of close presses every second one starts."""
    w = Window.partitionBy("house").orderBy(at, "seq")
    close = F.coalesce(F.col(at) < F.lag(at).over(w) + F.lag("length_s").over(w), F.lit(False))
    rows = presses.withColumn("_run", (~close).cast("int")).withColumn("_run", F.sum("_run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("house", "_run").orderBy(at, "seq"))
    rows = rows.withColumn("starts", place % 2 == 1)
    end = F.least(F.col(at) + F.col("length_s"), F.lead(at).over(w))
    return rows.withColumn("end_s", F.when(F.col("starts"), end)).drop("_run")


def release_seated(entities: DataFrame, u: Column) -> DataFrame:
    """O-77: the end of a scene frees those who sit: next_state and idle_s (0.5 to 2 s by u). Who
    is still on the way, or does something else, goes on."""
    seated = F.col("state") == "gathered"
    return entities.withColumn("next_state", F.when(seated, "idle").otherwise(F.col("state"))).withColumn("idle_s", F.when(seated, 0.5 + u * 1.5))
