"""Who gets a place: admission at a bounded capacity, in the order of asking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import scan

ADMITTED = "house bigint, object_id string, request bigint, start_s double, users int, accepted boolean"


def busy_periods(requests: DataFrame) -> DataFrame:
    """requests(house, object_id, request, start_s, end_s) with period: a stretch in which someone asks for or
    would use the object all the time. Before a period the object is surely free, whoever was
    let in, so periods are worked on apart and a crowded object is many of them.

    A sweep over starts (+1) and ends (-1); a null end is never."""
    on = ["house", "object_id"]
    starts = requests.select(*on, F.col("start_s").alias("at"), F.lit(1).alias("change"), F.struct("request", "start_s", "end_s", "capacity").alias("r"))
    ends = requests.where("end_s > start_s").select(*on, F.col("end_s").alias("at"), F.lit(-1).alias("change"), F.lit(None).cast(starts.schema["r"].dataType).alias("r"))
    # one that takes no time is gone at once
    starts = starts.withColumn("change", F.when(F.col("r.end_s") <= F.col("r.start_s"), 0).otherwise(1))
    order = Window.partitionBy(*on).orderBy("at", F.col("r").isNotNull(), "r.request")
    rows = starts.unionByName(ends).withColumn("before", F.coalesce(F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("period", F.sum((F.col("r").isNotNull() & (F.col("before") == 0)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("r is not null").select(*on, "period", "r.*")


def _let_in(inside: list, row) -> list[tuple]:
    inside[:] = [end for end in inside if end is None or end > row.start_s]
    accepted = len(inside) < row.capacity
    users = len(inside)
    end = None if row.end_s != row.end_s else row.end_s
    if accepted and (end is None or end > row.start_s):
        inside.append(end)
    return [(row.house, row.object_id, row.request, row.start_s, users, accepted)]


def admit(requests: DataFrame) -> DataFrame:
    """O-22, O-27, O-44: requests(house, object_id, request, start_s, end_s, capacity) -> ADMITTED: the users that a
    request finds and whether it is let in. A refused one uses nothing. Of equal times those
    who leave go first, then requests by their number. Requests without a house, object or
    start are left out. State of a task: the ends of those inside, capacity of them at most."""
    known = requests.where("house is not null and object_id is not null and start_s is not null")
    return scan.fold(busy_periods(known), ["house", "object_id", "period"], ["start_s", "request"], list, _let_in, ADMITTED)
