"""O-72, O-78: where everyone is at any time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import scan

LEGS = "house bigint, id bigint, at_s double, seq bigint, from_x double, from_z double, to_x double, to_z double, speed double, arrive_s double"
REACH = 0.25


def _leg(place: list, row) -> list[tuple]:
    """Ends the walk that is on where it stands at the time of the command, and begins the next."""
    if place:
        at, x, z, to_x, to_z, speed, arrive = place
        x, z = _along(x, z, to_x, to_z, min(row.at_s, arrive) - at, speed)
    else:
        x, z = row.x0, row.z0
    far = math.hypot(row.to_x - x, row.to_z - z)
    arrive = row.at_s + max(0.0, far - REACH) / row.speed
    place[:] = [row.at_s, x, z, row.to_x, row.to_z, row.speed, arrive]
    return [(row.house, row.id, row.at_s, row.seq, x, z, row.to_x, row.to_z, row.speed, arrive)]


def _along(x: float, z: float, to_x: float, to_z: float, seconds: float, speed: float) -> tuple[float, float]:
    far = math.hypot(to_x - x, to_z - z)
    share = min(1.0, seconds * speed / far) if far else 0.0
    return x + (to_x - x) * share, z + (to_z - z) * share


def trajectories(walks: DataFrame) -> DataFrame:
    """walks(house, id, at_s, seq, to_x, to_z, speed, x0, z0) -> LEGS: a straight leg for each command, from where the
    one before had come by then. A walk is over within REACH of its target. x0, z0: the place
    before the first walk. Ties go by seq: the last one is walked. speed is above 0."""
    return scan.fold(walks.where("house is not null and id is not null"), ["house", "id"], ["at_s", "seq"], list, _leg, LEGS)


def positions(asked: DataFrame, legs: DataFrame) -> DataFrame:
    """asked(house, id, at_s, ...) with x, z at that time, null before the first leg. Of legs at one time the
    last counts. One ordered window over both, no range join."""
    leg = [c for c in legs.columns if c not in ("house", "id")]
    names = [c for c in asked.columns if c not in ("house", "id")]
    one = asked.select("house", "id", "at_s", F.lit(1).alias("_kind"), F.struct(*names).alias("_asked"), F.lit(None).cast(legs.select(F.struct(*leg).alias("l")).schema["l"].dataType).alias("_leg"))
    two = legs.select("house", "id", "at_s", F.lit(0).alias("_kind"), F.lit(None).cast(one.schema["_asked"].dataType).alias("_asked"), F.struct(*leg).alias("_leg"))
    w = Window.partitionBy("house", "id").orderBy("at_s", "_kind", "_leg.seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = one.unionByName(two).withColumn("_leg", F.last("_leg", ignorenulls=True).over(w)).where("_kind = 1")
    far = F.hypot(F.col("_leg.to_x") - F.col("_leg.from_x"), F.col("_leg.to_z") - F.col("_leg.from_z"))
    gone = (F.least("at_s", "_leg.arrive_s") - F.col("_leg.at_s")) * F.col("_leg.speed")
    share = F.when(far > 0, F.least(F.lit(1.0), gone / far)).otherwise(F.lit(0.0))
    at = [(F.col(f"_leg.from_{c}") + (F.col(f"_leg.to_{c}") - F.col(f"_leg.from_{c}")) * share).alias(c) for c in ("x", "z")]
    return rows.select("house", "id", "_asked.*", *at)
