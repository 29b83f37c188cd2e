"""Saved states as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.sources.staging import staged

NEEDS = ("hunger", "energy", "fun", "social")


def save(entities: DataFrame, clock: DataFrame) -> DataFrame:
    """O-03, O-11: entities(house, ordinal, id, needs, rel, x, z), clock(house, game_minutes,
    day) -> house, document. A house is one document; null clock fields are saved as null."""
    sims = entities.groupBy("house").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.to_json(F.struct("id", "needs", "rel", "x", "z")).alias("doc")))), lambda s: s["doc"]).alias("sims"))
    rows = clock.join(sims, "house", "left")
    head = F.to_json(F.struct(F.col("game_minutes").alias("gameMinutes"), "day"), {"ignoreNullFields": "false"})
    body = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"sims":['), F.concat_ws(",", "sims"), F.lit("]}"))
    return rows.withColumn("head", head).select("house", body.alias("document"))


def latest(saves: DataFrame, key: str, at: str, bucket_s: int = 20) -> DataFrame:
    """O-04: the last save of each key in each stretch of bucket_s seconds."""
    rows = saves.withColumn("bucket", F.floor(F.col(at) / bucket_s).cast("bigint"))
    n = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(F.col(at).desc()))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def autosaves(frames: DataFrame, every_s: float = 20.0, cap_s: float = 0.1) -> DataFrame:
    """O-04: frames(house, at_us, seq) -> house, at_us, seq, save: the frames at which a house is saved, numbered
    from 1. Time since the last save adds up, cap_s a frame at most; above every_s the house is
    saved and counting starts at 0 again, so what went beyond is lost. Whole microseconds.

    Greedy cuts by pointers: running sums say for every frame which one would be the next save
    after it; then the saves that are reached from the start are marked by pointer doubling,
    a few joins however long the history."""
    every, cap = int(every_s * 1_000_000), int(cap_s * 1_000_000)
    w = Window.partitionBy("house").orderBy("at_us", "seq")
    step = F.least(F.col("at_us") - F.coalesce(F.lag("at_us").over(w), F.col("at_us")), F.lit(cap))
    rows = frames.select("house", "at_us", "seq", step.alias("step"), F.row_number().over(w).alias("n"))
    rows = staged(rows.withColumn("sum", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))), "frames")
    asks = rows.select("house", "n", "sum").union(rows.select("house", F.lit(0), F.lit(0).cast("bigint")).distinct())
    # backwards, so that the frame only grows: the last frame met before an ask is the first whose sum is beyond it
    both = rows.select("house", F.col("sum").alias("at"), F.lit(0).alias("ask"), "n").union(asks.select("house", F.col("sum") + every, F.lit(1), "n"))
    back = Window.partitionBy("house").orderBy(F.col("at").desc(), F.col("ask").desc(), F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    jump = both.withColumn("to", F.last(F.when(F.col("ask") == 0, F.col("n")), ignorenulls=True).over(back)).where("ask = 1 and to is not null")
    jump = staged(jump.select("house", F.col("n").alias("at"), "to"), "jump")
    saves, last = staged(jump.where("at = 0").select("house", F.col("to").alias("n"), F.lit(1).cast("bigint").alias("save")), "saves"), 1
    while True:
        more = saves.join(jump.withColumnRenamed("at", "n"), ["house", "n"]).select("house", F.col("to").alias("n"), (F.col("save") + last).alias("save"))
        if more.isEmpty():
            break
        saves = staged(saves.union(more), "saves")
        there = jump.select("house", F.col("at").alias("to"), F.col("to").alias("then"))
        jump, last = staged(jump.join(there, ["house", "to"]).select("house", "at", F.col("then").alias("to")), "jump"), 2 * last
    return saves.join(rows.select("house", "n", "at_us", "seq"), ["house", "n"]).select("house", "at_us", "seq", "save")


#: A saved character: x is null unless it is a number.
SIM = """named_struct('id', try_variant_get(s, '$.id', 'string'), 'needs', try_variant_get(s, '$.needs', 'map<string,double>'),
  'rel', try_variant_get(s, '$.rel', 'map<string,double>'), 'z', try_variant_get(s, '$.z', 'double'),
  'x', if(schema_of_variant(try_variant_get(s, '$.x', 'variant')) rlike '^(BIGINT|DOUBLE|FLOAT|DECIMAL)', try_variant_get(s, '$.x', 'double'), NULL))"""


def parse(saves: DataFrame, minutes: float = 480.0, day: int = 1) -> DataFrame:
    """O-05: documents -> house, ok, game_minutes, day, sims. Malformed JSON and a bare null
    are not ok; missing or null clock fields take the defaults, missing sims are none."""
    rows = saves.select("house", F.try_parse_json("document").alias("d"))
    ok = F.expr("d IS NOT NULL AND NOT coalesce(is_variant_null(d), true)")
    sims = F.expr(f"transform(coalesce(try_variant_get(d, '$.sims', 'array<variant>'), array()), s -> {SIM})")
    clock = [F.coalesce(F.try_variant_get("d", "$.gameMinutes", "double"), F.lit(minutes)), F.coalesce(F.try_variant_get("d", "$.day", "int"), F.lit(day))]
    return rows.select("house", ok.alias("ok"), clock[0].alias("game_minutes"), clock[1].alias("day"), sims.alias("sims"))


def restore(live: DataFrame, parsed: DataFrame) -> DataFrame:
    """O-05, O-32: live(house, id, needs, rel, x, z) overlaid by the saved rows of the same
    id: needs by key, rel as a whole (none saved: empty), x and z together where x is a
    number. Of several rows of one id later ones go over earlier ones. Unknown saved ids are
    skipped, live ones without a save stay."""
    saved = parsed.where("ok").select("house", F.posexplode("sims").alias("at", "s")).select("house", "at", "s.*")
    last = lambda value, there: F.max_by(value, F.when(there, F.col("at")))
    each = [last(F.try_element_at("needs", F.lit(n)), F.try_element_at("needs", F.lit(n)).isNotNull()).alias(f"s_{n}") for n in NEEDS]
    none = F.expr("cast(map() as map<string,double>)")
    saved = saved.groupBy("house", "id").agg(
        *each, F.max_by(F.coalesce("rel", none), "at").alias("s_rel"), last(F.struct("x", "z"), F.col("x").isNotNull()).alias("s_place")
    )
    rows = live.join(saved, ["house", "id"], "left")
    needs = F.create_map(*[x for n in NEEDS for x in (F.lit(n), F.coalesce(f"s_{n}", F.try_element_at("needs", F.lit(n))))])
    moved = F.col("s_place").isNotNull()
    place = [F.when(moved, F.coalesce(f"s_place.{c}", c)).otherwise(F.col(c)).alias(c) for c in ("x", "z")]
    return rows.select("house", "id", needs.alias("needs"), F.coalesce("s_rel", "rel").alias("rel"), *place)
