"""Scripted dialogue on a time line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timeline(lines: DataFrame, scene: str = "scene_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """O-69: lines with start_s. The first starts at 3 s, each later one 2.4 s plus 45 ms
    a character (2.5 s at most) after the one before. end_s is when the line is over."""
    delay = F.lit(2.4) + F.least(F.lit(2.5), F.length(F.coalesce(text, F.lit(""))) * F.lit(0.045))
    before = Window.partitionBy(scene).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(3.0) + F.coalesce(F.sum(delay).over(before), F.lit(0.0))
    return lines.withColumn("start_s", start).withColumn("end_s", start + delay)


def spoken(lines: DataFrame, entities: DataFrame, speaker: str = "speaker_id", house: str | None = None) -> DataFrame:
    """O-31: timed lines of known speakers, of their house where there is one; an unknown speaker's line keeps its
    time, so those after it start no sooner, and is not said."""
    on = [house, speaker] if house else [speaker]
    return lines.join(entities.withColumnRenamed("id", speaker).select(*on), on, "left_semi")


def replies(chats: DataFrame, delay_s: float = 2.6) -> DataFrame:
    """O-68: chats(chat, start_s, end_s) whose reply is still due when the delay is over."""
    at = F.col("start_s") + F.lit(delay_s)
    return chats.where(at < F.col("end_s")).withColumn("reply_s", at)


def open_chats(points: DataFrame, chats: DataFrame) -> DataFrame:
    """points(house, id, at_s, ...) with chats: how many chats(house, id, start_s, end_s) of that id are on then, from
    their start up to but not at their end; a null end is never.

    Starts, ends and points go through one ordered window: no range join, and chats may overlap."""
    names = [c for c in points.columns if c not in ("house", "id", "at_s")]
    row = F.struct(F.lit(True).alias("_is"), *names)
    asked = points.select("house", "id", "at_s", F.lit(0).alias("change"), row.alias("r"))
    none = F.lit(None).cast(asked.schema["r"].dataType).alias("r")
    known = chats.where("start_s is not null and (end_s is null or end_s > start_s)")
    changes = known.select("house", "id", F.col("start_s").alias("at_s"), F.lit(1).alias("change"), none).union(known.where("end_s is not null").select("house", "id", F.col("end_s").alias("at_s"), F.lit(-1).alias("change"), none))
    w = Window.partitionBy("house", "id").orderBy("at_s", F.col("r").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = asked.union(changes).withColumn("chats", F.sum("change").over(w)).where("r is not null")
    return rows.select("house", "id", "at_s", *[F.col(f"r.{c}").alias(c) for c in names], "chats")


def fired_replies(chats: DataFrame, delay_s: float = 2.6) -> DataFrame:
    """O-68: chats(house, chat, id, other, start_s, end_s), id having come to other -> house, id (who answers), chat,
    at_s: the answers that are said. An answer is due delay_s after its chat began and asks only whether
    its speaker is in any chat then, be it another one."""
    due = chats.select("house", F.col("other").alias("id"), (F.col("start_s") + F.lit(delay_s)).alias("at_s"), "chat")
    both = chats.select("house", F.explode(F.array("id", "other")).alias("id"), "start_s", "end_s")
    return open_chats(due, both).where("chats > 0").select("house", "id", "chat", "at_s")


def bubbles(lines: DataFrame, seconds: float = 3.5) -> DataFrame:
    """O-67: lines(house, id, at_s, seq) with until_s: a line is seen for so long, or until its speaker's next one."""
    w = Window.partitionBy("house", "id").orderBy("at_s", "seq")
    return lines.withColumn("until_s", F.least(F.col("at_s") + F.lit(seconds), F.lead("at_s").over(w)))
