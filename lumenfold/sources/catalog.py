"""Static tables. Dialogue texts are data: they come from a path (see read_dialogue)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEEDS = ("hunger", "energy", "fun", "social")

# The cast. id, latin, mbti, shirt, hair, skin, (sociability, energy, playfulness, order), favorites.
CAST = [
    ("namboy", "Namboy", "INTJ-A", 0x2F3B52, 0x1C1C22, 0xD8A878, (0.15, 0.6, 0.3, 1.0), ["desk", "bookshelf"]),
    ("badr", "Badr", "ENFJ-T", 0xD9A13B, 0x3A2A1C, 0xE8B88A, (1.0, 0.75, 0.65, 0.7), ["kitchen", "sofa", "garden"]),
    ("waleed", "Waleed", "ENTP-T", 0xD13B3B, 0x2E2118, 0xC89066, (0.9, 0.85, 0.9, 0.15), ["sofa", "stereo", "trampoline"]),
    ("ahmed", "Ahmed", "ENFP-T", 0x2E9C7A, 0x4A3326, 0xD8A878, (0.8, 0.7, 0.8, 0.3), ["bookshelf", "sofa", "stereo"]),
    ("lovato", "Lovato", "INFJ-T", 0x6B5CA5, 0x1C1C22, 0xE8B88A, (0.4, 0.5, 0.45, 0.7), ["easel", "bookshelf", "garden"]),
    ("omar", "Omar", "ISFP-T", 0x4F86C9, 0x6E4A2A, 0xF0C8A0, (0.5, 0.55, 0.7, 0.4), ["pool", "easel", "garden"]),
    ("saud", "Saud", "ISFP-A", 0x5E7A5A, 0x2E2A26, 0xC89066, (0.3, 0.6, 0.5, 0.8), ["garden", "kitchen", "pool"]),
    ("abdullah", "Abdullah", "INTJ-A", 0x3A3F47, 0x16161C, 0xD8A878, (0.2, 0.65, 0.35, 0.95), ["desk", "bookshelf"]),
]

# Usable objects. id, label, stand x, stand z, face x, face z, need, points an hour, anim, capacity.
OBJECTS = [
    ("fridge", "Fridge", -12.6, -10.6, -13.0, -12.0, "hunger", 55.0, "stand", 1),
    ("kitchen", "Stove", -9.5, -10.8, -9.5, -12.2, "hunger", 45.0, "stand", 1),
    ("sofa", "Sofa", 0.0, -2.2, 0.0, -7.0, "fun", 28.0, "sit", 3),
    ("bookshelf", "Bookshelf", -5.5, -10.9, -5.5, -12.3, "fun", 22.0, "stand", 1),
    ("stereo", "Stereo", -11.8, -1.0, -13.2, -1.0, "fun", 34.0, "dance", 4),
    ("desk", "Computer", 10.8, -1.5, 12.2, -1.5, "fun", 26.0, "stand", 1),
    *((f"bed{i}", "Bed", 7.0 + i * 1.9, -8.9, 7.0 + i * 1.9, -11.3, "energy", 30.0, "sleep", 1) for i in range(4)),
    ("pool", "Pool", 7.0, 12.0, 12.0, 12.0, "fun", 36.0, "stand", 3),
    ("trampoline", "Trampoline", -11.0, 11.0, -11.0, 11.0, "fun", 40.0, "bounce", 2),
    ("easel", "Easel", -15.4, 3.0, -16.5, 2.0, "fun", 30.0, "stand", 1),
    ("garden", "Garden", 17.0, 3.6, 17.0, 2.0, "fun", 20.0, "stand", 2),
    ("coffee", "Coffee", -5.5, -6.1, -5.5, -7.5, "energy", 24.0, "stand", 2),
]

# Seats stand on a circle; center x, center z, radius, count.
SEATS = (0.0, 16.0, 3.0, 8)

CAST_SCHEMA = "ordinal int, id string, latin string, mbti string, shirt int, hair int, skin int, traits struct<sociability:double,energy:double,playfulness:double,order:double>, favorites array<string>"
OBJECT_SCHEMA = "ordinal int, id string, label string, stand_x double, stand_z double, face_x double, face_z double, need string, rate double, anim string, capacity int"
PROFILE_SCHEMA = "id string, name string, emoji string"
LINE_SCHEMA = "id string, category string, n int, text string"
DYNAMIC_SCHEMA = "a string, b string, n int, first string, second string"
SCENE_SCHEMA = "scene_id int, turn int, speaker_id string, text string"


def cast(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(CAST)], CAST_SCHEMA)


def objects(spark: SparkSession) -> DataFrame:
    rows = [(i, *o) for i, o in enumerate(OBJECTS)]
    return spark.createDataFrame(rows, OBJECT_SCHEMA)


def register(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """O-02: objects appended behind those there, each key's (a house's) by itself: rows have the columns of
    table but the ordinal, which goes on from the greatest one, in the order given."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    both = table.withColumn("_new", F.lit(None).cast("int")).unionByName(rows.withColumn("ordinal", F.lit(None).cast("int")).withColumn("_new", place))
    top = F.coalesce(F.max("ordinal").over(Window.partitionBy(*keys)), F.lit(-1))
    return both.withColumn("ordinal", F.coalesce("ordinal", (top + F.col("_new")).cast("int"))).drop("_new")


def by_id(rows: DataFrame, table: DataFrame, on: list[str], order: str | None = None) -> DataFrame:
    """O-20, O-21: rows with what table has under the same keys, nulls where it has nothing. Of several
    the first in order counts; without an order keys are unique."""
    if order is not None:
        w = Window.partitionBy(*on).orderBy(order)
        table = table.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return rows.join(table, on, "left")


def seats(spark: SparkSession) -> DataFrame:
    x, z, radius, n = SEATS
    turn = F.col("seat_id") / F.lit(float(n)) * F.lit(math.pi) * F.lit(2.0)
    ids = spark.range(n).select(F.col("id").cast("int").alias("seat_id"))
    return ids.select("seat_id", (F.lit(x) + F.cos(turn) * radius).alias("x"), (F.lit(z) + F.sin(turn) * radius).alias("z"))


def read_dialogue(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """kind: profiles (names and signs of the cast), lines, dynamics or scenes, one JSON object a row in
    path/kind.json. Malformed rows raise."""
    schema = {"profiles": PROFILE_SCHEMA, "lines": LINE_SCHEMA, "dynamics": DYNAMIC_SCHEMA, "scenes": SCENE_SCHEMA}[kind]
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{kind}.json")


def whole_cast(spark: SparkSession, path: str) -> DataFrame:
    """O-01: the cast with names, signs and lines from path; null, or no lines, where path has none."""
    lines = line_pools(read_dialogue(spark, path, "lines"))
    rows = by_id(by_id(cast(spark), read_dialogue(spark, path, "profiles"), ["id"]), lines, ["id"])
    return rows.withColumn("lines", F.coalesce("lines", F.expr("cast(map() as map<string,array<string>>)")))


def line_pools(lines: DataFrame) -> DataFrame:
    """lines -> id, lines map<category, texts in order>. A character has few lines."""
    pools = lines.groupBy("id", "category").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]).alias("texts"))
    return pools.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("category", "texts"))).alias("lines"))
