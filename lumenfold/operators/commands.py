"""What a user's pointer and keys mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import choice


def clicks(events: DataFrame, limit: float = 6.0) -> DataFrame:
    """O-25: events(pointer, at_s, seq, kind, x, y), kind press or release -> the releases that are no drags,
    with moved: they meet a press, and moved limit at most since.

    A release takes the latest press of its pointer and uses it up, so the one before it in
    order must be that press: one ordered window, no join. Of equal times a press goes
    first, then seq. A new press replaces one that was never released; other kinds and
    events without a time or place are ignored."""
    known = events.where(F.col("kind").isin("press", "release") & F.col("at_s").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    w = Window.partitionBy("pointer").orderBy("at_s", F.col("kind") == "release", "seq")
    before = F.lag(F.struct("kind", "x", "y")).over(w)
    rows = known.withColumn("_b", before).where("kind = 'release' and _b.kind = 'press'")
    rows = rows.withColumn("moved", F.hypot(F.col("x") - F.col("_b.x"), F.col("y") - F.col("_b.y")))
    return rows.where(F.col("moved") <= limit).drop("_b", "kind")


def first_hit(hits: DataFrame) -> DataFrame:
    """O-26: hits(click, hit_no, kind, selected) -> each click's first hit that means
    something: an entity always, an object or the ground with a selection."""
    means = (F.col("kind") == "entity") | (F.col("kind").isin("object", "ground") & F.col("selected"))
    n = F.row_number().over(Window.partitionBy("click").orderBy("hit_no"))
    return hits.where(means).withColumn("_n", n).where("_n = 1").drop("_n")


def guard_capacity(requests: DataFrame) -> DataFrame:
    """O-27: requests(users, capacity, label) with accepted and, if not, a message."""
    full = F.col("users") >= F.col("capacity")
    return requests.withColumn("accepted", ~full).withColumn("message", F.when(full, F.concat(F.lit("The "), F.lower("label"), F.lit(" is taken!"))))


def clamp_ground(x: Column, z: Column) -> tuple[Column, Column]:
    """O-78: a ground target stays on the lot."""
    return F.least(F.greatest(x, F.lit(-26.0)), F.lit(26.0)), F.least(F.greatest(z, F.lit(-14.0)), F.lit(22.0))


def parse_command(key: Column) -> Column:
    """O-06: a key as a command: 1-8 select, Space pauses, G gathers, F follows."""
    n = key.try_cast("int") if hasattr(key, "try_cast") else key.cast("int")
    return F.when(n.between(1, 8), F.concat(F.lit("select:"), n - 1)).when(key == " ", "pause").when(F.lower(key) == "g", "gather").when(F.lower(key) == "f", "follow")


def argument(props: Column, name: str) -> Column:
    """A whole number that an event carries in its JSON; null where there is none or the JSON is broken."""
    return F.from_json(props, f"`{name}` bigint")[name]


#: What buttons, toolbar and keys stand for. source, name, command.
BUTTONS = {"0": "speed:0", "1": "speed:1", "3": "speed:3"}
TOOLS = {"majlis": "scene", "follow": "follow", "save": "save", "reset": "reset", "control": "free_will"}


def command_of(source: Column, name: Column) -> Column:
    """O-06: what an input means. source clock, toolbar, key, pointer or roster; name the button, the tool, the
    key, what a click hit as kind:id, or the chosen friend. Null where it means nothing."""
    at = lambda names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    keyed = parse_command(name)
    keyed = F.when(keyed == "pause", "speed:toggle").when(keyed == "gather", "scene").otherwise(keyed)
    kind, what = F.split_part(name, F.lit(":"), F.lit(1)), F.split_part(name, F.lit(":"), F.lit(2))
    clicked = F.when(kind == "entity", F.concat(F.lit("select:"), what)).when(kind == "object", F.concat(F.lit("use:"), what)).when(kind == "ground", F.concat(F.lit("move:"), what))
    return (
        F.when(source == "clock", F.try_element_at(at(BUTTONS), name)).when(source == "toolbar", F.try_element_at(at(TOOLS), name))
        .when(source == "key", keyed).when(source == "pointer", clicked).when(source == "roster", F.concat(F.lit("select:"), name))
    )


def command_table(inputs: DataFrame) -> DataFrame:
    """O-06: inputs(input_id, house, ts, source, name) -> input_id, house, ts, command: those that mean something, each
    once, however often it was delivered."""
    rows = inputs.select("input_id", "house", "ts", command_of(F.col("source"), F.col("name")).alias("command"))
    return rows.where("command is not null and ts is not null").dropDuplicates(["input_id"])


def gather(entities: DataFrame, seats: DataFrame) -> DataFrame:
    """O-77: entities(house, id, ordinal, state, x, z) all walk to a seat each -> house, id,
    seat_id, x, z (the target), next_state, and what that ends: released an object's use,
    parted a chat. Without a free seat all but the target holds."""
    taken = choice.seat_greedily(entities, seats)
    rows = entities.select("house", "id", "state").join(taken, ["house", "id"]).join(F.broadcast(seats), "seat_id", "left")
    return rows.select("house", "id", "seat_id", "x", "z", F.lit("walking").alias("next_state"), (F.col("state") == "using").alias("released"), (F.col("state") == "chatting").alias("parted"))
