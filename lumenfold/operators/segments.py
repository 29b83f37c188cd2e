"""Stretches of one state: needs at their end, occupancy, affinity, timers, speed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import derive
from lumenfold.operators import scan


def evolve(segments: DataFrame) -> DataFrame:
    """O-63..O-65: segments(..., state, anim, need, rate, hours, needs and traits) with the
    needs at the end as <need>_end. Closed form: one projection, no stepping."""
    using, chatting = F.col("state") == "using", F.col("state") == "chatting"
    asleep = using & (F.coalesce("anim", F.lit("")) == "sleep")
    rates = derive.decay_rates(F.col("sociability"), F.col("trait_energy"), F.col("playfulness"), asleep, chatting)
    gains = {n: F.when(using & (F.col("need") == n), F.col("rate")).otherwise(0.0) for n in rates}
    gains["social"] = F.when(chatting, 32.0).otherwise(gains["social"])
    gains["fun"] = F.when(chatting, 8.0).otherwise(gains["fun"])
    return segments.withColumns({f"{n}_end": derive.after_gain(F.col(n), F.coalesce(gains[n], F.lit(0.0)), rates[n], F.col("hours")) for n in rates})


def use_hours(start: Column, net: Column, asleep: Column, planned: Column) -> Column:
    """O-64: until energy 96 when asleep, else until the need is 98 or the time is up."""
    full = (F.when(asleep, 96.0).otherwise(98.0) - start) / net
    full = F.greatest(F.lit(0.0), full)
    return F.when(net <= 0, planned).when(asleep, full).otherwise(F.least(planned, full))


def affinity(chats: DataFrame, per_hour: float = 2.2) -> DataFrame:
    """O-43: chats(src, dst, hours) -> score of each direction; it only grows."""
    return chats.groupBy("src", "dst").agg(F.sum(F.col("hours") * F.lit(per_hour)).alias("score"))


def timers(starts: DataFrame, seconds: Column, at: Column) -> DataFrame:
    """O-67: rows with due_s and whether they have run out at the given time."""
    return starts.withColumn("due_s", F.col("start_s") + seconds).withColumn("over", F.col("start_s") + seconds <= at)


def game_clock(commands: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """O-71, O-61: speed commands(house, at_s, speed) -> the stretch each holds for, its game
    minutes and the game minutes before it. The last stretch is open. Of equal times, in the order
    of ties, each but the last is empty."""
    w = Window.partitionBy("house").orderBy("at_s", *ties)
    rows = commands.withColumn("until_s", F.lead("at_s").over(w)).withColumn("minutes", (F.col("until_s") - F.col("at_s")) * F.col("speed") * 10)
    return rows.withColumn("minutes_before", F.coalesce(F.sum("minutes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


# State machine. from, event, to.
TRANSITIONS = [
    ("idle", "decided", "walking"),
    ("walking", "arrived", "idle"),
    ("walking", "arrived_use", "using"),
    ("walking", "arrived_chat_busy", "idle"),
    ("walking", "arrived_chat_free", "chatting"),
    ("walking", "arrived_gather", "gathered"),
    ("using", "done", "idle"),
    ("chatting", "done", "idle"),
    ("chatting", "partner_gone", "idle"),
    ("gathered", "released", "idle"),
    ("idle", "visited", "chatting"),
    ("walking", "visited", "chatting"),
    ("gathered", "visited", "chatting"),
]
COMMANDS = ("move", "use", "gather")


STATES = ("idle", "walking", "using", "chatting", "gathered")


def transition(state: Column, event: Column, free_will: Column) -> Column:
    """What an event makes of a state. A command leads to walking from anywhere; deciding needs free will
    (null: yes); events that a state doesn't know leave it."""
    pairs = F.create_map(*[F.lit(x) for a, b, c in TRANSITIONS for x in (f"{a}/{b}", c)])
    to = F.try_element_at(pairs, F.concat_ws("/", state, event))
    held = (event == "decided") & ~F.coalesce(free_will, F.lit(True))
    return F.when(event.isin(*COMMANDS), "walking").when(held, state).otherwise(F.coalesce(to, state))


def next_state(rows: DataFrame) -> DataFrame:
    """O-66, O-77..O-79: rows(state, event, free_will) with next_state. A partner who is visited turns to
    chatting too, unless in use of something."""
    return rows.withColumn("next_state", transition(F.col("state"), F.col("event"), F.col("free_will")))


def state_history(events: DataFrame, keys: list[str], order: list[str], start: str = "idle", block: str | None = None) -> DataFrame:
    """O-66: events(keys, order, event, free_will) with state: the one that each event leaves, from start on.

    An event is a function from states to states; functions of few states compose, so a history
    of any length is a prefix scan (see scan.prefix_scan for order and block)."""
    names = [f"_from_{s}" for s in STATES]

    def compose(a: scan.Values, b: scan.Values) -> scan.Values:
        def after(state: Column) -> Column:
            out = F.when(state == STATES[0], b[names[0]])
            for s, n in zip(STATES[1:], names[1:]):
                out = out.when(state == s, b[n])
            return out

        return {n: after(a[n]) for n in names}

    rows = events.withColumns({n: transition(F.lit(s), F.col("event"), F.col("free_will")) for s, n in zip(STATES, names)})
    return scan.prefix_scan(rows, keys, order, names, compose, block).withColumn("state", F.col(f"_from_{start}")).drop(*names)


def close_on_command(segments: DataFrame, commands: DataFrame) -> DataFrame:
    """O-78: a command(house, id, at_s) ends the segment that is open then; one that begins with the
    command stays.

    Both go through one window by (house, id): no range join. Other columns of segments stay."""
    names = [c for c in segments.columns if c not in ("house", "id")]
    rows = segments.select("house", "id", "start_s", F.lit(None).cast("double").alias("at_s"), F.struct(*names).alias("r"))
    none = F.lit(None).cast(rows.schema["r"].dataType).alias("r")
    rows = rows.union(commands.select("house", "id", F.col("at_s").alias("start_s"), "at_s", none))
    # from the end backwards, so that the frame only grows: the last command met is the next one;
    # of equal times the segment comes first, so its own command is not met
    later = Window.partitionBy("house", "id").orderBy(F.col("start_s").desc(), F.col("at_s").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("cut_s", F.last("at_s", ignorenulls=True).over(later)).where("r is not null")
    return rows.select("house", "id", *[F.least("r.end_s", "cut_s").alias(c) if c == "end_s" else F.col(f"r.{c}").alias(c) for c in names])
