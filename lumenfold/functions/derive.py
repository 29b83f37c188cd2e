"""Column functions over one row: moods, rates, clocks, light, geometry, seeded draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points a need loses in a game hour.
DECAY = {"hunger": 4.5, "energy": 3.2, "fun": 5.0, "social": 4.2}
# What a character does at an object of each kind, and else.
VERBS = {"sleep": "Sleeping in", "sit": "Lounging on", "dance": "Dancing at", "bounce": "Bouncing on"}
USING, WALKING, CHATTING, NOBODY, OTHERWISE = "Using", "Walking...", "Chatting with ", "a friend", "Hanging out"
#: Draws are whole multiples of 1/DRAWS.
DRAWS = 1048576


def draw(seed: str, *keys: Column | str) -> Column:
    """A uniform number in [0, 1) that depends on seed and keys alone, not on partitions."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 5), 16, 10).cast("double") / F.lit(float(DRAWS))


def pick(values: Column, u: Column) -> Column:
    """O-75: uniform choice; null from an empty array."""
    return F.try_element_at(values, F.floor(u * F.size(values)).cast("int") + 1)


def mood(hunger: Column, energy: Column, fun: Column, social: Column) -> Column:
    """O-40: great above a mean of 70, fine above 50, low above 32, else awful."""
    mean = (hunger + energy + fun + social) / 4
    return F.when(mean > 70, "great").when(mean > 50, "fine").when(mean > 32, "low").otherwise("awful")


def level_band(value: Column) -> Column:
    """O-16."""
    return F.when(value < 22, "crit").when(value < 45, "low").otherwise("normal")


def need_weights(needs: dict[str, Column], sociability: Column, energy: Column, playfulness: Column) -> dict[str, Column]:
    """How urgent each need is to this character."""
    return {
        "hunger": 100 - needs["hunger"],
        "energy": (100 - needs["energy"]) * (F.lit(1.1) - energy * 0.4),
        "fun": (100 - needs["fun"]) * (F.lit(0.7) + playfulness * 0.6),
        "social": (100 - needs["social"]) * (F.lit(0.5) + sociability * 0.9),
    }


def most_urgent(weights: dict[str, Column]) -> Column:
    """O-41: struct(weight, need); of equal weights the need named first."""
    rows = [F.struct(w.cast("double").alias("weight"), F.lit(-i).alias("place"), F.lit(n).alias("need")) for i, (n, w) in enumerate(weights.items())]
    top = F.array_max(F.array(*rows))
    return F.struct(top["weight"].alias("weight"), top["need"].alias("need"))


def activity(state: Column, partner: Column, anim: Column, label: Column) -> Column:
    """O-14: what a character is doing, in words."""
    verbs = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])
    verb = F.coalesce(F.try_element_at(verbs, anim), F.lit(USING))
    chat = F.concat(F.lit(CHATTING), F.coalesce(partner, F.lit(NOBODY)))
    use = F.concat(verb, F.lit(" the "), label)
    return F.when(state == "walking", WALKING).when(state == "chatting", chat).when((state == "using") & label.isNotNull(), use).otherwise(OTHERWISE)


def clock_text(minutes: Column) -> Column:
    """O-15: 12-hour clock of game minutes."""
    hour = F.floor(minutes / 60).cast("int") % 24
    half = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.format_string("%d:%02d %s", half, F.floor(minutes % 60).cast("int"), F.when(hour >= 12, "PM").otherwise("AM"))


def rgb_hex(color: Column) -> Column:
    """O-13."""
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(color)), 6, "0"))


def game_minutes(real_seconds: Column, speed: Column) -> Column:
    """O-60, O-61: a frame counts 0.1 s at most; ten game minutes a second at speed 1."""
    return F.least(real_seconds, F.lit(0.1)) * speed * 10


def rollover(day: Column, minutes: Column) -> tuple[Column, Column]:
    """O-62: (day, minutes) with minutes below 1440."""
    over = F.floor(minutes / 1440).cast("bigint")
    return day + over, minutes - over * 1440


def daylight(minutes: Column) -> dict[str, Column]:
    """O-70: sun height, share of daylight, lights, and whether the fire shows."""
    height = F.sin((minutes % 1440 / 1440 - 0.25) * F.lit(math.pi) * 2)
    day = F.least(F.greatest(height * 2.2, F.lit(0.0)), F.lit(1.0))
    return {"elev": height, "day_amount": day, "sun": F.lit(0.15) + day * 1.5, "hemi": F.lit(0.25) + day * 0.65, "flame": (1 - day) > 0.25}


def walk_speed(energy: Column) -> Column:
    return F.lit(2.2) + energy * 1.6


def decay_rates(sociability: Column, energy: Column, playfulness: Column, asleep: Column, chatting: Column) -> dict[str, Column]:
    """O-63: points an hour; sleep suspends energy's decay, a chat social's."""
    return {
        "hunger": F.lit(DECAY["hunger"]),
        "energy": F.when(asleep, 0.0).otherwise((F.lit(1.2) - energy * 0.5) * DECAY["energy"]),
        "fun": (F.lit(0.6) + playfulness * 0.7) * DECAY["fun"],
        "social": F.when(chatting, 0.0).otherwise((F.lit(0.5) + sociability * 0.8) * DECAY["social"]),
    }


def after_decay(start: Column, rate: Column, hours: Column) -> Column:
    """O-63 in closed form over a stretch of one state."""
    return F.greatest(F.lit(0.0), start - rate * hours)


def after_gain(start: Column, gain: Column, rate: Column, hours: Column) -> Column:
    """O-64, O-65 in closed form: what is gained less what decays, 100 at most."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), start + (gain - rate) * hours))


def spawn(ordinal: Column, count: Column) -> tuple[Column, Column]:
    """O-10: (x, z) on an ellipse."""
    turn = ordinal / count * F.lit(math.pi) * 2
    return F.cos(turn) * 8, F.sin(turn) * 4 + 10


def wrap_angle(a: Column) -> Column:
    return F.pmod(a + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def distance(x1: Column, z1: Column, x2: Column, z2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (z1 - z2) * (z1 - z2))


def walk_seconds(dist: Column, speed: Column) -> Column:
    """O-72: until within 0.25 of the target, in a straight line."""
    return F.greatest(F.lit(0.0), dist - 0.25) / speed


def speak(lines: Column, category: Column, u: Column) -> Column:
    """O-76: a line of the category, of "idle" where that is missing."""
    return pick(F.coalesce(F.try_element_at(lines, category), F.try_element_at(lines, F.lit("idle"))), u)


# Odds of a remark when a use begins, when one ends, and when a character wanders off.
REMARKS = {"arrived_use": 0.6, "done": 0.35, "wander": 0.25}


def remark(event: Column, need: Column, anim: Column, u: Column) -> Column:
    """The category of the line that an event calls forth; null where nothing is said."""
    begins = F.when(need == "hunger", "hungry").when(anim == "sleep", "tired").otherwise("fun")
    said = F.when(event == "arrived_use", begins).when(event == "done", "fun").when(event == "wander", "idle")
    odds = F.create_map(*[F.lit(x) for pair in REMARKS.items() for x in pair])
    return F.when(u < F.coalesce(F.try_element_at(odds, event), F.lit(0.0)), said)
