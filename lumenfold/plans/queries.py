"""Queries of the engine over the driver's tables, each with its SQL.

The tables stand in for simulation data: customers for characters of a house (eight
neighbouring keys), suppliers for objects, orders for relationship scores, events for commands
and clock readings, conversations for scripted scenes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import derive
from lumenfold.operators import choice, commands, movement, occupancy, pairing, scan, segments, snapshot, timeline, toggles
from lumenfold.sources import catalog
from lumenfold.streaming import live, timers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Customers as characters, in terms both engines read alike.
ENTITY = """c_custkey AS id, cast(floor(c_custkey / 8) AS bigint) AS house, c_custkey AS ordinal,
  CASE c_custkey % 4 WHEN 0 THEN 'idle' WHEN 1 THEN 'walking' WHEN 2 THEN 'using' ELSE 'chatting' END AS state,
  CASE WHEN c_custkey % 4 = 3 THEN c_custkey + 4 END AS partner,
  cast((c_custkey * 37) % 101 AS double) AS hunger, cast((c_custkey * 53) % 101 AS double) AS energy,
  cast((c_custkey * 71) % 101 AS double) AS fun, cast((c_custkey * 89) % 101 AS double) AS social,
  cast((c_custkey * 13) % 21 AS double) / 20 AS sociability, cast((c_custkey * 17) % 21 AS double) / 20 AS trait_energy,
  cast((c_custkey * 19) % 21 AS double) / 20 AS playfulness, cast((c_custkey * 23) % 21 AS double) / 20 AS tidy,
  cast((c_custkey * 29) % 53 AS double) - 26 AS x, cast((c_custkey * 31) % 37 AS double) - 14 AS z"""
ENTITIES = f"(SELECT {ENTITY} FROM customer)"
#: Part as objects in use, events as a clock.
CLOCK = "(SELECT event_id, value, value * 7.5 AS minutes FROM events)"


def entities(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").selectExpr(*_split(ENTITY))


def _split(sql: str) -> list[str]:
    """Column expressions of a select list; commas within brackets don't count."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(sql):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(sql[last:i])
            last = i + 1
    return [*out, sql[last:]]


def clock(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", "value", (F.col("value") * F.lit(7.5)).alias("minutes"))


def _values(rows: list[tuple]) -> str:
    def lit(x):
        return "NULL" if x is None else "[" + ", ".join(map(lit, x)) + "]" if isinstance(x, list) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return "VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


CAST_VALUES = _values([(i, *r[:6], *r[6], r[7]) for i, r in enumerate(catalog.CAST)])
OBJECT_VALUES = _values([(i, *r) for i, r in enumerate(catalog.OBJECTS)])


def _draw_sql(seed: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"cast({k} AS VARCHAR)" for k in keys]])
    return f"(('0x' || substr(md5({text}), 1, 5))::BIGINT / 1048576.0)"


@query("""SELECT conv_id, turn, role, 3.0 + coalesce(sum(2.4::DOUBLE + least(2.5::DOUBLE, length(coalesce(text, '')) * 0.045::DOUBLE))
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_s FROM conversations""")
def scripted_timeline(spark, d):
    """O-69."""
    return timeline.timeline(_t(spark, d, "conversations"), "conv_id").select("conv_id", "turn", "role", "start_s")


@query(f"""SELECT id, CASE WHEN (hunger + energy + fun + social) / 4 > 70 THEN 'great' WHEN (hunger + energy + fun + social) / 4 > 50 THEN 'fine'
  WHEN (hunger + energy + fun + social) / 4 > 32 THEN 'low' ELSE 'awful' END AS mood,
  CASE WHEN hunger < 22 THEN 'crit' WHEN hunger < 45 THEN 'low' ELSE 'normal' END AS band FROM {ENTITIES}""")
def score_band(spark, d):
    """O-40, O-16."""
    e = entities(spark, d)
    return e.select("id", derive.mood(*[F.col(n) for n in catalog.NEEDS]).alias("mood"), derive.level_band(F.col("hunger")).alias("band"))


_W = f"""(SELECT *, 100 - hunger AS wh, (100 - energy) * (1.1::DOUBLE - trait_energy * 0.4::DOUBLE) AS we,
  (100 - fun) * (0.7::DOUBLE + playfulness * 0.6::DOUBLE) AS wf, (100 - social) * (0.5::DOUBLE + sociability * 0.9::DOUBLE) AS ws FROM {ENTITIES})"""
_TOP = f"""(SELECT *, greatest(wh, we, wf, ws) AS weight,
  CASE WHEN wh >= we AND wh >= wf AND wh >= ws THEN 'hunger' WHEN we >= wf AND we >= ws THEN 'energy' WHEN wf >= ws THEN 'fun' ELSE 'social' END AS need FROM {_W})"""


def _weights():
    return derive.need_weights({n: F.col(n) for n in catalog.NEEDS}, F.col("sociability"), F.col("trait_energy"), F.col("playfulness"))


@query(f"SELECT id, weight, need FROM {_TOP}")
def argmax_first_tie(spark, d):
    """O-41."""
    return entities(spark, d).select("id", derive.most_urgent(_weights()).alias("t")).select("id", "t.weight", "t.need")


@query("""SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS n FROM
  (SELECT o_custkey AS src, o_orderkey AS dst, o_totalprice / 10000 AS score FROM orders) WHERE score > 4) WHERE n = 1""")
def top1_over_threshold(spark, d):
    """O-42, O-50."""
    s = _t(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), (F.col("o_totalprice") / 10000).alias("score"), F.col("o_orderkey").alias("ordinal"))
    return choice.top_friend(s).select("src", "dst", "score")


@query("""WITH j AS (SELECT s_nationkey AS house, s_suppkey AS id, (s_acctbal > 5000)::INT AS fav FROM supplier)
SELECT house, id FROM (SELECT *, max(fav) OVER (PARTITION BY house) AS best FROM j) WHERE fav = best""")
def prefer_fallback(spark, d):
    """O-23."""
    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("house"), F.col("s_suppkey").alias("id"), "s_acctbal")
    return choice.prefer(s, ["house"], F.col("s_acctbal") > 5000).select("house", "id")


@query(f"""SELECT id, greatest(0::DOUBLE, hunger - 4.5::DOUBLE * 6) AS hunger_end,
  greatest(0::DOUBLE, energy - (1.2::DOUBLE - trait_energy * 0.5::DOUBLE) * 3.2::DOUBLE * 6) AS energy_end,
  greatest(0::DOUBLE, fun - (0.6::DOUBLE + playfulness * 0.7::DOUBLE) * 5.0::DOUBLE * 6) AS fun_end,
  greatest(0::DOUBLE, social - (0.5::DOUBLE + sociability * 0.8::DOUBLE) * 4.2::DOUBLE * 6) AS social_end FROM {ENTITIES}""")
def linear_decay(spark, d):
    """O-63."""
    no = F.lit(False)
    rates = derive.decay_rates(F.col("sociability"), F.col("trait_energy"), F.col("playfulness"), no, no)
    return entities(spark, d).select("id", *[derive.after_decay(F.col(n), r, F.lit(6.0)).alias(f"{n}_end") for n, r in rates.items()])


@query(f"""WITH e AS (SELECT *, CASE WHEN state = 'using' THEN CASE id % 3 WHEN 0 THEN 'sleep' WHEN 1 THEN 'sit' ELSE 'stand' END END AS anim,
  CASE WHEN state = 'using' THEN CASE id % 3 WHEN 0 THEN 'energy' WHEN 1 THEN 'fun' ELSE 'hunger' END END AS need FROM {ENTITIES}),
r AS (SELECT *, 4.5::DOUBLE AS rh, CASE WHEN anim = 'sleep' THEN 0 ELSE (1.2::DOUBLE - trait_energy * 0.5::DOUBLE) * 3.2::DOUBLE END AS re,
  (0.6::DOUBLE + playfulness * 0.7::DOUBLE) * 5.0::DOUBLE AS rf, CASE WHEN state = 'chatting' THEN 0 ELSE (0.5::DOUBLE + sociability * 0.8::DOUBLE) * 4.2::DOUBLE END AS rs FROM e)
SELECT id, least(100::DOUBLE, greatest(0::DOUBLE, hunger + (CASE WHEN need = 'hunger' THEN 30::DOUBLE ELSE 0 END - rh) * 2)) AS hunger_end,
  least(100::DOUBLE, greatest(0::DOUBLE, energy + (CASE WHEN need = 'energy' THEN 30::DOUBLE ELSE 0 END - re) * 2)) AS energy_end,
  least(100::DOUBLE, greatest(0::DOUBLE, fun + (CASE WHEN state = 'chatting' THEN 8::DOUBLE WHEN need = 'fun' THEN 30::DOUBLE ELSE 0 END - rf) * 2)) AS fun_end,
  least(100::DOUBLE, greatest(0::DOUBLE, social + (CASE WHEN state = 'chatting' THEN 32::DOUBLE ELSE 0 END - rs) * 2)) AS social_end FROM r""")
def gain_capped(spark, d):
    """O-63..O-65."""
    kind = lambda a, b, c: F.when(F.col("state") == "using", F.when(F.col("id") % 3 == 0, a).when(F.col("id") % 3 == 1, b).otherwise(c))
    s = entities(spark, d).withColumns({"anim": kind("sleep", "sit", "stand"), "need": kind("energy", "fun", "hunger"), "rate": F.lit(30.0), "hours": F.lit(2.0)})
    return segments.evolve(s).select("id", *[f"{n}_end" for n in catalog.NEEDS])


@query(f"""SELECT event_id, concat(CASE WHEN floor(minutes / 60)::INT % 24 % 12 = 0 THEN 12 ELSE floor(minutes / 60)::INT % 24 % 12 END, ':',
  lpad(floor(minutes % 60)::INT::VARCHAR, 2, '0'), ' ', CASE WHEN floor(minutes / 60)::INT % 24 >= 12 THEN 'PM' ELSE 'AM' END) AS clock FROM {CLOCK}""")
def clock_12h(spark, d):
    """O-15."""
    return clock(spark, d).select("event_id", derive.clock_text(F.col("minutes")).alias("clock"))


@query(f"""SELECT event_id, 1 + floor(minutes / 1440)::BIGINT AS day, minutes - floor(minutes / 1440)::BIGINT * 1440 AS minute_of_day,
  least(value, 0.1::DOUBLE) * 3 * 10 AS frame_minutes FROM {CLOCK}""")
def day_rollover(spark, d):
    """O-60..O-62."""
    day, left = derive.rollover(F.lit(1), F.col("minutes"))
    return clock(spark, d).select("event_id", day.alias("day"), left.alias("minute_of_day"), derive.game_minutes(F.col("value"), F.lit(3)).alias("frame_minutes"))


@query(f"""WITH h AS (SELECT event_id, sin((minutes % 1440 / 1440 - 0.25::DOUBLE) * pi() * 2) AS elev FROM {CLOCK}),
a AS (SELECT *, least(greatest(elev * 2.2::DOUBLE, 0::DOUBLE), 1::DOUBLE) AS day_amount FROM h)
SELECT event_id, round(elev, 9) AS elev, round(day_amount, 9) AS day_amount, round(0.15::DOUBLE + day_amount * 1.5::DOUBLE, 9) AS sun,
  round(0.25::DOUBLE + day_amount * 0.65::DOUBLE, 9) AS hemi, 1 - day_amount > 0.25::DOUBLE AS flame FROM a""")
def day_night(spark, d):
    """O-70."""
    light = derive.daylight(F.col("minutes"))
    return clock(spark, d).select("event_id", *[(c if n == "flame" else F.round(c, 9)).alias(n) for n, c in light.items()])


@query("SELECT p_partkey, '#' || lpad(lower(to_hex(p_partkey * 7919 % 16777216)), 6, '0') AS color FROM part")
def rgb_hex(spark, d):
    """O-13."""
    return _t(spark, d, "part").select("p_partkey", derive.rgb_hex(F.col("p_partkey") * 7919 % 16777216).alias("color"))


_HITS = """(SELECT user_id AS click, event_id AS hit_no, CASE event_id % 4 WHEN 0 THEN 'entity' WHEN 1 THEN 'object' WHEN 2 THEN 'ground' ELSE 'wall' END AS kind, value > 30 AS selected FROM events)"""


@query(f"""SELECT click, hit_no, kind FROM (SELECT *, row_number() OVER (PARTITION BY click ORDER BY hit_no) AS n FROM {_HITS}
  WHERE kind = 'entity' OR kind IN ('object', 'ground') AND selected) WHERE n = 1""")
def hit_precedence(spark, d):
    """O-26."""
    e, k = _t(spark, d, "events"), F.col("event_id") % 4
    kind = F.when(k == 0, "entity").when(k == 1, "object").when(k == 2, "ground").otherwise("wall")
    return commands.first_hit(e.select(F.col("user_id").alias("click"), F.col("event_id").alias("hit_no"), kind.alias("kind"), (F.col("value") > 30).alias("selected"))).select("click", "hit_no", "kind")


@query(f"""SELECT a.house, a.id, b.id AS other FROM {ENTITIES} a JOIN {ENTITIES} b ON a.house = b.house AND a.id <> b.id
  WHERE b.partner IS NULL AND b.state <> 'using'""")
def eligible_pairs(spark, d):
    """O-24."""
    return choice.chat_pairs(entities(spark, d)).select("house", "id", "other")


@query("""SELECT n_nationkey AS house, count(s_suppkey) AS users FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 0
  GROUP BY n_nationkey HAVING count(s_suppkey) < 4""")
def open_occupancy(spark, d):
    """O-44, O-22."""
    o = _t(spark, d, "nation").select(F.col("n_nationkey").alias("house"), F.lit("spot").alias("id"), F.lit(4).alias("capacity"))
    u = _t(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("house"), F.lit("spot").alias("object_id"))
    return choice.available(o, u).select("house", "users")


@query("""SELECT least(l_suppkey % 8, l_partkey % 8) AS lo, greatest(l_suppkey % 8, l_partkey % 8) AS hi, round(sum(l_quantity * 2.2::DOUBLE), 3) AS score
  FROM lineitem WHERE l_suppkey % 8 <> l_partkey % 8 GROUP BY 1, 2""")
def pair_affinity(spark, d):
    """O-30, O-43."""
    lo, hi = choice.unordered("a", "b")
    c = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("a"), (F.col("l_partkey") % 8).alias("b"), F.col("l_quantity").alias("hours")).where("a <> b")
    return segments.affinity(c.select(lo.alias("src"), hi.alias("dst"), "hours")).select(F.col("src").alias("lo"), F.col("dst").alias("hi"), F.round("score", 3).alias("score"))


@query("""SELECT user_id, bucket, event_id FROM (SELECT user_id, event_id, floor(event_id / 20)::BIGINT AS bucket,
  row_number() OVER (PARTITION BY user_id, floor(event_id / 20) ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_snapshot(spark, d):
    """O-04."""
    return snapshot.latest(_t(spark, d, "events"), "user_id", "event_id").select("user_id", "bucket", "event_id")


_OBJ = f"(SELECT id AS object_id, label, anim FROM ({OBJECT_VALUES}) o(ordinal, id, label, sx, sz, fx, fz, need, rate, anim, cap))"


@query(f"""WITH p AS (SELECT a.house, a.id, b.id AS other, b.ordinal AS oo, ((a.id * 7 + b.id * 3) % 11)::DOUBLE AS score FROM {ENTITIES} a JOIN {ENTITIES} b ON a.house = b.house AND a.id <> b.id
  WHERE b.partner IS NULL AND b.state <> 'using'),
r AS (SELECT *, row_number() OVER (PARTITION BY house, id ORDER BY score DESC, oo) AS k, count(*) OVER (PARTITION BY house, id) AS n FROM p)
SELECT house, id, other FROM r WHERE k = CASE WHEN {_draw_sql('s', 'house', 'id', "'top'")} < 0.7 THEN 1 ELSE floor({_draw_sql('s', 'house', 'id', "'any'")} * n)::BIGINT + 1 END""")
def partner_choice(spark, d):
    """O-50, O-51."""
    pairs = choice.chat_pairs(entities(spark, d)).withColumn("score", ((F.col("id") * 7 + F.col("other") * 3) % 11).cast("double"))
    return choice.choose_partner(pairs, "s").select("house", "id", "other")


@query(f"""WITH u AS (SELECT *, {_draw_sql('w', 'id')} AS u, {_draw_sql('x', 'id')} AS v FROM {_TOP} t)
SELECT id, weight < 35 OR (u > tidy AND weight < 55) AS wanders, (u - 0.5) * 40 AS x, (v - 0.5) * 30 AS z,
  CASE WHEN id % 2 = 0 THEN CASE floor(u * 2)::INT WHEN 0 THEN 'd' ELSE 'e' END
    ELSE CASE floor(u * 3)::INT WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END END AS line FROM u""")
def wander_and_speak(spark, d):
    """O-73, O-75, O-76."""
    e = entities(spark, d).withColumn("t", derive.most_urgent(_weights())).withColumns({"u": derive.draw("w", "id"), "v": derive.draw("x", "id")})
    x, z = choice.wander_target(F.col("u"), F.col("v"))
    idle, fun = (F.array(*map(F.lit, x)) for x in ("abc", "de"))
    lines = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("idle"), idle, F.lit("fun"), fun)).otherwise(F.create_map(F.lit("idle"), idle))
    return e.select("id", choice.wander(F.col("t.weight"), F.col("tidy"), F.col("u")).alias("wanders"), x.alias("x"), z.alias("z"), derive.speak(lines, F.lit("fun"), F.col("u")).alias("line"))


_FAV = f"(SELECT ordinal AS fav_at, favorites FROM ({CAST_VALUES}) c(ordinal, id, l, m, s, h, k, so, en, pl, tidy, favorites))"


@query(f"""WITH e AS (SELECT t.*, f.favorites, {_draw_sql('d', 'house', 'id', "'wander'")} AS uw FROM {_TOP} t JOIN {_FAV} f ON t.id % 8 = f.fav_at),
p AS (SELECT a.house, a.id, b.id AS other, row_number() OVER (PARTITION BY a.house, a.id ORDER BY (a.id * 7 + b.id * 3) % 11 DESC, b.ordinal) AS k, count(*) OVER (PARTITION BY a.house, a.id) AS n
  FROM {ENTITIES} a JOIN {ENTITIES} b ON a.house = b.house AND a.id <> b.id WHERE b.partner IS NULL AND b.state <> 'using'),
q AS (SELECT house, id, other FROM p WHERE k = CASE WHEN {_draw_sql('d', 'house', 'id', "'top'")} < 0.7 THEN 1 ELSE floor({_draw_sql('d', 'house', 'id', "'any'")} * n)::BIGINT + 1 END),
w AS (SELECT e.* EXCLUDE (need), q.other, weight < 35 OR (uw > tidy AND weight < 55) AS wan, CASE WHEN need = 'social' AND q.other IS NULL THEN 'fun' ELSE need END AS need FROM e LEFT JOIN q USING (house, id)),
o AS (SELECT ordinal AS oo, id AS object_id, need, cap FROM ({OBJECT_VALUES}) o(ordinal, id, label, sx, sz, fx, fz, need, rate, anim, cap)),
c AS (SELECT house, id, object_id, oo, list_contains(favorites, object_id)::INT AS fav FROM w JOIN o USING (need) WHERE NOT wan AND (house + oo) % 3 < cap),
b AS (SELECT * FROM (SELECT *, max(fav) OVER (PARTITION BY house, id) AS best FROM c) WHERE fav = best),
n AS (SELECT *, row_number() OVER (PARTITION BY house, id ORDER BY oo) AS k, count(*) OVER (PARTITION BY house, id) AS n FROM b),
g AS (SELECT house, id, object_id FROM n WHERE k = floor({_draw_sql('d', 'house', 'id', "'object'")} * n)::BIGINT + 1)
SELECT house, id, need, CASE WHEN wan THEN 'wander' WHEN need = 'social' THEN 'chat' WHEN object_id IS NOT NULL THEN 'use' ELSE 'idle' END AS action,
  CASE WHEN NOT wan AND need = 'social' THEN other END AS other, object_id FROM w LEFT JOIN g USING (house, id)""")
def decisions(spark, d):
    """O-74 and all it is made of."""
    fav = catalog.cast(spark).select(F.col("ordinal").alias("at"), "favorites")
    e = entities(spark, d).withColumnRenamed("tidy", "order").withColumn("at", F.col("id") % 8).join(F.broadcast(fav), "at")
    # every object of every house has (house + ordinal) % 3 users
    every = [F.struct(F.lit(i).alias("ordinal"), F.lit(o[0]).alias("id"), F.lit(o[6]).alias("need"), F.lit(o[9]).alias("capacity")) for i, o in enumerate(catalog.OBJECTS)]
    spots = e.select("house").distinct().select("house", F.explode(F.array(*every)).alias("o")).select("house", "o.*")
    users = spots.select("house", F.col("id").alias("object_id"), F.explode(F.expr("array_repeat(0, cast((house + ordinal) % 3 as int))")))
    # keys of a house are neighbours, so its pairs need no join
    others = e.select("house", "id", F.explode(F.sequence(F.col("house") * 8, F.col("house") * 8 + 7)).alias("other")).where("id <> other")
    scores = others.withColumn("score", ((F.col("id") * 7 + F.col("other") * 3) % 11).cast("double"))
    return choice.decide(e, choice.available(spots, users), scores, "d").select("house", "id", "need", "action", "other", "object_id")


_EVENTS = """CASE id % 6 WHEN 0 THEN 'decided' WHEN 1 THEN 'arrived_use' WHEN 2 THEN 'done' WHEN 3 THEN 'move' WHEN 4 THEN 'visited' ELSE 'released' END"""


@query(f"""SELECT id, CASE WHEN event = 'move' THEN 'walking' WHEN event = 'decided' AND id % 7 = 0 THEN state WHEN state = 'idle' AND event = 'decided' THEN 'walking'
  WHEN state = 'walking' AND event = 'arrived_use' THEN 'using' WHEN state IN ('idle', 'walking') AND event = 'visited' THEN 'chatting' WHEN state IN ('using', 'chatting') AND event = 'done' THEN 'idle' ELSE state END AS next_state
  FROM (SELECT *, {_EVENTS} AS event FROM {ENTITIES})""")
def state_transitions(spark, d):
    """O-66, O-77, O-79."""
    e = entities(spark, d).withColumn("event", F.expr(_EVENTS)).withColumn("free_will", F.col("id") % 7 != 0)
    return segments.next_state(e).select("id", "next_state")


@query(f"""SELECT id, round(greatest(0, sqrt(x * x + z * z) - 0.25) / (2.2 + trait_energy * 1.6), 9) AS walk_s,
  least(greatest(x * 2, -26), 26) AS ground_x, least(greatest(z * 2, -14), 22) AS ground_z, id % 3 >= 1 + id % 2 AS refused FROM {ENTITIES}""")
def movement_and_guards(spark, d):
    """O-72, O-78, O-27."""
    e = entities(spark, d)
    gx, gz = commands.clamp_ground(F.col("x") * 2, F.col("z") * 2)
    far = derive.distance(F.col("x"), F.col("z"), F.lit(0.0), F.lit(0.0))
    g = commands.guard_capacity(e.withColumns({"users": F.col("id") % 3, "capacity": 1 + F.col("id") % 2, "label": F.lit("Sofa")}))
    return g.select("id", F.round(derive.walk_seconds(far, derive.walk_speed(F.col("trait_energy"))), 9).alias("walk_s"), gx.alias("ground_x"), gz.alias("ground_z"), (~F.col("accepted")).alias("refused"))


@query(f"SELECT house, id, hunger, cast((id * 11) % 100 AS DOUBLE) AS energy, x + 1 AS x FROM {ENTITIES} WHERE id % 2 = 0 UNION ALL SELECT house, id, hunger, energy, x FROM {ENTITIES} WHERE id % 2 = 1")
def save_and_restore(spark, d):
    """O-03, O-05, O-11, O-32: all characters come back from documents, half of them changed."""
    e = entities(spark, d).withColumn("name", F.col("id").cast("string"))
    needs = F.create_map(*[x for n in catalog.NEEDS for x in (F.lit(n), F.col(n))])
    live = e.select("house", "ordinal", F.col("name").alias("id"), needs.alias("needs"), F.expr("cast(map() as map<string,double>)").alias("rel"), "x", "z")
    # changed ones save a single need, so the live ones of the others stay
    even = F.col("ordinal") % 2 == 0
    energy = F.create_map(F.lit("energy"), (F.col("ordinal") * 11 % 100).cast("double"))
    gone = live.withColumn("needs", F.when(even, energy).otherwise(F.col("needs"))).withColumn("x", F.when(even, F.col("x") + 1).otherwise(F.col("x")))
    times = e.groupBy("house").agg(F.lit(480.0).alias("game_minutes"), F.lit(2).alias("day"))
    back = snapshot.restore(live, snapshot.parse(snapshot.save(gone, times)))
    return back.select("house", F.col("id").cast("bigint").alias("id"), F.col("needs")["hunger"].alias("hunger"), F.col("needs")["energy"].alias("energy"), "x")


#: One document a house, of each kind that loading meets: no rel and some needs; no sims; malformed; an id
#: twice; x that is no number; an unknown id and a null clock field.
_SAVE = """CASE house % 6
  WHEN 0 THEN '{"gameMinutes":600.5,"sims":[{"id":"' || first || '","needs":{"fun":9.5},"x":1.5,"z":2}]}'
  WHEN 1 THEN '{"day":3}'
  WHEN 2 THEN '{"day":3,'
  WHEN 3 THEN '{"sims":[{"id":"' || first || '","needs":{"fun":1,"hunger":2},"rel":{"a":1},"x":3,"z":4},{"id":"' || first || '","needs":{"fun":7},"rel":{"a":1,"b":2}}]}'
  WHEN 4 THEN '{"day":9,"sims":[{"id":"' || first || '","rel":{"c":5},"x":"no","z":4}]}'
  ELSE '{"day":null,"sims":[{"id":"ghost","needs":{"fun":1}}]}' END"""


@query(f"""WITH e AS (SELECT *, min(id) OVER (PARTITION BY house) AS first FROM {ENTITIES}),
h AS (SELECT *, id = first AND house % 6 IN (0, 3, 4) AS saved FROM e)
SELECT house, id, CASE WHEN saved AND house % 6 = 0 THEN 9.5 WHEN saved AND house % 6 = 3 THEN 7 ELSE fun END AS fun,
  CASE WHEN saved AND house % 6 = 3 THEN 2 ELSE hunger END AS hunger,
  CASE WHEN NOT saved THEN 1 WHEN house % 6 = 0 THEN 0 WHEN house % 6 = 3 THEN 2 ELSE 1 END AS n_rel,
  CASE WHEN saved AND house % 6 = 0 THEN 1.5 WHEN saved AND house % 6 = 3 THEN 3 ELSE x END AS x,
  CASE WHEN saved AND house % 6 = 0 THEN 2 WHEN saved AND house % 6 = 3 THEN 4 ELSE z END AS z,
  house % 6 <> 2 AS ok, CASE house % 6 WHEN 0 THEN 600.5 ELSE 480 END AS game_minutes, CASE house % 6 WHEN 1 THEN 3 WHEN 4 THEN 9 ELSE 1 END AS day FROM h""")
def load_cases(spark, d):
    """O-05, O-32: documents as they come."""
    e = entities(spark, d).withColumn("name", F.col("id").cast("string"))
    needs = F.create_map(*[x for n in catalog.NEEDS for x in (F.lit(n), F.col(n))])
    live = e.select("house", F.col("name").alias("id"), needs.alias("needs"), F.create_map(F.lit("live"), F.lit(1.0)).alias("rel"), "x", "z")
    saves = e.groupBy("house").agg(F.min("id").cast("string").alias("first")).select("house", F.expr(_SAVE).alias("document"))
    parsed = snapshot.parse(saves)
    back = snapshot.restore(live, parsed).join(parsed.select("house", "ok", "game_minutes", "day"), "house")
    return back.select("house", F.col("id").cast("bigint").alias("id"), F.col("needs")["fun"].alias("fun"), F.col("needs")["hunger"].alias("hunger"), F.size("rel").cast("bigint").alias("n_rel"), "x", "z", "ok", "game_minutes", "day")


@query(f"""WITH e AS (SELECT id, id % 3 = 0 AS asleep, CASE id % 3 WHEN 0 THEN energy WHEN 1 THEN fun ELSE hunger END AS start,
  30::DOUBLE - CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN (0.6::DOUBLE + playfulness * 0.7::DOUBLE) * 5.0::DOUBLE ELSE 4.5::DOUBLE END AS net,
  (45 + {_draw_sql('use', 'id')} * 40) / 60 AS planned FROM {ENTITIES})
SELECT id, round(CASE WHEN asleep THEN greatest(0, (96 - start) / net) ELSE least(planned, greatest(0, (98 - start) / net)) END, 9) AS hours FROM e""")
def use_ends(spark, d):
    """O-64: when the use of an object ends."""
    kind = lambda a, b, c: F.when(F.col("id") % 3 == 0, a).when(F.col("id") % 3 == 1, b).otherwise(c)
    e = entities(spark, d).withColumn("asleep", F.col("id") % 3 == 0)
    rates = derive.decay_rates(F.col("sociability"), F.col("trait_energy"), F.col("playfulness"), F.col("asleep"), F.lit(False))
    net = F.lit(30.0) - kind(rates["energy"], rates["fun"], rates["hunger"])
    planned = (45 + derive.draw("use", "id") * 40) / 60
    return e.select("id", F.round(segments.use_hours(kind(F.col("energy"), F.col("fun"), F.col("hunger")), net, F.col("asleep"), planned), 9).alias("hours"))


@query(f"""WITH c AS (SELECT house, id AS a, partner AS b FROM {ENTITIES} WHERE state = 'chatting'),
k AS (SELECT *, (a + b) % 3 = 0 AND {_draw_sql('c', 'house', 'a', 'b', "'own'")} < 0.65 AS own, CASE WHEN (a + b) % 2 = 0 THEN a ELSE b END AS opens,
  floor({_draw_sql('c', 'house', 'a', 'b', "'line'")} * 2)::INT AS n FROM c)
SELECT house, a, b, CASE WHEN own THEN opens ELSE a END AS first_speaker, CASE WHEN own AND opens = a OR NOT own THEN b ELSE a END AS second_speaker,
  CASE WHEN own THEN 'first ' || n END AS first, CASE WHEN own THEN 'second ' || n END AS second,
  CASE WHEN NOT own THEN 'greet' END AS category, CASE WHEN NOT own THEN 'idle' END AS reply_category, CASE WHEN own THEN 2.6 ELSE 2.4 END AS reply_s FROM k""")
def chat_dialogue(spark, d):
    """O-30, O-68: who says what when a chat begins."""
    c = entities(spark, d).where("state = 'chatting'").select("house", F.col("id").alias("a"), F.col("partner").alias("b"))
    turn = (F.col("a") + F.col("b")) % 2 == 0
    pair = c.where((F.col("a") + F.col("b")) % 3 == 0).select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("b"))
    n = F.explode(F.array(F.lit(0), F.lit(1))).alias("n")
    lines = pair.select("a", "b", n).select("a", "b", "n", F.concat(F.lit("first "), "n").alias("first"), F.concat(F.lit("second "), "n").alias("second"))
    return choice.dialogue(c, lines, "c")


@query("""WITH k AS (SELECT event_id, list_extract(['1', '4', '8', '9', '0', ' ', 'g', 'G', 'f', 'F', 'q', ''], (event_id % 12 + 1)::INT) AS key FROM events)
SELECT event_id, key, CASE WHEN key BETWEEN '1' AND '8' AND length(key) = 1 THEN 'select:' || (key::INT - 1) WHEN key = ' ' THEN 'pause'
  WHEN lower(key) = 'g' THEN 'gather' WHEN lower(key) = 'f' THEN 'follow' END AS command FROM k""")
def key_commands(spark, d):
    """O-06."""
    keys = F.array(*map(F.lit, ["1", "4", "8", "9", "0", " ", "g", "G", "f", "F", "q", ""]))
    e = _t(spark, d, "events").select("event_id", F.element_at(keys, (F.col("event_id") % 12 + 1).cast("int")).alias("key"))
    return e.select("event_id", "key", commands.parse_command(F.col("key")).alias("command"))


@query("""WITH a AS (SELECT event_id, value, value - 50 AS turn, atan2(value - 30, 20 - value) AS heading FROM events)
SELECT event_id, round(turn - 2 * pi() * floor((turn + pi()) / (2 * pi())), 6) AS wrapped, round(heading, 6) AS heading,
  round(abs(turn) + (value - abs(turn)) * 0.25, 6) AS eased FROM a""")
def angle_and_lerp(spark, d):
    """Turning to a heading by the shorter way, and easing between two values."""
    v = F.col("value")
    return _t(spark, d, "events").select(
        "event_id", F.round(derive.wrap_angle(v - 50), 6).alias("wrapped"), F.round(F.atan2(v - 30, 20 - v), 6).alias("heading"),
        F.round(derive.lerp(F.abs(v - 50), v, F.lit(0.25)), 6).alias("eased"),
    )


_SEAT = ", ".join(f"({i}, 0::DOUBLE + cos({i} / 8.0 * pi() * 2) * 3, 16 + sin({i} / 8.0 * pi() * 2) * 3)" for i in range(8))


@query(f"""WITH RECURSIVE seat(seat_id, sx, sz) AS (VALUES {_SEAT}),
e AS (SELECT *, row_number() OVER (PARTITION BY house ORDER BY ordinal) AS k FROM {ENTITIES}),
walk(house, k, id, seat_id, taken) AS (
  SELECT house, 0::BIGINT, NULL::BIGINT, NULL::INT, []::INT[] FROM (SELECT DISTINCT house FROM e)
  UNION ALL
  SELECT w.house, e.k, e.id, b.seat_id, CASE WHEN b.seat_id IS NULL THEN w.taken ELSE list_append(w.taken, b.seat_id) END
  FROM walk w JOIN e ON e.house = w.house AND e.k = w.k + 1,
  LATERAL (SELECT arg_min(seat_id, (sx - e.x) * (sx - e.x) + (sz - e.z) * (sz - e.z)) AS seat_id FROM seat WHERE NOT list_contains(w.taken, seat_id)) b)
SELECT house, id, seat_id FROM walk WHERE k > 0""")
def greedy_seats(spark, d):
    """O-34, O-52."""
    return choice.seat_greedily(entities(spark, d), catalog.seats(spark)).select("house", "id", "seat_id")


@query(ORACLE_SQL["greedy_seats"].rpartition("SELECT")[0] + f"""SELECT w.house, w.id, w.seat_id, round(sx, 9) + 0.0 AS x, round(sz, 9) AS z, 'walking' AS next_state,
  e.state = 'using' AS released, e.state = 'chatting' AS parted FROM walk w JOIN e USING (house, id) LEFT JOIN seat USING (seat_id) WHERE w.k > 0""")
def gather_rows(spark, d):
    """O-77: everyone of a house to a seat, and what that ends."""
    g = commands.gather(entities(spark, d), catalog.seats(spark))
    return g.withColumn("x", F.round("x", 9) + F.lit(0.0)).withColumn("z", F.round("z", 9))


@query(f"""WITH c(ordinal, name, latin, mbti, shirt, hair, skin, so, en, pl, tidy, favorites) AS ({CAST_VALUES}),
n AS (SELECT cast(floor(c_custkey / 8) AS BIGINT) AS house, c_custkey AS id, c_custkey % 8 AS ordinal, count(*) OVER (PARTITION BY floor(c_custkey / 8)) AS n FROM customer)
SELECT id, house, name, mbti, shirt, round(so, 6)::DOUBLE AS sociability, round(2.2::DOUBLE + en * 1.6::DOUBLE, 6) AS speed,
  round(cos(2 * pi() * ordinal / n) * 8, 6) + 0.0 AS x, round(10 + sin(2 * pi() * ordinal / n) * 4, 6) + 0.0 AS z, len(favorites) AS n_favorites FROM n JOIN c USING (ordinal)""")
def cast_table(spark, d):
    """O-01, O-10, O-12: every customer in the part of one of the cast, spread over the house's lot."""
    e = _t(spark, d, "customer").select(F.floor(F.col("c_custkey") / 8).cast("bigint").alias("house"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 8).cast("int").alias("ordinal"))
    e = e.withColumn("n", F.count("*").over(Window.partitionBy("house")))
    x, z = derive.spawn(F.col("ordinal"), F.col("n"))
    c = catalog.by_id(e, catalog.cast(spark).withColumnRenamed("id", "name"), ["ordinal"])
    return c.select("id", "house", "name", "mbti", "shirt", F.col("traits.sociability"), F.round(derive.walk_speed(F.col("traits.energy")), 6).alias("speed"), (F.round(x, 6) + F.lit(0.0)).alias("x"), (F.round(z, 6) + F.lit(0.0)).alias("z"), F.size("favorites").cast("bigint").alias("n_favorites"))


@query("""WITH o AS (SELECT s_nationkey AS house, s_name AS label, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS ordinal FROM supplier),
n AS (SELECT c_nationkey AS house, c_name AS label, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer WHERE c_mktsegment = 'MACHINERY'),
t AS (SELECT house, max(ordinal) AS top FROM o GROUP BY house)
SELECT * FROM o UNION ALL SELECT house, label, (coalesce(top, -1) + k)::INT FROM n LEFT JOIN t USING (house)""")
def object_table(spark, d):
    """O-02: objects registered in each house behind those it has."""
    w = Window.partitionBy("house").orderBy("s_suppkey")
    have = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("house"), "s_suppkey", F.col("s_name").alias("label"))
    have = have.select("house", "label", (F.row_number().over(w) - 1).alias("ordinal"))
    new = _t(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_nationkey").alias("house"), F.col("c_name").alias("label"), F.col("c_custkey").alias("key"))
    return catalog.register(have.withColumn("key", F.lit(None).cast("bigint")), new, ["house"], ["key"]).select("house", "label", "ordinal")


@query(f"""WITH o(oo, object_id, label, sx, sz, fx, fz, need, rate, anim, cap) AS ({OBJECT_VALUES}),
f AS (SELECT ordinal, favorites FROM ({CAST_VALUES}) c(ordinal, id, l, m, s, h, k, so, en, pl, tidy, favorites)),
j AS (SELECT c_custkey AS id, o.need, o.object_id, list_contains(favorites, o.object_id)::INT AS fav FROM customer JOIN f ON c_custkey % 8 = ordinal, o)
SELECT id, need, object_id FROM (SELECT *, max(fav) OVER (PARTITION BY id, need) AS best FROM j) WHERE fav = best""")
def prefer_favorites(spark, d):
    """O-23, O-33: of every customer's objects for each need the favorites, else all."""
    e = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 8).cast("int").alias("ordinal"))
    c = catalog.by_id(e, catalog.cast(spark).select("ordinal", "favorites"), ["ordinal"]).select("id", "favorites", F.explode(F.array(*map(F.lit, catalog.NEEDS))).alias("need"))
    o = catalog.objects(spark).select("need", F.col("id").alias("object_id"))
    return choice.prefer(c.join(o, "need"), ["id", "need"], F.array_contains("favorites", F.col("object_id"))).select("id", "need", "object_id")


@query("""WITH p AS (SELECT conv_id, role, list(coalesce(text, '') ORDER BY turn, text) AS texts FROM conversations GROUP BY conv_id, role),
k AS (SELECT conv_id, coalesce(max(texts) FILTER (role = 'system'), max(texts) FILTER (role = 'user')) AS pool FROM p GROUP BY conv_id)
SELECT conv_id, pool[floor(""" + _draw_sql("say", "conv_id") + """ * len(pool))::INT + 1] AS text, len(pool) AS n FROM k""")
def line_pools(spark, d):
    """O-01, O-75, O-76: lines by conversation and category, and one of them said; the user's where there is no system line."""
    kind = F.when(F.col("role") == "user", "idle").when(F.col("role") == "system", "greet").otherwise("fun")
    lines = _t(spark, d, "conversations").select(F.col("conv_id").alias("id"), kind.alias("category"), F.col("turn").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    pools = catalog.line_pools(lines)
    pool = F.coalesce(F.try_element_at("lines", F.lit("greet")), F.try_element_at("lines", F.lit("idle")))
    return pools.select(F.col("id").alias("conv_id"), derive.speak(F.col("lines"), F.lit("greet"), derive.draw("say", "id")).alias("text"), F.size(pool).cast("bigint").alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, role, 3.0 + coalesce(sum(2.4::DOUBLE + least(2.5::DOUBLE, length(coalesce(text, '')) * 0.045::DOUBLE))
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_s FROM conversations)
SELECT conv_id, turn, role, round(start_s, 6) AS start_s FROM t JOIN (SELECT conv_id, role, min(turn) FROM conversations WHERE role <> 'system' GROUP BY ALL) k USING (conv_id, role)""")
def spoken_lines(spark, d):
    """O-31: an unknown speaker's line is not said, but those after it wait for it."""
    c = _t(spark, d, "conversations")
    known = c.where("role <> 'system'").select("conv_id", F.col("role").alias("id")).distinct()
    said = timeline.spoken(timeline.timeline(c, "conv_id"), known, "role", "conv_id")
    return said.select("conv_id", "turn", "role", F.round("start_s", 6).alias("start_s"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events")
def json_field(spark, d):
    """O-05, O-06: what an event carries."""
    return _t(spark, d, "events").select("event_id", F.coalesce(commands.argument(F.col("props"), "k"), F.lit(0)).alias("k"))


@query("""SELECT o_orderkey, coalesce(n_name, 'unknown') AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
  LEFT JOIN nation ON c_nationkey = n_nationkey""")
def role_lookup_left(spark, d):
    """O-20, O-21, O-32."""
    c = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    found = catalog.by_id(catalog.by_id(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]), n, ["c_nationkey"])
    return found.select("o_orderkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


_OBJ = f"(SELECT ordinal + 1 AS pos, label, anim FROM ({OBJECT_VALUES}) o(ordinal, id, label, sx, sz, fx, fz, need, rate, anim, cap))"


@query(f"""SELECT e.id, CASE WHEN state = 'walking' THEN 'Walking...' WHEN state = 'chatting' THEN 'Chatting with ' || coalesce('Customer ' || cast(partner AS VARCHAR), 'a friend')
  WHEN state = 'using' AND label IS NOT NULL THEN CASE anim WHEN 'sleep' THEN 'Sleeping in' WHEN 'sit' THEN 'Lounging on' WHEN 'dance' THEN 'Dancing at'
    WHEN 'bounce' THEN 'Bouncing on' ELSE 'Using' END || ' the ' || label ELSE 'Hanging out' END AS doing
  FROM {ENTITIES} e LEFT JOIN {_OBJ} o ON e.id // 4 % 16 = o.pos""")
def activity_label(spark, d):
    """O-14."""
    o = catalog.objects(spark).select("label", "anim", (F.col("ordinal") + 1).alias("pos"))
    e = catalog.by_id(entities(spark, d).withColumn("pos", F.floor(F.col("id") / 4).cast("int") % 16), o, ["pos"])
    partner = F.concat(F.lit("Customer "), F.col("partner").cast("string"))
    return e.select("id", derive.activity(F.col("state"), partner, F.col("anim"), F.col("label")).alias("doing"))


#: Events in time: microseconds since the year began, seconds as they are.
_TIMED = "(SELECT *, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) AS us, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6::DOUBLE AS at_s, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)"


def timed(spark: SparkSession, d: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return _t(spark, d, "events").withColumns({"us": us, "at_s": us / F.lit(1e6), "k": F.coalesce(commands.argument(F.col("props"), "k"), F.lit(0))})


@query(f"""WITH e AS (SELECT user_id AS pointer, event_id, us, (event_type IN ('view', 'click', 'signup')) AS press, k / 10.0::DOUBLE AS x, value / 10 AS y FROM {_TIMED}),
g AS (SELECT *, count(*) FILTER (NOT press) OVER (PARTITION BY pointer ORDER BY us, NOT press, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM e),
p AS (SELECT pointer, used, arg_max(x, (us, event_id)) AS px, arg_max(y, (us, event_id)) AS py FROM g WHERE press GROUP BY ALL)
SELECT pointer, event_id, round(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 6) AS moved FROM g JOIN p USING (pointer, used)
WHERE NOT press AND sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= 6""")
def drag_filter(spark, d):
    """O-25: presses and releases of a pointer in time, each press used once."""
    kind = F.when(F.col("event_type").isin("view", "click", "signup"), "press").otherwise("release")
    e = timed(spark, d).select(F.col("user_id").alias("pointer"), "at_s", F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("k") / F.lit(10.0)).alias("x"), (F.col("value") / 10).alias("y"))
    return commands.clicks(e).select("pointer", F.col("seq").alias("event_id"), F.round("moved", 6).alias("moved"))


#: Speed buttons and Spaces of a house, and its scene presses.
_SPEED = f"(SELECT event_type AS house, at_s, event_id, CASE WHEN value < 15 THEN 0 WHEN value < 30 THEN 1 WHEN value < 45 THEN 3 END AS value, row_number() OVER (PARTITION BY event_type ORDER BY at_s, event_id) AS n FROM {_TIMED})"


def _speeds(spark, d):
    v = F.col("value")
    c = timed(spark, d).select(F.col("event_type").alias("house"), "at_s", F.col("event_id").alias("seq"), F.when(v < 15, 0).when(v < 30, 1).when(v < 45, 3).alias("value"))
    return toggles.running(toggles.speeds(c))


@query(f"""WITH RECURSIVE c AS {_SPEED},
walk AS (SELECT house, 0::BIGINT AS n, NULL::BIGINT AS event_id, 1 AS speed, 0::DOUBLE AS at_s, 0::DOUBLE AS run_s FROM (SELECT DISTINCT house FROM c)
  UNION ALL SELECT w.house, c.n, c.event_id, CASE WHEN c.value IS NOT NULL THEN c.value WHEN w.speed > 0 THEN 0 ELSE 1 END, c.at_s, w.run_s + CASE WHEN w.speed > 0 THEN c.at_s - w.at_s ELSE 0 END
  FROM walk w JOIN c ON c.house = w.house AND c.n = w.n + 1)
SELECT house, event_id, speed, round(run_s, 3) AS run_s FROM walk WHERE n > 0""")
def speed_commands(spark, d):
    """O-71: the speed that buttons and Space make of each other, and the time a house ran."""
    return _speeds(spark, d).select("house", F.col("seq").alias("event_id"), "speed", F.round("run_s", 3).alias("run_s"))


@query(f"""WITH m AS (SELECT house, floor(at_s) AS at_s, event_id, CASE WHEN value IS NULL THEN 2 ELSE value END * 1.0::DOUBLE AS speed, lead(floor(at_s)) OVER (PARTITION BY house ORDER BY floor(at_s), event_id) - floor(at_s) AS held FROM {_SPEED})
SELECT house, event_id, round(held * speed * 10, 3) AS minutes, round(coalesce(sum(held * speed * 10) OVER (PARTITION BY house ORDER BY at_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS minutes_before FROM m""")
def speed_clock(spark, d):
    """O-61, O-71: game minutes of each stretch of one speed."""
    v = F.col("value")
    c = timed(spark, d).select(F.col("event_type").alias("house"), F.floor("at_s").cast("double").alias("at_s"), F.col("event_id"), F.when(v < 15, 0).when(v < 30, 1).when(v < 45, 3).otherwise(2).alias("speed"))
    return segments.game_clock(c, ("event_id",)).select("house", "event_id", F.round("minutes", 3).alias("minutes"), F.round("minutes_before", 2).alias("minutes_before"))


@query(f"""WITH RECURSIVE c AS (SELECT s.*, 30 * k AS length_s FROM {_SPEED} s JOIN {_TIMED} t ON s.event_id = t.event_id),
walk AS (SELECT house, 0::BIGINT AS n, NULL::BIGINT AS event_id, 1 AS speed, 0::DOUBLE AS at_s, 0::DOUBLE AS run_s, false AS starts, -1e9::DOUBLE AS over_s FROM (SELECT DISTINCT house FROM c)
  UNION ALL SELECT b.house, b.n, b.event_id, CASE WHEN b.value IS NOT NULL THEN b.value WHEN b.was > 0 THEN 0 ELSE 1 END, b.at_s, b.run_s, NOT (b.starts AND b.run_s < b.over_s), b.run_s + b.length_s
  FROM (SELECT c.*, w.speed AS was, w.starts, w.over_s, w.run_s + CASE WHEN w.speed > 0 THEN c.at_s - w.at_s ELSE 0 END AS run_s FROM walk w JOIN c ON c.house = w.house AND c.n = w.n + 1) b)
SELECT house, event_id, starts FROM walk WHERE n > 0""")
def scene_toggles(spark, d):
    """O-28, O-69, O-71: which presses begin a scene; scenes end by themselves and stand still with the house."""
    clock = _speeds(spark, d)
    presses = timed(spark, d).select(F.col("event_type").alias("house"), "at_s", F.col("event_id").alias("seq"), (F.col("k") * 30).cast("double").alias("length_s"))
    return toggles.scenes(toggles.run_at(presses, clock)).select("house", F.col("seq").alias("event_id"), "starts")


_DRIFT = f"""(SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n, event_type,
  coalesce(lead(at_s) OVER (PARTITION BY user_id ORDER BY us, event_id) - at_s, 0) / 3600 AS hours FROM {_TIMED})"""


@query(f"""WITH RECURSIVE s AS (SELECT *, hours * (CASE event_type WHEN 'purchase' THEN 55::DOUBLE ELSE 0 END - 4.5::DOUBLE) AS dh,
    hours * (CASE event_type WHEN 'click' THEN 32::DOUBLE ELSE 0 END - CASE event_type WHEN 'click' THEN 0 ELSE 4.2::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * 0.8::DOUBLE) END) AS ds FROM {_DRIFT}),
w AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 60::DOUBLE AS hunger, 60::DOUBLE AS social FROM (SELECT DISTINCT user_id FROM s)
  UNION ALL SELECT s.user_id, s.n, s.event_id, least(100::DOUBLE, greatest(0::DOUBLE, w.hunger + dh)), least(100::DOUBLE, greatest(0::DOUBLE, w.social + ds)) FROM w JOIN s ON s.user_id = w.user_id AND s.n = w.n + 1)
SELECT user_id, event_id, round(hunger, 6) AS hunger, round(social, 6) AS social FROM w WHERE n > 0""")
def need_histories(spark, d):
    """O-63..O-65: needs at the end of every segment of a history, segments split by day."""
    e = timed(spark, d)
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    hours = F.coalesce(F.lead("at_s").over(w) - F.col("at_s"), F.lit(0.0)) / 3600
    s = e.select("user_id", "event_id", "us", "event_type", hours.alias("hours"), F.floor(F.col("us") / F.lit(86_400_000_000)).alias("day"))
    chat, eats = F.col("event_type") == "click", F.when(F.col("event_type") == "purchase", 55.0).otherwise(0.0)
    half = F.lit(0.5)
    rates = derive.decay_rates(half, half, half, F.lit(False), chat)
    out, names = s, {}
    for need, gain in (("hunger", eats), ("social", F.when(chat, 32.0).otherwise(0.0))):
        columns, compose, start, apply = scan.clamped_shift(need)
        out = out.withColumns(start((gain - rates[need]) * F.col("hours")))
        out, names[need] = scan.prefix_scan(out, ["user_id"], ["us", "event_id"], columns, compose, "day"), apply
    return out.select("user_id", "event_id", *[F.round(f(F.lit(60.0)), 6).alias(n) for n, f in names.items()])


@query(f"""WITH RECURSIVE f AS (SELECT event_type AS house, event_id, us, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) AS n,
    least(coalesce(us - lag(us) OVER (PARTITION BY event_type ORDER BY us, event_id), 0), 100000) AS step FROM {_TIMED}),
w AS (SELECT house, 0::BIGINT AS n, NULL::BIGINT AS event_id, 0::BIGINT AS acc, false AS saved, 0::BIGINT AS save FROM (SELECT DISTINCT house FROM f)
  UNION ALL SELECT f.house, f.n, f.event_id, CASE WHEN w.acc + f.step > 2000000 THEN 0 ELSE w.acc + f.step END, w.acc + f.step > 2000000, w.save + (w.acc + f.step > 2000000)::BIGINT FROM w JOIN f ON f.house = w.house AND f.n = w.n + 1)
SELECT house, event_id, save FROM w WHERE saved""")
def autosave_times(spark, d):
    """O-04: frames at which a house is saved, time counted anew after each save (here every 2 s)."""
    frames = timed(spark, d).select(F.col("event_type").alias("house"), F.col("us").alias("at_us"), F.col("event_id").alias("seq"))
    return snapshot.autosaves(frames, every_s=2.0).select("house", F.col("seq").alias("event_id"), "save")


_ASKS = f"(SELECT user_id % 3 AS house, event_type AS object_id, event_id, at_s, at_s + k * 600::DOUBLE AS end_s, 1 + length(event_type) % 3 AS capacity, row_number() OVER (PARTITION BY user_id % 3, event_type ORDER BY at_s, event_id) AS n FROM {_TIMED})"


@query(f"""WITH RECURSIVE r AS {_ASKS},
w AS (SELECT house, object_id, 0::BIGINT AS n, NULL::BIGINT AS request, NULL::INT AS users, false AS accepted, []::DOUBLE[] AS inside FROM (SELECT DISTINCT house, object_id FROM r)
  UNION ALL SELECT r.house, r.object_id, r.n, r.event_id, len(list_filter(w.inside, lambda x: x > r.at_s))::INT, len(list_filter(w.inside, lambda x: x > r.at_s)) < r.capacity,
    CASE WHEN len(list_filter(w.inside, lambda x: x > r.at_s)) < r.capacity AND r.end_s > r.at_s THEN list_append(list_filter(w.inside, lambda x: x > r.at_s), r.end_s) ELSE list_filter(w.inside, lambda x: x > r.at_s) END
  FROM w JOIN r ON r.house = w.house AND r.object_id = w.object_id AND r.n = w.n + 1)
SELECT house, object_id, request, users, accepted FROM w WHERE n > 0""")
def admissions(spark, d):
    """O-22, O-27, O-44: who is let in at an object of bounded capacity, in the order of asking."""
    e = timed(spark, d).select((F.col("user_id") % 3).alias("house"), F.col("event_type").alias("object_id"), F.col("event_id").alias("request"), F.col("at_s").alias("start_s"), (F.col("at_s") + F.col("k") * F.lit(600.0)).alias("end_s"), (1 + F.length("event_type") % 3).alias("capacity"))
    return occupancy.admit(e).select("house", "object_id", "request", "users", "accepted")


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Events as arrivals of eight friends at each other, and leaves."""
    kind = F.when(F.col("event_type") == "error", "leave").otherwise("arrive")
    me, other = F.col("k") % 8, (F.col("k") + 1 + F.col("event_id") % 7) % 8
    return timed(spark, d).select((F.col("user_id") % 5).alias("house"), F.col("event_id").alias("seq"), kind.alias("kind"), me.cast("string").alias("id"), other.cast("string").alias("other"), (F.col("value") > 110).alias("other_using"))


@query(f"""WITH RECURSIVE a AS (SELECT user_id % 5 AS house, event_id AS seq, event_type = 'error' AS leaves, (k % 8)::INT AS me, ((k + 1 + event_id % 7) % 8)::INT AS other, value > 110 AS busy,
    row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS n FROM {_TIMED}),
w AS (SELECT house, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::INT AS me, NULL::INT AS met, NULL::VARCHAR AS event, list_transform(range(8), lambda i: -1)::INT[] AS p FROM (SELECT DISTINCT house FROM a)
  UNION ALL SELECT a.house, a.n, a.seq, a.me,
    CASE WHEN a.leaves THEN w.p[a.me + 1] ELSE a.other END,
    CASE WHEN a.leaves AND w.p[a.me + 1] >= 0 THEN 'parted' WHEN NOT a.leaves AND a.me <> a.other AND NOT a.busy AND w.p[a.other + 1] < 0 AND w.p[a.me + 1] < 0 THEN 'linked' END,
    CASE WHEN a.leaves THEN list_transform(w.p, lambda x, i: CASE WHEN i = a.me + 1 OR x = a.me THEN -1 ELSE x END)
      WHEN a.me <> a.other AND NOT a.busy AND w.p[a.other + 1] < 0 AND w.p[a.me + 1] < 0 THEN list_transform(w.p, lambda x, i: CASE WHEN i = a.me + 1 THEN a.other WHEN i = a.other + 1 THEN a.me ELSE x END) ELSE w.p END
  FROM w JOIN a ON a.house = w.house AND a.n = w.n + 1)
SELECT house, seq, me::VARCHAR AS id, met::VARCHAR AS partner, event FROM w WHERE event IS NOT NULL UNION ALL SELECT house, seq, met::VARCHAR, me::VARCHAR, event FROM w WHERE event IS NOT NULL""")
def chat_pairing(spark, d):
    """O-35, O-66: links that form and part in order of arrival."""
    return pairing.chat_links(arrivals(spark, d))


_CHATS = f"(SELECT user_id % 5 AS house, event_id AS chat, k % 4 AS id, (k + 1 + event_id % 3) % 4 AS other, event_id::DOUBLE AS start_s, event_id + value / 10 AS end_s FROM {_TIMED})"


def _chats(spark, d):
    return timed(spark, d).select((F.col("user_id") % 5).alias("house"), F.col("event_id").alias("chat"), (F.col("k") % 4).alias("id"), ((F.col("k") + 1 + F.col("event_id") % 3) % 4).alias("other"), F.col("event_id").cast("double").alias("start_s"), (F.col("event_id") + F.col("value") / 10).alias("end_s"))


@query(f"""WITH c AS {_CHATS}, m AS (SELECT house, id, start_s, end_s FROM c UNION ALL SELECT house, other, start_s, end_s FROM c)
SELECT house, other AS id, chat, start_s + 2.6::DOUBLE AS at_s FROM c WHERE EXISTS (SELECT 1 FROM m WHERE m.house = c.house AND m.id = c.other AND m.start_s <= c.start_s + 2.6::DOUBLE AND c.start_s + 2.6::DOUBLE < m.end_s)""")
def fired_replies(spark, d):
    """O-68: answers that are said, as their speaker is in some chat when they are due."""
    return timeline.fired_replies(_chats(spark, d))


@query(f"""WITH l AS (SELECT user_id % 7 AS house, k % 4 AS id, event_id, event_id / 10.0::DOUBLE AS at_s FROM {_TIMED})
SELECT event_id, at_s, round(least(at_s + 3.5, coalesce((SELECT min(n.at_s) FROM l n WHERE n.house = l.house AND n.id = l.id AND n.at_s > l.at_s), 1e18)), 6) AS until_s FROM l""")
def bubble_ends(spark, d):
    """O-67: a line is seen until its time is up or its speaker says the next one."""
    lines = timed(spark, d).select((F.col("user_id") % 7).alias("house"), (F.col("k") % 4).alias("id"), F.col("event_id").alias("seq"), (F.col("event_id") / F.lit(10.0)).alias("at_s"))
    return timeline.bubbles(lines).select(F.col("seq").alias("event_id"), "at_s", F.round("until_s", 6).alias("until_s"))


@query("""SELECT event_id, event_id + 2.6 AS reply_s, event_id + 3.5 <= 5000 AS over FROM events WHERE event_id + 2.6 < event_id + value""")
def replies_and_timers(spark, d):
    """O-67, O-68: within its own chat."""
    c = _t(spark, d, "events").select("event_id", F.col("event_id").cast("double").alias("start_s"), (F.col("event_id") + F.col("value")).alias("end_s"))
    r = timeline.replies(c)
    return segments.timers(r, F.lit(3.5), F.lit(5000.0)).select("event_id", "reply_s", "over")


@query(f"""WITH e AS (SELECT user_id AS id, event_id, us // 1000000 // 3600 * 3600 AS at_s, event_type IN ('click', 'error') AS is_command FROM {_TIMED}),
s AS (SELECT id, event_id, at_s, at_s + 90000 AS end_s FROM e WHERE NOT is_command)
SELECT id, event_id, least(end_s, coalesce((SELECT min(c.at_s) FROM e c WHERE c.is_command AND c.id = s.id AND c.at_s > s.at_s), end_s))::DOUBLE AS end_s FROM s""")
def commands_close_segments(spark, d):
    """O-78: segments by the hour, many of which begin with a command, and several commands a segment."""
    e = timed(spark, d).select(F.lit(0).alias("house"), F.col("user_id").alias("id"), "event_id", "event_type", (F.floor(F.floor(F.col("us") / F.lit(1_000_000)) / 3600) * 3600).cast("double").alias("at_s"))
    command = F.col("event_type").isin("click", "error")
    s = e.where(~command).select("house", "id", "event_id", F.col("at_s").alias("start_s"), (F.col("at_s") + 90000).alias("end_s"))
    s = segments.close_on_command(s, e.where(command).select("house", "id", "at_s"))
    return s.select("id", "event_id", "end_s")


_WALKS = f"""(SELECT user_id AS id, event_id, us, at_s / 3000 AS at_s, least(greatest(k * 0.6::DOUBLE - 30, -26), 26) AS to_x, least(greatest(value / 2 - 20, -14), 22) AS to_z, event_type <> 'view' AS walk,
  2.2::DOUBLE + (user_id % 8) / 8.0::DOUBLE * 1.6::DOUBLE AS speed FROM {_TIMED})"""


@query(f"""WITH RECURSIVE e AS {_WALKS}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY at_s, event_id) AS n FROM e WHERE walk),
w AS (SELECT id, 0::BIGINT AS n, 0::DOUBLE AS at_s, 0::DOUBLE AS x, 0::DOUBLE AS z, 0::DOUBLE AS to_x, 0::DOUBLE AS to_z, 1::DOUBLE AS speed FROM (SELECT DISTINCT id FROM k)
  UNION ALL SELECT b.id, b.n, b.at_s, b.x + (b.ox - b.x) * b.share, b.z + (b.oz - b.z) * b.share, b.to_x, b.to_z, b.speed FROM (
    SELECT k.id, k.n, k.at_s, k.to_x, k.to_z, k.speed, w.x, w.z, w.to_x AS ox, w.to_z AS oz, CASE WHEN sqrt((w.to_x - w.x) ** 2 + (w.to_z - w.z) ** 2) = 0 THEN 0
      ELSE least(1, least((k.at_s - w.at_s) * w.speed, greatest(0, sqrt((w.to_x - w.x) ** 2 + (w.to_z - w.z) ** 2) - 0.25)) / sqrt((w.to_x - w.x) ** 2 + (w.to_z - w.z) ** 2)) END AS share
    FROM w JOIN k ON k.id = w.id AND k.n = w.n + 1) b),
a AS (SELECT e.id, e.event_id, e.at_s, w.x, w.z, w.to_x, w.to_z, w.speed, w.at_s AS since, sqrt((w.to_x - w.x) ** 2 + (w.to_z - w.z) ** 2) AS far, w.n,
    row_number() OVER (PARTITION BY e.event_id ORDER BY w.n DESC) AS last FROM e JOIN w ON w.id = e.id AND w.at_s <= e.at_s AND w.n > 0 WHERE NOT e.walk)
SELECT event_id, round(x + (to_x - x) * s, 5) + 0.0 AS x, round(z + (to_z - z) * s, 5) + 0.0 AS z FROM (SELECT *, CASE WHEN far = 0 THEN 0 ELSE least(1, least((at_s - since) * speed, greatest(0, far - 0.25)) / far) END AS s FROM a WHERE last = 1)""")
def positions_asked(spark, d):
    """O-72, O-78: walks that commands interrupt, and where everyone is when asked."""
    e = timed(spark, d).select(F.lit(0).cast("bigint").alias("house"), F.col("user_id").alias("id"), F.col("event_id").alias("seq"), (F.col("at_s") / 3000).alias("at_s"), "event_type", F.col("k"), "value")
    x, z = commands.clamp_ground(F.col("k") * F.lit(0.6) - 30, F.col("value") / 2 - 20)
    speed = derive.walk_speed((F.col("id") % 8) / F.lit(8.0))
    walks = e.where("event_type <> 'view'").select("house", "id", "at_s", "seq", x.alias("to_x"), z.alias("to_z"), speed.alias("speed"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("z0"))
    asked = e.where("event_type = 'view'").select("house", "id", "at_s", "seq")
    found = movement.positions(asked, movement.trajectories(walks)).where("x is not null")
    return found.select(F.col("seq").alias("event_id"), (F.round("x", 5) + F.lit(0.0)).alias("x"), (F.round("z", 5) + F.lit(0.0)).alias("z"))


@query(f"""WITH c AS {_CHATS}, m AS (SELECT DISTINCT house, u.id AS id FROM c, (SELECT unnest(range(4)) AS id) u),
s AS (SELECT house, id AS src, other AS dst, end_s, (end_s - start_s) / 60 AS hours FROM c WHERE id <> other),
q AS (SELECT house, chat AS decision, id, start_s AS at_s FROM c),
p AS (SELECT q.house, q.decision, q.id, m.id AS other, coalesce((SELECT sum(hours * 2.2::DOUBLE) FROM s WHERE s.house = q.house AND s.src = q.id AND s.dst = m.id AND s.end_s < q.at_s), 0) AS score FROM q JOIN m ON m.house = q.house AND m.id <> q.id),
r AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY round(score, 6) DESC, other) AS k, count(*) OVER (PARTITION BY decision) AS n FROM p)
SELECT house, id, decision, other FROM r WHERE k = CASE WHEN {_draw_sql('of', 'decision', "'top'")} < 0.7 THEN 1 ELSE floor({_draw_sql('of', 'decision', "'any'")} * n)::BIGINT + 1 END""")
def partner_as_of(spark, d):
    """O-43, O-50, O-74: partners by the affinity of the time, not by what came later."""
    c = _chats(spark, d)
    members = c.select("house").distinct().select("house", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("id")).withColumn("ordinal", F.col("id"))
    past = c.where("id <> other").select("house", F.col("id").alias("src"), F.col("other").alias("dst"), "end_s", ((F.col("end_s") - F.col("start_s")) / 60).alias("hours"))
    asked = c.select("house", "id", F.col("start_s").alias("at_s"), F.col("chat").alias("decision"))
    return choice.partner_as_of(asked, members, past, "of").select("house", "id", "decision", "other")


_INPUTS = """(SELECT event_id, user_id AS house, ts, CASE event_type WHEN 'view' THEN 'clock' WHEN 'error' THEN 'toolbar' WHEN 'click' THEN 'pointer' WHEN 'signup' THEN 'roster' ELSE 'key' END AS source,
  CASE event_type WHEN 'view' THEN cast(event_id % 5 AS VARCHAR) WHEN 'error' THEN list_extract(['majlis', 'follow', 'save', 'reset', 'control', 'other'], (event_id % 6 + 1)::INT)
    WHEN 'click' THEN list_extract(['entity', 'object', 'ground', 'wall'], (event_id % 4 + 1)::INT) || ':' || event_id % 9 WHEN 'signup' THEN cast(event_id % 8 AS VARCHAR)
    ELSE list_extract(['1', '8', '9', ' ', 'G', 'f', 'q'], (event_id % 7 + 1)::INT) END AS name FROM events)"""


def inputs_of(events: DataFrame) -> DataFrame:
    """Events as inputs of five sources, each delivered twice."""
    kind, n = F.col("event_type"), F.col("event_id")
    nth = lambda names: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    source = F.when(kind == "view", "clock").when(kind == "error", "toolbar").when(kind == "click", "pointer").when(kind == "signup", "roster").otherwise("key")
    name = (
        F.when(kind == "view", (n % 5).cast("string")).when(kind == "error", nth(["majlis", "follow", "save", "reset", "control", "other"]))
        .when(kind == "click", F.concat_ws(":", nth(["entity", "object", "ground", "wall"]), n % 9)).when(kind == "signup", (n % 8).cast("string"))
        .otherwise(nth(["1", "8", "9", " ", "G", "f", "q"]))
    )
    rows = events.select(n.alias("input_id"), F.col("user_id").alias("house"), "ts", source.alias("source"), name.alias("name"))
    return rows.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")


@query(f"""SELECT * FROM (SELECT event_id AS input_id, house, ts, CASE source WHEN 'clock' THEN CASE WHEN name IN ('0', '1', '3') THEN 'speed:' || name END
  WHEN 'toolbar' THEN CASE name WHEN 'majlis' THEN 'scene' WHEN 'control' THEN 'free_will' WHEN 'other' THEN NULL ELSE name END
  WHEN 'pointer' THEN CASE split_part(name, ':', 1) WHEN 'entity' THEN 'select:' || split_part(name, ':', 2) WHEN 'object' THEN 'use:' || split_part(name, ':', 2) WHEN 'ground' THEN 'move:' || split_part(name, ':', 2) END
  WHEN 'roster' THEN 'select:' || name
  ELSE CASE name WHEN '1' THEN 'select:0' WHEN '8' THEN 'select:7' WHEN ' ' THEN 'speed:toggle' WHEN 'G' THEN 'scene' WHEN 'f' THEN 'follow' END END AS command FROM {_INPUTS}) WHERE command IS NOT NULL""")
def command_table(spark, d):
    """O-06: one table of commands from buttons, toolbar, keys, pointer and roster."""
    return commands.command_table(inputs_of(_t(spark, d, "events")))


@query(f"""WITH e AS (SELECT id, CASE id % 3 WHEN 0 THEN 'arrived_use' WHEN 1 THEN 'done' ELSE 'wander' END AS event, CASE id % 4 WHEN 0 THEN 'hunger' WHEN 1 THEN 'energy' ELSE 'fun' END AS need,
  CASE id % 4 WHEN 1 THEN 'sleep' ELSE 'stand' END AS anim, {_draw_sql('r', 'id')} AS u FROM {ENTITIES})
SELECT id, CASE event WHEN 'arrived_use' THEN CASE WHEN u < 0.6 THEN CASE WHEN need = 'hunger' THEN 'hungry' WHEN anim = 'sleep' THEN 'tired' ELSE 'fun' END END
  WHEN 'done' THEN CASE WHEN u < 0.35 THEN 'fun' END ELSE CASE WHEN u < 0.25 THEN 'idle' END END AS says FROM e""")
def remarks(spark, d):
    """O-76: what is said, with odds, on arrival, at the end of a use and when wandering off."""
    e, n = entities(spark, d), F.col("id")
    event = F.when(n % 3 == 0, "arrived_use").when(n % 3 == 1, "done").otherwise("wander")
    need, anim = F.when(n % 4 == 0, "hunger").when(n % 4 == 1, "energy").otherwise("fun"), F.when(n % 4 == 1, "sleep").otherwise("stand")
    return e.select("id", derive.remark(event, need, anim, derive.draw("r", "id")).alias("says"))


@query(f"""SELECT id, CASE WHEN state = 'using' THEN 'idle' ELSE state END AS next_state, CASE WHEN state = 'using' THEN 0.5 + {_draw_sql('seat', 'id')} * 1.5 END AS idle_s FROM {ENTITIES}""")
def scene_release(spark, d):
    """O-77: at the end of a scene those who sit are freed, the others go on."""
    e = entities(spark, d).withColumn("state", F.when(F.col("state") == "using", "gathered").otherwise(F.col("state")))
    return toggles.release_seated(e, derive.draw("seat", "id")).select("id", "next_state", "idle_s")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = _t(spark, d, name).schema
    # a pattern, as a stream takes a folder or a pattern and the table may be one file
    return spark.readStream.schema(schema).parquet(f"{d}/{{{name}.parquet}}")


@query(ORACLE_SQL["command_table"])
def live_commands(spark, d):
    """O-06 on a stream that reads what is there and ends: the same commands as the batch."""
    return live.available_now(live.command_stream(inputs_of(_stream(spark, d, "events"))), "commands")


@query("""WITH c AS (SELECT user_id AS house, event_id AS chat, event_id % 4 AS id, (event_id + 1 + event_id // 4 % 3) % 4 AS other, date_trunc('millisecond', ts) AS ts,
    date_trunc('millisecond', ts) + to_milliseconds(round(value * 20000)::BIGINT) AS over FROM events),
m AS (SELECT house, id, ts, over FROM c UNION ALL SELECT house, other, ts, over FROM c), w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 SECONDS AS upto FROM events)
SELECT house, chat, other AS id, ts + INTERVAL 2600 MILLISECONDS AS at, 'reply' AS what FROM c, w WHERE ts + INTERVAL 2600 MILLISECONDS <= upto
  AND EXISTS (SELECT 1 FROM m WHERE m.house = c.house AND m.id = c.other AND m.ts <= c.ts + INTERVAL 2600 MILLISECONDS AND c.ts + INTERVAL 2600 MILLISECONDS < m.over)
UNION ALL SELECT house, chat, unnest([id, other]), over, 'over' FROM c, w WHERE over <= upto""")
def live_replies(spark, d):
    """O-66..O-68 on a stream: answers and ends of chats fire by event-time timers."""
    e = _stream(spark, d, "events")
    n, ms = F.col("event_id"), F.date_trunc("millisecond", F.col("ts").cast("timestamp"))
    over = F.timestamp_millis(F.unix_millis(ms) + F.round(F.col("value") * 20000).cast("bigint"))
    chats = e.select(F.col("user_id").alias("house"), n.alias("chat"), (n % 4).alias("id"), ((n + 1 + F.floor(n / 4) % 3) % 4).alias("other"), ms.alias("ts"), over.alias("over"))
    fired = live.available_now(timers.chat_timers(chats), "replies", timers.STORE)
    return fired.withColumn("at", F.col("at").cast("timestamp_ntz"))


_HAPPENS = f"""(SELECT user_id, event_id, us, k % 7 <> 0 AS free_will, CASE event_type WHEN 'view' THEN 'decided' WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'arrived_use' ELSE 'arrived_chat_free' END
  WHEN 'purchase' THEN 'done' WHEN 'signup' THEN CASE WHEN k % 3 = 0 THEN 'gather' WHEN k % 3 = 1 THEN 'arrived_gather' ELSE 'visited' END ELSE CASE WHEN k % 2 = 0 THEN 'released' ELSE 'arrived' END END AS event,
  row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM {_TIMED})"""


@query(f"""WITH RECURSIVE e AS {_HAPPENS},
w AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 'idle' AS state FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN event = 'gather' THEN 'walking' WHEN event = 'decided' THEN CASE WHEN state = 'idle' AND free_will THEN 'walking' ELSE state END
    WHEN state = 'walking' AND event = 'arrived' THEN 'idle' WHEN state = 'walking' AND event = 'arrived_use' THEN 'using' WHEN state = 'walking' AND event = 'arrived_chat_free' THEN 'chatting'
    WHEN state = 'walking' AND event = 'arrived_gather' THEN 'gathered' WHEN state IN ('using', 'chatting') AND event = 'done' THEN 'idle' WHEN state = 'gathered' AND event = 'released' THEN 'idle'
    WHEN state IN ('idle', 'walking', 'gathered') AND event = 'visited' THEN 'chatting' ELSE state END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, state FROM w WHERE n > 0""")
def state_histories(spark, d):
    """O-66, O-77..O-79: the state after every event of a history, histories split by day."""
    k, kind = F.col("k"), F.col("event_type")
    event = F.when(kind == "view", "decided").when(kind == "click", F.when(k % 2 == 0, "arrived_use").otherwise("arrived_chat_free")).when(kind == "purchase", "done")
    event = event.when(kind == "signup", F.when(k % 3 == 0, "gather").when(k % 3 == 1, "arrived_gather").otherwise("visited")).otherwise(F.when(k % 2 == 0, "released").otherwise("arrived"))
    e = timed(spark, d).select("user_id", "event_id", "us", event.alias("event"), (k % 7 != 0).alias("free_will"), F.floor(F.col("us") / F.lit(86_400_000_000)).alias("day"))
    return segments.state_history(e, ["user_id"], ["us", "event_id"], block="day").select("user_id", "event_id", "state")
