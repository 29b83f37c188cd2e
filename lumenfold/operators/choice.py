"""Choosing: candidates, preferences, partners, seats, and a whole decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import derive


def available(objects: DataFrame, users: DataFrame) -> DataFrame:
    """O-22, O-44: objects(house, id, capacity) with users counted from open segments(house,
    object_id), those with room only. (house, id) is a key of objects; both tables are dealt
    and counted together, so no join."""
    names = [c for c in objects.columns if c not in ("house", "id")]
    spots = objects.select("house", "id", F.struct(*names).alias("o"), F.lit(0).alias("u"))
    open_ = users.select("house", F.col("object_id").alias("id"), F.lit(None).cast(spots.schema["o"].dataType).alias("o"), F.lit(1).alias("u"))
    both = spots.union(open_).groupBy("house", "id").agg(F.first("o", ignorenulls=True).alias("o"), F.sum("u").alias("users"))
    return both.where("o is not null and users < o.capacity").select("house", "id", "o.*", "users")


def prefer(candidates: DataFrame, who: list[str], favorite: Column) -> DataFrame:
    """O-23: a chooser's favorites where it has any among its candidates, else all of them."""
    best = F.max(favorite.cast("int")).over(Window.partitionBy(*who))
    return candidates.withColumn("_fav", favorite.cast("int")).withColumn("_best", best).where("_fav = _best").drop("_fav", "_best")


def choose_one(candidates: DataFrame, who: list[str], order: str, u: Column) -> DataFrame:
    """A uniform choice among each chooser's candidates in their order. u is one number a chooser."""
    w = Window.partitionBy(*who)
    rows = candidates.withColumn("_u", u).withColumn("_k", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    return rows.where(F.col("_k") == F.floor(F.col("_u") * F.col("_n")) + 1).drop("_u", "_k", "_n")


def chat_pairs(entities: DataFrame) -> DataFrame:
    """O-24: entities(house, id, state, partner, ...) -> (house, id, other): those of one
    house free to chat. Houses are small; the join is on the house."""
    other = entities.where(F.col("partner").isNull() & (F.col("state") != "using")).select("house", F.col("id").alias("other"), F.col("ordinal").alias("other_ordinal"))
    return entities.select("house", "id").join(other, "house").where("id <> other")


def unordered(a: str, b: str) -> tuple[Column, Column]:
    """O-30: one key for (a, b) and (b, a), so that a pair lookup is an equi-join."""
    return F.least(a, b), F.greatest(a, b)


def pair_lines(chats: DataFrame, dynamics: DataFrame) -> DataFrame:
    """O-30: chats(a, b) with the lines of their pair, whoever is named first."""
    lo, hi = unordered("a", "b")
    keyed = dynamics.select(lo.alias("_lo"), hi.alias("_hi"), F.col("a").alias("first_speaker"), "n", "first", "second")
    return chats.withColumn("_lo", lo).withColumn("_hi", hi).join(keyed, ["_lo", "_hi"]).drop("_lo", "_hi")


def dialogue(chats: DataFrame, dynamics: DataFrame, seed: str) -> DataFrame:
    """O-30, O-35, O-68: chats(house, a, b), a having come to b, with who says what: with odds
    0.65 a random exchange of the pair's own, if it has any, the answer 2.6 s later; else a
    greets and b falls back to small talk after 2.4 s.

    house, a, b, first_speaker, second_speaker, first, second (null in small talk), category
    and reply_category (null in an own exchange), reply_s. A pair has few exchanges.
    """
    lo, hi = unordered("a", "b")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("n", "first", "second"))), lambda x: F.struct(x["first"].alias("first"), x["second"].alias("second")))
    own = dynamics.groupBy(lo.alias("_lo"), hi.alias("_hi"), F.col("a").alias("_opens")).agg(lines.alias("_lines"))
    rows = chats.withColumn("_lo", lo).withColumn("_hi", hi).join(own, ["_lo", "_hi"], "left")
    say = F.col("_lines").isNotNull() & (derive.draw(seed, "house", "a", "b", F.lit("own")) < 0.65)
    rows = rows.withColumn("_say", F.coalesce(say, F.lit(False))).withColumn("_line", F.when(F.col("_say"), derive.pick(F.col("_lines"), derive.draw(seed, "house", "a", "b", F.lit("line")))))
    opens = F.when(F.col("_say"), F.col("_opens")).otherwise(F.col("a"))
    small = lambda c: F.when(~F.col("_say"), c)
    return rows.select(
        "house", "a", "b", opens.alias("first_speaker"), F.when(opens == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("second_speaker"),
        "_line.first", "_line.second", small("greet").alias("category"), small("idle").alias("reply_category"),
        F.when(F.col("_say"), 2.6).otherwise(2.4).alias("reply_s"),
    )


def top_friend(scores: DataFrame, at_least: float = 4.0) -> DataFrame:
    """O-42: scores(src, dst, score, ordinal) -> each src's highest above at_least; ties to the least ordinal."""
    n = F.row_number().over(Window.partitionBy("src").orderBy(F.col("score").desc(), "ordinal"))
    return scores.where(F.col("score") > at_least).withColumn("_n", n).where("_n = 1").drop("_n")


def choose_partner(pairs: DataFrame, seed: str) -> DataFrame:
    """O-50, O-51: pairs(house, id, other, score, other_ordinal) -> the most liked with odds
    0.7, else any of them, the most liked included."""
    w = Window.partitionBy("house", "id")
    ranked = pairs.withColumn("_k", F.row_number().over(w.orderBy(F.coalesce("score", F.lit(0.0)).desc(), "other_ordinal"))).withColumn("_n", F.count("*").over(w))
    u, v = derive.draw(seed, "house", "id", F.lit("top")), derive.draw(seed, "house", "id", F.lit("any"))
    at = F.when(u < 0.7, F.lit(1)).otherwise(F.floor(v * F.col("_n")) + 1)
    return ranked.where(F.col("_k") == at).drop("_k", "_n")


def wander(weight: Column, order: Column, u: Column) -> Column:
    """O-73: nothing is urgent, or the character is untidy enough to ignore it."""
    return (weight < 35) | ((u > order) & (weight < 55))


def wander_target(u: Column, v: Column) -> tuple[Column, Column]:
    return (u - 0.5) * 40, (v - 0.5) * 30


def running_affinity(chats: DataFrame, asked: DataFrame, per_hour: float = 2.2) -> DataFrame:
    """O-43 as of a time: asked(house, src, dst, at_s, ...) with score: what chats(house, src, dst, end_s, hours) that were over
    before at_s have added up to. One sorted pass over both, no range join."""
    names = [c for c in asked.columns if c not in ("house", "src", "dst", "at_s")]
    one = asked.select("house", "src", "dst", "at_s", F.lit(0).alias("_chat"), F.lit(0.0).alias("_hours"), F.struct(F.lit(True).alias("_is"), *names).alias("_r"))
    two = chats.select("house", "src", "dst", F.col("end_s").alias("at_s"), F.lit(1).alias("_chat"), F.col("hours").cast("double").alias("_hours"), F.lit(None).cast(one.schema["_r"].dataType).alias("_r"))
    # at one time those who ask come first
    w = Window.partitionBy("house", "src", "dst").orderBy("at_s", "_chat").rowsBetween(Window.unboundedPreceding, 0)
    rows = one.union(two).withColumn("score", F.sum(F.col("_hours") * F.lit(per_hour)).over(w)).where("_chat = 0")
    return rows.select("house", "src", "dst", "at_s", *[F.col(f"_r.{c}").alias(c) for c in names], "score")


def partner_as_of(decisions: DataFrame, members: DataFrame, chats: DataFrame, seed: str) -> DataFrame:
    """O-50, O-51, O-74 as of each decision: decisions(house, id, at_s, decision) -> with other: the partner chosen by the scores of
    that time, null where the house has nobody else. members(house, id, ordinal); a house has a
    handful. chats as running_affinity() takes them."""
    others = members.select("house", F.col("id").alias("dst"), "ordinal")
    asked = decisions.withColumnRenamed("id", "src").join(others, "house").where("src <> dst")
    scored = running_affinity(chats, asked)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ordinal", F.col("dst").alias("id"))))
    found = scored.groupBy("house", F.col("src").alias("id"), "at_s", "decision").agg(ranked.alias("_ranked"))
    u, v = derive.draw(seed, "decision", F.lit("top")), derive.draw(seed, "decision", F.lit("any"))
    at = F.when(u < 0.7, F.lit(1)).otherwise((F.floor(v * F.size("_ranked")) + 1).cast("int"))
    found = found.select("house", "id", "decision", F.try_element_at("_ranked", at)["id"].alias("other"))
    return decisions.join(found, ["house", "id", "decision"], "left")


def decide(entities: DataFrame, objects: DataFrame, scores: DataFrame, seed: str) -> DataFrame:
    """O-74: one action for each entity: wander, chat, use or idle, and with whom or what.

    entities(house, id, ordinal, state, partner, hunger, energy, fun, social, sociability,
    trait_energy, playfulness, order, favorites); objects(house, id, ordinal, need, ...)
    with room; scores(house, id, other, score), of repeated ones the greatest. A house is a
    handful of rows: each table is dealt by house once, and the house's choices are made in its row."""
    needs = {n: F.col(n) for n in ("hunger", "energy", "fun", "social")}
    top = derive.most_urgent(derive.need_weights(needs, F.col("sociability"), F.col("trait_energy"), F.col("playfulness")))
    wanders = wander(F.col("_top.weight"), F.col("order"), derive.draw(seed, "house", "id", F.lit("wander")))
    rows = entities.withColumn("_top", top).withColumn("_wander", wanders)
    who = rows.groupBy("house").agg(F.collect_list(F.struct("id", "ordinal", "state", "partner", "favorites", F.col("_top.need").alias("need"), F.col("_wander").alias("wander"))).alias("who"))
    liked = scores.groupBy("house").agg(F.collect_list(F.struct("id", "other", "score")).alias("liked"))
    able = objects.groupBy("house").agg(F.collect_list(F.struct("need", "ordinal", "id")).alias("able"))
    me = F.col("me")
    each = who.join(liked, "house", "left").join(able, "house", "left").select("house", "who", "liked", "able", F.explode("who").alias("me")).withColumn("id", me["id"])

    def score(other: Column) -> Column:
        mine = F.filter("liked", lambda s: (s["id"] == me["id"]) & (s["other"] == other))
        return F.coalesce(F.array_max(F.transform(mine, lambda s: s["score"])), F.lit(0.0))

    free = F.filter("who", lambda w: (w["id"] != me["id"]) & w["partner"].isNull() & (w["state"] != "using"))
    each = each.withColumn("_free", F.array_sort(F.transform(free, lambda w: F.struct((-score(w["id"])).alias("s"), w["ordinal"].alias("o"), w["id"].alias("id")))))
    u, v = derive.draw(seed, "house", "id", F.lit("top")), derive.draw(seed, "house", "id", F.lit("any"))
    at = F.when(u < 0.7, F.lit(1)).otherwise((F.floor(v * F.size("_free")) + 1).cast("int"))
    each = each.withColumn("_other", F.try_element_at("_free", at)["id"])
    each = each.withColumn("need", F.when((me["need"] == "social") & F.col("_other").isNull(), "fun").otherwise(me["need"]))
    found = F.filter("able", lambda o: o["need"] == F.col("need"))
    each = each.withColumn("_found", F.array_sort(F.transform(found, lambda o: F.struct(o["ordinal"].alias("o"), o["id"].alias("id")))))
    favored = F.filter("_found", lambda o: F.array_contains(me["favorites"], o["id"]))
    pool = F.when(F.size(favored) > 0, favored).otherwise(F.col("_found"))
    each = each.withColumn("object_id", F.when(~me["wander"] & (F.col("need") != "social"), derive.pick(pool, derive.draw(seed, "house", "id", F.lit("object")))["id"]))
    action = F.when(me["wander"], "wander").when(F.col("need") == "social", "chat").when(F.col("object_id").isNotNull(), "use").otherwise("idle")
    x, z = wander_target(derive.draw(seed, "house", "id", F.lit("x")), derive.draw(seed, "house", "id", F.lit("z")))
    return each.select("house", "id", "need", action.alias("action"), F.when(action == "chat", F.col("_other")).alias("other"), "object_id", F.when(action == "wander", x).alias("x"), F.when(action == "wander", z).alias("z"))


def seat_greedily(entities: DataFrame, seats: DataFrame) -> DataFrame:
    """O-34, O-52: in order of ordinal each entity of a house takes the nearest free seat,
    the first of equals -> house, id, seat_id; seat_id null once all are taken.

    A fold over a house's entities (a house is small) against the few seats.
    """
    row = seats.agg(F.sort_array(F.collect_list(F.struct("seat_id", "x", "z"))).alias("seats"))
    house = entities.groupBy("house").agg(F.sort_array(F.collect_list(F.struct("ordinal", "id", "x", "z"))).alias("who")).join(F.broadcast(row))
    fold = """aggregate(who, named_struct('free', seats, 'got', cast(array() as array<int>)), (acc, e) ->
        named_struct('free', filter(acc.free, s -> s.seat_id <> coalesce(array_min(transform(acc.free, t -> named_struct('d', (t.x-e.x)*(t.x-e.x)+(t.z-e.z)*(t.z-e.z), 's', t.seat_id))).s, -1)),
                     'got', concat(acc.got, array(array_min(transform(acc.free, t -> named_struct('d', (t.x-e.x)*(t.x-e.x)+(t.z-e.z)*(t.z-e.z), 's', t.seat_id))).s))), acc -> acc.got)"""
    got = house.select("house", F.explode(F.arrays_zip("who", F.expr(fold).alias("got"))).alias("p"))
    return got.select("house", F.col("p.who.id").alias("id"), F.col("p.got").alias("seat_id"))
