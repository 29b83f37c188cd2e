"""Hand-derived values, boundaries, ties, closed form against steps, streams."""

import pandas as pd
from pyspark.sql import functions as F

from lumenfold.functions import derive
from lumenfold.operators import choice, commands, segments, snapshot, timeline
from lumenfold.sources import catalog
from lumenfold.streaming import live


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_rates_of_the_cast(spark):
    """Points an hour: speed, energy, fun, social."""
    no = F.lit(False)
    rates = derive.decay_rates(F.col("traits.sociability"), F.col("traits.energy"), F.col("traits.playfulness"), no, no)
    got = {r.id: (round(r.s, 3), round(r.e, 3), round(r.f, 3), round(r.o, 3)) for r in catalog.cast(spark).select("id", derive.walk_speed(F.col("traits.energy")).alias("s"), rates["energy"].alias("e"), rates["fun"].alias("f"), rates["social"].alias("o")).collect()}
    assert got["namboy"] == (3.16, 2.88, 4.05, 2.604) and got["waleed"] == (3.56, 2.48, 6.15, 5.124) and got["abdullah"] == (3.24, 2.8, 4.225, 2.772)


def test_tables(spark):
    assert catalog.objects(spark).groupBy("need").count().orderBy("need").collect()[0]["count"] == 5
    s = catalog.seats(spark).collect()
    assert len(s) == 8 and all(abs(r.x**2 + (r.z - 16) ** 2 - 9) < 1e-9 for r in s)


def test_scene_times(spark):
    lengths = [57, 62, 38, 37, 50, 24, 38]
    rows = spark.createDataFrame([(0, i, "x" * n) for i, n in enumerate(lengths)], "scene_id int, turn int, text string")
    got = timeline.timeline(rows).orderBy("turn").collect()
    assert [round(r.start_s, 3) for r in got] == [3.0, 7.9, 12.8, 16.91, 20.975, 25.625, 29.105] and round(got[-1].end_s, 3) == 33.215


def test_clock_and_bands(spark):
    r = one(spark, a=derive.clock_text(F.lit(0.0)), b=derive.clock_text(F.lit(480.5)), c=derive.clock_text(F.lit(720.0)), d=derive.clock_text(F.lit(1439.9)), e=derive.level_band(F.lit(22)), f=derive.level_band(F.lit(45)), g=derive.level_band(F.lit(21.9)), h=derive.mood(*[F.lit(70.0)] * 4), i=derive.mood(*[F.lit(32.0)] * 4), j=derive.rgb_hex(F.lit(255)))
    assert tuple(r) == ("12:00 AM", "8:00 AM", "12:00 PM", "11:59 PM", "low", "normal", "crit", "fine", "awful", "#0000ff")


def test_first_of_ties(spark):
    w = {n: F.lit(50.0) for n in catalog.NEEDS}
    assert one(spark, t=derive.most_urgent(w)).t.need == "hunger"
    s = spark.createDataFrame([("a", "b", 4.0, 0), ("a", "c", 5.0, 2), ("a", "d", 5.0, 1), ("e", "b", 4.0, 0)], "src string, dst string, score double, ordinal int")
    assert [(r.src, r.dst) for r in choice.top_friend(s).collect()] == [("a", "d")]


def test_closed_form_is_stepping(spark):
    r = one(spark, d=derive.after_decay(F.lit(30.0), F.lit(4.5), F.lit(10.0)), g=derive.after_gain(F.lit(40.0), F.lit(30.0), F.lit(3.2), F.lit(1.5)))
    d, g = 30.0, 40.0
    for _ in range(1000):
        d, g = max(0.0, d - 4.5 * 0.01), min(100.0, max(0.0, g - 3.2 * 0.0015) + 30 * 0.0015)
    assert abs(r.d - d) < 1e-6 and abs(r.g - g) < 1e-6
    assert abs(one(spark, h=segments.use_hours(F.lit(40.0), F.lit(28.0), F.lit(True), F.lit(1.0))).h - 2.0) < 1e-9


def test_draws_do_not_depend_on_partitions(spark):
    a = spark.range(100).repartition(1).select("id", derive.draw("s", "id").alias("u")).collect()
    b = spark.range(100).repartition(7).select("id", derive.draw("s", "id").alias("u")).collect()
    assert dict(map(tuple, a)) == dict(map(tuple, b)) and all(0 <= r.u < 1 for r in a)
    assert one(spark, p=derive.pick(F.expr("cast(array() as array<string>)"), F.lit(0.5))).p is None


def test_pairs_and_lines(spark):
    d = spark.createDataFrame([("x", "y", 0, "hi", "yo")], catalog.DYNAMIC_SCHEMA)
    got = choice.pair_lines(spark.createDataFrame([("y", "x"), ("x", "z")], "a string, b string"), d).collect()
    assert len(got) == 1 and got[0].first_speaker == "x"
    lines = spark.createDataFrame([("x", "idle", 1, "b"), ("x", "idle", 0, "a"), ("x", "fun", 0, "c")], catalog.LINE_SCHEMA)
    assert catalog.line_pools(lines).first().lines == {"idle": ["a", "b"], "fun": ["c"]}


def test_dialogue_source(spark, tmp_path):
    (tmp_path / "scenes.json").write_text('{"scene_id":0,"turn":0,"speaker_id":"x","text":"t"}\n')
    assert catalog.read_dialogue(spark, str(tmp_path), "scenes").first().speaker_id == "x"


def test_restore_cases(spark):
    live_rows = [(1, "a", {"fun": 5.0, "hunger": 6.0}, {"b": 1.0}, 0.0, 0.0), (1, "b", {"fun": 7.0}, {}, 1.0, 1.0)]
    df = spark.createDataFrame(live_rows, "house int, id string, needs map<string,double>, rel map<string,double>, x double, z double")
    saves = spark.createDataFrame([(1, '{"day":3,"sims":[{"id":"a","needs":{"fun":9.0},"x":"no","z":4},{"id":"ghost"}]}'), (2, "{bad")], "house int, document string")
    p = snapshot.parse(saves)
    assert {(r.house, r.ok, r.game_minutes, r.day) for r in p.collect()} >= {(2, False, 480.0, 1)}
    # x is no number: the place stays; no rel: none is left
    got = {r.id: r for r in snapshot.restore(df, p).collect()}
    assert set(got) == {"a", "b"} and got["a"].needs["fun"] == 9.0 and got["a"].needs["hunger"] == 6.0 and (got["a"].x, got["a"].z) == (0.0, 0.0)
    assert got["a"].rel == {} and got["b"].needs["fun"] == 7.0
    more = [(1, '{"sims":[{"id":"a","needs":{"fun":1},"rel":{"q":2},"x":1,"z":2},{"id":"a","needs":{"hunger":3},"x":2.5,"z":4}]}'), (2, '{"day":3}'), (3, "null"), (4, '{"day":null,"gameMinutes":1.5}'), (5, None), (6, "")]
    p = snapshot.parse(spark.createDataFrame(more, "house int, document string"))
    assert {r.house: (r.ok, r.game_minutes, r.day) for r in p.collect()} == {1: (True, 480.0, 1), 2: (True, 480.0, 3), 3: (False, 480.0, 1), 4: (True, 1.5, 1), 5: (False, 480.0, 1), 6: (False, 480.0, 1)}
    got = snapshot.restore(df, p).where("id = 'a'").collect()
    assert len(got) == 1 and (got[0].needs["fun"], got[0].needs["hunger"], got[0].rel, got[0].x, got[0].z) == (1.0, 3.0, {}, 2.5, 4.0)


def test_commands(spark):
    r = one(spark, a=commands.parse_command(F.lit("3")), b=commands.parse_command(F.lit(" ")), c=commands.parse_command(F.lit("G")), d=commands.parse_command(F.lit("q")))
    assert tuple(r) == ("select:2", "pause", "gather", None)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    pd.DataFrame([(1, 0, "arrive", "a", "b", False), (1, 1, "arrive", "c", "b", False), (1, 2, "leave", "b", None, False), (1, 3, "arrive", "c", "b", False), (2, 0, "arrive", "a", "b", True)], columns=["house", "seq", "kind", "id", "other", "other_using"]).to_parquet(str(tmp_path / "x.parquet"))
    spark.read.parquet(str(tmp_path / "x.parquet")).write.parquet(src)
    rows = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = live.chat_links(rows).writeStream.format("memory").queryName("links").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [(r.house, r.id, r.partner, r.event) for r in spark.table("links").collect()]
    assert got == [(1, "a", "b", "linked"), (1, "b", "a", "linked"), (1, "b", "a", "parted"), (1, "a", "b", "parted"), (1, "c", "b", "linked"), (1, "b", "c", "linked")]
    docs = str(tmp_path / "docs")
    spark.createDataFrame([(1, "old", 1.0), (1, "new", 2.0), (2, "x", 1.0)], "house int, document string, at_s double").write.parquet(docs)
    s = spark.readStream.schema("house int, document string, at_s double").parquet(docs)
    q = live.autosave(s, str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.house, r.document) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "new"), (2, "x")}


def test_pairing_over_batches():
    """A house's arrivals are put in order over all of its batches, whatever order those come in."""

    class State:
        exists = False

        def update(self, value):
            self.value = value

    cols = ["house", "seq", "kind", "id", "other", "other_using"]
    late = pd.DataFrame([(1, 3, "arrive", "c", "b", False)], columns=cols)
    early = pd.DataFrame([(1, 1, "arrive", "a", "b", False), (1, 2, "leave", "b", None, False)], columns=cols)
    state = State()
    (out,) = live._pair((1,), iter([late, early]), state)
    assert out["event"].tolist() == ["linked", "linked", "parted", "parted", "linked", "linked"] and state.value == ({"c": "b", "b": "c"},)
    state.exists, state.get, state.remove = True, state.value, lambda: setattr(state, "value", None)
    list(live._pair((1,), iter([pd.DataFrame([(1, 4, "leave", "c", None, False)], columns=cols)]), state))
    assert state.value is None  # nothing is kept where nobody chats


def test_running_sums(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", 1.0), ("a", "b", 0.5), ("b", "a", 2.0)], "src string, dst string, hours double")
    assert {(r.src, r.dst): round(r.score, 6) for r in live.running_affinity(rows).collect()} == {("a", "b"): 3.3, ("b", "a"): 4.4}
    change = spark.createDataFrame([(1, "sofa", 1), (1, "sofa", 1), (1, "sofa", -1)], "house int, object_id string, change int")
    assert live.occupancy(change).first().users == 1
