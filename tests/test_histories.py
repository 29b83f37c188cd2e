"""Histories: switches, clamps, saves, places, links, replies and walks against plain stepping."""

import math
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import choice, commands, movement, occupancy, pairing, scan, segments, snapshot, timeline, toggles
from lumenfold.sources import catalog
from lumenfold.streaming import live, timers

POINTER = "pointer int, at_s double, seq int, kind string, x double, y double"


def test_presses_are_used_once(spark):
    rows = [(1, 0.0, 0, "press", 0.0, 0.0), (1, 1.0, 1, "press", 100.0, 100.0), (1, 2.0, 2, "release", 0.0, 0.0), (1, 3.0, 3, "release", 100.0, 100.0), (1, 4.0, 4, "release", 0.0, 0.0)]
    rows += [(2, 0.0, 0, "press", 0.0, 0.0), (2, 1.0, 1, "press", 50.0, 50.0), (2, 2.0, 2, "release", 50.0, 56.0), (2, 3.0, 3, "release", 50.0, 50.0), (2, 4.0, 4, "press", 1.0, 1.0), (2, 5.0, 5, "release", 1.0, 7.1)]
    rows += [(3, 0.0, 0, "release", 0.0, 0.0), (3, 1.0, 2, "release", 2.0, 0.0), (3, 1.0, 1, "press", 2.0, 0.0), (3, 1.5, 7, "wheel", 0.0, 0.0), (3, None, 3, "press", 0.0, 0.0), (4, 0.0, 0, "press", None, 1.0), (4, 1.0, 1, "release", 1.0, 1.0)]
    got = commands.clicks(spark.createDataFrame(rows, POINTER)).collect()
    # pointer 1: the latest press is far from its release, and the one before is used up by nobody
    assert sorted((r.pointer, r.seq, r.moved) for r in got) == [(2, 2, 6.0), (3, 2, 0.0)]


def test_presses_against_stepping(spark):
    r, rows, want = random.Random(5), [], []
    for pointer in range(5):
        down = None
        for k in range(200):
            kind, x, y = r.choice(["press", "release"]), r.randrange(12) * 1.0, r.randrange(12) * 1.0
            rows.append((pointer, float(k), k, kind, x, y))
            if kind == "press":
                down = (x, y)
            elif down:
                if math.hypot(x - down[0], y - down[1]) <= 6:
                    want.append((pointer, k))
                down = None
    got = commands.clicks(spark.createDataFrame(rows, POINTER).repartition(7)).collect()
    assert sorted((x.pointer, x.seq) for x in got) == want


def test_speed_and_scenes_against_stepping(spark):
    """Buttons, Space and scene presses mixed, ties too; scenes that end by themselves start again."""
    r, sets, presses, speeds, starts = random.Random(6), [], [], [], []
    for house in range(4):
        speed, run, at, on, over = 1, 0.0, 0.0, False, 0.0
        for k in range(300):
            gap = float(r.choice([0, 0, 1, 2, 5, 40]))
            at, run = at + gap, run + gap * (speed > 0)
            if r.random() < 0.5:
                value = r.choice([0, 1, 3, None, None, None])
                sets.append((house, at, k, value))
                speed = value if value is not None else 0 if speed > 0 else 1
                speeds.append((house, k, speed, run))
            else:
                length = float(r.choice([0, 3, 10, 30]))
                presses.append((house, at, k, length))
                on = not (on and run < over)
                over = run + length
                starts.append((house, k, on))
    clock = toggles.running(toggles.speeds(spark.createDataFrame(sets, "house int, at_s double, seq int, value int").repartition(5)))
    assert sorted((x.house, x.seq, x.speed, x.run_s) for x in clock.collect()) == speeds
    made = toggles.run_at(spark.createDataFrame(presses, "house int, at_s double, seq int, length_s double"), clock)
    assert sorted((x.house, x.seq, x.starts) for x in toggles.scenes(made).collect()) == starts


def test_scene_over_by_itself(spark):
    rows = [(1, 0.0, 0, 0.0), (1, 100.0, 1, 5.0), (1, 102.0, 2, 5.0), (1, 103.0, 3, 5.0), (1, 108.0, 4, 5.0)]
    got = toggles.scenes(spark.createDataFrame(rows, "house int, run_s double, seq int, length_s double")).orderBy("seq").collect()
    assert [(x.starts, x.end_s) for x in got] == [(True, 0.0), (True, 102.0), (False, None), (True, 108.0), (True, 113.0)]


@pytest.mark.parametrize("block", [None, "day"])
def test_clamped_histories(spark, block):
    """Thousands of segments, clipped at both ends over and over, equal to stepping."""
    r, rows, want = random.Random(7), [], {}
    for who, n in ((1, 3000), (2, 1), (3, 500)):
        x = 50.0
        for k in range(n):
            d = r.choice([-1, 1]) * r.random() * 60
            rows.append((who, k, k // 97, d))
            x = min(100.0, max(0.0, x + d))
            want[who, k] = x
    names, compose, start, apply = scan.clamped_shift("fun")
    df = spark.createDataFrame(rows, "who int, k int, day int, d double").repartition(5).withColumns(start(F.col("d")))
    got = scan.prefix_scan(df, ["who"], ["k"], names, compose, block).select("who", "k", apply(F.lit(50.0)).alias("x")).collect()
    assert len(got) == len(want) and all(abs(want[x.who, x.k] - x.x) < 1e-9 for x in got)


def test_scan_of_nothing_and_null_blocks(spark):
    names, compose, start, apply = scan.clamped_shift("fun")
    df = spark.createDataFrame([(1, 0, None, 5.0), (1, 1, 3, -9.0)], "who int, k int, day int, d double").withColumns(start(F.col("d")))
    got = scan.prefix_scan(df, ["who"], ["k"], names, compose, "day").select("k", apply(F.lit(2.0)).alias("x")).orderBy("k").collect()
    assert [x.x for x in got] == [7.0, 0.0]
    assert scan.prefix_scan(df.where("k > 5"), ["who"], ["k"], names, compose).count() == 0


def test_autosaves_restart_at_zero(spark):
    """Time since the last save, 0.1 s a frame at most: unlike fixed stretches of 20 s, and equal to stepping."""
    r, rows, want, fixed = random.Random(8), [], [], set()
    for house in range(3):
        at, acc, n, total = 0, 0, 0, 0
        for k in range(2500 * house):
            gap = r.choice([16_000, 33_000, 90_000, 400_000, 0])
            at += gap if k else 0
            rows.append((house, at, k))
            step = min(gap, 100_000) if k else 0
            acc, total = acc + step, total + step
            if acc > 20_000_000:
                acc, n = 0, n + 1
                want.append((house, k, n))
                fixed.add(total // 20_000_000)
    got = snapshot.autosaves(spark.createDataFrame(rows, "house int, at_us bigint, seq int").repartition(4)).collect()
    assert sorted((x.house, x.seq, x.save) for x in got) == want and len(want) > 8
    assert snapshot.autosaves(spark.createDataFrame([], "house int, at_us bigint, seq int")).count() == 0


def test_null_clock_is_saved(spark):
    e = spark.createDataFrame([(1, 0, "a", {"fun": 1.0}, {}, 1.0, 2.0)], "house int, ordinal int, id string, needs map<string,double>, rel map<string,double>, x double, z double")
    docs = snapshot.save(e, spark.createDataFrame([(1, None, None), (2, 5.0, None)], "house int, game_minutes double, day int"))
    back = {r.house: r for r in snapshot.parse(docs).collect()}
    assert back[1].ok and (back[1].game_minutes, back[1].day) == (480.0, 1) and back[1].sims[0].id == "a" and back[2].ok and back[2].game_minutes == 5.0


def test_command_at_a_segments_start(spark):
    s = spark.createDataFrame([(1, 1, 0.0, None, "a"), (1, 1, 10.0, None, "b"), (1, 1, 20.0, 25.0, "c")], "house int, id int, start_s double, end_s double, what string")
    c = spark.createDataFrame([(1, 1, 10.0), (1, 1, 24.0), (1, 1, 22.0), (1, 2, 1.0)], "house int, id int, at_s double")
    got = {r.what: r.end_s for r in segments.close_on_command(s, c).collect()}
    assert got == {"a": 10.0, "b": 22.0, "c": 22.0}


REQUESTS = "house bigint, object_id string, request bigint, start_s double, end_s double, capacity int"


def test_admission_against_stepping(spark):
    r, rows, want = random.Random(9), [], []
    for house, spot, cap in ((1, "sofa", 3), (1, "bed", 1), (2, "sofa", 2)):
        inside, at = [], 0.0
        for k in range(400):
            at += r.choice([0, 0, 1, 2, 30])
            end = r.choice([at, at + 1, at + 5, at + 20, None if k > 390 else at + 3])
            rows.append((house, spot, k, at, end, cap))
            inside = [x for x in inside if x is None or x > at]
            ok = len(inside) < cap
            want.append((house, spot, k, len(inside), ok))
            if ok and (end is None or end > at):
                inside.append(end)
    made = spark.createDataFrame(rows + [(None, "sofa", 1, 0.0, 1.0, 1), (1, None, 1, 0.0, 1.0, 1), (1, "bed", 900, None, 1.0, 1)], REQUESTS).repartition(5)
    got = occupancy.admit(made).collect()
    assert sorted((x.house, x.object_id, x.request, x.users, x.accepted) for x in got) == sorted(want)
    assert not all(x.accepted for x in got)
    periods = occupancy.busy_periods(made.where("house is not null and object_id is not null and start_s is not null"))
    assert periods.groupBy("house", "object_id").agg(F.countDistinct("period").alias("n")).agg(F.min("n")).first()[0] > 5


def test_refused_takes_no_place(spark):
    rows = [(1, "bed", 0, 0.0, 10.0, 1), (1, "bed", 1, 1.0, 100.0, 1), (1, "bed", 2, 10.0, 11.0, 1)]
    got = occupancy.admit(spark.createDataFrame(rows, REQUESTS)).orderBy("request").collect()
    assert [(x.users, x.accepted) for x in got] == [(0, True), (1, False), (0, True)]


ARRIVALS = "house bigint, seq bigint, kind string, id string, other string, other_using boolean"


def test_pairing_batch_and_stream_agree(spark, tmp_path):
    r = random.Random(10)
    rows = [(k % 3, k, r.choice(["arrive", "arrive", "leave"]), r.choice("abcdef"), r.choice("abcdef"), r.random() < 0.2) for k in range(300)]
    made = spark.createDataFrame(rows, ARRIVALS)
    batch = pairing.chat_links(made.repartition(4)).collect()
    src = str(tmp_path / "in")
    made.repartition(1).write.parquet(src)
    q = live.chat_links(spark.readStream.schema(made.schema).parquet(src)).writeStream.format("memory").queryName("pairs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {h: [(x.id, x.partner, x.event) for x in batch if x.house == h] for h in range(3)}
    got = {h: [(x.id, x.partner, x.event) for x in spark.table("pairs").collect() if x.house == h] for h in range(3)}
    assert got == want and all(len(v) > 20 for v in want.values())


def test_replies_ask_any_open_chat(spark):
    """b's answer to a is said in b's later chat with c; a chat that ends at the very time is over."""
    c = spark.createDataFrame([(1, 1, "a", "b", 0.0, 1.0), (1, 2, "c", "b", 2.0, 9.0), (1, 3, "d", "e", 0.0, 2.6), (2, 4, "a", "b", 0.0, 1.0), (1, 5, "f", "g", 0.0, None), (1, 6, "h", "i", 5.0, 4.0)], "house int, chat int, id string, other string, start_s double, end_s double")
    assert sorted((r.chat, r.id) for r in timeline.fired_replies(c).collect()) == [(1, "b"), (2, "b"), (5, "g")]


def test_bubbles_end_with_the_next_line(spark):
    lines = spark.createDataFrame([(1, "a", 0.0, 0), (1, "a", 2.0, 1), (1, "a", 9.0, 2), (1, "b", 1.0, 3)], "house int, id string, at_s double, seq int")
    assert [r.until_s for r in timeline.bubbles(lines).orderBy("seq").collect()] == [2.0, 5.5, 12.5, 4.5]


def test_unknown_speakers_keep_their_time(spark):
    lines = spark.createDataFrame([(1, 0, "a", "x" * 10), (1, 1, "ghost", "x" * 20), (1, 2, "a", "x"), (2, 0, "a", "x")], "scene_id int, turn int, speaker_id string, text string")
    known = spark.createDataFrame([(1, "a")], "scene_id int, id string")
    got = timeline.spoken(timeline.timeline(lines), known, "speaker_id", "scene_id").orderBy("turn").collect()
    assert [(r.scene_id, r.turn, round(r.start_s, 3)) for r in got] == [(1, 0, 3.0), (1, 2, 9.15)]


WALKS = "house bigint, id bigint, at_s double, seq bigint, to_x double, to_z double, speed double, x0 double, z0 double"


def test_walks_against_small_steps(spark):
    """Interrupted walks start where they stopped; positions at any time, as frames of 1 ms would have them."""
    r, walks, asked, want = random.Random(11), [], [], {}
    for who in range(3):
        x, z, to, at = 1.0, 2.0, None, 0.0
        plan = sorted((r.random() * 60, k) for k in range(12))
        asks = sorted((r.random() * 70, k) for k in range(40))
        for t, k in plan:
            walks.append((1, who, t, k, r.uniform(-26, 26), r.uniform(-14, 22), 2.5, 1.0, 2.0))
        events = sorted([(t, 0, k) for t, k in plan] + [(t, 1, k) for t, k in asks])
        goals = {w[3]: (w[4], w[5]) for w in walks if w[1] == who}
        for t, kind, k in events:
            while to and at < t:
                far = math.hypot(to[0] - x, to[1] - z)
                if far < 0.25:
                    break
                step = min(0.001, t - at)
                x, z, at = x + (to[0] - x) / far * 2.5 * step, z + (to[1] - z) / far * 2.5 * step, at + step
            at = t
            if kind == 0:
                to = goals[k]
            else:
                asked.append((1, who, t, k))
                want[who, k] = (x, z) if to else None
    legs = movement.trajectories(spark.createDataFrame(walks, WALKS).repartition(3))
    got = movement.positions(spark.createDataFrame(asked, "house bigint, id bigint, at_s double, seq int"), legs).collect()
    assert len(got) == len(want)
    for row in got:
        place = want[row.id, row.seq]
        assert (place is None and row.x is None) or math.hypot(row.x - place[0], row.z - place[1]) < 0.01
    again = movement.trajectories(spark.createDataFrame([(1, 1, 5.0, 1, 10.0, 0.0, 1.0, 0.0, 0.0), (1, 1, 5.0, 2, -10.0, 0.0, 1.0, 0.0, 0.0)], WALKS))
    assert movement.positions(spark.createDataFrame([(1, 1, 7.0)], "house bigint, id bigint, at_s double"), again).first().x == -2.0


def test_affinity_and_partners_as_of(spark):
    """Chats that end later don't count, nor does one that ends at the time of asking."""
    chats = spark.createDataFrame([(1, 1, 2, 5.0, 1.0), (1, 1, 2, 20.0, 9.0), (1, 1, 3, 10.0, 2.0), (1, 1, 3, 9.0, 0.4)], "house bigint, src bigint, dst bigint, end_s double, hours double")
    asked = spark.createDataFrame([(1, 1, 2, 6.0), (1, 1, 2, 30.0), (1, 1, 3, 10.0), (1, 1, 3, 11.0), (1, 1, 9, 1.0)], "house bigint, src bigint, dst bigint, at_s double")
    got = {(r.dst, r.at_s): round(r.score, 6) for r in choice.running_affinity(chats, asked).collect()}
    assert got == {(2, 6.0): 2.2, (2, 30.0): 22.0, (3, 10.0): 0.88, (3, 11.0): 5.28, (9, 1.0): 0.0}
    members = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2), (7, 5, 0)], "house bigint, id bigint, ordinal int")
    rows = [(1, 1, 10.5, k) for k in range(100)] + [(1, 1, 25.0, 100 + k) for k in range(100)] + [(7, 5, 1.0, 500)]
    chosen = choice.partner_as_of(spark.createDataFrame(rows, "house bigint, id bigint, at_s double, decision int"), members, chats, "s").collect()
    early = [r.other for r in chosen if r.decision < 100]
    late = [r.other for r in chosen if 100 <= r.decision < 500]
    assert early.count(3) > 70 and late.count(2) > 70 and [r.other for r in chosen if r.decision == 500] == [None]


def test_commands_once_in_batch_and_stream(spark, tmp_path):
    rows = [(1, 1, "clock", "3"), (2, 1, "clock", "2"), (3, 1, "toolbar", "majlis"), (4, 1, "key", " "), (5, 1, "key", "8"), (6, 1, "key", "9"), (7, 1, "pointer", "object:sofa"), (8, 1, "pointer", "wall:"), (9, 1, "roster", "badr"), (10, 1, "pointer", "ground:3,4"), (11, 1, "key", "g"), (12, 1, None, None), (13, 1, "key", None)]
    made = spark.createDataFrame([(*r, f"2024-01-01 00:0{r[0] % 10}:00") for r in rows for _ in range(2)], "input_id bigint, house bigint, source string, name string, at string")
    made = made.select("input_id", "house", F.to_timestamp_ntz("at").alias("ts"), "source", "name")
    batch = commands.command_table(made)
    want = {1: "speed:3", 3: "scene", 4: "speed:toggle", 5: "select:7", 7: "use:sofa", 9: "select:badr", 10: "move:3,4", 11: "scene"}
    assert {r.input_id: r.command for r in batch.collect()} == want and batch.count() == len(want)
    src = str(tmp_path / "in")
    made.write.parquet(src)
    out = live.available_now(live.command_stream(spark.readStream.schema(made.schema).parquet(src)), "commands")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_late_commands_are_dropped(spark, tmp_path):
    """In triggers of one file each: what is over the watermark is late, a second delivery within it a repeat."""
    src = tmp_path / "in"
    schema = "input_id bigint, house bigint, ts timestamp_ntz, source string, name string"
    spark.createDataFrame([], schema).write.parquet(str(src))
    q = live.command_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)), "5 minutes").writeStream.format("memory").queryName("late").start()
    for part in ([(1, "10:00")], [(1, "10:00"), (2, "10:30")], [(3, "10:01"), (2, "10:30"), (4, "10:29")]):
        rows = [(i, 1, pd.Timestamp(f"2024-01-01 {t}"), "key", "g") for i, t in part]
        spark.createDataFrame(pd.DataFrame(rows, columns=["input_id", "house", "ts", "source", "name"]), schema).coalesce(1).write.mode("append").parquet(str(src))
        q.processAllAvailable()
    q.stop()
    assert sorted(r.input_id for r in spark.table("late").collect()) == [1, 2, 4]


def chats_at(spark, rows):
    """(house, chat, id, other, start s, length s) from 10:00 on."""
    start = pd.Timestamp("2024-01-01 10:00:00")
    made = [(h, c, a, b, start + pd.Timedelta(seconds=s), start + pd.Timedelta(seconds=s + n)) for h, c, a, b, s, n in rows]
    return spark.createDataFrame(pd.DataFrame(made, columns=["house", "chat", "id", "other", "ts", "over"]), "house bigint, chat bigint, id bigint, other bigint, ts timestamp, over timestamp")


def test_timers_fire_and_survive_a_restart(spark, tmp_path):
    """Answers and ends fire once the watermark is past them, over a restart from the checkpoint; a late chat is dropped."""
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    first = [(1, 1, 1, 2, 0, 1), (1, 2, 3, 2, 2, 30), (1, 3, 4, 5, 0, 2), (2, 4, 1, 2, 5, 100)]
    later = [(1, 5, 6, 7, 60, 5), (1, 6, 8, 9, -50, 500), (2, 7, 3, 4, 400, 5)]
    before = {k: spark.conf.get(k, None) for k in timers.STORE}
    try:
        for k, v in timers.STORE.items():
            spark.conf.set(k, v)
        for part in (first, later):
            chats_at(spark, part).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(chats_at(spark, first).schema).parquet(src)
            q = timers.chat_timers(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
            q.awaitTermination()
            if part is first:
                assert spark.read.schema(timers.FIRED).parquet(out).count() == 0  # the newest chat began at 5 s, so nothing is 10 s old
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = sorted((r.what, r.chat, r.id, (r.at - pd.Timestamp("2024-01-01 10:00:00")).total_seconds()) for r in spark.read.parquet(out).collect())
    over = [("over", c, who, float(t)) for c, a, b, t in ((1, 1, 2, 1), (2, 3, 2, 32), (3, 4, 5, 2), (4, 1, 2, 105), (5, 6, 7, 65)) for who in (a, b)]
    reply = [("reply", 1, 2, 2.6), ("reply", 2, 2, 4.6), ("reply", 4, 2, 7.6), ("reply", 5, 7, 62.6)]
    assert got == sorted(over + reply)


class Counted:
    """A handle of one group that counts calls: a list, a value and timers."""

    def __init__(self):
        self.calls, self.rows, self.one, self.timers = 0, [], None, set()

    def _call(self, out=None):
        self.calls += 1
        return out

    def getListState(self, *_):
        put = lambda x: self._call(self.rows.__setitem__(slice(None), x))
        return SimpleNamespace(appendValue=lambda x: self._call(self.rows.append(x)), get=lambda: self._call(iter(list(self.rows))), put=put, clear=lambda: put([]))

    def getValueState(self, *_):
        put = lambda x: self._call(setattr(self, "one", x))
        return SimpleNamespace(get=lambda: self._call(self.one), update=put, clear=lambda: put(None))

    def getMapState(self, *_):
        return SimpleNamespace(updateValue=lambda *_: self._call())

    def registerTimer(self, at):
        self._call(self.timers.add(at))

    def deleteTimer(self, at):
        self._call(self.timers.discard(at))


@pytest.mark.parametrize("seed", range(4))
def test_timers_of_many_chats_take_few_calls(seed):
    """However many chats of neighbouring houses are due, over several triggers, each answer and end fires
    once, as brute force says, with a handful of calls a trigger; nothing is left behind."""
    r, handle, timer, got, none = random.Random(seed), Counted(), timers.ChatTimers(), [], -(2**63)
    timer.init(handle)
    known = lambda x: none if r.random() < 0.05 else x
    chats = [(r.choice([none, 1, 2, 2**62]), k, known(r.randrange(4)), known(r.randrange(4)), t, known(t + r.choice([-5, 0, 2600, r.randrange(9000)]))) for k, t in enumerate(sorted(r.randrange(60_000) for _ in range(900)))]
    since = 0
    for upto, now in ((20_000, 15_000), (20_000, 20_000), (45_000, 40_000), (60_000, 10**6)):
        handle.calls, part = 0, [c for c in chats if since <= c[4] < upto]
        since = upto
        rows = pd.DataFrame(part, columns=["house", "chat", "id", "other", "start", "over"])
        list(timer.handleInputRows((0,), iter([rows[k : k + 300] for k in range(0, len(rows), 300)]), None))
        for at in sorted(t for t in handle.timers if t <= now):
            for out in timer.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None):  # noqa: B023
                got += [tuple(x) for x in out.itertuples(index=False)]
            handle.timers.discard(at)
        assert handle.calls <= 16
    both = [(h, who, s, e) for h, _, a, b, s, e in chats for who in (a, b)]
    want = [(h, c, b, s + 2600, True) for h, c, a, b, s, e in chats if none not in (h, b) and any((h, b) == x[:2] and x[2] <= s + 2600 < x[3] for x in both)]
    want += [(h, c, who, e, False) for h, c, a, b, s, e in chats if e != none for who in (a, b)]
    assert sorted(got) == sorted(want) and len(want) > 900
    assert not handle.timers and not handle.rows and handle.one is None


def test_registered_behind_those_there(spark):
    have = spark.createDataFrame([(1, "a", 0), (1, "b", 4), (2, "c", 0)], "house int, label string, ordinal int")
    new = spark.createDataFrame([(1, "y"), (1, "x"), (3, "z")], "house int, label string")
    got = catalog.register(have, new, ["house"], ["label"]).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 0), (1, "b", 4), (1, "x", 5), (1, "y", 6), (2, "c", 0), (3, "z", 0)]
    twice = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "k int, v string, at int")
    assert [r.v for r in catalog.by_id(spark.createDataFrame([(1,), (2,)], "k int"), twice, ["k"], "at").orderBy("k").collect()] == ["a", None]


def test_release_frees_who_sits(spark):
    e = spark.createDataFrame([("a", "gathered"), ("b", "walking"), ("c", "using")], "id string, state string")
    got = toggles.release_seated(e, F.lit(0.5)).orderBy("id").collect()
    assert [(r.next_state, r.idle_s) for r in got] == [("idle", 1.25), ("walking", None), ("using", None)]


@pytest.mark.parametrize("block", [None, "day"])
def test_state_histories_against_stepping(spark, block):
    r, rows, want = random.Random(12), [], {}
    table = {(a, b): c for a, b, c in segments.TRANSITIONS}
    events = sorted({b for _, b, _ in segments.TRANSITIONS}) + ["move", "unknown"]
    for who, n in ((1, 700), (2, 3)):
        state = "idle"
        for k in range(n):
            event, will = r.choice(events), r.choice([True, False, None])
            rows.append((who, k, k // 50, event, will))
            if event == "move":
                state = "walking"
            elif not (event == "decided" and will is False):
                state = table.get((state, event), state)
            want[who, k] = state
    made = spark.createDataFrame(rows, "who int, k int, day int, event string, free_will boolean").repartition(3)
    got = segments.state_history(made, ["who"], ["k"], block=block).collect()
    assert {(x.who, x.k): x.state for x in got} == want and set(want.values()) == set(segments.STATES)


def test_whole_cast(spark, tmp_path):
    (tmp_path / "profiles.json").write_text('{"id":"badr","name":"B","emoji":"x"}\n')
    (tmp_path / "lines.json").write_text('{"id":"badr","category":"idle","n":0,"text":"hm"}\n')
    got = {r.id: (r.name, r.emoji, r.lines) for r in catalog.whole_cast(spark, str(tmp_path)).collect()}
    assert len(got) == 8 and got["badr"] == ("B", "x", {"idle": ["hm"]}) and got["omar"] == (None, None, {})
