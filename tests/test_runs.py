"""Streams against their batch twins, and the ordered helpers against plain folds."""

import random
import time
from datetime import timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import scan
from plumbline.streaming import events as ev
from plumbline.streaming import live

EVENT = "run_id string, seq bigint, offset_ms bigint, event string, data string, at timestamp"


def sample(spark, tmp_path):
    rnd = random.Random(5)
    kinds = ["review.started", "agent.started", "finding.detected", "context.updated", "agent.finished", "review.completed", "nonsense"]
    payload = {
        "review.started": '{"model":"m%d"}', "agent.started": '{"module":"f%d.py"}', "finding.detected": '{"finding":{"path":"f%d.py","line":1,"symbol":"s"}}',
        "context.updated": '{"what":"memo","count":%d}', "agent.finished": '{"usage":{"usd":0.%d}}', "review.completed": '{"report":{"usd":%d.0}}', "nonsense": "{}",
    }
    rows = []
    for run in ("r1", "r2"):
        for seq in range(1, 120):
            kind = rnd.choice(kinds if seq > 100 else kinds[:5] + kinds[6:])
            text = payload[kind] % rnd.randint(1, 4) if "%" in payload[kind] else payload[kind]
            rows.append((run, seq, seq * 10, kind, text))
    df = spark.createDataFrame(rows, EVENT.rsplit(",", 1)[0]).withColumn("at", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    folder = str(tmp_path / "events")
    df.repartition(3).write.json(folder)
    return df, folder


def drained(spark, stream, name, tmp_path, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    df, folder = sample(spark, tmp_path)
    live = spark.readStream.schema(EVENT).json(folder)
    batch, _ = ev.typed_events(df)
    stream, _ = ev.typed_events(live)
    for name, fold in (("stages", ev.stage_states), ("counters", ev.context_counters), ("ended", ev.terminal_runs)):
        got = drained(spark, fold(stream), name, tmp_path, "complete").collect()
        assert sorted(map(str, got)) == sorted(map(str, fold(batch).collect())), name


def test_redelivered_findings_show_once_on_a_stream(spark, tmp_path):
    df, folder = sample(spark, tmp_path)
    df.write.mode("append").json(folder)  # everything is delivered twice
    stream, _ = ev.typed_events(spark.readStream.schema(EVENT).json(folder))
    got = drained(spark, ev.dedupe_findings(stream, "1 hour").select("run_id", "path", "line", "symbol"), "once", tmp_path, "append")
    want = ev.dedupe_findings(ev.typed_events(df)[0]).select("run_id", "path", "line", "symbol")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_spend_after_the_report_is_added(spark):
    rows = [
        ("r", 1, "agent.finished", '{"usage": {"usd": 1.0}}'),
        ("r", 2, "review.completed", '{"report": {"usd": 3.0}}'),
        ("r", 3, "agent.finished", '{"usage": {"usd": 0.2}}'),
    ]
    typed, _ = ev.typed_events(spark.createDataFrame(rows, "run_id string, seq bigint, event string, data string"))
    got = ev.run_spend(typed).first()
    assert abs(got.usd - 3.2) < 1e-9 and got.calls == 2


def test_a_step_is_narrated_for_its_own_repository(spark):
    steps = spark.createDataFrame(
        [("A", "r", 1, "triage", "skipped", '{"path":"a.py","specialists":["data"],"why":""}', None)],
        "repo_id string, run_id string, seq bigint, agent string, action string, detail string, response string",
    )
    mods = spark.createDataFrame([("A", "a.py", ["data"]), ("B", "a.py", ["data"])], "repo_id string, path string, signals array<string>")
    assert ev.narrate(steps, mods).count() == 1


def test_history_folds(spark):
    schema = "n int, event string, run_id string, model string, scope string, modules int, started_at string, finished_at string, read int, findings int, usd double, report string"
    rows = [
        (1, "begin", "a", "m", "", 167, "2026-01-01 00:00:00", None, None, None, None, None),
        (2, "begin", "b", "m", "", 10, "2026-01-02 00:00:00", None, None, None, None, None),
        (3, "finish", "a", None, None, None, None, "2026-01-01 01:00:00", 100, 1, 1.0, ""),
        (4, "finish", "a", None, None, None, None, "2026-01-01 02:00:00", 167, 4, 1.87, "r.md"),
        (5, "finish", "ghost", None, None, None, None, "2026-01-01 02:00:00", 1, 1, 1.0, ""),
    ]
    got = {r.run_id: r for r in ev.run_history(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"a", "b"} and got["b"].interrupted and (got["a"].read, got["a"].usd) == (167, 1.87)
    assert got["a"].summary == "2026-01-01 00:00:00  read 167 of 167 modules, 4 findings, $1.8700, r.md"


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_spans_equal_the_plain_fold(spark, monkeypatch, fan):
    monkeypatch.setattr(ev, "FAN", fan)
    rnd = random.Random(11 + fan)
    rows = [("r", rnd.choice("xy"), i, rnd.randint(0, 500), rnd.random() < 0.45) for i in range(400)]
    df = spark.createDataFrame(rows, "run_id string, agent string, seq bigint, at bigint, is_start boolean")
    want = []
    for agent in "xy":
        spans = []
        for _, a, _, at, starts in rows:
            if a != agent:
                continue
            waiting = [s for s in spans if s[1] is None]
            if starts or not waiting:
                spans.append([at, None])
            else:
                waiting[0][1] = max(at, waiting[0][0])
        want += [(agent, n, *s) for n, s in enumerate(spans, 1)]
    got = [(r.agent, r.n, r.started_at, r.ended_at) for r in ev.agent_spans(df, slice_rows=7).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sliced_scans_equal_windows(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "cold"]), i, rnd.randint(0, 9), rnd.choice([None, "u", "v"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int, w string")
    w = Window.partitionBy("k").orderBy("i")
    cut = F.floor(F.col("i") / 16)
    summed = scan.running_sum(df, ["k"], [F.col("i")], cut, F.col("v"), "s")
    want = df.withColumn("s", F.sum("v").over(w))
    assert summed.select(*want.columns).exceptAll(want).isEmpty()
    for current in (True, False):
        got = scan.carried(df, ["k"], [F.col("i")], cut, F.col("w"), "c", include_current=current)
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if current else -1)
        plain = df.withColumn("c", F.last("w", ignorenulls=True).over(frame))
        assert got.select(*plain.columns).exceptAll(plain).isEmpty()


def test_a_hot_key_joins_whole(spark):
    big = spark.range(500).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    got = scan.spread_join(big, small, ["k"], "left")
    assert got.count() == 500 and got.filter("twice <> k * 2 or twice is null").isEmpty()


def test_torn_lines_cost_only_themselves(spark, tmp_path):
    from plumbline.sources import jsonl

    (tmp_path / "a.jsonl").write_text('{"run_id":"r","seq":1,"agent":"x"}\n\n[1]\n{"run_id":"r","se')
    rows = jsonl.scan_trajectory(spark, str(tmp_path / "a.jsonl")).collect()
    assert [(r.run_id, r.seq) for r in rows] == [("r", 1)]


def test_streamed_history_closes_and_gives_up(spark, tmp_path):
    """Begin and finish meet on a stream; a begin whose finish never comes is interrupted once time has passed."""
    schema = "event string, run_id string, model string, scope string, modules int, started_at string, finished_at string, read int, findings int, usd double, report string, at timestamp"
    folder = tmp_path / "log"
    row = lambda event, run, second: (event, run, "m", "", 5, "s", "f" if event == "finish" else None, 3, 1, 0.5, "", second)

    def write(name, rows):
        made = spark.createDataFrame(rows, schema.replace("at timestamp", "sec bigint"))
        made.withColumn("at", F.timestamp_seconds("sec")).drop("sec").coalesce(1).write.json(str(folder / name))

    write("one", [row("begin", "a", 1000), row("begin", "b", 1001), row("finish", "a", 1060)])
    write("two", [row("begin", "c", 9000), row("finish", "c", 9001)])
    write("three", [row("begin", "d", 20000), row("finish", "d", 20001)])
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "*"))
    got = drained(spark, ev.run_history_stream(live, "at", "10 minutes"), "history", tmp_path, "append").collect()
    seen = {r.run_id: r.interrupted for r in got}
    assert seen["a"] is False and seen["b"] is True and seen["c"] is False


def rounded(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


def assert_live_equals(df, last):
    typed, _ = ev.typed_events(df)
    assert rounded(live.run_states(last).collect()) == rounded(ev.live_run_state(typed).select(*live.run_states(last).columns).collect())
    assert rounded(live.file_states(last).collect()) == rounded(ev.file_states(typed).select("run_id", "path", "state", "first_seq").collect())
    total = ev.run_spend(typed).withColumn("model", F.lit("total"))
    assert rounded(live.spend(last).collect()) == rounded(ev.live_spend(typed).unionByName(total).select("run_id", "model", "usd", "calls").collect())


def test_live_fold_equals_batch_over_a_restart(spark, tmp_path):
    """Events arrive out of order, twice, and over a stream that is stopped half-way and goes on from its checkpoint."""
    df, _ = sample(spark, tmp_path)
    df = df.withColumn("data", F.when(F.col("seq") == 111, F.lit('{"report":{"usd":2.5,"coverage":{"analysed":["a","b"]}}}')).otherwise(F.col("data")))
    df = df.withColumn("event", F.when(F.col("seq") == 111, F.lit("review.completed")).otherwise(F.col("event")))
    folder, shared = str(tmp_path / "live"), str(tmp_path / "drained")
    halves = df.where("seq % 3 <> 0 or seq > 100"), df.where("seq % 3 = 0 or seq between 40 and 60")
    halves[0].repartition(2).write.json(folder)

    def stream():
        return live.live_runs(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(folder))

    first = live.latest(live.drain(stream(), shared)).where("kind = 'run'").collect()
    assert all(r.as_of == 2 and r.waiting > 0 and r.missed == 0 for r in first)  # the third event is still missing
    halves[1].repartition(3).write.mode("append").json(folder)
    updates = live.drain(stream(), shared)
    assert updates.select("batch").distinct().count() >= 5
    last = live.latest(updates)
    assert {(r.as_of, r.waiting, r.missed) for r in last.where("kind = 'run'").collect()} == {(119, 0, 0)}
    assert_live_equals(df, last)


def test_live_fold_passes_what_is_lost(spark, tmp_path):
    """With too many events waiting, or after the patience, the fold goes on past the hole and says how many it missed."""
    df, _ = sample(spark, tmp_path)
    lossy = df.where("seq not in (5, 6, 50)")
    lossy.repartition(1).write.json(str(tmp_path / "in"))
    events = spark.readStream.schema(EVENT).json(str(tmp_path / "in"))
    last = live.latest(live.drain(live.live_runs(events, most_waiting=0), str(tmp_path / "a")))
    assert {(r.as_of, r.waiting, r.missed) for r in last.where("kind = 'run'").collect()} == {(119, 0, 3)}
    assert_live_equals(lossy, last)
    waits = live.live_runs(events, time="at", delay="5 seconds", patience=timedelta(seconds=30))
    held = live.latest(live.drain(waits, str(tmp_path / "b"))).where("kind = 'run'").collect()
    assert {(r.as_of, r.missed) for r in held} == {(4, 0)}
    later = spark.createDataFrame([("other", 1, 0, "review.failed", "{}")], EVENT.rsplit(",", 1)[0])
    later.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000 + 300))).write.mode("append").json(str(tmp_path / "in"))
    last = live.latest(live.drain(waits, str(tmp_path / "b"))).where("run_id <> 'other'")
    assert {(r.as_of, r.missed) for r in last.where("kind = 'run'").collect()} == {(119, 3)}
    assert_live_equals(lossy, last)


def test_live_fold_of_odd_events(spark, tmp_path):
    rows = [("r", 1, 0, "agent.started", None), ("r", 2, 0, "agent.finished", "no json"), ("r", 3, 0, None, "{}"), ("r", 4, 0, "review.failed", "{}"), (None, 1, 0, "review.failed", "{}"), ("s", None, 0, "review.failed", "{}")]
    spark.createDataFrame(rows, EVENT.rsplit(",", 1)[0]).write.json(str(tmp_path / "in"))
    last = live.latest(live.drain(live.live_runs(spark.readStream.schema(EVENT).json(str(tmp_path / "in"))), str(tmp_path / "out"))).collect()
    assert [(r.run_id, r.kind, r.as_of, r.specialists, r.failed, r.read, r.usd, r.ended) for r in last] == [("r", "run", 4, "running", "the run failed", 0, 0.0, True)]
