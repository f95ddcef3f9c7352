"""Runs watched while they go on: each run's events folded in the order of their numbers (ST3, ST5).

The fold reads events ``(run_id, seq, event, data)`` as they arrive. What it keeps of a run is one value, a row for each
file and model, and the few events that wait for one that is still missing; no list of events is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from plumbline import dims
from plumbline.streaming.events import PAYLOAD, rejection

#: What the fold reads of an event; ``event`` is null where the event was rejected and only its number counts.
STEP = (
    "seq long, at long, event string, model string, path string, modules int, detail string, usd double, report_usd double, analysed int"
)
FACTS = "model string, failed string, total long, read long, flagged long, usd double, calls long, ended boolean"
STAGES = ", ".join(f"{s} string" for s in dims.STAGES)
RUN = f"next long, last_at long, files long, ended_at long, missed long, {STAGES}, {FACTS}"
#: One row per run, file of a run and model of a run, each time it changes; ``as_of`` is the last event it has seen.
UPDATES = f"run_id string, kind string, name string, as_of long, state string, first_seq long, waiting long, missed long, {STAGES}, {FACTS}"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _names(shape: str) -> list[str]:
    return [part.split()[0] for part in shape.split(", ")]


class RunFold(StatefulProcessor):
    """Folds the events of a run strictly by number: an event that came before is ignored, one that is early waits."""

    def __init__(self, first_seq: int, most_waiting: int, patience_ms: int | None, forget_ms: int | None):
        self.first_seq, self.most_waiting, self.patience_ms, self.forget_ms = first_seq, most_waiting, patience_ms, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN)
        self.files = handle.getMapState("files", "path string", "flagged boolean, first long, last long")
        self.models = handle.getMapState("models", "model string", "usd double, calls long")
        self.waiting = handle.getMapState("waiting", "seq long", STEP)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        run, early = self._opened()
        touched: dict[str, dict] = {"files": {}, "models": {}}
        for row in rows:
            run["last_at"] = max(run["last_at"], row.at or 0)
            if row.seq == run["next"]:
                self._fold(run, touched, row)
                while run["next"] in early:
                    self._fold(run, touched, early.pop(run["next"]))
            elif row.seq > run["next"]:
                early[row.seq] = row
        while len(early) > self.most_waiting:
            self._pass_gap(run, touched, early)
        yield from self._closed(key, run, touched, early)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        run, early = self._opened()
        if early:
            touched: dict[str, dict] = {"files": {}, "models": {}}
            while early:
                self._pass_gap(run, touched, early)
            yield from self._closed(key, run, touched, early)
        elif run["ended"] and self.forget_ms is not None:
            for kept in (self.run, self.files, self.models, self.waiting):
                kept.clear()

    def close(self) -> None:
        pass

    # -- state -----------------------------------------------------------------------------------------

    def _opened(self) -> tuple[dict[str, Any], dict[int, Row]]:
        """The run as it stands, and the events that wait."""
        if not self.run.exists():
            fresh = dict.fromkeys(_names(RUN), 0) | dict.fromkeys(dims.STAGES, "waiting")
            return fresh | {"next": self.first_seq, "model": "", "failed": "", "usd": 0.0, "ended": False}, {}
        run = dict(zip(_names(RUN), self.run.get(), strict=True))
        early = {}
        if self.waiting.exists():
            early = {k[0]: Row(*_names(STEP))(*v) for k, v in self.waiting.iterator()}
            self.waiting.clear()
        return run, early

    def _closed(self, key, run: dict, touched: dict, early: dict) -> Iterator[Row]:
        self.run.update(tuple(run[c] for c in _names(RUN)))
        for path, held in touched["files"].items():
            self.files.updateValue((path,), tuple(held))
        for model, held in touched["models"].items():
            self.models.updateValue((model,), tuple(held))
        for seq, step in early.items():
            self.waiting.updateValue((seq,), tuple(step[c] for c in _names(STEP)))
        timed = self.patience_ms is not None or self.forget_ms is not None
        for timer in list(self.handle.listTimers()) if timed else ():
            self.handle.deleteTimer(timer)
        pause = self.patience_ms if early else self.forget_ms if run["ended"] else None
        if pause is not None:
            self.handle.registerTimer(run["last_at"] + pause)
        yield from self._told(key, run, touched, len(early))

    def _told(self, key, run: dict, touched: dict, waiting: int) -> Iterator[Row]:
        """What changed: the run, its files and its models. Once a run completes, all files it was reading are read."""
        shape, as_of = Row(*_names(UPDATES)), run["next"] - 1

        def row(kind: str, name: str, **known):
            known |= {"run_id": key[0], "kind": kind, "name": name, "as_of": as_of}
            return shape(*(known.get(c) for c in _names(UPDATES)))

        yield row("run", "", waiting=waiting, missed=run["missed"], **{c: run[c] for c in (*dims.STAGES, *_names(FACTS))})
        files = touched["files"].items()
        if touched.get("settled"):
            files = ((k[0], v) for k, v in self.files.iterator())
        for path, (flagged, first, last) in files:
            state = "flagged" if flagged else "read" if run["ended_at"] > last else "reading"
            yield row("file", path, state=state, first_seq=first)
        for model, (usd, calls) in touched["models"].items():
            yield row("model", model, usd=usd, calls=calls)

    # -- the fold --------------------------------------------------------------------------------------

    def _pass_gap(self, run: dict, touched: dict, early: dict) -> None:
        """Gives up what is missing before the first event that waits, and folds on to the next gap."""
        first = min(early)
        run["missed"] += first - run["next"]
        run["next"] = first
        while run["next"] in early:
            self._fold(run, touched, early.pop(run["next"]))

    def _touch(self, touched: dict, what: str, key: str, fresh: list) -> tuple[list, bool]:
        """A file's or model's numbers to be changed in place, read from the state once a batch; and whether it is new."""
        held, store = touched[what], getattr(self, what)
        if key in held:
            return held[key], False
        known = store.containsKey((key,))
        held[key] = list(store.getValue((key,))) if known else fresh
        return held[key], not known

    def _fold(self, run: dict, touched: dict, step: Row) -> None:
        run["next"], event = step.seq + 1, step.event
        if event is None:
            return
        if step.usd is not None:
            run["usd"] += step.usd
            run["calls"] += 1
            spent, _ = self._touch(touched, "models", run["model"] or "model", [0.0, 0])
            spent[0] += step.usd
            spent[1] += 1
        reached = dims.STAGE_OF_EVENT.get(event)
        if reached:
            at = dims.STAGES.index(reached)
            run.update(dict.fromkeys(dims.STAGES[:at], "done") | {reached: "running"})
        if event in ("agent.started", "finding.detected") and step.path:
            found = event == "finding.detected"
            file, new = self._touch(touched, "files", step.path, [False, step.seq, step.seq])
            run["files"] += new
            run["flagged"] += found - file[0]
            file[0], file[2] = found, step.seq
            if not found:
                run["read"] = run["files"]
        elif event == "review.started" and step.model:
            run["model"] = step.model
        elif event == "structure.discovered" and step.modules is not None:
            run["total"] = step.modules
        elif event == "review.failed":
            run["failed"], run["ended"] = "the run failed" if step.detail is None else step.detail, True
        elif event == "review.completed":
            run.update(dict.fromkeys(dims.STAGES, "done") | {"ended_at": step.seq, "ended": True})
            touched["settled"] = True
            if step.report_usd is not None:
                run["usd"] = step.report_usd
            if step.analysed is not None:
                run["read"] = step.analysed


def steps(events: DataFrame, time: str | None = None) -> DataFrame:
    """Events parsed to what the fold reads; a rejected event keeps its number and time only."""
    at = F.lit(None).cast("long") if time is None else F.unix_millis(time)
    started, found = F.col("event") == "agent.started", F.col("event") == "finding.detected"
    good = rejection().isNull()
    p = {f.name: F.when(good, F.col(f"_p.{f.name}")) for f in T.StructType.fromDDL(PAYLOAD)}
    read = events.withColumn("_p", F.from_json("data", PAYLOAD, {"mode": "PERMISSIVE"}))
    return read.select(
        "run_id",
        F.col("seq").cast("long").alias("seq"),
        at.alias("at"),
        F.when(good, F.col("event")).alias("event"),
        *([] if time is None else [F.col(time).alias("_time")]),
        p["model"].alias("model"),
        F.when(started, p["module"]).when(found, p["finding"]["path"]).alias("path"),
        p["modules"].alias("modules"),
        p["detail"].alias("detail"),
        p["usage"]["usd"].alias("usd"),
        p["report"]["usd"].alias("report_usd"),
        F.size(p["report"]["coverage"]["analysed"]).alias("analysed"),
    ).withColumn("analysed", F.when(F.col("analysed") >= 0, F.col("analysed")))


def live_runs(
    events: DataFrame,
    first_seq: int = 1,
    most_waiting: int = 10_000,
    time: str | None = None,
    delay: str = "1 minute",
    patience: timedelta = timedelta(minutes=10),
    forget: timedelta | None = None,
) -> DataFrame:
    """A stream of ``UPDATES`` rows for a stream of events: run state, file states and spend per model, from one fold.

    Events count once and in the order of ``seq`` (from ``first_seq``, without holes where nothing is lost); a redelivered one
    changes nothing. An early event waits in the state, at most ``most_waiting`` of a run; beyond them, what is missing is
    counted as ``missed`` and the fold goes on. With a ``time`` column (a timestamp, watermarked by ``delay``) it also goes on
    once the watermark is ``patience`` past the run's last event, and ``forget`` clears the state of a run that long after its
    end; an event later than the watermark counts as missing. Null run ids and numbers are left out. Start the stream with
    ``drain``, or in update mode with the state store of ``ROCKS``.
    """
    wait, keep = (None if span is None or time is None else round(span.total_seconds() * 1000) for span in (patience, forget))
    fold = RunFold(first_seq, most_waiting, wait, keep)
    numbered = events.where(F.col("run_id").isNotNull() & F.col("seq").isNotNull())
    if time is None:
        return steps(numbered).groupBy("run_id").transformWithState(fold, T.StructType.fromDDL(UPDATES), "Update", "None")
    timed = steps(numbered.withWatermark(time, delay), time)
    return timed.groupBy("run_id").transformWithState(fold, T.StructType.fromDDL(UPDATES), "Update", "EventTime")


def drain(updates: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there and stops; returns every update so far, with the ``batch`` that brought it.

    ``folder`` holds checkpoint and updates and must be shared by all executors; called again with the same folder, the stream
    goes on where it stopped. A batch that is run again after a failure overwrites its own updates.
    """
    spark = updates.sparkSession

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/updates/batch={batch}")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        writer = updates.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(f"{UPDATES}, batch long").option("basePath", f"{folder}/updates").parquet(f"{folder}/updates")


def latest(updates: DataFrame) -> DataFrame:
    """The last update of every run, file and model."""
    keys = ["run_id", "kind", "name"]
    rest = F.struct(*[c for c in _names(UPDATES) if c not in keys])
    return updates.groupBy(*keys).agg(F.max_by(rest, "batch").alias("_u")).select(*keys, "_u.*")


def run_states(last: DataFrame) -> DataFrame:
    """The rows of ``latest`` that ``events.live_run_state`` gives for a batch."""
    return last.where("kind = 'run'").select("run_id", *dims.STAGES, "model", "failed", "total", "read", "flagged")


def file_states(last: DataFrame) -> DataFrame:
    """The rows of ``latest`` that ``events.file_states`` gives for a batch."""
    return last.where("kind = 'file'").select("run_id", F.col("name").alias("path"), "state", "first_seq")


def spend(last: DataFrame) -> DataFrame:
    """(run_id, model, usd, calls): what was spent on each model, and the run's total under its report as ``total``."""
    total = F.when(F.col("kind") == "run", F.lit("total")).otherwise(F.col("name"))
    return last.where("kind <> 'file'").select("run_id", total.alias("model"), "usd", "calls")
