"""Keyed state machines on streams. Every one has a batch twin in ``lensfold.operators`` with the same answer.

Rows wait in the state until the watermark has passed them and then run in event-time order, so the order in which they
arrive doesn't matter as long as they aren't later than the watermark; later ones are dropped and counted
(``late_rows``). An answer therefore comes one watermark delay after its row. The state of a key is what waits and what
is stated at each machine; where time can end it, a timer removes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lensfold.operators.metrics import QUOTA_BANDS, quota_step

WATERMARK = "10 minutes"
Step = Callable[[tuple | None, list[tuple]], tuple[tuple | None, list[tuple]]]


#: Rows wait in groups of so many seconds of event time; a group is one value of the map state.
WAITING_SECONDS = 60


class _Machine(StatefulProcessor):
    """Rows wait in a map from a span of event time to the rows in it; what is stated and the number of the next timer are values.

    A call writes the spans that its rows fall into and removes those that the watermark has passed: others aren't touched, however
    many rows wait."""

    def __init__(self, step: Step, state: str, waiting: str, names: Sequence[str], places: Sequence[int], timeout, expired):
        self.step, self.state_schema, self.waiting_schema, self.names = step, state, waiting, list(names)
        self.places, self.timeout, self.expired = list(places), timeout, expired  # columns of time and inputs: names may be changed on the way

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", self.state_schema)
        self.waiting = handle.getMapState("waiting", "span bigint", self.waiting_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans: dict[int, list[tuple]] = {}
        for pdf in rows:
            for r in pdf.iloc[:, self.places].itertuples(index=False, name=None):
                spans.setdefault(r[0] // (WAITING_SECONDS * 1_000_000), []).append(r)
        for span, own in spans.items():
            held = self._rows(self.waiting.getValue((span,))) if self.waiting.containsKey((span,)) else []
            self.waiting.updateValue((span,), self._columns(held + own))
        yield from self._run(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(key, timerValues.getCurrentWatermarkInMs())

    @staticmethod
    def _rows(columns: tuple) -> list[tuple]:
        return list(zip(*columns, strict=True))

    @staticmethod
    def _columns(rows: list[tuple]) -> tuple:
        return tuple(list(c) for c in zip(*rows, strict=True))

    def _run(self, key, mark: int) -> Iterator[pd.DataFrame]:
        ready, first = [], None
        spans = sorted(k[0] for k in self.waiting.keys())
        for span in spans:
            if span * WAITING_SECONDS * 1000 > mark:
                first = span * WAITING_SECONDS * 1000
                break
            rows = self._rows(self.waiting.getValue((span,)))
            later = [r for r in rows if r[0] > mark * 1000]
            ready += [r for r in rows if r[0] <= mark * 1000]
            if later:
                if len(later) < len(rows):
                    self.waiting.updateValue((span,), self._columns(later))
                first = min(r[0] for r in later) // 1000
                break
            self.waiting.removeKey((span,))
        current = tuple(self.current.get()) if self.current.exists() else None
        before, out = current, []
        if ready:
            current, out = self.step(current, sorted(ready))
        end = self.timeout(current) if self.timeout is not None and current is not None else None
        if end is not None and end <= mark:
            out = out + (self.expired(current) if self.expired else [])
            current = end = None
        if current is None and before is not None:
            self.current.clear()
        elif current is not None and current != before:
            self.current.update(tuple(current))
        due = [t for t in (end, None if first is None else first + 1) if t is not None]
        if due:
            self.handle.registerTimer(max(min(due), mark + 1))
        if out:
            yield pd.DataFrame([(*key, *row) for row in out], columns=self.names)

    def close(self) -> None:
        pass


def keyed_machine(
    stream: DataFrame, key: Sequence[str], ts: str, inputs: Sequence[str], step: Step, state: str, output: str,
    timeout: Callable[[tuple], int | None] | None = None, expired: Callable[[tuple], list[tuple]] | None = None, watermark: str = WATERMARK,
) -> DataFrame:
    """Append-mode stream of (key..., output...). ``step(state, rows)`` sees rows as (micros, inputs...) in order.

    ``timeout(state)`` is the event time in milliseconds at which ``expired(state)`` speaks and the state ends if nothing
    came; None keeps it.
    """
    on = list(key)
    schema = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in on)
    names = [*on, *[f.name for f in T._parse_datatype_string(output).fields]]
    waiting = ", ".join(["us array<bigint>", *[f"in_{i} array<{stream.schema[c].dataType.simpleString()}>" for i, c in enumerate(inputs)]])
    columns = [*on, ts, *[c for c in inputs if c != ts and c not in on]]
    rows = stream.withWatermark(ts, watermark).select(*columns, F.unix_micros(ts).alias("us"))
    machine = _Machine(step, state, waiting, names, [len(columns), *[columns.index(c) for c in inputs]], timeout, expired)
    return rows.groupBy(*on).transformWithStateInPandas(machine, f"{schema}, {output}", "Append", "EventTime")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has dropped so far because they came after the watermark, as far as its progress reports reach."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def _after(micros: int | None) -> int | None:
    """First whole millisecond after an instant."""
    return None if micros is None else micros // 1000 + 1


def limit_stream(stream: DataFrame, key: Sequence[str], ts: str, seconds: float, limit: int, **kw) -> DataFrame:
    """(key, us, allowed). State: the newest ``limit`` instants, which decide the next one."""
    width = int(seconds * 1_000_000)

    def step(state, rows):
        recent, out = list(state[0]) if state else [], []
        for (us,) in rows:
            if recent and us == recent[-1]:
                continue
            recent = [t for t in recent if t > us - width]
            out.append((us, len(recent) < limit))
            recent = [*recent, us][-limit:]
        return (recent,), out

    end = lambda s: _after(s[0][-1] + width)
    return keyed_machine(stream, key, ts, [], step, "recent array<bigint>", "us bigint, allowed boolean", end, **kw)


def throttle_stream(stream: DataFrame, key: Sequence[str], ts: str, ttl: float, most: int = 2, **kw) -> DataFrame:
    """(key, us, place, allowed). State: end of the open window and the events in it. ``most=1`` is the debounce."""
    width = int(ttl * 1_000_000)

    def step(state, rows):
        until, place = state or (None, 0)
        out = []
        for (us,) in rows:
            until, place = (us + width, 1) if until is None or us >= until else (until, place + 1)
            out.append((us, place, place <= most))
        return (until, place), out

    end = lambda s: _after(s[0])
    return keyed_machine(stream, key, ts, [], step, "until bigint, place bigint", "us bigint, place bigint, allowed boolean", end, **kw)


def attempts_stream(stream: DataFrame, key: Sequence[str], ts: str, success: str, ttl: float, most: int, **kw) -> DataFrame:
    """(key, us, attempt, blocked). State: attempts since the last reset and the time of the last one."""
    width = int(ttl * 1_000_000)

    def step(state, rows):
        count, last = state or (0, None)
        out = []
        for us, ok in rows:
            count = 1 if last is None or us - last >= width else count + 1
            out.append((us, count, count > most))
            count, last = (0 if ok and count <= most else count), us
        return (count, last), out

    end = lambda s: _after(s[1] + width)
    return keyed_machine(stream, key, ts, [success], step, "count bigint, last bigint", "us bigint, attempt bigint, blocked boolean", end, **kw)


def notifications_stream(alerts: DataFrame, group: Sequence[str], ts: str, repeat: float = 4 * 3600, **kw) -> DataFrame:
    """(group, us) of the notices sent: at most one per group and ``repeat`` seconds."""
    sent = throttle_stream(alerts, group, ts, repeat, 1, **kw)
    return sent.where("place = 1").select(*group, "us")


def _advance(run: tuple, us: int, good: bool, need: int, gap: int | None) -> tuple[tuple, tuple | None]:
    """Next (start, last, fired) of a run, and (start, us) when it has just lasted long enough."""
    start, last, fired = run
    if not good:
        return (None, us, False), None
    if start is None or (gap is not None and us - last > gap):
        start, fired = us, False
    fires = not fired and us - start >= need
    return (start, us, fired or fires), ((start, us) if fires else None)


def runs_stream(stream: DataFrame, key: Sequence[str], ts: str, on: str, period: float, max_gap: float | None = None, **kw) -> DataFrame:
    """(key, started_us, fired_us) once per run of the boolean column ``on``. State: start and last row of the run; it ends
    ``max_gap`` after the last row (without a gap a run never ends by itself, and its state stays)."""
    need, gap = int(period * 1_000_000), None if max_gap is None else int(max_gap * 1_000_000)

    def step(state, rows):
        run, out = state or (None, None, False), []
        for us, good in rows:
            run, fired = _advance(run, us, good, need, gap)
            out += [fired] if fired else []
        return run, out

    end = None if gap is None else lambda s: _after(s[1] + gap)
    return keyed_machine(stream, key, ts, [on], step, "start bigint, last bigint, fired boolean", "started_us bigint, fired_us bigint", end, **kw)


def not_draining_stream(
    stream: DataFrame, key: Sequence[str], ts: str, value: str, above: float, seconds: float, interval: float = 60, **kw
) -> DataFrame:
    """(key, started_us, fired_us) when a backlog above a limit did not shrink for ``seconds``. State: the samples of
    the trailing window and the run."""
    width, gap = int(seconds * 1_000_000), int(interval * 1_000_000)

    def step(state, rows):
        times, values, *run = state or ([], [], None, None, False)
        times, values, run, out = list(times), list(values), tuple(run), []
        for us, v in rows:
            times.append(us)
            values.append(v)
            while times[0] <= us - width:
                times.pop(0)
                values.pop(0)
            run, fired = _advance(run, us, v > above and not v - values[0] < 0, width, gap)
            out += [fired] if fired else []
        return (times, values, *run), out

    schema = "times array<bigint>, samples array<double>, start bigint, last bigint, fired boolean"
    end = lambda s: _after(s[3] + max(width, gap))
    return keyed_machine(stream, key, ts, [value], step, schema, "started_us bigint, fired_us bigint", end, **kw)


def quiet_stream(stream: DataFrame, key: Sequence[str], ts: str, kind: str, value: str, seconds: float, below: float, **kw) -> DataFrame:
    """(key, us, absent) for ``state`` rows that are on while the ``load`` rows of the trailing window stayed below a
    limit or are absent. ``kind`` is ``load`` or ``state``. State: the load samples of the window."""
    width = int(seconds * 1_000_000)

    def step(state, rows):
        times, values = (list(x) for x in state) if state else ([], [])
        out = []
        for us, what, v in rows:
            if what == "load":
                times.append(us)
                values.append(v)
            while times and times[0] <= us - width:
                times.pop(0)
                values.pop(0)
            if what == "state" and v == 1 and (not values or max(values) < below):
                out.append((us, not values))
        return (times, values), out

    end = lambda s: _after(s[0][-1] + width) if s[0] else 0
    return keyed_machine(stream, key, ts, [kind, value], step, "times array<bigint>, samples array<double>", "us bigint, absent boolean", end, **kw)


def quota_stream(stream: DataFrame, owner: Sequence[str], ts: str, percent: str, **kw) -> DataFrame:
    """(owner, us, band) for each announced band. State: the last band, one number per owner, kept for good: a band is
    announced once however long an owner is silent."""

    def step(state, rows):
        last = state[0] if state else 0
        out = []
        for us, value in rows:
            alert, last = quota_step(value, last)
            if alert:
                out.append((us, QUOTA_BANDS[alert - 1]))
        return (last,), out

    return keyed_machine(stream, owner, ts, [percent], step, "last int", "us bigint, band double", **kw)


def stall_stream(stream: DataFrame, job: Sequence[str], ts: str, stall: float, **kw) -> DataFrame:
    """(job, last_us) when a job had no activity for ``stall`` seconds, once per silence. State: last activity.

    The verdict comes from an event-time timer, so it needs no further row of the silent job.
    """
    width = int(stall * 1_000_000)

    def step(state, rows):
        last, out = state[0] if state else None, []
        for (us,) in rows:
            if last is not None and us - last >= width:
                out.append((last,))
            last = us
        return (last,), out

    return keyed_machine(
        stream, job, ts, [], step, "last bigint", "last_us bigint",
        timeout=lambda s: _after(s[0] + width), expired=lambda s: [(s[0],)], **kw,
    )


def reconcile_stream(
    stream: DataFrame, job: Sequence[str], ts: str, kind: str, tie: str, fresh: float = 180, stall: float = 1800, debounce: float = 300, **kw
) -> DataFrame:
    """(job, us, tie, verdict) of every ``check`` row, as in ``metrics.reconcile``. State: last start and heartbeat, whether
    this attempt was given up, and until when no further requeue is due."""
    fresh_us, stall_us, debounce_us = (int(x * 1_000_000) for x in (fresh, stall, debounce))

    def step(state, rows):
        started, beat, given_up, until = state or (None, None, False, None)
        out = []
        for us, order, what in rows:
            if what == "start":
                started, beat, given_up = us, None, False
                continue
            started = us if started is None else started
            if what == "heartbeat":
                beat = us
                continue
            idle = us - (started if beat is None else beat)
            if beat is not None and idle < fresh_us:
                verdict = "healthy"
            elif idle >= stall_us:
                verdict, given_up = ("skipped" if given_up else "reverted"), True
            else:
                requeues = until is None or us >= until
                verdict, until = ("requeued", us + debounce_us) if requeues else ("waiting", until)
            out.append((us, order, verdict))
        return (started, beat, given_up, until), out

    kind_of_tie = stream.schema[tie].dataType.simpleString()
    return keyed_machine(
        stream, job, ts, [tie, kind], step, "started bigint, beat bigint, given_up boolean, until bigint", f"us bigint, {tie} {kind_of_tie}, verdict string", **kw
    )


def progress_stream(stream: DataFrame, job: Sequence[str], ts: str, done: str, expiry: float = 86400, **kw) -> DataFrame:
    """(job, us, done) whenever progress moves forward; steps back are ignored, silent jobs are forgotten."""
    width = int(expiry * 1_000_000)

    def step(state, rows):
        best, last = state or (None, None)
        out = []
        for us, value in rows:
            if last is not None and us - last >= width:
                best = None
            if best is None or value > best:
                best = value
                out.append((us, value))
            last = us
        return (best, last), out

    return keyed_machine(
        stream, job, ts, [done], step, "best bigint, last bigint", "us bigint, done bigint",
        timeout=lambda s: _after(s[1] + width), **kw,
    )
