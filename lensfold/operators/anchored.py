"""Windows that open at an event and stay open for a fixed time, and small state machines, over hot keys.

Both are sequential by nature: what an event means depends on the ones before. Keys of ordinary size share packs
and are run from the start, many keys per call. The rows of heavy keys are cut into ranges of (key, time), whatever times
they lie at, so a burst of one key is many slices as well. What slices hand over is never gathered by key:

* A machine's slice is a function of its few states. Functions are composed ``FAN`` at a time, level by level, and the states in
  which slices are entered are handed down again the same way: a parallel prefix over (key, slice).
* A window's state is a time, so a slice would be a table as long as itself. Instead each event knows the first event at or
  after the end of the last window that it would open inside its slice. The events that are really met are those that the key's
  first event leads to: they are marked by pointer doubling, a join for each power of two.

Each slice is then run from its true entry state. No call holds more than one pack or one slice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensfold.operators.sliced import SLICE, last_known, micros, range_slice, running_sum
from lensfold.session import cut_lineage


HEAVY = 100_000  # rows of a key above which it is sliced
FAN = 64  # slices whose functions are composed in one row


def _split(rows: DataFrame, key: list[str], order: list[str], heavy: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys with pack numbers, and those of heavy keys in slices of about ``heavy`` rows (None when there are none)."""
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    size = counts.agg(F.sum("_n").alias("rows"), F.max("_n").alias("most"), F.sum(F.when(F.col("_n") > heavy, F.col("_n"))).alias("hot")).first()
    packs = max(1, math.ceil((size.rows or 0) / heavy))
    packed = rows.withColumn("_pack", F.pmod(F.xxhash64(*key), F.lit(packs)))
    if (size.most or 0) <= heavy:
        return packed, None
    hot = counts.where(F.col("_n") > heavy).select(*key)
    return packed.join(hot, key, "left_anti"), range_slice(rows.join(hot, key, "left_semi"), key, order, math.ceil(2 * size.hot / heavy))


def entries(tables: DataFrame, key: Sequence[str], states: int, start: int = 0, fan: int = FAN) -> DataFrame:
    """(key, slice, _entry): the state in which each slice is entered, from (key, slice, _exit) with the exit state of every entry state."""
    on = list(key)
    last = tables.agg(F.max(SLICE).alias("m")).first().m or 0
    block, inner = F.expr(f"_at div {fan}"), F.expr(f"_at % {fan}").cast("int")
    level, levels = tables.select(*on, F.col(SLICE).alias("_at"), "_exit"), []
    while True:
        grouped = cut_lineage(level.groupBy(*on, block.alias("_block")).agg(F.array_sort(F.collect_list(F.struct(inner.alias("i"), F.col("_exit").alias("f")))).alias("_fs")))
        levels.append(grouped)
        last //= fan
        if not last:
            break
        through = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: F.aggregate("_fs", s, lambda at, x: F.get(x["f"], at)))
        level = grouped.select(*on, F.col("_block").alias("_at"), through.alias("_exit"))
    entered = levels[-1].select(*on, "_block", F.lit(start).alias("_entry"))
    first = lambda: F.array(F.struct(F.lit(-1).alias("i"), F.lit(start).alias("s")))
    for grouped in reversed(levels):
        # A running list of (slice, its entry state); the state behind the last one closes it.
        step = lambda acc, x: F.struct(F.concat(acc["l"], F.array(F.struct(x["i"].alias("i"), acc["s"].alias("s")))).alias("l"), F.get(x["f"], acc["s"]).alias("s"))
        init = F.struct(F.filter(first(), lambda x: x["i"] >= 0).alias("l"), F.col("_entry").alias("s"))
        run = F.aggregate("_fs", init, step, lambda acc: acc["l"])
        entered = grouped.join(entered, [*on, "_block"]).select(*on, "_block", F.explode(run).alias("_r"))
        entered = entered.select(*on, (F.col("_block") * fan + F.col("_r.i")).alias("_block"), F.col("_r.s").alias("_entry"))
    return entered.withColumnRenamed("_block", SLICE)


def _groups(pdf: pd.DataFrame, key: list[str]) -> list[np.ndarray]:
    """Row numbers of each key of a pack, in row order."""
    return list(pdf.groupby(key, sort=False, dropna=False).indices.values())


def _anchor_exits(times: np.ndarray, ttl: int) -> np.ndarray:
    """For each event: when the last window is over if a window opens at this event. ``times`` ascends."""
    follow = np.searchsorted(times, times + ttl)
    exits = times + ttl
    for i in range(len(times) - 1, -1, -1):
        if follow[i] < len(times):
            exits[i] = exits[follow[i]]
    return exits


def _open_flags(times: np.ndarray, over: int, ttl: int) -> np.ndarray:
    opens = np.zeros(len(times), dtype=bool)
    i = int(np.searchsorted(times, over))
    while i < len(times):
        opens[i] = True
        i = int(np.searchsorted(times, times[i] + ttl))
    return opens


def _met(rows: DataFrame, on: list[str], width: int) -> DataFrame:
    """(key, slice, _first): the event of each slice of (key, slice, _us) that the window state coming from the left meets first."""
    fields = [rows.schema[k] for k in [*on, SLICE]]

    def leaving(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_us")
        return pdf.assign(_out=_anchor_exits(pdf["_us"].to_numpy(), width))

    left = cut_lineage(rows.groupBy(*on, SLICE).applyInPandas(leaving, T.StructType([*fields, T.StructField("_us", T.LongType()), T.StructField("_out", T.LongType())])))
    # The first event at or after each of these times: the last one known when time runs backwards.
    asked = left.select(*on, F.col("_out").alias("_at"), F.lit(1).alias("_asks")).distinct()
    both = rows.select(*on, F.col("_us").alias("_at"), F.lit(0).alias("_asks")).unionByName(asked)
    both = range_slice(both.withColumn("_back", -F.col("_at")), on, ["_back", "_asks"])
    found = last_known(both, on, ["_back", "_asks"], F.when(F.col("_asks") == 0, F.col("_at")), "_to")
    found = found.where("_asks = 1 and _to is not null").select(*on, F.col("_at").alias("_out"), "_to")
    edges = cut_lineage(left.join(found, [*on, "_out"]).select(*on, "_us", "_to"))
    heads = cut_lineage(rows.groupBy(*on).agg(F.min("_us").alias("_us")))
    met = edges.select(*on, F.col("_to").alias("_us")).unionByName(heads).distinct()
    jumps = [cut_lineage(edges.join(met, [*on, "_us"], "left_semi"))]
    while not jumps[-1].join(heads, [*on, "_us"], "left_semi").isEmpty():
        again = jumps[-1].select(*on, F.col("_us").alias("_to"), F.col("_to").alias("_next"))
        jumps.append(cut_lineage(jumps[-1].join(again, [*on, "_to"]).select(*on, "_us", F.col("_next").alias("_to"))))
    path = heads
    for jump in reversed(jumps):
        path = cut_lineage(path.unionByName(jump.join(path, [*on, "_us"], "left_semi").select(*on, F.col("_to").alias("_us"))).distinct())
    return rows.join(path, [*on, "_us"], "left_semi").select(*on, SLICE, F.col("_us").alias("_first"))


def anchors(log: DataFrame, key: Sequence[str], ts: str, ttl: float, heavy: int = HEAVY) -> DataFrame:
    """Distinct (key, instant) with ``opens``: whether this instant opens a window of ``ttl`` seconds.

    A window opens at the first event of a key and at the first event at or after the end of the last window.
    """
    width, on, never = int(ttl * 1_000_000), list(key), np.iinfo(np.int64).min
    rows = log.select(*on, micros(ts).alias("_us")).distinct()
    packed, hot = _split(rows, on, ["_us"], heavy)
    out = T.StructType([*[log.schema[k] for k in on], T.StructField("_us", T.LongType()), T.StructField("opens", T.BooleanType())])

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_us")
        times, opens = pdf["_us"].to_numpy(), np.zeros(len(pdf), dtype=bool)
        for at in _groups(pdf, on):
            opens[at] = _open_flags(times[at], never, width)
        return pdf[[*on, "_us"]].assign(opens=opens)

    def mark_slice(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_us")
        times, first = pdf["_us"].to_numpy(), pdf["_first"].iloc[0]
        opens = np.zeros(len(pdf), dtype=bool) if pd.isna(first) else _open_flags(times, int(first), width)
        return pdf[[*on, "_us"]].assign(opens=opens)

    marked = packed.groupBy("_pack").applyInPandas(mark, out)
    if hot is not None:
        entered = hot.join(_met(hot, on, width), [*on, SLICE], "left")
        marked = marked.unionByName(entered.groupBy(*on, SLICE).applyInPandas(mark_slice, out))
    return marked.withColumn(ts, F.timestamp_micros("_us"))


def debounce(log: DataFrame, key: Sequence[str], ts: str, ttl: float) -> DataFrame:
    """At most one action per key and ``ttl``: (key, ts, acts). Simultaneous events are one."""
    return anchors(log, key, ts, ttl).select(*key, ts, F.col("opens").alias("acts"))


def throttle(log: DataFrame, key: Sequence[str], ts: str, tie: str, ttl: float, most: int = 2, **kw) -> DataFrame:
    """Log with ``place`` inside its anchored window and ``allowed``: only the first ``most`` of a window pass."""
    on = list(key)
    flags = anchors(log, key, ts, ttl, **kw).select(*on, "_us", "opens")
    rows = range_slice(log.withColumn("_us", micros(ts)).join(flags, [*on, "_us"]), on, ["_us", tie])
    rows = cut_lineage(running_sum(rows, on, ["_us", tie], F.lit(1).cast("bigint"), "_ix"))
    heads = rows.where("opens").groupBy(*on, "_us").agg(F.min("_ix").alias("_head"))
    rows = rows.join(heads, [*on, "_us"], "left")
    rows = last_known(rows, on, ["_us", tie], F.when(F.col("_ix") == F.col("_head"), F.col("_ix")), "_start")
    place = F.col("_ix") - F.col("_start") + 1
    return rows.withColumn("place", place).withColumn("allowed", F.col("place") <= most).select(*log.columns, "place", "allowed")


def finite_machine(
    rows: DataFrame, key: Sequence[str], ts: str, tie: str, states: int,
    run: Callable[[np.ndarray, int], tuple[np.ndarray, int]], value: str, out: str, kind: T.DataType,
    slice_seconds: float | None = None, heavy: int = HEAVY,
) -> DataFrame:
    """Run a machine with ``states`` states over the values of each key in time order, starting in state 0.

    ``run(values, entry)`` gives the output per row and the exit state. ``slice_seconds`` has no effect any more: slices follow
    the number of rows.
    """
    on, order, columns = list(key), [ts, tie], rows.columns
    packed, hot = _split(rows, on, order, heavy)
    out_schema = T.StructType([*rows.schema.fields, T.StructField(out, kind)])

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(order)[value].to_numpy()
        return pdf[[*on, SLICE]].iloc[:1].assign(_exit=[[int(run(values, s)[1]) for s in range(states)]])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        values, result = pdf[value].to_numpy(), np.empty(len(pdf), dtype=object)
        for at in _groups(pdf, on):
            result[at] = run(values[at], 0)[0]
        return pdf[columns].assign(**{out: result})

    def final_slice(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf[columns].assign(**{out: run(pdf[value].to_numpy(), int(pdf["_entry"].iloc[0]))[0]})

    done = packed.groupBy("_pack").applyInPandas(final, out_schema)
    if hot is None:
        return done
    fields = [*[rows.schema[k] for k in on], T.StructField(SLICE, T.LongType()), T.StructField("_exit", T.ArrayType(T.IntegerType()))]
    exits = cut_lineage(hot.groupBy(*on, SLICE).applyInPandas(table, T.StructType(fields)))
    entered = hot.join(entries(exits, on, states), [*on, SLICE])
    return done.unionByName(entered.groupBy(*on, SLICE).applyInPandas(final_slice, out_schema))
