"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions of documents.

Targets share a total by weight. A source can't exceed ``max_epochs`` times its size; what it can't take is shared
among the others by weight, until none is above. A source whose target is e epochs gives each document floor(e) times,
and once more to a seeded sample that makes up the rest: the documents in the order of a seeded hash, as long as
their words fit (the nearest document ends it). Only one number per source decides, so documents aren't moved.

Null texts have size 0. A null source is a source. Rows that are equal in id and text are taken together. An empty
table gives no rows; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lensfold.llm.common import WORD, own_name, text_or_empty, written

#: Bits of the hash that cut a source into slices for its running sum.
SLICE_BITS = 12


def words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def seeded(seed: int, key: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.lit(seed), F.col(key), F.col(text))


def targets(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to (source, source_size, weight). Each round needs three sums of the table, nothing else is collected."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, level = share * total, 0.0
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        kept, weight = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight").cast("double")))).first()
        found = (budget - (kept or 0.0)) / weight if weight else level
        if found <= level:
            break
        level = found
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def plan(sized: DataFrame, weights: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target, whole, cutoff) from rows (source, size, h) and (source, weight): a document is taken
    ``whole`` times, and once more where its hash is at most ``cutoff``."""
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    slices = written(
        sized.groupBy("source", F.shiftright("h", 64 - SLICE_BITS).alias("slice")).agg(F.sum("size").alias("size")), "mix-slices"
    )
    totals = slices.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(totals.join(weights, same(totals, weights)).select(totals["source"], "source_size", "weight"), "mix-sources")
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = targets(sources, share, max_epochs).withColumn("whole", F.floor(epochs))
    aimed = written(aimed.withColumn("quota", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))), "mix-targets")

    upto = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    placed = slices.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    cut = placed.join(aimed, same(placed, aimed)).where("before <= quota and quota < before + size").select(
        aimed["source"], "slice", "before", "quota"
    )
    here = sized.withColumn("slice", F.shiftright("h", 64 - SLICE_BITS))
    rows = here.join(cut, same(here, cut) & (here["slice"] == cut["slice"])).groupBy(
        here["source"], here["h"], here["slice"], "before", "quota"
    ).agg(F.sum("size").alias("size"))
    within = W.partitionBy("source").orderBy("h").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within))
    middle = F.col("before") + F.col("upto") - F.col("size") / 2
    below = F.when(F.col("slice") > -(1 << (SLICE_BITS - 1)), F.shiftleft(F.col("slice") - 1, 64 - SLICE_BITS) + ((1 << (64 - SLICE_BITS)) - 1))
    last = rows.withColumn("below", below).groupBy("source").agg(
        F.coalesce(F.max(F.when(middle <= F.col("quota"), F.col("h"))), F.min("below")).alias("cutoff")
    )
    return written(aimed.join(last, same(aimed, last), "left").select(aimed["source"], "source_size", "target", "whole", "cutoff"), "mix-plan")


def repeats(whole: str = "whole", h: str = "h", cutoff: str = "cutoff") -> Column:
    return F.col(whole) + F.when(F.col(h) <= F.col(cutoff), 1).otherwise(0)


def cycled_weights(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """Weights that repeat over the sources in code point order, null last. One row per source goes through one task."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")).alias("weight"))


def sized(docs: DataFrame, seed: int, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, h) of every row, written: later steps don't read texts again."""
    return written(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"), seeded(seed, key, text).alias("h")), "mix-sized")


def mixed(docs: DataFrame, cycle: tuple[float, ...], share: float, max_epochs: float, seed: int) -> DataFrame:
    """The rows of ``docs`` (with doc_id, text, source) as often as the mix takes them, columns unchanged."""
    rows = sized(docs, seed)
    steps = plan(rows, cycled_weights(rows.select("source").distinct(), cycle), share, max_epochs)
    own = [own_name(docs, c) for c in ("mix_source", "mix_whole", "mix_cutoff", "mix_hash")]
    steps = steps.select(*[F.col(a).alias(b) for a, b in zip(("source", "whole", "cutoff"), own)])
    taken = docs.withColumn(own[3], seeded(seed)).join(steps, docs["source"].eqNullSafe(steps[own[0]]))
    taken = taken.withColumn(own[3], F.explode(F.array_repeat(F.lit(0), repeats(own[1], own[3], own[2]).cast("int"))))
    return taken.select(*docs.columns)
