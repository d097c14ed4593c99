"""Box geometry, primary detection, top boxes and overlap suppression."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensfold.operators.listing import best_per_group, first_n
from lensfold.session import cut_lineage


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip_box(x1, y1, x2, y2, width, height) -> Column:
    """Corner box clipped to the image, as struct(x, y, w, h) in image fractions."""
    into = lambda v, hi: F.greatest(F.lit(0.0), F.least(_c(hi).cast("double"), _c(v).cast("double")))
    left, top, right, bottom = into(x1, width), into(y1, height), into(x2, width), into(y2, height)
    return F.struct(
        (left / _c(width)).alias("x"), (top / _c(height)).alias("y"),
        (F.greatest(right - left, F.lit(0.0)) / _c(width)).alias("w"), (F.greatest(bottom - top, F.lit(0.0)) / _c(height)).alias("h"),
    )


def padded_pixels(x, y, w, h, width, height, padding: float) -> Column:
    """Fraction box with a margin as a pixel box of at least one pixel, rounded half to even."""
    whole = lambda v: F.rint(v).cast("bigint")
    pw, ph = _c(w) * padding, _c(h) * padding
    floor0 = lambda v, hi: F.greatest(F.lit(0).cast("bigint"), F.least(v, hi))
    wide, high = _c(width).cast("bigint"), _c(height).cast("bigint")
    x1 = floor0(whole((_c(x) - pw) * wide), wide - 1)
    y1 = floor0(whole((_c(y) - ph) * high), high - 1)
    x2 = F.greatest(x1 + 1, F.least(whole((_c(x) + _c(w) + pw) * wide), wide))
    y2 = F.greatest(y1 + 1, F.least(whole((_c(y) + _c(h) + ph) * high), high))
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def area_ratio(w, h) -> Column:
    return F.greatest(F.lit(0.0), _c(w) * _c(h))


def centre_distance(x, y, width, height) -> Column:
    dx, dy = _c(x) - _c(width) / 2, _c(y) - _c(height) / 2
    return F.sqrt(dx * dx + dy * dy)


def iou(a: Sequence[str | Column], b: Sequence[str | Column], pixel: float = 1.0, over: str = "union") -> Column:
    """Overlap of two corner boxes. ``pixel`` 1 counts edge pixels, 0 is plain geometry; ``over`` union or first."""
    ax1, ay1, ax2, ay2 = map(_c, a)
    bx1, by1, bx2, by2 = map(_c, b)
    side = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo + pixel)
    both = side(F.greatest(ax1, bx1), F.least(ax2, bx2)) * side(F.greatest(ay1, by1), F.least(ay2, by2))
    one = (ax2 - ax1 + pixel) * (ay2 - ay1 + pixel)
    two = (bx2 - bx1 + pixel) * (by2 - by1 + pixel)
    return both / (one + two - both if over == "union" else one)


def overlapping(
    boxes: DataFrame, image: Sequence[str], order: str, corners: Sequence[str], least: float, cell: float, pixel: float = 1.0
) -> DataFrame:
    """Pairs of boxes of one image with IoU > ``least``, each once, as (image, first, second, iou).

    Boxes are laid on a grid of ``cell`` pixels and meet only inside a cell, so an image with very many boxes does not
    compare all pairs. A box covers its edge pixel, as in its area. A pair is reported by the cell that holds the
    upper left corner of what both cover.
    """
    grid = lambda v: F.floor(v / F.lit(float(cell)))
    x1, y1, x2, y2 = map(F.col, corners)
    cells = boxes.select(*image, order, *corners).withColumn("_cx", F.explode(F.sequence(grid(x1), grid(x2 + pixel)))).withColumn(
        "_cy", F.explode(F.sequence(grid(y1), grid(y2 + pixel)))
    )
    left = cells.select(*image, "_cx", "_cy", F.col(order).alias("first"), *[F.col(c).alias(f"_a{i}") for i, c in enumerate(corners)])
    right = cells.select(*image, "_cx", "_cy", F.col(order).alias("second"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(corners)])
    a, b = [f"_a{i}" for i in range(4)], [f"_b{i}" for i in range(4)]
    home = (F.col("_cx") == grid(F.greatest("_a0", "_b0"))) & (F.col("_cy") == grid(F.greatest("_a1", "_b1")))
    return (
        left.join(right, [*image, "_cx", "_cy"]).where((F.col("first") < F.col("second")) & home)
        .select(*image, "first", "second", iou(a, b, pixel).alias("iou")).where(F.col("iou") > least)
    )


def primary_detection(boxes: DataFrame, image: Sequence[str], distance: Column, order: str) -> DataFrame:
    """The detection closest to the image centre per image; the first one wins ties."""
    rest = [c for c in boxes.columns if c not in image]
    return best_per_group(boxes, image, [distance, F.col(order)], rest)


def top_boxes(boxes: DataFrame, image: Sequence[str], corners: Sequence[str], order: str, n: int, width, height, centred: bool = True) -> DataFrame:
    """Largest boxes per image, by area or by area minus twice the squared offset from the centre."""
    x1, y1, x2, y2 = map(F.col, corners)
    area = (x2 - x1) * (y2 - y1)
    dx = (x1 + x2) / 2 - F.floor(_c(width) / 2)
    dy = (y1 + y2) / 2 - F.floor(_c(height) / 2)
    value = area - 2.0 * (dx * dx + dy * dy) if centred else area
    return first_n(boxes.withColumn("value", value), image, [F.col("value").desc(), F.col(order)], n)


def nms(
    boxes: DataFrame, image: Sequence[str], corners: Sequence[str], score: str, order: str, limit: float,
    group_limit: int = 5000, cell: float = 256.0,
) -> DataFrame:
    """Greedy suppression per image: best score first, boxes overlapping a kept one by more than ``limit`` go.

    Ordinary images share packs of bounded size and take one pass. An image with more than ``group_limit`` boxes is solved
    by rounds of joins instead, with the same result, so no group grows without bound.
    """
    on = list(image)
    heavy, large, packs = _packs(boxes, on, group_limit)
    if not large:
        return _nms_packs(boxes, on, corners, score, order, limit, packs)
    small = _nms_packs(boxes.join(heavy, on, "left_anti"), on, corners, score, order, limit, packs)
    return small.unionByName(_nms_rounds(boxes.join(heavy, on, "left_semi"), on, corners, score, order, limit, cell))


def _packs(boxes: DataFrame, image: list[str], group_limit: int) -> tuple[DataFrame, bool, int]:
    """Images with more than ``group_limit`` boxes, whether there are any, and the number of packs for the others."""
    counts = boxes.groupBy(*image).agg(F.count(F.lit(1)).alias("_n"))
    light = F.col("_n") <= group_limit
    seen = counts.agg(F.sum(F.when(light, F.col("_n"))).alias("boxes"), F.count_if(~light).alias("heavy")).first()
    return counts.where(~light).select(*image), seen.heavy > 0, max(1, math.ceil((seen.boxes or 0) / (4 * group_limit)))


def _packed(boxes: DataFrame, image: list[str], packs: int) -> DataFrame:
    return boxes.withColumn("_pack", F.pmod(F.xxhash64(*image), F.lit(packs)))


def _suppressed(box: np.ndarray, limit: float, pixel: float = 1.0, step: int = 512) -> np.ndarray:
    """Which of the boxes (rows x1, y1, x2, y2; best first) a kept better one covers by more than ``limit``. Overlaps
    of ``step`` boxes with all later ones are computed together."""
    low, high = box[:, :2], box[:, 2:] + pixel
    area = np.prod(high - low, axis=1)
    gone = np.zeros(len(box), bool)
    for at in range(0, len(box), step):
        some = slice(at, at + step)
        side = np.minimum(high[some, None], high[None, at:]) - np.maximum(low[some, None], low[None, at:])
        both = np.clip(side, 0, None).prod(axis=2)
        covers = both / (area[some, None] + area[None, at:] - both) > limit
        for i, row in enumerate(np.triu(covers, 1)):
            if not gone[at + i]:
                gone[at:] |= row
    return gone


def _suppressed_each(box: np.ndarray, starts: np.ndarray, sizes: np.ndarray, limit: float, pixel: float = 1.0, few: int = 64, step: int = 1 << 20) -> np.ndarray:
    """``_suppressed`` of many images that lie behind one another. Images with the same few boxes are worked out together, up to
    ``step`` overlaps at a time: a call for each costs more than its work."""
    gone = np.zeros(len(box), bool)
    for n in np.unique(sizes):
        own = starts[sizes == n]
        if n > few:
            for at in own:
                gone[at : at + n] = _suppressed(box[at : at + n], limit, pixel)
            continue
        many = max(1, step // (n * n))
        for at in range(0, len(own), many):
            rows = own[at : at + many, None] + np.arange(n)
            low, high = box[rows][..., :2], box[rows][..., 2:] + pixel
            area = np.prod(high - low, axis=2)
            side = np.minimum(high[:, :, None], high[:, None]) - np.maximum(low[:, :, None], low[:, None])
            both = np.clip(side, 0, None).prod(axis=3)
            covers = np.triu(both / (area[:, :, None] + area[:, None] - both) > limit, 1)
            out = np.zeros(rows.shape, bool)
            for i in range(n - 1):
                out |= covers[:, i] & ~out[:, i, None]
            gone[rows] = out
    return gone


def _kept(table: pa.Table, image: list[str], corners: Sequence[str], score: str, order: str, limit: float) -> pa.Table:
    """Boxes that stay, of all images of a table."""
    sequence = pa.array(np.arange(table.num_rows))
    ranked = table.append_column("_at", sequence).sort_by([*[(c, "ascending") for c in image], (score, "descending"), (order, "ascending")])
    groups = ranked.select(image).append_column("_at", sequence).group_by(image).aggregate([("_at", "min"), ("_at", "count")])
    box = np.stack([np.asarray(ranked.column(c), dtype=np.float64) for c in corners], axis=1)
    gone = _suppressed_each(box, np.asarray(groups.column("_at_min")), np.asarray(groups.column("_at_count")), limit)
    return ranked.filter(pa.array(~gone)).drop_columns(["_at"])


def _nms_packs(boxes: DataFrame, image: list[str], corners: Sequence[str], score: str, order: str, limit: float, packs: int) -> DataFrame:
    """Images hashed into packs of bounded size: one call per pack, since a call per image costs more than its work."""
    suppress = lambda table: _kept(table.drop_columns(["_pack"]), image, corners, score, order, limit)
    return _packed(boxes, image, packs).groupBy("_pack").applyInArrow(suppress, boxes.schema)


class _Suppress:
    """Rows of one image, best first, go out unless a box that went out before covers them by more than ``limit``."""

    corners: Sequence[str] = ()
    limit = 1.0

    def __init__(self):
        self.kept, self.n = np.empty((64, 4)), 0

    def eval(self, row):
        box = np.array([row[c] for c in self.corners], dtype=np.float64)
        kept = self.kept[: self.n]
        side = np.minimum(kept[:, 2:], box[2:]) + 1.0 - np.maximum(kept[:, :2], box[:2])
        both = np.clip(side, 0, None).prod(axis=1)
        area = np.prod(kept[:, 2:] + 1.0 - kept[:, :2], axis=1) + np.prod(box[2:] + 1.0 - box[:2]) - both
        if (both / area > self.limit).any():
            return
        if self.n == len(self.kept):
            self.kept = np.concatenate([self.kept, np.empty_like(self.kept)])
        self.kept[self.n] = box
        self.n += 1
        yield tuple(row)


def register_suppression(spark: SparkSession, name: str, boxes: DataFrame, corners: Sequence[str], limit: float) -> None:
    """Make suppression a table function of SQL for tables like ``boxes``::

        SELECT * FROM name(TABLE(boxes) PARTITION BY image ORDER BY score DESC, ord)

    Rows of an image are read one after the other; only those that stay are held."""
    own = type("Suppress", (_Suppress,), {"corners": tuple(corners), "limit": float(limit)})
    spark.udtf.register(name, F.udtf(own, returnType=boxes.schema))


class _SuppressPack:
    """Boxes of a pack of images, in Arrow batches; those that stay go out together."""

    columns: Sequence[str] = ()
    rule: tuple = ()

    def __init__(self):
        self.batches = []

    def eval(self, rows: pa.RecordBatch):
        self.batches.append(rows.select(self.columns))
        return iter(())

    def terminate(self):
        if self.batches:
            yield _kept(pa.Table.from_batches(self.batches), *self.rule)


def suppressed_by_sql(
    boxes: DataFrame, image: Sequence[str], corners: Sequence[str], score: str, order: str, limit: float, group_limit: int = 5000, cell: float = 256.0
) -> DataFrame:
    """``nms`` through a table function of SQL that takes packs of images, since a call for each image and row costs more than its
    work. Images with more than ``group_limit`` boxes go to rounds of joins, so that no call reads more than a pack."""
    on, spark = list(image), boxes.sparkSession
    heavy, large, packs = _packs(boxes, on, group_limit)
    own = type("SuppressPack", (_SuppressPack,), {"columns": list(boxes.columns), "rule": (on, list(corners), score, order, float(limit))})
    spark.udtf.register("suppressed_boxes", F.arrow_udtf(own, returnType=boxes.schema))
    light = boxes.join(heavy, on, "left_anti") if large else boxes
    out = spark.sql("SELECT * FROM suppressed_boxes(TABLE({boxes}) PARTITION BY `_pack`)", boxes=_packed(light, on, packs))
    return out.unionByName(_nms_rounds(boxes.join(heavy, on, "left_semi"), on, corners, score, order, limit, cell)) if large else out


def _nms_rounds(boxes: DataFrame, image: list[str], corners: Sequence[str], score: str, order: str, limit: float, cell: float) -> DataFrame:
    """A box is kept once no better open box overlaps it; boxes overlapping a kept one are closed. Below a limit of 1, copies
    of a box are covered by their best copy, so only that one enters the overlap join; from 1 on nothing covers anything."""
    if limit >= 1.0:
        return boxes
    rest = [c for c in boxes.columns if c not in (*image, *corners)]
    unique = cut_lineage(best_per_group(boxes, [*image, *corners], [-F.col(score), F.col(order)], rest).select(*boxes.columns))
    rank = unique.select(*image, order, score)
    pair = overlapping(unique, image, order, corners, limit, cell).select(*image, "first", "second")
    a = rank.select(*image, F.col(order).alias("first"), F.col(score).alias("_s1"))
    b = rank.select(*image, F.col(order).alias("second"), F.col(score).alias("_s2"))
    ranked = pair.join(a, [*image, "first"]).join(b, [*image, "second"])
    leads = (F.col("_s1") > F.col("_s2")) | ((F.col("_s1") == F.col("_s2")) & (F.col("first") < F.col("second")))
    edges = cut_lineage(ranked.select(
        *image, F.when(leads, F.col("first")).otherwise(F.col("second")).alias("_win"),
        F.when(leads, F.col("second")).otherwise(F.col("first")).alias("_lose"),
    ))
    removed = None
    while not edges.isEmpty():
        losers = edges.select(*image, F.col("_lose").alias("_win")).distinct()
        safe = edges.select(*image, "_win").distinct().join(losers, [*image, "_win"], "left_anti")
        out = cut_lineage(edges.join(safe, [*image, "_win"], "left_semi").select(*image, F.col("_lose").alias("_x")).distinct())
        removed = out if removed is None else removed.unionByName(out)
        for side in ("_win", "_lose"):
            edges = edges.join(out.withColumnRenamed("_x", side), [*image, side], "left_anti")
        edges = cut_lineage(edges)
    return unique if removed is None else unique.join(removed.withColumnRenamed("_x", order), [*image, order], "left_anti")
