"""Exact similarity joins and top-k search on vector columns, in blocks.

Within a partition key both sides are hashed into blocks of about ``block`` rows. Each pair of blocks is one
group: two matrices and one matrix product. Memory follows the block and not the key, and a heavy key becomes
many groups. A group returns what its caller needs (pairs above a threshold, the best k per source, or edges
that span the same components), never every pair it looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lensfold.operators.listing import best_per_group, first_n

BLOCK = 2000
#: Blocks along each side of a group of ``spanning_edges``, worked out one pair after the other: rows are copied once for so many blocks.
SPAN = 8
SCORE_DIGITS = 12  # products of equal vectors may differ in the last bit between blocks; ties must stay ties
CHANNELS = ("centroid", "centroid_vs_pyr", "pyr_centroid")  # fixed values: channel names in order of preference


def _block_counts(df: DataFrame, part: Sequence[str], block: int, name: str) -> DataFrame:
    blocks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(block))).cast("int")
    return df.groupBy(*part).agg(blocks.alias(name))


def _sides(df: DataFrame, ident: str, vecs: Sequence[str], part: Sequence[str]) -> DataFrame:
    return df.select(*part, F.col(ident).alias("_id"), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(vecs)])


def _own_block(blocks: str):
    return F.pmod(F.xxhash64("_id"), F.col(blocks).cast("bigint")).cast("int")


def _cross_blocks(left: DataFrame, right: DataFrame, part: Sequence[str], block: int) -> DataFrame:
    counts = _block_counts(left, part, block, "_nl").join(_block_counts(right, part, block, "_nr"), list(part))
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = [c for c in left.columns if c not in part]
    lhs = left.join(counts, list(part)).select(
        *part, _own_block("_nl").alias("_i"), others("_nr").alias("_j"), F.lit(0).alias("_side"), *keep
    )
    rhs = right.join(counts, list(part)).select(
        *part, others("_nl").alias("_i"), _own_block("_nr").alias("_j"), F.lit(1).alias("_side"), *keep
    )
    return lhs.unionByName(rhs)


def _self_blocks(df: DataFrame, part: Sequence[str], block: int) -> DataFrame:
    """Block pairs i <= j of one table; a block meets itself once, with all rows on side 0."""
    keep = [c for c in df.columns if c not in part]
    spread = (
        df.join(_block_counts(df, part, block, "_n"), list(part))
        .withColumn("_b", _own_block("_n"))
        .withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    )
    return spread.select(
        *part,
        F.least("_b", "_x").alias("_i"),
        F.greatest("_b", "_x").alias("_j"),
        (F.col("_b") > F.col("_x")).cast("int").alias("_side"),
        *keep,
    )


def _matrix(column: pa.ChunkedArray, normalise: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows as a double matrix, and which rows were present; missing rows are zero. Fails on vectors of mixed lengths."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    present = np.asarray(pc.is_valid(lists))
    lengths = pc.unique(pc.drop_null(pc.list_value_length(lists))).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)}")
    dim = lengths[0] if lengths else 0
    out = np.zeros((len(lists), max(dim, 1)))
    if dim:
        out[present] = np.asarray(lists.flatten(), dtype=np.float64).reshape(-1, dim)
    if normalise:
        length = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.divide(out, length, out=np.zeros_like(out), where=length > 0)
    return out, present


class _Side:
    """One block: ids in ascending order and a matrix per vector column."""

    def __init__(self, table: pa.Table, vecs: int, normalise: bool):
        table = table.take(pc.sort_indices(table.column("_id")))
        self.ids = table.column("_id").combine_chunks()
        self.mats = [_matrix(table.column(f"_v{i}"), normalise) for i in range(vecs)]

    def tiles(self, rows: int | None) -> list[_Side]:
        """Pieces of at most ``rows`` rows; None leaves it whole."""
        return [self] if rows is None or len(self.ids) <= rows else [self._slice(at, rows) for at in range(0, len(self.ids), rows)]

    def _slice(self, at: int, rows: int) -> _Side:
        piece = object.__new__(_Side)
        piece.ids = self.ids.slice(at, rows)
        piece.mats = [(m[at : at + rows], there[at : at + rows]) for m, there in self.mats]
        return piece


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] != b.shape[1]:
        raise ValueError(f"vectors of different lengths: {a.shape[1]} and {b.shape[1]}")
    return np.round(a @ b.T, SCORE_DIGITS)


def _scores(left: _Side, right: _Side) -> tuple[np.ndarray, np.ndarray | None]:
    """Similarity of every pair of the block pair; with two vector columns also the number of the winning channel.

    Channels are layers of one stack, minus infinity where a vector is missing; the first of the greatest wins.
    """
    (main_l, _), (main_r, _) = left.mats[0], right.mats[0]
    main = _product(main_l, main_r)
    if len(left.mats) == 1:
        return main, None
    (alt_l, there_l), (alt_r, there_r) = left.mats[1], right.mats[1]
    stack = np.full((len(CHANNELS), *main.shape), -np.inf)
    stack[0] = main
    if there_r.any():
        stack[1][:, there_r] = _product(main_l, alt_r[there_r])
        if there_l.any():
            stack[2][np.ix_(there_l, there_r)] = _product(alt_l[there_l], alt_r[there_r])
    channel = stack.argmax(axis=0)
    return np.take_along_axis(stack, channel[None], axis=0)[0], channel


def _channel_names(numbers: np.ndarray) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(numbers.astype(np.int8)), pa.array(CHANNELS)).cast(pa.string())


Emit = Callable[[_Side, _Side, bool], dict[str, pa.Array]]


def _run(
    rows: DataFrame, part: Sequence[str], vecs: int, emit: Emit, out: T.StructType, one_table: bool = False, normalise: bool = True, tile: int | None = None
) -> DataFrame:
    """``emit`` for each pair of blocks, or of their pieces of ``tile`` rows. Block pairs are dealt by themselves: rows that already lie by
    key, as after a join on it, would satisfy the grouping and leave all pairs of a key in one task."""
    names = [f.name for f in out.fields]
    n_part = len(part)
    nothing = to_arrow_schema(out).empty_table()

    def block_pair(key, table):
        side = np.asarray(table.column("_side"))
        left = _Side(table.filter(pa.array(side == 0)), vecs, normalise)
        within = one_table and key[n_part].as_py() == key[n_part + 1].as_py()
        right = left if within else _Side(table.filter(pa.array(side == 1)), vecs, normalise)
        if not len(left.ids) or not len(right.ids):
            return nothing
        found, ones = [], left.tiles(tile)
        others = ones if within else right.tiles(tile)
        for i, one in enumerate(ones):
            for j, two in enumerate(others):
                if within and j < i:
                    continue
                cols = emit(one, two, within and i == j)
                size = len(next(iter(cols.values())))
                for name, value in zip(part, key[:n_part], strict=True):
                    cols[name] = pa.repeat(value, size)
                found.append(pa.table({n: cols[n] for n in names}))
        return pa.concat_tables(found)

    dealt = [*part, "_i", "_j"]
    return rows.repartition(*dealt).groupBy(*dealt).applyInArrow(block_pair, out)


def _schema(df: DataFrame, part: Sequence[str], ident: str, *extra: tuple[str, T.DataType]) -> T.StructType:
    kind = df.schema[ident].dataType
    fields = [T.StructField(p, df.schema[p].dataType) for p in part]
    fields += [T.StructField("src", kind), T.StructField("dst", kind)]
    return T.StructType(fields + [T.StructField(n, t) for n, t in extra])


def similarity_join(
    left: DataFrame, right: DataFrame, ident: str, vec: str, part: Sequence[str], threshold: float, block: int = BLOCK
) -> DataFrame:
    """All pairs (src, dst, score) with cosine >= threshold; zero vectors score 0."""

    def emit(a: _Side, b: _Side, within: bool):
        score, _ = _scores(a, b)
        i, j = np.nonzero(score >= threshold)
        return {"src": a.ids.take(pa.array(i)), "dst": b.ids.take(pa.array(j)), "score": pa.array(score[i, j])}

    rows = _cross_blocks(_sides(left, ident, [vec], part), _sides(right, ident, [vec], part), part, block)
    return _run(rows, part, 1, emit, _schema(left, part, ident, ("score", T.DoubleType())))


def self_pairs(df: DataFrame, ident: str, vec: str, part: Sequence[str], threshold: float, block: int = BLOCK) -> DataFrame:
    """Pairs of one table, each once."""

    def emit(a: _Side, b: _Side, within: bool):
        score, _ = _scores(a, b)
        hit = score >= threshold
        i, j = np.nonzero(np.triu(hit, 1) if within else hit)
        return {"src": a.ids.take(pa.array(i)), "dst": b.ids.take(pa.array(j)), "score": pa.array(score[i, j])}

    rows = _self_blocks(_sides(df, ident, [vec], part), part, block)
    out = _run(rows, part, 1, emit, _schema(df, part, ident, ("score", T.DoubleType())), one_table=True)
    return out.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def _best_rows(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best entries per row; equal scores keep column order (ascending id)."""
    if k == 1:
        cols = score.argmax(axis=1)[:, None]
    else:
        cols = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(score.shape[0]), cols.shape[1]), cols.ravel()


def topk_search(
    queries: DataFrame, targets: DataFrame, ident: str, vec: str | Sequence[str], part: Sequence[str], k: int,
    threshold: float, block: int = BLOCK,
) -> DataFrame:
    """Best k targets per query with score >= threshold, ranked; ties go to the smallest target id.

    With two vector columns (main, alternative) the score is the best of the allowed channels and ``channel``
    names it. Each block pair keeps k per query, so the second step sees k rows per query and target block.
    """
    vecs = [vec] if isinstance(vec, str) else list(vec)

    def emit(a: _Side, b: _Side, within: bool):
        score, code = _scores(a, b)
        i, j = _best_rows(score, k)
        good = score[i, j] >= threshold
        i, j = i[good], j[good]
        cols = {"src": a.ids.take(pa.array(i)), "dst": b.ids.take(pa.array(j)), "score": pa.array(score[i, j])}
        if code is not None:
            cols["channel"] = _channel_names(code[i, j])
        return cols

    extra = [("score", T.DoubleType())] + ([("channel", T.StringType())] if len(vecs) > 1 else [])
    rows = _cross_blocks(_sides(queries, ident, vecs, part), _sides(targets, ident, vecs, part), part, block)
    found = _run(rows, part, len(vecs), emit, _schema(queries, part, ident, *extra))
    if k == 1:
        rest = [c for c in found.columns if c not in (*part, "src")]
        return best_per_group(found, [*part, "src"], [-F.col("score"), F.col("dst")], rest).withColumn("rank", F.lit(1))
    return first_n(found, [*part, "src"], [F.col("score").desc(), F.col("dst")], k)


def max_channel_similarity(
    left: DataFrame, right: DataFrame, ident: str, main: str, alt: str, part: Sequence[str], threshold: float,
    block: int = BLOCK,
) -> DataFrame:
    """Best of three channels per pair: main-main, main-alt, alt-alt; a later one wins only when greater."""

    def emit(a: _Side, b: _Side, within: bool):
        score, code = _scores(a, b)
        i, j = np.nonzero(score >= threshold)
        return {"src": a.ids.take(pa.array(i)), "dst": b.ids.take(pa.array(j)), "score": pa.array(score[i, j]), "channel": _channel_names(code[i, j])}

    vecs = [main, alt]
    rows = _cross_blocks(_sides(left, ident, vecs, part), _sides(right, ident, vecs, part), part, block)
    return _run(rows, part, 2, emit, _schema(left, part, ident, ("score", T.DoubleType()), ("channel", T.StringType())))


def nearest_other(df: DataFrame, ident: str, vec: str, part: Sequence[str], above: float, block: int = BLOCK) -> DataFrame:
    """For each row the other row with the greatest inner product, where that is strictly ``> above``.

    Vectors are taken as they are (means of groups are shorter than 1). Ties go to the smallest id.
    """

    def emit(a: _Side, b: _Side, within: bool):
        score, _ = _scores(a, b)
        if within:
            np.fill_diagonal(score, -np.inf)
        pieces = []
        for one, two, s in ((a, b, score),) if within else ((a, b, score), (b, a, score.T)):
            i, j = _best_rows(s, 1)
            good = s[i, j] > above
            i, j = i[good], j[good]
            pieces.append((one.ids.take(pa.array(i)), two.ids.take(pa.array(j)), s[i, j]))
        src, dst, val = zip(*pieces, strict=True)
        return {"src": pa.concat_arrays(src), "dst": pa.concat_arrays(dst), "score": pa.array(np.concatenate(val))}

    rows = _self_blocks(_sides(df, ident, [vec], part), part, block)
    found = _run(rows, part, 1, emit, _schema(df, part, ident, ("score", T.DoubleType())), one_table=True, normalise=False)
    return best_per_group(found, [*part, "src"], [-F.col("score"), F.col("dst")], ["dst", "score"])


def _local_components(hit: np.ndarray) -> np.ndarray:
    """Smallest reachable row number per row of a symmetric boolean matrix."""
    n = hit.shape[0]
    label = np.arange(n)
    while True:
        near = np.where(hit, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, near)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def spanning_edges(df: DataFrame, ident: str, vec: str, part: Sequence[str], min_cosine: float, block: int = BLOCK) -> DataFrame:
    """Edges that connect exactly what the graph ``cosine >= min_cosine`` connects.

    A block pair reduces its graph to one edge from each row to the smallest row of its local component: at most
    one edge per row and block pair, where a dense group would have a quadratic number of pairs.
    """

    def emit(a: _Side, b: _Side, within: bool):
        score, _ = _scores(a, b)
        hit = score >= min_cosine
        if within:
            ids, label = a.ids, _local_components(hit)
        else:
            # rows of b hang on rows of a: join the two sides through the bipartite matrix
            ids = pa.concat_arrays([a.ids, b.ids])
            label = _bipartite_components(hit)
        node = np.nonzero(label != np.arange(len(label)))[0]
        return {"src": ids.take(pa.array(label[node])), "dst": ids.take(pa.array(node))}

    rows = _self_blocks(_sides(df, ident, [vec], part), part, SPAN * block)
    return _run(rows, part, 1, emit, _schema(df, part, ident), one_table=True, tile=block)


def _bipartite_components(hit: np.ndarray) -> np.ndarray:
    n, m = hit.shape
    left, right = np.arange(n), n + np.arange(m)
    while True:
        new_right = np.minimum(right, np.where(hit, left[:, None], n + m).min(axis=0, initial=n + m))
        new_left = np.minimum(left, np.where(hit, new_right[None, :], n + m).min(axis=1, initial=n + m))
        joined = np.concatenate([new_left, new_right])
        joined = joined[joined]
        new_left, new_right = joined[:n], joined[n:]
        if np.array_equal(new_left, left) and np.array_equal(new_right, right):
            return joined
        left, right = new_left, new_right


def neighbour_counts(df: DataFrame, ident: str, vec: str, part: Sequence[str], min_cosine: float, block: int = BLOCK) -> DataFrame:
    """(src, neighbours) with the row itself counted; one partial count per row and block pair."""

    def emit(a: _Side, b: _Side, within: bool):
        hit = _scores(a, b)[0] >= min_cosine
        if within:
            np.fill_diagonal(hit, True)
            return {"src": a.ids, "n": pa.array(hit.sum(axis=1).astype(np.int64))}
        return {
            "src": pa.concat_arrays([a.ids, b.ids]),
            "n": pa.array(np.concatenate([hit.sum(axis=1), hit.sum(axis=0)]).astype(np.int64)),
        }

    out = T.StructType(
        [T.StructField(p, df.schema[p].dataType) for p in part]
        + [T.StructField("src", df.schema[ident].dataType), T.StructField("n", T.LongType())]
    )
    partial = _run(_self_blocks(_sides(df, ident, [vec], part), part, block), part, 1, emit, out, one_table=True)
    return partial.groupBy(*part, "src").agg(F.sum("n").alias("neighbours"))


def smallest_label_in_reach(
    left: DataFrame, right: DataFrame, ident: str, vec: str, label: str, part: Sequence[str], min_cosine: float,
    block: int = BLOCK,
) -> DataFrame:
    """(src, label): the smallest ``label`` among the right rows within reach of each left row."""
    lhs = _sides(left, ident, [vec], part).withColumn("_label", F.col("_id"))
    rhs = right.select(*part, F.col(ident).alias("_id"), F.col(vec).alias("_v0"), F.col(label).alias("_label"))
    spread = _cross_blocks(lhs, rhs.select(*lhs.columns), part, block)
    # right rows enter under their label; a side is sorted by id, so the first hit is the smallest label
    rows = spread.withColumn("_id", F.when(F.col("_side") == 1, F.col("_label")).otherwise(F.col("_id"))).drop("_label")

    def emit(a: _Side, b: _Side, within: bool):
        hit = _scores(a, b)[0] >= min_cosine
        i = np.nonzero(hit.any(axis=1))[0]
        return {"src": a.ids.take(pa.array(i)), "dst": b.ids.take(pa.array(hit[i].argmax(axis=1)))}

    found = _run(rows, part, 1, emit, _schema(left, part, ident))
    return found.groupBy(*part, "src").agg(F.min("dst").alias("label"))
