"""Aggregates over logs and catalogs. Every one pre-aggregates before it joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def zero(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0).cast("bigint"))


def share(num: Column, den: Column, digits: int = 2) -> Column:
    """Ratio rounded half to even, 0.0 when there is nothing to divide by."""
    return F.coalesce(F.when(den > 0, F.bround(num / den, digits)), F.lit(0.0))


def per_key(left: DataFrame, counted: DataFrame, key: Sequence[str], **aggregates: Column) -> DataFrame:
    """Left rows with aggregates of their matches, 0 where there are none."""
    agg = counted.groupBy(*key).agg(*[a.alias(n) for n, a in aggregates.items()])
    out = left.join(agg, list(key), "left")
    return out.withColumns({n: zero(n) for n in aggregates})


def event_summary(log: DataFrame, sessions: DataFrame, part: str, action: str = "action", verified: str = "verified") -> DataFrame:
    """Verified guests, views, downloads, and views per guest, per partition seen in either table."""
    guests = sessions.groupBy(part).agg(F.count_if(verified).alias("guests"))
    actions = log.groupBy(part).agg(
        F.count_if(F.col(action) == "view").alias("views"),
        F.count_if(F.col(action) == "download").alias("downloads"),
    )
    out = guests.join(actions, part, "full").withColumns({c: zero(c) for c in ("guests", "views", "downloads")})
    return out.withColumn("engagement", share(F.col("views"), F.col("guests")))


def status_counts(items: DataFrame, part: str, status: str = "processing_status", done: str = "faces_processed") -> DataFrame:
    return items.groupBy(part).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(status).isin("completed", "failed")).alias("terminal"),
        F.count_if(~F.col(done)).alias("pending"),
    )


def derive_status(counts: DataFrame, previous: DataFrame, part: str, status: str = "status") -> DataFrame:
    """New status per parent from its item counts; ``became_ready`` marks the change worth a notice."""
    joined = previous.join(counts, part, "left").withColumns({c: zero(c) for c in ("total", "terminal", "pending")})
    old = F.col(status)
    finished = (F.col("terminal") == F.col("total")) & (F.col("pending") == 0)
    new = (
        F.when(old == "archived", old)
        .when(F.col("total") == 0, "draft")
        .when(finished, "ready")
        .when(old == "processing", old)
        .otherwise("uploading")
    )
    return joined.withColumn("new_status", new).withColumn(
        "became_ready", (F.col("new_status") == "ready") & (old != "ready")
    )


def owner_bytes(items: DataFrame, parents: DataFrame, parent: str, owner: str, size: str) -> DataFrame:
    """Bytes per owner. Items are summed per parent first; owners without items get 0."""
    per_parent = items.groupBy(parent).agg(F.sum(size).alias("_b"))
    return (
        parents.select(parent, owner)
        .join(per_parent, parent, "left")
        .groupBy(owner)
        .agg(F.coalesce(F.sum("_b"), F.lit(0)).cast("bigint").alias("used_bytes"))
    )


def storage_breakdown(
    owners: DataFrame, parents: DataFrame, items: DataFrame, owner: str, parent: str, size: str,
    status: str = "status", limit: str = "limit_bytes",
) -> DataFrame:
    """Active and archived bytes per owner, and the share of the limit in percent."""
    per_parent = items.groupBy(parent).agg(F.sum(size).alias("_b"))
    split = (
        parents.join(per_parent, parent, "left")
        .groupBy(owner)
        .agg(
            F.sum(F.when(F.col(status) == "archived", F.lit(0)).otherwise(F.col("_b"))).alias("active_bytes"),
            F.sum(F.when(F.col(status) == "archived", F.col("_b")).otherwise(F.lit(0))).alias("archived_bytes"),
        )
    )
    out = owners.join(split, owner, "left").withColumns({c: zero(c) for c in ("active_bytes", "archived_bytes")})
    used = F.col("active_bytes") + F.col("archived_bytes")
    return out.withColumn("used_bytes", used).withColumn(
        "percent", share(F.lit(100.0) * F.col("used_bytes"), F.col(limit))
    )


def child_counts(parents: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """Counts per parent of several child tables and conditions: each table is read, aggregated and joined once."""
    tables: dict[int, tuple[DataFrame, dict[str, Column]]] = {}
    for name, (child, condition) in children.items():
        wanted = F.lit(True) if condition is None else condition
        tables.setdefault(id(child), (child, {}))[1][name] = F.count_if(wanted)
    out = parents
    for child, counts in tables.values():
        out = per_key(out, child, [key], **counts)
    return out.select(*parents.columns, *children)


def outcome_counts(df: DataFrame, status: str, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(F.col(status) == n).alias(n) for n in names])


def observed(df: DataFrame, name: str, status: str, names: Sequence[str]) -> tuple[DataFrame, Observation]:
    """``df`` with counters of its outcomes that the job which writes it fills on the way: no pass of their own. ``Observation.get`` has
    them after the job. A stream with counters reports them for every batch, under ``name`` in its progress (``observed_stream``)."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == n).alias(n) for n in names]), watch


def observed_stream(stream: DataFrame, name: str, status: str, names: Sequence[str]) -> DataFrame:
    return stream.observe(name, F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == n).alias(n) for n in names])


def eta_seconds(total: str, done: str, elapsed: str) -> Column:
    """Whole seconds left at the average pace; null before any progress, 0 when finished."""
    left = F.col(total) - F.col(done)
    known = (F.col(done) > 0) & (F.col(elapsed) > 0)
    return F.when(F.col(done) <= 0, F.lit(None)).when(left <= 0, F.lit(0)).when(
        known, F.floor(left / (F.col(done) / F.col(elapsed)))
    ).cast("bigint")


def upload_sessions(progress: DataFrame, session: str, file: str, ts: str, status: str, sent: str, tie: str) -> DataFrame:
    """Per session: files by latest status, bytes sent (never going down), and the batch status."""
    files = progress.groupBy(session, file).agg(
        F.max_by(status, F.struct(ts, tie)).alias("_s"), F.max(sent).alias("_b")
    )
    out = files.groupBy(session).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("_s") == "complete").alias("completed"),
        F.count_if(F.col("_s") == "failed").alias("failed"),
        F.count_if(F.col("_s") == "uploading").alias("active"),
        F.sum("_b").alias("uploaded_bytes"),
    )
    finished = F.col("completed") + F.col("failed") == F.col("files")
    return out.withColumn(
        "batch_status",
        F.when(finished & (F.col("failed") == F.col("files")), "error").when(finished, "complete").otherwise("uploading"),
    )


def _first_spellings(entries: Column) -> Column:
    """Of an array of (_k, pos, entry): the first of each ``_k`` as (pos, entry), in order of their places."""
    bind = lambda value, use: F.transform(F.array(value), use)[0]
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (x["_k"] != F.get(s, i - 1)["_k"]))
    return F.sort_array(F.transform(bind(F.sort_array(entries), first), lambda x: F.struct(x["pos"].alias("pos"), x["entry"].alias("entry"))))


def spellings(df: DataFrame, by: Sequence[str], text: str, sep: str = ",") -> DataFrame:
    """(by, spelled): entries of a separated list, unique ignoring case, as an array of (pos, entry) in the order of their first places.

    A key with one row, as ids have, is worked out inside that row and only its text is moved. Rows of other keys are taken apart, so that
    no list of many rows is in one task before it is unique.
    """
    on = list(by)
    rows = df.where(F.col(text).isNotNull()).select(*on, F.col(text).alias("_text"))
    keys = rows.select(*on).groupBy(*on).agg((F.count(F.lit(1)) > 1).alias("_several"))
    same = [F.col(f"_key_{k}").eqNullSafe(F.col(k)) for k in on]
    several = keys.where("_several").select(*[F.col(k).alias(f"_key_{k}") for k in on])
    entry = lambda e, i: F.struct(F.lower(F.trim(e)).alias("_k"), i.alias("pos"), F.trim(e).alias("entry"))
    cut = F.filter(F.transform(F.split("_text", sep), entry), lambda x: x["entry"] != "")
    filled = F.filter(F.array(_first_spellings(cut)), lambda x: F.size(x) > 0)  # taken out of an array, it is worked out once
    one = rows.join(several, same, "left_anti").select(*on, F.explode(filled).alias("spelled"))
    parts = rows.join(several, same, "left_semi").select(*on, F.posexplode(F.split("_text", sep)).alias("pos", "entry")).withColumn("entry", F.trim("entry"))
    firsts = parts.where(F.col("entry") != "").groupBy(*on, F.lower("entry").alias("_k")).agg(F.min(F.struct("pos", "entry")).alias("_first"))
    many = firsts.groupBy(*on).agg(F.sort_array(F.collect_list("_first")).alias("spelled"))
    return one.unionByName(many)


def distinct_ignoring_case(df: DataFrame, by: Sequence[str], text: str, sep: str = ",") -> DataFrame:
    """Entries of a separated list, unique ignoring case; first spelling and first place are kept."""
    return spellings(df, by, text, sep).select(*by, F.inline("spelled")).select(*by, "entry", "pos")


def toggled_on(log: DataFrame, key: Sequence[str]) -> DataFrame:
    """Members after a toggle log: keys that were toggled an odd number of times."""
    return log.groupBy(*key).agg(F.count(F.lit(1)).alias("toggles")).where(F.col("toggles") % 2 == 1)
