"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line; nothing is normalised) hashes to a wide vector, a document's fingerprint is the sum of its
paragraphs' vectors modulo powers of two. So order doesn't matter, and paragraphs are added to or removed from a
fingerprint without the rest of the text (``plus``, ``minus``).

* ``EXACT`` lanes modulo 2^64 are uniform hashes of the paragraph: equal documents agree, others don't.
* ``NEAR`` lanes modulo 2^32 are sums of signs, one hash per clause of the paragraph. Inner products of these lanes
  estimate how many clauses two documents share; ``likeness`` is twice the shared ones over all, from 0 to 1.

Null texts count as empty; an empty text has one empty paragraph. Repeated rows are documents of their own.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensfold.llm.common import partitions, text_or_empty
from lensfold.llm.ordered import boundaries, bucket, ordered_key

EXACT, NEAR = 8, 128
#: A clause ends at a mark or after 24 bytes, counted from its start: what comes before an edit stays as it was.
CLAUSE = re.compile(rb"[^\n.!?,;:|]{1,24}(?:[.!?,;:|]+\x20*)?|[.!?,;:|]+\x20*")

Print = tuple[np.ndarray, np.ndarray]


def fingerprint(text: bytes) -> Print:
    """(exact lanes as uint64, near lanes as int32)."""
    exact = b"".join([blake2b(p, digest_size=8 * EXACT).digest() for p in text.split(b"\n")])
    clauses = CLAUSE.findall(text)
    signs = np.zeros(NEAR, "int64")
    for i in range(0, len(clauses), 4096):
        some = b"".join([blake2b(c, digest_size=NEAR // 8, person=b"clause").digest() for c in clauses[i : i + 4096]])
        bits = np.unpackbits(np.frombuffer(some, "u1").reshape(-1, NEAR // 8), axis=1)
        signs += 2 * bits.sum(axis=0, dtype="int64") - len(bits)
    return np.frombuffer(exact, "<u8").reshape(-1, EXACT).sum(axis=0, dtype="uint64"), signs.astype("int32")


def plus(a: Print, b: Print) -> Print:
    """Fingerprint of both documents' paragraphs together."""
    return a[0] + b[0], a[1] + b[1]


def minus(a: Print, b: Print) -> Print:
    """Fingerprint without the paragraphs of ``b``."""
    return a[0] - b[0], a[1] - b[1]


def likeness(a: Print, b: Print) -> float:
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    x, y = a[1].astype("float64"), b[1].astype("float64")
    all_ = x @ x + y @ y
    return float(min(1.0, max(0.0, 2 * (x @ y) / all_))) if all_ else 0.0


def packed(f: Print) -> bytes:
    return f[0].astype("<u8").tobytes() + f[1].astype("<i4").tobytes()


def unpacked(raw: bytes) -> Print:
    return np.frombuffer(raw[: 8 * EXACT], "<u8"), np.frombuffer(raw[8 * EXACT :], "<i4")


def fingerprints(text: str | Column) -> Column:
    """Fingerprint of a text column as binary."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([packed(fingerprint(t or b"")) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())

    return run(text)


def edited(text: str, after: str) -> str:
    """The last half of a text replaced by the first as many code points of another one."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document in ascending order of ``key``, the last followed by the first: (key, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next). Rows with equal keys are ordered by text; null is first.

    Tasks hold ranges of keys and get a copy of the next range's first document, so texts move once and no task holds
    more than two documents and a batch."""
    parts = partitions(docs.sparkSession)
    rows = docs.select(ordered_key(key).alias("k"), F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"))
    bounds = boundaries(rows, "k", parts)
    heads = sorted((x["b"], x["k"]) for x in rows.groupBy(bucket("k", bounds).alias("b")).agg(F.min("k").alias("k")).collect())  # one a range
    before = {k: parts + heads[i - 1][0] for i, (_, k) in enumerate(heads)}
    edges, order = np.array(bounds, "int64"), list(before)

    @F.arrow_udf("array<int>")
    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for keys in batches:
            keys = keys.to_numpy(zero_copy_only=False)
            own = np.searchsorted(edges, keys, side="right").tolist()
            yield pa.array([[b, before[k]] if k in before else [b] for b, k in zip(own, keys.tolist())], pa.list_(pa.int32()))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (id, text, fingerprint) of the document that waits for its next one
        for batch in batches:
            out = []
            for key_, text_, copy in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), batch["copy"].to_pylist(), strict=True):
                own = fingerprint(text_.encode())
                if last:
                    changed = edited(last[1], text_)
                    raw = changed.encode()
                    other = fingerprint(raw)
                    names = [base64.b64encode(packed(f)).decode() for f in (last[2], other)]
                    out.append((last[0], len(last[1]), sha256(raw).hexdigest(), *names, likeness(last[2], other), likeness(last[2], own)))
                last = None if copy else (key_, text_, own)
                if copy:
                    break
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
            yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=list(names))

    if not order:
        rows = rows.limit(0)
    dealt = rows.withColumn("place", F.explode(places("k"))).select(
        "k", "id", "text", F.pmod("place", F.lit(parts)).alias("shard"), (F.col("place") >= parts).alias("copy")
    )
    dealt = dealt.repartitionById(parts, F.col("shard")).sortWithinPartitions("copy", "k", "text").select("id", "text", "copy")
    found = dealt.mapInArrow(
        compared,
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
    return found.withColumnRenamed("id", key)
