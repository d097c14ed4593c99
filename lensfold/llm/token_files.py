"""Token ids as Parquet list columns, in ascending order of the document id.

Files hold (doc_id, shard, start_in_shard, n_tokens, ids). Ids are dictionary encoded: the vocabulary fits in one
dictionary page, an id takes as many bits as the vocabulary needs. The other columns are delta encoded. Row groups
and pages are small and every page is in the page index, so a reader of a range of ids or of the metadata columns
skips the rest. ``shard`` numbers the ranges of ids; ``starts`` gives what lies before each of them.

A null text counts as empty; an empty text has the end id alone. Rows with equal ids are ordered by text, rows without
an id come first. An empty table gives no rows. Added tokens in a
text get their own ids, as the library gives by default. Columns other than id and text aren't written.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from lensfold.llm.common import chunks, partitions, text_or_empty, utf8_bytes
from lensfold.llm.ordered import boundaries, bucket, ordered_key

SCHEMA = "doc_id long, shard int, start_in_shard long, n_tokens long, ids array<int>"
#: Words in each of a worker's two generations of known words, and the longest that is kept.
REMEMBERED, LONG_WORD = 300_000, 60
#: Bytes of text that are cut into words together.
AT_ONCE = 8 << 20
NO_IDS = np.zeros(0, "<u4")

LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.dictionary.page.size": str(2 << 20),
    **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "shard", "start_in_shard", "n_tokens")},
}


class WordEncoder:
    """Ids of texts by a tokenizer that lowers case, whose matches never hold white space and are either letters, one digit or marks.
    Known words are looked up; new ones go to the library together, with a mark between them that none of them holds, and the
    ids are cut there. Words of lower-case ASCII and Latin-1 letters are one match that no normalisation changes: they go to the same
    merges without the expressions.

    ASCII capitals are lowered here, but for those before a character that isn't ASCII: the two may be composed, and the library
    composes before it lowers. Marks at the end of a word become a word of their own where a plain letter or digit stands before
    them. Texts that may hold an added token go to the library whole, unless ``added_are_text``. Ids are little-endian unsigned
    32-bit integers."""

    BETWEEN = b"|"
    COMPOSED = "[A-Z][^\\x00-\\x7f]"
    LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
    MARKS = "([0-9a-z])([.,!?;:#$%&*|]+(?:[\\x20\\x09-\\x0d]|$))"

    def __init__(self, path: str, added_are_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        if added_are_text:
            self.library.encode_special_tokens = True
            self.added = None
        else:
            added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
            self.added = "|".join(added)
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        (self.cut,) = self.library.encode(self.BETWEEN.decode(), add_special_tokens=False).ids
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def looked_up(self, words: list[bytes], library: Tokenizer) -> Iterator[tuple[bytes, bytes]]:
        """(word, ids) by a tokenizer, for words without the mark ``BETWEEN``."""
        between = b" " + self.BETWEEN + b" "
        groups = list(chunks(words, 200))
        found = library.encode_batch_fast([(between.join(some) + between).decode() for some in groups], add_special_tokens=False)
        for some, x in zip(groups, found, strict=True):
            ids = np.array(x.ids, "<u4")
            data, cuts = ids.tobytes(), 4 * np.flatnonzero(ids == self.cut)
            for w, a, b in zip(some, [0, *(cuts[:-1] + 4).tolist()], cuts.tolist(), strict=True):
                yield w, data[a:b]

    def whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [pack(f"<{len(x.ids)}I", *x.ids) for x in found]

    def words(self, texts: pa.Array) -> pa.ListArray:
        low = pc.ascii_lower(texts)
        if pc.any(composed := pc.match_substring_regex(texts, self.COMPOSED)).as_py():
            own = [np.frombuffer(x, "u1") for x in utf8_bytes(texts.filter(composed))]
            lowered = [np.where((x >= 65) & (x <= 90) & ~np.append(x[1:] > 127, False), x + 32, x).astype("u1").tobytes() for x in own]
            low = pc.replace_with_mask(low, composed, pa.array(lowered, pa.binary()).cast(low.type))
        return pc.ascii_split_whitespace(pc.replace_substring_regex(low, self.MARKS, "\\1 \\2"))

    def known(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of these different words."""
        unknown = set(words) - self.young.keys()
        self.young.update((w, self.old[w]) for w in unknown & self.old.keys())
        unknown -= self.old.keys()
        letters = [w for w in unknown if w.isalpha() or self.LETTERS.fullmatch(w)]
        unknown.difference_update(letters)
        odd = [w for w in unknown if self.BETWEEN in w]
        self.young.update(self.looked_up(letters, self.plain))
        self.young.update(self.looked_up(list(unknown.difference(odd)), self.library))
        self.young.update(zip(odd, self.whole(odd), strict=True))
        found = [self.young[w] for w in words]
        if len(self.young) > REMEMBERED:
            self.old = {w: ids for w, ids in self.young.items() if len(w) <= LONG_WORD}
            self.young = {}
        return found

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each begins and the last ends). Null is empty."""
        parts = [self.encode_part(texts.slice(at, n)) for at, n in by_bytes(texts, AT_ONCE)]
        return np.concatenate([NO_IDS, *(ids for ids, _ in parts)]), np.concatenate([[0], np.cumsum(np.concatenate([[], *(n for _, n in parts)]))]).astype("int64")

    def encode_part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many of each)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        special = pc.match_substring_regex(texts, self.added, ignore_case=True) if self.added else pa.array([False] * len(texts))
        lists = self.words(pc.if_else(special, "", texts))
        words = lists.flatten().dictionary_encode()
        own = self.known(utf8_bytes(words.dictionary))
        pool, sizes = np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), "int64", len(own)) // 4
        at = words.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if n.size else 0
        ids = pool[np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - n), n) + np.arange(total)] if total else NO_IDS
        counts = np.diff(np.concatenate([[0], ends])[np.asarray(lists.offsets) - lists.offsets[0].as_py()])
        if pc.any(special).as_py():
            cut = np.split(ids, np.cumsum(counts)[:-1])
            for i, x in zip(np.flatnonzero(special), self.whole(utf8_bytes(texts.filter(special))), strict=True):
                cut[i] = np.frombuffer(x, "<u4")
            ids, counts = np.concatenate(cut), np.array([x.size for x in cut])
        return ids, counts

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as bytes."""
        ids, at = self.encode_batch(pa.array(texts, pa.binary()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]


def by_bytes(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, number) of neighbouring texts of ``most`` bytes together, or of one that is longer."""
    begin, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if total and total + n > most:
            yield begin, i - begin
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts) - begin


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches together until they hold ``most`` bytes: the more words are looked up at once, the fewer of them differ."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(some)
            some, size = [], 0
    if some:
        yield pa.concat_batches(some)


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` behind every text."""
    return np.insert(ids, at[1:], end_id), at + np.arange(at.size)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path, added_are_text=False)


def write(docs: DataFrame, to: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``end_id``, write in ascending order of ``key``: shard i is file i."""
    parts = partitions(docs.sparkSession)
    rows = docs.select(ordered_key(key).alias("k"), F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.withColumn("shard", bucket("k", boundaries(rows, "k", parts)))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = encoder(tokenizer), 0
        for batch in gathered(batches, AT_ONCE):
            ids, offsets = with_end(*own.encode_batch(batch["text"]), end_id)
            values, lengths = ids.view("<i4"), np.diff(offsets)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.record_batch(
                {"doc_id": batch["doc_id"], "shard": batch["shard"], "start_in_shard": start + offsets[:-1], "n_tokens": lengths, "ids": lists}
            )
            start += int(offsets[-1])

    dealt = rows.repartitionById(parts, F.col("shard")).sortWithinPartitions("k", "text").select("doc_id", "shard", "text")
    dealt.mapInArrow(encoded, SCHEMA).write.options(**LAYOUT).parquet(to)


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The written rows, or those of a range of ids. Name the columns you need: only their pages are read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def starts(rows: DataFrame) -> DataFrame:
    """(shard, offset): ids in all shards before. One row for each file; reads the metadata columns only."""
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def crc32(ids: str | Column) -> Column:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            yield pa.array([zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64())

    return run(ids)
