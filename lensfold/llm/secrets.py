"""Secret scan: an Aho-Corasick pass finds keywords, anchored expressions look only where one was hit, and tokens that
carry a checksum count only when it holds.

Kinds of spans, in this order where two start at the same place:

* ``assign``: a name such as ``password``, a colon or equals sign, and a value of 8 characters or more
* ``access``: ``AKIA`` and capitals or digits, 16 characters or more
* ``hex``: 32 or more lower-case hex digits. They have no keyword; one expression for runs finds them
* ``github``, ``npm``: prefix, 30 characters, and their CRC-32 in base 62 as six more

Matches of a kind are leftmost and don't overlap; a match that fails its test is dropped after it has taken its place.
A null or empty text has no spans. Rows are looked at one by one: repeated rows give repeated results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lensfold.llm.common import utf8_bytes

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
SPANS = "array<struct<kind:string,start:int,end:int>>"

# Keyword in lower case, kind, expression anchored at the keyword, least length, group that has it.
ANCHORED = (
    *(
        (name, "assign", rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1)
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key")
    ),
    ("akia", "access", rb"AKIA[A-Z0-9]+", 16, 0),
    *((f"gh{x}_", "github", rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", 40, 0) for x in "pousr"),
    ("npm_", "npm", rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", 40, 0),
)
HEX_RUN = re.compile(rb"[0-9a-f]{32,}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: bytes) -> bytes:
    """CRC-32 as six digits of base 62."""
    value, digits = zlib.crc32(body), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.encode()


def holds(kind: str, found: bytes) -> bool:
    """Whether the checksum at the end of a token belongs to its middle; kinds without one always hold."""
    return kind not in ("github", "npm") or found[-6:] == checksum62(found[4:-6])


@lru_cache(maxsize=1)
def _rules() -> tuple[ahocorasick.Automaton, dict[str, tuple]]:
    words = ahocorasick.Automaton()
    for name, *_ in ANCHORED:
        words.add_word(name, name)
    words.make_automaton()
    return words, {name: (kind, re.compile(rule), least, group) for name, kind, rule, least, group in ANCHORED}


def spans_of(text: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes, ordered by start, then kind."""
    words, rules = _rules()
    found, taken = [], {}
    hits = sorted((at - len(name) + 1, name) for at, name in words.iter(text.lower().decode("latin-1")))
    for at, name in hits:
        kind, rule, least, group = rules[name]
        if at < taken.get(kind, 0) or not (m := rule.match(text, at)):
            continue
        taken[kind] = m.end()
        if len(m[group]) >= least and holds(kind, m[0]):
            found.append((at, KINDS.index(kind), m.end()))
    found += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX_RUN.finditer(text)]
    return [(start, KINDS[k], end) for start, k, end in sorted(found)]


def code_points(text: bytes, spans: list[tuple[int, str, int]]) -> list[dict]:
    """Byte places as places in code points."""
    if text.isascii():
        return [{"kind": k, "start": a, "end": b} for a, k, b in spans]
    places, at, count = {}, 0, 0
    for x in sorted({p for a, _, b in spans for p in (a, b)}):
        count += len(text[at:x].decode())
        places[x], at = count, x
    return [{"kind": k, "start": places[a], "end": places[b]} for a, k, b in spans]


def scan(text: str | Column) -> Column:
    """Spans of a text column in code points, end exclusive, as an array of (kind, start, end)."""

    @F.arrow_udf(SPANS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            yield pa.array([code_points(t, s) if (s := spans_of(t)) else [] for t in utf8_bytes(texts)], kind)

    return run(text)


def mask(text: str | Column, name: Callable[[str], str] = "[{}]".format) -> Column:
    """The text with its secrets replaced; spans that touch or overlap become one, named after the first. Null stays null."""

    def masked(raw: bytes) -> bytes:
        out, end = [], 0
        for start, kind, stop in spans_of(raw):
            if not out or start > end:
                out += [raw[end:start], name(kind).encode()]
            end = max(end, stop)
        return b"".join(out) + raw[end:] if end else raw

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            done = [None if x is None else masked(x) for x in texts.cast(pa.binary()).to_pylist()]
            yield pa.array(done, pa.binary()).cast(pa.string())

    return run(text)


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the wanted kinds, joined by commas."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
