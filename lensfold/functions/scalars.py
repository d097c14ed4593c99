"""Scalar column functions."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses in declaration order; the order is what sorting by status means.
EVENT_STATUSES = ("draft", "uploading", "processing", "ready", "archived")
PROCESSING_STATUSES = ("pending", "processing", "completed", "failed")
# Key names that are always redacted, and fragments that mark a key as sensitive.
SENSITIVE_NAMES = (
    "password", "passwd", "secret", "secret_key", "token", "access_token", "refresh_token", "authorization",
    "otp", "otp_code", "sms_api_key", "aws_secret_access_key", "aws_access_key_id",
)
SENSITIVE_FRAGMENTS = ("password", "otp", "token", "secret")
REDACTED = "***REDACTED***"
# Age class midpoints.
AGE_MIDPOINTS = (2, 9, 19, 29, 39, 49, 59, 69, 79)
# Accepted upload types, and the extension fallback.
UPLOAD_TYPES = ("image/jpeg", "image/png", "image/heic", "image/tiff", "image/webp")
TYPE_BY_EXTENSION = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".heic": "image/heic", ".heif": "image/heic",
    ".tif": "image/tiff", ".tiff": "image/tiff", ".webp": "image/webp",
}
UNKNOWN_TYPE = "application/octet-stream"
# Which rendition serves a variant, best first.
RENDITIONS = {
    "micro_thumb": ("micro_thumb", "thumb", "preview", "proxy"),
    "thumb": ("thumb", "preview", "proxy"),
    "preview": ("preview", "proxy", "thumb"),
    "full": ("proxy", "preview", "thumb"),
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordinal(status: Column | str, names: tuple[str, ...] = EVENT_STATUSES) -> Column:
    """Position of a status in its declared order."""
    pairs = [F.lit(x) for i, name in enumerate(names) for x in (name, i)]
    return F.create_map(*pairs)[_c(status)]


def stored_bytes(*parts: Column | str) -> Column:
    """Original, proxy and derivative bytes together; a missing part is 0."""
    total = F.lit(0).cast("bigint")
    for part in parts:
        total = total + F.coalesce(_c(part), F.lit(0)).cast("bigint")
    return total


def rendition_key(variant: str, keys: dict[str, Column | str]) -> Column:
    """First non-empty key for a variant; ``keys`` maps rendition name to column."""
    return F.coalesce(*[F.nullif(_c(keys[name]), F.lit("")) for name in RENDITIONS[variant] if name in keys])


def _ascii_fold(values: pd.Series) -> pd.Series:
    return values.map(
        lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    )


def slug(text: Column | str, empty: str = "event") -> Column:
    """URL name: compatibility-decomposed ASCII, lower case, runs of other characters become ``-``.

    Plain ASCII rows never leave the JVM: the Arrow function only sees the text that needs decomposition.
    """
    fold = F.pandas_udf(_ascii_fold, "string")
    source = _c(text)
    foreign = source.rlike("[^\\x00-\\x7F]")
    ascii_text = F.coalesce(F.when(~foreign, source), fold(F.when(foreign, source)))
    dashed = F.regexp_replace(F.lower(ascii_text), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit(empty))


def add_months(ts: Column | str, months: int) -> Column:
    """Calendar months later; the day is clamped to the end of the month and the time of day kept."""
    return _c(ts) + F.expr(f"INTERVAL {int(months)} MONTHS")


def floor_to(ts: Column | str, seconds: int) -> Column:
    """Start of the bucket of ``seconds`` that holds ``ts`` (epoch aligned)."""
    return F.timestamp_seconds(F.floor(F.unix_micros(_c(ts)) / F.lit(seconds * 1_000_000)) * seconds)


def national_number(phone: Column | str, prefix: str = "+91", digits: int = 10) -> Column:
    """National digits of a number with exactly this country code; null when invalid."""
    pattern = f"^\\+{prefix.lstrip('+')}([0-9]{{{digits}}})$"
    return F.nullif(F.regexp_extract(_c(phone), pattern, 1), F.lit(""))


def mask_contact(value: Column | str) -> Column:
    """Hide a phone number or mail address; anything shorter than 8 stays as it is."""
    v = _c(value)
    mail = F.concat(F.substring(F.substring_index(v, "@", 1), 1, 2), F.lit("***@"), F.split(v, "@")[1])
    lead = F.when(v.startswith("+"), F.substring(v, 1, 3)).otherwise(F.lit(""))
    phone = F.concat(lead, F.lit(" ******"), F.right(v, F.lit(4)))
    return F.when(F.length(v) < 8, v).when(v.contains("@"), mail).otherwise(phone)


def initials(name: Column | str) -> Column:
    words = F.split(F.trim(_c(name)), "\\s+")
    first = F.substring(words[0], 1, 1)
    second = F.when(F.size(words) > 1, F.substring(F.get(words, F.lit(1)), 1, 1)).otherwise(F.lit(""))
    return F.upper(F.concat(first, second))


def resolve_type(filename: Column | str, declared: Column | str) -> Column:
    """Declared type without parameters when accepted, else by extension, else whatever was declared."""
    bare = F.lower(F.regexp_replace(F.substring_index(F.coalesce(_c(declared), F.lit("")), ";", 1), "^\\s+|\\s+$", ""))
    ext = F.lower(F.regexp_extract(_c(filename), "[^./](\\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in TYPE_BY_EXTENSION.items() for x in pair])
    return F.when(bare.isin(*UPLOAD_TYPES), bare).otherwise(
        F.coalesce(F.try_element_at(table, ext), F.nullif(bare, F.lit("")), F.lit(UNKNOWN_TYPE))
    )


def expected_age(probs: Column | str, midpoints: tuple[int, ...] = AGE_MIDPOINTS, confidence: float = 0.5) -> Column:
    """Expected class midpoint, truncated; null unless the top probability is above ``confidence``."""
    p = _c(probs)
    bins = F.array(*[F.lit(float(b)) for b in midpoints])
    mean = F.aggregate(F.zip_with(p, bins, lambda x, b: x.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.array_max(p) > confidence, mean.cast("int"))


def valid_uuid(text: Column | str) -> Column:
    return F.coalesce(F.lower(_c(text)).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False))


def sensitive(key: Column | str) -> Column:
    k = F.regexp_replace(F.lower(_c(key)), "-", "_")
    return k.isin(*SENSITIVE_NAMES) | k.rlike("|".join(SENSITIVE_FRAGMENTS))


def redact_map(fields: Column | str) -> Column:
    """Redact the values of sensitive keys in a flat string map; stays in the JVM."""
    return F.transform_values(_c(fields), lambda k, v: F.when(sensitive(k), F.lit(REDACTED)).otherwise(v))


#: Part of a key, in any case and with either separator, that makes it sensitive.
_MARKED = "|".join(SENSITIVE_FRAGMENTS)
_NAMED = "|".join(SENSITIVE_NAMES).replace("_", "[-_]")
_SENSITIVE_KEY = re.compile(f"{_MARKED}|^(?:{_NAMED})$", re.IGNORECASE)
#: JSON text that may hold such a key; a key can also be written with escapes.
_MAY_HOLD = f'(?i)"[^"]*(?:{_MARKED})[^"]*"\\s*:|"(?:{_NAMED})"\\s*:|\\\\u'


def _hide(pairs: list[tuple]) -> dict:
    return {key: REDACTED if _SENSITIVE_KEY.search(key) else value for key, value in pairs}


def _without_secrets(texts: pd.Series) -> pd.Series:
    """The decoder hands over every object it has read, inner ones first; those keys are hidden on the way."""

    def clean(text):
        try:
            return text and json.dumps(json.loads(text, object_pairs_hook=_hide), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return text

    return texts.map(clean, na_action="ignore")


def redact_json(text: Column | str) -> Column:
    """Redact nested JSON text at any depth. Text that is not JSON, or can't hold a sensitive key, is returned unchanged
    and doesn't leave the JVM."""
    source = _c(text)
    suspect = source.rlike(_MAY_HOLD)
    return F.when(suspect, F.pandas_udf(_without_secrets, "string")(F.when(suspect, source))).otherwise(source)
