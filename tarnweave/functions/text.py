"""Text columns. White space is Unicode's and lengths are bytes of UTF-8 throughout."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order of redaction: wider patterns first, so the result doesn't depend on the order of a map.
#: ASCII word boundaries are spelled out because Java's \b follows Unicode.
_L, _R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
PII = (
    # the name begins where its run of characters does, or where the last match ended, and isn't given back: linear on long runs
    ("EMAIL", r"(?:(?<![\w.%+-])|\G)[\w.%+-]++@[A-Za-z\d.-]+\.[^\W\d_]{2,}"),
    ("CREDIT_CARD", _L + r"\d{4}(?:[\s-]?\d{4}){3}" + _R),
    ("SSN", _L + r"\d{3}-\d\d-\d{4}" + _R),
    ("PHONE_INTL", r"[+]\d{1,3}[\s.-]?[(]?\d{1,4}[)]?[\s.-]?\d{1,4}[\s.-]?\d{1,9}"),
    ("PHONE_US", _L + r"(?:\d{3}[.-]?){2}\d{4}" + _R),
    ("IP_V4", _L + r"(?:\d{1,3}[.]){3}\d{1,3}" + _R),
)
#: No pattern of PII fits a text without this.
PII_HINT = r"@|\d{3}|[+]\d|\d[.]\d"


def trim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++$", "")


def squeeze(c: Column) -> Column:
    """Trimmed, inner runs of white space as one space."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


@F.arrow_udf(T.StringType())
def _unescape(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())


def unescape(c: Column) -> Column:
    """HTML entities decoded once; only texts with an ampersand leave the JVM."""
    return F.when(c.contains("&"), _unescape(F.when(c.contains("&"), c))).otherwise(c)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def sanitize(c: Column) -> Column:
    """Markup removed without a space in its place (script text stays), entities decoded, white space squeezed."""
    return squeeze(unescape(strip_tags(c)))


def redact(c: Column) -> Column:
    """Personal data as [REDACTED_<KIND>]. Only texts with something like it, which one cheap pattern tells, go through all patterns."""
    out = c
    for kind, pattern in PII:
        out = F.regexp_replace(out, pattern, f"[REDACTED_{kind}]")
    return F.when(c.rlike(PII_HINT), out).otherwise(c)


def words(c: Column) -> Column:
    """Array of words by Unicode white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def truncate(c: Column, limit: int, suffix: str = "...", inside: bool = False) -> Column:
    """At most `limit` bytes, then the suffix where something was cut; inside=True: the suffix counts towards the limit.

    A character that the limit would split goes as a whole.
    """
    size = limit - len(suffix.encode()) if inside else limit
    cut = F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, size).cast("string"))
    cut = F.regexp_replace(cut, "�{1,3}$", "")
    return F.when(F.octet_length(c) > limit, F.concat(cut, F.lit(suffix))).otherwise(c)


def between(c: Column, left: str, right: str) -> Column:
    """What lies between the first `left` and the next `right`; empty where either is missing."""
    start = F.instr(c, left)
    rest = F.substr(c, start + F.lit(len(left)))
    end = F.instr(rest, right)
    return F.when((start > 0) & (end > 0), F.left(rest, end - 1)).otherwise(F.lit(""))


def css_escape(c: Column) -> Column:
    """A backslash before the characters : . [ ] ( ) / and space."""
    return F.regexp_replace(c, r"([:.\[\]()/ ])", r"\\$1")


def jaccard(a: Column, b: Column) -> Column:
    """Of the lower-case word sets: 1 for equal strings, 0 where one is empty."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    union = F.size(F.array_union(x, y))
    return F.when(a == b, 1.0).when((a == "") | (b == "") | (union == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def list_overlap(a: Column, b: Column) -> Column:
    """Common entries over the union's size, both taken from list lengths, so repeats count; 1 for two empty lists."""
    common = F.size(F.filter(b, lambda v: F.array_contains(a, v)))
    union = F.size(a) + F.size(b) - common
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(union == 0, 0.0).otherwise(common / union)


def map_overlap(a: Column, b: Column) -> Column:
    """Equal entries over the larger map's size; 1 for two empty maps."""
    common = F.size(F.array_intersect(F.map_entries(a), F.map_entries(b)))
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).otherwise(common / most)


def human_bytes(n: Column) -> Column:
    """512 B, 1.5 KB, 3.2 MB, ... of whole numbers. The value as a double, rounded exactly, halves to even, as printf does."""
    d = F.least(n.cast("double"), F.lit(2.0**63 - 1024)).cast("bigint")  # the most that a double below 2^63 holds

    def tenths(bits: int, unit: str) -> Column:
        part = d.bitwiseAND((1 << bits) - 1) * 10
        low, rest = F.shiftright(part, bits), part.bitwiseAND((1 << bits) - 1)
        up = ((rest > 1 << bits - 1) | ((rest == 1 << bits - 1) & (low % 2 == 1))).cast("bigint")
        t = F.shiftright(d, bits) * 10 + low + up
        return F.concat(F.call_function("div", t, F.lit(10)).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(f" {unit}"))

    return F.when(n < 1 << 10, F.format_string("%d B", n)).when(n < 1 << 20, tenths(10, "KB")).when(n < 1 << 30, tenths(20, "MB")).when(n >= 1 << 30, tenths(30, "GB"))


def human_millis(ms: Column) -> Column:
    """950ms, 1.2s, 3.4m"""
    return F.when(ms < 1000, F.format_string("%dms", ms.cast("long"))).when(ms < 60000, F.format_string("%.1fs", F.bround(ms / 1000.0, 1))).otherwise(F.format_string("%.1fm", F.bround(ms / 60000.0, 1)))


def mask_dsn(c: Column) -> Column:
    """The credentials of a connection string as ***."""
    return F.regexp_replace(c, "://[^@/]*@", "://***@")


def content_hash(c: Column, digits: int = 16) -> Column:
    """First hex digits of the SHA-256."""
    return F.substring(F.sha2(c, 256), 1, digits)
