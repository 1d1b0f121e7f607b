"""Dates, prices, numbers and other scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shape of a text -> the forms that can fit it, in the order tried; the weekday before the last shape's forms is dropped.
#: The month-first form precedes the day-first form, so 03/04/2024 is 4 March and 15/01/2024 is 15 January.
DATE_SHAPES = (
    (r"^[+-]?\d{4,}-", ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")),
    (r"^[+-]?\d{4,}/", ("yyyy/MM/dd",)),
    (r"^\d\d/", ("MM/dd/yyyy", "dd/MM/yyyy")),
    (r"^\d\d-\d", ("MM-dd-yyyy",)),
    (r"^\d\d-\D", ("dd-MMM-yyyy",)),
    (r"^\d\d [^:]*:", ("dd MMM yy HH:mm z", "dd MMM yy HH:mm xx")),
    (r"^\d{1,2} \D", ("d MMMM yyyy", "d MMM yyyy")),
    (r"^\p{L}+\.? \d{1,2},", ("MMMM d, yyyy", "MMM d, yyyy")),
)
WEEKDAY = "^[A-Z][a-z]{2},? "
DAY_FORMS = ("dd MMM yyyy HH:mm:ss z", "dd MMM yyyy HH:mm:ss xx", "dd MMM yyyy", "MMM d HH:mm:ss yyyy")
PRICE = r"[€£¥₹$]\s*[,\d]+(?:\.\d*)?|\d+[,.]\d\d\s*(?:EUR|GBP|INR|JPY|USD)"


def parse_date(c: Column) -> Column:
    """Timestamp by the first form that fits the whole text; else null. The text's shape tells which few forms are tried."""
    bare = F.regexp_replace(c, WEEKDAY + "+", "")
    tried = lambda x, forms: F.coalesce(*[F.try_to_timestamp(x, F.lit(p)) for p in forms])
    out = F.when(c.rlike(WEEKDAY) & ~c.rlike(DATE_SHAPES[-1][0]), tried(bare, DAY_FORMS))
    for shape, forms in DATE_SHAPES:
        out = out.when(c.rlike(shape), tried(c, forms))
    return out


def date_normalize(c: Column, out: str = "yyyy-MM-dd'T'HH:mm:ssXXX") -> Column:
    """The date in another form; a text that isn't a date stays."""
    return F.coalesce(F.date_format(parse_date(c), out), c)


def currency_normalize(c: Column) -> Column:
    """Digits, point and sign of a price, as text. A comma after the last point makes the comma the decimal sign, and then only the first one."""
    bare = F.regexp_replace(c, r"[^0-9.,\-]", "")
    last_comma = F.length(bare) - F.instr(F.reverse(bare), ",")
    last_point = F.when(F.instr(bare, ".") > 0, F.length(bare) - F.instr(F.reverse(bare), ".")).otherwise(-1)
    no_points = F.regexp_replace(bare, r"\.", "")
    european = F.concat(F.substring_index(no_points, ",", 1), F.lit("."), F.substr(no_points, F.instr(no_points, ",") + 1))
    return F.when(c == "", c).when((F.instr(bare, ",") > 0) & (last_comma > last_point), european).otherwise(F.regexp_replace(bare, ",", ""))


def to_int(c: Column) -> Column:
    """Leading integer of a text, 0 where there is none."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def to_float(c: Column) -> Column:
    """Leading number of a text, 0 where there is none."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def to_bool(c: Column) -> Column:
    return F.lower(c).isin("true", "1", "yes")


COERCE = {"int": to_int, "float": to_float, "bool": to_bool, "string": lambda c: c.cast("string")}


def find_price(c: Column) -> Column:
    """First price in a text, empty where there is none."""
    return F.regexp_extract(c, PRICE, 0)


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds to wait: an integer up to 120, or the time until an HTTP date, between 1 and 120; 5 where missing or unreadable."""
    secs = F.btrim(header).try_cast("int")
    at = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    left = F.unix_timestamp(at) - F.unix_timestamp(now)
    date = F.when(left < 0, 1).otherwise(F.least(left, F.lit(120)))
    return F.when(header.isNull() | (header == ""), 5).when(secs.isNotNull(), F.least(secs, F.lit(120))).when(at.isNotNull(), date).otherwise(5).cast("int")


def backoff_jitter(base: Column, seed: int = 0) -> Column:
    """base spread by a quarter either way."""
    return base * (0.75 + 0.5 * F.rand(seed))


def scale_step(workers: Column) -> Column:
    """How many workers to add or take away."""
    return F.when(workers < 5, 1).when(workers < 20, 2).when(workers < 50, 5).otherwise(10)


def scale_decision(utilisation: Column, memory: Column, workers: Column, queue: Column, least: int = 2, most: int = 64, up_below: float = 0.6, down_above: float = 0.85) -> Column:
    """Workers wanted next. load = 0.7 utilisation + 0.3 memory pressure; a low load with a queue longer than the pool adds some, a high load takes some away."""
    load = 0.7 * utilisation + 0.3 * memory
    up = (load < up_below) & (queue > workers) & (workers < most)
    down = (load > down_above) & (workers > least)
    return F.when(up, F.least(F.lit(most), workers + scale_step(workers))).when(down, F.greatest(F.lit(least), workers - scale_step(workers))).otherwise(workers).cast("int")


def match_score(n: Column, final: float | None = None) -> Column:
    """Quality of a selector by its number of matches; final: score beyond three of the element-based variant, 1/n."""
    base = F.when(n == 1, 1.0).when(n <= 3, 0.8)
    return base.when(n <= 10, 0.5).otherwise(0.2) if final is None else base.otherwise(final / n)


def media_class(mime: Column) -> Column:
    m = F.lower(mime)
    doc = m.startswith("application/pdf") | m.startswith("application/msword") | m.startswith("application/vnd.")
    return F.when(m.startswith("image/"), "image").when(m.startswith("video/"), "video").when(m.startswith("audio/"), "audio").when(doc, "document").otherwise("other")
