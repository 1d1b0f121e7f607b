"""The item pipeline: row operators over item columns. NULL stands for a missing field.

Each operator maps a DataFrame to a DataFrame; Pipeline chains them. Column rules are applied in one
projection per operator, which Catalyst merges with its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize, text

Operator = Callable[[DataFrame], DataFrame]
#: Metadata columns that operators on "all string fields" leave alone.
META = ("_url", "_spider", "_timestamp", "_depth")


def string_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in META]


def _over(df: DataFrame, fields: Sequence[str], rule: Callable[[Column], Column]) -> DataFrame:
    """The rule on the given fields, those that don't exist or are empty aside."""
    have = set(df.columns)
    return df.withColumns({f: F.when(F.col(f) == "", F.col(f)).otherwise(rule(F.col(f))) for f in fields if f in have})


def field_filter(*fields: str) -> Operator:
    """Only these fields and the metadata; no fields given: all."""
    return lambda df: df.select(*[c for c in df.columns if c in fields or c in META]) if fields else df


def field_rename(**names: str) -> Operator:
    """old=new, all at once; a field that has the new name already gives way."""

    def op(df: DataFrame) -> DataFrame:
        moves = {a: b for a, b in names.items() if a in df.columns}
        taken = set(moves.values())
        return df.select(*[F.col(c).alias(moves.get(c, c)) for c in df.columns if c in moves or c not in taken])

    return op


def required_fields(*fields: str) -> Operator:
    """Rows that have all fields; an empty string counts as present."""

    def op(df: DataFrame) -> DataFrame:
        if any(f not in df.columns for f in fields):
            return df.where(F.lit(False))
        return df.dropna(subset=list(fields)) if fields else df

    return op


def default_values(**values: object) -> Operator:
    """A value for missing fields; present ones, empty or not, stay."""
    return lambda df: df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in values.items()})


def trim(df: DataFrame) -> DataFrame:
    return _over(df, string_fields(df), text.trim)


def html_sanitize(df: DataFrame) -> DataFrame:
    return _over(df, string_fields(df), text.sanitize)


def pii_redact(df: DataFrame) -> DataFrame:
    return _over(df, string_fields(df), text.redact)


def date_normalize(*fields: str, out: str = "yyyy-MM-dd'T'HH:mm:ssXXX") -> Operator:
    return lambda df: _over(df, fields, lambda c: normalize.date_normalize(c, out))


def currency_normalize(*fields: str) -> Operator:
    return lambda df: _over(df, fields, normalize.currency_normalize)


def type_coercion(**kinds: str) -> Operator:
    """field=int|float|bool|string"""
    return lambda df: df.withColumns({f: normalize.COERCE[k](F.col(f).cast("string")) for f, k in kinds.items() if f in df.columns})


def field_validate(drop: bool = True, **patterns: str) -> Operator:
    """Fields that aren't empty must contain a match; else the row goes, or with drop=False the field does."""

    def op(df: DataFrame) -> DataFrame:
        for f, p in patterns.items():
            if f in df.columns:
                fine = (F.coalesce(F.col(f), F.lit("")) == "") | F.col(f).rlike(p)
                df = df.where(fine) if drop else df.withColumn(f, F.when(fine, F.col(f)))
        return df

    return op


def word_count(*fields: str) -> Operator:
    """<field>_word_count for fields that aren't empty."""
    return lambda df: df.withColumns({f"{f}_word_count": F.when(F.col(f) != "", text.word_count(F.col(f))) for f in fields if f in df.columns})


def dedup(key: str, url: str = "_url", order: Sequence[str] = ()) -> Operator:
    """The first row per key; rows without a key are told apart by their URL, among the keys' own values.

    `order` says which is first and should be total; one shuffle on the key.
    """

    def op(df: DataFrame) -> DataFrame:
        k = F.coalesce(F.when(F.col(key) != "", F.col(key)), F.col(url)) if key in df.columns else F.col(url)
        w = Window.partitionBy("_dedup_key").orderBy(*(order or [url]))
        return df.withColumn("_dedup_key", k).withColumn("_dedup_at", F.row_number().over(w)).where("_dedup_at = 1").drop("_dedup_key", "_dedup_at")

    return op


class Pipeline:
    """Operators in a row; a row an operator drops never reaches the next one."""

    def __init__(self, *operators: Operator):
        self.operators = operators

    def __call__(self, df: DataFrame) -> DataFrame:
        for op in self.operators:
            df = df.transform(op)
        return df


# -- open schemas: items as map<string,string>


def map_filter_fields(fields: Column, *names: str) -> Column:
    return F.map_filter(fields, lambda k, v: k.isin(*names)) if names else fields


def map_defaults(fields: Column, **values: str) -> Column:
    extra = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.map_concat(F.map_filter(extra, lambda k, v: ~F.coalesce(F.map_contains_key(fields, k), F.lit(False))), fields)


def map_rename(fields: Column, **names: str) -> Column:
    moves = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    left = F.map_filter(fields, lambda k, v: ~k.isin(*names.values()) | k.isin(*names))
    return F.transform_keys(left, lambda k, v: F.coalesce(F.element_at(moves, k), k))


def scalar_or_array(values: Column) -> Column:
    """JSON of a list of matches: one value as a string, several as an array, none as null."""
    one = F.regexp_extract(F.to_json(values), r"^\[(.*)\]$", 1)
    return F.when(F.size(values) == 1, one).when(F.size(values) > 1, F.to_json(values))


def envelope(df: DataFrame, fields: Sequence[str], url: str = "_url", spider: str | None = None, timestamp: str | None = None, depth: str | None = None) -> Column:
    """An item as JSON: fields, url, spider_name where set, timestamp, depth."""
    parts = [F.struct(*fields).alias("fields"), F.col(url).alias("url")]
    parts += [F.col(c).alias(n) for c, n in ((spider, "spider_name"), (timestamp, "timestamp"), (depth, "depth")) if c]
    return F.to_json(F.struct(*parts))
