"""Fields from a language model. The model is any function from prompt to answer, run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.extract import balanced_json

Model = Callable[[str], str]
ENTITIES = "map<string,array<string>>"


def ask(model: Model, prompt: Column) -> Column:
    """Answers; null where the prompt is null or the model fails."""

    @F.arrow_udf("string")
    def answer(prompts: pa.Array) -> pa.Array:
        out = []
        for p in prompts.to_pylist():
            try:
                out.append(None if p is None else model(p))
            except Exception:  # noqa: BLE001  a failed call leaves the field out
                out.append(None)
        return pa.array(out, pa.string())

    return answer(prompt)


@F.arrow_udf(T.StringType())
def _first_object(answers: pa.Array) -> pa.Array:
    return pa.array([None if a is None else balanced_json(a) for a in answers.to_pylist()], pa.string())


def _prompt(c: Column, head: str, limit: int, least: int = 1) -> Column:
    return F.when(F.octet_length(c) >= least, F.concat(F.lit(head + "\n\n"), text.truncate(c, limit, "")))


def summarise(df: DataFrame, field: str, model: Model) -> DataFrame:
    """<field>_summary for texts of 100 bytes or more, of which the model sees 4000."""
    return df.withColumn(f"{field}_summary", ask(model, _prompt(F.col(field), "Summarise this text in two sentences:", 4000, 100)))


def entities(df: DataFrame, field: str, model: Model) -> DataFrame:
    """<field>_entities: lists by kind, from the first 3000 bytes."""
    got = _first_object(ask(model, _prompt(F.col(field), "List people, organizations, locations, dates and products as JSON lists:", 3000)))
    return df.withColumn(f"{field}_entities", F.from_json(got, ENTITIES))


def sentiment(df: DataFrame, field: str, model: Model) -> DataFrame:
    """<field>_sentiment: label and score, from the first 2000 bytes."""
    got = _first_object(ask(model, _prompt(F.col(field), "Rate the sentiment as JSON with label and score:", 2000)))
    return df.withColumn(f"{field}_sentiment", F.from_json(got, "struct<label:string,score:double>"))


def relevance(df: DataFrame, field: str, topic: str, model: Model, drop: bool = False) -> DataFrame:
    """<field>_relevant: whether the answer contains yes; drop=True: rows answered otherwise go, unanswered ones stay."""
    col = f"{field}_relevant"
    df = df.withColumn(col, F.lower(ask(model, _prompt(F.col(field), f"Is this text about {topic}? Answer yes or no.", 2000))).contains("yes"))
    return df.where(F.coalesce(F.col(col), F.lit(True))) if drop else df
