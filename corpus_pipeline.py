"""The corpus pipeline: stages that each call one operator of tarnweave.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, with all columns; labels come from sf_dir.
What holds for odd rows holds through all stages: a null or empty text is neither low in quality, nor toxic, nor a
copy of anything, and has no tokens to pack; rows with a null id are judged by their texts, are never taken for copies and
are packed with a null id; of rows that share an id one outlives dedup; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnweave.llm import minhash, packing, quality, toxicity
from tarnweave.llm.common import settle, table, unsettle


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null, empty and wordless texts resemble no labelled text and stay, and all stay without labels. Ties of votes (0.5)
    stay. Repeated rows share their fate. Extra columns are kept, whatever their names. No documents, no rows.
    """
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine calls toxic go.

    Null, empty and wordless texts have no known terms and stay, and all stay where labels are missing or of one
    class. A score that equals the cut is toxic. Repeated rows share their fate. Extra columns are kept. No documents, no rows.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the least id.

    Null, empty and wordless texts are copies of nothing and stay, and so do rows with a null id. Of rows that share an id
    one stays, the first as JSON. Extra columns are kept. No documents, no rows.
    """
    return minhash.drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into training sequences, whole.

    Null and empty texts have no tokens and appear in no sequence; a null id is packed as null; texts longer than a
    sequence are cut into pieces. Ties of sums of squares have one order. Extra columns go. No documents, no sequences.
    """
    return packing.pack_documents(docs)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("dedup", dedup_stage), ("packing", packing_stage)]
#: Fitted models and the order-dependent packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's output is written as Parquet and read again, and deleted once the next has used it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
            unsettle(before)
    return docs
