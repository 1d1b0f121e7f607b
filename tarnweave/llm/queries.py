"""The corpus operators' queries and SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import ann, chat, embed_dedup, licenses, minhash, packing, quality, sentencepiece_codec, token_blocks, toxicity
from .common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"))


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.write_token_blocks(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors are in the graph; every one whose id is divisible by 50 is a query against all."""
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), every=50)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.concat_ws("; ", "tags").alias("tags"), F.concat_ws("; ", "notices").alias("notices"), "expression", "permitted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.similar_counts(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.fold_chats(chat.revised_events(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_sentencepiece, op2_token_blocks, op3_nearest_neighbours, op4_packing, op5_licenses, op6_toxicity, op7_embedding_pairs, op8_quality, op9_near_duplicates, op10_chat)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


#: What common.PUNCT trims, as a regular-expression class.
_P = r"[!-/:-@\[-`{-~¡¿«»“”‘’…–—]+"

#: Licence -> pattern over the text in lower case with single spaces; single-licence tags and the notices that SQL can tell.
_NOTICES = {
    "MIT": r"\bmit licen[sc]e\b|\bpermission is hereby granted, free of charge\b",
    "Apache-2.0": r"\bapache licen[sc]e,? version 2\.0|\bapache licen[sc]e 2\.0",
    **{f"GPL-{v}.0-{k}": rf"\bgnu general public licen[sc]e,? version {v}(\.0)?{tail}" for v in (1, 2, 3) for k, tail in (("or-later", ",? or (\\(at your option\\) )?(any )?later"), ("only", "(?:[^0-9.]|\\.[^0-9]|\\.?$)"))},
    **{f"CC-BY{k}-{v}": rf"\bcc by{k.lower()} {v.replace('.', '[.]')}" for k in ("", "-NC", "-SA", "-ND", "-NC-SA", "-NC-ND") for v in ("3.0", "4.0")},
    "LicenseRef-proprietary": r"\ball rights reserved\b",
}
_ALLOWED = ", ".join(f"'{x}'" for x in sorted(licenses.ALLOWED))

ORACLE = {
    "op5_licenses": rf"""
        WITH texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS raw, regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g') AS t FROM documents),
        patterns(name, p) AS (VALUES {", ".join(f"('{n}', '{p}')" for n, p in _NOTICES.items())}),
        hits AS (SELECT k, name, length(regexp_extract(t, '^(.*?)(' || p || ')', 1)) AS pos FROM texts, patterns WHERE regexp_matches(t, p)),
        notes AS (SELECT k, list(name ORDER BY pos) AS n FROM hits GROUP BY k),
        found AS (
            SELECT k, doc_id, list_distinct(regexp_extract_all(raw, '(?i)spdx-license-identifier: *([A-Za-z0-9.+-]+)', 1)) AS tags, coalesce(n, []) AS n
            FROM texts LEFT JOIN notes USING (k)),
        told AS (SELECT *, CASE WHEN len(tags) > 0 OR len(n) > 1 THEN list_filter(n, lambda x: x <> 'LicenseRef-proprietary') ELSE n END AS kept FROM found)
        SELECT doc_id, array_to_string(tags, '; ') AS tags, array_to_string(kept, '; ') AS notices,
               CASE WHEN len(tags) + len(kept) > 0 THEN array_to_string(list_concat(tags, kept), ' AND ') END AS expression,
               CASE WHEN len(tags) + len(kept) > 0 THEN len(list_filter(list_concat(tags, kept), lambda x: x NOT IN ({_ALLOWED}))) = 0 END AS permitted
        FROM told""",
    "op9_near_duplicates": rf"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[\s\p{{Z}}]+'), lambda x: regexp_replace(x, '^{_P}|{_P}$', '', 'g')), lambda x: x <> '') AS w
            FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, chr(1))] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2]) END) AS s
            FROM words WHERE len(w) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
        near AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE c >= 0.5 * (p.n + q.n - c)),
        edges AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
        reach(id, top) AS (SELECT DISTINCT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT e.b, r.top FROM reach r JOIN edges e ON e.a = r.id WHERE r.top < e.b)
        SELECT id AS doc_id, min(top) AS group_id FROM reach GROUP BY id""",
    "op7_embedding_pairs": """
        WITH sized AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS size FROM embeddings),
        coded AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(round(x / size * 32767) AS INTEGER)) AS code FROM sized WHERE size > 0),
        classes AS (SELECT code, min(vec_id) AS class_id, arg_min(embedding, vec_id) AS e FROM coded GROUP BY code),
        links AS (
            SELECT x.class_id, count(*) AS links FROM classes x JOIN classes y ON x.class_id <> y.class_id
            WHERE list_cosine_similarity(x.e, y.e) >= 0.95 GROUP BY 1)
        SELECT vec_id, class_id, coalesce(links, 0) AS links FROM coded JOIN classes USING (code) LEFT JOIN links USING (class_id)""",
    "op10_chat": """
        WITH numbered AS (
            SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS m
            FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        told AS (SELECT *, max(m) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS top FROM numbered),
        final AS (
            SELECT conv_id, m, role,
                   CASE WHEN conv_id % 7 = 3 AND m = 2 THEN text || ' (edited)' WHEN conv_id % 7 = 5 AND m = top THEN 'Again: ' || text ELSE text END AS text,
                   NOT (conv_id % 7 = 1 AND m % 6 = 4 OR conv_id % 7 = 3 AND m > 2 OR conv_id % 7 = 5 AND top IS NOT NULL AND m > top) AS stays
            FROM told)
        SELECT conv_id, CAST(count(*) FILTER (WHERE stays) AS INTEGER) AS n_messages,
               CAST(count(*) FILTER (WHERE stays AND role = 'user') AS INTEGER) AS n_user,
               CAST(count(*) FILTER (WHERE stays AND role = 'assistant') AS INTEGER) AS n_assistant,
               coalesce(string_agg('<|im_start|>' || role || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY m) FILTER (WHERE stays), '') AS rendered
        FROM final GROUP BY conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
