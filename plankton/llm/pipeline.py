"""The corpus pipeline: language, near duplicates, benchmark passages, mixture, shards.

Each stage takes what the one before it kept, as a stored table, and all but
the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from .common import Scratch, documents
from .decontam import OP3_SQL, decontaminate
from .langid import OP1_SQL, keep_identified
from .mixing import OP9_SQL, mix_documents
from .neardup import NEAR_SQL, drop_near_duplicates
from .sharding import FLOW_SQL, shard_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    return shard_documents(docs)


STAGES = [("language ID", language), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("source mixing", mixture), ("sharding", shards)]

#: Each stage as SQL over the one before: the same rules, with every pair of documents compared.
ORACLE_SQL = f"""
WITH RECURSIVE s1 AS (
  SELECT d.* FROM documents d JOIN ({OP1_SQL}) x USING (doc_id) WHERE x.lang_pred <> 'und' AND x.score >= 0.1),
s2 AS (SELECT d.* FROM s1 d JOIN ({NEAR_SQL.format(source="s1", words=5, percent=80)}) x USING (doc_id) WHERE x.kept),
s3 AS (SELECT * FROM s2 WHERE doc_id NOT IN (SELECT doc_id FROM ({OP3_SQL.replace("FROM documents", "FROM s2")}) x)),
s4 AS (SELECT d.* FROM s3 d JOIN ({OP9_SQL.replace("FROM documents", "FROM s3")}) x USING (doc_id), range(CASE WHEN x.size > 0 THEN x.taken // x.size ELSE 0 END)),
c AS (
  SELECT *, text AS tie, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS pos,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS place FROM s4),
{FLOW_SQL}
SELECT doc_id, text, lang, source, n_chars, CAST(shard AS INTEGER) AS shard, slot + rank - lo AS slot
FROM r JOIN runs ON r.arc = runs.arc AND rank >= lo AND rank < hi
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    scratch = Scratch(spark, "pipeline")
    return functools.reduce(lambda docs, stage: scratch.keep(stage[1](spark, docs, sf_dir), "stage"), STAGES, documents(spark, sf_dir))
