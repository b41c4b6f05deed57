"""What several operators share: written intermediate tables, batch bounds, column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import fresh
from ..sources.scratch import Scratch

__all__ = ["BATCH_BYTES", "WORD", "Scratch", "documents", "fresh", "small_batches", "word_count"]

#: A word, as every contract here spells it.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch of rows that goes to a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that this session hands to Python by bytes: whole texts differ in length by orders of magnitude.

    The bound must hold when the result runs, which is after the operator has
    returned, so it stays set; a smaller one that the session has is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = str(spark.conf.get(key)).removesuffix("b")
    if not own.isdecimal() or not 0 < int(own) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
