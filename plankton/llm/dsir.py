"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and pairs of neighbouring words are hashed into BUCKETS buckets.  Two bag
models over the buckets, of the target texts and of all texts, give each
document the log weight sum(log p_target - log p_raw); adding an independent
Gumbel variable to each and taking the k largest samples k documents without
replacement in proportion to their weights.

Counts cover all texts and come to the driver as one number a bucket.  The k-th
largest key is found by counting keys in ranges that shrink, never by a sort
of everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents
from .lmscore import all_marked, good_documents
from .mixing import uniform
from .textnum import mix, word_hashes

BUCKETS = 10_000
#: Added to each bucket's count.
SMOOTH = 1.0
#: Share of the documents that the query samples.
SHARE = 0.1
RANGES, FEW = 1024, 10_000


def features(text: str | None, buckets: int) -> np.ndarray:
    """Bucket of each word and each pair of neighbours."""
    w = word_hashes(text)
    pairs = mix(w[:-1] * np.uint64(3) + w[1:]) if len(w) else w
    return (np.concatenate([w, pairs]) % np.uint64(buckets)).astype(np.int64)


def bucket_log_ratio(docs: DataFrame, buckets: int) -> np.ndarray:
    """log p_target - log p_raw of each bucket; docs as all_marked() gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, target in zip(batch["text"], batch["target"], strict=True):
                n = np.bincount(features(text, buckets), minlength=buckets)
                sums[0] += n
                if target:
                    sums[1] += n
        at = np.flatnonzero(sums[0])
        yield pd.DataFrame({"bucket": at, "raw": sums[0][at], "target": sums[1][at]})

    rows = docs.select("text", "target").mapInPandas(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    out = []
    for c in ("target", "raw"):
        n = np.bincount(rows["bucket"].to_numpy(np.int64), rows[c].to_numpy(np.float64), buckets) + SMOOTH
        out.append(np.log(n / n.sum()))
    return out[0] - out[1]


def kth_largest(keys: DataFrame, k: int) -> tuple[float, object] | None:
    """(key, id) of the k-th row by key descending, then id ascending; None if k is 0.

    Each round counts the keys of RANGES equal ranges of the interval that
    still holds the k-th and keeps one of them; the few rows left are ranked.
    """
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    if lo is None or k < 1:
        return None
    left, n = k, None
    while lo < hi and (n is None or n > FEW):
        step = (hi - lo) / RANGES
        if lo + step == lo:
            break
        at = F.least(F.floor((F.col("key") - lo) / step), F.lit(RANGES - 1)).cast("int")
        found = sorted(keys.where(F.col("key").between(lo, hi)).groupBy(at.alias("at")).agg(F.count(F.lit(1)), F.min("key"), F.max("key")).collect(), reverse=True)
        for _, n, least, most in found:  # at most RANGES rows
            if left <= n:
                lo, hi = least, most
                break
            left -= n
    rows = keys.where(F.col("key").between(lo, hi)).orderBy(F.desc("key"), "id").limit(left)
    return tuple(rows.orderBy("key", F.desc("id")).first())


def resample(docs: DataFrame, targets: DataFrame, *, share: float = SHARE, buckets: int = BUCKETS, seed: str = "gumbel", id_col: str = "doc_id", text_col: str = "text", target_id: str = "doc_id") -> DataFrame:
    """doc_id, log_weight, key, selected; one row a document, of which ceil(share * rows) are selected.

    targets lists the ids of documents to resemble.  A null text or one without
    words has log weight 0.  The Gumbel variable follows from the id, so
    reruns agree and rows that share an id and a text are selected together.
    An empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "dsir")
    ratio = bucket_log_ratio(all_marked(docs, targets, id_col, text_col, target_id), buckets)

    @F.pandas_udf("double")
    def log_weight(texts: pd.Series) -> pd.Series:
        return pd.Series([float(ratio[features(t, buckets)].sum()) for t in texts], dtype="float64")

    rows = docs.select(F.col(id_col).alias("id"), log_weight(F.col(text_col)).alias("log_weight"))
    rows = scratch.keep(rows.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform(F.col("id"), seed)))), "keys")
    cut = kth_largest(rows.select("key", "id"), math.ceil(share * rows.count()))
    if cut is None:
        chosen = F.lit(False)
    else:
        chosen = (F.col("key") > cut[0]) | ((F.col("key") == cut[0]) & (F.lit(cut[1] is None) | F.col("id").isNull() | (F.col("id") <= F.lit(cut[1]))))
    return rows.select(F.col("id").alias("doc_id"), "log_weight", "key", F.coalesce(chosen, F.lit(False)).alias("selected"))


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), good_documents(spark, sf_dir))
