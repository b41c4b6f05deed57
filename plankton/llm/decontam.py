"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

A short item inside a long document has almost no Jaccard similarity to it, so
both sides are partitioned by size.  Items of at most STEP shingles are looked
up exactly: if a document has k of an item's n shingles, it has one of any
n - k + 1 of them, so these, the rarest among the items, are sought among all
shingles of the document and none is missed.  Longer items fall into classes by
the power of two L that bounds their number of shingles; for each class a document is seen
as windows of 2 L shingles, L apart, one of which holds any passage of L
shingles whole.  An item and a window that share one of HASHES MinHash values
are candidates: at a containment of 0.8 the least Jaccard similarity of an item
and such a window is 0.19, which 64 values miss with a probability of 1e-6.
The window minima of a class are minima of those of the class below, so all
classes together cost one pass.  Candidates are verified by the share of the
item's distinct shingles that the whole document has.

The items are the query side and are taken in blocks of at most BLOCK_BYTES of
text, each small enough to go to every task; every block meets all documents.
No document leaves its task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, small_batches
from .textnum import constants, shingle_hashes, word_hashes

WORDS = 5
THRESHOLD = 0.8
HASHES = 64
#: Shingles of the smallest window step; items of no more are looked up exactly.
STEP = 16
BLOCK_BYTES = 16 << 20
#: Shingles worked on at a time.
CHUNK = 1 << 18


class Index:
    """The MinHash values and the shingle sets of one block of items."""

    def __init__(self, items: list[tuple[int, str]], words: int, threshold: float):
        self.words, self.threshold = words, threshold
        self.ids, self.sets = [], []
        for i, text in items:
            if len(s := np.unique(shingle_hashes(word_hashes(text), words))):
                self.ids.append(i)
                self.sets.append(s)
        self.factors = constants(HASHES, 4)
        self.short = self.lookup(*self.rarest())
        self.classes = {}
        level = [max(0, math.ceil(math.log2(len(s) / STEP))) for s in self.sets]
        for at in sorted(set(level) - {0}):
            own = [i for i, x in enumerate(level) if x == at]
            values = np.concatenate([(self.sets[i] * self.factors[:, None]).min(axis=1) for i in own])
            self.classes[at] = self.lookup(values, np.repeat(own, HASHES))

    @staticmethod
    def lookup(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]:
        """Values in order, their owners, and a bitmap of their lowest bits with its mask."""
        order = np.argsort(values, kind="stable")
        bits = max(20, len(values).bit_length() + 4)
        seen = np.zeros(1 << bits, bool)
        seen[values & np.uint64((1 << bits) - 1)] = True
        return values[order], owner[order], seen, np.uint64((1 << bits) - 1)

    def rarest(self) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of short items, so many of each that a hit has one of them, and their owners."""
        own = [i for i, s in enumerate(self.sets) if len(s) <= STEP]
        if not own:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        distinct, count = np.unique(np.concatenate([self.sets[i] for i in own]), return_counts=True)
        values = []
        for i in own:
            s = self.sets[i]
            least = max(1, math.ceil(self.threshold * len(s)))
            values.append(s[np.argsort(count[np.searchsorted(distinct, s)], kind="stable")][: max(0, len(s) - least + 1)])
        return np.concatenate(values), np.repeat(own, [len(v) for v in values])

    def candidates(self, shingles: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs that share a value; the documents' shingles stand one after the other."""
        found: set[tuple[int, int]] = set()
        values, owner, seen, mask = self.short
        at = np.flatnonzero(seen[shingles & mask])
        left, right = (np.searchsorted(values, shingles[at], side) for side in ("left", "right"))
        of = np.repeat(np.arange(len(sizes)), sizes)[at]
        for x in np.flatnonzero(right > left):
            found.update((int(of[x]), int(o)) for o in owner[left[x] : right[x]])
        if not self.classes:
            return found
        firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        blocks = -(-sizes // STEP)
        doc = np.repeat(np.arange(len(sizes)), blocks)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = firsts[doc] + number * STEP
        low = np.empty((HASHES, len(starts)), np.uint64)
        for j, a in enumerate(self.factors):
            low[j] = np.minimum.reduceat(shingles * a, starts)
        for at in range(max(self.classes) + 1):
            if at:  # join neighbours 0 and 1, 2 and 3, ... of each document
                even = np.flatnonzero(number % 2 == 0)
                low, doc, number = np.minimum.reduceat(low, even, axis=1), doc[even], number[even] // 2
            if at in self.classes:
                values, owner, seen, mask = self.classes[at]
                window = low.copy()
                same = np.flatnonzero(doc[1:] == doc[:-1])
                window[:, same] = np.minimum(low[:, same], low[:, same + 1])
                j, w = np.nonzero(seen[window & mask])
                v = window[j, w]
                left, right = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
                for x in np.flatnonzero(right > left):
                    found.update((int(doc[w[x]]), int(o)) for o in owner[left[x] : right[x]])
        return found

    def hits(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(row, item id, its shingles, those that the text has) of all verified pairs, rows in order."""
        out, rows, held, size = [], [], [], 0

        def flush() -> None:
            sizes = np.array([len(x) for x in held])
            for d, i in sorted(self.candidates(np.concatenate(held), sizes)):
                both = int(np.isin(self.sets[i], held[d]).sum())
                if both >= self.threshold * len(self.sets[i]):
                    out.append((rows[d], self.ids[i], len(self.sets[i]), both))

        for row, text in enumerate(texts):
            if len(s := shingle_hashes(word_hashes(text), self.words)):
                rows.append(row)
                held.append(s)
                size += len(s)
            if size >= CHUNK:
                flush()
                rows, held, size = [], [], 0
        if held:
            flush()
        return out


def indexes(items: DataFrame, words: int, threshold: float, item_id: str, item_text: str) -> Iterator[Index]:
    """An index for each block of items."""
    small_batches(items.sparkSession)
    items = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()  # bounded by the number of blocks
        yield Index([(r["id"], r["text"]) for r in rows], words, threshold)


def contaminated(docs: DataFrame, items: DataFrame, *, words: int = WORDS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: every document and item with n_shared >= threshold * n_item.

    n_item counts the item's distinct shingles of `words` words, n_shared those
    of them that the document has.  A text with fewer words is one shingle, so
    such an item is found only in documents that consist of it; null and empty
    texts have none and are in no pair.  Repeated rows give repeated pairs.
    Empty tables give an empty result; other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("item_id", T.LongType()), T.StructField("n_item", T.LongType()), T.StructField("n_shared", T.LongType())])

    def search(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = index.hits(batch.column(1).to_pylist())
                row, *rest = (pa.array([x[i] for x in found], pa.int64()) for i in range(4))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), *rest], ["doc_id", "item_id", "n_item", "n_shared"])

        return docs.mapInArrow(run, schema)

    out = None
    for index in indexes(items, words, threshold, item_id, item_text):
        part = search(index)
        out = part if out is None else out.union(part)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, *, words: int = WORDS, threshold: float = THRESHOLD, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, in which contaminated() finds no item.  Rows are filtered where they are read."""
    at = docs.columns.index(text_col)

    def clean(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in index.hits(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        return run

    for index in indexes(items, words, threshold, item_id, item_text):
        docs = docs.mapInArrow(clean(index), docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH t AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM t),
s AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s WHERE side = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n.n AS n_item, count(*) AS n_shared, count(*) / n.n::DOUBLE AS containment
FROM s d JOIN s b ON d.side = 'd' AND b.side = 'b' AND d.g = b.g JOIN n ON n.id = b.id
GROUP BY d.id, b.id, n.n HAVING count(*) >= 0.8 * n.n
"""
