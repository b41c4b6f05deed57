"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `vnodes` points on a ring and a key belongs to the next point
clockwise.  A shard takes no more rows than its capacity; keys that come to a
full shard continue clockwise to the next point whose shard has room.  The
capacities add up to the number of rows and differ by at most one, so the
loads do as well (law `rows`).

What is gathered is one count for each arc of the ring, shards * vnodes
numbers whatever the input.  On these the overflow is worked out in runs of
ranks (`place_arcs`), and each row finds its shard and slot by its rank within
its own arc.  Rows of an arc are in the order of a second hash, of id and text,
so an arc of any size splits evenly into parts of about PART_ROWS rows, also if
all its rows share one id.  Only part counts are prefix-summed, and a task
ranks the rows of its parts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fresh

SHARDS = 16
#: Points of each shard on the ring.
VNODES = 512
#: Rows of a part of an arc, about.
PART_ROWS = 4096
#: Hexadecimal digits of a position, on the ring and in an arc.
DIGITS = 13


def ring(n_shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the points in ascending order, and the shard of each."""
    points = sorted((int(hashlib.md5(f"{s}:{v}".encode()).hexdigest()[:DIGITS], 16), s) for s in range(n_shards) for v in range(vnodes))
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int32)


def place_arcs(counts: np.ndarray, owner: np.ndarray, n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, slot of the first rank) for all rows of all arcs.

    Round r offers what is left of each arc to the r-th point clockwise from it.
    Within a round a shard serves arcs in ring order, and in an arc the lowest
    ranks.  A full shard never empties, so every shard splits one run at most.
    """
    total = int(counts.sum())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    slot = [0] * n_shards
    runs = []
    left = [(arc, 0, int(n)) for arc, n in enumerate(counts) if n]
    for r in range(len(counts)):
        rest = []
        for arc, lo, hi in left:
            s = int(owner[(arc + r) % len(owner)])
            if n := min(hi - lo, room[s]):
                runs.append((arc, lo, lo + n, s, slot[s]))
                room[s] -= n
                slot[s] += n
            if lo + n < hi:
                rest.append((arc, lo + n, hi))
        if not (left := rest):
            break
    return runs


def position(*parts: Column) -> Column:
    """A number of DIGITS hexadecimal digits that follows from the parts; a null counts as empty."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def shard_documents(docs: DataFrame, *, n_shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with two more columns, `shard` and `slot` (0, 1, ... within the shard).

    docs is read three times (twice only ids and hashes of texts), so it must
    be a stored table or otherwise give the same rows each time.  Null ids
    count as one key, as equal ids do; rows of one key are told apart by their
    text.  Columns of docs named shard or slot are replaced.  An empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    points, owner = ring(n_shards, vnodes)
    docs = docs.drop("shard", "slot")
    names = {n: fresh(docs, f"ring_{n}") for n in ("arc", "rank", "part", "place", "of", "lo", "hi", "slot", "shard", "start", "in", "parts", "at")}

    @F.pandas_udf("int")
    def arc_of(p: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, p.to_numpy(), side="left") % len(points), dtype="int32")

    arc, place, part = (F.col(names[n]) for n in ("arc", "place", "part"))
    arcs = docs.select(arc_of(position(F.col(id_col))).alias(names["arc"]))
    counts = np.zeros(len(points), np.int64)
    for a, n in arcs.groupBy(names["arc"]).count().collect():  # at most n_shards * vnodes rows
        counts[a] = n
    runs = place_arcs(counts, owner, n_shards)
    placed = spark.createDataFrame(runs, ", ".join(f"{names[n]} {t}" for n, t in (("of", "int"), ("lo", "long"), ("hi", "long"), ("shard", "int"), ("slot", "long"))))
    sizes = spark.createDataFrame([(a, -(-n // PART_ROWS)) for a, n in enumerate(counts.tolist())], f"{names['in']} int, {names['parts']} long")

    def parted(df: DataFrame) -> DataFrame:
        """Adds arc, place in the arc and part of the arc.  Proven bound of the broadcast: a row for each arc."""
        df = df.withColumn(names["arc"], arc_of(position(F.col(id_col)))).withColumn(names["place"], position(F.col(id_col), F.col(text_col)))
        df = df.join(F.broadcast(sizes), arc == F.col(names["in"]))
        return df.withColumn(names["part"], F.floor(place.cast("double") * F.col(names["parts"]) / float(16**DIGITS))).drop(names["in"], names["parts"])

    held = parted(docs.select(id_col, text_col)).groupBy(arc.alias(names["at"]), part.alias(names["in"])).agg(F.count(F.lit(1)).alias(names["start"]))
    so_far = Window.partitionBy(names["at"]).orderBy(names["in"])
    starts = held.withColumn(names["start"], F.sum(names["start"]).over(so_far) - F.col(names["start"]))
    order = Window.partitionBy(names["arc"], names["part"]).orderBy(place, F.col(id_col), F.col(text_col))
    ranked = parted(docs).withColumn(names["rank"], F.row_number().over(order) - 1)
    ranked = ranked.join(starts, (arc == F.col(names["at"])) & (part == F.col(names["in"]))).withColumn(names["rank"], F.col(names["rank"]) + F.col(names["start"]))
    rank = F.col(names["rank"])
    # Proven bound: a run for each arc and a split for each shard.
    here = ranked.join(F.broadcast(placed), (arc == F.col(names["of"])) & (rank >= F.col(names["lo"])) & (rank < F.col(names["hi"])))
    return here.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(names["shard"]).alias("shard"), (F.col(names["slot"]) + rank - F.col(names["lo"])).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_documents(docs, text_col="text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Over a relation c of rows with a position `pos`, a place `place` in an arc, a doc_id and a column `tie`: r, the rows with arc and rank, and runs.
FLOW_SQL = r"""
ring AS (
  SELECT s, p, row_number() OVER (ORDER BY p, s) - 1 AS arc
  FROM (SELECT s, CAST('0x' || substr(md5(s || ':' || v), 1, 13) AS BIGINT) AS p FROM range(16) a(s), range(512) b(v))),
r AS (
  SELECT c.*, coalesce(ring.arc, 0) AS arc, row_number() OVER (PARTITION BY coalesce(ring.arc, 0) ORDER BY c.place, doc_id NULLS FIRST, tie) - 1 AS rank
  FROM c ASOF LEFT JOIN ring ON c.pos <= ring.p),
flow AS (
  SELECT 0 AS round, arc, CAST(0 AS BIGINT) AS lo, count(*) AS hi, CAST(NULL AS BIGINT) AS shard, CAST(NULL AS BIGINT) AS slot FROM r GROUP BY arc
  UNION ALL
  SELECT round + 1, arc, CASE WHEN placed OR e = 0 THEN lo ELSE lo + take END, CASE WHEN placed OR e = 1 THEN hi ELSE lo + take END,
         CASE WHEN placed OR e = 0 THEN s END, CASE WHEN placed THEN slot WHEN e = 0 THEN used + start END
  FROM (
    SELECT *, greatest(0, least(hi - lo, (SELECT count(*) FROM c) // 16 + CASE WHEN s < (SELECT count(*) FROM c) % 16 THEN 1 ELSE 0 END - used - start)) AS take
    FROM (
      SELECT f.*, f.shard IS NOT NULL AS placed, coalesce(f.shard, ring.s) AS s,
             CAST(sum(CASE WHEN f.shard IS NOT NULL THEN hi - lo ELSE 0 END) OVER (PARTITION BY coalesce(f.shard, ring.s)) AS BIGINT) AS used,
             CAST(sum(CASE WHEN f.shard IS NULL THEN hi - lo ELSE 0 END) OVER (PARTITION BY coalesce(f.shard, ring.s) ORDER BY f.shard IS NOT NULL, f.arc, lo) AS BIGINT) - CASE WHEN f.shard IS NULL THEN hi - lo ELSE 0 END AS start,
             count(*) FILTER (f.shard IS NULL) OVER () AS waiting
      FROM flow f JOIN ring ON ring.arc = (f.arc + f.round) % 8192)
    WHERE waiting > 0), range(2) x(e)
  WHERE CASE WHEN placed THEN e = 0 WHEN e = 0 THEN take > 0 ELSE lo + take < hi END),
runs AS (SELECT DISTINCT arc, lo, hi, shard, slot FROM flow WHERE shard IS NOT NULL)
"""
OP10_SQL = (
    r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), n)) AS tab),
k AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS pos FROM documents),
c AS (
  SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || tie), 1, 13) AS BIGINT) AS place FROM (
    SELECT doc_id, pos, CAST(len(bytes) + 1 AS BIGINT) AS size,
           CAST(xor(list_reduce(bytes, lambda crc, b: xor(crc >> 8, tab[(xor(crc, b) & 255) + 1]), 4294967295), 4294967295) AS BIGINT) AS text_crc32, text_crc32 AS tie FROM k, tab)),
"""
    + FLOW_SQL
    + """
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, slot + rank - lo AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN runs ON r.arc = runs.arc AND rank >= lo AND rank < hi
"""
)
