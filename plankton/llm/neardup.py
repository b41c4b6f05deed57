"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union of verified links.

1. Each text becomes a set of word shingles.  Texts with equal sets form a
   class, and only the class's smallest id, its representative, goes on.
2. Representatives get a SuperMinHash signature and a key for each of its
   bands.  In each bucket (band, key) every member is compared with the
   smallest one only, so a bucket of m texts costs m pairs and not m * m.
3. Pairs whose signatures agree well enough are verified on the full sets, and
   the verified links are united into components.
4. Buckets whose members now all lie in one component need no more.  In the
   others, members of different components are compared with each other by
   signature, in blocks of about BLOCK members so that no task holds a large
   bucket.  Members with a promising pair meet again with their texts; pairs are
   verified inside the task and only those that unite two components leave it,
   so what is passed on is in proportion to the members, not to the pairs.

So every two texts that share a bucket are either verified, estimated to be
far from the threshold, or connected already: no link between different texts
is lost but by the signatures.  With 24 bands of 4 rows a pair at similarity
0.85 shares no bucket with a probability of 2e-8 (at 0.8: 3e-6), and a
signature of 96 values estimates it more than MARGIN too low with less than
1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, fresh, small_batches
from .components import connected_components
from .textnum import band_keys, mix, shingle_set, superminhash

BANDS, ROWS = 24, 4
#: How far below the threshold a signature's estimate may lie.
MARGIN = 0.22
#: Members of a bucket's block, about; two blocks meet in one comparison.
BLOCK = 1024


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """id, text -> id, n_shingles, two 64-bit hashes of the whole set, its signature and the key of each band (null for an empty set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = shingle_set(text, words)
                sig = superminhash(s, BANDS * ROWS) if len(s) else None
                # Sums of two scrambles of each element: a hash of the set.
                h1, h2 = (int(mix(x).sum(dtype=np.uint64)) - 2**63 for x in (s, s ^ np.uint64(0x5851F42D4C957F2D)))
                out.append((len(s), h1, h2, None if sig is None else sig.tobytes(), None if sig is None else band_keys(sig, BANDS)))
            yield pd.DataFrame({"id": batch["id"]} | {c: [x[i] for x in out] for i, c in enumerate(("n_shingles", "h1", "h2", "sig", "keys"))})

    return docs.select("id", "text").mapInPandas(run, "id long, n_shingles long, h1 long, h2 long, sig binary, keys array<long>")


def promising(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (a, b) whose signatures agree in a share of at least `least`."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="bool")
        p, q = (np.frombuffer(b"".join(z), np.uint32).reshape(len(z), -1) for z in (x, y))
        return pd.Series((p == q).mean(axis=1) >= least)

    p = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
    p = p.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return p.where(near("sig_a", "sig_b")).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) with den * intersection >= num * union on the full shingle sets."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out, last, t = [], None, None
        for p, q in zip(x, y, strict=True):
            s = shingle_set(p, words)
            if q is not last:
                last, t = q, shingle_set(q, words)
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(den * both >= num * (len(s) + len(t) - both))
        return pd.Series(out, dtype="bool")

    texts = docs.select("id", "text")
    p = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    p = p.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return p.where(linked("text_a", "text_b")).select("a", "b").distinct()


class Run:
    """Members of one bucket that meet in one comparison, as arrays: two blocks of the bucket or one with itself."""

    COLUMNS = ("run", "band", "block", "within", "id", "component", "sig")

    def __init__(self, batch: pd.DataFrame, sigs: np.ndarray, at: slice):
        self.band, self.within = int(batch["band"].iat[at.start]), bool(batch["within"].iat[at.start])
        self.block, self.ids, self.components = (batch[c].to_numpy()[at] for c in ("block", "id", "component"))
        self.sigs = sigs[at]

    def pairs(self, least: float) -> Iterator[tuple[int, np.ndarray]]:
        """Rows i and, for each, later rows of another component and, if two blocks meet, another block, that agree in
        `least` of their signatures and share no earlier bucket; so each pair of texts comes up in one bucket only."""
        for i in range(len(self.ids) - 1):
            other = self.components[i + 1 :] != self.components[i]
            if not self.within:
                other &= self.block[i + 1 :] != self.block[i]
            if len(j := i + 1 + np.flatnonzero(other)):
                same = self.sigs[j] == self.sigs[i]
                first = same.reshape(len(j), BANDS, ROWS).all(axis=2).argmax(axis=1)
                if len(j := j[(same.mean(axis=1) >= least) & (first == self.band)]):
                    yield i, j


def runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, Run]]]]:
    """Batches of rows sorted by run, cut between runs, with the runs of each (and where they start)."""

    def cut(batch: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, list[tuple[int, Run]], pd.DataFrame | None]:
        edges = np.flatnonzero(np.diff(batch["run"].to_numpy())) + 1
        bounds = [0, *edges.tolist(), len(batch)]
        if not last:
            bounds.pop()
        whole = batch.iloc[: bounds[-1]]
        sigs = np.frombuffer(b"".join(whole["sig"]), np.uint32).reshape(len(whole), BANDS * ROWS)
        found = [(s, Run(whole, sigs, slice(s, e))) for s, e in zip(bounds, bounds[1:], strict=False) if e - s > 1]
        return whole, found, None if last else batch.iloc[bounds[-1] :]

    held = None
    for batch in batches:
        if held is not None and len(held):
            batch = pd.concat([held, batch], ignore_index=True)
        if len(batch):
            whole, found, held = cut(batch, False)
            yield whole, found
    if held is not None and len(held):
        yield cut(held.reset_index(drop=True), True)[:2]


def unsettled(members: DataFrame, least: float) -> DataFrame:
    """members: bucket, blocks, band, id, component, sig of buckets with several components -> those of them that have a promising pair, by run.

    A bucket of m members is dealt into ceil(m / BLOCK) blocks and every two
    blocks meet once, in one run of at most about 2 * BLOCK rows.  A row comes
    out at most once for each run it is in, not once for each pair.
    """
    m = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumn("run", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))).withColumn("within", F.col("block") == F.col("other")).select(*Run.COLUMNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole, found in runs(batches):
            promising = np.zeros(len(whole), bool)
            for start, r in found:
                for i, j in r.pairs(least):
                    promising[start + i] = promising[start + j] = True
            yield whole[promising]

    return m.repartition("run").sortWithinPartitions("run").mapInPandas(run, m.schema)


def settled(rows: DataFrame, docs: DataFrame, words: int, num: int, den: int, least: float) -> DataFrame:
    """Links (a, b) that unite components within the runs that unsettled() gives, verified on the full sets: at most one less than a run has rows."""
    rows = rows.join(docs, "id").select(*Run.COLUMNS, "text")

    def links_of(run: Run, texts: list[str]) -> list[tuple[int, int]]:
        sets: dict[int, np.ndarray] = {}
        parent: dict[int, int] = {}

        def set_of(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = shingle_set(texts[x], words)
            return sets[x]

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = c = parent.get(up, up)
            return c

        out = []
        for i, js in run.pairs(least):
            for j in js.tolist():
                p, q = root(int(run.components[i])), root(int(run.components[j]))
                if p != q:
                    both = len(np.intersect1d(set_of(i), set_of(j), assume_unique=True))
                    if den * both >= num * (len(set_of(i)) + len(set_of(j)) - both):
                        parent[max(p, q)] = min(p, q)
                        out.append((max(run.ids[i], run.ids[j]), min(run.ids[i], run.ids[j])))
        return out

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole, found in runs(batches):
            texts = whole["text"].tolist()
            yield pd.DataFrame([x for start, r in found for x in links_of(r, texts[start : start + len(r.ids)])], columns=["a", "b"], dtype="int64")

    return rows.repartition("run").sortWithinPartitions("run").mapInPandas(check, "a long, b long")


def near_duplicates(docs: DataFrame, *, words: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of docs.

    Two documents are linked if threshold[1] * |intersection| >= threshold[0] *
    |union| of their sets of distinct shingles of `words` words; a component is
    what links reach and is named by its smallest id, the one that is kept.  A
    text with fewer words is one shingle; a null or empty text has none and is
    linked with nothing.  A row without an id is alone, kept, with a null
    component.  Rows that share an id are one node.  An empty table gives an
    empty one; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    num, den = threshold
    least = num / den - MARGIN
    scratch = Scratch(spark, "neardup")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = scratch.keep(sketched(docs, words), "sets")
    full = sets.where("n_shingles > 0 AND id IS NOT NULL")
    classes = scratch.keep(full.groupBy("h1", "h2").agg(F.min("id").alias("rep")), "classes")
    sigs = full.select("id", "sig")
    reps = full.select("id", "keys").join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    buckets = scratch.keep(reps.select(F.posexplode("keys").alias("band", "key"), "id").select(F.xxhash64("band", "key").alias("bucket"), F.col("band").cast("int").alias("band"), "id"), "buckets")
    # Both sides of the joins on a bucket are stored, so Spark can split a bucket that holds many rows.
    hubs = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("most")).where("hub <> most").select("bucket", "hub")
    shared = scratch.keep(buckets.join(scratch.keep(hubs, "hubs"), "bucket"), "shared")
    pairs = shared.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    links = scratch.keep(verified(promising(pairs, sigs, least), docs, words, num, den), "star")
    parts = connected_components(links, scratch)

    def labelled(ids: DataFrame) -> DataFrame:
        return ids.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    placed = scratch.keep(labelled(shared.select("bucket", "band", "id")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    mixed = scratch.keep(mixed.where("least <> most").select("bucket", "blocks"), "mixed")
    members = scratch.keep(placed.join(mixed, "bucket"), "members").join(sigs, "id")
    open_rows = scratch.keep(unsettled(members, least), "unsettled")
    links = scratch.keep(links.union(settled(open_rows, docs, words, num, den, least)).distinct(), "links")
    # Rows that share an id but not a text stay one node: their classes' representatives are linked.
    nodes = full.select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "rep")
    node_of = nodes.groupBy("id").agg(F.min("rep").alias("node"), F.max("rep").alias("last"))
    twice = nodes.join(node_of.where("node <> last"), "id", "left_semi").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    parts = connected_components(links.union(twice), scratch)
    joined = node_of.join(parts, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    out = sets.join(joined, "id", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, *, words: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all columns; of rows that share an id, one each for as many as there are."""
    found = near_duplicates(docs, words=words, threshold=threshold, id_col=id_col, text_col=text_col)
    gone = fresh(docs, "gone_id")
    return docs.join(found.where(~F.col("kept")).select(F.col("doc_id").alias(gone)), F.col(id_col) == F.col(gone), "left_anti")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, threshold=(85, 100))


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {source}),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i : i + {words} - 1], ' ') FOR i IN range(1, len(w) - {words} + 2)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
OP6_SQL = NEAR_SQL.format(source="documents", words=3, percent=85)
