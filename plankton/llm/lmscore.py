"""Cross-entropy difference between a target and a background language model (Moore and Lewis).

Both are bigram models over one vocabulary: all words of the corpus and the end
of a text.  The target side is a list of documents, the background every other
one.  The sides are matched in size: the counts of the larger are weighted by
the ratio of the two sizes, so it counts as the expected model of a sample as
large as the smaller one, drawn from all its documents.  With c the weighted
counts of a side, the probability of a word after a history is

    P(w | h) = (c(h, w) + PRIOR * P0(w)) / (c(h) + PRIOR)

where a history is a frequent word (at least FREQUENT of all running words),
the start of a text or the class of the other words.  P0 is the side's add-one
estimate for frequent words and shares the mass of the others evenly among
them.  All pairs of a history and a word are counted, whatever their number.

A document is scored by what its side holds besides it: its own occurrences of
a pair are left out of c(h, w) and c(h).  Its score is the mean over its words
and its end of the loss under the target model less that under the background
model: the lower, the closer to the target.

What grows with the corpus, the pair counts, stays on Spark: each task deals the
pairs of its documents by pair to tasks that count them and sum the losses of
each document, and the sums meet again by batch of documents.  What goes to all
tasks has a bound: 1 / FREQUENT words, 1 / HOT pairs, TARGETS ids; a longer list
of ids meets the documents in an exchange.  A pair of at least HOT of all running
words is such a pair, so no pair can fill a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, small_batches
from .textnum import mix, word_hashes

#: Least share of all running words of a history and of a pair that goes to all tasks.
FREQUENT, HOT = 1e-5, 1e-4
#: Weight of the lower-order estimate, in words.
PRIOR = 1.0
#: Ids of target documents that go to all tasks, at most.
TARGETS = 100_000
#: Counts that a task holds before it hands them on.
HELD = 1 << 21
#: Running words that one task counts, about.
TASK_WORDS = 1 << 22
#: Codes of the start of a text and of the class of other words as histories, and of the end as a word.
START, OTHER, END, FIRST = 0, 1, 0, 2
WORD_BITS = 46


def listed(targets: DataFrame, target_id: str) -> DataFrame:
    """The distinct ids of the target side as t."""
    return targets.select(F.col(target_id).alias("t")).where("t IS NOT NULL").distinct()


def marked(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, target_id: str) -> DataFrame:
    """id, text, target (whether the id is among the targets).  The ids go to all tasks: at most TARGETS, those with the smallest hashes; for every id use all_marked()."""
    small_batches(docs.sparkSession)
    ids = listed(targets, target_id).orderBy(F.xxhash64("t"), "t").limit(TARGETS)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), F.col("id") == F.col("t"), "left").select("id", "text", F.col("t").isNotNull().alias("target"))


def all_marked(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, target_id: str, scratch: Scratch | None = None) -> DataFrame:
    """The same for every id of the targets, whatever their number.

    More than TARGETS ids meet the texts in an exchange by id.  Rows without an
    id are never targets and stay out of it, so they cannot fill a task.  With
    scratch the rows of the exchange are stored once for several readers.
    """
    spark = docs.sparkSession
    ids = listed(targets, target_id)
    if ids.count() <= TARGETS:
        return marked(docs, targets, id_col, text_col, target_id)
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    met = rows.where("id IS NOT NULL").join(ids.hint("shuffle_hash"), F.col("id") == F.col("t"), "left").select("id", "text", F.col("t").isNotNull().alias("target"))
    out = met.unionAll(rows.where("id IS NULL").select("id", "text", F.lit(False).alias("target")))
    return out if scratch is None else scratch.keep(out, "marked", release=True)


class Counter:
    """Sums of weights by 64-bit key, held as pieces until they are many."""

    def __init__(self):
        self.pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, target: bool) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.pieces.append((k, n, n * target))
        self.size += len(k)

    def merge(self) -> None:
        keys, every, target = (np.concatenate(x) for x in zip(*self.pieces, strict=True))
        k, at = np.unique(keys, return_inverse=True)
        self.pieces = [(k, np.bincount(at, every, len(k)).astype(np.int64), np.bincount(at, target, len(k)).astype(np.int64))]
        self.size = len(k)

    def frames(self) -> Iterator[pd.DataFrame]:
        if self.pieces:
            self.merge()
            k, every, target = self.pieces[0]
            self.pieces, self.size = [], 0
            for i in range(0, len(k), 1 << 17):
                yield pd.DataFrame({"key": k[i : i + (1 << 17)].astype(np.int64), "n": every[i : i + (1 << 17)], "n_target": target[i : i + (1 << 17)]})


def counted(docs: DataFrame, keys_of) -> DataFrame:
    """key, n, n_target: how often keys_of(text) has each key, in all texts and in those of the target."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter()
        for batch in batches:
            fine = 0
            for text, target in zip(batch["text"], batch["target"], strict=True):
                if text:
                    before = counter.size
                    counter.add(keys_of(text), target)
                    fine += counter.size - before
                    if fine > HELD:
                        counter.merge()
                        fine = 0
            if counter.size > HELD:
                counter.merge()
                if counter.size > HELD:
                    yield from counter.frames()
        yield from counter.frames()

    partial = docs.select("text", "target").mapInPandas(run, "key long, n long, n_target long")
    return partial.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


class Vocabulary:
    """Codes of words: FIRST and up for frequent ones by hash; a pair of a history and a word is one number.

    The number has the history's code above WORD_BITS and below it the code of
    a frequent word, or a hash for any other word and then the sign bit as well.
    """

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Code of each word hash, OTHER for words that are not frequent."""
        if not len(self.hashes):
            return np.full(len(words), OTHER, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, at + FIRST, OTHER)

    def pairs(self, text: str) -> np.ndarray:
        """The pair of each word and of the end with its history; none for a text without words."""
        h = word_hashes(text)
        if not len(h):
            return np.empty(0, np.int64)
        code = self.codes(h)
        hashed = (mix(h) >> np.uint64(64 - WORD_BITS)).astype(np.int64) | np.int64(-(2**63))
        word = np.append(np.where(code == OTHER, hashed, code), END)
        return (np.concatenate([[START], code]) << WORD_BITS) | word


def parts(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histories' codes, and words' codes (OTHER for those that are not frequent)."""
    history = (pairs & (2**63 - 1)) >> WORD_BITS
    return history, np.where(pairs < 0, OTHER, pairs & ((1 << WORD_BITS) - 1))


class Side:
    """What all tasks know of one side: weight, and by code the counts of histories and P0 of words."""

    def __init__(self, weight: float, words: np.ndarray, other: int, texts: int, n_other: int):
        self.weight = weight
        self.history = np.concatenate([[texts, other], words]) * weight
        total, size = self.history.sum(), len(words) + n_other + 1
        self.lower = (np.concatenate([[texts, other], words]) * weight + 1) / (total + size)
        # Of words that are not frequent, each has the same share of their class.
        self.lower[OTHER] = (other * weight + n_other) / (total + size) / max(n_other, 1)

    def losses(self, pairs: np.ndarray, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
        """-log P of each pair, of its count and of what of that is the document's own."""
        history, word = parts(pairs)
        left = self.weight * (counts - own)
        return np.log(np.maximum(self.history[history] - self.weight * own, left) + PRIOR) - np.log(left + PRIOR * self.lower[word])


class Models:
    """Vocabulary, the two sides, and the hot pairs (ascending) with their counts in both."""

    def __init__(self, vocab: Vocabulary, target: Side, background: Side, hot: np.ndarray, hot_target: np.ndarray, hot_background: np.ndarray):
        self.vocab, self.sides, self.hot, self.counts = vocab, (target, background), hot, (hot_target, hot_background)

    def sums(self, pairs: np.ndarray, times: np.ndarray, is_target: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """times * loss of each pair under both models, for documents of the sides that is_target says."""
        return [times * side.losses(pairs, n, np.where(is_target == mine, times, 0)) for side, n, mine in zip(self.sides, counts, (True, False), strict=True)]


def word_models(docs: DataFrame, scratch: Scratch) -> tuple[Vocabulary, Side, Side, int]:
    """The vocabulary, the two sides, and the number of running words."""
    start = np.array([-1], np.int64)  # counts the texts that have words

    def keys(text: str) -> np.ndarray:
        h = word_hashes(text)
        return np.concatenate([h.view(np.int64), start]) if len(h) else h.view(np.int64)

    words = scratch.keep(counted(docs, keys), "words")
    texts = words.where("key = -1").select("n", "n_target").first() or (0, 0)
    words = words.where("key <> -1")
    n, n_target, distinct = (x or 0 for x in words.agg(F.sum("n"), F.sum("n_target"), F.count(F.lit(1))).first())
    known = words.where(F.col("n") >= max(1, FREQUENT * n)).toPandas()  # at most 1 / FREQUENT
    hashes = known["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    every, own = (known[c].to_numpy(np.int64)[order] for c in ("n", "n_target"))
    size = n_target + texts[1], n - n_target + texts[0] - texts[1]
    least = min(size) or max(size)
    sides = []
    for total, k, all_, begun in zip(size, (own, every - own), (n_target, n - n_target), (texts[1], texts[0] - texts[1]), strict=True):
        sides.append(Side(least / total if total else 1.0, k, int(all_ - k.sum()), begun, int(distinct - len(known))))
    return Vocabulary(hashes), *sides, int(n)


def train(docs: DataFrame, scratch: Scratch) -> tuple[Models, int]:
    """Everything that goes to all tasks, and the number of running words; docs as all_marked() gives them."""
    vocab, target, background, n = word_models(docs, scratch)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, target.history / target.weight + background.history / background.weight >= max(1, HOT * n)))

    def keys(text: str) -> np.ndarray:
        vocab, often = shared.value
        pairs = vocab.pairs(text)
        history, word = parts(pairs)
        return pairs[(pairs >= 0) & often[history] & often[word]]

    pairs = counted(docs, keys).where(F.col("n") >= max(1, HOT * n)).toPandas().sort_values("key")  # at most about 1 / HOT
    own = pairs["n_target"].to_numpy(np.int64)
    return Models(vocab, target, background, pairs["key"].to_numpy(np.int64), own, pairs["n"].to_numpy(np.int64) - own), n


def planes(x: np.ndarray) -> bytes:
    """Numbers of eight bytes, first bytes first: what sorted or alike numbers share then lies together and compresses."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


DEALT = "part long, batch long, doc binary, pair binary, ids array<string>, n_words array<long>, loss_target array<double>, loss_background array<double>"
SUMMED = "batch long, doc binary, sums binary, ids array<string>, n_words array<long>, loss_target array<double>, loss_background array<double>"


def dealt(docs: DataFrame, models, n_parts: int) -> DataFrame:
    """The pairs of each batch of documents, by part: pairs and the documents they are in (number in the batch * 2 + target).

    One more row a batch, with a negative part, has ids, numbers of words and the
    losses of hot pairs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = models.value
        first = TaskContext.get().partitionId() << 32
        number = 0
        for frame in batches:
            for lo in range(0, len(frame), 1 << 14):
                rows = frame.iloc[lo : lo + (1 << 14)]
                number += 1
                found = [m.vocab.pairs(t) if t else np.empty(0, np.int64) for t in rows["text"]]
                sizes = np.array([len(x) for x in found])
                pairs = np.concatenate(found)
                doc = np.repeat(np.arange(len(rows)) * 2 + rows["target"].to_numpy(bool), sizes)
                at = np.minimum(np.searchsorted(m.hot, pairs), max(len(m.hot) - 1, 0))
                hot = m.hot[at] == pairs if len(m.hot) else np.zeros(len(pairs), bool)
                (p, d), times = np.unique(np.stack([at[hot], doc[hot]]), axis=1, return_counts=True)
                sums = m.sums(m.hot[p], times, d % 2 == 1, tuple(c[p] for c in m.counts))
                local = [np.bincount(d // 2, x, len(rows)) for x in sums]
                yield pd.DataFrame([(-1 - (first | number), first | number, None, None, [None if i is None or i != i else str(i) for i in rows["id"]], np.maximum(sizes - 1, 0), *local)], columns=[c.split()[0] for c in DEALT.split(", ")])
                pairs, doc = pairs[~hot], doc[~hot].astype(np.uint16)
                part = (mix(pairs.view(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
                order = np.lexsort((doc, pairs, part))
                part, pairs, doc = part[order], pairs[order], doc[order]
                cuts = np.flatnonzero(np.diff(part)) + 1
                bounds = [0, *cuts.tolist(), len(part)] if len(part) else [0]
                out = [(int(part[a]), first | number, doc[a:b].tobytes(), planes(pairs[a:b]), None, None, None, None) for a, b in zip(bounds, bounds[1:], strict=False)]
                for i in range(0, len(out), 4096):
                    yield pd.DataFrame(out[i : i + 4096], columns=[c.split()[0] for c in DEALT.split(", ")])

    return docs.select(F.col("id").cast("string").alias("id"), "text", "target").mapInPandas(run, DEALT)


def lost(rows: DataFrame, models) -> DataFrame:
    """The sums of losses of each batch's documents over the pairs that a task has; other rows as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = models.value
        docs, pairs, of, number = [], [], [], {}
        for frame in batches:
            meta = frame["part"] < 0
            if meta.any():
                yield frame[meta].assign(sums=None)[[c.split()[0] for c in SUMMED.split(", ")]]
            for b, d, p in zip(frame["batch"][~meta], frame["doc"][~meta], frame["pair"][~meta], strict=True):
                docs.append(np.frombuffer(d, np.uint16))
                pairs.append(unplaned(p, np.int64))
                of.append(np.full(len(docs[-1]), number.setdefault(b, len(number)), np.int32))
        if not docs:
            return
        batch = list(number)
        d = (np.concatenate(of).astype(np.int64) << 16) | np.concatenate(docs)
        p = np.concatenate(pairs)
        del docs, pairs, of
        order = np.lexsort((d, p))
        p, d = p[order], d[order]
        new = np.concatenate([[True], p[1:] != p[:-1]])
        group = np.cumsum(new) - 1
        mine = (d & 1).astype(bool)
        own = np.bincount(group, mine).astype(np.int64)
        every = np.bincount(group)
        each = np.flatnonzero(new | np.concatenate([[True], d[1:] != d[:-1]]))  # one entry a pair and document
        times = np.diff(np.append(each, len(p)))
        g = group[each]
        sums = m.sums(p[each], times, mine[each], (own[g], (every - own)[g]))
        at, where = np.unique(d[each], return_inverse=True)
        total = np.stack([np.bincount(where, x, len(at)) for x in sums], axis=1)
        cuts = np.flatnonzero(np.diff(at >> 16)) + 1
        bounds = [0, *cuts.tolist(), len(at)]
        for i in range(0, len(bounds) - 1, 1024):
            rows = [(batch[int(at[a] >> 16)], (at[a:b] & 0xFFFF).astype(np.uint16).tobytes(), planes(total[a:b]), None, None, None, None) for a, b in zip(bounds[i : i + 1024], bounds[i + 1 : i + 1025], strict=False)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMED.split(", ")])

    return rows.mapInPandas(run, SUMMED)


def gathered(rows: DataFrame) -> DataFrame:
    """id, n_words, loss_target, loss_background of each document, of its batch's sums: a batch after the other."""
    columns = ["id", "n_words", "loss_target", "loss_background"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total, meta = None, None, None

        def close() -> pd.DataFrame:
            n = meta.n_words
            sums = total[: len(n)] + np.stack([meta.loss_target, meta.loss_background], axis=1)
            mean = np.where(n[:, None] > 0, sums / (n[:, None] + 1), np.nan)
            out = pd.DataFrame({"id": list(meta.ids), "n_words": n})
            return out.assign(**{c: pd.Series(mean[:, i], dtype="Float64").mask(n == 0) for i, c in enumerate(columns[2:])})

        for frame in batches:
            for r in frame.itertuples():
                if r.batch != now:
                    if now is not None:
                        yield close()
                    now, total, meta = r.batch, np.zeros((1 << 14, 2)), None
                if r.doc is None:
                    meta = r
                else:
                    total[np.frombuffer(r.doc, np.uint16) // 2] += unplaned(r.sums, np.float64).reshape(-1, 2)
        if now is not None:
            yield close()

    return rows.mapInPandas(run, "id string, n_words long, loss_target double, loss_background double")


def score_documents(docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, loss_target, loss_background, score = loss_target - loss_background (means over the words and the end); one row a document.

    targets lists the ids of the documents that the target model learns from;
    the background model learns from all others.  A side without documents is uniform.  A null text or one without words has 0
    words and null losses.  Rows that share an id are documents of their own,
    and repeated rows count as often as they occur.  An empty table gives an
    empty one; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = all_marked(docs, targets, id_col, text_col, target_id, scratch)
    models, n = train(rows, scratch)
    shared = spark.sparkContext.broadcast(models)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / TASK_WORDS))
    pairs = dealt(rows, shared, 8 * tasks).repartition(tasks, "part")
    sums = lost(pairs, shared).repartition(tasks, "batch").sortWithinPartitions("batch")
    out = gathered(sums).select(F.col("id").cast(docs.schema[id_col].dataType).alias("doc_id"), "n_words", "loss_target", "loss_background")
    return out.withColumn("score", F.col("loss_target") - F.col("loss_background"))


def good_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents labelled as good and not toxic."""
    return documents(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses rounded to 9 places, as sums of logarithms depend on their order in the last."""
    out = score_documents(documents(spark, sf_dir), good_documents(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in ("loss_target", "loss_background", "score")})


#: ' ' is the end of a text, '  ' the class of words that are not frequent, chr(9) the start.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id IS NOT NULL) AS t,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
u AS (SELECT doc_id, t, unnest(list_append(w, ' ')) AS w, generate_subscripts(list_append(w, ' '), 1) AS i FROM d WHERE len(w) > 0),
c AS (SELECT w, count(*)::DOUBLE AS n, (count(*) FILTER (t))::DOUBLE AS nt FROM u GROUP BY w),
f AS (SELECT *, w = ' ' OR n >= greatest(1, 1e-5::DOUBLE * (SELECT sum(n) FROM c WHERE w <> ' ')) AS frequent FROM c),
s AS (
  SELECT sum(nt) AS nt, sum(n - nt) AS nb, count(*)::DOUBLE AS size, (count(*) FILTER (NOT frequent))::DOUBLE AS others,
         coalesce(sum(nt) FILTER (NOT frequent), 0) AS ot, coalesce(sum(n - nt) FILTER (NOT frequent), 0) AS ob FROM f),
g AS (
  SELECT *, CASE WHEN nt > 0 THEN CASE WHEN least(nt, nb) > 0 THEN least(nt, nb) ELSE greatest(nt, nb) END / nt ELSE 1 END AS gt,
         CASE WHEN nb > 0 THEN CASE WHEN least(nt, nb) > 0 THEN least(nt, nb) ELSE greatest(nt, nb) END / nb ELSE 1 END AS gb FROM s),
l AS (
  SELECT w, frequent, CASE WHEN frequent THEN (f.nt * gt + 1) / (g.nt * gt + size) ELSE (ot * gt + others) / (g.nt * gt + size) / others END AS lt,
         CASE WHEN frequent THEN ((f.n - f.nt) * gb + 1) / (g.nb * gb + size) ELSE (ob * gb + others) / (g.nb * gb + size) / others END AS lb FROM f, g),
p AS (SELECT doc_id, t, w, coalesce(lag(CASE WHEN frequent THEN w ELSE '  ' END) OVER (PARTITION BY doc_id ORDER BY i), chr(9)) AS h FROM u JOIN l USING (w)),
m AS (SELECT doc_id, t, h, w, count(*)::DOUBLE AS m FROM p GROUP BY ALL),
k AS (SELECT h, w, coalesce(sum(m) FILTER (t), 0) AS kt, coalesce(sum(m) FILTER (NOT t), 0) AS kb FROM m GROUP BY h, w),
z AS (SELECT h, sum(kt) AS ht, sum(kb) AS hb FROM k GROUP BY h),
x AS (
  SELECT doc_id, m,
         -ln((gt * (kt - CASE WHEN t THEN m ELSE 0 END) + lt) / (gt * (ht - CASE WHEN t THEN m ELSE 0 END) + 1)) AS a,
         -ln((gb * (kb - CASE WHEN t THEN 0 ELSE m END) + lb) / (gb * (hb - CASE WHEN t THEN 0 ELSE m END) + 1)) AS b
  FROM m JOIN k USING (h, w) JOIN z USING (h) JOIN l USING (w), g),
y AS (SELECT doc_id, sum(m * a) / sum(m) AS a, sum(m * b) / sum(m) AS b FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(a, 9) AS loss_target, round(b, 9) AS loss_background, round(a - b, 9) AS score
FROM d LEFT JOIN y USING (doc_id)
"""
