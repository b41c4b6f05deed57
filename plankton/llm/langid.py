"""Language identification by rank-order profiles (Cavnar and Trenkle).

A profile is the list of the most frequent letter n-grams in order.  A document
gets the language whose profile its own n-grams are least out of place in.

N-grams are runs of 1 to 3 characters of a lower-cased text in which every run
of other characters than letters has become one separator; those with the
separator in the middle or alone do not count.  An n-gram is one 63-bit number,
21 bits a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fresh, small_batches

#: N-grams of a profile, of a language as of a document.
PROFILE = 300
#: Separator; no letter has this code.
GAP = 1
_LETTERS: list = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and their counts; empty without letters."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(letters()[c], c, GAP)
    c = np.concatenate([[GAP], c, [GAP]])
    c = c[np.concatenate([[True], (c[1:] != GAP) | (c[:-1] != GAP)])]
    one = c[c != GAP]
    two = (c[:-1] << 21) | c[1:]
    three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[c[1:-1] != GAP]
    return np.unique(np.concatenate([one, two if len(one) else two[:0], three]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent n-grams in order; of equally frequent ones the smaller number first."""
    return grams[np.argsort(-counts, kind="stable")[:n]]


def learn(docs: DataFrame, *, size: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Language -> its profile, of all rows with a language.

    Counts cover every text; they are summed within each task before they are
    shuffled by language and n-gram.  Only the profiles, `size` numbers for
    each language, come to the driver.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        waiting = 0

        def out(lang: str) -> pd.DataFrame:
            grams, counts = (np.concatenate(x) for x in zip(*held[lang], strict=True))
            g, where = np.unique(grams, return_inverse=True)
            held[lang] = [(g, np.bincount(where, counts, len(g)).astype(np.int64))]
            return pd.DataFrame({"lang": lang, "gram": held[lang][0][0], "n": held[lang][0][1]})

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                held.setdefault(lang, []).append(x := ngrams(text))
                waiting += len(x[0])
                if waiting > 1 << 20:
                    for k in held:
                        out(k)
                    waiting = 0
            if sum(len(x[0]) for v in held.values() for x in v) > 1 << 22:
                for k in list(held):
                    yield out(k)
                held, waiting = {}, 0
        for k in list(held):
            yield out(k)

    counts = docs.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Ranks:
    """Profiles as one sorted list of n-grams with the rank of each in every language (size: not in it)."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size, self.langs = size, sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), 2 * size, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, profiles[lang])] = np.arange(len(profiles[lang]))

    def best(self, text: str | None) -> tuple[str, float]:
        """The nearest language, of equally near ones the first by code point, and 1 - distance / greatest distance."""
        own = ranked(*ngrams(text), self.size)
        if not len(own) or not len(self.grams):
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        away = np.minimum(np.abs(self.ranks[:, at] - np.arange(len(own))), self.size).sum(axis=1)
        i = int(away.argmin())
        return self.langs[i], 1 - float(away[i]) / (self.size * len(own))


def predictor(profiles: dict[str, list[int]], size: int = PROFILE):
    """A function of a text column that gives a struct of lang_pred and score."""
    ranks = Ranks(profiles, size)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ranks.best(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row a document.

    Profiles are learned from rows with a language that are not held out.  A
    text that is null or has no letter is `und` with score 0, and so is any if
    there is nothing to learn from.  Repeated rows count as often as they
    occur.  An empty table gives an empty one; other columns are not read.
    """
    predict = predictor(learn(docs.where(~held_out(F.col(id_col))), text_col=text_col, lang_col=lang_col))
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predict(F.col(text_col)).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, *, min_score: float = 0.1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with all columns, whose language is found with a score of at least min_score."""
    predict = predictor(learn(docs.where(~held_out(F.col(id_col))), text_col=text_col, lang_col=lang_col))
    p = fresh(docs, "p")
    out = docs.withColumn(p, predict(F.col(text_col)))
    return out.where((F.col(f"{p}.lang_pred") != "und") & (F.col(f"{p}.score") >= min_score)).drop(p)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, text,
         list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> CAST(k AS INTEGER)) & 1))),
                     lambda crc, bit: xor(crc >> 1, CASE WHEN xor(crc, bit) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295) AS crc FROM documents),
t AS (
  SELECT doc_id, lang, xor(crc, 4294967295) % 4 = 2 AS held_out,
         regexp_extract_all(regexp_replace(chr(1) || regexp_replace(lower(coalesce(text, '')), '[^\p{L}]', chr(1), 'g') || chr(1), '\x01+', chr(1), 'g'), '(?s).') AS c FROM d),
i AS (SELECT doc_id, lang, held_out, c, unnest(range(1, len(c) + 1)) AS i FROM t),
g AS (
  SELECT doc_id, lang, held_out, c[i] AS g FROM i WHERE c[i] <> chr(1)
  UNION ALL SELECT doc_id, lang, held_out, c[i] || c[i + 1] FROM i WHERE i + 1 <= len(c)
  UNION ALL SELECT doc_id, lang, held_out, c[i] || c[i + 1] || c[i + 2] FROM i WHERE i + 2 <= len(c) AND c[i + 1] <> chr(1)),
n AS (SELECT doc_id, lang, held_out, g, count(*) AS n FROM g GROUP BY ALL),
o AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS r FROM n QUALIFY r < 300),
p AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY s DESC, length(g), g) - 1 AS r
  FROM (SELECT lang, g, sum(n) AS s FROM n WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, g) QUALIFY r < 300),
a AS (
  SELECT o.doc_id, l.lang, sum(least(300, abs(coalesce(p.r, 600) - o.r))) AS away, count(*) AS size
  FROM o CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.g = o.g GROUP BY ALL),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY away, lang) = 1)
SELECT t.doc_id, t.held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1 - away::DOUBLE / (300 * size), 0) AS score
FROM t LEFT JOIN b USING (doc_id)
"""
