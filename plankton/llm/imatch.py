"""I-Match fingerprints over randomised lexicon subsets.

A document is reduced to its distinct terms whose inverse document frequency
lies in a band, and for each of several random subsets of that lexicon the
sorted terms that fall in the subset are hashed.  Two texts agree in a subset
if they hold the same lexicon terms there.

There is one family of subsets for all texts: on level L the lexicon is dealt
at random into SUBSETS * 4**L cells, and the first SUBSETS cells are the
level's subsets.  So a fingerprint has the same places whatever the size of the
text, and a place can be looked up.  Dense levels tell short texts apart and
sparse levels compare long ones, of whose terms they see a sample.  The likeness
of two fingerprints is the number of subsets in which both have the same terms,
out of those in which either has any, on the sparsest level where that is half
of the subsets at least (else on level 0).  One more hash covers all lexicon
terms: it tells long texts apart whose subsets agree and has no part in likeness.

All of it is DataFrame operations on the executors.  Document frequencies cover
every document.  The lexicon is one row, dealt into short lists by hash, and
reaches the tasks as the value of a scalar subquery: a term in the band occurs
in at least exp(-max idf) of all documents, so there are at most (mean distinct
terms of a document) * exp(max idf) of them, however many documents there are.
The next document of each is found on ids alone, in ranges of ids that exchange
only their first rows; texts are dealt out once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents

#: Terms found in at most a tenth and at least one in 200 of all documents.
IDF_BAND = (math.log(10), math.log(200))
SUBSETS = 16
LEVELS = 6
#: Ids of one range of neighbours, about.
RANGE_ROWS = 1 << 17


def term_ids(text: Column) -> Column:
    """Distinct terms (lower-cased runs of letters and digits) as 64-bit ids; empty for null."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def lexicon(docs: DataFrame, scratch: Scratch, idf_band: tuple[float, float] = IDF_BAND, text_col: str = "text") -> tuple[DataFrame, int]:
    """One row with the terms in the band, an array of short arrays where a term is in that of its number modulo their count; and that count."""
    n = docs.count()
    low, high = n * math.exp(-idf_band[1]), n * math.exp(-idf_band[0])
    df = docs.select(F.explode(term_ids(F.col(text_col))).alias("term")).groupBy("term").count()
    terms = scratch.keep(df.where(F.col("count").between(low, high)).select("term"), "lexicon")
    size = 2 * terms.count() + 1
    lists = docs.sparkSession.range(size).join(terms.groupBy(F.pmod("term", F.lit(size)).alias("id")).agg(F.collect_list("term").alias("terms")), "id", "left")
    one = lists.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms")))).alias("x"))
    return scratch.keep(one.select(F.col("x.terms").alias("lists")), "lists"), size


def _cells(terms: Column) -> Column:
    """The terms of each of the first SUBSETS cells, of terms that all lie in one of them or of level 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda s: F.filter(terms, lambda h: h.bitwiseAND(F.lit(SUBSETS - 1).cast("long")) == s))


def _first_cells(mask: int):
    return lambda h: h.bitwiseAND(F.lit(mask).cast("long")) < SUBSETS


def with_fingerprint(df: DataFrame, text: Column, lexicon: tuple[DataFrame, int], name: str) -> DataFrame:
    """Adds the struct `name`: parts (a hash for each subset, level by level up to the last that has a term; null for an empty subset), text (the same as text) and whole (a hash of all lexicon terms, null without any).

    A text without lexicon terms has no parts and an empty fingerprint.
    """
    lists, size = lexicon
    # Named before it is used, as a subquery may not stand inside a lambda; the optimizer puts its value there.
    df = df.withColumn("_t", term_ids(text)).withColumn("_lists", lists.scalar())
    df = df.withColumn("_k0", F.sort_array(F.filter("_t", lambda h: F.array_contains(F.element_at("_lists", (F.pmod(h, F.lit(size)) + 1).cast("int")), h)))).drop("_lists")
    parts = F.array().cast("array<int>")
    for level in range(LEVELS):
        own = F.col(f"_k{level}")
        hashes = F.transform(_cells(own), lambda x: F.when(F.size(x) > 0, F.shiftrightunsigned(F.xxhash64(x), 48).cast("int")))
        parts = F.concat(parts, F.when(F.size(own) > 0, hashes).otherwise(F.array().cast("array<int>")))
        if level + 1 < LEVELS:
            mask = SUBSETS * 4 ** (level + 1) - 1
            df = df.withColumn(f"_k{level + 1}", F.filter(own, _first_cells(mask)))
    df = df.withColumn("_p", parts)
    shown = F.transform("_p", lambda p: F.coalesce(F.lpad(F.lower(F.hex(p)), 4, "0"), F.lit("----")))
    whole = F.when(F.size("_k0") > 0, F.xxhash64("_k0"))
    return df.withColumn(name, F.struct(F.col("_p").alias("parts"), F.array_join(shown, "").alias("text"), whole.alias("whole"))).drop("_t", "_p", *[f"_k{i}" for i in range(LEVELS)])


def with_likeness(df: DataFrame, a: Column, b: Column, name: str) -> DataFrame:
    """Adds a number from 0 to 1; 1 for equal fingerprints, those of texts without lexicon terms among them."""
    long = F.greatest(F.size(a["parts"]), F.size(b["parts"]))
    for level in range(LEVELS):
        x, y = (F.slice(f["parts"], level * SUBSETS + 1, SUBSETS) for f in (a, b))
        # One number a level: subsets that either has, and 100 for each in which both are the same.
        seen = F.zip_with(x, y, lambda p, q: F.when(p.isNotNull() | q.isNotNull(), F.when(p == q, 101).otherwise(1)).otherwise(0))
        df = df.withColumn(f"_n{level}", F.when(long > level * SUBSETS, F.aggregate(seen, F.lit(0), lambda total, one: total + one)).otherwise(0))
    value = F.lit(0.0)
    for level in range(LEVELS):
        n = F.col(f"_n{level}")
        share = F.floor(n / 100) / F.greatest(n % 100, F.lit(1))
        value = share if level == 0 else F.when(n % 100 >= SUBSETS // 2, share).otherwise(value)
    return df.withColumn(name, F.when(a["text"] == b["text"], 1.0).otherwise(value)).drop(*[f"_n{i}" for i in range(LEVELS)])


def followers(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, tie, next_id, next_tie: the document that follows each by id (nulls first), then by a hash of its text; after the last comes the first.

    docs: doc_id, tie and what depends on them.  Rows with one id and one text are one document.
    """
    rows = scratch.keep(docs.distinct(), "ids")
    n = rows.count()
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = rows.repartitionByRange(max(1, math.ceil(n / RANGE_ROWS)), *order)
    ranged = scratch.keep(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    everywhere = Window.orderBy("part")  # one row a range
    firsts = firsts.select(F.col("part").alias("of"), F.coalesce(F.lead("first").over(everywhere), F.first("first").over(everywhere)).alias("first"))
    after = ranged.withColumn("next", F.lead(F.struct("doc_id", "tie")).over(Window.partitionBy("part").orderBy(*order)))
    after = after.join(firsts, F.col("part") == F.col("of")).withColumn("next", F.coalesce("next", "first"))
    return after.select(*docs.columns, F.col("next.doc_id").alias("next_id"), F.col("next.tie").alias("next_tie"))


def fingerprint_edits(docs: DataFrame, *, idf_band: tuple[float, float] = IDF_BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, whole, edited_whole; one row a document.

    The edited text is the text with its last quarter (floor of code points
    / 4) replaced by as many code points from the start of the next document
    by ascending id; after the last comes the first.  A null text counts as
    empty.  Null ids come before all others, rows with one id follow each other
    by a hash of their text, and those with one text as well are one document.
    An empty table gives an empty one; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "imatch")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    terms = lexicon(docs, scratch, idf_band, "text")
    tie = F.xxhash64("text")
    quarter = F.floor(F.length("text") / 4).cast("int")
    # Whole texts are dealt out once, by hashes of id and text; both joins read that.
    rows = docs.withColumn("tie", tie).withColumn("at", F.xxhash64("doc_id")).repartition("at", "tie")
    after = followers(docs.select("doc_id", tie.alias("tie"), quarter.alias("quarter")), scratch)
    after = after.select(F.xxhash64("doc_id").alias("of"), F.col("tie").alias("of_tie"), "quarter", F.xxhash64("next_id").alias("next_at"), "next_tie")
    heads = rows.join(scratch.keep(after, "after"), (F.col("at") == F.col("next_at")) & (F.col("tie") == F.col("next_tie")))
    # next_id is kept so that both sides read the same columns, and so the same exchange.
    heads = heads.select("of", "of_tie", F.col("doc_id").alias("next_id"), "quarter", "next_at", "next_tie", F.substr("text", F.lit(1), F.col("quarter")).alias("head")).dropDuplicates(["of", "of_tie"])
    both = rows.join(heads, (F.col("at") == F.col("of")) & (F.col("tie") == F.col("of_tie")))
    n = F.length("text")
    both = both.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - F.col("quarter")), F.col("head")))
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = with_fingerprint(with_fingerprint(both, F.col("text"), terms, "own"), F.col("edited"), terms, "changed")
    both = with_likeness(both, F.col("own"), F.col("changed"), "near_edited")
    both = both.select("doc_id", "next_id", "at", "tie", "next_at", "next_tie", "n_chars", "edited_sha256", "own", F.col("changed.text").alias("edited_fingerprint"), F.col("changed.whole").alias("edited_whole"), "near_edited")
    # Fingerprints of neighbours meet without their texts.
    both = scratch.keep(both, "fingerprints")
    following = both.select(F.col("at").alias("f_at"), F.col("tie").alias("f_tie"), F.col("own").alias("next")).dropDuplicates(["f_at", "f_tie"])
    both = with_likeness(both.join(following, (F.col("next_at") == F.col("f_at")) & (F.col("next_tie") == F.col("f_tie"))), F.col("own"), F.col("next"), "near_next")
    return both.select("doc_id", "n_chars", "edited_sha256", F.col("own.text").alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", F.col("own.whole").alias("whole"), "edited_whole")


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
