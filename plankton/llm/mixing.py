"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis).

Every document draws the exponential key -ln(u) / w, where u comes from a hash
of its id and w is its quality weight; taking documents in ascending key order
is then a weighted sample without replacement.  A source with target t and size
s contributes t // s complete epochs, and the rest of its target from the
documents with the smallest keys, up to the prefix sum nearest to that rest.

Everything is DataFrame operations.  No source is ever sorted as a whole.  The
cut point of each source is found by range counting: the keys of the interval
that holds it are summed in RANGES equal ranges, summed up in each task before
they are shuffled, and the range that holds it becomes the interval, until no
source has more than FEW documents in its own.  Only these are ordered one by
one.  So what a task ranks has the same bound whatever the weights and however
large a source is.  Documents that share a key, as those with one id do, are
told apart by a hash of their text in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Ranges in which the keys of an interval are summed, and the documents of a source that may be ranked one by one.
RANGES, FEW = 1024, 4096
#: The least weight of a document.
LEAST_WEIGHT = 0.05


def quality_weight(text: Column) -> Column:
    """Share of letters and white space among a text's characters, at least 0.05; 1 for an empty or null text."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\x09-\x0D\x20]", ""))
    n = F.length(text)
    return F.greatest(F.when(n > 0, kept / n).otherwise(F.lit(1.0)), F.lit(LEAST_WEIGHT))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that follows from the key and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)


def keyed(id_col: str, text_col: str, weight_col: str | None, seed: str) -> dict[str, Column]:
    """The columns that the sample needs of every document."""
    if weight_col is None:
        weight = quality_weight(F.col(text_col))
    else:
        w = F.col(weight_col).cast("double")
        weight = F.when(w.isNull() | F.isnan(w), F.lit(LEAST_WEIGHT)).otherwise(F.greatest(w, F.lit(LEAST_WEIGHT)))
    return {"mix_size": word_count(F.col(text_col)), "mix_key": -F.log(uniform(F.col(id_col), seed)) / weight, "mix_tie": F.shiftrightunsigned(F.xxhash64(text_col), 11).cast("double")}


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """sizes: source, source_size and more.  Adds `target`.

    All targets together are the size of everything; a target stops at
    max_epochs times its source's size and the excess is dealt again by weight.
    That ends at a level L with target = least(weight * L, cap), found by
    prefix sums over the sources in order of cap / weight.  One row a source:
    a single task holds them, as it holds any list of sources.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    everything = Window.partitionBy()
    w = sizes.withColumn("rank", F.row_number().over(in_order))
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1))
    w = w.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    w = w.withColumn("total", F.sum("source_size").over(everything))
    w = w.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = w.withColumn("after", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("level", (F.col("total") - F.col("before")) / F.col("after"))
    w = w.withColumn("free", F.col("ratio") > F.col("level"))
    w = w.withColumn("level", F.min(F.when(F.col("free"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    target = F.when(F.col("free"), F.col("weight") * F.col("level")).otherwise(F.col("cap").cast("double"))
    return w.withColumn("target", target).drop("rank", "weight", "cap", "ratio", "total", "before", "after", "level", "free")


def narrowed(base: DataFrame, cuts: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """cuts with a narrower interval [lo, hi] of `column` for each source, of at most FEW rows or one value.

    base: source, mix_size and the column.  cuts: s (the source), rest (what is
    left to take), lo, hi, n (rows in the interval), start (the size of all rows
    before it) and more.  The row at which the sizes reach `rest` stays inside.
    """
    open_ = (F.col("n") > FEW) & (F.col("lo") < F.col("hi")) & (F.col("rest") > 0)
    while cuts.where(open_).limit(1).count():
        c = cuts.where(open_).select("s", "rest", "lo", "hi", "start")
        step = (F.col("hi") - F.col("lo")) / RANGES
        inside = base.join(c, base["source"].eqNullSafe(c["s"]) & base[column].between(c["lo"], c["hi"]))
        at = F.least(F.floor((F.col(column) - F.col("lo")) / step), F.lit(RANGES - 1))
        sums = inside.groupBy("source", at.alias("at")).agg(F.sum("mix_size").alias("sum"), F.count(F.lit(1)).alias("m"), F.min(column).alias("low"), F.max(column).alias("high"), F.first("rest").alias("goal"), F.first("start").alias("begin"))
        so_far = Window.partitionBy("source").orderBy("at")  # at most RANGES rows a source
        sums = sums.withColumn("before", F.col("begin") + F.sum("sum").over(so_far) - F.col("sum"))
        # The last range that begins before the goal; what follows it is not taken, what precedes it is.
        edge = sums.where("before < goal").groupBy("source").agg(F.max_by(F.struct("low", "high", "m", "before"), "at").alias("edge"))
        edge = edge.select(F.col("source").alias("e"), "edge")
        new = cuts.join(edge, cuts["s"].eqNullSafe(edge["e"]), "left")
        narrow = F.col("edge").isNotNull()
        parts = {"lo": "low", "hi": "high", "n": "m", "start": "before"}
        new = new.select(*[(F.when(narrow, F.col("edge")[parts[x]]).otherwise(F.col(x)).alias(x) if x in parts else F.col(x)) for x in cuts.columns])
        cuts = scratch.keep(new, "cuts")
    return cuts


def cut_points(base: DataFrame, scratch: Scratch, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """One row a source: mix_source, source_size, target, epochs, and the last key and tie of the fractional epoch (null: none).

    base: source, mix_size, mix_key, mix_tie; one row a document.
    """
    sizes = base.groupBy("source").agg(F.sum("mix_size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.min("mix_key").alias("lo"), F.max("mix_key").alias("hi"))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long")
    cuts = source_targets(sizes, weights, max_epochs).withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    cuts = scratch.keep(cuts.withColumnRenamed("source", "s").withColumn("start", F.lit(0).cast("long")), "cuts")
    cuts = narrowed(base, cuts, "mix_key", scratch).withColumnsRenamed({"lo": "key_lo", "hi": "key_hi"})
    # Where many rows share the one key that is left, the same with their ties.
    shared = (F.col("key_lo") == F.col("key_hi")) & (F.col("n") > FEW) & (F.col("rest") > 0)
    cuts = cuts.withColumn("lo", F.lit(0.0)).withColumn("hi", F.lit(2.0**53)).withColumn("n", F.when(shared, F.col("n")).otherwise(F.lit(0).cast("long")))
    at_key = cuts.where(shared).select(F.col("s").alias("k"), "key_lo")
    ties = base.join(at_key, base["source"].eqNullSafe(at_key["k"]) & (base["mix_key"] == at_key["key_lo"])).select("source", "mix_size", "mix_tie")
    cuts = scratch.keep(narrowed(ties, cuts, "mix_tie", scratch), "cuts")
    # What is left is summed by key and tie, so that rows that repeat an id and a text are one.
    c = cuts.where("rest > 0").select("s", "rest", "start", "key_lo", "key_hi", "lo", "hi")
    inside = base.join(c, base["source"].eqNullSafe(c["s"]) & base["mix_key"].between(c["key_lo"], c["key_hi"]) & base["mix_tie"].between(c["lo"], c["hi"]))
    rows = inside.groupBy("source", "mix_key", "mix_tie").agg(F.sum("mix_size").alias("size"), F.first("rest").alias("rest"), F.first("start").alias("start"))
    by_key = Window.partitionBy("source").orderBy("mix_key", "mix_tie")
    before = F.sum("size").over(by_key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.col("start")
    chosen = rows.withColumn("before", before).where(F.col("before") + F.col("size") / 2 < F.col("rest"))
    last = chosen.groupBy("source").agg(F.max(F.struct("mix_key", "mix_tie")).alias("last")).select(F.col("source").alias("l"), "last")
    # Where the interval gives none, all before it is taken still: the last is the one before its first.
    out = cuts.join(last, cuts["s"].eqNullSafe(last["l"]), "left")
    return scratch.keep(out.select(F.col("s").alias("mix_source"), "source_size", "target", "epochs", "rest", "start", F.col("key_lo").alias("edge_key"), F.col("lo").alias("edge_tie"), "last"), "ends")


def copies_of() -> Column:
    """Times that the mix takes a document, of its own key and its source's cut point."""
    own = F.struct("mix_key", "mix_tie")
    edge = F.struct(F.col("edge_key").alias("mix_key"), F.col("edge_tie").alias("mix_tie"))
    drawn = (F.col("rest") > 0) & F.when(F.col("last").isNotNull(), own <= F.col("last")).otherwise(own < edge)
    return F.col("epochs") + F.when(F.coalesce(drawn, F.lit(False)), 1).otherwise(0)


def mix_plan(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken; one row a document.

    weight_col: quality weights (a score, an importance weight), of which null,
    NaN and what is below LEAST_WEIGHT count as that; without it the weight is
    quality_weight(text).  Null texts have size 0 and are taken 0 words; null
    sources are one source, the last in order; an empty table gives an empty
    one; rows that repeat an id, a text and a source are drawn together.  Other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    base = docs.select(F.col(id_col).alias("mix_id"), F.col(source_col).alias("source"), *[c.alias(n) for n, c in keyed(id_col, text_col, weight_col, seed).items()])
    base = scratch.keep(base, "sizes")
    cuts = cut_points(base, scratch, weights, max_epochs)
    out = base.join(cuts, base["source"].eqNullSafe(cuts["mix_source"])).withColumn("copies", copies_of())
    return out.select(F.col("mix_id").alias("doc_id"), F.col("mix_size").alias("size"), "source_size", "target", "copies", (F.col("mix_size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """The mixed documents themselves: every row of docs, with all its columns, as often as the mix takes it.

    Only ids, sizes and keys are gathered; texts stay where they were read,
    next to their source's cut point.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    columns = docs.columns
    keys = keyed(id_col, text_col, weight_col, seed)
    base = docs.select(F.col(source_col).alias("source"), *[c.alias(n) for n, c in keys.items()])
    cuts = cut_points(scratch.keep(base, "sizes"), scratch, weights, max_epochs)
    names = {c: f"x{i}" for i, c in enumerate(columns)}
    held = docs.select(F.struct(*[F.col(f"`{c}`").alias(names[c]) for c in columns]).alias("held"), F.col(source_col).alias("source"), *[c.alias(n) for n, c in keys.items()])
    mixed = held.join(cuts, held["source"].eqNullSafe(cuts["mix_source"])).withColumn("copies", copies_of())
    mixed = mixed.select("held", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return mixed.select(*[F.col(f"held.{names[c]}").alias(c) for c in columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         greatest(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{L}\x09-\x0D\x20]', '', 'g')) / length(text)::DOUBLE ELSE 1.0 END, 0.05) AS w,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
p AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3 * source_size AS cap FROM s),
o AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM p),
t AS (
  SELECT source, source_size, CASE WHEN cap / weight > level THEN weight * (SELECT arg_min(level, cap / weight) FROM o WHERE cap / weight > level) ELSE CAST(cap AS DOUBLE) END AS target FROM o),
k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(least(t.target / t.source_size, 3)) AS BIGINT) ELSE 0 END AS epochs,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.w, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN before + size / 2.0::DOUBLE < target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM k
"""
