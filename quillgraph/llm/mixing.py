"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key.  Keys are uniform, so fixed key ranges
("bins") cut each source into ranges of about equal size without sampling, and a
source that holds a third of all rows is spread over thousands of them.  Prefix
sums are taken in two levels: bin totals are summed over a source's bins, then
documents are summed inside their bin.  With about ``2 * sqrt(rows)`` bins a
source, no task of either level reads more than the square root of the input.

Defined results: null text has size 0; a null source is a source of its own, last
in order; rows that repeat (same id and text) share the order by size and are
interchangeable; an empty table gives an empty result; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm import common

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 42


def hash_key(doc_id: Column, seed: int = SEED) -> Column:
    """A 60-bit key that looks random and is the same in every run and engine."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source_key, source_size) -> the same with ``target``.

    Sources share the sum of all sizes by weight; what is above ``cap`` times a
    source's size is shared again among the rest.  That water level is found in
    closed form: with sources in order of cap / weight, a source is capped exactly
    if its ratio is below the level that the sources from it on would get.  One
    row a source goes through these windows, never documents.
    """
    order = Window.orderBy("source_key")
    ratio = Window.orderBy("ratio", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    index = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), index + 1)
    out = sizes.withColumn("weight", w.cast("double")).withColumn("most", (cap * F.col("source_size")).cast("double"))
    out = out.withColumn("ratio", F.col("most") / F.col("weight"))
    out = out.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(ratio), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ratio), F.lit(0.0))))
    water = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every)
    out = out.withColumn("water", water)
    return out.withColumn("target", F.when(F.col("ratio") < F.coalesce("water", F.col("ratio") + 1), F.col("most")).otherwise(F.col("weight") * F.col("water"))).select("source_key", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: id, source, size, source_size, target, epochs (whole passes), taken (words).

    In hash order, a source gives whole passes over all its documents and then a
    part of one more pass that ends at its budget exactly; the document at the cut
    gives its first words only.
    """
    spark = docs.sparkSession
    source = F.col(source_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string"))).alias("source_key"),
        F.size(common.words_of(F.col(text_col))).cast("long").alias("size"),
        common.row_key(id_col, text_col).alias("row_key"),
    )
    sized = common.written(sized, "mix-sizes")
    bins = max(1, math.ceil(2 * math.sqrt(sized.count())))
    sized = sized.withColumn("key", hash_key(F.col("doc_id"), seed))
    sized = sized.withColumn("bin", F.least(F.floor(F.col("key") / F.lit(float(1 << 60)) * bins), F.lit(bins - 1)).cast("int"))
    binned = common.written(sized.groupBy("source_key", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    goal = targets(binned.groupBy("source_key").agg(F.sum("bin_size").alias("source_size")), weights, cap)
    before = Window.partitionBy("source_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        binned.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
        .withColumn("source_size", F.sum("bin_size").over(Window.partitionBy("source_key")))
        .join(goal, "source_key")
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
    )
    inside = Window.partitionBy("source_key", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("bin_start") + F.col("within")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(rest - offset, F.col("size")))
    return (
        sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(ranges, ["source_key", "bin"])
        .select("doc_id", F.when(F.col("source_key") != "1", F.substring("source_key", 2, 1 << 30)).alias("source"), "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "row_key")
    )


def mixed_texts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as a corpus: each different row of ``docs`` that it takes, with all its columns and how the text goes in.

    ``epochs`` is how often the whole text is taken and ``rest`` the first words, one space
    between them, of the pass that the budget cuts (empty if it takes all or nothing of
    that pass; a pass that takes the whole text counts as one of ``epochs``).  ``size``,
    ``source_size``, ``target`` and ``taken`` are those of ``mix``.  Rows that repeat are
    one row here, with the most that any of them gives.  A clashing column name is refused.
    """
    made = ["size", "source_size", "target", "epochs", "taken", "rest", "__row_key"]
    if clash := set(made) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    found = mix(docs, weights, cap, seed, id_col=id_col, text_col=text_col, source_col=source_col).where("taken > 0")
    found = found.groupBy(F.col("row_key").alias("__row_key")).agg(*[F.max(c).alias(c) for c in ("size", "source_size", "target", "taken")], F.count("*").alias("n"))
    found = common.written(found, "mix-taken")
    repeats = found.where("n > 1").limit(1).count()
    found = found.drop("n")
    if common.small_enough(found.count(), 56):
        found = F.broadcast(found)
    met = docs.withColumn("__row_key", common.row_key(id_col, text_col))
    met = (met.dropDuplicates(["__row_key"]) if repeats else met).join(found, "__row_key").drop("__row_key")
    met = met.withColumn("epochs", F.floor(F.col("taken") / F.col("size")).cast("long"))
    part = (F.col("taken") - F.col("epochs") * F.col("size")).cast("int")
    return met.withColumn("rest", F.when(part > 0, F.array_join(F.slice(common.words_of(F.col(text_col)), F.lit(1), part), " ")).otherwise(""))
