"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame operations only.

A benchmark item is contained in a document if the document holds 0.8 or more of
the item's distinct five-word shingles.  Shingles are hashed; a set's MinHash sketch
is its smallest hashes.  An item of q shingles may miss at most ``floor(0.2 q)`` of
them, so one of its ``floor(0.2 q) + 1`` smallest hashes is in every document that
contains it: a sketch of that size loses no pair, where a fixed number of banded
hashes would lose short items in long documents, whose Jaccard similarity is near
zero.  Documents are partitioned by size (powers of two of their word count).  A
partition is searched only for items that fit into it, and its documents only keep
hashes up to the largest sketch hash of those items.  Candidates are verified by
exact containment over the shingles' words.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case.  Defined results: null texts
are empty; items of fewer than five words have no shingle and are never found; items
that repeat under one id count as one item for each different text; rows that repeat
get equal results; documents with a null id are searched; empty tables give empty
results; other columns, whatever their names, are kept and not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import common

SHINGLE = 5
SIMILARITY = 0.8
#: The bound on item rows that may be broadcast is common.BROADCAST_BYTES; a sketch row is about this long.
_SKETCH_BYTES = 64


def _normal_words(text: Column) -> Column:
    return common.words_of(common.ascii_lower(common.text_of(text)))


def _windows(words: Column, size: int, of: Callable[..., Column]) -> Column:
    """``of`` the words of each window of ``size`` words."""

    def every(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(0)))
        return F.transform(starts, lambda first, i: of(first, *[F.get(w, i + j) for j in range(1, size)]))

    return common.let(words, every)


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """array<long>: a hash for each window of ``size`` words, repeats included."""
    return _windows(words, size, F.xxhash64)


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """array<string>: the distinct windows of ``size`` words."""
    return F.array_distinct(_windows(words, size, lambda *w: F.concat_ws(" ", *w)))


def _size_class(n: Column) -> Column:
    return F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")


def contaminations(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs (row_key, doc_id, item_id, n_shingles, n_shared, containment) with containment of at least ``similarity``."""
    per_item = (
        items.select(F.col(item_col).alias("item_id"), _normal_words(F.col(item_text_col)).alias("w"))
        .distinct()
        .withColumn("grams", shingles(F.col("w"), size))
        .where(F.size("grams") > 0)
        .withColumn("q", F.size("grams"))
        .withColumn("hashes", F.array_sort(F.array_distinct(shingle_hashes(F.col("w"), size))))
        .withColumn("item_key", F.xxhash64("item_id", "w"))
    )
    # One more than may miss; the small margin keeps a product such as 0.8 * 5 from being rounded up.
    may_miss = F.floor(F.col("q") - F.col("q") * similarity + 1e-9).cast("int")
    per_item = per_item.withColumn("sketch", F.slice("hashes", F.lit(1), may_miss + 1)).withColumn("need", F.col("q") - may_miss)
    per_item = common.written(per_item.select("item_key", "item_id", "q", "need", "grams", "sketch"), "decontam-items")
    sketch = per_item.select("item_key", F.col("need").alias("needs"), F.explode("sketch").alias("h"))
    # The hash bound of each size partition: at most 31 rows, one a power of two.
    limits = {r.c: r.h for r in per_item.groupBy(_size_class(F.col("need") + (size - 1)).alias("c")).agg(F.max(F.element_at("sketch", -1)).alias("h")).collect()}
    bounds = [max((h for c, h in limits.items() if c <= at), default=None) for at in range(32)]
    bounds = F.array(*[F.lit(h).cast("long") for h in bounds])

    def sketched(w: Column) -> Column:
        """The document's hashes up to its partition's bound, each with the word count; none if nothing fits."""
        n = F.size(w)
        below = lambda most: F.filter(_windows(w, size, F.xxhash64), lambda h: h <= most)
        return F.transform(common.let(F.get(bounds, _size_class(n)), below), lambda h: F.struct(h.alias("h"), n.alias("n")))

    # One expression over words that are cut once: a projection of its own would be merged and cut them again for each use.
    keyed = docs.select(common.row_key(id_col, text_col).alias("row_key"), F.explode(common.let(_normal_words(F.col(text_col)), sketched)).alias("p"))
    probes = keyed.select("row_key", "p.h", "p.n")
    rows = per_item.agg(F.sum(F.size("sketch")).alias("s"), F.sum(F.length(F.array_join("grams", " "))).alias("b")).first()
    light = common.small_enough(rows.s or 0, _SKETCH_BYTES)
    pairs = probes.join(F.broadcast(sketch) if light else sketch, "h").where(F.col("n") - (size - 1) >= F.col("needs"))
    pairs = common.written(pairs.groupBy("row_key", "item_key").agg(F.lit(1).alias("one")).select("row_key", "item_key"), "decontam-candidates")
    # Candidates of a document in one row, so that its text meets them once and is cut into shingles once.
    wanted = pairs.groupBy("row_key").agg(F.collect_list("item_key").alias("item_keys"))
    if common.small_enough(pairs.count(), 48):
        wanted = F.broadcast(wanted)
    texts = docs.select(common.row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    met = texts.join(wanted, "row_key").select("row_key", "doc_id", shingles(_normal_words(F.col("text")), size).alias("doc_grams"), "item_keys")
    met = met.select("row_key", "doc_id", "doc_grams", F.explode("item_keys").alias("item_key"))
    grams = per_item.select("item_key", "item_id", "q", "need", "grams")
    if (rows.b or 0) * 2 <= common.BROADCAST_BYTES:
        grams = F.broadcast(grams)
    shared = met.join(grams, "item_key").withColumn("n_shared", F.size(F.array_intersect("grams", "doc_grams")))
    return shared.where(F.col("n_shared") >= F.col("need")).select("row_key", "doc_id", "item_id", F.col("q").cast("long").alias("n_shingles"), F.col("n_shared").cast("long").alias("n_shared"), (F.col("n_shared") / F.col("q")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that contain no item, with all their columns."""
    found = common.written(contaminations(docs, items, similarity, id_col=id_col, text_col=text_col).select("row_key").distinct(), "decontam-found")
    name = "__row_key"
    while name in docs.columns:
        name += "_"
    found = found.withColumnRenamed("row_key", name)
    if common.small_enough(found.count(), 16):
        found = F.broadcast(found)
    return docs.withColumn(name, common.row_key(id_col, text_col)).join(found, name, "left_anti").drop(name)
