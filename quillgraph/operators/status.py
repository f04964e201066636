"""Status, audit and usage: counts over documents, blocks, feedback, conflicts and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import schema


def zero_filled(counts: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """A count for each value of a fixed list."""
    every = counts.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return F.broadcast(every).join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def by_status(table: DataFrame, values: tuple[str, ...] = schema.BLOCK_STATUSES) -> DataFrame:
    return zero_filled(table.groupBy("status").agg(F.count("*").alias("n")), "status", values)


def pivoted_status(table: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """One row a key: total and a count for each status."""
    return table.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == v).alias(v) for v in values])


def top(table: DataFrame, n: int, *order: Column) -> DataFrame:
    return table.orderBy(*order).limit(n)


def documents_status(documents: DataFrame, blocks: DataFrame, vectors: DataFrame, by_doc: DataFrame) -> DataFrame:
    """Per document: blocks, vectors, entities and relations, from four pre-aggregated counts."""
    n_blocks = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    n_vectors = vectors_by_doc(vectors, blocks)
    out = documents.join(n_blocks, "doc_id", "left").join(n_vectors, "doc_id", "left").join(by_doc, "doc_id", "left")
    return out.select("doc_id", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("blocks", "vectors", "entities", "relations")])


def vectors_by_doc(vectors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Vectors of each document (S3)."""
    return blocks.join(vectors.select("id"), "id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("vectors"))


def vectors_status(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Whether embedded blocks and vectors agree in number."""
    done = blocks.agg(F.count_if(F.col("status").isin("embedded", "done")).alias("embedded"))
    both = done.join(vectors.agg(F.count("*").alias("vectors")), F.lit(True))
    return both.select("embedded", "vectors", (F.col("vectors") - F.col("embedded")).alias("delta"), (F.col("vectors") == F.col("embedded")).alias("consistent"))


def final_status(stages: DataFrame, documents: DataFrame) -> DataFrame:
    """A document's status from its stages: failed, processing or done; a missing stage is pending."""
    got = stages.groupBy("doc_id").agg(F.bool_or(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "done").alias("done"))
    out = documents.select("doc_id").join(got, "doc_id", "left")
    return out.select("doc_id", F.when(F.coalesce("failed", F.lit(False)), "failed").when(F.coalesce("done", F.lit(0)) == len(schema.STAGES), "done").otherwise("processing").alias("status"))


def pipeline_flags(documents: DataFrame, blocks: DataFrame, vectors: DataFrame, by_doc: DataFrame) -> DataFrame:
    """What is done for each document (S10); ``embedded`` asks for blocks in state embedded, ``embedded_or_done`` for either."""
    counts = blocks.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "embedded").alias("e"), F.count_if(F.col("status").isin("embedded", "done")).alias("ed"))
    out = documents.join(counts, "doc_id", "left").join(vectors_by_doc(vectors, blocks), "doc_id", "left").join(by_doc, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = zero("total")
    whole = lambda c: (total > 0) & (zero(c) == total) & (zero("vectors") == total)
    return out.select("doc_id", (total > 0).alias("parsed"), (total > 0).alias("batches_built"), ((zero("entities") > 0) | (zero("relations") > 0)).alias("extracted"), whole("e").alias("embedded"), whole("ed").alias("embedded_or_done"), (F.col("status") == "done").alias("done"))


def quality_score(counts: DataFrame) -> DataFrame:
    """100 less 5 for each kind of issue and 1 for each case, not below 0 (S9); ``counts`` is one row of numbers, missing kinds being null."""
    columns = counts.columns
    issues = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in columns), F.lit(0))
    cases = sum((F.coalesce(c, F.lit(0)) for c in columns), F.lit(0))
    return counts.select(issues.cast("long").alias("issues"), F.greatest(F.lit(0), 100 - 5 * issues - cases).cast("long").alias("score"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Total, mean to 2 places, and ratings of 0 or less."""
    return feedback.agg(F.count("*").alias("total"), F.round(F.avg("rating"), 2).alias("average"), F.count_if(F.col("rating") <= 0).alias("low"))


def recent_conflicts(conflicts: DataFrame, window: int, n: int) -> DataFrame:
    """Entities with the most conflicts among the ``window`` latest ones."""
    recent = top(conflicts, window, F.desc("timestamp"), F.desc("id"))
    return top(recent.groupBy("entity_type", "name").agg(F.count("*").alias("n")), n, F.desc("n"), F.col("entity_type"), F.col("name"))


# -- usage ------------------------------------------------------------------------


def block_activation(logs: DataFrame) -> DataFrame:
    """Hits of each block, first and last (D31); the same aggregation runs as a stream in ``streaming``."""
    return logs.where(F.col("block_id").isNotNull()).groupBy("block_id").agg(F.count("*").alias("hit_count"), F.min("created_at").alias("first_hit_at"), F.max("created_at").alias("last_hit_at"))


def trace(logs: DataFrame, n: int, session: str | None = None) -> DataFrame:
    """The latest log rows, of one session if given."""
    return top(logs.where(F.col("session_id") == session) if session else logs, n, F.desc("created_at"), F.desc("id"))


def trace_each(logs: DataFrame, n: int) -> DataFrame:
    """The latest log rows of every session."""
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    return logs.withColumn("n", F.row_number().over(w).cast("long")).where(F.col("n") <= n)


def hot_blocks(activation: DataFrame, n: int, cold: bool = False) -> DataFrame:
    """Blocks with most hits, or with fewest."""
    return top(activation, n, F.col("hit_count") if cold else F.desc("hit_count"), F.col("block_id"))


def cleaned_logs(logs: DataFrame, days: int = 30, most: int = 10_000) -> DataFrame:
    """Rows younger than ``days`` before the latest, and of them the newest ``most``.

    The cut is the time and id of the last row that stays, found by a top-n.
    """
    newest = logs.agg(F.max("created_at").alias("now"))
    young = logs.join(F.broadcast(newest), F.lit(True)).where(F.col("created_at") >= F.col("now") - F.expr(f"interval {days} days")).drop("now")
    return top(young, most, F.desc("created_at"), F.desc("id"))


def unused(entities: DataFrame, hits: DataFrame) -> DataFrame:
    """Entities that no hit names."""
    return entities.join(hits, ["entity_type", "name"], "left_anti")


def entity_hits(entities: Column) -> Column:
    """Distinct ``type::name`` of result entities that have both parts."""
    return F.array_distinct(F.transform(F.filter(entities, lambda e: (F.coalesce(e["entity_type"], F.lit("")) != "") & (F.coalesce(e["name"], F.lit("")) != "")), lambda e: F.concat_ws("::", e["entity_type"], e["name"])))


def masked(key: Column) -> Column:
    """A secret setting as shown."""
    return F.when(F.coalesce(key, F.lit("")) == "", "").when(F.length(key) <= 8, "****").otherwise(F.concat(F.left(key, F.lit(4)), F.lit("****"), F.right(key, F.lit(4))))
