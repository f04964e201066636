"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches of rising id.  A batch's line hashes are joined with the
runs, which hold every key of earlier batches; lines found there are dropped, and
inside the batch only the smallest id keeps a key.  The batch's keys are written in
order, and those that are in no run are a run of level 0.  Once a level has ``fanout`` runs, they are merged
into one run of the next level, so a key is rewritten a logarithmic number of times
and a lookup meets few runs.  Keys are 128 bits wide.  A run is a table in the shared
folder, bucketed and sorted by key with one file a bucket, so a batch's keys, dealt out
and sorted once, meet run after run in merge anti-joins that move no run; compaction
merges buckets in place.

Defined results: null or empty text is one empty line; lines of rows with one id
count as lines of one document; rows with a null id count as one document after
all others; rows that repeat get equal results; an empty table gives an empty
result; clashing names of other columns do no harm, as the work is done on a
selection.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common

LEAST_CHARS = 10
BATCHES = 6
FANOUT = 2
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return common.ascii_lower(F.btrim(line, F.lit(common.SPACE_CHARS)))


class LineRuns:
    """The store: levels of sorted runs (h1, h2) in ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.names: list[str] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def seen(self) -> DataFrame | None:
        """All keys of all runs; runs are disjoint, so this needs no distinct."""
        out = None
        for run in self.runs():
            out = run if out is None else out.unionByName(run)
        return out

    def stored(self, run: DataFrame, name: str, path: str | None = None) -> DataFrame:
        """A run, already dealt out by key, as a bucketed and sorted table, one file a bucket."""
        table = f"quillgraph_{name.replace('-', '_')}_{uuid.uuid4().hex}"
        path = path or common.scratch_path(self.spark, name)
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.buckets, "h1", "h2")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds."""
        for run in self.runs():
            keys = keys.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, run: DataFrame) -> None:
        """Add a stored run of keys that no run holds, and compact full levels."""
        depth = 0
        while True:
            if depth == len(self.levels):
                self.levels.append([])
            self.levels[depth].append(run)
            if len(self.levels[depth]) < self.fanout:
                return
            # Runs are disjoint and bucketed alike, so a full outer join of buckets is their sorted merge.
            merged = self.levels[depth][0]
            for other in self.levels[depth][1:]:
                merged = merged.join(other.hint("merge"), ["h1", "h2"], "full")
            self.levels[depth] = []
            depth += 1
            run = self.stored(merged, f"line-run-{depth}")

    def forget(self) -> None:
        """Take the runs' names out of the catalog; the files go with the driver's other scratch tables."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names, self.levels = [], []


def _bounds(ids: DataFrame, batches: int) -> list[int]:
    """Rising ids that part the documents into batches of about equal count; the result does not depend on them."""
    cuts = ids.where("id is not null").approxQuantile("id", [i / batches for i in range(1, batches)], 0.02) if batches > 1 else []
    return sorted({int(x) for x in cuts})


def mark_batch(lines: DataFrame, runs: LineRuns) -> DataFrame:
    """Dropped lines (id, text_key, pos) of a batch (id, text_key, pos, h1, h2); the runs then hold its keys too."""
    # Keys are combined before they are dealt out, so a line that very many documents hold is a few rows.
    keys = runs.dealt(lines.groupBy("h1", "h2").agg(F.min("id").alias("first_id")))
    path = common.scratch_path(runs.spark, "line-run-0")
    runs.add(runs.stored(runs.unseen(keys), "line-run-0", path).select("h1", "h2"))
    # A key stays in one place only: at the smallest id of the batch, if no earlier batch has it.
    # The batch's own new keys are read as a plain table, so that Spark can split this join at such a line.
    new = runs.spark.read.schema(keys.schema).parquet(path)
    met = lines.join(new.hint("merge"), ["h1", "h2"], "left")
    return met.where(F.col("first_id").isNull() | (F.col("id") > F.col("first_id"))).select("id", "text_key", "pos")


def without(lines: Column, gone: Column) -> Column:
    """The elements whose place is not in ``gone``, in time linear in both: slices between the sorted places."""
    stops = F.concat(F.array(F.lit(-1)), F.sort_array(gone), F.array(F.size(lines)))
    pieces = lambda x: common.let(stops, lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda k: F.slice(x, F.get(s, k) + 2, F.get(s, k + 1) - F.get(s, k) - 1))))
    return common.let(lines, pieces)


def dedup(docs: DataFrame, *, least_chars: int = LEAST_CHARS, batches: int = BATCHES, fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the kept lines as text, and ``n_lines`` and ``n_dropped``.

    Lines are hashed in one pass over the texts; only (id, place, hash) is written
    and shuffled.  The texts themselves are shuffled once, to meet their drops.
    """
    spark = docs.sparkSession
    key = F.col("line")
    base = docs.select(F.coalesce(F.col(id_col), F.lit(_LAST)).cast("long").alias("id"), common.text_of(text_col).alias("text"))
    bounds = _bounds(docs.select(F.col(id_col).cast("long").alias("id")), batches)
    batch = F.lit(0)
    for cut in bounds:
        batch = batch + (F.col("id") > cut).cast("int")
    # The text's hash is taken below the explode, or it would be taken once a line.
    base = base.select("id", F.xxhash64("text").alias("text_key"), F.transform(F.split("text", "\n", -1), line_key).alias("lines"))
    lines = base.select("id", "text_key", F.posexplode("lines").alias("pos", "line")).where(F.length("line") >= least_chars)
    lines = common.written(lines.select("id", "text_key", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"), batch.alias("batch")), "line-hashes", "batch")
    # Each batch's drops are written as they are found: one plan of all batches would start some 24 scans and shuffles at once, each of which costs the driver some MB.
    runs, path = LineRuns(spark, fanout), common.scratch_path(spark, "line-drops")
    for b in range(len(bounds) + 1):
        part = lines.where(F.col("batch") == b).drop("batch")
        part = mark_batch(part, runs).groupBy("id", "text_key").agg(F.collect_set("pos").alias("gone"))
        part.write.mode("append").option("compression", "zstd").parquet(path)
    drops = spark.read.schema(part.schema).parquet(path)
    runs.forget()
    # Repeated rows of one id and text have one row of drops; an id lies in one batch.
    taken = set(docs.columns)
    id_k, text_k, gone_k = (next(n for n in (f"{x}_{i}" if i else x for i in range(len(taken) + 1)) if n not in taken) for x in ("__id", "__text_key", "__gone"))
    drops = drops.select(F.col("id").alias(id_k), F.col("text_key").alias(text_k), F.col("gone").alias(gone_k))
    keyed = docs.withColumns({id_k: F.coalesce(F.col(id_col), F.lit(_LAST)).cast("long"), text_k: F.xxhash64(common.text_of(text_col))})
    # Always a merge join, so that a plan over few drops is that over many.
    joined = keyed.join(drops.hint("merge"), [id_k, text_k], "left")
    split = F.split(common.text_of(text_col), "\n", -1)
    gone = F.col(gone_k)
    kept = F.when(gone.isNull(), common.text_of(text_col)).otherwise(F.array_join(without(split, gone), "\n"))
    out = joined.withColumns({"n_lines": F.size(split).cast("long"), "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"), text_col: kept})
    return out.drop(id_k, text_k, gone_k)
