"""Sessions and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "quillgraph", **conf: str) -> SparkSession:
    """A session with adaptive execution; every setting given wins."""
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal out a scan that has fewer partitions than the session has cores, as one small file has one.

    Large inputs have more and are left as they are, so nothing large is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


#: Bytes of scanned files for each partition that ``dealt`` and ``parts_of`` make: files are compressed, and a task's rows are a multiple of them.
PART_BYTES = 4 << 20


def parts_of(*frames: DataFrame) -> int:
    """How many partitions rows made from these frames need, in proportion to the files they read; a core has one at least.

    Shuffled rows with few different values are compressed far better than they are
    held, so partitions that are joined by their shuffled bytes grow too large.
    """
    read = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        read += sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()) if "LogicalRelation" in leaves.apply(i).getClass().getSimpleName())
    return max(frames[0].sparkSession.sparkContext.defaultParallelism, -(-read // PART_BYTES))


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt out over ``parts_of`` partitions, by columns if any: before costly work on rows that lie in few row groups, or before groups are made."""
    return df.repartition(parts_of(df), *columns)
