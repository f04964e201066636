"""Sources and sinks: files of documents, request lines, prompts, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import short_hash


def scan(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files below a path with their hash and document id (IO1, IO2)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.md5("content").alias("file_hash"), short_hash(F.col("content")).alias("doc_id"), "content").dropDuplicates(["path"])


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Request or result lines; blank and malformed ones are skipped (IO7)."""
    return parsed_lines(spark.read.text(path), schema)


def parsed_lines(lines: DataFrame, schema: str, *, line_col: str = "value") -> DataFrame:
    good = F.try_parse_json(line_col).isNotNull()
    return lines.where((F.trim(line_col) != "") & good).select(F.from_json(line_col, schema).alias("r")).select("r.*")


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line (IO6)."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(name, template) of prompt files (IO12)."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("name"), F.col("value").alias("template"))


def filled(template, values: dict):
    """A template with ``$name`` or ``${name}`` replaced; unknown names stay (IO12)."""
    for name, value in values.items():
        template = F.replace(F.replace(template, F.lit("${" + name + "}"), value), F.lit("$" + name), value)
    return template


def save_graph(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet in a new folder (IO8); readers keep the old one until they are pointed at it."""
    entities.write.parquet(f"{path}/entities")
    relations.write.parquet(f"{path}/relations")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relations")


def node_link(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Node-link JSON, a line for each node and link (IO8, IO9): files join them as they like, and no row holds the whole graph."""
    nodes = entities.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.concat_ws("::", "entity_type", "name").alias("id"), *entities.columns)).alias("json"))
    links = relations.select(F.lit("link").alias("kind"), F.to_json(F.struct(F.concat_ws("::", "from_type", "from_name").alias("source"), F.concat_ws("::", "to_type", "to_name").alias("target"), "rel_type")).alias("json"))
    return nodes.unionByName(links)


def safe_member(name):
    """Whether an archive member's name stays inside its folder (IO5)."""
    return ~name.rlike(r"^/|\\|:") & ~F.array_contains(F.split(name, "/"), "..")
