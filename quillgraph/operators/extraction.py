"""From model answers to entities and relations, and what is still to be asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import schema
from quillgraph.functions.text import repaired_json
from quillgraph.session import parts_of
from quillgraph.shipping import ship


def _once(value: Column) -> Column:
    """A value that is computed once a row: filters and projections after it are not merged into its expression."""
    return F.explode(F.array(value))


def extract_results(lines: DataFrame, chapters: DataFrame, *, line_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a results file.

    ``lines`` (seq, value) are answers by request; ``chapters`` (custom_id, chapter).
    Answers without choices or JSON are skipped; types outside the vocabulary and
    entities without a name are dropped; ends of relations are not looked at.
    """
    row = F.from_json(line_col, schema.RESULT_LINE)
    raw = lines.select("seq", _once(row).alias("r")).select("seq", F.col("r.custom_id").alias("custom_id"), F.get(F.col("r.response.body.choices"), F.lit(0))["message"]["content"].alias("content"))
    parsed = raw.where(F.col("content").isNotNull()).select("seq", "custom_id", _once(repaired_json(F.col("content"), schema.EXTRACTION)).alias("x")).where(F.col("x").isNotNull()).join(chapters, "custom_id", "left")
    entities = parsed.select("seq", "chapter", F.posexplode("x.entities").alias("pos", "e")).select("seq", "pos", "chapter", F.col("e.type").alias("entity_type"), F.col("e.name").alias("name"), F.col("e.properties").alias("properties"))
    relations = parsed.select("seq", "chapter", F.posexplode("x.relations").alias("pos", "e")).select("seq", "pos", "chapter", "e.from_type", "e.from_name", "e.rel_type", "e.to_type", "e.to_name")
    named = F.coalesce("name", F.lit("")) != ""
    return entities.where(named & F.col("entity_type").isin(schema.NODE_TYPES)), relations.where(F.col("rel_type").isin(schema.REL_TYPES))


def merge_in_document(entities: DataFrame) -> DataFrame:
    """One row an entity of a document: the last value of each property, the first chapter."""
    at = F.struct("seq", "pos")
    keys = ["doc_id", "entity_type", "name"]
    first = entities.groupBy(*keys).agg(F.min_by("chapter", at).alias("chapter"))
    values = entities.select(*keys, at.alias("at"), F.explode("properties").alias("k", "v")).groupBy(*keys, "k").agg(F.max_by("v", "at").alias("v"))
    props = values.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    return first.join(props, keys, "left")


def product_edges(entities: DataFrame, products: DataFrame) -> DataFrame:
    """HAS_MODULE from a document's product to each of its modules."""
    modules = entities.where("entity_type = 'Module'").select("doc_id", "name").distinct()
    return modules.join(products, "doc_id").select("doc_id", F.lit("Product").alias("from_type"), F.col("product").alias("from_name"), F.lit("HAS_MODULE").alias("rel_type"), F.lit("Module").alias("to_type"), F.col("name").alias("to_name"))


def section_relations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations that touch an entity of a section, by type and name or by bare name.

    ``entities`` (doc_id, section, entity_type, name), ``relations`` with doc_id.  The
    four ways are equi-joins, united, in partitions in proportion to the relations.
    """
    cols, n = relations.columns, parts_of(relations)
    out = None
    for end in ("from", "to"):
        for keys in (["doc_id", f"{end}_type", f"{end}_name"], ["doc_id", f"{end}_name"]):
            named = entities.select("doc_id", "section", F.col("entity_type").alias(f"{end}_type"), F.col("name").alias(f"{end}_name")).select("section", *keys)
            part = relations.repartition(n, *keys).join(named.repartition(n, *keys).distinct(), keys).select("section", *cols)
            out = part if out is None else out.unionByName(part)
    return out.repartition(4 * n, "section", *cols).distinct()


def pending_requests(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests without an answer of status 200."""
    return requests.join(results.where("status_code = 200"), "custom_id", "left_anti")


def merged_results(requests: DataFrame, old: DataFrame, fresh: DataFrame) -> DataFrame:
    """An answer for each request in order: a good old one, else the last fresh one, else an error row."""
    good = old.where("status_code = 200").groupBy("custom_id").agg(F.max_by(F.struct("status_code", "body"), "seq").alias("a"))
    new = fresh.groupBy("custom_id").agg(F.max_by(F.struct("status_code", "body"), "seq").alias("b"))
    out = requests.join(good, "custom_id", "left").join(new, "custom_id", "left")
    return out.select("req_idx", "custom_id", F.coalesce("a.status_code", "b.status_code", F.lit(0)).alias("status_code"), F.coalesce("a.body", "b.body", F.lit("missing")).alias("body"))


def requests_for(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Requests of sections that changed or are new."""
    return requests.join(states.where(F.col("state").isin("changed", "added")), "title", "left_semi")


def batch_request(custom_id: Column, model: Column, prompt: Column, url: str = "/v4/chat/completions") -> Column:
    """A line of a batch file (T13, IO6)."""
    body = F.struct(model.alias("model"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body")))


def image_class(pixels: DataFrame) -> DataFrame:
    """(image_id, kind): black and white, gray or color.

    ``pixels`` (image_id, r, g, b).  Gray if over 95 % of the pixels are within 15 of
    their gray; black and white if also over 90 % have a luminance at either edge.
    """
    mean = (F.col("r") + F.col("g") + F.col("b")) / 3
    chroma = F.sqrt(F.pow(F.col("r") - mean, 2) + F.pow(F.col("g") - mean, 2) + F.pow(F.col("b") - mean, 2)) / F.sqrt(F.lit(3.0))
    light = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    found = pixels.groupBy("image_id").agg(share(chroma < 15).alias("gray"), share((light < 64) | (light > 192)).alias("edge"))
    return found.select("image_id", F.when((F.col("gray") > 0.95) & (F.col("edge") > 0.90), "bw").when(F.col("gray") > 0.95, "gray").otherwise("color").alias("kind"))


def size_binned(requests: DataFrame, most_bytes: int = 100 << 20) -> DataFrame:
    """Requests (req_idx, line) of one file with the bin of their part file.

    Consecutive filling is a fold in order; the fold is over a file's requests, whose
    sizes alone are gathered, by file.
    """
    from quillgraph.functions.chunking import size_bins

    def fold(frame):
        frame = frame.sort_values("req_idx")
        return frame.assign(bin=size_bins(frame["bytes"].tolist(), most_bytes))[["file_id", "req_idx", "bin"]]

    ship(requests.sparkSession)
    sizes = requests.select("file_id", F.col("req_idx").cast("long").alias("req_idx"), (F.octet_length("line") + 1).cast("long").alias("bytes"))
    return sizes.groupBy("file_id").applyInPandas(fold, f"file_id {dict(requests.dtypes)['file_id']}, req_idx long, bin long")


def latest(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return table.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
