"""The property graph as two tables: merge, look-up, neighbourhoods, paths, upkeep and statistics.

entities: entity_type, name, properties map, doc_properties map of maps,
source_doc_ids array, source_chapter, confidence, verified, feedback_score.
relations: from_type, from_name, to_type, to_name, rel_type and the same rest.
Nodes are named ``type::name`` where one column is wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.retrieval import BROADCAST_BYTES
from quillgraph.scratch import written
from quillgraph.session import dealt, parts_of
from quillgraph.shipping import ship

ENTITY_KEY = ["entity_type", "name"]
RELATION_KEY = ["from_type", "from_name", "to_type", "to_name"]


def node_id(kind: str | Column, name: str | Column) -> Column:
    return F.concat_ws("::", kind, name)


def node_parts(nid: Column) -> tuple[Column, Column]:
    """Type and name, cut at the first ``::``."""
    parts = F.split(nid, "::", 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def completeness(properties: Column) -> Column:
    """Values that say something: not null, not empty, not an empty list (G1)."""
    return F.size(F.filter(F.map_values(properties), lambda v: v.isNotNull() & (v != "") & (v != "[]"))).cast("long")


# -- merge -------------------------------------------------------------------


def _fold(keys: list[str]):
    """Streaming fold over events sorted by (key, property, seq): the last value of each property, and the conflicts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current_key, value, docs, last = None, None, {}, None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                key = (*(getattr(row, k) for k in keys), row.property_key)
                if key != current_key:
                    if current_key is not None and value is not None:
                        out.append((*current_key, "value", value, None, None, None, None, last))
                    current_key, value, docs, last = key, None, {}, None
                new = row.value if isinstance(row.value, str) else None
                if new is not None:
                    if value is None:
                        value = new
                    elif new != value:
                        old_score = next((s for v, s in docs.values() if v == value), None)
                        out.append((*key, "conflict", value, new, row.doc_id, float(-1 if old_score is None else old_score), float(row.score), int(row.seq)))
                        if old_score is not None and row.score > old_score:
                            value = new
                if isinstance(row.doc_id, str) and row.doc_id:
                    docs[row.doc_id] = (new, row.score)
                last = int(row.seq)
            yield pd.DataFrame(out, columns=[*keys, "property_key", "kind", "value", "new_value", "doc_id", "old_completeness", "new_completeness", "seq"])
        if current_key is not None and value is not None:
            yield pd.DataFrame([(*current_key, "value", value, None, None, None, None, last)], columns=[*keys, "property_key", "kind", "value", "new_value", "doc_id", "old_completeness", "new_completeness", "seq"])

    return run


def _merged_properties(versions: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Events of each (key, property) in order of ``merge_seq``, folded.

    A version that lacks a property still replaces its document's snapshot, so every
    version of a key meets every property of the key; versions are few a key, and
    the fold streams, so a key with very many needs no memory but its documents'.
    """
    ship(versions.sparkSession)
    scored = versions.select(*keys, F.col("merge_seq").cast("long").alias("seq"), F.coalesce(F.get("source_doc_ids", F.lit(0)), F.lit("")).alias("doc_id"), "properties", completeness(F.col("properties")).alias("score"))
    names = versions.select(*keys, F.explode(F.map_keys("properties")).alias("property_key")).distinct()
    events = scored.join(names, keys).select(*keys, "property_key", "seq", "doc_id", F.try_element_at("properties", F.col("property_key")).alias("value"), "score")
    ordered = events.repartition(n, *keys, "property_key").sortWithinPartitions(*keys, "property_key", "seq")
    schema = ", ".join(f"{k} string" for k in keys) + ", property_key string, kind string, value string, new_value string, doc_id string, old_completeness double, new_completeness double, seq long"
    return ordered.mapInPandas(_fold(keys), schema)


def _folded_back(folded: DataFrame, keys: list[str], n: int) -> DataFrame:
    values = folded.where("kind = 'value'").repartition(n, *keys)
    return values.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property_key", "value")))).alias("properties"))


def _side_columns(versions: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    chapter = F.when(F.coalesce("source_chapter", F.lit("")) != "", F.col("merge_seq"))
    return versions.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_doc_ids")))).alias("source_doc_ids"),
        F.coalesce(F.max_by("source_chapter", chapter), F.lit("")).alias("source_chapter"),
        F.min("confidence").alias("confidence"),
        F.bool_or("verified").alias("verified"),
        F.min_by("feedback_score", "merge_seq").alias("feedback_score"),
        *more,
    )


def merge_entities(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and conflicts from versions in order of ``merge_seq``.

    A new value wins only over a value whose document, the first whose snapshot
    holds it, is less complete.  Every difference is a conflict.
    """
    n = parts_of(versions)
    versions = versions.repartition(n, *ENTITY_KEY)
    folded = _merged_properties(versions, ENTITY_KEY, n)
    entities = _side_columns(versions, ENTITY_KEY).join(_folded_back(folded, ENTITY_KEY, n), ENTITY_KEY, "left")
    return entities, folded.where("kind = 'conflict'").drop("kind").withColumnRenamed("value", "old_value")


def merge_relations(versions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relations, conflicts and the entities that relations name but nobody made.

    Ends identify a relation; the first type stays.
    """
    n = parts_of(versions)
    together = versions.repartition(n, *RELATION_KEY)
    folded = _merged_properties(together, RELATION_KEY, n)
    relations = _side_columns(together, RELATION_KEY, F.min_by("rel_type", "merge_seq").alias("rel_type")).join(_folded_back(folded, RELATION_KEY, n), RELATION_KEY, "left")
    ends = versions.select(F.col("from_type").alias("entity_type"), F.col("from_name").alias("name")).unionByName(versions.select(F.col("to_type").alias("entity_type"), F.col("to_name").alias("name"))).distinct()
    return relations, folded.where("kind = 'conflict'").drop("kind").withColumnRenamed("value", "old_value"), ends.join(entities, ENTITY_KEY, "left_anti")


def snapshot(entities: DataFrame, doc_id: str) -> DataFrame:
    """Entities with the properties that one document gave, where it gave any."""
    return entities.withColumn("properties", F.coalesce(F.try_element_at("doc_properties", F.lit(doc_id)), F.col("properties")))


# -- look-up -----------------------------------------------------------------


def find_entities(entities: DataFrame, text: str = "", types: list[str] | None = None) -> DataFrame:
    """Names that hold a text in any case; an empty text matches all."""
    out = entities.where(F.contains(F.lower("name"), F.lit(text.lower()))) if text else entities
    return out.where(F.col("entity_type").isin(types)) if types else out


def get_relations(relations: DataFrame, kind: str, name: str, direction: str = "both", rel_type: str | None = None) -> DataFrame:
    """Relations at a node; ``both`` lists a self-loop twice."""
    rels = relations.where(F.col("rel_type") == rel_type) if rel_type else relations
    out = rels.where((F.col("from_type") == kind) & (F.col("from_name") == name))
    into = rels.where((F.col("to_type") == kind) & (F.col("to_name") == name))
    return {"out": out, "in": into, "both": out.unionAll(into)}[direction]


def neighbors(relations: DataFrame, starts: DataFrame, direction: str = "both", rel_type: str | None = None) -> DataFrame:
    """(qid, entity_type, name) around each start (qid, entity_type, name); both directions keep doubles."""
    rels = relations.where(F.col("rel_type") == rel_type) if rel_type else relations
    s = starts.select("qid", F.col("entity_type").alias("s_type"), F.col("name").alias("s_name"))
    out = rels.join(s, (F.col("from_type") == F.col("s_type")) & (F.col("from_name") == F.col("s_name"))).select("qid", F.col("to_type").alias("entity_type"), F.col("to_name").alias("name"))
    into = rels.join(s, (F.col("to_type") == F.col("s_type")) & (F.col("to_name") == F.col("s_name"))).select("qid", F.col("from_type").alias("entity_type"), F.col("from_name").alias("name"))
    return {"out": out, "in": into, "both": out.unionAll(into)}[direction]


def _plain_edges(relations: DataFrame, rel_types: list[str] | None = None) -> DataFrame:
    """(src, dst), repeated if the graph has several relations between two nodes."""
    rels = relations.where(F.col("rel_type").isin(rel_types)) if rel_types else relations
    return rels.select(node_id("from_type", "from_name").alias("src"), node_id("to_type", "to_name").alias("dst"))


def _if_small(df: DataFrame) -> DataFrame:
    """To be broadcast if its counted rows are few; of a written or cached table."""
    return F.broadcast(df) if df.count() * 256 <= BROADCAST_BYTES else df


def subgraph(entities: DataFrame, relations: DataFrame, centers: DataFrame, depth: int = 1, rel_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (qid, nid) within ``depth`` undirected steps of each center (qid, entity_type, name), and edges between them.

    The type filter holds for the steps only.  One join a layer, each layer distinct
    and cached (to disk if need be), as later layers and the edges start from it.
    """
    start = centers.join(entities.select(*ENTITY_KEY), ENTITY_KEY, "left_semi")
    seen = start.select("qid", node_id("entity_type", "name").alias("nid")).distinct().persist()
    edges = _plain_edges(relations, rel_types)
    both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    layer = seen
    for _ in range(depth):
        layer = both.join(_if_small(layer), F.col("nid") == F.col("src")).select("qid", F.col("dst").alias("nid")).distinct().join(seen, ["qid", "nid"], "left_anti").persist()
        seen = seen.unionByName(layer)
    every = relations.select(node_id("from_type", "from_name").alias("src"), node_id("to_type", "to_name").alias("dst"), "rel_type")
    inside = every.join(seen.withColumnRenamed("nid", "src"), "src").join(seen.withColumnRenamed("nid", "dst"), ["qid", "dst"], "left_semi").select("qid", "src", "dst", "rel_type")
    return seen, inside


def find_paths(relations: DataFrame, pairs: DataFrame, max_depth: int = 3, rel_types: list[str] | None = None) -> DataFrame:
    """(qid, path, length): directed simple paths of each pair (qid, src, dst) of node ids, at most ``max_depth`` (1 to 6) edges."""
    edges = _plain_edges(relations, rel_types).select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst"))
    walk = written(pairs.where("src <> dst").select("qid", F.array("src").alias("path"), F.col("src").alias("at"), "dst"), "walk")
    goals = _if_small(written(walk.select(F.col("dst").alias("e_dst")).distinct(), "goals"))
    most, found = max(1, min(max_depth, 6)), None
    for step in range(1, most + 1):
        # The last step goes to the ends only; edges that no walk takes are left out before they are moved.
        ways = edges if step < most else edges.join(goals, "e_dst", "left_semi")
        ways = ways.join(_if_small(written(walk.select(F.col("at").alias("e_src")).distinct(), "fronts")), "e_src", "left_semi")
        ways = dealt(ways, "e_src").select("e_src", "e_dst").distinct()
        walk = walk.join(ways, (F.col("at") == F.col("e_src")) & (F.lit(True) if step < most else F.col("dst") == F.col("e_dst"))).where(~F.array_contains("path", F.col("e_dst")))
        walk = written(walk.select("qid", F.array_append("path", F.col("e_dst")).alias("path"), F.col("e_dst").alias("at"), "dst"), "walk")
        here = walk.where("at = dst").select("qid", "path", F.lit(step).cast("long").alias("length"))
        found = here if found is None else found.unionByName(here)
        walk = walk.where("at <> dst")
    return found


# -- upkeep ------------------------------------------------------------------


def remove_document(entities: DataFrame, relations: DataFrame, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Take a document's contributions out; what only it had goes, with the edges of nodes that go."""

    def without(df: DataFrame) -> DataFrame:
        had = F.coalesce(F.array_contains("source_doc_ids", doc_id), F.lit(False))
        left = F.array_remove("source_doc_ids", doc_id)
        out = df.where(~(had & (F.size(left) == 0))).withColumn("source_doc_ids", F.coalesce(left, F.col("source_doc_ids")))
        if "doc_properties" in df.columns:
            out = out.withColumn("doc_properties", F.map_filter("doc_properties", lambda k, _: k != doc_id))
        return out

    kept = without(entities)
    return kept, _with_ends(without(relations), kept)


def _with_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    nodes = entities.select(*ENTITY_KEY).distinct()
    for end in ("from", "to"):
        relations = relations.join(nodes.select(F.col("entity_type").alias(f"{end}_type"), F.col("name").alias(f"{end}_name")), [f"{end}_type", f"{end}_name"], "left_semi")
    return relations


def patch(table: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the fields that a patch row gives (not null)."""
    fields = [c for c in patches.columns if c not in keys]
    renamed = patches.select(*keys, *[F.col(c).alias(f"p_{c}") for c in fields])
    return table.join(renamed, keys, "left").select(*[F.coalesce(f"p_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def verify(entities: DataFrame, keys: DataFrame) -> DataFrame:
    return patch(entities, keys.select(*ENTITY_KEY).distinct().withColumn("verified", F.lit(True)), ENTITY_KEY)


def delete_entities(entities: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop entities and every edge at them."""
    kept = entities.join(gone, ENTITY_KEY, "left_anti")
    for end in ("from", "to"):
        relations = relations.join(gone.select(F.col("entity_type").alias(f"{end}_type"), F.col("name").alias(f"{end}_name")), [f"{end}_type", f"{end}_name"], "left_anti")
    return kept, relations


def delete_relations(relations: DataFrame, gone: DataFrame) -> DataFrame:
    return relations.join(gone, [*RELATION_KEY, "rel_type"], "left_anti")


def apply_feedback(table: DataFrame, feedback: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of ratings as feedback_score."""
    scores = feedback.groupBy(*keys).agg(F.sum("rating").cast("long").alias("score"))
    return table.join(scores, keys, "left").withColumn("feedback_score", F.coalesce("score", "feedback_score")).drop("score")


# -- statistics --------------------------------------------------------------


def stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Counts of nodes and edges."""
    return entities.agg(F.count("*").alias("nodes")).join(relations.agg(F.count("*").alias("edges")), F.lit(True))


def stats_by_doc(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities and relations of each source document."""
    count = lambda df, name: df.select(F.explode("source_doc_ids").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias(name))
    both = count(entities, "entities").join(count(relations, "relations"), "doc_id", "full_outer")
    return both.select("doc_id", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("relations", F.lit(0)).alias("relations"))


def distribution(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count("*").alias("n"))


def verified_stats(table: DataFrame) -> DataFrame:
    return table.agg(F.count_if(F.col("verified")).alias("verified"), F.count_if(~F.col("verified")).alias("unverified"))


def low_confidence(table: DataFrame, threshold: float = 0.5) -> DataFrame:
    return table.agg(F.count_if(F.col("confidence") < threshold).alias("low_confidence"))


def source_gaps(table: DataFrame) -> DataFrame:
    return table.agg(F.count_if(F.coalesce(F.size("source_doc_ids"), F.lit(0)) <= 0).alias("without_source"))


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities at no edge."""
    ends = relations.select(F.col("from_type").alias("entity_type"), F.col("from_name").alias("name")).unionByName(relations.select(F.col("to_type").alias("entity_type"), F.col("to_name").alias("name")))
    return entities.join(ends, ENTITY_KEY, "left_anti")


def property_index(entities: DataFrame) -> DataFrame:
    """(entity_type, key, value, name): the index that look-ups by property read."""
    return entities.select("entity_type", "name", F.explode("properties").alias("key", "value"))


def find_by_property(entities: DataFrame, kind: str, key: str, value: str) -> DataFrame:
    return property_index(entities).where((F.col("entity_type") == kind) & (F.col("key") == key) & (F.col("value") == value))


# -- bridge ------------------------------------------------------------------


def extract_refs(blocks: DataFrame, *, id_col: str = "id", refs_col: str = "extracted_entities") -> DataFrame:
    """Distinct (block_id, entity_type, name) of the references that blocks hold, both parts given (B1, B2)."""
    refs = blocks.select(F.col(id_col).alias("block_id"), F.inline(refs_col))
    return refs.where((F.coalesce("entity_type", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "")).distinct()


def attach(bridge: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace the references of the blocks in ``fresh``."""
    return bridge.join(fresh.select("block_id").distinct(), "block_id", "left_anti").unionByName(fresh.distinct())


def detach(bridge: DataFrame, blocks: DataFrame) -> DataFrame:
    return bridge.join(blocks.select("block_id").distinct(), "block_id", "left_anti")


def context_of_hits(hits: DataFrame, bridge: DataFrame, entities: DataFrame, relations: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Entities and relations around the blocks (qid, id) that a query hit.

    Entities of the blocks that the graph has, their neighbourhood to ``depth``, and
    every relation at an entity of a block; each once a query.
    """
    # Few rows that several joins below start from; cached, so that the search behind the hits runs once.
    hits = written(hits.select("qid", "id"), "hits")
    met = _if_small(written(hits.select(F.col("id").alias("block_id")).distinct(), "hit-blocks"))
    bridge = bridge.join(met, "block_id", "left_semi")
    direct = hits.join(bridge, hits["id"] == bridge["block_id"]).select("qid", *ENTITY_KEY).distinct().join(entities.select(*ENTITY_KEY), ENTITY_KEY, "left_semi").persist()
    nodes, inside = subgraph(entities, relations, direct, depth)
    plain = relations.select(node_id("from_type", "from_name").alias("src"), node_id("to_type", "to_name").alias("dst"), "rel_type")
    mine = direct.select("qid", node_id("entity_type", "name").alias("nid"))
    incident = plain.join(mine, F.col("src") == F.col("nid")).select("qid", "src", "dst", "rel_type").unionByName(plain.join(mine, F.col("dst") == F.col("nid")).select("qid", "src", "dst", "rel_type"))
    return nodes, inside.unionByName(incident).distinct()


def source_documents(hits: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of the hits (qid, id, rank) in order of their first hit."""
    met = hits.join(blocks.select("id", "doc_id"), "id").groupBy("qid", "doc_id").agg(F.min("rank").alias("first_rank"))
    found = met.join(documents.select("doc_id", "title"), "doc_id")
    return found.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("first_rank", "doc_id")).cast("long"))
