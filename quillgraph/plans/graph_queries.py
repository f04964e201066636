"""Registered queries: graph look-ups, merge, upkeep, statistics, bridge, explore verbs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import graph as g
from quillgraph.plans import fixtures as fx
from quillgraph.plans.registry import query
from quillgraph.session import table

_G = f"WITH {fx.ENTITIES_SQL}, {fx.RELATIONS_SQL}"


@query("entity_lookup", f"{_G} SELECT entity_type, name, confidence, verified FROM entities WHERE entity_type = 'Nation' AND name = 'NATION_7'")
def entity_lookup(spark, sf_dir):
    e = fx.entities(spark, sf_dir)
    return e.where((F.col("entity_type") == "Nation") & (F.col("name") == "NATION_7")).select("entity_type", "name", "confidence", "verified")


@query("entity_search", f"{_G} SELECT entity_type, name FROM entities WHERE contains(lower(name), 'n_1') AND entity_type IN ('Nation', 'Region')")
def entity_search(spark, sf_dir):
    return g.find_entities(fx.entities(spark, sf_dir), "N_1", ["Nation", "Region"]).select("entity_type", "name")


@query("entities_by_type", f"{_G} SELECT name, confidence FROM entities WHERE entity_type = 'Supplier'")
def entities_by_type(spark, sf_dir):
    return g.find_entities(fx.entities(spark, sf_dir), types=["Supplier"]).select("name", "confidence")


@query("property_index_lookup", "SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
def property_index_lookup(spark, sf_dir):
    return g.find_by_property(fx.entities(spark, sf_dir), "Customer", "segment", "BUILDING").select("name")


def _nations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("qid"), F.lit("Nation").alias("entity_type"), F.col("n_name").alias("name"))


_N = "SELECT n_nationkey AS qid, {a}_type AS entity_type, {a}_name AS name FROM nation JOIN relations ON {b}_type = 'Nation' AND {b}_name = n_name"
for _direction, _sql in {"out": _N.format(a="to", b="from"), "in": _N.format(a="from", b="to"), "both": _N.format(a="to", b="from") + " UNION ALL " + _N.format(a="from", b="to")}.items():

    @query(f"neighbors_{_direction}", f"{_G} {_sql}")
    def _neighbors(spark, sf_dir, direction=_direction):
        return g.neighbors(fx.relations(spark, sf_dir), _nations(spark, sf_dir), direction)


@query("neighbors_rel_filter", f"{_G} {_N.format(a='to', b='from')} WHERE rel_type = 'HAS_SUPPLIER'")
def neighbors_rel_filter(spark, sf_dir):
    return g.neighbors(fx.relations(spark, sf_dir), _nations(spark, sf_dir), "out", "HAS_SUPPLIER")


@query("entity_relations", f"{_G} SELECT from_name, to_name, rel_type FROM relations WHERE from_name = 'NATION_8' UNION ALL SELECT from_name, to_name, rel_type FROM relations WHERE to_name = 'NATION_8'")
def entity_relations(spark, sf_dir):
    return g.get_relations(fx.relations(spark, sf_dir), "Nation", "NATION_8").select("from_name", "to_name", "rel_type")


def _subgraph_sql(depth: int, types: str | None = None) -> str:
    keep = f"WHERE rel_type IN ({types})" if types else ""
    layers = "l0 AS (SELECT n_nationkey AS qid, 'Nation::' || n_name AS nid FROM nation)"
    for i in range(depth):
        layers += f", l{i + 1} AS (SELECT qid, nid FROM l{i} UNION SELECT qid, dst FROM l{i} JOIN both_ ON nid = src)"
    return f"""{_G}, both_ AS (SELECT src, dst FROM edges {keep} UNION SELECT dst, src FROM edges {keep}), {layers},
inside AS (SELECT a.qid, count(*) AS n_edges FROM edges JOIN l{depth} a ON a.nid = src JOIN l{depth} b ON b.nid = dst AND a.qid = b.qid GROUP BY a.qid)
SELECT qid, n_nodes, coalesce(n_edges, 0) AS n_edges FROM (SELECT qid, count(*) AS n_nodes FROM l{depth} GROUP BY qid) LEFT JOIN inside USING (qid)"""


for _name, _depth, _types in (("subgraph_depth0", 0, None), ("subgraph_depth1", 1, None), ("subgraph_depth2", 2, None), ("subgraph_rel_filter", 2, ["CONTAINS"])):

    @query(_name, _subgraph_sql(_depth, "'CONTAINS'" if _types else None))
    def _subgraph(spark, sf_dir, depth=_depth, types=_types):
        nodes, inside = g.subgraph(fx.entities(spark, sf_dir), fx.relations(spark, sf_dir), _nations(spark, sf_dir), depth, types)
        return nodes.groupBy("qid").agg(F.count("*").alias("n_nodes")).join(inside.groupBy("qid").agg(F.count("*").alias("n_edges")), "qid", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def _paths_sql(depth: int, where: str = "") -> str:
    return f"""{_G.replace("WITH ", "WITH RECURSIVE ", 1)}, pairs AS (SELECT r_regionkey AS qid, 'Region::' || r_name AS src, 'Part::Part#1' AS dst FROM region),
walk AS (SELECT qid, [src] AS path, src AS at_, dst FROM pairs UNION ALL SELECT qid, list_append(path, e.dst), e.dst, w.dst FROM walk w JOIN edges e ON e.src = w.at_
  WHERE len(path) <= {depth} AND w.at_ <> w.dst AND NOT list_contains(path, e.dst) {where})
SELECT qid, array_to_string(path, '>') AS path, len(path) - 1 AS length FROM walk WHERE at_ = dst"""


for _name, _depth, _types, _where in (("find_path", 3, None, ""), ("find_path_depth_cap", 2, None, ""), ("find_path_filtered", 3, ["CONTAINS", "HAS_SUPPLIER"], "AND rel_type IN ('CONTAINS', 'HAS_SUPPLIER')")):

    @query(_name, _paths_sql(_depth, _where))
    def _paths(spark, sf_dir, depth=_depth, types=_types):
        pairs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("qid"), g.node_id(F.lit("Region"), F.col("r_name")).alias("src"), F.lit("Part::Part#1").alias("dst"))
        return g.find_paths(fx.relations(spark, sf_dir), pairs, depth, types).withColumn("path", F.array_join("path", ">"))


@query("graph_stats", f"{_G} SELECT (SELECT count(*) FROM entities) AS nodes, (SELECT count(*) FROM relations) AS edges")
def graph_stats(spark, sf_dir):
    return g.stats(fx.entities(spark, sf_dir), fx.relations(spark, sf_dir))


@query("stats_by_doc", f"{_G} SELECT doc_id, coalesce(e, 0) AS entities, coalesce(r, 0) AS relations FROM (SELECT src AS doc_id, count(*) AS e FROM entities WHERE src IS NOT NULL GROUP BY src) FULL JOIN (SELECT src AS doc_id, count(*) AS r FROM relations GROUP BY src) USING (doc_id)")
def stats_by_doc(spark, sf_dir):
    return g.stats_by_doc(fx.entities(spark, sf_dir), fx.relations(spark, sf_dir))


@query("entity_type_dist", f"{_G} SELECT entity_type, count(*) AS n FROM entities GROUP BY entity_type")
def entity_type_dist(spark, sf_dir):
    return g.distribution(fx.entities(spark, sf_dir), "entity_type")


@query("relation_type_dist", f"{_G} SELECT rel_type, count(*) AS n FROM relations GROUP BY rel_type")
def relation_type_dist(spark, sf_dir):
    return g.distribution(fx.relations(spark, sf_dir), "rel_type")


@query("verified_stats", f"{_G} SELECT count(*) FILTER (verified) AS verified, count(*) FILTER (NOT verified) AS unverified FROM entities")
def verified_stats(spark, sf_dir):
    return g.verified_stats(fx.entities(spark, sf_dir))


@query("low_confidence", f"{_G} SELECT count(*) FILTER (confidence < 0.5) AS low_confidence FROM entities")
def low_confidence(spark, sf_dir):
    return g.low_confidence(fx.entities(spark, sf_dir))


@query("source_gaps", f"{_G} SELECT count(*) FILTER (src IS NULL) AS without_source FROM entities")
def source_gaps(spark, sf_dir):
    return g.source_gaps(fx.entities(spark, sf_dir))


@query("orphans", f"{_G} SELECT entity_type, name FROM entities e WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = e.entity_type || '::' || e.name) AND NOT EXISTS (SELECT 1 FROM edges WHERE dst = e.entity_type || '::' || e.name)")
def orphans(spark, sf_dir):
    return g.orphans(fx.entities(spark, sf_dir), fx.relations(spark, sf_dir)).select("entity_type", "name")


def part_versions(spark, sf_dir) -> DataFrame:
    """Each part as two documents see it: the second differs for odd keys and is more complete for every third."""
    p = table(spark, sf_dir, "part")
    key, c = F.col("p_partkey"), F.col
    props = lambda m: F.map_filter(F.create_map(*[x for k, v in m.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    one = p.select(key, F.lit(1).alias("merge_seq"), F.array(F.lit("doc_a")).alias("source_doc_ids"), props({"brand": c("p_brand"), "type": c("p_type"), "size": c("p_size")}).alias("properties"), F.lit("a").alias("source_chapter"), F.lit(1.0).alias("confidence"))
    two = p.select(key, F.lit(2).alias("merge_seq"), F.array(F.lit("doc_b")).alias("source_doc_ids"), props({"brand": F.when(key % 2 == 1, F.concat("p_brand", F.lit("x"))).otherwise(F.col("p_brand")), "price": F.round("p_retailprice", 2).cast("long"), "note": F.when(key % 3 == 0, F.lit("n")), "more": F.when(key % 3 == 0, F.lit("m"))}).alias("properties"), F.when(key % 5 == 0, "b").otherwise("").alias("source_chapter"), F.lit(0.8).alias("confidence"))
    both = one.unionByName(two)
    return both.select(F.lit("Part").alias("entity_type"), F.concat(F.lit("Part#"), key.cast("string")).alias("name"), "merge_seq", "source_doc_ids", "properties", "source_chapter", "confidence", (key % 7 == 0).alias("verified"), F.lit(0).cast("long").alias("feedback_score"))


@query("merge_entities_2doc", """SELECT 'Part#' || p_partkey AS name, CASE WHEN p_partkey % 2 = 1 AND p_partkey % 3 = 0 THEN p_brand || 'x' ELSE p_brand END AS brand, p_type AS type, CAST(p_size AS VARCHAR) AS size,
CASE WHEN p_partkey % 3 = 0 THEN 'm' END AS more, 'doc_a,doc_b' AS docs, CASE WHEN p_partkey % 5 = 0 THEN 'b' ELSE 'a' END AS chapter, 0.8::DOUBLE AS confidence, p_partkey % 7 = 0 AS verified FROM part""")
def merge_entities_2doc(spark, sf_dir):
    merged, _ = g.merge_entities(part_versions(spark, sf_dir))
    prop = lambda k: F.try_element_at("properties", F.lit(k)).alias(k)
    return merged.select("name", prop("brand"), prop("type"), prop("size"), prop("more"), F.array_join("source_doc_ids", ",").alias("docs"), F.col("source_chapter").alias("chapter"), "confidence", "verified")


@query("merge_conflicts", "SELECT 'Part#' || p_partkey AS name, 'brand' AS property_key, p_brand AS old_value, p_brand || 'x' AS new_value, 'doc_b' AS doc_id, 3.0::DOUBLE AS old_completeness, CASE WHEN p_partkey % 3 = 0 THEN 4.0 ELSE 2.0 END AS new_completeness FROM part WHERE p_partkey % 2 = 1")
def merge_conflicts(spark, sf_dir):
    return g.merge_entities(part_versions(spark, sf_dir))[1].select("name", "property_key", "old_value", "new_value", "doc_id", "old_completeness", "new_completeness")


@query("merge_relations", f"{_G} SELECT from_type, from_name, to_type, to_name, rel_type, 'n,' || src AS docs FROM relations")
def merge_relations(spark, sf_dir):
    """Every relation twice, the second time with another type, which does not stay."""
    rels = fx.relations(spark, sf_dir).withColumns({"properties": F.create_map(F.lit("w"), F.lit("1")), "source_chapter": F.lit("")})
    again = rels.withColumns({"rel_type": F.lit("OTHER"), "source_doc_ids": F.array(F.lit("n")), "merge_seq": F.lit(2)})
    merged, _, _ = g.merge_relations(rels.withColumn("merge_seq", F.lit(1)).unionByName(again), fx.entities(spark, sf_dir))
    docs = F.concat(F.lit("n,"), F.array_join(F.array_remove("source_doc_ids", "n"), ","))
    return merged.select(*g.RELATION_KEY, "rel_type", docs.alias("docs"))


@query("merge_missing_endpoints", f"{_G} SELECT DISTINCT to_type AS entity_type, to_name AS name FROM relations WHERE to_type = 'Part'")
def merge_missing_endpoints(spark, sf_dir):
    """Relations over a graph that has no parts yet: the parts are named."""
    rels = fx.relations(spark, sf_dir).withColumns({"properties": F.create_map(F.lit("w"), F.lit("1")), "source_chapter": F.lit(""), "merge_seq": F.lit(1)})
    return g.merge_relations(rels, fx.entities(spark, sf_dir).where("entity_type <> 'Part'"))[2]


@query("remove_doc", f"{_G} SELECT 'entity' AS what, entity_type AS kind, count(*) AS n FROM entities WHERE src IS NULL OR src <> 'scm' GROUP BY entity_type UNION ALL SELECT 'relation', rel_type, count(*) FROM relations WHERE src <> 'scm' AND from_type NOT IN ('Supplier', 'Part') AND to_type NOT IN ('Supplier', 'Part') GROUP BY rel_type")
def remove_doc(spark, sf_dir):
    e, r = g.remove_document(fx.entities(spark, sf_dir), fx.relations(spark, sf_dir), "scm")
    return e.groupBy(F.lit("entity").alias("what"), F.col("entity_type").alias("kind")).agg(F.count("*").alias("n")).unionByName(r.groupBy(F.lit("relation").alias("what"), F.col("rel_type").alias("kind")).agg(F.count("*").alias("n")))


@query("update_entity", f"{_G} SELECT e.entity_type, e.name, CASE WHEN n.n_regionkey = 1 THEN 0.25 ELSE confidence END AS confidence, verified FROM entities e LEFT JOIN nation n ON e.entity_type = 'Nation' AND e.name = n_name")
def update_entity(spark, sf_dir):
    patches = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.lit("Nation").alias("entity_type"), F.col("n_name").alias("name"), F.lit(0.25).alias("confidence"), F.lit(None).cast("boolean").alias("verified"))
    return g.patch(fx.entities(spark, sf_dir), patches, g.ENTITY_KEY).select("entity_type", "name", "confidence", "verified")


@query("verify_entity", f"{_G} SELECT entity_type, count(*) FILTER (verified OR entity_type = 'Region') AS verified FROM entities GROUP BY entity_type")
def verify_entity(spark, sf_dir):
    keys = fx.entities(spark, sf_dir).where("entity_type = 'Region'")
    return g.verify(fx.entities(spark, sf_dir), keys).groupBy("entity_type").agg(F.count_if("verified").alias("verified"))


@query("delete_entity_cascade", f"{_G} SELECT (SELECT count(*) FROM entities WHERE entity_type <> 'Nation') AS nodes, (SELECT count(*) FROM relations WHERE from_type <> 'Nation' AND to_type <> 'Nation') AS edges")
def delete_entity_cascade(spark, sf_dir):
    gone = fx.entities(spark, sf_dir).where("entity_type = 'Nation'").select(*g.ENTITY_KEY)
    return g.stats(*g.delete_entities(fx.entities(spark, sf_dir), fx.relations(spark, sf_dir), gone))


@query("delete_relation", f"{_G} SELECT rel_type, count(*) AS n FROM relations WHERE rel_type <> 'SUPPLIES' GROUP BY rel_type")
def delete_relation(spark, sf_dir):
    rels = fx.relations(spark, sf_dir)
    gone = rels.where("rel_type = 'SUPPLIES'").select(*g.RELATION_KEY, "rel_type")
    return g.distribution(g.delete_relations(rels, gone), "rel_type")


@query("doc_properties_snapshot", "SELECT c_name AS name, c_mktsegment AS segment FROM customer")
def doc_properties_snapshot(spark, sf_dir):
    e = fx.entities(spark, sf_dir).where("entity_type = 'Customer'").withColumn("properties", F.create_map(F.lit("segment"), F.lit("merged")))
    return g.snapshot(e, "crm").select("name", F.try_element_at("properties", F.lit("segment")).alias("segment"))


@query("feedback_scores", f"WITH {fx.FEEDBACK_SQL} SELECT name, CAST(sum(rating) AS BIGINT) AS feedback_score FROM feedback GROUP BY name")
def feedback_scores(spark, sf_dir):
    fb = fx.feedback(spark, sf_dir)
    rated = fx.entities(spark, sf_dir).where("entity_type = 'Document'").join(fb, g.ENTITY_KEY, "left_semi")
    return g.apply_feedback(rated, fb, g.ENTITY_KEY).select("name", "feedback_score")


@query("property_completeness", "SELECT 'Customer' AS entity_type, c_name AS name, 2 AS score FROM customer")
def property_completeness(spark, sf_dir):
    return fx.entities(spark, sf_dir).where("entity_type = 'Customer'").select("entity_type", "name", g.completeness(F.col("properties")).alias("score"))


# -- bridge and explore ---------------------------------------------------------

_B = f"WITH {fx.BRIDGE_SQL}"


@query("bridge_build", f"{_B} SELECT * FROM bridge")
def bridge_build(spark, sf_dir):
    refs = fx.bridge(spark, sf_dir).groupBy("block_id").agg(F.collect_list(F.struct("entity_type", "name")).alias("refs"))
    return g.extract_refs(refs, id_col="block_id", refs_col="refs")


@query("blocks_by_entity", f"{_B} SELECT entity_type, name, count(DISTINCT block_id) AS blocks FROM bridge GROUP BY entity_type, name")
def blocks_by_entity(spark, sf_dir):
    return fx.bridge(spark, sf_dir).groupBy("entity_type", "name").agg(F.count("block_id").alias("blocks"))


@query("entities_by_block", f"{_B} SELECT block_id, count(*) FILTER (entity_type = 'Part') AS parts, count(*) FILTER (entity_type = 'Supplier') AS suppliers FROM bridge GROUP BY block_id")
def entities_by_block(spark, sf_dir):
    return fx.bridge(spark, sf_dir).groupBy("block_id").agg(F.count_if(F.col("entity_type") == "Part").alias("parts"), F.count_if(F.col("entity_type") == "Supplier").alias("suppliers"))


@query("bridge_detach", f"{_B} SELECT count(*) AS refs FROM bridge WHERE block_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def bridge_detach(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("block_id"))
    return g.detach(fx.bridge(spark, sf_dir), gone).agg(F.count("*").alias("refs"))


@query("bridge_attach", f"{_B} SELECT entity_type, count(*) AS refs FROM (SELECT * FROM bridge WHERE block_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT o_orderkey, 'Customer', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F') GROUP BY entity_type")
def bridge_attach(spark, sf_dir):
    fresh = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("block_id"), F.lit("Customer").alias("entity_type"), F.col("o_custkey").cast("string").alias("name"))
    return g.attach(fx.bridge(spark, sf_dir), fresh).groupBy("entity_type").agg(F.count("*").alias("refs"))


@query("find_chunks_by_entity", f"{_B} SELECT block_id, o_orderstatus AS doc_id FROM bridge JOIN orders ON o_orderkey = block_id WHERE entity_type = 'Part' AND name = 'Part#7'")
def find_chunks_by_entity(spark, sf_dir):
    hit = fx.bridge(spark, sf_dir).where("entity_type = 'Part' AND name = 'Part#7'")
    return hit.join(table(spark, sf_dir, "orders"), F.col("block_id") == F.col("o_orderkey")).select("block_id", F.col("o_orderstatus").alias("doc_id")).orderBy("doc_id", F.col("block_id").cast("string"))


@query("provenance", "SELECT l.doc_id, d.source, left(d.text, 500) AS preview FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic = 1")
def provenance(spark, sf_dir):
    """Where entities come from: their blocks with a preview of 500 characters."""
    named = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return fx.blocks(spark, sf_dir).join(named, "id").select("doc_id", "source", F.left("content", F.lit(500)).alias("preview"))


@query("explore_neighbors_deep", _subgraph_sql(2))
def explore_neighbors_deep(spark, sf_dir):
    """Neighbours beyond one step are a subgraph without a type filter."""
    nodes, inside = g.subgraph(fx.entities(spark, sf_dir), fx.relations(spark, sf_dir), _nations(spark, sf_dir), 2)
    return nodes.groupBy("qid").agg(F.count("*").alias("n_nodes")).join(inside.groupBy("qid").agg(F.count("*").alias("n_edges")), "qid", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


@query("node_id_parts", "SELECT 'Nation' AS kind, n_name || '::x' AS rest FROM nation")
def node_id_parts(spark, sf_dir):
    nid = g.node_id(F.lit("Nation"), F.concat("n_name", F.lit("::x")))
    kind, rest = g.node_parts(nid)
    return table(spark, sf_dir, "nation").select(kind.alias("kind"), rest.alias("rest"))


@query("graph_merge_fold", "SELECT 'B' AS value")
def graph_merge_fold(spark, sf_dir):
    """Three documents (A with score 1, A with score 5, B with score 3): B wins over the first holder of A."""
    more = {f"k{i}": "x" for i in range(5)}
    take = lambda n: dict(list(more.items())[:n])
    rows = [("T", "n", i + 1, [f"d{i + 1}"], {"v": v} | take(n - 1), "", 1.0, False, 0) for i, (v, n) in enumerate((("A", 1), ("A", 5), ("B", 3)))]
    versions = spark.createDataFrame(rows, "entity_type string, name string, merge_seq int, source_doc_ids array<string>, properties map<string,string>, source_chapter string, confidence double, verified boolean, feedback_score long")
    return g.merge_entities(versions)[0].select(F.col("properties")["v"].alias("value"))


@query("relation_dedup_key", f"{_G} SELECT from_type || '::' || from_name || '--' || rel_type || '--' || to_type || '::' || to_name AS k FROM relations WHERE rel_type = 'CONTAINS'")
def relation_dedup_key(spark, sf_dir):
    rels = fx.relations(spark, sf_dir).where("rel_type = 'CONTAINS'")
    return rels.select(F.concat_ws("--", g.node_id("from_type", "from_name"), "rel_type", g.node_id("to_type", "to_name")).alias("k"))
