"""Registered queries: status, audit, usage logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph import schema
from quillgraph.operators import extraction as ex
from quillgraph.operators import retrieval as r
from quillgraph.operators import status as st
from quillgraph.plans import fixtures as fx
from quillgraph.plans.registry import query
from quillgraph.session import table

_D = f"WITH {fx.DOCUMENTS_SQL}"
_L = f"WITH {fx.LOGS_SQL}"
_F = f"WITH {fx.FEEDBACK_SQL}"


@query("documents_by_status", f"{_D} SELECT s.status, count(docs.doc_id) AS n FROM (VALUES ('pending'), ('processing'), ('batch_submitted'), ('done'), ('failed')) s(status) LEFT JOIN docs ON docs.status = s.status GROUP BY s.status")
def documents_by_status(spark, sf_dir):
    return st.by_status(fx.documents(spark, sf_dir), schema.DOCUMENT_STATUSES)


def _blocks(spark, sf_dir):
    """Order lines as blocks of orders, with a state from the line."""
    state = F.when(F.col("l_returnflag") == "A", "failed").when(F.col("l_linestatus") == "F", "embedded").otherwise("pending")
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq_index"), state.alias("status"))


_BLOCKS = "blocks AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_orderkey AS doc_id, l_linenumber AS seq_index, CASE WHEN l_returnflag = 'A' THEN 'failed' WHEN l_linestatus = 'F' THEN 'embedded' ELSE 'pending' END AS status FROM lineitem)"


@query("blocks_by_status", f"WITH {_BLOCKS} SELECT s.status, count(blocks.id) AS n FROM (VALUES ('pending'), ('embedded'), ('done'), ('failed')) s(status) LEFT JOIN blocks ON blocks.status = s.status GROUP BY s.status")
def blocks_by_status(spark, sf_dir):
    return st.by_status(_blocks(spark, sf_dir))


@query("blocks_by_doc_status", f"WITH {_BLOCKS} SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'embedded') AS embedded, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM blocks GROUP BY doc_id")
def blocks_by_doc_status(spark, sf_dir):
    return st.pivoted_status(_blocks(spark, sf_dir), "doc_id", schema.BLOCK_STATUSES)


@query("pending_blocks", f"WITH {_BLOCKS} SELECT id, doc_id, seq_index FROM blocks WHERE status = 'pending' ORDER BY doc_id, seq_index, id LIMIT 20")
def pending_blocks(spark, sf_dir):
    return st.top(_blocks(spark, sf_dir).where("status = 'pending'"), 20, F.col("doc_id"), F.col("seq_index"), F.col("id")).select("id", "doc_id", "seq_index")


@query("list_documents", f"{_D} SELECT doc_id, title, status FROM docs ORDER BY doc_id DESC")
def list_documents(spark, sf_dir):
    return fx.documents(spark, sf_dir).select("doc_id", "title", "status").orderBy(F.desc("doc_id"))


@query("failed_documents", f"{_D} SELECT doc_id, title FROM docs WHERE status = 'failed' ORDER BY doc_id DESC LIMIT 100")
def failed_documents(spark, sf_dir):
    return st.top(fx.documents(spark, sf_dir).where("status = 'failed'"), 100, F.desc("doc_id")).select("doc_id", "title")


@query("upsert_documents", "SELECT source AS source_path, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source")
def upsert_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("source_path"), "doc_id", "lang")
    return ex.latest(d, ["source_path"], "doc_id")


@query("update_status", f"{_D} SELECT doc_id, CASE WHEN status = 'pending' THEN 'processing' ELSE status END AS status FROM docs")
def update_status(spark, sf_dir):
    return fx.documents(spark, sf_dir).select("doc_id", F.when(F.col("status") == "pending", "processing").otherwise(F.col("status")).alias("status"))


@query("documents_status", f"{_D}, v AS (SELECT vec_id FROM embeddings) SELECT doc_id, status, 1 AS blocks, CASE WHEN vec_id IS NULL THEN 0 ELSE 1 END AS vectors, coalesce(quality + toxic, 0) AS entities, coalesce(toxic, 0) AS relations FROM docs LEFT JOIN v ON vec_id = doc_id LEFT JOIN labels USING (doc_id)")
def documents_status(spark, sf_dir):
    counts = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("entities"), F.col("toxic").alias("relations"))
    return st.documents_status(fx.documents(spark, sf_dir), fx.blocks(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), counts)


@query("vectors_status", "WITH e AS (SELECT count(*) AS embedded FROM labels WHERE quality = 1), v AS (SELECT count(*) AS vectors FROM embeddings) SELECT embedded, vectors, vectors - embedded AS delta, vectors = embedded AS consistent FROM e, v")
def vectors_status(spark, sf_dir):
    return st.vectors_status(fx.documents(spark, sf_dir), table(spark, sf_dir, "embeddings"))


@query("vectors_by_doc", "SELECT doc_id, count(*) AS vectors FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY doc_id")
def vectors_by_doc(spark, sf_dir):
    return st.vectors_by_doc(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), fx.blocks(spark, sf_dir))


def _stages(spark, sf_dir):
    """The latest event of each user and stage, from all events: failed if its value is very low."""
    e = table(spark, sf_dir, "events")
    stage = F.get(F.array(*[F.lit(s) for s in schema.STAGES]), (F.col("event_id") % 6).cast("int"))
    rows = e.select(F.col("user_id").alias("doc_id"), stage.alias("stage"), F.col("event_id").alias("seq"), F.when(F.col("value") < 5, "failed").otherwise("done").alias("status"))
    return ex.latest(rows, ["doc_id", "stage"], "seq")


_STAGES = """stages AS (SELECT doc_id, stage, arg_max(status, seq) AS status FROM (SELECT user_id AS doc_id, event_id % 6 AS stage, event_id AS seq, CASE WHEN value < 5 THEN 'failed' ELSE 'done' END AS status FROM events) GROUP BY doc_id, stage)"""


@query("pipeline_stages", f"WITH {_STAGES} SELECT doc_id, ['parse', 'build', 'submit', 'ingest', 'build_embed', 'embed'][stage + 1] AS stage, status FROM stages")
def pipeline_stages(spark, sf_dir):
    return _stages(spark, sf_dir).select("doc_id", "stage", "status")


@query("final_doc_status", f"WITH {_STAGES}, u AS (SELECT DISTINCT user_id AS doc_id FROM events) SELECT u.doc_id, CASE WHEN coalesce(bool_or(status = 'failed'), false) THEN 'failed' WHEN count(*) FILTER (status = 'done') = 6 THEN 'done' ELSE 'processing' END AS status FROM u LEFT JOIN stages s USING (doc_id) GROUP BY u.doc_id")
def final_doc_status(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct()
    return st.final_status(_stages(spark, sf_dir), users)


@query("pipeline_flags", f"{_D} SELECT doc_id, true AS parsed, true AS batches_built, coalesce(quality + toxic, 0) > 0 AS extracted, false AS embedded, status = 'done' AND vec_id IS NOT NULL AS embedded_or_done, status = 'done' AS done FROM docs LEFT JOIN labels USING (doc_id) LEFT JOIN embeddings ON vec_id = doc_id")
def pipeline_flags(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    blocks = fx.blocks(spark, sf_dir).join(docs.select("doc_id", "status"), "doc_id")
    counts = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("entities"), F.col("toxic").alias("relations"))
    return st.pipeline_flags(docs, blocks, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), counts)


@query("document_progress", f"WITH {_BLOCKS} SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'embedded') AS embedded, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM blocks GROUP BY doc_id")
def document_progress(spark, sf_dir):
    return st.pivoted_status(_blocks(spark, sf_dir), "doc_id", schema.BLOCK_STATUSES)


@query("quality_score", "WITH i AS (SELECT (SELECT count(*) FROM labels WHERE quality = 0 AND toxic = 1) AS failed, (SELECT count(*) FROM labels WHERE doc_id < 0) AS pending, NULL AS low) SELECT (CASE WHEN failed > 0 THEN 1 ELSE 0 END) + (CASE WHEN pending > 0 THEN 1 ELSE 0 END) AS issues, greatest(0, 100 - 5 * ((CASE WHEN failed > 0 THEN 1 ELSE 0 END) + (CASE WHEN pending > 0 THEN 1 ELSE 0 END)) - failed - pending) AS score FROM i")
def quality_score(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    counts = labels.agg(F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("failed"), F.count_if(F.col("doc_id") < 0).alias("pending"), F.lit(None).cast("long").alias("low"))
    return st.quality_score(counts)


@query("feedback_stats", f"{_F} SELECT count(*) AS total, round(avg(rating), 2) AS average, count(*) FILTER (rating <= 0) AS low FROM feedback")
def feedback_stats(spark, sf_dir):
    return st.feedback_stats(fx.feedback(spark, sf_dir))


@query("entity_feedback", f"{_F} SELECT d.doc_id, coalesce(sum(rating), 0)::BIGINT AS score FROM documents d LEFT JOIN feedback f ON f.name = CAST(d.doc_id AS VARCHAR) GROUP BY d.doc_id")
def entity_feedback(spark, sf_dir):
    scores = fx.feedback(spark, sf_dir).groupBy("name").agg(F.sum("rating").alias("s"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"))
    return d.join(scores, "name", "left").select("doc_id", F.coalesce("s", F.lit(0)).alias("score"))


@query("low_ratings", f"{_F} SELECT name, rating, count(*) AS n FROM feedback WHERE rating <= 0 GROUP BY name, rating")
def low_ratings(spark, sf_dir):
    return fx.feedback(spark, sf_dir).where("rating <= 0").groupBy("name", "rating").agg(F.count("*").alias("n"))


_C = "conflicts AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'Register' ELSE 'Signal' END AS entity_type, 'u' || user_id AS name, ts AS timestamp FROM events)"


def _conflicts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "Register").otherwise("Signal").alias("entity_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.col("ts").alias("timestamp"))


@query("conflicts_recent", f"WITH {_C} SELECT id, entity_type, name FROM conflicts ORDER BY timestamp DESC, id DESC LIMIT 100")
def conflicts_recent(spark, sf_dir):
    return st.top(_conflicts(spark, sf_dir), 100, F.desc("timestamp"), F.desc("id")).select("id", "entity_type", "name")


@query("conflicts_filtered", f"WITH {_C} SELECT id, name FROM conflicts WHERE entity_type = 'Register' ORDER BY timestamp DESC, id DESC LIMIT 100")
def conflicts_filtered(spark, sf_dir):
    return st.top(_conflicts(spark, sf_dir).where("entity_type = 'Register'"), 100, F.desc("timestamp"), F.desc("id")).select("id", "name")


@query("conflicts_status", f"WITH {_C}, r AS (SELECT * FROM conflicts ORDER BY timestamp DESC, id DESC LIMIT 500) SELECT entity_type, name, count(*) AS n FROM r GROUP BY ALL ORDER BY n DESC, entity_type, name LIMIT 20")
def conflicts_status(spark, sf_dir):
    return st.recent_conflicts(_conflicts(spark, sf_dir), 500, 20)


@query("conflict_rows", "SELECT 'Relation[SUPPLIES]' AS entity_type, 'Supplier::' || l_suppkey || ' -> Part::' || l_partkey AS name, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey")
def conflict_rows(spark, sf_dir):
    """Relation conflicts as flat log rows."""
    flat = F.concat(F.lit("Supplier::"), F.col("l_suppkey").cast("string"), F.lit(" -> Part::"), F.col("l_partkey").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(F.lit("Relation[SUPPLIES]").alias("entity_type"), flat.alias("name")).agg(F.count("*").alias("n"))


@query("headings_status", "SELECT role AS heading, count(*) AS n, count(DISTINCT conv_id) AS docs FROM conversations GROUP BY role")
def headings_status(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("heading")).agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("docs"))


@query("usage_trace", f"{_L} SELECT session_id, id, tool_name, n FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS n FROM logs) WHERE n <= 50")
def usage_trace(spark, sf_dir):
    return st.trace_each(fx.usage_logs(spark, sf_dir), 50).select("session_id", "id", "tool_name", "n")


@query("usage_report", f"{_L} SELECT tool_name, count(*) AS calls, count(DISTINCT session_id) AS sessions FROM logs GROUP BY tool_name")
def usage_report(spark, sf_dir):
    return fx.usage_logs(spark, sf_dir).groupBy("tool_name").agg(F.count("*").alias("calls"), F.countDistinct("session_id").alias("sessions"))


@query("block_activation", f"{_L} SELECT block_id, count(*) AS hit_count, min(created_at) AS first_hit_at, max(created_at) AS last_hit_at FROM logs WHERE block_id IS NOT NULL GROUP BY block_id")
def block_activation(spark, sf_dir):
    return st.block_activation(fx.usage_logs(spark, sf_dir))


for _name, _cold in (("usage_report_hot", False), ("usage_report_cold", True)):

    @query(_name, f"{_L} SELECT block_id, count(*) AS hit_count FROM logs WHERE block_id IS NOT NULL GROUP BY block_id ORDER BY hit_count {'ASC' if _cold else 'DESC'}, block_id LIMIT 20")
    def _hot(spark, sf_dir, cold=_cold):
        return st.hot_blocks(st.block_activation(fx.usage_logs(spark, sf_dir)), 20, cold).select("block_id", "hit_count")


@query("usage_cleanup", f"{_L}, m AS (SELECT max(created_at) AS now_ FROM logs) SELECT id FROM logs, m WHERE created_at >= now_ - INTERVAL 10 DAY ORDER BY created_at DESC, id DESC LIMIT 1000")
def usage_cleanup(spark, sf_dir):
    return st.cleaned_logs(fx.usage_logs(spark, sf_dir), 10, 1000).select("id")


@query("usage_unused_entities", f"WITH {fx.ENTITIES_SQL} SELECT entity_type, name FROM entities WHERE entity_type = 'Document' AND name NOT IN (SELECT json_extract_string(props, '$.k') FROM events)")
def usage_unused_entities(spark, sf_dir):
    hits = fx.usage_logs(spark, sf_dir).select(F.lit("Document").alias("entity_type"), F.col("block_id").cast("string").alias("name")).distinct()
    return st.unused(fx.entities(spark, sf_dir).where("entity_type = 'Document'"), hits).select("entity_type", "name")


@query("usage_entity_hits", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'Module::m' || user_id ELSE 'Module::m' || user_id || ',Signal::s' END AS hits FROM events")
def usage_entity_hits(spark, sf_dir):
    e = lambda t, n: F.struct(t.alias("entity_type"), n.alias("name"))
    name = F.concat(F.lit("m"), F.col("user_id").cast("string"))
    listed = F.array(e(F.lit("Module"), name), e(F.lit("Module"), name), e(F.when(F.col("event_id") % 3 == 0, "").otherwise("Signal"), F.lit("s")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.array_join(st.entity_hits(listed), ",").alias("hits"))


@query("relation_feedback", "SELECT l_suppkey, l_partkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS BIGINT) AS score FROM lineitem GROUP BY l_suppkey, l_partkey")
def relation_feedback(spark, sf_dir):
    """Sum of ratings of each relation, by its two ends and type."""
    rated = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("rating"))
    return rated.groupBy("l_suppkey", "l_partkey").agg(F.sum("rating").alias("score"))


@query("embedded_batch", "SELECT d.doc_id, CASE WHEN e.vec_id IS NULL THEN 'pending' ELSE 'embedded' END AS status, coalesce(len(e.embedding), 0) AS dims FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def embedded_batch(spark, sf_dir):
    """Blocks with the vectors of a batch: those that have one are embedded."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    out = fx.blocks(spark, sf_dir).join(v, "id", "left")
    return out.select("doc_id", F.when(F.col("embedding").isNull(), "pending").otherwise("embedded").alias("status"), F.coalesce(F.size("embedding"), F.lit(0)).cast("long").alias("dims"))


@query("delete_doc_blocks", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_doc_blocks(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return fx.blocks(spark, sf_dir).join(gone, "doc_id", "left_anti").select("doc_id")


@query("blocks_of_document", f"WITH {_BLOCKS} SELECT doc_id, string_agg(CAST(seq_index AS VARCHAR), ',' ORDER BY seq_index) AS seqs FROM blocks GROUP BY doc_id")
def blocks_of_document(spark, sf_dir):
    """Every document's blocks in order."""
    seqs = F.array_sort(F.collect_list("seq_index"))
    return _blocks(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(seqs, lambda x: x.cast("string")), ",").alias("seqs"))


@query("eval_dataset", "SELECT item_id, text AS question, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS truth FROM (SELECT b.item_id, b.text, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) GROUP BY item_id, text")
def eval_dataset(spark, sf_dir):
    """Questions with the documents that answer them."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    truth = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    met = r.containing(table(spark, sf_dir, "documents"), items).groupBy("qid").agg(truth.alias("truth"))
    return met.join(items, "qid").select(F.col("qid").alias("item_id"), "question", "truth")


@query("usage_vector_hits", "SELECT session_id, string_agg(DISTINCT CAST(block_id AS VARCHAR), ',' ORDER BY CAST(block_id AS VARCHAR)) AS hits FROM (SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS block_id FROM events) WHERE block_id IS NOT NULL GROUP BY session_id")
def usage_vector_hits(spark, sf_dir):
    """Blocks that each session hit."""
    hits = F.array_join(F.array_sort(F.collect_set(F.col("block_id").cast("string"))), ",")
    return fx.usage_logs(spark, sf_dir).where("block_id is not null").groupBy("session_id").agg(hits.alias("hits"))


@query("graph_status", f"WITH {fx.ENTITIES_SQL}, {fx.RELATIONS_SQL} SELECT (SELECT count(*) FROM entities) AS nodes, (SELECT count(*) FROM relations) AS edges, (SELECT count(*) FILTER (verified) FROM entities) AS verified, (SELECT count(*) FILTER (confidence < 0.5) FROM entities) AS low_confidence, (SELECT count(*) FILTER (src IS NULL) FROM entities) AS without_source, (SELECT count(*) FROM entities WHERE entity_type = 'Document') AS orphans")
def graph_status(spark, sf_dir):
    """All counts of the graph in one row."""
    from quillgraph.operators import graph as g

    e, rel = fx.entities(spark, sf_dir), fx.relations(spark, sf_dir)
    out = g.stats(e, rel)
    for part in (g.verified_stats(e).select("verified"), g.low_confidence(e), g.source_gaps(e), g.orphans(e, rel).agg(F.count("*").alias("orphans"))):
        out = out.join(part, F.lit(True))
    return out
