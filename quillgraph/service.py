"""A knowledge base as a folder of tables, and the verbs over it: ingest, search, explore, read, status, evaluate, upkeep.

Tables are Parquet snapshots: a write makes a new snapshot folder and then moves the
table's pointer file, so readers see the old or the new one and never a part.  Each
verb takes and returns DataFrames; one query is a batch of one row.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import schema
from quillgraph.functions.text import short_hash, summarized
from quillgraph.operators import evaluation as ev
from quillgraph.operators import extraction as ex
from quillgraph.operators import graph as g
from quillgraph.operators import markdown as md
from quillgraph.operators import retrieval as r
from quillgraph.operators import status as st

_GRAPH = "properties map<string,string>, doc_properties map<string,map<string,string>>, source_doc_ids array<string>, source_chapter string, confidence double, verified boolean, feedback_score long"
TABLES = {
    "documents": "doc_id string, title string, source_path string, file_type string, file_hash string, status string, extracted_at timestamp",
    "blocks": "id long, doc_id string, block_id string, seq_index long, section_title string, content string, content_hash string, status string",
    "heading_maps": "doc_id string, heading_title string, heading_level long, parent_heading string, block_ids array<string>",
    "vectors": "id long, embedding array<float>",
    "entities": f"entity_type string, name string, {_GRAPH}",
    "relations": f"from_type string, from_name string, to_type string, to_name string, rel_type string, {_GRAPH}",
    "bridge": "block_id long, entity_type string, name string",
    "conflicts": "id long, entity_type string, name string, property_key string, old_value string, new_value string, timestamp timestamp, doc_id string",
    "feedback": "entity_type string, name string, rating int, comment string, created_at timestamp",
    "usage_logs": "id string, session_id string, tool_name string, params string, block_id long, elapsed_ms double, created_at timestamp",
    "stages": "doc_id string, stage string, status string, error_message string, updated_at timestamp",
}
SEARCH_MODES = ("semantic", "keyword", "hybrid", "rerank")
SCOPES = ("documents", "documents_by_status", "vectors", "graph", "entity_types", "relation_types", "blocks", "blocks_by_doc", "headings", "conflicts", "feedback", "quality", "ingest_pipeline", "pipeline", "trace", "usage")
EXPLORE_MODES = ("entity", "neighbors", "subgraph", "path", "provenance", "conflicts")


class KnowledgeBase:
    """Tables below ``path`` and the verbs over them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # -- tables

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointer(self, name: str) -> str | None:
        fs, p = self._fs(f"{self.path}/{name}.current")
        if not fs.exists(p):
            return None
        return self.spark.read.text(f"{self.path}/{name}.current").first()[0]

    def table(self, name: str) -> DataFrame:
        """The current snapshot; an empty table if there is none."""
        at = self._pointer(name)
        if at is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/{at}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Make ``rows`` the table's snapshot."""
        fields = [f.split()[0] for f in _fields(TABLES[name])]
        missing = {f: F.lit(None) for f in fields if f not in rows.columns}
        at = f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        typed = rows.withColumns(missing).select(*[F.col(f.split()[0]).cast(f.split(None, 1)[1]).alias(f.split()[0]) for f in _fields(TABLES[name])])
        typed.write.parquet(f"{self.path}/{name}/{at}")
        fs, p = self._fs(f"{self.path}/{name}.current")
        fresh = self._fs(f"{self.path}/{name}.next-{at}")[1]
        out = fs.create(fresh, True)
        out.write(bytearray(at.encode()))
        out.close()
        self._swap(fs.makeQualified(fresh), fs.makeQualified(p))

    def _swap(self, fresh, p) -> None:
        """Rename over the pointer in one step, so that a reader finds the old or the new snapshot at any time."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, p, how)

    def append(self, name: str, rows: DataFrame) -> None:
        self.replace(name, self.table(name).unionByName(rows, allowMissingColumns=True))

    # -- ingest

    def ingest(self, files: DataFrame, lossless: bool = False) -> DataFrame:
        """Add Markdown documents (source_path, text); a path that is known is replaced.  Returns doc_id and block count.

        Stages are recorded; vectors and extractions come later with ``add_vectors``
        and ``add_extractions``.
        """
        docs = files.select("source_path", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["source_path"])
        docs = docs.withColumn("file_hash", F.md5(F.col("text").cast("binary"))).withColumn("doc_id", short_hash(F.concat("source_path", F.lit("\n"), "text")))
        title = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"(.)\.[^.]*$", "$1")
        new = docs.select("doc_id", title.alias("title"), "source_path", F.lit("md").alias("file_type"), "file_hash", F.lit("processing").alias("status"), F.current_timestamp().alias("extracted_at"))
        old = self.table("documents")
        gone = old.join(new.select("source_path"), "source_path", "left_semi").select("doc_id").join(new.select("doc_id"), "doc_id", "left_anti")
        built = md.content_blocks(docs, lossless=lossless)
        # An id from document and block: stable over runs, and no sort over all blocks.
        blocks = built.withColumns({"id": F.xxhash64("doc_id", "block_id").bitwiseAND(F.lit((1 << 62) - 1)), "content_hash": short_hash(F.col("content")), "status": F.lit("pending")})
        maps = md.heading_maps(docs, lossless=lossless)
        stages = new.select("doc_id", F.explode(F.array(*[F.lit(s) for s in schema.STAGES[:2]])).alias("stage"), F.lit("done").alias("status"), F.current_timestamp().alias("updated_at"))
        ids = new.select("doc_id").unionByName(gone)
        for name, fresh in (("blocks", blocks), ("heading_maps", maps), ("stages", stages)):
            self.replace(name, self.table(name).join(ids, "doc_id", "left_anti").unionByName(fresh, allowMissingColumns=True))
        self.replace("documents", old.join(new.select("source_path"), "source_path", "left_anti").unionByName(new))
        return self.table("blocks").join(new.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("blocks"))

    def add_vectors(self, vectors: DataFrame) -> None:
        """Vectors (id, embedding) of blocks; ids that have one keep it."""
        have = self.table("vectors")
        fresh = vectors.dropDuplicates(["id"]).join(have.select("id"), "id", "left_anti")
        self.append("vectors", fresh.select("id", "embedding"))
        now = self.table("vectors").select("id").withColumn("has", F.lit(True))
        blocks = self.table("blocks").join(now, "id", "left").withColumn("status", F.when(F.col("has"), "embedded").otherwise(F.col("status"))).drop("has")
        self.replace("blocks", blocks)

    def add_extractions(self, entities: DataFrame, relations: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """Merge versions of entities and relations (with doc_id and merge_seq) into the graph; returns the conflicts."""
        empty = {"source_chapter": F.lit(""), "confidence": F.lit(1.0), "verified": F.lit(False), "feedback_score": F.lit(0).cast("long")}

        def versions(fresh: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
            rows = fresh.withColumns({k: v for k, v in empty.items() if k not in fresh.columns} | {"source_doc_ids": F.array("doc_id")})
            old = have.withColumn("merge_seq", F.lit(-1).cast("long"))
            cols = [*keys, "merge_seq", "source_doc_ids", "properties", *empty]
            return old.select(*cols).unionByName(rows.select(*cols))

        e, conflicts = g.merge_entities(versions(entities, self.table("entities"), g.ENTITY_KEY))
        rel, more, ends = g.merge_relations(versions(relations, self.table("relations"), [*g.RELATION_KEY, "rel_type"]), e)
        self.replace("relations", rel)
        self.replace("entities", e.unionByName(ends, allowMissingColumns=True).withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "verified": F.coalesce("verified", F.lit(False)), "feedback_score": F.coalesce("feedback_score", F.lit(0))}))
        flat = more.select(F.lit("Relation").alias("entity_type"), F.concat(g.node_id("from_type", "from_name"), F.lit(" -> "), g.node_id("to_type", "to_name")).alias("name"), "property_key", "old_value", "new_value", "doc_id")
        every = conflicts.select("entity_type", "name", "property_key", "old_value", "new_value", "doc_id").unionByName(flat).withColumns({"timestamp": F.current_timestamp(), "id": F.xxhash64("entity_type", "name", "property_key", "old_value", "new_value", "doc_id")})
        self.append("conflicts", every)
        if refs is not None:
            self.replace("bridge", g.attach(self.table("bridge"), refs.select("block_id", "entity_type", "name")))
        return every

    # -- search and read

    def search(self, queries: DataFrame, mode: str = "hybrid", top_k: int = 5, scorer: Callable[[DataFrame], DataFrame] | None = None, candidate_k: int | None = None, session_id: str | None = None) -> DataFrame:
        """(qid, id, rank, score, content) for queries (qid, text, embedding); rerank needs a scorer that adds ``rerank_score``."""
        if mode not in SEARCH_MODES:
            raise ValueError(f"mode must be one of {', '.join(SEARCH_MODES)}")
        began = time.time()
        blocks, vectors = self.table("blocks"), self.table("vectors")
        if mode == "semantic":
            hits = r.vector_search(vectors, queries, top_k)
        elif mode == "keyword":
            hits = r.bm25_search(blocks, queries, top_k)
        else:
            hits = r.hybrid_search(blocks, vectors, queries, top_k if mode == "hybrid" else candidate_k or 4 * top_k)
        found = r.with_blocks(hits, blocks)
        if mode == "rerank":
            found = r.rerank(found, scorer, top_k)
        if session_id is not None:
            self.log("search", {"mode": mode, "top_k": str(top_k)}, session_id, found.select(F.col("id").alias("block_id")), began)
        return found

    def related(self, hits: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        """Graph nodes and relations around hits (qid, id)."""
        return g.context_of_hits(hits, self.table("bridge"), self.table("entities"), self.table("relations"), depth)

    def read(self, doc_id: str, chapter: str | None = None, regex: str | None = None, concept: str | None = None, top_k: int = 10) -> DataFrame:
        """Blocks of a document by chapter title, title pattern or entity name, in that precedence; joined in order as ``content``."""
        blocks = self.table("blocks").where(F.col("doc_id") == doc_id)
        maps = self.table("heading_maps").where(F.col("doc_id") == doc_id)
        if chapter is not None:
            blocks = md.blocks_of(md.like_heading(maps, chapter), blocks)
        elif regex is not None:
            blocks = md.blocks_of(maps.where(F.col("heading_title").rlike(regex)), blocks)
        elif concept is not None:
            blocks = blocks.join(self.table("bridge").where(F.col("name") == concept).select(F.col("block_id").alias("id")), "id", "left_semi")
        picked = blocks.orderBy("seq_index").limit(top_k)
        return picked.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_index", "content"))), lambda x: x["content"]), "\n\n---\n\n").alias("content"), F.count("*").alias("blocks"))

    # -- explore

    def explore(self, mode: str, **p) -> DataFrame | tuple[DataFrame, DataFrame]:
        """Look-ups in the graph by mode: entity, neighbors, subgraph, path, provenance, conflicts."""
        e, rel = self.table("entities"), self.table("relations")
        kind, name = p.get("entity_type"), p.get("name")
        if mode == "entity":
            if kind and name:
                return e.where((F.col("entity_type") == kind) & (F.col("name") == name))
            return g.find_entities(e, p.get("pattern", ""), [kind] if kind else None)
        if mode in ("neighbors", "subgraph"):
            depth = int(p.get("depth", 1))
            center = self.spark.createDataFrame([(0, kind, name)], "qid long, entity_type string, name string")
            if mode == "neighbors":
                if depth <= 0:
                    raise ValueError("depth must be positive")
                if depth == 1:
                    return g.neighbors(rel, center, p.get("direction", "both"), p.get("rel_type")).join(e, g.ENTITY_KEY)
                return g.subgraph(e, rel, center, depth)
            return g.subgraph(e, rel, center, depth, p.get("rel_types"))
        if mode == "path":
            pairs = self.spark.createDataFrame([(0, f"{p['from_type']}::{p['from_name']}", f"{p['to_type']}::{p['to_name']}")], "qid long, src string, dst string")
            return g.find_paths(rel, pairs, int(p.get("max_depth", 3)))
        if mode == "provenance":
            named = self.table("bridge").where((F.col("entity_type") == kind) & (F.col("name") == name)).select(F.col("block_id").alias("id"))
            return self.table("blocks").join(named, "id", "left_semi").select("doc_id", "section_title", "block_id", F.left("content", F.lit(500)).alias("preview"))
        if mode == "conflicts":
            c = self.table("conflicts")
            for column in ("entity_type", "name", "doc_id"):
                if p.get(column):
                    c = c.where(F.col(column) == p[column])
            return st.top(c, int(p.get("limit", 100)), F.desc("timestamp"), F.desc("id"))
        raise ValueError(f"mode must be one of {', '.join(EXPLORE_MODES)}")

    # -- upkeep

    def upsert_entity(self, rows: DataFrame) -> None:
        """Replace given fields of known entities, add new ones."""
        e = self.table("entities")
        known = rows.join(e.select(*g.ENTITY_KEY), g.ENTITY_KEY, "left_semi")
        new = rows.join(e.select(*g.ENTITY_KEY), g.ENTITY_KEY, "left_anti")
        self.replace("entities", g.patch(e, known, g.ENTITY_KEY).unionByName(new, allowMissingColumns=True))

    def delete_entities(self, rows: DataFrame) -> None:
        e, rel = g.delete_entities(self.table("entities"), self.table("relations"), rows.select(*g.ENTITY_KEY))
        self.replace("relations", rel)
        self.replace("entities", e)

    def upsert_relation(self, rows: DataFrame) -> None:
        keys = [*g.RELATION_KEY, "rel_type"]
        rel = self.table("relations")
        known = rows.join(rel.select(*keys), keys, "left_semi")
        new = rows.join(rel.select(*g.RELATION_KEY), g.RELATION_KEY, "left_anti")
        self.replace("relations", g.patch(rel, known, keys).unionByName(new, allowMissingColumns=True))

    def delete_relations(self, rows: DataFrame) -> None:
        self.replace("relations", g.delete_relations(self.table("relations"), rows.select(*g.RELATION_KEY, "rel_type")))

    def verify(self, rows: DataFrame) -> None:
        self.replace("entities", g.verify(self.table("entities"), rows))

    def remove_document(self, doc_id: str) -> None:
        """Take a document and all that only it gave out of every table."""
        e, rel = g.remove_document(self.table("entities"), self.table("relations"), doc_id)
        gone = self.table("blocks").where(F.col("doc_id") == doc_id).select("id")
        self.replace("vectors", self.table("vectors").join(gone, "id", "left_anti"))
        self.replace("bridge", g.detach(self.table("bridge"), gone.select(F.col("id").alias("block_id"))))
        self.replace("relations", rel)
        self.replace("entities", e)
        for name in ("heading_maps", "stages", "blocks", "documents"):
            self.replace(name, self.table(name).where(F.col("doc_id") != doc_id))

    def submit_feedback(self, rows: DataFrame) -> None:
        """Ratings of 1 or -1; scores of the entities follow."""
        if rows.where(~F.col("rating").isin(1, -1)).limit(1).count():
            raise ValueError("rating must be 1 or -1")
        self.append("feedback", rows.withColumn("created_at", F.current_timestamp()))
        self.replace("entities", g.apply_feedback(self.table("entities"), self.table("feedback"), g.ENTITY_KEY))

    # -- logs

    def log(self, tool: str, params: dict[str, str], session_id: str, hits: DataFrame, began: float) -> None:
        """A log row for each block that a call hit, or one without a block."""
        call = uuid.uuid4().hex
        cut = F.to_json(F.create_map(*[x for k, v in params.items() for x in (F.lit(k), summarized(F.lit(v)))])) if params else F.lit("{}")
        base = self.spark.range(1).select(F.lit(call).alias("id"), F.lit(session_id).alias("session_id"), F.lit(tool).alias("tool_name"), cut.alias("params"), F.lit((time.time() - began) * 1000).alias("elapsed_ms"), F.current_timestamp().alias("created_at"))
        self.append("usage_logs", base.join(hits.select("block_id").distinct(), F.lit(True), "left"))

    def clean_logs(self, days: int = 30, most: int = 10_000) -> None:
        self.replace("usage_logs", st.cleaned_logs(self.table("usage_logs"), days, most))

    # -- status and evaluation

    def status(self, scope: str = "documents", top_n: int = 20, session_id: str | None = None) -> DataFrame:
        """A table for each scope."""
        t = self.table
        by_doc = lambda: g.stats_by_doc(t("entities"), t("relations"))
        scopes: dict[str, Callable[[], DataFrame]] = {
            "documents": lambda: st.documents_status(t("documents"), t("blocks"), t("vectors"), by_doc()),
            "documents_by_status": lambda: st.by_status(t("documents"), schema.DOCUMENT_STATUSES),
            "vectors": lambda: st.vectors_status(t("blocks"), t("vectors")),
            "graph": lambda: g.stats(t("entities"), t("relations")),
            "entity_types": lambda: g.distribution(t("entities"), "entity_type"),
            "relation_types": lambda: g.distribution(t("relations"), "rel_type"),
            "blocks": lambda: st.by_status(t("blocks")),
            "blocks_by_doc": lambda: st.pivoted_status(t("blocks"), "doc_id", schema.BLOCK_STATUSES),
            "headings": lambda: t("heading_maps").groupBy("heading_level").agg(F.count("*").alias("n")),
            "conflicts": lambda: st.recent_conflicts(t("conflicts"), 500, top_n),
            "feedback": lambda: st.feedback_stats(t("feedback")),
            "quality": lambda: st.quality_score(self._issues()),
            "ingest_pipeline": lambda: st.pipeline_flags(t("documents"), t("blocks"), t("vectors"), by_doc()),
            "pipeline": lambda: st.final_status(t("stages"), t("documents")),
            "trace": lambda: st.trace(t("usage_logs"), top_n, session_id),
            "usage": lambda: st.hot_blocks(st.block_activation(t("usage_logs")), top_n),
        }
        if scope not in scopes:
            raise ValueError(f"scope must be one of {', '.join(scopes)}")
        return scopes[scope]()

    def status_all(self, top_n: int = 20) -> dict[str, DataFrame]:
        """Every scope's table, lazily."""
        return {scope: self.status(scope, top_n) for scope in SCOPES}

    def _issues(self) -> DataFrame:
        t = self.table
        parts = [
            t("documents").agg(F.count_if(F.col("status") == "failed").alias("failed_documents")),
            t("blocks").agg(F.count_if(F.col("status") == "pending").alias("pending_blocks")),
            st.vectors_status(t("blocks"), t("vectors")).select(F.abs("delta").alias("vector_gap")),
            g.low_confidence(t("entities")),
            t("conflicts").agg(F.count("*").alias("conflicts")),
            st.feedback_stats(t("feedback")).select("low"),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.join(part, F.lit(True))  # one row each
        return out

    def evaluate(self, questions: DataFrame, truth: DataFrame, mode: str = "hybrid", top_k: int = 5) -> DataFrame:
        """Mean hit rate, reciprocal rank and NDCG of a search mode over questions (qid, text, embedding)."""
        hits = self.search(questions, mode, top_k)
        graded = truth if "grade" in truth.columns else truth.withColumn("grade", F.lit(1))
        return ev.summary(ev.evaluate(questions.select("qid"), hits, graded, top_k))

    def pending(self, requests: DataFrame, results: DataFrame) -> DataFrame:
        return ex.pending_requests(requests, results)


def _fields(ddl: str) -> list[str]:
    """Top-level fields of a schema string."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


def main(argv: list[str]) -> None:
    """``python -m quillgraph PATH VERB [JSON]``: a verb's table as JSON lines."""
    from quillgraph.session import get_session

    path, verb, *rest = argv
    params = json.loads(rest[0]) if rest else {}
    kb = KnowledgeBase(get_session(), path)
    if verb not in ("explore", "read", "status", "search", "clean_logs", "remove_document"):
        raise SystemExit(f"unknown verb {verb}")
    if verb == "search":
        text = params.pop("text")
        queries = kb.spark.createDataFrame([(0, text, params.pop("embedding", None))], "qid long, text string, embedding array<float>")
        out = kb.search(queries, **params)
    else:
        out = getattr(kb, verb)(**params)
    for frame in out if isinstance(out, tuple) else [out] if out is not None else []:
        for line in frame.toJSON().toLocalIterator():
            print(line)
