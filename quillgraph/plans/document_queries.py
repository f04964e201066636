"""Registered queries: Markdown, chunks, hashes, extraction, tables, policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph import schema
from quillgraph.functions import chunking, text as tx
from quillgraph.operators import extraction as ex
from quillgraph.operators import layout as ly
from quillgraph.operators import markdown as md
from quillgraph.operators import status as st
from quillgraph.plans import fixtures as fx
from quillgraph.plans.registry import query
from quillgraph.session import dealt, table
from quillgraph.sources import files

_TURNS = "SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, '## turn ' || turn || ' ' || role || chr(10) || chr(10) || text) AS n, turn, role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations"


@query("md_headings", f"WITH t AS ({_TURNS}) SELECT DISTINCT doc_id, 0 AS node_seq, 1 AS level, 'conv ' || doc_id AS title FROM t UNION ALL SELECT doc_id, n, 2, 'turn ' || turn || ' ' || role FROM t")
def md_headings(spark, sf_dir):
    return md.headings(fx.markdown(spark, sf_dir)).select("doc_id", "node_seq", "level", "title")


@query("md_parse_flat", f"WITH t AS ({_TURNS}) SELECT DISTINCT doc_id, 0 AS node_seq, md5('') AS content FROM t UNION ALL SELECT doc_id, n, md5(text) FROM t")
def md_parse_flat(spark, sf_dir):
    return md.headings(fx.markdown(spark, sf_dir)).select("doc_id", "node_seq", F.md5("content").alias("content"))


@query("md_tree_parent", f"WITH t AS ({_TURNS}) SELECT DISTINCT doc_id, 0 AS node_seq, -1 AS parent_seq, 0 AS root_seq FROM t UNION ALL SELECT doc_id, n, 0, 0 FROM t")
def md_tree_parent(spark, sf_dir):
    return md.headings(fx.markdown(spark, sf_dir)).select("doc_id", "node_seq", "parent_seq", "root_seq")


@query("md_paths", f"WITH t AS ({_TURNS}) SELECT doc_id, n AS node_seq, md5('# conv ' || doc_id || chr(10) || '## turn ' || turn || ' ' || role || chr(10) || chr(10) || text) AS content FROM t WHERE text <> ''")
def md_paths(spark, sf_dir):
    return md.chapters(fx.markdown(spark, sf_dir)).select("doc_id", "node_seq", F.md5("content").alias("content"))


@query("content_blocks", f"WITH t AS ({_TURNS}) SELECT doc_id, 'b_' || (n - 1) AS block_id, n - 1 AS seq_index, 'turn ' || turn || ' ' || role AS section_title, md5('## turn ' || turn || ' ' || role || chr(10) || chr(10) || text) AS content FROM t")
def content_blocks(spark, sf_dir):
    return md.content_blocks(fx.markdown(spark, sf_dir), 1 << 20).select("doc_id", "block_id", "seq_index", "section_title", F.md5("content").alias("content"))


@query("content_blocks_split")
def content_blocks_split(spark, sf_dir):
    """Blocks at the production size; tests hold them against the whole text."""
    return md.content_blocks(fx.markdown(spark, sf_dir))


@query("heading_maps", f"WITH t AS ({_TURNS}) SELECT doc_id, 'turn ' || turn || ' ' || role AS heading_title, 2 AS heading_level, 'conv ' || doc_id AS parent_heading, 'b_' || (n - 1) AS block_ids FROM t")
def heading_maps(spark, sf_dir):
    return md.heading_maps(fx.markdown(spark, sf_dir), 1 << 20).withColumn("block_ids", F.array_join("block_ids", ","))


@query("section_content", f"WITH t AS ({_TURNS}) SELECT doc_id, count(*) AS sections, sum(length('## turn ' || turn || ' ' || role || text) + 2)::BIGINT AS chars FROM t GROUP BY doc_id")
def section_content(spark, sf_dir):
    return md.content_blocks(fx.markdown(spark, sf_dir), 1 << 20).groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum(F.length("content")).alias("chars"))


@query("heading_like", f"WITH t AS ({_TURNS}) SELECT doc_id, 'b_' || (n - 1) AS block_id FROM t WHERE 'turn ' || turn || ' ' || role ILIKE '%USER%'")
def heading_like(spark, sf_dir):
    docs = fx.markdown(spark, sf_dir)
    return md.blocks_of(md.like_heading(md.heading_maps(docs, 1 << 20), "USER"), md.content_blocks(docs, 1 << 20)).select("doc_id", "block_id")


@query("heading_regex", f"WITH t AS ({_TURNS}) SELECT doc_id, 'b_' || (n - 1) AS block_id FROM t WHERE regexp_matches('turn ' || turn || ' ' || role, 'turn [0-2] ')")
def heading_regex(spark, sf_dir):
    docs = fx.markdown(spark, sf_dir)
    return md.blocks_of(md.heading_maps(docs, 1 << 20).where(F.col("heading_title").rlike("turn [0-2] ")), md.content_blocks(docs, 1 << 20)).select("doc_id", "block_id")


_TREE = "# R\n\nroot text\n\n## A\n\na text\n\n### A1\n\na1\n\n#### A1x\n\ndeep\n\n## A\n\nagain\n\n## B\n\n### B\n\nself"


@query("heading_recursive", "SELECT * FROM (VALUES (1, 'A', 2), (1, 'A1', 3), (1, 'A1x', 4)) t(doc_id, heading_title, heading_level)")
def heading_recursive(spark, sf_dir):
    """Literal fixture: one branch, with titles that repeat."""
    docs = spark.createDataFrame([(1, _TREE)], "doc_id long, text string")
    return md.heading_descent(md.heading_maps(docs), "A").select("doc_id", "heading_title", "heading_level")


@query("blocks_preface", "SELECT * FROM (VALUES ('b_0', 'A', '# R' || chr(10) || chr(10) || 'root text'), ('b_1', 'A', '## A'), ('b_2', 'B', '## B')) t(block_id, section_title, head)")
def blocks_preface(spark, sf_dir):
    docs = spark.createDataFrame([(1, _TREE)], "doc_id long, text string")
    blocks = md.content_blocks(docs)
    return blocks.select("block_id", "section_title", F.when(F.col("content").startswith("# R"), F.left("content", F.lit(14))).otherwise(F.regexp_extract("content", "^## .", 0)).alias("head"))


@query("read_document", f"WITH t AS ({_TURNS}) SELECT doc_id, md5(string_agg('## turn ' || turn || ' ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n)) AS content FROM t GROUP BY doc_id")
def read_document(spark, sf_dir):
    """The read verb: a document's blocks in order, joined by rules."""
    blocks = md.content_blocks(fx.markdown(spark, sf_dir), 1 << 20)
    parts = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq_index", "content"))).alias("p"))
    return parts.select("doc_id", F.md5(F.array_join(F.transform("p", lambda x: x["content"]), "\n\n---\n\n")).alias("content"))


@query("extraction_batches", f"WITH t AS ({_TURNS}) SELECT doc_id, role AS section_title, min(n - 1) AS first_seq, sum(length(text))::BIGINT + 2 * (count(*) - 1) AS chars FROM t WHERE text <> '' GROUP BY doc_id, role")
def extraction_batches(spark, sf_dir):
    """Turns of a role joined into one request text."""
    docs = fx.markdown(spark, sf_dir)
    nodes = md.headings(docs).where("parent_seq = 0").select("doc_id", F.regexp_extract("title", r"turn \d+ (.*)", 1).alias("section_title"), (F.col("node_seq") - 1).alias("seq_index"), "content")
    return md.batches(nodes, 1 << 20).select("doc_id", "section_title", "first_seq", F.length("chunk").cast("long").alias("chars"))


@query("content_hash", "SELECT doc_id, left(md5(text), 16) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.short_hash(F.col("text")).alias("content_hash"))


_OLD = "SELECT source || '-' || doc_id AS title, left(md5(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END), 16) AS content_hash FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT 'gone-' || item_id, left(md5(text), 16) FROM benchmark"


@query("incremental_diff", f"WITH n AS (SELECT source || '-' || doc_id AS title, left(md5(text), 16) AS h FROM documents), o AS ({_OLD}) SELECT coalesce(n.title, o.title) AS title, CASE WHEN o.title IS NULL THEN 'added' WHEN n.title IS NULL THEN 'removed' WHEN n.h = o.content_hash THEN 'unchanged' ELSE 'changed' END AS state FROM n FULL JOIN o ON n.title = o.title")
def incremental_diff(spark, sf_dir):
    d, title = table(spark, sf_dir, "documents"), F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("title")
    new = d.select(title, tx.short_hash(F.col("text")).alias("content_hash"))
    old = d.where("doc_id % 5 <> 0").select(title, tx.short_hash(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("content_hash"))
    gone = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("gone-"), F.col("item_id").cast("string")).alias("title"), tx.short_hash(F.col("text")).alias("content_hash"))
    return md.incremental(new, old.unionByName(gone))


@query("hard_cut_chunks", "SELECT doc_id, i AS seq, md5(substr(text, i * 500 + 1, 500)) AS chunk FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i FROM documents)")
def hard_cut_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.chunked(d, chunking.hard_cut, 500).withColumn("chunk", F.md5("chunk"))


@query("sentence_split_counts", "SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS sentences FROM documents")
def sentence_split_counts(spark, sf_dir):
    parts = F.filter(F.split("text", r"(?<=[.!?。！？])\s+", -1), lambda s: F.btrim(s, F.lit(" \t\n\r")) != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("sentences"))


@query("chunk_text")
def chunk_text(spark, sf_dir):
    """Chunks for vectors of every document; tests show that they lose nothing."""
    return chunking.chunked(table(spark, sf_dir, "documents").select("doc_id", "text"), chunking.split_for_embedding, chunking.BLOCK_CHARS)


@query("chunk_html")
def chunk_html(spark, sf_dir):
    return chunking.chunked(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), chunking.split_paragraphs, chunking.CHAPTER_CHARS)


@query("request_bins")
def request_bins(spark, sf_dir):
    """Request lines of a source filled into part files of a megabyte in order."""
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.col("source").alias("file_id"), F.col("doc_id").alias("req_idx"), ex.batch_request(F.col("doc_id").cast("string"), F.lit("m"), F.col("text")).alias("line"))
    return ex.size_binned(lines, 1 << 20)


@query("request_lines", "SELECT doc_id, CAST(doc_id AS VARCHAR) AS custom_id, md5(text) AS prompt FROM documents")
def request_lines(spark, sf_dir):
    """Request lines read back: what goes out comes in."""
    d = table(spark, sf_dir, "documents")
    lines = d.select(ex.batch_request(F.col("doc_id").cast("string"), F.lit("m"), F.col("text")).alias("value"))
    rows = files.parsed_lines(lines, "custom_id string, body struct<messages:array<struct<content:string>>>")
    return rows.select(F.col("custom_id").cast("long").alias("doc_id"), "custom_id", F.md5(F.col("body.messages")[0]["content"]).alias("prompt"))


# -- extraction -----------------------------------------------------------------


def _answers(spark, sf_dir):
    """Answers of a model about parts: fences, trailing commas, types that are not known, no JSON."""
    key = F.col("p_partkey")
    kind = F.when(key % 4 == 0, "Widget").otherwise("Module")
    name = F.when(key % 9 == 0, "").otherwise(F.concat(F.lit("Part#"), key.cast("string")))
    body = F.concat(F.lit('{"entities": [{"type": "'), kind, F.lit('", "name": "'), name, F.lit('", "properties": {"brand": "'), F.col("p_brand"), F.lit('"}},{"type": "Signal", "name": "S'), (key % 10).cast("string"), F.lit('"}], "relations": [{"from_type": "Module", "from_name": "'), name, F.lit('", "rel_type": "'), F.when(key % 5 == 0, "LIKES").otherwise("HAS_SIGNAL"), F.lit('", "to_type": "Signal", "to_name": "S'), (key % 10).cast("string"), F.lit('"}]'), F.when(key % 3 == 0, ",").otherwise(""), F.lit("}"))
    content = F.when(key % 11 == 0, "sorry").when(key % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    choice = F.array(F.struct(F.struct(content.alias("content")).alias("message")))
    line = F.to_json(F.struct(F.concat(F.lit("r"), key.cast("string")).alias("custom_id"), F.struct(F.lit(200).alias("status_code"), F.struct(choice.alias("choices")).alias("body")).alias("response")))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return dealt(parts).select(key.alias("seq"), line.alias("value")), parts.select(F.concat(F.lit("r"), key.cast("string")).alias("custom_id"), F.concat(F.lit("ch"), (key % 8).cast("string")).alias("chapter"))


@query("extract_results", "SELECT p_partkey AS seq, 0 AS pos, 'Module' AS entity_type, 'Part#' || p_partkey AS name, 'ch' || p_partkey % 8 AS chapter, p_brand AS brand FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 9 <> 0 AND p_partkey % 11 <> 0 UNION ALL SELECT p_partkey, 1, 'Signal', 'S' || p_partkey % 10, 'ch' || p_partkey % 8, NULL FROM part WHERE p_partkey % 11 <> 0")
def extract_results(spark, sf_dir):
    entities, _ = ex.extract_results(*_answers(spark, sf_dir))
    return entities.select("seq", "pos", "entity_type", "name", "chapter", F.try_element_at("properties", F.lit("brand")).alias("brand"))


@query("extract_relations", "SELECT p_partkey AS seq, 'S' || p_partkey % 10 AS to_name, 'HAS_SIGNAL' AS rel_type FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 11 <> 0")
def extract_relations(spark, sf_dir):
    return ex.extract_results(*_answers(spark, sf_dir))[1].select("seq", "to_name", "rel_type")


@query("merge_in_document", "SELECT 'Module' AS entity_type, 'B' || p_size AS name, arg_max(p_brand, p_partkey) AS brand, 'ch' || min(p_partkey) AS chapter FROM part GROUP BY p_size")
def merge_in_document(spark, sf_dir):
    """Parts of one size as mentions of one module: the last value wins, the first chapter stays."""
    e = table(spark, sf_dir, "part").select(F.lit("d").alias("doc_id"), F.lit("Module").alias("entity_type"), F.concat(F.lit("B"), F.col("p_size").cast("string")).alias("name"), F.col("p_partkey").alias("seq"), F.lit(0).alias("pos"), F.concat(F.lit("ch"), F.col("p_partkey").cast("string")).alias("chapter"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("properties"))
    return ex.merge_in_document(e).select("entity_type", "name", F.col("properties")["brand"].alias("brand"), "chapter")


@query("product_edges", "SELECT DISTINCT p_brand AS doc_id, 'prod-' || p_brand AS from_name, 'T' || p_size AS to_name FROM part")
def product_edges(spark, sf_dir):
    e = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.lit("Module").alias("entity_type"), F.concat(F.lit("T"), F.col("p_size").cast("string")).alias("name"))
    products = e.select("doc_id").distinct().withColumn("product", F.concat(F.lit("prod-"), "doc_id"))
    return ex.product_edges(e, products).select("doc_id", "from_name", "to_name")


@query("section_relations", "WITH r AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), e AS (SELECT 'sec' || s_nationkey AS section, s_suppkey AS s FROM supplier), f AS (SELECT 'sec' || p_size % 25 AS section, p_partkey AS p FROM part) SELECT section, count(*) AS relations FROM (SELECT section, s, p FROM r JOIN e USING (s) UNION SELECT section, s, p FROM r JOIN f USING (p)) GROUP BY section")
def section_relations(spark, sf_dir):
    rels = dealt(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").distinct()
    rels = rels.select(F.lit("d").alias("doc_id"), F.lit("Supplier").alias("from_type"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("from_name"), F.lit("SUPPLIES").alias("rel_type"), F.lit("Part").alias("to_type"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("to_name"))
    a = table(spark, sf_dir, "supplier").select(F.lit("d").alias("doc_id"), F.concat(F.lit("sec"), F.col("s_nationkey").cast("string")).alias("section"), F.lit("Supplier").alias("entity_type"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"))
    b = table(spark, sf_dir, "part").select(F.lit("d").alias("doc_id"), F.concat(F.lit("sec"), (F.col("p_size") % 25).cast("string")).alias("section"), F.lit("Other").alias("entity_type"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"))
    return ex.section_relations(a.unionByName(b), rels).groupBy("section").agg(F.count("*").alias("relations"))


def _attempts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    requests = e.select(F.col("event_id").alias("req_idx"), F.col("event_id").cast("string").alias("custom_id"), F.col("event_type").alias("title"))
    answer = lambda ok, body: e.select(F.col("event_id").cast("string").alias("custom_id"), F.col("event_id").alias("seq"), F.when(ok, 200).otherwise(500).alias("status_code"), F.concat(F.lit(body), F.col("event_id").cast("string")).alias("body"))
    return requests, answer(F.col("event_id") % 3 == 0, "old"), answer(F.col("event_id") % 2 == 0, "new").where("seq % 7 <> 0")


@query("pending_requests", "SELECT event_id AS req_idx FROM events WHERE event_id % 3 <> 0")
def pending_requests(spark, sf_dir):
    requests, old, _ = _attempts(spark, sf_dir)
    return ex.pending_requests(requests, old).select("req_idx")


@query("merge_results", "SELECT event_id AS req_idx, CASE WHEN event_id % 3 = 0 THEN 200 WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 2 = 0 THEN 200 ELSE 500 END AS status_code, CASE WHEN event_id % 3 = 0 THEN 'old' || event_id WHEN event_id % 7 = 0 THEN 'missing' ELSE 'new' || event_id END AS body FROM events")
def merge_results(spark, sf_dir):
    return ex.merged_results(*_attempts(spark, sf_dir)).select("req_idx", "status_code", "body")


@query("incremental_requests", "SELECT event_id AS req_idx FROM events WHERE event_type IN ('click', 'purchase')")
def incremental_requests(spark, sf_dir):
    states = spark.createDataFrame([("click", "changed"), ("purchase", "added"), ("view", "unchanged")], "title string, state string")
    return ex.requests_for(_attempts(spark, sf_dir)[0], states).select("req_idx")


@query("llm_json_repair", "SELECT * FROM (VALUES (1, '1'), (2, '1'), (3, '1'), (4, NULL), (5, NULL)) t(id, a)")
def llm_json_repair(spark, sf_dir):
    rows = [(1, '{"a": "1"}'), (2, '```json\n{"a": "1"}\n```'), (3, '{"a": "1",}'), (4, "no"), (5, '{"b": "1"}')]
    return spark.createDataFrame(rows, "id int, raw string").select("id", tx.repaired_json(F.col("raw"), "a string")["a"].alias("a"))


# -- literal fixtures and policies ------------------------------------------------


@query("heading_rules", "SELECT * FROM (VALUES ('# A', 1), ('####### deep', 7), (' # in', 0), ('#no', 0), ('# 12', 0), ('## 3 March 2020', 0), ('# 2020-01-02', 0), ('#  ', 0), ('text', 0)) t(line, level)")
def heading_rules(spark, sf_dir):
    lines = ["# A", "####### deep", " # in", "#no", "# 12", "## 3 March 2020", "# 2020-01-02", "#  ", "text"]
    return spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.coalesce(tx.heading_level(F.col("line")), F.lit(0)).alias("level"))


@query("product_regex", "SELECT * FROM (VALUES (1, 'TMS320F280'), (2, 'STM32F4'), (3, 'CC2640'), (4, NULL)) t(id, product)")
def product_regex(spark, sf_dir):
    rows = [(1, "intro\nThe TMS320F280 and STM32F4", "x.pdf"), (2, "none", "docs/STM32F4-guide.pdf"), (3, "CC2640 here\nTMS320X later", "a.pdf"), (4, "none", "plain.pdf")]
    return spark.createDataFrame(rows, "id int, text string, path string").select("id", tx.product_name(F.col("text"), F.col("path")).alias("product"))


@query("doc_context", "SELECT doc_id, '文档《' || source || '》' || CASE WHEN doc_id % 2 = 0 THEN '，产品型号 P' || doc_id ELSE '' END AS context FROM documents")
def doc_context(spark, sf_dir):
    product = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("P"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", tx.doc_context(F.col("source"), product).alias("context"))


@query("caption_filter", "SELECT * FROM (VALUES ('Table B1.3: Title', 'table', true), ('Table B1.3 shows it', 'table', false), ('表 2-1: 名', 'table', true), ('Table 5', 'table', false), ('Figure 3 Block', 'figure', true), ('Figure 3 illustrates it', 'figure', false), ('see Figure 3', 'figure', false)) t(text, kind, caption)")
def caption_filter(spark, sf_dir):
    rows = [("Table B1.3: Title", "table"), ("Table B1.3 shows it", "table"), ("表 2-1: 名", "table"), ("Table 5", "table"), ("Figure 3 Block", "figure"), ("Figure 3 illustrates it", "figure"), ("see Figure 3", "figure")]
    t = spark.createDataFrame(rows, "text string, kind string")
    return t.withColumn("caption", F.when(F.col("kind") == "table", tx.is_caption(F.col("text"), "table")).otherwise(tx.is_caption(F.col("text"), "figure")))


@query("toc_page_ranges", "WITH toc AS (SELECT n_regionkey AS doc_id, n_nationkey AS i, n_name AS title, 2 + n_nationkey AS page FROM nation), p AS (SELECT r_regionkey AS doc_id, unnest(range(1, 31)) AS page FROM region) SELECT p.doc_id, p.page, coalesce((SELECT arg_max(title, i) FROM toc WHERE toc.doc_id = p.doc_id AND toc.page <= p.page), '(Untitled)') AS chapter FROM p")
def toc_page_ranges(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    toc = n.select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("toc_idx"), F.col("n_name").alias("title"), (F.col("n_nationkey") + 2).cast("long").alias("page"))
    pages = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), F.lit(30).cast("long").alias("n_pages"))
    return md.toc_ranges(toc, pages)


@query("fill_down_tables", "SELECT l_orderkey AS table_id, row_idx, coalesce(last_value(first IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY row_idx), '') AS first FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_idx, CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag END AS first FROM lineitem)")
def fill_down_tables(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.row_number().over(w).cast("long").alias("row_idx"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_returnflag")).otherwise("").alias("first"))
    return md.filled_down(cells)


@query("continued_tables", "SELECT * FROM (VALUES (1, 1), (2, 2), (3, 1), (4, 4)) t(seg, target)")
def continued_tables(spark, sf_dir):
    rows = [("d", 1, "Table B1.2 Pins"), ("d", 2, "Table B1.3 Modes"), ("d", 3, "Table B1.2 – Continued from previous page"), ("d", 4, "Table 9 continued from previous page")]
    segs = spark.createDataFrame(rows, "doc_id string, seg int, caption string")
    return md.merge_continued(segs, tx.base_caption(F.col("caption"))).select("seg", "target")


@query("normalize_table", "SELECT '| a | b c |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 2 | 3 |' AS t")
def normalize_table(spark, sf_dir):
    return spark.createDataFrame([("  |a|  b<br>c |\n\n|---|---|\n| 1   2 | 3|",)], "t string").select(tx.normalized_table(F.col("t")).alias("t"))


@query("image_references", "SELECT * FROM (VALUES (0, 'fig', 'a.png'), (1, '', 'http://x/b.png')) t(pos, alt, path)")
def image_references(spark, sf_dir):
    t = spark.createDataFrame([("x ![fig](a.png) y ![](http://x/b.png)",)], "t string")
    return t.select(F.posexplode(tx.image_refs(F.col("t"))).alias("pos", "i")).select("pos", "i.alt", "i.path")


@query("image_descriptions", "SELECT 'see [fig] a plan' || chr(10) || chr(10) || '【图片内容】' || chr(10) || '[other] unseen' AS t, 'keep ![a](ok.png)  ![w](http://h/i.png)' AS links")
def image_descriptions(spark, sf_dir):
    t = spark.createDataFrame([("see ![fig](a.png)", [("fig", "a plan"), ("other", "unseen")], "keep ![a](ok.png) ![b](no.png) ![w](http://h/i.png)", ["ok.png"])], "t string, i array<struct<id:string,description:string>>, l string, v array<string>")
    return t.select(md.with_descriptions(F.col("t"), F.col("i")).alias("t"), md.without_broken_images(F.col("l"), F.col("v")).alias("links"))


@query("prompt_template", "SELECT doc_id, 'Q ' || source || ' in ' || lang || ' $x' AS prompt FROM documents")
def prompt_template(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", files.filled(F.lit("Q ${source} in $lang $x"), {"source": F.col("source"), "lang": F.col("lang")}).alias("prompt"))


_STATUS = "CASE event_id % 8 WHEN 0 THEN 401 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 499 WHEN 4 THEN 503 WHEN 5 THEN 400 WHEN 6 THEN 402 ELSE 418 END"


@query("error_classify", f"""SELECT event_id, CASE status WHEN 401 THEN 'authentication' WHEN 402 THEN 'authentication' WHEN 404 THEN 'request_format' WHEN 429 THEN CASE WHEN event_id % 3 = 0 THEN 'quota' ELSE 'rate_limit' END WHEN 499 THEN 'transient' WHEN 503 THEN 'server'
WHEN 400 THEN CASE WHEN event_id % 3 = 0 THEN 'request_format' WHEN event_id % 3 = 1 THEN 'too_large' ELSE 'content_filter' END ELSE 'api_error' END AS chat,
CASE status WHEN 401 THEN 'authentication' WHEN 402 THEN 'api_error' WHEN 404 THEN 'request_format' WHEN 429 THEN 'rate_limit' WHEN 499 THEN 'transient' WHEN 503 THEN 'overloaded' WHEN 400 THEN CASE WHEN event_id % 3 = 1 THEN 'too_large' WHEN event_id % 3 = 2 THEN 'content_filter' ELSE 'request_format' END ELSE 'api_error' END AS embedding
FROM (SELECT event_id, {_STATUS} AS status FROM events)""")
def error_classify(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.expr(_STATUS)
    message = F.when(F.col("event_id") % 3 == 0, "monthly usage limit").when(F.col("event_id") % 3 == 1, "exceeds limit").otherwise("high risk")
    message = F.when((status == 429) & (F.col("event_id") % 3 != 0), "slow down").when((status == 400) & (F.col("event_id") % 3 == 0), "bad").otherwise(message)
    return e.select("event_id", tx.error_class(status, F.lit(None), message).alias("chat"), tx.error_class(status, F.lit(None), message, "embedding").alias("embedding"))


@query("retry_backoff", "SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN 7.0 END, least(greatest(0.1, 1.0 * pow(2, event_id % 10)), 60.0)) AS delay FROM events")
def retry_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.backoff((F.col("event_id") % 10).cast("double"), retry_after=F.when(F.col("event_id") % 4 == 0, 7)).alias("delay"))


@query("chat_timeout", "SELECT doc_id, greatest(1, least(1800, 300 + CAST(floor(n_chars / 10000.0 * 60 + (doc_id % 3) * 30.0) AS INTEGER))) AS timeout_s FROM documents")
def chat_timeout(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.chat_timeout(F.col("n_chars"), F.col("doc_id") % 3).alias("timeout_s"))


@query("chat_retry_delay", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN least(60.0, greatest(1.0, value / 5.0)) ELSE 5.0 END AS delay FROM events")
def chat_retry_delay(spark, sf_dir):
    error = F.when(F.col("event_id") % 2 == 0, "Read Timed Out").otherwise("reset")
    return table(spark, sf_dir, "events").select("event_id", tx.chat_retry_delay(error, F.col("value")).alias("delay"))


@query("summarize_params", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS params FROM documents")
def summarize_params(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.summarized(F.col("text")).alias("params"))


@query("safe_members", "SELECT * FROM (VALUES ('a/b.md', true), ('../x', false), ('/abs', false), ('c:x', false), ('a\\b', false)) t(name, safe)")
def safe_members(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in ("a/b.md", "../x", "/abs", "c:x", "a\\b")], "name string").select("name", files.safe_member(F.col("name")).alias("safe"))


@query("node_link_export", "SELECT 'link' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'node', count(*) FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)")
def node_link_export(spark, sf_dir):
    e = fx.entities(spark, sf_dir).where("entity_type IN ('Nation', 'Region')")
    return files.node_link(e, fx.relations(spark, sf_dir).where("rel_type = 'CONTAINS'")).groupBy("kind").agg(F.count("*").alias("n"))


@query("masked_settings", "SELECT p_partkey, CASE WHEN length(p_brand) <= 8 THEN '****' ELSE left(p_brand, 4) || '****' || right(p_brand, 4) END AS shown FROM part")
def masked_settings(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", st.masked(F.col("p_brand")).alias("shown"))


@query("vocabulary", f"SELECT 'node' AS kind, {len(schema.NODE_TYPES)} AS n UNION ALL SELECT 'relation', {len(schema.REL_TYPES)}")
def vocabulary(spark, sf_dir):
    rows = [("node", t) for t in schema.NODE_TYPES] + [("relation", t) for t in schema.REL_TYPES]
    return spark.createDataFrame(rows, "kind string, name string").distinct().groupBy("kind").agg(F.count("*").alias("n"))


# -- page geometry ------------------------------------------------------------------


def _page_elements(spark, sf_dir):
    """Order lines as boxes on a page: one page an order."""
    c = F.col
    y0 = (c("l_linenumber") * 100).cast("double")
    h = c("l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc_id"), c("l_orderkey").alias("page"), F.when(c("l_linenumber") % 2 == 0, "heading").otherwise("body_text").alias("kind"), F.lit(0.0).alias("x0"), y0.alias("y0"), c("l_discount").alias("x1"), (y0 + h * 2).alias("y1"), c("l_returnflag").alias("text"))


_BOXES = "SELECT l_orderkey AS page, l_linenumber * 100.0 AS y0, l_linenumber * 100.0 + 2 * l_quantity AS y1 FROM lineitem"
_ISLANDS = f"""b AS ({_BOXES}), m AS (SELECT *, CASE WHEN y0 <= max(y1) OVER (PARTITION BY page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 0 ELSE 1 END AS new_ FROM b),
i AS (SELECT *, sum(new_) OVER (PARTITION BY page ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS island FROM m), s AS (SELECT page, island, min(y0) AS y0, max(y1) AS y1 FROM i GROUP BY page, island)"""


@query("page_separators", f"WITH {_ISLANDS} SELECT page, y0::DOUBLE AS y0, y1::DOUBLE AS y1 FROM s")
def page_separators(spark, sf_dir):
    return ly.separators(_page_elements(spark, sf_dir)).select("page", "y0", "y1")


@query("page_zones", f"WITH {_ISLANDS}, z AS (SELECT page, y1 AS z0, lead(y0) OVER (PARTITION BY page ORDER BY y0) AS z1 FROM s) SELECT page, z0::DOUBLE AS z0, z1::DOUBLE AS z1 FROM z WHERE z1 > z0 + 1")
def page_zones(spark, sf_dir):
    return ly.zones(ly.separators(_page_elements(spark, sf_dir))).select("page", "z0", "z1")


@query("elements_in_zones", f"WITH {_ISLANDS}, z AS (SELECT page, y1 AS z0, lead(y0) OVER (PARTITION BY page ORDER BY y0) AS z1 FROM s), k AS (SELECT * FROM z WHERE z1 > z0 + 1), e AS (SELECT page, y0 + 50 AS y0, y1 + 50 AS y1 FROM b) SELECT page, count(*) AS n FROM e JOIN k USING (page) WHERE (y0 + y1) / 2 >= z0 AND (y0 + y1) / 2 < z1 GROUP BY page")
def elements_in_zones(spark, sf_dir):
    e = _page_elements(spark, sf_dir)
    moved = e.withColumns({"y0": F.col("y0") + 50, "y1": F.col("y1") + 50})
    return ly.in_zones(moved, ly.zones(ly.separators(e))).groupBy("page").agg(F.count("*").alias("n"))


@query("table_styles", "SELECT * FROM (VALUES (1, 'grid'), (2, 'horizontal'), (3, NULL)) t(zone, style)")
def table_styles(spark, sf_dir):
    line = lambda z, i, up: ("d", 1, z, "drawing", 10.0 * i if up else 0.0, 0.0 if up else 12.0 * i, 10.0 * i if up else 200.0, 60.0 if up else 12.0 * i)
    rows = [line(1, i, False) for i in range(5)] + [line(1, i, True) for i in range(4)] + [("d", 1, 1, "text", 0.0, 0.0, 9.0, 9.0)] * 4
    rows += [line(2, i, False) for i in range(5)] + [("d", 1, 2, "text", 0.0, 0.0, 9.0, 9.0)] * 3
    rows += [("d", 1, 3, "drawing", 0.0, 0.0, 50.0, 50.0)] * 3 + [line(3, 1, False)]
    placed = spark.createDataFrame(rows, "doc_id string, page int, zone int, kind string, x0 double, y0 double, x1 double, y1 double")
    return ly.table_style(placed).select("zone", "style")


@query("drawing_clusters", "SELECT * FROM (VALUES (0.0, 0), (8.0, 0), (16.0, 0), (100.0, 1), (300.0, 2)) t(y0, cluster)")
def drawing_clusters(spark, sf_dir):
    rows = [("d", 1, 0.0, y, 5.0, y + 2) for y in (0.0, 16.0, 8.0, 100.0, 300.0)]
    return ly.drawing_clusters(spark.createDataFrame(rows, "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")).select("y0", "cluster")


@query("consistent_lines", "SELECT * FROM (VALUES (1, 41.0), (2, 0.0)) t(doc_id, y)")
def consistent_lines(spark, sf_dir):
    rows = [(1, 5, y) for y in (40.0, 41.0, 42.0, 41.0, 300.0)] + [(2, 5, y) for y in (10.0, 50.0, 90.0)]
    return ly.consistent_lines(spark.createDataFrame(rows, "doc_id int, n_pages int, y double"))


@query("toc_headings", "SELECT n_nationkey AS page, 'Nation ' || n_nationkey AS text, 1 AS level FROM nation WHERE n_regionkey = 1")
def toc_headings(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    blocks = n.select(F.lit("d").alias("doc_id"), F.col("n_nationkey").alias("page"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("text"))
    toc = n.where("n_regionkey = 1").select(F.lit("d").alias("doc_id"), F.col("n_nationkey").alias("page"), F.lit(1).alias("level"), F.concat(F.lit("NATION  "), F.col("n_nationkey").cast("string")).alias("title"))
    return ly.toc_headings(blocks, toc).select("page", "text", "level")


@query("page_markdown", "SELECT l_orderkey AS page, string_agg(l_returnflag, chr(10) || chr(10) ORDER BY l_linenumber, l_returnflag) AS text FROM lineitem GROUP BY l_orderkey")
def page_markdown(spark, sf_dir):
    return ly.page_markdown(_page_elements(spark, sf_dir)).select("page", "text")


@query("body_text_blocks", "SELECT doc_id, n_chars % 600 / 612.0 > 0.52 AND n_chars % 50 > 8 AND length(left(text, 60)) > 45 AND n_chars % 50 <= 277.2 AND NOT (n_chars % 600 / 612.0 > 0.85 AND n_chars % 50 > 80) AS body FROM documents")
def body_text_blocks(spark, sf_dir):
    c = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", ly.is_body_text(F.left("text", F.lit(60)), c % 600, c % 50, F.lit(612.0), F.lit(792.0)).alias("body"))


@query("text_block_classes", "SELECT * FROM (VALUES (1, 'figure_caption'), (2, 'callout'), (3, 'callout'), (4, 'heading'), (5, 'body_text'), (6, 'other'), (7, 'heading')) t(n, category)")
def text_block_classes(spark, sf_dir):
    """Literal fixture: a caption, a label near it, one near the label, headings by size and by contents, text, a far label."""
    long = "running text that goes on for more than forty-five characters in a line"
    rows = [(1, 50.0, 100.0, 300.0, 112.0, "Figure 3. Block diagram", 10.0), (2, 60.0, 330.0, 90.0, 338.0, "A. input", 8.0), (3, 60.0, 380.0, 90.0, 388.0, "clock", 8.0), (4, 50.0, 600.0, 400.0, 616.0, "Chapter", 16.0), (5, 50.0, 630.0, 560.0, 660.0, long, 10.0), (6, 50.0, 720.0, 90.0, 728.0, "7", 12.5), (7, 50.0, 745.0, 90.0, 753.0, "2.1", 10.0)]
    blocks = spark.createDataFrame([("d", 1, *r, 612.0, 792.0) for r in rows], "doc_id string, page int, n int, x0 double, y0 double, x1 double, y1 double, text string, font_size double, page_width double, page_height double")
    toc = spark.createDataFrame([("d", 1, "2.1 Setup")], "doc_id string, page int, title string")
    return ly.classify_blocks(blocks, toc).select("n", "category")


@query("borderless_tables", "SELECT '| Group | Item | Use |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| G1 | a | one |' || chr(10) || '| G1 | b | two |' || chr(10) || '| G2 | c | three |' AS t")
def borderless_tables(spark, sf_dir):
    """Literal fixture: full lines part groups, a short line parts the items of one group."""
    line = lambda y, x: ("d", 1, 1, "line", x, y, 500.0, y, "")
    word = lambda x, y, t: ("d", 1, 1, "word", x, y, x + 30.0, y + 8.0, t)
    rows = [line(100.0, 50.0), line(120.0, 50.0), line(140.0, 150.0), line(160.0, 50.0), line(180.0, 50.0)]
    rows += [word(60.0, 106.0, "Group"), word(160.0, 106.0, "Item"), word(260.0, 106.0, "Use"), word(60.0, 136.0, "G1"), word(160.0, 126.0, "a"), word(260.0, 126.0, "one"), word(160.0, 146.0, "b"), word(260.0, 146.0, "two"), word(60.0, 166.0, "G2"), word(160.0, 166.0, "c"), word(260.0, 166.0, "three")]
    elements = spark.createDataFrame([(*r, 400.0) for r in rows], "doc_id string, page int, region int, kind string, x0 double, y0 double, x1 double, y1 double, text string, bottom double")
    return ly.borderless_tables(elements).select(F.col("table").alias("t"))


@query("table_regions", "SELECT * FROM (VALUES (1), (4)) t(table_id)")
def table_regions(spark, sf_dir):
    """Literal fixture: a table, one inside it, one too flat, one elsewhere."""
    rows = [(1, 50.0, 100.0, 500.0, 300.0, 5), (2, 60.0, 110.0, 490.0, 290.0, 4), (3, 50.0, 310.0, 500.0, 320.0, 3), (4, 50.0, 400.0, 500.0, 500.0, 3)]
    found = spark.createDataFrame([("d", 1, 1, *r, 3, 612.0) for r in rows], "doc_id string, page int, zone int, table_id int, x0 double, y0 double, x1 double, y1 double, n_rows int, n_cols int, page_width double")
    return ly.table_regions(found).select("table_id")


@query("fallback_headings", "SELECT * FROM (VALUES ('Big', 1), ('Mid', 2), ('Bold', 3)) t(text, level)")
def fallback_headings(spark, sf_dir):
    rows = [("Big", 18.0, False), ("Mid", 13.5, False), ("Bold", 10.0, True), *[(f"text {i}", 10.0, False) for i in range(9)]]
    return ly.fallback_headings(spark.createDataFrame([("d", 1, 0.0, *r) for r in rows], "doc_id string, page int, y0 double, text string, font_size double, bold boolean")).select("text", "level")


@query("cluster_scores", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0, (8 * l_discount + 4 * (1 - l_tax) + 2 * (l_linenumber % 2) - CASE WHEN l_returnflag = 'A' THEN 5 ELSE 0 END) * CASE WHEN l_quantity < 30 THEN 0.2 ELSE 0.6 END), 6) AS score FROM lineitem")
def cluster_scores(spark, sf_dir):
    c = F.col
    score = ly.cluster_score(c("l_discount"), c("l_tax"), c("l_linenumber") % 2, c("l_quantity"), c("l_returnflag") == "A", F.lit(False))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(score, 6).alias("score"))


@query("low_content_images", "SELECT user_id AS image_id, max(n) > 0.25 * sum(n) AS low_content FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def low_content_images(spark, sf_dir):
    pixels = table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.col("event_type").alias("color"))
    return ly.low_content(pixels, 0.25)


@query("image_classes", "SELECT * FROM (VALUES (1, 'bw'), (2, 'gray'), (3, 'color')) t(image_id, kind)")
def image_classes(spark, sf_dir):
    rows = [(1, v, v, v) for v in (0, 255) * 20] + [(2, v, v, v) for v in range(100, 140)] + [(3, 250, 10, 10)] * 20 + [(3, 0, 0, 0)] * 20
    return ex.image_class(spark.createDataFrame(rows, "image_id int, r int, g int, b int"))


@query("chapters_nested", "SELECT n_nationkey AS doc_id, 'ch' || i AS title, i * 10 AS start_page FROM nation, (SELECT unnest(range(1, 4)) AS i)")
def chapters_nested(spark, sf_dir):
    """Contents as a nested array, read back as rows."""
    entries = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")), lambda i: F.struct(F.concat(F.lit("ch"), i.cast("string")).alias("title"), (i * 10).alias("start_page")))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), entries.alias("chapters")).select("doc_id", F.inline("chapters"))
