"""Registered queries: tokens, BM25, vectors, fusion, search verbs, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import bm25_tokens
from quillgraph.operators import evaluation as ev
from quillgraph.operators import graph as g
from quillgraph.operators import retrieval as r
from quillgraph.plans import fixtures as fx
from quillgraph.plans.registry import query
from quillgraph.session import table

TOKENS_SQL = r"""tok AS (SELECT doc_id AS id, list_concat(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+'), regexp_extract_all(lower(text), '[^\s\p{L}\p{N}_]')) AS t FROM documents),
flat AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok),
post AS (SELECT id, term, dl, count(*) AS tf FROM flat GROUP BY id, term, dl),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def _queries_sql(source: str) -> str:
    return rf"""q AS ({source}),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(list_concat(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+'), regexp_extract_all(lower(text), '[^\s\p{{L}}\p{{N}}_]'))) AS term FROM q) GROUP BY ALL),
bm AS (SELECT qid, id, round(sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf USING (term) JOIN post USING (term), st GROUP BY qid, id),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS rank FROM bm) WHERE rank <= {{k}} AND score > 0)"""


_BENCH = _queries_sql("SELECT item_id AS qid, text FROM benchmark")
_HYBRID_QUERIES = "SELECT doc_id AS qid, text, embedding FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % 100 = 0"
_UNIT = "u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"


@query("tokenize_terms", f"WITH {TOKENS_SQL} SELECT id, term, tf, CAST(dl AS BIGINT) AS dl FROM post")
def tokenize_terms(spark, sf_dir):
    return r.postings(fx.blocks(spark, sf_dir))


@query("bm25_idf", f"WITH {TOKENS_SQL} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, sf_dir):
    return r.inverse_frequencies(*r.lexicon(fx.blocks(spark, sf_dir))).withColumn("idf", F.round("idf", 6))


@query("bm25_topk", f"WITH {TOKENS_SQL}, {_BENCH.replace("{k}", "10")} SELECT qid, id, rank, score FROM sparse")
def bm25_topk(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return r.bm25_search(fx.blocks(spark, sf_dir), queries, 10).select("qid", "id", "rank", "score")


@query("bm25_topk_indexed", f"WITH {TOKENS_SQL}, {_BENCH.replace('{k}', '10')} SELECT qid, id, rank, score FROM sparse")
def bm25_topk_indexed(spark, sf_dir):
    """The same from an index."""
    blocks = fx.blocks(spark, sf_dir)
    df, stats = r.lexicon(blocks)
    index = (r.postings(blocks), r.inverse_frequencies(df, stats), stats)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return r.bm25_search(blocks, queries, 10, index=index).select("qid", "id", "rank", "score")


def _vector_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")


_COS = f"""WITH {_UNIT}, s AS (SELECT a.id AS qid, b.id, b.label, round(list_inner_product(a.v, b.v), 6) AS score FROM u a, u b WHERE a.id % 100 = 0)"""


@query("vector_cosine_topk", f"{_COS} SELECT qid, id, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS rank FROM s) WHERE rank <= 5")
def vector_cosine_topk(spark, sf_dir):
    return r.vector_search(table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), 5, id_col="vec_id").withColumn("score", F.round("score", 4))


@query("vector_normalize", f"WITH {_UNIT} SELECT id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm, round(v[1], 6) AS first FROM u")
def vector_normalize(spark, sf_dir):
    v = r.normalized(table(spark, sf_dir, "embeddings"), id_col="vec_id", dim=64)
    return v.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


@query("vector_index_info", "SELECT count(*) AS vectors, min(len(embedding)) AS dimension, count(DISTINCT vec_id) AS ids FROM embeddings")
def vector_index_info(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"), F.min(F.size("embedding")).cast("long").alias("dimension"), F.countDistinct("vec_id").alias("ids"))


@query("vector_remove_doc", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def vector_remove_doc(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return r.without_ids(table(spark, sf_dir, "embeddings").select("vec_id", "label"), gone, "vec_id")


@query("vector_pooling", "SELECT label, i, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i)")
def vector_pooling(spark, sf_dir):
    parts = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return r.pooled(parts, id_col="label").select(F.col("id").alias("label"), F.posexplode("v").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


_HYBRID = f"""{TOKENS_SQL}, {_queries_sql(_HYBRID_QUERIES).replace("{k}", "50")}, {_UNIT},
cos AS (SELECT a.id AS qid, b.id, round(list_inner_product(a.v, b.v), 6) AS score FROM u a JOIN q ON q.qid = a.id, u b),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS rank FROM cos) WHERE rank <= 50),
fused AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 8) AS score FROM (SELECT qid, id, rank FROM dense UNION ALL SELECT qid, id, rank FROM sparse) GROUP BY qid, id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS rank FROM fused) WHERE rank <= 10)"""


def hybrid_hits(spark, sf_dir, k: int = 10) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = table(spark, sf_dir, "documents").join(vectors, F.col("doc_id") == F.col("vec_id")).where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "text", "embedding")
    return r.hybrid_search(fx.blocks(spark, sf_dir), vectors.select(F.col("vec_id").alias("id"), "embedding"), queries, k)


@query("hybrid_search", f"WITH {_HYBRID} SELECT qid, id, rank, round(h.score, 4) AS score, d.source FROM hits h JOIN documents d ON d.doc_id = h.id")
def hybrid_search(spark, sf_dir):
    blocks = fx.blocks(spark, sf_dir)
    return hybrid_hits(spark, sf_dir).join(blocks.select("id", "source"), "id").select("qid", "id", "rank", F.round("score", 4).alias("score"), "source")


@query("search_semantic", f"{_COS} SELECT qid, id, rank, round(score, 4) AS score, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS rank FROM s) JOIN documents ON doc_id = id WHERE rank <= 5")
def search_semantic(spark, sf_dir):
    hits = r.vector_search(table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), 5, id_col="vec_id")
    return r.with_blocks(hits, fx.blocks(spark, sf_dir)).select("qid", "id", "rank", "score", F.length("content").cast("long").alias("n_chars"))


@query("rrf_fusion", "WITH a AS (SELECT user_id AS qid, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS rank FROM events), b AS (SELECT user_id AS qid, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events), f AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 8) AS score FROM (SELECT * FROM a WHERE rank <= 50 UNION ALL SELECT * FROM b WHERE rank <= 50) GROUP BY qid, id) SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS rank FROM f) WHERE rank <= 10")
def rrf_fusion(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), "value", "ts")
    return r.rrf([r.top_k(e, 50, score_col="value"), r.top_k(e, 50, score_col="ts")], 10)


@query("rerank_scores", "WITH c AS (SELECT user_id AS qid, event_id AS id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS rank FROM events), n AS (SELECT *, CAST(round(value) AS BIGINT) % 11 AS rerank_score FROM c WHERE rank <= 20) SELECT * FROM (SELECT qid, id, rank, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rank) AS new_rank FROM n) WHERE new_rank <= 5")
def rerank_scores(spark, sf_dir):
    """Candidates of four times the wanted number, ordered by a scorer; ties by the earlier rank."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), "value")
    scorer = lambda c: c.withColumn("rerank_score", F.round("value").cast("long") % 11)
    return r.rerank(r.top_k(e, 20, score_col="value"), scorer, 5).select("qid", "id", "rank", "rerank_score", "new_rank")


_ANSWERS = "SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN '[1, 2.5, 3]' WHEN 1 THEN '{\"scores\": [3, 2, 1]}' WHEN 2 THEN '[1, 2]' WHEN 3 THEN 'no json' ELSE '[\"7\", \"x\", 9]' END AS raw FROM events"


@query("rerank_parse_scores", f"SELECT id, CASE id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 3.0 WHEN 4 THEN 7.0 ELSE 0.0 END AS s0, CASE id % 5 WHEN 0 THEN 2.5 WHEN 1 THEN 2.0 ELSE 0.0 END AS s1, CASE id % 5 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 WHEN 4 THEN 9.0 ELSE 0.0 END AS s2 FROM ({_ANSWERS})")
def rerank_parse_scores(spark, sf_dir):
    answers = spark.sql(_ANSWERS.replace("FROM events", "FROM {events}").replace('\\"', '"').replace("'{\"scores\"", "'{{\"scores\"").replace("1]}'", "1]}}'"), events=table(spark, sf_dir, "events"))
    parsed = answers.select("id", r.parsed_scores(F.col("raw"), F.lit(3)).alias("s"))
    return parsed.select("id", *[F.col("s")[i].alias(f"s{i}") for i in range(3)])


@query("search_with_graph", f"""WITH {_HYBRID}, {fx.ENTITIES_SQL}, {fx.RELATIONS_SQL}, {fx.BRIDGE_SQL},
direct AS (SELECT DISTINCT qid, entity_type || '::' || name AS nid FROM hits JOIN bridge ON id = block_id),
both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
nodes AS (SELECT qid, nid FROM direct UNION SELECT qid, dst FROM direct JOIN both_ ON nid = src),
inside AS (SELECT DISTINCT a.qid, src, dst, rel_type FROM edges JOIN nodes a ON a.nid = src JOIN nodes b ON b.nid = dst AND b.qid = a.qid
  UNION SELECT qid, src, dst, rel_type FROM edges JOIN direct ON nid = src OR nid = dst)
SELECT qid, n_nodes, coalesce(n_relations, 0) AS n_relations FROM (SELECT qid, count(*) AS n_nodes FROM nodes GROUP BY qid) LEFT JOIN (SELECT qid, count(*) AS n_relations FROM inside GROUP BY qid) USING (qid)""")
def search_with_graph(spark, sf_dir):
    nodes, rels = g.context_of_hits(hybrid_hits(spark, sf_dir), fx.bridge(spark, sf_dir), fx.entities(spark, sf_dir), fx.relations(spark, sf_dir), 1)
    return nodes.groupBy("qid").agg(F.count("*").alias("n_nodes")).join(rels.groupBy("qid").agg(F.count("*").alias("n_relations")), "qid", "left").withColumn("n_relations", F.coalesce("n_relations", F.lit(0)))


@query("search_source_documents", f"WITH {_HYBRID}, {fx.DOCUMENTS_SQL} SELECT qid, doc_id, title, first_rank, row_number() OVER (PARTITION BY qid ORDER BY first_rank, doc_id) AS position FROM (SELECT qid, id AS doc_id, min(rank) AS first_rank FROM hits GROUP BY qid, id) JOIN docs USING (doc_id)")
def search_source_documents(spark, sf_dir):
    return g.source_documents(hybrid_hits(spark, sf_dir), fx.blocks(spark, sf_dir), fx.documents(spark, sf_dir))


# -- evaluation ----------------------------------------------------------------

_TRUTH = "truth AS (SELECT item_id AS qid, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_EVAL = f"""WITH {TOKENS_SQL}, {_BENCH.replace("{k}", "10")}, {_TRUTH},
rel AS (SELECT s.qid, s.rank, t.id IS NOT NULL AS relevant FROM sparse s LEFT JOIN truth t ON t.qid = s.qid AND t.id = s.id),
n AS (SELECT qid, count(*) AS n FROM truth GROUP BY qid),
ideal AS (SELECT qid, sum(1 / log2(i + 1)) AS idcg FROM (SELECT qid, unnest(range(1, least(n, 10) + 1)) AS i FROM n) GROUP BY qid),
per AS (SELECT b.item_id AS qid, coalesce(max(CASE WHEN relevant THEN 1.0 ELSE 0.0 END), 0.0) AS hit, coalesce(1.0 / min(rank) FILTER (relevant), 0.0) AS mrr,
  coalesce(sum(CASE WHEN relevant THEN 1 / log2(rank + 1) ELSE 0 END) / any_value(idcg), 0.0) AS ndcg
  FROM benchmark b LEFT JOIN rel ON rel.qid = b.item_id LEFT JOIN ideal i ON i.qid = b.item_id GROUP BY b.item_id)"""


def _evaluated(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    hits = r.bm25_search(fx.blocks(spark, sf_dir), items.withColumnRenamed("question", "text"), 10)
    truth = r.containing(table(spark, sf_dir, "documents"), items).withColumn("grade", F.lit(1))
    return ev.evaluate(items.select("qid"), hits, truth, 10)


@query("eval_hit_mrr_ndcg", f"{_EVAL} SELECT qid, hit, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM per")
def eval_hit_mrr_ndcg(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("qid", "hit", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


@query("eval_summary", f"{_EVAL} SELECT count(*) AS questions, round(coalesce(avg(hit), 0), 6) AS hit_rate, round(coalesce(avg(mrr), 0), 6) AS mrr, round(coalesce(avg(ndcg), 0), 6) AS ndcg FROM per")
def eval_summary(spark, sf_dir):
    return ev.summary(_evaluated(spark, sf_dir))


@query("judge_scores", """SELECT doc_id, round(CASE WHEN a + b > 0 THEN a * 1.0 / (a + b) ELSE 0 END, 4) AS faithfulness, round(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE quality * 1.0 END, 4) AS precision_, CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE 0.75 END AS relevancy
FROM (SELECT *, quality + 1 AS a, toxic * 2 AS b FROM labels)""")
def judge_scores(spark, sf_dir):
    """Judge answers made from the labels: list sizes, a wrong count, a score out of range."""
    labels = table(spark, sf_dir, "labels")
    out = labels.select(
        "doc_id",
        ev.faithfulness(F.array_repeat(F.lit("s"), F.col("quality") + 1), F.array_repeat(F.lit("u"), F.col("toxic") * 2), F.array().cast("array<string>")).alias("faithfulness"),
        ev.context_precision(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.col("quality") == 1)), F.lit(1)).alias("precision_"),
        ev.answer_relevancy(F.when(F.col("doc_id") % 4 == 0, F.lit("7")).otherwise(F.lit("0.75"))).alias("relevancy"),
    )
    return out


@query("cjk_tokens", "SELECT 'a' AS id, 6 AS n, 'foo_1|中|文|文|件|中文|文件' AS t WHERE false UNION ALL SELECT * FROM (VALUES ('run', 5, '中|文|件|中文|文件'), ('mixed', 4, 'spi_reset|中|文|,'), ('split', 3, 'foo|中|文'))")
def cjk_tokens(spark, sf_dir):
    """Literal fixture: CJK runs give characters and pairs; pairs never cross other text."""
    rows = spark.createDataFrame([("run", "中文件"), ("mixed", "SPI_reset 中,文"), ("split", "中foo文")], "id string, text string")
    t = bm25_tokens(F.col("text"))
    return rows.select("id", F.size(t).alias("n"), F.array_join(t, "|").alias("t"))
