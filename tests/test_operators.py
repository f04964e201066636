"""Operators on small hand-written inputs."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from quillgraph.functions import chunking
from quillgraph.functions.text import bm25_tokens, tokens_of
from quillgraph.operators import evaluation as ev
from quillgraph.operators import graph as g
from quillgraph.operators import markdown as md
from quillgraph.operators import retrieval as r
from quillgraph.operators import status as st
from quillgraph.sources import files


def ids(df, *columns):
    return sorted(tuple(x) for x in df.select(*columns).collect())


# -- retrieval


def test_rrf_prefers_what_both_lists_have(spark):
    dense = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "qid int, id int, rank int")
    sparse = spark.createDataFrame([(0, 2, 1), (0, 4, 2), (0, 5, 3)], "qid int, id int, rank int")
    got = r.rrf([dense, sparse]).orderBy("rank").collect()
    assert got[0].id == 2 and {x.id for x in got} == {1, 2, 3, 4, 5}


def test_rrf_ties_go_to_the_higher_id(spark):
    a = spark.createDataFrame([(0, 1, 1)], "qid int, id int, rank int")
    b = spark.createDataFrame([(0, 2, 1)], "qid int, id int, rank int")
    assert [x.id for x in r.rrf([a, b]).orderBy("rank").collect()] == [2, 1]


def test_tokens(spark):
    got = spark.createDataFrame([("SPI_reset ä", ), ("中foo文", ), (None, )], "t string").select(bm25_tokens(F.col("t")).alias("t")).collect()
    assert got[0].t == ["spi_reset"] and got[1].t == ["foo", "中", "文"] and got[2].t == []


def _corpus(spark):
    return spark.createDataFrame([(1, "SPI reset value"), (2, "GPIO pins"), (3, "timers and counters")], "id long, content string")


def test_bm25_finds_the_block(spark):
    q = spark.createDataFrame([(0, "reset"), (1, ""), (2, "nothing here")], "qid long, text string")
    got = r.bm25_search(_corpus(spark), q).collect()
    assert [(x.qid, x.id) for x in got] == [(0, 1)] and got[0].score > 0


def test_bm25_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, content string")
    assert r.bm25_search(empty, spark.createDataFrame([(0, "reset")], "qid long, text string")).count() == 0


def test_vector_search_is_exact_and_skips_nothing(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0])], "id long, embedding array<float>")
    got = r.vector_search(v, v.where("id = 3").withColumnRenamed("id", "qid"), 3).orderBy("rank").collect()
    assert [x.id for x in got] == [3, 2, 1] and got[1].score == pytest.approx(0.707107)
    assert r.vector_search(v, v.where("id < 0").withColumnRenamed("id", "qid"), 3).count() == 0


def test_wrong_dimension_raises(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        r.normalized(v, dim=3).collect()


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    hits = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 9, 1)], "qid int, id int, rank int")
    truth = spark.createDataFrame([(1, 1, 3), (1, 2, 2), (1, 3, 1), (2, 8, 1)], "qid int, id int, grade int")
    got = {x.qid: x for x in ev.evaluate(q, hits, truth, 3).collect()}
    assert (got[1].hit, got[1].mrr, got[1].ndcg) == (1.0, 1.0, pytest.approx(1.0))
    assert (got[2].hit, got[2].mrr, got[2].ndcg) == (0.0, 0.0, 0.0) and got[3].ndcg == 0.0


# -- graph


def _chain(spark):
    e = spark.createDataFrame([("M", n) for n in "ABCD"], "entity_type string, name string")
    rel = [("M", "A", "M", "B", "CONTAINS"), ("M", "B", "M", "C", "CONTAINS"), ("M", "C", "M", "D", "CONTAINS"), ("M", "A", "M", "C", "HAS_SIGNAL")]
    return e, spark.createDataFrame(rel, "from_type string, from_name string, to_type string, to_name string, rel_type string")


def test_subgraph_is_induced(spark):
    e, rel = _chain(spark)
    center = spark.createDataFrame([(0, "M", "B"), (1, "M", "nobody")], "qid int, entity_type string, name string")
    nodes, edges = g.subgraph(e, rel, center, 1, ["CONTAINS"])
    assert ids(nodes, "nid") == [("M::A",), ("M::B",), ("M::C",)] and edges.count() == 3
    assert g.subgraph(e, rel, center, 0)[0].count() == 1


def test_paths(spark):
    _, rel = _chain(spark)
    pairs = spark.createDataFrame([(0, "M::A", "M::C"), (1, "M::A", "M::D"), (2, "M::A", "M::A")], "qid int, src string, dst string")
    count = lambda depth, types=None: {x.qid: x["count"] for x in g.find_paths(rel, pairs, depth, types).groupBy("qid").count().collect()}
    assert count(3) == {0: 2, 1: 2} and count(2) == {0: 2, 1: 1} and count(3, ["HAS_SIGNAL"]) == {0: 1}


def test_neighbors_keep_doubles(spark):
    rel = spark.createDataFrame([("M", "A", "M", "B", "X"), ("M", "B", "M", "A", "X"), ("M", "A", "M", "A", "X")], "from_type string, from_name string, to_type string, to_name string, rel_type string")
    start = spark.createDataFrame([(0, "M", "A")], "qid int, entity_type string, name string")
    assert ids(g.neighbors(rel, start), "name") == [("A",), ("A",), ("B",), ("B",)]


VERSION = "entity_type string, name string, merge_seq int, source_doc_ids array<string>, properties map<string,string>, source_chapter string, confidence double, verified boolean, feedback_score long"


@pytest.mark.parametrize(
    ("versions", "value", "conflicts"),
    [
        ([("a", {"w": "32"}), ("b", {"w": "64"})], "32", 1),
        ([("a", {"w": "32"}), ("b", {"w": "64", "x": "1"})], "64", 1),
        ([("a", {"w": "32"}), ("b", {"w": "32", "x": "1"})], "32", 0),
        ([("a", {"w": "A"}), ("b", {"w": "A", "p": "1", "q": "1", "r": "1", "s": "1"}), ("c", {"w": "B", "p": "1", "q": "1"})], "B", 1),
        ([("a", {"w": "A"}), ("a", {"v": "1"}), ("b", {"w": "B", "x": "1", "y": "1"})], "A", 1),
    ],
)
def test_merge(spark, versions, value, conflicts):
    rows = [("T", "n", i, [d], p, "", 1.0 - i / 10, i == 1, 0) for i, (d, p) in enumerate(versions)]
    merged, found = g.merge_entities(spark.createDataFrame(rows, VERSION))
    row = merged.first()
    assert row.properties["w"] == value and found.count() == conflicts
    assert row.source_doc_ids == sorted({d for d, _ in versions}) and row.verified == (len(versions) > 1)


def test_removed_document_leaves_shared_nodes(spark):
    e = spark.createDataFrame([("M", "A", ["d1", "d2"]), ("M", "B", ["d1"]), ("M", "C", [])], "entity_type string, name string, source_doc_ids array<string>")
    rel = spark.createDataFrame([("M", "A", "M", "B", "X", ["d2"]), ("M", "A", "M", "C", "X", ["d2"])], "from_type string, from_name string, to_type string, to_name string, rel_type string, source_doc_ids array<string>")
    nodes, edges = g.remove_document(e, rel, "d1")
    assert ids(nodes, "name") == [("A",), ("C",)] and ids(edges, "to_name") == [("C",)]


# -- Markdown and chunks


def test_headings_and_fences():
    text = "lost\n# One\ntext\n```\n# no\n```\n## Two\n### 2020-01-01\n#no\nmore\n####### deep"
    assert [(n.level, n.title, n.parent) for n in md.parse(text)] == [(1, "One", -1), (2, "Two", 0), (7, "deep", 1)]
    assert md.parse("plain")[0].content == "plain" and md.parse("plain")[0].title == ""


def test_blocks_share_the_section(spark):
    text = "# R\n\npre\n\n## S\n\ns\n\n### T\n\nt\n\n#### U\n\nu\n\n##### V\n\nv"
    blocks, maps = md.build_blocks(text)
    assert len(blocks) == 1 and blocks[0][3].startswith("# R\n\npre\n\n## S\n\ns\n\n### T")
    assert [(m[0], m[2], m[3]) for m in maps] == [("S", "R", ["b_0"]), ("T", "S", ["b_0"]), ("U", "T", ["b_0"])]


def test_childless_roots():
    text = "# A\n\nlost\n\n# B\n\n## s\n\nkept"
    assert [b[2] for b in md.build_blocks(text)[0]] == ["s"] and [b[2] for b in md.build_blocks(text, lossless=True)[0]] == ["A", "s"]
    assert md.build_blocks("only text")[0] == [("b_0", 0, "", "only text")]


def test_chunker_sizes():
    assert len(chunking.split_paragraphs("A. " * 200, 200)) == 3
    table = "|a|b|\n|-|-|\n" + "\n".join(f"|{i}|x|" for i in range(200))
    pieces = chunking.split_paragraphs(table, 300)
    assert len(pieces) > 1 and all(p.startswith("|a|b|\n|-|-|") for p in pieces)
    code = "```py\n" + "\n\n".join("x" * 50 for _ in range(20)) + "\n```"
    assert all(p.startswith("```py\n") and p.endswith("```") for p in chunking.split_paragraphs(code, 200))
    html = "<table><thead><tr><th>h</th></tr></thead><tbody>" + "<tr><td>x</td></tr>" * 100 + "</tbody></table>"
    assert sum(p.count("<td>") for p in chunking.split_paragraphs(html, 400)) == 100
    assert chunking.split_paragraphs("a\n\n```\nx\n\ny\n```", 100) == ["a\n\n```\nx\n\ny\n```"]


def test_chunks_lose_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = chunking.chunked(docs, chunking.split_for_embedding, 1000).toPandas().sort_values(["doc_id", "seq"])
    squeezed = lambda s: "".join(s.split())
    want = {x.doc_id: squeezed(x.text) for x in docs.collect()}
    assert {d: squeezed("".join(x)) for d, x in got.groupby("doc_id")["chunk"]} == want and got["chunk"].str.len().max() <= 1000


@settings(max_examples=200, deadline=None)
@given(st_.lists(st_.sampled_from(["word ", "End. ", "\n\n", "\n", "```\n", "|a|b|\n", "<table>", "</table>", "x" * 30, "中。 "]), max_size=60), st_.integers(8, 80))
def test_any_text_is_kept(parts, most):
    text = "".join(parts)
    squeezed = lambda s: "".join(s.split())
    if not any(x in text for x in ("```", "|", "<table>")):  # fences and heads of tables are repeated by design
        assert squeezed("".join(chunking.split_paragraphs(text, most))) == squeezed(text)
    pieces = chunking.split_for_embedding(text, most)
    assert pieces and all(len(p) <= most for p in pieces) or not text.strip() or any(x in text for x in ("```", "|", "<table>"))


def test_size_bins():
    assert chunking.size_bins([5, 5, 5, 20, 1], 10) == [0, 0, 1, 2, 3]
    assert chunking.split_for_client("abc\n\ndef", 100) == ["abc\n\ndef"] and chunking.split_for_client("a" * 10, 4) == ["aaaa", "aaaa", "aa"]


# -- logs and files


def test_feedback_and_activation(spark):
    fb = spark.createDataFrame([("E", "a", 1), ("E", "a", -1)], "entity_type string, name string, rating int")
    e = spark.createDataFrame([("E", "a", 0), ("E", "b", 4)], "entity_type string, name string, feedback_score long")
    assert ids(g.apply_feedback(e, fb, g.ENTITY_KEY), "name", "feedback_score") == [("a", 0), ("b", 4)]
    logs = spark.sql("SELECT 7L AS block_id, timestamp'2024-01-01' AS created_at UNION ALL SELECT 7L, timestamp'2024-01-02'")
    assert st.block_activation(logs).first().hit_count == 2


def test_stream_equals_batch(spark, tmp_path):
    from quillgraph.streaming.usage import activation_stream

    logs = spark.sql("SELECT id % 3 AS block_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id) AS created_at FROM range(40)")
    logs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "in"))
    run = activation_stream(stream).writeStream.format("memory").queryName("activation").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    total = spark.table("activation").groupBy("block_id").agg(F.sum("hit_count").alias("hit_count"))
    assert ids(total, "block_id", "hit_count") == ids(st.block_activation(logs), "block_id", "hit_count")


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"pdf")
    (tmp_path / "note.txt").write_text("hi ${name} $other")
    found = files.scan(spark, str(tmp_path)).collect()
    assert len(found) == 1 and len(found[0].doc_id) == 16
    prompt = files.read_prompts(spark, str(tmp_path / "note.txt")).select("name", files.filled(F.col("template"), {"name": F.lit("you")}).alias("t")).first()
    assert tuple(prompt) == ("note", "hi you $other")
    lines = spark.createDataFrame([('{"a": 1}',), ("",), ("{bad",)], "value string")
    assert files.parsed_lines(lines, "a int").collect()[0].a == 1 and files.parsed_lines(lines, "a int").count() == 1


def test_graph_round_trip(spark, tmp_path):
    e, rel = _chain(spark)
    files.save_graph(e, rel, str(tmp_path / "g"))
    e2, rel2 = files.load_graph(spark, str(tmp_path / "g"))
    assert ids(e, "name") == ids(e2, "name") and rel.count() == rel2.count()


def test_headings_of_nine_levels_and_a_cycle(spark):
    """All generations come out, by a recursive query over the same rows."""
    import duckdb

    rows = [(1, f"level {i} of it", i, f"level {i - 1} of it") for i in range(1, 10)] + [(1, "aside", 2, "elsewhere"), (2, "level 1 of it", 1, "level 2 of it"), (2, "level 2 of it", 2, "level 1 of it"), (3, "none", 1, None)]
    maps = spark.createDataFrame(rows, "doc_id long, heading_title string, heading_level int, parent_heading string")
    got = {(r.doc_id, r.heading_title, r.heading_level) for r in md.heading_descent(maps, "EVEL 1").collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE maps (doc_id BIGINT, t VARCHAR, l INT, p VARCHAR)")
    c.executemany("INSERT INTO maps VALUES (?, ?, ?, ?)", rows)
    want = c.execute("WITH RECURSIVE d AS (SELECT doc_id, t, l FROM maps WHERE t ILIKE '%evel 1%' UNION SELECT m.doc_id, m.t, m.l FROM maps m JOIN d ON m.doc_id = d.doc_id AND m.p = d.t) SELECT * FROM d").fetchall()
    assert got == set(want) and len(got) == 11


# -- what grows with the corpus


ODD_TEXTS = [None, "", "  \t\n", "SPI_reset ä, x-y!", "中foo文件", "a b c \x1c d", "½ ² ५ é Ⅷ", "€100 — „q“ 中, 文字", "İSTANBUL ΟΔΟΣ 😀", "_ __ a_b 1_2 #$%&"]


def test_tokens_are_the_same_in_both_engines(spark):
    rows = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id long, t string")
    got = rows.select("id", bm25_tokens(F.col("t")).alias("t"), F.lower("t").cast("binary").alias("low")).collect()
    assert [sorted(x.t) for x in got] == [sorted(tokens_of(bytes(x.low) if x.low is not None else None)) for x in got]


def _plain_bm25(rows, queries, k):
    """By hand: rows of one id and length are one block, as postings are grouped so."""
    tokens = [(i, tokens_of(t.lower().encode() if t else None)) for i, t in rows]
    n, avg = len(tokens), sum(len(t) for _, t in tokens) / len(tokens)
    post = Counter((i, len(t), x) for i, t in tokens for x in t)
    df = Counter(x for _, _, x in {(j, 0, x) for j, (_, t) in enumerate(tokens) for x in t})
    raw = {x: math.log(n - d + 0.5) - math.log(d + 0.5) for x, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    out = {}
    for q, text in queries:
        scores = Counter()
        for x, qtf in Counter(tokens_of(text.lower().encode())).items():
            for (i, dl, y), tf in post.items():
                if x == y:
                    scores[i] += qtf * (raw[x] if raw[x] >= 0 else 0.25 * mean) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
        best = sorted(((round(s, 6), i is not None, i if i is not None else 0) for i, s in scores.items() if round(s, 6) > 0), reverse=True)[:k]
        out[q] = [i if some else None for _, some, i in best]
    return out


@pytest.mark.parametrize("bounds", [{}, {"QUERY_TERMS": 7, "DENSE_BYTES": 64, "SCORE_BYTES": 64, "TERM_ROWS": 5, "VOCABULARY": 3}])
def test_bm25_by_hand_with_repeated_ids(spark, monkeypatch, bounds):
    """Also with blocks of queries, dense matrices and batches of a few rows; the index finds the same."""
    for name, value in bounds.items():
        monkeypatch.setattr(r, name, value)
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    rows = [(i, " ".join(words[(i * j) % 10] if j % 3 else words[i % 7] for j in range(1, 3 + i % 5))) for i in range(60)]
    rows += [(7, rows[7][1]), (8, "alpha alpha beta"), (None, "alpha kappa"), (None, "kappa kappa kappa"), (61, None)]
    queries = [(q, " ".join(words[(q + j) % 10] for j in range(3))) for q in range(12)]
    blocks = spark.createDataFrame(rows, "id long, content string").repartition(5)
    asked = spark.createDataFrame(queries, "qid long, text string")
    want = _plain_bm25(rows, queries, 4)
    df, stats = r.lexicon(blocks)
    index = (r.postings(blocks), r.inverse_frequencies(df, stats), stats)
    for got in (r.bm25_search(blocks, asked, 4), r.bm25_search(blocks, asked, 4, index=index)):
        hits = {q: [] for q, _ in queries}
        for x in got.orderBy("qid", "rank").collect():
            hits[x.qid].append(x.id)
        assert hits == want


def _moved(df):
    """Rows of each exchange of the executed plan."""
    df.collect()
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if "ShuffleExchange" in node.getClass().getSimpleName():
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        if "AdaptiveSparkPlan" in node.getClass().getSimpleName():
            nodes.append(node.executedPlan())
        elif "QueryStage" in node.getClass().getSimpleName():
            nodes.append(node.plan())
        else:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_search_moves_no_pairs_of_block_and_query(spark):
    """Every block meets every query; 400 x 40 pairs, of which a task sends 3 a query."""
    blocks = spark.range(400).selectExpr("id", "concat('common word', id % 9, ' common') AS content", "array(float(id), 1f) AS embedding").repartition(2)
    asked = spark.range(40).selectExpr("id AS qid", "concat('common word', id % 9) AS text", "array(1f, float(id)) AS embedding")
    assert max(_moved(r.bm25_search(blocks, asked, 3))) <= 400
    assert max(_moved(r.vector_search(blocks, asked, 3))) <= 400
    assert max([0, *_moved(r.postings(blocks))]) <= 400


def test_containing_finds_items_without_inner_words(spark):
    docs = [(1, "one two three four"), (2, "xone two threex"), (3, None), (4, "two"), (5, "one  two three")]
    items = [(0, "one two three"), (1, "two"), (2, ""), (3, "e t"), (4, None), (5, "one  two"), (6, "e two th"), (7, "one two three four five")]
    got = r.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "qid long, question string"))
    assert ids(got, "qid", "id") == sorted((q, i) for q, x in items for i, t in docs if x is not None and t is not None and x in t)


def test_answers_are_parsed_in_many_tasks_and_once(spark):
    """Rows of one row group are dealt out, and no filter repeats the parsing."""
    from conftest import DATA
    from quillgraph.plans.document_queries import _answers as answers
    from quillgraph.operators import extraction as ex

    lines, chapters = answers(spark, DATA)
    assert lines.rdd.getNumPartitions() >= 4
    for df in ex.extract_results(lines, chapters):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 3


def test_groups_are_made_in_partitions_in_proportion_to_the_input(spark, monkeypatch):
    from conftest import DATA
    from quillgraph import session
    from quillgraph.plans import QUERIES, fixtures as fx

    monkeypatch.setattr(session, "PART_BYTES", 1 << 12)
    n = session.parts_of(fx.table(spark, DATA, "lineitem").select("l_orderkey"))
    plan = str(fx.bridge(spark, DATA)._jdf.queryExecution().executedPlan())
    assert n > 10 and f", {n}), REPARTITION_BY_NUM" in plan
    for name in ("entities_by_block", "merge_relations", "merge_missing_endpoints", "section_relations"):
        assert "REPARTITION_BY_NUM" in str(QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan())


def test_the_last_step_of_a_path_goes_to_its_end(spark):
    """A start with 500 ways; of the last step's rows only those at the end are made."""
    rel = spark.createDataFrame([("M", "A", "M", f"b{i}", "X") for i in range(500)] + [("M", f"b{i}", "M", f"c{j}", "X") for i in range(500) for j in range(3)] + [("M", "A", "M", "c1", "X"), ("M", "A", "M", "c1", "Y")], "from_type string, from_name string, to_type string, to_name string, rel_type string")
    found = g.find_paths(rel, spark.createDataFrame([(0, "M::A", "M::c1")], "qid int, src string, dst string"), 2)
    assert sorted((x.length, len(x.path)) for x in found.collect()) == [(1, 2)] + [(2, 3)] * 500
    assert sum(_moved(found) or [0]) == 0


def test_separators_of_equal_boxes(spark):
    """Equal boxes are one island, wherever a sort puts them."""
    from quillgraph.operators import layout as ly

    boxes = [(145164, 200.0, 220.0), (145164, 200.0, 230.0), (145164, 600.0, 644.0), (145164, 600.0, 644.0)]
    rows = spark.createDataFrame([("d", p, "heading", a, b) for p, a, b in boxes], "doc_id string, page long, kind string, y0 double, y1 double")
    assert ids(ly.separators(rows), "y0", "y1") == [(200.0, 230.0), (600.0, 644.0)]
