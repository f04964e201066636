"""The verbs over one small knowledge base."""

import pytest

from quillgraph.service import KnowledgeBase

TEXT = "# Guide\n\nintro\n\n## Reset\n\nThe SPI reset value is zero.\n\n## Pins\n\nGPIO pins are inputs.\n\n### Modes\n\nTwo modes."


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    kb = KnowledgeBase(spark, str(tmp_path_factory.mktemp("kb")))
    kb.ingest(spark.createDataFrame([("a/guide.md", TEXT), ("a/other.md", "# T\n\n## Timers\n\ntimers count")], "source_path string, text string"))
    return kb


def _queries(spark):
    return spark.createDataFrame([(0, "reset value", [1.0, 0.0])], "qid long, text string, embedding array<float>")


def test_ingest_again_replaces(spark, kb):
    n = kb.table("blocks").count()
    assert n == 3 and kb.table("heading_maps").count() == 4
    kb.ingest(spark.createDataFrame([("a/other.md", "# T\n\n## Timers\n\ncounters now")], "source_path string, text string"))
    assert kb.table("documents").count() == 2 and kb.table("blocks").count() == n
    assert kb.table("blocks").where("content LIKE '%counters now%'").count() == 1


def test_search_read_and_logs(spark, kb):
    block = kb.table("blocks").where("section_title = 'Reset'").first()
    kb.add_vectors(spark.createDataFrame([(block.id, [1.0, 0.0])], "id long, embedding array<float>"))
    kb.add_vectors(spark.createDataFrame([(block.id, [0.0, 1.0])], "id long, embedding array<float>"))
    for mode in ("semantic", "keyword", "hybrid"):
        assert kb.search(_queries(spark), mode, 1, session_id="s").first().id == block.id
    with pytest.raises(ValueError):
        kb.search(_queries(spark), "other")
    assert kb.status("trace", session_id="s").count() == 3 and kb.status("usage").first().hit_count == 3
    assert "reset value" in kb.read(block.doc_id, chapter="reset").first().content
    assert kb.read(block.doc_id, regex="^Mod").first().content.startswith("## Pins")
    assert kb.read(block.doc_id).first().blocks == 2 and kb.status("vectors").first().consistent


def test_graph_verbs(spark, kb):
    block = kb.table("blocks").where("section_title = 'Pins'").first()
    e = spark.createDataFrame([("Module", "GPIO", 1, "d1", {"width": "8"}), ("Module", "GPIO", 2, "d2", {"width": "16", "x": "1"}), ("Pin", "P1", 1, "d1", {})], "entity_type string, name string, merge_seq long, doc_id string, properties map<string,string>")
    rel = spark.createDataFrame([("Module", "GPIO", "Pin", "P1", "HAS_PIN", 1, "d1", {}), ("Module", "GPIO", "Pin", "P2", "HAS_PIN", 1, "d2", {})], "from_type string, from_name string, to_type string, to_name string, rel_type string, merge_seq long, doc_id string, properties map<string,string>")
    refs = spark.createDataFrame([(block.id, "Module", "GPIO")], "block_id long, entity_type string, name string")
    kb.add_extractions(e, rel, refs)
    assert kb.explore("entity", entity_type="Module", name="GPIO").first().properties["width"] == "16"
    assert kb.explore("conflicts").count() == 1 and kb.table("entities").count() == 3
    assert kb.explore("neighbors", entity_type="Module", name="GPIO").count() == 2
    assert kb.explore("path", from_type="Module", from_name="GPIO", to_type="Pin", to_name="P2").first().path == ["Module::GPIO", "Pin::P2"]
    assert kb.explore("provenance", entity_type="Module", name="GPIO").first().preview.startswith("## Pins")
    kb.submit_feedback(spark.createDataFrame([("Module", "GPIO", -1, "")], "entity_type string, name string, rating int, comment string"))
    kb.upsert_entity(spark.createDataFrame([("Module", "GPIO", 0.2), ("Module", "ADC", 0.9)], "entity_type string, name string, confidence double"))
    kb.verify(spark.createDataFrame([("Pin", "P1")], "entity_type string, name string"))
    got = {x.name: x for x in kb.table("entities").collect()}
    assert got["GPIO"].feedback_score == -1 and got["GPIO"].confidence == 0.2 and got["ADC"].confidence == 0.9 and got["P1"].verified
    assert kb.status("quality").first().score < 100
    kb.delete_entities(spark.createDataFrame([("Pin", "P1")], "entity_type string, name string"))
    assert kb.table("relations").count() == 1


def test_every_scope_answers(kb):
    for frame in kb.status_all().values():
        frame.collect()
    with pytest.raises(ValueError):
        kb.status("nothing")


def test_removed_document(spark, kb):
    doc = kb.table("documents").where("source_path = 'a/other.md'").first().doc_id
    kb.remove_document(doc)
    assert kb.table("blocks").where(f"doc_id = '{doc}'").count() == 0 and kb.table("documents").count() == 1


def test_server_speaks_json_rpc(kb):
    import io
    import json

    from quillgraph.server import TOOLS, serve

    lines = ['{"jsonrpc": "2.0", "id": 1, "method": "initialize"}', '{"jsonrpc": "2.0", "method": "notifications/initialized"}', "", "{bad", '{"jsonrpc": "2.0", "id": 2, "method": "tools/list"}', '{"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "status", "arguments": {"scope": "graph"}}}', '{"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "status", "arguments": {"scope": "none"}}}', '{"jsonrpc": "2.0", "id": 5, "method": "other"}']
    out = io.StringIO()
    serve(kb, lines, out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in got] == [1, None, 2, 3, 4, 5] and len(got[2]["result"]["tools"]) == len(TOOLS)
    assert "nodes" in got[3]["result"]["content"][0]["text"] and got[4]["result"]["isError"] and got[5]["error"]["code"] == -32601


def test_office_files(spark):
    import io
    import zipfile

    from quillgraph.sources.office import office_text

    def packed(**parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in parts.items():
                z.writestr(name.replace("__", "/") + ".xml", text)
        return out.getvalue()

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    docx = packed(word__document=f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl></w:body></w:document>")
    xlsx = packed(xl__sharedStrings=f"<sst {m}><si><t>name</t></si></sst>", xl__worksheets__sheet1=f'<worksheet {m}><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>')
    files = spark.createDataFrame([("x.docx", docx), ("y.xlsx", xlsx), ("z.docx", b"bad"), ("n.txt", b"")], "path string, content binary")
    assert {r.path: r.text for r in office_text(files).collect()} == {"x.docx": "Hello\na | b", "y.xlsx": "name | 7", "z.docx": None, "n.txt": None}


def test_a_write_that_fails_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    kb = KnowledgeBase(spark, str(tmp_path / "kb2"))
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    two = spark.createDataFrame([(2, [0.0, 1.0])], "id long, embedding array<float>")
    kb.replace("vectors", one)

    def stop(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(KnowledgeBase, "_swap", stop)
        with pytest.raises(OSError):
            kb.append("vectors", two)
    assert [r.id for r in kb.table("vectors").collect()] == [1]
    kb.append("vectors", two)
    assert sorted(r.id for r in kb.table("vectors").collect()) == [1, 2]


def test_long_answers_say_that_they_are_cut(spark):
    from quillgraph.server import _rows

    assert _rows(spark.range(5), 3)[3:] == [{"truncated": True, "shown": 3}] and len(_rows(spark.range(3), 3)) == 3
