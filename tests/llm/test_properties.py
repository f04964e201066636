"""Functions on whole texts against plain versions, over generated texts."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import htmlmain, mil, outliers, simhash, warc
from tests.llm.test_free import _fingerprint, _stats

words = st.lists(st.sampled_from(["a", "b", "A", "é", "😀", "#|", "word", " ", "\x1c"]), max_size=40)
spaces = st.sampled_from([" ", "\n", "\t", "\x0b", "\r\n", "  "])
texts = st.one_of(st.text(max_size=60), st.builds(lambda w, s: s.join(w), words, spaces))


@settings(max_examples=300, deadline=None)
@given(texts)
def test_statistics_match(text):
    assert outliers.text_stats(text)[:5] == _stats(text)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_fingerprints_match(text):
    assert simhash.fingerprint(text) == _fingerprint(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<!--", "-->", "<script>", "</script>", "<br>", "text of it ", "&amp;", "<", ">", "\"", "<a href='", "'>", "</a>", "<nav>", "</nav>", "<p hidden>"]), max_size=30))
def test_any_markup_gives_clean_text(parts):
    text = htmlmain.main_text("".join(parts))
    assert all(line == " ".join(line.split()) and line for line in text.split("\n") if text)
    assert text == "" or set(text.split("\n")) <= set(htmlmain.plain_text("".join(parts)).split("\n"))


@settings(max_examples=100, deadline=None)
@given(st.lists(texts, max_size=6))
def test_every_document_has_passages(some):
    parts = list(mil.encode(some))
    assert sum(len(c) for _, c in parts) == len(some) and all((c >= 1).all() and len(x) == c.sum() for x, c in parts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=5))
def test_records_are_cut_by_length(blocks):
    data = b"".join(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    assert [r["block"] for r in warc.parse(data)] == blocks
