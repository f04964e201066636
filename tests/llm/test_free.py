"""The operators without a SQL form: brute force, round trips and held-out accuracy."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F
from tests.llm.test_native import LOWER, WORD

from quillgraph.llm import common, components, htmlmain, linededup, mil, outliers, simhash, tokencount, warc
from quillgraph.llm.queries import QUERIES

# -- SimHash


def _fingerprint(text, k=3):
    w = WORD.findall((text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(items, near):
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def _close(a, b, radius=2):
    return (a ^ b).bit_count() <= radius


def test_simhash_of_odd_rows(odd, odd_rows):
    prints = [_fingerprint(r[1]) for r in odd_rows]
    group = _classes(prints, _close)
    smallest = defaultdict(lambda: None)
    for r, c in zip(odd_rows, group, strict=True):
        if r[0] is not None:
            smallest[c] = r[0] if smallest[c] is None else min(r[0], smallest[c])
    got = simhash.near_duplicates(odd).collect()
    assert Counter((x.doc_id, x.fp % (1 << 64), x.component_id) for x in got) == Counter((r[0], f, smallest[c]) for r, f, c in zip(odd_rows, prints, group, strict=True))


def test_simhash_of_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.representatives(nothing).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 6])
def test_tables_lose_no_pair(radius):
    rng = np.random.default_rng(radius)
    masks = [m % (1 << 64) for m in simhash.tables(radius)]
    for _ in range(3000):
        d = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, radius + 1), replace=False))
        assert any(m & d == 0 for m in masks)


@pytest.mark.parametrize(("radius", "words"), [(2, 1), (5, 1), (20, 4)])
def test_bit_sliced_links(radius, words):
    rng = np.random.default_rng(1)
    fps = []
    for _ in range(30):
        x = int.from_bytes(rng.bytes(8 * words), "little")
        for _ in range(rng.integers(1, 12)):
            fps.append(x)
            for b in rng.choice(64 * words, rng.integers(1, radius + 3), replace=False):
                x ^= 1 << int(b)
    rng.shuffle(fps)
    array = np.array([[f >> 64 * i & (1 << 64) - 1 for i in range(words)] for f in fps], np.uint64)
    union = simhash._Union(len(fps))
    simhash.link(array, np.array([0]), radius, union)
    assert list(union.root) == _classes(fps, lambda a, b: _close(a, b, radius))


def test_large_runs_are_parted_exactly():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 18, 1500).astype(np.uint64))[:, None]
    want = simhash._Union(len(fps))
    simhash.link(fps, np.array([0]), 2, want)
    got = simhash._Union(len(fps))
    simhash._link_large(fps, np.arange(len(fps)), simhash._exact_ways((1 << 64) - (1 << 22), 2), 2, got, 64)
    assert list(got.root) == list(want.root)


def test_links_over_batches(spark):
    """Keys whose rows go on over Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        fps = [0, 3, 12, 48, 192, 1 << 40, 1 << 41, 5 << 40] + [i << 20 for i in range(1, 40)]
        got = components.components(simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = _classes(sorted(fps), _close)
    assert {x.node: x.label for x in got} == {f: sorted(fps)[c] for f, c in zip(sorted(fps), want, strict=True) if want.count(c) > 1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (900, -3)]
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 900: -3, -3: -3}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_texts(spark):
    """Copies at stated similarities: near ones share a group, far ones never do."""
    rng = np.random.default_rng(4)
    rows, sets = [], {}
    for base in range(60):
        words = [f"v{x}" for x in rng.integers(0, 50_000, 300)]
        for copy, changed in enumerate((0, 0, 2, 4, 120)):
            w = list(words)
            for at in rng.choice(300, changed, replace=False):
                w[at] = f"c{base}-{copy}-{at}"
            i = base * 10 + copy
            rows.append((i, " ".join(w)))
            sets[i] = {tuple(w[k : k + 5]) for k in range(296)}
    got = {x.id: x.first_id for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    near = [(i, j) for i in sets for j in sets if i // 10 == j // 10 and i < j and _jaccard(sets[i], sets[j]) >= 0.85]
    assert sum(got[i] == got[j] for i, j in near) >= 0.97 * len(near)
    assert all(got[i] // 10 == i // 10 for i in sets) and all(got[i] == i for i in sets if i % 10 == 4)


def test_similar_texts_match_brute_force(spark):
    """Around the threshold no link is lost and none is wrong; chains go over verified pairs only."""
    rng = np.random.default_rng(6)
    texts = {}
    for base in range(80):
        words = [f"v{x}" for x in rng.integers(0, 50_000, 300)]
        for copy, changed in enumerate((0, 2, 4, 6, 7, 8, 9)):
            w = list(words)
            for at in rng.choice(300, changed, replace=False):
                w[at] = f"c{base}-{copy}-{at}"
            texts[base * 10 + copy] = w
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    ids = sorted(texts)
    near = [(i, j) for i in ids for j in ids if i // 10 == j // 10 and i < j and _jaccard(sets[i], sets[j]) >= 0.8]
    root = {i: i for i in ids}
    for _ in ids:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    assert len(set(root.values())) > 100
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(4)
    assert {x.id: x.first_id for x in simhash.similar(docs).collect()} == root


def test_large_runs_lose_no_pair():
    """A band that more than SPLIT rows share is compared whole, across batches too."""
    n = simhash.SPLIT + 904
    nodes = np.arange(n)
    labels = np.where(nodes % 1000 == 0, nodes, n)
    columns = [np.zeros(n, np.int64), np.zeros(n, np.int64), nodes, np.full(n, 100), labels]
    batches = [simhash.pa.RecordBatch.from_arrays([simhash.pa.array(c[i : i + 700]) for c in columns], names=list("tknsl")) for i in range(0, n, 700)]
    got = [p for batch in simhash._runs(iter(batches), simhash._cross_pairs(0.8)) for p in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    alone = set(nodes[nodes % 1000 == 0].tolist())
    assert len(got) == len(set(got)) and set(got) == {(max(a, b), min(a, b)) for a in alone for b in range(n) if a != b}


def _cross_batches(rows, size):
    columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
    return [simhash.pa.RecordBatch.from_arrays([simhash.pa.array(c[i : i + size]) for c in columns], names=[str(k) for k in range(len(columns))]) for i in range(0, len(rows), size)]


def test_cross_pairs_match_brute_force():
    """Several runs, labels, sizes and SimHashes: the pairs are those of a plain loop."""
    rng = np.random.default_rng(12)
    rows, node = [], 0
    for run in range(60):
        base = rng.integers(0, 1 << 62, simhash.WIDE)
        for size in np.sort(rng.integers(50, 90, rng.integers(1, 150 if run % 7 == 0 else 9))):
            flips = rng.integers(0, 1 << 62, simhash.WIDE) & rng.integers(0, 1 << 62, simhash.WIDE) & rng.integers(0, 1 << 62, simhash.WIDE)
            rows.append((run % 3, run, node, int(size), int(rng.integers(0, 4)), int(rng.integers(0, 3)) if run % 2 else 0, *(base ^ flips)))
            node += 1
    rows.sort(key=lambda r: (r[0], r[1], r[3], r[2]))
    radius = 60
    got = [p for b in simhash._runs(iter(_cross_batches(rows, 37)), simhash._cross_pairs(0.8, radius)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want = set()
    for i, x in enumerate(rows):
        for y in rows[:i]:
            bits = sum((int(a) ^ int(b)).bit_count() for a, b in zip(x[6:], y[6:], strict=True))
            if x[:2] == y[:2] and x[4] != y[4] and min(x[3], y[3]) >= 0.8 * max(x[3], y[3]) and (x[5] == 0 or x[5] != y[5]) and bits <= radius:
                want.add((max(x[2], y[2]), min(x[2], y[2])))
    assert len(got) == len(set(got)) and set(got) == want and 100 < len(want)


def test_large_keys_meet_in_tiles(spark):
    """A key parted into tiles gives the pairs that it gives whole, and no task's tile holds all of its rows."""
    n = 300
    rows = [(i, 100, i, [5, i], *([i] * simhash.WIDE)) for i in range(n)]
    nodes = spark.createDataFrame(rows, "node long, n long, label long, keys array<long>, " + ", ".join(f"f{i} long" for i in range(simhash.WIDE)))
    tiles = simhash._dealt(nodes, 2, large=50, looked_at=1).sort("t", "key", "n", "node").collect()
    assert max(Counter((r.t, r.key) for r in tiles).values()) < n / 2
    got = [p for b in simhash._runs(iter(_cross_batches([tuple(r) for r in tiles], 1000)), simhash._cross_pairs(0.8, 255)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(got) == len(set(got)) == n * (n - 1) // 2


def test_many_alike_but_different_texts(spark):
    """Thousands of different texts of one template end as one group, and those below the threshold apart."""
    rng = np.random.default_rng(13)
    base = [f"v{x}" for x in rng.integers(0, 50_000, 200)]
    rows = []
    for i in range(3000):
        w = list(base)
        for at in rng.choice(200, 2 if i < 2900 else 60, replace=False):
            w[at] = f"c{i}-{at}"
        rows.append((i, " ".join(w)))
    got = {x.id: x.first_id for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[i] == 0 for i in range(2900)) and all(got[i] == i for i in range(2900, 3000))


def test_one_of_each_group_stays(odd, odd_rows):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    got = Counter((x.doc_id, x.text) for x in kept.collect())
    assert max(got.values()) == 1
    same = defaultdict(list)
    for r in odd_rows:
        same[" ".join(WORD.findall((r[1] or "").translate(LOWER)))].append((r[0] is None, r[0], r[1]))
    assert len(got) == len(same)
    assert all((g := min(v, key=lambda x: (x[0], x[1] or 0)))[1] in [k[0] for k in got if " ".join(WORD.findall((k[1] or "").translate(LOWER))) == n] for n, v in same.items() if (g := min(v, key=lambda x: (x[0], x[1] or 0))))


# -- quality rules


def _stats(text):
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    twice = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice)


@pytest.mark.parametrize("text", ["", " \n\t", "a b c d e a b c d e x", "a a a a a a a", "x\nx\n x\n\n\ny\ny", "é😀 #|<> ü x", "word " * 500, "a b c d e f " * 3 + "z"])
def test_statistics(text):
    assert outliers.text_stats(text)[:5] == _stats(text)


def test_verdicts_of_odd_rows(odd, odd_rows, nothing):
    got = outliers.judge(odd).collect()
    assert Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in got) == Counter((r[0], *_stats(r[1] or "")) for r in odd_rows)
    for x in got:
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words) and not (x.base_failed and x.kept)
    assert outliers.judge(nothing).count() == 0


def _mcd(x, share):
    """The estimate of one group in memory: sorted distances, exact subsets."""
    floor = np.array(outliers.FLOOR)

    def inverse(scatter):
        values, vectors = np.linalg.eigh(scatter / np.outer(floor, floor))
        scatter = vectors @ np.diag(np.maximum(values, 1)) @ vectors.T * np.outer(floor, floor)
        return np.linalg.inv(scatter), np.linalg.slogdet(scatter)[1]

    def far(center, inv):
        return np.einsum("ij,jk,ik->i", x - center, inv, x - center)

    def of(rows, q):
        center = rows.mean(axis=0)
        return (center, *inverse(outliers.consistency(q) * np.cov(rows.T, bias=True)))

    middle = np.median(x, axis=0)
    scale = np.maximum(1.4826 * np.median(np.abs(x - middle), axis=0), floor)
    z = (x - middle) / scale
    tops, steps = [], []
    for y in (None, np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]):
        shape = np.eye(z.shape[1])
        if y is not None:
            moments = y.T @ y
            root = np.sqrt(np.maximum(np.diag(moments), 1e-12))
            shape = moments / np.outer(root, root)
            np.fill_diagonal(shape, 1)
        model = (middle, *inverse(shape * np.outer(scale, scale)))
        for _ in range(outliers.FIRST_STEPS):
            model = of(x[np.argsort(far(*model[:2]), kind="stable")[: math.ceil(share * len(x))]], share)
        tops.append(model)
    model = min(tops, key=lambda m: m[2])
    steps.append(model)
    for _ in range(outliers.MORE_STEPS):
        model = of(x[np.argsort(far(*model[:2]), kind="stable")[: math.ceil(share * len(x))]], share)
        assert model[2] <= steps[-1][2] + 1e-6  # no step lets the determinant grow
        steps.append(model)
    best = min(steps, key=lambda m: m[2])
    return np.sqrt(far(*of(x[far(*best[:2]) <= outliers.chi2_quantile(outliers.INSIDE)], outliers.INSIDE)[:2]))


def _vectors(texts):
    n, chars, symbols, dup, rep, lines = np.array([outliers.text_stats(t) for t in texts], float).T
    return np.stack([(chars + 250) / (n + 50), np.log1p(100 * symbols / (n + 50)), np.log1p(100 * dup / (lines + 5)), np.log1p(100 * rep / (n + 50)), np.log1p(n)], axis=1)


def test_distances_match_groups_in_memory(spark):
    """Two groups of their own, two small ones of a language together, and languages of a few rows as one."""
    rng = np.random.default_rng(3)
    rows = []
    for name, size, letters in (("en-a", 400, 6), ("en-b", 150, 12), ("de-a", 40, 9), ("de-b", 30, 9), ("fr-a", 20, 5), ("es-a", 35, 4)):
        for i in range(size):
            words = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, letters))) for _ in range(rng.integers(20, 80))]
            rows.append((len(rows), " ".join(w + "|#" if i % 20 == 0 else w for w in words), *name.split("-")))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = outliers.judge(docs).toPandas().set_index("doc_id").sort_index()
    of = {"en": lambda r: r[2:], "de": lambda r: r[2], "fr": lambda r: "rest", "es": lambda r: "rest"}
    parts = defaultdict(list)
    for r in rows:
        parts[of[r[2]](r)].append(r[0])
    assert sorted(map(len, parts.values())) == [55, 70, 150, 400]
    for ids in parts.values():
        want = _mcd(_vectors([rows[i][1] for i in ids]), outliers.SHARE)
        assert np.allclose(got.loc[ids, "distance"].to_numpy(float), want, rtol=0.05, atol=0.05)
    assert set(got.index[~got["kept"]]) >= {i for i in parts[("en", "a")] if i % 20 == 0}


def test_outliers_that_no_margin_shows_are_rejected(spark):
    """Two statistics that go together: rows against that grain lie inside every single range."""
    rng = np.random.default_rng(9)
    n = 1000
    a = rng.normal(0, 1, n)
    x = np.stack([4 + 0.8 * a, np.zeros(n), np.zeros(n), np.zeros(n), 5 + 1.6 * a + rng.normal(0, 0.05, n)], axis=1)
    x[:50, 4] = 5 - 1.6 * a[:50]
    against = np.abs(a[:50]) > 1.2
    frame = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"{f} double" for f in outliers.FEATURES))
    fit = outliers.Mcd(frame, True).fit()
    d = np.array([r.d for r in outliers.Mcd(frame, True).far(fit).sort("x0").collect()])[np.argsort(np.argsort(x[:, 0]))]
    assert (d[:50][against] > outliers.CUT).all() and (d[50:] <= outliers.CUT).all()
    margins = (x - np.median(x, axis=0)) / np.maximum(x.std(axis=0), outliers.FLOOR)
    assert (np.abs(margins[:50]) < 4).all()


def test_consistency_factor():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200_000, 5))
    d = (x**2).sum(axis=1)
    dense = x[d <= np.quantile(d, 0.75)]
    assert outliers.consistency(0.75) == pytest.approx(1 / dense.var(), rel=0.02)


# -- HTML

PAGES = [
    ("<html><body><nav><ul><li><a href=/>Home page of it</a></ul></nav><div class='ad'>Buy</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>\n text.<p>Second&nbsp;one<br>same block</article><footer>(c) me</footer>", "Title & more\nFirst bold text.\nSecond one same block"),
    ("<article><p>Keep it.</p><div class=\"comments\"><article><p>the reader says it is a nice one</p></article></div><script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no --><form>Name <input></form></article>", "Keep it."),
    ("<div class=sidebar>the of and to in a is it for you</div><div id=main-content><p>" + "the cat of a house is in the garden and it was with them all day long " * 4 + "<p>Short one.</div><div class=cookie-notice>we and our partners are in the use of it</div>", ("the cat of a house is in the garden and it was with them all day long " * 4).strip() + "\nShort one."),
    ("<article>a<br><br>b<p hidden>no</p><span style='display: none'>no</span>c</article>", "a\nb\nc"),
    ("", ""),
    (None, ""),
    ("<nav>the menu is open and <article><p>text of it", "text of it"),
    ("<article><p>x < y & z &lt;tag&gt; &#233; &bogus;</p></article>", "x < y & z <tag> é &bogus;"),
    ("<article><p>unclosed <!-- comment", "unclosed"),
    ("<article><p>a</p><aside>side</aside><header><h1>In</h1></header><p>b</p></article><header>Out</header>", "a\nIn\nb"),
]


@pytest.mark.parametrize("kind", ["lines", "words", "length"])
def test_one_extreme_statistic_is_rejected(spark, kind):
    """In a group that never repeats anything, each of these statistics alone rejects a text."""
    rng = np.random.default_rng(8)
    page = lambda n: [" ".join(f"w{x}" for x in rng.integers(0, 1_000_000, 8)) for _ in range(n)]
    texts = ["\n".join(page(int(rng.integers(18, 23)))) for _ in range(300)]
    if kind == "lines":
        odd_one = "\n".join(x for line in page(20) for x in (line, "share"))
    elif kind == "words":
        twice = " ".join(f"r{x}" for x in range(15))
        odd_one = "\n".join([*page(9), twice, *page(9), twice + " end"])
    else:
        odd_one = "\n".join(page(4000))
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate([*texts, odd_one])], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.judge(docs).select("doc_id", "base_failed", "kept").collect()}
    assert not got[300].base_failed and not got[300].kept
    assert all(got[i].kept for i in range(300))


def test_text_before_an_unfinished_tag_stays_whole():
    assert htmlmain.plain_text("<p>one</p>if 2 < 3 then more text <p unfinished") == "one\nif 2 < 3 then more text"


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_main_text(html, text):
    assert htmlmain.main_text(html) == text


def test_pages_of_the_driver(spark):
    """Each page's article, cut out by its tags, is its main text."""
    import html
    import re

    got = {x.page_id: x for x in QUERIES["op6_html_extraction"](spark, DATA).collect()}
    for p in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = re.search("<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert got[p.page_id].text == "\n".join(b for b in blocks if b) and got[p.page_id].n_chars == len(got[p.page_id].text)


def test_ambiguous_blocks_follow_their_neighbours():
    sentence = "the cat of a house is in the garden and it was with them all day long " * 4
    html = f"<div><p>{sentence}</p><p>Brief.</p><p>{sentence}</p></div><div><p><a href=x>link link link link</a></p><p>Tiny.</p></div>"
    assert htmlmain.main_text(html) == f"{sentence.strip()}\nBrief.\n{sentence.strip()}"


def _article(html_text):
    import html
    import re

    inner = re.search("<article>(.*)</article>", html_text, re.S)[1]
    found = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(b for b in found if b)


@pytest.mark.parametrize("tags", ["article|main", "article|main|nav|footer|header|aside"])
def test_rules_decide_without_names(spark, tags):
    """With the page's own names for its parts gone, text rules and neighbours alone find the article."""
    import re

    pages = [p.html for p in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    plain = [re.sub(r"\s(?:class|id)=(?:\"[^\"]*\"|'[^']*'|[^\s>]*)", "", re.sub(rf"<(/?)(?:{tags})\b[^>]*>", r"<\1div>", p)) for p in pages]
    assert sum(htmlmain.main_text(q) == _article(p) for p, q in zip(pages, plain, strict=True)) >= 0.95 * len(pages)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><h1>A heading here</h1><p>Short text.</p><p><a>See the linked reference document</a></p></article>", "A heading here\nShort text.\nSee the linked reference document"),
        ("<article><p>Text of it.</p><ul><li><a>One link</a><li><a>Two links</a></ul></article>", "Text of it."),
        ("<article><section id=search-methods><p>Press <button>Go</button> now</p><button>Share this</button></section></article>", "Press Go now"),
        ("<article><p title='it's'>some text</p></article>", "some text"),
        ("<p>" + "Это длинный текст о доме и саде. " * 8 + "</p><p>Конец.</p>", ("Это длинный текст о доме и саде. " * 8).strip() + "\nКонец."),
        ("<div><a href=/>首页</a></div><div><a href=/x>新闻</a></div><p>" + "这是一个关于花园和房子的长文章" * 6 + "</p>", "这是一个关于花园和房子的长文章" * 6),
        ("text without a tag", "text without a tag"),
        ("<script>if (a < b) { x = '<p>'; }</script><p>shown</p><svg><text>no</text></svg><svg><p>also shown", "shown\nalso shown"),
    ],
)
def test_contract_of_main_text(html, text):
    assert htmlmain.main_text(html) == text


@pytest.mark.parametrize("piece", ['<a "', "<a  ", "<div></section>", "<svg>", "<!-", "<p title='it's'>x", "<aside><article></article>", '<a href="', "<br><br>x", "<b hidden>", "<li><a>x</a>", "&", "<x y=1 "])
def test_hostile_pages_take_linear_time(piece):
    import time

    page = piece * (1_000_000 // len(piece))
    start = time.process_time()
    htmlmain.main_text(page)
    assert time.process_time() - start < 8


def test_neighbours_match_a_plain_search():
    """The second pass against a search over all pairs of blocks."""
    rng = np.random.default_rng(5)
    word = {0: "the of and to in " * 20, 1: "short one", 2: "xx yy zz qq ww " * 20}
    for _ in range(200):
        found = [htmlmain.Block(word[int(k)], 0, 0, bool(rng.random() < 0.1), 0, bool(rng.random() < 0.1)) for k in rng.integers(0, 3, rng.integers(1, 14))]
        labels = htmlmain.first_pass(found)
        section = np.cumsum([b.heading and not b.named_bad for b in found])
        for i, (label, kept) in enumerate(zip(labels, htmlmain.classify(found), strict=True)):
            if label == htmlmain.NEAR:
                known = [(abs(j - i), -labels[j]) for j in range(len(found)) if labels[j] != htmlmain.NEAR]
                sides = [min((abs(j - i), j) for j in js if labels[j] != htmlmain.NEAR) for js in (range(i), range(i + 1, len(found))) if any(labels[j] != htmlmain.NEAR for j in js)]
                mine = [(d, j) for d, j in sides if section[j] == section[i]] or sides
                if found[i].heading and any(j > i for _, j in sides):
                    mine = [(d, j) for d, j in sides if j > i]
                assert bool(known) == bool(sides)
                label = max((labels[j] for d, j in mine if d == min(mine)[0]), default=htmlmain.BAD)
            assert kept == (label == htmlmain.GOOD)


def test_extraction_keeps_columns(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "u", "<article>t</article>", "y")], "page_id long, url string, html string, n_chars string")
    assert sorted(map(str, htmlmain.extract(pages).select("main_text", "n_chars").collect())) == ["Row(main_text='', n_chars='x')", "Row(main_text='t', n_chars='y')"]
    assert htmlmain.extract(pages.limit(0)).count() == 0


# -- WARC


def test_derivatives_refer_to_their_source(spark, tmp_path):
    rows = [(1, "http://h/a", "<html lang=en><title>T &amp; t</title><body><a href='/b'>go</a><p>text é"), (2, None, None), (None, "http://h/c", ""), (1, "http://h/a", "<html lang=en><title>T &amp; t</title><body><a href='/b'>go</a><p>text é")]
    sources = warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = warc.derive(sources).collect()
    by_id = {s.record_id: s for s in sources.collect()}
    assert len(found) == 8 and len({x.record_id for x in found}) == 6
    for x in found:
        s = by_id[x.refers_to]
        assert (x.refers_to_date, x.refers_to_target_uri, x.source_payload_digest) == (s.date, s.target_uri, s.payload_digest)
        assert x.source_headers["WARC-Block-Digest"] == s.block_digest == warc.digest(bytes(s.block)) and x.block_digest == warc.digest(bytes(x.block))
    first = {x.record_type: bytes(x.block).decode() for x in found if x.key == 1}
    assert first["conversion"] == "go\ntext é" and "title: T & t\r\n" in first["metadata"] and "outlink: /b a/@href\r\n" in first["metadata"] and "language: en\r\n" in first["metadata"]
    every = sources.unionByName(warc.derive(sources))
    warc.write(every, str(tmp_path / "out"))
    again = warc.read(spark, str(tmp_path / "out"))
    fields = ["record_id", "record_type", "target_uri", "refers_to", "refers_to_date", "block_digest", "payload_digest", "source_payload_digest", "block"]
    assert sorted(map(repr, again.select(*fields).collect())) == sorted(map(repr, every.select(*fields).collect()))
    assert sorted(x.record_id for x in warc.derive(again).collect()) == sorted(x.record_id for x in found)


def test_gzip_members(spark, tmp_path):
    import gzip

    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:2>\r\nContent-Type: text/html\r\nContent-Length: 9\r\n\r\n<p>hi</p>\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    records = warc.read(spark, str(tmp_path / "x.warc.gz"))
    assert [(r.record_type, bytes(r.block)) for r in records.collect()] == [("warcinfo", b"abc"), ("response", b"<p>hi</p>")]
    assert [(r.record_type, bytes(r.block)) for r in warc.derive(records).collect()] == [("metadata", b""), ("conversion", b"hi")]


def test_written_derivatives_keep_source_headers(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<title>t{i}</title><p>text of {i}") for i in range(20)], "page_id long, url string, html string")
    made = warc.derive(warc.responses(pages))
    warc.write(made.drop("key"), str(tmp_path / "out"))
    again = warc.read(spark, str(tmp_path / "out"))
    fields = lambda df: {r.record_id: (r.refers_to, dict(r.source_headers), r.source_payload_digest, bytes(r.block)) for r in df.collect()}
    assert fields(again) == fields(made) and all(v[1]["WARC-Type"] == "response" and v[1]["WARC-Block-Digest"] for v in fields(again).values())


def test_broken_records_are_rows_and_reading_goes_on():
    import gzip

    record = lambda i, length=None: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: %s\r\n\r\nbody %d\r\n\r\n" % (i, length or b"6", i)
    kinds = lambda data: [(r["record_type"], r["record_id"]) for r in warc.parse(data)]
    one, two, three = (("response", f"<urn:x:{i}>") for i in (1, 2, 3))
    bad = (warc.UNREADABLE, None)
    assert kinds(record(1) + record(2, b"six") + record(3)) == [one, bad, bad, three]
    assert kinds(record(1) + b"rubbish between\r\n" + record(2)) == [one, bad, two]
    assert kinds(record(1) + record(2)[:-8]) == [one, bad]
    assert kinds(b"") == [] and kinds(b"\r\n\r\n") == [] and kinds(b"no record") == [bad]
    broken = bytearray(gzip.compress(record(2) * 50))
    broken[40:60] = b"\xff" * 20
    assert kinds(gzip.compress(record(1)) + bytes(broken) + gzip.compress(record(3))) == [one, bad, three]
    assert kinds(gzip.compress(record(1)) + gzip.compress(record(2))[:-9]) == [one, two, bad]  # the record is whole, its member's end is not
    assert b"".join(r["block"] for r in warc.parse(b"WARC/1.0\r\nContent-Length: 3000000\r\n\r\n" + b"x" * 3_000_000)) == b"x" * 3_000_000


def test_key_of_any_type_is_carried(spark):
    records = warc.responses(spark.createDataFrame([(1, "u", "<a href='x' href=y>t</a>")], "page_id long, url string, html string"))
    got = warc.derive(records.withColumn("key", F.lit("k1")).withColumn("block2", F.lit(1))).collect()
    assert [(r.key, r.record_type) for r in got] == [("k1", "metadata"), ("k1", "conversion")]
    assert b"outlink: x a/@href\r\n" in bytes(got[0].block)


def test_derivatives_of_nothing(spark):
    assert warc.derive(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


# -- token counts


def test_histogram_answers_every_limit(odd, odd_rows, nothing):
    encoder = tokencount._encoder(tokencount.load_vocabulary(), tokencount.PATTERN)
    lengths = defaultdict(list)
    for r in odd_rows:
        lengths[r[2]].append(len(encoder.encode_ordinary(r[1] or "")))
    hist = tokencount.histogram(odd)
    sums = tokencount.with_suffix_sums(hist)
    for x in sums.collect():
        every = lengths[x.group]
        assert x.n_docs == every.count(x.n_tokens) and x.total_docs == len(every) and x.total_tokens == sum(every)
        assert x.docs_over == sum(v > x.n_tokens for v in every) and x.tokens_over == sum(v for v in every if v > x.n_tokens)
        assert x.truncated_total == sum(min(v, x.n_tokens) for v in every)
    limits = (0, 1, 5, 17, 1000, 10**6)
    for x in tokencount.truncated_totals(sums, limits).collect():
        assert (x.truncated_total, x.docs_over) == (sum(min(v, x.limit) for v in lengths[x.group]), sum(v > x.limit for v in lengths[x.group]))
    for x in tokencount.quantiles(sums).collect():
        every = sorted(lengths[x.group])
        assert x.n_tokens == every[math.ceil(x.share * len(every)) - 1]
    assert tokencount.with_suffix_sums(tokencount.histogram(nothing)).count() == 0


def test_token_ids_decode_to_the_text():
    encoder = tokencount._encoder(tokencount.load_vocabulary(), tokencount.PATTERN)
    for text in ("plain text", "é ü 中文 😀\n\n  x", "<|endoftext|>"):
        assert encoder.decode(encoder.encode_ordinary(text)) == text


# -- classifier


def test_gradients():
    rng = np.random.default_rng(0)
    counts, y = np.array([2, 1, 4]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(7, mil.WIDTH))
    base = mil.train(x, counts, y, seed=1)
    assert np.allclose([base.attention(x, counts)[a:b].sum() for a, b in ((0, 2), (2, 3), (3, 7))], 1)
    assert (base.score(x, counts) > 0.5).tolist() == [True, False, True]


def test_scores_of_odd_rows(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)] + [(1, None, 0), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    model = mil.fit(odd, labels)
    got = mil.score(odd, model, score_col="mil_score").collect()
    assert len(got) == len(odd_rows) and all(0 <= x.mil_score <= 1 for x in got)
    by_text = defaultdict(set)
    for x in got:
        by_text[x.text or ""].add(round(x.mil_score, 12))
    assert all(len(v) == 1 for v in by_text.values())
    assert mil.score(nothing, model, score_col="mil_score").count() == 0
    assert 0 <= mil.score(odd, mil.fit(odd, labels.limit(0)), score_col="mil_score").first().mil_score <= 1


def test_encoding_does_not_depend_on_chunks(monkeypatch):
    texts = ["one two", "", None, "x " * 500, "ÄÖ ü\n\n#tag #tag", " "]
    whole = list(mil.encode(texts))
    monkeypatch.setattr(mil, "CHUNK", 1)
    parts = list(mil.encode(texts))
    assert np.allclose(np.concatenate([x for x, _ in whole]), np.concatenate([x for x, _ in parts]))
    assert np.concatenate([c for _, c in parts]).tolist() == [1, 1, 1, 8, 1, 1]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op10_quality_classifier"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    out = got[got["held_out"]]
    assert ((out["score"] >= 0.3) == (out["quality"] == 1)).mean() >= 0.95


def test_line_runs_are_compacted_to_a_second_level(spark, monkeypatch):
    names, store = [], linededup.LineRuns.stored
    monkeypatch.setattr(linededup.LineRuns, "stored", lambda self, run, name, *path: names.append(name) or store(self, run, name, *path))
    docs = spark.createDataFrame([(i, f"a line of document {i}\na line that all share") for i in range(90)], "doc_id long, text string")
    got = linededup.dedup(docs).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {i: int(i > 0) for i in range(90)}
    assert names.count("line-run-1") >= 2 and "line-run-2" in names


def test_runs_are_met_without_moving_them(spark):
    """Merge anti-joins with bucketed runs: the only exchange is that of the batch's keys, and compaction has none."""
    runs = linededup.LineRuns(spark, fanout=3)
    keys = lambda a, b: runs.dealt(spark.range(a, b).selectExpr("id", "id AS text_key", "0 AS pos", "xxhash64(id) AS h1", "xxhash64(id, 7) AS h2"))
    for a in (0, 100, 200, 300):
        linededup.mark_batch(keys(a, a + 150), runs).count()
    assert [len(level) for level in runs.levels] == [1, 1] and sum(r.count() for r in runs.runs()) == 450
    unseen = runs.unseen(keys(400, 500).select("h1", "h2"))
    plan = unseen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 2 and unseen.count() == 50
    runs.forget()


def test_many_shared_lines_take_linear_time(spark):
    import time

    lines = [f"shared line number {i}" for i in range(200_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([*lines[:9], "one own line", *lines[9:]])), (3, "")], "doc_id long, text string")
    start = time.monotonic()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in linededup.dedup(docs, batches=2).collect()}
    assert got[2] == (200_001, 200_000, "one own line") and got[1][1] == 0 and got[3] == (1, 0, "")
    assert time.monotonic() - start < 120


def test_crowded_keys_are_compared_by_minhash_too(spark):
    """Many texts under one key, alike but below the threshold: groups are those of brute force and few pairs are listed."""
    rng = np.random.default_rng(21)
    base = [f"v{x}" for x in rng.integers(0, 50_000, 150)]
    texts = {}
    for i in range(150):
        w = list(base)
        for at in rng.choice(150, int(rng.integers(0, 15)), replace=False):
            w[at] = f"c{i}-{at}"
        texts[i] = w
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    order = sorted(texts)
    group = _classes([sets[i] for i in order], lambda a, b: _jaccard(a, b) >= 0.8)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    got = {x.id: x.first_id for x in simhash.similar(docs).collect()}
    assert [got[i] for i in order] == group and len(set(group)) > 20
    values = [simhash.minima(simhash.shingle_set(" ".join(texts[i]))) for i in order]
    near = [(a, b) for a in range(150) for b in range(a) if _jaccard(sets[a], sets[b]) >= 0.8]
    assert all((values[a] == values[b]).sum() >= simhash.least_agreeing() for a, b in near)


def test_crowded_pairs_come_out_once():
    """Under the first shared key only; and, of nearest partners, the one that agrees in most values."""
    cross = lambda **more: simhash._cross_pairs(0.5, 64 * simhash.WIDE, 2, **more)
    starts, nodes, ones = np.array([0]), np.array([5, 6, 7]), np.ones(3, np.int64)
    low = np.array([bytes([1, 1, 1, 9]), bytes([1, 1, 1, 8]), bytes([1, 1, 2, 9])], object)
    keys = np.array([[3, 4], [2, 4], [3, 4]], np.int64)
    held = np.empty(3, object)
    held[:] = list(keys)
    words = [np.zeros(3, np.int64)] * simhash.WIDE
    seen = lambda pairs: sorted((int(a), int(b)) for x, y in pairs for a, b in zip(x, y, strict=True))
    run = lambda pairs, band: seen(pairs(starts, np.full(3, band), nodes, ones, nodes, np.zeros(3, np.int64), *words, low, held))
    assert run(cross(), 1) == [(6, 5), (7, 6)]
    assert seen(cross()(starts, np.zeros(2, np.int64), nodes[[0, 2]], ones[:2], nodes[[0, 2]], np.zeros(2, np.int64), *[w[:2] for w in words], low[[0, 2]], held[[0, 2]])) == [(7, 5)]
    assert set(run(cross(nearest=True), 1)) <= {(6, 5), (7, 5)} and (7, 5) in run(cross(nearest=True), 1)
