"""Plans stay small: a scan or stage that is started costs the driver some MB, and all of a plan's start at once."""

import random

from conftest import DATA

from quillgraph.llm import common, components, linededup


def _leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def _counted(monkeypatch):
    """(name, scans) of each table written from now on."""
    seen, write = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name, *by: (seen.append((name, _leaves(df))), write(df, name, *by))[1])
    return seen


def _brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_lines_of_many_batches_are_read_in_one_scan(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert _leaves(linededup.dedup(docs)) <= 2


def test_a_round_of_components_starts_few_scans(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(1000, x) for x in range(500, 560)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(220)]
    edges = [e for e in edges if e[0] != e[1]]
    seen = _counted(monkeypatch)
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == _brute(edges)
    assert len(seen) > 3 and max(n for _, n in seen) <= 2


def test_stars_need_no_round(spark, monkeypatch):
    seen = _counted(monkeypatch)
    edges = [(1, x) for x in range(2, 30)] + [(50, 51), (51, 50), (60, 60)]
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 1 for x in range(1, 30)} | {50: 50, 51: 50}
    assert [name for name, _ in seen] == ["cc-edges"]
