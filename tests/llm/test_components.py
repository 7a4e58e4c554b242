import random

from shelfrate.llm import components as module
from shelfrate.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    return {x: find(x) for x in list(root)}


def check(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert set(got) == set(want)
    assert len({(got[x], want[x]) for x in got}) == len(set(got.values())) == len(set(want.values()))


def test_random_graph_with_loops_and_repeats(spark):
    rng = random.Random(1)
    check(spark, [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (1, 2), (2, 1)])


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    keep = module.written
    monkeypatch.setattr(module, "written", lambda df, name: rounds.append(name) or keep(df, name))
    check(spark, [(i, i + 1) for i in range(400)])
    assert rounds.count("contraction") <= 24


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0
