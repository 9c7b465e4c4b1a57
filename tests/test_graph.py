"""Graph kernels: both ways against naive closures on seeded random graphs."""

import random

import pytest

from taproot.operators import files, graph


def naive(edges, roots):
    seen = set(roots)
    while True:
        more = {b for a, b in edges if a in seen} - seen
        if not more:
            return seen
        seen |= more


def frames(spark, edges, roots, nodes):
    e = spark.createDataFrame([("p", a, b) for a, b in edges], "profile string, src string, dst string")
    r = spark.createDataFrame([("p", x, i) for i, x in enumerate(roots)], "profile string, path string, position int")
    n = spark.createDataFrame([("p", x) for x in nodes], "profile string, path string")
    return e, r, n


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [None, 0])
def test_random(spark, seed, limit):
    rng = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(14)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(18)}
    roots = rng.sample(nodes, 2)
    e, r, n = frames(spark, edges, roots, nodes)
    assert {x.path for x in graph.reachable(e, r, limit).collect()} == naive(edges, roots)
    ways = {v: naive(edges, [v]) for v in nodes}
    want = {v: min(w for w in nodes if w in ways[v] and v in ways[w]) for v in nodes}
    got = {x.path: x.component for x in graph.strong_components(e, n, limit).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [None, 0])
def test_discovery_order(spark, limit):
    e, r, _ = frames(spark, [("b", "x"), ("a", "y"), ("x", "z"), ("y", "z"), ("z", "a")], ["b", "a"], [])
    got = {x.path: (x.depth, x["rank"], x.parent) for x in graph.discovery(e, r, limit).collect()}
    # ties go by discovery, not by name: z comes from x, which the first root found
    assert got == {"b": (0, 0, None), "a": (0, 1, None), "x": (1, 2, "b"), "y": (1, 3, "a"), "z": (2, 4, "x")}


def test_long_chain_takes_few_rounds(spark):
    edges = [(f"f{i:04}", f"f{i + 1:04}") for i in range(200)]
    e, r, _ = frames(spark, edges, ["f0000"], [])
    assert graph.reachable(e, r, limit=0).count() == 201


def test_dead_cycle_is_one_finding(spark):
    profiles = spark.createDataFrame([("default",)], "profile string")
    names = ["src/index.js", "src/dead-a.js", "src/dead-b.js"]
    f = spark.createDataFrame([(n, ".", False) for n in names], "path string, workspace string, fatal boolean")
    entries = spark.createDataFrame([("default", "src/index.js")], "profile string, path string")
    edges = spark.createDataFrame([("default", "src/dead-a.js", "src/dead-b.js"), ("default", "src/dead-b.js", "src/dead-a.js")], "profile string, src string, dst string")
    none = spark.createDataFrame([], "profile string, path string")
    status = files.file_status(f, entries, edges, none, profiles)
    found = files.unreachable_findings(status, edges).collect()
    assert [list(x.paths) for x in found] == [["src/dead-a.js", "src/dead-b.js"]]
    # a blocker on a reachable file silences the profile, one on a dead file doesn't
    for path, dead in (("src/index.js", 0), ("src/dead-a.js", 2)):
        blockers = spark.createDataFrame([("default", path)], "profile string, path string")
        assert files.file_status(f, entries, edges, blockers, profiles).where("status = 'unreachable'").count() == dead
