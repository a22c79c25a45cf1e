"""Paths to goals against a walk over all paths; branches that lead nowhere cost nothing."""

import itertools
import random

from emberlog.operators import graph


def walk(edges, starts, goals, most):
    out, todo = set(), [(s,) for s in starts]
    while todo:
        path = todo.pop()
        if len(path) > 1 and path[-1] in goals:
            out.add(path)
        if len(path) < most:
            todo += [(*path, b) for a, b in edges if a == path[-1] and b not in path]
    return out


def frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_paths(spark, monkeypatch):
    rnd = random.Random(4)
    nodes = [f"n{i}" for i in range(12)]
    edges = {(a, b) for a, b in itertools.permutations(nodes, 2) if rnd.random() < 0.2}
    dead = [f"d{i}" for i in range(40)]
    more = {(a, b) for a, b in itertools.permutations(dead, 2)} | {("n0", d) for d in dead}
    held = {}
    real = graph.stage

    def counted(df, name):
        out = real(df, name)
        held.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(graph, "stage", counted)
    for own in (edges, edges | more):
        df = spark.createDataFrame(sorted(own), "src string, dst string")
        got = [tuple(r.path) for r in graph.simple_paths(df, frame(spark, ["n0", "n3"]), frame(spark, ["n5", "n7", "n3"]), 5).collect()]
        assert len(got) == len(set(got)) and set(got) == walk(edges, ["n0", "n3"], {"n5", "n7", "n3"}, 5)
    half = len(held["paths"]) // 2
    assert held["paths"][:half] == held["paths"][half:]  # the dense branch made no row


def test_ends(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    paths = lambda goals, n: sorted(tuple(r.path) for r in graph.simple_paths(df, frame(spark, ["a"]), frame(spark, goals), n).collect())
    assert paths(["c"], 3) == [("a", "b", "c")] and paths(["c"], 2) == [] and paths(["a"], 5) == [] and paths(["b", "c"], 3) == [("a", "b"), ("a", "b", "c")]
    assert paths(["x"], 4) == [] and paths(["b"], 1) == []
