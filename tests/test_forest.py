"""The forest that SQL can grow again: against a plain one, odd rows, and any layout of the input."""

import hashlib

import pytest
from pyspark.sql import functions as F

from idsignal.operators import forest

INPUTS = ["a", "b", "c"]
SCHEMA = "id long, a double, b double, c double, label int"


def draw(*keys):
    return int(hashlib.md5("-".join(map(str, keys)).encode()).hexdigest()[:13], 16) / 16 ** 13


def bin_of(x):
    return 0 if x is None else min(forest.BINS - 1, max(0, int(x * forest.BINS // 1)))


def plain_forest(rows, trees, depth, tried=2, seed=forest.SEED):
    """(tree, node) to (input, bin) or to class counts, row by row and node by node."""
    nodes = {}

    def impurity(part):
        counts = [sum(w for _, l, w in part if l == c) for c in range(forest.CLASSES)]
        return sum(n * n for n in counts) / sum(counts)

    def split(tree, node, part, left):
        best = None
        for i in sorted(range(len(INPUTS)), key=lambda i: draw(seed, tree, node, i))[:tried] if left else []:
            for b in sorted({cell[i] for cell, _, _ in part}):
                low, high = [r for r in part if r[0][i] <= b], [r for r in part if r[0][i] > b]
                if high:
                    score = impurity(low) + impurity(high)
                    if score > impurity(part) + forest.LEAST_GAIN and (best is None or (-score, i, b) < best[0]):
                        best = ((-score, i, b), low, high)
        if best is None:
            nodes[tree, node] = tuple(sum(w for _, l, w in part if l == c) for c in range(forest.CLASSES))
            return
        nodes[tree, node] = best[0][1:]
        split(tree, 2 * node, best[1], left - 1)
        split(tree, 2 * node + 1, best[2], left - 1)

    for tree in range(1, trees + 1):
        part = []
        for row_id, *values, label in rows:
            weight = sum(draw(seed, row_id, tree) >= edge for edge in forest.POISSON)
            if weight and label is not None and row_id is not None:
                part.append((tuple(map(bin_of, values)), label, weight))
        if part:
            split(tree, 1, part, depth)
    return nodes


def table(nodes):
    return {(r.tree, r.node): (r.input, r.bin) if r.input is not None else (r.n0, r.n1, r.n2, r.n3) for r in nodes.collect()}


@pytest.fixture(scope="module")
def rows():
    made = [(i, draw("a", i), round(draw("b", i), 1), float(i % 2), int(draw("a", i) * 2 + draw("b", i) * 2) if i % 7 else i % 4) for i in range(300)]
    return [*made, (300, None, 0.5, 2.5, 1), (301, 0.1, -1.0, 0.0, None), (None, 0.1, 0.1, 0.0, 2), (5, 0.9, 0.9, 1.0, 3)]


def test_the_forest_equals_a_plain_one(spark, rows):
    nodes = forest.grow(spark.createDataFrame(rows, SCHEMA), "id", INPUTS, "label", trees=4, depth=5)
    assert table(nodes) == plain_forest(rows, 4, 5)


def test_shares_equal_a_walk_per_row(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = forest.grow(df, "id", INPUTS, "label", trees=4, depth=5)
    plain, want = table(nodes), []
    for row_id, *values, _ in rows:
        shares, cell = [0] * forest.CLASSES, list(map(bin_of, values))
        for tree in range(1, 5):
            node = 1
            while len(plain[tree, node]) == 2:
                i, b = plain[tree, node]
                node = 2 * node + (cell[i] > b)
            counts = plain[tree, node]
            shares = [s + n * forest.SHARE_UNITS // sum(counts) for s, n in zip(shares, counts)]
        want.append((row_id, shares))
    got = [(r.id, r.shares) for r in forest.class_shares(df, nodes, "id", INPUTS, trees=4, depth=5).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_the_layout_does_not_matter(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    first, second = (table(forest.grow(d, "id", INPUTS, "label", trees=3, depth=4)) for d in (df.coalesce(1), df.repartition(7, "b")))
    assert first == second


def test_nothing_to_learn_from(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = forest.grow(df.where(F.lit(False)), "id", INPUTS, "label", trees=2, depth=2)
    assert nodes.count() == 0
    got = forest.class_shares(df, nodes, "id", INPUTS, trees=2, depth=2).collect()
    assert len(got) == len(rows) and all(r.shares == [0] * forest.CLASSES for r in got)
    assert forest.class_shares(df.where(F.lit(False)), nodes, "id", INPUTS, trees=2, depth=2).count() == 0


def test_a_saved_forest_is_loaded(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    grown = table(forest.load_or_grow(f"{tmp_path}/nodes", df, "id", INPUTS, "label", trees=2, depth=3))
    again = forest.load_or_grow(f"{tmp_path}/nodes", df.where("id < 3"), "id", INPUTS, "label", trees=2, depth=3)
    assert table(again) == grown


def test_rows_are_read_twice_and_trees_never_joined_to_rows(spark, rows):
    """Each distinct cell walks the trees; rows meet one result each."""
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = forest.grow(df, "id", INPUTS, "label", trees=2, depth=2)
    plan = forest.class_shares(df, nodes, "id", INPUTS, trees=2, depth=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Generate" not in plan
