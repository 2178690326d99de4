"""Clusters of any density against a plain merge of sorted edges."""

import numpy as np

from plexivec.operators import cluster
from plexivec.operators.hierarchy import hdbscan, large_from, spanning_tree
from tests.test_index import frame


def plain_tree(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, k - 1]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    order = sorted((m[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x)))
    up = list(range(len(x)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    out = []
    for w, i, j in order:
        a, b = find(i), find(j)
        if a != b:
            up[b] = a
            out.append((w, i, j))
    return out


def plain_hdbscan(x, k, least):
    """Edges merged one by one; clusters split from the top; the excess of mass picks."""
    tree = plain_tree(x, k)
    node = {i: ("leaf", i) for i in range(len(x))}
    members = {i: [i] for i in range(len(x))}
    at = list(range(len(x)))
    for w, i, j in tree:
        a, b = at[i], at[j]
        node[a] = ("merge", w, node[a], node[b], sorted(members[a]), sorted(members[b]))
        members[a] = members[a] + members.pop(b)
        for p in members[a]:
            at[p] = a
    root = node[at[0]]
    low = min(w for w, _, _ in tree if w > 0)
    density = lambda w: 1 / max(w, low)
    found = []

    def walk(n, start, points):
        """The stability and the best clusters of the cluster that begins at ``n``."""
        total, all_ = 0.0, list(points)
        while True:
            if n[0] == "leaf":
                return total, [all_], all_
            _, w, left, right, a, b = n
            here = density(w)
            if len(a) >= least and len(b) >= least:
                total += (here - start) * (len(a) + len(b))
                below = [walk(left, here, a), walk(right, here, b)]
                inner = sum(s for s, _, _ in below)
                if total >= inner and start > 0:
                    return total, [all_], all_
                return inner, [c for _, cs, _ in below for c in cs], all_
            if len(a) < least and len(b) < least:
                return total + (here - start) * (len(a) + len(b)), [all_], all_
            gone = a if len(a) < least else b
            total += (here - start) * len(gone)
            n = right if gone is a else left

    _, clusters, everything = walk(root, 0.0, range(len(x)))
    if clusters == [everything]:
        return [-1] * len(x)
    out = [-1] * len(x)
    for c in clusters:
        for p in c:
            out[p] = min(c)
    return out


def test_hdbscan_agrees_with_sorted_merges(spark):
    rng = np.random.default_rng(3)
    parts = [rng.normal(c, s, (n, 3)) for c, s, n in [(0, 0.1, 30), (2, 0.5, 40), (6, 0.2, 20), (6.9, 0.05, 15)]]
    x, k, least = np.concatenate([*parts, rng.uniform(-3, 9, (20, 3))]), 3, 5
    df = frame(spark, x)
    tree = {(r["a"], r["b"]) for r in spanning_tree(df, "id", "v", k, block=40).collect()}
    assert tree == {(i, j) for _, i, j in plain_tree(x, k)}
    got = dict(map(tuple, hdbscan(df, "id", "v", k, least).collect()))
    assert [got[i] for i in range(len(x))] == plain_hdbscan(x, k, least)


def test_small_components_in_chains(spark):
    """Points far out, each nearest to the one before: all join the large component at their own edge."""
    tree = spark.createDataFrame([(float(i), i - 1, i) for i in range(1, 40)], "w double, a long, b long")
    points = spark.range(40).withColumnRenamed("id", "_id")
    got = {r["_id"]: r["e"]["w"] for r in large_from(tree, points, 3).collect()}
    assert got == {0: 2.0, 1: 2.0, **{i: float(i) for i in range(2, 40)}}


def test_few_or_equal_points(spark):
    assert {r[1] for r in hdbscan(frame(spark, np.zeros((1, 2))), "id", "v").collect()} == {-1}
    df = frame(spark, np.concatenate([np.zeros((6, 2)), np.ones((6, 2)) * 5])).unionByName(spark.createDataFrame([(50, None)], "id long, v array<double>"))
    got = dict(map(tuple, cluster.cluster(df, "id", "v", method="hdbscan", min_samples=2, min_cluster_size=3).collect()))
    assert got == {**{i: 0 for i in range(6)}, **{i: 6 for i in range(6, 12)}, 50: -1}
