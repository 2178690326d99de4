"""Clusters of any density: a spanning tree of mutual reachability, its condensed tree, and the most stable clusters.

Every step is rounds of joins over tables of vectors, tree edges or clusters; nothing is merged one after the other in one
task.  The edges of the spanning tree are taken in order in windows of a fixed size: what a window's edges do not join is merged
apart, and between windows components are rows.  So rounds grow with the number of edges over the size of a window, not with
the depth of the tree of clusters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexivec.functions.stats import running_sums
from plexivec.operators.metric_index import Rows, distances2
from plexivec.operators.neighbors import ACROSS, BLOCK, TILE, _block_pairs, _differences2, _index, nearest
from plexivec.plans.components import components
from plexivec.plans.staging import staged

MAX_ROUNDS = 200


def _pair(w: Column, a: Column, b: Column) -> Column:
    """An edge in the order of edges: weight, then ends; no two edges are equal."""
    return F.struct(w.alias("w"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def spanning_tree(df: DataFrame, key: str, vector: str, min_samples: int, block: int = BLOCK, backend: str = "kdtree") -> DataFrame:
    """``w, a, b``: a least spanning tree of the mutual reachability distances of all vectors.

    A vector's core distance is that to its ``min_samples``-th nearest, itself counted; two vectors are as far apart as the
    largest of both core distances and their distance.  In each round every component takes the lightest edge out of it; the
    nearest neighbours bound how far it has to look, and the metric index leaves out cells beyond.
    """
    points = df.select(F.col(key).alias("_id"), F.col(vector).alias("v")).filter("v is not null")
    near = staged(nearest(points, points, "_id", "v", min_samples + 4, block=block, backend=backend), "near")
    core = near.filter(F.col("rank") <= min_samples).groupBy("_id").agg(F.max(F.sqrt("d2")).alias("core"))
    points = staged(points.join(core, "_id"), "points")
    edges = near.filter("_id <> neighbor").join(core, "_id").join(core.select(F.col("_id").alias("neighbor"), F.col("core").alias("other")), "neighbor")
    near = staged(edges.select("_id", "neighbor", F.greatest("core", "other", F.sqrt("d2")).alias("w")), "near")
    index = _index(points, points, block, backend)
    labels, tree = staged(points.select("_id", F.col("_id").alias("comp")), "labels"), None

    def cheapest(x: Rows, y: Rows) -> pd.DataFrame:
        out = []
        hair = 1e-9 * ((x["v"] ** 2).sum(1).max() + (y["v"] ** 2).sum(1).max())
        for i in range(0, len(x["v"]), TILE):
            at, best, found = slice(i, i + TILE), np.inf, []
            for j in range(0, len(y["v"]), ACROSS):
                to = slice(j, j + ACROSS)
                d = np.maximum(np.maximum(distances2(x["v"][at], y["v"][to]), x["core"][at, None] ** 2), y["core"][to] ** 2)
                d[x["comp"][at, None] == y["comp"][to]] = np.inf
                best = np.minimum(best, d.min(1, keepdims=True) + hair + 1e-9 * d.min(1, keepdims=True))
                near = np.nonzero((d <= best) & np.isfinite(d))
                found.append((near[0] + i, near[1] + j))
            a, b = (np.concatenate(z) for z in zip(*found))
            w = np.maximum(np.maximum(np.sqrt(_differences2(x["v"], y["v"], a, b)), x["core"][a]), y["core"][b])
            ends = x["_id"][a], y["_id"][b]
            edges = pd.DataFrame({"comp": x["comp"][a], "w": w, "a": np.minimum(*ends), "b": np.maximum(*ends)})
            out.append(edges.sort_values(["w", "a", "b"]).drop_duplicates("comp"))  # of equally light edges the first by ends
        return pd.concat(out).sort_values(["w", "a", "b"]).drop_duplicates("comp")

    for _ in range(MAX_ROUNDS):
        other = labels.select(F.col("_id").alias("neighbor"), F.col("comp").alias("there"))
        bound = near.join(labels, "_id").join(other, "neighbor").filter("comp <> there").groupBy("comp").agg(F.min("w").alias("_r"))
        known = staged(labels.join(bound, "comp", "left").select("_id", "comp", F.coalesce("_r", F.lit(float("inf"))).alias("_r")), "known")
        schema = "comp bigint, w double, a bigint, b bigint"
        if index:
            left = staged(index.left.select("_id", "v", "core", "ball", "far", "cell").join(known, "_id"), "left")
            index.right = left.drop("_r")
            met = index.join(index.lower_bounds() <= index.radius_of_cells(F.col("_r"), left)[:, None], cheapest, schema, "_r", left)
        else:
            both = points.join(known.drop("_r"), "_id")
            met = _block_pairs(both, both, cheapest, schema, block)
        found = staged(met.groupBy("comp").agg(F.min(_pair(F.col("w"), F.col("a"), F.col("b"))).alias("e")).select("e.*").distinct(), "edges")
        if not found.take(1):
            break
        tree = found if tree is None else tree.unionByName(found)
        ends = found.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        labels = staged(labels.join(components(ends).select(F.col("node").alias("comp"), F.col("comp").alias("new")), "comp").select("_id", F.col("new").alias("comp")), "labels")
    return staged(tree, "tree") if tree is not None else df.sparkSession.createDataFrame([], "w double, a bigint, b bigint")


#: Edges of the tree that are merged in one window, and so the most that one task holds.
WINDOW = 65536


class _Merges:
    """The components that a group's edges join, one after the other, and the clusters that they begin, join and end.

    A component is its size and, once it has ``least`` points, its open cluster: the cluster's number, the edge that made it,
    its own points with the sum of their densities, the points below it and the sum of the best of its two parts.
    """

    def __init__(self, least: int, density: Callable[[float], float]):
        self.least, self.density = least, density
        self.up: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.open: dict[int, dict] = {}
        self.members: dict[int, list[int]] = {}  # components of before the window, while too small
        self.joined: list[tuple] = []  # component of before the window, edge, cluster
        self.ended: list[tuple] = []  # cluster, parent, whether chosen

    def add(self, comp: int, size: int, cluster: dict | None) -> None:
        self.up[comp], self.size[comp] = comp, size
        if cluster is None:
            self.members[comp] = [comp]
        else:
            self.open[comp] = cluster

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def stability(self, c: dict, end: float) -> float:
        """Of a cluster until the density ``end``: nearer the root densities are smaller."""
        below = c["n_below"] * (c["made"] - end) if c["n_below"] else 0.0
        return c["total"] - c["n"] * end + below

    def _end(self, c: dict, parent: int, end: float) -> float:
        own = self.stability(c, end)
        chosen = c["kids"] is None or own >= c["kids"]
        self.ended.append((c["cluster"], parent, chosen))
        return own if chosen else c["kids"]

    def _points(self, comp: int, c: dict, edge: tuple) -> None:
        """The points of a small component join a cluster."""
        self.joined += [(m, *edge, c["cluster"]) for m in self.members.pop(comp)]
        c["n"] += self.size[comp]
        c["total"] += self.size[comp] * self.density(edge[0])

    def merge(self, w: float, a: int, b: int, at: int, to: int) -> None:
        """The edge ``w, a, b`` between the components ``at`` and ``to``; a new cluster is named by its edge."""
        x, y, edge = self.find(at), self.find(to), (w, a, b)
        cx, cy = self.open.pop(x, None), self.open.pop(y, None)
        here = self.density(w)
        fresh = lambda **of: {"cluster": f"{a},{b}", "made": here, "n": 0, "total": 0.0, "n_below": 0, "kids": None} | of
        if cx and cy:
            name = f"{a},{b}"
            kids = self._end(cx, name, here) + self._end(cy, name, here)
            c = fresh(n_below=self.size[x] + self.size[y], kids=kids)
        elif cx or cy:
            c = cx or cy
            self._points(y if cx else x, c, edge)
        elif self.size[x] + self.size[y] >= self.least:
            c = fresh()
            self._points(x, c, edge), self._points(y, c, edge)
        else:
            c = None
            self.members[x] += self.members.pop(y)
        self.up[y] = x
        self.size[x] += self.size[y]
        if c:
            self.open[x] = c


_CLUSTER = "cluster string, made double, n bigint, total double, n_below bigint, kids double"


def _condensed(tree: DataFrame, points: DataFrame, least: int, smallest: float) -> tuple[DataFrame, DataFrame]:
    """``_id, e, cluster``: of every point the edge at which its component first has ``least`` points, and the cluster it joins there;
    and ``cluster, parent, chosen`` of every cluster but the root.

    Edges are taken in windows of ``WINDOW``, in order.  In a window, each set of components that its edges join is merged by itself; between windows components and their open clusters are tables.
    """
    if least <= 1:
        raise ValueError("clusters need two points at least")
    density = lambda w: 1 / max(w, smallest)
    n = tree.count()
    windows = max(1, -(-n // WINDOW))
    ranked = running_sums(tree.withColumn("e", _pair(F.col("w"), F.col("a"), F.col("b"))).withColumn("one", F.lit(1)), [F.col("e")], ["one"])
    edges = staged(ranked.select("w", "a", "b", F.floor((F.col("one_upto") - 1) / WINDOW).cast("int").alias("window")), "edges")
    labels = staged(points.select("_id", F.col("_id").alias("comp")), "labels")
    state = points.select(F.col("_id").alias("comp"), F.lit(1).cast("long").alias("size"), *[F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in _CLUSTER.split(", "))])
    joined, ended = [], []
    schema = f"kind string, comp bigint, new bigint, size bigint, {_CLUSTER}, w double, a bigint, b bigint, parent string, chosen boolean"
    columns = [x.split()[0] for x in schema.split(", ")]
    names = [x.split()[0] for x in _CLUSTER.split(", ")]

    def merged(comps: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        m = _Merges(least, density)
        for r in comps.itertuples(index=False):
            c = None
            if isinstance(r.cluster, str):
                c = {"cluster": r.cluster, "made": r.made, "n": int(r.n), "total": r.total, "n_below": int(r.n_below), "kids": None if np.isnan(r.kids) else r.kids}
            m.add(int(r.comp), int(r.size), c)
        for r in own.sort_values(["w", "a", "b"]).itertuples(index=False):
            m.merge(r.w, int(r.a), int(r.b), int(r.ca), int(r.cb))
        out = [{"kind": "comp", "comp": x, "new": m.find(x)} for x in m.up]
        out += [{"kind": "state", "comp": x, "size": m.size[x], **m.open.get(x, {})} for x, up in m.up.items() if x == up]
        out += [{"kind": "joined", "comp": x, "w": w, "a": a, "b": b, "cluster": c} for x, w, a, b, c in m.joined]
        out += [{"kind": "ended", "cluster": c, "parent": p, "chosen": k} for c, p, k in m.ended]
        kinds = {"bigint": "Int64", "double": float, "boolean": "boolean", "string": object}
        return pd.DataFrame(out, columns=columns, dtype=object).astype({c: kinds[k] for c, k in (x.split() for x in schema.split(", "))})

    for k in range(windows):
        side = lambda x: labels.select(F.col("_id").alias(x), F.col("comp").alias(f"c{x}"))  # noqa: B023, E731
        own = staged(edges.filter(F.col("window") == k).join(side("a"), "a").join(side("b"), "b"), "window")
        met = staged(components(own.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).toDF("comp", "group"), "met")
        lines = own.join(met.select(F.col("comp").alias("ca"), "group"), "ca")
        groups = state.join(met, "comp").groupBy("group").cogroup(lines.toDF(*lines.columns).groupBy("group"))
        found = staged(groups.applyInPandas(merged, schema), "merged")
        joined.append(staged(labels.join(found.filter("kind = 'joined'").select("comp", F.struct("w", "a", "b").alias("e"), "cluster"), "comp").select("_id", "e", "cluster"), "joined"))
        ended.append(found.filter("kind = 'ended'").select("cluster", "parent", "chosen"))
        if k + 1 < windows:
            new = found.filter("kind = 'comp'").select("comp", "new")
            labels = staged(labels.join(new, "comp", "left").select("_id", F.coalesce("new", "comp").alias("comp")), "labels")
            state = staged(state.join(met, "comp", "left_anti").unionByName(found.filter("kind = 'state'").select("comp", "size", *names)), "state")
    return reduce(DataFrame.unionByName, joined), reduce(DataFrame.unionByName, ended)


def large_from(tree: DataFrame, points: DataFrame, least: int) -> DataFrame:
    """``_id, e``: of every point the edge at which its component first has ``least`` points; null if none ever has."""
    return points.select("_id").join(_condensed(tree, points, least, 1.0)[0].select("_id", "e"), "_id", "left")


def _highest_chosen(clusters: DataFrame) -> DataFrame:
    """``cluster, best``: of every cluster the chosen one nearest the root on its way there, itself counted; null if there is none.

    Ways are doubled in every round: a row holds the best so far and how far it has come.
    """
    now = staged(clusters.select("cluster", F.when(F.col("chosen"), F.col("cluster")).alias("best"), F.col("parent").alias("next")), "ways")
    for _ in range(MAX_ROUNDS):
        after = now.select(F.col("cluster").alias("next"), F.col("best").alias("_best"), F.col("next").alias("_next"))
        now = staged(now.join(after, "next", "left").select("cluster", F.coalesce("_best", "best").alias("best"), F.col("_next").alias("next")), "ways")
        if not now.filter("next is not null").take(1):
            return now.select("cluster", "best")
    raise RuntimeError(f"ways to the root did not settle in {MAX_ROUNDS} rounds")


def hdbscan(df: DataFrame, key: str, vector: str, min_samples: int = 3, min_cluster_size: int | None = None, block: int = BLOCK, backend: str = "kdtree") -> DataFrame:
    """``key, cluster``: the smallest key of the cluster, -1 for noise.

    Clusters are the nodes of the condensed tree (splits into parts of ``min_cluster_size``, by default ``min_samples`` and two at
    least) whose stability is not below that of the best clusters inside them; all vectors together are never one cluster.
    Null vectors are noise; equal vectors are at distance 0, whose density counts as that of the smallest positive distance.
    """
    least = max(min_samples if min_cluster_size is None else min_cluster_size, 2)
    points = df.select(F.col(key).alias("_id")).filter(F.col(vector).isNotNull())
    noise = df.select(key, F.lit(-1).cast("long").alias("cluster"))
    if points.count() < least:
        return noise
    tree = spanning_tree(df, key, vector, min_samples, block, backend)
    smallest = tree.filter("w > 0").agg(F.min("w")).first()[0] or 1.0
    joined, clusters = _condensed(tree, points, least, float(smallest))
    label = joined.join(_highest_chosen(clusters), "cluster").filter("best is not null").select("_id", F.col("best").alias("c"))
    label = staged(label, "labels")
    named = label.join(label.groupBy("c").agg(F.min("_id").alias("cluster")), "c").select("_id", "cluster")
    return df.select(key).join(named, F.col(key) == F.col("_id"), "left").select(key, F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))
