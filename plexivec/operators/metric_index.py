"""A metric index for neighbour joins: both sides in cells, pairs of cells cut by the triangle inequality.

Vectors are dealt to the ball of their nearest pivot, and balls are cut into shells by distance; a shell is a cell.
For every cell the least and largest distance to each pivot are known, so for two cells no distance can be below the
largest gap between their ranges.  Only pairs of cells that may hold neighbours are compared.  Cells travel in parts of
either side, of which there are no more than a fixed number until parts have their largest size.  Pivots and cells have fixed bounds in number, so their tables fit the driver whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexivec.plans.staging import staged

MAX_CELLS = 1024
SHELLS = 4
#: Rows from which pivots are chosen, far from each other.
SAMPLE = 2048


def distances2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows by one product; to be recomputed where a hair decides."""
    d = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
    return np.maximum(d, 0.0, out=d)


def stacked(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float)


def _pivots(df: DataFrame, n: int) -> np.ndarray:
    """``n`` rows at most, each the farthest from those before, of a bounded sample by hash."""
    some = df.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select("v").toPandas()["v"]
    x = np.unique(stacked(some), axis=0)
    chosen, near = [0], distances2(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances2(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


class CellIndex:
    """Both sides of a join (``_id, v`` and more) in cells, with the ranges of their distances to the pivots; one frame on both sides has the same cells."""

    def __init__(self, left: DataFrame, right: DataFrame, block: int):
        self.block = block
        n = max(left.count(), right.count())
        cells = min(MAX_CELLS, -(-n // block))
        shells = min(SHELLS, cells)
        self.pivots = _pivots(right, -(-cells // shells))
        self.left, self.n_left, self.left_low, self.left_high = self._dealt(left, shells)
        same = right is left
        self.right, self.n_right, self.right_low, self.right_high = (self.left, self.n_left, self.left_low, self.left_high) if same else self._dealt(right, shells)

    def _dealt(self, df: DataFrame, shells: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        pivots = self.pivots

        @F.pandas_udf("ball int, far double")
        def home(v: pd.Series) -> pd.DataFrame:
            if not len(v):
                return pd.DataFrame({"ball": pd.Series([], dtype="int32"), "far": pd.Series([], dtype=float)})
            d = distances2(stacked(v), pivots)
            return pd.DataFrame({"ball": d.argmin(1).astype("int32"), "far": np.sqrt(d.min(1))})

        rows = staged(df.withColumn("_h", home("v")).select(*df.columns, "_h.ball", "_h.far"), "balls")
        cuts = {r["ball"]: r["q"] for r in rows.groupBy("ball").agg(F.percentile_approx("far", [i / shells for i in range(1, shells)] or [1.0]).alias("q")).collect()}
        edges = [sorted(cuts.get(b, [])) if shells > 1 else [] for b in range(len(pivots))]
        shell = F.size(F.filter(F.get(F.array(*[F.array(*map(F.lit, e)) if e else F.array().cast("array<double>") for e in edges]), F.col("ball")), lambda e: e < F.col("far")))
        rows = rows.withColumn("cell", F.col("ball") * shells + shell)

        def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: dict[int, list] = {}
            for b in batches:
                if len(b):
                    d = np.sqrt(distances2(stacked(b["v"]), pivots))
                    for cell, at in b.groupby("cell").indices.items():
                        low, high = d[at].min(0), d[at].max(0)
                        s = seen.setdefault(cell, [0, low, high])
                        seen[cell] = [s[0] + len(at), np.minimum(s[1], low), np.maximum(s[2], high)]
            if seen:
                yield pd.DataFrame([(c, n, lo, hi) for c, (n, lo, hi) in seen.items()], columns=["cell", "n", "low", "high"])

        found = rows.select("v", "cell").mapInPandas(ranges, "cell int, n bigint, low array<double>, high array<double>")
        each = found.select("cell", "n", F.posexplode(F.arrays_zip("low", "high")).alias("p", "z")).groupBy("cell", "p").agg(F.sum("n").alias("n"), F.min("z.low").alias("low"), F.max("z.high").alias("high"))
        size, p = len(pivots) * shells, len(pivots)
        n, low, high = np.zeros(size, np.int64), np.full((size, p), np.inf), np.full((size, p), -np.inf)
        for r in each.collect():  # at most MAX_CELLS x pivots rows
            n[r["cell"]], low[r["cell"], r["p"]], high[r["cell"], r["p"]] = r["n"], r["low"], r["high"]
        return rows, n, low, high

    def lower_bounds(self) -> np.ndarray:
        """For every pair of cells: no two of their vectors are nearer.  Infinite for an empty cell."""
        out = np.zeros((len(self.n_left), len(self.n_right)))
        for p in range(len(self.pivots)):
            a, b = self.left_low[:, p, None] - self.right_high[None, :, p], self.right_low[None, :, p] - self.left_high[:, p, None]
            np.maximum(out, np.maximum(a, b), out=out)
        out[:, self.n_right == 0] = np.inf
        out[self.n_left == 0] = np.inf
        return out * (1 - 1e-9) - 1e-6

    def visited(self, needed: np.ndarray) -> float:
        """The share of all pairs of vectors that lie in needed pairs of cells."""
        return float(self.n_left @ needed @ self.n_right / (self.n_left.sum() * self.n_right.sum()))

    def radius_of_cells(self, radius: Column, left: DataFrame | None = None) -> np.ndarray:
        """The largest radius in each left cell; -1 without rows."""
        out = np.full(len(self.n_left), -1.0)
        for r in (self.left if left is None else left).groupBy("cell").agg(F.max(radius).alias("r")).collect():
            out[r["cell"]] = r["r"]
        return out

    def join(self, needed: np.ndarray, run: Callable, schema: str, radius: str | None = None, left: DataFrame | None = None) -> DataFrame:
        """``run(left rows, right rows)`` (``Rows``) for the rows of all needed pairs of cells, as in ``meet``.

        With a column ``radius`` a left row goes only to cells that may reach into its own ball.
        """
        left = self.left if left is None else left
        ranges = (radius, self.right_low, self.right_high) if radius else None
        return meet(left, self.right, self.n_left, self.n_right, needed, run, schema, self.block, ranges)


#: A column of row values by name; ``v`` is a matrix.
Rows = dict[str, np.ndarray]
#: Parts that a side is dealt to while none is larger than ``PART`` rows: every row is sent to each part of the other
#: side, so what is shuffled grows as the rows do, not as their pairs.
GRID, PART = 24, 65536


def rows_of(df: pd.DataFrame) -> Rows:
    """Columns as arrays."""
    return {c: stacked(df[c]) if df[c].dtype == object else df[c].to_numpy() for c in df.columns}


def taken(rows: Rows, at: np.ndarray) -> Rows:
    return {c: x[at] for c, x in rows.items()}


def parts_of(n: int, block: int) -> int:
    """Parts that a side of ``n`` rows is dealt to."""
    return max(min(GRID, -(-n // block)), -(-n // PART), 1)


def _dealt_cells(n: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The first part of every cell and the number of its parts; a cell beyond the size of a part is spread, others share one."""
    size = max(1, -(-int(n.sum()) // parts_of(int(n.sum()), block)))
    return (np.cumsum(n) - n) // size, np.maximum(1, -(-n // size))


def meet(left: DataFrame, right: DataFrame, n_left: np.ndarray, n_right: np.ndarray, needed: np.ndarray, run: Callable, schema: str, block: int, ranges: tuple | None = None) -> DataFrame:
    """``run(left rows, right rows)`` for the rows of all needed pairs of cells (column ``cell``; rows of each cell are counted).

    Cells are gathered in parts, and a task has one part of each side.  There ``run`` is called once for all cells that the
    same left rows need.  ``ranges`` are a column of radii and the least and largest distances of right cells to the
    pivots, by which a left row (``ball, far``) is spared cells.
    """
    spark = left.sparkSession
    (first, span), (first_r, span_r) = _dealt_cells(n_left, block), _dealt_cells(n_right, block)
    inside = lambda first, span: (first[:, None] <= np.arange((first + span).max())) & (np.arange((first + span).max()) < (first + span)[:, None])
    held = needed & (n_left > 0)[:, None] & (n_right > 0)
    pairs = np.argwhere(inside(first, span).T.astype(np.float32) @ held.astype(np.float32) @ inside(first_r, span_r).astype(np.float32) > 0)

    def dealt(df: DataFrame, first: np.ndarray, span: np.ndarray, side: int) -> DataFrame:
        cells = spark.createDataFrame([(c, int(a), int(n)) for c, (a, n) in enumerate(zip(first, span))], "cell int, _first long, _span long")
        to: dict[int, list[int]] = {}
        for pair in pairs.tolist():
            to.setdefault(pair[side], []).append(pair[1 - side])
        parts = spark.createDataFrame(list(to.items()), "_part long, _to array<long>")
        rows = df.join(F.broadcast(cells), "cell").withColumn("_part", F.col("_first") + F.pmod(F.xxhash64("_id"), "_span"))
        rows = rows.join(F.broadcast(parts), "_part").withColumn("_other", F.explode("_to"))
        i, j = ("_part", "_other") if side == 0 else ("_other", "_part")
        return rows.select(*df.columns, F.col(i).alias("_i"), F.col(j).alias("_j"))

    bits, width = np.packbits(needed, axis=1), needed.shape[1]

    def task(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame()
        one, other = rows_of(x.drop(columns=["_i", "_j"])), rows_of(y.drop(columns=["_i", "_j"]).sort_values("cell"))
        cells, at = np.unique(other["cell"], return_index=True)
        ends = np.append(at[1:], len(other["cell"]))
        own, place = np.unique(one["cell"], return_inverse=True)
        wanted = np.unpackbits(bits[own], axis=1, count=width)[:, cells].astype(bool)[place]
        if ranges:
            radius, low, high = ranges
            near, far = one[radius][:, None] * (1 + 1e-9) + 1e-6, one["far"][:, None]
            wanted &= (low[cells][:, one["ball"]].T - far <= near) & (far - high[cells][:, one["ball"]].T <= near)
        alike: dict[bytes, list[int]] = {}
        for c, column in enumerate(np.packbits(wanted, axis=0).T):
            alike.setdefault(column.tobytes(), []).append(c)
        out = []
        for group in alike.values():
            rows = np.flatnonzero(wanted[:, group[0]])
            if len(rows):
                a = one if len(rows) == len(wanted) else taken(one, rows)
                b = other if len(group) == len(cells) else taken(other, np.concatenate([np.arange(at[c], ends[c]) for c in group]))
                found = run(a, b)
                if len(found):
                    out.append(found)
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame()

    a, b = dealt(left, first, span, 0), dealt(right.toDF(*right.columns), first_r, span_r, 1)
    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(task, schema)
