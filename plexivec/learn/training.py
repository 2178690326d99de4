"""Data-parallel training of small networks: gradients are sums over partitions, parameters a broadcast a round.

A round takes the rows of one batch, chosen by a hash, sums loss and gradient in every task and adds the tasks' sums up in
Spark, a few thousand numbers a row; the driver holds the parameters, whose number does not depend on the data.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexivec.plans.batches import spread
from plexivec.plans.staging import new_path, staged

#: Numbers of a gradient in one row, and rows of a batch computed at once.
CHUNK = 4096
AT_ONCE = 1024


class Net:
    """A network: named arrays of parameters, and loss and gradient of a batch of columns."""

    #: Columns that ``loss`` needs.
    columns: tuple[str, ...] = ()

    def __init__(self, shapes: dict[str, tuple[int, ...]]):
        self.shapes = shapes

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes.values())

    def start(self, seed: int) -> np.ndarray:
        """Parameters to begin with: weights by the number of inputs, offsets 0."""
        rng, out = np.random.default_rng(seed), np.zeros(self.size)
        for a in self.views(out).values():
            if a.ndim > 1:
                a[:] = rng.standard_normal(a.shape) * np.sqrt(2 / np.prod(a.shape[:-1]))
        return out

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The named arrays as parts of one."""
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def loss(self, p: dict[str, np.ndarray], cols: dict[str, np.ndarray], g: dict[str, np.ndarray] | None) -> float:
        """The summed loss of the rows; adds its gradient to ``g``."""
        raise NotImplementedError


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of numbers, or of lists of one length, as a matrix."""
    values = batch.column(column)
    listed = pa.types.is_list(values.type) or pa.types.is_large_list(values.type)
    return (values.flatten() if listed else values).to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def summed(net: Net, params: np.ndarray, rows: DataFrame, gradient: bool = True) -> tuple[float, int, np.ndarray]:
    """Loss, number of rows and gradient of all ``rows``."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, g, loss, n = net.views(shared.value), np.zeros(net.size if gradient else 0), 0.0, 0
        for batch in batches:
            for a in range(0, len(batch), AT_ONCE):
                some = batch.slice(a, AT_ONCE)
                loss += net.loss(p, {c: matrix(some, c) for c in net.columns}, net.views(g) if gradient else None)
                n += len(some)
        if n:
            sums = np.concatenate([[loss, n], g])
            parts = [sums[k : k + CHUNK] for k in range(0, len(sums), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], ["chunk", "s"])

    parts = rows.select(*net.columns).mapInArrow(run, "chunk int, s array<double>").groupBy("chunk").agg(Summarizer.sum(array_to_vector("s")).alias("s")).orderBy("chunk").collect()
    shared.destroy()
    if not parts:
        return 0.0, 0, np.zeros(net.size)
    total = np.concatenate([r["s"].toArray() for r in parts])
    return total[0], int(total[1]), total[2:]


class Adam:
    """Parameters that gradients move by Adam, slower in the second half of all rounds."""

    def __init__(self, params: np.ndarray, rate: float, rounds: int):
        self.params, self.rate, self.rounds, self.k = params, rate, rounds, 0
        self.first, self.second = np.zeros_like(params), np.zeros_like(params)

    def step(self, g: np.ndarray) -> None:
        """One move against the gradient ``g``."""
        self.first, self.second = 0.9 * self.first + 0.1 * g, 0.99 * self.second + 0.01 * g * g
        step = self.first / (1 - 0.9 ** (self.k + 1)) / (np.sqrt(self.second / (1 - 0.99 ** (self.k + 1))) + 1e-8)
        self.params = self.params - self.rate * min(1.0, 2 * (1 - self.k / self.rounds)) * step
        self.k += 1


@dataclass
class Fitted:
    """Parameters, the losses of validation by round, and where the best parameters are kept."""

    params: np.ndarray
    losses: list[float] = field(default_factory=list)
    path: str | None = None


def save_params(spark: SparkSession, path: str, params: np.ndarray, meta: dict | None = None) -> None:
    """One JSON line with the parameters and what belongs to them."""
    line = json.dumps({"params": params.tolist(), "meta": meta or {}})
    spark.createDataFrame(pa.table({"value": [line]})).coalesce(1).write.mode("overwrite").text(path)


def load_params(spark: SparkSession, path: str) -> tuple[np.ndarray, dict]:
    found = json.loads(spark.read.text(path).first()[0])
    return np.array(found["params"]), found["meta"]


#: Files of a batch.
SLICES = 8


def _dealt(rows: DataFrame, key: str, rounds: int, batches: int, seed: int) -> DataFrame:
    """``rows`` with ``round``, a folder of its own: written once, so that a round reads its own batch only, and rows of no round are not even made.

    In a turn through all rows a hash of ``key`` says the batch; batches of turn after turn are rounds.
    """
    turns = [F.lit(t * batches) + F.pmod(F.xxhash64(F.lit(seed), F.lit(t), F.col(key)), F.lit(batches)) for t in range(-(-rounds // batches))]
    mine = F.filter(F.array(*turns), lambda k: k < rounds)
    out = rows.filter(F.size(mine) > 0).withColumn("round", F.explode(mine).alias("round")).withColumn("round", F.col("round").cast("int"))
    path = new_path(rows.sparkSession, "batches")
    slot = F.pmod(F.xxhash64(F.lit("slice"), F.col(key)), F.lit(SLICES))
    out.repartition("round", slot).drop(key).write.partitionBy("round").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(out.drop(key).schema).parquet(path)


def fit(net: Net, rows: DataFrame, key: str, rounds: int = 60, batch_rows: int = 4096, rate: float = 3e-3, seed: int = 0, validation: DataFrame | None = None, every: int = 5) -> Fitted:
    """Adam over ``rounds`` batches of about ``batch_rows`` rows, which a hash of ``key`` and pass deals out; all rows in turn.

    Every ``every`` rounds the loss on ``validation`` is taken; the best parameters so far are written to the shared
    folder and are the result.  ValueError without rows.
    """
    n = rows.count()
    if not n:
        raise ValueError("no rows to learn from")
    batches = max(1, round(n / batch_rows))
    if batches > 1:
        rows, validation = _dealt(rows.select(key, *net.columns), key, rounds, batches, seed), rows if validation is None else validation
    else:
        rows = staged(rows.select(*net.columns).repartition(SLICES), "rows")  # read in every round
    if validation is not None:
        validation = staged(spread(validation.select(*net.columns)), "validation")
    adam, best, kept = Adam(net.start(seed), rate, rounds), np.inf, None
    out = Fitted(adam.params)
    for k in range(rounds):
        batch = rows if batches == 1 else rows.filter(F.col("round") == k)
        _, m, g = summed(net, adam.params, batch)
        if m:
            adam.step(g / m)
        params = adam.params
        if validation is not None and (k + 1) % every == 0 or k == rounds - 1:
            loss, m, _ = summed(net, params, rows if validation is None else validation, gradient=False)
            out.losses.append(loss / max(m, 1))
            if out.losses[-1] < best:
                best, kept = out.losses[-1], params
                out.path = out.path or new_path(rows.sparkSession, "parameters")
                save_params(rows.sparkSession, out.path, params, {"round": k, "loss": best})
    out.params = params if kept is None else kept
    return out


def split(df: DataFrame, key: str, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Eight tenths to learn from, a tenth to choose by and a tenth to test on, by a hash of ``key``."""
    part = F.pmod(F.xxhash64(F.lit(seed), F.lit("split"), F.col(key)), F.lit(10))
    return df.filter(part < 8), df.filter(part == 8), df.filter(part == 9)
