"""A network on weighted sets: records are embedded, pooled by attention, and a head tells a value of every sample.

The records of a sample need not fit in one task.  Each of a few learned queries weighs all records of a sample by a softmax;
tasks hold its largest logit and sums for their own records, which Spark adds up (pass one).  For the gradient, the normaliser,
the pooled vector and its gradient of every sample of a batch go back to the records (pass two).  A record's weight enters as the
logarithm added to its logits, so only shares within a sample count.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexivec.functions.names import prototype_hash
from plexivec.learn.training import AT_ONCE, CHUNK, Adam, Net, load_params, matrix, save_params
from plexivec.operators.basis import Basis
from plexivec.operators.evaluate import roc_auc, spearman
from plexivec.plans.skew import MAX_HOT, lookup
from plexivec.plans.staging import dropped, new_path, staged

#: Records of a sample in one part of the staged table; larger samples are several parts.
PART_ROWS = 65536
#: Samples whose sums a task holds before it hands them on.
MAX_HELD = 1024
#: Samples of a batch, if all samples can be dealt to the rounds in such batches; and samples of a batch, about, up to
#: which the driver sees their pooled vectors.
BATCH_SAMPLES, MAX_SEEN = 128, 1024
#: Folders of the staged table; a batch reads one of them.
MAX_DEALS = 256
TASKS = ("regression", "classification")


class SetNet(Net):
    """Two dense layers for a record, ``queries`` softmaxes over the records of a sample, two dense layers for the sample."""

    def __init__(self, width: int, hidden: int = 32, queries: int = 8):
        self.width, self.hidden, self.queries = width, hidden, queries
        super().__init__({"in": (width, hidden), "in0": (hidden,), "mid": (hidden, hidden), "mid0": (hidden,), "ask": (hidden, queries), "head": (queries * hidden, hidden), "head0": (hidden,), "out": (hidden, 1), "out0": (1,)})

    def start(self, seed: int) -> np.ndarray:
        flat = super().start(seed)
        self.views(flat)["ask"][:] *= 0.1  # all records alike at first
        return flat

    def records(self, p: dict[str, np.ndarray], z: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both layers of the records, and their logits for each query."""
        a = np.maximum(z @ p["in"] + p["in0"], 0)
        b = np.maximum(a @ p["mid"] + p["mid0"], 0)
        return a, b, b @ p["ask"] / np.sqrt(self.hidden) + np.log(w)[:, None]

    def records_gradient(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], z: np.ndarray, w: np.ndarray, norm: np.ndarray, pooled: np.ndarray, d: np.ndarray) -> None:
        """Adds the gradient of records, given what belongs to the sample of each: log normalisers, pooled vectors and their gradient."""
        a, b, logits = self.records(p, z, w)
        share = np.exp(logits - norm)
        dl = share * (np.einsum("nh,nqh->nq", b, d) - np.einsum("nqh,nqh->nq", pooled, d)) / np.sqrt(self.hidden)
        g["ask"] += b.T @ dl
        db = (dl @ p["ask"].T + np.einsum("nq,nqh->nh", share, d)) * (b > 0)
        g["mid"] += a.T @ db
        g["mid0"] += db.sum(0)
        da = (db @ p["mid"].T) * (a > 0)
        g["in"] += z.T @ da
        g["in0"] += da.sum(0)

    def told(self, p: dict[str, np.ndarray], pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The head's value of every sample, and its hidden layer."""
        h = np.maximum(pooled.reshape(len(pooled), -1) @ p["head"] + p["head0"], 0)
        return (h @ p["out"] + p["out0"])[:, 0], h

    def head_loss(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], pooled: np.ndarray, y: np.ndarray, task: str) -> tuple[float, np.ndarray]:
        """The summed loss of samples, with the gradient of their pooled vectors; adds the head's own to ``g``."""
        v, h = self.told(p, pooled)
        d = 2 * (v - y) if task == "regression" else 0.5 * (1 + np.tanh(v / 2)) - y
        loss = float(((v - y) ** 2).sum() if task == "regression" else (np.logaddexp(0, v) - v * y).sum())
        g["out"] += h.T @ d[:, None]
        g["out0"] += d.sum()
        dh = (d[:, None] * p["out"][:, 0]) * (h > 0)
        g["head"] += pooled.reshape(len(pooled), -1).T @ dh
        g["head0"] += dh.sum(0)
        return loss, (dh @ p["head"].T).reshape(pooled.shape)


def _records(df: DataFrame, sample: str, vector: str, weight: str) -> DataFrame:
    """``sample, z, w, row, _key``: the records that count; others are without sample or vector, or their weight is null, NaN or not above 0."""
    ok = F.col(sample).isNotNull() & F.col(vector).isNotNull() & (F.col(weight) > 0) & ~F.isnan(F.col(weight).cast("double"))
    rows = df.filter(ok).select(F.col(sample).alias("sample"), F.col(vector).cast("array<double>").alias("z"), F.col(weight).cast("double").alias("w"))
    return rows.withColumn("row", F.monotonically_increasing_id()).withColumn("_key", F.xxhash64("sample"))


def _parted(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``_part``: samples of more than ``PART_ROWS`` records are several parts, all others are one.

    Only those samples are looked up.  They are few: a part has at least the 4,000th part of all ``total`` records.
    """
    most = max(PART_ROWS, -(-total // MAX_HOT))
    large = rows.groupBy("_key", "sample").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(F.col("_key").alias("_large"), F.col("sample").alias("_of"), F.ceil(F.col("_n") / most).alias("_parts"))
    met = rows.join(F.broadcast(large), (F.col("_key") == F.col("_large")) & F.col("sample").eqNullSafe(F.col("_of")), "left")
    return met.withColumn("_part", F.pmod(F.xxhash64("row"), F.coalesce("_parts", F.lit(1)))).drop("_large", "_of", "_parts")


def dealt(sample: Column, deals: int, seed: int) -> Column:
    """The folder of a sample, by a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("deal"), sample), F.lit(deals)).cast("int")


def clouds(df: DataFrame, sample: str, vector: str, weight: str, deals: int = 1, seed: int = 0, deal: Column | None = None) -> DataFrame:
    """``sample, z, w, row, deal``: the staged records of all samples, each sample's together in parts of about ``PART_ROWS``.

    Records without sample or vector, or whose weight is null, NaN or not above 0, count for nothing.  ``deal`` is a hash of the
    sample, and a folder of its own; a caller's own ``deal`` is a column of ``sample``, and null for samples that are not wanted.
    """
    place = dealt(F.col("sample"), deals, seed) if deal is None else deal
    # rows are numbered before any is left out, so that a row's number does not depend on the samples that are wanted
    rows = staged(_records(df, sample, vector, weight).withColumn("deal", place).filter("deal is not null"), "records")
    sizes = rows.groupBy("deal").agg(F.count("*").alias("_n"))  # as many as folders
    known = _parted(rows, rows.count()).join(F.broadcast(sizes), "deal")
    slot = F.pmod(F.xxhash64("_key", "_part"), F.ceil(F.col("_n") / PART_ROWS))
    out = known.withColumn("_slot", slot).repartition("deal", "_slot").sortWithinPartitions("deal", "_key", "_part").select("sample", "z", "w", "row", "deal")
    path = new_path(df.sparkSession, "clouds")
    out.write.partitionBy("deal").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def _gathered(df: DataFrame, sample: str, vector: str, weight: str) -> DataFrame:
    """``sample, z, w``: the records that count, to be read once; each sample's together in one task, or in several if it is large."""
    rows = _records(df, sample, vector, weight)
    rows = rows if hasattr(df, "_staged_at") else staged(rows, "records")
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return _parted(rows, rows.count()).repartition(tasks, "_key", "_part").sortWithinPartitions("_key", "_part").select("sample", "z", "w")


def _merged(top: np.ndarray, sums: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest logits (n, queries) and sums (n, queries, numbers) of runs of rows, which begin at ``first``; sums are relative to the logits."""
    most = np.maximum.reduceat(top, first)
    level = np.exp(top - np.repeat(most, np.diff(np.append(first, len(top))), axis=0))
    return most, np.add.reduceat(sums * level[:, :, None], first)


def _runs(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal numbers together, and where each begins."""
    order = np.argsort(place, kind="stable")
    return order, np.flatnonzero(np.append(True, np.diff(place[order]) != 0))


def pooled(net: SetNet, params: np.ndarray, rows: DataFrame) -> DataFrame:
    """``sample, norm, pooled``: of every sample each query's log normaliser and mean of the embedded records by its softmax, one after the other.

    A task's sums are relative to its own largest logit; they are brought to the largest of the sample, so nothing overflows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(params)
    kind = rows.select("sample").schema[0].dataType.simpleString()
    shape = (-1, net.queries, net.hidden + 1)

    def lists(x: np.ndarray) -> pa.Array:
        flat = x.reshape(len(x), -1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held, n = net.views(shared.value), [], 0

        def handed() -> pa.RecordBatch:
            names = pa.concat_arrays([x[0] for x in held]).dictionary_encode()
            order, first = _runs(names.indices.to_numpy())
            most, sums = _merged(np.concatenate([x[1] for x in held])[order], np.concatenate([x[2] for x in held])[order], first)
            held.clear()
            return pa.RecordBatch.from_arrays([names.dictionary, lists(most), lists(sums)], ["sample", "top", "sums"])

        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                _, b, logits = net.records(p, matrix(some, "z"), matrix(some, "w")[:, 0])
                names = some.column("sample").dictionary_encode()
                order, first = _runs(names.indices.to_numpy())
                b = np.concatenate([np.ones((len(b), 1)), b], 1)[order]
                held.append((names.dictionary, *_merged(logits[order], np.broadcast_to(b[:, None], (len(b), net.queries, b.shape[1])), first)))
                n += len(first)
                if n > MAX_HELD:
                    yield handed()
                    n = 0
        if held:
            yield handed()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by sample; the last sample of a batch may go on in the next."""
        rest = None

        def told(name: pa.Array, top: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            size = sums[:, :, :1]
            return pa.RecordBatch.from_arrays([name, lists(top + np.log(size[:, :, 0])), lists(sums[:, :, 1:] / size)], ["sample", "norm", "pooled"])

        for batch in batches:
            if not len(batch):
                continue
            key, name, top, sums = batch.column("_key"), batch.column("sample"), matrix(batch, "top"), matrix(batch, "sums").reshape(shape)
            if rest:
                key, name = pa.concat_arrays([rest[0], key]), pa.concat_arrays([rest[1], name])
                top, sums = np.concatenate([rest[2], top]), np.concatenate([rest[3], sums])
            # equal hashes of different samples come by sample; NaN, which is unlike itself, is one sample
            new = pc.or_(pc.not_equal(key[1:], key[:-1]), pc.and_(pc.not_equal(name[1:], name[:-1]), pc.or_(pc.equal(name[1:], name[1:]), pc.equal(name[:-1], name[:-1]))))
            first = np.flatnonzero(np.append(True, new.to_numpy(zero_copy_only=False)))
            top, sums = _merged(top, sums, first)
            key, name = key.take(pa.array(first)), name.take(pa.array(first))
            rest = key[-1:], name[-1:], top[-1:], sums[-1:]
            if len(first) > 1:
                yield told(name[:-1], top[:-1], sums[:-1])
        if rest:
            yield told(*rest[1:])

    parts = rows.select("sample", "z", "w").mapInArrow(run, f"sample {kind}, top array<double>, sums array<double>")
    parts = parts.withColumn("_key", F.xxhash64("sample")).repartition("_key").sortWithinPartitions("_key", "sample")
    return parts.mapInArrow(add, f"sample {kind}, norm array<double>, pooled array<double>")


def _added(net: SetNet, rows: DataFrame, shared: Broadcast, add: Callable, more: int = 0) -> np.ndarray:
    """The sums, over all tasks, of what ``add(batch, value of shared, sums)`` adds up of at most ``AT_ONCE`` rows; as long as the network's parameters and ``more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(net.size + more)
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                add(batch.slice(at, AT_ONCE), shared.value, g)
        parts = [g[k : k + CHUNK] for k in range(0, len(g), CHUNK)] if g.any() else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], ["chunk", "g"])

    found = rows.mapInArrow(run, "chunk int, g array<double>").groupBy("chunk").agg(Summarizer.sum(array_to_vector("g")).alias("g")).orderBy("chunk").collect()
    shared.destroy()
    return np.concatenate([r["g"].toArray() for r in found]) if found else np.zeros(net.size + more)


def records_gradient(net: SetNet, params: np.ndarray, rows: DataFrame, state: dict) -> np.ndarray:
    """The summed gradient of the records of a batch's samples, given (norm, pooled, gradient of pooled) of each."""
    names = list(state)
    shared = rows.sparkSession.sparkContext.broadcast((params, {n: i for i, n in enumerate(names)}, *(np.stack([state[n][k] for n in names]) for k in range(3))))

    def add(some: pa.RecordBatch, value: tuple, g: np.ndarray) -> None:
        flat, place, norm, pools, d = value
        of = np.array([place.get(x, -1) for x in some.column("sample").to_pylist()])
        own = of >= 0
        if own.any():
            of = of[own]
            net.records_gradient(net.views(flat), net.views(g), matrix(some, "z")[own], matrix(some, "w")[own, 0], norm[of], pools[of], d[of])

    return _added(net, rows.select("sample", "z", "w"), shared, add)


def batch_gradient(net: SetNet, params: np.ndarray, rows: DataFrame, taught: DataFrame, task: str, total: int, largest: int) -> tuple[np.ndarray, int]:
    """The summed gradient of a batch of any size and its number of samples; ``taught``: ``sample, y, n``, with the records of a sample.

    The samples' pooled vectors are a table that meets the records again; samples of many of all ``total`` records are looked up apart.
    """
    key, sc = F.xxhash64("sample").alias("_key"), rows.sparkSession.sparkContext
    state = staged(pooled(net, params, rows).join(taught, "sample").select(key, "sample", "norm", "pooled", "y", "n"), "pooled")
    shape = (-1, net.queries, net.hidden)

    def heads(some: pa.RecordBatch, flat: np.ndarray, g: np.ndarray) -> None:
        net.head_loss(net.views(flat), net.views(g[:-1]), matrix(some, "pooled").reshape(shape), matrix(some, "y")[:, 0], task)
        g[-1] += len(some)

    def records(some: pa.RecordBatch, flat: np.ndarray, g: np.ndarray) -> None:
        p, pools = net.views(flat), matrix(some, "pooled").reshape(shape)
        _, d = net.head_loss(p, net.views(np.zeros(net.size)), pools, matrix(some, "y")[:, 0], task)
        net.records_gradient(p, net.views(g), matrix(some, "z"), matrix(some, "w")[:, 0], matrix(some, "norm"), pools, d)

    met = lookup(rows.select(key, "sample", "z", "w", "row"), state, ["_key", "sample"], "n", total, F.xxhash64("row"), "inner", largest)
    g = _added(net, state.select("pooled", "y"), sc.broadcast(params), heads, 1)
    own = _added(net, met.select("z", "w", "norm", "pooled", "y"), sc.broadcast(params), records)
    dropped(state)
    return g[:-1] + own, int(g[-1])


@dataclass(frozen=True)
class SetModel:
    """A trained network with its task, and the fingerprint of the basis that its records are in."""

    net: SetNet
    params: np.ndarray
    task: str
    center: float = 0.0
    spread: float = 1.0
    basis: str | None = None
    losses: list[float] = field(default_factory=list)

    def _checked(self, df: DataFrame, vector: str) -> None:
        said = df.schema[vector].metadata.get("basis")
        if said != self.basis:
            raise ValueError(f"vectors of different bases: {said} and {self.basis}")

    def predict(self, df: DataFrame, sample: str, vector: str, weight: str, output: str = "predicted") -> DataFrame:
        """``sample, <output>`` of all samples with a record that counts: the value, or the chance of the positive class.

        ValueError for vectors of another basis than the model learned from.
        """
        self._checked(df, vector)
        return self._predicted(_gathered(df, sample, vector, weight)).select(F.col("sample").alias(sample), F.col("predicted").alias(output))

    def _predicted(self, rows: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def value(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            m = shared.value
            for x in batches:
                v = m.net.told(m.net.views(m.params), np.stack(x.to_numpy()))[0] if len(x) else np.zeros(0)
                yield pd.Series(v * m.spread + m.center if m.task == "regression" else 0.5 * (1 + np.tanh(v / 2)))

        return pooled(self.net, self.params, rows).select("sample", value("pooled").alias("predicted"))


def held_out(sample: Column, share: float, seed: int = 0) -> Column:
    """Whether a sample is kept apart to choose the best round by; a hash of it decides."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("held out"), sample), F.lit(1000)) < round(share * 1000)


def _shown(turn: int, least: float, seed: int) -> Column:
    """Whether a record is shown in a turn through the batches: a share of a sample's, between ``least`` and 1, and in every other turn what the one before left out."""
    bits, pair = 1 << 20, turn // 2
    draw = lambda *of: F.pmod(F.xxhash64(F.lit(seed), F.lit(pair), *of), F.lit(bits)) / F.lit(float(bits))
    share = lambda name: F.lit(least) + draw(F.lit(name), F.col("sample")) * F.lit(1 - least)
    place = draw(F.lit("row"), F.col("row"))
    return place < share("share") if turn % 2 == 0 else place >= F.least(1 - share("next"), share("share"))


def train_set_encoder(df: DataFrame, labels: DataFrame, sample: str, vector: str, weight: str, label: str, task: str = "regression", rounds: int = 60, batch_samples: int | None = None, rate: float = 5e-3, hidden: int = 32, queries: int = 8, share: float = 0.2, every: int = 10, least: float | None = 0.2, seed: int = 0) -> SetModel:
    """A model of ``label`` (``labels``: one row a sample) from the samples' records in ``df``.

    Each round takes the samples of one batch, by a hash.  All samples teach, in two rounds at least: batches are as large as that
    needs, ``BATCH_SAMPLES`` or more, and only the pooled vectors of small ones are seen by the driver.  A caller's own ``batch_samples`` are
    about that many a round, and then samples of no round teach nothing.  With ``least`` a sample shows a share of its records, drawn
    between ``least`` and 1 for each round, so that the model learns to read shallow samples; what it does not show in one
    turn through the batches it shows in the next.  Every ``every`` rounds the loss on the ``share`` of samples kept apart is taken; the best
    parameters go to the shared folder and are the result.  Samples without a label or a record teach nothing.  ValueError for an
    unknown task, two labels of a sample, no sample to learn from, or for classes other than 0 and 1.
    """
    if task not in TASKS:
        raise ValueError(f"task must be one of {TASKS}, got {task!r}")
    spark = df.sparkSession
    known = staged(labels.filter(F.col(label).isNotNull() & F.col(sample).isNotNull()).select(F.col(sample).alias("sample"), F.col(label).cast("double").alias("y")).withColumn("apart", held_out(F.col("sample"), share, seed)), "labels")
    n, kinds, mean, dev, odd = known.agg(F.count_if(~F.col("apart")), F.count("*") - F.count_distinct("sample"), F.avg(F.when(~F.col("apart"), F.col("y"))), F.stddev_pop(F.when(~F.col("apart"), F.col("y"))), F.count_if(~F.col("y").isin(0.0, 1.0))).first()
    if kinds:
        raise ValueError("a sample has several labels")
    if not n:
        raise ValueError("no samples to learn from")
    if task == "classification" and odd:
        raise ValueError("classes must be 0 and 1")
    center, spread = (float(mean), float(dev) or 1.0) if task == "regression" else (0.0, 1.0)
    batches = max(1, round(n / (batch_samples or BATCH_SAMPLES)))
    if batch_samples is None:
        batches = max(1, min(batches, rounds // 2))
    deals = min(batches, MAX_DEALS)
    # a batch is a part of one folder; samples kept apart are a folder, samples of no round are not written
    name, apart = F.col("sample"), held_out(F.col("sample"), share, seed)
    first = dealt(name, deals, seed)
    batch_of = first + F.pmod(F.xxhash64(F.lit(seed), F.lit("sub"), name), F.ceil((F.lit(batches) - first) / F.lit(deals))) * deals
    used = batch_of < min(rounds, batches)
    known = known.withColumn("y", (F.col("y") - center) / spread)
    taught, known = staged(known.filter(~apart & used).select("sample", "y"), "taught"), staged(known.filter(apart).select("sample", "y"), "apart")
    rows = clouds(df, sample, vector, weight, deals, seed, deal=F.when(apart, F.lit(-1)).when(used, first))
    head = rows.select(F.size("z")).first() or _records(df, sample, vector, weight).select(F.size("z")).first()
    if head is None:
        raise ValueError("no samples to learn from")
    large = n > MAX_SEEN * batches
    if large:
        sizes = rows.filter("deal >= 0").groupBy("sample").agg(F.count("*").alias("n"))
        taught = staged(taught.join(sizes, "sample"), "taught")
        total, largest = taught.agg(F.sum("n"), F.max("n")).first()
    net = SetNet(head[0], hidden, queries)
    adam, losses, best, kept, path = Adam(net.start(seed), rate, rounds), [], np.inf, None, None
    model = lambda flat: SetModel(net, flat, task, center, spread, df.schema[vector].metadata.get("basis"), losses)
    for k in range(rounds):
        batch = rows.filter((F.col("deal") == k % batches % deals) & (batch_of == k % batches))
        if least is not None:
            batch = batch.filter(_shown(k // batches, least, seed))
        if large:
            g, m = batch_gradient(net, adam.params, batch, taught, task, total or 0, largest or 0)
            if m:
                adam.step(g / m)
        elif met := pooled(net, adam.params, batch).join(F.broadcast(taught), "sample").select("sample", "norm", "pooled", "y").collect():
            p, g = net.views(adam.params), np.zeros(net.size)
            pools = np.array([r["pooled"] for r in met]).reshape(len(met), queries, hidden)
            _, d = net.head_loss(p, net.views(g), pools, np.array([r["y"] for r in met]), task)
            state = {r["sample"]: (np.array(r["norm"]), pools[i], d[i]) for i, r in enumerate(met)}
            adam.step((g + records_gradient(net, adam.params, batch, state)) / len(met))
        if (k + 1) % every == 0 or k == rounds - 1:
            losses.append(_validation(model(adam.params), rows.filter("deal = -1"), known))
            if losses[-1] < best or kept is None:
                best, kept = losses[-1], adam.params
                path = path or new_path(spark, "parameters")
                save_params(spark, path, kept, {"round": k, "loss": best})
    return model(kept)


def _validation(model: SetModel, rows: DataFrame, known: DataFrame) -> float:
    """Mean loss on labelled samples; infinite if there is none."""
    v = F.col("predicted")
    loss = ((v - model.center) / model.spread - F.col("y")) ** 2
    if model.task == "classification":
        loss = -F.when(F.col("y") == 1, F.log(F.greatest(v, F.lit(1e-300)))).otherwise(F.log(F.greatest(1 - v, F.lit(1e-300))))
    found = model._predicted(rows).join(known, "sample").agg(F.avg(loss)).first()[0]
    return np.inf if found is None else float(found)


def set_score(predicted: DataFrame, label: str, task: str, value: str = "predicted") -> float | None:
    """How well samples are told: area under the ROC curve (a half with one class only), or the absolute rank correlation (0 if undefined)."""
    if task == "classification":
        found = roc_auc(predicted, value, label).select(F.when(F.isnan("auc"), None).otherwise(F.col("auc"))).first()[0] if predicted.select(label).distinct().count() > 1 else None
        return 0.5 if found is None else found
    return abs(spearman(predicted, value, label).first()[0] or 0.0)


def _prototypes(prototypes: DataFrame) -> str:
    return prototypes.agg(prototype_hash(prototypes).alias("h")).first()[0]


def save_set_encoder(spark: SparkSession, path: str, model: SetModel, basis: Basis, prototypes: DataFrame) -> None:
    """Write a model with the basis of its records and the hash of the prototypes below it; ValueError for another basis than it learned from."""
    if model.basis != basis.fingerprint:
        raise ValueError(f"vectors of different bases: {basis.fingerprint} and {model.basis}")
    net = model.net
    meta = {"task": model.task, "net": [net.width, net.hidden, net.queries], "center": model.center, "spread": model.spread, "basis": basis.record(), "fingerprint": basis.fingerprint, "prototypes": _prototypes(prototypes)}
    save_params(spark, path, model.params, meta | {"check": hashlib.sha256(json.dumps(meta, sort_keys=True).encode()).hexdigest()[:16]})


def load_set_encoder(spark: SparkSession, path: str, prototypes: DataFrame, verify: bool = True) -> tuple[SetModel, Basis]:
    """Read a model and its basis; ValueError if it belongs to other prototypes or what is written of it was changed."""
    params, meta = load_params(spark, path)
    check = meta.pop("check")
    if verify and check != hashlib.sha256(json.dumps(meta, sort_keys=True).encode()).hexdigest()[:16]:
        raise ValueError("the record of the model was changed")
    if verify and meta["prototypes"] != _prototypes(prototypes):
        raise ValueError("the model belongs to other prototypes")
    basis = Basis(**{k: v if k == "meta" or v is None else np.array(v) for k, v in meta["basis"].items()})
    return SetModel(SetNet(*meta["net"]), params, meta["task"], meta["center"], meta["spread"], meta["fingerprint"]), basis
