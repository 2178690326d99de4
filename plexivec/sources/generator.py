"""Background records from a model that is learned from a table, read as a partitioned data source.

The model is counts: of gene pairs, of lengths, of first letters, of letters after a letter, and of last letters.  Its
size depends on genes and letters, not on rows.  Row blocks have random numbers of their own, so any partition can be
read alone and rows do not depend on the number of partitions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of one stream of random numbers.
BLOCK = 4096
NAME = "learned_records"
SCHEMA = "row_id bigint, v_call string, j_call string, junction_aa string"


def generator_counts(df: DataFrame, v: str = "v_call", j: str = "j_call", sequence: str = "junction_aa") -> DataFrame:
    """``kind, a, b, n``: gene pairs, lengths (a), first letters (b), letters b after a inside a sequence, last letters (b).

    Rows without a gene or with fewer than two letters teach nothing.
    """
    s = F.col(sequence)
    rows = df.filter(F.col(v).isNotNull() & F.col(j).isNotNull() & (F.length(s) >= 2)).select(F.col(v).alias("v"), F.col(j).alias("j"), s.alias("s"))
    length = F.length("s")
    part = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("string").alias("a"), b.cast("string").alias("b"))
    one = F.array(part("genes", F.col("v"), F.col("j")), part("length", length, F.lit(None)), part("first", F.lit(None), F.left("s", F.lit(1))), part("last", F.lit(None), F.right("s", F.lit(1))))
    steps = F.transform(F.filter(F.sequence(F.lit(1), length), lambda i: i < length - 1), lambda i: part("next", F.substring("s", i, F.lit(1)), F.substring("s", i + 1, F.lit(1))))
    return rows.select(F.explode(F.concat(one, steps)).alias("p")).groupBy("p.kind", "p.a", "p.b").agg(F.count("*").alias("n"))


def learn_generator(df: DataFrame, v: str = "v_call", j: str = "j_call", sequence: str = "junction_aa") -> str:
    """The counts as JSON, in a fixed order; ValueError if no row teaches anything."""
    rows = sorted(((r["kind"], r["a"] or "", r["b"] or "", r["n"]) for r in generator_counts(df, v, j, sequence).collect()))
    if not rows:
        raise ValueError("no rows to learn from")
    return json.dumps(rows)


def _pick(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of numbers in 0 .. 1 among cumulative weights."""
    up = np.cumsum(weights) / weights.sum()
    return np.minimum(np.searchsorted(up, at, "right"), len(weights) - 1)


class _Model:
    def __init__(self, text: str):
        rows = json.loads(text)
        of = lambda kind: [r for r in rows if r[0] == kind]
        self.genes, self.lengths = of("genes"), of("length")
        self.letters = sorted({x for r in rows if r[0] in ("first", "last", "next") for x in r[1:3] if x})
        at = {x: i for i, x in enumerate(self.letters)}
        self.first, self.last = np.zeros(len(at)), np.zeros(len(at))
        for kind, w in (("first", self.first), ("last", self.last)):
            for _, _, b, n in of(kind):
                w[at[b]] = n
        self.next = np.zeros((len(at), len(at)))
        for _, a, b, n in of("next"):
            self.next[at[a], at[b]] = n
        self.next[self.next.sum(1) == 0] = self.next.sum(0) + self.first  # a letter that is only ever last
        self.gene_weights, self.length_weights = (np.array([r[3] for r in x], float) for x in (self.genes, self.lengths))

    def block(self, seed: int, number: int) -> tuple[list[str], list[str], list[str]]:
        """All rows of one block."""
        rng = np.random.default_rng([seed, number])
        gene = _pick(self.gene_weights, rng.random(BLOCK))
        size = np.array([int(r[1]) for r in self.lengths])[_pick(self.length_weights, rng.random(BLOCK))]
        up = np.cumsum(self.next, 1) / self.next.sum(1, keepdims=True)
        letters = np.empty((BLOCK, size.max()), np.int64)
        letters[:, 0] = _pick(self.first, rng.random(BLOCK))
        for i in range(1, size.max()):
            letters[:, i] = np.minimum((rng.random(BLOCK)[:, None] >= up[letters[:, i - 1]]).sum(1), len(self.letters) - 1)
        letters[np.arange(BLOCK), size - 1] = _pick(self.last, rng.random(BLOCK))
        names = np.array(self.letters)
        return [self.genes[g][1] for g in gene], [self.genes[g][2] for g in gene], ["".join(names[row[:n]]) for row, n in zip(letters, size)]


class _Blocks(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.model, self.rows, self.seed = options["model"], int(options["rows"]), int(options.get("seed", 0))
        self.parts = max(1, int(options.get("partitions", 8)))

    def partitions(self) -> list[_Blocks]:
        blocks = -(-self.rows // BLOCK)
        cuts = [blocks * k // self.parts for k in range(self.parts + 1)]
        return [_Blocks(a, b) for a, b in zip(cuts, cuts[1:]) if b > a] or [_Blocks(0, 0)]

    def read(self, partition: _Blocks) -> Iterator[pa.RecordBatch]:
        model = _Model(self.model)
        for k in range(partition.first, partition.end):
            n = min(BLOCK, self.rows - k * BLOCK)
            v, j, s = (x[:n] for x in model.block(self.seed, k))
            yield pa.RecordBatch.from_arrays([pa.array(range(k * BLOCK, k * BLOCK + n), pa.int64()), pa.array(v), pa.array(j), pa.array(s)], ["row_id", "v_call", "j_call", "junction_aa"])


class LearnedRecords(DataSource):
    """Options ``model`` (of ``learn_generator``), ``rows``, ``seed`` and ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def generate_records(spark: SparkSession, model: str, n: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """``n`` rows ``row_id, v_call, j_call, junction_aa`` drawn from a model."""
    spark.dataSource.register(LearnedRecords)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.read.format(NAME).option("model", model).option("rows", n).option("seed", seed).option("partitions", parts).load()
