"""Product codes of integer vectors: Lloyd's rounds with heaps of bounds.

A block of vectors is one row; it keeps, for each part position, the parts of every codebook entry as a heap in
an array: in ascending order of the key "lower bound to any other entry minus upper bound to the own one, plus the
entry's cumulative drift when the key was made".  An entry's own move and the largest move of all others lower the
slack of its parts alike, so its cumulative drift alone tells which parts may have a new nearest entry: those at
the front of its heap whose key is below it.  Only they are popped, compared with all entries exactly, and pushed
again.  Sums of entries change by the parts that went elsewhere.  Codebooks, drifts and sums have a fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexivec.plans.batches import small_batches
from plexivec.plans.skew import lookup
from plexivec.plans.staging import dropped, staged

#: Vectors of a block, and parts compared with a codebook at once.
BLOCK = 8192
AT_ONCE = 2048
#: Share of a bound within which it counts as violated; far above the rounding of square roots.
SLACK = 1e-9


@dataclass(frozen=True)
class Codebooks:
    """Entries as ``parts`` x entries x width whole numbers, and how far each entry's bounds have drifted in all."""

    entries: np.ndarray
    drift: np.ndarray

    @property
    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(vector).isNotNull() & F.coalesce(F.forall(F.col(vector), finite), F.lit(False))


def _squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of parts (rows) to entries; in floats, where all are exact, else in 64-bit integers."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    kind = np.float64 if x.shape[1] * (2 * int(most)) ** 2 < 1 << 52 else np.int64
    x, y = x.astype(kind), entries.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)


def _nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, the lower one on ties, and the slack to the next nearest."""
    label, slack = np.empty(len(x), np.int64), np.full(len(x), np.inf)
    for a in range(0, len(x), AT_ONCE):
        d = _squared(x[a : a + AT_ONCE], entries)
        own = label[a : a + AT_ONCE] = d.argmin(1)
        if len(entries) > 1:
            near = np.sqrt(np.take_along_axis(d, own[:, None], 1)[:, 0].astype(float))
            np.put_along_axis(d, own[:, None], np.iinfo(np.int64).max if d.dtype == np.int64 else np.inf, 1)
            far = np.sqrt(d.min(1).astype(float))
            slack[a : a + AT_ONCE] = far - near - SLACK * (1 + far)
    return label, slack


class Heaps:
    """The heaps of one block and part position: ``at`` lists parts by entry and ascending key."""

    def __init__(self, label: np.ndarray, key: np.ndarray):
        self.label, self.key = label, key
        self.at = np.lexsort((key, label))

    def popped(self, drift: np.ndarray) -> np.ndarray:
        """The parts whose bounds the drift has violated, from the front of every heap."""
        label, key = self.label[self.at], self.key[self.at]
        first = np.searchsorted(label, np.arange(len(drift) + 1))
        out = [self.at[a : a + np.searchsorted(key[a:b], d, "left")] for a, b, d in zip(first[:-1], first[1:], drift) if b > a]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def push(self, parts: np.ndarray, label: np.ndarray, key: np.ndarray) -> Heaps:
        """The heaps with these parts in their new entries'."""
        self.label[parts], self.key[parts] = label, key
        return Heaps(self.label, self.key)


STATE = "n int, ids binary, missing binary, labels binary, x binary, label binary, at binary, key binary, changes array<struct<p:int,e:int,n:bigint,s:array<bigint>>>, rescanned bigint"
_NAMES = [c.split()[0] for c in STATE.split(", ")]
_CHANGE = pa.struct([("p", pa.int32()), ("e", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])
_KINDS = [pa.int32(), *[pa.binary()] * 7, pa.list_(_CHANGE), pa.int64()]


def _changes(x: np.ndarray, label: np.ndarray, sign: int, p: int, out: dict) -> None:
    """Adds sums and counts of parts by entry."""
    order = np.argsort(label, kind="stable")
    entries, first = np.unique(label[order], return_index=True)
    if len(entries):
        sums = np.add.reduceat(x[order].astype(np.int64), first, axis=0)
        for e, k, s in zip(entries.tolist(), np.diff([*first, len(label)]).tolist(), sums):
            n, before = out.get((p, e), (0, 0))
            out[p, e] = n + sign * k, before + sign * s


def _assigned(x: np.ndarray, books: Codebooks, before: list[Heaps] | None) -> tuple[list[Heaps], list[dict], int]:
    """The heaps after this round, the changes of sums, and how many parts were compared with all entries."""
    heaps, out, n = [], {}, 0
    for p, (entries, drift) in enumerate(zip(books.entries, books.drift)):
        if before is None:
            label, slack = _nearest(x[:, p], entries)
            heaps.append(Heaps(label, slack + drift[label]))
            _changes(x[:, p], label, 1, p, out)
            n += len(x)
            continue
        some = before[p].popped(drift)
        label, slack = _nearest(x[some, p], entries)
        moved = label != before[p].label[some]
        _changes(x[some[moved], p], before[p].label[some[moved]], -1, p, out)
        _changes(x[some[moved], p], label[moved], 1, p, out)
        heaps.append(before[p].push(some, label, slack + drift[label]))
        n += len(some)
    return heaps, [{"p": p, "e": e, "n": k, "s": s.tolist()} for (p, e), (k, s) in out.items()], n


def _loaded(batch: pa.RecordBatch, i: int, parts: int, dtype: str) -> tuple[np.ndarray, list[Heaps]]:
    """The vectors of a block and its heaps."""
    n = batch.column("n")[i].as_py()
    read = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)
    heaps = []
    for label, at, key in zip(read("label", np.uint8).reshape(parts, n), read("at", np.int32).reshape(parts, n), read("key", float).reshape(parts, n)):
        h = Heaps.__new__(Heaps)
        h.label, h.at, h.key = label.astype(np.int64), at.astype(np.int64), key.copy()
        heaps.append(h)
    return read("x", dtype).reshape(n, parts, -1), heaps


def _row(x: np.ndarray, ids: tuple[bytes, bytes, bytes], heaps: list[Heaps], changes: list[dict], n: int) -> list:
    join = lambda c, kind: b"".join(getattr(h, c).astype(kind).tobytes() for h in heaps)
    return [len(x), *ids, x.tobytes(), join("label", np.uint8), join("at", np.int32), join("key", float), changes, n]


def _batch(row: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS)], _NAMES)


def _moved(old: Codebooks, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
    """Entries at the floors of their parts' means; unused ones stay.  A bound drifts by the own move and the largest other one."""
    used = counts > 0
    new = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], old.entries)
    move = np.sqrt(((new - old.entries).astype(float) ** 2).sum(2))
    drift = old.drift.copy()
    for p, m in enumerate(move):
        for e in range(len(m)):
            drift[p, e] += (m[e] + np.delete(m, e).max(initial=0.0)) * (1 + SLACK)
    return Codebooks(new, drift)


def vector_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, grid: int = 1024) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable vector.

    Components become ``floor(grid * x)``.  The codebook of each part position starts as that part of the ``entries``
    (at most 256) smallest keys' vectors, in order of key, then vector; ``rounds`` of exact nearest entries (ties to
    the lower) and floored means follow, then a last assignment.  ``code`` has two hex digits a part, ``error`` is the
    squared distance in all, ``label_error`` its sum over equal labels (nulls together).

    Vectors that are null or hold a null, NaN or infinite component are left out.  Repeated rows are rows of their own;
    null keys come last.  No usable vector: no rows.  Fewer than ``entries``: smaller codebooks.  Other columns are
    ignored, whatever their names.  ValueError if usable vectors differ in length, if it isn't a multiple of ``parts``,
    or if components are so large that an error or a sum may not fit a long.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256, two hex digits")
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * grid)
    rows = df.filter(usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled.alias("v"))
    span = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    names = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
    spark = df.sparkSession
    if not span["n"]:
        return spark.createDataFrame([], names)
    dim, most = span["hi"], int(min(span["most"] or 0, 2.0**62)) + 1
    if span["lo"] != dim or dim % parts:
        raise ValueError(f"vectors have {span['lo']} to {dim} components; all need the same multiple of {parts}")
    if dim * (2 * most) ** 2 >= 1 << 62 or span["n"] * most >= 1 << 62:
        raise ValueError("components are too large for whole numbers of 64 bits")
    dtype = "<i2" if most < 1 << 15 else "<i4"
    whole = F.transform("v", lambda x: F.floor(x).cast("long"))
    first = rows.select("id", whole.alias("v")).orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    start = np.array([r["v"] for r in sorted(first, key=lambda r: (r["id"] is None, r["id"] or 0, r["v"]))], np.int64)
    books = Codebooks(start.reshape(len(first), parts, -1).transpose(1, 0, 2).copy(), np.zeros((parts, len(first))))

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = np.floor(t.column("v").combine_chunks().flatten().to_numpy()).astype(dtype).reshape(len(t), parts, -1)
            ids = [t.column(c).fill_null(0).to_numpy().tobytes() for c in ("id", "label")]
            missing = np.packbits(np.stack([t.column(c).is_null().to_numpy() for c in ("id", "label")])).tobytes()
            return _batch(_row(x, (ids[0], missing, ids[1]), *_assigned(x, books, None)))

        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                some = batch.slice(a, BLOCK)
                if n + len(some) > BLOCK:
                    yield block()
                    held, n = [], 0
                held.append(some)
                n += len(some)
        if n:
            yield block()

    def again(books: Codebooks):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    x, heaps = _loaded(batch, i, parts, dtype)
                    ids = tuple(batch.column(c)[i].as_py() for c in ("ids", "missing", "labels"))
                    yield _batch(_row(x, ids, *_assigned(x, books, heaps)))

        return run

    sums, counts = np.zeros(books.entries.shape, np.int64), np.zeros(books.entries.shape[:2], np.int64)
    state = staged(small_batches(rows).mapInArrow(begun, STATE), "codes")
    for k in range(rounds):
        change = state.select(F.explode("changes").alias("c")).groupBy("c.p", "c.e").agg(F.sum("c.n").alias("n"), *[F.sum(F.col("c.s")[i]).alias(f"s{i}") for i in range(dim // parts)])
        for r in change.collect():  # at most parts x entries rows
            counts[r["p"], r["e"]] += r["n"]
            sums[r["p"], r["e"]] += [r[f"s{i}"] for i in range(dim // parts)]
        books = _moved(books, sums, counts)
        new = staged(state.mapInArrow(again(books), STATE), "codes")
        dropped(state)
        state = new

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x, heaps = _loaded(batch, i, parts, dtype)
                read = lambda c, kind=np.int64: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
                no_id, no_label = np.unpackbits(read("missing", np.uint8))[: 2 * len(x)].reshape(2, -1).astype(bool)
                error = sum(((x[:, p].astype(np.int64) - books.entries[p][h.label]) ** 2).sum(1) for p, h in enumerate(heaps))
                codes = np.stack([h.label.astype(np.uint8) for h in heaps], 1).tobytes().hex()
                cols = [pa.array(read("ids"), mask=no_id), pa.array([codes[j : j + 2 * parts] for j in range(0, len(codes), 2 * parts)], pa.string()), pa.array(error), pa.array(read("labels"), mask=no_label)]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "code", "error", "label"])

    out = staged(state.mapInArrow(told, "vec_id bigint, code string, error bigint, label bigint"), "coded")
    by_label = out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    met = lookup(out, by_label, ["label"], "_n", span["n"], F.xxhash64("vec_id", "code"))
    return met.select("vec_id", "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))
