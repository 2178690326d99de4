"""Token ids in training order: fixed-stride binary shards, shuffled by a keyed permutation.

A document becomes sequences of ``seq_len`` token ids.  A keyed Feistel permutation with cycle-walking
runs over all pairs of a document id in the range of ids and a sequence number up to the largest that the
longest text can have, and gives every sequence a place of its own.  Shard k holds the k-th range of
places, sorted, as records of a fixed number of bytes; slots are the places that are taken, in order.  A
slot is found from the shards' record counts and a multiplication, so reading is sequential and can be
resumed anywhere.  The order depends on ids, lengths in bytes and the key, not on how rows are
partitioned; and it needs no count of the sequences beforehand, so no second pass of the tokenizer.

Records are written by Spark's text writer, whose committer covers lost tasks: a cast to string leaves
bytes as they are, and every record ends with a line end, which is part of the stride.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexivec.llm.wordhash import mix
from plexivec.plans.batches import small_batches
from plexivec.plans.staging import new_path

if TYPE_CHECKING:
    import tiktoken

#: Pattern of the byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes before the tokens of a record: document id, sequence number, number of tokens.
HEAD = np.dtype([("doc_id", "<i8"), ("part", "<i4"), ("n_tokens", "<i4")])
ROUNDS = 6
#: Characters encoded at once; longer texts are cut before a lone space, where no token crosses.
CUT = 1 << 18
_LONE = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of records that a task hands on at once.
FLUSH = 8 << 20


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The tokenizer of a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, tokenizer: tiktoken.Encoding) -> np.ndarray:
    """Token ids of a whole text."""
    if len(text) <= CUT:
        return np.array(tokenizer.encode_ordinary(text), np.uint32)
    out, at = [], 0
    while at < len(text):
        found = _LONE.search(text, at + CUT)
        end = found.start() if found else len(text)
        out.append(np.array(tokenizer.encode_ordinary(text[at:end]), np.uint32))
        at = end
    return np.concatenate(out)


def _rounds(left: np.ndarray, right: np.ndarray, half: int, key: int, tweak: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Feistel rounds on two halves of ``half`` bits."""
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in keys:
        left, right = right, left ^ (mix(right ^ k ^ tweak) & mask)
    return left, right


def permute(x: np.ndarray, domain: int, key: int, tweak: np.ndarray | int = 0) -> np.ndarray:
    """A permutation of 0 .. ``domain`` - 1 for each key and tweak: Feistel rounds on the next even number of bits, repeated while outside."""
    half = max(1, (max(domain - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    with np.errstate(over="ignore"):
        tweak = np.broadcast_to(mix(np.asarray(tweak, np.uint64) + np.uint64(1)), x.shape)
        out, open_ = x.astype(np.uint64).copy(), np.arange(len(x))
        while len(open_):
            left, right = _rounds(out[open_] >> shift, out[open_] & mask, half, key, tweak[open_])
            out[open_] = left << shift | right
            open_ = open_[out[open_] >= np.uint64(domain)]
    return out


def places(doc: np.ndarray, part: np.ndarray, n_docs: int, n_parts: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of the pairs below (``n_docs``, ``n_parts``), which may be more than 2**64: the new pairs.

    Both numbers make one of up to 127 bits, in two halves; cycle-walking ends in a pair that is below both.
    """
    low = max(1, (n_docs - 1).bit_length())
    half = max(1, (low + max(1, (n_parts - 1).bit_length()) + 1) // 2)
    u, mask = np.uint64, np.uint64((1 << half) - 1)
    doc, part = doc.astype(np.uint64), part.astype(np.uint64)
    out_doc, out_part, open_ = doc.copy(), part.copy(), np.arange(len(doc))
    with np.errstate(over="ignore"):
        while len(open_):
            d, p = out_doc[open_], out_part[open_]
            if low >= half:  # the high half has the number's upper bits and the part
                left, right = d >> u(half) if half < 64 else np.zeros_like(d), d & mask
                left = left | p << u(low - half)
            else:
                left, right = p >> u(half - low), d | (p & u((1 << (half - low)) - 1)) << u(low)
            left, right = _rounds(left, right, half, key)
            if low >= half:
                rest = u((1 << (low - half)) - 1)
                d = right | ((left & rest) << u(half) if half < 64 else u(0))
                p = left >> u(low - half)
            else:
                d, p = right & u((1 << low) - 1), right >> u(low) | left << u(half - low)
            out_doc[open_], out_part[open_] = d, p
            outside = p >= u(n_parts)
            if n_docs < 1 << 64:
                outside |= d >= u(n_docs)
            open_ = open_[outside]
    return out_doc, out_part


@dataclass(frozen=True)
class Layout:
    """Where shards are and how their records look."""

    path: str
    seq_len: int
    end_id: int
    wide: bool  # 4 bytes an id instead of 2

    @property
    def stride(self) -> int:
        """Bytes of a record: head, ids, and the line end that Spark's text writer adds."""
        return HEAD.itemsize + self.seq_len * (4 if self.wide else 2) + 1

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<u4" if self.wide else "<u2")


def _records(docs: list[int | None], tokens: list[np.ndarray], layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the sequences of some documents: their document's number in the lists, their number in it, and their bytes by row."""
    n = np.array([len(t) // layout.seq_len + 1 for t in tokens], np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ids = np.full(int(n.sum()) * layout.seq_len, layout.end_id, layout.dtype)
    for at, t in zip((np.cumsum(n) - n) * layout.seq_len, tokens):
        ids[at : at + len(t)] = t
    head = np.zeros(len(owner), HEAD)
    head["doc_id"] = np.array([-1 if d is None else d for d in docs], np.int64)[owner]
    head["part"] = part
    head["n_tokens"] = np.minimum(layout.seq_len, np.array([len(t) for t in tokens], np.int64)[owner] + 1 - part * layout.seq_len)
    return owner, part, head, np.concatenate([head.view(np.uint8).reshape(len(head), -1), ids.view(np.uint8).reshape(len(head), -1)], 1)


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as an Arrow array."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _signed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers without sign as ones with sign, in the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 256, key: int = 2024, shard_bytes: int = 16 << 20, copies: int = 1) -> Layout:
    """Write the shards of ``docs`` below ``path``, a folder ``shard=k`` each.

    A document's ids end with ``end_id``, which also fills its last record.  Null and empty texts have no
    record.  Ids may be any 64-bit numbers.  Null ids take part as one more id and are written as -1.
    Rows that repeat an id have the same places; they get neighbouring slots, in the order of their bytes.
    For tables that repeat documents on purpose ``copies`` is how often at most: then the second record of
    a place goes to another shard, half of all shards away, and so on.  An empty table writes no shard.
    Other columns are ignored, whatever their names.  Files are written by Spark's committer: a lost
    executor's tasks are repeated and leave no half a shard.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = base.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum(F.octet_length("text")).alias("b"), F.max(F.octet_length("text")).alias("most")).first()
    lo, hi = seen["lo"] or 0, seen["hi"] or 0
    # a token has a byte at least; pairs with a null id have sequence numbers of their own
    n_docs, n_own = hi - lo + 1, (seen["most"] or 0) // seq_len + 1
    n_parts = 2 * n_own
    shards = max(1, -(-int((seen["b"] or 0) * 0.9) // shard_bytes))
    layout = Layout(path, seq_len, end_id, _n_ids(tokenizer_path) > 65536 or end_id > 65535)

    def handed(docs: list[int | None], tokens: list[np.ndarray]) -> pa.RecordBatch:
        owner, part, _, rows = _records(docs, tokens, layout)
        index = np.array([0 if d is None else d - lo for d in docs], np.uint64)[owner]
        null = np.array([d is None for d in docs])[owner]
        d, p = places(index, part + null * n_own, n_docs, n_parts, key)
        shard = np.minimum((p.astype(float) + d.astype(float) / n_docs) / n_parts * shards, shards - 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(_signed(p)), pa.array(_signed(d)), _binary(rows)], ["shard", "high", "low", "record"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(tokenizer_path)
        for batch in batches:
            docs, tokens, held = [], [], 0
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = encode(text.as_py(), tokenizer)
                docs.append(doc.as_py()), tokens.append(ids)
                held += (len(ids) // seq_len + 1) * layout.stride
                if held >= FLUSH:
                    yield handed(docs, tokens)
                    docs, tokens, held = [], [], 0
            if docs:
                yield handed(docs, tokens)

    order = ["shard", "high", "low", "record"]
    schema = "shard int, high bigint, low bigint, record binary"
    rows = small_batches(base.filter(F.length("text") > 0)).mapInArrow(run, schema)
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions(*order)
    if copies > 1:

        def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, k = None, 0
            for batch in batches:
                numbers = []
                for at in zip(batch.column("high").to_pylist(), batch.column("low").to_pylist()):
                    k = min(k + 1, copies - 1) if at == last else 0
                    last = at
                    numbers.append(k)
                n, shard = np.array(numbers, np.int64), batch.column("shard").to_numpy().astype(np.int64)
                new = (shard + n * -(-shards // copies)) % shards * copies + n
                yield pa.RecordBatch.from_arrays([pa.array(new.astype(np.int32)), *batch.columns[1:]], order)

        dealt = dealt.mapInArrow(apart, schema).sortWithinPartitions(*order)
    dealt.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").text(path)
    return layout


def _n_ids(tokenizer_path: str) -> int:
    return encoder(tokenizer_path).n_vocab


def shard_table(spark: SparkSession, layout: Layout) -> DataFrame:
    """One row a shard: ``shard, file, records, first_slot``; the window sees one row a shard."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(layout.path)
    rows = files.select(F.regexp_extract("path", "shard=(\\d+)", 1).cast("int").alias("shard"), F.col("path").alias("file"), (F.col("length") / layout.stride).cast("long").alias("records"))
    ahead = F.sum("records").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("first_slot", F.coalesce(ahead, F.lit(0)))


def read_slots(spark: SparkSession, layout: Layout, first: int = 0, count: int | None = None) -> DataFrame:
    """The records of slots ``first`` to ``first + count`` - 1 as ``slot, shard, byte_offset, doc_id, part, n_tokens, ids, sha256``.

    Only shards that hold one of the slots are read; within a shard reading starts at the slot's offset.
    """
    end = None if count is None else first + count
    table = shard_table(spark, layout)
    wanted = table.filter(F.col("first_slot") + F.col("records") > first)
    wanted = wanted if end is None else wanted.filter(F.col("first_slot") < end)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(layout.path)
    rows = files.select("path", "content").join(F.broadcast(wanted.withColumnRenamed("file", "path")), "path")
    schema = "slot bigint, shard int, byte_offset bigint, doc_id bigint, part int, n_tokens int, ids array<int>, sha256 string"
    kind = np.dtype([("head", HEAD), ("ids", layout.dtype, (layout.seq_len,)), ("end", "u1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, shard, at in zip(batch.column("content"), batch.column("shard").to_pylist(), batch.column("first_slot").to_pylist()):
                records = np.frombuffer(content.as_buffer(), kind)
                lo, hi = max(0, first - at), len(records) if end is None else min(len(records), end - at)
                for a in range(lo, hi, 4096):
                    r = records[a : min(a + 4096, hi)]
                    n = len(r)
                    ids = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * layout.seq_len), pa.array(r["ids"].reshape(-1).astype(np.int32)))
                    digest = [hashlib.sha256(x.tobytes()).hexdigest() for x in r["ids"]]
                    cols = [pa.array(np.arange(a, a + n) + at), pa.array([shard] * n, pa.int32()), pa.array(np.arange(a, a + n) * layout.stride), pa.array(r["head"]["doc_id"].copy()), pa.array(r["head"]["part"].copy()), pa.array(r["head"]["n_tokens"].copy()), ids, pa.array(digest)]
                    yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])

    return rows.select("content", "shard", "first_slot").mapInArrow(run, schema)


def token_manifest(docs: DataFrame, tokenizer_path: str, end_id: int = 50256, **kwargs) -> DataFrame:
    """Write ``docs`` as shards in the shared folder and read them back: one row a sequence, without the ids."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    layout = write_shards(docs, path, tokenizer_path, end_id, **kwargs)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = "slot bigint, shard int, byte_offset bigint, doc_id bigint, part int, n_tokens int, sha256 string"
    if not any("shard=" in s.getPath().getName() for s in fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs)):
        return spark.createDataFrame([], schema)
    return read_slots(spark, layout).drop("ids")
