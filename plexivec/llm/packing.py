"""Packing documents into sequences by minimum bin slack.

A document's token ids are cut into full windows and one remainder.  What windows to fill with which remainders
depends on their lengths alone, so it is decided from the counts of at most ``capacity`` lengths: the longest
remainder left opens a window, a subset-sum program over bitsets finds the multiset of lengths that comes
closest to filling it, and the counts say how often the same multiset can be taken.  Documents then find their
places by their rank among the remainders of their length; ranks are a number in the task plus a sum over the
tasks before, so texts are tokenised once and tokens do not move.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexivec.plans.batches import small_batches
from plexivec.plans.staging import staged

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Bytes of a text cut into words at once, and words whose ids a task remembers.
CUT = 1 << 20
REMEMBERED = 1_000_000
#: Bytes of ids that a task hands on at once.
FLUSH = 4 << 20
#: Sums of ranks (24 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 250_000

#: Visible ASCII and the letters of Latin-1 with marks, whose words the tokenizer's own pattern makes as follows; the
#: letters are normal forms as they are.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_SPECIAL = "<|"


@functools.lru_cache(maxsize=2)
def _tokenizers(path: str) -> tuple[Tokenizer, Tokenizer, np.ndarray]:
    """The tokenizer of a file, the same for words that are ready for its merges, and which ids end a word."""
    from tokenizers import Tokenizer, pre_tokenizers

    whole, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
    bare.normalizer, bare.pre_tokenizer = None, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    vocabulary = whole.get_vocab()
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
    return whole, bare, last


class WordIds:
    """Ids of texts by a tokenizer that never joins characters across white space; words met before are remembered."""

    def __init__(self, path: str, dtype: np.dtype):
        self.whole, self.bare, self.last = _tokenizers(path)
        self.dtype, self.known, self.pieces = dtype, {}, {}

    def _learn(self, words: set[bytes]) -> None:
        """Ids of words: common ones are cut here and new pieces merged in one call, others take the tokenizer's whole path."""
        cut, other = {}, []
        for word in words:
            text = word.decode()
            if _PLAIN.fullmatch(text) and _SPECIAL not in text:
                low = text.lower()
                cut[word] = [low] if low.isalpha() else _PIECE.findall(low)
            else:
                other.append(word)
        new = list({p for ps in cut.values() for p in ps}.difference(self.pieces))
        if new:
            ids = np.array(self.bare.encode_batch_fast([new], is_pretokenized=True, add_special_tokens=False)[0].ids, self.dtype)
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.last[ids]) + 1) * ids.itemsize).tolist()
            self.pieces.update((piece, raw[a:b]) for piece, a, b in zip(new, [0, *ends], ends, strict=False))
        get = self.pieces.__getitem__
        self.known.update((word, get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps))) for word, ps in cut.items())
        if other:
            for word, found in zip(other, self.whole.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)):
                self.known[word] = np.array(found.ids, self.dtype).tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty.  Texts are cut at ASCII white space, which no token crosses."""
        held, size = [], 0
        for text in texts:
            raw = (text or "").encode()
            if len(raw) > CUT:
                yield from self._ids(held)
                held, size = [], 0
                yield np.concatenate(list(self._long(raw)))
                continue
            held.append(raw.split())
            size += len(raw)
            if size >= CUT:
                yield from self._ids(held)
                held, size = [], 0
        yield from self._ids(held)

    def _long(self, raw: bytes) -> Iterator[np.ndarray]:
        at = 0
        while at < len(raw):
            found = re.compile(rb"\s").search(raw, at + CUT)
            end = found.start() if found else len(raw)
            yield next(self._ids([raw[at:end].split()]))
            at = end

    def _ids(self, texts: list[list[bytes]]) -> Iterator[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.pieces.clear()
        new = set().union(*texts).difference(self.known)
        if new:
            self._learn(new)
        for words in texts:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, words)), self.dtype)


@dataclass(frozen=True)
class Plan:
    """Where the remainders go.  Each row is a range of ranks among the remainders of one length.

    Item number ``first + rank - low`` of a row is in sequence ``base + number % times`` at ``offset + number //
    times * length``, with the ``length`` ids from ``start`` on.  ``layer`` counts the cuts of an item before it.
    """

    rows: np.ndarray
    n_sequences: int
    n_steps: int


ROW = np.dtype([(c, np.int64) for c in ("layer", "size", "low", "high", "start", "length", "base", "first", "times", "offset")])


def fill(counts: dict[int, int], target: int) -> tuple[dict[int, int], int]:
    """The multiset of lengths, with the longest in it, whose sum comes closest to ``target`` from below.

    Reachable sums are the bits of a number; each length enters with as many copies as are there, in powers of
    two; the way back over the numbers before each addition tells the copies.
    """
    lengths = sorted((n for n, k in counts.items() if k and n <= target), reverse=True)
    room = target - lengths[0]
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        copies = min(counts[n] - (n == lengths[0]), room // n)
        power = 1
        while copies > 0 and not bits >> room & 1:
            some = min(power, copies)
            more = bits | bits << n * some & mask
            if more != bits:
                steps.append((bits, n, some))
                bits = more
            copies -= some
            power *= 2
        if bits >> room & 1:
            break
    reached = left = bits.bit_length() - 1
    used: dict[int, int] = defaultdict(int, {lengths[0]: 1})
    for before, n, some in reversed(steps):
        if not before >> left & 1:
            used[n] += some
            left -= n * some
    return dict(used), reached + lengths[0]


def plan_windows(counts: dict[int, int], capacity: int) -> Plan:
    """Fill windows of ``capacity`` ids with remainders, given the number of remainders of every length.

    A window that no multiset fills is closed with the head of one more remainder, whose tail goes back.  What is
    left below one capacity fills windows of powers of two, which need no padding, the largest first.  The work and
    the rows depend on the lengths, not on the number of documents, as equal windows are taken at once.
    """
    pool = {n: deque([(0, n, 0, k, 0)]) for n, k in counts.items() if k}  # layer, size, low, high, start
    counts = {n: k for n, k in counts.items() if k}
    total, base, n_steps, rows = sum(n * k for n, k in counts.items()), 0, 0, []

    def take(n: int, k: int) -> Iterator[tuple[int, ...]]:
        counts[n] -= k
        while k:
            layer, size, low, high, start = pool[n].popleft()
            some = min(k, high - low)
            if some < high - low:
                pool[n].appendleft((layer, size, low + some, high, start))
            yield layer, size, low, low + some, start
            k -= some

    while total:
        target = capacity if total >= capacity else 1 << total.bit_length() - 1
        if any(k and n <= target for n, k in counts.items()):
            used, reached = fill(counts, target)
        else:
            used, reached = {}, 0
        gap, cut = target - reached, 0
        if gap:
            cut = max(n for n, k in counts.items() if k > used.get(n, 0))
        times = min(counts[n] // (used.get(n, 0) + (n == cut)) for n in {*used, *([cut] if cut else [])})
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            first = 0
            for layer, size, low, high, start in take(n, k * times):
                rows.append((layer, size, low, high, start, n, base, first, times, offset))
                first += high - low
            offset += n * k
        if cut:
            first, rest = 0, cut - gap
            for layer, size, low, high, start in take(cut, times):
                rows.append((layer, size, low, high, start, gap, base, first, times, offset))
                first += high - low
                pool.setdefault(rest, deque()).append((layer + 1, size, low, high, start + gap))
                counts[rest] = counts.get(rest, 0) + high - low
        counts = {n: k for n, k in counts.items() if k}
        total -= target * times
        base, n_steps = base + times, n_steps + 1
    return Plan(np.sort(np.array(rows, ROW), order=["layer", "size", "low"]), base, n_steps)


def _pieces(plan: Plan, size: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each layer of cuts: the items that have a piece there, and the piece's row in the plan."""
    order = lambda a, b: (a << np.int64(48)) + b
    for layer in np.unique(plan.rows["layer"]):
        rows = plan.rows[plan.rows["layer"] == layer]
        at = np.searchsorted(order(rows["size"], rows["low"]), order(size, rank), "right") - 1
        row = rows[np.maximum(at, 0)]
        there = np.flatnonzero((at >= 0) & (row["size"] == size) & (rank < row["high"]))
        yield there, row[there]


@functools.lru_cache(maxsize=1)
def word_ids(path: str, wide: bool) -> WordIds:
    """The words that a Python worker knows, kept from task to task."""
    return WordIds(path, np.dtype("<u4" if wide else "<u2"))


ITEM = "part int, nth bigint, size int, doc_id bigint, start bigint, doc_tokens bigint, ids binary"
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def token_items(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Full windows and remainders of all documents, one row each, with the task and the number among its items of that size."""
    from tokenizers import Tokenizer

    wide = max(end_id, Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1) > 65535
    dtype = np.dtype("<u4" if wide else "<u2")
    names = [c.split()[0] for c in ITEM.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_ids(tokenizer_path, wide), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        rows, held = [], 0

        def handed() -> pa.RecordBatch:
            cols = list(zip(*rows))
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, dtype.type(end_id))
                for start in range(0, len(ids), capacity):
                    some = ids[start : start + capacity]
                    rows.append((part, seen[len(some)], len(some), doc, start, len(ids), some.tobytes()))
                    seen[len(some)] += 1
                    held += some.nbytes + 64
                    if held >= FLUSH:
                        yield handed()
                        rows, held = [], 0
        if rows:
            yield handed()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return small_batches(base).mapInArrow(run, ITEM)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``capacity`` ids, with their ids in bytes.

    One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.  ``ids`` are
    little-endian numbers of 2 bytes (4 if the tokenizer has more than 65,536 ids); the checksum is over 4 bytes
    an id.  Every sequence is full or holds a power of two of ids, so none needs padding.

    A null or empty text is a document of its end id; rows that repeat a document, whatever their number, and
    null ids are documents of their own; an empty table has no pieces; other columns are ignored, whatever their
    names.  A text of any length is tokenised whole, in cuts at white space.  The tokenizer must keep words apart
    at white space and drop it, as ``word_bpe_49k.json`` does.
    """
    spark = docs.sparkSession
    items = staged(token_items(docs, tokenizer_path, capacity, end_id, id_col, text_col), "items")
    per_task = staged(items.groupBy("part", "size").agg(F.count("*").alias("n")), "per_task")
    # at most `capacity` rows, whatever the data
    counts = {r["size"]: r["n"] for r in per_task.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    plan = plan_windows(counts, capacity)
    before = W.partitionBy("size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ahead = per_task.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    few = per_task.count() <= BROADCAST_ROWS
    ranked = items.join(F.broadcast(ahead) if few else ahead, ["part", "size"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    names = [c.split()[0] for c in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank, start = (batch.column(c).to_numpy().astype(np.int64) for c in ("size", "rank", "start"))
            for there, row in _pieces(plan, size, rank):
                if not len(there):
                    continue
                number = row["first"] + rank[there] - row["low"]
                raw, sums = [], []
                for i, a, n in zip(there.tolist(), row["start"].tolist(), row["length"].tolist()):
                    whole = batch.column("ids")[i].as_buffer()
                    ids = np.frombuffer(whole, "<u2" if whole.size == 2 * size[i] else "<u4")[a : a + n]
                    raw.append(ids.tobytes())
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                taken = batch.take(pa.array(there))
                cols = [taken.column("doc_id"), pa.array(start[there] + row["start"]), pa.array(row["length"].copy()), pa.array(sums, pa.int64()), taken.column("doc_tokens"), pa.array(row["base"] + number % row["times"]), pa.array(row["offset"] + number // row["times"] * row["length"]), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return small_batches(ranked.select("size", "rank", "doc_id", "start", "doc_tokens", "ids")).mapInArrow(run, PIECE) if counts else spark.createDataFrame([], PIECE)


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids, doc_ids``: the ids of whole sequences in bytes, and the documents in them in order.

    A sequence holds at most the capacity, so its group is bounded.
    """
    own = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    rows = pieces.groupBy("sequence_id").agg(own.alias("_p"))
    joined = F.aggregate("_p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    total = F.aggregate("_p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return rows.select("sequence_id", total.alias("n_tokens"), joined.alias("ids"), F.col("_p.doc_id").alias("doc_ids"))
