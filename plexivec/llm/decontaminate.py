"""Finding benchmark items in training texts: BM25 over an inverted index of the items, with block-max WAND.

Every passage of every document (windows of words that overlap by half) is a query against the items.
BM25 impacts are divided by the score an item gets from its own text, so that one threshold holds for
items of any length.  The bounds that skip work, without changing what is retrieved:

* terms whose impacts can never bring any item to the threshold on their own, common words, are not
  essential: a passage without essential terms is skipped at once (MaxScore's form of the WAND pivot);
* items are grouped in blocks, and each term has its largest impact in every block: only blocks whose
  sum of largest impacts can reach the threshold are opened and scored exactly.

An item retrieved is verified: enough of the word n-grams of its question and of its answer (its last
sentence) occur in the document's words around the passage.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexivec.llm.wordhash import blocks, shingles, text_bytes, words
from plexivec.plans.batches import small_batches

K1, B = 1.2, 0.75
#: Items in a block of the index.
BLOCK_ITEMS = 8
#: Items in one index; more are searched in several passes.  With MAX_ITEM_WORDS this bounds what is broadcast.
MAX_ITEMS = 20000
MAX_INDEX_BYTES = 64 << 20
#: Share of an item's own score from which it is retrieved.
LEAST_SCORE = 0.5
#: Words of an n-gram, and shares of the question's and the answer's n-grams that must occur.
N_WORDS = 5
LEAST_OVERLAP = 0.5


def question_and_answer(text: str) -> tuple[str, str]:
    """The text up to its last sentence, and the last sentence; with one sentence both are the text."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def _words(text: str) -> np.ndarray:
    return words(*text_bytes(pa.array([text])))[0]


def _grams(hashes: np.ndarray, n_words: int) -> tuple[int, np.ndarray]:
    """The size of the n-grams, less than ``n_words`` for a text of fewer words, and their set."""
    n = max(1, min(n_words, len(hashes)))
    return n, np.unique(shingles(hashes, n))


def _overlap(grams: tuple[int, np.ndarray], hashes: np.ndarray) -> float:
    """Share of the n-grams that occur in a run of words."""
    n, own = grams
    return float(np.isin(own, shingles(hashes, n)).mean()) if len(own) and len(hashes) >= n else 0.0


@dataclass(frozen=True)
class Index:
    """Inverted index of some items."""

    item_ids: list
    lengths: np.ndarray  # words of an item
    terms: np.ndarray  # sorted word hashes
    essential: np.ndarray  # whether a term is
    starts: np.ndarray  # postings of term i: starts[i] to starts[i + 1]
    items: np.ndarray
    impacts: np.ndarray
    block_starts: np.ndarray  # block maxima of term i
    block_ids: np.ndarray
    block_max: np.ndarray
    common_bound: np.ndarray  # for a block, the most its items can get from terms that are not essential
    common: np.ndarray  # the same for an item
    questions: list[tuple[int, np.ndarray]]
    answers: list[tuple[int, np.ndarray]]
    width: int  # words of a passage


def build_index(item_ids: list, texts: list[str | None], least_score: float = LEAST_SCORE, n_words: int = N_WORDS) -> Index:
    """The index of the items; items without words are never retrieved."""
    with np.errstate(over="ignore"):
        tokens = [_words(t or "") for t in texts]
        sets = [[_grams(_words(p), n_words) for p in question_and_answer(t or "")] for t in texts]
    n = len(tokens)
    lengths = np.array([len(t) for t in tokens], np.int64)
    pairs = [np.unique(t, return_counts=True) for t in tokens]
    all_terms = np.concatenate([p[0] for p in pairs]) if n else np.zeros(0, np.uint64)
    items = np.repeat(np.arange(n), [len(p[0]) for p in pairs])
    tf = np.concatenate([p[1] for p in pairs]).astype(float) if n else np.zeros(0)
    terms, at, df = np.unique(all_terms, return_inverse=True, return_counts=True)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    mean = lengths[lengths > 0].mean() if (lengths > 0).any() else 1.0
    impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[items] / mean))
    impact /= np.maximum(np.bincount(items, impact, n), 1e-12)[items]

    # Terms from the most frequent on are not essential, as long as no item reaches the threshold by them alone.
    by_df = np.argsort(-df, kind="stable")
    order = np.empty(len(terms), np.int64)
    order[by_df] = np.arange(len(terms))
    by_item = np.lexsort((order[at], items))
    sums = np.cumsum(impact[by_item])
    base = np.concatenate([[0.0], sums])[np.searchsorted(items[by_item], np.arange(n))] if n else np.zeros(0)
    reach = sums - base[items[by_item]] if n else sums
    too_far = order[at][by_item][reach >= 0.8 * least_score]
    cut = int(too_far.min()) if len(too_far) else len(terms)
    essential = order >= cut

    common = np.bincount(items, impact * ~essential[at], n)
    n_blocks = -(-n // BLOCK_ITEMS)
    bound = np.zeros(n_blocks)
    np.maximum.at(bound, np.arange(n) // BLOCK_ITEMS, common)
    by_term = np.lexsort((items, at))
    t, i, w = at[by_term], items[by_term], impact[by_term]
    starts = np.searchsorted(t, np.arange(len(terms) + 1))
    key, first = np.unique(t * max(n_blocks, 1) + i // BLOCK_ITEMS, return_index=True)
    block_max = np.maximum.reduceat(w, first) if len(first) else np.zeros(0)
    block_starts = np.searchsorted(key // max(n_blocks, 1), np.arange(len(terms) + 1))
    width = max(64, 2 * int(lengths.max(initial=0)))
    return Index(list(item_ids), lengths, terms, essential, starts, i, w, block_starts, key % max(n_blocks, 1), block_max, bound, common, [s[0] for s in sets], [s[1] for s in sets], width)


def _ranges(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all postings of the terms ``which``, and for each the number of its term in ``which``."""
    n = starts[which + 1] - starts[which]
    owner = np.repeat(np.arange(len(which)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[which], n), owner


def search(index: Index, hashes: np.ndarray, docs: np.ndarray, least_score: float = LEAST_SCORE) -> list[tuple[int, int, int, float]]:
    """``(document, passage start, item, score)`` of all passages and items that reach the threshold.

    ``hashes`` are the words of several documents, ``docs`` the number of each word's document.
    """
    if not len(index.terms) or not len(hashes):
        return []
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    term = np.where(index.terms[at] == hashes, at, -1)
    hits = np.flatnonzero((term >= 0) & index.essential[np.maximum(term, 0)])
    if not len(hits):
        return []
    half = index.width // 2
    first = np.searchsorted(docs, np.arange(docs[-1] + 2))
    place = hits - first[docs[hits]]
    window = np.concatenate([place // half, place // half - 1])
    word = np.concatenate([hits, hits])[window >= 0]
    window = window[window >= 0]
    # every passage with an essential term: (document, window), distinct (passage, term)
    many = int(window.max()) + 1
    passage, of = np.unique(docs[word] * many + window, return_inverse=True)
    pair = np.unique(of * len(index.terms) + term[word])
    of, t = pair // len(index.terms), pair % len(index.terms)
    pos, owner = _ranges(index.block_starts, t)
    n_blocks = len(index.common_bound)
    cell, where = np.unique(of[owner] * n_blocks + index.block_ids[pos], return_inverse=True)
    upper = np.bincount(where, index.block_max[pos], len(cell)) + index.common_bound[cell % n_blocks]
    cell = cell[upper >= least_score - 1e-9]
    # the postings of opened blocks: exact sums of essential terms, with each item's own bound for the rest
    n_items = len(index.lengths)
    open_ = np.zeros(len(passage), bool)
    open_[cell // n_blocks] = True
    of, t = of[open_[of]], t[open_[of]]
    pos, owner = _ranges(index.starts, t)
    inside = np.isin(of[owner] * n_blocks + index.items[pos] // BLOCK_ITEMS, cell)
    pos, owner = pos[inside], owner[inside]
    pair, where = np.unique(of[owner] * n_items + index.items[pos], return_inverse=True)
    sums = np.bincount(where, index.impacts[pos], len(pair))
    pair = pair[sums + index.common[pair % n_items] >= least_score - 1e-9]
    out = []
    for p in np.unique(pair // n_items):
        doc, w = int(passage[p] // many), int(passage[p] % many)
        a = int(first[doc]) + w * half
        found = np.unique(term[a : min(a + index.width, int(first[doc + 1]))])
        pos, _ = _ranges(index.starts, found[found >= 0])
        score = np.bincount(index.items[pos], index.impacts[pos], n_items)
        out += [(doc, a, int(i), float(score[i])) for i in pair[pair // n_items == p] % n_items if score[i] >= least_score - 1e-9]
    return out


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP, n_words: int = N_WORDS) -> DataFrame:
    """One row for each document and item it contains: ``doc_id, text_hash, item_id, score, question_overlap, answer_overlap``.

    The score and overlaps are those of the document's best passage for the item.  All words of all
    documents are read.  Null or blank texts and items match nothing; rows that repeat an id and a text
    give equal rows; without items the result is empty.  The item table is read in parts of at most
    ``MAX_ITEMS`` items and ``MAX_INDEX_BYTES`` of text, and the documents once for each part.  Other
    columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, text_hash bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    found = []
    for shared in _indexes(items, item_col, item_text_col, least_score, n_words):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                with np.errstate(over="ignore"):
                    yield _found(batch, shared.value, least_score, least_overlap, schema)

        found.append(small_batches(base).mapInArrow(run, schema))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _indexes(items: DataFrame, item_col: str, item_text_col: str, least_score: float, n_words: int) -> list[Broadcast]:
    """The items as broadcast indexes of bounded size."""
    wanted = items.filter(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    share = max(size["n"] / MAX_ITEMS, size["b"] / MAX_INDEX_BYTES)
    parts = 1 if share <= 1 else math.ceil(1.25 * share)
    out = []
    for part in range(parts):
        rows = wanted.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        index = build_index([r["item_id"] for r in rows], [r["text"] for r in rows], least_score, n_words)
        out.append(items.sparkSession.sparkContext.broadcast(index))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP, n_words: int = N_WORDS) -> DataFrame:
    """The rows of ``docs`` without any item, as ``find_items`` finds them, in one pass and without a shuffle."""
    schema = "doc_id bigint, text_hash bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    for shared in _indexes(items, item_col, item_text_col, least_score, n_words):
        docs = small_batches(docs).filter(_clean(shared, least_score, least_overlap, schema)(F.col(text_col)))
    return docs


def _clean(shared: Broadcast, least_score: float, least_overlap: float, schema: str):
    """A function of texts: whether they are without any item of one index."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        at = pa.array(range(len(texts)), pa.int64())
        batch = pa.RecordBatch.from_arrays([at, at, texts], ["doc_id", "text_hash", "text"])
        with np.errstate(over="ignore"):
            hit = set(_found(batch, shared.value, least_score, least_overlap, schema).column("doc_id").to_pylist())
        return pa.array([i not in hit for i in range(len(texts))], pa.bool_())

    return clean


def _found(batch: pa.RecordBatch, index: Index, least_score: float, least_overlap: float, schema: str) -> pa.RecordBatch:
    raw, offsets = text_bytes(batch.column("text"))
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for i, j in blocks(offsets):
        h, _, _, first = words(raw, offsets[i : j + 1])
        docs = np.repeat(np.arange(j - i), np.diff(first))
        for doc, a, item, score in search(index, h, docs, least_score):
            # a passage may cut an item in two: the words of an item's length around it are compared too
            near = index.lengths[item]
            lo, hi = max(int(first[doc]), a - int(near)), min(int(first[doc + 1]), a + index.width + int(near))
            q, r = _overlap(index.questions[item], h[lo:hi]), _overlap(index.answers[item], h[lo:hi])
            if q >= least_overlap and r >= least_overlap:
                key = (i + doc, item)
                best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, q, r))
    at = [d for d, _ in best]
    ids, hashes = batch.column("doc_id").take(pa.array(at, pa.int64())), batch.column("text_hash").take(pa.array(at, pa.int64()))
    cols = [ids, hashes, pa.array([index.item_ids[i] for _, i in best], pa.int64())] + [pa.array([v[k] for v in best.values()], pa.float64()) for k in range(3)]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])
