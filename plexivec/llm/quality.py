"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every whole text.  Expectation-maximisation
over the counts of vote patterns (of all documents) estimates how often each labeller votes what on good
and on bad texts, and so the probability that a text with a given pattern is good.  With these posterior
labels a linear scorer on hashed features is fitted, which needs no labeller any more.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from plexivec.llm.charhash import SPAN, code_points, trigram_buckets, trigram_codes
from plexivec.llm.wordhash import _power, blocks, mix, text_bytes, words
from plexivec.plans.batches import small_batches
from plexivec.plans.staging import staged

#: Feature buckets: 2 ** BITS.
BITS = 11
#: Documents, about, on which the scorer is fitted; they are drawn by a hash of id and text.
TRAIN_DOCS = 4000
EM_ROUNDS = 200
#: Marks that running text hardly has, marks that come in runs, and marks after which a word may well end.
MARKS, RUNS, ENDS = "#$%&*|<>{}=~^_/\\", "#$%&*!=~|", ".,;:?)\"'"
LABELLERS = ("blank", "marks", "marked_words", "mark_runs", "word_ends", "capitals", "stutter", "repeated_sentences", "vocabulary", "cries", "line_ends")
#: Code points judged at once, about: texts in blocks, longer ones alone.  A task needs some 100 bytes for each.
BLOCK = 1 << 17
#: Training rows, of ``2 ** BITS`` features each, handed on at once.
ROWS = 256
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """For every code point a bit each: capital letter, letter or digit."""
    if not _kinds:
        cats = (unicodedata.category(chr(i)) for i in range(0x110000))
        _kinds.append(np.fromiter(((c == "Lu") | (c[0] in "LN") << 1 for c in cats), np.uint8, 0x110000))
    return _kinds[0]


def _in(c: np.ndarray, chars: str) -> np.ndarray:
    table = np.zeros(128, bool)
    table[[ord(x) for x in chars]] = True
    return table[np.minimum(c, 127)] & (c < 127)


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``, which end with their text."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of code points: differences of one running sum."""
    up, down = _power(len(c) + 1)
    total = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(mix(c.astype(np.uint64) + np.uint64(1)) * up[: len(c)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes every owner has."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return np.bincount(o[new], minlength=n)


def label_votes(texts: list[str]) -> np.ndarray:
    """Votes of all labellers on each text, 1 good, -1 bad, 0 none; all texts at once as one array of code points.

    blank: no word.  marks: share of ``MARKS``; marked_words: of words with one; mark_runs: pairs of equal
    ``RUNS`` and bars between blanks, for each word; word_ends: words that end with a mark not of ``ENDS``;
    capitals: share of capitals; stutter: words equal to the one before; repeated_sentences: share of
    distinct sentences; vocabulary: of distinct words; cries: exclamation marks for each word; line_ends:
    share of lines that end like a sentence.  Words are runs of other characters than space and \\x09 to
    \\x0D, sentences runs without ``.``, ``!``, ``?`` and line ends, from their first character that is not blank.
    """
    n_texts = len(texts)
    c = code_points("".join(texts))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    owner = lambda at: np.searchsorted(offsets, at, "right") - 1
    per = lambda at: np.bincount(owner(at), minlength=n_texts)
    chars = np.maximum(np.diff(offsets), 1)
    with np.errstate(over="ignore"):
        blank = (c == 32) | ((c >= 9) & (c <= 13))
        mark = _in(c, MARKS)
        begin, end = _runs(~blank, offsets)
        words = per(begin)
        n = np.maximum(words, 1)
        enough = n >= 8
        seen = np.concatenate([[0], np.cumsum(mark)])
        marked = per(begin[seen[end] > seen[begin]])
        same_next = np.zeros(len(c), bool)
        same_next[:-1] = (c[1:] == c[:-1]) & _in(c[:-1], RUNS)
        same_next[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] <= len(c))] - 1] = False
        a, b = _runs(same_next, offsets)
        pairs = np.bincount(owner(a), (b - a + 1) // 2, n_texts) if len(a) else np.zeros(n_texts)
        bar = begin[(end - begin == 1) & (c[begin] == ord("|"))]
        bar = bar[(bar > 0) & (bar < len(c) - 1)]
        bar = bar[(c[bar - 1] == 32) & (c[bar + 1] == 32)]
        runs = (pairs + per(bar)) / n
        del same_next
        closed = end[(end < len(c))]
        closed = closed[~np.isin(closed, offsets)]  # a word at the end of its text has no blank after it
        z = c[closed - 1]
        odd = per(closed[~((kinds()[z] & 2) > 0) & ~_in(z, ENDS)] - 1)
        hashes = _hashes(c, begin, end)
        of = owner(begin)
        stutter = np.bincount(of[1:][(of[1:] == of[:-1]) & (hashes[1:] == hashes[:-1])], minlength=n_texts)
        a, b = _runs(~(_in(c, ".!?") | (c == 10)), offsets)
        filled = np.flatnonzero(~blank)
        k = np.searchsorted(filled, a)
        a, b, k = a[k < len(filled)], b[k < len(filled)], k[k < len(filled)]
        first = filled[k]
        a, b = first[first < b], b[first < b]
        sentences = np.maximum(per(a), 1)
        distinct = _distinct(owner(a), _hashes(c, a, b), n_texts) / sentences
        a, b = _runs(c != 10, offsets)
        lines = np.maximum(per(a), 1)
        solid = np.flatnonzero(~blank | (c == 10))  # the last character of a line that is not blank is the one before its end
        tail = solid[np.maximum(np.searchsorted(solid, b) - 1, 0)] if len(solid) else a - 1
        ended = per(a[(tail >= a) & _in(c[np.maximum(tail, 0)], ".!?:")]) / lines
        rates = {
            "marks": (per(np.flatnonzero(mark)) / chars, 0.03, 0.005, True),
            "marked_words": (marked / n, 0.2, 0.05, enough),
            "mark_runs": (runs, 0.15, 0.03, enough),
            "word_ends": (odd / n, 0.2, 0.08, enough),
            "capitals": (per(np.flatnonzero(kinds()[c] & 1)) / chars, 0.3, 0.1, enough),
            "stutter": (stutter / n, 0.25, 0.1, enough),
            "cries": (per(np.flatnonzero(c == 33)) / n, 0.3, 0.05, enough),
            "repeated_sentences": (1 - distinct, 0.5, 0.1, sentences >= 4),
            "vocabulary": (1 - _distinct(of, hashes, n_texts) / n, 0.75, 0.55, n >= 30),
            "line_ends": (1 - ended, 0.7, 0.3, enough),
        }
    out = {"blank": np.where(words == 0, -1, 0)}
    for name, (rate, bad, good, sure) in rates.items():
        out[name] = np.where((rate > bad) & sure, -1, np.where(rate < good, 1, 0))
    return np.stack([out[name] for name in LABELLERS], 1).astype(np.int32)


def _blocks(texts: pa.Array) -> Iterator[list[str]]:
    """Texts of about ``BLOCK`` bytes together, or one text; a null text is empty."""
    _, offsets = text_bytes(texts)
    for i, j in blocks(offsets, BLOCK):
        yield [t or "" for t in texts.slice(i, j - i).to_pylist()]


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])), pa.array(rows.ravel()))


@F.arrow_udf(ArrayType(IntegerType()))
def _voted(texts: pa.Array) -> pa.Array:
    return _lists(np.concatenate([np.zeros((0, len(LABELLERS)), np.int32), *map(label_votes, _blocks(texts))]))


def with_votes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``votes``: all labellers' on the text (1 good, -1 bad, 0 none); a null text is empty."""
    return small_batches(docs).withColumn("votes", _voted(F.col(text_col)))


def vote_patterns(docs: DataFrame, text_col: str = "text") -> pd.DataFrame:
    """Distinct vote patterns with their number of documents: at most 3 ** labellers rows, whatever the corpus."""
    return with_votes(docs.select(text_col), text_col).groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").toPandas()


def posterior(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Probability that texts with each pattern are good, by EM for independent labellers.

    Starts from "bad if any labeller says so", which also fixes which class is which.
    """
    hits = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    good = np.where((patterns == -1).any(1), 0.1, 0.9)
    n = counts.astype(float)
    for _ in range(rounds):
        logs = []
        for q in (good, 1 - good):
            w = q * n
            rate = (np.einsum("i,ijv->jv", w, hits) + 0.01) / (w.sum() + 0.03)
            logs.append(np.log((w.sum() + 0.01) / (n.sum() + 0.02)) + np.einsum("ijv,jv->i", hits, np.log(rate)))
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return good


def _shape(c: np.ndarray) -> np.ndarray:
    """Classes of code points: blank, line end, lower case, capital, digit, and every other ASCII mark for itself."""
    out = np.full(len(c), 1, np.uint64)
    ascii_ = c < 128
    out[ascii_] = _SHAPES[c[ascii_]]
    return out


def _shape_codes(points: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams of character classes."""
    c = _shape(points)
    return ((c[:-2] * np.uint64(997) + c[1:-1]) * np.uint64(991) + c[2:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)


_SHAPES = np.array([1 if chr(i).islower() else 2 if chr(i).isupper() else 3 if chr(i).isdigit() else 4 + i for i in range(128)], np.uint64)


def features(text: str | None) -> Iterator[tuple[np.ndarray, float]]:
    """Hashed buckets with the value of each occurrence, so that every family of features sums to at most 1.

    Families: character trigrams, trigrams of character classes, and of words: equal to the one before,
    seen before in the text.
    """
    t = text or ""
    n = max(len(t), 1)
    with np.errstate(over="ignore"):
        for b in trigram_buckets(t, BITS):
            yield b, 1 / n
        for at in range(0, len(t), SPAN):
            yield _shape_codes(code_points(t[at : at + SPAN + 2])), 1 / n
        h, _, _, _ = words(*text_bytes(pa.array([t])))
        if len(h) > 1:
            same = int((h[1:] == h[:-1]).sum())
            again = len(h) - len(np.unique(h))
            yield np.full(same, 0, np.uint64), 1 / len(h)
            yield np.full(again, 1, np.uint64), 1 / len(h)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes on each text and its hashed features, by one Python worker for both."""
    for batch in batches:
        for texts in _blocks(batch.column("text")):
            for at in range(0, len(texts), ROWS):
                part = texts[at : at + ROWS]
                x = np.zeros((len(part), 1 << BITS), np.float32)
                for row, t in zip(x, part):
                    for b, v in features(t):
                        row += np.bincount(b.astype(np.int64), minlength=1 << BITS).astype(np.float32) * v
                yield pa.RecordBatch.from_arrays([_lists(label_votes(part)), _lists(x)], ["votes", "x"])


@dataclass(frozen=True)
class Scorer:
    """Logistic scorer on the hashed features."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        """Probability that a text is good; 0 for a null or blank one."""
        return float(self.scores([text])[0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of several texts: the sum of the weights of ``features``, for short texts in one pass over all of them."""
        out, short, size = np.zeros(len(texts)), [], 0
        for i, t in enumerate(texts):
            if not (t or "").strip():
                continue
            if len(t) > BLOCK:
                out[i] = sum(float(self.weights[b].sum()) * v for b, v in features(t))
                continue
            short.append(i)
            size += len(t)
            if size > BLOCK:
                out[short] = self._together([texts[k] for k in short])
                short, size = [], 0
        if short:
            out[short] = self._together([texts[k] for k in short])
        some = np.array([bool((t or "").strip()) for t in texts], bool)
        return np.where(some, 1 / (1 + np.exp(-np.clip(out + self.intercept, -500, 500))), 0.0)

    def _together(self, texts: list[str]) -> np.ndarray:
        c = code_points("".join(f" {t} " for t in texts))
        n = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(n + 2)[:-1]])
        with np.errstate(over="ignore"):
            grams = self.weights[trigram_codes(c, BITS)]
            shapes = self.weights[_shape_codes(c)]
            total = lambda w, a, m: (lambda s: s[a + m] - s[a])(np.concatenate([[0.0], np.cumsum(w)]))
            z = total(grams, starts, n) + total(shapes, starts + 1, np.maximum(n - 2, 0))
            h, _, _, first = words(*text_bytes(pa.array(texts)))
        z = z / np.maximum(n, 1)
        of, m = np.repeat(np.arange(len(texts)), np.diff(first)), np.diff(first)
        same = np.bincount(of[1:][(of[1:] == of[:-1]) & (h[1:] == h[:-1])], minlength=len(texts))
        again = m - _distinct(of, h, len(texts))
        return z + np.where(m > 1, (same * self.weights[0] + again * self.weights[1]) / np.maximum(m, 1), 0.0)


def fit_scorer(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Scorer:
    """EM over the votes on all of ``docs``, then the scorer on about ``train_docs`` of them.

    Documents are drawn by a hash of id and text, so that of many copies of a text only a share is drawn;
    rows that repeat both are one.  A null or empty text is a document like any other, with the vote of
    ``blank``; very long texts are read whole.  An empty table, and one on which all posteriors agree,
    gives a scorer that says 0.5.  Other columns are ignored, whatever their names.
    """
    found = vote_patterns(docs, text_col)
    if not len(found):
        return Scorer(np.zeros(1 << BITS), 0.0)
    good = posterior(np.array(found["votes"].tolist()), found["n"].to_numpy())
    spark = docs.sparkSession
    # Arrow tables reach the JVM as they are; rows of pandas would go through Python workers of a second pool
    label = spark.createDataFrame(pa.table({"votes": pa.array(found["votes"].map(list).tolist(), pa.list_(pa.int32())), "good": pa.array(good)}))
    share = min(1.0, train_docs / found["n"].sum())
    one = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.lit("quality"), F.col(id_col), F.col(text_col)).alias("draw"))
    drawn = one.filter(F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("draw").agg(F.first("text").alias("text"))
    train = staged(small_batches(drawn.select("text")).mapInArrow(_training_rows, "votes array<int>, x array<float>").join(F.broadcast(label), "votes").select("x", "good"), "quality")
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("good").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("good")).alias("weight"))))
    rows = train.select(array_to_vector(F.col("x")).alias("features"), both.alias("y")).select("features", "y.*").filter("weight > 1e-4")
    if rows.select("label").distinct().count() < 2:
        return Scorer(np.zeros(1 << BITS), 0.0)
    model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=60).fit(rows)
    return Scorer(model.coefficients.toArray(), float(model.intercept))


def score_quality(docs: DataFrame, scorer: Scorer, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``quality`` (0 to 1) and ``kept`` (``quality`` of ``least`` or more), from the whole text.

    Null and blank texts have quality 0 and are not kept.  If all documents look alike to the labellers,
    nothing can be learned and every other text has quality 0.5 and is kept.  Columns of these names are
    replaced; equal texts have equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *map(shared.value.scores, _blocks(texts))]))

    return small_batches(docs).withColumn("quality", scored(F.col(text_col))).withColumn("kept", F.col("quality") >= least)
