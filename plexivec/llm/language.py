"""Language identification by rank-order profiles of character n-grams (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexivec.llm.charhash import counted
from plexivec.plans.batches import small_batches

#: n-grams in a profile, and most of a document's that are compared.
PROFILE = 400
#: Documents a language, about, from which its profile is learned: they are drawn by a hash of the id.
TRAIN_DOCS = 3000


@dataclass(frozen=True)
class Profiles:
    """``ranks[i, j]``: rank of n-gram ``codes[i]`` in language ``langs[j]``, or ``size`` if it has none."""

    langs: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the least out-of-place distance, and 1 - distance / largest distance."""
        codes, counts = counted(text or "")
        if len(codes) == 0 or not self.langs:
            return "und", 0.0
        if len(codes) > self.size:  # the top, with all that tie at its end
            least = np.partition(counts, len(counts) - self.size)[len(counts) - self.size]
            codes, counts = codes[counts >= least], counts[counts >= least]
        order = np.lexsort((codes, -counts))[: self.size]
        top = codes[order]
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        known = self.codes[at] == top
        ranks = np.where(known[:, None], self.ranks[at], self.size)
        off = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(len(top))[:, None])).sum(0)
        best = int(np.argmin(off))
        return self.langs[best], float(1 - off[best] / (self.size * len(top)))


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", size: int = PROFILE, train_docs: int = TRAIN_DOCS) -> Profiles:
    """Profiles of the languages of ``docs``: their ``size`` most frequent n-grams, ties by code.

    Of each language about ``train_docs`` documents are read, all if it has fewer; counts are summed by
    Spark, and only ``size`` n-grams a language come to the driver.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    share = {r["lang"]: min(1.0, train_docs / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Profiles([], np.zeros(1, np.uint64), np.zeros((1, 0), np.int64), size)
    part = F.create_map(*[x for lang, s in share.items() for x in (F.lit(lang), F.lit(float(s)))])
    drawn = F.pmod(F.xxhash64(F.lit("profile"), "doc_id"), F.lit(1 << 30)) < part[F.col("lang")] * (1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), object)
            texts = batch.column("text")
            for lang in sorted(set(langs)):
                parts = [counted(texts[int(i)].as_py()) for i in np.flatnonzero(langs == lang)]
                codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "code", "n"])

    counts = small_batches(known.filter(drawn).select("lang", "text")).mapInArrow(run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= size).toPandas()
    langs = sorted(share)
    codes = np.unique(top["code"].to_numpy(np.int64).astype(np.uint64))
    ranks = np.full((max(len(codes), 1), len(langs)), size, np.int64)
    column = {lang: j for j, lang in enumerate(langs)}
    ranks[np.searchsorted(codes, top["code"].to_numpy(np.int64).astype(np.uint64)), top["lang"].map(column).to_numpy(int)] = top["rank"].to_numpy(int) - 1
    return Profiles(langs, codes if len(codes) else np.zeros(1, np.uint64), ranks, size)


def identify_language(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns ``lang_pred`` and ``score`` (0 to 1), from the whole text and nothing else.

    ``und`` and 0 if the text is null or has no letter, or if no language was learned; among equal
    distances the first language in code-point order.  Columns of these names in ``docs`` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = small_batches(docs).select(F.struct(*rest).alias("row"), predicted(F.col(text_col)).alias("found"))
    return out.select("row.*", "found.lang_pred", "found.score")


def held_out(id_col: str = "doc_id"):
    """The documents of the test fold: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
