"""Line deduplication across documents, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexivec.functions.text import BLANK, ascii_lower
from plexivec.plans.skew import lookup
from plexivec.plans.staging import staged


def line_keys(text: Column) -> Column:
    """The key of every line of a text: blanks stripped at both ends, A-Z in lower case."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.btrim(line, F.lit(BLANK)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per document: ``doc_id, text, n_lines, n_dropped``, with the text that stays.

    Lines with a key of at least ``min_chars`` code points found in at least ``min_docs`` documents are
    dropped everywhere but in the document with the largest id that holds the key.  A null or empty
    text is one empty line.  A document that loses all lines keeps the empty text.  Documents are counted
    by id: rows that repeat an id hold a line as one document, and all keep it if theirs is the largest
    id; rows without an id are one document, smaller than all others.  Other columns are ignored,
    whatever their names.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))
    long = lambda k: F.char_length(k) >= min_chars
    held = base.select("doc_id", F.explode(F.transform(F.filter(line_keys(F.col("text")), long), hashed)).alias("k"))
    in_doc = held.groupBy("k.h1", "k.h2", "doc_id").agg(F.count("*").alias("n"))  # combined before the shuffle
    counted = in_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"), F.max("doc_id").alias("keeper"))
    repeated = staged(counted.filter(F.col("n_docs") >= min_docs), "lines")
    total = repeated.agg(F.coalesce(F.sum("n_lines"), F.lit(0))).first()[0]

    row = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    at = base.select(*row, F.posexplode(line_keys(F.col("text"))).alias("pos", "key")).filter(long(F.col("key")))
    at = at.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    lost = lookup(at, repeated, ["h1", "h2"], "n_lines", total, F.xxhash64("doc_id", "text_hash", "pos"), "inner").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_set("pos")).alias("lost"))

    joined = base.withColumn("text_hash", F.xxhash64("text")).join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    none = F.array().cast("array<int>")
    out = joined.select("doc_id", "text", F.split("text", "\n", -1).alias("lines"), F.coalesce("lost", none).alias("lost"))
    # sets of integers are hashed and keep their order: linear in the number of lines
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.array_join(F.transform(stay, lambda p: F.get(F.col("lines"), p)), "\n")
    return out.select("doc_id", F.when(F.size("lost") == 0, F.col("text")).otherwise(kept).alias("text"), F.size("lines").cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"))
