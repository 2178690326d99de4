"""Exact dedup, line dedup and mixing: edge cases against plain Python."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plexivec.llm import queries
from plexivec.llm.exact_dedup import exact_dedup, may_repeat, repeated_positions
from plexivec.llm.line_dedup import dedup_lines
from plexivec.llm.mixing import fair_schedule, mix_sources, mixed_documents, served, source_targets
from plexivec.plans.skew import lookup
from tests.compare import same
from tests.conftest import SMALL

LONG = "This line is longer than twenty."
DOCS = [
    (1, None, "a"), (2, "", "a"), (3, "x", "b"), (4, "x", None), (5, "x", "b"), (6, f"{LONG}\nshort\n{LONG}", "c"),
    (7, f" {LONG.upper()}\t\nb", "c"), (8, f"q\n\n{LONG}\x0b", "c"), (9, "word " * 3000, "c"), (None, "x", "b"), (5, "x", "b"), (3, "y", None),
]


@pytest.fixture
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(0) for c in ("n_docs", "keeper", "h1", "row", "size", "kept", "_id", "bucket", "group_size")})


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    same(spark, SMALL, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_exact(docs):
    got = sorted(map(tuple, exact_dedup(docs).collect()), key=repr)
    groups = defaultdict(list)
    for i, t, _ in DOCS:
        groups[t or ""].append(i)
    assert len(got) == len(DOCS)
    for i, keep, size, kept, sha in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == sha)
        assert keep == max(g for g in groups[text] if g is not None) and size == len(groups[text]) and (not kept or i == keep)
    kept = Counter(sha for *_, k, sha in got if k)
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_lines(docs):
    got = sorted(map(tuple, dedup_lines(docs).collect()), key=repr)
    assert len(got) == len(DOCS)
    by = {(i, t): (n, d) for i, t, n, d in got}
    assert by[6, "short"] == (3, 2) and by[7, "b"] == (2, 1) and by[8, f"q\n\n{LONG}\x0b"] == (3, 0) and by[1, ""] == (1, 0)
    assert sum(i == 9 for i, *_ in got) == 1


def test_lines_need_length_and_documents(spark):
    rows = [(i, "nineteen characters\ntwenty characters !!") for i in range(3)] + [(9, "in two documents only, this"), (10, "in two documents only, this")]
    got = {i: (t, d) for i, t, _, d in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == ("nineteen characters", 1) and got[2][1] == 0 and got[9][1] == 0


def test_lines_count_documents_not_rows(spark):
    rows = [(9, LONG), (9, LONG), (9, f"{LONG}\nmore"), (10, LONG), (None, "another line, longer than twenty"), (None, "another line, longer than twenty"), (1, "another line, longer than twenty")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))).collect()
    assert len(got) == 7 and all(r["n_dropped"] == 0 for r in got)
    more = spark.createDataFrame([*rows, (11, LONG)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_dropped"]) for r in dedup_lines(more).filter("doc_id >= 9").collect()) == [(9, 1), (9, 1), (9, 1), (10, 1), (11, 0)]


def test_lines_of_a_very_long_text(spark):
    many = "\n".join(f"a line that comes again {i % 20000} times" for i in range(60_000))
    rows = [(1, many), (2, many), (3, many + "\nlast")]
    got = {i: (t, n, d) for i, t, n, d in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == ("", 60_000, 60_000) and got[3] == (many + "\nlast", 60_001, 0)


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 40)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(sizes, (3, 1, 2), 1.5, 2).collect()}
    weights, most = {"a": 3, "b": 1, "c": 2, None: 3}, {"a": 20, "b": 2000, "c": 1000, None: 80}
    target = dict.fromkeys(weights, 0.0)
    open_, left = set(weights), 1.5 * 1550
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level >= most[s]}
        for s in full or open_:
            target[s] = most[s] if full else weights[s] * level
        left -= sum(most[s] for s in full)
        open_ = open_ - full if full else set()
    assert got == pytest.approx(target)


def test_mix(docs):
    copies = mix_sources(docs).toPandas()
    assert len(copies) == 2 * len(DOCS)
    taken = copies.groupby(copies["source"].fillna("-"))["taken"].sum()
    target = copies.groupby(copies["source"].fillna("-"))["target"].first()
    assert ((target - taken).abs() < 1).all() and (copies["taken"] <= copies["size"]).all()
    finish = copies["finish"].dropna().tolist()
    assert finish == sorted(finish)
    again = mix_sources(docs.repartition(3)).toPandas()
    key = ["doc_id", "source", "size", "epoch", "taken"]
    assert sorted(map(repr, copies[key].astype(object).values.tolist())) == sorted(map(repr, again[key].astype(object).values.tolist()))


def test_mix_takes_what_the_queues_serve(spark):
    """Every source's words are its target to the word, by the sum over the sorted pieces."""
    docs = spark.createDataFrame([(i, "w " * (i * 7 % 90), f"s{i % 5}") for i in range(400)], "doc_id long, text string, source string")
    p = served(docs).toPandas()
    by = p.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (by["taken"] == by["target"].apply(math.floor)).all()
    p = p.sort_values(["finish", "over"], kind="stable")
    assert p["taken"].sum() == by["target"].apply(math.floor).sum() and (p[p["taken"] > 0]["finish"] <= 1).all()
    assert (p.groupby(["doc_id"])["taken"].sum() <= 2 * p.groupby("doc_id")["size"].first()).all()


def test_exact_beyond_the_broadcast_limit(docs, monkeypatch):
    want = sorted(map(repr, exact_dedup(docs).collect()))
    monkeypatch.setattr("plexivec.llm.exact_dedup.BROADCAST_BYTES", 0)
    assert sorted(map(repr, exact_dedup(docs).collect())) == want


def test_exact_moves_no_unique_row_behind_a_folded_filter(spark, monkeypatch):
    """The second filter has bits for repeated positions only: it stays small beside many rows, and testing against it shuffles nothing."""
    monkeypatch.setattr("plexivec.llm.exact_dedup.BLOCK_BITS", 64)
    n = 20000
    rows = spark.range(n).select(F.when(F.col("id") % 100 == 0, F.col("id") % 1000).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"))
    rows = rows.withColumn("position", F.pmod(F.xxhash64("k"), F.lit(1 << 20))).cache()
    twice = repeated_positions(rows)
    tested = may_repeat(rows, twice, n)
    plan = tested._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(position" not in plan.split("BroadcastExchange")[0]
    out = tested.groupBy("maybe", (F.col("row") % 100 == 0).alias("again")).count().collect()
    count = {(r["maybe"], r["again"]): r["count"] for r in out}
    assert count[True, True] == n // 100 and (False, True) not in count and sum(count.values()) == n
    assert count[True, False] < 0.12 * n
    monkeypatch.setattr("plexivec.llm.exact_dedup.BROADCAST_BYTES", 0)
    apart = may_repeat(rows, twice, n).filter("maybe")
    assert apart.filter("row % 100 = 0").count() == n // 100 and apart.count() < 0.05 * n
    empty = rows.limit(0)
    assert may_repeat(empty, repeated_positions(empty), 0).count() == 0


def test_mixed_documents_by_either_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 9), ["a", "b", None][i % 3], "x") for i in range(300)], "doc_id long, text string, source string, _rows string")
    rows = sorted(map(repr, mixed_documents(docs).collect()))
    taken = mix_sources(docs).filter("taken > 0 and taken * 2 > size").groupBy("doc_id").count()
    want = {r["doc_id"]: r["count"] for r in taken.collect()}
    assert Counter(r["doc_id"] for r in mixed_documents(docs).collect()) == want
    monkeypatch.setattr("plexivec.llm.mixing.BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mixed_documents(docs).collect())) == rows


def test_mixed_documents(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "ab"[i % 3 > 0], "x") for i in range(300)], "doc_id long, text string, source string, lang string")
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert max(Counter(r["doc_id"] for r in out.collect()).values()) <= 2


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert exact_dedup(none).count() == dedup_lines(none).count() == mix_sources(none).count() == fair_schedule(none).count() == 0


def test_lookup_with_hot_groups(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).cast("long").alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("m"), F.max("id").alias("last"))
    got = lookup(rows, groups, ["k"], "m", 3000, F.xxhash64("id"))
    assert got.count() == 3000 and got.filter("k = 7").agg(F.min("last"), F.max("last"), F.count("*")).first() == (999, 999, 1000)
    assert lookup(rows, groups.filter("k % 2 = 1"), ["k"], "m", 3000, F.xxhash64("id"), "inner").count() == 2000
