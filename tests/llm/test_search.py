"""Near duplicates and decontamination against brute force; hashes of words."""

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plexivec.llm import decontaminate as dc
from plexivec.llm import near_dedup as nd
from plexivec.llm import queries, wordhash
from plexivec.plans import components
from plexivec.sources.tables import table
from tests.conftest import SMALL

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(ASCII))


def shingle_set(text, n):
    w = tokens(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n):
    """``doc_id: (n_shingles, component)`` by comparing all pairs."""
    sets = {i: shingle_set(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and both:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def check(df, n, **kwargs):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute(rows, n)
    got = nd.near_duplicates(df, n_words=n, **kwargs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("n", [2, 5])
def test_documents(spark, n):
    check(table(spark, SMALL, "documents"), n)


def test_large_families(spark, monkeypatch):
    """Groups far beyond the long-list limit: near copies, and texts that share half of their words only; texts come in copies for parts, never to the lookup that may broadcast."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(90):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 12)):
            w[k] = f"x{rng.integers(10**6)}"
        docs.append((i, " ".join(w)))
    for i in range(90, 150):
        docs.append((i, " ".join(base[:60] + [f"y{rng.integers(10**6)}" for _ in range(40)])))
    docs += [(200, None), (201, " \t\n"), (202, "One"), (203, "one"), (204, "one two"), (205, "a b c d e"), (206, "a b c d e f")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("m", F.lit(1))
    check(df, 2)
    lookup = nd.lookup

    def without_texts(rows, groups, *args):
        assert not any("text" in c.replace("text_hash", "") for c in rows.columns + groups.columns)
        return lookup(rows, groups, *args)

    monkeypatch.setattr(nd, "lookup", without_texts)
    monkeypatch.setattr(nd, "TEXT_ROWS", 8)
    check(df, 2, long_list=4)


def test_groups_are_about_one_edge_a_class(spark, monkeypatch):
    """Classes that meet in many long lists are no edge for each list; the groups are those of all lists."""
    seen, hubs = [], nd._hubs

    def watched(met):
        all_ = met.select(F.col("top.node").alias("a"), F.col("node").alias("b")).distinct()
        seen.append((met.select("node").distinct().count(), all_.count(), hubs(met).count()))
        by_node = lambda edges: sorted(map(tuple, nd.components(edges).collect()))
        assert by_node(hubs(met)) == by_node(all_)
        return hubs(met)

    monkeypatch.setattr(nd, "_hubs", watched)
    rng = np.random.default_rng(5)
    docs = []
    for i in range(240):
        w = [f"w{k}" for k in range(120)]
        for k in rng.integers(0, 120, 4):
            w[k] = f"x{rng.integers(10**6)}"
        docs.append((i, " ".join(w)))
    check(spark.createDataFrame(docs, "doc_id long, text string"), 2)
    classes, before, now = seen[0]
    assert now < 1.5 * classes and 2 * now < before


def test_queries_are_planned_in_small_pieces(spark, monkeypatch):
    """Spark plans a query anew on the driver after each shuffle and holds its broadcasts there: no query has many shuffles, and without hot groups none is told to broadcast."""
    seen = []

    def watched(f):
        def staged(df, name):
            said = df._jdf.queryExecution().executedPlan().toString()
            seen.append((len(re.findall(r"(?<!\w)Exchange ", said)), said.count("BroadcastExchange"), name))
            return f(df, name)

        return staged

    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(base[:60] + [f"y{rng.integers(10**6)}" for _ in range(40)])) for i in range(40)]
    docs += [(i, " ".join(base[: 110 - i % 3])) for i in range(40, 70)] + [(i, " ".join(base[: 119 - i % 9])) for i in range(70, 80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(nd, "staged", watched(nd.staged))
    monkeypatch.setattr(components, "staged", watched(components.staged))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(df, 2, long_list=4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert {"best", "close", "last", "within"} <= {name for *_, name in seen}
    assert max(shuffles for shuffles, *_ in seen) <= 12
    assert all(broadcasts <= (name == "labels") for _, broadcasts, name in seen)  # the jump of components does not know its groups' sizes


def test_groups_compare_only_sets_of_about_one_size(spark, monkeypatch):
    """Each class outside the largest component meets each class that may be similar once, and few others."""
    monkeypatch.setattr(nd, "BLOCK_CLASSES", 8)
    rng = np.random.default_rng(6)
    sizes = [80, 100, 64, 125, 1, 1, 5, 4] + np.exp(rng.uniform(2, 8, 300)).astype(int).tolist()
    rows = [(1, i % 5, 0, i, n, [i]) for i, n in enumerate(sizes)] + [(2, i, i % 2, 1000 + i, 50, [i]) for i in range(2)]
    df = spark.createDataFrame(rows, "g long, comp long, largest long, node long, n long, sketch array<long>")
    x = nd._blocks(df, 80).toPandas()
    pair = ["g", "p", "q", "i", "j"]
    met = x[x["outside"]].merge(x[~x["outside"]], on=pair)
    seen = set(zip(met["node_x"], met["node_y"]))
    assert len(seen) == len(met) and x.groupby([*pair, "outside"]).size().max() < 24
    outside = [i for i in range(len(sizes)) if i % 5]
    assert {(i, j) for i in outside for j in range(len(sizes)) if 100 * sizes[i] >= 80 * sizes[j] and 100 * sizes[j] >= 80 * sizes[i]} <= seen
    assert len(met) < len(outside) * len(sizes) / 4


def test_sets_of_blocks_are_counted_by_products(monkeypatch):
    """Many close pairs of two blocks are no intersection each; the links are those of single intersections."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"y{rng.integers(10**6)}" if rng.random() < 0.05 else f"w{k}" for k in range(90 + i % 3)) for i in range(60)]
    sets = list(nd.shingle_sets(pa.array(texts), 2))
    x = pd.DataFrame({"node": range(60), "comp": range(60), "n": [len(s) for s in sets], "sketch": [s[: nd.K].astype(np.int64) for s in sets], "text": texts})
    monkeypatch.setattr(nd, "PRODUCT_VALUES", 50)
    known = nd._shared(sets[:30], sets[30:], 10**12)
    assert known.tolist() == [[len(set(s.tolist()) & set(t.tolist())) for t in sets[30:]] for s in sets[:30]]
    assert nd._shared(sets[:1], [sets[0] + 1], 10**6).tolist() == [[len(np.intersect1d(sets[0], sets[0] + 1))]]
    monkeypatch.setattr(nd, "PAIR_PRODUCTS", 0)
    single = nd._forest(x[:30], x[30:], 2, 80)
    monkeypatch.undo()
    monkeypatch.setattr(nd.np, "intersect1d", lambda *a, f=np.intersect1d, **k: f(*a) if not k else pytest.fail("a pair by itself"))
    assert len(single) and nd._forest(x[:30], x[30:], 2, 80).equals(single)


def test_short_texts_at_the_threshold(spark):
    """Families around the long-list limit, each a text of 4, 8 or 12 shingles and others with 1, 2 or 3 more (4/5, 8/10, 12/15)."""
    docs = []
    for shingles, more in ((4, 1), (8, 2), (12, 3)):
        for size in range(17, 61, 3):
            base = [f"f{len(docs)}w{i}" for i in range(shingles + 1)]
            docs.append((len(docs), " ".join(base)))
            for _ in range(size - 1):
                docs.append((len(docs), " ".join(base + [f"d{len(docs)}x{i}" for i in range(more)])))
    check(spark.createDataFrame(docs, "doc_id long, text string"), 2)


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "z"), (3, None), (None, None)]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n_words=2).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True)]
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=50)
    kept = nd.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")), n_words=2)
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == 5


def test_least_shared_is_a_bound():
    rng = np.random.default_rng(0)
    shared = rng.random((20000, nd.K)) < 0.8
    assert (shared[:, 1:] & shared[:, :-1]).sum(1).min() >= nd.least_shared(0.8)


def test_words_match_python(monkeypatch):
    texts = ["Hello  World", None, "", " a\tb\x0bc ", "ÉTÉ hello", "x" * 50 + " y", "hello world"] * 3
    monkeypatch.setattr(wordhash, "BLOCK", 16)
    with np.errstate(over="ignore"):
        h, s, e, first = wordhash.words(*wordhash.text_bytes(pa.array(texts)))
    got = [list(h[a:b]) for a, b in zip(first[:-1], first[1:])]
    names = defaultdict(set)
    for t, hs in zip(texts, got):
        assert len(hs) == len(tokens(t))
        for w, x in zip(tokens(t), hs):
            names[w].add(x)
    assert all(len(v) == 1 for v in names.values()) and len({min(v) for v in names.values()}) == len(names)


def test_decontaminate_finds_all(spark):
    docs, items = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontaminate(spark, SMALL).collect()}
    squeeze = lambda t: f" {' '.join(tokens(t))} "
    bench = [(r["item_id"], r["text"]) for r in items.collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    exact = {(d, i) for d, t in texts.items() for i, b in bench if squeeze(b) in squeeze(t)}
    assert exact and exact <= got
    for d, i in got - exact:
        b = shingle_set(dict(bench)[i], 5)
        assert len(b & shingle_set(texts[d], 5)) >= 0.5 * len(b)
    clean = dc.drop_contaminated(docs, items)
    assert {r["doc_id"] for r in clean.collect()} == set(texts) - {d for d, _ in got} and clean.columns == docs.columns


def test_search_is_bm25(monkeypatch):
    """What the bounds let through is what plain scoring of every passage retrieves."""
    rng = np.random.default_rng(5)
    vocab = [f"t{i}" for i in range(60)]
    common = ["the", "of", "and"]
    make = lambda n: " ".join(rng.choice(vocab + common * 15, n))
    items = [make(rng.integers(4, 30)) for _ in range(50)] + ["", None, "the of"]
    index = dc.build_index(list(range(len(items))), items)
    texts = [make(rng.integers(1, 300)) + " " + str(items[k % 50]) for k in range(40)] + [""]
    with np.errstate(over="ignore"):
        h, _, _, first = wordhash.words(*wordhash.text_bytes(pa.array(texts)))
    docs = np.repeat(np.arange(len(texts)), np.diff(first))
    got = {(d, a, i): s for d, a, i, s in dc.search(index, h, docs)}
    want, half = {}, index.width // 2
    for d in range(len(texts)):
        for a in range(first[d], first[d + 1], half):
            have = set(h[a : min(a + index.width, first[d + 1])].tolist())
            for i in range(len(items)):
                s = sum(index.impacts[p] for t in range(len(index.terms)) if int(index.terms[t]) in have for p in range(index.starts[t], index.starts[t + 1]) if index.items[p] == i)
                if s >= dc.LEAST_SCORE:
                    want[d, int(a), i] = s
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)


def test_decontaminate_edges(spark, monkeypatch):
    items = spark.createDataFrame([(1, "What is the capital of Freedonia in the year 1933? Glorious Fredville."), (2, None), (3, " "), (4, "tiny item")], "item_id long, text string")
    rows = [(1, "junk " * 500 + "WHAT is the capital of Freedonia in the year 1933? Glorious Fredville. " + "more " * 300), (2, None), (3, ""), (4, "what is the capital of nothing"), (5, "a tiny item here"), (5, "a tiny item here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.find_items(docs, items).collect()) == [(1, 1), (5, 4), (5, 4)]
    monkeypatch.setattr(dc, "MAX_ITEMS", 1)
    assert sorted({(r["doc_id"], r["item_id"]) for r in dc.find_items(docs, items).collect()}) == [(1, 1), (5, 4)]
    monkeypatch.undo()
    assert dc.find_items(docs, items.limit(0)).count() == dc.find_items(docs.limit(0), items).count() == 0
    assert dc.question_and_answer("One? Two. Three!") == ("One? Two.", "Three!") and dc.question_and_answer("One") == ("One", "One")
