"""Literal cases of names, tokens and statistics."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plexivec.functions import names as n
from plexivec.functions import stats as st
from plexivec.functions import vectors as v


def column(spark, value, *exprs, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(*exprs).first()


@pytest.mark.parametrize("name,gene,full,major", [("TRBV6-5*02", "TRBV6-5", "TRBV6-5*02", "TRBV6-5*01"), ("TRBV6-5*", "TRBV6-5", "TRBV6-5*01", "TRBV6-5*01"), (" TRBV1 ", "TRBV1", "TRBV1*01", "TRBV1*01"), (None, "", "", "*01"), ("", "", "", "*01")])
def test_alleles(spark, name, gene, full, major):
    x = F.col("x")
    assert tuple(column(spark, name, n.strip_allele(x), n.allele_with_default(x), n.allele_to_major(x))) == (gene, full, major)


def test_aliases():
    assert n.normalize_species("Homo sapiens") == "human" and n.normalize_species("HSA") == "human"
    assert n.normalize_locus("heavy") == "IGH" and n.normalize_locus("T-beta") == "TRB"
    assert n.preset("hsa", "beta") == (2000, 65, 260) and n.preset("mouse", "IGH") == n.FALLBACK_PRESET
    for f in (n.normalize_species, n.normalize_locus):
        with pytest.raises(ValueError):
            f("frog")


def test_aliases_of_a_column(spark):
    names = ["Homo sapiens", " mus-musculus", "HSA", "frog", "", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, x string").orderBy("i").select(n.meant("species", F.col("x"))).collect()
    assert [r[0] for r in got] == ["human", "mouse", "human", None, None, None]
    names = ["heavy", "T-beta", "B_kappa", "igl", "T lambda", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, x string").orderBy("i").select(n.meant("locus", F.col("x"))).collect()
    assert [r[0] for r in got] == ["IGH", "TRB", "IGK", "IGL", None, None]


@pytest.mark.parametrize("seq", ["CAS", "CASSIRSSYEQYF", "C" * 60, "", None, "CAéS"])
def test_tokens(spark, seq):
    ids = column(spark, seq, n.tokens(F.col("x")))[0]
    assert len(ids) == 40
    kept = "".join(n.ALPHABET[i] for i in ids if i < 20)
    clean = "".join(c for c in seq or "" if ord(c) < 128)
    assert kept == (clean if len(clean) <= 40 else "C" * 40)
    if len(clean) > 7:
        assert kept[:4] == clean[:4] and ids[-1] == n.ALPHABET.index(clean[-1])


def test_round_trip_and_one_hot(spark):
    x = F.col("x")
    seq, hot = column(spark, "CASSIRSSYEQYF", n.tokens_to_sequence(n.tokens(x)), n.one_hot(n.tokens(x)))
    assert seq == "CASSIRSSYEQYF" and len(hot) == 40 and all(sum(h) == 1 for h in hot)


def test_mutation(spark):
    df = spark.createDataFrame([(i, "CASSIRSSYEQYF") for i in range(200)] + [(i, "CF") for i in range(5)], "i int, x string")
    for old, new in df.select("x", n.mutate(F.col("x"), F.col("i"))).collect():
        diff = [k for k in range(len(old)) if old[k] != new[k]]
        assert len(new) == len(old) and (len(diff) == 1 and 0 < diff[0] < len(old) - 1 if len(old) > 2 else not diff)


def test_longest_common_suffix(spark):
    df = spark.createDataFrame([(["TEAFF", "NTEAFF", "", "EAFF"],), ([""],), (["A", "B"],)], "x array<string>")
    assert [r[0] for r in df.select(n.longest_common_suffix(F.col("x"))).collect()] == ["EAFF", "", ""]


@pytest.mark.parametrize("raw,out", [("[F]", "F"), ("(ORF)", "ORF"), ("", "P"), (None, "P"), ("F", "F")])
def test_functionality(spark, raw, out):
    assert column(spark, raw, n.normalize_functionality(F.col("x")))[0] == out


def test_tails(spark):
    df = spark.createDataFrame([(k, m) for k in range(8) for m in (0.3, 2.0, 6.5)], "k int, m double")
    df = df.select("k", "m", st.poisson_tail(F.col("k"), F.col("m")).alias("p"), st.binomial_tail(F.col("k"), F.lit(20), F.col("m") / 20).alias("b"), st.gamma_tail(F.col("m"), F.lit(2.5), F.lit(1.5)).alias("g"))
    for k, m, p, b, _ in df.collect():
        assert p == pytest.approx(1 - sum(math.exp(-m) * m**i / math.factorial(i) for i in range(k)), abs=1e-12)
        q = m / 20
        assert b == pytest.approx(1 - sum(math.comb(20, i) * q**i * (1 - q) ** (20 - i) for i in range(k)), abs=1e-12)
    # chi-square with 4 degrees in closed form
    c = spark.createDataFrame([(5.0, 4.0)], "x double, d double").select(st.chi2_tail("x", "d")).first()[0]
    assert c == pytest.approx(math.exp(-2.5) * 3.5)
    assert column(spark, 0.2, st.fisher_combine(F.col("x"), F.lit(0.5)), kind="double")[0] == pytest.approx(0.1 * (1 - math.log(0.1)))


def test_fisher_exact(spark):
    p = spark.createDataFrame([(3, 1, 1, 3)], "a int, b int, c int, d int").select(st.fisher_exact("a", "b", "c", "d")).first()[0]
    assert p == pytest.approx(34 / 70)


def test_benjamini_hochberg(spark):
    ps = [0.01, 0.04, 0.03, 0.2, 0.03, 0.9]
    got = {r[0]: r[1] for r in st.benjamini_hochberg(spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, pvalue double")).select("i", "qvalue").collect()}
    order = np.argsort(ps)
    q = np.minimum.accumulate((np.array(ps)[order] * 6 / np.arange(1, 7))[::-1])[::-1]
    assert [got[int(i)] for i in order] == pytest.approx(np.minimum(q, 1))


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 0.0, 3.0])], "a array<double>, b array<double>")
    r = df.select(v.l2sq("a", "b"), v.dot("a", "b"), v.upper_triangle("a"), v.strided("a", 2, 3), v.view("a", "full")).first()
    assert list(r) == [5.0, 11.0, [1.0, 2.0, 3.0, 4.0, 6.0, 9.0], [3.0], [1.0, 2.0, 3.0]]
    with pytest.raises(ValueError):
        v.view("a", "half")
    with pytest.raises(ValueError, match=r"\['y', 'z'\]"):
        v.require_columns(df, ["z", "a", "y"])
    with pytest.raises(ValueError):
        st.size_weight(F.lit(1), "cube")


def test_tails_of_large_means(spark):
    """Sums of the terms in logs, at means where exp(-mean) is 0."""
    from math import exp, lgamma, log

    rows = [(n, m) for m in (1000.0, 5000.0) for n in (0, 1, int(m * 0.97), int(m), int(m * 1.05), int(m * 3))]
    trials = 20_000
    df = spark.createDataFrame(rows, "k int, m double")
    got = df.select("k", "m", st.poisson_tail(F.col("k"), F.col("m")).alias("p"), st.binomial_tail(F.col("k"), F.lit(trials), F.col("m") / trials).alias("b")).collect()
    for r in got:
        k, m, q = r["k"], r["m"], r["m"] / trials
        p = sum(exp(-m + i * log(m) - lgamma(i + 1)) for i in range(k, k + 30_000))
        b = sum(exp(lgamma(trials + 1) - lgamma(i + 1) - lgamma(trials - i + 1) + i * log(q) + (trials - i) * log(1 - q)) for i in range(k, trials + 1))
        assert r["p"] == pytest.approx(p, rel=1e-8, abs=1e-300) and r["b"] == pytest.approx(b, rel=1e-8, abs=1e-300)


def test_small_batches(spark):
    import pyarrow as pa

    from plexivec.plans.batches import SETTING, small_batches

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    texts = spark.range(30, numPartitions=1).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))
    before = spark.conf.get(SETTING, None)
    try:
        spark.conf.unset(SETTING)
        found = [r["n"] for r in small_batches(texts).mapInArrow(rows, "n bigint").collect()]
        assert sum(found) == 30 and max(found) <= 5
        spark.conf.set(SETTING, "1000")
        assert [r["n"] for r in small_batches(texts).mapInArrow(rows, "n bigint").collect()] == [1] * 30  # the caller's size holds
    finally:
        spark.conf.unset(SETTING) if before is None else spark.conf.set(SETTING, before)


def test_tails_of_arrays():
    from math import erfc, exp, lgamma, log, sqrt

    x = np.concatenate([np.geomspace(1e-6, 1e9, 400), np.arange(1, 40) / 2])
    want = np.array([lgamma(v) for v in x])
    assert np.all(np.abs(st.log_gamma(x) - want) <= 1e-13 * np.maximum(1, np.abs(want)))
    z = np.linspace(-30, 30, 601)
    assert np.allclose(st.normal_cdf.func(pd.Series(z)), [0.5 * erfc(-v / sqrt(2)) for v in z], rtol=1e-12, atol=0)
    k, m = (v.ravel() for v in np.meshgrid(np.arange(0, 60), [0.0, 1e-9, 0.5, 3.0, 40.0, 90.0]))
    head = [1.0 if a == 0 else 0.0 if b == 0 else sum(exp(-b + i * log(b) - lgamma(i + 1)) for i in range(a, a + 600)) for a, b in zip(k.tolist(), m.tolist())]
    assert np.allclose(st._poisson.func(pd.Series(k), pd.Series(m)), head, rtol=1e-10, atol=0)
    t = k + k % 7
    tail = [sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(q) + (n - i) * log(1 - q)) for i in range(a, n + 1)) for a, n, q in zip(k.tolist(), t.tolist(), (k % 9 / 10 + 0.05).tolist())]
    assert np.allclose(st._binomial.func(pd.Series(k), pd.Series(t), pd.Series(k % 9 / 10 + 0.05)), tail, rtol=1e-10, atol=0)
    assert list(st._binomial.func(pd.Series([3, 0, 2]), pd.Series([2, 2, 2]), pd.Series([0.5, 0.0, 1.0]))) == [0.0, 1.0, 1.0]
    lost = pd.Series([np.nan, 1.0, 0.0]), pd.Series([1.0, np.nan, np.nan])
    assert st._poisson.func(*lost).isna().all() and st._binomial.func(*lost, pd.Series([0.5] * 3)).isna().all() and st.chi2_tail.func(*lost).isna().all()
    assert list(st.chi2_tail.func(pd.Series([0.0, np.inf]), pd.Series([3, 3]))) == [1.0, 0.0]


def test_fisher_of_many_subjects(monkeypatch):
    """Wide margins look at likely tables only, and large counts have no table of factorials: the same p as with all of them."""
    rng = np.random.default_rng(5)
    cells = [pd.Series(rng.integers(0, 30_000, 40)) for _ in range(4)]
    cells[0][0], cells[1][0], cells[2][0], cells[3][0] = 30_000, 0, 0, 30_000
    near = [pd.Series(20_000 + rng.integers(0, 300, 40)) for _ in range(4)]
    for some in (cells, near):
        got = st.fisher_exact.func(*some)
        monkeypatch.setattr(st, "FACTORIALS", 10)
        stirling = st.fisher_exact.func(*some)
        monkeypatch.setattr(st, "_likely", lambda logs, low, high, mode: (low, high))
        every = st.fisher_exact.func(*some)
        monkeypatch.undo()
        assert np.allclose(got, stirling, rtol=1e-6, atol=1e-300) and np.allclose(stirling, every, rtol=1e-9, atol=1e-300)
    assert (got > 1e-6).sum() > 20
    huge = st.fisher_exact.func(*[pd.Series([x]) for x in (60_000_000, 60_010_000, 60_000_000, 60_000_000)])
    assert 0 < huge[0] < 1
