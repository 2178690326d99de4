"""The metric index, clusters through it, the learned generator, and rows with nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexivec import registry
from plexivec.functions.stats import benjamini_hochberg
from plexivec.operators import basis, cluster, cohort, density, evaluate, neighbors, repertoire
from plexivec.operators.metric_index import CellIndex
from plexivec.plans.numbering import numbered, permuted
from plexivec.sources.generator import generate_records, generator_counts, learn_generator
from tests.conftest import SMALL


def frame(spark, x):
    return spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, v array<double>")


def clumps(rng, n, d, k=12, spread=0.3):
    return rng.normal(size=(k, d))[rng.integers(0, k, n)] * 6 + rng.normal(size=(n, d)) * spread


@pytest.mark.parametrize("shape", ["clumps", "cloud", "copies"])
def test_index_agrees_with_all_pairs(spark, shape):
    rng = np.random.default_rng(4)
    x = {"clumps": clumps(rng, 300, 6), "cloud": rng.normal(size=(300, 6)), "copies": np.repeat(rng.normal(size=(3, 6)), 100, 0)}[shape]
    df = frame(spark, x)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    radii = np.partition(d, 9, axis=1)[:, 9]  # of vectors themselves: on the border
    own = df.join(spark.createDataFrame([(i, float(r)) for i, r in enumerate(radii)], "id long, r2 double"), "id")
    got = dict(map(tuple, neighbors.ball_counts(own, df, "id", "v", radius_col="r2", block=32).collect()))
    assert got == {i: int((d[i] <= r).sum()) for i, r in enumerate(radii)}
    near = neighbors.nearest(df, df, "id", "v", 4, skip_self=True, block=32).toPandas()
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), k + 1) for i in range(len(x)) for k, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:4])}
    assert {(r.id, r.neighbor, r.rank) for r in near.itertuples()} == want


def test_index_visits_few_pairs_of_clumps(spark):
    df = frame(spark, clumps(np.random.default_rng(0), 2000, 16, 40, 0.1)).withColumnRenamed("id", "_id")
    index = CellIndex(df, df, 50)
    assert index.visited(index.lower_bounds() <= 0.5) < 0.1
    assert index.visited(index.lower_bounds() <= 1e9) == 1.0


def test_backends(spark):
    rng = np.random.default_rng(0)
    bg, obs = rng.normal(size=(900, 8)), rng.normal(size=(300, 8))
    obs[:40] = 3.0 + 0.05 * rng.normal(size=(40, 8))
    o, b = frame(spark, obs), frame(spark, bg)
    with pytest.raises(ValueError, match="backend"):
        density.neighbor_enrichment(o, b, "id", "v", backend="faiss")
    got = {k: density.neighbor_enrichment(o, b, "id", "v", backend=k).cache() for k in ("exact", "kdtree")}
    sets = {k: {r["id"] for r in e.filter(density.enriched_mask(e)).collect()} for k, e in got.items()}
    assert sets["exact"] == sets["kdtree"] >= set(range(40))
    assert sorted(map(tuple, got["exact"].select("id", "n_obs", "n_bg").collect())) == sorted(map(tuple, got["kdtree"].select("id", "n_obs", "n_bg").collect()))


def test_approximate_backend_finds_the_hits(spark, monkeypatch):
    rng = np.random.default_rng(1)
    bg, obs = rng.normal(size=(1200, 8)), rng.normal(size=(400, 8))
    obs[:40] = 3.0 + 0.05 * rng.normal(size=(40, 8))
    monkeypatch.setattr(neighbors, "BLOCK", 64)
    for f in (neighbors.nearest, neighbors.found_within):
        monkeypatch.setattr(f, "__defaults__", tuple(64 if x == 2048 else x for x in f.__defaults__))
    o, b = frame(spark, obs), frame(spark, bg)
    hits = {}
    for k in ("exact", "ann"):
        e = density.neighbor_enrichment(o, b, "id", "v", backend=k)
        hits[k] = {r["id"] for r in e.filter(density.enriched_mask(e)).collect()}
    assert len(hits["exact"] & hits["ann"]) > 0.9 * len(hits["exact"] | hits["ann"])
    with pytest.warns(UserWarning, match="undercounted"):
        density.neighbor_enrichment(o, b, "id", "v", backend="ann", k_max=5)


def test_recall_of_approximate_neighbours(spark):
    v = registry.vectors(spark, "/root/testdata/sf0.01")
    near = {(r[0], r[1]) for r in registry.ann_nearest(spark, "/root/testdata/sf0.01").select("vec_id", "neighbor").collect()}
    all_ = {(r[0], r[1]) for r in neighbors.nearest(v, v, "vec_id", "embedding", 10, skip_self=True, backend="exact").select("vec_id", "neighbor").collect()}
    assert len(near & all_) >= 0.9 * len(all_)


def test_spanning_links():
    rng = np.random.default_rng(2)
    for _ in range(20):
        m = rng.random((30, 25)) < rng.choice([0.0, 0.03, 0.1, 0.9])
        links = cluster.spanning_links(m)
        assert all(m[i, j] for i, j in links) and len(links) < 55
        label = np.arange(55)
        for i, j in links:
            label[label == label[30 + j]] = label[i]
        assert all(label[i] == label[30 + j] for i, j in zip(*np.nonzero(m)))


def test_dbscan_through_the_index(spark):
    x = clumps(np.random.default_rng(7), 300, 5, 8, 0.5)
    df = frame(spark, x)
    a, b = (dict(map(tuple, cluster.dbscan(df, "id", "v", 0.6, 4, backend=k, block=40).collect())) for k in ("kdtree", "exact"))
    assert a == b and len(set(a.values())) > 3 and -1 in a.values()


def test_null_vectors(spark):
    df = frame(spark, np.random.default_rng(0).normal(size=(20, 3))).unionByName(spark.createDataFrame([(99, None)], "id long, v array<double>"))
    fit = basis.fit_projection(df.filter("v is not null"), "v", 2)
    out = {r["id"]: r["z"] for r in basis.transform(df, fit, "v").collect()}
    assert out[99] is None and len(out[3]) == 2
    counts = dict(map(tuple, neighbors.ball_counts(df, df, "id", "v", 100.0).collect()))
    assert counts[99] == 0 and counts[3] == 20
    assert {r["id"] for r in neighbors.nearest(df, df, "id", "v", 2).collect()} == set(range(20))
    assert dict(map(tuple, cluster.dbscan(df, "id", "v", 9.0).collect()))[99] == -1


def test_transform_replaces_what_is_there(spark):
    df = frame(spark, np.random.default_rng(0).normal(size=(20, 3))).withColumn("z", F.array(F.lit(99.0)))
    fit = basis.with_random_features(basis.fit_projection(df, "v", 2), 1.0, 4, 0)
    out = basis.transform(df.withColumn("f", F.lit(1)), fit, "v", "z", "f")
    assert all(len(r["z"]) == 2 and len(r["f"]) == 4 for r in out.collect())
    assert out.schema["z"].metadata["basis"] == fit.fingerprint


def test_null_values_keep_their_rows(spark):
    df = spark.createDataFrame([(1, 0.01), (2, None), (3, 0.5), (4, 0.5), (5, 0.0)], "id long, pvalue double")
    got = {r["id"]: r["qvalue"] for r in benjamini_hochberg(df).collect()}
    assert got == {1: 0.02, 2: None, 3: 0.5, 4: 0.5, 5: 0.0}
    assert {r["id"]: r["r"] for r in evaluate.average_rank(df, "pvalue", "r").collect()} == {1: 2.0, 2: None, 3: 3.5, 4: 3.5, 5: 1.0}
    assert {r["id"]: r["s"] for r in density.size_survival(df, "pvalue", "s").collect()} == {1: 0.75, 2: None, 3: 0.5, 4: 0.5, 5: 1.0}


def test_permutations(spark):
    for n in (1, 2, 3, 10, 1000):
        a, b = permuted(np.arange(n), n, 1), permuted(np.arange(n), n, 2)
        assert sorted(a) == sorted(b) == list(range(n))
    assert (a != b).mean() > 0.9
    rows = numbered(spark.range(0, 50, 1, 7).filter("id % 3 <> 0"), "nr").collect()
    assert sorted(r["nr"] for r in rows) == list(range(len(rows)))


def test_built_in_permutations_of_a_report(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 120)
    x = np.column_stack([y + rng.normal(0, 0.3, 120), rng.normal(size=120)])
    df = spark.createDataFrame([(int(a), [float(v) for v in r]) for a, r in zip(y, x)], "y int, x array<double>")
    spec = cohort.ChannelSpec({"signal": [0], "noise": [1]})
    score = lambda d, cols: abs(d.agg(F.corr(sum(F.col("x")[c] for c in cols), "y")).first()[0])
    got = {r["channel"]: r["pvalue"] for r in cohort.channel_report(df, spec, score, n_permutations=9, seed=3).collect()}
    assert got["signal"] == 0.1 <= got["noise"] <= 1.0


def test_stacked_embeddings(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], [3.0]), ("b", [4.0, 5.0], [6.0])], "s string, mean array<double>, diversity array<double>")
    out, spec = cohort.stack_embeddings(df)
    assert spec.channels == {"mean": [0, 1], "diversity": [2]} and spec.attributable == {"mean"}
    assert sorted(r["x"] for r in out.collect()) == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]
    with pytest.raises(ValueError, match="differ"):
        cohort.stack_embeddings(df.withColumn("mean", F.when(F.col("s") == "a", F.col("mean")).otherwise(F.array(F.lit(1.0)))))
    with pytest.raises(ValueError):
        cohort.stack_embeddings(df.limit(0))
    assert repertoire.decode_metrics([1.0, 2.0, 0.5])["clonality"] == 0.5


def test_generator_follows_its_table(spark):
    own = registry._records(spark, SMALL).cache()
    model = learn_generator(own)
    rows = generate_records(spark, model, 20_000, seed=5, partitions=3)
    assert rows.count() == 20_000 and rows.select("row_id").distinct().count() == 20_000
    assert rows.filter(~F.col("junction_aa").rlike("^C[A-Z]*F$")).count() == 0
    want, got = ({(r["kind"], r["a"], r["b"]): r["n"] for r in generator_counts(x).collect()} for x in (own, rows))
    assert set(got) <= set(want)
    for kind in ("genes", "length", "first", "last"):
        total = [sum(n for k, n in c.items() if k[0] == kind) for c in (want, got)]
        assert sum(abs(want[k] / total[0] - got.get(k, 0) / total[1]) for k in want if k[0] == kind) / 2 < 0.06
    other = generate_records(spark, model, 20_000, seed=5, partitions=1)
    assert rows.exceptAll(other).count() == 0
    with pytest.raises(ValueError):
        learn_generator(own.limit(0))
