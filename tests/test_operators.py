"""Laws and small hand-made cases of the operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plexivec import registry
from plexivec.operators import basis, cluster, cohort, density, embedding, evaluate, neighbors, repertoire, theory
from plexivec.plans.components import components
from plexivec.sources import formats
from plexivec.streaming.incremental import windowed_descriptor

SEQS = ["CASSIRSSYEQYF", "CSARVSGYYGYTF", "CASSF", "CASSLAPGATNEKLFF", "CAF"]


def test_gapblock_laws():
    g = embedding.gram(embedding.substitution())
    assert (np.diag(g) == 0).all() and (g == g.T).all()
    d = embedding.gapblock(SEQS, SEQS, g)
    assert np.allclose(np.diag(d), 0) and np.allclose(d, d.T) and (d >= 0).all()
    assert embedding.gapblock(["CASSF"], ["CASSSF", "CASSSSF"], g).tolist() == [[8.0, 9.0]]


def test_alignments():
    s = embedding.substitution()
    assert embedding.smith_waterman("CASF", "CASF", s) == 9 + 4 + 4 + 6
    assert embedding.smith_waterman("WWW", "PPP", s) == 0
    assert embedding.needleman_wunsch("CAF", "CAF", s) == 19 and embedding.needleman_wunsch("CAF", "CF", s) == 15 - 12


def frame(spark):
    return spark.createDataFrame([(f"V{i % 2}", f"J{i % 3}", s) for i, s in enumerate(SEQS)], "v_call string, j_call string, junction_aa string")


def germline(spark):
    seqs = [("V", "V0*01", "ACDE"), ("V", "V1*01", "ACDW"), ("J", "J0*01", "FF"), ("J", "J1*01", "WF"), ("J", "J2*01", "FF")]
    return embedding.bake_germline(spark.createDataFrame(seqs, "component string, allele string, seq string")).persist()


def test_prototype_is_zero_in_its_own_slot(spark):
    df = frame(spark)
    protos = spark.createDataFrame([(i, *r) for i, r in enumerate(df.collect())], "proto_idx int, v_call string, j_call string, junction_aa string")
    out = embedding.clonotype_embed(df, protos, germline(spark)).toPandas()
    for r in out.itertuples():
        e = np.array(r.embedding).reshape(-1, 3)
        assert (e[SEQS.index(r.junction_aa)] == 0).all() and (e >= 0).all()
    with pytest.raises(ValueError, match="mode"):
        embedding.clonotype_embed(df, protos, germline(spark), mode="x")
    with pytest.raises(ValueError, match="CDR1"):
        embedding.clonotype_embed(df, protos, germline(spark), mode="cdr123")
    with pytest.raises(ValueError, match="matrix"):
        embedding.sequence_distances(df, protos, alignment="sw", matrix=np.eye(20))


def test_alignments_against_plain_recursions():
    """Batches of pairs of mixed lengths against the recursions written cell by cell."""
    rng, s = np.random.default_rng(0), embedding.substitution()
    place = {c: i for i, c in enumerate(embedding.RESIDUES)}
    a, b = (["".join(rng.choice(list(embedding.RESIDUES), rng.integers(0, 9))) for _ in range(60)] for _ in range(2))
    local, whole = embedding.smith_waterman_scores(a, b, s), embedding.needleman_wunsch_scores(a, b, s, 5.0, 2.0)
    for x, y, got, all_ in zip(a, b, local, whole):
        h = np.zeros((len(x) + 1, len(y) + 1))
        m, u, v = (np.full((len(x) + 1, len(y) + 1), -1e18) for _ in range(3))
        m[0, 0] = 0.0
        for i in range(len(x) + 1):
            for j in range(len(y) + 1):
                if i:
                    u[i, j] = max(m[i - 1, j] - 5, u[i - 1, j] - 2)
                if j:
                    v[i, j] = max(m[i, j - 1] - 5, v[i, j - 1] - 2)
                if i and j:
                    c = s[place[x[i - 1]], place[y[j - 1]]]
                    h[i, j] = max(0, h[i - 1, j - 1] + c, h[i - 1, j] - 1, h[i, j - 1] - 1)
                    m[i, j] = m[i - 1, j - 1] + c
                m[i, j] = max(m[i, j], u[i, j], v[i, j])
        assert got == h.max() and all_ == m[-1, -1]
    with pytest.raises(ValueError, match="gap_open"):
        embedding.needleman_wunsch("A", "A", s, 1.0, 2.0)


def test_gapblock_against_plain_sums():
    rng, g = np.random.default_rng(1), embedding.gram(embedding.substitution())
    place = {c: i for i, c in enumerate(embedding.RESIDUES)}
    a = ["".join(rng.choice(list(embedding.RESIDUES), rng.integers(0, 14))) for _ in range(40)]
    got = embedding.gapblock(a, a, g)
    for i, x in enumerate(a):
        for j, y in enumerate(a):
            long, short = (x, y) if len(x) >= len(y) else (y, x)
            gap, best = len(long) - len(short), []
            for p in embedding.GAP_POSITIONS if gap else (0,):
                cut = min(max(p if p >= 0 else len(short) + p, 0), len(short))
                kept = long[:cut] + long[cut + gap :]
                best.append(sum(g[place[c], place[d]] for c, d in zip(kept, short)) + (8 + gap - 1 if gap else 0))
            assert got[i, j] == min(best)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_constant_columns_are_no_component(spark, parts):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((200, 3)), np.full((200, 1), 0.1 + 1e6 / 3)], 1)
    df = spark.createDataFrame([([float(y) for y in r],) for r in x], "v array<double>").repartition(parts)
    b = basis.fit_projection(df, "v", 4)
    assert b.scale[3] == 1.0 and np.abs(b.loadings[3, :3]).max() < 1e-9 and b.variances[3] == pytest.approx(0, abs=1e-12)
    z = np.array([r["z"] for r in basis.transform(df, b, "v", "z").collect()])
    assert np.abs(z[:, 3]).max() < 1e-6 and np.allclose(z[:, :3].var(0), b.variances[:3])


def test_more_prototypes_than_allowed_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embedding, "MAX_PROTOTYPES", 3)
    p = spark.createDataFrame([(i, [1.0]) for i in range(4)], "proto_idx int, v array<double>")
    with pytest.raises(ValueError, match="more than 3"):
        embedding.vector_embed(p.withColumn("k", F.lit(1)), p, "k", "v")
    (tmp_path / "human_TRB.tsv").write_text("v_call\tj_call\tjunction_aa\n" + "V\tJ\tCAF\n" * 5)
    with pytest.raises(ValueError, match="more than 4"):
        formats.load_prototypes(spark, str(tmp_path / "human_TRB.tsv"), most=4)
    with pytest.raises(ValueError, match="only 5"):
        formats.load_prototypes(spark, str(tmp_path / "human_TRB.tsv"), 6)
    assert [tuple(r)[:2] for r in formats.list_available_prototypes(spark, str(tmp_path)).collect()] == [("human", "TRB")]
    assert formats.resource_path(spark, str(tmp_path), "human_TRB.tsv").endswith("human_TRB.tsv")
    with pytest.raises(FileNotFoundError):
        formats.resource_path(spark, str(tmp_path), "mouse_TRB.tsv")


def test_exact_quantiles(spark):
    from plexivec.functions.stats import exact_quantiles

    x = np.random.default_rng(3).integers(0, 40, 301) * 0.5
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    at = [0.0, 0.1, 0.5, 0.77, 1.0]
    assert exact_quantiles(df, F.col("v"), at) == pytest.approx(np.quantile(x, at).tolist())
    assert exact_quantiles(df.limit(0), F.col("v"), at) == [None] * 5


def test_unknown_gene_is_far_even_from_itself(spark):
    df = spark.createDataFrame([("V9", "J0", "CAF")], "v_call string, j_call string, junction_aa string")
    protos = spark.createDataFrame([(0, "V9", "J0", "CAF")], "proto_idx int, v_call string, j_call string, junction_aa string")
    g = germline(spark)
    e = embedding.clonotype_embed(df, protos, g).first()["embedding"]
    assert e[0] == g.filter("component = 'V'").agg(F.max("d")).first()[0] and e[1:] == [0, 0]


def test_paired_needs_equal_keys(spark):
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "k int, embedding array<float>")
    b = spark.createDataFrame([(1, [3.0])], "k int, embedding array<float>")
    assert embedding.paired_embed({"TRA": a, "TRB": a}, "k").filter("k = 2").first()["embedding"] == [2.0, 2.0]
    with pytest.raises(Exception, match="different keys"):
        embedding.paired_embed({"TRA": a, "TRB": b}, "k").collect()


def cloud(spark, n=300, d=6, seed=0, planted=0):
    x = np.random.default_rng(seed).standard_normal((n, d))
    x[:planted] = 2.5 + 0.05 * x[:planted]
    return spark.createDataFrame([(i, [float(y) for y in r], int(i < planted)) for i, r in enumerate(x)], "id long, v array<double>, y int"), x


def test_projection_invariants(spark, tmp_path):
    df, x = cloud(spark)
    b = basis.with_random_features(basis.fit_projection(df, "v", 4), 1.0, 16, 4)
    z = np.array([r["z"] for r in basis.transform(df, b, "v", "z").orderBy("id").collect()])
    assert np.allclose(z.mean(0), 0, atol=1e-9) and np.allclose(z.var(0), b.variances) and np.allclose(b.loadings.T @ b.loadings, np.eye(4))
    s = (x - x.mean(0)) / x.std(0)
    assert np.allclose(np.sort(np.linalg.eigvalsh(s.T @ s / len(s)))[::-1][:4], b.variances)
    b.save(spark, str(tmp_path / "b"))
    again = basis.Basis.load(spark, str(tmp_path / "b"), expect=b.fingerprint)
    assert again.fingerprint == b.fingerprint
    with pytest.raises(ValueError, match="fingerprint"):
        basis.Basis.load(spark, str(tmp_path / "b"), expect="0" * 16)
    other = basis.fit_projection(df.filter("id < 100"), "v", 4)
    with pytest.raises(ValueError, match="different bases"):
        basis.same_basis(basis.transform(df, b, "v", "z"), basis.transform(df, other, "v", "z"), "z")


def test_neighbours_against_brute_force(spark, monkeypatch):
    df, x = cloud(spark, 200)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    got = dict(map(tuple, neighbors.ball_counts(df, df, "id", "v", 3.0, block=64).collect()))
    assert got == {i: int((d[i] <= 3.0).sum()) for i in range(200)}
    near = neighbors.nearest(df, df, "id", "v", 3, skip_self=True, block=64).toPandas()
    np.fill_diagonal(d, np.inf)
    assert {(r.id, r.neighbor) for r in near.itertuples()} == {(i, int(j)) for i in range(200) for j in np.argsort(d[i])[:3]}
    pairs = {(r.a, r.b) for r in neighbors.pairs_within(df, "id", "v", 2.0).collect()}
    assert pairs == {(i, j) for i in range(200) for j in range(i + 1, 200) if d[i, j] <= 2.0}
    monkeypatch.setattr(neighbors, "MANY_DIMENSIONS", 2)
    assert pairs == {(r.a, r.b) for r in neighbors.pairs_within(df, "id", "v", 2.0, block=64).collect()}


@pytest.mark.parametrize("test", ["poisson", "binomial"])
def test_enrichment_finds_planted(spark, test):
    obs, _ = cloud(spark, 300, planted=30)
    bg, _ = cloud(spark, 600, seed=1)
    e = density.neighbor_enrichment(obs, bg, "id", "v", test=test)
    hits = {r["id"] for r in e.filter(density.enriched_mask(e)).collect()}
    assert set(range(30)) <= hits and len(hits) < 60
    with pytest.raises(ValueError, match="empty"):
        density.neighbor_enrichment(obs.limit(0), bg, "id", "v")
    with pytest.raises(ValueError, match="pseudocount"):
        density.neighbor_enrichment(obs, bg, "id", "v", pseudocount=0)
    with pytest.raises(ValueError, match="test"):
        density.neighbor_enrichment(obs, bg, "id", "v", test="t")


def test_enrichment_with_abundance(spark):
    obs, _ = cloud(spark, 200, planted=20)
    bg, _ = cloud(spark, 400, seed=1)
    e = density.neighbor_enrichment(obs.withColumn("a", F.col("id") + 1), bg, "id", "v", abundance="a")
    assert "score" in e.columns and set(range(20)) <= {r["id"] for r in e.filter(density.enriched_mask(e)).collect()}


def test_mask(spark):
    rows = [(5, 0.01, 2.0), (5, 0.2, 2.0), (0, 0.01, 2.0), (5, 0.01, 0.9)]
    df = spark.createDataFrame(rows, "n_obs int, qvalue double, fold double")
    assert [r[0] for r in df.select(density.enriched_mask(df)).collect()] == [True, False, False, False]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 102), (101, 102), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 103: 100}


def test_components_of_long_paths_in_any_order(spark):
    """Labels that lie in no order on a path: what a label's nodes hear moves all of them."""
    one, other = np.random.default_rng(0).permutation(300), 1000 + np.random.default_rng(1).permutation(200)
    edges = [(int(a), int(b)) for path in (one, other) for a, b in zip(path[:-1], path[1:])]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(300)}, **{1000 + i: 1000 for i in range(200)}}


def test_cluster_metrics_by_hand(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 1, -1], "AAABBBA")), "c int, l string")
    got = {r["label"]: r for r in cluster.cluster_metrics(df, "c", "l").collect()}
    assert got["A"]["f1"] == 1.0 and got["A"]["retention"] == 0.75
    df = spark.createDataFrame(list(zip([0, 0, 0, 0], "AAAB")), "c int, l string")
    got = {r["label"]: r for r in cluster.cluster_metrics(df, "c", "l").collect()}
    assert got["A"]["precision"] == 0.75 and got["B"]["f1"] == 0.0


def test_two_blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (20, 8)), rng.normal(5, 0.1, (20, 8)), [[50.0] * 8]])
    df = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = dict(map(tuple, cluster.dbscan(df, "id", "v", eps=1.0).collect()))
    assert {got[i] for i in range(20)} == {0} and {got[i] for i in range(20, 40)} == {20} and got[40] == -1
    assert cluster.estimate_eps(df, "id", "v") > 0
    with pytest.raises(ValueError):
        cluster.cluster(df, "id", "v", method="magic")
    few = cluster.cluster_hits(df.withColumn("hit", F.col("id") < 3), "hit", "id", "v")
    assert {r["cluster"] for r in few.collect()} == {-1}


def sample(spark):
    rows = [(s, i, float(1 + (i * s) % 7), [np.cos(i + s), np.sin(i), 0.1 * s]) for s in (1, 2, 3) for i in range(30)]
    return spark.createDataFrame([(s, i, a, [float(y) for y in v]) for s, i, a, v in rows], "s int, i int, a double, psi array<double>")


def test_sample_embedding(spark):
    df = sample(spark)
    e = repertoire.sample_embedding(df, "s", "a", "psi", "psi").toPandas().set_index("s")
    eig = repertoire.sample_embedding(df, "s", "a", "psi", "psi", blocks=("second",), n_eigs=2).toPandas().set_index("s")
    for s, part in df.toPandas().groupby("s"):
        w = np.log1p(part["a"].to_numpy())
        w /= w.sum()
        psi = np.stack(part["psi"])
        assert np.allclose(e.loc[s, "mean"], w @ psi) and e.loc[s, "n_eff"] == pytest.approx(1 / (w @ w))
        second = (psi * w[:, None]).T @ psi
        assert np.allclose(e.loc[s, "second"], second[np.triu_indices(3)])
        assert np.allclose(eig.loc[s, "second"], np.linalg.eigvalsh(second)[::-1][:2])
        f = part["a"] / part["a"].sum()
        assert np.allclose(e.loc[s, "diversity"], [np.log(30), -(f * np.log(f)).sum(), -np.log((f * f).sum()), 1.0])
        assert np.exp(e.loc[s, "diversity"][2]) <= e.loc[s, "n_eff"] <= 30
    assert list(e.columns) == ["n_eff", "mean", "second", "diversity"]
    with pytest.raises(ValueError):
        repertoire.sample_embedding(df, "s", "a", "psi", blocks=("third",))
    with pytest.raises(Exception, match="degenerate"):
        repertoire.sample_weights(df.withColumn("a", F.lit(0.0)), "s", "a").collect()


def test_mmd(spark):
    e = repertoire.sample_embedding(sample(spark), "s", "a", "psi", blocks=("mean",)).persist()
    d = {(r.id_a, r.id_b): r.dist for r in repertoire.mmd_matrix(e, "s", block=2).collect()}
    m = {r["s"]: np.array(r["mean"]) for r in e.collect()}
    assert len(d) == 9 and all(d[a, b] == pytest.approx(np.linalg.norm(m[a] - m[b])) for a, b in d)
    with pytest.raises(Exception, match="single-clonotype"):
        repertoire.mmd_matrix(e.withColumn("n_eff", F.lit(1.0)), "s", unbiased=True).collect()
    h = e.withColumn("al", F.when(F.col("s") == 3, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))))
    s = {(r.id_a, r.id_b): r.dist for r in repertoire.stratified_mmd(h, "s", "al").collect()}
    assert s[1, 1] == 0 and s[1, 2] == d[1, 2] and np.isnan(s[3, 3]) and np.isnan(s[1, 3])


def test_coverage(spark):
    df = spark.createDataFrame([("x", i, 1 + (i % 4)) for i in range(60)], "s string, i int, a int")
    full = repertoire.hill(df, "s", "a").first()
    c = repertoire.sample_coverage(df, "s", "a").first()["coverage"]
    same = repertoire.coverage_hill(df, "s", "a", c).first()
    assert same["d0"] == pytest.approx(full["d0"], rel=0.02) and same["d2"] == pytest.approx(full["d2"], rel=0.05)
    assert repertoire.coverage_hill(df, "s", "a", 0.5).first()["d0"] < full["d0"]


def test_downsample(spark):
    out = repertoire.downsample(sample(spark).withColumn("a", F.col("a").cast("int")), "s", "i", "a", 20)
    assert {r[1] for r in out.groupBy("s").agg(F.sum("a")).collect()} == {20}


def test_cohort(spark):
    df, x = cloud(spark, 90)
    df = df.withColumn("batch", F.col("id") % 3)
    flat = cohort.residualize(df, "v", "batch").orderBy("id").toPandas()
    assert all(np.allclose(np.stack(p["v"]).mean(0), 0, atol=1e-9) for _, p in flat.groupby("batch"))
    one = cohort.correct_batch(df, "id", "v", "batch", n_clusters=1).orderBy("id").toPandas()
    assert np.allclose(np.stack(one["v"]), np.stack(flat["v"]))
    shifted = df.withColumn("v", F.transform("v", lambda y: y + F.col("batch") * 0.7))
    fixed = np.stack(cohort.correct_batch(shifted, "id", "v", "batch", n_clusters=2).orderBy("id").toPandas()["v"])
    means = [fixed[k::3].mean(0) for k in range(3)]
    assert np.abs(means[0] - means[2]).mean() < 0.7


def test_donors(spark, tmp_path):
    df = sample(spark).withColumn("donor", F.col("i") % 10).withColumn("locus", F.when(F.col("s") == 1, "TRA").otherwise("TRB")).filter("not (donor = 4 and locus = 'TRA')")
    args = (df.select("donor").distinct(), "donor", "locus", "a", "psi")
    space = cohort.fit_donors(df, *args, ["TRA", "TRB"], id_pca=2, min_clones=3)
    x = {r["donor"]: np.array(r["x"]) for r in space.transform(df, *args).collect()}
    m = np.stack(list(x.values()))
    assert m.shape == (10, space.spec.width) and np.allclose(m.mean(0), 0, atol=1e-9) and np.isfinite(m).all()
    space.save(spark, str(tmp_path / "d"))
    again = cohort.DonorSpace.load(spark, str(tmp_path / "d"))
    few = again.transform(df.filter("donor < 3"), df.select("donor").distinct().filter("donor < 3"), *args[1:])
    assert all(np.allclose(r["x"], x[r["donor"]]) for r in few.collect())
    few = cohort.fit_donors(df, *args, ["TRA"], id_pca=20)
    assert "TRA:identity" not in few.spec
    with pytest.raises(ValueError):
        cohort.fit_donors(df, *args, [])


def test_extra_channels(spark):
    df = sample(spark).withColumn("donor", F.col("i") % 10).withColumn("locus", F.lit("TRA"))
    args = (df.select("donor").distinct(), "donor", "locus", "a", "psi")
    own = df.groupBy("donor").agg(F.array(F.avg("a"), F.max("a")).alias("own"))
    space = cohort.fit_donors(df, *args, ["TRA"], id_pca=2, extra={"own": (own, "own", 2)}, coverage=False)
    assert "own" in space.spec and "TRA:coverage" not in space.spec
    x = np.stack([r["x"] for r in space.transform(df, *args, extra={"own": (own, "own", 2)}).collect()])
    assert np.allclose(x.mean(0), 0, atol=1e-9)
    for wrong in (None, {"other": (own, "own", 2)}, {"own": (own, "own", 1)}):
        with pytest.raises(ValueError, match="extra channels"):
            space.transform(df, *args, extra=wrong)


def test_spaces(spark):
    pool = formats.generate_background(spark, 80, (["V1"], ["J1"])).withColumn("locus", F.when(F.col("row_id") < 70, "TRB").otherwise("TRA"))
    protos = pool.filter("row_id < 10").select(F.col("row_id").alias("proto_idx"), "junction_aa")
    embed = lambda df: embedding.sequence_distances(df, protos, output="embedding")
    spaces = basis.fit_repertoire_spaces(pool, {"TRB": embed, "TRA": embed}, {"TRB": 4, "TRA": 4}, n_rff=8, n_rff_second=4)
    assert list(spaces) == ["TRB"] and spaces["TRB"].omega.shape == (4, 8) and spaces["TRB"].meta["length_scale"] > 0
    obs, bg = cloud(spark, 100)[0], cloud(spark, 150, seed=1)[0]
    b, z, w = basis.fit_density_space(obs, bg, "v", 3)
    both = np.stack([r["z"] for r in z.unionByName(w).collect()])
    assert len(both) == 250 and np.allclose(both.mean(0), 0, atol=1e-9) and np.allclose(both.var(0), b.variances)


def test_drivers_and_mismatches(spark):
    e = repertoire.sample_embedding(sample(spark), "s", "a", "psi", blocks=("mean",)).persist()
    spec = cohort.ChannelSpec({"a": [0], "b": [1]}, frozenset({"a"}))
    got = cohort.channel_drivers(spec, "a", e.filter("s = 1"), e.filter("s > 1"), sample(spark).filter("s = 1"), "psi", "i", top=3)
    assert got.count() == 3 and got.first()["channel"] == "a"
    with pytest.raises(ValueError, match="attributable"):
        cohort.channel_drivers(spec, "b", e, e, sample(spark), "psi", "i")
    df = spark.createDataFrame([(s,) for s in ("CAF", "CSF", "CSW", "AAAA")], "f string")
    assert sorted(r[0] for r in cohort.merge_one_mismatch(df, "f").collect()) == ["AAAA", "CAF", "CAF", "CAF"]


def test_approximate_neighbours_undercount(spark):
    df, _ = cloud(spark, 200)
    exact = dict(map(tuple, neighbors.ball_counts(df, df, "id", "v", 2.0).collect()))
    got = dict(map(tuple, neighbors.ann_ball_counts(df, df, "id", "v", 2.0).collect()))
    assert all(got[i] <= exact[i] for i in exact) and sum(got.values()) > 0.9 * sum(exact.values())


def test_channels(spark):
    ids = spark.createDataFrame([(i,) for i in range(5)], "k int")
    a = spark.createDataFrame([(i, [float(i), None if i == 2 else 1.0 * i]) for i in range(4)], "k int, a array<double>")
    x, spec = cohort.ChannelBuilder(ids, "k").add("one", a, "a", 2, True).add("two", a, "a", 2).add("one", a, "a", 2).build(standardize=False)
    assert spec.names == ["one", "two"] and spec["one"] == [0, 1, 4, 5] and spec.width == 6 and "two" in spec and spec.attributable == {"one"}
    got = {r["k"]: r["x"] for r in x.collect()}
    assert got[4] == [1.5, 1.0, 1.5, 1.0, 1.5, 1.0] and got[2][1] == 1.0
    with pytest.raises(ValueError, match="unknown channel"):
        spec["three"]
    report = cohort.channel_report(x, spec, lambda df, cols: float(len(cols)), base=1.0, mode="both", permuted=lambda df, i: df, n_permutations=3).toPandas()
    assert list(report["channel"]) == ["one", "two"] and list(report["delta_out"]) == [4.0, 2.0] and list(report["pvalue"]) == [1.0, 1.0]
    with pytest.raises(ValueError):
        cohort.channel_report(x, spec, lambda df, cols: 0.0, mode="up")


def test_survival(spark):
    rng = np.random.default_rng(1)
    risk = rng.standard_normal(200)
    t, e = rng.exponential(np.exp(-0.9 * risk)), rng.random(200) < 0.7
    df = spark.createDataFrame([(i, float(t[i]), bool(e[i]), [float(risk[i])], float(risk[i]), "ab"[int(risk[i] > 0)]) for i in range(200)], "id int, t double, e boolean, x array<double>, r double, g string")
    assert evaluate.cox_fit(df, "t", "e", "x", penalizer=0.0)[0] == pytest.approx(0.9, abs=0.3)
    c = evaluate.concordance(df, "t", "e", "r", "id").first()["cindex"]
    pairs = [(i, j) for i in range(200) if e[i] for j in range(200) if t[i] < t[j]]
    assert c == pytest.approx(np.mean([risk[i] > risk[j] for i, j in pairs]))
    assert evaluate.logrank(df, "t", "e", "g").first()["pvalue"] < 1e-4
    assert evaluate.cv_cindex(df, "id", "t", "e", "x", n_splits=3) > 0.6


def test_efron_ties(spark):
    """Newton's method on Efron's partial likelihood, written out."""
    rng = np.random.default_rng(8)
    x, t, e = rng.standard_normal(80), rng.integers(1, 9, 80), rng.random(80) < 0.7
    df = spark.createDataFrame([(int(t[i]), bool(e[i]), [float(x[i])]) for i in range(80)], "t int, e boolean, x array<double>")

    def loglik(b):
        out = 0.0
        for s in np.unique(t[e]):
            dead, risk = (t == s) & e, np.exp(b * x)
            out += b * x[dead].sum() - sum(np.log(risk[t >= s].sum() - l / dead.sum() * risk[dead].sum()) for l in range(dead.sum()))
        return out / 80 - 0.05 * b * b

    grid = np.linspace(-1, 1, 4001)
    assert evaluate.cox_fit(df, "t", "e", "x", penalizer=0.1)[0] == pytest.approx(grid[np.argmax([loglik(b) for b in grid])], abs=1e-3)


def test_folds_are_even(spark):
    df = spark.range(103).withColumn("y", F.col("id") % 4 == 0)
    sizes = evaluate.with_folds(df, "id", "y", 5, 0).groupBy("y", "fold").count().toPandas()
    assert all(g["count"].max() - g["count"].min() <= 1 and len(g) == 5 for _, g in sizes.groupby("y"))


def test_cindex_with_base_and_block(spark):
    rng = np.random.default_rng(1)
    risk = rng.standard_normal(120)
    t = rng.exponential(np.exp(-1.2 * risk))
    df = spark.createDataFrame([(i, float(t[i]), True, [float(risk[i]), 1.0], [float(risk[i] + rng.normal()), 0.0, float(rng.normal())]) for i in range(120)], "id int, t double, e boolean, base array<double>, block array<double>")
    assert evaluate.cv_cindex(df, "id", "t", "e", "block", n_splits=2, base="base", n_pc=1) > 0.65
    assert np.isnan(evaluate.cv_cindex(df, "id", "t", "e"))


def test_auc(spark):
    df = spark.createDataFrame([(i, [float(i % 10 >= 5) + 0.1 * (i % 3), float(i % 7)], i % 10 >= 5) for i in range(80)], "id int, x array<double>, y boolean")
    mean, dev = evaluate.cv_auc(df, "id", "x", "y", n_splits=3, n_repeats=1)
    assert mean > 0.95 and dev >= 0
    assert 0.5 < evaluate.held_out_auc(df.filter("id < 50"), df.filter("id >= 50"), "x", "y", pca_cols=1) <= 1


def test_fits(spark):
    x = np.random.default_rng(0).gamma(3.0, 2.0, 3000)
    got = evaluate.fit_distributions(spark.createDataFrame(pd.DataFrame({"x": x})), "x").set_index("name")
    assert got.loc["gamma", "a"] == pytest.approx(3.0, rel=0.1) and got.loc["gamma", "aic"] < got.loc["normal", "aic"]
    assert got.loc["gamma", "ks"] < 0.03 < got.loc["normal", "ks"]
    u = np.random.default_rng(1).random(2000)
    v = 20 + 2 / 0.2 * ((-np.log(u)) ** -0.2 - 1)
    got = evaluate.fit_distributions(spark.createDataFrame(pd.DataFrame({"x": v})), "x").set_index("name")
    assert got.loc["gev", "c"] == pytest.approx(0.2, abs=0.07) and got.loc["gev", "a"] == pytest.approx(20, abs=0.3) and got["aic"].idxmin() == "gev" and got.loc["gev", "ks"] < 0.03


def test_formats(spark, tmp_path):
    (tmp_path / "s1.x.tsv").write_text("count\tfreq\tcdr3nt\tcdr3aa\tv\td\tj\n5\t0.5\tTGT\tCASSF\tTRBV1\t.\tTRBJ1\n2\t0.5\tTGT\tCASF\tTRAV1,TRAV2\t.\tTRAJ1\n")
    df = formats.read_clonotypes(spark, str(tmp_path / "s1.x.tsv"))
    rows = {r["junction_aa"]: r for r in df.collect()}
    assert rows["CASSF"]["sample_id"] == "s1" and rows["CASSF"]["duplicate_count"] == 5 and rows["CASF"]["locus"] == "TRA" and rows["CASF"]["v_call"] == "TRAV1"
    with pytest.raises(ValueError, match="TRA"):
        formats.pick_locus(df)
    formats.write_table(df.select("junction_aa"), str(tmp_path / "o.parquet"))
    assert spark.read.parquet(str(tmp_path / "o.parquet")).count() == 2
    (tmp_path / "p.tsv").write_text("v_call\tj_call\tjunction_aa\n" + "".join(f"V{i}\tJ1\tCA{'S' * i}F\n" for i in range(9)))
    assert [r["junction_aa"] for r in formats.load_prototypes(spark, str(tmp_path / "p.tsv"), 3).orderBy("proto_idx").collect()] == ["CAF", "CASF", "CASSF"]
    with pytest.raises(ValueError):
        formats.load_prototypes(spark, "x", 0)
    protos = formats.make_prototypes(formats.generate_background(spark, 50, (["V1"], ["J1"])), n=10)
    assert sorted(r["proto_idx"] for r in protos.collect()) == list(range(10))


def test_library_and_regions(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">X1|TRBV1*01|Homo|F|V\nCAS..S\nF\n>X2|TRBV1*02|Homo|(P)|V\nAC\n")
    lib = formats.parse_library(spark, str(tmp_path / "g.fa"), "human")
    assert {(r["allele"], r["sequence"], r["functionality"]) for r in lib.collect()} == {("TRBV1*01", "CASSF", "F"), ("TRBV1*02", "AC", "P")}
    assert tuple(formats.allele_counts(lib.withColumn("locus", F.lit("TRB"))).first()) == ("human", "TRB", "TRBV1", 2, 1)
    rows = [(i, "human", "TRB", "V1", "J1", s, "a", "b", "c", "d", "e") for i, s in enumerate(["CAXTEAFF", "CTTEAFF"])]
    names = "row_id int, species string, locus string, v_call string, j_call string, junction_aa string, fwr1_aa string, cdr1_aa string, fwr2_aa string, cdr2_aa string, fwr3_aa string"
    out = {r["gene"]: r for r in formats.region_annotations(spark.createDataFrame(rows, names)).collect()}
    assert out["J1"]["jcdr3_aa"] == "TEAFF" and out["V1"]["fwr1_aa"] == "a"


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id", "event_type")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    plan = windowed_descriptor(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), "ts", "user_id", "event_type", "1 day", "0 seconds")
    q = plan.writeStream.outputMode("append").format("memory").queryName("neff").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("SELECT window_start, user_id, n_items, round(n_eff, 6) FROM neff").collect()}
    all_ = {tuple(r) for r in windowed_descriptor(src, "ts", "user_id", "event_type", "1 day").select("window_start", "user_id", "n_items", F.round("n_eff", 6)).collect()}
    assert got and got <= all_


def test_cli(spark, tmp_path, capsys):
    from plexivec import cli

    for s in ("s1", "s2"):
        (tmp_path / f"{s}.tsv").write_text("v_call\tj_call\tjunction_aa\tduplicate_count\n" + "".join(f"TRBV{i % 3}\tTRBJ1\tCA{'SDEF'[i % 4] * (i % 5 + 1)}{s[1]}F\t{i + 1}\n".replace("1F", "AF").replace("2F", "GF") for i in range(20)))
    (tmp_path / "p.tsv").write_text("v_call\tj_call\tjunction_aa\n" + "".join(f"V{i}\tJ1\tCA{'S' * i}F\n" for i in range(6)))
    cli.main(["embed", "clonotypes", str(tmp_path / "s1.tsv"), "--prototypes", str(tmp_path / "p.tsv"), "-o", str(tmp_path / "e.parquet")])
    e = spark.read.parquet(str(tmp_path / "e.parquet"))
    assert e.count() == 20 and "e5" in e.columns
    genes = spark.createDataFrame([("V", f"V{i}*01", "ACDEF"[i % 5] * 3) for i in range(6)] + [("J", "J1*01", "FFF")], "component string, allele string, seq string")
    embedding.bake_germline(genes).write.parquet(str(tmp_path / "g.parquet"))
    cli.main(["embed", "clonotypes", str(tmp_path / "s1.tsv"), "--prototypes", str(tmp_path / "p.tsv"), "--germline", str(tmp_path / "g.parquet"), "--pca", "2", "-o", str(tmp_path / "z.parquet")])
    assert spark.read.parquet(str(tmp_path / "z.parquet")).columns[-1] == "e1"
    cli.main(["embed", "repertoires", str(tmp_path / "s1.tsv"), str(tmp_path / "s2.tsv"), "--prototypes", str(tmp_path / "p.tsv"), "-o", str(tmp_path / "phi.parquet"), "--mmd", str(tmp_path / "mmd.parquet"), "--n-rff", "16", "--n-components", "3"])
    assert spark.read.parquet(str(tmp_path / "phi.parquet")).count() == 2 and spark.read.parquet(str(tmp_path / "mmd.parquet")).count() == 2


def test_theory(spark):
    pool = formats.generate_background(spark, 60, (["V1"], ["J1"]), lengths=(10, 10)).withColumnRenamed("row_id", "id").persist()
    protos = pool.filter("id < 20").withColumn("proto_idx", F.col("id"))
    r = theory.distance_correlation(pool, "id", "junction_aa").first()
    assert r["n_pairs"] == 60 * 59 / 2 and r["r"] > 0.1
    drift = {x["k"]: x for x in theory.mutation_drift(pool, protos, "junction_aa", max_mut=3, n_rep=2).collect()}
    assert drift[0]["mean"] == drift[0]["std"] == 0 and drift[1]["mean"] < drift[3]["mean"]
    same = theory.prototype_correlation(pool, protos, protos, "id", "junction_aa").first()["r"]
    assert same == pytest.approx(1.0)
    c = theory.neighbour_convergence(pool, protos, "id", "junction_aa", n_components=5, scales=(1.0, 2.0)).toPandas()
    assert list(c["scale"]) == [1.0, 2.0] and (c["radius"] > 0).all()


def test_concordance_blocks(spark):
    """Many blocks of times and risks, ties, nulls and NaN against a join of all pairs."""
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 30)), [True, False, None][rng.integers(0, 3)], [None, float("nan"), float(rng.integers(0, 40))][min(2, rng.integers(0, 20))]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, t int, e boolean, r double").unionByName(spark.createDataFrame([(-1, None, True, 1.0)], "id long, t int, e boolean, r double"))
    p = df.filter("e").alias("a").join(df.alias("b"), F.expr("a.t < b.t or (a.t = b.t and not b.e)"))
    want = tuple(p.agg(F.expr("count_if(a.r > b.r)"), F.expr("count_if(a.r = b.r)"), F.count("*")).first())
    for block in (7, 50, 20_000):
        assert tuple(evaluate.concordance(df, "t", "e", "r", "id", block=block).first())[:3] == want
    assert evaluate.concordance(df.filter("not e"), "t", "e", "r", "id").first()["cindex"] is None


def test_survival_queries_take_all_rows(spark):
    whole = registry.survival(spark, "/root/testdata/sf0.01").count()
    assert whole == spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()


def test_libraries_are_whole(spark):
    """Every brand and part of a line item is in a library, whatever its order."""
    got = registry.QUERIES["library_consistency_query"](spark, "/root/testdata/sf0.01")
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").filter("l_linestatus in ('F', 'O')")
    assert got.selectExpr("sum(n_both + n_only_a + n_only_b)").first()[0] == lines.select("l_partkey").distinct().count()


def test_distance_correlations_take_all_rows(spark):
    """Sums over blocks against all pairs, and the queries' numbers of pairs."""
    sf = "/root/testdata/sf0.001"
    v = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id < 60")
    x = np.stack(v.orderBy("vec_id").toPandas()["embedding"].to_list()).astype(float)
    i, j = np.triu_indices(len(x), 1)
    want = np.corrcoef(*[np.sqrt(((z[i] - z[j]) ** 2).sum(1)) for z in (x, x[:, :32])])[0, 1]
    got = neighbors.distance_corr(v.withColumn("u", F.slice("embedding", 1, 32)), "vec_id", "embedding", "u", block=16).first()
    assert got["n_pairs"] == len(i) and got["r"] == pytest.approx(want)

    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert registry.QUERIES["pairwise_corr"](spark, sf).first()["n_pairs"] == n * (n - 1) // 2
    assert registry.QUERIES["weighted_mass"](spark, sf).count() == n

    s = registry.junctions(spark, "/root/testdata/sf0.01").filter("p_partkey < 90")
    few = s.filter("p_partkey < 20")
    got = theory.distance_correlation(s, "p_partkey", "seq", few).first()
    e = embedding.sequence_distances(s.select("p_partkey", "seq"), few.select(F.col("p_partkey").alias("proto_idx"), "seq"), "seq", "e").orderBy("p_partkey").toPandas()
    x, p = np.stack(e["e"].to_list()).astype(float), few.count()
    pairs = [(a, b) for a in range(len(x)) for b in range(p) if a < b or a >= p]
    a, b = np.array(pairs).T
    assert got["n_pairs"] == len(pairs) and got["r"] == pytest.approx(np.corrcoef(x[a, b], np.sqrt(((x[a] - x[b]) ** 2).sum(1)))[0, 1])


def test_projection_fits_all_rows(spark):
    """A third of the rows are equal vectors: the mean is that of all rows, also of a large table without a key."""
    df = spark.range(210_000).select(F.when(F.col("id") % 3 == 0, F.array(F.lit(9.0), F.lit(-9.0))).otherwise(F.array(F.col("id") % 7 * 1.0, F.col("id") % 11 * 1.0)).alias("v"))
    want = df.agg(F.avg(F.col("v")[0]), F.avg(F.col("v")[1])).first()
    assert basis.fit_projection(df, "v", 2).mean == pytest.approx(tuple(want), rel=1e-12)


def test_knee_of_all_values(spark):
    """The fit by sums is that of all values on the driver; ties, nulls, a flat and an empty column."""
    rng = np.random.default_rng(8)
    for values in (rng.exponential(1.0, 700), np.round(np.concatenate([rng.normal(1, 0.05, 600), rng.uniform(1, 9, 60)]), 2), rng.pareto(1.5, 500)):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "d double").repartition(5)
        want = cluster.knee(np.sort(values))
        at = np.sort(values)
        got = cluster.knee_of_column(df, "d", direct=0)
        assert cluster.knee_of_column(df, "d") == want
        assert (got is None) == (want is None)
        if want is not None:
            assert got in at and abs(np.searchsorted(at, got) - np.searchsorted(at, want)) <= 1
    flat = spark.createDataFrame([(1.0,)] * 50, "d double")
    assert cluster.knee_of_column(flat, "d", direct=0) is None and cluster.knee_of_column(flat.limit(0), "d") is None
