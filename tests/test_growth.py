"""What work grows with: plans and counts of jobs that larger tables depend on."""

import numpy as np
from pyspark.sql import functions as F

from plexivec import registry
from plexivec.functions.names import mutate_places
from plexivec.learn import sequences, training
from plexivec.operators import evaluate, hierarchy, theory
from plexivec.operators.neighbors import ball_counts
from tests.conftest import SMALL
from tests.test_hierarchy import plain_tree


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_mutation_drift_deals_rows_to_tasks_and_keeps_no_embedding(spark):
    s = registry.junctions(spark, SMALL)
    out = theory.mutation_drift(s, s.filter("p_partkey < 9").withColumn("proto_idx", F.col("p_partkey")), "seq", 3, 2)
    said = plan(out)
    assert "REPARTITION_BY_NUM" in said and said.count("ArrowEvalPython") == 1
    assert [r["k"] for r in out.collect()] == [0, 1, 2, 3]


def test_places_are_drawn_once_a_sequence(spark):
    """Not once for each letter of it; letters away from the places stay."""
    df = spark.createDataFrame([("ACDEFGHIKL" * 100, k) for k in (0, 1, 40, 2000)] + [("AC", 1), ("", 1), (None, 1)], "s string, k int")
    got = [r[0] for r in df.select(mutate_places(F.col("s"), F.lit("x"), F.col("k"))).collect()]
    assert got[0] == "ACDEFGHIKL" * 100 and got[4:] == ["AC", "", None]
    moved = [sum(a != b for a, b in zip(got[0], g)) for g in got[:4]]
    assert moved[1] <= 1 and 30 <= moved[2] <= 40 and moved[3] > 900 and all(len(g) == 1000 and g[0] + g[-1] == "AL" for g in got[:4])
    assert "array_contains" not in plan(df.select(mutate_places(F.col("s"), F.lit("x"), F.col("k"))))


def test_neighbour_convergence_compares_equal_sequences_once(spark, monkeypatch):
    """One join for all radii, over distinct sequences; the same ranks as counts over all rows."""
    s = registry.junctions(spark, SMALL).selectExpr("p_partkey as id", "left(seq, 4) as seq").persist()
    seen, join = [], theory.join_within

    def watched(a, b, *rest):
        seen.append((a.count(), b.count()))
        return join(a, b, *rest)

    monkeypatch.setattr(theory, "join_within", watched)
    c = theory.neighbour_convergence(s, s.filter("id < 20").withColumn("proto_idx", F.col("id")), "id", "seq", 4, scales=(0.5, 1.2)).collect()
    n = s.select("seq").distinct().count()
    assert seen == [(n, n)] and n < s.count() and len(c) == 2
    protos = s.filter("id < 20").withColumn("proto_idx", F.col("id"))
    e = theory.sequence_distances(s, protos, "seq", "e")
    z = theory.transform(e, theory.fit_projection(e, "e", 4), "e", "z")
    near = theory.one_mismatch_counts(s, "id", "seq", "near")
    for r in c:
        counts = ball_counts(z, z, "id", "z", r["radius"] ** 2, backend="exact")
        assert abs(theory.spearman(counts.join(near, "id"), "n", "near").first()[0] - r["rho"]) < 1e-9


def test_batches_are_written_once_and_are_those_of_the_hash(spark):
    """A round reads its own folder; the rows are those that a filter of all rows by the hash of turn and key gives."""
    rows = spark.range(500).select(F.col("id").alias("key"), F.array(F.col("id").cast("int")).alias("frame"))
    rounds, batches, seed = 7, 3, 5
    got = training._dealt(rows, "key", rounds, batches, seed)
    assert {r[0] for r in got.select("round").distinct().collect()} == set(range(rounds))
    for k in range(rounds):
        turn, at = divmod(k, batches)
        want = rows.filter(F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), F.col("key")), F.lit(batches)) == at)
        mine = got.filter(F.col("round") == k)
        assert sorted(r["frame"][0] for r in mine.collect()) == sorted(r["key"] for r in want.collect())
        assert f"round={k}" in mine.inputFiles()[0] or "PartitionFilters: [isnotnull(round" in plan(mine)


def test_the_convolution_is_that_of_one_hot_windows():
    rng = np.random.default_rng(1)
    net = sequences.EncoderNet(2)
    flat = rng.standard_normal(net.size)
    p, frames, target = net.views(flat), rng.integers(0, 21, (9, 40)), rng.standard_normal((9, 2))
    padded = np.full((9, 44), 21)
    padded[:, 2:42] = frames
    hot = np.eye(22)[np.lib.stride_tricks.sliding_window_view(padded, 5, 1)][..., :21].reshape(360, -1)
    a = np.maximum(hot @ p["conv"] + p["conv0"], 0).reshape(9, -1)
    want = np.maximum(a @ p["deep"] + p["deep0"], 0) @ p["out"] + p["out0"]
    assert np.allclose(sequences.encoded(p, frames)[0], want, atol=1e-9)
    g, cols = np.zeros(net.size), {"frame": frames, "target": target}
    net.loss(p, cols, net.views(g))
    for i in rng.choice(105 * 16, 20, replace=False):  # places of the convolution, by differences
        step = np.zeros(net.size)
        step[i] = 1e-5
        slope = (net.loss(net.views(flat + step), cols, None) - net.loss(net.views(flat - step), cols, None)) / 2e-5
        assert abs(slope - g[i]) <= 1e-4 * max(1, abs(slope))


def test_reconstruction_searches_no_neighbours(spark):
    df = spark.createDataFrame([(1, "CAAF", [0.0], "CAAF"), (2, "CADF", [0.0], "CAAF"), (3, "CADF", [1.0], "CADF")], "k long, s string, c array<double>, r string")
    whole = evaluate.codec_losslessness(df, "k", "s", "c", "r").first().asDict()
    got = evaluate.reconstruction(df, "k", "s", "r")
    assert got.first().asDict() == {c: v for c, v in whole.items() if c not in ("collision_rate", "ceiling")} and "Join" not in plan(got)


def test_distance_correlation_is_one_pass_over_rows(spark):
    """No embedding is written or shuffled; the sums are those of all pairs."""
    s = registry.junctions(spark, SMALL).select("p_partkey", "seq")
    protos = s.filter("p_partkey < 12")
    out = theory.distance_correlation(s, "p_partkey", "seq", protos)
    said = plan(out)
    assert "MapInPandas" in said and "CoGroup" not in said and "array" not in said
    e = theory.sequence_distances(s, protos.withColumn("proto_idx", F.col("p_partkey")), "seq", "e").select("p_partkey", "e").toPandas().sort_values("p_partkey")
    x, ids = np.stack(e["e"]).astype(float), e["p_partkey"].to_numpy()
    at = {p: i for i, p in enumerate(sorted(ids[ids < 12]))}
    pairs = [(x[i, at[p]], np.sqrt(((x[i] - x[list(ids).index(p)]) ** 2).sum())) for i, k in enumerate(ids) for p in at if k != p and (k not in at or k < p)]
    r, n = out.first()
    assert n == len(pairs) and abs(r - np.corrcoef(np.array(pairs).T)[0, 1]) < 1e-9


def test_clusters_of_a_deep_tree_take_windows_not_rounds(spark, monkeypatch):
    """A tree of clusters as deep as it has clusters: no more jobs than for a flat one, and the same clusters in small windows."""
    x = np.concatenate([[v, v + 0.01] for v in np.cumsum(np.arange(1, 31) * 0.5)])[:, None]
    edges, ids = plain_tree(x, 1), spark.range(len(x)).withColumnRenamed("id", "_id")
    tree = spark.createDataFrame([(float(w), i, j) for w, i, j in edges], "w double, a long, b long")
    found = []
    for window in (65536, 25):
        calls, stage = [], hierarchy.staged
        monkeypatch.setattr(hierarchy, "WINDOW", window)
        monkeypatch.setattr(hierarchy, "staged", lambda df, name: calls.append(name) or stage(df, name))  # noqa: B023
        joined, ended = hierarchy._condensed(tree, ids, 2, min(w for w, _, _ in edges))
        monkeypatch.setattr(hierarchy, "staged", stage)
        found.append((sorted(map(tuple, joined.select("_id", "e.w", "cluster").collect())), sorted(map(tuple, ended.collect()))))
        assert len(calls) <= 2 + 6 * -(-len(edges) // window)
    assert found[0] == found[1] and len(found[0][0]) == len(x) and len(found[0][1]) == 58
