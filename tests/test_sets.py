"""The network on weighted sets: gradients, sums over parts, learning a planted cluster, kept with its basis."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexivec.learn import sets
from plexivec.learn.sets import SetNet, clouds, pooled, records_gradient, set_score, train_set_encoder
from plexivec.operators.basis import fit_projection, transform


def _plain(net, p, z, w):
    """Normaliser and pooled vectors of one sample held whole."""
    _, b, logits = net.records(p, z, w)
    top = logits.max(0)
    e = np.exp(logits - top)
    return np.log(e.sum(0)) + top, e.T @ b / e.sum(0)[:, None]


def _sample(rng, n, planted, width=6):
    z = rng.standard_normal((n, width))
    if planted:
        z[:6] = 2.5 + 0.05 * rng.standard_normal((6, width))
    return z


@pytest.fixture(scope="module")
def toy(spark):
    """Samples of which every other one has a tight cluster, and rows that count for nothing."""
    rng = np.random.default_rng(0)
    rows = [(f"s{c:03d}", z.tolist(), float(w)) for c in range(80) for z, w in zip(_sample(rng, int(rng.integers(40, 80)), c % 2), rng.random(80) + 0.1)]
    rows += [("s000", None, 1.0), ("s000", [0.0] * 6, 0.0), ("s000", [0.0] * 6, None), ("s000", [0.0] * 6, float("nan")), (None, [0.0] * 6, 1.0), ("empty", None, 1.0)]
    labels = [(f"s{c:03d}", c % 2) for c in range(80)] + [("nobody", 1), ("empty", 0)]
    return spark.createDataFrame(rows, "sid string, z array<double>, w double").cache(), spark.createDataFrame(labels, "sid string, y int")


def test_samples_of_no_round_are_not_written(spark, toy, monkeypatch):
    """Learning stages the samples of its rounds and those kept apart, telling stages none; all are told."""
    df, labels = toy
    seen, staging = [], sets.clouds

    def watched(*args, **kwargs):
        seen.append(staging(*args, **kwargs))
        return seen[-1]

    monkeypatch.setattr(sets, "clouds", watched)
    m = train_set_encoder(df, labels, "sid", "z", "w", "y", task="classification", rounds=2, batch_samples=8, every=2, queries=2, hidden=4)
    assert m.predict(df, "sid", "z", "w").count() == 80 and len(seen) == 1
    name = F.col("sample")
    written = seen[0].select(name, sets.held_out(name, 0.2).alias("apart")).distinct()
    own = df.filter("w > 0 and not isnan(w) and z is not null and sid is not null").select("sid").distinct()
    assert written.filter("apart").count() == own.filter(sets.held_out(F.col("sid"), 0.2)).count()
    assert 0 < written.filter("not apart").count() < 40 < own.filter(~sets.held_out(F.col("sid"), 0.2)).count()


def test_all_samples_and_records_teach(spark, toy, monkeypatch):
    """Without a size of batches of the caller's own, few rounds take larger batches, and leave out no sample and no record."""
    df, labels = toy
    monkeypatch.setattr(sets, "BATCH_SAMPLES", 8, raising=False)
    monkeypatch.setattr(sets, "MAX_SEEN", 20, raising=False)
    seen, embed = [], sets.pooled
    monkeypatch.setattr(sets, "pooled", lambda net, params, rows: seen.append(rows) or embed(net, params, rows))
    train_set_encoder(df, labels, "sid", "z", "w", "y", task="classification", rounds=4, every=4, queries=2, hidden=4)
    name, own = F.col("sample"), df.filter("w > 0 and not isnan(w) and z is not null and sid is not null")
    teach = own.filter(~sets.held_out(F.col("sid"), 0.2))
    shown = [x.select(name, "row").filter(~sets.held_out(name, 0.2)) for x in seen[:4]]
    assert len(seen) == 5 and min(x.count() for x in shown) < 0.45 * teach.count()  # the fifth tells the samples kept apart
    union = shown[0].unionByName(shown[1]).unionByName(shown[2]).unionByName(shown[3]).distinct()
    assert union.count() == teach.count() and union.select(name).distinct().count() == teach.select("sid").distinct().count()


@pytest.mark.parametrize("turn", [0, 2])
def test_two_turns_show_all_records(spark, turn):
    rows = spark.range(4000).select((F.col("id") % 10).alias("sample"), F.col("id").alias("row"))
    got = rows.groupBy("sample").agg(*[F.avg(sets._shown(turn + k, 0.2, 3).cast("int")).alias(f"s{k}") for k in (0, 1)], F.min((sets._shown(turn, 0.2, 3) | sets._shown(turn + 1, 0.2, 3)).cast("int")).alias("all")).collect()
    assert len(got) == 10 and all(r["all"] == 1 and min(r["s0"], r["s1"]) > 0.1 for r in got) and min(r["s0"] for r in got) < 0.7


@pytest.mark.parametrize("hot", [False, True])
def test_batches_of_any_size_have_the_same_gradient(spark, toy, monkeypatch, hot):
    """By tables, with large samples looked up apart or not, as by the driver."""
    from plexivec.plans import skew

    df, labels = toy
    if hot:
        monkeypatch.setattr(skew, "MIN_HOT", 60)
    rng, net = np.random.default_rng(8), SetNet(6, 4, 3)
    flat = net.start(0) + rng.normal(size=net.size) * 0.3
    rows = clouds(df, "sid", "z", "w", deals=2)
    taught = labels.filter("sid < 's050'").select(F.col("sid").alias("sample"), F.col("y").cast("double"))
    taught = taught.join(rows.groupBy("sample").agg(F.count("*").alias("n")), "sample").cache()
    got, m = sets.batch_gradient(net, flat, rows, taught, "classification", rows.count(), 80)
    met = pooled(net, flat, rows).join(taught, "sample").collect()
    pools, g = np.array([r["pooled"] for r in met]).reshape(len(met), 3, 4), np.zeros(net.size)
    _, d = net.head_loss(net.views(flat), net.views(g), pools, np.array([r["y"] for r in met]), "classification")
    state = {r["sample"]: (np.array(r["norm"]), pools[i], d[i]) for i, r in enumerate(met)}
    assert m == len(met) == 50 and np.allclose(got, g + records_gradient(net, flat, rows, state))


def test_sums_of_a_sample_meet_across_batches(spark, monkeypatch):
    """Without a row for each query and a window; -0.0 and NaN as samples are one each."""
    monkeypatch.setattr(sets, "MAX_HELD", 1)
    monkeypatch.setattr(sets, "AT_ONCE", 2)
    rng, net = np.random.default_rng(4), SetNet(3, 4, 2)
    rows = [(float(n), z.tolist(), float(w)) for n in (0.0, -0.0, float("nan"), 1.0, 2.0) for z, w in zip(rng.standard_normal((23, 3)) * 9, rng.random(23) + 0.1)]
    flat = net.start(0) + rng.normal(size=net.size)
    df = spark.createDataFrame(rows, "sample double, z array<double>, w double").repartition(3)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "3")
    try:
        out = pooled(net, flat, df)
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
        found = {str(r["sample"] + 0.0): r for r in out.collect()}
    finally:
        spark.conf.set(setting, before)
    assert sorted(found) == ["0.0", "1.0", "2.0", "nan"] and out.count() == 4
    for n, r in found.items():
        own = [x for x in rows if str(x[0] + 0.0) == n]
        norm, pool = _plain(net, net.views(flat), np.array([x[1] for x in own]), np.array([x[2] for x in own]))
        assert np.allclose(r["norm"], norm) and np.allclose(np.reshape(r["pooled"], pool.shape), pool)


@pytest.mark.parametrize("task", sets.TASKS)
def test_gradient_is_the_slope(task):
    rng, net = np.random.default_rng(1), SetNet(3, 5, 2)
    parts = [(rng.standard_normal((n, 3)), rng.random(n) + 0.1) for n in (4, 1, 7)]
    y, flat = np.array([1.0, 0.0, 1.0]), net.start(2) + rng.normal(size=net.size) * 0.3

    def loss(at):
        p = net.views(at)
        return net.head_loss(p, net.views(np.zeros(net.size)), np.stack([_plain(net, p, *x)[1] for x in parts]), y, task)[0]

    p, g = net.views(flat), np.zeros(net.size)
    met = [_plain(net, p, *x) for x in parts]
    _, d = net.head_loss(p, net.views(g), np.stack([m[1] for m in met]), y, task)
    for (z, w), (norm, pool), back in zip(parts, met, d):
        of = np.zeros(len(z), int)
        net.records_gradient(p, net.views(g), z, w, norm[None][of], pool[None][of], back[None][of])
    for i in range(net.size):
        step = np.zeros(net.size)
        step[i] = 1e-6
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-6 - g[i]) < 1e-4 * (1 + abs(g[i]))


def test_parts_of_a_sample_add_up(spark, toy, monkeypatch):
    monkeypatch.setattr(sets, "PART_ROWS", 7)
    monkeypatch.setattr(sets, "MAX_HELD", 3)
    df, _ = toy
    rng, net = np.random.default_rng(3), SetNet(6, 4, 3)
    flat = net.start(0) + rng.normal(size=net.size)
    rows = clouds(df, "sid", "z", "w", deals=3)
    assert rows.count() == df.filter("sid is not null and z is not null and w > 0 and not isnan(w)").count()
    assert rows.groupBy("sample").agg(F.count_distinct("deal").alias("n")).filter("n > 1").count() == 0
    found = {r["sample"]: r for r in pooled(net, flat, rows).collect()}
    assert set(found) == {f"s{c:03d}" for c in range(80)}
    own, p, state, g = rows.toPandas(), net.views(flat), {}, np.zeros(net.size)
    for name, x in own.groupby("sample"):
        norm, pool = _plain(net, p, np.stack(x["z"]), x["w"].to_numpy())
        assert np.allclose(found[name]["norm"], norm) and np.allclose(np.reshape(found[name]["pooled"], pool.shape), pool)
        if name < "s050":  # other samples belong to no batch
            state[name] = norm, pool, rng.normal(size=pool.shape)
            of = np.zeros(len(x), int)
            net.records_gradient(p, net.views(g), np.stack(x["z"]), x["w"].to_numpy(), *(s[None][of] for s in state[name]))
    assert np.allclose(records_gradient(net, flat, rows, state), g)


def test_large_logits_do_not_overflow(spark):
    net = SetNet(1, 1, 1)
    flat = np.ones(net.size)
    df = spark.createDataFrame([(1, [900.0], 1.0), (1, [1.0], 5.0), (2, [2000.0], 1e-12)], "sid long, z array<double>, w double").repartition(3)
    out = {r["sample"]: r for r in pooled(net, flat, clouds(df, "sid", "z", "w")).collect()}
    assert np.allclose(out[1]["pooled"], 902.0) and np.allclose(out[2]["pooled"], 2002.0)


def test_tells_samples_with_a_planted_cluster(spark, toy):
    df, labels = toy
    m = train_set_encoder(df, labels, "sid", "z", "w", "y", task="classification", rounds=30, every=15, batch_samples=200, queries=4, hidden=16, rate=1e-2)
    out = m.predict(df, "sid", "z", "w")
    assert out.count() == 80 and out.filter("predicted < 0 or predicted > 1").count() == 0
    apart = out.join(labels, "sid").filter(sets.held_out(F.col("sid"), 0.2))
    assert set_score(apart, "y", "classification") > 0.8
    again = m.predict(df.repartition(7), "sid", "z", "w")
    assert out.join(again.withColumnRenamed("predicted", "b"), "sid").filter("abs(predicted - b) > 1e-9").count() == 0
    scaled = m.predict(df.withColumn("w", F.col("w") * 3), "sid", "z", "w").withColumnRenamed("predicted", "b")
    assert out.join(scaled, "sid").filter("abs(predicted - b) > 1e-9").count() == 0  # only shares count


def test_regression_and_errors(spark, toy):
    df, labels = toy
    y = df.filter("z is not null and w > 0 and not isnan(w)").groupBy("sid").agg((F.sum(F.when(F.col("z")[0] > 0, F.col("w")).otherwise(0)) / F.sum("w") * 100 + 5).alias("y"))
    m = train_set_encoder(df, y, "sid", "z", "w", "y", rounds=30, every=15, batch_samples=30, queries=2, hidden=16, least=None, rate=1e-2)
    out = m.predict(df, "sid", "z", "w").join(y, "sid")
    assert set_score(out, "y", "regression") > 0.6
    train = lambda lab, **kw: train_set_encoder(df, lab, "sid", "z", "w", "y", **{"rounds": 1} | kw)
    for lab, kw in ((labels, {"task": "ranking"}), (labels.limit(0), {}), (labels.unionByName(labels), {}), (y, {"task": "classification"})):
        with pytest.raises(ValueError):
            train(lab, **kw)
    with pytest.raises(ValueError):
        train_set_encoder(df.limit(0), labels, "sid", "z", "w", "y", rounds=1)
    assert m.predict(df.limit(0), "sid", "z", "w").count() == 0
    one = out.withColumn("y", F.lit(1))
    assert set_score(one, "y", "classification") == 0.5 and set_score(one, "y", "regression") == 0.0


def test_kept_with_its_basis(spark, toy, tmp_path):
    df, labels = toy
    basis = fit_projection(df.filter("z is not null"), "z", 4)
    x = transform(df.withColumnRenamed("z", "v"), basis, "v", "z")
    m = train_set_encoder(x, labels, "sid", "z", "w", "y", task="classification", rounds=2, every=2, queries=2, hidden=4)
    with pytest.raises(ValueError, match="different bases"):
        m.predict(df, "sid", "z", "w")
    protos = spark.createDataFrame([(0, "CASSF"), (1, "CATTF")], "proto_idx long, junction_aa string")
    path = str(tmp_path / "m")
    sets.save_set_encoder(spark, path, m, basis, protos)
    back, kept = sets.load_set_encoder(spark, path, protos)
    assert kept.fingerprint == basis.fingerprint and back.task == "classification"
    a, b = (f.predict(x, "sid", "z", "w").orderBy("sid").collect() for f in (m, back))
    assert len(a) == 80 and np.allclose([r[1] for r in a], [r[1] for r in b])
    with pytest.raises(ValueError, match="other prototypes"):
        sets.load_set_encoder(spark, path, protos.filter("proto_idx = 0"))
    sets.load_set_encoder(spark, path, protos.filter("proto_idx = 0"), verify=False)
    other = fit_projection(df.filter("z is not null"), "z", 3)
    with pytest.raises(ValueError, match="different bases"):
        sets.save_set_encoder(spark, path, m, other, protos)
    line = json.loads(spark.read.text(path).first()[0])
    line["meta"]["task"] = "regression"
    spark.createDataFrame([(json.dumps(line),)], "value string").coalesce(1).write.text(str(tmp_path / "changed"))
    with pytest.raises(ValueError, match="changed"):
        sets.load_set_encoder(spark, str(tmp_path / "changed"), protos)
