"""Networks on token frames: gradients against differences, training over partitions, codecs kept with their prototypes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexivec.functions.names import tokens
from plexivec.learn import sequences
from plexivec.learn.sequences import CodecNet, DecoderNet, EncoderNet
from plexivec.learn.training import fit, load_params, summed
from plexivec.operators.embedding import sequence_distances
from plexivec.operators.evaluate import codec_losslessness


@pytest.fixture(scope="module")
def pool(spark):
    """Sequences with ends in common and a free middle, and their distances to the first 24."""
    rng = np.random.default_rng(0)
    rows = [(i, "CAS" + "".join(rng.choice(list("ADEGKLNPQRSTVY"), rng.integers(3, 9))) + "EQYF") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, junction_aa string")
    protos = df.filter("id < 24").withColumn("proto_idx", F.col("id"))
    return sequence_distances(df, protos, output="embedding").cache(), protos


@pytest.mark.parametrize("net", [EncoderNet(3), DecoderNet(3), CodecNet(3, 0.7)])
def test_gradients_are_the_slopes(net):
    rng = np.random.default_rng(1)
    cols = {"frame": rng.integers(0, 21, (5, 40)), "target": rng.normal(size=(5, 3)), "code": rng.normal(size=(5, 3))}
    flat, g = net.start(3) + rng.normal(size=net.size) * 0.01, np.zeros(net.size)
    net.loss(net.views(flat), cols, net.views(g))
    for i in rng.integers(0, net.size, 60):
        step = np.zeros(net.size)
        step[i] = 1e-6
        slope = (net.loss(net.views(flat + step), cols, None) - net.loss(net.views(flat - step), cols, None)) / 2e-6
        assert abs(slope - g[i]) < 1e-4 * (1 + abs(slope))


def test_sums_do_not_depend_on_partitions(spark):
    net = EncoderNet(2)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.integers(0, 21, 40).tolist(), rng.normal(size=2).tolist()) for i in range(50)], "key long, frame array<int>, target array<double>")
    a, b = (summed(net, net.start(0), df.repartition(k)) for k in (1, 5))
    assert a[1] == b[1] == 50 and abs(a[0] - b[0]) < 1e-9 and np.allclose(a[2], b[2])
    found = fit(net, df, "key", rounds=3, batch_rows=20, every=1, validation=df)
    kept, meta = load_params(spark, found.path)
    assert np.allclose(kept, found.params) and meta["loss"] == min(found.losses)
    with pytest.raises(ValueError):
        fit(net, df.limit(0), "key")


def test_regressor_learns(spark, pool):
    df = pool[0].withColumn("y", -F.length("junction_aa").cast("double"))
    m = sequences.train_regressor(df.unionByName(df.limit(1).withColumn("y", F.lit(None).cast("double"))), "id", "junction_aa", "y", rounds=30)
    assert m.predict(df, "junction_aa").agg(F.corr("y", "predicted")).first()[0] > 0.8
    assert m.predict(spark.createDataFrame([(None,)], "s string"), "s").first()["predicted"] is not None


def test_encoder_learns_and_is_kept(spark, pool, tmp_path):
    df, protos = pool
    m = sequences.train_encoder(df, "id", "junction_aa", "embedding", rounds=40)
    out = m.encode(df, "junction_aa", "vector")
    assert m.losses[-1] < m.losses[0] and sequences.mean_cosine(out, "vector", "embedding") > 0.9
    sequences.save_codec(spark, str(tmp_path / "m"), m, protos)
    again = sequences.load_codec(spark, str(tmp_path / "m"), protos)
    a, b = (x.code(df, "junction_aa").orderBy("id").limit(10).collect() for x in (m, again))
    assert np.allclose([r["code"] for r in a], [r["code"] for r in b])
    with pytest.raises(ValueError, match="other prototypes"):
        sequences.load_codec(spark, str(tmp_path / "m"), protos.limit(20))
    sequences.load_codec(spark, str(tmp_path / "m"), protos.limit(20), verify=False)


def test_decoder_and_codec_learn(pool):
    df = pool[0]
    codec = sequences.train_codec(df, "id", "junction_aa", "embedding", rounds=50)
    coded = codec.code(df, "junction_aa").cache()
    scores = codec_losslessness(codec.decode(coded, "code"), "id", "junction_aa", "code", "recon").first()
    assert scores["token_acc"] > 0.7
    decoder = sequences.train_decoder(coded, "id", "junction_aa", "code", rounds=50)
    back = decoder.decode(coded, "code").withColumn("same", F.zip_with(tokens(F.col("junction_aa")), tokens(F.col("recon")), lambda a, b: (a == b).cast("double")))
    assert back.agg(F.avg(F.aggregate("same", F.lit(0.0), lambda s, x: s + x) / 40)).first()[0] > 0.7
    assert all(isinstance(r["recon"], str) for r in codec.roundtrip(df.limit(5), "junction_aa").collect())
