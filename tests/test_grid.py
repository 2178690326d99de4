"""Neighbour joins in a bounded number of parts."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plexivec.operators import neighbors
from tests.test_index import frame


def test_rows_are_sent_to_a_bounded_number_of_parts(spark):
    df = frame(spark, np.random.default_rng(0).normal(size=(400, 30))).withColumnRenamed("id", "_id")
    sent = neighbors.join_within(df, df, lambda x, y: pd.DataFrame({"_id": x["_id"]}), "_id bigint", 1e6, block=2)
    n = sent.groupBy("_id").count().agg(F.max("count"), F.count("*")).first()
    assert n[0] <= 48 and n[1] == 400


def test_random_projections_make_no_row_a_pair(spark):
    x = np.repeat(np.random.default_rng(1).normal(size=(3, 6)), 40, 0)
    out = neighbors.ann_ball_counts(frame(spark, x), frame(spark, x), "id", "v", 1e-6)
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().toString()
    assert [r["n"] for r in out.collect()] == [40] * 120


def test_forest_connects_what_the_links_connect():
    from plexivec.operators.cluster import forest_of_links

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 2)), rng.normal(size=(50, 2))
    links = forest_of_links(x, y, np.arange(60), np.arange(60, 110), 0.1)
    d = ((x[:, None] - y[None]) ** 2).sum(2) <= 0.1
    label = np.arange(110)
    for a, b in links:
        assert d[a, b - 60]
        label[label == label[b]] = label[a]
    assert all(label[i] == label[60 + j] for i, j in zip(*np.nonzero(d))) and len(links) < 110
