import numpy as np
from pyspark.sql import functions as F

from textloom.operators import layout, similarity
from textloom.operators.neighbours import neighbours


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, embedding array<double>")


def test_layout_keeps_more_neighbours_than_two_components(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(8, 20)) * 2
    rows = centers[rng.integers(0, 8, 160)] + rng.normal(size=(160, 20))
    df = frame(spark, rows)
    near = neighbours(df, df, "id", "id", 10, True).select("id", "neighbour")
    places = layout.neighbour_layout(df, "id", rounds=8)
    flat = similarity.reduce_dimensions(df, 2).select("id", F.col("reduced")[0].alias("x"), F.col("reduced")[1].alias("y"))
    kept = [layout.kept_neighbours(near, p).agg(F.avg("kept"), F.count("*")).first() for p in (places, flat)]
    assert kept[0][1] == kept[1][1] == 160
    assert kept[0][0] > 1.5 * kept[1][0]
    again = layout.neighbour_layout(df, "id", rounds=8).collect()
    assert {r.id: (round(r.x, 6), round(r.y, 6)) for r in again} == {r.id: (round(r.x, 6), round(r.y, 6)) for r in places.collect()}


def test_kept_share_by_brute_force(spark):
    rng = np.random.default_rng(1)
    flat = rng.normal(size=(40, 2))
    places = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(flat)], "id long, x double, y double").repartition(3)
    gaps = ((flat[:, None] - flat[None]) ** 2).sum(-1)
    np.fill_diagonal(gaps, np.inf)
    order = np.argsort(gaps, axis=1)
    near = spark.createDataFrame([(i, int(j)) for i in range(40) for j in (*order[i, :3], *order[i, -2:])], "id long, neighbour long")
    rows = layout.kept_neighbours(near, places, 5).collect()
    assert len(rows) == 40 and all(abs(r.kept - 0.6) < 1e-9 for r in rows)


def test_layout_edges(spark):
    none = frame(spark, np.zeros((0, 3)))
    assert layout.neighbour_layout(none, "id").count() == 0
    one = frame(spark, [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0]])
    assert layout.neighbour_layout(one, "id", rounds=2).count() == 2
