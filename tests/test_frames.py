import pytest
from pyspark.sql import functions as F

from trackforge.functions import geometry as G
from trackforge.plans import frames as P

DET = "video_id long, det_id long, frame long, track_id long, cls int, x1 double, y1 double, x2 double, y2 double, conf double"
IDENTITY = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]


def rows(spark, *dets):
    dets = [(*d[:5], *map(float, d[5:])) for d in dets]
    return P.frame_rows(spark.createDataFrame(dets, DET), IDENTITY, F.col("cls") == 32, 20)


def test_players_in_the_court_and_the_surest_ball(spark):
    found = rows(
        spark,
        (0, 1, 5, 7, 0, 0, 0, 2, 7, 0.9),  # front left of A
        (0, 2, 5, 8, 0, 18, 0, 22, 7, 0.9),  # outside
        (0, 3, 5, None, 0, 0, 0, 2, 7, 0.9),  # no track
        (0, 4, 5, None, 32, 4, 4, 6, 6, 0.5),
        (0, 5, 5, None, 32, 3, 14, 5, 16, 0.8),
        (0, 6, 5, None, 32, 1, 1, 2, 2, 0.8),  # as sure, but later
    )
    player, = found.where("kind = 'player'").collect()
    assert (player["track_id"], player["x_m"], player["y_m"], player["side"], player["zone"], player["low"]) == (7, 1.0, 7.0, "A", 4, None)
    ball, = P.ball_places(found).collect()
    assert (ball["x_m"], ball["y_m"], ball["low"]) == (4.0, 15.0, True)
    assert [tuple(r) for r in P.zone_occupancy(found).collect()] == [(0, 7, 4, 1)]


def test_no_rows(spark):
    assert rows(spark, (0, 1, 0, 1, 0, 0, 0, 2, 7, 0.9)).where("kind = 'ball'").count() == 0


@pytest.mark.parametrize(
    ("heat", "peak"),
    [
        ([0.0, 0.9, 0.0, 0.0, 0.9, 0.3], (1.0, 0.0, 2.0, 0.9)),  # the first of equal ones
        ([0.0, 0.1, 0.0, 0.0, 0.4, 0.3], None),
        ([], None),
        (None, None),
    ],
)
def test_heatmap_peak(spark, heat, peak):
    df = spark.createDataFrame([(heat,)], "h array<double>")
    got = df.select(G.heatmap_peak("h", 3, 2).alias("p")).first()["p"]
    assert (tuple(got) if got else None) == peak


def test_heatmap_peak_in_the_frame(spark):
    got = spark.createDataFrame([([0.0] * 5 + [1.0],)], "h array<double>").select(G.heatmap_peak("h", 3, 2, frame_w=30, frame_h=40).alias("p")).first()["p"]
    assert tuple(got) == (20.0, 20.0, 20.0, 1.0)
