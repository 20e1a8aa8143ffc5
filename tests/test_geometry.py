import numpy as np
import pytest
from pyspark.sql import functions as F

from trackforge.functions import calibration as C
from trackforge.functions import geometry as G


def one(spark, *columns, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return tuple(df.select(*columns).first())


CENTRES = [(1.5, 7.5), (4.5, 7.5), (7.5, 7.5), (1.5, 2.0), (4.5, 2.0), (7.5, 2.0), (7.5, 10.5), (4.5, 10.5), (1.5, 10.5), (7.5, 16.0), (4.5, 16.0), (1.5, 16.0)]
LABELS = ["A4", "A3", "A2", "A5", "A6", "A1", "B4", "B3", "B2", "B5", "B6", "B1"]


def test_zone_centres(spark):
    df = spark.createDataFrame(CENTRES, "x double, y double")
    got = df.select(G.zone_label("x", "y").alias("z"), G.zone_number("x", "y", G.side_of("y")).alias("n")).collect()
    assert [r["z"] for r in got] == LABELS
    assert [r["n"] for r in got] == [int(z[1]) for z in LABELS]
    assert one(spark, G.zone_number("x", "y", F.lit("A"), flip=True), x=7.5, y=3.0) == (5,)


def test_the_two_zone_systems_differ_between_the_lines(spark):
    assert one(spark, G.zone_label("x", "y"), G.zone_number("x", "y", F.lit("A")), x=1.0, y=5.0) == ("A4", 5)
    assert one(spark, G.zone_label("x", "y"), G.side_of("y"), x=1.0, y=9.0) == ("A4", "B")


def test_half_court_and_margin(spark):
    assert one(spark, G.zone_label("x", "y", 9.0, 9.0, half=True), x=1.0, y=2.0) == ("A4",)
    assert one(spark, G.zone_label("x", "y", 9.0, 9.0, half=True), x=8.0, y=8.0) == ("A1",)
    assert one(spark, G.zone_label("x", "y"), G.zone_label("x", "y", margin=0.5), x=-0.3, y=2.0) == (None, "A5")


def test_margins_of_the_court(spark):
    """Edges and corners of a court of 6 x 8 with a margin of a quarter."""
    cases = {(0.0, 0.0): True, (-0.25, 8.25): True, (6.25, -0.25): True, (-0.26, 4.0): False, (3.0, 8.26): False, (6.5, 7.0): False, (3.0, None): False, (None, None): False}
    df = spark.createDataFrame(list(cases), "x double, y double")
    assert [r[0] for r in df.select(G.in_court("x", "y", 6.0, 8.0, 0.25)).collect()] == list(cases.values())


def test_polygons(spark):
    """An arrow head: a notch is outside, vertices and edges are inside."""
    arrow = [(0.0, 0.0), (8.0, 4.0), (0.0, 8.0), (3.0, 4.0)]
    cases = {(5.0, 4.0): True, (1.0, 4.0): False, (3.0, 4.0): True, (4.0, 2.0): True, (8.0, 4.0): True, (8.1, 4.0): False, (1.5, 2.0): True, (2.0, 7.5): False, (-1.0, 0.0): False}
    df = spark.createDataFrame(list(cases), "x double, y double")
    assert [r[0] for r in df.select(G.in_polygon("x", "y", arrow)).collect()] == list(cases.values())
    assert one(spark, G.in_polygon("x", "y", None), x=-7.0, y=1e9) == (True,)


def test_region_of_a_scaled_court():
    """Twenty pixels a metre, shifted: the court of 6 x 8 and half a metre around it."""
    h = np.array([[1.0, 0.0, -100.0], [0.0, 1.0, -40.0], [0.0, 0.0, 1.0]])
    assert C.roi_polygon(h, 6, 8, 20, 0.5) == [(90, 30), (230, 30), (230, 210), (90, 210)]
    assert C.roi_polygon(np.ones((3, 3)), 6, 8, 20) is None


def test_projection_round_trip(spark):
    quad = [(400, 225), (880, 230), (1100, 700), (180, 690)]
    for court in ((9, 18), (9, 9)):
        h = C.court_homography(quad, *court, 40.0)
        df = spark.createDataFrame([(float(x), float(y)) for x, y in quad], "x double, y double")
        got = [tuple(r) for r in df.select(*G.project(h.tolist(), "x", "y", 40.0)).collect()]
        assert np.allclose(got, [(0, 0), (court[0], 0), court, (0, court[1])], atol=1e-3)
        back = C.apply(np.linalg.inv(h), np.array(got) * 40)
        assert np.allclose(back, quad, atol=1e-3)
    assert np.allclose(C.apply(C.court_homography(quad, 9, 18, 1.0, flip=True), [quad[0]]), [(0, 18)], atol=1e-6)
    assert one(spark, *G.project([[1, 0, 0], [0, 1, 0], [1, 0, 0]], "x", "y"), x=0.0, y=1.0) == (None, None)


def camera(points, height=6.0, back=9.0, side=3.0, f=900.0, w=1280, h=720):
    """Pinhole view of court points from behind, off the middle."""
    eye, target = np.array([4.5 + side, -back, height]), np.array([4.5, 9.0, 0.0])
    z = (target - eye) / np.linalg.norm(target - eye)
    x = np.cross(z, [0, 0, 1.0])
    x /= np.linalg.norm(x)
    r = np.stack([x, np.cross(z, x), z])
    c = (np.c_[points, np.zeros(len(points))] - eye) @ r.T
    return [(f * a / d + w / 2, f * b / d + h / 2) for a, b, d in c]


@pytest.mark.parametrize(("length", "aspect"), [(18, 2.0), (9, 1.0)])
def test_aspect_from_an_oblique_camera(length, aspect):
    corners = camera(np.array([(0, length), (9, length), (9, 0), (0, 0)], float))
    got, sure = C.rectangle_aspect(corners, 720, 1280)
    assert sure and abs(got - aspect) < 0.05
    assert C.court_size(corners, 720, 1280) == (9.0, float(length))


def test_aspect_is_unsure_for_parallels():
    corners = [(100, 100), (500, 100), (500, 300), (100, 300)]
    assert C.rectangle_aspect(corners, 720, 1280) == (2.0, False)
    assert C.court_size(corners, 720, 1280) == (9.0, 18.0)
    assert C.court_size(corners, 720, 1280, "half") == (9.0, 9.0)


def test_corners_region_and_mask():
    assert C.order_corners([(9, 9), (0, 0), (0, 9), (9, 0)]) == [(0, 0), (9, 0), (9, 9), (0, 9)]
    assert C.ball_region(None, 100, 200) is None
    assert C.ball_region([(0, 0)] * 3, 100, 200) is None
    assert C.ball_region([(0, 0), (1, float("nan")), (1, 1), (0, 1)], 100, 200) is None
    assert C.ball_region([(20, 30), (100, 30), (100, 90), (20, 90)], 100, 200) == (14.0, 0.0, 106.0, 93.0)
    assert C.mask_quality(0.9, 0.8, 0.05) == 0
    grid = np.zeros((40, 40))
    grid[20, 20] = 1
    mask = C.envelope_mask(grid, 75, 2)
    assert mask[20, 20] and not mask[0, 0]
    src = [(0, 0), (10, 0), (10, 10), (0, 10), (5, 5), (5, 0)]
    dst = [(x * 2, y * 2) for x, y in src[:4]] + [(10, 10), (90, 90)]
    assert np.allclose(C.apply(C.robust_homography(src, dst, 1.0), [(5, 0)]), [(10, 0)], atol=1e-6)


def test_bodies(spark):
    kp = [[0.0, 0.0]] * 17
    for i, p in {5: (1, 0), 6: (3, 0), 11: (1, 2), 12: (3, 2), 13: (1, 3), 15: (1, 4), 14: (3, 3), 16: (4, 3)}.items():
        kp[i] = [float(p[0]), float(p[1])]
    df = spark.createDataFrame([(kp, [1.0] * 17), (kp, [0.4] * 17)], "kp array<array<double>>, sc array<double>")
    got = df.select(G.torso_lean("kp", "sc"), G.stance_width("kp", "sc"), G.knee_angle("kp", "sc", "left"), G.knee_angle("kp", "sc", "right"), G.mean_knee("kp", "sc")).collect()
    assert np.allclose(got[0], (0, 10**0.5, 180, 90, 135), atol=0.01)
    assert tuple(got[1]) == (None,) * 5
    crop = df.select(G.torso_crop(F.lit(0), F.lit(0), F.lit(100), F.lit(200), "kp", "sc", 640, 480)).collect()
    assert crop[0][0] is None  # four by four pixels of shirt
    assert tuple(spark.range(1).select(G.torso_crop(F.lit(0), F.lit(0), F.lit(100), F.lit(200), F.lit(None).cast("array<array<double>>"), F.lit(None).cast("array<double>"), 640, 480)).first()[0]) == (0, 22, 101, 123)


def test_words_at_their_thresholds(spark):
    marks = [(100, "excelente"), (80, "excelente"), (79, "bueno"), (60, "bueno"), (59, "regular"), (40, "regular"), (39, "bajo"), (0, "bajo")]
    df = spark.createDataFrame([(n,) for n, _ in marks], "s int")
    assert [r[0] for r in df.select(G.verdict("s")).collect()] == [w for _, w in marks]
    times = [(0.0, "0s"), (59.4, "59s"), (59.6, "1m 00s"), (61.0, "1m 01s"), (3725.0, "62m 05s"), (None, "0s")]
    df = spark.createDataFrame([(t,) for t, _ in times], "t double")
    assert [r[0] for r in df.select(G.spoken_seconds("t")).collect()] == [w for _, w in times]
    counts = [(50, "alta"), (49, "media"), (25, "media"), (24, "baja")]
    df = spark.createDataFrame([(n,) for n, _ in counts], "n int")
    assert [r[0] for r in df.select(G.reliability("n")).collect()] == [w for _, w in counts]
    assert one(spark, *G.render_point("x", "y", 12.0, 7.0), x=2.5, y=18.0) == (37, 7)


def test_mask_quality_is_the_same_in_both_forms(spark):
    for solid, fit, share in [(0.9, 0.8, 0.05), (0.9, 0.8, 0.06), (0.5, 1.0, 0.7)]:
        assert one(spark, G.mask_quality("a", "b", "c"), a=solid, b=fit, c=share) == (pytest.approx(C.mask_quality(solid, fit, share)),)


def test_default_corners_are_a_court_from_behind():
    tl, tr, br, bl = C.default_corners(1000, 500)
    assert C.order_corners([br, tl, bl, tr]) == [tl, tr, br, bl] and tr[0] - tl[0] < br[0] - bl[0] and tl[1] < bl[1]
