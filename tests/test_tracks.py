import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackforge.operators import balls as B
from trackforge.operators import tracks as T
from trackforge.operators import windows as W

SAMPLE = "video_id long, track_id long, det_id long, frame long, court_x double, court_y double"


def samples(spark, *tracks):
    rows, n = [], 0
    for tid, frames, (x, y) in tracks:
        for f in frames:
            rows.append((0, tid, n, f, float(x), float(y)))
            n += 1
    return spark.createDataFrame(rows, SAMPLE)


@pytest.mark.parametrize(
    ("second", "roots"),
    [(([20, 25, 30], (1.2, 1.1)), 1), (([500, 505], (1.2, 1.1)), 2), (([20, 25], (50, 50)), 2)],
)
def test_stitch(spark, second, roots):
    df = samples(spark, (1, [0, 5, 10], (1, 1)), (2, *second))
    assert T.stitch(df, 30, 5.0, 6.0).select("track_id").distinct().count() == roots


def test_stitch_chains_to_the_first(spark):
    df = samples(spark, (7, [0, 5], (1, 1)), (3, [10, 15], (1, 1)), (5, [20, 25], (1, 1)))
    assert {r["root"] for r in T.stitch_mapping(df, 30).collect()} == {7}
    assert T.stitch_mapping(df.limit(0), 30).count() == 0


def quality(spark, lens, samples_, ball=0, evaluated=None, zones=(), half=True, rejected=0):
    t = spark.createDataFrame([(n,) for n in lens], "n long")
    z = spark.createDataFrame([(v,) for v in zones], "visits long")
    return T.quality_strings(T.quality(t, z, ball, rejected, samples_, half, evaluated), half).first()


def test_quality(spark):
    r = quality(spark, [100] * 6, 200)
    assert (r["tracks_pts"], r["stability_pts"]) == (30, 10)
    assert r["quality_breakdown"]["tracks"] == "30/30 (6 de 6)"
    assert quality(spark, [30] * 48, 200)["tracks_pts"] == 4
    assert quality(spark, [100] * 3, 200)["tracks_pts"] == 15
    assert quality(spark, [100] * 6, 200, 100, 100)["ball_pts"] == 20
    assert quality(spark, [], 0)["score"] == 0
    assert quality(spark, [10], 100, zones=[4, 3, 5])["zones_pts"] == int(2 / 6 * 25)


def test_detection_status(spark):
    rows = [(0, 0, 10, 397, False), (0, 0, 413, 10, False), (0, 460, 10, 715, False), (0, 0, 10, 396, False), (0, 0, 500, 700, True)]
    df = spark.createDataFrame(rows, "x1 int, y1 int, x2 int, y2 int, ball boolean")
    got = [r[0] for r in df.select(T.detection_status("x1", "y1", "x2", "y2", 1000, 720, F.col("ball"))).collect()]
    assert got == ["fg_too_large", "fg_too_large", "fg_at_edge", "ok", "ok"]


def test_dominant_zone_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([(0, 1, 1, 5, "B"), (0, 1, 2, 6, "A"), (0, 1, 3, 7, "A"), (0, 1, 4, 8, "B")], "video_id long, track_id long, det_id long, frame long, z string")
    assert T.dominant_zone(df, F.col("z"), ["video_id", "track_id"]).first()["dominant_zone"] == "B"


def test_eligible_and_summary(spark):
    df = samples(spark, (1, range(20), (1, 1)), (2, range(14), (1, 1)), (3, range(20), (99, 1)))
    kept = T.eligible(df, F.col("court_x") < 9, ["video_id", "track_id"])
    assert {r["track_id"] for r in kept.select("track_id").distinct().collect()} == {1}
    s = T.summarise(kept, ["video_id", "track_id"], 10.0).first()
    assert (s["samples"], s["reliability"], s["distance_m"], s["side"], s["seconds_tracked"]) == (20, "baja", 0.0, "A", 1.9)
    assert T.even_frames(10, 4) == [0, 3, 6, 9]


def test_jersey_votes(spark):
    reads = [(0, 1, s, t, c) for s, t, c in [(0, " 7 ", 0.8), (1, "7", 0.7), (2, "9", 0.9), (3, "123", 1.0), (4, "55", 1.0), (5, "9", 0.2)]]
    reads += [(0, 2, 0, "9", 0.7), (0, 2, 1, "7", 0.79), (0, 3, 0, "x", 0.9)]
    reads += [(0, 4, i, "x", 0.9) for i in range(30)] + [(0, 4, 30, "7", 5.0)]
    df = spark.createDataFrame(reads, "video_id long, track_id long, seq long, text string, conf double")
    roster = spark.createDataFrame([(7, "Ana"), (9, "Eva")], "number int, name string")
    got = {r["track_id"]: r for r in T.vote(T.roster_reads(df, roster), df, roster).collect()}
    assert (got[1]["number"], got[1]["name"], got[1]["votes"]) == (7, "Ana", 3)
    assert got[2]["name"] == "desconocida" and got[2]["votes"] == 2
    assert (got[3]["name"], got[3]["votes"], got[3]["confidence"]) == ("desconocida", 0, 0.0)
    assert got[4]["votes"] == 0  # the 31st reading no longer counts


def test_jersey_votes_do_not_hang_on_last_bits(spark):
    """0.1 + 0.2 is no more than 0.3, which was seen first; 0.7 + 0.5 + 0.3 in this order is 1.5, in others less."""
    reads = [(0, 1, 0, "9", 0.3), (0, 1, 1, "7", 0.1), (0, 1, 2, "7", 0.2)]
    reads += [(0, 2, s, "7", c) for s, c in enumerate((0.7, 0.5, 0.3))]
    df = spark.createDataFrame(reads, "video_id long, track_id long, seq long, text string, conf double").repartition(3)
    roster = spark.createDataFrame([(7, "Ana"), (9, "Eva")], "number int, name string")
    found = T.vote(T.roster_reads(df, roster, least=0.1), df, roster, least=0.2, share=0.4, dp=None).collect()
    got = {r["track_id"]: (r["number"], r["weight"]) for r in found}
    assert got == {1: (9, 0.3), 2: (7, 0.7 + 0.5 + 0.3)}


BALL = "video_id long, det_id long, frame long, img_x double, img_y double, court_x double, court_y double, conf double"


def ball(spark, rows):
    return spark.createDataFrame([(0, i, f, float(x), float(y), float(x), float(y), float(c)) for i, (f, x, y, c) in enumerate(rows)], BALL)


def test_rallies(spark):
    def found(frames, ys=None, **k):
        rows = [(f, 1, y, 1) for f, y in zip(frames, ys or [2] * len(frames), strict=True)]
        return B.rallies(ball(spark, rows), ["video_id"], 30.0, **k)

    a, b = list(range(0, 151, 5)), list(range(350, 451, 5))
    assert found(a + b).count() == 2
    assert found(list(range(0, 301, 5))).first()["duration_s"] == 10.0
    assert found(a + [800, 803]).count() == 1
    sides = found(a + list(range(350, 501, 5)), [2] * len(a) + [15] * 31)
    assert {r["serve_side"] for r in sides.collect()} == {"A", "B"}
    none = B.play_summary(found(a).where("false"), []).first()
    assert (none["n_rallies"], none["total_play_s"]) == (0, 0.0)


def test_steady_ball(spark):
    rows = [(0, 0, 0, 1), (5, 10, 0, 1), (20, 15, 0, 1), (36, 15, 0, 1), (40, 900, 0, 1)]
    got = B.steady_ball(ball(spark, rows), ["video_id"], 1000, stride=5)
    assert sorted(r["frame"] for r in got.collect()) == [0, 5, 20]


def test_gaps_smoothing_and_duplicates(spark):
    rows = [(0, 0, 0, 0.2), (0, 9, 9, 0.9), (6, 15, 15, 1), (13, 20, 20, 1)]
    dense = W.dense_frames(W.dedup_frames(ball(spark, rows), ["video_id"]), ["video_id"], ["img_x"])
    x = [r["img_x"] for r in W.fill_gaps(dense, ["video_id"], ["img_x"], 5).orderBy("frame").collect()]
    assert x[:7] == [9, 10, 11, 12, 13, 14, 15] and x[7:13] == [None] * 6 and x[13] == 20
    s = W.smooth(spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 3.0), (0, 3, 5.0)], "video_id long, frame long, v double"), ["video_id"], ["v"])
    assert [r["v"] for r in s.orderBy("frame").collect()] == [1.0, None, 4.0, 4.0]


def legs(n=120):
    x, y, out = 0.0, 0.0, []
    for f in range(n):
        out.append((f, x, y, 1))
        dx, dy = [(12, 0), (0, 12), (-12, 0), (0, -12)][f // 30 % 4]
        x, y = x + dx, y + dy
    return out


def test_touch_peaks(spark):
    got = B.detect_touches(B.reconstruct(ball(spark, legs()), ["video_id"], width=1)).collect()
    assert [r["frame"] for r in got] == [30, 60, 90]
    assert all(abs(r["accel"] - 288**0.5) < 1e-6 for r in got)
    assert B.detect_touches(B.reconstruct(ball(spark, [(f, 5, 5, 1) for f in range(60)]), ["video_id"])).count() == 0


def test_find_peaks():
    assert B.find_peaks(np.array([0, 5, 5, 5, 0, 1, 0]), 1, 1, 1).tolist() == [2, 5]
    assert B.find_peaks(np.array([9, 1, 2, 1, 9]), 0, 1, 0.5).tolist() == [2]
    assert B.find_peaks(np.array([0, 5, 4, 6, 0]), 0, 3, 0).tolist() == [3]
    assert B.find_peaks(np.array([0, 5, 4, 6, 0]), 0, 1, 2).tolist() == [3]
    assert B.find_peaks(np.array([]), 0, 1, 0).tolist() == []


def plain_peaks(x, height, distance, prominence):
    n = len(x)
    tops = []
    for i in range(1, n - 1):
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < n - 1 and x[j + 1] < x[i]:
            tops.append((i + j) // 2)
    kept = []
    for p in sorted((p for p in set(tops) if x[p] >= height), key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        a = max([q for q in range(p) if x[q] > x[p]], default=-1)
        b = min([q for q in range(p + 1, n) if x[q] > x[p]], default=n)
        if x[p] - max(min(x[a + 1 : p + 1]), min(x[p:b])) >= prominence:
            out.append(p)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_find_peaks_against_a_loop(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 8, 200).astype(float).tolist()
    for distance, prominence in ((1, 0), (3, 2), (7, 5)):
        assert B.find_peaks(np.array(x), 2, distance, prominence).tolist() == plain_peaks(x, 2, distance, prominence)


def test_find_peaks_time_goes_with_length():
    x = np.random.default_rng(1).random(400_000)
    began = time.time()
    assert len(B.find_peaks(x, 0.5, 12, 0.1)) > 10_000
    assert time.time() - began < 20


def test_attribution(spark):
    touches = spark.createDataFrame([(0, 0, 50)], "video_id long, touch_id long, frame long")
    players = samples(spark, (1, range(40, 61, 5), (1, 1)), (2, range(40, 61, 5), (8, 8)))
    near = B.attribute(touches, ball(spark, [(49, 1.2, 1.0, 1)]), players).first()
    assert (near["track_id"], near["player_distance_m"]) == (1, 0.2)
    far = B.attribute(touches, ball(spark, [(50, 50, 50, 1)]), players).first()
    assert far["track_id"] is None and far["player_distance_m"] > 50
    assert B.attribute(touches, ball(spark, [(90, 1, 1, 1)]), players).first()["court_x"] is None


def test_nearest_frame_against_a_loop(spark):
    """Around the edges of bins and below zero, without a join and a row for each frame of the band."""
    rng = np.random.default_rng(7)
    for reach in (3, 30):
        frames = sorted({int(f) for f in np.concatenate([rng.integers(-60, 60, 12), rng.integers(980, 1080, 12), rng.integers(2000, 2100, 6)])})
        right = [(v, int(f), int(i), float(i)) for v in (0, 1) for i, f in enumerate(rng.choice(frames, 40))] + [(None, 5, 99, 1.0), (0, None, 99, 1.0)]
        left = [(v, 10_000 * v + i, f) for v in (0, 1) for i, f in enumerate(range(-100, 2200, 3))] + [(0, -1, None), (None, -2, 5)]
        r = spark.createDataFrame(right, "video_id long, frame long, det_id long, v double")
        found = W.nearest_frame(spark.createDataFrame(left, "video_id long, touch_id long, frame long"), r, ["video_id"], ["v"], reach=reach)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Generate") == 1
        want = set()
        for v, t, f in left:
            near = [x for x in right if None not in (v, f, x[0], x[1]) and x[0] == v and abs(x[1] - f) <= reach]
            best = min(near, key=lambda x: (abs(x[1] - f), x[1] - f, -x[2]), default=(None,) * 4)  # noqa: B023
            want.add((v, t, f, best[1], best[3]))
        assert {tuple(x) for x in found.collect()} == want


def test_known_positions_are_those_of_every_track(spark):
    rng = np.random.default_rng(5)
    rows = [(0, int(t), i, int(f), float(f % 7), float(i)) for i, (t, f) in enumerate(zip(rng.integers(1, 5, 60), rng.integers(0, 400, 60), strict=True))]
    df = spark.createDataFrame(rows, SAMPLE)
    moments = spark.createDataFrame([(0, f, f - 50) for f in range(0, 520, 3)], "video_id long, touch_id long, frame long")
    first = {t: min((r[3], r[2]) for r in rows if r[1] == t) for t in range(1, 5)}
    for most, exact in ((1, False), (30, False), (30, True), (200, False)):
        want = {(r["touch_id"], r["track_id"]): (r["x"], r["y"]) for r in W.asof_position(moments, df, most, exact).where("x is not null").collect()}
        found = W.known_positions(moments, df, most, exact).collect()
        got = {(r["touch_id"], r["track_id"]): (r["x"], r["y"]) for r in found}
        assert len(found) == len(got) and got == want
        assert all(tuple(r["seen"]) == first[r["track_id"]] for r in found)


def test_attribution_answers_once_for_each_frame(spark, monkeypatch):
    """500 touches of a frame are held against the tracks once, as are frames without a ball not at all."""
    asked, known = [], W.known_positions
    monkeypatch.setattr(W, "known_positions", lambda moments, *a, **b: asked.append(moments.count()) or known(moments, *a, **b))
    touches = spark.createDataFrame([(0, i, 50) for i in range(500)] + [(0, 500, 90), (0, 501, None)], "video_id long, touch_id long, frame long")
    players = samples(spark, (1, range(40, 61, 5), (1, 1)), (2, range(40, 61, 5), (8, 8)))
    got = {r["touch_id"]: r["track_id"] for r in B.attribute(touches, ball(spark, [(49, 1.2, 1.0, 1)]), players).collect()}
    assert asked == [1] and got == {i: 1 if i < 500 else None for i in range(502)}


def test_asof_against_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(0, int(t), i, int(f), float(f), float(t)) for i, (t, f) in enumerate(zip(rng.integers(1, 4, 60), rng.integers(0, 300, 60), strict=True))]
    df = spark.createDataFrame(rows, SAMPLE)
    moments = spark.createDataFrame([(0, f, f) for f in range(0, 300, 7)], "video_id long, touch_id long, frame long")
    got = {(r["touch_id"], r["track_id"]): r["x"] for r in W.asof_position(moments, df).collect()}
    for f in range(0, 300, 7):
        for t in (1, 2, 3):
            mine = sorted((r[3], r[2], r[4]) for r in rows if r[1] == t)
            a = [m for m in mine if m[0] <= f][-1:]
            b = [m for m in mine if m[0] > f][:1]
            if a and b:
                want = a[0][2] + (b[0][2] - a[0][2]) * (f - a[0][0]) / (b[0][0] - a[0][0]) if b[0][0] - a[0][0] <= 30 else None
            elif a:
                want = a[0][2] if f - a[0][0] <= 30 else None
            else:
                want = b[0][2] if b[0][0] - f <= 30 else None
            assert got[(f, t)] == pytest.approx(want)


def test_exact_hit_before_a_hole(spark):
    df = samples(spark, (1, [0, 50], (3, 3)))
    m = spark.createDataFrame([(0, 0, 0)], "video_id long, touch_id long, frame long")
    assert W.asof_position(m, df).first()["x"] is None
    assert W.asof_position(m, df, hold_exact=True).first()["x"] == 3


def test_touch_rallies(spark):
    t = spark.createDataFrame([(0, i, f, 1) for i, f in enumerate([10, 40, 280, 310])], "video_id long, touch_id long, frame long, track_id long")
    g = B.touch_rallies(t, ["video_id"], 60.0)
    assert [(r["rally_id"], r["seq_in_rally"]) for r in g.orderBy("frame").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    totals = B.rally_totals(g, ["video_id"], 60.0).orderBy("rally_id").collect()
    assert [r["n_touches"] for r in totals] == [2, 2] and totals[0]["touches_by_player"] == {"1": 2}


def parabola(frames):
    return [(t, 6 * t + 120, 0.8 * t * t - 14 * t + 300, 1) for t in frames]


def test_flights(spark):
    rows = B.flights(ball(spark, parabola(range(0, 19, 3))), 30, 1000)
    s = B.flight_summary(rows, []).first()
    assert (s["real"], s["interpolated"], s["total"], s["reconstructed_flights"]) == (7, 12, 19, 1)
    at1 = rows.where("frame = 1").first()
    assert (at1["img_x"], at1["img_y"]) == (126.0, 286.8)
    few = B.flight_summary(B.flights(ball(spark, parabola([0, 3, 6])), 30, 1000), []).first()
    assert (few["real"], few["interpolated"]) == (3, 0)
    two = B.flights(ball(spark, parabola(range(0, 19, 3)) + [(f + 200, x, y, c) for f, x, y, c in parabola(range(0, 19, 3))]), 30, 1000)
    assert two.agg(F.max("flight")).first()[0] == 2 and two.where("frame between 19 and 199").count() == 0
    turn = [(f, 40 * f if f <= 8 else 640 - 40 * f, 300, 1) for f in range(17)]
    back = B.flights(ball(spark, turn), 30, 300)
    assert back.agg(F.max("flight")).first()[0] >= 2 and back.count() == back.select("frame").distinct().count()
    assert B.flights(ball(spark, parabola([0])).limit(0), 30, 1000).count() == 0


def test_centred_windows(spark):
    df = spark.createDataFrame([(0, i, i, float(i)) for i in range(20)], "video_id long, det_id long, frame long, conf double")
    got = W.centred_windows(df, ["video_id"], "conf").orderBy("frame").collect()
    assert len(got) == 12 and got[0]["frame"] == 4 and list(got[0]["window"]) == list(range(9))


