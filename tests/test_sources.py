import json

import pytest

from trackforge.sources import tables as S


def put(tmp_path, name, doc):
    (tmp_path / name).write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return f"file://{tmp_path / name}"


def spots(n, x=2.0):
    return [{"frame": 10 * i, "court_x": x, "court_y": 0.5 * i} for i in range(n)]


SHOTS = [{"frame": f, "img_x": 3 * f, "img_y": 7, "court_x": 4, "court_y": 9, "conf": 0.25} for f in (4, 8, 12)]


def read_back(spark, tmp_path, **fields):
    _, balls, samples = S.read_scouting(spark, put(tmp_path, "doc.json", {"duration_s": 4.5, "ball_track": SHOTS, **fields}))
    assert [(r["frame"], r["det_id"], r["img_x"]) for r in balls.orderBy("frame").collect()] == [(4, 0, 12.0), (8, 1, 24.0), (12, 2, 36.0)]
    return sorted((r["track_id"], r["frame"], r["court_y"]) for r in samples.collect())


def test_samples_from_a_list_of_tracks(spark, tmp_path):
    got = read_back(spark, tmp_path, track_samples=[{"id": 21, "samples": spots(2)}, {"id": 22, "samples": spots(1)}, {"id": 23, "samples": []}])
    assert got == [(21, 0, 0.0), (21, 10, 0.5), (22, 0, 0.0)]


def test_samples_from_a_map_by_id(spark, tmp_path):
    assert read_back(spark, tmp_path, track_samples={"31": spots(1), "40": spots(3)}) == [(31, 0, 0.0), (40, 0, 0.0), (40, 10, 0.5), (40, 20, 1.0)]


def test_old_documents_have_samples_in_their_tracks(spark, tmp_path):
    assert read_back(spark, tmp_path, tracks=[{"id": 8, "samples": spots(2), "side": "A"}]) == [(8, 0, 0.0), (8, 10, 0.5)]


def test_samples_win_over_summaries(spark, tmp_path):
    summary = [{"id": 77, "samples": 512, "reliability": "alta"}]
    assert read_back(spark, tmp_path, tracks=summary, track_samples=[{"id": 6, "samples": spots(1)}]) == [(6, 0, 0.0)]


def test_documents_that_cannot_be_used(spark, tmp_path):
    whole = {"duration_s": 1, "ball_track": SHOTS, "track_samples": [{"id": 6, "samples": spots(1)}]}
    for field, value in (("track_samples", [{"id": 6, "samples": 512}]), ("track_samples", None), ("ball_track", []), ("ball_track", None)):
        with pytest.raises(ValueError, match="no ball track or no raw player samples"):
            S.read_scouting(spark, put(tmp_path, "doc.json", whole | {field: value}))


def test_tables_with_schemas(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3, None, 0, 1, 1, 2, 2, 0.5, "x")], S.DETECTIONS.replace("x1 double, y1 double, x2 double, y2 double", "x1 int, y1 int, x2 int, y2 int") + ", more string").write.parquet(f"file://{tmp_path}/d")
    r = S.read_detections(spark, f"file://{tmp_path}/d")
    assert r.columns[-1] == "conf" and dict(r.dtypes)["x1"] == "double" and r.count() == 1
    for read in (S.read_shirt_reads, S.read_poses):
        with pytest.raises(ValueError, match="columns are missing"):
            read(spark, f"file://{tmp_path}/d")


def test_roster(spark, tmp_path):
    path = put(tmp_path, "r.json", {"team": "x", "players": {"7": "Ana", "x": "Eva", "12": "Lu"}})
    assert sorted(tuple(r) for r in S.read_roster(spark, path).collect()) == [(7, "Ana"), (12, "Lu")]
    with pytest.raises(ValueError, match="roster"):
        S.read_roster(spark, put(tmp_path, "e.json", {"players": {"x": "Eva"}}))


def test_ball_csv(spark, tmp_path):
    path = put(tmp_path, "b.csv", "Frame,Visibility,X,Y,Radius\n1,1,2.5,3,4\n2,0,0,0,0\n")
    assert [tuple(r) for r in S.read_ball_csv(spark, path).collect()] == [(1, 2.5, 3.0, 4.0, 1.0)]


def test_calibration_round_trip(spark, tmp_path):
    S.write_calibration(spark, f"file://{tmp_path}/c.json", [[1, 0, 0], [0, 1, 0], [0, 0, 1]], [(0, 0), (9, 0), (9, 9), (0, 9)], (9.0, 9.0), 40.0, (720, 1280))
    r = S.read_calibration(spark, f"file://{tmp_path / 'c.json'}").first()
    assert (r["court_w"], r["ppm"], r["half_court"], r["frame_w"]) == (9.0, 40.0, True, 1280)


def test_cache(spark, tmp_path):
    made = []

    def tracked(folder, **inputs):
        def compute():
            made.append(inputs)
            return spark.createDataFrame([(len(made), 0.5, 0.5, 4.0, 0.9)], S.RAW_BALL)

        return S.cached(spark, folder, compute, **inputs).first()["frame"]

    folder = f"file://{tmp_path}/kept"
    a = {"clip": "gym.mp4", "every": 3, "least": 0.25}
    assert [tracked(folder, **a), tracked(folder, **a), tracked(folder, **a | {"every": 4}), tracked(folder, **a)] == [1, 1, 2, 1]
    assert tracked(folder, **a | {"least": 0.250001}) == 1  # floats count to four digits
    assert tracked(None, **a) == 3
    for f in (tmp_path / "kept" / S.signature(**a)).iterdir():
        if f.name.startswith(".part-"):
            f.unlink()
        elif f.name.startswith("part-"):
            f.write_bytes(b"no parquet")
    assert [tracked(folder, **a), tracked(folder, **a)] == [4, 4]
    (tmp_path / "kept" / S.signature(**a) / "_SUCCESS").unlink()
    assert tracked(folder, **a) == 5


def test_foot_points(spark):
    feet = spark.createDataFrame([(100.0, float(y), h) for y, h in [(600, 90.0), (620, 95.0), (120, 35.0), (140, 40.0)]], "x double, y double, height double")
    assert not S.upside_down(feet, 720)
    assert S.upside_down(feet.selectExpr("x", "720 - y AS y", "height"), 720)
    assert not S.upside_down(feet.limit(3), 720)
    ball = spark.createDataFrame([(100.0, 300.0), (100.0, 700.0)], "x double, y double")
    assert S.inside_feet(ball, feet).count() == 1
    assert S.inside_feet(ball, feet.limit(0)).count() == 0
