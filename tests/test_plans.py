import json

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from trackforge.functions import geometry as G
from trackforge.plans import catalogue
from trackforge.plans import scouting as P
from trackforge.streaming import live

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert len(catalogue.QUERIES[name](spark, DIR).collect()) > 0


def test_touches_of_a_frame_share_their_positions(spark, monkeypatch, tmp_path):
    """1300 touches of a frame ask for its positions twice, not 1300 times; one of them has no id."""
    con, folder = duckdb.connect(), str(tmp_path)
    con.sql("SET timezone = 'UTC'")
    some = "SELECT nullif(i, 77) AS event_id, TIMESTAMP '2024-01-01 00:30:00' + INTERVAL 1 MINUTE * (CASE WHEN i < 1300 THEN 40 ELSE i % 97 END) AS ts, i % 4 * 8 AS user_id, '{}' AS props FROM range(1340) t(i)"
    con.sql(f"CREATE TABLE events AS {some} UNION ALL SELECT 5000, NULL, 8, '{{}}'")
    con.sql(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    asked, known = [], catalogue.W.known_positions
    monkeypatch.setattr(catalogue.W, "known_positions", lambda moments, *a, **b: asked.append(moments) or known(moments, *a, **b))
    df = catalogue.QUERIES["asof_interp"](spark, folder)
    want = con.sql(catalogue.ORACLES["asof_interp"])
    assert rows(df.columns, df.where("touch_id is not null").collect()) == rows(want.columns, want.filter("touch_id is not null").fetchall())
    assert df.where("touch_id is null").count() == 4
    assert asked[0].count() == con.sql("SELECT count(DISTINCT ts) FROM events").fetchall()[0][0] + 1


@pytest.mark.parametrize("name", ["nearest_ball", "attribute_touches", "touch_rallies", "asof_interp"])
def test_every_event_is_a_moment(spark, name):
    events = {r[0] for r in spark.read.parquet(f"{DIR}/events.parquet").select("event_id").collect()}
    got = [r["touch_id"] for r in catalogue.QUERIES[name](spark, DIR).collect()]
    if name == "asof_interp":  # a row for each track that is near enough in time; which ones, the SQL says
        assert len(set(got)) > len(events) / 4
    else:
        assert sorted(got) == sorted(events)


def test_jersey_vote_rounds_as_its_sql(spark, tmp_path):
    """0.989 of 4.0 is 0.24725, a tie of roundings."""
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    # conf is event_id * 13 % 1000 / 1000, and 77 the inverse of 13
    kept = ", ".join(f"({v * 77 % 1000}, {3 * n})" for n, v in enumerate((989, 800, 750, 730, 731)))
    con.sql(f"COPY (SELECT CAST(i AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' AS ts, CAST(8 AS BIGINT) AS user_id, '{{\"k\": ' || n || '}}' AS props FROM (VALUES {kept}) v(i, n)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df, want = catalogue.QUERIES["jersey_vote"](spark, f"file://{tmp_path}"), con.sql(catalogue.ORACLES["jersey_vote"])
    assert want.fetchall()[0][4] == 0.2473
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_halves_of_the_weight_name_as_the_sql_does(spark, tmp_path):
    """The best number of each of 300 tracks has half of the weight: whether that is enough hangs on the order of additions."""
    rng, reads = np.random.default_rng(1), []
    while len(reads) < 1500:
        s, a, x, y = (int(v) for v in rng.integers((1700, 750, 400, 400), (1900, 900, 700, 700)))
        if 300 <= s - x - y <= 990 and 300 <= s - a <= 990:
            best, *rest = (3 * int(n) for n in rng.permutation(30)[:4])
            reads += [(8 * (len(reads) // 5), n, v) for n, v in zip((best, best, *rest), (a, s - a, x, y, s - x - y), strict=True)]
    con = duckdb.connect(config={"threads": 1})
    con.sql("SET timezone = 'UTC'")
    kept = ", ".join(f"({i * 1000 + v * 77 % 1000}, {t}, {n})" for i, (t, n, v) in enumerate(reads))
    con.sql(f"COPY (SELECT CAST(i AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' AS ts, CAST(t AS BIGINT) AS user_id, '{{\"k\": ' || n || '}}' AS props FROM (VALUES {kept}) v(i, t, n)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("jersey_vote", "identity_of_tracks"):
        df, want = catalogue.QUERIES[name](spark, f"file://{tmp_path}"), con.sql(catalogue.ORACLES[name])
        assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_odd_texts_and_missing_ids_name_as_the_sql_does(spark, tmp_path):
    """Spaces of Unicode are trimmed, ends of lines are not; events without an id come after the 30 that count."""
    texts = ["42", " 42 ", "\u00a042", "\u200942\u3000", "\t42", "42\n", "42\r", "42\x85", "42\u2028", "4\n2", "06", "\u0664\u0662"]
    events = [(1000 * i + 300, 8 * t, json.dumps({"k": text})) for t, text in enumerate(texts) for i in range(3)]  # conf is 0.9
    events += [(None, 801, '{"k": 9}')] * 30 + [(1000 * i + 300, 801, '{"k": 42}') for i in range(3)]
    events += [(1000 * i + 300, None, '{"k": 42}') for i in range(3)] + [(1000 * i + 300, 802, None) for i in range(3)]
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, props VARCHAR, ts TIMESTAMP DEFAULT TIMESTAMP '2024-01-01')")
    con.executemany("INSERT INTO events (event_id, user_id, props) VALUES (?, ?, ?)", events)
    con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("jersey_vote", "identity_of_tracks"):
        df, want = catalogue.QUERIES[name](spark, f"file://{tmp_path}"), con.sql(catalogue.ORACLES[name])
        assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
    assert (1, 1, 1) in want.fetchall() and (0, 5, len(texts)) in want.fetchall()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


DET = "video_id long, det_id long, frame long, track_id long, cls int, x1 double, y1 double, x2 double, y2 double, conf double"


def match(spark, frames=240):
    out, n = [], 0
    for f in range(frames):
        for t, (x, y) in enumerate([(2.0, 2.0), (7.0, 7.0), (4.0, 15.0)]):
            out.append((0, n, f, t, 0, x * 10 - 1, y * 10 - 4, x * 10 + 1, y * 10, 0.9))
            n += 1
        x, y = (45 + 0.3 * f, 40.0 + 0.1 * (f % 60))
        out.append((0, n, f, None, 32, x - 1, y - 1, x + 1, y + 1, 0.8))
        n += 1
    return spark.createDataFrame(out, DET)


def test_scouting_document(spark, tmp_path):
    video, court = P.Video(30.0, 240, 200, 400), P.Court(np.eye(3).tolist(), 9.0, 18.0, 10.0)
    t = P.scouting(match(spark), video, court, stride=1, roi_margin=5.0)
    assert t["tracks"].count() == 3
    doc = P.document(t, video, court, "a.mp4", stride=1)
    P.write_document(doc, f"file://{tmp_path}/doc")
    text = next((tmp_path / "doc").glob("part-*")).read_text()
    got = json.loads(text)
    assert [x["samples"] for x in got["tracks"]] == [240] * 3
    assert got["zone_visits_total"]["B6"] == 240 and got["play_summary"]["n_rallies"] == 1
    assert got["quality_score"] == sum(int(v.split("/")[0]) for v in got["quality_breakdown"].values())
    page = P.report(got)
    assert "rallies" in page and "<table>" in page
    more = P.enrich(spark, f"file://{tmp_path}/doc")
    assert set(more) == {"touches", "touch_rallies", "documents"} and "rally_id" in more["touches"].columns
    assert "1 rallies" in page and "Side B" in page and "First half" in page and "minutes" in page
    P.write_raw_tracks(t["raw"], f"file://{tmp_path}/raw")
    raw = [json.loads(x) for f in (tmp_path / "raw").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted((r["id"], len(r["samples"])) for r in raw) == [(0, 240), (1, 240), (2, 240)]


def test_touch_run(spark, tmp_path):
    x, y, ball = 0.0, 0.0, []
    for f in range(120):
        ball.append({"frame": f, "img_x": x, "img_y": y, "court_x": 4.0, "court_y": 4.0, "conf": 1.0})
        dx, dy = [(12, 0), (0, 12), (-12, 0), (0, -12)][f // 30 % 4]
        x, y = x + dx, y + dy
    still = [{"frame": f, "court_x": 4.2, "court_y": 4.0} for f in range(0, 120, 5)]
    (tmp_path / "s.json").write_text(json.dumps({"duration_s": 2.0, "ball_track": ball, "track_samples": [{"id": 1, "samples": still}]}))
    t = P.enrich(spark, f"file://{tmp_path / 's.json'}")
    assert t["touches"].count() >= 2 and {r["track_id"] for r in t["touches"].collect()} == {1}
    assert t["touch_rallies"].count() == 1
    P.write_enriched(P.enriched_documents(t), f"file://{tmp_path}/more")
    (text,) = [f.read_text() for f in (tmp_path / "more").glob("part-*") if f.stat().st_size]
    doc = json.loads(text)
    assert doc["duration_s"] == 2.0 and doc["ball_track"] == ball and doc["touch_version"] == P.VERSION
    assert [x["frame"] for x in doc["touches"]] == sorted(r["frame"] for r in t["touches"].collect()) and {x["track_id"] for x in doc["touches"]} == {1}
    (rally,) = doc["touch_rallies"]
    assert rally["n_touches"] == len(doc["touches"]) and "touches" not in rally


def test_frame_rate_of_each_video(spark, tmp_path):
    """Touches 100 frames apart: one rally at 60 frames a second, several at 20."""
    for name, seconds in (("fast", 4.0), ("slow", 12.0)):
        x, ball = 0.0, []
        for f in range(240):
            ball.append({"frame": f, "img_x": x, "img_y": 5.0, "court_x": 4.0, "court_y": 4.0, "conf": 1.0})
            x += 12 if f < 60 or f >= 160 else -12
        still = [{"frame": f, "court_x": 4.2, "court_y": 4.0} for f in range(0, 240, 5)]
        (tmp_path / f"{name}.json").write_text(json.dumps({"duration_s": seconds, "ball_track": ball, "track_samples": [{"id": 1, "samples": still}]}))
    t = P.enrich(spark, f"file://{tmp_path}/*.json")
    names = {r["video_id"]: r["video"].rsplit("/", 1)[1] for r in t["documents"].collect()}
    got = {}
    for r in t["touch_rallies"].collect():
        got.setdefault(names[r["video_id"]], []).append(r["n_touches"])
    assert len(got["fast.json"]) == 1 and len(got["slow.json"]) > 1 and sum(got["fast.json"]) == sum(got["slow.json"])


def stream(spark, tmp_path, df, plan, name, mode="append"):
    df.write.parquet(f"file://{tmp_path}/in")
    src = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    q = plan(src).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_live_rallies(spark, tmp_path):
    frames = [*range(0, 151, 5), *range(350, 451, 5), 5000]
    df = spark.createDataFrame([(0, f) for f in frames], "video_id long, frame long").coalesce(1)
    got = stream(spark, tmp_path, df, lambda s: live.live_rallies(s, 30.0), "rallies")
    assert sorted((r["start_frame"], r["end_frame"]) for r in got) == [(0, 150), (350, 450)]


def test_live_zones_and_votes(spark, tmp_path):
    df = spark.createDataFrame([(0, f, 1.0, 2.0) for f in [*range(0, 100, 10), 9000]], "video_id long, frame long, court_x double, court_y double").coalesce(1)
    got = stream(spark, tmp_path / "a", df, lambda s: live.live_zones(s, G.zone_label("court_x", "court_y"), 30.0), "zones")
    assert [(r["zone"], r["visits"]) for r in got] == [("A5", 10)]
    df = spark.createDataFrame([(0, 1, 7, 0.5), (0, 1, 7, 0.75)], "video_id long, track_id long, number int, conf double")
    got = stream(spark, tmp_path / "b", df, live.live_votes, "votes", "complete")
    assert [(r["weight"], r["votes"]) for r in got] == [(1.25, 2)]
