"""Registered queries over the derived detections, with DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..operators import balls as B
from ..operators import bodies, courts
from ..operators import tracks as T
from ..operators import windows as W
from . import frames as P
from .adapter import DET, FPS, FRAME_H, FRAME_W, detections, poses

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
V, VT = ["video_id"], ["video_id", "track_id"]
HALF_FRAME = 21600
H = [[0.012, 0.001, -1.5], [0.0005, 0.02, -0.8], [0.00001, 0.0004, 1.0]]
H_INV = [[83.9, -5.0, 122.0], [-2.0, 50.4, 37.3], [0.0, -0.02, 0.98]]
ROI = [(200.0, 100.0), (1000.0, 120.0), (1200.0, 700.0), (50.0, 650.0)]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str, dp: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, dp) for c in columns})


def _halves_up(df: DataFrame, *columns: str, dp: int = 4) -> DataFrame:
    """Rounded as DuckDB does: doubles are multiplied, and halves go away from zero.
    (``round`` goes by the decimal digits of a double, and takes much longer.)"""

    def nearest(c: Column) -> Column:
        whole = F.floor(F.abs(c))
        return F.signum(c) * (whole + F.when(F.abs(c) - whole >= 0.5, 1).otherwise(0))

    return df.withColumns({c: nearest(F.col(c) * 10**dp) / 10**dp for c in columns})


ZONE = """CASE WHEN court_x BETWEEN -0.5 AND 9.5 AND court_y BETWEEN -0.5 AND 18.5 THEN
  CASE WHEN least(greatest(court_y, 0), 18) <= 9 THEN 'A' || (CASE WHEN least(greatest(court_y, 0), 18) > 4.5 THEN [4, 3, 2] ELSE [5, 6, 1] END)[c + 1]
  ELSE 'B' || (CASE WHEN 18 - least(greatest(court_y, 0), 18) > 4.5 THEN [2, 3, 4] ELSE [1, 6, 5] END)[c + 1] END END"""
ZONED = f"""{DET}, zoned AS (SELECT *, {ZONE} AS zone FROM (
  SELECT *, CASE WHEN least(greatest(court_x, 0), 9) < 3 THEN 0 WHEN least(greatest(court_x, 0), 9) < 6 THEN 1 ELSE 2 END AS c FROM det))"""
BALL = f"{DET}, ball AS (SELECT * FROM det WHERE conf >= 0.1)"


def zone() -> Column:
    return G.zone_label("court_x", "court_y", margin=0.5)


def ball_rows(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).where("conf >= 0.1")


@query("zone_histogram", f"WITH {ZONED} SELECT video_id, zone, count(*) AS visits, round(sum(court_x), 4) AS sum_x, round(sum(court_y), 4) AS sum_y FROM zoned WHERE zone IS NOT NULL GROUP BY ALL")
def zone_histogram(spark, d):
    z = detections(spark, d).withColumn("zone", zone()).where("zone is not null")
    return _rounded(z.groupBy("video_id", "zone").agg(F.count(F.lit(1)).alias("visits"), F.sum("court_x").alias("sum_x"), F.sum("court_y").alias("sum_y")), "sum_x", "sum_y")


@query(
    "zone_histogram_fivb",
    f"""WITH {DET}, s AS (SELECT *, CASE WHEN court_y < 9 THEN 'A' ELSE 'B' END AS side, CASE WHEN court_x < 3 THEN 0 WHEN court_x < 6 THEN 1 ELSE 2 END AS third FROM det),
    n AS (SELECT *, CASE WHEN side = 'A' THEN third ELSE 2 - third END AS lft, CASE WHEN side = 'A' THEN court_y >= 6 ELSE court_y <= 12 END AS front FROM s)
    SELECT track_id, side, CASE WHEN NOT court_x BETWEEN 0 AND 9 THEN 0 WHEN front THEN 4 - lft ELSE [5, 6, 1][lft + 1] END AS zone, count(*) AS frames FROM n GROUP BY ALL""",
)
def zone_histogram_fivb(spark, d):
    s = detections(spark, d).withColumn("side", G.side_of("court_y"))
    return s.withColumn("zone", G.zone_number("court_x", "court_y", "side")).groupBy("track_id", "side", "zone").agg(F.count(F.lit(1)).alias("frames"))


@query("zone_by_half", f"WITH {ZONED} SELECT video_id, zone, count(*) AS visits, count(*) FILTER (frame < {HALF_FRAME}) AS first_half, count(*) FILTER (frame >= {HALF_FRAME}) AS second_half FROM zoned WHERE zone IS NOT NULL GROUP BY ALL")
def zone_by_half(spark, d):
    return T.zone_visits(detections(spark, d), zone(), V, HALF_FRAME)


def _sql_project(h, x, y) -> tuple[str, str]:
    row = lambda i: f"({h[i][0]!r}::DOUBLE * {x} + {h[i][1]!r}::DOUBLE * {y} + {h[i][2]!r}::DOUBLE)"
    return f"{row(0)} / {row(2)}", f"{row(1)} / {row(2)}"


@query(
    "homography_project",
    f"WITH {DET}, p AS (SELECT det_id, {_sql_project(H, 'img_x', 'img_y')[0]} AS px, {_sql_project(H, 'img_x', 'img_y')[1]} AS py FROM det) "
    f"SELECT det_id, round(px, 4) AS px, round(py, 4) AS py, round({_sql_project(H_INV, 'px', 'py')[0]}, 4) AS bx, round({_sql_project(H_INV, 'px', 'py')[1]}, 4) AS by_ FROM p",
)
def homography_project(spark, d):
    px, py = G.project(H, "img_x", "img_y")
    p = detections(spark, d).select("det_id", px.alias("px"), py.alias("py"))
    bx, by = G.project(H_INV, "px", "py")
    return _rounded(p.select("det_id", "px", "py", bx.alias("bx"), by.alias("by_")), "px", "py", "bx", "by_")


def _sql_polygon(points, x="fx", y="fy") -> str:
    edges, odd = [], []
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        edges.append(f"(({bx - ax}) * ({y} - {ay}) - ({by - ay}) * ({x} - {ax}) = 0 AND {x} BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND {y} BETWEEN {min(ay, by)} AND {max(ay, by)})")
        if ay != by:
            odd.append(f"CAST((({ay} > {y}) <> ({by} > {y})) AND {x} < ({bx - ax})::DOUBLE * ({y} - {ay}) / ({by - ay}) + {ax} AS INT)")
    return f"({' OR '.join(edges)} OR ({' + '.join(odd)}) % 2 = 1)"


@query("roi_filter", f"WITH {DET}, f AS (SELECT *, (x1 + x2) / 2 AS fx, CAST(y2 AS DOUBLE) AS fy FROM det) SELECT video_id, CASE WHEN {_sql_polygon(ROI)} THEN 'ok' ELSE 'fg_outside_roi' END AS status, count(*) AS n, CAST(sum(fx) AS DOUBLE) AS sum_x FROM f GROUP BY ALL")
def roi_filter(spark, d):
    fx, fy = G.ground_point("x1", "y1", "x2", "y2")
    f = detections(spark, d).select("video_id", fx.alias("fx"), fy.alias("fy"))
    return f.withColumn("status", F.when(G.in_polygon("fx", "fy", ROI), "ok").otherwise("fg_outside_roi")).groupBy("video_id", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("fx").alias("sum_x"))


STATUS = "CASE WHEN (y2 - y1) / 720 > 0.55 OR (x2 - x1) / 1280 > 0.40 THEN 'fg_too_large' WHEN y2 >= 715 AND (y2 - y1) / 720 > 0.35 THEN 'fg_at_edge' ELSE 'ok' END"


@query("classify_detection", f"WITH {DET} SELECT det_id, {STATUS} AS status FROM det")
def classify_detection(spark, d):
    return detections(spark, d).select("det_id", T.detection_status("x1", "y1", "x2", "y2", FRAME_W, FRAME_H).alias("status"))


@query(
    "reject_counts",
    f"WITH {DET}, s AS (SELECT video_id, {STATUS} AS a, (x1 + x2) / 2 AS fx, CAST(y2 AS DOUBLE) AS fy FROM det) SELECT video_id, CASE WHEN a <> 'ok' THEN a WHEN {_sql_polygon(ROI)} THEN 'ok' ELSE 'fg_outside_roi' END AS status, count(*) AS n FROM s GROUP BY ALL",
)
def reject_counts(spark, d):
    fx, fy = G.ground_point("x1", "y1", "x2", "y2")
    a = T.detection_status("x1", "y1", "x2", "y2", FRAME_W, FRAME_H)
    s = F.when(a != "ok", a).when(G.in_polygon(fx, fy, ROI), "ok").otherwise("fg_outside_roi")
    return detections(spark, d).withColumn("status", s).groupBy("video_id", "status").agg(F.count(F.lit(1)).alias("n"))


INSIDE = "court_x BETWEEN -0.1 AND 9.1 AND court_y BETWEEN -0.1 AND 18.1"
KEPT = f"""{DET}, kept AS (SELECT * FROM (SELECT *, count(*) OVER t AS n, count(*) FILTER ({INSIDE}) OVER t AS k FROM det WINDOW t AS (PARTITION BY video_id, track_id))
  WHERE n >= 15 AND k / n >= 0.5 AND k >= 7 AND {INSIDE})"""


def kept(spark, d):
    return T.eligible(detections(spark, d), G.in_court("court_x", "court_y", margin=0.1), VT)


@query("track_filter", f"WITH {KEPT} SELECT video_id, track_id, count(*) AS n, min(frame) AS a, max(frame) AS b FROM kept GROUP BY ALL")
def track_filter(spark, d):
    return kept(spark, d).groupBy(*VT).agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("a"), F.max("frame").alias("b"))


@query(
    "track_summary",
    f"""WITH {KEPT}, s AS (SELECT *, sqrt(pow(court_x - lag(court_x) OVER w, 2) + pow(court_y - lag(court_y) OVER w, 2)) AS step FROM kept WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame, det_id)),
    t AS (SELECT video_id, track_id, count(*) AS samples, (max(frame) - min(frame)) * 60.0::DOUBLE AS span, coalesce(sum(step), 0) AS dist, median(court_y) AS mid, sum(court_x) AS x, sum(court_y) AS y FROM s GROUP BY ALL)
    SELECT video_id, track_id, samples, CASE WHEN samples >= 50 THEN 'alta' WHEN samples >= 25 THEN 'media' ELSE 'baja' END AS reliability, round(dist, 4) AS distance,
      round(dist / span, 6) AS speed, CASE WHEN mid <= 9 THEN 'A' ELSE 'B' END AS side, round(x, 4) AS sum_x, round(y, 4) AS sum_y FROM t""",
)
def track_summary(spark, d):
    """What the summary rounds, at more digits than it shows."""
    return _rounded(_rounded(T.track_stats(kept(spark, d), VT, FPS), "distance", "sum_x", "sum_y").drop("span"), "speed", dp=6)


PROFILE = f"""{ZONED}, prof AS (SELECT video_id, track_id, zone, count(*) AS visits, min({{'f': frame, 'd': det_id}}) AS fst FROM zoned WHERE zone IS NOT NULL GROUP BY ALL),
  ranked AS (SELECT video_id, track_id, zone, visits, CAST(round_even(visits / sum(visits) OVER (PARTITION BY video_id, track_id) * 100, 0) AS INT) AS pct,
    CAST(row_number() OVER (PARTITION BY video_id, track_id ORDER BY visits DESC, fst) AS INT) AS place FROM prof)"""


@query("dominant_zone", f"WITH {PROFILE} SELECT video_id, track_id, zone AS dominant_zone FROM ranked WHERE place = 1")
def dominant_zone(spark, d):
    return T.dominant_zone(detections(spark, d), zone(), VT)


@query("zone_profile", f"WITH {PROFILE} SELECT * FROM ranked")
def zone_profile(spark, d):
    return T.zone_profile(detections(spark, d), zone(), VT)


@query("top_tracks", f"WITH {KEPT}, t AS (SELECT video_id, track_id, count(*) AS n FROM kept GROUP BY ALL) SELECT track_id, n, CAST(row_number() OVER (ORDER BY n DESC, track_id) AS INT) AS place FROM t QUALIFY place <= 10")
def top_tracks(spark, d):
    t = kept(spark, d).groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "track_id").limit(10)
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "track_id")))


# ---- balls

STEADY_GAP, STEADY_W = 200, 4000.0
ISLANDS = f"""{BALL}, lagged AS (SELECT *, lag(frame) OVER w AS pf, lag(img_x) OVER w AS px, lag(img_y) OVER w AS py FROM ball WINDOW w AS (PARTITION BY video_id ORDER BY frame, det_id)),
  marked AS (SELECT *, CASE WHEN frame - pf <= {STEADY_GAP} AND sqrt(pow(img_x - px, 2) + pow(img_y - py, 2)) <= 0.09::DOUBLE * {STEADY_W} * greatest(frame - pf, 1) THEN 0 ELSE 1 END AS st FROM lagged),
  isl AS (SELECT *, sum(st) OVER (PARTITION BY video_id ORDER BY frame, det_id ROWS UNBOUNDED PRECEDING) AS island FROM marked)"""


@query("ball_islands", f"WITH {ISLANDS} SELECT video_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(frame) AS a, max(frame) AS b FROM isl GROUP BY ALL HAVING count(*) >= 2")
def ball_islands(spark, d):
    s = B.steady_ball(ball_rows(spark, d), V, STEADY_W, max_gap=STEADY_GAP)
    return s.groupBy("video_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("a"), F.max("frame").alias("b"))


RALLY_GAP = 60  # minutes
RALLIES = f"""{BALL}, l AS (SELECT *, CASE WHEN frame - lag(frame) OVER w <= {RALLY_GAP} THEN 0 ELSE 1 END AS st FROM ball WINDOW w AS (PARTITION BY video_id ORDER BY frame, det_id)),
  r AS (SELECT *, sum(st) OVER (PARTITION BY video_id ORDER BY frame, det_id ROWS UNBOUNDED PRECEDING) AS rally FROM l),
  g AS (SELECT video_id, rally, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_points, arg_min(court_x, frame * 1000000 + det_id) AS sx, arg_min(court_y, frame * 1000000 + det_id) AS sy FROM r GROUP BY ALL),
  rallies AS (SELECT video_id, start_frame, end_frame, round_even((end_frame - start_frame) * 60.0::DOUBLE, 2) AS duration_s, n_points, CASE WHEN sy <= 9 THEN 'A' ELSE 'B' END AS serve_side, round(sx, 3) AS serve_x_m, round(sy, 3) AS serve_y_m
    FROM g WHERE n_points >= 3 AND end_frame > start_frame)"""


def _rallies(spark, d):
    return B.rallies(ball_rows(spark, d), V, FPS, max_gap_s=RALLY_GAP * 60, dp=3)


@query("rally_segments", f"WITH {RALLIES} SELECT * FROM rallies")
def rally_segments(spark, d):
    return _rallies(spark, d)


@query(
    "play_summary",
    f"""WITH {RALLIES} SELECT video_id, count(*) AS n_rallies, count(*) AS n_serves, round_even(avg(duration_s), 2) AS avg_rally_s, max(duration_s) AS longest_rally_s, round_even(sum(duration_s), 2) AS total_play_s,
    count(*) FILTER (serve_side = 'A') AS serves_a, count(*) FILTER (serve_side = 'B') AS serves_b FROM rallies GROUP BY ALL""",
)
def play_summary(spark, d):
    return B.play_summary(_rallies(spark, d), V)


DEDUP = f"{BALL}, one AS (SELECT * FROM ball QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY conf DESC, det_id) = 1)"


@query("ball_dedup", f"WITH {DEDUP} SELECT video_id, frame, det_id, conf FROM one")
def ball_dedup(spark, d):
    return W.dedup_frames(ball_rows(spark, d), V).select("video_id", "frame", "det_id", "conf")


@query("ball_rate", f"WITH {BALL} SELECT video_id, count(DISTINCT frame) AS ball_frames, greatest(1, max(frame) // 5) AS evaluated, round(count(DISTINCT frame) / greatest(1, max(frame) // 5), 4) AS rate FROM ball GROUP BY ALL")
def ball_rate(spark, d):
    return _rounded(B.ball_rate(ball_rows(spark, d), V), "rate")


GAP = 40
FILLED = f"""{DEDUP}, span AS (SELECT video_id, min(frame) AS a, max(frame) AS b FROM one GROUP BY ALL),
  grid AS (SELECT video_id, unnest(generate_series(a, b)) AS frame FROM span),
  dense AS (SELECT g.video_id, g.frame, o.img_x, o.img_y FROM grid g LEFT JOIN one o USING (video_id, frame)),
  near AS (SELECT *, last_value(CASE WHEN img_x IS NOT NULL THEN frame END IGNORE NULLS) OVER p AS pf, last_value(img_x IGNORE NULLS) OVER p AS px, last_value(img_y IGNORE NULLS) OVER p AS py,
      first_value(CASE WHEN img_x IS NOT NULL THEN frame END IGNORE NULLS) OVER n AS nf, first_value(img_x IGNORE NULLS) OVER n AS nx, first_value(img_y IGNORE NULLS) OVER n AS ny FROM dense
    WINDOW p AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  filled AS (SELECT video_id, frame, CASE WHEN img_x IS NOT NULL THEN img_x WHEN nf - pf - 1 <= {GAP} THEN px + (nx - px) * (frame - pf) / (nf - pf) END AS img_x,
    CASE WHEN img_y IS NOT NULL THEN img_y WHEN nf - pf - 1 <= {GAP} THEN py + (ny - py) * (frame - pf) / (nf - pf) END AS img_y FROM near)"""


def _filled(spark, d):
    dense = W.dense_frames(W.dedup_frames(ball_rows(spark, d), V), V, ["img_x", "img_y"])
    return W.fill_gaps(dense, V, ["img_x", "img_y"], GAP)


@query("gap_fill", f"WITH {FILLED} SELECT video_id, frame, round(img_x, 4) AS img_x, round(img_y, 4) AS img_y FROM filled")
def gap_fill(spark, d):
    return _rounded(_filled(spark, d), "img_x", "img_y")


SMOOTHED = f"""{FILLED}, smoothed AS (SELECT video_id, frame, CASE WHEN img_x IS NOT NULL AND count(img_x) OVER w >= 2 THEN avg(img_x) OVER w ELSE img_x END AS img_x,
    CASE WHEN img_y IS NOT NULL AND count(img_y) OVER w >= 2 THEN avg(img_y) OVER w ELSE img_y END AS img_y FROM filled
  WINDOW w AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


def _smoothed(spark, d):
    return W.smooth(_filled(spark, d), V, ["img_x", "img_y"])


@query("smooth", f"WITH {SMOOTHED} SELECT video_id, frame, round(img_x, 4) AS img_x, round(img_y, 4) AS img_y FROM smoothed")
def smooth(spark, d):
    return _rounded(_smoothed(spark, d), "img_x", "img_y")


MOVES = f"""{SMOOTHED}, moves AS (SELECT video_id, frame, sqrt(pow(lead(img_x) OVER w - 2 * img_x + lag(img_x) OVER w, 2) + pow(lead(img_y) OVER w - 2 * img_y + lag(img_y) OVER w, 2)) AS accel FROM smoothed
  WINDOW w AS (PARTITION BY video_id ORDER BY frame))"""


def _moves(spark, d):
    return W.acceleration(_smoothed(spark, d), V, "img_x", "img_y")


@query("ball_accel", f"WITH {MOVES} SELECT video_id, frame, round(accel, 4) AS accel FROM moves WHERE accel IS NOT NULL")
def ball_accel(spark, d):
    return _moves(spark, d).where("accel is not null").select("video_id", "frame", F.round("accel", 4).alias("accel"))


@query("accel_threshold", f"WITH {MOVES} SELECT video_id, round(quantile_cont(accel, 0.92), 4) AS threshold, count(*) AS n FROM moves WHERE accel IS NOT NULL GROUP BY ALL")
def accel_threshold(spark, d):
    return _rounded(B.accel_threshold(_moves(spark, d), V), "threshold")


# ---- joins at moments

TOUCHES = "touch AS (SELECT video_id, det_id AS touch_id, frame FROM det)"  # every event is a moment


def touches(spark, d):
    return detections(spark, d).select("video_id", F.col("det_id").alias("touch_id"), "frame")


def _ball_for_touches(spark, d):
    return detections(spark, d).where("conf >= 0.6")


NEAR = f"""{DET}, {TOUCHES}, b AS (SELECT video_id, frame AS nf, max_by(court_x, det_id) AS bx, max_by(court_y, det_id) AS by_ FROM det WHERE conf >= 0.6 GROUP BY ALL),
  nearest AS (SELECT t.video_id, t.touch_id, t.frame, nf, bx, by_ FROM touch t LEFT JOIN b ON b.video_id = t.video_id AND nf BETWEEN frame - 30 AND frame + 30
    QUALIFY row_number() OVER (PARTITION BY t.video_id, t.touch_id ORDER BY abs(nf - frame) NULLS LAST, nf - frame) = 1)"""


def _nearest(spark, d):
    return W.nearest_frame(touches(spark, d), _ball_for_touches(spark, d), V, ["court_x", "court_y"], reach=30)


@query("nearest_ball", f"WITH {NEAR} SELECT video_id, touch_id, frame, nf AS near_frame, round(bx, 4) AS near_court_x, round(by_, 4) AS near_court_y FROM nearest")
def nearest_ball(spark, d):
    return _rounded(_nearest(spark, d), "near_court_x", "near_court_y")


ASOF = """samples AS (SELECT video_id, track_id, frame, det_id, court_x, court_y FROM det WHERE conf < 0.6),
  tracks AS (SELECT video_id, track_id, min({'f': frame, 'd': det_id}) AS seen FROM samples GROUP BY ALL),
  asks AS (SELECT t.video_id, track_id, frame, touch_id, seen FROM touch t JOIN tracks USING (video_id)),
  bef AS (SELECT k.*, s.frame AS af, s.court_x AS ax, s.court_y AS ay FROM asks k LEFT JOIN samples s ON s.video_id = k.video_id AND s.track_id = k.track_id AND s.frame <= k.frame
    QUALIFY row_number() OVER (PARTITION BY k.video_id, k.track_id, touch_id ORDER BY s.frame DESC NULLS LAST, s.det_id DESC) = 1),
  aft AS (SELECT k.*, s.frame AS zf, s.court_x AS zx, s.court_y AS zy FROM bef k LEFT JOIN samples s ON s.video_id = k.video_id AND s.track_id = k.track_id AND s.frame > k.frame
    QUALIFY row_number() OVER (PARTITION BY k.video_id, k.track_id, touch_id ORDER BY s.frame NULLS LAST, s.det_id) = 1),
  pos AS (SELECT video_id, touch_id, frame, track_id, seen,
    CASE WHEN af IS NOT NULL AND zf IS NOT NULL THEN CASE WHEN zf - af <= 600 THEN ax + (zx - ax) * ((frame - af) / (zf - af)) END WHEN af IS NOT NULL THEN CASE WHEN frame - af <= 600 THEN ax END WHEN zf - frame <= 600 THEN zx END AS x,
    CASE WHEN af IS NOT NULL AND zf IS NOT NULL THEN CASE WHEN zf - af <= 600 THEN ay + (zy - ay) * ((frame - af) / (zf - af)) END WHEN af IS NOT NULL THEN CASE WHEN frame - af <= 600 THEN ay END WHEN zf - frame <= 600 THEN zy END AS y FROM aft)"""


LIFT = 1e-7  # interpolated positions often lie between two roundings; this lifts them off


def _samples(spark, d):
    return detections(spark, d).where("conf < 0.6")


@query("asof_interp", f"WITH {DET}, {TOUCHES}, {ASOF} SELECT video_id, touch_id, frame, track_id, round(x + {LIFT}, 4) AS x, round(y + {LIFT}, 4) AS y FROM pos WHERE x IS NOT NULL")
def asof_interp(spark, d):
    """A track's position in a frame is worked out once; its touches stand side by side,
    so that Parquet's compression takes most of what they repeat."""
    found = W.known_positions(W.by_frame(touches(spark, d)), _samples(spark, d), most=600).where("x is not null")
    found = found.select("video_id", "moments", "frame", "track_id", *((F.col(c) + LIFT).alias(c) for c in ("x", "y")))
    return _halves_up(found, "x", "y").select("video_id", F.inline("moments"), "frame", "track_id", "x", "y")


@query(
    "attribute_touches",
    f"""WITH {NEAR.replace("- 30 AND frame + 30", "- 3 AND frame + 3")}, {ASOF.replace("600", "30")}, dist AS (SELECT p.video_id, p.touch_id, track_id, seen, sqrt(pow(x - bx, 2) + pow(y - by_, 2)) AS d FROM pos p JOIN nearest n ON n.video_id = p.video_id AND n.touch_id = p.touch_id),
    best AS (SELECT * FROM dist WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id, touch_id ORDER BY d, seen, track_id) = 1)
    SELECT n.video_id, n.touch_id, n.frame, round(bx, 4) AS court_x, round(by_, 4) AS court_y, CASE WHEN d <= 1.5 THEN track_id END AS track_id, round(d, 4) AS player_distance_m
    FROM nearest n LEFT JOIN best b ON b.video_id = n.video_id AND b.touch_id = n.touch_id""",
)
def attribute_touches(spark, d):
    found = B.attribute(touches(spark, d), _ball_for_touches(spark, d), _samples(spark, d), dp=None)
    return _halves_up(found, "court_x", "court_y", "player_distance_m")


@query(
    "touch_rallies",
    f"""WITH {DET}, t AS (SELECT video_id, det_id AS touch_id, frame, track_id FROM det), l AS (SELECT *, CASE WHEN frame - lag(frame) OVER w <= 90 THEN 0 ELSE 1 END AS st FROM t WINDOW w AS (PARTITION BY video_id ORDER BY frame, touch_id)),
    r AS (SELECT *, sum(st) OVER (PARTITION BY video_id ORDER BY frame, touch_id ROWS UNBOUNDED PRECEDING) - 1 AS rally_id FROM l)
    SELECT video_id, touch_id, frame, track_id, CAST(rally_id AS BIGINT) AS rally_id, CAST(row_number() OVER (PARTITION BY video_id, rally_id ORDER BY frame, touch_id) - 1 AS INT) AS seq_in_rally FROM r""",
)
def touch_rallies(spark, d):
    t = detections(spark, d).select("video_id", F.col("det_id").alias("touch_id"), "frame", "track_id")
    return B.touch_rallies(t, V, FPS, gap_s=5400)


ROSTER = [(n, f"player {n}") for n in range(0, 90, 3)]


@query(
    "jersey_vote",
    f"""WITH {DET}, roster AS (SELECT unnest(range(0, 90, 3)) AS number), firsts AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY det_id) AS k FROM det),
    good AS (SELECT *, CAST(trim(text) AS BIGINT) AS number FROM firsts WHERE k <= 30 AND regexp_matches(trim(text), '^[0-9]{{1,2}}$') AND conf >= 0.3), ok AS (SELECT * FROM good WHERE number IN (SELECT number FROM roster)),
    sums AS (SELECT video_id, track_id, number, sum(conf) AS weight, min(det_id) AS f FROM ok GROUP BY ALL),
    best AS (SELECT *, sum(weight) OVER (PARTITION BY video_id, track_id) AS total FROM sums QUALIFY row_number() OVER (PARTITION BY video_id, track_id ORDER BY round(weight, 6) DESC, f) = 1),
    votes AS (SELECT video_id, track_id, count(*) AS votes FROM ok GROUP BY ALL), t AS (SELECT DISTINCT video_id, track_id FROM det)
    SELECT t.video_id, t.track_id, CASE WHEN weight >= 1.5 AND weight / total >= 0.5 THEN CAST(number AS INT) END AS number, CASE WHEN weight >= 1.5 AND weight / total >= 0.5 THEN 'player ' || number ELSE 'desconocida' END AS name,
      coalesce(round(weight / total, 4), 0) AS confidence, coalesce(votes, 0) AS votes, coalesce(round(weight, 4), 0) AS weight
    FROM t LEFT JOIN best b ON b.video_id = t.video_id AND b.track_id = t.track_id LEFT JOIN votes v ON v.video_id = t.video_id AND v.track_id = t.track_id""",
)
def jersey_vote(spark, d):
    det = detections(spark, d)
    roster = spark.createDataFrame(ROSTER, "number int, name string")
    reads = T.roster_reads(det.withColumn("seq", F.col("det_id")), roster)
    return _halves_up(T.vote(reads, det, roster, dp=None), "confidence", "weight")


# ---- bodies, frames, tables

_KP = "embedding[{}]::DOUBLE"
_P = lambda i: (_KP.format(2 * i + 1), _KP.format(2 * i + 2))
_S = lambda *parts: " AND ".join(f"embedding[{35 + i}]::DOUBLE + 0.5 >= 0.5" for i in parts)


def _sql_knee(h, k, a) -> str:
    (hx, hy), (kx, ky), (ax, ay) = _P(h), _P(k), _P(a)
    u, v = (f"({hx} - {kx})", f"({hy} - {ky})"), (f"({ax} - {kx})", f"({ay} - {ky})")
    cos = f"({u[0]} * {v[0]} + {u[1]} * {v[1]}) / (sqrt(pow({u[0]}, 2) + pow({u[1]}, 2)) * sqrt(pow({v[0]}, 2) + pow({v[1]}, 2)) + 1e-9)"
    return f"CASE WHEN {_S(h, k, a)} THEN degrees(acos(greatest(-1, least(1, {cos})))) END"


POSE_SQL = f"""m AS (SELECT vec_id, vec_id % 7 AS track_id,
    CASE WHEN {_S(5, 6, 11, 12)} THEN degrees(atan2(({_P(5)[0]} + {_P(6)[0]}) / 2 - ({_P(11)[0]} + {_P(12)[0]}) / 2, -(({_P(5)[1]} + {_P(6)[1]}) / 2 - ({_P(11)[1]} + {_P(12)[1]}) / 2))) END AS lean,
    CASE WHEN {_S(15, 16)} THEN sqrt(pow({_P(15)[0]} - {_P(16)[0]}, 2) + pow({_P(15)[1]} - {_P(16)[1]}, 2)) END AS stance,
    {_sql_knee(11, 13, 15)} AS lk, {_sql_knee(12, 14, 16)} AS rk FROM embeddings)"""


@query(
    "pose_metrics",
    f"""WITH {POSE_SQL} SELECT track_id, count(lean) AS samples_with_pose, round(avg(lean), 4) AS lean_avg, round(max(lean), 4) AS lean_max, round(avg(stance), 4) AS stance_avg, round(avg(coalesce((lk + rk) / 2, lk, rk)), 3) AS knee_avg
    FROM m GROUP BY ALL HAVING count(lean) + count(stance) + count(coalesce(lk, rk)) > 0""",
)
def pose_metrics(spark, d):
    t = bodies.pose_stats(poses(spark, d), ["track_id"], dp=4, knee_dp=3)
    return t.select("track_id", "samples_with_pose", F.col("torso_lean_deg_avg").alias("lean_avg"), F.col("torso_lean_deg_max").alias("lean_max"), F.col("stance_width_px_avg").alias("stance_avg"), F.col("knee_flexion_deg_avg").alias("knee_avg"))


GRID = f"{DET}, grid AS (SELECT video_id, CAST(floor(img_x / 40) AS BIGINT) AS gx, CAST(floor(img_y / 40) AS BIGINT) AS gy, sum(CASE WHEN conf >= 0.6 THEN 0.3::DOUBLE ELSE 1 END) AS weight FROM det GROUP BY ALL)"


@query("density_grid", f"WITH {GRID} SELECT video_id, gx, gy, round(weight, 4) AS weight, round(quantile_cont(weight, 0.75) OVER (PARTITION BY video_id), 4) AS p75 FROM grid")
def density_grid(spark, d):
    g = T.density_grid(detections(spark, d), 40, F.when(F.col("conf") >= 0.6, 0.3).otherwise(1.0))
    return _rounded(g.withColumnRenamed("threshold", "p75"), "weight", "p75")


@query("best_frame", f"WITH {DET}, f AS (SELECT video_id, frame, round(count(*) + avg(conf), 6) AS score FROM det WHERE conf >= 0.5 GROUP BY ALL) SELECT video_id, frame, score FROM f QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame) = 1")
def best_frame(spark, d):
    return T.best_frame(detections(spark, d))


@query("best_mask", f"WITH {DET}, q AS (SELECT video_id, frame, det_id, CASE WHEN img_x / 1280 >= 0.06 THEN round(conf * (img_y / 720) * (0.5 + img_x / 1280), 6) ELSE 0 END AS score FROM det) SELECT video_id, frame, score FROM q QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame, det_id) = 1")
def best_mask(spark, d):
    score = G.mask_quality("conf", F.col("img_y") / 720, F.col("img_x") / 1280)
    return T.best_mask(detections(spark, d), F.round(score, 6))


@query("union_long", f"WITH {DET} SELECT frame, round(frame / 30, 3) AS t, 'player' AS kind, track_id, round(court_x, 3) AS x_m, round(court_y, 3) AS y_m, round(conf, 3) AS conf FROM det WHERE conf < 0.6 UNION ALL SELECT frame, round(frame / 30, 3), 'ball', -1, round(court_x, 3), round(court_y, 3), round(conf, 3) FROM det WHERE conf >= 0.6")
def union_long(spark, d):
    det = detections(spark, d)
    return P.union_long(det.where("conf < 0.6"), det.where("conf >= 0.6"), 30)


@query("landing_points", f"WITH {DET} SELECT frame, det_id, round(court_x, 3) AS x_m, round(court_y, 3) AS y_m FROM det WHERE conf >= 0.6 AND court_x BETWEEN -0.1 AND 9.1 AND court_y BETWEEN -0.1 AND 18.1")
def landing_points(spark, d):
    return P.landing_points(detections(spark, d).where("conf >= 0.6"))


@query("sampled_frames", f"WITH {DET} SELECT det_id, frame, track_id FROM det WHERE frame % 5 = 0 AND conf >= 0.4 AND track_id IS NOT NULL")
def sampled_frames(spark, d):
    return T.sample_frames(detections(spark, d), 5).where("conf >= 0.4 and track_id is not null").select("det_id", "frame", "track_id")


@query("centre_windows", f"WITH {DET}, w AS (SELECT video_id, track_id, det_id, frame, avg(conf) OVER w AS m, count(*) OVER w AS n FROM det WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame, det_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) SELECT video_id, track_id, det_id, frame, round(m, 4) AS mean_conf FROM w WHERE n = 9")
def centre_windows(spark, d):
    w = W.centred_windows(detections(spark, d), VT, "conf")
    mean = F.aggregate("window", F.lit(0.0), lambda a, x: a + x) / 9
    return w.select(*VT, "det_id", "frame", F.round(mean, 4).alias("mean_conf"))


@query("pose_frames", f"WITH {DET}, f AS (SELECT video_id, frame, count(*) AS n FROM det WHERE conf >= 0.3 GROUP BY ALL) SELECT video_id, frame, n FROM f QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY n DESC, frame) = 1")
def pose_frames(spark, d):
    return T.fullest_frame(detections(spark, d))


@query("half_tracks", f"WITH {DET} SELECT video_id, track_id, CASE WHEN frame < {HALF_FRAME} THEN 1 ELSE 2 END AS half, count(*) AS n FROM det GROUP BY ALL HAVING count(*) >= 5")
def half_tracks(spark, d):
    return T.by_half(detections(spark, d), VT, HALF_FRAME)


@query("zone_display", f"WITH {ZONED}, z AS (SELECT zone, count(*) AS visits FROM zoned WHERE zone IS NOT NULL GROUP BY ALL) SELECT zone, visits, round(visits / max(visits) OVER (), 4) AS share, list_position([4, 3, 2, 5, 6, 1], CAST(right(zone, 1) AS INT)) AS place FROM z")
def zone_display(spark, d):
    z = detections(spark, d).withColumn("zone", zone()).where("zone is not null").groupBy("zone").agg(F.count(F.lit(1)).alias("visits"))
    return _rounded(T.zone_order(z), "share")


QUALITY = f"""{KEPT}, lens AS (SELECT track_id, count(*) AS n FROM kept GROUP BY ALL), tops AS (SELECT avg(n) AS top FROM (SELECT n FROM lens ORDER BY n DESC LIMIT 12)),
  z AS (SELECT count(*) AS nz FROM (SELECT zone FROM (WITH {ZONED} SELECT zone FROM zoned) WHERE zone IS NOT NULL GROUP BY ALL HAVING count(*) > 3)),
  c AS (SELECT (SELECT count(*) FROM lens) AS n, (SELECT sum(n) FROM lens) AS kept_n, (SELECT count(DISTINCT frame) FROM det WHERE conf >= 0.9) AS bf, (SELECT count(*) FROM det) AS total,
    (SELECT count(*) FROM det WHERE {STATUS} <> 'ok') AS rej, nz, top FROM z, tops),
  p AS (SELECT *, bf / greatest(total, 1) AS rate, CAST(round_even(30 * least(n, 12) / greatest(n, 12), 0) AS INT) AS tracks_pts, CAST(least(25, trunc(nz / 12 * 25)) AS INT) AS zones_pts,
    CASE WHEN n > 0 THEN CAST(round_even(10 * (0.5 * least(1, top / total / 0.5) + 0.5 * greatest(0, 1 - abs(n - 12) / 12)), 0) AS INT) ELSE 0 END AS stability_pts, CAST(trunc(kept_n / (kept_n + rej) * 15) AS INT) AS filter_pts FROM c),
  q AS (SELECT *, CAST(CASE WHEN rate >= 0.5 THEN 20 WHEN rate >= 0.1 THEN trunc(4 + (rate - 0.1) / 0.4 * 16) ELSE trunc(rate / 0.1 * 4) END AS INT) AS ball_pts FROM p)"""


@query("quality_score", f"WITH {QUALITY} SELECT tracks_pts, zones_pts, ball_pts, filter_pts, stability_pts, tracks_pts + zones_pts + ball_pts + filter_pts + stability_pts AS score FROM q")
def quality_score(spark, d):
    det = detections(spark, d)
    zones = det.withColumn("zone", zone()).where("zone is not null").groupBy("zone").agg(F.count(F.lit(1)).alias("visits"))
    lens = kept(spark, d).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    status = T.detection_status("x1", "y1", "x2", "y2", FRAME_W, FRAME_H)
    n = det.agg(F.count_distinct(F.when(F.col("conf") >= 0.9, F.col("frame"))).alias("bf"), F.count(F.lit(1)).alias("total"), F.count_if(status != "ok").alias("rej")).first()
    return T.quality(lens, zones, n["bf"], n["rej"], n["total"]).select("tracks_pts", "zones_pts", "ball_pts", "filter_pts", "stability_pts", "score")


# ---- grouped steps without an SQL form


FOOT = _sql_project(H, "((x1 + x2) / 2)", "y2::DOUBLE")
CENTRE = _sql_project(H, "((x1 + x2) / 2)", "((y1 + y2) / 2)")
FRAMES = f"""{DET}, placed AS (
  SELECT *, {FOOT[0]} AS x, {FOOT[1]} AS y FROM det WHERE conf < 0.6 AND track_id IS NOT NULL
), sided AS (
  SELECT *, CASE WHEN y < 9 THEN 'A' ELSE 'B' END AS side FROM placed WHERE x BETWEEN -1 AND 10 AND y BETWEEN -1 AND 19
), players AS (
  SELECT video_id, frame, 'player' AS kind, track_id, round(x, 3) AS x_m, round(y, 3) AS y_m, side,
    CASE WHEN x < 0 OR x > 9 THEN 0
      WHEN side = 'A' AND y >= 6 THEN CASE WHEN x < 3 THEN 4 WHEN x < 6 THEN 3 ELSE 2 END
      WHEN side = 'A' THEN CASE WHEN x < 3 THEN 5 WHEN x < 6 THEN 6 ELSE 1 END
      WHEN y <= 12 THEN CASE WHEN x < 3 THEN 2 WHEN x < 6 THEN 3 ELSE 4 END
      ELSE CASE WHEN x < 3 THEN 1 WHEN x < 6 THEN 6 ELSE 5 END END AS zone, round(conf, 3) AS conf, NULL::BOOLEAN AS low FROM sided
), balls AS (
  SELECT video_id, frame, 'ball' AS kind, NULL::BIGINT AS track_id, round({CENTRE[0]}, 3) AS x_m, round({CENTRE[1]}, 3) AS y_m, NULL AS side, NULL AS zone,
    round(conf, 3) AS conf, y2 > 360 AS low FROM det WHERE conf >= 0.6 QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY conf DESC, det_id) = 1
)"""


@query("frame_rows", f"WITH {FRAMES} SELECT * FROM players UNION ALL SELECT * FROM balls")
def frame_rows(spark, d):
    return P.frame_rows(detections(spark, d), H, F.col("conf") >= 0.6, FRAME_H)


@query("zone_occupancy", f"WITH {FRAMES} SELECT video_id, track_id, zone, count(*) AS frames FROM players GROUP BY ALL")
def zone_occupancy(spark, d):
    return P.zone_occupancy(frame_rows(spark, d))


@query(
    "heatmap_decode",
    """WITH h AS (SELECT vec_id, embedding::DOUBLE[] AS h FROM embeddings), p AS (SELECT vec_id, h, list_max(h) AS top, list_position(h, list_max(h)) - 1 AS cell FROM h)
SELECT vec_id, (cell % 8) * 160.0::DOUBLE AS x, (cell // 8) * 90.0::DOUBLE AS y,
  round(greatest(2, sqrt(len(list_filter(h, lambda v: v > 0.125)) / pi())) * 160, 4) AS radius, round(top, 4) AS confidence FROM p WHERE top >= 0.25""",
)
def heatmap_decode(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("h"))
    p = e.select("vec_id", G.heatmap_peak("h", 8, 8, 0.25, FRAME_W, FRAME_H).alias("p")).where("p is not null")
    return p.select("vec_id", "p.x", "p.y", F.round("p.radius", 4).alias("radius"), F.round("p.confidence", 4).alias("confidence"))


# the greedy joining, one track at a time: a track takes the first later start that is near its end; passes repeat until none joins
STITCH = f"""{DET}, cut AS (SELECT *, CAST(frame - lag(frame) OVER w > 600 AS INT) AS hole FROM det WHERE conf >= 0.4 WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame, det_id)),
  frag AS (SELECT * REPLACE (track_id * 1000000 + 1 + sum(coalesce(hole, 0)) OVER (PARTITION BY video_id, track_id ORDER BY frame, det_id) AS track_id) FROM cut),
  ends AS (SELECT video_id, CAST(track_id AS BIGINT) AS track_id, min((frame, det_id, court_x, court_y)) AS s, max((frame, det_id, court_x, court_y)) AS e FROM frag GROUP BY ALL),
  track AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s[1], s[2]) AS i FROM ends),
  later AS (SELECT a.video_id, a.i AS t, list(b.i ORDER BY b.i) AS next FROM track a JOIN track b ON b.video_id = a.video_id AND b.s[1] > a.e[1] AND b.s[1] <= a.e[1] + 720
    WHERE pow(b.s[3] - a.e[3], 2) + pow(b.s[4] - a.e[4], 2) <= 36 GROUP BY ALL),
  walk AS (SELECT video_id, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS pos, count(*) AS n, list(i ORDER BY i) AS tails, list(i ORDER BY i) AS roots, true AS joined FROM track GROUP BY video_id
    UNION ALL
    SELECT video_id, step + 1, pos, n,
      CASE WHEN b IS NULL THEN tails ELSE list_transform(tails, lambda v, j: CASE WHEN j = pos THEN tails[b] ELSE v END) END,
      CASE WHEN b IS NULL THEN roots ELSE list_transform(roots, lambda v, j: CASE WHEN j = b THEN pos ELSE v END) END, b IS NOT NULL OR (joined AND pos > 1)
    FROM (SELECT m.*, list_filter(l.next, lambda c: m.roots[c] = c)[1] AS b FROM
        (SELECT video_id, step, n, tails, roots, joined, coalesce(ahead, 1) AS pos
          FROM (SELECT *, list_filter(range(pos + 1, n + 1), lambda j: roots[j] = j)[1] AS ahead FROM walk) WHERE ahead IS NOT NULL OR joined) m
      LEFT JOIN later l ON l.video_id = m.video_id AND l.t = m.tails[m.pos])),
  parent AS (SELECT video_id, unnest(range(1, n + 1)) AS i, unnest(arg_max(roots, step)) AS up FROM (SELECT video_id, n, step, roots FROM walk) GROUP BY video_id, n),
  climb AS (SELECT video_id, i, up, i AS was FROM parent UNION ALL SELECT c.video_id, c.i, p.up, c.up FROM climb c JOIN parent p ON p.video_id = c.video_id AND p.i = c.up WHERE c.up <> c.was)"""


@query(
    "stitch_tracks",
    f"""WITH RECURSIVE {STITCH} SELECT t.video_id, t.track_id, r.track_id AS root FROM climb c JOIN track t USING (video_id, i) JOIN track r ON r.video_id = c.video_id AND r.i = c.up
  WHERE c.up IN (SELECT p.i FROM parent p WHERE p.video_id = c.video_id AND p.up = p.i) GROUP BY ALL""",
)
def stitch_tracks(spark, d):
    """Fragments (a track cut at its holes) joined again."""
    det = detections(spark, d).where("conf >= 0.4")
    cut = W.frame_islands(det, VT, 600, "fragment").withColumn("track_id", F.col("track_id") * 1_000_000 + F.col("fragment"))
    return T.stitch_mapping(cut, fps=1.0, max_gap_s=720, max_jump_m=6.0)


@query("trajectory")
def trajectory(spark, d):
    return B.flights(ball_rows(spark, d), fps=1.0, frame_w=FRAME_W, max_gap_s=30)


PEAKS = f"""{SMOOTHED}, acc AS (SELECT video_id, frame, img_x, img_y, row_number() OVER w AS i,
    round(sqrt(pow(lead(img_x) OVER w - 2 * img_x + lag(img_x) OVER w, 2) + pow(lead(img_y) OVER w - 2 * img_y + lag(img_y) OVER w, 2)), 6) AS accel
  FROM smoothed WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
  height AS (SELECT video_id, quantile_cont(accel, 0.92) AS h FROM acc GROUP BY ALL HAVING count(accel) > 0 AND count(img_x) >= 10),
  signal AS (SELECT video_id, i, coalesce(accel, 0) AS x FROM acc),
  stepped AS (SELECT *, CAST(lag(x) OVER (PARTITION BY video_id ORDER BY i) IS DISTINCT FROM x AS INT) AS step FROM signal),
  flat AS (SELECT video_id, r, min(i) AS lo, max(i) AS hi, min(x) AS x FROM (SELECT *, sum(step) OVER (PARTITION BY video_id ORDER BY i) AS r FROM stepped) GROUP BY video_id, r),
  around AS (SELECT *, lag(x) OVER w AS before, lead(x) OVER w AS after FROM flat WINDOW w AS (PARTITION BY video_id ORDER BY r)),
  ranked AS (SELECT video_id, (lo + hi) // 2 AS i, row_number() OVER (PARTITION BY video_id ORDER BY x DESC, (lo + hi) // 2 DESC) AS k
    FROM around JOIN height USING (video_id) WHERE before < x AND after < x AND x >= h),
  kept AS (SELECT video_id, k, [i] AS places FROM ranked WHERE k = 1 UNION ALL
    SELECT r.video_id, r.k, CASE WHEN len(list_filter(places, lambda p: abs(p - r.i) < 12)) = 0 THEN list_append(places, r.i) ELSE places END
    FROM kept JOIN ranked r ON r.video_id = kept.video_id AND r.k = kept.k + 1),
  spaced AS (SELECT video_id, unnest(arg_max(places, k)) AS i FROM kept GROUP BY video_id),
  tops AS (SELECT video_id, i, x AS top FROM spaced JOIN signal USING (video_id, i)),
  walls AS (SELECT t.video_id, t.i, t.top, coalesce(max(s.i) FILTER (s.i < t.i), 0) AS wall_l, min(s.i) FILTER (s.i > t.i) AS wall_r
    FROM tops t LEFT JOIN signal s ON s.video_id = t.video_id AND s.x > t.top GROUP BY ALL),
  bases AS (SELECT w.video_id, w.i, w.top, min(s.x) FILTER (s.i <= w.i) AS low_l, min(s.x) FILTER (s.i >= w.i) AS low_r
    FROM walls w JOIN signal s ON s.video_id = w.video_id AND s.i > wall_l AND s.i < coalesce(wall_r, s.i + 1) GROUP BY ALL),
  peaks AS (SELECT video_id, i FROM bases WHERE top - greatest(low_l, low_r) >= 3)"""


@query(
    "touch_peaks",
    f"""WITH RECURSIVE {PEAKS} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS touch_id, frame,
  round(img_x, 4) AS img_x, round(img_y, 4) AS img_y, round(accel, 4) AS accel, round(accel / (h + 1e-6), 4) AS accel_z FROM peaks JOIN acc USING (video_id, i) JOIN height USING (video_id)""",
)
def touch_peaks(spark, d):
    return _rounded(B.detect_touches(B.reconstruct(ball_rows(spark, d), V, max_gap=GAP)), "img_x", "img_y", "accel", "accel_z")


# ---- many cameras, bodies, names

CAMERAS = """cam AS (SELECT v AS video_id, 0.012 + v * 0.0001::DOUBLE AS a, 0.02 + v * 0.0001::DOUBLE AS e, CASE WHEN v % 3 = 0 THEN 9.0 ELSE 18.0 END AS court_h, v % 2 = 0 AS corners FROM (SELECT unnest(range(7)) AS v)),
  rows_ AS (SELECT d.*, (a * img_x + 0.001::DOUBLE * img_y - 1.5::DOUBLE) / (0.0004::DOUBLE * img_y + 1) AS px, (0.0005::DOUBLE * img_x + e * img_y - 0.8::DOUBLE) / (0.0004::DOUBLE * img_y + 1) AS py, court_h, corners FROM det d JOIN cam USING (video_id))"""


def cameras(spark) -> DataFrame:
    """A calibration for each of seven of the eight videos; every other one has corners."""
    v, z = F.col("id"), F.lit(0.0)
    row = lambda *c: F.array(*(F.lit(x) if isinstance(x, float) else x for x in c))
    h = F.array(row(v * 0.0001 + 0.012, 0.001, -1.5), row(0.0005, v * 0.0001 + 0.02, -0.8), row(z, 0.0004, 1.0))
    corners = F.array(row(300.0, 200.0), row(900.0, 220.0), row(1100.0, 600.0), row(150.0, 620.0))
    return spark.range(7).select(
        v.alias("video_id"), h.alias("h"), F.lit(9.0).alias("court_w"), F.when(v % 3 == 0, 9.0).otherwise(18.0).alias("court_h"), F.lit(1.0).alias("ppm"),
        F.when(v % 2 == 0, corners).alias("pixel_corners"), F.lit(FRAME_H).alias("frame_h"), F.lit(FRAME_W).alias("frame_w"),
    )


@query(
    "calibrated",
    f"WITH {DET}, {CAMERAS} SELECT video_id, count(*) AS n, count(*) FILTER (px BETWEEN -0.5 AND 9.5 AND py BETWEEN -0.5 AND court_h + 0.5) AS inside, round(sum(px), 3) AS sum_x, round(sum(py), 3) AS sum_y FROM rows_ GROUP BY ALL",
)
def calibrated(spark, d):
    rows = courts.calibrated(detections(spark, d).drop("court_x", "court_y"), cameras(spark))
    inside = G.in_court("court_x", "court_y", F.col("cal.court_w"), F.col("cal.court_h"))
    t = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("inside"), F.sum("court_x").alias("sum_x"), F.sum("court_y").alias("sum_y"))
    return _rounded(t, "sum_x", "sum_y", dp=3)


@query(
    "ball_region",
    f"""WITH {DET}, {CAMERAS}, f AS (SELECT det_id, video_id, CASE WHEN corners THEN 'pixel_polygon' ELSE 'court_projection_fallback' END AS ball_filter,
      CASE WHEN corners THEN img_x BETWEEN 150 - 38.4::DOUBLE AND 1100 + 38.4::DOUBLE AND img_y BETWEEN 0 AND 620 + 21.6::DOUBLE ELSE px BETWEEN -2 AND 11 AND py BETWEEN -2 AND court_h + 2 END AS ok FROM rows_ WHERE conf >= 0.6)
    SELECT det_id, video_id, ball_filter FROM f WHERE ok""",
)
def ball_region(spark, d):
    balls = detections(spark, d).where("conf >= 0.6").drop("court_x", "court_y")
    return courts.balls_near_court(courts.calibrated(balls, courts.with_regions(cameras(spark)))).select("det_id", "video_id", "ball_filter")


@query("calibration_cascade", "WITH v AS (SELECT unnest(range(7)) AS video_id) SELECT video_id, CASE WHEN video_id % 2 = 0 THEN 0 WHEN video_id % 3 = 0 THEN 1 ELSE 2 END AS source, CASE WHEN video_id % 2 = 0 THEN 9.0 WHEN video_id % 3 = 0 THEN 8.0 ELSE 7.0 END::DOUBLE AS court_w FROM v")
def calibration_cascade(spark, d):
    cal = cameras(spark)
    some = lambda w, keep: cal.withColumns({"court_w": F.lit(w), "h": F.when(keep, F.col("h"))})
    found = courts.cascade(some(9.0, F.col("video_id") % 2 == 0), some(8.0, F.col("video_id") % 3 == 0), some(7.0, F.lit(True)))
    return found.select("video_id", "source", "court_w")


POSED = f"""{DET}, boxes AS (SELECT det_id, video_id, frame, row_number() OVER (PARTITION BY video_id, frame ORDER BY det_id) AS position FROM det),
  pose AS (SELECT vec_id, video_id, frame, (list_sum(list_transform(embedding[35:51], lambda v: v::DOUBLE + 0.5))) / 17 AS mean, row_number() OVER (PARTITION BY video_id, frame ORDER BY vec_id) AS position FROM embeddings JOIN det ON det_id = vec_id)"""


def _posed(spark, d) -> DataFrame:
    """A frame's poses, taken as those of the vectors whose ids its detections have."""
    at = detections(spark, d).select("video_id", "frame", F.col("det_id").alias("vec_id"))
    return bodies.positions(poses(spark, d).drop("track_id").join(at, "vec_id"), "vec_id")


@query("pose_boxes", f"WITH {POSED} SELECT b.video_id, b.frame, b.det_id, coalesce(mean >= 0.3, false) AS posed FROM boxes b LEFT JOIN pose p ON p.video_id = b.video_id AND p.frame = b.frame AND p.position = b.position")
def pose_boxes(spark, d):
    return bodies.pose_to_boxes(detections(spark, d), _posed(spark, d)).select("video_id", "frame", "det_id", F.col("kp").isNotNull().alias("posed"))


@query(
    "pose_of_tracks",
    f"""WITH {DET}, {POSE_SQL}, st AS (SELECT track_id, count(lean) AS n, round(avg(lean), 4) AS lean FROM m GROUP BY ALL HAVING count(lean) + count(stance) + count(coalesce(lk, rk)) > 0), t AS (SELECT track_id, count(*) AS samples FROM det GROUP BY ALL)
    SELECT t.track_id, samples, n AS samples_with_pose, lean FROM t LEFT JOIN st USING (track_id)""",
)
def pose_of_tracks(spark, d):
    tracks = detections(spark, d).groupBy("track_id").agg(F.count(F.lit(1)).alias("samples"))
    found = bodies.attach(tracks, bodies.pose_stats(poses(spark, d), ["track_id"], dp=4), "pose_stats", ["track_id"])
    return found.select("track_id", "samples", "pose_stats.samples_with_pose", F.col("pose_stats.torso_lean_deg_avg").alias("lean"))


@query("identity_of_tracks", f"WITH v AS ({ORACLES['jersey_vote']}) SELECT video_id, count(*) FILTER (name <> 'desconocida') AS players_identified, count(*) AS tracks FROM v GROUP BY ALL")
def identity_of_tracks(spark, d):
    tracks = detections(spark, d).select(*VT).distinct()
    named = bodies.attach(tracks, jersey_vote(spark, d), "identity")
    return bodies.identified(named.select(*VT, "identity.*"), V)


@query("fragments", f"WITH {DET}, l AS (SELECT *, CASE WHEN frame - lag(frame) OVER w <= 600 THEN 0 ELSE 1 END AS st FROM det WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame, det_id)), r AS (SELECT *, sum(st) OVER (PARTITION BY video_id, track_id ORDER BY frame, det_id ROWS UNBOUNDED PRECEDING) AS fragment FROM l) SELECT video_id, track_id, CAST(fragment AS BIGINT) AS fragment, count(*) AS n, min(frame) AS a, max(frame) AS b FROM r GROUP BY ALL")
def fragments(spark, d):
    f = W.frame_islands(detections(spark, d), VT, 600, "fragment")
    return f.groupBy(*VT, "fragment").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("a"), F.max("frame").alias("b"))


@query(
    "touch_totals",
    f"""WITH {DET}, t AS (SELECT video_id, det_id AS touch_id, frame, CASE WHEN conf < 0.8 THEN track_id END AS track_id FROM det), l AS (SELECT *, CASE WHEN frame - lag(frame) OVER w <= 30 THEN 0 ELSE 1 END AS st FROM t WINDOW w AS (PARTITION BY video_id ORDER BY frame, touch_id)),
    r AS (SELECT *, sum(st) OVER (PARTITION BY video_id ORDER BY frame, touch_id ROWS UNBOUNDED PRECEDING) - 1 AS rally_id FROM l),
    p AS (SELECT video_id, rally_id, track_id, count(*) AS n FROM r WHERE track_id IS NOT NULL GROUP BY ALL), q AS (SELECT video_id, rally_id, string_agg(track_id || ':' || n, ',' ORDER BY CAST(track_id AS VARCHAR)) AS players FROM p GROUP BY ALL),
    g AS (SELECT video_id, rally_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_touches FROM r GROUP BY ALL)
    SELECT g.video_id, CAST(g.rally_id AS BIGINT) AS rally_id, start_frame, end_frame, n_touches, (end_frame - start_frame) * 60.0::DOUBLE AS duration_s, coalesce(players, '') AS players FROM g LEFT JOIN q USING (video_id, rally_id)""",
)
def touch_totals(spark, d):
    t = detections(spark, d).select("video_id", F.col("det_id").alias("touch_id"), "frame", F.when(F.col("conf") < 0.8, F.col("track_id")).alias("track_id"))
    r = B.rally_totals(B.touch_rallies(t, V, FPS, gap_s=1800), V, FPS)
    pairs = F.transform(F.array_sort(F.map_entries("touches_by_player")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return r.select("video_id", "rally_id", "start_frame", "end_frame", "n_touches", "duration_s", F.concat_ws(",", pairs).alias("players"))


@query("words", f"WITH {DET} SELECT det_id, CASE WHEN det_id % 101 >= 80 THEN 'excelente' WHEN det_id % 101 >= 60 THEN 'bueno' WHEN det_id % 101 >= 40 THEN 'regular' ELSE 'bajo' END AS verdict, CASE WHEN frame % 900 < 60 THEN (frame % 900) || 's' ELSE (frame % 900 // 60) || 'm ' || lpad(CAST(frame % 60 AS VARCHAR), 2, '0') || 's' END AS seconds, CAST(round_even(court_x * 40 + 20, 0) AS INT) AS px, CAST(round_even((18 - court_y) * 40 + 20, 0) AS INT) AS py FROM det")
def words(spark, d):
    px, py = G.render_point("court_x", "court_y", 40.0, 20.0)
    return detections(spark, d).select("det_id", G.verdict(F.col("det_id") % 101).alias("verdict"), G.spoken_seconds(F.col("frame") % 900).alias("seconds"), px.alias("px"), py.alias("py"))


@query("first_frames", f"WITH {DET}, s AS (SELECT video_id, min(frame) AS a FROM det GROUP BY ALL) SELECT det_id, video_id, frame FROM det JOIN s USING (video_id) WHERE frame < a + 500")
def first_frames(spark, d):
    return T.first_frames(detections(spark, d), 500).select("det_id", "video_id", "frame")


CROP = "(x2 - x1) AS w, (y2 - y1) AS h, x1 + (x2 - x1) * 0.12::DOUBLE AS lx, x2 - (x2 - x1) * 0.12::DOUBLE AS rx, y1 + (y2 - y1) * 0.18::DOUBLE AS ty, y1 + (y2 - y1) * 0.55::DOUBLE AS by_"


@query(
    "torso_crop",
    f"""WITH {DET}, c AS (SELECT det_id, {CROP} FROM det), p AS (SELECT *, (rx - lx) * 0.18::DOUBLE AS px, (by_ - ty) * 0.18::DOUBLE AS py FROM c),
    q AS (SELECT det_id, w, h, greatest(0, least(1280, CAST(trunc(lx - px) AS INT))) AS x1, greatest(0, least(720, CAST(trunc(ty - py) AS INT))) AS y1, greatest(0, least(1280, CAST(trunc(rx + px) AS INT))) AS x2, greatest(0, least(720, CAST(trunc(by_ + py) AS INT))) AS y2 FROM p)
    SELECT det_id, x1, y1, x2, y2 FROM q WHERE w >= 4 AND h >= 4 AND x2 - x1 >= 6 AND y2 - y1 >= 6""",
)
def torso_crop(spark, d):
    """Boxes without a pose: by shares of the box."""
    none = F.lit(None).cast("array<array<double>>"), F.lit(None).cast("array<double>")
    crop = detections(spark, d).select("det_id", G.torso_crop("x1", "y1", "x2", "y2", *none, FRAME_W, FRAME_H).alias("c"))
    return crop.where("c is not null").select("det_id", "c.x1", "c.y1", "c.x2", "c.y2")
