"""Scouting rows frame by frame: players in the court and the surest ball."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G

ROW = ["video_id", "frame", "kind", "track_id", "x_m", "y_m", "side", "zone", "conf", "low"]


def frame_rows(det: DataFrame, h: G.Matrix, ball: Column, frame_h: int, margin: float = 1.0, flip: bool = False, ppm: float = 1.0) -> DataFrame:
    """Long table of ``det(video_id, det_id, frame, track_id, x1, y1, x2, y2, conf)``.

    Players need a track and a foot point within ``margin`` metres of the court;
    zones follow the attack lines.  A frame has one ball at most, its surest
    (smallest det_id of equal ones), which is ``low`` where its box ends in the
    lower half of the picture.  Balls have no track, side or zone.
    """
    def placed(rows: DataFrame, is_ball: bool) -> DataFrame:
        x, y = G.project(h, *G.ground_point("x1", "y1", "x2", "y2", is_ball), ppm)
        return rows.withColumns({"_x": x, "_y": y})

    players = placed(det.where(~ball & F.col("track_id").isNotNull()), False).where(G.in_court("_x", "_y", margin=margin))
    players = players.withColumn("side", G.side_of("_y")).withColumns({"zone": G.zone_number("_x", "_y", "side", flip), "kind": F.lit("player"), "low": F.lit(None).cast("boolean")})
    first = Window.partitionBy("video_id", "frame").orderBy(F.desc("conf"), "det_id")
    balls = det.where(ball).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "track_id")
    balls = placed(balls, True).withColumns(
        {"track_id": F.lit(None).cast("long"), "side": F.lit(None).cast("string"), "zone": F.lit(None).cast("int"), "kind": F.lit("ball"), "low": F.col("y2") > frame_h * 0.5}
    )
    named = {"x_m": F.round("_x", 3), "y_m": F.round("_y", 3), "conf": F.round("conf", 3)}
    return players.withColumns(named).select(ROW).unionByName(balls.withColumns(named).select(ROW))


def zone_occupancy(rows: DataFrame) -> DataFrame:
    """Frames of each player in each zone."""
    return rows.where("kind = 'player'").groupBy("video_id", "track_id", "zone").agg(F.count(F.lit(1)).alias("frames"))


def ball_places(rows: DataFrame) -> DataFrame:
    """Where the ball was, in frame order."""
    return rows.where("kind = 'ball'").select("video_id", "frame", "x_m", "y_m", "low").orderBy("video_id", "frame")


def union_long(players: DataFrame, balls: DataFrame, fps: float) -> DataFrame:
    """Players and balls as one long table with seconds; the ball's track is -1."""

    def rows(df: DataFrame, kind: str, track: Column) -> DataFrame:
        return df.select(
            "frame", F.round(F.col("frame") / fps, 3).alias("t"), F.lit(kind).alias("kind"), track.alias("track_id"),
            F.round("court_x", 3).alias("x_m"), F.round("court_y", 3).alias("y_m"), F.round("conf", 3).alias("conf"),
        )

    return rows(players, "player", F.col("track_id")).unionByName(rows(balls, "ball", F.lit(-1).cast("long")))


def landing_points(balls: DataFrame, margin: float = 0.1) -> DataFrame:
    """Balls whose floor point lies in the court."""
    b = balls.where(G.in_court("court_x", "court_y", margin=margin))
    return b.select("frame", "det_id", F.round("court_x", 3).alias("x_m"), F.round("court_y", 3).alias("y_m"))
