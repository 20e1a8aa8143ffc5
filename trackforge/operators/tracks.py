"""Detections and player tracks: filters, stitching, summaries, zones, scores."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from . import windows as W


def detection_status(x1, y1, x2, y2, frame_w: int, frame_h: int, ball: Column | None = None) -> Column:
    """Why a person's box is rejected (too large, or cut by the lower edge), or ``ok``.
    Balls are always ok."""
    w, h = (F.col(x2) - F.col(x1)) / frame_w, (F.col(y2) - F.col(y1)) / frame_h
    status = F.when((h > 0.55) | (w > 0.40), "fg_too_large").when((F.col(y2) >= frame_h - 5) & (h > 0.35), "fg_at_edge").otherwise("ok")
    return status if ball is None else F.when(ball, "ok").otherwise(status)


def sample_frames(df: DataFrame, stride: int) -> DataFrame:
    return df.where(F.pmod("frame", F.lit(stride)) == 0)


def even_frames(total: int, n: int) -> list[int]:
    """``n`` frames spread over a video, first and last included."""
    return [int(i * (total - 1) / (n - 1)) for i in range(n)] if n > 1 else [0]


def eligible(samples: DataFrame, inside: Column, part: list[str], least: int = 15, share: float = 0.5) -> DataFrame:
    """In-court samples of tracks with enough of them."""
    w = Window.partitionBy(*part)
    df = samples.withColumn("_in", inside).withColumns({"_n": F.count(F.lit(1)).over(w), "_k": F.count_if(F.col("_in")).over(w)})
    return df.where((F.col("_n") >= least) & (F.col("_k") / F.col("_n") >= share) & (F.col("_k") >= least // 2) & F.col("_in")).drop("_in", "_n", "_k")


def zone_visits(df: DataFrame, zone: Column, part: list[str], half_frame: int) -> DataFrame:
    """Visits of each zone: all, and by half of the video."""
    first = F.col("frame") < half_frame
    return df.withColumn("zone", zone).where("zone is not null").groupBy(*part, "zone").agg(
        F.count(F.lit(1)).alias("visits"), F.count_if(first).alias("first_half"), F.count_if(~first).alias("second_half")
    )


def zone_profile(df: DataFrame, zone: Column, part: list[str]) -> DataFrame:
    """Share of each zone in a track and its rank; equal counts rank by first visit."""
    seen = df.withColumn("zone", zone).where("zone is not null").groupBy(*part, "zone").agg(F.count(F.lit(1)).alias("visits"), F.min(F.struct("frame", "det_id")).alias("_first"))
    share = F.bround(F.col("visits") / F.sum("visits").over(Window.partitionBy(*part)) * 100, 0).cast("int")
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("visits"), "_first"))
    return seen.withColumns({"pct": share, "place": rank}).drop("_first")


def dominant_zone(df: DataFrame, zone: Column, part: list[str]) -> DataFrame:
    return zone_profile(df, zone, part).where("place = 1").select(*part, F.col("zone").alias("dominant_zone"))


def track_stats(samples: DataFrame, part: list[str], fps: float, court_h: float = 18.0, half: bool = False) -> DataFrame:
    """One row per track: samples, seconds, metres, side and sums of positions."""
    steps = W.step_length(samples, part, ["frame", "det_id"])
    t = steps.groupBy(*part).agg(
        F.count(F.lit(1)).alias("samples"),
        ((F.max("frame") - F.min("frame")) / fps).alias("span"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("distance"),
        F.median("court_y").alias("_mid"),
        F.sum("court_x").alias("sum_x"),
        F.sum("court_y").alias("sum_y"),
    )
    side = F.lit("A") if half else F.when(F.col("_mid") <= court_h / 2, "A").otherwise("B")
    speed = F.when(F.col("span") > 0, F.try_divide("distance", "span"))
    return t.withColumns({"reliability": G.reliability("samples"), "speed": speed, "side": side}).drop("_mid")


def summarise(samples: DataFrame, part: list[str], fps: float, court_h: float = 18.0, half: bool = False) -> DataFrame:
    """``track_stats`` with the names and digits of the scouting document."""
    return track_stats(samples, part, fps, court_h, half).select(
        *part,
        "samples",
        F.bround("span", 1).alias("seconds_tracked"),
        "reliability",
        F.bround("distance", 1).alias("distance_m"),
        F.bround("speed", 2).alias("avg_speed_m_per_s"),
        "side",
        F.bround(F.col("sum_x") / F.col("samples"), 2).alias("avg_x_m"),
        F.bround(F.col("sum_y") / F.col("samples"), 2).alias("avg_y_m"),
    )


# ---- choices and distributions


def frame_scores(det: DataFrame, least: float) -> DataFrame:
    """How many sure detections each frame has, and how sure they are."""
    return det.where(F.col("conf") >= least).groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean"))


def _top(df: DataFrame, score: str) -> DataFrame:
    """The row of each video with the highest score; the first frame of equal ones."""
    best = df.groupBy("video_id").agg(F.max(F.struct(score, (-F.col("frame")).alias("_f"))).alias("b"))
    return best.select("video_id", (-F.col("b._f")).alias("frame"), F.col(f"b.{score}").alias(score))


def best_frame(det: DataFrame, least: float = 0.5) -> DataFrame:
    """The frame to calibrate on: most points, then surest."""
    return _top(frame_scores(det, least).withColumn("score", F.round(F.col("n") + F.col("mean"), 6)), "score")


def fullest_frame(det: DataFrame, least: float = 0.3) -> DataFrame:
    """The frame with most sure detections."""
    return _top(frame_scores(det, least), "n")


def best_mask(masks: DataFrame, score: Column) -> DataFrame:
    """The mask of each video with the highest score; earlier ones of equal."""
    best = masks.withColumn("score", score).groupBy("video_id").agg(F.min(F.struct((-F.col("score")).alias("_s"), "frame", "det_id", "score")).alias("b"))
    return best.select("video_id", "b.frame", "b.score")


def density_grid(det: DataFrame, cell: int, weight: Column, percentile: float = 0.75) -> DataFrame:
    """Weights in square cells of the picture, with their percentile in the video."""
    g = det.groupBy("video_id", F.floor(F.col("img_x") / cell).alias("gx"), F.floor(F.col("img_y") / cell).alias("gy")).agg(F.sum(weight).alias("weight"))
    p = g.groupBy("video_id").agg(F.percentile("weight", percentile).alias("threshold"))
    return g.join(p, "video_id").select("video_id", "gx", "gy", "weight", "threshold")


def by_half(samples: DataFrame, part: list[str], half_frame: int, least: int = 5) -> DataFrame:
    """Samples of each track in each half of the video, where there are enough."""
    h = F.when(F.col("frame") < half_frame, 1).otherwise(2).alias("half")
    return samples.groupBy(*part, h).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def zone_order(visits: DataFrame) -> DataFrame:
    """``visits(zone, visits)`` with their share of the fullest zone and their place on
    the display, front row first."""
    place = F.array_position(F.array(*map(F.lit, (4, 3, 2, 5, 6, 1))), F.right("zone", F.lit(1)).cast("int")).cast("int")
    top = visits.agg(F.max("visits").alias("_top"), F.lit(1).alias("_one"))
    both = visits.withColumn("_one", F.lit(1)).join(top, "_one")
    return both.select("zone", "visits", (F.col("visits") / F.col("_top")).alias("share"), place.alias("place"))


def first_frames(det: DataFrame, most: int) -> DataFrame:
    """Detections of the first ``most`` frames of each video."""
    start = det.groupBy("video_id").agg(F.min("frame").alias("_start"))
    return det.join(start, "video_id").where(F.col("frame") < F.col("_start") + most).drop("_start")


# ---- stitching


def stitch_mapping(samples: DataFrame, fps: float, max_gap_s: float = 1.5, max_jump_m: float = 2.5) -> DataFrame:
    """``video_id, track_id, root``: which track each belongs to after joining ends
    to later starts close by.

    Joining is greedy and depends on order, so each video's end points (one row
    per track, not its samples) are settled together; tracks come in the order of
    their first sample.
    """
    point = lambda f: f(F.struct("frame", "det_id", "court_x", "court_y"))
    ends = samples.groupBy("video_id", "track_id").agg(point(F.min).alias("s"), point(F.max).alias("e"))
    flat = ends.select(
        "video_id", "track_id", F.col("s.frame").alias("s_frame"), F.col("s.det_id").alias("s_id"), F.col("s.court_x").alias("s_x"), F.col("s.court_y").alias("s_y"),
        F.col("e.frame").alias("e_frame"), F.col("e.court_x").alias("e_x"), F.col("e.court_y").alias("e_y"),
    )

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s_frame", "s_id"], kind="stable")
        rows = list(pdf.itertuples())
        starts = [r.s_frame for r in rows]  # ascending, as the tracks come
        tail = [(r.e_frame, r.e_x, r.e_y) for r in rows]
        alive, root = [True] * len(rows), {r.track_id: r.track_id for r in rows}
        joined = len(rows) > 1
        while joined:
            joined = False
            for a, row in enumerate(rows):
                if not alive[a]:
                    continue
                end, x, y = tail[a]
                # later starts in their order: the first that is near has the smallest gap
                for b in range(bisect_right(starts, end), bisect_right(starts, end + max_gap_s * fps)):
                    if alive[b] and b != a and (rows[b].s_x - x) ** 2 + (rows[b].s_y - y) ** 2 <= max_jump_m**2:
                        tail[a], alive[b], joined = tail[b], False, True
                        root[rows[b].track_id] = row.track_id
                        break
        for t in root:
            r = t
            while root[r] != r:
                r = root[r]
            root[t] = r
        return pd.DataFrame({"video_id": pdf["video_id"], "track_id": pdf["track_id"], "root": pdf["track_id"].map(root)})

    return flat.groupBy("video_id").applyInPandas(settle, "video_id long, track_id long, root long")


def stitch(samples: DataFrame, fps: float, max_gap_s: float = 1.5, max_jump_m: float = 2.5) -> DataFrame:
    """The samples under the ids of the stitched tracks."""
    roots = stitch_mapping(samples, fps, max_gap_s, max_jump_m)
    return samples.join(roots, ["video_id", "track_id"]).withColumn("track_id", F.col("root")).drop("root")


# ---- identity


def roster_reads(reads: DataFrame, roster: DataFrame, least: float = 0.3, cap: int = 30) -> DataFrame:
    """Usable readings of shirt numbers: of the first ``cap`` of each track those
    that are one or two digits, sure enough and on the roster.  Spaces around the
    digits (any of Unicode's, no line ends) do not count; rows without ``seq`` come last."""
    w = Window.partitionBy("video_id", "track_id").orderBy(F.asc_nulls_last("seq"))
    digits = F.regexp_extract("text", r"^\p{Zs}*([0-9]{1,2})\p{Zs}*\z", 1)
    first = reads.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap)
    good = first.where(F.col("conf") >= least).withColumn("number", digits.try_cast("int"))
    return good.join(roster.select("number").distinct(), "number", "left_semi").drop("_k")


def vote(reads: DataFrame, tracks: DataFrame, roster: DataFrame, least: float = 1.5, share: float = 0.5, dp: int | None = 2) -> DataFrame:
    """The name of each track: the number with the most weight, if that is enough
    and at least ``share`` of all; equal weights (to six decimals) go to the first seen.

    Weights are added in the order of ``seq``, and all of them from the largest on, so
    that no other order of additions tips a weight over a limit.  Without ``dp``
    confidence and weight are not rounded.
    """
    part = ["video_id", "track_id"]
    adding = Window.partitionBy(*part, "number").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    sums = reads.withColumn("_sum", F.sum("conf").over(adding)).groupBy(*part, "number").agg(F.max("_sum").alias("weight"), F.min("seq").alias("_first"))
    w = Window.partitionBy(*part).orderBy(F.desc(F.round("weight", 6)), "_first")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.withColumns({"_all": F.sum("weight").over(whole), "_k": F.row_number().over(w)}).where("_k = 1")
    votes = reads.groupBy(*part).agg(F.count(F.lit(1)).alias("votes"))
    best = sums.join(votes, part).join(roster.select("number", "name"), "number", "left")
    named = (F.col("weight") >= least) & (F.col("weight") / F.col("_all") >= share)
    out = tracks.select(*part).distinct().join(best, part, "left")
    rounded = lambda c: c if dp is None else F.bround(c, dp)
    return out.select(
        *part,
        F.when(named, F.col("number")).alias("number"),
        F.when(named, F.col("name")).otherwise("desconocida").alias("name"),
        F.coalesce(rounded(F.col("weight") / F.col("_all")), F.lit(0.0)).alias("confidence"),
        F.coalesce("votes", F.lit(0)).cast("long").alias("votes"),
        F.coalesce(rounded(F.col("weight")), F.lit(0.0)).alias("weight"),
    )


# ---- quality of a run


def quality(tracks: DataFrame, zones: DataFrame, ball_frames: int | Column, rejected: int | Column, samples: int | Column, half: bool = False, evaluated: int | Column | None = None) -> DataFrame:
    """Score of a run with its five parts: ``tracks(n)`` has the in-court samples of
    each track, ``zones(visits)`` the visits of each zone."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    most = 6 if half else 12
    one = F.lit(1).alias("_one")
    top = tracks.orderBy(F.desc("n")).limit(most).agg(F.avg("n").alias("top"))
    t = tracks.agg(F.count(F.lit(1)).alias("n_tracks"), F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))
    t = t.select("*", one).join(top.select("*", one), "_one").drop("_one")
    z = zones.agg(F.count_if(F.col("visits") > 3).alias("n_zones"))
    n = F.col("n_tracks")
    rate = lit(ball_frames) / F.greatest(lit(evaluated if evaluated is not None else samples), F.lit(1))
    total = F.col("kept") + lit(rejected)
    persist = F.least(F.lit(1.0), F.col("top") / lit(samples) / 0.5)
    consol = F.greatest(F.lit(0.0), 1 - F.abs(n - most) / most)
    steady = F.bround(10 * (0.5 * persist + 0.5 * consol), 0).cast("int")
    row = t.select("*", one).join(z.select("*", one), "_one").select(
        F.bround(30 * F.least(n, F.lit(most)) / F.greatest(n, F.lit(most)), 0).cast("int").alias("tracks_pts"),
        F.least(F.lit(25), (F.col("n_zones") / most * 25).cast("int")).alias("zones_pts"),
        F.when(rate >= 0.5, 20).when(rate >= 0.1, (4 + (rate - 0.1) / 0.4 * 16).cast("int")).otherwise((rate / 0.1 * 4).cast("int")).alias("ball_pts"),
        F.when(total > 0, (F.try_divide(F.col("kept"), total) * 15).cast("int")).otherwise(0).alias("filter_pts"),
        F.when((n > 0) & (lit(samples) > 0), steady).otherwise(0).alias("stability_pts"),
        "n_tracks", "n_zones", rate.alias("ball_rate"), lit(rejected).alias("rejects"),
        F.coalesce(F.when(n > 0, persist), F.lit(0.0)).alias("persist"), F.when(n > 0, consol).otherwise(0.0).alias("consol"),
    )
    score = F.col("tracks_pts") + F.col("zones_pts") + F.col("ball_pts") + F.col("filter_pts") + F.col("stability_pts")
    return row.withColumn("score", score).withColumn("tier", G.verdict("score"))


def quality_strings(row: DataFrame, half: bool = False) -> DataFrame:
    """The breakdown as the texts of the report."""
    most = 6 if half else 12
    f = F.format_string
    parts = {
        "tracks": f(f"%d/30 (%d de {most})", "tracks_pts", "n_tracks"),
        "zonas": f(f"%d/25 (%d de {most})", "zones_pts", "n_zones"),
        "balon": f("%d/20 (%.1f%%)", "ball_pts", F.col("ball_rate") * 100),
        "filtrado": f("%d/15 (rechazos: %d)", "filter_pts", "rejects"),
        "estabilidad": f("%d/10 (persist %.2f, consol %.2f)", "stability_pts", "persist", "consol"),
    }
    return row.withColumn("quality_breakdown", F.struct(*(c.alias(k) for k, c in parts.items())))


