"""Detections of many videos under their own calibrations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calibration as C
from ..functions import geometry as G

REGION = "region struct<x1:double,y1:double,x2:double,y2:double>"
ROI = "roi array<array<double>>"


def cascade(*sources: DataFrame) -> DataFrame:
    """One calibration per video: the first source that has one.

    ``sources(video_id, h, ...)`` have the same columns; rows without a matrix do not
    count.
    """
    ranked = [s.where("h is not null").withColumn("source", F.lit(i)) for i, s in enumerate(sources)]
    every = reduce(DataFrame.unionByName, ranked)
    rest = [c for c in every.columns if c not in ("video_id", "source")]
    best = every.groupBy("video_id").agg(F.min_by(F.struct(*rest, "source"), "source").alias("best"))
    return best.select("video_id", "best.*")


def with_regions(cal: DataFrame, margin: float = 2.0) -> DataFrame:
    """``cal(video_id, h, court_w, court_h, ppm, pixel_corners, frame_w, frame_h, ...)``,
    one row per camera, with the polygon in which players stand (``roi``) and the
    rectangle in which balls fly (``region``); each null where it cannot be told."""

    def add(batches):
        for pdf in batches:
            roi, region = [], []
            for r in pdf.itertuples():
                h = np.array([list(row) for row in r.h], float)
                polygon = C.roi_polygon(h, r.court_w, r.court_h, r.ppm, margin)
                roi.append([[float(x), float(y)] for x, y in polygon] if polygon else None)
                corners = None if r.pixel_corners is None else [list(p) for p in r.pixel_corners]
                box = C.ball_region(corners, r.frame_h, r.frame_w)
                region.append(dict(zip(("x1", "y1", "x2", "y2"), map(float, box), strict=True)) if box else None)
            yield pdf.assign(roi=pd.Series(roi, pdf.index, object), region=pd.Series(region, pdf.index, object))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cal.schema.fields)
    return cal.mapInPandas(add, f"{kinds}, {ROI}, {REGION}")


def calibrated(det: DataFrame, cal: DataFrame, x: str = "img_x", y: str = "img_y") -> DataFrame:
    """``det(video_id, ...)`` with the court position of ``x, y`` under its video's
    calibration, and that calibration as ``cal``.  Videos without one go."""
    rest = [c for c in cal.columns if c != "video_id"]
    rows = det.join(cal.select("video_id", F.struct(*rest).alias("cal")), "video_id")
    cx, cy = G.project(F.col("cal.h"), x, y, F.col("cal.ppm"))
    return rows.withColumns({"court_x": cx, "court_y": cy})


def balls_near_court(ball: DataFrame, margin: float = 2.0) -> DataFrame:
    """Balls that can belong to the game, of ``calibrated`` rows with regions, and by
    which rule (``ball_filter``): inside the region of their picture, or, where the
    calibration has no corners, projected to the court and its margin."""
    region = F.col("cal.region")
    inside = F.col("img_x").between(region["x1"], region["x2"]) & F.col("img_y").between(region["y1"], region["y2"])
    court = G.in_court("court_x", "court_y", F.col("cal.court_w"), F.col("cal.court_h"), margin)
    mode = F.when(region.isNotNull(), "pixel_polygon").otherwise("court_projection_fallback")
    return ball.withColumn("ball_filter", mode).where(F.when(region.isNotNull(), inside).otherwise(court))
