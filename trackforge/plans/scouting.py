"""The two runs end to end: scouting document from detections, touches from a document."""

from __future__ import annotations

import html
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.calibration import ball_region, roi_polygon
from ..operators import balls as B
from ..operators import tracks as T
from ..operators import windows as W
from ..sources.tables import read_scouting

VERSION = "trackforge-1"


@dataclass(frozen=True)
class Video:
    fps: float
    total_frames: int
    width: int
    height: int


@dataclass(frozen=True)
class Court:
    h: list[list[float]]
    w_m: float = 9.0
    h_m: float = 18.0
    ppm: float = 1.0
    corners: list[tuple[float, float]] | None = None

    @property
    def half(self) -> bool:
        return self.h_m <= self.w_m


def scouting(det: DataFrame, video: Video, court: Court, stride: int = 5, person_conf: float = 0.4, ball_conf: float = 0.10, roi_margin: float | None = 2.0) -> dict[str, DataFrame]:
    """All result tables from ``det(video_id, det_id, frame, track_id, cls, x1, y1,
    x2, y2, conf)``; class 0 is a person, 32 a ball."""
    seen = T.sample_frames(det, stride)
    ball = F.col("cls") == 32
    px, py = G.ground_point("x1", "y1", "x2", "y2")
    bx, by = G.ground_point("x1", "y1", "x2", "y2", ball=True)
    rows = seen.withColumns({"img_x": F.when(ball, bx).otherwise(px), "img_y": F.when(ball, by).otherwise(py)})
    cx, cy = G.project(court.h, "img_x", "img_y", court.ppm)
    rows = rows.withColumns({"court_x": cx, "court_y": cy})

    roi = None if roi_margin is None else roi_polygon(np.array(court.h), court.w_m, court.h_m, court.ppm, roi_margin)
    box = T.detection_status("x1", "y1", "x2", "y2", video.width, video.height)
    status = F.when(box != "ok", box).when(~G.in_polygon("img_x", "img_y", roi), "fg_outside_roi").otherwise("ok")
    people = rows.where(~ball & (F.col("conf") >= person_conf) & F.col("track_id").isNotNull()).withColumn("status", status)
    raw = T.stitch(people.where("status = 'ok'"), video.fps, 5.0, 6.0)
    inside = G.in_court("court_x", "court_y", court.w_m, court.h_m)
    tracks = T.eligible(raw, inside, ["video_id", "track_id"])
    zone = G.zone_label("court_x", "court_y", court.w_m, court.h_m, court.half, 0.5)

    shots = rows.where(ball & (F.col("conf") >= ball_conf))
    region = ball_region(court.corners, video.height, video.width)
    if region:
        x1, y1, x2, y2 = region
        near = shots.where(F.col("img_x").between(x1, x2) & F.col("img_y").between(y1, y2))
    else:
        near = shots.where(G.in_court("court_x", "court_y", court.w_m, court.h_m, 2.0))
    steady = B.steady_ball(near, ["video_id"], video.width, stride)
    part = ["video_id"]
    flown = B.flights(steady, video.fps, video.width)
    fx, fy = G.project(court.h, "img_x", "img_y", court.ppm)
    flown = flown.withColumns({"court_x": F.bround(fx, 2), "court_y": F.bround(fy, 2)})
    found = B.rallies(steady, part, video.fps, court_h=court.h_m, half=court.half)
    keys = ["video_id", "track_id"]
    summary = T.summarise(tracks, keys, video.fps, court.h_m, court.half)
    profile = T.zone_profile(tracks, zone, keys)
    pct = profile.groupBy(*keys).agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("place", "zone", "pct"))), lambda e: F.struct(e["zone"], e["pct"]))).alias("zone_profile_pct"))
    summary = summary.join(T.dominant_zone(tracks, zone, keys), keys, "left").join(pct, keys, "left")
    return {
        "raw": people.where("status = 'ok'"),
        "samples": tracks,
        "tracks": summary,
        "zones": T.zone_visits(tracks, zone, part, video.total_frames // 2),
        "rejected": people.groupBy("video_id", "status").agg(F.count(F.lit(1)).alias("n")).where("status <> 'ok'"),
        "ball": steady,
        "ball_dense": flown,
        "ball_reconstruction": B.flight_summary(flown, part),
        "rallies": found,
        "play_summary": B.play_summary(found, part),
    }


def document(t: dict[str, DataFrame], video: Video, court: Court, name: str, stride: int = 5) -> DataFrame:
    """The tables of one video as one nested row, ready for ``to_json``."""
    samples = max(1, video.total_frames // stride)
    n_ball = t["ball"].select("frame").distinct().count()
    rejected = {r["status"]: r["n"] for r in t["rejected"].groupBy("status").agg(F.sum("n").alias("n")).collect()}
    lens = t["samples"].groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    zones = t["zones"].groupBy("zone").agg(*(F.sum(c).alias(c) for c in ("visits", "first_half", "second_half")))
    score = T.quality_strings(T.quality(lens, zones, n_ball, sum(rejected.values()), samples, court.half), court.half)
    rows = lambda df, *order: F.sort_array(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order and c != "video_id"])))
    key = F.lit(1).alias("_k")
    out = score.select(
        F.lit(VERSION).alias("version"), F.lit(name).alias("video"), F.lit(round(video.total_frames / video.fps, 1)).alias("duration_s"), F.lit(stride).alias("stride"),
        F.lit(samples).alias("samples_processed"), F.array(F.lit(court.w_m), F.lit(court.h_m)).alias("court_size_m"), F.lit(court.half).alias("half_court"),
        F.create_map(*[F.lit(v) for kv in rejected.items() for v in kv]).alias("rejected_detections") if rejected else F.create_map().cast("map<string,bigint>").alias("rejected_detections"),
        F.lit(n_ball).alias("ball_frames_oncourt"), F.lit(round(n_ball / samples, 3)).alias("ball_detection_rate"), F.col("score").alias("quality_score"), "quality_breakdown", key,
    )
    maps = zones.agg(*(F.map_from_entries(F.sort_array(F.collect_list(F.struct("zone", c)))).alias(a) for c, a in (("visits", "zone_visits_total"), ("first_half", "zone_visits_first_half"), ("second_half", "zone_visits_second_half"))))
    ball = t["ball"].select("video_id", "frame", *(F.bround(c, dp).alias(c) for c, dp in (("img_x", 1), ("img_y", 1), ("court_x", 2), ("court_y", 2), ("conf", 3))))
    parts = [
        maps,
        t["play_summary"].groupBy().agg(F.first(F.struct(*[c for c in t["play_summary"].columns if c != "video_id"])).alias("play_summary")),
        t["rallies"].agg(rows(t["rallies"], "start_frame").alias("rallies")),
        ball.agg(rows(ball, "frame").alias("ball_track")),
        t["ball_dense"].agg(rows(t["ball_dense"], "frame", "flight").alias("ball_track_reconstructed")),
        t["tracks"].agg(F.array_sort(F.collect_list(F.struct(F.col("track_id").alias("id"), *[c for c in t["tracks"].columns if c not in ("video_id", "track_id")])), _longest_first).alias("tracks")),
        t["samples"].groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("frame", F.bround("court_x", 2).alias("court_x"), F.bround("court_y", 2).alias("court_y")))).alias("samples")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("track_id").alias("id"), "samples"))).alias("track_samples")
        ),
    ]
    for p in parts:  # single rows
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def _longest_first(a, b):
    """Comparator: a map in a struct keeps it from being ordered as a whole."""
    n = F.signum((b["samples"] - a["samples"]).cast("double")).cast("int")
    return F.when(n != 0, n).otherwise(F.signum((a["id"] - b["id"]).cast("double")).cast("int"))


def write_document(doc: DataFrame, path: str) -> None:
    doc.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_raw_tracks(raw: DataFrame, path: str) -> None:
    """The samples of every track before stitching, one JSON line per track."""
    point = F.struct("frame", F.round("court_x", 4).alias("court_x"), F.round("court_y", 4).alias("court_y"), "conf")
    tracks = raw.groupBy("video_id", F.col("track_id").alias("id")).agg(F.sort_array(F.collect_list(point)).alias("samples"))
    tracks.write.mode("overwrite").json(path)


def enrich(spark, path: str, default_fps: float = 60.0) -> dict[str, DataFrame]:
    """Touches and touch rallies of scouting files.

    ``touch_rallies`` stays apart from the ball-based rallies of the documents.  Each
    video's frame rate follows from its last ball frame and duration.
    """
    docs, ball, samples = read_scouting(spark, path)
    dense = B.reconstruct(ball, ["video_id"])
    touches = B.detect_touches(dense)
    named = B.attribute(touches, ball, samples)
    last = ball.groupBy("video_id").agg(F.max("frame").alias("last"))
    rate = F.when(F.col("duration_s") > 0, (F.col("last") + 1) / F.col("duration_s"))
    rates = docs.join(last, "video_id").select("video_id", F.coalesce(rate, F.lit(default_fps)).alias("fps"))
    grouped = B.touch_rallies(named.join(rates, "video_id"), ["video_id"], F.col("fps"))
    totals = B.rally_totals(grouped, ["video_id", "fps"], F.col("fps")).drop("fps")
    return {"touches": grouped.drop("fps"), "touch_rallies": totals, "documents": docs}


def enriched_documents(found: dict[str, DataFrame]) -> DataFrame:
    """``video, doc``: the documents that ``enrich`` read, as JSON, with its results."""
    key = ["video_id"]

    def nested(name: str, *order: str) -> DataFrame:
        df = found[name]
        rest = [c for c in df.columns if c not in (*key, *order)]
        items = F.collect_list(F.struct(*order, F.struct(*order, *rest).alias("item")))
        ordered = F.transform(F.array_sort(items, lambda a, b: _ascending(a, b, order)), lambda e: e["item"])
        return df.groupBy(*key).agg(F.to_json(ordered, {"ignoreNullFields": "false"}).alias(name))

    docs = found["documents"].join(nested("touches", "frame", "touch_id"), key, "left").join(nested("touch_rallies", "rally_id"), key, "left")

    def merge(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                parts = {n: json.loads(v) if v else [] for n, v in (("touches", r.touches), ("touch_rallies", r.touch_rallies))}
                out.append(json.dumps(json.loads(r.doc) | {"touch_version": VERSION} | parts, ensure_ascii=False))
            yield pdf[["video"]].assign(doc=out)

    return docs.select("video", "doc", "touches", "touch_rallies").mapInPandas(merge, "video string, doc string")


def _ascending(a, b, names):
    out = F.lit(0)
    for n in reversed(names):
        sign = F.signum((a[n] - b[n]).cast("double")).cast("int")
        out = F.when(sign != 0, sign).otherwise(out)
    return out


def write_enriched(docs: DataFrame, folder: str) -> None:
    """One JSON line per document, in a folder of text files."""
    docs.select(F.col("doc").alias("value")).write.mode("overwrite").text(folder)


#: fixed value: zones as they lie on a side of the court, from the net back
SHOWN = (4, 3, 2, 5, 6, 1)
ADVICE = {
    "excelente": "The numbers can be used as they are.",
    "bueno": "The numbers can be used; single tracks may be short.",
    "regular": "Use zones and rallies; take players' numbers as rough.",
    "bajo": "Check the calibration and the picture before using any number.",
}


def _zone_bars(visits: dict, side: str, top: int) -> str:
    shown = [f"{side}{n}" for n in SHOWN if f"{side}{n}" in visits]
    return "".join(f"<div>{z} <meter max='{top}' value='{visits[z]}'></meter> {visits[z]}</div>" for z in shown)


def _spoken(seconds: float | None) -> str:
    """As ``geometry.spoken_seconds``, for a single number."""
    t = round(seconds or 0)
    return f"{t}s" if t < 60 else f"{t // 60}m {t % 60:02d}s"


def _track_row(t: dict) -> str:
    name = html.escape(str((t.get("identity") or {}).get("name") or ""))
    zones = ", ".join(f"{z} {p}%" for z, p in list((t.get("zone_profile_pct") or {}).items())[:3])
    cells = (t["id"], name, t["samples"], t["reliability"], _spoken(t.get("seconds_tracked")), t.get("dominant_zone") or "-", zones, t.get("distance_m", 0), t.get("avg_speed_m_per_s") or "-")
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def _notes(doc: dict) -> list[str]:
    rate, expected = doc.get("ball_detection_rate") or 0, 6 if doc.get("half_court") else 12
    notes = []
    if len(doc.get("tracks") or []) > 1.5 * expected:
        notes.append("More tracks than players: identities are split.")
    if rate == 0:
        notes.append("No ball was found.")
    elif rate < 0.15:
        notes.append("The ball was rarely found.")
    if rate < 0.30 and doc.get("play_summary"):
        notes.append("Rallies may be incomplete.")
    return notes


def report(doc: dict) -> str:
    """HTML page for people from a scouting document (as parsed JSON): score and advice,
    zones by side and half, the ten longest tracks, play."""
    score = doc.get("quality_score", 0)
    tier = "excelente" if score >= 80 else "bueno" if score >= 60 else "regular" if score >= 40 else "bajo"
    parts = [("Zones", "zone_visits_total"), ("First half", "zone_visits_first_half"), ("Second half", "zone_visits_second_half")]
    top = max([*(doc.get("zone_visits_total") or {}).values(), 1])
    zones = "".join(
        f"<h2>{title}</h2>" + "".join(f"<h3>Side {side}</h3>{bars}" for side in ("A", "B") if (bars := _zone_bars(doc.get(field) or {}, side, top))) for title, field in parts if doc.get(field)
    )
    tracks = sorted(doc.get("tracks") or [], key=lambda t: -t["samples"])[:10]
    heads = "".join(f"<th>{h}</th>" for h in ("track", "name", "samples", "reliability", "seen", "zone", "zones", "m", "m/s"))
    play = doc.get("play_summary") or {}
    serves = f", serves {play.get('serves_a', 0)} from A and {play.get('serves_b', 0)} from B" if play.get("n_serves") else ""
    length = doc.get("duration_s") or 0
    return (
        f"<!doctype html><meta charset='utf-8'><title>{html.escape(str(doc.get('video', '')))}</title><h1>{score} <small>{tier}</small></h1><p>{ADVICE[tier]}</p>"
        + "".join(f"<p class='note'>{n}</p>" for n in _notes(doc))
        + f"<p>{length / 60:.1f} minutes, {doc.get('samples_processed', 0)} frames, {len(doc.get('tracks') or [])} tracks</p>"
        + f"{zones}<h2>Tracks</h2><table><tr>{heads}</tr>{''.join(map(_track_row, tracks))}</table>"
        + f"<h2>Play</h2><p>{play.get('n_rallies', 0)} rallies, {_spoken(play.get('avg_rally_s'))} on average, {_spoken(play.get('longest_rally_s'))} at most, {play.get('total_play_s', 0)} s of play{serves}</p>"
    )
