"""Court geometry and body geometry as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[float]]
COURT_W, COURT_H = 9.0, 18.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def project(h: Matrix | Column, x, y, ppm: float | Column = 1.0) -> tuple[Column, Column]:
    """Homography of an image point, in units of ``ppm`` pixels; null where the
    point lies on the vanishing line."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    at = (lambda i, j: h[i][j]) if isinstance(h, Column) else (lambda i, j: F.lit(float(h[i][j])))
    w = (at(2, 0) * x + at(2, 1) * y + at(2, 2)) * _c(ppm)
    return (F.try_divide(at(0, 0) * x + at(0, 1) * y + at(0, 2), w), F.try_divide(at(1, 0) * x + at(1, 1) * y + at(1, 2), w))


def in_court(x, y, w=COURT_W, h=COURT_H, margin: float = 0.5) -> Column:
    """Inside the court or its margin, edges included; null counts as outside."""
    x, y = _c(x), _c(y)
    return F.coalesce(x.between(-margin, _c(w) + margin) & y.between(-margin, _c(h) + margin), F.lit(False))


def zone_label(x, y, w: float = COURT_W, h: float = COURT_H, half: bool = False, margin: float = 0.0) -> Column:
    """Side and rotation zone such as ``A4``; null outside the court and its margin.

    Front rows reach from the net over a quarter of a full court, or a third of a
    half court, whose net is at y = 0.
    """
    x, y = _c(x), _c(y)
    cx, cy = F.greatest(F.lit(0.0), F.least(F.lit(w), x)), F.greatest(F.lit(0.0), F.least(F.lit(h), y))
    third = F.when(cx < w / 3, 0).when(cx < 2 * w / 3, 1).otherwise(2)
    if half:
        side_a, front = F.lit(True), cy < h / 3
    else:
        side_a = cy <= h / 2
        front = F.when(side_a, cy).otherwise(h - cy) > h / 4
    column = F.when(side_a, third).otherwise(2 - third)  # from the left as that side sees it
    number = F.when(front, F.element_at(F.array(*map(F.lit, (4, 3, 2))), column + 1)).otherwise(F.element_at(F.array(*map(F.lit, (5, 6, 1))), column + 1))
    label = F.concat(F.when(side_a, "A").otherwise("B"), number.cast("string"))
    return F.when(in_court(x, y, w, h, margin), label)


def zone_number(x, y, side, flip: bool = False) -> Column:
    """Zone 1 to 6 by the attack lines at 6 and 12 m; 0 where x is off the court."""
    x, y, a = _c(x), _c(y), _c(side) == "A"
    third = F.when(x < 3, 0).when(x < 6, 1).otherwise(2)
    left = F.when(a, third).otherwise(2 - third)
    if flip:
        left = 2 - left
    front = F.when(a, y >= 6).otherwise(y <= 12)
    number = F.when(front, 4 - left).otherwise(F.when(left == 0, 5).when(left == 1, 6).otherwise(1))
    return F.when(x.between(0, 9), number).otherwise(0).cast("int")


def side_of(y) -> Column:
    return F.when(_c(y) < COURT_H / 2, "A").otherwise("B")


def in_polygon(x, y, corners: list[tuple[float, float]] | None) -> Column:
    """Inside a polygon or on its edge; always true without one."""
    if corners is None:
        return F.lit(True)
    x, y = _c(x).cast("double"), _c(y).cast("double")
    odd, edge = F.lit(False), F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        edge = edge | ((cross == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
        if ay != by:
            crosses = (F.lit(ay) > y) != (F.lit(by) > y)
            odd = odd != (crosses & (x < (bx - ax) * (y - ay) / (by - ay) + ax))
    return F.coalesce(odd | edge, F.lit(False))


def ground_point(x1, y1, x2, y2, ball: bool = False) -> tuple[Column, Column]:
    """Where a person stands (middle of the lower edge), or the middle of a ball."""
    return (_c(x1) + _c(x2)) / 2, (_c(y1) + _c(y2)) / 2 if ball else _c(y2).cast("double")


def render_point(x, y, scale: float, pad: float) -> tuple[Column, Column]:
    """Court metres to pixels of a drawing whose side A is below."""
    return F.rint(_c(x) * scale + pad).cast("int"), F.rint((COURT_H - _c(y)) * scale + pad).cast("int")


# ---- bodies: 17 keypoints (x, y) and their scores


def _kp(kp, i: int) -> tuple[Column, Column]:
    p = F.get(_c(kp), F.lit(i))
    return F.get(p, F.lit(0)), F.get(p, F.lit(1))


def _sure(scores, parts: tuple[int, ...], least: float) -> Column:
    ok = F.lit(True)
    for i in parts:
        ok = ok & F.coalesce(F.get(_c(scores), F.lit(i)) >= least, F.lit(False))
    return ok


def torso_lean(kp, scores, least: float = 0.5) -> Column:
    """Degrees of the line from hips to shoulders off the vertical, right positive."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = (_kp(kp, i) for i in (5, 6, 11, 12))
    across, up = (ax + bx) / 2 - (cx + dx) / 2, (ay + by) / 2 - (cy + dy) / 2
    return F.when(_sure(scores, (5, 6, 11, 12), least), F.degrees(F.atan2(across, -up)))


def stance_width(kp, scores, least: float = 0.5) -> Column:
    (ax, ay), (bx, by) = _kp(kp, 15), _kp(kp, 16)
    return F.when(_sure(scores, (15, 16), least), F.hypot(ax - bx, ay - by))


def knee_angle(kp, scores, side: str, least: float = 0.5) -> Column:
    """Degrees between thigh and shin; 180 is a straight leg."""
    parts = (11, 13, 15) if side == "left" else (12, 14, 16)
    (hx, hy), (kx, ky), (ax, ay) = (_kp(kp, i) for i in parts)
    ux, uy, vx, vy = hx - kx, hy - ky, ax - kx, ay - ky
    cos = (ux * vx + uy * vy) / (F.hypot(ux, uy) * F.hypot(vx, vy) + 1e-9)
    return F.when(_sure(scores, parts, least), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))


def mean_knee(kp, scores, least: float = 0.5) -> Column:
    a, b = knee_angle(kp, scores, "left", least), knee_angle(kp, scores, "right", least)
    return F.coalesce((a + b) / 2, a, b)


POSE_METRICS = {"lean": torso_lean, "stance": stance_width, "knee": mean_knee}


def torso_crop(x1, y1, x2, y2, kp, scores, frame_w: int, frame_h: int, least: float = 0.3, pad: float = 0.18) -> Column:
    """Rectangle around the shirt: by shoulders and hips where those are sure,
    otherwise by shares of the box.  Null for boxes under 4 and crops under 6 pixels."""
    x1, y1, x2, y2 = (_c(v).cast("double") for v in (x1, y1, x2, y2))
    w, h = x2 - x1, y2 - y1
    pts = [_kp(kp, i) for i in (5, 6, 11, 12)]
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    by_pose = _sure(scores, (5, 6, 11, 12), least) & F.coalesce(F.size(_c(kp)) > 12, F.lit(False))
    lx, hx, ly, hy = F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys)
    left, right = F.when(by_pose, lx).otherwise(x1 + w * 0.12), F.when(by_pose, hx).otherwise(x2 - w * 0.12)
    top, bottom = F.when(by_pose, ly).otherwise(y1 + h * 0.18), F.when(by_pose, hy).otherwise(y1 + h * 0.55)
    px, py = (right - left) * pad, (bottom - top) * pad
    left, right, top, bottom = left - px, right + px, top - py, bottom + py
    clamp = lambda v, most: F.greatest(F.lit(0), F.least(F.lit(most), v.cast("int")))
    box = F.struct(clamp(left, frame_w).alias("x1"), clamp(top, frame_h).alias("y1"), clamp(right, frame_w).alias("x2"), clamp(bottom, frame_h).alias("y2"))
    return F.when((w >= 4) & (h >= 4) & (box["x2"] - box["x1"] >= 6) & (box["y2"] - box["y1"] >= 6), box)


def mask_quality(solidity, fit, share, least: float = 0.06) -> Column:
    """How far a court mask can be trusted, from its contour's measures."""
    share = _c(share)
    return F.when(share >= least, _c(solidity) * _c(fit) * (F.lit(0.5) + share)).otherwise(0.0)


# ---- words for people; these are fixed values


def reliability(samples) -> Column:
    return F.when(_c(samples) >= 50, "alta").when(_c(samples) >= 25, "media").otherwise("baja")


def verdict(score) -> Column:
    return F.when(_c(score) >= 80, "excelente").when(_c(score) >= 60, "bueno").when(_c(score) >= 40, "regular").otherwise("bajo")


def spoken_seconds(s) -> Column:
    """``45s`` or ``1m 29s``; ``0s`` for null."""
    t = F.rint(F.coalesce(_c(s), F.lit(0)).cast("double")).cast("long")
    return F.when(t < 60, F.format_string("%ds", t)).otherwise(F.format_string("%dm %02ds", F.floor(t / 60), t % 60))


def heatmap_peak(heat, width: int, height: int, least: float = 0.5, frame_w: int | None = None, frame_h: int | None = None) -> Column:
    """The ball of a model's heatmap, given as one row after the other: ``x, y,
    radius, confidence``; null where no cell reaches ``least``.

    The first of equal peaks counts.  The radius is that of a disc with as many
    cells as lie over half of ``least``, two at least.  With the frame's size,
    the place is in its pixels; the radius goes with the width.
    """
    h = _c(heat)
    top = F.array_max(h)
    at = (F.array_position(h, top) - 1).cast("int")
    radius = F.greatest(F.lit(2.0), F.sqrt(F.size(F.filter(h, lambda v: v > least / 2)) / F.lit(math.pi)))
    wide, high = (frame_w or width) / width, (frame_h or height) / height
    place = F.struct(
        ((at % width) * F.lit(wide)).alias("x"), (F.floor(at / width) * F.lit(high)).alias("y"), (radius * wide).alias("radius"), top.cast("double").alias("confidence")
    )
    return F.when(top >= least, place)
