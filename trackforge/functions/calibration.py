"""Calibration mathematics for one camera, on the driver in numpy."""

from __future__ import annotations

import numpy as np

Points = list[tuple[float, float]]


def homography(src: Points, dst: Points) -> np.ndarray:
    """3 x 3 map of ``src`` to ``dst``: exact for four points, least squares beyond."""
    if len(src) < 4 or len(src) != len(dst):
        raise ValueError("a homography needs at least four pairs of points")
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    h, *_ = np.linalg.lstsq(np.array(rows, float), np.array(right, float), rcond=None)
    return np.append(h, 1.0).reshape(3, 3)


def robust_homography(src: Points, dst: Points, tolerance: float = 5.0, tries: int = 200, seed: int = 0) -> np.ndarray:
    """RANSAC over four-point samples; the largest consensus is fitted again."""
    if len(src) == 4:
        return homography(src, dst)
    rng, best = np.random.default_rng(seed), np.zeros(len(src), bool)
    s, d = np.array(src, float), np.array(dst, float)
    for _ in range(tries):
        pick = rng.choice(len(src), 4, replace=False)
        try:
            err = np.hypot(*(apply(homography(s[pick].tolist(), d[pick].tolist()), s) - d).T)
        except np.linalg.LinAlgError:
            continue
        if (err <= tolerance).sum() > best.sum():
            best = err <= tolerance
    if best.sum() < 4:
        return homography(src, dst)
    return homography(s[best].tolist(), d[best].tolist())


def apply(h: np.ndarray, points) -> np.ndarray:
    p = np.c_[np.asarray(points, float), np.ones(len(points))] @ np.asarray(h, float).T
    return p[:, :2] / p[:, 2:]


def order_corners(points: Points) -> Points:
    """Top left, top right, bottom right, bottom left; the first of equal ones."""
    p = np.asarray(points, float)
    s, d = p.sum(axis=1), p[:, 0] - p[:, 1]
    return [tuple(p[i]) for i in (s.argmin(), d.argmax(), s.argmax(), d.argmin())]


def default_corners(w: int, h: int) -> Points:
    return [(w * 0.30, h * 0.32), (w * 0.70, h * 0.32), (w * 0.82, h * 0.85), (w * 0.18, h * 0.85)]


def court_homography(corners: Points, court_w: float, court_h: float, ppm: float, flip: bool = False) -> np.ndarray:
    """Image to court pixels from four ordered corners."""
    target = [(0, 0), (court_w * ppm, 0), (court_w * ppm, court_h * ppm), (0, court_h * ppm)]
    return homography(corners, [target[i] for i in (3, 2, 1, 0)] if flip else target)


def roi_polygon(h: np.ndarray, court_w: float, court_h: float, ppm: float, margin: float = 2.0) -> Points | None:
    """The court and a margin, in whole image pixels; None for a singular map."""
    try:
        back = np.linalg.inv(np.asarray(h, float))
    except np.linalg.LinAlgError:
        return None
    lo, w, e = -margin, court_w + margin, court_h + margin
    corners = apply(back, np.array([(lo, lo), (w, lo), (w, e), (lo, e)]) * ppm)
    return [(int(x), int(y)) for x, y in corners] if np.isfinite(corners).all() else None


#: fixed values: room around the court for balls, as shares of the frame
BALL_SIDE, BALL_BELOW, BALL_ABOVE = 0.03, 0.03, 0.50


def ball_region(corners: Points | None, frame_h: int, frame_w: int) -> tuple[float, float, float, float] | None:
    """x1, y1, x2, y2 in which a ball can be; None without four finite corners."""
    p = np.asarray(corners if corners is not None else [], float)
    if p.shape != (4, 2) or not np.isfinite(p).all():
        return None
    (x1, y1), (x2, y2) = p.min(axis=0), p.max(axis=0)
    return x1 - BALL_SIDE * frame_w, max(0.0, y1 - BALL_ABOVE * frame_h), x2 + BALL_SIDE * frame_w, y2 + BALL_BELOW * frame_h


def line(p, q) -> np.ndarray:
    return np.cross([*p, 1.0], [*q, 1.0])


def intersection(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Where two lines meet; None for parallels."""
    x = np.cross(a, b)
    return None if abs(x[2]) < 1e-6 else x[:2] / x[2]


def rectangle_aspect(corners: Points, frame_h: int, frame_w: int) -> tuple[float, bool]:
    """Long by short side of the rectangle behind four image corners.

    The vanishing points of its sides give the focal length of a camera without
    skew; the sides follow.  Not reliable where opposite sides are parallel in the
    image or no real focal length exists: then the sides are measured in pixels.
    """
    tl, tr, br, bl = (np.asarray(p, float) for p in corners)
    flat = _pixel_aspect(tl, tr, br, bl)
    v1, v2 = intersection(line(tl, tr), line(bl, br)), intersection(line(tl, bl), line(tr, br))
    if v1 is None or v2 is None:
        return flat, False
    centre = np.array([frame_w / 2, frame_h / 2])
    f2 = -float((v1 - centre) @ (v2 - centre))
    if not np.isfinite(f2) or f2 <= 1:
        return flat, False
    rays = [np.append(p - centre, np.sqrt(f2)) for p in (tl, tr, br, bl)]
    # depths with which the corners close a parallelogram: tl + br = tr + bl
    k, *_ = np.linalg.lstsq(np.c_[rays[1], rays[3], -rays[2]], rays[0], rcond=None)
    p0, p1, p3 = rays[0], k[0] * rays[1], k[1] * rays[3]
    a, b = np.linalg.norm(p1 - p0), np.linalg.norm(p3 - p0)
    if min(a, b) < 1e-9 or not np.isfinite(a + b) or (k <= 0).any():
        return flat, False
    return float(max(a, b) / min(a, b)), True


def _pixel_aspect(tl, tr, br, bl) -> float:
    a = (np.linalg.norm(tr - tl) + np.linalg.norm(br - bl)) / 2
    b = (np.linalg.norm(bl - tl) + np.linalg.norm(br - tr)) / 2
    return float(max(a, b) / max(min(a, b), 1e-9))


def court_size(corners: Points, frame_h: int, frame_w: int, forced: str = "auto") -> tuple[float, float]:
    """9 x 18 or 9 x 9 metres; a full court where the aspect is not reliable."""
    if forced != "auto":
        return (9.0, 18.0) if forced == "full" else (9.0, 9.0)
    aspect, sure = rectangle_aspect(corners, frame_h, frame_w)
    return (9.0, 9.0) if sure and aspect < 1.5 else (9.0, 18.0)


def mask_quality(solidity: float, fit: float, share: float, least: float = 0.06) -> float:
    """How far a court mask can be trusted, from its contour's measures."""
    return solidity * fit * (0.5 + share) if share >= least else 0.0


def smooth_density(grid: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian with mirrored borders."""
    r = max(1, int(round(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(grid, pad, mode="reflect" if grid.shape[axis] > r else "symmetric")
        grid = np.apply_along_axis(lambda v: np.convolve(v, k, mode="valid"), axis, wide)
    return grid


def envelope_mask(grid: np.ndarray, percentile: float = 75, sigma: float = 25) -> np.ndarray:
    """Cells of a smoothed density at or above its percentile over the positive ones."""
    smooth = smooth_density(np.asarray(grid, float), sigma)
    some = smooth[smooth > 0]
    return smooth >= np.percentile(some, percentile) if len(some) else np.zeros(grid.shape, bool)
