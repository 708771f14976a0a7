"""Geometry of faces and crops from landmarks and boxes, and the quality vector, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entries of the quality vector in order, and what stands for one that is missing.
QUALITY = {"face_detected": 0.0, "face_frac": 0.0, "sharpness_log": 0.0, "ear": 1.0, "mar": 0.0, "exposure_clipped_frac": 0.0, "face_centeredness": 0.5}
FACE_EXPAND = 1.55


def distance(a: Column, b: Column) -> Column:
    """Distance of two points (arrays or structs of x and y)."""
    return F.sqrt(F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["y"] - b["y"], F.lit(2)))


def eye_ratio(points: Column) -> Column:
    """Eye aspect ratio of six points around an eye (outer corner, two above, inner corner, two below); 0 for no width."""
    p = [F.get(points, i) for i in range(6)]
    width = distance(p[0], p[3])
    return F.when(width == 0, 0.0).otherwise((distance(p[1], p[5]) + distance(p[2], p[4])) / (2.0 * width))


def mouth_ratio(points: Column) -> Column:
    """Mouth height by width of four points (left, right, top, bottom); 0 for no width."""
    p = [F.get(points, i) for i in range(4)]
    width = distance(p[0], p[1])
    return F.when(width == 0, 0.0).otherwise(distance(p[2], p[3]) / width)


def face_square(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, expand: float = FACE_EXPAND) -> dict[str, Column]:
    """x0, y0, x1, y1 of the square around a face box (x, y, w, h), cut at the image's edges."""
    half = F.greatest(w, h) * F.lit(expand / 2)
    cx, cy = x + w / 2, y + h / 2
    return {"x0": F.greatest(F.lit(0.0), cx - half).cast("int"), "y0": F.greatest(F.lit(0.0), cy - half).cast("int"), "x1": F.least(width.cast("double"), cx + half).cast("int"), "y1": F.least(height.cast("double"), cy + half).cast("int")}


def body_box(x0: Column, y0: Column, x1: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """x0, y0, x1, y1 of the body below a face: half a face wider on both sides, down to the image's end."""
    return {"x0": F.greatest(F.lit(0.0), x0 - w * 0.5).cast("int"), "y0": F.greatest(F.lit(0.0), y0 - h * 0.25).cast("int"), "x1": F.least(width.cast("double"), x1 + w * 0.5).cast("int"), "y1": height.cast("int")}


def center_square(width: Column, height: Column) -> dict[str, Column]:
    """left, top and side of the largest square in the middle."""
    side = F.least(width, height)
    return {"left": F.floor((width - side) / 2).cast("int"), "top": F.floor((height - side) / 2).cast("int"), "side": side.cast("int")}


def face_share(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    return (x1 - x0) * (y1 - y0) / (width * height)


def centeredness(cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """1 in the middle of the image, 0 at a corner."""
    return 1.0 - F.hypot((cx - width / 2) / (width / 2), (cy - height / 2) / (height / 2)) / F.sqrt(F.lit(2.0))


def quality_vector(q: Column) -> Column:
    """The quality array from a map of measurements: sharpness as log1p, defaults for what is missing."""
    sharp = F.log1p(F.greatest(F.coalesce(F.try_element_at(q, F.lit("sharpness")), F.lit(0.0)), F.lit(0.0)))
    return F.array(*[sharp if k == "sharpness_log" else F.coalesce(F.try_element_at(q, F.lit(k)), F.lit(v)) for k, v in QUALITY.items()])
