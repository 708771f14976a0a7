"""Scalar rules: tags, technical quality, capture metadata and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the tags and of the technical score.
WIDE_BELOW, CLOSE_FROM = -0.038, 0.0
PEOPLE_AREA, HERO_AREA, HERO_SECOND, HERO_BACKGROUND = 0.04, 0.06, 0.02, 0.05
W_SHARP, W_EXPOSURE, W_EYES, W_COMPOSITION = 0.4, 0.4, 0.5, 0.2
REJECTED_SCORE = -1e9
# Rules of the hard reject, and the ranges that the technical components are scaled from.
CLOSED_FACE, CLOSED_EAR, BLUR_FACE, BLUR_SHARPNESS, CLIPPED_SHARE = 0.05, 0.12, 0.005, 4.0, 0.40
EXPOSURE_RANGE, EAR_RANGE, EYE_FACE_RANGE, FACE_RANGE, SHARP_SHARES = (0.0, 0.30), (0.10, 0.22), (0.005, 0.05), (0.0, 0.20), [0.05, 0.95]


def unit(x: Column, lo: Column | float, hi: Column | float) -> Column:
    """x scaled from [lo, hi] to [0, 1] and clamped; 0 for an empty range."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(hi <= lo, 0.0).otherwise(F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))


def shot_of(closeness: Column) -> Column:
    return F.when(closeness.isNull(), "").when(closeness < WIDE_BELOW, "wide").when(closeness >= CLOSE_FROM, "close").otherwise("medium")


def subject_of(area: Column) -> Column:
    return F.when(area >= PEOPLE_AREA, "people").otherwise("stage")


def hero_of(area: Column, prominent: Column, second: Column, background: Column, most: float = HERO_BACKGROUND) -> Column:
    return (area >= PEOPLE_AREA) & (area >= HERO_AREA) & (prominent <= 1) & (second < HERO_SECOND) & (background <= most)


def reject_reason(face_frac: Column, ear: Column, face: Column, sharpness: Column, clipped: Column) -> Column:
    """First rule that holds, '' for none."""
    return F.when((face_frac > CLOSED_FACE) & (ear < CLOSED_EAR), "eyes_closed").when(face & (face_frac > BLUR_FACE) & (sharpness < BLUR_SHARPNESS), "severe_blur").when(face & (clipped > CLIPPED_SHARE), "exposure_clipped").otherwise("")


def camera_of(serial: Column, make: Column, model: Column, lens: Column, filename: Column) -> Column:
    """Body serial, else make, model and lens, else make and model, else the file itself."""
    s, mk, md, ln = (F.nullif(F.trim(c), F.lit("")) for c in (serial, make, model, lens))
    return F.coalesce(F.concat(F.lit("body:"), s), F.concat(F.lit("rig:"), mk, F.lit("/"), md, F.lit("/"), ln), F.concat(F.lit("model:"), mk, F.lit("/"), md), F.concat(F.lit("unknown:"), filename))


def capture_time(text: Column, subseconds: Column) -> Column:
    """EXIF date and time with up to six digits of a second; null if the date can't be read."""
    digits = F.regexp_replace(F.coalesce(subseconds, F.lit("")), "[^0-9]", "")
    micros = F.rpad(F.substring(digits, 1, 6), 6, "0").cast("int")
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz") + F.make_dt_interval(secs=(micros / F.lit(1000000.0)).cast("decimal(18,6)"))


def safe_name(name: Column) -> Column:
    """Letters, digits, '.', '_' and '-' only, at most 60 characters, 'run' if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(plain, 1, 60), F.lit("")), F.lit("run"))


def folder_name(run_id: Column, name: Column) -> Column:
    return F.format_string("run%04d_%s", run_id, safe_name(name))


def iso_time(t: Column) -> Column:
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def next_version(v: int) -> int:
    """The even number after v: odd versions are being written."""
    return (v | 1) + 1


def pair_loss(d: Column, margin: float = 0.0) -> Column:
    """Loss of a pair whose good frame scores d more: softplus(-d) without overflow, or a hinge with a margin."""
    return F.greatest(margin - d, F.lit(0.0)) if margin > 0 else F.greatest(-d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))
