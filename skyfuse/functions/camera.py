"""Frame-camera geometry as column expressions: rotation, collinearity both ways, affine geotransforms, view direction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Camera:
    """Interior orientation in pixels, image size, and the mean ground height."""

    focal: float = 3713.29
    cx: float = 2647.02
    cy: float = 1969.28
    width: int = 5280
    height: int = 3956
    mean_height: float = 37.5


def rotation(phi: Column, omega: Column, kappa: Column) -> list[Column]:
    """Nine coefficients a1 a2 a3 b1 b2 b3 c1 c2 c3 of the phi-omega-kappa system."""
    sp, cp, so, co, sk, ck = F.sin(phi), F.cos(phi), F.sin(omega), F.cos(omega), F.sin(kappa), F.cos(kappa)
    return [cp * ck - sp * so * sk, -cp * sk - sp * so * ck, -sp * co, co * sk, co * ck, -so, sp * ck + cp * so * sk, -sp * sk + cp * so * ck, cp * co]


def to_photo(ground: list[Column], camera: list[Column], rot: list[Column], focal: float) -> list[Column]:
    """Ground (X, Y, Z) -> photo (px, py); far away where the point stands in the camera's plane."""
    dx, dy, dz = (g - c for g, c in zip(ground, camera, strict=True))
    a1, a2, a3, b1, b2, b3, c1, c2, c3 = rot
    den = a3 * dx + b3 * dy + c3 * dz
    flat, far = F.abs(den) < 1e-12, F.lit(1e12)
    px = F.when(flat, far).otherwise(-F.lit(focal) * (a1 * dx + b1 * dy + c1 * dz) / den)
    py = F.when(flat, far).otherwise(-F.lit(focal) * (a2 * dx + b2 * dy + c2 * dz) / den)
    return [px, py]


def to_ground(photo: list[Column], z: Column, camera: list[Column], rot: list[Column], focal: float) -> list[Column]:
    """Photo (px, py) -> ground (X, Y) at height z; the camera's place where the ray is level."""
    px, py = photo
    xs, ys, zs = camera
    a1, a2, a3, b1, b2, b3, c1, c2, c3 = rot
    f = F.lit(focal)
    den = c1 * px + c2 * py - c3 * f
    flat = F.abs(den) < 1e-12
    x = F.when(flat, xs).otherwise((z - zs) * (a1 * px + a2 * py - a3 * f) / den + xs)
    y = F.when(flat, ys).otherwise((z - zs) * (b1 * px + b2 * py - b3 * f) / den + ys)
    return [x, y]


def pixel_to_map(gt: list[Column], col: Column, row: Column) -> list[Column]:
    return [gt[0] + col * gt[1] + row * gt[2], gt[3] + col * gt[4] + row * gt[5]]


def map_to_pixel(gt: list[Column], x: Column, y: Column) -> list[Column]:
    """Inverse of ``pixel_to_map``; null where the geotransform can't be inverted."""
    det = gt[1] * gt[5] - gt[2] * gt[4]
    dx, dy = x - gt[0], y - gt[3]
    ok = lambda v: F.when(det != 0, v / det)
    return [ok(dx * gt[5] - dy * gt[2]), ok(dy * gt[1] - dx * gt[4])]


def tilt_degrees(phi: Column, omega: Column) -> Column:
    return F.degrees(F.hypot(phi, omega))


def direction(phi: Column, omega: Column, kappa: Column, nadir_below: float = 10.0, step: int = 45) -> Column:
    """'nadir' under ``nadir_below`` degrees of tilt, else the heading's sector 'az0', 'az45', ..."""
    deg = F.degrees(kappa)
    sector = (F.floor((deg - F.floor(deg / 360) * 360) / step) * step).cast("int")
    return F.when(tilt_degrees(phi, omega) < nadir_below, F.lit("nadir")).otherwise(F.concat(F.lit("az"), sector.cast("string")))
