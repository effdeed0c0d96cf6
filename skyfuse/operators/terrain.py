"""Projecting photo detections onto a height grid: rays, control points, planes.

Heights live in square tiles.  A grid up to BROADCAST bytes goes to every worker once; a larger one stays in the
shared folder, and workers read the tiles that their rays cross, a bounded number at a time.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from ..functions.camera import Camera
from ..runtime import new_folder

BROADCAST, TILE, HELD = 64 << 20, 512, 64


@dataclass(frozen=True)
class Rays:
    """How rays are followed and planes fitted."""

    step: float = 0.25
    margin: float = 2.0
    most_steps: int = 4096
    tolerance: float = 0.25
    window: int = 5
    search_margin: float = 10.0
    interval: int = 1
    most_height_diff: float = 2.0
    filter_heights: bool = True
    mean_height_fallback: bool = False
    min_control: int = 4
    inlier: float = 0.2
    min_inliers: int = 5
    most_tilt: float = 60.0
    trials: int = 100
    seed: int = 0
    surfaces: int = 4
    anchor_radius: float = 2.0


def rotation(phi: float, omega: float, kappa: float) -> np.ndarray:
    """Photo to ground axes as a 3 x 3 matrix."""
    sp, cp, so, co, sk, ck = math.sin(phi), math.cos(phi), math.sin(omega), math.cos(omega), math.sin(kappa), math.cos(kappa)
    return np.array([[cp * ck - sp * so * sk, -cp * sk - sp * so * ck, -sp * co], [co * sk, co * ck, -so], [sp * ck + cp * so * sk, -sp * sk + cp * so * ck, cp * co]])


@dataclass
class Terrain:
    """Height grid (row, col) under a geotransform; heights that equal ``nodata`` or aren't finite are unknown."""

    geo: tuple[float, ...]
    rows: int
    cols: int
    low: float | None
    high: float | None
    nodata: float | None = None
    heights: np.ndarray | None = None
    folder: str | None = None
    held: OrderedDict = field(default_factory=OrderedDict)

    @staticmethod
    def of(heights: np.ndarray, geo, nodata: float | None = None) -> Terrain:
        h = np.asarray(heights, np.float64)
        known = h[np.isfinite(h) & (h != nodata if nodata is not None else True)]
        return Terrain(tuple(geo), *h.shape, float(known.min()) if known.size else None, float(known.max()) if known.size else None, nodata, h)

    def stored(self, spark) -> Terrain:
        """The same grid in tiles in the shared folder."""
        h, folder = self.heights, new_folder(spark, "terrain")
        tiles = [(r // TILE, c // TILE, h[r : r + TILE, c : c + TILE]) for r in range(0, self.rows, TILE) for c in range(0, self.cols, TILE)]
        rows = [(tr, tc, t.shape[1], t.ravel().tolist()) for tr, tc, t in tiles]
        spark.createDataFrame(rows, "tr int, tc int, width int, z array<double>").write.partitionBy("tr", "tc").parquet(f"{folder}/tiles")
        return Terrain(self.geo, self.rows, self.cols, self.low, self.high, self.nodata, None, f"{folder}/tiles")

    def _tile(self, tr: int, tc: int) -> np.ndarray:
        key = (tr, tc)
        if key not in self.held:
            import pyarrow.parquet as pq
            from pyarrow import fs

            store, top = fs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("/") else self.folder.replace("file:", "file://", 1))
            files = [f.path for f in store.get_file_info(fs.FileSelector(f"{top}/tr={tr}/tc={tc}")) if f.path.endswith(".parquet")]
            t = pq.read_table(files[0], filesystem=store, partitioning=None)
            self.held[key] = t["z"].combine_chunks().flatten().to_numpy().reshape(-1, t["width"][0].as_py())
            while len(self.held) > HELD:
                self.held.popitem(last=False)
        self.held.move_to_end(key)
        return self.held[key]

    def pixels(self, x, y):
        """Fractional (col, row) of map points."""
        g = self.geo
        det = g[1] * g[5] - g[2] * g[4]
        dx, dy = x - g[0], y - g[3]
        return (dx * g[5] - dy * g[2]) / det, (dy * g[1] - dx * g[4]) / det

    def at(self, col, row) -> np.ndarray:
        """Heights of whole cells; NaN outside the grid or where unknown."""
        col, row = np.asarray(col, np.int64), np.asarray(row, np.int64)
        out = np.full(col.shape, np.nan)
        ok = (col >= 0) & (row >= 0) & (col < self.cols) & (row < self.rows)
        if self.heights is not None:
            out[ok] = self.heights[row[ok], col[ok]]
        elif ok.any():
            at = np.flatnonzero(ok.ravel())
            c, r = col.ravel()[at], row.ravel()[at]
            tile = r // TILE * (self.cols // TILE + 1) + c // TILE
            flat = out.ravel()
            for t in np.unique(tile):
                here = tile == t
                z = self._tile(int(t) // (self.cols // TILE + 1), int(t) % (self.cols // TILE + 1))
                flat[at[here]] = z[r[here] % TILE, c[here] % TILE]
            out = flat.reshape(col.shape)
        out[~np.isfinite(out)] = np.nan
        if self.nodata is not None:
            out[out == self.nodata] = np.nan
        return out

    def under(self, x, y) -> np.ndarray:
        """Heights of the nearest cells under map points; halves go to the even cell."""
        c, r = self.pixels(np.asarray(x, float), np.asarray(y, float))
        big = 1e15
        return self.at(np.rint(np.clip(c, -big, big)), np.rint(np.clip(r, -big, big)))

    def median(self, x: float, y: float, window: int) -> float | None:
        """Median height of the window of cells around a point."""
        c, r = (int(np.rint(v)) for v in self.pixels(x, y))
        k = window // 2 if window > 1 else 0
        cc, rr = np.meshgrid(np.arange(max(0, c - k), min(self.cols, c + k + 1)), np.arange(max(0, r - k), min(self.rows, r + k + 1)))
        z = self.at(cc, rr)
        z = z[np.isfinite(z)]
        return float(np.median(z)) if z.size else None


class Projector:
    """Detections of photos onto a terrain."""

    def __init__(self, terrain: Terrain, cam: Camera, rays: Rays = Rays()):
        self.t, self.cam, self.rays = terrain, cam, rays

    def _beams(self, pix: np.ndarray, pose) -> np.ndarray:
        """Ground directions of pixels, one row each."""
        p = np.column_stack([pix[:, 0] - self.cam.cx, self.cam.cy - pix[:, 1], np.full(len(pix), -self.cam.focal)])
        return p @ rotation(*pose[3:6]).T

    def hits(self, pix, pose) -> np.ndarray:
        """(x, y, z) where each pixel's ray first meets the surface, seen from the camera; NaN where it doesn't.

        The ray is followed outward over heights from the camera, or just above the highest ground, to just below the
        lowest; the first step from above the surface to on or under it is halved to tolerance.
        """
        pix = np.asarray(pix, float).reshape(-1, 2)
        out, r = np.full((len(pix), 3), np.nan), self.rays
        if self.t.low is None or not len(pix):
            return out
        cam = np.asarray(pose[:3], float)
        top, floor = min(cam[2], self.t.high + r.margin), self.t.low - r.margin
        if top <= floor:
            return out
        n = min(int((top - floor) / max(r.step, 1e-6)) + 2, max(2, r.most_steps))
        z = np.linspace(top, floor, n)
        beam = self._beams(pix, pose)
        level = np.abs(beam[:, 2]) < 1e-12
        rate = np.where(level[:, None], 0.0, beam[:, :2] / np.where(level, 1.0, beam[:, 2])[:, None])
        place = lambda zz, k: cam[:2] + (zz - cam[2])[:, None] * rate[k]
        for k in range(len(pix)):
            xy = cam[:2] + (z - cam[2])[:, None] * rate[k]
            gap = z - self.t.under(xy[:, 0], xy[:, 1])
            first = np.flatnonzero((gap[:-1] > 0) & (gap[1:] <= 0))
            if not first.size:
                continue
            a, b = z[first[0]], z[first[0] + 1]
            m, ground = b, b - gap[first[0] + 1]
            for _ in range(40 if gap[first[0] + 1] != 0 else 0):
                m = (a + b) / 2
                p = place(np.array([m]), k)[0]
                ground = float(self.t.under(p[:1], p[1:])[0])
                if not np.isfinite(ground) or abs(m - ground) <= r.tolerance:
                    break
                a, b = (m, b) if m > ground else (a, m)
            if np.isfinite(ground):
                out[k] = [*place(np.array([m]), k)[0], ground]
        return out

    def _corners_on_ground(self, box, pose) -> np.ndarray:
        m = self.rays.search_margin
        x1, y1, x2, y2 = box[0] - m, box[1] - m, box[2] + m, box[3] + m
        pix = np.array([[x1, y1], [x1, y2], [x2, y2], [x2, y1]])
        h = self.hits(pix, pose)[:, :2]
        if self.rays.mean_height_fallback:
            miss = ~np.isfinite(h[:, 0])
            h[miss] = self.at_height(pix[miss], pose, self.cam.mean_height)
        return h[np.isfinite(h[:, 0])]

    def at_height(self, pix, pose, z: float) -> np.ndarray:
        """(x, y) of pixels at a level; the camera's place for level rays."""
        pix = np.asarray(pix, float).reshape(-1, 2)
        b = self._beams(pix, pose)
        level = np.abs(b[:, 2]) < 1e-12
        rate = np.where(level[:, None], 0.0, b[:, :2] / np.where(level, 1.0, b[:, 2])[:, None])
        return np.asarray(pose[:2], float) + (z - pose[2]) * rate

    def cells(self, box, pose, known_only: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, z) of the grid cells under a pixel box and its margin, near the height under its centre."""
        none, r = (np.zeros(0),) * 3, self.rays
        ground = self._corners_on_ground(box, pose)
        if not len(ground):
            return none
        c, row = self.t.pixels(np.array([ground[:, 0].min(), ground[:, 0].max()]), np.array([ground[:, 1].max(), ground[:, 1].min()]))
        c0, c1 = (max(0, min(int(v), self.t.cols - 1)) for v in (c.min(), c.max()))
        r0, r1 = (max(0, min(int(v), self.t.rows - 1)) for v in (row.min(), row.max()))
        if c0 >= c1 or r0 >= r1:
            return none
        cc, rr = (a.ravel() for a in np.meshgrid(np.arange(c0, c1 + 1, max(1, r.interval)), np.arange(r0, r1 + 1, max(1, r.interval))))
        z = self.t.at(cc, rr)
        ok = np.isfinite(z)
        if known_only or r.filter_heights:
            mid = self.hits([[(box[0] + box[2]) / 2, (box[1] + box[3]) / 2]], pose)[0]
            ref = self.t.median(mid[0], mid[1], r.window) if np.isfinite(mid[0]) else None
            if ref is None:
                ref = self._centre_median()
            if ref is not None:
                ok &= np.abs(np.nan_to_num(z, nan=np.inf) - ref) <= r.most_height_diff
        g = self.t.geo
        cc, rr, z = cc[ok].astype(float), rr[ok].astype(float), z[ok]
        return g[0] + cc * g[1] + rr * g[2], g[3] + cc * g[4] + rr * g[5], z

    def _centre_median(self) -> float | None:
        g, c, r = self.t.geo, self.t.cols // 2, self.t.rows // 2
        return self.t.median(g[0] + c * g[1] + r * g[2], g[3] + c * g[4] + r * g[5], self.rays.window)

    def control_points(self, box, pose) -> tuple[np.ndarray, np.ndarray]:
        """(pixels, map points) of the cells that fall into the box and the photo."""
        x, y, z = self.cells(box, pose, False)
        d = np.column_stack([x, y, z]) - np.asarray(pose[:3], float) if len(z) else np.zeros((0, 3))
        q = d @ rotation(*pose[3:6])
        den = np.where(np.abs(q[:, 2]) < 1e-12, 1e-12, q[:, 2])
        u, v = self.cam.cx - self.cam.focal * q[:, 0] / den, self.cam.cy + self.cam.focal * q[:, 1] / den
        ok = (u >= max(0, box[0])) & (u <= min(self.cam.width, box[2])) & (v >= max(0, box[1])) & (v <= min(self.cam.height, box[3]))
        return np.column_stack([u, v])[ok], np.column_stack([x, y])[ok]

    def plane(self, x, y, z, anchor=None):
        """(a, b, c, inliers, rmse) of z = a x + b y + c through the cells, or None.

        With an anchor, cells near it are tried first, and surfaces are peeled off, largest first, until one holds
        the anchor; failing that the first that isn't too steep.
        """
        r = self.rays
        least = max(3, r.min_inliers)
        if anchor is not None and np.isfinite(anchor[0]) and r.anchor_radius > 0:
            near = (x - anchor[0]) ** 2 + (y - anchor[1]) ** 2 <= r.anchor_radius**2
            if near.sum() >= least and (got := self._peel(x[near], y[near], z[near], anchor, least)):
                return got
        return self._peel(x, y, z, anchor if anchor is not None and np.isfinite(anchor[0]) else None, least)

    def _peel(self, x, y, z, anchor, least):
        r, left, fallback = self.rays, np.arange(len(z)), None
        for _ in range(max(1, r.surfaces) if anchor is not None else 1):
            if len(left) < least:
                break
            coef, mask = consensus_plane(x[left], y[left], z[left], r.inlier, r.trials, r.seed)
            if coef is None or mask.sum() < r.min_inliers:
                break
            on, left = left[mask], left[~mask]
            a, b, c = coef
            if math.degrees(math.atan(math.hypot(a, b))) > r.most_tilt:
                continue
            res = z[on] - (a * x[on] + b * y[on] + c)
            got = (a, b, c, int(len(on)), float(np.sqrt((res * res).mean())))
            if anchor is None or abs(a * anchor[0] + b * anchor[1] + c - anchor[2]) <= r.inlier:
                return got
            fallback = fallback or got
        return fallback

    def on_plane(self, pix, pose, abc) -> np.ndarray | None:
        """(x, y, z) of pixels' rays on a plane; None if a ray runs along it."""
        a, b, c = abc
        d, cam = self._beams(np.asarray(pix, float), pose), np.asarray(pose[:3], float)
        den = d[:, 2] - a * d[:, 0] - b * d[:, 1]
        if (np.abs(den) < 1e-9).any():
            return None
        out = cam + ((a * cam[0] + b * cam[1] + c - cam[2]) / den)[:, None] * d
        return out if np.isfinite(out).all() else None

    def feature(self, seg, box, pose, method: str = "auto") -> dict:
        """seg, seg_z, method, tilt, azimuth, pf_inlier, pf_rmse of a feature; failures keep the pixels and are named *_failed.

        Methods: slope (plane under the feature), affine (control points), collinearity (each corner's ray), auto
        (affine with enough control points, else collinearity).
        """
        rings = [np.asarray(r, float).reshape(-1, 2) for r in seg or [] if r is not None and len(r) >= 6 and len(r) % 2 == 0]
        if pose is None or any(v is None for v in pose):
            return {"seg": seg, "method": "pose_missing_failed"}
        if not rings:
            return {"seg": seg, "method": "ring_missing_failed"}
        flat = lambda ps: [p[:, :2].ravel().tolist() for p in ps]
        if method == "slope":
            x, y, z = self.cells(box, pose)
            anchor = self.hits([[(box[0] + box[2]) / 2, (box[1] + box[3]) / 2]], pose)[0]
            got = self.plane(x, y, z, anchor) if len(z) >= self.rays.min_inliers else None
            ps = [p for p in (self.on_plane(r, pose, got[:3]) for r in rings) if p is not None] if got else []
            if not ps:
                return {"seg": seg, "method": "slope_failed"}
            a, b = got[:2]
            return {"seg": flat(ps), "seg_z": [p[:, 2].tolist() for p in ps], "method": "slope", "tilt": math.atan(math.hypot(a, b)), "azimuth": math.atan2(a, b), "pf_inlier": got[3], "pf_rmse": got[4]}
        src, dst = (np.zeros((0, 2)),) * 2 if method == "collinearity" else self.control_points(box, pose)
        if method == "affine" or method == "auto" and len(src) >= self.rays.min_control:
            if len(src) < 3:
                return {"seg": seg, "method": "affine_failed"}
            m = affine_fit(src, dst)
            return {"seg": flat([np.column_stack([r, np.ones(len(r))]) @ m for r in rings]), "method": "affine"}
        ps = []
        for r in rings:
            h = self.hits(r, pose)[:, :2]
            if self.rays.mean_height_fallback:
                miss = ~np.isfinite(h[:, 0])
                h[miss] = self.at_height(r[miss], pose, self.cam.mean_height)
            h = h[np.isfinite(h[:, 0])]
            if len(h) >= 3:
                ps.append(h)
        return {"seg": flat(ps), "method": "collinearity"} if ps else {"seg": seg, "method": "collinearity_failed"}


def affine_fit(src, dst) -> np.ndarray:
    """3 x 2 matrix of the least-squares affine map from src to dst (three pairs or more)."""
    src, dst = np.asarray(src, float), np.asarray(dst, float)
    if len(src) < 3:
        raise ValueError("an affine map needs three pairs")
    return np.linalg.lstsq(np.column_stack([src, np.ones(len(src))]), dst, rcond=None)[0]


def consensus_plane(x, y, z, inlier: float, trials: int, seed: int):
    """((a, b, c), mask): the plane through three random cells that most cells are near, fitted again to those; (None, None) without one."""
    rng, n = np.random.default_rng(seed), len(z)
    mx, my = x.mean(), y.mean()
    p = np.column_stack([x - mx, y - my, np.ones(n)])
    best = None
    for _ in range(trials):
        k = rng.choice(n, 3, replace=False)
        det = np.linalg.det(p[k])
        if abs(det) < 1e-12:
            continue
        mask = np.abs(p @ np.linalg.solve(p[k], z[k]) - z) <= inlier
        if best is None or mask.sum() > best.sum():
            best = mask
            if mask.all():
                break
    if best is None or best.sum() < 3:
        return None, None
    a, b, c = np.linalg.lstsq(p[best], z[best], rcond=None)[0]
    return (float(a), float(b), float(c - a * mx - b * my)), best


def projected(features: DataFrame, terrain: Terrain, cam: Camera = Camera(), rays: Rays = Rays(), method: str = "auto") -> DataFrame:
    """features(seq, seg, x1..y2 in pixels, xs..kappa) -> on the map: seg, seg_z, method and plane fit; other columns stay.

    Rows are independent: no shuffle; the grid is broadcast up to BROADCAST bytes, else read by tile.
    """
    spark = features.sparkSession
    if terrain.heights is not None and terrain.heights.nbytes > BROADCAST:
        terrain = terrain.stored(spark)
    sent = spark.sparkContext.broadcast(terrain)
    keep = [c for c in features.columns if c not in ("seg", "seg_z", "method", "tilt", "azimuth", "pf_inlier", "pf_rmse")]
    added = "seg array<array<double>>, seg_z array<array<double>>, method string, tilt double, azimuth double, pf_inlier int, pf_rmse double"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema if f.name in keep) + ", " + added

    def run(batches):
        import pyarrow as pa

        ring = pa.list_(pa.list_(pa.float64()))
        kinds = {"seg": ring, "seg_z": ring, "method": pa.string(), "tilt": pa.float64(), "azimuth": pa.float64(), "pf_inlier": pa.int32(), "pf_rmse": pa.float64()}
        proj = Projector(sent.value, cam, rays)
        for b in batches:
            rows = []
            cols = [b.column(c).to_pylist() for c in ("seg", "x1", "y1", "x2", "y2", "xs", "ys", "zs", "phi", "omega", "kappa")]
            for seg, x1, y1, x2, y2, *pose in zip(*cols, strict=True):
                rows.append(proj.feature(seg, (x1, y1, x2, y2), pose, method))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array([r.get(c) for r in rows], k) for c, k in kinds.items())], [*keep, *kinds])

    return features.mapInArrow(run, schema)
