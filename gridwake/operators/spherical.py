"""Areas that any convex cells share on the sphere: unstructured, across the seam, on the poles, of unlike sizes.

A cell is a list of corners (lons, lats) joined by great circles. Its bounding cap is covered by cells of a quadtree on the
cube's six faces, at the level whose cells are about as wide as the cap: a few keys a cell whatever its size and
place. Cells of two levels meet at the coarser one: each side also goes by the ancestors of its keys, at those levels that
the other side has. A pair that meets at several keys counts at the least. Pairs are clipped in batches, all of a batch
at once.

Defined results: corners may turn either way and may coincide, as on a pole; rows with a null or empty list, a null
corner, lists of unlike length, or a cell that is no smaller than a hemisphere share nothing; repeated rows are added up
by the caller; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Finest level of the quadtree: some 40 cm on the earth.
FINEST = 24
#: Pairs that are clipped at once.
BATCH = 4096
_FACES = [np.array(f, float) for f in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]  # axes: normal, first, second


def unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], -1)


def corners(lons, lats, pieces: int = 1) -> np.ndarray | None:
    """Unit vectors of a cell's corners, turning left, with each side in so many pieces that are straight in lon and lat."""
    if lons is None or lats is None or len(lons) < 3 or len(lons) != len(lats):
        return None
    lon, lat = np.asarray(lons, float), np.asarray(lats, float)
    if not (np.isfinite(lon).all() and np.isfinite(lat).all()):
        return None
    if pieces > 1:
        t = np.arange(pieces) / pieces
        step = (np.roll(lon, -1) - lon + 180) % 360 - 180
        lon, lat = (lon[:, None] + step[:, None] * t).ravel(), (lat[:, None] + (np.roll(lat, -1) - lat)[:, None] * t).ravel()
    p = unit(lon, lat)
    turn = np.cross(p, np.roll(p, -1, 0)).sum(0)
    centre = p.mean(0)
    if np.linalg.norm(centre) < 1e-9:
        return None
    if turn @ centre < 0:
        p = p[::-1]
    return p if (p @ (centre / np.linalg.norm(centre)) > 1e-9).all() else None


def covering(p: np.ndarray) -> tuple[int, list[int]]:
    """Level and keys (face, column, row in one number) of the cells that the cap around p reaches."""
    c = p.mean(0)
    c = c / np.linalg.norm(c)
    r = float(np.arccos(np.clip((p @ c).min(), -1, 1))) + 1e-12
    level = int(np.clip(np.floor(np.log2(np.pi / 4 / r)), 0, FINEST))
    n, keys = 1 << level, []
    for face in range(6):
        sign = 1 if face < 3 else -1
        k, a, b = (int(x) for x in _FACES[face % 3])
        ends = []
        for along, other in ((a, b), (b, a)):  # the angle about the axis `other`, as a longitude about a pole
            tilt = abs(np.arcsin(np.clip(c[other], -1, 1)))
            half = np.pi if tilt + r >= np.pi / 2 else np.arcsin(min(1.0, np.sin(r) / np.cos(tilt)))
            at = np.arctan2(c[along], sign * c[k])
            # the part on the face's quarter, in each turn; all of it if there is one in several
            parts = [(max(at - half + t, -np.pi / 4), min(at + half + t, np.pi / 4)) for t in (-2 * np.pi, 0.0, 2 * np.pi)]
            parts = [x for x in parts if x[0] <= x[1]] if half < np.pi else [(-np.pi / 4, np.pi / 4)]
            ends.append(parts[0] if len(parts) == 1 else (-np.pi / 4, np.pi / 4) if parts else (1.0, 0.0))
        if all(low <= high for low, high in ends):
            (u0, u1), (v0, v1) = (tuple(int(np.clip(np.floor((x + np.pi / 4) / (np.pi / 2) * n + d), 0, n - 1)) for x, d in zip(e, (-1e-9, 1e-9), strict=True)) for e in ends)
            keys += [(face * n + u) * n + v for u in range(u0, u1 + 1) for v in range(v0, v1 + 1)]
    return level, keys


def ancestor(key: int, level: int, coarser: int) -> int:
    n, m, s = 1 << level, 1 << coarser, level - coarser
    face, u, v = key // (n * n), key // n % n, key % n
    return (face * m + (u >> s)) * m + (v >> s)


def clip(s: np.ndarray, n: np.ndarray, w: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of polygons s (pairs, corners, 3; the first n count) within convex w (the first m count), both turning left."""
    pairs = np.arange(len(s))
    for e in range(w.shape[1]):
        side = w[:, e], w[pairs, (e + 1) % np.maximum(m, 1)]
        d = np.einsum("pvc,pc->pv", s, np.cross(*side))
        d[np.abs(d) < 1e-15] = 0.0
        there = np.arange(s.shape[1]) < n[:, None]
        after = np.where(np.arange(s.shape[1]) + 1 < n[:, None], np.arange(s.shape[1]) + 1, 0)
        q, f = np.take_along_axis(s, after[..., None], 1), np.take_along_axis(d, after, 1)
        use = (e < m)[:, None]
        keep = there & ((d >= 0) | ~use)
        cross = there & use & (((d > 0) & (f < 0)) | ((d < 0) & (f > 0)))
        t = np.where(cross, d / np.where(cross, d - f, 1), 0)[..., None]
        mid = s + (q - s) * t
        mid = mid / np.maximum(np.linalg.norm(mid, axis=2, keepdims=True), 1e-300)
        count = keep.astype(int) + cross
        at = np.cumsum(count, 1) - count
        n = count.sum(1)
        out = np.zeros((len(s), max(int(n.max(initial=0)), 1), 3))
        i, k = np.nonzero(keep)
        out[i, at[i, k]] = s[i, k]
        i, k = np.nonzero(cross)
        out[i, at[i, k] + keep[i, k]] = mid[i, k]
        s = out
    return s, n


def areas(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Areas on the unit sphere of polygons (pairs, corners, 3), by triangles from the first corner."""
    total = np.zeros(len(s))
    for k in range(1, s.shape[1] - 1):
        a, b, c = s[:, 0], s[:, k], s[:, k + 1]
        dot = lambda x, y: np.einsum("pc,pc->p", x, y)
        total += np.where(k + 1 < n, 2 * np.arctan2(dot(a, np.cross(b, c)), 1 + dot(a, b) + dot(b, c) + dot(c, a)), 0)
    return np.abs(total)


def _keyed(cells: DataFrame, name: str, pieces: int) -> DataFrame:
    """(name, p, level, keys): corners as bytes, and the covering keys."""
    kind = dict(cells.dtypes)[name]

    def run(frames):
        for f in frames:
            made = [corners(a, b, pieces) for a, b in zip(f["lons"], f["lats"], strict=True)]
            keep = [k for k, p in enumerate(made) if p is not None]
            cover = [covering(made[k]) for k in keep]
            yield pd.DataFrame({name: f[name].iloc[keep].to_numpy(), "p": [made[k].tobytes() for k in keep], "level": [c[0] for c in cover], "keys": [c[1] for c in cover]})

    return cells.select(name, "lons", "lats").mapInPandas(run, f"{name} {kind}, p binary, level int, keys array<long>")


def overlaps(targets: DataFrame, sources: DataFrame, pieces: int = 1, least: float = 1e-15) -> DataFrame:
    """(dst, src, w): areas on the unit sphere that targets (dst, lons, lats) and sources (src, lons, lats) share."""
    t, s = _keyed(targets, "dst", pieces), _keyed(sources, "src", pieces)
    levels = [sorted(r["level"] for r in df.select("level").distinct().collect()) for df in (t, s)]  # at most FINEST + 1 each

    def by_levels(df: DataFrame, others: list[int], name: str) -> DataFrame:
        """A row for each key at the own level, and at the other side's coarser ones."""
        low = "(shiftleft(1L, level) - 1)"
        up = f"shiftleft(shiftleft(shiftright(k, 2 * level), at) + shiftright(shiftright(k, level) & {low}, level - at), at) + shiftright(k & {low}, level - at)"
        at = F.array_distinct(F.concat(F.array("level"), F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x < F.col("level"))))
        wide = df.withColumn("at", F.explode(at)).withColumn("all", F.array_sort(F.array_distinct(F.expr(f"transform(keys, k -> {up})"))))
        return wide.select(name, F.col("p").alias(f"p_{name}"), F.col("level").alias(f"level_{name}"), "at", F.col("all").alias(f"all_{name}"), F.explode("all").alias("key"))

    both = by_levels(t, levels[1], "dst").join(by_levels(s, levels[0], "src"), ["at", "key"])
    both = both.where(F.col("at") == F.least("level_dst", "level_src")).where(F.col("key") == F.array_min(F.array_intersect("all_dst", "all_src")))
    kinds = [dict(df.dtypes)[c] for df, c in ((targets, "dst"), (sources, "src"))]

    def shared(frames):
        for f in frames:
            for lo in range(0, len(f), BATCH):
                g = f.iloc[lo : lo + BATCH]

                def padded(column):
                    v = [np.frombuffer(b).reshape(-1, 3) for b in column]
                    n = np.array([len(x) for x in v])
                    out = np.zeros((len(v), n.max(), 3))
                    for k, x in enumerate(v):
                        out[k, : len(x)] = x
                    return out, n

                area = areas(*clip(*padded(g["p_src"]), *padded(g["p_dst"])))
                hit = area > least
                yield pd.DataFrame({"dst": g["dst"].to_numpy()[hit], "src": g["src"].to_numpy()[hit], "w": area[hit]})

    return both.select("dst", "src", "p_dst", "p_src").mapInPandas(shared, f"dst {kinds[0]}, src {kinds[1]}, w double")
