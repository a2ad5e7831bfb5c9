"""Distances, quadrants, rotations, projections and polygons.

What has a closed form is a column expression; what iterates (ellipsoidal geodesics, inverse
ellipsoidal projections, clipping) is numpy over whole Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwake.model import CoordSystem, Planet, planet


def cartesian_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def spherical_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, a: float = planet().a) -> Column:
    """Law of cosines on a sphere of radius a."""
    c = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon1 - lon2))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))) * a


def sphere_embed(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """The unit vector."""
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def chord(degrees: Column) -> Column:
    """Length of the unit sphere's chord over an angle."""
    return 2 * F.sin(F.radians(degrees) / 2)


def lon_difference(lon1: Column, lon2: Column) -> Column:
    """lon2 - lon1 within -180..180."""
    return F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180


def quadrant_latlon(lon: Column, lat: Column, lonn: Column, latn: Column) -> Column:
    """Of a neighbour: 1 NE, 2 NW, 3 SW, 4 SE; on the meridian it is west (2, 3), on the parallel south (3, 4)."""
    d = lon_difference(lon, lonn)
    return F.when((d > 0) & (latn > lat), 1).when((d <= 0) & (latn > lat), 2).when((d <= 0) & (latn <= lat), 3).otherwise(4)


def rotate_pole(lon: Column, lat: Column, pole_lon: float, pole_lat: float) -> tuple[Column, Column]:
    """Longitude and latitude in a system whose north pole is at (pole_lon, pole_lat)."""
    x, y, z = sphere_embed(lon, lat)
    p, q = math.radians(pole_lon), math.radians(90.0 - pole_lat)
    u, v = x * math.cos(p) + y * math.sin(p), y * math.cos(p) - x * math.sin(p)
    w, s = u * math.cos(q) - z * math.sin(q), u * math.sin(q) + z * math.cos(q)
    return F.degrees(F.atan2(v, w)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))


def unrotate_pole(lon: Column, lat: Column, pole_lon: float, pole_lat: float) -> tuple[Column, Column]:
    """The way back of rotate_pole()."""
    w, v, s = sphere_embed(lon, lat)
    p, q = math.radians(pole_lon), math.radians(90.0 - pole_lat)
    u, z = w * math.cos(q) + s * math.sin(q), s * math.cos(q) - w * math.sin(q)
    x, y = u * math.cos(p) - v * math.sin(p), u * math.sin(p) + v * math.cos(p)
    return F.degrees(F.atan2(y, x)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


# --- azimuthal projections of the sphere -------------------------------------------------------


def optimal_alpha(area: float, a: float) -> float:
    """The angle (degrees) of the standard circle that suits a region of some area best."""
    return math.degrees(math.asin(min(1.0, math.sqrt(area / (2 * math.pi)) / a)))


def polar_alpha(lat: float) -> float:
    """Polar stereographic grids take the angle of their standard latitude."""
    return max(90.0 - abs(lat), 1e-4)


def stereographic(lon: Column, lat: Column, lon0: float, lat0: float, alpha: float, radius: float) -> tuple[Column, Column]:
    """Oblique stereographic, true at the angle alpha (degrees) from its centre."""
    l, p = F.radians(lon - lon0), F.radians(lat)
    s0, c0 = math.sin(math.radians(lat0)), math.cos(math.radians(lat0))
    t = (1 + math.cos(math.radians(alpha))) / (1 + F.cos(p) * c0 * F.cos(l) + F.sin(p) * s0)
    return radius * F.cos(p) * F.sin(l) * t, radius * (F.sin(p) * c0 - F.cos(p) * s0 * F.cos(l)) * t


def inverse_stereographic(x: Column, y: Column, lon0: float, lat0: float, alpha: float, radius: float) -> tuple[Column, Column]:
    rho = F.hypot(x, y)
    c = 2 * F.atan(rho / (radius * (1 + math.cos(math.radians(alpha)))))
    return _inverse_azimuthal(x, y, rho, c, lon0, lat0)


def equal_area(lon: Column, lat: Column, lon0: float, lat0: float, radius: float) -> tuple[Column, Column]:
    """Lambert's azimuthal equal-area projection."""
    l, p = F.radians(lon - lon0), F.radians(lat)
    s0, c0 = math.sin(math.radians(lat0)), math.cos(math.radians(lat0))
    t = F.sqrt(2 / (1 + F.cos(p) * c0 * F.cos(l) + F.sin(p) * s0))
    return radius * F.cos(p) * F.sin(l) * t, radius * (F.sin(p) * c0 - F.cos(p) * s0 * F.cos(l)) * t


def inverse_equal_area(x: Column, y: Column, lon0: float, lat0: float, radius: float) -> tuple[Column, Column]:
    rho = F.hypot(x, y)
    return _inverse_azimuthal(x, y, rho, 2 * F.asin(F.least(F.lit(1.0), rho / (2 * radius))), lon0, lat0)


def _inverse_azimuthal(x, y, rho, c, lon0: float, lat0: float) -> tuple[Column, Column]:
    s0, c0 = math.sin(math.radians(lat0)), math.cos(math.radians(lat0))
    at_centre = rho == 0
    sine = F.cos(c) * s0 + F.when(at_centre, 0.0).otherwise(y * F.sin(c) / rho) * c0
    lon = F.lit(lon0) + F.degrees(F.atan2(x * F.sin(c), rho * c0 * F.cos(c) - y * s0 * F.sin(c)))
    lon = F.when(at_centre, F.lit(lon0)).otherwise(lon)
    return F.pmod(lon + 180, F.lit(360.0)) - 180, F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine))))


# --- projections of the ellipsoid (Snyder 1987), numpy -----------------------------------------


def conformal_latitude(lat: np.ndarray, e: float) -> np.ndarray:
    s = e * np.sin(lat)
    return 2 * np.arctan(np.tan(np.pi / 4 + lat / 2) * ((1 - s) / (1 + s)) ** (e / 2)) - np.pi / 2


def _from_conformal(chi: np.ndarray, e: float) -> np.ndarray:
    lat = chi.copy()
    for _ in range(12):
        s = e * np.sin(lat)
        lat = 2 * np.arctan(np.tan(np.pi / 4 + chi / 2) * ((1 + s) / (1 - s)) ** (e / 2)) - np.pi / 2
    return lat


def _authalic_q(sine: np.ndarray, e: float) -> np.ndarray:
    return (1 - e * e) * (sine / (1 - (e * sine) ** 2) - np.log((1 - e * sine) / (1 + e * sine)) / (2 * e))


def _from_authalic(q: np.ndarray, e: float) -> np.ndarray:
    lat = np.arcsin(np.clip(q / 2, -1, 1))
    for _ in range(12):
        s = np.sin(lat)
        f = 1 - (e * s) ** 2
        step = f * f / (2 * np.maximum(np.cos(lat), 1e-12)) * (q / (1 - e * e) - s / f + np.log((1 - e * s) / (1 + e * s)) / (2 * e))
        lat = np.clip(lat + step, -np.pi / 2, np.pi / 2)
    return lat


def ellipsoid_project(kind: str, u, v, lon0: float, lat0: float, alpha: float = 0.0, body: Planet | None = None, inverse: bool = False):
    """Snyder's ellipsoidal forms over numpy arrays: degrees to metres, or back with inverse=True.

    kind: stereographic (oblique), polar_stereographic (true at lat0's circle 90 - alpha), equal_area.
    """
    body = body or planet()
    a, e = body.a, body.e
    u, v = np.asarray(u, float), np.asarray(v, float)
    l0, p0 = math.radians(lon0), math.radians(lat0)
    if kind == "polar_stereographic":
        sign = 1.0 if lat0 >= 0 else -1.0
        pc = math.radians(90.0 - alpha)
        t_of = lambda p: np.tan(np.pi / 4 - p / 2) / ((1 - e * np.sin(p)) / (1 + e * np.sin(p))) ** (e / 2)
        scale = math.cos(pc) / math.sqrt(1 - (e * math.sin(pc)) ** 2) / t_of(pc) if abs(pc - math.pi / 2) > 1e-9 else 2 / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
        if not inverse:
            l, p = np.radians(u) - l0, sign * np.radians(v)
            rho = a * scale * t_of(p)
            return rho * np.sin(l), -sign * rho * np.cos(l)
        rho = np.hypot(u, v)
        chi = np.pi / 2 - 2 * np.arctan(rho / (a * scale))
        lon = l0 + np.arctan2(u, -sign * v)
        return (np.degrees(lon) + 180) % 360 - 180, sign * np.degrees(_from_conformal(chi, e))
    if kind == "stereographic":
        x0 = conformal_latitude(np.array(p0), e)
        m0 = math.cos(p0) / math.sqrt(1 - (e * math.sin(p0)) ** 2)
        k0 = (1 + math.cos(math.radians(alpha))) / 2
        if not inverse:
            l, chi = np.radians(u) - l0, conformal_latitude(np.radians(v), e)
            big = 2 * a * k0 * m0 / (np.cos(x0) * (1 + np.sin(x0) * np.sin(chi) + np.cos(x0) * np.cos(chi) * np.cos(l)))
            return big * np.cos(chi) * np.sin(l), big * (np.cos(x0) * np.sin(chi) - np.sin(x0) * np.cos(chi) * np.cos(l))
        rho = np.hypot(u, v)
        c = 2 * np.arctan2(rho * np.cos(x0), 2 * a * k0 * m0)
        safe = np.where(rho == 0, 1, rho)
        chi = np.arcsin(np.clip(np.cos(c) * np.sin(x0) + v * np.sin(c) * np.cos(x0) / safe, -1, 1))
        lon = l0 + np.arctan2(u * np.sin(c), rho * np.cos(x0) * np.cos(c) - v * np.sin(x0) * np.sin(c))
        return (np.degrees(np.where(rho == 0, l0, lon)) + 180) % 360 - 180, np.degrees(_from_conformal(np.where(rho == 0, x0, chi), e))
    if kind == "equal_area":
        qp = float(_authalic_q(np.array(1.0), e))
        b0 = math.asin(float(_authalic_q(np.array(math.sin(p0)), e)) / qp)
        rq = a * math.sqrt(qp / 2)
        d = a * math.cos(p0) / math.sqrt(1 - (e * math.sin(p0)) ** 2) / (rq * math.cos(b0))
        if not inverse:
            l, b = np.radians(u) - l0, np.arcsin(np.clip(_authalic_q(np.sin(np.radians(v)), e) / qp, -1, 1))
            big = rq * np.sqrt(2 / (1 + math.sin(b0) * np.sin(b) + math.cos(b0) * np.cos(b) * np.cos(l)))
            return big * d * np.cos(b) * np.sin(l), big / d * (math.cos(b0) * np.sin(b) - math.sin(b0) * np.cos(b) * np.cos(l))
        rho = np.hypot(u / d, v * d)
        c = 2 * np.arcsin(np.clip(rho / (2 * rq), -1, 1))
        safe = np.where(rho == 0, 1, rho)
        q = qp * (np.cos(c) * math.sin(b0) + d * v * np.sin(c) * math.cos(b0) / safe)
        lon = l0 + np.arctan2(u * np.sin(c), d * rho * math.cos(b0) * np.cos(c) - d * d * v * math.sin(b0) * np.sin(c))
        return (np.degrees(np.where(rho == 0, l0, lon)) + 180) % 360 - 180, np.degrees(np.where(rho == 0, p0, _from_authalic(q, e)))
    raise ValueError(f"unknown projection {kind!r}")


def _sphere_azimuthal(kind: str, u, v, lon0: float, lat0: float, alpha: float, radius: float, inverse: bool):
    """Stereographic and equal-area azimuthal projections of the sphere over numpy arrays, as the column forms above."""
    s0, c0 = math.sin(math.radians(lat0)), math.cos(math.radians(lat0))
    k = 1 + math.cos(math.radians(alpha))
    if not inverse:
        l, p = np.radians(u - lon0), np.radians(v)
        near = np.maximum(1 + np.cos(p) * c0 * np.cos(l) + np.sin(p) * s0, 1e-300)
        t = radius * (k / near if kind == "stereographic" else np.sqrt(2 / near))
        return np.cos(p) * np.sin(l) * t, (np.sin(p) * c0 - np.cos(p) * s0 * np.cos(l)) * t
    rho = np.hypot(u, v)
    c = 2 * np.arctan(rho / (radius * k)) if kind == "stereographic" else 2 * np.arcsin(np.minimum(1, rho / (2 * radius)))
    safe = np.where(rho == 0, 1, rho)
    lat = np.arcsin(np.clip(np.cos(c) * s0 + v * np.sin(c) * c0 / safe, -1, 1))
    lon = np.where(rho == 0, lon0, lon0 + np.degrees(np.arctan2(u * np.sin(c), rho * c0 * np.cos(c) - v * s0 * np.sin(c))))
    return (lon + 180) % 360 - 180, np.where(rho == 0, lat0, np.degrees(lat))


def _turned(lon, lat, pole_lon: float, pole_lat: float, back: bool):
    """rotate_pole() and unrotate_pole() over numpy arrays."""
    l, p = np.radians(lon), np.radians(lat)
    x = np.stack([np.cos(p) * np.cos(l), np.cos(p) * np.sin(l), np.sin(p)])
    a, b = math.radians(pole_lon), math.radians(90.0 - pole_lat)
    about_z = np.array([[math.cos(a), math.sin(a), 0], [-math.sin(a), math.cos(a), 0], [0, 0, 1]])
    about_y = np.array([[math.cos(b), 0, -math.sin(b)], [0, 1, 0], [math.sin(b), 0, math.cos(b)]])
    m = about_y @ about_z
    x = np.tensordot(m.T if back else m, x, 1)
    return np.degrees(np.arctan2(x[1], x[0])), np.degrees(np.arcsin(np.clip(x[2], -1, 1)))


_AZIMUTHAL = {"stereographic": "stereographic", "polar_stereographic": "stereographic", "lambert_azimuthal_equal_area": "equal_area"}


def to_system(system: CoordSystem, u, v, inverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes to a system's own coordinates, in its units; back with inverse=True."""
    u, v = np.asarray(u, float), np.asarray(v, float)
    if system.mtype == "rotated_pole":
        return _turned(u, v, system.lon, system.lat, inverse)
    if not system.is_cartesian:
        return u, v
    if system.mtype not in _AZIMUTHAL:
        raise ValueError(f"{system.mtype!r} coordinates have no place on the globe")
    kind, m = _AZIMUTHAL[system.mtype], system.metres
    at = (u * m, v * m) if inverse else (u, v)
    if system.planet.f == 0:
        out = _sphere_azimuthal(kind, *at, system.lon, system.lat, system.alpha, system.planet.a, inverse)
    else:
        kind = "polar_stereographic" if system.mtype == "polar_stereographic" or kind == "stereographic" and abs(system.lat) == 90 else kind
        out = ellipsoid_project(kind, *at, system.lon, system.lat, system.alpha, system.planet, inverse)
    return out if inverse else (out[0] / m, out[1] / m)


# --- geodesics (Vincenty 1975; by bisection near the antipode), numpy ----------------------------


def _series(u):
    """Vincenty's A and B."""
    return 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))


def _antipodal(lon12, lat1, lat2, body: Planet):
    """As geodesic_inverse(), for a difference of longitudes within -180..180, by the azimuth at which it is reached.

    The points are mirrored and swapped so that the first is in the south and the farther from the equator; then the
    longitude that a geodesic has gained where it next comes to the second latitude, northward, grows with its azimuth.
    """
    west, l = lon12 < 0, np.radians(np.abs(lon12))
    swap = np.abs(lat1) < np.abs(lat2)
    p1, p2 = np.where(swap, lat2, lat1), np.where(swap, lat1, lat2)
    north = p1 > 0
    p1, p2 = np.where(north, -p1, p1), np.where(north, -p2, p2)
    u1, u2 = (np.arctan((1 - body.f) * np.tan(np.radians(p))) for p in (p1, p2))
    s1, c1, s2, c2 = -np.abs(np.sin(u1)), np.maximum(np.cos(u1), 1e-15), np.sin(u2), np.maximum(np.cos(u2), 1e-15)
    s1 = np.where(s1 == 0, -0.0, s1)

    def along(az):
        sa, ca = np.sin(az), np.cos(az)
        s0 = sa * c1
        sa2, ca2 = s0 / c2, np.sqrt(np.maximum((ca * c1) ** 2 + (c2 - c1) * (c2 + c1), 0)) / c2
        g1, g2 = np.arctan2(s1, ca * c1), np.arctan2(s2, ca2 * c2)
        o1, o2 = np.arctan2(s0 * s1, ca * c1), np.arctan2(s0 * s2, ca2 * c2)
        g = np.where(g2 - g1 < 0, 0, g2 - g1)
        o = (o2 - o1) % (2 * np.pi)
        k2 = np.maximum(1 - s0 * s0, 0)
        c = body.f / 16 * k2 * (4 + body.f * (4 - 3 * k2))
        cm = np.cos(g1 + g2)
        gained = o - (1 - c) * body.f * s0 * (g + c * np.sin(g) * (cm + c * np.cos(g) * (2 * cm * cm - 1)))
        return gained, g, cm, k2, sa, ca, sa2, ca2

    lo, hi = np.zeros(l.shape), np.full(l.shape, np.pi)
    for _ in range(64):
        mid = (lo + hi) / 2
        less = along(mid)[0] < l
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    _, g, cm, k2, sa, ca, sa2, ca2 = along(hi)
    big_a, big_b = _series(k2 * (body.a**2 - body.b**2) / body.b**2)
    sg, cg = np.sin(g), np.cos(g)
    d = big_b * sg * (cm + big_b / 4 * (cg * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * sg * sg - 3) * (4 * cm * cm - 3)))
    # back to the points as given: mirrored azimuths in the north, turned round where the ends were swapped
    ca, ca2 = np.where(north, -ca, ca), np.where(north, -ca2, ca2)
    first, second = (np.where(swap, sa2, sa), np.where(swap, -ca2, ca)), (np.where(swap, sa, sa2), np.where(swap, -ca, ca2))
    az1, az2 = (np.degrees(np.arctan2(np.where(west, -s, s), c)) for s, c in (first, second))
    return body.b * big_a * (g - d), az1, az2


def geodesic_inverse(lon1, lat1, lon2, lat2, body: Planet | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance in metres, and azimuths (degrees) at both ends."""
    body = body or planet()
    lon1, lat1, lon2, lat2 = (np.atleast_1d(np.asarray(v, float)) for v in (lon1, lat1, lon2, lat2))
    l = np.radians((lon2 - lon1 + 180) % 360 - 180)
    u1, u2 = (np.arctan((1 - body.f) * np.tan(np.radians(p))) for p in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = l.copy()
    for _ in range(200):
        sl, cl = np.sin(lam), np.cos(lam)
        ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cs = s1 * s2 + c1 * c2 * cl
        sigma = np.arctan2(ss, cs)
        sa = np.where(ss == 0, 0, c1 * c2 * sl / np.where(ss == 0, 1, ss))
        ca2 = 1 - sa * sa
        cm = np.where(ca2 > 1e-14, cs - 2 * s1 * s2 / np.where(ca2 > 1e-14, ca2, 1), 0)
        c = body.f / 16 * ca2 * (4 + body.f * (4 - 3 * ca2))
        new = l + (1 - c) * body.f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
        done = np.abs(new - lam) < 1e-13
        lam = np.clip(new, -np.pi, np.pi)
        if done.all():
            break
    u = ca2 * (body.a**2 - body.b**2) / body.b**2
    big_a, big_b = _series(u)
    d = big_b * ss * (cm + big_b / 4 * (cs * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    az1 = np.degrees(np.arctan2(c2 * sl, c1 * s2 - s1 * c2 * cl))
    az2 = np.degrees(np.arctan2(c1 * sl, c1 * s2 * cl - s1 * c2))
    out = body.b * big_a * (sigma - d), az1, az2
    on_equator = (u1 == 0) & (u2 == 0) & (np.abs(l) <= math.pi * (1 - body.f))
    far = np.flatnonzero((~done | (np.abs(l) > math.radians(170))) & ~on_equator)
    if len(far) and body.f:
        l, lat1, lat2 = (np.broadcast_to(v, out[0].shape)[far] for v in (np.degrees(l), lat1, lat2))
        for old, new in zip(out, _antipodal(l, lat1, lat2, body), strict=True):
            old[far] = new
    return out


def geodesic_direct(lon1, lat1, azimuth, distance, body: Planet | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longitude, latitude and azimuth after a distance."""
    body = body or planet()
    lon1, lat1, azimuth, s = (np.atleast_1d(np.asarray(v, float)) for v in (lon1, lat1, azimuth, distance))
    a1 = np.radians(azimuth)
    u1 = np.arctan((1 - body.f) * np.tan(np.radians(lat1)))
    s1, c1 = np.sin(u1), np.cos(u1)
    sigma1 = np.arctan2(np.tan(u1), np.cos(a1))
    sa = c1 * np.sin(a1)
    ca2 = 1 - sa * sa
    u = ca2 * (body.a**2 - body.b**2) / body.b**2
    big_a, big_b = _series(u)
    sigma = s / (body.b * big_a)
    for _ in range(100):
        cm, ss, cs = np.cos(2 * sigma1 + sigma), np.sin(sigma), np.cos(sigma)
        d = big_b * ss * (cm + big_b / 4 * (cs * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        new = s / (body.b * big_a) + d
        done = np.abs(new - sigma) < 1e-13
        sigma = new
        if done.all():
            break
    ss, cs, cm = np.sin(sigma), np.cos(sigma), np.cos(2 * sigma1 + sigma)
    lat = np.arctan2(s1 * cs + c1 * ss * np.cos(a1), (1 - body.f) * np.hypot(sa, s1 * ss - c1 * cs * np.cos(a1)))
    lam = np.arctan2(ss * np.sin(a1), c1 * cs - s1 * ss * np.cos(a1))
    c = body.f / 16 * ca2 * (4 + body.f * (4 - 3 * ca2))
    l = lam - (1 - c) * body.f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
    return (lon1 + np.degrees(l) + 180) % 360 - 180, np.degrees(lat), np.degrees(np.arctan2(sa, c1 * cs * np.cos(a1) - s1 * ss))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(12)


def geodesic_area(lon, lat, body: Planet | None = None) -> float:
    """Area (m2) of a polygon whose sides are geodesics, whichever way it turns; a pole may be a corner, but not inside.

    The area between a side and the equator is integrated along the side by Gauss-Legendre quadrature; a side between
    two longitudes of a pole has no length, but all of the zone under it.
    """
    body = body or planet()
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    lon2, lat2 = np.roll(lon, -1), np.roll(lat, -1)
    dist, az, _ = geodesic_inverse(lon, lat, lon2, lat2, body)
    at = (dist[:, None] * (_NODES + 1) / 2).ravel()
    rep = len(_NODES)
    _, p, z = geodesic_direct(np.repeat(lon, rep), np.repeat(lat, rep), np.repeat(az, rep), at, body)
    s = np.sin(np.radians(p))
    e = body.e
    zone = lambda s: body.a**2 / 2 * (2 * s if e == 0 else _authalic_q(s, e))
    prime = body.a / np.sqrt(1 - (e * s) ** 2)
    rate = np.sin(np.radians(z)) / (prime * np.maximum(np.cos(np.radians(p)), 1e-12))
    sides = ((zone(s) * rate).reshape(-1, rep) * _WEIGHTS).sum(1) * (dist / 2)
    at_pole = (np.abs(lat) > 90 - 1e-9) & (np.abs(lat2) > 90 - 1e-9)
    turn = np.radians((lon2 - lon + 180) % 360 - 180)
    to_pole = ~at_pole & ((np.abs(lat) > 90 - 1e-9) | (np.abs(lat2) > 90 - 1e-9))  # along a meridian
    return float(abs(np.where(at_pole, zone(np.sign(lat)) * turn, np.where(to_pole, 0.0, sides)).sum()))


def planet_distance(body: Planet | None = None):
    """A vectorized column function of (lon1, lat1, lon2, lat2) in degrees: geodesic metres."""

    @F.pandas_udf("double")
    def distance(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
        return pd.Series(geodesic_inverse(lon1, lat1, lon2, lat2, body)[0], index=lon1.index)

    return distance


# --- polygons ---------------------------------------------------------------------------------


def signed_area(xs: str, ys: str) -> Column:
    """Shoelace area over array columns of vertices; positive if they turn left."""
    return F.expr(f"aggregate(sequence(0, size({xs}) - 1), cast(0 as double), (s, i) -> s + ({xs}[i] * {ys}[(i + 1) % size({xs})] - {xs}[(i + 1) % size({xs})] * {ys}[i]) / 2)")


def polygon_area(xs: str, ys: str) -> Column:
    return F.abs(signed_area(xs, ys))


def point_in_polygon(x: str, y: str, xs: str, ys: str) -> Column:
    """Ray casting: whether the sides that a ray to the right crosses are odd in number."""
    j = f"(i + 1) % size({xs})"
    return F.expr(f"aggregate(sequence(0, size({xs}) - 1), false, (s, i) -> if(({ys}[i] > {y}) != ({ys}[{j}] > {y}) and {x} < ({xs}[{j}] - {xs}[i]) * ({y} - {ys}[i]) / ({ys}[{j}] - {ys}[i]) + {xs}[i], not s, s))")


def clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a polygon (n, 2) inside a convex one (Sutherland and Hodgman 1974); empty if none."""
    out = np.asarray(subject, float)
    window = np.asarray(window, float)
    if np.sum(window[:, 0] * np.roll(window[:, 1], -1) - np.roll(window[:, 0], -1) * window[:, 1]) < 0:
        window = window[::-1]
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        if not len(out):
            break
        d = b - a
        side = d[0] * (out[:, 1] - a[1]) - d[1] * (out[:, 0] - a[0])
        out = _cut(out, side)
    return out


def clip_sphere(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """As clip() for polygons of unit vectors (n, 3) whose sides are great circles; window turns left."""
    out = np.asarray(subject, float)
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        if not len(out):
            break
        out = _cut(out, out @ np.cross(a, b))
        if len(out):
            out = out / np.linalg.norm(out, axis=1, keepdims=True)
    return out


def _cut(points: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Points on the kept side (>= 0), with the crossings in between."""
    kept = []
    for p, q, s, t in zip(points, np.roll(points, -1, axis=0), side, np.roll(side, -1), strict=True):
        if s >= 0:
            kept.append(p)
        if (s > 0 > t) or (s < 0 < t):
            kept.append(p + (q - p) * (s / (s - t)))
    return np.array(kept).reshape(-1, points.shape[1])


def plane_area(p: np.ndarray) -> float:
    return float(abs(np.sum(p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1])) / 2) if len(p) > 2 else 0.0


def sphere_area(p: np.ndarray) -> float:
    """Area on the unit sphere of a polygon of unit vectors, by triangles from its first point."""
    total = 0.0
    for i in range(1, len(p) - 1):
        a, b, c = p[0], p[i], p[i + 1]
        total += 2 * math.atan2(float(a @ np.cross(b, c)), 1 + float(a @ b) + float(b @ c) + float(c @ a))
    return abs(total)


def gaussian_latitudes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n Gaussian latitudes from north to south, and weights that add up to 2."""
    x, w = np.polynomial.legendre.leggauss(n)
    return np.degrees(np.arcsin(x))[::-1], w[::-1]
