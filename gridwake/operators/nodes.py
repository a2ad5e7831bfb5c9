"""Values between staggered nodes of a grid, and at quadrature points of its cells.

A cell has its centre (aa), its right and upper side (acx, acy) and its upper right corner (ab); in three
dimensions also its top (acz). Every operator is a mean over a few neighbours, so it is a linear combination
of lag/lead columns: two window passes, one along each axis.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.operators.stencil import quadrature_nodes

UNDERFLOW = 1e-15


def shifted(df: DataFrame, value: str, along: str, by: int, name: str, keys: list[str], axes: tuple[str, ...], wrap: bool) -> DataFrame:
    """df with the value of the cell `by` further along an axis; at the ends NULL, or the other end's."""
    w = Window.partitionBy(*keys, *[a for a in axes if a != along]).orderBy(along)
    v = F.lead(value, by).over(w) if by > 0 else F.lag(value, -by).over(w)
    if wrap:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        there = F.lead(F.lit(1), by).over(w) if by > 0 else F.lag(F.lit(1), -by).over(w)
        v = F.when(there.isNull(), (F.first if by > 0 else F.last)(F.col(value)).over(whole)).otherwise(v)
    return df.withColumn(name, v)


def _name(value: str, offset: tuple[int, ...]) -> str:
    return f"_{value}_" + "_".join("m" if o < 0 else "p" if o > 0 else "0" for o in offset)


def neighbours(df: DataFrame, value: str, offsets, keys: list[str] | None = None, axes: tuple[str, ...] = ("i", "j"), wrap: bool = True) -> DataFrame:
    """df with a column for each offset (steps of -1, 0, 1 along each axis), named by _name()."""
    keys = keys or []
    made = {(0,) * len(axes): value}
    for offset in sorted(set(offsets), key=lambda o: sum(map(abs, o))):
        at: tuple[int, ...] = (0,) * len(axes)
        for k, step in enumerate(offset):
            if not step:
                continue
            to = (*at[:k], step, *at[k + 1 :])
            if to not in made:
                made[to] = _name(value, to)
                df = shifted(df, made[at], axes[k], step, made[to], keys, axes, wrap)
            at = to
        if offset not in made:
            made[offset] = value
    return df


def _at(value: str, offset: tuple[int, ...]) -> Column:
    return F.col(value if not any(offset) else _name(value, offset))


def mean_of(df: DataFrame, value: str, offsets, out: str, keys: list[str] | None = None, axes: tuple[str, ...] = ("i", "j"), wrap: bool = True, otherwise: float | None = None) -> DataFrame:
    """df with the mean over the offsets; where one lies outside (without wrapping) the column `otherwise`."""
    wide = neighbours(df, value, offsets, keys, axes, wrap)
    total = sum(_at(value, o) for o in offsets) / float(len(offsets))
    return wide.select(*df.columns, (total if otherwise is None else F.coalesce(total, F.lit(otherwise))).alias(out))


#: Neighbours whose mean a staggering takes; those of sides do not wrap, and leave 0 at the end.
_AA_AB = ((0, 0), (1, 0), (0, 1), (1, 1))
_AB_AA = ((0, 0), (-1, 0), (0, -1), (-1, -1))
_SIDES = {
    "aa_acx": ((0, 0), (1, 0)),
    "aa_acy": ((0, 0), (0, 1)),
    "acx_aa": ((-1, 0), (0, 0)),
    "acy_aa": ((0, -1), (0, 0)),
    "ab_acx": ((0, -1), (0, 0)),
    "ab_acy": ((-1, 0), (0, 0)),
}
STAGGERINGS = ("aa_ab", "ab_aa", *_SIDES)


def stagger(df: DataFrame, kind: str, keys: list[str] | None = None, value: str = "value", out: str = "staggered") -> DataFrame:
    """From one kind of nodes to another, such as aa_ab or acx_aa."""
    if kind in _SIDES:
        return mean_of(df, value, _SIDES[kind], out, keys, wrap=False, otherwise=0.0)
    if kind not in STAGGERINGS:
        raise ValueError(f"unknown staggering {kind!r}; known are {STAGGERINGS}")
    return mean_of(df, value, _AA_AB if kind == "aa_ab" else _AB_AA, out, keys)


def sides_to_centres(df: DataFrame, u: str = "u", v: str = "v", keys: list[str] | None = None, out: str = "staggered") -> DataFrame:
    """Mean of u on a cell's two vertical sides and v on its two horizontal ones."""
    wide = neighbours(neighbours(df, u, ((-1, 0),), keys), v, ((0, -1),), keys)
    return wide.select(*df.columns, ((F.col(u) + _at(u, (-1, 0)) + F.col(v) + _at(v, (0, -1))) / 4).alias(out))


def magnitude(df: DataFrame, u: str = "u", v: str = "v", cover: str = "cover", keys: list[str] | None = None, wrap: bool = True, out: str = "magnitude") -> DataFrame:
    """Size of the vector (u on acx, v on acy nodes) at the centres of cells wholly covered, 0 elsewhere."""
    wide = neighbours(neighbours(df, u, ((-1, 0),), keys, wrap=wrap), v, ((0, -1),), keys, wrap=wrap)
    tiny = lambda x: F.when(F.abs(x) < UNDERFLOW, 0.0).otherwise(x)
    before = lambda c, o: _at(c, o) if wrap else F.coalesce(_at(c, o), F.col(c))
    a, b = tiny((before(u, (-1, 0)) + F.col(u)) / 2), tiny((before(v, (0, -1)) + F.col(v)) / 2)
    return wide.select(*df.columns, F.when(F.col(cover) == 1.0, tiny(F.sqrt(a * a + b * b))).otherwise(0.0).alias(out))


def _chosen_mean(df: DataFrame, value: str, flag: str, offsets, keys, out: str) -> DataFrame:
    """Mean over the offsets whose flag holds, or over all of them if none does."""
    wide = neighbours(neighbours(df, value, offsets, keys), flag, offsets, keys)
    n = sum(_at(flag, o).cast("int") for o in offsets)
    chosen = sum(F.when(_at(flag, o), _at(value, o)).otherwise(0.0) for o in offsets) / n
    return wide.select(*df.columns, F.when(n > 0, chosen).otherwise(sum(_at(value, o) for o in offsets) / float(len(offsets))).alias(out))


def centres_to_corners_bare(df: DataFrame, value: str = "value", cover: str = "cover", keys: list[str] | None = None, out: str = "staggered") -> DataFrame:
    """aa to ab over the cells without cover, if a corner has any."""
    flagged = df.withColumn("_flag", F.col(cover) == 0.0)
    return _chosen_mean(flagged, value, "_flag", _AA_AB, keys, out).drop("_flag")


def corners_to_centres_thick(df: DataFrame, value: str = "value", thickness: str = "thickness", cover: str = "cover", keys: list[str] | None = None, out: str = "staggered") -> DataFrame:
    """ab to aa over the corners with thickness, if a cell has any."""
    thick = centres_to_corners_bare(df, thickness, cover, keys, "_thick").withColumn("_flag", F.col("_thick") > 0.0)
    return _chosen_mean(thick, value, "_flag", _AB_AA, keys, out).drop("_flag", "_thick")


# --- quadrature -------------------------------------------------------------------------------


def corner_offsets(kind: str, dims: int = 2) -> list[list[tuple[int, ...]]]:
    """For each corner of a cell (first axis fastest), the nodes of a kind around it.

    Nodes that lie on a corner along an axis are met at the step before and at the cell's own; others are
    averaged over the two steps around the corner.
    """
    axes = "xyz"[:dims]
    between = {"aa": axes, "ab": "", "acx": axes.replace("x", ""), "acy": axes.replace("y", ""), "acz": axes.replace("z", "")}
    if kind not in between or kind == "acz" and dims == 2:
        raise ValueError(f"no {kind!r} nodes in {dims} dimensions")
    out = []
    for corner in itertools.product((-1, 0), repeat=dims):
        corner = corner[::-1]
        out.append(list(itertools.product(*[(c, c + 1) if a in between[kind] else (c,) for a, c in zip(axes, corner, strict=True)])))
    return out


def to_quadrature(df: DataFrame, kind: str = "aa", dims: int = 2, keys: list[str] | None = None, value: str = "value", wrap: bool = True, axes: tuple[str, ...] = ("i", "j", "k")) -> DataFrame:
    """(node, at_node) of each cell: values of a kind of nodes at the points of the two-point Gauss rule.

    In three dimensions the cell lies between its level and the one below; acz nodes and corners stand on levels.
    """
    corners = corner_offsets(kind, dims)
    wide = neighbours(df, value, {o for c in corners for o in c}, keys, axes[:dims], wrap)
    names = [f"_c{n}" for n in range(len(corners))]
    wide = wide.select(*df.columns, *[(sum(_at(value, o) for o in c) / float(len(c))).alias(n) for n, c in zip(names, corners, strict=True)])
    return quadrature_nodes(wide, names).drop(*names)


def basis(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (point, node) and reference derivatives (axis, point, node) of the multilinear element at Gauss points."""
    ends = np.array(list(itertools.product((-1, 1), repeat=dims)))[:, ::-1]
    at = ends / math.sqrt(3)
    part = (1 + at[:, None, :] * ends[None]) / 2
    slope = [ends[None, :, a] / 2 * np.prod(np.delete(part, a, 2), 2) for a in range(dims)]
    return part.prod(2), np.stack(slope)


def basis_derivatives(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives (..., point, axis, node) in true coordinates, and determinants (..., point), for elements (..., node, axis)."""
    dims = nodes.shape[-1]
    reference = np.moveaxis(basis(dims)[1], 0, 1)  # point, axis, node
    jacobian = np.einsum("pan,...nb->...pab", reference, nodes)
    det = np.linalg.det(jacobian)
    if (det == 0).any():
        raise ValueError("an element is degenerate: its Jacobian has no inverse")
    return np.linalg.solve(jacobian, np.broadcast_to(reference, (*jacobian.shape[:-2], *reference.shape[1:]))), det


def element_derivatives(df: DataFrame, coordinates: list[str]) -> DataFrame:
    """df with (point, determinant, derivatives: array of arrays by axis): elements given by an array column for each axis."""
    dims = len(coordinates)

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            nodes = np.stack([np.stack(f[c].to_numpy()) for c in coordinates], -1).astype(float)
            d, det = basis_derivatives(nodes)
            points = d.shape[1]
            rows = f.loc[f.index.repeat(points)].reset_index(drop=True)
            rows["point"] = np.tile(np.arange(1, points + 1), len(f))
            rows["determinant"] = det.ravel()
            rows["derivatives"] = [[list(a) for a in p] for p in d.reshape(-1, dims, d.shape[-1])]
            yield pd.DataFrame(rows)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{kinds}, point int, determinant double, derivatives array<array<double>>")
