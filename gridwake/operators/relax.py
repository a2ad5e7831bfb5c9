"""Iterated operators on fields of any size: tiles that exchange halos.

A field (slice keys, i, j, value) is cut into tiles of at least TILE cells a side. A round sends each
tile the strips of its neighbours, wide enough for several sweeps, and sweeps tile and halo: what the
cut spoils moves inwards by the operator's reach a sweep and never leaves the halo, so that every cell
gets exactly what a sweep over the whole array gives. What steers an operator is a reduction over the
whole field after each sweep (the largest residual, the cells that are left). It is foretold for the
sweeps of a round, measured by them, and checked after: sweeps beyond the point where it turned out
otherwise are made again. Each slice has its own course. No group is larger than a tile and its halo,
and nothing but the number of slices that go on comes to the driver.

Missing is nan in arrays and NULL in tables; cells that a table does not have are missing, and are
filled on the way like others, but not returned (relaxation goes without them). The field reaches from the least to the largest i and
j of its slice. Fields smaller than an operator's box are handled by what there is of it. An empty table
gives no row, one without any value stays as it is, and of rows that repeat a cell one counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.operators.solvers import cut

TILE = 256


@dataclass
class Block:
    """A part of a field: rows and cols are places in the whole of `shape`, own is the part that counts, closed if its rows wrap."""

    z: np.ndarray
    rows: np.ndarray
    cols: np.ndarray
    shape: tuple[int, int]
    own: tuple[slice, slice] = (slice(None), slice(None))
    extra: list[np.ndarray] = field(default_factory=list)
    closed: bool = False

    def inside(self, r: int) -> np.ndarray:
        """Cells that are at least r away from every cell beyond the field's sides."""
        n, m = self.shape
        return np.outer((self.rows >= r) & (self.rows < n - r), (self.cols >= r) & (self.cols < m - r))

    def most(self, values: np.ndarray) -> float:
        return float(np.max(values[self.own], initial=-np.inf))

    def any(self, cells: np.ndarray) -> float:
        return float(cells[self.own].any())


def around(z: np.ndarray, r: int):
    """(a, b, z shifted by them) over the box of radius r, nan beyond the array."""
    p = np.pad(z, r, constant_values=np.nan)
    n, m = z.shape
    for a in range(-r, r + 1):
        for b in range(-r, r + 1):
            yield a, b, p[r + a : r + a + n, r + b : r + b + m]


class Relaxation:
    """One sweep of an operator, and its course: control(s) before, statistics (maxima over the field) after."""

    reach, most, first, width = 1, 100, 0.0, 2

    def sweep(self, block: Block, control: float) -> tuple[np.ndarray, list[float]]:
        raise NotImplementedError

    def follow(self, control: float, stats: list[float]) -> float | None:
        """The next sweep's control, None to stop."""
        raise NotImplementedError


class Weighted(Relaxation):
    """Holes by inverse distance over the box of radius r, those first that most quadrants of the box reach.

    Statistics: most quadrants of a hole, whether holes are left that are not next to the border zone.
    """

    most, first = 400, 4.0

    def __init__(self, r: int = 4):
        self.r = self.reach = r

    def sweep(self, block, control):
        z, hole = block.z, np.isnan(block.z) & block.inside(self.r)
        at = np.nonzero(hole)
        total, weight, quads = (np.zeros(s) for s in (len(at[0]), len(at[0]), (4, len(at[0]))))
        for a, b, s in around(z, self.r):
            v = s[at]
            there = ~np.isnan(v)
            w = 1 / max(0.1, math.hypot(a, b))
            total += w * np.where(there, v, 0)
            weight += w * there
            quads[(a >= 0) * 2 + (b >= 0)] += there  # the box's middle lines belong to the quadrants of larger i and j
        n = (quads > 0).sum(0)
        now = n >= max(control, 1)
        z, count = z.copy(), np.zeros(z.shape)
        z[at] = np.where(now, total / np.where(now, weight, 1), np.nan)
        count[at] = n
        return z, [block.most(count), block.any(np.isnan(z) & block.inside(self.r + 1))]

    def follow(self, control, stats):
        return stats[0] if stats[1] and stats[0] > 0 else None


class Nearest(Relaxation):
    """Holes that the mask (if any) holds by the nearest value in the box of radius r; of equal ones the first by j, then i.

    Statistics: whether a hole was filled, whether holes are left that are not next to the border zone.
    """

    def __init__(self, r: int = 4):
        self.r = self.reach = r

    def sweep(self, block, control):
        z, hole = block.z, np.isnan(block.z) & block.inside(self.r)
        if block.extra:
            hole &= block.extra[0] > 0
        at = np.nonzero(hole)
        best, value = np.full(len(at[0]), np.inf), np.full(len(at[0]), np.nan)
        for a, b, s in sorted(around(z, self.r), key=lambda x: (x[1], x[0])):
            v = s[at]
            nearer = ~np.isnan(v) & (max(0.1, math.hypot(a, b)) < best)
            best, value = np.where(nearer, math.hypot(a, b), best), np.where(nearer, v, value)
        z, new = z.copy(), np.zeros(z.shape, bool)
        z[at] = value
        new[at] = ~np.isnan(value)
        return z, [block.any(new), block.any(np.isnan(z) & block.inside(self.r + 1))]

    def follow(self, control, stats):
        return control if stats[0] and stats[1] else None


class BoxMean(Relaxation):
    """Missing cells of each 3 x 3 box take its mean; of the boxes over a cell, the last by i, then j, counts, an empty one too.

    Statistics: whether a cell was filled, whether any is left.
    """

    reach, most = 2, 50

    def sweep(self, block, control):
        total, count = np.zeros(block.z.shape), np.zeros(block.z.shape)
        for _, _, s in around(block.z, 1):
            there = ~np.isnan(s)
            total += np.where(there, s, 0)
            count += there
        mean = np.where(count > 0, total / np.maximum(count, 1), np.nan)
        centre = np.where(block.inside(1), 1.0, np.nan)
        filled = np.full(mean.shape, np.nan)
        for (_, _, s), (_, _, c) in zip(around(mean, 1), around(centre, 1), strict=True):  # by the place of the box's centre from the cell
            filled = np.where(np.isnan(c), filled, s)
        z = np.where(np.isnan(block.z), filled, block.z)
        return z, [block.any(np.isnan(block.z) & ~np.isnan(z)), block.any(np.isnan(z))]

    def follow(self, control, stats):
        return control if stats[0] and stats[1] else None


class Poisson(Relaxation):
    """Cells that the mask holds move half way to the mean of their four neighbours, as many as have a value.

    Beyond a side lies the mirror image of the field; rows may wrap. Statistics: the largest residual.
    The control is the residual at which to stop.
    """

    most, width = 1000, 1

    def sweep(self, block, control):
        z, (n, m) = block.z, block.shape
        p = np.pad(z, 1, constant_values=np.nan)
        if block.closed:
            p[0, 1:-1], p[-1, 1:-1] = z[-1], z[0]
        else:
            if block.rows[0] == 0 and n > 1:
                p[0, 1:-1] = z[1]
            if block.rows[-1] == n - 1 and n > 1:
                p[-1, 1:-1] = z[-2]
        if block.cols[0] == 0 and m > 1:
            p[1:-1, 0] = z[:, 1]
        if block.cols[-1] == m - 1 and m > 1:
            p[1:-1, -1] = z[:, -2]
        four = np.stack([p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        there = ~np.isnan(four)
        count = there.sum(0)
        free = (block.extra[0] > 0) & (count > 0) & ~np.isnan(z)
        residual = np.where(free, np.where(there, four, 0).sum(0) / np.maximum(count, 1) - z, 0.0)
        return np.where(free, z + 0.5 * residual, z), [block.most(np.abs(residual))]

    def follow(self, control, stats):
        return control if stats[0] > control else None


class Diffusion(Relaxation):
    """The mean of the 3 x 3 box inside, on a side the mean with the inner neighbour (sides along i last)."""

    width = 1

    def __init__(self, rounds: int):
        self.most = rounds

    def sweep(self, block, control):
        z, (n, m) = block.z, block.shape
        shifted = {(a, b): s for a, b, s in around(z, 1)}
        mean = lambda parts: np.where((c := np.sum([~np.isnan(s) for s in parts], 0)) > 0, np.sum([np.nan_to_num(s) for s in parts], 0) / np.maximum(c, 1), z)
        out = np.where(block.inside(1), mean(list(shifted.values())), z)
        for along, size, sides in ((block.cols, m, ((0, (0, 1)), (m - 1, (0, -1)))), (block.rows, n, ((0, (1, 0)), (n - 1, (-1, 0))))):
            for k, inner in sides:
                line = (along == k) & (size > 1)
                out = np.where(line[:, None] if along is block.rows else line[None], mean([z, shifted[inner]]), out)
        return out, [0.0]

    def follow(self, control, stats):
        return control


class Gradient(Relaxation):
    """Cells that the mask (if any) holds and that differ too much from their steepest neighbour move to 0.8 of the limit from it.

    Statistics: the steepest gradient met. The outermost cells stay.
    """

    width = 1

    def __init__(self, dx: float, dy: float, limit: float, rounds: int = 50):
        self.steps, self.limit, self.most = (dx, dx, dy, dy), limit, rounds

    def sweep(self, block, control):
        z = block.z
        near = {(a, b): s for a, b, s in around(z, 1)}
        four = np.stack([near[-1, 0], near[1, 0], near[0, -1], near[0, 1]])
        step = np.array(self.steps)[:, None, None]
        slope = np.nan_to_num((four - z) / step)
        k = np.abs(slope).argmax(0)[None]
        steep, beside, by = (np.take_along_axis(np.broadcast_to(x, slope.shape), k, 0)[0] for x in (slope, four, step))
        use = block.inside(1) & ~np.isnan(z)
        if block.extra:
            use &= block.extra[0] > 0
        over = use & (np.abs(steep) > self.limit)
        return np.where(over, beside - np.sign(steep) * 0.8 * self.limit * by, z), [block.most(np.where(use, np.abs(steep), 0.0))]

    def follow(self, control, stats):
        return control if stats[0] > self.limit else None


class Outwards(Relaxation):
    """Holes of the border zone of width r + 1 take their inner neighbour's value, ring by ring: along i, then along j."""

    most, width = 1, 1

    def __init__(self, r: int):
        self.r, self.reach = r, r + 2

    def sweep(self, block, control):
        z = block.z.copy()
        use = block.extra[0] > 0 if block.extra else np.ones(z.shape, bool)
        for places, n, turn in ((block.rows, block.shape[0], False), (block.cols, block.shape[1], True)):
            f, u = (z.T, use.T) if turn else (z, use)
            at = {int(p): k for k, p in enumerate(places)}
            for k, inner in [(k, k + 1) for k in range(min(self.r, n - 1), -1, -1)] + [(k, k - 1) for k in range(max(n - self.r - 1, 0), n)]:
                if k in at and inner in at:
                    line = f[at[k]]
                    f[at[k]] = np.where(np.isnan(line) & u[at[k]], f[at[inner]], line)
        return z, [0.0]

    def follow(self, control, stats):
        return None


def whole(rule: Relaxation, z: np.ndarray, *extra: np.ndarray, first: float | None = None, closed: bool = False) -> np.ndarray:
    """The operator on one array."""
    z, control = np.array(z, float), rule.first if first is None else first
    rows, cols = np.arange(z.shape[0]), np.arange(z.shape[1])
    for _ in range(rule.most if z.size else 0):
        z, stats = rule.sweep(Block(z, rows, cols, z.shape, extra=list(extra), closed=closed), control)
        control = rule.follow(control, stats)
        if control is None:
            break
    return z


# --- tiles ------------------------------------------------------------------------------------


def _count(n: int, tile: int) -> int:
    return max(1, n // tile)


def _edges(n: int, tile: int) -> list[int]:
    """Where tiles begin, and n: each has at least `tile` cells, if there are as many."""
    k = _count(n, tile)
    return [t * n // k for t in range(k + 1)]


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """b with its keys renamed, and the condition that they equal a's, nulls too."""
    for k in keys:
        b = b.withColumnRenamed(k, f"_of_{k}")
    return b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])


def _tiled(df: DataFrame, keys: list[str], value: str, extra: list[str], tile: int) -> DataFrame:
    """One row for each tile: keys, n, m, i0, j0, ti, tj, z, and the planes of extra with that of the cells there are."""
    df = df.where("i is not null and j is not null").select(*keys, F.col("i").cast("long").alias("_i"), F.col("j").cast("long").alias("_j"), F.col(value).cast("double").alias("_v"), *[F.col(c).cast("double").alias(f"_e{x}") for x, c in enumerate(extra)])
    size = df.groupBy(*keys).agg((F.max("_i") - F.min("_i") + 1).cast("long").alias("_n"), (F.max("_j") - F.min("_j") + 1).cast("long").alias("_m"), F.min("_i").alias("_i0"), F.min("_j").alias("_j0"))
    k = {c: F.greatest(F.lit(1), F.floor(F.col(c) / tile)).cast("long") for c in ("_n", "_m")}
    at = lambda c, first, n: (F.ceil(((F.col(c) - F.col(first) + 1) * k[n]) / F.col(n)) - 1).cast("int")
    right, cond = same(df, size, keys)
    cells = df.join(right, cond).select(*keys, "_n", "_m", "_i0", "_j0", at("_i", "_i0", "_n").alias("_ti"), at("_j", "_j0", "_m").alias("_tj"), "_i", "_j", "_v", *[f"_e{x}" for x in range(len(extra))])
    # a tile may have no cell at all
    frame = size.withColumn("_ti", F.explode(F.sequence(F.lit(0), (k["_n"] - 1).cast("int")))).withColumn("_tj", F.explode(F.sequence(F.lit(0), (k["_m"] - 1).cast("int"))))
    every = cells.unionByName(frame, allowMissingColumns=True)

    def pack(key, p: pd.DataFrame) -> pd.DataFrame:
        n, m, i0, j0, ti, tj = (int(x) for x in key[len(keys) :])
        a, b = _edges(n, tile)[ti : ti + 2], _edges(m, tile)[tj : tj + 2]
        p = p[p["_i"].notna()]
        i, j = p["_i"].to_numpy(np.int64) - i0 - a[0], p["_j"].to_numpy(np.int64) - j0 - b[0]
        planes = np.full((2 + len(extra), a[1] - a[0], b[1] - b[0]), np.nan)
        for plane, c in zip(planes, ["_v", *(f"_e{x}" for x in range(len(extra)))], strict=False):
            plane[i, j] = p[c].to_numpy(float)
        planes[-1] = 0
        planes[-1, i, j] = 1
        out = pd.DataFrame([list(key)], columns=[*keys, "_n", "_m", "_i0", "_j0", "_ti", "_tj"])
        return out.assign(_z=[planes[0].tobytes()], _planes=[planes[1:].tobytes()])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "_n long, _m long, _i0 long, _j0 long, _ti int, _tj int, _z binary, _planes binary"])
    return every.groupBy(*keys, "_n", "_m", "_i0", "_j0", "_ti", "_tj").applyInPandas(pack, schema)


def _cells(tiles: DataFrame, keys: list[str], kinds: dict[str, str], value: str, tile: int) -> DataFrame:
    """Back to (keys, i, j, value), the cells that the table had."""

    def run(frames):
        for f in frames:
            for _, r in f.iterrows():
                a, b = _edges(r["_n"], tile)[r["_ti"] : r["_ti"] + 2], _edges(r["_m"], tile)[r["_tj"] : r["_tj"] + 2]
                shape = (a[1] - a[0], b[1] - b[0])
                z, there = np.frombuffer(r["_z"]).reshape(shape), np.frombuffer(r["_planes"]).reshape(-1, *shape)[-1]
                i, j = np.nonzero(there)
                out = pd.DataFrame({"i": i + a[0] + r["_i0"], "j": j + b[0] + r["_j0"], value: z[i, j]})
                for c in keys:
                    out[c] = [r[c]] * len(out)
                yield out[[*keys, "i", "j", value]]

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), f"i {kinds['i']}, j {kinds['j']}, `{value}` double"])
    return tiles.select(*keys, "_n", "_m", "_i0", "_j0", "_ti", "_tj", "_z", "_planes").mapInPandas(run, schema)


def _round(tiles: DataFrame, keys: list[str], kinds: dict[str, str], rule: Relaxation, tile: int, wrap: bool) -> DataFrame:
    """Each tile swept under its slice's plan: keys, place, z, planes, plan, done; new, and stats by sweep."""
    place = ["_n", "_m", "_i0", "_j0", "_ti", "_tj"]

    def spread(frames):
        for f in frames:
            for _, r in f.iterrows():
                n, m, ti, tj = r["_n"], r["_m"], r["_ti"], r["_tj"]
                a, b = _edges(n, tile), _edges(m, tile)
                shape = (a[ti + 1] - a[ti], b[tj + 1] - b[tj])
                halo = rule.reach * len(r["_plan"])
                every = np.concatenate([np.frombuffer(r["_z"]), np.frombuffer(r["_planes"])]).reshape(-1, *shape)
                for di in (-1, 0, 1):
                    for dj in (-1, 0, 1):
                        u, w = ti + di, tj + dj
                        if wrap and len(a) > 2:
                            u %= len(a) - 1
                        if not (0 <= u < len(a) - 1 and 0 <= w < len(b) - 1):
                            continue
                        cut_i = {-1: slice(0, halo), 0: slice(None), 1: slice(max(shape[0] - halo, 0), None)}[di]
                        cut_j = {-1: slice(0, halo), 0: slice(None), 1: slice(max(shape[1] - halo, 0), None)}[dj]
                        part = every[:, cut_i, cut_j]
                        out = {c: r[c] for c in (*keys, *place)} | {"_ti": u, "_tj": w, "_fi": -di, "_fj": -dj, "_h": part.shape[1], "_w": part.shape[2], "_part": part.tobytes(), "_plan": r["_plan"], "_done": r["_done"]}
                        yield pd.DataFrame([list(out.values())], columns=list(out))

    columns = [*(f"`{c}` {kinds[c]}" for c in keys), "_n long, _m long, _i0 long, _j0 long, _ti int, _tj int"]
    sent = tiles.select(*keys, *place, "_z", "_planes", "_plan", "_done").mapInPandas(spread, ", ".join([*columns, "_fi int, _fj int, _h int, _w int, _part binary, _plan array<double>, _done int"]))

    def run(key, p: pd.DataFrame) -> pd.DataFrame:
        n, m, _, _, ti, tj = (int(x) for x in key[len(keys) :])
        a, b = _edges(n, tile)[ti : ti + 2], _edges(m, tile)[tj : tj + 2]
        parts = {(r["_fi"], r["_fj"]): np.frombuffer(r["_part"]).reshape(-1, r["_h"], r["_w"]) for _, r in p.iterrows()}
        plan, done = p["_plan"].iloc[0], int(p["_done"].iloc[0])
        lines = [np.concatenate([parts[fi, fj] for fj in (-1, 0, 1) if (fi, fj) in parts], 2) for fi in (-1, 0, 1) if (fi, 0) in parts]
        every = np.concatenate(lines, 1)
        up, left = (parts[f].shape[x] if f in parts else 0 for f, x in (((-1, 0), 1), ((0, -1), 2)))
        rows, cols = np.arange(every.shape[1]) + a[0] - up, np.arange(every.shape[2]) + b[0] - left
        own = (slice(up, up + a[1] - a[0]), slice(left, left + b[1] - b[0]))
        block = Block(every[0].copy(), rows, cols, (n, m), own, list(every[1:-1]), closed=wrap and a[0] == 0 and a[1] == n)
        old, stats = every[0][own], []
        for control in plan:
            block.z, s = rule.sweep(block, control)
            stats.append(s)
        out = pd.DataFrame([list(key)], columns=[*keys, *place])
        return out.assign(_z=[old.tobytes()], _planes=[every[1:][(slice(None), *own)].tobytes()], _plan=[plan], _done=[done], _new=[block.z[own].tobytes()], _stats=[stats])

    return sent.groupBy(*keys, *place).applyInPandas(run, ", ".join([*columns, "_z binary, _planes binary, _plan array<double>, _done int, _new binary, _stats array<array<double>>"]))


def _judged(made: DataFrame, keys: list[str], kinds: dict[str, str], rule: Relaxation, longest: int) -> DataFrame:
    """For each slice: whether its sweeps stand, the plan that follows, how many sweeps are done, and whether it is finished."""
    stats = made.select(*keys, F.posexplode("_stats").alias("_s", "_x")).groupBy(*keys, "_s").agg(F.array(*[F.max(F.get("_x", F.lit(c))) for c in range(rule.width)]).alias("_x"))
    stats = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_s", "_x"))).alias("_stats"))
    plans = made.groupBy(*keys).agg(F.first("_plan").alias("_plan"), F.first("_done").alias("_done"))
    right, cond = same(stats, plans, keys)

    def run(frames):
        for f in frames:
            out = []
            for plan, done, stats in zip(f["_plan"], f["_done"], f["_stats"], strict=True):
                plan, told, stop = [float(x) for x in plan], [], False
                for s in stats:  # controls as they should have been
                    told.append(plan[0] if not told else following)
                    if told[-1] != plan[len(told) - 1]:
                        break
                    following = rule.follow(told[-1], list(s["_x"]))
                    stop = following is None or done + len(told) >= rule.most
                    if stop:
                        break
                stands = len(told) == len(plan) and told == plan
                if stands:
                    ahead = 0 if stop else min(2 * len(plan), longest, rule.most - done - len(plan))
                    out.append((True, [following] * ahead, done + len(plan), stop))
                else:  # once more: up to the end, or with what is known now
                    out.append((False, told + [told[-1]] * (0 if stop else len(plan) - len(told)), done, False))
            yield pd.concat([f[keys].reset_index(drop=True), pd.DataFrame(out, columns=["_stands", "_next", "_made", "_finished"])], axis=1)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "_stands boolean, _next array<double>, _made int, _finished boolean"])
    return stats.join(right, cond).select(*keys, "_stats", "_plan", "_done").mapInPandas(run, schema)


def relax(df: DataFrame, rules: list[Relaxation], keys: list[str] | None = None, value: str = "value", extra: list[str] | None = None, first: str | None = None, wrap: bool = False, tile: int = TILE) -> DataFrame:
    """(keys, i, j, value) after the rules, one after another; extra are further columns of cells that they read.

    first: a column with the first rule's control, alike in all cells of a slice, where it is not the same for all slices.
    """
    kinds, own = dict(df.dtypes), list(keys or [])
    if not own:  # one field: a key of one value, whose tiles spread all the same
        df, keys, kinds = df.withColumn("_field", F.lit(0)), ["_field"], kinds | {"_field": "int"}
    else:
        keys = own
    tiles, done = cut(_tiled(df, keys, value, list(extra or []), tile)), []
    starts = df.groupBy(*keys).agg(F.max(first).cast("double").alias("_start")) if first else None
    for turn, rule in enumerate(rules):
        longest = max(1, tile // 2 // rule.reach)
        if tile < rule.reach:
            raise ValueError("a tile must be at least as wide as the operator's reach")
        if starts is not None and turn == 0:
            right, cond = same(tiles, starts, keys)
            live = tiles.join(right, cond).withColumn("_plan", F.array("_start")).drop("_start", *[f"_of_{k}" for k in keys])
        else:
            live = tiles.withColumn("_plan", F.array(F.lit(float(rule.first))))
        live, done = live.withColumn("_done", F.lit(0)), []
        while rule.most > 0:
            made = cut(_round(live, keys, kinds, rule, tile, wrap))
            judged = cut(_judged(made, keys, kinds, rule, longest))
            right, cond = same(made, judged, keys)
            after = made.drop("_plan", "_done").join(right, cond).withColumn("_z", F.when(F.col("_stands"), F.col("_new")).otherwise(F.col("_z")))
            after = after.select(*keys, "_n", "_m", "_i0", "_j0", "_ti", "_tj", "_z", "_planes", F.col("_next").alias("_plan"), F.col("_made").alias("_done"), "_finished")
            done.append(after.where("_finished"))
            live = after.where("not _finished").drop("_finished")
            if judged.where("not _finished").isEmpty():
                break
        if done:
            tiles = cut(reduce(DataFrame.unionByName, done).drop("_plan", "_done", "_finished"))
    out = _cells(tiles, keys, kinds, value, tile)
    return out.select(*own, "i", "j", value)


def fill_weighted(df: DataFrame, r: int = 4, keys: list[str] | None = None, value: str = "value", tile: int = TILE) -> DataFrame:
    return relax(df, [Weighted(r), Outwards(r)], keys, value, tile=tile)


def fill_nearest(df: DataFrame, r: int = 4, keys: list[str] | None = None, value: str = "value", mask: str | None = None, tile: int = TILE) -> DataFrame:
    return relax(df, [Nearest(r), Outwards(r)], keys, value, [mask] if mask else None, tile=tile)


def fill_mean(df: DataFrame, keys: list[str] | None = None, value: str = "value", tile: int = TILE) -> DataFrame:
    return relax(df, [BoxMean()], keys, value, tile=tile)


def filter_poisson(df: DataFrame, mask: str, tol: float = 1e-2, wrap: bool = False, keys: list[str] | None = None, value: str = "value", tile: int = TILE) -> DataFrame:
    """Relaxes the cells of mask until the largest residual is tol of the middle between the field's least and largest value."""
    limit = df.groupBy(*(keys or [])).agg((tol * F.abs((F.max(value) + F.min(value)) / 2)).alias("_limit"))
    if keys:
        right, cond = same(df, limit, keys)
        df = df.join(right, cond)
    else:
        df = df.join(limit)  # one row
    return relax(df.withColumn("_limit", F.coalesce("_limit", F.lit(0.0))), [Poisson()], keys, value, [mask], "_limit", wrap, tile)


def fill_poisson(df: DataFrame, guess: str = "zonal", wrap: bool = False, tol: float = 1e-2, keys: list[str] | None = None, value: str = "value", tile: int = TILE) -> DataFrame:
    """Missing cells by a first guess (zero; zonal: mean of the cells of one j; mean; weighted), then relaxed."""
    keys, v = list(keys or []), F.col(value)
    if guess == "weighted":
        filled = fill_weighted(df, 6, keys, value, tile).withColumnRenamed(value, "_guess")
        by = [*keys, "i", "j"]
    elif guess in ("zonal", "mean"):
        by = [*keys, *(["j"] if guess == "zonal" else [])]
        filled = df.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("_guess"))
    elif guess == "zero":
        filled, by = None, []
    else:
        raise ValueError("guess must be zero, zonal, mean or weighted")
    if filled is None:
        out = df.withColumn("_guess", F.lit(0.0))
    elif by:
        right, cond = same(df, filled, by)
        out = df.join(right, cond)
    else:
        out = df.join(filled)
    out = out.select(*keys, "i", "j", F.coalesce(v, "_guess").alias(value), v.isNull().cast("double").alias("_free"))
    return filter_poisson(out, "_free", tol, wrap, keys, value, tile)


def diffuse(df: DataFrame, rounds: int, keys: list[str] | None = None, value: str = "value", tile: int = TILE) -> DataFrame:
    return relax(df, [Diffusion(rounds)], keys, value, tile=tile)


def limit_gradient(df: DataFrame, dx: float, dy: float, limit: float, rounds: int = 50, keys: list[str] | None = None, value: str = "value", mask: str | None = None, tile: int = TILE) -> DataFrame:
    return relax(df, [Gradient(dx, dy, limit, rounds)], keys, value, [mask] if mask else None, tile=tile)
