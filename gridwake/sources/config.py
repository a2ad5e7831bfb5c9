"""Namelists, variable tables, grid descriptions and path templates: small text, read on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from gridwake.model import PLANETS, Axis, CoordSystem, Grid, Planet, planet


def fill_path(template: str, **names: str) -> str:
    """{domain}, {grid_name} and other keys replaced; unknown ones stay."""
    for key, value in names.items():
        template = template.replace("{" + key + "}", str(value))
    return template


# --- namelists --------------------------------------------------------------------------------

_FLAT = re.compile(r"([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+)")


def parse_namelist(text: str) -> dict[str, dict[str, str]]:
    """{group: {name: raw value}}, from &group blocks and from flat lines of group.name=value pairs.

    The first of several equal names counts. In blocks `!` begins a comment anywhere, on flat lines it may
    stand in quotes.
    """
    out: dict[str, dict[str, str]] = {}
    group = None
    for raw in text.splitlines():
        line = raw.strip()
        if group is None and line.startswith("&"):
            group = line[1:].split("!")[0].strip()
            out.setdefault(group, {})
        elif group is not None:
            line = line.split("!")[0].strip()
            if line == "/" or line.lower() == "&end":
                group = None
            elif "=" in line:
                name, value = line.split("=", 1)
                out[group].setdefault(name.strip(), value.strip().rstrip(",").strip())
        elif line and line[0] not in "!#":
            for g, name, value in _FLAT.findall(line):
                out.setdefault(g, {}).setdefault(name, value)
    return out


def words_of(value: str) -> list[str]:
    """A value's items: quoted strings whole, others split at blanks and commas."""
    return [a or b or c for a, b, c in re.findall(r"\"([^\"]*)\"|'([^']*)'|([^\s,]+)", value)]


def number(text: str) -> float:
    """A number, with Fortran exponents; one that does not parse is tried without its last character."""
    text = text.strip().lower().replace("d", "e")
    try:
        return float(text)
    except ValueError:
        return float(text[:-1])


def logical(text: str) -> bool:
    t = text.strip().strip(".").lower()
    if t in ("t", "true", "1"):
        return True
    if t in ("f", "false", "0"):
        return False
    raise ValueError(f"not a logical value: {text!r}")


_KINDS = {str: lambda t: t, float: number, int: lambda t: int(number(t)), bool: logical}


class Namelist:
    """Values of a file over those of a defaults file, which then must declare every name."""

    def __init__(self, text: str, defaults: str | None = None):
        self.user = parse_namelist(text)
        self.defaults = None if defaults is None else parse_namelist(defaults)

    @classmethod
    def load(cls, path: str, defaults: str | None = None) -> Namelist:
        return cls(Path(path).read_text(), Path(defaults).read_text() if defaults else None)

    def raw(self, group: str, name: str) -> str:
        if self.defaults is not None and name not in self.defaults.get(group, {}):
            raise KeyError(f"{group}.{name} is not declared in the defaults")
        for source in (self.user, self.defaults or {}):
            if name in source.get(group, {}):
                return source[group][name]
        raise KeyError(f"{group}.{name}")

    def get(self, group: str, name: str, kind: type = str):
        items = words_of(self.raw(group, name))
        return _KINDS[kind](items[0] if items else "")

    def vector(self, group: str, name: str, kind: type = float) -> list:
        return [_KINDS[kind](w) for w in words_of(self.raw(group, name))]

    def unknown(self) -> list[str]:
        """group.name of the file that the defaults do not declare."""
        known = {(g, n) for g, v in (self.defaults or {}).items() for n in v}
        return sorted(f"{g}.{n}" for g, v in self.user.items() for n in v if (g, n) not in known)

    def text(self) -> str:
        """Both, merged, as blocks."""
        merged = {g: dict(v) for g, v in (self.defaults or {}).items()}
        for g, v in self.user.items():
            merged.setdefault(g, {}).update(v)
        return "\n".join("&" + g + "\n" + "".join(f"  {n} = {x}\n" for n, x in v.items()) + "/\n" for g, v in merged.items())

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(g, n, x) for g, v in parse_namelist(self.text()).items() for n, x in v.items()]
        return spark.createDataFrame(rows, "group string, name string, value string")


# --- variable tables --------------------------------------------------------------------------


def parse_variables(text: str) -> list[tuple[int, str, list[str], str, str]]:
    """(id, name, dims, units, long name) of the rows of a table drawn with bars; rule and heading lines are skipped."""
    out = []
    for line in text.splitlines():
        part = [c.strip() for c in line.strip().strip("|").split("|")]
        if len(part) < 5 or not part[0].lstrip("+-").isdigit():
            continue
        out.append((int(part[0]), part[1], [d.strip() for d in part[2].split(",") if d.strip()], part[3], part[4]))
    return out


def variables(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_variables(text), "id int, varname string, dims array<string>, units string, long_name string")


def find_variable(table: DataFrame, name: str) -> DataFrame:
    return table.where(table["varname"] == name)


# --- grid descriptions ------------------------------------------------------------------------


@dataclass
class Description:
    """A grid description: its own `# key = value` heading wins over keys of the body."""

    keys: dict[str, str] = field(default_factory=dict)
    yvals: list[float] = field(default_factory=list)
    xvals: list[float] = field(default_factory=list)


#: Projections by the names that other tools use.
_MAPPINGS = {"stereographic": "stereographic", "polar_stereographic": "polar_stereographic", "lambert_azimuthal_equal_area": "lambert_azimuthal_equal_area", "rotated_latitude_longitude": "rotated_pole"}


def _body(k: dict[str, str]) -> Planet:
    """The planet by its name, or by its axes."""
    if "planet" in k:
        return planet(k["planet"].strip("\"'"))
    for p in PLANETS.values():
        if "semi_major_axis" in k and abs(float(k["semi_major_axis"]) - p.a) < 1e-6 and ("inverse_flattening" in k) == (p.f != 0):
            return p
    if "semi_major_axis" in k:
        inverse = float(k.get("inverse_flattening", 0))
        return Planet("given", float(k["semi_major_axis"]), 1 / inverse if inverse else 0.0)
    return planet()


def _projection(k: dict[str, str]) -> tuple[float, float, float]:
    """Centre and angle: the own keys, else those that other tools write."""
    first = lambda *names: next((float(k[n]) for n in names if n in k), 0.0)
    lon = first("lambda", "longitude_of_projection_origin", "straight_vertical_longitude_from_pole", "grid_north_pole_longitude")
    lat = first("phi", "latitude_of_projection_origin", "grid_north_pole_latitude")
    alpha = first("alpha", "angle_of_oblique_tangent")
    if "alpha" not in k and "standard_parallel" in k:
        alpha = 90.0 - abs(float(k["standard_parallel"]))
    return lon, lat, alpha


def parse_description(text: str) -> Description:
    heading: dict[str, str] = {}
    body: dict[str, str] = {}
    values: dict[str, list[float]] = {"xvals": [], "yvals": []}
    reading = ""
    for line in text.splitlines():
        s = line.strip()
        if s.startswith("#"):
            if "=" in s:
                k, v = s[1:].split("=", 1)
                heading[k.strip()] = v.strip()
        elif "=" in s:
            k, v = (p.strip() for p in s.split("=", 1))
            reading = k if k in values else ""
            if reading:
                values[k] += [float(x) for x in v.split()]
            else:
                body[k] = v
        elif s and reading:
            values[reading] += [float(x) for x in s.split()]
    return Description({**body, **heading}, values["yvals"], values["xvals"])


def grid_of(text: str) -> Grid:
    """The structured grid that a description gives."""
    d = parse_description(text)
    k = d.keys
    nx, ny = int(k["xsize"]), int(k["ysize"])
    x = Axis.of(d.xvals) if d.xvals else Axis(float(k["xfirst"]), float(k["xinc"]), nx)
    y = Axis.of(d.yvals) if d.yvals else Axis(float(k["yfirst"]), float(k["yinc"]), ny)
    if (x.n, y.n) != (nx, ny):
        raise ValueError(f"{x.n} x {y.n} values, but sizes {nx} x {ny}")
    kind = {"lonlat": "latlon", "projection": k.get("mtype", "stereographic"), "generic": "cartesian"}.get(k.get("gridtype", "lonlat"), "latlon")
    system = CoordSystem(k.get("mtype") or _MAPPINGS.get(k.get("grid_mapping_name", ""), kind), k.get("xunits", "degrees").strip("\"'"), _body(k), *_projection(k))
    return Grid(k.get("name", "grid"), x, y, system)


def describe(g: Grid) -> str:
    """The text that grid_of() reads again."""
    s = g.system
    kind = "lonlat" if s.mtype == "latlon" else "projection" if s.is_projection else "generic"
    heading = {"name": g.name, "mtype": s.mtype, "planet": s.planet.name, "lambda": s.lon, "phi": s.lat, "alpha": s.alpha}
    if s.planet.name not in PLANETS:
        heading |= {"semi_major_axis": s.planet.a, **({"inverse_flattening": 1 / s.planet.f} if s.planet.f else {})}
        del heading["planet"]
    body = {"gridtype": kind, "gridsize": g.size, "xsize": g.x.n, "ysize": g.y.n, "xunits": s.units, "yunits": s.units}
    for c, a in (("x", g.x), ("y", g.y)):
        body |= {f"{c}first": a.x0, f"{c}inc": a.dx} if a.at is None else {f"{c}vals": " ".join(map(repr, a.at))}
    return "".join(f"# {k} = {v}\n" for k, v in heading.items()) + "".join(f"{k} = {v}\n" for k, v in body.items())


def describe_cells(outlines: DataFrame, name: str = "grid", kind: str = "unstructured") -> str:
    """An explicit description: the corners of each cell of outlines (src, x, y, xs, ys in degrees), for tools without the grid's system."""
    rows = outlines.orderBy("src").collect()
    line = lambda values: " ".join(f"{v:.10g}" for v in values)
    corners = len(rows[0]["xs"]) if rows else 0
    out = [f"gridtype = {kind}", f"gridsize = {len(rows)}", f"gridname = {name}", f"nvertex = {corners}", "xunits = degrees", "yunits = degrees"]
    for c in "xy":
        out += [f"{c}vals = {line(r[c] for r in rows)}", f"{c}bounds = "] + [line(r[f"{c}s"]) for r in rows]
    return "\n".join(out) + "\n"
