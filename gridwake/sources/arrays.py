"""Long-form fields as Parquet, multi-file stitching, ASCII series, and classic netCDF files.

Inside, missing values are NULL; the sentinel exists only in files. A field is a table of index
columns and a value, so hyperslabs are range conditions that reach the scan, and files outside a
time range are never opened beyond their footers.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridwake.model import MISSING, CoordSystem, Grid

TINY, HUGE = 1e-30, 1e25


def decoded(value: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    """A stored number: NaN, the sentinel and sizes of 1e25 and more are missing, sizes below 1e-30 are 0; others unpacked."""
    v = F.when(F.isnan(value) | (value == MISSING), None).otherwise(value * scale + offset)
    return F.when(F.abs(v) < TINY, 0.0).when(F.abs(v) >= HUGE, None).otherwise(v)


def encoded(value: Column, scale: float = 1.0, offset: float = 0.0, missing: float = MISSING) -> Column:
    """The way back: packed, and the sentinel for what is missing."""
    return F.coalesce((value - offset) / scale, F.lit(missing))


def logical(value: Column) -> Column:
    return value == 1


def read_slab(spark: SparkSession, path: str, start: dict[str, int] | None = None, count: dict[str, int] | None = None, value: str = "value", scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """A hyperslab: from start (1-based) so many along each index."""
    df = spark.read.parquet(path)
    for c, s in (start or {}).items():
        df = df.where(F.col(c) >= s)
        if count and c in count:
            df = df.where(F.col(c) < s + count[c])
    return df.withColumn(value, decoded(F.col(value).cast("double"), scale, offset))


def write_field(df: DataFrame, path: str, by: list[str] | None = None, value: str = "value", scale: float = 1.0, offset: float = 0.0, mode: str = "overwrite") -> None:
    """As Parquet, packed, sorted by `by` within files so that row groups can be skipped."""
    out = df.withColumn(value, encoded(F.col(value), scale, offset))
    if by:
        out = out.repartitionByRange(*by).sortWithinPartitions(*by)
    out.write.mode(mode).parquet(path)


def transposed(df: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    """Two index columns swapped."""
    swap = {a: b, b: a}
    return df.select(*[F.col(c).alias(swap.get(c, c)) for c in df.columns])


def shape(df: DataFrame, indices: list[str]) -> dict[str, int]:
    """Largest index of each."""
    row = df.agg(*[F.max(c).alias(c) for c in indices]).first()
    return {c: int(row[c] or 0) for c in indices}


def stitched(spark: SparkSession, paths: list[str], step: str = "t_idx") -> DataFrame:
    """Files in order of their names, their steps numbered on: one job counts their steps, one scan reads them all."""
    from gridwake.sources.manifest import Manifest

    return Manifest.of(spark, paths, step).read(spark)


def with_attributes(df: DataFrame, column: str, **attributes) -> DataFrame:
    """Units and the like as column metadata."""
    return df.withMetadata(column, {**df.schema[column].metadata, **attributes})


def attributes(df: DataFrame, column: str) -> dict:
    return dict(df.schema[column].metadata)


# --- ASCII series -----------------------------------------------------------------------------


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """(time, channel from 1, value) from lines of a time and one or more numbers.

    Blank lines, comments (# or !) and lines that do not begin with a number are skipped. The first line
    of data says how many channels there are.
    """
    line = F.trim(F.col("value"))
    number = r"^[+-]?(\d|\.\d)"
    rows = spark.read.text(path).select(F.split(F.regexp_replace(line, ",", " "), r"\s+").alias("w"), line.alias("line")).where(F.col("line").rlike(number))
    first = rows.first()
    if first is None or len(first["w"]) < 2:
        raise ValueError(f"{path}: no series of two columns and more")
    n = len(first["w"]) - 1
    out = rows.select(F.expr("try_cast(replace(lower(w[0]), 'd', 'e') as double)").alias("time"), F.posexplode(F.slice("w", 2, n)).alias("c", "v"))
    return out.select("time", (F.col("c") + 1).alias("channel"), F.expr("try_cast(replace(lower(v), 'd', 'e') as double)").alias("value")).where("time is not null")


def channels(wide: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """Columns of a wide table as channels."""
    return wide.unpivot([time], columns, "channel", "value").withColumnRenamed(time, "time")


# --- classic netCDF ---------------------------------------------------------------------------

_TYPES = {1: ("b", 1), 2: ("S1", 1), 3: (">i2", 2), 4: (">i4", 4), 5: (">f4", 4), 6: (">f8", 8)}
_CODES = {"f8": 6, "f4": 5, "i4": 4, "i2": 3, "i1": 1, "S1": 2}


def _padded(n: int) -> int:
    return -(-n // 4) * 4


def opened(path: str):
    """A file to seek and read in: a local path, or a URI of a file system that pyarrow knows."""
    if "://" in path:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        return system.open_input_file(at)
    return open(path, "rb")


class ClassicFile:
    """The header of a classic netCDF file (versions 1 and 2), and its variables; taken counts bytes of values read."""

    def __init__(self, path: str):
        self.path, self.taken = path, 0
        with opened(path) as f:
            self.data = f.read(1 << 20)
            if self.data[:3] != b"CDF" or self.data[3] not in (1, 2):
                raise ValueError(f"{path}: not a classic netCDF file")
            self.wide = self.data[3] == 2
            while True:
                try:
                    self._parse()
                    break
                except (struct.error, IndexError):  # the header is longer than what was read
                    more = f.read(1 << 20)
                    if not more:
                        raise
                    self.data += more

    def _parse(self):
        self.at = 4
        self.records = self._int()
        self.dims = self._list(lambda: (self._name(), self._int()))
        self.attributes = dict(self._list(self._attribute))
        self.vars = {}
        for name, ids, attributes, kind, size, begin in self._list(self._variable):
            self.vars[name] = {"dims": [self.dims[i][0] for i in ids], "ids": ids, "attributes": attributes, "kind": kind, "size": size, "begin": begin}
        if len(self.data) < self.at:
            raise IndexError

    def _int(self) -> int:
        (v,) = struct.unpack_from(">i", self.data, self.at)
        self.at += 4
        return v

    def _name(self) -> str:
        n = self._int()
        raw = self.data[self.at : self.at + n]
        if len(raw) < n:
            raise IndexError
        self.at += _padded(n)
        return raw.decode()

    def _list(self, item):
        self._int()
        return [item() for _ in range(self._int())]

    def _attribute(self):
        name, kind, n = self._name(), self._int(), self._int()
        code, size = _TYPES[kind]
        raw = self.data[self.at : self.at + n * size]
        if len(raw) < n * size:
            raise IndexError
        self.at += _padded(n * size)
        if kind == 2:
            return name, raw.decode("utf-8", "replace").rstrip("\0")
        values = np.frombuffer(raw, code).tolist()
        return name, values[0] if n == 1 else values

    def _variable(self):
        name = self._name()
        ids = [self._int() for _ in range(self._int())]
        attributes, kind, size = dict(self._list(self._attribute)), self._int(), self._int()
        (begin,) = struct.unpack_from(">q" if self.wide else ">i", self.data, self.at)
        self.at += 8 if self.wide else 4
        return name, ids, attributes, kind, size, begin

    def shape(self, name: str) -> list[int]:
        return [self.dims[i][1] or self.records for i in self.vars[name]["ids"]]

    def unlimited(self, name: str) -> bool:
        ids = self.vars[name]["ids"]
        return bool(ids) and self.dims[ids[0]][1] == 0

    def _take(self, code: str, each: int, offsets: list[int]) -> np.ndarray:
        """So many values from each place of the file."""
        width, out = np.dtype(code).itemsize, []
        with opened(self.path) as f:
            for at in offsets:
                f.seek(at)
                raw = f.read(each * width)
                if len(raw) < each * width:
                    raise ValueError(f"{self.path}: ends before byte {at + each * width}")
                self.taken += len(raw)
                out.append(np.frombuffer(raw, code))
        return np.stack(out) if out else np.zeros((0, each), code)

    def steps(self, name: str, first: int, count: int, rows: tuple[int, int] | None = None) -> np.ndarray:
        """Values of so many steps of the first dimension, from step first (0-based); rows: only from..to of the second."""
        v = self.vars[name]
        code, width = _TYPES[v["kind"]]
        shape = self.shape(name)
        if not shape:
            return self._take(code, 1, [v["begin"]])[0]
        each = int(np.prod(shape[1:], dtype=int))
        stride = each * width
        if self.unlimited(name):
            own = [x for x in self.vars.values() if x["ids"] and self.dims[x["ids"][0]][1] == 0]
            if len(own) > 1:  # a single record variable is not padded
                stride = sum(_padded(x["size"]) for x in own)
        some = shape[1:]
        offsets = [v["begin"] + (first + k) * stride for k in range(count)]
        if rows is not None and len(shape) > 1 and rows != (0, shape[1]):
            rest = int(np.prod(shape[2:], dtype=int))
            some = [rows[1] - rows[0], *shape[2:]]
            offsets = [at + rows[0] * rest * width for at in offsets]
        elif stride == each * width and count:  # steps lie one behind the other
            return self._take(code, each * count, offsets[:1]).reshape(count, *some)
        return self._take(code, int(np.prod(some, dtype=int)), offsets).reshape(count, *some)


class ClassicSource(DataSource):
    """spark.read.format("classic_netcdf").option("path", ...).option("variable", ...).load(): a variable in long form.

    Indices are 1-based, named after the dimensions; missing values are NULL, packed values unpacked. Option time: a
    variable along the first dimension that becomes the column `time`. Partitions are runs of steps of the first
    dimension. The path, or URI, must be readable on every executor. read_classic() pushes conditions down.
    """

    @classmethod
    def name(cls) -> str:
        return "classic_netcdf"

    def schema(self) -> str:
        dims = ClassicFile(self.options["path"]).vars[self.options["variable"]]["dims"]
        return ", ".join([*(f"`{d}_idx` int" for d in dims), *(["time double"] if "time" in self.options else []), "value double"])

    def reader(self, schema) -> DataSourceReader:
        kind = PrunedReader if self.options.get("pruned") == "true" else ClassicReader
        return kind(self.options["path"], self.options["variable"], int(self.options.get("cells", 1_000_000)), self.options.get("time"))


class Steps(InputPartition):
    def __init__(self, first: int, count: int, rows: tuple[int, int] | None = None):
        super().__init__(first)
        self.first, self.count, self.rows = first, count, rows


class ClassicReader(DataSourceReader):
    def __init__(self, path: str, variable: str, cells: int, time: str | None = None):
        self.path, self.variable, self.cells, self.time = path, variable, cells, time
        self.bounds: dict[str, list[float]] = {}  # least and largest value by column

    def partitions(self) -> list[Steps]:
        f = ClassicFile(self.path)
        shape, dims = f.shape(self.variable), f.vars[self.variable]["dims"]
        if not shape:
            return [Steps(0, 1)]
        ends = [(max(1, math.ceil(a)), min(n, math.floor(b))) for n, (a, b) in zip(shape, (self.bounds.get(f"{d}_idx", (-1, n)) for d, n in zip(dims, shape, strict=True)), strict=True)]
        first, last = ends[0]
        if "time" in self.bounds and self.time:
            t = f.steps(self.time, 0, shape[0]).astype(float)
            hit = np.flatnonzero((t >= self.bounds["time"][0]) & (t <= self.bounds["time"][1])) + 1
            first, last = (max(first, int(hit[0])), min(last, int(hit[-1]))) if len(hit) else (1, 0)
        rows = (ends[1][0] - 1, ends[1][1]) if len(shape) > 1 else None
        if first > last or rows is not None and rows[0] >= rows[1]:
            return [Steps(0, 0)]
        per = max(1, self.cells // max(1, int(np.prod(shape[1:], dtype=int)) * (rows[1] - rows[0]) // shape[1] if rows else 1))
        return [Steps(k, min(per, last - k), rows) for k in range(first - 1, last, per)]

    def read(self, partition: Steps) -> Iterator:
        import pyarrow as pa

        f = ClassicFile(self.path)
        if not partition.count:
            return
        values = f.steps(self.variable, partition.first, partition.count, partition.rows)
        attributes = f.vars[self.variable]["attributes"]
        scalar = not f.shape(self.variable)
        v = values.astype(float).ravel()
        bad = ~np.isfinite(v) | (v == MISSING) | (np.abs(v) >= HUGE)
        for key in ("missing_value", "_FillValue"):
            if key in attributes:
                bad |= v == attributes[key]
        v = v * attributes.get("scale_factor", 1.0) + attributes.get("add_offset", 0.0)
        index = [] if scalar else [x.ravel().astype(np.int32) + 1 for x in np.indices(values.shape)]
        columns = [f"{d}_idx" for d in f.vars[self.variable]["dims"]]
        if index:
            index[0] = index[0] + np.int32(partition.first)
        if len(index) > 1 and partition.rows:
            index[1] = index[1] + np.int32(partition.rows[0])
        made = [*map(pa.array, index)]
        if self.time:
            t = f.steps(self.time, partition.first, partition.count).astype(float)
            made.append(pa.array(t[index[0] - 1 - partition.first]))
            columns.append("time")
        yield pa.RecordBatch.from_arrays([*made, pa.array(v, mask=bad)], names=[*columns, "value"])


class PrunedReader(ClassicReader):
    """With conditions on the first two indices and on time turned into byte ranges."""

    def pushFilters(self, filters):
        dims = ClassicFile(self.path).vars[self.variable]["dims"]
        whole = {f"{d}_idx" for d in dims[:2]}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = type(f).__name__
            v = getattr(f, "value", None)
            ends = {"EqualTo": (v, v), "GreaterThan": (v, None), "GreaterThanOrEqual": (v, None), "LessThan": (None, v), "LessThanOrEqual": (None, v), "In": (min(v), max(v)) if kind == "In" and v and None not in v else None}.get(kind)
            if ends is None or column not in whole | ({"time"} if self.time else set()) or not all(isinstance(x, (int, float)) or x is None for x in ends):
                if not (kind == "IsNotNull" and column in whole):  # indices are never null
                    yield f
                continue
            if column in whole and kind in ("GreaterThan", "LessThan"):
                ends = (None if ends[0] is None else ends[0] + 1, None if ends[1] is None else ends[1] - 1)
            held = self.bounds.setdefault(column, [-math.inf, math.inf])
            held[0] = max(held[0], -math.inf if ends[0] is None else ends[0])
            held[1] = min(held[1], math.inf if ends[1] is None else ends[1])
            if column == "time" or kind == "In":  # the range only; Spark does the rest
                yield f
        for column, (a, b) in list(self.bounds.items()):
            self.bounds[column] = [max(a, -1e18), min(b, 1e18)]


def read_classic(spark: SparkSession, path: str, variable: str, time: str | None = None, cells: int = 1_000_000) -> DataFrame:
    """A variable of a classic file in long form; conditions on its first two indices, and on time, choose what is read.

    Sets spark.sql.python.filterPushdown.enabled for the session, which sources that take conditions need.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ClassicSource)
    reader = spark.read.format("classic_netcdf").option("path", path).option("variable", variable).option("cells", str(cells)).option("pruned", "true")
    return (reader.option("time", time) if time else reader).load()


def layout(dims: dict[str, int], variables: dict[str, tuple[list[str], str, int, dict]], attributes: dict | None = None) -> tuple[bytes, dict[str, int]]:
    """Header of a classic file with fixed dimensions, and where each variable (dimensions, type, bytes, attributes) begins."""

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">i", len(raw)) + raw.ljust(_padded(len(raw)), b"\0")

    def attrs(a: dict) -> bytes:
        if not a:
            return struct.pack(">ii", 0, 0)
        out = struct.pack(">ii", 12, len(a))
        for k, v in a.items():
            if isinstance(v, str):
                raw = v.encode()
                out += text(k) + struct.pack(">ii", 2, len(raw)) + raw.ljust(_padded(len(raw)), b"\0")
            else:
                x = np.atleast_1d(np.asarray(v, ">f8"))
                out += text(k) + struct.pack(">ii", 6, len(x)) + x.tobytes()
        return out

    names = list(dims)
    head = b"CDF\x02" + struct.pack(">i", 0)
    head += struct.pack(">ii", 10 if dims else 0, len(dims)) + b"".join(text(d) + struct.pack(">i", n) for d, n in dims.items())
    head += attrs(attributes or {})

    def table(begin: int) -> tuple[bytes, dict[str, int]]:
        out, begins = struct.pack(">ii", 11, len(variables)), {}
        for name, (own, kind, size, a) in variables.items():
            begins[name] = begin
            out += text(name) + struct.pack(">i", len(own)) + b"".join(struct.pack(">i", names.index(d)) for d in own)
            out += attrs(a) + struct.pack(">iiq", _CODES[kind], _padded(size) if size < 2**31 - 4 else -1, begin)
            begin += _padded(size)
        return out, begins

    start = len(head) + len(table(0)[0])
    body, begins = table(start)
    return head + body, begins


def write_classic(path: str, dims: dict[str, int], variables: dict[str, tuple[list[str], np.ndarray, dict]], attributes: dict | None = None) -> None:
    """A classic netCDF file of whole arrays (fixed dimensions) that the driver holds; sink.py writes tables."""
    arrays = {name: np.asarray(x) for name, (_, x, _) in variables.items()}
    bodies = {name: (x if x.dtype.kind == "S" else x.astype(f">{x.dtype.str[1:]}")).tobytes() for name, x in arrays.items()}
    head, _ = layout(dims, {name: (own, arrays[name].dtype.str[1:], len(bodies[name]), a) for name, (own, _, a) in variables.items()}, attributes)
    with open(path, "wb") as f:
        f.write(head)
        for body in bodies.values():
            f.write(body.ljust(_padded(len(body)), b"\0"))


def characters(strings: list[str]) -> np.ndarray:
    """Strings as a matrix of single bytes, padded with blanks: what a character variable holds."""
    raw = [s.encode() for s in strings]
    width = max(map(len, raw), default=0) or 1
    return np.array([list(r.ljust(width)) for r in raw], np.uint8).view("S1").reshape(len(raw), width)


def read_characters(path: str, name: str, separator: str | None = None) -> list[str]:
    """The strings of a character variable, blanks stripped; a single string is split at a separator."""
    f = ClassicFile(path)
    shape = f.shape(name)
    if f.vars[name]["kind"] != 2:
        raise ValueError(f"{path}: {name} holds no characters")
    z = f.steps(name, 0, shape[0]).reshape(-1 if len(shape) > 1 else 1, shape[-1])
    got = [b"".join(row.tolist()).rstrip(b" \0").decode("utf-8", "replace") for row in z]
    if separator is not None and len(got) == 1:
        return [s.strip() for s in got[0].split(separator) if s.strip()]
    return got


def contents(path: str) -> tuple[dict[str, int], dict[str, tuple[list[str], np.ndarray, dict]], dict]:
    """Dimensions, variables and attributes of a classic file, as write_classic() takes them."""
    f = ClassicFile(path)
    dims = {name: size or f.records for name, size in f.dims}
    variables = {}
    for name, v in f.vars.items():
        shape = f.shape(name)
        x = f.steps(name, 0, shape[0] if shape else 1)
        variables[name] = (v["dims"], x if shape else x.reshape(()), v["attributes"])
    return dims, variables, f.attributes


def update_classic(path: str, dims: dict[str, int] | None = None, variables: dict | None = None, attributes: dict | None = None, of: dict[str, dict] | None = None, only_new: bool = False) -> None:
    """Add to a classic file, or create it: dimensions, variables, global attributes, and attributes `of` variables.

    The file is written again as a whole. only_new leaves attributes that are there already.
    """
    try:
        old = contents(path)
    except FileNotFoundError:
        old = ({}, {}, {})
    merged = (lambda a, b: {**b, **a}) if only_new else (lambda a, b: {**a, **b})
    every = {**old[1], **(variables or {})}
    for name, extra in (of or {}).items():
        own, x, a = every[name]
        every[name] = (own, x, merged(a, extra))
    write_classic(path, {**old[0], **(dims or {})}, every, merged(old[2], attributes or {}))


def has_variable(path: str, name: str) -> bool:
    return name in ClassicFile(path).vars


def _attributes_of(path: str, variable: str | None) -> dict:
    f = ClassicFile(path)
    return f.attributes if variable is None else f.vars.get(variable, {"attributes": {}})["attributes"]


def has_attribute(path: str, name: str, variable: str | None = None) -> bool:
    """Whether a file, or one of its variables, has an attribute."""
    return name in _attributes_of(path, variable)


def attribute_size(path: str, name: str, variable: str | None = None) -> int:
    """Characters, or numbers, of an attribute; 0 without it."""
    v = _attributes_of(path, variable).get(name)
    return 0 if v is None else len(v) if isinstance(v, (str, list)) else 1


def read_attribute(path: str, name: str, variable: str | None = None):
    return _attributes_of(path, variable)[name]


#: Standard attributes of dimensions by their usual names.
STANDARD_DIMENSIONS = {
    "lon": {"standard_name": "longitude", "long_name": "longitude", "units": "degrees_east", "axis": "X"},
    "lat": {"standard_name": "latitude", "long_name": "latitude", "units": "degrees_north", "axis": "Y"},
    "x": {"standard_name": "projection_x_coordinate", "axis": "X"},
    "y": {"standard_name": "projection_y_coordinate", "axis": "Y"},
    "z": {"standard_name": "height", "long_name": "height", "positive": "up", "axis": "Z"},
    "time": {"standard_name": "time", "long_name": "time", "axis": "T"},
}


def standard_attributes(path: str) -> None:
    """Standard attributes for the coordinate variables of a file, where they are not set."""
    names = ClassicFile(path).vars
    update_classic(path, of={k: v for k, v in STANDARD_DIMENSIONS.items() if k in names}, only_new=True)


def grid_mapping(system: CoordSystem, x_e: float = 0.0, y_n: float = 0.0) -> dict:
    """Attributes of the variable that names a file's projection."""
    out: dict = {"grid_mapping_name": {"lambert_azimuthal_equal_area": "lambert_azimuthal_equal_area"}.get(system.mtype, system.mtype)}
    if system.mtype == "rotated_pole":
        out["grid_mapping_name"] = "rotated_latitude_longitude"
        out |= {"grid_north_pole_longitude": system.lon, "grid_north_pole_latitude": system.lat}
    elif system.is_projection:
        out["longitude_of_projection_origin" if system.mtype != "polar_stereographic" else "straight_vertical_longitude_from_pole"] = system.lon
        out["latitude_of_projection_origin"] = system.lat if system.mtype != "polar_stereographic" else math.copysign(90.0, system.lat)
        if system.mtype == "stereographic":
            out |= {"angle_of_oblique_tangent": system.alpha, "scale_factor_at_projection_origin": 1.0}
        if system.mtype == "polar_stereographic":
            out["standard_parallel"] = math.copysign(90.0 - system.alpha, system.lat)
        out |= {"false_easting": x_e, "false_northing": y_n}
    out["semi_major_axis"] = system.planet.a
    if system.planet.f:
        out["inverse_flattening"] = 1 / system.planet.f
    return out


def write_grid(g: Grid, path: str, columns: DataFrame) -> None:
    """A grid's axes, projection, and 2-D fields (cell and further columns, such as lon, lat, area, border) as a classic file."""
    from gridwake.sources.sink import write_arrays

    own = [("x", g.x), ("y", g.y)] if g.system.is_cartesian else [("lon", g.x), ("lat", g.y)]
    dims = {name: a.n for name, a in own}
    unit = g.system.units if g.system.is_cartesian else None
    variables: dict = {name: ([name], np.array([a.centre(i) for i in range(1, a.n + 1)]), dict(STANDARD_DIMENSIONS[name], **({"units": unit} if unit else {}))) for name, a in own}
    extra = {"missing_value": MISSING, **({"grid_mapping": "crs"} if g.system.is_projection else {})}
    for c in columns.columns:
        if c != "cell":
            variables[c] = (["y", "x"] if g.system.is_cartesian else ["lat", "lon"], columns.select((F.col("cell") - 1).alias("at"), F.col(c).cast("double").alias("v")), extra)
    if g.system.is_projection:
        variables["crs"] = ([], np.int32(0), grid_mapping(g.system))
    write_arrays(columns.sparkSession, path, dims, variables, {"name": g.name, "mtype": g.system.mtype})


def write_points(points: DataFrame, path: str, key: str = "pt") -> None:
    """Points (key and further numeric columns) as a classic file with one dimension `point`."""
    from gridwake.sources.sink import positions, write_arrays

    placed, n = positions(points, [key])
    variables = {c: (["point"], placed.select("at", F.col(c).cast("double").alias("v")), {"missing_value": MISSING}) for c in points.columns}
    write_arrays(points.sparkSession, path, {"point": n}, variables)


# --- series and fields by kind of file ------------------------------------------------------------


def is_netcdf(path: str) -> bool:
    return path.rsplit(".", 1)[-1].lower() in ("nc", "nc4", "cdf", "netcdf")


def read_channels(path: str, variable: str, time: str | None = None, sigma: str | None = None) -> pd.DataFrame:
    """(time, channel, value, sigma) of a netCDF variable of time, or of time and channels in either order.

    The time axis is the dimension of that name, else the one that is as long as the time variable.
    """
    f = ClassicFile(path)
    whole = lambda n: f.steps(n, 0, f.shape(n)[0]).astype(float)
    dims, shape = f.vars[variable]["dims"], f.shape(variable)
    time = time or next((n for n in ("time", "t", "year", *dims) if n in f.vars), None)
    if time is None:
        raise ValueError(f"{path}: no time variable")
    t = whole(time)
    own = f.vars[time]["dims"][0]
    axis = dims.index(own) if own in dims else dims.index(time) if time in dims else shape.index(len(t))
    along = lambda n: np.moveaxis(whole(n), axis, 0).reshape(len(t), -1)
    z = along(variable)
    s = along(sigma) if sigma and sigma in f.vars else np.full(z.shape, np.nan)
    n = z.shape[1]
    return pd.DataFrame({"time": np.repeat(t, n), "channel": np.tile(np.arange(1, n + 1), len(t)), "value": z.ravel(), "sigma": s.ravel()})


def load_series(spark: SparkSession, path: str, variable: str = "", time: str | None = None, sigma: str | None = None) -> DataFrame:
    """(time, channel, value, sigma) from an ASCII table or a netCDF file, by the name's ending."""
    if not is_netcdf(path):
        return read_series(spark, path).withColumn("sigma", F.lit(None).cast("double"))
    rows = spark.createDataFrame(read_channels(path, variable, time, sigma))
    absent = lambda c: F.when(~F.isnan(c) & (F.col(c) != MISSING), F.col(c)).alias(c)
    return rows.select("time", "channel", absent("value"), absent("sigma")).where("value is not null")


def series_from_namelist(spark: SparkSession, nl, group: str) -> DataFrame:
    """The series that a namelist group names: filename, and for netCDF varname, time_name, sigma_name."""
    path = nl.get(group, "filename")
    if not is_netcdf(path):
        return load_series(spark, path)
    return load_series(spark, path, *(nl.get(group, k) for k in ("varname", "time_name", "sigma_name")))


def read_remapped(spark: SparkSession, path: str, links: DataFrame | None, sizes: tuple[int, int], variable: str | None = None, kind: str = "double", keys: list[str] | None = None, dims: tuple[str, str] = ("i", "j")) -> DataFrame:
    """A field of a file on the grid of some links' targets: (dst, keys, value).

    A field that has the target's sizes (nx, ny) already, or comes without links, passes through. kind: double,
    integer (rounded) or logical (a half and more). Files are Parquet, or classic netCDF with a variable.
    """
    from gridwake.operators.links import apply

    i, j = dims
    if variable is None:
        field = read_slab(spark, path)
    else:
        field = spark.read.format("classic_netcdf").option("path", path).option("variable", variable).load()
    own = shape(field, [i, j])
    cells = field.select(((F.col(j) - 1) * own[i] + F.col(i)).cast("long").alias("src"), *(keys or []), "value")
    if links is None or (own[i], own[j]) == tuple(sizes):
        out = cells.withColumnRenamed("src", "dst")
    else:
        out = apply(links, cells, "mean", keys=keys)
    value = {"double": F.col("value"), "integer": F.round("value").cast("int"), "logical": F.col("value") >= 0.5}[kind]
    return out.select("dst", *(keys or []), value.alias("value"))


def to_classic(df: DataFrame, path: str, indices: list[str], value: str = "value", units: str = "") -> None:
    """One field (1-based indices, value) to one classic file, each task writing a range of it; cells without a row are missing."""
    from gridwake.sources.sink import write_arrays

    size = shape(df, indices)
    at = F.lit(0).cast("long")
    for c in indices:
        at = at * size[c] + F.col(c) - 1
    variables = {value: (indices, df.select(at.alias("at"), F.col(value).cast("double").alias("v")), {"missing_value": MISSING, "units": units})}
    write_arrays(df.sparkSession, path, size, variables)


def numbered(df: DataFrame, order: str, name: str = "t_idx") -> DataFrame:
    """Steps numbered from 1 in order, for tables as short as a time axis."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(order)))


def describe_columns(df: DataFrame) -> pd.DataFrame:
    """name, type and metadata of each column."""
    return pd.DataFrame([(f.name, f.dataType.simpleString(), dict(f.metadata)) for f in df.schema.fields], columns=["name", "type", "metadata"])
