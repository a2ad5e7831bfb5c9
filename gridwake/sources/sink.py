"""Tables as variables of one array file, written in parallel.

The driver makes a new file of the final size beside the target: header, and arrays that it holds anyway. Cells are dealt by
their place in the file, so that each task writes a run of bytes of its own, and a task that runs again writes the same
bytes. When all cells have been counted the file takes the target's name; otherwise it is removed, and the target stays
as it was. Executors must see the target's folder at the same path (a shared mount): stores without writes inside a
file take Parquet (arrays.write_field).

Defined results: cells without a row or value are the sentinel; of rows of one cell the largest value counts; an
empty variable has no cells.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gridwake.model import MISSING
from gridwake.operators.solvers import cut
from gridwake.sources.arrays import _padded, layout

#: Cells that a task writes, about.
CELLS = 1 << 22


@dataclass
class Written(WriterCommitMessage):
    cells: int


class CellWriter(DataSourceArrowWriter):
    def __init__(self, path: str, parts: list, expected: int):
        self.path, self.parts, self.expected = path, parts, expected

    def write(self, iterator) -> Written:
        n = 0
        with open(self.path, "r+b") as f:
            for batch in iterator:
                at, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                n += len(at)
                for begin, end, code in self.parts:
                    own = (at >= begin) & (at < end)
                    places, values = at[own], v[own].astype(f">{code}")
                    for run in np.split(np.arange(len(places)), np.flatnonzero(np.diff(places) != values.itemsize) + 1):
                        if len(run):
                            f.seek(int(places[run[0]]))
                            f.write(values[run].tobytes())
        return Written(n)

    def commit(self, messages) -> None:
        n = sum(m.cells for m in messages if m is not None)
        if n != self.expected:
            raise ValueError(f"{self.path}: {n} cells written, {self.expected} expected")

    def abort(self, messages) -> None:
        """The caller removes the file."""


class CellSink(DataSource):
    """(place in the file, value) rows into a file that is there; see write_arrays()."""

    @classmethod
    def name(cls) -> str:
        return "classic_netcdf_cells"

    def writer(self, schema, overwrite) -> CellWriter:
        return CellWriter(self.options["path"], json.loads(self.options["parts"]), int(self.options["expected"]))


def positions(df: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """df with `at`, its rows' places (from 0) in order of the columns, and how many there are: no task sees all rows."""
    placed = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    counts = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("first")).orderBy("_part").collect()  # a row a partition
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["_part"], before - r["first"]))
        before += r["n"]
    known = df.sparkSession.createDataFrame(offsets, "_part int, _shift long")
    return placed.join(F.broadcast(known), "_part").withColumn("at", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift"), before


def write_arrays(spark: SparkSession, path: str, dims: dict[str, int], variables: dict, attributes: dict | None = None) -> None:
    """A classic file. variables: (dimensions, array or table of (at, v), attributes[, f8 or i4]); at is the cell's place, from 0."""
    if "://" in path:
        raise ValueError(f"{path}: array files are written at paths that all executors share")
    n = {name: int(np.prod([dims[d] for d in v[0]], dtype=int)) for name, v in variables.items()}
    held = {name: np.asarray(v[1]) for name, v in variables.items() if not isinstance(v[1], DataFrame)}
    code = {name: held[name].dtype.str[1:] if name in held else (*v, "f8")[3] for name, v in variables.items()}
    size = {name: n[name] * int(code[name][1:]) for name in variables}
    head, begin = layout(dims, {name: (list(v[0]), code[name], size[name], v[2]) for name, v in variables.items()}, attributes)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(head)
        for name, x in held.items():
            f.seek(begin[name])
            f.write(x.astype(f">{code[name]}").tobytes())
        f.truncate(max([len(head), *(begin[k] + _padded(size[k]) for k in variables)]))
    try:
        cells = None
        for name, v in variables.items():
            if name not in held and n[name]:
                values = v[1].groupBy("at").agg(F.max("v").alias("v"))
                every = spark.range(n[name]).select(F.col("id").alias("at")).join(values, "at", "left")
                value = F.coalesce(F.nanvl("v", F.lit(MISSING)), F.lit(MISSING))
                rows = every.select((F.col("at") * int(code[name][1:]) + begin[name]).alias("place"), value.alias("v"))
                cells = rows if cells is None else cells.unionByName(rows)
        if cells is not None:
            expected = sum(n[k] for k in variables if k not in held)
            parts = [(begin[k], begin[k] + size[k], code[k]) for k in variables if k not in held]
            spark.dataSource.register(CellSink)
            dealt = cells.repartitionByRange(max(1, -(-expected // CELLS)), "place").sortWithinPartitions("place")
            dealt.write.format("classic_netcdf_cells").option("path", temporary).option("parts", json.dumps(parts)).option("expected", str(expected)).mode("append").save()
        os.replace(temporary, path)
    except BaseException:
        os.remove(temporary)
        raise
