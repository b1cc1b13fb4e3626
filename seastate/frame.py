"""Spectra as rows: a DataFrame whose column efth holds each spectrum, and the grid they share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grid import Grid

EFTH = "efth"
#: Rows of an Arrow batch of spectra.
BATCH_ROWS = 2000


@dataclass(frozen=True)
class SpectraFrame:
    """df: any columns and efth ARRAY<DOUBLE>, row-major over (freq, dir). Non-spectral columns ride along."""

    df: DataFrame
    grid: Grid

    def with_df(self, df: DataFrame, grid: Grid | None = None) -> "SpectraFrame":
        return SpectraFrame(df, grid or self.grid)

    @property
    def others(self) -> list[str]:
        return [c for c in self.df.columns if c != EFTH]

    @property
    def spec(self) -> Column:
        return F.col(EFTH)

    def map_spectra(self, efth: Column, grid: Grid | None = None) -> "SpectraFrame":
        return self.with_df(self.df.withColumn(EFTH, efth), grid)

    def to_long(self) -> DataFrame:
        """A row for each bin: other columns, ifreq, freq, df, idir, dir, efth. Coordinates come from literals, not a join."""
        g = self.grid
        at = F.col("__pos")
        freq, df, dir = (F.lit([float(x) for x in v]) for v in (g.f, g.df, g.theta))
        i, j = F.floor(at / g.nd).cast("int"), F.pmod(at, F.lit(g.nd)).cast("int")
        rows = self.df.select(*self.others, F.posexplode(EFTH).alias("__pos", EFTH))
        return rows.select(*self.others, i.alias("ifreq"), F.get(freq, i).alias("freq"), F.get(df, i).alias("df"), j.alias("idir"), F.get(dir, j).alias("dir"), EFTH)

    @staticmethod
    def from_long(df: DataFrame, grid: Grid, keys: list[str]) -> "SpectraFrame":
        """Pack rows with keys, ifreq, idir and efth; missing bins become NaN."""
        pos = F.col("ifreq") * grid.nd + (F.col("idir") if "idir" in df.columns else 0)
        packed = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(pos.cast("int").alias("k"), EFTH))).alias("m"))
        efth = F.transform(F.sequence(F.lit(0), F.lit(grid.size - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(float("nan"))))
        return SpectraFrame(packed.select(*keys, efth.alias(EFTH)), grid)

    def apply(self, op: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray], grid: Grid | None = None, reads: tuple[str, ...] = ()) -> "SpectraFrame":
        """Spectra changed by a numpy function of blocks (n, nf, nd) and the number columns it reads, batch by batch."""
        g, new, names = self.grid, grid or self.grid, self.df.columns
        self.df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                block = unpack(b.column(names.index(EFTH)), g)
                extra = {c: b.column(names.index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in reads}
                out = pack(op(block, extra))
                yield pa.RecordBatch.from_arrays([out if c == EFTH else b.column(i) for i, c in enumerate(names)], names)

        return self.with_df(self.df.mapInArrow(run, self.df.schema), new)

    def explode_parts(self, op: Callable[[np.ndarray, dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]], reads: tuple[str, ...] = (), name: str = "part") -> "SpectraFrame":
        """A row for each part, numbered from 0; a numpy function gives the number of parts of each spectrum of a block and all parts in order."""
        g, names = self.grid, [c for c in self.df.columns if c != name]
        rows = self.df.select(*names)
        schema = T.StructType([*(rows.schema[c] for c in names if c != EFTH), T.StructField(name, T.IntegerType()), T.StructField(EFTH, T.ArrayType(T.DoubleType()))])
        self.df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                block = unpack(b.column(names.index(EFTH)), g)
                extra = {c: b.column(names.index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in reads}
                sizes, parts = op(block, extra)
                rows = np.repeat(np.arange(len(sizes)), sizes)
                at, number = pa.array(rows), pa.array(np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes), pa.int32())
                yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)).take(at) for c in names if c != EFTH), number, pack(parts)], [*(c for c in names if c != EFTH), name, EFTH])

        return self.with_df(rows.mapInArrow(run, schema))


def unpack(column: pa.Array, grid: Grid) -> np.ndarray:
    """A block (n, nf, nd); null spectra and bins are NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if column.null_count == 0 and len(flat) == len(column) * grid.size:
        return flat.reshape(-1, grid.nf, grid.nd)
    out = np.full((len(column), grid.size), np.nan)
    for k, x in enumerate(column.to_pylist()):
        if x is not None:
            if len(x) != grid.size:
                raise ValueError(f"a spectrum of {len(x)} bins on a grid of {grid.size}")
            out[k] = [np.nan if v is None else v for v in x]
    return out.reshape(-1, grid.nf, grid.nd)


def pack(block: np.ndarray) -> pa.Array:
    n, size = len(block), int(np.prod(block.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size) if size else np.zeros(n + 1), pa.int32()), pa.array(np.ascontiguousarray(block).reshape(-1)))
