"""Grid geometry on the driver, with column expressions for rows, columns and coordinates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """A regular grid: upper-left corner, cell size, extent in rows and columns."""

    rows: int
    cols: int
    cellsize: float
    xul: float
    yul: float

    @classmethod
    def parse(cls, text: str) -> "GridSpec":
        """From `cols rows cellsize xul yul`."""
        cols, rows, size, x, y = text.split()
        return cls(int(rows), int(cols), float(size), float(x), float(y))

    def row_of(self, lat: Column) -> Column:
        return F.floor((F.lit(self.yul) - lat) / self.cellsize).cast("int")

    def col_of(self, lon: Column) -> Column:
        return F.floor((lon - F.lit(self.xul)) / self.cellsize).cast("int")

    def lat_of(self, row: Column) -> Column:
        return F.lit(self.yul) - (row + 0.5) * self.cellsize

    def lon_of(self, col: Column) -> Column:
        return F.lit(self.xul) + (col + 0.5) * self.cellsize

    def contains(self, row: Column, col: Column) -> Column:
        return row.between(0, self.rows - 1) & col.between(0, self.cols - 1)

    def cell_id(self, row: Column, col: Column) -> Column:
        return row.cast("long") * self.cols + col

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cells of the rectangle, made in parallel."""
        return spark.range(self.rows * self.cols).select(
            F.col("id").alias("cell_id"),
            F.expr(f"cast(id div {self.cols} as int)").alias("row"),
            (F.col("id") % self.cols).cast("int").alias("col"),
        )

    def ratio_to(self, coarse: "GridSpec") -> "GridRatio":
        """How this fine grid lies in a coarse one: cell ratio and offset in fine cells."""
        ratio = round(coarse.cellsize / self.cellsize)
        if ratio < 1 or abs(coarse.cellsize / self.cellsize - ratio) > 1e-6:
            raise ValueError("coarse cells must be a whole multiple of fine cells")
        return GridRatio(
            ratio,
            round((coarse.yul - self.yul) / self.cellsize),
            round((self.xul - coarse.xul) / self.cellsize),
        )


@dataclass(frozen=True)
class GridRatio:
    """Fine cells per coarse cell and the fine offset of the upper-left corner."""

    ratio: int
    row_offset: int
    col_offset: int
