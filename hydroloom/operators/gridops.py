"""Clipping, resampling and map extraction on long grid tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroloom.functions.clean import MAP_SENTINEL, cap_display, display_radius, safe_divide
from hydroloom.grid import GridRatio, GridSpec
from hydroloom.operators.keyed import counted, tasks_for


def clip_to_box(cells: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """Rows and columns in the half-open box, counted from its corner. The filter reaches the scan."""
    r, c = F.col("row"), F.col("col")
    return (
        cells.filter((r >= row0) & (r < row1) & (c >= col0) & (c < col1))
        .withColumn("row", r - row0).withColumn("col", c - col0)
    )


def clip_ldd_edges(codes: DataFrame, rows: int, cols: int) -> DataFrame:
    """Codes after a clip: invalid ones are missing, cells that flow over an edge become pits.

    The lower edge is treated like the other three; missing cells stay missing.
    """
    code = F.when((F.col("code") > 9) | (F.col("code") < 0), 0).otherwise(F.col("code"))
    over = (
        ((F.col("row") == 0) & code.isin(7, 8, 9)) | ((F.col("row") == rows - 1) & code.isin(1, 2, 3))
        | ((F.col("col") == 0) & code.isin(1, 4, 7)) | ((F.col("col") == cols - 1) & code.isin(3, 6, 9))
    )
    return codes.withColumn("code", F.when(over, 5).otherwise(code))


def mask_cells(codes: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells of the mask whose network code is not missing."""
    return codes.filter(F.col("code") > 0).join(mask.select("cell_id"), "cell_id", "left_semi")


def mask_from_rectangle(spark: SparkSession, text: str) -> DataFrame:
    """All cells of a rectangle given as `cols rows cellsize xul yul`."""
    return GridSpec.parse(text).cells(spark)


def cell_of_point(points: DataFrame, grid: GridSpec, strict: bool = False) -> DataFrame:
    """Row, column and id of the cell that holds a point; outside points are flagged, or stop the job."""
    row, col = grid.row_of(F.col("lat")), grid.col_of(F.col("lon"))
    inside = grid.contains(row, col)
    out = points.withColumn("row", row).withColumn("col", col).withColumn("in_grid", inside)
    cell = grid.cell_id(F.col("row"), F.col("col"))
    outside = F.raise_error(F.lit("point outside the grid")) if strict else F.lit(None)
    return out.withColumn("cell_id", F.when(F.col("in_grid"), cell).otherwise(outside.cast("long")))


def coord_of_cell(cells: DataFrame, grid: GridSpec) -> DataFrame:
    return cells.withColumn("lat", grid.lat_of(F.col("row"))).withColumn("lon", grid.lon_of(F.col("col")))


def compact_box(cells: DataFrame, zone: str, grid: GridSpec) -> DataFrame:
    """Smallest box around each zone with its upper-left corner."""
    return cells.groupBy(zone).agg(
        F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1")
    ).withColumn("xul", F.lit(grid.xul) + F.col("col0") * grid.cellsize).withColumn(
        "yul", F.lit(grid.yul) - F.col("row0") * grid.cellsize
    )


def move_to_box(cells: DataFrame, boxes: DataFrame, zone: str) -> DataFrame:
    """Cells with rows and columns counted from the corner of their zone's box."""
    joined = cells.join(boxes.select(zone, "row0", "col0"), zone)
    return joined.withColumn("row", F.col("row") - F.col("row0")).withColumn("col", F.col("col") - F.col("col0")).drop("row0", "col0")


def _block(n: int, ratio: GridRatio | None) -> tuple[Column, Column]:
    dr, dc = (ratio.row_offset, ratio.col_offset) if ratio else (0, 0)
    return F.floor((F.col("row") + dr) / n).cast("int"), F.floor((F.col("col") + dc) / n).cast("int")


def coarse_cell(fine: DataFrame, ratio: GridRatio) -> DataFrame:
    """Row and column of the coarse cell that holds each fine cell."""
    row, col = _block(ratio.ratio, ratio)
    return fine.withColumn("coarse_row", row).withColumn("coarse_col", col)


def grid_refine(fine: DataFrame, coarse: DataFrame, n: int, value: str = "value", keys: list[str] = (), ratio: GridRatio | None = None) -> DataFrame:
    """Copy a coarse value to its fine cells; cells outside the coarse grid drop."""
    row, col = _block(n, ratio)
    right = coarse.select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), value)
    return fine.withColumn("_r", row).withColumn("_c", col).join(right, ["_r", "_c"]).drop("_r", "_c")


def _with_block_mean(fine: DataFrame, n: int, value: str) -> DataFrame:
    from hydroloom.operators.keyed import with_group

    row, col = _block(n, None)
    clean = F.nanvl(F.col(value), F.lit(None).cast("double"))
    return with_group(fine.withColumn("_r", row).withColumn("_c", col), ["_r", "_c"], _mean=F.avg(clean))


def delta_temperature(fine: DataFrame, coarse: DataFrame, n: int) -> DataFrame:
    """Coarse value plus the anomaly of the fine climate about its block mean; the coarse value where unknown."""
    joined = _joined(fine, coarse, n)
    return joined.withColumn("value", F.coalesce(F.col("climate") - F.col("_mean") + F.col("coarse"), F.col("coarse"))).drop("_mean", "coarse")


def delta_precip(fine: DataFrame, coarse: DataFrame, n: int) -> DataFrame:
    """Coarse value scaled by the fine climate over its block mean; the coarse value where unknown."""
    joined = _joined(fine, coarse, n)
    scaled = F.col("coarse") * safe_divide(F.col("climate"), F.col("_mean"))
    return joined.withColumn("value", F.coalesce(scaled, F.col("coarse"))).drop("_mean", "coarse")


def _joined(fine: DataFrame, coarse: DataFrame, n: int) -> DataFrame:
    right = coarse.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias("coarse"), *[c for c in coarse.columns if c not in ("row", "col", "value")])
    return _with_block_mean(fine, n, "climate").join(right, ["_r", "_c"]).drop("_r", "_c")


def _patches(coarse: DataFrame, rows: int, cols: int, value: str, keys: list[str]) -> DataFrame:
    """Per lower corner (r0, c0) the four values around a patch, edges repeated.

    Each coarse cell is sent to the few patches it is a corner of, so fine cells need one join. Patches are dealt by their
    place over tasks that hold so many corners, and the join finds them there.
    """

    def corners(axis: str, n: int) -> Column:
        x = F.col(axis)
        own = F.array(F.struct(x.alias("o"), F.lit(0).alias("p")), F.struct((x - 1).alias("o"), F.lit(1).alias("p")))
        first = F.when(x == 0, F.array(F.struct((x - 1).alias("o"), F.lit(0).alias("p")))).otherwise(F.slice(own, 1, 0))
        last = F.when(x == n - 1, F.array(F.struct(x.alias("o"), F.lit(1).alias("p")))).otherwise(F.slice(own, 1, 0))
        return F.concat(own, first, last)

    table, n = counted(coarse.select(*keys, "row", "col", value))
    spread = table.withColumn("_y", F.explode(corners("row", rows))).withColumn("_x", F.explode(corners("col", cols)))
    corner = spread.select(
        *keys, value, F.col("_y.o").cast("int").alias("_r0"), F.col("_x.o").cast("int").alias("_c0"), (F.col("_y.p") * 2 + F.col("_x.p")).alias("_p")
    ).repartition(tasks_for(n * 4), "_r0", "_c0")
    return corner.groupBy(*keys, "_r0", "_c0").agg(
        *[F.max(F.when(F.col("_p") == i * 2 + j, F.col(value))).alias(f"_v{i}{j}") for i in (0, 1) for j in (0, 1)]
    )


def interpolate(
    fine: DataFrame, coarse: DataFrame, n: int, rows: int, cols: int, value: str, alignment: str = "centre", keys: list[str] = ()
) -> DataFrame:
    """Bilinear value of a coarse map at fine cells, for each of its `keys` (a date, say).

    `centre` aligns cell centres and repeats the edges; `zoom` stretches the first and last cells
    onto each other.
    """

    def position(axis: str, count: int) -> Column:
        i = F.col(axis)
        if alignment == "centre":
            return (i + 0.5) / n - 0.5
        if alignment == "zoom":
            return i * ((count - 1) / (n * count - 1))
        raise ValueError(f"unknown alignment {alignment!r}")

    y, x = position("row", rows), position("col", cols)
    placed = fine.withColumn("_r0", F.floor(y).cast("int")).withColumn("_c0", F.floor(x).cast("int"))
    joined = placed.join(_patches(coarse, rows, cols, value, list(keys)), ["_r0", "_c0"])
    fy, fx = y - F.col("_r0"), x - F.col("_c0")
    low = F.col("_v00") * (1 - fx) + F.col("_v01") * fx
    high = F.col("_v10") * (1 - fx) + F.col("_v11") * fx
    return joined.withColumn(value, low * (1 - fy) + high * fy).drop("_r0", "_c0", "_v00", "_v01", "_v10", "_v11")


def delta_interpolated(
    fine: DataFrame, coarse: DataFrame, n: int, rows: int, cols: int, kind: str, alignment: str = "centre", keys: list[str] = ()
) -> DataFrame:
    """Correct a fine climate by an interpolated coarse difference (`temperature`) or ratio (`precip`).

    `coarse(keys, row, col, value)`; the climate is one map, so its block means are joined once.
    """
    from hydroloom.operators.zonal import grid_coarsen

    mean = grid_coarsen(fine.select("row", "col", "climate"), n, "climate")
    both = coarse.select(*keys, "row", "col", "value").join(mean, ["row", "col"])
    if kind == "temperature":
        factor = both.select(*keys, "row", "col", (F.col("climate") - F.col("value")).alias("_delta"))
    elif kind == "precip":
        factor = both.select(*keys, "row", "col", safe_divide(F.col("value"), F.col("climate")).alias("_delta"))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    smooth = interpolate(fine, factor, n, rows, cols, "_delta", alignment, keys)
    value = F.col("climate") - F.col("_delta") if kind == "temperature" else F.col("climate") * F.col("_delta")
    return smooth.withColumn("value", value).drop("_delta")


def _step_date(series: DataFrame, step: int) -> Column:
    """Date of a 0-based daily step; negative steps count from the end."""
    if step >= 0:
        return F.date_add(series.select(F.min("date")).scalar(), step)
    return F.date_add(series.select(F.max("date")).scalar(), step + 1)


def map_step(series: DataFrame, step: int, keys: list[str] = ("cell_id",)) -> DataFrame:
    return series.filter(F.col("date") == _step_date(series, step)).select(*keys, "value")


def map_delta(series: DataFrame, step: int, base: int, keys: list[str] = ("cell_id",)) -> DataFrame:
    """Map at a step minus map at another, for cells present in both; one scan, no self join."""
    a, b = _step_date(series, step), _step_date(series, base)
    d = F.col("date")
    g = series.filter((d == a) | (d == b)).groupBy(*keys).agg(
        (F.sum(F.when(d == a, F.col("value"))) - F.sum(F.when(d == b, F.col("value")))).alias("value")
    )
    return g.filter(F.col("value").isNotNull())


def map_sum(series: DataFrame, keys: list[str] = ("cell_id",)) -> DataFrame:
    """Sum over all steps, each counted once."""
    return series.groupBy(*keys).agg(F.sum("value").alias("value"))


def valid_cells(values: DataFrame, positive: bool = False) -> DataFrame:
    v = F.col("value")
    return values.filter(v > 0 if positive else v != MAP_SENTINEL)


def map_points(values: DataFrame, cells: DataFrame, grid: GridSpec, positive: bool = True, invert: bool = False) -> DataFrame:
    """(lat, lon, value, radius) rows of a map, ready to draw."""
    shown = valid_cells(values, positive).join(cells.select("cell_id", "row", "col"), "cell_id")
    v = cap_display(100 - F.col("value") if invert else F.col("value"))
    return coord_of_cell(shown, grid).select("cell_id", "lat", "lon", v.alias("value"), display_radius(v).alias("radius"))


def point_series(series: DataFrame, points: DataFrame, grid: GridSpec) -> DataFrame:
    """Series of the nearest cell to each point; latitude and longitude are matched on their own."""
    from hydroloom.operators.joins import nearest_on_grid

    # Rows count from the top, so a tie between two rows goes to the smaller row as well.
    row = nearest_on_grid(F.lit(grid.yul) - F.col("lat"), 0.0, grid.cellsize, grid.rows)
    col = nearest_on_grid(F.col("lon"), grid.xul, grid.cellsize, grid.cols)
    placed = points.withColumn("cell_id", grid.cell_id(row, col))
    return series.join(placed.drop("lat", "lon"), "cell_id")
