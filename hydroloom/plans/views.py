"""Canonical inputs (grids, networks, series, gauges) derived from the driver tables.

`Views` builds them as DataFrames; `VIEW_SQL` holds the same definitions for the oracle. A
deployment replaces this module by its own tables with the schemas of `hydroloom.schemas`.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroloom.grid import GridSpec

GRID_COLS = 50
DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEW_SQL = {
    "cell": """select p_partkey as cell_id, (p_partkey // 50)::int as row, (p_partkey % 50)::int as col,
        p_retailprice as area, p_size as zone from part""",
    "ldd": "select p_partkey as cell_id, case when p_partkey = 0 then null else (p_partkey - 1) // 2 end as down_id from part",
    "ldd_forest": "select p_partkey as cell_id, case when p_partkey < 8 then null else (p_partkey - 1) // 2 end as down_id from part",
    "flow_code": """select cell_id, row, col,
        (case zone % 4 when 0 then 7 when 1 then 8 when 2 then 9 else 6 end)::int as code from cell""",
    "any_code": "select cell_id, row, col, (zone % 10)::int as code from cell",
    "river": """select a.cell_id, b.cell_id as down_id from (
        select cell_id, row, col,
          row + case when code in (7, 8, 9) then -1 when code in (1, 2, 3) then 1 else 0 end as to_row,
          col + case when code in (3, 6, 9) then 1 when code in (1, 4, 7) then -1 else 0 end as to_col
        from flow_code) a left join cell b on b.row = a.to_row and b.col = a.to_col and b.cell_id <> a.cell_id""",
    "gauge": "select s_suppkey as gauge_id, s_suppkey * 3 + 1 as cell_id from supplier",
    "water_body": """select cell_id, row, col,
        (case when (row // 4 + col // 5) % 3 = 0 then (row // 4) * 100 + col // 5 + 1 else 0 end)::int as body
        from cell""",
    "cell_series": """select l_returnflag || l_linestatus as variable, l_shipdate::date as date, l_partkey as cell_id,
        sum(l_quantity) as value from lineitem group by 1, 2, 3""",
    "cell_day": """select l_partkey as cell_id, l_shipdate::date as date, sum(l_quantity) as value
        from lineitem group by 1, 2""",
    "flux_catalog": """select * from (values
        ('NO', 'Rain', 'M', 'Basin', 'Input'), ('NF', 'Snow', 'M3', 'Basin', 'Input'),
        ('AF', 'Evapotranspiration', 'M', 'Basin', 'Output'), ('AO', 'Downstream', 'MS', 'Basin', 'Output'),
        ('RF', 'Groundwater', 'M', 'Basin', 'Storage'), ('RO', 'Lakes', 'M3', 'Basin', 'Storage'),
        ('NO', 'Rain', 'M', 'Soil', 'Input'), ('AF', 'Transpiration', 'M', 'Soil', 'Output'),
        ('RF', 'Soil', 'M', 'Soil', 'Storage'), ('NF', 'Lake inflow', 'M3', 'Lakes', 'Input'),
        ('AO', 'Lake discharge', 'MS', 'Lakes', 'Output'), ('RO', 'Lake storage', 'M3', 'Lakes', 'Storage'))
        t(variable, label, unit_class, section, role)""",
    "pairs": """select l_suppkey as station_id, l_shipdate::date as date,
        sum(l_extendedprice * (1 - l_discount)) / 777 as s,
        case when dayofyear(l_shipdate::date) % 17 = 0 then null else sum(l_extendedprice) / 777 end as o
        from lineitem group by 1, 2""",
    "runs": """select l_linenumber as run_id, l_suppkey as station_id, l_shipdate::date as date,
        sum(l_extendedprice) as q from lineitem group by 1, 2, 3""",
    "demand": """select c_nationkey as region, date_trunc('month', o_orderdate)::date as month,
        o_orderpriority as sector, sum(o_totalprice) / 1e6 as mm3
        from orders join customer on o_custkey = c_custkey group by 1, 2, 3""",
    "station": """select s_suppkey as station_id, s_name as name, (s_suppkey % 40)::double as lat,
        (s_suppkey % 50)::double as lon from supplier""",
    "reading": "select user_id as gauge_id, ts, event_type as variable, value from events",
    "meteo": """select d.cell_id, d.date, d.tavg, d.tavg - 5 as tmin, d.tavg + 6 as tmax,
        8 + 100 * d.disc as rsds, 25 + 50 * d.tax as rsdl, 101.3 - c.area / 100 as psurf,
        0.004 + d.disc / 20 as qair, 0.8 + 10 * d.disc as eact, 1 + 20 * d.disc as wind, d.tavg / 5000 as precip,
        c.row::double + 20 as lat, c.area - 800 as elev
        from (select l_partkey as cell_id, l_shipdate::date as date, avg(l_quantity) / 2 as tavg,
              avg(l_discount) as disc, avg(l_tax) as tax from lineitem group by 1, 2) d
        join cell c using (cell_id)""",
}


class Views:
    """Canonical DataFrames over one directory of driver tables; nothing runs until an action."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Derive an input by SQL that both engines read; views and tables are named after FROM or JOIN."""
        used: dict[str, DataFrame] = {}

        def bind(match: re.Match) -> str:
            word, name = match.group(1), match.group(2)
            if name in VIEW_SQL:
                used[name] = getattr(self, name)
            elif name in DRIVER_TABLES:
                used[name] = self.table(name)
            else:
                return match.group(0)
            return f"{word} {{{name}}}"

        bound = re.sub(r"(?i)\b(from|join)\s+([a-z_]+)\b", bind, text)
        return self.spark.sql(bound, **used)

    @cached_property
    def grid(self) -> GridSpec:
        """Geometry of the `part` grid; the row count comes from parquet footers."""
        rows = -(-self.table("part").count() // GRID_COLS)
        return GridSpec(rows=rows, cols=GRID_COLS, cellsize=1.0, xul=0.0, yul=float(rows))

    @cached_property
    def cell(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("cell_id"),
            F.expr(f"cast(p_partkey div {GRID_COLS} as int)").alias("row"),
            (F.col("p_partkey") % GRID_COLS).cast("int").alias("col"),
            F.col("p_retailprice").alias("area"),
            F.col("p_size").alias("zone"),
        )

    @cached_property
    def ldd(self) -> DataFrame:
        return self._heap(1)

    @cached_property
    def ldd_forest(self) -> DataFrame:
        return self._heap(8)

    def _heap(self, pits: int) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("cell_id"), F.when(key >= pits, F.expr("(p_partkey - 1) div 2")).alias("down_id")
        )

    @cached_property
    def flow_code(self) -> DataFrame:
        z = F.col("zone") % 4
        code = F.when(z == 0, 7).when(z == 1, 8).when(z == 2, 9).otherwise(6)
        return self.cell.select("cell_id", "row", "col", code.alias("code"))

    @cached_property
    def any_code(self) -> DataFrame:
        return self.cell.select("cell_id", "row", "col", (F.col("zone") % 10).alias("code"))

    @cached_property
    def river(self) -> DataFrame:
        from hydroloom.operators.network import ldd_edges

        return ldd_edges(self.flow_code)

    @cached_property
    def gauge(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("gauge_id"), (F.col("s_suppkey") * 3 + 1).alias("cell_id")
        )

    @cached_property
    def water_body(self) -> DataFrame:
        body = F.expr("case when (row div 4 + col div 5) % 3 = 0 then (row div 4) * 100 + col div 5 + 1 else 0 end")
        return self.cell.select("cell_id", "row", "col", body.cast("int").alias("body"))

    @cached_property
    def cell_series(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(
                F.concat("l_returnflag", "l_linestatus").alias("variable"),
                F.to_date("l_shipdate").alias("date"),
                F.col("l_partkey").alias("cell_id"),
            )
            .agg(F.sum("l_quantity").alias("value"))
        )

    @cached_property
    def cell_day(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("cell_id"), F.to_date("l_shipdate").alias("date"))
            .agg(F.sum("l_quantity").alias("value"))
        )

    @cached_property
    def flux_catalog(self) -> DataFrame:
        from hydroloom.operators.balance import small_table

        rows = [
            ("NO", "Rain", "M", "Basin", "Input"), ("NF", "Snow", "M3", "Basin", "Input"),
            ("AF", "Evapotranspiration", "M", "Basin", "Output"), ("AO", "Downstream", "MS", "Basin", "Output"),
            ("RF", "Groundwater", "M", "Basin", "Storage"), ("RO", "Lakes", "M3", "Basin", "Storage"),
            ("NO", "Rain", "M", "Soil", "Input"), ("AF", "Transpiration", "M", "Soil", "Output"),
            ("RF", "Soil", "M", "Soil", "Storage"), ("NF", "Lake inflow", "M3", "Lakes", "Input"),
            ("AO", "Lake discharge", "MS", "Lakes", "Output"), ("RO", "Lake storage", "M3", "Lakes", "Storage"),
        ]
        return small_table(self.spark, rows, "variable string, label string, unit_class string, section string, role string")

    @cached_property
    def pairs(self) -> DataFrame:
        day = F.to_date("l_shipdate")
        sums = (
            self.table("lineitem")
            .groupBy(F.col("l_suppkey").alias("station_id"), day.alias("date"))
            .agg(
                (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 777).alias("s"),
                (F.sum("l_extendedprice") / 777).alias("o"),
            )
        )
        return sums.withColumn("o", F.when(F.dayofyear("date") % 17 != 0, F.col("o")))

    @cached_property
    def runs(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(
                F.col("l_linenumber").alias("run_id"),
                F.col("l_suppkey").alias("station_id"),
                F.to_date("l_shipdate").alias("date"),
            )
            .agg(F.sum("l_extendedprice").alias("q"))
        )

    @cached_property
    def demand(self) -> DataFrame:
        orders = self.table("orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        return (
            orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(
                F.col("c_nationkey").alias("region"),
                F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"),
                F.col("o_orderpriority").alias("sector"),
            )
            .agg((F.sum("o_totalprice") / 1e6).alias("mm3"))
        )

    @cached_property
    def station(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("station_id"),
            F.col("s_name").alias("name"),
            (F.col("s_suppkey") % 40).cast("double").alias("lat"),
            (F.col("s_suppkey") % 50).cast("double").alias("lon"),
        )

    @cached_property
    def reading(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("gauge_id"), "ts", F.col("event_type").alias("variable"), "value"
        )

    @cached_property
    def meteo(self) -> DataFrame:
        day = (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("cell_id"), F.to_date("l_shipdate").alias("date"))
            .agg(
                (F.avg("l_quantity") / 2).alias("tavg"),
                F.avg("l_discount").alias("disc"),
                F.avg("l_tax").alias("tax"),
            )
        )
        c = self.cell.select("cell_id", "row", "area")
        return day.join(c, "cell_id").select(
            "cell_id", "date", "tavg",
            (F.col("tavg") - 5).alias("tmin"),
            (F.col("tavg") + 6).alias("tmax"),
            (8 + 100 * F.col("disc")).alias("rsds"),
            (25 + 50 * F.col("tax")).alias("rsdl"),
            (101.3 - F.col("area") / 100).alias("psurf"),
            (0.004 + F.col("disc") / 20).alias("qair"),
            (0.8 + 10 * F.col("disc")).alias("eact"),
            (1 + 20 * F.col("disc")).alias("wind"),
            (F.col("tavg") / 5000).alias("precip"),
            (F.col("row").cast("double") + 20).alias("lat"),
            (F.col("area") - 800).alias("elev"),
        )
