"""Scalar functions of the library as temporary SQL functions of a session.

Bodies are SQL expressions, so calls are inlined into the plan like built-in functions. Aggregate
scores stay `Column` functions (`hydroloom.functions.skill`): SQL functions take scalars only.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# name -> (parameters, return type, body)
FUNCTIONS = {
    "hl_safe_divide": ("x DOUBLE, y DOUBLE", "DOUBLE", "CASE WHEN y = 0 THEN CASE WHEN x IS NOT NULL THEN 0D END ELSE x / y END"),
    "hl_clamp_fraction": ("x DOUBLE", "DOUBLE", "CASE WHEN x IS NOT NULL THEN greatest(0D, least(1D, x)) END"),
    "hl_null_meteo": ("v DOUBLE", "DOUBLE", "CASE WHEN isnan(v) OR v > 1e15 THEN NULL ELSE v END"),
    "hl_unit_to_volume": (
        "v DOUBLE, area DOUBLE, unit_class STRING", "DOUBLE",
        "CASE unit_class WHEN 'M' THEN v * area WHEN 'M3' THEN v WHEN 'MS' THEN v * 86400 END",
    ),
    "hl_env_flow_vmf": (
        "mmf DOUBLE, maf DOUBLE", "DOUBLE",
        "CASE WHEN mmf <= 0.4D * maf THEN 0.6D * mmf WHEN mmf > 0.8D * maf THEN 0.3D * mmf ELSE 0.45D * mmf END",
    ),
    "hl_water_temperature": ("tavg DOUBLE", "DOUBLE", "3D + 25D / (1D + exp(0.18D * (14D - tavg)))"),
    "hl_period_end": (
        "d DATE", "INT", "CASE WHEN month(d) = 12 AND day(d) = 31 THEN 2 WHEN d = last_day(d) THEN 1 ELSE 0 END",
    ),
    "hl_month_start": ("d DATE", "DATE", "CAST(trunc(d, 'MM') AS DATE)"),
    "hl_year_end": ("d DATE", "DATE", "make_date(year(d), 12, 31)"),
    "hl_days_in_month": ("d DATE", "INT", "day(last_day(d))"),
    "hl_days_in_year": ("d DATE", "INT", "dayofyear(make_date(year(d), 12, 31))"),
    "hl_slot10": ("d DATE", "INT", "CAST(floor((dayofyear(d) - 1) / 10) AS INT)"),
    "hl_slot30": ("d DATE", "INT", "CAST(floor((dayofyear(d) - 1) / 30) AS INT)"),
    "hl_step_index": ("d DATE, start_day DATE", "INT", "datediff(d, start_day) + 1"),
    "hl_flow_length": ("code INT, length DOUBLE", "DOUBLE", "CASE WHEN code IN (1, 3, 7, 9) THEN 1.414214D * length ELSE length END"),
    "hl_infiltration_capacity": (
        "water DOUBLE, capacity DOUBLE, shape DOUBLE", "DOUBLE",
        "capacity / (shape + 1D) * pow(1D - greatest(0D, least(1D, pow(greatest(0D, water / capacity), shape))), (shape + 1D) / shape)",
    ),
    "hl_denormalise": ("p DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "p * (high - low) + low"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for name, (parameters, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return list(FUNCTIONS)
