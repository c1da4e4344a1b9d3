"""Missing values, guarded division and small text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers that stand for "missing" in the input formats.
SERIES_FILL = 1e31
METEO_LIMIT = 1e15
MAP_LIMIT = 1e20
DECOMPRESS_FILL = -9999.0
MAP_SENTINEL = 1200.0


def null_sentinels(v: Column, rule: str = "meteo") -> Column:
    """NULL for NaN and for the marker of a source.

    rules: `meteo` (> 1e15), `series` (1e31), `map` (beyond +-1e20), `decompress` (-9999),
    `observed` (< 0), `run` (< -900).
    """
    bad = {
        "meteo": v > METEO_LIMIT,
        "series": v == SERIES_FILL,
        "map": (v > MAP_LIMIT) | (v < -MAP_LIMIT),
        "decompress": v == DECOMPRESS_FILL,
        "observed": v < 0,
        "run": v < -900,
    }
    if rule not in bad:
        raise ValueError(f"unknown rule {rule!r}, expected one of {sorted(bad)}")
    return F.when(F.isnan(v) | bad[rule], None).otherwise(v)


def safe_divide(x: Column, y: Column, default: float = 0.0) -> Column:
    """x / y, `default` where y is 0; NULL operands stay NULL."""
    return F.when(y == 0, F.when(x.isNotNull(), F.lit(float(default)))).otherwise(x / y)


def clamp_fraction(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """NULL stays NULL (`greatest` and `least` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def normalise_station_name(name: Column) -> Column:
    """Names that are safe in files: umlauts spelled out, separators to single underscores."""
    # Transliterations and the characters that become underscores.
    for old, new in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")):
        name = F.replace(name, F.lit(old), F.lit(new))
    return F.regexp_replace(F.translate(name, ".() ", "____"), "_+", "_")


def station_numeric_id(station_id: Column) -> Column:
    """Number behind the one-letter prefix of an id, NULL when there is none."""
    return F.substring(station_id, 2, 1000).try_cast("int")


def number_format(x: Column) -> Column:
    """Thousands separators, two decimals."""
    return F.format_number(x, 2)


def cap_display(v: Column, limit: float = 5e8) -> Column:
    return F.least(v, F.lit(limit))


def display_radius(v: Column) -> Column:
    return F.greatest(F.lit(1.0), v / 100)


def round_double(x: Column, digits: int) -> Column:
    """`F.round` of a double, in plain arithmetic wherever that gives the same number.

    `F.round` goes through the decimal digits of the double. Away from a tie these name the same whole number of units as a
    product does, and that number over a power of ten (both exact) is the double nearest to the decimal. Ties, large
    numbers and what is no number take the way of `F.round`.
    """
    unit = F.lit(float(10**digits))
    scaled = x * unit
    whole = F.rint(scaled)
    # A product is off by 2**-53 of itself, so far less than a thousandth below 2**40.
    plain = (F.abs(scaled) < F.lit(float(1 << 40))) & (F.abs(scaled - whole) < F.lit(0.499))
    return F.when(plain, (whole + F.lit(0.0)) / unit).otherwise(F.round(x, digits))
