"""Potential evaporation and meteorological terms as stateless column expressions.

Temperatures in deg C, radiation in MJ/m2/day, pressures in kPa, results in m/day. All of them stay
inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants of the FAO-56 equations.
STEFAN_BOLTZMANN = 4.903e-9
KELVIN = 273.16
SOLAR_CONSTANT = 0.082
WATT_TO_MJ = 86400 * 1e-6

# Latitude and day that a radiation shortcut of two methods is tied to.
PARITY_LATITUDE, PARITY_DOY = -20.0, 246


def _at_least_zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def saturation_pressure(t: Column) -> Column:
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def vapour_terms(
    tmin: Column, tmax: Column, tavg: Column, psurf: Column, humidity: Column, specific: bool = True
) -> dict[str, Column]:
    """Saturation and actual vapour pressure, psychrometric constant, slope, deficit."""
    esat = (saturation_pressure(tmin) + saturation_pressure(tmax)) / 2
    eact = psurf * humidity / (0.378 * humidity + 0.622) if specific else esat * humidity / 100
    return {
        "esat": esat,
        "eact": eact,
        "psycon": 0.665e-3 * psurf,
        "delta": 4098.0 * esat / F.pow(tavg + 237.3, F.lit(2.0)),
        "deficit": _at_least_zero(esat - eact),
    }


def latent_heat(tavg: Column) -> Column:
    return 2.501 - 0.002361 * tavg


def longwave_up(tmin: Column, tmax: Column) -> Column:
    four = F.lit(4.0)
    return STEFAN_BOLTZMANN * (F.pow(tmin + KELVIN, four) + F.pow(tmax + KELVIN, four)) / 2


def extraterrestrial_radiation(lat: Column, doy: Column, elevation: Column) -> tuple[Column, Column]:
    """(Ra, clear-sky radiation).

    The sunset angle is taken from tan(lat * tan(decl)), as in the original model; the textbook
    has tan(lat) * tan(decl).
    """
    radian = lat * (math.pi / 180)
    angle = 2 * math.pi * doy / 365
    distance = 1 + 0.033 * F.cos(angle)
    decl = 0.409 * F.sin(angle - 1.39)
    ws = F.acos(-F.tan(radian * F.tan(decl)))
    ra = (
        24 * 60 / math.pi * SOLAR_CONSTANT * distance
        * (ws * F.sin(radian) * F.sin(decl) + F.cos(radian) * F.cos(decl) * F.sin(ws))
    )
    return ra, ra * (0.75 + 2e-5 * elevation)


def fixed_day_radiation(elevation: Column) -> tuple[Column, Column]:
    """(Ra, clear-sky radiation) of one latitude and day for all rows, only to repeat runs that did so."""
    return extraterrestrial_radiation(F.lit(PARITY_LATITUDE), F.lit(PARITY_DOY), elevation)


def net_longwave_from_radiation(up: Column, rsds: Column, rso: Column, eact: Column) -> Column:
    cloud = F.least(F.greatest(1.35 * rsds / rso - 0.35, F.lit(0.05)), F.lit(1.0))
    return up * (0.34 - 0.14 * F.sqrt(eact)) * cloud


def psychrometric_at(elevation: Column, heat: Column) -> Column:
    return 0.00163 * (101.3 / heat) * F.pow((293 - 0.0065 * elevation) / 293, F.lit(5.26))


def net_radiation(rsds: Column, longwave: Column, heat: Column, albedo: Column) -> Column:
    return _at_least_zero(((1 - albedo) * rsds - longwave) / heat)


def pet_penman_monteith(
    tmin: Column, tmax: Column, tavg: Column, rsds: Column, longwave: Column, psycon: Column, eact: Column, wind: Column,
    albedo_land: Column, albedo_water: Column, co2: Column | None = None,
) -> dict[str, Column]:
    """Reference and open-water evaporation after FAO-56; with `co2` the wind term follows its concentration."""
    esat = (saturation_pressure(tmin) + saturation_pressure(tmax)) / 2
    delta = 4098.0 * esat / F.pow(tavg + 237.3, F.lit(2.0))
    heat = latent_heat(tavg)
    drag = F.lit(0.34) if co2 is None else 0.34 + 0.00024 * (co2 - 300)
    denominator = delta + psycon * (1 + drag * wind)
    aero = 900 * wind / (tavg + KELVIN) * _at_least_zero(esat - eact) * psycon / denominator
    land = net_radiation(rsds, longwave, heat, albedo_land) * delta / denominator
    water = net_radiation(rsds, longwave, heat, albedo_water) * delta / denominator
    return {"et_ref": (land + aero) * 0.001, "ew_ref": (water + aero) * 0.001}


def pet_energy_only(rsds: Column, longwave: Column, tavg: Column, albedo_land: Column, albedo_water: Column) -> dict[str, Column]:
    heat = latent_heat(tavg)
    return {
        "et_ref": 0.8 * net_radiation(rsds, longwave, heat, albedo_land) * 0.001,
        "ew_ref": 0.8 * net_radiation(rsds, longwave, heat, albedo_water) * 0.001,
    }


def pet_priestley_taylor(
    tmin: Column, tmax: Column, tavg: Column, rsds: Column, longwave: Column, psycon: Column,
    albedo_land: Column, albedo_water: Column,
) -> dict[str, Column]:
    esat = (saturation_pressure(tmin) + saturation_pressure(tmax)) / 2
    delta = 4098.0 * esat / F.pow(tavg + 237.3, F.lit(2.0))
    heat = latent_heat(tavg)
    weight = delta / (delta + psycon)
    return {
        "et_ref": 1.1 * weight * net_radiation(rsds, longwave, heat, albedo_land) * 0.001,
        "ew_ref": 1.26 * weight * net_radiation(rsds, longwave, heat, albedo_water) * 0.001,
    }


def meteo_units(
    precip: Column | None = None, temperature: Column | None = None, radiation: Column | None = None, pressure_hpa: Column | None = None,
    conversion: float = 1.0, kelvin: bool = False, strict: bool = False,
) -> dict[str, Column]:
    """Input units to model units: rain not below 0, K to deg C, W/m2 to MJ/day, hPa to kPa.

    `strict` stops the job at a temperature outside -100..100, the sign of a wrong unit flag.
    """
    out: dict[str, Column] = {}
    if precip is not None:
        out["precip"] = _at_least_zero(precip * conversion)
    if temperature is not None:
        t = temperature - 273.15 if kelvin else temperature
        bad = (t < -100) | (t > 100)
        out["temperature"] = F.when(bad, F.raise_error(F.lit("temperature outside -100..100: check its unit"))).otherwise(t) if strict else t
    if radiation is not None:
        out["radiation"] = radiation * WATT_TO_MJ
    if pressure_hpa is not None:
        out["pressure"] = pressure_hpa * 0.1
    return out


# Elevation quantiles (index into 12) that stand for n snow layers, highest first.
SNOW_BANDS = {
    1: (7,), 2: (9, 5), 3: (9, 7, 5), 4: (11, 8, 5, 3), 5: (11, 9, 7, 5, 3), 6: (11, 9, 7, 5, 3, 1),
    7: (11, 9, 8, 7, 5, 3, 1), 8: (11, 9, 8, 7, 6, 5, 3, 1), 9: (11, 10, 9, 8, 7, 6, 5, 3, 1),
    10: (11, 10, 9, 8, 7, 6, 5, 4, 3, 1),
}
MEDIAN_QUANTILE = 7


def _band_temperatures(tavg: Column, dz: Column, layers: int, lapse: Column) -> list[Column]:
    return [tavg - lapse * (F.get(dz, F.lit(i)) - F.get(dz, F.lit(MEDIAN_QUANTILE))) for i in SNOW_BANDS[layers]]


def _band_precipitation(
    t: Column, precip: Column, snow_factor: Column, temp_snow: Column, low: Column | None, high: Column | None
) -> tuple[Column, Column]:
    if low is not None and high is not None:
        solid = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (t - low) / (high - low)))
        return solid * snow_factor * precip, (1 - solid) * precip
    return F.when(t < temp_snow, snow_factor * precip).otherwise(0.0), F.when(t >= temp_snow, precip).otherwise(0.0)


def _mean(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / len(parts)


def rain_snow_split(
    tavg: Column, precip: Column, dz: Column, layers: int, lapse: Column, snow_factor: Column, temp_snow: Column,
    low: Column | None = None, high: Column | None = None,
) -> dict[str, Column]:
    """Rain and snow as means over elevation bands; the bands are few, so they unroll into one expression."""
    parts = [
        _band_precipitation(t, precip, snow_factor, temp_snow, low, high) for t in _band_temperatures(tavg, dz, layers, lapse)
    ]
    return {"snow": _mean([s for s, _ in parts]), "rain": _mean([r for _, r in parts])}


def melt_coefficient(doy: Column, season: Column, base: Column, day_degrees: float = 360 / 365.25) -> Column:
    """Degree-day factor over the year, smallest in winter."""
    return season * F.sin(F.radians((doy - 81) * day_degrees)) + base


def potential_degree_day_melt(
    tavg: Column, precip: Column, dz: Column, layers: int, lapse: Column, snow_factor: Column, temp_snow: Column,
    temp_melt: Column, coefficient: Column, radiation_factor: Column | None = None, rsds: Column | None = None, rsdl: Column | None = None,
) -> Column:
    """Melt that temperature (and radiation) could cause, mean over bands, before any storage limit."""
    melts = []
    for t in _band_temperatures(tavg, dz, layers, lapse):
        _, rain = _band_precipitation(t, precip, snow_factor, temp_snow, None, None)
        melt = (t - temp_melt) * coefficient
        if radiation_factor is not None:
            up = STEFAN_BOLTZMANN * F.pow(t + KELVIN, F.lit(4.0))
            melt = melt + radiation_factor * (rsds - (up - rsdl)) / 334.0
        melts.append(_at_least_zero(melt * (1 + 0.01 * rain)))
    return _mean(melts)
