"""Catalogues of balance variables, chosen by option."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroloom.operators.balance import small_table

SCHEMA = "variable string, label string, unit_class string, role string, section string, needs string"

# Variable, label, unit class, role with its section, and the option that adds it.
# A leading "!" means: only without that option.
ROWS = [
    ("storGroundwater", "Groundwater", "M", "Storage", "!coupled"),
    ("storGroundwater", "Groundwater", "M", "Storage_GW", "!coupled"),
    ("sum_capRiseFromGW", "Capillary rise", "M", "Input_GW", "!coupled"),
    ("sum_capRiseFromGW", "Capillary rise", "M", "Output_GW", "!coupled"),
    ("sum_capRiseFromGW", "Capillary rise", "M", "Output_Soil", "!coupled"),
    ("sum_capRiseFromGW", "Capillary rise", "M", "Input_Soil", "!coupled"),
    ("sum_gwRecharge", "GW recharge", "M", "Input_GW", "!coupled"),
    ("nonFossilGroundwaterAbs", "GW pumping", "M", "Output_GW", "limited"),
    ("nonFossilGroundwaterAbs", "GW pumping", "M", "Input_Consumption", "limited"),
    ("unmetDemand", "Fossil water", "M", "Input", "fossil"),
    ("unmetDemand", "Fossil water", "M", "Input_GW", "fossil"),
    ("pot_GroundwaterAbstract", "GW requested", "M", "Input_Consumption", "fossil"),
    ("pot_GroundwaterAbstract", "GW pumping", "M", "Output_GW", "fossil_no_withdrawals"),
    ("GW_Domestic", "GW_Domestic", "M", "Output_GW", "fossil_withdrawals"),
    ("GW_Livestock", "GW_Livestock", "M", "Output_GW", "fossil_withdrawals"),
    ("GW_Industry", "GW_Industry", "M", "Output_GW", "fossil_withdrawals"),
    ("GW_Irrigation", "GW_Irrigation", "M", "Output_GW", "fossil_withdrawals"),
    ("leakage", "Canal leakage", "M3", "Output_LR", "coupled"),
    ("capillar", "Capillary rise", "M", "Output_GW", "coupled"),
    ("capillar", "Capillary rise", "M", "Input_Soil", "coupled"),
    ("modfPumpingM_actual", "GW pumping actual", "M", "Output_GW", "coupled"),
    ("Pumping_daily", "GW requested", "M", "Input_Consumption", "coupled"),
    ("riverbedExchangeM", "Riverbed exchange", "M", "Input_Soil", "coupled"),
    ("leakageIntoRunoff", "Canal leakage (Runoff)", "M", "Input_Soil", "coupled"),
    ("leakageIntoGw", "Canal leakage (GW)", "M", "Input_Soil", "coupled"),
    ("riverbedExchangeM", "Riverbed exchange", "M", "Input_GW", "coupled"),
    ("lakebedExchangeM", "Lakebed exchange", "M", "Input_GW", "coupled"),
    ("lakebedExchangeM", "Lakebed exchange", "M", "Output_LR", "coupled"),
    ("lakebedExchangeM", "Lakebed exchange", "M", "Input_Soil", "coupled"),
    ("leakageIntoGw", "Canal leakage (GW)", "M", "Input_GW", "coupled"),
    ("groundwater_storage_available", "Groundwater", "M", "Storage", "coupled"),
    ("groundwater_storage_available", "Groundwater", "M", "Storage_GW", "coupled"),
    ("prefFlow_GW", "Preferential flow", "M", "Input_GW", "coupled"),
    ("perc3toGW_GW", "Soil percolation", "M", "Input_GW", "coupled"),
    ("smallevapWaterBody", "Small Water bodies evaporation", "M", "Output", "small_lakes"),
    ("smalllakeStorage", "Small Water bodies storage", "M3", "Storage", "small_lakes"),
    ("Rain", "Rain", "M", "Input", ""),
    ("Snow", "Snow", "M", "Input", ""),
    ("totalET", "Evapotranspiration", "M", "Output", ""),
    ("EvapoChannel", "Channel evap.", "M", "Output", ""),
    ("EvapWaterBodyM", "Lake evap.", "M", "Output", ""),
    ("act_nonIrrConsumption", "Consumption", "M", "Output", ""),
    ("channelStorage", "Rivers", "M3", "Storage", ""),
    ("lakeResStorage", "Lakes", "M3", "Storage", ""),
    ("totalSto", "Soil*", "M", "Storage", ""),
    ("unmet_lost", "Non-lost fossil water", "M", "Output", ""),
    ("dis_outlet", "Downstream", "MS", "Output", ""),
    ("sum_actTransTotal", "Transpiration", "M", "Output_ET", ""),
    ("actTransTotal_forest", "Forest", "M", "Output_Trans", ""),
    ("actTransTotal_grasslands", "Grasslands", "M", "Output_Trans", ""),
    ("actTransTotal_paddy", "Paddy", "M", "Output_Trans", ""),
    ("actTransTotal_nonpaddy", "non-Paddy", "M", "Output_Trans", ""),
    ("sum_actBareSoilEvap", "Bare soil evap.", "M", "Output_ET", ""),
    ("sum_interceptEvap", "Intercept evap.", "M", "Output_ET", ""),
    ("sum_openWaterEvap", "Open water evap.", "M", "Output_ET", ""),
    ("addtoevapotrans", "Application loss", "M", "Output_ET", ""),
    ("snowEvap", "Snow evap.", "M", "Output_ET", ""),
    ("iceEvap", "Ice evap.", "M", "Output_ET", "ice"),
    ("lakeResInflowM", "Lake inflow", "M", "Input_LR", ""),
    ("EvapWaterBodyM", "Lake evap.", "M", "Output_LR", ""),
    ("act_bigLakeResAbst", "Delivered lake", "M", "Output_LR", ""),
    ("lakeResOutflowM", "Lake discharge", "M", "Output_LR", ""),
    ("lakeResStorage", "Lake storage", "M3", "Storage_LR", ""),
    ("baseflow", "Baseflow", "M", "Output_GW", ""),
    ("Rain", "Rain", "M", "Input_Soil", ""),
    ("Snow", "Snow", "M", "Input_Soil", ""),
    ("act_totalIrrConsumption", "Effective irrigation", "M", "Input_Soil", ""),
    ("sum_actTransTotal", "Transpiration", "M", "Output_Soil", ""),
    ("sum_actBareSoilEvap", "Bare soil evap.", "M", "Output_Soil", ""),
    ("sum_interceptEvap", "Intercept evap.", "M", "Output_Soil", ""),
    ("sum_openWaterEvap", "Open water evap.", "M", "Output_Soil", ""),
    ("sum_runoff", "Runoff", "M", "Output_Soil", ""),
    ("sum_gwRecharge", "GW recharge", "M", "Output_Soil", ""),
    ("snowEvap", "Snow evap.", "M", "Output_Soil", ""),
    ("totalSto", "Soil*", "M", "Storage_Soil", ""),
    ("act_domConsumption", "Domestic consumption", "M", "Output_Consumption", "consumption"),
    ("act_indConsumption", "Industrial consumption", "M", "Output_Consumption", "consumption"),
    ("act_livConsumption", "Livestock consumption", "M", "Output_Consumption", "consumption"),
    ("act_nonpaddyConsumption", "non-Paddy Effective Irrigation", "M", "Output_Consumption", "consumption"),
    ("act_paddyConsumption", "Paddy Effective Irrigation", "M", "Output_Consumption", "consumption"),
    ("addtoevapotrans", "Evap. application loss", "M", "Output_Consumption", "consumption"),
    ("returnflowIrr", "Irr Return flow", "M", "Output_Consumption", "consumption"),
    ("returnflowNonIrr", "Non-Irr Return flow", "M", "Output_Consumption", "consumption"),
    ("unmet_lost", "Non-lost fossil water", "M", "Output_Consumption", "consumption"),
    ("act_SurfaceWaterAbstract", "Surface water abst. (applied)", "M", "Input_Consumption", "consumption"),
    ("reservoir_transfers_from_outside_M3", "Desalinated", "M3", "Input", "transfers"),
    ("reservoir_transfers_from_outside_M3", "Desalinated", "M3", "Input_LR", "transfers"),
    ("act_irrWithdrawal", "Irr abstractions", "M", "Input_Withdrawal", "withdrawals"),
    ("act_nonIrrWithdrawal", "nonIrr abstractions", "M", "Input_Withdrawal", "withdrawals"),
]
# Sources and sectors whose pairs are withdrawals, and the second catalogue's change.
WITHDRAWAL_SOURCES = ("Channel", "Lake", "Res", "GW")
WITHDRAWAL_SECTORS = ("Domestic", "Livestock", "Industry", "Irrigation")
SECOND_EDITION_UNITS = {"EvapoChannel": "M3"}
SECOND_EDITION_LABELS = {
    "act_nonIrrConsumption": "non-Irrigation consumption", "dis_outlet": "Downstream outflow", "addtoevapotrans": "Evap. application loss",
}
OPTIONS = (
    "coupled", "limited", "unlimited", "withdrawals", "consumption", "transfers", "lifts", "small_lakes", "ice", "crops",
)


def _split_role(role: str) -> tuple[str, str]:
    """`Output_GW` is the role Output of the section GW; a plain role belongs to the basin."""
    kind, _, section = role.partition("_")
    return kind, section or "Basin"


def flux_catalog(spark: SparkSession, options: set[str] = frozenset(), crops: int = 0, edition: int = 1) -> DataFrame:
    """Catalogue rows that the options call for, as a broadcast table of known size.

    The second edition takes abstraction as limited unless `unlimited` is asked for.
    """
    unknown = set(options) - set(OPTIONS)
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}, expected some of {OPTIONS}")
    active = set(options) - {"unlimited"}
    if edition == 2 and not {"coupled", "unlimited"} & set(options):
        active.add("limited")
    if "coupled" not in active and "limited" not in active:
        active |= {"fossil", "fossil_withdrawals" if "withdrawals" in active else "fossil_no_withdrawals"}
    if "coupled" in active:
        active.discard("limited")
    rows = list(ROWS)
    rows += [
        (f"{a}_{b}", f"{a}_{b}", "M", "Output_Withdrawal", "withdrawals") for a in WITHDRAWAL_SOURCES for b in WITHDRAWAL_SECTORS
    ]
    rows += [(f"Lift_{b}", f"Lift_{b}", "M", "Output_Withdrawal", "lifts") for b in WITHDRAWAL_SECTORS]
    for c in range(crops):
        rows += [
            (f"actTransTotal_crops_Irr[{c}]", f"Trans Irr crop {c}", "M", "Output_irrTrans", "crops"),
            (f"actTransTotal_crops_nonIrr[{c}]", f"Trans nonIrr crop {c}", "M", "Output_nonirrTrans", "crops"),
            (f"irr_crop[{c}]", f"Irr crop {c}", "M", "Input_Withdrawal_crops", "crops"),
        ]
    chosen = []
    for variable, label, unit, role, needs in rows:
        wanted = needs[1:] not in active if needs.startswith("!") else not needs or needs in active
        if wanted:
            if edition == 2:
                unit = SECOND_EDITION_UNITS.get(variable, unit)
                label = SECOND_EDITION_LABELS.get(variable, label)
            kind, section = _split_role(role)
            chosen.append((variable, label, unit, kind, section, needs))
    return small_table(spark, chosen, SCHEMA)


def extend(catalog: DataFrame, more: DataFrame) -> DataFrame:
    """Catalogue with further rows, each pair of variable, role and section once."""
    return catalog.unionByName(more, allowMissingColumns=True).dropDuplicates(["variable", "role", "section"])


def for_variables(catalog: DataFrame, series: DataFrame) -> DataFrame:
    """Rows of the catalogue whose variable the series holds."""
    return catalog.join(series.select("variable").distinct(), "variable", "left_semi").select(
        "variable", "label", "unit_class", "section", F.col("role")
    )
