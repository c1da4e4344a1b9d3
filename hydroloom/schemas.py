"""Fixed schemas of the tables the library reads and writes."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_L, _I, _D, _S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

CELL = _struct(cell_id=_L, row=_I, col=_I, lat=_D, lon=_D, area=_D, zone=_I)
CELL_SERIES = _struct(variable=_S, date=T.DateType(), cell_id=_L, value=_D)
LDD = _struct(cell_id=_L, down_id=_L)
GAUGE = _struct(gauge_id=_L, cell_id=_L)
STATION_CSV = _struct(
    ID_numeric=_I, ID=_S, Provider=_S, River=_S, Station=_S, Country=_S,
    lat=_D, lon=_D, DrainArPro=_D, DrainArLDD=_D,
)
OBSERVATION = _struct(station_id=_S, date=T.DateType(), q=_D)
SERIES = _struct(run_id=_S, station_id=_S, date=T.DateType(), q=_D)
FLUX_CATALOG = _struct(variable=_S, label=_S, unit_class=_S, section=_S, role=_S)
PARAM_RANGE = _struct(name=_S, min=_D, max=_D, start=_D)
READING = _struct(
    event_id=_L, ts=T.TimestampType(), user_id=_L, event_type=_S, value=_D, props=_S
)
