"""Column names and types of the input tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


LONG, INT, DOUBLE, TEXT, DATE, MOMENT = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.DateType(), T.TimestampNTZType(),
)

EVENTS = _schema(
    index=LONG, start=MOMENT, end=MOMENT, type=TEXT, P=DOUBLE,
    dD=DOUBLE, dD_dev=DOUBLE, dO=DOUBLE, dO_dev=DOUBLE,
)

WEATHER = _schema(rownum=INT, date=DATE, time=INT, temp=DOUBLE, rh=DOUBLE, gph=DOUBLE)

TRACKS = _schema(
    run=INT, receptor=INT, hour_along=INT, traj_dt=MOMENT, lat=DOUBLE, lon=DOUBLE, height=DOUBLE,
    traj_dt_i=MOMENT, lat_i=DOUBLE, lon_i=DOUBLE, height_i=DOUBLE, pressure=DOUBLE, theta=DOUBLE,
    air_temp=DOUBLE, rainfall=DOUBLE, mixdepth=DOUBLE, rh=DOUBLE, sp_humidity=DOUBLE,
    h2o_mixrate=DOUBLE, terr_msl=DOUBLE, sun_flux=DOUBLE, index=LONG,
)

VERTICES = _schema(poly_id=LONG, kind=TEXT, ring=INT, seq=INT, lon=DOUBLE, lat=DOUBLE)
